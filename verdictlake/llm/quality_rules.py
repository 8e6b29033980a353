"""Quality rules: counts from the text, then bands of n-gram perplexity for each language.

The language model is a modified Kneser-Ney model of ORDER code points. Its n-grams are counted by
Spark over every document, language by language, and estimated in Spark tables that grow with the
corpus: each order's table is joined with its contexts and with the order below. An n-gram of
the orders above two that was met once gives its mass to the order below, so that a text is not
made likely by its own count. The probabilities end in arrays sorted by a 64-bit hash of the n-gram,
which are looked up by binary search.

Up to MODEL_GRAMS n-grams, one array a language is broadcast. Beyond, documents are dealt into
blocks, and each block gets the sorted arrays of its own n-grams as files in the shared folder, so
that no task holds more than what its block needs. Both ways give the same results.

A text's perplexity is judged against its language's band, which is wider for short texts, whose
mean is less certain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_batches, ship_package
from .common import get, new_folder, put, text_bytes, written

#: Code points of an n-gram, and the least count with which one of three or more keeps a probability of its own.
ORDER, LEAST_COUNT = 5, 2
#: N-grams of all languages up to which the model is broadcast (12 bytes each), bytes of text of a block beyond, positions counted at a time.
MODEL_GRAMS, BLOCK_BYTES, POSITIONS = 4_000_000, 48 << 20, 4_000_000
#: A band reaches this many standard deviations below and above the middle.
LOWER, UPPER = 3.5, 7.0
#: A document fails with fewer words, or if more than this percentage of them stand in repeated 5-word windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5

_SPACE, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _SPACE).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    duplicates = len(lines) - len(set(lines))
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) < len(windows):
            times: dict = {}
            for w in windows:
                times[w] = times.get(w, 0) + 1
            covered = 0  # words counted so far reach up to this place
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeated += i + WINDOW - max(i, covered)
                    covered = i + WINDOW
    return n, chars, symbols, duplicates, repeated


def symbols_of(text: bytes) -> np.ndarray:
    """The code points of a text's words joined by single spaces, after ORDER - 1 spaces."""
    joined = b" " * (ORDER - 1) + b" ".join(text.split())
    return np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")


def hashes_of(symbols: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the n-gram that ends at each symbol after the first ORDER - 1."""
    n = max(0, len(symbols) - ORDER + 1)
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out *= np.uint64(0x5851F42D4C957F2D)
        out += symbols[k : k + n]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0x9E3779B97F4A7C15)


def hashes_of_grams(grams: list[str]) -> np.ndarray:
    """The same hash of n-grams given as strings."""
    points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, ORDER)
    out = np.zeros(len(points), np.uint64)
    for k in range(ORDER):
        out = out * np.uint64(0x5851F42D4C957F2D) + points[:, k]
    return (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def _rows(docs: DataFrame, language: str) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col(language).cast("string"), F.lit("")).alias("language"), text_bytes().alias("text"))


def count_ngrams(rows: DataFrame, by_block: bool = False) -> DataFrame:
    """language, gram and n (with by_block also block): the count of every n-gram of ORDER code points over all rows.

    Partial counts leave each task's parts of POSITIONS n-grams; Spark adds them up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (block, name), parts in held.items():
                points = np.concatenate(parts)  # the leading spaces of a text part it from the one before
                keys, first, n = np.unique(hashes_of(points), return_index=True, return_counts=True)
                if len(parts) > 1:  # n-grams that begin in one text and end in the next are none
                    ends = np.cumsum([len(x) for x in parts])[:-1]
                    over = (ends[:, None] + np.arange(1 - ORDER, 0)[None, :]).ravel()
                    lost, times = np.unique(hashes_of(points)[over], return_counts=True)
                    n[np.searchsorted(keys, lost)] -= times
                there = n > 0
                first, n = first[there], n[there]
                text = points[first[:, None] + np.arange(ORDER)].tobytes().decode("utf-32-le", "surrogatepass")
                grams = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(grams), pa.int64()), pa.array([name] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n.astype(np.int64))],
                    names=["block", "language", "gram", "n"],
                )
            held.clear()

        for batch in batches:
            for block, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                points = symbols_of(text.as_py())
                if len(points) >= ORDER:
                    held.setdefault((block, name), []).append(points)
                    size += len(points)
                if size > POSITIONS:
                    yield from flush()
                    size = 0
        yield from flush()

    block = F.col("block") if by_block else F.lit(0).cast("long").alias("block")
    parts = map_batches(rows.select(block, "language", "text"), count, "block long, language string, gram string, n long")
    return parts.groupBy(*["block"] * by_block, "language", "gram").agg(F.sum("n").alias("n"))


def _discounts(n: list) -> list:
    """The three discounts of modified Kneser-Ney for counts 1, 2 and more from the counts of counts 1 to 4; plain values where these are too few."""
    few = (n[0] == 0) | (n[1] == 0) | (n[2] == 0) | (n[3] == 0)
    n = [F.greatest(F.lit(1), x) for x in n]
    y = n[0] / (n[0] + 2 * n[1])
    found = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [F.when(few, plain).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(k + 0.95), x))) for k, (x, plain) in enumerate(zip(found, (0.5, 0.75, 0.9)))]


def estimate(counts: DataFrame) -> DataFrame:
    """language, gram and p: the probability of the last code point after the others, for every n-gram of counts (language, gram, n).

    Orders below the highest count distinct left neighbours. What discounts and pruned n-grams leave
    of a context goes to the order below, and at the lowest to all code points of the language and
    one for those never met, so that every context's probabilities add up to 1.
    """
    tables = {ORDER: written(counts.select("language", "gram", F.col("n").alias("c")), "grams")}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = written(tables[k + 1].groupBy("language", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")), "grams")
    classes = lambda c: [F.sum((c == x).cast("long")).alias(f"n{x}") for x in (1, 2, 3, 4)]
    found = None
    for k, t in tables.items():
        one = t.groupBy("language").agg(*classes(F.col("c")), F.count("*").alias("kinds")).withColumn("order", F.lit(k))
        found = one if found is None else found.unionByName(one)
    d = _discounts([F.col(f"n{x}") for x in (1, 2, 3, 4)])
    discounts = written(found.select("language", "order", "kinds", *(x.alias(f"d{i}") for i, x in enumerate(d, 1))), "discounts")  # a row for each language and order
    lower = None
    for k in range(1, ORDER + 1):
        least = 1 if k < 3 else LEAST_COUNT
        own = F.broadcast(discounts.where(F.col("order") == k).drop("order"))
        t = tables[k].select("language", "gram", "c", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("below"))
        kept = F.col("c") >= least
        w = t.groupBy("language", "context").agg(
            F.sum("c").alias("total"), F.sum(F.when(kept, F.col("c")).otherwise(0)).alias("kept"),
            *(F.sum((kept & (F.col("c") == x if x < 3 else F.col("c") >= 3)).cast("long")).alias(f"m{x}") for x in (1, 2, 3)),
        )
        w = w.join(own, "language").select(
            "language", "context", "total", ((F.col("kept") - F.col("m1") * F.col("d1") - F.col("m2") * F.col("d2") - F.col("m3") * F.col("d3")) / F.col("total")).alias("share"), "d1", "d2", "d3", "kinds"
        )
        t = t.join(w, ["language", "context"])
        taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        mass = F.when(kept, (F.col("c") - taken) / F.col("total")).otherwise(F.lit(0.0))
        if lower is None:
            under = 1 / (F.col("kinds") + 1)
        else:
            t, under = t.join(lower.withColumnsRenamed({"gram": "below", "p": "p_below"}), ["language", "below"]), F.col("p_below")
        lower = written(t.select("language", "gram", (mass + (1 - F.col("share")) * under).alias("p")), "model")
    return lower


def _arrays(grams: list[str], p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and the natural logarithms of the probabilities beside them."""
    keys = hashes_of_grams(grams) if len(grams) else np.zeros(0, np.uint64)
    keys, first = np.unique(keys, return_index=True)
    return keys, np.log(p[first]).astype(np.float32)


class Lookup:
    """Search in sorted hashes: a directory over their leading bits leads to a few neighbours, which binary search would reach in many steps."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray) -> None:
        self.n = len(keys)
        if self.n:
            bits = min(22, self.n.bit_length() + 1)
            self.shift = np.uint64(64 - bits)
            self.starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
            self.keys, self.logs = np.append(keys, np.uint64(2**64 - 1)), np.append(logs, logs.min())  # the end stands for what is missing

    def log_probabilities(self, text: bytes) -> np.ndarray:
        """The log probability of every code point of a text; an n-gram that the model has not met is as likely as its least likely one."""
        wanted = hashes_of(symbols_of(text))
        if not self.n or not len(wanted):
            return np.zeros(0)
        at = self.starts[wanted >> self.shift]
        open_ = np.flatnonzero(self.keys[at] < wanted)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.keys[at[open_]] < wanted[open_]]
        at[self.keys[at] != wanted] = self.n
        return self.logs[at].astype(np.float64)


def _deal(rows: DataFrame) -> DataFrame:
    """rows with a block number, written: a block holds consecutive rows of one task, BLOCK_BYTES of text and one text at most."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            blocks = []
            for text in batch.column(2):
                if held > BLOCK_BYTES:
                    block, held = block + 1, 0
                blocks.append(block)
                held += text.as_buffer().size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], names=["doc_id", "language", "text", "block"])

    return written(map_batches(rows.withColumn("doc_id", F.col("doc_id").cast("long")), deal, "doc_id long, language string, text binary, block long"), "blocks")


def _place(folder: str, block: int, language: str) -> str:
    return f"{folder}/{block}-{hashlib.md5(language.encode()).hexdigest()}.npy"


@lru_cache(maxsize=8)
def _load(uri: str) -> Lookup:
    raw = get(uri)
    n = len(raw) // 12
    return Lookup(np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<f4", n, 8 * n))


def _store(model: DataFrame, counts: DataFrame) -> Callable:
    """Writes each block's sorted arrays for each of its languages; returns how a task reads them."""
    folder = new_folder(model.sparkSession, "lookup")
    ship_package(model.sparkSession)

    def write(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys, logs = _arrays(group["gram"].tolist(), group["p"].to_numpy())
        put(_place(folder, *key), keys.astype("<u8").tobytes() + logs.astype("<f4").tobytes())
        return pd.DataFrame({"n": [len(keys)]})

    pairs = counts.select("block", "language", "gram").join(model, ["language", "gram"])
    written(pairs.groupBy("block", "language").applyInPandas(write, "n long"), "lookups")
    return lambda block, language: _load(_place(folder, block, language))


def score(rows: DataFrame, lookup: Callable) -> DataFrame:
    """doc_id, language, the base counts, base_failed, scored, log_perplexity and its variance a symbol, for every row (doc_id, language, text, block)."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = "doc_id long, language string, " + ", ".join(f"{c} long" for c in counts) + ", scored long, log_perplexity double, variance double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, text, block in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                text = text.as_py()
                base = base_counts(text)
                logs = lookup(block, name).log_probabilities(text) if base[0] else np.zeros(0)
                n = len(logs)
                found.append((*base, n, -float(logs.mean()) if n else 0.0, float(logs.var()) if n else 0.0))
            frame = pd.DataFrame(found, columns=[*counts, "scored", "log_perplexity", "variance"])
            arrays = [batch.column(0).cast(pa.int64()), batch.column(1), *(pa.array(frame[c]) for c in frame.columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "language", *frame.columns])

    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return map_batches(rows.select("doc_id", "language", "text", "block"), scored, schema).withColumn("base_failed", failed)


def scores(docs: DataFrame, language: str = "lang", model_grams: int = MODEL_GRAMS) -> DataFrame:
    """score() of every row of docs by the model of all of them."""
    spark, rows = docs.sparkSession, _rows(docs, language)
    model = estimate(count_ngrams(rows))
    if model.count() <= model_grams:
        table = model.toArrow()  # model_grams rows at most
        arrays = {}
        for name in set(table.column("language").to_pylist()):
            part = table.filter(pc.equal(table.column("language"), name))
            arrays[name] = _arrays(part.column("gram").to_pylist(), part.column("p").to_numpy())
        shared, none, ready = spark.sparkContext.broadcast(arrays), (np.zeros(0, np.uint64), np.zeros(0, np.float32)), {}

        def lookup(block: int, name: str) -> Lookup:
            if name not in ready:
                ready[name] = Lookup(*shared.value.get(name, none))
            return ready[name]

        return written(score(rows.withColumn("block", F.lit(0).cast("long")), lookup), "scores")
    blocks = _deal(rows)
    return written(score(blocks, _store(model, count_ngrams(blocks, by_block=True))), "scores")


def bands(found: DataFrame) -> DataFrame:
    """language, middle, spread and noise: of the documents that the base keeps, the median log perplexity, a robust standard deviation and the variance a symbol."""
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000)
    grouped = found.where("not base_failed and scored > 0").groupBy("language").agg(quartiles.alias("q"), F.percentile_approx("variance", 0.5, 10_000).alias("noise"))
    return grouped.select("language", F.col("q")[1].alias("middle"), ((F.col("q")[2] - F.col("q")[0]) / 1.349).alias("spread"), "noise")


def judge(docs: DataFrame, language: str = "lang", below: float = LOWER, above: float = UPPER, model_grams: int = MODEL_GRAMS) -> DataFrame:
    """doc_id, the base counts, base_failed, log_perplexity, lower, upper and kept for every row of docs (doc_id, text, a language).

    kept is false for base failures and for texts outside their language's band. A null text has no
    words and fails. A null language is one of its own. Repeated rows stay repeated and count as
    often. An empty table gives none; other columns are ignored.
    """
    found = scores(docs, language, model_grams)
    deviation = F.sqrt(F.col("spread") ** 2 + F.col("noise") / F.greatest(F.lit(1), "scored"))  # the mean of a short text is less certain
    joined = found.join(F.broadcast(bands(found)), "language", "left")  # a row for each language
    joined = joined.withColumn("lower", F.col("middle") - below * deviation).withColumn("upper", F.col("middle") + above * deviation)
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_perplexity", "lower", "upper"]
    return joined.withColumn("kept", ~F.col("base_failed") & inside).select(*columns, "kept")


#: DuckDB SQL for the base counts and the base's verdict.
BASE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), c AS (
  SELECT *, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), w AS (
  SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d)
), v AS (
  SELECT r, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p AS five FROM w WINDOW p AS (PARTITION BY r ORDER BY i)
), twice AS (
  SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, five) AS n FROM v WHERE five IS NOT NULL) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(n, 0) > 20 * n_words AS base_failed
FROM c LEFT JOIN covered USING (r)
"""
