"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled
texts. A text is compressed once with each dictionary, block by block so that the dictionary
counts over the whole text and not only over its start; the language with the smallest sum wins.
A narrow margin rejects the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import map_batches
from .common import by_bytes, free_names, text_bytes

#: Bounds of what is learned: sampled texts for a language (about), bytes of a dictionary.
SAMPLE_TEXTS, DICTIONARY_BYTES = 400, 512 * 1024
#: Bytes of a block, and zstandard's level.
BLOCK_BYTES, LEVEL = 16 * 1024, 5
#: Bytes of text that leave a worker together (one document at least).
PART_BYTES = 4 << 20
#: A text is rejected if the best language saves less than this share of the runner-up's bytes.
NARROW = 0.004

#: Capital ASCII letters become small; ASCII characters that are no letters become spaces, signs and digits nothing.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalpha())

_letter = regex.compile(r"\p{L}").search


def plain(text: bytes) -> bytes:
    """What is compressed: letters in small case and spaces; letters outside ASCII stay as they are."""
    return text.translate(_PLAIN, _SIGNS)


@dataclass(frozen=True)
class CompressionModel:
    """One dictionary for each language, in the order of the languages' code points."""

    dictionaries: tuple[tuple[str, bytes], ...]

    def compressors(self, level: int = LEVEL) -> list[tuple[str, zstandard.ZstdCompressor]]:
        made = []
        for language, content in self.dictionaries:
            parameters = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0)
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=parameters)
            made.append((language, zstandard.ZstdCompressor(dict_data=data, compression_params=parameters)))
        return made


def classify(text: bytes, compressors: list) -> tuple[str, float, float]:
    """language, score and margin: the share of the runner-up's bytes that the winner saves.

    ``und`` with score 0 if the text has no letter or nothing was learned. Ties go to the language
    first in code-point order. The score is 0.5 at a tie and nears 1 as the margin grows.
    """
    if not compressors or not _letter(text.decode("utf-8", "replace")):
        return "und", 0.0, 0.0
    text, sizes = plain(text), []
    for language, compressor in compressors:
        compress = compressor.compress
        sizes.append((sum(len(compress(text[i : i + BLOCK_BYTES])) for i in range(0, len(text), BLOCK_BYTES)), language))
    sizes.sort()
    best, language = sizes[0]
    if len(sizes) == 1:
        return language, 1.0, 1.0
    margin = (sizes[1][0] - best) / sizes[1][0]
    return language, 0.5 + 0.5 * min(1.0, 5 * margin), margin


def held_out(column: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, label: str = "lang", texts: int = SAMPLE_TEXTS, dictionary_bytes: int = DICTIONARY_BYTES) -> CompressionModel:
    """Learns from the rows of docs (text and a label), nulls in either left out.

    The bound: about ``texts`` texts a language, taken by a hash of the text, go whole into its
    dictionary, in the hash's order, as far as ``dictionary_bytes`` bytes hold them; one that no
    longer fits is left out for the next. (A language whose sampled texts are all longer than a
    dictionary fills it with the first of them.) Only that sample, of which no text is longer than a
    dictionary, reaches the driver. Repeated texts count once.
    """
    rows = docs.where(F.col(label).isNotNull() & (F.length("text") > 0)).select(F.col(label).alias("_label"), "text")
    counts = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    if not counts:
        return CompressionModel(())
    # The share of a language that is wanted, in 2 ** 20ths of the hash's range.
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1 << 20, (texts << 20) // n + 1)))), F.col("_label"))
    key = F.xxhash64("text", F.lit("fit"))
    fits = F.octet_length("text") <= dictionary_bytes
    text = F.when(fits, F.col("text")).otherwise(F.substring("text", 1, dictionary_bytes))
    sample = rows.where(F.pmod(key, F.lit(1 << 20)) < share).select("_label", key.alias("key"), fits.alias("fits"), text.alias("text")).distinct().collect()
    found: dict[str, list[tuple[bool, int, str]]] = {}
    for language, k, whole, text in sample:
        found.setdefault(language, []).append((not whole, k, text))
    dictionaries = []
    for language in sorted(found, key=str.encode):
        parts, size = [], 0
        for _, _, text in sorted(found[language]):
            raw = plain(text.encode("utf-8", "replace")) + b" "
            if not parts or size + len(raw) <= dictionary_bytes:
                parts.append(raw)
                size += len(raw)
        dictionaries.append((language, b"".join(parts)[:dictionary_bytes]))
    return CompressionModel(tuple(dictionaries))


def predict(docs: DataFrame, model: CompressionModel, keep: tuple[str, ...] = ("doc_id",), narrow: float = NARROW) -> DataFrame:
    """The columns in keep, lang_pred, score, margin and lang_rejected of every row, from its whole text alone.

    A null, empty or letterless text is ``und``, score 0, and rejected, as is a text whose margin is
    under narrow. Repeated rows stay repeated; an empty table gives none. A column in keep of a
    result's name is replaced by that result.
    """
    added = "lang_pred string, score double, margin double, lang_rejected boolean"
    names = [a.split()[0] for a in added.split(", ")]
    keep = tuple(c for c in keep if c.lower() not in names)
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), added])
    models = docs.sparkSession.sparkContext.broadcast(model.dictionaries)  # languages times dictionary_bytes at most
    # The text goes to Python once, also where it is kept.
    there = keep.index("text") if "text" in keep and docs.schema["text"].dataType.simpleString() == "string" else len(keep)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = CompressionModel(models.value).compressors()
        for whole in batches:
            for batch in by_bytes(whole, there, PART_BYTES):
                texts = batch.column(there).cast(pa.binary())
                rows = [classify(x.as_py() or b"", compressors) for x in texts]
                columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())]
                rejected = pa.array([r[0] == "und" or r[2] < narrow for r in rows], pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], *columns, rejected], names=[*keep, *names])

    text = [text_bytes().alias(free_names(docs, "_text")[0])] if there == len(keep) else []
    return map_batches(docs.select(*(F.col(f"`{c}`") for c in keep), *text), predicted, schema)
