"""Secret scans through a trigram inverted index, with DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query: an OR of ANDs of trigrams one of
which every match's text must hold (compare the published description of trigram code search).
The index holds, for each trigram that some query asks for, postings of the texts that hold it,
by blocks of texts so that no posting list grows with the corpus. Postings are intersected and
united block by block; only the texts that are left are verified with the rule's expression. A
rule without mandatory trigrams is verified on every text.

A text's key in the postings is its hash. Copies share one; two texts that collide can only make
each other candidates, which verification settles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, written

try:  # the parser of regular expressions, whose place depends on the Python version
    from re import _constants as sre_constants
    from re import _parser as sre_parse
except ImportError:  # Python before 3.11
    import sre_constants
    import sre_parse

#: Texts that a block of the index should hold.
BLOCK_TEXTS = 20_000
#: Candidate texts up to which their keys are broadcast (some 100 bytes each); beyond, texts and keys are joined by a shuffle.
BROADCAST_KEYS = 100_000
#: Matches whose positions are put together at a time, so that no long list is copied for each of them.
LOT = 256
#: More alternatives than this are not followed when a query is derived.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern, left to right without overlap; those whose group is shorter than least are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base kinds, then well-known published token formats.
BASE_RULES = (
    Rule(
        "assign",
        r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # the runs of [0-9a-f]+ that have 32 characters or more
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + MORE_RULES

# What redact() takes out: of a private key the whole block, up to its END line or, without one, as far as base64 lines go, however many.
# Repeats are possessive: they take what they can in a loop, without a step of the stack for each line.
_BODY = r"(?:[\s\\]*(?:Proc-Type|DEK-Info):[^\n\\]*){0,2}(?:[\s\\]*+[A-Za-z0-9+/=]{16,}+)++(?:\s*[A-Za-z0-9+/]+={1,2}|\r?\n[A-Za-z0-9+/]{1,15}(?=\s*\n|\s*$))?"
KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----|" + _BODY + ")?"
REDACTED = tuple(Rule(r.kind, KEY_BLOCK) if r.kind == "private_key" else r for r in RULES)

Clauses = frozenset  # of frozensets of trigrams: an OR of ANDs; a clause without trigrams asks for nothing


def _smallest(clauses) -> Clauses:
    """Without clauses that a smaller one implies."""
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _of_strings(strings: set[str]) -> Clauses:
    return _smallest(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _both(a: Clauses, b: Clauses) -> Clauses:
    joined = _smallest(x | y for x in a for y in b)
    return joined if len(joined) <= MOST_STRINGS else a


NOTHING: Clauses = frozenset({frozenset()})


def _analyse(items) -> tuple[set[str] | None, Clauses]:
    """For a parsed expression: all strings that it matches (small case), if they are few, and its query."""
    strings: set[str] | None = {""}
    query, run, open_start = NOTHING, {""}, False
    for op, arg in items:
        found, inner = _analyse_one(op, arg)
        if found is not None and len(run) * len(found) <= MOST_STRINGS:
            run = {a + b for a in run for b in found}
            continue
        # A run of known strings ends here.
        query, run, open_start = _both(query, _of_strings(run)), {""}, True
        if found is not None:
            run = set(found)
        else:
            query = _both(query, inner)
    if open_start:
        strings = None
    else:
        strings = run
    return strings, _both(query, _of_strings(run))


def _analyse_one(op, arg) -> tuple[set[str] | None, Clauses]:
    c = sre_constants
    if op is c.LITERAL:
        return {chr(arg).lower()}, NOTHING
    if op is c.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is c.LITERAL:
                found.add(chr(value).lower())
            elif kind is c.RANGE and value[1] - value[0] < 8:
                found.update(chr(x).lower() for x in range(value[0], value[1] + 1))
            else:
                return None, NOTHING
        return (found, NOTHING) if len(found) <= 8 else (None, NOTHING)
    if op is c.SUBPATTERN:
        return _analyse(arg[-1])
    if op is c.BRANCH:
        parts = [_analyse(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return set().union(*(s for s, _ in parts)), NOTHING
        return None, _smallest(q for _, query in parts for q in query)
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        low, high, inner = arg
        found, query = _analyse(inner)
        if found is not None and high <= 1:
            return found | {""} if low == 0 else found, NOTHING
        return None, query if low > 0 else NOTHING
    if op is c.AT:
        return {""}, NOTHING
    return None, NOTHING


def trigram_query(pattern: str) -> Clauses | None:
    """The OR of ANDs of small-case trigrams that a matching text must satisfy; None if there is none."""
    query = _analyse(sre_parse.parse(pattern))[1]
    return None if frozenset() in query or not query else query


def _key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def build_index(docs: DataFrame, trigrams: list[str], block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """block and, for each trigram in order, a column t0, t1, ... with the keys of the block's texts that hold it."""
    blocks = max(1, -(-docs.count() // block_texts))
    small = docs.select(F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("small"), _key().alias("key"))
    held = small.select("key", *(F.contains("small", F.lit(t)).alias(f"h{i}") for i, t in enumerate(trigrams)))
    block = F.pmod(F.col("key"), F.lit(blocks)).alias("block")
    some = [F.col(f"h{i}") for i in range(len(trigrams))]
    anything = some[0]
    for x in some[1:]:
        anything = anything | x
    return held.where(anything).groupBy(block).agg(*(F.collect_set(F.when(F.col(f"h{i}"), F.col("key"))).alias(f"t{i}") for i in range(len(trigrams))))


def _labelled(keys: Column, kind: str) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(kind).alias("rule")))


def candidates(index: DataFrame, trigrams: list[str], queries: dict[str, Clauses]) -> DataFrame:
    """key and rules: the kinds whose query the postings satisfy, one row for each key that has any."""
    at = {t: F.col(f"t{i}") for i, t in enumerate(trigrams)}
    found = []
    for kind, clauses in queries.items():
        united = None
        for clause in sorted(map(sorted, clauses)):
            met = at[clause[0]]
            for t in clause[1:]:
                met = F.array_intersect(met, at[t])
            united = met if united is None else F.array_union(united, met)
        found.append(_labelled(united, kind))
    pairs = index.select(F.explode(F.concat(*found)).alias("p")).select("p.key", "p.rule")
    return pairs.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """The rule's kept matches as an array of (start, kind's place, stop), code points."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    between = F.split(text, rule.pattern, -1)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["between"])
        stop = start + F.length(x["match"])
        added = F.concat(state["out"], start.cast("string"), F.lit(":"), stop.cast("string"), F.lit(","))
        out = F.when(F.length(x["judged"]) >= rule.least, added).otherwise(state["out"])
        return F.struct(F.coalesce(stop, state["at"]).alias("at"), out.alias("out"))

    zipped = F.arrays_zip(between.alias("between"), matches.alias("match"), judged.alias("judged"))  # the rest after the last match has none

    def lot(state: Column, first: Column) -> Column:
        inner = F.aggregate(F.slice(zipped, first, LOT), F.struct(state["at"].alias("at"), F.lit("").alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(state["out"], inner["out"]).alias("out"))

    listed = F.when(F.size(matches) == 0, F.array().cast("array<string>")).otherwise(
        F.aggregate(
            F.sequence(F.lit(1), F.size(matches) + 1, F.lit(LOT)),
            F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lot,
            lambda state: F.filter(F.split(state["out"], ","), lambda x: x != ""),
        )
    )
    return F.transform(
        listed,
        lambda x: F.struct(
            F.substring_index(x, ":", 1).cast("int").alias("start"), F.lit(order).alias("kind"), F.substring_index(x, ":", -1).cast("int").alias("stop")
        ),
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """docs with a column ``secrets`` added: all spans as an array of (start, kind, stop), by start and then by the rules' order.

    Positions count code points of the whole text, stop is exclusive, kind is the rule's place in
    rules. A null or empty text has no spans. All rows and columns are kept, repeated ones too
    (a column of the name secrets is replaced). An empty table gives none.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    trigrams = sorted({t for clauses in queries.values() for clause in clauses for t in clause})
    text = F.coalesce(F.col("text"), F.lit(""))
    row_key, row_rules = free_names(docs, "_key", "_rules")
    if trigrams:
        index = written(build_index(docs, trigrams, block_texts), "trigrams")
        found = written(candidates(index, trigrams, queries).select(F.col("key").alias(row_key), F.col("rules").alias(row_rules)), "candidates")
        if found.count() <= BROADCAST_KEYS:
            found = F.broadcast(found)  # no text moves
        rows = docs.withColumn(row_key, _key()).join(found, row_key, "left")
    else:
        rows = docs.withColumn(row_key, F.lit(0)).withColumn(row_rules, F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    parts = []
    for order, rule in enumerate(rules):
        spans = _spans(rule, order, text)
        parts.append(F.when(F.array_contains(row_rules, rule.kind), spans).otherwise(none) if rule.kind in queries else spans)
    return rows.withColumn("secrets", F.array_sort(F.concat(*parts))).drop(row_key, row_rules)


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:stop of each span, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _of_kind(spans: Column, place: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == place)


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256 and spans for every row.

    Nulls, empty texts, repeated rows and empty tables are as in scan(); other columns are ignored.
    """
    rows = scan(docs, rules).select("doc_id", "secrets")
    first = F.filter("secrets", lambda s: s["kind"] < base)
    counts = [F.size(_of_kind(F.col("secrets"), i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])]
    return rows.select("doc_id", *counts, F.sha2(listed(first, rules).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets"), rules).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = REDACTED, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its texts replaced by mark (overlapping ones by one), n_chars following the text if there.

    A null or empty text stays as it is. All rows and columns are kept, repeated rows too; an empty
    table gives none.
    """
    rows = scan(docs, rules)

    def step(state: Column, s: Column) -> Column:
        text = F.col("text")
        kept = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        return F.struct(
            F.greatest(state["at"], s["stop"]).alias("at"), F.when(s["start"] >= state["at"], kept).otherwise(state["out"]).alias("out")
        )

    clean = F.aggregate(
        "secrets", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text")))
    )
    rows = rows.withColumn("text", F.when(F.size("secrets") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def oracle_sql(rules: tuple[Rule, ...] = RULES, base: int = len(BASE_RULES)) -> str:
    """DuckDB SQL for digest(): every rule's expression over every text, positions from the lengths of matches and of what lies between."""
    quoted = [r.pattern.replace("'", "''") for r in rules]
    parsed = ", ".join(
        f"regexp_extract_all(t, '{p}', 0) AS m{i}, regexp_extract_all(t, '{p}', {r.group}) AS j{i}, string_split_regex(t, '{p}') AS b{i}" for i, (r, p) in enumerate(zip(rules, quoted))
    )
    spans = ", ".join(
        f"list_filter(list_transform(range(1, len(m{i}) + 1), lambda x: {{'s': coalesce(list_sum(list_transform(b{i}[1:x], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m{i}[1:x - 1], lambda y: length(y))), 0), "
        f"'k': {i}, 'n': length(m{i}[x]), 'ok': length(j{i}[x]) >= {r.least}}}), lambda x: x.ok) AS s{i}"
        for i, r in enumerate(rules)
    )
    names = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    text = lambda last: f"coalesce(array_to_string(list_transform(list_sort(flatten([{', '.join(f's{i}' for i in range(last))}])), lambda x: {names}[x.k + 1] || ':' || x.s::BIGINT::VARCHAR || ':' || (x.s + x.n)::BIGINT::VARCHAR), ','), '')"
    counts = ", ".join(f"len(s{i})::BIGINT AS n_{r.kind}" for i, r in enumerate(rules[:base]))
    return f"SELECT doc_id, {counts}, sha256({text(base)}) AS base_sha256, {text(len(rules))} AS spans FROM (SELECT doc_id, {spans} FROM (SELECT doc_id, {parsed} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))"
