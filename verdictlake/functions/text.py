"""Text scalars as Columns. Each variant of a rule has its own name; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}"
_JOIN = "␟"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(c) -> Column:
    """Null to empty, runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), r"(?U)\s+", " "))


def normalize_bytes(c) -> Column:
    return normalize(F.decode(_col(c), "UTF-8"))


def join_parts(c, limit: int) -> Column:
    """A list joined by blank lines, no-break spaces made plain; beyond limit it ends in a mark."""
    text = F.replace(F.array_join(_col(c), "\n\n"), F.lit(" "), F.lit(" "))
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 20)), F.lit(" ... [TRUNCATED]"))).otherwise(text)


def cut(c, limit: int) -> Column:
    """NUL to space, cut at limit, trimmed."""
    return F.trim(F.substring(F.replace(F.coalesce(_col(c), F.lit("")), F.lit("\0"), F.lit(" ")), 1, limit))


def cut_with_ellipsis(c, limit: int) -> Column:
    text = F.trim(F.replace(F.coalesce(_col(c), F.lit("")), F.lit("\0"), F.lit(" ")))
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def strip_prefix(c, prefix: str) -> Column:
    text = normalize(c)
    return F.when(F.lower(text).startswith(prefix.lower()), F.trim(F.substring(text, len(prefix) + 1, 1 << 30))).otherwise(text)


PHONE = r"(?:\+?\d{1,2}[ .-])?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}"


def phone_numbers(c) -> Column:
    return F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(PHONE), F.lit(0))


def redact_phones(c, mark: str = "[PHONE]") -> Column:
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), PHONE, mark)


def cjk_count(*texts) -> Column:
    joined = F.concat(*(F.coalesce(_col(t), F.lit("")) for t in texts))
    return F.length(F.regexp_replace(joined, rf"[^{CJK}]", ""))


def language(*texts, least: int = 5) -> Column:
    """zh with at least that many CJK characters in all texts together, else en."""
    return F.when(cjk_count(*texts) >= least, "zh").otherwise("en")


def stable_sha1(*parts) -> Column:
    return F.sha1(F.concat_ws(_JOIN, *(F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts)).cast("binary"))


def stable_sha256(*parts, digits: int = 64) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", *(normalize(p) for p in parts)).cast("binary"), 256), 1, digits)


def content_key(task, prompt, a, b) -> Column:
    return stable_sha256(task, prompt, a, b, digits=32)


def hash_bucket(digest, modulus: int) -> Column:
    return F.conv(F.substring(_col(digest), 1, 8), 16, 10).cast("long") % modulus


def hash_split(digest, modulus: int = 100, train: int = 70, dev: int = 85) -> Column:
    bucket = hash_bucket(digest, modulus)
    return F.when(bucket < train, "train").when(bucket < dev, "dev").otherwise("test")


def first_non_blank(*candidates) -> Column:
    return F.coalesce(*(F.when(F.trim(_col(c)) != "", _col(c)) for c in candidates))


def first_number(*candidates) -> Column:
    return F.coalesce(*(F.expr(f"try_cast({c} as double)") for c in candidates))


# Words that carry no content.
STOPWORDS = (
    "a an and are as at be by for from in is it of on or that the to was were with".split()
)


def tokens(c) -> Column:
    """ASCII letter and digit runs and single CJK characters, small case, without stop words."""
    found = F.regexp_extract_all(F.lower(normalize(c)), F.lit(rf"[a-z0-9]+|[{CJK}]"), F.lit(0))
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    return F.filter(found, lambda t: ~F.array_contains(stop, t))


def token_set(c) -> Column:
    return F.array_distinct(tokens(c))


def word_set(c, least: int = 2) -> Column:
    """Runs of at least that many letters, digits or CJK characters, small case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(normalize(c)), F.lit(rf"[A-Za-z0-9{CJK}]{{{least},}}"), F.lit(0)))


def numbers(c) -> Column:
    found = F.regexp_extract_all(normalize(c), F.lit(r"\d+(?:[,.]\d+)?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(""))))


MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"


def dates(c) -> Column:
    text = normalize(c)
    years = F.regexp_extract_all(text, F.lit(r"\b(?:1[6-9]\d{2}|20\d{2}|21\d{2})\b"), F.lit(0))
    numeric = F.regexp_extract_all(text, F.lit(r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"), F.lit(0))
    named = F.regexp_extract_all(F.lower(text), F.lit(rf"\b(?:{MONTHS})\.?\s+\d{{1,2}}(?:,\s*\d{{4}})?\b"), F.lit(0))
    return F.array_distinct(F.concat(years, numeric, named))


def entities(c) -> Column:
    """Tokens that look like names: letters with digits, all capitals, capitalised, or long."""
    found = F.regexp_extract_all(normalize(c), F.lit(r"\b[A-Za-z][A-Za-z0-9-]*\b"), F.lit(0))
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    named = F.filter(
        found,
        lambda t: ~F.array_contains(stop, F.lower(t))
        & (t.rlike(r"\d") | t.rlike(r"^[A-Z]{2,}$") | t.rlike(r"^[A-Z][a-z]{2,}(?:-[A-Z][a-z]{2,})?$") | (F.length(t) >= 9)),
    )
    return F.array_distinct(F.transform(named, F.lower))


def alias_entities(c) -> Column:
    """Entities without hyphens, also without a plural s, and the initials of capitalised phrases."""
    plain = F.transform(entities(c), lambda t: F.replace(t, F.lit("-"), F.lit("")))
    singular = F.transform(F.filter(plain, lambda t: (F.length(t) > 4) & t.endswith("s")), lambda t: F.substring(t, F.lit(1), F.length(t) - 1))
    phrases = F.regexp_extract_all(normalize(c), F.lit(r"\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){1,5}\b"), F.lit(0))
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    initials = F.transform(phrases, lambda p: F.array_join(F.transform(F.filter(F.split(F.lower(p), " "), lambda w: ~F.array_contains(stop, w)), lambda w: F.substring(w, 1, 1)), ""))
    return F.array_distinct(F.filter(F.concat(plain, singular, F.filter(initials, lambda x: F.length(x) >= 2)), lambda x: x != ""))


def sentences(c) -> Column:
    text = normalize(c)
    return F.filter(F.split(text, r"(?<=[.!?。！？])\s+"), lambda s: s != "")


def sentence_count(c) -> Column:
    return F.greatest(F.lit(1), F.size(sentences(c)))


def long_sentences(c, limit: int, longer_than: int = 12) -> Column:
    return F.slice(F.filter(F.split(normalize(c), r"(?<=[.!?])\s+"), lambda s: F.length(s) > longer_than), 1, limit)


def bullet_count(c) -> Column:
    """On normalised text, where it is 0 or 1: only the start can be a line's start."""
    return F.regexp_count(normalize(c), F.lit(r"(^|\n)\s*[-*0-9]+[.)、-]"))


def number_count(c) -> Column:
    return F.regexp_count(normalize(c), F.lit(r"\d+(?:\.\d+)?"))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def coverage(a: Column, b: Column) -> Column:
    """The share of a's distinct items that b has; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a)))


def gap(a: Column, *blocks: Column) -> Column:
    """The share of a's distinct items that no block has; 0 if a is empty."""
    have = blocks[0]
    for b in blocks[1:]:
        have = F.array_union(have, b)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_except(a, have)) / F.size(F.array_distinct(a)))


def long_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(rf"^\d+$|^[{CJK}]$") | (F.length(t) >= 4))


def support_of_sets(a: Column, long_a: Column, n: Column, e: Column, have: Column) -> Column:
    """Support from token sets, long tokens and numbers of the answer, tokens and numbers of the evidence."""
    share, long_share = coverage(a, e), coverage(long_a, e)
    with_numbers = 0.45 * share + 0.30 * long_share + 0.25 * (F.size(F.array_intersect(n, have)) / F.greatest(F.lit(1), F.size(n)))
    return F.when(F.size(n) > 0, with_numbers).otherwise(0.65 * share + 0.35 * long_share)


def support(answer, evidence) -> Column:
    """How far an evidence text covers an answer: tokens, long tokens and, if there are any, numbers."""
    a = token_set(answer)
    empty = (normalize(answer) == "") | (normalize(evidence) == "")
    return F.when(empty, 0.0).otherwise(support_of_sets(a, long_tokens(a), numbers(answer), token_set(evidence), numbers(evidence)))


# Words that negate, and groups of words that compare.
NEGATIONS = (
    "not no never none neither nor without cannot can't won't isn't aren't wasn't weren't doesn't didn't 不 未 没有 无".split()
)
COMPARATIVES = {
    "increase": "more greater higher larger longer better increased increases increase exceeds above over 最多 更高 更大".split(),
    "decrease": "less fewer lower smaller shorter worse decreased decreases decrease below under 最少 更低 更小".split(),
    "maximum": "most largest highest greatest best maximum max top".split(),
    "minimum": "least smallest lowest worst minimum min bottom".split(),
}


def has_negation(c) -> Column:
    return F.lower(normalize(c)).rlike(r"(?U)(^|\W)(?:" + "|".join(NEGATIONS) + r")($|\W)")


def comparative_groups(c) -> Column:
    words = token_set(c)
    groups = F.array(*(F.when(F.arrays_overlap(words, F.array(*(F.lit(t) for t in terms))), F.lit(g)) for g, terms in COMPARATIVES.items()))
    return F.filter(groups, lambda g: g.isNotNull())


def missing_kind(c) -> Column:
    """null, empty, whitespace or null for a present value; nan for a number that is none."""
    x = _col(c)
    return F.when(x.isNull(), "null").when(x == "", "empty").when(F.trim(x) == "", "whitespace")
