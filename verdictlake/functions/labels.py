"""Label mappings and record-level decisions as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Spellings that stand for a label.
WINNERS = {"A>B": ("a", "model_a", "model a", "answer_a", "1", "a>b"), "B>A": ("b", "model_b", "model b", "answer_b", "2", "b>a"), "Tie": ("tie", "draw", "both", "equal", "tie (bothbad)")}
TRUE, FALSE = ("1", "true", "yes", "supported", "y"), ("0", "false", "no", "unsupported", "n")
OPEN_LICENCES = ("apache-2.0", "mit", "cc-by-4.0", "cc-by-sa-3.0", "cc-by-sa-4.0", "cc0-1.0", "odc-by", "public domain")


def winner(c) -> Column:
    """A winner's name as a pairwise label; null if unknown."""
    x = F.lower(T.normalize(c))
    return reduce(lambda w, item: w.when(x.isin(*item[1]), item[0]), list(WINNERS.items())[1:], F.when(x.isin(*WINNERS["A>B"]), "A>B"))


def binary(c) -> Column:
    x = F.lower(T.normalize(c))
    return F.when(x.isin(*TRUE), 1).when(x.isin(*FALSE), 0)


def factuality_of_binaries(*flags) -> Column:
    """supported if all flags are 1, unsupported if none is (a null isn't), else ambiguous."""
    ones = [F.col(f).eqNullSafe(F.lit(1)) for f in flags]
    return F.when(reduce(lambda a, b: a & b, ones), "supported").when(~reduce(lambda a, b: a | b, ones), "unsupported").otherwise("ambiguous")


def factuality_of_scores(*scores, high: float = 0.75, low: float = 0.40) -> Column:
    """By the mean of the scores that aren't null; null without any."""
    have = F.array_compact(F.array(*(F.col(s).cast("double") for s in scores)))
    mean = F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.size(have)
    return F.when(F.size(have) == 0, F.lit(None).cast("string")).when(mean >= high, "supported").when(mean <= low, "unsupported").otherwise("ambiguous")


def factuality_of_spans(spans) -> Column:
    """A response with hallucinated spans is unsupported."""
    return F.when(F.size(F.coalesce(F.col(spans), F.array().cast("array<string>"))) > 0, "unsupported").otherwise("supported")


def row_score(rank: str, scores: list[str], parts: list[str]) -> Column:
    """The negated rank, else the first number among scores, else the mean of parts, else 0."""
    have = F.array_compact(F.array(*(F.expr(f"try_cast({p} as double)") for p in parts)))
    mean = F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.size(have))
    return F.coalesce(-F.expr(f"try_cast({rank} as double)"), T.first_number(*scores), mean, F.lit(0.0))


def licence_reason(licence: Column, markers: Column | None = None) -> Column:
    """ok for an open licence, else why it isn't allowed."""
    x = F.lower(F.trim(F.coalesce(licence, F.lit(""))))
    return F.when(x == "", "missing").when(x.rlike(r"non-?commercial|(^|-)nc(-|$)"), "non_commercial").when(x.isin(*OPEN_LICENCES), "ok").otherwise("unknown")


def pairwise_prompt(prompt, a, b) -> Column:
    part = lambda title, c: F.concat(F.lit(f"{title}:\n"), T.normalize(c))
    return F.concat_ws("\n\n", part("Question", prompt), part("Answer A", a), part("Answer B", b), F.lit("Reply with [RESULT] A, B or Tie."))


def direct_prompt(prompt, answer, reference=None) -> Column:
    part = lambda title, c: F.concat(F.lit(f"{title}:\n"), T.normalize(c))
    extra = [part("Reference", reference)] if reference is not None else []
    return F.concat_ws("\n\n", part("Question", prompt), part("Answer", answer), *extra, F.lit("Rate the answer from 1 to 5."))


def one_to_five(c) -> Column:
    x = F.expr(f"try_cast({c} as double)")
    return F.when(x.between(1, 5), x)


def direct_score(raw) -> Column:
    """The rating in a judge's reply: a JSON object's score, key: value, a mark, or the mean of named dimensions; null if none is from 1 to 5."""
    text = F.coalesce(F.col(raw), F.lit(""))
    json = F.expr(f"try_cast(get_json_object({raw}, '$.score') as double)")
    number = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")
    ok = lambda x: F.when(x.between(1, 5), x)
    named = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(?:relevance|completeness|factuality|clarity|safety)\W{1,4}([1-5](?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    mean = F.when(F.size(named) > 0, F.aggregate(named, F.lit(0.0), lambda a, x: a + x) / F.size(named))
    return F.coalesce(ok(json), ok(number(r"(?i)(?:overall|score|rating)\W{1,4}(\d+(?:\.\d+)?)")), ok(number(r"\[RESULT\]\s*(\d+(?:\.\d+)?)")), mean)
