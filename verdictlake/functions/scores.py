"""Labels, probabilities and heuristic judges as Columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def clip01(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def invert(label: Column) -> Column:
    return F.when(label == "A>B", "B>A").when(label == "B>A", "A>B").otherwise(label)


def favoured(label: Column) -> Column:
    return F.when(label == "A>B", "a").when(label == "B>A", "b").when(label == "Tie", "tie")


def majority(*votes) -> Column:
    """The label of at least two of three votes, Tie without one."""
    cast = F.array(*votes)
    winner = F.filter(F.array_distinct(cast), lambda v: F.size(F.filter(cast, lambda x: x == v)) >= 2)
    return F.coalesce(F.get(winner, F.lit(0)), F.lit("Tie"))


def final_score(label: Column, head: str = "pairwise") -> Column:
    top, low = ("supported", "unsupported") if head == "factuality" else ("A>B", "B>A")
    return F.when(label == top, 1.0).when(label == low, 0.0).otherwise(0.5)


def argmax(p: Column) -> Column:
    """The place of the largest item, the first on ties."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed a single time: what a lambda names again would be computed again for each of its items."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shares(values: Column) -> Column:
    """values over their sum."""
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return once(values, lambda e: once(total(e), lambda t: F.transform(e, lambda x: x / t)))


def temperature(p: Column, t: Column) -> Column:
    return _shares(once(t, lambda u: F.transform(p, lambda x: F.exp(F.ln(F.greatest(x, F.lit(1e-12))) / u))))


def softmax(scores: Column) -> Column:
    return _shares(once(scores, lambda z: once(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))))


def brier(p: Column, gold: Column) -> Column:
    """Sum over classes of the squared distance to the gold class, given by its place."""
    squares = F.transform(p, lambda x, i: F.pow(x - F.when(i == gold, 1.0).otherwise(0.0), 2))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def bin_of(confidence: Column, bins: int = 10) -> Column:
    """Equal-width bins, the last one closed."""
    return F.least(F.lit(bins - 1), F.floor(confidence * bins)).cast("int")


# What a judge's prose says, in small case. {x} is the side spoken of, {y} the other one.
CONCLUSION_PATTERNS = (
    r"\bresponse {x} (?:is|would be|should be)? ?(?:the )?(?:better|preferred|stronger|superior)(?: response)? than response {y}\b",
    r"\b(?:therefore|overall|in conclusion|based on the rubric),?.{0,80}\bresponse {x} (?:is|would be|should be)? ?(?:the )?(?:better|preferred|stronger|superior)\b",
)
TIE_PATTERNS = (
    r"\b(?:both|two) responses? (?:are|seem|appear) (?:equally good|equivalent|comparable|similar)",
    r"\b(?:it is|this is|the result is|should be) (?:a )?tie\b",
    r"\bneither response is (?:clearly )?better\b",
    r"\bboth responses? (?:are|were) identical(?: in content| in structure)?\b",
    r"\bboth responses? correctly\b",
    r"\bboth responses? (?:provide|present) (?:a )?(?:complete|accurate|similar|equivalent)\b",
)
POSITIVE_PATTERNS = (
    r"\bresponse {x} (?:is|appears|seems|would be|should be) (?:the )?(?:better|best|preferred|stronger|superior)",
    r"\bresponse {x} (?:is|appears|seems) more (?:accurate|complete|comprehensive|detailed|thorough|specific|relevant|helpful|factual|factually correct|aligned)",
    r"\bresponse {x} provides a more (?:accurate|complete|comprehensive|detailed|thorough|specific|relevant|helpful|factual)",
    r"\bresponse {x} (?:correctly|directly|successfully|clearly) (?:identifies|answers|addresses|states|provides|presents|explains|calculates|follows|aligns)",
    r"\bresponse {x} (?:provides|presents|includes|offers|gives) (?:a |an )?(?:clear|correct|complete|comprehensive|relevant|practical|well-structured|accurate|factual)",
    r"\bresponse {x} (?:is|appears|seems) (?:complete|relevant|correct|accurate|factual|well-structured|clear)",
    r"\bresponse {x} (?:at least )?(?:attempts|makes an attempt)\b",
    r"\b(?:therefore|overall|in conclusion),? response {x}\b",
    r"\b(?:i would choose|choose|prefer|select) response {x}\b",
    r"\bresponse {x} (?:better|more effectively|more completely|more accurately)",
)
NEGATIVE_PATTERNS = (
    r"\bresponse {x} (?:also )?(?:fails|does not|doesn't|lacks|incorrectly|only|merely|repeats)\b",
    r"\bresponse {x} (?:is|appears|seems) (?:incomplete|incorrect|less organized|less informative|harder to|not as)",
    r"\bresponse {x} (?:contains|has|includes) (?:several |multiple |many |some |significant |major )?(?:errors|mistakes|misconceptions|issues|flaws)\b",
    r"\bresponse {x} (?:is|appears|seems) (?:flawed|wrong|problematic|misleading)\b",
)


def of_side(patterns: tuple[str, ...], side: str) -> list[str]:
    return [x.replace("{x}", side).replace("{y}", "b" if side == "a" else "a") for x in patterns]


def natural_label(raw) -> Column:
    """The verdict that prose states: one side's conclusion, else the only one of tie, A and B that anything speaks for; null otherwise.

    What is said against a side speaks for the other.
    """
    text = F.lower(T.normalize(raw))
    said = lambda patterns: reduce(lambda a, b: a | b, (text.rlike(x) for x in patterns))
    ends_a, ends_b = (said(of_side(CONCLUSION_PATTERNS, x)) for x in "ab")
    for_a = said(of_side(POSITIVE_PATTERNS, "a") + of_side(NEGATIVE_PATTERNS, "b"))
    for_b = said(of_side(POSITIVE_PATTERNS, "b") + of_side(NEGATIVE_PATTERNS, "a"))
    tie = said(list(TIE_PATTERNS))
    one = for_a.cast("int") + for_b.cast("int") + tie.cast("int") == 1
    return F.when(ends_a & ~ends_b, "A>B").when(ends_b & ~ends_a, "B>A").when(one, F.when(tie, "Tie").when(for_a, "A>B").otherwise("B>A"))


def parse_label(raw) -> Column:
    """A judge's verdict: a [RESULT] mark, then a statement in words, then a bare token (as it is written, Tie in this case)."""
    text = T.normalize(raw)
    mark = F.upper(F.regexp_extract(text, r"(?i)\[RESULT\]\s*(A|B|Tie)\b", 1))
    marked = F.when(mark == "A", "A>B").when(mark == "B", "B>A").when(mark == "TIE", "Tie")
    token = F.regexp_extract(text, r"(?i)\b(A>B|B>A|Tie)\b", 1)
    return F.coalesce(marked, natural_label(raw), F.when(F.lower(token) == "tie", "Tie").when(token != "", token))


def heuristic_pairwise(prompt="prompt", a="answer_a", b="answer_b", context="context", band: float = 0.08) -> Column:
    """A transparent judge of two answers: struct of score_a, score_b and label."""
    p, x, y, c = (T.normalize(k) for k in (prompt, a, b, context))
    n, m = F.length(x), F.length(y)
    words_p, words_c = T.word_set(prompt, 3), T.word_set(context, 3)
    shared = F.when((F.size(words_p) > 0) & (F.size(words_c) > 0), F.size(F.array_intersect(words_p, words_c)) / F.size(words_p) * 0.1).otherwise(0.0)
    lp, lc = F.length(p), F.length(c)
    balance = F.when((lp > 0) & (lc > 0), (1 - F.least(F.lit(1.0), F.abs(lp - lc) / F.greatest(lp, lc))) * 0.05).otherwise(0.0)

    def side(own: Column, other: Column, sentences: Column) -> Column:
        base = F.when(own >= 12, 0.2).otherwise(0.0) + F.least(F.lit(0.5), sentences * 0.05)
        return base + F.when(own > other, 0.15).otherwise(0.0) + shared + balance

    sa, sb = side(n, m, T.sentence_count(a)), side(m, n, T.sentence_count(b))
    label = F.when(F.abs(sa - sb) < band, "Tie").when(sa > sb, "A>B").otherwise("B>A")
    return F.struct(sa.alias("score_a"), sb.alias("score_b"), label.alias("label"))


def heuristic_direct(prompt="prompt", answer="answer_a", context="context", reference="reference") -> Column:
    """A transparent judge of one answer on six dimensions from 1 to 5, and their mean."""
    own = T.word_set(answer)

    def shared(c) -> Column:
        words = T.word_set(c)
        return F.when(F.size(words) > 0, F.size(F.array_intersect(words, own)) / F.greatest(F.lit(1), F.size(words))).otherwise(0.0)

    p = shared(prompt)
    dims = {
        "relevance": 1 + 4 * F.least(F.lit(1.0), p + 0.2),
        "completeness": F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.length(T.normalize(answer)) / 120 + 1)),
        "factuality": 1 + 4 * F.greatest(shared(context), shared(reference), F.lit(0.25)),
        "instruction_following": 1 + 4 * F.least(F.lit(1.0), p + 0.15),
        "clarity": F.least(F.lit(5.0), 2.5 + F.least(F.lit(2.0), T.sentence_count(answer) * 0.25)),
        "safety": F.lit(4.0),
    }
    rounded = {k: F.round(v, 4) for k, v in dims.items()}
    total = sum(rounded.values(), F.lit(0.0))
    return F.struct(*(v.alias(k) for k, v in rounded.items()), F.round(total / len(dims), 4).alias("overall"))
