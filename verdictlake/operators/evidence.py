"""Evidence of answers, sentence by sentence, as an inverted join.

Sentences of answers and of evidence become rows; what they hold (tokens, numbers) becomes postings that are
joined by sample and value, so a sentence meets only evidence that shares something with it. Shared
values are counted for each pair of sentences that meets, and the best evidence of a sentence is one
max_by. Numbers, dates and names that the evidence lacks are found by another join of postings. Nothing
is compared within a row, so a sample with a long text is many rows' work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..schemas import PAIRWISE
from ..session import stored

MEASURES = (
    "context_support", "reference_support", "claim_support_rate", "numeric_evidence_gap", "date_evidence_gap", "entity_evidence_gap", "entity_alias_gap", "negation_mismatch", "comparative_mismatch", "sentence_max_support",
    "sentence_mean_support", "low_support_sentence_ratio", "low_support_anchor_sentence_ratio", "max_low_support_anchor_gap", "anchored_hallucination_severity", "local_hallucination_risk",
)
# Cuts of support, and labels of single answers.
COMPARED, LOW, HALF, REVIEW = 0.20, 0.35, 0.50, 0.60
SINGLE = ("supported", "unsupported", "ambiguous")
#: What a measure adds to the risk of a pair: name, measure, cut, whether the risk is what is missing to 1, weights for the first and the second answer (None: no risk, or for the second answer no reason either).
RISKS = (
    ("numeric_evidence_gap", "numeric_evidence_gap", 0.0, 0.90, 0.45),
    ("date_evidence_gap", "date_evidence_gap", 0.0, 0.85, 0.40),
    ("entity_evidence_gap", "entity_evidence_gap", 0.45, 0.60, None),
    ("entity_alias_gap", "entity_alias_gap", 0.45, 0.60, 0.30),
    ("negation_mismatch", "negation_mismatch", 0.0, 0.85, 0.40),
    ("comparative_mismatch", "comparative_mismatch", 0.0, 0.65, 0.30),
    ("low_support_sentence_ratio", "low_support_sentence_ratio", 0.35, 0.70, None),
    ("low_support_anchor_sentence_ratio", "low_support_anchor_sentence_ratio", 0.0, 0.0, 0.0),
    ("max_low_support_anchor_gap", "max_low_support_anchor_gap", 0.0, 0.0, 0.0),
    ("anchored_hallucination_severity", "anchored_hallucination_severity", 0.0, 0.0, None),
    ("local_hallucination_risk", "local_hallucination_risk", 0.45, 0.75, 0.45),
)


def _values(**kinds: Column) -> Column:
    """(kind, value) of all arrays, each value of a kind once."""
    return reduce(lambda a, b: F.concat(a, b), (F.transform(F.array_distinct(c), lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value"))) for k, c in kinds.items()))


def measures(df: DataFrame, answers: dict[str, str], context: str = "context", reference: str | None = None) -> DataFrame:
    """df with a row number _row, and for each name of answers a struct of that name with the MEASURES of the named column.

    Null texts are empty. An answer without a sentence has measures of 0. Rows that are alike stay apart.
    """
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()), "samples")
    text = lambda c: T.normalize(c) if c else F.lit("")
    base = rows.select("_row", text(context).alias("c"), text(reference).alias("r"), *(T.normalize(c).alias(f"x_{k}") for k, c in answers.items()))
    base = base.withColumn("both", F.concat_ws(" ", "c", "r"))
    found = base.select(
        "*", T.token_set("c").alias("ct"), T.numbers("c").alias("cn"), T.token_set("r").alias("rt"), T.numbers("r").alias("rn"),
        F.array_union(T.dates("c"), T.dates("r")).alias("d"), F.array_union(T.entities("c"), T.entities("r")).alias("e"), F.array_union(T.alias_entities("c"), T.alias_entities("r")).alias("al"),
    )
    sides = found.withColumn("x", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(f"x_{k}").alias("text")) for k in answers)))).withColumn("t", T.token_set("x.text")).withColumn("n", T.numbers("x.text"))
    support = lambda e, m, whole: F.when((F.col("x.text") == "") | (whole == ""), 0.0).otherwise(T.support_of_sets(F.col("t"), T.long_tokens(F.col("t")), F.col("n"), e, m))
    ct, rt, cn, rn = (F.col(k) for k in ("ct", "rt", "cn", "rn"))
    whole = sides.select(
        "_row", "x.side", (T.normalize("both") != "").alias("evidence"), (F.size(T.comparative_groups(F.col("x.text"))) > 0).alias("compares"),
        support(ct, cn, F.col("c")).alias("context_support"),
        support(rt, rn, F.col("r")).alias("reference_support"),
        support(F.array_union(ct, rt), F.array_union(cn, rn), T.normalize("both")).alias("combined"),
        T.gap(F.col("n"), F.array_union(cn, rn)).alias("numeric_evidence_gap"),
        T.gap(T.dates(F.col("x.text")), F.col("d")).alias("date_evidence_gap"),
        T.gap(T.entities(F.col("x.text")), F.col("e")).alias("entity_evidence_gap"),
        T.gap(T.alias_entities(F.col("x.text")), F.col("al")).alias("entity_alias_gap"),
    )

    described = lambda c: (T.token_set(c).alias("t"), T.numbers(c).alias("n"), T.has_negation(c).alias("negated"), T.comparative_groups(c).alias("groups"))
    own = base.select("_row", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(f"x_{k}").alias("text")) for k in answers))).alias("x"))
    own = own.select("_row", "x.side", F.posexplode(T.sentences(F.col("x.text"))).alias("s", "text"))
    own = own.select("_row", "side", "s", *described("text"), T.dates("text").alias("d"), T.entities("text").alias("e"), T.alias_entities("text").alias("al"))
    own = stored(own.withColumn("long", T.long_tokens(F.col("t"))), "sentences")
    other = base.select("_row", F.posexplode(T.sentences("both")).alias("p", "text"))
    other = stored(other.select("_row", "p", *described("text")), "evidence")

    posted = own.select("_row", "side", "s", F.explode(_values(t=F.col("t"), n=F.col("n"))).alias("v"), "long").select("_row", "side", "s", "v.*", F.array_contains("long", F.col("v.value")).alias("long"))
    met = posted.join(other.select("_row", "p", F.explode(_values(t=F.col("t"), n=F.col("n"))).alias("v")).select("_row", "p", "v.*"), ["_row", "kind", "value"])
    hits = met.groupBy("_row", "side", "s", "p").agg(*(F.sum(c.cast("int")).alias(k) for k, c in (("ht", F.col("kind") == "t"), ("hl", (F.col("kind") == "t") & F.col("long")), ("hn", F.col("kind") == "n"))))
    sizes = own.select("_row", "side", "s", F.size("t").alias("st"), F.size("long").alias("sl"), F.size("n").alias("sn"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    score = F.when(F.col("sn") > 0, 0.45 * share("ht", "st") + 0.30 * share("hl", "sl") + 0.25 * share("hn", "sn")).otherwise(0.65 * share("ht", "st") + 0.35 * share("hl", "sl"))
    best = hits.join(sizes, ["_row", "side", "s"]).withColumn("score", score).groupBy("_row", "side", "s").agg(F.max_by(F.struct("score", "p"), F.struct("score", -F.col("p"))).alias("b")).select("_row", "side", "s", "b.score", "b.p")

    anchors = {"n": F.col("n"), "d": F.col("d"), "e": F.col("e"), "a": F.col("al")}
    there = base.select("_row", F.explode(_values(n=T.numbers("both"), d=T.dates("both"), e=T.entities("both"), a=T.alias_entities("both"))).alias("v")).select("_row", "v.*", F.lit(1).alias("there"))
    wanted = own.select("_row", "side", "s", F.explode(_values(**anchors)).alias("v")).select("_row", "side", "s", "v.*").join(there, ["_row", "kind", "value"], "left")
    gaps = wanted.groupBy("_row", "side", "s", "kind").agg((F.sum(F.col("there").isNull().cast("int")) / F.count("*")).alias("gap")).groupBy("_row", "side", "s").agg(F.max("gap").alias("gap"))

    facing = other.select("_row", "p", F.col("negated").alias("o_negated"), F.col("groups").alias("o_groups"))
    each = own.select("_row", "side", "s", "negated", "groups").join(best, ["_row", "side", "s"], "left").join(gaps, ["_row", "side", "s"], "left").join(facing, ["_row", "p"], "left")
    each = each.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("gap", F.coalesce("gap", F.lit(0.0)))
    compared = F.col("score") >= COMPARED
    apart = F.when(compared & (F.size("groups") > 0), F.size(F.array_except("groups", "o_groups")) / F.size("groups"))
    mean = lambda c: F.avg(c.cast("double"))
    total = each.groupBy("_row", "side").agg(
        F.coalesce(mean(F.when(compared, F.col("negated") != F.col("o_negated"))), F.lit(0.0)).alias("negation_mismatch"),
        F.coalesce(F.avg(apart), F.lit(0.0)).alias("departed"),
        F.max("score").alias("sentence_max_support"),
        F.avg("score").alias("sentence_mean_support"),
        mean(F.col("score") < LOW).alias("low_support_sentence_ratio"),
        mean((F.col("score") < LOW) & (F.col("gap") > 0)).alias("low_support_anchor_sentence_ratio"),
        F.coalesce(F.max(F.when(F.col("score") < HALF, F.col("gap"))), F.lit(0.0)).alias("max_low_support_anchor_gap"),
        F.avg((1 - F.col("score")) * F.col("gap")).alias("anchored_hallucination_severity"),
    )
    out = whole.join(total, ["_row", "side"], "left").na.fill(0.0)
    # Without evidence no comparison of an answer is backed.
    out = out.withColumn("comparative_mismatch", F.when(~F.col("evidence"), F.col("compares").cast("double")).otherwise(F.col("departed")))
    out = out.withColumn("claim_support_rate", F.least(F.lit(1.0), F.greatest("combined", 0.65 * F.col("context_support") + 0.35 * F.col("reference_support"))))
    local = F.greatest(*(F.col(c) for c in ("low_support_sentence_ratio", "entity_evidence_gap", "entity_alias_gap", "date_evidence_gap", "numeric_evidence_gap", "negation_mismatch", "comparative_mismatch")))
    out = out.withColumn("local_hallucination_risk", local).select("_row", "side", F.struct(*MEASURES).alias("m"))
    for k in answers:
        rows = rows.join(out.where(F.col("side") == k).select("_row", F.col("m").alias(k)), "_row")
    return rows


def task_form(df: DataFrame, explicit: str | None = None) -> Column:
    """pairwise if said so, or the label compares, or there is a second answer; else single_answer."""
    said = F.lower(T.normalize(explicit)) if explicit else F.lit("")
    pair = F.coalesce(F.col("human_label").isin(*PAIRWISE), F.lit(False)) | (T.normalize("answer_b") != "")
    return F.when(said.isin("single_answer", "pairwise"), said).when(pair, "pairwise").otherwise("single_answer")


def decision_signal(task_type: Column, label: Column, form: Column) -> Column:
    """Which head a sample speaks to: pairwise_factuality, single_answer_factuality or non_factuality."""
    known = lambda *v: F.coalesce(label.isin(*v), F.lit(False))
    return F.when(~F.coalesce(task_type == "factuality_rag", F.lit(False)), "non_factuality").when(known(*PAIRWISE) | (form == "pairwise"), "pairwise_factuality").when(known(*SINGLE), "single_answer_factuality").otherwise("non_factuality")


def pair_profiles(df: DataFrame, context: str = "context", reference: str | None = None, form: str | None = None, review_at: float = REVIEW) -> DataFrame:
    """df with form, the MEASURES of both answers (_a, _b; the second null for single answers) and what follows: support_delta_a_minus_b, pairwise_support_contradiction, evidence_risk, review_required and sorted reasons.

    df has answer_a, answer_b, human_label and the named texts. Numbers have six places.
    """
    from .profiles import pairwise_contradiction

    rows = measures(df, {"_a": "answer_a", "_b": "answer_b"}, context, reference)
    rows = rows.withColumn("form", task_form(rows, form))
    rows = rows.withColumn("_b", F.when((F.col("form") == "pairwise") & (T.normalize("answer_b") != ""), F.col("_b")))
    parts = []  # reason, whether it holds, risk
    for side, (of_context, of_reference) in (("_a", (0.70, 0.45)), ("_b", (0.35, 0.25))):
        m = lambda c, side=side: F.col(f"{side}.{c}")
        parts.append((f"low_context_support{side}", (T.normalize(context) != "") & (m("context_support") < 0.35), of_context * (1 - m("context_support"))))
        if reference:
            parts.append((f"reference_support_gap{side}", (T.normalize(reference) != "") & (m("reference_support") < 0.25), of_reference * (1 - m("reference_support"))))
        for name, measure, cut, first, second in RISKS:
            weight = first if side == "_a" else second
            if weight is not None:
                parts.append((name + side, m(measure) > cut, weight * m(measure)))
    against = pairwise_contradiction(F.col("human_label"), F.col("_a.claim_support_rate"), F.col("_b.claim_support_rate"))
    rows = rows.withColumn("_c", F.when(F.col("_b").isNotNull(), against))
    parts.append((None, F.col("_c.reason").isNotNull(), 0.80 * F.col("_c.contradiction")))
    risk = F.greatest(F.lit(0.0), *(F.when(ok, r).otherwise(0.0) for _, ok, r in parts))
    reasons = F.array_sort(F.array_compact(F.array(*(F.when(ok, F.lit(n) if n else F.col("_c.reason")) for n, ok, _ in parts))))
    six = lambda c: F.when(c.isNotNull(), F.round(S.clip01(c), 6))
    return rows.withColumn("_risk", risk).withColumn("reasons", reasons).select(
        *df.columns,
        "form",
        *(six(F.col(f"{side}.{c}")).alias(c + side) for side in ("_a", "_b") for c in MEASURES),
        F.round(F.col("_a.claim_support_rate") - F.col("_b.claim_support_rate"), 6).alias("support_delta_a_minus_b"),
        six(F.coalesce("_c.contradiction", F.lit(0.0))).alias("pairwise_support_contradiction"),
        six(F.col("_risk")).alias("evidence_risk"),
        (F.least(F.lit(1.0), F.col("_risk")) >= review_at).alias("review_required"),
        "reasons",
    )


def vector(profiles: DataFrame, key: str = "id") -> DataFrame:
    """key and the 36 evidence features of pair_profiles as doubles; what is missing is 0."""
    short = {"numeric_evidence_gap": "numeric_gap", "date_evidence_gap": "date_gap", "entity_evidence_gap": "entity_gap"}
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    both = [value(c + side).alias(f"evidence_{short.get(c, c)}{side}") for side in ("_a", "_b") for c in MEASURES]
    return profiles.select(key, *both, value("support_delta_a_minus_b").alias("evidence_support_delta_a_minus_b"), value("pairwise_support_contradiction").alias("evidence_pairwise_support_contradiction"), value("evidence_risk").alias("evidence_risk"), value("review_required").alias("evidence_review_required"))
