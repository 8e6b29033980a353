"""The registered query of evidence for pairs of answers, and its DuckDB twin, which compares all pairs of sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence
from .sample_queries import _tokens_sql as tokens
from .views import normalised as norm
from .views import samples, with_views

Q, SQL = {}, {}

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
#: DuckDB's word boundaries know ASCII only, so words with other letters are taken out first.
_plain = lambda c: f"regexp_replace({c}, '[A-Za-z0-9_]*[_\\x{{00C0}}-\\x{{1FFF}}\\x{{3040}}-\\x{{D7FF}}][\\p{{L}}\\p{{N}}_]*', '¦', 'g')"
_sentences = lambda c: f"list_filter(string_split(regexp_replace({c}, '([.!?。！？])\\s+', '\\1~~', 'g'), '~~'), lambda x: x <> '')"
_numbers = lambda c: f"list_distinct(list_transform(regexp_extract_all({c}, '\\d+(?:[,.]\\d+)?'), lambda v: replace(v, ',', '')))"


def _dates(c: str) -> str:
    x = _plain(c)
    return f"list_distinct(list_concat(list_concat(regexp_extract_all({x}, '\\b(?:1[6-9]\\d{{2}}|20\\d{{2}}|21\\d{{2}})\\b'), regexp_extract_all({x}, '\\b\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}\\b')), regexp_extract_all(lower({x}), '\\b(?:{T.MONTHS})\\.?\\s+\\d{{1,2}}(?:,\\s*\\d{{4}})?\\b')))"


def _entities(c: str) -> str:
    found = f"regexp_extract_all({_plain(c)}, '\\b[A-Za-z][A-Za-z0-9-]*\\b')"
    named = f"NOT list_contains({_STOP}, lower(t)) AND (regexp_matches(t, '\\d') OR regexp_full_match(t, '[A-Z]{{2,}}|[A-Z][a-z]{{2,}}(?:-[A-Z][a-z]{{2,}})?') OR length(t) >= 9)"
    return f"list_distinct(list_transform(list_filter({found}, lambda t: {named}), lambda t: lower(t)))"


def _aliases(c: str) -> str:
    plain = f"list_transform({_entities(c)}, lambda t: replace(t, '-', ''))"
    single = f"list_transform(list_filter({plain}, lambda t: length(t) > 4 AND t[-1] = 's'), lambda t: t[:-2])"
    phrases = f"regexp_extract_all({_plain(c)}, '\\b[A-Z][A-Za-z]+(?:\\s+[A-Z][A-Za-z]+){{1,5}}\\b')"
    initials = f"list_transform({phrases}, lambda p: array_to_string(list_transform(list_filter(string_split(lower(p), ' '), lambda w: NOT list_contains({_STOP}, w)), lambda w: w[1]), ''))"
    return f"list_distinct(list_filter(list_concat(list_concat({plain}, {single}), list_filter({initials}, lambda x: length(x) >= 2)), lambda x: x <> ''))"


def _negated(c: str) -> str:
    words = "|".join(w.replace("'", "''") for w in T.NEGATIONS)
    edge = "[^\\p{L}\\p{N}\\p{M}_]"
    return f"regexp_matches(lower({c}), '(^|{edge})(?:{words})($|{edge})')"


def _groups(t: str) -> str:
    has = lambda terms: f"len(list_intersect({t}, [" + ", ".join(f"'{w}'" for w in terms) + "])) > 0"
    return "list_filter([" + ", ".join(f"CASE WHEN {has(terms)} THEN '{g}' END" for g, terms in T.COMPARATIVES.items()) + "], lambda x: x IS NOT NULL)"


_long = lambda t: f"list_filter({t}, lambda v: regexp_matches(v, '^\\d+$|^[一-鿿]$') OR length(v) >= 4)"
_share = lambda a, e: f"coalesce(len(list_intersect({a}, {e})) / nullif(len({a}), 0), 0)"
_gap = lambda a, e: f"coalesce(len(list_filter({a}, lambda v: NOT list_contains({e}, v))) / nullif(len({a}), 0), 0)"


def _support(t: str, n: str, e: str, m: str) -> str:
    share, long_ = _share(t, e), _share(_long(t), e)
    return f"CASE WHEN len({n}) > 0 THEN 0.45 * {share} + 0.30 * {long_} + 0.25 * len(list_intersect({n}, {m})) / len({n}) ELSE 0.65 * {share} + 0.35 * {long_} END"


_M = evidence.MEASURES
_LOCAL = "greatest(low_support_sentence_ratio, entity_evidence_gap, entity_alias_gap, date_evidence_gap, numeric_evidence_gap, negation_mismatch, comparative_mismatch)"


def _risk_parts() -> list[tuple[str, str, str]]:
    out = []
    for s, ctx, ref in (("_a", 0.70, 0.45), ("_b", 0.35, 0.25)):
        out.append((f"'low_context_support{s}'", f"c <> '' AND context_support{s} < 0.35", f"{ctx} * (1 - context_support{s})"))
        out.append((f"'reference_support_gap{s}'", f"r <> '' AND reference_support{s} < 0.25", f"{ref} * (1 - reference_support{s})"))
        for name, measure, cut, first, second in evidence.RISKS:
            if (weight := first if s == "_a" else second) is not None:
                out.append((f"'{name}{s}'", f"{measure}{s} > {cut}", f"{weight} * {measure}{s}"))
    out.append(("'pairwise_support_contradiction'", "contra = 1", "0.80"))
    out.append(("'pairwise_support_tie_imbalance'", "contra = 0.5", "0.40"))
    return out


_PARTS = _risk_parts()
_SQL = f""", b AS MATERIALIZED (SELECT *, trim(c || ' ' || r) AS w FROM (SELECT id, human_label AS label, {norm('context')} AS c, {norm('prompt')} AS r, {norm('answer_a')} AS xa, {norm('answer_b')} AS xb FROM samples)
), ev AS MATERIALIZED (
  SELECT id, c, r, w, {tokens('c')} AS ct, {_numbers('c')} AS cn, {tokens('r')} AS rt, {_numbers('r')} AS rn, list_concat({_dates('c')}, {_dates('r')}) AS d, list_concat({_entities('c')}, {_entities('r')}) AS e,
    list_concat({_aliases('c')}, {_aliases('r')}) AS al, {_numbers('w')} AS wn, {_dates('w')} AS wd, {_entities('w')} AS we, {_aliases('w')} AS wa FROM b
), xs AS MATERIALIZED (
  SELECT *, {tokens('x')} AS t, {_numbers('x')} AS n, {_dates('x')} AS xd, {_entities('x')} AS xe, {_aliases('x')} AS xal FROM (SELECT id, '_a' AS side, xa AS x FROM b UNION ALL SELECT id, '_b', xb FROM b)
), whole AS (
  SELECT id, side, w <> '' AS evidence, {_groups('t')} AS g, CASE WHEN x = '' OR c = '' THEN 0 ELSE {_support('t', 'n', 'ct', 'cn')} END AS context_support, CASE WHEN x = '' OR r = '' THEN 0 ELSE {_support('t', 'n', 'rt', 'rn')} END AS reference_support,
    CASE WHEN x = '' OR w = '' THEN 0 ELSE {_support('t', 'n', 'list_concat(ct, rt)', 'list_concat(cn, rn)')} END AS combined, {_gap('n', 'list_concat(cn, rn)')} AS numeric_evidence_gap, {_gap('xd', 'd')} AS date_evidence_gap,
    {_gap('xe', 'e')} AS entity_evidence_gap, {_gap('xal', 'al')} AS entity_alias_gap FROM xs JOIN ev USING (id)
), own AS MATERIALIZED (
  SELECT id, side, i, {tokens('s')} AS t, {_numbers('s')} AS n, {_negated('s')} AS neg, {_dates('s')} AS sd, {_entities('s')} AS se, {_aliases('s')} AS sal FROM (SELECT id, side, i, l[i] AS s FROM (SELECT id, side, {_sentences('x')} AS l FROM xs), unnest(range(1, len(l) + 1)) AS u(i))
), oth AS MATERIALIZED (
  SELECT id, j, {tokens('s')} AS t, {_numbers('s')} AS n, {_negated('s')} AS neg FROM (SELECT id, j, l[j] AS s FROM (SELECT id, {_sentences('w')} AS l FROM b), unnest(range(1, len(l) + 1)) AS u(j))
), best AS (
  SELECT * FROM (SELECT o.id, o.side, o.i, p.neg AS pneg, {_groups('p.t')} AS pg, {_support('o.t', 'o.n', 'p.t', 'p.n')} AS score, p.j FROM own o JOIN oth p ON p.id = o.id) QUALIFY row_number() OVER (PARTITION BY id, side, i ORDER BY score DESC, j) = 1
), each AS (
  SELECT o.id, o.side, o.neg, {_groups('o.t')} AS g, pneg, pg, coalesce(score, 0) AS score, greatest({_gap('o.n', 'wn')}, {_gap('sd', 'wd')}, {_gap('se', 'we')}, {_gap('sal', 'wa')}) AS gap FROM own o JOIN ev USING (id) LEFT JOIN best USING (id, side, i)
), total AS (
  SELECT id, side, coalesce(avg((neg <> pneg)::INTEGER) FILTER (score >= 0.20), 0) AS negation_mismatch, coalesce(avg({_gap('g', 'pg')}) FILTER (score >= 0.20 AND len(g) > 0), 0) AS departed, max(score) AS sentence_max_support, avg(score) AS sentence_mean_support,
    avg((score < 0.35)::INTEGER) AS low_support_sentence_ratio, avg((score < 0.35 AND gap > 0)::INTEGER) AS low_support_anchor_sentence_ratio, coalesce(max(gap) FILTER (score < 0.50), 0) AS max_low_support_anchor_gap, avg((1 - score) * gap) AS anchored_hallucination_severity FROM each GROUP BY id, side
), m0 AS (
  SELECT w.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('negation_mismatch', 'sentence_max_support', 'sentence_mean_support', 'low_support_sentence_ratio', 'low_support_anchor_sentence_ratio', 'max_low_support_anchor_gap', 'anchored_hallucination_severity'))},
    CASE WHEN NOT evidence THEN (len(g) > 0)::INTEGER ELSE coalesce(departed, 0) END AS comparative_mismatch, least(1, greatest(combined, 0.65 * context_support + 0.35 * reference_support)) AS claim_support_rate FROM whole w LEFT JOIN total t ON t.id = w.id AND t.side = w.side
), m AS MATERIALIZED (SELECT *, {_LOCAL} AS local_hallucination_risk FROM m0
), p0 AS (
  SELECT b.id, label, c, r, {', '.join(f'x.{k} AS {k}_a' for k in _M)}, {', '.join(f"CASE WHEN xb <> '' THEN y.{k} END AS {k}_b" for k in _M)} FROM b JOIN m x ON x.id = b.id AND x.side = '_a' JOIN m y ON y.id = b.id AND y.side = '_b'
), p1 AS (
  SELECT *, claim_support_rate_a - claim_support_rate_b AS delta, coalesce(CASE WHEN label = 'A>B' AND delta < -0.05 OR label = 'B>A' AND delta > 0.05 THEN 1 WHEN label = 'Tie' AND abs(delta) > 0.35 THEN 0.5 END, 0) AS contra FROM p0
), p AS (SELECT *, least(1, greatest(0, {', '.join(f'CASE WHEN {ok} THEN {w} ELSE 0 END' for _, ok, w in _PARTS)})) AS risk FROM p1)
SELECT id, {', '.join(f'round({k}{s}, 6)::DOUBLE AS {k}{s}' for s in ('_a', '_b') for k in _M)}, round(delta, 6)::DOUBLE AS support_delta_a_minus_b, contra::DOUBLE AS pairwise_support_contradiction, round(risk, 6)::DOUBLE AS evidence_risk, risk >= 0.60 AS review_required,
  array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN {ok} THEN {n} END' for n, ok, _ in _PARTS)}], lambda x: x IS NOT NULL)), ';') AS reasons FROM p"""

SQL["evidence_pairs"] = with_views(_SQL, "samples")


def evidence_pairs(spark, sf_dir):
    """Both answers against a document as context and the prompt as reference."""
    p = evidence.pair_profiles(samples(spark, sf_dir), reference="prompt")
    columns = [c + s for s in ("_a", "_b") for c in evidence.MEASURES] + ["support_delta_a_minus_b", "pairwise_support_contradiction", "evidence_risk", "review_required"]
    return p.select("id", *(((F.col(c) + 0.0).alias(c) if c != "review_required" else F.col(c)) for c in columns), F.array_join("reasons", ";").alias("reasons"))


Q["evidence_pairs"] = evidence_pairs
