"""Adapters from raw question-answer sources to one record form; each takes and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

COLUMNS = ("id", "source", "source_record_id", "question", "context", "answer", "options", "language", "group_key")


def record(df: DataFrame, source: str, record_id: Column, question: Column, answer: Column, context: Column | None = None, options: Column | None = None, group: Column | None = None) -> DataFrame:
    """Records with a question and an answer; the id hashes source, record and question, the group is what must stay in one split."""
    q, a = T.normalize(question), T.normalize(answer)
    c = T.normalize(context) if context is not None else F.lit("")
    rid = F.coalesce(record_id.cast("string"), F.lit(""))
    out = df.select(
        T.stable_sha256(F.lit(source), rid, q, digits=24).alias("id"),
        F.lit(source).alias("source"),
        rid.alias("source_record_id"),
        q.alias("question"),
        c.alias("context"),
        a.alias("answer"),
        (options if options is not None else F.create_map().cast("map<string,string>")).alias("options"),
        T.language(q, a).alias("language"),
        (F.coalesce(group.cast("string"), rid) if group is not None else rid).alias("group_key"),
    )
    return out.where((F.col("question") != "") & (F.col("answer") != ""))


def parallel_questions(df: DataFrame, source: str, paper: str = "id") -> DataFrame:
    """Papers with parallel arrays questions, question_ids, answers, and a context."""
    rows = df.select(F.col(paper).alias("_paper"), "context", F.explode(F.arrays_zip("questions", "question_ids", "answers")).alias("q"))
    return record(rows, source, F.col("q.question_ids"), F.col("q.questions"), F.col("q.answers"), F.col("context"), group=F.col("_paper"))


def keyed(df: DataFrame, source: str, column: str = "records") -> DataFrame:
    """A map from record ids to structs of question, context and answer."""
    rows = df.select(F.explode(column).alias("key", "r"))
    return record(rows, source, F.col("key"), F.col("r.question"), F.col("r.answer"), F.col("r.context"))


def multiple_choice(df: DataFrame, source: str) -> DataFrame:
    """question, labels and texts of choices, and the right one's label as answer_key."""
    options = F.map_from_arrays("labels", "texts")
    return record(df, source, F.col("id"), F.col("question"), F.try_element_at(options, F.col("answer_key")), options=options)


def tab_separated(df: DataFrame, source: str, column: str = "value") -> DataFrame:
    """Lines of at least three tab-separated fields: id, question, answer; others are left out."""
    parts = F.split(column, "\t")
    return record(df.where(F.size(parts) >= 3).select(parts.alias("p")), source, F.col("p")[0], F.col("p")[1], F.col("p")[2])


def conversation(df: DataFrame, turns: str = "turns") -> DataFrame:
    """From an array of (role, content): the last user turn as prompt, what precedes it as context, the last assistant turn as answer."""
    users = F.filter(turns, lambda t: t["role"] == "user")
    answers = F.filter(turns, lambda t: t["role"] == "assistant")
    last = F.try_element_at(users, F.lit(-1))["content"]
    before = F.transform(F.slice(turns, 1, F.greatest(F.lit(0), F.size(turns) - 2)), lambda t: F.concat_ws(": ", t["role"], t["content"]))
    return df.select("*", last.alias("prompt"), F.array_join(before, "\n").alias("context"), F.try_element_at(answers, F.lit(-1))["content"].alias("answer"))


REGISTRY = {"parallel_questions": parallel_questions, "keyed": keyed, "multiple_choice": multiple_choice, "tab_separated": tab_separated}


def corpus(frames: list[DataFrame], quotas: dict[str, int] | None = None) -> DataFrame:
    """Records of several sources: united, without repeats (small case, the first 500 characters of context), in quotas by language, split by group."""
    from ..operators import ranking

    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    key = F.sha2(F.concat_ws("␟", F.lower("question"), F.lower("answer"), F.lower(F.substring("context", 1, 500))).cast("binary"), 256)
    kept, _ = ranking.deduplicate(rows.withColumn("_key", key), ["_key"], "id")
    kept = kept.dropDuplicates(["_key"]).drop("_key")
    if quotas:
        limits = F.coalesce(*(F.when(F.col("language") == k, n) for k, n in quotas.items()), F.lit(0))
        from pyspark.sql import Window

        # The largest quota as a fixed number: Spark then limits every task's rows of a language before they meet.
        ranked = kept.withColumn("_r", F.row_number().over(Window.partitionBy("language").orderBy("id"))).where(F.col("_r") <= max(quotas.values()))
        kept = ranked.where(F.col("_r") <= limits).drop("_r")
    return ranking.hash_splits(kept, ["source", "group_key"], 1000, 700, 850)
