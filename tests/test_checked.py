import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from verdictlake.operators import checked
from verdictlake.schemas import PREDICTION

ROW = ("1", "d", "open_qa", "dev", "pairwise", "A>B", "Tie", 0.5, 0.75, 0.25, False, None, {"A>B": 0.25, "Tie": 0.75})


def rows(spark, *changes):
    names = PREDICTION.fieldNames()
    return spark.createDataFrame([tuple(c.get(n, v) for n, v in zip(names, ROW)) for c in changes], PREDICTION)


def write(df, path, gates=()):
    counts = [F.count("*").alias("rows"), F.sum((F.col("human_label") == F.col("predicted_label")).cast("long")).alias("hits")]
    return checked.checked_write(df, str(path), checked.prediction_rules(), "id", counts, list(gates))


def test_a_write_that_passes_gives_its_counts(spark, tmp_path):
    df = rows(spark, {}, {"id": "2", "predicted_label": "A>B"}, {"id": "3", "confidence": 0.0, "risk_score": 1.0}).repartition(3)
    assert checked.missing_columns(df) == [] and checked.missing_columns(df.drop("split", "head")) == ["head", "split"]
    assert write(df, tmp_path / "a", [("some hits", lambda c: c["hits"] >= 1)]) == {"rows": 3, "hits": 1}
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3
    assert write(df.where("false"), tmp_path / "b") == {"rows": 0, "hits": None}


@pytest.mark.parametrize(
    "change, message",
    [
        ({"confidence": 1.5}, "confidence outside [0, 1]: 9"),
        ({"confidence": float("nan")}, "confidence outside [0, 1]: 9"),
        ({"risk_score": None}, "risk_score outside [0, 1]: 9"),
        ({"label_probabilities": {}}, "label_probabilities empty: 9"),
        ({"label_probabilities": None}, "label_probabilities empty: 9"),
        ({"head": None, "confidence": -1.0}, "head missing: 9"),
        ({"id": None}, "id missing: null"),
    ],
)
def test_a_broken_row_stops_the_write(spark, tmp_path, change, message):
    df = rows(spark, {}, {"id": "9", **change}, {"id": "2"})
    with pytest.raises(PySparkException, match=message.replace("[", r"\[").replace("]", r"\]")):
        write(df, tmp_path / "a")
    assert not (tmp_path / "a" / "_SUCCESS").exists() and not list((tmp_path / "a").glob("*.parquet"))


def test_gates_are_named(spark, tmp_path):
    gates = [("rows", lambda c: c["rows"] == 2), ("hits", lambda c: c["hits"] >= 1), ("most", lambda c: c["rows"] > 5)]
    with pytest.raises(checked.GateError) as e:
        write(rows(spark, {}, {"id": "2"}), tmp_path / "a", gates)
    assert e.value.failed == ["hits", "most"]
