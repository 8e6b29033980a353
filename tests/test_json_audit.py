import json

from verdictlake.operators import json_audit

TEXTS = [
    '{"a": {"b": [1, 2.5, "", {"c": null}], "d e": " \\t"}, "x": true, "y": 12345678901234567890}',
    '[[[["", [" "]]]], {}, []]',
    '"  "', "7", "null", "", "{broken", '{"k": 1, "k": 2}', None,
    '{"meta": {"deep": {"er": {"still": [{"s": "x"}, {"s": ""}]}}}}',
    '{"meta": {"deep": {"er": {"still": [{"s": "x"}, {"s": ""}]}}}}',
]


def walk(value, path="$", shape="$"):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(value)]
    yield path, shape, kind, value if isinstance(value, str) else None
    for key, child in value.items() if isinstance(value, dict) else ():
        yield from walk(child, f"{path}.{key}", f"{shape}.{key}")
    for k, child in enumerate(value) if isinstance(value, list) else ():
        yield from walk(child, f"{path}[{k}]", f"{shape}[*]")


def whole(text):
    if text is None:
        return [("$", "$", "missing", None)]
    try:
        pairs = lambda found: dict(found) if len({k for k, _ in found}) == len(found) else 1 / 0
        return list(walk(json.loads(text, object_pairs_hook=pairs)))
    except (ValueError, ZeroDivisionError):
        return [("$", "$", "malformed", None)]


def test_every_value_against_a_walk(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "key long, props string").withColumnRenamed("key", "id")
    want = sorted((i, *r[:3], r[3] or "") for i, t in enumerate(TEXTS) for r in whole(t))
    rows = json_audit.json_values(df, "props", ["id"]).collect()
    assert sorted((r.id, r.path, r["shape"], r.type, (r.value if r.type == "string" else None) or "") for r in rows) == want
    blank = {r.id: r.paths for r in json_audit.blank_paths(df, "props", "id").collect()}
    paths = {i: sorted(p for p, _, k, v in whole(t) if k == "string" and not v.strip()) for i, t in enumerate(TEXTS)}
    assert blank == {i: p for i, p in paths.items() if p}
    counts = {(r["shape"], r.type): (r.n, r.n_blank) for r in json_audit.json_paths(df, "props", []).collect()}
    assert counts["$.meta.deep.er.still[*].s", "string"] == (4, 2) and counts["$", "missing"] == (1, 0) and counts["$", "malformed"] == (3, 0)


def test_columns_that_clash_and_no_rows(spark):
    df = spark.createDataFrame([("p", 1, '{"type": {"value": ""}}')], "path string, pos int, type string")
    rows = json_audit.json_values(df.withColumnRenamed("path", "grp"), "type", ["grp"]).collect()
    assert {(r.path, r.type) for r in rows} == {("$", "object"), ("$.type", "object"), ("$.type.value", "string")}
    assert json_audit.json_paths(df.where("false"), "type", []).count() == 0
