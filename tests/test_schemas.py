"""Fields of nested records, by version."""

from __future__ import annotations

from causa.operators import schemas

RECORDS = [
    (1, '{"a": 1, "b": {"c": "x", "d": [1, "two"]}, "e": []}'), (1, '{"b": {"d": [{"f": true}]}, "a": 2}'), (1, None), (1, "not json"),
    (2, '{"b": {"d": [[1]], "c": null}, "a": "1"}'), (3, '{"e": [], "a": 5, "b": {"d": ["y", 3, {"f": false}], "c": "z"}}'), (3, "{no"),
]


def known(spark):
    return schemas.fields(spark.createDataFrame(RECORDS, "version int, record string"))


def test_paths_types_and_counts(spark):
    got = {(r.path, r.type, r.records) for r in known(spark).where("version = 1").collect()}
    assert got == {("$", "INVALID|OBJECT", 2), ("$.a", "BIGINT", 2), ("$.b", "OBJECT", 2), ("$.b.c", "STRING", 1), ("$.b.d", "ARRAY", 2), ("$.b.d[]", "BIGINT|OBJECT|STRING", 1), ("$.b.d[].f", "BOOLEAN", 1), ("$.e", "ARRAY", 1)}


def test_added_removed_and_retyped(spark):
    got = {r.path: (r.change, r.before, r.after) for r in schemas.diff(known(spark), 1, 2).collect()}
    assert got == {
        "$": ("retyped", "INVALID|OBJECT", "OBJECT"), "$.a": ("retyped", "BIGINT", "STRING"), "$.b.c": ("retyped", "STRING", "VOID"), "$.b.d[]": ("retyped", "BIGINT|OBJECT|STRING", "ARRAY"),
        "$.b.d[][]": ("added", None, "BIGINT"), "$.b.d[].f": ("removed", "BOOLEAN", None), "$.e": ("removed", "ARRAY", None),
    }


def test_hash_is_the_same_whatever_the_order(spark):
    got = {r.version: (r.paths, r.digest) for r in schemas.digests(known(spark)).collect()}
    assert got[1] == got[3] and got[1] != got[2]


def test_no_records(spark):
    assert known(spark).where("version = 9").count() == 0
    assert schemas.fields(spark.createDataFrame([], "version int, record string")).collect() == []


def test_records_are_opened_once_per_level(spark):
    rows = [(1, '{"a":{"b":[{"c":1},{"c":2},{"c":"x"}]},"d":[[1],[2,null]]}'), (1, '{"a":{"b":[]}}'), (2, "no json"), (2, None)]
    found = schemas.fields(spark.createDataFrame(rows, "version int, record string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan and "schema_of_variant" not in plan
    got = {(r.version, r.path): (r.type, r.records) for r in found.collect()}
    assert got[1, "$.a.b[].c"] == ("BIGINT|STRING", 1) and got[1, "$.a.b"] == ("ARRAY", 2) and got[1, "$.d[]"] == ("ARRAY", 1) and got[1, "$.d[][]"] == ("BIGINT|VOID", 1) and got[2, "$"] == ("INVALID", 1)
