"""JSON Schema validation by hand, and against documents of a nested schema."""

import json

import pytest

from lodestone.sources import validated

SCHEMA = {
    "type": "object", "required": ["id", "task", "scores"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": "^[A-Z]+_[0-9]+$"},
        "task": {"type": "object", "required": ["level"], "properties": {"level": {"enum": ["L1", "L2", None]}, "marks": {"type": "integer", "minimum": 1, "maximum": 20}, "note": {"type": ["string", "null"], "minLength": 3}}},
        "scores": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"$ref": "#/$defs/score"}},
        "more": {}, "weight": {"type": "number", "exclusiveMinimum": 0}, "flag": {"type": "boolean", "const": True},
    },
    "$defs": {"score": {"type": "object", "required": ["value"], "properties": {"value": {"type": "number", "minimum": 0, "maximum": 1}}}},
}
GOOD = {"id": "AB_1", "task": {"level": "L1", "marks": 5, "note": "éèê"}, "scores": [{"value": 0.5}, {"value": 1}]}


def changed(**kw):
    return json.dumps({**GOOD, **kw})


CASES = [
    (json.dumps(GOOD), []), (changed(task={"level": None, "marks": 5.0, "note": None}), []), (changed(more=[1, {"x": 2}], weight=0.1, flag=True), []),
    ("{broken", ["json"]), (None, ["json"]), ("[1]", ["$:type"]), ("{}", ["id:required", "task:required", "scores:required"]),
    (changed(id="ab_1"), ["id:pattern"]), (changed(id=7), ["id:type"]), (changed(task={"level": "L9", "marks": 2.5}), ["task.level:enum", "task.marks:type"]),
    (changed(task={"marks": 0}), ["task.level:required", "task.marks:minimum"]), (changed(task={"level": "L2", "marks": 21, "note": "no"}), ["task.marks:maximum", "task.note:minLength"]),
    (changed(scores=[]), ["scores:minItems"]), (changed(scores=[{"value": 2}, {}, {"value": "x"}, {"value": 3}]), ["scores:maxItems", "scores[].value:maximum", "scores[].value:required", "scores[].value:type"]),
    (changed(extra=1), ["$:additionalProperties"]), (changed(weight=0, flag=False), ["weight:exclusiveMinimum", "flag:const"]), (changed(scores={"value": 1}), ["scores:type"]),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, doc string")
    made = validated.judged(df, "doc", SCHEMA)
    got = {r["i"]: r for r in made.collect()}
    for i, (text, want) in enumerate(CASES):
        assert sorted(got[i]["reasons"]) == sorted(want), text
        assert (got[i]["sample"] is None) == bool(want)
    assert got[0]["sample"]["task"]["note"] == "éèê" and [s["value"] for s in got[0]["sample"]["scores"]] == [0.5, 1.0] and got[1]["sample"]["task"]["marks"] == 5
    assert validated.accepted(made).count() == 3 and validated.rejected(made).count() == len(CASES) - 3


def test_rules_over_several_fields(spark):
    rules = {"scores fall": "forall(sequence(1, size(sample.scores) - 1), i -> sample.scores[i].value <= sample.scores[i - 1].value)", "marks known": "sample.task.marks > 0"}
    rows = [(changed(scores=[{"value": 0.5}, {"value": 0.4}]),), (json.dumps(GOOD),), (changed(task={"level": "L1"}, scores=[{"value": 0.5}, {"value": 0.5}]),), ("x",)]
    got = [r["reasons"] for r in validated.judged(spark.createDataFrame(rows, "doc string"), "doc", SCHEMA, rules).collect()]
    assert got == [[], ["scores fall"], ["marks known"], ["json"]]


def test_files(spark, tmp_path):
    for name, text in (("a.json", json.dumps(GOOD, indent=2)), ("deep/b.json", "{"), ("deep/c.txt", json.dumps(GOOD))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    made = validated.read_documents(spark, str(tmp_path), SCHEMA)
    assert sorted((r["file"][-6:], list(r["reasons"])) for r in made.collect()) == [("a.json", []), ("b.json", ["json"])]


def test_references_that_recur_are_an_error():
    with pytest.raises(ValueError, match="recurs"):
        validated.spark_type({"type": "object", "properties": {"x": {"$ref": "#/properties/x"}}})
