"""Schema keywords one by one, and what is refused."""

import pytest

from millrace.llm import neardup, toolcalls, vectors

CASES = [
    ({"const": 1}, ["1", "1.0"], ["true", "2"], "const"),
    ({"exclusiveMinimum": 3}, ["3.5", '"x"'], ["3", "2"], "exclusiveMinimum"),
    ({"exclusiveMaximum": 3}, ["2"], ["3", "4"], "exclusiveMaximum"),
    ({"multipleOf": 0.1}, ["0.3", "-2", "0"], ["0.35"], "multipleOf"),
    ({"minItems": 2}, ["[1,2]", "{}"], ["[1]"], "minItems"),
    ({"maxItems": 1}, ["[1]"], ["[1,2]"], "maxItems"),
    ({"uniqueItems": True}, ["[1,true,[1]]"], ["[1,1.0]", '[{"a":1,"b":2},{"b":2,"a":1}]'], "uniqueItems"),
    ({"contains": {"type": "string"}}, ['[1,"a"]', "3"], ["[]", "[1]"], "contains"),
    ({"contains": {"type": "string"}, "minContains": 0, "maxContains": 1}, ["[]", '["a"]'], ['["a","b"]'], "maxContains"),
    ({"minProperties": 1}, ['{"a":1}'], ["{}"], "minProperties"),
    ({"maxProperties": 1}, ['{"a":1}'], ['{"a":1,"b":2}'], "maxProperties"),
    ({"dependentRequired": {"a": ["b"]}}, ["{}", '{"b":1}', '{"a":1,"b":1}'], ['{"a":1}'], "dependentRequired"),
    ({"propertyNames": {"maxLength": 2}}, ['{"ab":1}'], ['{"abc":1}'], "propertyNames"),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ['"a"', "7"], ["3"], "anyOf"),
    ({"oneOf": [{"minimum": 5}, {"maximum": 9}]}, ["3", "12"], ["7"], "oneOf"),
    ({"not": {"type": "null"}}, ["1"], ["null"], "not"),
    ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, ["1"], ["3"], "maximum"),
    ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 2}}, ['"ab"', "2"], ['"a"'], "minLength"),
    ({"prefixItems": [{"type": "string"}], "items": {"type": "number"}}, ['["a",1]', "[]"], ["[1]", '["a","b"]'], "type"),
    ({"patternProperties": {"^x": {"type": "number"}}, "additionalProperties": False}, ['{"xa":1}'], ['{"xa":"b"}'], "type"),
    ({"properties": {"a": {}}, "additionalProperties": {"type": "string"}}, ['{"a":1,"b":"c"}'], ['{"b":1}'], "type"),
    ({"items": False}, ["[]"], ["[1]"], "false"),
    ({"$defs": {"tree": {"properties": {"kids": {"items": {"$ref": "#/$defs/tree"}}, "v": {"type": "number"}}}}, "$ref": "#/$defs/tree"}, ['{"v":1,"kids":[{"kids":[{"v":2}]}]}'], ['{"kids":[{"kids":[{"v":"x"}]}]}'], "type"),
    ({"$defs": {"a/b": {"type": "string"}}, "items": {"$ref": "#/$defs/a~1b"}}, ['["x"]'], ["[1]"], "type"),
]


@pytest.mark.parametrize("schema, good, bad, keyword", CASES, ids=lambda x: x if isinstance(x, str) else None)
def test_keywords(schema, good, bad, keyword):
    toolcalls.check_schema(schema)
    assert [toolcalls.schema_errors(toolcalls._parsed(v), schema) for v in good] == [[]] * len(good)
    for v in bad:
        errors = toolcalls.schema_errors(toolcalls._parsed(v), schema)
        assert errors and all(e.endswith(f": {keyword}") for e in errors)


@pytest.mark.parametrize(
    "schema, why",
    [
        ({"properties": {"a": {"minLenght": 3}}}, "minLenght"), ({"anyOf": [{"unevaluatedItems": False}]}, "unevaluatedItems"), ({"$ref": "#/$defs/none"}, "nothing"), ({"$ref": "http://x/y"}, "beyond"),
        ({"$defs": {"a": {"$ref": "#/$defs/b"}, "b": {"allOf": [{"$ref": "#/$defs/a"}]}}, "$ref": "#/$defs/a"}, "circle"), ({"$ref": "#"}, "circle"), ({"$ref": "#/enum", "enum": [1]}, "no schema"),
    ],
)
def test_schemas_that_are_refused(spark, schema, why):
    calls = spark.createDataFrame([("c", "t", "{}")], "call_id string, tool string, arguments string")
    with pytest.raises(ValueError, match=why):
        toolcalls.checked_arguments(calls["tool"], calls["arguments"], {"t": schema})


def test_repeated_keys_are_no_json():
    for text in ('{"a":1,"a":2}', '[{"b":{"a":1,"a":1}}]'):
        with pytest.raises(ValueError, match="twice"):
            toolcalls._parsed(text)


def test_bounds(spark):
    docs = spark.createDataFrame([(1, "a b", 0)], "doc_id long, text string, row long")
    for percent in (50, 74, 101):
        with pytest.raises(ValueError, match="percent"):
            neardup.near_duplicates(docs, "row", percent)
    assert vectors._wanted({64: 10_000, 3: 1}) == {64: 400, 3: 16}
    many = vectors._wanted({1024: 10**9, 768: 10**9})
    assert sum(d * n for d, n in many.items()) <= vectors.MOST_NUMBERS
    with pytest.raises(ValueError, match="room"):
        vectors._wanted({d: 5 for d in range(1, 5000)})
