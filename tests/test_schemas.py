"""The validator against a plain one: recursion, references, what is left over, patterns, schemas as data."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions.regex import RegexError, java_regex
from ledgerleaf.operators import jsonschema as J
from ledgerleaf.operators import results as X
from ledgerleaf.operators.schema_graph import SchemaRequestError, check_schema
from ledgerleaf.operators.schema_rows import malformed_schemas

from test_validation import errors


def plain_errors(schema, v, root, path="$", at="#"):
    """Errors by walking a value, for the few keywords of the random schemas."""
    fits = lambda s, x: not plain_errors(s, x, root)
    out = []
    for word, arg in schema.items():
        here = f"{at}/{word}"
        if word == "type":
            kinds = {"object": dict, "array": list, "integer": int, "null": type(None), "string": str}
            if not any(isinstance(v, kinds[k]) for k in ([arg] if isinstance(arg, str) else arg)):
                out.append((path, here, word))
        elif word == "$ref":
            out += plain_errors(root["$defs"][arg.rsplit("/", 1)[-1]] if arg != "#" else root, v, root, path, at)
        elif word == "properties" and isinstance(v, dict):
            for k in arg.keys() & v.keys():
                out += plain_errors(arg[k], v[k], root, f'{path}["{k}"]', f"{here}/{k}")
        elif word == "items" and isinstance(v, list):
            for i, x in enumerate(v):
                out += plain_errors(arg, x, root, f"{path}[{i}]", here)
        elif word == "maximum" and isinstance(v, int) and v > arg:
            out.append((path, here, word))
        elif word == "anyOf" and not any(fits(s, v) for s in arg):
            out.append((path, here, word))
        elif word == "not" and fits(arg, v):
            out.append((path, here, word))
        elif word == "contains" and isinstance(v, list) and not any(fits(arg, x) for x in v):
            out.append((path, here, word))
    return sorted(out)


RECURSIVE = {
    "tree": {"type": "object", "properties": {"v": {"maximum": 5}, "kids": {"items": {"$ref": "#"}}}},
    "choice": {"type": "object", "properties": {"v": {"maximum": 5}, "next": {"anyOf": [{"type": "null"}, {"$ref": "#"}]}, "kids": {"contains": {"$ref": "#/$defs/leaf"}}}, "$defs": {"leaf": {"type": "object", "not": {"properties": {"next": {"$ref": "#/$defs/leaf"}}}}}},
    "mutual": {"type": "object", "$ref": "#/$defs/a", "$defs": {"a": {"properties": {"next": {"$ref": "#/$defs/b"}, "v": {"maximum": 3}}}, "b": {"type": ["object", "null"], "properties": {"kids": {"items": {"anyOf": [{"$ref": "#/$defs/a"}, {"type": "integer"}]}}, "next": {"$ref": "#/$defs/a"}}}}},
}


def random_value(rng, depth):
    if depth == 0 or rng.random() < 0.1:
        return rng.choice([None, 1, 9, "s", {}])
    out = {"v": rng.choice([1, 1, 1, 1, 9])}
    if rng.random() < 0.7:
        out["next"] = random_value(rng, depth - 1)
    if rng.random() < 0.5:
        out["kids"] = [random_value(rng, depth - 1) for _ in range(rng.randint(0, 2))]
    return out


@pytest.mark.parametrize("name", sorted(RECURSIVE))
def test_recursion_equals_walking(spark, name):
    rng = random.Random(name)
    schema = RECURSIVE[name]
    values = [random_value(rng, rng.randint(0, 6)) for _ in range(60)]
    got = errors(spark, schema, *map(json.dumps, values), "no json")
    assert got == [plain_errors(schema, v, schema) for v in values] + [None]
    assert any(got[:-1]) and not all(got[:-1])


def test_a_thousand_levels(spark):
    """Deeper than any expression could be; Spark's JSON parser itself takes 1000 levels."""
    schema = {"type": "object", "properties": {"v": {"type": "integer"}, "n": {"$ref": "#"}}}
    text = '{"v":1,"n":' * 990 + '{"v":"x"}' + "}" * 990
    df = spark.createDataFrame([(1, text), (2, '{"v":1}')], "n int, t string")
    request = J.schema_request("deep", 1, schema)
    request = J.SchemaRequest("deep", 1, schema, J.SchemaPlan(schema, depth=12))
    deep, flat = J.validate_json(df, "t", request).orderBy("n").collect()
    assert [(e.path, e.validator) for e in deep.schema_errors] == [("$" + '["n"]' * 990 + '["v"]', "type")] and flat.schema_valid


@pytest.mark.parametrize("name", ["tree", "choice"])
def test_errors_are_not_broadcast(spark, name):
    """They grow with the data, whatever the size that Spark expects of them."""
    df = J.validate_json(spark.createDataFrame([('{"v":9}',)], "t string"), "t", J.schema_request("s", 1, RECURSIVE[name]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert [len(r.schema_errors) for r in df.collect()] == [1]


def test_references_by_uri_and_anchor(spark):
    schema = {
        "$id": "https://a.test/root/",
        "type": "object",
        "properties": {"x": {"$ref": "part#deep"}, "y": {"$ref": "#/$defs/p/$defs/q"}, "z": {"$ref": "https://a.test/root/part"}, "w": {"$ref": "#/$defs/p/properties/in~1er%20s"}},
        "$defs": {"p": {"$id": "part", "properties": {"in/er s": {"maximum": 1}}, "type": ["object", "integer"], "$defs": {"q": {"$anchor": "deep", "maximum": 2}}}},
    }
    got = errors(spark, schema, {"x": 3, "y": 2, "z": "a"}, {"x": 2, "y": 3, "z": {"in/er s": 2}, "w": 2})
    assert got == [[('$["x"]', "#/properties/x/maximum", "maximum"), ('$["z"]', "#/properties/z/type", "type")], [('$["w"]', "#/properties/w/maximum", "maximum"), ('$["y"]', "#/properties/y/maximum", "maximum"), ('$["z"]["in/er s"]', "#/properties/z/properties/in~1er s/maximum", "maximum")]]


def test_dynamic_references_lead_to_the_outermost_resource(spark):
    tree = {"$id": "https://t.test/tree", "$dynamicAnchor": "node", "type": "object", "properties": {"data": True, "children": {"type": "array", "items": {"$dynamicRef": "#node"}}}}
    strict = {"$id": "https://t.test/strict", "$dynamicAnchor": "node", "type": "object", "$ref": "tree", "unevaluatedProperties": False, "$defs": {"tree": tree}}
    loose = {"type": "object", "$ref": "https://t.test/tree", "$defs": {"tree": tree}}
    values = [{"children": [{"daat": 1}]}, {"children": [{"data": 1, "children": []}]}, {"children": [{"children": [{"x": 1}, {"children": 2}]}]}]
    assert [[(p, v) for p, _, v in row] for row in errors(spark, strict, *values)] == [[('$["children"][0]', "unevaluatedProperties")], [], [('$["children"][0]["children"][0]', "unevaluatedProperties"), ('$["children"][0]["children"][1]["children"]', "type")]]
    assert [len(row) for row in errors(spark, loose, *values)] == [0, 0, 1]


@pytest.mark.parametrize(
    ("part", "good", "bad"),
    [
        ({"properties": {"a": True}}, {"a": 1}, {"b": 1}),
        ({"patternProperties": {"^x": True}}, {"x1": 1}, {"y": 1}),
        ({"additionalProperties": {"type": "integer"}}, {"q": 1}, None),
        ({"allOf": [{"properties": {"a": True}}, {"properties": {"b": True}}]}, {"a": 1, "b": 1}, {"c": 1}),
        ({"oneOf": [{"properties": {"a": {"type": "integer"}}, "required": ["a"]}, {"properties": {"b": True}, "required": ["b"]}]}, {"a": 1}, {"b": 1, "a": "s", "c": 1}),
        ({"anyOf": [{"properties": {"a": {"const": 1}}}, {"properties": {"b": True}}]}, {"a": 1, "b": 1}, {"a": 2, "b": 1}),
        ({"if": {"properties": {"a": {"const": 1}}, "required": ["a"]}, "then": {"properties": {"b": True}}, "else": {"properties": {"a": True, "c": True}}}, {"a": 1, "b": 2}, {"a": 1, "c": 1}),
        ({"dependentSchemas": {"a": {"properties": {"a": True, "b": True}}}}, {"a": 1, "b": 1}, {"b": 1}),
        ({"$ref": "#/$defs/p"}, {"p": 1}, {"q": 1}),
        ({"not": {"properties": {"z": {"const": 1}}, "required": ["z"]}}, {}, {"a": 1}),
    ],
)
def test_unevaluated_properties(spark, part, good, bad):
    schema = {"type": "object", **part, "unevaluatedProperties": False, "$defs": {"p": {"properties": {"p": True}}}}
    fine, wrong = errors(spark, schema, good, bad if bad is not None else good)
    assert fine == [] and (bad is None or ("$", "#/unevaluatedProperties", "unevaluatedProperties") in wrong)


def test_unevaluated_items(spark):
    schema = {"type": "object", "properties": {"x": {"allOf": [{"prefixItems": [True]}, {"contains": {"const": "c"}}], "unevaluatedItems": {"type": "null"}}}}
    got = errors(spark, schema, {"x": [1, "c", "c"]}, {"x": ["c", None]}, {"x": ["c", 1]}, {"x": "text"})
    assert got == [[], [], [('$["x"]', "#/properties/x/unevaluatedItems", "unevaluatedItems")], []]


def test_counts_of_contained_items(spark):
    schema = {"type": "object", "properties": {"x": {"contains": {"const": 1}, "minContains": 2, "maxContains": 3}}}
    got = errors(spark, schema, *({"x": [1] * n} for n in range(5)))
    assert [[v for _, _, v in row] for row in got] == [["contains"], ["minContains"], [], [], ["maxContains"]]


def test_unknown_keywords_say_nothing(spark):
    assert errors(spark, {"type": "object", "ref": "#/x", "minlength": 3, "x-own": {"type": 7}, "format": "date", "$vocabulary": {}}, {"a": "b"}) == [[]]


PATTERNS = [r"^(?P<a>x)(?P=a)$", r"^\d+$", r"\A\w+\Z", r"\bab\b", r"[^\W\d_]", r"(?i)straSSe", r"a.c", r"(?s)a.c", r"(?m)^b$", r"x{2,3}?y", r"(?<!a)b(?=c)", r"[\]\-^]", r"a|bc|", r"(?x) a b # comment", r"\s\S", r"(?a)^\w$", r"(?i:K)", r"^[a-zé]*$", r"\Bb", r"a\tb|\x41|é", r"(a+)+$", r"^(?:a|b){2}\.$", r"[\d\s]{2}", r"[^a\n]"]
TEXTS = ["", "xx", "x", "12", "١٢", "12\n", "12 ", "é", "ab", "cab ab", "a\nc", "a\rc", "a c", "abc", "a\nb\n", "STRASSE", "xxy", "bc", "]", "-", "^", "a\tb", "A", "_", "a b", "\x1c\x85", "ä̈", "²", "k", "ba.", "1 ", "ab\n\n", "😀c", "a😀c"]


def test_patterns_match_as_in_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "n int, t string")
    got = df.orderBy("n").select(*(F.col("t").rlike(java_regex(p)).alias(f"p{k}") for k, p in enumerate(PATTERNS))).collect()
    assert [list(row) for row in got] == [[re.search(p, t) is not None for p in PATTERNS] for t in TEXTS]


@pytest.mark.parametrize("pattern", ["(", "[", "*", r"(a)(?(1)b|c)", "a{99999999999}", "(?P<1>a)", "[b-a]", r"\p{L}"])
def test_patterns_without_an_equivalent_are_refused(spark, pattern):
    with pytest.raises(RegexError):
        java_regex(pattern)
    with pytest.raises(SchemaRequestError):
        J.schema_request("s", 1, {"type": "object", "properties": {"a": {"pattern": pattern}}})


PARTS = [
    {"required": "abc"}, {"required": ["a", "a"]}, {"minLength": "x"}, {"minLength": -1}, {"maxItems": 1.5}, {"maxItems": 2.0}, {"pattern": "("}, {"pattern": "^a"}, {"patternProperties": {"(": True}},
    {"patternProperties": {"a": 1}}, {"properties": [1]}, {"properties": {"a": 1}}, {"properties": {"a": False}}, {"minimum": "x"}, {"minimum": True}, {"multipleOf": 0}, {"uniqueItems": 1}, {"enum": "a"}, {"enum": []},
    {"items": [True]}, {"anyOf": []}, {"anyOf": [{}, {"type": []}]}, {"not": None}, {"$defs": {"a": {"type": "text"}}}, {"dependentRequired": {"a": "b"}}, {"dependentSchemas": {"a": {"minItems": "1"}}},
    {"properties": {"a": {"items": {"maxLength": []}}}}, {"title": 1}, {"$anchor": "1a"}, {"$anchor": "ab\n"}, {"$anchor": "a-b"}, {"$id": "a#b"}, {"$id": "a"}, {"unevaluatedItems": {"maximum": "1"}}, {"x-own": {"type": 7}}, {"type": ["string", "string"]}, {"const": {"type": 7}},
    {"properties": {"type": {"type": "string"}, "required": {}}}, {"if": {"then": {"else": {"oneOf": [{"contains": {"pattern": "["}}]}}}},
]


def test_schemas_as_data_are_checked_like_a_request(spark):
    def refused(schema):
        try:
            check_schema(schema)
        except SchemaRequestError:
            return True
        return False

    schemas = [{"type": "object", **p} for p in PARTS] + [{"type": "object", "properties": {"deep": {"items": p}}} for p in PARTS] + [True, False]
    texts = [json.dumps(s) for s in schemas]
    df = spark.createDataFrame([(t, "x") for t in texts + texts[:5] + [None, "{no json"]], "schema string, row string").repartition(3)
    got = {r.schema for r in malformed_schemas(df).collect()}
    assert got == {t for t, s in zip(texts, schemas, strict=True) if refused(s)} | {"{no json"}


def test_requests_with_malformed_schemas_are_refused(spark):
    raw = {"title": "t", "document_type": "d", "source": {"provider": "p", "source_uri": "u"}, "participants": [], "segments": [{"sequence": 1, "text": "x"}]}
    schemas = [{"type": "object"}, {"type": "object", "properties": {"a": {"$ref": "#"}}}, {"type": "object", "properties": {"a": {"items": {"required": "x"}}}}, {"type": "object", "pattern": "("}, {"type": "array"}, "text", None]
    bodies = [json.dumps({"schemaVersion": 1, "rawDocument": raw, "provider": "openai", "model": "m", "schemaRequest": {"name": "n", "version": 1, "schema": s}}) for s in schemas]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies * 2)], "n int, body string")
    got = [r.outcome for r in X.triage_requests(df).orderBy("n").collect()]
    assert got == (["accepted"] * 2 + ["invalid_request"] * 5) * 2


def test_nothing_to_validate(spark):
    df = spark.createDataFrame([], "n int, t string")
    for schema in (RECURSIVE["tree"], RECURSIVE["choice"]):
        assert J.validate_json(df, "t", J.schema_request("s", 1, schema)).count() == 0
    assert malformed_schemas(spark.createDataFrame([], "schema string")).count() == 0


def test_hotspots_fold_members_of_the_data(spark):
    schema = {"type": "object", "properties": {"a": {"additionalProperties": {"type": "integer"}}, 'q"[0]': {"items": {"type": "string"}}}, "patternProperties": {"^x": {"type": "null"}}}
    bodies = [{"a": {"k": "s", 'odd"]["a': "s"}}] * 3 + [{"a": {f"u{i}": None}} for i in range(40)] + [{'q"[0]': ["t", 1, 2]}, {"x1": 0}, {"a": {"a": None}}, {"a": {"k": 1}}]
    frame = spark.createDataFrame([(json.dumps(b),) for b in bodies] + [("nope",), (None,)], "t string")
    request = J.schema_request("s", 1, schema)
    judged = J.validate_json(frame, "t", request)
    got = {(r.path, r.validator): (r.n, r.n_error, [tuple(f) for f in r.frequent]) for r in J.schema_error_hotspots(judged, request, most=3).collect()}
    many = [('$["a"]["k"]', 3), (r'$["a"]["odd\"][\"a"]', 3), ('$["a"]["a"]', 1)]
    assert got.pop(('$["a"]["*"]', "type")) == (46, 0, many[:2] + [('$["a"]["u0"]', 1)])
    assert got.pop(('$["a"]["a"]', "type")) == (1, 0, many[2:])
    assert got.pop((r'$["q\"[0]"][]', "type")) == (2, 0, [(r'$["q\"[0]"][1]', 1), (r'$["q\"[0]"][2]', 1)])
    assert got.pop(('$["*"]', "type")) == (1, 0, [('$["x1"]', 1)]) and not got
    assert not J.schema_error_hotspots(judged.where("false"), request).collect()
    for bad in ((0, 5), (6, 5), (1, 2_000_000)):
        with pytest.raises(ValueError):
            J.schema_error_hotspots(judged, request, *bad)


def test_hotspots_beyond_what_is_tracked(spark):
    """Counts keep within the stated error, and what is frequent is found, with far more paths than are tracked."""
    member = F.when(F.col("id") % 4 == 0, F.col("id") % 3).otherwise(F.col("id"))
    body = F.concat(F.lit('{"m":{"'), member.cast("string"), F.lit('":0}}'))
    request = J.schema_request("s", 1, {"type": "object", "properties": {"m": {"additionalProperties": {"type": "string"}}}})
    judged = J.validate_json(spark.range(40000, numPartitions=4).select(body.alias("t")), "t", request)
    (row,) = J.schema_error_hotspots(judged, request, most=3, tracked=300).collect()
    assert row.n == 40000 and row.n_error == -(-40000 * 7 // 1024)
    assert {f.path for f in row.frequent} == {f'$["m"]["{i}"]' for i in range(3)}
    assert all(abs(f.n - 10000 / 3) <= row.n_error + 2 for f in row.frequent)


def test_hotspots_are_exact_beyond_what_is_tracked(spark):
    """Counts hardly above the others, which no sketch of that size could tell; of equal ones the least paths."""
    member = F.when(F.col("id") < 12, F.col("id") % 4).otherwise(F.col("id"))
    body = F.concat(F.lit('{"m":{"'), member.cast("string"), F.lit('":0}}'))
    request = J.schema_request("s", 1, {"type": "object", "properties": {"m": {"additionalProperties": {"type": "string"}}}})
    judged = J.validate_json(spark.range(20000, numPartitions=4).select(body.alias("t")), "t", request)
    (row,) = J.schema_error_hotspots(judged, request, most=6, tracked=300).collect()
    assert [tuple(f) for f in row.frequent] == [(f'$["m"]["{i}"]', 3) for i in range(4)] + [(f'$["m"]["{i}"]', 1) for i in (100, 1000)]
    assert row.n == 20000
