"""Queries of the validator beyond single values: recursion, what subschemas leave over, patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions.nested import exploded
from ledgerleaf.operators import jsonschema as J
from ledgerleaf.plans.transcripts import table


def order_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders as JSON, each inside the one before."""
    order = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    chains = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(order)).alias("orders"))
    body = F.aggregate(F.reverse("orders"), F.lit("null"), lambda rest, o: F.concat(F.lit('{"key":'), o["key"], F.lit(',"status":"'), o["status"], F.lit('","next":'), rest, F.lit("}")))
    return chains.select("o_custkey", body.alias("body"))


def chain_request(following: dict) -> J.SchemaRequest:
    order = {"$anchor": "order", "type": ["object", "null"], "properties": {"key": {"type": "integer"}, "status": {"enum": ["O", "F"]}, "next": following}}
    return J.schema_request("chain", 1, {"type": "object", "$ref": "#order", "$defs": {"order": order}})


def _errors(df: DataFrame, key: str, request: J.SchemaRequest) -> DataFrame:
    return exploded(J.validate_json(df, "body", request), "schema_errors", "at", "e", key).select(key, "e.path", "e.schema_path", "e.validator")


def schema_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of chains of any depth, by a schema that refers to itself."""
    return _errors(order_chains(spark, sf_dir), "o_custkey", chain_request({"$ref": "#order"}))


def schema_recursive_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the rest of a chain is one of two choices, so that it is right or wrong as a whole."""
    return _errors(order_chains(spark, sf_dir), "o_custkey", chain_request({"anyOf": [{"type": "null"}, {"$ref": "#order"}]}))


def left_over_request() -> J.SchemaRequest:
    schema = {
        "type": "object",
        "allOf": [{"properties": {"key": True, "prio": True, "tags": True}}],
        "anyOf": [{"properties": {"status": {"const": "F"}, "paid": True}}, {"properties": {"status": {"const": "O"}, "open": True}}],
        "if": {"properties": {"prio": {"const": "1-URGENT"}}},
        "then": {"properties": {"rush": True}},
        "dependentSchemas": {"gift": {"properties": {"gift": True, "note": True}}},
        "$ref": "https://orders.test/extra#more",
        "properties": {"tags": {"prefixItems": [{"type": "integer"}], "contains": {"pattern": "^x"}, "unevaluatedItems": False}},
        "unevaluatedProperties": {"type": "null"},
        "$defs": {"extra": {"$id": "https://orders.test/extra", "$defs": {"m": {"$anchor": "more", "properties": {"extra": {"type": "boolean"}}}}}},
    }
    return J.schema_request("left over", 1, schema)


def schema_unevaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and items that no applied part of a schema has looked at."""
    n = F.col("o_orderkey")
    some = lambda k, member: F.when(n % k == 0, f',"{member}":1').otherwise("")
    tags = F.concat(F.lit(',"tags":['), n, F.lit(',"x1"'), F.when(n % 6 == 5, ',"y"').otherwise(""), F.lit("]"))
    body = F.concat(F.lit('{"extra":true,"none":null,"key":'), n, F.lit(',"status":"'), F.col("o_orderstatus"), F.lit('","prio":"'), F.col("o_orderpriority"), F.lit('"'), tags, some(2, "paid"), some(3, "open"), some(5, "rush"), some(7, "gift"), some(4, "note"), F.lit("}"))
    return _errors(table(spark, sf_dir, "orders").select(n, body.alias("body")), "o_orderkey", left_over_request())


def pattern_request() -> J.SchemaRequest:
    fits = {"first": r"^\w+$", "pair": r"(?P<c>\w)(?P=c)", "number": r"^\d{2}$", "whole": r"\A\d{2}\Z"}
    return J.schema_request("patterns", 1, {"type": "object", "properties": {k: {"pattern": p} for k, p in fits.items()}})


def schema_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of patterns in Python's syntax on the first word of each document and on numbers in two scripts."""
    n = F.col("doc_id")
    first = F.regexp_extract(F.coalesce("text", F.lit("")), r"[^\x20\x09-\x0D]+", 0)
    number = F.concat(F.when(n % 2 == 0, "٣٤").otherwise("12"), F.when(n % 3 == 0, "\n").when(n % 3 == 1, " ").otherwise(""))
    body = F.to_json(F.struct(first.alias("first"), first.alias("pair"), number.alias("number"), number.alias("whole")))
    return _errors(table(spark, sf_dir, "documents").select(n, body.alias("body")), "doc_id", pattern_request())


def price_request() -> J.SchemaRequest:
    return J.schema_request("prices", 1, {"type": "object", "properties": {"spent": {"type": "object", "additionalProperties": {"items": {"maximum": 150000}}}}})


def schema_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers with most orders above a price, found as the most frequent paths of one place of the orders' JSON."""
    spent = F.concat(F.lit('{"spent":{"customer '), F.col("o_custkey").cast("string"), F.lit('":['), F.col("o_totalprice").cast("string"), F.lit("]}}"))
    judged = J.validate_json(table(spark, sf_dir, "orders").select(spent.alias("body")), "body", price_request())
    found = J.schema_error_hotspots(judged, price_request(), most=20)
    return found.select("path", "validator", F.col("n").alias("n_place"), "n_error", F.inline("frequent").alias("frequent", "n"))


QUERIES = {f.__name__: f for f in (schema_recursive, schema_recursive_choice, schema_unevaluated, schema_patterns, schema_hotspots)}

_CHAINS = "chains as (select o_custkey, o_orderstatus as s, row_number() over (partition by o_custkey order by o_orderkey, o_orderstatus) as n from orders)"

ORACLES = {
    "schema_recursive": f"""with recursive {_CHAINS}, walk as (select o_custkey, n, s, '$' as path, '#' as schema_path from chains where n = 1
          union all select c.o_custkey, c.n, c.s, path || '["next"]', schema_path || '/properties/next' from walk w join chains c on c.o_custkey = w.o_custkey and c.n = w.n + 1)
        select o_custkey, path || '["status"]' as path, schema_path || '/properties/status/enum' as schema_path, 'enum' as validator from walk where s not in ('O', 'F')""",
    "schema_recursive_choice": f"""with {_CHAINS} select o_custkey, '$["status"]' as path, '#/properties/status/enum' as schema_path, 'enum' as validator from chains where n = 1 and s not in ('O', 'F')
        union all select distinct o_custkey, '$["next"]', '#/properties/next/anyOf', 'anyOf' from chains where n > 1 and s not in ('O', 'F')""",
    "schema_unevaluated": """select o_orderkey, '$' as path, '#/anyOf' as schema_path, 'anyOf' as validator from orders where o_orderstatus not in ('F', 'O')
        union all select o_orderkey, '$["tags"]', '#/properties/tags/unevaluatedItems', 'unevaluatedItems' from orders where o_orderkey % 6 = 5
        union all select o_orderkey, '$', '#/unevaluatedProperties', 'unevaluatedProperties' from orders where o_orderstatus not in ('F', 'O') or (o_orderkey % 2 = 0 and o_orderstatus <> 'F')
          or (o_orderkey % 3 = 0 and o_orderstatus <> 'O') or (o_orderkey % 5 = 0 and o_orderpriority <> '1-URGENT') or (o_orderkey % 4 = 0 and o_orderkey % 7 <> 0)""",
    "schema_patterns": r"""with w as (select doc_id, regexp_extract(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents)
        select doc_id, '$["first"]' as path, '#/properties/first/pattern' as schema_path, 'pattern' as validator from w where not regexp_full_match(w, '[\p{L}\p{N}_]+')
        union all select doc_id, '$["pair"]', '#/properties/pair/pattern', 'pattern' from w where len(list_filter(range(1, length(w)), lambda i: w[i] = w[i + 1] and regexp_full_match(w[i], '[\p{L}\p{N}_]'))) = 0
        union all select doc_id, '$["number"]', '#/properties/number/pattern', 'pattern' from w where doc_id % 3 = 1
        union all select doc_id, '$["whole"]', '#/properties/whole/pattern', 'pattern' from w where doc_id % 3 <> 2""",
    "schema_hotspots": """with counted as (select '$["spent"]["customer ' || o_custkey || '"][0]' as frequent, count(*) as n from orders where o_totalprice > 150000 group by o_custkey),
          placed as (select *, row_number() over (order by n desc, frequent) as r, sum(n) over () as total from counted)
        select '$["spent"]["*"][]' as path, 'maximum' as validator, total::bigint as n_place, case when total <= 10000 then 0 else ceil(total * 3.5 / 16384) end::bigint as n_error, frequent, n from placed where r <= 20""",
}
