"""JSON Schema validation of a column: a schema is compiled once, on the driver, into Column expressions.

Payloads are read as VARIANT for the checks and stay raw text otherwise: nothing is coerced, filled in or reordered.
Errors are {path, schema_path, validator, message}, sorted; paths and validators follow Draft 2020-12, messages are
our own. Text that is no JSON, duplicate keys and NaN count as invalid JSON. Keywords that the draft does not know, and
``format``, say nothing; patterns are Python's.

A schema that refers to itself has no finite expression. Its references are followed a few times within one, and what
lies deeper leaves it as calls (schema, path, value), rows of a frontier that is validated in turn until none is left:
see ``recursion``.
"""

from __future__ import annotations

import json
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import text
from ledgerleaf.functions.nested import exploded
from ledgerleaf.functions.regex import java_regex
from ledgerleaf.operators.schema_graph import HOLD_LIST, HOLD_MEMBERS, HOLD_SCHEMA, SHAPES, SchemaGraph, SchemaRequestError, check_schema, schema_path

#: A step of a path: the root, an index or a quoted member.
STEP = r'^\$|\[[0-9]+\]|\["(?:[^"\\]|\\.)*"\]'
ERROR = "array<struct<path:string,schema_path:string,validator:string,message:string>>"
#: Keywords that check a value; those beside ``if`` and ``contains`` are applied by them.
CHECKED = ({*SHAPES, *HOLD_SCHEMA, *HOLD_LIST, *HOLD_MEMBERS, "const"}) - {"then", "else", "minContains", "maxContains"}


@dataclass(frozen=True)
class SchemaRequest:
    name: str
    version: int
    schema: dict
    plan: SchemaPlan | None = field(default=None, compare=False, repr=False)


def schema_request(name: str, version: int, schema: dict, **unknown: object) -> SchemaRequest:
    """Check a request before anything runs: a one-line name, a positive version, a well-formed schema of an object."""
    if unknown:
        raise SchemaRequestError(f"unknown members: {', '.join(sorted(unknown))}")
    if not isinstance(name, str) or not name.strip() or "\n" in name.strip():
        raise SchemaRequestError("the name must be one line of text")
    if isinstance(version, bool) or not isinstance(version, int) or version <= 0:
        raise SchemaRequestError("the version must be a positive integer")
    if not isinstance(schema, dict) or schema.get("type") != "object":
        raise SchemaRequestError("the root of the schema must be of type object")
    check_schema(schema)
    plan = SchemaPlan(schema)
    if plan.recursive:
        from ledgerleaf.operators.recursion import compiled

        compiled(plan)
    else:
        Compiler(plan).entry(0)
    return SchemaRequest(name.strip(), version, schema, plan)


def instance_path(parent: Column, key: str | Column | None = None, index: Column | None = None) -> Column:
    """``parent`` and a key, quoted as JSON, or an index."""
    if isinstance(key, Column):
        return F.concat(parent, F.to_json(F.array(key)))
    return F.concat(parent, F.lit(f"[{json.dumps(key, ensure_ascii=False)}]")) if key is not None else F.concat(parent, F.lit("["), index.cast("string"), F.lit("]"))


def kind(v: Column) -> Column:
    """The JSON type of a variant; a whole number is an integer whatever it is written as; null for no value."""
    of = F.schema_of_variant(v)
    number = F.when(F.try_variant_get(v, "$", "double") % 1 == 0, "integer").otherwise("number")
    return (
        F.when(v.isNull(), None)
        .when(of.startswith("OBJECT"), "object")
        .when(of.startswith("ARRAY"), "array")
        .when(of == "STRING", "string")
        .when(of == "BOOLEAN", "boolean")
        .when(of == "VOID", "null")
        .when(of == "BIGINT", "integer")
        .otherwise(number)
    )


def member(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$[{_quoted(key)}]", "variant")


def _quoted(key: str) -> str:
    if "'" not in key:
        return f"'{key}'"
    if '"' not in key:
        return f'"{key}"'
    raise SchemaRequestError("a key with both kinds of quotes is not supported")


class SchemaPlan:
    """A schema and the places in it that calls lead to, the root first: (schema, resources passed)."""

    #: References to one schema within an expression, and how many expressions may come of them.
    DEPTH, SIZE = 4, 32

    def __init__(self, schema: dict, depth: int | None = None) -> None:
        self.graph = SchemaGraph(schema)
        self.targets: list[tuple[object, tuple[str, ...]]] = [(schema, self.graph.enter(schema, ()))]
        self.recursive = self.graph.recursive(schema)
        self.conditional = False
        self.compiled: tuple[Column, Column] | None = None
        branches = self.graph.branching() if self.recursive else 0
        self.depth = depth or next((d for d in range(self.DEPTH, 1, -1) if branches**d <= self.SIZE), 1)

    def target(self, schema: object, scope: tuple[str, ...]) -> int:
        found = next((i for i, (x, s) in enumerate(self.targets) if x is schema and s == scope), None)
        if found is None:
            self.targets.append((schema, scope))
            found = len(self.targets) - 1
        return found


class Compiler:
    """Errors of a value as an expression; of a call, whether its key is among ``bad``."""

    TYPE = ERROR

    def __init__(self, plan: SchemaPlan, start: Column | None = None, bad: Column | None = None) -> None:
        self.plan, self.graph = plan, plan.graph
        self.start, self.bad = start, bad
        self.scope: tuple[str, ...] = ()
        self.open: tuple[int, ...] = ()
        self.here: tuple[int, ...] = ()
        self.strict = True

    def entry(self, target: int, v: Column | None = None, path: Column | None = None) -> Column:
        """The expression of one of the plan's places."""
        schema, self.scope = self.plan.targets[target]
        self.open = self.here = (id(schema),)
        return self.errors(F.lit(None).cast("variant") if v is None else v, schema, F.lit("$") if path is None else path, ())

    @property
    def none(self) -> Column:
        return F.array().cast(self.TYPE)

    def joined(self, parts) -> Column:
        return F.concat(self.none, *parts)

    def idle(self, schema: object) -> bool:
        """Whether nothing can come of a schema."""
        return schema is True or schema == {}

    def errors(self, v: Column, schema: dict | bool, path: Column, at: tuple[str, ...]) -> Column:
        """All errors of ``v`` (null: absent, no error) as one array."""
        if self.idle(schema):
            return self.none
        if schema is False:
            return self.error(v.isNotNull(), path, at, "false schema", "no value is allowed")
        scope, self.scope = self.scope, self.graph.enter(schema, self.scope)
        parts = []
        for word in sorted(schema):
            method = getattr(self, "on_" + word.lstrip("$").lower(), None) if word in CHECKED else None
            if method is not None:
                parts.append(method(v, schema[word], schema, path, (*at, word)))
        self.scope = scope
        return self.joined(parts)

    def child(self, v: Column, schema: dict | bool, path: Column, at: tuple[str, ...]) -> Column:
        """``errors`` of a value inside the present one."""
        here, self.here = self.here, ()
        try:
            return self.errors(v, schema, path, at)
        finally:
            self.here = here

    def within(self, v: Column, schema: dict | bool, path: Column, at: tuple[str, ...]) -> Column:
        """``child`` with ``v``, a part that is cut out of a variant, made once, however often it is looked at."""
        return F.element_at(F.transform(F.array(v), lambda x: self.child(x, schema, path, at)), 1)

    def place(self, at: tuple[str, ...]) -> Column:
        return F.lit(schema_path(at)) if self.start is None else F.concat(self.start, F.lit(schema_path(at)[1:]))

    def error(self, wrong: Column, path: Column, at: tuple[str, ...], validator: str | Column, message: str | Column) -> Column:
        column = lambda x: F.lit(x) if isinstance(x, str) else x
        one = F.struct(path.alias("path"), self.place(at).alias("schema_path"), column(validator).alias("validator"), column(message).alias("message"))
        return F.when(F.coalesce(wrong, F.lit(False)), F.array(one).cast(ERROR)).otherwise(self.none)

    def valid(self, v: Column, schema: dict | bool, path: Column, at: tuple[str, ...], inside: bool = False) -> Column:
        """Whether ``v`` fits; calls in there are decided by their keys."""
        strict, self.strict = self.strict, False
        try:
            return F.size((self.child if inside else self.errors)(v, schema, path, at)) == 0
        finally:
            self.strict = strict

    def call(self, v: Column, schema: object, path: Column, at: tuple[str, ...]) -> Column:
        if self.strict:
            return self.none  # its errors are rows of their own
        self.plan.conditional = True
        key = F.concat(F.lit(f"{self.plan.target(schema, self.graph.enter(schema, self.scope))}|"), path)
        return self.error(v.isNotNull() & F.array_contains(F.lit(None).cast("array<string>") if self.bad is None else self.bad, key), path, at, "$ref", "must fit the schema")

    def followed(self, target: object, use: Callable[[object], Column]) -> Column:
        """``use`` of a reference's target, unless it leads back to itself without any value between."""
        if id(target) in self.here:
            raise SchemaRequestError("a schema refers to itself about the same value")
        kept = self.open, self.here
        self.open, self.here = (*self.open, id(target)), (*self.here, id(target))
        try:
            return use(target)
        finally:
            self.open, self.here = kept

    def referred(self, v, target, path, at):
        if self.plan.recursive and self.open.count(id(target)) >= self.plan.depth and self.graph.recursive(target):
            return self.call(v, target, path, at)
        return self.followed(target, lambda t: self.errors(v, t, path, at))

    # types and values
    def on_type(self, v, wanted, schema, path, at):
        names = [wanted] if isinstance(wanted, str) else wanted
        allowed = set(names) | ({"integer"} if "number" in names else set())
        return self.error(~kind(v).isin(*sorted(allowed)), path, at, "type", f"must be of type {' or '.join(names)}")

    def same(self, v: Column, value: object) -> Column:
        """Whether ``v`` equals a JSON value; numbers by value, members in any order."""
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return self.compared(v, value, operator.eq)
        return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value, ensure_ascii=False))))

    def on_enum(self, v, values, schema, path, at):
        found = reduce(or_, (F.coalesce(self.same(v, x), F.lit(False)) for x in values), F.lit(False))
        return self.error(v.isNotNull() & ~found, path, at, "enum", "must be one of the listed values")

    def on_const(self, v, value, schema, path, at):
        return self.error(v.isNotNull() & ~F.coalesce(self.same(v, value), F.lit(False)), path, at, "const", "must be the given value")

    # numbers
    def number(self, v: Column) -> Column:
        return F.when(kind(v).isin("integer", "number"), F.try_variant_get(v, "$", "double"))

    def whole(self, v: Column) -> Column:
        """A whole number of up to 38 digits, exactly."""
        return F.when(kind(v) == "integer", F.try_variant_get(v, "$", "decimal(38,0)"))

    def compared(self, v: Column, x: int | float, op: Callable) -> Column:
        """``op`` of a number and a limit: exactly if both are whole, else as doubles; null for no number."""
        plain = op(self.number(v), F.lit(float(x)))
        return F.coalesce(op(self.whole(v), F.lit(Decimal(int(x)))), plain) if x == int(x) and abs(x) < 10**38 else plain

    def on_minimum(self, v, x, schema, path, at):
        return self.error(self.compared(v, x, operator.lt), path, at, "minimum", f"must be at least {x}")

    def on_maximum(self, v, x, schema, path, at):
        return self.error(self.compared(v, x, operator.gt), path, at, "maximum", f"must be at most {x}")

    def on_exclusiveminimum(self, v, x, schema, path, at):
        return self.error(self.compared(v, x, operator.le), path, at, "exclusiveMinimum", f"must be more than {x}")

    def on_exclusivemaximum(self, v, x, schema, path, at):
        return self.error(self.compared(v, x, operator.ge), path, at, "exclusiveMaximum", f"must be less than {x}")

    def on_multipleof(self, v, x, schema, path, at):
        share = self.number(v) / F.lit(float(x))
        uneven = F.abs(share - F.round(share)) > 1e-9
        if x == int(x) and x < 10**38:
            uneven = F.coalesce(self.whole(v) % F.lit(Decimal(int(x))) != 0, uneven)
        return self.error(uneven, path, at, "multipleOf", f"must be a multiple of {x}")

    # strings
    def string(self, v: Column) -> Column:
        return F.when(kind(v) == "string", F.try_variant_get(v, "$", "string"))

    def on_minlength(self, v, n, schema, path, at):
        return self.error(F.length(self.string(v)) < n, path, at, "minLength", f"must have {n} characters or more")

    def on_maxlength(self, v, n, schema, path, at):
        return self.error(F.length(self.string(v)) > n, path, at, "maxLength", f"must have {n} characters or fewer")

    def on_pattern(self, v, pattern, schema, path, at):
        return self.error(~self.string(v).rlike(java_regex(pattern)), path, at, "pattern", "must match the pattern")

    # arrays
    def items(self, v: Column) -> Column:
        return F.when(kind(v) == "array", v.cast("array<variant>"))

    def each(self, found: Column | None) -> Column:
        return F.coalesce(F.flatten(found), self.none)

    def on_items(self, v, sub, schema, path, at):
        if self.idle(sub):
            return self.none
        after = len(schema.get("prefixItems", ()))
        rest = F.slice(self.items(v), after + 1, F.greatest(F.size(self.items(v)) - after, F.lit(0))) if after else self.items(v)
        return self.each(F.transform(rest, lambda x, i: self.child(x, sub, instance_path(path, index=i + after), at)))

    def on_prefixitems(self, v, subs, schema, path, at):
        return self.joined(self.within(F.get(self.items(v), F.lit(k)), s, instance_path(path, index=F.lit(k)), (*at, str(k))) for k, s in enumerate(subs) if not self.idle(s))

    def on_minitems(self, v, n, schema, path, at):
        return self.error(F.size(self.items(v)) < n, path, at, "minItems", f"must have {n} items or more")

    def on_maxitems(self, v, n, schema, path, at):
        return self.error(F.size(self.items(v)) > n, path, at, "maxItems", f"must have {n} items or fewer")

    def on_uniqueitems(self, v, wanted, schema, path, at):
        written = F.transform(self.items(v), lambda x: F.to_json(x))  # noqa: PLW0108  to_json has a second parameter
        return self.error((F.size(F.array_distinct(written)) < F.size(written)) if wanted else F.lit(False), path, at, "uniqueItems", "items must differ")

    def fitting(self, v, sub, path, at) -> Column:
        """Indices of the items that fit."""
        fits = F.transform(self.items(v), lambda x, i: F.when(self.valid(x, sub, instance_path(path, index=i), at, inside=True), i))
        return F.array_compact(fits)

    def on_contains(self, v, sub, schema, path, at):
        n = F.size(self.fitting(v, sub, path, at))
        low, high = schema.get("minContains", 1), schema.get("maxContains")
        many = n > high if high is not None else F.lit(False)
        validator = F.when(many, "maxContains").when(n > 0, "minContains").otherwise("contains")
        return self.error((n < low) | many, path, at, validator, "has too few or too many fitting items")

    # objects
    def keys(self, v: Column) -> Column:
        return F.when(kind(v) == "object", F.map_keys(v.cast("map<string,variant>")))

    def on_properties(self, v, subs, schema, path, at):
        return self.joined(self.within(member(v, k), s, instance_path(path, k), (*at, k)) for k, s in subs.items() if not self.idle(s))

    def on_required(self, v, names, schema, path, at):
        return self.joined(self.error(~F.array_contains(self.keys(v), k), path, at, "required", f"{json.dumps(k)} is required") for k in names)

    def additional(self, v, schema) -> Column:
        """The members that neither a name nor a pattern of the schema covers."""
        named = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
        patterns = [java_regex(p) for p in schema.get("patternProperties", {})]
        return F.filter(F.array_except(self.keys(v), named), lambda k: reduce(and_, (~k.rlike(p) for p in patterns), F.lit(True)))

    def on_additionalproperties(self, v, sub, schema, path, at):
        if self.idle(sub):
            return self.none
        extra = self.additional(v, schema)
        if sub is False:
            return self.error(F.size(extra) > 0, path, at, "additionalProperties", F.concat(F.lit("not allowed: "), F.array_join(F.array_sort(extra), ", ")))
        values = F.map_filter(F.when(kind(v) == "object", v.cast("map<string,variant>")), lambda k, _: F.array_contains(extra, k))
        return self.each(F.transform(F.map_entries(values), lambda e: self.child(e["value"], sub, instance_path(path, e["key"]), at)))

    def on_patternproperties(self, v, subs, schema, path, at):
        entries = F.map_entries(F.when(kind(v) == "object", v.cast("map<string,variant>")))
        of = lambda p, s: self.each(F.transform(F.filter(entries, lambda e: e["key"].rlike(java_regex(p))), lambda e: self.child(e["value"], s, instance_path(path, e["key"]), (*at, p))))
        return self.joined(of(p, s) for p, s in subs.items() if not self.idle(s))

    def on_propertynames(self, v, sub, schema, path, at):
        if self.plan.recursive and self.graph.recursive(sub):
            raise SchemaRequestError(f"{schema_path(at)} is recursive")
        name = lambda k: F.to_json(F.struct(k.alias("k")))
        return self.each(F.transform(self.keys(v), lambda k: self.child(F.try_variant_get(F.parse_json(name(k)), "$.k", "variant"), sub, path, at)))

    def on_minproperties(self, v, n, schema, path, at):
        return self.error(F.size(self.keys(v)) < n, path, at, "minProperties", f"must have {n} members or more")

    def on_maxproperties(self, v, n, schema, path, at):
        return self.error(F.size(self.keys(v)) > n, path, at, "maxProperties", f"must have {n} members or fewer")

    def has(self, v: Column, key: str) -> Column:
        return F.array_contains(self.keys(v), key)

    def on_dependentrequired(self, v, rules, schema, path, at):
        return self.joined(self.error(self.has(v, k) & ~self.has(v, n), path, at, "dependentRequired", f"{json.dumps(n)} is required beside {json.dumps(k)}") for k, names in rules.items() for n in names)

    def on_dependentschemas(self, v, subs, schema, path, at):
        return self.joined(F.when(self.has(v, k), self.errors(v, s, path, (*at, k))).otherwise(self.none) for k, s in subs.items() if not self.idle(s))

    # combinations
    def on_allof(self, v, subs, schema, path, at):
        return self.joined(self.errors(v, s, path, (*at, str(k))) for k, s in enumerate(subs))

    def on_anyof(self, v, subs, schema, path, at):
        fits = reduce(or_, (self.valid(v, s, path, (*at, str(k))) for k, s in enumerate(subs)))
        return self.error(v.isNotNull() & ~fits, path, at, "anyOf", "fits none of the schemas")

    def on_oneof(self, v, subs, schema, path, at):
        fits = reduce(lambda a, b: a + b, (self.valid(v, s, path, (*at, str(k))).cast("int") for k, s in enumerate(subs)))
        return self.error(v.isNotNull() & (fits != 1), path, at, "oneOf", "must fit exactly one of the schemas")

    def on_not(self, v, sub, schema, path, at):
        return self.error(v.isNotNull() & self.valid(v, sub, path, at), path, at, "not", "must not fit the schema")

    def on_if(self, v, sub, schema, path, at):
        branch = lambda word: self.errors(v, schema.get(word, True), path, (*at[:-1], word))
        return F.when(self.valid(v, sub, path, at), branch("then")).otherwise(branch("else"))

    def on_ref(self, v, ref, schema, path, at):
        return self.referred(v, self.graph.resolve(schema, ref), path, at[:-1])

    def on_dynamicref(self, v, ref, schema, path, at):
        return self.referred(v, self.graph.resolve_dynamic(schema, ref, self.scope), path, at[:-1])

    # what subschemas have looked at
    def evaluated(self, v: Column, schema: object, path: Column, at: tuple[str, ...], names: bool, top: bool = False) -> Column:
        """Names of members (or indices of items) that a schema, or one applied to the same value by it, evaluates."""
        kind_of = "array<string>" if names else "array<int>"
        none = F.array().cast(kind_of)
        if not isinstance(schema, dict):
            return none
        scope, self.scope = self.scope, self.graph.enter(schema, self.scope)
        whole = self.keys(v) if names else F.when(F.size(self.items(v)) > 0, F.sequence(F.lit(0), F.size(self.items(v)) - 1)).when(F.size(self.items(v)) == 0, none)
        within = lambda s, word: self.evaluated(v, s, path, (*at, word), names)
        fits = lambda s, word: self.valid(v, s, path, (*at, word))
        found = []
        rest = "unevaluatedProperties" if names else "unevaluatedItems"
        if (not top and rest in schema) or (names and "additionalProperties" in schema) or (not names and "items" in schema):
            found.append(whole)
        elif names:
            found.append(F.array_intersect(whole, F.array(*map(F.lit, schema.get("properties", {}))).cast(kind_of)))
            matching = lambda p: F.filter(whole, lambda k: k.rlike(java_regex(p)))
            found += map(matching, schema.get("patternProperties", {}))
        else:
            found.append(F.filter(whole, lambda i: i < len(schema.get("prefixItems", ()))))
        if not names and "contains" in schema:
            found.append(self.fitting(v, schema["contains"], path, (*at, "contains")))
        for word in ("allOf", "anyOf", "oneOf"):
            found += [F.when(fits(s, word), within(s, word)) for s in schema.get(word, ())]
        if "if" in schema:
            yes = F.array_union(within(schema["if"], "if"), within(schema.get("then"), "then"))
            found.append(F.when(fits(schema["if"], "if"), yes).otherwise(within(schema.get("else"), "else")))
        found += [F.when(self.has(v, k), within(s, k)) for k, s in schema.get("dependentSchemas", {}).items()]
        if "$ref" in schema:
            found.append(self.followed(self.graph.resolve(schema, schema["$ref"]), lambda t: within(t, "$ref")))
        if "$dynamicRef" in schema:
            found.append(self.followed(self.graph.resolve_dynamic(schema, schema["$dynamicRef"], self.scope), lambda t: within(t, "$dynamicRef")))
        self.scope = scope
        return F.array_distinct(F.flatten(F.array(*(F.coalesce(x, none) for x in found))))

    def on_unevaluatedproperties(self, v, sub, schema, path, at):
        if sub is True:
            return self.none
        left = F.array_except(self.keys(v), self.evaluated(v, schema, path, at, names=True, top=True))
        values = F.map_filter(F.when(kind(v) == "object", v.cast("map<string,variant>")), lambda k, _: F.array_contains(left, k))
        bad = F.filter(F.map_entries(values), lambda e: ~self.valid(e["value"], sub, instance_path(path, e["key"]), at, inside=True))
        return self.error(F.size(left if sub is False else bad) > 0, path, at, "unevaluatedProperties", "has members that no schema allows")

    def on_unevaluateditems(self, v, sub, schema, path, at):
        if sub is True:
            return self.none
        seen = self.evaluated(v, schema, path, at, names=False, top=True)
        bad = F.transform(self.items(v), lambda x, i: ~F.array_contains(seen, i) & ~self.valid(x, sub, instance_path(path, index=i), at, inside=True))
        return self.error(F.exists(bad, lambda x: x), path, at, "unevaluatedItems", "has items that no schema allows")


def json_errors(payload: Column, request: SchemaRequest) -> Column:
    """Sorted errors of a payload column of JSON text; null where the text is no JSON. For schemas without recursion."""
    plan = request.plan or SchemaPlan(request.schema)
    if plan.recursive:
        raise SchemaRequestError("the schema refers to itself: use validate_json")
    v = F.try_parse_json(payload)
    made = lambda x: F.array_sort(Compiler(plan).entry(0, x))
    return F.when(v.isNotNull(), F.element_at(F.transform(F.array(v), made), 1))


def with_json_errors(df: DataFrame, payload: Column, request: SchemaRequest, name: str) -> DataFrame:
    """Add the sorted errors of a column of JSON text as the column ``name``; null where the text is no JSON."""
    plan = request.plan or SchemaPlan(request.schema)
    if not plan.recursive:
        return df.withColumn(name, json_errors(payload, request))
    from ledgerleaf.operators.recursion import validated

    return validated(df, payload, plan, name)


def validate_json(df: DataFrame, column: str, request: SchemaRequest) -> DataFrame:
    """Add ``schema_errors`` (null where the text is no JSON) and ``schema_valid``; the payload is untouched."""
    df = with_json_errors(df, F.col(column), request, "schema_errors")
    return df.withColumn("schema_valid", F.coalesce(F.size("schema_errors") == 0, F.lit(False)))


def schema_error_summary(df: DataFrame) -> DataFrame:
    """How often each validator fails at each place; array indices count as one place."""
    errors = exploded(df, "schema_errors", "_at", "e")
    place = F.regexp_replace("e.path", r"\[[0-9]+\]", "[]")
    return errors.groupBy(place.alias("path"), F.col("e.validator").alias("validator")).agg(F.count(F.lit(1)).alias("n"))


def declared_names(schema: object) -> set[str]:
    """The member names that a schema's ``properties`` declare, anywhere in it."""
    if isinstance(schema, list):
        return set().union(*map(declared_names, schema))
    if not isinstance(schema, dict):
        return set()
    own = schema.get("properties")
    return (set(own) if isinstance(own, dict) else set()).union(*map(declared_names, schema.values()))


def declared_place(path: Column, names: set[str]) -> Column:
    """A path without what the data put into it: an index becomes [], a member of no declared name ["*"]."""
    steps = F.regexp_extract_all(path, F.lit(STEP), 0)
    kept = ["$", *sorted(f"[{json.dumps(n, ensure_ascii=False)}]" for n in names)]
    step = lambda x: F.when(x.rlike(r"^\[[0-9]+\]$"), "[]").when(x.isin(kept), x).otherwise('["*"]')
    return F.array_join(F.transform(steps, step), "")


def schema_error_hotspots(df: DataFrame, request: SchemaRequest, most: int = 10, tracked: int = 10_000) -> DataFrame:
    """How often each validator fails at each declared place, and the real paths that fail most there.

    Members that the schema does not name put data into paths, so paths grow with the data; places do not, unless the
    schema is recursive. ``n`` is exact. ``frequent`` (path, n; of equal counts the least path first) holds the ``most``
    most frequent paths of a place, exactly: paths are counted by an aggregate dealt by path, and the first of each place
    are chosen before they meet. ``n_error`` bounds the error of these counts: what a sketch of ``tracked`` paths a place
    would be wrong by at most. Null or no errors count nowhere.
    """
    if not 1 <= most <= tracked <= 1_000_000:
        raise ValueError("1 <= most <= tracked <= 1000000 must hold")
    errors = exploded(df, "schema_errors", "_at", "e")
    each = errors.groupBy(F.col("e.path").alias("real"), F.col("e.validator").alias("validator")).agg(F.count(F.lit(1)).alias("n"))
    each = each.withColumn("path", declared_place(F.col("real"), declared_names(request.schema)))
    counted = each.groupBy("path", "validator").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("path", "validator").orderBy(F.desc("n"), "real")
    chosen = each.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
    listed = chosen.groupBy("path", "validator").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("real").alias("path"), "n"))).alias("all"))
    frequent = F.transform("all", lambda x: F.struct(x["path"].alias("path"), x["n"].alias("n")))
    # A sketch has room for the next power of two above tracked / 0.75, and errs by 3.5 parts in so many.
    room = 1 << math.ceil(math.log2(tracked / 0.75))
    error = F.when(F.col("n") <= tracked, 0).otherwise(F.ceil(F.col("n") * 3.5 / room)).cast("bigint")
    return counted.join(listed, ["path", "validator"]).select("path", "validator", "n", error.alias("n_error"), frequent.alias("frequent"))


def is_text_identifier(c: Column) -> Column:
    """Whether a name is already normal: not blank, one line, nothing to strip."""
    return ~text.is_blank(c) & ~text.has_inner_break(c) & c.eqNullSafe(text.clean_text(c))
