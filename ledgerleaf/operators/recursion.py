"""Validation against schemas that refer to themselves, as a frontier advanced until it is empty.

Of each row the compiled expression gives the calls that it has no room for: (schema, path, value). They are the rows
of the next level, validated in the same way, so the number of rounds is the depth of the deepest value, divided by how
often an expression follows a reference, whatever the number of rows, and no row is ever walked by a program. Where a
call decides a condition (``anyOf``, ``not``, ``contains`` and the like), levels are gone through once more from the
deepest up, and each row learns which of its calls failed.

Levels are written to the shared folder: a lost executor costs the tasks at hand. The rows validated are written first,
as they get numbers that have to last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.operators.jsonschema import ERROR, Compiler, SchemaPlan
from ledgerleaf.operators.schema_graph import SchemaRequestError
from ledgerleaf.sources.scratch import new_folder

#: How rows meet what was found of them. Spark takes errors for as small as the compressed levels that they are made of,
#: and would broadcast them, though they grow with the data.
SORTED = "merge"
CALL = "array<struct<target:int,path:string,at:string,strict:boolean,value:variant>>"


class Caller(Compiler):
    """The calls of a value as an expression."""

    TYPE = CALL

    def idle(self, schema):
        return not self.graph.recursive(schema)

    def error(self, wrong, path, at, validator, message):
        return self.none

    def call(self, v, schema, path, at):
        target = self.plan.target(schema, self.graph.enter(schema, self.scope))
        one = F.struct(F.lit(target).alias("target"), path.alias("path"), self.place(at if self.strict else ()).alias("at"), F.lit(self.strict).alias("strict"), v.alias("value"))
        return F.when(v.isNotNull(), F.array(one).cast(CALL)).otherwise(self.none)

    def loosely(self, made) -> Column:
        """What ``made`` gives, with calls that decide a condition."""
        strict, self.strict = self.strict, False
        try:
            return self.joined(made())
        finally:
            self.strict = strict

    def on_anyof(self, v, subs, schema, path, at):
        return self.loosely(lambda: [self.errors(v, s, path, at) for s in subs if not self.idle(s)])

    on_oneof = on_anyof

    def on_not(self, v, sub, schema, path, at):
        return self.on_anyof(v, [sub], schema, path, at)

    def on_contains(self, v, sub, schema, path, at):
        return self.loosely(lambda: [self.on_items(v, sub, {}, path, at)])

    def on_propertynames(self, v, sub, schema, path, at):
        return self.none

    def on_if(self, v, sub, schema, path, at):
        branches = {w: schema[w] for w in ("then", "else") if w in schema and not self.idle(schema[w])}
        asked = self.on_anyof(v, [sub], schema, path, at)
        if not branches:
            return asked
        if not self.idle(sub):
            raise SchemaRequestError("an 'if' that refers to itself can't choose between branches that do")
        fits = Compiler(self.plan, self.start).valid(v, sub, path, at)
        chosen = lambda w: self.errors(v, branches[w], path, (*at[:-1], w)) if w in branches else self.none
        return F.when(fits, chosen("then")).otherwise(chosen("else"))

    def on_unevaluatedproperties(self, v, sub, schema, path, at):
        return self.loosely(lambda: [self.on_additionalproperties(v, sub, {}, path, at)])

    def on_unevaluateditems(self, v, sub, schema, path, at):
        return self.loosely(lambda: [self.on_items(v, sub, {}, path, at)])


def compiled(plan: SchemaPlan) -> tuple[Column, Column]:
    """(errors, calls) of a row (target, path, at, value, bad), whatever its target."""
    if plan.compiled:
        return plan.compiled
    value, path, at, bad = (F.col(c) for c in ("value", "path", "at", "bad"))
    cases: list[tuple[Column, Column]] = []
    while len(cases) < len(plan.targets):
        k = len(cases)
        # Within a lambda expressions are interpreted; as generated code they may be too large for a method.
        within = lambda made, k=k: F.element_at(F.transform(F.array(value), lambda v: made.entry(k, v, path)), 1)
        cases.append((within(Compiler(plan, at, bad)), within(Caller(plan, at))))
    chosen = lambda n: reduce(lambda rest, k: F.when(F.col("target") == k, cases[k][n]).otherwise(rest), reversed(range(len(cases) - 1)), cases[-1][n])
    plan.compiled = chosen(0), chosen(1)
    return plan.compiled


def _saved(df: DataFrame, uri: str) -> DataFrame:
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def frontier(rows: DataFrame, plan: SchemaPlan) -> tuple[str, int]:
    """All levels of calls that begin with ``rows`` (row, value), written: their folder, and how many there are.

    A level has id, parent (an id of the level before), row, target, path, at, strict, live (reported, if in error), value.
    """
    folder = new_folder(rows.sparkSession, "levels")
    _, calls = compiled(plan)
    yes, number = F.lit(True), F.monotonically_increasing_id().alias("id")
    level = rows.select(number, F.lit(-1).cast("long").alias("parent"), "row", F.lit(0).alias("target"), F.lit("$").alias("path"), F.lit("#").alias("at"), yes.alias("strict"), yes.alias("live"), "value")
    n = 0
    while True:
        level = _saved(level, f"{folder}/level={n}")
        n += 1
        if level.isEmpty():
            return folder, n - 1
        made = level.select(F.col("id").alias("parent"), "row", "live", F.explode(calls).alias("c"))
        made = made.select("parent", "row", "c.target", "c.path", "c.at", "c.strict", (F.col("live") & F.col("c.strict")).alias("live"), "c.value")
        if plan.conditional:  # a condition may ask twice
            made = made.dropDuplicates(["parent", "row", "target", "path", "at", "strict", "live"])
        level = made.select(number, *made.columns)


def row_errors(spark: SparkSession, plan: SchemaPlan, folder: str, n: int) -> DataFrame:
    """(row, errors) of the rows that have errors, unsorted, from a frontier's ``n`` levels in ``folder``."""
    errors, _ = compiled(plan)
    nothing = F.array().cast("array<string>")
    if not plan.conditional:
        found = spark.read.parquet(folder).where("live").withColumn("bad", nothing).select("row", errors.alias("errors"))
    else:
        judged = new_folder(spark, "judged")
        below = None
        for k in reversed(range(n)):
            level = spark.read.parquet(f"{folder}/level={k}")
            if below is None:
                level = level.select("*", nothing.alias("bad"), F.lit(False).alias("broken"))
            else:
                level = level.join(below.hint(SORTED), F.col("id") == F.col("of"), "left").withColumn("bad", F.coalesce("bad", nothing)).withColumn("broken", F.coalesce("broken", F.lit(False)))
            key = F.concat(F.col("target").cast("string"), F.lit("|"), F.col("path")).alias("key")
            done = _saved(level.select("row", "parent", "strict", "live", "broken", key, errors.alias("errors")), f"{judged}/level={k}")
            failed = done.where((F.size("errors") > 0) | F.col("broken"))
            below = failed.groupBy(F.col("parent").alias("of")).agg(F.collect_set(F.when(~F.col("strict"), F.col("key"))).alias("bad"), F.max("strict").alias("broken"))
        found = (spark.read.parquet(judged) if n else spark.createDataFrame([], f"row long, live boolean, errors {ERROR}")).where("live").select("row", "errors")
    return found.where(F.size("errors") > 0).groupBy("row").agg(F.flatten(F.collect_list("errors")).alias("errors"))


def validated(df: DataFrame, payload: Column, plan: SchemaPlan, name: str) -> DataFrame:
    """``df`` with the sorted errors of ``payload`` as the column ``name``; null where the text is no JSON."""
    numbered = _saved(df.withColumn("_payload", payload).withColumn("_row", F.monotonically_increasing_id()), new_folder(df.sparkSession, "rows"))
    rows = numbered.select(F.col("_row").alias("row"), F.try_parse_json("_payload").alias("value")).where("value is not null")
    found = row_errors(df.sparkSession, plan, *frontier(rows, plan)).select("row", F.array_sort("errors").alias(name))
    joined = numbered.join(found.hint(SORTED), F.col("_row") == F.col("row"), "left")
    errors = F.when(F.try_parse_json("_payload").isNotNull(), F.coalesce(name, F.array().cast(ERROR)))
    return joined.select(*df.columns, errors.alias(name))
