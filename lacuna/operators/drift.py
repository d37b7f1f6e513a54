"""Problem 2: schemas that drift between the files of a feed.

Lines are JSON objects.  The schema of each file is read from the lines in
parallel (one row per file and field, combined before the shuffle), folded
through a small type lattice, compared with the previous file of the feed, and
every difference is logged in order.  All lines are then cast to the union
schema, with renamed fields under their first name.

The lattice: null < number, string, boolean, array, object < string.  A field
that is null throughout a file keeps the type it had before; two unlike types
meet in string.

A rename is judged on values: the field that goes and the field that comes must
hold equal values on the records that both files have.  Each side is folded to
an order-free fingerprint (count and two 64-bit hash sums of record and value),
so no pairs of lines are formed and a file with a third of all lines is summed
by many tasks.

Lines are parsed twice: once for the schemas, from which all but renames follow,
and once, in files between which fields both come and go, for those fields only.

Defined results: lines that are no JSON object, and lines without a record name,
take no part in the comparison; repeated lines count once (smallest line); an
empty table gives no changes; a field that returns after an absence is
``added`` and remembers its last type; extra columns of the lines are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lacuna.session import cut

TYPE_NAMES = ["string", "number", "boolean", "array", "object"]


def promote(types: Column) -> Column:
    """Join of a set of types in the lattice: none is null, one is itself, several are string."""
    return F.when(F.size(types) == 1, types[0]).when(F.size(types) > 1, F.lit("string"))


def _json_type(variant: Column) -> Column:
    kind = F.schema_of_variant(variant)
    return (
        F.when(kind == "VOID", None)
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def _canonical(variant: Column, kind: Column) -> Column:
    """Equal text for equal JSON values: numbers by value, objects by sorted keys."""
    number = F.try_variant_get(variant, "$", "double").cast("string")
    return F.when(kind.isNull(), None).otherwise(F.concat(kind, F.lit(":"), F.when(kind == "number", number).otherwise(F.to_json(variant))))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``body`` (variant, null if the payload is no JSON object) and the record's name ``rec``."""
    body = F.try_parse_json("payload")
    parsed = lines.select(
        "line_id",
        F.coalesce("source_table", F.lit("")).alias("source_table"),
        F.coalesce("feed", F.lit("")).alias("feed"),
        F.col("file_name").alias("file_name"),
        "delivered_at",
        "line_no",
        body.alias("body"),
    ).where(F.col("file_name").isNotNull())
    is_object = F.schema_of_variant("body").startswith("OBJECT")
    parsed = parsed.withColumn("body", F.when(is_object, F.col("body")))
    return parsed.withColumn("rec", F.try_variant_get("body", "$.source_row", "string"))


def explode_fields(parsed: DataFrame) -> DataFrame:
    """One row per line and field: ``field``, ``value`` (variant), ``kind`` (null for JSON null); lines without an object give one row without a field."""
    spark = parsed.sparkSession
    cells = parsed.lateralJoin(spark.tvf.variant_explode_outer(F.col("body").outer()))
    cells = cells.withColumnRenamed("key", "field").drop("pos", "body")
    return cells.withColumn("kind", _json_type(F.col("value")))


def file_schemas(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (place ``seq`` within the feed by delivery, ``last_seq`` of the feed), and one row per file and field with its promoted type, its type carried from earlier files, and its neighbours."""
    fields = explode_fields(parsed).groupBy("feed", "file_name", "field")
    fields = cut(fields.agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.min("delivered_at").alias("delivered_at"), F.min("source_table").alias("source_table")))  # a few rows per file

    files = fields.groupBy("feed", "file_name").agg(F.min("delivered_at").alias("delivered_at"), F.min("source_table").alias("source_table"))
    order = Window.partitionBy("feed").orderBy(F.col("delivered_at").asc_nulls_first(), "file_name")
    files = files.withColumn("seq", F.row_number().over(order)).withColumn("last_seq", F.count(F.lit(1)).over(Window.partitionBy("feed")))
    files = cut(files)

    schemas = fields.where(F.col("field").isNotNull()).select("feed", "file_name", "field", promote(F.col("kinds")).alias("kind"))
    schemas = schemas.join(files, ["feed", "file_name"])
    history = Window.partitionBy("feed", "field").orderBy("seq")
    schemas = schemas.withColumn("carried", F.last("kind", ignorenulls=True).over(history.rowsBetween(Window.unboundedPreceding, 0)))
    schemas = (
        schemas.withColumn("before_seq", F.lag("seq").over(history))
        .withColumn("before_kind", F.lag("carried").over(history))
        .withColumn("after_seq", F.lead("seq").over(history))
    )
    return files, cut(schemas)


def _renames(parsed: DataFrame, files: DataFrame, comes: DataFrame, goes: DataFrame) -> DataFrame:
    new = comes.groupBy("feed", "step").agg(F.collect_list("field").alias("new_fields"))
    old = goes.groupBy("feed", "step").agg(F.collect_list("field").alias("old_fields"))
    steps = new.join(old, ["feed", "step"])
    # each file is read for the fields that came with it and for those that are gone from the next
    place = (
        files.select("feed", "file_name", "seq")
        .join(steps.select("feed", F.col("step").alias("seq"), "new_fields"), ["feed", "seq"], "left")
        .join(steps.select("feed", (F.col("step") - 1).alias("seq"), "old_fields"), ["feed", "seq"], "left")
        .where(F.col("new_fields").isNotNull() | F.col("old_fields").isNotNull())
    )
    lines = parsed.where(F.col("rec").isNotNull()).join(cut(place), ["feed", "file_name"])
    cells = explode_fields(lines)
    named = lambda side, step, names: F.when(names.isNotNull() & (F.array_contains(names, F.col("field")) | (F.col("field") == "source_row")), F.struct(F.lit(side).alias("side"), step.alias("step")))
    sides = F.array(named("new", F.col("seq"), F.col("new_fields")), named("old", F.col("seq") + 1, F.col("old_fields")))
    text = _canonical(F.col("value"), F.col("kind"))
    cells = cells.select("feed", "rec", "line_no", "line_id", "field", F.when(F.col("field") != "source_row", text).alias("text"), F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("_s"))
    cells = cells.select("feed", "_s.step", "_s.side", "rec", "field", F.struct("line_no", "line_id", F.xxhash64("rec", "text").alias("h1"), F.xxhash64("text", F.lit("\u0001"), "rec").alias("h2"), F.col("text").isNotNull().alias("given")).alias("v"))
    once = cells.groupBy("feed", "step", "rec", "side", "field").agg(F.min("v").alias("v"))
    # the row of source_row says that the record is in the file
    shared = once.groupBy("feed", "step", "rec").agg(
        F.countDistinct(F.when(F.col("field") == "source_row", F.col("side"))).alias("_files"),
        F.collect_list(F.when((F.col("field") != "source_row") & F.col("v.given"), F.struct("side", "field", "v.h1", "v.h2"))).alias("_cells"),
    )
    shared = shared.where(F.col("_files") == 2).select("feed", "step", F.explode("_cells").alias("c"))
    wide = "decimal(38,0)"
    prints = shared.groupBy("feed", "step", F.col("c.side").alias("side"), F.col("c.field").alias("field")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c.h1").cast(wide)).alias("h1"), F.sum(F.col("c.h2").cast(wide)).alias("h2")
    )
    pairs = prints.groupBy("feed", "step", "n", "h1", "h2").agg(F.collect_set(F.when(F.col("side") == "old", F.col("field"))).alias("o"), F.collect_set(F.when(F.col("side") == "new", F.col("field"))).alias("w"))
    return pairs.select("feed", "step", F.explode("o").alias("old_field"), "w").select("feed", "step", "old_field", F.explode("w").alias("new_field"))


def schema_changes(lines: DataFrame) -> DataFrame:
    """Log of differences: feed, source_table, seq, file_name, change_kind, old_field, new_field, old_type, new_type."""
    parsed = parse_lines(lines)
    return _changes(parsed, *file_schemas(parsed))


def _changes(parsed: DataFrame, files: DataFrame, schemas: DataFrame) -> DataFrame:
    comes = schemas.where((F.col("seq") > 1) & (F.col("before_seq").isNull() | (F.col("before_seq") < F.col("seq") - 1)))
    comes = comes.select("feed", "field", F.col("seq").alias("step"))
    goes = schemas.where((F.col("seq") < F.col("last_seq")) & (F.col("after_seq").isNull() | (F.col("after_seq") > F.col("seq") + 1)))
    goes = goes.select("feed", "field", (F.col("seq") + 1).alias("step"))
    renamed = cut(_renames(parsed, files, comes, goes))

    kept = (F.col("before_seq") == F.col("seq") - 1) & F.col("before_kind").isNotNull() & (F.col("before_kind") != F.col("carried"))
    retyped = schemas.where(kept).select(
        "feed", F.col("seq").alias("step"), F.lit("retyped").alias("change_kind"), F.col("field").alias("old_field"), F.col("field").alias("new_field"),
        F.col("before_kind").alias("old_type"), F.col("carried").alias("new_type"),
    )
    no_type = F.lit(None).cast("string")
    lone_new = comes.join(renamed.select("feed", "step", F.col("new_field").alias("field")), ["feed", "step", "field"], "left_anti")
    lone_old = goes.join(renamed.select("feed", "step", F.col("old_field").alias("field")), ["feed", "step", "field"], "left_anti")
    parts = [
        retyped,
        renamed.select("feed", "step", F.lit("renamed").alias("change_kind"), "old_field", "new_field", no_type.alias("old_type"), no_type.alias("new_type")),
        lone_new.select("feed", "step", F.lit("added").alias("change_kind"), F.lit("").alias("old_field"), F.col("field").alias("new_field"), no_type.alias("old_type"), no_type.alias("new_type")),
        lone_old.select("feed", "step", F.lit("removed").alias("change_kind"), F.col("field").alias("old_field"), F.lit("").alias("new_field"), no_type.alias("old_type"), no_type.alias("new_type")),
    ]
    log = reduce(DataFrame.unionByName, parts)
    names = files.select("feed", F.col("seq").alias("step"), "file_name", "source_table", "delivered_at")
    return log.join(names, ["feed", "step"]).withColumnRenamed("step", "seq")


def first_names(changes: DataFrame) -> DataFrame:
    """For each rename, the first name of the chain: feed, seq (from this file on), field, first_name.

    A chain is followed backwards inside the feed's own log; the log holds a few
    rows per file, never lines.
    """
    renames = changes.where(F.col("change_kind") == "renamed").select("feed", "seq", "old_field", "new_field")

    def follow(log):
        log = log.sort_values(["seq", "old_field", "new_field"])
        root, rows = {}, []
        for feed, seq, old, new in log[["feed", "seq", "old_field", "new_field"]].itertuples(index=False):
            root[new] = root.get(old, old)
            rows.append((feed, seq, new, root[new]))
        out = log.iloc[:0][["feed", "seq"]].assign(field="", first_name="")
        return out if not rows else type(log)(rows, columns=["feed", "seq", "field", "first_name"])

    return renames.groupBy("feed").applyInPandas(follow, "feed string, seq int, field string, first_name string")


def _first_name_of_fields(changes: DataFrame, schemas: DataFrame) -> DataFrame:
    """feed, file_name, source_table, field, first_name, kind of every field of every file."""
    names = first_names(changes)
    spans = names.withColumn("next_seq", F.lead("seq").over(Window.partitionBy("feed", "field").orderBy("seq")))
    spans = spans.select("feed", "field", F.col("seq").alias("from_seq"), "next_seq", "first_name")
    inside = (F.col("seq") >= F.col("from_seq")) & (F.col("next_seq").isNull() | (F.col("seq") < F.col("next_seq")))
    named = schemas.select("feed", "seq", "field").join(spans, ["feed", "field"]).where(inside).select("feed", "seq", "field", "first_name")
    every = schemas.join(named, ["feed", "seq", "field"], "left")
    return every.select("feed", "file_name", "source_table", "field", F.coalesce("first_name", "field").alias("first_name"), "kind")


def _union_kinds(named: DataFrame) -> DataFrame:
    """source_table, field (first name), union_kind: the lattice join over all files of the source table."""
    kinds = named.groupBy("source_table", F.col("first_name").alias("field")).agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    return kinds.select("source_table", "field", promote(F.col("kinds")).alias("union_kind"))


def consistent_cells(lines: DataFrame) -> DataFrame:
    """All fields of all lines in one schema: line_id, source_table, feed, file_name, source_row, field (first name), kind, value (text), union_kind.

    ``union_kind`` is the lattice join over all files of the source table; values are
    text (JSON text for arrays and objects), which every type of the lattice can be cast to.
    """
    parsed = parse_lines(lines)
    files, schemas = file_schemas(parsed)
    named = cut(_first_name_of_fields(_changes(parsed, files, schemas), schemas))
    union = cut(_union_kinds(named))
    cells = explode_fields(parsed).where(F.col("field").isNotNull())
    cells = cells.join(named.select("feed", "file_name", "field", "first_name"), ["feed", "file_name", "field"])
    text = F.when(F.col("kind").isNotNull(), F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value")))
    cells = cells.select("line_id", "source_table", "feed", "file_name", F.col("rec").alias("source_row"), F.col("first_name").alias("field"), "kind", text.alias("value"))
    return cells.join(union, ["source_table", "field"])


_SPARK_TYPES = {"number": "double", "boolean": "boolean"}


def consistent_table(lines: DataFrame, source_table: str) -> DataFrame:
    """All lines of one source as one table: line_id, feed, file_name, and every field under its first name, cast to its union type.

    Numbers are doubles, flags booleans, all else text (JSON text for arrays and objects, and where unlike types meet).
    Only the union schema reaches the driver; lines are not shuffled, each reads its file's names.  Fields that differ
    from line_id, feed and file_name or from each other in case alone keep their name with ``_field`` behind it.
    """
    parsed = parse_lines(lines)
    files, schemas = file_schemas(parsed)
    named = cut(_first_name_of_fields(_changes(parsed, files, schemas), schemas).where(F.col("source_table") == source_table))
    kinds = {r["field"]: r["union_kind"] for r in _union_kinds(named).collect()}  # a row per column of the table
    spellings: dict[str, list[str]] = {}
    for r in named.select("first_name", "field").distinct().orderBy("first_name", "field").collect():  # a row per column and name
        spellings.setdefault(r["first_name"], []).append(r["field"])
    maps = named.groupBy("feed", "file_name").agg(F.map_from_entries(F.collect_list(F.struct("field", "first_name"))).alias("_names"))
    rows = parsed.where(F.col("source_table") == source_table).join(maps, ["feed", "file_name"], "left")
    columns, taken = [], {"line_id", "feed", "file_name"}
    for first in sorted(kinds):
        kind = _SPARK_TYPES.get(kinds[first], "string")
        values = []
        for name in spellings[first]:
            quote = "'" if "'" not in name else '"'
            if quote in name:  # no path names it, so it is read as text
                got = F.try_element_at(F.from_json(F.to_json("body"), "map<string,string>"), F.lit(name))
                values.append(F.when(F.try_element_at("_names", F.lit(name)) == first, got.try_cast(kind)))
                continue
            path = f"$[{quote}{name}{quote}]"
            got = F.try_variant_get("body", path, kind)
            if kind == "string":
                whole = F.try_variant_get("body", path, "variant")
                got = F.when(~F.is_variant_null(whole), F.coalesce(got, F.to_json(whole)))
            values.append(F.when(F.try_element_at("_names", F.lit(name)) == first, got))
        alias = first
        while alias.lower() in taken:
            alias += "_field"
        taken.add(alias.lower())
        columns.append(F.coalesce(*values).alias(alias))
    return rows.select("line_id", "feed", "file_name", *columns)
