"""Queries of problems 1, 2, 5 and 7, each with SQL written independently of the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lacuna.functions.text import MISSING_WORDS, given, given_key, same_key
from lacuna.operators import drift, hotdeck, orphans, quantities
from lacuna.sources.tables import table

MIDNIGHT = "midnight_miccai2025_official_scores"


# ---- problem 1 ----

def _p1_orphans(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, MIDNIGHT).select("record_id", given_key("model_id").alias("model_key"), given_key("evaluation_id").alias("evaluation_key"), F.col("reported_at").alias("at"))
    sources = table(spark, d, "model_sources").select("record_id", given_key("model_id").alias("model_key"), F.col("audited_at").alias("at"))
    models = table(spark, d, "model_metadata").select(same_key("model_id").alias("model_key"), "registered_at", "deleted_at")
    tasks = table(spark, d, "tasks").select(same_key("evaluation_id").alias("evaluation_key"), "added_at", "removed_at")
    model = lambda name: orphans.Component(name, "model_key", models, "model_key", "registered_at", "deleted_at")
    evaluation = orphans.Component("midnight.evaluation_id", "evaluation_key", tasks, "evaluation_key", "added_at", "removed_at")
    of_scores = orphans.find_component_orphans(scores, [model("midnight.model_id"), evaluation], "at", ["record_id", "at"])
    return of_scores.unionByName(orphans.find_component_orphans(sources, [model("model_sources.model_id")], "at", ["record_id", "at"]))


def _p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Composite references (model, evaluation) of midnight to the cells of the score table, under partial match."""
    refs = table(spark, d, MIDNIGHT).select("record_id", F.col("reported_at").alias("at"), given_key("model_id").alias("m"), given_key("evaluation_id").alias("e"))
    cells = table(spark, d, "scores").select(same_key("model_id").alias("m"), same_key("evaluation_id").alias("e"))
    lost = orphans.find_orphans(refs, ["m", "e"], cells, ["m", "e"], match="partial", keep=["record_id", "at"])
    return lost.withColumn("ref_field", F.lit("midnight.(model_id, evaluation_id)"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1_orphans(spark, d).select("ref_field", "record_id", "kind")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans of single and composite references by referring field, null mask, month and kind."""
    return orphans.orphan_report(_p1_orphans(spark, d).unionByName(_p1_pairs(spark, d)), "ref_field", "at")


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every composite reference of midnight that no cell of the score table agrees with, and its null mask."""
    return _p1_pairs(spark, d).select("record_id", "null_mask", "kind")


_WORDS = ", ".join(f"'{w}'" for w in MISSING_WORDS)


def sql_key(c: str) -> str:
    return f"lower(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g'))"


def sql_missing(c: str) -> str:
    return f"({c} IS NULL OR {sql_key(c)} IN ('', {_WORDS}))"


_P1_SQL = f"""
WITH refs AS (
  SELECT 'midnight.model_id' AS ref_field, 2 * ({sql_missing('evaluation_id')})::INT AS null_mask, record_id, {sql_key('model_id')} AS k, reported_at AS t, 'm' AS tgt FROM {MIDNIGHT} WHERE NOT {sql_missing('model_id')}
  UNION ALL SELECT 'midnight.evaluation_id', ({sql_missing('model_id')})::INT, record_id, {sql_key('evaluation_id')}, reported_at, 'e' FROM {MIDNIGHT} WHERE NOT {sql_missing('evaluation_id')}
  UNION ALL SELECT 'model_sources.model_id', 0, record_id, {sql_key('model_id')}, audited_at, 'm' FROM model_sources WHERE NOT {sql_missing('model_id')}),
targets AS (
  SELECT 'm' AS tgt, {sql_key('model_id')} AS k, registered_at AS a, deleted_at AS z FROM model_metadata
  UNION ALL SELECT 'e', {sql_key('evaluation_id')}, added_at, removed_at FROM tasks),
judged AS (
  SELECT r.ref_field, r.null_mask, r.record_id, r.t, count(x.k) AS n, min(x.a) AS first_a,
         count(*) FILTER (WHERE x.a <= r.t AND (x.z IS NULL OR x.z > r.t)) AS live
  FROM refs r LEFT JOIN targets x ON x.tgt = r.tgt AND x.k = r.k GROUP BY ALL),
found AS (
  SELECT ref_field, null_mask, record_id, t, CASE WHEN n = 0 THEN 'missing' WHEN t < first_a THEN 'late' ELSE 'deleted' END AS kind
  FROM judged WHERE n = 0 OR live = 0)
"""

_P1_PAIRS = f"""
WITH r AS (SELECT record_id, reported_at AS t, CASE WHEN {sql_missing('model_id')} THEN NULL ELSE {sql_key('model_id')} END AS m,
                  CASE WHEN {sql_missing('evaluation_id')} THEN NULL ELSE {sql_key('evaluation_id')} END AS e FROM {MIDNIGHT}),
s AS (SELECT DISTINCT {sql_key('model_id')} AS m, {sql_key('evaluation_id')} AS e FROM scores)
SELECT record_id, t, CAST((m IS NULL)::INT + 2 * (e IS NULL)::INT AS INTEGER) AS null_mask, 'missing' AS kind
FROM r WHERE (m IS NOT NULL OR e IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM s WHERE (r.m IS NULL OR s.m = r.m) AND (r.e IS NULL OR s.e = r.e))"""

# ---- problem 2 ----

def p2_found(spark: SparkSession, d: str) -> DataFrame:
    log = drift.schema_changes(table(spark, d, "raw_score_lines"))
    return log.select("file_name", "change_kind", "old_field", "new_field")


def p2_log(spark: SparkSession, d: str) -> DataFrame:
    """All differences in order of delivery, with the types before and after."""
    return drift.schema_changes(table(spark, d, "raw_score_lines")).select(
        "source_table", "feed", F.col("seq").cast("bigint").alias("file_no"), "file_name", "change_kind", "old_field", "new_field", "old_type", "new_type"
    )


def p2_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every field of every line under one name and one type per source."""
    return drift.consistent_cells(table(spark, d, "raw_score_lines")).select("line_id", "source_table", "source_row", "field", "union_kind", "value")


def p2_hibou(spark: SparkSession, d: str) -> DataFrame:
    """All lines of the feeds of hibou as one table under first names and union types."""
    return drift.consistent_table(table(spark, d, "raw_score_lines"), "hibou_official_scores_2024")


def p2_midnight(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "raw_score_lines"), MIDNIGHT)


def p2_phikon(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "raw_score_lines"), "phikon_family_official_scores_2023_2024")


_P2_SQL = """
WITH files AS (
  SELECT feed, file_name, row_number() OVER (PARTITION BY feed ORDER BY min(delivered_at), file_name) AS seq,
         count(*) OVER (PARTITION BY feed) AS last_seq
  FROM raw_score_lines GROUP BY feed, file_name),
cells AS (
  SELECT f.feed, f.file_name, f.seq, f.last_seq, json_extract_string(payload, '$.source_row') AS rec, u.k AS field,
         json_extract(payload, '$."' || u.k || '"') AS v
  FROM raw_score_lines l JOIN files f USING (feed, file_name), unnest(json_keys(payload)) AS u(k)),
typed AS (
  SELECT *, CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
                 WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind,
         CASE WHEN json_type(v) = 'NULL' THEN NULL WHEN json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(CAST(v AS DOUBLE) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS txt
  FROM cells),
ff AS (SELECT feed, file_name, seq, last_seq, field, max(kind) AS kind FROM typed GROUP BY ALL),
hist AS (
  SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY feed, field ORDER BY seq ROWS UNBOUNDED PRECEDING) AS carried,
         lag(seq) OVER (PARTITION BY feed, field ORDER BY seq) AS b, lead(seq) OVER (PARTITION BY feed, field ORDER BY seq) AS a FROM ff),
hist2 AS (SELECT *, lag(carried) OVER (PARTITION BY feed, field ORDER BY seq) AS bk FROM hist),
comes AS (SELECT feed, seq, field FROM hist2 WHERE seq > 1 AND (b IS NULL OR b < seq - 1)),
goes AS (SELECT feed, seq + 1 AS seq, field FROM hist2 WHERE seq < last_seq AND (a IS NULL OR a > seq + 1)),
recs AS (SELECT DISTINCT feed, seq, rec FROM typed WHERE rec IS NOT NULL),
common AS (SELECT p.feed, c.seq, c.rec FROM recs p JOIN recs c ON p.feed = c.feed AND p.rec = c.rec AND c.seq = p.seq + 1),
pairs AS (SELECT g.feed, g.seq, g.field AS old_field, c.field AS new_field FROM goes g JOIN comes c USING (feed, seq)),
vals AS (SELECT feed, seq, rec, field, any_value(txt) AS txt FROM typed GROUP BY ALL),
renamed AS (
  SELECT p.feed, p.seq, p.old_field, p.new_field FROM pairs p JOIN common k USING (feed, seq)
  LEFT JOIN vals o ON o.feed = p.feed AND o.seq = p.seq - 1 AND o.rec = k.rec AND o.field = p.old_field
  LEFT JOIN vals n ON n.feed = p.feed AND n.seq = p.seq AND n.rec = k.rec AND n.field = p.new_field
  GROUP BY ALL HAVING bool_and(o.txt IS NOT DISTINCT FROM n.txt) AND count(o.txt) > 0),
found AS (
  SELECT feed, seq, 'renamed' AS change_kind, old_field, new_field, NULL AS old_type, NULL AS new_type FROM renamed
  UNION ALL SELECT feed, seq, 'added', '', field, NULL, NULL FROM comes ANTI JOIN (SELECT feed, seq, new_field AS field FROM renamed) USING (feed, seq, field)
  UNION ALL SELECT feed, seq, 'removed', field, '', NULL, NULL FROM goes ANTI JOIN (SELECT feed, seq, old_field AS field FROM renamed) USING (feed, seq, field)
  UNION ALL SELECT feed, seq, 'retyped', field, field, bk, carried FROM hist2 WHERE b = seq - 1 AND bk <> carried)
"""


# ---- problem 5 ----

def _p5(spark: SparkSession, d: str) -> DataFrame:
    return quantities.harmonise_units(table(spark, d, MIDNIGHT).select("record_id", "value", "value_unit", "metric"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose written unit is not the common one, in whole output units; inferred units are in ``p5_values``."""
    done = _p5(spark, d)
    return done.where((F.col("unit_source") != "inferred") & (F.col("unit") != F.col("common_unit")) & F.col("common_value").isNotNull()).select("record_id", "common_value")


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value in its common unit; units written nowhere are inferred and flagged where uncertain."""
    return _p5(spark, d).select(
        "record_id", "quantity", "unit", "unit_source", F.round("posterior", 6).alias("posterior"), "uncertain", "common_value", "common_unit"
    )


def _sql_units() -> str:
    rows = []
    for quantity, units in quantities.UNITS.items():
        for unit, (factor, spellings) in units.items():
            for s in spellings:
                rows.append(f"('{s}', '{quantity}', {str(unit == quantities.COMMON[quantity]).lower()}, {factor})")
    return "(VALUES " + ", ".join(rows) + ") AS u(spelling, quantity, is_common, factor)"


def _sql_spell(c: str) -> str:
    return f"lower(regexp_replace({c}, '[^A-Za-z0-9%‰]', '', 'g'))"


_P5_SQL = f"""
WITH u AS (SELECT * FROM {_sql_units()}),
a AS (SELECT record_id, value_unit, metric,
  regexp_replace(replace(replace(value, '−', '-'), chr(160), ' '), '(±|\\+/-)\\s*[0-9.,eE+-]*[0-9]', '') AS v FROM {MIDNIGHT} WHERE regexp_matches(value, '[0-9]')),
b AS (SELECT *, regexp_extract(v, '^\\s*([+-]?[0-9.,]+([eE][+-]?[0-9]+)?)', 1) AS n FROM a),
c AS (SELECT record_id, n, {_sql_spell('substr(ltrim(v), length(n) + 1)')} AS s1,
  CASE WHEN {sql_missing('value_unit')} AND NOT contains(coalesce(value_unit, ''), '%') AND NOT contains(coalesce(value_unit, ''), '‰') THEN '' ELSE {_sql_spell('value_unit')} END AS s2,
  {_sql_spell("regexp_extract(metric, '(,| in |[(]|[[])(.*)$', 2)")} AS s3 FROM b WHERE n <> ''),
d AS (SELECT c.record_id, c.n, coalesce(u1.quantity, u2.quantity, u3.quantity) AS q, coalesce(u1.is_common, u2.is_common, u3.is_common) AS is_common,
  coalesce(u1.factor, u2.factor, u3.factor) AS factor
  FROM c LEFT JOIN u u1 ON u1.spelling = c.s1 LEFT JOIN u u2 ON u2.spelling = c.s2 LEFT JOIN u u3 ON u3.spelling = c.s3),
e AS (SELECT *, CASE
  WHEN contains(n, ',') AND contains(n, '.') THEN replace(n, ',', '')
  WHEN length(n) - length(replace(n, ',', '')) > 1 OR (regexp_matches(n, '^[+-]?[1-9][0-9]{{0,2}},[0-9]{{3}}$') AND (q <> 'fraction' OR factor = 100)) THEN replace(n, ',', '')
  ELSE replace(n, ',', '.') END AS plain FROM d WHERE NOT is_common)
SELECT record_id, CAST(CASE WHEN contains(lower(plain), 'e') THEN round(CAST(CAST(plain AS DOUBLE) AS DECIMAL(38, 12)) * factor) ELSE round(CAST(plain AS DECIMAL(38, 12)) * factor) END AS BIGINT) AS common_value FROM e
"""


# ---- problem 7 ----

def _p7_models(spark: SparkSession, d: str) -> DataFrame:
    """One row per model: smallest spelling, first registration, family as given."""
    return (
        table(spark, d, "model_metadata")
        .select(same_key("model_id").alias("model_key"), "model_id", given("family").alias("family"), "primary_source_url", "registered_at")
        .groupBy("model_key")
        .agg(F.min("model_id").alias("model_id"), F.min("family").alias("family"), F.min("primary_source_url").alias("primary_source_url"), F.min("registered_at").alias("registered_at"))
        .withColumn("day", F.unix_micros(F.col("registered_at").cast("timestamp")) / 86_400_000_000.0)
    )


def _p7_c0(spark: SparkSession, d: str) -> DataFrame:
    bounds = table(spark, d, "score_columns").where(F.col("column_name") == "c0").agg(F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))
    wide = table(spark, d, "score_matrix_wide").select(same_key("model_id").alias("model_key"), F.col("model_id").alias("row_id"), "c0")
    wide = wide.crossJoin(F.broadcast(bounds))  # one row: an ungrouped aggregate
    proper = ~F.isnan("c0") & F.col("c0").between(F.col("lowest"), F.col("highest"))
    wide = wide.select("model_key", "row_id", F.when(proper, F.col("c0")).alias("c0"))
    rows = wide.join(_p7_models(spark, d).select("model_key", same_key("family").alias("family_key"), "day"), "model_key", "left")
    return hotdeck.hot_deck(rows, "family_key", "day", "row_id", "c0")


def _p7_family(spark: SparkSession, d: str) -> DataFrame:
    return hotdeck.hot_deck(_p7_models(spark, d), "primary_source_url", "day", "model_id", "family")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    c0 = _p7_c0(spark, d).where("was_filled").select(F.col("row_id").alias("model_id"), F.lit("c0").alias("field_name"))
    family = _p7_family(spark, d).where("was_filled").select("model_id", F.lit("family").alias("field_name"))
    return c0.unionByName(family)


def p7_c0(spark: SparkSession, d: str) -> DataFrame:
    """c0 of every row of the matrix with a mark, donor and distance in days on filled values."""
    return _p7_c0(spark, d).select(F.col("row_id").alias("model_id"), F.col("c0_filled").alias("c0"), "was_filled", "donor", "donor_side", F.round("distance", 6).alias("distance_days"))


def p7_family(spark: SparkSession, d: str) -> DataFrame:
    """Family of every model with a mark, donor and distance in days on filled values."""
    return _p7_family(spark, d).select("model_id", F.col("family_filled").alias("family"), "was_filled", "donor", "donor_side", F.round("distance", 6).alias("distance_days"))


_P7_MODELS = f"""
m AS (SELECT {sql_key('model_id')} AS k, min(model_id) AS model_id, min(CASE WHEN {sql_missing('family')} THEN NULL ELSE family END) AS family,
      min(primary_source_url) AS url, min(registered_at) AS reg FROM model_metadata GROUP BY 1),
w AS (SELECT s.model_id, {sql_key('m.family')} AS fam, m.reg, CASE WHEN isfinite(s.c0) AND s.c0 BETWEEN c.lowest AND c.highest THEN s.c0 END AS c0
      FROM score_matrix_wide s LEFT JOIN m ON m.k = {sql_key('s.model_id')}, (SELECT lowest, highest FROM score_columns WHERE column_name = 'c0') c)
"""
_P7_SQL = f"""
WITH {_P7_MODELS}
SELECT a.model_id, 'c0' AS field_name FROM w a WHERE a.c0 IS NULL AND a.fam IS NOT NULL AND EXISTS (SELECT 1 FROM w b WHERE b.fam = a.fam AND b.model_id <> a.model_id AND b.c0 IS NOT NULL)
UNION ALL
SELECT a.model_id, 'family' FROM m a WHERE a.family IS NULL AND EXISTS (SELECT 1 FROM m b WHERE b.url = a.url AND b.k <> a.k AND b.family IS NOT NULL)
"""


def _sql_deck(rows: str, group: str, identity: str, value: str) -> str:
    """Nearest donor by brute force over all pairs of a group, ties to the one before, then in sort order."""
    return f"""
WITH {_P7_MODELS},
r AS (SELECT *, {group} AS g, {identity} AS who, {value} AS val, epoch_us(reg) / 86400000000.0 AS x FROM {rows}),
p AS (SELECT a.who, b.who AS donor, b.val, CASE WHEN (b.x, b.who) < (a.x, a.who) THEN 'before' ELSE 'after' END AS side, abs(a.x - b.x) AS dist,
        row_number() OVER (PARTITION BY a.who ORDER BY abs(a.x - b.x), CASE WHEN (b.x, b.who) < (a.x, a.who) THEN 0 ELSE 1 END,
          CASE WHEN (b.x, b.who) < (a.x, a.who) THEN NULL ELSE b.who END, b.who DESC) AS n
      FROM r a JOIN r b ON a.g = b.g AND a.who <> b.who AND b.val IS NOT NULL WHERE a.val IS NULL)
SELECT r.who AS model_id, coalesce(r.val, p.val) AS {value}, p.who IS NOT NULL AS was_filled, p.donor, p.side AS donor_side, round(p.dist, 6) AS distance_days
FROM r LEFT JOIN p ON p.who = r.who AND p.n = 1
"""


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p1_pairs": p1_pairs,
    "p2_found": p2_found,
    "p2_log": p2_log,
    "p2_cells": p2_cells,
    "p2_hibou": p2_hibou,
    "p2_midnight": p2_midnight,
    "p2_phikon": p2_phikon,
    "p5_found": p5_found,
    "p5_values": p5_values,
    "p7_found": p7_found,
    "p7_c0": p7_c0,
    "p7_family": p7_family,
}

ORACLES = {
    "p1_found": _P1_SQL + "SELECT ref_field, record_id, kind FROM found",
    "p1_report": _P1_SQL + f""", lost AS (SELECT ref_field, null_mask, t, kind FROM found UNION ALL SELECT 'midnight.(model_id, evaluation_id)', null_mask, t, kind FROM ({_P1_PAIRS}))
SELECT ref_field, CAST(null_mask AS INTEGER) AS null_mask, strftime(date_trunc('month', t), '%Y-%m-%d') AS period, kind, count(*) AS orphans FROM lost GROUP BY ALL""",
    "p1_pairs": f"SELECT record_id, null_mask, kind FROM ({_P1_PAIRS})",
    "p2_found": _P2_SQL + "SELECT f.file_name, r.change_kind, r.old_field, r.new_field FROM found r JOIN files f USING (feed, seq)",
    "p2_log": _P2_SQL + """SELECT t.source_table, r.feed, r.seq AS file_no, f.file_name, r.change_kind, r.old_field, r.new_field, r.old_type, r.new_type
FROM found r JOIN files f USING (feed, seq) JOIN (SELECT feed, file_name, min(coalesce(source_table, '')) AS source_table FROM raw_score_lines GROUP BY 1, 2) t USING (feed, file_name)""",
    "p5_found": _P5_SQL,
    "p7_found": _P7_SQL,
    "p7_c0": _sql_deck("w", "fam", "model_id", "c0"),
    "p7_family": _sql_deck("m", "url", "model_id", "family"),
}
