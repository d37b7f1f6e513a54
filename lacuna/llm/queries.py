"""Queries of problems 3, 4, 6, 8, 9 and 10, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lacuna.functions.text import MISSING_WORDS, given_key, same_key
from lacuna.llm import mixing, mojibake, ranking, splits, survivors, tokenizer
from lacuna.session import cut
from lacuna.sources.tables import table

PHIKON = "phikon_family_official_scores_2023_2024"
FIELDS = ["value", "uncertainty", "magnification", "downstream_protocol"]
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}

# ---- problem 3 ----


def _p3_records(spark: SparkSession, d: str) -> DataFrame:
    ranks = table(spark, d, "status_ranks").groupBy(same_key("inclusion_status").alias("status_key")).agg(F.min("trust_rank").alias("trust_rank"))
    records = table(spark, d, PHIKON).select(
        "record_id",
        given_key("model_id").alias("model_key"),
        given_key("dedup_key").alias("cell_key"),
        same_key("inclusion_status").alias("status_key"),
        survivors.written_date(F.col("source_revision")).alias("revised"),
        *FIELDS,
    )
    records = records.where(F.col("model_key").isNotNull() & F.col("cell_key").isNotNull())
    return records.join(F.broadcast(ranks), "status_key", "left")  # status_ranks is a fixed table of 8 rows


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    chosen = survivors.choose_fields(_p3_records(spark, d), ["model_key", "cell_key"], "record_id", "trust_rank", "revised", FIELDS)
    return chosen.select("group_id", "field_name", F.col("record").alias("record_id"))


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One record per cell of two or more records, each field with its record and dominance layer."""
    return survivors.build_survivors(_p3_records(spark, d), ["model_key", "cell_key"], "record_id", "trust_rank", "revised", FIELDS)


_WORDS = ", ".join(f"'{w}'" for w in MISSING_WORDS)


def _key(c: str) -> str:
    return f"lower(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g'))"


def _missing(c: str) -> str:
    return f"({c} IS NULL OR regexp_replace({c}, '[[:space:][:punct:]\\x{{00a0}}—–]', '', 'g') = '' OR {_key(c)} IN ({_WORDS}))"


_REV = "coalesce(source_revision, '')"
_P3_DATE = f"""coalesce(
  try_cast(replace(replace(nullif(regexp_extract({_REV}, '(20[0-9]{{2}}[-/.][0-9]{{2}}[-/.][0-9]{{2}})', 1), ''), '/', '-'), '.', '-') AS DATE),
  try_strptime(nullif(regexp_extract({_REV}, '(^|[^0-9])(20[0-9]{{6}})($|[^0-9])', 2), ''), '%Y%m%d')::DATE,
  try_strptime(nullif(regexp_extract({_REV}, '([0-9]{{1,2}} [A-Z][a-z]+ 20[0-9]{{2}})', 1), ''), ['%d %B %Y', '%d %b %Y'])::DATE,
  try_strptime(nullif(regexp_extract({_REV}, '([A-Z][a-z]+ [0-9]{{1,2}}, 20[0-9]{{2}})', 1), ''), ['%B %d, %Y', '%b %d, %Y'])::DATE)"""
_P3_SQL = f"""
WITH r AS (
  SELECT p.record_id, {_key('p.model_id')} AS m, {_key('p.dedup_key')} AS c, coalesce(s.trust_rank, 1000000) AS trust, {_P3_DATE} AS day,
    {', '.join(f'NOT {_missing(f)} AS g_{f}' for f in FIELDS)}
  FROM {PHIKON} p LEFT JOIN status_ranks s ON {_key('s.inclusion_status')} = {_key('p.inclusion_status')}
  WHERE NOT {_missing('p.model_id')} AND NOT {_missing('p.dedup_key')}),
g AS (SELECT *, count(*) OVER w AS n, min(record_id) OVER w AS group_id, {' + '.join(f'g_{f}::INT' for f in FIELDS)} AS filled FROM r WINDOW w AS (PARTITION BY m, c)),
f AS ({' UNION ALL '.join(f"SELECT group_id, '{f}' AS field_name, record_id, trust, day, filled FROM g WHERE n > 1 AND g_{f}" for f in FIELDS)}),
o AS (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY trust, day DESC NULLS LAST, filled DESC, record_id) AS k FROM f)
SELECT group_id, field_name, record_id FROM o WHERE k = 1
"""

# ---- problem 4 ----


def _p4_members(spark: SparkSession, d: str) -> DataFrame:
    models = table(spark, d, "model_metadata").select(same_key("model_id").alias("member"), "model_id", given_key("family").alias("name"))
    models = models.where(F.col("member") != "")
    spelled = models.groupBy("member").agg(F.min("model_id").alias("model_id"))
    sources = table(spark, d, "model_sources").select(given_key("model_id").alias("member"), given_key("canonical_family").alias("name"))
    sources = sources.join(spelled.select("member"), "member", "left_semi")
    names = models.select("member", "name").unionByName(sources)
    return cut(splits.related_groups(spelled.select("member"), names).join(spelled, "member"))


def _p4_groups(members: DataFrame) -> DataFrame:
    return members.groupBy("group_root").agg(F.min("model_id").alias("group_id"), F.count(F.lit(1)).alias("size"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    members = _p4_members(spark, d)
    groups = _p4_groups(members).where(F.col("size") > 1)
    return members.join(groups, "group_root").select("model_id", "group_id")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every model with its group and split."""
    members = _p4_members(spark, d)
    groups = _p4_groups(members)
    placed = splits.assign_splits(groups.select("group_id", "size"), SHARES)
    return members.join(groups.select("group_root", "group_id"), "group_root").join(placed.select("group_id", "split"), "group_id").select("model_id", "group_id", "split")


_P4_SQL = f"""
WITH RECURSIVE m AS (SELECT {_key('model_id')} AS k, min(model_id) AS model_id FROM model_metadata GROUP BY 1),
n AS (SELECT DISTINCT {_key('model_id')} AS k, {_key('family')} AS f FROM model_metadata WHERE NOT {_missing('family')}
      UNION SELECT {_key('model_id')}, {_key('canonical_family')} FROM model_sources WHERE NOT {_missing('canonical_family')} AND NOT {_missing('model_id')} AND {_key('model_id')} IN (SELECT k FROM m)),
e AS (SELECT DISTINCT a.f AS x, b.f AS y FROM n a JOIN n b USING (k)),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
comp AS (SELECT x AS f, min(y) AS root FROM reach GROUP BY x),
g AS (SELECT DISTINCT n.k, comp.root FROM n JOIN comp USING (f)),
s AS (SELECT g.root, min(m.model_id) AS group_id, count(*) AS size FROM g JOIN m USING (k) GROUP BY 1)
SELECT m.model_id, s.group_id FROM g JOIN m USING (k) JOIN s USING (root) WHERE s.size > 1
"""

# ---- problem 6 ----


def _p6_columns(spark: SparkSession, d: str) -> list[dict]:
    declared = table(spark, d, "score_columns").where(F.col("column_name").isNotNull()).groupBy("column_name")
    declared = declared.agg(F.bool_and(F.coalesce("higher_is_better", F.lit(True))).alias("up"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))
    return [{"name": r["column_name"], "higher_is_better": r["up"], "lowest": r["lowest"], "highest": r["highest"]} for r in declared.orderBy("column_name").collect()]  # a fixed table: one row per column of the matrix


def _p6_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "score_matrix_wide").withColumn("member", same_key("model_id")).drop("model_id")


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "model_metadata").where(F.col("model_id").isNotNull()).groupBy(same_key("model_id").alias("member")).agg(F.min("model_id").alias("model_id"))
    out = ranking.rank_items(items.select("member"), _p6_scores(spark, d), "member", _p6_columns(spark, d))
    return out.join(items, "member").select("model_id", "n_scores", "projection", "place")


def p6_loadings(spark: SparkSession, d: str) -> DataFrame:
    """Loading of every score column in the one ranking, and whether it runs against its declared direction."""
    return ranking.loadings(_p6_scores(spark, d), "member", _p6_columns(spark, d))


# ---- problem 8 ----


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_documents(table(spark, d, "documents"))


# ---- problem 9 ----


def _p9_parts(spark: SparkSession, d: str) -> tuple[DataFrame, dict, dict]:
    targets = table(spark, d, "mix_targets").where(F.col("source").isNotNull())
    wanted = {r["key"]: (float(r["share"]), int(r["repeats"])) for r in targets.groupBy(same_key("source").alias("key")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect()}
    sized = tokenizer.count_tokens(table(spark, d, "documents").withColumn("source", given_key("source")), ["doc_id", "source"])
    sized = cut(sized.withColumn("source", F.when(F.col("source").isin(list(wanted)), F.col("source"))))
    supply = {r["source"]: (r["tokens"], r["documents"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")).collect()}
    return sized, wanted, supply


def _p9_draw(spark: SparkSession, d: str) -> tuple[DataFrame, dict, dict]:
    sized, wanted, supply = _p9_parts(spark, d)
    plan = mixing.plan_shares({s: t for s, (t, _) in supply.items() if s is not None}, wanted)
    return mixing.draw_mixture(sized, plan, rows=sum(n for _, n in supply.values())), wanted, supply


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every drawn copy of every document with its output shard and its place key within the shard."""
    return _p9_draw(spark, d)[0].select("doc_id", "source", "copy_no", "shard", "position_key")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents and tokens there are, copies and tokens drawn, repeats, target and reached share."""
    drawn, wanted, supply = _p9_draw(spark, d)
    rows = [(s, *supply.get(s, (0, 0))[::-1], *wanted.get(s, (None, None))) for s in {*supply, *wanted}]
    base = spark.createDataFrame(rows, "source string, documents long, tokens long, target_share double, max_repeats int")
    sums = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("copies"), F.sum("tokens").alias("drawn_tokens"))
    total = drawn.agg(F.sum("tokens").alias("_total"))
    out = base.join(sums, "source", "left").crossJoin(F.broadcast(total))  # one row: an ungrouped aggregate
    return out.select(
        "source", "documents", "tokens", "target_share", "max_repeats",
        F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"),
        F.round(F.col("drawn_tokens") / F.nullif("tokens", F.lit(0)), 6).alias("repeats"),
        F.round(F.coalesce(F.col("drawn_tokens") / F.col("_total"), F.lit(0.0)), 6).alias("actual_share"),
    )


# ---- problem 10 ----


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore_documents(table(spark, d, "documents")).where("garbled").select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with their text as restored, the steps, and whether no lost stretch is left."""
    return mojibake.restore_documents(table(spark, d, "documents")).where("garbled").select("doc_id", "restored", "steps", "text")


QUERIES = {
    "p3_found": p3_found,
    "p3_survivors": p3_survivors,
    "p4_found": p4_found,
    "p4_splits": p4_splits,
    "p6_ranking": p6_ranking,
    "p6_loadings": p6_loadings,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}

ORACLES = {"p3_found": _P3_SQL, "p4_found": _P4_SQL}
