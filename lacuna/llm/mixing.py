"""Problem 9: sources mixed to target shares of all tokens.

The total is the largest that lets every source reach its share with at most its
allowed repeats.  A source gives whole documents: all of them as often as the
full passes say, and once more those at the head of a seeded order, up to the
rest.  The drawn copies are cut into blocks; a splitting tree halves the range of
output shards again and again and draws, by a multivariate hypergeometric, how
many blocks of each source go left, so the quotas of all shards are exact and
add up.  The draws are exact for any number of blocks.  Each source's blocks, in
the random order of a seeded hash, are dealt out by these quotas, and the rows of
a shard are sorted by a hash.  The number of shards grows with the copies.

Only sums by source (a fixed table) and the tree reach the driver.  Running sums
inside a source go over hash buckets, so one source may hold most rows.

Defined results: documents of no or unlisted source are not drawn and are
counted in the report under source null; a listed source without tokens gives
nothing and the other shares are scaled up; documents without tokens travel with
the full passes; equal documents are separate records.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lacuna.operators.ranks import hash_bits, running

SHARDS = 16  # at least
SHARD_ROWS = 1_000_000
BLOCK_ROWS = 64
GENERATOR_RANGE = 10**9  # populations that the generator draws from itself
#: A table of more blocks than this is joined by a shuffle instead of a broadcast.
BROADCAST_BLOCKS = 1_000_000


def plan_shares(supply: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, dict]:
    """Per source: wanted tokens, full passes and the rest, for the largest total that all caps allow.

    That total is set by the scarcest source.  With a larger ``total`` sources that their cap stops give all they may
    and reach less than their share.
    """
    live = {s: t for s, t in targets.items() if supply.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    scale = sum(t[0] for t in live.values())
    if not live:
        return {}
    total = min(supply[s] * repeats / (share / scale) for s, (share, repeats) in live.items()) if total is None else total
    out = {}
    for s, (share, repeats) in live.items():
        wanted = min(supply[s] * repeats, total * share / scale)
        full = min(repeats, math.floor(wanted / supply[s] + 1e-9))
        out[s] = {"wanted": wanted, "full": full, "rest": max(0, round(wanted - full * supply[s])) if full < repeats else 0}
    return out


def split_blocks(blocks: dict[str, int], shards: int = SHARDS, seed: int = 0) -> dict[str, list[int]]:
    """Blocks of each source in each shard; shards differ by at most one block in all."""
    names = sorted(blocks)
    quotas = {n: [0] * shards for n in names}

    def descend(low: int, high: int, counts: np.ndarray) -> None:
        if high - low == 1:
            for n, c in zip(names, counts):
                quotas[n][low] = int(c)
            return
        middle = (low + high) // 2
        total = int(counts.sum())
        left = total * (middle - low) // (high - low)
        drawn = draw_blocks(np.random.default_rng([seed, low, high]), counts, left)
        descend(low, middle, drawn)
        descend(middle, high, counts - drawn)

    if names:
        descend(0, shards, np.array([blocks[n] for n in names], dtype=np.int64))
    return quotas


def draw_blocks(rng: np.random.Generator, counts: np.ndarray, left: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``left`` out of ``counts``, one marginal after the other."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, n in enumerate(counts):
        rest -= int(n)
        out[i] = hypergeometric(rng, int(n), rest, left)
        left -= int(out[i])
    return out


def _log_factorial_step(n: int, by: int) -> float:
    """log((n + by)! / n!), precise where both are large and alike."""
    if min(n, n + by) < 1_000_000:
        return math.lgamma(n + by + 1) - math.lgamma(n + 1)
    return (n + by + 0.5) * math.log1p(by / n) + by * math.log(n) - by + (1.0 / (n + by) - 1.0 / n) / 12.0


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` balls are good, exactly distributed for populations of any size.

    Beyond the generator's own range: ratio of uniforms around the mode, with the logarithm of the probability
    relative to the mode's, so that nothing large cancels.
    """
    total = good + bad
    if total < GENERATOR_RANGE:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(good, sample)
    mode = min(high, max(low, (sample + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(sample * (good / total) * (bad / total) * ((total - sample) / (total - 1)))
    half = 1.5 * spread + 2.0
    while low < high:
        u, v = 1.0 - rng.random(), (2.0 * rng.random() - 1.0) * half
        by = math.floor(v / u + 0.5)
        if not low <= mode + by <= high:
            continue
        odds = -_log_factorial_step(mode, by) - _log_factorial_step(good - mode, -by) - _log_factorial_step(sample - mode, -by) - _log_factorial_step(bad - sample + mode, by)
        if 2.0 * math.log(u) <= odds:
            return mode + by
    return low


def draw_mixture(documents: DataFrame, plan: dict[str, dict], shards: int | None = None, block_rows: int = BLOCK_ROWS, seed: int = 0, rows: int = 0) -> DataFrame:
    """doc_id, source, copy_no, shard, position_key of every drawn copy; ``documents(doc_id, source, tokens)``, ``rows`` of them."""
    spark = documents.sparkSession
    table = spark.createDataFrame([(s, p["full"], int(p["rest"])) for s, p in plan.items()], "source string, full_passes int, rest long")
    drawn = documents.join(F.broadcast(table), "source")  # one row per listed source, a fixed table
    drawn = running(drawn.withColumn("_h", F.xxhash64("doc_id", F.lit(seed))), ["source"], "_h", ["doc_id"], F.col("tokens"), out="_sum", bits=hash_bits(rows))
    copies = F.col("full_passes") + F.when((F.col("_sum") <= F.col("rest")) & (F.col("rest") > 0), 1).otherwise(0)
    drawn = drawn.withColumn("_copies", copies).where(F.col("_copies") > 0)
    drawn = drawn.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy_no"))
    drawn = drawn.withColumn("_h", F.xxhash64("doc_id", "copy_no", F.lit(seed + 1)))

    sizes = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per listed source
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}
    quotas = split_blocks(blocks, shards or max(SHARDS, -(-sum(sizes.values()) // SHARD_ROWS)), seed)
    dealt = spark.createDataFrame([(s, k, n) for s, q in quotas.items() for k, n in enumerate(q) if n], "source string, shard int, n long")
    dealt = dealt.select("source", "shard", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_i"))  # at most a shard's blocks in a row
    dealt = dealt.withColumn("_h", F.xxhash64("source", "shard", "_i", F.lit(seed + 3)))
    dealt = running(dealt, ["source"], "_h", ["shard", "_i"], out="_block", bits=hash_bits(sum(blocks.values()))).select("source", "_block", "shard")
    placed = running(drawn, ["source"], "_h", ["doc_id", "copy_no"], out="_place", bits=hash_bits(sum(sizes.values())))
    placed = placed.withColumn("_block", F.ceil(F.col("_place") / block_rows).cast("long"))
    placed = placed.join(F.broadcast(dealt) if sum(blocks.values()) <= BROADCAST_BLOCKS else dealt, ["source", "_block"])
    return placed.select("doc_id", "source", F.col("copy_no").cast("int").alias("copy_no"), "tokens", "shard", F.xxhash64("doc_id", "copy_no", F.lit(seed + 2)).alias("position_key"))
