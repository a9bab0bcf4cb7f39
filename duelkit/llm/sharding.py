"""A uniform shuffle into shards of exact sizes: a hypergeometric matrix says how many rows of each block go to each
shard; blocks are permuted locally, exchanged, and permuted again. Rows move by DataFrame functions only."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, table

#: Rows of a block and of a slice of a shard, about; the most cells of the matrix (its size is blocks times shards, whatever
#: the number of rows) and the most slices of all shards.
BLOCK_ROWS, MAX_CELLS, MAX_SLICES = 100_000, 1 << 20, 1 << 16
LEAST = 64


def hypergeometric(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """How many of ``taken`` rows drawn without replacement are good. From 10^9 rows on the distribution is summed in double
    precision over 20 standard deviations on both sides; what lies beyond has less than 1e-80 of it."""
    low, high = max(0, taken - bad), min(good, taken)
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, taken))
    mean = taken * good / (good + bad)
    reach = 20 * int((mean * (bad / (good + bad)) * max(1, good + bad - taken) / (good + bad)) ** 0.5 + 20)
    k = np.arange(max(low, int(mean) - reach), min(high, int(mean) + reach) + 1, dtype=np.float64)
    steps = np.log(good - k[:-1]) + np.log(taken - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - taken + k[:-1] + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    share = np.cumsum(np.exp(weight - weight.max()))
    return int(k[np.searchsorted(share, rng.random() * share[-1])])


def matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """How many rows of each block go to each shard: row sums are ``counts``, column sums are ``sizes``."""
    rng = np.random.default_rng(seed)
    left = list(sizes)
    out = []
    for taken in counts:
        rest, row = sum(left), []
        for j, size in enumerate(left):
            rest -= size
            got = hypergeometric(rng, size, rest, taken) if taken and size else 0
            row.append(got)
            taken -= got
            left[j] -= got
        out.append(row)
    return out


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def shuffle_shards(df: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """Adds ``shard`` (0 to shards-1; row counts at most one apart) and ``slot`` (the row's place in its shard, gapless
    from 0): a uniform random permutation. Columns of these names are replaced, columns of any other name stay.

    The result is fixed once it is computed, but another run gives the same one only if its rows come in the same partitions
    in the same order, as rows are numbered where they stand and not by their values. So any rows will do: nulls, equal
    rows and a key that most rows share don't matter. Numbered and dealt rows are written to the shared folder once each, so
    that a lost executor's work is redone over the same numbers. After the exchange a shard is permuted by random keys in
    slices of key ranges, so no task holds a whole shard; the slices' counts, at most ``MAX_SLICES``, place them. Only the
    blocks' row counts (at most ``MAX_CELLS`` over the number of shards) come to the driver. An empty table gives none.
    """
    df = df.drop("shard", "slot")
    columns = df.columns
    # input columns stand in one struct, apart from the columns made here
    rows = kept(df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.monotonically_increasing_id().alias("uid")), "rows")
    n = rows.count()
    blocks = max(LEAST, min(MAX_CELLS // shards, n // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(blocks))
    counted = {r["block"]: r["n"] for r in rows.groupBy(block.alias("block")).agg(F.count("*").alias("n")).collect()}
    bounds = np.cumsum(matrix([counted.get(b, 0) for b in range(blocks)], even(n, shards), seed), axis=1)
    cells = F.from_json(F.lit(json.dumps([{"block": b, "to": row} for b, row in enumerate(bounds.tolist())])), "array<struct<block:bigint,to:array<bigint>>>")
    dealt = df.sparkSession.range(1).select(F.inline(cells))

    local = Window.partitionBy("block").orderBy(F.xxhash64("uid", F.lit(seed + 1)), "uid")
    placed = rows.withColumn("block", block).withColumn("rank", F.row_number().over(local) - 1).join(F.broadcast(dealt), "block")
    slices = max(1, min(MAX_SLICES, max(LEAST, n // BLOCK_ROWS)) // shards)
    key = F.xxhash64("uid", F.lit(seed + 2))
    in_range = F.floor(F.shiftrightunsigned(key, 32) * slices / (1 << 32)).cast("int")  # rises with the unsigned key
    placed = kept(placed.select("row", "uid", F.size(F.filter("to", lambda to: to <= F.col("rank"))).alias("shard"), in_range.alias("slice")), "dealt")

    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "slice").agg(F.count("*").alias("n")).select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    again = Window.partitionBy("shard", "slice").orderBy(key, "uid")
    numbered = placed.withColumn("at", F.row_number().over(again) - 1).join(F.broadcast(starts), ["shard", "slice"])
    return numbered.select(*[F.col("row").getField(c).alias(c) for c in columns], (F.col("start") + F.col("at")).cast("long").alias("slot"), "shard")


def shards(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return shuffle_shards(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
