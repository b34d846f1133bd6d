"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix, in DataFrame functions only.

Every row is known by its file and its number in that file. Rows lie in partitions hashed by that number. How many rows
of each partition go to each shard is drawn exactly from the multivariate hypergeometric law, from counts alone. Each
partition then orders its rows by a seeded hash of their numbers and deals them out by those counts, and each shard
orders what it received by other seeded hashes, in blocks of a bounded size: every arrangement is equally likely and
every shard has exactly its size. Two exchanges of the rows, no sort of the whole; partitions and blocks grow with the
table.

Law "rows": shard sizes differ by one at most; equal texts are rows like any others and spread over all shards.
Null keys, repeated keys and rows equal in every column are rows like any others too, as no column decides where a row
goes; only the files do, so reruns over the same files agree, also after lost executors. A table that is not read
straight from Parquet files is written to the shared folder first. An empty table gives an empty result. Input columns
named like an output column are replaced; texts of any length pass through unread.
"""

from __future__ import annotations

import json
import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, table

#: Rows of a partition, and of a block of a shard; beyond MOST_COUNTS counts in the matrix partitions get larger instead.
PART_ROWS, BLOCK_ROWS, MOST_COUNTS = 4096, 16384, 1 << 21


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` items, taken without return, are good: inversion outward from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    up = down = mode
    p_up = p_down = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left = rng.random() - p_up
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            if (left := left - p_up) <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            if (left := left - p_down) <= 0:
                return down
    return mode


def communication_matrix(rows: list[int], cells: list[int], seed: int) -> list[list[int]]:
    """Row p: how many of partition p's rows go to each cell; row sums are ``rows``, column sums ``cells``."""
    rng, free, out = random.Random(seed), list(cells), []
    for n in rows:
        bad, counts = sum(free), []
        for k, room in enumerate(free):
            bad -= room
            counts.append(got := hypergeometric(rng, room, bad, n))
            n -= got
            free[k] -= got
        out.append(counts)
    return out


def shuffle_to_shards(df: DataFrame, shards: int, seed: int = 8) -> DataFrame:
    """df with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard)."""
    columns = [c for c in df.columns if c not in ("shard", "slot", "__file", "__row")]
    df = numbered(df.drop("shard", "slot"))
    spark, total = df.sparkSession, df.count()
    drawn = lambda k: F.xxhash64(F.lit(seed + k), "__file", "__row")
    parts = min(max(1, MOST_COUNTS // shards), max(1, math.ceil(total / PART_ROWS)))
    part = F.pmod(drawn(0), F.lit(parts)).cast("int")
    found = {r["p"]: r["count"] for r in df.groupBy(part.alias("p")).count().collect()}
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([found.get(p, 0) for p in range(parts)], sizes, seed)
    cuts = json.dumps([list(accumulate(row)) for row in matrix])
    dealt = spark.range(1).select(F.posexplode(F.from_json(F.lit(cuts), "array<array<bigint>>")).alias("__part", "__cuts"))
    blocks = max(1, math.ceil(total / shards / BLOCK_ROWS))

    def placed(rows: DataFrame) -> DataFrame:
        """rows with shard, and with block and rank of a random order in it."""
        ranked = rows.withColumn("__part", part).withColumn(
            "__rank", F.row_number().over(Window.partitionBy("__part").orderBy(drawn(1), "__file", "__row"))
        )
        shard = F.size(F.filter("__cuts", lambda c: c < F.col("__rank"))).alias("shard")
        return ranked.join(dealt, "__part").select(*rows.columns, shard, F.pmod(drawn(2), F.lit(blocks)).alias("__block"))

    counts = placed(df.select("__file", "__row")).groupBy("shard", "__block").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("__block")) - F.col("count")
    starts = counts.select("shard", "__block", before.alias("__start"))
    rank = F.row_number().over(Window.partitionBy("shard", "__block").orderBy(drawn(3), "__file", "__row"))
    return placed(df).withColumn("__rank", rank).join(starts, ["shard", "__block"]).select(*columns, "shard", (F.col("__start") + F.col("__rank") - 1).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = numbered(table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"), "__file", "__row"
    )
    return shuffle_to_shards(docs, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
