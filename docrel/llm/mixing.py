"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a word budget. Whole passes over the source fill as much of it as they can; for the rest, documents
are counted by exact length, an equal share of every length is taken, and a bounded-knapsack dynamic programme over
the lengths meets what is then left of the budget, to the word wherever the lengths allow. Which documents of a length
go is settled by a seeded hash, so reruns agree.

Only one row per source reaches the driver; one task sees one row per (source, length); which documents are taken is
decided in 64 hash ranges of each (source, length), so no source, length or group of copies lands in one task.
A null text has size 0 and is never taken; a null source is a source of its own, last in order; an empty table gives
no rows; a document repeated as rows is taken row by row. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import math
import random
from itertools import cycle

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

WEIGHTS = (5, 2, 1)
#: Budget left to the dynamic programme: greedy single documents, in seeded order of lengths, bring it below this.
DP_BUDGET = 1 << 16


def count_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most: float = 3) -> dict[str | None, float]:
    """The words each source should give: all words shared by weight, none above ``most`` times its own size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, cycle(weights)))
    capped: set = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        unit = rest / (sum(weight[s] for s in order if s not in capped) or 1)
        over = {s for s in order if s not in capped and unit * weight[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else unit * weight[s] for s in order}
        capped |= over


def fit(lengths: list[int], counts: list[int], budget: int, seed: int) -> list[int]:
    """How many documents of each length to take so that the lengths sum to the budget, or as near below as may be."""
    total = sum(n * k for n, k in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    taken = [k * budget // total if n else 0 for n, k in zip(lengths, counts, strict=True)]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    order = [k for k in range(len(lengths)) if lengths[k]]
    random.Random(seed).shuffle(order)
    more = True
    while left > DP_BUDGET and more:
        more = False
        for k in order:
            if left > DP_BUDGET and taken[k] < counts[k] and lengths[k] <= left:
                taken[k] += 1
                left -= lengths[k]
                more = True
    # Bit s of the integer: sum s can be reached with the lengths so far.
    reach, mask, steps = 1, (1 << (left + 1)) - 1, []
    for k in order:
        if reach >> left & 1:
            break
        n, free = lengths[k], counts[k] - taken[k]
        free = min(free, left // n)
        if free <= 0:
            continue
        steps.append((k, free, reach))
        chunk = 1
        while free:
            chunk = min(chunk, free)
            reach |= (reach << (chunk * n)) & mask
            free -= chunk
            chunk *= 2
    at = reach.bit_length() - 1
    for k, free, before in reversed(steps):
        while free and not before >> at & 1:
            at -= lengths[k]
            taken[k] += 1
            free -= 1
    return taken


def mix_sources(df: DataFrame, size=None, weights=WEIGHTS, most: int = 3, seed: int = 6) -> DataFrame:
    """df (doc_id, source, text, ...) with size (by default the words of text), source_size, target and taken."""
    size = count_words("text") if size is None else size
    df = df.withColumn("__size", size).drop("size", "source_size", "target", "taken").withColumnRenamed("__size", "size")
    spark, columns = df.sparkSession, [c for c in df.columns if c != "size"]
    hashed = F.xxhash64(F.lit(seed), "doc_id")
    key = F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("s:"), F.col("source")))
    sized = df.withColumns({"__hash": hashed, "__key": key}).withColumn(
        "__range", F.shiftrightunsigned("__hash", 58).cast("int")
    )
    counts = sized.groupBy("source", "__key", "size", "__range").count().persist()
    sizes = {(r["source"], r["__key"]): int(r["n"]) for r in counts.groupBy("source", "__key").agg(F.sum(F.col("size") * F.col("count")).alias("n")).collect()}
    goal = targets({s: n for (s, _), n in sizes.items()}, weights, most)
    plan, budget = [], {}
    for (source, name), n in sizes.items():
        passes = min(most, math.floor(goal[source] / n)) if n else 0
        budget[name] = 0 if passes == most or not n else min(n, round(goal[source]) - passes * n)
        plan.append((name, n, goal[source], passes))

    def choose(lengths: pd.DataFrame) -> pd.DataFrame:
        lengths = lengths.sort_values("size")
        name = lengths["__key"].iloc[0]
        took = fit(lengths["size"].tolist(), lengths["count"].tolist(), budget[name], seed)
        return pd.DataFrame({"__key": name, "size": lengths["size"], "__take": took})

    take = counts.groupBy("__key", "size").agg(F.sum("count").alias("count")).groupBy("__key").applyInPandas(choose, "__key string, size long, __take long")
    before = F.sum("count").over(Window.partitionBy("__key", "size").orderBy("__range")) - F.col("count")
    quota = counts.join(take, ["__key", "size"]).select(
        "__key", "size", "__range", F.greatest(F.lit(0), F.least(F.col("count"), F.col("__take") - before)).alias("__quota")
    )
    sources = spark.createDataFrame(plan, "__key string, source_size long, target double, __passes long")
    rank = F.row_number().over(Window.partitionBy("__key", "size", "__range").orderBy("__hash", F.xxhash64(*columns)))
    picked = sized.join(quota, ["__key", "size", "__range"]).withColumn("__rank", rank)
    taken = F.col("size") * (F.col("__passes") + (F.col("__rank") <= F.col("__quota")).cast("long"))
    return picked.join(sources, "__key").select(*columns, "size", "source_size", "target", taken.alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", count_words("text").alias("words")))
    return mix_sources(docs, size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")
