"""Quality classifier by compression: how much better a text compresses with a zstandard dictionary of good labelled
text than with one of bad labelled text.

Texts are cut into pieces of PIECE bytes, each compressed on its own with either dictionary, so the dictionaries weigh
as much at the end of a long text as at its start. The normalised difference of the two sums goes through a logistic
curve, fitted to labelled documents that the dictionaries have not seen.

Fitting uses a bounded sample (parameters below) of the labelled rows that ``training`` allows, chosen by a seeded
hash; scoring covers every byte of every document and needs no shuffle. Null and empty texts have difference 0 and so
the curve's middle value. Without labelled texts of both classes every score is the share of label 1 (0.5 without any
label). A null doc_id has no label and is not held out. Conflicting labels of one document: the larger counts. Repeated rows stay; other columns pass through, and an
input column named like the result is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_result

PIECE = 512
LEVEL = 3
DICTIONARY_BYTES = 112_640
#: The sample: documents of each class for the dictionaries, and for the curve; pieces of one document.
DICTIONARY_DOCS, CURVE_DOCS, DOC_PIECES = 1200, 1000, 12
THRESHOLD = 0.7


def pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8")
    return [raw[k : k + PIECE] for k in range(0, len(raw), PIECE)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Difference:
    """(bad - good) / (bad + good) of a text's compressed sizes: above 0 when the good dictionary serves it better."""

    def __init__(self, good: bytes, bad: bytes):
        self.with_good, self.with_bad = (self._compressor(d) for d in (good, bad))

    @staticmethod
    def _compressor(content: bytes):
        dict_data = zstandard.ZstdCompressionDict(content)
        dict_data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=dict_data, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, text: str | None) -> float:
        cut = pieces(text)
        good, bad = (sum(len(c.compress(p)) for p in cut) for c in (self.with_good, self.with_bad))
        return (bad - good) / (bad + good) if cut else 0.0


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    middle: float

    def score(self, difference: float) -> float:
        z = self.slope * difference + self.middle
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton's method on targets drawn in from 0 and 1 (Platt)."""
    ones = y.sum()
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    scale = x.std() or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (goal - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def training(doc_id):
    """Rows from which labels may be learned."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 != 2


def fit_quality(docs: DataFrame, labels: DataFrame, seed: int = 9) -> QualityModel:
    labelled = labels.where(F.col("quality").isin(0, 1) & training(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = {r["quality"]: r["count"] for r in labelled.groupBy("quality").count().collect()}
    if len(known) < 2:
        share = known.get(1, 0) / sum(known.values()) if known else 0.5
        return QualityModel(b"", b"", 0.0, {0.0: -500.0, 0.5: 0.0, 1.0: 500.0}[share])
    rank = F.xxhash64(F.lit(seed), "doc_id")
    chosen = None
    for quality in (0, 1):
        first = labelled.where(F.col("quality") == quality).orderBy(rank, "doc_id").limit(DICTIONARY_DOCS + CURVE_DOCS)
        chosen = first if chosen is None else chosen.unionAll(first)
    # At most 2 * (DICTIONARY_DOCS + CURVE_DOCS) ids, so this side is small; a second hash deals them out.
    share = DICTIONARY_DOCS * 1000 // (DICTIONARY_DOCS + CURVE_DOCS)
    chosen = chosen.withColumn("curve", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(1000)) >= share)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").persist()

    def cut(batches):
        for batch in batches:
            rows = [(q, p) for q, t in zip(batch.column("quality").to_pylist(), batch.column("text").to_pylist(), strict=True) for p in _spread(pieces(t))]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], ["quality", "piece"])

    cut_up = sample.where(~F.col("curve")).select(F.col("quality").cast("int").alias("quality"), "text").mapInArrow(cut, "quality int, piece binary").collect()
    parts = [dictionary(sorted(bytes(r["piece"]) for r in cut_up if r["quality"] == q)) for q in (1, 0)]
    if not all(parts):
        sample.unpersist()
        return QualityModel(b"", b"", 0.0, math.log(known[1] / known[0]))
    measured = add_difference(sample.where("curve"), *parts, keep=["quality"]).select("quality", "compressed.difference").collect()
    sample.unpersist()
    x, y = np.array([r["difference"] for r in measured]), np.array([r["quality"] for r in measured])
    if not 0 < y.sum() < len(y):
        return QualityModel(*parts, 20.0, math.log(known[1] / known[0]))
    return QualityModel(*parts, *fit_curve(x, y))


def _spread(cut: list[bytes]) -> list[bytes]:
    return cut if len(cut) <= DOC_PIECES else [cut[k * len(cut) // DOC_PIECES] for k in range(DOC_PIECES)]


def add_difference(df: DataFrame, good: bytes, bad: bytes, keep: list[str] | None = None) -> DataFrame:
    made: list[Difference] = []

    def compute(batch):
        if not made:
            made.append(Difference(good, bad))
        return [{"difference": made[0](t)} for t in batch.column("text").to_pylist()]

    return with_result(df, "compressed", "struct<difference: double>", compute, keep)


def score_quality(df: DataFrame, model: QualityModel, name: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """df with a struct: difference, score from 0 to 1, predicted (score >= THRESHOLD)."""
    made: list[Difference] = []

    def compute(batch):
        if not made and model.good:
            made.append(Difference(model.good, model.bad))
        out = []
        for text in batch.column("text").to_pylist():
            difference = made[0](text) if made else 0.0
            score = model.score(difference)
            out.append({"difference": difference, "score": score, "predicted": int(score >= THRESHOLD)})
        return out

    return with_result(df, name, "struct<difference: double, score: double, predicted: int>", compute, keep)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=["doc_id"]).select("doc_id", (~training(F.col("doc_id"))).alias("held_out"), "quality.score", "quality.predicted")
