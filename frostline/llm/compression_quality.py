"""Quality classifier by compression: how much better a text compresses with a dictionary of good text than of bad.

Method: two zstandard dictionaries are trained, one on labelled good text, one on labelled bad text. A text is cut into
blocks, every block is compressed with either dictionary, and the difference of the summed sizes divided by the number
of bytes is the evidence; a logistic curve, fitted on labelled texts that neither dictionary has seen, makes it a score
from 0 to 1.

Bounds: each dictionary is trained on at most ``Training.per_class`` whole texts of its class of at most
``Training.max_chars`` characters (those first by a hash of the key). The curve is fitted on the counts of all other
labelled texts in ``Training.bins`` bins of the evidence, so the driver never holds more than that.

Defined results: null and empty texts score 0. Without texts of both classes every score is 0.5. Extra columns are
ignored, repeated rows are scored each, a null key gives a row with a null key. Several labels for a key: it is a good
text only if all of them say so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import named, stored


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the training."""

    per_class: int = 1200
    max_chars: int = 20_000
    dictionary_bytes: int = 112_640
    block_bytes: int = 2048
    level: int = 3
    bins: int = 400
    reach: float = 0.2


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Evidence:
    """Compressed-size difference per byte; made once for a task."""

    def __init__(self, good: bytes, bad: bytes, training: Training):
        shape = zstandard.ZstdCompressionParameters.from_level(
            training.level, write_content_size=False, write_checksum=False, write_dict_id=False
        )

        def packer(dictionary: bytes) -> zstandard.ZstdCompressor:
            known = zstandard.ZstdCompressionDict(dictionary)
            known.precompute_compress(compression_params=shape)
            return zstandard.ZstdCompressor(dict_data=known, compression_params=shape)

        self.good, self.bad, self.block = packer(good), packer(bad), training.block_bytes

    def __call__(self, text: str) -> float:
        data = text.encode()
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        gain = sum(len(self.bad.compress(b)) for b in blocks) - sum(len(self.good.compress(b)) for b in blocks)
        return gain / max(1, len(data))


def labels_of(labels: DataFrame, key: str, label: str) -> DataFrame:
    """``(key, good)``: one row per key that may be learned from."""
    marks = labels.where(named(label).isNotNull()).groupBy(named(key).alias("key")).agg(F.min(named(label)).alias("good"))
    return marks.where(F.col("key").isNotNull() & ~held_out(F.col("key")))


def in_dictionary(key: Column) -> Column:
    """Half of the labelled keys may make the dictionaries, the other half the curve."""
    return F.pmod(F.xxhash64(key, F.lit("dictionary")), F.lit(2)) == 0


def dictionaries(rows: DataFrame, marks: DataFrame, training: Training) -> tuple[bytes, bytes] | None:
    """Good and bad dictionary. Keys are drawn first, beside nothing but lengths; only the texts drawn are then read."""
    sizes = rows.where(F.length("text").between(1, training.max_chars)).select("key").distinct()
    known = marks.where(in_dictionary(F.col("key"))).join(sizes, "key")
    texts = {}
    for good in (0, 1):
        keys = known.where(F.col("good") == good).orderBy(F.xxhash64("key"), "key").select("key").limit(training.per_class)
        drawn = [r["key"] for r in keys.collect()]
        if len(drawn) < 8:
            return None
        own = rows.where(F.col("key").isin(drawn) & F.length("text").between(1, training.max_chars))
        texts[good] = [r["text"].encode() for r in own.orderBy(F.xxhash64("key"), "key", "text").select("text").limit(training.per_class).collect()]

    def dictionary(held: list[bytes]) -> bytes:
        blocks = [t[i : i + training.block_bytes] for t in held for i in range(0, len(t), training.block_bytes)]
        return zstandard.train_dictionary(training.dictionary_bytes, blocks).as_bytes()

    try:
        return dictionary(texts[1]), dictionary(texts[0])
    except zstandard.ZstdError:  # too little text to make a dictionary
        return None


def calibrated(measured: DataFrame, marks: DataFrame, training: Training) -> tuple[float, float]:
    """Slope and bias, from the evidence of all labelled texts that are not the dictionaries'."""
    width = 2 * training.reach / training.bins
    bin_ = F.least(F.greatest(F.floor((F.col("evidence") + training.reach) / width), F.lit(0)), F.lit(training.bins - 1))
    rest = measured.where(~F.col("empty")).join(marks.where(~in_dictionary(F.col("key"))), "key")
    counts = rest.groupBy(bin_.alias("bin"), "good").count().collect()
    x = np.array([(r["bin"] + 0.5) * width - training.reach for r in counts])
    y = np.array([float(r["good"]) for r in counts])
    n = np.array([float(r["count"]) for r in counts])
    return curve(x, y, n)


def curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve through weighted points, both classes weighing the same; Newton's method with
    a small pull to zero, so that separable points have a finite answer."""
    if len(set(y.tolist())) < 2:
        return 0.0, 0.0
    n = n / np.where(y > 0, n[y > 0].sum(), n[y == 0].sum())
    scale = np.abs(x).max() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    pull = np.diag([1e-4, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + pull, a.T @ (n * (y - p)) - pull @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def evidence(rows: DataFrame, good: bytes, bad: bytes, training: Training) -> DataFrame:
    """``(key, empty, evidence)`` of ``rows (key, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Evidence(good, bad, training)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            columns = [batch.column(0), pa.array([not t for t in texts], pa.bool_()), pa.array(map(measure, texts), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "empty", "evidence"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, empty boolean, evidence double")


def score(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    training: Training = Training(),
) -> DataFrame:
    """One row per document: key, ``held_out``, ``score``, ``predicted``. Texts are compressed once and never shuffled."""
    rows = docs.select(named(key).alias("key"), named(text).alias("text"))
    marks = labels_of(labels, key, label)
    learned = dictionaries(rows, marks, training)
    if learned is None:
        empty = F.coalesce(F.length("text"), F.lit(0)) == 0
        scored = rows.select("key", F.when(empty, 0.0).otherwise(0.5).alias("score"))
    else:
        measured = stored(evidence(rows, *learned, training), "evidence")
        slope, bias = calibrated(measured, marks, training)
        z = F.col("evidence") * slope + bias
        scored = measured.select("key", F.when(F.col("empty"), 0.0).otherwise(1 / (1 + F.exp(-z))).alias("score"))
    return scored.select(
        F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
