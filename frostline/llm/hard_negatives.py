"""Hard negatives by rotated one-bit codes with stored code-vector alignment.

An anchor's positives are the rows of its label with the largest inner products; for each positive, its hard negatives
are the rows of other labels whose inner product with the anchor lies within a share of the positive's and nearest to it.

Method: components are scaled to integers, and a row's score is the integer inner product with the anchor. All rows are
rotated by one random orthogonal matrix. Of a rotated row ``o`` only the signs are kept, as the unit vector ``x`` of
entries ``+-1/sqrt(d)``, with the alignment ``a = <o, x>`` and the length of the residual ``r = o - a x``, which is
orthogonal to ``x``. The anchor is rotated and quantised to ``PLANES`` bit planes, so that ``t = <q, x>`` is estimated by
popcounts of the planes with the code, wrong by no more than the length of the quantisation error. As
``<q, o> = a t + <q - t x, r>``, Cauchy-Schwarz bounds the score by ``a t +- sqrt(|q|^2 - t^2) |r|``, always, not
with some probability. Rows whose interval cannot reach what is asked for are dropped: below the k-th exact score of the
rows with the best estimates, or outside the positive's window. The others are scored in integers, so results are exact.

Scale: anchors are a stated set of queries against all rows, in cells of ``ANCHORS`` anchors and ``ROWS`` rows; both sides
are dealt by a hash of the row's number, so labels and copies of any size spread evenly and no cell grows. A cell returns
at most ``k`` rows for each question, and the best of the cells are found by windows whose limit Spark applies before the
shuffle too. Work is anchors times rows, memory one cell.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part. Shorter vectors
count as filled up with zeros. A null key is no anchor and comes last among equal scores. Repeated rows are rows of
their own: a copy of an anchor is another row, and copies are returned as often as they occur. Components saturate at
64 bits; scores beyond 64 bits saturate as well. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.common import named, stored

#: Anchors and rows of one cell.
ANCHORS, ROWS = 1024, 8192
#: Bits kept of an anchor's rotated components.
PLANES = 6
SEED = 20
_LARGEST = (1 << 63) - 1


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def codes(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs of the rotated rows, packed; alignment with them; length of the residual."""
    turned = vectors @ turn
    signs = turned >= 0
    aligned = np.abs(turned).sum(axis=1) / np.sqrt(max(turned.shape[1], 1))
    rest = np.sqrt(np.maximum((vectors * vectors).sum(axis=1) - aligned**2, 0))
    return np.packbits(signs, axis=1, bitorder="little"), aligned, rest


def words(packed: np.ndarray) -> np.ndarray:
    """Packed bytes as 64-bit words."""
    wide = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


class Question:
    """An anchor as the popcounts see it: bit planes of its rotated components, and the length of what they leave out."""

    def __init__(self, vector: np.ndarray, turn: np.ndarray):
        turned = vector @ turn
        self.dims = len(turned)
        self.low = turned.min() if self.dims else 0.0
        self.step = (turned.max() - self.low) / (2**PLANES - 1) if self.dims else 0.0
        level = np.rint((turned - self.low) / self.step).astype(np.uint8) if self.step > 0 else np.zeros(self.dims, np.uint8)
        self.planes = [words(np.packbits((level >> j & 1)[None, :], axis=1, bitorder="little"))[0] for j in range(PLANES)]
        self.total = self.low * self.dims + self.step * float(level.sum())
        self.error = float(np.linalg.norm(turned - (self.low + self.step * level)))
        self.length = float(np.linalg.norm(vector))

    def bounds(self, code: np.ndarray, aligned: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimate, least and largest possible score of the rows with these codes."""
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        positive = self.low * ones
        for j, plane in enumerate(self.planes):
            positive = positive + self.step * (1 << j) * np.bitwise_count(code & plane).sum(axis=1, dtype=np.int64)
        t = (2 * positive - self.total) / np.sqrt(max(self.dims, 1))
        nearest = np.maximum(np.abs(t) - self.error, 0)
        reach = aligned * self.error + np.sqrt(np.maximum(self.length**2 - nearest**2, 0)) * rest
        reach = reach * (1 + 1e-9) + 1e-9 * self.length * (aligned + rest) + 1e-6
        return aligned * t, aligned * t - reach, aligned * t + reach


def scores(vectors: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; beyond 64 bits they saturate."""
    if not len(vectors) or not len(anchor):
        return np.zeros(len(vectors), np.int64)
    bound = float(np.abs(vectors.astype(float)).max()) * float(np.abs(anchor.astype(float)).max()) * len(anchor)
    if bound < 2.0**52:
        return (vectors.astype(float) @ anchor.astype(float)).astype(np.int64)
    if bound < 2.0**62:
        return vectors @ anchor
    whole = anchor.astype(object)
    return np.array([max(-_LARGEST - 1, min(_LARGEST, int(row.astype(object) @ whole))) for row in vectors], np.int64)


def first(score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by falling score, then by rank."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
        return near[np.lexsort((rank[near], ~score[near]))][:k]
    return np.lexsort((rank, ~score))[:k]


class Cell:
    """The rows of one cell, in order of their keys (null last), so that a place is also a rank."""

    def __init__(self, rows: pa.Table, dims: int):
        rows = rows.sort_by([("vec_id", "ascending"), ("uid", "ascending")])  # null keys last
        n = rows.num_rows
        self.uid, self.label = rows["uid"].to_numpy(), rows["label"].to_numpy()
        self.key = rows["vec_id"].to_pylist()
        self.vector = np.frombuffer(b"".join(rows["vector"].to_pylist()), "<i8").reshape(n, dims)
        packed = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(n, -(-dims // 8))
        self.code, self.aligned, self.rest = words(packed), rows["aligned"].to_numpy(), rows["rest"].to_numpy()
        self.rank = np.arange(n)

    def nearest(self, ask: Question, anchor: np.ndarray, among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``k`` of the rows ``among`` and their scores."""
        estimate, _, most = ask.bounds(self.code[among], self.aligned[among], self.rest[among])
        if len(among) > k:
            sure = np.argpartition(estimate, len(among) - k)[len(among) - k :]
            among = among[most >= scores(self.vector[among[sure]], anchor).min()]
        exact = scores(self.vector[among], anchor)
        best = first(exact, self.rank[among], k)
        return among[best], exact[best]

    def within(self, ask: Question, anchor: np.ndarray, among: np.ndarray, spans: list[tuple[int, int]], k: int):
        """For every span of scores the first ``k`` of the rows ``among`` and their scores."""
        _, least, most = ask.bounds(self.code[among], self.aligned[among], self.rest[among])
        low, high = min(a for a, _ in spans), max(b for _, b in spans)
        among = among[(np.maximum(most, -(2.0**63)) >= low) & (np.minimum(least, 2.0**63) <= high)]  # scores saturate
        exact = scores(self.vector[among], anchor)
        for low, high in spans:
            held = np.flatnonzero((exact >= low) & (exact <= high))
            best = held[first(exact[held], self.rank[among[held]], k)]
            yield among[best], exact[best]


def scaled(vector: Column, factor: int = 256) -> Column:
    """Components as ``floor(factor * x)``."""
    return F.transform(vector, lambda x: F.floor(factor * x.cast("double")))


def _finite(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(whole, F.lit(False))


def encode(rows: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """Rows that take part, written: uid, vec_id, label, integer vector, code, alignment, residual; and the dimension."""
    kind = rows.schema[label].dataType.simpleString()
    valid = rows.where(named(label).isNotNull() & _finite(named(vector)))
    plain = valid.select(
        F.monotonically_increasing_id().alias("uid"), named(key).cast("long").alias("vec_id"), named(label).alias("label"),
        scaled(named(vector)).alias("ints"),
    )
    dims = int(valid.agg(F.max(F.size(named(vector)))).first()[0] or 0)

    def coded(batches):
        turn = rotation(dims)
        for batch in batches:
            n = batch.num_rows
            ints = batch.column("ints")
            vectors = np.zeros((n, dims), np.int64)
            lengths = np.diff(ints.offsets.to_numpy())
            vectors[np.arange(dims)[None, :] < lengths[:, None]] = ints.flatten().to_numpy()
            code, aligned, rest = codes(vectors.astype(float), turn)
            yield pa.RecordBatch.from_arrays([
                batch.column("uid"), batch.column("vec_id"), batch.column("label"),
                pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([c.tobytes() for c in code], pa.binary()),
                pa.array(aligned), pa.array(rest),
            ], ["uid", "vec_id", "label", "vector", "code", "aligned", "rest"])

    schema = f"uid long, vec_id long, label {kind}, vector binary, code binary, aligned double, rest double"
    return stored(plain.mapInArrow(coded, schema), "codes"), dims


def _cells(rows: DataFrame, anchors: DataFrame, answer: Callable, schema: str) -> DataFrame:
    """``answer(anchors, rows)`` for every cell of anchors and rows."""
    across = max(1, -(-anchors.count() // ANCHORS))
    down = max(1, -(-rows.count() // ROWS))
    dealt = F.xxhash64("uid")
    left = anchors.withColumn("_a", F.pmod(dealt, F.lit(across))).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = rows.withColumn("_r", F.pmod(dealt, F.lit(down)).cast("int")).withColumn(
        "_a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long")))
    )
    left, right = (side.toDF(*side.columns) for side in (left, right))  # both come from one table
    return left.groupBy("_a", "_r").cogroup(right.groupBy("_a", "_r")).applyInArrow(answer, schema)


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)


def _find_positives(dims: int, k: int):
    def answer(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            cell, turn = Cell(rows, dims), rotation(dims)
            for uid, label, raw in zip(*(anchors[c].to_pylist() for c in ("uid", "label", "vector"))):
                vector = np.frombuffer(raw, "<i8")
                among = np.flatnonzero((cell.label == label) & (cell.uid != uid))
                places, exact = cell.nearest(Question(vector.astype(float), turn), vector, among, k)
                out += [(uid, int(cell.uid[p]), cell.key[p], int(s)) for p, s in zip(places, exact)]
        return _table(out, ["uid", "positive_uid", "positive_id", "positive_score"], [pa.int64()] * 4)

    return answer


def _find_negatives(dims: int, k: int, low: int, high: int):
    def answer(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            cell, turn = Cell(rows, dims), rotation(dims)
            for uid, label, raw, positives in zip(*(anchors[c].to_pylist() for c in ("uid", "label", "vector", "positives"))):
                vector = np.frombuffer(raw, "<i8")
                spans = [(-(-low * p // 100), high * p // 100) for p in positives]
                among = np.flatnonzero(cell.label != label)
                found = cell.within(Question(vector.astype(float), turn), vector, among, spans, k)
                for turn_of, (places, exact) in enumerate(found):
                    out += [(uid, turn_of, int(cell.uid[p]), cell.key[p], int(s)) for p, s in zip(places, exact)]
        names = ["uid", "turn", "negative_uid", "negative_id", "negative_score"]
        return _table(out, names, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])

    return answer


def mine(
    rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5,
    negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """For each anchor (a condition on ``vec_id``) and positive its hard negatives: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score. A negative's score is from ``low`` to ``high`` hundredths of the
    positive's."""
    coded, dims = encode(rows, key, vector, label)
    asked = coded.where(anchor)
    near = _cells(coded, asked, _find_positives(dims, positives), "uid long, positive_uid long, positive_id long, positive_score long")
    order = Window.partitionBy("uid").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_uid")
    best = stored(near.withColumn("turn", F.row_number().over(order) - 1).where(F.col("turn") < positives), "positives")

    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "positive_score"))), lambda p: p["positive_score"])
    questions = asked.join(best.groupBy("uid").agg(turns.alias("positives")), "uid")
    hard = _cells(coded, questions, _find_negatives(dims, negatives, low, high), "uid long, turn int, negative_uid long, negative_id long, negative_score long")
    rank = Window.partitionBy("uid", "turn").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_uid")
    ranked = hard.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= negatives)
    names = asked.select("uid", F.col("vec_id").alias("anchor_id"))
    return ranked.join(best, ["uid", "turn"]).join(names, "uid").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def relabelled(rows: DataFrame) -> DataFrame:
    """The table with some labels wrong on purpose: where 7 divides the key, the label moves on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", "embedding", moved.alias("label"))
