"""Scores texts with a probabilistic suffix tree over words, learned from the corpus.

Method: the states of the tree are contexts, the last one to ``DEPTH`` words before a token. A context that the training
texts hold ``least`` times or more is tested for divergence: the log-likelihood that its next-symbol distribution gains
on that of its suffix (the context without its oldest word), summed over its occurrences, each one left out of the
counts that judge it. That is the number of occurrences times the divergence, without what chance alone would give. It
is kept if it gains ``gain`` nats at least, with the weight of the suffix (one of ``WEIGHTS``) that gains most. The
distribution of a kept context is smoothed with that of its longest kept suffix,
``(c(s, w) + weight * P(w | suffix)) / (c(s) + weight)``, down to the empty context,
``(c(w) + 0.1) / (N + 0.1 (V + 1))``. A token is scored in the longest kept context that ends before it. ``least``
is the same for a corpus of any size, so that the tree grows with it.

How it runs: texts become chunks of about ``CHUNK`` tokens, written once as numbers. Chunks ask and ranges answer. A
chunk packs its distinct n-grams, as sorted 64-bit hashes with their counts, by range of hash; one task sums a range over
all chunks and answers every chunk in the order it asked. Contexts are asked about in the same way: their gains are
summed, the answer is the weight or none. So a chunk sends each distinct n-gram once however frequent it is, ranges of a
hash are even, and neither the counts nor the tree is ever gathered in one place. Contexts longer than a word are only
counted where the shorter one occurs ``least`` times, which loses none that could be kept. Chunks and answers are
written tables, so a lost executor costs its tasks. Two n-grams of n distinct ones share a hash with chance n^2 / 2^65.

Defined results: a null text is empty; an empty one is its end alone. A null key is neither learned from nor held out.
Rows are scored each on its own, repeated ones alike; extra columns are ignored. Without training tokens every score is
0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import bucketed, named, stored

#: Words of the longest context.
DEPTH = 3
#: Occurrences from which a context is tested.
LEAST = 16
#: Tokens of a chunk and, about, of all chunks in a range.
CHUNK, RANGE = 1 << 21, 1 << 22
#: Weights of the suffix to choose from, and the one that stands for a suffix before the weights are chosen.
WEIGHTS = (4.0, 64.0, 1024.0)
USUAL = 64.0

_ASKED = "level int, chunk long, range int, keys binary, sums binary"
_ANSWERED = "level int, chunk long, range int, answer binary, distinct long, total double"


def packed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: planes that hardly change cost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T if len(values) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def extended(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of contexts followed by a word."""
    x = (context ^ (context >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_END = xxhash.xxh64_intdigest(b"")  # no word is empty


def _chunked(kind: pa.DataType) -> Callable:
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        keys, learned, tokens, size = [], [], [], 0
        local: defaultdict = defaultdict()
        local.default_factory = local.__len__

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in local), np.uint64, len(local))
            lengths = np.fromiter(map(len, tokens), np.uint32, len(tokens))
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 32) + made], pa.int64()), pa.array([size], pa.int64()), pa.array([keys], pa.list_(kind)),
                pa.array([packed(np.array(learned, np.int8))]), pa.array([packed(lengths)]),
                pa.array([packed(np.concatenate(tokens))]), pa.array([packed(hashes)]),
            ], ["chunk", "tokens", "keys", "learned", "lengths", "places", "hashes"])

        for batch in batches:
            for key, text, learn in zip(*(c.to_pylist() for c in batch.columns)):
                words = (text or "").encode().lower().split()
                words.append(b"")
                tokens.append(np.fromiter(map(local.__getitem__, words), np.uint32, len(words)))
                keys.append(key)
                learned.append(-1 if learn is None else int(learn))
                size += len(words)
                if size >= CHUNK:
                    yield flush()
                    made += 1
                    keys, learned, tokens, size = [], [], [], 0
                    local.clear()
        if keys:
            yield flush()

    return chunks


class Grams:
    """A chunk's tokens with the n-grams that end at them, as far as they have been asked about and answered."""

    def __init__(self, row: dict, least: int):
        self.chunk, self.least = row["chunk"], least
        self.keys = row["keys"]
        self.lengths = unpacked(row["lengths"], np.uint32).astype(np.int64)
        self.state = unpacked(row["learned"], np.int8)
        self.word = unpacked(row["hashes"], np.uint64)[unpacked(row["places"], np.uint32)]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.learned = np.repeat(self.state == 1, self.lengths)
        self.place = np.arange(len(self.word)) - np.repeat(self.starts, self.lengths)
        self.hashes = [self.word]
        self.counts: list[np.ndarray] = []

    def asked(self, level: int) -> np.ndarray:
        """Where n-grams of ``level`` words of context are asked about."""
        if level == 0:
            return np.arange(len(self.word))
        long = self.place >= level
        if level > 1:
            long[1:] &= self.counts[level - 1][:-1] >= self.least
        return np.flatnonzero(long)

    def grams(self, level: int) -> np.ndarray:
        while len(self.hashes) <= level:
            shorter = self.hashes[-1]
            longer = np.zeros_like(shorter)
            longer[1:] = extended(shorter[:-1], self.word[1:])
            self.hashes.append(longer)
        return self.hashes[level]

    def told(self, level: int, totals: np.ndarray) -> None:
        at = self.asked(level)
        _, inverse = np.unique(self.grams(level)[at], return_inverse=True)
        counts = np.zeros(len(self.word))
        counts[at] = totals[inverse]
        self.counts.append(counts)

    def contexts(self, level: int) -> np.ndarray:
        """Where the context of ``level`` words is frequent enough to be a state."""
        at = self.asked(level)
        return at[self.counts[level - 1][at - 1] >= self.least]

    def requests(self, level: int, ranges: int) -> list[tuple]:
        at = self.asked(level)
        keys, inverse = np.unique(self.grams(level)[at], return_inverse=True)
        return _requests(level, self.chunk, keys, [np.bincount(inverse, self.learned[at], len(keys))], ranges)


def _requests(level: int, chunk: int, keys: np.ndarray, sums: list[np.ndarray], ranges: int) -> list[tuple]:
    """Sorted keys and their sums as one row for every range of keys."""
    of = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    ends = np.searchsorted(of, np.arange(1, ranges + 1).astype(np.uint64))
    rows, begin = [], 0
    for r, end in enumerate(ends.tolist()):
        if end > begin:
            held = keys[begin:end]
            gaps = np.diff(held, prepend=np.uint64(0))
            columns = np.stack([s[begin:end] for s in sums]).astype(np.float32)
            rows.append((level, chunk, r, packed(gaps), packed(columns.ravel())))
        begin = end
    return rows


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)


def _asking(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return _rows(rows, ["level", "chunk", "range", "keys", "sums"], kinds)


def _summed(choose: Callable[[np.ndarray], np.ndarray], kind) -> Callable[[pa.Table], pa.Table]:
    """A range: the sums of every key over all chunks, and ``choose`` of them told to each chunk in its own order."""

    def answer(asked: pa.Table) -> pa.Table:
        asked = asked.sort_by("chunk")
        parts = [np.cumsum(unpacked(b, np.uint64), dtype=np.uint64) for b in asked["keys"].to_pylist()]
        sums = [unpacked(b, np.float32).reshape(-1, len(p)) for b, p in zip(asked["sums"].to_pylist(), parts)]
        keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        values = np.concatenate(sums, axis=1)
        totals = np.stack([np.bincount(inverse, column, len(keys)) for column in values])
        chosen = choose(totals).astype(kind)
        ends = np.cumsum([len(p) for p in parts])
        level, r = asked["level"][0].as_py(), asked["range"][0].as_py()
        rows = [
            (level, chunk, r, packed(chosen[inverse[end - len(p) : end]]), 0, 0.0)
            for chunk, p, end in zip(asked["chunk"].to_pylist(), parts, ends.tolist())
        ]
        rows[0] = (*rows[0][:4], int((totals[0] > 0).sum()), float(totals[0].sum()))
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.float64()]
        return pa.Table.from_batches([_rows(rows, ["level", "chunk", "range", "answer", "distinct", "total"], kinds)])

    return answer


def _answers(requests: DataFrame, choose: Callable, kind, purpose: str) -> DataFrame:
    return stored(requests.groupBy("level", "range").applyInArrow(_summed(choose, kind), _ANSWERED), purpose)


def _heard(answers: pa.Table, kind) -> dict[int, np.ndarray]:
    """What a chunk was told about each level, in the order it asked."""
    answers = answers.select(["level", "range", "answer"]).sort_by([("level", "ascending"), ("range", "ascending")])
    heard: dict[int, list[np.ndarray]] = {}
    for level, blob in zip(answers["level"].to_pylist(), answers["answer"].to_pylist()):
        heard.setdefault(level, []).append(unpacked(blob, kind))
    return {level: np.concatenate(parts) for level, parts in heard.items()}


def _told_grams(chunk: pa.Table, counts: pa.Table, least: int, levels: int) -> Grams:
    grams = Grams(chunk.to_pylist()[0], least)
    heard = _heard(counts, np.float64)
    for level in range(levels):
        grams.told(level, heard.get(level, np.zeros(0)))
    return grams


def _base(counts: np.ndarray, total: float, distinct: int) -> np.ndarray:
    return (counts + 0.1) / (total + 0.1 * (distinct + 1))


def _gains(grams: Grams, depth: int, total: float, distinct: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Per level the contexts, and what each weight gains on the suffix over their training occurrences."""
    suffix = _base(np.maximum(grams.counts[0] - 1, 0), max(total - 1, 0), distinct)
    for level in range(1, depth + 1):
        at = grams.contexts(level)
        states, inverse = np.unique(grams.hashes[level - 1][at - 1], return_inverse=True)
        learned = grams.learned[at]
        at, inverse = at[learned], inverse[learned]  # contexts that only held-out texts of the chunk have are asked about too
        others, of = grams.counts[level][at] - 1, grams.counts[level - 1][at - 1] - 1
        yield level, states, [
            np.bincount(inverse, np.log((others / suffix[at] + w) / (of + w)), len(states)) for w in WEIGHTS
        ]
        suffix[at] = (others + USUAL * suffix[at]) / (of + USUAL)


def _scored(grams: Grams, weights: dict[int, np.ndarray], total: float, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Probability of every token: in the empty context, and in the longest kept one."""
    base = _base(grams.counts[0], total, distinct)
    chance = base.copy()
    for level, told in sorted(weights.items()):
        at = grams.contexts(level)
        _, inverse = np.unique(grams.hashes[level - 1][at - 1], return_inverse=True)  # as asked
        kept = told[inverse]
        at, weight = at[kept > 0], np.array((0.0, *WEIGHTS))[kept[kept > 0]]
        chance[at] = (grams.counts[level][at] + weight * chance[at]) / (grams.counts[level - 1][at - 1] + weight)
    return base, chance


def score(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", depth: int = DEPTH, least: int = LEAST,
    gain: float = 10.0,
) -> DataFrame:
    """Score all ``docs``, learning from those where ``learn`` is true: key, held_out (``learn`` is false), n_tokens,
    n_known, train_tokens, base_score, score (both log10 of a probability)."""
    kind = docs.schema[key].dataType
    arrow = docs.select(named(key)).limit(0).toArrow().schema.field(0).type
    spelled = kind.simpleString()
    rows = docs.select(named(key).alias("key"), named(text).alias("text"), learn.alias("learn"))
    chunks = bucketed(rows.mapInArrow(
        _chunked(arrow),
        f"chunk long, tokens long, keys array<{spelled}>, learned binary, lengths binary, places binary, hashes binary",
    ), "chunk", "suffix-tree-chunks")
    ranges = max(1, -(-(chunks.agg(F.sum("tokens")).first()[0] or 0) // RANGE))

    def first_requests(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row, 0)
                for level in range(min(depth, 1) + 1):
                    yield _asking(grams.requests(level, ranges))

    def counted(level: int):
        def requests(chunk: pa.Table, counts: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_asking(_told_grams(chunk, counts, least, level).requests(level, ranges))])

        return requests

    def whole(sums: np.ndarray) -> np.ndarray:
        return sums[0]

    counts = _answers(chunks.mapInArrow(first_requests, _ASKED), whole, np.float64, "suffix-tree-counts")
    total, distinct = counts.where("level = 0").agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = int(total or 0), int(distinct or 0)
    for level in range(2, depth + 1):
        asked = chunks.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(counted(level), _ASKED)
        counts = counts.unionByName(_answers(asked, whole, np.float64, f"suffix-tree-counts-{level}"))

    def gained(chunk: pa.Table, told: pa.Table) -> pa.Table:
        grams = _told_grams(chunk, told, least, depth + 1)
        found = _gains(grams, depth, total, distinct)
        return pa.Table.from_batches([_asking([r for level, states, sums in found for r in _requests(level, grams.chunk, states, sums, ranges)])])

    def kept(sums: np.ndarray) -> np.ndarray:
        return np.where(sums.max(axis=0) >= gain, sums.argmax(axis=0) + 1, 0)

    tests = chunks.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(gained, _ASKED)
    weights = _answers(tests, kept, np.int8, "suffix-tree-weights")

    def result(chunk: pa.Table, told: pa.Table) -> pa.Table:
        weighed = told["weighed"].to_pylist()
        grams = _told_grams(chunk, told.filter(pa.array([not w for w in weighed])), least, depth + 1)
        heard = _heard(told.filter(pa.array(weighed)), np.int8)
        base, chance = _scored(grams, heard, total, distinct)
        known = np.add.reduceat((grams.counts[0] > 0).astype(np.int64), grams.starts)
        return pa.table({
            "key": pa.array(grams.keys, arrow), "held_out": pa.array(grams.state == 0), "n_tokens": grams.lengths, "n_known": known,
            "base_score": np.add.reduceat(np.log10(base), grams.starts), "score": np.add.reduceat(np.log10(chance), grams.starts),
        })

    every = counts.withColumn("weighed", F.lit(False)).unionByName(weights.withColumn("weighed", F.lit(True)))
    scored = chunks.groupBy("chunk").cogroup(every.groupBy("chunk")).applyInArrow(
        result, f"key {spelled}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def score_by_key(docs: DataFrame) -> DataFrame:
    """All documents, learning from those whose key's CRC-32 does not end in 0."""
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0)
