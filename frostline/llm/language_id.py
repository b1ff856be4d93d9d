"""Language identification by prediction by partial matching: which language's model codes a text shortest.

Method: for each language a variable-order byte context tree holds, for every context of up to ``ORDER`` bytes, how
often each byte followed it. A byte is coded in the longest context that has been seen; a byte that never followed it
costs an escape (method C: distinct followers over followers and distinct followers) and is coded in the next shorter
context, down to 1 in 256. The statistics are frozen after learning, so a text's code length is a sum over its bytes,
exact to floating point, and the byte at any place costs what its last ``ORDER + 1`` bytes say. The trees are flattened
to one table per order with the cost of every byte sequence any language has seen, escapes included, and texts are
coded by looking up all their places at once.

Bounds: each language learns from about ``per_language`` whole texts of at most ``max_chars`` characters (a share of its
keys by hash, all of them if there are fewer); ``max_languages`` is the most languages there can be. Counting is distributed; what comes to the
driver is at most the sequences of that sample.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Equal code
lengths: the first code in alphabetical order. The score is the probability of the language given the text when all are
equally likely beforehand. Extra columns are ignored, repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm.common import named

ORDER = 4
#: What stands before the first byte of a text.
BEFORE = b"\n" * ORDER
#: Places coded at once: bounds memory for texts of any length.
BLOCK = 1 << 20


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sequences(data: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes at every place of ``data`` from ``ORDER`` on, as numbers."""
    out = np.zeros(len(data) - ORDER, np.uint64)
    for k in range(length):
        out = (out << np.uint64(8)) | data[ORDER - length + 1 + k : len(data) - length + 1 + k]
    return out


def counts(docs: DataFrame) -> DataFrame:
    """``(lang, length, sequence, n)`` over ``docs (lang, text)``: byte sequences of 1 to ``ORDER + 1`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text.encode())
            for lang, held in texts.items():
                parts = [np.frombuffer(BEFORE + t, np.uint8) for t in held]
                for length in range(1, ORDER + 2):
                    found, n = np.unique(np.concatenate([sequences(p, length) for p in parts]), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found), pa.string()), pa.array(np.full(len(found), length, np.int32)),
                         pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))],
                        ["lang", "length", "sequence", "n"])

    schema = "lang string, length int, sequence long, n long"
    return docs.mapInArrow(run, schema).groupBy("lang", "length", "sequence").agg(F.sum("n").alias("n"))


class Model:
    """Flattened trees. For each length: the sorted sequences any language saw, and what their last byte costs in bits
    in every language. For contexts: what an escape costs."""

    def __init__(self, languages: list[str], seen: dict[str, dict[int, dict[int, int]]]):
        self.languages = languages
        k = len(languages)
        self.costs: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64), np.full((1, k), 8.0))]
        self.escapes: list[tuple[np.ndarray, np.ndarray]] = []
        for length in range(1, ORDER + 2):
            every = np.unique(np.concatenate([np.array(list(seen[x][length]), np.uint64) for x in languages]))
            contexts = np.unique(every >> np.uint64(8))
            escape = np.zeros((len(contexts) + 1, k))  # last row: a context nobody has seen costs nothing
            cost = np.zeros((len(every) + 1, k))
            # Cost in shorter contexts, by the same lookup that coding uses.
            shorter = self._lookup(length - 1, every & np.uint64((1 << 8 * (length - 1)) - 1)) if length > 1 else np.full((len(every), k), 8.0)
            where = np.searchsorted(contexts, every >> np.uint64(8))
            for j, lang in enumerate(languages):
                own = seen[lang][length]
                n = np.array([own.get(s, 0) for s in every.tolist()], float)
                total = np.bincount(where, weights=n, minlength=len(contexts))
                distinct = np.bincount(where, weights=n > 0, minlength=len(contexts))
                with np.errstate(divide="ignore"):
                    escape[:-1, j] = np.where(total > 0, np.log2(np.maximum(total + distinct, 1)) - np.log2(np.maximum(distinct, 1)), 0.0)
                    direct = np.log2(np.maximum(total + distinct, 1))[where] - np.log2(np.maximum(n, 1e-300))
                cost[:-1, j] = np.where(n > 0, direct, escape[where, j] + shorter[:, j])
            self.escapes.append((contexts, escape.astype(np.float32)))
            self.costs.append((every, cost.astype(np.float32)))
        # Sequences of full length through a table by hash: slots hold the first match, the rest go by search.
        self.bits = max(10, int(np.ceil(np.log2(len(self.costs[-1][0]) * 4 + 1))))
        self.slots = np.full(1 << self.bits, len(self.costs[-1][0]), np.int64)
        every = self.costs[-1][0]
        self.slots[self._slot(every)[::-1]] = np.arange(len(every))[::-1]
        self.keys = np.append(every, np.uint64(0xFFFFFFFFFFFFFFFF))

    def _slot(self, sequence: np.ndarray) -> np.ndarray:
        return (sequence * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def _lookup(self, length: int, sequence: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each sequence of ``length`` bytes, in every language."""
        if length == 0:
            return np.full((len(sequence), len(self.languages)), 8.0, np.float32)
        every, cost = self.costs[length]
        at = np.searchsorted(every, sequence)
        hit = every[np.minimum(at, len(every) - 1)] == sequence
        out = np.empty((len(sequence), len(self.languages)), np.float32)
        out[hit] = cost[at[hit]]
        missed = sequence[~hit]
        if len(missed):
            out[~hit] = self._escaped(length, missed)
        return out

    def _escaped(self, length: int, missed: np.ndarray) -> np.ndarray:
        contexts, escape = self.escapes[length - 1]
        above = missed >> np.uint64(8)
        at = np.minimum(np.searchsorted(contexts, above), len(contexts) - 1)
        at = np.where(contexts[at] == above, at, len(contexts))
        return escape[at] + self._lookup(length - 1, missed & np.uint64((1 << 8 * (length - 1)) - 1))

    def bits_of(self, data: np.ndarray) -> np.ndarray:
        """Bits of every place of ``data`` from ``ORDER`` on, in every language."""
        sequence = sequences(data, ORDER + 1)
        at = self.slots[self._slot(sequence)]
        out = self.costs[-1][1][at]
        missed = np.nonzero(self.keys[at] != sequence)[0]
        if len(missed):
            found, inverse = np.unique(sequence[missed], return_inverse=True)
            out[missed] = self._lookup(ORDER + 1, found)[inverse]
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of every text in every language, in bits."""
        out = np.zeros((len(texts), len(self.languages)))
        data = np.frombuffer(b"".join(BEFORE + t for t in texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(sizes + ORDER)])
        owner_start = starts[:-1]
        for k in range(0, len(data) - ORDER, BLOCK):
            bits = self.bits_of(data[k : k + BLOCK + ORDER])
            # Place i of the block is byte k + i + ORDER; places of BEFORE belong to no text.
            first = np.searchsorted(owner_start, k, "right") - 1
            last = np.searchsorted(owner_start, k + len(bits) + ORDER, "left")
            for t in range(first, last):
                a, b = owner_start[t] + ORDER - ORDER - k, owner_start[t] + sizes[t] - k
                a, b = max(0, a), min(len(bits), b)
                if b > a:
                    out[t] += bits[a:b].sum(axis=0, dtype=np.float64)
        return out


def learn(docs: DataFrame, key: str, text: str, language: str, per_language: int = 300, max_chars: int = 20_000, max_languages: int = 256) -> Model | None:
    rows = docs.select(named(key).alias("key"), named(text).alias("text"), named(language).alias("lang"))
    rows = rows.where(~held_out(F.col("key")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= max_chars))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(max_languages + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(sizes)
    # Each language's share of its keys, by hash: the sample never passes through one task.
    limit = F.lit(0)
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, int(min(1.0, per_language / n) * (1 << 30))).otherwise(limit)
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < limit).select("lang", "text")
    seen: dict[str, dict[int, dict[int, int]]] = {x: {n: {} for n in range(1, ORDER + 2)} for x in languages}
    for r in counts(sample).toLocalIterator():
        seen[r["lang"]][r["length"]][r["sequence"]] = r["n"]
    return Model(languages, seen)


def predict(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", **bounds: int) -> DataFrame:
    """One row per document: key, ``held_out``, ``lang_pred``, ``score``."""
    spark: SparkSession = docs.sparkSession
    model = learn(docs, key, text, language, **bounds)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            judged = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if known else []
            if judged:
                bits = known.lengths([texts[i].encode() for i in judged])
                best = bits.argmin(axis=1)
                odds = np.exp2(np.minimum(0, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
                for i, b, o in zip(judged, best.tolist(), odds.tolist()):
                    names[i], scores[i] = known.languages[b], 1.0 / o
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(named(key).alias("key"), named(text).alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double")
    return made.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "lang_pred", "score")
