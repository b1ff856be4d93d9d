"""Benchmark decontamination by latent semantic retrieval, for copies and paraphrases of benchmark items.

Method: words weigh by inverse document frequency, counted over all documents (words hashed to ``DIMENSIONS`` slots).
The TF-IDF rows of the benchmark items and of all passages of all documents, over the words of the benchmark, get
a randomised singular value decomposition: the partial products of all rows are made in tasks and summed by Spark,
the driver only orthogonalises matrices of (benchmark words x rank). Every document is cut into overlapping passages of
several lengths. An item of whose words a stretch of the document and its surroundings hold too few cannot have a common
subsequence with it that counts, and is out there (whatever the words weigh that stand in their place); passages are
compared in the latent space with the items of their length that are left, and those of a high cosine are candidates.
A candidate counts if the longest common subsequence of item and passage surroundings holds
enough of the item's words, and enough of its answer's (its last sentence, and at least its last quarter).

A passage's vector is the sum of the weights of its words.

Scale: the benchmark is the stated query set. It is worked off in blocks of at most ``block_words`` words; each block's
matrix (that many words times the rank) is what is broadcast, whatever the size of the benchmark or the corpus.
Documents are not shuffled. Their words are hashed once and written, eight bytes a word before compression; the counts,
each round of the decomposition and the matching read the hashes.

Defined results: null and empty texts and items match nothing, nor do items of fewer than ``min_words`` words. Repeated
documents are judged each. Equal items: all are reported. Extra columns are ignored by ``matches``, kept by ``clean``.
Empty documents or an empty benchmark: no matches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm.common import free_name, named, stored

DIMENSIONS = 1 << 16
#: Passages projected at once.
WINDOWS = 512
#: Words of a stretch, as a multiple of the longest item.
STRETCH = 4
#: Characters of texts hashed at once.
PIECE = 1 << 20
#: Words multiplied at once, and passages of a word summed at once.
PRODUCT, LINE = 1 << 18, 32
PUNCTUATION = ".,;:!?\"()[]{}«»¿¡“”„…"


@dataclass(frozen=True)
class Settings:
    """Parameters."""

    lengths: tuple[int, ...] = (8, 16, 32)
    min_words: int = 8
    cosine: float = 0.5
    common: float = 0.65
    answer: float = 0.5
    rank: int = 64
    rounds: int = 2
    block_words: int = 100_000


def words_of(text: str) -> list[str]:
    """Lower-case words without punctuation."""
    text = text.lower()
    for mark in PUNCTUATION:
        if mark in text:
            text = text.replace(mark, " ")
    return text.split()


DELIMITERS = np.zeros(256, bool)
DELIMITERS[list(b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f" + bytes(ord(c) for c in PUNCTUATION if c.isascii()))] = True
WIDE = [c for c in PUNCTUATION if not c.isascii()]
ODD = 0x9E3779B97F4A7C15


class Words:
    """Hashes of the words of texts, the same words as ``words_of``'s, made for many texts at once.

    The hash of a word is a polynomial in its bytes, taken from sums over the whole run of texts; it stands for the word
    everywhere after this.
    """

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, odd, np.uint64)])) for odd in (ODD, pow(ODD, -1, 1 << 64))
            )

    def _run(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all pieces, and how many words stand before the end of each."""
        data = np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)
        self._powers(len(data) + 1)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], DELIMITERS[data]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h, np.searchsorted(starts, np.cumsum([len(x) + 1 for x in pieces]))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        pieces: list[bytes] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            text = text.lower()
            if not text.isascii():
                for mark in WIDE:
                    if mark in text:
                        text = text.replace(mark, " ")
                text = " ".join(text.split())
            at = 0
            while len(text) - at > PIECE and (cut := text.find(" ", at + PIECE)) >= 0:
                pieces.append(text[at:cut].encode())
                owner.append(i)
                at = cut
            pieces.append(text[at:].encode())
            owner.append(i)
        found: list[list[np.ndarray]] = [[] for _ in texts]
        a = 0
        while a < len(pieces):
            b, size = a + 1, len(pieces[a])
            while b < len(pieces) and size + len(pieces[b]) <= PIECE:
                size += len(pieces[b])
                b += 1
            h, ends = self._run(pieces[a:b])
            for i, x, y in zip(owner[a:b], [0, *ends.tolist()], ends.tolist()):
                found[i].append(h[x:y])
            a = b
        return [f[0] if len(f) == 1 else np.concatenate(f) for f in found]


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(DIMENSIONS - 1)).astype(np.int64)


def hashes_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, words)``: the hashes of every row's words, packed; none for a null text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for batch in batches:
            words = hashed([t.as_py() or "" for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.tobytes() for w in words], pa.binary())], ["key", "words"])

    return docs.select(named(key).alias("key"), named(text).alias("text")).mapInArrow(run, f"key {kind}, words binary")


def unpacked(words: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(w, np.uint64) for w in words.to_pylist()]


def document_counts(hashed: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each slot occurs, and the number of documents: at most one row per slot is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for own in unpacked(batch.column(0)):
                total[slot_of(own)] += 1  # once for every slot, however often it is named
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(total[used], rows))], ["slot", "n"])

    found = hashed.select("words").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(DIMENSIONS, np.int64)
    n = dict(zip(found["slot"], found["n"]))
    rows = int(n.pop(-1, 0))
    counts[list(n)] = list(n.values())
    return counts, rows


class Block:
    """The items of one block ``(key, hashes of its words, words of its answer)``, and its words and their weights."""

    def __init__(self, items: list[tuple[object, np.ndarray, int]], idf: np.ndarray, settings: Settings):
        self.settings, self.idf = settings, idf
        self.items = [(key, words.tolist(), answer) for key, words, answer in items]
        self.counts = [Counter(words) for _, words, _ in self.items]
        self.words = np.unique(np.concatenate([words for _, words, _ in items]))
        self.weight = idf[slot_of(self.words)].astype(np.float32)
        #: Passages are compared with the items whose length class is theirs.
        size = lambda words: max([x for x in settings.lengths if x <= len(words)], default=settings.lengths[0])
        self.of_length = {x: [i for i, (_, w, _) in enumerate(self.items) if size(w) == x] for x in settings.lengths}
        self.lengths = [x for x in settings.lengths if self.of_length[x]]
        #: Places of the words of all items, where each item's begin, and how many of them must be about.
        self.flat = self.place(np.concatenate([words for _, words, _ in items]))
        sizes = np.array([len(words) for _, words, _ in items])
        self.begins = np.cumsum(sizes) - sizes
        self.least = settings.common * sizes
        self.longest = int(sizes.max())
        self.rows: np.ndarray | None = None
        self.latent: np.ndarray | None = None

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words among the block's; one past the last for words that are not."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, len(self.words))

    def row(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns and TF-IDF weights of a passage of the block's words."""
        columns, n = np.unique(places, return_counts=True)
        return columns, n * self.weight[columns]

    def set_basis(self, basis: np.ndarray) -> None:
        self.rows = np.concatenate([basis * self.weight[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
        z = np.stack([self.rows[self.place(np.array(words, np.uint64))].sum(axis=0) for _, words, _ in self.items])
        self.latent = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def blocks_of(benchmark: DataFrame, key: str, text: str, idf: np.ndarray, settings: Settings) -> Iterator[Block]:
    """Items in blocks of bounded size; the benchmark is read row by row, never held whole."""
    held: list[tuple[object, np.ndarray, int]] = []
    size, hashed = 0, Words()
    for r in benchmark.select(named(key).alias("key"), named(text).alias("text")).toLocalIterator():
        words = hashed([r["text"] or ""])[0]
        if len(words) < settings.min_words:
            continue
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", r["text"]) if words_of(s)]
        answer = max(len(words_of(sentences[-1])) if len(sentences) > 1 else 1, len(words) // 4)
        if held and size + len(words) > settings.block_words:
            yield Block(held, idf, settings)
            held, size = [], 0
        held.append((r["key"], words, answer))
        size += len(words)
    if held:
        yield Block(held, idf, settings)


def summed(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each line of ``of`` the sum of the rows it names."""
    out = np.empty((len(of), rows.shape[1]), np.float32)
    for k in range(0, len(of), WINDOWS):
        out[k : k + WINDOWS] = np.take(rows, of[k : k + WINDOWS], axis=0).sum(axis=1)
    return out


def add_product(total: np.ndarray, weighted: np.ndarray, passages: np.ndarray) -> None:
    """Add to each word's row of ``total`` the products of the passages it is in with ``weighted``, word by word. A
    passage is a line of ``passages``, the places of its words; places past the last word of ``total`` are no words."""
    n, none = len(total), np.zeros((1, total.shape[1]), np.float32)
    products = np.concatenate([summed(np.concatenate([weighted, none]), passages), none])
    places = passages.ravel()
    known = np.flatnonzero(places < n)
    places = places[known].astype(np.uint16 if n <= 1 << 16 else np.int64)  # short numbers are sorted by radix
    order = np.argsort(places, kind="stable")
    # The passages of a word, in lines of a fixed width; the last is filled up with the empty passage.
    counts = np.bincount(places, minlength=n)
    lines = -(-counts // LINE)
    begins = np.cumsum(lines) - lines
    rank = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    of = np.full(int(lines.sum()) * LINE, len(passages))
    of[np.repeat(begins, counts) * LINE + rank] = known[order] // passages.shape[1]
    used = np.flatnonzero(counts)
    if len(used):
        total[used] += np.add.reduceat(summed(products, of.reshape(-1, LINE)), begins[used], axis=0)


def decompose(spark: SparkSession, block: Block, benchmark: DataFrame, corpus: DataFrame) -> np.ndarray:
    """Right singular vectors of the TF-IDF rows of all passages, by randomised subspace iteration on Spark's
    partitions; both tables have packed ``words``."""
    settings = block.settings
    rank = min(settings.rank, len(block.words))
    rng = np.random.default_rng(7)
    basis = np.linalg.qr(rng.standard_normal((len(block.words), rank)))[0].astype(np.float32)
    rows = benchmark.union(corpus)
    longest = max(settings.lengths)
    step = max(1, PRODUCT // longest) * longest  # ends where a passage does

    for _ in range(settings.rounds):
        sent = spark.sparkContext.broadcast((block, basis))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, q = sent.value
            total, weighted = np.zeros((len(own.words), q.shape[1]), np.float32), own.weight[:, None] * q
            held: list[np.ndarray] = []
            size = 0
            for batch in batches:
                for words in unpacked(batch.column(0)):
                    for low in range(0, len(words), step):
                        part = words[low : low + step]
                        places = np.full(-(-len(part) // longest) * longest, len(own.words))
                        places[: len(part)] = own.place(part)
                        held.append(places.reshape(-1, longest))
                        size += len(places)
                        if size >= PRODUCT:
                            add_product(total, weighted, np.concatenate(held))
                            held, size = [], 0
            if size:
                add_product(total, weighted, np.concatenate(held))
            total *= own.weight[:, None]
            used = np.nonzero(total.any(axis=1))[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(list(total[used]), pa.list_(pa.float32()))], ["place", "part"])

        parts = rows.mapInArrow(run, "place int, part array<float>")
        summed = parts.groupBy("place").agg(F.array(*[F.sum(F.get("part", F.lit(i))) for i in range(rank)]).alias("part"))
        product = np.zeros((len(block.words), rank))
        for r in summed.collect():
            product[r["place"]] = r["part"]
        sent.unpersist()
        basis = np.linalg.qr(product)[0].astype(np.float32)
    return basis


def common_length(item: list, passage: list) -> int:
    """Length of the longest common subsequence, one bit per item word."""
    where: dict = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(item)) - 1
    row = full
    for w in passage:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def candidates(block: Block, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(item, first word, end)`` of passages near an item in the latent space."""
    s = block.settings
    if len(words) < s.min_words:
        return
    place = block.place(words)
    there = np.zeros(len(block.words) + 1, np.int32)
    step, reach = STRETCH * block.longest, block.longest + max(block.lengths) + 2
    for low in range(0, len(words), step):
        # What the surroundings of all passages that start here lack of an item bounds the common subsequence.
        around = place[max(0, low - reach) : low + step + reach]
        there[around] = 1
        there[-1] = 0
        held = np.add.reduceat(there[block.flat], block.begins) >= block.least
        there[around] = 0
        if not held.any():
            continue
        for length in block.lengths:
            items = [i for i in block.of_length[length] if held[i]]
            if not items:
                continue
            last = max(0, len(words) - length)
            starts = np.arange(-(-low // (length // 4)) * (length // 4), min(last + 1, low + step), length // 4)
            if last % (length // 4) and low <= last < low + step:
                starts = np.append(starts, last)
            ends = np.minimum(starts + length, len(words))
            for k in range(0, len(starts), WINDOWS):
                a, b = starts[k : k + WINDOWS], ends[k : k + WINDOWS]
                z = block.rows[place[a[:, None] + np.arange(b[0] - a[0])]].sum(axis=1)
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                for w, i in np.argwhere(z @ block.latent[items].T >= s.cosine).tolist():
                    yield items[i], int(a[w]), int(b[w])


def verified(block: Block, words: np.ndarray, found: Iterator[tuple[int, int, int]]) -> dict[int, float]:
    """Item -> share of its words, for the candidates that hold enough of the item and of its answer."""
    best: dict[int, float] = {}
    longest = max(len(item) for _, item, _ in block.items)
    window, there = None, set()
    for i, a, b in found:
        if best.get(i, 0.0) >= 1.0:
            continue
        if window != (a, b):
            wide = max(2, longest - (b - a) + 2)
            window, there = (a, b), set(words[max(0, a - wide) : b + wide].tolist())
        # What the surroundings lack of the item bounds the common subsequence.
        _, item, answer = block.items[i]
        lacks = sum(n for w, n in block.counts[i].items() if w not in there)
        if len(item) - lacks < block.settings.common * len(item):
            continue
        reach = max(2, len(item) - (b - a) + 2)
        around = words[max(0, a - reach) : b + reach].tolist()
        share = common_length(item, around) / len(item)
        if share >= block.settings.common and share > best.get(i, 0.0):
            if common_length(item[-answer:], around) >= block.settings.answer * answer:
                best[i] = share
    return best


def matches(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", settings: Settings = Settings(),
) -> DataFrame:
    """``(key, item, share)``: every document with every item it holds, and the share of the item's words found."""
    spark = docs.sparkSession
    hashed = stored(hashes_of(docs, key, text), "document-words")
    counts, n = document_counts(hashed)
    idf = np.log((1 + n) / (1 + counts)) + 1.0
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"key {kind}, item {item_kind}, share double"
    items = stored(hashes_of(benchmark, item_key, item_text), "item-words").select("words")
    out = spark.createDataFrame([], schema)
    arrow_type = benchmark.select(named(item_key)).limit(0).toArrow().schema.field(0).type

    for block in blocks_of(benchmark, item_key, item_text, idf, settings):
        block.set_basis(decompose(spark, block, items, hashed.select("words")))
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                keys, found, shares = [], [], []
                for k, words in zip(batch.column(0), unpacked(batch.column(1))):
                    for i, x in verified(own, words, candidates(own, words)).items():
                        keys.append(k.as_py())
                        found.append(own.items[i][0])
                        shares.append(x)
                kinds = [batch.schema.field(0).type, arrow_type]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, kinds[0]), pa.array(found, kinds[1]), pa.array(shares, pa.float64())], ["key", "item", "share"])

        out = out.unionByName(hashed.mapInArrow(run, schema))
    return out.withColumnsRenamed({"key": key, "item": item_key})


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **names) -> DataFrame:
    """One row per contaminated document key: ``n_items``, the ``item_id`` held best (smallest on a tie), ``share``."""
    found = matches(docs, benchmark, key, **names)
    best = F.max_by("item_id", F.struct("share", -F.col("item_id")))
    return found.groupBy(named(key)).agg(F.countDistinct("item_id").alias("n_items"), best.alias("item_id"), F.max("share").alias("share"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **names) -> DataFrame:
    """The documents that hold no item, with all their columns. What a row holds follows from its text alone, so rows are told
    apart by a digest of it; ``docs`` is read twice, not copied."""
    digest = F.unhex(F.sha2(named(text).cast("binary"), 256))
    row = free_name(docs, "row_")
    judged = docs.select(digest.alias(row), named(text))
    found = stored(matches(judged, benchmark, row, text, **names).select(named(row)).distinct(), "contaminated")
    return docs.withColumn(row, digest).join(found, row, "left_anti").select(*[named(c) for c in docs.columns])
