"""SimHash near-duplicates through an inverted index on the bytes of the fingerprints.

Method: a 64-bit fingerprint is eight bytes, each at its position. Two fingerprints that differ in at most ``max_bits``
bits agree in at least ``8 - max_bits`` positions, the guaranteed minimum of matches. The inverted index maps
(positions, their bytes) to the distinct fingerprints holding them; a posting is the intersection of the lists of
several positions, chosen so that every pair reaching the minimum meets in one: the eight positions are dealt into
``max_bits + 2`` groups, of which a pair keeps at least two whole. For each pair that meets, the shared positional bytes
are tallied, pairs below the minimum go, and the rest are verified by counting differing bits. Lists of single bytes
would hold 1/256 of the corpus each and are never paired.

Copies share a fingerprint and are collapsed before the index, so a group of copies of any size is one entry. Linked
fingerprints become components by alternating star contractions, which halve the distance to the smallest member in
every round, each round cut by a checkpoint.

Defined results: a null or empty text, or one of white space, has fingerprint zero, linked like any other. Fewer words
than a shingle: the whole sequence is one shingle. Rows with the same key are rows of their own; a null key is never
a component's id unless its component has no other. Extra columns are ignored by ``components`` and kept by
``one_of_each``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import checkpointed, free_name, named, stored

CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit i is set if it is set in over half the XXH64 (seed 42) of the word shingles; signed, as Spark's long."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, len(starts), CHUNK):
        spans = zip(starts[k : k + CHUNK].tolist(), ends[k : k + CHUNK].tolist())
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(starts[k : k + CHUNK]))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = 3) -> DataFrame:
    """``(key, fp)`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(named(key).alias("key"), named(text).alias("text")).mapInArrow(run, f"key {kind}, fp long")


def byte_at(fp: Column, position: int) -> Column:
    return F.shiftright(fp, 8 * position).bitwiseAND(F.lit(255))


def postings(fps: DataFrame, max_bits: int) -> DataFrame:
    """``(posting, value, fp)``: each fingerprint under every pair of position groups."""
    groups = [list(range(8))[i :: max_bits + 2] for i in range(max_bits + 2)]

    def value(positions: list[int]) -> Column:
        return reduce(lambda a, b: F.shiftleft(a, 8).bitwiseOR(b), [byte_at(F.col("fp"), p) for p in positions])

    keys = F.array(*[
        F.struct(F.lit(i).alias("posting"), value(groups[a] + groups[b]).alias("value"))
        for i, (a, b) in enumerate(combinations(range(max_bits + 2), 2))
    ])
    return fps.select("fp", F.explode(keys).alias("k")).select("k.posting", "k.value", "fp")


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints with at most ``max_bits`` differing bits."""
    if not 0 <= max_bits <= 6:
        raise ValueError("max_bits must be 0 to 6: a pair must keep two groups of positions whole")
    left = postings(fps, max_bits).withColumnRenamed("fp", "a")
    right = postings(fps, max_bits).withColumnRenamed("fp", "b")
    a, b = F.col("a"), F.col("b")
    tally = reduce(lambda x, y: x + y, [(byte_at(a, p) == byte_at(b, p)).cast("int") for p in range(8)])
    met = left.join(right, ["posting", "value"]).where((a < b) & (tally >= 8 - max_bits))
    return met.where(F.bit_count(a.bitwiseXOR(b)) <= max_bits).select("a", "b").distinct()


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``: root is the smallest node of its component."""

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        nearest = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = pairs.join(nearest, "u")
        if large:
            out = out.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = out.select(F.col("m").alias("a"), F.col("v").alias("b")).union(nearest.select(F.col("m"), F.col("u")))
        return out.where("a != b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = checkpointed(edges)
    before = mark(edges)
    while before[0]:
        edges = star(both(edges), large=True)
        edges = checkpointed(star(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), large=False))
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(edges.select("a", "a").distinct())


def component_of(marked: DataFrame, max_bits: int = 2) -> DataFrame:
    """``(fp, component_id)``: the smallest key reachable from each distinct fingerprint of ``marked (key, fp)``."""
    fps = stored(marked.groupBy("fp").agg(F.min("key").alias("first")), "fingerprints")
    roots = smallest_reachable(links(fps.select("fp"), max_bits))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per document: key, ``fingerprint`` as 16 hexadecimal digits, ``component_id``."""
    marked = stored(fingerprints(docs, key, text, shingle), "marked")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(component_of(marked, max_bits), "fp").select(F.col("key").alias(key), shown, "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The documents with the smallest key of each component, one each (null keys last; of equal keys the first text,
    then one of the equal rows), with all their columns."""
    row = free_name(docs, "row_")
    docs_once = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    marked = stored(fingerprints(docs_once, row, text, shingle), "marked").withColumnRenamed("key", "row")
    keys = docs_once.select(named(row).alias("row"), named(key).alias("key"), F.xxhash64(named(text)).alias("hash"))
    # Of the rows of one fingerprint only the best goes on; the component keeps the best of those.
    best = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "hash", "row"))
    per_fp = stored(marked.join(keys, "row").groupBy("fp").agg(best.alias("best")), "first-of-copies")
    roots = smallest_reachable(links(per_fp.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    rooted = per_fp.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return docs_once.join(kept, row, "left_semi").select(*[named(c) for c in docs.columns])
