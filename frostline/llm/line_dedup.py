"""Near-duplicate lines by segment partition: lines within ``edits`` edits of an earlier line go.

Method: equal lines are collapsed first. Each distinct line is split into ``edits + 1`` segments; if two lines are
within the threshold, one segment of the shorter one is untouched and stands in the longer one near its old place. So
the index holds every segment under (length of the line, number of the segment, its text), and a line probes, for each
length from its own down to ``edits`` less and each segment, the few substrings that the multi-match-aware bounds allow.
Segments and substrings travel as packed hashes beside the line's number, to ranges of hashes that keep those which
several lines share; only these are joined. Lines that meet are verified: first by comparing which characters and which
pairs of neighbouring characters they hold, as parities, inside the join, so that a segment that many lines share yields
no pairs but those that can be near; then by a banded bit-parallel edit distance on the texts.

A line is removed if an equal line or a line within the threshold stands earlier, in order of document key, then place.
Lines under ``min_chars`` code points are never duplicates of anything and stay.

Skew: copies, however many, are one entry; the hash join is an equi-join that Spark splits where a segment is frequent.
Nothing is gathered by line. The removals of a document are gathered by document, which its text bounds.

Defined results: null texts stay null, empty texts empty. A document all of whose lines go has an empty text. Rows with
the same key are documents of their own; among them, and for null keys (which come last), the order is that of a number
given once and written down. Extra columns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from frostline.llm.common import bucketed, free_name, named, stored


#: Characters whose counts are compared before texts are.
COUNTED = "aeioubcdfghlmnprstvwy0123456789"


#: Ranges for each shuffle partition: what a task holds at once is one range.
RANGES = 4
#: A mark in its range: 40 bits of its hash, and the line's place in its chunk.
ENTRY = np.dtype([("low", "<u4"), ("high", "u1"), ("at", "<u2")])
#: A line's number is its chunk's number times this, plus its place.
CHUNK = 1 << 16


@cache
def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and end of each segment of an even split; the last segments are longer by one."""
    short, longer = divmod(length, edits + 1)
    ends = np.cumsum([short + (i >= edits + 1 - longer) for i in range(edits + 1)]).tolist()
    return list(zip([0, *ends], ends))


@cache
def probes(length: int, edits: int) -> list[tuple[int, int, int]]:
    """``(start, end, seed)`` of the substrings of a line that may be a segment of a line as long or up to ``edits``
    shorter, its own segments left out.

    Seen from the left at most ``i`` edits stand before segment ``i``, seen from the right at most ``edits - i`` after
    it; together they bound how far it can have moved.
    """
    found = []
    for less in range(min(edits, length) + 1):
        for i, (start, end) in enumerate(segments(length - less, edits)):
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                if (less or shift) and start + shift >= 0 and end + shift <= length:
                    found.append((start + shift, end + shift, (length - less) * (edits + 1) + i))
    return found


def marks_of(text: str, edits: int) -> tuple[list[int], list[int]]:
    """Hashes of the segments of a line, under its length and their number, and of what it probes."""
    n = len(text)
    own = [xxhash.xxh64_intdigest(text[a:b].encode(), n * (edits + 1) + i) for i, (a, b) in enumerate(segments(n, edits))]
    return own, [xxhash.xxh64_intdigest(text[a:b].encode(), seed) for a, b, seed in probes(n, edits)]


def chunked(lines: DataFrame) -> DataFrame:
    """``(chunk, texts, firsts)``: distinct lines ``(text, first)``, one row for each Arrow batch, numbered once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                whole = pa.array([0, part.num_rows], pa.int32())
                columns = [pa.ListArray.from_arrays(whole, pa.concat_arrays([c])) for c in part.columns]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *columns], ["chunk", "texts", "firsts"])
                number += 1

    first = lines.schema["first"].dataType.simpleString()
    return bucketed(lines.select("text", "first").mapInArrow(run, f"chunk long, texts array<string>, firsts array<{first}>"), "chunk", "lines")


def marked(chunks: DataFrame, edits: int, n: int) -> DataFrame:
    """``(range, chunk, own, probed)``: the marks of the lines of each chunk, packed, by range of hash."""

    def packed(marks: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Entries in order of range, and the range of each."""
        flat = np.fromiter(chain.from_iterable(marks), np.uint64)
        rows = np.zeros(len(flat), ENTRY)
        rows["low"], rows["high"] = flat & np.uint64(0xFFFFFFFF), (flat >> np.uint64(32)) & np.uint64(0xFF)
        rows["at"] = np.repeat(np.arange(len(marks)), [len(m) for m in marks])
        where = ((flat >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)
        order = np.argsort(where, kind="stable")
        return rows[order], where[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [marks_of(t, edits) for t in texts.as_py()]
                (own, own_range), (probed, probed_range) = packed([f[0] for f in found]), packed([f[1] for f in found])
                every = np.arange(n + 1, dtype=np.uint64)
                x, y = np.searchsorted(own_range, every), np.searchsorted(probed_range, every)
                used = np.flatnonzero((np.diff(x) > 0) | (np.diff(y) > 0)).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(used, pa.int32()), pa.array([chunk] * len(used), pa.int64()),
                    pa.array([own[x[r] : x[r + 1]].tobytes() for r in used], pa.binary()),
                    pa.array([probed[y[r] : y[r + 1]].tobytes() for r in used], pa.binary()),
                ], ["range", "chunk", "own", "probed"])

    return chunks.select("chunk", "texts").mapInArrow(run, "range int, chunk long, own binary, probed binary")


def shared_marks(marks: DataFrame) -> DataFrame:
    """``(mark, line, own)``: the marks that more than one line has, as a segment of at least one. Most lines share none
    and are out after this."""

    def opened(group: pd.DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.frombuffer(b, ENTRY) for b in group[name]]
        flat = np.concatenate(rows)
        lines = np.repeat(group["chunk"].to_numpy() * CHUNK, [len(r) for r in rows]) + flat["at"]
        return flat["low"].astype(np.int64) | (flat["high"].astype(np.int64) << 32), lines

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        own, own_line = opened(group, "own")
        probed, probed_line = opened(group, "probed")
        found, count = np.unique(own, return_counts=True)
        asked = np.isin(found, probed)
        again = found[(count > 1) | asked]
        keep, ask = np.isin(own, again), np.isin(probed, again)
        mark = np.concatenate([own[keep], probed[ask]])
        # The range is part of a mark.
        return pd.DataFrame({
            "mark": mark | (np.int64(group["range"].iloc[0]) << 40), "line": np.concatenate([own_line[keep], probed_line[ask]]),
            "own": np.arange(len(mark)) < keep.sum(),
        }) if len(mark) else pd.DataFrame({"mark": [], "line": [], "own": []}).astype({"mark": "int64", "line": "int64", "own": bool})

    return marks.groupBy("range").applyInPandas(meet, "mark long, line long, own boolean")


def held_characters(text: Column) -> Column:
    """31 bits: bit ``i`` says whether the text holds an odd number of the characters counted under ``i``. Characters
    not in the list count nowhere. An edit changes at most two of the counts by one, so at most two bits."""
    bits = [F.shiftleft((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) % 2, i) for i, c in enumerate(COUNTED)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def pair_parities(text: str) -> list[int]:
    """256 bits as four numbers: bit ``i`` says whether an odd number of the text's pairs of neighbouring characters fall
    under ``i``. An edit takes away two pairs and puts there two at most, so it turns four bits at most."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    pairs = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(56)
    odd = np.bincount(pairs.astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def with_parities(lines: DataFrame) -> DataFrame:
    """``lines`` with the bits of :func:`pair_parities` in four columns."""
    at = lines.columns.index("text")
    bits = [StructField(f"p{i}", LongType()) for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([pair_parities(t) for t in batch.column(at).to_pylist()], np.int64).reshape(-1, 4)
            columns = [*batch.columns, *[pa.array(found[:, i]) for i in range(4)]]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *[b.name for b in bits]])

    return lines.mapInArrow(run, StructType([*lines.schema.fields, *bits]))


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: bit-parallel on a band of ``2 * edits + 1`` diagonals.

    Bit ``d`` of ``reach[e]`` says that ``e`` edits turn the characters of ``a`` handled so far into as many characters
    of ``b``, ``d - edits`` more. What both begin and end with is cut off first.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    start = shared(a, b)
    a, b = a[start:], b[start:]
    end = shared(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]

    def inside(i: int) -> int:
        low, high = max(0, edits - i), min(2 * edits, len(b) - i + edits)
        return ((1 << (high + 1)) - (1 << low)) if high >= low else 0

    reach = [1 << edits]
    for _ in range(edits):
        reach.append(reach[-1] | (reach[-1] << 1) & inside(0))
    for i, c in enumerate(a):
        first = max(0, edits - i)
        window = b[max(0, i - edits) : i + edits + 1]
        equal = sum(1 << (first + k) for k, x in enumerate(window) if x == c)
        fresh = [reach[0] & equal]
        for e in range(1, edits + 1):
            changed = reach[e - 1] & (((1 << len(window)) - 1) << first)
            dropped = reach[e - 1] >> 1
            added = (fresh[-1] << 1) & inside(i + 1)
            fresh.append(fresh[-1] | (reach[e] & equal) | changed | dropped | added)
        reach = fresh
        if not reach[-1]:
            return False
    return bool(reach[-1] >> (len(b) - len(a) + edits) & 1)


def shared(a: str, b: str) -> int:
    """How many characters both texts begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def lines_at(chunks: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(line, text, first)`` of the numbered lines; only their numbers move to the chunks."""
    places = numbers.select(F.floor(F.col("line") / CHUNK).alias("chunk"), (F.col("line") % CHUNK).cast("int").alias("at"))
    wanted = places.groupBy("chunk").agg(F.collect_set("at").alias("places"))
    found = F.transform("places", lambda i: F.struct(
        (F.col("chunk") * CHUNK + i).alias("line"), F.get("texts", i).alias("text"), F.get("firsts", i).alias("first")))
    return chunks.join(wanted, "chunk").select(F.explode(found).alias("x")).select("x.*")


def near_lines(chunks: DataFrame, edits: int) -> DataFrame:
    """``line`` of every line of the chunks that has one before it within ``edits`` edits."""
    n = RANGES * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = stored(shared_marks(marked(chunks, edits, n)), "marks").distinct()
    lines = lines_at(chunks, common.select("line").distinct())
    held = with_parities(lines.select("line", "text", "first", held_characters(F.col("text")).alias("held")))
    lines = stored(held, "candidates")
    signs = ("held", "p0", "p1", "p2", "p3")
    common = common.join(lines.select("line", *signs), "line")
    left = common.where("own").select("mark", F.col("line").alias("a"), *[F.col(c).alias(f"{c}_a") for c in signs])
    right = common.select("mark", F.col("line").alias("b"), *[F.col(c).alias(f"{c}_b") for c in signs])

    def turned(*columns: str) -> Column:
        return reduce(Column.__add__, [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in columns])

    likely = (turned("held") <= 2 * edits) & (turned(*signs[1:]) <= 4 * edits)
    met = left.join(right, "mark").where((F.col("a") != F.col("b")) & likely)
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x: lines.select(F.col("line").alias(x), F.col("text").alias(f"text_{x}"), F.col("first").alias(f"first_{x}"))
    later = F.when(F.col("first_a") > F.col("first_b"), F.col("a")).otherwise(F.col("b"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select(later.alias("line"), "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [within(a, b, edits) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield batch.select(["line"]).filter(pa.array(near, pa.bool_()))

    return full.mapInArrow(run, "line long").distinct()


def kept_places(docs: DataFrame, row: str, key: str, text: str, edits: int, min_chars: int) -> DataFrame:
    """``(row, places)``: the long lines of each document that stay, for documents that keep any."""
    lines = docs.select(named(row).alias("row"), named(key).alias("key"), F.posexplode(F.split(named(text), "\n")).alias("place", "text"))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row", "place")).alias("first")
    distinct = lines.where(F.length("text") >= min_chars).groupBy("text").agg(first)
    chunks = chunked(distinct)
    number = (F.col("chunk") * CHUNK + F.col("at")).alias("line")
    every = chunks.select("chunk", F.posexplode("firsts").alias("at", "first")).select(number, "first")
    stay = every.join(near_lines(chunks, edits), "line", "left_anti")
    return stay.groupBy(F.col("first.row").alias("row")).agg(F.sort_array(F.collect_list("first.place")).alias("places"))


def long_places(text: Column, min_chars: int) -> Column:
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.when(F.length(x) >= min_chars, i))
    return F.array_compact(lines)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = 2, min_chars: int = 30) -> DataFrame:
    """One row per document: key, ``n_lines``, ``n_removed`` and ``removed``, their places from 0, comma-joined."""
    once = stored(docs.select(F.monotonically_increasing_id().alias("row"), named(key).alias("key"), named(text).alias("text")), "numbered")
    kept = kept_places(once, "row", "key", "text", edits, min_chars)
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    held = once.select("row", "key", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), long_places(F.col("text"), min_chars).alias("long"))
    gone = F.array_except("long", F.coalesce("places", F.array().cast("array<int>")))
    rows = held.join(kept, "row", "left").withColumn("gone", gone)
    return rows.select(F.col("key").alias(key), "n_lines", F.size("gone").cast("long").alias("n_removed"), F.concat_ws(",", F.col("gone").cast("array<string>")).alias("removed"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = 2, min_chars: int = 30) -> DataFrame:
    """All documents with all their columns, the removed lines gone from the text."""
    row, places = free_name(docs, "row_"), free_name(docs, "places_")
    once = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    kept = kept_places(once, row, key, text, edits, min_chars).withColumnsRenamed({"row": row, "places": places})
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for whole, stay in zip(batch.column(at), batch.column(len(batch.columns) - 1)):
                whole, stay = whole.as_py(), set(stay.as_py() or ())
                if whole is not None:
                    whole = "\n".join(x for i, x in enumerate(whole.split("\n")) if len(x) < min_chars or i in stay)
                texts.append(whole)
            columns = list(batch.columns[: len(batch.columns) - 1])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    rows = once.join(kept, row, "left").select(*[named(c) for c in docs.columns], named(places))
    return rows.mapInArrow(run, docs.schema)
