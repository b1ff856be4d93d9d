from __future__ import annotations

import re

import xxhash
from odd import ODD, SF
from pyspark.sql import functions as F

from frostline.llm import simhash as s
from frostline.llm.queries import op9_simhash


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    marks = [(k, brute_fingerprint(t)) for k, t in pairs]
    group = list(range(len(marks)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(marks):
            for j, (_, b) in enumerate(marks):
                if group[i] != group[j] and (a ^ b).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    least = {g: min((k for (k, _), x in zip(marks, group) if x == g and k is not None), default=None) for g in set(group)}
    return sorted(((k, f"{f:016x}", least[g]) for (k, f), g in zip(marks, group)), key=str)


def test_whole_table(spark, rows):
    assert sorted(map(tuple, op9_simhash(spark, SF).collect()), key=str) == brute_components([r[:2] for r in rows])


def test_odd_rows(frame):
    df = frame(ODD)
    assert sorted(map(tuple, s.components(df).collect()), key=str) == brute_components(ODD)
    kept = s.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5]


def test_empty_table(frame):
    assert s.components(frame([])).isEmpty() and s.one_of_each(frame([])).isEmpty()


def test_links_at_the_limit(spark):
    base = 0x0123456789ABCDEF
    marks = [base, base ^ 1, base ^ 3, base ^ 7, base ^ (1 << 63), base ^ (1 << 63) ^ (1 << 31), base ^ 0x1010100]
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    for bits in (0, 1, 2, 3, 4):
        got = {tuple(sorted(map(tuple, [r]))[0]) for r in s.links(spark.createDataFrame([(m,) for m in signed], "fp long"), bits).collect()}
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits}
        assert got == want


def test_long_chain_is_one_component(spark):
    edges = spark.range(1, 300).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    roots = s.smallest_reachable(edges.union(spark.createDataFrame([(1000, 1001)], "a long, b long")))
    got = {r["node"]: r["root"] for r in roots.collect()}
    assert got == {i: 0 for i in range(300)} | {1000: 1000, 1001: 1000}
