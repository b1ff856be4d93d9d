from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from frostline.llm import merkle_manifest
from frostline.llm.common import table
from odd import ODD, SF


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    found = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        found.append(nodes)
    return found


def by_hand(rows):
    """Every row ``(doc_id, source, lang, n_chars, text)`` with its proof, in order of the leaves."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: levels([leaf(r) for r in order[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    root = top[-1][0]
    out = []
    for at, source in enumerate(sources):
        for k, row in enumerate(order[source]):
            runs = []
            for tree, place in ((trees[source], k), (top, at)):
                for nodes in tree[:-1]:
                    runs.append((nodes[place // 3 * 3 : place // 3 * 3 + 3], place % 3))
                    place //= 3
            node = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                node = leaf((*row[:4], row[4].replace("\n", "")))
            for run, place in runs:
                node = digest(*run[:place], node, *run[place + 1 :])
            siblings = "".join("".join(run[:p] + run[p + 1 :]) for run, p in runs)
            out.append((row[0], leaf(row), trees[source][-1][0], root, digest(siblings), node, node == root))
    return out


def documents(spark):
    return [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]


def sortable(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("depth", [8, 2, 1])
def test_equals_trees_built_by_hand(spark, monkeypatch, depth):
    """Whatever the partitions, within one or over many rounds of levels."""
    monkeypatch.setattr(merkle_manifest, "DEPTH", depth)
    monkeypatch.setattr(merkle_manifest, "SORTED_ROWS", 40)
    got = merkle_manifest.tampered(table(spark, SF, "documents")).collect()
    assert sortable(got) == sortable(by_hand(documents(spark)))
    assert {r.verified for r in got} == {True, False}


def test_missing_nodes_are_asked_for_once():
    """Siblings of what is known, none that can be derived."""
    assert [(n, g.tolist()) for n, g in merkle_manifest.missing(__import__("numpy").array([0, 1, 4]), 10)] == [
        (0, [2, 3, 5]), (1, [2]), (2, [1]),
    ]


def test_some_rows_prove_what_all_prove(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "DEPTH", 2)
    manifest = merkle_manifest.build(table(spark, SF, "documents"))
    every = {tuple(r) for r in merkle_manifest.prove(manifest).collect()}
    some = [tuple(r) for r in merkle_manifest.prove(manifest, manifest.leaves.where(F.col("key") % 7 == 0)).collect()]
    assert some and set(some) == {r for r in every if r[0] % 7 == 0}
    assert all(r[-1] for r in every)


def test_odd_rows(spark):
    """Null keys and sources, repeated rows, a lone leaf, an empty table, columns of clashing names."""
    rows = [(k, s, None, i, t) for i, (k, t) in enumerate(ODD) for s in (None, "s", "ü")] + [(1, "alone", "en", 1, "a\nb")] * 2
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame(rows, schema).withColumn("key", F.lit(1)).withColumn("at", F.lit("x"))
    assert sortable(merkle_manifest.tampered(docs).collect()) == sortable(by_hand(rows))
    assert merkle_manifest.tampered(docs.limit(0)).count() == 0
    one = merkle_manifest.tampered(docs.where("source = 'alone'").limit(1)).collect()
    assert sortable(one) == sortable(by_hand([(1, "alone", "en", 1, "a\nb")]))
