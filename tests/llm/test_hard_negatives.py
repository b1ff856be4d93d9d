from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.llm import hard_negatives
from frostline.llm.common import table
from frostline.llm.queries import HARD_NEGATIVES_SQL

SF = "/root/testdata/sf0.01"


def by_hand(rows, anchor=lambda i: i is not None and i % 100 == 0):
    """``rows``: (vec_id, vector, label)."""
    used = [
        (i, [math.floor(256 * float(x)) for x in v], y) for i, v, y in rows
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for k, (i, v, y) in enumerate(used):
        if anchor(i):
            found = [(-score(v, w), j is None, j or 0, z, j) for n, (j, w, z) in enumerate(used) if n != k]
            for p, _, _, _, j in sorted(f[:3] + (0, f[4]) for f in found if f[3] == y)[:5]:
                held = sorted(f[:3] + (0, f[4]) for f in found if f[3] != y and 80 * -p <= 100 * -f[0] <= 100 * -p)
                out += [(i, j, r + 1, f[4], -p, -f[0]) for r, f in enumerate(held[:5])]
    return sorted(out, key=str)


def mined(rows):
    return sorted((tuple(r) for r in hard_negatives.mine(rows, F.col("vec_id") % 100 == 0).collect()), key=str)


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    expected = sorted(con.execute(HARD_NEGATIVES_SQL).fetchall())
    assert expected and mined(hard_negatives.relabelled(table(spark, SF, "embeddings"))) == sorted(expected, key=str)


def test_cells_make_no_difference(spark, monkeypatch):
    rows = table(spark, SF, "embeddings")
    expected = by_hand([tuple(r) for r in rows.collect()])
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    monkeypatch.setattr(hard_negatives, "ROWS", 60)
    assert mined(rows) == expected


@pytest.mark.parametrize("dims", [1, 3, 64, 100])
def test_intervals_hold(dims):
    """The score is never outside its interval, and the filter drops what is far away."""
    random = np.random.default_rng(dims)
    rows = random.integers(-300, 300, (500, dims)).astype(float)
    rows[250:] = rows[0] + random.integers(-20, 20, (250, dims))
    turn = hard_negatives.rotation(dims)
    code, aligned, rest = hard_negatives.codes(rows, turn)
    for anchor in (*rows[:3], rows[0] * 0, rows[0] * 1000):
        _, least, most = hard_negatives.Question(anchor, turn).bounds(hard_negatives.words(code), aligned, rest)
        exact = rows @ anchor
        assert (least <= exact).all() and (exact <= most).all()
    estimate, _, most = hard_negatives.Question(rows[0], turn).bounds(hard_negatives.words(code), aligned, rest)
    if dims >= 64:
        assert (most < (rows @ rows[0])[250:].min()).sum() > 150


def test_odd_rows(spark):
    """Nulls, infinities, vectors of several lengths, repeated rows, ties, huge components, a null key."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.5], 1), (3, [0.4, 0.5], 2), (4, [0.4, 0.5], 2),
        (5, [0.4, 0.5], 2), (5, [0.4, 0.5], 2), (6, None, 1), (7, [0.5, None], 1), (8, [nan, 1.0], 2), (9, [inf, 1.0], 2),
        (10, [0.5, 0.5], None), (11, [], 1), (None, [0.4, 0.5], 2), (100, [0.1, 0.1, 0.1], 3), (200, [-0.5, 0.1], 3),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"uid": F.lit(1), "rank": F.lit("x")})
    plain = [(i, v, y) for i, v, y in [tuple(r)[:3] for r in frame.collect()]]
    assert mined(frame.repartition(3)) == by_hand(plain)
    assert mined(frame.limit(0)) == []
    huge = spark.createDataFrame([(0, [3e30], 1), (1, [3e30], 1), (2, [3e30], 2)], "vec_id long, embedding array<float>, label int")
    assert mined(huge) == [(0, 1, 1, 2, (1 << 63) - 1, (1 << 63) - 1)]
