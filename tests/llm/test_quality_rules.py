from __future__ import annotations

import re
from collections import Counter

import duckdb

from odd import ODD, SF

from frostline.llm import quality_rules as q
from frostline.llm.queries import op10_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


def judged(df):
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()


def test_base_counts_of_a_whole_table(spark, rows):
    got = {r[0]: tuple(r)[1:7] for r in judged(op10_quality_rules(spark, SF))}
    assert got == {r[0]: brute(r[1]) for r in rows}


def test_junk_goes_and_clean_text_stays(spark, rows):
    kept = {r[0]: r[7] for r in judged(op10_quality_rules(spark, SF))}
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    long = {r[0] for r in rows if len(WORD.findall(r[1])) >= 80}
    assert all(kept[k] for k, good in labels.items() if good and k in long)
    assert not any(kept[k] for k, good in labels.items() if not good and "%%%" in dict((r[0], r[1]) for r in rows)[k])


def test_odd_rows(frame):
    df = frame(ODD + [(7, "a a a a"), (8, "a\x0bb\x0cc\rd"), (9, "x y z\nx y z\n\nx y z")])
    got = sorted(((r[0], *tuple(r)[1:7]) for r in judged(q.verdicts(df))), key=str)
    pairs = ODD + [(7, "a a a a"), (8, "a\x0bb\x0cc\rd"), (9, "x y z\nx y z\n\nx y z")]
    assert got == sorted(((k, *brute(t)) for k, t in pairs), key=str)
    kept = q.keep_good(df)
    assert kept.columns == df.columns and kept.isEmpty()


def test_empty_table(frame):
    assert q.verdicts(frame([])).isEmpty() and q.keep_good(frame([])).isEmpty()


def test_plan_has_no_python(spark, frame, rows):
    plan = q.keep_good(frame(rows_pairs(rows)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def rows_pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_distance_is_jensen_shannon(spark):
    from math import log2, sqrt

    from pyspark.sql import functions as F

    p, r = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, r)]
    want = sqrt(sum(0.5 * x * log2(x / y) for x, y in zip(p + r, m + m) if x))
    row = spark.range(1).select(q.distance(F.array(F.lit(2), F.lit(2), F.lit(0)), F.lit(4), r).alias("d")).first()
    assert abs(row["d"] - want) < 1e-12
