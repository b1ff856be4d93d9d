from __future__ import annotations

import re

import duckdb
from odd import SF

from frostline.llm import license_scan as ls
from frostline.llm.queries import op8_license_scan

LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def test_whole_table(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = {k: {name for line, name in LINES.items() if line.rstrip(".") in t} for k, t in rows}
    got = {r["doc_id"]: r["licence"] for r in op8_license_scan(spark, SF).collect()}
    assert len(got) == len(rows) and any(got.values())
    assert all((got[k] in names) if names else got[k] is None for k, names in want.items())


def test_inheritance_and_odd_rows(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License"), (2, "a/b/c/x.txt", "text " * 99), (3, "a/b/COPYING", "Apache License Version 2.0, January 2004"),
        (4, "a/y.txt", "text " * 99), (5, "z/y.txt", "text " * 99), (6, "z/own.txt", "text " * 99 + "\nLicensed under CC BY 4.0"),
        (7, None, "text " * 99), (8, "a/n.txt", None), (9, "top.txt", ""), (10, "a/b/d", "text " * 99), (10, "a/b/d", "text " * 99), (None, "a/b/e", "text " * 99),
        (11, "zz/a b.c/LICENSE.md", "Released under the MIT License"), (12, "zz/a b.c/f", "licence " * 200),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, path string, text string, row long").repartition(3)
    got = sorted({(r["doc_id"], r["licence"], r["inherited"], r["inherited_from"]) for r in ls.scan(df).collect()}, key=str)
    assert got == sorted([
        (1, "MIT", None, None), (2, None, "Apache-2.0", "a/b/COPYING"), (3, "Apache-2.0", None, None), (4, None, "MIT", "a/LICENSE"),
        (5, None, None, None), (6, "CC-BY-4.0", None, None), (7, None, None, None), (8, None, "MIT", "a/LICENSE"), (9, None, None, None),
        (10, None, "Apache-2.0", "a/b/COPYING"), (None, None, "Apache-2.0", "a/b/COPYING"), (11, "MIT", None, None),
        (12, None, "MIT", "zz/a b.c/LICENSE.md"),
    ], key=str)
    assert ls.scan(df).count() == len(rows) and ls.scan(df.limit(0)).isEmpty()


def test_a_header_with_extra_words_at_two_sizes(spark):
    """Extra words that most files hold, or that nobody else uses, weigh the same in a small and in a larger table."""
    headers = ["This project is licensed under the Apache License, Version 2.0, see the file by its name in this place", "Released under the MIT License by Jane Doe."]
    common = "see the file by its name in this place under project is " + "word " * 60

    def cosines(n):
        rows = [(k, f"d{k}/x", f"{common}\n{headers[k % 100]}" if k % 100 < 2 else common) for k in range(n)]
        found = ls.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).where("licence is not null").collect()
        return {r["doc_id"]: (r["licence"], r["cosine"]) for r in found}

    small, large = cosines(400), cosines(20_000)
    assert {k: v[0] for k, v in small.items()} == {k: ("Apache-2.0", "MIT")[k % 100] for k in range(400) if k % 100 < 2}
    assert len(large) == 400 and all(large[k][0] == v[0] and abs(large[k][1] - v[1]) < 0.05 for k, v in small.items())


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a/b", "Released under the MIT License")], "doc_id long, path string, text string")
    assert not re.search("Python|Pandas|Arrow", ls.scan(df)._jdf.queryExecution().toString())
