from __future__ import annotations

import zlib

import duckdb
import numpy as np
from odd import ODD

from frostline.llm import compression_quality as c
from frostline.llm import language_id as li
from frostline.llm.queries import op3_compression_quality, op4_language_id

SF = "/root/testdata/sf0.01"


def test_quality_on_rows_never_learned_from(spark):
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    rows = op3_compression_quality(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    judged = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in judged) / len(judged) > 0.9


def test_quality_odd_rows(spark, frame):
    good = [(100 + i, f"a calm morning by the river number {i} with nothing to say " * 9) for i in range(120)]
    bad = [(300 + i, f"BUY!! NOW!! {i} CHEAP$$$ CLICK### " * 20) for i in range(120)]
    labels = spark.createDataFrame([(k, 1, "x") for k, _ in good] + [(k, 0, "x") for k, _ in bad], "doc_id long, quality int, text string")
    got = {(r["doc_id"], r["score"] > 0) for r in c.score(frame(ODD + good + bad), labels).where("doc_id < 10 or doc_id is null").collect()}
    assert got == {(1, False), (2, False), (3, True), (4, True), (5, True), (6, True), (None, True)}
    rows = c.score(frame(good + bad), labels).where("held_out").collect()
    assert all((r["predicted"] == 1) == (r["doc_id"] < 300) for r in rows)


def test_quality_without_labels(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in c.score(frame(ODD), none).collect()} == {0.0, 0.5}
    assert c.score(frame([]), none).isEmpty()


def test_language_on_rows_never_learned_from(spark):
    known = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    rows = op4_language_id(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    judged = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == known[r["doc_id"]] for r in judged) / len(judged) > 0.95


def test_language_odd_rows(frame):
    got = sorted({(r["doc_id"], r["lang_pred"]) for r in li.predict(frame([*ODD, (9, "12 34 !?")])).collect()}, key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "en"), (6, "en"), (9, "und"), (None, "en")], key=str)
    assert li.predict(frame([])).isEmpty()
    assert {r["lang_pred"] for r in li.predict(frame([(1, "text")]), language="lang").collect()} <= {"und", "en"}


def brute_bits(counts, text, order):
    """Code length by walking the context tree byte by byte."""
    data, total = b"\n" * order + text, 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = counts[k].get(data[i - k : i], {})
            n, kinds = sum(seen.values()), len(seen)
            if seen.get(data[i]):
                total += np.log2((n + kinds) / seen[data[i]])
                break
            if n:
                total += np.log2((n + kinds) / kinds)
        else:
            total += 8
    return total


def test_code_lengths_are_those_of_the_tree():
    texts = {"a": [b"abracadabra", b"abab"], "b": [b"banana bandana"]}
    seen, trees = {}, {}
    for lang, own in texts.items():
        seen[lang] = {n: {} for n in range(1, li.ORDER + 2)}
        trees[lang] = [{} for _ in range(li.ORDER + 1)]
        for t in own:
            data = np.frombuffer(li.BEFORE + t, np.uint8)
            for n in range(1, li.ORDER + 2):
                for s in li.sequences(data, n).tolist():
                    seen[lang][n][s] = seen[lang][n].get(s, 0) + 1
                    context = s.to_bytes(n, "big")
                    node = trees[lang][n - 1].setdefault(context[:-1], {})
                    node[context[-1]] = node.get(context[-1], 0) + 1
    model = li.Model(["a", "b"], seen)
    probes = [b"abracadabra", b"banana", b"xyz ban", b"", b"a" * 50, bytes(range(200, 256))]
    got = model.lengths(probes)
    want = [[brute_bits(trees[x], p, li.ORDER) for x in ("a", "b")] for p in probes]
    assert np.allclose(got, want, rtol=1e-4)


def test_signs_that_are_no_letters_have_no_language(spark):
    """Fractions, powers, circled and Roman numerals are numbers; marks without a letter are none either."""
    texts = ["½ ² ①", "Ⅷ", "12 34", "-- ++", "́", "a", "ß", "日", "ª"]
    learned = [(100 + i, "the quiet harbour at dawn and the boats", "en") for i in range(30)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + learned, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in li.predict(docs).where("doc_id < 100").collect()}
    assert [got[i] for i in range(len(texts))] == ["und"] * 5 + ["en"] * 4
