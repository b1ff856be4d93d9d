from __future__ import annotations

import random
import re

import numpy as np
import duckdb
from odd import ODD, SF

from frostline.llm import decontamination as d
from frostline.llm.queries import op2_decontamination


def test_every_copy_in_the_table_is_found_and_nothing_else(spark, rows):
    plain = lambda t: f" {' '.join(d.words_of(t))} "
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    want = {k for k, text, *_ in rows if any(plain(t) in plain(text) for _, t in items if len(d.words_of(t)) >= 8)}
    assert want and {r["doc_id"] for r in op2_decontamination(spark, SF).collect()} == want


def test_paraphrases_and_odd_rows(spark, frame, rows):
    rng = random.Random(5)
    items = [(i, t) for i, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall() if len(d.words_of(t)) >= 15]
    clean = [(k, t) for k, t, *_ in rows if k % 3 == 0][:40]
    pairs = []
    for n, (_, text) in enumerate(items):
        words = text.split()
        for i in rng.sample(range(len(words)), len(words) // 6):
            words[i] = "zebra"
        host = rows[n][1].split()
        pairs.append((1000 + n, " ".join([*host[:40], *words, *host[40:]])))
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (902, "the of and")], "item_id long, text string")
    df = frame(ODD + pairs)
    got = {(r["doc_id"], r["item_id"]) for r in d.matches(df, bench).collect()}
    assert {(1000 + n, i) for n, (i, _) in enumerate(items)} <= got
    assert all(k is not None and k >= 1000 for k, _ in got)
    kept = d.clean(frame(ODD + pairs), bench)
    assert kept.columns == df.columns and kept.count() == len(ODD)
    found = {r["doc_id"] for r in d.matches(frame(clean), bench).collect()}
    plain = lambda t: f" {' '.join(d.words_of(t))} "
    assert found == {k for k, t in clean if any(plain(x) in plain(t) for _, x in items)}


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.report(frame(ODD), none).isEmpty() and d.clean(frame(ODD), none).count() == len(ODD)
    assert d.clean(frame([]), none).isEmpty()
    some = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    assert d.report(frame([]), some).isEmpty()


def test_blocks_give_the_same_matches(spark, frame, rows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    df = frame([(r[0], r[1]) for r in rows])
    whole = {tuple(r)[:2] for r in d.matches(df, bench).collect()}
    assert whole == {tuple(r)[:2] for r in d.matches(df, bench, settings=d.Settings(block_words=400)).collect()}


def test_common_length_is_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2)]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert d.common_length(a, b) == table[-1, -1]


def test_paraphrases_with_a_rare_word_in_each_place(spark, frame):
    rng = random.Random(9)
    texts = [t.split() for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()]
    corpus = [" ".join(t[k : k + 150]) for t in texts for k in range(0, min(len(t), 600), 150)]
    assert len(corpus) >= 2000
    items = [(i, t) for i, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall() if len(d.words_of(t)) >= 15]
    pairs, want = list(enumerate(corpus)), set()
    for share in (0.2, 0.25, 0.3):
        for i, text in items:
            words = text.split()
            for k in rng.sample(range(len(words)), int(share * len(words))):
                words[k] = f"rare{len(pairs)}word{k}"
            own, new = d.words_of(text), d.words_of(" ".join(words))
            answer = max(len(own) // 4, len(d.words_of(re.split(r"(?<=[.!?])\s+|\n+", text)[-1])))
            if d.common_length(own, new) >= 0.65 * len(own) and d.common_length(own[-answer:], new) >= 0.5 * answer:
                want.add((len(pairs), i))
                host = corpus[len(want)].split()
                pairs.append((len(pairs), " ".join([*host[:40], *words, *host[40:80]])))
    got = {(r["doc_id"], r["item_id"]) for r in d.matches(frame(pairs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 2.5 * len(items) and len(want - got) <= 0.02 * len(want)


def test_the_decomposition_sees_every_document(spark, frame, monkeypatch):
    """Not a sample of them: fails if only some documents shape the latent space."""
    seen, real = [], d.decompose
    monkeypatch.setattr(d, "decompose", lambda spark, block, items, corpus: seen.append(corpus.count()) or real(spark, block, items, corpus))
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    pairs = [(i, f"one two {i} four five six") for i in range(1500)] + [(2000, "so one two three four five six seven eight nine ten it is")]
    assert [r["doc_id"] for r in d.matches(frame(pairs), bench).collect()] == [2000]
    assert seen == [1501]


def test_products_of_passages_are_summed_by_word():
    rng = np.random.default_rng(3)
    passages = rng.integers(0, 10, (60, 8))  # 9 is no word
    passages[passages == 4] = 3
    weight, q = rng.random(9), rng.random((9, 4))
    total = np.zeros((9, 4))
    d.add_product(total, weight[:, None] * q, passages)
    rows = np.zeros((60, 10))
    np.add.at(rows, (np.repeat(np.arange(60), 8), passages.ravel()), 1)
    rows = rows[:, :9] * weight
    assert np.allclose(total * weight[:, None], rows.T @ (rows @ q), rtol=1e-4)


def test_cleaning_copies_no_text(spark, monkeypatch):
    """Equal texts under other keys go together, texts that are null or empty stay; fails if documents are written beside their words."""
    kinds, real = [], d.stored
    monkeypatch.setattr(d, "stored", lambda df, purpose: kinds.append(dict(df.dtypes)) or real(df, purpose))
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"so {item} it is", "a"), (1, f"so {item} it is", None), (2, None, "b"), (3, "", "c"), (3, "", "c"), (None, "so it is", "d")],
                                 "row_ long, text string, source string")
    kept = d.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("row_ <> 1 or row_ is null").collect()))
    assert kinds and not any(kind == "string" for kinds_of in kinds for kind in kinds_of.values())
