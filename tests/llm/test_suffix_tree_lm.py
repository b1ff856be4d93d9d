from __future__ import annotations

import collections
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from frostline.llm import suffix_tree_lm
from frostline.llm.common import table
from odd import ODD, SF


def by_hand(rows, learn, depth=3, least=16, gain=10.0):
    """The same tree with dictionaries of word tuples; returns scores by place and the kept contexts."""
    texts = []
    for key, text in rows:
        plain = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        texts.append((learn(key), [w for w in re.split(r"[\x20\x09-\x0D]+", plain) if w] + [None]))
    seen = [collections.Counter() for _ in range(depth + 1)]
    for learned, words in texts:
        if learned:
            for n in range(depth + 1):
                seen[n].update(tuple(words[i - n : i + 1]) for i in range(n, len(words)))
    total, distinct = sum(seen[0].values()), len(seen[0])
    gains = collections.defaultdict(lambda: [0.0] * len(suffix_tree_lm.WEIGHTS))
    for learned, words in texts:
        for i in range(len(words) if learned else 0):
            suffix = (max(seen[0][(words[i],)] - 1, 0) + 0.1) / (max(total - 1, 0) + 0.1 * (distinct + 1))
            for n in range(1, min(depth, i) + 1):
                state = tuple(words[i - n : i])
                if seen[n - 1][state] < least:
                    break
                c, of = seen[n][(*state, words[i])] - 1, seen[n - 1][state] - 1
                for j, w in enumerate(suffix_tree_lm.WEIGHTS):
                    gains[state][j] += math.log((c + w * suffix) / (of + w) / suffix)
                suffix = (c + suffix_tree_lm.USUAL * suffix) / (of + suffix_tree_lm.USUAL)
    kept = {s: suffix_tree_lm.WEIGHTS[g.index(max(g))] for s, g in gains.items() if max(g) >= gain}
    scores = []
    for _, words in texts:
        base = score = known = 0
        for i, word in enumerate(words):
            c = seen[0][(word,)]
            known += c > 0
            p = (c + 0.1) / (total + 0.1 * (distinct + 1))
            base += math.log10(p)
            for n in range(1, min(depth, i) + 1):
                state = tuple(words[i - n : i])
                if state in kept:
                    p = (seen[n][(*state, word)] + kept[state] * p) / (seen[n - 1][state] + kept[state])
            score += math.log10(p)
        scores.append((len(words), known, total, base, score))
    return scores, kept


def learned(key):
    return key is not None and zlib.crc32(str(key).encode()) % 10 != 0


@pytest.mark.parametrize("chunk", [1 << 21, 3000])
def test_equals_a_tree_built_by_hand(spark, rows, monkeypatch, chunk):
    """Whatever the chunks: counts of n-grams, kept contexts and scores are those of dictionaries."""
    monkeypatch.setattr(suffix_tree_lm, "CHUNK", chunk)
    monkeypatch.setattr(suffix_tree_lm, "RANGE", chunk)
    scores, kept = by_hand([r[:2] for r in rows], learned)
    assert {len(s) for s in kept} == {1, 2, 3}
    got = {r.doc_id: r for r in suffix_tree_lm.score_by_key(table(spark, SF, "documents")).collect()}
    assert len(got) == len(rows)
    for (key, *_), (n, known, total, base, score) in zip(rows, scores):
        r = got[key]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, not learned(key))
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=1e-5)


def test_held_out_texts_are_more_likely_than_by_word_counts(spark):
    got = [r for r in suffix_tree_lm.score_by_key(table(spark, "/root/testdata/sf0.01", "documents")).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.95 * sum(r.base_score for r in got)


def test_odd_rows(spark, frame):
    got = suffix_tree_lm.score_by_key(frame(ODD))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    found = collections.Counter((r.doc_id, r.n_tokens) for r in got.collect())
    assert found == collections.Counter((k, len((t or "").split()) + 1) for k, t in ODD)
    assert [r.held_out for r in got.collect() if r.doc_id is None] == [False]
    assert suffix_tree_lm.score_by_key(frame([(1, "a")]).limit(0)).count() == 0
    alone = suffix_tree_lm.score(frame([(1, "a b")]), F.lit(False)).first()
    assert (alone.train_tokens, alone.base_score, alone.score) == (0, 0.0, 0.0)


def test_keys_of_any_type(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, None)], "doc_id string, text string")
    assert {r.doc_id for r in suffix_tree_lm.score(docs, F.lit(True)).collect()} == {"a", None}


def test_a_context_of_16_occurrences_is_tested_in_a_large_corpus(spark, frame):
    """The least number of occurrences does not depend on how many tokens the rest of the table has."""
    filler = " ".join(["x"] * 10_000)
    pairs = [(i, filler) for i in range(520)] + [(1000 + i, "quill wren") for i in range(16)] + [(2000, "quill wren")]
    found = suffix_tree_lm.score(frame(pairs), F.col("doc_id") < 2000)
    (row,) = found.where("doc_id = 2000").collect()
    assert row["train_tokens"] > 5_000_000 and not row["n_known"] < 3
    # Only the first word is rare without its context.
    assert row["score"] > row["base_score"] + 5
