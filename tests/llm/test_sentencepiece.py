from __future__ import annotations

import hashlib

import numpy as np
import pytest
import sentencepiece
from odd import ODD, SF

from frostline.llm import sentencepiece_codec as s
from frostline.llm.queries import TOKENIZERS, op5_sentencepiece

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
TEXTS = [
    "", " ", "  a  b ", "a ", "▁x▁▁", "<s> <0x0A> </s><unk>", "日本語 😀\u0000x", "a" * 300, "\n\n\t x", "aaaaaaa ooooo 0000000 ======",
    "﻿​", "   ", "élan vital", "x" + " " * 70 + "y",
]


@pytest.fixture(scope="module")
def theirs():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_whole_table_against_the_library(spark, rows, theirs):
    got = {r["doc_id"]: r for r in op5_sentencepiece(spark, SF).collect()}
    for key, text, *_ in rows:
        ids = np.array(theirs.encode(text), "<i4")
        assert got[key]["n_tokens"] == len(ids) and got[key]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[key]["parity"] and got[key]["round_trip"]


def test_difficult_texts(theirs):
    with open(MODEL, "rb") as file:
        data = file.read()
    codec, plain = s.Codec(data), s.backend(data)
    assert codec.cuts
    made, same, back = codec.encode(TEXTS)
    assert [m.tolist() for m in made] == theirs.encode(TEXTS) and all(same) and all(back)
    codec.cuts = False
    assert [m.tolist() for m in codec.encode(TEXTS)[0]] == theirs.encode(TEXTS)
    assert plain.decode_batch(theirs.encode(TEXTS), skip_special_tokens=False) == [t.replace("▁", " ") for t in TEXTS]


def test_odd_rows_and_decoding(frame):
    encoded = s.encode(frame(ODD), MODEL)
    got = sorted(((r["doc_id"], r["text"]) for r in s.decode(encoded, MODEL).collect()), key=str)
    assert got == sorted(((k, t or "") for k, t in ODD), key=str)
    assert s.encode(frame([]), MODEL).isEmpty()


def test_batches_hold_every_text_once():
    texts = ["a" * n for n in (0, 5, 30, 2, 2, 2, 50, 0)]
    runs = list(s.batches_of(texts, 10))
    assert [t for r in runs for t in r] == texts and all(len(r) == 1 or sum(map(len, r)) <= 10 for r in runs)


def test_worker_forgets_what_it_no_longer_meets(theirs, monkeypatch):
    """A worker lives on after its stage: what it remembers is bounded, and what every batch holds is learned once."""
    assert 2 * s.KNOWN <= 500_000
    monkeypatch.setattr(s, "KNOWN", 60)
    with open(MODEL, "rb") as file:
        codec = s.Codec(file.read())
    learned = []
    learn = codec._learn
    monkeypatch.setattr(codec, "_learn", lambda texts: learned.extend(texts) or learn(texts))
    for n in range(20):
        texts = [f"winter storm ▁ {n}x{k} " for k in range(40)]
        assert [m.tolist() for m in codec.encode(texts)[0]] == theirs.encode(texts)
        assert len(codec.known) + len(codec.older) <= 120
    assert learned.count("winter") == learned.count("storm") == 1 and len(learned) == 802
