"""SentencePiece encoding and decoding on the tokenizers library, from nothing but the model file.

Method: the model's protobuf is parsed here, and from it a tokenizers pipeline is rebuilt: the normaliser with its
prefix and white-space rules, the metaspace marker, the pieces with their scores (unigram models as they are, pair-merge
models as the merges that their scores rank) and byte fallback. Batches of whole texts are encoded by the library's
threads. What it gives is compared with what the SentencePiece library itself gives, and what it decodes with the
normalised input; both outcomes are columns.

Where markers only stand at the start of pieces (checked on the vocabulary; else texts are not cut), no piece can cross
from another character to a marker. A text is then cut into segments of markers and what follows them, and the tokens
of a text are those of its segments in a row. A worker process encodes, compares and decodes a segment once as long as it
remembers it, over all its tasks: segments that it keeps meeting stay, others are forgotten, so that the worker stays
small whatever the texts hold.

Defined results: null and empty texts have no tokens and decode to an empty text. The marker character itself in a text
decodes to a space, as SentencePiece has it. Extra columns are ignored, repeated rows are encoded each. The model is
read by the driver from ``model_path`` and sent to the tasks; its size is that of the vocabulary.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from frostline.llm.common import named

MARK = "▁"
#: Kinds of pieces in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters given to the library at once; bounds the memory of its results.
BATCH_CHARS = 250_000
#: Different segments a worker process has met lately and remembers; it remembers as many it met before those.
KNOWN = 250_000
#: Threads of the library in each task.
THREADS = 2


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of one protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _number(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _number(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """What the protobuf says: pieces ``(text, score, kind)``, the training and the normaliser settings."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        training: dict[int, int | bytes] = {}
        rules: dict[int, int | bytes] = {}
        for field, value in message(data):
            if field == 1:
                own = dict(message(value))
                score = float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0])
                self.pieces.append((own[1].decode(), score, own.get(3, NORMAL)))
            elif field == 2:
                training = dict(message(value))
            elif field == 3:
                rules = dict(message(value))
        self.merges_pairs = training.get(3, 1) == 2
        self.byte_fallback = bool(training.get(35, 0))
        self.unknown = int(training.get(40, 0))
        self.charsmap = rules.get(2, b"")
        self.prefix, self.trims, self.escapes = (bool(rules.get(n, 1)) for n in (3, 4, 5))


def merges(model: Model) -> list[tuple[str, str]]:
    """All splits of a piece into two pieces, the best-scored piece first."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
    found = []
    for piece, s in score.items():
        splits = [(piece[:k], piece[k:]) for k in range(1, len(piece))]
        # Of equal pieces the split whose parts were made first.
        own = sorted(x for x in ((-min(score[a], score[b]), -max(score[a], score[b]), a, b) for a, b in splits if a in score and b in score))
        found += [(-s, i, a, b) for i, (_, _, a, b) in enumerate(own)]
    return [(a, b) for _, _, a, b in sorted(found, key=lambda x: x[:2])]


def backend(data: bytes) -> Tokenizer:
    model = Model(data)
    unknown = model.pieces[model.unknown][0]
    if model.merges_pairs:
        ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(ids, merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    made = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trims:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.prefix:
        steps.append(normalizers.Prepend(MARK if model.escapes else " "))
    if model.escapes:
        steps.append(normalizers.Replace(" ", MARK))
    made.normalizer = normalizers.Sequence(steps)
    if model.escapes and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in model.pieces):
        made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    ends = [decoders.Strip(" ", 1, 0)] if model.prefix else []
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return made


class Codec:
    """Encodes batches of texts; remembers the segments met so far, as far as memory is set aside for it."""

    def __init__(self, data: bytes, threads: int = THREADS):
        # Read by the library when its threads start, which is with the first batch of this process.
        os.environ |= {"TOKENIZERS_PARALLELISM": "true", "RAYON_NUM_THREADS": str(threads)}
        self.ours, self.model = backend(data), Model(data)
        self.theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
        inside = any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in self.model.pieces)
        self.cuts = self.model.escapes and self.model.prefix and not (inside or self.model.trims or self.model.charsmap)
        self.segment = re.compile(f"{MARK}+[^{MARK}]*")
        #: Segment -> its ids, as bytes: of those met lately, and of those met before.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Segments whose tokens differ from the other library's, or that decode to something else.
        self.differ: set[str] = set()
        self.lost: set[str] = set()

    def _plain(self, text: str) -> str:
        text = text.replace(MARK, " ") if self.model.escapes else text
        return re.sub(" {2,}", " ", text).strip(" ") if self.model.trims else text

    def _learn(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool | None]]:
        """Ids, parity and round trip of whole texts. With a character map there is no plain text to compare with."""
        made = [e.ids for e in self.ours.encode_batch_fast(texts, add_special_tokens=False)]
        same = [m == n for m, n in zip(made, self.theirs.encode(texts, num_threads=1))]
        flat = np.fromiter(chain.from_iterable(made), "<i4").tobytes()
        ends = np.cumsum([4 * len(m) for m in made]).tolist()
        ids = [flat[a:b] for a, b in zip([0, *ends], ends)]
        if self.model.charsmap:
            return ids, same, [None] * len(texts)
        back = self.ours.decode_batch(made, skip_special_tokens=False)
        return ids, same, [b == p for b, p in zip(back, map(self._plain, texts))]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool | None]]:
        if not self.cuts:
            made, same, back = self._learn(texts)
            return [np.frombuffer(m, "<i4") for m in made], same, back
        cut = [self.segment.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        every = set().union(*cut)
        if len(self.known) + len(every) > KNOWN:
            self.older, self.known = self.known, {}
            self.differ.intersection_update(self.older)
            self.lost.intersection_update(self.older)
        met = every.difference(self.known)
        # An intersection of a set and a dictionary would walk the dictionary.
        self.known.update((s, self.older[s]) for s in met if s in self.older)
        # A segment is what its text without the first marker is encoded to: the prefix puts the marker back.
        fresh = [s for s in met.difference(self.older) if s != MARK]
        made, same, back = self._learn([s[1:].replace(MARK, " ") for s in fresh])
        self.known.update(zip(fresh, made))
        self.differ.update(s for s, ok in zip(fresh, same) if not ok)
        self.lost.update(s for s, ok in zip(fresh, back) if not ok)
        if MARK in every:
            self._learn_marker()
        ids = [np.frombuffer(b"".join(map(self.known.__getitem__, c)), "<i4") for c in cut]
        return ids, [self.differ.isdisjoint(c) for c in cut], [self.lost.isdisjoint(c) for c in cut]

    def _learn_marker(self) -> None:
        """The tokens of a marker followed by nothing: what a text ending in a letter gains by a space at its end."""
        ours = lambda t: self.ours.encode(t, add_special_tokens=False).ids
        gain = ours("a ")[len(ours("a")) :]
        self.known[MARK] = np.array(gain, "<i4").tobytes()
        if gain != self.theirs.encode("a ")[len(self.theirs.encode("a")) :]:
            self.differ.add(MARK)
        if self.ours.decode(ours("a "), skip_special_tokens=False) != "a ":
            self.lost.add(MARK)


@lru_cache(maxsize=1)
def process_codec(data: bytes) -> Codec:
    """The codec of a model for all tasks that a worker process runs one after the other: what one has met, the next knows."""
    return Codec(data)


def batches_of(texts: list[str], most: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Runs of whole texts of about ``most`` characters; a longer text is a run of its own."""
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """Key, ``n_tokens``, ``ids_sha256`` (of the little-endian 32-bit ids), ``parity``, ``round_trip`` and, if asked
    for, ``input_ids``."""
    with open(model_path, "rb") as file:
        data = file.read()
    sent = docs.sparkSession.sparkContext.broadcast(data)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = process_codec(sent.value)
        for batch in rows:
            at = 0
            for texts in batches_of([t.as_py() or "" for t in batch.column(1)]):
                made, same, back = codec.encode(texts)
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(m) for m in made], pa.int64()),
                    pa.array([hashlib.sha256(m.tobytes()).hexdigest() for m in made], pa.string()),
                    pa.array(same, pa.bool_()),
                    pa.array(back, pa.bool_()),
                ]
                at += len(texts)
                if ids:
                    columns.append(pa.array(made, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    names = ["key", "n_tokens", "ids_sha256", "parity", "round_trip", "input_ids"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, parity boolean, round_trip boolean" + ", input_ids array<int>" * ids
    rows = docs.select(named(key).alias("key"), named(text).alias("text")).mapInArrow(run, schema)
    return rows.withColumnRenamed("key", key)


def decode(encoded: DataFrame, model_path: str, key: str = "doc_id", ids: str = "input_ids") -> DataFrame:
    """Key and ``text`` of encoded rows; null ids decode to an empty text."""
    with open(model_path, "rb") as file:
        sent = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = backend(sent.value)
        for batch in rows:
            texts = ours.decode_batch([i.as_py() or [] for i in batch.column(1)], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(named(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string")
    return rows.withColumnRenamed("key", key)
