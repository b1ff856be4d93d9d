from __future__ import annotations

import hashlib
import re

from odd import ODD, SF

from frostline.llm import pii
from frostline.llm.queries import op1_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        worth = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(worth) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(key, text):
    spans = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]
    shown = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (key, *[sum(s[0] == k for s in spans) for k in PATTERNS], hashlib.sha256(shown.encode()).hexdigest()), set(shown.split(","))


def same(df, pairs):
    rows = df.collect()
    assert sorted((tuple(r)[:6] for r in rows), key=str) == sorted((brute(*p)[0] for p in pairs), key=str)
    return rows


def test_whole_table(spark, rows):
    pairs = {r[0]: r[1] for r in rows}
    for r in same(op1_pii(spark, SF), pairs.items()):
        assert brute(r["doc_id"], pairs[r["doc_id"]])[1] <= set(r["spans"].split(",")) | {""}


HARD = [
    "a@b.c_d@e.f x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 0000000001.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111",
    "+1 (555) 555-1234) +49..(12 +33 1 23 45 67 89 0123456789", "é😀 a+b@c-d.e-f", "4111111111111111 4111111111111111", "+1((((((((((",
    "4111  1111 1111 1111", "%%% a.b@c.d@e.f..g@h", "10.0.0.1.", "1-2-3", "+12 345 678 9",
]


def test_hard_and_odd_rows(frame):
    pairs = ODD + [(50 + i, t) for i, t in enumerate(HARD)]
    pairs += [(90, "1 2 3 4 5 6 7 8 9 0 1 2 3" * 4000), (91, "a." * 20000), (92, "+" * 2000 + "1" * 50), (93, "a." * 20000 + "@b.c")]
    same(pii.find(frame(pairs)), pairs)
    assert pii.find(frame([])).isEmpty()


def test_the_trees_add_written_out_addresses_and_single_numbers(frame):
    pairs = [(i, f"so it was said, mail me at person{i}@mail{i}.example.org please") for i in range(200)]
    pairs += [(1000 + i, f"my card {4000000000000000 + 9973 * i} is new") for i in range(800)]
    pairs += [(5000, "write to jane (at) mail.example (dot) org now"), (5001, "cards 4111111111111111 4111111111111111 both"), (5002, "nothing here at all, dot")]
    got = {r["doc_id"]: r["spans"] for r in same(pii.find(frame(pairs)), pairs)}
    assert got[5001] == "card:6:22,card:23:39"
    assert got[5000] in ("email:9:41", "") and got[5002] == ""


def test_the_context_decides_between_equal_candidates(frame):
    pairs = [(i, f"you may call me on +1 555 {1000 + i} 444 any day") for i in range(200)]
    pairs += [(300 + i, f"the build id=+1 {i} was made") for i in range(200)]
    pairs += [(600 + i, f"please write to person{i}@mail{i}.example.org soon") for i in range(200)]
    pairs += [(900 + i, f"the build id=pack{i}@1.{i}.7 was made") for i in range(200)]
    asked = {5000: "you may call me on (555) 555-1234 any day", 5001: "the build id=(555) 555-1234 was made",
             5002: "please write to jane (at) mail.example (dot) org soon", 5003: "the build id=jane (at) mail.example (dot) org was made"}
    pairs += asked.items()
    got = {r["doc_id"]: r["spans"] for r in same(pii.find(frame(pairs)), pairs)}
    assert [got[k] for k in asked] == ["phone:19:33", "", "email:16:48", ""]


def test_no_feature_tells_what_the_rule_says(frame):
    """Two spans in one context, of which the rule accepts one, have the same features."""
    pairs = [(1, "at 4111111111111111 now"), (2, "at 4111111111111112 now"), (3, "at 12 now")]
    spans = pii.with_formats(pii.candidates(frame(pairs), "doc_id", "text")[1]).where("base")
    full, names = pii.with_features(spans)
    rows = full.collect()
    assert {r["rule"] for r in rows} == {True, False} and len({tuple(r[n] for n in names) for r in rows}) == 1


def test_plan_has_no_python(frame):
    rows, spans = pii.candidates(frame(ODD), "doc_id", "text")
    plan = pii.with_features(pii.with_formats(spans))[0]._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
