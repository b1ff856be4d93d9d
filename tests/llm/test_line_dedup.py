from __future__ import annotations

import random

from odd import ODD, SF

from frostline.llm import line_dedup as ld
from frostline.llm.queries import op7_line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        fresh = [i]
        for j, y in enumerate(b, 1):
            fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != y)))
        row = fresh
    return row[-1]


def brute(pairs, edits=2, least=30):
    """Rows of equal key and text are alike, so their order does not matter."""
    order = sorted(range(len(pairs)), key=lambda i: (pairs[i][0] is None, pairs[i][0] or 0, i))
    seen, gone = [], {i: [] for i in order}
    for i in order:
        for place, line in enumerate((pairs[i][1] or "").split("\n")):
            if len(line) >= least:
                if any(abs(len(line) - len(x)) <= edits and ld.within(line, x, edits) for x in seen):
                    gone[i].append(place)
                if line not in seen:
                    seen.append(line)
    rows = [(k, 0 if t is None else len(t.split("\n")), len(gone[i]), ",".join(map(str, gone[i]))) for i, (k, t) in enumerate(pairs)]
    return sorted(rows, key=str)


def test_within_is_edit_distance():
    rng = random.Random(1)
    for _ in range(4000):
        a, b = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(2)]
        assert [ld.within(a, b, k) for k in range(4)] == [distance(a, b) <= k for k in range(4)]


def test_whole_table(spark, rows):
    assert sorted(map(tuple, op7_line_dedup(spark, SF).collect()), key=str) == brute([r[:2] for r in rows])


def changed(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        i, kind = rng.randrange(len(out)), rng.randint(0, 2)
        out[i : i + (kind > 0)] = [rng.choice("xyzäé")] if kind < 2 else []
    return "".join(out)


def test_edited_lines(frame, rows):
    rng = random.Random(2)
    pairs = []
    for k, text, *_ in rows[:40]:
        lines = [x[: rng.randint(20, 80)] for x in text.split("\n") if x][:4]
        pairs += [(4 * k + n, "\n".join(changed(rng, x, rng.randint(0, 4)) if n else x for x in lines)) for n in range(4)]
    for edits in (1, 2, 3):
        assert sorted(map(tuple, ld.report(frame(pairs), edits=edits).collect()), key=str) == brute(pairs, edits)


def test_odd_rows(frame):
    line = "a line that is long enough to be compared"
    pairs = ODD + [(10, line), (11, f"{line}!\nshort\n{line}?\nshort"), (None, line)]
    df = frame(pairs)
    assert sorted(map(tuple, ld.report(df).collect()), key=str) == brute(pairs)
    kept = ld.without_repeats(df)
    texts = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert kept.columns == df.columns and kept.count() == len(pairs)
    assert {(1, None), (2, ""), (10, line), (11, "short\nshort"), (None, ""), (None, "word")} <= texts
    assert ld.report(frame([])).isEmpty() and ld.without_repeats(frame([])).isEmpty()


def test_a_line_in_every_document(frame):
    pairs = [(k, f"this very line stands in every document\nbut this one stands in number {k * 7919} alone, {k * 104729}") for k in range(300)]
    assert sorted(map(tuple, ld.report(frame(pairs)).collect()), key=str) == brute(pairs)


def test_an_edit_turns_four_pair_parities_at_most():
    rng = random.Random(5)
    turned = lambda a, b: sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(ld.pair_parities(a), ld.pair_parities(b)))
    for _ in range(3000):
        text = "".join(rng.choice("ab cé日") for _ in range(rng.randint(1, 60)))
        for edits in (1, 2, 3):
            assert turned(text, changed(rng, text, edits) if len(text) > edits else text) <= 4 * edits
    assert turned("", "") == turned("a", "b") == 0


def test_a_segment_that_a_third_of_the_lines_share(frame):
    """A long line with words put in at other places: few of them are near, and those are found."""
    rng = random.Random(6)
    words = "the wind over open water carries salt and sand to every field behind the dunes".split() * 3
    lines = []
    for i in range(120):
        own = list(words)
        for _ in range(3):
            own[rng.randrange(20, len(own))] = "".join(rng.choice("klmnop") for _ in range(6))
        lines.append(" ".join(own))
    lines += [changed(rng, rng.choice(lines), rng.randint(0, 3)) for _ in range(40)]
    lines += ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(240)]
    rng.shuffle(lines)
    pairs = [(i, x) for i, x in enumerate(lines)]
    assert sorted(map(tuple, ld.report(frame(pairs)).collect()), key=str) == brute(pairs)
