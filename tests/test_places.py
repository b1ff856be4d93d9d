"""Addresses of one lot are linked, those of neighbours are not; a batch of words said finds its sites by trigrams."""

from __future__ import annotations

import random

import pytest

from frostline.operators import place_index, same_lot


def sites(spark, *rows):
    return spark.createDataFrame(list(rows), "site_id long, address string, city string, state string, zip string")


def linked(spark, *rows):
    return {r.site_id: r.lot for r in same_lot.lots(sites(spark, *rows)).collect()}


@pytest.mark.parametrize("other", [
    "742 Evergreen Ter.", "742 EVERGREEN TERRACE", "742  evergreen terr", "742 Evergren Terrace", "742 Evergreen",
])
def test_spellings_of_one_lot(spark, other):
    assert linked(spark, (1, "742 Evergreen Terrace", "Ashfield", "MN", "55002"), (2, other, "ashfield", None, "55002-1234")) == {1: 1, 2: 1}


@pytest.mark.parametrize("other", [
    "744 Evergreen Terrace", "742 Evergreen Court", "742 Evergreen Terrace #2", "742 Elm Terrace", "74 2 Evergreen Terrace", "Evergreen Terrace",
])
def test_neighbours_stay_apart(spark, other):
    assert linked(spark, (1, "742 Evergreen Terrace", "Ashfield", "MN", "55002"), (2, other, "Ashfield", "MN", "55002")) == {}


def test_numbered_streets_and_streets_called_by_a_direction(spark):
    rows = [(1, "5 12th Avenue", "Ashfield", "MN", "55002"), (2, "5 13th Avenue", "Ashfield", "MN", "55002"), (3, "5 12th Av.", "Ashfield", "MN", "55002"),
            (4, "5 North Street", "Ashfield", "MN", "55002"), (5, "5 N St", "Ashfield", "MN", "55002"), (6, "5 South St", "Ashfield", "MN", "55002")]
    assert linked(spark, *rows) == {1: 1, 3: 1, 4: 4, 5: 4}


def test_units_directions_and_places(spark):
    found = linked(
        spark, (5, "#12 90 N Oak Ave", None, "MN", "55002"), (6, "90 North Oak Avenue, Ste 12", "Ashfield", "MN", None),
        (7, "90 North Oak Av Unit 012", "Ashfield", "MN", "55002"), (8, "90 North Oak Avenue Apt 12B", "Ashfield", "MN", "55002"),
        (9, "90 North Oak Avenue, Ste 12", "Brookmoor", "MN", "55003"), (10, "90 South Oak Avenue, Ste 12", "Ashfield", "MN", "55002"),
        (11, None, "Ashfield", "MN", "55002"), (12, "", None, None, None),
    )
    assert found == {5: 5, 6: 5, 7: 5}


def test_copies_and_chains(spark):
    """Equal spellings make no pairs; a lot is found through a spelling in the middle."""
    rows = [(i, "10 Harbor Street", "Ashfield", "MN", "55002") for i in range(100, 160)]
    rows += [(2, "10 Harbr St", "Ashfield", "MN", "55002"), (3, "10 Harbr St", None, "MN", "55002"), (900, "11 Harbor St", "Ashfield", "MN", "55002")]
    found = linked(spark, *rows)
    assert set(found.values()) == {2} and len(found) == 62
    nodes = same_lot.canonical(sites(spark, *rows)).drop("site_id").distinct()
    assert nodes.count() == 4
    assert linked(spark) == {}


def test_words_said_find_what_a_scan_finds(spark):
    """Ten thousand phrases against all sites, short ones, unknown ones and marks included."""
    rng = random.Random(4)
    words = ["Ring", "Harbor", "Élan", "Oak 50%", "Mill_Pond", "St", "A"]
    rows = [(i, f"{rng.randrange(400)} {rng.choice(words)} {rng.choice(words)}", rng.choice([*words, None])) for i in range(400)]
    table = spark.createDataFrame(rows, "site_id long, address string, street_name string")
    said = []
    for i in range(10_000):
        text = rng.choice(rows)[1]
        start = rng.randrange(len(text))
        said.append((i, rng.choice([str.upper, str.lower])(text[start : start + rng.choice([1, 2, 3, 4, 6, 9])])))
    said += [(-1, "zzz"), (-2, ""), (-3, None), (-4, "%"), (-5, "_"), (-6, "  ")]
    asked = spark.createDataFrame(said, "request_id long, said string")
    got = place_index.match_places(table, asked)
    expected = {
        (n, i) for n, s in said if s and s.strip(" ") for i, address, street in rows
        if s.strip(" ").lower() in address.lower() or s.strip(" ").lower() in (street or "").lower()
    }
    assert {tuple(r) for r in got.collect()} == expected and got.count() == len(expected)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
