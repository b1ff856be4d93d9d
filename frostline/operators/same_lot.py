"""Which sites are the same lot: addresses that are written differently, linked.

An address becomes a number, a unit, a street and its kind, in one spelling. Equal forms are one node, whatever their
number, so copies never make pairs. Two nodes are compared when they share a block: number and unit with the ZIP code, the
city or the sound of the street. A block holds the different streets of one house number in a place or of one sound, so it
stays small at any size, and the join on it is never a square of copies. A pair is linked if nothing that both know
contradicts and the evidence suffices; linked nodes become groups by spreading the lowest id along the links.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.sources.shared import written_once

# Spellings of street kinds and directions, and the words before a unit.
STREET_KINDS = {
    "avenue": ("ave", "av", "avn"), "street": ("st", "str"), "road": ("rd",), "drive": ("dr", "drv"), "lane": ("ln",),
    "court": ("ct", "crt"), "circle": ("cir", "circ"), "boulevard": ("blvd", "boul"), "place": ("pl",), "parkway": ("pkwy", "pky"),
    "highway": ("hwy",), "terrace": ("ter", "terr"), "trail": ("trl", "tr"), "square": ("sq",), "way": ("wy",), "loop": ("lp",),
}
DIRECTIONS = {"north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw"}
UNIT_WORDS = ("apt", "apartment", "unit", "ste", "suite", "bldg", "building", "lot", "no")

FORM = ("number", "unit", "street", "direction", "kind", "city", "state", "zip")


def _spelled(words: Column, spellings: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair])
    return F.transform(words, lambda w: F.coalesce(known[w], w))


def canonical(sites: DataFrame, ident: str = "site_id") -> DataFrame:
    """``ident`` and the parts of the address in one spelling; an absent part is null."""
    unit_word = "|".join(UNIT_WORDS)
    text = F.regexp_replace(F.lower("address"), r"[.,]", " ")
    # A unit is what follows '#' or a unit word, wherever it stands.
    unit = F.regexp_extract(text, rf"(?:#|\b(?:{unit_word})\b)\s*#?\s*([a-z]?[0-9]+[a-z]?)\b", 1)
    rest = F.regexp_replace(text, rf"(?:#|\b(?:{unit_word})\b)\s*#?\s*[a-z]?[0-9]+[a-z]?\b", " ")
    words = F.array_remove(F.split(F.trim(F.regexp_replace(rest, "[^a-z0-9]+", " ")), " "), "")
    number = F.when(F.try_element_at("words", F.lit(1)).rlike("^[0-9]+[a-z]?$"), F.try_element_at("words", F.lit(1)))
    kinds = {short: kind for kind, shorts in STREET_KINDS.items() for short in shorts} | {kind: kind for kind in STREET_KINDS}
    known = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    named = _spelled(F.when(F.col("number").isNotNull(), F.slice("words", 2, 100)).otherwise(F.col("words")), DIRECTIONS)
    # The kind is the last word but a direction that is a kind; a street may have none.
    last = F.try_element_at("named", F.lit(-1))
    ends = F.when(last.isin(*DIRECTIONS.values()) & (F.size("named") > 2), F.try_element_at("named", F.lit(-2))).otherwise(last)
    kind = F.when(F.size("named") > 1, known[ends])
    unkind = F.when(F.col("kind").isNull(), F.col("named")).otherwise(F.array_remove("named", F.col("_kind_word")))
    points = [F.lit(d) for d in DIRECTIONS.values()]
    bare, headed = F.array_except("core", F.array(*points)), F.array_intersect("core", F.array(*points))
    # A street that is called by a direction alone keeps it.
    street = F.array_join(F.when(F.size(bare) > 0, bare).otherwise(F.col("core")), " ")
    direction = F.when((F.size(bare) > 0) & (F.size(headed) > 0), F.array_join(F.array_sort(headed), " "))

    def plain(name: str) -> Column:
        cut = F.trim(F.lower(name))
        return F.when(cut != "", cut).alias(name)

    parted = sites.where(F.col("address").isNotNull()).select(
        F.col(ident), words.alias("words"), F.when(unit != "", F.regexp_replace(unit, "^0+(?=.)", "")).alias("unit"),
        *[plain(c) for c in ("city", "state", "zip")],
    ).withColumn("number", number).withColumn("named", named).withColumn("_kind_word", ends).withColumn("kind", kind)
    parted = parted.withColumn("core", unkind).withColumns({"street": street, "direction": direction})
    return parted.withColumn("zip", F.substring("zip", 1, 5)).select(ident, *FORM)


def links(nodes: DataFrame) -> DataFrame:
    """``a < b`` of different nodes that are the same lot."""
    unit = F.coalesce("unit", F.lit(""))
    blocks = F.explode(F.array_compact(F.array(
        *[F.when(F.col(c).isNotNull(), F.concat_ws("|", F.lit(c), "number", unit, c)) for c in ("zip", "city")],
        F.concat_ws("|", F.lit("s"), F.col("number"), unit, F.soundex(F.substring_index("street", " ", 1))),
    ))).alias("block")
    held = nodes.where(F.col("number").isNotNull() & (F.col("street") != "")).select(blocks, *[F.col(c) for c in ("node", *FORM)])
    left = held.select("block", *[F.col(c).alias(f"{c}_a") for c in ("node", *FORM)])
    right = held.select("block", *[F.col(c).alias(f"{c}_b") for c in ("node", *FORM)])
    pairs = left.join(right, "block").where(F.col("node_a") < F.col("node_b"))

    def both(name: str) -> tuple[Column, Column]:
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        return F.coalesce(a == b, F.lit(False)), F.coalesce(a != b, F.lit(False))

    digits = [F.regexp_replace(f"street_{side}", "[^0-9]", "") for side in "ab"]
    contradicted = reduce(Column.__or__, [both(c)[1] for c in ("direction", "kind", "city", "state", "zip")], digits[0] != digits[1])
    longer = F.greatest(F.length("street_a"), F.length("street_b"))
    edits = F.levenshtein(F.col("street_a"), F.col("street_b"))
    near = (F.least(F.length("street_a"), F.length("street_b")) >= 4) & (edits <= F.greatest(F.lit(1), F.floor(longer / 8)))
    evidence = F.when(edits == 0, 2).when(near, 1).otherwise(-9)
    for name in ("zip", "city"):
        evidence = evidence + both(name)[0].cast("int")
    return pairs.where(~contradicted & (evidence >= 2)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def groups(edges: DataFrame) -> DataFrame:
    """``(id, lowest)`` for every node that has a link: the lowest id it can reach. One round per step of the longest
    chain of spellings; each is written, so that the plan does not grow."""
    both = written_once(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    now = written_once(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("lowest")), "groups")
    while True:
        told = both.join(now, both.b == now.id).groupBy(F.col("a").alias("_of")).agg(F.min("lowest").alias("_told"))
        after = written_once(now.join(told, F.col("id") == F.col("_of")).select("id", F.least("lowest", "_told").alias("lowest"), (F.col("_told") < F.col("lowest")).alias("moved")), "groups")
        if after.where("moved").isEmpty():
            return after.select("id", "lowest")
        now = after.select("id", "lowest")


def lots(sites: DataFrame, ident: str = "site_id") -> DataFrame:
    """``(site_id, lot)`` of the sites that share a lot with another one: ``lot`` is the lowest of their ids. Null
    addresses and those without a house number are no lot."""
    forms = written_once(canonical(sites, ident).where(F.col("number").isNotNull()), "addresses")
    nodes = written_once(forms.groupBy(*FORM).agg(F.min(ident).alias("node"), F.count("*").alias("copies")), "spellings")
    lowest = groups(links(nodes))
    lot = nodes.join(lowest, F.col("node") == F.col("id"), "left").select(
        *[F.col(c).alias(f"_{c}") for c in FORM], F.coalesce("lowest", "node").alias("lot"), (F.col("lowest").isNotNull() | (F.col("copies") > 1)).alias("shared")
    ).where("shared")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FORM])
    return forms.join(lot, same).select(ident, "lot")
