"""A Merkle manifest of a dataset, and proofs for its rows by octopus multiproofs.

Every row is a leaf: the digest of its fields, nulls and lengths included. The leaves of a split (a source) stand in
order of their key; while more than one node is left, every ``WIDTH`` neighbours become their digest, the last run as
short as it falls, even one. What is left is the split's subroot; the subroots in order of the splits become the root
the same way. The manifest is the table of all nodes by ``(tree, level, at)``: ``tree`` numbers the splits in order,
``TOP`` is the tree over them, level 0 holds the leaves.

Method (octopus multiproof): the rows to be proved are dealt into partitions of neighbours, ``WIDTH ** DEPTH``
positions of a tree. Each partition computes the union of the coordinates that all its rows miss: level by level the
siblings of what it knows or has derived, none of them twice. These coordinates are fetched once, by one join with the
manifest. From its rows and the fetched nodes the partition derives every shared interior once, and expands the single
proofs from that table: a row's proof is its siblings in every level, leaf to root. A row whose content was changed is
folded on its own with the original siblings.

Scale: numbering is a range sort of digests, not of texts, with positions from counts per sorted partition; a hot source
or key is cut by further sort columns, equal rows by where they are stored. Partitions have a fixed size, so no task
holds a split or a tree. Levels are built ``DEPTH`` at a time, a logarithmic number of rounds. A partition asks for a few
nodes a level. Nothing but the counts of the trees and the root reaches the driver.

Defined results: null fields are ``-``; null keys and splits come first; rows with one key are ordered by their digest,
equal rows are interchangeable and have positions of their own. Extra columns are ignored. An empty table has no root
(``None``) and no proofs.
"""

from __future__ import annotations

import dataclasses
import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.common import named, stored

#: Children of a node.
WIDTH = 3
#: Levels that one partition spans: ``WIDTH ** DEPTH`` neighbours.
DEPTH = 8
#: The tree over the subroots.
TOP = -1
#: Rows that one sorted partition holds, about.
SORTED_ROWS = 500_000

_NODE = "tree long, level int, at long, digest string"


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def combined(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def height(size: int) -> int:
    """Levels above the leaves of a tree with so many."""
    levels = 0
    while size > 1:
        size = -(-size // WIDTH)
        levels += 1
    return levels


def _height(size: Column) -> Column:
    return reduce(Column.__add__, [(size > WIDTH**j).cast("int") for j in range(40)])


@dataclasses.dataclass(frozen=True)
class Manifest:
    """``leaves``: key, split, leaf, altered, tree, size, at. ``nodes``: the levels above. ``trees``: split, tree, size.
    ``root``: the digest over all, ``splits``: how many trees it covers."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None
    splits: int


def _numbered(df: DataFrame, within: list[str], order: list[str], purpose: str) -> tuple[DataFrame, DataFrame]:
    """``df`` (a stored table) with ``_at``, its place in a sort by ``within`` and ``order``, and the runs of it: one row
    per sorted partition and ``within``, with the place of its first row and its start position within the group."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SORTED_ROWS))
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    keys = [named(c).asc_nulls_first() for c in (*within, *order)]
    spread = df.withColumn("_place", place).repartitionByRange(parts, *keys, F.col("_place"))
    ranked = spread.sortWithinPartitions(*keys, "_place").drop("_place").withColumn("_at", F.monotonically_increasing_id())
    ranked = stored(ranked, purpose).withColumn("_part", F.shiftright("_at", 33))
    runs = ranked.groupBy(*within, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return ranked, runs.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def _climbed(rows: DataFrame, base: int) -> DataFrame:
    """The nodes of up to ``DEPTH`` levels above ``rows(tree, size, at, digest)``, which are of level ``base``;
    ``size`` is the tree's number of nodes there."""
    span = WIDTH**DEPTH

    def climb(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        tree, left = block["tree"][0].as_py(), block["size"][0].as_py()
        start, digests = block["at"][0].as_py(), block["digest"].to_pylist()
        out: list[tuple] = []
        for level in range(base + 1, base + DEPTH + 1):
            if left == 1:
                break
            digests = [combined(digests[k : k + WIDTH]) for k in range(0, len(digests), WIDTH)]
            start, left = start // WIDTH, -(-left // WIDTH)
            out += [(tree, level, start + k, digest) for k, digest in enumerate(digests)]
        columns = list(zip(*out)) or [()] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string())
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["tree", "level", "at", "digest"])

    blocks = rows.where(F.col("size") > 1).withColumn("_block", F.floor(F.col("at") / span))
    return blocks.groupBy("tree", "_block").applyInArrow(climb, _NODE)


def _levels(rows: DataFrame, largest: int, purpose: str) -> list[DataFrame]:
    """All levels above the leaves ``rows(tree, size, at, digest)``; ``largest`` is the size of the largest tree."""
    found: list[DataFrame] = []
    base = 0
    sizes = rows.select("tree", "size").distinct() if height(largest) > DEPTH else None
    while base < height(largest):
        made = stored(_climbed(rows, base), purpose)
        found.append(made)
        base += DEPTH
        if base < height(largest):
            left = F.ceil(F.col("size") / float(WIDTH**base)).cast("long")
            rows = made.where(F.col("level") == base).join(sizes, "tree").select("tree", left.alias("size"), "at", "digest")
    return found


def build(
    docs: DataFrame, key: str = "doc_id", split: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    altered: dict[str, Column] | None = None, among: Column | None = None,
) -> Manifest:
    """The manifest of ``docs``. ``altered`` replaces fields of the rows ``among``, whose leaf of the changed content is
    kept beside the original one, as ``altered``, to be proved against the manifest."""
    spark = docs.sparkSession
    changed = F.lit(None).cast("string")
    if altered:
        changed = F.when(F.lit(True) if among is None else among, leaf_digest(*[altered.get(f, named(f)) for f in fields]))
    rows = stored(docs.select(
        named(key).alias("key"), named(split).alias("split"), leaf_digest(*[named(f) for f in fields]).alias("leaf"),
        changed.alias("altered"),
    ), "merkle-leaves")
    ranked, runs = _numbered(rows, ["split"], ["key", "leaf"], "merkle-ranked")

    sizes = stored(runs.groupBy("split").agg(F.sum("_n").alias("size")), "merkle-splits")
    ordered, spans = _numbered(sizes, [], ["split"], "merkle-order")
    trees = stored(
        ordered.join(spans, "_part").select("split", "size", (F.col("_start") + F.col("_at") - F.col("_first")).alias("tree")),
        "merkle-trees",
    )
    splits, largest = trees.agg(F.count("*"), F.max("size")).first()

    placed = runs.join(trees.withColumnRenamed("split", "_split"), F.col("split").eqNullSafe(F.col("_split")))
    placed = placed.select("_split", F.col("_part").alias("_run"), "_first", "_start", "tree", "size")
    same = F.col("split").eqNullSafe(F.col("_split")) & (F.col("_part") == F.col("_run"))
    leaves = stored(ranked.join(placed, same).select(
        "key", "split", "leaf", "altered", "tree", "size", (F.col("_start") + F.col("_at") - F.col("_first")).alias("at")
    ), "merkle-placed")

    bottom = leaves.select("tree", "size", "at", F.col("leaf").alias("digest"))
    nodes = _levels(bottom, largest or 0, "merkle-nodes")
    zero = bottom.select("tree", F.lit(0).alias("level"), "at", "digest")
    whole = reduce(DataFrame.unionByName, nodes, zero)
    subroots = whole.join(trees, "tree").where(F.col("level") == _height(F.col("size")))
    top = stored(subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(splits).cast("long").alias("size"), F.col("tree").alias("at"), "digest"
    ), "merkle-subroots")
    above = _levels(top, splits, "merkle-top")
    crown = reduce(DataFrame.unionByName, above, top.select("tree", F.lit(0).alias("level"), "at", "digest"))
    last = crown.where(F.col("level") == height(splits)).select("digest").first() if splits else None
    return Manifest(leaves, whole.unionByName(crown), trees, last[0] if last else None, splits)


def missing(known: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """Per level the positions a holder of the leaves ``known`` has to be told to derive the root: siblings of what it
    knows or derives."""
    found = []
    level = 0
    known = np.unique(known)
    while size > 1:
        parents = np.unique(known // WIDTH)
        children = (parents[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        gap = np.setdiff1d(children[children < size], known, assume_unique=True)
        if len(gap):
            found.append((level, gap))
        known, size, level = parents, -(-size // WIDTH), level + 1
    return found


def _wanted(splits: int):
    def union_of_missing(block: pa.Table) -> pa.Table:
        tree, size = block["tree"][0].as_py(), block["size"][0].as_py()
        owner = block["_block"][0].as_py()
        out: list[tuple] = []
        for of, known, count in ((tree, block["at"].to_numpy(), size), (TOP, np.array([tree]), splits)):
            out += [(tree, owner, of, level, int(at)) for level, gap in missing(known, count) for at in gap]
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["owner", "_block", "tree", "level", "at"])

    return union_of_missing


class _Paths:
    """One tree as a partition sees it: known leaves, fetched nodes, the interiors derived from both."""

    def __init__(self, known: dict[int, str], fetched: list[dict[int, str]], size: int):
        self.levels: list[dict[int, str]] = []
        self.sizes: list[int] = []
        for level in range(height(size) + 1):
            held = known | fetched[level] if level < len(fetched) else known
            self.levels.append(held)
            self.sizes.append(size)
            known = {p: combined(self.run(level, p)) for p in {at // WIDTH for at in known}} if size > 1 else known
            size = -(-size // WIDTH)
        self._above: dict[tuple[int, int], str] = {}

    def run(self, level: int, parent: int) -> list[str]:
        held = self.levels[level]
        return [held[k] for k in range(parent * WIDTH, min(parent * WIDTH + WIDTH, self.sizes[level]))]

    def siblings(self, level: int, at: int) -> str:
        """The siblings of a node and of all nodes above it, level by level, joined."""
        if level == len(self.levels) - 1:
            return ""
        above = self._above.get((level + 1, at // WIDTH))
        if above is None:
            above = self._above[level + 1, at // WIDTH] = self.siblings(level + 1, at // WIDTH)
        run = self.run(level, at // WIDTH)
        return "".join(run[: at % WIDTH] + run[at % WIDTH + 1 :]) + above

    def folded(self, digest: str, at: int) -> str:
        """The root that follows from ``digest`` at a leaf's place and the original siblings."""
        for level in range(len(self.levels) - 1):
            run = self.run(level, at // WIDTH)
            run[at % WIDTH] = digest
            digest, at = combined(run), at // WIDTH
        return digest

    @property
    def root(self) -> str:
        return self.levels[-1][0]


def _expander(splits: int):
    def expand(block: pa.Table, told: pa.Table) -> pa.Table:
        tree, size = block["tree"][0].as_py(), block["size"][0].as_py()
        fetched = {of: [{} for _ in range(height(count) + 1)] for of, count in ((tree, size), (TOP, splits))}
        for of, level, at, digest in zip(*(told[c].to_pylist() for c in ("tree", "level", "at", "digest"))):
            fetched[of][level][at] = digest
        places, leaves, altered = (block[c].to_pylist() for c in ("at", "leaf", "altered"))
        own = _Paths(dict(zip(places, leaves)), fetched[tree], size)
        top = _Paths({tree: own.root}, fetched[TOP], splits)
        crown = top.siblings(0, tree)
        proofs = [hashlib.sha256((own.siblings(0, at) + crown).encode()).hexdigest() for at in places]
        folded = [
            top.root if new is None or new == old else top.folded(own.folded(new, at), tree)
            for at, old, new in zip(places, leaves, altered)
        ]
        n = len(places)
        kept = block.select(["key", "leaf"])
        return kept.append_column("subroot", pa.array([own.root] * n, pa.string())).append_column(
            "proof_sha256", pa.array(proofs, pa.string())
        ).append_column("folded_root", pa.array(folded, pa.string()))

    return expand


def prove(manifest: Manifest, wanted: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """The proofs of all leaves, or of ``wanted``, rows of ``manifest.leaves``: key, leaf, subroot, root, the digest of
    the siblings, the root folded from the altered leaf (else from the leaf itself) and whether it is the root."""
    rows = manifest.leaves if wanted is None else wanted
    blocks = rows.withColumn("_block", F.floor(F.col("at") / WIDTH**DEPTH))
    needs = blocks.select("tree", "size", "at", "_block").groupBy("tree", "_block").applyInArrow(
        _wanted(manifest.splits), "owner long, _block long, tree long, level int, at long"
    )
    told = needs.join(manifest.nodes, ["tree", "level", "at"])
    kind = rows.schema["key"].dataType.simpleString()
    made = blocks.groupBy("tree", "_block").cogroup(told.groupBy("owner", "_block")).applyInArrow(
        _expander(manifest.splits), f"key {kind}, leaf string, subroot string, proof_sha256 string, folded_root string"
    )
    root = F.lit(manifest.root).cast("string")
    return made.select(
        F.col("key").alias(key), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


def tampered(docs: DataFrame) -> DataFrame:
    """Proofs of all documents; where 2 divides the key's CRC-32, the text has lost its line feeds on the way."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return prove(build(docs, altered={"text": F.replace("text", F.lit("\n"), F.lit(""))}, among=hit))
