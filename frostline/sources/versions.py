"""Versions of the operations tables: a batch of changes rewrites the months it touches, nothing else.

A store keeps the fact table as ``clears/gen=<generation>/storm_month=<month>`` and every other table as
``<table>/gen=<generation>``. A version is a manifest: which generation holds each month and each table. Applying a
batch writes the months of the changed rows to a new generation and a new manifest that points to them and, for all other
months, to where they were. Nothing is overwritten or moved, so readers of an older version go on undisturbed, and a
failed batch leaves files that no manifest names. A branch is a line of versions of its own. One writer per branch: two
that commit the same version number collide when the second manifest is written, and the second one fails.

A rewrite moves whole rows once, to blocks of a month; the rows that a batch names are looked up in narrow columns first and
meet the whole rows there by a hash of the narrow side, so whole rows are sorted by their month only, a block or a few at a time.

Only manifests reach the driver, a row per table and month.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from frostline.schemas import TABLES, conform
from frostline.sources.tables import OpsTables

MAIN = "main"
_FACT = "clears"
#: The manifest's entry for the batch that made a version.
_LOG = "log"
_ENTRY = "table string, storm_month string, gen string"
#: How the partition column spells a clear whose storm is unknown.
_ORPHAN = "__HIVE_DEFAULT_PARTITION__"
#: Clears of a block of a month, about: what one file holds after a rewrite.
BLOCK = 1 << 17
#: Where a clear is rewritten.
_PLACE = ["_month", "_block"]


@dataclasses.dataclass(frozen=True)
class Version:
    branch: str
    number: int
    #: (table, month or None) -> generation
    held: dict[tuple[str, str | None], str]

    def months(self) -> list[str | None]:
        return [month for table, month in self.held if table == _FACT]


class Store:
    """Versioned tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- reading ----------------------------------------------------------------------------------------------------

    def _manifest(self, branch: str, number: int) -> str:
        return f"{self.root}/manifests/{branch}/{number}"

    def _folders(self, path: str) -> list[str]:
        """Names of the folders in a folder."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)
        return [f.getPath().getName() for f in found if f.isDirectory()]

    def version(self, branch: str = MAIN, number: int | None = None) -> Version:
        """A version, by default the latest of its branch."""
        if number is None:
            number = max(int(n) for n in self._folders(f"{self.root}/manifests/{branch}") if n.isdigit())
        rows = self.spark.read.schema(_ENTRY).parquet(self._manifest(branch, number)).collect()
        return Version(branch, number, {(r.table, r.storm_month): r.gen for r in rows})

    def read(self, version: Version | None = None) -> OpsTables:
        """The tables of a version; the fact table keeps its month partitions for pruning."""
        version = version or self.version()
        return OpsTables(**{name: self.read_table(version, name) for name in TABLES})

    def read_table(self, version: Version, name: str, months: list[str | None] | None = None) -> DataFrame:
        """One table, of the fact table only ``months`` if they are given."""
        schema, base = TABLES[name], f"{self.root}/{name}"
        if name != _FACT:
            return self.spark.read.schema(schema).parquet(f"{base}/gen={version.held[name, None]}")
        wanted = version.months() if months is None else [m for m in version.months() if m in set(months)]
        paths = [f"{base}/gen={version.held[name, m]}/storm_month={_ORPHAN if m is None else m}" for m in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        with_gen = StructType([*schema.fields, StructField("gen", StringType())])
        return self.spark.read.schema(with_gen).option("basePath", base).parquet(*paths).select(*schema.names)

    # -- writing ----------------------------------------------------------------------------------------------------

    def write(self, df: DataFrame, name: str, gen: str, by_month: bool = False) -> None:
        """Write a generation of a table, the fact table by month; no version holds it yet. Rows that lie ``by_month``
        already are not shuffled."""
        path, out = f"{self.root}/{name}/gen={gen}", conform(df, TABLES[name])
        if name == _FACT:
            laid = out if by_month else out.hint("rebalance", F.col("storm_month"))
            laid.write.option("compression", "zstd").partitionBy("storm_month").parquet(path)
        else:
            out.write.option("compression", "zstd").parquet(path)

    def written(self, name: str, gen: str) -> DataFrame:
        """A whole generation of a table, as it was written."""
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/gen={gen}")

    def _commit(self, version: Version) -> Version:
        rows = [(table, month, gen) for (table, month), gen in version.held.items()]
        manifest = self.spark.createDataFrame(rows, _ENTRY).coalesce(1)
        manifest.write.mode("errorifexists").parquet(self._manifest(version.branch, version.number))
        return version

    def _months_in(self, gen: str) -> list[str | None]:
        """The months of a generation, from its folders."""
        names = self._folders(f"{self.root}/{_FACT}/gen={gen}")
        months = [n.partition("=")[2] for n in names if n.startswith("storm_month=")]
        return [None if m == _ORPHAN else m for m in months]

    def adopt(self, written: dict[str, str], branch: str = MAIN) -> Version:
        """The first version of a branch, over generations that are written already (table -> generation)."""
        held = {(name, None): gen for name, gen in written.items() if name != _FACT}
        held |= {(_FACT, month): written[_FACT] for month in self._months_in(written[_FACT])}
        return self._commit(Version(branch, 1, held))

    def write_first(self, tables: OpsTables, branch: str = MAIN) -> Version:
        gen = uuid.uuid4().hex
        for name in TABLES:
            self.write(getattr(tables, name), name, gen)
        return self.adopt(dict.fromkeys(TABLES, gen), branch)

    def _batch(self, df: DataFrame, gen: str, part: str) -> DataFrame:
        """A part of a batch, written once: Spark then knows its size, and it is read several times."""
        path = f"{self.root}/batches/{gen}/{part}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _named(self, before: DataFrame, named: DataFrame, gen: str) -> DataFrame:
        """``(clear_id, storm_month)`` of the clears of ``before`` that ``named(clear_id)`` names, once each."""
        asked = self._batch(named.select("clear_id").distinct(), gen, "asked")
        ids = before.select("clear_id", "storm_month").join(self._met(asked), "clear_id", "left_semi")
        return self._batch(ids.distinct(), gen, "named")

    def _met(self, ids: DataFrame) -> DataFrame:
        """Written ids for a join: a few are broadcast, many are met by a hash of them, whatever Spark takes their files for."""
        return ids if ids.count() <= BLOCK else ids.hint("shuffle_hash")

    def _placing(self, *frames: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """How the clears of ``frames`` are brought together by blocks of their months, a month in as many as its rows ask for."""
        counts: dict[str, int] = {}
        for frame in frames:
            for r in frame.groupBy("storm_month").count().collect():
                month = _ORPHAN if r.storm_month is None else r.storm_month
                counts[month] = counts.get(month, 0) + r["count"]
        blocks = {month: -(-n // BLOCK) for month, n in counts.items() if n > BLOCK}
        parts = max(2, -(-sum(counts.values()) // BLOCK))  # a single one would be dealt out again by the join
        month = F.coalesce("storm_month", F.lit(_ORPHAN))
        of = F.lit(1)
        if blocks:
            of = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]), month), of)
        block = F.pmod(F.xxhash64("clear_id"), of.cast("long"))
        return lambda df: df.withColumns({"_month": month, "_block": block}).repartition(parts, *_PLACE)

    def _next(self, base: Version, held: dict, touched: list[str | None], gen: str, branch: str | None) -> Version:
        written = set(self._months_in(gen)) if touched else set()
        for month in touched:
            held.pop((_FACT, month), None)
            if month in written:
                held[_FACT, month] = gen
        line = base.branch if branch is None else branch
        return self._commit(Version(line, base.number + 1 if line == base.branch else 1, held))

    def apply(
        self, base: Version, changed: DataFrame | None = None, gone: DataFrame | None = None, branch: str | None = None,
        log: bool = False, **whole: DataFrame,
    ) -> Version:
        """The version after ``base``: ``changed`` clears (whole rows, new ones included) and ``gone`` ones
        (``clear_id, storm_month``) replace their months, ``whole`` tables are replaced. On another ``branch`` the
        line starts there with version 1. A batch that changes nothing still makes a version. With ``log`` the batch's
        signed rows are kept for :meth:`logged`."""
        gen = uuid.uuid4().hex
        held = {k: v for k, v in base.held.items() if k[0] != _LOG}
        touched: list[str | None] = []
        for name, df in whole.items():
            self.write(df, name, gen)
            held[name, None] = gen
        if changed is not None or gone is not None:
            rows = self.spark.createDataFrame([], TABLES[_FACT]) if changed is None else conform(changed, TABLES[_FACT])
            rows = self._batch(rows, gen, "rows")
            named = rows.select("clear_id", "storm_month")
            if gone is not None:
                named = named.unionByName(gone.select("clear_id", "storm_month"))
            touched = [r[0] for r in named.select("storm_month").distinct().collect()]
            before = self.read_table(base, _FACT, touched)
            found = self._named(before, named, gen)
            if log:
                was = before.join(self._met(found.select("clear_id")), "clear_id", "left_semi").select(*TABLES[_FACT].names)
                signed = was.withColumn("sign", F.lit(-1)).unionByName(rows.withColumn("sign", F.lit(1)))
                signed.write.option("compression", "zstd").parquet(f"{self.root}/log/{gen}")
                held[_LOG, None] = gen
            placed = self._placing(before, rows)
            known = placed(found).select(*_PLACE, "clear_id").hint("shuffle_hash")
            kept = placed(before).join(known, [*_PLACE, "clear_id"], "left_anti").select(*TABLES[_FACT].names)
            self.write(kept.unionByName(placed(rows).select(*TABLES[_FACT].names)), _FACT, gen, by_month=True)
        return self._next(base, held, touched, gen, branch)

    def mark(
        self, base: Version, marks: DataFrame, update: Callable[[DataFrame], DataFrame], branch: str | None = None,
    ) -> Version:
        """The version after ``base`` in which the clears that ``marks(clear_id)`` names are as ``update`` makes them.

        ``update`` takes clears with a column ``_marked`` (true or null) and may change all but their ids and months. Other than with
        :meth:`apply`, whole rows are moved by the rewrite alone: only ids are moved to find the marked ones."""
        gen = uuid.uuid4().hex
        held = {k: v for k, v in base.held.items() if k[0] != _LOG}
        found = self._named(self.read_table(base, _FACT), marks, gen)
        touched = [r[0] for r in found.select("storm_month").distinct().collect()]
        if touched:
            before = self.read_table(base, _FACT, touched)
            placed = self._placing(before)
            known = placed(found).select(*_PLACE, "clear_id", F.lit(True).alias("_marked")).hint("shuffle_hash")
            self.write(update(placed(before).join(known, [*_PLACE, "clear_id"], "left")), _FACT, gen, by_month=True)
        return self._next(base, held, touched, gen, branch)

    def logged(self, version: Version) -> DataFrame:
        """The signed clears of the batch that made a version: ``sign`` -1 as they were, 1 as they are."""
        schema = StructType([*TABLES[_FACT].fields, StructField("sign", IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/log/{version.held[_LOG, None]}")
