"""Personal data: base rules, and boosted trees that choose among more candidate spans.

Method: generators with high recall propose spans that may overlap: the base patterns of the four kinds, and wider ones
(addresses written with "at" and "dot", numbers with other separators, single groups of a longer run of digits, numbers
without a country code). A candidate is judged twice, by views that share nothing: the rule of its kind judges its
characters (digits, checksum, parts), gradient-boosted trees judge its context (what stands before and after). The trees
learn from base matches, in what contexts the rule accepts; nothing that the rule looks at is a feature. A base match
that the rule accepts is a labelled one, one that it refuses is not labelled rather than wrong: a context in which the
rule accepts a share ``g`` is right with ``g / c``, ``c`` being the mean of ``g`` over accepted matches. A threshold for
each kind is calibrated on base matches that the trees have not seen: the lowest whose contexts at or above it are right
with ``Settings.precision`` together, and those of its bin by half. Base spans always stay; another candidate is added if
its rule accepts it, its context reaches the threshold, it overlaps no base span, and no better candidate overlaps it.
Where contexts tell nothing (one share in all of them) the rule decides alone.

Only DataFrame functions and Spark's own tree learner are used. Positions come from splitting a text at its matches:
the lengths of gaps and matches, summed in order. Only texts with matches leave the scan, without their text. Training
uses at most about ``Settings.sample`` candidates, chosen by a hash; statistics for the thresholds use all of the rest.

Defined results: null and empty texts have no spans. Repeated rows and equal keys are judged each. Positions count code
points, the end is exclusive. Extra columns are ignored. Without candidates of both outcomes nothing is added to the
base spans. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.common import held, named, stored

KINDS = ("email", "ip", "card", "phone")

# Possessive quantifiers and the look-behind keep matching linear in the text and off the call stack; they match what
# the plain patterns match, from left to right. \G allows a match to start where the one before ended.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:\x20?[0-9]|-[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AT, DOT = r"\x20?[\[({]at[\])}]\x20?", r"\x20?[\[({]dot[\])}]\x20?"
WIDER = {
    "email": (
        rf"(?:\G|(?<!{LOCAL})){LOCAL}{{1,64}}+{AT}[A-Za-z0-9-]{{1,64}}+(?:(?:{DOT}|\.)[A-Za-z0-9-]{{1,64}}+){{1,8}}+",
        rf"(?:\G|(?<!{LOCAL})){LOCAL}{{1,64}}+@[A-Za-z0-9-]{{1,64}}+(?:{DOT}[A-Za-z0-9-]{{1,64}}+){{1,8}}+",
    ),
    "ip": (r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\))[0-9]{1,3}+){3}+(?![0-9.])",),
    "card": (
        r"(?<![0-9])[0-9]{13,19}+(?![0-9])",
        r"(?<![0-9])[0-9]{4}+(?:[\x20./_-][0-9]{4}+){3}+(?![0-9])",
    ),
    "phone": (
        r"(?<![0-9+.-])\([0-9]{2,4}+\)\x20?[0-9]{3}+[\x20.-][0-9]{4}+(?![0-9])",
        r"(?<![0-9+])00[1-9][0-9]{0,2}+(?:[\x20.()-]{1,2}+[0-9]{2,5}+){2,5}+(?![0-9])",
    ),
}
#: Words before a span that speak for one kind or against all.
HINTS = {
    "mail": r"(?i)e-?mail|contact|write to",
    "call": r"(?i)phone|tel|call|fax|mobile",
    "pay": r"(?i)card|visa|account|paid",
    "net": r"(?i)\bip\b|host|server|address",
    "code": r"(?i)token|key|sha|hash|version|id\b|=|#",
}


@dataclass(frozen=True)
class Settings:
    """Bounds and targets."""

    sample: int = 20_000
    precision: float = 0.98
    trees: int = 12
    depth: int = 4
    bins: int = 200


def generators() -> list[tuple[int, str, str, bool]]:
    """``(number, kind, pattern, base)``."""
    made = [(k, BASE[k], True) for k in KINDS] + [(k, p, False) for k in KINDS for p in WIDER[k]]
    return [(i, *g) for i, g in enumerate(made)]


def matches(body: Column, pattern: str) -> Column:
    """Every match in order: ``gap`` (characters since the match before), ``before``, ``hit``, ``after``."""

    def of(gaps: Column) -> Column:
        return F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), lambda hit, i: F.struct(
            F.length(F.get(gaps, i)).alias("gap"), F.right(F.get(gaps, i), F.lit(30)).alias("before"), hit.alias("hit"),
            F.left(F.get(gaps, i + 1), F.lit(10)).alias("after"),
        ))

    return F.when(body.rlike(pattern), held(F.split(body, pattern, -1), of))


def candidates(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``(row, key)`` of all rows, and ``(row, gen, kind, base, start, end, before, hit, after)`` of all candidates."""
    body = F.coalesce(named(text), F.lit(""))
    found = F.concat(*[F.coalesce(_numbered(matches(body, p), i), F.array().cast(NUMBERED)) for i, _, p, _ in generators()])
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), named(key).alias("key"), found.alias("found")), "candidates")
    each = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.gen", "f.n", "f.m.*")
    up_to = Window.partitionBy("row", "gen").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(up_to)
    # Spans of a run, with nothing but separators between them, stand in the context of its first.
    lead = F.last(F.when(~F.col("before").rlike(r"^[\x20,;/|]{1,3}$"), F.col("before")), ignorenulls=True).over(up_to)
    kind = F.element_at(F.array(*[F.lit(k) for _, k, _, _ in generators()]), F.col("gen") + 1)
    spans = each.withColumns({"end": end, "before": F.coalesce(lead, "before")}).select(
        "row", "gen", kind.alias("kind"), (F.col("gen") < len(KINDS)).alias("base"),
        (F.col("end") - F.length("hit")).alias("start"), "end", "before", "hit", "after",
    )
    return rows.select("row", "key"), spans


NUMBERED = "array<struct<gen:int,n:int,m:struct<gap:int,before:string,hit:string,after:string>>>"


def _numbered(found: Column, gen: int) -> Column:
    return F.transform(found, lambda m, n: F.struct(F.lit(gen).alias("gen"), n.alias("n"), m.alias("m")))


def luhn(digits: Column) -> Column:
    """Whether the checksum of a string of digits holds."""

    def worth(c: Column, i: Column) -> Column:
        v = c.cast("int")
        return F.when(i % 2 == 0, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0))

    each = F.transform(F.split(F.reverse(digits), ""), worth)
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def with_formats(spans: DataFrame) -> DataFrame:
    """Adds ``rule``: what the rule of the kind says of the span once separators are made plain, and ``valid``: whether it
    counts if it is a base match, as addresses do without a rule."""
    hit = F.col("hit")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length("digits")
    parts = F.transform(F.split(F.regexp_replace(hit, r"[^0-9]+", "."), r"\."), lambda p: F.ltrim(p, F.lit("0")))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.try_to_number(F.lpad(p, 3, "0"), F.lit("999")), F.lit(0)) <= 255))
    plain = F.regexp_replace(F.regexp_replace(hit, AT, "@"), DOT, ".")
    return spans.withColumn("digits", digits).withColumn(
        "rule",
        F.when(F.col("kind") == "email", plain.rlike(rf"^{LOCAL}+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z][A-Za-z0-9-]+$"))
        .when(F.col("kind") == "ip", (F.size(parts) == 4) & small)
        .when(F.col("kind") == "card", n.between(13, 19) & F.when(n.between(13, 19), luhn(F.col("digits"))).otherwise(F.lit(False)))
        .otherwise(n.between(9, 15)),
    ).withColumn("valid", F.col("rule") | (F.col("base") & (F.col("kind") == "email"))).drop("digits")


def with_features(spans: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds one double column per feature, the kind and what the context says; their names are returned. The characters
    of the span are left out: the rule that labels is a function of them."""
    last, first = F.right("before", F.lit(1)), F.left("after", F.lit(1))
    made = {f"f_kind_{k}": F.col("kind") == k for k in KINDS}
    made |= {
        "f_word_before": last.rlike(r"[\p{L}0-9]"), "f_word_after": first.rlike(r"[\p{L}0-9]"),
        "f_quote_before": last.rlike("[\"'=]"), "f_stop_after": first.rlike("[.,;:!?]"),
        "f_digits_near": F.regexp_count(F.concat("before", "after"), F.lit("[0-9]")),
    }
    made |= {f"f_{name}": F.col("before").rlike(p) for name, p in HINTS.items()}
    full = spans.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in made.items()})
    return full, list(made)


def scored(spans: DataFrame, settings: Settings) -> DataFrame | None:
    """Spans that are not base matches and whose rule holds, with ``score`` and the ``threshold`` of their kind; None if nothing was learned."""
    featured, names = with_features(spans)
    featured = stored(VectorAssembler(inputCols=names, outputCol="features").transform(featured).drop(*names), "features")
    label = F.col("rule").cast("double")
    known = featured.where("base").withColumn("label", label)
    part = F.pmod(F.xxhash64("hit", "before"), F.lit(1 << 20))
    sizes = {r["label"]: r["count"] for r in known.where(part % 2 == 0).groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    share = min(1.0, settings.sample / sum(sizes.values()))
    trees = GBTClassifier(maxIter=settings.trees, maxDepth=settings.depth, seed=7, maxBins=32)
    train = known.where((part % 2 == 0) & (part < share * (1 << 20)))
    if train.select("label").distinct().count() < 2:
        return None
    model = trees.fit(train.select("features", "label"))
    judge = lambda df: model.transform(df).withColumn("score", vector_to_array("probability")[1])
    # Of every score bin and kind, how many calibration candidates are right: at most ``bins`` rows for each kind.
    bin_ = F.least(F.floor(F.col("score") * settings.bins), F.lit(settings.bins - 1)).cast("int")
    counts = judge(known.where(part % 2 == 1)).groupBy("kind", bin_.alias("bin")).agg(F.sum("label").alias("right"), F.count("*").alias("n")).collect()
    levels = {}
    for kind in KINDS:
        own = sorted((r for r in counts if r["kind"] == kind), key=lambda r: -r["bin"])
        accepted = sum(r["right"] for r in own)
        labelled = sum(r["right"] ** 2 / r["n"] for r in own) / accepted if accepted else 1.0
        right = n = 0
        for r in own:
            right, n = right + r["right"], n + r["n"]
            if right >= settings.precision * labelled * n and r["right"] >= 0.5 * labelled * r["n"]:
                levels[kind] = r["bin"] / settings.bins
    threshold = reduce(lambda c, k: F.when(F.col("kind") == k, levels[k]).otherwise(c), levels, F.lit(2.0))
    return judge(featured.where("not base and rule")).select("row", "kind", "start", "end", "score", threshold.alias("threshold"))


def additions(base: DataFrame, judged: DataFrame) -> DataFrame:
    """Chosen candidates that overlap no base span and no better candidate; the better has the higher score, then is the
    longer, then starts first, then comes first by kind."""
    rank = F.struct("score", (F.col("end") - F.col("start")).alias("length"), (-F.col("start")).alias("early"), (-F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))).alias("order"))
    chosen = judged.where("score >= threshold").withColumn("rank", rank).select("row", "kind", "start", "end", "rank").distinct()
    other = chosen.select("row", F.col("start").alias("s"), F.col("end").alias("e"), F.col("rank").alias("r")).unionByName(
        base.select("row", F.col("start").alias("s"), F.col("end").alias("e")).withColumn("r", F.lit(None).cast(chosen.schema["rank"].dataType))
    )
    beaten = (
        (chosen["row"] == other["row"]) & (chosen["start"] < other["e"]) & (other["s"] < chosen["end"])
        & (other["r"].isNull() | (other["r"] > chosen["rank"]))
    )
    return chosen.join(other, beaten, "left_anti").select("row", "kind", "start", "end")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document: key, ``n_email, n_ip, n_card, n_phone`` and ``base_sha256`` of the base spans, and ``spans``,
    all spans as ``kind:start:end`` by kind, then start."""
    rows, spans = candidates(docs, key, text)
    spans = stored(with_formats(spans), "spans")
    base = spans.where("base and valid").select("row", "kind", "start", "end")
    judged = scored(spans, settings)
    every = base.withColumn("added", F.lit(False))
    if judged is not None:
        every = every.unionByName(additions(base, stored(judged, "judged")).withColumn("added", F.lit(True)))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    entry = F.struct(place.alias("place"), "start", "end", "kind", "added")
    by_row = every.groupBy("row").agg(
        F.sort_array(F.collect_list(entry)).alias("all"),
        *[F.count(F.when((F.col("kind") == k) & ~F.col("added"), 1)).alias(f"n_{k}") for k in KINDS],
    )
    shown = lambda entries: F.array_join(F.transform(entries, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    none = F.array().cast("array<struct<place:bigint,start:bigint,end:bigint,kind:string,added:boolean>>")
    held_spans = F.coalesce(F.col("all"), none)
    return rows.join(by_row, "row", "left").select(
        F.col("key").alias(key), *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.sha2(shown(F.filter(held_spans, lambda x: ~x["added"])).cast("binary"), 256).alias("base_sha256"), shown(held_spans).alias("spans"),
    )
