"""Proof submissions and free text from the field: option keys, completeness, leaked names and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions.labels import option_key
from frostline.schemas import PROOF_CONDITIONS, PROOF_SALT, PROOF_SURFACES

MAX_PHOTOS = 4

# Fixed value: wording that gives away an access code.
GATE_CODE = r"(?i)\b(gate|door|lockbox|access|entry)( code| pin)?( is|:|#)? *#?[0-9]{3,8}\b"


def option_keys(labels: DataFrame, label: str) -> DataFrame:
    """Distinct labels with the key the form service derives from them and how many labels share that key."""
    keys = labels.groupBy(label).agg(F.count("*").alias("uses")).withColumn("option_key", option_key(F.col(label)))
    shared = keys.groupBy("option_key").agg(F.count("*").alias("labels_with_key"))
    return keys.join(shared, "option_key").select(F.col(label).alias("label"), "option_key", "uses", "labels_with_key")


def after_photos() -> Column:
    """Number of after photos of a submission; none listed is zero."""
    return F.coalesce(F.size(F.filter(F.coalesce("media", F.array()), lambda m: m["field"] == "after")), F.lit(0))


def proof_validation(proofs: DataFrame) -> DataFrame:
    """Submissions with a required answer missing, an unknown option key, no after photo or too many."""

    def problems(field: str, allowed: tuple[str, ...]) -> list[Column]:
        value = F.col(f"data.{field}")
        return [
            F.when(value.isNull(), F.lit(f"{field} missing")),
            F.when(~value.isin(*allowed), F.lit(f"{field} unknown")),
        ]

    photos = after_photos()
    found = F.array(
        *problems("surface", PROOF_SURFACES), *problems("condition", PROOF_CONDITIONS),
        *problems("salt_applied", PROOF_SALT),
        F.when(photos == 0, F.lit("after photo missing")), F.when(photos > MAX_PHOTOS, F.lit("too many photos")),
    )
    said = F.filter(found, lambda p: p.isNotNull())
    return proofs.select(
        "submission_id", "event_id", "worker_id", photos.alias("photos"), F.array_join(said, "; ").alias("problems")
    ).where(F.col("problems") != "")


def words(text: Column) -> Column:
    """Lower-case words and numbers of a text; an empty text is one empty word."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def name_mentions(texts: DataFrame, ident: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(ident, name) for every name a text mentions as whole words. ``ident`` must be unique.

    The whole text is read, and no text meets every name: texts are first met by their distinct words with the
    first words of names; only texts that share one are cut into word sequences, starting at those words and as
    long as the longest name, and these are met with the names by an equi join.
    """
    known = names.select(F.array_join(words(F.col(name)), " ").alias("_said"), F.col(name).alias("name")).where(
        F.col("_said") != ""
    ).groupBy("_said").agg(F.min("name").alias("name"))
    longest = known.agg(F.coalesce(F.max(F.size(F.split("_said", " "))), F.lit(1))).scalar()
    first = known.select(F.element_at(F.split("_said", " "), 1).alias("_word")).distinct()
    hits = (
        texts.select(ident, F.explode(F.array_distinct(words(F.col(text)))).alias("_word"))
        .join(first, "_word", "left_semi").groupBy(ident).agg(F.collect_set("_word").alias("_hits"))
    )
    cut = texts.join(hits, ident).select(ident, "_hits", words(F.col(text)).alias("_w"))
    starts = F.filter(
        F.sequence(F.lit(1), F.size("_w")), lambda i: F.array_contains("_hits", F.element_at(F.col("_w"), i))
    )
    spans = cut.select(ident, "_w", F.explode(starts).alias("_at")).select(
        ident, F.slice(F.col("_w"), F.col("_at"), longest.cast("int")).alias("_span")
    )
    said = spans.select(ident, "_span", F.explode(F.sequence(F.lit(1), F.size("_span"))).alias("_n")).select(
        ident, F.array_join(F.slice(F.col("_span"), F.lit(1), F.col("_n")), " ").alias("_said")
    )
    return said.join(known, "_said").select(ident, "name").distinct()


def notes_leak_scan(texts: DataFrame, ident: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """Texts that give away a gate code or a contact's name, with what was found. ``ident`` must be unique."""
    coded = texts.where(F.col(text).rlike(GATE_CODE)).select(ident, F.lit(1).alias("gate_code"))
    mentioned = name_mentions(texts, ident, text, names, name).groupBy(ident).agg(
        F.count("*").alias("names"), F.min("name").alias("first_name")
    )
    return coded.join(mentioned, ident, "full").select(
        ident, F.coalesce("gate_code", F.lit(0)).alias("gate_code"),
        F.coalesce(F.col("names"), F.lit(0).cast("long")).alias("names"), "first_name",
    )
