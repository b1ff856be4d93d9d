"""Quality rules: word-count and repetition limits, then divergence of a text's histograms from its language.

Method: the character classes and the common words of each document are counted, the counts of all documents of a
language make that language's reference histograms, and a document whose Jensen-Shannon distance (square root of the
divergence, base 2, 0 to 1) from either reference exceeds a threshold is rejected. Texts below a minimum number of
words are not judged by a histogram. Only DataFrame functions are used, all of them row by row; the one shuffle
carries a handful of sums per language, and the references are at most one row per configured language.

Defined results: a null or empty text has no words and fails the base rules. A document in a language without a
reference (null or unknown code) is compared with the language whose common words it holds most of; with none of them
it is judged by the base rules alone. Repeated rows are judged each. Extra columns are ignored by ``verdicts`` and kept
by ``keep_good``. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import free_name, held, named, stored

# Common words by language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit des ist ein".split(),
    "en": "the of and to in a is that for was with by".split(),
    "es": "de la que el en y a los del las un por".split(),
    "fr": "de la le et les des en un du une que dans".split(),
}
SYMBOLS = "[#*$%&|<>]"
PUNCTUATION = r"[.,;:!?'\"()\-]"
CLASSES = ("lower", "upper", "digit", "punctuation", "other", "space")


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules."""

    min_words: int = 50
    max_repeat_percent: int = 50
    class_distance: float = 0.25
    word_distance: float = 0.31
    class_min_words: int = 50
    word_min_words: int = 80
    reference_min_words: int = 50


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that the text holds twice or more.

    Each window becomes one long: 35 bits of its hash above 28 bits of its position. In sorted order equal hashes stand
    side by side; only windows found so are spelled out and compared as text, so the count is exact.
    """
    low = (1 << 28) - 1

    def hashed(w: Column) -> Column:
        return F.sort_array(F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.shiftrightunsigned(F.shiftleft(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), 28), 1)
            .bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")),
        ))

    def alike(packed: Column) -> Column:
        places = F.when(F.size(packed) > 1, F.sequence(F.lit(0), F.size(packed) - 2)).otherwise(F.array().cast("array<int>"))
        firsts = F.filter(places, lambda k: F.get(packed, k).bitwiseXOR(F.get(packed, k + 1)) <= low)
        both = F.array_distinct(F.flatten(F.transform(firsts, lambda k: F.array(k, k + 1))))
        return F.transform(both, lambda k: F.get(packed, k).bitwiseAND(F.lit(low)).cast("int"))

    def spelled(w: Column, at: Column) -> Column:
        return F.sort_array(F.transform(
            at, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))
        ))

    def covered(o: Column) -> Column:
        again = F.filter(o, lambda x, k: x["t"].eqNullSafe(F.get(o, k - 1)["t"]) | x["t"].eqNullSafe(F.get(o, k + 1)["t"]))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return held(held(hashed(words), alike), lambda at: F.when(F.size(at) == 0, F.lit(0)).otherwise(held(spelled(words, at), covered)))


def _each(text: Column, marks: str, by: str) -> Column:
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(by))
    return text


def with_words(docs: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns, named by the dictionary: ``body`` (empty for null), ``spaced`` (every white space a
    space), ``words`` and ``compact`` (no white space)."""
    names = {n: free_name(docs, f"{n}_") for n in ("body", "spaced", "words", "compact")}
    body, spaced = named(names["body"]), named(names["spaced"])
    docs = docs.withColumn(names["body"], F.coalesce(named(text), F.lit("")))
    docs = docs.withColumn(names["spaced"], _each(body, "\t\n\x0b\x0c\r", " "))
    docs = docs.withColumns({names["words"]: F.array_remove(F.split(spaced, " "), ""), names["compact"]: _each(spaced, " ", "")})
    return docs, names


def base_counts(body: Column, words: Column, compact: Column) -> dict[str, Column]:
    """The counts of the base rules."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(compact).cast("long"),
        "n_symbols": F.size(F.regexp_extract_all(compact, F.lit(SYMBOLS), F.lit(0))).cast("long"),
        "n_dup_lines": held(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words).cast("long"),
    }


def with_histograms(docs: DataFrame, language: str, names: dict[str, str]) -> tuple[DataFrame, str]:
    """``docs`` with a struct column, whose name is returned: ``code, n_words, classes, words``.

    ``code`` is the stated language where it has a reference, else the one of whose common words the text holds most
    (the first code on a tie). In the lower-case text every space is doubled: removing one word with a space on either
    side shortens it by a known length for each occurrence. Steps are columns of their own, so each is computed once.
    """
    body, spaced, words, compact = (named(names[n]) for n in ("body", "spaced", "words", "compact"))
    codes = sorted(COMMON_WORDS)
    own = {n: free_name(docs, n) for n in ("apart_", "counts_", "code_", "marks_", "histogram_")}
    apart, counts, code, marks = (named(own[n]) for n in ("apart_", "counts_", "code_", "marks_"))
    stated = F.lower(named(language))
    known = F.coalesce(stated.isin(codes), F.lit(False))
    size = lambda x: F.length(x).cast("long")

    def occurrences(word: Column) -> Column:
        left = F.replace(apart, F.concat(F.lit(" "), word, F.lit(" ")), F.lit(""))
        return ((F.octet_length(apart) - F.octet_length(left)) / (F.octet_length(word) + 2)).cast("long")

    # One row of counts for the stated language; all four only where none is stated.
    listed = {k: F.array(*map(F.lit, COMMON_WORDS[k])) for k in codes}
    wanted = F.when(~known, F.array(*[listed[k] for k in codes]))
    for k in codes:
        wanted = wanted.when(stated == k, F.array(listed[k]))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    hits = F.transform(counts, total)
    at = F.when(known, F.lit(0)).when(F.array_max(hits) > 0, F.array_position(hits, F.array_max(hits)).cast("int") - 1)
    found = F.when(known, stated).otherwise(F.get(F.array(*map(F.lit, codes)), at))
    runs = lambda x, pattern: F.array_join(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), "")
    upper, digit, mark = size(runs(marks, r"\p{Lu}+")), size(runs(marks, "[0-9]+")), size(runs(marks, PUNCTUATION + "+"))
    letters = size(runs(marks, r"\p{L}+"))
    classes = F.array(
        size(compact) - size(marks) + letters - upper, upper, digit, mark,
        size(marks) - letters - digit - mark, size(body) - size(compact),
    )
    out = (
        docs.withColumns({own["apart_"]: F.concat(F.lit(" "), F.replace(F.lower(spaced), F.lit(" "), F.lit("  ")), F.lit(" ")),
                          own["marks_"]: runs(compact, r"[^\p{Ll}]+")})
        .withColumn(own["counts_"], F.transform(wanted, lambda ws: F.transform(ws, occurrences)))
        .withColumn(own["code_"], F.struct(found.alias("code"), at.alias("at")))
        .withColumn(own["histogram_"], F.struct(
            code["code"].alias("code"), F.size(words).cast("long").alias("n_words"), classes.alias("classes"),
            F.get(counts, code["at"]).alias("words")))
    )
    return out.drop(*[v for n, v in own.items() if n != "histogram_"]), own["histogram_"]


def summed(histograms: DataFrame, limits: Limits) -> dict:
    """Reference histograms by language from the struct ``h`` of every document: ``{code: (classes, words, n_words)}``.

    At most one row per language of ``COMMON_WORDS`` comes to the driver.
    """
    h = F.col("h")
    long_enough = histograms.where(h["code"].isNotNull() & (h["n_words"] >= limits.reference_min_words))
    most = max(map(len, COMMON_WORDS.values()))
    sums = long_enough.groupBy(h["code"].alias("code")).agg(
        F.sum(h["n_words"]).alias("n_words"),
        *[F.sum(F.get(h["classes"], F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))],
        *[F.sum(F.get(h["words"], F.lit(i))).alias(f"w{i}") for i in range(most)],
    )
    found = {}
    for r in sums.collect():
        k = len(COMMON_WORDS[r["code"]])
        found[r["code"]] = ([r[f"c{i}"] for i in range(len(CLASSES))], [r[f"w{i}"] for i in range(k)], r["n_words"])
    return found


def distance(counts: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of ``counts / total`` from a fixed histogram. Zero where the total is zero."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(
        F.transform(counts, lambda c: c.cast("double") / total), F.array(*[F.lit(float(q)) for q in reference]),
        lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2),
    )
    summed = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(summed / 2, F.lit(0.0)))).otherwise(F.lit(0.0))


def _with_rest(counts: list[int], n: int) -> list[float]:
    return [c / n for c in [*counts, n - sum(counts)]]


def distances(histogram: Column, found: dict) -> tuple[Column, Column]:
    """Distances of the class and the word histogram from the reference of the document's language; null without one."""
    classes = words = F.lit(None).cast("double")
    code, n = histogram["code"], histogram["n_words"]
    seen = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    for key, (class_sums, word_sums, n_words) in sorted(found.items()):
        every = sum(class_sums)
        classes = F.when(code == key, distance(histogram["classes"], seen(histogram["classes"]), [c / every for c in class_sums])).otherwise(classes)
        counts = F.concat(histogram["words"], F.array(n - seen(histogram["words"])))
        words = F.when(code == key, distance(counts, n, _with_rest(word_sums, n_words))).otherwise(words)
    return classes, words


def verdicts(docs: DataFrame, text: str = "text", language: str = "lang", limits: Limits = Limits(), key: str = "doc_id") -> DataFrame:
    """One row per document: key, base counts, ``base_failed``, both distances and ``kept``."""
    counted, names = with_words(docs.select(named(key), named(text), named(language)), text)
    counted, name = with_histograms(counted, language, names)
    base = base_counts(*[named(names[n]) for n in ("body", "words", "compact")])
    rows = stored(
        counted.select(named(key), *[c.alias(n) for n, c in base.items()], named(name).alias("h")),
        "histograms",
    )
    class_distance, word_distance = distances(F.col("h"), summed(rows, limits))
    judged = rows.withColumns({"class_distance": class_distance, "word_distance": word_distance}).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"), limits))
    far = too_far(F.col("n_words"), F.col("class_distance"), F.col("word_distance"), limits)
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).drop("h")


def base_failed(n_words: Column, n_repeat_words: Column, limits: Limits) -> Column:
    return (n_words < limits.min_words) | (100 * n_repeat_words > limits.max_repeat_percent * n_words)


def too_far(n_words: Column, class_distance: Column, word_distance: Column, limits: Limits) -> Column:
    """The method's verdict: a histogram of a long enough text lies too far from its reference."""
    over = lambda d, most: F.coalesce(d, F.lit(0.0)) > most
    return ((n_words >= limits.class_min_words) & over(class_distance, limits.class_distance)) | (
        (n_words >= limits.word_min_words) & over(word_distance, limits.word_distance)
    )


def keep_good(docs: DataFrame, text: str = "text", language: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with all their columns.

    Documents and their counts are written once to the shared folder, so the texts are counted once: the references
    come from the written counts, and the verdict is a plain filter over them.
    """
    counted, names = with_words(docs, text)
    counted, name = with_histograms(counted, language, names)
    repeats = free_name(counted, "repeats_")
    counted = counted.withColumn(repeats, repeated_words(named(names["words"])))
    rows = stored(counted.select(*[named(c) for c in docs.columns], named(name), named(repeats)), "judged")
    class_distance, word_distance = distances(named(name), summed(rows.select(named(name).alias("h")), limits))
    n = named(name)["n_words"]
    good = ~too_far(n, class_distance, word_distance, limits) & ~base_failed(n, named(repeats), limits)
    return rows.where(good).select(*[named(c) for c in docs.columns])
