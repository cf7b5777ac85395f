"""Quality rules with thresholds that adapt to each language and source.

A document is measured on its whole text. Two base rules hold everywhere. What passes
them feeds quantile sketches, one per language, source and measure: counts of log-spaced
bins, which bound the relative error of a quantile and merge by adding counts, so that
they do not depend on partitions or order. Upper fences come from the lower half of a
document's group, which junk, as what lies above a fence, does not move while it is less than
six tenths of the group. A group of n documents gives its own fences the weight
n / (n + ``borrow``) and takes the rest from its language, which leans on the corpus in the
same way, so that no size switches between them. The fences, a few numbers per group,
are joined back to filter.

Null text has no words and fails the base rules. Null language or source is a group of
its own. Repeated rows count as often as they occur. An empty table gives no rows. Other
columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netvigil.llm.common import WORD, let, stored, text_or_empty, words
from netvigil.operators.sizing import broadcast_if_small

SYMBOL = r"[#*$%&|<>]"
MEASURES = ("symbols", "dup_lines", "repeats", "word_length")
# Bins grow by 5 %, so that a quantile is off by 2.5 % at most; smaller values are zero.
GROWTH = 1.05
SMALLEST = 1e-4
# Documents of its own at which a group's fences weigh as much as its language's.
BORROW = 10
# A fence stands REACH times the spread from the LOW to the MIDDLE quantile above the middle
# one. The spread is taken as at least `FLOOR` of the measure, so that a group without spread
# has room. Where half of a group is junk, these are quantiles 0.2 and 0.8 of the rest.
LOW, MIDDLE = 0.1, 0.4
REACH = 6.0
FLOOR = {"symbols": 0.01, "dup_lines": 0.06, "repeats": 0.06, "word_length": 0.3}


def _repeat_words(hashes: Column, n_words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""
    places = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def repeated(rows):
        def place(row, at):
            alike = F.coalesce(F.get(rows, at - 1).h == row.h, F.lit(False)) | F.coalesce(
                F.get(rows, at + 1).h == row.h, F.lit(False)
            )
            return F.when(alike, row.i)

        return F.sort_array(F.filter(F.transform(rows, place), lambda i: i.isNotNull()))

    def covered(starts):
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            starts,
            zero,
            lambda s, i: F.struct(
                (i + 3).alias("end"), (s.n + 3 - F.greatest(F.lit(0), s.end - i)).alias("n")
            ),
            lambda s: s.n,
        )

    # Most texts repeat no window, which is found without sorting.
    return F.when(
        (n_words >= 3) & (F.size(F.array_distinct(hashes)) < F.size(hashes)),
        covered(let(F.sort_array(places), repeated)),
    ).otherwise(0)


def measures(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words); n_lines
    counts lines with a word."""

    def of_words(w):
        windows = F.when(
            F.size(w) >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
            ),
        )
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

        return let(
            F.struct(lines.alias("lines"), windows.alias("windows")),
            lambda x: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
                F.size(x.lines).cast("long").alias("n_lines"),
                (F.size(x.lines) - F.size(F.array_distinct(x.lines)))
                .cast("long")
                .alias("n_dup_lines"),
                _repeat_words(x.windows, F.size(w)).cast("long").alias("n_repeat_words"),
            ),
        )

    return let(words(text), of_words)


def base_failed(m: Column, min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (m["n_words"] < min_words) | (
        100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"]
    )


def _values(m: Column) -> dict[str, Column]:
    def ratio(part, whole):
        return F.coalesce(m[part] / F.nullif(m[whole], F.lit(0).cast("long")), F.lit(0.0))

    return {
        "symbols": ratio("n_symbols", "word_chars"),
        "dup_lines": ratio("n_dup_lines", "n_lines"),
        "repeats": ratio("n_repeat_words", "n_words"),
        "word_length": ratio("word_chars", "n_words"),
    }


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): the mergeable sketches of what passes the base rules."""
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("measure"), value.alias("value"))
            for name, value in _values(F.col("m")).items()
        ]
    )
    bin_of = F.when(
        F.col("x.value") >= SMALLEST,
        F.floor(F.log(F.col("x.value") / SMALLEST) / F.log(F.lit(GROWTH))) + 1,
    ).otherwise(0)
    return (
        measured.where(~base_failed(F.col("m")))
        .select("lang", "source", F.explode(rows).alias("x"))
        .groupBy("lang", "source", F.col("x.measure").alias("measure"), bin_of.alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def _fences(bins: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, fences: measure -> upper fence) of sketches merged per group."""
    merged = bins.groupBy(*group, "measure", "bin").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*group, "measure")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.when(F.col("bin") == 0, F.lit(0.0)).otherwise(
        SMALLEST * F.pow(F.lit(GROWTH), F.col("bin") - 0.5)
    )
    ranked = merged.select(
        *group,
        "measure",
        middle.alias("value"),
        F.sum("n").over(upto).alias("rank"),
        F.sum("n").over(whole).alias("total"),
    )
    quantiles = ranked.groupBy(*group, "measure").agg(
        F.min(F.when(F.col("rank") >= LOW * F.col("total"), F.col("value"))).alias("low"),
        F.min(F.when(F.col("rank") >= MIDDLE * F.col("total"), F.col("value"))).alias("middle"),
        F.max("total").alias("n"),
    )
    floor = F.create_map(*[F.lit(x) for pair in FLOOR.items() for x in pair])
    fence = F.col("middle") + REACH * F.greatest(
        F.col("middle") - F.col("low"), F.try_element_at(floor, F.col("measure"))
    )
    return quantiles.groupBy(*group).agg(
        F.max("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("measure", fence.alias("fence")))).alias(
            "fences"
        ),
    )


def thresholds(measured: DataFrame, borrow: int = BORROW) -> DataFrame:
    """(lang, source, fences), a row per group that has documents passing the base rules."""
    bins = stored(sketches(measured), "quality-sketches")
    groups = _fences(bins, ["lang", "source"])
    langs = _fences(bins, ["lang"]).select(
        F.col("lang").alias("of_lang"), F.col("n").alias("n_lang"), F.col("fences").alias("by_lang")
    )
    corpus = _fences(bins.withColumn("all", F.lit(1)), ["all"]).select(
        F.col("all"), F.col("fences").alias("by_all")
    )

    def leaning(n: str, own: str | Column, other: str | Column) -> Column:
        weight = F.col(n) / (F.col(n) + borrow)
        return F.map_zip_with(own, other, lambda _, x, y: weight * x + (1 - weight) * y)

    return stored(
        groups.join(langs, groups.lang.eqNullSafe(langs.of_lang))
        .withColumn("all", F.lit(1))
        .join(corpus, "all")
        .select(
            "lang",
            "source",
            leaning("n", "fences", leaning("n_lang", "by_lang", "by_all")).alias("fences"),
        ),
        "quality-fences",
    )


def judged(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """``measured`` (lang, source, m, ...) with base_failed and kept."""
    groups = broadcast_if_small(
        fences.select(
            F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"), "fences"
        )
    )
    inside = F.lit(True)
    for name, value in _values(F.col("m")).items():
        limit = F.try_element_at(F.col("fences"), F.lit(name))
        inside = inside & F.coalesce(value <= limit, F.lit(True))
    return (
        measured.join(
            groups,
            measured.lang.eqNullSafe(groups.fence_lang)
            & measured.source.eqNullSafe(groups.fence_source),
            "left",
        )
        .withColumn("base_failed", base_failed(F.col("m")))
        .withColumn("kept", ~F.col("base_failed") & inside)
        .drop("fence_lang", "fence_source", "fences")
    )


def measure_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, m), stored once and read by sketches and verdicts alike."""
    return stored(
        docs.select("doc_id", "lang", "source", measures(text_or_empty()).alias("m")),
        "quality-measures",
    )


def keep_good(docs: DataFrame, borrow: int = BORROW) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    columns = docs.columns
    measured = docs.select(
        "lang",
        "source",
        measures(text_or_empty()).alias("m"),
        F.struct(*[F.col(c) for c in columns]).alias("row"),
    )
    fences = thresholds(measured.select("lang", "source", "m"), borrow)
    return judged(measured, fences).where("kept").select("row.*")
