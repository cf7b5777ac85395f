"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its weighted part of the mix, at most ``cap`` times what it holds;
what a source cannot take is shared again by weight. Every document of a source is
expected target / size times: the whole part of that number is certain, the fraction is
rounded. Rounding pairs two documents and moves words from one to the other at random
until one of the two fractions is 0 or 1; the other goes on. Expectations hold exactly,
and a source's words end within one document of its target, as only the last document
left is decided by itself.

The pairing is a reduction tree: leaves of about ``LEAF`` documents are folded, their
residuals form the next level. Leaves are dealt by a hash, so a source with any share of
the rows is spread over tasks, and every level is stored in the shared folder.

Null text has no words; a document without words is copied by its own draw. Null sources
form one source, after all others. Rows repeated in full are mixed separately. An empty
table gives no rows. ``doc_id`` may be null or repeated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netvigil.llm.common import WORD, let, stored, text_hash, text_or_empty, uniform
from netvigil.operators.sizing import broadcast_if_small

LEAF = 128
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """(source, source_no, documents, source_size, target) from (source, size) rows.

    The windows run over one row per source, not over documents.
    """
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("documents")
    )
    everything = Window.partitionBy()
    order = Window.partitionBy().orderBy(F.col("source").isNull(), "source")
    wave = Window.partitionBy().orderBy("fills_at", "source_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights))
    total = F.sum("source_size").over(everything) * share
    before = F.coalesce(F.sum("most").over(wave), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(wave), F.lit(0.0)
    )
    # A source is full if the level its share is based on, with all that fill up earlier
    # taken out, reaches where it fills up.
    filled = (
        sources.withColumn("source_no", F.row_number().over(order) - 1)
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("total", total)
        .withColumn("fills_at", F.col("most") / F.col("weight"))
        .withColumn("level", (F.col("total") - before) / open_weight)
        .withColumn("full", F.col("level") >= F.col("fills_at"))
    )
    full_words = F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0))
    free_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    share_out = (F.col("total") - full_words) / free_weight * F.col("weight")
    return filled.select(
        "source",
        "source_no",
        "documents",
        "source_size",
        F.when(F.col("full"), F.col("most"))
        .otherwise(F.least(share_out, F.col("most")))
        .alias("target"),
    )


def _pair(a: Column, b: Column, salt: int) -> Column:
    """Move words between two fractions: (settled, its result, the other with its new p)."""
    gain_a, loss_a = a.size * (1.0 - a.p), a.size * a.p
    gain_b, loss_b = b.size * (1.0 - b.p), b.size * b.p

    def moved(m):
        # to_a words may go from b to a, to_b from a to b; the odds keep both expectations.
        towards_a = uniform(F.lit(salt), a.key, b.key) * (m.to_a + m.to_b) < m.to_b

        def result(done, result, rest, p):
            return F.struct(
                done.alias("done"),
                F.lit(result).alias("up"),
                rest.withField("p", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).alias("rest"),
            )

        return (
            F.when(towards_a & (gain_a <= loss_b), result(a, 1, b, b.p - m.to_a / b.size))
            .when(towards_a, result(b, 0, a, a.p + m.to_a / a.size))
            .when(gain_b <= loss_a, result(b, 1, a, a.p - m.to_b / a.size))
            .otherwise(result(a, 0, b, b.p + m.to_b / b.size))
        )

    return let(
        F.struct(
            F.least(gain_a, loss_b).alias("to_a"), F.least(loss_a, gain_b).alias("to_b")
        ),
        moved,
    )


ITEM = "struct<key:bigint,doc_id:{id},hash:bigint,size:bigint,whole:bigint,p:double>"


def _fold(items: Column, kind: str, salt: int) -> Column:
    """Settle a group of items but for one: struct(rest, settled)."""
    item = ITEM.format(id=kind)
    settled = f"array<struct<item:{item},up:int>>"
    zero = F.struct(
        F.lit(None).cast(item).alias("rest"), F.array().cast(settled).alias("settled")
    )

    def step(s, x):
        return F.when(
            s.rest.isNull(), F.struct(x.alias("rest"), s.settled.alias("settled"))
        ).otherwise(
            let(
                _pair(s.rest, x, salt),
                lambda r: F.struct(
                    r.rest.alias("rest"),
                    F.concat(
                        s.settled, F.array(F.struct(r.done.alias("item"), r.up.alias("up")))
                    ).alias("settled"),
                ),
            )
        )

    return F.aggregate(items, zero, step)


def mix_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 11,
    leaf: int = LEAF,
) -> DataFrame:
    """Per row of ``docs``: doc_id, hash (of the text), source, size, source_size, target,
    copies, taken."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = stored(
        docs.select(
            "doc_id", text_hash().alias("hash"), "source", n_words(text_or_empty()).alias("size")
        ),
        "mix-rows",
    )
    sources = stored(source_targets(rows, weights, share, cap), "mix-sources")
    small = broadcast_if_small(sources)
    copies = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(1.0))
    items = (
        rows.join(small, rows.source.eqNullSafe(small.source))
        .select(
            "source_no",
            "doc_id",
            "hash",
            "size",
            "documents",
            F.floor(copies).alias("whole"),
            (copies - F.floor(copies)).alias("p"),
            F.xxhash64(F.lit(seed), "doc_id", "hash", "size").alias("key"),
        )
    )
    item = F.struct("key", "doc_id", "hash", "size", "whole", "p").cast(ITEM.format(id=kind))
    alone = items.where((F.col("size") == 0) | (F.col("p") == 0)).select(
        "source_no",
        item.alias("item"),
        (uniform(F.lit(seed + 1), "key") < F.col("p")).cast("int").alias("up"),
    )
    leaves = F.ceil(F.col("documents") / leaf)
    level = items.where((F.col("size") > 0) & (F.col("p") > 0)).select(
        "source_no", F.pmod("key", leaves).alias("node"), item.alias("item")
    )
    settled = [alone]
    widest = sources.agg(F.coalesce(F.max("documents"), F.lit(0))).first()[0]
    nodes, depth = math.ceil(widest / leaf), 0
    while True:
        folded = stored(
            level.groupBy("source_no", "node")
            .agg(F.sort_array(F.collect_list("item")).alias("items"))
            .select("source_no", "node", _fold(F.col("items"), kind, seed + depth).alias("fold")),
            f"mix-level{depth}",
        )
        settled.append(
            folded.select("source_no", F.explode("fold.settled").alias("one")).select(
                "source_no", "one.item", "one.up"
            )
        )
        level = folded.select(
            "source_no",
            F.floor(F.col("node") / leaf).alias("node"),
            F.col("fold.rest").alias("item"),
        )
        if nodes <= 1:
            break
        nodes, depth = math.ceil(nodes / leaf), depth + 1
    settled.append(
        level.select(
            "source_no",
            "item",
            (uniform(F.lit(seed + 2), F.col("item.key")) < F.col("item.p")).cast("int").alias("up"),
        )
    )
    decided = settled[0]
    for more in settled[1:]:
        decided = decided.unionByName(more)
    taken = F.col("item.whole") + F.col("up")
    return decided.join(small, "source_no").select(
        "item.doc_id",
        "item.hash",
        "source",
        "item.size",
        "source_size",
        "target",
        taken.alias("copies"),
        (taken * F.col("item.size")).alias("taken"),
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with every row as often as the plan says; columns stay."""
    columns = docs.columns
    plan = mix_plan(docs, **settings)
    # Rows repeated in full may have different copies: the i-th row takes the i-th number.
    numbers = plan.groupBy(F.xxhash64("doc_id", "hash").alias("mix_key")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "source", "copies"))).alias("mix_copies")
    )
    rows = docs.select(
        F.struct(*[F.col(c) for c in columns]).alias("row"),
        F.xxhash64("doc_id", text_hash()).alias("mix_key"),
    ).withColumn(
        "mix_no",
        F.row_number().over(
            Window.partitionBy("mix_key").orderBy(F.col("row.doc_id"), F.col("row.source"))
        ),
    )
    copies = F.get("mix_copies", F.col("mix_no") - 1)["copies"].cast("int")
    return (
        rows.join(numbers, "mix_key")
        .withColumn("row", F.explode(F.array_repeat("row", copies)))
        .select("row.*")
    )
