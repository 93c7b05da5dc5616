"""Mixing sources to target weights.

Every document gets a random key from a hash of its id. Within a source, documents are taken in the
order of their keys until its budget is used up; a budget above the size of the source takes whole
epochs first. Keys are spread evenly, so ranges of them split a source into equal parts: words are
summed by source and fine range, the sums are accumulated in two steps (fine ranges within coarse
ones, then coarse ones), and only the range in which the budget ends is read by document. What comes
out is one key for each source, below which a document is taken once more; documents do not move.

The document in which a budget ends gives its first words up to it (``taken``); where documents stay
whole (``copies``), it is taken if half of it or more is. A null text has no words. Documents without an
id use their text as key; rows with one key share what is left in equal parts. The null source is a
source of its own. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodfeed.llm.arrow import unused
from moodfeed.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Documents of a fine range, at most, if there were one source.
RANGE = 256


def words_in(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_column: str = "doc_id", text: str = "text", seed: str = "mix") -> Column:
    known = F.coalesce(F.col(id_column).cast("string"), F.col(text), F.lit(""))
    return F.md5(F.concat(F.lit(seed + ":"), known))


def targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Target of each row (source, source_size): shares of all words by weight, none above
    ``max_epochs`` times its size, the excess shared by weight among the others.

    One row a source, which a window without partitions can hold.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    position = F.row_number().over(by_name) - 1
    cycle = F.array(*map(F.lit, weights))
    weighted = sizes.select(
        "source",
        "source_size",
        F.get(cycle, position % len(weights)).cast("long").alias("weight"),
        (max_epochs * F.col("source_size")).alias("most"),
    )
    # sources are full in the order of most / weight; the others share what is left
    order = [F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    full_before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    from_here = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(full_before), F.lit(0))
    ) / F.sum("weight").over(from_here)
    levelled = weighted.select("*", level.alias("level"))
    # the level at the first source that is not full holds for all that follow
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    final = F.first(open_level, ignorenulls=True).over(Window.orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0))
    return levelled.select(
        "source",
        "source_size",
        F.coalesce(final * F.col("weight"), F.col("most")).cast("double").alias("target"),
    )


def budgets(table: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """For each source of (source, key, size): size, target, whole epochs, and the highest key that
    is taken once more."""
    n = table.count()
    digits = max(1, math.ceil(math.log(max(n, 2) / RANGE, 16)))
    coarse_digits = digits // 2
    sizes = table.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = stage(
        targets(sizes, weights, max_epochs)
        .withColumn(
            "epochs",
            F.when(
                F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
            ).otherwise(0),
        )
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")),
        "targets",
    )
    fine, coarse = F.substring("key", 1, digits), F.substring("key", 1, coarse_digits)
    sums = table.groupBy("source", coarse.alias("coarse"), fine.alias("fine")).agg(
        F.sum("size").alias("words")
    )

    def before(*partition: str) -> Window:
        order = "fine" if "coarse" in partition else "coarse"
        return Window.partitionBy(*partition).orderBy(order).rowsBetween(
            Window.unboundedPreceding, -1
        )

    sums = stage(sums, "sums")
    coarse_sums = sums.groupBy("source", "coarse").agg(F.sum("words").alias("words")).select(
        "source",
        "coarse",
        F.coalesce(F.sum("words").over(before("source")), F.lit(0)).alias("coarse_start"),
    )
    within = F.coalesce(F.sum("words").over(before("source", "coarse")), F.lit(0))
    fine_sums = sums.select("source", "coarse", "fine", "words", within.alias("start"))
    same = ["source", "coarse"]
    starts = _join(fine_sums, coarse_sums, same).withColumn(
        "start", F.col("start") + F.col("coarse_start")
    )
    # ranges that end after the budget hold its end in their first one; all before are taken whole
    crossing = _join(starts, plan.select("source", "budget"), ["source"]).where(
        (F.col("start") <= F.col("budget")) & (F.col("start") + F.col("words") >= F.col("budget"))
    )
    # a range without words may touch the budget too: the last of these is looked into
    last = crossing.groupBy("source").agg(
        F.max(F.struct("fine", "start", "budget")).alias("last")
    ).select("source", "last.*")
    inside = _join(
        table.withColumn("fine", fine), last, ["source", "fine"]
    ).groupBy("source", "key", "start", "budget").agg(
        F.sum("size").alias("size"), F.count("*").alias("rows")
    )
    by_key = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("start") + F.coalesce(F.sum("size").over(by_key), F.lit(0))
    # the last key that fits is taken; of the one after it, what is left of the budget
    ends = inside.withColumn("begin", begin).withColumn("end", F.col("begin") + F.col("size"))
    fits = F.col("end") <= F.col("budget")
    cuts = ends.groupBy("source").agg(
        F.max(F.when(fits, F.col("key"))).alias("inner"),
        F.min(
            F.when(
                ~fits & (F.col("begin") < F.col("budget")),
                F.struct("key", (F.col("budget") - F.col("begin")).alias("words"), "rows", "size"),
            )
        ).alias("part"),
    )
    cuts = _join(last.select("source", "fine"), cuts, ["source"], "left").select(
        "source",
        F.coalesce("inner", "fine").alias("cut"),
        F.col("part.key").alias("part_key"),
        F.floor(F.col("part.words") / F.col("part.rows")).alias("part_words"),
        (2 * F.col("part.words") >= F.col("part.size")).alias("part_taken"),
    )
    return _join(plan.drop("budget"), cuts, ["source"], "left")


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join in which null equals null."""
    other = right.select(*(F.col(c).alias(f"_r_{c}" if c in on else c) for c in right.columns))
    test = F.lit(True)
    for c in on:
        test = test & left[c].eqNullSafe(other[f"_r_{c}"])
    return left.join(other, test, how).drop(*(f"_r_{c}" for c in on))


def mix(
    docs: DataFrame,
    name: str,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    id_column: str = "doc_id",
) -> DataFrame:
    """All rows and columns of ``docs`` and a struct called ``name``: size in words, source_size,
    target, ``taken`` in words, and ``copies``, how often the mix takes the whole document."""
    table = stage(
        docs.select("source", random_key(id_column).alias("key"), words_in().alias("size")), "sizes"
    )
    plan = stage(budgets(table, weights, max_epochs), "budgets")
    own, key = unused(docs, "plan"), unused(docs, "key")
    rows = docs.withColumn(key, random_key(id_column))
    # one row a source; Spark broadcasts it if it is small and splits large sources if not
    named = unused(docs, "of_source")
    packed = plan.select(F.col("source").alias(named), F.struct("*").alias(own))
    joined = rows.join(packed, F.col("source").eqNullSafe(F.col(named)))
    size, under = words_in(), F.col(f"{own}.epochs") < max_epochs
    whole = F.coalesce((F.col(key) <= F.col(f"{own}.cut")) & under, F.lit(False))
    part = F.coalesce((F.col(key) == F.col(f"{own}.part_key")) & under, F.lit(False))
    words = F.when(whole, size).when(part, F.least(size, F.col(f"{own}.part_words"))).otherwise(0)
    nearest = whole | (part & F.coalesce(F.col(f"{own}.part_taken"), F.lit(False)))
    mixed = F.struct(
        size.alias("size"),
        F.col(f"{own}.source_size").alias("source_size"),
        F.col(f"{own}.target").alias("target"),
        (F.col(f"{own}.epochs") * size + words).cast("long").alias("taken"),
        (F.col(f"{own}.epochs") + nearest.cast("long")).cast("long").alias("copies"),
    )
    return joined.select(*docs.columns, mixed.alias(name))
