"""Global row numbers without a single-task window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodfeed.operators.joins import null_safe_join
from moodfeed.staging import stage

# monotonically_increasing_id: the partition above, the row within it below
ROW_BITS = 33


def with_position(rows: DataFrame, keys: list[str], name: str = "position") -> DataFrame:
    """Number the rows from 0 in the order of ``keys``.

    One range shuffle sorts the rows; staging it fixes which row lies in which partition. Only the
    row count of each partition passes through the driver.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    ordered = stage(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("*", F.spark_partition_id().alias("_part"), row.alias("_row")),
        "ordered",
    )
    counts = sorted(tuple(r) for r in ordered.groupBy("_part").count().collect())
    starts = [0, *accumulate(n for _, n in counts)][: len(counts)]
    offsets = ordered.sparkSession.createDataFrame(
        [(part, start) for (part, _), start in zip(counts, starts)], "_part int, _start bigint"
    )
    return ordered.join(F.broadcast(offsets), "_part").select(
        *rows.columns, (F.col("_start") + F.col("_row")).alias(name)
    )


# Cells of a histogram that comes to the driver, and rows that one task may sort.
CELLS = 4096
SORTED = 10_000

INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def smallest(rows: DataFrame, n: int, key: str) -> DataFrame:
    """The ``n`` rows with the smallest ``key``, an integral column; NULL comes first, and ties are cut by
    the other columns.

    A histogram of the key, ``CELLS`` rows, tells in which cell the n-th lies; that cell gets a histogram of
    its own until it has at most ``SORTED`` rows or one key. What is below the cell is kept by a filter on
    the key, so that nothing but the cell is sorted and nothing is copied. ``rows`` are read for each
    histogram, of which 64 bits need six.
    """
    others = [c for c in rows.columns if c != key]
    value = F.col(key)
    total, nulls, low, high = rows.agg(
        F.count("*"), F.count_if(value.isNull()), F.min(key), F.max(key)
    ).first()
    if total <= n:
        return rows
    if n <= nulls:
        return _first_of(rows.filter(value.isNull()), n, nulls, [key, *others])
    rest, inside = n - nulls, total - nulls
    below = value.isNull()
    while inside > SORTED and low < high:
        width = (high - low) // CELLS + 1
        # decimals, as the span of 64-bit keys has 65
        offset = value.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
        cell = F.floor(offset / width).cast("int")
        counts = sorted(
            tuple(r) for r in rows.filter(value.between(low, high)).groupBy(cell.alias("c")).count().collect()
        )
        for c, size in counts:
            if rest <= size:
                break
            rest -= size
        low, high, inside = low + c * width, min(high, low + (c + 1) * width - 1), size
    below = below | (value < low)
    return rows.filter(below).unionByName(
        _first_of(rows.filter(value.between(low, high)), rest, inside, [key, *others])
    )


def _first_of(rows: DataFrame, n: int, size: int, keys: list[str]) -> DataFrame:
    if size == n:
        return rows
    if size <= SORTED:
        return rows.orderBy(*keys).limit(n)
    # many rows with one key
    return with_position(rows, keys, "_position").filter(F.col("_position") < n).drop("_position")


def split_positional(
    rows: DataFrame, fraction: float = 0.7, key: str = "tweet_id", group: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """First ``int(fraction * n)`` rows by the key, and the rest; for each group, if one is named.

    Groups need not fit a task: all rows are sorted together and each group's first place and size
    are looked up.
    """
    groups = [group] if group else []
    numbered = with_position(rows, [*groups, key], "_position")
    sizes = numbered.groupBy(*groups).agg(
        F.min("_position").alias("_first"), F.count("*").alias("_n")
    )
    if group:
        numbered = null_safe_join(numbered, stage(sizes, "sizes"), [group])
        first, n = F.col("_first"), F.col("_n")
    else:
        _, total = sizes.first()
        first, n = F.lit(0), F.lit(total)
    # the product is cut as a double, as int(fraction * n) is
    in_train = F.col("_position") - first < F.floor(F.lit(fraction) * n)
    return (
        numbered.filter(in_train).select(*rows.columns),
        numbered.filter(~in_train).select(*rows.columns),
    )
