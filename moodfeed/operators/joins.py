"""Joins on keys that may be NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", never_null: tuple[str, ...] = ()
) -> DataFrame:
    """As ``left.join(right, on, how)``, but NULL equals NULL. Keeps the keys of the left side.

    Keys are compared in the order given. One that is ``never_null`` is compared plainly: Spark hashes and
    sorts a null-safe key as two.
    """
    named = {c: f"_right_{c}" for c in on}
    other = right.select(*[F.col(c).alias(named.get(c, c)) for c in right.columns])
    test = F.lit(True)
    for c in on:
        one, two = F.col(c), F.col(named[c])
        test = test & (one == two if c in never_null else one.eqNullSafe(two))
    joined = left.join(other, test, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*named.values())
