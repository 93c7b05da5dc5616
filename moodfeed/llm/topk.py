"""Exact top-k inner products by norm-sorted blocks.

1. Components are turned into integers, floor(``scale`` * x). Rows with equal vectors are one candidate
   with its smallest ids: more than k + 1 of them can never be in a result, and the limit works in each
   task before the shuffle. Queries with equal vectors are searched for once.
2. Candidates are sorted by length and descending norm, and cut into blocks of equal size. The right
   singular vectors of a bounded sample rotate the vectors, so that a few components hold most of a product.
3. Blocks are searched in rounds, the longest vectors first and ``GROWTH`` times as many in each round. A
   query goes to a block only while its own norm times the block's greatest norm can reach the (k + 1)-th
   best score that it has. Within a block, candidates come in descending norm; a candidate whose partial
   product over the first rotated components plus the product of the residual norms (Cauchy-Schwarz)
   cannot reach it is pruned, all others get their exact integer product. Bounds allow for rounding, and
   candidates that may tie stay.
4. Every query vector keeps its k + 1 best; a row's own entry is taken out at the end.

Blocks and groups of queries have bounded sizes, and each pair of them that is needed is a task of its own;
only the sample and the sizes of range partitions reach the driver.

Vectors that are null, or hold null, NaN or infinity, take no part; zero vectors do. Vectors are compared
with those of their own length. Rows with a null id are candidates, last among ties, and no queries. Rows
that repeat an id are candidates of each other; equal rows give their results once each. Components
beyond 64 bits become the nearest 64-bit integer, scores likewise. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodfeed.llm.ship import ship
from moodfeed.operators.ranking import with_position
from moodfeed.staging import stage

SCALE = 256
SAMPLE = 4096
#: Bytes of the vectors of a block or a group of queries, and the parts that small tables are dealt in.
BLOCK_BYTES = 32 << 20
PARTS, LEAST_BLOCK, LEAST_QUERIES = 48, 1024, 64
GROWTH = 8
STEP = 512
_LAST = np.iinfo(np.int64).max
_EXACT = float(1 << 53)


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")))


def _clip(x: int) -> int:
    return max(-_LAST - 1, min(_LAST, x))


def _products(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray, exact: bool) -> np.ndarray:
    """Integer products of pairs; ``exact`` where doubles hold all sums."""
    if not exact:
        pairs = zip(q[rows].tolist(), c[cols].tolist())
        return np.array([_clip(sum(a * b for a, b in zip(x, y))) for x, y in pairs], np.int64)
    if len(rows) * 4 > len(q) * len(c):
        return (q.astype(float) @ c.T.astype(float))[rows, cols].astype(np.int64)
    out = np.empty(len(rows), np.int64)
    for a in range(0, len(rows), 1 << 16):
        part = slice(a, a + (1 << 16))
        out[part] = np.einsum("ij,ij->i", q[rows[part]].astype(float), c[cols[part]].astype(float))
    return out


def search(
    q: np.ndarray, c: np.ndarray, first: np.ndarray, least: np.ndarray, rotation: np.ndarray | None, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, by score and then the smaller ``first``, among those that reach
    its ``least``: query, candidate, score. Candidates come in descending norm."""
    n, d = c.shape
    qf, cf = q.astype(float), c.astype(float)
    norm_q, norm_c = np.sqrt((qf * qf).sum(1)), np.sqrt((cf * cf).sum(1))
    exact = norm_q.max(initial=0) * norm_c.max(initial=0) < _EXACT / 4
    if rotation is not None:
        qf, cf = qf @ rotation, cf @ rotation
    h = max(1, d // 4)
    rest_q, rest_c = (np.sqrt((x[:, h:] ** 2).sum(1)) for x in (qf, cf))
    floor_ = np.where(np.isnan(least), -np.inf, least)
    who = cand = score = np.zeros(0, np.int64)
    for a in range(0, n, STEP):
        # what rounding may take from a bound
        slack = 1e-9 * norm_q * norm_c[a] + 0.5
        alive = np.flatnonzero(norm_q * norm_c[a] + slack >= floor_)
        if not len(alive):
            break
        b = min(n, a + STEP)
        bound = qf[alive, :h] @ cf[a:b, :h].T + rest_q[alive, None] * rest_c[None, a:b]
        rows, cols = np.nonzero(bound + slack[alive, None] >= floor_[alive, None])
        new = _products(q[alive], c[a:b], rows, cols, exact)
        rows, cols = alive[rows], cols + a
        on = new >= floor_[rows]
        who = np.concatenate([who, rows[on]])
        cand = np.concatenate([cand, cols[on]])
        score = np.concatenate([score, new[on]])
        order = np.lexsort((first[cand], -score.astype(float) if exact else ~score, who))
        who, cand, score = who[order], cand[order], score[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        who, cand, score = (x[place < k] for x in (who, cand, score))
        full = place == k - 1
        floor_[who[full[place < k]]] = np.maximum(
            floor_[who[full[place < k]]], score[full[place < k]].astype(float)
        )
    return who, cand, score


def _matrix(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    part = column.take(pa.array(rows)).combine_chunks()
    return np.asarray(part.flatten(), np.int64).reshape(len(rows), -1)


def _found(candidates: DataFrame, asks: DataFrame, rotation, k: int) -> DataFrame:
    """Best candidates of a block for the queries of a group: query, place, first, score."""

    def run(block: pa.Table, ask: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 4
        lengths, wanted = (np.asarray(t.column("length")) for t in (block, ask))
        for length in np.intersect1d(lengths, wanted).tolist():
            own = np.flatnonzero(lengths == length)
            place = np.asarray(block.column("place"))[own]
            own = own[np.argsort(place)]
            mine = np.flatnonzero(wanted == length)
            first = np.asarray(block.column("first").fill_null(_LAST))[own]
            who, cand, score = search(
                _matrix(ask.column("ints"), mine),
                _matrix(block.column("ints"), own),
                first,
                np.asarray(ask.column("least").cast(pa.float64(), safe=False).fill_null(np.nan))[mine],
                rotation.value.get(length),
                k,
            )
            found = (
                np.asarray(ask.column("query"))[mine][who],
                np.asarray(block.column("place"))[own][cand],
                first[cand],
                score,
            )
            out = [np.concatenate(pair) for pair in zip(out, found)]
        return pa.table(dict(zip(("query", "place", "first", "score"), out)))

    left, right = candidates.groupBy("block", "group"), asks.groupBy("block", "group")
    return left.cogroup(right).applyInArrow(run, "query long, place long, first long, score long")


def _rotation(candidates: DataFrame, length: int) -> dict[int, np.ndarray]:
    """Right singular vectors of a sample of the vectors of the usual length."""
    rows = (
        candidates.where(F.col("length") == length).orderBy(F.xxhash64("place")).limit(SAMPLE)
        .select("ints").toArrow()
    )
    x = _matrix(rows.column("ints"), np.arange(rows.num_rows)).astype(float)
    return {length: np.linalg.svd(x / max(1.0, np.abs(x).max()), full_matrices=True)[2].T}


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "first", "place")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def _parts(n: int, length: int, least: int) -> int:
    """Rows of a part: few enough for the memory of a task, and so that small tables have some parts."""
    most = max(1, BLOCK_BYTES // (8 * max(1, length)))
    return min(most, max(least, -(-n // PARTS)))


def top_products(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = SCALE,
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of every row that ``is_query``, the k other rows with the
    highest products (all, if fewer), ties to the smaller id."""
    spark = rows.sparkSession
    ship(spark)
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    base = stage(
        rows.where(F.col(vector).isNotNull() & ~bad).select(
            F.col(id_column).cast("long").alias("id"),
            integers(F.col(vector), scale).alias("ints"),
            F.coalesce(is_query & F.col(id_column).isNotNull(), F.lit(False)).alias("asks"),
        ),
        "integers",
    )
    best = k + 1
    in_vector = Window.partitionBy("ints").orderBy(F.col("id").asc_nulls_last())
    few = base.select("ints", "id").withColumn("_n", F.row_number().over(in_vector))
    ids = F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))
    candidates = (
        few.where(F.col("_n") <= best)
        .groupBy("ints")
        .agg(F.transform(F.array_sort(ids), lambda x: x.id).alias("ids"))
    )
    asked = base.where("asks").select("ints").distinct().withColumn("asked", F.lit(True))
    square = F.aggregate("ints", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    sized = candidates.join(asked, "ints", "left").select(
        "ints", "ids", F.coalesce("asked", F.lit(False)).alias("asked"),
        F.size("ints").alias("length"), F.sqrt(square).alias("norm"),
        (-F.sqrt(square)).alias("_short"), F.xxhash64("ints").alias("_hash"),
    )
    placed = with_position(sized, ["length", "_short", "_hash"], "place")
    usual = placed.groupBy("length").agg(
        F.count("*").alias("n"), F.count_if("asked").alias("asked")
    ).orderBy(F.desc("n"), "length").first()
    result = "query_id long, rank int, vec_id long, score long"
    if usual is None or not placed.where("asked").count():
        return spark.createDataFrame([], result)
    total, asking = placed.agg(F.count("*"), F.count_if("asked")).first()
    size = _parts(total, usual.length, LEAST_BLOCK)
    groups = -(-asking // _parts(asking, usual.length, LEAST_QUERIES))
    blocks = -(-total // size)
    numbered = stage(
        placed.withColumn("block", F.floor(F.col("place") / size).cast("int")).drop("_short", "_hash"),
        "candidates",
    )
    rotation = spark.sparkContext.broadcast(_rotation(numbered, usual.length))
    longest = stage(
        numbered.groupBy("block", "length").agg(F.max("norm").alias("most")), "blocks"
    )
    queries = numbered.where("asked").select(F.col("place").alias("query"), "ints", "length", "norm")
    queries = stage(
        queries.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int")), "queries"
    )
    found, least = None, None
    low, high = 0, 1
    while low < blocks:
        # groups and blocks: numbers that the sizes bound
        asks = queries.withColumn("block", F.explode(F.sequence(F.lit(low), F.lit(min(high, blocks) - 1))))
        asks = asks.join(longest, ["block", "length"])
        if least is None:
            asks = asks.withColumn("least", F.lit(None).cast("long"))
        else:
            reach = F.col("norm") * F.col("most") * (1 + 1e-9) + 1
            asks = asks.join(least, "query", "left").where(
                F.col("least").isNull() | (reach >= F.col("least"))
            )
        asks = stage(asks.select("block", "group", "query", "ints", "length", "least"), "asks")
        needed = stage(asks.select("block", "group").distinct(), "needed")
        here = numbered.select("block", "place", "ints", "length", F.col("ids")[0].alias("first"))
        new = _found(here.join(needed, "block"), asks, rotation, best)
        found = stage(_best(new if found is None else found.unionByName(new), best), "found")
        least = found.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        least = stage(least.where(F.col("n") == best).select("query", "least"), "least")
        low, high = high, high * GROWTH
    return _rows(base, numbered, found, k)


def _rows(base: DataFrame, numbered: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Results of every asking row from those of its vector, without its own entry."""
    entries = found.join(numbered.select("place", "ids"), "place").select(
        "query", "score", F.explode("ids").alias("id")
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    top = entries.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "score", "id"))).alias("top"))
    of_vector = stage(
        numbered.join(lists, numbered.place == lists.query).select("ints", "top"), "tops"
    )
    asking = base.where("asks").select(F.col("id").alias("query_id"), "ints")
    # doubles can miss 64-bit sums, decimals cannot; a component of 2^32 reaches the last score alone
    most = 1 << 32
    near = F.transform("ints", lambda x: F.greatest(F.least(x, F.lit(most)), F.lit(-most)).cast("decimal(11,0)"))
    wide = F.aggregate(
        near, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x * x).cast("decimal(38,0)")
    )
    own = F.least(wide, F.lit(_LAST).cast("decimal(38,0)")).cast("long")
    joined = asking.join(of_vector, "ints").select("query_id", "top", own.alias("own"))
    at = F.array_position(
        F.transform("top", lambda t: F.coalesce((t.id == F.col("query_id")) & (t.score == F.col("own")), F.lit(False))),
        True,
    ).cast("int")
    others = F.filter("top", lambda t, i: i != F.col("at") - 1)
    return (
        joined.withColumn("at", at)
        .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("n", "t"))
        .select("query_id", (F.col("n") + 1).alias("rank"), F.col("t.id").alias("vec_id"), "t.score")
    )
