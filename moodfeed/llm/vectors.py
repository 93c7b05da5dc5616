"""Near-duplicate embeddings by a robust-pruned flat graph.

1. Equal vectors are collapsed and numbered, as an id may have several vectors. Centroids are fitted on a bounded sample; every vector is indexed in the
   shards of its ``OVERLAP`` nearest centroids, so shards overlap. A shard of more than ``BLOCK`` vectors,
   a group of near copies say, is divided into blocks by hash.
2. Each block builds a robust-pruned neighbour graph; the adjacency lists that a vector has in its
   shards are united.
3. Every vector is searched for in the blocks of its ``PROBES`` nearest centroids: greedily from the
   block's medoid, and from its own place where it is indexed; once a vector in range is met, the
   search spreads over all vectors in range that the graph connects.
4. What is in range has been computed in double precision from the given components. A pair that meets
   in several blocks counts in one: that of the first of the searcher's centroids that indexes the other.
5. ``audit`` compares some searches with all vectors. If recall is below ``RECALL``, the search is
   repeated with twice the overlap and probes, until it is reached or every shard is searched.

Number of centroids and blocks grow with the input, a block does not. The centroids broadcast are at
most ``MAX_CENTROIDS``; beyond that, shards have more blocks. Vectors that are null, empty, zero, or
hold null, NaN or infinity link with nothing, nor do those of another length than most have. Rows with
equal vectors link with each other; rows that share an id but not the vector have the links and the
component of their own vector. Ids that are null are kept and are their own component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodfeed.llm.components import connect
from moodfeed.llm.near import Forest
from moodfeed.llm.ship import ship
from moodfeed.staging import stage

LINK = 0.95
OVERLAP = 3
PROBES = 6
SHARD = 1500
BLOCK = 3000
SEARCHES = 4000  # of a task
MAX_CENTROIDS = 4096
SAMPLE = 16  # vectors of the sample for each centroid
DEGREE = 24
POOL = 64
ALPHA = 1.2
BEAM = 24
RECALL = 0.98
AUDIT = 400


def unit(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, np.float64)
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of unit vectors."""
    rng = np.random.default_rng(3)
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.bincount(own, minlength=len(centres)) == 0
        sums[empty] = centres[empty]
        norms = np.sqrt((sums * sums).sum(1))
        centres = sums / np.where(norms > 0, norms, 1)[:, None]
    return centres


def robust_prune(x: np.ndarray, degree: int, pool: int, alpha: float) -> list[np.ndarray]:
    """Out-neighbours of every vector: of its nearest ``pool``, those not much nearer to a chosen one;
    reverse edges are added."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64) for _ in range(n)]
    pool = min(pool, n - 1)
    near = np.empty((n, pool), np.int64)
    for a in range(0, n, 512):
        sims = x[a : a + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
        part = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        order = np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable")
        near[a : a + 512] = np.take_along_axis(part, order, 1)
    kept = np.zeros((n, pool), bool)
    for a in range(0, n, 256):
        c = x[near[a : a + 256]]
        between = np.maximum(0, 2 - 2 * c @ c.transpose(0, 2, 1))
        own = np.maximum(0, 2 - 2 * np.einsum("ijk,ik->ij", c, x[a : a + 256]))
        alive = np.ones(own.shape, bool)
        chosen = np.zeros(own.shape, bool)
        for j in range(pool):
            take = alive[:, j] & (chosen.sum(1) < degree)
            chosen[take, j] = True
            # squared distances, so alpha is squared too
            covered = alpha**2 * between[:, j] <= own
            alive &= ~(covered & take[:, None])
        kept[a : a + 256] = chosen
    rows, cols = np.nonzero(kept)
    ends = near[rows, cols]
    a, b = np.concatenate([rows, ends]), np.concatenate([ends, rows])
    pairs = np.unique(a * n + b)
    a, b = pairs // n, pairs % n
    cuts = np.searchsorted(a, np.arange(n + 1))
    # reverse edges of a hub may be many: the nearest of them are enough
    out = []
    for i in range(n):
        own = b[cuts[i] : cuts[i + 1]]
        if len(own) > 2 * degree:
            own = own[np.argsort(-(x[own] @ x[i]), kind="stable")[: 2 * degree]]
        out.append(own)
    return out


def range_search(
    x: np.ndarray,
    graph: np.ndarray,
    queries: np.ndarray,
    own: np.ndarray,
    link: float = LINK,
    beam: int = BEAM,
) -> Iterator[tuple[int, np.ndarray]]:
    """Vectors within range of each query, found by walking the graph.

    ``graph``: neighbours by row, padded with -1; ``own``: the query's own place or -1, which is left
    out of what is found.
    """
    n = len(x)
    medoid = int((x @ x.mean(0)).argmax())
    for a in range(0, len(queries), 256):
        q, mine = queries[a : a + 256], own[a : a + 256]
        m = len(q)
        rows = np.arange(m)
        sims = np.full((m, n), -2.0)
        open_ = np.zeros((m, n), bool)  # met, not yet expanded
        start = np.where(mine >= 0, mine, medoid)
        for places in (np.full(m, medoid), start):
            sims[rows, places] = np.einsum("ij,ij->i", q, x[places])
            open_[rows, places] = True
        active = rows
        while len(active):
            scores = np.where(open_[active], sims[active], -3.0)
            best = scores.argmax(1)
            value = scores[np.arange(len(active)), best]
            # the beam-th best of what is met bounds the walk; what is in range is always expanded
            met = sims[active]
            if n > beam:
                bound = -np.partition(-met, beam - 1, axis=1)[:, beam - 1]
            else:
                bound = np.full(len(active), -3.0)
            on = (value > -3) & ((value >= link) | (value >= bound))
            active, best = active[on], best[on]
            if not len(active):
                break
            open_[active, best] = False
            neighbours = graph[best]
            r, c = np.nonzero(neighbours >= 0)
            who, place = active[r], neighbours[r, c]
            new = sims[who, place] <= -2
            who, place = who[new], place[new]
            sims[who, place] = np.einsum("ij,ij->i", q[who], x[place])
            open_[who, place] = True
        for i in range(m):
            found = np.flatnonzero(sims[i] >= link)
            yield a + i, found[found != mine[i]]


class Space:
    """Centroids, and how many blocks each shard has."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres = centres

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        sims = x @ self.centres.T
        k = min(k, sims.shape[1])
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable")
        return np.take_along_axis(part, order, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _assigned(classes: DataFrame, shared, overlap: int, probes: int) -> DataFrame:
    """Shards by nearness: ``index`` the first ``overlap``, ``probe`` the first ``probes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(_matrix(batch.column("vector")))
            near = shared.value.nearest(x, probes).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("copies"),
                    batch.column("vector"),
                    pa.array(list(near), pa.list_(pa.int32())),
                ],
                names=["id", "copies", "vector", "shards"],
            )

    return classes.mapInArrow(run, "id long, copies long, vector array<double>, shards array<int>")


def _graphs(index: DataFrame) -> DataFrame:
    """Adjacency lists of every block: id, neighbours."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        x = unit(_matrix(table.column("vector").combine_chunks()))
        ids = np.asarray(table.column("id"))
        lists = [ids[g] for g in robust_prune(x, DEGREE, POOL, ALPHA)]
        return pa.table(
            {"id": table.column("id"), "near": pa.array(lists, pa.list_(pa.int64()))}
        )

    return index.select("shard", "block", "id", "vector").groupBy("shard", "block").applyInArrow(
        run, "id long, near array<long>"
    )


def _searched(index: DataFrame, queries: DataFrame, link: float) -> DataFrame:
    """Links of the queries of a block: id, links (weighted by copies), root (a linked vector)."""

    def run(nodes: pa.Table, asks: pa.Table) -> pa.Table:
        if not (nodes.num_rows and asks.num_rows):
            none = pa.array([], pa.int64())
            return pa.table({"id": none, "links": none, "root": none})
        nodes, asks = nodes.sort_by("id").combine_chunks(), asks.sort_by("id").combine_chunks()
        x = unit(_matrix(nodes.column("vector").combine_chunks()))
        q = unit(_matrix(asks.column("vector").combine_chunks()))
        ids, asked = np.asarray(nodes.column("id")), np.asarray(asks.column("id"))
        copies = np.asarray(nodes.column("copies"))
        homes = [np.asarray(s.values) for s in nodes.column("homes")]
        probes = [np.asarray(s.values) for s in asks.column("shards")]
        shard = nodes.column("shard")[0].as_py()
        lists = nodes.column("near")
        owner = np.repeat(np.arange(len(ids)), np.asarray(pa.compute.list_value_length(lists)))
        target = np.asarray(lists.combine_chunks().flatten())
        place = np.minimum(np.searchsorted(ids, target), len(ids) - 1)
        here = ids[place] == target
        owner, place = owner[here], place[here]
        size = np.bincount(owner, minlength=len(ids))
        graph = np.full((len(ids), max(1, size.max())), -1, np.int64)
        graph[owner, np.arange(len(owner)) - (np.cumsum(size) - size)[owner]] = place
        at = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
        own = np.where(ids[at] == asked, at, -1)
        # union-find over the places of the block and the searchers that are not in it
        forest = Forest(len(ids) + len(asked))
        links = np.zeros(len(asked), np.int64)
        home = np.full((len(ids), max(map(len, homes))), -1)
        for i, h in enumerate(homes):
            home[i, : len(h)] = h
        for i, found in range_search(x, graph, q, own, link):
            me = int(own[i]) if own[i] >= 0 else len(ids) + i
            if len(found):
                # counted here if no earlier centroid of the searcher indexes the other
                rank = int(np.flatnonzero(probes[i] == shard)[0])
                earlier = np.isin(home[found], probes[i][:rank]).any(1)
                links[i] = int(copies[found[~earlier]].sum())
                for f in found.tolist():
                    forest.join(me, f)
        smallest: dict[int, int] = {}
        everyone = np.concatenate([ids, asked])
        for i, v in enumerate(everyone.tolist()):
            r = forest.root(i)
            smallest[r] = min(smallest.get(r, v), v)
        roots = [
            smallest[forest.root(int(own[i]) if own[i] >= 0 else len(ids) + i)]
            for i in range(len(asked))
        ]
        return pa.table({"id": asked, "links": links, "root": pa.array(roots, pa.int64())})

    left = index.groupBy("shard", "block", "turn")
    return left.cogroup(queries.groupBy("shard", "block", "turn")).applyInArrow(
        run, "id long, links long, root long"
    )


def _audit(classes: DataFrame, searched: DataFrame, link: float, audit: int) -> float:
    """Mean share, over some vectors with links, of the links found among those that all vectors give."""
    spark = classes.sparkSession
    chosen = classes.where(F.col("first") % 100 == 0).orderBy(F.xxhash64("id")).limit(audit)
    table = chosen.select("id", "vector").toArrow().combine_chunks()
    if not table.num_rows:
        return 1.0
    asked = np.asarray(table.column("id"))
    q = spark.sparkContext.broadcast(
        (asked, unit(_matrix(table.column("vector").combine_chunks())))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = q.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            other = np.asarray(batch.column("id"))
            hits = unit(_matrix(batch.column("vector"))) @ queries.T >= link
            hits &= other[:, None] != ids[None, :]
            total += np.asarray(batch.column("copies")) @ hits
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "n"])

    true = (
        classes.select("id", "copies", "vector")
        .mapInArrow(run, "id long, n long")
        .groupBy("id")
        .agg(F.sum("n").alias("n"))
    )
    # a mean of shares, so that the links of one dense group do not hide those of small ones
    share = F.least("n", F.coalesce("links", F.lit(0))) / F.col("n")
    mean = true.where("n > 0").join(searched, "id", "left").agg(F.avg(share)).first()[0]
    return 1.0 if mean is None else mean


def near_vectors(
    rows: DataFrame,
    link: float = LINK,
    overlap: int = OVERLAP,
    probes: int = PROBES,
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """One row for each of ``rows``: the id, n_links, component_id, kept."""
    ship(rows.sparkSession)
    values = F.col(vector).cast("array<double>")
    base = rows.select(F.col(id_column).cast("long").alias("id"), values.alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("vector", lambda v: v != 0)
    length = F.size("vector")
    usual = (
        base.where(some & ~bad).groupBy(length.alias("n")).count()
        .orderBy(F.desc("count"), F.desc("n")).first()
    )
    good = F.coalesce(some & ~bad & (length == (usual["n"] if usual else 0)), F.lit(False))
    good = good & F.col("id").isNotNull()
    flagged = base.withColumn("good", good)
    classes = stage(
        flagged.where("good").groupBy("vector").agg(
            F.min("id").alias("first"), F.count("*").alias("copies")
        ).select(F.monotonically_increasing_id().alias("id"), "first", "copies", "vector"),
        "vectors",
    )
    n = classes.count()
    lone = flagged.where("NOT good").select(
        F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"),
        F.col("id").alias("component_id"),
    )
    if n:
        found = _linked(classes, n, link, overlap, probes)
        of_class = stage(found, "classes")
        member = flagged.where("good").select(F.col("id").alias(id_column), "vector")
        joined = member.join(of_class, "vector").select(id_column, "n_links", "component_id")
        lone = lone.unionByName(joined)
    return lone.withColumn(
        "kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True))
    )


def _linked(classes: DataFrame, n: int, link: float, overlap: int, probes: int) -> DataFrame:
    spark = classes.sparkSession
    k = int(min(MAX_CENTROIDS, max(1, round(n * overlap / SHARD))))
    sample = classes.orderBy(F.xxhash64("id")).limit(SAMPLE * k + 1000).select("vector").toArrow()
    x = unit(_matrix(sample.column("vector").combine_chunks()))
    shared = spark.sparkContext.broadcast(Space(kmeans(x, k)))
    while True:
        assigned = stage(_assigned(classes, shared, overlap, probes), "assigned")
        homes = F.slice("shards", 1, overlap)
        index = assigned.select(
            "id", "copies", "vector", homes.alias("homes"), F.explode(homes).alias("shard")
        )
        asks = assigned.select("id", F.explode("shards").alias("shard"))
        # one row a centroid
        sizes = (
            index.groupBy("shard").agg(F.count("*").alias("indexed"))
            .join(asks.groupBy("shard").agg(F.count("*").alias("asked")), "shard")
            .select(
                "shard",
                F.ceil(F.col("indexed") / BLOCK).cast("int").alias("blocks"),
                F.ceil(F.col("asked") / SEARCHES).cast("int").alias("turns"),
            )
        )
        sizes = stage(sizes, "shards")
        index = index.join(F.broadcast(sizes), "shard").withColumn(
            "block", F.pmod(F.hash("shard", "id"), F.col("blocks"))
        )
        united = _graphs(index).groupBy("id").agg(
            F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")
        )
        united = stage(united, "graph")
        nodes = index.join(united, "id").withColumn(
            "turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))
        ).select("shard", "block", "turn", "id", "copies", "vector", "homes", "near")
        nodes = stage(nodes, "nodes")
        queries = (
            assigned.select("id", "vector", "shards", F.explode("shards").alias("shard"))
            .join(F.broadcast(sizes), "shard")
            .withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns")).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("shard", "block", "turn", "id", "vector", "shards")
        )
        found = stage(_searched(nodes, queries, link), "found")
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        recall = _audit(classes, links, link, AUDIT)
        if recall >= RECALL or overlap >= k:
            break
        overlap, probes = 2 * overlap, 2 * probes
    parts = connect(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    firsts = parts.join(classes.select(F.col("id").alias("node"), "first"), "node")
    parts = parts.join(
        firsts.groupBy("component").agg(F.min("first").alias("smallest")), "component"
    ).select("node", "smallest")
    own = F.col("links") + F.col("copies") - 1
    return (
        classes.join(links, "id")
        .join(parts.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "vector", own.alias("n_links"), F.coalesce("smallest", "first").alias("component_id")
        )
    )
