"""Near-duplicate texts by order-preserving MinHash and banded alignment.

Texts are sequences of runs of five words, numbered when they repeat, which makes them sets. A sketch
takes the ``TAKE`` runs with the least hashes and keeps them in the order of the text; ``SKETCHES`` of
them are drawn. Two texts with a similarity of 0.8 share a sketch with a chance of about 0.33 each, so
all 32 miss with one of 3 in a million, while texts with a similarity of 0.3 share one in 500.

1. Equal texts are collapsed by their hash and numbered; only the smallest id of each goes on.
2. Texts that share a sketch are tied to the smallest number that has it, a row each. The connected parts
   of that are clouds: nothing outside a text's cloud shares a sketch with it.
3. Each cloud is compared within itself, all texts against all, in blocks of bounded size, so that a
   group of copies is never one task. Runs in common bound the similarity from above; pairs that pass
   are aligned and joined at once, and pairs already joined are skipped.
4. Joined texts of different blocks are connected, and copies take the class of their text.

Similarity is m / (a + b - m), for a and b runs and m of them matched in order by the best alignment.
At 0.8 or more at most (a - 0.8 b) / 1.8 runs of the first can be unmatched, which bounds the band.
Words are compared in lower case (A-Z). A text of fewer than five words is one run; texts without
words, empty ones included, are like their equals only. A null text is its own class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodfeed.llm import words as wd
from moodfeed.llm.arrow import slices, text_bytes, unused
from moodfeed.llm.components import connect
from moodfeed.llm.ship import ship
from moodfeed.staging import stage

RUN = 5
THRESHOLD = 0.8
SKETCHES = 32
TAKE = 5
#: Below so many runs, sketches of one run are drawn as well: longer ones differ too easily.
SHORT = 16
#: Texts of a block.
BLOCK = 512

U64 = np.uint64


def numbered_runs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of a text's runs; the second and later of equal ones differ from the first."""
    if not len(hashes):
        return np.zeros(0, U64)
    runs = wd.grams(hashes, min(RUN, len(hashes)))
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    if new.all():
        return runs
    first = np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0))
    again = np.empty(len(runs), U64)
    again[order] = (np.arange(len(runs)) - first).astype(U64)
    return np.where(again > 0, wd.mix(runs + again * U64(0x9E3779B97F4A7C15)), runs)


_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * U64(2) + U64(1)
_SHIFTS = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)


def sketch(runs: np.ndarray, take: int) -> np.ndarray:
    """One hash for each sketch, of its least runs in the order of the text."""
    n = len(runs)
    # only hashes below a limit that leaves a few more than needed are looked at
    limit = (1 << 64) - 1 if n <= 6 * take else int((1 << 64) * (6 * take / n))
    out = np.empty(SKETCHES, U64)
    step = max(1, (1 << 18) // n)
    for a in range(0, SKETCHES, step):
        hashes = runs[None, :] * _FACTORS[a : a + step, None] + _SHIFTS[a : a + step, None]
        hashes ^= hashes >> U64(32)
        hashes *= U64(0x9E3779B97F4A7C15)
        row, at = np.nonzero(hashes <= U64(limit))
        counts = np.bincount(row, minlength=len(hashes))
        for r in np.flatnonzero(counts < min(take, n)):
            least = np.argpartition(hashes[r], min(take, n) - 1)[: min(take, n)]
            out[a + r] = _ordered(runs[np.sort(least)])
        order = np.lexsort((hashes[row, at], row))
        row, at = row[order], at[order]
        rank = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
        kept = (rank < take) & (counts[row] >= min(take, n))
        row, at = row[kept], at[kept]
        rows = np.unique(row)
        if len(rows):
            places = np.sort(at.reshape(len(rows), -1), axis=1)
            total = np.zeros(len(rows), U64)
            for k in range(places.shape[1]):
                total = wd.mix(total + runs[places[:, k]])
            out[a + rows] = total
    return wd.mix(out + np.arange(SKETCHES, dtype=U64) * U64(2) + U64(take))


def _ordered(runs: np.ndarray) -> U64:
    total = np.zeros(1, U64)
    for r in runs:
        total = wd.mix(total + r)
    return total[0]


def sketches(runs: np.ndarray) -> np.ndarray:
    if not len(runs):
        return np.zeros(0, U64)
    many = sketch(runs, TAKE)
    return np.concatenate([many, sketch(runs, 1)]) if len(runs) < SHORT else many


def matched(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> int:
    """Runs matched by the best alignment of two texts, within the band that ``threshold`` allows.

    All values within a text differ, so the alignment is an increasing sequence of places; those
    outside the band cannot belong to an alignment that reaches the threshold.
    """
    order = np.argsort(b)
    at = np.searchsorted(b[order], a)
    at = order[np.minimum(at, len(b) - 1)]
    here = np.flatnonzero(b[at] == a)
    there = at[here]
    need = threshold * (len(a) + len(b)) / (1 + threshold)
    offset = there - here
    within = (offset <= len(b) - need + 1e-9) & (offset >= need - len(a) - 1e-9)
    there = there[within]
    # longest increasing subsequence
    tails: list[int] = []
    from bisect import bisect_left

    if len(there) < 2 or (np.diff(there) > 0).all():
        return len(there)
    for x in there.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    m = matched(a, b, threshold)
    return m >= threshold * (len(a) + len(b) - m) - 1e-9


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def compare(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> Forest:
    """Join similar texts of one block, or of two."""
    texts = left if right is None else left + right
    forest = Forest(len(texts))
    values, codes = np.unique(np.concatenate(texts), return_inverse=True)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    marks = np.zeros(len(values), bool)
    other = 0 if right is None else len(left)
    for i in range(len(left)):
        j = max(i + 1, other)
        if j == len(texts):
            break
        own = codes[ends[i] - sizes[i] : ends[i]]
        marks[own] = True
        begin = ends[j] - sizes[j]
        hits = marks[codes[begin:]]
        marks[own] = False
        common = np.add.reduceat(hits, ends[j:] - sizes[j:] - begin, dtype=np.int64)
        bound = common >= threshold * (sizes[i] + sizes[j:] - common) - 1e-9
        for k in np.flatnonzero(bound) + j:
            if forest.root(i) != forest.root(int(k)) and similar(texts[i], texts[k], threshold):
                forest.join(i, int(k))
    return forest


def _sketched(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, text_hash binary, n int, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = wd.words_of(*text_bytes(part.column("text")), "space", lower=True)
                n, keys = [], []
                for a, b in zip(words.bounds, words.bounds[1:]):
                    runs = numbered_runs(words.hashes[a:b])
                    n.append(len(runs))
                    keys.append(sketches(runs).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array(n, pa.int32()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n", "keys"],
                )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, schema)


def _compared(texts: DataFrame, threshold: float) -> DataFrame:
    """Ties (a, b) between similar texts of (cloud, one, two, block, node, runs)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("node", "ascending")]).combine_chunks()
        ids = np.asarray(table.column("node"))
        blocks = np.asarray(table.column("block"))
        flat = table.column("runs").combine_chunks()
        runs = [np.frombuffer(x.as_buffer(), U64) for x in flat]
        cut = int(np.searchsorted(blocks, blocks[0], "right")) if len(blocks) else 0
        one, two = pc.min_max(table.column("one"))["min"].as_py(), pc.min_max(table.column("two"))["min"].as_py()
        if one == two:
            forest = compare(runs, None, threshold)
        elif cut == len(runs):
            forest = Forest(len(runs))
        else:
            forest = compare(runs[:cut], runs[cut:], threshold)
        roots = np.array([forest.root(i) for i in range(len(runs))])
        tied = np.flatnonzero(roots != np.arange(len(runs)))
        return pa.table({"a": pa.array(ids[tied]), "b": pa.array(ids[roots[tied]])})

    return texts.groupBy("cloud", "one", "two").applyInArrow(run, "a long, b long")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Class of every document (``doc_id``, ``text``): doc_id, text_hash, class_id (the smallest id of the
    class) and kept (whether it is the class's first document: its smallest id, then the least hash).

    Rows with the same id and text become one. An id that has several texts gives a row for each, with the
    class of that text. A row without id or text is not compared."""
    ship(docs.sparkSession)
    hashed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_hash"),
        "text",
    )
    compared = hashed.where("doc_id IS NOT NULL AND text IS NOT NULL")
    members = stage(
        _sketched(compared)
        .groupBy("text_hash", "doc_id")
        .agg(F.first("n").alias("n"), F.first("keys").alias("keys")),
        "sketches",
    )
    # nodes are texts, with a number of their own, as an id may have several
    copies = stage(
        members.groupBy("text_hash").agg(
            F.min("doc_id").alias("first_id"), F.min_by("keys", "doc_id").alias("keys"),
            F.min("n").alias("n"),
        ).withColumn("node", F.monotonically_increasing_id()),
        "texts",
    )
    keys = copies.where("n > 0").select("node", F.explode("keys").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("many"))
    # stored, so that the join has a shuffle of its own, whose hot keys Spark can split
    hubs = stage(hubs.where("many > 1").drop("many"), "hubs")
    ties = keys.join(hubs, "key").where("node != hub")
    clouds = stage(connect(ties.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()), "clouds")
    sizes = stage(clouds.groupBy("component").agg(F.count("*").alias("texts")), "cloud_sizes")
    # the texts of a cloud in blocks by the hash of their number; each pair of blocks is one group
    placed = (
        clouds.join(sizes, "component")
        .withColumn("blocks", F.ceil(F.col("texts") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
        .select("node", F.col("component").alias("cloud"), "block", "blocks")
    )
    firsts = copies.select("node", "first_id", "text_hash")
    wanted = placed.join(firsts, "node").withColumnRenamed("first_id", "doc_id")
    rows = compared.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["node"])
    with_runs = stage(_runs(rows), "runs")
    pairs = with_runs.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cloud",
        F.least("block", "peer").alias("one"),
        F.greatest("block", "peer").alias("two"),
        "block",
        "node",
        "runs",
    )
    found = stage(_compared(pairs, threshold), "ties")
    joined = connect(found).join(firsts, "node")
    # only classes of several texts; the others are their own
    lead = F.min(F.struct("first_id", "text_hash")).alias("lead")
    of_class = joined.join(joined.groupBy("component").agg(lead), "component").select("node", "lead")
    lead = F.coalesce("lead", F.struct("first_id", "text_hash"))
    of_text = firsts.join(of_class, "node", "left").select("text_hash", lead.alias("lead"))
    known = members.select("doc_id", "text_hash").join(of_text, "text_hash").select(
        "doc_id",
        "text_hash",
        F.col("lead.first_id").alias("class_id"),
        ((F.col("doc_id") == F.col("lead.first_id")) & (F.col("text_hash") == F.col("lead.text_hash"))).alias("kept"),
    )
    rest = hashed.where("doc_id IS NOT NULL AND text IS NULL").select("doc_id").distinct()
    return known.unionByName(
        rest.select(
            "doc_id",
            F.lit(None).cast("binary").alias("text_hash"),
            F.col("doc_id").alias("class_id"),
            F.lit(True).alias("kept"),
        )
    )


def _runs(rows: DataFrame) -> DataFrame:
    schema = "node long, cloud long, block int, blocks int, runs binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = wd.words_of(*text_bytes(part.column("text")), "space", lower=True)
                runs = [
                    numbered_runs(words.hashes[a:b]).tobytes()
                    for a, b in zip(words.bounds, words.bounds[1:])
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("node", "cloud", "block", "blocks")),
                     pa.array(runs, pa.binary())],
                    names=["node", "cloud", "block", "blocks", "runs"],
                )

    return rows.select("node", "cloud", "block", "blocks", "text").mapInArrow(run, schema)


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of ``docs`` that are the first of their class, and those not compared. An id with
    several texts loses only the texts that are near copies of others."""
    classes = stage(near_classes(docs.select("doc_id", "text"), threshold), "classes")
    key, number, gone_id, gone_hash = (
        unused(docs, n) for n in ("text_hash", "number", "gone_id", "gone_hash")
    )
    gone = classes.where("NOT kept").select(
        F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)
    )
    rows = docs.withColumn(key, F.unhex(F.md5("text"))).withColumn(
        number, F.col("doc_id").cast("long")
    )
    kept = rows.join(
        gone, (F.col(number) == F.col(gone_id)) & (F.col(key) == F.col(gone_hash)), "left_anti"
    )
    # rows alike in id and text are one document
    return kept.dropDuplicates([number, key]).drop(key, number)
