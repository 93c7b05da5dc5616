"""Exact removal of repeated word windows by relative Lempel-Ziv parsing.

The reference is the corpus itself, cut into indexed blocks. A window's anchor is the least hash
among the word grams inside it, so equal windows have equal anchors: consecutive windows of a
document with one anchor form a piece, and a block holds the pieces whose anchors fall into it. A
document is thereby factored against every block that can hold a match, and no other.

1. Pieces are counted by anchor. An anchor that occurs once has no repeated window. An anchor whose
   pieces are all the same text makes them repeated as a whole, without being parsed.
2. The pieces of all other anchors are collapsed by content and parsed in their block: a factor is
   followed along its reference as far as both agree; where it ends, the next window is looked up in
   the index anew, so windows across factor boundaries are found as well.
3. Anchors with more than ``HOT`` pieces (a passage in a third of all documents) are not gathered:
   their windows are counted with partial sums, which gives the same.

Windows are told apart by two 64-bit hashes, of the anchor and of the window. Null and short texts
have no window; repeated rows repeat each other's windows; a missing id is a value like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodfeed.llm import words as wd
from moodfeed.llm.arrow import SLICE_BYTES, annotate, slices, text_bytes, unused
from moodfeed.llm.ship import ship
from moodfeed.staging import stage

WINDOW = 35
#: Words of an anchor.
GRAM = 8
#: Pieces of an anchor above which they are counted instead of parsed together.
HOT = 2048
#: Pieces that a block gets.
BLOCK = 20_000

U64 = np.uint64
KEY = ["doc_id", "text_hash"]


class Pieces:
    """The pieces of a slice of documents, and hashes of stretches of words."""

    def __init__(self, column: pa.Array, window: int, gram: int) -> None:
        words = wd.words_of(*text_bytes(column), "space", lower=False)
        self.bounds = words.bounds
        n = len(words.hashes)
        up, self.down = wd._powers_to(max(16, int(n).bit_length()))
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(words.hashes * up[:n], out=self.sums[1:])
        last = np.repeat(words.bounds[1:], words.counts()) - window
        self.starts = np.flatnonzero(np.arange(n) <= last)
        if len(self.starts):
            hashes = wd.grams(words.hashes, gram)
            views = np.lib.stride_tricks.sliding_window_view(hashes, window - gram + 1)
            anchors = self.starts + np.concatenate(
                [views[part].argmin(1) for part in np.array_split(self.starts, 1 + n // 20_000)]
            )
            new = np.flatnonzero(np.append(True, (np.diff(anchors) != 0) | (np.diff(self.starts) != 1)))
            self.first = self.starts[new]
            self.size = np.diff(np.append(new, len(anchors)))
            self.anchor = hashes[anchors[new]]
            # the place of the anchor tells pieces with the same words and another anchor apart
            content = self.stretch(self.first, self.first + self.size + window - 1)
            self.content = wd.mix(content + (anchors[new] - self.first).astype(U64))
        else:
            none = np.zeros(0, np.int64)
            self.first, self.size, self.anchor, self.content = none, none, none, none
        self.owner = np.searchsorted(self.bounds, self.first, "right") - 1

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from start to end."""
        total = (self.sums[end] - self.sums[start]) * self.down[start]
        return wd.mix(total + (end - start).astype(U64))


def _pieces(docs: DataFrame, window: int, gram: int) -> DataFrame:
    schema = "doc_id string, text_hash long, anchor long, content long, start int, n int"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = Pieces(part.column("text"), window, gram)
                at = pa.array(p.owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(at),
                        part.column("text_hash").take(at),
                        pa.array(p.anchor.view(np.int64)),
                        pa.array(p.content.view(np.int64)),
                        pa.array((p.first - p.bounds[p.owner]).astype(np.int32)),
                        pa.array(p.size.astype(np.int32)),
                    ],
                    names=names,
                )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, schema)


def _windows(flagged: DataFrame, window: int) -> DataFrame:
    """Hashes of the windows of the listed pieces of each text."""
    schema = "anchor long, content long, hot boolean, w array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = wd.words_of(*text_bytes(part.column("text")), "space", lower=False)
                n = len(words.hashes)
                up, down = wd._powers_to(max(16, int(n).bit_length()))
                sums = np.zeros(n + 1, U64)
                np.cumsum(words.hashes * up[:n], out=sums[1:])
                lists = part.column("pieces")
                flat = lists.flatten()
                owner = np.repeat(
                    np.arange(len(lists)), np.asarray(pa.compute.list_value_length(lists))
                )
                first = np.asarray(flat.field("start"), np.int64) + words.bounds[owner]
                size = np.asarray(flat.field("n"), np.int64)
                ends = np.cumsum(size)
                at = np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
                hashes = wd.mix((sums[at + window] - sums[at]) * down[at])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(0, ends).astype(np.int32)), pa.array(hashes.view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [flat.field("anchor"), flat.field("content"), flat.field("hot"), lists],
                    names=["anchor", "content", "hot", "w"],
                )

    return flagged.select("text", "pieces").mapInArrow(run, schema)


def parse(
    anchor: np.ndarray, copies: np.ndarray, size: np.ndarray, windows: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of the pieces of a block: piece, first window, number of windows.

    ``copies``: how often a piece occurs; ``size``: its number of windows.
    """
    n, owner = len(windows), np.repeat(np.arange(len(size)), size)
    order = np.lexsort((windows, anchor[owner]))
    a, w = anchor[owner][order], windows[order]
    new = np.append(True, (a[1:] != a[:-1]) | (w[1:] != w[:-1]))
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(new) - 1  # equal windows have equal numbers
    # the reference of a window: the next occurrence in the index, the first one after the last
    heads = np.flatnonzero(new)
    following = np.append(np.arange(1, n), 0)
    tails = np.append(heads[1:], n) - 1
    following[tails] = heads
    reference = np.empty(n, np.int64)
    reference[order] = order[following]
    found = (reference != np.arange(n)) | (copies[owner] > 1)
    # a factor goes on while the next windows of both places agree
    step = np.minimum(reference + 1, n - 1)
    agree = np.zeros(n, bool)
    agree[1:] = (
        (owner[1:] == owner[:-1])
        & found[:-1]
        & (owner[step[:-1]] == owner[reference[:-1]])
        & (group[1:] == group[step[:-1]])
    )
    begin = found & ~agree
    ids = np.cumsum(begin)[found]
    starts = np.flatnonzero(begin)
    lengths = np.bincount(ids, minlength=len(starts) + 1)[1:]
    first = np.cumsum(size) - size
    return owner[starts], starts - first[owner[starts]], lengths


def _factors(contents: DataFrame, blocks: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table.column("w").combine_chunks()
        size = np.asarray(pa.compute.list_value_length(lists), np.int64)
        anchor = np.asarray(table.column("anchor"))
        piece, start, n = parse(
            anchor, np.asarray(table.column("copies")), size, np.asarray(lists.flatten())
        )
        at = pa.array(piece)
        return pa.table(
            {
                "anchor": table.column("anchor").take(at),
                "content": table.column("content").take(at),
                "at": pa.array(start.astype(np.int32)),
                "m": pa.array(n.astype(np.int32)),
            }
        )

    return (
        contents.withColumn("block", F.pmod(F.hash("anchor"), F.lit(blocks)))
        .groupBy("block")
        .applyInArrow(run, "anchor long, content long, at int, m int")
    )


def _counted(contents: DataFrame) -> DataFrame:
    """As ``_factors``, for anchors with very many pieces."""
    rows = contents.select("anchor", "content", "copies", F.posexplode("w").alias("at", "w"))
    repeated = (
        rows.groupBy("anchor", "w").agg(F.sum("copies").alias("all")).where("all > 1").drop("all")
    )
    repeated = stage(repeated, "windows")  # as the anchors
    found = rows.join(repeated, ["anchor", "w"])
    return found.select("anchor", "content", "at", F.lit(1).alias("m"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Runs of repeated windows by document (``doc_id`` as text, ``text_hash``): lists of start, n."""
    pieces = _pieces(docs, window, gram)
    shared = (
        pieces.groupBy("anchor")
        .agg(
            F.count("*").alias("many"),
            (F.min("content") != F.max("content")).alias("differ"),
        )
        .where("many > 1")
        .select("anchor", "differ", (F.col("many") > HOT).alias("hot"))
    )
    # stored, so that the join has a shuffle of its own, whose hot anchors Spark can split
    shared = stage(shared, "anchors")
    flagged = stage(pieces.join(shared, "anchor"), "pieces")
    differing = flagged.where("differ")
    lists = differing.groupBy(*KEY).agg(
        F.collect_list(F.struct("anchor", "content", "start", "n", "hot")).alias("pieces")
    )
    windows = _windows(docs.join(lists, _same(docs, lists)).select("text", "pieces"), window)
    contents = stage(
        windows.groupBy("anchor", "content", "hot").agg(
            F.count("*").alias("copies"), F.first("w").alias("w")
        ),
        "contents",
    )
    cold = contents.where("NOT hot")
    blocks = 1 + cold.count() // BLOCK
    factors = _factors(cold, blocks).unionByName(_counted(contents.where("hot")))
    partial = differing.join(factors, ["anchor", "content"]).select(
        *KEY, (F.col("start") + F.col("at")).alias("start"), F.col("m").alias("n")
    )
    whole = flagged.where("NOT differ").select(*KEY, "start", "n")
    return (
        whole.unionByName(partial)
        .groupBy(*KEY)
        .agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    )


def _same(docs: DataFrame, other: DataFrame) -> F.Column:
    return (docs.text_hash == other.text_hash) & docs.doc_id.eqNullSafe(other.doc_id)


REMOVED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
    ]
)


def _remove(table: pa.RecordBatch, window: int) -> Iterator[tuple[int, int, bytes]]:
    for text, spans in zip(table.column("text"), table.column("spans")):
        words = (text.as_py() or "").encode().split()
        gone = np.zeros(len(words) + 1, np.int32)
        spans = spans.values
        if spans is not None and len(spans):
            start = np.asarray(spans.field("start"), np.int64)
            np.add.at(gone, start, 1)
            np.add.at(gone, start + np.asarray(spans.field("n")) + window - 1, -1)
            removed = np.cumsum(gone)[:-1] > 0
            kept = b" ".join(words[i] for i in np.flatnonzero(~removed))
            yield len(words), int(removed.sum()), kept
        else:
            yield len(words), 0, b" ".join(words)


def remove_repeated(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False
) -> DataFrame:
    """For each document (``doc_id``, ``text``): its words, how many lie in repeated windows, and
    the other words joined by one space, or the SHA-256 of that."""
    ship(docs.sparkSession)
    keyed = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        "text",
        F.col("doc_id").alias("original_id"),
    )
    spans = repeated_spans(keyed.drop("original_id"), window, gram)
    rows = keyed.join(spans, _same(keyed, spans), "left").select("original_id", "text", "spans")
    last = "kept_sha256" if digest else "kept"
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField(last, T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 * SLICE_BYTES):
                n, removed, kept = zip(*_remove(part, window))
                texts = [hashlib.sha256(k).hexdigest() if digest else k.decode() for k in kept]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("original_id"),
                        pa.array(n, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(texts, pa.string()),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)
