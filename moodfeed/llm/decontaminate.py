"""Benchmark decontamination with suffix arrays of the training texts.

Each task sorts the suffixes of its own documents (a shard of the suffix array) and searches every
suffix of the benchmark items in it by bisection. A suffix is compared on its first ``window`` words,
so equal stretches of the array are all occurrences of a window; runs of occurrences on one diagonal
are the longest verbatim matches.

Suffixes that cannot match are left out of the array: those with a word that no item has among
their first words, as many as the shortest window has. The benchmark is cut into blocks of bounded
size; each is broadcast and searched in a pass of its own.

Null and empty texts have no words; repeated documents are all judged; a repeated item id counts
once; an item without an id is listed as ``null``; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodfeed.llm.arrow import annotate, text_bytes, unused
from moodfeed.llm.words import Words, words_of
from moodfeed.staging import stage

WINDOW = 13
#: Text bytes of the benchmark that are broadcast at once.
BLOCK_BYTES = 8 << 20

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.LongType()),
        T.StructField("longest_at", T.LongType()),
        T.StructField("longest_item", T.StringType()),
    ]
)
VERDICT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("longest", T.LongType()),
        T.StructField("longest_at", T.LongType()),
        T.StructField("longest_item", T.StringType()),
    ]
)


class Block:
    """The distinct windows of some items, as word numbers, and where they stand."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int) -> None:
        self.window = window
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        words = words_of(data, offsets, "ascii", lower=True)
        self.vocabulary = np.unique(words.hashes)
        numbers = np.searchsorted(self.vocabulary, words.hashes).astype(np.uint32) + 1
        self.ids = ids
        groups: dict[int, list] = {}
        for item, (a, b) in enumerate(zip(words.bounds, words.bounds[1:])):
            n = min(window, b - a)
            if n:
                rows = np.lib.stride_tricks.sliding_window_view(numbers[a:b], n)
                groups.setdefault(int(n), []).append((item, rows))
        #: by number of words: keys, and the items and places of each
        self.lengths = []
        for n, parts in sorted(groups.items()):
            rows = np.concatenate([r for _, r in parts])
            items = np.repeat([i for i, _ in parts], [len(r) for _, r in parts])
            places = np.concatenate([np.arange(len(r)) for _, r in parts])
            keys, inverse = np.unique(_keys(rows, n), return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            bounds = np.searchsorted(inverse[order], np.arange(len(keys) + 1))
            self.lengths.append((n, keys, items[order], places[order], bounds))
        self.shortest = self.lengths[0][0] if self.lengths else 0
        self.known = np.zeros(1 << 16, bool)
        self.known[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; 0 for words that no item has."""
        out = np.zeros(len(hashes), np.uint32)
        at = np.flatnonzero(self.known[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if len(at) and len(self.vocabulary):
            found = np.minimum(
                np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1
            )
            same = self.vocabulary[found] == hashes[at]
            out[at[same]] = found[same] + 1
        return out


def _keys(rows: np.ndarray, width: int, fill: int = 0) -> np.ndarray:
    """Rows of word numbers as byte strings in the same order; missing words are ``fill``."""
    full = np.full((len(rows), width), fill, ">u4")
    full[:, : rows.shape[1]] = rows
    return full.view(f"S{4 * width}").ravel()


def occurrences(words: Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places where a window of the block occurs: place, group of windows, window."""
    numbers = block.numbers(words.hashes)
    n, width = len(numbers), block.window
    # words from each place to the end of its text, and to the next unknown word
    ends = np.repeat(words.bounds[1:], words.counts())
    unknown = np.append(np.flatnonzero(numbers == 0), n)
    stop = np.minimum(ends, unknown[np.searchsorted(unknown, np.arange(n))])
    room = stop - np.arange(n)
    suffixes = np.flatnonzero(room >= block.shortest)
    none = np.zeros(0, np.int64)
    if not (len(suffixes) and block.lengths):
        return none, none, none
    padded = np.concatenate([numbers, np.zeros(width, np.uint32)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[suffixes]
    rows = np.where(np.arange(width) < room[suffixes, None], rows, 0)
    keys = _keys(rows, width)
    order = np.argsort(keys, kind="stable")  # the suffix array
    keys, suffixes = keys[order], suffixes[order]
    places, groups, windows = [], [], []
    for g, (length, tests, _, _, _) in enumerate(block.lengths):
        test_rows = tests.view(">u4").reshape(len(tests), length)
        low = np.searchsorted(keys, _keys(test_rows, width), "left")
        high = np.searchsorted(keys, _keys(test_rows, width, 0xFFFFFFFF), "right")
        hits = high - low
        at = np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
        places.append(suffixes[at])
        groups.append(np.full(len(at), g))
        windows.append(np.repeat(np.arange(len(tests)), hits))
    return np.concatenate(places), np.concatenate(groups), np.concatenate(windows)


def _scan(block: Block, column: pa.Array) -> pa.Array:
    data, offsets = text_bytes(column)
    words = words_of(data, offsets, "ascii", lower=True)
    places, groups, windows = occurrences(words, block)
    order = np.argsort(places, kind="stable")
    places, groups, windows = places[order], groups[order], windows[order]
    firsts = [places_[bounds[:-1]] for _, _, _, places_, bounds in block.lengths]
    owners = [items[bounds[:-1]] for _, _, items, _, bounds in block.lengths]
    lengths = np.array([length for length, *_ in block.lengths], np.int64)
    cuts = np.searchsorted(places, words.bounds)
    rows = []
    for i, n_words in enumerate(words.counts()):
        a, b = cuts[i], cuts[i + 1]
        base = int(words.bounds[i])
        if a == b:
            rows.append((int(n_words), [], [], 0, None, None))
            continue
        at, group, window = places[a:b] - base, groups[a:b], windows[a:b]
        spans = _merged(at, at + lengths[group])
        items: set[str] = set()
        longest = (0, 0, 0)
        for g in np.unique(group):
            own = group == g
            distinct = np.unique(window[own])
            _, _, item_of, _, bounds = block.lengths[g]
            for w in distinct:
                items.update(block.ids[x] for x in item_of[bounds[w] : bounds[w + 1]])
            # runs on one diagonal of one item
            item, place = owners[g][window[own]], firsts[g][window[own]]
            breaks = np.flatnonzero(
                (np.diff(at[own]) != 1) | (np.diff(place) != 1) | (np.diff(item) != 0)
            )
            begin = np.concatenate([[0], breaks + 1])
            size = np.diff(np.append(begin, own.sum())) + lengths[g] - 1
            k = int(np.argmax(size))
            longest = max(longest, (int(size[k]), -int(at[own][begin[k]]), int(item[begin[k]])))
        spans = [int(x) for pair in spans for x in pair]
        rows.append(
            (int(n_words), spans, sorted(items), longest[0], -longest[1], block.ids[longest[2]])
        )
    names = FOUND.names
    return pa.array([dict(zip(names, r)) for r in rows], _arrow(FOUND))


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Joined spans of sorted starts."""
    reach = np.maximum.accumulate(ends)
    new = np.append(True, starts[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return list(zip(starts[at], np.append(reach[at[1:] - 1], reach[-1])))


def _arrow(kind: T.StructType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _judge(found: pa.Array) -> pa.Array:
    rows = []
    for r in found.to_pylist():
        spans = np.array(r["spans"], np.int64).reshape(-1, 2)
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        hit = sum(int(b - a) for a, b in _merged(spans[:, 0], spans[:, 1])) if len(spans) else 0
        items = sorted(set(r["items"]))
        rows.append(
            {
                "n_words": r["n_words"],
                "n_hit": hit,
                "n_items": len(items),
                "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(),
                "contaminated": hit > 0 and 20 * hit >= r["n_words"],
                "longest": r["longest"],
                "longest_at": r["longest_at"],
                "longest_item": r["longest_item"],
            }
        )
    return pa.array(rows, _arrow(VERDICT))


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list[Callable[[], Block]]:
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text"
    )
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = 1 + int(size) // block_bytes
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))

    def block(i: int) -> Block:
        rows = sorted(map(tuple, items.where(part == i).collect()), key=lambda r: (r[0], r[1] or ""))
        return Block([r[0] for r in rows], [r[1] for r in rows], window)

    return [lambda i=i: block(i) for i in range(n)]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    name: str,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All rows and columns of ``docs`` and the verdict on ``text``, a struct called ``name``."""
    blocks = _blocks(benchmark, window, block_bytes)
    found = unused(docs, "found")
    spark = docs.sparkSession
    if len(blocks) == 1:
        only = spark.sparkContext.broadcast(blocks[0]())
        return annotate(
            docs, "text", lambda: lambda column: _judge(_scan(only.value, column)), VERDICT, name
        )

    def scanned(rows: DataFrame, make: Callable[[], Block]) -> DataFrame:
        shared = spark.sparkContext.broadcast(make())
        return annotate(
            rows, "text", lambda: lambda column: _scan(shared.value, column), FOUND, found
        )

    # numbered and stored, so that every pass sees the same numbers
    row = unused(docs, "row")
    docs = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    passes = None
    for make in blocks:
        one = scanned(docs.select(row, "text"), make).select(row, found)
        passes = one if passes is None else passes.unionByName(one)
    best = F.max(F.struct(f"{found}.longest", f"{found}.longest_at", f"{found}.longest_item"))
    merged = passes.groupBy(row).agg(
        F.struct(
            F.first(f"{found}.n_words").alias("n_words"),
            F.flatten(F.collect_list(f"{found}.spans")).alias("spans"),
            F.flatten(F.collect_list(f"{found}.items")).alias("items"),
            best["longest"].alias("longest"),
            best["longest_at"].alias("longest_at"),
            best["longest_item"].alias("longest_item"),
        ).alias(found)
    )
    rows = docs.join(merged, row).drop(row)
    schema = T.StructType([*[f for f in rows.schema if f.name != found], T.StructField(name, VERDICT)])
    at = rows.columns.index(found)

    def judged(batches):
        for batch in batches:
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, _judge(batch.column(at))], names=schema.names)

    return rows.mapInArrow(judged, schema)
