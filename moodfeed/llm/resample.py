"""Documents drawn by how much their words look like those of a target.

1. Words come from the ``tokenizers`` library: an untrained pre-tokenizer splits the ASCII-lowered text by
   a pattern and returns every word with its offsets. Each run of 1 to ``longest`` consecutive offset pairs
   is a feature, the words joined by one space; its bucket is its CRC-32 modulo ``buckets``.
2. Every document's buckets and counts are staged, so that texts are split once. Histograms of documents
   and target are summed in each task before the shuffle. The gains, one for each bucket, are broadcast.
3. A document's weight is the mean gain of its features; noise from its id is added (Gumbel), and the
   documents with the highest scores are drawn. An approximate quantile leaves the candidates, which a range
   sort ranks; no task holds them all.

A null text has no words. A missing id counts as an empty one. Rows alike in score and id take ranks
next to each other. With an empty table of documents or target every count is zero. Long texts
are split in pieces that overlap by ``longest`` - 1 words; a single word longer than a piece is its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodfeed.llm.arrow import SLICE_BYTES, slices, unused
from moodfeed.llm.ship import ship
from moodfeed.operators.ranking import with_position
from moodfeed.staging import stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_LAST_GAP = re.compile(r"(?s:.*)" + _GAP.pattern)
BUCKETS = 10_000
SEED = 2024
#: Code points that the pre-tokenizer is given at once.
PIECE = 1 << 20

FEATURES = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_features", T.LongType()),
        T.StructField("buckets", T.ArrayType(T.IntegerType())),
        T.StructField("counts", T.ArrayType(T.LongType())),
    ]
)


class Splitter:
    """Offset pairs of the words of ASCII-lowered texts."""

    def __init__(self) -> None:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self._split = Split(Regex(WORD), "removed", invert=True)

    def pairs(self, text: str) -> list[tuple[int, int]]:
        return [pair for _, pair in self._split.pre_tokenize_str(text)]

    def pieces(self, text: str, overlap: int) -> Iterator[tuple[str, list[tuple[int, int]], int]]:
        """Pieces of a text cut between words, their offset pairs, and how many of them were in the piece
        before."""
        start = fresh = old = 0
        while fresh < len(text):
            stop, lone = len(text), False
            if stop - fresh > PIECE:
                last = _LAST_GAP.match(text, fresh, fresh + PIECE)
                lone = last is None
                last = last or _GAP.search(text, fresh + PIECE)
                stop = last.end() if last else stop
            piece = text[start:stop]
            if lone:
                # one word, longer than what the pre-tokenizer should hold
                end = len(piece) - bool(_GAP.match(piece, len(piece) - 1))
                pairs = [*self.pairs(text[start:fresh]), (fresh - start, end)]
            else:
                pairs = self.pairs(piece)
            yield piece, pairs, old
            old = min(overlap, len(pairs))
            start = start + pairs[-old][0] if old else stop
            fresh = stop


def _runs(piece: str, pairs: list[tuple[int, int]], old: int, longest: int) -> Iterator[bytes]:
    """Features that end with a word after the first ``old``: the windows over the offset pairs."""
    if longest == 1 and piece.isascii():
        data = piece.encode()
        yield from (data[a:b] for a, b in pairs[old:])
        return
    words = [piece[a:b].encode() for a, b in pairs]
    for k in range(1, longest + 1):
        for i in range(max(0, old - k + 1), len(words) - k + 1):
            yield b" ".join(words[i : i + k])


def histogram(splitter: Splitter, text: str, longest: int, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, buckets in order, and their counts, of a lowered text."""
    n_words = 0
    parts = []
    for piece, pairs, old in splitter.pieces(text, longest - 1):
        n_words += len(pairs) - old
        crcs = np.fromiter(map(zlib.crc32, _runs(piece, pairs, old, longest)), np.int64)
        parts.append(np.unique(crcs % buckets, return_counts=True))
    if len(parts) == 1:
        return n_words, *parts[0]
    total = np.zeros(buckets if parts else 0, np.int64)
    for keys, counts in parts:
        total[keys] += counts
    return n_words, np.flatnonzero(total), total[total > 0]


def _offsets(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32())


def features(
    docs: DataFrame, name: str, longest: int, buckets: int, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all of them by default) and a struct: n_words, n_features, buckets,
    counts."""
    ship(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, FEATURES)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            plain = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            last = f"c{batch.num_columns - 1}"
            for part in slices(plain, last, SLICE_BYTES):
                *columns, texts = part.columns
                lowered = pc.ascii_lower(pc.fill_null(texts, ""))
                rows = [histogram(splitter, t.as_py(), longest, buckets) for t in lowered]
                keys, counts = [r[1] for r in rows], [r[2] for r in rows]
                offsets = _offsets(keys)
                struct = pa.StructArray.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([int(c.sum()) for c in counts], pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys).astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts), pa.int64())),
                    ],
                    FEATURES.names,
                )
                yield pa.RecordBatch.from_arrays([*columns, struct], names=names)

    # the text goes in last, under a name of its own
    return docs.select(*keep, F.col(text).alias(unused(docs, "_words_of"))).mapInArrow(run, schema)


def bucket_sums(found: DataFrame, name: str, buckets: int) -> DataFrame:
    """(bucket, n) over all rows; a task gives each bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            keys = np.asarray(batch.column("buckets").flatten())
            np.add.at(total, keys, np.asarray(batch.column("counts").flatten()))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"]
        )

    parts = found.select(f"{name}.buckets", f"{name}.counts").mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) from two tables of (bucket, n): 1000 times the log ratio of smoothed shares, floored."""
    s, t = docs.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    above = (F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))
    below = (F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(above / below)).alias("gain"))


def _weights(found: DataFrame, name: str, shared) -> DataFrame:
    """The rows of ``found``; their struct gives way to n_words, n_features, weight."""
    result = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    )
    at = found.columns.index(name)
    fields = list(found.schema.fields)
    fields[at] = T.StructField(name, result)
    schema = T.StructType(fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            n_words, n_features, keys, counts = columns[at].flatten()
            owner = np.repeat(np.arange(len(keys)), np.asarray(pc.list_value_length(keys)))
            gain = shared.value[np.asarray(keys.flatten())] * np.asarray(counts.flatten())
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, owner, gain)
            weight = total // np.maximum(np.asarray(n_features), 1)
            columns[at] = pa.StructArray.from_arrays(
                [n_words, n_features, pa.array(weight)], result.names
            )
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(run, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    name: str,
    percent: int = 10,
    least_words: int = 20,
    longest: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_column: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default, the id among them) and a struct ``name``: n_words,
    n_features, weight, score, rank.

    Of the documents with ``least_words`` words, the given percentage with the highest scores has ranks
    from 1, ties to the smaller id, nulls last; the others have none.
    """
    spark = docs.sparkSession
    found = stage(features(docs, name, longest, buckets, text, keep), "features")
    aim = features(target, name, longest, buckets, text, [])
    table = gains(
        stage(bucket_sums(found, name, buckets), "document_buckets"),
        stage(bucket_sums(aim, name, buckets), "target_buckets"),
        buckets,
    )
    # one row a bucket
    gain = np.array([r.gain for r in table.orderBy("bucket").collect()], np.int64)
    weighed = _weights(found, name, spark.sparkContext.broadcast(gain))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    score = F.col(f"{name}.weight") + noise
    scored = stage(weighed.withColumn(name, F.col(name).withField("score", score)), "scored")
    fit = F.col(f"{name}.n_words") >= least_words
    score = F.col(f"{name}.score")
    # the quantile is off by one row in 10,000 at most; twice that is left over
    at = max(0.0, 1 - percent / 100 - 0.0002)
    n, least = scored.where(fit).agg(F.count("*"), F.percentile_approx(score, at, 10_000)).first()
    wanted = percent * n // 100
    if wanted and scored.where(fit & (score >= least)).count() < wanted:
        least = scored.where(fit).agg(F.min(score)).first()[0]
    high = F.coalesce(fit & (score >= F.lit(least if wanted else None).cast("long")), F.lit(False))
    order, tie, place = (unused(scored, c) for c in ("_order", "_tie", "_place"))
    near = scored.where(high).select(
        "*", (-score).alias(order), F.monotonically_increasing_id().alias(tie)
    )
    ranked = with_position(near, [order, F.col(id_column).asc_nulls_last(), tie], place)
    rank = F.when(F.col(place) < wanted, F.col(place) + 1)
    return (
        ranked.withColumn(name, F.col(name).withField("rank", rank))
        .drop(order, tie, place)
        .unionByName(
            scored.where(~high).withColumn(name, F.col(name).withField("rank", F.lit(None).cast("long")))
        )
    )
