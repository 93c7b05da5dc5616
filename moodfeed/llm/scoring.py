"""Language-model scores of whole documents.

1. Word counts come from all training texts, summed in each task before the shuffle.
2. The ``HEAD`` most frequent words are the model's own; counts of the ``COMMON`` most frequent are
   broadcast (both bounds are fixed). Words beyond are joined with the counts by shuffle.
3. All training documents train the recurrent model, each in one of ``ROUNDS`` rounds: in each round,
   trainers of about ``TRAINER_TOKENS`` tokens start from the same weights and pass over their own
   documents, and their weights are averaged by Spark, block by block.
4. Every text is scored whole. A word outside the head has the model's probability of its kind (its
   length and last character) times its smoothed share of the training words of that kind.

Words are kept apart by a 64-bit hash. A null text is empty and has its end only. Rows alike in id and
text get equal scores; a missing id is a value like any other. Without training texts every count is
zero and the model is uniform over its classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodfeed.llm import gru
from moodfeed.llm import words as wd
from moodfeed.llm.arrow import slices, text_bytes
from moodfeed.llm.ship import ship
from moodfeed.staging import stage

HEAD = 2048
COMMON = 1 << 18
#: Texts of so many tokens are scored at once.
SCORED_TOKENS = 2_000_000
ROUNDS = 4
TRAINER_TOKENS = 600_000
#: Weights of so many trainers are averaged at once, and then their averages.
AVERAGED = 256
LENGTHS = np.array([2, 4, 6, 8, 11])  # words up to so many bytes, and longer ones
ENDINGS = 4  # letter or digit, full stop, comma, anything else
KINDS = (len(LENGTHS) + 1) * ENDINGS
#: The end of a text among the hashes; kind -1.
END = np.uint64(0xE4D)
BLOCK = 8192

_ENDING = np.full(256, 3)
_ENDING[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 0
_ENDING[ord(".")], _ENDING[ord(",")] = 1, 2


def tokens(column: pa.Array) -> tuple[wd.Words, np.ndarray]:
    """Words of texts and their kinds."""
    words = wd.words_of(*text_bytes(column), "space", lower=True)
    length = np.searchsorted(LENGTHS, words.ends - words.starts)
    ending = _ENDING[words.data[words.ends - 1]] if len(words.ends) else np.zeros(0, np.int64)
    return words, length * ENDINGS + ending


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, kind, n) of the given documents; the end is a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kinds, held = [], [], 0

        def flush() -> pa.RecordBatch:
            all_hashes, all_kinds = np.concatenate(hashes), np.concatenate(kinds)
            # sorting values is much faster than sorting places, and words of a kind need no places
            order = np.argsort(all_kinds.astype(np.int8), kind="stable")
            all_hashes, cuts = all_hashes[order], np.cumsum(np.bincount(all_kinds + 1, minlength=KINDS + 1))
            found = [
                (*np.unique(all_hashes[a:b], return_counts=True), kind)
                for kind, (a, b) in enumerate(zip([0, *cuts], cuts), -1)
            ]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([values for values, _, _ in found]).view(np.int64)),
                    pa.array(np.repeat(range(-1, KINDS), [len(x[0]) for x in found]).astype(np.int32)),
                    pa.array(np.concatenate([n for _, n, _ in found]).astype(np.int64)),
                ],
                names=["word", "kind", "n"],
            )

        for batch in batches:
            for part in slices(batch, "text"):
                words, kind = tokens(part.column("text"))
                hashes += [words.hashes, np.full(part.num_rows, END)]
                kinds += [kind, np.full(part.num_rows, -1)]
                held += len(words.hashes) + part.num_rows
                if held > 2_000_000:
                    yield flush()
                    hashes, kinds, held = [], [], 0
        if held:
            yield flush()

    parts = docs.select("text").mapInArrow(run, "word long, kind int, n long")
    return parts.groupBy("word").agg(F.max("kind").alias("kind"), F.sum("n").alias("n"))


class Vocabulary:
    """Counts of common words, symbols of head words, and sums for the other ones."""

    def __init__(self, common: pa.Table, n: int, v: int, kind_sums: dict[int, tuple[int, int]]):
        hashes = np.asarray(common.column("word").combine_chunks()).view(np.uint64)
        counts = np.asarray(common.column("n").combine_chunks())
        kinds = np.asarray(common.column("kind").combine_chunks())
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.logs = np.log10(self.counts + 0.5)
        ranked = np.flatnonzero(hashes != END)[:HEAD]  # the table comes in the order of counts
        self.shape = gru.Shape(HEAD, KINDS)
        symbol = np.full(len(hashes), -1, np.int32)
        symbol[ranked] = np.arange(len(ranked))
        self.symbol = symbol[order]
        self.n, self.v = n, v
        self.ends = int(counts[hashes == END].sum())
        kind_n = np.array([kind_sums.get(k, (0, 0))[0] for k in range(KINDS)], np.float64)
        kind_v = np.array([kind_sums.get(k, (0, 0))[1] for k in range(KINDS)], np.float64)
        kind_n -= np.bincount(kinds[ranked], counts[ranked], KINDS)[:KINDS]
        kind_v -= np.bincount(kinds[ranked], minlength=KINDS)[:KINDS]
        self.kind_log = np.log10(kind_n + 0.5 * (kind_v + 1))
        head = np.zeros(HEAD)
        head[: len(ranked)] = counts[ranked]
        self.symbol_counts = np.concatenate([head, [self.ends], kind_n])

    @cached_property
    def _first(self) -> tuple[np.ndarray, np.uint64]:
        """The place of the first hash that starts with certain bits, for all of them, and the shift
        to these bits; made where it is used."""
        bits = len(self.hashes).bit_length() + 1
        shift = np.uint64(64 - bits)
        return np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << shift), shift

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the common words, and whether it is one."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        first, shift = self._first
        last = len(self.hashes) - 1
        at = np.minimum(first.take(hashes >> shift), last)
        there = self.hashes.take(at)
        common = there == hashes
        # few hashes share their first bits
        left = np.flatnonzero(there < hashes)
        while len(left):
            at[left] += 1
            left = left[at[left] <= last]
            there, own = self.hashes.take(at[left]), hashes[left]
            common[left] = there == own
            left = left[there < own]
        return np.minimum(at, last), common

    def symbols(self, at: np.ndarray, common: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Symbols of words that were looked up."""
        symbol = np.where(common, self.symbol[at] if len(self.symbol) else -1, -1)
        return np.where(symbol >= 0, symbol, HEAD + 1 + kinds).astype(np.int32)


def vocabulary(counts: DataFrame) -> Vocabulary:
    n, v = counts.agg(F.sum("n"), F.count("*")).first()
    sums = counts.where("kind >= 0").groupBy("kind").agg(F.sum("n"), F.count("*")).collect()
    common = counts.orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    return Vocabulary(common, n or 0, v, {r[0]: (r[1], r[2]) for r in sums})


def _symbols(docs: DataFrame, shared) -> DataFrame:
    """Symbols of the documents that train, and their round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, kinds = tokens(part.column("text"))
                symbols = shared.value.symbols(*shared.value.look_up(words.hashes), kinds)
                rows = [symbols[a:b].tobytes() for a, b in zip(words.bounds, words.bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("draw"), pa.array(words.counts() + 1), pa.array(rows, pa.binary())],
                    names=["draw", "n", "symbols"],
                )

    return docs.mapInArrow(run, "draw long, n long, symbols binary")


def train_model(docs: DataFrame, shared) -> np.ndarray:
    """Weights fitted on the given documents, all of them."""
    spark = docs.sparkSession
    known: Vocabulary = shared.value
    draw = F.pmod(F.xxhash64(F.lit("train"), "doc_id", "text"), F.lit(1 << 40))
    learnt = stage(_symbols(docs.select(draw.alias("draw"), "text"), shared), "symbols")
    total = learnt.agg(F.sum("n")).first()[0] or 0
    trainers = max(1, round(total / (ROUNDS * TRAINER_TOKENS)))
    flat = known.shape.start(known.symbol_counts)
    for k in range(ROUNDS):
        weights = spark.sparkContext.broadcast(flat)

        def run(key: tuple, table: pa.Table) -> pa.Table:
            rows = table.sort_by("draw").column("symbols")
            texts = [np.frombuffer(r.as_buffer(), np.int32) for r in rows]
            new = gru.train(shared.value.shape, weights.value, texts)
            parts = [new[a : a + BLOCK].tobytes() for a in range(0, len(new), BLOCK)]
            size = sum(map(len, texts)) + len(texts)
            return pa.table(
                {
                    "block": pa.array(range(len(parts)), pa.int32()),
                    "part": pa.array([key[0].as_py() // AVERAGED] * len(parts), pa.int64()),
                    "size": pa.array([float(size)] * len(parts)),
                    "values": pa.array(parts, pa.binary()),
                }
            )

        def mean(table: pa.Table) -> pa.Table:
            size = np.asarray(table.column("size"))
            values = [np.frombuffer(x.as_buffer(), np.float32) for x in table.column("values")]
            average = (np.stack(values) * (size / size.sum())[:, None]).sum(0).astype(np.float32)
            return pa.table(
                {
                    "block": table.column("block").slice(0, 1),
                    "size": pa.array([size.sum()]),
                    "values": pa.array([average.tobytes()], pa.binary()),
                }
            )

        # rounds take turns through the draws, trainers share a round
        turn, rest = F.col("draw") % ROUNDS, F.floor(F.col("draw") / ROUNDS)
        trained = (
            learnt.where(turn == k)
            .withColumn("trainer", rest % trainers)
            .groupBy("trainer")
            .applyInArrow(run, "block int, part long, size double, values binary")
        )
        averaged = trained.groupBy("block", "part").applyInArrow(mean, "block int, size double, values binary")
        if trainers > AVERAGED:
            averaged = averaged.groupBy("block").applyInArrow(mean, "block int, size double, values binary")
        rows = sorted((r["block"], bytes(r["values"])) for r in averaged.collect())
        if rows:
            flat = np.concatenate([np.frombuffer(v, np.float32) for _, v in rows])
    return flat


_SCORES = (
    "doc_id {id}, held_out boolean, text_hash long, n_tokens long, n_known long, base double, "
    "model double, rare array<long>"
)


def _common_scores(docs: DataFrame, shared, weights) -> DataFrame:
    """Scores in which words beyond the common ones count as unseen, and those words."""
    schema = _SCORES.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = shared.value
        scorer = gru.Scorer(known.shape, weights.value)
        whole = np.log10(known.n + 0.5 * (known.v + 1))
        held, texts, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            model = scorer.score(texts) / np.log(10)
            for columns, inner in held:
                own, model = model[: len(inner)], model[len(inner) :]
                columns["model"] = pa.array(own + inner)
                yield pa.RecordBatch.from_arrays([columns[x] for x in names], names=names)

        for batch in batches:
            for part in slices(batch, "text"):
                words, kinds = tokens(part.column("text"))
                at, common = known.look_up(words.hashes)
                symbols = known.symbols(at, common, kinds)
                logs = np.where(common, known.logs[at] if len(known.logs) else 0, np.log10(0.5))
                seen = common & (known.counts[at] > 0) if len(known.counts) else common
                owner, n = words.owners(), part.num_rows
                base = np.bincount(owner, logs - whole, n) + np.log10(known.ends + 0.5) - whole
                inner = np.where(symbols > HEAD, logs - known.kind_log[kinds], 0.0)
                columns = {
                    "doc_id": part.column("doc_id"),
                    "held_out": part.column("held_out"),
                    "text_hash": part.column("text_hash"),
                    "n_tokens": pa.array(words.counts() + 1),
                    "n_known": pa.array(np.bincount(owner, seen, n).astype(np.int64) + (known.ends > 0)),
                    "base": pa.array(base),
                    "rare": pa.ListArray.from_arrays(
                        pa.array(np.append(0, np.cumsum(~common))[words.bounds].astype(np.int32)),
                        pa.array(words.hashes[~common].view(np.int64)),
                    ),
                }
                held.append((columns, np.bincount(owner, inner, n)))
                texts += [symbols[a:b] for a, b in zip(words.bounds, words.bounds[1:])]
                size += len(symbols) + n
                # many texts at once keep the lanes of the model full beside a long one
                if size > SCORED_TOKENS:
                    yield from flush()
                    held, texts, size = [], [], 0
        if held:
            yield from flush()

    return docs.select("doc_id", "held_out", "text_hash", "text").mapInArrow(run, schema)


def score(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """Scores of ``docs`` (doc_id, text) after learning from those that are not held out: doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score."""
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    rows = docs.select(
        "doc_id", held_out.alias("held_out"), F.xxhash64("text").alias("text_hash"), "text"
    )
    learning = rows.where("NOT held_out")
    counts = stage(word_counts(learning), "counts")
    shared = sc.broadcast(vocabulary(counts))
    weights = sc.broadcast(train_model(learning, shared))
    scored = stage(_common_scores(rows, shared, weights), "scores")
    # counts of all words that are not common; a word without a count was never seen
    rare = scored.select("doc_id", "text_hash", F.explode("rare").alias("word"))
    rare = rare.join(counts.select("word", "n"), "word")
    more = F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5))
    parts = rare.select(
        "doc_id", "text_hash", more.alias("more"), F.lit(1).alias("seen"), F.lit(0).alias("rows")
    ).unionByName(
        scored.select(
            "doc_id", "text_hash", F.lit(0.0).alias("more"), F.lit(0).alias("seen"), F.lit(1).alias("rows")
        )
    )
    # rows alike in id and text have added the same words
    sums = parts.groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_text")).agg(
        (F.sum("more") / F.sum("rows")).alias("more"),
        (F.sum("seen") / F.sum("rows")).cast("long").alias("seen"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_text"))
    return scored.drop("rare").join(sums, same).select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("seen")).alias("n_known"),
        F.lit(shared.value.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more")).alias("base_score"),
        (F.col("model") + F.col("more")).alias("score"),
    )
