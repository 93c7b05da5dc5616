"""Fill-in-middle documents, cut by an indexable skip list.

The units of a text are its runs of ASCII letters and its other code points. A skip list stands over them:
every unit is in the lowest lane by a chance of 1 in ``RATIO``, in each higher lane by the same chance
again, and every link carries how many units and how many code points it passes. A cut after a number of
units descends from the highest lane, adds up the widths, and ends with single units of the text.

A null text is empty, and empty texts stay plain. A missing id counts as an empty one, rows alike in id
and text are cut alike, an empty table gives none. Texts are never shortened: the list is built over pieces
of ``PIECE`` code points and holds one unit in ``RATIO``. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodfeed.llm.arrow import SLICE_BYTES, slices, unused
from moodfeed.llm.ship import ship
from moodfeed.llm.words import U64, mix

RATIO = 16
PIECE = 1 << 18
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

_UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
_MARK = re.compile("|".join((PREFIX, SUFFIX, MIDDLE)))

RESULT = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


class Lane:
    """Links of one lane: the units and code points that each passes, and its place in the lane below."""

    def __init__(self, ranks: np.ndarray, points: np.ndarray, n: int, length: int, down: np.ndarray | None):
        self.units = np.diff(ranks, append=n)
        self.points = np.diff(points, append=length)
        self.down = down


class SkipList:
    def __init__(self, text: str) -> None:
        self.text = text
        ranks, points, heights = self._nodes()
        self.lanes: list[Lane] = []
        down = None
        for level in range(int(heights.max(initial=0)) + 1):
            up = np.flatnonzero(heights >= level)
            self.lanes.append(Lane(ranks[up], points[up], self.n, len(text), down))
            down = np.flatnonzero(heights[up] > level)

    def _nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranks, code points and heights of the units in the lowest lane; the first unit is in all."""
        ranks, points = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        self.n, within = 0, False
        for a in range(0, len(self.text), PIECE):
            codes = np.frombuffer(self.text[a : a + PIECE].encode("utf-32-le"), "<u4") | np.uint32(32)
            letter = (codes >= ord("a")) & (codes <= ord("z"))
            before = np.empty_like(letter)
            before[0], before[1:] = within, letter[:-1]
            starts = np.flatnonzero(~(letter & before))
            rank = np.arange(self.n, self.n + len(starts))
            up = (mix(rank.astype(U64)) % U64(RATIO) == 0) & (rank > 0)
            ranks.append(rank[up])
            points.append(starts[up] + a)
            self.n += len(starts)
            within = bool(letter[-1])
        rank, point = np.concatenate(ranks), np.concatenate(points)
        draw, height = mix(rank.astype(U64)) // U64(RATIO), np.zeros(len(rank), np.int64)
        while True:
            higher = draw % U64(RATIO) == 0
            higher &= height == height.max()
            higher[0] = True
            if higher.sum() < 2:
                return rank, point, height
            height[higher] += 1
            draw = draw // U64(RATIO)

    def cut(self, rank: int) -> int:
        """Code points before the unit of this rank."""
        place = units = points = 0
        for lane in reversed(self.lanes):
            while place < len(lane.units) and units + lane.units[place] <= rank:
                units += int(lane.units[place])
                points += int(lane.points[place])
                place += 1
            if place == len(lane.units):
                return points
            if lane.down is not None:
                place = int(lane.down[place])
        for _ in range(rank - units):
            points = _UNIT.match(self.text, points).end()
        return points


def infill(text: str, draws: list[int], plain_from: int, spm_below: int) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text."""
    units = SkipList(text)
    h1, h2, h3, h4 = draws
    if not text or _MARK.search(text) or h3 % 100 >= plain_from:
        return units.n, PLAIN, None, None, text
    first, second = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.cut(first), units.cut(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return units.n, SPM, a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return units.n, PSM, a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def draws_of(id_column: str, seed: int) -> Column:
    """Four numbers below 2^32 from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return F.array(
        *(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4))
    )


def transform(
    docs: DataFrame,
    name: str,
    seed: int = 1,
    plain_from: int = 90,
    spm_below: int = 20,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """All columns of ``docs`` and a struct ``name``: n (units), form, prefix_chars, middle_chars, output.

    A text is cut unless a draw in 0 to 99 reaches ``plain_from``; of those cut, those with a draw below
    ``spm_below`` give the suffix first.
    """
    ship(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, RESULT)])
    names, at = schema.names, docs.columns.index(text)
    drawn = docs.withColumn(unused(docs, "draws"), draws_of(id_column, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # positions, as other columns may repeat a name
            plain = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in slices(plain, f"c{at}", SLICE_BYTES):
                *columns, draws = part.columns
                rows = [
                    infill(t.as_py() or "", d.as_py(), plain_from, spm_below)
                    for t, d in zip(columns[at], draws)
                ]
                fields = [
                    pa.array([r[i] for r in rows], kind)
                    for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))
                ]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.StructArray.from_arrays(fields, RESULT.names)], names=names
                )

    return drawn.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    parts = F.split(output, _MARK.pattern, -1)
    return (
        F.when(form == PLAIN, output)
        .when(form == PSM, F.concat(parts[1], parts[3], parts[2]))
        .when(form == SPM, F.concat(parts[2], parts[3], parts[1]))
    )
