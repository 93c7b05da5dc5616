"""Sharding by a k-d tree over document metadata, split at distributed weighted medians.

A node that must become k shards is cut in two along its widest dimension, so that the left side
gets floor(k/2)/k of its bytes, until every leaf is one shard of the target size. Numbers are compared
on a logarithmic scale, other values by hash; a dimension's width is the share of its range in the
whole table that the node spans. All nodes of a level are cut together: a round is one aggregation of
bytes by node and cell, of at most ``CELLS`` cells a node, whatever the input. The cell into which a cut
falls is refined by the hash of the text, then by that of the id, until it weighs less than
``tolerance`` of a shard or cannot be divided. The tree is thus a short list of rules, and a row finds
its shard without moving.

Equal texts stay together unless a cut has to divide their group, if all dimensions follow from the
text: its hash decides before the id does. Rows equal in text and id stay together. A null text has no
bytes, a null dimension is a value of its own, and an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodfeed.llm.arrow import unused
from moodfeed.staging import stage

SHARDS = 40
TOLERANCE = 0.001
#: Bytes that a document counts beside its text.
OVERHEAD = 16
BITS = 10
CELLS = 1 << BITS
#: Cells of a doubling of a number.
PER_OCTAVE = 12
#: Columns that refine a cell, in this order: bits of the text's hash, then of the id's.
REFINE = ["t0", "t1", "t2", "i0", "i1", "i2"]
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def doc_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def text_crc32(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")))


def _cell(name: str, kind: str) -> Column:
    if kind in NUMBERS or kind.startswith("decimal"):
        value = F.col(name).cast("double")
        scaled = F.signum(value) * F.floor(F.log2(1 + F.abs(value)) * PER_OCTAVE)
    else:
        scaled = F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(CELLS))
    return F.coalesce(scaled.cast("int"), F.lit(-CELLS))


def _coordinates(docs: DataFrame, dimensions: list[str], id_column: str) -> dict[str, Column]:
    kinds = dict(docs.dtypes)
    out = {f"c{i}": _cell(d, kinds[d]) for i, d in enumerate(dimensions)}
    for letter, column in (("t", "text"), ("i", id_column)):
        for k in range(3):
            piece = F.shiftrightunsigned(F.xxhash64(F.col(column).cast("string")), k * BITS)
            out[f"{letter}{k}"] = piece.bitwiseAND(CELLS - 1).cast("int")
    return out


@dataclass
class Node:
    shards: int
    first: int  # its lowest shard
    dimension: int = 0  # of the cut
    path: list[int] = field(default_factory=list)  # cells of the dimension, then of REFINE
    inclusive: bool = False  # whether the last cell goes left
    children: tuple["Node", "Node"] | None = None

    def all(self) -> list["Node"]:
        return [self] + [x for c in self.children or () for x in c.all()]

    def cut(self) -> list[int]:
        """What a row's cells must be less than to go left."""
        rest = len(REFINE) + 1 - len(self.path)
        return self.path + [(1 << 30) if self.inclusive else -(1 << 30)] * rest


def _key(names: list[str]) -> Column:
    """The row's cells along the dimension of its node, then the refining ones; these compare like
    the cuts do."""
    own = F.get(F.array(*map(F.col, names)), F.col("dimension"))
    return F.array(own, *map(F.col, REFINE))


def _values(table: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of whole numbers and lists of them, to be broadcast; as SQL, which needs no
    Python on the executors."""

    def literal(value: int | list[int]) -> str:
        return f"array({', '.join(map(str, value))})" if isinstance(value, list) else str(value)

    listed = ", ".join(f"({', '.join(map(literal, row))})" for row in rows)
    return F.broadcast(
        table.sparkSession.sql(f"SELECT * FROM VALUES {listed} AS rules({', '.join(names)})")
    )


def _rules(table: DataFrame, nodes: list[Node], pending: list[int]) -> DataFrame:
    """The nodes as a table, of twice as many rows as there are shards."""
    at = {id(x): i for i, x in enumerate(nodes)}
    rows = []
    for i, x in enumerate(nodes):
        left, right = (at[id(c)] for c in x.children or (x, x))
        depth = len(x.path) if i in pending else -1
        rows.append((i, x.dimension, x.cut(), left, right, x.path or [0], depth))
    names = ["node", "dimension", "cut", "to_left", "to_right", "path", "depth"]
    return _values(table, rows, names)


def place(table: DataFrame, root: Node, names: list[str]) -> DataFrame:
    """Add the number, in the order of ``root.all()``, of the ``node`` that each row falls into."""
    rules = _rules(table, root.all(), []).select("node", "dimension", "cut", "to_left", "to_right")
    columns = table.columns
    table = table.withColumn("node", F.lit(0))
    level = [root]
    while level := [c for x in level for c in x.children or ()]:
        step = F.when(_key(names) < F.col("cut"), F.col("to_left")).otherwise(F.col("to_right"))
        table = table.join(rules, "node").select(*columns, step.alias("node"))
    return table


def grow_tree(table: DataFrame, names: list[str], shards: int, tolerance: float = TOLERANCE) -> Node:
    """The tree of a table of coordinates and ``size``."""
    root = Node(shards, 0)
    slack, ranges = 0.0, None
    while True:
        nodes = root.all()
        opened = [i for i, x in enumerate(nodes) if x.children is None and x.shards > 1]
        if not opened:
            return root
        numbered = place(table, root, names)
        spans = {
            r["node"]: r
            for r in numbered.groupBy("node")
            .agg(
                F.sum("size").alias("bytes"),
                *(f(c).alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))),
            )
            .collect()
        }
        if ranges is None:
            if not spans:
                return root
            whole = spans[0]
            ranges = [max(1, whole[f"hi_{c}"] - whole[f"lo_{c}"]) for c in names]
            slack = tolerance * whole["bytes"] / shards
        wanted: dict[int, float] = {}
        for i in opened:
            row, x = spans.get(i), nodes[i]
            widths = [
                (row[f"hi_{c}"] - row[f"lo_{c}"]) / r if row else 0 for c, r in zip(names, ranges)
            ]
            x.dimension, x.path = widths.index(max(widths)), []
            wanted[i] = (row["bytes"] if row else 0) * (x.shards // 2) / x.shards
        pending = opened
        while pending:
            pending = _refine(numbered, nodes, pending, names, wanted, slack)
        for i in opened:
            x = nodes[i]
            half = x.shards // 2
            x.children = (Node(half, x.first), Node(x.shards - half, x.first + half))


def _refine(
    numbered: DataFrame,
    nodes: list[Node],
    pending: list[int],
    names: list[str],
    wanted: dict[int, float],
    slack: float,
) -> list[int]:
    """Add to each pending cut the cell in which it falls; returns those to go on with."""
    rules = _rules(numbered, nodes, pending).select("node", "dimension", "path", "depth")
    rows = (
        numbered.join(rules, "node")
        .select("node", "size", _key(names).alias("key"), "path", "depth")
        .where("depth >= 0 AND slice(key, 1, depth) = slice(path, 1, depth)")
        .groupBy("node", F.expr("get(key, depth)").alias("cell"))
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .collect()
    )
    cells: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["node"], r["cell"])):
        cells.setdefault(r["node"], []).append(r)
    again = []
    for i in pending:
        below, x = 0, nodes[i]
        for r in cells.get(i, []):
            if below + r["bytes"] >= wanted[i]:
                break
            below += r["bytes"]
        else:
            x.path.append(1 << 30)  # nothing to divide: all go left
            continue
        x.path.append(r["cell"])
        rest = wanted[i] - below
        x.inclusive = r["bytes"] - rest < rest
        if r["bytes"] > slack and r["n"] > 1 and len(x.path) <= len(REFINE):
            wanted[i] = rest
            again.append(i)
    return again


def kd_shards(
    docs: DataFrame,
    dimensions: list[str],
    name: str,
    shards: int | None = None,
    target_bytes: int | None = None,
    id_column: str = "doc_id",
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """All rows and columns of ``docs`` and their shard, an int called ``name``.

    Give the number of shards, or the bytes that a shard should have.
    """
    columns = _coordinates(docs, dimensions, id_column)
    names = [c for c in columns if c not in REFINE]
    table = stage(
        docs.select(doc_size().alias("size"), *(c.alias(n) for n, c in columns.items())), "metadata"
    )
    if shards is None:
        total = table.agg(F.sum("size")).first()[0] or 0
        shards = max(1, round(total / target_bytes))
    tree = grow_tree(table, names, shards, tolerance)
    # the rules are applied to the cells in a struct, apart from the table's own columns
    own = unused(docs, "row")
    packed = docs.select(F.struct(*docs.columns).alias(own), *(c.alias(n) for n, c in columns.items()))
    firsts = [(i, x.first) for i, x in enumerate(tree.all())]
    shard = _values(docs, firsts, ["node", "shard"])
    placed = place(packed, tree, names).join(shard, "node")
    return placed.select(*(F.col(own)[c].alias(c) for c in docs.columns), F.col("shard").alias(name))


def with_slots(rows: DataFrame, shard: str, name: str, id_column: str = "doc_id") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, by the hash of their id.

    Hash ranges are numbered side by side and their sizes summed up.
    """
    part, offset = unused(rows, "part"), unused(rows, "offset")
    rows = rows.withColumn(part, F.pmod(F.xxhash64(id_column), F.lit(CELLS)).cast("int"))
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(shard, part).agg(F.count("*").alias("n"))
    offsets = sizes.select(
        shard, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(offset)
    )
    within = Window.partitionBy(shard, part).orderBy(id_column)
    numbered = rows.withColumn(name, F.row_number().over(within) - 1)
    return numbered.join(offsets, [shard, part]).withColumn(
        name, (F.col(name) + F.col(offset)).cast("long")
    ).drop(part, offset)
