"""Shards of nearly equal size by a k-d tree over metadata.

The tree starts with all rows and the number of shards. A node that has k of them left is split along its widest dimension
(its range as a share of the whole table's), at the weighted median that gives floor(k / 2) of k parts of its bytes to the
left, until nodes have one shard each. The medians of all nodes of a level are found at once: a pass over a narrow table of keys
puts each row in its node and in one of BUCKETS parts of the range that the node's median still lies in, sums sizes by part
where the rows lie, and keeps the part that holds the median; a range is settled when it holds one row or less than
CLOSE of a shard. Rows that tie in the dimension are told apart by a hash of their id and text, and rows that repeat both by
their place in the table; so a value, a text or a row that a third of the table has is split like any other. The order within a
dimension puts equal values side by side, so neighbours in the metadata share a shard.

What reaches the driver in a pass is at most ROWS sums; the tree has two nodes a shard and travels with the tasks. Rows move
once, when the slots of a shard are numbered, in up to SALTED parts of each shard.

Defined results for odd input: a null text has no bytes and the checksum of an empty one; a null or NaN dimension
counts as -1; a null id is an id; repeated rows are placed row by row; in a table with fewer rows than shards some shards stay
empty; an empty table gives an empty result; dimensions of strings are told apart by their first six bytes and then by the
hash; infinite dimensions count as the greatest and least finite ones; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tesserae.runtime import written

#: Fixed values of the contract.
SHARDS, OVERHEAD, LAW = 40, 16, "bytes"
#: The columns of ``documents`` that a shard is made of neighbours in.
DIMENSIONS = ("n_chars", "lang", "source")
#: Most parts that the rows of one shard are numbered in, and rows a part should have.
SALTED, PART = 4096, 1 << 15
#: Most parts of a node's range in a pass, most sums of a pass, and the share of a shard that a median may be off.
BUCKETS, ROWS, CLOSE = 4096, 1 << 18, 1e-5


def _number(df: DataFrame, column: str) -> Column:
    """A column as a double in its own order: numbers and times as they are, strings by their first six bytes."""
    kind, c = df.schema[column].dataType.typeName(), F.col(f"`{column}`")
    if kind in ("string", "varchar", "char", "binary"):
        c = F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10)
    elif kind == "boolean":
        c = c.cast("int")
    elif kind == "date":
        c = F.unix_date(c)
    held = F.greatest(F.lit(-1.7e308), F.least(F.lit(1.7e308), F.nanvl(c.cast("double"), F.lit(-1.0))))
    return F.coalesce(held, F.lit(-1.0)) if kind != "null" else F.lit(-1.0)


def keyed(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """The columns that place a row: its id, size, checksum, dimensions and the hash that parts ties."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    hashed = F.xxhash64(F.col(f"`{id_col}`"), F.crc32(text), F.length(text))
    return {
        "_id": F.col(f"`{id_col}`"), "_size": F.octet_length(text).cast("long") + OVERHEAD, "_crc": F.crc32(text),
        "_x": F.array(*(_number(docs, d) for d in dimensions)), "_y": F.shiftrightunsigned(hashed, 12).cast("double"),
    }


class Tree:
    """Cuts by node; the children of node n are 2 n and 2 n + 1. A cut is a place in the order of dimension, hash and position:
    rows before it, and with ``inclusive`` those at it, go left."""

    def __init__(self, shards: int):
        n = 1 << (2 + max(shards - 1, 1).bit_length())
        self.dim, self.at, self.inclusive = np.full(n, -1), np.zeros((n, 3)), np.zeros(n, bool)
        self.shard = np.full(n, -1)

    def nodes(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The leaf, or the node not yet split, of each row; ``x`` has a column for each dimension."""
        node = np.ones(len(y), np.int64)
        while True:
            inner = np.flatnonzero(self.dim[node] >= 0)
            if not len(inner):
                return node
            here = node[inner]
            key = np.stack([x[inner, self.dim[here]], y[inner], z[inner]])
            cut = self.at[here].T
            beyond = ~self.inclusive[here]
            for k in (2, 1, 0):
                beyond = (key[k] > cut[k]) | ((key[k] == cut[k]) & beyond)
            node[inner] = 2 * here + beyond


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, z = (batch.column(c).to_numpy() for c in ("_y", "_z"))
    return batch.column("_x").flatten().to_numpy().reshape(batch.num_rows, -1), y, z


def _sums(code: np.ndarray, values: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """By code: the sum of sizes, the number of rows, the least and the greatest value."""
    order = np.argsort(code, kind="stable")
    code, values, size = code[order], values[order], size[order]
    first = np.flatnonzero(np.diff(code, prepend=-1)) if len(code) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(code)))
    return [code[first], *(np.add.reduceat(size, first) if len(first) else size[:0],), n, *(f.reduceat(values, first) if len(first) else values[:0] for f in (np.minimum, np.maximum))]


def _pass(rows: DataFrame, code_of) -> list:
    """Sums by code over all rows: partial sums of each batch, then one small shuffle. ``code_of`` gives codes and values of
    some of a batch's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for code, values, size in code_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _sums(code, values, size)], names=["code", "size", "n", "lo", "hi"])

    parts = rows.mapInArrow(run, "code long, size long, n long, lo double, hi double")
    return parts.groupBy("code").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()


class _Search:
    """Where the median of a node lies: the components of its place found so far, and the range of the next."""

    def __init__(self, dim: int, lo: float, hi: float, goal: float):
        self.dim, self.lo, self.hi, self.goal, self.found = dim, lo, hi, goal, []

    def settle(self, value: float, size: float, n: int, close: float) -> bool:
        """A component has one value left, with ``size`` bytes of which ``goal`` go left; whether the place is settled."""
        self.found.append(value)
        if n > 1 and size > close and len(self.found) < 3:
            # 52 bits of hash, and positions: a partition's number over 33 bits
            self.lo, self.hi = (0.0, float(1 << 52)) if len(self.found) == 1 else (0.0, float(1 << 63))
            return False
        self.left = 2 * self.goal >= size
        self.found += [np.inf if self.left else -np.inf] * (3 - len(self.found))
        return True


def grown(rows: DataFrame, shards: int, n_dims: int) -> Tree:
    """The tree over ``rows``: a table of ``_x``, ``_y``, ``_z`` and ``_size``."""
    tree, nodes, whole = Tree(shards), {1: (0, shards)}, None  # node: its first shard and how many it has
    while nodes:
        for node, (first, k) in nodes.items():
            if k == 1:
                tree.shard[node] = first
        nodes = {node: x for node, x in nodes.items() if x[1] > 1}
        if not nodes:
            break
        spans = _spans(rows, tree, np.array(sorted(nodes)), n_dims)
        whole = whole or (spans[1][1:] if 1 in spans else None)
        searches, close = {}, 0.0
        for node, (mass, lo, hi) in spans.items():
            width = [(hi[d] - lo[d]) / ((whole[1][d] - whole[0][d]) or 1.0) for d in range(n_dims)]
            dim, k = int(np.argmax(width)), nodes[node][1]
            searches[node], close = _Search(dim, lo[dim], hi[dim], mass * (k // 2) / k), max(close, CLOSE * mass / k)
        _find(rows, tree, searches, close)
        for node in nodes:
            tree.dim[node] = searches[node].dim if node in searches else 0  # without rows any cut will do
            if node in searches:
                tree.at[node], tree.inclusive[node] = searches[node].found, searches[node].left
        nodes = {child: part for node, (first, k) in nodes.items() for child, part in ((2 * node, (first, k // 2)), (2 * node + 1, (first + k // 2, k - k // 2)))}
    return tree


def _spans(rows: DataFrame, tree: Tree, nodes: np.ndarray, n_dims: int) -> dict[int, tuple[int, list[float], list[float]]]:
    """Of each node that has rows its bytes, and the least and greatest value in each dimension."""

    def code_of(batch: pa.RecordBatch):
        x, y, z = _columns(batch)
        node, size = tree.nodes(x, y, z), batch.column("_size").to_numpy()
        some = np.isin(node, nodes)
        for d in range(n_dims):
            yield node[some] * n_dims + d, x[some, d], size[some]

    out: dict[int, tuple[int, list[float], list[float]]] = {}
    for r in sorted(_pass(rows, code_of), key=lambda r: r["code"]):
        mass, lo, hi = out.setdefault(r["code"] // n_dims, (r["size"], [], []))
        lo.append(r["lo"])
        hi.append(r["hi"])
    return out


def _find(rows: DataFrame, tree: Tree, searches: dict[int, _Search], close: float) -> None:
    """Settle the median of each node."""
    todo = dict(searches)
    while todo:
        buckets = max(16, min(BUCKETS, ROWS // len(todo)))
        names = np.array(sorted(todo))
        some = [todo[n] for n in names.tolist()]
        dim, depth = np.array([s.dim for s in some]), np.array([len(s.found) for s in some])
        lo, hi = np.array([s.lo for s in some]), np.array([s.hi for s in some])
        fixed = np.array([[*s.found, 0.0, 0.0][:2] for s in some])

        def code_of(batch: pa.RecordBatch, names=names, dim=dim, depth=depth, lo=lo, hi=hi, fixed=fixed, buckets=buckets):
            x, y, z = _columns(batch)
            node, size = tree.nodes(x, y, z), batch.column("_size").to_numpy()
            at = np.minimum(np.searchsorted(names, node), len(names) - 1)
            row = np.flatnonzero(names[at] == node)
            at = at[row]
            key = np.stack([x[row, dim[at]], y[row], z[row]])
            value = key[depth[at], np.arange(len(row))]
            inside = (value >= lo[at]) & (value <= hi[at]) & ((depth[at] < 1) | (key[0] == fixed[at, 0])) & ((depth[at] < 2) | (key[1] == fixed[at, 1]))
            at, value = at[inside], value[inside]
            wide = np.where(hi > lo, hi / 2 - lo / 2, 1.0)
            part = np.minimum(((value / 2 - lo[at] / 2) / wide[at] * buckets).astype(np.int64), buckets - 1)
            yield at * buckets + part, value, size[row][inside]

        by_node: dict[int, list] = {}
        for r in sorted(_pass(rows, code_of), key=lambda r: r["code"]):
            by_node.setdefault(r["code"] // buckets, []).append(r)
        for i, found in by_node.items():
            search = some[i]
            for r in found:
                if search.goal < r["size"] or r is found[-1]:
                    break
                search.goal -= r["size"]
            if r["lo"] == r["hi"] or r["size"] <= close:
                # a range of little weight goes to one side as a whole
                whole = r["lo"] < r["hi"]
                if whole:
                    search.found += [r["hi"], *[np.inf] * 2][: 3 - len(search.found)]
                    search.left = True
                if whole or search.settle(r["lo"], r["size"], r["n"], close):
                    del todo[int(names[i])]
            else:
                search.lo, search.hi = r["lo"], r["hi"]


def _keys(docs: DataFrame, dimensions: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    keys = keyed(docs, dimensions, id_col, text_col)
    return written(docs.select(*(c.alias(n) for n, c in keys.items())).withColumn("_z", F.monotonically_increasing_id().cast("double")), "keys")


def placed(rows: DataFrame, tree: Tree) -> DataFrame:
    """``rows`` (with ``_x``, ``_y``, ``_z``) and ``_shard``; they stay where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = tree.shard[tree.nodes(*_columns(batch))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], names=[*batch.schema.names, "_shard"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_shard", IntegerType())]))


def assigned(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size (UTF-8 bytes and OVERHEAD), text_crc32, law, shard, slot and grown_shard (null:
    a tree is made anew for another number of shards)."""
    rows = _keys(docs, dimensions, id_col, text_col)
    found = written(placed(rows, grown(rows, shards, len(dimensions))).drop("_x"), "shards")
    parts = max(1, min(SALTED, -(-found.count() // (shards * PART))))
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("_y", "_z"), F.lit(parts)).cast("int"))
    tally = salted.groupBy(F.col("_shard").alias("_l"), F.col("_salt").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("_l").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # at most SALTED rows
    offsets = tally.select("_l", "_s", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_o"))
    order = Window.partitionBy("_shard", "_salt").orderBy("_y", "_z")
    out = salted.withColumn("_r", F.row_number().over(order) - 1).join(F.broadcast(offsets), (F.col("_shard") == F.col("_l")) & (F.col("_salt") == F.col("_s")))
    return out.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit(LAW).alias("law"),
        F.col("_shard").alias("shard"), (F.col("_o") + F.col("_r")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(docs: DataFrame, path: str, target_bytes: int, dimensions: tuple[str, ...] = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write ``docs`` with all columns as Parquet, a folder ``shard=k`` for each shard of about ``target_bytes``; their number.

    The tree is fitted on keys alone and then places the rows where they lie; of rows that repeat an id and a text, all those
    at a cut go to one side of it.
    """
    rows = _keys(docs, dimensions, id_col, text_col)
    total = rows.agg(F.sum("_size")).first()[0] or 0
    shards = max(1, -(-total // target_bytes))
    keys = keyed(docs, dimensions, id_col, text_col)
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(keys[c].alias(c) for c in ("_x", "_y"))).withColumn("_z", F.lit(0.0))
    out = placed(inner, grown(rows, shards, len(dimensions))).select("_row.*", F.col("_shard").alias("_folder"))
    # clashing names: the folder is named by a column that ``docs`` doesn't have
    name = "shard"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    out.withColumnRenamed("_folder", name).write.partitionBy(name).parquet(path)
    return shards
