"""Embedding near-dedup: an exact metric range join within labels.

Unit vectors with cosine >= c lie within r = sqrt(2 - 2c) of each other. Copies become one class with a weight; vectors of one
label and length are a group. Large groups get pivots, in proportion to their vectors up to a total of PIVOTS; each vector belongs
to the cell of its nearest pivot, and cells are cut into blocks of about BLOCK. No vector is copied: a block is written once, as one row,
and pairs of blocks meet in a Cartesian product of that table's files, which are read again and never shuffled. So disk is in
proportion to the vectors, and a task holds the blocks of some files, however large a label is; time stays quadratic where nothing can be left out.
What can: as a link from p's side to q's crosses the plane midway between the pivots, both its ends are within r of that plane,
|cos(v, p) - cos(v, q)| <= r d(p, q). Blocks without such vectors don't meet, and of others those vectors alone are compared: in
single precision, and within its error of the threshold in double precision. A task gives each vector's number of links and
one row per vector that ties it to its part of the links (a star, not all pairs).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, without
from .components import components

PIVOTS = 2048  # in all groups together: what the driver holds and sends to tasks
CELL = 1024  # vectors that a cell should have; groups of fewer aren't cut
BLOCK = 2048  # vectors of a block; a task compares two blocks, TILE rows at a time
TILE = 512
FILE = 16  # blocks of a file, at most
OUT = ["n_links", "component_id", "kept"]


def _usable(label: Column, v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return label.isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _units(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class _Cells:
    """What the driver knows of large groups: their pivots, and the first number and the count of each cell's blocks."""

    def __init__(self, vectors: DataFrame):
        """vectors: grp, v, copies included."""
        h = F.xxhash64("grp", "v")
        counts = vectors.groupBy("grp").agg(F.approx_count_distinct(h).alias("n"))
        counts = materialize(counts, "counts")
        large = {r["grp"]: r["n"] for r in counts.filter(F.col("n") > CELL).orderBy(F.desc("n"), "grp").collect()}
        self.small = counts.filter(F.col("n") <= CELL).agg(F.sum("n")).first()[0] or 0
        discard(counts)
        wanted, left = {}, PIVOTS
        for grp, n in list(large.items())[: PIVOTS // 2]:
            k = min(64, math.ceil(n / CELL), left)
            if k > 1:
                wanted[grp] = k
                left -= k
        self.pivots, sizes = {}, {(grp, 0): n for grp, n in large.items() if grp not in wanted}
        if wanted:
            slots = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
            own = vectors.filter(F.col("grp").isin(list(wanted)))
            chosen = own.groupBy("grp", F.pmod(h, slots[F.col("grp")]).alias("slot")).agg(F.min_by("v", h).alias("v")).orderBy("grp", "slot").collect()
            for grp in wanted:
                self.pivots[grp] = _units(np.array([r["v"] for r in chosen if r["grp"] == grp]))
            homes = own.withColumn("h", h).select("grp", "v", "h").mapInArrow(self._homes, "grp string, cell int, h long")
            sizes |= {(r["grp"], r["cell"]): r["n"] for r in homes.groupBy("grp", "cell").agg(F.approx_count_distinct("h").alias("n")).collect()}
            sizes = {(grp, q): 1 for grp, p in self.pivots.items() for q in range(len(p))} | sizes
        self.blocks, n = {}, 0
        for (grp, cell), size in sorted(sizes.items()):  # a group's blocks have numbers in a row, so they lie in few files
            self.blocks.setdefault(grp, []).append((n, -(-size // BLOCK)))
            n += -(-size // BLOCK)
        self.files = max(1, min(FILE, n // 32))  # blocks of a file
        self.parts = max(64, -(-self.small // 4096))  # of the small groups

    def crossed(self, grp: str) -> bool:
        return sum(n for _, n in self.blocks.get(grp, [])) > 1

    def home(self, grp: str, u: np.ndarray) -> np.ndarray:
        return (u @ self.pivots[grp].T).argmax(axis=1) if grp in self.pivots else np.zeros(len(u), np.int64)

    def within(self, grp: str, u: np.ndarray, cell: int, r: float, others=slice(None)) -> np.ndarray:
        """Which vectors of a cell are within r of the planes between its pivot and the others."""
        if grp not in self.pivots:
            return np.ones((len(u), 1), bool)
        p = self.pivots[grp]
        apart = np.sqrt(np.maximum(2 - 2 * (p[others] @ p[cell]), 0))
        return (u @ p[cell])[:, None] - u @ p[others].T <= r * apart + 1e-9

    def _homes(self, batches):
        for batch in batches:
            cell = np.zeros(len(batch), np.int32)
            for grp, at, x in _matrices(batch):
                cell[at] = self.home(grp, _units(x))
            yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array(cell), batch.column("h")], names=["grp", "cell", "h"])

    def dealt(self, batches):
        """Gives each vector its block, and the part of the blocks or small groups that a task packs; copies in a batch become one row."""
        for batch in batches:
            first, m, ids = _merged(batch.column("key"), np.ones(len(batch), np.int64), batch.column("id"))
            batch = batch.take(pa.array(first))
            key = _keys(batch.column("key"))
            block, part = np.full(len(batch), -1, np.int64), np.empty(len(batch), np.int64)
            for grp, at, x in _matrices(batch):
                if grp in self.blocks:
                    start, n = np.array(self.blocks[grp]).T[:, self.home(grp, _units(x))]
                    block[at] = start + (key[at, 1] % n.astype(np.uint64)).astype(np.int64)
                    part[at] = block[at] // self.files
                else:
                    part[at] = -1 - batch.column("spread")[int(at[0])].as_py() % self.parts
            v = batch.column("v")
            ends, flat = v.offsets.to_numpy(), v.flatten()
            x = flat.to_numpy(zero_copy_only=False)
            x = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(((ends - ends[0]) * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(block), batch.column("grp"), batch.column("key"), pa.array(m), ids, x], names=["part", "block", "grp", "key", "m", "id", "x"])


def _matrices(batch: pa.RecordBatch):
    """Each group of a batch, with its rows' places and their vectors."""
    codes = batch.column("grp").dictionary_encode()
    v = batch.column("v")
    ends, flat, code = v.offsets.to_numpy(), v.flatten().to_numpy(zero_copy_only=False), codes.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else []:
        start = ends[at] - ends[0]
        yield codes.dictionary[int(code[at[0]])].as_py(), at, flat[start[:, None] + np.arange(ends[at[0] + 1] - ends[at[0]])]


def _keys(key: pa.Array) -> np.ndarray:
    """Keys of 16 bytes as pairs of numbers; the first is a class's name."""
    return np.frombuffer(b"".join(key.to_pylist()), np.uint64).reshape(-1, 2)


def _merged(key: pa.Array, m: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each key: a row of it, its weight and its least id, if any."""
    _, first, own = np.unique(np.frombuffer(b"".join(key.to_pylist()), "S16"), return_index=True, return_inverse=True)
    weight = np.zeros(len(first), np.int64)
    np.add.at(weight, own, m)
    there = ids.is_valid().to_numpy(zero_copy_only=False)
    least, any_id = np.full(len(first), np.iinfo(np.int64).max), np.zeros(len(first), bool)
    np.minimum.at(least, own[there], ids.drop_null().to_numpy())
    any_id[own[there]] = True
    return first, weight, pa.array(least, mask=~any_id)


def _near(u: np.ndarray, w: np.ndarray, cosine: float):
    """Pairs (i, j) of near unit vectors, some rows of u at a time."""
    error = (u.shape[1] + 8) * 1.2e-7  # of single precision
    w32 = np.ascontiguousarray(w.T, np.float32)
    for k in range(0, len(u), TILE):
        s = u[k : k + TILE].astype(np.float32) @ w32
        i, j = np.nonzero(s >= cosine - error)
        if not len(i):
            continue
        near = np.ones(len(i), bool)
        close = np.flatnonzero(s[i, j] < cosine + error)
        for a in range(0, len(close), 1 << 14):
            c = close[a : a + (1 << 14)]
            near[c] = np.einsum("ij,ij->i", u[i[c] + k], w[j[c]]) >= cosine
        yield i[near] + k, j[near]


def _tie(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the parts of a and b, pairs of places: root leads each place to a lower one of its part, or is itself."""

    def top(x):
        while True:
            up = root[x]
            if (up == x).all():
                return x
            x = up

    start = a, b
    while len(a):
        a, b = top(a), top(b)
        apart = a != b
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, b, a)
    for x in start:
        root[x] = top(x)


def _packed(cells: _Cells, cosine: float, kind: type):
    """The blocks of a part as rows, with their own links; small groups of a part are one row, and have no links beyond."""
    r = math.sqrt(2 - 2 * cosine)

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        if not len(table):
            return pa.Table.from_pylist([], schema=PACKED)
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        first, weight, ids = _merged(column["key"], column["m"].to_numpy(), column["id"])
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        first, weight, ids = first[known], weight[known], ids.drop_null().to_numpy()
        key = _keys(column["key"].take(pa.array(first)))
        cls = key[:, 0].view(np.int64)
        block = column["block"].take(pa.array(first)).to_numpy()
        groups = column["grp"].take(pa.array(first)).dictionary_encode()
        x = column["x"].take(pa.array(first))
        order = np.lexsort((groups.indices.to_numpy(), block))
        named = np.stack([block, groups.indices.to_numpy()])[:, order]
        out, rest = [], []
        for at in np.split(order, np.flatnonzero((np.diff(named) != 0).any(axis=0)) + 1) if len(order) else []:
            raw = b"".join(x.take(pa.array(at)).to_pylist())
            u = _units(np.frombuffer(raw, kind).reshape(len(at), -1))
            links, root = np.zeros(len(at), np.int64), np.arange(len(at))
            for i, j in _near(u, u, cosine):
                i, j = i[i != j], j[i != j]
                np.add.at(links, i, weight[at][j])
                _tie(root, i, j)
            grp = groups.dictionary[int(groups.indices[int(at[0])].as_py())].as_py()
            row = [key[at].tobytes(), weight[at].tobytes(), ids[at].tobytes(), links.tobytes(), cls[at][root].tobytes()]
            if cells.crossed(grp):
                cell = next(q for q, (n, k) in enumerate(cells.blocks[grp]) if n <= block[at[0]] < n + k)
                out.append([int(block[at[0]]), grp, cell, cells.within(grp, u, cell, r).any(axis=0).tolist(), *row, raw])
            else:
                rest.append(row)
        if rest:
            out.append([-1, None, None, None, *[b"".join(c) for c in zip(*rest)], None])
        return pa.Table.from_arrays([pa.array([o[c] for o in out], PACKED[c].type) for c in range(len(PACKED))], schema=PACKED)

    return pack


PACKED = pa.schema([("block", pa.int64()), ("grp", pa.string()), ("cell", pa.int32()), ("open", pa.list_(pa.bool_())), *[(c, pa.binary()) for c in ("keys", "m", "ids", "links", "roots", "x")]])


def _nodes(batches):
    """The vectors of blocks, with the links inside their block."""
    for batch in batches:
        for row in batch.to_pylist():
            key, m, ids, links, root = (row[c] for c in ("keys", "m", "ids", "links", "roots"))
            n = len(m) // 8
            keys = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.py_buffer(key)])
            cls = np.frombuffer(key, np.int64)[::2]
            yield pa.RecordBatch.from_arrays([keys, pa.array(cls), *[pa.array(np.frombuffer(c, np.int64)) for c in (m, ids, links, root)]], names=["_key", "cls", "m", "id", "links", "root"])


def _crossed(cells: _Cells, cosine: float, kind: type):
    """The links between pairs of blocks, counted and tied over all pairs that the task gets."""
    r = math.sqrt(2 - 2 * cosine)

    def cross(batches):
        start: dict[int, int] = {}  # block -> place of its first vector
        cls, links, root, last = [np.zeros(0, np.int64)] * 3 + [(None, None)]
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k].as_py() for c in ("grp", "a_block", "a_cell", "b_block", "b_cell")}
                ends = []
                for s, o in ("ab", "ba"):
                    block = row[f"{s}_block"]
                    if s == "a" and last[0] == block:
                        u = last[1]
                    else:
                        m = len(batch.column(f"{s}_m")[k].as_buffer()) // 8
                        u = _units(np.frombuffer(batch.column(f"{s}_x")[k].as_buffer(), kind).reshape(m, -1))
                    last = (block, u) if s == "a" else last
                    at = np.arange(len(u))
                    if row["a_cell"] != row["b_cell"]:
                        at = np.flatnonzero(cells.within(row["grp"], u, row[f"{s}_cell"], r, [row[f"{o}_cell"]])[:, 0])
                    ends.append((block, at, u[at]))
                (a, i_at, u), (b, j_at, w) = ends
                for i, j in _near(u, w, cosine):
                    for block, s in ((a, "a"), (b, "b")):
                        if block not in start:
                            start[block] = len(cls)
                            own = np.frombuffer(batch.column(f"{s}_keys")[k].as_buffer(), np.int64)[::2]
                            root = np.append(root, np.arange(len(own)) + len(cls))
                            cls, links = np.append(cls, own), np.append(links, np.zeros(len(own), np.int64))
                    m, n = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in ("a_m", "b_m"))
                    i, j = i_at[i], j_at[j]
                    np.add.at(links, start[a] + i, n[j])
                    np.add.at(links, start[b] + j, m[i])
                    _tie(root, start[a] + i, start[b] + j)
        while len(root) and (root[root] != root).any():
            root = root[root]
        for at in np.array_split(np.flatnonzero(links), -(-np.count_nonzero(links) // 10_000) or 1):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cls[at], links[at], cls[root[at]])], names=["cls", "links", "root"])

    return cross


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vectors with n_links, component_id and kept.

    Only vectors of equal, not null labels and equal length link. Vectors that are null, empty, all zero or hold null
    or non-finite components link with nothing, nor do those of a null label: 0 links, a component of their own.
    Repeated rows are vectors that link with each other; rows of one id with different vectors are each their own, and only link
    if they are near. Input columns named like an output are replaced, all others
    kept; an empty table gives an empty table.
    """
    rows = without(vectors, [*OUT, "_key", "_cls"])
    single = rows.schema[vector].dataType.elementType == T.FloatType()
    kind, v = np.float32 if single else np.float64, F.col(f"`{vector}`").cast("array<double>")
    usable = _usable(F.col(f"`{label}`"), v)
    text = F.concat_ws(",", v.cast("array<string>"))
    rows = rows.withColumn("_key", F.when(usable, F.unhex(F.md5(F.concat_ws("|", F.col(f"`{label}`").cast("string"), text)))))
    group = F.concat_ws("|", F.size(v).cast("string"), F.col(f"`{label}`").cast("string")).alias("grp")
    raw = F.col(f"`{vector}`") if single else v
    cells = _Cells(rows.filter(usable).select(group, raw.alias("v")))
    some = rows.filter(usable).select(group, F.col("_key").alias("key"), F.col(f"`{id_col}`").cast("long").alias("id"), raw.alias("v")).withColumn("spread", F.xxhash64("grp"))
    dealt = some.mapInArrow(cells.dealt, "part long, block long, grp string, key binary, m long, id long, x binary")
    packed = dealt.groupBy("part").applyInArrow(_packed(cells, cosine, kind), "block long, grp string, cell int, open array<boolean>, keys binary, m binary, ids binary, links binary, roots binary, x binary")
    packed = materialize(packed, "blocks", per_file=FILE)
    nodes = materialize(packed.select("keys", "m", "ids", "links", "roots").mapInArrow(_nodes, "_key binary, cls long, m long, id long, links long, root long"), "nodes")
    found = nodes.filter("links > 0").select("cls", "links", "root")
    if any(map(cells.crossed, cells.blocks)):
        side = lambda s: packed.filter("x is not null").select("grp", *[F.col(c).alias(f"{s}_{c}") for c in ("block", "cell", "open", "keys", "m", "x")])
        once = (F.col("a_block") < F.col("b_block")) == ((F.col("a_block") + F.col("b_block")) % 2 == 0)  # either order, so that tasks are alike
        meet = F.get("a_open", F.col("b_cell")) & F.get("b_open", F.col("a_cell"))
        a, b = side("a"), side("b").withColumnRenamed("grp", "b_grp")
        pairs = a.join(b.hint("shuffle_replicate_nl"), (F.col("grp") == F.col("b_grp")) & (F.col("a_block") != F.col("b_block")) & once & meet)
        pairs = pairs.select("grp", *[f"{s}_{c}" for s in "ab" for c in ("block", "cell", "keys", "m", "x")])
        crossed = materialize(pairs.mapInArrow(_crossed(cells, cosine, kind), "cls long, links long, root long"), "links")
        found = found.unionByName(crossed)
    discard(packed)
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    parts = components(found.filter("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    known = nodes.select("_key", "cls", "m", "id").join(links, "cls", "left").join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    known = materialize(known.select("_key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component", "id"), "known")
    least = known.groupBy("component").agg(F.min("id").alias("component_id"))
    known = known.join(least, "component").select("_key", "n_links", "component_id")
    own = F.col(f"`{id_col}`").cast("long")
    out = rows.join(known, "_key", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))).withColumn("component_id", F.coalesce("component_id", own))
    return out.withColumn("kept", own.eqNullSafe(F.col("component_id"))).drop("_key")
