"""Vectors: similarity, top-k, centroids, merges, best match, clustering."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """-1 for vectors of different length, 0 where a norm vanishes."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), -1.0).when(n < 1e-12, 0.0).otherwise(F.try_divide(dot(a, b), n))


def normalise(v: Column, floor: float = 1e-12) -> Column:
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(floor)))


def knn(vectors: DataFrame, query: list[float], k: int, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The k nearest by Euclidean distance among the given (already filtered) vectors of the query's length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.sqrt(F.aggregate(F.zip_with(doubles(F.col(vector)), q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return vectors.filter(F.size(vector) == len(query)).withColumn("distance", d).orderBy("distance", id_col).limit(k)


def centroids(vectors: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The normalised mean vector of each key, and how many vectors it has."""
    at = vectors.select(*keys, F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
    means = at.groupBy(*keys, "pos").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    rows = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s"), F.max("n").alias("n"))
    return rows.select(*keys, "n", normalise(F.transform("s", lambda x: x["m"])).alias("centroid"))


def weighted_merge(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """Count-weighted mean of two vectors, normalised; of different lengths, the first."""
    total = na + nb
    mean = F.zip_with(a, b, lambda x, y: F.coalesce(F.try_divide(x * na + y * nb, total), x))
    return F.when(F.size(a) != F.size(b), a).otherwise(normalise(mean))


def blend(old: Column, count: Column, new: Column) -> Column:
    """One step of the running voiceprint: weight min(count, 20) for the old vector; lengths that differ replace it."""
    n = F.least(count, F.lit(20)).cast("double")
    mean = F.zip_with(old, new, lambda x, y: x * (n / (n + 1)) + y / (n + 1))
    return F.when((F.size(old) != F.size(new)) | (F.size(old) == 0), new).otherwise(normalise(mean))


def cosine_shorter(a: Column, b: Column) -> Column:
    """Cosine over the length of the shorter one; 0 where a norm vanishes."""
    n = F.least(F.size(a), F.size(b))
    return cosine(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


BLOCK = 4096  # vectors of a block, at most; a library of no more is one block
PIVOTS = 1024  # of a library's vectors of one length
SLACK = 1e-6  # of angles, far above their rounding


def _scores(q: np.ndarray, lib: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(lib, axis=1)[None, :]
    return np.where(norms < 1e-12, 0.0, (q @ lib.T) / np.where(norms < 1e-12, 1.0, norms))


def _angles(vectors: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Angles to unit vectors; a zero vector is at a right angle to all."""
    return np.arccos(np.clip(vectors @ units.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300), -1, 1))


def _spread(vectors: list, dim: int, most: int) -> np.ndarray:
    """Unit vectors of a sample that lie far apart: each is the one farthest from those before it, as long as there are others."""
    if not vectors:
        return np.eye(1, dim)
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(most, len(x)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def best_match(queries: DataFrame, library: DataFrame, threshold: float) -> DataFrame:
    """For each query (qid, qvec) the most similar library vector (lid, lvec) by cosine, the first of equal ones, whether it
    reaches the threshold, and the number of library blocks that the query was compared with. Only vectors of the query's length and
    a similarity above -1 count; queries without any, null ones among them, have no lid, no score, and don't match.

    The library's vectors lie in cells around pivots (of each length, the square root of their number, PIVOTS at most). Angles obey the
    triangle inequality, so no vector of a cell is nearer to a query than its pivot's angle less the cell's radius. A query meets
    the cell whose pivot is nearest first; of the others, it meets those alone that may hold a vector as near as the best it has
    found. What it meets of a cell are blocks of BLOCK vectors, by one product of matrices a task. A library of no more than
    BLOCK vectors is sent to the tasks instead.
    """
    spark = queries.sparkSession
    q = queries.filter("qvec is not null").select("qid", doubles(F.col("qvec")).alias("qvec")).withColumn("dim", F.size("qvec"))
    lib = library.filter("lvec is not null").select("lid", doubles(F.col("lvec")).alias("lvec")).withColumn("dim", F.size("lvec"))
    sizes = {r["dim"]: r["count"] for r in lib.filter("dim > 0").groupBy("dim").count().collect()}  # one row a length of vector
    if sum(sizes.values()) <= BLOCK:
        return _answers(queries, _small(q, lib), threshold)
    chance = F.pmod(F.xxhash64("lid", F.lit(7)), F.lit(1 << 30))
    picked = F.lit(False)
    for dim, n in sizes.items():
        picked = picked | (F.col("dim") == dim) & (chance < int((1 << 30) * min(1.0, 4 * min(PIVOTS, math.isqrt(n) + 1) / n)))
    rows = lib.filter(picked & (norm(F.col("lvec")) >= 1e-12)).select("dim", "lvec").limit(8 * PIVOTS * max(1, len(sizes))).collect()  # bounded
    units = {dim: _spread([r["lvec"] for r in rows if r["dim"] == dim], dim, min(PIVOTS, math.isqrt(n) + 1)) for dim, n in sizes.items()}

    def cells(batches):
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                if dim:
                    angles = _angles(np.vstack(own["lvec"].tolist()), units[dim])
                    cell = angles.argmin(axis=1)
                    yield own.assign(cell=cell.astype(np.int32), angle=angles[np.arange(len(cell)), cell])

    held = written(lib.filter("dim > 0").mapInPandas(cells, "lid long, lvec array<double>, dim int, cell int, angle double"), "cells")
    bounds = {(r["dim"], r["cell"]): (r["radius"], -(-r["n"] // BLOCK)) for r in held.groupBy("dim", "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}  # PIVOTS a length
    radii = {dim: np.array([bounds.get((dim, k), (-1.0, 0))[0] for k in range(len(u))]) for dim, u in units.items()}
    parts = {dim: np.array([bounds.get((dim, k), (-1.0, 0))[1] for k in range(len(u))]) for dim, u in units.items()}

    def bounded(own: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """The cell of the nearest pivot, and the least angle at which each cell may hold a vector, for each query; empty cells hold none."""
        angles = np.where(radii[dim] < 0, np.inf, _angles(np.vstack(own["qvec"].tolist()), units[dim]))
        return angles.argmin(axis=1), angles - radii[dim]

    def meeting(own: pd.DataFrame, at: np.ndarray, cell: np.ndarray, dim: int) -> pd.DataFrame:
        """A row for each query (by place) and block of a cell."""
        n = parts[dim][cell]
        out = own.iloc[np.repeat(at, n)][["qid", "qvec", "dim"]]
        return out.assign(cell=np.repeat(cell, n).astype(np.int32), part=(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32))

    def nearest(batches):
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                if dim in units:
                    yield meeting(own, np.arange(len(own)), bounded(own, dim)[0], dim)

    def others(batches):
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                first, low = bounded(own, dim)
                low[np.arange(len(own)), first] = np.inf  # met already
                limit = np.arccos(np.clip(own["score"].to_numpy(float), -1, 1)) + SLACK
                at, cell = np.nonzero(low <= limit[:, None])
                if len(at):
                    yield meeting(own, at, cell, dim)

    shape = "qid long, qvec array<double>, dim int, cell int, part int"
    by_part = held.withColumn("part", F.lit(0))
    if any(n > 1 for _, n in bounds.values()):
        numbers = spark.createDataFrame([(*k, n) for k, (_, n) in bounds.items()], "dim int, cell int, n int")
        by_part = held.join(numbers, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("lid"), F.col("n")).cast("int"))

    def met(wanted: DataFrame) -> DataFrame:
        """The best of each block that a query meets. Blocks meet at most so many queries at once; a cell that all queries meet is many groups."""
        share = max(1, -(-wanted.count() // (BLOCK * max(1, sum(n for _, n in bounds.values())))))
        left = wanted.withColumn("share", F.pmod(F.xxhash64("qid"), F.lit(share)).cast("int"))
        right = by_part.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(share - 1)))).select("lid", "lvec", "dim", "cell", "part", "share")
        keys = ["dim", "cell", "part", "share"]

        def scored(own: pd.DataFrame, lib: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(lib):
                return pd.DataFrame({"qid": pd.Series(dtype="int64"), "lid": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
            lib = lib.sort_values("lid")
            vectors, found = np.vstack(lib["lvec"].tolist()), []
            for k in range(0, len(own), BLOCK):
                s = _scores(np.vstack(own["qvec"].iloc[k : k + BLOCK].tolist()), vectors)
                best = s.argmax(axis=1)
                found.append(pd.DataFrame({"qid": own["qid"].iloc[k : k + BLOCK].to_numpy(), "lid": lib["lid"].to_numpy()[best], "score": s[np.arange(len(best)), best]}))
            return pd.concat(found)

        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scored, "qid long, lid long, score double")

    first = written(met(q.mapInPandas(nearest, shape)), "first-cells")
    if any(len(u) > 1 for u in units.values()):
        so_far = first.groupBy("qid").agg(F.max("score").alias("score"))
        more = written(q.join(so_far, "qid").mapInPandas(others, shape), "other-cells")
        first = first.unionByName(met(more))
    return _answers(queries, first, threshold)


def _small(q: DataFrame, lib: DataFrame) -> DataFrame:
    """The best of a library of BLOCK vectors at most, which is sent to the tasks whole, in order: (qid, lid, score)."""
    held: dict[int, tuple[list[int], list]] = {}
    for r in sorted(lib.collect()):
        ids, rows = held.setdefault(r["dim"], ([], []))
        ids.append(r["lid"])
        rows.append(r["lvec"])
    shared = q.sparkSession.sparkContext.broadcast({dim: (np.array(ids), np.array(rows, float)) for dim, (ids, rows) in held.items() if dim})

    def scored(batches):
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                if dim in shared.value:
                    ids, rows = shared.value[dim]
                    for k in range(0, len(own), BLOCK):
                        s = _scores(np.vstack(own["qvec"].iloc[k : k + BLOCK].tolist()), rows)
                        best = s.argmax(axis=1)
                        yield pd.DataFrame({"qid": own["qid"].iloc[k : k + BLOCK], "lid": ids[best], "score": s[np.arange(len(best)), best]})

    return q.mapInPandas(scored, "qid long, lid long, score double")


def _answers(queries: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    best = found.groupBy("qid").agg(F.max_by(F.struct("lid", "score"), F.when(F.col("score") > -1, F.struct("score", -F.col("lid")))).alias("b"), F.count(F.lit(1)).alias("blocks"))
    out = queries.select("qid").join(best, "qid", "left")
    return out.select("qid", "b.lid", "b.score", F.coalesce(F.col("b.score") >= threshold, F.lit(False)).alias("matched"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


def ordinals(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows numbered from 0 in order (which tells them apart), without one task for all: numbers within sorted ranges, after the sizes
    of the ranges before."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "ordinals")
    span = F.shiftright("_id", 33)
    sizes = held.groupBy(span.alias("_span")).count()  # one row a range
    before = sizes.select("_span", F.coalesce(F.sum("count").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("_span", span).join(before, "_span").withColumn(name, place).drop("_id", "_span", "_before")


def greedy_clusters(vectors: list[np.ndarray], threshold: float) -> list[int]:
    """Leader clustering in order: a vector joins the most similar centroid that reaches the threshold, else founds one."""
    groups: list[list[np.ndarray]] = []
    centres: list[np.ndarray] = []
    out = []
    for v in vectors:
        u = v / max(float(np.linalg.norm(v)), 1e-12)
        best, score = -1, -1.0
        for k, c in enumerate(centres):
            s = float(u @ c)
            if s > score:
                best, score = k, s
        if best >= 0 and score >= threshold:
            groups[best].append(v)
        else:
            best = len(groups)
            groups.append([v])
            centres.append(u)
        mean = np.mean(groups[best], axis=0)
        centres[best] = mean / max(float(np.linalg.norm(mean)), 1e-12)
        out.append(best)
    return out


def cluster_within(rows: DataFrame, key: str, id_col: str, vector: str, threshold: float) -> DataFrame:
    """Greedy clusters of each key's vectors (one meeting's, so bounded) in id order."""
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {id_col} {rows.schema[id_col].dataType.simpleString()}, cluster long"

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        return pd.DataFrame({key: pdf[key], id_col: pdf[id_col], "cluster": greedy_clusters([np.asarray(v, float) for v in pdf[vector]], threshold)})

    return rows.select(key, id_col, vector).groupBy(key).applyInPandas(step, schema)


def spectral_labels(vectors: list, clusters: int | None = None, most: int = 20, seed: int = 42) -> dict[int, int]:
    """Spectral clusters of one meeting's vectors: clipped cosine affinity, k by the largest eigengap (or given), k-means
    with fixed seeding, labels by first appearance. Missing vectors get no label."""
    at = [i for i, v in enumerate(vectors) if v is not None]
    if len(at) <= 1:
        return {i: 0 for i in at}
    x = np.array([vectors[i] for i in at], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    a = np.clip(x @ x.T, 0, 1)
    np.fill_diagonal(a, 1.0)  # of zero vectors, too
    d = a.sum(axis=1)
    lap = np.eye(len(a)) - a / np.sqrt(np.outer(d, d))
    values, basis = np.linalg.eigh(lap)
    gaps = np.diff(values[: min(most + 1, len(at) - 1)][1:])
    k = clusters if clusters and 2 <= clusters <= most else min(max(2, int(np.argmax(gaps)) + 2), most) if len(gaps) else 2
    k = min(k, len(at))
    e = basis[:, : min(k, len(at))]
    e = e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    c = [e[0]]
    while len(c) < k:
        gap = np.min([((e - q) ** 2).sum(axis=1) for q in c], axis=0)
        c.append(e[int(gap.argmax())] if gap.max() > 1e-12 else e[rng.integers(len(e))])
    centre, label = np.array(c), None
    for _ in range(100):
        new = ((e[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        if label is not None and (new == label).all():
            break
        label = new
        centre = np.array([e[label == j].mean(axis=0) if (label == j).any() else centre[j] for j in range(k)])
    names: dict[int, int] = {}
    return {i: names.setdefault(int(v), len(names)) for i, v in zip(at, label)}


LANDMARKS = 1024  # vectors of a recording whose affinities one task holds


def spectral_speakers(rows: DataFrame, keys: list[str], id_col: str, vector: str, clusters: int | None = None, landmarks: int = LANDMARKS) -> DataFrame:
    """(keys, id, speaker): spectral clusters of each meeting's vectors, named by first appearance in id order; null vectors get no speaker.

    Of a meeting with more than `landmarks` vectors, about so many, chosen by a hash of their ids, are clustered; the others, in blocks over
    many tasks, take the cluster of the most similar one. So no task holds the affinities of all parts of a long recording.
    """
    names = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*keys, id_col]]
    fields = ", ".join("`{}` {}".format(*n.split(" ", 1)) for n in names)
    given = rows.select(*keys, id_col, doubles(F.col(vector)).alias("_v"))
    sizes = given.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("_v").alias("_size"))
    held = given.join(sizes, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    stride = F.ceil(F.col("_size") / landmarks)
    chosen = F.col("_v").isNull() | (stride <= 1) | (F.pmod(F.xxhash64(id_col, F.lit(11)), stride) == 0)
    held = written(held.select(*keys, id_col, "_v", stride.alias("_stride"), chosen.alias("_chosen")), "parts")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, kind="stable").reset_index(drop=True)
        got = spectral_labels([None if v is None else np.asarray(v, float) for v in pdf["_v"]], clusters)
        return pdf[[*keys, id_col]].assign(label=[got.get(i) for i in range(len(pdf))]).astype({"label": "Int64"})

    some = written(held.filter("_chosen").groupBy(*keys).applyInPandas(cluster, fields + ", label long"), "landmarks")
    rest, labels = held.filter(~F.col("_chosen")), some
    if not rest.isEmpty():
        blocks = rest.withColumn("_b", F.pmod(F.xxhash64(id_col, F.lit(12)), F.col("_stride")))
        marks = held.filter("_chosen and _stride > 1 and _v is not null").join(some.filter("label is not null").select(*[F.col(c).alias(f"_{c}") for c in [*keys, id_col]], "label"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*keys, id_col]]).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_stride") - 1)))
        marks = marks.select(*[F.col(k).alias(f"m_{k}") for k in keys], F.col(id_col).alias("m_id"), F.col("_v").alias("m_v"), F.col("_b").alias("m_b"), F.col("label").alias("m_label"))

        def nearest(own: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(marks):
                return own[[*keys, id_col]].iloc[:0].assign(label=pd.Series(dtype="Int64"))
            marks = marks.sort_values("m_id")
            at = _scores(np.vstack(own["_v"].tolist()), np.vstack(marks["m_v"].tolist())).argmax(axis=1)
            return own[[*keys, id_col]].assign(label=marks["m_label"].to_numpy()[at]).astype({"label": "Int64"})

        labels = some.unionByName(blocks.groupBy(*keys, "_b").cogroup(marks.groupBy(*[f"m_{k}" for k in keys], "m_b")).applyInPandas(nearest, fields + ", label long"))
    first = labels.filter("label is not null").groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("label").alias("_label")).agg(F.min(id_col).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_first"))  # of a meeting's few clusters
    named = first.withColumn("speaker", F.concat(F.lit("Speaker "), place.cast("string")))
    on = [F.col("label") == F.col("_label"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]]
    return labels.join(named, on, "left").select(*keys, id_col, "speaker")


def match_or_enrol(queries: DataFrame, library: DataFrame, threshold: float, batch: str = "batch") -> DataFrame:
    """Voiceprints of segments (batch, qid, qvec) -> (batch, qid, lid, name, fresh).

    Entries of the library (lid, name, lvec, n) with samples and the length of the queries can match; others are spare. A query
    takes its best match at the threshold; the rest of a batch (one recording) is clustered greedily in order. Clusters are numbered over
    all batches in order, and each takes the spare entry of its number, then a new name, numbered after those of the library that
    begin alike: no entry and no name goes to two clusters. Batches match the same library; what they learn is learned_voiceprints().
    """
    size = F.size("lvec")
    dims = queries.filter("qvec is not null").agg(F.min_by(F.size("qvec"), F.struct(batch, "qid")).alias("dim"))
    dim = dims.first()["dim"]
    usable = (F.col("n") > 0) & F.col("lvec").isNotNull() & (size > 0) & F.coalesce(size == F.lit(dim).cast("int"), F.lit(False))
    best = best_match(queries.select("qid", "qvec"), library.filter(usable).select("lid", "lvec"), threshold)
    spare = ordinals(library.filter(~usable).select("lid", "name"), ["lid"], "_k")  # entries never learned, or of another length
    known = library.agg(F.count(F.when(F.startswith("name", F.lit(UNKNOWN)), 1)).alias("known"), F.count(F.when(~usable, 1)).alias("spare")).first()
    matched = best.filter("matched").select("qid", "lid").join(library.select("lid", "name"), "lid")
    first = queries.select(batch, "qid").join(matched, "qid").select(batch, "qid", "lid", "name", F.lit(False).alias("fresh"))
    left = queries.filter("qvec is not null").join(matched.select("qid"), "qid", "left_anti").select(batch, "qid", "qvec")
    grouped = written(cluster_within(left, batch, "qid", "qvec", threshold), "clusters")
    numbered = ordinals(grouped.select(batch, "cluster").distinct(), [batch, "cluster"], "_k").join(spare, "_k", "left")
    new = F.concat(F.lit(UNKNOWN + " "), (F.col("_k") + (known["known"] - known["spare"] + 1)).cast("string"))
    named = numbered.select(F.col(batch).alias("_b"), F.col("cluster").alias("_c"), "lid", F.coalesce("name", new).alias("name"), F.col("lid").isNull().alias("fresh"))
    rest = grouped.join(named, F.col(batch).eqNullSafe(F.col("_b")) & (F.col("cluster") == F.col("_c"))).select(batch, "qid", "lid", "name", "fresh")
    return first.unionByName(rest)


UNKNOWN = "未知说话人"


def learned_voiceprints(assigned: DataFrame, queries: DataFrame, library: DataFrame) -> DataFrame:
    """The library after its entries have learned from the segments assigned to them: (lid, lvec, n), blended with the normalised
    mean of the new vectors, n one more, 100 at most; entries without samples or of another length are replaced."""
    given = assigned.filter("lid is not null").join(queries.select("qid", "qvec"), "qid")
    mean = centroids(given, ["lid"], "qvec").select("lid", "centroid", F.col("n").alias("_new"))
    rows = library.join(mean, "lid", "left")
    fits = (F.col("n") > 0) & (F.size("lvec") == F.size("centroid"))
    after = F.when(fits, blend(doubles(F.col("lvec")), F.col("n"), F.col("centroid"))).otherwise(F.col("centroid"))
    count = F.least(F.when(fits, F.col("n")).otherwise(F.col("_new")) + 1, F.lit(100))
    return rows.select("lid", F.when(F.col("centroid").isNull(), doubles(F.col("lvec"))).otherwise(after).alias("lvec"), F.when(F.col("centroid").isNull(), F.col("n")).otherwise(count).alias("n"))
