"""MinHash near-dedup by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

Texts are lower-cased and split at white space; shingles are five words (all words, if fewer). A shingle weighs its
count in the text times its idf, 1 + ln(N / max(df, FLOOR)): df is the exact number of texts that have it, N that of
texts with a word, FLOOR the number of all texts' distinct shingles over HEAVY. Only shingles above FLOOR need a table,
and no more than HEAVY of them can exist, whatever the corpus; those below share one weight. They are found in two
passes: counts of hash buckets show which buckets may hold one, then the shingles of these buckets are counted exactly.

Each text gets BANDS * ROWS samples; a sample is the shingle (and its quantised weight) of the least ICWS value, so two
texts agree in a sample with a probability of their weighted Jaccard similarity. Texts that agree in all samples of a
band are candidates: all pairs in buckets of up to SMALL texts, and in larger ones each text with the bucket's leaders (a
least text by a hash of each of LEADERS slots). Agreement over all samples sorts out chance candidates, the best candidate of
each text is verified first, then all that join two components, by the exact weighted Jaccard similarity.

Leaders are no cap: what a large bucket holds outside its main component, its strays, is compared with all texts of the
bucket in other components, block by block within a task. A pair stays if its samples agree often enough and if an upper
bound of its similarity (weights added up in BINS bins by hash; the overlap is at most the sum of the lesser ones) reaches
SIMILAR. Again each stray's best partner is verified first, then every pair still between two components.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, materialize, semi_join, text_of, without
from .components import components
from .hashing import mixed, shingle_hashes, slices
from .worker import owned

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 5
HEAVY = 1 << 16  # shingles with an idf of their own, at most
BUCKETS = 1 << 18
PIECE = 512  # shingles sampled at a time, so that the arrays stay in the cache
SMALL = 16
LEADERS = 2
BLOCK = 1024  # texts of a large bucket that are compared with as many in one task
BINS = 512
LIKELY = 0.6  # share of agreeing samples below which a pair of similarity 0.8 has a chance of about 1e-5
PAIRS = 64  # pairs verified at a time
OUT = ["class_id", "component_id", "n_shingles", "kept"]


def sliced(batches, *columns: str):
    """Rows of Arrow batches, some at a time: the columns, the last of which, the text's, as lower-case bytes."""
    owned("minhash", dict)
    for batch in batches:
        for k, raw in slices(batch.column(columns[-1])):
            yield *(batch.column(c).slice(k, len(raw)) for c in columns[:-1]), raw


class Idf:
    """The idf of shingles: of those in more than `floor` texts by table, of all others the same."""

    def __init__(self, n: int, floor: float, shingles: np.ndarray, df: np.ndarray):
        order = np.argsort(shingles)
        self.shingles = np.append(shingles[order], np.uint64(2**64 - 1))
        self.idf = np.append(np.maximum(1 + np.log(max(n, 1) / np.maximum(df[order], 1)), 1), 0.0)
        self.rare = max(1 + np.log(max(n, 1) / max(floor, 1)), 1.0)
        self.low = np.zeros(1 << 16, bool)  # most shingles aren't in the table, as their low bits show
        self.low[(self.shingles[:-1] & np.uint64(0xFFFF)).astype(np.int64)] = True

    def weights(self, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.full(len(s), self.rare)
        some = np.flatnonzero(self.low[(s & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.shingles, s[some])
        hit = (self.shingles[at] == s[some]) & (at < len(self.shingles) - 1)
        out[some[hit]] = self.idf[at[hit]]
        return n * out


@cache
def draws() -> tuple[np.ndarray, ...]:
    """Gamma(2, 1) draws r, their partners ln c for 16 hash bits each, and a seed for each sample."""
    u = [(mixed(mixed(np.arange(1, 65537, dtype=np.uint64) + np.uint64(k << 40))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54 for k in range(4)]
    seeds = mixed(mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return (-np.log(u[0] * u[1])).astype(np.float32), np.log(-np.log(u[2] * u[3])).astype(np.float32), seeds


@cache
def scratch() -> tuple[np.ndarray, ...]:
    """Arrays for the samples of PIECE shingles: new ones for each step would cost more than the arithmetic."""
    size = BANDS * ROWS * PIECE
    return *(np.empty(size, np.uint64) for _ in range(2)), *(np.empty(size, np.float32) for _ in range(4))


def sample(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The BANDS * ROWS samples of a weighted set, as 64-bit numbers."""
    r_of, c_of, seeds = draws()
    best, value = np.zeros(len(seeds), np.uint64), np.full(len(seeds), np.inf, np.float32)
    logs, at = np.log(w).astype(np.float32), np.arange(len(seeds))
    for a in range(0, len(s), PIECE):
        part = s[a : a + PIECE]
        x, bits, beta, r, ln, t = (b[: len(seeds) * len(part)].reshape(len(seeds), -1) for b in scratch())
        np.add(part, seeds[:, None], out=x)
        x ^= np.right_shift(x, np.uint64(32), out=bits)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= np.right_shift(x, np.uint64(29), out=bits)
        np.right_shift(x, np.uint64(32), out=bits)
        np.copyto(beta, bits.view(np.int64), casting="unsafe")  # signed numbers convert faster
        beta *= np.float32(2.0**-32)
        np.right_shift(x, np.uint64(16), out=bits)
        bits &= np.uint64(0xFFFF)
        c_of.take(bits.view(np.int64), out=ln, mode="wrap")  # with no mode given, take() copies its output
        x &= np.uint64(0xFFFF)
        r_of.take(x.view(np.int64), out=r, mode="wrap")
        np.divide(np.float32(1), r, out=t)
        t *= logs[a : a + PIECE]
        t += beta
        np.floor(t, out=t)
        beta -= t
        beta -= 1
        r *= beta
        ln += r
        k = ln.argmin(axis=1)
        low = ln[at, k]
        less = low < value
        best[less] = mixed(part[k] + t[at, k].astype(np.int64).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))[less]
        value = np.minimum(low, value)
    return best


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard: sum of least over sum of greatest weights."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum()
    return float(both / (wa.sum() + wb.sum() - both))


def bins(s: np.ndarray, w: np.ndarray) -> bytes:
    """The weights in each bin, as half-precision numbers that are never too small (beyond their range: infinite)."""
    with np.errstate(over="ignore"):
        return (np.bincount((s >> np.uint64(55)).astype(np.int64), weights=w, minlength=BINS) * 1.001).astype(np.float16).tobytes()


def inverse_frequencies(texts: DataFrame) -> Idf:
    """Exact document frequencies of all shingles in more than FLOOR texts."""

    def bucket(s: np.ndarray) -> np.ndarray:
        return ((s >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)

    def count(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for (raw,) in sliced(batches, "t"):
            s, _, cut = shingle_hashes(raw, WORDS)
            n += int((np.diff(cut) > 0).sum())
            total += np.bincount(bucket(s), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])

    counts = materialize(texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "df")
    n, all_of = counts.agg(F.sum(F.when(F.col("bucket") < 0, F.col("n"))), F.sum(F.when(F.col("bucket") >= 0, F.col("n")))).first()
    floor = max(1.0, (all_of or 0) / HEAVY)
    flagged = np.zeros(BUCKETS, bool)
    flagged[[r["bucket"] for r in counts.filter((F.col("bucket") >= 0) & (F.col("n") > floor)).select("bucket").collect()]] = True  # BUCKETS at most
    discard(counts)

    def exact(batches):
        held = []
        for (raw,) in sliced(batches, "t"):
            s, _, _ = shingle_hashes(raw, WORDS)
            held.append(s[flagged[bucket(s)]])
            if sum(map(len, held)) > 500_000:
                yield table(np.concatenate(held))
                held = []
        yield table(np.concatenate([np.zeros(0, np.uint64), *held]))

    def table(s: np.ndarray) -> pa.RecordBatch:
        s, n = np.unique(s, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n)], names=["s", "n"])

    heavy = texts.mapInArrow(exact, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") > floor).collect()  # HEAVY at most
    return Idf(n or 0, floor, np.array([r["s"] for r in heavy], np.int64).view(np.uint64), np.array([r["n"] for r in heavy], np.float64))


def _signatures(shared):
    def signatures(batches):
        idf, odd = shared.value, np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for k1, k2, raw in sliced(batches, "k1", "k2", "t"):
            s, n, cut = shingle_hashes(raw, WORDS)
            w = idf.weights(s, n)
            got = [sample(s[a:b], w[a:b]) if b > a else None for a, b in zip(cut, cut[1:])]
            hashed = [None if g is None else mixed(mixed(g.reshape(BANDS, ROWS) * odd).sum(axis=1, dtype=np.uint64)).view(np.int64) for g in got]
            short = [None if g is None else (g & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for g in got]
            yield pa.RecordBatch.from_arrays([k1, k2, pa.array(np.diff(cut)), pa.array(hashed, pa.list_(pa.int64())), pa.array(short, pa.binary())], names=["k1", "k2", "n", "bands", "sig"])

    return signatures


A, B = ["a1", "a2"], ["b1", "b2"]


def _ends(pairs: DataFrame, table: DataFrame, cols: list[str]) -> DataFrame:
    """pairs with columns of both ends from a table by (k1, k2)."""
    for x, names in (("a", A), ("b", B)):
        pairs = pairs.join(table.select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1]), *[F.col(c).alias(f"{x}_{c}") for c in cols]), names)
    return pairs


def _likely(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    def agree(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS) for c in ("a_sig", "b_sig"))
            same = (a == b).mean(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in A + B), pa.array(same)], names=[*A, *B, "same"])

    return _ends(pairs, signatures, ["sig"]).mapInArrow(agree, "a1 long, a2 long, b1 long, b2 long, same double").filter(F.col("same") >= LIKELY)


def _verified(pairs: DataFrame, some: DataFrame, shared) -> DataFrame:
    """The pairs whose texts (of some: k1, k2, t) are similar. Texts travel, as they are shorter than their weighted sets."""

    def verify(batches):
        idf = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, PAIRS):
                part = batch.slice(k, PAIRS)
                raw = [t.lower().encode("utf-8", "surrogatepass") for c in ("a_t", "b_t") for t in part.column(c).to_pylist()]
                s, n, cut = shingle_hashes(raw, WORDS)
                w, m = idf.weights(s, n), part.num_rows
                sets = [(s[a:b], w[a:b]) for a, b in zip(cut, cut[1:])]
                keep = [similarity(*sets[i], *sets[m + i]) >= SIMILAR for i in range(m)]
                yield part.select([*A, *B]).filter(pa.array(keep, pa.bool_()))

    return _ends(pairs.select(*A, *B), some, ["t"]).mapInArrow(verify, "a1 long, a2 long, b1 long, b2 long")


def _best(pairs: DataFrame, *sides) -> DataFrame:
    """The partner of each text that its samples agree most with."""
    best = [pairs.groupBy(*x).agg(F.max_by(F.struct(*y), F.struct("same", *y)).alias("p")).select(*x, *[f"p.{c}" for c in y]) for x, y in sides]
    return (best[0].unionByName(best[1]) if len(best) > 1 else best[0]).distinct()


def _joined_up(links: DataFrame) -> DataFrame:
    """Links -> (k1, k2, c1, c2): each linked key's component."""
    ends = links.select(F.struct(*[F.col(x).alias(y) for x, y in zip(A, ("k1", "k2"))]).alias("a"), F.struct(*[F.col(x).alias(y) for x, y in zip(B, ("k1", "k2"))]).alias("b"))
    return components(ends).select("node.k1", "node.k2", F.col("component.k1").alias("c1"), F.col("component.k2").alias("c2"))


def _extended(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts after more links: only components that a link joins, and keys that had none, are looked at."""
    if links.isEmpty():
        return parts
    met = links
    for x, names in (("a", A), ("b", B)):
        own = F.struct(F.col(names[0]).alias("k1"), F.col(names[1]).alias("k2"))
        known = parts.select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1]), F.struct(F.col("c1").alias("k1"), F.col("c2").alias("k2")).alias(f"{x}_c"))
        met = met.join(known, names, "left").withColumn(f"{x}_new", F.col(f"{x}_c").isNull()).withColumn(f"{x}_c", F.coalesce(f"{x}_c", own))
    met = materialize(met, "met")
    moved = materialize(components(met.select(F.col("a_c").alias("a"), F.col("b_c").alias("b"))), "moved")
    moved = moved.select(F.col("node.k1").alias("c1"), F.col("node.k2").alias("c2"), F.col("component.k1").alias("d1"), F.col("component.k2").alias("d2"))
    fresh = [met.filter(f"{x}_new").select(F.col(n[0]).alias("k1"), F.col(n[1]).alias("k2")) for x, n in (("a", A), ("b", B))]
    fresh = fresh[0].unionByName(fresh[1]).distinct().select("k1", "k2", F.col("k1").alias("c1"), F.col("k2").alias("c2"))
    out = parts.unionByName(fresh).join(moved, ["c1", "c2"], "left")
    return materialize(out.select("k1", "k2", F.coalesce("d1", "c1").alias("c1"), F.coalesce("d2", "c2").alias("c2")), "parts")


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one component yet."""
    for x, names in (("a", A), ("b", B)):
        pairs = pairs.join(parts.select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1]), F.struct("c1", "c2").alias(f"{x}_c")), names, "left")
    return pairs.filter(~F.coalesce(F.col("a_c") == F.col("b_c"), F.lit(False))).select(*A, *B)


def _placed(large: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(band, h, k1, k2, c1, c2) of the large buckets with components, and of them the strays, outside the bucket's main component."""
    placed = large.join(parts, ["k1", "k2"], "left").withColumns({"c1": F.coalesce("c1", "k1"), "c2": F.coalesce("c2", "k2")})
    placed = materialize(placed.select("band", "h", "k1", "k2", "c1", "c2"), "placed")
    main = placed.groupBy("band", "h", "c1", "c2").count().groupBy("band", "h").agg(F.max_by(F.struct("c1", "c2"), F.struct("count", "c1", "c2")).alias("main"), F.sum("count").alias("size"))
    strays = placed.join(materialize(main, "main"), ["band", "h"]).filter("struct(c1, c2) <> main")
    return placed, materialize(strays.select("band", "h", "k1", "k2", "c1", "c2", "size"), "strays")


def _binned(some: DataFrame, shared) -> DataFrame:
    def binned(batches):
        idf = shared.value
        for k1, k2, raw in sliced(batches, "k1", "k2", "t"):
            s, n, cut = shingle_hashes(raw, WORDS)
            w = idf.weights(s, n)
            total = np.array([w[a:b].sum() for a, b in zip(cut, cut[1:])])
            yield pa.RecordBatch.from_arrays([k1, k2, pa.array(total), pa.array([bins(s[a:b], w[a:b]) for a, b in zip(cut, cut[1:])], pa.binary())], names=["k1", "k2", "w", "bins"])

    return some.mapInArrow(binned, "k1 long, k2 long, w double, bins binary")


def _blocks(members: DataFrame, measured: DataFrame) -> DataFrame:
    """Members (band, h, k1, k2, c1, c2, size) -> blocks of about BLOCK texts of a bucket, with what pairs are judged on."""
    rows = members.join(measured, ["k1", "k2"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.expr("pmod(xxhash64(k2, k1), blocks)"))
    return rows.groupBy("band", "h", "blocks", "block").agg(F.collect_list(F.struct("k1", "k2", "c1", "c2", "w", "sig", "bins")).alias("m"))


def _across(strays: DataFrame, placed: DataFrame, measured: DataFrame, best: bool) -> DataFrame:
    """Pairs of strays and members of their buckets in other components that may be similar: (a1, a2, b1, b2, same), a < b;
    or (a: the stray) only the best one of each stray in a block."""
    sizes = materialize(strays.select("band", "h", "size").distinct(), "sizes")
    mine = _blocks(strays, measured).select("band", "h", F.col("m").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    all_of = _blocks(placed.join(sizes, ["band", "h"]), measured).select("band", "h", "block", F.col("m").alias("b"))
    both = mine.join(materialize(all_of, "blocks"), ["band", "h", "block"]).select("a", "b")

    def columns(m: pa.Array) -> tuple:
        k = [m.field(c).to_numpy() for c in ("k1", "k2", "c1", "c2", "w")]
        sig = np.frombuffer(b"".join(m.field("sig").to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
        return k, np.ascontiguousarray(sig.T), np.frombuffer(b"".join(m.field("bins").to_pylist()), np.float16).reshape(-1, BINS)

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (ka, a, ha), (kb, b, hb) = (columns(batch.column(c)[i].values) for c in ("a", "b"))
                for p in range(0, len(ha), 128):
                    own = slice(p, p + 128)
                    n = np.zeros((len(ha[own]), len(hb)), np.int16)
                    for x, y in zip(a[:, own], b):
                        n += x[:, None] == y[None, :]
                    n[(ka[2][own][:, None] == kb[2]) & (ka[3][own][:, None] == kb[3])] = 0
                    at, to = np.nonzero(n >= LIKELY * BANDS * ROWS)
                    same = n[at, to] / (BANDS * ROWS)
                    at += p
                    keep = np.zeros(len(at), bool)
                    for q in range(0, len(at), 4096):
                        u, v = at[q : q + 4096], to[q : q + 4096]
                        overlap = np.minimum(ha[u], hb[v]).sum(axis=1, dtype=np.float32).astype(np.float64) * 1.001
                        keep[q : q + 4096] = overlap >= SIMILAR * (ka[4][u] + kb[4][v] - overlap)
                    at, to, same = at[keep], to[keep], same[keep]
                    if best and len(at):
                        order = np.lexsort((-same, at))
                        first = order[np.unique(at[order], return_index=True)[1]]
                        at, to, same = at[first], to[first], same[first]
                    one, two = ([x[at] for x in ka[:2]], [x[to] for x in kb[:2]])
                    less = (one[0] < two[0]) | ((one[0] == two[0]) & (one[1] < two[1])) | best
                    ends = [np.where(less, x, y) for x, y in zip(one, two)] + [np.where(less, y, x) for x, y in zip(one, two)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, ends), pa.array(same)], names=[*A, *B, "same"])

    return both.mapInArrow(compare, "a1 long, a2 long, b1 long, b2 long, same double").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with class_id (hash of the text), component_id (the least document id of the near-duplicate
    group), n_shingles and kept (one document of each group: that of the least id).

    Equal texts are one class; texts equal but for case and white space are alike. Null, empty and blank texts link with nothing: each row is
    its own component and kept. Rows that repeat both id and text stay or go together; of texts that share the least
    id, the one of the least class stays. Null ids come last; a group of null ids only has a null component. Input
    columns named like an output are replaced, all others kept; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = without(docs, [*OUT, "_k1", "_k2", "_t", "_least", "_m1", "_m2"]).withColumn("_t", text_of(text))
    rows = rows.withColumns({"_k1": F.xxhash64("_t"), "_k2": F.xxhash64(F.lit(1), "_t")})
    texts = rows.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), F.col("_t").alias("t"))
    shared = spark.sparkContext.broadcast(inverse_frequencies(texts))
    made = materialize(texts.mapInArrow(_signatures(shared), "k1 long, k2 long, n long, bands array<long>, sig binary"), "rows")
    classes = materialize(made.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in ("n", "bands", "sig")]), "classes")
    discard(made)
    signatures = classes.filter("sig is not null").select("k1", "k2", "sig")
    member = classes.filter("bands is not null").select("k1", "k2", F.posexplode("bands").alias("band", "h"))
    size = materialize(member.groupBy("band", "h").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    crowded = materialize(member.join(size, ["band", "h"]), "crowded")
    discard(size)
    small, large = crowded.filter(F.col("size") <= SMALL), crowded.filter(F.col("size") > SMALL).select("band", "h", "k1", "k2")
    other = small.select("band", "h", F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    close = small.select("band", "h", F.col("k1").alias("a1"), F.col("k2").alias("a2")).join(other, ["band", "h"]).filter("struct(a1, a2) < struct(b1, b2)")
    slot = F.pmod(F.xxhash64("band", "k1"), F.lit(LEADERS))
    order = F.struct(F.xxhash64("band", "k2").alias("o"), "k1", "k2")
    leaders = materialize(large.groupBy("band", "h").agg(F.array(*[F.min(F.when(slot == k, order)) for k in range(LEADERS)]).alias("l")), "leaders")
    led = large.join(leaders, ["band", "h"]).select("k1", "k2", F.explode("l").alias("l"))
    low, high = F.least(F.struct("k1", "k2"), F.struct("l.k1", "l.k2")), F.greatest(F.struct("k1", "k2"), F.struct("l.k1", "l.k2"))
    led = led.filter("l is not null and not (l.k1 = k1 and l.k2 = k2)").select(low["k1"].alias("a1"), low["k2"].alias("a2"), high["k1"].alias("b1"), high["k2"].alias("b2"))
    pairs = materialize(close.select(*A, *B).unionByName(led).distinct(), "pairs")
    likely = materialize(_likely(pairs, signatures), "likely")
    discard(pairs)
    # The best partner of each text first: most other pairs are then within one component and need no look.
    firsts = materialize(_best(likely, (A, B), (B, A)), "firsts")
    ends = likely.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).unionByName(likely.select(F.col("b1").alias("k1"), F.col("b2").alias("k2")))
    needed = materialize(ends.unionByName(large.select("k1", "k2")).distinct(), "needed")
    some = bucketed(semi_join(texts, needed, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("t").alias("t")), ["k1", "k2"], "some")
    links = materialize(_verified(firsts, some, shared), "links")
    parts = materialize(_joined_up(links), "parts")
    apart = materialize(_apart(likely, parts), "apart")
    discard(firsts, links, likely)
    parts = _extended(parts, materialize(_verified(apart, some, shared), "links"))
    if not large.isEmpty():
        members = materialize(large.select("k1", "k2").distinct(), "members")
        measured = _binned(some.join(members, ["k1", "k2"], "left_semi"), shared)
        measured = materialize(measured.join(signatures, ["k1", "k2"]), "measured")
        for best in (True, False):
            placed, strays = _placed(large, parts)
            late = materialize(_across(strays, placed, measured, best), "late")
            chosen = materialize(_best(late, (A, B)) if best else _apart(late, parts), "chosen")
            parts = _extended(parts, materialize(_verified(chosen, some, shared), "links"))
            discard(placed, strays, late)
        discard(measured)
    discard(some, crowded)
    ids = rows.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), F.col(f"`{id_col}`").alias("id")).groupBy("k1", "k2").agg(F.min("id").alias("id"))
    placed = ids.join(parts, ["k1", "k2"], "left").withColumns({"c1": F.coalesce("c1", "k1"), "c2": F.coalesce("c2", "k2")})
    placed = materialize(placed, "documents")
    chosen = placed.groupBy("c1", "c2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("m"))
    chosen = placed.join(materialize(chosen, "chosen"), ["c1", "c2"]).select("k1", "k2", "m.id", F.col("m.k1").alias("m1"), F.col("m.k2").alias("m2"))
    known = materialize(chosen.join(classes.select("k1", "k2", "n"), ["k1", "k2"]), "known")
    known = known.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("id").alias("_least"), F.col("m1").alias("_m1"), F.col("m2").alias("_m2"), F.col("n").alias("n_shingles"))
    out = rows.join(known, ["_k1", "_k2"], "left")
    own = F.col(f"`{id_col}`")
    blank = F.coalesce("n_shingles", F.lit(0)) == 0
    out = out.withColumns({
        "class_id": F.lower(F.concat(F.lpad(F.hex("_k1"), 16, "0"), F.lpad(F.hex("_k2"), 16, "0"))),
        "component_id": F.when(blank, own).otherwise(F.col("_least")),
        "n_shingles": F.coalesce("n_shingles", F.lit(0).cast("long")),
        "kept": blank | (own.eqNullSafe(F.col("_least")) & (F.col("_k1") == F.col("_m1")) & (F.col("_k2") == F.col("_m2"))),
    })
    return out.drop("_k1", "_k2", "_t", "_least", "_m1", "_m2")
