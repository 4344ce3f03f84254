"""Secret scans with character Markov models, in DataFrame functions only.

Base patterns find assignments, access keys and hexadecimal strings. Two character bigram models, one of random
strings and one of ordinary identifiers, are trained from labelled samples and compared by the mean log-likelihood
ratio of the tokens of each text; tokens that look random add spans of kind `markov`.

Labelled samples (bounded; the bound is TRAIN_ROWS): random strings are digests in hexadecimal, base64 and a mixed
alphabet; ordinary identifiers are combinations of the words below in the usual spellings, and numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of, without

TRAIN_ROWS = 3000
MIN_TOKEN = 20
MIN_RATIO = 0.55  # nats a character
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # leftmost runs of 24 or more: those of [0-9a-f]+ that don't fail
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
OUT = ["n_assign", "n_access", "n_hex", "n_markov", "base_spans", "all_spans"]

#: Words of ordinary identifiers.
IDENTIFIER_WORDS = (
    "account action address admin agent alert amount array author average balance batch block body border buffer build "
    "button cache call category channel check child class client close cluster code color column comment config connect "
    "content context control convert copy count create current customer data database date default delete depth detail "
    "device direct display document domain double download driver element empty enable encode engine entry error event "
    "example execute export factory feature field file filter first float folder format frame function generate global "
    "graph group handle handler header height history house image import index information input insert instance "
    "integer interface internal item iterator journal label language last layer layout length level library limit line "
    "list listener load local location lock manager mapping matrix maximum member memory merge message method minimum "
    "model module monitor name network node normal notice number object offset operation option order output package "
    "page parameter parent parse partition password path pattern payment permission person place player point policy "
    "position previous primary print process product profile program project property provider public query queue "
    "random range reader record reference region register remote remove render replace report request reset resource "
    "response result return review route sample schema scope score script search second section select sender sequence "
    "server service session setting shape share signal simple single size source special stack start state status "
    "storage store stream string style subject submit summary support switch symbol system table target task template "
    "text theme thread time title token total track transaction transfer tree trigger type unit update upload user "
    "utility value variable vector version video view visible window worker world writer"
).split()


def _samples(spark: SparkSession) -> DataFrame:
    """Rows (random boolean, s): as many random strings as ordinary identifiers."""
    n = len(IDENTIFIER_WORDS)
    words = F.array(*map(F.lit, IDENTIFIER_WORDS))
    ids = spark.range(TRAIN_ROWS)
    digest = F.sha2(F.concat(F.lit("s"), F.col("id").cast("string")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    random = ids.select(F.lit(True).alias("random"), F.explode(F.array(F.substring(digest, 1, 40), F.substring(mixed, 1, 40), F.upper(F.substring(mixed, 1, 24)), F.lower(mixed))).alias("s"))
    pick = [F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)) + 1).cast("int")) for k in range(4)]
    joined = [F.concat_ws("_", *pick), F.concat(pick[0], *[F.initcap(p) for p in pick[1:]]), F.concat_ws("-", *pick), F.concat(*pick), F.upper(F.concat_ws("_", *pick)), F.concat_ws("/", *pick), F.format_string("%s_%04d-%02d-%02d", pick[0], F.col("id") + 1000, F.col("id") % 12 + 1, F.col("id") % 28 + 1)]
    return random.unionByName(ids.select(F.lit(False).alias("random"), F.explode(F.array(*joined)).alias("s")))


def train(spark: SparkSession) -> list[float]:
    """The log ratio random : ordinary of each character after each other one, at 128 * first + second (add-half counts)."""
    chars = F.split(F.col("s"), "")
    pairs = _samples(spark).select("random", F.explode(F.transform(F.arrays_zip(F.slice(chars, 1, F.length("s") - 1).alias("a"), F.slice(chars, 2, F.length("s") - 1).alias("b")), lambda p: F.ascii(p["a"]) * 128 + F.ascii(p["b"]))).alias("k"))
    counts = pairs.groupBy("k").agg(F.sum(F.col("random").cast("long")).alias("r"), F.sum((~F.col("random")).cast("long")).alias("o")).collect()  # at most 128 * 128 rows
    n_r, n_o = [0.0] * 128, [0.0] * 128
    for k, r, o in counts:
        n_r[k // 128] += r
        n_o[k // 128] += o
    found = {k: (r, o) for k, r, o in counts}
    ratio = lambda k: math.log((found.get(k, (0, 0))[0] + 0.5) / (n_r[k // 128] + 32)) - math.log((found.get(k, (0, 0))[1] + 0.5) / (n_o[k // 128] + 32))
    return [round(ratio(k), 6) for k in range(128 * 128)]


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of (start, order, kind, end) of the pattern's leftmost, non-overlapping matches, in code points.

    The pieces between matches and the matches take turns, so that their lengths add up to the positions.
    """
    order = KINDS.index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>").alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        one = F.array(F.struct(begin.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.when(keep(x["m"]), one).otherwise(F.slice(one, 1, 0)) if keep else one).alias("out"))

    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    walked = F.aggregate(F.filter(pairs, lambda p: p["m"].isNotNull()), start, step)["out"]
    return F.when(F.size(found) > 0, walked).otherwise(F.slice(start["out"], 1, 0))


def joined(all_spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(all_spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, model: list[float] | None = None, text: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, n_markov, base_spans and all_spans (arrays of start, order, kind, end).

    Null and empty texts have no spans. Overlapping spans of different kinds all stay. Other columns and repeated
    rows are kept, input columns named like an output are replaced; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    weights = F.array(*map(F.lit, model)) if model else None
    table = spark.createDataFrame([(train(spark),)], "_model array<double>") if weights is None else spark.range(1).select(weights.alias("_model"))
    rows = without(docs, [*OUT, "_model", "_t", "_k", "_a", "_b", "_c", "_m"]).withColumn("_t", text_of(text))
    rows = rows.join(F.broadcast(table), F.lit(True))  # one row of 16384 numbers

    def assigned(m):
        return F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6

    def random_looking(m):
        n = F.length(m) - 1
        codes = F.transform(F.split(m, ""), lambda c: F.ascii(c))
        total = F.aggregate(F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: F.get(F.col("_model"), a * 128 + b)), F.lit(0.0), lambda s, x: s + x)
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (total > MIN_RATIO * n)

    rows = rows.withColumn("_a", spans(F.col("_t"), ASSIGN, "assign", assigned))
    rows = rows.withColumn("_b", spans(F.col("_t"), ACCESS, "access", lambda m: F.length(m) >= 20))
    rows = rows.withColumn("_c", spans(F.col("_t"), HEX, "hex")).withColumn("_m", spans(F.col("_t"), TOKEN, "markov", random_looking))
    return (
        rows.withColumns({n: F.size(c).cast("long") for n, c in zip(OUT, ("_a", "_b", "_c", "_m"))})
        .withColumn("base_spans", F.concat("_a", "_b", "_c"))
        .withColumn("all_spans", F.concat("_a", "_b", "_c", "_m"))
        .drop("_t", "_model", "_a", "_b", "_c", "_m")
    )


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The texts with every span of all_spans (merged where they overlap) replaced by mark. Texts without spans stay as they are."""
    merged = F.aggregate(
        F.array_sort("all_spans"),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"), s["end"].alias("at")),
        ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))),
    )
    cut = F.concat(merged["out"], F.substring(F.col(text), merged["at"] + 1, F.length(text)))
    return scanned.withColumn(text, F.when(F.size("all_spans") > 0, cut).otherwise(F.col(text)))
