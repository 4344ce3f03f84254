"""Quality rules with host-level verdicts.

Each whole text is measured once per pass. Failures of the rules are added up by host (a column; pre-aggregated, so a
host with a third of all rows costs one row per task), the hosts' failure rates are shrunk towards a beta prior whose
two parameters come from the hosts themselves (method of moments), and the verdicts are joined back to the documents:
in a bad host, documents that fail any rule go; elsewhere only the base rule removes documents.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of, without
from .hashing import slices
from .worker import owned

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
OUT = [*STATS, "base_failed", "rule_failed", "host_rate", "host_bad", "kept"]

MIN_WORDS = 50
MAX_REPEAT = 50  # per cent of words within repeated 3-word windows
MAX_SYMBOLS = 10  # symbols per 100 words
MAX_DUP_LINES = 30  # per cent of lines
WORD_LENGTHS = (2, 12)  # mean characters of a word
BAD_HOST = 0.5  # shrunken failure rate


def measure(text: str) -> tuple[int, ...]:
    words = WORD.findall(text)
    n = len(words)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        last = -1
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 2 - max(i - 1, last)
                last = i + 2
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def text_stats(text: Column) -> Column:
    @F.arrow_udf(", ".join(f"{c} long" for c in STATS))
    def stats(texts: pa.Array) -> pa.Array:
        owned("rules", dict)
        rows = [measure(t.decode()) for _, part in slices(texts, lower=False) for t in part]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(STATS))], STATS)

    return stats(text)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def rule_failed() -> Column:
    low, high = WORD_LENGTHS
    return (
        base_failed()
        | (100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"))
        | (F.col("word_chars") < low * F.col("n_words"))
        | (F.col("word_chars") > high * F.col("n_words"))
    )


def host_verdicts(measured: DataFrame, bad_host: float = BAD_HOST) -> DataFrame:
    """One row per host: its documents, failures, shrunken rate (f + a) / (n + a + b) and verdict.

    a and b match the mean and variance of the hosts' rates; where these give no prior (one host, or rates that vary
    no more than chance would have it), a prior of one document's weight at the mean rate stands in.
    """
    hosts = measured.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("f"))
    rate = F.col("f") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"))
    weight = F.coalesce(F.try_divide(F.col("m") * (1 - F.col("m")), F.col("v")) - 1, F.lit(1.0))
    prior = prior.select("m", F.when(weight > 0, F.least(weight, F.lit(1e6))).otherwise(F.lit(1.0)).alias("w"))
    # The prior is one row by construction, so this broadcast has a fixed size.
    shrunk = (F.col("f") + F.col("m") * F.col("w")) / (F.col("n") + F.col("w"))
    return hosts.join(F.broadcast(prior), F.lit(True)).select("_host", shrunk.alias("host_rate"), (shrunk >= bad_host).alias("host_bad"))


def quality_rules(docs: DataFrame, host: str = "source", bad_host: float = BAD_HOST) -> DataFrame:
    """docs with the measures, base_failed, rule_failed, host_rate, host_bad and kept.

    Null texts count as empty (they fail the base rule); null hosts are one host. Repeated rows count each. Input
    columns named like an output are replaced, in any case. An empty table gives an empty table.
    """
    rows = without(docs, [*OUT, "_host", "_s"]).withColumn("_host", F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")))
    kept = [F.col(f"`{c}`") for c in rows.columns]

    def measured(df: DataFrame, cols) -> DataFrame:
        df = df.select(*cols, text_stats(text_of()).alias("_s")).select(*cols, "_s.*")
        return df.withColumn("base_failed", base_failed()).withColumn("rule_failed", rule_failed())

    verdicts = materialize(host_verdicts(measured(rows.select("_host", "text"), [F.col("_host")]), bad_host), "hosts")
    judged = measured(rows, kept).join(verdicts, "_host")  # a written table of a row a host: broadcast while small, else a join that splits where a host is hot
    return judged.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_bad") & F.col("rule_failed"))).drop("_host")
