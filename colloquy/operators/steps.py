"""Post-processing as switched steps, each of which may fail without losing what came before it.

A step on texts is a Python function, called in Arrow batches and guarded row by row: where it raises, the row keeps its text and
says which step failed, and how. A step on rows is a function of the whole table; it is computed when its turn comes, and if that fails,
its input goes on, with the failure in every row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

ERRORS = "array<struct<step: string, message: string>>"
NAMES = ("hallucination", "itn", "filler", "correction", "segmentation", "punctuation", "diarization", "embedding")  # in the order in which they run
PUNCTUATED = ("qwen3", "whisper")  # engines whose answers have punctuation


@dataclass(frozen=True)
class Step:
    """One of NAMES, and what it does: `text`, of a text (str to str), or `rows`, of a table."""

    name: str
    text: Callable[[str], str] | None = None
    rows: Callable[[DataFrame], DataFrame] | None = None


def switched(steps: list[Step], switches: dict[str, bool], engine: str = "") -> list[Step]:
    """The steps that are on, in their order. Steps are on unless switched off; punctuation is off for engines that give it."""
    if wrong := [s.name for s in steps if s.name not in NAMES] + [n for n in switches if n not in NAMES]:
        raise ValueError(f"no such step: {', '.join(wrong)}")
    on = [s for s in steps if switches.get(s.name, True) and not (s.name == "punctuation" and engine in PUNCTUATED)]
    return sorted(on, key=lambda s: NAMES.index(s.name))


def _failed(name: str, message) -> F.Column:
    return F.array(F.struct(F.lit(name).alias("step"), message.alias("message"))).cast(ERRORS)


def _on_texts(rows: DataFrame, step: Step) -> DataFrame:
    apply = step.text

    @F.pandas_udf("text string, error string")
    def guarded(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                out.append((None if t is None else apply(t), None))
            except Exception as e:  # whatever it is, it is this row's
                out.append((t, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["text", "error"], dtype=object)

    rows = rows.withColumn("_done", guarded("text"))
    errors = F.when(F.col("_done.error").isNull(), F.col("errors")).otherwise(F.concat("errors", _failed(step.name, F.col("_done.error"))))
    return rows.withColumns({"errors": errors, "text": F.col("_done.text")}).drop("_done")


def post_processed(rows: DataFrame, steps: list[Step], switches: dict[str, bool] | None = None, engine: str = "") -> DataFrame:
    """rows (with a text) after the steps that are on, and `errors`: which of them failed on each row, and how.

    Null texts stay null. Steps on rows must keep the column `errors`, and may drop rows and add columns. Without steps, rows are as they were.
    """
    rows = rows.drop("errors").withColumn("errors", F.array().cast(ERRORS))
    for step in switched(steps, switches or {}, engine):
        if step.text:
            rows = _on_texts(rows, step)
        if step.rows:
            before = written(rows, "steps")  # a failure is this step's, and not an earlier one's
            try:
                rows = written(step.rows(before), f"after-{step.name}")
            except (PySparkException, ValueError, TypeError, KeyError) as e:
                rows = before.withColumn("errors", F.concat("errors", _failed(step.name, F.lit(str(e).split("\n")[0][:500]))))
    return rows
