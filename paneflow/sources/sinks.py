"""Sinks for metric tables: JSON, YAML, CSV, Parquet and a small Markdown report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT_ROWS = 200


def write_metrics(metrics: DataFrame, path: str, kind: str = "json") -> None:
    """``kind`` is json, csv or parquet; what was there is replaced."""
    writer = metrics.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def checkpoint_fold(scores: DataFrame, path: str, fold: int) -> None:
    """Write one fold's scores beside the others; a rerun replaces only that fold."""
    scores.drop("fold").write.mode("overwrite").parquet(f"{path}/fold={fold}")


def markdown(metrics: DataFrame, digits: int = 4) -> str:
    """The first REPORT_ROWS rows as a Markdown table, and a line that says so if there are more: a report, not the data."""
    shown = metrics.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in metrics.dtypes)).limit(REPORT_ROWS + 1).collect()
    lines = ["| " + " | ".join(metrics.columns) + " |", "|" + "---|" * len(metrics.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in shown[:REPORT_ROWS]]
    return "\n".join(lines + ["", f"The first {REPORT_ROWS} rows; there are more."] * (len(shown) > REPORT_ROWS))


def write_yaml(metrics: DataFrame, path: str) -> None:
    """One YAML item per row as text files; values are written as JSON, which YAML includes."""
    fields = [F.concat(F.lit(("- " if i == 0 else "  ") + c + ": "), F.coalesce(_scalar(c, kind), F.lit("null"))) for i, (c, kind) in enumerate(metrics.dtypes)]
    metrics.select(F.concat_ws("\n", *fields).alias("value")).write.mode("overwrite").text(path)


def _scalar(column: str, kind: str) -> Column:
    if kind != "string":
        return F.col(column).cast("string")
    quoted = F.regexp_extract(F.to_json(F.struct(F.col(column).alias("v"))), r'^\{"v":(.*)\}$', 1)
    return F.when(F.col(column).isNotNull(), quoted)
