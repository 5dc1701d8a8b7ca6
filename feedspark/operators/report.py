"""Evaluation report: a metrics long table (section, metric, value, note) and its text rendering."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT_COLS = ("section", "metric", "value", "note")


def metric_rows(section: str, one_row: DataFrame, note: str = "") -> DataFrame:
    """Unpivot a one-row metrics DataFrame into (section, metric, value, note)."""
    cols = one_row.columns
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                for c in cols])).alias("m")
    return one_row.select(stack).select(F.lit(section).alias("section"), "m.metric", "m.value",
                                        F.lit(note).alias("note"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def render_lines(report: DataFrame, title: str) -> DataFrame:
    """One text line per metric, ordered by section then metric, formatted to 4 decimals."""
    line = F.concat(F.col("section"), F.lit(" | "), F.col("metric"), F.lit(": "),
                    F.coalesce(F.format_string("%.4f", F.col("value")), F.lit("nan")),
                    F.when(F.col("note") != "", F.concat(F.lit(" ("), F.col("note"), F.lit(")"))).otherwise(F.lit("")))
    return report.select(line.alias("value"), "section", "metric")


def write_report(report: DataFrame, path: str, title: str = "Evaluation Report") -> None:
    """Text file: title line, separator, one line per metric (the report is a handful of rows)."""
    spark = report.sparkSession
    header = spark.createDataFrame([(f"--- {title} ---", "", ""), ("-" * 30, "", "")], "value string, section string, metric string")
    body = render_lines(report, title)
    out = header.withColumn("o", F.lit(0)).unionByName(body.withColumn("o", F.lit(1)))
    out.orderBy("o", "section", "metric").coalesce(1).select("value").write.mode("overwrite").text(path)
