"""Article CSV reader: columns by name, all strings, multi-line quoted text, pandas-style NA tokens."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Strings a pandas CSV read turns into missing values by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

ARTICLE_CSV_COLUMNS = ("article_id", "title", "description", "content", "category", "published_at")


def na_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.col(c).isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
                       for c in df.columns])


def read_articles_csv(spark: SparkSession, path: str, columns=None, corrupt_col: str | None = None) -> DataFrame:
    """The wanted columns, by name, as strings (no inference pass over the data), NA tokens -> NULL.

    The file's columns may be in any order and more than wanted; a missing text column is NULL, a missing
    article id is left out (article preparation makes one). ``corrupt_col`` names a column that holds
    the source of malformed rows. Quoted text may span lines, so a file is read by one task: large
    inputs come as many files.
    """
    cols = columns or ARTICLE_CSV_COLUMNS

    def reader():
        return (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
                .option("mode", "PERMISSIVE"))

    names = reader().csv(path).columns  # the header; no inference
    schema = ", ".join(f"`{c}` string" for c in names)
    read = reader().option("enforceSchema", False)
    if corrupt_col:
        read = read.option("columnNameOfCorruptRecord", corrupt_col)
        schema += f", `{corrupt_col}` string"
    df = read.schema(schema).csv(path)
    wanted = [F.col(f"`{c}`") if c in names else F.lit(None).cast("string").alias(c) for c in cols if c in names or c != "article_id"]
    out = na_to_null(df.select(*wanted, *([corrupt_col] if corrupt_col else [])))
    return out


def write_articles_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
       .option("quoteAll", True).option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False).csv(path))
