"""Article preparation: sample, dedupe, combine text, filter, parse dates, label categories."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import combine_text, normalize_category, parse_published_at
from ..session import cut_lineage
from .ranking import first_per_key
from .sampling import SEED, sample_rows

TEXT_COLS = ("title", "description", "content")
ID_COL = "article_id"
CATEGORY_COL = "category"
DATE_COL = "published_at"
PROCESSED_COLS = (ID_COL, CATEGORY_COL, "category_encoded", DATE_COL, "combined_text")


def with_row_order(df: DataFrame, order_col: str = "row_ord") -> DataFrame:
    """Input order column; where absent, from a 128-bit digest of the row's content, which does not change with
    the layout of the files (rows that are equal in every column count as one). Without an id column either, the
    digest becomes the id."""
    if order_col in df.columns:
        return df
    whole = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    df = df.withColumn("__digest", F.md5(whole)).dropDuplicates(["__digest"]).withColumn(order_col, F.xxhash64("__digest"))
    if ID_COL not in df.columns:
        df = df.withColumn(ID_COL, F.col("__digest"))
    return df.drop("__digest")


def with_article_id(df: DataFrame, order_col: str = "row_ord") -> DataFrame:
    """String id; where the input has an order column but no id, the order becomes the id."""
    if ID_COL not in df.columns:
        df = df.withColumn(ID_COL, F.col(order_col))
    return df.withColumn(ID_COL, F.col(ID_COL).cast("string"))


def with_missing_text_cols(df: DataFrame) -> DataFrame:
    for c in (*TEXT_COLS, CATEGORY_COL, DATE_COL):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def dedupe_articles(df: DataFrame, order_col: str = "row_ord") -> DataFrame:
    """One row per article id: the first in input order."""
    return first_per_key(df, [ID_COL], [order_col])


def with_combined_text(df: DataFrame) -> DataFrame:
    return df.withColumn("combined_text", combine_text(*TEXT_COLS))


def category_labels(df: DataFrame, col: str = CATEGORY_COL) -> DataFrame:
    """(category, category_encoded): distinct values numbered from 0 in code-point order.

    The window runs over the distinct label table only (one row per category, a small label space);
    ``global_row_number`` is the distributed alternative for a label space of unbounded size.
    """
    distinct = df.select(col).distinct()
    w = Window.orderBy(F.col(col))
    return distinct.select(col, (F.row_number().over(w) - 1).cast("int").alias("category_encoded"))


def encode_category(df: DataFrame, col: str = CATEGORY_COL) -> DataFrame:
    """Attach the label. The label table's real size is known when the join runs: adaptive execution
    broadcasts it when it is small and splits a hot category otherwise."""
    return df.join(category_labels(df, col), col)


def prepare_articles(raw: DataFrame, cap: int | None = None, seed: int = SEED,
                     order_col: str = "row_ord", materialize: bool = True) -> DataFrame:
    """Raw article rows -> processed articles (article_id, category, category_encoded, published_at,
    combined_text), in the reference's step order: sample (only with a ``cap``), id, dedupe, combine, drop null category,
    drop blank text, parse date, normalise category, label."""
    df = with_missing_text_cols(with_row_order(raw, order_col))
    if cap is not None:
        df = sample_rows(df, cap, seed, [order_col])
    df = with_article_id(df, order_col).where(F.col(ID_COL).isNotNull())
    df = dedupe_articles(df.select(ID_COL, *TEXT_COLS, CATEGORY_COL, DATE_COL, order_col), order_col)
    df = with_combined_text(df)
    df = df.where(F.col(CATEGORY_COL).isNotNull())
    # Every combined field is stripped and non-empty, so the combined text is blank exactly when
    # it is '' (no second strip over the whole text).
    df = df.where(F.col("combined_text") != "")
    df = df.withColumn(DATE_COL, parse_published_at(DATE_COL)).where(F.col(DATE_COL).isNotNull())
    df = df.withColumn(CATEGORY_COL, normalize_category(CATEGORY_COL))
    if materialize:
        # the label table and the rows both read the prepared rows: write them once
        df = cut_lineage(df.select(ID_COL, CATEGORY_COL, DATE_COL, "combined_text"))
    df = encode_category(df)
    return df.select(*PROCESSED_COLS)


def category_count(processed: DataFrame) -> DataFrame:
    """Number of distinct labels (k for clustering)."""
    return processed.agg(F.countDistinct("category_encoded").cast("bigint").alias("n_categories"))


def category_lookup(processed: DataFrame) -> DataFrame:
    """(article_id, category): the id -> category map consumed by joins."""
    return processed.select(ID_COL, CATEGORY_COL)
