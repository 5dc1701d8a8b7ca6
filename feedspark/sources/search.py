"""Paged web-search source as a Spark Python DataSource.

Queries come from a stored Parquet table (option ``queries_table``: query, query_idx, wanted; cut into partitions of
``rows_per_partition`` rows by its row groups, of which planning reads the footers alone) or, for a few, from the option ``queries`` as JSON,
one partition each. For each query the page function is asked for at most 10
results at a time, follows the next start index, and stops when enough results were fetched, when
there is no next page, or on an error (keeping what it has). Empty pages that still announce a next
page stop after ``max_empty_pages`` so a misbehaving service cannot loop forever.

The page function is named by an import path (``module:function``) and called as
``fn(query, start, num, **options) -> {"items": [{"link", "title", "snippet"}...], "next_start": int | None}``.
Without credentials or a page function the source yields nothing.

With the option ``status`` every row has a column of this name: ``ok``, or, in one row without a position after the results of a query that
failed, the error. With the option ``pushdown`` (and ``spark.sql.python.filterPushdown.enabled``) filters on ``query`` and upper
bounds of ``pos`` are taken over: other queries are not asked, and no more results than needed are.

``search_all`` asks for a DataFrame of queries in the same way, from any store that Spark reads.
"""
from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "query string, query_idx int, pos int, link string, title string, snippet string"
MAX_PER_REQUEST, ROWS_PER_PARTITION = 10, 64
OK = "ok"


class QueryPartition(InputPartition):
    """Queries named here, or rows of a row group of a stored table."""

    def __init__(self, queries: list[tuple[str, int, int]] | None = None, file: str | None = None, group: int = 0, lo: int = 0, hi: int = 0):
        self.queries, self.file, self.group, self.lo, self.hi = queries, file, group, lo, hi


def _load(path: str):
    mod, fn = path.split(":")
    return getattr(importlib.import_module(mod), fn)


def fetch_query(page_fn, query: str, wanted: int, options: dict, max_empty_pages: int = 3) -> tuple[list[dict], str]:
    """(results, ``ok`` or the error that ended the requests)."""
    results, start, empty = [], 1, 0
    try:
        while len(results) < wanted:
            num = min(MAX_PER_REQUEST, wanted - len(results))
            page = page_fn(query, start, num, **options)
            items = list(page.get("items") or [])
            results.extend(items)
            empty = empty + 1 if not items else 0
            nxt = page.get("next_start")
            if nxt and len(results) < wanted and empty < max_empty_pages:
                start = nxt
            else:
                break
    except Exception as e:  # noqa: BLE001 - whatever a page function raises ends its query alone
        return results, f"{type(e).__name__}: {e}"
    return results, OK


def _rows(page_fn, query: str, query_idx: int, wanted: int, options: dict, max_empty_pages: int, with_status: bool) -> Iterator[tuple]:
    items, status = fetch_query(page_fn, query, wanted, options, max_empty_pages)
    for i, it in enumerate(items, start=1):
        yield (query, query_idx, i, it.get("link"), it.get("title"), it.get("snippet"), *([OK] if with_status else []))
    if with_status and status != OK:
        yield query, query_idx, None, None, None, None, status


def _file_system(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class PagedSearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.only: set[str] | None = None
        self.most: int | None = None

    def partitions(self):
        table = self.options.get("queries_table")
        if not table:
            listed = [(q["query"], int(q.get("query_idx", i + 1)), int(q["wanted"])) for i, q in enumerate(json.loads(self.options.get("queries", "[]")))]
            return [QueryPartition([q]) for q in listed if self.only is None or q[0] in self.only] or [QueryPartition([])]
        from pyarrow import fs
        from pyarrow import parquet as pq
        store, path = _file_system(table)
        step = int(self.options.get("rows_per_partition", ROWS_PER_PARTITION))
        found = store.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else sorted((f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.path.endswith(".parquet")), key=lambda f: f.path)
        out = []
        for f in files:
            with store.open_input_file(f.path) as source:
                meta = pq.ParquetFile(source).metadata
            for g in range(meta.num_row_groups):
                n = meta.row_group(g).num_rows
                out += [QueryPartition(None, f.path, g, lo, min(n, lo + step)) for lo in range(0, n, step)]
        return out or [QueryPartition([])]

    def _queries(self, partition: QueryPartition) -> list[tuple[str, int, int]]:
        if partition.file is None:
            return partition.queries
        from pyarrow import parquet as pq
        store, _ = _file_system(self.options["queries_table"])
        with store.open_input_file(partition.file) as source:
            table = pq.ParquetFile(source).read_row_group(partition.group, columns=["query", "query_idx", "wanted"]).slice(partition.lo, partition.hi - partition.lo)
        return [(r["query"], r["query_idx"], r["wanted"]) for r in table.to_pylist() if r["query"] is not None and (self.only is None or r["query"] in self.only)]

    def read(self, partition: QueryPartition):
        fn_path = self.options.get("page_function")
        if not fn_path or not self.options.get("api_key", "set"):
            return
        page_fn = _load(fn_path)
        extra = {k: v for k, v in self.options.items() if k.startswith("arg_")}
        # a pushed bound of the position also drops status rows, whose position is null
        with_status = self.options.get("status", "false").lower() == "true"
        for query, query_idx, wanted in self._queries(partition):
            wanted = wanted or 0
            most = wanted if self.most is None else min(wanted, max(0, self.most))
            for row in _rows(page_fn, query, query_idx, most, extra, int(self.options.get("max_empty_pages", 3)), with_status):
                if self.most is None or row[2] is not None:
                    yield row


class PushingReader(PagedSearchReader):
    """Takes over filters; a class of its own, because Spark refuses such a reader where push-down is off."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("query",):
                self.only = {f.value} & (self.only if self.only is not None else {f.value})
            elif isinstance(f, In) and f.attribute == ("query",):
                self.only = set(f.value) & (self.only if self.only is not None else set(f.value))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("pos",):
                bound = f.value - isinstance(f, LessThan)
                self.most = bound if self.most is None else min(self.most, bound)
            else:
                yield f


class PagedSearchDataSource(DataSource):
    @classmethod
    def name(cls):
        return "paged_search"

    def schema(self):
        return SCHEMA + (", status string" if self.options.get("status", "false").lower() == "true" else "")

    def reader(self, schema):
        return (PushingReader if self.options.get("pushdown", "false").lower() == "true" else PagedSearchReader)(self.options)


def register(spark) -> None:
    spark.dataSource.register(PagedSearchDataSource)


def search_all(queries: DataFrame, page_function: str, options: dict | None = None, max_empty_pages: int = 3) -> DataFrame:
    """Results, and a status row for each failed query, of ``queries`` (query, query_idx, wanted); repeated queries are asked once for the most that any of them wants."""
    from pyspark.sql import functions as F
    extra = dict(options or {})

    def run(batches):
        import pandas as pd
        page_fn = _load(page_function)
        names = [*(c.split(" ")[0] for c in SCHEMA.split(", ")), "status"]
        for pdf in batches:
            rows = [r for q, w in zip(pdf["query"], pdf["wanted"]) for r in _rows(page_fn, q, 0, int(w), extra, max_empty_pages, True)]
            out = pd.DataFrame(rows, columns=names)
            yield out.assign(pos=out["pos"].astype("Int32"))[["query", "pos", "link", "title", "snippet", "status"]]

    asked = queries.where("query IS NOT NULL").groupBy("query").agg(F.max(F.coalesce("wanted", F.lit(0))).alias("most"))
    found = asked.select("query", F.col("most").alias("wanted")).mapInPandas(run, "query string, pos int, link string, title string, snippet string, status string")
    return (queries.select("query", "query_idx", "wanted").join(found, "query").where((F.col("pos") <= F.col("wanted")) | F.col("pos").isNull())
            .select("query", "query_idx", "pos", "link", "title", "snippet", "status"))
