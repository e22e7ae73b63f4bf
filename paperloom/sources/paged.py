"""Paged scans: replies that come page by page for each of several queries, live or recorded.

A page is a row (query, page, body): pages of a query count from 1, and body is the reply's JSON, null if the request failed.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.text import blank, filled

from .readers import _CROSSREF, _PAPER, _WORKING, crossref_items, paper_items, working_paper_items


class RateLimited(Exception):
    """What a fetch raises if the request may be sent again after a pause."""


def scan(queries: DataFrame, fetch: Callable[[str, int], str | None], items: str, per_page: int, most: int = 50, tries: int = 3, pause: float = 30.0) -> DataFrame:
    """(query, page, body, error): the pages that `fetch(query, page)` gives, a task for each part of the queries.

    A query ends with its first page of fewer than `per_page` entries in the array `items` (a path by dots), or with page
    `most`.  A rate-limited request is sent `tries` times, after a pause that grows; then, and at once for any other error,
    the query ends with a page without a body and the error's name, and the others go on.  Queries that are null or empty
    are left out, repeated ones are asked once.
    """
    path = items.split(".")

    def entries(body: str) -> int:
        found = json.loads(body)
        for name in path:
            found = (found or {}).get(name)
        return len(found or [])

    def pages(query: str) -> Iterator[tuple]:
        for page in range(1, most + 1):
            for again in range(tries):
                try:
                    body = fetch(query, page)
                    n = entries(body) if body else 0
                    break
                except RateLimited as e:
                    error = e
                    if again + 1 < tries:
                        time.sleep(pause * (again + 1))
                except Exception as e:  # one query's failure is its own
                    yield query, page, None, type(e).__name__
                    return
            else:
                yield query, page, None, type(error).__name__
                return
            yield query, page, body, None
            if n < per_page:
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for query in b.column(0).to_pylist():
                for row in pages(query):
                    yield pa.RecordBatch.from_pylist([dict(zip(("query", "page", "body", "error"), row))], pa.schema([("query", pa.string()), ("page", pa.int32()), ("body", pa.string()), ("error", pa.string())]))

    wanted = queries.select(F.col(queries.columns[0]).cast("string").alias("query")).filter(~blank(F.col("query"))).distinct()
    return wanted.mapInArrow(run, "query string, page int, body string, error string")


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """Pages recorded as files `<query>/<page>.json` below a folder in any store that Spark reads."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(path)
    name = F.split(F.col("_metadata.file_path"), "/")
    return raw.select(F.url_decode(F.element_at(name, -2)).alias("query"), F.regexp_extract(F.element_at(name, -1), r"^(\d+)\.json$", 1).try_cast("int").alias("page"), F.nullif(F.col("value"), F.lit("")).alias("body")).filter("page is not null")


def entries(pages: DataFrame, items: str, schema: str, per_page: int | None = None) -> DataFrame:
    """(query, page, place, e) of the pages that a scan would have read; e has the entry's fields by `schema`.

    A scan starts at page 1 and goes on while pages are full and the next one is there and could be read: what lies behind
    a short, missing or failed page isn't taken.  Without `per_page` a query has page 1 alone.  Only page numbers and
    lengths are shuffled to find a query's end; bodies stay where they are read.
    """
    listed = pages.withColumn("__e", F.from_json(F.get_json_object("body", f"$.{items}"), "array<string>"))
    sizes = listed.select("query", "page", F.size(F.coalesce("__e", F.array().cast("array<string>"))).alias("n"))
    if per_page is None:
        kept = listed.filter("page = 1")
    else:
        short = sizes.groupBy("query").agg(F.min(F.when(F.col("n") < per_page, F.col("page"))).alias("__short"))
        # the first page whose follower is missing
        gap = sizes.join(sizes.select("query", (F.col("page") - 1).alias("page")), ["query", "page"], "left_anti").groupBy("query").agg(F.min("page").alias("__gap"))
        starts = sizes.filter("page = 1").select("query").distinct()
        ends = starts.join(short, "query").join(gap, "query").select("query", F.least("__short", "__gap").alias("__end"))
        kept = listed.join(ends, "query").filter(F.col("page") <= F.col("__end"))
    rows = kept.select("query", "page", F.posexplode("__e").alias("place", "__x"))
    return rows.select("query", "page", "place", F.from_json("__x", schema).alias("e")).filter("e is not null")


def working_papers(pages: DataFrame, programs: list[str] | None = None, per_page: int = 100, as_of: str | None = None) -> DataFrame:
    """Items of working papers from pages by program; a paper of several programs is that of the last one, in the order of
    `programs`, or without them of the programs' names."""
    if programs is not None:
        pages = pages.filter(F.col("query").isin(*programs))
    rows = entries(pages, "results", _WORKING, per_page)
    at = F.col("query") if programs is None else F.array_position(F.array(*map(F.lit, programs)), F.col("query"))
    return working_paper_items(rows.select("e.*", F.struct(at.alias("at"), "page", "place").alias("load_order")), as_of)


def program_papers(pages: DataFrame, program: str, per_page: int = 100, as_of: str | None = None) -> DataFrame:
    """One program's working papers."""
    return working_papers(pages, [program], per_page, as_of)


def prefix_works(pages: DataFrame, prefix: str, since: str, source: str, rows: int = 60) -> DataFrame:
    """Items of works whose DOI has a prefix and that were created since a day, the newest `rows` of each query.

    Pages are first pages of works; a query whose page failed gives nothing.  A work found by several queries stands there
    for each, as the collectors' union drops repeats.
    """
    e = entries(pages, "message.items", _CROSSREF)
    parts = F.get(F.col("e.created.date-parts"), F.lit(0))
    created = F.concat_ws("-", F.lpad(F.get(parts, F.lit(0)).cast("string"), 4, "0"), F.lpad(F.coalesce(F.get(parts, F.lit(1)), F.lit(1)).cast("string"), 2, "0"), F.lpad(F.coalesce(F.get(parts, F.lit(2)), F.lit(1)).cast("string"), 2, "0"))
    own = e.withColumn("__day", created).filter(F.startswith(F.lower("e.DOI"), F.lit(f"{prefix.lower()}/")) & (F.col("__day") >= since))
    w = Window.partitionBy("query").orderBy(F.desc("__day"), "place")
    newest = own.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= rows)
    return crossref_items(newest.select("e.*"), F.lit(source), F.lit("3"))


def keyword_papers(pages: DataFrame, since: str, limit: int = 40) -> DataFrame:
    """Items of the papers published since a day that keyword searches found, `limit` of each search."""
    e = entries(pages, "data", _PAPER).filter(filled(F.col("e.publicationDate")) >= since)
    w = Window.partitionBy("query").orderBy("page", "place")
    return paper_items(e.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= limit).select("e.*"))
