"""Readers that turn feeds and API replies into item columns.  Every one reads through Spark, from any store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import dates, text

ITEM_COLUMNS = ["title", "authors", "abstract", "url", "date", "source", "section", "doi", "arxiv_id"]
_CROSSREF = ("DOI string, URL string, title array<string>, abstract string, type string, `container-title` array<string>, `is-referenced-by-count` int, "
             "author array<struct<given: string, family: string>>, published struct<`date-parts`: array<array<int>>>, issued struct<`date-parts`: array<array<int>>>, created struct<`date-parts`: array<array<int>>>")
_OPENALEX = ("id string, doi string, title string, display_name string, publication_date string, publication_year int, cited_by_count int, "
             "authorships array<struct<author: struct<id: string, display_name: string>>>, abstract_inverted_index map<string, array<int>>, "
             "primary_location struct<landing_page_url: string, source: struct<display_name: string>>")

_WORKING = "title string, authors array<string>, abstract string, displaydate string, url string"
_PAPER = ("title string, abstract string, url string, publicationDate string, authors array<struct<name: string>>, externalIds struct<DOI: string, ArXiv: string>")


def _item(df: DataFrame, **columns: Column) -> DataFrame:
    """The item columns in order, those not given as null texts, then any others."""
    none = F.lit(None).cast("string")
    extra = [c for c in columns if c not in ITEM_COLUMNS]
    return df.select(*[columns.get(c, none).alias(c) for c in ITEM_COLUMNS], *[columns[c].alias(c) for c in extra])


def _first_people(people: Column, name, n: int = 4) -> Column:
    return F.array_join(F.transform(F.slice(people, 1, n), name), ", ")


def rss(spark: SparkSession, path: str, source: str | Column, section: str, cutoff: str | None = None, keep_undated: bool = True, most: int | None = 600) -> DataFrame:
    """Items of RSS feeds; without a cutoff all are kept, and undated ones if wanted.

    `most`: characters of the description that are kept (None: all).  `source` may be a column, as `from_folder`.
    """
    raw = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    day = F.try_to_date(F.regexp_extract(F.coalesce("pubDate", F.lit("")), r"(\d{1,2} \w{3} \d{4})", 1), "d MMM yyyy")
    if cutoff is not None:
        raw = raw.filter((day >= cutoff) | (day.isNull() if keep_undated else F.lit(False)))
    arxiv = F.nullif(F.regexp_extract(F.lower(F.coalesce("link", F.lit(""))), r"(?:arxiv\.org/abs/|repec:arx:papers:)(\d{4}\.\d{4,5})", 1), F.lit(""))
    told = text.clean_html(F.col("description"))
    return _item(raw, title=text.clean_html(F.col("title")), abstract=told if most is None else F.substring(told, 1, most), url=F.trim("link"), date=F.coalesce(day.cast("string"), F.lit("")),
                 source=F.lit(source), section=F.lit(section), arxiv_id=arxiv)


def from_folder(name: str, before: str = "") -> Column:
    """The value of the folder `name=value` that a file lies in, after `before`: a source for each folder of feeds."""
    value = F.regexp_extract(F.col("_metadata.file_path"), f"/{name}=([^/]*)/", 1)
    for _ in range(2):  # Spark escapes the folder's name, and the path as a whole is a URI
        value = F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
    return F.concat(F.lit(before), value)


def atom(spark: SparkSession, path: str, source: str, section: str, cutoff: str, most: int = 200) -> DataFrame:
    """Entries of an Atom reply since the cutoff, the newest `most`; four authors at most."""
    schema = "id string, title string, summary string, published string, author array<struct<name: string>>"
    raw = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    new = raw.filter(F.substring("published", 1, 10) >= cutoff).orderBy(F.desc("published"), "id").limit(most)
    return _item(new, title=text.clean_html(F.col("title")), authors=_first_people(F.col("author"), lambda a: a["name"]), abstract=text.clean_html(F.col("summary")), url=F.col("id"), date=F.substring("published", 1, 10),
                 source=F.lit(source), section=F.lit(section), arxiv_id=F.regexp_extract("id", r"abs/(\d{4}\.\d{4,5})", 1))


def crossref(spark: SparkSession, path: str, source: str | Column, section: str = "3") -> DataFrame:
    """Works of a Crossref reply, one JSON object a line; works without a title are dropped, unknown citations stay null."""
    return crossref_items(spark.read.schema(_CROSSREF).json(path), F.lit(source), F.lit(section))


def crossref_items(works: DataFrame, source: Column, section: Column) -> DataFrame:
    """Works as Crossref has them, as items."""
    raw = works.filter(~text.blank(F.get("title", F.lit(0))))
    first = lambda c: F.get(F.col(f"{c}.date-parts"), F.lit(0))
    parts = F.coalesce(first("published"), first("issued"), first("created"))
    return _item(raw, title=text.clean_html(F.get("title", F.lit(0))), authors=_first_people(F.col("author"), lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), abstract=text.tidy(F.col("abstract"), 1500),
                 url=F.coalesce("URL", F.concat(F.lit("https://doi.org/"), "DOI")), date=F.coalesce(dates.parts_to_iso(parts), F.lit("")), source=source, section=section, doi=F.lower("DOI"),
                 cites=F.col("is-referenced-by-count"), journal=F.get("container-title", F.lit(0)), kind=F.col("type"))


def openalex(spark: SparkSession, path: str, source: str | Column, section: str) -> DataFrame:
    """Works of an OpenAlex reply: abstract from its inverted index, a missing day from the year."""
    raw = spark.read.schema(_OPENALEX).json(path)
    year = F.when(F.col("publication_year") > 0, F.concat(F.col("publication_year").cast("string"), F.lit("-01-01")))
    return _item(raw, title=F.coalesce("title", "display_name"), authors=_first_people(F.col("authorships"), lambda a: a["author"]["display_name"]), abstract=text.from_inverted_index(F.col("abstract_inverted_index")),
                 url=F.coalesce("primary_location.landing_page_url", "doi", "id"), date=F.coalesce("publication_date", year, F.lit("")), source=F.lit(source), section=F.lit(section), doi=F.lower(F.regexp_replace("doi", "^https?://doi.org/", "")),
                 cites=F.coalesce("cited_by_count", F.lit(0)), oa_author_ids=F.transform(F.slice("authorships", 1, 4), lambda a: F.element_at(F.split(a["author"]["id"], "/"), -1)))


def working_papers(spark: SparkSession, path: str) -> DataFrame:
    """Records of a working-paper API: the number is the link's last part, later pages replace earlier ones."""
    return working_paper_items(spark.read.schema(_WORKING + ", load_order long").json(path))


def working_paper_items(raw: DataFrame, as_of: str | None = None) -> DataFrame:
    """Records (with load_order) as items, each number once: the one loaded last; dates that can't be read are `as_of`."""
    wp = F.element_at(F.split("url", "/"), -1)
    last = raw.withColumn("nber_wp", wp).withColumn("__n", F.row_number().over(Window.partitionBy("nber_wp").orderBy(F.desc("load_order")))).filter("__n = 1")
    people = F.array_join(F.transform("authors", lambda a: text.clean_html(a)), ", ")
    day = F.coalesce(F.try_to_date(F.trim("displaydate"), "MMMM yyyy"), F.lit(as_of).cast("date"))
    return _item(last, title=text.clean_html(F.col("title")), authors=people, abstract=text.clean_html(F.col("abstract")), url=F.concat(F.lit("https://www.nber.org"), F.coalesce("url", F.lit(""))), date=day.cast("string"), source=F.lit("nber"), section=F.lit("1"), doi=F.concat(F.lit("10.3386/"), "nber_wp"), nber_wp=F.col("nber_wp"))


def newest_per_source(items: DataFrame, n: int) -> DataFrame:
    """The newest n items of every source."""
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("date"), "title", "url")
    return items.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def archive(spark: SparkSession, path: str) -> DataFrame:
    """Archived rows with `meta` as VARIANT; rows whose JSON can't be read are skipped."""
    rows = spark.read.parquet(path).withColumn("meta", F.try_parse_json("meta"))
    return rows.filter(F.col("meta").isNotNull())


def paper_items(papers: DataFrame, source: str = "semantic-scholar", section: str = "3") -> DataFrame:
    """Papers of a keyword search as items: four authors, 800 characters of the abstract, with their DOI and arXiv id."""
    return _item(papers, title=text.clean_html(F.col("title")), authors=_first_people(F.col("authors"), lambda a: a["name"]), abstract=F.substring(text.clean_html(F.col("abstract")), 1, 800), url=F.coalesce("url", F.lit("")),
                 date=F.coalesce("publicationDate", F.lit("")), source=F.lit(source), section=F.lit(section), doi=F.col("externalIds.DOI"), arxiv_id=F.col("externalIds.ArXiv"))
