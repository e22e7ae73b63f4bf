"""Repair by field provenance: which source filled which field, the first before the second, and what is still missing.

Sources are functions from the rows that they are asked for to records, so that recorded replies, another table and a
service behind `with_model` serve alike.  What each source gives is written before the next one is asked.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import ids
from paperloom.functions.text import blank, filled, surnames, title_key
from paperloom.session import materialise

from .dedup import keep_first
from .state import is_empty, patch


@dataclass(frozen=True)
class Source:
    """`ask` maps the rows that it is asked for to at most one record of each key (of several, any one counts).

    `gives`: the fields taken from it.  `unless`: fields one of which, once found, makes asking needless; none: always.
    """

    name: str
    ask: Callable[[DataFrame], DataFrame]
    gives: list[str]
    unless: list[str] = field(default_factory=list)


def in_turn(wanted: DataFrame, key: str, fields: dict[str, str], sources: list[Source]) -> DataFrame:
    """(key, fields, filled_by): for every wanted key what the sources give in turn, with the source of each field.

    `fields`: name to type.  A field stays with the first source that has a value for it (null, the empty text and the
    empty array are none; 0 and false are values).  A source sees the wanted rows that it isn't needless for, as they
    were.  Null keys are left out, repeated keys are asked for once; keys of which nothing is found have null fields and
    an empty map.
    """
    known = wanted.filter(F.col(key).isNotNull()).dropDuplicates([key])
    found = known.select(key, *[F.lit(None).cast(kind).alias(name) for name, kind in fields.items()], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("filled_by"))
    for source in sources:
        needless = F.lit(False)
        for name in source.unless:
            needless |= ~is_empty(F.col(name), fields[name])
        asked = known.join(found.filter(~needless).select(key), key, "left_semi")
        got = source.ask(asked).select(key, *[F.col(c).cast(fields[c]).alias(f"__{c}") for c in source.gives]).dropDuplicates([key])
        got = got.join(asked.select(key), key, "left_semi")
        takes = {c: is_empty(F.col(c), fields[c]) & ~is_empty(F.col(f"__{c}"), fields[c]) for c in source.gives}
        told = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(c).alias("key"), F.lit(source.name).alias("value"))) for c, t in takes.items()]))
        joined = found.join(got, key, "left")
        found = materialise(joined.select(key, *[F.when(takes[c], F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in takes else F.col(c) for c in fields], F.map_concat("filled_by", F.map_from_entries(told)).alias("filled_by")))
    return found


def repaired(items: DataFrame, key: str, wanted: Column, fields: dict[str, str], sources: list[Source]) -> tuple[DataFrame, DataFrame]:
    """(the items with what was found for those `wanted`, the provenance (key, fields, filled_by) of these).

    What is found replaces what an item has; nothing that is found empty does.  A null condition counts as not wanted.
    """
    found = in_turn(items.filter(F.coalesce(wanted, F.lit(False))), key, fields, sources)
    return patch(items, found.drop("filled_by"), key), found


def rates(found: DataFrame, fields: list[str]) -> DataFrame:
    """One row: wanted, fixed (keys with any field) and gained_<field>, over provenance rows; zeros if there are none."""
    has = lambda c: F.coalesce(F.map_contains_key("filled_by", F.lit(c)), F.lit(False))
    return found.agg(F.count("*").alias("wanted"), F.count_if(F.size("filled_by") > 0).alias("fixed"), *[F.count_if(has(c)).alias(f"gained_{c}") for c in fields])


def same_work(wanted: Column, found: Column, least: int = 25) -> Column:
    """Whether two titles are the same by their keys, or either holds the other and the wanted one has more than `least`
    characters; blank titles match nothing."""
    a, b = title_key(wanted), title_key(found)
    return (a != "") & (b != "") & ((a == b) | ((F.length(a) > least) & (F.contains(b, a) | F.contains(a, b))))


def first_hit(asked: DataFrame, hits: DataFrame, key: str, place: str, years: int = 3) -> DataFrame:
    """The first of each key's hits (key, place, title, year, more) that is the same work (`same_work`) and, where both
    years are known, at most `years` off.  `asked`: key, title, year."""
    want = asked.select(key, F.col("title").alias("__title"), F.col("year").try_cast("int").alias("__year"))
    near = F.coalesce(F.abs(F.col("year").try_cast("int") - F.col("__year")) <= years, F.lit(True))
    ok = hits.join(want, key).filter(same_work(F.col("__title"), F.col("title")) & near).drop("__title", "__year")
    return keep_first(ok, [key], [F.col(place), F.col("title")])


#: Fields that the repair of classics finds.
CLASSIC = {"doi": "string", "url": "string", "abstract": "string", "authors": "string", "journal": "string", "cites": "long"}


def repair_classics(items: DataFrame, key: str, registry: DataFrame, index: DataFrame, most: int = 6000) -> tuple[DataFrame, DataFrame]:
    """(items, provenance) of classics without a DOI, looked up by title in the hits of two services.

    items: key, title, year, classic and the fields of CLASSIC.  registry: hits (key, place, title, year, doi, abstract,
    authors, journal, cites); it is asked first, its abstracts lose their tags, and its DOI also gives a link to items
    that lack one.  index: hits (key, place, title, year, doi, abstract); it is asked only for those of which the first
    gave no abstract, and fills no other gap than DOI and abstract.  Abstracts keep `most` characters.
    """
    plain = F.substring(F.trim(F.regexp_replace(F.regexp_replace(filled(F.col("abstract")), "<[^>]+>", " "), r"\s+", " ")), 1, most)

    def first(rows):
        hit = first_hit(rows, registry, key, "place").withColumns({"abstract": plain, "authors": F.substring("authors", 1, 300)})
        linkless = rows.select(key, blank(F.col("url")).alias("__linkless"))
        return hit.join(linkless, key).withColumn("url", F.when(F.col("__linkless") & ~blank(F.col("doi")), F.concat(F.lit("https://doi.org/"), "doi")))

    def second(rows):
        return first_hit(rows, index, key, "place").withColumns({"doi": F.replace("doi", F.lit("https://doi.org/"), F.lit("")), "abstract": F.substring("abstract", 1, most)})

    sources = [Source("registry", first, list(CLASSIC)), Source("index", second, ["doi", "abstract"], ["abstract"])]
    return repaired(items, key, F.col("classic") & blank(F.col("doi")), CLASSIC, sources)


def working_papers(failed: DataFrame, key: str, own: DataFrame, hits: DataFrame, heads: DataFrame, years: int = 6) -> DataFrame:
    """(key, url, route, verified) of articles without a reachable file: a free working-paper version of each, if any.

    failed: key, title, authors, year.  own: (title, wp, place) of working papers held, matched by the whole title, the
    last one counts (`archive`).  hits: (key, place, title, year, names: array of surnames, pdf), every record of which is
    tried, not only the best (`open copy`): the same title, or one that holds a wanted one of more than 25 characters;
    then a year at most `years` off, else a shared surname where both have names, else no wanted year to contradict.
    heads: (url, head) the first bytes behind a link; verified if they are %PDF.  Blank titles match nothing.
    """
    title = title_key(F.col("title"))
    known = own.filter(~blank(F.col("wp"))).select(title.alias("__t"), F.regexp_replace("wp", "^w+", "").alias("__wp"), "place").filter("__t <> ''")
    last = known.groupBy("__t").agg(F.max_by("__wp", F.struct("place", "__wp")).alias("__wp"))
    link = F.concat(F.lit("https://www.nber.org/system/files/working_papers/w"), "__wp", F.lit("/w"), "__wp", F.lit(".pdf"))
    archive = lambda rows: rows.withColumn("__t", title).join(last, "__t").select(key, link.alias("url"))

    def copies(rows):
        want = rows.select(key, title.alias("__a"), F.col("year").try_cast("int").alias("__year"), blank(F.col("year").cast("string")).alias("__undated"), surnames(F.col("authors")).alias("__names"))
        j = hits.withColumns({"__b": title, "__got": F.col("year").try_cast("int"), "__has": F.coalesce("names", F.array().cast("array<string>"))}).drop("title", "year").join(want, key)
        same = (F.col("__a") != "") & ((F.col("__a") == F.col("__b")) | ((F.length("__a") > 25) & F.contains("__b", F.col("__a"))))
        near = F.coalesce(F.abs(F.col("__got") - F.col("__year")) <= years, F.lit(False))
        named = (F.size("__names") > 0) & (F.size("__has") > 0)
        fits = near | F.when(named, F.arrays_overlap("__names", F.transform("__has", F.lower))).otherwise(F.col("__undated"))
        return keep_first(j.filter(same & fits & ~blank(F.col("pdf"))), [key], [F.col("place"), F.col("pdf")]).select(key, F.col("pdf").alias("url"))

    found = in_turn(failed, key, {"url": "string"}, [Source("archive", archive, ["url"]), Source("open copy", copies, ["url"], ["url"])])
    good = heads.filter(F.startswith(F.col("head").cast("binary"), F.lit(b"%PDF"))).select("url").distinct().withColumn("__ok", F.lit(True))
    return found.join(good, "url", "left").select(key, "url", F.col("filled_by")["url"].alias("route"), F.coalesce("__ok", F.lit(False)).alias("verified"))


def hit_rate(probed: DataFrame) -> DataFrame:
    """One row: probed, hits (links that are verified) and percent, 0 if nothing was probed."""
    return probed.agg(F.count("*").alias("probed"), F.count_if("verified").alias("hits")).withColumn("percent", F.coalesce(F.try_divide(100 * F.col("hits"), F.col("probed")), F.lit(0.0)))


def free_copies(items: DataFrame, key: str, named: DataFrame, routes: list[tuple[str, DataFrame]], least: int = 15) -> DataFrame:
    """(key, link, route): where the full text of each item is; nulls if no route knows one.

    items: key (a paper's uid), url, title, doi.  The key or the page's link give it away (`derived`); else the item's own
    DOI, that in its key, or, of titles of `least` characters or more, what `named` (key, pdf, doi) says is asked for in
    `routes` (name, (doi, place, pdf)), one after the other, each only for what is still missing; ids are compared
    without case.  A PDF that `named` has itself comes before its DOI (`title`).
    """
    item = items.select(key, F.col("url").alias("__url"), "title", F.col("doi").alias("__doi"))
    own = F.coalesce(F.when(~blank(F.col("__doi")), F.trim("__doi")), F.when(F.startswith(F.col(key), F.lit("doi:")), F.substr(F.col(key), F.lit(5))))
    derived = lambda rows: rows.select(key, ids.free_link(F.col(key), F.col("__url")).alias("link"))
    by_title = named.select(key, F.nullif("pdf", F.lit("")).alias("__pdf"), F.replace(F.nullif("doi", F.lit("")), F.lit("https://doi.org/"), F.lit("")).alias("__found")).dropDuplicates([key])
    asked = item.withColumn("__own", own).join(by_title, key, "left").withColumn("__apt", F.col("__own").isNull() & (F.length("title") >= least))
    asked = asked.withColumn("__id", F.lower(F.coalesce("__own", F.when(F.col("__apt") & F.col("__pdf").isNull(), F.col("__found")))))

    def route(table):
        first = keep_first(table.filter(~blank(F.col("pdf"))).withColumn("__id", F.lower("doi")), ["__id"], [F.col("place"), F.col("pdf")])
        return lambda rows: rows.join(first.select("__id", F.col("pdf").alias("link")), "__id").select(key, "link")

    title = lambda rows: rows.filter("__apt").select(key, F.col("__pdf").alias("link"))
    sources = [Source("derived", derived, ["link"]), Source("title", title, ["link"], ["link"]), *[Source(name, route(table), ["link"], ["link"]) for name, table in routes]]
    found = in_turn(asked, key, {"link": "string"}, sources)
    return found.select(key, "link", F.col("filled_by")["link"].alias("route"))
