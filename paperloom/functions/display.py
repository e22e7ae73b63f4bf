"""Column functions for lists, prompts and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, filled, shorten, squeeze, unescape


def category(tier: Column, section: Column) -> Column:
    """0 and 1 for the journal tiers, 3 for practitioners, else 2."""
    return F.when(tier == "T1", 0).when(tier == "T2", 1).when(section.cast("string") == "4", 3).otherwise(2)


def citations_per_year(cites: Column, year: Column, as_of: Column) -> Column:
    """Citations over the years since publication, this one included; one decimal."""
    return F.round(cites / F.greatest(F.lit(1), F.year(as_of) - year + 1), 1)


def escape_html(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def meta_abstract(html: Column, least: int = 80, most: int = 1500) -> Column:
    """The first description tag of a page with more than `least` characters; null if none."""
    names = ("citation_abstract", "dc.description", "og:description", "description")
    found = [squeeze(unescape(F.regexp_extract(filled(html), rf'(?is)<meta[^>]+(?:name|property)="{n}"[^>]+content="([^"]*)"', 1))) for n in names]
    return F.substring(F.coalesce(*[F.when(F.length(x) > least, x) for x in found]), 1, most)


def depth_label(has_passages: Column, abstract: Column) -> Column:
    return F.when(has_passages, "full").when(~blank(abstract), "abstract").otherwise("summary_only")


def context_line(place: Column, title: Column, authors: Column, date: Column, depth: Column, body: Column) -> Column:
    """One numbered source of a context block."""
    return F.concat(F.lit("["), place.cast("string"), F.lit("] "), F.concat_ws(" | ", title, authors, date, F.concat(F.lit("depth: "), depth)), F.lit("\n"), filled(body))


def cited_numbers(answer: Column) -> Column:
    """Distinct source numbers that an answer cites as [n], in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(filled(answer), F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))))


def batch_line(place: Column, title: Column, abstract: Column) -> Column:
    """One indexed entry of a batch prompt."""
    return F.concat(place.cast("string"), F.lit(". "), filled(title), F.lit("\n"), F.substring(squeeze(abstract), 1, 500))


def chat_title(question: Column) -> Column:
    return shorten(squeeze(question), 52)
