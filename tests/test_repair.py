"""Repair by field provenance: the sources' order, odd rows, empty tables, titles that only look alike."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import ids
from paperloom.operators import repair
from paperloom.operators.repair import Source

FIELDS = {"doi": "string", "n": "long", "tags": "array<string>"}


def rows(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_sources_fill_what_is_missing(spark):
    wanted = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (4, "d"), (None, "e")], "k long, t string")
    seen = []

    def source(*made):
        def ask(asked):
            seen.append(sorted(r["k"] for r in asked.collect()))
            return spark.createDataFrame(list(made), "k long, doi string, n long, tags array<string>")
        return ask

    sources = [Source("one", source((1, "x", 0, []), (2, "", None, ["t"]), (2, "", None, ["t"]), (9, "z", 1, ["u"])), ["doi", "n", "tags"]),
               Source("two", source((1, "no", 7, ["v"]), (2, "y", 5, ["w"]), (3, "y", 5, ["w"])), ["doi", "tags"], ["doi"]),
               Source("three", source((3, "q", 3, None), (None, "q", 3, None)), ["n", "doi"])]
    got = rows(repair.in_turn(wanted, "k", FIELDS, sources))
    assert seen == [[1, 2, 3, 4], [2, 3, 4], [1, 2, 3, 4]]
    assert got == {1: ("x", 0, None, {"doi": "one", "n": "one"}), 2: ("y", None, ["t"], {"doi": "two", "tags": "one"}), 3: ("y", 3, ["w"], {"doi": "two", "tags": "two", "n": "three"}), 4: (None, None, None, {})}
    none = repair.in_turn(wanted.limit(0), "k", FIELDS, sources)
    assert none.count() == 0 and repair.rates(none, ["doi"]).first().asDict() == {"wanted": 0, "fixed": 0, "gained_doi": 0}
    assert repair.rates(repair.in_turn(wanted, "k", FIELDS, sources), ["n"]).first().asDict() == {"wanted": 4, "fixed": 3, "gained_n": 2}
    assert rows(repair.in_turn(wanted, "k", FIELDS, []))[1] == (None, None, None, {})


def test_repair_replaces_only_by_what_is_found(spark):
    items = spark.createDataFrame([(1, "old", 4, True), (2, "old", None, False), (3, None, 6, None)], "k long, doi string, n long, wanted boolean")
    ask = lambda asked: asked.select("k", F.lit("new").alias("doi"), F.lit(None).cast("long").alias("n"))
    new, found = repair.repaired(items, "k", F.col("wanted"), {"doi": "string", "n": "long"}, [Source("s", ask, ["doi", "n"])])
    assert {k: v[:2] for k, v in rows(new).items()} == {1: ("new", 4), 2: ("old", None), 3: (None, 6)} and list(rows(found)) == [1]


@pytest.mark.parametrize("wanted, found, same", [
    ("The Value Premium!", "the value  premium", True), ("Short title", "Short title and more", False), ("A long title of some twenty-six letters", "A long title of some twenty six letters: reply", True),
    ("A long title of some twenty-six letters", "Some", True), ("", "", False), (None, None, False), ("A long title of some twenty-six letters", "!!", False)])
def test_same_work(spark, wanted, found, same):
    df = spark.createDataFrame([(wanted, found)], "a string, b string")
    assert df.select(repair.same_work(F.col("a"), F.col("b"))).first()[0] is same


def test_first_hit_by_year_and_place(spark):
    asked = spark.createDataFrame([(1, "On x", "2000"), (2, "On x", None), (3, "On x", "n/a"), (4, None, "2000")], "k long, title string, year string")
    hits = spark.createDataFrame([(k, p, "On X", y) for k in (1, 2, 3, 4) for p, y in ((0, 1996), (1, 2003), (2, 2000), (2, 2000))], "k long, place int, title string, year int")
    assert {k: v[0] for k, v in rows(repair.first_hit(asked, hits, "k", "place").select("k", "place")).items()} == {1: 1, 2: 0, 3: 0}
    assert repair.first_hit(asked, hits.limit(0), "k", "place").count() == 0


def test_working_papers(spark):
    failed = spark.createDataFrame([(1, "Held here", "A Roe", "1990"), (2, "Elsewhere", "Jo Roe; X Poe", "1990"), (3, "Elsewhere", None, None), (4, "Elsewhere", "A Roe", "1990"), (5, None, None, None), (6, "Elsewhere", "", "1990")],
                                   "k long, title string, authors string, year string")
    own = spark.createDataFrame([("held HERE", "w12", 0), ("Held here", "w7", 1), ("Held here", None, 2), (None, "w3", 0)], "title string, wp string, place int")
    hits = spark.createDataFrame([(k, p, "Elsewhere", y, names, pdf) for k in (2, 3, 4, 5, 6) for p, y, names, pdf in ((0, 1990, None, None), (1, 1970, ["Doe"], "other"), (2, 1970, ["Poe"], "by name"), (2, 1970, ["Poe"], "by name"))],
                                 "k long, place int, title string, year int, names array<string>, pdf string")
    heads = spark.createDataFrame([("by name", bytearray(b"%PDF-1")), ("by name", bytearray(b"%PDF-2")), ("other", bytearray(b"<a>")), (None, None)], "url string, head binary")
    got = rows(repair.working_papers(failed, "k", own, hits, heads))
    archive = "https://www.nber.org/system/files/working_papers/w7/w7.pdf"
    assert got == {1: (archive, "archive", False), 2: ("by name", "open copy", True), 3: ("other", "open copy", False), 4: (None, None, False), 5: (None, None, False), 6: (None, None, False)}
    probed = repair.working_papers(failed, "k", own, hits, heads)
    assert tuple(repair.hit_rate(probed).first()) == (6, 1, pytest.approx(100 / 6)) and tuple(repair.hit_rate(probed.limit(0)).first()) == (0, 0, 0.0)
    assert {v for v, *_ in rows(repair.working_papers(failed, "k", own.limit(0), hits.limit(0), heads.limit(0))).values()} == {None}


@pytest.mark.parametrize("uid, url, link", [
    ("t:1", "http://ARXIV.org/abs/2401.1v2?x", "2401.1v2"), ("arxiv:2401.2", "x", "2401.2"), ("arxiv:2401.2", "https://arxiv.org/abs/9", "9"), ("t:1", "x?h=RePEc:arx:papers:2401.3&y", "2401.3")])
def test_links_to_preprints(spark, uid, url, link):
    assert spark.range(1).select(ids.free_link(F.lit(uid), F.lit(url))).first()[0] == f"https://arxiv.org/pdf/{link}"


def test_free_copies(spark):
    items = spark.createDataFrame([("doi:10.1/X", None, None, " "), ("t:1", "", "A title long enough", None), ("t:2", "", "A title long enough", None), ("t:3", "", "short", None), ("t:4", "a.pdfx", None, None), ("t:5", "a.pdf?x", None, None), (None, "b.pdf", None, None)],
                                  "uid string, url string, title string, doi string")
    named = spark.createDataFrame([("t:1", "", "https://doi.org/10.1/Y"), ("t:2", "t.pdf", "10.1/x"), ("t:3", "t.pdf", ""), ("t:4", "t.pdf", ""), (None, "q", "q")], "uid string, pdf string, doi string")
    one = spark.createDataFrame([("10.1/x", 1, "late"), ("10.1/X", 0, "early"), ("10.1/y", 0, " "), (None, 0, "null")], "doi string, place int, pdf string")
    two = spark.createDataFrame([("10.1/x", 0, "two"), ("10.1/y", 0, "y")], "doi string, place int, pdf string")
    got = rows(repair.free_copies(items, "uid", named, [("one", one), ("two", two)]))
    assert got == {"doi:10.1/X": ("early", "one"), "t:1": ("y", "two"), "t:2": ("t.pdf", "title"), "t:3": (None, None), "t:4": (None, None), "t:5": ("a.pdf?x", "derived")}
    assert repair.free_copies(items.limit(0), "uid", named, [("one", one)]).count() == 0
    assert rows(repair.free_copies(items, "uid", named.limit(0), []))["t:1"] == (None, None)
