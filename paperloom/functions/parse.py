"""Tolerant parsing of graded replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once: inside a lambda, Spark computes again whatever stands there twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def level(value: Column, fallback: int | None = 0) -> Column:
    """A grade from 0 to 3; numbers above 3 are percentages; anything unreadable, or not finite, is the fallback."""
    def clamped(n: Column) -> Column:
        scaled = F.when(n > 3, F.round(n / 100 * 3)).otherwise(n)
        return F.when(F.abs(n) < float("inf"), F.least(F.lit(3.0), F.greatest(F.lit(0.0), scaled)).cast("int")).otherwise(F.lit(fallback))

    return _let(F.round(value.cast("string").try_cast("double")), clamped)


def flag(value: Column) -> Column:
    """Three-valued: null-like texts are null, false-like ones false, all others true."""
    low = F.lower(F.trim(value))
    return F.when(low.isNull() | low.isin("", "null", "none", "unknown", "n/a"), F.lit(None).cast("boolean")).when(low.isin("false", "0", "no"), False).otherwise(True)


def one_of(value: Column, allowed: list[str], neutral: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(neutral)


def tags(value: Column, allowed: list[str], most: int = 3, rest: str = "other") -> Column:
    """Known tags without repeats and no more than `most`; `rest` if none is left."""
    known = F.array_distinct(F.filter(F.transform(value, lambda t: F.lower(F.trim(t))), lambda t: t.isin(*allowed) & (t != rest)))
    return _let(known, lambda k: F.when(F.coalesce(F.size(k), F.lit(0)) > 0, F.slice(k, 1, most)).otherwise(F.array(F.lit(rest))))


def _number(value: Column) -> Column:
    """A whole number, from a number or a text of one; null if there is none."""
    return F.trim(value).try_cast("double").try_cast("int")


def _axis(node: Column, fallback: Column, provisional: bool) -> Column:
    """struct of level and why (and provisional) from an object, or from a bare number or its text."""
    inside = F.coalesce(F.startswith(F.ltrim(node), F.lit("{")), F.lit(False))
    grade = F.when(inside, F.get_json_object(node, "$.level")).otherwise(node)
    fields = [F.coalesce(level(grade, None), fallback).alias("level"), F.when(inside, F.substring(F.trim(filled(F.get_json_object(node, "$.why"))), 1, 120)).otherwise("").alias("why")]
    if provisional:
        told = F.when(inside, F.lower(F.get_json_object(node, "$.provisional")))
        fields.append((~F.coalesce(told.isin("false", "0", "0.0", ""), F.lit(False))).alias("provisional"))
    return F.struct(*fields)


def graded(reply: Column, names: list[str], categories: dict[str, tuple[list[str], str]], allowed: list[str], *, alone: tuple[str, ...] = (), provisional: tuple[str, ...] = (),
           flags: tuple[str, ...] = (), topics: tuple[list[str], str] | None = None, summary: bool = False) -> Column:
    """A reply's array of graded items: i, the levels `names` (struct of level and why), `categories` and tags.

    Every entry is read by itself, so one that is no object, or has no whole number i, takes no other with it; of entries
    with one i the last counts.  A level is an object with level and why, or the bare level; one that is missing or
    unreadable takes the first level of the entry, or 0 if it is among `alone`.  Those among `provisional` also say whether
    they are, which is true if not told.  Categories outside their list get their neutral value; tags may be one bare
    text.  If asked for: `flags` are three-valued, `topic` is one of `topics` or its rest, and `summary` (or else why)
    has 280 characters at most.  A reply without a readable array gives no items.

    Every field of an entry is read once, and only of entries that count.
    """
    none = F.array().cast("array<string>")
    entries = F.coalesce(F.from_json(json_array(reply), "array<string>"), none)

    fields = list(dict.fromkeys([*names, *categories, "tags", *flags, *(["topic"] if topics is not None else []), *(["summary", "why"] if summary else [])]))
    raw = lambda r, name: r[f"f{fields.index(name)}"]

    def read(x: Column) -> Column:
        return F.struct(x["i"].alias("i"), *[F.get_json_object(x["entry"], f"$.{name}").alias(f"f{n}") for n, name in enumerate(fields)])

    def item(r: Column) -> Column:
        axis = lambda n, fallback: _axis(raw(r, n), fallback, n in provisional)
        kinds = [one_of(F.lower(F.trim(raw(r, c))), values, neutral).alias(c) for c, (values, neutral) in categories.items()]
        listed = raw(r, "tags")
        many = F.when(F.startswith(F.ltrim(listed), F.lit("[")), F.from_json(listed, "array<string>")).when(~_empty(listed), F.array(listed))
        rest = [flag(raw(r, f)).alias(f) for f in flags]
        if topics is not None:
            rest.append(one_of(F.trim(raw(r, "topic")), *topics).alias("topic"))
        if summary:
            said = F.coalesce(*[F.when(~_empty(c), c) for c in (raw(r, "summary"), raw(r, "why"))], F.lit(""))
            rest.append(F.substring(F.trim(said), 1, 280).alias("summary"))

        def whole(first: Column) -> Column:
            axes = [first.alias(names[0])] + [axis(n, F.lit(0) if n in alone else first["level"]).alias(n) for n in names[1:]]
            return F.struct(r["i"].alias("i"), *axes, *kinds, tags(many, allowed).alias("tags"), *rest)

        return _let(axis(names[0], F.lit(0)), whole)

    numbered = F.transform(entries, lambda x, n: F.struct(_number(F.get_json_object(x, "$.i")).alias("i"), n.alias("at"), x.alias("entry")))
    rows = F.sort_array(F.filter(numbered, lambda x: x["i"].isNotNull()))
    last = _let(rows, lambda xs: F.filter(xs, lambda x, n: ~x["i"].eqNullSafe(F.get(xs, n + 1)["i"])))
    in_order = F.sort_array(F.transform(last, lambda x: F.struct(x["at"], x["i"], x["entry"])))
    return F.transform(F.transform(in_order, read), item)


def _empty(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(True))


def findings(reply: Column) -> Column:
    """The findings of a reply's array: entries with a text `f`, with their paper number `p`."""
    rows = F.from_json(json_array(reply), "array<struct<p: int, f: string>>")
    return F.coalesce(F.filter(rows, lambda x: F.coalesce(F.trim(x["f"]), F.lit("")) != ""), F.array().cast("array<struct<p: int, f: string>>"))


def json_array(reply: Column) -> Column:
    """The text from the first "[" to the last "]", which may stand in prose; null if there is none."""
    return F.nullif(F.regexp_extract(filled(reply), r"(?s)(\[.*\])", 1), F.lit(""))
