"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Each rule rejects documents whose statistic lies above a cutoff.  Documents labelled good form the holdout: for every
stratum, rule and cutoff of a fixed grid the exact binomial tail tells whether the share of good documents that the
cutoff would reject can be as high as `risk`.  A rule's cutoffs are tested in a fixed sequence, from lax to strict, up to
the first failure, so only rules and strata need a Bonferroni correction: the chance that any certified cutoff breaks
its bound is below `delta`.  The strictest certified cutoff is used, and none if none is certified.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, apart, materialise

#: Highest share of good documents that one rule may reject in a stratum, and the chance that this is ever exceeded.
RISK, DELTA = 0.005, 0.05
#: Statistics, each with its grid of cutoffs, from strict to lax.
GRID = {
    "symbol_share": [i / 200 for i in range(1, 101)],
    "dup_line_share": [i / 100 for i in range(1, 91)],
    "repeat_share": [i / 100 for i in range(1, 51)],
    "upper_share": [i / 100 for i in range(5, 100)],
}
BASE_WORDS, BASE_REPEAT_PERCENT = 50, 50


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """How many of the words stand in 3-word windows that occur at least twice."""
    def covered(starts: Column) -> Column:
        # a window adds the words that no earlier flagged window has
        return F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                           lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")))["n"]

    def among(sorted_windows: Column) -> Column:
        last = F.size(sorted_windows) - 1
        marked = F.transform(sorted_windows, lambda x, k: F.when(
            ((k > 0) & (F.get(sorted_windows, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(sorted_windows, k + 1)["h"] == x["h"])), x["i"]))
        return covered(F.sort_array(F.filter(marked, lambda i: i.isNotNull())))

    def starts(w: Column) -> Column:
        return F.sequence(F.lit(0), F.size(w) - 3)

    def window(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]

    # different hashes tell that no window repeats; where some agree, the words themselves are compared (none has a space)
    hashes = F.transform(starts(words), lambda i: F.xxhash64(*window(words, i)))
    some = _let(F.sort_array(F.transform(starts(words), lambda i: F.struct(F.concat_ws(" ", *window(words, i)).alias("h"), i.alias("i")))), among)
    different = _let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when((F.size(words) < 3) | different, F.lit(0)).otherwise(some)


def text_statistics(df: DataFrame, text: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) and base_failed of `text`.

    A null text counts as empty: all zero and failed.  Columns of these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"), _repeated(w).cast("long").alias("repeated"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))

    out = df.withColumns({
        "__words": _let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), of_words),
        "__lines": _let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)), of_lines),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "upper_chars": F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long"),
    })
    out = out.withColumns({
        "n_words": F.col("__words.n"), "word_chars": F.col("__words.chars"), "n_repeat_words": F.col("__words.repeated"),
        "n_dup_lines": F.col("__lines.dup"), "n_lines": F.col("__lines.n"),
    }).drop("__words", "__lines")
    return out.withColumn("base_failed", (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words")))


#: The rules' statistics as shares of two counts.
SHARES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("upper_chars", "word_chars"),
}
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "upper_chars", "n_lines", "base_failed"]


def _share(rule: str) -> Column:
    over, under = SHARES[rule]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(0.0)


def _above(rule: str) -> Column:
    """How many cutoffs of the rule's grid its statistic lies above."""
    value = _share(rule)
    return F.aggregate(F.array(*map(F.lit, GRID[rule])), F.lit(0), lambda n, c: n + (value > c).cast("int"))


def _ln_factorial(n: Column) -> Column:
    """ln n! for n >= 0 by Stirling's series, moved up by 8."""
    z = n + 9.0
    tail = (((-1 / 1680) / (z * z) + 1 / 1260) / (z * z) - 1 / 360) / (z * z) + 1 / 12
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + tail / z
    down = F.lit(0.0)
    for i in range(1, 9):
        down = down + F.ln(n + float(i))
    return series - down


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial X with n trials; 1 where k > n p, which no bound below one half needs.

    Terms are added from k downwards, where they fall; 10 standard deviations on they are below 1e-20 of the sum.
    """
    top = _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(10 * F.sqrt(n * p)) + 100)
    terms = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.greatest(steps - 1, F.lit(0).cast("long"))),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda acc, i: _let(acc["term"] * (k - i) * (1 - p) / ((n - k + i + 1) * p), lambda t: F.struct(t.alias("term"), (acc["sum"] + t).alias("sum"))))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(top) * terms["sum"])


def _key(stratum: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("n"))


def certify(statistics: DataFrame, labels: DataFrame, id_col: str, stratum: str, good: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row for each stratum of the holdout: the certified cutoff of every rule (null: none).

    `statistics` has text_statistics' columns, `labels` the id and `good` (1: must not be rejected).  The holdout are
    the labelled good rows that the base rules pass; repeated labels of an id count once.  A null stratum is one of its
    own; columns `stratum` of the result start with "s", but that one's is "n".  Only counts of grid cells are shuffled, aggregated beforehand.
    """
    marked = labels.filter((F.col(good) == 1) & F.col(id_col).isNotNull()).select(id_col).distinct()
    held = statistics.filter("not base_failed").join(marked, id_col, "left_semi").withColumn("stratum", _key(stratum))
    cells = F.array(*[F.struct(F.lit(rule).alias("rule"), _above(rule).alias("above")) for rule, grid in GRID.items()])
    counted = held.select("stratum", F.explode(cells).alias("c")).groupBy("stratum", "c.rule", "c.above").count()
    grid = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("place"), F.lit(c).alias("cutoff")) for rule, g in GRID.items() for i, c in enumerate(g)])
    strata = counted.filter(F.col("rule") == "symbol_share").groupBy("stratum").agg(F.sum("count").alias("n"))
    tests = strata.select("stratum", "n", F.explode(grid).alias("g")).select("stratum", "n", "g.*")
    rejected = tests.join(counted, ["stratum", "rule"]).groupBy("stratum", "rule", "cutoff", "n").agg(F.sum(F.when(F.col("above") > F.col("place"), F.col("count")).otherwise(0)).alias("k"))
    # a stricter cutoff rejects no fewer, so those certified are just the ones before the first failure
    number = strata.agg((F.count("*") * len(GRID)).alias("m"))
    safe = rejected.crossJoin(F.broadcast(number)).filter(binomial_tail(F.col("k"), F.col("n"), risk) <= delta / F.col("m"))
    return safe.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"max_{rule}") for rule in GRID])


def risk_controlled(df: DataFrame, id_col: str, text: str, stratum: str, labels: DataFrame, good: str = "quality", keep_text: bool = False) -> DataFrame:
    """`df`'s id and stratum (all columns with `keep_text`), the statistics, and `kept`: passes the base rules and every certified one.

    Strata without a certified cutoff keep all that the base rules keep.  Rows with a null id or stratum are judged
    like others.  Statistics are written once and read by both the calibration and the verdict.  Of the columns carried,
    those named like a new one are replaced.
    """
    own, name = apart(df)
    marked = labels.select(F.col(id_col).alias(name[id_col]), F.col(good).alias("good"))
    carried = df.columns if keep_text else [id_col, stratum]
    work = materialise(text_statistics(own, name[text]).select(*{name[c]: None for c in [*carried, id_col, stratum]}, *STATISTICS))
    cutoffs = materialise(certify(work, marked, name[id_col], name[stratum], "good"))
    judged = work.withColumn("__stratum", _key(name[stratum])).join(cutoffs.withColumnRenamed("stratum", "__stratum"), "__stratum", "left")
    broken = F.lit(False)
    for rule in GRID:
        broken = broken | F.coalesce(_share(rule) > F.col(f"max_{rule}"), F.lit(False))
    new = {c: F.col(c) for c in STATISTICS} | {"kept": ~F.col("base_failed") & ~broken}
    return judged.select(*[F.col(name[c]).alias(c) for c in carried if c not in new], *[v.alias(c) for c, v in new.items()])


def keep_good(df: DataFrame, id_col: str, text: str, stratum: str, labels: DataFrame, good: str = "quality") -> DataFrame:
    """The rows of `df` that `risk_controlled` keeps, with their columns as they are."""
    own, name = apart(df)
    out = risk_controlled(own, name[id_col], name[text], name[stratum], labels.select(F.col(id_col).alias(name[id_col]), F.col(good).alias("__good")), "__good", keep_text=True)
    return out.filter("kept").select(*name.values()).toDF(*df.columns)
