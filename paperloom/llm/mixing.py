"""Mixing sources to target weights by entropy balancing, in DataFrame expressions only.

Every source has a target of words.  Among all rates whose words add up to it, and that stay within the cap, the ones
closest in relative entropy to taking each document once are min(cap, exp(lambda * size)), with one multiplier for each
source: the solution of a convex dual, found by Newton steps kept inside a bracket.  A step is one aggregation over
(source, size) counts.  Sums are decimal, so that the order of rows cannot change a result.  Rates become whole copies:
all documents get the whole part; those that come first in a fixed pseudo-random order also get one more, until the
source's words are reached.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, apart, materialise

WEIGHTS, CAP = (5, 2, 1), 3
#: The Newton steps end when every source is within this share of its target.
TOLERANCE = 1e-6
CELLS = 4096


def sized(df: DataFrame, id_col: str, text: str, source: str) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns renamed (and their new names), `source`, `size` (words of the text; null: 0) and `draw`, a
    fixed number in [0, 1) made of id and text."""
    own, name = apart(df)
    id_col, text = name[id_col], name[text]
    return own.withColumns({
        "source": F.col(name[source]),
        "size": F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long"),
        "draw": F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text)), 11) / float(1 << 53)}), name


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, s, source_size, target) of every source of `sizes` (source, size).

    Sources in code-point order, null last, get the weights in turn and share all words by them; no target is above
    `cap` times its source's words, and the excess goes to the others by weight.  Filling up in the order of
    cap * words / weight gives that in one pass: once a source isn't capped, none after it is.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("s") - 1) % len(weights) + 1).cast("int"))
    t = total.withColumn("s", number).withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("level", level).withColumn("capped", F.col("most") <= F.col("level") * F.col("weight"))
    shared = F.min(F.when(~F.col("capped"), F.struct(F.col("most") / F.col("weight"), "s", "level"))).over(everything)["level"]
    return t.select("source", "s", "source_size", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("weight") * shared).alias("target"))


def _rate(multiplier: Column, size: Column, mean: Column, cap: int) -> Column:
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(multiplier * size / mean, F.lit(50.0)))))


def balance(sizes: DataFrame, goal: DataFrame, cap: int = CAP) -> DataFrame:
    """`goal` (see targets) with `multiplier`, `mean` and `full` (everything taken `cap` times) of each source.

    Every sixteenth step halves the bracket, so the steps end.
    """
    cells = materialise(sizes.filter("size > 0").groupBy("source", "size").count())
    state = goal.join(cells.groupBy("source").agg((F.sum(F.col("size") * F.col("count")) / F.sum("count")).alias("mean")).withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    state = materialise(state.withColumns({
        "mean": F.coalesce("mean", F.lit(1.0)), "full": F.col("target") >= cap * F.col("source_size"), "multiplier": F.lit(0.0),
        "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "off": F.lit(None).cast("double")}))
    columns = state.columns

    numbered = materialise(cells.join(goal.select(F.col("source").alias("__s"), "s"), F.col("source").eqNullSafe(F.col("__s"))).select("s", "size", "count"))
    for number in count():
        mass = F.col("count") * F.col("size")
        rate = _rate(F.col("multiplier"), F.col("size"), F.col("mean"), cap)
        sums = numbered.join(state.select("s", "multiplier", "mean", "full"), "s").groupBy("s").agg(
            F.sum((mass * rate).cast("decimal(28,6)")).cast("double").alias("words"),
            F.sum(F.when(rate < cap, mass * rate * F.col("size") / F.col("mean")).otherwise(0.0).cast("decimal(28,6)")).cast("double").alias("slope"))
        x = F.col("multiplier")
        low = F.when(F.col("words") <= F.col("target"), x).otherwise(F.col("low"))
        high = F.when(F.col("words") > F.col("target"), x).otherwise(F.col("high"))
        step = x + F.try_divide(F.col("target") - F.col("words"), F.col("slope"))
        inside = step.isNotNull() & (F.col("low").isNull() | (step > F.col("low"))) & (F.col("high").isNull() | (step < F.col("high")))
        halved = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(F.col("high").isNull(), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        # done, too, once no number lies between the ends of the bracket
        met = (F.col("low") == F.col("high")) | ((F.col("low") + F.col("high")) / 2).isin(F.col("low"), F.col("high"))
        off = F.when(F.col("full") | F.coalesce(met, F.lit(False)), 0.0).otherwise(F.abs(F.col("words") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)))
        new = state.drop("off").join(sums, "s", "left").withColumns({"low": low, "high": high, "off": F.coalesce(off, F.lit(0.0))})
        moved = F.when(F.col("off") <= TOLERANCE, x).when(inside & (F.abs(step - x) < 20) & F.lit(number % 16 != 15), step).otherwise(halved)
        state = materialise(new.withColumn("multiplier", F.coalesce(moved, x)).select(*columns))
        if state.agg(F.max("off")).first()[0] is None or state.filter(F.col("off") > TOLERANCE).isEmpty():
            break
    return state.select("source", "s", "source_size", "target", "mean", "full", F.round("multiplier", 12).alias("multiplier"))


def _with_rate(df: DataFrame, plan: DataFrame, cap: int) -> DataFrame:
    """Join the plan by source (null-safe) and add the whole part of the rate and the place in the order of extras."""
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    out = df.withColumn("__key", key).join(plan.withColumn("__key", key).drop("source"), "__key").drop("__key")
    rate = _rate(F.col("multiplier"), F.col("size"), F.col("mean"), cap)
    out = out.withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    return out.withColumn("place", F.when(F.col("whole") < cap, F.col("draw") - (F.col("rate") - F.col("whole")))).withColumn("cell", F.floor((F.col("place") + 1) * (CELLS // 2)))


def plan_mix(rows: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """What every source needs to draw its mix: one row for each source of `rows` (source, size, draw).

    Extra copies go to the lowest `place`s until the target is reached.  Words by cell of the place find the cell where
    that happens; only that cell's rows are ordered.
    """
    plan = materialise(balance(rows, materialise(targets(rows, weights, cap)), cap))
    rated = _with_rate(rows, plan, cap)
    cells = materialise(rated.groupBy("s", "cell").agg(F.sum(F.col("whole") * F.col("size")).alias("base"), F.sum("size").alias("extra")))
    need = plan.select("s", "target").join(cells.groupBy("s").agg(F.sum("base").alias("base")), "s").select("s", (F.col("target") - F.col("base")).alias("need"))
    upto = F.sum("extra").over(Window.partitionBy("s").orderBy("cell"))
    filled = cells.filter("cell is not null and extra > 0").withColumn("upto", upto).join(need, "s")
    border = materialise(filled.filter("upto >= need").groupBy("s").agg(F.min_by(F.struct("cell", (F.col("need") - F.col("upto") + F.col("extra")).alias("left")), "cell").alias("b")).select("s", F.col("b.cell").alias("border"), "b.left"))
    inside = rated.filter("size > 0").select("s", "cell", "place", "size").join(border, "s").filter("cell = border")
    grouped = inside.groupBy("s", "place", "left").agg(F.sum("size").alias("size"))
    run = F.sum("size").over(Window.partitionBy("s").orderBy("place"))
    last = grouped.withColumn("run", run).filter("run - size / 2 <= left").groupBy("s").agg(F.max("place").alias("upto"))
    return materialise(plan.join(border.select("s", "border"), "s", "left").join(last, "s", "left"))


def apply_mix(rows: DataFrame, plan: DataFrame, cap: int = CAP) -> DataFrame:
    """Add source_size, target, rate, `copies` and `taken` (words) to `rows` (source, size, draw and any others)."""
    own = [c for c in rows.columns if c not in ("source_size", "target", "rate", "copies", "taken")]
    out = _with_rate(rows.select(*own), plan, cap)
    # without a border the target lies beyond all extras; without a last row the border's first is beyond it
    extra = F.col("place").isNotNull() & (F.col("border").isNull() | (F.col("cell") < F.col("border")) | ((F.col("cell") == F.col("border")) & F.coalesce(F.col("place") <= F.col("upto"), F.lit(False))))
    copies = F.col("whole") + extra.cast("long")
    return out.withColumn("copies", copies).select(*own, "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(df: DataFrame, id_col: str, text: str, source: str, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """`df` with size, source_size, target, rate, copies and taken of every row; columns of these names are replaced.

    `source` is a string column.  A null text has size 0, a null source is one of its own, null ids are like others, and
    rows that agree in id and text are taken alike.  Texts are read twice, for the plan and for the result; only sizes
    are written.
    """
    rows, name = sized(df, id_col, text, source)
    out = apply_mix(rows, plan_mix(materialise(rows.select("source", "size", "draw")), weights, cap), cap)
    new = ["size", "source_size", "target", "rate", "copies", "taken"]
    return out.select(*[F.col(n).alias(c) for c, n in name.items() if c not in new], *new)


def draw_mix(df: DataFrame, id_col: str, text: str, source: str, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Every row of `df` as often as its source's target takes it, which may be never; its columns as they are."""
    own, name = apart(df)
    out = mix(own, name[id_col], name[text], name[source], weights, cap)
    copy = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")
    return out.select(*name.values(), copy).drop("copy").toDF(*df.columns)
