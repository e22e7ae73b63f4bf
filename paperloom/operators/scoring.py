"""Posteriors, discounts, reputation and the composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the scoring model.
NOVELTY_PRIOR = {
    "Asset Pricing & Factor Models": 0.2136, "Portfolio Construction & Optimization": 0.102, "Market Efficiency & Behavioral": 0.1562, "Derivatives & Option Pricing": 0.1471,
    "Volatility Modeling": 0.1698, "Fixed Income & Credit": 0.125, "Market Microstructure & Liquidity": 0.1034, "Fund Performance & Institutional": 0.065,
    "Machine Learning in Finance": 0.197, "Financial Econometrics": 0.0614, "Macro & Monetary": 0.0106, "Other": 0.0016}
RELEVANCE_PRIOR = {
    "Asset Pricing & Factor Models": 0.6019, "Portfolio Construction & Optimization": 0.4696, "Market Efficiency & Behavioral": 0.2, "Derivatives & Option Pricing": 0.56,
    "Volatility Modeling": 0.5484, "Fixed Income & Credit": 0.2364, "Market Microstructure & Liquidity": 0.4286, "Fund Performance & Institutional": 0.2136,
    "Machine Learning in Finance": 0.3373, "Financial Econometrics": 0.0965, "Macro & Monetary": 0.0263, "Other": 0.0188}
TOPICS = list(NOVELTY_PRIOR)
NOVELTY_LR = {"matches_known": 0.15, "ambiguous": 1.0, "no_antecedent": 6.0}
RELEVANCE_LR = {"core_fit": 6.0, "adjacent": 1.0, "off_topic": 0.15}
NOVELTY_FALLBACK, RELEVANCE_FALLBACK, NOVELTY_CONFIDENCE, RELEVANCE_CONFIDENCE = 0.0476, 0.2, 0.28, 0.75
AXES = {"generality": 0.40, "contribution": 0.35, "testability": 0.25}
QUALITY, CITES, VELOCITY, REPUTATION = 0.45, 0.30, 0.25, 0.15
DISCOUNTS = {"isolated_backtest_only": 0.85, "no_costs_mentioned": 0.90, "extreme_claimed_sharpe": 0.85, "weak_stat_support": 0.85}
DISCOUNT_FLOOR = 0.5
MEMBER_BONUS = {"canon": 30, "seed": 20, "auto": 15}
JUNK = r"(?i)^(editorial board|table of contents|front matter|masthead|issue information|recent quant links|weekly (roundup|links)|links? (roundup|round-up))\b"


def _lookup(values: dict[str, float], key: Column, other: float) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(pairs, F.coalesce(key, F.lit(""))), F.lit(other))


def is_junk(title: Column) -> Column:
    """Front matter and link lists, which are no papers."""
    return F.trim(F.coalesce(title, F.lit(""))).rlike(JUNK)


def posterior(prior: Column, ratio: Column) -> Column:
    """Probability after odds are multiplied by a likelihood ratio; priors stay off 0 and 1."""
    p = F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = p / (1 - p) * ratio
    return odds / (1 + odds)


def novelty_posterior(topic: Column, verdict: Column) -> Column:
    return posterior(_lookup(NOVELTY_PRIOR, topic, NOVELTY_FALLBACK), _lookup(NOVELTY_LR, verdict, 1.0))


def relevance_posterior(topic: Column, verdict: Column) -> Column:
    return posterior(_lookup(RELEVANCE_PRIOR, topic, RELEVANCE_FALLBACK), _lookup(RELEVANCE_LR, verdict, 1.0))


def with_posteriors(df: DataFrame, topic: str, match: str, category: str) -> DataFrame:
    """Add both posteriors (rounded), rank_score 0-100, and whether the contribution is provisional (before rounding)."""
    novelty, relevance = novelty_posterior(F.col(topic), F.col(match)), relevance_posterior(F.col(topic), F.col(category))
    return df.withColumns({"novelty_posterior": F.round(novelty, 3), "relevance_posterior": F.round(relevance, 3), "rank_score": F.round(100 * relevance).cast("int"), "provisional": novelty < NOVELTY_CONFIDENCE})


def robustness(flags: dict[str, Column]) -> Column:
    """Product of the discounts of flags that are true (null never counts), no lower than the floor."""
    out = F.lit(1.0)
    for name, c in flags.items():
        out = out * F.when(c, F.lit(DISCOUNTS[name])).otherwise(1.0)
    return F.greatest(F.lit(DISCOUNT_FLOOR), out)


def pooled(value: Column, pool: list[str], log: bool, when: Column | None = None) -> Column:
    """Min-max to 0-100 within a pool: all 0 if none is positive, all 100 if all are equal.

    With `when`, only those rows form the pool and the others are null.  The pool key bounds what one task sees; for a
    single pool over everything use pooled_global, which aggregates first.
    """
    ok = F.lit(True) if when is None else when
    v = F.greatest(F.lit(0.0), F.coalesce(value, F.lit(0)).cast("double"))
    v = F.when(ok, F.log1p(v) if log else v)
    w = Window.partitionBy(*pool)
    return _scaled(v, F.min(v).over(w), F.max(v).over(w))


def _scaled(v: Column, low: Column, high: Column) -> Column:
    return F.when(v.isNull(), None).when(high <= 0, 0.0).when(high == low, 100.0).otherwise(100.0 * (v - low) / (high - low))


def pooled_global(df: DataFrame, columns: dict[str, tuple[Column, bool]]) -> DataFrame:
    """Add min-max columns over the whole table: name -> (value, log).  Null values stay null and outside the pool.

    The bounds are one row from a map-side aggregation, so no task sees all rows.
    """
    # greatest() skips nulls, so they are kept out by hand
    above = {n: F.when(v.isNotNull(), F.greatest(F.lit(0.0), v.cast("double"))) for n, (v, _) in columns.items()}
    values = {n: F.log1p(above[n]) if log else above[n] for n, (_, log) in columns.items()}
    bounds = df.agg(*[f(values[n]).alias(f"__{n}_{f.__name__}") for n in values for f in (F.min, F.max)])
    out = df.crossJoin(F.broadcast(bounds))  # one row
    return out.withColumns({n: _scaled(v, F.col(f"__{n}_min"), F.col(f"__{n}_max")) for n, v in values.items()}).drop(*bounds.columns)


def author_score(h: Column, roster_h: Column, member: Column, recent_cites: Column, venue_share: Column) -> Column:
    """0-100 with 50 neutral: twice the h-index, and for roster members a floor and bonuses."""
    best = F.greatest(h, roster_h)
    base = F.when(best.isNull(), 50.0).otherwise(F.least(F.lit(100.0), best * 2.0))
    bonus = _lookup({k: float(v) for k, v in MEMBER_BONUS.items()}, member, 0.0) + F.least(F.lit(15.0), F.log10(F.coalesce(recent_cites, F.lit(0)) + 1) / 4 * 15) + 0.08 * F.coalesce(venue_share, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(member.isNotNull(), F.greatest(base, F.lit(55.0)) + bonus).otherwise(base)))


def reputation(score: Column, impact_percentile: Column) -> Column:
    """Multiplier around 1 from the mean of what is known."""
    mean = F.when(impact_percentile.isNull(), score).otherwise((score + impact_percentile) / 2)
    return (1 - REPUTATION) + 2 * REPUTATION * (mean / 100)


def composite(df: DataFrame) -> DataFrame:
    """Composite score of items that are eligible, with its parts.

    Needs title, relevance_category, cites, author_score, impact_percentile, age (years), generality, contribution,
    testability (levels), provisional, and the four flags.  What a new paper cannot have yet gives its weight to the
    quality axes.  Citations are scaled over the eligible items, velocities over those that have one.
    """
    ok = df.filter(F.col("relevance_category").isNotNull() & (F.col("relevance_category") != "off_topic") & ~is_junk(F.col("title")))
    old = F.col("cites").isNotNull() & (F.col("age") >= 1)
    velocity = F.when(old, F.try_divide(F.col("cites").cast("double"), F.col("age")))
    ok = pooled_global(ok, {"cites_scaled": (F.coalesce("cites", F.lit(0)), True), "velocity_norm": (velocity, True)})
    young = (F.col("age").isNull() | (F.col("age") < 1)) & (F.coalesce("cites", F.lit(0)) == 0)
    cited = F.col("cites").isNotNull() & ~young
    contribution = F.when(F.coalesce("provisional", F.lit(True)), F.least(F.coalesce("contribution", F.lit(0)), F.lit(2))).otherwise(F.coalesce("contribution", F.lit(0)))
    levels = {"generality": F.coalesce("generality", F.lit(0)), "contribution": contribution, "testability": F.coalesce("testability", F.lit(0))}
    quality = sum((w * (levels[a] / 3 * 100) for a, w in AXES.items()), F.lit(0.0))
    fast = F.col("velocity_norm").isNotNull()
    weight = F.lit(QUALITY) + F.when(cited, 0.0).otherwise(CITES) + F.when(fast, 0.0).otherwise(VELOCITY)
    blend = weight * F.col("base_quality_raw") + F.when(cited, CITES * F.col("cites_scaled")).otherwise(0.0) + F.when(fast, VELOCITY * F.col("velocity_norm")).otherwise(0.0)
    out = ok.withColumns({"base_quality_raw": quality, "robustness_raw": robustness({n: F.col(n) for n in DISCOUNTS}), "reputation_raw": reputation(F.col("author_score"), F.col("impact_percentile"))})
    score = F.least(F.lit(100.0), blend * F.col("robustness_raw") * F.col("reputation_raw"))
    return out.withColumns({
        "base_quality": F.round("base_quality_raw", 1), "cites_norm": F.when(cited, F.round("cites_scaled", 1)), "robustness": F.round("robustness_raw", 3),
        "reputation": F.round("reputation_raw", 3), "composite": F.round(score, 1), "velocity_norm": F.round("velocity_norm", 1)}).drop("base_quality_raw", "robustness_raw", "reputation_raw", "cites_scaled")


def strength(generality: Column, testability: Column, novelty: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round((generality + testability) / 6 * 50 + novelty * 50)))


def topical_fit(text: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the terms that occur in the text, hyphens read as blanks."""
    padded = F.concat(F.lit(" "), F.translate(F.lower(F.coalesce(text, F.lit(""))), "-", " "), F.lit(" "))
    terms = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(float(w)).alias("w")) for t, w in weights.items()])
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + F.when(F.contains(padded, x["t"]), x["w"]).otherwise(0.0))


def tier(journal_tier: Column, h: Column, score: Column, author: Column) -> Column:
    """1, 2 or 0 from the journal's tier, the h-index, the relevance score and the author score."""
    z = lambda c: F.coalesce(c, F.lit(0))
    one = (F.coalesce(journal_tier, F.lit("")) == "T1") | (z(h) >= 40) | (z(score) >= 85) | (z(author) >= 80)
    two = (F.coalesce(journal_tier, F.lit("")) == "T2") | (z(h) >= 20) | (z(score) >= 60) | (z(author) >= 65)
    return F.when(one, 1).when(two, 2).otherwise(0)


def beta_binomial(hits: Column, total: Column, a: float, b: float) -> Column:
    return F.round((a + hits) / (a + b + total), 4)
