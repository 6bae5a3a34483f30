"""Length statistics and sampling of lengths."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ngram import uniform


def fit(lengths: DataFrame, *by: str) -> DataFrame:
    """(by..., n, median, std, low, high, p10, p90) of lengths (by..., length): population std, linear percentiles, low
    at least 1, p10 and p90 within low and high. Aggregates of histograms: the shuffle holds distinct lengths only."""
    return fit_histogram(lengths.where(F.col("length").isNotNull()).groupBy(*by, "length").agg(F.count(F.lit(1)).alias("k")), *by)


def fit_histogram(hist: DataFrame, *by: str) -> DataFrame:
    """fit() of how often each length occurs (by..., length, k)."""
    p = lambda q: F.expr(f"percentile(length, {q}, k)")
    mean = F.sum(F.col("length") * F.col("k")) / F.sum("k")
    square = F.sum(F.col("length").cast("double") * F.col("length") * F.col("k")) / F.sum("k")
    raw = hist.groupBy(*by).agg(F.sum("k").alias("n"), p(0.5).alias("median"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), F.greatest(F.lit(1), F.min("length")).alias("low"), F.max("length").alias("high"), p(0.1).alias("p10"), p(0.9).alias("p90"))
    clamp = lambda c: F.greatest(F.col("low").cast("double"), F.least(F.col(c), F.col("high").cast("double"))).alias(c)
    return raw.where("n > 0").select(*by, "n", "median", "std", "low", "high", clamp("p10"), clamp("p90"))


class Fitted:
    """Statistics of lengths that keep up with what is added: only the histogram is kept, statistics are worked out when they
    are asked for and kept until lengths are added again."""

    def __init__(self, lengths: DataFrame, *by: str):
        self.by, self.hist, self.stats = by, None, None
        self.add(lengths)

    def add(self, lengths: DataFrame) -> None:
        new = lengths.where(F.col("length").isNotNull()).groupBy(*self.by, "length").agg(F.count(F.lit(1)).alias("k"))
        both = new if self.hist is None else self.hist.unionByName(new).groupBy(*self.by, "length").agg(F.sum("k").alias("k"))
        self.hist, self.stats = cut(both), None

    def get(self) -> DataFrame:
        if self.stats is None:
            self.stats = cut(fit_histogram(self.hist, *self.by))
        return self.stats


def fit_or(lengths: DataFrame, fallback: DataFrame, *by: str) -> DataFrame:
    """fit() of lengths, and of fallback for the groups that lengths hasn't."""
    main, other = fit(lengths, *by), fit(fallback, *by)
    if not by:
        return main.unionByName(other.join(main.agg(F.count(F.lit(1)).alias("_n")), F.col("_n") == 0, "left_semi")).where("n > 0").limit(1)
    return main.unionByName(other.join(main, list(by), "left_anti"))


def histogram(lengths: DataFrame, *by: str) -> DataFrame:
    """(by..., lengths map<string,long>): how often each length occurs, by its text."""
    counts = lengths.groupBy(*by, "length").agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("length").cast("string").alias("length"), "k")))).alias("lengths"))


def normal(*key: Column | str, seed: int = 0) -> Column:
    """A standard normal number from a hash of a key."""
    u, v = uniform(*key, seed=2 * seed + 1), uniform(*key, seed=2 * seed + 2)
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-300)))) * F.cos(2 * F.pi() * v)


def _round(x: Column, low: Column, high: Column) -> Column:
    return F.bround(F.greatest(low, F.least(high, x))).cast("int")


def skew_normal(mean: float, std: float, skew: float, low: int, high: int, *key: Column | str, seed: int = 0) -> Column:
    """A length from a skew normal distribution, cut to its bounds, half to even."""
    if std <= 0 or low > high:
        raise ValueError("std > 0 and low <= high are needed")
    delta = skew / (1 + skew**2) ** 0.5
    x = mean + std * (delta * F.abs(normal(*key, seed=10 + seed)) + (1 - delta**2) ** 0.5 * normal(*key, seed=20 + seed))
    return _round(x, F.lit(float(low)), F.lit(float(high)))


def kernel(draws: DataFrame, lengths: DataFrame, by: str, *key: str, seed: int = 0) -> DataFrame:
    """draws (by, key...) with length, drawn from a Gaussian kernel density of lengths (by, length) by Scott's rule: one of
    the lengths plus noise, cut to their range. Histograms, bounded by distinct lengths, are what is joined."""
    stats = lengths.groupBy(by, "length").agg(F.count(F.lit(1)).alias("k")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("length", "k"))).alias("hist"))
    n = F.aggregate("hist", F.lit(0).cast("long"), lambda a, h: a + h["k"])
    mean = F.aggregate("hist", F.lit(0.0), lambda a, h: a + h["length"] * h["k"]) / n
    var = F.aggregate("hist", F.lit(0.0), lambda a, h: a + F.pow(h["length"] - F.col("mean"), 2) * h["k"]) / F.greatest(F.col("n") - 1, F.lit(1))
    stats = stats.withColumn("n", n).withColumn("mean", mean).withColumn("h", F.sqrt(var * F.pow(F.col("n").cast("double"), F.lit(-0.4))))
    cumulative = F.aggregate("hist", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("double").alias("at")), lambda a, x: F.struct((a["sum"] + x["k"]).alias("sum"), F.coalesce(a["at"], F.when(a["sum"] + x["k"] > F.col("_u") * F.col("n"), x["length"].cast("double"))).alias("at")))["at"]
    joined = draws.join(stats.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).withColumn("_u", uniform(*key, seed=seed))
    x = cumulative + F.col("h") * normal(*key, seed=30 + seed)
    return joined.withColumn("length", _round(x, F.col("hist")[0]["length"].cast("double"), F.element_at("hist", -1)["length"].cast("double"))).drop("_by", "_u", "hist", "n", "mean", "h")


def drawing(settings: Mapping, given: DataFrame, by: str, *key: str, seed: int = 0) -> Callable[[DataFrame], DataFrame]:
    """What adds length to draws (by, key...), by the settings of a checkpoint: mode `skew_normal` with its mean and std,
    or `from_seed`, the kernel density of given (by, length). Bounds that the settings lack are those of given's fit, per
    group; other settings say nothing here."""
    mode = settings.get("mode", "from_seed")
    if mode == "from_seed":
        return lambda draws: kernel(draws, given, by, *key, seed=seed)
    if mode != "skew_normal":
        raise ValueError(f"no way of drawing is named {mode}")
    mean, std = (settings.get(k) for k in ("mean", "std"))
    if mean is None or std is None:
        raise ValueError("a skew normal distribution has a mean and a std")
    low, high = settings.get("min"), settings.get("max")
    bounds = fit(given, by).select(F.col(by).alias("_by"), F.col("low").alias("_low"), F.col("high").alias("_high"))

    def add(draws: DataFrame) -> DataFrame:
        if low is not None and high is not None:
            return draws.withColumn("length", skew_normal(mean, std, settings.get("skew", 0.0), low, high, *key, seed=seed))
        free = skew_normal(mean, std, settings.get("skew", 0.0), -(1 << 30), 1 << 30, *key, seed=seed)
        joined = draws.join(bounds, F.col(by).eqNullSafe(F.col("_by")), "left")
        least, most = (F.col(c) if x is None else F.lit(x) for c, x in (("_low", low), ("_high", high)))
        return joined.withColumn("length", F.greatest(least, F.least(most, free)).cast("int")).drop("_by", "_low", "_high")

    return add
