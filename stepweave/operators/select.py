"""Choosing representatives of clusters, and reports on clusters and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import differs_at


def validate_clusters(members: DataFrame, budget: int = 99) -> DataFrame:
    """(cluster_key, status, final_sequence, attempts, original_valid, reason) of members (cluster_key, seq_id, is_medoid,
    distance, tokens, valid, reason, bad_idx).

    A valid medoid stays (valid_medoid, 1 attempt). Else members are tried in the order of distance and id, first those
    that differ from the medoid at one of its bad places (all, where it has none), then the others (all again), at most
    `budget`: the first valid one replaces it (replaced), or there is none (unusable, nulls). attempts is 1 and the
    number of tries. Of several medoids the least id counts; clusters without one aren't given. Null distances come
    last. First and count are aggregates, so that a cluster with most of the rows isn't sorted in one task."""
    medoids = members.where("is_medoid").groupBy("cluster_key").agg(F.min(F.struct("seq_id", "tokens", "valid", "reason", "bad_idx")).alias("m"))
    order = F.struct(F.when((F.size("m.bad_idx") == 0) | differs_at(F.col("tokens"), F.col("m.tokens"), F.col("m.bad_idx")), 1).otherwise(2).alias("pass"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"), "seq_id")
    others = members.join(medoids, "cluster_key").where(~F.col("m.valid") & (F.col("seq_id") != F.col("m.seq_id"))).select("cluster_key", order.alias("rank"), "tokens", "valid", (F.size("m.bad_idx") == 0).alias("twice"))
    first = others.groupBy("cluster_key").agg(F.min(F.when(F.col("valid"), F.struct("rank", "tokens"))).alias("first"), F.count(F.lit(1)).alias("n"), F.first("twice").alias("twice"))
    tries = others.select("cluster_key", "rank").join(first.select("cluster_key", "first.rank").withColumnRenamed("rank", "upto"), "cluster_key").groupBy("cluster_key").agg(F.count_if(F.col("rank") <= F.col("upto")).alias("tries"))
    all_ = medoids.join(first, "cluster_key", "left").join(tries, "cluster_key", "left")
    ok = F.col("m.valid")
    found = F.col("first").isNotNull() & (F.col("tries") <= budget)
    total = F.coalesce(F.col("n"), F.lit(0)) * F.when(F.coalesce("twice", F.lit(False)), 2).otherwise(1)
    return all_.select(
        "cluster_key",
        F.when(ok, "valid_medoid").when(found, "replaced").otherwise("unusable").alias("status"),
        F.when(ok, F.col("m.tokens")).when(found, F.col("first.tokens")).alias("final_sequence"),
        F.when(ok, F.lit(1)).when(found, 1 + F.col("tries")).otherwise(1 + F.least(F.lit(budget), total)).cast("long").alias("attempts"),
        ok.alias("original_valid"),
        F.when(~ok, F.col("m.reason")).alias("reason"),
    )


def first_valid(members: DataFrame) -> DataFrame:
    """(cluster_key, seq_id, tokens): the nearest valid member, or the nearest one where none is valid."""
    rank = F.struct(F.coalesce("distance", F.lit(float("inf"))).alias("d"), "seq_id", "tokens")
    one = members.groupBy("cluster_key").agg(F.coalesce(F.min(F.when(F.col("valid"), rank)), F.min(rank)).alias("x"))
    return one.select("cluster_key", "x.seq_id", "x.tokens")


def with_validation(clusters: DataFrame, validation: DataFrame, key: str = "cluster_key") -> DataFrame:
    """All clusters with what validation says of them, nulls where it says nothing."""
    return clusters.join(validation, key, "left")


def status_counts(validation: DataFrame, *by: str) -> DataFrame:
    """(by..., status, n, attempts)."""
    return validation.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("attempts"))


def cluster_sizes(members: DataFrame, key: str, *by: str) -> DataFrame:
    """(by..., n_clusters, min_size, max_size, mean_size, median_size)."""
    sizes = members.groupBy(*by, key).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_clusters"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.avg("size").alias("mean_size"), F.percentile("size", F.lit(0.5)).alias("median_size"))


def pending(entries: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """The entries that no successful row of progress (key, success) has."""
    return entries.join(progress.where("success").select(key), key, "left_anti")


def frozen(entries: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """The entries that some successful row of progress (key, success) has: what stays as it is when others are made again."""
    return entries.join(progress.where("success").select(key), key, "left_semi")


def failed(progress: DataFrame, key: str) -> DataFrame:
    """(key): the non-null keys of progress that no row finished."""
    known = progress.where(F.col(key).isNotNull())
    return known.groupBy(key).agg(F.bool_or("success").alias("_s")).where(~F.coalesce("_s", F.lit(False))).select(key)


def usable(validation: DataFrame, indices: list[int] | None = None, index: str = "cluster_idx") -> DataFrame:
    """Clusters that aren't unusable, of given indices if there are any."""
    kept = validation.where(F.col("status").isin("valid_medoid", "replaced"))
    return kept if indices is None else kept.where(F.col(index).isin(indices))


def write_summary(finals: DataFrame, types: DataFrame) -> DataFrame:
    """(domain, total_actions, write_actions, write_share) over non-null finals (domain, final_sequence)."""
    each = finals.where(F.col("final_sequence").isNotNull()).select("domain", F.explode("final_sequence").alias("token"))
    joined = each.join(types.select(F.col("domain").alias("_d"), F.col("token").alias("_t"), "type"), F.col("domain").eqNullSafe(F.col("_d")) & (F.col("token") == F.col("_t")), "left")
    writes = F.count_if(F.col("type").eqNullSafe(F.lit("WRITE")))
    return joined.groupBy("domain").agg(F.count(F.lit(1)).alias("total_actions"), writes.alias("write_actions"), F.round(writes / F.count(F.lit(1)), 6).alias("write_share"))
