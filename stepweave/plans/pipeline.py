"""The stages put together: learn a model, sample and cluster a pool, validate, and cluster again what failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, ngram, select
from ..operators.distance import Costs
from ..operators.providers import Provider
from ..session import cut


def sample_pool(counts: DataFrame, vocabulary: DataFrame, size: int, lengths, tau: float = 1.5, seed: int = 0, keep=None, config: ngram.Config = ngram.Config(), oversample: int = 10) -> DataFrame:
    """(domain, idx, tokens): up to `size` distinct sequences per domain of at most oversample times as many attempts.
    lengths is a column of attempt. Attempts are made in rounds, twice the size at first and then as many again, until
    every domain's pool is full: an attempt gives the same sequence in whichever round it is made."""
    first, start, end = None, 0, 2 * size
    n_domains = vocabulary.select("domain").distinct().count()
    while True:
        attempts = ngram._attempts(vocabulary, start, end).withColumns({"length": lengths.cast("int"), "tau": F.lit(float(tau))})
        made = ngram.generate(attempts, counts, vocabulary, seed, config).select("domain", "attempt", "tokens")
        made = made if keep is None else made.where(keep)
        both = made if first is None else first.unionByName(made)
        first = cut(both.groupBy("domain", "tokens").agg(F.min("attempt").alias("attempt")))
        full = first.groupBy("domain").count().where(F.col("count") >= size).count()
        if full >= n_domains or end >= size * oversample:
            return cluster.unique_pool(first, size)
        start, end = end, min(2 * end, size * oversample)


def cluster_and_validate(spark: SparkSession, counts: DataFrame, vocabulary: DataFrame, judge: Provider, k: int, size: int, lengths, costs: Costs, seed: int = 0, rounds: int = 3, budget: int = 99, keep=None) -> DataFrame:
    """(domain, cluster_idx, status, final_sequence, attempts, original_valid, reason) of k clusters per domain.

    Clusters that turn out unusable are made again around the frozen final sequences of the others, from a new pool, at
    most `rounds` times, and take their old places; domains without a usable one are clustered without frozen ones."""
    pool = cut(sample_pool(counts, vocabulary, size, lengths, seed=seed, keep=keep).withColumn("is_frozen", F.lit(False)))

    def validated(members: DataFrame) -> DataFrame:
        named = judge(members.withColumns({"cluster_key": F.concat_ws(":", "domain", "cluster_idx"), "seq_id": F.col("idx"), "is_medoid": F.col("idx") == F.col("medoid_idx")}))
        v = select.validate_clusters(named, budget)
        return v.join(named.select("cluster_key", "domain", "cluster_idx").distinct(), "cluster_key").drop("cluster_key")

    done = cut(validated(cluster.k_medoids(pool, k, costs, seed)))
    for r in range(1, rounds + 1):
        bad = done.where("status = 'unusable'")
        if not bad.limit(1).count():
            break
        frozen = done.where("status <> 'unusable'").select("domain", (-1 - F.col("cluster_idx")).cast("int").alias("idx"), F.col("final_sequence").alias("tokens"), F.lit(True).alias("is_frozen"))
        fresh = sample_pool(counts, vocabulary, size, lengths, seed=seed + r, keep=keep).withColumn("is_frozen", F.lit(False))
        again = fresh.join(bad.select("domain").distinct(), "domain", "left_semi").unionByName(frozen.join(bad.select("domain").distinct(), "domain", "left_semi"))
        new = cut(validated(cluster.k_medoids(again, _most(bad), costs, seed + r)))
        slots = bad.selectExpr("domain", "cluster_idx as slot", "row_number() over (partition by domain order by cluster_idx) - 1 as n")
        ranked = new.selectExpr("domain", "row_number() over (partition by domain order by status = 'unusable', cluster_idx) - 1 as n", "status", "final_sequence", "attempts", "original_valid", "reason")
        placed = slots.join(ranked, ["domain", "n"]).withColumnRenamed("slot", "cluster_idx").drop("n")
        done = cut(cluster.splice(done, placed, ["domain", "cluster_idx"]))
    return done


def _most(bad: DataFrame) -> int:
    return bad.groupBy("domain").count().agg(F.max("count")).first()[0]
