"""Items that appear together, by basket collapsing.

Baskets with the same set of items are grouped into one weighted basket, pairs are enumerated once per distinct
basket, and weights are added up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checked_broadcast, cut


#: Items of a basket that one row holds while its pairs are made.
ITEMS = 256


def collapse(baskets: DataFrame) -> DataFrame:
    """Weighted baskets (src, domain, items, weight) of baskets (src, domain, items array<string>)."""
    return baskets.groupBy("src", "domain", "items").agg(F.count(F.lit(1)).alias("weight"))


def baskets_of_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One basket (src, domain, items) per combination of keys of rows (src, domain, keys..., item). Null items are no
    items, but their basket counts; null keys are a key. Items are deduplicated before the shuffle, so a basket with a
    third of all rows arrives as a few small sets."""
    return rows.groupBy("src", "domain", *keys).agg(F.sort_array(F.collect_set("item")).alias("items")).select("src", "domain", "items")


def _pairs(weighted: DataFrame) -> DataFrame:
    """(src, domain, weight, item_a, item_b) of every pair of every basket, once. A basket of more than ITEMS items is cut into
    blocks of them; each pair of blocks is a row of its own, and these rows are spread over all tasks, so that the pairs
    of one large basket are no single task's."""
    n = F.size("items")
    small = weighted.where((n > 1) & (n <= ITEMS)).select("src", "domain", "weight", "items", F.posexplode("items").alias("i", "item_a"))
    within = small.select("src", "domain", "weight", "item_a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("item_b"))
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / ITEMS).cast("int"))
    first = weighted.where(n > ITEMS).select("src", "domain", "weight", "items", F.explode(blocks).alias("a"))
    both = first.select("src", "domain", "weight", "items", "a", F.explode(F.sequence(F.col("a"), F.floor((n - 1) / ITEMS).cast("int"))).alias("b"))
    block = lambda k: F.slice("items", F.col(k) * ITEMS + 1, F.lit(ITEMS)).alias("of_" + k)
    dealt = both.select("src", "domain", "weight", "a", "b", block("a"), block("b")).repartition("src", "domain", "a", "b", F.xxhash64("of_a", "of_b"))
    across = dealt.select("src", "domain", "weight", "a", "b", "of_b", F.explode("of_a").alias("item_a")).select("src", "domain", "weight", "a", "b", "item_a", F.explode("of_b").alias("item_b"))
    across = across.where((F.col("a") < F.col("b")) | (F.col("item_a") < F.col("item_b"))).drop("a", "b")
    return within.unionByName(across)


def pair_counts(weighted: DataFrame, min_count: int = 1, min_share: int | None = None) -> DataFrame:
    """(src, domain, item_a, item_b, n_ab, n_a, n_b, n, lift, conviction) of every pair, item_a < item_b, that occurs in
    at least min_count baskets and, where min_share is given, in at least one of min_share.

    conviction is that of item_a -> item_b, null where item_b is never missing. With min_share, items that are too
    rare for any such pair are left out before pairs are made: a pair is never more frequent than its items, so the
    result is whole. Of a domain fewer items are left than min_share times a basket's average size; their table is
    broadcast behind a check of its size. Baskets with fewer than two items give no pair but count in n. Null domains are a domain."""
    same = lambda a, b: F.col(f"{a}.src").eqNullSafe(F.col(f"{b}.src")) & F.col(f"{a}.domain").eqNullSafe(F.col(f"{b}.domain"))
    weighted = cut(weighted)
    n = weighted.groupBy("src", "domain").agg(F.sum("weight").alias("n"))
    singles = weighted.select("src", "domain", "weight", F.explode("items").alias("item")).groupBy("src", "domain", "item").agg(F.sum("weight").alias("n_item"))
    items = singles.alias("s").join(n.alias("t"), same("s", "t")).select("s.*", "n").where(F.col("n_item") >= min_count)
    if min_share is not None:
        items = cut(items.where(F.col("n_item") * min_share >= F.col("n")))
        frequent = cut(items.groupBy("src", "domain").agg(F.collect_set("item").alias("frequent")))
        pruned = weighted.alias("w").join(checked_broadcast(frequent, 10_000).alias("f"), same("w", "f")).select("w.src", "w.domain", F.sort_array(F.array_intersect("items", "frequent")).alias("items"), "weight")
        weighted = pruned.where(F.size("items") > 1).groupBy("src", "domain", "items").agg(F.sum("weight").alias("weight"))
    counted = _pairs(weighted).groupBy("src", "domain", "item_a", "item_b").agg(F.sum("weight").alias("n_ab")).where(F.col("n_ab") >= min_count)
    a, b = (items.select("src", "domain", F.col("item").alias("item"), F.col("n_item").alias("n_item"), "n") for _ in "ab")
    out = counted.alias("p").join(a.alias("a"), same("p", "a") & (F.col("item_a") == F.col("a.item"))).join(b.alias("b"), same("p", "b") & (F.col("item_b") == F.col("b.item")))
    n_ab, n_a, n_b, n_all = F.col("n_ab"), F.col("a.n_item"), F.col("b.n_item"), F.col("a.n")
    out = out.select("p.src", "p.domain", "item_a", "item_b", "n_ab", n_a.alias("n_a"), n_b.alias("n_b"), n_all.alias("n"), (n_ab * n_all / (n_a * n_b)).alias("lift"), F.when(n_a > n_ab, n_a * (n_all - n_b) / (n_all * (n_a - n_ab))).alias("conviction"))
    return out if min_share is None else out.where(F.col("n_ab") * min_share >= F.col("n"))
