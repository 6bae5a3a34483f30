"""Queries of the llm operators by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_form, name_forms
from ..session import cut
from ..sources.tables import table
from . import bpe, coding, levels, packing, pairs, patterns, terms, varied

#: Tokens of a container.
CAPACITY = 2048
#: Sequences of a domain's varied subset.
SUBSET = 40


def _patterns(spark: SparkSession, d: str, medoids: bool = False) -> DataFrame:
    members = table(spark, d, "cluster_members").select(F.lit("members").alias("src"), "domain", "seq_id", F.col("tokens").alias("items"))
    accepted = table(spark, d, "sampler_accepted").select(F.lit("accepted").alias("src"), "domain", "seq_id", F.col("tokens").alias("items"))
    sequences = members.unionByName(accepted)
    if medoids:
        sequences = sequences.unionByName(table(spark, d, "cluster_info").select(F.lit("medoids").alias("src"), "domain", F.col("cluster_key").alias("seq_id"), F.col("medoid_sequence").alias("items")))
    found = patterns.frequent_patterns(sequences, form=coding.name_form)
    return found.withColumn("pattern", F.array_join("pattern", ">"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _patterns(spark, d).select("src", "domain", "pattern")


def p2_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Frequent patterns with their support and the number of sequences, of the medoids of cluster_info too, one per cluster."""
    return _patterns(spark, d, medoids=True)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = table(spark, d, "model_vocab").select("domain", name_form("token").alias("term"))
    return terms.term_frequencies(_layout(spark, d), vocabulary)


def _layout(spark: SparkSession, d: str) -> DataFrame:
    """The vertical layout as a table that is kept: it is written once and read for every count."""
    records = table(spark, d, "cluster_members").select("domain", "seq_id", F.col("tokens").alias("terms"))
    return cut(terms.term_bitmaps(records, coding.name_form))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where(F.col("mark").isNotNull()).select("domain", "term", "mark")


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    """Total count, number of sequences and mark of every term."""
    return _terms(spark, d)


def p5_layout(spark: SparkSession, d: str) -> DataFrame:
    """The containers of each term with their cardinalities and bytes; the term '' has all records."""
    sums = _layout(spark, d).groupBy("domain", "term").agg(F.count(F.lit(1)).alias("containers"), F.sum(F.col("n").cast("long")).alias("n_records"), F.sum(F.length("ids") + F.coalesce(F.length("more"), F.lit(0))).alias("bytes"))
    return sums


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    actions = table(spark, d, "eval_actions").select(F.lit("actions").alias("src"), "domain", "task_id", "trial", name_form("name").alias("item"))
    members = table(spark, d, "cluster_members").select(F.lit("members").alias("src"), "domain", "seq_id", F.sort_array(F.array_distinct(name_forms("tokens"))).alias("items"))
    once = members.where("seq_id is not null").groupBy("src", "domain", "seq_id").agg(F.first("items").alias("items")).unionByName(members.where("seq_id is null").distinct())
    return pairs.baskets_of_rows(actions, ["task_id", "trial"]).unionByName(once.select("src", "domain", "items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    counted = pairs.pair_counts(pairs.collapse(_baskets(spark, d)), min_count=5, min_share=200)
    return counted.where(F.col("n_ab") * F.col("n") >= 3 * F.col("n_a") * F.col("n_b")).select("src", "domain", "item_a", "item_b")


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with its count, lift and conviction."""
    counted = pairs.pair_counts(pairs.collapse(_baskets(spark, d)))
    return counted.withColumns({"lift": F.round("lift", 6), "conviction": F.round("conviction", 6)})


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Each document's container of CAPACITY tokens; a text of more tokens has several parts."""
    sizes = bpe.encode(table(spark, d, "documents"), counts_only=True).withColumnRenamed("n_tokens", "size")
    return packing.fill_containers(sizes, CAPACITY)


def p4_subset(spark: SparkSession, d: str) -> DataFrame:
    """SUBSET varied sequences per domain, of all members and medoids."""
    members = table(spark, d, "cluster_members").select("domain", F.lit("members").alias("src"), F.col("seq_id").alias("id"), F.col("tokens").alias("items"))
    medoids = table(spark, d, "cluster_info").select("domain", F.lit("medoids").alias("src"), F.col("cluster_key").alias("id"), F.col("medoid_sequence").alias("items"))
    chosen = varied.varied_subset(members.unionByName(medoids), SUBSET, form=coding.name_form)
    return chosen.select("domain", "src", "id", F.array_join("items", ">").alias("sequence"), "copies", F.round("spread", 6).alias("spread"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return levels.score(documents, levels.train(documents, table(spark, d, "reading_labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return levels.mostly_hard(_scored(spark, d)).select("doc_id").distinct()


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """The estimated level of every document."""
    return _scored(spark, d).withColumns({"mean_level": F.round("mean_level", 4), "hard_share": F.round("hard_share", 4)})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_patterns, p4_subset, p5_found, p5_terms, p5_layout, p7_found, p7_pairs, p8_ids, p9_containers, p10_found, p10_levels)}


def _name(x: str) -> str:
    return f"nullif(trim(regexp_replace(lower({x}), '[^a-z]+', '_', 'g'), '_'), '')"


_TERMS = f"""
WITH seqs AS (
  SELECT DISTINCT domain, seq_id, tokens FROM cluster_members
), size AS (
  SELECT domain, count(*) AS n FROM seqs GROUP BY ALL
), held AS (
  SELECT domain, seq_id, term FROM (SELECT domain, seq_id, {_name("t")} AS term FROM (SELECT domain, seq_id, unnest(tokens) AS t FROM seqs)) WHERE term IS NOT NULL
), counted AS (
  SELECT domain, term, count(*) AS total, count(DISTINCT seq_id) AS n_records FROM held GROUP BY ALL
), every AS (
  SELECT domain, term FROM counted UNION SELECT domain, {_name("token")} FROM model_vocab
), marked AS (
  SELECT e.domain, e.term, coalesce(c.total, 0) AS total, coalesce(c.n_records, 0) AS n_records, coalesce(s.n, 0) AS n,
    CASE WHEN coalesce(c.n_records, 0) < 3 THEN 'rare' WHEN 2 * c.n_records > s.n THEN 'common' END AS mark
  FROM every e LEFT JOIN counted c USING (domain, term) LEFT JOIN size s ON s.domain = e.domain WHERE e.term IS NOT NULL
)
"""

_PAIRS = f"""
WITH basket AS (
  SELECT 'actions' AS src, domain, task_id || '/' || trial AS basket, list(DISTINCT {_name("name")}) FILTER ({_name("name")} IS NOT NULL) AS items FROM eval_actions GROUP BY ALL
  UNION ALL SELECT 'members', domain, seq_id::VARCHAR, list_distinct(list_filter([{_name("x")} FOR x IN tokens], lambda y: y IS NOT NULL)) FROM (SELECT DISTINCT domain, seq_id, tokens FROM cluster_members)
), size AS (
  SELECT src, domain, count(*) AS n FROM basket GROUP BY ALL
), item AS (
  SELECT src, domain, basket, unnest(items) AS item FROM basket
), single AS (
  SELECT src, domain, item, count(*) AS n_item FROM item GROUP BY ALL
), pair AS (
  SELECT a.src, a.domain, a.item AS item_a, b.item AS item_b, count(*) AS n_ab
  FROM item a JOIN item b ON a.src = b.src AND a.domain = b.domain AND a.basket = b.basket AND a.item < b.item GROUP BY ALL
), scored AS (
  SELECT p.src, p.domain, item_a, item_b, n_ab, a.n_item AS n_a, b.n_item AS n_b, n
  FROM pair p JOIN single a ON a.src = p.src AND a.domain = p.domain AND a.item = item_a
  JOIN single b ON b.src = p.src AND b.domain = p.domain AND b.item = item_b JOIN size s ON s.src = p.src AND s.domain = p.domain
)
"""

def _grown(more: str = "") -> str:
    """Prefix growth: at each length, the first place where a pattern of frequent steps ends in each sequence."""
    steps = f"""
WITH seqs AS (
  SELECT DISTINCT 'members' AS src, domain, seq_id, tokens FROM cluster_members UNION ALL SELECT DISTINCT 'accepted', domain, seq_id, tokens FROM sampler_accepted{more}
), least AS (
  SELECT src, domain, count(*) AS n, greatest(10, ceil(count(*) / 8))::BIGINT AS least FROM seqs GROUP BY ALL
), step AS (
  SELECT src, domain, seq_id, pos, {_name("t")} AS t FROM (SELECT src, domain, seq_id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS t FROM seqs) WHERE {_name("t")} IS NOT NULL
), g1 AS (
  SELECT src, domain, seq_id, t AS pattern, min(pos) AS pos FROM step GROUP BY ALL
), f1 AS (
  SELECT src, domain, pattern, support FROM (SELECT src, domain, pattern, count(*) AS support FROM g1 GROUP BY ALL) JOIN least USING (src, domain) WHERE support >= least
)"""
    for k in range(2, 6):
        steps += f""", g{k} AS (
  SELECT g.src, g.domain, g.seq_id, g.pattern || '>' || s.t AS pattern, min(s.pos) AS pos
  FROM g{k - 1} g JOIN f{k - 1} f USING (src, domain, pattern) JOIN step s ON s.src = g.src AND s.domain = g.domain AND s.seq_id = g.seq_id AND s.pos > g.pos GROUP BY ALL
), f{k} AS (
  SELECT src, domain, pattern, support FROM (SELECT src, domain, pattern, count(*) AS support FROM g{k} GROUP BY ALL) JOIN least USING (src, domain) WHERE support >= least
)"""
    return steps + ", found AS (FROM f3 UNION ALL FROM f4 UNION ALL FROM f5)\n"


SQL: dict[str, str] = {
    "p2_found": _grown() + "SELECT src, domain, pattern FROM found",
    "p2_patterns": _grown(" UNION ALL SELECT DISTINCT 'medoids', domain, cluster_key, medoid_sequence FROM cluster_info") + "SELECT src, domain, pattern, support, n FROM found JOIN least USING (src, domain)",
    "p5_found": _TERMS + "SELECT domain, term, mark FROM marked WHERE mark IS NOT NULL",
    "p5_terms": _TERMS + "SELECT * FROM marked",
    "p5_layout": _TERMS
    + """, posting AS (
  SELECT domain, term, seq_id, count(*) AS times FROM held GROUP BY ALL UNION ALL SELECT domain, '', seq_id, 1 FROM seqs
), container AS (
  SELECT domain, term, seq_id >> 16 AS bucket, count(*) AS n, count(*) FILTER (times > 1) AS more FROM posting GROUP BY ALL
)
SELECT domain, term, count(*) AS containers, sum(n) AS n_records, sum(CASE WHEN n < 4096 THEN 2 * n ELSE 8192 END + 6 * more) AS bytes FROM container GROUP BY ALL""",
    "p7_found": _PAIRS + "SELECT src, domain, item_a, item_b FROM scored WHERE n_ab >= 5 AND 200 * n_ab >= n AND n_ab * n >= 3 * n_a * n_b",
    "p7_pairs": _PAIRS + "SELECT *, round(n_ab * n / (n_a * n_b), 6) AS lift, CASE WHEN n_a > n_ab THEN round(n_a * (n - n_b) / (n * (n_a - n_ab)), 6) END AS conviction FROM scored",
}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
