"""Checks that give rows of violations: missing references, ownership, reuse, ambiguity; and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violation(df: DataFrame, keys: Sequence[str], rule: str, message: Column) -> DataFrame:
    return df.select(*keys, F.lit(rule).alias("rule"), message.alias("message"))


def missing(df: DataFrame, targets: DataFrame, on: dict[str, str]) -> DataFrame:
    """The rows of df whose non-null references (column to column of targets) have no target."""
    keys = targets.select(*(F.col(t).alias(f"_{t}") for t in on.values()))
    cond = [F.col(c) == F.col(f"_{t}") for c, t in on.items()]
    whole = df
    for c in on:
        whole = whole.where(F.col(c).isNotNull())
    return whole.join(keys, cond, "left_anti")


def missing_in_any(df: DataFrame, column: str, targets: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """The rows whose reference is in none of several target columns."""
    ids = targets[0][0].select(F.col(targets[0][1]).cast("string").alias("_id"))
    for t, c in targets[1:]:
        ids = ids.unionByName(t.select(F.col(c).cast("string").alias("_id")))
    return df.where(F.col(column).isNotNull()).join(ids, F.col(column).cast("string") == F.col("_id"), "left_anti")


def missing_links(tables: DataFrame, id_column: str, links: Sequence[tuple[str, str, str]], form=None) -> DataFrame:
    """(id_column, child_table, child_key, name, value): the records of child tables (id_column, child_table, child_key,
    attrs map<string,string>) whose attribute names a record that their own document hasn't, by links (table, attribute,
    target table). form makes keys comparable. A null attribute links to nothing."""
    form = form or (lambda c: c)
    same = lambda t, a: (F.col("child_table") == t) & (F.col("name") == a)
    each = tables.select(id_column, "child_table", "child_key", F.explode("attrs").alias("name", "value"))
    target = F.lit(None).cast("string")
    for t, a, to in links:
        target = F.when(same(t, a), to).otherwise(target)
    asked = each.withColumn("_to", target).where(F.col("_to").isNotNull()).withColumn("_key", form(F.col("value"))).distinct()
    have = tables.where(F.col("child_table").isin([to for _, _, to in links])).select(F.col(id_column).alias("_id"), F.col("child_table").alias("_t"), form(F.col("child_key")).alias("_k"))
    return asked.join(have, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_to") == F.col("_t")) & (F.col("_key") == F.col("_k")), "left_anti").drop("_to", "_key")


def not_listed(df: DataFrame, owners: DataFrame, key: str, item: str, links: str) -> DataFrame:
    """The rows (key, item) of df whose owner exists and doesn't list the item."""
    listed = owners.select(F.col(key).alias("_k"), F.explode(links).alias("_i"))
    return df.join(owners.select(F.col(key).alias("_o")).distinct(), F.col(key) == F.col("_o"), "left_semi").join(listed, (F.col(key) == F.col("_k")) & (F.col(item) == F.col("_i")), "left_anti")


def over_limit(df: DataFrame, keys: Sequence[str], test: Column, limit: int) -> DataFrame:
    """(keys..., n) where the test holds in more than `limit` rows."""
    return df.groupBy(*keys).agg(F.count_if(test).alias("n")).where(F.col("n") > limit)


def reused(df: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """(keys..., item, n) of items that occur more than once."""
    return df.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unexpected_arguments(actions: DataFrame, specs: DataFrame) -> DataFrame:
    """actions (name, arguments JSON) with unknown_tool, unexpected and missing argument names by specs (name, params
    array<string>); arguments that are no object have nulls in both lists."""
    args = F.map_keys(F.from_json("arguments", "map<string,string>"))
    joined = actions.join(specs.select(F.col("name").alias("_n"), "params"), F.col("name") == F.col("_n"), "left")
    return joined.select("*", F.col("_n").isNull().alias("unknown_tool"), F.array_sort(F.array_except(args, "params")).alias("unexpected"), F.array_sort(F.array_except("params", args)).alias("missing")).drop("_n", "params")


def ambiguous(candidates: DataFrame, key: Sequence[str], item: str) -> DataFrame:
    """(key..., item, others): for each key that several items share, the first item in order and the others. The
    candidates of a key are deduplicated before they are gathered."""
    sets = candidates.groupBy(*key).agg(F.sort_array(F.collect_set(item)).alias("_s")).where(F.size("_s") > 1)
    return sets.select(*key, F.col("_s")[0].alias(item), F.slice("_s", F.lit(2), F.size("_s")).alias("others"))


def first_failure(violations: DataFrame, keys: Sequence[str], steps: Sequence[str]) -> DataFrame:
    """(keys..., rule, message): of each key's violations, the one whose rule is first in steps; ties by message."""
    order = F.create_map(*(F.lit(x) for i, s in enumerate(steps) for x in (s, i)))
    one = violations.groupBy(*keys).agg(F.min(F.struct(F.coalesce(F.try_element_at(order, F.col("rule")), F.lit(len(steps))).alias("o"), "rule", "message")).alias("v"))
    return one.select(*keys, "v.rule", "v.message")


def verdicts(all_: DataFrame, failures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """all_ with success and what failed first."""
    return all_.join(failures, list(keys), "left").withColumn("success", F.col("rule").isNull())


def route(failures: DataFrame, narrow: Sequence[str], wide_messages: Sequence[str]) -> DataFrame:
    """failures with patch: db_only for the rules of narrow unless the message holds one of wide_messages, which speak
    of the task itself; else task_and_db."""
    wide = F.lit(False)
    for m in wide_messages:
        wide = wide | F.coalesce(F.contains("message", F.lit(m)), F.lit(False))
    return failures.withColumn("patch", F.when(F.col("rule").isin(*narrow) & ~wide, "db_only").otherwise("task_and_db"))


def at_most(candidates: DataFrame, keys: Sequence[str], priority: Sequence[str], limit: int) -> DataFrame:
    """The first `limit` candidates of each key in the order of priority (a report of the top few)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*priority))
    return candidates.select(*keys, *priority).withColumn("_n", place).where(F.col("_n") <= limit).drop("_n")  # limited before the shuffle


def usage_costs(usage: DataFrame, prices: dict[str, tuple[float, float]], default: tuple[float, float]) -> DataFrame:
    """usage (model, prompt_tokens, completion_tokens) with cost_usd, DECIMAL(18,9), by prices per million tokens of
    input and output; the model's name counts from its last slash on, unknown ones cost the default."""
    name = F.substring_index("model", "/", -1)
    pick = lambda i: F.coalesce(*([F.try_element_at(F.create_map(*(F.lit(x) for m, p in prices.items() for x in (m, p[i]))), name)] if prices else []), F.lit(default[i]))
    return usage.withColumn("cost_usd", ((F.col("prompt_tokens") * pick(0) + F.col("completion_tokens") * pick(1)) / 1e6).cast("decimal(18,9)"))


def collisions(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of new whose keys exist already."""
    return new.join(existing.select(*keys).distinct(), list(keys), "left_semi")
