"""Entities kept as maps or lists of records: normal forms, merges, back links, follow-up steps, redaction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ngram import uniform


def map_to_list(m: Column, id_name: str) -> Column:
    """A map of structs as a list of structs that have their key as id_name, ordered by key."""
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: F.struct(e["key"].alias(id_name), e["value"].alias("record")))


def list_to_map(items: Column, id_name: str) -> Column:
    """A list of structs as a map by their id_name; of repeated ids the last counts, null ids are left out."""
    kept = F.filter(items, lambda e: e[id_name].isNotNull())
    return F.aggregate(kept, F.create_map().cast("map<string,string>"), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != e[id_name].cast("string")), F.create_map(e[id_name].cast("string"), F.to_json(e))))


def _without(record: Column, name: str) -> Column:
    return F.map_filter(record, lambda k, _: k != name)


def rename_fields(record: Column, aliases: Mapping[str, str | None]) -> Column:
    """A map<string,string> with wrong names put right: an alias becomes its name if that is absent, else it is dropped;
    an alias of None is dropped."""
    out = record
    for wrong, right in aliases.items():
        without = _without(out, wrong)
        if right is None:
            out = without
        else:
            put = F.map_contains_key(out, wrong) & ~F.map_contains_key(out, right)
            out = F.when(put, F.map_concat(without, F.create_map(F.lit(right), F.try_element_at(out, F.lit(wrong))))).otherwise(without)
    return out


def merge_scalars(changes: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keys..., fields...): each field's last non-null value in the order given. Aggregated before the shuffle."""
    rank = F.struct(*order)
    return changes.groupBy(*keys).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields))


def merge_lists(changes: DataFrame, keys: Sequence[str], field: str, order: str) -> DataFrame:
    """(keys..., field): the distinct elements of a list field, each where it first appeared, by order and then by place
    and text. Elements are deduplicated before they are gathered."""
    each = changes.select(*keys, F.col(order).alias("_at"), F.posexplode(field).alias("_pos", "_e")).where(F.col("_e").isNotNull())
    first = each.groupBy(*keys, "_e").agg(F.min(F.struct("_at", "_pos")).alias("_first"))
    gathered = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_first", "_e"))).alias("_l"))
    return gathered.select(*keys, F.transform("_l", lambda x: x["_e"]).alias(field))


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base with the rows of new: inserted, or merged field by field where keys are equal; new's nulls change nothing."""
    fields = [c for c in base.columns if c not in keys]
    joined = base.alias("b").join(new.alias("n"), list(keys), "full")
    return joined.select(*keys, *(F.coalesce(F.col(f"n.{f}"), F.col(f"b.{f}")).alias(f) if f in new.columns else F.col(f"b.{f}").alias(f) for f in fields))


def back_links(owners: DataFrame, owned: DataFrame, key: str, links: str, item: str) -> DataFrame:
    """(key, links): each owner's list of links with the items of owned (key, item) added, distinct and sorted."""
    listed = owners.select(key, F.explode(links).alias("_e"))
    both = listed.unionByName(owned.join(owners.select(key).distinct(), key, "left_semi").select(key, F.col(item).alias("_e"))).where(F.col("_e").isNotNull())
    return owners.select(key).distinct().join(both.groupBy(key).agg(F.sort_array(F.collect_set("_e")).alias(links)), key, "left").select(key, F.coalesce(links, F.array().cast("array<string>")).alias(links))


def missing_follow_ups(actions: DataFrame, keys: Sequence[str], position: str, trigger: Column, other: Column, follower: Column) -> DataFrame:
    """The rows of actions where `trigger` holds and the next row of the same keys where `other` holds isn't one where
    `follower` holds, or there is none: where a follow-up step must be put in."""
    w = Window.partitionBy(*keys).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, -1)  # runs backwards: one pass
    flagged = actions.withColumns({"_t": F.coalesce(trigger, F.lit(False)), "_f": F.when(F.coalesce(other, F.lit(False)), F.coalesce(follower, F.lit(False)))})
    return flagged.withColumn("_next", F.last("_f", ignorenulls=True).over(w)).where(F.col("_t") & ~F.coalesce("_next", F.lit(False))).drop("_t", "_f", "_next")


def with_follow_ups(actions: DataFrame, missing: DataFrame, position: str, action_id: str, changes: Mapping[str, Column], prefix: str) -> DataFrame:
    """actions with a follow-up step put in right after each row of missing (rows of actions): its columns are those of that
    row with changes, its id the row's with a prefix, its position half a step on."""
    new = missing.withColumns({**changes, action_id: F.concat(F.lit(prefix), F.col(action_id).cast("string")), position: F.col(position) + 0.5})
    return actions.withColumn(position, F.col(position).cast("double")).unionByName(new.select(*actions.columns))


def assembled(tasks: DataFrame, basis: Sequence[str] = ("DB", "COMMUNICATE")) -> DataFrame:
    """(row_id, task_id, n_actions, reward_basis) of tasks whose criteria hold a list of actions: what a task is made of, with
    the default basis where it names none."""
    v = F.try_parse_json("evaluation_criteria")
    v = F.coalesce(F.try_parse_json(F.try_variant_get(v, "$", "string")), v)
    actions = F.try_variant_get(v, "$.actions", "array<variant>")
    named = F.try_variant_get(v, "$.reward_basis", "array<string>")
    return tasks.select("row_id", "task_id", F.size(actions).alias("n_actions"), F.coalesce(named, F.array(*map(F.lit, basis))).alias("reward_basis"), actions.isNotNull().alias("_ok")).where("_ok").drop("_ok")


def patched(record: Column, patch: Column, fields: Sequence[str]) -> Column:
    """A struct with the fields of another one, where that has them."""
    for f in fields:
        record = record.withField(f, F.coalesce(patch[f], record[f]))
    return record


def called(messages: DataFrame, column: str) -> DataFrame:
    """messages with pos, name and arguments of each action that a message's JSON calls: those of the list tool_calls, else the
    one of function_call. Name and arguments have several spellings; arguments that are a JSON string are opened, and those
    that don't parse are kept as they are. A message that calls nothing, or isn't JSON, gives no row."""
    v = F.try_parse_json(column)
    many = F.try_variant_get(v, "$.tool_calls", "array<variant>")
    one = F.try_variant_get(v, "$.function_call", "variant")
    rows = messages.select("*", F.posexplode(F.when(F.size(many) > 0, many).when(one.isNotNull() & ~F.is_variant_null(one), F.array(one))).alias("pos", "_c"))
    inner = F.coalesce(F.try_variant_get("_c", "$.function", "variant"), F.col("_c"))
    rows = rows.withColumn("_f", inner)
    first = lambda kind, *names: F.coalesce(*(F.try_variant_get("_f", f"$.{n}", kind) for n in names))
    args = first("variant", "arguments", "args", "parameters")
    spelled = F.when(F.schema_of_variant(args) == "STRING", args.cast("string"))
    return rows.select(*messages.columns, "pos", first("string", "name", "tool_name", "action_name").alias("name"), F.coalesce(F.to_json(F.try_parse_json(spelled)), spelled, F.to_json(args), F.lit("{}")).alias("arguments"))


#: Cells that the hashes of a group's rows are cut into.
CELLS = 1_024


def redact(actions: DataFrame, group: Sequence[str], key: Sequence[str], share: float, arguments: str, may: Column, seed: int = 0) -> DataFrame:
    """actions with covered: of each group's rows where `may` holds, the share (at least one if share > 0, rounded down)
    with the least hash is covered, and its JSON arguments keep their names only, as name=???.

    Hashes are cut into CELLS equal cells. Counts of a group's cells say in which cell its share ends: rows in cells before
    it are covered, and only those in it are ranked, so that a group with most of the rows is spread over its cells. The
    key names a row; rows that share one are ranked in any order."""
    u = uniform(*key, seed=seed)
    names_of = {g: f"_g{i}" for i, g in enumerate(group)}
    flagged = actions.withColumns({"_may": F.coalesce(may, F.lit(False)), "_u": u, "_cell": F.floor(u * CELLS).cast("int")})
    cells = flagged.where("_may").groupBy(*(F.col(g).alias(n) for g, n in names_of.items()), F.col("_cell").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*names_of.values())
    before = F.sum("_n").over(whole.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumns({"_before": F.coalesce(before, F.lit(0)), "_want": F.greatest(F.lit(1), F.floor(F.sum("_n").over(whole) * share))})
    same = F.col("_cell") == F.col("_c")
    for g, n in names_of.items():
        same = same & F.col(g).eqNullSafe(F.col(n))
    rank = F.row_number().over(Window.partitionBy(*group, "_cell", "_may").orderBy("_u", *key))
    placed = flagged.join(cells, same, "left").withColumn("_rank", rank)
    covered = F.lit(share > 0) & F.col("_may") & (F.col("_before") + F.col("_rank") <= F.col("_want"))
    actions = placed.withColumn("covered", F.coalesce(covered, F.lit(False))).drop("_may", "_u", "_cell", "_c", "_n", "_before", "_want", "_rank", *names_of.values())
    names = F.map_keys(F.from_json(arguments, "map<string,string>"))
    return actions.withColumn("shown", F.when(F.col("covered"), F.array_join(F.transform(F.array_sort(names), lambda k: F.concat(k, F.lit("=???"))), ", ")).otherwise(F.col(arguments)))


def task_rows(tasks: DataFrame) -> DataFrame:
    """(row_id, task_id, pos, action_id, name, requestor, arguments, info) of each action of tasks, with their defaults:
    action_id the position, requestor assistant, info only if it is a string. Nulls keep their position, unread."""
    v = F.try_parse_json("evaluation_criteria")
    v = F.coalesce(F.try_parse_json(F.try_variant_get(v, "$", "string")), v)
    rows = tasks.select("row_id", "task_id", F.posexplode(F.try_variant_get(v, "$.actions", "array<variant>")).alias("pos", "a"))
    get = lambda *names: F.coalesce(*(F.try_variant_get("a", f"$.{n}", "string") for n in names))
    args = F.coalesce(*(F.try_variant_get("a", f"$.{n}", "variant") for n in ("arguments", "args", "parameters")))
    info = F.try_variant_get("a", "$.info", "variant")
    return rows.where(F.schema_of_variant("a").startswith("OBJECT")).select("row_id", "task_id", "pos", F.coalesce(get("action_id"), F.col("pos").cast("string")).alias("action_id"), get("name", "tool_name", "action_name").alias("name"), F.coalesce(get("requestor"), F.lit("assistant")).alias("requestor"), F.coalesce(F.to_json(args), F.lit("{}")).alias("arguments"), F.when(F.schema_of_variant(info) == "STRING", info.cast("string")).alias("info"))


def mismatches(expected: DataFrame, actual: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """(keys..., position, expected, actual) where two lists of steps differ at a position, or one has none there."""
    e = expected.select(*keys, position, F.col(value).alias("expected"))
    a = actual.select(*keys, position, F.col(value).alias("actual"))
    return e.join(a, [*keys, position], "full").where(~F.col("expected").eqNullSafe(F.col("actual")))


def split_by(df: DataFrame, kind: str, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of other kinds, rows of the kinds named); null kinds are other ones."""
    named = F.coalesce(F.col(kind).isin(*names), F.lit(False))
    return df.where(~named), df.where(named)


def described(entities: DataFrame, group: Sequence[str], kind: str, key: str, body: str) -> DataFrame:
    """(group..., summary): one line per entity, `kind key: body`, ordered by kind and key."""
    line = F.struct(kind, key, F.format_string("%s %s: %s", kind, key, body).alias("line"))
    listed = entities.groupBy(*group).agg(F.array_sort(F.collect_list(line)).alias("_l"))
    return listed.select(*group, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("summary"))
