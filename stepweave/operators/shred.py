"""Deeply nested records as flat tables, by Dewey labels.

A walk over each document gives every object node its ordinal path (label: the position among its siblings at each
depth) and its named path (steps). A parent's label is a prefix of its children's, so the link to the parent is the
label cut short, without a join; nodes that share a schema path form one table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def _reject(constant: str):
    raise ValueError(constant)


def _open(value):
    """A value, or the content of a string that holds JSON, however often it is wrapped: each opening leaves a shorter
    string. A string that begins like JSON and doesn't parse is null."""
    while isinstance(value, str) and (head := value.lstrip()[:1]) and head in '{["':
        try:
            value = json.loads(value, parse_constant=_reject)
        except (ValueError, RecursionError):
            return None if head in "{[" else value
    return value


def _text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def _nodes(value, collections: Mapping[str, str | None], root: str) -> Iterator[tuple]:
    """(label, steps, path, attrs) of every object of one document, parents first. Iterative: depth is no limit."""
    todo = [(_open(value), [], [root], root)]
    while todo:
        v, label, steps, path = todo.pop()
        if path in collections:
            if isinstance(v, dict):
                opened = {k: _open(x) for k, x in v.items()}
                if all(x is None or isinstance(x, dict) for x in opened.values()):
                    elements = list(opened.items())
                else:
                    elements = [("0", v)]
            elif isinstance(v, list):
                own, elements = collections[path], []
                for i, x in enumerate(map(_open, v)):
                    k = x.get(own) if own and isinstance(x, dict) else None
                    elements.append((str(i) if k in (None, "") or isinstance(k, (dict, list)) else _text(k), x))
            else:
                continue
            below = path + "/*"
            for i in range(len(elements) - 1, -1, -1):
                k, x = elements[i]
                if isinstance(x, dict):
                    todo.append((x, [*label, i], [*steps, k], below))
            continue
        if isinstance(v, dict):
            attrs, deeper = [], []
            for i, (k, x) in enumerate(v.items()):
                x = _open(x)
                if isinstance(x, (dict, list)):
                    deeper.append((x, [*label, i], [*steps, k], path + "/" + k.replace("/", "~1")))
                elif x is not None:
                    attrs.append((k, _text(x)))
            yield label, steps, path, attrs
            todo.extend(reversed(deeper))
        elif isinstance(v, list):
            todo.extend((x, [*label, i], [*steps, str(i)], path + "/[]") for i, x in reversed(list(enumerate(map(_open, v)))) if isinstance(x, (dict, list)))


def dewey_nodes(df: DataFrame, id_column: str, documents: list[str], collections: Mapping[str, str | None]) -> DataFrame:
    """Every object in the JSON of the documents' columns: (id_column, label, steps, path, attrs).

    path is the schema path, with the column's name as its root, `*` for the elements of a collection and `[]` for
    those of other lists. collections maps a collection's schema path to the name of its records' own id, or None. In
    a collection, an object whose values are all objects or null holds records by name; a list holds records, named by
    their own id or else by position; any other object is one record, named 0. Nulls give no node and keep their
    position. A string that holds JSON counts as its content, also repeatedly; JSON that doesn't parse, null and empty
    documents give nothing. attrs holds a record's scalars as text. One pass, no shuffle; a record is never split."""
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, label array<int>, steps array<string>, path string, attrs map<string,string>"
    arrow = pa.map_(pa.string(), pa.string())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, labels, steps, paths, attrs = [], [], [], [], []

            def flush():
                return pa.RecordBatch.from_arrays([batch.column(id_column).take(pa.array(at, pa.int64())), pa.array(labels, pa.list_(pa.int32())), pa.array(steps, pa.list_(pa.string())), pa.array(paths, pa.string()), pa.array(attrs, arrow)], [id_column, "label", "steps", "path", "attrs"])

            for column in documents:
                for i, text in enumerate(batch.column(column).to_pylist()):
                    if text is None:
                        continue
                    for label, step, path, attr in _nodes(text, collections, column):
                        at.append(i)
                        labels.append(label)
                        steps.append(step)
                        paths.append(path)
                        attrs.append(attr)
                    if len(at) > 20_000:
                        yield flush()
                        at, labels, steps, paths, attrs = [], [], [], [], []
            yield flush()

    return df.select(id_column, *documents).mapInArrow(walk, schema)


def child_tables(nodes: DataFrame, id_column: str, tables: list[tuple[str, str, int]]) -> DataFrame:
    """The records of tables as (id_column, child_table, parent_label, label, parent_key, child_key, attrs).

    tables holds (table, schema path of its records, levels up to the parent, or 0 for none). The parent's label and
    key are the record's own, cut by so many levels. tables is matched in the JVM by schema path."""
    to = F.create_map(*(F.lit(x) for t, path, _ in tables for x in (path, t)))
    ups = F.create_map(*(F.lit(x) for _, path, up in tables for x in (path, up)))
    known = nodes.where(F.col("path").isin([path for _, path, _ in tables]))
    up, depth = ups[F.col("path")], F.size("label")
    return known.select(
        id_column,
        to[F.col("path")].alias("child_table"),
        F.when(up > 0, F.slice("label", F.lit(1), F.greatest(depth - up, F.lit(0)))).alias("parent_label"),
        "label",
        F.when(up > 0, F.element_at("steps", depth + 1 - up)).otherwise("").alias("parent_key"),
        F.element_at("steps", -1).alias("child_key"),
        "attrs",
    )


_AGENT = "initial_state/initialization_data/agent_data"

#: Tables of tasks: collection below agent_data, table, own id; and below those: table, collection, child table, own id.
_TOP = [("users", "user", "user_id"), ("reservations", "reservation", "reservation_id"), ("flights", "flight", "flight_number"), ("orders", "order", "order_id"), ("products", "product", "product_id"), ("customers", "customer", "customer_id"), ("lines", "line", "line_id"), ("bills", "bill", "bill_id"), ("devices", "device", "device_id"), ("plans", "plan", "plan_id")]
_BELOW = [("users", "payment_methods", "payment_method"), ("customers", "payment_methods", "payment_method"), ("reservations", "flights", "leg"), ("reservations", "passengers", "passenger"), ("flights", "dates", "flight_date"), ("orders", "items", "order_item"), ("products", "variants", "variant"), ("bills", "line_items", "bill_item")]
_APPS, _ACTIONS = "initial_state/initialization_data/user_data/device/app_statuses", "evaluation_criteria/actions"

TASK_COLLECTIONS: dict[str, str | None] = {f"{_AGENT}/{c}": i for c, _, i in _TOP} | {f"{_AGENT}/{c}/*/{d}": None for c, d, _ in _BELOW} | {_APPS: "app_name", _ACTIONS: None, f"{_ACTIONS}/*/arguments/flights": None, f"{_ACTIONS}/*/arguments/payment_methods": None}
TASK_TABLES = [(t, f"{_AGENT}/{c}/*", 0) for c, t, _ in _TOP] + [(t, f"{_AGENT}/{c}/*/{d}/*", 2) for c, d, t in _BELOW] + [("app_status", _APPS + "/*", 2), ("action", _ACTIONS + "/*", 0), ("action_leg", f"{_ACTIONS}/*/arguments/flights/*", 3), ("action_payment", f"{_ACTIONS}/*/arguments/payment_methods/*", 3)]


def task_tables(tasks: DataFrame) -> DataFrame:
    """All child tables of tasks in one long form; repeated deliveries of a row are collapsed by their labels."""
    nodes = dewey_nodes(tasks, "row_id", ["initial_state", "evaluation_criteria"], TASK_COLLECTIONS)
    return child_tables(nodes, "row_id", TASK_TABLES)


#: Names of a table's scalars at most; more are an error, as they would be values taken for names. The long form of
#: child_tables() and attributes() holds any number.
MOST_COLUMNS = 2_000


def attributes(tables: DataFrame, id_column: str) -> DataFrame:
    """(id_column, child_table, parent_key, child_key, name, value): every scalar of child_tables(), in long form."""
    return tables.select(id_column, "child_table", "parent_key", "child_key", F.explode("attrs").alias("name", "value"))


def flat_table(tables: DataFrame, id_column: str, child_table: str) -> DataFrame:
    """One of child_tables() as a flat table: id_column, parent_label, label, parent_key, child_key and a text column per
    scalar; names that are taken, in any case, get a suffix. Repeated records count once."""
    mine = tables.where(F.col("child_table") == child_table)
    names = sorted(r[0] for r in mine.select(F.explode(F.map_keys("attrs"))).distinct().limit(MOST_COLUMNS + 1).collect())
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} names")
    columns, taken = [], {id_column.lower(), "parent_label", "label", "parent_key", "child_key"}
    for n in names:
        as_, k = n, 2
        while as_.lower() in taken:
            as_, k = f"{n}__{k}", k + 1
        taken.add(as_.lower())
        columns.append(F.try_element_at("attrs", F.lit(n)).alias(as_))
    dotted = lambda c: F.array_join(F.col(c), ".").alias(c)
    return mine.select(id_column, dotted("parent_label"), dotted("label"), "parent_key", "child_key", *columns).distinct()
