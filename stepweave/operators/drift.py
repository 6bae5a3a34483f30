"""Schemas that drift between files, by tagged-union inference.

Every value keeps a tag, its kind. Per file and field the tags are counted (the union of alternatives of that path),
counts of separate parts add up, so parts of a file fuse in any order. paths() does so for every path below the top
level too. Files of a feed are compared in the order of their export; conflicting kinds become typed branches beside one
canonical text in consistent().
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checked_broadcast, cut

#: Kinds of values, in the order that settles ties of the most frequent one.
KINDS = ("string", "integer", "decimal", "boolean", "array", "object")
_KIND_OF = {str: "string", int: "integer", Decimal: "decimal", bool: "boolean", list: "array", dict: "object", type(None): "null"}
#: A file has a field when more than one in so many of its records carry it.
CARRY = 20
#: A field was renamed when at least so many of so many pairs of values agree.
AGREE, OF = 4, 5


def tagged(raw: DataFrame, ids: dict[str, str]) -> DataFrame:
    """One row per top-level field of each record: feed_id, file_no, exported_at, entity, row_id, record_id, field, kind
    (null for a null), text (the value as text, objects with sorted names), value (variant).

    raw has feed_id, file_no, exported_at, entity, row_id and body; a repeated row counts once. Bodies that are null,
    not valid JSON (which a name given twice in one object isn't here) or no object give nothing. A whole number of 19
    digits and more is an integer too. ids gives the name of each entity's record id. All in the JVM."""
    kept = raw.select("feed_id", "file_no", "exported_at", "entity", "row_id", "body")
    one = kept.where(F.col("row_id").isNotNull()).groupBy("feed_id", "file_no", "entity", "row_id").agg(F.max_by("exported_at", "body").alias("exported_at"), F.max("body").alias("body"))
    one = one.unionByName(kept.where(F.col("row_id").isNull()).distinct())
    objects = one.where(F.rlike("body", F.lit(r"(?s)^\s*\{.*\}\s*$"))).withColumn("body", F.try_parse_json("body"))
    records = objects.where(F.col("body").isNotNull()).withColumn("members", F.col("body").cast("map<string,variant>"))
    id_name = F.create_map(*(F.lit(x) for kv in ids.items() for x in kv))[F.col("entity")]
    entry = records.withColumn("record_id", F.try_element_at("members", id_name).cast("string") if ids else F.lit(None).cast("string"))
    entry = entry.select("feed_id", "file_no", "exported_at", "entity", "row_id", "record_id", F.explode("members").alias("field", "value"))
    entry, schema = entry.withColumn("schema", F.schema_of_variant("value")), F.col("schema")  # once per value
    kind = (
        F.when(schema == "STRING", "string")
        .when((schema == "BIGINT") | schema.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "integer")
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "decimal")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
    )
    text = F.when(F.col("kind").isin("array", "object"), F.to_json("value")).when(F.col("kind").isNotNull(), F.col("value").cast("string"))
    return entry.withColumn("kind", kind).withColumn("text", text).drop("schema")


def file_fields(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, present): files has feed_id, file_no, exported_at, records, prev_no (the file before); present has
    feed_id, file_no, field, kind (the most frequent, null when all values are), kinds (count per kind) of the fields
    that more than one in CARRY records carry. Records that have no field at all count as none."""
    counts = fields.groupBy("feed_id", "file_no", "field").agg(F.count(F.lit(1)).alias("carriers"), *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS), F.min("exported_at").alias("exported_at"))
    records = fields.select("feed_id", "file_no", "row_id", "exported_at").groupBy("feed_id", "file_no").agg(F.count_distinct(F.coalesce(F.col("row_id").cast("string"), F.lit(""))).alias("records"), F.min("exported_at").alias("exported_at"))
    w = Window.partitionBy("feed_id").orderBy("exported_at", "file_no")
    files = records.withColumn("prev_no", F.lag("file_no").over(w))
    ranked = F.array_max(F.array(*(F.struct(F.col(k).alias("n"), F.lit(-i).alias("rank"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS))))
    present = counts.drop("exported_at").join(files.select("feed_id", "file_no", "records"), ["feed_id", "file_no"]).where(F.col("carriers") * CARRY > F.col("records"))
    return files, present.select("feed_id", "file_no", "field", F.when(ranked["n"] > 0, ranked["kind"]).alias("kind"), F.create_map(*(x for k in KINDS for x in (F.lit(k), F.col(k)))).alias("kinds"), "carriers", "records")


def changes(fields: DataFrame) -> DataFrame:
    """Every change between a file and the one before: (feed_id, file_no, change, old_field, new_field).

    A field that goes and one that comes are `renamed` when of the record ids with a value of both, at least AGREE in
    OF agree as text; a field may be so in several pairs, and all are given. Of an id that a file holds repeatedly, the
    least text counts. The first file of a feed gives none. Values are only compared for fields that come or go, by
    record id: no group is larger than the copies of one record. Bodies are parsed once: the tagged fields are cut."""
    fields = cut(fields.select("feed_id", "file_no", "exported_at", "row_id", "record_id", "field", "kind", "text"))
    files, present = (cut(x) for x in file_fields(fields))
    follow = files.where(F.col("prev_no").isNotNull()).select("feed_id", "file_no", "prev_no")
    new = present.join(follow, ["feed_id", "file_no"], "left_semi").select("feed_id", "file_no", "field", F.col("kind").alias("new_kind"), F.lit(True).alias("is_new"))
    old = present.select("feed_id", F.col("file_no").alias("prev_no"), "field", F.col("kind").alias("old_kind"), F.lit(True).alias("is_old")).join(follow, ["feed_id", "prev_no"]).drop("prev_no")
    both = new.join(old, ["feed_id", "file_no", "field"], "full")
    retyped = both.where((F.col("is_new") & F.col("is_old")) & (F.col("new_kind") != F.col("old_kind"))).select("feed_id", "file_no", F.lit("retyped").alias("change"), F.col("field").alias("old_field"), F.col("field").alias("new_field"))
    come = both.where(F.col("is_old").isNull()).select("feed_id", "file_no", F.col("field").alias("new_field"))
    gone = both.where(F.col("is_new").isNull()).select("feed_id", "file_no", F.col("field").alias("old_field"))
    pairs = checked_broadcast(cut(gone.join(come, ["feed_id", "file_no"]).join(follow, ["feed_id", "file_no"])))
    values = fields.where(F.col("record_id").isNotNull() & F.col("text").isNotNull()).select("feed_id", F.col("file_no").alias("at_no"), "record_id", "field", "text")
    keys = ["feed_id", "file_no", "old_field", "new_field", "record_id"]
    left = values.join(pairs.withColumnsRenamed({"prev_no": "at_no"}).withColumn("field", F.col("old_field")), ["feed_id", "at_no", "field"]).groupBy(keys).agg(F.min("text").alias("was"))
    right = values.join(pairs.withColumn("at_no", F.col("file_no")).withColumn("field", F.col("new_field")), ["feed_id", "at_no", "field"]).groupBy(keys).agg(F.min("text").alias("now"))
    agree = left.join(right, keys).groupBy(keys[:4]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("was") == F.col("now")).alias("same"))
    renamed = agree.where(F.col("same") * OF >= F.col("n") * AGREE).select("feed_id", "file_no", F.lit("renamed").alias("change"), "old_field", "new_field")
    added = come.join(renamed, ["feed_id", "file_no", "new_field"], "left_anti").select("feed_id", "file_no", F.lit("added").alias("change"), F.lit("").alias("old_field"), "new_field")
    removed = gone.join(renamed, ["feed_id", "file_no", "old_field"], "left_anti").select("feed_id", "file_no", F.lit("removed").alias("change"), "old_field", F.lit("").alias("new_field"))
    return renamed.unionByName(added).unionByName(removed).unionByName(retyped)


def alternatives(fields: DataFrame) -> DataFrame:
    """(feed_id, file_no, field, kind, n): kinds that a field has in a file, in n records, and hadn't in the file before,
    which has the field as well; stray values show here before they become a change of kind."""
    files, present = file_fields(fields)
    each = present.select("feed_id", "file_no", "field", F.explode("kinds").alias("kind", "n"))
    old = each.select("feed_id", F.col("file_no").alias("prev_no"), "field", "kind", F.col("n").alias("old_n"))
    both = each.join(files.where(F.col("prev_no").isNotNull()).select("feed_id", "file_no", "prev_no"), ["feed_id", "file_no"]).join(old, ["feed_id", "prev_no", "field", "kind"])
    return both.where((F.col("n") > 0) & (F.col("old_n") == 0)).select("feed_id", "file_no", "field", "kind", "n")


def paths(fields: DataFrame) -> DataFrame:
    """Alternative types of every path: (feed_id, file_no, path, kind, n), in how many records of a file a path has a kind.

    fields are those of tagged(). A path is a field's name, then `.name` for the members of an object and `[]` for the
    elements of an array, at any depth; kinds are those of KINDS and `null`. A record that has a kind at a path
    repeatedly, as in an array, counts once. Each batch of records is summed up before the only shuffle."""
    kept = fields.select("feed_id", "file_no", "field", "kind", F.when(F.col("kind").isin("array", "object"), F.col("text")).alias("below"))
    scalar = kept.where(F.col("below").isNull()).select("feed_id", "file_no", F.col("field").alias("path"), F.coalesce("kind", F.lit("null")).alias("kind"), F.lit(1).cast("long").alias("n"))
    spec = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for feed, file, field, text in zip(*(b.column(c).to_pylist() for c in ("feed_id", "file_no", "field", "below"))):
                found, todo = set(), [(field, json.loads(text, parse_float=Decimal))]
                while todo:
                    path, v = todo.pop()
                    found.add((path, _KIND_OF[type(v)]))
                    if isinstance(v, dict):
                        todo.extend((f"{path}.{k}", x) for k, x in v.items())
                    elif isinstance(v, list):
                        todo.extend((path + "[]", x) for x in v)
                counts.update((feed, file, p, k) for p, k in found)
            feeds, files, ps, ks = zip(*counts) if counts else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(feeds, b.schema.field("feed_id").type), pa.array(files, b.schema.field("file_no").type), pa.array(ps, pa.string()), pa.array(ks, pa.string()), pa.array(list(counts.values()), pa.int64())], ["feed_id", "file_no", "path", "kind", "n"])

    deep = kept.where(F.col("below").isNotNull()).mapInArrow(walk, f"feed_id {spec['feed_id']}, file_no {spec['file_no']}, path string, kind string, n long")
    return scalar.unionByName(deep).groupBy("feed_id", "file_no", "path", "kind").agg(F.sum("n").alias("n"))


def path_alternatives(fields: DataFrame) -> DataFrame:
    """(feed_id, file_no, path, kind, n): kinds that a path has in a file and hadn't in the file before, which has the path as
    well: where a type begins to drift, below the top level too. Paths that come anew are no alternatives."""
    files, _ = file_fields(fields)
    follow = files.where(F.col("prev_no").isNotNull()).select("feed_id", "file_no", "prev_no")
    each = cut(paths(fields))
    old = each.groupBy("feed_id", F.col("file_no").alias("prev_no"), "path").agg(F.collect_set("kind").alias("before"))  # seven kinds at most
    both = each.join(follow, ["feed_id", "file_no"]).join(old, ["feed_id", "prev_no", "path"])
    return both.where(~F.array_contains("before", F.col("kind"))).select("feed_id", "file_no", "path", "kind", "n")


def lineages(change_rows: DataFrame) -> DataFrame:
    """The canonical name of each renamed field: (feed_id, field, canonical), the name that a chain of renames began
    with; of several old names the least is followed. A chain that ends in a circle has no beginning: its least name
    counts. Chains are followed by pointer doubling over the renames alone, whose number is that of schema changes, not
    of rows: after k rounds a name knows the least of the 2^k names behind it and the first one, if it is among them. When
    a round changes neither, every chain has been followed to its end and every circle once around."""
    step = change_rows.where((F.col("change") == "renamed") & (F.col("old_field") != F.col("new_field"))).groupBy("feed_id", F.col("new_field").alias("field")).agg(F.min("old_field").alias("to"))
    step = cut(step.select("feed_id", "field", "to", F.least("field", "to").alias("least"), F.lit(True).alias("open")))
    while True:
        over = step.select("feed_id", F.col("field").alias("to"), F.col("to").alias("further"), F.col("least").alias("low"), F.col("open").alias("more"))
        moved = step.join(over, ["feed_id", "to"], "left").select("feed_id", "field", F.coalesce("further", "to").alias("to"), F.coalesce(F.least("least", "low"), "least").alias("least"), F.coalesce("more", F.lit(False)).alias("open"), F.col("least").alias("was"), F.col("open").alias("was_open"))
        moved = cut(moved)
        step = moved.drop("was", "was_open")
        if not moved.where((F.col("least") != F.col("was")) | (F.col("open") != F.col("was_open"))).limit(1).count():
            break
    return step.select("feed_id", "field", F.when(F.col("open"), F.col("least")).otherwise(F.col("to")).alias("canonical"))


def consistent(fields: DataFrame, change_rows: DataFrame) -> DataFrame:
    """One consistent table of all entities in long form: entity, feed_id, file_no, row_id, record_id, field (canonical
    name), source_field, kind, the branches as_string, as_integer, as_decimal, as_boolean and as_json (at most one is
    non-null, that of the value's own kind), and canonical, the value as text. Keeps every value, stray ones included."""
    names = lineages(change_rows)
    whole = fields.join(names, ["feed_id", "field"], "left")
    v = F.col("value")
    return whole.select(
        "entity", "feed_id", "file_no", "row_id", "record_id", F.coalesce("canonical", "field").alias("field"), F.col("field").alias("source_field"), "kind",
        F.when(F.col("kind") == "string", F.col("text")).alias("as_string"),
        F.when(F.col("kind") == "integer", F.try_variant_get(v, "$", "bigint")).alias("as_integer"),
        F.when(F.col("kind") == "decimal", F.try_variant_get(v, "$", "double")).alias("as_decimal"),
        F.when(F.col("kind") == "boolean", F.try_variant_get(v, "$", "boolean")).alias("as_boolean"),
        F.when(F.col("kind").isin("array", "object"), F.col("text")).alias("as_json"),
        F.col("text").alias("canonical"),
    )


TELECOM_IDS = {"device": "device_id", "customers": "customer_id", "lines": "line_id"}


#: Fields of an entity's table at most; more are an error, as they would be values taken for names.
#: The long form of consistent() holds any number.
MOST_FIELDS = 5_000
_TYPES = {"string": "string", "integer": "bigint", "decimal": "double", "boolean": "boolean", "array": "string", "object": "string"}


def entity_table(long: DataFrame, present: DataFrame, entity: str) -> DataFrame:
    """One row per record of an entity: feed_id, file_no, row_id, record_id, a column per field, branches, and other.

    long is that of consistent(), present that of file_fields(). A field that some file has is a column of its most
    frequent kind (ties by KINDS), under its canonical name: values of other kinds are converted to it where that is
    possible, and stand as they are in a branch <field>__<kind> for each other kind that occurs. Arrays and objects are
    JSON. Fields that no file has as a whole are kept in the map other. Names that differ in case only get a suffix."""
    mine = long.where(F.col("entity") == entity)
    whole = mine.join(present.select("feed_id", F.col("field").alias("source_field")).distinct(), ["feed_id", "source_field"], "left_semi")
    kinds = whole.where(F.col("kind").isNotNull()).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n")).limit(MOST_FIELDS + 1).collect()
    if len(kinds) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields and kinds")
    fields: dict[str, dict[str, int]] = {}
    for r in kinds:
        fields.setdefault(r.field, {})[r.kind] = r.n
    columns, taken = [], {"feed_id", "file_no", "row_id", "record_id", "other"}

    def name(n: str) -> str:
        k, base = 2, n
        while n.lower() in taken:
            n, k = f"{base}__{k}", k + 1
        taken.add(n.lower())
        return n

    for f in sorted(fields):
        main = max(KINDS, key=lambda k, f=f: (fields[f].get(k, 0), -KINDS.index(k)))
        is_f = F.col("field") == f
        columns.append(F.max(F.when(is_f, F.col("canonical"))).try_cast(_TYPES[main]).alias(name(f)))
        columns += [F.max(F.when(is_f & (F.col("kind") == k), F.col("canonical"))).try_cast(_TYPES[k]).alias(name(f"{f}__{k}")) for k in KINDS if k != main and k in fields[f]]
    other = F.map_from_entries(F.array_distinct(F.collect_list(F.when(~F.col("field").isin(*fields) if fields else F.lit(True), F.struct("field", "canonical")))))
    return mine.groupBy("feed_id", "file_no", "row_id", "record_id").agg(*columns, other.alias("other"))
