"""References to records that do not exist, from signed counts of references and of existence per key.

A key with references and an existence of zero is an orphan, as of one of two times:

- of each reference's own time, in orphans(): every change of a target becomes a signed existence delta of its key, +1
  where a version begins to exist, -1 where it is deleted or replaced, and the running sum is read at every reference.
  Only the existence side is signed there, for a reference stays a fact of its own time, whatever comes later;
- now, in current_orphans(): fold() keeps signed counts of both sides from batch to batch. A record whose version is
  replaced or deleted takes back the existence and the references that it gave before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_digit, key_form
from ..session import checked_broadcast, cut

#: A key's day with more rows than this, and than one in HOT_SHARE of all, is spread over several tasks.
HOT_ROWS, HOT_SHARE = 20_000, 1_000
#: Parts that such a day is cut into, by quantiles of its times.
PARTS = 64
_DAY = 86_400_000_000


class _NotJson(ValueError):
    pass


def _reject(_: str):
    raise _NotJson


def _leaves(value) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for x in value:
            yield from _leaves(x)
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        yield json.dumps(value)


def named_values(df: DataFrame, column: str, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Every scalar in the JSON of a column, at any depth, whose name is one of names: the columns of keep, field (the
    name as given in names) and value. Names compare by their letters, in any case. A list under such a name gives
    each of its scalars. Null and what isn't valid JSON give no row; a name that is repeated in one object gives all."""
    known = {re.sub("[^a-z]", "", n.lower()): n for n in names}
    keep_fields = [f for f in df.select(*keep).schema.fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep_fields] + ["field string", "value string"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, str | None] = {}
        found: list[tuple[str, str]] = []

        def pairs(members: list[tuple]) -> dict:
            for k, v in members:
                if k not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[k] = known.get(re.sub("[^a-z]", "", k.lower()))
                if (name := seen[k]) is not None:
                    found.extend((name, x) for x in _leaves(v))
            return dict(members)

        decode = json.JSONDecoder(object_pairs_hook=pairs, parse_constant=_reject).decode
        for batch in batches:
            at, fields, values = [], [], []
            for i, text in enumerate(batch.column(column).to_pylist()):
                found.clear()
                if text is None:
                    continue
                try:
                    decode(text)
                except (ValueError, RecursionError):
                    continue
                for name, value in found:
                    at.append(i)
                    fields.append(name)
                    values.append(value)
            at = pa.array(at, pa.int64())
            columns = [batch.column(f.name).take(at) for f in keep_fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fields, pa.string()), pa.array(values, pa.string())], [*(f.name for f in keep_fields), "field", "value"])

    return df.select(*keep, column).mapInArrow(walk, schema)


def _collapsed(versions: DataFrame) -> DataFrame:
    """(target, ref_key, at, deleted_at): one row per key and time, that of the largest seq."""
    one = versions.where(F.col("ref_key").isNotNull() & F.col("at").isNotNull()).groupBy("target", "ref_key", "at").agg(F.max(F.struct("seq", "deleted_at")).alias("v"))
    return one.select("target", "ref_key", "at", "v.deleted_at")


def _of_day(at: str) -> Column:
    """Microseconds since the begin of the day."""
    return ((F.hour(at) * 3600 + F.minute(at) * 60) * F.lit(1_000_000).cast("long") + F.date_part(F.lit("SECOND"), F.col(at)) * 1_000_000).cast("long")


def _day(at: str) -> Column:
    return F.unix_date(F.to_date(at)).cast("long") * _DAY


def in_spans(log: DataFrame, n: int) -> list[DataFrame]:
    """A log cut into n batches by spans of equal length of its at, for replays; rows without a time are in none."""
    timed = cut(log.withColumn("_us", _day("at") + _of_day("at")))
    ends = timed.agg(F.min("_us").alias("lo"), F.max("_us").alias("hi")).first()
    if ends["lo"] is None:
        return [timed.drop("_us")]
    span = F.expr(f"(_us - {ends['lo']}) * {n} div {ends['hi'] - ends['lo'] + 1}")
    return [timed.where(span == i).drop("_us") for i in range(n)]


def _slotted(df: DataFrame, hot: DataFrame | None) -> DataFrame:
    """df with slot, the begin in microseconds of the part of time that at is in: its day, or for a key's hot day (target,
    ref_key, day, bounds) the part between two bounds. Slots are in the order of time."""
    day = _day("at")
    if hot is None:
        return df.withColumn("slot", day)
    known = df.withColumn("day", F.to_date("at")).join(F.broadcast(hot), ["target", "ref_key", "day"], "left")
    begun = F.coalesce(F.array_max(F.filter("bounds", lambda b: b <= F.col("_t"))), F.lit(0).cast("long"))
    return known.withColumn("_t", F.when(F.col("bounds").isNotNull(), _of_day("at"))).withColumn("slot", day + begun).drop("day", "bounds", "_t")


def _hot_days(refs: DataFrame, one: DataFrame, hot_rows: int, hot_share: int) -> tuple[DataFrame | None, int]:
    """(target, ref_key, day, bounds) of the days of keys that hold more than the limit of references or of versions, and
    the limit; None where there are none. They are at most two in hot_share of a day each, so their table is small."""
    on = ["target", "ref_key", "day"]
    both = refs.select("target", "ref_key", F.to_date("at").alias("day"), F.lit(1).alias("r"), F.lit(0).alias("v")).unionByName(one.select("target", "ref_key", F.to_date("at").alias("day"), F.lit(0).alias("r"), F.lit(1).alias("v")))
    days = cut(both.groupBy(*on).agg(F.sum("r").alias("r"), F.sum("v").alias("v")))
    total = days.agg(F.greatest(F.sum("r"), F.sum("v")).alias("t")).first()["t"] or 0
    limit = max(hot_rows, total // hot_share)
    over = days.where((F.col("r") > limit) | (F.col("v") > limit)).select(*on)
    if not over.limit(1).count():
        return None, limit
    times = refs.select("target", "ref_key", "at").unionByName(one.select("target", "ref_key", "at")).withColumn("day", F.to_date("at")).join(F.broadcast(over), on)
    cuts = F.percentile_approx(_of_day("at"), [i / PARTS for i in range(1, PARTS)], 10_000)
    return cut(times.groupBy(*on).agg(F.array_distinct(cuts).alias("bounds"))), limit


def _deltas(one: DataFrame, hot: DataFrame | None) -> DataFrame:
    on = ["target", "ref_key"]
    one = _slotted(one, hot)
    firsts = one.groupBy(*on, "slot").agg(F.min("at").alias("first_at")).select(*on, "slot", F.lead("first_at").over(Window.partitionBy(*on).orderBy("slot")).alias("later"))
    timed = one.withColumn("soon", F.lead("at").over(Window.partitionBy(*on, "slot").orderBy("at"))).join(firsts, [*on, "slot"])
    ends = timed.select(*on, "at", F.least(F.coalesce("soon", "later"), "deleted_at").alias("until")).where(F.col("until").isNull() | (F.col("until") > F.col("at")))
    both = F.array(F.struct(F.col("at").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("delta")))
    return ends.select(*on, F.inline(both)).where(F.col("at").isNotNull())


def existence_deltas(versions: DataFrame) -> DataFrame:
    """Signed existence deltas (target, ref_key, at, delta) of a whole change log (target, ref_key, at, seq, deleted_at).

    A version counts from its at to its deleted_at or the key's next version, whichever comes first, and not at all
    when it was deleted by then already. Of versions with one at, that of the largest seq rules. Rows without a key
    or an at change nothing. Repeated rows collapse in the first, partially aggregated step. The next version is looked
    for within a day, then among the first ones of later days, so a key with most of the rows is split by days."""
    return _deltas(_collapsed(versions), None)


def orphans(refs: DataFrame, versions: DataFrame, hot_rows: int = HOT_ROWS, hot_share: int = HOT_SHARE) -> DataFrame:
    """The references whose target doesn't exist at their own time: (src_table, src_row_id, ref_field, target, ref_key,
    at), distinct.

    refs has those columns, versions those of existence_deltas(). Per key, in order of time and with existence before
    references of the same instant, the running sum of existence deltas is read at every reference. The timeline of a
    key is split into days, each of which begins with what the days before add up to, from sums by key and day; days
    with very many references or versions are split further, by quantiles of their times. Where very many references
    still fall into one part, as when they all come at one instant, they are spread over salts, and the part's few
    deltas are repeated for each salt. References without a time or key are never due and give no row. Empty inputs
    give an empty result."""
    on = ["target", "ref_key", "slot"]
    refs = cut(refs.where(F.col("ref_key").isNotNull() & F.col("at").isNotNull()).select("src_table", "src_row_id", "ref_field", "target", "ref_key", "at"))
    one = cut(_collapsed(versions))
    hot, limit = _hot_days(refs, one, hot_rows, hot_share)
    placed = _slotted(refs, hot)
    counts = cut(placed.groupBy(*on).agg(F.count(F.lit(1)).alias("n")))
    salted = F.broadcast(counts.where(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("int").alias("salts")))
    spread = F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1))).cast("int")  # copies are spread too
    asked = placed.join(salted, on, "left").select(*on, spread.alias("salt"), "at", F.lit(1).alias("asks"), F.lit(0).cast("long").alias("delta"), "src_table", "src_row_id", "ref_field")
    deltas = cut(_slotted(_deltas(one, hot), hot))
    zero = F.lit(0).cast("long")
    slots = counts.select(*on, "n", zero.alias("s")).unionByName(deltas.select(*on, zero.alias("n"), F.col("delta").cast("long").alias("s"))).groupBy(*on).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    before = slots.withColumn("delta", F.sum("s").over(Window.partitionBy("target", "ref_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)))
    never = F.lit(None).cast(refs.schema["at"].dataType)  # sorts first
    carried = before.where((F.col("n") > 0) & (F.col("delta") != 0)).select(*on, never.alias("at"), F.lit(-1).alias("asks"), "delta")
    known = deltas.select(*on, "at", F.lit(0).alias("asks"), F.col("delta").cast("long").alias("delta")).unionByName(carried)
    told = known.join(salted, on, "left").select(*on, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), "at", "asks", "delta", F.lit(None).cast("string").alias("src_table"), F.lit(None).cast(refs.schema["src_row_id"].dataType).alias("src_row_id"), F.lit(None).cast("string").alias("ref_field"))
    w = Window.partitionBy(*on, "salt").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = asked.unionByName(told).withColumn("exists", F.sum("delta").over(w))
    return state.where((F.col("asks") == 1) & (F.col("exists") == 0)).select("src_table", "src_row_id", "ref_field", "target", "ref_key", "at").distinct()


@dataclass(frozen=True)
class State:
    """What is known after some batches of changes: records (src_table, src_key, at, seq, live, keys) holds each version
    that ruled its record when its batch came, deltas (target, ref_key, refs, exists) the signed counts. Both only grow by
    what a batch changes; compact() leaves what still counts."""

    records: DataFrame
    deltas: DataFrame


def _signed(version: str, sign: int) -> Column:
    """What a version of a record gives, or takes back: its own existence and its references; nothing if it isn't live."""
    v, zero, one = F.col(version), F.lit(0).cast("long"), F.lit(sign).cast("long")
    itself = F.array(F.struct(F.col("src_table").alias("target"), F.col("src_key").alias("ref_key"), zero.alias("refs"), one.alias("exists")))
    others = F.transform(v["keys"], lambda k: F.struct(k["target"].alias("target"), k["ref_key"].alias("ref_key"), one.alias("refs"), zero.alias("exists")))
    return F.when(v["live"], F.concat(itself, others)).otherwise(F.slice(itself, 1, 0))


def fold(state: State | None, log: DataFrame) -> State:
    """The state after one more batch of a change log (src_table, src_key, at, seq, live, keys array<struct<target,
    ref_key>>): the rows of records as they were loaded, in any order, late ones included.

    Of a record the version with the greatest (at, seq) rules, in whichever batch it comes; a batch that doesn't hold a
    later one than the state changes nothing. Where it does, what the old version gave is taken back (-1) and what the new
    one gives is added (+1), so that the counts after any split of a log into batches, in any order, are those of the log
    as a whole. Rows without a key or a time change nothing; repeated rows collapse before the shuffle. Of the state only
    the records of the batch are looked up, with the batch's keys broadcast behind a check of their number."""
    on = ["src_table", "src_key"]
    version = F.struct("at", "seq", "live", "keys")
    news = cut(log.where(F.col("src_key").isNotNull() & F.col("at").isNotNull()).groupBy(*on).agg(F.max(version).alias("new")))
    if state is None:
        changed = news.withColumn("old", F.lit(None).cast(news.schema["new"].dataType))
    else:
        old = state.records.join(checked_broadcast(news.select(*on)), on).groupBy(*on).agg(F.max(version).alias("old"))
        later = F.struct("new.at", "new.seq") > F.struct("old.at", "old.seq")
        changed = cut(news.join(old, on, "left").where(F.col("old").isNull() | later))
    deltas = _sums(changed.select(F.inline(F.concat(_signed("old", -1), _signed("new", 1)))))
    if state is None:
        return State(changed.select(*on, "new.*"), cut(deltas))
    return State(state.records.unionByName(changed.select(*on, "new.*")), state.deltas.unionByName(cut(deltas)))


def _sums(deltas: DataFrame) -> DataFrame:
    summed = deltas.groupBy("target", "ref_key").agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists"))
    return summed.where((F.col("refs") != 0) | (F.col("exists") != 0))


def compact(state: State) -> State:
    """The same state with one version per record and one row of counts per key, for after many batches."""
    v = F.struct("at", "seq", "live", "keys")
    return State(cut(state.records.groupBy("src_table", "src_key").agg(F.max(v).alias("v")).select("src_table", "src_key", "v.*")), cut(_sums(state.deltas)))


def current_orphans(state: State) -> DataFrame:
    """(target, ref_key, refs): the keys that live records refer to and that don't exist."""
    return _sums(state.deltas).where((F.col("refs") > 0) & (F.col("exists") <= 0)).select("target", "ref_key", "refs")


#: The table that each kind of reference points at.
TARGETS = {"user_id": "agent_users", "reservation_id": "agent_reservations", "flight_number": "agent_flights"}


def _argument_keys(actions: DataFrame) -> DataFrame:
    return named_values(actions.where((F.col("domain") == "airline") & has_digit(F.col("arguments"))), "arguments", list(TARGETS), ["row_id", "loaded_at"])


def airline_inputs(users: DataFrame, flights: DataFrame, reservations: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """refs and versions of the airline tables, for orphans()."""
    target = F.create_map(*(F.lit(x) for kv in TARGETS.items() for x in kv))

    def ref(df: DataFrame, src: str, field, value) -> DataFrame:
        return df.select(F.lit(src).alias("src_table"), F.col("row_id").alias("src_row_id"), field.alias("ref_field"), target[field].alias("target"), key_form(value).alias("ref_key"), F.col("loaded_at").alias("at"))

    legs = reservations.select("row_id", "loaded_at", F.explode("flights.flight_number").alias("value"))
    listed = users.select("row_id", "loaded_at", F.explode("reservations").alias("value"))
    refs = (
        ref(reservations, "agent_reservations", F.lit("user_id"), F.col("user_id"))
        .unionByName(ref(legs, "agent_reservations", F.lit("flight_number"), F.col("value")))
        .unionByName(ref(listed, "agent_users", F.lit("reservation_id"), F.col("value")))
        .unionByName(ref(_argument_keys(actions), "eval_actions", F.col("field"), F.col("value")))
        .where(has_digit(F.col("ref_key")))
    )

    def version(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.select(F.lit(name).alias("target"), key_form(key).alias("ref_key"), F.col("loaded_at").alias("at"), F.col("row_id").alias("seq"), "deleted_at")

    versions = version(users, "agent_users", "user_id").unionByName(version(flights, "agent_flights", "flight_number")).unionByName(version(reservations, "agent_reservations", "reservation_id"))
    return refs, versions


def airline_log(users: DataFrame, flights: DataFrame, reservations: DataFrame, actions: DataFrame) -> DataFrame:
    """The change log of the airline tables, for fold(). A row without a key of its own (null, or without a digit) is a
    record by its row_id; a reference in an action's arguments is a record that never changes."""

    def keys(field: str, values: Column) -> Column:
        found = F.filter(F.transform(values, key_form), lambda k: F.coalesce(has_digit(k), F.lit(False)))
        return F.coalesce(F.transform(F.array_distinct(found), lambda k: F.struct(F.lit(TARGETS[field]).alias("target"), k.alias("ref_key"))), F.array().cast("array<struct<target:string,ref_key:string>>"))

    def of(df: DataFrame, name: str, key: Column, live: Column, refs: Column) -> DataFrame:
        return df.select(F.lit(name).alias("src_table"), key.alias("src_key"), F.col("loaded_at").alias("at"), F.col("row_id").alias("seq"), live.alias("live"), refs.alias("keys"))

    def own(key: str) -> Column:
        return F.when(has_digit(key_form(key)), key_form(key)).otherwise(F.concat_ws("", F.lit("#"), F.col("row_id").cast("string")))

    here, none = F.col("deleted_at").isNull(), F.array().cast("array<string>")
    target = F.create_map(*(F.lit(x) for kv in TARGETS.items() for x in kv))
    told = _argument_keys(actions).withColumn("k", key_form("value")).where(has_digit(F.col("k")))
    parts = [
        of(users, "agent_users", own("user_id"), here, keys("reservation_id", F.col("reservations"))),
        of(flights, "agent_flights", own("flight_number"), here, keys("flight_number", none)),
        of(reservations, "agent_reservations", own("reservation_id"), here, F.concat(keys("user_id", F.array("user_id")), keys("flight_number", F.col("flights.flight_number")))),
        of(told, "eval_actions", F.concat_ws(":", F.col("row_id").cast("string"), "field", "k"), F.lit(True), F.array(F.struct(target[F.col("field")].alias("target"), F.col("k").alias("ref_key")))),
    ]
    log = parts[0]
    for p in parts[1:]:
        log = log.unionByName(p)
    return log
