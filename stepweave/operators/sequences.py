"""Action sequences: arrays of names, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of a sequence's begin and end, and the types of actions.
BOS, EOS = "|BOS|", "|EOS|"
READ, WRITE, GENERIC = "READ", "WRITE", "GENERIC"


def strip_marks(tokens: Column, bos: str = BOS, eos: str = EOS) -> Column:
    """A sequence without the marks of its begin and end."""
    return F.filter(tokens, lambda t: ~t.isin(bos, eos))


def pad(tokens: Column, n: int, bos: str = BOS, eos: str = EOS) -> Column:
    """n-1 begin marks, the sequence without marks, and one end mark."""
    return F.concat(F.array_repeat(F.lit(bos), n - 1), strip_marks(tokens, bos, eos), F.array(F.lit(eos)))


def windows(df: DataFrame, tokens: Column, n: int, bos: str = BOS, eos: str = EOS) -> DataFrame:
    """df with pos, ctx (the n-1 tokens before) and token for each position of the padded sequences; an empty sequence
    has one window, that of its end. Null sequences have none."""
    padded = df.withColumn("_p", pad(tokens, n, bos, eos))
    at = F.sequence(F.lit(0), F.size("_p") - n)
    return padded.withColumn("pos", F.explode(F.when(F.col("_p").isNotNull(), at))).withColumns({"ctx": F.slice("_p", F.col("pos") + 1, n - 1), "token": F.element_at("_p", F.col("pos") + n)}).drop("_p")


def action_types(vocabulary: DataFrame) -> DataFrame:
    """(domain, token, type) with GENERIC where a type is missing."""
    return vocabulary.select("domain", "token", F.coalesce("action_type", F.lit(GENERIC)).alias("type"))


def effective_type(kind: Column) -> Column:
    """READ or WRITE: a missing type is GENERIC, and GENERIC counts as READ."""
    kind = F.coalesce(kind, F.lit(GENERIC))
    return F.when(kind == GENERIC, READ).otherwise(kind)


def action_group(token: Column, groups: Column | None = None) -> Column:
    """The group in a map, else what stands before the first underscore."""
    prefix = F.substring_index(token, "_", 1)
    return prefix if groups is None else F.coalesce(F.try_element_at(groups, token), prefix)


def write_fraction(tokens: Column, types: Column) -> Column:
    """The share of tokens whose type in a map is WRITE; 0 for an empty sequence."""
    writes = F.size(F.filter(tokens, lambda t: F.try_element_at(types, t).eqNullSafe(F.lit(WRITE))))
    return F.when(F.size(tokens) > 0, writes / F.size(tokens)).otherwise(0.0)


def only_writes(tokens: Column, types: Column) -> Column:
    """Whether every token is known as WRITE or GENERIC."""
    return F.forall(tokens, lambda t: F.coalesce(F.try_element_at(types, t).isin(WRITE, GENERIC), F.lit(False)))


def type_map(vocabulary: DataFrame) -> DataFrame:
    """(domain, types map<string,string>): one row per domain, bounded by its vocabulary."""
    return action_types(vocabulary).groupBy("domain").agg(F.map_from_entries(F.collect_set(F.struct("token", "type"))).alias("types"))


def repeats_from(tokens: Column, times: int = 3) -> Column:
    """The positions at which a token stands the times-th time in a row or more."""
    at = F.sequence(F.lit(0), F.size(tokens) - 1)
    same = lambda i: F.forall(F.slice(tokens, i - times + 2, F.lit(times)), lambda t: t == F.get(tokens, i))
    return F.when(F.size(tokens) >= times, F.filter(at, lambda i: (i >= times - 1) & F.when(i >= times - 1, same(i)).otherwise(False))).otherwise(F.array().cast("array<int>"))


def ordering_violations(tokens: Column, rules: Sequence[tuple[str, frozenset[str] | set[str], frozenset[str] | set[str]]]) -> Column:
    """The names of the rules that a sequence breaks. A rule is (kind, tokens a, tokens b):

    only_last: a may stand only at the end. first_block: if a occurs, it begins the sequence and is in one block.
    before: each of b needs one of a before it. between: two different ones of b need one of a between them.
    not_after: after the first b, a may not occur. An empty sequence breaks none."""
    last = F.size(tokens) - 1
    at = F.sequence(F.lit(0), last)

    def places(names) -> Column:
        return F.when(F.size(tokens) > 0, F.filter(at, lambda i: F.get(tokens, i).isin(*sorted(names)))).otherwise(F.array().cast("array<int>"))

    broken = []
    for k, (kind, a, b) in enumerate(rules):
        pa, pb = places(a), places(b)
        if kind == "only_last":
            bad = F.exists(pa, lambda i: i != last)
        elif kind == "first_block":
            bad = (F.size(pa) > 0) & (F.array_max(pa) != F.size(pa) - 1)
        elif kind == "before":
            bad = (F.size(pb) > 0) & ((F.size(pa) == 0) | (F.array_min(pb) < F.coalesce(F.array_min(pa), F.lit(0))))
        elif kind == "between":
            bad = F.exists(pb, lambda i: F.exists(pb, lambda j: (i < j) & (F.get(tokens, i) != F.get(tokens, j)) & ~F.exists(pa, lambda m: (m > i) & (m < j))))
        elif kind == "not_after":
            bad = (F.size(pa) > 0) & (F.size(pb) > 0) & (F.array_max(pa) > F.array_min(pb))
        else:
            raise ValueError(kind)
        broken.append(F.when(F.size(tokens).isNotNull() & bad, F.lit(f"{k}:{kind}")))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def rubric(tokens: Column, known: Column, only_last: Sequence[str] = ("transfer_to_human_agents",), times: int = 3) -> Column:
    """The deterministic verdict on a sequence, a struct of valid, reason and bad_idx: an empty sequence is invalid, so is
    one with unknown names (known is the array of names), with a name `times` times in a row, or with a name of
    only_last before the end; the first of these gives the reason and the places."""
    at = F.sequence(F.lit(0), F.size(tokens) - 1)
    where = lambda test: F.when(F.size(tokens) > 0, F.filter(at, test)).otherwise(F.array().cast("array<int>"))
    unknown = where(lambda i: ~F.array_contains(known, F.get(tokens, i)))
    runs = repeats_from(tokens, times)
    early = where(lambda i: F.get(tokens, i).isin(*only_last) & (i < F.size(tokens) - 1))
    verdict = lambda reason, idx: F.struct(F.lit(reason is None).alias("valid"), F.lit(reason).cast("string").alias("reason"), idx.cast("array<int>").alias("bad_idx"))
    none = F.array().cast("array<int>")
    return F.when(F.size(tokens) == 0, verdict("empty", none)).when(F.size(unknown) > 0, verdict("unknown action", unknown)).when(F.size(runs) > 0, verdict("repeated", runs)).when(F.size(early) > 0, verdict("not at the end", early)).otherwise(verdict(None, none))


def clean_indices(idx: Column, tokens: Column) -> Column:
    """Indices cut to whole numbers, without those outside of the sequence."""
    whole = F.transform(idx, lambda i: F.when(i >= 0, F.floor(i)).otherwise(F.ceil(i)).cast("int"))
    return F.filter(whole, lambda i: (i >= 0) & (i < F.size(tokens)))


def differs_at(candidate: Column, failed: Column, idx: Column) -> Column:
    """Whether a candidate differs from a failed sequence at one of the places, or is too short to have one."""
    return F.exists(idx, lambda i: (i >= F.size(candidate)) | (i >= F.size(failed)) | ~F.get(candidate, i).eqNullSafe(F.get(failed, i)))


def status_of(df: DataFrame, accepted: DataFrame, rejected: DataFrame, tokens: str = "tokens") -> DataFrame:
    """df with status: accepted_dup if its tokens are in accepted, else rejected_dup if in rejected, else new. Two
    left joins with deduplicated keys, so no row is multiplied."""
    a = accepted.select(F.col(tokens).alias("_a")).distinct()
    r = rejected.select(F.col(tokens).alias("_r")).distinct()
    out = df.join(a, F.col(tokens) == F.col("_a"), "left").join(r, F.col(tokens) == F.col("_r"), "left")
    return out.withColumn("status", F.when(F.col("_a").isNotNull(), "accepted_dup").when(F.col("_r").isNotNull(), "rejected_dup").otherwise("new")).drop("_a", "_r")


def short_model_name(name: Column) -> Column:
    """What follows the last slash, without -preview or -latest, with underscores for dashes."""
    return F.replace(F.regexp_replace(F.substring_index(name, "/", -1), "-(preview|latest)$", ""), F.lit("-"), F.lit("_"))


def seed_sequences(tasks: DataFrame, criteria: str = "evaluation_criteria") -> DataFrame:
    """(task_id, tokens) of tasks whose criteria hold a list of actions; an empty list is kept, JSON that doesn't parse
    is not. A string that holds the criteria as a string is opened once more."""
    v = F.try_parse_json(criteria)
    v = F.coalesce(F.try_parse_json(F.try_variant_get(v, "$", "string")), v)
    actions = F.try_variant_get(v, "$.actions", "array<variant>")
    names = F.filter(F.transform(actions, lambda a: F.try_variant_get(a, "$.name", "string")), lambda n: n.isNotNull())
    return tasks.withColumn("tokens", names).where(F.col("tokens").isNotNull()).select("row_id", "task_id", "tokens")
