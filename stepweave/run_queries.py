"""Queries on what runs read, write and decide: files of tasks, models, prompts and logs, checks of records, retries and
costs. Each query with files writes them to the shared folder and gives what is read back. Their SQL stands below them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import has_digit, key_form, name_form
from .operators import entities, json_ops, lengths, ngram, orphans, providers, rules, select, sequences, shred
from .oracle import _ACTIONS, _AGENT, _CRITERIA, _GRAMS, _JUDGED, _ORPHANS, _REPLACED, _SEQS, CHILDREN, _key
from .queries import _accepted, _actions, _counts, _failures, _judged, _keyed, _members, _validated, _vocab
from .session import cut, place
from .sources import artifacts
from .sources.tables import table

#: Spellings of argument names and what they are put right to; a name that is put right to None is dropped.
ALIASES = {"userId": "user_id", "USER_ID": "user_id", "reservationId": "reservation_id", "RESERVATION_ID": "reservation_id", "flightNumber": "flight_number", "ref": None}
#: Links between child tables of a task: table, attribute, target table.
LINKS = [("order", "user_id", "user"), ("reservation", "user_id", "user"), ("line", "plan_id", "plan"), ("leg", "flight_number", "flight"), ("order_item", "product_id", "product")]
#: Prices of models per million tokens of input and output, and of any other model, for tests (invented).
PRICES, DEFAULT_PRICE = {"transcript": (2.0, 12.0), "policy": (0.5, 3.0)}, (0.3, 2.5)


def task_files(spark: SparkSession, d: str) -> DataFrame:
    """Tasks written as JSON arrays and read again."""
    tasks = table(spark, d, "tasks").select("row_id", "task_id", "domain", "evaluation_criteria").distinct()
    folder = place(spark, "tasks")
    artifacts.write_tasks_json(tasks, folder)
    return artifacts.tasks_json(spark, folder, "row_id bigint, task_id string, domain string, evaluation_criteria string")


def task_set(spark: SparkSession, d: str) -> DataFrame:
    """The tasks of a set without their tickets, and per domain what its metadata says."""
    rows = table(spark, d, "tasks").select("row_id", "task_id", "domain", F.col("evaluation_criteria").alias("ticket")).distinct()
    seeds = sequences.seed_sequences(table(spark, d, "tasks").distinct()).join(rows.select("row_id", "domain"), "row_id")
    folder = place(spark, "set")
    artifacts.write_task_set(rows, folder, artifacts.generation_metadata(seeds, "domain"))
    tasks, metadata = artifacts.read_task_set(spark, folder)
    counted = tasks.groupBy("domain").agg(F.count(F.lit(1)).alias("n_rows"), F.lit("ticket" in tasks.columns).alias("has_ticket")) if "domain" in tasks.columns else spark.createDataFrame([], "domain string, n_rows long, has_ticket boolean")
    if "domain" not in metadata.columns:
        return counted.select("domain", "n_rows", "has_ticket", *(F.lit(None).cast(t).alias(c) for c, t in (("n_tasks", "long"), ("n_empty", "long"), ("low", "long"), ("high", "long"), ("median", "double"))))
    return counted.join(metadata, "domain").select("domain", "n_rows", "has_ticket", "n_tasks", "n_empty", "low", "high", "median")


def counts_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """n-gram counts written as a checkpoint in tables and read again."""
    folder = place(spark, "model")
    artifacts.write_counts(_counts(spark, d), _accepted(spark, d), folder, 400)
    return artifacts.read_counts(spark, folder, 400)[0].select("domain", "sign", F.array_join("ctx", ">").alias("ctx"), "token", "w")


def json_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """n-gram counts written as a JSON checkpoint per domain and read again."""
    counts, folder, out = cut(_counts(spark, d)), place(spark, "json"), None
    for r in _vocab(spark, d).select("domain").where("domain is not null").distinct().orderBy("domain").collect():
        path = f"{folder}/{artifacts.checkpoint_name(r.domain, 3, 400)}"
        artifacts.write_checkpoint_json(counts.where(F.col("domain") == r.domain), path, {"n": 3})
        back = artifacts.checkpoint_json(spark, path, r.domain)
        out = back if out is None else out.unionByName(back)
    out = counts if out is None else out
    return out.select("domain", "sign", F.array_join("ctx", ">").alias("ctx"), "token", "w")


def saved_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Validated clusters written and read again."""
    info = table(spark, d, "cluster_info").select("cluster_key", "domain", F.col("status").alias("listed_status")).distinct()
    folder = place(spark, "clusters")
    artifacts.write_clusters(select.with_validation(info, _validated(spark, d).select("cluster_key", "status", "final_sequence", "attempts")), folder)
    return artifacts.read_clusters(spark, folder).withColumn("final_sequence", F.array_join("final_sequence", ">"))


def tool_specs(spark: SparkSession, d: str) -> DataFrame:
    """Tool specs of each domain written as JSON and read again: names, types, and names of parameters."""
    vocab, folder, out = cut(_vocab(spark, d)), place(spark, "specs"), None
    param = lambda e: F.create_map(F.concat(e["token"], F.lit("_id")), F.struct(F.lit("string").alias("type")))
    entry = lambda e: F.struct(e["token"], F.struct(e["type"].alias("type"), F.when(e["type"].isNotNull(), param(e)).alias("parameters")))
    for r in vocab.select("domain").where("domain is not null").distinct().orderBy("domain").collect():
        mine = vocab.where(F.col("domain") == r.domain).where("token is not null").groupBy("token").agg(F.min("action_type").alias("type"))
        mine.agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("token", "type"))), entry))).alias("value")).coalesce(1).write.text(f"{folder}/{r.domain}")  # a vocabulary has a fixed size
        specs = artifacts.tool_specs(spark, f"{folder}/{r.domain}").select(F.lit(r.domain).alias("domain"), "name", "type", F.array_join(F.map_keys("params"), ",").alias("params"))
        out = specs if out is None else out.unionByName(specs)
    return vocab.select("domain", F.col("token").alias("name"), F.lit("").alias("type"), F.lit("").alias("params")) if out is None else out


def completed_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Progress written in two appends, beside a line that isn't JSON, and what it says of each cluster: finished, or failed."""
    judged = _judged(spark, d).select(F.col("cluster_key").alias("cluster_idx"), F.col("valid").alias("success"))
    folder = place(spark, "progress")
    artifacts.append_progress(judged.where("success"), folder)
    artifacts.append_progress(judged.where("not success"), folder)
    spark.range(1).select(F.lit('{"cluster_idx": 1, "succ')).write.mode("append").text(folder)
    progress = artifacts.read_progress(spark, folder, "cluster_idx bigint, success boolean")
    done = artifacts.completed(progress).withColumn("state", F.lit("finished"))
    return done.unionByName(select.failed(progress, "cluster_idx").withColumn("state", F.lit("failed")))


def frozen_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Listed clusters that a valid member has finished, which stay as they are."""
    info = table(spark, d, "cluster_info").select("cluster_key", "domain").distinct()
    return select.frozen(info, _judged(spark, d).select("cluster_key", F.col("valid").alias("success")), "cluster_key")


def failure_log(spark: SparkSession, d: str) -> DataFrame:
    """Failures of two steps in one log, each with its own details, written and read again."""
    f = _failures(spark, d)
    folder = place(spark, "log")
    rows = f.withColumn("key", F.concat(F.col("row_id").cast("string"), F.lit("/"), "rule"))
    artifacts.append_errors(artifacts.failures(rows.where("rule = 'shape'"), "assertion", "key", F.col("message"), rule=F.col("rule")), folder)
    artifacts.append_errors(artifacts.failures(rows.where("rule <> 'shape'"), "alignment", "key", F.col("message")), folder)
    return artifacts.read_progress(spark, folder, "id string, message string, detail string, step string").select("step", "id", "message", "detail")


def prompts_of_runs(spark: SparkSession, d: str) -> DataFrame:
    """A prompt log of accepted sequences, numbered within their checkpoint, written and read again."""
    a = _accepted(spark, d).join(table(spark, d, "sampler_accepted").select("seq_id", "checkpoint").distinct(), "seq_id")
    folder = place(spark, "prompts")
    artifacts.append_errors(artifacts.prompt_log(a.withColumn("prompt", F.array_join("tokens", ",")), "checkpoint", "seq_id", "prompt"), folder)
    return artifacts.read_progress(spark, folder, "run string, n bigint, prompt string, step string").select("run", "n", "prompt")


def sectioned_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a section per type of action, written per domain and read again section by section."""
    vocab = sequences.action_types(_vocab(spark, d)).where("domain is not null and token is not null")
    folder = place(spark, "sections")
    part = vocab.groupBy("domain", "type").agg(F.array_join(F.sort_array(F.collect_set("token")), "\n").alias("t"))  # a vocabulary has a fixed size
    whole = part.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "t"))), lambda x: F.concat(F.lit("==="), x["type"], F.lit("===\n"), x["t"], F.lit("\n\n"))), "").alias("value"))
    whole.write.partitionBy("domain").text(folder)
    try:
        read = artifacts.prompt_sections(spark, f"{folder}/*")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):  # no domain, no file
            raise
        return spark.createDataFrame([], "domain string, section string, body string")
    return read.select(F.regexp_extract("file", r"domain=([^/]+)/", 1).alias("domain"), "section", "body")


def seed_counts(spark: SparkSession, d: str) -> DataFrame:
    """A model that has seen seeds only: training without samples over the sequences of tasks, judged by rules."""
    tasks = table(spark, d, "tasks").distinct()
    seeds = sequences.seed_sequences(tasks).join(tasks.select("row_id", "domain"), "row_id").select("domain", F.filter(F.transform("tokens", name_form), lambda t: t.isNotNull()).alias("tokens"))
    vocab = _vocab(spark, d)
    counts, _ = ngram.train(spark, seeds, vocab, providers.by_rules(vocab), 0, 50, F.lit(7))
    return counts.select("domain", "sign", F.array_join("ctx", ">").alias("ctx"), "token", "w")


def whole_sequence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of accepted sequences as good and of invalid members as bad ones, as a whole and with half the weight."""
    counts = ngram.from_sequences(_accepted(spark, d), _judged(spark, d).where("not valid"), _vocab(spark, d), negative_weight=0.5)
    return counts.select("domain", "sign", F.array_join("ctx", ">").alias("ctx"), "token", "w")


def accepted_names(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary of accepted sequences."""
    return ngram.vocabulary_of(_accepted(spark, d))


def lengths_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of what the first checkpoint accepted, or of members in domains where that is nothing."""
    first = table(spark, d, "sampler_accepted").where("checkpoint = 't400' and domain <> 'library'").select("seq_id").distinct()
    seeds = _accepted(spark, d).join(first, "seq_id").select("domain", F.size("tokens").alias("length"))
    fitted = lengths.fit_or(seeds, _members(spark, d).select("domain", F.size("tokens").alias("length")), "domain")
    return fitted.select("domain", "n", "low", "high", *(F.round(c, 6).alias(c) for c in ("median", "std")))


def refitted_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Length statistics of members that were fitted, and fitted again after accepted sequences were added."""
    sized = lambda df: df.select("domain", F.size("tokens").alias("length"))
    fitted = lengths.Fitted(sized(_members(spark, d)), "domain")
    first = fitted.get().select("domain", F.lit("members").alias("of"), "n", "median")
    fitted.add(sized(_accepted(spark, d)))
    return first.unionByName(fitted.get().select("domain", F.lit("both").alias("of"), "n", "median"))


def recorded_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Accepted sequences judged by what was said of members with the same steps; indices outside of them are cut."""
    said = _judged(spark, d).groupBy("tokens").agg(F.bool_and("valid").alias("valid"), F.max("reason").alias("reason"))
    said = said.withColumn("bad_idx", F.array(F.lit(-1.0), F.lit(0.7), F.size("tokens") - 0.5, F.size("tokens") + 1.0))
    judged = providers.by_table(said)(_accepted(spark, d))
    return judged.select("domain", "seq_id", "valid", "reason", F.array_join(F.col("bad_idx").cast("array<string>"), ",").alias("bad_idx"))


def short_names(spark: SparkSession, d: str) -> DataFrame:
    names = F.concat(F.lit("provider/"), "source", F.lit("-v-2"), F.when(F.col("doc_id") % 2 == 0, "-preview").otherwise("-latest-x"))
    return table(spark, d, "documents").select("doc_id", sequences.short_model_name(names).alias("short"))


def unexpected_arguments(spark: SparkSession, d: str) -> DataFrame:
    """Arguments that an action has beside those that are usual for its name, or that it lacks: usual are names that over half
    of the valid calls of the name have. Names of fewer than three calls have no spec."""
    a = _actions(spark, d).select("row_id", "step", "arguments")
    keys = a.where("step is not null").select("step", F.map_keys(F.from_json("arguments", "map<string,string>")).alias("keys")).where("keys is not null")
    n = keys.groupBy("step").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    usual = keys.select("step", F.explode("keys").alias("k")).groupBy("step", "k").agg(F.count(F.lit(1)).alias("held"))
    specs = n.join(usual, "step", "left").groupBy(F.col("step").alias("name")).agg(F.sort_array(F.collect_list(F.when(F.col("held") * 2 > F.col("n"), F.col("k")))).alias("params"))
    out = rules.unexpected_arguments(a.withColumnRenamed("step", "name"), specs)
    return out.select("row_id", "name", "unknown_tool", F.array_join("unexpected", ",").alias("unexpected"), F.array_join("missing", ",").alias("missing"))


def unknown_reservations(spark: SparkSession, d: str) -> DataFrame:
    """Reservations that actions name and that were neither loaded nor are listed by a user."""
    users, reservations = _keyed(spark, d)
    acts = orphans.named_values(table(spark, d, "eval_actions").where("domain = 'airline'"), "arguments", ["reservation_id"], ["row_id"])
    keys = acts.select("row_id", key_form("value").alias("ref_key")).where(has_digit(F.col("ref_key"))).distinct()
    listed = users.select(F.explode(F.transform("reservations", key_form)).alias("link"))
    return rules.missing_in_any(keys, "ref_key", [(reservations, "reservation"), (listed, "link")])


def missing_links(spark: SparkSession, d: str) -> DataFrame:
    """Child records of tasks that point at a record which their task hasn't."""
    return rules.missing_links(cut(shred.task_tables(table(spark, d, "tasks"))), "row_id", LINKS, key_form)


def known_keys(spark: SparkSession, d: str) -> DataFrame:
    """Users and reservations that actions name and whose key was loaded already, so that it can't be given to a new one."""
    acts = orphans.named_values(table(spark, d, "eval_actions").where("domain = 'airline'"), "arguments", ["user_id", "reservation_id"], ["row_id"])
    new = acts.select("row_id", F.col("field").alias("kind"), key_form("value").alias("key")).where(has_digit(F.col("key"))).distinct()
    users, reservations = _keyed(spark, d)
    existing = users.select(F.lit("user_id").alias("kind"), F.col("user").alias("key")).unionByName(reservations.select(F.lit("reservation_id").alias("kind"), F.col("reservation").alias("key")))
    return rules.collisions(new, existing, ["kind", "key"]).select("row_id", "kind", "key")


def renamed_arguments(spark: SparkSession, d: str) -> DataFrame:
    """The names of arguments after spellings were put right."""
    a = _actions(spark, d).select("row_id", F.from_json("arguments", "map<string,string>").alias("m")).where("m is not null and startswith(trim(arguments), '{')")
    return a.select("row_id", F.array_join(F.array_sort(F.map_keys(entities.rename_fields(F.col("m"), ALIASES))), ",").alias("names"))


def dates_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Flight dates as a list of records, made a map by their date again."""
    flights = table(spark, d, "agent_flights").select("row_id", F.transform(F.map_entries("dates"), lambda e: F.struct(e["key"].alias("date"), e["value"]["status"].alias("status"))).alias("l")).distinct()
    named = flights.select("row_id", F.explode(entities.list_to_map(F.col("l"), "date")).alias("date", "record"))
    return named.select("row_id", "date", F.get_json_object("record", "$.status").alias("status"))


def upserted_users(spark: SparkSession, d: str) -> DataFrame:
    """Users as merged from their rows with an odd and then from those with an even row_id."""
    users, _ = _keyed(spark, d)
    half = lambda k: entities.merge_scalars(users.where(F.col("user").isNotNull() & (F.col("row_id") % 2 == k)), ["user"], ["email", "membership"], ["loaded_at", "row_id"])
    return entities.upsert(half(1), half(0), ["user"])


def sides_of_tasks(spark: SparkSession, d: str) -> DataFrame:
    """How many child records of each table stand on the agent's and on the user's side."""
    agent, user = entities.split_by(shred.task_tables(table(spark, d, "tasks")).select("row_id", "child_table", "parent_key", "child_key").distinct(), "child_table", ["app_status"])
    both = agent.withColumn("side", F.lit("agent")).unionByName(user.withColumn("side", F.lit("user")))
    return both.groupBy("side", "child_table").agg(F.count(F.lit(1)).alias("n"))


def described_tasks(spark: SparkSession, d: str) -> DataFrame:
    """One line per record of a task's agent data."""
    t = shred.task_tables(table(spark, d, "tasks")).where("child_table in ('user', 'order', 'line', 'reservation')").select("row_id", "child_table", "child_key", F.lit("given").alias("body")).distinct()
    return entities.described(t, ["row_id"], "child_table", "child_key", "body")


def assembled_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Size and reward basis of each task, with the default basis where none is named."""
    return entities.assembled(table(spark, d, "tasks").distinct()).withColumn("reward_basis", F.array_join("reward_basis", ","))


def evolved_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The first version of each task with the instructions of its last one, as far as that has them."""
    t = table(spark, d, "tasks").select("task_id", F.struct("created_at", "row_id").alias("at"), F.col("user_scenario.instructions").alias("i"), "domain")
    ends = t.groupBy("task_id").agg(F.min_by("i", "at").alias("old"), F.max_by("i", "at").alias("new"), F.count(F.lit(1)).alias("n"))
    out = ends.where("task_id is not null").withColumn("i", entities.patched(F.col("old"), F.col("new"), ["reason_for_call", "known_info", "task_instructions"]))
    return out.select("task_id", "i.reason_for_call", "i.known_info", "i.task_instructions")


def cleaned_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Scenarios of tasks without their persona."""
    t = table(spark, d, "tasks").select("row_id", json_ops.clear_fields(F.col("user_scenario"), ["persona"]).alias("s")).distinct()
    return t.select("row_id", F.col("s.persona").cast("string").alias("persona"), F.col("s.instructions.domain").alias("domain"))


#: What may stand around JSON in a response: before and after it.
WRAPS = [("", ""), ("Here it is:\n```json\n", "\n```\nDone."), ("Sure {not this} ", " thanks"), ("```\n", "\n```"), ("The answer is ", "."), ("", ",")]


def extracted_json(spark: SparkSession, d: str) -> DataFrame:
    """The names of the JSON found in responses: arguments as they are, in fences, within prose, and with commas too many."""
    a = _actions(spark, d).where("startswith(arguments, '{')").select("row_id", "arguments", (F.col("row_id") % len(WRAPS)).alias("w"))
    pick = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in WRAPS)), (F.col("w") + 1).cast("int"))
    text = F.concat(pick(0), F.when(F.col("row_id") % 4 == 0, F.regexp_replace("arguments", r"\}$", ",}")).otherwise(F.col("arguments")), pick(1))
    found = json_ops.extract_json(text)
    return a.select("row_id", F.array_join(F.array_sort(F.json_object_keys(found)), ",").alias("names"))


def planted_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks of templates in texts that have some, and how often a brace is doubled when they are escaped."""
    text = F.concat_ws(" ", F.lit("{user_id}"), "source", F.lit("{a b}"), F.concat(F.lit("{"), "domain", F.lit("}")), F.lit("{_x9}"))
    t = table(spark, d, "documents").select("doc_id", text.alias("t"))
    return t.select("doc_id", F.array_join(json_ops.template_marks(F.col("t")), " ").alias("marks"), json_ops.escape_braces(F.col("t")).alias("escaped"))


def inserted_reboots(spark: SparkSession, d: str) -> DataFrame:
    """The steps that are put in where a resumed line isn't followed by a reboot."""
    a = _actions(spark, d).where("domain = 'telecom'").select("row_id", "task_id", "trial", "position", "action_id", "step")
    is_ = F.col("step")
    missing = entities.missing_follow_ups(a, ["task_id", "trial"], "position", is_ == "resume_line", is_.startswith("check_") | (is_ == "reboot_device"), is_ == "reboot_device")
    out = entities.with_follow_ups(a, missing, "position", "action_id", {"step": F.lit("reboot_device")}, "policy_reboot_after_")
    return out.where("action_id like 'policy_reboot_after_%'").drop("row_id")


def shown_arguments(spark: SparkSession, d: str) -> DataFrame:
    """What is shown of the arguments of assistants' actions when all of them are covered, and of others."""
    a = _actions(spark, d)
    out = entities.redact(a, ["task_id", "trial"], ["row_id"], 1.0, "arguments", F.col("requestor").eqNullSafe(F.lit("assistant")))
    return out.select("row_id", "covered", "shown")


def called_actions(spark: SparkSession, d: str) -> DataFrame:
    """Actions out of messages that call them: as a list of tool calls, as a single function call, with arguments as an object
    or as a JSON string."""
    a = _actions(spark, d).where("domain = 'retail' and step is not null").select("row_id", "step", "arguments")
    one = F.struct(F.col("step").alias("name"), F.col("arguments"))
    other = F.struct(F.col("step").alias("tool_name"), F.col("arguments").alias("args"))
    message = F.when(F.col("row_id") % 3 == 0, F.to_json(F.struct(F.array(F.struct(one.alias("function")), F.struct(one.alias("function"))).alias("tool_calls")))).when(F.col("row_id") % 3 == 1, F.to_json(F.struct(other.alias("function_call")))).otherwise(F.lit('{"content": "none"}'))
    return entities.called(a.select("row_id", message.alias("m")), "m").select("row_id", "pos", "name", F.coalesce(F.array_join(F.array_sort(F.json_object_keys("arguments")), ","), F.lit("")).alias("names"))


def first_steps(spark: SparkSession, d: str) -> DataFrame:
    """The first four steps of each trial, by position and row."""
    return rules.at_most(_actions(spark, d).where("task_id is not null and trial is not null"), ["task_id", "trial"], ["position", "row_id", "step"], 4)


def retried_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences tried again up to three times, after each of which one bad place is taken to be mended."""
    start = _judged(spark, d).select("domain", "seq_id", F.size("bad_idx").alias("bad"))
    out = providers.with_retries(lambda df, k: df.withColumn("success", F.col("bad") == 0), lambda df, k: df.withColumn("bad", F.col("bad") - 1), start)
    return out.select("domain", "seq_id", "success", "retries_used")


def evolution_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Sequences that go down a ladder of rungs: short ones are settled by the first, longer ones by the second."""
    sized = _accepted(spark, d).select("domain", "seq_id", F.size("tokens").alias("length"))
    rung = lambda low, high: lambda df: df.withColumn("success", F.col("length").between(low, high))
    return providers.ladder([("full", rung(1, 4)), ("lite", rung(1, 8))], sized)


def usage_costs(spark: SparkSession, d: str) -> DataFrame:
    """Costs per model, of documents taken as calls: the source is the model, characters are tokens."""
    usage = table(spark, d, "documents").select(F.concat(F.lit("host/"), "source").alias("model"), F.coalesce("n_chars", F.lit(0)).alias("prompt_tokens"), F.length(F.coalesce("text", F.lit(""))).alias("completion_tokens"))
    costs = rules.usage_costs(usage, PRICES, DEFAULT_PRICE)
    return costs.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_usd").cast("double"), 5).alias("cost_usd"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (task_files, task_set, counts_checkpoint, json_checkpoints, saved_clusters, tool_specs, completed_clusters, frozen_clusters, failure_log, prompts_of_runs, sectioned_prompts, seed_counts, whole_sequence_counts, accepted_names, lengths_with_fallback, refitted_lengths, recorded_verdicts, short_names, unexpected_arguments, unknown_reservations, missing_links, known_keys, renamed_arguments, dates_by_name, upserted_users, sides_of_tasks, described_tasks, assembled_tasks, evolved_tasks, cleaned_tasks, extracted_json, planted_marks, inserted_reboots, shown_arguments, called_actions, first_steps, retried_sequences, evolution_ladder, usage_costs)}


_FED = _GRAMS[_GRAMS.index(", windows AS (") : _GRAMS.index(", size AS (")]
_VALID_JSON = "(SELECT DISTINCT row_id, arguments::JSON AS j FROM eval_actions WHERE json_valid(arguments) AND json_type(arguments::JSON) = 'OBJECT')"
_LINK = " OR ".join(f"(child_table = '{t}' AND name = '{a}')" for t, a, _ in LINKS)
_LINK_TO = "CASE " + " ".join(f"WHEN child_table = '{t}' AND name = '{a}' THEN '{to}'" for t, a, to in LINKS) + " END"
_PRICE = lambda i: "CASE source " + " ".join(f"WHEN '{m}' THEN {p[i]}" for m, p in PRICES.items()) + f" ELSE {DEFAULT_PRICE[i]} END"
_REPAIRED = "name"
for _wrong, _right in ALIASES.items():
    _REPAIRED = f"CASE {_REPAIRED} WHEN '{_wrong}' THEN {'NULL' if _right is None else repr(_right)} ELSE {_REPAIRED} END" if _REPAIRED == "name" else _REPAIRED.replace("ELSE name", f"WHEN '{_wrong}' THEN {'NULL' if _right is None else repr(_right)} ELSE name")

SQL: dict[str, str] = {
    "task_files": "SELECT DISTINCT row_id, task_id, domain, evaluation_criteria FROM tasks",
    "task_set": _CRITERIA
    + """, s AS (
  SELECT t.domain, len([x FOR x IN (c.j->'$.actions')::JSON[] IF x->>'$.name' IS NOT NULL]) AS n FROM c JOIN (SELECT DISTINCT row_id, domain FROM tasks) t USING (row_id) WHERE json_type(c.j->'$.actions') = 'ARRAY'
)
SELECT domain, n_rows, false AS has_ticket, count(*) AS n_tasks, count(*) FILTER (n = 0) AS n_empty, greatest(1, min(n)) AS low, max(n) AS high, median(n) AS median FROM s JOIN (SELECT domain, count(DISTINCT row_id) AS n_rows FROM tasks GROUP BY ALL) USING (domain) GROUP BY ALL""",
    "counts_checkpoint": _GRAMS + "SELECT * FROM counts",
    "json_checkpoints": _GRAMS + "SELECT * FROM counts",
    "saved_clusters": _REPLACED + "SELECT i.*, r.status, array_to_string(r.final, '>') AS final_sequence, r.attempts FROM (SELECT DISTINCT cluster_key, domain, status AS listed_status FROM cluster_info) i LEFT JOIN replaced r USING (cluster_key)",
    "tool_specs": "SELECT DISTINCT domain, token AS name, coalesce(action_type, 'GENERIC') AS type, CASE WHEN action_type IS NULL THEN '' ELSE token || '_id' END AS params FROM model_vocab",
    "completed_clusters": _JUDGED + "SELECT cluster_key AS cluster_idx, CASE WHEN bool_or(valid) THEN 'finished' ELSE 'failed' END AS state FROM judged WHERE cluster_key IS NOT NULL GROUP BY ALL",
    "frozen_clusters": _JUDGED + "SELECT DISTINCT cluster_key, domain FROM cluster_info i WHERE EXISTS (FROM judged j WHERE j.cluster_key = i.cluster_key AND valid)",
    "failure_log": _AGENT
    + """, v AS (
  SELECT row_id, 0 AS o, 'shape' AS rule, 'no flights' AS message FROM r WHERE coalesce(len(flights), 0) < 1
  UNION ALL SELECT row_id, 1, 'references', 'unknown user ' || user FROM r WHERE user IS NOT NULL AND user NOT IN (SELECT user FROM u WHERE user IS NOT NULL)
  UNION ALL SELECT row_id, 1, 'references', 'missing required argument user_id' FROM r WHERE coalesce(user, '') = ''
)
SELECT CASE rule WHEN 'shape' THEN 'assertion' ELSE 'alignment' END AS step, row_id || '_' || rule AS id, message, CASE rule WHEN 'shape' THEN '{"rule":"shape"}' ELSE '{}' END AS detail FROM v QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY o, rule, message) = 1""",
    "prompts_of_runs": _SEQS + "SELECT checkpoint AS run, row_number() OVER (PARTITION BY checkpoint ORDER BY seq_id) AS n, array_to_string(tokens, ',') AS prompt FROM acc JOIN (SELECT DISTINCT seq_id, checkpoint FROM sampler_accepted) USING (seq_id)",
    "sectioned_prompts": "SELECT domain, coalesce(action_type, 'GENERIC') AS section, string_agg(DISTINCT token, chr(10) ORDER BY token) AS body FROM model_vocab GROUP BY ALL",
    "seed_counts": _CRITERIA.rstrip()
    + """, m AS (
  SELECT t.domain, c.row_id AS seq_id, list_filter([nullif(trim(regexp_replace(lower(x->>'$.name'), '[^a-z]+', '_', 'g'), '_'), '') FOR x IN (c.j->'$.actions')::JSON[]], lambda y: y IS NOT NULL) AS tokens
  FROM c JOIN (SELECT DISTINCT row_id, domain FROM tasks) t USING (row_id) WHERE json_type(c.j->'$.actions') = 'ARRAY'
), known AS (SELECT domain, list(DISTINCT token) AS known FROM model_vocab GROUP BY ALL)"""
    + _JUDGED[_JUDGED.index("\n, judged_idx AS (") :]
    + """, fed AS (
  SELECT domain, CASE WHEN valid THEN 'pos' ELSE 'neg' END AS sign, tokens, CASE WHEN NOT valid THEN bad_idx END AS bad_idx FROM judged WHERE len(tokens) > 0 AND (valid OR len(bad_idx) > 0)
)"""
    + _FED
    + "SELECT * FROM counts",
    "whole_sequence_counts": _JUDGED
    + """, fed AS (
  SELECT domain, 'pos' AS sign, tokens, NULL::BIGINT[] AS bad_idx FROM acc UNION ALL SELECT domain, 'neg', tokens, NULL FROM judged WHERE NOT valid
)"""
    + _FED
    + "SELECT domain, sign, ctx, token, CASE sign WHEN 'pos' THEN w ELSE w / 2 END AS w FROM counts",
    "accepted_names": _SEQS + "SELECT DISTINCT domain, unnest(tokens) AS token FROM acc",
    "lengths_with_fallback": _SEQS
    + """, s AS (
  SELECT domain, len(tokens) AS n FROM acc WHERE seq_id IN (SELECT seq_id FROM sampler_accepted WHERE checkpoint = 't400' AND domain <> 'library')
), l AS (FROM s UNION ALL SELECT domain, len(tokens) FROM m WHERE domain NOT IN (SELECT domain FROM s))
SELECT domain, count(*) AS n, greatest(1, min(n)) AS low, max(n) AS high, round(median(n), 6) AS median, round(stddev_pop(n), 6) AS std FROM l GROUP BY domain""",
    "refitted_lengths": _SEQS + ", l AS (SELECT domain, 'members' AS of, len(tokens) AS n FROM m UNION ALL SELECT domain, 'both', len(tokens) FROM m UNION ALL SELECT domain, 'both', len(tokens) FROM acc) SELECT domain, of, count(*) AS n, median(n) AS median FROM l GROUP BY domain, of",
    "recorded_verdicts": _JUDGED
    + """, said AS (SELECT tokens, bool_and(valid) AS valid, max(reason) AS reason FROM judged GROUP BY ALL)
SELECT domain, seq_id, CASE WHEN len(a.tokens) = 0 THEN true ELSE coalesce(valid, false) END AS valid, CASE WHEN len(a.tokens) > 0 THEN coalesce(reason, CASE WHEN s.tokens IS NULL THEN 'no verdict' END) END AS reason,
  CASE WHEN s.tokens IS NULL OR len(a.tokens) = 0 THEN '' ELSE '0,' || (len(a.tokens) - 1) END AS bad_idx FROM acc a LEFT JOIN said s ON a.tokens = s.tokens""",
    "short_names": "SELECT doc_id, replace(source, '-', '_') || '_v_2' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '_latest_x' END AS short FROM documents",
    "unexpected_arguments": _ACTIONS
    + f""", k AS (
  SELECT a.row_id, step, json_keys(j) AS keys FROM a JOIN {_VALID_JSON} v ON a.row_id = v.row_id
), n AS (
  SELECT step, count(*) AS n FROM k WHERE step IS NOT NULL GROUP BY ALL HAVING count(*) > 2
), spec AS (
  SELECT step, coalesce(list(key) FILTER (2 * held > n), []) AS params FROM n LEFT JOIN (SELECT step, key, count(*) AS held FROM (SELECT step, unnest(keys) AS key FROM k WHERE step IS NOT NULL) GROUP BY ALL) USING (step) GROUP BY ALL
)
SELECT a.row_id, a.step AS name, spec.step IS NULL AS unknown_tool, CASE WHEN spec.step IS NOT NULL AND keys IS NOT NULL THEN array_to_string(list_sort([x FOR x IN keys IF NOT list_contains(params, x)]), ',') END AS unexpected,
  CASE WHEN spec.step IS NOT NULL AND keys IS NOT NULL THEN array_to_string(list_sort([x FOR x IN params IF NOT list_contains(keys, x)]), ',') END AS missing
FROM a LEFT JOIN spec ON a.step = spec.step LEFT JOIN k ON a.row_id = k.row_id""",
    "unknown_reservations": _ORPHANS
    + f"""SELECT DISTINCT src_row_id AS row_id, ref_key FROM refs WHERE src_table = 'eval_actions' AND ref_field = 'reservation_id' AND regexp_matches(ref_key, '[0-9]')
AND NOT EXISTS (FROM versions v WHERE v.ref_field = 'reservation_id' AND v.ref_key = refs.ref_key) AND ref_key NOT IN (SELECT {_key("x")} FROM (SELECT unnest(reservations) AS x FROM agent_users) WHERE x IS NOT NULL)""",
    "missing_links": CHILDREN
    + f"""SELECT DISTINCT row_id, child_table, child_key, name, value FROM attribute a WHERE ({_LINK}) AND NOT EXISTS (FROM record r WHERE r.row_id = a.row_id AND r.tab = {_LINK_TO} AND {_key("r.key")} = {_key("a.value")})""",
    "known_keys": _ORPHANS
    + """SELECT DISTINCT src_row_id AS row_id, ref_field AS kind, ref_key AS key FROM refs WHERE src_table = 'eval_actions' AND ref_field <> 'flight_number' AND regexp_matches(ref_key, '[0-9]')
AND EXISTS (FROM versions v WHERE v.ref_field = refs.ref_field AND v.ref_key = refs.ref_key)""",
    "renamed_arguments": f"SELECT row_id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS names FROM (SELECT row_id, {_REPAIRED} AS name FROM (SELECT row_id, unnest(CASE WHEN len(json_keys(j)) = 0 THEN [NULL] ELSE json_keys(j) END) AS name FROM {_VALID_JSON})) GROUP BY ALL",
    "dates_by_name": "SELECT DISTINCT row_id, e.key AS date, e.value.status AS status FROM (SELECT row_id, unnest(map_entries(dates)) AS e FROM agent_flights)",
    "upserted_users": _AGENT
    + """, h AS (
  SELECT user, row_id % 2 AS half, arg_max(email, (loaded_at, row_id)) FILTER (email IS NOT NULL) AS email, arg_max(membership, (loaded_at, row_id)) FILTER (membership IS NOT NULL) AS membership FROM u WHERE user IS NOT NULL GROUP BY ALL
)
SELECT user, coalesce(n.email, b.email) AS email, coalesce(n.membership, b.membership) AS membership FROM (FROM h WHERE half = 1) b FULL JOIN (FROM h WHERE half = 0) n USING (user)""",
    "sides_of_tasks": CHILDREN + "SELECT CASE tab WHEN 'app_status' THEN 'user' ELSE 'agent' END AS side, tab AS child_table, count(*) AS n FROM (SELECT DISTINCT row_id, tab, parent, key FROM record) GROUP BY ALL",
    "described_tasks": CHILDREN + "SELECT row_id, string_agg(tab || ' ' || key || ': given', chr(10) ORDER BY tab, key) AS summary FROM (SELECT DISTINCT row_id, tab, key FROM record WHERE tab IN ('user', 'order', 'line', 'reservation')) GROUP BY ALL",
    "assembled_tasks": _CRITERIA + "SELECT row_id, task_id, len((j->'$.actions')::JSON[]) AS n_actions, CASE WHEN json_type(j->'$.reward_basis') = 'ARRAY' THEN array_to_string((j->'$.reward_basis')::VARCHAR[], ',') ELSE 'DB,COMMUNICATE' END AS reward_basis FROM c WHERE json_type(j->'$.actions') = 'ARRAY'",
    "evolved_tasks": """WITH t AS (SELECT task_id, arg_min({'i': user_scenario.instructions}, {'a': created_at, 'r': row_id}).i AS o, arg_max({'i': user_scenario.instructions}, {'a': created_at, 'r': row_id}).i AS n FROM tasks WHERE task_id IS NOT NULL GROUP BY ALL)
SELECT task_id, CASE WHEN o IS NOT NULL THEN coalesce(n.reason_for_call, o.reason_for_call) END AS reason_for_call, CASE WHEN o IS NOT NULL THEN coalesce(n.known_info, o.known_info) END AS known_info, CASE WHEN o IS NOT NULL THEN coalesce(n.task_instructions, o.task_instructions) END AS task_instructions FROM t""",
    "cleaned_tasks": "SELECT DISTINCT row_id, NULL::VARCHAR AS persona, user_scenario.instructions.domain AS domain FROM tasks",
    "extracted_json": _ACTIONS
    + f"SELECT row_id, CASE WHEN row_id % 6 <> 2 THEN array_to_string(list_sort(json_keys(j)), ',') END AS names FROM a LEFT JOIN {_VALID_JSON} v USING (row_id) WHERE starts_with(a.arguments, '{{')",
    "planted_marks": "SELECT doc_id, '{user_id}' || CASE WHEN regexp_full_match(domain, '[a-zA-Z_][a-zA-Z0-9_]*') THEN ' {' || domain || '}' ELSE '' END || ' {_x9}' AS marks, '{{user_id}}' || coalesce(' ' || replace(replace(source, '{', '{{'), '}', '}}'), '') || ' {{a b}}' || coalesce(' {{' || domain || '}}', '') || ' {{_x9}}' AS escaped FROM documents",
    "inserted_reboots": _ACTIONS
    + """, n AS (
  SELECT *, lead(CASE WHEN step LIKE 'check\\_%' ESCAPE '\\' OR step = 'reboot_device' THEN step = 'reboot_device' END IGNORE NULLS) OVER (PARTITION BY task_id, trial ORDER BY position) AS nxt FROM a WHERE domain = 'telecom'
)
SELECT task_id, trial, position + 0.5::DOUBLE AS position, 'policy_reboot_after_' || action_id AS action_id, 'reboot_device' AS step FROM n WHERE step = 'resume_line' AND NOT coalesce(nxt, false) AND action_id IS NOT NULL""",
    "shown_arguments": _ACTIONS
    + f"""SELECT a.row_id, coalesce(requestor, '') = 'assistant' AS covered, CASE WHEN coalesce(requestor, '') = 'assistant' THEN CASE WHEN j IS NOT NULL THEN array_to_string([k || '=???' FOR k IN list_sort(json_keys(j))], ', ') END ELSE a.arguments END AS shown
FROM a LEFT JOIN {_VALID_JSON} v USING (row_id)""",
    "called_actions": _ACTIONS
    + f"""SELECT a.row_id, p.range::INT AS pos, step AS name, coalesce(array_to_string(list_sort(json_keys(j)), ','), '') AS names FROM a LEFT JOIN {_VALID_JSON} v USING (row_id), range(2) p
WHERE domain = 'retail' AND step IS NOT NULL AND (row_id % 3 = 0 OR (row_id % 3 = 1 AND p.range = 0))""",
    "first_steps": _ACTIONS + "SELECT task_id, trial, position, row_id, step FROM a WHERE task_id IS NOT NULL AND trial IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task_id, trial ORDER BY position NULLS FIRST, row_id NULLS FIRST, step NULLS FIRST) <= 4",
    "retried_sequences": _JUDGED + "SELECT domain, seq_id, len(bad_idx) <= 3 AS success, least(len(bad_idx), 3)::INT AS retries_used FROM judged",
    "evolution_ladder": _SEQS + "SELECT domain, seq_id, len(tokens) AS length, CASE WHEN len(tokens) BETWEEN 1 AND 4 THEN 'full' WHEN len(tokens) BETWEEN 1 AND 8 THEN 'lite' ELSE 'original' END AS rung, len(tokens) BETWEEN 1 AND 8 AS evolved FROM acc",
    "usage_costs": f"SELECT 'host/' || source AS model, count(*) AS calls, round(sum(round((coalesce(n_chars, 0) * {_PRICE(0)} + length(coalesce(text, '')) * {_PRICE(1)}) / 1000000, 9)), 5) AS cost_usd FROM documents GROUP BY ALL",
}
