"""Queries of the core by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import key_form, name_form, name_forms
from .operators import cluster, distance, drift, entities, json_ops, lengths, ngram, orphans, providers, rules, select, sequences, shred
from .plans import pipeline
from .session import checked_broadcast, cut, place
from .sources.tables import table
from .streaming import online


def _airline(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return orphans.airline_inputs(*(table(spark, d, t) for t in ("agent_users", "agent_flights", "agent_reservations", "eval_actions")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(*_airline(spark, d)).select("src_table", "src_row_id", "ref_field", "ref_key")


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per referring table, field and month of loaded_at."""
    month = F.date_format("at", "yyyy-MM").alias("period")
    return orphans.orphans(*_airline(spark, d)).groupBy("src_table", "ref_field", month).agg(F.count(F.lit(1)).alias("n_orphans"), F.count_distinct("ref_key").alias("n_keys"))


#: Batches that the change log is replayed in.
BATCHES = 3


def _batches(spark: SparkSession, d: str) -> list[DataFrame]:
    log = orphans.airline_log(*(table(spark, d, t) for t in ("agent_users", "agent_flights", "agent_reservations", "eval_actions")))
    return orphans.in_spans(log, BATCHES)


def p1_current(spark: SparkSession, d: str) -> DataFrame:
    """Keys that live records point at and that don't exist, once all batches are in; the latest batch comes first, so that
    all others are late."""
    state = None
    for batch in reversed(_batches(spark, d)):
        state = orphans.fold(state, batch)
    return orphans.current_orphans(state)


def p1_folds(spark: SparkSession, d: str) -> DataFrame:
    """The report after each batch, in the order of time."""
    state, out = None, None
    for i, batch in enumerate(_batches(spark, d)):
        state = orphans.fold(state, batch)
        report = orphans.current_orphans(state).select(F.lit(i).alias("batch"), "*")
        out = report if out is None else out.unionByName(report)
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.task_tables(table(spark, d, "tasks")).select("row_id", "child_table", "parent_key", "child_key").distinct()


def p3_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every child record with its label, the label of its parent and its scalars, all tables in one long form."""
    t = shred.task_tables(table(spark, d, "tasks"))
    dotted = lambda c: F.array_join(F.col(c), ".")
    return t.select("row_id", "child_table", dotted("parent_label").alias("parent_label"), dotted("label").alias("label"), "parent_key", "child_key", F.to_json("attrs").alias("attrs")).distinct()


def p3_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Every scalar of every child record, all tables in one long form."""
    return shred.attributes(shred.task_tables(table(spark, d, "tasks")), "row_id").distinct()


def _fields(spark: SparkSession, d: str) -> DataFrame:
    return drift.tagged(table(spark, d, "telecom_snapshots"), drift.TELECOM_IDS)


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """The same, for queries that read it several times: bodies are parsed once."""
    return cut(_fields(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(_fields(spark, d))


def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The union of kinds of each field in each file, with counts."""
    _, present = drift.file_fields(_fields(spark, d))
    return present.select("feed_id", "file_no", "field", F.explode("kinds").alias("kind", "n")).where("n > 0")


def p6_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of values that a field has in a file and hadn't in the file before."""
    return drift.alternatives(_parsed(spark, d))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """The union of kinds of each path, below the top level too, in each file, with counts."""
    return drift.paths(_fields(spark, d))


def p6_path_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Kinds that a path has in a file and hadn't in the file before."""
    return drift.path_alternatives(_parsed(spark, d))


def _entity(spark: SparkSession, d: str, entity: str) -> DataFrame:
    fields = _parsed(spark, d)
    _, present = drift.file_fields(fields)
    out = drift.entity_table(cut(drift.consistent(fields, cut(drift.changes(fields)))), cut(present.drop("kinds")), entity)
    return out.withColumn("other", F.to_json("other"))


def p6_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of all files as one table of typed columns, with branches for values of other kinds."""
    return _entity(spark, d, "lines")


def p6_device(spark: SparkSession, d: str) -> DataFrame:
    """The same of devices."""
    return _entity(spark, d, "device")


def p6_customers(spark: SparkSession, d: str) -> DataFrame:
    """The same of customers."""
    return _entity(spark, d, "customers")


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    """All records of all files in one consistent table."""
    fields = _parsed(spark, d)
    long = drift.consistent(fields, cut(drift.changes(fields)))
    return long.withColumn("as_decimal", F.round("as_decimal", 6))


#: Steps of a window of acceptance, medoids of a stated set that sequences are compared with, and tries for a replacement.
EVERY, CENTERS, BUDGET = 400, 8, 99
#: Mean, std, skew and bounds of drawn lengths (fixed values).
LENGTHS = (7.0, 5.0, 2.0, 1, 15)
#: Sequences of a sampled pool and rounds of re-clustering, the defaults of the reference.
POOL, ROUNDS = 2_000, 3
#: Names of all vocabularies at most, for costs by type.
MOST_NAMES = 100_000
#: Rules on the order of steps, for ordering_violations().
ORDER_RULES = [("only_last", {"transfer_to_human_agents"}, set()), ("first_block", {"find_user_id_by_email", "find_user_id_by_name_zip"}, set()), ("before", {"get_user_details"}, {"cancel_reservation"}), ("between", {"get_order_details"}, {"return_delivered_order_items", "exchange_delivered_order_items"}), ("not_after", {"resume_line"}, {"reboot_device"})]


def _members(spark: SparkSession, d: str, *together: str) -> DataFrame:
    """Distinct members; those that are equal in the columns `together` are in one partition."""
    m = table(spark, d, "cluster_members").select("domain", "seq_id", "cluster_key", "is_medoid", F.col("distance_to_medoid").alias("distance"), name_forms("tokens").alias("tokens"))
    return (m.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *together) if together else m).distinct()


def _accepted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sampler_accepted").select("domain", "seq_id", "t", name_forms("tokens").alias("tokens")).distinct()


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "model_vocab").select("domain", "token", "action_type")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return providers.by_rules(_vocab(spark, d))(_members(spark, d))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Accepted sequences count as positive, invalid members at their bad places as negative."""
    good = _accepted(spark, d).select("domain", "tokens", F.lit(True).alias("valid"), F.array().cast("array<int>").alias("bad_idx"))
    bad = _judged(spark, d).where("not valid").select("domain", "tokens", "valid", "bad_idx")
    return ngram.count(ngram.feedback(good.unionByName(bad)), _vocab(spark, d))


def seq_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).select("domain", "seq_id", F.posexplode("tokens").alias("pos", "token"))


def seed_sequences(spark: SparkSession, d: str) -> DataFrame:
    seeds = sequences.seed_sequences(table(spark, d, "tasks").distinct())
    return seeds.select("row_id", "task_id", F.array_join("tokens", ">").alias("tokens"))


def seq_length_stats(spark: SparkSession, d: str) -> DataFrame:
    fitted = lengths.fit(_members(spark, d).select("domain", F.size("tokens").alias("length")), "domain")
    return fitted.select("domain", "n", *(F.round(c, 6).alias(c) for c in ("median", "std", "p10", "p90")), "low", "high")


def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = lengths.histogram(_members(spark, d).select("domain", F.size("tokens").alias("length")), "domain")
    return h.select("domain", F.explode("lengths").alias("length", "k"))


def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).select("domain", "sign", F.array_join("ctx", ">").alias("ctx"), "token", "w")


def context_totals(spark: SparkSession, d: str) -> DataFrame:
    return ngram.context_totals(_counts(spark, d)).select("domain", "sign", F.array_join("ctx", ">").alias("ctx"), "total")


def seen_scores(spark: SparkSession, d: str) -> DataFrame:
    """Posteriors and signed scores of the n-grams that were seen."""
    scores = ngram.seen_scores(_counts(spark, d), _vocab(spark, d))
    return scores.select("domain", F.array_join("ctx", ">").alias("ctx"), "token", *(F.round(c, 7).alias(c) for c in ("p_pos", "p_neg", "score")))


def top_continuation(spark: SparkSession, d: str) -> DataFrame:
    """The best continuation of each context; one unseen name stands for all of them."""
    scores = ngram.seen_scores(_counts(spark, d), _vocab(spark, d), unseen=True)
    best = scores.groupBy("domain", "ctx").agg(F.min(F.struct((-F.round("score", 7)).alias("s"), "token")).alias("b"))
    return best.select("domain", F.array_join("ctx", ">").alias("ctx"), F.col("b.token").alias("token"), (-F.col("b.s")).alias("score"))


def temperature_schedule(spark: SparkSession, d: str) -> DataFrame:
    c = ngram.Config()
    return _accepted(spark, d).select("t").distinct().select("t", F.round(ngram.temperature(F.col("t"), c.tau0, c.decay), 9).alias("temperature"))


def window_acceptance(spark: SparkSession, d: str) -> DataFrame:
    judged = providers.by_rules(_vocab(spark, d))(_accepted(spark, d))
    return ngram.window_stats(judged.select("domain", "t", F.col("valid").alias("accepted")), EVERY)


def write_fractions(spark: SparkSession, d: str) -> DataFrame:
    joined = _members(spark, d).join(sequences.type_map(_vocab(spark, d)), "domain", "left")
    types = F.coalesce("types", F.create_map().cast("map<string,string>"))
    return joined.select("domain", "seq_id", F.round(sequences.write_fraction(F.col("tokens"), types), 9).alias("write_fraction"), sequences.only_writes(F.col("tokens"), types).alias("only_writes"))


def token_classes(spark: SparkSession, d: str) -> DataFrame:
    """Effective type and group of every token of the vocabulary."""
    return sequences.action_types(_vocab(spark, d)).select("domain", "token", "type", sequences.effective_type(F.col("type")).alias("effective_type"), sequences.action_group(F.col("token")).alias("action_group"))


def rubric_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("domain", "seq_id", "valid", "reason", F.array_join(F.col("bad_idx").cast("array<string>"), ",").alias("bad_idx"))


def ordering_rules(spark: SparkSession, d: str) -> DataFrame:
    broken = sequences.ordering_violations(F.col("tokens"), ORDER_RULES)
    return _members(spark, d).select("domain", "seq_id", F.explode(broken).alias("rule"))


def duplicate_status(spark: SparkSession, d: str) -> DataFrame:
    """Members as accepted_dup, rejected_dup (the tokens of an invalid medoid) or new."""
    judged = _judged(spark, d)
    return sequences.status_of(_members(spark, d), _accepted(spark, d), judged.where("is_medoid and not valid")).select("domain", "seq_id", "status")


def _to_medoid(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    medoids = m.where("is_medoid").groupBy("cluster_key").agg(F.min(F.struct("seq_id", "tokens")).alias("m"))
    return m.join(medoids, "cluster_key").select("domain", "seq_id", "tokens", F.col("m.tokens").alias("medoid"))


def edit_distances(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance of each member to its medoid."""
    a, b = F.col("tokens"), F.col("medoid")
    return _to_medoid(spark, d).select("domain", "seq_id", distance.edit_distance(a, b).alias("distance"), F.round(distance.normalized(a, b), 9).alias("normalized"))


def weighted_distances(spark: SparkSession, d: str) -> DataFrame:
    """Weighted edit distance of each member to its medoid; types come from the vocabulary, a table of fixed size."""
    return distance.weighted(_to_medoid(spark, d), "tokens", "medoid", _costs(_vocab(spark, d))).select("domain", "seq_id", F.round("distance", 2).alias("distance"))


def _medoids(spark: SparkSession, d: str, members: DataFrame | None = None) -> DataFrame:
    """The medoids of each domain, placed by the size of their clusters."""
    sizes = (_members(spark, d) if members is None else members).groupBy("domain", "cluster_key").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("is_medoid"), F.struct("seq_id", "tokens"))).alias("m")).where("m is not null")
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "cluster_key"))
    return sizes.withColumn("rank", rank).select("domain", "rank", "cluster_key", F.col("m.tokens").alias("tokens"))


def _placed(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("place", F.col("rank") - 1).drop("rank")


def _centers(spark: SparkSession, d: str) -> DataFrame:
    """The medoids of the CENTERS largest clusters of each domain."""
    return _placed(_medoids(spark, d).where(F.col("rank") <= CENTERS)).drop("cluster_key")


def nearest_center(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each sequence to a given set, the medoids of its domain's largest clusters."""
    given: dict = {}
    for r in _centers(spark, d).orderBy("domain", "place").collect():
        given.setdefault(r.domain, []).append(r.tokens)
    out = distance.to_set(_members(spark, d).select("domain", "seq_id", "tokens"), "tokens", "domain", given)
    return out.select("domain", "seq_id", F.round("min_distance", 9).alias("min_distance"), "nearest", F.round("mean_distance", 9).alias("mean_distance"))


def nearest_medoid(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each sequence to all medoids of its domain, in blocks; nearest is a place, those of larger clusters first."""
    by = ["domain", "tokens"]
    own = _members(spark, d, *by).groupBy(*by).agg(F.collect_list(F.struct("seq_id", "cluster_key", "is_medoid")).alias("own"))
    own = cut(own.withColumn("_id", F.monotonically_increasing_id()))
    medoids = cut(_placed(_medoids(spark, d, own.select(*by, F.inline("own")))))
    named = checked_broadcast(medoids.select("domain", F.col("place").alias("nearest"), F.col("cluster_key").alias("nearest_cluster")))
    ids = own.select("_id", "domain", F.array_distinct("own.seq_id").alias("ids"))
    out = ids.join(distance.numbered_to_sets(own, medoids), "_id", "left").join(named, ["domain", "nearest"], "left")
    return out.select("domain", F.explode("ids").alias("seq_id"), F.round("min_distance", 9).alias("min_distance"), "nearest", "nearest_cluster", F.round("mean_distance", 9).alias("mean_distance"))


def medoid_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Plain edit distances of all pairs of medoids of a domain, in blocks of pairs."""
    return distance.all_pairs(cut(_placed(_medoids(spark, d))).withColumnRenamed("place", "idx"), distance.Costs(None))


def weighted_medoid_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Weighted edit distances of all pairs of medoids of a domain, in blocks of pairs."""
    pairs = distance.all_pairs(cut(_placed(_medoids(spark, d))).withColumnRenamed("place", "idx"), _costs(_vocab(spark, d)))
    return pairs.withColumn("distance", F.round("distance", 2))


def best_medoids(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster's best medoid: the member with the least sum of weighted distances to all, the first id on ties."""
    m = cut(_members(spark, d).select("domain", "cluster_key", "seq_id", "tokens"))
    costs = distance.medoid_costs(m.select("domain", "cluster_key", "tokens"), _costs(_vocab(spark, d)))
    ids = m.groupBy("cluster_key", "tokens").agg(F.min("seq_id").alias("seq_id"))
    best = costs.join(ids, ["cluster_key", "tokens"]).groupBy("cluster_key").agg(F.min(F.struct(F.round("cost", 2).alias("cost"), "seq_id")).alias("b"))
    return best.select("cluster_key", "b.seq_id", "b.cost")


def accepted_pool(spark: SparkSession, d: str) -> DataFrame:
    """The first POOL distinct sequences of each domain that were accepted, in the order of their steps and ids."""
    made = _accepted(spark, d).select("domain", F.struct("t", "seq_id").alias("attempt"), "tokens")
    return cluster.unique_pool(made, POOL).select("domain", "idx", F.array_join("tokens", ">").alias("tokens"))


def pool_distances(spark: SparkSession, d: str) -> DataFrame:
    """Weighted distances of all pairs of a sampled pool of POOL sequences per domain."""
    counts, vocab = cut(_counts(spark, d)), _vocab(spark, d)
    drawn = lengths.skew_normal(*LENGTHS, "domain", "attempt")
    pool = pipeline.sample_pool(counts, vocab, POOL, drawn, seed=5)
    return distance.all_pairs(cut(pool), _costs(vocab))


def _costs(vocab: DataFrame) -> distance.DomainCosts:
    """Costs by the types of each domain's vocabulary, of MOST_NAMES names at most; more are an error."""
    rows = sequences.action_types(vocab).select("domain", "token", "type").distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names in the vocabularies")
    types: dict = {}
    for r in rows:
        types.setdefault(r.domain, {})[r.token] = r.type
    return distance.DomainCosts(types)


def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return select.cluster_sizes(_members(spark, d), "cluster_key", "domain").withColumn("mean_size", F.round("mean_size", 6))


def _validated(spark: SparkSession, d: str) -> DataFrame:
    return select.validate_clusters(_judged(spark, d), BUDGET)


def medoid_replacement(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d).withColumn("final_sequence", F.array_join("final_sequence", ">"))


def validation_status(spark: SparkSession, d: str) -> DataFrame:
    return select.status_counts(_validated(spark, d))


def merged_validation(spark: SparkSession, d: str) -> DataFrame:
    """All clusters of cluster_info with what validation said of them."""
    info = table(spark, d, "cluster_info").select("cluster_key", "domain", F.col("status").alias("listed_status"), "n_members").distinct()
    return select.with_validation(info, _validated(spark, d).select("cluster_key", "status", "attempts"))


def first_valid_member(spark: SparkSession, d: str) -> DataFrame:
    return select.first_valid(_judged(spark, d)).select("cluster_key", "seq_id")


def pending_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Usable clusters that no valid member has finished yet."""
    info = table(spark, d, "cluster_info").select("cluster_key", "domain", "status").distinct()
    return select.pending(select.usable(info), _judged(spark, d).select("cluster_key", F.col("valid").alias("success")), "cluster_key").select("cluster_key", "domain", "status")


def write_summary(spark: SparkSession, d: str) -> DataFrame:
    finals = _validated(spark, d).join(_members(spark, d).select("cluster_key", "domain").distinct(), "cluster_key")
    return select.write_summary(finals, sequences.action_types(_vocab(spark, d)))


def _keyed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    users = table(spark, d, "agent_users").select("row_id", "user_id", "email", "membership", "reservations", "loaded_at").distinct().withColumn("user", key_form("user_id"))
    reservations = table(spark, d, "agent_reservations").distinct().withColumns({"user": key_form("user_id"), "reservation": key_form("reservation_id")})
    return users, reservations


def missing_users(spark: SparkSession, d: str) -> DataFrame:
    """Reservations whose user was never loaded."""
    users, reservations = _keyed(spark, d)
    return rules.missing(reservations, users.select(F.col("user").alias("known")), {"user": "known"}).select("row_id", "user")


def unlisted_reservations(spark: SparkSession, d: str) -> DataFrame:
    """Reservations that no version of their owner lists."""
    users, reservations = _keyed(spark, d)
    owners = users.select("user", F.transform("reservations", key_form).alias("links"))
    return rules.not_listed(reservations.select("row_id", "user", "reservation"), owners, "user", "reservation", "links").select("row_id", "user", "reservation")


def users_over_limit(spark: SparkSession, d: str) -> DataFrame:
    _, reservations = _keyed(spark, d)
    return rules.over_limit(reservations, ["user"], F.col("cabin") == "business", 3)


def reused_flights(spark: SparkSession, d: str) -> DataFrame:
    _, reservations = _keyed(spark, d)
    legs = reservations.select("row_id", F.explode("flights.flight_number").alias("flight")).withColumn("flight", key_form("flight"))
    return rules.reused(legs, ["row_id"], "flight")


def ambiguous_flights(spark: SparkSession, d: str) -> DataFrame:
    """Routes and dates that several flights share."""
    flights = table(spark, d, "agent_flights").select("origin", "destination", F.explode(F.map_keys("dates")).alias("date"), key_form("flight_number").alias("flight"))
    out = rules.ambiguous(flights.where("origin is not null and destination is not null"), ["origin", "destination", "date"], "flight")
    return out.withColumn("others", F.array_join("others", ","))


def _failures(spark: SparkSession, d: str) -> DataFrame:
    users, reservations = _keyed(spark, d)
    none = rules.violation(reservations.where(F.coalesce(F.size("flights"), F.lit(0)) < 1), ["row_id"], "shape", F.lit("no flights"))
    lost = rules.violation(rules.missing(reservations, users.select(F.col("user").alias("known")), {"user": "known"}), ["row_id"], "references", F.concat(F.lit("unknown user "), F.col("user")))
    keyless = rules.violation(reservations.where(F.coalesce("user", F.lit("")) == ""), ["row_id"], "references", F.lit("missing required argument user_id"))
    return rules.first_failure(none.unionByName(lost).unionByName(keyless), ["row_id"], ["shape", "references"])


def rule_chain(spark: SparkSession, d: str) -> DataFrame:
    """The first failing check of each reservation and what it makes to be patched."""
    return rules.route(_failures(spark, d), ["references"], ["missing required argument"])


def merged_users(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last non-null email and membership."""
    users, _ = _keyed(spark, d)
    return entities.merge_scalars(users, ["user"], ["email", "membership"], ["loaded_at", "row_id"])


def merged_reservation_lists(spark: SparkSession, d: str) -> DataFrame:
    users, _ = _keyed(spark, d)
    out = entities.merge_lists(users, ["user"], "reservations", "loaded_at")
    return out.select("user", F.array_join("reservations", ",").alias("reservations"))


def back_links(spark: SparkSession, d: str) -> DataFrame:
    """Each user's list of reservations, with those that name the user added."""
    users, reservations = _keyed(spark, d)
    owners = users.select("user", F.transform("reservations", key_form).alias("links"))
    return entities.back_links(owners, reservations, "user", "links", "reservation").select("user", F.array_join("links", ",").alias("links"))


def flight_dates(spark: SparkSession, d: str) -> DataFrame:
    """The map of dates as a list of records that have their key."""
    listed = table(spark, d, "agent_flights").select("row_id", F.explode(entities.map_to_list(F.col("dates"), "date")).alias("e"))
    return listed.select("row_id", "e.date", "e.record.status", "e.record.available_seats").distinct()


def _actions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_actions").distinct().withColumn("step", name_form("name"))


def follow_ups(spark: SparkSession, d: str) -> DataFrame:
    """Lines that were resumed without the user's next action being a reboot."""
    a = _actions(spark, d).where("domain = 'telecom'")
    out = entities.missing_follow_ups(a, ["task_id", "trial"], "position", F.col("step") == "resume_line", F.col("step").startswith("check_") | (F.col("step") == "reboot_device"), F.col("step") == "reboot_device")
    return out.select("row_id", "task_id", "trial", "position")


def redacted_arguments(spark: SparkSession, d: str) -> DataFrame:
    out = entities.redact(_actions(spark, d), ["task_id", "trial"], ["row_id"], 0.33, "arguments", F.col("requestor").eqNullSafe(F.lit("assistant")), seed=1)
    return out.groupBy("domain", "trial", "task_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("covered").alias("n_covered"))


def argument_parse_stages(spark: SparkSession, d: str) -> DataFrame:
    return _actions(spark, d).select("row_id", json_ops.parse_stage(F.col("arguments")).alias("stage"))


def task_actions(spark: SparkSession, d: str) -> DataFrame:
    return entities.task_rows(table(spark, d, "tasks").distinct()).select("row_id", "pos", "action_id", "name", "requestor", "info")


def task_changes(spark: SparkSession, d: str) -> DataFrame:
    """Scalars of the criteria that differ between each row of a task and the row before it."""
    w = Window.partitionBy("task_id").orderBy("created_at", "row_id")
    rows = table(spark, d, "tasks").groupBy("task_id", "created_at", "row_id").agg(F.max("evaluation_criteria").alias("new"))
    both = cut(rows.withColumns({"old": F.lag("new").over(w), "n": F.row_number().over(w)}).where("n > 1"))
    return json_ops.deep_diff(both.select("task_id", "row_id", F.col("old").alias("doc")), both.select("task_id", "row_id", F.col("new").alias("doc")), ["task_id", "row_id"], "doc")


def trial_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Steps of every later trial of a task that differ from its trial 0. Trial 1 counts for each task, also where it was
    never run; others where they have rows."""
    a = cut(_actions(spark, d).select("task_id", "trial", "position", "step"))
    first, later = a.where("trial = 0").drop("trial"), a.where("trial > 0")
    second = first.select("task_id", F.lit(1).cast(a.schema["trial"].dataType).alias("trial"))
    trials = later.select("task_id", "trial").unionByName(second).distinct().withColumnRenamed("task_id", "_t")
    expected = first.join(trials, F.col("task_id").eqNullSafe(F.col("_t")))
    return entities.mismatches(expected, later, ["task_id", "trial"], "position", "step")


def sampled_sequences(spark: SparkSession, d: str) -> DataFrame:
    """200 sampled sequences per domain, of lengths by a kernel density of the accepted ones."""
    counts, vocab = cut(_counts(spark, d)), _vocab(spark, d)
    draws = vocab.select("domain").distinct().withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(199)).cast("array<long>")))
    drawn = lengths.kernel(draws, _accepted(spark, d).select("domain", F.size("tokens").alias("length")), "domain", "domain", "attempt")
    made = ngram.generate(drawn.withColumn("tau", F.lit(1.5)), counts, vocab, seed=7)
    return made.select("domain", "attempt", F.array_join("tokens", ">").alias("tokens"))


def clustered_pool(spark: SparkSession, d: str) -> DataFrame:
    """12 validated clusters per domain of a sampled pool of POOL sequences, with up to ROUNDS rounds around frozen centers."""
    counts, vocab = cut(_counts(spark, d)), _vocab(spark, d)
    drawn = lengths.skew_normal(*LENGTHS, "domain", "attempt")
    out = pipeline.cluster_and_validate(spark, counts, vocab, providers.by_rules(vocab), 12, POOL, drawn, _costs(vocab), seed=42, rounds=ROUNDS)
    return out.select("domain", "cluster_idx", "status", F.array_join("final_sequence", ">").alias("final_sequence"), "attempts")


def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type, counted by a stream."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    events = online.stream(spark, f"{d}/events.parquet*", schema)
    daily = events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return online.run_to_table(daily, place(spark, "daily"), "complete").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


#: Child tables that are registered one by one as flat tables.
FLAT = list(dict.fromkeys(t for t, _, _ in shred.TASK_TABLES))


def _flat(child: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return shred.flat_table(cut(shred.task_tables(table(spark, d, "tasks"))), "row_id", child)

    query.__name__ = f"p3_{child}s" if not child.endswith("s") else f"p3_{child}es"
    query.__doc__ = f"The records of {child} as a flat table with links to their parents."
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import run_queries

    return {f.__name__: f for f in (p1_found, p1_periods, p1_current, p1_folds, p3_found, p3_tables, p3_attributes, *map(_flat, FLAT), p6_found, p6_kinds, p6_table, p6_alternatives, p6_paths, p6_path_alternatives, p6_lines, p6_device, p6_customers, seq_tokens, seed_sequences, seq_length_stats, length_histogram, ngram_counts, context_totals, seen_scores, top_continuation, temperature_schedule, window_acceptance, write_fractions, token_classes, rubric_verdicts, ordering_rules, duplicate_status, edit_distances, weighted_distances, nearest_center, nearest_medoid, medoid_pairs, weighted_medoid_pairs, best_medoids, accepted_pool, pool_distances, cluster_sizes, medoid_replacement, validation_status, merged_validation, first_valid_member, pending_clusters, write_summary, missing_users, unlisted_reservations, users_over_limit, reused_flights, ambiguous_flights, rule_chain, merged_users, merged_reservation_lists, back_links, flight_dates, follow_ups, redacted_arguments, argument_parse_stages, task_actions, task_changes, trial_mismatches, sampled_sequences, clustered_pool, stream_daily)} | run_queries.queries()


def oracle_sql() -> dict[str, str]:
    from . import run_queries
    from .oracle import SQL

    return {k: v for k, v in (SQL | run_queries.SQL).items() if k in queries()}
