"""DuckDB SQL of the core's queries, over whole tables."""

from __future__ import annotations


def _key(x: str) -> str:
    return f"upper(regexp_replace({x}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))"


#: Arguments as a tree: one row per value with the name it has. json_tree visits every depth.
_ORPHANS = f"""
WITH act AS (
  SELECT row_id, loaded_at, arguments FROM eval_actions
  WHERE domain = 'airline' AND arguments IS NOT NULL AND json_valid(arguments)
), refs AS (
  SELECT 'agent_reservations' AS src_table, row_id AS src_row_id, 'user_id' AS ref_field, {_key("user_id")} AS ref_key, loaded_at AS seen_at FROM agent_reservations
  UNION SELECT 'agent_reservations', row_id, 'flight_number', {_key("leg.flight_number")}, loaded_at
    FROM (SELECT row_id, loaded_at, unnest(flights) AS leg FROM agent_reservations)
  UNION SELECT 'agent_users', row_id, 'reservation_id', {_key("r")}, loaded_at
    FROM (SELECT row_id, loaded_at, unnest(reservations) AS r FROM agent_users)
  UNION SELECT 'eval_actions', row_id,
      CASE regexp_replace(lower(t.key), '[^a-z]', '', 'g') WHEN 'userid' THEN 'user_id' WHEN 'reservationid' THEN 'reservation_id' ELSE 'flight_number' END,
      {_key("t.value->>'$'")}, loaded_at
    FROM act, json_tree(act.arguments::JSON) AS t
    WHERE regexp_replace(lower(t.key), '[^a-z]', '', 'g') IN ('userid', 'reservationid', 'flightnumber')
      AND t.type NOT IN ('OBJECT', 'ARRAY', 'NULL', 'BOOLEAN')
), versions AS (
  SELECT 'user_id' AS ref_field, {_key("user_id")} AS ref_key, loaded_at AS seen_at, row_id AS seq, deleted_at FROM agent_users
  UNION SELECT 'reservation_id', {_key("reservation_id")}, loaded_at, row_id, deleted_at FROM agent_reservations
  UNION SELECT 'flight_number', {_key("flight_number")}, loaded_at, row_id, deleted_at FROM agent_flights
), last AS (
  SELECT r.*, arg_max({{'d': v.deleted_at}}, {{'a': v.seen_at, 's': v.seq}}) AS v, count(v.seen_at) AS n
  FROM refs r LEFT JOIN versions v ON v.ref_field = r.ref_field AND v.ref_key = r.ref_key AND v.seen_at <= r.seen_at
  WHERE regexp_matches(r.ref_key, '[0-9]') AND r.seen_at IS NOT NULL
  GROUP BY ALL
), orphan AS (
  SELECT * FROM last WHERE n = 0 OR v.d <= seen_at
)
"""

_TREE = """
WITH fields AS (
  SELECT DISTINCT s.feed_id, s.file_no, s.exported_at, s.entity, s.row_id, f.key AS field, f.value AS value, s.body->>(CASE s.entity WHEN 'device' THEN 'device_id' WHEN 'customers' THEN 'customer_id' ELSE 'line_id' END) AS record_id,
    CASE json_type(f.value) WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'HUGEINT' THEN 'integer' WHEN 'DOUBLE' THEN 'decimal' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END AS kind,
    CASE WHEN json_type(f.value) = 'NULL' THEN NULL ELSE f.value->>'$' END AS text
  FROM (SELECT feed_id, file_no, exported_at, entity, row_id, body::JSON AS body FROM telecom_snapshots WHERE json_valid(body)) s, json_each(s.body) f
), files AS (
  SELECT feed_id, file_no, count(DISTINCT row_id) AS n, min(exported_at) AS seen_at FROM fields GROUP BY ALL
), ordered AS (
  SELECT *, lag(file_no) OVER (PARTITION BY feed_id ORDER BY seen_at, file_no) AS prev_no FROM files
), counted AS (
  SELECT feed_id, file_no, field, kind, count(*) AS n FROM fields GROUP BY ALL
), present AS (
  SELECT c.feed_id, c.file_no, c.field, sum(c.n) AS carriers,
    arg_max(c.kind, c.n * 10 - list_position(['string', 'integer', 'decimal', 'boolean', 'array', 'object'], c.kind)) FILTER (c.kind IS NOT NULL) AS kind
  FROM counted c JOIN files f USING (feed_id, file_no) GROUP BY c.feed_id, c.file_no, c.field, f.n HAVING sum(c.n) * 20 > f.n
)
"""

#: What comes, goes and is renamed from file to file.
_CHANGES = (
    _TREE
    + """, pair AS (
  SELECT o.feed_id, o.file_no, o.prev_no FROM ordered o WHERE o.prev_no IS NOT NULL
), now AS (
  SELECT p.feed_id, p.file_no, x.field, x.kind FROM pair p JOIN present x ON x.feed_id = p.feed_id AND x.file_no = p.file_no
), was AS (
  SELECT p.feed_id, p.file_no, x.field, x.kind FROM pair p JOIN present x ON x.feed_id = p.feed_id AND x.file_no = p.prev_no
), come AS (
  SELECT feed_id, file_no, field FROM now ANTI JOIN was USING (feed_id, file_no, field)
), gone AS (
  SELECT feed_id, file_no, field FROM was ANTI JOIN now USING (feed_id, file_no, field)
), renamed AS (
  SELECT g.feed_id, g.file_no, g.field AS old_field, c.field AS new_field
  FROM gone g JOIN come c USING (feed_id, file_no) JOIN pair p USING (feed_id, file_no)
  JOIN fields a ON a.feed_id = g.feed_id AND a.file_no = p.prev_no AND a.field = g.field
  JOIN fields b ON b.feed_id = g.feed_id AND b.file_no = g.file_no AND b.field = c.field AND b.record_id = a.record_id
  WHERE a.text IS NOT NULL AND b.text IS NOT NULL
  GROUP BY ALL HAVING 5 * count(*) FILTER (a.text = b.text) >= 4 * count(*)
)
"""
)

_KIND = "WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'HUGEINT' THEN 'integer' WHEN 'DOUBLE' THEN 'decimal' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'null'"

_PATHS = (
    _TREE
    + f""", pathed AS (
  SELECT feed_id, file_no, path, kind, count(DISTINCT row_id) AS n FROM (
    SELECT s.feed_id, s.file_no, s.row_id, CASE t.type {_KIND} END AS kind, regexp_replace(regexp_replace(substr(t.fullkey, 3), '\\[[0-9]+\\]', '[]', 'g'), '"', '', 'g') AS path
    FROM (SELECT feed_id, file_no, row_id, body::JSON AS body FROM telecom_snapshots WHERE json_valid(body)) s, json_tree(s.body) t WHERE t.fullkey <> '$')
  GROUP BY ALL
)
"""
)

SQL: dict[str, str] = {
    "p1_found": _ORPHANS + "SELECT DISTINCT src_table, src_row_id, ref_field, ref_key FROM orphan",
    "p1_periods": _ORPHANS + "SELECT src_table, ref_field, strftime(seen_at, '%Y-%m') AS period, count(*) AS n_orphans, count(DISTINCT ref_key) AS n_keys FROM orphan GROUP BY ALL",
    "p6_found": _CHANGES
    + """SELECT feed_id, file_no, 'renamed' AS change, old_field, new_field FROM renamed
UNION ALL SELECT feed_id, file_no, 'added', '', field FROM come c WHERE NOT EXISTS (FROM renamed r WHERE r.feed_id = c.feed_id AND r.file_no = c.file_no AND r.new_field = c.field)
UNION ALL SELECT feed_id, file_no, 'removed', field, '' FROM gone g WHERE NOT EXISTS (FROM renamed r WHERE r.feed_id = g.feed_id AND r.file_no = g.file_no AND r.old_field = g.field)
UNION ALL SELECT feed_id, file_no, 'retyped', field, field FROM now JOIN was USING (feed_id, file_no, field) WHERE now.kind <> was.kind""",
    "p6_alternatives": _TREE
    + """SELECT c.feed_id, c.file_no, c.field, c.kind, c.n FROM counted c JOIN present p USING (feed_id, file_no, field) JOIN ordered o USING (feed_id, file_no)
JOIN present b ON b.feed_id = c.feed_id AND b.file_no = o.prev_no AND b.field = c.field
WHERE c.kind IS NOT NULL AND NOT EXISTS (FROM counted x WHERE x.feed_id = c.feed_id AND x.file_no = o.prev_no AND x.field = c.field AND x.kind = c.kind)""",
    "p6_table": _CHANGES
    + """, step AS (
  SELECT feed_id, new_field AS field, min(old_field) AS was FROM renamed WHERE old_field <> new_field GROUP BY ALL
), back AS (
  WITH RECURSIVE b(feed_id, field, upto, seen) AS (
    SELECT feed_id, field, was, [field, was] FROM step
    UNION ALL SELECT b.feed_id, b.field, s.was, list_append(b.seen, s.was) FROM b JOIN step s ON s.feed_id = b.feed_id AND s.field = b.upto WHERE NOT list_contains(b.seen[:-2], b.upto)
  ) SELECT feed_id, field, arg_max(upto, len(seen)) AS upto, arg_max(seen, len(seen)) AS seen FROM b GROUP BY ALL
), named AS (
  SELECT b.feed_id, b.field, CASE WHEN EXISTS (FROM step s WHERE s.feed_id = b.feed_id AND s.field = b.upto) THEN list_min(b.seen) ELSE b.upto END AS canonical FROM back b
)
SELECT f.entity, f.feed_id, f.file_no, f.row_id, f.record_id, coalesce(n.canonical, f.field) AS field, f.field AS source_field, f.kind,
  CASE WHEN kind = 'string' THEN text END AS as_string, CASE WHEN kind = 'integer' THEN try_cast(text AS BIGINT) END AS as_integer, CASE WHEN kind = 'decimal' THEN round(try_cast(text AS DOUBLE), 6) END AS as_decimal,
  CASE WHEN kind = 'boolean' THEN text::BOOLEAN END AS as_boolean, CASE WHEN kind IN ('array', 'object') THEN text END AS as_json, text AS canonical
FROM fields f LEFT JOIN named n USING (feed_id, field)""",
    "p6_paths": _PATHS + "SELECT * FROM pathed",
    "p6_path_alternatives": _PATHS
    + """SELECT p.* FROM pathed p JOIN ordered o USING (feed_id, file_no)
WHERE EXISTS (FROM pathed b WHERE b.feed_id = p.feed_id AND b.file_no = o.prev_no AND b.path = p.path)
AND NOT EXISTS (FROM pathed b WHERE b.feed_id = p.feed_id AND b.file_no = o.prev_no AND b.path = p.path AND b.kind = p.kind)""",
    "p6_kinds": _TREE + "SELECT c.feed_id, c.file_no, c.field, c.kind, c.n FROM counted c JOIN present p USING (feed_id, file_no, field) WHERE c.kind IS NOT NULL",
}


def _name(x: str) -> str:
    return f"nullif(trim(regexp_replace(lower({x}), '[^a-z]+', '_', 'g'), '_'), '')"


def _names(x: str) -> str:
    return f"coalesce(list_filter([{_name('x')} FOR x IN {x}], lambda y: y IS NOT NULL), [])"


#: Members and accepted sequences, their windows of three, and the deterministic verdict on members.
_SEQS = f"""
WITH m AS (
  SELECT DISTINCT domain, seq_id, cluster_key, is_medoid, distance_to_medoid AS distance, {_names("tokens")} AS tokens FROM cluster_members
), acc AS (
  SELECT DISTINCT domain, seq_id, t, {_names("tokens")} AS tokens FROM sampler_accepted
), known AS (
  SELECT domain, list(DISTINCT token) AS known FROM model_vocab GROUP BY ALL
)
"""


def _verdict(source: str, alias: str) -> str:
    i = "range(len(tokens))"
    return f"""
, {alias}_idx AS (
  SELECT s.*, [i FOR i IN {i} IF NOT list_contains(k.known, tokens[i + 1])] AS unknown,
    [i FOR i IN {i} IF i >= 2 AND tokens[i + 1] = tokens[i] AND tokens[i] = tokens[i - 1]] AS runs,
    [i FOR i IN {i} IF tokens[i + 1] = 'transfer_to_human_agents' AND i < len(tokens) - 1] AS early
  FROM {source} s LEFT JOIN known k USING (domain)
), {alias} AS (
  SELECT *, reason IS NULL AS valid, CASE reason WHEN 'unknown action' THEN unknown WHEN 'repeated' THEN runs WHEN 'not at the end' THEN early ELSE [] END AS bad_idx
  FROM (SELECT *, CASE WHEN len(tokens) = 0 THEN 'empty' WHEN len(unknown) > 0 THEN 'unknown action' WHEN len(runs) > 0 THEN 'repeated' WHEN len(early) > 0 THEN 'not at the end' END AS reason FROM {alias}_idx)
)
"""


_JUDGED = _SEQS + _verdict("m", "judged")

_GRAMS = _JUDGED + """
, fed AS (
  SELECT domain, 'pos' AS sign, tokens, NULL::BIGINT[] AS bad_idx FROM acc
  UNION ALL SELECT domain, 'neg', tokens, bad_idx FROM judged WHERE NOT valid AND len(bad_idx) > 0
), windows AS (
  SELECT domain, sign, bad_idx, len(tokens) AS n, pos, p[pos + 1] || '>' || p[pos + 2] AS ctx, p[pos + 3] AS token
  FROM (SELECT *, unnest(range(len(tokens) + 1)) AS pos FROM (SELECT *, ['|BOS|', '|BOS|'] || tokens || ['|EOS|'] AS p FROM fed))
), counts AS (
  SELECT domain, sign, ctx, token, count(*)::DOUBLE AS w FROM windows w
  WHERE (bad_idx IS NULL OR (list_contains(bad_idx, pos) AND pos < n)) AND (token = '|EOS|' OR EXISTS (FROM model_vocab v WHERE v.domain = w.domain AND v.token = w.token))
  GROUP BY ALL
), size AS (
  SELECT domain, count(DISTINCT token) AS v FROM model_vocab GROUP BY ALL
), totals AS (
  SELECT domain, ctx, coalesce(sum(w) FILTER (sign = 'pos'), 0) AS tp, coalesce(sum(w) FILTER (sign = 'neg'), 0) AS tn FROM counts GROUP BY ALL
), cells AS (
  SELECT domain, ctx, token, coalesce(sum(w) FILTER (sign = 'pos'), 0) AS cp, coalesce(sum(w) FILTER (sign = 'neg'), 0) AS cn FROM counts GROUP BY ALL
), grid AS (
  SELECT t.domain, t.ctx, v.token, c.token IS NOT NULL AS seen, (0.1::DOUBLE + coalesce(cp, 0)) / (v * 0.1::DOUBLE + tp) AS p_pos, (0.1::DOUBLE + coalesce(cn, 0)) / (v * 0.1::DOUBLE + tn) AS p_neg
  FROM totals t JOIN size USING (domain) JOIN (SELECT DISTINCT domain, token FROM model_vocab) v USING (domain) LEFT JOIN cells c ON c.domain = t.domain AND c.ctx = t.ctx AND c.token = v.token
), scored AS (
  SELECT *, p_pos * pow(p_neg + 1e-12, -1) AS score FROM grid
)
"""

_ENCODED = _SEQS + """
, medoid AS (
  SELECT cluster_key, arg_min(tokens, seq_id) AS medoid FROM m WHERE is_medoid GROUP BY ALL
), pair AS (
  SELECT m.domain, seq_id, tokens, medoid, list_distinct(list_concat(tokens, medoid)) AS names FROM m JOIN medoid USING (cluster_key)
), measured AS (
  SELECT domain, seq_id, greatest(len(tokens), len(medoid)) AS longest,
    levenshtein(array_to_string([chr(32 + list_position(names, x)::INT) FOR x IN tokens], ''), array_to_string([chr(32 + list_position(names, x)::INT) FOR x IN medoid], '')) AS d
  FROM pair
)
"""

_CENTERS = """
, sized AS (
  SELECT domain, cluster_key, count(*) AS n, arg_min(tokens, seq_id) FILTER (is_medoid) AS tokens FROM m GROUP BY ALL HAVING count(*) FILTER (is_medoid) > 0
), center AS (
  SELECT domain, tokens, row_number() OVER (PARTITION BY domain ORDER BY n DESC, cluster_key) - 1 AS place FROM sized QUALIFY place < 8
)
"""

_MEDOIDS = """
, sized AS (
  SELECT domain, cluster_key, count(*) AS n, arg_min(tokens, seq_id) FILTER (is_medoid) AS tokens FROM m GROUP BY ALL HAVING count(*) FILTER (is_medoid) > 0
), medoid AS (
  SELECT domain, cluster_key, tokens, row_number() OVER (PARTITION BY domain ORDER BY n DESC, cluster_key) - 1 AS place FROM sized
)
"""

_REPLACED = _JUDGED + """
, medoid AS (
  SELECT cluster_key, arg_min({'seq_id': seq_id, 'tokens': tokens, 'valid': valid, 'reason': reason, 'bad': bad_idx}, seq_id) AS x FROM judged WHERE is_medoid GROUP BY ALL
), other AS (
  SELECT j.*, x, row_number() OVER (PARTITION BY cluster_key ORDER BY CASE WHEN len(x.bad) = 0 OR len([i FOR i IN x.bad IF i >= len(j.tokens) OR j.tokens[i + 1] <> x.tokens[i + 1]]) > 0 THEN 1 ELSE 2 END, coalesce(distance, 'inf'::DOUBLE), j.seq_id) AS rank
  FROM judged j JOIN medoid USING (cluster_key) WHERE NOT x.valid AND j.seq_id <> x.seq_id
), best AS (
  SELECT cluster_key, count(*) AS n, min(rank) FILTER (valid) AS tries, arg_min(tokens, rank) FILTER (valid) AS tokens FROM other GROUP BY ALL
), replaced AS (
  SELECT cluster_key, CASE WHEN x.valid THEN 'valid_medoid' WHEN tries <= 99 THEN 'replaced' ELSE 'unusable' END AS status,
    CASE WHEN x.valid THEN x.tokens WHEN tries <= 99 THEN tokens END AS final,
    CASE WHEN x.valid THEN 1 WHEN tries <= 99 THEN 1 + tries ELSE 1 + least(99, coalesce(n, 0) * CASE WHEN len(x.bad) = 0 THEN 2 ELSE 1 END) END AS attempts,
    x.valid AS original_valid, CASE WHEN NOT x.valid THEN x.reason END AS reason
  FROM medoid LEFT JOIN best USING (cluster_key)
)
"""

_AGENT = f"""
WITH u AS (
  SELECT DISTINCT row_id, {_key("user_id")} AS user, email, membership, reservations, loaded_at FROM agent_users
), r AS (
  SELECT DISTINCT *, {_key("user_id")} AS user, {_key("reservation_id")} AS reservation FROM agent_reservations
), links AS (
  SELECT DISTINCT user, {_key("x")} AS link FROM (SELECT user, unnest(reservations) AS x FROM u)
)
"""

_ACTIONS = f"WITH a AS (SELECT DISTINCT *, {_name('name')} AS step FROM eval_actions)"

_CRITERIA = """
WITH c AS (
  SELECT row_id, task_id, created_at, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(j->>'$') THEN (j->>'$')::JSON ELSE j END AS j
  FROM (SELECT DISTINCT row_id, task_id, created_at, evaluation_criteria::JSON AS j FROM tasks WHERE json_valid(evaluation_criteria))
), a AS (
  SELECT row_id, task_id, unnest(range(len(l))) AS pos, unnest(l) AS a FROM (SELECT row_id, task_id, (j->'$.actions')::JSON[] AS l FROM c WHERE json_type(j->'$.actions') = 'ARRAY')
)
"""

#: Weighted edit distance of the lists a and b of a row, in hundredths: rows of the table of a dynamic program, step by step. A
#: step is a struct of its token, effective type and group.
_STEPS = """
, kinds AS (
  SELECT domain, token, CASE WHEN coalesce(action_type, 'GENERIC') = 'GENERIC' THEN 'READ' ELSE action_type END AS kind FROM (SELECT DISTINCT domain, token, action_type FROM model_vocab)
), maps AS (
  SELECT domain, map_from_entries(list({'key': token, 'value': kind})) AS kinds FROM kinds GROUP BY ALL
), typed AS (
  SELECT s.*, [{'t': x, 'k': coalesce(kinds[x], 'READ'), 'g': split_part(x, '_', 1)} FOR x IN tokens] AS steps FROM (SELECT DISTINCT domain, tokens FROM m) s LEFT JOIN maps USING (domain)
)
"""


def _weighted(pairs: str) -> str:
    """CTE `measured`: pairs (..., a, b) of lists of steps with d, their distance in hundredths."""
    cost = "CASE WHEN x.t = y.t THEN 0 WHEN x.k = y.k AND x.g = y.g THEN 33 WHEN x.k = y.k THEN 66 ELSE 100 END"
    return f"""
, pairs AS (SELECT row_number() OVER () AS pair, * FROM ({pairs})
), grown AS (
  WITH RECURSIVE g(pair, step, line) AS (
    SELECT pair, 0, [100 * j FOR j IN range(len(b) + 1)] FROM pairs
    UNION ALL
    SELECT g.pair, step + 1, list_reduce([{{'up': line[j + 1], 'diagonal': line[j], 'y': b[j]}} FOR j IN range(1, len(b) + 1)], lambda acc, c: list_append(acc, least(c.up + 100, acc[-1] + 100, c.diagonal + list_transform([{{'x': a[step + 1], 'y': c.y}}], lambda q: {cost.replace("x.", "q.x.").replace("y.", "q.y.")})[1])), [100 * (step + 1)])
    FROM g JOIN pairs USING (pair) WHERE step < len(a)
  ) SELECT pair, line[-1] AS d FROM g JOIN pairs USING (pair) WHERE step = len(a)
), measured AS (SELECT * FROM pairs JOIN grown USING (pair))
"""


SQL |= {
    "weighted_distances": _SEQS
    + """, medoid AS (
  SELECT cluster_key, arg_min(tokens, seq_id) AS medoid FROM m WHERE is_medoid GROUP BY ALL
)"""
    + _STEPS
    + _weighted("SELECT DISTINCT m.domain, m.tokens, medoid, x.steps AS a, y.steps AS b FROM m JOIN medoid USING (cluster_key) JOIN typed x ON x.domain = m.domain AND x.tokens = m.tokens JOIN typed y ON y.domain = m.domain AND y.tokens = medoid")
    + "SELECT m.domain, seq_id, round(d / 100, 2) AS distance FROM m JOIN medoid USING (cluster_key) JOIN measured w ON w.domain = m.domain AND w.tokens = m.tokens AND w.medoid = medoid.medoid",
    "weighted_medoid_pairs": _SEQS + _MEDOIDS + _STEPS + _weighted("SELECT p.domain, p.place AS i, q.place AS j, x.steps AS a, y.steps AS b FROM medoid p JOIN medoid q ON p.domain = q.domain AND p.place < q.place JOIN typed x ON x.domain = p.domain AND x.tokens = p.tokens JOIN typed y ON y.domain = q.domain AND y.tokens = q.tokens") + "SELECT domain, i, j, round(d / 100, 2) AS distance FROM measured",
    "best_medoids": _SEQS
    + """, one AS (SELECT domain, cluster_key, tokens, count(*) AS w, min(seq_id) AS seq_id FROM m WHERE cluster_key IS NOT NULL GROUP BY ALL)"""
    + _STEPS
    + _weighted("SELECT DISTINCT p.domain, p.tokens AS ta, q.tokens AS tb, x.steps AS a, y.steps AS b FROM one p JOIN one q ON p.cluster_key = q.cluster_key AND p.tokens < q.tokens JOIN typed x ON x.domain = p.domain AND x.tokens = p.tokens JOIN typed y ON y.domain = q.domain AND y.tokens = q.tokens")
    + """, cost AS (
  SELECT p.cluster_key, p.seq_id, round(coalesce(sum(d * q.w), 0) / 100, 2) AS cost FROM one p LEFT JOIN one q ON p.cluster_key = q.cluster_key AND p.tokens <> q.tokens
  LEFT JOIN measured w ON w.domain = p.domain AND w.ta = least(p.tokens, q.tokens) AND w.tb = greatest(p.tokens, q.tokens) GROUP BY ALL
)
SELECT cluster_key, seq_id, cost FROM cost QUALIFY row_number() OVER (PARTITION BY cluster_key ORDER BY cost, seq_id) = 1""",
    "accepted_pool": _SEQS + "SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY f.t, f.s) - 1 AS idx, array_to_string(tokens, '>') AS tokens FROM (SELECT domain, tokens, min({'t': t, 's': seq_id}) AS f FROM acc GROUP BY ALL) QUALIFY idx < 2000",
    "seq_tokens": _SEQS + "SELECT domain, seq_id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM m",
    "seed_sequences": _CRITERIA + "SELECT c.row_id, c.task_id, coalesce((SELECT string_agg(a->>'$.name', '>' ORDER BY pos) FROM a WHERE a.row_id = c.row_id AND a->>'$.name' IS NOT NULL), '') AS tokens FROM c WHERE json_type(j->'$.actions') = 'ARRAY'",
    "seq_length_stats": _SEQS + "SELECT domain, count(*) AS n, round(median(len(tokens)), 6) AS median, round(stddev_pop(len(tokens)), 6) AS std, greatest(1, min(len(tokens))) AS low, max(len(tokens)) AS high, round(greatest(greatest(1, min(len(tokens))), quantile_cont(len(tokens), 0.1)), 6) AS p10, round(least(max(len(tokens)), quantile_cont(len(tokens), 0.9)), 6) AS p90 FROM m GROUP BY ALL",
    "length_histogram": _SEQS + "SELECT domain, len(tokens)::VARCHAR AS length, count(*) AS k FROM m GROUP BY ALL",
    "ngram_counts": _GRAMS + "SELECT * FROM counts",
    "context_totals": _GRAMS + "SELECT domain, sign, ctx, sum(w) AS total FROM counts GROUP BY ALL",
    "seen_scores": _GRAMS + "SELECT domain, ctx, token, round(p_pos, 7) AS p_pos, round(p_neg, 7) AS p_neg, round(score, 7) AS score FROM scored WHERE seen",
    "top_continuation": _GRAMS + "SELECT domain, ctx, token, round(score, 7) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY domain, ctx ORDER BY round(score, 7) DESC, token) = 1",
    "temperature_schedule": "SELECT DISTINCT t, round(1 + 2 * exp(-t / 1500.0), 9) AS temperature FROM sampler_accepted",
    "window_acceptance": _SEQS + _verdict("acc", "judged") + "SELECT domain, (t - 1) // 400 AS \"window\", min(t) AS first_t, max(t) AS last_t, count(*) AS attempted, count(*) FILTER (valid) AS accepted, count(*) FILTER (NOT valid) AS rejected, round(count(*) FILTER (valid) / count(*), 6) AS acceptance_rate FROM judged GROUP BY ALL",
    "write_fractions": _SEQS + """, types AS (
  SELECT domain, list(token) FILTER (action_type = 'WRITE') AS writes, list(token) FILTER (coalesce(action_type, 'GENERIC') IN ('WRITE', 'GENERIC')) AS fine FROM model_vocab GROUP BY ALL
)
SELECT m.domain, seq_id, CASE WHEN len(tokens) = 0 THEN 0 ELSE round(len([x FOR x IN tokens IF list_contains(writes, x)]) / len(tokens), 9) END AS write_fraction, len([x FOR x IN tokens IF NOT list_contains(fine, x)]) = 0 AS only_writes FROM m LEFT JOIN types USING (domain)""",
    "token_classes": "SELECT domain, token, coalesce(action_type, 'GENERIC') AS type, CASE coalesce(action_type, 'GENERIC') WHEN 'GENERIC' THEN 'READ' ELSE action_type END AS effective_type, split_part(token, '_', 1) AS action_group FROM model_vocab",
    "rubric_verdicts": _JUDGED + "SELECT domain, seq_id, valid, reason, array_to_string(bad_idx, ',') AS bad_idx FROM judged",
    "ordering_rules": _SEQS + """, p AS (
  SELECT domain, seq_id, len(tokens) AS n,
    [i FOR i IN range(len(tokens)) IF tokens[i + 1] = 'transfer_to_human_agents'] AS transfer,
    [i FOR i IN range(len(tokens)) IF tokens[i + 1] IN ('find_user_id_by_email', 'find_user_id_by_name_zip')] AS auth,
    list_position(tokens, 'get_user_details') AS details, list_position(tokens, 'cancel_reservation') AS cancel,
    [i FOR i IN range(len(tokens)) IF tokens[i + 1] = 'get_order_details'] AS lookups,
    [i FOR i IN range(len(tokens)) IF tokens[i + 1] = 'return_delivered_order_items'] AS returns,
    [i FOR i IN range(len(tokens)) IF tokens[i + 1] = 'exchange_delivered_order_items'] AS exchanges,
    [i FOR i IN range(len(tokens)) IF tokens[i + 1] = 'resume_line'] AS resumes, list_position(tokens, 'reboot_device') AS reboot
  FROM m
), two AS (
  SELECT DISTINCT domain, seq_id FROM (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT domain, seq_id, lookups, a, unnest(exchanges) AS b FROM (SELECT domain, seq_id, lookups, exchanges, unnest(returns) AS a FROM p)))
  WHERE len([x FOR x IN lookups IF x > lo AND x < hi]) = 0
)
SELECT domain, seq_id, '0:only_last' AS rule FROM p WHERE len([i FOR i IN transfer IF i <> n - 1]) > 0
UNION ALL SELECT domain, seq_id, '1:first_block' FROM p WHERE len(auth) > 0 AND list_max(auth) <> len(auth) - 1
UNION ALL SELECT domain, seq_id, '2:before' FROM p WHERE cancel > 0 AND (coalesce(details, 0) = 0 OR cancel < details)
UNION ALL SELECT domain, seq_id, '3:between' FROM two
UNION ALL SELECT domain, seq_id, '4:not_after' FROM p WHERE reboot > 0 AND list_max(resumes) > reboot - 1""",
    "duplicate_status": _JUDGED + "SELECT domain, seq_id, CASE WHEN tokens IN (SELECT tokens FROM acc) THEN 'accepted_dup' WHEN tokens IN (SELECT tokens FROM judged WHERE is_medoid AND NOT valid) THEN 'rejected_dup' ELSE 'new' END AS status FROM m",
    "edit_distances": _ENCODED + "SELECT domain, seq_id, d AS distance, CASE WHEN longest = 0 THEN 0 ELSE round(d / longest, 9) END AS normalized FROM measured",
    "nearest_center": _SEQS + _CENTERS + """, pair AS (
  SELECT m.domain, seq_id, place, m.tokens AS a, c.tokens AS b, list_distinct(list_concat(m.tokens, c.tokens)) AS names FROM m JOIN center c USING (domain)
), measured AS (
  SELECT domain, seq_id, place, CASE WHEN greatest(len(a), len(b)) = 0 THEN 0 ELSE levenshtein(array_to_string([chr(32 + list_position(names, x)::INT) FOR x IN a], ''), array_to_string([chr(32 + list_position(names, x)::INT) FOR x IN b], '')) / greatest(len(a), len(b)) END AS d FROM pair
)
SELECT domain, seq_id, round(min(d), 9) AS min_distance, arg_min(place, d * 1000000 + place) AS nearest, round(avg(d), 9) AS mean_distance FROM measured GROUP BY ALL""",
    "medoid_pairs": _SEQS + _MEDOIDS + """
SELECT domain, i, j, levenshtein(array_to_string([chr(32 + list_position(names, x)::INT) FOR x IN a], ''), array_to_string([chr(32 + list_position(names, x)::INT) FOR x IN b], ''))::DOUBLE AS distance
FROM (SELECT x.domain, x.place AS i, y.place AS j, x.tokens AS a, y.tokens AS b, list_distinct(list_concat(x.tokens, y.tokens)) AS names FROM medoid x JOIN medoid y ON x.domain = y.domain AND x.place < y.place)""",
    "nearest_medoid": _SEQS + _MEDOIDS + """, pair AS (
  SELECT m.domain, seq_id, place, medoid.cluster_key, m.tokens AS a, medoid.tokens AS b, list_distinct(list_concat(m.tokens, medoid.tokens)) AS names FROM m JOIN medoid ON m.domain = medoid.domain
), measured AS (
  SELECT domain, seq_id, place, cluster_key, CASE WHEN greatest(len(a), len(b)) = 0 THEN 0 ELSE levenshtein(array_to_string([chr(32 + list_position(names, x)::INT) FOR x IN a], ''), array_to_string([chr(32 + list_position(names, x)::INT) FOR x IN b], '')) / greatest(len(a), len(b)) END AS d FROM pair
)
SELECT domain, seq_id, round(min(d), 9) AS min_distance, arg_min(place, d * 1000000 + place) AS nearest, arg_min(cluster_key, d * 1000000 + place) AS nearest_cluster, round(avg(d), 9) AS mean_distance FROM measured GROUP BY domain, seq_id""",
    "cluster_sizes": _SEQS + "SELECT domain, count(*) AS n_clusters, min(size) AS min_size, max(size) AS max_size, round(avg(size), 6) AS mean_size, median(size) AS median_size FROM (SELECT domain, cluster_key, count(*) AS size FROM m GROUP BY ALL) GROUP BY ALL",
    "medoid_replacement": _REPLACED + "SELECT cluster_key, status, array_to_string(final, '>') AS final_sequence, attempts, original_valid, reason FROM replaced",
    "validation_status": _REPLACED + "SELECT status, count(*) AS n, sum(attempts) AS attempts FROM replaced GROUP BY ALL",
    "merged_validation": _REPLACED + "SELECT i.*, r.status, r.attempts FROM (SELECT DISTINCT cluster_key, domain, status AS listed_status, n_members FROM cluster_info) i LEFT JOIN replaced r USING (cluster_key)",
    "first_valid_member": _JUDGED + "SELECT cluster_key, seq_id FROM judged QUALIFY row_number() OVER (PARTITION BY cluster_key ORDER BY NOT valid, coalesce(distance, 'inf'::DOUBLE), seq_id) = 1",
    "pending_clusters": _JUDGED + "SELECT DISTINCT cluster_key, domain, status FROM cluster_info i WHERE status IN ('valid_medoid', 'replaced') AND NOT EXISTS (FROM judged j WHERE j.cluster_key = i.cluster_key AND valid)",
    "write_summary": _REPLACED + ", each AS (SELECT domain, unnest(final) AS token FROM replaced JOIN (SELECT DISTINCT cluster_key, domain FROM m) USING (cluster_key)) SELECT domain, count(*) AS total_actions, count(*) FILTER (action_type = 'WRITE') AS write_actions, round(count(*) FILTER (action_type = 'WRITE') / count(*), 6) AS write_share FROM each LEFT JOIN model_vocab USING (domain, token) GROUP BY ALL",
    "missing_users": _AGENT + "SELECT row_id, user FROM r WHERE user IS NOT NULL AND user NOT IN (SELECT user FROM u WHERE user IS NOT NULL)",
    "unlisted_reservations": _AGENT + "SELECT row_id, user, reservation FROM r WHERE user IN (SELECT user FROM u) AND NOT EXISTS (FROM links l WHERE l.user = r.user AND l.link = r.reservation)",
    "users_over_limit": _AGENT + "SELECT user, count(*) FILTER (cabin = 'business') AS n FROM r GROUP BY ALL HAVING n > 3",
    "reused_flights": _AGENT + f"SELECT row_id, flight, count(*) AS n FROM (SELECT row_id, {_key('l.flight_number')} AS flight FROM (SELECT row_id, unnest(flights) AS l FROM r)) WHERE flight IS NOT NULL GROUP BY ALL HAVING n > 1",
    "ambiguous_flights": f"WITH f AS (SELECT DISTINCT origin, destination, unnest(map_keys(dates)) AS date, {_key('flight_number')} AS flight FROM agent_flights WHERE origin IS NOT NULL AND destination IS NOT NULL) SELECT origin, destination, date, min(flight) AS flight, array_to_string(list_sort(list(flight))[2:], ',') AS others FROM f GROUP BY ALL HAVING count(*) > 1",
    "rule_chain": _AGENT + """, v AS (
  SELECT row_id, 0 AS o, 'shape' AS rule, 'no flights' AS message FROM r WHERE coalesce(len(flights), 0) < 1
  UNION ALL SELECT row_id, 1, 'references', 'unknown user ' || user FROM r WHERE user IS NOT NULL AND user NOT IN (SELECT user FROM u WHERE user IS NOT NULL)
  UNION ALL SELECT row_id, 1, 'references', 'missing required argument user_id' FROM r WHERE coalesce(user, '') = ''
)
SELECT row_id, rule, message, CASE WHEN rule = 'references' AND NOT contains(message, 'missing required argument') THEN 'db_only' ELSE 'task_and_db' END AS patch FROM v QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY o, rule, message) = 1""",
    "merged_users": _AGENT + "SELECT user, arg_max(email, (loaded_at, row_id)) FILTER (email IS NOT NULL) AS email, arg_max(membership, (loaded_at, row_id)) FILTER (membership IS NOT NULL) AS membership FROM u GROUP BY ALL",
    "merged_reservation_lists": _AGENT + "SELECT user, string_agg(x, ',' ORDER BY a, p, x) AS reservations FROM (SELECT user, x, min({'a': loaded_at, 'p': p}).a AS a, min({'a': loaded_at, 'p': p}).p AS p FROM (SELECT user, loaded_at, unnest(range(len(reservations))) AS p, unnest(reservations) AS x FROM u) WHERE x IS NOT NULL GROUP BY ALL) GROUP BY ALL",
    "back_links": _AGENT + "SELECT user, coalesce(string_agg(link, ',' ORDER BY link), '') AS links FROM (SELECT DISTINCT user FROM u) LEFT JOIN (SELECT user, link FROM links WHERE link IS NOT NULL UNION SELECT user, reservation FROM r WHERE reservation IS NOT NULL) USING (user) GROUP BY ALL",
    "flight_dates": "SELECT DISTINCT row_id, e.key AS date, e.value.status AS status, e.value.available_seats AS available_seats FROM (SELECT row_id, unnest(map_entries(dates)) AS e FROM agent_flights)",
    "follow_ups": _ACTIONS + """, t AS (SELECT * FROM a WHERE domain = 'telecom'), n AS (
  SELECT *, lead(CASE WHEN step LIKE 'check\\_%' ESCAPE '\\' OR step = 'reboot_device' THEN step = 'reboot_device' END IGNORE NULLS) OVER (PARTITION BY task_id, trial ORDER BY position) AS nxt FROM t
)
SELECT row_id, task_id, trial, position FROM n WHERE step = 'resume_line' AND NOT coalesce(nxt, false)""",
    "redacted_arguments": _ACTIONS + "SELECT domain, trial, task_id, count(*) AS n, CASE WHEN count(*) FILTER (requestor = 'assistant') = 0 THEN 0 ELSE greatest(1, floor(count(*) FILTER (requestor = 'assistant') * 0.33))::BIGINT END AS n_covered FROM a GROUP BY ALL",
    "argument_parse_stages": _ACTIONS + "SELECT row_id, CASE WHEN arguments IS NULL THEN NULL WHEN json_valid(arguments) THEN 1 WHEN json_valid(regexp_replace(arguments, ',(\\s*[\\]}])', '\\1', 'g')) THEN 2 ELSE 0 END AS stage FROM a",
    "task_actions": _CRITERIA + "SELECT row_id, pos, coalesce(a->>'$.action_id', pos::VARCHAR) AS action_id, coalesce(a->>'$.name', a->>'$.tool_name', a->>'$.action_name') AS name, coalesce(a->>'$.requestor', 'assistant') AS requestor, CASE WHEN json_type(a->'$.info') = 'VARCHAR' THEN a->>'$.info' END AS info FROM a WHERE json_type(a) = 'OBJECT'",
    "task_changes": """WITH r AS (
  SELECT task_id, created_at, row_id, max(evaluation_criteria) AS doc FROM tasks GROUP BY ALL
), o AS (
  SELECT task_id, row_id, doc AS new, lag(doc) OVER w AS old FROM r WINDOW w AS (PARTITION BY task_id ORDER BY created_at, row_id) QUALIFY row_number() OVER w > 1
), leaf AS (
  SELECT task_id, row_id, side, replace(t.fullkey, '"', '') AS path, t.value::VARCHAR AS value
  FROM (SELECT task_id, row_id, 'old' AS side, old::JSON AS doc FROM o WHERE json_valid(old) UNION ALL SELECT task_id, row_id, 'new', new::JSON FROM o WHERE json_valid(new)) d, json_tree(d.doc) t
  WHERE t.type NOT IN ('OBJECT', 'ARRAY') OR t.value::VARCHAR IN ('{}', '[]')
)
SELECT task_id, row_id, path, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' ELSE 'changed' END AS change, a.value AS old_value, b.value AS new_value
FROM (FROM leaf WHERE side = 'old') a FULL JOIN (FROM leaf WHERE side = 'new') b USING (task_id, row_id, path) WHERE a.value IS DISTINCT FROM b.value""",
    "trial_mismatches": _ACTIONS + """, t AS (
  SELECT task_id, trial FROM a WHERE trial > 0 UNION SELECT task_id, 1 FROM a WHERE trial = 0
), e AS (
  SELECT a.task_id, t.trial, a.position, a.step FROM a JOIN t ON a.task_id IS NOT DISTINCT FROM t.task_id WHERE a.trial = 0
)
SELECT task_id, trial, position, e.step AS expected, x.step AS actual FROM e FULL JOIN (FROM a WHERE trial > 0) x USING (task_id, trial, position) WHERE e.step IS DISTINCT FROM x.step""",
    "stream_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}


def _opened(x: str) -> str:
    """A JSON value, or the content of a string that holds JSON, three times over; broken JSON is null."""
    for _ in range(3):
        x = f"(SELECT CASE WHEN json_type(_o) = 'VARCHAR' AND regexp_matches(_o->>'$', '^\\s*[\\[{{\"]') THEN CASE WHEN json_valid(_o->>'$') THEN (_o->>'$')::JSON END ELSE _o END FROM (SELECT {x} AS _o))"
    return x


def _elements(name: str, collections: str) -> str:
    """CTEs that give the records (row_id, tab, parent, key, v) of collections (row_id, tab, own, parent, v)."""
    return f"""
, {name}_c AS (
  SELECT row_number() OVER () AS id, * FROM ({collections}) WHERE json_type(v) IN ('OBJECT', 'ARRAY')
), {name}_e AS (
  SELECT c.* EXCLUDE (v), json_type(c.v) AS kind, c.v AS whole, j.key, {_opened("j.value")} AS v FROM {name}_c c, json_each(c.v) AS j
), {name}_s AS (
  SELECT *, bool_and(coalesce(json_type(v), 'NULL') IN ('OBJECT', 'NULL')) OVER (PARTITION BY id) AS named FROM {name}_e
), {name} AS (
  SELECT row_id, tab, parent, CASE WHEN kind = 'ARRAY' THEN coalesce(nullif(v->>own, ''), key::VARCHAR) ELSE key::VARCHAR END AS key, v FROM {name}_s WHERE json_type(v) = 'OBJECT' AND (kind = 'ARRAY' OR named)
  UNION ALL SELECT DISTINCT row_id, tab, parent, '0', whole FROM {name}_s WHERE kind = 'OBJECT' AND NOT named
)"""


_TOP = "users user, reservations reservation, flights flight, orders order, products product, customers customer, lines line, bills bill, devices device, plans plan"
_BELOW = "user payment_methods payment_method, customer payment_methods payment_method, reservation flights leg, reservation passengers passenger, flight dates flight_date, order items order_item, product variants variant, bill line_items bill_item"
_OWN = {"user": "user_id", "reservation": "reservation_id", "flight": "flight_number", "order": "order_id", "product": "product_id", "customer": "customer_id", "line": "line_id", "bill": "bill_id", "device": "device_id", "plan": "plan_id"}


def _children() -> str:
    top = " UNION ALL ".join(f"SELECT row_id, '{t}' AS tab, '$.{_OWN[t]}' AS own, '' AS parent, {_opened(f'agent->{c!r}')} AS v FROM agent" for c, t in (x.split() for x in _TOP.split(", ")))
    below = " UNION ALL ".join(f"SELECT row_id, '{t}' AS tab, '$.-' AS own, key AS parent, {_opened(f'v->{c!r}')} AS v FROM top WHERE tab = '{p}'" for p, c, t in (x.split() for x in _BELOW.split(", ")))
    more = " UNION ALL ".join(f"SELECT row_id, '{t}' AS tab, '$.-' AS own, key AS parent, {_opened(_opened('v->' + repr('arguments')) + f'->{c!r}')} AS v FROM act" for c, t in (("flights", "action_leg"), ("payment_methods", "action_payment")))
    return (
        f"""WITH doc AS (
  SELECT DISTINCT row_id, {_opened(_opened("CASE WHEN json_valid(initial_state) THEN initial_state::JSON END") + "->'initialization_data'")} AS init, {_opened("CASE WHEN json_valid(evaluation_criteria) THEN evaluation_criteria::JSON END")} AS crit FROM tasks
), agent AS (SELECT row_id, {_opened("init->'agent_data'")} AS agent FROM doc), device AS (SELECT row_id, {_opened(_opened("init->'user_data'") + "->'device'")} AS device FROM doc)"""
        + _elements("top", top)
        + _elements("below", below)
        + _elements("app", f"SELECT row_id, 'app_status' AS tab, '$.app_name' AS own, 'device' AS parent, {_opened('device->' + repr('app_statuses'))} AS v FROM device")
        + _elements("act", f"SELECT row_id, 'action' AS tab, '$.-' AS own, '' AS parent, {_opened('crit->' + repr('actions'))} AS v FROM doc")
        + _elements("more", more)
        + """, record AS (FROM top UNION ALL FROM below UNION ALL FROM app UNION ALL FROM act UNION ALL FROM more
), attribute AS (
  SELECT DISTINCT row_id, tab AS child_table, parent AS parent_key, key AS child_key, name, v->>'$' AS value
  FROM (SELECT r.row_id, r.tab, r.parent, r.key, a.key AS name, """
        + _opened("a.value")
        + """ AS v FROM record r, json_each(r.v) a) WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL')
)
"""
    )


CHILDREN = _children()

#: The change log of records, replayed in three spans of time: of each record the version loaded last rules, and gives its
#: own existence and its references unless it is deleted.
_LOG = (
    _ORPHANS
    + f""", own AS (
  SELECT 'agent_users' AS tab, CASE WHEN regexp_matches(user_id, '[0-9]') THEN {_key("user_id")} ELSE '#' || row_id END AS k, row_id, loaded_at, deleted_at FROM agent_users
  UNION SELECT 'agent_flights', CASE WHEN regexp_matches(flight_number, '[0-9]') THEN {_key("flight_number")} ELSE '#' || row_id END, row_id, loaded_at, deleted_at FROM agent_flights
  UNION SELECT 'agent_reservations', CASE WHEN regexp_matches(reservation_id, '[0-9]') THEN {_key("reservation_id")} ELSE '#' || row_id END, row_id, loaded_at, deleted_at FROM agent_reservations
), told AS (
  SELECT DISTINCT src_row_id, ref_field, ref_key, seen_at FROM refs WHERE src_table = 'eval_actions' AND regexp_matches(ref_key, '[0-9]') AND seen_at IS NOT NULL
), ends AS (
  SELECT min(epoch_us(t)) AS lo, max(epoch_us(t)) - min(epoch_us(t)) + 1 AS span FROM (SELECT loaded_at AS t FROM own UNION ALL SELECT seen_at FROM told)
), ruling AS (
  SELECT b.range AS batch, tab, k, row_id, deleted_at IS NULL AS live FROM own, ends, range(3) b WHERE (epoch_us(loaded_at) - lo) * 3 // span <= b.range
  QUALIFY row_number() OVER (PARTITION BY b.range, tab, k ORDER BY loaded_at DESC, row_id DESC) = 1
), asked AS (
  SELECT DISTINCT batch, tab, k, ref_field, ref_key FROM ruling JOIN refs ON src_table = tab AND src_row_id = row_id WHERE live AND regexp_matches(ref_key, '[0-9]')
  UNION ALL SELECT b.range, 'eval_actions', src_row_id::VARCHAR, ref_field, ref_key FROM told, ends, range(3) b WHERE (epoch_us(seen_at) - lo) * 3 // span <= b.range
), report AS (
  SELECT batch, CASE ref_field WHEN 'user_id' THEN 'agent_users' WHEN 'reservation_id' THEN 'agent_reservations' ELSE 'agent_flights' END AS target, ref_key, count(*) AS refs FROM asked a
  WHERE NOT EXISTS (FROM ruling r WHERE r.live AND r.batch = a.batch AND r.k = a.ref_key AND r.tab = CASE a.ref_field WHEN 'user_id' THEN 'agent_users' WHEN 'reservation_id' THEN 'agent_reservations' ELSE 'agent_flights' END)
  GROUP BY ALL
)
"""
)

SQL |= {
    "p3_found": CHILDREN + "SELECT DISTINCT row_id, tab AS child_table, parent AS parent_key, key AS child_key FROM record",
    "p3_attributes": CHILDREN + "SELECT * FROM attribute",
    "p1_current": _LOG + "SELECT target, ref_key, refs FROM report WHERE batch = 2",
    "p1_folds": _LOG + "SELECT batch, target, ref_key, refs FROM report",
}
