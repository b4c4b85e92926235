"""DuckDB SQL with the results of the registered queries.

Statements are put together from common table expressions by name; each names what it needs.
"""

from __future__ import annotations

from foretrace.functions import text

_PARTS: dict[str, tuple[str, tuple[str, ...]]] = {}
ORACLES: dict[str, str] = {}


def part(name: str, sql: str, *needs: str) -> None:
    _PARTS[name] = (sql, needs)


def oracle(name: str, sql: str, *needs: str, replaced: dict[str, str] | None = None) -> None:
    """Register ``sql`` with the parts it needs; ``replaced`` renames needed parts to other ones."""
    order: list[str] = []

    def add(n: str) -> None:
        if n not in order:
            for m in _PARTS[(replaced or {}).get(n, n)][1]:
                add(m)
            order.append(n)

    for n in needs:
        add(n)
    parts = ",\n".join(f"{n} AS ({_PARTS[(replaced or {}).get(n, n)][0]})" for n in order)
    ORACLES[name] = f"WITH {parts}\n{sql}" if parts else sql


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


J = "array_to_string({}, ' > ')".format

part("log", "SELECT CAST(o_custkey AS VARCHAR) AS case_id, o_orderpriority AS activity, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, o_orderkey AS key, o_totalprice AS price FROM orders")
part("traces", "SELECT case_id, list(activity ORDER BY pos) AS trace FROM log GROUP BY case_id", "log")
part("samples", "SELECT case_id, CAST(pos AS INTEGER) AS pos, trace[1:pos - 1] AS prefix, trace[pos] AS next, list_sort(list_distinct(trace)) AS unique_activities FROM (SELECT case_id, trace, unnest(range(2, len(trace) + 1)) AS pos FROM traces)", "traces")
part("pfx", "SELECT DISTINCT prefix FROM samples", "samples")
part("raw", """SELECT CAST(case_id AS BIGINT) * 1000 + pos AS row_ord, case_id, pos, prefix,
    CASE WHEN (CAST(case_id AS BIGINT) * 1000 + pos) % 13 = 0 THEN list_append(unique_activities, 'None') ELSE unique_activities END AS acts,
    CASE WHEN pos % 7 = 0 THEN '[END]' WHEN pos % 11 = 0 THEN 'END' ELSE next END AS next FROM samples""", "samples")
part("clean", "SELECT * FROM raw WHERE next NOT IN ('[END]', 'END', '<END>', 'None', '') AND NOT list_contains(acts, 'None')", "raw")
part("pairs", "SELECT case_id, lag(activity) OVER w AS prev, activity AS next, key, price, pos FROM log WINDOW w AS (PARTITION BY case_id ORDER BY pos) QUALIFY pos > 1", "log")
part("labelled", "SELECT p.*, CASE WHEN price > (SELECT avg(price) FROM pairs) THEN 1 ELSE 0 END AS y FROM pairs p", "pairs")
part("guard_counts", "SELECT prev, next, count(*) AS tot, CAST(sum(y) AS BIGINT) AS pos FROM labelled GROUP BY prev, next", "labelled")
part("allowed", "SELECT prev, next, score, prev_total FROM (SELECT *, pos / tot AS score, sum(tot) OVER (PARTITION BY prev) AS prev_total FROM guard_counts) WHERE score >= 0.5", "guard_counts")
part("edge_counts", "SELECT src, dst, cnt, cnt / sum(cnt) OVER (PARTITION BY src) AS prob FROM (SELECT trace[i] AS src, trace[i + 1] AS dst, count(*) AS cnt FROM (SELECT trace, unnest(range(1, len(trace))) AS i FROM traces) GROUP BY ALL)", "traces")
part("grams", "SELECT trace[i - o:i - 1] AS context, trace[i] AS next, count(*) AS c FROM (SELECT trace, unnest(range(1, len(trace) + 1)) AS i FROM traces), (VALUES (1), (2)) t(o) WHERE i - o >= 1 GROUP BY ALL", "traces")
part("markov", "SELECT context, next, c, c / sum(c) OVER (PARTITION BY context) AS prob FROM grams", "grams")
part("markov3", "SELECT * FROM (SELECT context, next, c, c / sum(c) OVER (PARTITION BY context) AS prob FROM grams) WHERE c >= 3", "grams")
part("tree", "SELECT trace[1:i - 1] AS prefix, trace[i] AS next, count(*) AS c FROM (SELECT trace, unnest(range(1, len(trace) + 1)) AS i FROM traces) GROUP BY ALL", "traces")
part("backed", """SELECT p.prefix, m.next AS activity, m.prob FROM (
    SELECT p.prefix, coalesce(c2.context, c1.context) AS context FROM pfx p
    LEFT JOIN (SELECT DISTINCT context FROM markov) c2 ON len(p.prefix) >= 2 AND c2.context = p.prefix[len(p.prefix) - 1:len(p.prefix)]
    LEFT JOIN (SELECT DISTINCT context FROM markov) c1 ON len(p.prefix) >= 1 AND c1.context = p.prefix[len(p.prefix):len(p.prefix)]) p
    JOIN markov m ON m.context = p.context""", "pfx", "markov")
part("tree5", "SELECT prefix, next AS activity, c / sum(c) OVER (PARTITION BY prefix) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY c DESC, next) AS rn FROM tree) WHERE rn <= 5", "tree")
part("mixed", "SELECT coalesce(m.prefix, t.prefix) AS prefix, coalesce(m.activity, t.activity) AS activity, 0.5::DOUBLE * coalesce(m.prob, 0.0) + 0.5::DOUBLE * coalesce(t.prob, 0.0) AS score FROM backed m FULL JOIN (SELECT t.* FROM tree5 t JOIN pfx p ON p.prefix = t.prefix) t ON t.prefix = m.prefix AND t.activity = m.activity", "backed", "tree5")
part("cands", "SELECT prefix, rk, activity, score / sum(score) OVER (PARTITION BY prefix) AS score FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, activity) AS rk FROM mixed) WHERE rk <= 5", "mixed")
part("prev_cands", "SELECT *, CASE WHEN len(prefix) > 0 THEN prefix[len(prefix)] END AS prev FROM cands", "cands")
part("soft", "SELECT c.prefix, c.prev, c.activity, row_number() OVER (PARTITION BY c.prefix ORDER BY c.score + 0.5::DOUBLE * coalesce(e.prob, 0.0) DESC, c.rk) AS rk, c.score + 0.5::DOUBLE * coalesce(e.prob, 0.0) AS score FROM prev_cands c LEFT JOIN edge_counts e ON e.src = c.prev AND e.dst = c.activity", "prev_cands", "edge_counts")
part("prior_rows", "SELECT prefix, next FROM samples", "samples")
part("pair_w", "SELECT prev, next, c, c / sum(c) OVER (PARTITION BY prev) AS w FROM (SELECT prefix[len(prefix)] AS prev, next, count(*) AS c FROM prior_rows WHERE len(prefix) > 0 GROUP BY ALL)", "prior_rows")
part("act_w", "SELECT next AS activity, count(*) / (SELECT count(*) FROM samples) AS w FROM samples GROUP BY next", "samples")

# ------------------------------------------------------------------ sources and parsing

oracle("load_snap", f"SELECT row_ord, case_id AS model_id, CAST(pos AS VARCHAR) AS revision_id, {J('acts')} AS activities, {J('prefix')} AS prefix, next FROM clean", "clean")
part("raw_text", "SELECT *, '[' || array_to_string(list_transform(prefix, lambda x: '''' || x || ''''), ', ') || ']' AS prefix_text FROM raw", "raw")
oracle("load_instructions", f"SELECT row_ord, {J('acts')} AS activities, 'What follows ' || prefix_text || '?' AS instruction, CASE WHEN row_ord % 5 <> 0 THEN next END AS output FROM raw_text", "raw_text")


def split_sql(source: str, name: str, test: float = 0.2, val: float = 0.1) -> str:
    return f"SELECT gid, CASE WHEN r <= round_even({test} * n, 0) THEN 'test' WHEN r <= round_even({test} * n, 0) + round_even({val} * n, 0) THEN 'val' ELSE 'train' END AS {name} FROM (SELECT gid, row_number() OVER (ORDER BY md5('42|' || gid), gid) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT gid FROM {source}))"


part("clean_ids", "SELECT case_id || '_' || CAST(pos AS VARCHAR) AS gid, * FROM clean", "clean")
part("clean_split", split_sql("clean_ids", "split"), "clean_ids")
oracle("load_task", f"SELECT c.row_ord, {J('c.acts')} AS activities, {J('c.prefix')} AS prefix, c.next, s.split FROM clean_ids c JOIN clean_split s ON s.gid = c.gid WHERE len(c.acts) >= 4", "clean_ids", "clean_split")
oracle("load_data", f"SELECT row_ord, 'snap' AS kind, {J('acts')} AS activities FROM clean UNION ALL SELECT row_ord, 'instructions', {J('acts')} FROM raw", "clean", "raw")
part("cases", "SELECT case_id AS gid, trace FROM traces", "traces")
part("case_split", split_sql("cases", "split"), "cases")
part("case_resplit", split_sql("cases", "split", 0.3, 0.2), "cases")
oracle("split_saved_twice", "SELECT a.gid AS group_id, a.split, b.split AS second FROM case_split a JOIN case_resplit b ON b.gid = a.gid", "case_split", "case_resplit")
oracle("required_columns", "SELECT row_ord, unnest(['both', 'none']) AS asked FROM raw", "raw")
oracle("column_values", "SELECT next, count(*) AS n FROM raw GROUP BY next", "raw")
oracle("preprocess", f"SELECT row_ord, {J('acts')} AS activities, next, 0 AS prefix_len, 0 AS trace_len FROM clean", "clean")
oracle("eval_samples", f"SELECT case_id || '-' || CAST(pos AS VARCHAR) AS case_id, {J('prefix')} AS prefix, next AS y_true FROM samples", "samples")
oracle("prior_json_roundtrip", "SELECT prev, next, round(w, 9) AS w FROM pair_w", "pair_w")
oracle("parse_list", f"""SELECT row_ord, CASE WHEN row_ord % 3 = 0 THEN {J('acts')}
    WHEN row_ord % 3 = 1 THEN {J("list_transform(prefix, lambda x, i: (CASE WHEN i = 1 THEN '[' ELSE '' END) || x || (CASE WHEN i = len(prefix) THEN ']' ELSE '' END))")}
    ELSE {J('prefix')} END AS items FROM raw""", "raw")
oracle("parse_pairs", "SELECT key, CASE WHEN key % 2 = 0 THEN prev || '/' || next || ' > ' || next || '/' || prev ELSE prev || '/' || next END AS pairs FROM pairs", "pairs")
oracle("parse_prefix", f"SELECT case_id, pos, {J('prefix')} AS prefix FROM samples", "samples")
oracle("drop_end_tokens", f"SELECT case_id, pos, {J('list_filter(prefix, lambda x, i: NOT ((i - 1) % 3 = 1 OR (i - 1) % 5 = 2))')} AS prefix FROM samples", "samples")
oracle("resolve_columns", "SELECT row_ord, case_id AS model_id, CAST(pos AS VARCHAR) AS revision_id, prefix_text AS prefix, next FROM raw_text", "raw_text")
part("hashed", "SELECT case_id, pos, substr(md5(array_to_string(list_sort(list_distinct(list_append(prefix, next))), '|')), 1, 10) AS hash, substr(md5(array_to_string(unique_activities, '|')), 1, 10) AS whole FROM samples", "samples")
oracle("activity_hash", "SELECT case_id, pos, hash FROM hashed", "hashed")
oracle("ensure_model_id", "SELECT CAST(case_id AS BIGINT) * 1000 + pos AS row_ord, case_id AS model_id FROM hashed UNION ALL SELECT -CAST(case_id AS BIGINT) * 1000 - pos, whole FROM hashed", "hashed")
oracle("group_id", "SELECT row_ord, 0 AS form, case_id || '_' || CAST(pos AS VARCHAR) AS group_id FROM raw UNION ALL SELECT row_ord, 1, case_id FROM raw UNION ALL SELECT row_ord, 2, CAST(row_ord AS VARCHAR) FROM raw", "raw")
part("first_seen", "SELECT case_id, pos, list(x ORDER BY i) AS acts FROM (SELECT case_id, pos, x, min(i) AS i FROM (SELECT case_id, pos, unnest(prefix) AS x, generate_subscripts(prefix, 1) AS i FROM samples) GROUP BY ALL) GROUP BY ALL", "samples")
oracle("standardize", f"SELECT s.case_id, s.pos, {J('f.acts')} AS activities, CASE WHEN s.pos % 2 = 0 THEN {J('s.prefix')} ELSE '' END AS prefix, 0 AS trace_len FROM samples s JOIN first_seen f ON f.case_id = s.case_id AND f.pos = s.pos", "first_seen")
oracle("pseudo_traces", f"SELECT case_id, pos, CASE WHEN pos % 4 <> 0 THEN {J('list_append(prefix, next)')} ELSE next END AS trace FROM samples", "samples")
part("dialogue", "SELECT CAST(u.conv_id AS VARCHAR) || '-' || CAST(u.turn AS VARCHAR) AS case_id, u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'")
oracle("eval_case_rows", r"SELECT case_id, CASE WHEN turn % 4 = 0 OR turn % 6 = 2 OR lower(trim(answer)) IN ('', 'nan') THEN NULL ELSE regexp_replace(answer, '^\s+|\s+$', '', 'g') END AS gold_explanation FROM dialogue", "dialogue")

# ------------------------------------------------------------------ text

WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}_]+')".format
SENTENCES = r"string_split(regexp_replace({}, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1))".format
oracle("tokenize", f"SELECT conv_id, turn, array_to_string({WORDS('text')}, ' ') AS tokens FROM conversations")
oracle("split_sentences", f"SELECT conv_id, turn, CASE WHEN text = '' THEN '' ELSE array_to_string({SENTENCES('text')}, '|') END AS sentences FROM conversations")
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')".format
part("answers", f"SELECT *, {STRIP('answer')} AS bare FROM dialogue", "dialogue")
part("shortened", f"SELECT *, {STRIP('substr(array_to_string(list_filter(' + SENTENCES('bare') + '[1:2], lambda s: length(trim(s)) > 0), chr(32)), 1, 600)')} AS explanation FROM answers", "answers")
oracle("normalize_explanation", "SELECT case_id, explanation FROM shortened", "shortened")
PASSES = f"len(list_filter({SENTENCES('{0}')}, lambda s: length(trim(s)) > 0)) BETWEEN 1 AND 3"
oracle("reason_pass", f"SELECT conv_id, turn, {PASSES.format('text')} AS reason_pass FROM conversations")


def template(source: str, **values: str) -> str:
    out = quoted(source)
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


BRACES = "'{{ ' || array_to_string({}, ', ') || ' }}'".format
PATH = "array_to_string({}, ' -> ')".format
oracle("prediction_prompts", f"SELECT case_id, pos, {template(text.PREDICTION_TEMPLATE, candidates=BRACES('unique_activities'), prefix=PATH('prefix'))} AS prompt FROM samples", "samples")
explained = f"CASE WHEN pos % 5 = 0 THEN '<EMPTY_PREFIX>' ELSE {PATH('prefix')} END"
oracle("explanation_prompts", f"SELECT case_id, pos, {template(text.EXPLANATION_TEMPLATE, candidates=BRACES('unique_activities'), prefix=explained, chosen_label='next')} AS prompt FROM samples", "samples")
oracle("parse_label", "SELECT case_id, pos, CASE WHEN pos % 4 IN (0, 1) THEN next ELSE unique_activities[1] END AS label FROM samples", "samples")
oracle("synthetic_reverse", f"SELECT case_id, pos, {J('list_reverse(prefix)')} AS prefix FROM samples", "samples")
oracle("prompt_catalog", f"SELECT case_id, pos, CASE WHEN pos % 2 = 0 THEN 'snap_predict_strict_v1' ELSE 'snap_explain_reasonable_v1' END AS id, CASE WHEN pos % 2 = 0 THEN {len(text.PREDICTION_TEMPLATE)} ELSE {len(text.EXPLANATION_TEMPLATE)} END AS length FROM samples", "samples")

# ------------------------------------------------------------------ filters, limits, sampling

oracle("drop_end_labels", "SELECT row_ord, next FROM raw WHERE next NOT IN ('[END]', 'END', '<END>', 'None', '')", "raw")
oracle("drop_invalid_sets", f"SELECT row_ord, {J('acts')} AS activities FROM raw WHERE NOT list_contains(acts, 'None')", "raw")
oracle("invert_labels", "SELECT doc_id, CASE WHEN quality = 1 THEN 0 ELSE 1 END AS label FROM labels")
oracle("head_limit", "SELECT row_ord, next FROM raw ORDER BY row_ord LIMIT 500", "raw")
oracle("positional_split", "SELECT row_ord, CASE WHEN r <= floor(0.8 * n) THEN 'first' ELSE 'rest' END AS part FROM (SELECT row_ord, row_number() OVER (ORDER BY row_ord) AS r, count(*) OVER () AS n FROM raw)", "raw")
oracle("dedup_first", "SELECT row_ord, prefix_text AS prefix, next FROM raw_text QUALIFY row_number() OVER (PARTITION BY prefix_text ORDER BY row_ord) = 1", "raw_text")
oracle("activity_vocab", "SELECT DISTINCT activity FROM log ORDER BY activity", "log")
part("anomalies", "SELECT CAST(case_id AS BIGINT) AS id, trace, CASE WHEN len(trace) > 10 THEN 'False' ELSE 'True' END AS ds_labels FROM traces", "traces")
oracle("oversample_label", f"SELECT id, {J('trace')} AS trace, ds_labels FROM anomalies UNION ALL SELECT id, {J('trace')}, ds_labels FROM anomalies, range(2) WHERE ds_labels = 'False'", "anomalies")
oracle("sample_label", "SELECT id, ds_labels FROM anomalies WHERE ds_labels = 'True' ORDER BY md5('42|' || CAST(id AS VARCHAR)), id LIMIT 200", "anomalies")
oracle("column_stats", "SELECT round(avg(o_totalprice), 6) AS mean, round(median(o_totalprice), 6) AS median, round(min(o_totalprice), 6) AS min, round(max(o_totalprice), 6) AS max, round(stddev_samp(o_totalprice), 6) AS std FROM orders")

# ------------------------------------------------------------------ splits

part("daily", "SELECT CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y-%m-%d') AS gid, event_type, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS pos FROM events")
part("daily_samples", "SELECT gid, pos, event_type AS next FROM daily WHERE pos >= 2", "daily")
part("daily_split", split_sql("daily_samples", "split"), "daily_samples")
oracle("group_split_ids", "SELECT gid AS group_id, split FROM daily_split", "daily_split")
oracle("group_split_rows", "SELECT d.gid AS group_id, CAST(d.pos AS INTEGER) AS pos, d.next, s.split FROM daily_samples d JOIN daily_split s ON s.gid = d.gid", "daily_samples", "daily_split")
part("sample_ids", "SELECT case_id AS gid, * FROM samples", "samples")
part("sample_split", split_sql("sample_ids", "split"), "sample_ids")
part("bucketed", """SELECT s.split, x.gid, CASE WHEN len(unique_activities) <= 1 THEN '≤1' WHEN len(unique_activities) <= 4 THEN '2–4' WHEN len(unique_activities) <= 7 THEN '5–7' WHEN len(unique_activities) <= 10 THEN '8–10' ELSE '≥11' END AS a,
    CASE WHEN len(prefix) <= 2 THEN '≤2' WHEN len(prefix) <= 5 THEN '3–5' WHEN len(prefix) <= 8 THEN '6–8' ELSE '≥9' END AS b FROM sample_ids x JOIN sample_split s ON s.gid = x.gid""", "sample_ids", "sample_split")
oracle("bucket_report", """SELECT f.split, f.dimension, f.bucket, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (
    SELECT split, dimension, bucket FROM (VALUES ('train'), ('val'), ('test')) s(split), (SELECT 'process_size' AS dimension, unnest(['≤1', '2–4', '5–7', '8–10', '≥11']) AS bucket UNION ALL SELECT 'prefix_len', unnest(['≤2', '3–5', '6–8', '≥9']))) f
    LEFT JOIN (SELECT split, 'process_size' AS dimension, a AS bucket, count(*) AS n FROM bucketed GROUP BY ALL UNION ALL SELECT split, 'prefix_len', b, count(*) FROM bucketed GROUP BY ALL) c ON c.split = f.split AND c.dimension = f.dimension AND c.bucket = f.bucket""", "bucketed")

part("case_sizes", """SELECT s.split, CASE WHEN len(list_distinct(trace)) <= 1 THEN '≤1' WHEN len(list_distinct(trace)) <= 4 THEN '2–4' WHEN len(list_distinct(trace)) <= 7 THEN '5–7' WHEN len(list_distinct(trace)) <= 10 THEN '8–10' ELSE '≥11' END AS a,
    CASE WHEN len(trace) <= 3 THEN '≤3' WHEN len(trace) <= 7 THEN '4–7' WHEN len(trace) <= 10 THEN '8–10' ELSE '≥11' END AS b FROM cases c JOIN case_split s ON s.gid = c.gid""", "cases", "case_split")
oracle("trace_length_report", """SELECT f.split, f.dimension, f.bucket, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (
    SELECT split, dimension, bucket FROM (VALUES ('train'), ('val'), ('test')) s(split), (SELECT 'process_size' AS dimension, unnest(['≤1', '2–4', '5–7', '8–10', '≥11']) AS bucket UNION ALL SELECT 'trace_len', unnest(['≤3', '4–7', '8–10', '≥11']))) f
    LEFT JOIN (SELECT split, 'process_size' AS dimension, a AS bucket, count(*) AS n FROM case_sizes GROUP BY ALL UNION ALL SELECT split, 'trace_len', b, count(*) FROM case_sizes GROUP BY ALL) c ON c.split = f.split AND c.dimension = f.dimension AND c.bucket = f.bucket""", "case_sizes")

# ------------------------------------------------------------------ models

oracle("markov_model", f"SELECT {J('context')} AS context, next, c, round(prob, 9) AS prob FROM markov WHERE c >= 2", "markov")
oracle("prefix_tree_counts", f"SELECT {J('prefix')} AS prefix, next, c FROM tree", "tree")
oracle("prefix_tree_topk", f"SELECT {J('prefix')} AS prefix, next, c, round(c / sum(c) OVER (PARTITION BY prefix), 9) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY c DESC, next) AS rn FROM tree) WHERE rn <= 3", "tree")
oracle("markov_backoff", f"SELECT {J('prefix')} AS prefix, activity AS next, round(prob, 9) AS prob FROM backed", "backed", replaced={"markov": "markov3"})
part("grams5", "SELECT trace[i - o:i - 1] AS context, trace[i] AS next, count(*) AS c FROM (SELECT trace, unnest(range(1, len(trace) + 1)) AS i FROM traces), (VALUES (1), (2), (3), (4), (5)) t(o) WHERE i - o >= 1 GROUP BY ALL", "traces")
part("markov5", "SELECT * FROM (SELECT context, next, c / sum(c) OVER (PARTITION BY context) AS prob, c FROM grams5) WHERE c >= 3", "grams5")
part("suffixes", "SELECT p.prefix, max(o) AS o FROM pfx p, (VALUES (1), (2), (3), (4), (5)) t(o) WHERE o <= len(p.prefix) AND EXISTS (SELECT 1 FROM markov5 m WHERE m.context = p.prefix[len(p.prefix) - o + 1:len(p.prefix)]) GROUP BY p.prefix", "pfx", "markov5")
oracle("markov_backoff_5", f"SELECT {J('s.prefix')} AS prefix, m.next, round(m.prob, 9) AS prob FROM suffixes s JOIN markov5 m ON m.context = s.prefix[len(s.prefix) - s.o + 1:len(s.prefix)]", "suffixes", "markov5")
oracle("dfg_edges", "SELECT src, dst, cnt, round(prob, 9) AS prob FROM edge_counts WHERE cnt >= 2 AND prob >= 0.05", "edge_counts")
oracle("dfg_lookup", "SELECT s.case_id, s.pos, round(coalesce(e.prob, 0.0), 9) AS prob, e.src IS NOT NULL OR s.pos % 6 = 0 AS allowed FROM samples s LEFT JOIN edge_counts e ON e.prob >= 0.2 AND s.pos % 6 <> 0 AND e.src = s.prefix[len(s.prefix)] AND e.dst = s.next", "samples", "edge_counts")
oracle("dfg_outgoing", "SELECT src, dst, round(prob, 9) AS prob FROM edge_counts", "edge_counts")
oracle("activity_prior", "SELECT activity, round(w, 9) AS w FROM act_w", "act_w")
oracle("pair_prior", "SELECT prev, next, c, round(c / sum(c) OVER (PARTITION BY prev), 9) AS w FROM pair_w WHERE c >= 3", "pair_w")
oracle("guard_pairs_labelled", "SELECT prev, next, tot, pos FROM guard_counts", "guard_counts")
oracle("guard_pairs_invariants", "SELECT prev, next, count(*) AS tot, CAST(sum(CASE WHEN key % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos FROM pairs WHERE key % 3 <> 2 AND key % 5 <> 0 GROUP BY prev, next", "pairs")
oracle("guard_allowed_pairs", "SELECT prev, next, round(score, 9) AS score, CAST(prev_total AS BIGINT) AS prev_total FROM (SELECT *, pos / tot AS score, sum(tot) OVER (PARTITION BY prev) AS prev_total FROM guard_counts) WHERE tot >= 2 AND tot / prev_total >= 0.1 AND score >= 0.45", "guard_counts")
oracle("guard_check", "SELECT s.case_id, s.pos, s.pos % 6 = 0 OR a.prev IS NOT NULL AS ok FROM samples s LEFT JOIN allowed a ON a.prev = s.prefix[len(s.prefix)] AND a.next = s.next", "samples", "allowed")

# ------------------------------------------------------------------ retrieval

part("memory", "SELECT row_ord AS ex_id, 'What follows ' || prefix_text || '?' AS instruction, next AS output, prefix, next, list_filter(acts, lambda a: a <> 'None') AS acts, case_id AS model_id, CAST(pos AS VARCHAR) AS revision_id FROM raw_text WHERE row_ord % 5 <> 0 AND len(prefix) >= 2", "raw_text")
oracle("example_memory", f"SELECT ex_id, instruction, output, {J('prefix')} AS prefix, next, {J('acts')} AS activities, model_id, revision_id FROM memory", "memory")
SIM = "0.7::DOUBLE * (CASE WHEN list_position(list_transform(list_zip({0}, {1}, true), lambda z: z[1] = z[2]), false) IS NULL THEN least(len({0}), len({1})) ELSE list_position(list_transform(list_zip({0}, {1}, true), lambda z: z[1] = z[2]), false) - 1 END) / greatest(len({0}), len({1})) + 0.3::DOUBLE * (len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))))".format
oracle("prefix_similarity", f"SELECT {J('q.prefix')} AS q, {J('e.prefix')} AS e, round({SIM('q.prefix', 'e.prefix')}, 9) AS sim FROM (SELECT DISTINCT prefix FROM samples WHERE CAST(case_id AS BIGINT) % 50 = 0) q JOIN pfx e ON len(list_intersect(q.prefix, e.prefix)) > 0", "pfx", "samples")
oracle("example_memory_sample", f"SELECT ex_id, next, {J('prefix')} AS prefix FROM memory ORDER BY md5('42|' || CAST(ex_id AS VARCHAR)), ex_id LIMIT 200", "memory")
part("sims", f"SELECT q, e, {SIM('q', 'e')} AS sim FROM (SELECT DISTINCT prefix AS q FROM samples), (SELECT DISTINCT prefix AS e FROM memory)", "samples", "memory")
#: Three examples of each example prefix are enough besides those of the query's own model.
part("near", "SELECT s.q, m.ex_id, s.sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, f) AS k FROM sims JOIN (SELECT prefix, min(ex_id) AS f FROM memory GROUP BY prefix) ON prefix = e) s JOIN (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY ex_id) AS j FROM memory) m ON m.prefix = s.e AND s.k <= 3 AND m.j <= 3", "sims", "memory")
part("offered", "SELECT case_id, pos, ex_id, max(score) AS score FROM (SELECT a.case_id, a.pos, n.ex_id, n.sim AS score FROM samples a JOIN near n ON n.q = a.prefix UNION ALL SELECT a.case_id, a.pos, m.ex_id, s.sim + 0.05::DOUBLE FROM samples a JOIN memory m ON m.model_id = a.case_id JOIN sims s ON s.q = a.prefix AND s.e = m.prefix) GROUP BY case_id, pos, ex_id", "samples", "memory", "near", "sims")
part("retrieved", "SELECT o.case_id, o.pos, m.ex_id, m.instruction, m.output, o.score, row_number() OVER (PARTITION BY o.case_id, o.pos ORDER BY o.score DESC, m.ex_id) AS place FROM offered o JOIN memory m ON m.ex_id = o.ex_id", "offered", "memory")
oracle("fewshot_topk", "SELECT case_id, pos, CAST(place AS INTEGER) AS place, ex_id, round(score, 9) AS score FROM retrieved WHERE place <= 3 AND score > 0", "retrieved")
part("shots", "SELECT case_id, pos, string_agg('Example ' || CAST(place AS VARCHAR) || ':' || chr(10) || instruction || chr(10) || 'Correct answer: ' || output, chr(10) || chr(10) ORDER BY place) AS block FROM retrieved WHERE place <= 2 AND score > 0 GROUP BY case_id, pos", "retrieved")
part("filled", f"SELECT a.case_id, a.pos, CASE WHEN s.block IS NULL THEN '' ELSE {quoted(text.FEWSHOT_INTRO)} || s.block || {quoted(text.FEWSHOT_OUTRO)} END || {template(text.PREDICTION_TEMPLATE, candidates=BRACES('list_sort(list_distinct(a.prefix))'), prefix=PATH('a.prefix'))} AS prompt FROM samples a LEFT JOIN shots s ON s.case_id = a.case_id AND s.pos = a.pos", "samples", "shots")
oracle("fewshot_prompts", "SELECT case_id, pos, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INTEGER) AS length FROM filled", "filled")

# ------------------------------------------------------------------ scoring

RANKED = f"{J('prefix')} AS prefix, CAST(rk AS INTEGER) AS rank, activity, round(score, 9) AS score"
oracle("ensemble_topk", f"SELECT {RANKED} FROM cands", "cands")
oracle("dfg_rerank_soft", f"SELECT 0 AS n_dropped, {RANKED} FROM soft", "soft")
part("hard", "SELECT c.prefix, c.activity, c.rk AS old, c.score + coalesce(e.prob, 0.0) AS score, coalesce(e.prob, 0.0) < 0.2 AS gone FROM prev_cands c LEFT JOIN edge_counts e ON e.src = c.prev AND e.dst = c.activity", "prev_cands", "edge_counts")
oracle("dfg_rerank_hard", f"SELECT n_dropped, {RANKED} FROM (SELECT *, row_number() OVER (PARTITION BY prefix, gone ORDER BY score DESC, old) AS rk, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) OVER (PARTITION BY prefix) AS INTEGER) AS n_dropped FROM hard) WHERE NOT gone", "hard")
part("barred", "SELECT c.prefix, c.activity, c.rk AS old, c.score, e.src IS NULL AND c.prev IS NOT NULL AS gone, coalesce(e.prob, 0.0) AS p FROM prev_cands c LEFT JOIN edge_counts e ON e.prob >= 0.2 AND e.src = c.prev AND e.dst = c.activity", "prev_cands", "edge_counts")
part("barred2", "SELECT *, bool_and(gone) OVER (PARTITION BY prefix) AS triggered FROM barred", "barred")
part("barred3", "SELECT prefix, activity, old, triggered, CASE WHEN triggered THEN score ELSE score + 0.3::DOUBLE * p END AS score FROM barred2 WHERE triggered OR NOT gone", "barred2")
oracle("graph_priors_reweight", f"SELECT triggered, {RANKED} FROM (SELECT *, CASE WHEN triggered THEN old ELSE row_number() OVER (PARTITION BY prefix ORDER BY score DESC, old) END AS rk FROM barred3)", "barred3")


def mix_sql(source: str, weight: str, share: str, joins: str) -> str:
    """Ranked candidates after mixing softmax scores with weights normalised per prefix."""
    return f"""SELECT prefix, prev, activity, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, old) AS rk, score FROM (
        SELECT prefix, prev, activity, rk AS old, (1 - {share}::DOUBLE) * (x / sum(x) OVER (PARTITION BY prefix)) + {share}::DOUBLE * ({weight}) AS score FROM (
            SELECT c.*, exp(c.score - max(c.score) OVER (PARTITION BY c.prefix)) AS x, pw.w AS pw, aw.w AS aw FROM {source} c {joins}))"""


def normal(weight: str) -> str:
    return f"{weight} / (CASE WHEN sum({weight}) OVER (PARTITION BY prefix) = 0 THEN 1 ELSE sum({weight}) OVER (PARTITION BY prefix) END)"


WEIGHT_JOINS = "LEFT JOIN pair_w pw ON pw.prev = c.prev AND pw.next = c.activity LEFT JOIN act_w aw ON aw.activity = c.activity"
PAIR, ACT = (normal(f"least(greatest(coalesce({w}, 0.1::DOUBLE), 0.0), 1.3::DOUBLE)") for w in ("pw", "aw"))
OWN = normal("coalesce(nullif(len(list_filter(prefix, lambda p: p = activity)), 0)::DOUBLE, 0.1::DOUBLE)")
for _name, _weight in {"prior_mix_pair": PAIR, "prior_mix_activity": ACT, "prior_mix_hybrid": f"0.5::DOUBLE * ({PAIR}) + 0.5::DOUBLE * ({ACT})", "prior_mix_provider": f"CASE WHEN len(prefix) % 2 = 1 THEN {OWN} ELSE {PAIR} END", "prior_mix_failing_provider": f"CASE WHEN len(prefix) % 2 = 1 AND len(prefix) % 3 <> 0 AND len(prefix) % 5 <> 0 THEN {OWN} ELSE {PAIR} END"}.items():
    oracle(_name, f"SELECT {RANKED} FROM ({mix_sql('prev_cands', _weight, '0.4', WEIGHT_JOINS)})", "prev_cands", "pair_w", "act_w")

part("checked", "SELECT c.prefix, c.activity, c.rk AS old, c.score, a.prev IS NULL AND c.prev IS NOT NULL AS blocked FROM prev_cands c LEFT JOIN allowed a ON a.prev = c.prev AND a.next = c.activity", "prev_cands", "allowed")
BLOCKED = "CAST(sum(CASE WHEN blocked THEN 1 ELSE 0 END) OVER (PARTITION BY prefix) AS INTEGER) AS n_blocked"
oracle("guard_soft", f"SELECT n_blocked, {RANKED} FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, old) AS rk FROM (SELECT prefix, activity, old, score * CASE WHEN blocked THEN 0.5 ELSE 1.0 END AS score, {BLOCKED} FROM checked))", "checked")
oracle("guard_hard", f"SELECT n_blocked, {RANKED} FROM (SELECT *, {BLOCKED}, row_number() OVER (PARTITION BY prefix, blocked ORDER BY score DESC, old) AS rk FROM checked) WHERE NOT blocked", "checked")
part("lp", f"SELECT prefix, {J('prefix')} AS case_id, rk, activity, score, -((length({J('prefix')}) * (rk - 1 + 3)) % 17) / 4 AS lp FROM cands", "cands")
part("lpn", "SELECT *, score + 0.3::DOUBLE * CASE WHEN max(lp) OVER p > min(lp) OVER p THEN (lp - min(lp) OVER p) / (max(lp) OVER p - min(lp) OVER p) ELSE 0.0 END AS final FROM lp WINDOW p AS (PARTITION BY prefix)", "lp")
oracle("logprob_fusion", "SELECT case_id AS prefix, arg_min(activity, rk) FILTER (a = 1) AS label, arg_min(activity, rk) FILTER (b = 1) AS best, round(max(final), 9) AS score FROM (SELECT *, rank() OVER (PARTITION BY case_id ORDER BY final DESC) AS a, rank() OVER (PARTITION BY case_id ORDER BY lp DESC) AS b FROM lpn) GROUP BY case_id", "lpn")

# ------------------------------------------------------------------ the whole pipeline: fit on train cases, predict test cases

part("all_traces", "SELECT case_id, case_id AS gid, list(activity ORDER BY pos) AS trace FROM log GROUP BY case_id", "log")
part("case_split", split_sql("all_traces", "split"), "all_traces")
part("train_traces", "SELECT a.case_id, a.trace FROM all_traces a JOIN case_split s ON s.gid = a.gid AND s.split = 'train'", "all_traces", "case_split")
part("test_samples", "SELECT case_id, CAST(pos AS INTEGER) AS pos, trace[1:pos - 1] AS prefix, trace[pos] AS next FROM (SELECT a.case_id, a.trace, unnest(range(2, len(a.trace) + 1)) AS pos FROM all_traces a JOIN case_split s ON s.gid = a.gid AND s.split = 'test')", "all_traces", "case_split")
part("train_rows", "SELECT trace[1:pos - 1] AS prefix, trace[pos] AS next FROM (SELECT trace, unnest(range(1, len(trace) + 1)) AS pos FROM traces)", "traces")
part("train_labelled", "SELECT p.*, CASE WHEN price > (SELECT avg(price) FROM pairs) THEN 1 ELSE 0 END AS y FROM pairs p JOIN case_split s ON s.gid = p.case_id AND s.split = 'train'", "pairs", "case_split")
part("no_act", "SELECT NULL::VARCHAR AS activity, NULL::DOUBLE AS w")
part("hybrid_mixed", mix_sql("soft", normal("least(greatest(coalesce(pw, 1.0::DOUBLE), 0.7::DOUBLE), 1.3::DOUBLE)"), "0.2", "LEFT JOIN pair_w pw ON pw.prev = c.prev AND pw.next = c.activity LEFT JOIN act_w aw ON aw.activity = c.activity"), "soft", "pair_w", "act_w")
part("hybrid_guarded", "SELECT prefix, activity, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, old) AS rk, score, blocked FROM (SELECT c.prefix, c.activity, c.rk AS old, a.prev IS NULL AND c.prev IS NOT NULL AS blocked, c.score * CASE WHEN a.prev IS NULL AND c.prev IS NOT NULL THEN 0.5 ELSE 1.0 END AS score FROM hybrid_mixed c LEFT JOIN allowed a ON a.prev = c.prev AND a.next = c.activity)", "hybrid_mixed", "allowed")
part("scored", "SELECT prefix, list(activity ORDER BY rk) AS ranked, arg_min(activity, rk) AS y_pred, arg_min(score, rk) AS top_score, CAST(count(*) FILTER (blocked) AS INTEGER) AS n_blocked FROM hybrid_guarded GROUP BY prefix", "hybrid_guarded")
part("predicted", "SELECT s.case_id, s.pos, s.next AS y_true, p.y_pred, coalesce(p.ranked, []) AS ranked, p.top_score, coalesce(p.n_blocked, 0) AS n_blocked, 1 + s.pos * 0.25 AS latency_ms, coalesce(list_position(p.ranked, s.next), 0) AS place FROM samples s LEFT JOIN scored p ON p.prefix = s.prefix", "samples", "scored")
HYBRID = {"traces": "train_traces", "samples": "test_samples", "prior_rows": "train_rows", "labelled": "train_labelled", "act_w": "no_act"}
oracle("hybrid_predict", f"SELECT case_id, pos, y_true, y_pred, {J('ranked')} AS ranked, round(top_score, 9) AS top_score, n_blocked FROM predicted", "predicted", replaced=HYBRID)

# ------------------------------------------------------------------ evaluation

part("f1", """SELECT label, tp, fp, fn, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM (
    SELECT label, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM (
    SELECT label, count(*) FILTER (y_true = label AND y_pred IS NOT DISTINCT FROM label) AS tp, count(*) FILTER (y_pred = label AND y_true <> label) AS fp, count(*) FILTER (y_true = label AND y_pred IS DISTINCT FROM label) AS fn
    FROM (SELECT y_true AS label FROM predicted UNION SELECT y_pred FROM predicted WHERE y_pred IS NOT NULL) l, predicted GROUP BY label))""", "predicted")
NDCG = "avg(CASE WHEN place BETWEEN 1 AND {0} THEN 1 / log2(place + 1) ELSE 0.0 END)".format
ACC = "avg(CASE WHEN place BETWEEN 1 AND {0} THEN 1.0 ELSE 0.0 END)".format
MRR = "avg(CASE WHEN place > 0 THEN 1 / place ELSE 0.0 END)"
HIT = "avg(CASE WHEN y_true IS NOT DISTINCT FROM y_pred THEN 1.0 ELSE 0.0 END)"
LATENCY = "round(avg({0}), 9) AS avg_ms, round(quantile_cont({0}, 0.5), 9) AS p50_ms, round(quantile_cont({0}, 0.9), 9) AS p90_ms, round(quantile_cont({0}, 0.95), 9) AS p95_ms".format
oracle("eval_accuracy", f"SELECT round({HIT}, 9) AS accuracy FROM predicted", "predicted", replaced=HYBRID)
oracle("eval_f1_by_label", "SELECT label, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f1", "f1", replaced=HYBRID)
oracle("eval_macro_f1", "SELECT round(avg(f1), 9) AS macro_f1 FROM f1", "f1", replaced=HYBRID)
oracle("eval_mrr_ndcg", f"SELECT round({MRR}, 9) AS mrr, round({NDCG(5)}, 9) AS ndcg FROM predicted", "predicted", replaced=HYBRID)
oracle("eval_at_k", "SELECT " + ", ".join(f"round({ACC(k)}, 9) AS acc_at_{k}, round({NDCG(k)}, 9) AS ndcg_at_{k}" for k in (1, 3, 5)) + f", round({MRR}, 9) AS mrr, (SELECT round(avg(f1), 9) FROM f1) AS macro_f1 FROM predicted", "predicted", "f1", replaced=HYBRID)
oracle("metric_record", f"SELECT {LATENCY('o_totalprice')} FROM orders")
oracle("latency_stats", f"SELECT {LATENCY('o_totalprice')} FROM orders")
part("statuses", "SELECT o_orderpriority AS model, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS metric, avg(o_totalprice) AS latency, CAST(count(*) AS DOUBLE) AS memory FROM orders GROUP BY 1")
oracle("cpr", "SELECT model, round(metric / (latency / 1000), 9) AS cpr FROM statuses", "statuses")
oracle("cpr_by_model", "SELECT model, round(CASE WHEN model < '4' THEN metric ELSE 0.0 END / (latency + memory), 9) AS cpr FROM statuses", "statuses")
part("explained", f"""SELECT s.explanation, {PASSES.format('s.answer')} AS ok, CASE WHEN s.turn % 3 = 0 THEN s.conv_id % 5 + 1 END AS human,
    list_distinct({WORDS('s.explanation')}) AS said, CASE WHEN s.conv_id % 4 <> 0 THEN list_distinct({WORDS('s.question')}) END AS meant FROM shortened s""", "shortened")
part("overlapped", "SELECT *, CASE WHEN len(said) > 0 AND len(meant) > 0 THEN len(list_intersect(said, meant)) END AS k FROM explained", "explained")
OVERLAP = "round(coalesce(avg(k / len(said)), 0.0), 9) AS overlap_precision, round(coalesce(avg(k / len(meant)), 0.0), 9) AS overlap_recall, round(coalesce(avg(CASE WHEN k IS NULL THEN NULL WHEN k > 0 THEN 2 * (k / len(said)) * (k / len(meant)) / (k / len(said) + k / len(meant)) ELSE 0.0 END), 0.0), 9) AS overlap_f1"
oracle("token_overlap", f"SELECT {OVERLAP} FROM overlapped", "overlapped")
SAME = "round(avg(CASE WHEN quality IS NOT DISTINCT FROM toxic THEN 1.0 ELSE 0.0 END), 9)"
oracle("consistency", f"SELECT {SAME} AS consistency FROM labels")
oracle("explain_summary", f"SELECT round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 9) AS reason_pass_rate, round(avg(length(explanation)), 9) AS avg_length, round(coalesce(avg(human), 0.0), 9) AS usefulness, {OVERLAP}, (SELECT {SAME} FROM labels) AS consistency FROM overlapped", "overlapped")
oracle("eval_report", f"SELECT count(*) AS n_samples, round({HIT}, 9) AS accuracy, round({MRR}, 9) AS mrr, round({NDCG(5)}, 9) AS ndcg, {LATENCY('latency_ms')}, (SELECT round(avg(f1), 9) FROM f1) AS macro_f1, round((SELECT avg(f1) FROM f1) / (avg(latency_ms) / 1000), 9) AS cpr FROM predicted", "predicted", "f1", replaced=HYBRID)
