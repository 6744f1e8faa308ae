"""Queries over the driver's tables, each beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions import arrays, text
from labelmill.operators import batches, mining, rules, scoring, splits, tracker
from labelmill.sources import adapters as a

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_R, _T, _M, _J = a.RECORDS_SQL, a.TRACES_SQL, a.META_SQL, a.JUDGED_SQL
_TEMPLATE = text.RETRIEVAL_TEMPLATE.replace("'", "''")
_OVERLAP = f"""(len(list_intersect(list_distinct(regexp_extract_all(lower('{_TEMPLATE}'), '[a-z]+')), list_distinct(regexp_extract_all(lower(l), '[a-z]+')))) / len(list_distinct(regexp_extract_all(lower('{_TEMPLATE}'), '[a-z]+'))))"""
_NO_INSTRUCTIONS = rules.NO_INSTRUCTIONS.replace("'", "''")
_ENDS = ", ".join("'" + e.replace("'", "''") + "'" for e in rules.SENTENCE_ENDS)
_RULED = f"""{_R}, s AS (SELECT *, trim(instruction_set, {_WS}) AS l, trim(prompt, {_WS}) AS p FROM records),
ruled AS (SELECT *, CASE WHEN length(l) < 10 THEN 'empty_or_short' WHEN regexp_matches(l, '{_NO_INSTRUCTIONS}') THEN 'no_instructions_response'
    WHEN {_OVERLAP} >= 0.75 THEN 'prompt_b_echo' WHEN contains(l, '<<<MESSAGE_START>>>') OR contains(l, '<<<MESSAGE_END>>>') THEN 'marker_leak'
    WHEN NOT contains(l, '- ') AND NOT contains(l, '* ') THEN 'no_bullets' WHEN length(l) >= 1945.6 AND l[-1] NOT IN ({_ENDS}) THEN 'truncated'
    WHEN length(p) < 25 OR len(regexp_extract_all(p, '\\S+')) < 5 THEN 'prompt_too_short' ELSE '' END AS rule FROM s)"""
_LEAK = " OR ".join(f"regexp_matches(instruction_set, '{p.replace('(?iu)', '(?i)')}')" for p in rules.TEMPLATE_LEAKS)
_REASONED = rf"""{_R}, b AS (SELECT *, regexp_extract_all(instruction_set, '(?m)^\s*(?:[-*+]|\d+[.)])\s+(.*?)\s*$', 1) AS bullets FROM records),
reasoned AS (SELECT *, len(bullets) AS n, CASE WHEN {_LEAK} THEN 'template_leak'
    WHEN len(bullets) >= 5 AND len(list_filter(bullets, lambda x: len(regexp_extract_all(x, '\S+')) <= 2)) >= 0.7 * len(bullets) THEN 'word_fragmentation'
    WHEN len(bullets) > 6 THEN 'over_cap (n=' || len(bullets) || ')' WHEN len(bullets) = 0 THEN 'no_bullets' ELSE 'kept' END AS reason FROM b)"""
_VERDICT = rf"""v AS (SELECT *, trim(coalesce(raw, ''), {_WS}) AS c FROM judged),
w AS (SELECT *, CASE WHEN contains(c, '</think>') THEN trim(regexp_extract(c, '(?s)^.*</think>(.*)$', 1), {_WS}) WHEN contains(c, '<think>') THEN NULL ELSE c END AS x FROM v),
u AS (SELECT *, upper(regexp_extract(x, '(?i)\b(YES|NO)\b', 1)) AS f FROM w),
parsed AS (SELECT *, CASE WHEN c = '' OR coalesce(x, '') = '' THEN NULL WHEN starts_with(upper(x), 'YES') THEN 'YES'
    WHEN starts_with(upper(x), 'NO') AND NOT regexp_matches(x[3:3], '[[:alpha:]]') THEN 'NO' WHEN f <> '' THEN f END AS verdict FROM u)"""
_UNITS = """unit_of AS (SELECT *, coalesce('g:' || paraphrase_group_id, 'r:' || id) AS unit FROM records),
units AS (SELECT unit, count(*) AS size, min(ord) AS first_ord, arg_min(source_dataset, ord) AS source_dataset FROM unit_of GROUP BY unit)"""
_SPLIT = f"""{_R}, {_UNITS},
ranked AS (SELECT *, sum(size) OVER (ORDER BY md5('42:' || unit), unit ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM units),
tested AS (SELECT sum(size) AS t FROM ranked WHERE before < greatest(1, floor(total * 0.1))),
placed AS (SELECT unit, CASE WHEN before < greatest(1, floor(total * 0.1)) THEN 'test' WHEN before - t < greatest(1, floor(total * 0.1)) THEN 'val' ELSE 'train' END AS split FROM ranked, tested),
split_records AS (SELECT r.*, split FROM unit_of r JOIN placed USING (unit))"""
_UPDATES = f"""{_T}, ups AS (SELECT step, record_id, avg(reward) AS v FROM traces GROUP BY ALL HAVING NOT bool_and(reward = 0)),
folded AS (SELECT record_id, list_reduce(list(v ORDER BY step), lambda acc, x: 0.3::DOUBLE * x + 0.7::DOUBLE * acc) AS ema, count(*) AS cnt FROM ups GROUP BY record_id)"""
_HARD = f"""{_T}, {_M}, means AS (SELECT record_id, avg(reward) AS mean_reward FROM traces WHERE NOT judge_error GROUP BY record_id),
pool AS (SELECT m.record_id, m.source, mean_reward, row_number() OVER (PARTITION BY source ORDER BY mean_reward IS NULL, mean_reward, m.record_id) AS rank
    FROM meta m LEFT JOIN means USING (record_id) WHERE mean_reward IS NULL OR mean_reward < 0.85),
caps AS (SELECT source, greatest(1, round_even(200.0 * count(*) / (SELECT count(*) FROM meta), 0)) AS cap FROM meta GROUP BY source),
hard AS (SELECT record_id, source, mean_reward, rank FROM pool JOIN caps USING (source) WHERE rank <= cap)"""
_GROUPS = f"""{_T}, g AS (SELECT *, count(*) OVER w AS n, avg(reward) OVER w AS m, stddev_pop(reward) OVER w AS s FROM traces WINDOW w AS (PARTITION BY step, record_id))"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _ruled(spark: SparkSession, d: str) -> DataFrame:
    return a.records(spark, d).withColumn("rule", rules.failed_rule(F.col("instruction_set"), F.col("prompt")))


def _reasoned(spark: SparkSession, d: str) -> DataFrame:
    return a.records(spark, d).withColumn("reason", rules.mask_reason(F.col("instruction_set")))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return a.judged(spark, d).withColumn("said", rules.verdict(F.col("raw"))).withColumn("judged", F.col("raw").isNotNull())


@query(f"WITH {_RULED} SELECT id, rule FROM ruled")
def q_rule_filter(spark, d):
    return _ruled(spark, d).select("id", "rule")


@query(f"""WITH {_RULED}, {_J}, {_VERDICT}, r AS (SELECT p.source_dataset AS source_file, rule, CASE WHEN rule = '' THEN verdict END AS verdict,
    rule = '' AND raw IS NOT NULL AND verdict IS NULL AS error FROM parsed p JOIN ruled USING (id))
SELECT source_file, count(*) AS total, count(*) FILTER (rule = '' AND NOT error AND coalesce(verdict, '') <> 'NO') AS kept, count(*) FILTER (rule <> '') AS rule_removed,
    count(*) FILTER (rule = '' AND NOT error AND verdict = 'NO') AS judge_removed, count(*) FILTER (rule = '' AND NOT error AND verdict = 'YES') AS judge_passed,
    count(*) FILTER (rule = '' AND NOT error AND verdict IS NULL) AS judge_skipped, count(*) FILTER (error) AS judge_error,
    round(100.0::DOUBLE * count(*) FILTER (rule = '' AND NOT error AND coalesce(verdict, '') <> 'NO') / count(*), 2) AS kept_pct
FROM r GROUP BY GROUPING SETS ((source_file), ())""")
def q_rule_stats(spark, d):
    rule = rules.failed_rule(F.col("instruction_set"), F.col("prompt"))
    rows = _judged(spark, d).withColumn("rule", rule)
    passed = F.col("rule") == ""
    rows = rows.select(F.col("source_dataset").alias("source_file"), "rule", F.when(passed, F.col("said.verdict")).alias("verdict"), (passed & F.col("judged") & F.col("said.verdict").isNull()).alias("error"))
    return mining.rule_statistics(rows)


@query(f"WITH {_R}, s AS (SELECT id, instruction_set AS l FROM records) SELECT id, round({_OVERLAP}, 6) AS overlap FROM s")
def q_echo_overlap(spark, d):
    return a.records(spark, d).select("id", F.round(text.echo_overlap(F.col("instruction_set"), F.lit(text.RETRIEVAL_TEMPLATE)), 6).alias("overlap"))


@query(f"WITH {_REASONED} SELECT id, n FROM reasoned")
def q_bullet_count(spark, d):
    return a.records(spark, d).select("id", F.size(text.mask_bullets(F.col("instruction_set"))).cast("long").alias("n"))


@query(f"WITH {_REASONED} SELECT source_dataset, reason, count(*) AS n FROM reasoned GROUP BY GROUPING SETS ((source_dataset, reason), (source_dataset), (reason), ())")
def q_mask_reasons(spark, d):
    return mining.reason_counts(_reasoned(spark, d))


@query(f"WITH {_REASONED} SELECT r.id, r.source_dataset FROM records r SEMI JOIN (SELECT id FROM reasoned WHERE reason = 'kept') USING (id)")
def q_mask_semi_join(spark, d):
    return splits.masked(a.records(spark, d), _reasoned(spark, d).where("reason = 'kept'").select("id")).select("id", "source_dataset")


@query(f"WITH {_R} SELECT 'doc-' || (doc_id + 7) AS id FROM documents WHERE 'doc-' || (doc_id + 7) NOT IN (SELECT id FROM records)")
def q_mask_orphans(spark, d):
    mask = a.table(spark, d, "documents").select(F.concat(F.lit("doc-"), (F.col("doc_id") + 7).cast("string")).alias("id"))
    return splits.orphans(mask, a.records(spark, d))


@query(rf"""WITH {_R}, {_J}, {_VERDICT} SELECT id, verdict, CASE WHEN c = '' THEN 'empty judge response' WHEN x IS NULL THEN 'judge output truncated inside thinking block'
    WHEN x = '' THEN 'no content after thinking block' WHEN starts_with(upper(x), 'YES') THEN trim(ltrim(x[4:], ' —-–:'), {_WS})
    WHEN starts_with(upper(x), 'NO') AND NOT regexp_matches(x[3:3], '[[:alpha:]]') THEN trim(ltrim(x[3:], ' —-–:'), {_WS})
    WHEN f <> '' THEN coalesce(nullif(trim(ltrim(regexp_replace(x, '(?is)^.*?\b(YES|NO)\b', ''), ' —-–:'), {_WS}), ''), trim(regexp_extract(x, '(?is)^(.*?)\b(YES|NO)\b', 1), {_WS}))
    ELSE 'ambiguous judge response: ' || x[1:200] END AS reason FROM parsed WHERE raw IS NOT NULL""")
def q_verdict_parse(spark, d):
    return _judged(spark, d).where("judged").select("id", "said.verdict", "said.reason")


@query(f"""WITH {_RULED}, {_J}, {_VERDICT} SELECT p.id, p.source_dataset, CASE WHEN rule <> '' THEN 'removed' WHEN raw IS NOT NULL AND verdict IS NULL THEN 'errors'
    WHEN verdict = 'NO' THEN 'removed' ELSE 'kept' END AS route, p.instruction_set[1:500] AS shown FROM parsed p JOIN ruled USING (id)""")
def q_three_way_route(spark, d):
    rows = _judged(spark, d).withColumn("rule", rules.failed_rule(F.col("instruction_set"), F.col("prompt")))
    return rows.select("id", "source_dataset", rules.judged_route(F.col("rule"), F.col("said.verdict"), F.col("judged")).alias("route"), F.substring("instruction_set", 1, 500).alias("shown"))


@query(f"WITH {_R}, {_UNITS} SELECT unit, size, first_ord FROM units")
def q_group_units(spark, d):
    return splits.units(a.records(spark, d)).select("unit", "size", "first_ord")


@query(f"WITH {_SPLIT} SELECT id, split FROM split_records")
def q_greedy_split(spark, d):
    return splits.split_records(a.records(spark, d)).select("id", "split")


@query(f"""WITH {_R}, {_UNITS}, ranked AS (SELECT *, sum(size) OVER (PARTITION BY source_dataset ORDER BY md5('42:' || unit), unit ROWS UNBOUNDED PRECEDING) - size AS before,
    greatest(1, floor(sum(size) OVER (PARTITION BY source_dataset) * 0.1)) AS target FROM units),
tested AS (SELECT source_dataset, sum(size) AS t FROM ranked WHERE before < target GROUP BY 1),
placed AS (SELECT unit, CASE WHEN before < target THEN 'test' WHEN before - t < target THEN 'val' ELSE 'train' END AS split FROM ranked JOIN tested USING (source_dataset))
SELECT id, split FROM unit_of JOIN placed USING (unit)""")
def q_stratified_split(spark, d):
    return splits.split_records(a.records(spark, d), stratify_by="source_dataset").select("id", "split")


@query(rf"""WITH {_SPLIT}, b AS (SELECT *, len(regexp_extract_all(instruction_set, '(?m)^\s*(?:[-*+]|\d+[.)])\s+(.*?)\s*$', 1)) AS n FROM split_records)
SELECT split, count(*) AS n FROM b WHERE n BETWEEN 1 AND 6 AND instruction_set <> '' GROUP BY split""")
def q_split_after_mask(spark, d):
    rows = a.records(spark, d)
    mask = rows.where(F.size(text.mask_bullets(F.col("instruction_set"))).between(1, 6)).select("id")
    return splits.split_then_mask(rows, mask).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_R}, x AS (SELECT *, 'doc-' || (ord // 2) AS rid, CASE WHEN ord % 10 = 0 THEN '' ELSE prompt END AS p, CASE WHEN ord % 20 = 0 THEN 'old' END AS old FROM records)
SELECT source_dataset, count(*) AS records, count(*) - count(DISTINCT rid) AS duplicate_ids,
    count(*) FILTER ((p = '' OR response = '' OR instruction_set = '') AND old IS NULL) AS bad_fields FROM x GROUP BY GROUPING SETS ((source_dataset), ())""")
def q_dataset_audit(spark, d):
    rows = a.records(spark, d).withColumn("id", F.concat(F.lit("doc-"), F.floor(F.col("ord") / 2).cast("string")))
    rows = rows.withColumn("prompt", F.when(F.col("ord") % 10 == 0, "").otherwise(F.col("prompt"))).withColumn("prompt_a", F.when(F.col("ord") % 20 == 0, "old"))
    return mining.audit(rows, ["id", "source_dataset", "prompt", "response", "instruction_set"], ["prompt_a"])


@query(f"WITH {_SPLIT} SELECT split, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY ord)) AS checksum FROM split_records GROUP BY split")
def q_id_checksum(spark, d):
    return mining.id_checksum(splits.split_records(a.records(spark, d)), ["split"])


@query("SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id")
def q_first_user_turn(spark, d):
    users = F.filter("messages", lambda m: m["role"] == "user")
    return a.turns(spark, d).select("conv_id", F.get(users, F.lit(0))["content"].alias("prompt")).where("prompt is not null")


@query("SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations GROUP BY conv_id HAVING arg_min(role, turn) = 'user'")
def q_leading_user_turn(spark, d):
    first = F.get("messages", F.lit(0))
    return a.turns(spark, d).where((F.size("messages") > 0) & (first["role"] == "user")).select("conv_id", first["content"].alias("prompt"))


@query(f"""SELECT source AS task_name, CASE WHEN x <> '' AND y <> '' THEN x || chr(10) || chr(10) || 'Input: ' || y ELSE x || y END AS prompt
FROM (SELECT source, trim(split_part(text, chr(10), 1), {_WS}) AS x, trim(split_part(text, chr(10), 2), {_WS}) AS y, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r = 1 AND (x <> '' OR y <> '')""")
def q_first_per_task(spark, d):
    rows = a.table(spark, d, "documents").select(F.col("source").alias("task_name"), "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("definition"), F.split_part("text", F.lit("\n"), F.lit(2)).alias("inputs"))
    from labelmill.sources.loaders import first_of_each_task

    return first_of_each_task(rows, "doc_id").select("task_name", "prompt")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
def q_per_source_cap(spark, d):
    return batches.first_rows(a.table(spark, d, "documents").select("source", "doc_id"), 5, ["doc_id"], ["source"])


@query(rf"""WITH {_R} SELECT id, len(regexp_extract_all(response, '\S+')) >= 20 AS long_enough, response <> '' AND instruction_set <> '' AND len(regexp_extract_all(response, '\S+')) >= 20
    AND length(instruction_set) >= 80 AND NOT contains(lower(instruction_set), 'help with a task') AS valid FROM records""")
def q_response_gate(spark, d):
    return a.records(spark, d).select("id", rules.response_gate(F.col("response")).alias("long_enough"), rules.valid_record(F.col("response"), F.col("instruction_set")).alias("valid"))


@query("SELECT doc_id, sha256('run-1|' || source || '|' || doc_id)[1:32] AS id, md5(source || doc_id) AS group_id FROM documents")
def q_stable_ids(spark, d):
    return a.table(spark, d, "documents").select("doc_id", text.stable_id(F.lit("run-1"), F.col("source"), F.col("doc_id")).alias("id"), F.md5(F.concat("source", F.col("doc_id").cast("string"))).alias("group_id"))


@query(f"WITH {_R} SELECT id FROM records WHERE ord % 3 <> 1")
def q_resume_missing(spark, d):
    rows = a.records(spark, d).select("id", "ord")
    return batches.missing(rows, rows.where("ord % 3 = 1"), "id").select("id")


@query("SELECT user_id AS idx, arg_max(event_type || ':' || event_id, event_id) AS response FROM events WHERE event_type <> 'error' GROUP BY user_id")
def q_last_write_wins(spark, d):
    log = a.table(spark, d, "events").select(F.col("user_id").alias("idx"), "event_id", F.when(F.col("event_type") == "error", "  ").otherwise(F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"))).alias("response"))
    return batches.last_written(log, "idx", "response", "event_id")


@query(f"""WITH p AS (SELECT doc_id AS idx, split_part(text, chr(10), 1) AS prompt, split_part(text, chr(10), 2) AS p0, split_part(text, chr(10), 3) AS p1 FROM documents)
SELECT idx, -1 AS pass, prompt, false AS is_paraphrase FROM p
UNION ALL SELECT idx, 0, p0, true FROM p WHERE trim(p0, {_WS}) <> '' AND trim(p0, {_WS}) <> trim(prompt, {_WS})
UNION ALL SELECT idx, 1, p1, true FROM p WHERE trim(p1, {_WS}) <> '' AND trim(p1, {_WS}) <> trim(prompt, {_WS})""")
def q_paraphrase_union(spark, d):
    line = lambda k: F.split_part("text", F.lit("\n"), F.lit(k))
    rows = a.table(spark, d, "documents").select(F.col("doc_id").alias("idx"), line(1).alias("prompt"), F.posexplode(F.array(line(2), line(3))).alias("pass", "other"))
    accepted = rows.where(rules.accepted_paraphrase(F.col("other"), F.col("prompt"))).select("idx", "pass", F.col("other").alias("prompt"))
    return batches.paraphrase_union(a.table(spark, d, "documents").select(F.col("doc_id").alias("idx"), line(1).alias("prompt")), accepted)


@query(f"""WITH {_T} SELECT step // 10 AS bin, count(*) AS n, round(avg(reward), 9) AS reward, round(avg(mean_instruction_score), 9) AS inst, round(avg(mean_hallucination_score), 9) AS halluc,
    round(avg(length_penalty), 9) AS penalty, round(avg(n_report), 9) AS bullets, round(avg(n_truth), 9) AS truth, round(avg(CASE WHEN reward < 0 THEN 100.0 ELSE 0.0 END), 9) AS negative_pct,
    round(avg(CASE WHEN mean_hallucination_score > 0 THEN 100.0 ELSE 0.0 END), 9) AS hallucinated_pct, round(avg(CASE WHEN judge_error THEN 100.0 ELSE 0.0 END), 9) AS error_pct FROM traces GROUP BY 1""")
def q_trace_bins(spark, d):
    bins = mining.trace_bins(a.traces(spark, d), 10)
    return bins.select("bin", "n", *(F.round(c, 9).alias(c) for c in bins.columns[2:]))


@query(f"WITH {_T} SELECT record_id, round(avg(reward), 6) AS mean_reward, count(*) AS n FROM traces WHERE NOT judge_error GROUP BY record_id HAVING count(*) >= 2")
def q_record_means(spark, d):
    return mining.record_means(a.traces(spark, d), 2).select("record_id", F.round("mean_reward", 6).alias("mean_reward"), "n")


@query(f"WITH {_HARD} SELECT record_id, source, round(mean_reward, 6) AS mean_reward, rank FROM hard")
def q_hard_ids(spark, d):
    return mining.hard_ids(a.trace_meta(spark, d), a.traces(spark, d), target=200).select("record_id", "source", F.round("mean_reward", 6).alias("mean_reward"), "rank")


@query(f"""WITH {_HARD}, c AS (SELECT source, count(*) AS underlying, count(*) FILTER (record_id IN (SELECT record_id FROM hard)) AS selected FROM meta GROUP BY source)
SELECT source, selected, underlying, round(100.0::DOUBLE * selected / greatest(1, sum(selected) OVER ()), 1) AS selected_pct, round(100.0::DOUBLE * underlying / sum(underlying) OVER (), 1) AS underlying_pct FROM c""")
def q_hard_breakdown(spark, d):
    meta = a.trace_meta(spark, d)
    return mining.breakdown(meta, mining.hard_ids(meta, a.traces(spark, d), target=200))


@query(f"WITH {_GROUPS} SELECT event_id, n, round(m, 6) AS group_mean, round(s, 6) AS group_std, round((reward - m) / (s + 1e-6::DOUBLE), 3) AS advantage FROM g WHERE n >= 2")
def q_group_advantage(spark, d):
    rows = scoring.group_statistics(a.traces(spark, d), ["step", "record_id"]).where("n >= 2")
    return rows.select("event_id", "n", F.round("group_mean", 6).alias("group_mean"), F.round("group_std", 6).alias("group_std"), F.round("advantage", 3).alias("advantage"))


@query(f"""WITH {_T}, s AS (SELECT step, record_id, count(*) AS n, avg(reward) AS m, stddev_pop(reward) AS s FROM traces GROUP BY ALL)
SELECT step, record_id, n, CASE WHEN n < 2 THEN 'kept' WHEN s < 0.05 THEN 'low_std' WHEN m > 0.95 THEN 'high_mean' ELSE 'kept' END AS fate FROM s""")
def q_dynamic_sampling(spark, d):
    return scoring.informative_groups(a.traces(spark, d), ["step", "record_id"]).select("step", "record_id", "n", "fate")


@query(f"""WITH {_T}, s AS (SELECT step, record_id, count(*) AS n, first(candidate_idx ORDER BY reward DESC, candidate_idx) AS chosen_idx, first(candidate_idx ORDER BY reward, candidate_idx) AS rejected_idx,
    max(reward) - min(reward) AS margin FROM traces GROUP BY ALL) SELECT step, record_id, chosen_idx, rejected_idx, round(margin, 6) AS margin FROM s WHERE n >= 2 AND chosen_idx <> rejected_idx AND margin >= 0.25""")
def q_pref_pairs(spark, d):
    return scoring.preference_pairs(a.traces(spark, d), ["step", "record_id"]).withColumn("margin", F.round("margin", 6))


@query(f"WITH {_UPDATES} SELECT record_id, round(ema, 6) AS ema, cnt FROM folded")
def q_ema_replay(spark, d):
    return tracker.replayed(a.traces(spark, d)).select("record_id", F.round("ema", 6).alias("ema"), "cnt")


@query(f"WITH {_UPDATES}, {_M} SELECT record_id, round(least(1.0::DOUBLE / (greatest(coalesce(ema, 0.8::DOUBLE), 0.0::DOUBLE) + 0.1::DOUBLE), 5.0::DOUBLE), 6) AS weight FROM meta LEFT JOIN folded USING (record_id)")
def q_sampling_weights(spark, d):
    return tracker.sampling_weights(a.trace_meta(spark, d).select("record_id"), tracker.replayed(a.traces(spark, d))).select("record_id", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_UPDATES}, {_M}, w AS (SELECT least(1.0::DOUBLE / (greatest(coalesce(ema, 0.8::DOUBLE), 0.0::DOUBLE) + 0.1::DOUBLE), 5.0::DOUBLE) AS weight FROM meta LEFT JOIN folded USING (record_id))
SELECT round(quantile_cont(weight, 0.5), 6) AS p50, round(quantile_cont(weight, 0.9), 6) AS p90, round(quantile_cont(weight, 0.99), 6) AS p99, round(max(weight), 6) AS max_weight FROM w""")
def q_weight_quantiles(spark, d):
    weights = tracker.sampling_weights(a.trace_meta(spark, d).select("record_id"), tracker.replayed(a.traces(spark, d)))
    found = tracker.weight_quantiles(weights)
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query(f"""WITH {_T} SELECT event_id, round(1.0::DOUBLE - 0.4::DOUBLE * (CASE WHEN n_report = 0 THEN 0.0 ELSE 0.5 END) - 0.15::DOUBLE * greatest(0, n_report - 1.5 * n_truth) - 0.15::DOUBLE * greatest(0, 0.5 * n_truth - n_report), 6) AS reward FROM traces""")
def q_reward(spark, d):
    scored = scoring.reward(F.col("instruction_scores"), F.col("hallucination_scores"), F.size("instruction_scores"), scoring.RewardConfig.shipped())
    return a.traces(spark, d).select("event_id", F.round(scored["reward"], 6).alias("reward"))


@query("""SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN 0 ELSE 0.15::DOUBLE * greatest(0, event_id % 12 - 1.5::DOUBLE * (event_id % 5)) + 0.15::DOUBLE * greatest(0, 0.5::DOUBLE * (event_id % 5) - event_id % 12) END, 6) AS penalty FROM events""")
def q_length_penalty(spark, d):
    return a.table(spark, d, "events").select("event_id", F.round(scoring.length_penalty(F.col("event_id") % 12, F.col("event_id") % 5, lam=0.15, under=True), 6).alias("penalty"))


_JUDGE_RAW = """CASE event_id % 4 WHEN 0 THEN 'INSTRUCTIONS: ' || round(value, 2) || ', x,,0.5' || chr(10) || 'hallucinations: 1.0' WHEN 1 THEN 'instructions: 1,0.5' WHEN 2 THEN 'nothing to say' ELSE 'HALLUCINATIONS: 0.25,0.5,0.75' END"""


@query(rf"""WITH t AS (SELECT event_id, {_JUDGE_RAW} AS raw FROM events),
l AS (SELECT *, nullif(trim(regexp_extract(raw, '(?im)^\s*INSTRUCTIONS\s*:\s*(.*)$', 1)), '') AS i, nullif(trim(regexp_extract(raw, '(?im)^\s*HALLUCINATIONS\s*:\s*(.*)$', 1)), '') AS h FROM t),
n AS (SELECT *, list_transform(list_filter(list_transform(string_split(coalesce(i, ''), ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: coalesce(try_cast(x AS DOUBLE), 0.0::DOUBLE)) AS a,
    list_transform(list_filter(list_transform(string_split(coalesce(h, ''), ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: coalesce(try_cast(x AS DOUBLE), 0.0::DOUBLE)) AS b FROM l)
SELECT event_id, i IS NULL AND h IS NULL AS error, round(list_sum(list_concat(a, [0.0::DOUBLE, 0, 0])[1:3]), 6) AS inst_sum, CASE WHEN i IS NULL AND h IS NULL THEN 0 ELSE 2 END::BIGINT AS n_report,
    CASE WHEN i IS NULL AND h IS NULL THEN 0.0 ELSE round(list_sum(list_concat(b, [0.0::DOUBLE, 0])[1:2]), 6) END AS halluc_sum FROM n""")
def q_judge_text(spark, d):
    raw = F.expr(_JUDGE_RAW.replace("chr(10)", "'\\n'"))
    scores = scoring.judge_scores(F.col("raw"), F.lit(3), F.lit(2))
    rows = a.table(spark, d, "events").select("event_id", raw.alias("raw")).withColumn("s", scores)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda x, y: x + y), 6)
    return rows.select("event_id", "s.error", total("s.instruction_scores").alias("inst_sum"), F.size("s.hallucination_scores").cast("long").alias("n_report"), total("s.hallucination_scores").alias("halluc_sum"))


@query(rf"""WITH {_R}, b AS (SELECT id, instruction_set AS t, list_filter(list_transform(list_filter(string_split(instruction_set, chr(10)), lambda x: regexp_matches(x, '^\s*(?:[-*•]|\d+\.)\s+(.*)$')),
    lambda x: trim(regexp_extract(x, '^\s*(?:[-*•]|\d+\.)\s+(.*)$', 1), {_WS})), lambda x: x <> '') AS bullets FROM records),
c AS (SELECT id, CASE WHEN len(bullets) > 0 THEN bullets WHEN trim(t, {_WS}) = '' THEN [] ELSE [trim(t, {_WS})] END AS items FROM b),
e AS (SELECT id, items, CASE WHEN len(items) = 1 AND len(string_split(items[1], ' - ')) >= 3 THEN list_filter(list_transform(string_split(items[1], ' - '), lambda x: trim(x, {_WS})), lambda x: x <> '') ELSE [] END AS p FROM c)
SELECT id, len(CASE WHEN len(p) >= 3 THEN p ELSE items END) AS n, md5(array_to_string(CASE WHEN len(p) >= 3 THEN p ELSE items END, '|')) AS digest FROM e""")
def q_split_instructions(spark, d):
    rows = a.records(spark, d).select("id", text.report_claims(F.col("instruction_set")).alias("claims"))
    return rows.select("id", F.size("claims").cast("long").alias("n"), F.md5(F.array_join("claims", "|")).alias("digest"))


@query("""WITH l AS (SELECT doc_id, n_chars AS n, least(128, n_chars) AS k FROM documents), s AS (SELECT *, least(greatest(n // 2 - k // 2, 0), n - k) AS m FROM l)
SELECT doc_id, n - k AS last_start, n AS last_end, 0::BIGINT AS first_start, k AS first_end, m AS middle_start, m + k AS middle_end FROM s WHERE n > 0""")
def q_token_ranges(spark, d):
    rows = a.table(spark, d, "documents").where("n_chars > 0")
    out = [rows["doc_id"]]
    for s in ("last", "first", "middle"):
        span = arrays.token_range(F.col("n_chars"), 128, s)
        out += [span["start"].alias(f"{s}_start"), span["end"].alias(f"{s}_end")]
    return rows.select(*out)


@query("SELECT doc_id, unnest(range(greatest(doc_id % 10 - 4, 0), doc_id % 10)) AS pos FROM documents")
def q_positions(spark, d):
    span = arrays.token_range(F.col("doc_id") % 10, 4, "last")
    return a.table(spark, d, "documents").select("doc_id", F.explode(arrays.positions(span)).alias("pos"))


@query("""WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings)
SELECT vec_id, round(embedding[1]::DOUBLE * (3.0::DOUBLE / greatest(norm, 1e-6::DOUBLE)), 5) AS first_value, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) * (3.0::DOUBLE / greatest(norm, 1e-6::DOUBLE)), 4) AS total FROM n""")
def q_norm_match(spark, d):
    rows = a.activations(spark, d).select("vec_id", arrays.norm_matched(F.col("embedding"), 3.0).alias("v"))
    return rows.select("vec_id", F.round(F.get("v", F.lit(0)), 5).alias("first_value"), F.round(F.aggregate("v", F.lit(0.0), lambda x, y: x + y), 4).alias("total"))


@query("SELECT round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS target_norm FROM embeddings")
def q_target_norm(spark, d):
    return a.activations(spark, d).agg(F.round(F.avg(arrays.norm(F.col("embedding"))), 5).alias("target_norm"))


@query("""WITH r AS (SELECT vec_id // 8 AS record, count(*) AS have, list(embedding[1]::DOUBLE ORDER BY vec_id) AS f FROM embeddings GROUP BY 1)
SELECT record, least(have, 6)::BIGINT AS filled, 6::BIGINT AS width, round(list_sum(f[1:6]), 4) AS first_sum FROM r""")
def q_pad_mask(spark, d):
    rows = a.activations(spark, d).groupBy("record").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "embedding"))), lambda x: x["embedding"]).alias("rows"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), 64)
    rows = rows.select("record", arrays.padded(F.col("rows"), 6, zero).alias("acts"), arrays.filled_mask(F.col("rows"), 6).alias("mask"))
    rows = rows.withColumn("acts", arrays.masked(F.col("acts"), F.col("mask")))
    return rows.select("record", F.aggregate("mask", F.lit(0).cast("long"), lambda x, y: x + y).alias("filled"), F.size("acts").cast("long").alias("width"), F.round(F.aggregate("acts", F.lit(0.0), lambda x, y: x + F.get(y, F.lit(0))), 4).alias("first_sum"))


@query("SELECT doc_id, r // 16 AS batch, r // 256 AS shard FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r FROM documents)")
def q_shards(spark, d):
    return batches.length_batches(a.table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 16, 256).select("doc_id", "batch", "shard")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('43:' || (doc_id // 100)), doc_id // 100, doc_id) - 1 AS position FROM documents")
def q_shard_order(spark, d):
    rows = a.table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 100).cast("long").alias("shard"))
    return batches.shard_order(rows, "shard", "doc_id", 42, 1).select("doc_id", "position")


@query("SELECT source AS source_dataset, dense_rank() OVER (ORDER BY source) - 1 AS source_id FROM (SELECT DISTINCT source FROM documents)")
def q_source_ids(spark, d):
    return mining.dense_source_ids(a.records(spark, d))


@query("""SELECT event_id, round(CASE WHEN event_id < 300 THEN (event_id + 1) / 300.0::DOUBLE ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5 * (1 + cos(pi() * least(greatest((event_id - 300) / 8700.0::DOUBLE, 0), 1))) END, 6) AS factor FROM events""")
def q_lr_schedule(spark, d):
    return a.table(spark, d, "events").select("event_id", F.round(arrays.learning_rate_factor(F.col("event_id"), 300, 9000, 0.1), 6).alias("factor"))


@query(f"""WITH {_T}, s AS (SELECT step, round(avg(reward), 6) AS value FROM traces GROUP BY step), b AS (SELECT *, max(value) OVER (ORDER BY step) AS best, max(value) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s),
i AS (SELECT *, e IS NULL OR value > e AS improved FROM b), k AS (SELECT *, sum(improved::INT) OVER (ORDER BY step) AS run FROM i) SELECT step, value, best, improved, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS since FROM k""")
def q_best_so_far(spark, d):
    steps = a.traces(spark, d).groupBy("step").agg(F.round(F.avg("reward"), 6).alias("value"))
    return tracker.best_so_far(steps).select("step", "value", "best", "improved", "since")


@query(f"WITH {_T} SELECT round(avg(exp(mean_instruction_score - reward) - 1.0 - (mean_instruction_score - reward)), 4) AS k3_mean FROM traces")
def q_k3_kl(spark, d):
    return a.traces(spark, d).agg(F.round(F.avg(scoring.k3(F.col("reward"), F.col("mean_instruction_score"))), 4).alias("k3_mean"))


@query(f"""WITH {_T}, p AS (SELECT (reward - mean_instruction_score) - (mean_hallucination_score - length_penalty) AS delta FROM traces)
SELECT round(avg(ln(1.0 + exp(-0.1::DOUBLE * delta))), 6) AS dpo_loss, round(avg((delta > 0)::INT), 6) AS pair_accuracy, round(avg((delta - 5.0::DOUBLE) * (delta - 5.0::DOUBLE)), 4) AS ipo_loss FROM p""")
def q_dpo_ipo(spark, d):
    pairs = a.traces(spark, d).select(F.col("reward").alias("pi_chosen"), F.col("mean_instruction_score").alias("pi_rejected"), F.col("mean_hallucination_score").alias("ref_chosen"), F.col("length_penalty").alias("ref_rejected"))
    out = scoring.pair_losses(pairs)
    return out.select(F.round("dpo_loss", 6).alias("dpo_loss"), F.round("pair_accuracy", 6).alias("pair_accuracy"), F.round("ipo_loss", 4).alias("ipo_loss"))


@query(f"""WITH {_GROUPS}, v AS (SELECT *, (reward - m) / (s + 1e-6::DOUBLE) AS adv FROM g)
SELECT round(-avg(adv * mean_instruction_score) + 0.1 * avg(mean_hallucination_score), 3) AS loss, round(avg(reward), 6) AS reward_mean, round(stddev_pop(reward), 6) AS reward_std, round(avg(abs(adv)), 3) AS mean_abs_advantage, count(DISTINCT (step, record_id)) AS n_groups FROM v WHERE n >= 2""")
def q_group_loss(spark, d):
    rows = scoring.group_statistics(a.traces(spark, d), ["step", "record_id"]).where("n >= 2").drop("n", "group_mean", "group_std", "advantage")
    out = scoring.group_loss(rows, ["step", "record_id"], 0.1, "mean_instruction_score", "mean_hallucination_score")
    return out.select(F.round("loss", 3).alias("loss"), F.round("reward_mean", 6).alias("reward_mean"), F.round("reward_std", 6).alias("reward_std"), F.round("mean_abs_advantage", 3).alias("mean_abs_advantage"), "n_groups")


@query(f"""WITH {_R} SELECT id, 3::BIGINT AS n_messages, md5('user' || prompt || 'assistant' || response || 'user' || 'List them.') AS digest, md5('system' || 'Be brief.' || 'user' || 'Prompt: ' || prompt) AS with_system FROM records""")
def q_message_build(spark, d):
    joined = lambda m: F.md5(F.array_join(F.transform(m, lambda x: F.concat(x["role"], x["content"])), ""))
    three = rules.label_messages(F.col("prompt"), F.col("response"), F.lit("List them."), "multi_turn")
    one = rules.with_system(rules.label_messages(F.col("prompt"), F.col("response"), text.filled("Prompt: {prompt}", prompt=F.col("prompt")), "prompt_only"), F.lit("Be brief."))
    return a.records(spark, d).select("id", F.size(three).cast("long").alias("n_messages"), joined(three).alias("digest"), joined(one).alias("with_system"))


@query("""WITH t AS (SELECT doc_id, list_transform(range(1, 9), lambda k: ((doc_id * k) % 7)::INT) AS a FROM documents)
SELECT doc_id, len(a[1:coalesce(list_position(a, 0), 8)]) AS n, list_sum(a[1:coalesce(list_position(a, 0), 8)])::BIGINT AS total FROM t""")
def q_eos_trim(spark, d):
    tokens = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: (F.col("doc_id") * k % 7).cast("int"))
    rows = a.table(spark, d, "documents").select("doc_id", arrays.cut_after(tokens, 0).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda x, y: x + y).alias("total"))


@query("""WITH t AS (SELECT doc_id, doc_id // 4 AS batch, list_transform(range(0, doc_id % 5 + 2), lambda k: (k + 1)::INT) AS a FROM documents), w AS (SELECT *, max(len(a)) OVER (PARTITION BY batch) AS width FROM t)
SELECT doc_id, width AS width, (width - len(a)) AS pads, list_sum(list_transform(a, lambda x: CASE WHEN x - 1 >= 1 AND x - 1 < 3 THEN x ELSE -100 END))::BIGINT AS label_sum FROM w""")
def q_batch_labels(spark, d):
    from pyspark.sql.window import Window

    tokens = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 5 + 1).cast("int")), lambda k: k + 1)
    rows = a.table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("batch"), tokens.alias("a")).withColumn("width", F.max(F.size("a")).over(Window.partitionBy("batch")).cast("long"))
    rows = rows.withColumn("padded", arrays.right_padded(F.col("a"), F.col("width"), -1)).withColumn("labels", arrays.answer_labels(F.col("a"), F.lit(1), F.lit(3)))
    return rows.select("doc_id", "width", F.size(F.filter("padded", lambda x: x == -1)).cast("long").alias("pads"), F.aggregate("labels", F.lit(0).cast("long"), lambda x, y: x + y).alias("label_sum"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id::VARCHAR LIMIT (SELECT greatest(1, floor(count(*) * 0.1))::BIGINT FROM documents)")
def q_judge_subsample(spark, d):
    rows = a.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"))
    return batches.hash_sample(rows, 0.1, 42, "key").select("doc_id")


@query("SELECT source, round(avg(m), 6) AS loss, count(*) AS batches FROM (SELECT doc_id // 16 AS batch, source, avg(n_chars / 1000.0::DOUBLE) AS m FROM documents GROUP BY ALL) GROUP BY source")
def q_source_loss(spark, d):
    rows = a.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 16).alias("batch"), "source", (F.col("n_chars") / 1000.0).alias("loss"))
    return mining.source_losses(rows).select("source", F.round("loss", 6).alias("loss"), "batches")


@query(f"WITH {_HARD}, h AS (SELECT record_id, row_number() OVER (ORDER BY source, rank) - 1 AS position FROM hard) SELECT position, record_id, min(doc_id) AS idx FROM h JOIN (SELECT doc_id, 'doc-' || (doc_id % 500) AS record_id FROM documents) USING (record_id) GROUP BY ALL")
def q_hard_index(spark, d):
    meta = a.trace_meta(spark, d)
    hard = batches.numbered(mining.hard_ids(meta, a.traces(spark, d), target=200), ["source", "rank"], name="position").select("position", "record_id")
    dataset = a.table(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.concat(F.lit("doc-"), (F.col("doc_id") % 500).cast("string")).alias("record_id"))
    return mining.ordered_hits(hard, dataset)


@query("SELECT doc_id, (i - 1)::INT AS candidate_idx, md5(line) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def q_candidates_expanded(spark, d):
    """The lines of each document as its candidates."""
    rows = a.table(spark, d, "documents").select("doc_id", F.split("text", "\n", -1).alias("candidates"))
    return scoring.with_candidates(rows, "candidates").select("doc_id", "candidate_idx", F.md5("candidate").alias("digest"))


@query("SELECT conv_id, count(*) AS n, sha256(string_agg(r || '. ' || text, chr(10) ORDER BY turn)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY conv_id")
def q_numbered_turns(spark, d):
    lines = text.numbered(F.transform("messages", lambda m: m["content"]))
    return a.turns(spark, d).select("conv_id", F.size("messages").cast("long").alias("n"), F.sha2(lines, 256).alias("digest"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract(props, '$.k')::BIGINT END AS k FROM events")
def q_judge_json(spark, d):
    """What the props of events say, as a judge would give them: bare, fenced, in prose, or not as JSON."""
    body, kind = F.col("props"), F.col("event_id") % 4
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("I think "), body, F.lit(" fits"))).otherwise(F.concat(F.lit("{k "), body))
    return a.table(spark, d, "events").select("event_id", F.get_json_object(text.json_object(raw), "$.k").cast("long").alias("k"))


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT user_id, n, CASE WHEN user_id % 5 <> 0 OR event_type <> 'click' THEN 'language_model.' ELSE 'model.' END || event_type AS k FROM n WHERE event_type <> 'error'),
m AS (SELECT user_id, bool_or(starts_with(k, 'model.')) AS have FROM k GROUP BY user_id)
SELECT user_id, string_agg(x || '=' || n, ',' ORDER BY x) AS entries FROM (SELECT user_id, n, CASE WHEN have THEN k ELSE replace(k, 'language_model.', 'model.') END AS x FROM k JOIN m USING (user_id)) GROUP BY user_id""")
def q_map_keys(spark, d):
    """Event counts of each user as a map: errors are secret, and keys are renamed where none has its new name yet."""
    key = F.concat(F.when(F.col("event_type") == "error", "lora_secret.").when((F.col("user_id") % 5 == 0) & (F.col("event_type") == "click"), "model.").otherwise("language_model."), F.col("event_type"))
    counts = a.table(spark, d, "events").groupBy("user_id", key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    clean = arrays.remapped_keys(arrays.without_keys(F.col("m"), ["secret", "path"]), "language_model.", "model.")
    entries = F.array_sort(F.transform(F.map_entries(clean), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return maps.select("user_id", F.array_join(entries, ",").alias("entries")).where("entries <> ''")


@query()
def weighted_sample(spark, d):
    weights = tracker.sampling_weights(a.trace_meta(spark, d).select("record_id"), tracker.replayed(a.traces(spark, d)))
    return tracker.weighted_draws(batches.numbered(weights, ["record_id"], name="idx"), 1000, 7)


@query()
def exact_seed_split(spark, d):
    return splits.split_records_exactly(a.records(spark, d)).select("id", "split")


@query(f"WITH {_UPDATES} SELECT record_id, round(ema, 6) AS ema, cnt FROM folded")
def stream_ema(spark, d):
    from labelmill.streaming.traces import replay_stream

    return replay_stream(a.traces(spark, d).select("step", "record_id", "reward")).select("record_id", F.round("ema", 6).alias("ema"), "cnt")


@query(f"WITH {_R} SELECT id, length(prompt) || ' characters' AS response FROM records")
def enrich_stub(spark, d):
    from labelmill.plans.enrich import enriched

    rows = a.records(spark, d).select("id", "prompt")
    return enriched(rows, "id", "prompt", lambda prompts: [f"{len(p)} characters" for p in prompts], "response")


@query("""WITH x AS (SELECT vec_id // 8 AS record, vec_id % 8 AS pos, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY record) AS size FROM x),
l AS (SELECT record, CASE WHEN i + 1 >= 3 THEN e[i + 2] - ln(list_sum(list_transform(e, lambda v: exp(v)))) END AS logp FROM n WHERE i + 1 < size)
SELECT r.record, round(coalesce(sum(logp), 0), 4) AS logp_sum, round(coalesce(avg(logp), 0), 5) AS logp_mean, count(logp) AS n_tokens FROM (SELECT DISTINCT record FROM x) r LEFT JOIN l USING (record) GROUP BY r.record""")
def token_logprobs(spark, d):
    from labelmill.functions.tensors import sequence_logprobs

    logits = a.activations(spark, d).groupBy("record").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "embedding"))), lambda x: x["embedding"]).alias("logits"))
    labels = F.transform("logits", lambda _, i: F.when(i < 3, F.lit(-100)).otherwise(i).cast("int"))
    return sequence_logprobs(logits.withColumn("labels", labels), "record").select("record", F.round("logp_sum", 4).alias("logp_sum"), F.round("logp_mean", 5).alias("logp_mean"), "n_tokens")


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    from labelmill.storage import shared_folder

    return f"{shared_folder(spark)}/labelmill/{name}-{uuid.uuid4().hex}"


@query(f"SELECT 'ultrachat' AS source, 'chat' AS task_type, conv_id, turn, trim(text, {_WS}) AS prompt FROM conversations WHERE role = 'user' AND trim(text, {_WS}) <> '' ORDER BY conv_id, turn LIMIT 200")
def q_prompt_source(spark, d):
    """The first user turns, by the data source: role and cap are dealt with in the scan."""
    from labelmill.sources import prompts

    files = prompts.parquet_files(spark, f"{d}/conversations.parquet")
    rows = prompts.read_prompts(spark, "ultrachat", files, "text", ["conv_id", "turn", "role"], where=[("role", "=", "user")], most=200)
    return rows.select("source", "task_type", "conv_id", "turn", "prompt")


@query(f"""WITH {_SPLIT}, n AS (SELECT *, (row_number() OVER (PARTITION BY split ORDER BY ord, id) - 1) // 64 AS shard FROM split_records)
SELECT split, shard, count(*) AS records, min(ord) AS first_ord, max(ord) AS last_ord, CAST(sum(length(response)) AS BIGINT) AS chars FROM n GROUP BY split, shard""")
def q_shard_commit(spark, d):
    """Records of each split in shards of 64, written with their manifest in one commit and read back by it."""
    from labelmill.plans import shards

    path = _folder(spark, "shards")
    rows = splits.split_records(a.records(spark, d)).select("split", "ord", "id", "response")
    shards.write_sharded(rows, path, ["ord", "id"], 64)
    return shards.read_sharded(spark, path).groupBy("split", "shard").agg(F.count(F.lit(1)).alias("records"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.sum(F.length("response")).alias("chars"))


@query(f"""WITH {_R}, f AS (SELECT *, ord % 2 AS file FROM records WHERE prompt <> '' AND response <> ''),
g AS (SELECT id, ord, 0 AS rank FROM f WHERE file = 1 UNION ALL SELECT id, ord, 1 FROM f WHERE file = 0 UNION ALL SELECT id, ord, 2 FROM f WHERE file = 1)
SELECT row_number() OVER (ORDER BY rank, ord) - 1 AS place, id FROM g""")
def q_scan_order(spark, d):
    """Lines of three paths, one of them given twice, numbered in the order in which they are given."""
    from labelmill.sources import readers

    path = _folder(spark, "lines")
    rows = a.records(spark, d).select("id", "source_dataset", "prompt", "response", "instruction_set", "ord")
    for k in (0, 1):
        rows.where(F.col("ord") % 2 == k).repartitionByRange(3, "ord").sortWithinPartitions("ord").drop("ord").write.json(f"{path}/{k}")
    read = readers.dataset(spark, [f"{path}/1", f"{path}/0", f"{path}/1"])
    return batches.numbered(read.select("ord", "id"), ["ord"], name="place").select("place", "id")


@query(rf"""WITH {_REASONED}, m AS (SELECT '[' || string_agg('"' || id || '"', ', ' ORDER BY ord) || ']' AS text FROM reasoned WHERE reason = 'kept')
SELECT CAST(length(text) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM m""")
def q_mask_digest(spark, d):
    """Size and digest of the mask file of all records that the rules keep."""
    from labelmill.plans import manifest
    from labelmill.sources import digests

    path = _folder(spark, "mask") + "/valid_record_ids.json"
    manifest.write_mask(_reasoned(spark, d).where("reason = 'kept'"), path)
    return digests.file_digests(spark, [path]).select("bytes", "sha256")


@query(f"""WITH {_SPLIT} SELECT split, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY md5('42:' || unit), ord)) AS checksum FROM split_records GROUP BY split""")
def q_split_digests(spark, d):
    """A digest of the ids of each split, in the order of the hash that dealt them: no array of all ids is made."""
    rows = splits.split_records(a.records(spark, d)).withColumn("unit", F.coalesce(F.concat(F.lit("g:"), F.col("paraphrase_group_id")), F.concat(F.lit("r:"), F.col("id"))))
    placed = batches.numbered(rows.select("split", "id", splits.hash_order(42, F.col("unit")).alias("key"), "ord"), ["key", "ord"], name="position")
    return splits.split_digests(placed)


@query(rf"""WITH {_REASONED} SELECT id, CAST(unnest(range(len(bullets))) AS INTEGER) AS pos, unnest(bullets) AS bullet FROM reasoned""")
def q_bullet_rows(spark, d):
    """A row for each bullet, by a table function that SQL joins laterally."""
    from labelmill.functions.tables import with_table_functions

    rows = a.records(spark, d).select("id", "instruction_set")
    return with_table_functions(spark).sql("SELECT r.id, b.pos, b.bullet FROM {rows} r, LATERAL bullets(r.instruction_set) b", rows=rows)
