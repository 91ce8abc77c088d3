"""Queries of scalars, ingestion, chunking, evaluation and accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import query
from .functions import similarity as S
from .functions import text as T
from .operators import chunking as C
from .operators import evaluation as E
from .operators import usage as U
from .sources import ingest as I

_MONTHS = ", ".join(f"'{m}'" for m in T.MONTHS)
_CHUNK_KEY = "doc_id, session_id, session_time"


@query("SELECT doc_id, turn, CASE WHEN regexp_matches(trim(concat(session_time, ' ', speaker)), '^\\d{4}/\\d{2}/\\d{2}') THEN session_time END AS date_prefix, CASE WHEN regexp_matches(speaker, '^\\d{4}/\\d{2}/\\d{2}') THEN speaker END AS none FROM turns")
def date_prefix(t):
    return t["turns"].select("doc_id", "turn", T.date_prefix(F.concat_ws(" ", "session_time", "speaker")).alias("date_prefix"), T.date_prefix("speaker").alias("none"))


_LONG = f"concat('1:56 pm on ', cast(cast(substr(b, 9, 2) AS int) AS string), ' ', upper(substr(list_extract([{_MONTHS}], cast(substr(b, 6, 2) AS int)), 1, CASE WHEN id % 2 = 0 THEN 3 ELSE 20 END)), CASE WHEN id % 3 = 0 THEN ', ' ELSE ' ' END, substr(b, 1, 4))"


@query(f"SELECT id, long_date, CASE WHEN id % 11 = 0 THEN 'no date here' ELSE a END AS parsed FROM (SELECT id, a, CASE WHEN id % 11 = 0 THEN 'no date here' ELSE {_LONG} END AS long_date FROM dates)")
def parse_long_date(t):
    months = F.array(*(F.lit(m) for m in T.MONTHS))
    month = F.upper(F.substr(F.get(months, F.substring("b", 6, 2).cast("int") - 1), F.lit(1), F.when(F.col("id") % 2 == 0, 3).otherwise(20)))
    text = F.concat(F.lit("1:56 pm on "), F.substring("b", 9, 2).cast("int").cast("string"), F.lit(" "), month, F.when(F.col("id") % 3 == 0, ", ").otherwise(" "), F.substring("b", 1, 4))
    rows = t["dates"].withColumn("long_date", F.when(F.col("id") % 11 == 0, "no date here").otherwise(text))
    return rows.select("id", "long_date", T.parse_long_date("long_date").alias("parsed"))


@query("SELECT id, CASE WHEN id % 3 = 2 THEN '2001/12/31' ELSE a END AS stamp FROM dates")
def norm_timestamp(t):
    rows = t["dates"].select("id", F.when(F.col("id") % 3 == 0, F.col("stamp")).otherwise("").alias("x"), F.when(F.col("id") % 3 == 1, F.col("b")).alias("y"), F.array(F.lit(""), F.lit("1999-01-01"), F.lit("2001-12-31 10:00")).alias("z"))
    return rows.select("id", T.norm_timestamp("x", "y", "z").alias("stamp"))


@query("SELECT id, cast(abs(cast(b AS date) - DATE '1998-05-02') AS double) AS gap, CASE WHEN id % 2 = 0 THEN 0.0::double ELSE cast(abs(cast(b AS date) - DATE '1998-05-02') AS double) END AS strict_gap, 0.0::double AS mixed, 0.0::double AS unknown FROM dates")
def time_gap(t):
    fixed = F.lit("1998/5/2")
    return t["dates"].select(
        "id", T.time_gap("a", fixed).alias("gap"), T.time_gap(F.when(F.col("id") % 2 == 0, F.col("b")).otherwise(F.col("a")), fixed, strict=True).alias("strict_gap"),
        T.time_gap("b", fixed).alias("mixed"), T.time_gap(F.lit("2023/00/08"), "a").alias("unknown"))


_CONTEXT = "SELECT doc_id, string_agg(concat('\"', speaker, '\": \"', content, '\"'), '' ORDER BY turn) AS context FROM turns GROUP BY doc_id"


def _messages(t):
    return t["turns"].groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "speaker", "content"))), lambda m: F.struct(m["speaker"].alias("role"), m["content"].alias("content"))).alias("m"))


@query(_CONTEXT)
def build_context(t):
    return _messages(t).select("doc_id", T.build_context("m").alias("context"))


@query("""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY turn) - 1 AS pos, speaker, content FROM (
    SELECT doc_id, turn, speaker, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS content FROM turns WHERE speaker IN ('user', 'assistant')) WHERE content <> ''""")
def dialog_turns(t):
    parsed = _messages(t).select("doc_id", F.explode(C.turn_parser()(T.build_context("m"))).alias("x"))
    return parsed.select("doc_id", F.col("x.pos").cast("bigint").alias("pos"), "x.speaker", "x.content")


@query("SELECT session_id, concat('D', cast(doc_id AS string), ',D', cast(doc_id % 7 AS string)) AS evidence FROM turns WHERE turn = 0 AND doc_id <> doc_id % 7 UNION ALL SELECT session_id, concat('D', cast(doc_id AS string)) FROM turns WHERE turn = 0 AND doc_id = doc_id % 7")
def evidence_prefix(t):
    d = lambda n: F.concat(F.lit("D"), n.cast("string"), F.lit(":"), F.col("turn").cast("string"))
    rows = t["turns"].filter("turn = 0").select("session_id", F.array(d(F.col("doc_id")), F.lit("no colon"), d(F.col("doc_id") % 7), d(F.col("doc_id"))).alias("e"))
    return rows.select("session_id", F.array_join(T.evidence_prefix("e"), ",").alias("evidence"))


_SUFFIX = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in I.SUFFIXES.items()) + " ELSE 'unknown' END"


@query("SELECT kind, suffix, count(*) AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'multi-session' WHEN 1 THEN 'knowledge-update' ELSE event_type END AS kind, CASE event_id % 3 WHEN 0 THEN 'ms' WHEN 1 THEN 'ku' ELSE 'unknown' END AS suffix FROM events) GROUP BY kind, suffix")
def type_counts(t):
    kind = F.when(F.col("event_id") % 3 == 0, "multi-session").when(F.col("event_id") % 3 == 1, "knowledge-update").otherwise(F.col("event_type"))
    return t["events"].select(kind.alias("kind")).groupBy("kind", I.suffix("kind").alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type, 3 + row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS item_index FROM events")
def item_index(t):
    rows = t["events"].withColumn("kind", F.concat_ws("/", "event_type", F.col("user_id").cast("string")))
    return I.folder_index(rows, "kind", "event_id", taken=3).select("event_id", "event_type", "item_index")


@query("SELECT concat('Q', cast(doc_id AS string)) AS question_id, 0 AS pos, session_id, session_time, context FROM (SELECT doc_id, session_id, session_time, string_agg(concat('\"', speaker, '\": \"', content, '\"'), '' ORDER BY turn) AS context FROM turns GROUP BY doc_id, session_id, session_time)")
def ingest_sessions(t):
    rows = _messages(t).join(t["turns"].select("doc_id", "session_id", "session_time").distinct(), "doc_id")
    items = rows.select(
        F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("question_id"), F.array(F.concat_ws(" ", "session_time", F.lit("(Sat) 02:21")), F.lit("2024/02/02")).alias("haystack_dates"),
        F.array("session_id").alias("haystack_session_ids"), F.array("m", "m").alias("haystack_sessions"))
    return I.item_sessions(items)


_PAIRS = f"SELECT *, sum(start) OVER (PARTITION BY {_CHUNK_KEY} ORDER BY turn) - 1 AS pair FROM (SELECT *, CASE WHEN speaker = 'user' OR coalesce(lag(speaker) OVER (PARTITION BY {_CHUNK_KEY} ORDER BY turn), '') <> 'user' THEN 1 ELSE 0 END AS start FROM turns WHERE speaker IN ('user', 'assistant') AND trim(content) <> '')"
_CHUNKS = f"SELECT row_number() OVER (ORDER BY doc_id, session_id, pair) - 1 AS chunk_id, * FROM (SELECT {_CHUNK_KEY}, pair, string_agg(concat(upper(substr(speaker, 1, 1)), substr(speaker, 2), ': ', content), chr(10) ORDER BY turn) AS text, max(CASE WHEN speaker = 'user' THEN 1 ELSE 0 END) AS has_user, max(CASE WHEN speaker = 'assistant' THEN 1 ELSE 0 END) AS has_assistant FROM ({_PAIRS}) GROUP BY {_CHUNK_KEY}, pair)"
_FIXED = f"SELECT row_number() OVER (ORDER BY doc_id, session_id, pair) - 1 AS chunk_id, * FROM (SELECT {_CHUNK_KEY}, pair, string_agg(concat(speaker, ': ', content), chr(10) ORDER BY turn) AS text FROM (SELECT *, (row_number() OVER (PARTITION BY {_CHUNK_KEY} ORDER BY turn) - 1) // 2 AS pair FROM turns WHERE trim(content) <> '') GROUP BY {_CHUNK_KEY}, pair)"


@query(f"SELECT chunk_id, {_CHUNK_KEY}, text FROM ({_CHUNKS})")
def dialog_chunks(t):
    return C.dialog_chunks(t["turns"]).select("chunk_id", "doc_id", "session_id", "session_time", "text")


@query(f"SELECT chunk_id, {_CHUNK_KEY}, text FROM ({_FIXED})")
def dialog_chunks_fixed(t):
    return C.dialog_chunks(t["turns"], fixed=True).select("chunk_id", "doc_id", "session_id", "session_time", "text")


@query(f"""SELECT count(*) AS chunks, cast(sum(words) AS bigint) AS words, count(DISTINCT session_id) AS sessions, round(avg(words), 6) AS avg_words,
    count(*) FILTER (has_user = 1 AND has_assistant = 0) AS user_only, count(*) FILTER (has_user = 0 AND has_assistant = 1) AS assistant_only, count(*) FILTER (has_user = 1 AND has_assistant = 1) AS complete
    FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM ({_CHUNKS}))""")
def chunk_stats(t):
    return C.chunk_stats(C.dialog_chunks(t["turns"]))


@query(f"SELECT count(*) FILTER (chunk_id IS NULL OR coalesce(session_id, '') = '' OR trim(text) = '') = 0 AS valid, count(*) FILTER (chunk_id IS NULL OR coalesce(session_id, '') = '' OR trim(text) = '') AS invalid_chunks FROM ({_CHUNKS})")
def chunk_validate(t):
    return C.chunk_faults(C.dialog_chunks(t["turns"]))


@query("""SELECT doc_id, k AS pos, k * 1100 AS start_idx, least(k * 1100 + 1200, n) AS end_idx, substr(text, (k * 1100 + 1)::INT, 1200) AS text FROM (
    SELECT doc_id, text, length(text) AS n, unnest(range(0, greatest(1, ceil((length(text) - 100) / 1100.0)::BIGINT))) AS k FROM documents WHERE length(text) > 0)""")
def doc_chunks(t):
    return C.window_chunks(t["documents"], 1200, 100)


@query()
def document_splitter(t):
    return C.document_chunks(t["documents"].withColumn("title", F.lit("")))


@query("""WITH RECURSIVE folds AS (
    SELECT session_id, turn, context AS acc FROM session_docs WHERE turn = 0
    UNION ALL SELECT s.session_id, s.turn, CASE WHEN contains(p.acc, s.context) THEN p.acc ELSE concat(p.acc, chr(10), chr(10), s.context) END FROM folds p JOIN session_docs s ON s.session_id = p.session_id AND s.turn = p.turn + 1)
    SELECT a.session_id, b.session_time, a.acc AS context FROM folds a JOIN (SELECT session_id, max(turn) AS last, min(session_time) AS session_time FROM session_docs GROUP BY session_id) b ON a.session_id = b.session_id AND a.turn = b.last""")
def merge_session_docs(t):
    return I.merge_session_docs(t["session_docs"].select(F.col("turn").alias("doc_id"), "session_id", "session_time", "context"))


def _summaries(t):
    """A summary for each session: its speakers as keys, a theme for each turn."""
    turns = t["turns"].withColumn("theme", F.struct((F.col("turn") + 1).cast("int").alias("i"), F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("title"), F.regexp_replace("content", "\n", " ").alias("summary")))
    return turns.groupBy("session_id", "session_time").agg(F.array_join(F.array_sort(F.collect_set("speaker")), ", ").alias("keys"), F.collect_list("theme").alias("themes"))


_THEME = "replace(content, chr(10), ' ')"
_SUMMARY = "SELECT session_id, session_time, string_agg(DISTINCT speaker, ', ' ORDER BY speaker) AS keys, {themes} AS themes FROM turns GROUP BY session_id, session_time"


@query(f"SELECT session_id, concat('Session ', session_id, ' (', session_time, ') Keys: ', keys, ' ', themes) AS text FROM ({_SUMMARY.format(themes=f'''string_agg(concat('theme_', cast(turn + 1 AS string), ': Turn ', cast(turn AS string), ' Summary: ', {_THEME}), ' ' ORDER BY turn)''')})")
def summary_text(t):
    return _summaries(t).select("session_id", T.summary_text("session_id", "session_time", "keys", "themes").alias("text"))


@query(f"SELECT session_id, concat('Session ', session_id, ' (', session_time, '):', chr(10), '  Keys: ', keys, chr(10), themes) AS block FROM ({_SUMMARY.format(themes=f'''string_agg(concat('  theme_', cast(turn + 1 AS string), ': Turn ', cast(turn AS string), chr(10), '    Summary: ', {_THEME}), chr(10) ORDER BY turn)''')})")
def format_summaries(t):
    return _summaries(t).select("session_id", T.format_summary("session_id", "session_time", "keys", "themes").alias("block"))


@query(f"""SELECT session_id, session_time, keys, themes FROM ({_SUMMARY.format(themes=f'''string_agg(concat(cast(rn AS string), ':', {_THEME}), '|' ORDER BY turn)''').replace('FROM turns', 'FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS rn FROM turns)')})""")
def summary_legacy(t):
    from .operators.context import legacy_summary

    rows = t["turns"].groupBy("session_id", "session_time").agg(F.array_sort(F.collect_set("speaker")).alias("keys"), F.array_sort(F.collect_list(F.struct("turn", F.regexp_replace("content", "\n", " ").alias("summary")))).alias("t"))
    rows = rows.select("session_id", "session_time", "keys", F.transform("t", lambda x: F.struct(F.lit("").alias("title"), x["summary"].alias("summary"))).alias("themes"))
    return legacy_summary(rows).select("session_id", "session_time", "keys", F.array_join(F.transform("themes", lambda x: F.concat(x["i"].cast("string"), F.lit(":"), x["summary"])), "|").alias("themes"))


@query(f"""SELECT chunk_id, CASE WHEN len(said) > 0 THEN array_to_string(said, ' ') WHEN len(sentences) > 0 THEN array_to_string(sentences[1:2], ' ') WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS utterances FROM (
    SELECT chunk_id, text, list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: starts_with(x, 'User:')), lambda x: regexp_replace(substr(x, 6), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS said,
    list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 10 AND NOT regexp_matches(lower(s), 'assistant:|i can help|here are|let me|you should')) AS sentences FROM ({_CHUNKS}))""")
def user_utterances(t):
    return C.dialog_chunks(t["turns"]).select("chunk_id", T.user_utterances("text").alias("utterances"))


_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_NUMBER = f"regexp_matches(expected, '{T.NUMBER}') OR regexp_matches(expected, '^\\d+(\\.\\d+)?\\s*\\w*$')"
_NUMERIC = "regexp_matches(expected, '\\d+(?:\\.\\d+)?') AND list_contains(regexp_extract_all(output, '\\d+(?:\\.\\d+)?'), regexp_extract(expected, '\\d+(?:\\.\\d+)?'))"
_EXACT = "contains(lower(trim(output)), lower(trim(expected)))"
_MATCH = f"""SELECT *, CASE WHEN coalesce(trim(expected), '') = '' OR coalesce(trim(output), '') = '' THEN false WHEN {_EXACT} THEN true WHEN {_NUMBER} THEN {_NUMERIC} ELSE contains(o, e) OR (len(regexp_split_to_array(trim(expected), '\\s+')) <= 3 AND len(list_filter(string_split(e, ' '), lambda x: NOT list_contains(string_split(o, ' '), x))) = 0) END AS correct, trim(output) <> '' AS answered FROM (
    SELECT *, {_NORM.format('expected')} AS e, {_NORM.format('output')} AS o FROM answers)"""


@query(f"SELECT doc_id, {_NORM.format('text')} AS text FROM documents")
def normalize_text(t):
    return t["documents"].select("doc_id", T.normalize_text("text").alias("text"))


@query(f"SELECT id, ({_NUMBER}) AS is_numeric, ({_NUMERIC}) AS matched FROM answers")
def numeric_match(t):
    return t["answers"].select("id", T.is_numeric("expected").alias("is_numeric"), T.numeric_match("expected", "output").alias("matched"))


@query(f"SELECT id, {_EXACT} AS matched FROM answers")
def exact_match(t):
    return t["answers"].select("id", T.exact_match("expected", "output").alias("matched"))


@query(f"SELECT id, correct FROM ({_MATCH})")
def answer_match(t):
    return t["answers"].select("id", T.answer_match("expected", "output").alias("correct"))


_METRICS = "count(*) AS total, count(*) FILTER (answered) AS answered, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) / count(*), 6) AS accuracy, round(count(*) FILTER (answered) / count(*), 6) AS answer_rate"


@query(f"SELECT {_METRICS} FROM ({_MATCH})")
def eval_metrics(t):
    return E.metrics(E.judged(t["answers"]))


@query(f"SELECT coalesce(question_type, 'all') AS question_type, {_METRICS} FROM ({_MATCH}) GROUP BY ROLLUP (question_type)")
def eval_by_type(t):
    return E.metrics_by_type(E.judged(t["answers"]))


@query("SELECT id, round(len(list_filter(o, lambda x: x = top_a OR x = top_b)) / len(o), 6) AS score FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(origin, '[,;]'), lambda x: trim(x)), lambda x: x <> '') AS o FROM answers)")
def session_matching(t):
    return t["answers"].select("id", F.round(E.matching_score(T.origin_ids("origin"), F.array("top_a", "top_b")), 6).alias("score"))


@query(f"SELECT id, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) OVER (ORDER BY id), 6) AS running_accuracy FROM ({_MATCH})")
def running_accuracy(t):
    rows = E.judged(t["answers"]).withColumn("part", F.floor(F.col("id") / 1000))
    return E.running_accuracy(rows, "id", "part").select("id", F.round("running_accuracy", 6).alias("running_accuracy"))


@query("SELECT kind, judge, count(*) AS n FROM (SELECT kind, CASE kind WHEN 'temporal-reasoning' THEN 'temporal' WHEN 'knowledge-update' THEN 'update' ELSE 'default' END AS judge FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'temporal-reasoning' WHEN 1 THEN 'knowledge-update' ELSE event_type END AS kind FROM events)) GROUP BY kind, judge")
def judge_prompt_kind(t):
    kind = F.when(F.col("event_id") % 3 == 0, "temporal-reasoning").when(F.col("event_id") % 3 == 1, "knowledge-update").otherwise(F.col("event_type"))
    return t["events"].select(kind.alias("kind")).groupBy("kind", E.judge_prompt_kind(F.col("kind")).alias("judge")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, greatest(1, length(text) // 4) AS tokens FROM conversations")
def token_estimate(t):
    return t["conversations"].select("conv_id", "turn", T.token_estimate("text").alias("tokens"))


_PRICED = "SELECT *, CASE model WHEN 'small' THEN (prompt_tokens * 0.00015::double + completion_tokens * 0.0006::double) / 1000 WHEN 'large' THEN (prompt_tokens * 0.0025::double + completion_tokens * 0.01::double) / 1000 ELSE 0.0::double END AS cost FROM usage WHERE prompt_tokens + completion_tokens > 0"


def _priced(t):
    return U.priced(t["usage"], U.price_table(t.spark))


@query(f"SELECT stage, model, count(*) AS calls, cast(sum(prompt_tokens) AS bigint) AS prompt_tokens, cast(sum(completion_tokens) AS bigint) AS completion_tokens, round(sum(cost), 4) AS cost FROM ({_PRICED}) GROUP BY stage, model")
def token_costs(t):
    return U.token_costs(_priced(t), "stage", "model")


@query(f"""SELECT stage, tokens, round(cost, 6) AS cost, tokens - coalesce(lag(tokens) OVER (ORDER BY stage), 0) AS tokens_delta, round(cost - coalesce(lag(cost) OVER (ORDER BY stage), 0), 6) AS cost_delta, CASE WHEN cost >= 0.5 THEN 'exceeded' WHEN cost >= 0.4 THEN 'warning' ELSE 'ok' END AS budget_state FROM (
    SELECT stage, cast(sum(tokens) OVER (ORDER BY stage) AS bigint) AS tokens, sum(cost) OVER (ORDER BY stage) AS cost FROM (SELECT stage, sum(prompt_tokens + completion_tokens) AS tokens, sum(cost) AS cost FROM ({_PRICED}) GROUP BY stage))""")
def stage_cost_delta(t):
    from pyspark.sql import Window

    stages = _priced(t).groupBy("stage").agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum("cost").alias("cost"))
    running = Window.orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)
    totals = stages.select("stage", F.sum("tokens").over(running).cast("bigint").alias("tokens"), F.sum("cost").over(running).alias("cost"))
    return U.stage_deltas(totals, "stage", 0.5).withColumn("cost", F.round("cost", 6))


@query(f"""SELECT calls, tokens, cost, questions, accuracy, round(tokens / calls, 4) AS tokens_per_call, round(1000 * cost / tokens, 6) AS cost_per_1k, round(questions * 60 / 120.0::double, 4) AS questions_per_minute, CASE WHEN accuracy < 0.5 THEN 'improve retrieval' WHEN round(tokens / calls, 4) > 4000 THEN 'shorten prompts' ELSE 'none' END AS advice FROM (
    SELECT count(*) AS calls, cast(sum(prompt_tokens + completion_tokens) AS bigint) AS tokens, round(sum(cost), 4) AS cost FROM ({_PRICED})), (SELECT count(*) AS questions, round(count(*) FILTER (correct) / count(*), 6) AS accuracy FROM ({_MATCH}))""")
def final_report(t):
    return U.final_report(_priced(t), E.judged(t["answers"]), 120.0)


@query("""SELECT a.entity_type, a.name, b.name AS other, len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) AS jaccard FROM (
    SELECT DISTINCT entity_type, name, list_distinct(list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda w: w <> '')) AS wa FROM parts) a JOIN (SELECT DISTINCT entity_type, name, list_distinct(list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda w: w <> '')) AS wb FROM parts) b ON a.entity_type = b.entity_type AND a.name < b.name""")
def jaccard_names(t):
    names = t["parts"].select("entity_type", "name").distinct()
    rows = names.alias("a").join(names.alias("b"), F.expr("a.entity_type = b.entity_type AND a.name < b.name"))
    return rows.select("a.entity_type", "a.name", F.col("b.name").alias("other"), S.jaccard(F.col("a.name"), F.col("b.name")).alias("jaccard"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"
_JACCARD = f"len(list_intersect({_WORDS.format('a.name')}, {_WORDS.format('b.name')})) / len(list_distinct(list_concat({_WORDS.format('a.name')}, {_WORDS.format('b.name')})))"


@query(f"SELECT a.name, b.name AS other, round(CASE WHEN lower(a.name) = lower(b.name) THEN 1.0 WHEN contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name)) THEN 0.8 WHEN {_JACCARD} > 0 THEN least(1.0, {_JACCARD} + 0.2) ELSE 0.0 END, 6)::double AS similarity FROM (SELECT DISTINCT name FROM parts) a, (SELECT DISTINCT name FROM parts) b")
def name_similarity(t):
    names = t["parts"].select("name").distinct()
    return names.alias("a").crossJoin(names.alias("b")).select(F.col("a.name").alias("name"), F.col("b.name").alias("other"), F.round(S.name_similarity(F.col("a.name"), F.col("b.name")), 6).alias("similarity"))


@query("SELECT o_orderkey, round(CASE WHEN max(o_totalprice) OVER w - min(o_totalprice) OVER w < 1e-9 THEN 1.0 ELSE (o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w) END, 6) AS scaled FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def minmax_norm(t):
    from pyspark.sql import Window

    return t["orders"].select("o_orderkey", F.round(S.minmax("o_totalprice", Window.partitionBy("o_custkey")), 6).alias("scaled"))


@query("SELECT id, round(exp(-pow(gap / greatest(m, 1.0), 0.2)), 6) AS weight FROM (SELECT id, cast(abs(cast(b AS date) - DATE '1998-05-02') AS double) AS gap FROM dates), (SELECT median(cast(abs(cast(b AS date) - DATE '1998-05-02') AS double)) AS m FROM dates)")
def temporal_decay(t):
    gaps = t["dates"].select("id", T.time_gap("a", F.lit("1998/05/02")).alias("gap"))
    return gaps.crossJoin(F.broadcast(gaps.agg(F.greatest(F.median("gap"), F.lit(1.0)).alias("m")))).select("id", F.round(S.decay("gap", "m", 0.2), 6).alias("weight"))


@query("SELECT event_type, round(sum(value), 6) AS total, count(*) AS n, round(avg(value), 6) AS mean, round(100 * sum(value) / (SELECT sum(value) FROM events), 6) AS percent FROM events GROUP BY event_type")
def timer_stats(t):
    rows = U.timers(t["events"], "event_type", "value")
    return rows.select("event_type", *(F.round(c, 6).alias(c) if c != "n" else F.col(c) for c in ("total", "n", "mean", "percent")))


@query(f"SELECT id, CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE {_EXACT} END AS label FROM answers")
def judge_labels(t):
    response = F.when(F.col("id") % 3 == 0, "Yes, it is").when(F.col("id") % 3 == 1, "No.")
    return t["answers"].select("id", E.judge_label(response, F.col("expected"), F.col("output")).alias("label"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(substr(text, 1, 100), '...') ELSE text END AS preview FROM documents")
def source_preview(t):
    return t["documents"].select("doc_id", T.preview("text").alias("preview"))


@query(f"SELECT chunk_id, CASE WHEN doc_id % 2 = 0 THEN concat(session_time, ' ', text) ELSE text END AS text FROM ({_CHUNKS})")
def chunk_with_time(t):
    from .operators.context import with_time

    return C.dialog_chunks(t["turns"]).select("chunk_id", with_time(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("session_time"))).alias("text"))


@query("SELECT question_type, n, CASE WHEN question_type = 'view' THEN 'Context insufficient to answer' ELSE question_type END AS answer FROM (SELECT event_type AS question_type, count(*) AS n FROM events GROUP BY event_type)")
def default_answers(t):
    rows = t["events"].groupBy(F.col("event_type").alias("question_type")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("question_type", "n", T.answer_or_default(F.when(F.col("question_type") != "view", F.col("question_type")).otherwise("")).alias("answer"))
