"""The registered queries on the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index, retrieve, search, segment, sessions
from ..session import importable
from ..sources import files, store
from . import budget, pack

NOW = 1_706_745_600.0  # the end of the events table's month
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


SPACE = r"[\s\x1C-\x1F\x{85}\p{Z}]"
QUALITY = rf"CASE WHEN length(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')) > 0 THEN round_even(length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) / length(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')), 3) ELSE 0.0 END"
KEY = rf"trim(regexp_replace(lower(text), '{SPACE}+', ' ', 'g'))"


@query(f"SELECT doc_id, {QUALITY} AS quality FROM documents")
def quality_score_docs(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.quality_score(F.col("text")).alias("quality"))


@query("SELECT doc_id, CAST(floor(length(text) / 4 * 1.1) AS INTEGER) AS budget_tokens, CAST(length(text) // 4 AS INTEGER) AS chunk_tokens FROM documents")
def token_estimates(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.budget_tokens(F.col("text")).alias("budget_tokens"), T.chunk_tokens(F.col("text")).alias("chunk_tokens"))


@query(f"SELECT doc_id, q AS quality FROM (SELECT doc_id, text, {QUALITY} AS q FROM documents) WHERE length(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')) >= 30 AND q >= 0.30")
def doc_filter_min_len_quality(spark, d):
    q = T.quality_score(F.col("text"))
    return _t(spark, d, "documents").where(F.length(T.strip(F.col("text"))) >= 30).select("doc_id", q.alias("quality")).where("quality >= 0.30")


def _redact_sql(column: str) -> str:
    out = column
    for pattern, label in T.SECRETS:
        quoted = pattern.replace("'", "''").replace('\\"', '"')
        out = f"regexp_replace({out}, '{quoted}', '\\1[REDACTED:{label}]\\3', 'g')"
    return out


@query(f"SELECT doc_id, {_redact_sql('text')} AS redacted FROM documents")
def redact_docs(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("redacted"))


def _noise_sql(column: str) -> str:
    out = f"regexp_replace({column}, '\\r\\n?', chr(10), 'g')"
    out = f"regexp_replace({out}, '{T.NOISE_CHARACTERS}', '', 'g')"
    said = "|".join(T.NOISE_PHRASES).replace(r"\s", SPACE).replace(r"\w", r"[\p{L}\p{N}_]")
    out = f"regexp_replace({out}, '(?:{said})', '', 'gi')"
    out = f"regexp_replace({out}, '[\\t\\x0B\\f\\r\\x1C-\\x1F\\x{{85}}\\p{{Z}}]{{3,}}', ' ', 'g')"
    return f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT doc_id, {_noise_sql('text')} AS cleaned FROM documents")
def strip_noise_docs(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.strip_noise(T.unix_newlines(F.col("text"))).alias("cleaned"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents")
def xml_escape_docs(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.xml_escape(F.col("text")).alias("escaped"))


def _chunks(spark, d) -> DataFrame:
    """documents as chunks: a chunk each, its source as session, its id as time in hours before NOW."""
    return _t(spark, d, "documents").select(
        F.concat(F.lit("c"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("chunk_id"), F.col("source").alias("session_id"), F.col("doc_id").alias("index"), "text",
        (NOW - F.col("doc_id") * 3600.0).alias("ts_start"), (NOW - F.col("doc_id") * 3600.0 + 90.0).alias("ts_end"), T.quality_score(F.col("text")).alias("quality_score"),
    )


CHUNKS = f"(SELECT 'c' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS chunk_id, source AS session_id, doc_id AS index, text, {NOW} - doc_id * 3600.0 AS ts_start, {NOW} - doc_id * 3600.0 + 90.0 AS ts_end, {QUALITY} AS quality_score FROM documents)"


@query(f"SELECT chunk_id FROM (SELECT chunk_id, row_number() OVER (PARTITION BY {KEY} ORDER BY quality_score DESC, ts_end DESC, chunk_id) AS r FROM {CHUNKS}) WHERE r = 1")
def exact_dedup(spark, d):
    return retrieve.exact_dedup(_chunks(spark, d)).select("chunk_id")


DECAY = f"CASE WHEN ({NOW} - ts_end) / 86400.0 <= 0 THEN 1.0 ELSE exp(-(({NOW} - ts_end) / 86400.0) * 0.6931471805599453 / 14.0) END"


@query(f"SELECT chunk_id, round(q_eff, 6) AS q_eff FROM (SELECT *, quality_score * {DECAY} AS q_eff FROM {CHUNKS}) WHERE length(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')) >= 30 AND q_eff >= 0.30 ORDER BY q_eff DESC, ts_end DESC, chunk_id LIMIT 200")
def recency_topk(spark, d):
    return retrieve.recent(_chunks(spark, d), 14.0, NOW).select("chunk_id", F.round("q_eff", 6).alias("q_eff"))


@query()
def near_dedup_topn(spark, d):
    return retrieve.near_dedup(retrieve.recent(_chunks(spark, d), 14.0, NOW)).select("chunk_id", "ts_end")


TURNS = "(SELECT conv_id, turn_number, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) || chr(10) ORDER BY turn) AS full_text, count(*) AS n FROM (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_number FROM conversations WHERE role IN ('user', 'assistant')) WHERE turn_number > 0 GROUP BY ALL)"


@query(f"SELECT conv_id, turn_number, full_text FROM {TURNS}")
def turn_assembly(spark, d):
    return segment.turns(_t(spark, d, "conversations"))


@query(f"SELECT conv_id, count(*) AS turns, CAST(sum(length(full_text)) AS BIGINT) AS chars FROM {TURNS} GROUP BY conv_id")
def turn_stats(spark, d):
    return segment.turns(_t(spark, d, "conversations")).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("full_text")).cast("long").alias("chars"))


@query()
def turn_chunks(spark, d):
    return segment.chunks_of_turns(segment.turns(_t(spark, d, "conversations")))


@query("SELECT doc_id, CAST(k AS INTEGER) AS k, CASE WHEN k = 0 THEN '' ELSE right(substr(text, (k - 1) * 2048 + 1, 2048), 200) END || substr(text, k * 2048 + 1, 2048) AS text FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, CAST(ceil(length(text) / 2048.0) AS BIGINT) - 1))) AS k FROM documents)")
def forced_split_overlap(spark, d):
    return segment.forced_split(_t(spark, d, "documents"), "doc_id")


def _index(spark, d) -> DataFrame:
    kind = F.when(F.col("label") != 0, F.concat(F.lit("t"), F.col("label").cast("string")))
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", kind.alias("artifact_type"), (NOW - F.col("vec_id") * 43200.0).alias("ts"), F.concat(F.lit("p"), (F.col("vec_id") % 3).cast("string")).alias("project_path"))


def _query_vector(spark, d) -> list[float]:
    row = _t(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return search.literal(row[0] if row else [])


INDEX = f"(SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s, CASE WHEN label <> 0 THEN 't' || label END AS artifact_type, {NOW} - vec_id * 43200.0 AS ts, 'p' || (vec_id % 3) AS project_path FROM embeddings)"


@query(f"SELECT id, round(s, 6) AS score FROM {INDEX} ORDER BY s DESC, id LIMIT 10")
def vector_topk(spark, d):
    return search.top_k(_index(spark, d), _query_vector(spark, d), 10).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round(s, 6) AS score FROM {INDEX} WHERE artifact_type IS NULL ORDER BY s DESC, id LIMIT 10")
def vector_topk_sessions(spark, d):
    return search.top_k(_index(spark, d), _query_vector(spark, d), 10, "session").select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round(s, 6) AS score FROM {INDEX} WHERE artifact_type = 't3' ORDER BY s DESC, id LIMIT 10")
def vector_topk_by_label(spark, d):
    return search.top_k(_index(spark, d), _query_vector(spark, d), 10, "t3").select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round(CASE WHEN artifact_type IS NULL THEN s * (1 + 0.1 * exp(-(({NOW} - ts) / 86400.0) * 0.6931471805599453 / 14.0)) ELSE s END, 6) AS score FROM (SELECT * FROM {INDEX} ORDER BY s DESC, id LIMIT 10)")
def vector_topk_decay(spark, d):
    return search.top_k(_index(spark, d), _query_vector(spark, d), 10, half_life_days=14.0, now=NOW).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round(s, 6) AS score FROM (SELECT * FROM {INDEX} ORDER BY s DESC, id LIMIT 15) WHERE s >= 0.35")
def vector_floor(spark, d):
    return search.top_k(_index(spark, d), _query_vector(spark, d), 15, floor=0.35).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, project_path, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY project_path ORDER BY s DESC, id) AS r FROM {INDEX}) WHERE r <= 5 ORDER BY s DESC, id LIMIT 5")
def vector_global_merge(spark, d):
    return search.top_k_across(_index(spark, d), _query_vector(spark, d), 5).select("id", "project_path", F.round("score", 6).alias("score"))


@query("SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS INTEGER) AS rank FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 5")
def knn_all_pairs(spark, d):
    e = _t(spark, d, "embeddings")
    found = search.nearest(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding"), 5)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


GAP = 21600
SESS = f"(SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= {{gap}} * CAST(1000000 AS BIGINT) THEN 1 ELSE 0 END AS st FROM events))"


@query(f"SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM {SESS.format(gap=600)} GROUP BY ALL")
def sessionize_events(spark, d):
    return sessions.sessionize(_t(spark, d, "events"), "user_id", "ts", 600).groupBy("user_id", "session").agg(F.count("*").alias("n"))


def _sessions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Sessions of events (six hours' gap) with an exit code if any event is an error, and events as their chunks."""
    ev = sessions.sessionize(_t(spark, d, "events"), "user_id", "ts", GAP)
    sid = F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit("-"), F.lpad(F.col("session").cast("string"), 6, "0"))
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ev = ev.select(sid.alias("session_id"), sec.alias("sec"), "event_type", "event_id", "props")
    # a neighbour test on seconds from the table's start needs no calendar
    meta = ev.groupBy("session_id").agg(F.min("sec").alias("started_at"), F.max("sec").alias("ended_at"), F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("exit_code"))
    meta = meta.withColumn("command", F.when(F.col("exit_code") == 1, F.array(F.lit("cargo"), F.lit("test"))).otherwise(F.array(F.lit("/usr/bin/make"))))
    text = F.concat(F.when(F.col("event_type") == "error", "ERROR: event ").otherwise("event "), F.col("event_id").cast("string"))
    chunks = ev.select(F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("chunk_id"), "session_id", F.col("event_id").alias("index"), text.alias("text"), F.col("sec").alias("ts_start"), F.col("sec").alias("ts_end"), F.lit(1.0).alias("quality_score"))
    return meta, chunks


META = f"(SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '-' || lpad(CAST(CAST(session AS BIGINT) AS VARCHAR), 6, '0') AS session_id, min(epoch_us(ts)) / 1e6 AS started_at, max(epoch_us(ts)) / 1e6 AS ended_at, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS exit_code FROM {SESS.format(gap=GAP)} GROUP BY user_id, session)"
NEAR = f"(SELECT a.session_id AS src, b.session_id AS dst FROM {META} a JOIN {META} b ON a.session_id <> b.session_id AND least(abs(a.started_at - b.ended_at), abs(b.started_at - a.ended_at), abs(a.started_at - b.started_at)) <= 600)"
EV = f"(SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '-' || lpad(CAST(CAST(session AS BIGINT) AS VARCHAR), 6, '0') AS session_id, event_id, ts, event_type FROM {SESS.format(gap=GAP)})"


@query(f"SELECT session_id, exit_code = 1 AS has_error FROM {META}")
def session_errors(spark, d):
    meta, chunks = _sessions(spark, d)
    return sessions.errors(meta, chunks).select("session_id", "has_error")


@query(f"SELECT session_id FROM {META} WHERE exit_code = 1 ORDER BY started_at DESC, session_id LIMIT 1")
def latest_error_session(spark, d):
    return pack.latest_error(*_sessions(spark, d)).select("session_id")


@query(f"SELECT src, dst FROM {NEAR}")
def related_sessions(spark, d):
    return sessions.related(_sessions(spark, d)[0], bucketed=True)


@query(f"SELECT 'e' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS chunk_id FROM {EV} WHERE session_id IN (SELECT 'u000000001-000001' UNION SELECT dst FROM {NEAR} WHERE src = 'u000000001-000001') ORDER BY ts DESC, event_id LIMIT 200")
def around_failure(spark, d):
    meta, chunks = _sessions(spark, d)
    return sessions.around_failure(meta, chunks, "u000000001-000001").select("chunk_id")


@query(f"SELECT m.session_id, CASE WHEN exit_code = 1 THEN 'test' ELSE 'build' END AS episode_type, exit_code = 1 AS has_error, coalesce(n.related, 0) AS related FROM {META} m LEFT JOIN (SELECT src, count(*) AS related FROM {NEAR} GROUP BY src) n ON m.session_id = n.src")
def session_graph(spark, d):
    g = sessions.graph(*_sessions(spark, d), bucketed=True)
    return g.select("session_id", "episode_type", "has_error", F.size("related_sessions").cast("long").alias("related"))


@query(f"SELECT session_id, 'Exit code 1; ' || array_to_string(list(line ORDER BY event_id)[1:2], '; ') AS error_summary FROM (SELECT session_id, event_id, 'ERROR: event ' || event_id AS line FROM {EV} WHERE event_type = 'error') GROUP BY session_id")
def error_summary(spark, d):
    meta, chunks = _sessions(spark, d)
    return sessions.errors(meta, chunks).where("has_error").select("session_id", "error_summary")


def _scores_sql() -> str:
    return ", ".join(f"CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS \"{n}\"" for n, p in sessions.EPISODES.items())


def _best_sql() -> str:
    names = list(sessions.EPISODES)
    most = "greatest(" + ", ".join(f'"{n}"' for n in names) + ")"
    return "CASE WHEN " + most + " = 0 THEN 'refactor' " + " ".join(f"WHEN \"{n}\" = {most} THEN '{n}'" for n in names) + " END"


@query(f"SELECT *, {_best_sql()} AS episode FROM (SELECT conv_id, {_scores_sql()} FROM conversations GROUP BY conv_id)")
def episode_content_scores(spark, d):
    return sessions.content_scores(_t(spark, d, "conversations"), "conv_id")


ARGV = [
    (["make"], "build"), (["cmake", "."], "build"), (["cargo", "build"], "build"), (["cargo", "test"], "test"), (["go", "test"], "test"), (["npm", "run", "x"], "build"), (["npm", "test"], "test"),
    (["docker", "push"], "deploy"), (["docker", "build"], "build"), (["/usr/bin/pytest"], "test"), (["jest"], "test"), (["python", "-m", "pytest"], "test"), (["python", "-m", "pdb"], "debug"),
    (["kubectl", "apply"], "deploy"), (["terraform"], "deploy"), (["gdb", "a"], "debug"), (["make", "test"], "test"), (["foo", "run", "test"], "test"), (["bash"], "build"), ([], "build"), (["claude"], "refactor"), (["ansible"], "deploy"), (["python", "x.py"], "build"),
]


@query("SELECT CAST(k AS INTEGER) AS k, e AS episode FROM (VALUES " + ", ".join(f"({k}, '{e}')" for k, (_, e) in enumerate(ARGV)) + ") v(k, e)")
def episode_command(spark, d):
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(ARGV)], "k int, command array<string>")
    return df.select("k", sessions.episode_of_command().alias("episode"))


@query(f"SELECT event_id, round(CASE WHEN age <= 0 THEN 1.0 ELSE exp(-age * 0.6931471805599453 / 14.0) END, 6) AS decay FROM (SELECT event_id, ({NOW} - epoch_us(ts) / 1e6) / 86400.0 AS age FROM events)")
def decay_curve(spark, d):
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return _t(spark, d, "events").select("event_id", F.round(T.decay_factor(sec, 14.0, NOW), 6).alias("decay"))


@query("SELECT doc_id, 'new' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'known' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_anti_incremental(spark, d):
    docs, labels = _t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels")
    return store.new_only(docs, labels, "doc_id").withColumn("kind", F.lit("new")).unionByName(store.of_project(docs, labels, "doc_id").withColumn("kind", F.lit("known")))


RANK = {"1-URGENT": 0, "2-HIGH": 0, "4-NOT SPECIFIED": 2, "5-LOW": 2}


@query("SELECT o_orderkey, CAST(p AS INTEGER) AS p FROM (SELECT o_orderkey, o_orderdate, o_orderstatus, CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RANK.items()) + " ELSE 1 END AS p FROM orders WHERE o_orderstatus <> 'F') ORDER BY p, o_orderdate DESC, o_orderkey LIMIT 100")
def priority_sort_active(spark, d):
    p = F.coalesce(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))[F.col("o_orderpriority")], F.lit(1))
    return _t(spark, d, "orders").where("o_orderstatus <> 'F'").withColumn("p", p).orderBy("p", F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", F.col("p").cast("int"))


@query(f"SELECT chunk_id, CAST(used AS BIGINT) AS used FROM (SELECT chunk_id, sum(CAST(floor(length(text) / 4 * 1.1) AS BIGINT)) OVER (ORDER BY ts_end DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT * FROM {CHUNKS} ORDER BY ts_end DESC, chunk_id LIMIT 200)) WHERE used <= 6000")
def budget_prefix(spark, d):
    top = _chunks(spark, d).orderBy(F.desc("ts_end"), "chunk_id").limit(200)
    return budget.fitting_prefix(top, [F.desc("ts_end"), F.col("chunk_id")], 6000, T.budget_tokens(F.col("text"))).select("chunk_id", F.col("used").cast("long"))


@query("WITH RECURSIVE o AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), walk AS (SELECT o_custkey, CAST(0 AS BIGINT) AS k, CAST(300000 AS BIGINT) AS room, 0 AS n FROM o WHERE k = 1 UNION ALL SELECT o.o_custkey, o.k, w.room - CASE WHEN CAST(trunc(o_totalprice) AS BIGINT) <= w.room THEN CAST(trunc(o_totalprice) AS BIGINT) ELSE 0 END, w.n + CASE WHEN CAST(trunc(o_totalprice) AS BIGINT) <= w.room THEN 1 ELSE 0 END FROM walk w JOIN o ON o.o_custkey = w.o_custkey AND o.k = w.k + 1) SELECT o_custkey, CAST(arg_max(n, k) AS INTEGER) AS n FROM walk GROUP BY o_custkey")
def budget_greedy(spark, d):
    docs = _t(spark, d, "orders")
    return budget.greedy_fit(docs, "o_custkey", F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderkey"), 300_000).select("o_custkey", F.size("ids").alias("n"))


@query()
def state_sample(spark, d):
    text = budget.sample_of_all(_chunks(spark, d))
    return spark.createDataFrame([(text,)], "state string")


@query("SELECT 2 AS plans, 2 AS todo_files, 2 AS active_todos, 1 AS task_dirs, 1 AS pending_tasks")
def artifact_counts(spark, d):
    item = "struct<content:string,status:string,priority:string>"
    todos = spark.createDataFrame([("s1", [("a", "pending", "high"), ("b", "completed", "low")]), ("s2", [("c", "in_progress", "medium")])], f"session_id string, items array<{item}>")
    tasks = spark.createDataFrame([("s1", "1", "pending"), ("s1", "2", "completed")], "session_id string, id string, status string")
    plans = spark.createDataFrame([("p1",), ("p2",)], "slug string")
    out = store.artifact_counts(todos, tasks, plans)
    return out.select(*(F.col(c).cast("int").alias(c) for c in out.columns))


TOP = f"(SELECT * FROM {CHUNKS} ORDER BY ts_end DESC, chunk_id LIMIT 20)"
ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _top(spark, d):
    return _chunks(spark, d).orderBy(F.desc("ts_end"), "chunk_id").limit(20)


@query(f"SELECT chunk_id, '    <EXCERPT session=\"' || {ESC.format('session_id')} || '\">' || chr(10) || {ESC.format('text')} || chr(10) || '    </EXCERPT>' AS fragment FROM {TOP}")
def render_excerpts_xml(spark, d):
    return pack.excerpts_xml(_top(spark, d))


@query(f"SELECT chunk_id, CAST(json_object('session_id', session_id, 'text', text) AS VARCHAR) AS fragment FROM {TOP}")
def render_excerpts_json(spark, d):
    return pack.excerpts_json(_top(spark, d))


@query(f"SELECT chunk_id, '### ' || session_id || ' (01:30)' || chr(10) || text AS fragment FROM {TOP}")
def render_excerpts_md(spark, d):
    return pack.excerpts_markdown(_top(spark, d))


@query()
def context_pack(spark, d):
    meta, chunks = _sessions(spark, d)
    text = pack.build(meta, chunks, {"summary": "Events of a month", "decisions": [], "constraints": [], "tasks": []}, budget=2000, mode="debug", now=NOW)
    return spark.createDataFrame([(text,)], "pack string")


@query("SELECT event_id, substr(sha256('s' || user_id || ':' || event_id), 1, 16) AS generated FROM events")
def event_ids(spark, d):
    return _t(spark, d, "events").select("event_id", T.event_id(F.concat(F.lit("s"), F.col("user_id").cast("string")), F.col("event_id").cast("string")).alias("generated"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN substr(sha256('s' || user_id || ':' || event_id), 1, 16) ELSE 'kept-' || event_id END AS filled FROM events")
def migrate_backfill(spark, d):
    e = _t(spark, d, "events")
    old = e.select(F.col("event_id").alias("n"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("kept-"), F.col("event_id").cast("string"))).alias("event_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").cast("string").alias("ts_text"))
    return store.backfill_event_ids(old).select(F.col("n").alias("event_id"), F.col("event_id").alias("filled"))


@query("SELECT k AS mode, CAST(round(x, 6) AS DOUBLE) AS recent_context FROM (VALUES ('auto', 0.40), ('debug', 0.75), ('build', 0.25), ('explore', 0.40)) v(k, x)")
def mode_profile(spark, d):
    return spark.createDataFrame([(m, round(budget.profile(m)["recent_context"], 6)) for m in budget.PROFILES], "mode string, recent_context double")


@query("SELECT event_id, count(*) AS keys FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events) GROUP BY event_id")
def json_props(spark, d):
    return _t(spark, d, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("k")).groupBy("event_id").agg(F.count("*").alias("keys"))


@query(f"SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 3 THEN 'recent' ELSE 'old' END AS age FROM events")
def latest_per_user(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return _t(spark, d, "events").select("event_id", F.when(F.row_number().over(w) <= 3, "recent").otherwise("old").alias("age"))


ITEMS = "(SELECT CASE WHEN event_id % 2 = 0 THEN 'todo' ELSE 'task' END AS kind, 'u' || user_id AS session_id, epoch_us(ts) / 1e6 AS mtime, event_id AS n, CASE WHEN event_type = 'error' THEN 'pending' WHEN event_id % 7 = 0 THEN 'in_progress' ELSE 'completed' END AS status, CASE WHEN event_id % 5 = 0 THEN 'high' WHEN event_id % 5 = 1 THEN 'low' WHEN event_id % 5 = 2 THEN 'other' ELSE 'medium' END AS priority FROM events)"


@query(f"SELECT kind, n, CAST(row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, kind DESC, place, n) AS INTEGER) AS rank FROM {ITEMS} i JOIN (SELECT kind, session_id, row_number() OVER (PARTITION BY kind ORDER BY max(mtime) DESC, session_id) AS place FROM {ITEMS} WHERE status <> 'completed' GROUP BY kind, session_id) s USING (kind, session_id) WHERE place <= 5 AND status <> 'completed'")
def active_items(spark, d):
    """Events as todo and task items of users as sessions."""
    e, i = _t(spark, d, "events"), F.col("event_id")
    status = F.when(F.col("event_type") == "error", "pending").when(i % 7 == 0, "in_progress").otherwise("completed")
    priority = F.when(i % 5 == 0, "high").when(i % 5 == 1, "low").when(i % 5 == 2, "other").otherwise("medium")
    items = e.select(F.when(i % 2 == 0, "todo").otherwise("task").alias("kind"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("mtime"), i.alias("n"), status.alias("status"), priority.alias("priority"))
    out = files.active_items(items)
    rank = F.row_number().over(Window.orderBy(F.when(F.col("priority") == "high", 0).when(F.col("priority") == "low", 2).otherwise(1), F.desc("kind"), "place", "n"))  # the items of ten sessions
    return out.select("kind", "n", rank.alias("rank"))


@query("SELECT d.doc_id AS external_id, 's' || l.doc_id AS session_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN d.n_chars IS DISTINCT FROM CASE WHEN l.quality = 1 THEN d.n_chars ELSE 0 END THEN 'grown' ELSE 'same' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)")
def import_plan(spark, d):
    """Documents as external sessions; labelled ones are known, with the size they have if their quality is 1."""
    docs, labels = _t(spark, d, "documents").select("doc_id", "n_chars"), _t(spark, d, "labels")
    known = labels.join(docs, "doc_id").select(F.col("doc_id").alias("external_id"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("session_id"), F.when(F.col("quality") == 1, F.col("n_chars")).otherwise(0).alias("size"))
    return files.changed(docs.select(F.col("doc_id").alias("external_id"), F.col("n_chars").alias("size")), known).select("external_id", "session_id", "action")


@query("SELECT count(CASE WHEN kind = 'session' AND fresh THEN 1 END) AS imported, count(CASE WHEN kind = 'session' AND NOT fresh THEN 1 END) AS skipped, count(CASE WHEN kind = 'plan' AND fresh THEN 1 END) AS plans, count(CASE WHEN kind = 'todo' AND fresh THEN 1 END) AS todos, count(CASE WHEN kind = 'task' AND fresh THEN 1 END) AS tasks FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'session' WHEN 1 THEN 'plan' WHEN 2 THEN 'todo' ELSE 'task' END AS kind, doc_id NOT IN (SELECT doc_id FROM labels) AS fresh FROM documents)")
def import_counts(spark, d):
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    kind = F.element_at(F.array(*map(F.lit, ("session", "plan", "todo", "task"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return files.import_counts(docs.join(labels, "doc_id", "left").select(kind.alias("kind"), F.when(F.col("known"), "same").otherwise("new").alias("action")))


@query(f"SELECT session_id, min(ts_end) AS ts_end FROM {CHUNKS} WHERE quality_score >= 0.3 AND trim(text) <> '' GROUP BY session_id")
def state_sources(spark, d):
    return budget.sources_in_order(_chunks(spark, d).where("quality_score >= 0.3 and trim(text) <> ''"))


@query("SELECT pack, name, CASE WHEN protected OR total <= 150 OR got >= t THEN content ELSE substr(content, 1, CAST(floor(got * 4 / 1.1) AS BIGINT)) END AS content FROM (SELECT *, least(t, greatest(0, greatest(0, 150 - held) - coalesce(before, 0))) AS got FROM (SELECT *, sum(t) OVER (PARTITION BY pack) AS total, sum(CASE WHEN protected THEN t ELSE 0 END) OVER (PARTITION BY pack) AS held, sum(CASE WHEN protected THEN 0 ELSE t END) OVER (PARTITION BY pack ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT conv_id AS pack, 't' || turn AS name, turn, text AS content, role = 'system' AS protected, CAST(floor(length(text) / 4 * 1.1) AS BIGINT) AS t FROM conversations)))")
def section_budget(spark, d):
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("pack"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("name"), F.col("text").alias("content"), F.col("turn").alias("priority"), (F.col("role") == "system").alias("protected"), F.lit(0).alias("max_tokens"))
    return budget.fill_sections(rows, 150).select("pack", "name", "content")


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(replace(text, chr(10), ' '), 1, 200) || '...' ELSE replace(text, chr(10), ' ') END AS snippet FROM documents")
def snippets(spark, d):
    return _t(spark, d, "documents").select("doc_id", index.snippet(F.col("text")).alias("snippet"))
