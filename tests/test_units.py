from difflib import SequenceMatcher

from pyspark.sql import functions as F

from loomlog.functions import text as T
from loomlog.operators import retrieve, search, segment, sessions
from loomlog.plans import budget
from loomlog.sources import transcripts
from loomlog.streaming.terminal import Stripper, strip_bytes


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("v")).first()[0]


def test_redaction_of_each_family(spark):
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    cases = {
        f"id {key} end": "id [REDACTED:AWS_KEY] end",
        "aws_secret=" + "a" * 40: "aws_secret=[REDACTED:AWS_SECRET]",
        "sk_live_" + "a1" * 12: "[REDACTED:STRIPE]",
        "token: " + "b" * 32: "token: [REDACTED:API_KEY]",
        "http://u:pw@h/": "http://u:[REDACTED:PASSWORD]@h/",
        "password = x1": "password = [REDACTED:PASSWORD]",
        "nothing here": "nothing here",
    }
    for text, want in cases.items():
        assert one(spark, T.redact(F.col("t")), t=text) == want


def test_noise_and_quality(spark):
    assert one(spark, T.strip_noise(F.col("t")), t="a ─── b     c\n\n\n\nd Esc to cancel") == "a  b c\n\nd "
    assert one(spark, T.quality_score(F.col("t")), t="ab .") == 0.5
    assert one(spark, T.quality_score(F.col("t")), t="  ") == 0.0


def test_decay_halves(spark):
    f = T.decay_factor(F.col("t"), 14.0, 1_000_000.0)
    assert abs(one(spark, f, t=1_000_000.0 - 14 * 86400) - 0.5) < 1e-12
    assert one(spark, f, t=2_000_000.0) == 1.0


def test_ansi_over_any_cut():
    data = "a\x1b[31mré\x1b[0m\r\nb\x1b]0;t\x07c\rd".encode()
    want = "aré\nbc\nd"
    assert strip_bytes(data) == want
    for k in range(len(data)):
        s = Stripper()
        first = s.feed(data[:k])
        t = Stripper()
        t.restore(*s.state())
        assert first + t.feed(data[k:]) + t.flush() == want


def test_neighbours_both_plans(spark):
    df = spark.createDataFrame([("a", 100.0, 110.0), ("b", 111.0, 120.0), ("c", 100000.0, None)], "session_id string, started_at double, ended_at double")
    for bucketed in (False, True):
        assert sorted(map(tuple, sessions.related(df, bucketed=bucketed).collect())) == [("a", "b"), ("b", "a")]


def test_near_dedup_keeps_better(spark):
    a, b = "the quick brown fox jumps over the lazy dog " * 2, "the quick brown fox jumped over the lazy dog " * 2
    assert SequenceMatcher(None, a, b).ratio() > 0.7
    df = spark.createDataFrame([("1", a, 1.0, 0.5), ("2", b, 2.0, 0.9), ("3", "entirely different words here", 3.0, 0.9)], "chunk_id string, text string, ts_end double, quality_score double")
    assert sorted(r.chunk_id for r in retrieve.near_dedup(df).collect()) == ["2", "3"]


def test_boost_keeps_membership(spark):
    df = spark.createDataFrame([(k, [1.0, k / 10], None, float(k)) for k in range(10)], "id long, embedding array<float>, artifact_type string, ts double")
    q = search.literal([1.0, 0.0])
    plain = {r.id for r in search.top_k(df, q, 4).collect()}
    assert {r.id for r in search.top_k(df, q, 4, half_life_days=1.0, now=10.0).collect()} == plain


def test_paragraph_split(spark):
    f = segment.split_paragraphs(F.col("t"), 10)
    assert one(spark, f, t="aaaa\n\nbbbb\n\ncccc") == ["aaaa\n\nbbbb", "cccc"]
    assert one(spark, f, t="a" * 12 + "\n\n" + "b" * 23) == ["a" * 12, "b" * 10, "b" * 10, "bbb"]


def test_event_segments(spark):
    rows = [("s", 0.0, "stdout", "one\n\ntwo"), ("s", 1.0, "stdout", " more"), ("s", 2.0, "stdin", "x")]
    got = segment.segment_events(spark.createDataFrame(rows, "session_id string, ts double, stream string, content string")).orderBy("k").collect()
    assert [(r.text, r.ts_start, r.ts_end) for r in got] == [("one\n\n", 0.0, 0.0), ("two more", 0.0, 1.0)]


def test_greedy_and_sample(spark):
    df = spark.createDataFrame([("g", 1, 6), ("g", 2, 5), ("g", 3, 4)], "g string, o int, c int")
    assert budget.greedy_fit(df, "g", F.col("o"), F.col("c"), F.col("o").cast("long"), 10).first().ids == [1, 3]
    assert budget.sample_for_state([(0.1, 1, "first"), (0.9, 2, "mid"), (0.1, 3, "last"), (0.5, 4, "end")], 18) == "first\n\nmid\n\nend"


def test_transcript_lines(spark):
    lines = [
        '{"type":"user","message":{"content":"hello"},"timestamp":"2024-01-01T00:00:00Z","slug":"p"}',
        '{"type":"user","message":{"content":"<command-name>x"}}',
        '{"type":"assistant","message":{"content":[{"type":"text","text":" hi "},{"type":"tool_use"}]}}',
        '{"type":"assistant","isSidechain":true,"message":{"content":"no"}}',
        "broken",
    ]
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(lines)], "session_id string, line long, value string")
    got = transcripts.parse(df).orderBy("line").collect()
    assert [(r.role, r.text) for r in got] == [("user", "hello"), ("assistant", "hi")]
