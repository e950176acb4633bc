"""Files, index, state and sinks on small folders against plain Python."""

import json
import os
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.functions import text as T
from loomlog.operators import index, search, segment
from loomlog.plans import budget
from loomlog.sources import files, store


def put(root, name, text, mtime=None):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if mtime:
        os.utime(path, (mtime, mtime))


def test_discovery(spark, tmp_path):
    for name, text in (("p/b.jsonl", "{}"), ("p/a.jsonl", "{}"), ("p/agent-x.jsonl", "{}"), ("t/a-agent-a.json", "[1]"), ("t/b-agent-b.json", ""), ("t/z-agent-z.json", "[1]"), ("k/a/1.json", "{}"), ("k/z/1.json", "{}"), ("plans/red-fox.md", "x"), ("plans/blue-cat.md", "y")):
        put(tmp_path, name, text)
    sessions = files.transcripts(files.listing(spark, f"{tmp_path}/p")).select(F.col("stem").alias("session_id"))
    assert sorted(r[0] for r in sessions.collect()) == ["a", "b"]
    assert [r["session_id"] for r in files.todos_of(files.listing(spark, f"{tmp_path}/t"), sessions).collect()] == ["a"]
    assert [r[0] for r in files.task_folders_of(files.listing(spark, f"{tmp_path}/k"), sessions).collect()] == ["a"]
    slugs = spark.createDataFrame([("red-fox",), ("none",)], "slug string")
    assert [r["slug"] for r in files.plans_of(files.listing(spark, f"{tmp_path}/plans"), slugs).collect()] == ["red-fox"]
    lines = spark.createDataFrame([("b", "s"), ("a", "s"), ("c", None), ("a", "s")], "session_id string, slug string")
    assert [r[0] for r in files.sessions_with_slug(lines, "s").collect()] == ["a", "b"]
    plans = spark.createDataFrame([(f"p{k}", "t", float(k)) for k in range(6)], "slug string, text string, mtime double")
    assert [r["slug"] for r in files.recent_plans(plans).collect()] == ["p5", "p4", "p3"]


def test_staleness_and_json(spark, tmp_path):
    put(tmp_path, "c/chunks.jsonl", "{}", 1000)
    listed = files.listing(spark, f"{tmp_path}/c")
    assert files.stale(listed, 999) and not files.stale(listed, 1000) and files.stale(listed, None) and not files.stale(listed.where("false"), None)
    path = f"{tmp_path}/state/s.json"
    assert files.read_json(spark, path, {"a": 1}) == {"a": 1}
    files.write_json(spark, path, {"ä": [1, None]})
    assert files.read_json(spark, path) == {"ä": [1, None]} == json.loads(open(path).read())
    put(tmp_path, "bad.json", "{")
    assert files.read_json(spark, f"{tmp_path}/bad.json", 5) == 5
    with pytest.raises(ValueError):
        files.read_json(spark, f"{tmp_path}/bad.json", strict=True)
    reg = files.Registry(spark, f"{tmp_path}/reg/projects.json")
    reg.register("/a", 1.0)
    reg.register("/a", 2.0)
    reg.register("/b", 3.0)
    reg.update("/b", 4.0, 7)
    assert [tuple(r) for r in reg.projects().collect()] == [("/a", 1.0, None, 0), ("/b", 3.0, 4.0, 7)]
    assert reg.remove("/a") and not reg.remove("/a") and reg.projects().count() == 1


def test_sessions_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.create_session("s1", ["make"], "/x", 10.0, "pty")
    s.create_session("s2", ["ls"], "/x", 20.0)
    s.finalize_session("s1", 15.0, 2)
    assert [(r["session_id"], r["exit_code"], r["ended_at"]) for r in s.session("s1").collect()] == [("s1", 2, 15.0)] and s.session("none").count() == 0
    put(tmp_path, "sessions/s1/chunks.jsonl", '{"chunk_id": "c"}')
    assert [r["session_id"] for r in s.without_chunks().collect()] == ["s2"]
    chunk = spark.createDataFrame([("k1", "s1", 0, "t")], "chunk_id string, session_id string, index int, text string")
    s.append_artifact_chunks(chunk)
    s.append_artifact_chunks(chunk.withColumn("chunk_id", F.lit("k2")))
    assert sorted(r["chunk_id"] for r in s.artifact_chunks().collect()) == ["k1", "k2"]
    s.write_artifact("todos", "s1", [{"content": "x"}])
    assert files.read_json(spark, f"{tmp_path}/artifacts/todos/s1.json") == [{"content": "x"}]
    assert s.delete_session("s2") and not s.delete_session("s2") and [r["session_id"] for r in s.sessions().collect()] == ["s1"]
    for bad in ("", "..", "a/b"):
        with pytest.raises(ValueError):
            s.delete_session(bad)


def test_index(spark, tmp_path):
    embed, ix = index.hashing_embedder(32), index.Index(spark, f"{tmp_path}/ix")
    texts = ["red fox runs", "red fox sleeps", "blue cat runs", "green frog", "  ", "a plan of a fox"]
    chunks = spark.createDataFrame([(f"c{k}", f"s{k // 2}", t, float(k), "plan" if k == 5 else None) for k, t in enumerate(texts)], "chunk_id string, session_id string, text string, ts_end double, artifact_type string")
    assert ix.build(chunks.where("session_id = 's0'"), embed).count() == 2
    assert sorted(r["id"] for r in ix.build(chunks, embed).collect()) == ["c2", "c3", "c5"] and ix.build(chunks, embed).count() == 0
    assert sorted(r[0] for r in ix.sessions().collect()) == ["s0", "s1", "s2"] and "embedding" not in ix.metadata().columns
    v = {f"c{k}": np.array(x) for k, x in enumerate(embed(texts))}
    q = np.array(embed(["red fox"])[0])
    want = sorted(((-float(v[k] @ q), k) for k in v if k != "c4"))[:3]
    got = [(r["id"], r["score"]) for r in ix.search("red fox", embed, 3, floor=None).collect()]
    assert [k for k, _ in got] == [k for _, k in want] and np.allclose([s for _, s in got], [-s for s, _ in want], atol=1e-6)
    assert [r["id"] for r in ix.search("red fox", embed, 3, artifact_type="plan", floor=None).collect()] == ["c5"]
    judged = ix.search("red fox", embed, 1, judge=lambda ts: [10.0 if "frog" in t else 0.0 for t in ts], floor=None)
    assert judged.count() == 1
    assert ix.rebuild(chunks, embed) == (5, 3)


def test_boost_sorts_again(spark):
    rows = [(1, [1.0, 0.0], None, 0.0), (2, [1.0, 0.02], None, 100 * 86400.0), (3, [0.0, 1.0], None, 0.0)]
    got = search.top_k(spark.createDataFrame(rows, "id int, embedding array<double>, artifact_type string, ts double"), search.literal([1.0, 0.0]), 2, half_life_days=1.0, now=100 * 86400.0).collect()
    assert [r["id"] for r in got] == [2, 1]


def test_legacy_vectors(spark, tmp_path):
    v = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "vectors.bin").write_bytes(v.tobytes() + struct.pack("<f", 1.0))
    meta = spark.createDataFrame([(0, "a"), (1, "b")], "row long, id string")
    got = index.with_metadata(index.legacy_vectors(spark, f"{tmp_path}/vectors.bin", 4), meta).orderBy("row").collect()
    assert [(r["id"], list(r["embedding"])) for r in got] == [("a", [0, 1, 2, 3]), ("b", [4, 5, 6, 7])]


def test_chunks_of_sessions(spark):
    events = spark.createDataFrame([("t1", "stdout", 0.0, "x" * 2500), ("t1", "stdout", 1.0, "a\n\nb"), ("t1", "stdin", 2.0, "no"), ("m1", "stdout", 0.0, "unused")], "session_id string, stream string, ts double, content string")
    said = spark.createDataFrame([("m1", 0, "user", "hi"), ("m1", 1, "assistant", "ho")], "session_id string, turn int, role string, text string")
    got = segment.chunk_sessions(spark.createDataFrame([("t1",), ("m1",), ("none",)], "session_id string"), events, said).orderBy("session_id", "index").collect()
    assert [(r["chunk_id"], r["text"]) for r in got] == [("m1-0", "User: hi\n\nAssistant: ho"), ("t1-0", "x" * 2048), ("t1-1", "x" * 200 + "x" * 452 + "a\n\n"), ("t1-2", ("x" * 452 + "a\n\n")[-200:] + "b")]
    todos = spark.createDataFrame([("s", [("c", "pending", "high")], 5.0), ("e", [], 5.0)], "session_id string, items array<struct<content:string,status:string,priority:string>>, mtime double")
    assert [(r["chunk_id"], r["text"]) for r in segment.todo_chunks(todos).collect()] == [("todo-s-0", "[TODO] pending (high): c")]
    tasks = spark.createDataFrame([("s", "12", "Do", "open", "", ["2"], []), ("s", "x", "So", "open", "D", [], [])], "session_id string, id string, subject string, status string, description string, blocks array<string>, blocked_by array<string>")
    assert [(r["index"], r["text"]) for r in segment.task_chunks(tasks).collect()] == [(12, "[TASK] Do (open)\nBlocks: 2"), (0, "[TASK] So (open)\nD")]


@pytest.mark.parametrize("pattern", [r"key=((?:ab)\d+)", r"k\(=(\w+)", r"tok[(]([a-z]((x)|y))z", r"plain\d+", r"(?i)KEY:(\w+);", r"(a(b)c)d(e)"])
def test_extra_patterns(spark, pattern):
    text = "key=ab12 x k(=word tok(ayz tok(bxz plain77 key:abc; abcde"
    def cover(m):
        a, b = m.span(1) if m.re.groups else m.span()
        return m[0][: a - m.start()] + "[REDACTED:K]" + m[0][b - m.start() :]
    row = spark.createDataFrame([(text,)], "t string").select(T.redact(F.col("t"), [(pattern, "K")])).first()
    assert row[0] == re.sub(pattern, cover, text)


def test_state_and_sections(spark):
    assert budget.sample_for_state([(0.5, 1.0, "a" * 10), (0.9, 2.0, "b" * 8), (0.4, 3.0, "c" * 10), (0.3, 2.5, "d" * 30)], 31) == "\n\n".join(["a" * 10, "b" * 8, "c" * 10])
    chunks = spark.createDataFrame([("c1", "s2", "good text", 1.0, 0.9), ("c2", "s1", "more text", 2.0, 0.9), ("c3", "s3", "...", 3.0, 0.1), ("c4", "s2", "last", 4.0, 0.9)], "chunk_id string, session_id string, text string, ts_end double, quality_score double")
    got = budget.generate_state(chunks, lambda t: {"summary": t, "other": 1}, now=9.0)
    assert got == {"summary": "good text\n\nmore text\n\nlast", "decisions": [], "constraints": [], "tasks": [], "updated_at": 9.0, "source_sessions": ["s2", "s1"]}
    assert budget.generate_state(chunks.where("false"), lambda t: 1 / 0, now=9.0)["source_sessions"] == []
    rows = [("p", "keep", "k" * 400, 9, True, 0), ("p", "one", "1" * 400, 1, False, 20), ("p", "two", "2" * 400, 2, False, 0), ("p", "three", "3" * 400, 3, False, 0), ("q", "a", "a" * 40, 1, False, 0)]
    out = budget.fill_sections(spark.createDataFrame(rows, "pack string, name string, content string, priority int, protected boolean, max_tokens int"), 200)
    assert {r["name"]: len(r["content"]) for r in out.collect()} == {"keep": 400, "one": 72, "two": 258, "three": 0, "a": 40}
    assert budget.decay_config(None) == (False, 14.0) and budget.decay_config({"decay": {"enabled": True, "half_life_days": 3}}) == (True, 3.0)
