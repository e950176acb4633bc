import os

import duckdb
import pytest

from loomlog.plans import catalogue, pack

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(float(r[k]) if type(r[k]).__name__ in ("Decimal", "float") else r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = duck.sql(catalogue.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.collect(), got.columns) == rows_of(want.fetchall(), want.columns)


def test_queries_without_sql():
    """The others have tests of their own: near_dedup_topn and state_sample in test_retrieval, the others below."""
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE) == {"near_dedup_topn", "state_sample", "turn_chunks", "context_pack"}


def packed(text, most=2048):
    """Paragraphs packed by hand; the last pack alone is cut by force."""
    if len(text) <= most:
        return [text]
    done, held = [], ""
    for part in text.split("\n\n"):
        more = f"{held}\n\n{part}" if held else part
        if held and len(more) > most:
            done.append(held)
            more = part
        held = more
    cuts = [held[k : k + most] for k in range(0, len(held), most)] if held.strip() else []
    return done + [x for k, x in enumerate(cuts) if k < len(cuts) - 1 or x.strip()]


def test_turn_chunks(spark, duck):
    got = {(r["conv_id"], r["index"]): (r["chunk_id"], r["text"], r["token_estimate"]) for r in catalogue.turn_chunks(spark, DATA).collect()}
    want, places = {}, {}
    for conv, _, text in sorted(duck.sql(f"select conv_id, turn_number, full_text from {catalogue.TURNS}").fetchall()):
        before = ""
        for seg in packed(text) if text.strip() else []:
            at = places[conv] = places.get(conv, -1) + 1
            whole = before[-200:] + seg
            want[conv, at], before = (f"{conv}-{at}", whole, len(whole) // 4), seg
    assert got == want


@pytest.mark.parametrize("tokens", [150, 400, 1409, 9000])
def test_context_pack_keeps_its_budget(spark, tokens):
    meta = spark.createDataFrame([("s1", ["make"], 100.0, 200.0, 1)], "session_id string, command array<string>, started_at double, ended_at double, exit_code int")
    chunks = spark.createDataFrame([(f"c{k:02d}", "s1", k, f"{k} " + "word & more " * 12, float(k), float(k), 0.9) for k in range(40)], "chunk_id string, session_id string, index int, text string, ts_start double, ts_end double, quality_score double")
    text = pack.build(meta, chunks, {"summary": "S", "decisions": [{"id": "d", "statement": "x" * 80}], "constraints": ["c"]}, budget=tokens, mode="debug", now=300.0)
    n = text.count("<EXCERPT ")
    assert int(len(text) / 4 * 1.1) <= tokens and (n == 40 if tokens == 9000 else n < 40) and (n > 5 or tokens < 1000)
    assert all(f"<{k}" in text for k in ("PROJECT_STATE", "DECISIONS", "CONSTRAINTS", "ACTIVE_TASKS", "RECENT_CONTEXT_EXCERPTS", "INSTRUCTIONS"))
