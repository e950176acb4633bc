"""The label model on votes with planted accuracies and correlations, the induced lexicon, and held-out recall."""

import duckdb
import numpy as np
import pytest

from loomlog.llm import queries, toxicity


def planted(rng, n=6000, share=0.2):
    y = rng.random(n) < share
    on, off = np.array([0.5, 0.4, 0.6, 0.3, 0.5]), np.array([0.02, 0.05, 0.1, 0.03, 0.02])
    votes = rng.random((n, 5)) < np.where(y[:, None], on, off)
    twin = np.where(rng.random(n) < 0.9, votes[:, 0], rng.random(n) < np.where(y, on[0], off[0]))  # repeats the first voter nine times of ten
    idle = rng.random(n) < 0.15  # says nothing
    return y, np.column_stack([votes, twin, idle]).astype(float), share * np.append(on, 0.5) / (share * np.append(on, 0.5) + (1 - share) * np.append(off, 0.02))


def test_label_model_finds_planted_accuracies_and_correlations():
    y, votes, accuracy = planted(np.random.default_rng(4))
    model = toxicity.LabelModel(0.2)
    post = model.fit(votes)
    assert np.abs(model.accuracy[:6] - accuracy).max() < 0.25  # drawn towards the share, and in order
    good, poor = model.accuracy[[0, 4, 5]], model.accuracy[[1, 2]]
    assert good.min() > poor.max() and poor.min() > model.accuracy[6] + 0.15
    assert model.accuracy[6] < 0.4
    found = model.correlation[1]
    assert found[0, 5] > 0.8 and np.abs(found[1, 2]) < 0.3 and np.abs(found[0, 6]) < 0.1
    assert model.weight[0] < 0.7 * model.weight[1]
    assert ((post >= 0.5) == y).mean() > 0.9


def test_label_model_sees_no_label():
    y, votes, _ = planted(np.random.default_rng(5))
    a, b = toxicity.LabelModel(0.2).fit(votes), toxicity.LabelModel(0.2).fit(votes[::-1])
    assert np.allclose(a, b[::-1], atol=1e-6)


def test_induced_lexicon_leaves_chance_alone():
    rng = np.random.default_rng(6)
    words = [f"w{k:04d}" for k in range(3000)]
    docs = [(frozenset(rng.choice(words, 60)) | ({f"zzzz{rng.integers(9)}", *(["bad"] if k % 16 else [])} if k % 8 == 0 else frozenset()), int(k % 8 == 0)) for k in range(1600)]
    found = toxicity.induced([(frozenset(w), y) for w, y in docs])
    assert "=bad" in found and "zzzz*" in found and len([f for f in found if f.startswith("=w")]) <= 3


def test_patterns():
    fired = lambda t: {list(toxicity.PATTERNS)[k] for k in toxicity.patterns_of(t, toxicity.words_of(t))}
    assert fired("You are such an idiot.") >= {"address", "epithet"} and fired("i-d-i-o-t") == {"spaced"} and fired("A m0r0n") == {"masked"}
    assert fired("one idiot and one clown") == {"twice"}
    assert fired("Plain words, without any of it.") == fired("") == fired(None) == set()


def test_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    toxic = dict(duckdb.sql(f"select doc_id, toxic from '{d}/labels.parquet'").fetchall())
    rows = [(r["predicted"], toxic[r["doc_id"]]) for r in queries.op4_toxicity(spark, d).where("held_out").select("doc_id", "predicted").collect() if r["doc_id"] in toxic]
    recall = sum(p for p, y in rows if y) / sum(y for _, y in rows)
    flagged = sum(p for p, y in rows if not y) / sum(not y for _, y in rows)
    assert recall >= 0.7 and flagged < 0.015
