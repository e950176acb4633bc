"""Retrieval queries on small document tables against plain Python."""

import random
from difflib import SequenceMatcher

import pytest

from loomlog.operators import retrieve
from loomlog.plans import budget, catalogue


def written(spark, tmp_path, texts):
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def quality(text):
    return round(sum(c.isalnum() for c in text) / len(text.strip()), 3) if text.strip() else 0.0


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


def edited(rng, text, n):
    out = text.split(" ")
    for _ in range(n):
        out[rng.randrange(len(out))] = "changed"
    return " ".join(out)


def test_near_dedup_of_long_documents(spark, tmp_path):
    rng = random.Random(3)
    short, long_, longer = words(rng, 30), words(rng, 700), words(rng, 1200)
    texts = [short, long_, long_[:-300] + words(rng, 40), longer, words(rng, 600), edited(rng, short, 2), longer[:-900] + words(rng, 100), long_.upper(), words(rng, 25)]
    assert sum(len(t) > 2048 for t in texts) == 6
    rows = sorted(((catalogue.NOW - k * 3600 + 90, f"c{k:012d}", t) for k, t in enumerate(texts)))
    best = {}
    for r in rows:
        key = " ".join(r[2].lower().split())
        if key not in best or (quality(r[2]), r[0]) > (quality(best[key][2]), best[key][0]):
            best[key] = r
    rows, gone = [r for r in rows if r in best.values()], set()
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)) if i not in gone else ():
            if j not in gone and SequenceMatcher(None, a[2], rows[j][2]).ratio() > 0.7:
                if (quality(rows[j][2]), rows[j][0]) > (quality(a[2]), a[0]):
                    gone.add(i)
                    break
                gone.add(j)
    want = sorted(r[1] for i, r in enumerate(rows) if i not in gone)
    assert 0 < len(gone) and any(len(rows[i][2]) > 2048 for i in gone) and any(len(r[2]) > 2048 for i, r in enumerate(rows) if i not in gone)
    assert sorted(r.chunk_id for r in catalogue.near_dedup_topn(spark, written(spark, tmp_path, texts)).collect()) == want


@pytest.mark.parametrize("ratio", [0.5, 0.7, 0.9])
def test_early_end_decides_as_the_ratio(ratio):
    rng = random.Random(5)
    for _ in range(60):
        a = words(rng, rng.randint(0, 120))
        b = edited(rng, a, rng.randint(0, 60)) if rng.random() < 0.7 else words(rng, rng.randint(0, 120))
        m = SequenceMatcher(None, a, b)
        assert retrieve.is_near(m, ratio) == (m.ratio() > ratio)


def test_state_sample_of_all_documents(spark, tmp_path):
    rng = random.Random(7)
    texts = ["oldest? ..... " * 4 + "ends", *(words(rng, rng.randint(60, 200)) for _ in range(70)), *(words(rng, 3) + " ." * rng.randint(1, 9) for _ in range(40)), " \n ", "!!!", " newest.. .. .. "]
    chunks = [(quality(t), catalogue.NOW - k * 3600 + 90, t.strip()) for k, t in enumerate(texts) if t.strip() and quality(t) >= 0.3]
    want = budget.sample_for_state(chunks)
    assert "newest" in want and "oldest" in want and any(len(t) < 30 for t in want.split("\n\n"))
    d = written(spark, tmp_path, texts)
    assert catalogue.state_sample(spark, d).first().state == want
    for batch in (1, 3):
        assert budget.sample_of_all(catalogue._chunks(spark, d), 400, batch=batch) == budget.sample_for_state(chunks, 400)
    assert budget.sample_of_all(catalogue._chunks(spark, d), 10**6) == budget.sample_for_state(chunks, 10**6)
