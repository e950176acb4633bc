"""The registered corpus queries and the pipeline against plain Python on whole small tables, and against DuckDB where SQL can say them."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import tokenizers

import corpus_pipeline
from loomlog.llm import queries, toxicity
from loomlog.llm.common import table

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, source from '{DATA}/documents.parquet' order by doc_id").fetchall()


def encode(vocabulary, text, end):
    return [*vocabulary.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or {tuple(words)}


def components(ids, linked):
    """Smallest id reachable, by union of every linked pair; also the number of links."""
    root, links = {i: i for i in ids}, Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if linked(a, b):
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: find(i) for i in ids}, links


def near_components(texts, n):
    sets = {i: shingles(t, n) for i, t in texts.items()}

    def linked(a, b):
        x, y = sets[a], sets[b]
        if not x or not y or 100 * min(len(x), len(y)) < 80 * max(len(x), len(y)):
            return False
        both = len(x & y)
        return 100 * both >= 80 * (len(x) + len(y) - both)

    return components(sorted(texts), linked)[0], sets


def pieces(rows, capacity=2048):
    """Counter of (doc_id, piece, start, length, crc32) with the first piece the shorter one."""
    vocabulary = tokenizers.Tokenizer.from_file(queries.vocabulary(queries.BYTE_VOCABULARY))
    out = Counter()
    for doc_id, text in rows:
        ids = encode(vocabulary, text, 0)
        cuts = [0, *range(len(ids) % capacity or min(len(ids), capacity), len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[doc_id, k, a, b - a, crc(ids[a:b])] += 1
    return out


def packed_well(rows, capacity=2048):
    """Sequences hold at most capacity, are gapless, and are no more than best-fit decreasing makes."""
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    room = []
    for length in sorted((r["length"] for r in rows), reverse=True):
        fit = min((k for k in range(len(room)) if room[k] >= length), key=room.__getitem__, default=None)
        if fit is None:
            room.append(capacity - length)
        else:
            room[fit] -= length
    assert len(bins) <= len(room)


def source_targets(sizes):
    """Targets by bisection on the common level: least(2 * size, level * weight) must sum to 150 % of all sizes."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    low, high, want = 0.0, 4.0 * sum(sizes.values()) + 1, 1.5 * sum(sizes.values())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * weight[s]) for s in order) < want else (low, mid)
    return {s: min(2 * sizes[s], high * weight[s]) for s in order}


def mix_by_hand(rows):
    """rows: (doc_id, text, source). Words taken of each row, by the sampler's keys sorted within the source."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = Counter()
    for n, (_, _, s) in zip(size, rows, strict=True):
        total[s] += n
    target, by, taken = source_targets(total), defaultdict(list), [0] * len(rows)
    for k, (i, t, s) in enumerate(rows):
        u = (int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        plain = sum(w.rstrip(".,;:!?") != "" and w[: len(w) - (w[-1] in ".,;:!?")].isalpha() for w in WORD.findall(t or ""))
        by[s].append((-math.log(u) / max(0.1, plain / size[k] if size[k] else 0), i, k))
    for s, held in by.items():
        left = round(target[s])
        epochs, left = divmod(left, total[s]) if total[s] else (0, 0)
        for _, _, k in sorted(held):
            part = min(left, size[k])
            taken[k], left = epochs * size[k] + part, left - part
    return size, total, target, taken


def test_op1(spark, docs):
    vocabulary, at, want = tokenizers.Tokenizer.from_file(queries.vocabulary(queries.WORD_VOCABULARY)), 0, []
    for i, t, _ in docs:
        ids = encode(vocabulary, t, 1)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    got = queries.op1_wavelet_tokens(spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_op2(spark, docs):
    size, total, target, taken = mix_by_hand(docs)
    got = {r["doc_id"]: r for r in queries.op2_source_mix(spark, DATA).collect()}
    assert len(got) == len(docs)
    given = Counter()
    for k, (i, _, s) in enumerate(docs):
        r = got[i]
        assert (r["size"], r["source_size"]) == (size[k], total[s]) and r["target"] == pytest.approx(target[s])
        assert r["taken"] == taken[k] <= 2 * size[k]
        given[s] += r["taken"]
    assert all(abs(given[s] - target[s]) <= 1 for s in total)


def test_op3(spark, docs):
    rows = queries.op3_best_fit_pack(spark, DATA).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == pieces((i, t) for i, t, _ in docs)
    packed_well(rows)


def toxic_score(model, text):
    """The score from the model's voters and weights, voter by voter."""
    words, x = set(re.findall(r"[^\W_]+", (text or "").lower())), []
    for voter in model.voters:
        x.append(sum(w == voter[1:] if voter[0] == "=" else w.startswith(voter[:-1]) and 3 < len(voter[:-1]) < len(w) for w in words))
    x += [int(bool(text) and bool(p.search(text.lower()))) for p in toxicity.PATTERNS.values()]
    given = [e if n else 0.0 for n, e in zip(x, model.evidence, strict=True)]
    columns = [1.0, *(math.log1p(n) for n in x), math.log1p(sum(math.log1p(n) * e for n, e in zip(x, model.evidence, strict=True))), max(given), float(any(g > 0 for g in given))]
    return 1 / (1 + math.exp(-sum(c * w for c, w in zip(columns, model.weights, strict=True))))


def test_op4(spark, docs):
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, DATA).collect()}
    model = toxicity.train(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
    for i, t, _ in docs:
        score = toxic_score(model, t)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["score"] == pytest.approx(score, abs=1e-5) and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.5)


def test_op6(spark):
    data = "/root/testdata/sf0.01"  # the smaller table holds no secret
    docs = duckdb.sql(f"select doc_id, text from '{data}/documents.parquet'").fetchall()
    kinds = ("assign", "access", "hex")
    patterns = (
        (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    got = {r["doc_id"]: r for r in queries.op6_secret_scan(spark, data).collect()}
    some = 0
    for i, t in docs:
        found = sorted((m.start(), k, m.end()) for k, (p, fits) in enumerate(patterns) for m in re.finditer(p, (t or ""), re.ASCII) if fits(m))
        base = [f"{kinds[k]}:{a}:{b}" for a, k, b in found]
        r = got[i]
        assert [r[f"n_{x}"] for x in kinds] == [sum(k == n for _, k, _ in found) for n in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("random")] == base
        some += len(base)
    assert some


def test_op8(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{DATA}/embeddings.parquet'").fetchall()
    v = {i: np.array(x, float) / np.linalg.norm(np.array(x, float)) for i, x in rows}
    comp, links = components(sorted(v), lambda a, b: v[a] @ v[b] >= 0.9)
    got = queries.op8_vector_near_dedup(spark, DATA).collect()
    found = sum(r["n_links"] for r in got)
    assert found >= 0.99 * links.total() and all(r["n_links"] <= links[r["vec_id"]] for r in got)
    if found == links.total():
        assert {r["vec_id"]: (r["component_id"], r["kept"]) for r in got} == {i: (c, i == c) for i, c in comp.items()}


def test_op9(spark, docs):
    comp, sets = near_components({i: t for i, t, _ in docs}, 2)
    got = queries.op9_minhash_near_dedup(spark, DATA).collect()
    assert {tuple(r) for r in got} == {(i, len(sets[i]), c, i == c) for i, c in comp.items()}
    assert any(not r["kept"] for r in got)


def test_op10(spark, docs):
    def parts(text):
        return set(re.findall(r"(?s)[^\n]{1,99}(?: |\n|$)|[^\n]{1,99}|\n", text))

    def like(a, b):
        return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0

    got = {r["doc_id"]: r for r in queries.op10_document_fingerprints(spark, DATA).collect()}
    down = [(i, t or "") for i, t, _ in reversed(docs)]
    prints = defaultdict(set)
    for (i, t), (_, following) in zip(down, down[1:] + down[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(parts(t), parts(edited))) and r["near_next"] == pytest.approx(like(parts(t), parts(following)))
        prints[t].add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns)) for r in want.fetchall())


def test_pipeline(spark, docs):
    """run() against the five stages by hand."""
    from loomlog.llm import secrets

    model = toxicity.train(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
    left = [d for d in docs if toxic_score(model, d[1]) < 0.5]
    comp, _ = near_components({i: t for i, t, _ in left}, 5)
    left = [d for d in left if comp[d[0]] == d[0]]
    assert len(left) < len(docs)
    encoder = secrets._encoding(queries.vocabulary(queries.BYTE_RANKS)).encode_ordinary
    hidden = []
    for i, t, s in left:
        chars = list(t or "")
        covered = sorted({k for a, _, b in secrets.spans_of(t or "", encoder) for k in range(a, b)}, reverse=True)
        for k in covered:
            chars[k] = "[SECRET]" if k - 1 not in covered else ""
        hidden.append((i, None if t is None else "".join(chars), s))
    size, _, _, taken = mix_by_hand(hidden)
    mixed = [d for d, n, got in zip(hidden, size, taken, strict=True) if n for _ in range((2 * got + n) // (2 * n))]
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == pieces((i, t) for i, t, _ in mixed)
    packed_well(rows)
