import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import html, minhash, mixing, packing, queries, secrets, sketches, toxicity, urlfilter, vectors, wavelet
from loomlog.llm.tokens import CachedEncoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (3, None, "en", None, 0), (4, "", "en", "t", 0), (5, "one", "en", "t", 3), (5, "one", "en", "t", 3), (None, "x y", "en", "t", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).withColumn("start", F.lit("clash"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_ids_equal_the_library(name):
    enc = CachedEncoder(queries.vocabulary(name))
    for t in ["", " a", "a  b", "a \nb.", "x\x1cy. z", "It's 3.5, ok.\nYes", "é ß。 ", "a\n\n b"]:
        assert enc.encode([t])[0].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_wavelet_round_trip():
    ids = np.random.default_rng(0).integers(0, 50, 3000).astype(np.uint32)
    wm = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, [3000]).to_bytes())
    assert (wm.decode() == ids).all() and all(wm.access(i) == ids[i] for i in range(0, 3000, 97))
    assert wm.count(7, 10, 900) == (ids[10:900] == 7).sum() and wm.occurrences(7, 10, 900) == (np.flatnonzero(ids[10:900] == 7) + 10).tolist()


def test_edge_rows(spark, docs):
    empty = docs.where("false")
    path = queries.vocabulary(queries.BYTE_VOCABULARY)
    assert wavelet.read(wavelet.write(docs, path, 1)).count() == 7 and wavelet.read(wavelet.write(empty, path, 1)).count() == 0
    assert packing.pack(docs, path).count() == 7 and packing.pack(empty, path).count() == 0
    assert mixing.mix(mixing.sized(docs)).count() == 7 and mixing.mix(mixing.sized(empty)).count() == 0
    assert sketches.fingerprints(docs).count() == 7 and sketches.fingerprints(empty).count() == 0
    assert secrets.scan(docs, queries.vocabulary(queries.BYTE_RANKS)).where("spans <> ''").count() == 0
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 2).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (None, None, True)}
    assert minhash.near_duplicates(empty, 2).count() == 0


def test_packing_of_small_instances():
    for sizes, best in (([6, 4, 5, 5], 2), ([7, 3, 3, 4, 3], 2), ([10], 1), ([1] * 20, 2)):
        bins = {}
        for length, _, n, seq, off in packing.plan({x: sizes.count(x) for x in sizes}, 10):
            for k in range(n):
                bins.setdefault(seq + k, []).append((off, length))
        assert len(bins) == best and sum(len(b) for b in bins.values()) == len(sizes)
        assert all(o == sum(x for _, x in sorted(b)[:i]) for b in bins.values() for i, (o, _) in enumerate(sorted(b)))


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((20, 16))
    v = np.concatenate([base, base + 0.15 * rng.standard_normal((20, 16)), base[:3]])
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(90, None), (91, [0.0] * 16), (92, [float("nan")] * 16)]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = ((u @ u.T >= 0.9).sum(1) - 1).tolist() + [0, 0, 0]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == want


def test_urls(spark):
    rows = [(1, "http://A.example.org/es/x?q"), (2, "https://x.com/de/"), (3, "none"), (4, None), (5, "http://b.org"), (6, "http://example.org/en/15")]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), urlfilter.rules_frame(spark)).orderBy("page_id").collect()
    assert [(r.host, r.rule, r.verdict) for r in got] == [("a.example.org", "example.org/es/", "block"), ("x.com", "com/de/", "block"), ("", None, "allow"), ("", None, "allow"), ("b.org", None, "allow"), ("example.org", "example.org/en/1", "block")]


def test_page_text():
    page = "<html><body><nav>Menu</nav><article><h1>T</h1><p>One &amp; two.<p>Three  <i>x</i>.</article><div class=comments>No</div><footer>f</footer></body></html>"
    assert html.main_text(page) == "T\nOne & two.\nThree x." and html.main_text(None) == ""


def test_secret_spans():
    encode = secrets._encoding(queries.vocabulary(queries.BYTE_RANKS)).encode_ordinary
    text = "secret=token: x password = 'hunter22' " + "AKIA" + "B" * 16 + " zQ9xK2vB7mW4pL8tR3nY"
    assert secrets.joined(secrets.spans_of(text, encode)) == "assign:16:36,access:38:58,random:59:79"


def test_toxicity_learns_and_leaves_clean(spark):
    rows = [(k, f"word{k} idiot moron" if k % 3 == 0 else f"word{k} plain fine", "en", "s", 9) for k in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    assert {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()} == set(range(0, 300, 3))
