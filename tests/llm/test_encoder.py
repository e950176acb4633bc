import random
import time

import pyarrow as pa
import pytest

from loomlog.llm import queries
from loomlog.llm.tokens import CachedEncoder, encoded

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PARTS = [*"aAbHK's19.,!-_\"" + " " * 6, "\n", "\n", "\t", "\r", "\x0b", "\x1f", "\x85", "\xa0", " ", " ", " ", "　", "あ", "中", "é", "ß", "×", "İ", "Σ", "́", "̱", "…", "“", "\U0001f600", "\0", "\x01", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "'ll"]


def each(enc, texts):
    ids, counts = enc.encode(texts)
    ends = counts.cumsum().tolist()
    assert len(ids) == (ends[-1] if ends else 0)
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts.tolist(), strict=True)]


def library(enc, texts):
    return [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_ids_of_odd_texts(name):
    texts = ["H̱ T̈x", "a <|ENDOFTEXT|> b", "a  <|endoftext|>\n\n b", None, "", " ", "\n", "zé. “x” a b", "x" * 500 + ".", "中" * 300]
    enc = CachedEncoder(queries.vocabulary(name))
    assert each(enc, texts) == library(enc, texts) == each(enc, texts)


@pytest.mark.parametrize("name", NAMES)
def test_ids_of_random_texts_in_small_caches_and_slices(name):
    draw = random.Random(7)
    enc = CachedEncoder(queries.vocabulary(name), max_words=500, max_bytes=12)
    for _ in range(300):
        texts = [None if draw.random() < 0.05 else "".join(draw.choices(PARTS, k=draw.choice((0, 1, 2, 5, 12, 40)))) for _ in range(draw.randrange(8))]
        want = library(enc, texts)
        assert each(enc, texts) == want
        column = pa.array(["left out", *texts, "too"]).slice(1, len(texts))
        assert [i for *_, ids, _ in encoded(enc, column, 20) for i in ids.tolist()] == [i for x in want for i in x]


@pytest.mark.parametrize("name", NAMES)
def test_unseen_words_cost_less_than_a_call_each(name):
    draw = random.Random(1)
    words = list({"".join(draw.choices(["tion", "er", "schl", "en", "ou", "é", "wh"], k=6)) for _ in range(30_000)})
    text, path = " ".join(words), queries.vocabulary(name)
    ratios = []
    for _ in range(3):
        enc, plain = CachedEncoder(path), CachedEncoder(path).tokenizer
        began = time.process_time()
        ids, _ = enc.encode([text])
        took = time.process_time() - began
        began = time.process_time()
        got = [x.ids for x in plain.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        ratios.append(took / (time.process_time() - began))
    assert abs(sum(map(len, got)) - len(ids)) <= 2
    assert min(ratios) < 0.85, ratios
