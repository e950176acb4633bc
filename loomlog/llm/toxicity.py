"""Toxicity by weak supervision.

Voters look at a text and fire or abstain: a fixed lexicon, fixed patterns (an insult in an address, its spaced or masked
spellings), and a lexicon induced from labelled learning rows (words and word beginnings that are far more
frequent in toxic ones). ``LabelModel`` then estimates, from the votes alone, how often each voter fires on toxic and on
clean documents (its accuracy) and how voters are correlated within a class; correlated voters share their evidence. Labels
enter it only as the share of toxic documents. A linear classifier is fitted to its posteriors and scores every whole text.

The sample: at most ``max_toxic`` and ``max_clean`` labelled and ``max_unlabelled`` other documents, drawn by a hash of
doc_id, none of the held-out fifth. One task fits the model to it; the driver only gets the fitted weights.

Edge cases: a null or empty text scores as a text without any vote; with fewer than ``ENOUGH`` distinct labelled rows of
either kind any vote of the fixed lexicon and patterns is toxic; a doc_id with labels of both kinds counts as toxic, one with several texts by the least by hash;
repeated rows score alike; a null doc_id is not held out; very long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import importable
from .tokens import in_slices, only_cache, tidy

#: Insults that vote toxic.
LEXICON = (
    "idiot", "moron", "stupid", "trash", "pathetic", "worthless", "disgusting", "clown", "loser", "scum", "imbecile", "garbage",
    "idiote", "connard", "salaud", "abruti", "ordure", "arschloch", "dummkopf", "abschaum", "trottel", "idiota", "imbécil", "estúpido", "basura", "escoria",
)
_INSULT = "|".join(sorted(LEXICON, key=len, reverse=True))
#: Patterns that vote toxic, on lower-cased text.
PATTERNS = {
    "address": re.compile(rf"\b(?:you|you're|ur|tu|vous|du|ihr|eres|usted)\b[^.!?\n]{{0,40}}\b(?:{_INSULT})s?\b"),
    "epithet": re.compile(rf"\b(?:what an?|such an?|total|complete|utter|bloody|sale|espèce de|so ein|du|qué)\s+(?:\w+\s+)?(?:{_INSULT})s?\b"),
    "plural": re.compile(rf"\b(?:{_INSULT})(?:s|en|es)\b"),
    "masked": re.compile(r"\b(?:1d[i1]ot|id1ot|m0r0n|stup1d|tr4sh|l0ser|cl0wn)s?\b"),
    "spaced": re.compile(rf"\b(?:{'|'.join('[-_. ]'.join(w) for w in LEXICON[:12])})\b"),
    "twice": re.compile(rf"\b(?:{_INSULT})\b.*\b(?:{_INSULT})\b", re.S),
}
_WORD = re.compile(r"[^\W_]+")
_LENGTHS = range(4, 9)
RIDGE = 0.2
TRUST = 0.95
ENOUGH = 10  # labelled rows of each kind, fewer of which teach nothing
SAME = 0.6  # correlation within toxic documents from which a vote repeats another


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


_FORMS = frozenset(w + end for w in LEXICON for end in ("", "s", "en", "es"))
_MASKED = frozenset(w + end for w in ("1diot", "1d1ot", "id1ot", "m0r0n", "stup1d", "tr4sh", "l0ser", "cl0wn") for end in ("", "s"))


def patterns_of(text: str | None, words: set[str]) -> tuple[int, ...]:
    """Numbers of the patterns that fire; words (the text's) tell which of them can."""
    named, masked, letters = not _FORMS.isdisjoint(words), not _MASKED.isdisjoint(words), sum(len(w) == 1 for w in words) > 2
    if not (named or masked or letters):
        return ()
    low, can = text.lower(), {"masked": masked, "spaced": letters}
    return tuple(k for k, (name, p) in enumerate(PATTERNS.items()) if can.get(name, named) and p.search(low))


class LabelModel:
    """A two-class model of votes: firing rates by class, correlations within a class, posteriors; no label is read.

    A voter that doesn't fire abstains, which says nothing. ``fit`` alternates posteriors and rates, from a start in which
    each voter is better than chance. A voter's accuracy is the share of toxic documents, among those on which it fires, that
    the other votes on them make likely, without votes that repeat it: never too high, and a voter that no other one bears out
    loses its say. A vote's evidence is divided by one
    plus the correlations with the votes beside it, so that voters that say the same thing count once."""

    def __init__(self, toxic_share: float, rounds: int = 40, start: float = 2.5):
        self.share, self.rounds, self.start = min(0.5, max(0.005, toxic_share)), rounds, start

    def fit(self, votes: np.ndarray, trusted: np.ndarray | bool = False) -> np.ndarray:
        """Posteriors. The accuracy of ``trusted`` voters (those set by hand) is the mean of ``TRUST`` and what the votes say."""
        m, total, prior = votes.shape[1], votes.sum(axis=0), np.log(self.share / (1 - self.share))
        self.weight, self.evidence = np.ones(m), np.full(m, self.start)
        self.correlation = [np.eye(m), np.eye(m)]
        odds = self.odds(votes)
        post = _logistic(odds)
        for _ in range(self.rounds):
            p1 = max(1.0, post.sum())
            repeated = np.where(self.correlation[1] > SAME, self.correlation[1], 0) * self.evidence[:, None]
            others = odds[:, None] - prior - votes @ repeated  # evidence on each document without each voter
            on = np.clip(((_logistic(prior + others) * votes).sum(axis=0) + self.share) / (total + 1), 1e-4, 1 - 1e-4)
            on = np.where(trusted, (on + TRUST) / 2, on)
            self.rates = np.stack([np.clip((1 - on) * total / (len(votes) - p1 + 1), 1e-5, 0.99), np.clip(on * total / p1, 1e-5, 0.99)])
            self.correlation = [self._correlation(votes, p) for p in (1 - post, post)]
            shared = np.where(self.correlation[1] > 4 / np.sqrt(max(4.0, p1)), self.correlation[1], 0)  # not by chance
            np.fill_diagonal(shared, 0)
            self.weight = 1 / (1 + self._shared(votes, shared))
            self.evidence = self.weight * np.log(on / (1 - on) * (1 - self.share) / self.share)
            odds = self.odds(votes)
            now = _logistic(odds)
            done = np.abs(now - post).max(initial=0) < 1e-4
            post = now
            if done:
                break
        self.accuracy = on  # how likely a document is toxic if the voter fires
        return post

    @staticmethod
    def _shared(votes: np.ndarray, correlation: np.ndarray) -> np.ndarray:
        """The sum of correlations with the voters that fire beside each voter, on average."""
        beside = (votes.T @ votes) / np.maximum(1, votes.sum(axis=0))[:, None]
        return (correlation * beside).sum(axis=1)

    @staticmethod
    def _correlation(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
        rate = np.clip(p @ votes / max(p.sum(), 1.0), 1e-5, 1 - 1e-5)
        z = (votes - rate) * np.sqrt(p)[:, None]
        sd = np.sqrt(rate * (1 - rate))
        return np.clip(z.T @ z / max(p.sum(), 1.0) / np.outer(sd, sd), -1, 1)

    def odds(self, votes: np.ndarray) -> np.ndarray:
        return np.log(self.share / (1 - self.share)) + votes @ self.evidence


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def induced(docs: list[tuple[frozenset, int]], most: int = 500, least: int = 3, chance: float = 1.0) -> list[str]:
    """Words (``=w``) and word beginnings (``w*``) that toxic documents have more often than chance allows: ``chance`` is the
    expected number of features let in by mistake, over all that ``least`` toxic documents have (Chernoff's bound on the
    toxic part of a feature's documents). A beginning needs three words, and of features found in the same documents only
    the longest beginning stays."""
    seen, n = [Counter(), Counter()], [sum(not y for _, y in docs), sum(y for _, y in docs)]
    kinds: dict[str, set] = defaultdict(set)

    def features(words) -> set[str]:
        return {f"={w}" for w in words} | {f"{w[:k]}*" for w in words for k in _LENGTHS if len(w) > k}

    for words, y in docs:
        if y:
            seen[1].update(features(words))
    tried = {f for f, c in seen[1].items() if c >= least}
    seen[1] = Counter({f: seen[1][f] for f in tried})
    for words, y in docs:
        if not y:
            seen[0].update(tried.intersection(features(words)))
    share, need = n[1] / len(docs), np.log(max(1, len(tried)) / chance)

    def surprise(f: str) -> float:
        c, k = seen[1][f], seen[0][f]
        part = c / (c + k)
        return 0.0 if part <= share else c * np.log(part / share) + (k * np.log((1 - part) / (1 - share)) if k else 0.0)

    good = {f for f in sorted(tried) if surprise(f) >= need}
    if not good:
        return []
    where: dict[str, set] = {f: set() for f in good}
    for at, (words, y) in enumerate(docs):
        if y:
            for w in words:
                if f"={w}" in good:
                    where[f"={w}"].add(at)
                for k in _LENGTHS:
                    if len(w) > k and (f := f"{w[:k]}*") in good:
                        where[f].add(at)
                        if len(kinds[f]) < 3:
                            kinds[f].add(w)
    best: dict[frozenset, str] = {}
    for f in sorted(good, key=lambda f: (f[0] != "=", len(f), f)):
        if f[0] == "=" or len(kinds[f]) > 2:
            best[frozenset(where[f])] = f
    return sorted(best.values(), key=lambda f: (-seen[1][f], f))[:most]


class Model:
    """Voters and the linear classifier's weights."""

    def __init__(self, labelled: list[tuple[set[str], tuple, int]], unlabelled: list[tuple[set[str], tuple]] = (), **how):
        once = list({(w, y): (w, p, y) for w, p, y in ((tuple(sorted(w)), p, y) for w, p, y in labelled)}.values())
        toxic = sum(y for *_, y in once)
        both = min(toxic, len(once) - toxic) >= ENOUGH
        mined = induced([(w, y) for w, _, y in once], **how) if both else []
        self.voters = {f: k for k, f in enumerate(dict.fromkeys([*(f"={w}" for w in LEXICON), *mined]))}
        self.size = len(self.voters) + len(PATTERNS)
        self.cache: dict[str, tuple[int, ...]] = {}
        rows = [(w, p) for w, p, _ in once] + list(unlabelled)
        x = np.array([self.counts(w, p) for w, p in rows], np.float32).reshape(len(rows), self.size)
        self.cache = {}
        if not both:
            self.evidence = np.full(self.size, 1.0)
            self.weights = np.concatenate([[-4.0], np.zeros(self.size), [0, 0, 8.0]])
            return
        votes = (x > 0).astype(np.float32)
        used = votes.sum(axis=0) > 0
        self.labels = LabelModel(toxic / len(once))
        byhand = np.array([f[0] == "=" and f[1:] in LEXICON for f in self.voters] + [True] * len(PATTERNS))
        post = self.labels.fit(votes[:, used].astype(np.float64), byhand[used])
        self.evidence = np.full(self.size, 1.0)
        self.evidence[used] = np.maximum(0.0, self.labels.evidence)
        self._fit(x, post)

    def counts(self, words: set[str], patterns: tuple[int, ...]) -> np.ndarray:
        """Distinct words of the document that each voter matches; 1 for a pattern that fires."""
        out = np.zeros(self.size, np.float32)
        cache = self.cache
        for w in words:
            hit = cache.get(w)
            if hit is None:
                found = (self.voters.get(f) for f in (f"={w}", *(f"{w[:k]}*" for k in _LENGTHS if len(w) > k)))
                hit = tuple(k for k in found if k is not None)
                if len(cache) < 200_000:
                    cache[w] = hit
            for k in hit:
                out[k] += 1
        for k in patterns:
            out[len(self.voters) + k] = 1
        return out

    def _columns(self, x: np.ndarray) -> np.ndarray:
        given = np.where(x > 0, self.evidence, 0)
        total = np.log1p((np.log1p(x) * self.evidence).sum(1, keepdims=True))
        return np.hstack([np.ones((len(x), 1)), np.log1p(x), total, given.max(1, initial=0)[:, None], (given > 0).any(1, keepdims=True)])

    def _fit(self, x: np.ndarray, target: np.ndarray) -> None:
        z = self._columns(x).astype(np.float64)
        w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], RIDGE)
        ridge[0] = 1e-3
        for _ in range(25):
            p = _logistic(z @ w)
            s = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((z * s[:, None]).T @ z + np.diag(ridge), z.T @ (target - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return _logistic(self._columns(counts) @ self.weights)

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        return self.scores(np.array([self.counts(w, patterns_of(t, w)) for t in texts for w in (words_of(t),)], np.float32).reshape(len(texts), self.size))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 2000, max_clean: int = 4000, max_unlabelled: int = 2000, **how) -> Model:
    """The model of a bounded sample, fitted in one task; **how goes to ``induced``."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("_y")).where("doc_id is not null and _y in (0, 1)").groupBy("doc_id").agg(F.max("_y").alias("_y"))
    known = known.where(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    other = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).join(labels.select("doc_id"), "doc_id", "left_anti").distinct()
    drawn = known.where("_y = 1").orderBy(order, "doc_id").limit(max_toxic).unionByName(known.where("_y = 0").orderBy(order, "doc_id").limit(max_clean))
    drawn = drawn.unionByName(other.withColumn("_y", F.lit(None).cast("int")).orderBy(order, "doc_id").limit(max_unlabelled))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most the three bounds' rows are broadcast

    def words(batches):
        only_cache("toxicity sample")
        for batch in batches:
            for a, b, texts in in_slices(batch.column("text")):
                sets = [words_of(t) for t in texts]
                key = pa.array(["\n".join(sorted(w)) for w in sets], pa.string())
                fired = pa.array([list(patterns_of(t, w)) for t, w in zip(texts, sets, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), key, fired, batch.column("_y").slice(a, b - a)], names=["doc_id", "words", "fired", "y"])

    def fit(batches):
        only_cache("toxicity sample")
        labelled, rest = [], []
        held: dict[str, str] = {}  # one string for each word
        for batch in batches:
            for w, p, y in zip(*(batch.column(k).to_pylist() for k in ("words", "fired", "y")), strict=True):
                found = tuple(held.setdefault(x, x) for x in w.split("\n")) if w else ()
                if y is None:
                    rest.append((found, tuple(p)))
                else:
                    labelled.append((found, tuple(p), y))
        model = Model(labelled, rest, **how)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    importable(docs.sparkSession)
    got = rows.select("doc_id", "text", "_y").mapInArrow(tidy(words), "doc_id long, words string, fired array<int>, y int")
    got = got.groupBy("doc_id", "y").agg(F.min_by(F.struct("words", "fired"), F.xxhash64("words")).alias("v")).select("doc_id", "v.words", "v.fired", "y")
    fitted = got.repartition(1).sortWithinPartitions("doc_id").mapInArrow(tidy(fit), "model binary").collect()
    return pickle.loads(fitted[0][0]) if fitted else Model([])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def rate(batches):
        only_cache("toxicity", model.cache.clear)
        for batch in batches:
            for a, b, texts in in_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.of_texts(texts))], names=["doc_id", "score"])

    importable(docs.sparkSession)
    out = docs.select("doc_id", "text").mapInArrow(tidy(rate, model.cache.clear), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows predicted toxic; columns as they are."""

    def keep(batches):
        only_cache("toxicity", model.cache.clear)
        for batch in batches:
            for a, b, texts in in_slices(batch.column(batch.schema.get_field_index("text"))):
                yield batch.slice(a, b - a).filter(pa.array(model.of_texts(texts) < 0.5))

    importable(docs.sparkSession)
    return docs.mapInArrow(tidy(keep, model.cache.clear), docs.schema)
