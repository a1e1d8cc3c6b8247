"""Toxicity by weak supervision.

Voters vote toxic, vote clean or abstain. Toxic votes come from lexicon entries
(fixed insult words of public English, and words that labelled rows suggest) and
patterns (word beginnings that labelled rows suggest, two or more different
words with a term); clean votes from the patterns "no lexicon entry" and "no word
with a term". Labels only suggest terms: the generative label model does not see them.
It starts from the majority of the votes and estimates by expectation
maximisation, with a latent truth, how often each voter fires on toxic and on
other texts. Voters whose votes agree beyond what the truth explains are
correlated, and each one's evidence is divided by its correlated mass, so
near-equal voters do not count twice. A linear classifier is then trained on the
posterior labels and scores every whole text.

Fitting uses at most ``most_labelled`` labelled rows (documented bound, chosen
by a hash of the id) and at most ``most_voters`` suggested terms, the best of all
counted; votes are kept sparse. Scoring covers all rows and whole texts of any
length, one word after the other. Null and empty texts get the score of a text
without terms; repeated rows get equal scores; terms of equal worth are taken in
the order of their names; without labels only the fixed lexicon votes, and an
empty table gives an empty result. Other columns are ignored, or pass through
``drop_toxic``, whatever they are called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .bytewords import slices
from .shared import free_name, id_text, map_batches, tidily

MOST_LABELLED, MOST_VOTERS, SURE = 20_000, 400, 2.5
MOST_HELD = 100_000  # words or counts that a worker remembers; more go on to the next step or are found again
WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6, 7, 8)
#: Common English insults.
INSULTS = "idiot moron stupid dumb loser clown scum trash garbage worthless pathetic disgusting hate ugly filthy vermin imbecile fool bastard bitch crap damn shit fuck".split()


LEXICON = tuple("=" + w for w in INSULTS)


def forms(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


def features(text: str) -> Counter:
    """Counts of the words' whole forms (=) and beginnings (^)."""
    out: Counter = Counter()
    for w, n in Counter(WORD.findall(text.lower())).items():
        for x in forms(w):
            out[x] += n
    return out


#: Voters that are no terms: so many different words with a term (toxic), no lexicon entry, no word (clean).
PATTERNS = ("two words", "three words", "no lexicon entry", "no word")


class Finder:
    """Terms of a text: how often each fires, and which of PATTERNS do. Remembers words within a bound."""

    def __init__(self, terms: list[str], n_suggested: int):
        self.index, self.n, self.n_suggested, self.memo = {v: k for k, v in enumerate(terms)}, len(terms), n_suggested, {}

    def __call__(self, text: str) -> dict[int, int]:
        """Counts of voters (terms by their place, then PATTERNS)."""
        found: dict[int, int] = {}
        words = set()
        for w in WORD.findall(text.lower()):
            h = self.memo.get(w)
            if h is None:
                if len(self.memo) > MOST_HELD:
                    self.memo.clear()
                h = self.memo[w] = tuple(self.index[x] for x in forms(w) if x in self.index)
            for k in h:
                found[k] = found.get(k, 0) + 1
            if h:
                words.add(w)
        fires = (len(words) > 1, len(words) > 2, all(k < self.n_suggested for k in found), not words)
        return dict(sorted(found.items())) | {self.n + k: 1 for k, x in enumerate(fires) if x}


@dataclass
class Model:
    """Voters are ``terms`` (suggested ones, then the lexicon) and then PATTERNS."""

    terms: list[str]
    n_suggested: int
    weights: np.ndarray
    bias: float

    def scorer(self):
        """A function from text to score."""
        find, weights = Finder(self.terms, self.n_suggested), self.weights.tolist()

        def score(text: str) -> float:
            z = self.bias + sum(weights[k] * log1p(n) for k, n in find(text).items())
            return 1 / (1 + exp(-min(40.0, max(-40.0, z))))

        return score


@dataclass
class Votes:
    """Sparse rows x voters: entry i says that voter[i] fires on row[i], count[i] times."""

    row: np.ndarray
    voter: np.ndarray
    count: np.ndarray
    n_rows: int
    n_voters: int

    def by_voter(self, weight: np.ndarray) -> np.ndarray:
        """For each voter the sum of its rows' weights."""
        return np.bincount(self.voter, weight[self.row], self.n_voters)

    def by_row(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weight[self.voter], self.n_rows)

    def dense(self, lo: int, hi: int) -> np.ndarray:
        a, b = np.searchsorted(self.row, (lo, hi))
        out = np.zeros((hi - lo, self.n_voters), "f4")
        out[self.row[a:b] - lo, self.voter[a:b]] = 1
        return out


def independent_share(votes: Votes, post: np.ndarray, on: np.ndarray, off: np.ndarray) -> np.ndarray:
    """1 / (each voter's mass of correlation with others that the truth does not explain)."""
    m, n = votes.n_voters, votes.n_rows
    total, both = np.zeros(m), np.zeros((m, m))
    for lo in range(0, n, 1000):
        p = post[lo : lo + 1000, None].astype("f4")
        rest = votes.dense(lo, lo + len(p)) - (p * on.astype("f4") + (1 - p) * off.astype("f4"))
        total += rest.sum(0)
        both += rest.T @ rest
    std = np.maximum(np.sqrt(np.maximum(np.diag(both) / n - (total / n) ** 2, 0)), 1e-3)
    return 1 / np.maximum(1, np.maximum(both / n / std[:, None] / std - 0.1, 0).sum(0))


def label_model(votes: Votes, polarity: np.ndarray, rounds: int = 25, share_at: tuple[int, ...] = (2, 8)) -> np.ndarray:
    """The posterior of the latent truth. polarity: 1 for voters of toxic, -1 for voters of clean."""
    toxic, clean = np.minimum(votes.by_row((polarity > 0) * 1.0), 3), votes.by_row((polarity < 0) * 1.0)
    post, share, n = 1 / (1 + np.exp(-2 * (toxic - clean))), np.ones(votes.n_voters), votes.n_rows
    for k in range(rounds):
        t = post.sum()
        prior = (t + 1) / (n + 2)
        on = np.clip((votes.by_voter(post) + 0.5) / (t + 1), 1e-4, 1 - 1e-4)
        off = np.clip((votes.by_voter(1 - post) + 0.05) / (n - t + 1), 1e-5, 1 - 1e-4)
        if k in share_at:
            share = independent_share(votes, post, on, off)
        fire, silent = np.log(on / off) * share, np.log((1 - on) / (1 - off)) * share
        z = np.log(prior / (1 - prior)) + votes.by_row(fire - silent) + silent.sum()
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return post


def linear_fit(votes: Votes, polarity: np.ndarray, y: np.ndarray, steps: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam, from each voter's polarity."""
    x, w, b = np.log1p(votes.count), polarity.astype("f8"), -1.0
    m = s = np.zeros(len(w) + 1)
    for k in range(1, steps + 1):
        z = np.bincount(votes.row, w[votes.voter] * x, votes.n_rows) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.append(np.bincount(votes.voter, (p - y)[votes.row] * x, len(w)) / len(y) + l2 * w, (p - y).mean())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_voters: int = MOST_VOTERS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labelled rows outside the held-out fold."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out("doc_id"))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    rows = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("toxic", "text")  # most_labelled rows at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[dict, dict] = {}, {}

        def ends() -> pa.RecordBatch:
            names = list(n[0].keys() | n[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c.get(x, 0) for x in names], pa.int64()) for c in (n[1], n[0]))], ["name", "pos", "neg"])
            n[0].clear()
            n[1].clear()
            return out

        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                for y, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for x in features(text):
                        n[y > 0][x] = n[y > 0].get(x, 0) + 1  # documents that hold it
                    if len(n[0]) + len(n[1]) > MOST_HELD:
                        yield ends()
        yield ends()

    counts = rows.mapInArrow(tidily(count), "name string, pos long, neg long").groupBy("name").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # a term is suggested if its share of toxic documents is over a half, SURE standard deviations aside
    n, share = F.col("pos") + F.col("neg"), F.col("pos") / (F.col("pos") + F.col("neg"))
    least = (share + SURE**2 / (2 * n) - SURE * F.sqrt(share * (1 - share) / n + SURE**2 / (4 * n * n))) / (1 + SURE**2 / n)
    found = counts.where(least > 0.5).orderBy((F.col("pos") * least).desc(), "name").limit(most_voters).collect()
    pos = {r["name"]: r["pos"] for r in found}
    words = [v for v in pos if v[0] == "="]
    # a beginning that says no more than one of its words is left out
    suggested = [v for v in pos if v not in LEXICON and (v[0] == "=" or not any(w[1:].startswith(v[1:]) and pos[w] >= 0.8 * pos[v] for w in words))]
    terms = suggested + list(LEXICON)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            find, ks, ns, hs = Finder(terms, len(suggested)), [], [], []
            for text in (t for part in parts(batch) for t in part.column(1).to_pylist()):
                own = find(text)
                ks.append(list(own))
                ns.append(list(own.values()))
                hs.append(xxhash.xxh3_64_intdigest(text) >> 1)
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ks, pa.list_(pa.int32())), pa.array(ns, pa.list_(pa.int32()))], ["h", "k", "n"])

    got = rows.mapInArrow(tidily(vote), "h long, k array<int>, n array<int>").toArrow().combine_chunks()
    polarity = np.array([1.0] * (len(terms) + 2) + [-1.0, -1.0])
    if not got.num_rows:
        return Model(terms, len(suggested), polarity, -1.5)
    got = got.take(pc.sort_indices(got, [("h", "ascending")])).combine_chunks()  # so that sums do not hang on the order of rows
    k, n = (pc.list_flatten(got.column(c)).to_numpy() for c in ("k", "n"))
    votes = Votes(np.repeat(np.arange(got.num_rows), pc.list_value_length(got.column("k")).to_numpy()), k, n.astype("f8"), got.num_rows, len(polarity))
    post = label_model(votes, polarity)
    return Model(terms, len(suggested), *linear_fit(votes, polarity, post))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = id_text(docs, id_col, text_col)
    scored = _scored(rows, model, "text", "score")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def parts(batch: pa.RecordBatch, most_rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in parts of a few rows, so that little is decoded at once."""
    return (batch.slice(k, most_rows) for k in range(0, batch.num_rows, most_rows))


def _scored(rows: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    """``rows`` and behind them their scores as column ``name``."""

    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            for part in parts(batch):
                s = pa.array([of(t or "") for t in part.column(at).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, s], [*part.schema.names, "added"])

    return map_batches(rows, run, StructField(name, DoubleType()))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is under 0.5, with their columns."""
    model, name = fit(docs, labels, id_col=id_col, text_col=text_col), free_name(docs, "__score")
    return _scored(docs, model, text_col, name).where(F.col(name) < 0.5).drop(name)
