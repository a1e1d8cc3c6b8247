"""Quality classifier: random-indexing word vectors pooled per document, and a
two-layer network with temperature-calibrated probabilities.

Tokens are runs of letters and digits (lower-cased) and runs of other marks. Each
token has, by a hash, one of ``BUCKETS`` places and a sparse ternary index vector
of ``DIM`` numbers. A place's context vector sums its neighbours' index vectors
over every text of the corpus, as whole numbers that Spark adds up; its size does
not grow with the corpus (words that share a place share a vector). A word vector
is the context vector, logarithms taken and brought to length 1, and the token's
own index vector. A document's pool is the mean of its tokens' vectors, the shares
of their shapes (capitals, length, marks, same as one of the two before) and the
logarithm of their number.

A network of one hidden layer is fitted in numpy to the pools of labelled rows,
and a temperature for its logits to a fifth of them that it did not see. Fitting
uses at most ``most_labelled`` rows (documented bound, by a hash of id and text)
whose id is outside the held-out fold; word vectors come from all rows, and every
whole text is scored.

Null and empty texts have a pool of zeros and the score that goes with it; a null
doc_id counts as not held out; repeated rows get equal scores; without labels of
both kinds the score is the labels' share, or 0.5 without any. Where an id has
several labels the greatest counts. An empty table gives an empty result. Other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LOWER, SPACE, U, buffers, mix, slices, word_hashes
from .shared import id_text, tidily
from .terms import LETTERS_DIGITS
from .toxicity import held_out

MOST_LABELLED, BUCKETS, DIM, NONZERO, WINDOW, HIDDEN = 20_000, 1 << 14, 32, 4, 2, 32
SHAPES = 13


def index_vectors(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n places the NONZERO dimensions and signs."""
    with np.errstate(over="ignore"):
        h = mix(np.arange(n, dtype=U)[:, None] * U(NONZERO) + np.arange(NONZERO, dtype=U) + U(salt << 32))
    return (h % U(DIM)).astype("i8"), 1 - 2 * ((h >> U(60)) & U(1)).astype("i8")


def _dense(dims: np.ndarray, signs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(dims), DIM))
    np.add.at(out, (np.arange(len(dims))[:, None], dims), signs)
    return out


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and shapes of all tokens, and for each text the number of tokens before it (n + 1)."""
    data, off = buffers(texts)
    kind = np.where(SPACE[data], 0, np.where(LETTERS_DIGITS[data], 1, 2)).astype("i1")
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[off] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    starts, ends = starts[kind[starts] > 0], ends[kind[starts] > 0]
    if not len(starts):
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(len(off), "i8")
    place = (word_hashes(LOWER[data], starts, ends) >> U(64 - 14)).astype("i8")
    capitals = np.append(0, np.cumsum((data >= 65) & (data <= 90)))
    n, upper = ends - starts, capitals[ends] - capitals[starts]
    case = np.where(upper == 0, 0, np.where((upper == n) & (n > 1), 2, 1))
    shape = np.where(kind[starts] == 2, 9 + np.minimum(n, 3) - 1, 3 * case + np.digitize(n, (4, 12)))
    return place, shape, np.searchsorted(starts, off)


def _parts(batches: Iterator[pa.RecordBatch], col: int, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, col, most)


def context_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS x DIM sums of the neighbours' index vectors over all texts."""
    dims, signs = index_vectors(BUCKETS, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS * DIM, "i8")
        for part in _parts(batches, 0, 1 << 21):
            place, _, before = tokens(part.column(0))
            text = np.repeat(np.arange(len(before) - 1), np.diff(before))
            for k in range(1, WINDOW + 1):
                near = text[k:] == text[:-k]
                for x, y in ((place[:-k][near], place[k:][near]), (place[k:][near], place[:-k][near])):
                    sums += np.bincount((x[:, None] * DIM + dims[y]).ravel(), signs[y].ravel(), len(sums)).astype("i8")
        rows = sums.reshape(BUCKETS, DIM)
        at = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(rows[at, j]) for j in range(DIM))], ["place", *names])

    names = [f"v{j}" for j in range(DIM)]
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sums = rows.mapInArrow(tidily(run), ", ".join(f"{c} long" for c in ["place", *names])).groupBy("place").agg(*(F.sum(c).alias(c) for c in names))
    got = sums.toArrow()  # BUCKETS rows at most
    out = np.zeros((BUCKETS, DIM), "i8")
    out[got.column("place").to_numpy()] = np.stack([got.column(c).to_numpy() for c in names], 1).reshape(-1, DIM)
    return out


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Of each place its context, less what all have in common, at length 1, and its own index vector."""
    c = np.sign(contexts) * np.log1p(np.abs(contexts))
    used = contexts.any(1)
    c[used] -= c[used].mean(0) if used.any() else 0
    c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-9)
    return np.hstack([c, _dense(*index_vectors(BUCKETS, 1)) / 2]).astype("f4")


def pools(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: mean of its tokens' vectors, their shapes' shares, log(1 + tokens)."""
    place, shape, before = tokens(texts)
    n, d, length = len(before) - 1, vectors.shape[1], np.diff(before)
    out = np.zeros((n, d + SHAPES + 1))
    some = np.flatnonzero(length)
    if len(some):
        out[some, :d] = np.add.reduceat(vectors[place], before[:-1][some], 0) / length[some][:, None]
        text = np.repeat(np.arange(n), length)
        again = np.zeros(len(place), bool)
        for k in (1, 2):
            again[k:] |= (place[k:] == place[:-k]) & (text[k:] == text[:-k])
        again = np.flatnonzero(again)
        for at in (text * SHAPES + shape, text[again] * SHAPES + SHAPES - 1):
            out[:, d:-1] += np.bincount(at, minlength=n * SHAPES).reshape(n, SHAPES)
        out[:, d:-1] /= np.maximum(1, length)[:, None]
        out[:, -1] = np.log1p(length)
    return out


@dataclass
class Network:
    """Inputs are brought to mean 0 and deviation 1 (means over few tokens less so), one hidden layer, a logit divided by the temperature."""

    mean: np.ndarray
    std: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -5, 5)
        z[:, :-1] *= 1 - 8 / (np.exp(x[:, -1:]) + 7)
        return z

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.inputs(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, l2: float = 1e-3) -> Network:
    """By Adam on shuffled batches; the same rows in the same order give the same network."""
    rng = np.random.default_rng(7)
    net = Network(x.mean(0), np.maximum(x.std(0), 1e-6), rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    x = net.inputs(x)
    params = [net.w1, net.b1, net.w2, np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            at = order[k : k + batch]
            h = np.tanh(x[at] @ params[0] + params[1])
            g = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - y[at]) / len(at)
            back = g[:, None] * params[2] * (1 - h * h)
            grads = [x[at].T @ back + l2 * params[0], back.sum(0), h.T @ g + l2 * params[2], g.sum(keepdims=True)]
            step += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                params[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *params[:3], float(params[3][0])
    return net


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, by golden-section search on its logarithm; from 1/8 to 8."""
    loss = lambda t: float(np.logaddexp(0, np.where(y > 0, -1, 1) * logits / np.exp(t)).mean())
    lo, hi, r = -np.log(8), np.log(8), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None
    share: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        return self.network.probabilities(pools(texts, self.vectors))


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from all texts, and labelled rows outside the held-out fold."""
    vectors = word_vectors(context_vectors(docs, text_col))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").try_cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    key = F.xxhash64("doc_id", "text")
    rows = id_text(docs, id_col, text_col).join(F.broadcast(known), "doc_id").select((F.col("quality") > 0).cast("double").alias("y"), key.alias("key"), "text")

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 2):
            x = pools(part.column(2), vectors).astype("f4")
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), flat], ["y", "key", "x"])

    pooled = rows.mapInArrow(tidily(pool), "y double, key long, x array<float>")
    got = pooled.orderBy("key", "y").limit(most_labelled).toArrow()  # ids that repeat do not add to the bound
    y = got.column("y").to_numpy()
    if len(np.unique(y)) < 2:
        return Model(vectors, None, float(y.mean()) if len(y) else 0.5)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1).astype("f8")
    test = np.arange(len(y)) % 5 == 0  # rows are in the order of their hash
    if len(np.unique(y[~test])) < 2:
        test[:] = False
    net = fit_network(x[~test], y[~test])
    if test.any():
        net.temperature = fit_temperature(net.logits(x[test]), y[test])
    return Model(vectors, net, float(y.mean()))


def score(docs: DataFrame, model: Model, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1)))], ["doc_id", "score"])

    scored = id_text(docs, id_col, text_col).mapInArrow(tidily(run), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
