"""Quality classifier by positive-unlabelled learning.

A network of one hidden layer is trained on the non-negative unbiased risk: with trusted positives P, unlabelled web
text U, class prior p and logistic loss l, the risk is p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]); where the second
part turns negative, its gradient is followed backward. Its inputs are shares of characters and words of the whole text,
never labels, languages, sources or ids.

The class prior is estimated from positives and unlabelled texts alone, as labelled negatives need not look like the web:
a first network tells half of the positives from the unlabelled sample, and of all thresholds of its score that one gives
the estimate, as the share of unlabelled texts above it by that of the other half of the positives, whose upper
confidence bound is the lowest (best bin estimation); half the width of the bound is taken off. That share is counted over all unlabelled texts.

The sample that the networks are fitted to is bounded: at most POSITIVES positives and UNLABELLED unlabelled texts, chosen
by a hash of their ids among rows outside the held-out fold. The risk's second part is a mean over unlabelled texts, which a
sample of that size gives to about a hundredth; steps over all texts would need a pass over the corpus each.

Defined results: null texts are scored like empty ones; an empty table or one without positives gives score 0.5 to all;
of several labels of one id the largest counts; null ids have no label and count as the empty text in the folds; rows
that repeat are each scored; extra columns are passed on by accept() and not looked at by score().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.llm.common import fold, hash_sample
from sieveworks.llm.kernels import buffers, text_ngrams, word_hashes

POSITIVES, UNLABELLED = 8000, 8000
THRESHOLD = 0.3
HIDDEN, STEPS, BATCH, RATE, DECAY = 16, 1500, 512, 0.01, 1e-3
#: Bins of a score in which texts are counted to estimate the prior.
BINS = 512

_GROUPS = [b"!", b"#$%&*", b"|", b"0123456789", b".", b",", b"\n", b" ", b"<>{}[]=;_/\\", b"?:\"'()-", bytes(range(128, 256))]
_UPPER, _LOWER = slice(65, 91), slice(97, 123)
FEATURES = 11 + len(_GROUPS)


def _repeats(keys: np.ndarray, owner: np.ndarray, texts: int):
    """(distinct, most frequent, all) by text."""
    full = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (keys >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]])) if len(full) else np.zeros(0, np.int64)
    own = (full[first] >> np.uint64(48)).astype(np.int64)
    most = np.zeros(texts, np.int64)
    np.maximum.at(most, own, np.diff(np.append(first, len(full))))
    return np.bincount(own, minlength=texts), most, np.bincount(owner, minlength=texts)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers per text; null counts as empty."""
    n = len(texts)
    data, offsets = buffers(texts, lower=False)
    chars = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]) if n else np.zeros((0, 256))
    total = np.maximum(1, chars.sum(1))
    hashes, bounds, s, e = word_hashes(texts, spans=True)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    size = (e - s).astype(float)
    words = np.maximum(1, np.diff(bounds))
    mean = np.bincount(owner, size, n) / words
    spread = np.sqrt(np.maximum(0, np.bincount(owner, size * size, n) / words - mean**2))
    distinct, most, _ = _repeats(hashes, owner, n)
    grams, own, _ = text_ngrams(hashes, bounds, 3)
    few, _, many = _repeats(grams, own, n)
    doubled = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))
    letters = np.maximum(1, chars[:, _UPPER].sum(1) + chars[:, _LOWER].sum(1))
    cols = [np.log1p(np.diff(bounds)), mean, spread, chars[:, _UPPER].sum(1) / letters, distinct / words, np.log(np.maximum(1, distinct)) / np.log(words + 1.0), np.sqrt(most / words), 1 - few / np.maximum(1, many), np.log1p(words / (1 + chars[:, 46])), np.bincount(owner, size <= 3, n) / words, np.sqrt(np.bincount(owner[doubled], minlength=n) / words)]
    cols += [np.sqrt(chars[:, list(g)].sum(1) / total) for g in _GROUPS]
    return np.stack(cols, 1).astype(np.float64) if n else np.zeros((0, FEATURES))


class PUNet:
    def __init__(self, mean, scale, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = {"A": rng.normal(0, len(mean) ** -0.5, (len(mean), HIDDEN)), "a": np.zeros(HIDDEN), "B": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1)}

    def inputs(self, x):
        return np.clip((x - self.mean) / self.scale, -4, 8)

    def margin(self, x):
        return np.tanh(x @ self.p["A"] + self.p["a"]) @ self.p["B"] + self.p["b"][0]

    def scores(self, x):
        return 1 / (1 + np.exp(-np.clip(self.margin(self.inputs(x)), -30, 30)))

    def _gradient(self, x, weight):
        """Of the sum over rows of weight times margin."""
        h = np.tanh(x @ self.p["A"] + self.p["a"])
        d = weight[:, None] * self.p["B"] * (1 - h * h)
        return {"A": x.T @ d, "a": d.sum(0), "B": h.T @ weight, "b": np.array([weight.sum()])}

    def fit(self, positives, unlabelled, prior=None, seed: int = 1):
        """Adam on the non-negative risk; without a prior on telling positives from unlabelled rows."""
        rng, xp_all, xu_all = np.random.default_rng(seed), self.inputs(positives), self.inputs(unlabelled)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for i in range(1, STEPS + 1):
            xp, xu = xp_all[rng.integers(0, len(xp_all), BATCH)], xu_all[rng.integers(0, len(xu_all), BATCH)]
            gp, gu = self.margin(xp), self.margin(xu)
            sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
            negative = 0 if prior is None else np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            up, uu = (1 if prior is None else prior) * (sp - 1) / BATCH, su / BATCH
            if prior is None:
                g = self._gradient(np.concatenate([xp, xu]), np.concatenate([up, uu]))
            elif negative >= 0:
                g = self._gradient(np.concatenate([xp, xu]), np.concatenate([up - prior * sp / BATCH, uu]))
            else:  # the negative part has gone below zero: backward along it
                g = self._gradient(np.concatenate([xp, xu]), np.concatenate([prior * sp / BATCH, -uu]))
            rate = RATE * (1 if i < 0.7 * STEPS else 0.1)
            for k, a in self.p.items():
                step = g[k] + DECAY * a * (a.ndim > 1 or k == "B")
                m[k] += 0.1 * (step - m[k])
                v[k] += 0.001 * (step * step - v[k])
                a -= rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
        return self


def _featured(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            x = features(b.column(len(keep)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * FEATURES, pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], lists], names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def best_bin(positives: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, more: float = 0.01) -> float:
    """The class prior, less half the width of its confidence bound, from counts of positives and of unlabelled texts by bin of a score, the
    lowest first. A prior that is too high by little leaves the risk's second part nothing to learn from, one that is too
    low by as much does no harm."""
    n, m = positives.sum(), unlabelled.sum()
    above = lambda x: np.cumsum(x[::-1]) / x.sum()
    p, u = above(positives), above(unlabelled)
    doubt = (np.log(4 / delta) / 2) ** 0.5 * (m**-0.5 + n**-0.5)
    some = np.flatnonzero(p > 0)
    at = some[np.argmin((u[some] + (1 + more) * doubt) / p[some])]
    return float(min(0.99, max(0.01, u[at] / p[at] - doubt / 2)))


def _histogram(rows: DataFrame, net, text_col: str) -> np.ndarray:
    """How many texts have a score in each of BINS bins; counted by the workers."""
    shared = rows.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches):
        total = np.zeros(BINS, np.int64)
        for b in batches:
            total += _bins(shared.value.scores(features(b.column(0))))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=schema.names)

    out = np.zeros(BINS, np.int64)
    for r in rows.select(F.col(text_col).cast("string")).mapInArrow(run, schema).groupBy("bin").agg(F.sum("n")).collect():  # at most BINS rows
        out[r[0]] = r[1]
    return out


def _bins(scores: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(BINS - 1, (scores * BINS).astype(int)), minlength=BINS)


def estimated_prior(positives: np.ndarray, unlabelled: np.ndarray, counts, start) -> float:
    """The class prior; counts gives all unlabelled texts by bin of a network's score, start makes a network."""
    half = np.arange(len(positives)) % 2 == 0
    if half.all():
        return 0.5
    first = start().fit(positives[half], unlabelled)
    return best_bin(_bins(first.scores(positives[~half])), counts(first))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """The network, or None without positives."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col, folds) != 0)).groupBy(id_col).agg(F.max(label_col).alias("_y")).where("_y = 1")
    ones = known.count()
    if not ones:
        return None
    key = F.col(id_col).cast("string")
    trusted = hash_sample(known, key, ones, positives, "trusted").select(F.col(id_col), F.lit(True).alias("_p"))  # bounded: safe to broadcast
    text = docs.where(fold(id_col, folds) != 0).select(F.col(id_col), F.col(text_col))
    total = text.count()
    web = F.lit(True) if total <= unlabelled else F.pmod(F.xxhash64(F.lit("web"), F.coalesce(key, F.lit(""))), F.lit(1_000_000)) < F.lit(int(1_000_000 * unlabelled / total))
    sample = text.join(F.broadcast(trusted), id_col, "left").select(F.coalesce("_p", F.lit(False)).alias("_p"), web.alias("_u"), F.col(text_col)).where("_p or _u")
    rows = sorted(tuple(r) for r in _featured(sample, ["_p", "_u"], text_col).collect())
    x, p, u = np.array([r[2] for r in rows]).reshape(-1, FEATURES), np.array([r[0] for r in rows], bool), np.array([r[1] for r in rows], bool)
    if not p.any() or not u.any():
        return None
    start = lambda: PUNet(x[u].mean(0), np.maximum(x[u].std(0), 1e-3))
    prior = estimated_prior(x[p], x[u], lambda net: _histogram(text, net, text_col), start)
    net = start().fit(x[p], x[u], prior)
    net.prior = prior
    return net


def _scores(net, texts) -> np.ndarray:
    return np.full(len(texts), 0.5) if net is None else net.scores(features(texts))


def score(docs: DataFrame, net, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for b in batches:
            got = _scores(shared.value, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=schema.names)

    return docs.select(F.col(id_col), (fold(id_col, folds) == 0).alias("held_out"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def accept(docs: DataFrame, net, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those whose score is under threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(shared.value, b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
