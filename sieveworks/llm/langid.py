"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy.

The recurrence runs over all bytes of the lower-cased text, blanks, digits and signs among them, in both directions, and
every byte gets log probabilities from the two states that meet there. A text is covered by windows of CORE bytes; the
recurrence of a window begins CONTEXT bytes before it and ends CONTEXT bytes after it (or where the text does), so that a
text of any length is read in bounded memory and every position has that much context on both sides. A document's
probabilities are pooled as the normalised geometric mean over all its positions. Training is backpropagation through
time with Adam, from a fixed seed.

The training sample is bounded: at most TRAIN_DOCS documents, chosen by a hash of their ids, and of each at most
TRAIN_WINDOWS stretches of TRAIN_WIDTH bytes, evenly spread over the whole text. Predictions read whole texts of all
documents.

Defined results: text is taken in lower case; null texts and texts without a letter are und with score 0; so is
everything if no language could be learned; null ids count as the empty text in the folds; rows that repeat are each
predicted; extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.llm.common import fold, hash_sample
from sieveworks.llm.kernels import buffers

TRAIN_DOCS, TRAIN_WINDOWS, TRAIN_WIDTH = 4000, 8, 96
#: Bytes of a text that a window labels, and bytes on each side that its recurrence reads besides.
CORE, CONTEXT = 448, 32
#: Windows that are computed at once.
ROWS = 512
HIDDEN, STEPS, BATCH, RATE = 8, 250, 128, 0.02


class ByteGRU:
    """Two gated recurrent layers, one from each end of a window, and a softmax at each byte."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 0):
        rng, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p = {f"{k}{d}": (rng.normal(0, s, shape)).astype(np.float32) for d in "fb" for k, shape, s in (("E", (256, 3 * h), 0.3), ("U", (h, 3 * h), h**-0.5))}
        self.p |= {"V": rng.normal(0, h**-0.5, (2 * h, classes)).astype(np.float32), "c": np.zeros(classes, np.float32)}

    def _run(self, x, way, keep=False):
        """States (time + 1 x batch x h, from the zero state on) over the bytes x (time x batch); with keep also the gates."""
        h, e, u = self.h, self.p[f"E{way}"], self.p[f"U{way}"]
        gates, inner = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        (steps, rows), kind, x = x.shape, u.dtype, x.astype(np.intp)
        states = np.zeros((steps + 1, rows, h), kind)
        kept = np.empty((steps, rows, 3 * h), kind) if keep else None
        g, a, c, reset = np.empty((rows, 3 * h), kind), np.empty((rows, 2 * h), kind), np.empty((rows, h), kind), np.empty((rows, h), kind)
        for t in range(steps):
            state, new = states[t], states[t + 1]
            np.take(e, x[t], axis=0, out=g, mode="clip")
            np.matmul(state, gates, out=a)
            a += g[:, : 2 * h]
            a *= 0.5  # the logistic function by tanh
            np.tanh(a, out=a)
            a *= 0.5
            a += 0.5
            np.multiply(state, a[:, h:], out=reset)
            np.matmul(reset, inner, out=c)
            c += g[:, 2 * h :]
            np.tanh(c, out=c)
            np.subtract(state, c, out=new)
            new *= a[:, :h]
            new += c
            if keep:
                kept[t, :, : 2 * h], kept[t, :, 2 * h :] = a, c
        return states, kept

    @staticmethod
    def _mirror(sizes, width):
        """time x batch: for each place in a reversed window its place in the window, and the other way round."""
        t = np.arange(width)[:, None]
        return np.where(t < sizes[None, :], sizes[None, :] - 1 - t, t)

    def _logits(self, x, sizes, keep=False):
        """time x batch x classes, and what backpropagation needs; x: time x batch."""
        h, back = self.h, self._mirror(sizes, len(x))
        turned = np.take_along_axis(x, back, 0)
        f, b = self._run(x, "f", keep), self._run(turned, "b", keep)
        out = f[0][1:] @ self.p["V"][:h] + np.take_along_axis(b[0][1:] @ self.p["V"][h:], back[:, :, None], 0) + self.p["c"]
        return out, f, b, back, turned

    def log_probabilities(self, x, sizes):
        """batch x time x classes of left-aligned windows x (batch x time), valid below sizes."""
        a = self._logits(np.ascontiguousarray(x.T), sizes)[0]
        a -= a.max(2, keepdims=True)
        a -= np.log(np.exp(a).sum(2, keepdims=True))
        return a.transpose(1, 0, 2)

    def gradients(self, x, sizes, y):
        """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
        x, h = np.ascontiguousarray(x.T), self.h
        a, f, b, back, turned = self._logits(x, sizes, keep=True)
        a -= a.max(2, keepdims=True)
        q = np.exp(a)
        q /= q.sum(2, keepdims=True)
        live = np.arange(len(x))[:, None] < sizes[None, :]
        total = live.sum()
        own = (np.arange(len(x))[:, None], np.arange(x.shape[1])[None, :], y[None, :])
        loss = -np.log(q[own] + 1e-9)[live].sum() / total
        q[own] -= 1
        q *= live[:, :, None] / q.dtype.type(total)
        mirrored = np.take_along_axis(q, back[:, :, None], 0)
        grads = {"V": np.concatenate([np.einsum("tbi,tbl->il", f[0][1:], q), np.einsum("tbi,tbl->il", b[0][1:], mirrored)]), "c": q.sum((0, 1))}
        for way, bytes_, (states, kept), d in (("f", x, f, q @ self.p["V"][:h].T), ("b", turned, b, mirrored @ self.p["V"][h:].T)):
            u = self.p[f"U{way}"]
            into, gu, carry = np.empty_like(kept), np.zeros_like(u), np.zeros_like(states[0])
            for t in range(len(x) - 1, -1, -1):
                state, z, r, n = states[t], kept[t, :, :h], kept[t, :, h : 2 * h], kept[t, :, 2 * h :]
                out = carry + d[t]
                dn = out * (1 - z) * (1 - n * n)
                to_n = dn @ u[:, 2 * h :].T
                into[t, :, :h] = out * (state - n) * z * (1 - z)
                into[t, :, h : 2 * h] = to_n * state * r * (1 - r)
                into[t, :, 2 * h :] = dn
                carry = out * z + to_n * r + into[t, :, : 2 * h] @ u[:, : 2 * h].T
                gu[:, : 2 * h] += state.T @ into[t, :, : 2 * h]
                gu[:, 2 * h :] += (r * state).T @ dn
            flat, which = into.reshape(-1, 3 * h), bytes_.ravel()
            grads |= {f"E{way}": np.stack([np.bincount(which, flat[:, k], 256) for k in range(3 * h)], 1).astype(u.dtype), f"U{way}": gu}
        return loss, grads

    def fit(self, windows, sizes, y, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 1):
        """Adam over random batches in which every class has an equal share."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        of = [np.flatnonzero(y == k) for k in range(len(self.p["c"]))]
        for i in range(1, steps + 1):
            pick = np.concatenate([rng.choice(o, max(1, batch // len(of))) for o in of])
            width = max(1, int(sizes[pick].max()))
            _, g = self.gradients(windows[pick, :width], sizes[pick], y[pick])
            now = rate * (1 if i < 0.7 * steps else 0.2)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k, a in self.p.items():
                own = g[k] / max(1.0, norm)
                m[k] += 0.1 * (own - m[k])
                v[k] += 0.01 * (own * own - v[k])
                a -= (now * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return self


def training_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out=(3, 1), docs_bound: int = TRAIN_DOCS):
    """(languages, windows, sizes, classes) of the bounded training sample."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, held_out[0]) != held_out[1]))
    sample = hash_sample(known, F.coalesce(F.col(id_col).cast("string"), F.lit("")), known.count(), docs_bound, "langid")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("windows", T.ArrayType(T.BinaryType()))])

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column(1))
            out = []
            for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
                many = int(min(TRAIN_WINDOWS, -(-(hi - lo) // TRAIN_WIDTH)))
                starts = {int(lo + max(0, hi - lo - TRAIN_WIDTH) * k // max(1, many - 1)) for k in range(many)}
                out.append([data[s : min(hi, s + TRAIN_WIDTH)].tobytes() for s in sorted(starts)] if _has_letter(data[lo:hi]) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.binary()))], names=schema.names)

    got = sorted((r[0], [bytes(w) for w in r[1]]) for r in sample.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, schema).collect())
    languages = sorted({lang for lang, windows in got if windows})
    pairs = [(languages.index(lang), w) for lang, windows in got for w in windows]
    rows, sizes = np.zeros((len(pairs), TRAIN_WIDTH), np.uint8), np.zeros(len(pairs), np.int64)
    for i, (_, w) in enumerate(pairs):
        rows[i, : len(w)], sizes[i] = np.frombuffer(w, np.uint8), len(w)
    return languages, rows, sizes, np.array([k for k, _ in pairs], np.int64)


def train(docs: DataFrame, **options):
    """(languages, network); the network is None if there is nothing to learn from."""
    languages, rows, sizes, y = training_windows(docs, **options)
    return (languages, ByteGRU(len(languages)).fit(rows, sizes, y)) if languages else ([], None)


def _has_letter(text: np.ndarray) -> bool:
    """Whether the bytes of a text in lower case hold a letter."""
    if ((text >= 97) & (text <= 122)).any():
        return True
    return bool((text >= 128).any()) and any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace"))


def pooled(net: ByteGRU, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """texts x classes: sums of the log probabilities of all positions of each text, given as bytes and offsets."""
    many = -(-np.diff(offsets) // CORE)
    owner = np.repeat(np.arange(len(many)), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    lo, hi = offsets[owner] + nth * CORE, np.minimum(offsets[owner] + (nth + 1) * CORE, offsets[owner + 1])
    begin, end = np.maximum(lo - CONTEXT, offsets[owner]), np.minimum(hi + CONTEXT, offsets[owner + 1])
    out = np.zeros((len(many), len(net.p["c"])))
    order = np.argsort(end - begin, kind="stable")
    for part in np.split(order, range(ROWS, len(order), ROWS)) if len(order) else []:
        sizes = end[part] - begin[part]
        t = np.arange(int(sizes.max()))[None, :]
        at = np.minimum(begin[part][:, None] + t, len(data) - 1)
        lp = net.log_probabilities(data[at], sizes)
        inner = (at >= lo[part][:, None]) & (at < hi[part][:, None]) & (t < sizes[:, None])
        np.add.at(out, owner[part], np.einsum("btc,bt->bc", lp, inner.astype(lp.dtype)))
    return out


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", held_out=(3, 1)) -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        names, net = shared.value
        for b in batches:
            langs, scores = ["und"] * b.num_rows, [0.0] * b.num_rows
            if net:
                data, offsets = buffers(b.column(2))
                sums = pooled(net, data, offsets)
                for d, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    if _has_letter(data[lo:hi]):
                        q = sums[d] / (hi - lo)
                        q = np.exp(q - q.max())
                        k = int(q.argmax())
                        langs[d], scores[d] = names[k], float(q[k] / q.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(F.col(id_col), (fold(id_col, held_out[0]) == held_out[1]).alias("held_out"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
