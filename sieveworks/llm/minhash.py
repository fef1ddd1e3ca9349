"""MinHash near-duplicates by ProbMinHash over weighted word shingles.

The shingles of five words of a text, each weighted by 1 + ln(its count), send out Poisson arrivals at the rate of their
weight; each arrival falls on one of K components, which keeps the shingle whose arrival is the earliest. Two texts agree
in a component with the probability Jaccard similarity of their weighted shingles (the common Jaccard where weights are
equal). A shingle stops once its next arrival is later than all components' earliest. Components are grouped into bands;
texts that share a band are candidates, and every link is verified on the shingle sets of the whole texts, a shingle
being 4 bytes of its hash.

Equal texts (the same words in a row) are one node from the start. In a band group, one node, the pivot, is compared
with all others; what remains between different components is compared pair by pair once it is in proportion to the
nodes, less what the pivot's similarities rule out by the triangle inequality or the signatures by far too few common
places (DEVIATIONS, which a link at the limit falls under once in 30,000), and by further pivots before. So a group of near
copies costs its size, not its square; of what shares a band, only a link that the signatures rule out can be left out.

Defined results: words are compared in lower case; a text of one to four words is one shingle; texts without a word, and
null texts, are copies of nothing; rows that share an id are one document; rows without an id are not compared and are
kept; ties go to the smallest id; of rows that share a kept id keep_one keeps that with the smallest text (null last),
then with the smallest hash of all columns; columns other than those named are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.llm import graph
from sieveworks.llm.common import broadcastable, cut, looked_up
from sieveworks.llm.kernels import mix, text_ngrams, word_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 36, 7
K = 256
#: Standard deviations under the expected agreement of signatures at the wanted similarity from which a pair is not compared.
DEVIATIONS = 4.0
#: Bytes of ids that may be broadcast to fetch or drop texts; beyond it the join is left to the planner.
BROADCAST_IDS = 64_000_000
#: Bytes of shingle sets that may be broadcast to compare pairs; beyond it they are joined by shuffling.
BROADCAST_SETS = 10_000_000


def weighted_shingles(texts: pa.Array, words: int = WORDS):
    """(ids, weights, owner, words hashes, bounds): the distinct shingles (48-bit ids) of each text in order, and their weights."""
    hashes, bounds = word_hashes(texts)
    grams, own, _ = text_ngrams(hashes, bounds, words, short=True)
    keys = np.sort((own.astype(np.uint64) << np.uint64(48)) | (grams >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return keys & np.uint64((1 << 48) - 1), 1 + np.log(counts), (keys >> np.uint64(48)).astype(np.int64), hashes, bounds


def signatures(ids: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """texts x K shingle ids, by interleaved arrivals with early termination; rows of texts without shingles are 0."""
    earliest, kept = np.full(texts * K, np.inf), np.zeros(texts * K, np.uint64)
    latest = np.full(texts, np.inf)
    live, at, done, width = np.arange(len(ids)), np.zeros(len(ids)), 0, 1
    while len(live):
        rounds = np.arange(done, done + width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = mix((ids[live, None] * np.uint64(0xD1342543DE82EF95)) ^ rounds)
        gaps = -np.log(((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weights[live, None]
        times = at[:, None] + np.cumsum(gaps, axis=1)
        slots = owner[live, None] * K + (h & np.uint64(K - 1)).astype(np.int64)
        use = times <= latest[owner[live], None]
        t, s = times[use], slots[use]
        np.minimum.at(earliest, s, t)
        won = earliest[s] == t
        kept[s[won]] = np.broadcast_to(ids[live, None], times.shape)[use][won]
        latest = earliest.reshape(texts, K).max(axis=1)
        more = times[:, -1] <= latest[owner[live]]
        live, at = live[more], times[more, -1]
        done += width
        width = min(64, 2 * width) if done > 1 else 1
    return kept.reshape(texts, K)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((len(signature), bands), np.uint64)
    out += np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for r in range(rows):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + signature[:, r : r + rows * bands : rows][:, :bands])
    return out.view(np.int64)


def _sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node id, class (16 bytes; null without words), band keys, and the low bytes of the signature."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("cls", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.ArrayType(T.ByteType()))])

    def run(batches):
        for b in batches:
            texts = b.column(1)
            ids, weights, owner, hashes, bounds = weighted_shingles(texts)
            signature = signatures(ids, weights, owner, len(texts))
            keys = band_keys(signature)
            filled = np.diff(bounds) > 0
            cls = [hashlib.blake2b(hashes[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest() if filled[i] else None for i in range(len(texts))]
            lists = lambda v: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(filled * v.shape[1])]), pa.int32()), pa.array(v[filled].reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.binary()), lists(keys), lists(signature.astype(np.uint8).view(np.int8))], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).where(F.col(id_col).isNotNull()).mapInArrow(run, schema)


def _shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node id, shingles (sorted 4-byte ids), weights (4 bytes each, none if all are 1).

    Four bytes make one false common shingle in about 10,000 pairs of 600 shingles each."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("w", T.BinaryType())])

    def run(batches):
        for b in batches:
            ids, weights, owner, _, _ = weighted_shingles(b.column(1))
            at = np.searchsorted(owner, np.arange(b.num_rows + 1))
            sets, rest = [], []
            for i in range(b.num_rows):
                short, first = np.unique((ids[at[i] : at[i + 1]] >> np.uint64(16)).astype(np.uint32), return_index=True)
                own = weights[at[i] : at[i + 1]][first].astype(np.float32)
                sets.append(short.tobytes())
                rest.append(b"" if (own == 1).all() else own.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary()), pa.array(rest, pa.binary())], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def _unpacked(ids: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    out = np.frombuffer(ids, np.uint32)
    return out, np.frombuffer(w, np.float32) if w else np.ones(len(out), np.float32)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common elements of 1 / sum over all elements of max(wa_j / wa_i, wb_j / wb_i); a and b sorted."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if wa.max() == wa.min() and wb.max() == wb.min():
        return len(both) / (len(a) + len(b) - len(both))
    # for ratio r = wb_i / wa_i: max(wa_j / wa_i, wb_j / wb_i) = max(wa_j * r, wb_j) / wb_i; sums by prefix over wb_j / wa_j
    ca, cb = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    only_a, only_b = wa.sum(dtype=np.float64) - ca.sum(), wb.sum(dtype=np.float64) - cb.sum()
    ratio = cb / ca
    order = np.argsort(ratio, kind="stable")
    pa_, pb = np.concatenate([[0], np.cumsum(ca[order])]), np.concatenate([[0], np.cumsum(cb[order])])
    k = np.searchsorted(ratio[order], ratio, side="right")  # wb_j / wa_j <= r: wa_j * r is the larger
    total = (only_a + pa_[k]) * ratio + only_b + (pb[-1] - pb[k])
    return float((cb / total).sum())


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their probability Jaccard as sim."""
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"], T.StructField("sim", T.DoubleType())])

    def run(batches):
        for x in batches:
            ai, aw, bi, bw = (x.column(i).to_pylist() for i in range(2, 6))
            sims = [probability_jaccard(*_unpacked(p, q), *_unpacked(r, s)) if p and r else 0.0 for p, q, r, s in zip(ai, aw, bi, bw, strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(sims, pa.float64())], names=schema.names)

    size = sets.agg(F.coalesce(F.sum(F.length("ids") + F.length("w") + 16), F.lit(0))).first()[0]
    small = F.broadcast if size <= BROADCAST_SETS else (lambda d: d)
    left = small(sets.select(F.col("id").alias("a"), F.col("ids").alias("ai"), F.col("w").alias("aw")))
    right = small(sets.select(F.col("id").alias("b"), F.col("ids").alias("bi"), F.col("w").alias("bw")))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ai", "aw", "bi", "bw").mapInArrow(run, schema)


def _with_pivot(rows: DataFrame) -> DataFrame:
    """rows (key, n) of keys that several nodes share, with the key's pivot: the node whose keys hold the most nodes, as the original of many copies does."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = rows.join(sizes, "key")
    weight = shared.groupBy("n").agg(F.sum("k").alias("w"))
    pivots = shared.join(weight, "n").groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("w"), "n")).alias("p")).select("key", F.col("p.n").alias("pivot"))
    return rows.join(pivots, "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, pairs_per_node: int = 100) -> DataFrame:
    """One row per distinct id: id, component_id (the smallest id of its group), kept (id = component_id)."""
    sketch = cut(_sketch(docs, id_col, text_col), "sketch")
    classes = cut(sketch.where("cls is not null").groupBy("cls").agg(F.min("id").alias("rep")), "classes")
    nodes = sketch.join(classes.select("rep").distinct(), sketch["id"] == F.col("rep"), "left_semi").select(F.col("id").alias("n"), "bands", "sig")
    rows = cut(_with_pivot(nodes.select("n", F.explode("bands").alias("key")).distinct()), "bands")
    total = classes.count()
    pairs = rows.where("n <> pivot").select(F.col("pivot").alias("a"), F.col("n").alias("b")).distinct()
    found = None
    while True:
        pairs = cut(pairs, "pairs")
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        ids = cut(ids.withColumnRenamed("id", id_col), "ids")
        wanted = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(ids) if broadcastable(ids, id_col, BROADCAST_IDS) else ids, id_col, "left_semi")
        now = cut(_compared(pairs, cut(_shingle_sets(wanted, id_col, text_col), "sets")), "compared")
        edges = now.where(F.col("sim") >= similarity - 1e-9).select("a", "b")
        if found is not None:  # earlier links count as those of each node to its component
            edges = edges.unionByName(found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
        found = cut(graph.components(edges, "a", "b"), "components")
        if rows is None:
            break
        # what is still undecided: rows other than pivots, in keys whose rows are of several components
        known = now.select(F.col("a").alias("pivot"), F.col("b").alias("n"), "sim")
        rest = rows.where("n <> pivot").join(known, ["pivot", "n"], "left").join(found.withColumnRenamed("node", "n"), "n", "left").select("key", "n", "pivot", "sim", F.coalesce("component", "n").alias("c"))
        sizes = rest.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("ss"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        rest = cut(rest.join(sizes.select("key"), "key"), "rest")
        cross = sizes.agg(F.sum((F.col("s") * F.col("s") - F.col("ss")) / 2)).first()[0] or 0
        if cross == 0:
            break
        if cross <= pairs_per_node * total:
            # one minus the similarity is a metric: two nodes whose similarities to the pivot differ by more than 1 - similarity are not linked;
            # each pair comes from the least of its common keys; signatures of a link agree in fewer places than that once in 30,000
            agree = int(K * similarity - DEVIATIONS * (K * similarity * (1 - similarity)) ** 0.5)
            full = rest.join(nodes, "n")
            side = lambda x: full.select("key", F.col("n").alias(x), F.col("c").alias(f"c{x}"), F.col("sim").alias(f"s{x}"), F.col("bands").alias(f"k{x}"), F.col("sig").alias(f"g{x}"))
            on = f"l.key = r.key and a < b and ca <> cb and abs(coalesce(sa, 0) - coalesce(sb, 0)) <= {1 - similarity + 1e-6} and l.key = array_min(array_intersect(ka, kb)) and size(filter(sequence(0, {K - 1}), i -> ga[i] = gb[i])) >= {agree}"
            pairs = side("a").alias("l").join(side("b").alias("r"), F.expr(on)).select("a", "b").distinct()
            rows = None
        else:  # another pivot for each key
            rows = cut(_with_pivot(rest.select("key", "n")), "bands")
            pairs = rows.where("n <> pivot").select(F.col("pivot").alias("a"), F.col("n").alias("b")).distinct()
    # classes get their component first, so that the rows of a class of many copies need not meet
    spread = found.select(F.col("node").alias("rep"), "component")
    labels = classes.join(spread, "rep", "left").select(F.hex("cls").alias("key"), F.coalesce("component", "rep").alias("component_id"))
    own = looked_up(sketch.select("id", F.hex("cls").alias("key")), labels, "key")
    # rows that share an id are tied together like equal texts
    out = own.groupBy("id").agg(F.min("component_id").alias("component_id")).select("id", F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group: that with the smallest id."""
    found = cut(near_duplicates(docs, id_col, text_col, similarity), "decisions")
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(id_col)
    repeated = cut(repeated, "repeated")
    gone = found.where("not kept").select(id_col)
    gone_or_several = gone.unionByName(repeated).distinct()
    if broadcastable(gone_or_several, id_col, BROADCAST_IDS):  # else the planner's own join
        gone_or_several = F.broadcast(gone_or_several)
    single = docs.join(gone_or_several, id_col, "left_anti").select(*docs.columns)
    several = docs.join(repeated.join(gone, id_col, "left_anti"), id_col, "left_semi")
    first = F.struct(F.col(text_col).isNull().alias("_0"), F.col(text_col).alias("_1"), F.xxhash64(*docs.columns).alias("_2"))
    chosen = several.groupBy(F.col(id_col).alias("_id")).agg(F.min_by(F.struct(*docs.columns), first).alias("_row"))
    return single.unionByName(chosen.select("_row.*"))
