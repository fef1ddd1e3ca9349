"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction built from a random product code: after a random rotation a vector is cut into two halves, and
every pair of a codeword for each half is a filter. Each vector is list-decoded to all filters whose score exceeds a
threshold (set so that a random vector exceeds LOAD of them, and never fewer than LEAST): in each half only codewords
that can still reach the threshold with the best of the other half are combined. The number of filters grows with the
number of vectors, so that filters keep their size. Vectors that share a filter are candidates, and are verified by
their cosine in double precision.

Equal vectors are one node. In filters with many nodes, those within half the link angle of a pivot form a ball: they
are all linked with each other by the triangle inequality. Two balls are linked, or not linked, as a whole where their
centres' angle and their radii decide it, and only pairs of balls in between are compared vector by vector. So a dense
group costs its size, not its square, and links are counted without listing them.

Defined results: null and zero vectors, and those with null or non-finite components, link with nothing; vectors of
different lengths never link; rows that repeat, ids included, are vectors of their own; a null id takes part but is
never the smallest; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.llm import graph
from sieveworks.llm.common import cut

COSINE = 0.95
LOAD, LEAST = 48, 24
#: Nodes in a filter from which on balls are formed, and how often.
HOT, ROUNDS = 32, 4
MARGIN = 1e-7


class ProductCode:
    """The filters for vectors of one length."""

    def __init__(self, dim: int, words: int, load: int = LOAD, seed: int = 7):
        rng = np.random.default_rng([seed, dim, words])
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        self.turn, self.half, self.words = q * np.sign(np.diag(r)), max(1, dim // 2), words
        unit = lambda x: x / np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))
        self.one, self.two = unit(rng.normal(size=(words, self.half))), unit(rng.normal(size=(words, dim - self.half))) if dim > 1 else np.zeros((1, 0))
        trial = unit(rng.normal(size=(64, dim)))
        a, b = self._scores(trial)
        tops = [np.sort((x[:, None] + y[None, :]).ravel())[-(load + 1)] for x, y in zip(np.partition(a, -min(words, 128), 1)[:, -128:], np.partition(b, -min(len(self.two), 128), 1)[:, -128:], strict=True)]
        self.threshold = float(np.mean(tops))

    def _scores(self, units):
        x = units @ self.turn
        return x[:, : self.half] @ self.one.T, x[:, self.half :] @ self.two.T

    def decode(self, units: np.ndarray) -> list[np.ndarray]:
        """For each vector the numbers of all filters that it exceeds."""
        a, b = self._scores(units)
        out = []
        for x, y in zip(a, b, strict=True):
            least = self.threshold
            i, j = np.flatnonzero(x >= least - y.max()), np.flatnonzero(y >= least - x.max())
            sums = x[i][:, None] + y[j][None, :]
            p, q = np.nonzero(sums >= least)
            if len(p) < LEAST:  # its best filters all the same
                i, j = np.argsort(-x)[:LEAST], np.argsort(-y)[:LEAST]
                best = np.argsort(-(x[i][:, None] + y[j][None, :]).ravel())[:LEAST]
                p, q = best // len(j), best % len(j)
            out.append(i[p].astype(np.int64) * self.words + j[q])
        return out


def _vectors(data: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """row, id, unit (double bytes, null if it links with nothing), raw (bytes as they came)."""
    schema = T.StructType([T.StructField("id", data.schema[id_col].dataType), T.StructField("unit", T.BinaryType()), T.StructField("raw", T.BinaryType())])

    def run(batches):
        for b in batches:
            units, raws = [], []
            for x in b.column(1):
                v = np.array([np.nan if c is None else c for c in (x.as_py() or [])], np.float64)
                if len(v) and np.isfinite(v).all() and v.any():
                    v = v / np.abs(v).max()  # against overflow and underflow
                    raws.append(v.tobytes())
                    units.append((v / np.sqrt((v * v).sum())).tobytes())
                else:
                    raws.append(None)
                    units.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(units, pa.binary()), pa.array(raws, pa.binary())], names=schema.names)

    return data.select(id_col, vec_col).mapInArrow(run, schema)


def _filters(nodes: DataFrame, words: int) -> DataFrame:
    """node, filter (long) of every filter that a node exceeds."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("filter", T.LongType())])

    def run(batches):
        codes: dict[int, ProductCode] = {}
        for b in batches:
            ids, units = b.column(0).to_pylist(), [np.frombuffer(x, np.float64) for x in b.column(1).to_pylist()]
            for dim in sorted({len(u) for u in units}):
                mine = [i for i, u in enumerate(units) if len(u) == dim]
                if dim not in codes:
                    codes[dim] = ProductCode(dim, words)
                got = codes[dim].decode(np.stack([units[i] for i in mine]))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([ids[i] for i in mine], [len(g) for g in got]).astype(np.int64)), pa.array(np.concatenate(got) + dim * words * words)], names=schema.names)

    return nodes.select("node", "unit").mapInArrow(run, schema)


def _cosines(pairs: DataFrame, units: DataFrame, least: float) -> DataFrame:
    """pairs (a, b, more columns) with their cosine, where it is at least least."""
    schema = T.StructType([*pairs.schema.fields, T.StructField("cos", T.DoubleType())])
    width = len(pairs.columns)

    def run(batches):
        for x in batches:
            if not x.num_rows:
                continue
            a, b = x.column(width).to_pylist(), x.column(width + 1).to_pylist()
            cos = np.array([float(np.dot(np.frombuffer(p, np.float64), np.frombuffer(q, np.float64))) if len(p) == len(q) else -2.0 for p, q in zip(a, b, strict=True)])
            good = pa.array(np.flatnonzero(cos >= least))
            yield pa.RecordBatch.from_arrays([*(c.take(good) for c in x.columns[:width]), pa.array(cos).take(good)], names=schema.names)

    left, right = units.select(F.col("node").alias("a"), F.col("unit").alias("_ua")), units.select(F.col("node").alias("b"), F.col("unit").alias("_ub"))
    return pairs.join(right, "b").join(left, "a").select(*pairs.columns, "_ua", "_ub").mapInArrow(run, schema)


def links(data: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id (smallest id reachable), kept."""
    base = cut(_vectors(data, id_col, vec_col), "vectors")
    valid = base.where("unit is not null")
    # a node for each distinct vector; a hash of all its bytes names it, in 63 bits of which two are checked against each other
    key = F.sha2("raw", 256)
    classes = cut(valid.groupBy(key.alias("key")).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m"), F.first("unit").alias("unit")).withColumn("node", F.expr("cast(conv(substring(key, 1, 15), 16, 10) as bigint)")), "classes")
    n = classes.count()
    # filters = words squared, 64 for each node at least
    words = 1 << max(6, math.ceil(math.log2(math.sqrt(64 * max(1, n)))))
    units = classes.select("node", "unit")
    rows = cut(_filters(units, words).distinct(), "filters")

    theta = math.acos(cosine)
    ball_cos = math.cos(theta / 2) + MARGIN
    balls, open_rows = None, rows
    for _ in range(ROUNDS):
        hot = open_rows.groupBy("filter").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT)
        near = _cosines(open_rows.join(hot, "filter").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), units, ball_cos)
        found = cut(near.groupBy(F.col("a").alias("node")).agg(F.min(F.struct("b", "cos")).alias("x")).select("node", F.col("x.b").alias("ball"), F.col("x.cos").alias("cos")), "balls")
        if found.isEmpty():
            break
        balls = found if balls is None else balls.unionByName(found)
        open_rows = open_rows.join(found.select("node"), "node", "left_anti")
    lone = classes.select("node", F.col("node").alias("ball"), F.lit(1.0).alias("cos"))
    if balls is None:
        members = lone
    else:  # a pivot's number may be its own node's ball as well: balls of several are told apart by their sign
        members = balls.select("node", (-1 - F.col("ball")).alias("ball"), "cos").unionByName(lone.join(balls.select("node"), "node", "left_anti"))
    members = cut(members.join(classes.select("node", "least", "m"), "node"), "members")
    ball = members.groupBy("ball").agg(F.sum("m").alias("weight"), F.min("least").alias("least"), F.acos(F.least(F.lit(1.0), F.min("cos"))).alias("radius"), F.count(F.lit(1)).alias("size"))
    ball = cut(ball.withColumn("radius", F.when(F.col("size") > 1, F.col("radius") + MARGIN).otherwise(F.when(F.col("ball") < 0, F.col("radius") + MARGIN).otherwise(0.0))), "ball")

    # balls that share a filter through any of their members
    touched = rows.join(members.select("node", "ball"), "node").select("filter", "ball").distinct()
    pairs = touched.select("filter", F.col("ball").alias("x")).join(touched.select("filter", F.col("ball").alias("y")), "filter").where("x < y").select("x", "y").distinct()
    centre = lambda c: F.when(F.col(c) < 0, -1 - F.col(c)).otherwise(F.col(c))
    side = lambda c: ball.select(F.col("ball").alias(c), F.col("radius").alias(f"r{c}"))
    pairs = pairs.join(side("x"), "x").join(side("y"), "y").select(centre("x").alias("a"), centre("y").alias("b"), "x", "y", "rx", "ry")
    angle = F.acos(F.least(F.lit(1.0), F.col("cos")))
    reach = F.col("rx") + F.col("ry")
    lone_pair = reach == 0
    judged = _cosines(pairs, units, min(cosine, math.cos(min(math.pi, 2 * theta + 4 * MARGIN))))
    judged = judged.withColumn("all", F.when(lone_pair, F.col("cos") >= cosine).otherwise(angle + reach + MARGIN <= theta))
    judged = cut(judged.where(F.col("all") | (~lone_pair & (angle - reach - MARGIN <= theta))).select("x", "y", "all"), "judged")
    inside = members.select("ball", "node")
    some = judged.where("not all").join(inside.select(F.col("ball").alias("x"), F.col("node").alias("a")), "x").join(inside.select(F.col("ball").alias("y"), F.col("node").alias("b")), "y").select("a", "b", "x", "y")
    single = cut(_cosines(some, units, cosine).select("a", "b", "x", "y"), "single")

    whole = judged.where("all").select("x", "y")
    both = lambda d, a, b: d.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(d.select(F.col(b).alias("u"), F.col(a).alias("v")))
    from_balls = both(whole, "x", "y").join(ball.select(F.col("ball").alias("v"), "weight"), "v").groupBy(F.col("u").alias("ball")).agg(F.sum("weight").alias("by_ball"))
    from_nodes = both(single, "a", "b").join(classes.select(F.col("node").alias("v"), "m"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("m").alias("by_node"))
    parts = graph.components(whole.unionByName(single.select("x", "y")), "x", "y")
    parts = cut(ball.select("ball", "least").join(parts.withColumnRenamed("node", "ball"), "ball", "left").select("ball", "least", F.coalesce("component", "ball").alias("part")), "parts")
    smallest = parts.groupBy("part").agg(F.min("least").alias("component_id"))
    per_ball = parts.join(smallest, "part").select("ball", "component_id").join(ball.select("ball", "weight"), "ball").join(from_balls, "ball", "left")
    per_node = members.select("node", "ball").join(per_ball, "ball").join(from_nodes, "node", "left")
    per_node = per_node.select("node", "component_id", (F.col("weight") - 1 + F.coalesce("by_ball", F.lit(0)) + F.coalesce("by_node", F.lit(0))).alias("n_links"))
    named = classes.select("key", "node").join(per_node, "node").select("key", "component_id", "n_links")
    out = base.select("id", F.when(F.col("raw").isNotNull(), key).alias("key")).withColumn("key", F.coalesce("key", F.concat(F.lit("none"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    out = out.join(named, "key", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
