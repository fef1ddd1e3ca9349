"""Texts alike by their pairs of characters: all pairs of a block, by bits in tiles.

Each text becomes a row of bits, one for each of the most frequent pairs of characters of all rows, and a list of its other
pairs, so that nothing is left out. The rows of a block, in order of their numbers of pairs, are cut into parts of about
PART rows; a tile is two parts whose numbers are near enough, and is compared by itself. No candidates are written: a tile
rules pairs out by the bits that tell texts apart best, and counts the rest in full. Two texts that are alike to at least
least differ in at most (1 - least) / (1 + least) of the sum of their numbers, in whatever bits are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one part, pairs of characters that have a bit, words of 64 bits looked at first, and pairs compared at once.
PART, COMMON, FIRST, AT_ONCE = 16384, 4096, 4, 1 << 17
_SHORT = 1 << 62


def grams_of(text: str) -> np.ndarray:
    """The distinct pairs of neighbouring characters as numbers; a shorter text is one number of its own."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(c) < 2:
        return np.array([_SHORT | (int(c[0]) if len(c) else 1 << 21)], np.int64)
    g = np.sort(c[:-1] << 32 | c[1:])
    return g[np.concatenate([[True], g[1:] != g[:-1]])]


def _counts(batches):
    for b in batches:
        grams = [grams_of(t) for t in b.column(0).to_pylist()]
        values, counts = np.unique(np.concatenate(grams), return_counts=True) if grams else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(np.append(values, -1)), pa.array(np.append(counts, len(grams)))], names=["g", "n"])


def encoded(rows: DataFrame, block: list[str], key: str, text: str) -> DataFrame:
    """_b0, ... (the block), k, n (distinct pairs of characters), bits, rare; rows without a block, a key or a text are left out."""
    cols = [F.col(c) for c in block] or [F.lit(0)]
    names = [f"_b{i}" for i in range(len(cols))]
    base = rows.select(*(c.alias(n) for c, n in zip(cols, names, strict=True)), F.col(key).alias("k"), F.col(text).cast("string").alias("t")).dropna()
    seen = base.select("t").mapInArrow(_counts, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    top = [(r["g"], r["n"]) for r in seen.where("n > 1").orderBy(F.desc("n"), "g").limit(COMMON + 1).collect()]
    total = dict(top).get(-1, 1)
    # what half of the texts have tells them apart best and comes first
    grams = [g for g, n in sorted(top, key=lambda x: (abs(2 * x[1] - total), x[0])) if g >= 0][:COMMON]
    own, place = np.array(sorted(grams), np.int64), np.argsort(np.argsort(np.array(grams, np.int64)))
    column = np.empty(len(grams), np.int64)
    column[place] = np.arange(len(grams))
    shared = rows.sparkSession.sparkContext.broadcast((own, column, max(1, -(-len(grams) // 64)) * 64))
    kept = [base.schema[n] for n in [*names, "k"]]
    schema = T.StructType([*kept, T.StructField("n", T.IntegerType()), T.StructField("bits", T.BinaryType()), T.StructField("rare", T.ArrayType(T.LongType()))])

    def run(batches):
        own, column, width = shared.value
        for b in batches:
            sizes, bits, rare = [], [], []
            for t in b.column(len(kept)).to_pylist():
                g = grams_of(t)
                at = np.minimum(np.searchsorted(own, g), max(0, len(own) - 1))
                has = own[at] == g if len(own) else np.zeros(len(g), bool)
                row = np.zeros(width, np.uint8)
                row[column[at[has]]] = 1
                sizes.append(len(g))
                bits.append(np.packbits(row, bitorder="little").tobytes())
                rare.append(g[~has])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(rare, pa.list_(pa.int64()))], names=schema.names)

    return base.mapInArrow(run, schema)


class Tile:
    """Rows of one or two parts, sorted by part and number of pairs of characters."""

    def __init__(self, table: pa.Table, least: float):
        self.least = least
        side, n = (table.column(c).to_numpy() for c in ("side", "n"))
        order = np.lexsort((n, side))
        table = table.take(pa.array(order)).combine_chunks()
        self.k, self.n, self.side = table.column("k").combine_chunks(), n[order].astype(np.int64), side[order]
        bits = table.column("bits").combine_chunks()
        self.bits = np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(len(order), -1)
        self.head = np.ascontiguousarray(self.bits[:, :FIRST].T)
        rare = table.column("rare").combine_chunks()
        self.count = np.asarray(rare.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        self.start = np.cumsum(self.count) - self.count
        self.rare = np.unique(rare.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int64)
        self.owned = np.sort(self.rare * len(order) + np.repeat(np.arange(len(order)), self.count))

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows, of different parts if there are two, that the first bits do not rule out."""
        rows, cut = len(self.n), int(np.searchsorted(self.side, 1))
        alone = cut == rows
        far = (1 - self.least) / (1 + self.least)
        others = self.n if alone else self.n[cut:]
        base, i = 0 if alone else cut, 0
        while i < cut:
            lo = base + int(np.searchsorted(others, self.least * self.n[i] - 1e-6)) if not alone else i + 1
            step = max(1, AT_ONCE // max(1, rows - lo))
            j = min(cut, i + step)
            hi = base + int(np.searchsorted(others, self.n[j - 1] / self.least + 1e-6, "right"))
            if lo < hi:
                differ = np.zeros((j - i, hi - lo), np.uint16)
                for w in self.head:
                    differ += np.bitwise_count(w[i:j, None] ^ w[None, lo:hi])
                limit = far * (self.n[i:j, None] + self.n[None, lo:hi]) + 1e-6
                a, b = np.nonzero(differ <= limit)
                a, b = a + i, b + lo
                if alone:
                    a, b = a[a < b], b[a < b]
                for at in range(0, len(a), AT_ONCE):
                    yield a[at : at + AT_ONCE], b[at : at + AT_ONCE]
            i = j

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        common = np.zeros(len(a), np.int64)
        step = max(1, AT_ONCE * 8 // self.bits.shape[1])
        for at in range(0, len(a), step):
            common[at : at + step] = np.bitwise_count(self.bits[a[at : at + step]] & self.bits[b[at : at + step]]).sum(1, dtype=np.int64)
        some = np.flatnonzero((self.count[a] > 0) & (self.count[b] > 0))
        least = np.where(self.count[a[some]] <= self.count[b[some]], a[some], b[some])
        other = a[some] + b[some] - least
        ends = np.cumsum(self.count[least])
        first = 0
        while first < len(some):  # the rare ones of the shorter list, looked up in the other row's
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + AT_ONCE * 8, "right")))
            x, y = least[first:last], other[first:last]
            many = self.count[x]
            owner = np.repeat(np.arange(len(x)), many)
            g = self.rare[np.repeat(self.start[x] - (np.cumsum(many) - many), many) + np.arange(len(owner))]
            code = g * len(self.n) + y[owner]
            found = self.owned[np.minimum(np.searchsorted(self.owned, code), len(self.owned) - 1)] == code
            common[some[first:last]] += np.bincount(owner[found], minlength=len(x))
            first = last
        return common / (self.n[a] + self.n[b] - common)

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a, b in self.candidates():
            s = self.similarity(a, b)
            ok = s >= self.least - 1e-9
            if ok.any():
                yield a[ok], b[ok], s[ok]

    def forest(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each row of the tile that links reach, with the one that stands for all that they connect; no similarities."""
        root = np.arange(len(self.n))

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in self.candidates():
            new = root[a] != root[b]
            a, b = a[new], b[new]
            s = self.similarity(a, b)
            ok = s >= self.least - 1e-9
            for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                x, y = top(x), top(y)
                root[max(x, y)] = min(x, y)
            while not np.array_equal(up := root[root], root):
                root[:] = up
        tied = np.flatnonzero(root != np.arange(len(root)))
        yield tied, root[tied], np.zeros(len(tied))


def _tiles(rows: DataFrame, least: float, forest: bool) -> DataFrame:
    """a, b, similarity of encoded rows, a and b in any order."""
    block = [c for c in rows.columns if c.startswith("_b")]
    part, one, two = ["p", "s"], ["p1", "s1"], ["p2", "s2"]
    sizes = rows.groupBy(*block, "n").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy(*block).orderBy("n")) - F.col("c")
    sizes = sizes.withColumn("p", F.floor(before / PART)).withColumn("of", F.ceil(F.col("c") / PART)).drop("c")
    # rows of one number that are more than a part are dealt to several by their keys
    placed = rows.join(sizes, [*block, "n"]).withColumn("s", F.pmod(F.xxhash64("k"), F.col("of"))).drop("of")
    parts = sizes.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1))).groupBy(*block, *part).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x = parts.select(*block, F.col("p").alias("p1"), F.col("s").alias("s1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    y = parts.select(*block, F.col("p").alias("p2"), F.col("s").alias("s2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    near = x.join(y, block).where("p1 < p2 or p1 = p2 and s1 <= s2").where((F.col("hi1") >= least * F.col("lo2") - 1e-6) & (F.col("hi2") >= least * F.col("lo1") - 1e-6)).select(*block, *one, *two)
    left = near.select("*", F.col("p1").alias("p"), F.col("s1").alias("s"), F.lit(0).alias("side"))
    right = near.where("p1 <> p2 or s1 <> s2").select("*", F.col("p2").alias("p"), F.col("s2").alias("s"), F.lit(1).alias("side"))
    dealt = placed.join(left.unionByName(right), [*block, *part]).select(*block, *one, *two, "side", "k", "n", "bits", "rare")
    schema = T.StructType([T.StructField("a", rows.schema["k"].dataType), T.StructField("b", rows.schema["k"].dataType), T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = Tile(pa.Table.from_batches([b.select(["side", "k", "n", "bits", "rare"]) for b in batches]), least)
        for a, b, s in tile.forest() if forest else tile.links():
            yield pa.RecordBatch.from_arrays([tile.k.take(pa.array(a)), tile.k.take(pa.array(b)), pa.array(s, pa.float64())], names=schema.names)

    return dealt.groupBy(*block, *one, *two).applyInArrow(run, schema)


def similar_pairs(rows: DataFrame, block: list[str], key: str, text: str, least: float = 0.8) -> DataFrame:
    """a, b, similarity of rows of one block whose texts' pairs of characters have a Jaccard similarity of at least least."""
    found = _tiles(encoded(rows, block, key, text), least, forest=False)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").where("a < b")


def similar_links(rows: DataFrame, block: list[str], key: str, text: str, least: float = 0.8) -> DataFrame:
    """a, b that connect the same rows as the pairs of similar_pairs do, in proportion to the rows: of each tile stars."""
    found = _tiles(encoded(rows, block, key, text), least, forest=True)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
