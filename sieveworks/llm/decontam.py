"""Benchmark decontamination: n-gram seeds, rarest first, then Smith-Waterman alignment.

A first pass counts in how many texts each n-gram of the benchmark occurs. Every n-gram that occurs in any is a seed, so
that each leak whose alignment keeps N words in a row somewhere is found with its full score; one that keeps fewer
everywhere (such as a copy with a word inserted after every second) is not. A second pass joins texts to items at the
seeds, and aligns the words around the seeds, as far as a leak can reach, with the whole item; the places of a pair
with the rarest seeds come first and rule out others. A pair is a leak if its local alignment (match 2, mismatch and gap
-1) reaches SHARE of the item's perfect score, or the score of LONG copied words in a longer item.

The benchmark is handled in blocks of bounded size, each one broadcast; the texts are never shuffled. Decisions are
taken row by row.

Defined results: words are compared in lower case; null and empty texts leak nothing; items of fewer than N words are
not looked for; rows that repeat, or lack an id, are each judged on their own; several places in one text count by the
best; equal items each give a row; extra columns are passed on by clean() and not looked at by leaks().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.llm.kernels import text_ngrams, word_hashes

N, STRIDE = 3, 1
SHARE, LONG = 0.6, 20
#: Characters of benchmark text in one broadcast block.
BLOCK_CHARS = 8_000_000


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of two word sequences; start and end in text, the latter exclusive."""
    cols = np.arange(1, len(text) + 1)
    row, origin = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    best = (0, 0, 0)
    for word in item:
        step = row[:-1] + np.where(text == word, 2, -1)
        down = row[1:] - 1
        new = np.maximum(np.maximum(step, down), 0)
        start = np.where(new == 0, cols, np.where(new == step, origin[:-1], origin[1:]))
        # a gap in the item: the best cell to the left, less one for each word between
        lifted = np.maximum.accumulate(new + cols)
        sideways = lifted - cols
        far = sideways > new
        if far.any():
            source = np.maximum.accumulate(np.where(new + cols == lifted, np.arange(len(text)), 0))
            start = np.where(far, start[source], start)
            new = np.where(far, sideways, new)
        row, origin = np.concatenate([[0], new]), np.concatenate([[0], start])
        at = int(new.argmax())
        if new[at] > best[0]:
            best = (int(new[at]), int(start[at]), at + 1)
    return best


def threshold(words: int) -> float:
    return min(2 * SHARE * words, 2.0 * LONG)


def _blocks(benchmark: DataFrame):
    """Lists of (item_id, text) of about BLOCK_CHARS characters."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-int(chars) // BLOCK_CHARS))
    for k in range(parts):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        yield sorted(((r[0], r[1]) for r in got), key=lambda r: (r[0] is not None, r[0], r[1]))


def _item_grams(block):
    """(word hashes by item, gram hash, item number and word position of every n-gram)."""
    hashes, bounds = word_hashes(pa.array([t for _, t in block], pa.string()))
    grams, own, pos = text_ngrams(hashes, bounds, N)
    return [hashes[bounds[i] : bounds[i + 1]] for i in range(len(block))], grams, own, pos


def _frequency(docs: DataFrame, text_col: str, known: np.ndarray) -> np.ndarray:
    """In how many texts each of the known n-grams (sorted, distinct) occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    schema = T.StructType([T.StructField("gram", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches):
        total = np.zeros(len(shared.value), np.int64)
        for b in batches:
            hashes, bounds = word_hashes(b.column(0))
            grams, own, _ = text_ngrams(hashes, bounds, N)
            at = _lookup(shared.value, grams)
            hit = at >= 0
            seen = np.unique(own[hit] * len(total) + at[hit])
            total += np.bincount(seen % len(total), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["gram", "n"])

    counts = np.zeros(len(known), np.int64)
    for r in docs.select(F.col(text_col).cast("string")).mapInArrow(run, schema).groupBy("gram").agg(F.sum("n")).toLocalIterator():  # at most one row per benchmark n-gram
        counts[r[0]] = r[1]
    return counts


def _lookup(known: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The place of each gram in known, or -1; a table of low bits answers for most."""
    if not len(known) or not len(grams):
        return np.full(len(grams), -1)
    bits = 20
    flags = np.zeros(1 << bits, bool)
    flags[(known & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    out = np.full(len(grams), -1)
    maybe = np.flatnonzero(flags[(grams & np.uint64((1 << bits) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, grams[maybe]), len(known) - 1)
    good = known[at] == grams[maybe]
    out[maybe[good]] = at[good]
    return out


def _seeds(docs: DataFrame, text_col: str, block) -> dict:
    """The block's items and its seeds: sorted seed hashes, and for each the (item, position) places where it stands."""
    items, grams, own, pos = _item_grams(block)
    known = np.unique(grams)
    if not len(known):
        return {"items": items, "seeds": known, "places": [], "rarity": []}
    rarity = _frequency(docs, text_col, known)[np.searchsorted(known, grams)]
    chosen: dict[int, list] = {}
    for k in np.flatnonzero(rarity):  # what no text has cannot be met
        chosen.setdefault(int(grams[k]), []).append((int(own[k]), int(pos[k])))
    counts = dict(zip(grams.tolist(), rarity.tolist(), strict=True))
    seeds = np.array(sorted(chosen), np.uint64)
    return {"items": items, "seeds": seeds, "places": [chosen[int(s)] for s in seeds], "rarity": [counts[int(s)] for s in seeds]}


def _found(texts: pa.Array, plan: dict) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, score, first word, end word) of each leak among texts."""
    hashes, bounds = word_hashes(texts)
    grams, own, pos = text_ngrams(hashes, bounds, N)
    at = _lookup(plan["seeds"], grams)
    spots: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k in np.flatnonzero(at >= 0):
        for item, where in plan["places"][at[k]]:
            spots.setdefault((int(own[k]), item), []).append((int(pos[k]) - where, plan["rarity"][at[k]]))
    out = []
    for (d, i), shifts in spots.items():
        words, item = hashes[bounds[d] : bounds[d + 1]], plan["items"][i]
        least, best = threshold(len(item)), (0, 0, 0)
        slack = int(2 * len(item) - least)  # the most words that a leak can have inserted
        shifts.sort()
        parts: list[list[int]] = []  # [count of the rarest seed, first word, end word]
        for shift, count in shifts:
            lo, hi = max(0, shift - slack), shift + len(item) + slack
            if parts and lo <= parts[-1][2]:
                parts[-1][0], parts[-1][2] = min(parts[-1][0], count), hi
            else:
                parts.append([count, lo, hi])
        for _, lo, hi in sorted(parts):
            part = words[lo:hi]
            if 2 * min(np.isin(item, part).sum(), np.isin(part, item).sum()) < max(least, best[0]):
                continue  # cannot reach it
            score, a, b = align(item, part)
            if score > best[0] or score == best[0] and lo + a < best[1]:
                best = (score, lo + a, lo + b)
        if best[0] >= least:
            out.append((d, i, *best))
    return out


LEAK = T.StructType([T.StructField("score", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text and benchmark item that it leaks: ids, score, similarity (share of the perfect score), and where."""
    sc = docs.sparkSession.sparkContext
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType), *LEAK.fields])
    rows, out = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")), None
    for block in _blocks(benchmark):
        shared = sc.broadcast(_seeds(rows, "_text", block))
        names = sc.broadcast([i for i, _ in block])

        def run(batches, shared=shared, names=names):
            for b in batches:
                got = _found(b.column(1), shared.value)
                cols = [b.column(0).take(pa.array([g[0] for g in got], pa.int64())), pa.array([names.value[g[1]] for g in got]).cast(schema_item), pa.array([g[2] for g in got], pa.int64()), pa.array([g[2] / (2 * len(shared.value["items"][g[1]])) for g in got], pa.float64()), pa.array([g[3] for g in got], pa.int64()), pa.array([g[4] for g in got], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

        from pyspark.sql.pandas.types import to_arrow_type

        schema_item = to_arrow_type(schema["item_id"].dataType)
        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the texts that leak an item."""
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark):
        shared = sc.broadcast(_seeds(docs, text_col, block))

        def run(batches, shared=shared):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[g[0] for g in _found(b.column(at), shared.value)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
