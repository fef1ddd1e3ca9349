"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's documents are cut into blocks of equal size, in the order of the MD5 of their ids. Of the P slots of a
period, a source of weight w gets q = round(w P) (one at least; P is their sum). Its block j of a period has release
time floor(j P / q) and deadline ceil((j + 1) P / q); earliest deadline first among the released blocks fills every slot
and keeps each source within less than one block of its target at every slot, as long as no source has run out. What
has run out is passed over; every document comes once.

Only the schedule of one period is made in one place: it has P rows, and P is at most the parameter slots plus the number
of sources, whatever the number of documents. Ranks within a source are taken by leading digits of the hash, so a source
that holds most rows is spread over many tasks. A block's position is the sum of the sizes of the blocks before it, by
stretches of slots: of blocks only, so that documents move once, however many sources there are.

Defined results: a null source is a source of its own; null ids hash like the empty text; rows with equal ids each get a
position of their own, in arbitrary order; an empty table gives an empty result; extra columns are passed on, whatever
their names (only those of ADDED are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADDED = ("mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position")
BLOCK_DOCS, SLOTS = 16, 1000
#: Slots whose blocks' sizes are summed up together.
STRETCH = 128


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def quotas(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, slots: int = SLOTS) -> DataFrame:
    """One row per source: src, n (documents), q (slots of a period). weights: by source; those not named, and all if
    there are none, count the square root of their documents, scaled to the weight that is left or the named sources' mean."""
    per = docs.groupBy(_key(source).alias("src")).agg(F.count(F.lit(1)).alias("n"))
    raw = F.sqrt("n")
    if weights:
        given = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (f"={k}", float(v))))
        mean = sum(weights.values()) / len(weights)
        raw = F.coalesce(F.element_at(given, F.col("src")), F.lit(float(mean)))
    total = per.agg(F.sum(raw).alias("total"))
    return per.crossJoin(F.broadcast(total)).select("src", "n", F.greatest(F.lit(1), F.round(raw / F.col("total") * F.lit(slots))).cast("long").alias("q"))


def schedule(quota: DataFrame) -> DataFrame:
    """One row per slot of a period: src, j (block of the period), slot, release, deadline, q, and period (P) in each row.

    The slots are filled one after the other from a pool of released blocks that is kept sorted by deadline, and by
    source where deadlines are equal."""
    one = quota.agg(F.array_sort(F.collect_list(F.struct("src", "q"))).alias("s"), F.sum("q").alias("p")).where("p > 0")
    blocks = one.select("p", F.size("s").cast("long").alias("m"), F.posexplode("s").alias("i", "x")).select("p", "m", "i", "x.q", F.explode(F.expr("sequence(0L, x.q - 1)")).alias("j"))
    due = blocks.select(F.expr("(j * p) div q").alias("release"), F.expr("((j + 1) * p + q - 1) div q * m + i").alias("due"))
    released = due.groupBy("release").agg(F.collect_list("due").alias("due"))
    pool = one.crossJoin(released.agg(F.map_from_entries(F.collect_list(F.struct("release", "due"))).alias("at")))
    none = "cast(array() as array<bigint>)"
    ready = f"array_sort(concat(slice(a.ready, 2, greatest(0, size(a.ready) - 1)), coalesce(at[t], {none})))"
    step = f"transform(array({ready}), r -> named_struct('ready', r, 'took', concat(a.took, array(r[0]))))[0]"
    pool = pool.select("s", "p", F.expr(f"aggregate(sequence(0L, p - 1), named_struct('ready', {none}, 'took', {none}), (a, t) -> {step}).took").alias("took"))
    rows = pool.select("p", "s", F.posexplode("took").alias("slot", "due")).select(F.expr("s[cast(due % size(s) as int)]").alias("x"), F.col("p").alias("period"), F.col("slot").cast("long").alias("slot"))
    rows = rows.select("x.src", "x.q", "period", "slot").withColumn("j", F.row_number().over(Window.partitionBy("src").orderBy("slot")).cast("long") - 1)
    return rows.withColumn("release", F.expr("(j * period) div q")).withColumn("deadline", F.expr("((j + 1) * period + q - 1) div q"))


def _before(sizes: DataFrame, at: str, size: str, stretch: int = 4096) -> DataFrame:
    """at, before: the sum of size over all rows with a smaller at (distinct whole numbers from 0 on), by stretches first."""
    own = Window.partitionBy("far").orderBy(at)
    parts = sizes.withColumn("far", F.expr(f"{at} div {stretch}")).withColumn("own", F.sum(size).over(own) - F.col(size))
    whole = parts.groupBy("far").agg(F.sum(size).alias("whole"))
    whole = whole.select("far", (F.sum("whole").over(Window.orderBy("far")) - F.col("whole")).alias("earlier"))
    return parts.join(whole, "far").select(at, (F.col("earlier") + F.col("own")).alias("before"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, slots: int = SLOTS, id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with ADDED: block within its source, slot of that block with its release time and deadline, and the
    document's position in the mix from 0 on. Columns of docs with such names are replaced."""
    docs = docs.drop(*ADDED)
    quota = quotas(docs, source, weights, slots)
    plan = schedule(quota)
    # the caller's columns stay in one struct, so that their names meet none of those used here
    whole = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("doc")
    hashed = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(_key(source).alias("src"), F.substring(hashed, 1, 3).alias("cell"), hashed.alias("h"), whole)
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("src", "cell").orderBy("h", F.col("doc")[id_col])) - 1)
    # at most 4096 rows a source
    cells = docs.groupBy(_key(source).alias("src"), F.substring(hashed, 1, 3).alias("cell")).agg(F.count(F.lit(1)).alias("here"))
    cells = cells.withColumn("first", F.sum("here").over(Window.partitionBy("src").orderBy("cell")) - F.col("here"))
    # the blocks that a cell has documents of, each counted in the cell where it begins
    blocks = cells.join(F.broadcast(quota), "src").withColumn("k", F.explode(F.expr(f"sequence(first div {block_docs}, (first + here - 1) div {block_docs})")))
    blocks = blocks.withColumn("round", F.expr("k div q")).withColumn("j", F.expr("k % q")).withColumn("size", F.expr(f"if(k * {block_docs} >= first, least({block_docs}, n - k * {block_docs}), 0)"))
    blocks = blocks.drop("q").join(F.broadcast(plan), ["src", "j"])
    shift = F.col("round") * F.col("period")
    blocks = blocks.withColumn("at", shift + F.col("slot")).withColumn("part", F.expr(f"at div {STRETCH}"))
    earlier = Window.partitionBy("part").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("within", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    blocks = blocks.join(_before(blocks.groupBy("part").agg(F.sum("size").alias("all")), "part", "all"), "part")
    added = [F.col("k"), F.col("at"), shift + F.col("release"), shift + F.col("deadline"), F.col("before") + F.col("within")]
    placed = F.array_sort(F.collect_list(F.struct(*(c.cast("long").alias(n) for c, n in zip(added, ADDED, strict=True)))))
    per_cell = blocks.groupBy("src", "cell").agg(placed.alias("blocks"), F.first("first").alias("first"))
    rows = rows.join(per_cell, ["src", "cell"]).withColumn("rank", F.col("first") + F.col("r"))
    rows = rows.select("doc", "rank", F.expr(f"blocks[cast(rank div {block_docs} - first div {block_docs} as int)]").alias("at"))
    return rows.select("doc.*", *(F.col("at")[n].alias(n) for n in ADDED[:-1]), (F.col("at")[ADDED[-1]] + F.col("rank") % block_docs).alias(ADDED[-1]))
