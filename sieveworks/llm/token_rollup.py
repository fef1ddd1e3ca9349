"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas. A batch of changes (insert, revise, delete)
is counted once, compared with the ledger of what each document counted before, and committed by renaming one entry of a
log into place under the next number, which fails if another writer has taken it; the comparison is then made anew. A
batch id that is in the log is not applied again, and a batch that died half-way leaves only a folder that no entry names.
Documents and deltas are never rewritten; compact() writes the ledger and the totals of all entries so far as one, so that
later commits read that and what came after it.

Defined results: null texts count 0 tokens; null source or language is a group of its own; of several changes of one
document in one batch, that with the largest seq counts (among equals, the one with the most tokens); inserting a known
document revises it, revising or deleting an unknown one inserts it or does nothing; rows without an id are plain
additions, as nothing can name them later; extra columns are not looked at.
"""

from __future__ import annotations

import base64
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.llm.common import drop_path, new_path

#: Where the public vocabularies are; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ("source", "lang", "tokenizer")
TOTALS = ("n_docs", "n_tokens", "n_chars")
_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file of ranks; one per worker and file."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(enc, text: str | None) -> int:
    if not text:
        return 0
    try:
        return len(enc.encode_ordinary(text))
    except Exception:  # noqa: BLE001  the engine gives up on very long runs of one class: the same pieces, one by one
        import regex

        return sum(len(enc.encode_single_piece(p.encode())) if hasattr(enc, "encode_single_piece") else len(enc._encode_single_piece(p)) for p in regex.findall(PATTERN, text))


def counted(changes: DataFrame, tokenizer: str, path: str) -> DataFrame:
    """changes with token and character counts in place of their texts."""
    keep = ["op", "doc_id", "source", "lang", "seq"]
    schema = T.StructType([*(changes.schema[c] for c in keep), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([tokenizer] * len(texts), pa.string()), pa.array([count_tokens(enc, t) for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], names=schema.names)

    return changes.select(*keep, F.when(F.col("op") != "delete", F.col("text")).alias("text")).mapInArrow(run, schema)


class TokenRollup:
    """A rollup kept in one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str | None = None, tokenizer: str = "byte_bpe_50k", vocabulary: str = VOCABULARY):
        self.spark, self.root, self.tokenizer, self.vocabulary = spark, root or new_path(spark, "tokens"), tokenizer, vocabulary
        self._java = spark.sparkContext._jvm
        self._path = self._java.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _names(self) -> list[str]:
        """The names of the log's entries in their order: number, folder, kind and batch id."""
        at = self._path(f"{self.root}/log")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at) if x.getPath().getName()[0].isdigit()) if self._fs.exists(at) else []

    def _entries(self) -> list[tuple[int, str, str, str]]:
        """(number, folder, kind, batch id) of each entry; kind is batch or base."""
        out = []
        for name in self._names():
            stream = self._fs.open(self._path(f"{self.root}/log/{name}"))
            try:
                size = stream.available()
                text = bytes(b & 255 for b in stream.readNBytes(size)).decode()
            finally:
                stream.close()
            out.append((int(name), *text.split("\n", 2)))
        return out

    def _publish(self, number: int, folder: str, kind: str, batch_id: str) -> bool:
        """Takes a number of the log for a folder that is complete; False if it is taken."""
        draft = self._path(f"{self.root}/log/_{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(f"{folder}\n{kind}\n{batch_id}".encode()))
        finally:
            stream.close()
        files = self._java.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self._conf)
        rename = self._java.org.apache.hadoop.fs.Options.Rename
        plainly = self.spark.sparkContext._gateway.new_array(rename, 1)
        plainly[0] = rename.NONE  # an entry that is there is never replaced
        try:
            files.rename(draft, self._path(f"{self.root}/log/{number:08d}"), plainly)
        except Exception as e:  # noqa: BLE001  the JVM's own class, wrapped
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(draft, False)
            return False
        return True

    @staticmethod
    def _current(entries):
        """The last base, if there is one, and what came after it."""
        at = max((i for i, e in enumerate(entries) if e[2] == "base"), default=0)
        return entries[at:]

    def batches(self) -> list[str]:
        """The committed batch ids in the order of their commit."""
        return [e[3] for e in self._entries() if e[2] == "batch"]

    def _ledger(self, entries) -> DataFrame | None:
        rows = None
        for number, folder, _, _ in self._current(entries):
            part = self.spark.read.parquet(f"{self.root}/data/{folder}/ledger").where("doc_id is not null").withColumn("batch_no", F.lit(number))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return None
        last = rows.groupBy("doc_id", "tokenizer").agg(F.max_by(F.struct("source", "lang", "live", "n_tokens", "n_chars"), "batch_no").alias("now"))
        return last.select("doc_id", "tokenizer", "now.*").where("live")

    def ledger(self) -> DataFrame | None:
        """What each named document counts now, by tokenizer version."""
        return self._ledger(self._entries())

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Applies one batch; False if it was there already. changes: op, doc_id, source, lang, text and optionally seq."""
        if batch_id in self.batches():
            return False
        folder = uuid.uuid4().hex
        if "seq" not in changes.columns:
            changes = changes.withColumn("seq", F.lit(0).cast("long"))
        new = lambda rows: counted(changes.where(rows), self.tokenizer, self.vocabulary)  # noqa: E731  filtered before, so that each text is counted once
        value = F.struct("seq", "n_tokens", "n_chars", "op", "source", "lang")
        named = new("doc_id is not null").groupBy("doc_id", "tokenizer").agg(F.max(value).alias("v"))
        plain = new("doc_id is null and op != 'delete'").select("doc_id", "tokenizer", value.alias("v"))
        rows = named.unionByName(plain).select("doc_id", "tokenizer", "v.source", "v.lang", (F.col("v.op") != "delete").alias("live"), "v.n_tokens", "v.n_chars")
        rows.write.parquet(f"{self.root}/data/{folder}/ledger")
        added = self.spark.read.parquet(f"{self.root}/data/{folder}/ledger")
        while True:
            entries = self._entries()
            if batch_id in {e[3] for e in entries if e[2] == "batch"}:  # another writer was faster
                drop_path(self.spark, f"{self.root}/data/{folder}")
                return False
            signed = added.where("live").select(*KEYS, F.lit(1).alias("sign"), "n_tokens", "n_chars")
            if (before := self._ledger(entries)) is not None:
                gone = before.join(added.where("doc_id is not null").select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
                signed = signed.unionByName(gone.select(*KEYS, F.lit(-1).alias("sign"), "n_tokens", "n_chars"))
            delta = signed.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), *(F.sum(F.col("sign") * F.col(c)).cast("long").alias(c) for c in TOTALS[1:]))
            delta.write.mode("overwrite").parquet(f"{self.root}/data/{folder}/delta")
            if self._publish(len(entries), folder, "batch", batch_id):
                return True

    def compact(self) -> bool:
        """Writes the ledger and the totals of all entries as one; False if there are none or another writer came between."""
        entries = self._entries()
        if len(self._current(entries)) < 2:
            return False
        folder = uuid.uuid4().hex
        self._ledger(entries).withColumn("live", F.lit(True)).write.parquet(f"{self.root}/data/{folder}/ledger")
        self._totals(entries).write.parquet(f"{self.root}/data/{folder}/delta")
        if self._publish(len(entries), folder, "base", ""):
            return True
        drop_path(self.spark, f"{self.root}/data/{folder}")
        return False

    def _totals(self, entries) -> DataFrame:
        rows = self.spark.read.parquet(*(f"{self.root}/data/{e[1]}/delta" for e in self._current(entries)))
        return rows.groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in TOTALS)).where("n_docs != 0")

    def totals(self) -> DataFrame:
        """The current totals: the sum of the committed deltas; groups that are back at zero documents are left out."""
        entries = self._entries()
        if not entries:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long")
        return self._totals(entries)
