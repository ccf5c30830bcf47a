"""Token counts kept as rollups of signed changes.

Every document is counted once for each tokenizer version. A batch of changes (+1 inserts, -1 deletes, or a pair of
both for a revised count) is summed by source, language and version and committed under its batch id. Totals are
the sums of all committed batches, so they never need the documents again. A batch is committed by renaming one
marker file that names its data: the first marker wins, a batch that is sent again changes nothing, and data without a
marker is never read.

Defined cases: null and empty texts count as documents of no tokens; null source or language form groups of their
own; repeated rows count each; of equal texts `firsts` takes the smallest doc_id, then source, language; an empty batch
commits no rows; other columns are ignored. A text is encoded whole, at about 40 bytes of memory a byte.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import tidy

KEYS = ("source", "lang", "version")
SUMS = ("docs", "tokens", "bytes")
# Fixed value: the pattern that cuts text before the byte-level merges of these vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_FILES = {"byte_bpe_50k/1": "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_multi_50k/1": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}


@functools.lru_cache(maxsize=8)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, files: dict[str, str] | None = None) -> DataFrame:
    """doc_id, source, lang, text_md5, bytes, and an array of (version, tokens) for every document."""
    files = dict(files or DEFAULT_FILES)
    narrow = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_md5"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "text",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {v: encoding(p) for v, p in files.items()}
        kind = pa.list_(pa.struct([("version", pa.string()), ("tokens", pa.int64())]))
        for batch in batches:
            counts = [[{"version": v, "tokens": len(e.encode_ordinary(t)) if t else 0} for v, e in known.items()] for t in (x.as_py() for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang", "text_md5", "bytes")), pa.array(counts, kind)], ["doc_id", "source", "lang", "text_md5", "bytes", "counts"])

    return narrow.mapInArrow(tidy(run), "doc_id long, source string, lang string, text_md5 string, bytes long, counts array<struct<version:string,tokens:long>>")


def signed(counted: DataFrame, sign: int) -> DataFrame:
    """Changes of +1 or -1 for every counted document and version."""
    c = counted.select("source", "lang", "bytes", F.explode("counts").alias("c"))
    return c.select("source", "lang", F.col("c.version").alias("version"), F.lit(sign).cast("long").alias("docs"), (F.col("c.tokens") * sign).alias("tokens"), (F.col("bytes") * sign).alias("bytes"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace the old counts of documents by new ones."""
    return signed(old, -1).unionByName(signed(new, 1))


def firsts(counted: DataFrame) -> DataFrame:
    """One row for each distinct text: that of the smallest doc_id. Partial minima meet before the shuffle."""
    row = F.struct(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("bytes"), F.col("counts"))
    first = counted.groupBy("text_md5").agg(F.min(row).alias("x"))
    return first.select("x.doc_id", "x.source", "x.lang", "text_md5", "x.bytes", "x.counts")


class Rollup:
    """Committed batches of summed changes below one folder of a shared file system.

    A marker is written in full under a temporary name and then renamed without overwriting, so it is whole or absent;
    a marker that cannot be read (left by a broken file system) counts as absent and gives way to the next commit.
    Batch ids are any text: files are named by their hash.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    @staticmethod
    def _name(batch_id: str) -> str:
        return "batch-" + hashlib.sha256(batch_id.encode()).hexdigest()

    def _read(self, path) -> dict | None:
        stream = self._fs.open(path)
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()
        return found if isinstance(found, dict) and {"data", "covers"} <= found.keys() else None

    def _markers(self) -> list[dict]:
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        paths = [status.getPath() for status in self._fs.listStatus(folder)]
        return [m for m in map(self._read, (p for p in paths if p.getName().startswith(("batch-", "fold-")))) if m]

    def _mark(self, name: str, content: dict) -> bool:
        """Make the marker appear at once; False if a whole one is there already."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        last, new = self._path(f"{self.root}/commits/{name}"), self._path(f"{self.root}/commits/writing-{uuid.uuid4().hex}")
        if self._fs.exists(last) and self._read(last) is None:
            self._fs.delete(last, False)
        stream = self._fs.create(new, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(new, last, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            self._fs.delete(new, False)
            if "AlreadyExists" in str(error):
                return False
            raise
        return True

    def committed(self, batch_id: str) -> bool:
        path = self._path(f"{self.root}/commits/{self._name(batch_id)}")
        return self._fs.exists(path) and self._read(path) is not None

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Sum the changes and commit them; False, and no effect, if that batch is committed already."""
        if self.committed(batch_id):
            return False
        data = f"deltas/{uuid.uuid4().hex}"
        changes.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).write.parquet(f"{self.root}/{data}")
        done = self._mark(self._name(batch_id), {"data": data, "covers": [batch_id]})
        if not done:
            self._fs.delete(self._path(f"{self.root}/{data}"), True)
        return done

    @staticmethod
    def _live(markers: list[dict]) -> list[dict]:
        """Markers whose data add up to all batches, each once: larger folds first, and none that shares a batch."""
        seen: set[str] = set()
        live = []
        for m in sorted(markers, key=lambda m: (-len(m["covers"]), m["data"])):
            if seen.isdisjoint(m["covers"]):
                live.append(m)
                seen.update(m["covers"])
        return live

    def _sum(self, live: list[dict]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], "source string, lang string, version string, docs long, tokens long, bytes long")
        deltas = self.spark.read.parquet(*[f"{self.root}/{m['data']}" for m in live])
        return deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens, bytes: the sums of all committed batches."""
        return self._sum(self._live(self._markers()))

    def compact(self) -> None:
        """Fold the batches committed by now into one; their ids stay committed. The markers are listed once, so a batch
        that is committed meanwhile is neither in the fold's data nor in what it covers."""
        live = self._live(self._markers())
        covers = sorted(b for m in live for b in m["covers"])
        if len(live) > 1:
            data = f"deltas/{uuid.uuid4().hex}"
            self._sum(live).write.parquet(f"{self.root}/{data}")
            self._mark(f"fold-{uuid.uuid4().hex}", {"data": data, "covers": covers})
