"""Line dedup: lines that many documents share are dropped by probing a sharded minimal perfect hash.

1. Every document gives its distinct line keys as 64-bit hashes, stored as (h, doc_id, bucket). A hash counts the
   distinct ids that hold it.
2. All distinct hashes are dealt to shards by their upper bits. Each shard becomes one minimal perfect hash (levels of
   bit arrays; the rank of a hash's bit is its slot) with two compact arrays: a 32-bit fingerprint (other bits of the
   mixed hash) and a 32-bit count for each slot.
3. Documents probe the arrays; no line is joined. Documents are dealt to buckets of bounded size by hash; a bucket's
   distinct hashes go to the shards, so a line that a third of all documents hold costs a row for each bucket. Every
   hash that is asked for was indexed, so its slot is its own and the count array decides. The dropped hashes go back
   to their buckets, ahead of the documents, which stream past them.

Nothing is broadcast or collected but totals, and there is one way at every size.

Keys: all of ``[\\x20\\x09-\\x0D]`` stripped at both ends, A-Z lower-cased. Keys shorter than ``min_chars`` code
points are never dropped. Defined cases: null text is one empty line, kept; a line that a document repeats counts once
for it; rows with equal ids are one document in the counts, and each of them is cut; rows without id are cut, too, but
count for nothing; a document whose lines all go keeps the empty text; an empty table gives no rows. Two lines are
taken for equal if their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyframe.llm.storage import materialize, scratch, slices

STRIP = b" \t\n\x0b\x0c\r"
SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
GAMMA = 2.0
#: Hashes and probes of a shard, documents and bytes of a bucket, on average.
SHARD_KEYS, SHARD_PROBES = 1 << 16, 1 << 21
BUCKET_ROWS, BUCKET_BYTES = 2048, 8 << 20
Dropped = Callable[[np.ndarray], np.ndarray]


def line_key(line: bytes) -> bytes:
    return line.strip(STRIP).translate(LOWER)


def key_hash(key: bytes) -> int:
    """The 64-bit hash that is counted, as a signed integer."""
    h = xxhash.xxh64_intdigest(key, SEED)
    return h - (1 << 64) if h >> 63 else h


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer over unsigned hashes; another function for each salt."""
    with np.errstate(over="ignore"):
        x = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes with a fingerprint and a count for each slot."""

    def __init__(self, levels: list[np.ndarray], fingerprints: np.ndarray, counts: np.ndarray) -> None:
        self.levels, self.fingerprints, self.counts = levels, fingerprints, counts
        self.before = np.concatenate([[0], np.cumsum([int(np.bitwise_count(w).sum()) for w in levels])]).astype(np.int64)
        self.ranks = [np.concatenate([[0], np.cumsum(np.bitwise_count(w))]).astype(np.int64) for w in levels]

    @classmethod
    def build(cls, hashes: np.ndarray, counts: np.ndarray) -> PerfectHash:
        """hashes: distinct, unsigned. Each level keeps those that no other one meets; the rest go on."""
        levels, left = [], hashes
        while len(left):
            size = max(64, int(GAMMA * len(left)) // 64 * 64 + 64)
            at = mix(left, len(levels)) % np.uint64(size)
            hits = np.bincount(at.astype(np.int64), minlength=size)
            words = np.packbits(hits == 1, bitorder="little").view(np.uint64)
            levels.append(words)
            left = left[hits[at.astype(np.int64)] > 1]
        made = cls(levels, np.zeros(len(hashes), np.uint32), np.zeros(len(hashes), np.uint32))
        slots = made.slots(hashes)
        made.fingerprints[slots] = fingerprint(hashes)
        made.counts[slots] = np.minimum(counts, 0xFFFFFFFF)
        return made

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 where it meets no bit. A hash that isn't indexed may get any slot."""
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        for i, words in enumerate(self.levels):
            at = (mix(hashes[todo], i) % np.uint64(len(words) * 64)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            on = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[on]] = (self.before[i] + self.ranks[i][at >> 6] + below)[on]
            todo = todo[~on]
            if not len(todo):
                break
        return out

    def count_of(self, hashes: np.ndarray) -> np.ndarray:
        """Documents of each hash; 0 for those that aren't indexed."""
        slots = self.slots(hashes)
        found = slots >= 0
        found[found] = self.fingerprints[slots[found]] == fingerprint(hashes[found])
        return np.where(found, self.counts[np.maximum(slots, 0)] if len(self.counts) else 0, 0)

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels), len(self.counts)], np.int64)
        return b"".join([sizes.tobytes(), *[w.tobytes() for w in self.levels], self.fingerprints.tobytes(), self.counts.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        *sizes, keys = np.frombuffer(data, np.int64, n + 1, 8).tolist()
        pos, levels = 8 * (n + 2), []
        for size in sizes:
            levels.append(np.frombuffer(data, np.uint64, size, pos))
            pos += 8 * size
        return cls(levels, np.frombuffer(data, np.uint32, keys, pos), np.frombuffer(data, np.uint32, keys, pos + 4 * keys))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes, 0x7FFF) >> np.uint64(32)).astype(np.uint32)


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or sum((b & 0xC0) != 0x80 for b in key) >= min_chars)


def line_hashes(rows: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h, doc_id, bucket) of (doc_id, raw, bucket): the distinct line keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got: list[int] = []
            sizes = []
            for raw in batch.column(1).to_pylist():
                keys = {line_key(x) for x in (raw or b"").split(b"\n")}
                own = [key_hash(k) for k in keys if long_enough(k, min_chars)]
                got += own
                sizes.append(len(own))
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), batch.column(0).take(owner), batch.column(2).take(owner)], ["h", "doc_id", "bucket"])

    return rows.select("doc_id", "raw", "bucket").mapInArrow(run, "h long, doc_id long, bucket int")


def count_lines(hashes: DataFrame) -> DataFrame:
    """(h, docs): how many distinct ids hold each line key; 0 where only rows without id do."""
    pairs = hashes.select("h", "doc_id").distinct()
    return pairs.groupBy("h").agg(F.count("doc_id").alias("docs"))


def build_shards(counts: DataFrame, n_shards: int) -> DataFrame:
    """(shard, index): one serialized PerfectHash for each shard of (h, docs)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy().astype(np.int64).view(np.uint64)
        index = PerfectHash.build(h, table.column("docs").to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "index": pa.array([index.to_bytes()], pa.binary())})

    sharded = counts.select("h", "docs", F.pmod(F.shiftrightunsigned("h", 40), F.lit(n_shards)).cast("int").alias("shard"))
    return sharded.groupBy("shard").applyInArrow(run, "shard int, index binary")


def cut_lines(raws: list[bytes | None], dropped_of: Dropped, min_chars: int) -> tuple[list[int], list[int], list[bytes]]:
    """Lines, dropped lines and what is kept of each text. dropped_of: hashes of all lines -> mask."""
    lines = [(r or b"").split(b"\n") for r in raws]
    keys = [[line_key(x) for x in ls] for ls in lines]
    eligible = np.array([long_enough(k, min_chars) for ks in keys for k in ks], bool)
    flat = np.array([key_hash(k) for ks in keys for k in ks], np.int64)
    gone = dropped_of(flat) & eligible
    dropped, kept, at = [], [], 0
    for ls in lines:
        mask = gone[at : at + len(ls)]
        at += len(ls)
        dropped.append(int(mask.sum()))
        kept.append(b"\n".join([x for x, g in zip(ls, mask, strict=True) if not g]))
    return [len(x) for x in lines], dropped, kept


def probe_shards(asked: DataFrame, shards: DataFrame, n_shards: int, min_docs: int) -> DataFrame:
    """(bucket, h) of the asked (bucket, h) whose count reaches ``min_docs``."""

    def run(_: tuple, rows: pa.Table, index: pa.Table) -> pa.Table:
        h = rows.column("h").to_numpy()
        if not len(h):
            return pa.table({"bucket": pa.array([], pa.int32()), "h": pa.array([], pa.int64())})
        hit = PerfectHash.from_bytes(index.column("index")[0].as_py()).count_of(h.view(np.uint64)) >= min_docs
        return pa.table({"bucket": rows.column("bucket").filter(pa.array(hit)), "h": pa.array(h[hit])})

    dealt = asked.select("bucket", "h", F.pmod(F.shiftrightunsigned("h", 40), F.lit(n_shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(run, "bucket int, h long")


def cut_rows(rows: DataFrame, text_col: str, make: Callable[[pa.RecordBatch, tuple], pa.RecordBatch], schema: str | StructType, bucket, hits: DataFrame, min_chars: int) -> DataFrame:
    """Map batches of ``rows`` with ``make(batch, cut_lines(...))``. A bucket's dropped hashes stand before its rows, which stream."""
    names = rows.columns
    own = [f"_{i}" for i in range(len(names))]
    text_at = names.index(text_col)
    lists = hits.groupBy("bucket").agg(F.collect_list("h").alias("gone")).select("bucket", F.lit(0).alias("turn"), "gone")
    dealt = rows.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)], bucket.alias("bucket"), F.lit(1).alias("turn"))
    both = dealt.unionByName(lists, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gone = None, np.zeros(0, np.int64)
        for batch in slices(batches):
            bucket, turn = batch.column(len(own)).to_numpy(), batch.column(len(own) + 1).to_numpy()
            starts = np.flatnonzero((np.diff(bucket, prepend=bucket[:1]) != 0) | (turn == 0) | (np.diff(turn, prepend=turn[:1]) != 0))
            for first, after in zip([0, *starts.tolist()], [*starts.tolist(), len(bucket)], strict=True):
                if first == after:
                    continue
                if turn[first] == 0:
                    at, gone = bucket[first], np.sort(batch.column(len(own) + 2)[first].values.to_numpy())
                    continue
                if at != bucket[first]:
                    at, gone = bucket[first], np.zeros(0, np.int64)
                part = batch.slice(first, after - first)
                part = pa.RecordBatch.from_arrays(part.columns[: len(own)], names)

                def dropped(flat: np.ndarray, gone: np.ndarray = gone) -> np.ndarray:
                    if not len(gone):
                        return np.zeros(len(flat), bool)
                    return gone[np.minimum(np.searchsorted(gone, flat), len(gone) - 1)] == flat

                yield make(part, cut_lines(part.column(text_at).cast(pa.binary()).to_pylist(), dropped, min_chars))

    return both.select(*own, "bucket", "turn", "gone").mapInArrow(run, schema)


def _dedup(rows: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int, make: Callable[[pa.RecordBatch, tuple], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    doc_id, raw = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("binary")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(raw)), F.lit(0))).first()
    n_buckets = 1 + max(n // BUCKET_ROWS, size // BUCKET_BYTES)
    bucket = F.pmod(F.xxhash64(doc_id, raw), F.lit(n_buckets)).cast("int")
    with scratch(rows.sparkSession):
        hashes = materialize(line_hashes(rows.select(doc_id.alias("doc_id"), raw.alias("raw"), bucket.alias("bucket")), min_chars), "line-hashes")
        counts = materialize(count_lines(hashes), "line-counts")
        asked = materialize(hashes.select("bucket", "h").distinct(), "line-probes")
        n_shards = 1 + max(counts.count() // SHARD_KEYS, asked.count() // SHARD_PROBES)
        shards = materialize(build_shards(counts, n_shards), "line-index")
        hits = materialize(probe_shards(asked, shards, n_shards, min_docs), "line-hits", keep=True)
    return cut_rows(rows, text_col, make, schema, bucket, hits, min_chars)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, digest: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and ``kept``: the text without the lines that at least ``min_docs`` documents share.

    ``digest`` returns the kept text's SHA-256 instead of the text.
    """

    def make(batch: pa.RecordBatch, cut: tuple) -> pa.RecordBatch:
        lines, dropped, kept = cut
        last = pa.array([hashlib.sha256(k).hexdigest() for k in kept] if digest else [k.decode() for k in kept], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), last], ["doc_id", "n_lines", "n_dropped", "kept"])

    slim = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
    return _dedup(slim, id_col, text_col, min_docs, min_chars, make, "doc_id long, n_lines long, n_dropped long, kept string")


def replace_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with all its rows and columns, the shared lines gone from the text; a null text stays null."""
    at = docs.columns.index(text_col)

    def make(batch: pa.RecordBatch, cut: tuple) -> pa.RecordBatch:
        kept = [None if not t.is_valid else k.decode() for t, k in zip(batch.column(at), cut[2], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(kept, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return _dedup(docs, id_col, text_col, min_docs, min_chars, make, docs.schema)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines that at least 10 documents share go from every document: one row each with the kept text's digest."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return out.withColumnRenamed("kept", "kept_sha256")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.doc_id, k.i, k.line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
