"""WARC archives, index first.

Writing: every page becomes one gzip member in an archive file of its task, in the shared folder; the task
returns an index row (file, offset, length, URL, payload digest, record type) for each record, and the index is
stored before anything is read. A task that runs again writes a file of another name; only the files that the
stored index names count, so a lost executor costs a retry and nothing else.

Reading: the index alone says what to read. Selected records are grouped by file and sorted by offset; ranges
that lie close together are coalesced into one read of bounded size, and the records are parsed out of it.

Equal payloads: the page with the largest id is the response, the others are revisits that refer to it and carry
no payload (their HTTP header keeps the length). Payloads shorter than ``min_payload`` are always responses.

Defined cases: null html is the empty payload; a null URL is written as an empty target; pages with equal ids are
written as often as they occur; a page without id is a response; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.storage import fresh_path, materialize, scratch

SALTS = 16
#: Digests with their page ids (28 bytes each) that go to every task.
BROADCAST_DIGESTS = 500_000
#: The profile of a revisit record, and the date that all records carry (archives are then reproducible).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MAX_READ = 8 << 20
MAX_GAP = 64 << 10
MEMBER_LEVEL = 3


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(url: str) -> str:
    """A header value can't hold line ends."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(fields: dict[str, str], name: str) -> int | None:
    number = fields.get(name, "<urn:page:none>").removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def make_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit keeps the HTTP header and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(MEMBER_LEVEL, wbits=31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse_record(member: bytes) -> dict:
    """Fields of one gzip member; checks lengths and, of a response, the payload's digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("a record's payload is not what its header says")
    return {"page_id": page_of(fields, "WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page_of(fields, "WARC-Refers-To")}


def link_equal_payloads(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """(page_id, url, html, refers_to): the largest page id with the same payload, null for that page itself.

    Groups are found on digests with partial maxima before the shuffle, and only digests of groups with two ids or more
    go on: to every task while there are at most ``broadcast_digests``; else they are spread over SALTS copies, so that
    a payload that a third of all pages hold does not meet in one task, and the pages are shuffled.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("html"))
    keyed = slim.withColumn("digest", F.when(F.length("html") >= min_payload, F.unhex(F.sha1("html"))))
    groups = keyed.where("digest IS NOT NULL AND page_id IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first")).where("first < last").select("digest", "last")
    groups = materialize(groups, "digests")
    if groups.count() <= broadcast_digests:
        joined = keyed.join(F.broadcast(groups), "digest", "left")
    else:
        copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(copies, ["digest", "salt"], "left")
    return joined.select("page_id", "url", "html", F.when(F.col("last") != F.col("page_id"), F.col("last")).alias("refers_to"))


def write_archives(linked: DataFrame, label: str = "warc") -> DataFrame:
    """Write (page_id, url, html, refers_to) as WARC files in the shared folder; return the stored index.

    Index: file, offset, length, url, payload_digest, record_type, page_id.
    """
    spark = linked.sparkSession
    folder = fresh_path(spark, label)
    names = ["file", "offset", "length", "url", "payload_digest", "record_type", "page_id"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        path, sink, offset = "", None, 0
        try:
            for batch in batches:
                rows = []
                if sink is None and batch.num_rows:
                    store.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    sink = store.open_output_stream(path, compression=None)  # members are compressed already
                for i in range(batch.num_rows):
                    page_id, url, html, refers_to = (c[i].as_py() for c in batch.columns)
                    digest = payload_digest(html)
                    member = make_record(page_id, url, html, digest, refers_to)
                    sink.write(member)
                    rows.append((path, offset, len(member), url, digest, "response" if refers_to is None else "revisit", page_id))
                    offset += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        finally:
            if sink is not None:
                sink.close()

    index = linked.select("page_id", "url", "html", "refers_to").mapInArrow(run, "file string, offset long, length long, url string, payload_digest string, record_type string, page_id long")
    return materialize(index.withColumn("folder", F.lit(folder)), f"{label}-index", keep=True)


def coalesce_ranges(spans: list[tuple[int, int]], max_gap: int = MAX_GAP, max_read: int = MAX_READ) -> list[tuple[int, int]]:
    """(first, after last) places of sorted (offset, length) spans that are read at once; a longer record is a read of its own."""
    out: list[tuple[int, int]] = []
    first = 0
    for i in range(1, len(spans) + 1):
        if i == len(spans) or spans[i][0] - sum(spans[i - 1]) > max_gap or sum(spans[i]) - spans[first][0] > max_read:
            out.append((first, i))
            first = i
    return out


def read_records(index: DataFrame, payloads: bool = True, task_bytes: int = 32 << 20) -> DataFrame:
    """Parse the records of the selected index rows: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    A task gets index rows for about ``task_bytes`` of archives, sorted by file and offset (range partitioning keeps
    neighbours together; their number follows what they point at, not the size of the index). With
    ``payloads=False`` the payload is read and checked but not returned.
    """
    folder_of = index.select("folder", "file", "offset", "length")
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, path, store = None, "", None
        for batch in batches:
            folder, file, offset, length = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(file):
                stop = at
                while stop < len(file) and file[stop] == file[at]:
                    stop += 1
                if path != file[at]:
                    if source:
                        source.close()
                    store = pafs.FileSystem.from_uri(folder[at])[0]
                    path, source = file[at], store.open_input_file(file[at])
                spans = list(zip(offset[at:stop], length[at:stop], strict=True))
                for first, after in coalesce_ranges(spans):
                    begin = spans[first][0]
                    data = source.read_at(sum(spans[after - 1]) - begin, begin)
                    rows = [parse_record(data[o - begin : o - begin + n]) for o, n in spans[first:after]]
                    if not payloads:
                        for r in rows:
                            r["payload"] = None
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names)
                at = stop
        if source:
            source.close()

    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n_tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    ordered = folder_of.repartitionByRange(n_tasks, F.col("file"), F.col("offset")).sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, schema)


def op10_warc_index(spark, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back through the index: one row each."""
    with scratch(spark):
        index = write_archives(link_equal_payloads(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) || '0' AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, CAST((5 * i) // 4 + 1 AS BIGINT), 2))::INT >> CAST(3 - (5 * i) % 4 AS INT)) & 31), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d
"""
