"""Deterministic sharded WARC writer and reader.

Records are dealt into key ranges of about equal size, each range is sorted and written by one task as files that roll at a
compressed size, and every record is a gzip member of its own with regenerated headers and digests. Ranges come from exact
byte counts over a fixed number of key steps (not from sampling), and nothing in a record depends on time, task or
partitioning, so the same pages give the same bytes. A task writes under a temporary name and then moves the file to its final
name, so a repeated task replaces a file by its equal; the manifest is written last, and a reader takes only files it names.

Equal payloads become one response, that with the largest key; the others are revisits without payload, which name the
response and carry size and digest of the whole payload.

Defined cases: null html is an empty payload; null ids and urls are written without that header and read back as null, and
ids sort first; of repeated rows with the largest id one is the response and the rest revisit it; an empty table gives a
manifest without files; other columns play no part.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from receptorium.llm.shared import fresh_path, prepared, tidy, written

FILE_BYTES = 32 << 20
RANGE_BYTES = 16 << 20
STEP_BITS = 13
MOST_TASKS = 50_000
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def _record_id(page_id: int | None, digest: str, nth: int) -> str:
    name = f"{page_id}/{digest}/{nth}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, nth: int) -> bytes:
    """One gzip member. ``payload`` None: a revisit. ``nth`` tells equal rows apart."""
    revisit = payload is None
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest, nth)),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to, digest, 0))]
        if refers_to is not None:
            head.append(("X-Refers-To-Page-ID", str(refers_to)))
    body = payload or b""
    head.append(("Content-Length", str(len(body))))
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


class _Roller:
    """Files of one key range, closed at a compressed size; each comes to its name by a move."""

    def __init__(self, folder: str, shard: int, most: int):
        (self.fs, self.folder), self.shard, self.most, self.number = _file_system(folder), shard, most, 0
        self.out = None

    def add(self, member: bytes, page_id: int | None) -> tuple | None:
        """Append; the finished file's manifest row if another one has to begin."""
        done = self.close() if self.out is not None and self.size + len(member) > self.most else None
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.records, self.hash, self.first = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha1(), page_id
        self.out.write(member)
        self.hash.update(member)
        self.size, self.records, self.last = self.size + len(member), self.records + 1, page_id
        return done

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        self.fs.move(self.temporary, f"{self.folder}/{self.name}")
        self.out, self.number = None, self.number + 1
        return self.name, self.records, self.size, self.hash.hexdigest(), self.first, self.last


_MANIFEST = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def _writer(folder: str, file_bytes: int, least_bytes: int):
    def write(batches):
        roller, shard, before, response, nth, rows = None, None, None, None, 0, []
        for batch in batches:
            columns = [batch.column(c) for c in ("_shard", "page_id", "url", "html", "_digest", "_size", "_response", "_page")]
            for own, page, url, html, sha, size, of_payload, is_page in zip(*(c.to_pylist() for c in columns), strict=True):
                if not is_page:  # comes before its page
                    response = of_payload
                    continue
                if own != shard:
                    rows.append(roller.close() if roller else None)
                    roller, shard, before = _Roller(folder, own, file_bytes), own, None
                key = (page, sha)
                nth, before = (nth + 1 if key == before else 0), key
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                whole = size < least_bytes or (page == response and nth == 0)
                payload = (html or "").encode() if whole else None
                if whole and digest_of(payload) != digest:
                    raise ValueError(f"payload of page {page} does not match its digest")
                rows.append(roller.add(record_bytes(page, url, payload, size, digest, None if whole else response, nth), page))
            done = [r for r in rows if r]
            rows = []
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(_MANIFEST.names, r, strict=True)) for r in done], schema=_MANIFEST)
        if roller and (last := roller.close()):
            yield pa.RecordBatch.from_pylist([dict(zip(_MANIFEST.names, last, strict=True))], schema=_MANIFEST)
    return write


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES) -> str:
    """Write a record per row of ``pages`` (page_id, url, html) into ``folder``, which driver and executors share (default: a
    new one in the shared folder), and return it. Payloads of at least ``least_bytes`` bytes that are equal are stored once.
    ``range_bytes`` of payload make a key range, however many ranges that gives. Ids may be any integers of 64 bits."""
    spark = pages.sparkSession
    prepared(spark)
    folder = folder or fresh_path(spark, "warc")
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)
    own = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("_digest", F.sha1(F.col("html").cast("binary"))).withColumn("_size", F.octet_length("html").cast("long"))
    thin = own.select("page_id", "_digest", "_size")
    low, high = thin.agg(F.min("page_id"), F.max("page_id")).first()
    shift = max(0, (high - low).bit_length() - STEP_BITS) if low is not None else 0
    before = max((low >> shift) - 1, -(1 << 63)) if low is not None else 0  # null ids come before all others
    of_key = F.coalesce(F.shiftright("page_id", shift), F.lit(before))
    sizes = dict(thin.groupBy(of_key.alias("k")).agg(F.sum("_size") + 512 * F.count(F.lit(1))).collect())  # at most 2^STEP_BITS + 2 rows
    shard_of, parts, shard, filled = {}, {}, 0, 0
    for k in sorted(sizes):  # neighbouring steps share a range; a step over its size becomes several by payload digest
        if filled and filled + sizes[k] > range_bytes:
            shard, filled = shard + 1, 0
        shard_of[k], parts[k] = shard, max(1, -(-sizes[k] // range_bytes))
        shard, filled = (shard + parts[k], 0) if parts[k] > 1 else (shard, filled + sizes[k])
    ranges = spark.createDataFrame([(int(k), s, int(parts[k])) for k, s in shard_of.items()] or [(0, 0, 1)], "_k long, _first int, _parts int")
    best = thin.groupBy("_digest").agg(F.max("page_id").alias("_response"))
    # Payloads are shuffled once, to their range; what their response is travels beside them, sorted in before each page.
    said = thin.join(best, "_digest").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "_digest", "_size",
                                             "_response", F.lit(False).alias("_page"))
    both = said.unionByName(own.withColumns({"_response": F.lit(None).cast("long"), "_page": F.lit(True)}))
    dealt = (both.withColumn("_k", of_key).join(F.broadcast(ranges), "_k")
             .withColumn("_shard", F.col("_first") + F.pmod(F.xxhash64("_digest"), F.col("_parts")).cast("int")))
    # a task writes its ranges one after the other, so there may be more ranges than a shuffle bears partitions
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(shard + 1, MOST_TASKS))
    ordered = (dealt.select("_shard", "page_id", "url", "html", "_digest", "_size", "_response", "_page").repartition(tasks, "_shard")
               .sortWithinPartitions("_shard", "page_id", "_digest", "_page", "url"))
    files = ordered.mapInArrow(tidy(_writer(folder, file_bytes, least_bytes)), "file string, records long, bytes long, sha1 string, first_id long, last_id long")
    manifest = written(files, "manifest")
    rows = manifest.orderBy("file").toLocalIterator()
    temporary, final = f"{path}/.manifest.{uuid.uuid4().hex}.tmp", f"{path}/manifest.tsv"
    with fs.open_output_stream(temporary, compression=None) as out:
        for r in rows:
            out.write(("\t".join("" if v is None else str(v) for v in r) + "\n").encode())
    fs.move(temporary, final)
    return folder


def _members(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, read in chunks: (headers, block)."""
    inflate, raw, held = zlib.decompressobj(31), io.BytesIO(), b""
    while True:
        chunk = held or stream.read(1 << 16)
        if not chunk:
            return
        raw.write(inflate.decompress(chunk))
        held = b""
        if inflate.eof:
            head, _, rest = raw.getvalue().partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, rest[:int(fields["Content-Length"])]
            held, inflate, raw = inflate.unused_data, zlib.decompressobj(31), io.BytesIO()


def _reader(folder: str):
    def read(batches):
        fs, path = _file_system(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64())])
        names = schema.names
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for head, block in _members(stream):
                        digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                        if head["WARC-Type"] == "response":
                            size, found = len(block), digest_of(block)
                            if found != digest:
                                raise ValueError(f"{name}: a payload does not match its digest")
                        number = lambda k: int(head[k]) if k in head else None  # noqa: E731, B023
                        url = head.get("WARC-Target-URI")
                        url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                        rows.append((number("X-Page-ID"), url, size, digest, head["WARC-Type"], number("X-Refers-To-Page-ID")))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)
    return read


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all files that the manifest in ``folder`` names: page_id, url, payload_bytes, payload_digest, record_type
    and refers_to. Payloads are checked against their digests."""
    prepared(spark)
    listed = spark.read.schema("file string, records long, bytes long, sha1 string, first_id long, last_id long").csv(f"{folder}/manifest.tsv", sep="\t")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return listed.repartition(tasks, "file").mapInArrow(tidy(_reader(folder)), _RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages and read the archives back."""
    return read_archives(pages.sparkSession, write_archives(pages, least_bytes=least_bytes)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
