"""WARC archives: a deterministic sharded writer and its reader.

Records are sorted by page id and dealt to shards by id range. A shard ends where the
bytes of all pages up to an id pass a multiple of ``shard_bytes``, so borders depend on
the rows alone and shards are even however ids are spread; what goes out to the tasks is
eight bytes a shard. A shard's records go to files that roll once
``roll_bytes`` of compressed output are reached; each record is a gzip member of its
own. Headers and digests are made anew from the payload, and dates come from a
parameter, so equal rows give equal files.

Commit: a task writes each file under a temporary name with its attempt's own
suffix and reports it in a manifest. Only when all tasks have ended does a second
job rename the reported files, and the final manifest is written last: files that
it does not name are not part of the archive. A lost task leaves temporary files
only, which are removed at the end; renaming again after a failure does no harm.

Of records with equal payloads of at least ``least`` bytes the one with the smallest
page id is a response, the others are revisits without payload that name it.
Payloads are equal if their lengths and SHA-1 digests are.

Cases: null html is an empty payload; null url is an empty target; a null page id
counts as the smallest; rows that repeat a page id are all written, the first is the
response; no rows give an archive without files; extra columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.llm.common import Scratch, partitions
from helixmill.plans.storage import shared_folder

SHARD_BYTES, ROLL_BYTES = 32 << 20, 16 << 20
LEVEL = 2  # of gzip
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "shard long, roll long, file string, temporary string, records long, bytes long, sha256 string"


def file_system(uri: str):
    """(file system, path) that Python on any executor can use for a shared folder."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


def b32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id, n: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{n}')}>"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member without time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id, url: str, payload: bytes, digest: str, refers_to, n: int = 0, date: str = DATE) -> bytes:
    """A response record, or a revisit record if it refers to a page."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, n)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{b32_sha1(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, HTTP head, payload) of each record of uncompressed data."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        n = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        if data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end as it should")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield head, http, payload
        at = end + 8 + n


def records_of(stream) -> Iterator[bytes]:
    """Records of a gzip file, member by member, from a file object."""
    rest = b""
    while True:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not rest and not (rest := stream.read(1 << 20)):
                if out:
                    raise ValueError("the last record is cut off")
                return
            out.append(z.decompress(rest))
            rest = z.unused_data if z.eof else b""
        yield b"".join(out)


def shard_borders(sized: DataFrame, shard_bytes: int) -> np.ndarray:
    """Smallest page id of each shard but the first, from (page_id, bytes): a shard ends where
    the bytes of all pages up to an id pass a multiple of ``shard_bytes``.

    The ids are dealt by range, so that running sums need one total per range on the driver."""
    scratch = Scratch(sized.sparkSession, "warc-sizes")
    ranges = max(1, partitions(sized.sparkSession))
    per = sized.where("page_id IS NOT NULL").groupBy("page_id").agg(F.sum(F.col("bytes") + 600).alias("bytes"))
    per = scratch.save(per.repartitionByRange(ranges, "page_id").select("page_id", "bytes", F.spark_partition_id().alias("part")), "sizes")
    totals = sorted((r["first"], r["part"], r["bytes"]) for r in per.groupBy("part").agg(F.min("page_id").alias("first"), F.sum("bytes").alias("bytes")).collect())
    if not totals:
        return np.zeros(0, np.int64)
    before, base = 0, []
    for _, part, size in totals:
        base.append((part, before))
        before += size
    base = sized.sparkSession.createDataFrame(base, "part int, base long")
    inside = Window.partitionBy("part").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = per.withColumn("inside", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(F.broadcast(base), "part")
    first = placed.groupBy(F.floor((F.col("base") + F.col("inside")) / shard_bytes).alias("shard")).agg(F.min("page_id").alias("first"))
    found = np.sort(first.toPandas()["first"].to_numpy(np.int64))[1:]
    scratch.drop(per)
    return found


def _shards(sized: DataFrame, shard_bytes: int) -> tuple[F.Column, int]:
    """Shard of each page id, and the number of shards."""
    borders = shard_borders(sized, shard_bytes)
    if not len(borders):
        return F.lit(0), 1

    @F.pandas_udf("int")
    def shard(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, page_id.to_numpy(), "right").astype(np.int32))

    return F.when(F.col("page_id").isNull(), 0).otherwise(shard(F.coalesce("page_id", F.lit(0)))), len(borders) + 1


def write_archive(pages: DataFrame, base: str, least: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write page_id, url, html as WARC files under ``base``; returns the manifest."""
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    # html leaves the plan before the shuffle: what is grouped are digests
    keys = pages.select("page_id", F.octet_length("html").cast("long").alias("bytes"), F.sha1(F.encode("html", "utf-8")).alias("digest"))
    shard, n = _shards(keys, shard_bytes)
    first = keys.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min("page_id").alias("to"), F.count("*").alias("n")).where("n > 1").select("digest", "bytes", "to", F.lit(True).alias("many"))
    size, digest = F.octet_length("html").cast("long"), F.sha1(F.encode("html", "utf-8"))
    dealt = pages.select("*", size.alias("bytes"), digest.alias("digest"), shard.alias("shard"))
    refs = keys.join(first, ["digest", "bytes"]).select("page_id", "digest", "to", shard.alias("shard")).distinct()
    # references meet the pages in the writer: both sides are sorted by shard and page
    rows = dealt.select("shard", "page_id", F.lit(1).alias("side"), "digest", F.lit(None).cast("long").alias("to"), "url", "html").union(refs.select("shard", "page_id", F.lit(0), "digest", "to", F.lit(None), F.lit(None)))
    rows = rows.repartition(n, "shard").sortWithinPartitions("shard", "page_id", "side", "digest", "url")
    tmp = f"{base}/_temporary"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(tmp)
        system.create_dir(root, recursive=True)
        attempt = uuid.uuid4().hex[:12]
        out, manifest, at = None, [], None
        refs: dict[str, int | None] = {}
        page, nth, seen = object(), 0, set()

        def close():
            nonlocal out
            if out is not None:
                out.close()
                manifest[-1][6] = sha.hexdigest()
                out = None

        def opened(shard: int, roll: int):
            nonlocal out, sha
            close()
            name = f"part-{shard:06d}-{roll:05d}.warc.gz"
            temporary = f"{name}.{attempt}"
            out, sha = system.open_output_stream(posixpath.join(root, temporary), compression=None), hashlib.sha256()
            manifest.append([shard, roll, name, temporary, 0, 0, None])

        def put(data: bytes):
            out.write(data)
            sha.update(data)
            manifest[-1][5] += len(data)

        sha = None
        for b in batches:
            for shard, page_id, side, hexed, to, url, html in zip(*(c.to_pylist() for c in b.columns)):
                if page_id != page:
                    page, nth, refs, seen = page_id, 0, {}, set()
                if side == 0:
                    refs[hexed] = to
                    continue
                if out is None or manifest[-1][0] != shard:
                    opened(shard, 0)
                    info = f"software: helixmill\r\nformat: WARC File Format 1.1\r\nisPartOf: {manifest[-1][2]}\r\n".encode()
                    put(member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: " + _urn(manifest[-1][2]).encode() + f"\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
                elif manifest[-1][5] >= roll_bytes:
                    opened(shard, manifest[-1][1] + 1)
                refers = None
                if hexed in refs and (refs[hexed] != page_id or hexed in seen):
                    refers = refs[hexed]
                seen.add(hexed)
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                put(member(record(page_id, url, html.encode(), digest, refers, nth, date)))
                manifest[-1][4] += 1
                nth += 1
        close()
        cols = list(zip(*manifest)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()])], [x.split()[0] for x in MANIFEST.split(", ")])

    rows.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{base}/_reported")
    reported = spark.read.schema(MANIFEST).parquet(f"{base}/_reported")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = file_system(base)
        for b in batches:
            for name, temporary in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                source, target = posixpath.join(root, "_temporary", temporary), posixpath.join(root, name)
                if system.get_file_info(source).type == fs.FileType.File:
                    system.move(source, target)
                elif system.get_file_info(target).type != fs.FileType.File:
                    raise FileNotFoundError(source)
            yield b

    reported.mapInArrow(commit, MANIFEST).write.mode("overwrite").parquet(f"{base}/_manifest")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for gone in (tmp, f"{base}/_reported"):
        p = spark._jvm.org.apache.hadoop.fs.Path(gone)
        p.getFileSystem(conf).delete(p, True)
    return spark.read.schema(MANIFEST).parquet(f"{base}/_manifest")


READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, html string"


def read_archive(spark: SparkSession, base: str, html: bool = True) -> DataFrame:
    """The records under ``base``, one row each; digests and lengths are checked.
    A revisit has no html."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{base}/_manifest").select("file", "records")
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, manifest.count()))
    fields = READ if html else READ.rsplit(", ", 1)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(base)
        for b in batches:
            for name, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, size, count = [], 0, 0
                with system.open_input_stream(posixpath.join(root, name), compression=None) as f:
                    for data in records_of(f):
                        for head, http, payload in parse(data):
                            if head["WARC-Type"] == "warcinfo":
                                continue
                            count += 1
                            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                            length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                            revisit = head["WARC-Type"] == "revisit"
                            if not revisit and (len(payload) != length or b32_sha1(payload) != digest):
                                raise ValueError(f"{name}: payload of {head['WARC-Record-ID']} is not what its headers say")
                            ids = [int(head[k]) if head.get(k) else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
                            rows.append((ids[0], head["WARC-Target-URI"], head["WARC-Type"], digest, length, ids[1], None if revisit else payload.decode())[: None if html else 6])
                            size += len(payload)
                        if html and size > 4 << 20 or len(rows) >= 10_000:
                            yield _rows(rows, fields)
                            rows, size = [], 0
                if count != records:
                    raise ValueError(f"{name} holds {count} records, not {records}")
                yield _rows(rows, fields)

    return manifest.repartition(n, "file").mapInArrow(run, fields)


def _rows(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = [(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in fields.split(", ")]
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(cols, kinds)], [k for k, _ in kinds])


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex[:12]}"


def round_trip(pages: DataFrame, base: str | None = None) -> DataFrame:
    """Write the pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    base = base or archive_folder(spark)
    write_archive(pages, base)
    return read_archive(spark, base, html=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
