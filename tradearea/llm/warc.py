"""WARC archives written by tasks, an index of every record, and coalesced reads by byte range.

Writing comes with the index: per record the file, offset, length, URL and digest. Readers start from
index rows, sort them by file and offset, join neighbouring ranges into one read, and cut the records out of
what they have read. Records are gzip members of their own, so each range opens by itself.

Archives and index go to the folder all executors share. A task writes under a name of its own; the
index, itself a written table, names only files of tasks that succeeded, so a repeated task leaves at
worst a file that nobody reads.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradearea.llm.words import slices
from tradearea.sources.scratch import cut, shared_dir

REVISIT_FROM = 100
GAP, READ = 64 << 10, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = "file string, offset bigint, length bigint, url string, digest string, record_type string, {key} {kind}"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a URI or a path."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _record(kind: str, url: str | None, payload: bytes, digest: str, key: str, refers: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{quote(key)}>", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]')}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{quote(refers)}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower case names) and payload of a record; the digests in it are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[:int(headers["content-length"])]
    if first != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n" or headers["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"broken record {headers.get('warc-record-id')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    headers["payload-length"] = http.rpartition(b"Content-Length: ")[2].decode()
    if headers["warc-type"] == "response" and headers["warc-payload-digest"] != "sha256:" + hashlib.sha256(payload).hexdigest():
        raise ValueError(f"broken payload {headers.get('warc-record-id')}")
    return headers, payload


def with_revisits(pages: DataFrame, key: str, html: str, least: int) -> DataFrame:
    """pages with _digest and _refers: the smallest key with the same payload of at least `least` bytes, else null.

    Digests come more than once are found by one aggregate; only those meet the pages again, on the
    digest, where Spark splits the partitions of frequent ones.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    named = pages.withColumns({"_digest": F.sha2(payload.cast("binary"), 256), "_bytes": F.octet_length(payload)})
    firsts = named.filter(F.col("_bytes") >= least).groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_c"), F.min(key).alias("_refers")).filter("_c > 1").select("_digest", "_refers")
    joined = named.join(firsts, "_digest", "left")
    return joined.withColumn("_refers", F.when(~F.col("_refers").eqNullSafe(F.col(key)), F.col("_refers")))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
                   least: int = REVISIT_FROM) -> DataFrame:
    """Writes one record per row below `folder` and returns the index, itself a written table.

    Columns: file, offset, length, url, digest, record_type and the key. Of rows with equal payloads of at
    least `least` bytes the smallest key is the response, the others revisit it; rows that repeat the smallest
    key are responses too, and where no row has a key all are. A null page is an empty payload. Other
    columns are passed over; an empty table writes no file.
    """
    source = with_revisits(pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"), F.col(html).cast("string").alias("_html")),
                           "_key", "_html", least).select("_key", "_url", "_html", "_digest", F.col("_refers").cast("string").alias("_refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        name = f"{base}/part-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for batch in slices(batches, "_html"):
            system.create_dir(base, recursive=True)
            out = out or system.open_output_stream(name, compression=None)
            offsets, lengths, kinds = [], [], []
            for row_key, row_url, page, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
                kind = "response" if refers is None else "revisit"
                raw = zlib.compress(_record(kind, row_url, (page or "").encode("utf-8"), digest, str(row_key), refers), 1, 31)
                out.write(raw)
                offsets.append(at)
                lengths.append(len(raw))
                kinds.append(kind)
                at += len(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * batch.num_rows), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), batch.column("_url"),
                 batch.column("_digest"), pa.array(kinds), batch.column("_key")],
                names=["file", "offset", "length", "url", "digest", "record_type", "_key"])
        if out is not None:
            out.close()

    kind = source.schema["_key"].dataType.simpleString()
    index = source.mapInArrow(run, INDEX.format(key="_key", kind=kind))
    return cut(index, "warc-index").withColumnRenamed("_key", key)


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, int, int]]:
    """(first, past the last, start, end): sorted ranges (offset, length) joined into reads of at most `most` bytes or one range."""
    reads: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(ranges):
        if reads and offset <= reads[-1][3] + gap and offset + length - reads[-1][2] <= most:
            first, _, start, end = reads[-1]
            reads[-1] = (first, i + 1, start, max(end, offset + length))
        else:
            reads.append((i, i + 1, offset, offset + length))
    return reads


def read_records(index: DataFrame, folder: str, key: str = "page_id", gap: int = GAP, most: int = READ, with_payload: bool = True) -> DataFrame:
    """The selected records: the key, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to (as text).

    Rows of the index are dealt out by stretches of a file and sorted, so that a task reads neighbouring records
    at once. Any subset of the index may be given; repeated rows are read as often.
    """
    kind = index.schema[key].dataType.simpleString()
    source = index.select("file", "offset", "length", "url", F.col(key).alias("_key"), F.floor(F.col("offset") / most).alias("_stretch"))
    source = source.repartition("file", "_stretch").sortWithinPartitions("file", "offset").drop("_stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(folder)
        for batch in batches:
            files, offsets, lengths, urls, keys = (batch.column(i).to_pylist() for i in range(5))
            start = 0
            while start < len(files):
                stop = start
                while stop < len(files) and files[stop] == files[start]:
                    stop += 1
                with system.open_input_file(files[start]) as opened:
                    for first, last, begin, end in coalesced(list(zip(offsets[start:stop], lengths[start:stop])), gap, most):
                        raw = opened.read_at(end - begin, begin)
                        rows = []
                        for i in range(start + first, start + last):
                            headers, payload = parse(zlib.decompress(raw[offsets[i] - begin:offsets[i] - begin + lengths[i]], 31))
                            refers = headers.get("warc-refers-to")
                            revisit = headers["warc-type"] == "revisit"
                            rows.append((keys[i], urls[i], headers["warc-type"], payload if with_payload and not revisit else None,
                                         int(headers["payload-length"]), headers["warc-payload-digest"].removeprefix("sha256:"),
                                         refers.removeprefix("<urn:page:").removesuffix(">") if refers else None))
                        columns = list(zip(*rows))
                        kinds = (batch.schema.field("_key").type, pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=OUT)
                start = stop

    found = source.mapInArrow(run, f"_key {kind}, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to string")
    return found.withColumnRenamed("_key", key)


OUT = ["_key", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]


def new_folder(spark) -> str:
    """A folder for one set of archives, in the folder all executors share."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
