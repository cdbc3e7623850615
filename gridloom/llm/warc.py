"""WARC archives: writing them, bringing monolithic gzip files into record members, reading by offset.

Some crawlers compress a whole archive as one gzip stream, which cannot be entered in the middle. ``normalise`` inflates
such a file once, front to back, writes every record as a gzip member of its own, and leaves an index of the members'
offsets beside the archive. ``read_records`` goes by that index and inflates single members.

Files are written under the shared scratch folder through ``pyarrow.fs``, by every scheme that it knows. A file counts
only if the successful attempt of its task named it, so repeated or lost tasks leave no double records.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.words import row_slices
from gridloom.storage import broadcast_if_small, scratch_path, store

ARCHIVE_BYTES = 256 << 20  # of payload; a task starts another archive beyond
DEDUP_BYTES = 100
_READ = 1 << 18
_DATE = "2000-01-01T00:00:00Z"  # the tables carry no crawl time
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def mark_revisits(pages: DataFrame, key: str, payload: str, least: int = DEDUP_BYTES) -> DataFrame:
    """``pages`` with ``payload_digest``, ``record_type`` and ``refers_to``.

    Of rows with equal payloads of at least ``least`` bytes, the smallest key is the response. Rows that share this
    key are responses all; where every key of a group is NULL, all are responses. NULL payloads are empty. Only digests
    that occur twice move, one row each, so a payload that a third of the rows hold is combined before it moves.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    sized = pages.withColumn("_size", F.octet_length(body)).withColumn("payload_digest", F.sha2(body, 256))
    groups = (
        sized.filter(F.col("_size") >= least)
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.min(key).alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
    )
    repeated = store(groups.select("_digest", "_first"), "repeated")
    joined = sized.join(broadcast_if_small(repeated), F.col("payload_digest") == F.col("_digest"), "left")
    revisit = F.col("_first").isNotNull() & ~F.col(key).eqNullSafe(F.col("_first"))
    return (
        joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("_first")))
        .drop("_size", "_digest", "_first")
    )


def record(key: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP header alone, and names the length of the payload it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + body if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if key is None else key}>"]
    if url:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", url))
    lines += [f"WARC-Date: {_DATE}", "Content-Type: application/http;msgtype=response"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(body)}"]
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:] if x)}


def split_records(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """Records of an inflated stream, one at a time; ``read`` gives up to so many bytes, none at the end."""
    rest = bytearray()
    while True:
        while (cut := rest.find(b"\r\n\r\n")) < 0:
            more = read(_READ)
            if not more:
                if rest.strip():
                    raise ValueError("the archive ends within a record")
                return
            rest += more
        size = cut + 4 + int(parse_head(bytes(rest[:cut]))["content-length"]) + 4
        while len(rest) < size:
            more = read(max(_READ, size - len(rest)))
            if not more:
                raise ValueError("the archive ends within a record")
            rest += more
        yield bytes(rest[:size])
        del rest[:size]


def inflate(stream) -> Callable[[int], bytes]:
    """A reader of the inflated bytes of a gzip stream, of one member or many."""
    state = {"gzip": zlib.decompressobj(31), "tail": b""}

    def read(n: int) -> bytes:
        while True:
            data = state["tail"] or stream.read(_READ)
            if not data:
                if not state["gzip"].eof and state["gzip"].unused_data == b"" and state.get("begun"):
                    raise ValueError("the gzip stream is cut short")
                return b""
            if state["gzip"].eof:
                state["gzip"] = zlib.decompressobj(31)
            state["begun"] = True
            out = state["gzip"].decompress(data, n)
            state["tail"] = state["gzip"].unused_data if state["gzip"].eof else state["gzip"].unconsumed_tail
            if state["gzip"].eof and not state["tail"]:
                state["begun"] = False
            if out:
                return out

    return read


def gzip_member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _open(uri: str, mode: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    if mode == "w":
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_stream(path, compression=None) if mode == "r" else system.open_input_file(path)


def write_archives(pages: DataFrame, key: str, url: str, payload: str, folder: str) -> DataFrame:
    """Write marked pages as monolithic gzip archives; gives ``archive`` and ``n_records`` of each file."""
    source = pages.select(
        F.col(key).cast("long").alias("key"),
        F.col(url).alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("body"),
        F.col("payload_digest").alias("digest"),
        F.col("refers_to").cast("long").alias("refers"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for part in row_slices(batch, "body"):
                for row in part.to_pylist():
                    if out is None:
                        name = f"{folder}/whole/{uuid.uuid4().hex}.warc.gz"
                        out, packer, n, size = _open(name, "w"), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                    body = row["body"].encode()
                    out.write(packer.compress(record(row["key"], row["url"], body, row["digest"], row["refers"])))
                    n, size = n + 1, size + len(body)
                    if size >= ARCHIVE_BYTES:
                        out.write(packer.flush())
                        out.close()
                        yield pa.RecordBatch.from_pydict({"archive": [name], "n_records": pa.array([n], pa.int64())})
                        out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "n_records": pa.array([n], pa.int64())})

    return store(source.mapInArrow(run, "archive string, n_records long"), "archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Bring the files named in ``archive`` to one gzip member per record, with a sidecar of JSON lines each.

    Gives ``members`` and ``sidecar``, the names of the new files, and ``n_records``. Memory holds one record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                stem = f"{folder}/members/{uuid.uuid4().hex}"
                members, sidecar, at, n = f"{stem}.warc.gz", f"{folder}/index/{uuid.uuid4().hex}.jsonl", 0, 0
                with _open(name, "r") as stream, _open(members, "w") as out, _open(sidecar, "w") as index:
                    for raw in split_records(inflate(stream)):
                        packed = gzip_member(raw)
                        out.write(packed)
                        entry = {"archive": members, "offset": at, "length": len(packed), "number": n}
                        index.write(json.dumps(entry).encode() + b"\n")
                        at, n = at + len(packed), n + 1
                found = {"members": [members], "sidecar": [sidecar], "n_records": pa.array([n], pa.int64())}
                yield pa.RecordBatch.from_pydict(found)

    files = archives.select("archive")
    n_files = max(1, files.count())
    return store(files.repartition(n_files).mapInArrow(run, "members string, sidecar string, n_records long"), "members")


INDEX = "archive string, offset long, length long, number long"
RECORDS = (
    "key long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
)


def read_index(normalised: DataFrame, folder: str) -> DataFrame:
    """The entries of the sidecars that ``normalised`` names; files of failed attempts do not count."""
    entries = normalised.sparkSession.read.schema(INDEX).json(f"{folder}/index")
    valid = normalised.select(F.col("members").alias("archive"))
    return entries.join(broadcast_if_small(valid), "archive", "left_semi")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Records by their index entries. A response whose payload does not have its digest raises.

    Revisits have the digest and length of the payload that they stand for, and a NULL payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        name, file = None, None
        for batch in batches:
            rows, held = [], 0
            for entry in batch.to_pylist():
                if entry["archive"] != name:
                    name, file = entry["archive"], _open(entry["archive"], "random")
                file.seek(entry["offset"])
                rows.append(_row(zlib.decompress(file.read(entry["length"]), 31), payloads))
                held += len(rows[-1][-1] or b"")
                if held > 1 << 24:
                    yield _rows(rows, names)
                    rows, held = [], 0
            yield _rows(rows, names)

    return index.mapInArrow(run, RECORDS)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    long, text = pa.int64(), pa.string()
    kinds = (long, text, text, text, long, long, pa.binary())
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _row(raw: bytes, payloads: bool) -> tuple:
    cut = raw.index(b"\r\n\r\n")
    head = parse_head(raw[:cut])
    block = raw[cut + 4 : cut + 4 + int(head["content-length"])]
    digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(head["warc-payload-length"])
    body = None
    if head["warc-type"] == "response":
        body = block[block.index(b"\r\n\r\n") + 4 :]
        if len(body) != size or hashlib.sha256(body).hexdigest() != digest:
            raise ValueError(f"damaged record {head['warc-record-id']}")
    key, refers = _page(head["warc-record-id"]), _page(head.get("warc-refers-to"))
    url = head.get("warc-target-uri")
    return key, url, head["warc-type"], digest, size, refers, body if payloads else None


def _page(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">") if urn else "null"
    return None if number == "null" else int(number)


def round_trip(pages: DataFrame, key: str, url: str, payload: str, payloads: bool = True) -> DataFrame:
    """Write all pages, normalise the archives, and read every record back through the index.

    An empty table writes no archive and gives no record. Characters that a header cannot hold are escaped in the URL.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    marked = mark_revisits(pages.select(key, url, payload), key, payload)
    archives = write_archives(marked, key, url, payload, folder)
    normalised = normalise(archives, folder)
    if normalised.isEmpty():
        return pages.sparkSession.createDataFrame([], RECORDS)
    return read_records(read_index(normalised, folder), payloads)
