"""WARC archives: writing, the monolithic-gzip normaliser, and reading by offset.

Some writers compress a whole archive as one gzip stream, which allows no
access to a single record. The normaliser inflates such a stream once, front
to back, finds the records by their Content-Length, writes each as a gzip
member of its own, and writes a sidecar index of where each member starts.
It holds one record and one inflated block at a time.

`archive` writes pages as response and revisit records into monolithic
archives, `normalise` rewrites them, `records` reads the records back through
the index. Archives and manifests are in the shared folder; a task's files
count only if its manifest rows were committed, so a repeated attempt leaves
no doubles.

Defined cases: a null html is the empty payload. Payloads below `least` bytes
are never revisits. Of equal payloads the largest page_id is the response;
repeated rows with that page_id and payload are responses each. A null page_id
counts as smaller than any other, and where every copy lacks an id all are
responses. A very long payload is one record, held whole by the task that
writes or reads it. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Columns, Store, Told, rows_of, scratch_path, scratch_table

#: Fixed date of the archives, so that they are the same each time.
DATE = "2024-01-01T00:00:00Z"
_BLOCK = 1 << 16


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def _base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _hex(told: str) -> str:
    return base64.b32decode(told.removeprefix("sha1:")).hex()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit that keeps the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url or "")
    headers = [("WARC-Record-ID", _urn(page_id)), ("WARC-Target-URI", target), ("WARC-Date", DATE), ("WARC-Payload-Digest", _base32(digest)), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))]
    return record("revisit" if revisit else "response", headers, http if revisit else http + payload)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def cut(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The records in a stream of inflated blocks, each with its closing line ends."""
    held = bytearray()
    need = 0
    for block in blocks:
        held += block
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields = (line.partition(b":") for line in bytes(held[:end]).split(b"\r\n"))
                need = end + 8 + next(int(v) for k, _, v in fields if k.strip().lower() == b"content-length")
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError(f"the archive ends within a record: {len(held)} bytes are left")


def inflated(source) -> Iterator[bytes]:
    """Blocks of a gzip file, however many members it has; each block is bounded whatever the ratio."""
    engine = zlib.decompressobj(31)
    while raw := source.read(_BLOCK):
        while raw:
            yield engine.decompress(raw, 16 * _BLOCK)
            raw = engine.unconsumed_tail
            if engine.eof:
                raw, engine = engine.unused_data, zlib.decompressobj(31)


def decided(pages: DataFrame, least: int, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, Told]:
    """A written table of page_id, url, payload, digest, row; and by row, for pages with a larger copy, that copy's page_id.

    Digests decide; payloads are never shuffled.
    """
    payload = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    own = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    own = scratch_table(own.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes"), F.monotonically_increasing_id().alias("row")), "warc-pages")
    long = own.where(F.col("bytes") >= least).select("page_id", "digest", "row")
    # a row a digest after map-side combining: the group of a hot payload is never gathered
    copies = long.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    told = long.join(copies, "digest").where("not page_id <=> keeper and keeper is not null").select("row", F.col("keeper").alias("value"))
    return own.select("page_id", "url", "payload", "digest", "row"), Told(told, "warc-revisits")


def archive(pages: DataFrame, least: int = 1000, most: int = 1 << 30, **columns) -> tuple[str, DataFrame]:
    """Writes monolithic archives of about `most` inflated bytes at most; gives their folder and the manifest (name, records)."""
    folder = scratch_path(pages.sparkSession, "warc-whole")
    schema = pa.schema([("name", pa.string()), ("records", pa.int64())])
    own, revisits = decided(pages, least, **columns)

    def run(batches):
        look, waiting = revisits.reader(), None

        def rows():
            for batch in batches:
                found, keeper = look(batch.column(4).to_numpy())
                yield from zip(rows_of(batch), found.tolist(), keeper.tolist(), strict=True)

        source = rows()
        while (waiting := waiting or next(source, None)) is not None:
            name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
            with Store(folder).write(name) as f:
                engine = zlib.compressobj(4, zlib.DEFLATED, 31)
                f.write(engine.compress(record("warcinfo", [("WARC-Record-ID", "<urn:info>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                while waiting is not None and (not n or size < most):
                    (page_id, url, payload, digest, _), revisit, keeper = waiting
                    data = page_record(page_id, url, payload, digest, keeper if revisit else None, revisit)
                    f.write(engine.compress(data))
                    n, size, waiting = n + 1, size + len(data), next(source, None)
                f.write(engine.flush())
            yield pa.RecordBatch.from_pylist([{"name": name, "records": n}], schema=schema)

    return folder, scratch_table(own.mapInArrow(run, "name string, records long"), "warc-whole-manifest")


def normalise(folder: str, manifest: DataFrame) -> tuple[str, DataFrame]:
    """Rewrites each archive with a gzip member a record, and NAME.idx: pairs of little-endian 64-bit offset and length."""
    target = scratch_path(manifest.sparkSession, "warc-members")
    schema = pa.schema([("name", pa.string()), ("records", pa.int64())])

    def run(batches):
        for batch in batches:
            for (name,) in rows_of(batch):
                new, index, at = f"{uuid.uuid4().hex}.warc.gz", [], 0
                store = Store(target)
                with Store(folder).open(name) as source, store.write(new) as f:
                    for data in cut(inflated(source)):
                        engine = zlib.compressobj(4, zlib.DEFLATED, 31)
                        member = engine.compress(data) + engine.flush()
                        f.write(member)
                        index.append((at, len(member)))
                        at += len(member)
                with store.write(new + ".idx") as f:
                    f.write(np.array(index, "<i8").tobytes())
                yield pa.RecordBatch.from_pylist([{"name": new, "records": len(index)}], schema=schema)

    names = manifest.select("name").repartition(max(1, manifest.count()))  # a row an archive
    return target, scratch_table(names.mapInArrow(run, "name string, records long"), "warc-members-manifest")


def records(folder: str, manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page record, through the index."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        store = Store(folder)
        for batch in batches:
            for (name,) in rows_of(batch):
                out = Columns(schema)
                with store.open(name) as f:
                    for at, size in np.frombuffer(store.read(name + ".idx"), "<i8").reshape(-1, 2).tolist():
                        f.seek(at)
                        headers, block = parsed(zlib.decompress(f.read(size), 31))
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                        digest = _hex(headers["WARC-Payload-Digest"])
                        if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{name}, {headers['WARC-Record-ID']}: the payload is damaged")
                        out.add(_page(headers["WARC-Record-ID"]), length, digest, kind, _page(headers["WARC-Refers-To"]) if kind == "revisit" else None)
                        if len(out) >= 5000:
                            yield out.take()
                yield out.take()

    names = manifest.select("name").repartition(max(1, manifest.count()))
    return names.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Archives the pages, normalises the archives, drops the monolithic ones and reads the records back."""
    folder, whole = archive(pages, least)
    target, members = normalise(folder, whole)
    if whole.head(1):
        Store(folder).drop()
    return records(target, members)
