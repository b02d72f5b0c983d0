"""WARC archives compressed by record with a shared Zstandard dictionary (operator 5).

Writing: each page becomes one compressed frame on the map side (so only compressed bytes are shuffled); equal
payloads are found by digest with an aggregate, and all but one of them become revisit records without a payload.
Archives are written to the shared folder under names of their own attempt, and a manifest, which only
successful tasks get into, lists them; so tasks that are lost, repeated or speculated leave no double records.
An archive begins with the dictionary in a skippable frame, then a warcinfo record, then one frame a record.

Reading: the dictionary is loaded from the leading skippable frame, frames are decoded one at a time from a
stream, and version line, header lines, content length, trailer and (for responses) the payload digest are
checked; ``WarcError`` names what is wrong. Memory: one record.

Defined results: a null html is an empty payload; a null url is the empty target; rows that repeat page_id and
payload are of one kind (all responses if theirs is the largest page_id); a null page_id is smaller than any
other; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.session import shared_dir, ship

#: Fixed values of the format: the dictionary's skippable frame, Zstandard's frame magic.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION, EOL = b"WARC/1.1", b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
#: Payloads below this size are never revisits; an archive is closed beyond this size.
LEAST, ARCHIVE = 1000, 64 << 20
#: The dictionary is trained on at most so many pages of at most so many characters (those of the least hashes).
SAMPLE, LONGEST, DICTIONARY = 400, 32_768, 32_768


class WarcError(ValueError):
    pass


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(EOL + EOL)[2]

    @property
    def http(self) -> dict[str, str]:
        lines = self.block.partition(EOL + EOL)[0].decode("utf-8", "replace").split("\r\n")[1:]
        return {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in lines)}


def _clean(url: str) -> str:
    """A header value cannot hold control characters or blanks."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(kind: str, record_id: str, url: str, block: bytes, more: Iterable[tuple[str, str]] = ()) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)), *more, ("Content-Length", str(len(block)))]
    return VERSION + EOL + "".join(f"{a}: {b}\r\n" for a, b in lines if b or a == "Content-Length").encode() + EOL + block + EOL + EOL


def page_record(page_id: object, url: str, size: int, digest: bytes, payload: bytes | None, refers_to: object = None) -> bytes:
    """A response with its payload, or, without one, a revisit of the page refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    more = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode())]
    if payload is None:
        more += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{page_urn(refers_to)}>")]
    return record("response" if payload is not None else "revisit", page_urn(page_id), url, http + (payload or b""), more)


def page_urn(page_id: object) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def page_of(header: str) -> int | None:
    value = header.strip("<>").removeprefix("urn:page:")
    return int(value) if value else None


def train(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary for the pages; what is too little to train on is the dictionary itself (or there is none)."""
    if sum(map(len, samples)) > 10 * size and len(samples) >= 10:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def read(stream, piece: int = 1 << 20) -> Iterator[Record]:
    """Records of an archive, from anything with read(n)."""
    data = stream.read(8)
    dictionary = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", data[4:])[0]
        raw = b""
        while len(raw) < size:
            more = stream.read(size - len(raw))
            if not more:
                raise WarcError("the dictionary is cut off")
            raw += more
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be compressed itself
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary, data = zstandard.ZstdCompressionDict(raw), b""
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        data = data or stream.read(piece)
        if not data:
            return
        frame, out = decoder.decompressobj(), []
        while True:
            try:
                out.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise WarcError(f"a frame can't be decoded: {e}") from e
            if frame.eof:
                data = frame.unused_data
                break
            data = stream.read(piece)
            if not data:
                raise WarcError("the last frame is cut off")
        yield parse(b"".join(out))


def parse(raw: bytes) -> Record:
    """One record, checked."""
    head, gap, rest = raw.partition(EOL + EOL)
    lines = head.split(EOL)
    if not gap or lines[0] not in (b"WARC/1.0", VERSION):
        raise WarcError("no WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"not a header line: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdigit():
        raise WarcError("content-length isn't a number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != EOL + EOL:
        raise WarcError(f"content-length is {size}, the block has {len(rest) - 4} bytes")
    found = Record(headers["warc-type"], headers, rest[:size])
    if found.kind == "response" and (digest := headers.get("warc-payload-digest", "")).startswith("sha1:"):
        if hashlib.sha1(found.payload).digest() != base64.b32decode(digest[5:]):
            raise WarcError("the payload doesn't have its digest")
    return found


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def fit_dictionary(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> bytes:
    few = pages.where(F.length(html_col).between(1, LONGEST)).select(F.xxhash64(id_col, F.length(html_col)).alias("h"), F.col(html_col).alias("html"))
    edge = few.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    rows = few.where(F.col("h") <= edge).limit(2 * SAMPLE).collect() if edge is not None else []
    return train([r["html"].encode("utf-8", "replace") for r in sorted(rows, key=lambda r: (r["h"], r["html"]))[:SAMPLE]])


def write(pages: DataFrame, folder: str, least: int = LEAST, archive: int = ARCHIVE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives of the pages into folder (a uri that all machines share); gives the manifest (path, records, bytes), already written."""
    spark = pages.sparkSession
    ship(spark)
    shared_dir(spark)
    dictionary = fit_dictionary(pages, id_col, html_col)
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def compressor():
        return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)

    def frames(batches):
        pack = compressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, size, digests, out = batch.slice(lo, 256), [], [], []
                for page, url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    payload = html.encode("utf-8", "replace")
                    size.append(len(payload))
                    digests.append(hashlib.sha1(payload).digest())
                    out.append(pack.compress(page_record(page, url, len(payload), digests[-1], payload)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(digests, pa.binary()), pa.array(out, pa.binary())], ["page_id", "url", "size", "digest", "frame"])

    made = src.mapInArrow(frames, "page_id long, url string, size long, digest binary, frame binary")
    digest = F.unhex(F.sha1(F.encode("html", "UTF-8")))
    shared = src.where(F.octet_length("html") >= least).select(digest.alias("digest"), "page_id").groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    ready = made.join(shared, "digest", "left").select("page_id", "url", "size", "digest", "keeper", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull(), F.lit(None)).otherwise(F.col("frame")).alias("frame"))

    def store(batches):
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        pack, sink, path, size, n = compressor(), None, "", 0, 0

        def begin():
            nonlocal sink, path, size, n
            path, n = f"{root}/{uuid.uuid4().hex}.warc.zst", 0
            sink = system.open_output_stream(path)
            info = f"software: vigilake\r\nformat: WARC file version 1.1\r\nconformsTo: {REVISIT_PROFILE.rsplit('/', 2)[0]}\r\n".encode()
            head = dictionary_frame(dictionary) + pack.compress(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", "", info, [("Content-Type", "application/warc-fields")]))
            sink.write(head)
            size = len(head)

        def done():
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([os.path.basename(path)]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for page, url, length, digest, keeper, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    begin()
                frame = frame if frame is not None else pack.compress(page_record(page, url, length, digest, None, keeper))
                sink.write(frame)
                size, n = size + len(frame), n + 1
                if size >= archive:
                    yield done()
                    sink = None
        if sink is not None:
            yield done()

    return ready.mapInArrow(store, "path string, records long, bytes long").checkpoint()


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of each page record of the manifest's archives."""
    ship(manifest.sparkSession)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

    def run(batches):
        system, root = _open(folder)
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen = [], 0
                with system.open_input_stream(f"{root}/{path}") as stream:
                    for found in read(stream):
                        if found.kind not in ("response", "revisit"):
                            continue
                        h, seen = found.headers, seen + 1
                        digest = base64.b32decode(h["warc-payload-digest"][5:]).hex()
                        size = len(found.payload) if found.kind == "response" else int(found.http["content-length"])
                        refers = page_of(h["warc-refers-to"]) if found.kind == "revisit" else None
                        rows.append((page_of(h["warc-record-id"]), size, digest, found.kind, refers, h.get("warc-target-uri", "")))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if seen != records:
                    raise WarcError(f"{path} has {seen} page records of {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "records").repartition(parts, "path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")
