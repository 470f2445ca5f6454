"""WARC archives of dictionary-compressed records.

Each archive begins with a skippable frame that holds a Zstandard dictionary
trained on the archive's own records; every record then is a frame of its own,
compressed with that dictionary, so records can be read one by one. Records of
equal payloads are written once; the others are revisit records.

Tasks write archives to a folder that all machines share, under names that no
other attempt uses. The manifest lists only the archives of the attempts that
succeeded, so a lost executor leaves nothing but an unlisted file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch

#: First bytes of the frame that holds the dictionary, and the revisit profile: fixed values.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_ID = "urn:x-page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Fields of a record; the payload of a response is read and its digest computed anew."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
    number = lambda name: int(n) if (n := fields.get(name, "").strip("<>").removeprefix(_ID)) else None
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None}


def train_dictionary(records: list[bytes], size: int, sample: int = 4 << 20) -> bytes:
    """A dictionary from evenly spread records of at most `sample` bytes; raw content where there are too few."""
    total = sum(map(len, records))
    step = max(1, -(-total // sample))
    chosen = records[::step]
    size = min(size, max(256, sum(map(len, chosen)) // 8))
    try:
        return zstandard.train_dictionary(size, chosen, d=8, k=200, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[: max(1, size // len(chosen))] for r in chosen)[:size]


def write_archive(records: list[bytes], size: int = 64 << 10, level: int = 6) -> bytes:
    content = train_dictionary(records, size)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=True)
    out = [struct.pack("<II", DICTIONARY_MAGIC, len(content)), content]
    out += [packer.compress(r) for r in records]
    return b"".join(out)


def read_archive(data: bytes) -> Iterator[bytes]:
    """Records of an archive, one after another."""
    magic, length = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    view, at = memoryview(data), 8 + length
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[8:at])))
    while at < len(data):
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            piece = view[at : at + (16 << 10)]
            if not len(piece):
                raise ValueError("the last record is cut off")
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def _writer(folder: str, limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        records, size = [], 0

        def flush() -> pd.DataFrame:
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = write_archive(records)
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            return pd.DataFrame({"path": [f"{folder}/{name}"], "records": [len(records)], "bytes": [len(data)]})

        for batch in batches:
            for page_id, url, html, lead, revisit in zip(batch["page_id"], batch["url"], batch["html"], batch["lead"], batch["revisit"], strict=True):
                known = lambda n: None if pd.isna(n) else int(n)
                records.append(build_record(known(page_id), url, (html or "").encode(), known(lead), bool(revisit)))
                size += len(records[-1])
                if size >= limit:
                    yield flush()
                    records, size = [], 0
        if records:
            yield flush()

    return run


def write_warc(pages: DataFrame, folder: str | None = None, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, archive_bytes: int = 32 << 20) -> DataFrame:
    """Writes a record for every row; returns the manifest (path, records, bytes).

    Of rows with equal payloads of at least `least` bytes, the one of the
    largest id is a response and the others revisit it; smaller payloads are
    all responses. Null payloads are empty. Rows that repeat the largest id
    are all responses, and a row of a null id revisits the largest id there
    is; payloads of null ids alone are all responses. Equality is that of
    SHA-256. `folder` is any place that pyarrow can write to and all machines
    share; without one the shared folder of the session is used.
    """
    scratch = Scratch(pages.sparkSession)
    folder = folder or scratch.path()
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("sha", F.sha2(F.coalesce("html", F.lit("")), 256)).withColumn("size", F.coalesce(F.octet_length("html"), F.lit(0)))
    leads = rows.filter(F.col("size") >= least).groupBy("sha").agg(F.max("page_id").alias("lead"), F.count("*").alias("n"))
    leads = scratch.keep(leads.filter("n > 1 and lead is not null").select("sha", "lead"))
    marked = rows.join(leads, "sha", "left")
    revisit = F.col("lead").isNotNull() & (F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("lead"))
    marked = marked.select("page_id", "url", "html", "lead", revisit.alias("revisit"))
    manifest = marked.mapInPandas(_writer(folder, archive_bytes), "path string, records long, bytes long")
    manifest = scratch.keep(manifest)
    scratch.drop(leads)
    return manifest


def _reader(with_payload: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as source:
                    data = source.read()
                rows = []
                for record in read_archive(data):
                    row = parse_record(record)
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    if len(rows) == 2000:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    return run


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_warc(manifest: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """Records of the archives that a manifest lists; archives are dealt out one to a task."""
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    paths = manifest.select("path")
    return paths.repartition(max(1, min(10_000, paths.count()))).mapInPandas(_reader(with_payload), kind)
