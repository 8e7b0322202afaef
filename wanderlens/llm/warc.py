"""WARC archives in seekable Zstandard bundles.

A page is one record. Among pages with equal payloads the smallest key holds the payload, the
others revisit it. Records fill independent Zstandard frames of about ``FRAME`` bytes, frames fill
bundles of about ``BUNDLE`` bytes, and a bundle ends with a skippable frame that holds the seek
table of the published seekable format. An index maps each record to its frame and the place in it,
so one record is read by inflating one frame.

Bundles are rows of a table in the shared folder, as Spark alone can write to any store;
``export_files`` writes them as ``.warc.zst`` files where executors share a mounted folder.
A payload that a third of all pages have is one row of the table of payloads, and its pages meet
that row in ``SALT`` parts. Memory holds one frame and one bundle for each task.

Defined cases: a null payload is an empty one; rows that repeat the smallest key of a payload all
hold it; a null key is never the smallest and refers to the smallest key there is; a null URL is
left out; an empty table gives no bundle and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wanderlens.sources.stored import stored

FRAME = 256 * 1024
BUNDLE = 4 * 1024 * 1024
LEVEL = 3
SALT = 8
SMALLEST = 0
DATE = "2024-01-01T00:00:00Z"

#: Fixed values of the published formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

BUNDLE_SCHEMA = (
    "bundle string, data binary, records array<struct<key:bigint,frame:int,at:int,length:int>>")
RECORD_SCHEMA = (
    "key long, record_type string, refers_to long, payload_digest string, payload_bytes long, url string, payload binary")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit carries the length and digest of its payload but not the payload."""
    name = lambda k: f"<urn:x-page:{'' if k is None else k}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(key)}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        safe = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    block = HTTP + payload if refers_to is None else HTTP
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """A record's row of ``RECORD_SCHEMA``; fails if the payload does not have the digest that it names."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    number = lambda urn: int(urn[12:-1]) if urn and urn[12:-1] else None
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    full, named = fields["WARC-Type"] == "response", fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2] if full else None
    if full and (digest(payload) != named or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return (number(fields["WARC-Record-ID"]), fields["WARC-Type"], number(fields.get("WARC-Refers-To")), named,
            int(fields["X-Payload-Length"]), fields.get("WARC-Target-URI"), payload)


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for frames of (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frame_places(data: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, plain size) of each frame, read from the end of a bundle."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    places, at = [], 0
    for compressed, plain in struct.iter_unpack("<II", data[-9 - 8 * count : -9]):
        places.append((at, compressed, plain))
        at += compressed
    return places


def _bundles(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    task, made = TaskContext.get().partitionId(), 0
    press = zstandard.ZstdCompressor(level=LEVEL)
    frame, index, frames, data = bytearray(), [], [], bytearray()

    def close_frame() -> None:
        small = press.compress(bytes(frame))
        frames.append((len(small), len(frame)))
        data.extend(small)
        frame.clear()

    def close_bundle() -> pd.DataFrame:
        nonlocal made
        row = (f"{task:05d}-{made:05d}", bytes(data) + seek_table(frames), list(index))
        made += 1
        for x in (data, frames, index):
            x.clear()
        return pd.DataFrame([row], columns=["bundle", "data", "records"])

    for batch in batches:
        for key, url, html, refers_to in batch.astype(object).itertuples(index=False):
            blank = lambda x: None if pd.isna(x) else int(x)
            made_record = record(blank(key), url, (html or "").encode("utf-8", "surrogatepass"), blank(refers_to))
            index.append({"key": blank(key), "frame": len(frames), "at": len(frame), "length": len(made_record)})
            frame.extend(made_record)
            if len(frame) >= FRAME:
                close_frame()
                if len(data) >= BUNDLE:
                    yield close_bundle()
    if frame:
        close_frame()
    if index:
        yield close_bundle()


def write(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", smallest: int = SMALLEST) -> DataFrame:
    """The bundles of all pages, a stored table of ``BUNDLE_SCHEMA``."""
    body = F.coalesce(pages[html], F.lit(""))
    rows = pages.select(pages[key].cast("long").alias("key"), pages[url].alias("url"), body.alias("html"), F.when(
        F.octet_length(body) >= smallest, F.sha1(body.cast("binary"))).alias("same"))
    shared = rows.where("same is not null").groupBy("same").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).where("n > 1").select(
        F.col("same").alias("of"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int"))
    met = salted.join(shared.hint("shuffle_hash"), (F.col("same") == F.col("of")) & (F.col("salt") == F.col("part")), "left")
    refers_to = F.when(~F.col("first").eqNullSafe(F.col("key")), F.col("first"))
    return stored(met.select("key", "url", "html", refers_to.alias("refers_to")).mapInPandas(_bundles, BUNDLE_SCHEMA), "warc")


def _records(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    inflate = zstandard.ZstdDecompressor()
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    for batch in batches:
        for data, index in zip(batch["data"], batch["records"], strict=True):
            places, current, plain, rows = frame_places(data), -1, b"", []
            for entry in index:
                if entry["frame"] != current:
                    if rows:
                        yield pd.DataFrame(rows, columns=names).astype({"key": object, "refers_to": object})
                    current, rows = entry["frame"], []
                    at, size, full = places[current]
                    plain = inflate.decompress(data[at : at + size], max_output_size=full)
                rows.append(parse(plain[entry["at"] : entry["at"] + entry["length"]]))
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"key": object, "refers_to": object})


def read(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, checked against its digest: rows of ``RECORD_SCHEMA``."""
    return bundles.select("data", "records").mapInPandas(_records, RECORD_SCHEMA)


def export_files(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle to ``folder``, which all executors have mounted; ``bundle, bytes`` of the files."""

    def put(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle, data in zip(batch["bundle"], batch["data"], strict=True):
                Path(folder, f"{bundle}.warc.zst").write_bytes(data)
                yield pd.DataFrame({"bundle": [bundle], "bytes": [len(data)]})

    return bundles.select("bundle", "data").mapInPandas(put, "bundle string, bytes long")


#: A SHA-1 as four numbers of 40 bits, each of which is eight characters of base 32.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {10 * c + 1}, 10))::bigint >> {35 - 5 * k}) & 31)::int + 1, 1)"
    for c in range(4) for k in range(8))
ORACLE = f"""
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages),
first as (select h, min(page_id) f from p group by h)
select page_id, octet_length(encode(html))::bigint payload_bytes, {_BASE32} payload_digest,
       case when page_id = f then 'response' else 'revisit' end record_type,
       case when page_id <> f then f end refers_to
from p join first using (h)
"""
