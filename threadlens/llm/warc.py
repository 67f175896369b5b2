"""WARC archives: writing them, normalising monolithic gzip files, and reading records through a sidecar index.

A monolithic file is one gzip stream over all its records, so nothing in it can be reached without inflating all that comes before.
The normaliser inflates such a file once, from front to back, and writes every record as a gzip member of its own, with an
index of members beside it. Files live in a folder that all executors share. A task writes under a name of its own and reports it,
so what a lost or repeated task has left is never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.shared import materialise, remove_folder, shared_folder

VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 18
#: Salts that the rows of one digest are spread over.
SALTS = 32
#: Digests that occur more than once are sent to all executors up to this size; beyond it pages are shuffled to meet them.
BROADCAST_BYTES, DIGEST_BYTES = 32 << 20, 96
#: Most tasks that archives are dealt to; beyond it a task takes several.
MOST_TASKS = 20_000


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit if `refers_to` names the page whose record has the payload. Both carry the HTTP header, so a
    revisit tells the payload's length and digest without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": page_urn(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:x-page:{page_id}",
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        fields |= {"WARC-Refers-To": page_urn(refers_to), "WARC-Profile": REVISIT_PROFILE}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflate(file: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file of one or several members, block by block. A file that ends inside a member raises an error, wherever it was cut."""
    engine, inside = zlib.decompressobj(31), False
    while data := file.read(BLOCK):
        while data:
            inside = True
            yield engine.decompress(data, BLOCK)
            while engine.unconsumed_tail:
                yield engine.decompress(engine.unconsumed_tail, BLOCK)
            data = engine.unused_data if engine.eof else b""
            if engine.eof:
                engine, inside = zlib.decompressobj(31), False
    if inside:
        raise ValueError("the archive ends inside a gzip member")


def split_records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, each with its head, block and closing empty lines. A record is held in memory, a file is not."""
    held = bytearray()
    blocks = iter(blocks)

    def more() -> bool:
        for block in blocks:
            if block:
                held.extend(block)
                return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a record's head")
                return
        if not held.startswith(b"WARC/"):
            raise ValueError("a record does not begin with WARC/")
        size = end + 4 + int(parse_head(bytes(held[:end])).get("content-length", 0)) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield bytes(held[:size])
        del held[:size]


def mark_revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Adds `refers_to`: of pages with equal payloads of `min_payload` bytes or more the largest page_id is the response (null), the others refer to
    it. Only digests are grouped, summed up before the shuffle. Digests that occur more than once are joined with the pages: up to BROADCAST_BYTES of
    them are sent to the pages, beyond it both are shuffled, the rows of a frequent payload spread over SALTS parts. The result is the same."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    several = keyed.where(F.col("size") >= min_payload).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    several = materialise(several.select(F.col("digest").alias("d"), "first"))
    if several.count() * DIGEST_BYTES <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(several), (F.col("digest") == F.col("d")) & (F.col("size") >= min_payload), "left")
    else:
        several = several.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = keyed.withColumn("salt", salt).join(several, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")) & (F.col("size") >= min_payload), "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_monolithic(pages: DataFrame, folder: str, archive_bytes: int = 16 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes `pages(page_id, url, html, refers_to)` as files of one gzip stream each, of about `archive_bytes` inflated, and returns their paths."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = open_folder(folder)
        files.create_dir(root, recursive=True)
        out = engine = path = None
        inside = 0
        for part in parts:
            for page_id, url, html, refers_to in zip(part["page_id"], part["url"], part["html"], part["refers_to"]):
                if out is None:
                    path, inside = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out, engine = files.open_output_stream(path, compression=None), zlib.compressobj(6, wbits=31)
                record = build_record(None if pd.isna(page_id) else int(page_id), url, (html or "").encode("utf-8", "surrogatepass"), None if pd.isna(refers_to) else int(refers_to), date)
                out.write(engine.compress(record))
                inside += len(record)
                if inside >= archive_bytes:
                    out.write(engine.flush())
                    out.close()
                    yield pd.DataFrame({"path": [path]})
                    out = None
        if out is not None:
            out.write(engine.flush())
            out.close()
            yield pd.DataFrame({"path": [path]})

    exact = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))
    return materialise(exact.mapInPandas(write, "path string"))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """`archives(path)` -> the index: path, offset and length of every member, and its record's id, type, target, digest and refers_to.

    Each file is inflated once. Beside every file written is its index, `<file>.idx`, a JSON line for each member. An archive without records
    gives an empty file; one that is cut off raises an error."""

    def rewrite(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = open_folder(folder)
        files.create_dir(root, recursive=True)
        for part in parts:
            for source in part["path"]:
                path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                rows, offset = [], 0
                with files.open_input_stream(source, compression=None) as file, files.open_output_stream(path, compression=None) as out:
                    for record in split_records(inflate(file)):
                        head = parse_head(record[: record.index(b"\r\n\r\n")])
                        engine = zlib.compressobj(6, wbits=31)
                        member = engine.compress(record) + engine.flush()
                        out.write(member)
                        rows.append((path, offset, len(member), *(head.get(k) for k in ("warc-record-id", "warc-type", "warc-target-uri", "warc-payload-digest", "warc-refers-to"))))
                        offset += len(member)
                index = pd.DataFrame(rows, columns=["path", "offset", "length", "record_id", "record_type", "target", "digest", "refers_to"])
                with files.open_output_stream(f"{path}.idx", compression=None) as out:
                    for row in index.drop(columns="path").to_dict("records"):
                        out.write(json.dumps(row).encode() + b"\n")
                yield index

    schema = "path string, offset long, length long, record_id string, record_type string, target string, digest string, refers_to string"
    # an archive is a task's least work; a number of tasks that is named is not made smaller because paths are
    return materialise(archives.repartition(_tasks(archives.count())).mapInPandas(rewrite, schema))


def _tasks(archives: int) -> int:
    return max(1, min(archives, MOST_TASKS))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Reads the members that `index` names in the store that `folder` is in, each by its offset alone: record_id, record_type, target, refers_to, payload_bytes,
    payload_digest and payload (null for a revisit, whose length and digest are those of the payload it stands for)."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = open_folder(folder)
        for part in parts:
            rows, held = [], 0
            for path, members in part.groupby("path", sort=True):
                with files.open_input_file(path) as file:
                    for offset, length in zip(members["offset"], members["length"]):
                        file.seek(int(offset))
                        record = zlib.decompress(file.read(int(length)), 31)
                        cut = record.index(b"\r\n\r\n")
                        head = parse_head(record[:cut])
                        block = record[cut + 4 : cut + 4 + int(head["content-length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if head["warc-type"] == "response":
                            size, digest = len(payload), payload_digest(payload)
                        else:
                            size, digest, payload = int(parse_head(http)["content-length"]), head["warc-payload-digest"].removeprefix("sha1:"), None
                        rows.append((head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"), head.get("warc-refers-to"), size, digest, payload))
                        held += len(record)
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=NAMES)
                            rows, held = [], 0
            yield pd.DataFrame(rows, columns=NAMES)

    members = index.select("path", "offset", "length")
    tasks = _tasks(members.select("path").distinct().count())
    # by ranges of paths and offsets, so that a task reads on from where it is, and a large file is shared by several
    return members.repartitionByRange(2 * tasks, "path", "offset").sortWithinPartitions("path", "offset").mapInPandas(read, SCHEMA)


NAMES = ["record_id", "record_type", "target", "refers_to", "payload_bytes", "payload_digest", "payload"]
SCHEMA = "record_id string, record_type string, target string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def round_trip(pages: DataFrame, folder: str | None = None, min_payload: int = 0) -> DataFrame:
    """Writes `pages(page_id, url, html)` as monolithic archives, normalises them and reads every record back by the index.

    One row for each page, with page_id and refers_to as longs. A null html is an empty payload; a null url gets the page's own URN. A null page_id
    is a response only if no page with its payload has an id. Rows that share the largest page_id of a payload are all responses.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    archives = write_monolithic(mark_revisits(pages, min_payload), f"{folder}/monolithic")
    index = normalise(archives, f"{folder}/members")
    remove_folder(pages.sparkSession, f"{folder}/monolithic")  # the index is written: nothing asks for them again
    records = read_records(index, folder)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:x-page:(-?\d*)>$", 1), F.lit("")).cast("long")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "target", "payload")
