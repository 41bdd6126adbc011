"""A deterministic, sharded WARC writer, and its reader.

Records are range-sorted by id. The ranges come from an exact histogram of payload bytes over steps of the id, of which the
heavy ones are cut again, not from a sample, so the same rows give the same shards, files and bytes in every run. There
are as many shards as the bytes ask for; only rows that share an id can't be parted. Each writer task rolls its files by
their compressed size, makes headers and digests anew from the payload, and writes under names of its own in
``_temporary``; the rows it returns are its manifest. Only the manifests of successful attempts reach the driver, which
moves their files to their final names and writes ``MANIFEST.json`` last: a folder without it is not complete. Attempts
that were lost leave nothing but temporary files, which the commit removes.

Of the records with equal payloads of at least ``min_revisit`` bytes the one with the largest id is the response and
the others are revisits that refer to it; marks for the revisits travel to the writers beside the pages, so that the
payloads are shuffled once and a payload with many copies is never gathered.

Defined cases: a null payload is empty; a null id sorts first and can be no revisit; null and empty URLs become
``about:blank``, and blanks and unprintable characters of other URLs ``%20``, so that a header stays one line; rows that repeat both id and payload of a response are responses too; an empty table gives an archive without files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.llm.order import Steps, prefix_sums, steps
from spotlattice.llm.util import sized_broadcast, stored

VERSION = "WARC/1.1"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST_SCHEMA = "shard int, roll int, tmp string, name string, records long, bytes long, sha256 string"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _warc(fields: list[tuple[str, object]], block: bytes) -> bytes:
    fields = [*fields, ("WARC-Block-Digest", _digest(block)), ("Content-Length", len(block))]
    return "".join([VERSION, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def _one_line(url: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else "%20" for c in url) if url else "about:blank"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its HTTP headers and payload, or a revisit with the headers alone."""
    digest = _digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _one_line(url)),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", digest),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", page_id))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-Id", refers_to)]
    return _warc(fields, http + payload if refers_to is None else http)


def _member(record: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


class _Files:
    """The files of one writer task, rolled by compressed size. Rows of the manifest are in ``done``."""

    def __init__(self, root: str, roll_bytes: int, level: int):
        self.fs, self.root = _fs(root)
        self.mine = f"{self.root}/_temporary/{uuid.uuid4().hex}"
        self.roll_bytes, self.level, self.done, self.out, self.shard = roll_bytes, level, [], None, None
        self.fs.create_dir(self.mine, recursive=True)

    def add(self, shard: int, record: bytes) -> None:
        if self.out is not None and (shard != self.shard or self.size >= self.roll_bytes):
            roll = self.roll + 1 if shard == self.shard else 0
            self.close()
            self.open(shard, roll)
        elif self.out is None:
            self.open(shard, 0)
        self.put(_member(record, self.level))
        self.records += 1

    def open(self, shard: int, roll: int) -> None:
        self.shard, self.roll, self.size, self.records, self.sha = shard, roll, 0, 0, hashlib.sha256()
        self.name = f"part-{shard:06d}-{roll:05d}.warc.gz"
        self.out = self.fs.open_output_stream(f"{self.mine}/{self.name}", compression=None)
        info = _warc([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        self.put(_member(info, self.level))

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.done.append((self.shard, self.roll, f"{self.mine}/{self.name}", self.name, self.records, self.size, self.sha.hexdigest()))


def _shards_by_bytes(slim: DataFrame, shard_bytes: int) -> tuple[Steps, DataFrame]:
    """Steps of page_id, and a table (__b, __shard) that puts them into shards of about shard_bytes, from (page_id, bytes)."""
    every = steps(slim, "page_id", max(1, shard_bytes // 64), F.col("bytes"))
    sums = stored(every.of(slim).groupBy("__b").agg(F.sum("bytes").alias("bytes")).withColumn("__at", F.col("__b")), "steps")
    before = prefix_sums(sums, None, every.bucket(), ["__at"], {"__before": F.col("bytes")})
    return every, stored(before.select(F.col("__at").alias("__b"), F.floor(F.col("__before") / F.lit(shard_bytes)).cast("int").alias("__shard")), "shards")


def write(pages: DataFrame, root: str, *, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 1000, shard_bytes: int = 32 << 20, roll_bytes: int = 64 << 20, level: int = 6) -> list[dict]:
    """Write pages as WARC files under the folder ``root``; the manifest is returned, a row for each file."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    every, shards = _shards_by_bytes(stored(rows.select("page_id", F.octet_length("payload").cast("long").alias("bytes")), "sizes"), shard_bytes)
    digests = rows.where(F.octet_length("payload") >= min_revisit).select("page_id", F.sha1("payload").alias("digest"))
    owners = digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    marks = digests.join(owners, "digest").where("page_id < refers_to")
    lines = rows.select("page_id", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    both = lines.unionByName(marks.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to"))
    both = every.of(both).join(sized_broadcast(shards, shards.count(), 1_000_000), "__b")
    n = (shards.agg(F.max("__shard")).first()[0] or 0) + 1
    # A task for each shard, by its number: by a hash some tasks would have several.
    both = both.repartitionById(n, "__shard").sortWithinPartitions("__shard", F.col("page_id").asc_nulls_first(), "kind", F.sha1("payload"), "url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at, refers = None, None, {}
        for batch in batches:
            files = files or _Files(root, roll_bytes, level)
            for shard, page_id, kind, link, data, digest, to in zip(batch["__shard"], batch["page_id"], batch["kind"], batch["url"], batch["payload"], batch["digest"], batch["refers_to"], strict=True):
                page_id = None if pd.isna(page_id) else int(page_id)
                if page_id != at:
                    at, refers = page_id, {}
                if not kind:
                    refers[digest] = int(to)
                    continue
                data = bytes(data)
                to = refers.get(hashlib.sha1(data).hexdigest()) if refers else None
                files.add(int(shard), build_record(page_id, link, data, to))
        if files:
            files.close()
            yield pd.DataFrame(files.done, columns=["shard", "roll", "tmp", "name", "records", "bytes", "sha256"])

    made = both.select("__shard", "page_id", "kind", "url", "payload", "digest", "refers_to").mapInPandas(run, MANIFEST_SCHEMA).collect()
    return commit(root, [r.asDict() for r in made])


def commit(root: str, made: list[dict]) -> list[dict]:
    """Move finished files to their final names, write the manifest, and clear what lost attempts left."""
    fs, path = _fs(root)
    fs.create_dir(path, recursive=True)
    made = sorted(made, key=lambda r: r["name"])
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda r: fs.move(r["tmp"], f"{path}/{r['name']}"), made))
    manifest = [{k: r[k] for k in ("name", "shard", "roll", "records", "bytes", "sha256")} for r in made]
    from pyarrow.fs import FileType

    if fs.get_file_info(f"{path}/_temporary").type == FileType.Directory:
        fs.delete_dir(f"{path}/_temporary")
    with fs.open_output_stream(f"{path}/MANIFEST.json.tmp") as f:
        f.write(json.dumps(manifest, indent=1).encode())
    fs.move(f"{path}/MANIFEST.json.tmp", f"{path}/MANIFEST.json")
    return manifest


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed members of a gzip file, one at a time."""
    data = stream.read(chunk)
    while data:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not data:
                raise ValueError("truncated archive")
            parts.append(z.decompress(data))
            data = z.unused_data if z.eof else stream.read(chunk)
        yield b"".join(parts)
        data = data or stream.read(chunk)


def parse(record: bytes, payload: bool = True) -> tuple | None:
    """The row of one record; None for warcinfo. Digests are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if _digest(block) != fields["WARC-Block-Digest"] or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("damaged record")
    if fields["WARC-Type"] == "warcinfo":
        return None
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(http.decode().rpartition("Content-Length: ")[2].split("\r\n")[0])
    response = fields["WARC-Type"] == "response"
    if response and (len(body) != length or _digest(body) != fields["WARC-Payload-Digest"]):
        raise ValueError("damaged payload")
    number = lambda k: int(fields[k]) if k in fields else None
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    return number("X-Page-Id"), fields["WARC-Target-URI"], fields["WARC-Type"], number("X-Refers-To-Page-Id"), length, digest, body if response and payload else None


def read(spark: SparkSession, root: str, *, payload: bool = True, batch: int = 256) -> DataFrame:
    """The records of a committed archive; files are streamed, a record in memory at a time."""
    fs, path = _fs(root)
    with fs.open_input_stream(f"{path}/MANIFEST.json") as f:
        names = [(f"{path}/{x['name']}",) for x in json.loads(f.read())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
        for files in batches:
            for name in files["path"]:
                rows = []
                with _fs(root)[0].open_input_stream(name, compression=None) as f:
                    for record in _members(f):
                        row = parse(record, payload)
                        if row:
                            rows.append(row)
                        if len(rows) >= batch:
                            yield frame(rows)
                            rows = []
                yield frame(rows)

    files = spark.createDataFrame(names, "path string")
    return files.repartition(max(1, len(names))).mapInPandas(run, RECORD_SCHEMA)
