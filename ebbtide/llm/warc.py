"""WARC archives with a two-level capture index: write, look up by URL, read back by range.

Records are gzip members one after another.  The index lines (reversed-host key, capture, archive, offset,
length) are sorted over all archives, cut into shards and inside a shard into compressed blocks; the
directory of a shard has the first key of every block and is sparse.  A lookup goes to the shard of its
key range, finds the block in the directory by binary search, reads that block, finds its lines by binary
search, and reads the records at their ranges.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import posixpath
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import saved
from ebbtide.session import scratch_path, ship_package

#: Lines of an index block, lines of an index shard, and bytes between records that are read in one go.
BLOCK_LINES, SHARD_LINES, GAP = 500, 500_000, 1 << 16
#: Bytes of one read at most, but for a longer record.
SPAN = 4 << 20
DATE = "2000-01-01T00:00:00Z"
ENTRY = "surt string, page_id long, archive string, offset long, length long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a folder named by a URI or a plain path."""
    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9+.-]+:", path) else f"file://{path}")


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, without scheme, ``www``, default port and fragment; lower-case host."""
    if not url:
        return ")/"
    parts = urlsplit(url if "//" in url else f"//{url}")
    host = parts.netloc.rpartition("@")[2].lower()
    host, _, port = host.partition(":")
    host = re.sub(r"^www\d*\.", "", host)
    tail = f":{port}" if port and port not in ("80", "443") else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{tail}){parts.path or '/'}{query}"


def _safe_surt(url: str | None) -> str:
    try:
        return surt(url)
    except ValueError:  # no valid URL: kept under its own text
        return f"!{url}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None, size: int) -> bytes:
    """One gzip member; a revisit carries the headers of the response alone."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {json.dumps(url)[1:-1]}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 5, mtime=0)


def parse_record(member: bytes) -> dict:
    """Fields of a record read back; the payload digest of a response is worked out from its bytes."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != stated):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = re.compile(r"<urn:page:(.*)>")
    target = fields.get("WARC-Refers-To")
    own = number.match(fields["WARC-Record-ID"])[1]
    return {
        "page_id": None if own == "None" else int(own),
        "url": json.loads(f'"{fields["WARC-Target-URI"]}"'),
        "payload_bytes": size,
        "payload_digest": stated,
        "record_type": fields["WARC-Type"],
        "refers_to": int(number.match(target)[1]) if target else None,
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def plan_records(pages: DataFrame, key: str, url: str, html: str, least: int) -> DataFrame:
    """``page_id``, ``url``, ``html``, ``refers_to``: of equal payloads of ``least`` bytes or more, that with the largest id is the response."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    sized = rows.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("sha"), F.octet_length("html").alias("size"))
    groups = (
        sized.where(F.col("size") >= least)
        .groupBy("sha", "size")
        .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .drop("n")
    )
    # Only payloads that occur again are looked up; a payload that fills a third of the rows is one row here.
    found = rows.withColumns({"sha": F.sha1(F.encode("html", "UTF-8")), "size": F.octet_length("html")}).join(
        groups, ["sha", "size"], "left"
    )
    refers = F.when((F.col("last") != F.col("page_id")) | F.col("page_id").isNull(), F.col("last"))
    return found.select("page_id", "url", "html", refers.alias("refers_to"))


@dataclass(frozen=True)
class Archive:
    """Where the archives and the index of one run lie."""

    folder: str
    directory: DataFrame  # shard, least, most: key range and file of every index shard


def write_archive(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0,
    block_lines: int = BLOCK_LINES, shard_lines: int = SHARD_LINES,
) -> Archive:
    """Write a record per row and the index.  A file is named by its task attempt, and only files of attempts that
    counted are in the index, so a task that ran again leaves no second record."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, base = _open(folder)
        name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        system.create_dir(base, recursive=True)
        offset = 0
        with system.open_output_stream(posixpath.join(base, name), compression=None) as out:
            for batch in batches:
                lines = []
                for page, address, text, target in batch.itertuples(index=False):
                    page = None if pd.isna(page) else int(page)
                    address = address if isinstance(address, str) else ""
                    payload = text.encode("utf-8", "surrogatepass")
                    member = record(page, address, payload, payload_digest(payload), None if pd.isna(target) else int(target), len(payload))
                    out.write(member)
                    lines.append((_safe_surt(address), page, name, offset, len(member)))
                    offset += len(member)
                yield pd.DataFrame(lines, columns=["surt", "page_id", "archive", "offset", "length"]).astype({"page_id": "Int64"})

    ship_package(pages.sparkSession)
    planned = plan_records(pages, key, url, html, least)
    # The lines are written down before they are sorted: the archives are written once.
    lines = saved(planned.mapInPandas(write, ENTRY))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, base = _open(folder)
        name = f"index-{context.partitionId():06d}-{context.taskAttemptId()}"
        blocks, held, size = [], [], 0
        low = high = None

        def flush(out) -> None:
            nonlocal size
            packed = zlib.compress(json.dumps(held, ensure_ascii=False).encode("utf-8", "surrogatepass"))
            out.write(packed)
            blocks.append([held[0][0], size, len(packed)])
            size += len(packed)
            held.clear()

        out = None
        for batch in batches:
            for line in batch.itertuples(index=False):
                if out is None:
                    low = line[0]
                    out = system.open_output_stream(posixpath.join(base, name), compression=None)
                high = line[0]
                held.append([line[0], None if pd.isna(line[1]) else int(line[1]), line[2], int(line[3]), int(line[4])])
                if len(held) >= block_lines:
                    flush(out)
        if out is None:
            return
        if held:
            flush(out)
        out.close()
        with system.open_output_stream(posixpath.join(base, f"{name}.dir"), compression=None) as directory:
            directory.write(json.dumps(blocks, ensure_ascii=False).encode("utf-8", "surrogatepass"))
        yield pd.DataFrame({"shard": [name], "least": [low], "most": [high]})

    spread = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(spread, -(-lines.count() // shard_lines))
    # Equal keys may be split between shards by the capture, so a URL with very many captures fills no task.
    ordered = lines.repartitionByRange(shards, "surt", "page_id").sortWithinPartitions("surt", "page_id")
    return Archive(folder, saved(ordered.mapInPandas(index, "shard string, least string, most string")))


class ShardReader:
    """Lookups in one index shard: the directory is held, blocks are read when asked for."""

    def __init__(self, system: fs.FileSystem, base: str, name: str) -> None:
        with system.open_input_stream(posixpath.join(base, f"{name}.dir"), compression=None) as source:
            self.blocks = json.loads(source.read().decode("utf-8", "surrogatepass"))
        self.first = [b[0] for b in self.blocks]
        self.file = system.open_input_file(posixpath.join(base, name))
        self.at, self.lines, self.keys = -1, [], []

    def block(self, number: int) -> None:
        if number != self.at:
            _, offset, length = self.blocks[number]
            self.file.seek(offset)
            self.lines = json.loads(zlib.decompress(self.file.read(length)).decode("utf-8", "surrogatepass"))
            self.at, self.keys = number, [line[0] for line in self.lines]

    def find(self, key: str) -> list[list]:
        """All lines of a key; they may begin in the block before the first that starts with it."""
        out = []
        for number in range(max(0, bisect_left(self.first, key) - 1), bisect_right(self.first, key)):
            self.block(number)
            out += self.lines[bisect_left(self.keys, key) : bisect_right(self.keys, key)]
        return out


def read_records(lines: pd.DataFrame, system: fs.FileSystem, base: str) -> Iterator[dict]:
    """Records at the given ranges, archive by archive; near ones are read together."""
    for name, part in lines.sort_values(["archive", "offset"]).groupby("archive", sort=False):
        with system.open_input_file(posixpath.join(base, name)) as source:
            held: list[tuple[int, int]] = []

            def drain() -> Iterator[dict]:
                low = held[0][0]
                source.seek(low)
                data = source.read(held[-1][0] + held[-1][1] - low)
                for offset, length in held:
                    yield parse_record(data[offset - low : offset - low + length])

            for offset, length in zip(part["offset"], part["length"], strict=True):
                if held and (offset - sum(held[-1]) > GAP or offset + length - held[0][0] > SPAN):
                    yield from drain()
                    held = []
                held.append((int(offset), int(length)))
            if held:
                yield from drain()


FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def look_up(archive: Archive, urls: DataFrame, url: str = "url", payload: bool = False) -> DataFrame:
    """All captures of the given URLs, read back from the archives (``FIELDS``, and ``payload`` if asked for).

    Every URL is looked up once, however often it is given; URLs without capture give no row.  The shards of a
    URL's key come from the key ranges (one row per shard); the work is spread over tasks by shard and key.
    """
    ship_package(urls.sparkSession)
    folder, directory = archive.folder, archive.directory
    schema = FIELDS + (", payload binary" if payload else "")

    @F.pandas_udf("string")
    def key_of(address: pd.Series) -> pd.Series:
        return address.map(_safe_surt)

    # One row per index file (of up to SHARD_LINES captures); ranges are in order and may touch at their ends.
    ranges = sorted((r["least"], r["most"], r["shard"]) for r in directory.collect())
    shared = urls.sparkSession.sparkContext.broadcast(([r[0] for r in ranges], [r[1] for r in ranges], [r[2] for r in ranges]))

    @F.pandas_udf("array<string>")
    def shards_of(keys: pd.Series) -> pd.Series:
        least, most, names = shared.value
        return keys.map(lambda key: names[bisect_left(most, key) : bisect_right(least, key)])

    wanted = urls.select(key_of(F.coalesce(F.col(url), F.lit(""))).alias("surt")).distinct()
    placed = wanted.select("surt", F.explode(shards_of("surt")).alias("shard"))
    placed = placed.repartitionByRange("shard", "surt").sortWithinPartitions("shard", "surt")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _open(folder)
        reader, name = None, None
        for batch in batches:
            lines = []
            for key, shard in batch[["surt", "shard"]].itertuples(index=False):
                if shard != name:
                    reader, name = ShardReader(system, base, shard), shard
                lines += reader.find(key)
            found = pd.DataFrame(lines, columns=["surt", "page_id", "archive", "offset", "length"])
            held, size = [], 0
            for row in read_records(found, system, base):
                size += len(row["payload"] or b"") if payload else 0
                if not payload:
                    del row["payload"]
                held.append(row)
                if len(held) >= 2000 or size > SPAN:
                    yield _frame(held)
                    held, size = [], 0
            if held:
                yield _frame(held)

    return placed.mapInPandas(read, schema)


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})


def archive_and_read_back(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write all pages, then read every record back through the index.

    A NULL html is an empty payload, a NULL url an empty one, a NULL page_id is never the largest.  Repeated rows get a record each; those that
    carry the largest id of their payload are all responses.  Other columns are not looked at; an empty
    frame gives an empty result.  The folder must be one that all executors share.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    archive = write_archive(pages, folder, key, url, html, least)
    return look_up(archive, pages, url).drop("url")
