"""WARC archives with an index merged from sorted runs.

write() settles which record of equal payloads is the response, writes one gzip-per-record WARC file a partition into
the shared folder and, with it, an index run sorted by URL key and timestamp. The runs meet in range partitions of
(URL key, timestamp, id); each merge task joins the sorted pieces of all runs with a loser tree, so the index is one
globally ordered history of captures. read() follows the index back into the archives and checks each payload's digest.

Files are written under a name of their attempt and moved into place whole.

Defined results: a null payload counts as empty. Of at least `least` bytes and equal payloads, records with the largest
id are responses and the others revisit it; a null id loses to any other, and where all are null all are responses. Null
urls have the empty key and no Target-URI; control characters in urls are percent-encoded. A null timestamp counts as
the epoch. Repeated rows give repeated records. An empty table gives an empty index and no files. Other columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, new_folder, row_key, text_or_empty
from .token_files import open_folder

INDEX = "url_key string, ts timestamp, page_id long, run int, seq long, file string, start long, size long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = "urn:tidewater:page:"


@dataclass
class Archive:
    folder: str
    #: INDEX's columns, globally ordered by url_key, ts, page_id over its partitions
    index: DataFrame


def url_key(url: str | None) -> str:
    """Host labels reversed, then the rest without its fragment: example.org/a becomes org,example)/a."""
    m = re.match(r"(?s)(?:[^:/?#]*:)?//(?:[^@/?#]*@)?([^/?#]*)([^#]*)", url or "")
    if not m:
        return (url or "").lower()
    host = re.sub(r":\d*$", "", m[1].lower()).removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}){m[2] or '/'}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(row: dict) -> bytes:
    """One WARC record of page_id, url, ts, payload (bytes), refers_to, revisit."""
    payload, revisit = row["payload"], row["revisit"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<{_NAME}{'' if i is None else i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(row['page_id'])}",
        f"WARC-Date: {row['ts'].astimezone(UTC).strftime('%Y-%m-%dT%H:%M:%S.%fZ')}",
        *([f"WARC-Target-URI: {re.sub('[\\x00-\\x20\\x7f]', lambda c: f'%{ord(c[0]):02X}', row['url'])}"] if row["url"] is not None else []),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(row['refers_to'])}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers of a record, its payload (None for a revisit) and the payload's length."""
    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = body[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda field: int(x) if (x := fields.get(field, "<>")[len(_NAME) + 1 : -1]) else None
    revisit = fields["WARC-Type"] == "revisit"
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": size, "refers_to": number("WARC-Refers-To") if revisit else None, "payload": None if revisit else payload}


#: Index rows of a range of the merge on average, which bounds what one task holds.
RANGE_ROWS = 1 << 19


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        task = TaskContext.get()
        part, out, at, entries = task.partitionId(), None, 0, []
        name = f"captures-{part:05d}.warc.gz"
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                for row in batch.slice(lo, 200).to_pylist():
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}.{task.taskAttemptId()}")
                    row["payload"] = row["payload"].encode()
                    packer = zlib.compressobj(1, wbits=31)
                    data = packer.compress(record(row)) + packer.flush()
                    out.write(data)
                    entries.append((url_key(row["url"]), row["ts"], row["page_id"], at, len(data)))
                    at += len(data)
        if out is None:
            return
        out.close()
        fs.move(f"{root}/{name}.{task.taskAttemptId()}", f"{root}/{name}")
        entries.sort(key=lambda e: (e[0].encode(), e[1], e[2] is not None, e[2] or 0))
        for lo in range(0, len(entries), 10_000):
            some = entries[lo : lo + 10_000]
            n = len(some)
            columns = [pa.array([e[0] for e in some]), pa.array([e[1] for e in some], pa.timestamp("us", "UTC")), pa.array([e[2] for e in some], pa.int64()), pa.array([part] * n, pa.int32()), pa.array(range(lo, lo + n), pa.int64()), pa.array([name] * n), pa.array([e[3] for e in some], pa.int64()), pa.array([e[4] for e in some], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["url_key", "ts", "page_id", "run", "seq", "file", "start", "size"])

    return run


def merge(runs: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """(run, place) of all entries of sorted runs in order; a loser tree of the runs' next entries: one comparison a level."""
    k = len(runs)
    place = [0] * k
    after = (1,)  # greater than any (0, entry)
    key = lambda r: (0, runs[r][place[r]], r) if place[r] < len(runs[r]) else after
    losers, keys = [-1] * k, [key(r) for r in range(k)]

    def play(r: int) -> int:
        """Lets run r climb; what it meets at an empty node waits there, what beats it climbs on."""
        node = (r + k) // 2
        while node:
            other = losers[node]
            if other < 0:
                losers[node] = r
                return -1
            if keys[other] < keys[r]:
                losers[node], r = r, other
            node //= 2
        return r

    winner = 0 if k == 1 else next((w for w in [play(r) for r in range(k)] if w >= 0), -1)
    while winner >= 0 and keys[winner] is not after:
        yield winner, place[winner]
        place[winner] += 1
        keys[winner] = key(winner)
        winner = play(winner) if k > 1 else winner


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range partition, run by run in their order, to rows in global order."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    run = table.column("run").to_pylist()
    keys = [(k.encode(), t, p is not None, p or 0) for k, t, p in zip(table.column("url_key").to_pylist(), table.column("ts").to_pylist(), table.column("page_id").to_pylist(), strict=True)]
    starts = [i for i in range(len(run)) if i == 0 or run[i] != run[i - 1]]
    runs = [keys[a:b] for a, b in zip(starts, [*starts[1:], len(run)], strict=True)]
    order = [starts[r] + i for r, i in merge(runs)]
    yield from table.take(pa.array(order, pa.int64())).to_batches(max_chunksize=10_000)


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ts: Column | None = None, least: int = 0, folder: str | None = None) -> Archive:
    """Writes the archives and merges their index now."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    when = F.coalesce(ts.cast("timestamp") if ts is not None else F.lit(None).cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), when.alias("ts"), text_or_empty(payload_col).alias("payload"), row_key(id_col, payload_col).alias("key"))
    marks = cut(rows.select("key", "page_id", F.sha1(F.col("payload").cast("binary")).alias("sha"), F.octet_length("payload").alias("n")))
    groups = cut(marks.where(F.col("n") >= least).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("m")).where("m > 1").select("sha", "refers_to"))
    revisits = marks.where(F.col("n") >= least).join(groups.hint("merge"), "sha").where("not page_id <=> refers_to").select("key", "refers_to", F.lit(True).alias("revisit")).dropDuplicates(["key"])
    settled = rows.join(revisits.hint("merge"), "key", "left").select("page_id", "url", "ts", "payload", "refers_to", F.coalesce("revisit", F.lit(False)).alias("revisit"))
    runs = cut(settled.mapInArrow(_writer(folder), INDEX))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    ranged = runs.repartitionByRange(n, "url_key", "ts", F.col("page_id").asc_nulls_first(), "run", "seq").sortWithinPartitions("run", "seq")
    return Archive(folder, cut(ranged.mapInArrow(_merged, INDEX)))


def read(archive: Archive, with_payload: bool = True) -> DataFrame:
    """One row per record, from the files: page_id, url, record_type, payload_digest, payload_bytes, refers_to and, if asked for, payload (null for revisits)."""
    folder = archive.folder
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        name, f = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                rows = []
                for entry in batch.slice(lo, 200).to_pylist():
                    if entry["file"] != name:
                        if f is not None:
                            f.close()
                        name, f = entry["file"], fs.open_input_file(f"{root}/{entry['file']}")
                    rows.append(parse(zlib.decompress(f.read_at(entry["size"], entry["start"]), wbits=31)))
                    if rows[-1]["payload"] is not None and payload_digest(rows[-1]["payload"]) != rows[-1]["payload_digest"]:
                        raise ValueError(f"{name} at {entry['start']}: the payload does not have its digest")
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=False)], names)

    # a fixed number: the index is small beside its archives, so partitions must not be merged by their size
    n = int(archive.index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = archive.index.select("file", "start", "size").repartition(n, "file").sortWithinPartitions("file", "start")
    return placed.mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary" * with_payload)
