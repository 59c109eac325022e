"""Token ids as flat binary files.

write() orders documents by id over range partitions; each partition is one file set in the shared folder:

- part-NNNNN.bin: ids of all its documents one after another, unsigned 16-bit little-endian where the vocabulary fits,
  else 32-bit;
- part-NNNNN.idx: n + 1 unsigned 64-bit little-endian offsets, in ids, of its n documents;
- part-NNNNN.doc: n signed 64-bit document ids.

A manifest row a partition holds its counts; the prefix sums of those rows give each partition's base. read() maps the
files into memory and yields documents with their place in the whole.

Files are written under a name of their attempt and moved into place whole, so a task that runs twice or is lost
leaves a right file or none. Tasks reach the folder as pyarrow's file systems do (local or mounted paths, HDFS, object
stores); remote files are read instead of mapped.

Defined results: a null text counts as empty and has the end id alone. Null ids come first, in the order of their texts'
digests; so do rows that repeat an id. An empty table gives no files. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_words import default_path, encoder
from .shared import cut, new_folder, slices, text_or_empty


@dataclass
class TokenFiles:
    folder: str
    #: part, documents, null_ids, ids, width: one row a partition
    manifest: DataFrame


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def _writer(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path), TaskContext.get()
        fs, root = open_folder(folder)
        part, tag = task.partitionId(), task.taskAttemptId()
        if end_id >= 1 << (8 * enc.dtype.itemsize):
            raise ValueError("the end id does not fit the vocabulary's width")
        counts, nulls, doc_ids, total = [np.zeros(1, np.int64)], 0, [], 0
        out = None
        for batch in batches:
            for some in slices(batch, "text"):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/part-{part:05d}.bin.{tag}")
                ids, offsets = enc.encode(some.column(1))
                ended = np.insert(ids, offsets[1:], end_id).astype(enc.dtype.newbyteorder("<"))
                out.write(ended.tobytes())
                counts.append(np.diff(offsets) + 1)
                nulls += some.column(0).null_count
                doc_ids.append(np.asarray(some.column(0).fill_null(0), np.int64))
                total += len(ended)
        if out is None:
            return
        out.close()
        for name, data in (("idx", np.cumsum(np.concatenate(counts)).astype("<u8")), ("doc", np.concatenate(doc_ids).astype("<i8"))):
            with fs.open_output_stream(f"{root}/part-{part:05d}.{name}.{tag}") as f:
                f.write(data.tobytes())
        for name in ("bin", "idx", "doc"):
            fs.move(f"{root}/part-{part:05d}.{name}.{tag}", f"{root}/part-{part:05d}.{name}")
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, sum(map(len, doc_ids)), nulls, total, enc.dtype.itemsize)], ["part", "documents", "null_ids", "ids", "width"])

    return run


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1, folder: str | None = None, partitions: int | None = None) -> TokenFiles:
    """Writes the files now. id_col must be of an integer kind."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    digest = F.md5("text")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), digest).sortWithinPartitions(F.col("id").asc_nulls_first(), digest)
    return TokenFiles(folder, cut(placed.mapInArrow(_writer(folder, path or default_path(), end_id), "part long, documents long, null_ids long, ids long, width long")))


def bases(manifest: DataFrame) -> DataFrame:
    """The manifest with base, the ids before each partition: a prefix sum over a row a partition."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _mapped(fs: pafs.FileSystem, path: str, dtype: np.dtype) -> np.ndarray:
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read(files: TokenFiles, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per document, from the files: id, start, n_tokens, ids_crc32 and, if asked for, ids (binary, unsigned 32-bit)."""
    folder = files.folder
    n = max(1, files.manifest.count())  # rows of partitions
    tasks = bases(files.manifest).select("part", "null_ids", "width", "base").repartition(n, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{root}/part-{row['part']:05d}"
                ids, offsets, docs = _mapped(fs, f"{name}.bin", np.dtype(f"<u{row['width']}")), _mapped(fs, f"{name}.idx", np.dtype("<u8")), _mapped(fs, f"{name}.doc", np.dtype("<i8"))
                for lo in range(0, len(docs), 1000):
                    own = offsets[lo : lo + 1001].astype(np.int64)
                    each = [ids[a:b].astype("<u4").tobytes() for a, b in zip(own[:-1], own[1:], strict=True)]
                    columns = [
                        pa.array(np.asarray(docs[lo : lo + 1000]), pa.int64(), mask=np.arange(lo, lo + len(each)) < row["null_ids"]),
                        pa.array(own[:-1] + row["base"]),
                        pa.array(np.diff(own)),
                        pa.array([zlib.crc32(x) for x in each], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array(each, pa.binary())] * with_ids], [id_col, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return tasks.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
