"""Token-ID / binary output: length-delimited records with masked checksums, and an offset index.

A record is a length (8 bytes), the masked crc32 of those bytes (4), the payload, and the masked
crc32 of the payload (4), all little-endian. The payload is a header (doc_id 8 bytes, number of ids
8, bytes of an id 8) and the ids. Each file of records has an index file beside it, with one entry
(doc_id, offset, number of ids) of 3 x 8 bytes a record, so a reader may take records in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.llm.common import shared_path, written
from placeloom.llm.tokenizing import encoder, small_batches, with_end

END = 2
#: A file is closed at this size.
FILE_BYTES = 32_000_000
#: Files that a task of a shuffled read has open at most.
OPEN_FILES = 64


def masked(data: bytes) -> int:
    """crc32, rotated and shifted, so that a checksum over data that holds checksums stays sound."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def record(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One framed record; a null doc_id is written as the least long."""
    payload = struct.pack("<qqq", -(1 << 63) if doc_id is None else doc_id, len(ids), ids.itemsize) + ids.astype(ids.dtype.newbyteorder("<")).tobytes()
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def read_record(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids and end of the record at `at`; a ValueError if a checksum is wrong."""
    size = bytes(data[at : at + 8])
    if len(size) < 8 or masked(size) != struct.unpack_from("<I", data, at + 8)[0]:
        raise ValueError(f"the length of the record at {at} is damaged")
    end = at + 12 + struct.unpack("<Q", size)[0]
    payload = data[at + 12 : end]
    if len(data) < end + 4 or masked(payload) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError(f"the record at {at} is damaged")
    doc_id, n, width = struct.unpack_from("<qqq", payload)
    return None if doc_id == -(1 << 63) else doc_id, np.frombuffer(payload, f"<u{width}", n, 24), end + 4


def write_records(docs: DataFrame, folder: str, vocabulary: str, end: int = END, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the documents' ids into `folder` in ascending doc_id order; returns the manifest.

    The manifest (part, file, records, tokens) lists the files in order; it is written too, and a file
    counts only if it lists it: what a lost or repeated task has left is never read. Files are
    written through the file system of the folder's URI.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        out, index, part, number = None, [], 0, 0
        done: list[tuple] = []

        def close() -> None:
            nonlocal out, number
            if out is not None:
                out.close()
                with store.open_output_stream(f"{path}/{name}.idx") as x:
                    x.write(np.array(index, "<i8").tobytes())
                done.append((part, number, f"{name}.rec", len(index), sum(x[2] for x in index)))
                out, number = None, number + 1
                index.clear()

        name, size = "", 0
        for batch in small_batches(batches):
            part = batch.column("part")[0].as_py()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), with_end(*encoder(vocabulary).encode(batch.column("text")), end), strict=True):
                if out is None:
                    name, size = f"part-{part:06d}-{number:04d}-{uuid.uuid4().hex}", 0
                    out = store.open_output_stream(f"{path}/{name}.rec")
                data = record(doc_id, ids)
                out.write(data)
                index.append((-(1 << 63) if doc_id is None else doc_id, size, len(ids)))
                size += len(data)
                if size >= file_bytes:
                    close()
        close()
        columns = list(zip(*done, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "number", "file", "records", "tokens"])

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    # equal and null ids are spread too
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    ordered = ordered.repartitionByRange("doc_id", F.col("row")).sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    ordered = ordered.withColumn("part", F.spark_partition_id().cast("long"))
    return written(ordered.mapInArrow(run, "part long, number long, file string, records long, tokens long"), "manifest")


def opened(folder: str):
    """A function that opens a file of the folder for reading at any place."""
    store, path = fs.FileSystem.from_uri(folder)
    return lambda name: store.open_input_file(f"{path}/{name}")


def record_at(source, at: int) -> tuple[int | None, np.ndarray, int]:
    """Like read_record, from an open file; only the one record is held."""
    head = source.read_at(12, at)
    if len(head) < 12 or masked(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
        raise ValueError(f"the length of the record at {at} is damaged")
    size = struct.unpack("<Q", head[:8])[0]
    doc_id, ids, end = read_record(memoryview(head + source.read_at(size + 4, at + 12)), 0)
    return doc_id, ids, at + end


_FACTS = "file string, place long, doc_id long, start long, n_tokens long, ids_crc32 long"


def _facts(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 5), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["file", "place", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """(file, place, doc_id, start, n_tokens, ids_crc32) of all records in the manifest's files.

    manifest: file, and shift, the ids in all files before it. place is the record's number in its file, start
    counts the ids before it. A task reads its files record by record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file = opened(folder)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("shift").to_pylist(), strict=True):
                at, place, rows = 0, 0, []
                with open_file(file) as source:
                    while at < source.size():
                        doc_id, ids, at = record_at(source, at)
                        rows.append((file, place, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4"))))
                        place, start = place + 1, start + len(ids)
                        if len(rows) == 4096:
                            yield _facts(rows)
                            rows = []
                yield _facts(rows)

    # a stated number, for rows as small as these would be gathered in one task
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "shift").repartition(parts).mapInArrow(run, _FACTS)


def record_index(manifest: DataFrame, folder: str) -> DataFrame:
    """(file, place, doc_id, offset, n_tokens) of all records, from the index files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file = opened(folder)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with open_file(file.replace(".rec", ".idx")) as source:
                    rows = np.frombuffer(source.read(), "<i8").reshape(-1, 3)
                ids = pa.array(rows[:, 0], mask=rows[:, 0] == -(1 << 63))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(np.arange(len(rows))), ids, pa.array(rows[:, 1]), pa.array(rows[:, 2])], names=["file", "place", "doc_id", "offset", "n_tokens"])

    return manifest.select("file").mapInArrow(run, "file string, place long, doc_id long, offset long, n_tokens long")


def read_shuffled(index: DataFrame, folder: str, seed: int) -> DataFrame:
    """The records of index entries in an order shuffled by `seed`: (at, file, place, doc_id, ids), at being the place in that order.

    Entries are dealt by the range of a hash; each record is then read by its offset alone. A task opens a
    file once, and holds one record at a time.
    """
    key = F.xxhash64(F.lit(seed), "file", "place")
    dealt = index.select("file", "place", "offset", key.alias("at")).repartitionByRange("at").sortWithinPartitions("at", "file", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file, sources = opened(folder), {}
        for batch in batches:
            for at, file, place, offset in zip(*(batch.column(c).to_pylist() for c in ("at", "file", "place", "offset")), strict=True):
                if file not in sources:
                    if len(sources) == OPEN_FILES:
                        sources.pop(next(iter(sources))).close()
                    sources[file] = open_file(file)
                doc_id, ids, _ = record_at(sources[file], offset)
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([file]), pa.array([place]), pa.array([doc_id], pa.int64()), pa.array([ids.astype(np.int64)])], names=["at", "file", "place", "doc_id", "ids"])

    return dealt.mapInArrow(run, "at long, file string, place long, doc_id long, ids array<long>")


def token_index(docs: DataFrame, folder: str, vocabulary: str, end: int = END) -> DataFrame:
    """Writes the records of docs and reads them back: doc_id, start, n_tokens and ids_crc32 of each.

    start counts the ids of all documents before it in doc_id order. Null and empty texts are a record
    with the end id alone; a null doc_id comes first; repeated ids keep a record each, in no set order. An
    empty table writes no file and gives an empty result. Other columns are ignored.
    """
    manifest = write_records(docs, folder, vocabulary, end)
    # one row a file
    ahead = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("shift"))
    return read_records(files, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_index(docs, shared_path(spark, "records"), public_tokenizers.path("byte_bpe_50k.json"))
