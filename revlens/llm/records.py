"""Token ids as files of length-delimited records, with an offset index beside each file.

A record: payload length (8 bytes), masked CRC-32 of these (4), payload, masked CRC-32 of it (4), little-endian.
Payload: id flag (1), doc_id (8), bytes for each token id (1), token ids. Index: offset and length (8 each) of
each record. Ids take two bytes where the vocabulary allows it. A task writes a file under a name of its own
attempt, so that one that is repeated never meets a half-written file; what counts is the table of files that
the tasks that succeeded have returned.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import rows, tokens
from revlens.session import scratch_path, written

CHUNK = 4 << 20
FILES = "part int, file string, first_id long, docs long, ids long, bytes long"
RECORD = pa.schema([("file", pa.string()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])
RECORDS = "file string, nth long, doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"


def masked(crc: int) -> int:
    """Rotated and shifted, so that a checksum over data that holds checksums stays sound."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(zlib.crc32(length))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<BqB", doc_id is not None, doc_id or 0, width) + ids


def opened(data: bytes) -> tuple[int | None, np.ndarray]:
    there, doc_id, width = struct.unpack_from("<BqB", data)
    return (doc_id if there else None), np.frombuffer(data, f"<u{width}", offset=10)


def unframed(data: memoryview) -> Iterator[tuple[int, bytes]]:
    """(size of the frame, payload) of each whole record in ``data``; a wrong checksum is an error."""
    at = 0
    while at + 12 <= len(data):
        length, crc = struct.unpack_from("<QI", data, at)
        if masked(zlib.crc32(data[at : at + 8])) != crc:
            raise ValueError("a record's length is damaged")
        end = at + 12 + length
        if end + 4 > len(data):
            return
        own = bytes(data[at + 12 : end])
        if masked(zlib.crc32(own)) != struct.unpack_from("<I", data, end)[0]:
            raise ValueError("a record is damaged")
        yield length + 16, own
        at = end + 4


def located(spark: SparkSession, path: str) -> str:
    """The path with the scheme under which Spark itself would find it: one without a scheme lies in the default file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path with a scheme, and the path in it."""
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, parts: int | None = None) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; returns the table of files.

    A null or empty text is its end id alone. Null ids come first; rows of one id follow each other by text.
    ``folder`` must be one that all executors share; by default it lies below spark.checkpoint.dir.
    """
    spark = docs.sparkSession
    folder = located(spark, folder or scratch_path(spark, "records"))
    definition = tokens.vocabulary(spark, tokenizer)
    code = "H" if _small(definition.value) else "I"
    parts = parts or rows.partitions(spark)
    dealt, _ = rows.in_order(rows.id_text(docs), parts)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, path = store(folder)
        place.create_dir(path, recursive=True)
        context, file, found, end, width = TaskContext.get(), None, None, b"", 4
        first = docs_n = ids_n = at = 0
        for batch in (x for whole in batches for x in tokens.portions(whole, 1)):
            if file is None:
                found = tokens.words(tokens.SpacedWords, definition, code)
                width = 2 if found.code == "H" else 4
                end = np.array([end_id], f"<u{width}").tobytes()
                name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
                file, index = place.open_output_stream(f"{path}/{name}.records"), place.open_output_stream(f"{path}/{name}.index")
                part, first = batch.column(2)[0].as_py(), batch.column(0)[0].as_py()
            out, places = [], []
            for doc_id, ids in zip(batch.column(0).to_pylist(), found.ids(batch.column(1)), strict=True):
                ids += end
                frame = framed(payload(doc_id, ids, width))
                out.append(frame)
                places += (at, len(frame))
                at += len(frame)
                docs_n += 1
                ids_n += len(ids) // width
            file.write(b"".join(out))
            index.write(np.array(places, "<u8").tobytes())
        if file is not None:
            file.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "first_id": pa.array([first], pa.int64()), "docs": [docs_n], "ids": [ids_n], "bytes": [at]})

    dealt = rows.dealt_by_part(dealt, parts).sortWithinPartitions("doc_id", "text")
    files = written(rows.mapped(dealt, kept, FILES, words=True), "files")
    return files.withColumn("folder", F.lit(folder))


def _small(definition: str) -> bool:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True) <= 1 << 16


def read(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """A row for each record, from the files: nth and start count what lies before it in all files.

    Files are read in pieces of some MB, each by the task that has its row.
    """
    before = rows.running_total(rows.running_total(files, "ids", "part", "ids_before"), "docs", "part", "docs_before")
    dealt = before.select("folder", "file", "ids_before", "docs_before").repartition(rows.partitions(files.sparkSession), "file")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, name, start, nth in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                place, path = store(folder)
                with place.open_input_stream(f"{path}/{name}.records") as file:
                    rest = b""
                    while True:
                        more = file.read(CHUNK)
                        rest += more
                        out, used = [], 0
                        for size, own in unframed(memoryview(rest)):
                            doc_id, ids = opened(own)
                            wide = ids.astype("<u4")
                            out.append((name, nth, doc_id, start, len(ids), zlib.crc32(wide), wide.view("<i4") if with_ids else None))
                            start, nth, used = start + len(ids), nth + 1, used + size
                        rest = rest[used:]
                        if out:
                            yield rows.batch({f.name: [r[i] for r in out] for i, f in enumerate(RECORD)}, RECORD)
                        if not more:
                            if rest:
                                raise ValueError(f"{name} ends within a record")
                            break

    made = rows.mapped(dealt, records, RECORDS)
    return made if with_ids else made.drop("ids")


def index(files: DataFrame) -> DataFrame:
    """The offset index: folder, file, offset, length of each record."""
    dealt = files.select("folder", "file").repartition(rows.partitions(files.sparkSession), "file")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place, path = store(folder)
                with place.open_input_stream(f"{path}/{name}.index") as file:
                    while data := file.read(CHUNK):
                        at = np.frombuffer(data, "<i8").reshape(-1, 2)
                        n = len(at)
                        yield pa.RecordBatch.from_pydict({"folder": [folder] * n, "file": [name] * n, "offset": at[:, 0], "length": at[:, 1]})

    return rows.mapped(dealt, places, "folder string, file string, offset long, length long")


def read_shuffled(files: DataFrame, seed: int = 0, parts: int | None = None) -> DataFrame:
    """Records in a random order: the index is shuffled, records are then read at their offsets. Columns doc_id, ids."""
    parts = parts or rows.partitions(files.sparkSession)
    order = F.xxhash64("file", "offset", F.lit(seed))
    dealt = index(files).withColumn("order", order).repartition(parts, "order").sortWithinPartitions("order")

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, pa.NativeFile] = {}
        for batch in rows.slices(batches):
            out = []
            for folder, name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if name not in open_:
                    if len(open_) >= 64:
                        open_.pop(next(iter(open_))).close()
                    place, path = store(folder)
                    open_[name] = place.open_input_file(f"{path}/{name}.records")
                frame = open_[name].read_at(length, offset)
                doc_id, ids = opened(next(unframed(memoryview(frame)))[1])
                out.append((doc_id, ids.astype("<i4")))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapped(dealt, picked, "doc_id long, ids array<int>")


def file_paths(files: DataFrame) -> list[str]:
    """Full names of the files, in order; for small tables of files."""
    return [os.path.join(store(r["folder"])[1], r["file"] + ".records") for r in files.orderBy("part").collect()]
