"""Token ids in files of independent zstandard frames.

A file is a row of zstandard frames, each with its own checksum; then one skippable frame, the directory (each document's
id and number of token ids); then the seek table of the public seekable format, again a skippable frame: compressed size,
size and checksum of every frame before it. Any zstandard tool can decompress the whole file. A reader takes the seek table from
the end of the file, the directory next, and then only the frames that hold the documents it wants.

Payload of a frame: token ids as little-endian unsigned 32-bit integers, document after document. A frame ends with the
document that brings it to ``frame_ids`` ids or more; a longer document has a frame to itself, or several.

Tables go to files by ranges of ascending document id (null first), so files in order, and documents in file order, are the
documents in ascending order. Every file is written under a name of its attempt; only names that a finished task
reported are in the manifest, so lost executors and second attempts leave nothing that a reader would see.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logweir.llm.common import Batches, batch
from logweir.llm.tokens import default_tokenizer, encoder

# Fixed values of the zstandard seekable format.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

FRAME_IDS = 65_536
FILE_BYTES = 64 << 20
END_ID = 2

MANIFEST = "file string, part int, documents long, ids long"
_DIRECTORY = struct.Struct("<Q")


class FileWriter:
    """Writes one file to an open binary stream. Holds one frame and the directory: 13 bytes a document."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 3) -> None:
        self.out, self.frame_bytes = out, 4 * frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.waiting: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int, int]] = []
        self.keys: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids) // 4)
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._frame()
        for at in range(0, len(ids), self.frame_bytes):
            part = ids[at : at + self.frame_bytes]
            self.waiting.append(part)
            self.size += len(part)
            if self.size >= self.frame_bytes:
                self._frame()

    def _frame(self) -> None:
        if self.size:
            payload = b"".join(self.waiting)
            data = self.zstd.compress(payload)
            self.out.write(data)
            self.frames.append((len(data), len(payload), xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF))
            self.waiting, self.size = [], 0

    def close(self) -> None:
        self._frame()
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        nulls = np.array([k is None for k in self.keys], np.uint8)
        body = _DIRECTORY.pack(len(keys)) + keys.tobytes() + np.array(self.lengths, "<u8").tobytes() + nulls.tobytes()
        body = zstandard.ZstdCompressor(write_checksum=True).compress(body)
        self._skippable(SKIPPABLE, body)
        # in the seek table the directory counts as a frame without content
        self.frames.append((len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        self._skippable(SEEK_TABLE, entries + struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEKABLE))

    def _skippable(self, magic: int, body: bytes) -> None:
        self.out.write(struct.pack("<II", magic, len(body)))
        self.out.write(body)


@dataclass
class Entry:
    key: int | None
    start: int
    length: int


class FileReader:
    """Reads documents from a seekable stream of known size; decompresses only the frames that hold them."""

    def __init__(self, stream, size: int) -> None:
        self.stream = stream
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & HAS_CHECKSUMS:
            raise ValueError("the file has no seek table with checksums")
        table = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.table = table[:-1]
        self.file_at = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.ids_at = np.concatenate(([0], np.cumsum(self.table[:, 1]))) // 4
        body = self._at(int(self.file_at[-2]), int(table[-1, 0]))
        body = zstandard.ZstdDecompressor().decompress(body[8:])
        (n,) = _DIRECTORY.unpack_from(body)
        keys = np.frombuffer(body, "<i8", n, 8)
        lengths = np.frombuffer(body, "<u8", n, 8 + 8 * n).astype(np.int64)
        nulls = np.frombuffer(body, np.uint8, n, 8 + 16 * n)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        self.entries = [Entry(None if x else int(k), int(s), int(m)) for k, x, s, m in zip(keys, nulls, starts, lengths, strict=False)]
        self._last: tuple[int, bytes] | None = None

    def _at(self, start: int, size: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(size)

    def _frame(self, i: int) -> bytes:
        if self._last is None or self._last[0] != i:
            packed, size, checksum = self.table[i]
            payload = zstandard.ZstdDecompressor().decompress(self._at(int(self.file_at[i]), int(packed)), max_output_size=int(size))
            if xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {i} does not match its checksum")
            self._last = (i, payload)
        return self._last[1]

    def ids(self, entry: Entry) -> bytes:
        """The document's ids, as they were added."""
        out, at, end = [], entry.start, entry.start + entry.length
        i = int(np.searchsorted(self.ids_at, at, "right")) - 1
        while at < end:
            base, stop = int(self.ids_at[i]), min(end, int(self.ids_at[i + 1]))
            out.append(self._frame(i)[4 * (at - base) : 4 * (stop - base)])
            at, i = stop, i + 1
        return b"".join(out)


def write(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode whole texts (null: empty) and write them below ``path`` in ascending order of ``key``.

    ``path``: a folder of any file system that pyarrow opens by its address and every executor reaches. Returns the
    manifest (file, part, documents, ids), stored beside the files. Rows with equal keys are ordered by text. Other columns are
    not read; an empty table gives an empty manifest.
    """
    spark, tokenizer = df.sparkSession, tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    bytes_ = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // file_bytes))
    schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64())])

    def save(batches: Batches) -> Batches:
        part, writer, out, name = TaskContext.get().partitionId(), None, None, ""
        for b in batches:
            if writer is None:
                name = f"part-{part:05d}-{uuid.uuid4().hex}.zst"
                fs, folder = pafs.FileSystem.from_uri(path)
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                writer = FileWriter(out, frame_ids)
            for k, ids in zip(b["key"].to_pylist(), encoder(tokenizer).encode(b["text"].to_pylist()), strict=True):
                writer.add(k, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            yield batch(schema, [name], [part], [len(writer.keys)], [sum(writer.lengths)])

    placed = rows.repartitionByRange(files, F.col("key").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    placed.mapInArrow(save, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _entries(path: str, files: Iterable[str]) -> Iterator[tuple[str, FileReader]]:
    fs, folder = pafs.FileSystem.from_uri(path)
    for name in files:
        size = fs.get_file_info(f"{folder}/{name}").size
        with fs.open_input_file(f"{folder}/{name}") as stream:
            yield name, FileReader(stream, size)


def read_documents(path: str, file: str, keys: set[int | None]) -> dict[int | None, list[np.ndarray]]:
    """The ids of the wanted documents of one file, without touching frames that hold none of them."""
    out: dict[int | None, list[np.ndarray]] = {}
    for _, reader in _entries(path, [file]):
        for entry in reader.entries:
            if entry.key in keys:
                out.setdefault(entry.key, []).append(np.frombuffer(reader.ids(entry), "<u4"))
    return out


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Read all files back: key, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    based = manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def load(batches: Batches) -> Batches:
        for b in batches:
            base = dict(zip(b["file"].to_pylist(), b["base"].to_pylist(), strict=True))
            for name, reader in _entries(path, base):
                for at in range(0, len(reader.entries), 4096):
                    part = reader.entries[at : at + 4096]
                    yield batch(schema, [e.key for e in part], [base[name] + e.start for e in part], [e.length for e in part], [zlib.crc32(reader.ids(e)) for e in part])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(parts, "file").mapInArrow(load, "key long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)

