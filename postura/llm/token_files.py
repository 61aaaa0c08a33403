"""Token ids in files of independent zstandard frames with a trailing seek table.

File layout, in the published seekable form of zstandard:

* data frames, each a whole number of documents' ids (little-endian, 16 bits where the vocabulary allows, else 32)
* a skippable frame with the document index: id, known flag, first value, number of values, per document
* a skippable frame with the seek table: per data frame its compressed and plain size and the low 32 bits of the XXH64
  of its plain bytes; then the number of frames, a flag byte and the closing magic number

A reader takes the tail of a file, finds a document's frame by binary search and decompresses that frame only, after its
checksum has been compared. Any zstandard tool can still read the whole file.

Files are cut by quantiles of the document id, so that they are about equal and in ascending order; a document id
never spans two files. The ids are encoded where the text is read and only ids are shuffled. Every write goes to
a name of its own and the returned manifest names the files that count, so repeated or lost tasks do no harm. Folders are
any place that Arrow's file systems reach, and are shared by all executors.

Defined cases: a null or empty text is one end id; rows with a null id come first; rows with equal ids are ordered by their
ids' bytes; an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postura.llm.common import by_value, column, small_batches, text_of
from postura.llm.files import qualified
from postura.llm.tokens import word_bpe
from postura.operators.ordered import stage, staging_path

END = 1
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Plain bytes of a frame, unless a document is longer; text bytes of a file.
FRAME_BYTES, FILE_TEXT = 1 << 18, 64 << 20
INDEX = np.dtype([("doc", "<i8"), ("known", "u1"), ("start", "<u8"), ("n", "<u8")])
TABLE = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("sum", "<u4")])
MANIFEST = "part long, path string, docs long, ids long"


def _file_system(path: str):
    """Arrow's file system for a path, and the path there."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def checksum(data: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes one file; documents come in order."""

    def __init__(self, path: str, width: int, level: int = 3):
        import zstandard

        self.path, self.width = path, width
        self.files, place = _file_system(path)
        self.files.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self.out = self.files.open_output_stream(place, compression=None)
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held, self.size, self.values = [], 0, 0
        self.index: list[tuple] = []
        self.table: list[tuple[int, int, int]] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        n = len(ids) // self.width
        self.index.append((doc or 0, doc is not None, self.values, n))
        self.values += n
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            plain = b"".join(self.held)
            packed = self.packer.compress(plain)
            self.table.append((len(packed), len(plain), checksum(plain)))
            self.out.write(packed)
            self.held, self.size = [], 0

    def close(self) -> tuple[str, int, int]:
        self._flush()
        index = struct.pack("<B", self.width) + np.array(self.index, dtype=INDEX).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = np.array(self.table, dtype=TABLE).tobytes() + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        self.out.close()
        return self.path, len(self.index), self.values


class Reader:
    """Reads one file; holds its tables and one frame."""

    def __init__(self, path: str):
        files, place = _file_system(path)
        self.file = files.open_input_file(place)
        size = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        start = size - 9 - frames * TABLE.itemsize
        self.table = np.frombuffer(self._at(start, frames * TABLE.itemsize), dtype=TABLE)
        self.offsets = np.concatenate([[0], np.cumsum(self.table["packed"], dtype=np.int64)])
        self.plain = np.concatenate([[0], np.cumsum(self.table["plain"], dtype=np.int64)])
        at = int(self.offsets[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError(f"{path} has no document index")
        body = self._at(at + 8, length)
        self.width, self.index = body[0], np.frombuffer(body, dtype=INDEX, offset=1)
        self.current: tuple[int, bytes] = (-1, b"")
        self.decompressed = 0

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def frame(self, k: int) -> bytes:
        if self.current[0] != k:
            import zstandard

            packed = self._at(int(self.offsets[k]), int(self.table["packed"][k]))
            plain = zstandard.ZstdDecompressor().decompress(packed)
            if len(plain) != self.table["plain"][k] or checksum(plain) != self.table["sum"][k]:
                raise ValueError(f"frame {k} is damaged")
            self.current = (k, plain)
            self.decompressed += 1
        return self.current[1]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        row = self.index[i]
        start, n = int(row["start"]) * self.width, int(row["n"]) * self.width
        k = int(np.searchsorted(self.plain, start, side="right")) - 1
        at = start - int(self.plain[k])
        return np.frombuffer(self.frame(k)[at:at + n], dtype=f"<u{self.width}")

    def find(self, doc: int) -> list[np.ndarray]:
        """Ids of every document with this id."""
        first = int(self.index["known"].size - self.index["known"].sum())  # rows without an id come first
        known = self.index["doc"][first:]
        lo, hi = np.searchsorted(known, doc, side="left"), np.searchsorted(known, doc, side="right")
        return [self.document(first + int(i)) for i in range(lo, hi)]


def write(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = 2,
          file_text: int = FILE_TEXT) -> DataFrame:
    """Encode every text, append the end id and write the files; returns the staged manifest (part, path, docs, ids)."""
    small_batches(df.sparkSession)
    folder = qualified(df.sparkSession, folder)  # where Spark itself would put it, not each machine's own disk
    rows = df.select(column(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    parts = max(1, -(-size // file_text), -(-n // 1_000_000))
    cuts = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    cuts = sorted(set(cuts or []))
    end = np.asarray([END], dtype=f"<u{width}").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(tokenizer)
        for batch in batches:
            docs, ids = batch.column(0), encoder.encode(batch.column(1).to_pylist())
            packed = [np.frombuffer(b, "<u4").astype(f"<u{width}").tobytes() + end for b in ids]
            part = np.searchsorted(np.array(cuts, dtype=np.int64), docs.fill_null(-2 ** 63).to_numpy(), side="left")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), docs, pa.array(packed, pa.binary())],
                                             ["part", "id", "ids"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, current = None, None

        def done():
            path, docs, ids = writer.close()
            return pa.RecordBatch.from_pylist([{"part": current, "path": path, "docs": docs, "ids": ids}],
                                              pa.schema([("part", pa.int64()), ("path", pa.string()),
                                                         ("docs", pa.int64()), ("ids", pa.int64())]))

        for batch in batches:
            for part, doc, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if part != current:
                    if writer:
                        yield done()
                    writer, current = Writer(f"{folder}/{part:06d}-{uuid.uuid4().hex}.zst", width), part
                writer.add(doc, ids)
        if writer:
            yield done()

    encoded = rows.mapInArrow(encode, "part long, id long, ids binary")
    dealt = encoded.repartitionById(len(cuts) + 1, F.col("part").cast("int")).sortWithinPartitions("part", F.col("id").asc_nulls_first(), "ids")
    return stage(dealt.mapInArrow(save, MANIFEST))


def read(manifest: DataFrame) -> DataFrame:
    """All documents of the files: part, doc_id, start (ids before it in all files), n_tokens, ids (as stored)."""
    return _read(manifest, lambda ids: ids.tobytes(), pa.binary(), "ids binary")


def digest(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
    return _read(manifest, crc, pa.int64(), "ids_crc32 long").drop("part")


def _read(manifest: DataFrame, value, kind: pa.DataType, field: str) -> DataFrame:
    small_batches(manifest.sparkSession)
    name = field.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path, base in zip(*[c.to_pylist() for c in batch.columns]):
                reader = Reader(path)
                for at in range(0, len(reader.index), 1024):
                    some = reader.index[at:at + 1024]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([part] * len(some), pa.int64()), pa.array(some["doc"], pa.int64(), mask=some["known"] == 0),
                        pa.array(some["start"].astype(np.int64) + base), pa.array(some["n"].astype(np.int64)),
                        pa.array([value(reader.document(i)) for i in range(at, at + len(some))], kind),
                    ], ["part", "doc_id", "start", "n_tokens", name])

    # one row per file, in order; then one task per file, as far as the session's partitions go
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("part", "path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "part").mapInArrow(run, f"part long, doc_id long, start long, n_tokens long, {field}")


def lookup(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of requested documents: doc_id, ids (little-endian, as stored). Only their frames are decompressed."""
    small_batches(manifest.sparkSession)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                known = (index := Reader(path).index)["doc"][index["known"] == 1]
                if len(known):
                    yield pa.RecordBatch.from_pylist([{"path": path, "low": int(known[0]), "high": int(known[-1])}])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, path = None, None
        for batch in batches:
            docs, found = [], []
            for name, doc in zip(*[c.to_pylist() for c in batch.columns]):
                if name != path:
                    reader, path = Reader(name), name
                for ids in reader.find(doc):
                    docs.append(doc)
                    found.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "ids"])

    ranges = manifest.select("path").mapInArrow(bounds, "path string, low long, high long")
    asked = wanted.select(column(id_col).cast("long").alias("doc")).where("doc is not null").distinct()
    pairs = asked.join(ranges, F.col("doc").between(F.col("low"), F.col("high"))).select("path", "doc")
    return pairs.repartition("path").sortWithinPartitions("path", "doc").mapInArrow(pick, "doc_id long, ids binary")


def new_folder(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return staging_path(spark)


by_value(__name__)
