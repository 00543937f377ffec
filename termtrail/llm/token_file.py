"""Token ids in seekable files: independent zstandard frames, a document index and a seek table.

A file holds documents in ascending order. Each document is one zstandard frame of little-endian
unsigned 32-bit ids (a very long one takes several frames), so a reader decompresses only what it
is asked for. After the frames come two skippable frames: the document index (ids, token counts,
first frame) and the seek table of the public seekable zstandard format, which holds compressed
size, raw size and an XXH64 checksum for each frame and ends with the number of frames.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtrail.llm import common, words

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
FRAME_BYTES = 1 << 22
CACHED_WORDS = 400_000
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_ENTRY = np.dtype([("packed", "<u4"), ("raw", "<u4"), ("check", "<u4")])
_INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("tokens", "<i8"), ("frame", "<i8")])


class Encoder:
    """Token ids of whole texts, as bytes; ids of words already met come from a bounded cache.

    The tokenizer never joins characters across a space or a line end, so a text's ids are those of
    its parts between them, in order. A new part that is one run of composed Latin letters, with or
    without a run of punctuation behind, needs no normaliser but lower case and goes to the
    library's model at once; all others go through the whole tokenizer. A tokenizer of another
    build, seen by a few probes, uses the whole way for all parts.
    """

    _simple = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")
    _probes = ("word", "Mixed", "\u00c9t\u00e9,", "na\u00efve!?", "\u0141\u00f3d\u017a...", "x", "THE!!", "the&&&")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        self.bytes = {b: chr(b) for b in plain}
        self.bytes |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in self.bytes)}
        self.known: dict[str, bytes] = {"": b""}
        self.runs: dict[str, bytes] = {}
        self.direct = all(self._at_once(p) == self._whole([p])[0] for p in self._probes)

    def _whole(self, parts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids)
                for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]

    def _at_once(self, part: str) -> bytes | None:
        found = self._simple.fullmatch(part)
        if found is None:
            return None
        letters, marks = found.groups()
        ids = self._run(letters.lower())
        return ids + self._run(marks) if marks else ids

    def _run(self, run: str) -> bytes:
        """Ids of a run in lower case; a word is spelled once for all marks and capitals it comes with."""
        ids = self.runs.get(run)
        if ids is None:
            spelled = run if run.isascii() else run.encode().decode("latin-1").translate(self.bytes)
            found = [t.id for t in self.library.model.tokenize(spelled)]
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(self.runs) >= CACHED_WORDS:
                self.runs.clear()
            self.runs[run] = ids
        return ids

    def _learn(self, new: list[str]) -> None:
        other = []
        for part in new:
            ids = self._at_once(part) if self.direct else None
            if ids is None:
                other.append(part)
            else:
                self.known[part] = ids
        for lo in range(0, len(other), 4096):
            self.known.update(zip(other[lo:lo + 4096], self._whole(other[lo:lo + 4096]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > CACHED_WORDS:  # short words come again more often
            self.known = {k: v for k, v in self.known.items() if len(k) < 8}
            if len(self.known) > CACHED_WORDS // 2:
                self.known = {"": b""}
        known, out, gaps = self.known, [], {}
        for text in texts:
            parts = (text or "").replace("\n", " ").split(" ")
            ids = list(map(known.get, parts))
            if None in ids:
                gaps[len(out)] = [(i, parts[i]) for i, x in enumerate(ids) if x is None]
            out.append(ids)
        self._learn(list({p for gap in gaps.values() for _, p in gap}))
        for at, gap in gaps.items():
            for i, part in gap:
                out[at][i] = known[part]
        return [b"".join(ids) for ids in out]


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer: str = TOKENIZER) -> Encoder:
    """One encoder for each Python worker and tokenizer file."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer if os.path.sep in tokenizer else public_tokenizers.path(tokenizer))
    return _encoders[tokenizer]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Writes one file; ``add`` takes documents in order, ``close`` appends index and seek table."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.zstd = sink, zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, len(ids) // 4, len(self.entries)))
        for lo in range(0, max(len(ids), 1), FRAME_BYTES):
            raw = ids[lo:lo + FRAME_BYTES]
            packed = self.zstd.compress(raw)
            self.sink.write(packed)
            self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        index = self.zstd.compress(np.array(self.docs, dtype=_INDEX).tobytes())
        table = np.array(self.entries, dtype=_ENTRY).tobytes()
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + 9) + table
                        + struct.pack("<IBI", len(self.entries), 0x80, SEEK_MAGIC))
        self.sink.close()


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError(f"{uri} has no seek table")
        start = size - 9 - frames * _ENTRY.itemsize
        self.entries = np.frombuffer(self.file.read_at(frames * _ENTRY.itemsize, start), dtype=_ENTRY)
        self.at = np.concatenate(([0], np.cumsum(self.entries["packed"], dtype=np.int64)))
        head = int(self.at[-1])
        magic, length = struct.unpack("<II", self.file.read_at(8, head))
        if magic != SKIPPABLE_INDEX:
            raise ValueError(f"{uri} has no document index")
        self.zstd = zstandard.ZstdDecompressor()
        self.docs = np.frombuffer(self.zstd.decompress(self.file.read_at(length, head + 8)), dtype=_INDEX)

    def _frame(self, i: int) -> bytes:
        raw_size = int(self.entries["raw"][i])
        packed = self.file.read_at(int(self.entries["packed"][i]), int(self.at[i]))
        raw = self.zstd.decompress(packed, max_output_size=max(raw_size, 1))
        if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.entries["check"][i]):
            raise ValueError(f"frame {i} is damaged")
        return raw

    def ids(self, i: int) -> bytes:
        """Ids of the i-th document of the file, as little-endian unsigned 32-bit integers."""
        stop = int(self.docs["frame"][i + 1]) if i + 1 < len(self.docs) else len(self.entries)
        return b"".join(self._frame(k) for k in range(int(self.docs["frame"][i]), stop))

    def find(self, doc_id: int) -> list[bytes]:
        """Ids of each row with this document id."""
        return [self.ids(int(i)) for i in np.flatnonzero((self.docs["doc_id"] == doc_id) & (self.docs["has_id"] == 1))]


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
          tokenizer: str = TOKENIZER) -> DataFrame:
    """Encodes and writes every row; returns the manifest ``(shard, file, n_docs, n_tokens)``.

    Files are shards of an id range, written under names of their own by each task attempt; only
    those in the returned manifest count, so retried or doubled tasks do no harm. Null texts are
    empty, null ids come first, repeated ids keep one entry for each row, ordered by text. An empty
    table gives an empty manifest. Further columns are not read.
    """
    _, bounds = common.shard_bounds(docs, id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       common.order_key(id_col).alias("key")).withColumn("shard", common.shard_of(F.col("key"), bounds))
    rows = (rows.repartition(common.partitions(docs.sparkSession), "shard")
            .sortWithinPartitions("shard", "key", "text").select("shard", "doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(path)
        fs.create_dir(folder, recursive=True)
        encode, end = encoder(tokenizer).encode, struct.pack("<I", END_ID)
        out = None
        made: list[tuple[int, str, int, int]] = []

        def finish() -> None:
            out.close()
            made.append((shard_now, name, len(out.docs), sum(d[2] for d in out.docs)))

        shard_now = name = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                shards, ids, texts = (c.to_pylist() for c in part.columns)
                for shard, doc_id, packed in zip(shards, ids, encode(texts), strict=True):
                    if out is None or shard != shard_now:
                        if out is not None:
                            finish()
                        shard_now = shard
                        name = f"ids-{shard:06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.zst"
                        out = Writer(fs.open_output_stream(f"{folder}/{name}", compression=None))
                    out.add(doc_id, packed + end)
        if out is not None:
            finish()
        yield pa.record_batch([pa.array(c, t) for c, t in zip(
            zip(*made) if made else ((), (), (), ()), (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)],
            ["shard", "file", "n_docs", "n_tokens"])

    made = rows.mapInArrow(words.tidy(run), "shard int, file string, n_docs bigint, n_tokens bigint")
    return common.stored(made, "manifest")


def read(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document of the manifest's files.

    ``start`` counts the ids of all documents before it: one sum for each file, then within it.
    Each task opens its own files and decompresses one document at a time.
    """
    totals = manifest.select("shard", "file", "n_tokens").collect()  # a row for each file, not for each document
    starts, before = [], 0
    for row in sorted(totals):
        starts.append((row.file, before))
        before += row.n_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = Reader(f"{path}/{file}")
                at = start + np.concatenate(([0], np.cumsum(reader.docs["tokens"])))
                for lo in range(0, len(reader.docs), 256):
                    docs = reader.docs[lo:lo + 256]
                    yield pa.record_batch([
                        pa.array(docs["doc_id"], pa.int64(), mask=docs["has_id"] == 0), pa.array(at[lo:lo + len(docs)]),
                        pa.array(docs["tokens"]), pa.array([reader.ids(lo + i) for i in range(len(docs))], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    if not starts:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(starts, "file string, start bigint")
    return files.repartition(max(1, min(len(starts), common.partitions(spark))), "file").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "ids")
    manifest = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

