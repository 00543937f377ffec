"""Documents packed into compressed batches, and hash exchanges between batches and buckets.

A pack is one row ``(batch, blob)``: some megabytes of whole rows in Arrow IPC with zstandard. The
packed table is written once to shared storage, so a batch keeps its number however often tasks are
retried, and later passes shuffle compressed packs instead of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from termtrail.llm import common, words

PACK_BYTES = 4 << 20
BUCKET_HASHES = 1 << 21


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(batch, n_words, blob)``; the rows of a batch are in ascending order of (id, text).

    Every column of ``docs`` is kept. Null ids come first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = context.partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            table = pa.Table.from_batches(held)
            keys = pa.table({"i": table[id_col].cast(pa.int64()).fill_null(common.LOWEST), "t": table[text_col].fill_null("")})
            table = table.take(pc.sort_indices(keys, sort_keys=[("i", "ascending"), ("t", "ascending")]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.combine_chunks())
            data, offsets = words.text_bytes(table[text_col])
            solid = ~words.SPACE[data]
            n = int(np.count_nonzero(solid[1:] & ~solid[:-1])) + len(offsets)
            batch = pa.record_batch([pa.array([number]), pa.array([n]), pa.array([sink.getvalue().to_pybytes()])],
                                    ["batch", "n_words", "blob"])
            number, held, size = number + 1, [], 0
            return batch

        for batch in batches:
            _, offsets = words.text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PACK_BYTES - size, side="right")) - 1)
                held.append(batch.slice(lo, hi - lo))
                size += int(offsets[hi] - offsets[lo])
                lo = hi
                if size >= PACK_BYTES // 2 and (size >= PACK_BYTES or lo < batch.num_rows):
                    yield flush()
        if held:
            yield flush()

    return common.stored(docs.mapInArrow(words.tidy(run), "batch bigint, n_words bigint, blob binary"), "packs")


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def bucket_bits(packed: DataFrame) -> int:
    """Bits of a hash that name its bucket, so that a bucket gets about ``BUCKET_HASHES`` of them."""
    total = packed.agg({"n_words": "sum"}).first()[0] or 0
    return max(2, int(total // BUCKET_HASHES).bit_length())


def bucket_edges(sorted_values: np.ndarray, value_bits: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur among sorted values of ``value_bits`` bits, and where each begins and ends."""
    bucket = (sorted_values >> words.U(value_bits - bits)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, int)
    return bucket[cut[:-1]], cut


_compress = zstandard.ZstdCompressor(level=1)
_expand = zstandard.ZstdDecompressor()


def planes(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes: small numbers cost few bytes."""
    raw = np.ascontiguousarray(values)
    return _compress.compress(np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T).tobytes())


def from_planes(blob: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(_expand.decompress(blob), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def deltas(sorted_values: np.ndarray) -> bytes:
    return planes(np.diff(sorted_values, prepend=words.U(0)))


def from_deltas(blob: bytes) -> np.ndarray:
    return np.cumsum(from_planes(blob, "<u8"), dtype=np.uint64)


def bits_of(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, dtype=np.uint8), count=n).astype(bool)
