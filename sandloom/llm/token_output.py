"""Token ids in a directly addressable binary format.

A segment holds the ids of neighbouring documents. Every id is split into chunks of CHUNK bits, low chunk first. Level 0
has a chunk of each id, level k a chunk of those ids that go on past level k-1; a bitmap says which do, and a directory of
running counts finds an id's place on the next level, so any token is read without decoding others.

Layout of a segment, little-endian: b"DAC1", uint32 levels, uint64 documents, uint64 ids; int64 doc ids; uint64 starts
(documents + 1, within the segment); then for each level uint64 entries, the chunks (uint8), and but for the last level
the bitmap (uint64 words) and the directory (uint32, ones before each word).

Segments are rows of a Parquet table in the shared folder (Spark's committer makes each task's output appear once or
not at all, on any file system); `payload` alone is the self-contained binary format and can be cut out as a file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import spill, table, texts
from ._tokens import WordCached, loaded

CHUNK = 8
SEGMENT_IDS = 1 << 18


def encode_segment(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    top = int(ids.max()).bit_length() if len(ids) else 1
    levels = max(1, -(-top // CHUNK))
    parts = [b"DAC1", struct.pack("<IQQ", levels, len(doc_ids), len(ids)), doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes()]
    rest = ids.astype(np.uint32)
    for level in range(levels):
        parts += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes()]
        if level < levels - 1:
            high = rest >> CHUNK
            more = high > 0
            bits = np.packbits(more, bitorder="little")
            words = np.zeros(-(-len(rest) // 64) * 8, dtype=np.uint8)
            words[: len(bits)] = bits
            words = words.view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            parts += [words.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
            rest = high[more]
    return b"".join(parts)


class Segment:
    """Reads a payload; token(i) is random access, ids() decodes all."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"DAC1":
            raise ValueError("not a DAC1 segment")
        levels, n_docs, self.n = struct.unpack_from("<IQQ", payload, 4)
        at = 24
        self.doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
        at += 8 * n_docs
        self.starts = np.frombuffer(payload, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.levels = []
        for level in range(levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            chunks = np.frombuffer(payload, np.uint8, n, at + 8)
            at += 8 + n
            if level < levels - 1:
                w = -(-n // 64)
                self.levels.append((chunks, np.frombuffer(payload, "<u8", w, at), np.frombuffer(payload, "<u4", w, at + 8 * w)))
                at += 12 * w
            else:
                self.levels.append((chunks, None, None))
        if at != len(payload):
            raise ValueError("a segment of another length than its header says")

    def token(self, i: int) -> int:
        value = 0
        for level, (chunks, words, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK * level)
            if words is None:
                break
            word = int(words[i >> 6])
            if not word >> (i & 63) & 1:
                break
            i = int(ranks[i >> 6]) + (word & ((1 << (i & 63)) - 1)).bit_count()
        return value

    def ids(self) -> np.ndarray:
        out = np.zeros(self.n, dtype="<u4")
        place = None
        for level, (chunks, words, _) in enumerate(self.levels):
            part = chunks.astype(np.uint32) << (CHUNK * level)
            if place is None:
                out |= part
            else:
                out[place] |= part
            if words is not None:
                more = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[: len(chunks)])
                place = more if place is None else place[more]
        return out


def write_ids(docs: DataFrame, tokenizer: str, end_id: int | None = 1, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode every text, add end_id, and write segments in ascending doc_id order; returns the table of segments.

    part, seq, part_start (ids before the segment in its part), n_docs, n_ids, payload. Null text is empty; a null
    doc_id is stored as the smallest long and comes first; rows of one doc_id come in the order of their texts.
    """

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part = loaded(WordCached, tokenizer), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        keys, held, size, seq, before = [], [], 0, 0, 0

        def out():
            n = np.fromiter((len(x) // 4 for x in held), np.int64, len(held))
            ids = np.frombuffer(b"".join(held), "<u4")
            payload = encode_segment(np.array(keys, dtype=np.int64), np.concatenate([[0], np.cumsum(n)]), ids)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "part_start": before, "n_docs": len(held), "n_ids": len(ids), "payload": payload}], schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("part_start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for i in range(0, b.num_rows, 256):
                x = b.slice(i, 256)
                for key, ids in zip(x.column(0).to_pylist(), enc.encode(x.column(1).to_pylist()), strict=True):
                    keys.append(-(1 << 63) if key is None else key)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= segment_ids:
                        yield out()
                        seq, before = seq + 1, before + size
                        keys, held, size = [], [], 0
        if held:
            yield out()

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return spill(ordered.mapInArrow(write, "part int, seq int, part_start long, n_docs long, n_ids long, payload binary"), "token-ids")


def read_ids(segments: DataFrame) -> DataFrame:
    """Per document, from the written segments: doc_id, start, n_tokens, ids_crc32."""
    # One row for each partition of the writer, so the driver's share doesn't grow with the documents.
    sizes = sorted((r.part, r.n) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, total = {}, 0
    for part, n in sizes:
        base[part] = total
        total += n

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for part, before, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                s = Segment(payload.as_py())
                raw, at = memoryview(s.ids().tobytes()), s.starts
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                keys = [None if k == -(1 << 63) else k for k in s.doc_ids.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(at[:-1] + before + base[part], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("part", "part_start", "payload").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_ids(write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1))
