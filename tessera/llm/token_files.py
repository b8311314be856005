"""Token files with directly addressable codes.

A segment holds the ids of consecutive documents.  Each id is split into chunks of CHUNK_BITS bits,
lowest first; chunk j of all ids that have one forms level j, with a bitmap that says which of them go
on to level j + 1 and a rank directory (ones before each block of RANK_BLOCK bits).  Any id is then
read by one byte, one bit and one rank per level, and nothing before it is decoded.

A file is a run of segments, each followed by one newline byte, without compression.  A segment's header
says how long it is, so a reader steps from header to header and then reads single bytes by position
(``TokenFile`` maps a file and touches nothing else).  Spark's text writer makes the files: its commit
protocol makes them whole even when executors are lost, on any file system that Spark writes to.  A file
has at most FILE_SEGMENTS segments, so readers that take a whole file (``read``) hold a bounded part.

Defined cases: a null text counts as empty and has its end id alone; rows that repeat an identifier
keep their order by text digest; an empty table gives no segment; no other column is read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from . import common, pretokens

CHUNK_BITS = 8
RANK_BLOCK = 512
SEGMENT_IDS = 1 << 16
#: Segments to a file, each of SEGMENT_IDS ids and the rest of its last document.
FILE_SEGMENTS = 128
MAGIC = b"DAC2"
#: Part, ids of the part before the segment, bytes of the segment; numbers of documents, ids and levels.
HEADER = struct.Struct("<4sIqqIII")
#: Part, and ids of the part up to the segment's end; big-endian, so that SQL can read it off the end of a file.
TRAILER = struct.Struct(">Iq")


def write_segment(doc_ids, offsets, ids: np.ndarray, part: int = 0, before: int = 0) -> bytes:
    """Header, document directory, then per level: chunks, bitmap, rank directory; trailer."""
    levels = []
    rest = ids.astype(np.uint64)
    while True:
        low = (rest & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        rest >>= np.uint64(CHUNK_BITS)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK)))])
        levels.append((low.tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()))
        rest = rest[more]
        if not len(rest):
            break
    out = [np.asarray(doc_ids, "<i8").tobytes(), np.asarray(offsets, "<i8").tobytes()]
    for level in levels:
        out.append(struct.pack("<III", *map(len, level)))
        out += level
    out.append(TRAILER.pack(part, before + len(ids)))
    n_bytes = HEADER.size + sum(map(len, out))
    return b"".join([HEADER.pack(MAGIC, part, before, n_bytes, len(doc_ids), len(ids), len(levels)), *out])


class Segment:
    """Reads the segment that starts at a position of a buffer; nothing is copied or decoded in advance."""

    def __init__(self, data, at: int = 0):
        magic, self.part, self.before, self.n_bytes, n_docs, self.n_ids, n_levels = HEADER.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        blob, at = data, at + HEADER.size
        self.doc_ids = np.frombuffer(blob, "<i8", n_docs, at)
        self.offsets = np.frombuffer(blob, "<i8", n_docs + 1, at + 8 * n_docs)
        at += 8 * (2 * n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            a, b, c = struct.unpack_from("<III", blob, at)
            at += 12
            self.levels.append(
                (
                    np.frombuffer(blob, np.uint8, a, at),
                    np.frombuffer(blob, np.uint8, b, at + a),
                    np.frombuffer(blob, "<u4", c // 4, at + a + b),
                )
            )
            at += a + b + c

    def rank(self, level: int, i: int) -> int:
        """Ones in the bitmap of a level before position i."""
        _, bits, ranks = self.levels[level]
        block = i // RANK_BLOCK
        inside = np.unpackbits(bits[block * RANK_BLOCK // 8 : (i + 7) // 8], bitorder="little")
        return int(ranks[block]) + int(inside[: i - block * RANK_BLOCK].sum())

    def __getitem__(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, shift = 0, 0
        for level, (low, bits, _) in enumerate(self.levels):
            value |= int(low[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self.rank(level, i), shift + CHUNK_BITS
        return value

    def read(self, lo: int, hi: int) -> np.ndarray:
        """The ids at positions lo..hi-1."""
        out = np.zeros(hi - lo, np.uint32)
        where, shift = np.arange(hi - lo), 0
        for level, (low, bits, _) in enumerate(self.levels):
            if hi <= lo:
                break
            out[where] |= low[lo:hi].astype(np.uint32) << np.uint32(shift)
            more = np.unpackbits(bits[lo // 8 : (hi + 7) // 8], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            where, shift = where[more], shift + CHUNK_BITS
            lo = self.rank(level, lo)
            hi = lo + len(where)
        return out


def segments_in(data):
    """The segments of a file's bytes, header by header."""
    at = 0
    while at < len(data):
        segment = Segment(data, at)
        yield segment
        at += segment.n_bytes + 1


class TokenFile:
    """One file, mapped: any id by its position in the file, without reading what lies before it."""

    def __init__(self, path: str):
        self.segments = list(segments_in(memoryview(np.memmap(path, np.uint8, "r"))))
        self.first = self.segments[0].before
        self.starts = [s.before - self.first for s in self.segments]
        self.n_ids = self.starts[-1] + self.segments[-1].n_ids

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        k = bisect_right(self.starts, i) - 1
        return self.segments[k][i - self.starts[k]]


def segments(docs, path: str, end_id: int):
    """Segments of all documents in ascending order: one row each, in the order of the files."""
    text = common.id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = text.repartitionByRange(common.range_count(docs), "doc_id").sortWithinPartitions(
        "doc_id", F.xxhash64("text")
    )

    def run(batches):
        enc = pretokens.encoder(path, word_level=True)
        part = TaskContext.get().partitionId()
        before = 0
        names, sizes, parts, held = [], [], [], 0
        end = np.array([end_id], np.uint32)

        def close():
            nonlocal before, names, sizes, parts, held
            blob = write_segment(names, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(parts), part, before)
            before += held
            names, sizes, parts, held = [], [], [], 0
            return pa.record_batch([pa.array([blob], pa.binary())], ["blob"])

        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for lo, offs, ids in enc.rows(batch.column(1)):
                for i in range(len(offs) - 1):
                    names.append(ids_of[lo + i])
                    sizes.append(int(offs[i + 1] - offs[i]) + 1)
                    parts += [ids[offs[i] : offs[i + 1]], end]
                    held += sizes[-1]
                    if held >= SEGMENT_IDS:
                        yield close()
        if names:
            yield close()

    return ordered.mapInArrow(run, "blob binary")


def write(docs, folder: str, path: str, end_id: int = 2) -> None:
    # The text writer puts a string's bytes into the file as they are.
    rows = segments(docs, path, end_id).select(F.col("blob").cast("string").alias("value"))
    rows.write.option("compression", "none").option("lineSep", "\n").option("maxRecordsPerFile", FILE_SEGMENTS).text(folder)


def read(spark, folder: str):
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select("content")

    def number(end: int, size: int):
        return F.conv(F.hex(F.substring("content", -end, size)), 16, 10).cast("long")

    # One total per written partition, not per segment or document; the trailer stands before the last newline.
    last = files.select(number(TRAILER.size + 1, 4).alias("part"), number(9, 8).alias("n"))
    totals = sorted((r["part"], r["n"]) for r in last.groupBy("part").agg(F.max("n").alias("n")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part], at = at, at + n

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                for seg in segments_in(memoryview(content.as_buffer())):
                    cuts = seg.offsets.tolist()
                    crcs = [zlib.crc32(seg.read(a, b).astype("<u4").tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
                    yield pa.record_batch(
                        [
                            pa.array(seg.doc_ids.astype(np.int64)),
                            pa.array(seg.offsets[:-1].astype(np.int64) + base[seg.part] + seg.before),
                            pa.array(np.diff(seg.offsets).astype(np.int64)),
                            pa.array(crcs, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return common.null_ids(files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def op8_token_files(spark, sf_dir):
    folder = common.stage_path(spark, "token-files")
    write(common.documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, folder)
