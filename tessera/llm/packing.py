"""Packing of documents into fixed-length sequences, shortest pack first over the length histogram.

Documents longer than a sequence are cut into full pieces and a rest.  Only the histogram of piece
lengths (at most ``size`` entries) reaches the driver.  Lengths are placed longest first; each goes
to the pack with the most room (the shortest), and packs of one pattern are moved together, so the
work depends on the number of distinct lengths and not on the number of documents.  Patterns are
then joined back to pieces by rank: the r-th piece of a length takes the r-th place for it.

Defined cases: a null text counts as empty and packs its end id alone; rows that repeat an
identifier are separate pieces; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, pretokens

SIZE = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, number of such packs) for a histogram of lengths in 1..size."""
    by_room: list[list] = [[] for _ in range(size + 1)]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = size
        while left and room >= length:
            if not by_room[room]:
                room -= 1
                continue
            pattern, count = by_room[room].pop()
            used = min(left, count)
            if used < count:
                by_room[room].append((pattern, count - used))
            by_room[room - length].append(((*pattern, length), used))
            left -= used
            if used < count:
                break
        each = size // length
        for repeat, count in ((each, left // each), (left % each, 1)):
            if left and repeat and count:
                by_room[size - repeat * length].append(((length,) * repeat, count))
    merged: dict = defaultdict(int)
    for packs in by_room:
        for pattern, count in packs:
            merged[pattern] += count
    return sorted(merged.items(), reverse=True)


def places(packs: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank of each run of places, its first sequence, and its offset there."""
    runs = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    first = 0
    for pattern, count in packs:
        offset = 0
        for length in pattern:
            runs[length].append((ranks[length], first, offset))
            ranks[length] += count
            offset += length
        first += count
    return {length: tuple(np.array(x, np.int64) for x in zip(*got, strict=True)) for length, got in runs.items()}


def tokenised_pieces(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """One row per piece, with its number among the pieces of its length in its task."""

    def cut(batches):
        enc = pretokens.encoder(path)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            ids_of = batch.column(0).to_numpy()
            for lo, offs, ids in enc.rows(batch.column(1)):
                rows = []
                for i in range(len(offs) - 1):
                    own = np.append(ids[offs[i] : offs[i + 1]], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), size):
                        piece = own[start : start + size]
                        n = len(piece)
                        rows.append((ids_of[lo + i], start, n, zlib.crc32(piece.tobytes()), len(own), part, seen[n]))
                        seen[n] += 1
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to a staged table of pieces (columns of PIECES)."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    spots = places(shortest_pack_first(histogram, size))
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = pieces.join(base, ["part", "length"]).select(*fields, (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for one in np.unique(length):
                here = np.flatnonzero(length == one)
                ranks, firsts, offsets = spots[int(one)]
                run = np.searchsorted(ranks, rank[here], "right") - 1
                seq[here] = firsts[run] + rank[here] - ranks[run]
                off[here] = offsets[run]
            yield pa.record_batch(
                [*(batch.column(f) for f in fields), pa.array(seq), pa.array(off)], [*fields, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(
        place,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def packed(docs: DataFrame, path: str, size: int = SIZE, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their place: sequence_id and offset."""
    pieces = tokenised_pieces(common.id_and_text(docs), path, size, end_id)
    return common.null_ids(pack(common.staged(pieces, "pieces"), size))


def sequences(docs: DataFrame, placed: DataFrame, path: str, size: int = SIZE, end_id: int = 1, pad_id: int = 0) -> DataFrame:
    """The token arrays themselves: sequence_id, ids (padded to ``size``), n_ids before padding.

    A sequence whose length is a power of two is not padded.

    Documents meet their places by identifier, which must be unique here; ids are made again
    instead of being carried through the packing.
    """

    def fill(batches):
        enc = pretokens.encoder(path)
        for batch in batches:
            spots = batch.column(2).to_pylist()
            seqs, offs, out = [], [], []
            for lo, at, ids in enc.rows(batch.column(1)):
                for i in range(len(at) - 1):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id))
                    for spot in spots[lo + i]:
                        seqs.append(spot["sequence_id"])
                        offs.append(spot["offset"])
                        out.append(own[spot["start"] : spot["start"] + spot["length"]].astype(np.int32))
            yield pa.record_batch(
                [pa.array(seqs, pa.int64()), pa.array(offs, pa.int64()), pa.array(out, pa.list_(pa.int32()))],
                ["sequence_id", "offset", "ids"],
            )

    spots = placed.groupBy(F.coalesce("doc_id", F.lit(common.LARGEST)).alias("doc_id")).agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("spots"))
    text = common.id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = text.join(spots, "doc_id").select("doc_id", "text", "spots")
    filled = parts.mapInArrow(fill, "sequence_id long, offset long, ids array<int>")
    whole = filled.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    whole = whole.select("sequence_id", ids.alias("ids"), F.size(ids).alias("n_ids"))
    missing = F.when(F.bit_count("n_ids") == 1, 0).otherwise(F.lit(size) - F.col("n_ids"))
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), missing)).alias("ids"), "n_ids")


def op5_packing(spark, sf_dir):
    return packed(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
