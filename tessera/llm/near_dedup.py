"""Near duplicates: one-permutation MinHash, banded buckets, star-shaped candidate edges.

A document's set holds its distinct 4-word shingles as 64-bit hashes.  One hash of each shingle
serves all bins: its high bits choose the bin and the smallest hash in a bin is its signature; empty
bins copy a filled bin chosen by a fixed random order per bin (optimal densification).  ROWS bins
make a band; documents that agree on a band share a bucket.  Documents with equal sets are one class
and enter buckets once.

A bucket of m classes gives a star around one centre, its most popular class, the one with the most
company over all its buckets: the original of many edited copies is nearer to each of them than they
are to each other.  A class takes part in one star a round, that of the most popular centre it meets, so a
round has at most as many candidate edges as classes.  Edges are confirmed on full sets, links are
contracted to components at once, and buckets that lie in one component are closed.  Further rounds
draw the centres by a hash of class and bucket, while a round links a SHRINK-th of the open classes.

Stars only contract.  What they leave in open buckets is settled exactly, see ``rest``: two sets reach the
similarity only if they share a shingle in their prefixes, the rarest shingles first, and every pair
of different components that does is confirmed on full sets.  So each pair of near copies that shares
a bucket ends in one component, however many classes the bucket has, and no draw decides recall.

Before full sets are compared, bitmaps rule edges out: a bit that only one of two bitmaps has stands for at
least one shingle that only one set has, so the bound on what two sets share is never too low.

Two sets with similarity s miss each other in all buckets with chance (1 - s^4)^32: 4.6e-8 at 0.8.

Defined cases: a null or blank text has the empty set, is linked with nothing and is its own
component; fewer words than a shingle form one shingle; rows that repeat an identifier count as one
document with the links of both and are each returned; an empty table gives an empty result; no
other column is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb
from .components import components

BINS = 128
ROWS = 4
#: Stars are drawn again while a pass links at least one in SHRINK of the open classes.
SHRINK = 2
#: Counters of shingles by hash: they order the shingles, any order gives the same pairs.
COUNTERS = 1 << 20
#: Steps of length (a ratio) by which prefixes are dealt out, so that lengths too far apart never meet.
STEP = 1.02
#: Up to so many rows (16 MB of identifiers) are broadcast to thin out texts and sets; beyond, they are joined.
BROADCAST_ROWS = 500_000
_rng = np.random.Generator(np.random.PCG64(71))
_DONORS = np.stack([_rng.permutation(BINS) for _ in range(BINS)])
_ROW_ODD = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = _rng.integers(1, 2**63, BINS // ROWS, dtype=np.uint64)


def shingles(offs: np.ndarray, buf: np.ndarray, size: int):
    """Yield the sorted distinct shingle hashes of each text."""
    low = tb.LOWER[buf]
    starts, ends, first = tb.word_spans(offs, low)
    words = tb.span_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    prefix = tb.prefix_hash(words, tb._ODD2)
    n = np.diff(first)
    begins = np.arange(len(words))
    upto = np.repeat(first[1:], n)
    full = np.minimum(begins + size, upto)
    kept = (full - begins == size) | (begins == np.repeat(first[:-1], n))
    hashes = tb.range_hash(prefix, begins[kept], full[kept], tb._ODD2)
    cuts = np.concatenate([[0], np.cumsum(kept)])[first]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = np.unique(hashes[a:b])
        yield own


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Densified one-permutation signatures of non-empty sorted sets, one row each."""
    sig = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    for i, own in enumerate(sets):
        at = (own >> shift).astype(np.int64)
        lead = np.concatenate([[True], at[1:] != at[:-1]])
        sig[i, at[lead]] = own[lead]
        filled[i, at[lead]] = True
    row, gap = np.nonzero(~filled)
    for attempt in range(BINS):
        if not len(row):
            break
        donor = _DONORS[gap, attempt]
        ok = filled[row, donor]
        sig[row[ok], gap[ok]] = sig[row[ok], donor[ok]]
        row, gap = row[~ok], gap[~ok]
    return sig


def bitmap(own: np.ndarray) -> bytes:
    """A bit per shingle at its hash, in the power of two from 8 bits a shingle on."""
    width = 1 << max(6, (8 * len(own) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(own & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(one: bytes, two: bytes, n_one: int, n_two: int) -> int:
    """No fewer shingles than the sets of two bitmaps share; the wider one is folded to the narrower."""
    x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    width = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(z.reshape(-1, width), axis=0) for z in (x, y))
    return min(n_one - int(np.bitwise_count(x & ~y).sum()), n_two - int(np.bitwise_count(y & ~x).sum()))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band is part of the key."""
    parts = tb.mix(sig.reshape(len(sig), BINS // ROWS, ROWS) * _ROW_ODD)
    return tb.mix(parts.sum(axis=2, dtype=np.uint64) + _BAND_SALT).view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128 bits that name the set), bands."""

    def run(batches):
        for batch in batches:
            for lo, offs, buf in tb.slices(batch.column(1)):
                sets = list(shingles(offs, buf, size))
                bands = band_keys(signature([s for s in sets if len(s)]))
                sizes = np.array([len(s) for s in sets], np.int64)
                a = np.array([tb.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                b = np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                at = np.concatenate([[0], np.cumsum((sizes > 0) * bands.shape[1])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(bands.ravel()))
                yield pa.record_batch([batch.column(0).slice(lo, len(sets)), pa.array(sizes), pa.array(a), pa.array(b), lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """rep, bits, shingles: bitmap and whole set of each text."""

    def run(batches):
        for batch in batches:
            for lo, offs, buf in tb.slices(batch.column(1)):
                sets = list(shingles(offs, buf, size))
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                maps = pa.array([bitmap(s) for s in sets], pa.binary())
                yield pa.record_batch([batch.column(0).slice(lo, len(sets)), maps, pa.ListArray.from_arrays(pa.array(at), flat)], ["rep", "bits", "shingles"])

    return docs.mapInArrow(run, "rep long, bits binary, shingles array<long>")


def few(table: DataFrame) -> bool:
    """Whether a staged table is small enough to be broadcast."""
    return table.count() <= BROADCAST_ROWS


def with_ends(edges: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Staged edges with ``column`` of both ends as y (member) and x (center).

    Few edges go to the sets of their members, so only what belongs to an edge is shuffled, to its centre.
    A hot centre is a skewed join of two plain shuffles, which adaptive execution splits.
    """
    centers = edges.select(F.col("center").alias("rep")).distinct()
    one, two = sets.select("rep", column), sets.select(F.col("rep").alias("member"), F.col(column).alias("y"))
    if few(edges):
        two, one = two.join(F.broadcast(edges), "member"), one.join(F.broadcast(centers), "rep", "left_semi")
    else:
        two = two.join(edges, "member")
    return two.join(one.select(F.col("rep").alias("center"), F.col(column).alias("x")).hint("merge"), "center")


def plausible(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges without those that the bitmaps of their ends rule out."""
    columns = edges.columns
    sized = with_ends(edges, sets.withColumn("bits", F.struct("bits", F.size("shingles").alias("n"))), "bits")

    def run(batches):
        for batch in batches:
            x, y = ([batch.column(i).field(j).to_pylist() for j in (0, 1)] for i in (len(columns), len(columns) + 1))
            keep = [(100 + percent) * most_shared(a, b, n, m) >= percent * (n + m) for a, n, b, m in zip(*x, *y, strict=True)]
            yield batch.select(columns).filter(pa.array(keep, pa.bool_()))

    return sized.select(*columns, "x", "y").mapInArrow(run, edges.schema)


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Staged edges whose full sets reach the similarity."""
    left = common.staged(plausible(edges, sets, percent), "plausible")
    shared = F.size(F.array_intersect("x", "y"))
    both = with_ends(left, sets, "shingles")
    found = both.filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select(*edges.columns)
    found = common.staged(found, "links")
    common.release(edges.sparkSession, left)
    return found


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles occur in the sets, by COUNTERS hash values."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(flat & (COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            yield pa.record_batch([pa.array(some), pa.array(total[some])], ["at", "n"])

    got = sets.select("shingles").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.uint32)
    counts[got.column(0).to_numpy()] = np.minimum(got.column(1).to_numpy(), (1 << 32) - 1)
    return counts


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """rep, component_id, n, token, at: the shingles that come first in the order, rare ones before common ones."""

    def run(batches):
        for batch in batches:
            out, held = [], 0
            reps, marks, lists = (batch.column(i) for i in range(3))
            edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for row, (rep, own_mark) in enumerate(zip(reps.to_pylist(), marks.to_pylist(), strict=True)):
                own = flat[edges[row] : edges[row + 1]]
                first = np.lexsort((own, counts[own & (COUNTERS - 1)]))[: len(own) - -(-percent * len(own) // 100) + 1]
                n = len(first)
                out.append((np.full(n, rep), np.full(n, own_mark), np.full(n, len(own)), own[first], np.arange(n)))
                held += n
                if held >= 1 << 16 or row == len(reps) - 1:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["rep", "component_id", "n", "token", "at"])
                    out, held = [], 0

    return sets.select("rep", "component_id", "shingles").mapInArrow(run, "rep long, component_id long, n long, token long, at long")


def rest(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (center, member, center_c, member_c) between different components of ``left`` (rep, component_id): all of them.

    With shingles in one order, the first that two sets share has at least as many behind it in both as
    the sets must share.  That bounds its place: in the larger set within the first 20 % (at 80 percent), in the
    smaller within the first 11 %.  A place also bounds the lengths of the sets that can meet there, and the
    prefixes are dealt out by shingle and length.  Sets just under the similarity differ in more than
    that, so in a group with a common template these places hold few of the template's shingles.
    """
    spark = left.sparkSession
    held = common.staged(sets.join(F.broadcast(left) if few(left) else left, "rep").select("rep", "component_id", "shingles"), "rest")
    tokens = common.staged(prefixes(held, shingle_counts(held), percent), "prefixes")
    as_smaller = (100 + percent) * (F.col("n") - F.col("at")) >= 2 * percent * F.col("n")
    mixed = (
        tokens.groupBy("token")
        .agg(F.min("component_id").alias("least"), F.max("component_id").alias("most"), F.max(as_smaller).alias("met"))
        .filter("least < most and met")
        .select("token")
    )
    shared = common.staged(common.skew_join(tokens, mixed, ["token"]), "tokens")
    length = lambda n: F.floor(F.log(n) / F.lit(float(np.log(STEP)))).cast("int")
    entry = F.struct("rep", "component_id", "n", "at")
    one = shared.filter(as_smaller).select("token", length(F.col("n")).alias("length"), entry.alias("x"))
    low = F.ceil(percent * F.col("n") / 100)
    high = F.least("n", F.floor((F.col("n") - F.col("at")) * (100 + percent) / percent) - F.col("n"))
    two = shared.filter(low <= high).select("token", F.explode(F.sequence(length(low), length(high))).alias("length"), entry.alias("y"))
    pairs = (
        one.join(two, ["token", "length"])
        .filter("x.n < y.n or (x.n = y.n and x.rep < y.rep)")
        .filter("x.component_id <> y.component_id")
        .filter(100 * F.col("x.n") >= percent * F.col("y.n"))
        .filter((100 + percent) * F.least(F.expr("x.n - x.at"), F.expr("y.n - y.at")) >= percent * F.expr("x.n + y.n"))
        .select(F.col("y.rep").alias("center"), F.col("x.rep").alias("member"), F.col("y.component_id").alias("center_c"), F.col("x.component_id").alias("member_c"))
        .distinct()
    )
    edges = common.staged(pairs, "rest-edges")
    found = confirmed(edges, sets, percent)
    common.release(spark, held, tokens, shared, edges)
    return found


def relabelled(table: DataFrame, merged: DataFrame) -> DataFrame:
    """``table`` with its component_id replaced by that of ``merged`` (node, component_id) where it has one.

    The join is one of two plain shuffles, so a component with very many rows is split.
    """
    new = merged.select(F.col("node").alias("component_id"), F.col("component_id").alias("_new"))
    return table.join(new, "component_id", "left").withColumn("component_id", F.coalesce("_new", "component_id")).drop("_new").select(table.columns)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    spark = docs.sparkSession
    text = common.id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sketch = common.staged(sketches(text, size), "sketches")
    named = ["set_a", "set_b", "n_shingles"]
    classes = common.staged(
        sketch.filter("n_shingles > 0").groupBy(*named).agg(F.min(F.struct("doc_id", "bands")).alias("r"))
        .select(*named, F.col("r.doc_id").alias("rep"), "r.bands"),
        "classes",
    )
    buckets = classes.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    live = common.staged(common.skew_join(buckets, shared, ["bucket"]), "buckets")
    # Company of each class over its buckets, with a hash to settle ties.
    company = common.staged(
        live.groupBy("rep").agg((-F.sum("n") * (1 << 20) - F.pmod(F.xxhash64("rep"), F.lit(1 << 20))).alias("order")), "company"
    )
    chosen = company.select(F.col("rep").alias("doc_id"))
    sets = common.staged(full_sets(text.join(F.broadcast(chosen) if few(company) else chosen, "doc_id", "left_semi"), size), "sets")
    placed = live.join(company, "rep").select("bucket", "rep", "n_shingles", F.col("rep").alias("component_id"), "order")
    merges: list[DataFrame] = []
    turn = 0
    while True:
        stars = placed.groupBy("bucket").agg(F.min(F.struct("order", "rep", "n_shingles", "component_id")).alias("s"))
        met = (
            common.skew_join(placed.drop("order"), stars, ["bucket"])
            .filter("component_id <> s.component_id")
            .filter(100 * F.least("n_shingles", "s.n_shingles") >= percent * F.greatest("n_shingles", "s.n_shingles"))
        )
        edges = met.groupBy("rep", "component_id").agg(F.min("s").alias("s"))
        edges = common.staged(edges.select(F.col("s.rep").alias("center"), F.col("rep").alias("member"), F.col("s.component_id").alias("center_c"), F.col("component_id").alias("member_c")), "edges")
        found = confirmed(edges, sets, percent)
        gained = found.count()
        before = placed
        if gained:
            merges.append(components(found, "center_c", "member_c"))
            placed = relabelled(placed.drop("order"), merges[-1])
        mixed = placed.groupBy("bucket").agg(F.min("component_id").alias("least"), F.max("component_id").alias("most")).filter("least < most").select("bucket")
        placed = common.staged(common.skew_join(placed.select("bucket", "rep", "n_shingles", "component_id"), mixed, ["bucket"]), "open")
        common.release(spark, edges, found, *([before] if turn else [live]))
        left = common.staged(placed.select("rep", "component_id").distinct(), "left")
        if SHRINK * gained < left.count() or not gained:
            break
        turn += 1
        placed = placed.withColumn("order", F.xxhash64("rep", "bucket", F.lit(turn)))
    if left.limit(1).count():
        found = rest(left, sets, percent)
        if found.limit(1).count():
            merges.append(components(found, "center_c", "member_c"))
    common.release(spark, placed, left, sets, company)
    grouped = classes.select(*named, F.col("rep").alias("component_id"))
    for merged in merges:
        grouped = relabelled(grouped, merged)
    found = sketch.select("doc_id", *named).join(grouped, named, "left")
    own = F.coalesce("component_id", "doc_id")
    out = found.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id") == own).alias("kept"))
    return common.null_ids(out, "doc_id", "component_id")


def op10_near_dedup(spark, sf_dir):
    return near_groups(common.documents(spark, sf_dir))
