"""Repeated passages: confirmed phrases, sharded Aho-Corasick automata, exact windows.

A word is removed when it lies in a WINDOW of consecutive words that also starts in a document with a
smaller identifier.

1. Anchors.  Of the PHRASE-word phrases inside each window the one with the smallest hash is its
   anchor, so equal windows have equal anchors wherever they stand.  About 2 phrases in 27 are anchors.
   Documents without an anchor that a document with another identifier has can hold no recurring window.
2. Confirmation.  The words of the anchors that recur are compared: a phrase of which two documents with
   different identifiers have the same words is confirmed.  Its owner is the smallest of them.
3. Automata.  Confirmed phrases are dealt into shards of about SHARD_PHRASES by their owner, and every
   document is routed to the shards of its phrases, in slices of about SLICE_WORDS words.  A task reads
   the phrases of a shard, compiles them into one automaton over words, and streams the documents of
   its slice through it, which locates every occurrence.  So a phrase that very many documents share
   makes more slices, never a larger task.
4. Windows.  The windows around occurrences are staged as runs and compared by 128-bit hashes: the
   smallest identifier of each hash is aggregated before the join, so a passage that very many documents
   share is a skewed join, which adaptive execution splits, and never one group.

Documents with equal words are one class: only the smallest identifier goes through 1 to 4, the others
are covered completely (from WINDOW words on).

Defined cases: a null or blank text has no words; rows that repeat an identifier do not cover each
other and each text is returned; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

WINDOW = 50
PHRASE = 25
#: Phrases of a shard (some 25 MB as an automaton), and words of a slice of its documents.
SHARD_PHRASES = 10_000
SLICE_WORDS = 1 << 20
#: Rows of three identifiers up to this many (16 MB) are broadcast to thin out the texts; beyond, texts are joined.
BROADCAST_IDS = 500_000
EMPTY = hashlib.sha256(b"").hexdigest()


def slide(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def anchor_starts(phrases: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the smallest hash of some ``width`` consecutive phrases."""
    if len(phrases) < width:
        return np.zeros(0, np.int64)
    least = slide(phrases, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(slide(np.concatenate([edge, least, edge]), width, np.maximum) == phrases)


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words with one space between them."""
    if not len(starts):
        return b""
    sizes = ends - starts + 1
    shift = starts - (np.cumsum(sizes) - sizes)
    at = np.repeat(shift, sizes) + np.arange(int(sizes.sum()))
    last = np.cumsum(sizes) - 1
    at[last] = 0
    out = buf[at]
    out[last] = 0x20
    return out[:-1].tobytes()


def texts_of(column):
    """Yield (row, words' bytes, starts, ends, hashes) of each text."""
    for lo, offs, buf in tb.slices(column):
        starts, ends, first = tb.word_spans(offs, buf)
        hashes = tb.span_hashes(buf, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        cuts = first.tolist()
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            yield lo + i, buf, starts[a:b], ends[a:b], hashes[a:b]


def mark(column):
    """Tells texts of one identifier apart."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit(""))).alias("mark")


def digests(text: DataFrame) -> DataFrame:
    """doc_id, mark (of the raw text), n_words, key (SHA-256 of the joined words), anchors (distinct hashes)."""

    def run(batches):
        for batch in batches:
            out = []

            def flush(batch=batch, out=out):
                rows, n, keys, anchors = zip(*out, strict=True)
                out.clear()
                return pa.record_batch(
                    [batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows)), pa.array(n, pa.int64()), pa.array(keys), pa.array(anchors, pa.list_(pa.int64()))],
                    ["doc_id", "mark", "n_words", "key", "anchors"],
                )

            for row, buf, starts, ends, hashes in texts_of(batch.column(1)):
                phrases = tb.window_hashes(hashes, PHRASE)
                own = np.unique(phrases[anchor_starts(phrases, WINDOW - PHRASE + 1)]).view(np.int64)
                out.append((row, len(starts), hashlib.sha256(joined(buf, starts, ends)).hexdigest(), own))
                if len(out) >= 1000:
                    yield flush()
            if out:
                yield flush()

    marked = text.select("doc_id", "text", mark("text"))
    return marked.mapInArrow(run, "doc_id long, mark long, n_words long, key string, anchors array<long>")


def phrases_of(candidates: DataFrame) -> DataFrame:
    """doc_id, anchor, phrase: the words of each text's recurring anchors."""

    def run(batches):
        for batch in batches:
            ids, lists, out = batch.column(0).to_pylist(), batch.column(2), []
            for row, buf, starts, ends, words in texts_of(batch.column(1)):
                phrases = tb.window_hashes(words, PHRASE)
                spots = anchor_starts(phrases, WINDOW - PHRASE + 1)
                spots = spots[np.isin(phrases[spots], np.asarray(lists[row].values).view(np.uint64))]
                _, first = np.unique(phrases[spots], return_index=True)
                for p in spots[first].tolist():
                    out.append((ids[row], int(phrases[p : p + 1].view(np.int64)[0]), joined(buf, starts[p : p + PHRASE], ends[p : p + PHRASE]).decode()))
                if len(out) >= 10_000:
                    yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], ["doc_id", "anchor", "phrase"])
                    out = []
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], ["doc_id", "anchor", "phrase"])

    return candidates.select("doc_id", "text", "anchors").mapInArrow(run, "doc_id long, anchor long, phrase string")


def letters(words: np.ndarray) -> tuple[int, ...]:
    """Words as letters of an automaton; equal words are equal letters, and windows are compared in full later."""
    return tuple((words >> np.uint64(32)).tolist())


class Shard:
    """The automaton of a shard: phrases first, then texts."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        self.open = True

    def add(self, words: np.ndarray) -> None:
        self.automaton.add_word(letters(words))

    def locate(self, words: np.ndarray) -> np.ndarray:
        """Starts of all occurrences of the shard's phrases."""
        if not len(self.automaton):
            return np.zeros(0, np.int64)
        if self.open:
            self.automaton.make_automaton()
            self.open = False
        return np.array([end - PHRASE + 1 for end, _ in self.automaton.iter(letters(words))], np.int64)


def window_starts(spots: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of the windows that hold a phrase at one of the spots."""
    n = n_words - WINDOW + 1
    if n < 1 or not len(spots):
        return np.zeros(0, np.int64)
    # A window that starts at s holds the phrase at p if p - (WINDOW - PHRASE) <= s <= p.
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.minimum(np.maximum(spots - (WINDOW - PHRASE), 0), n), 1)
    np.add.at(step, np.minimum(spots + 1, n), -1)
    return np.flatnonzero(np.cumsum(step[:-1]) > 0)


def streamed(dealt: DataFrame) -> DataFrame:
    """doc_id, part, start, a, b: runs of windows (128 bits each) that hold a confirmed phrase.

    ``dealt`` (shard, slice, kind, doc_id, part, body) has the phrases (kind 0) of a shard before the
    texts (kind 1) of a slice, sorted so in each partition.
    """

    def run(batches):
        at, shard = None, None
        for batch in batches:
            places = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            ids, parts, out, held = batch.column(3).to_pylist(), batch.column(4).to_pylist(), [], 0
            for row, _, _, _, words in texts_of(batch.column(5)):
                *place, kind = places[row]
                if place != at:
                    at, shard = place, Shard()
                if not kind:
                    shard.add(words)
                    continue
                starts = window_starts(shard.locate(words), len(words))
                if not len(starts):
                    continue
                one, two = (tb.window_hashes(words, WINDOW, salt)[starts].view(np.int64) for salt in (0, 1))
                cuts = np.flatnonzero(np.diff(starts, prepend=-2) > 1)
                for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(starts)], strict=True):
                    out.append((ids[row], parts[row], int(starts[lo]), one[lo:hi], two[lo:hi]))
                held += len(starts)
                if held > 1 << 17:
                    yield runs_of(out)
                    out, held = [], 0
            if out:
                yield runs_of(out)

    def runs_of(out):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "part", "start", "a", "b"])

    return dealt.mapInArrow(run, "doc_id long, part long, start int, a array<long>, b array<long>")


def cleaned(candidates: DataFrame) -> DataFrame:
    """doc_id, key, n_removed, kept_text for texts with the starts of their repeated windows."""

    def run(batches):
        for batch in batches:
            ids, keys, starts_of = batch.column(0), batch.column(2), batch.column(3)
            out = []
            for row, buf, starts, ends, _ in texts_of(batch.column(1)):
                step = np.zeros(len(starts) + 1, np.int64)
                at = np.unique(np.asarray(starts_of[row].values))
                step[at] += 1
                step[at + WINDOW] -= 1
                keep = np.cumsum(step[:-1]) == 0
                text = joined(buf, starts[keep], ends[keep])
                out.append((ids[row].as_py(), keys[row].as_py(), int((~keep).sum()), text.decode()))
                if len(out) >= 1000:
                    yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], ["doc_id", "key", "n_removed", "kept_text"])
                    out = []
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], ["doc_id", "key", "n_removed", "kept_text"])

    return candidates.select("doc_id", "text", "key", "starts").mapInArrow(
        run, "doc_id long, key string, n_removed long, kept_text string"
    )


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(digests of all rows with their class's smallest identifier, cleaned texts of changed classes)."""
    text = common.id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    seen = common.staged(digests(text), "digests")
    firsts = seen.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    rows = common.staged(common.skew_join(seen, firsts, ["key"]), "classes")
    name = ["doc_id", "mark", "key", "n_words"]
    once = rows.filter("doc_id = first_id").select(*name, F.explode("anchors").alias("anchor"))
    recurring = once.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x < y").select("anchor")
    held = common.staged(common.skew_join(once, recurring, ["anchor"]).groupBy(*name).agg(F.collect_set("anchor").alias("anchors")), "held")
    # Texts that share an identifier are told apart by their part: 0 for an only text, so that it packs well.
    least = held.groupBy("doc_id").agg(F.min("mark").alias("least"))
    parted = common.skew_join(held, least, ["doc_id"]).withColumn("part", F.col("mark").bitwiseXOR(F.col("least"))).drop("least")
    source = text.select("doc_id", "text", mark("text"))
    if held.count() <= BROADCAST_IDS:
        source = source.join(F.broadcast(held.select("doc_id").distinct()), "doc_id", "left_semi")
    candidates = common.staged(source.join(parted, ["doc_id", "mark"]), "candidates")
    found = common.staged(streamed(dealt_out(candidates)), "runs")
    windows = found.select("doc_id", "part", "start", F.posexplode(F.arrays_zip("a", "b"))).select(
        F.col("col.a").alias("a"), F.col("col.b").alias("b"), "doc_id", "part", (F.col("start") + F.col("pos")).alias("start")
    )
    owners = windows.groupBy("a", "b").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x < y").select("a", "b", "x")
    covered = common.skew_join(windows, owners, ["a", "b"]).filter("doc_id > x")
    starts = common.staged(covered.groupBy("doc_id", "part").agg(F.collect_set("start").alias("starts")), "covered")
    changed = common.staged(cleaned(candidates.join(starts, ["doc_id", "part"])), "cleaned")
    common.release(docs.sparkSession, seen, held, candidates, found, starts)
    return rows.select("doc_id", "mark", "key", "n_words", "first_id"), changed


def dealt_out(candidates: DataFrame) -> DataFrame:
    """shard, slice, kind, doc_id, part, body: phrases and texts, each slice of a shard in one partition."""
    phrases = common.staged(
        phrases_of(candidates).groupBy("anchor", "phrase").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most")).filter("owner < most").drop("most"),
        "phrases",
    )
    shards = max(1, phrases.count() // SHARD_PHRASES)
    phrases = phrases.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("int"))
    routed = common.staged(
        candidates.select("doc_id", "mark", "part", "n_words", F.explode("anchors").alias("anchor"))
        .join(phrases.select("anchor", "shard").distinct(), "anchor")
        .groupBy("doc_id", "mark", "part", "n_words")
        .agg(F.collect_set("shard").alias("shards")),
        "routed",
    )
    each = routed.select("doc_id", "mark", "part", "n_words", F.explode("shards").alias("shard"))
    # One row per shard; a shard with many words has many slices.
    sizes = common.staged(each.groupBy("shard").agg((1 + F.floor(F.sum("n_words") / SLICE_WORDS)).cast("int").alias("slices")), "slices")
    small = F.broadcast if shards <= BROADCAST_IDS else (lambda df: df)
    keys = phrases.join(small(sizes), "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("part"), F.col("phrase").alias("body")
    )
    spots = each.join(small(sizes), "shard").select("doc_id", "part", "shard", F.pmod(F.xxhash64("doc_id", "mark"), F.col("slices")).cast("int").alias("slice"))
    if routed.count() <= BROADCAST_IDS:
        spots = F.broadcast(spots)
    texts = candidates.select("doc_id", "part", "text").join(spots, ["doc_id", "part"]).select("shard", "slice", F.lit(1).alias("kind"), "doc_id", "part", F.col("text").alias("body"))
    # Slices go round the partitions, so that none gets several by chance while others get none.
    total = sizes.agg(F.coalesce(F.sum("slices"), F.lit(0))).first()[0]
    parts = max(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(common.MOST_RANGES, total))
    place = F.pmod(F.xxhash64("shard") + F.col("slice"), F.lit(parts)).cast("int")
    return keys.union(texts).repartitionById(parts, place).sortWithinPartitions("shard", "slice", "kind")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per input row."""
    rows, changed = repeats(docs)
    changed = changed.select("doc_id", "key", F.col("n_removed").alias("cut"), F.sha2(F.col("kept_text"), 256).alias("sha")).dropDuplicates(["doc_id", "key"])
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= WINDOW)
    out = rows.join(changed, ["doc_id", "key"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("sha", "key")).alias("kept_sha256"),
    )
    return common.null_ids(out)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out of ``text``; other columns and texts unchanged."""
    rows, changed = repeats(docs)
    copies = rows.filter((F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= WINDOW)).select(
        "doc_id", "mark", F.lit("").alias("kept_text")
    )
    names = rows.select("doc_id", "key", "mark").distinct()
    new = changed.dropDuplicates(["doc_id", "key"]).join(names, ["doc_id", "key"]).select("doc_id", "mark", "kept_text").union(copies.distinct())
    new = new.select(F.col("doc_id").alias("_cut_id"), F.col("mark").alias("_cut_mark"), F.col("kept_text").alias("_cut_text"))
    cut = docs.join(new, F.coalesce(docs["doc_id"].cast("long"), F.lit(common.LARGEST)).eqNullSafe(new["_cut_id"]) & (mark("text") == new["_cut_mark"]), "left")
    return cut.select(*[F.coalesce("_cut_text", "text").alias("text") if c == "text" else docs[c] for c in docs.columns])


def op2_substring_dedup(spark, sf_dir):
    return removed(common.documents(spark, sf_dir))


OP2_SQL = r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
g as (select doc_id, unnest(range(1, len(ws) - 48)) as i, ws from w where len(ws) >= 50),
k as (select doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) as h from g),
f as (select h, min(doc_id) as m from k group by h),
d as (select k.doc_id, k.i from k join f on k.h = f.h where k.doc_id > f.m),
c as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) as p from d) q),
r as (select doc_id, list(p) as ps, count(*) as n from c group by doc_id)
select w.doc_id, len(w.ws)::bigint as n_words, coalesce(r.n, 0)::bigint as n_removed,
       sha256(coalesce(array_to_string(case when r.n is null then w.ws else
              list_transform(list_filter(range(1, len(w.ws) + 1), lambda p: not list_contains(r.ps, p)), lambda p: w.ws[p])
              end, ' '), '')) as kept_sha256
from w left join r on w.doc_id = r.doc_id
"""
