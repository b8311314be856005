"""Language-model scoring by context-tree weighting over bytes, next to an add-one word model.

A text is its lower-cased words with one space between them and an end byte.  Each byte is eight binary
decisions.  For a decision, every context of the last 0..DEPTH bytes holds zero and one counts and a
Krichevsky-Trofimov estimate; context-tree weighting mixes the estimates of all depths, a node's share
being its posterior against the subtree below it.  The log-probability of a text is its negative code
length, so divided by its bytes it is the code length per byte.

Counts come from all training texts.  What is gathered:

* n-grams of DEPTH + 1 bytes and words, counted per task and then summed by key;
* the tree below each pair of latest bytes, built where the n-grams of that pair meet (at most 2^8(DEPTH-1)
  distinct n-grams, however large the corpus); only sums per pair go on, to the small tree above;
* one log-probability per distinct n-gram.

Scoring holds the most frequent words and n-grams in memory (at most FREQUENT of each: the threshold
is read off the histogram of counts).  The rest of a text's words and n-grams is joined by key.

Defined cases: a null or blank text is its end byte alone; without training texts counts are zero and
every binary estimate is 1/2; repeated rows are scored (and learned from) one by one; an empty table
gives an empty result; no other column is read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

DEPTH = 5
FREQUENT = 1 << 18
SLICE = 1 << 20
#: Distinct keys that a counting task holds before it hands them on.
HELD = 700_000
WORD, GRAM, END = 0, 1, 2
LN_HALF = math.log(0.5)


def stream(offs: np.ndarray, buf: np.ndarray):
    """(word hashes, first word of each row, n-gram keys, first n-gram of each row)."""
    low = tb.LOWER[buf]
    starts, ends, first = tb.word_spans(offs, low)
    n_words = np.diff(first)
    sizes = ends - starts + 1
    bytes_of = np.concatenate([[0], np.cumsum(sizes)])
    symbols = np.where(n_words > 0, bytes_of[first[1:]] - bytes_of[first[:-1]], 1)
    grams_at = np.concatenate([[0], np.cumsum(symbols)])
    rows = np.arange(len(n_words))
    out = np.full(int(grams_at[-1]) + DEPTH * len(rows), 0x0A, np.uint8)
    if len(starts):
        row = np.repeat(rows, n_words)
        to = grams_at[row] + DEPTH * (row + 1) + bytes_of[:-1] - bytes_of[first[row]]
        inside = sizes - 1
        where = np.arange(int(inside.sum())) - np.repeat(np.cumsum(inside) - inside, inside)
        out[np.repeat(to, inside) + where] = low[np.repeat(starts, inside) + where]
        gap = np.ones(len(starts), bool)
        gap[first[1:][n_words > 0] - 1] = False
        out[(to + inside)[gap]] = 0x20
    keys = np.zeros(len(out) - DEPTH, np.int64) if len(rows) else np.zeros(0, np.int64)
    for k in range(DEPTH + 1):
        keys <<= 8
        keys |= out[k : len(out) - DEPTH + k]
    at = np.arange(int(grams_at[-1])) + DEPTH * np.repeat(rows, symbols)
    words = tb.span_hashes(low, starts, ends).view(np.int64) if len(starts) else np.zeros(0, np.int64)
    return words, first, keys[at], grams_at


class Tally:
    """Sums by key of a task; parts are merged now and then."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys, train, every):
        self.parts.append((keys, train, every))
        self.size += len(keys)

    def merged(self):
        keys, where = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        sums = [np.bincount(where, np.concatenate([p[i] for p in self.parts]), len(keys)).astype(np.int64) for i in (1, 2)]
        self.parts, self.size = [(keys, *sums)], len(keys)
        return keys, *sums


def counted(docs: DataFrame) -> DataFrame:
    """kind, key, n_train, n_all per task; docs: text, train."""

    def run(batches):
        tallies = {WORD: Tally(), GRAM: Tally()}
        ends = np.zeros(2, np.int64)

        def hand_on(kind, tally):
            keys, train, every = tally.merged()
            tally.parts, tally.size = [], 0
            for i in range(0, len(keys), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.record_batch(
                    [pa.array(np.full(len(keys[s]), kind, np.int8)), pa.array(keys[s]), pa.array(train[s]), pa.array(every[s])],
                    ["kind", "key", "n_train", "n_all"],
                )

        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, offs, buf in tb.slices(batch.column(0), SLICE):
                words, first, grams, at = stream(offs, buf)
                own = train[lo : lo + len(offs) - 1]
                ends += [own.sum(), len(own)]
                for kind, keys, cuts in ((WORD, words, first), (GRAM, grams, at)):
                    learned, tally = np.repeat(own, np.diff(cuts)), tallies[kind]
                    for side in (True, False):
                        some, n = np.unique(keys[learned == side], return_counts=True)
                        tally.add(some, n * side, n)
                    if tally.size > 2 * HELD:
                        tally.merged()
                        if tally.size > HELD:
                            yield from hand_on(kind, tally)
        for kind, tally in tallies.items():
            if tally.parts:
                yield from hand_on(kind, tally)
        yield pa.record_batch([pa.array([END], pa.int8()), pa.array([0]), pa.array(ends[:1]), pa.array(ends[1:])], ["kind", "key", "n_train", "n_all"])

    return docs.mapInArrow(run, "kind byte, key long, n_train long, n_all long")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0: Stirling's series after moving small arguments up."""
    x = x.astype(np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift -= np.where(small, np.log(np.where(small, x, 1)), 0)
        x = np.where(small, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


def decisions(keys: np.ndarray, depth: int):
    """Per bit of the symbol: (node = context of ``depth`` bytes and bits before, bit)."""
    context = (keys >> 8) & ((1 << 8 * depth) - 1)
    symbol = keys & 255
    for bit in range(8):
        yield context << 8 | 1 << bit | symbol >> (8 - bit), (symbol >> (7 - bit)) & 1


def nodes(keys: np.ndarray, n: np.ndarray, depth: int):
    """Sorted nodes at a depth with their counts of zeros and ones."""
    names, bits = (np.concatenate(x) for x in zip(*decisions(keys, depth), strict=True))
    names, where = np.unique(names, return_inverse=True)
    n = np.tile(n, 8)
    return names, np.bincount(where, n * (1 - bits), len(names)), np.bincount(where, n * bits, len(names))


def weigh(names, zeros, ones, below=None, below_log=None, depth=0):
    """(ln of the weighted probability, share of the node's own estimate) for nodes at a depth."""
    own = log_kt(zeros, ones)
    if below is None:
        return own, np.ones(len(own))
    parent = (((below >> 8) & ((1 << 8 * depth) - 1)) << 8) | (below & 255)
    children = np.bincount(np.searchsorted(names, parent), below_log, len(names))
    both = np.logaddexp(LN_HALF + own, LN_HALF + children)
    return both, np.exp(LN_HALF + own - both)


def mixed(keys: np.ndarray, levels: list, least: int) -> np.ndarray:
    """Probability of each bit of each key's symbol, mixed over levels least..DEPTH."""
    out = np.empty((len(keys), 8))
    for bit in range(8):
        p = None
        for depth in range(least + len(levels) - 1, least - 1, -1):
            names, zeros, ones, share = levels[depth - least]
            node, value = list(decisions(keys, depth))[bit]
            if len(names):
                at = np.minimum(np.searchsorted(names, node), len(names) - 1)
                seen = names[at] == node
                kt = (np.where(value == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
                here = kt if p is None else share[at] * kt + (1 - share[at]) * p
                p = np.where(seen, here, 0.5)
            else:
                p = np.full(len(keys), 0.5)
        out[:, bit] = p
    return out


def subtree(keys: np.ndarray, n: np.ndarray):
    """Levels 2..DEPTH of the contexts that end in one pair of bytes, and the pair's own nodes."""
    trained = n > 0
    levels, below, below_log = [], None, None
    for depth in range(DEPTH, 1, -1):
        names, zeros, ones = nodes(keys[trained], n[trained], depth)
        logs, share = weigh(names, zeros, ones, below, below_log, depth)
        levels.insert(0, (names, zeros, ones, share))
        below, below_log = names, logs
    return levels, below_log


def trees(grams: DataFrame) -> DataFrame:
    """From key, n_train: rows of n-grams (key, bits) and rows of pair nodes (node, zeros, ones, log_w)."""

    def run(table):
        keys, n = table.column("key").to_numpy(), table.column("n_train").to_numpy().astype(np.float64)
        levels, logs = subtree(keys, n)
        names, zeros, ones, _ = levels[0]
        bits = mixed(keys, levels, 2)
        k, m = len(keys), len(names)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([np.arange(k + 1) * 8, np.full(m, k * 8)]).astype(np.int32)), pa.array(bits.ravel())
        )
        gap = np.zeros(k)
        return pa.table(
            {
                "key": np.concatenate([keys, names]),
                "top": np.concatenate([np.zeros(k, bool), np.ones(m, bool)]),
                "bits": lists,
                "zeros": np.concatenate([gap, zeros]),
                "ones": np.concatenate([gap, ones]),
                "log_w": np.concatenate([gap, logs]),
            }
        )

    pair = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
    return grams.select("key", "n_train", pair.alias("pair")).groupBy("pair").applyInArrow(
        run, "key long, top boolean, bits array<double>, zeros double, ones double, log_w double"
    )


def top_levels(table: pa.Table) -> list:
    """Levels 0 and 1 from the nodes of the pairs."""
    below, zeros, ones, logs = (table.column(c).to_numpy() for c in ("key", "zeros", "ones", "log_w"))
    levels = []
    for depth in (1, 0):
        parent = ((below >> 8) & ((1 << 8 * depth) - 1)) << 8 | (below & 255)
        names, where = np.unique(parent, return_inverse=True)
        zeros, ones = (np.bincount(where, x, len(names)) for x in (zeros, ones))
        logs, share = weigh(names, zeros, ones, below, logs, depth)
        levels.insert(0, (names, zeros, ones, share))
        below = names
    return levels


def with_top(rows: DataFrame, levels: list) -> DataFrame:
    """key, value: log10 of the probability of each n-gram's last byte."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            p = batch.column(1).flatten().to_numpy().reshape(-1, 8)
            total = np.zeros(len(keys))
            for bit in range(8):
                mix = p[:, bit]
                for depth in (1, 0):
                    names, zeros, ones, share = levels[depth]
                    node, value = list(decisions(keys, depth))[bit]
                    if not len(names):
                        mix = np.full(len(keys), 0.5)
                        continue
                    at = np.minimum(np.searchsorted(names, node), len(names) - 1)
                    kt = (np.where(value == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
                    mix = np.where(names[at] == node, share[at] * kt + (1 - share[at]) * mix, 0.5)
                total += np.log10(mix)
            yield pa.record_batch([batch.column(0), pa.array(total)], ["key", "value"])

    return rows.select("key", "bits").mapInArrow(run, "key long, value double")


def frequent(table: DataFrame, count: str) -> pa.Table:
    """The rows with the highest counts, at most FREQUENT of them, sorted by key."""
    histogram = table.groupBy(F.col(count).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(FREQUENT).toArrow()
    least, kept = None, 0
    for c, n in zip(histogram.column("c").to_pylist(), histogram.column("n").to_pylist(), strict=True):
        kept += n
        if kept > FREQUENT:
            break
        least = c
    if least is None:
        return table.limit(0).select("key", "value").toArrow()
    return table.filter(F.col(count) >= least).select("key", "value").toArrow().sort_by("key")


def scored(docs: DataFrame, held_out) -> DataFrame:
    """One row per input row; ``held_out`` is a condition on doc_id that keeps a text from training."""
    text = common.id_and_text(docs).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    spark = docs.sparkSession
    seen = counted(text.select("text", (~F.col("held_out")).alias("train")))
    counts = common.staged(seen.groupBy("kind", "key").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all")), "counts")
    words = counts.filter(f"kind = {WORD} and n_train > 0").select("key", "n_train", "n_all", F.log10(F.col("n_train") + F.lit(1.0)).alias("value"))
    ends = counts.filter(f"kind = {END}").agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0]
    n, v = words.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (1 if ends else 0)
    built = common.staged(trees(counts.filter(f"kind = {GRAM}").select("key", "n_train")), "trees")
    levels = top_levels(built.filter("top").select("key", "zeros", "ones", "log_w").toArrow())
    values = with_top(built.filter("not top"), levels)
    grams = common.staged(
        values.join(counts.filter(f"kind = {GRAM}").select("key", "n_all"), "key").select("key", "value", "n_all"), "gram-values"
    )
    held = spark.sparkContext.broadcast(
        tuple((t.column("key").to_numpy(), t.column("value").to_numpy()) for t in (frequent(words, "n_all"), frequent(grams, "n_all")))
    )
    end_value, per_token = math.log10(ends + 1), math.log10(n + 1 * (v + 1))

    def look_up(table, keys):
        names, found = table
        if not len(names):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        hit = names[at] == keys
        return np.where(hit, found[at], 0.0), hit

    def sums(x, cuts):
        total = np.concatenate([[0.0], np.cumsum(x)])
        return total[cuts[1:]] - total[cuts[:-1]]

    def lists(keys, miss, cuts):
        at = np.concatenate([[0], np.cumsum(miss)])[cuts].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(keys[miss]))

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, offs, buf in tb.slices(batch.column(1), SLICE):
                own_words, first, own_grams, at = stream(offs, buf)
                k = len(offs) - 1
                w, w_hit = look_up(held.value[0], own_words)
                g, g_hit = look_up(held.value[1], own_grams)
                tokens = np.diff(first) + 1
                yield pa.record_batch(
                    [
                        pa.array(uid + np.arange(k)),
                        batch.column(0).slice(lo, k),
                        batch.column(2).slice(lo, k),
                        pa.array(tokens),
                        pa.array(np.rint(sums(w_hit, first)).astype(np.int64) + (1 if ends else 0)),
                        pa.array(sums(w, first) + end_value - tokens * per_token),
                        pa.array(sums(g, at)),
                        pa.array(np.diff(at)),
                        lists(own_words, ~w_hit, first),
                        lists(own_grams, ~g_hit, at),
                    ],
                    ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "value", "n_bytes", "words", "grams"],
                )
                uid += k

    rows = common.staged(
        text.select("doc_id", "text", "held_out").mapInArrow(
            run,
            "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, value double, "
            "n_bytes long, words array<long>, grams array<long>",
        ),
        "scored",
    )
    rare = rows.select("uid", F.lit(WORD).alias("kind"), F.explode("words").alias("key")).union(
        rows.select("uid", F.lit(GRAM).alias("kind"), F.explode("grams").alias("key"))
    )
    known = words.select(F.lit(WORD).alias("kind"), "key", "value").union(grams.select(F.lit(GRAM).alias("kind"), "key", "value"))
    is_word = F.col("kind") == WORD
    rest = (
        rare.join(known, ["kind", "key"])
        .groupBy("uid")
        .agg(
            F.sum(F.when(is_word, 1).otherwise(0)).alias("more_known"),
            F.sum(F.when(is_word, F.col("value")).otherwise(0.0)).alias("more_base"),
            F.sum(F.when(is_word, 0.0).otherwise(F.col("value"))).alias("more_value"),
        )
    )
    zero = F.lit(0)
    out = rows.join(rest, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("value") + F.coalesce("more_value", F.lit(0.0))).alias("score"),
        "n_bytes",
    )
    return common.null_ids(out)


def op7_lm_scoring(spark, sf_dir):
    return scored(common.documents(spark, sf_dir), common.held_out("doc_id", 7, 2))
