"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed character n-grams of the lower-cased text in a table of 2^BITS
buckets; every bucket has a weight.  The log-count ratio of a feature, ln(share of toxic texts that have it
/ share of the others), scales its column; a logistic regression with an L2 penalty is fitted on the
scaled columns by L-BFGS.  Each step sums gradients where the staged features lie: a task hands on one
array of 2^BITS numbers, however many rows it read, and PARTS tasks read the bounded draw.

The model is learned from about TRAIN_TOXIC toxic and TRAIN_CLEAN other labelled rows at most (documented
bounds, drawn by a hash of the identifier; the intercept is set back to the shares of all labels); every
whole text is scored, in pieces of PIECE bytes, so a very long text costs no more memory than a short one.

Defined cases: a null or empty text has no feature and gets the score of the intercept; several labels
of one identifier count as toxic if one is; labels other than 0 and 1 are left out; with one class or
no labels the score is the (smoothed) share of toxic labels; repeated rows are scored one by one; a row
without an identifier has no label and is not held out; an empty table gives an empty result; no
other column is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

SIZES = (3, 4, 5, 6)
BITS = 19
TRAIN_TOXIC = 3_000
TRAIN_CLEAN = 5_000
#: Tasks that the bounded draw is read by.
PARTS = 8
#: Bytes of text worked on at once: four n-gram sizes hold some 100 bytes per byte of text.
PIECE = 1 << 18
L2 = 1.0
#: L-BFGS: most passes over the draw, and how many steps it remembers.
PASSES, MEMORY = 16, 4
_STEP = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, max(SIZES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Model:
    """A weight per bucket (none: all zero), and the intercept."""

    weights: np.ndarray
    intercept: float


def characters(buf: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes, A-Z lower-cased, white space as a space."""
    chars = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    chars[(chars >= 0x41) & (chars <= 0x5A)] += np.uint64(0x20)
    chars[(chars >= 0x09) & (chars <= 0x0D)] = 0x20
    return chars


def buckets_of(chars: np.ndarray) -> list[np.ndarray]:
    """Per size, the bucket of the n-gram that starts at each character."""
    codes = tb.mix(chars + np.uint64(1))
    out = []
    for n in SIZES:
        k = max(0, len(chars) - n + 1)
        h = np.full(k, n, np.uint64)
        for i in range(n):
            h += codes[i : i + k] * _STEP[i]
        out.append((tb.mix(h) >> np.uint64(64 - BITS)).astype(np.int32))
    return out


def features(column):
    """Yield the distinct buckets of each text."""
    stamp = np.zeros(1 << BITS, np.int32)

    def distinct(buckets):
        """Each bucket once: the last one that left its place in the stamp."""
        at = np.arange(len(buckets), dtype=np.int32)
        stamp[buckets] = at
        return buckets[stamp[buckets] == at]

    for _, offs, buf in tb.slices(column, PIECE):
        if len(buf) > PIECE:
            yield long_features(buf)
            continue
        cuts = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offs].tolist()
        found = buckets_of(characters(buf))
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield distinct(np.concatenate([own[a : max(a, b - n + 1)] for n, own in zip(SIZES, found, strict=True)]))


def long_features(buf: np.ndarray) -> np.ndarray:
    """The distinct buckets of one long text; pieces overlap by the longest n-gram."""
    seen = np.zeros(1 << BITS, bool)
    leads = lambda at: at + int(np.argmax((buf[at : at + 4] & 0xC0) != 0x80)) if at < len(buf) else len(buf)
    for at in range(0, len(buf), PIECE):
        for own in buckets_of(characters(buf[leads(at) : leads(at + PIECE + 4 * max(SIZES))])):
            seen[own] = True
    return np.flatnonzero(seen).astype(np.int32)


def chosen_labels(labels: DataFrame, held_out) -> tuple[DataFrame, float]:
    """doc_id, toxic of a bounded draw of labelled documents that are not held out, and the log-odds
    that the draw adds to those of all labels."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("toxic in (0, 1) and doc_id is not null")
        .filter(~held_out)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    sides = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {side: min(1.0, most / max(1, sides.get(side, 0))) for side, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))}
    limit = F.when(F.col("toxic") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30)))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit)
    return drawn, float(np.log(share[1] / share[0]))


def summed(rows: DataFrame, add, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the rows of a table: ``add(total, few, batch)`` adds a batch to kinds x 2^BITS numbers and to two more.

    Every task hands on one array, and there are PARTS tasks.
    """

    def run(batches):
        total, few = np.zeros((kinds, 1 << BITS)), np.zeros(2)
        for batch in batches:
            add(total, few, batch)
        yield pa.record_batch([pa.array([total.astype(np.float32).tobytes()], pa.binary()), pa.array([few.tolist()], pa.list_(pa.float64()))], ["total", "few"])

    total, few = np.zeros((kinds, 1 << BITS)), np.zeros(2)
    got = rows.coalesce(PARTS).mapInArrow(run, "total binary, few array<double>").toArrow()
    for blob, own in zip(*got.columns, strict=True):
        total += np.frombuffer(blob.as_buffer(), np.float32).reshape(total.shape)
        few += own.as_py()
    return total, few


def featured(texts: DataFrame) -> DataFrame:
    """toxic, cols (distinct buckets, 32 bits each) of a bounded table (text, toxic)."""

    def run(batches):
        for batch in batches:
            rows = [own.tobytes() for own in features(batch.column(0))]
            yield pa.record_batch([batch.column(1), pa.array(rows, pa.binary())], ["toxic", "cols"])

    return texts.select(F.coalesce("text", F.lit("")).alias("text"), "toxic").mapInArrow(run, "toxic int, cols binary")


def entries(batch):
    """(labels, row of each feature, its bucket) of a batch of ``featured``."""
    y, lists = batch.column(0).to_numpy(), [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(1)]
    return y, np.repeat(np.arange(len(y)), [len(x) for x in lists]), np.concatenate(lists) if lists else np.zeros(0, np.int32)


def fit(texts: DataFrame) -> Model:
    """Learn from a bounded table (text, toxic)."""
    rows = common.staged(featured(texts), "labelled")

    def count(total, few, batch):
        y, row, cols = entries(batch)
        for side in (0, 1):
            total[side] += np.bincount(cols[y[row] == side], minlength=1 << BITS)
            few[side] += (y == side).sum()

    (no, yes), (n_no, n_yes) = summed(rows, count, 2)
    base = float(np.log((n_yes + 1) / (n_no + 1)))
    if not n_yes or not n_no:
        return Model(np.zeros(0), base)
    ratio = np.log((yes + 0.5) / (n_yes + 1)) - np.log((no + 0.5) / (n_no + 1))
    ratio[yes + no == 0] = 0

    def loss_and_slope(at: np.ndarray):
        """Mean loss and its gradient at (weights, intercept)."""
        scaled, intercept = (at[:-1] * ratio).astype(np.float32), at[-1]

        def add(total, few, batch):
            y, row, cols = entries(batch)
            z = np.bincount(row, scaled[cols], len(y)) + intercept
            miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            total[0] += np.bincount(cols, miss[row], 1 << BITS)
            few += [miss.sum(), (np.logaddexp(0, z) - y * z).sum()]

        (slope,), (slope_0, loss) = summed(rows, add, 1)
        n = n_yes + n_no
        return (loss + 0.5 * L2 * float(at[:-1] @ at[:-1])) / n, np.append(slope * ratio + L2 * at[:-1], slope_0) / n

    found = lbfgs(loss_and_slope, np.append(np.zeros(1 << BITS), base))
    return Model(found[:-1] * ratio, float(found[-1]))


def lbfgs(value_and_slope, at: np.ndarray) -> np.ndarray:
    """A minimum by limited-memory BFGS with halved steps, in at most PASSES evaluations."""
    value, slope = value_and_slope(at)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    passes = 1
    while passes < PASSES and np.abs(slope).max() > 1e-6:
        way, kept = -slope, []
        for s, y in reversed(steps):
            a = (s @ way) / (s @ y)
            way = way - a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            way = way * ((s @ y) / (y @ y))
        else:
            way = way / max(1e-12, np.linalg.norm(slope))
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            way = way + s * (a - (y @ way) / (s @ y))
        size = 1.0
        while True:
            new_value, new_slope = value_and_slope(at + size * way)
            passes += 1
            if new_value <= value + 1e-4 * size * float(slope @ way) or passes >= PASSES:
                break
            size /= 2
        if new_value > value:
            break
        move, turn = size * way, new_slope - slope
        if move @ turn > 1e-12:
            steps = [*steps, (move.astype(np.float32), turn.astype(np.float32))][-MEMORY:]
        at, value, slope = at + move, new_value, new_slope
        del way, move, turn
    return at


def score_batch(model: Model, column) -> np.ndarray:
    z = np.array([model.weights[own].sum() if len(model.weights) else 0.0 for own in features(column)]) + model.intercept
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(score_batch(model, batch.column(1)), pa.float64())], ["doc_id", "score"])

    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return common.null_ids(text.mapInArrow(run, "doc_id long, score double"))


def score_of(model: Model):
    """A column function: the score of a text column, so that filters keep a row's other columns."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(score_batch(model, texts.fill_null("")), pa.float64())

    return score


def held_out(doc_id="doc_id"):
    return common.held_out(doc_id, 5, 0)


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    text = common.id_and_text(docs)
    drawn, added = chosen_labels(labels, held_out())
    model = fit(text.join(F.broadcast(drawn), "doc_id"))
    model.intercept -= added
    return model


def op9_toxicity(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    found = scores(common.id_and_text(docs), learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
