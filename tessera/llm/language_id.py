"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

Letters and their scripts are read off the code points (Unicode categories L, with marks M after a letter).
The script of a word's first letter narrows its candidate languages to those that use the script.  Each
candidate scores the word by the log-probabilities of its hashed byte n-grams (word borders included).
Viterbi then labels the words of a text: changing the language between two words costs SWITCH nats, so
stray words do not break a span and a passage in another language makes its own span.  The text's
language is the one with most letters; the score is its share of the letters.

The model is learned from at most TRAIN_ROWS documents (a documented bound, drawn by a hash of the
identifier) and has a fixed number of buckets; every whole text is labelled.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without training rows
every text is ``und``; repeated rows are labelled one by one; a row without an identifier is not held
out; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

TRAIN_ROWS = 8_000
BITS = 18
SIZES = (2, 3, 4, 5)
SWITCH = 8.0
BATCH_BYTES = 1 << 22
UNKNOWN = "und"

#: Scripts by the first code point of their main blocks; letters elsewhere are "other".
SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "han", "hangul", "other")
BLOCKS = {
    "latin": [(0x41, 0x250), (0x1E00, 0x1F00), (0x2C60, 0x2C80), (0xA720, 0xA800), (0xFF21, 0xFF5B)],
    "greek": [(0x370, 0x400), (0x1F00, 0x2000)],
    "cyrillic": [(0x400, 0x530), (0x1C80, 0x1C90), (0x2DE0, 0x2E00), (0xA640, 0xA6A0)],
    "hebrew": [(0x590, 0x600), (0xFB1D, 0xFB50)],
    "arabic": [(0x600, 0x700), (0x750, 0x780), (0x8A0, 0x900), (0xFB50, 0xFE00), (0xFE70, 0xFF00)],
    "indic": [(0x900, 0xE00)],
    "kana": [(0x3040, 0x3100), (0x31F0, 0x3200), (0xFF66, 0xFFA0)],
    "han": [(0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32400)],
    "hangul": [(0x1100, 0x1200), (0x3130, 0x3190), (0xAC00, 0xD7B0)],
}
#: In the table of code points: a mark, which goes on with the word of the letter before it.
MARK = -1
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_STEP = np.random.Generator(np.random.PCG64(17)).integers(1, 2**63, max(SIZES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Model:
    """Log-probabilities of n-gram buckets by language, and the scripts that each language uses."""

    langs: list[str]
    table: np.ndarray
    uses: np.ndarray


@cache
def letters() -> np.ndarray:
    """Script number of each code point that is a letter, MARK of a mark, 0 of anything else."""
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    out = np.where(kinds == "L", SCRIPTS.index("other"), np.where(kinds == "M", MARK, 0)).astype(np.int8)
    for script, blocks in BLOCKS.items():
        for lo, hi in blocks:
            own = out[lo:hi]
            own[own > 0] = SCRIPTS.index(script)
    return out


def words(offs: np.ndarray, buf: np.ndarray):
    """Lower-cased letters, (start, end) of each word, first word of each row, script of each word."""
    low = _FOLD[buf]
    at = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] < 0x9F)) + 1 if len(buf) else np.zeros(0, np.int64)
    low[at[buf[at] != 0x97]] += 0x20
    # Characters beyond ASCII: code point, number of bytes, kind.
    leads = np.flatnonzero(buf >= 0xC0)
    first_byte = buf[leads].astype(np.int64)
    size = 2 + (first_byte >= 0xE0) + (first_byte >= 0xF0)
    point = first_byte & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        point[more] = point[more] << 6 | (buf[leads[more] + k] & 0x3F)
    kind = letters()[point]
    if (kind == MARK).any():
        before = np.where(leads > 0, _FOLD[buf[leads - 1]], 0x20)
        fresh = (before < 0x80) | np.isin(leads, offs)  # no character beyond ASCII of the same row stands before
        letter_before = (before < 0x80) & (before != 0x20) & ~np.isin(leads, offs)
        own = np.where(kind != MARK, kind != 0, letter_before)
        known = np.maximum.accumulate(np.where((kind != MARK) | fresh, np.arange(len(kind)), 0))
        kind = np.where(kind != MARK, kind, np.where(own[known], MARK, 0))
    for k in range(4):
        none = (kind == 0) & (size > k)
        low[leads[none] + k] = 0x20
    starts, ends, first = tb.word_spans(offs, low)
    script = np.full(len(starts), SCRIPTS.index("latin"), np.int64)
    if len(leads):
        beyond = buf[starts] >= 0x80
        script[beyond] = kind[np.searchsorted(leads, starts[beyond])]
    return low, starts, ends, first, script


def grams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(bucket, word) of every n-gram of every word, borders counting as a space."""
    # Words are laid out with one space on each side.
    sizes = ends - starts + 2
    first = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    word = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(total) - first[word]
    inner = (at > 0) & (at < sizes[word] - 1)
    text = np.full(total, 0x20, np.uint8)
    text[inner] = low[(starts[word] + at - 1)[inner]]
    codes = tb._BYTE[text]
    left = sizes[word] - at
    for n in SIZES:
        if total < n:
            continue
        h = np.full(total - n + 1, n, np.uint64)
        for k in range(n):
            h += codes[k : total - n + 1 + k] * _STEP[k]
        fits = left[: len(h)] >= n
        yield (tb.mix(h[fits]) >> np.uint64(64 - BITS)).astype(np.int64), word[: len(h)][fits]


def fit(docs: DataFrame) -> Model:
    """Learn from a bounded table (text, lang)."""
    docs = common.staged(docs.select(F.coalesce("text", F.lit("")).alias("text"), "lang"), "by-language")
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().collect())
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, len(SCRIPTS)), bool))

    def count(batches):
        seen = np.zeros((len(langs), 1 << BITS), np.int32)
        used = np.zeros((len(langs), len(SCRIPTS)), np.int64)
        index = {lang: i for i, lang in enumerate(langs)}
        for batch in batches:
            lang = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            for lo, offs, buf in tb.slices(batch.column(0)):
                low, starts, ends, first, script = words(offs, buf)
                if not len(starts):
                    continue
                of_word = np.repeat(lang[lo : lo + len(offs) - 1], np.diff(first))
                for bucket, word in grams(low, starts, ends):
                    for i in np.unique(of_word):
                        seen[i] += np.bincount(bucket[of_word[word] == i], minlength=1 << BITS).astype(np.int32)
                np.add.at(used, (of_word, script), 1)
        for i in range(len(langs)):
            at = np.flatnonzero(seen[i])
            keys = np.concatenate([at, -1 - np.arange(len(SCRIPTS))])
            n = np.concatenate([seen[i][at].astype(np.int64), used[i]])
            yield pa.record_batch([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys), pa.array(n)], ["lang", "key", "n"])

    total = docs.mapInArrow(count, "lang int, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), 1 << BITS))
    uses = np.zeros((len(langs), len(SCRIPTS)))
    lang, key, n = (total[c].to_numpy() for c in ("lang", "key", "n"))
    grams_at = key >= 0
    counts[lang[grams_at], key[grams_at]] = n[grams_at]
    uses[lang[~grams_at], -1 - key[~grams_at]] = n[~grams_at]
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * (1 << BITS))
    table = np.log(share)
    table -= table.max(axis=0, keepdims=True)
    return Model(langs, np.ascontiguousarray(table.T, np.float32), uses >= 0.001 * uses.sum(axis=1, keepdims=True))


def emissions(model: Model, low, starts, ends, script) -> np.ndarray:
    """Score of each word in each language; all zero where no language uses its script."""
    out = np.zeros((len(starts), len(model.langs)), np.float32)
    for bucket, word in grams(low, starts, ends):
        rows = model.table[bucket]
        for i in range(len(model.langs)):
            out[:, i] += np.bincount(word, rows[:, i], len(starts)).astype(np.float32)
    allowed = model.uses[:, script].T
    out[~allowed] -= 1e3
    out[~allowed.any(axis=1)] = 0
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word; all texts of a batch advance together, word by word."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")
    path = np.zeros(len(scores), np.int32)
    stay = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int32)
    now = np.zeros((len(sizes), scores.shape[1]), np.float32)
    for t in range(longest):
        n = active[t]
        at = begin[:n] + t
        live = now[:n]
        if t:
            best = live.argmax(axis=1)
            change = live[np.arange(n), best] - switch
            kept = live >= change[:, None]
            stay[at], source[at] = kept, best
            live = np.where(kept, live, change[:, None])
        live = live + scores[at]
        now[:n] = live - live.max(axis=1, keepdims=True)
    lang = now.argmax(axis=1).astype(np.int32)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        here = lang[:n]
        path[at] = here
        if t:
            lang[:n] = np.where(stay[at, here], here, source[at])
    return path


def labelled(model: Model, column):
    """Yield (first row, first word of each row, label, start, end of each word, text offsets)."""
    for lo, offs, buf in tb.slices(column, max(tb.SLICE_BYTES, 8 * BATCH_BYTES // max(8, len(model.langs)))):
        parts, firsts, spans, base = [], [np.zeros(1, np.int64)], [], 0
        rows = 0
        while rows < len(offs) - 1:
            upto = max(rows + 1, int(np.searchsorted(offs, offs[rows] + tb.SLICE_BYTES, "right")) - 1)
            own, piece = offs[rows : upto + 1] - offs[rows], buf[offs[rows] : offs[upto]]
            low, starts, ends, first, script = words(own, piece)
            parts.append(emissions(model, low, starts, ends, script) if len(starts) else np.zeros((0, len(model.langs)), np.float32))
            firsts.append(first[1:] + base)
            spans.append((starts + offs[rows], ends + offs[rows]))
            base += len(starts)
            rows = upto
        first = np.concatenate(firsts)
        scores = np.concatenate(parts)
        path = viterbi(scores, first, SWITCH) if scores.size else np.zeros(len(scores), np.int32)
        starts, ends = (np.concatenate(x) for x in zip(*spans, strict=True))
        yield lo, offs, buf, first, path, starts, ends


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, n_spans."""

    def run(batches):
        k = max(1, len(model.langs))
        for batch in batches:
            for lo, offs, buf, first, path, starts, ends in labelled(model, batch.column(1)):
                n = len(offs) - 1
                row = np.repeat(np.arange(n), np.diff(first))
                letters = np.bincount(row * k + path, ends - starts, n * k).reshape(n, k)
                total = letters.sum(axis=1)
                best = letters.argmax(axis=1)
                known = (total > 0) & bool(model.langs)
                names = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, letters[np.arange(n), best] / np.maximum(total, 1), 0.0)
                change = np.ones(len(path), bool)
                change[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
                spans = np.bincount(row, change, n).astype(np.int64)
                yield pa.record_batch([batch.column(0).slice(lo, n), pa.array(names, pa.string()), pa.array(score), pa.array(spans)], ["doc_id", "lang_pred", "score", "n_spans"])

    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return common.null_ids(text.mapInArrow(run, "doc_id long, lang_pred string, score double, n_spans long"))


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, end (bytes of the UTF-8 text), lang: one row per span of one language."""

    def run(batches):
        for batch in batches:
            for lo, offs, _, first, path, starts, ends in labelled(model, batch.column(1)):
                if not len(path) or not model.langs:
                    continue
                row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
                change = np.ones(len(path), bool)
                change[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
                a = np.flatnonzero(change)
                b = np.append(a[1:], len(path)) - 1
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(lo + row[a])),
                        pa.array(starts[a] - offs[row[a]]),
                        pa.array(ends[b] - offs[row[a]]),
                        pa.array([model.langs[i] for i in path[a].tolist()], pa.string()),
                    ],
                    ["doc_id", "start", "end", "lang"],
                )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, start long, end long, lang string"
    )


def held_out():
    return common.held_out("doc_id", 3, 1)


def learned(docs: DataFrame) -> Model:
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & ~held_out()
    )
    share = min(1.0, TRAIN_ROWS / max(1, known.count()))
    return fit(known.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))))


def op4_language_id(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    text = common.id_and_text(docs)
    found = predictions(text, learned(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_spans")
