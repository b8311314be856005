import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import language_id, lm_scoring, toxicity
from tessera.llm import textbytes as tb

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_toxicity_finds_held_out_documents(spark):
    rnd = random.Random(0)
    bad, clean = ["worthless", "disgusting", "pathetic"], ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        words = rnd.choices(clean, k=60)
        toxic = int(i % 6 == 0)
        if toxic:
            words[rnd.randrange(60)] = rnd.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    rows += [(1000, None), (1001, ""), (1002, "  ")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learned(docs, marks)
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (labels[i][2] == 1) for i in held]) > 0.97
    assert 0 < got[1000] == got[1001] < 0.5
    column = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score_of(model)("text").alias("s")).collect()}
    assert all(abs(column[i] - got[i]) < 1e-12 for i in got)


def test_toxicity_without_labels_or_rows(spark, docs, empty):
    none = spark.createDataFrame([(1, None, None), (2, 1, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.learned(docs, none)
    assert {r.score for r in toxicity.scores(docs, model).collect()} == {0.5}
    assert toxicity.scores(empty, model).count() == 0


def brute_path(scores, switch):
    best, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(len(best)), key=lambda k: best[k])
        back.append([k if best[k] >= best[top] - switch else top for k in range(len(best))])
        best = [max(best[k], best[top] - switch) + row[k] for k in range(len(best))]
    at = max(range(len(best)), key=lambda k: best[k])
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    return max(best), path[::-1]


def value(scores, path, switch):
    return sum(s[k] for s, k in zip(scores, path, strict=True)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 7, 40, 3, 0, 25]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(first[-1], 3)).astype(np.float32)
    path = language_id.viterbi(scores, first, 1.5)
    for a, b in zip(first, first[1:], strict=False):
        if b > a:
            best, _ = brute_path(scores[a:b].tolist(), 1.5)
            assert abs(value(scores[a:b].tolist(), path[a:b].tolist(), 1.5) - best) < 1e-3


def test_language_of_texts_and_spans(spark, docs, empty):
    rnd = random.Random(0)
    vocab = {"en": ["the", "with", "thing", "other", "water", "which"], "fr": ["où", "été", "leur", "français", "être", "voilà"], "ru": ["это", "вода", "слово", "другой"]}
    rows = [(i, " ".join(rnd.choices(vocab[lang], k=30)), lang) for i, lang in enumerate(random.Random(1).choices(list(vocab), k=300))]
    mixed = " ".join(rnd.choices(vocab["en"], k=30)) + ". " + " ".join(rnd.choices(vocab["fr"], k=12))
    train = spark.createDataFrame(rows + [(900, mixed, None), (901, None, "en"), (902, "123 ?!", "fr"), (903, "漢字だけ", None)], "doc_id long, text string, lang string")
    model = language_id.learned(train)
    got = {r.doc_id: r for r in language_id.predictions(train.select("doc_id", "text"), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert (got[901].lang_pred, got[902].lang_pred, got[901].score) == ("und", "und", 0.0)
    assert got[900].lang_pred == "en" and 0.5 < got[900].score < 1
    spans = [r for r in language_id.spans(train.select("doc_id", "text"), model).collect() if r.doc_id == 900]
    assert [r.lang for r in sorted(spans, key=lambda r: r.start)] == ["en", "fr"]
    assert language_id.predictions(docs, model).count() == docs.count()
    assert language_id.predictions(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.predictions(docs, language_id.learned(empty)).collect()} == {"und"}


def normal(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return WORD.findall(low)


def ctw(train, query, depth):
    """log10 of the probability of each query by a plain recursion over all contexts."""
    counts = {}

    def walk(words):
        data = b"\n" * depth + b" ".join(words) + b"\n"
        for p in range(depth, len(data)):
            for bit in range(8):
                yield data[p - depth : p], 1 << bit | data[p] >> (8 - bit), data[p] >> (7 - bit) & 1

    for words in train:
        for context, node, bit in walk(words):
            for d in range(depth + 1):
                counts.setdefault((context[depth - d :], node), [0, 0])[bit] += 1
    kt = lambda c: math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi)
    children = {}
    for context, node in counts:
        if context:
            children.setdefault((context[1:], node), []).append((context, node))
    weight = {}

    def log_w(key):
        own = kt(counts[key])
        if len(key[0]) == depth:
            weight[key] = 1.0
            return own
        below = sum(log_w(c) for c in children[key])
        both = np.logaddexp(own, below) + math.log(0.5)
        weight[key] = math.exp(own + math.log(0.5) - both)
        return both

    for node in {n for c, n in counts if not c}:
        log_w((b"", node))
    out = []
    for words in query:
        total = 0.0
        for context, node, bit in walk(words):
            p = 0.5
            for d in range(depth, -1, -1):
                key = (context[depth - d :], node)
                if key not in counts:
                    p = 0.5
                    continue
                c = counts[key]
                p = weight[key] * (c[bit] + 0.5) / (sum(c) + 1) + (1 - weight[key]) * p
            total += math.log10(p)
        out.append(total)
    return out


def test_scores_against_brute_force(docs, corpus, monkeypatch):
    held = {i for i, _ in corpus if i % 7 == 2}
    rows = {r.doc_id: r for r in lm_scoring.scored(docs, F.pmod("doc_id", F.lit(7)) == 2).collect()}
    words = {i: normal(t) for i, t in corpus}
    train = [i for i in words if i not in held]
    counts = Counter(w for i in train for w in words[i])
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    some = [0, 2, 9, 60, 70, *[i for i, t in corpus[-13:-1]]]
    want = dict(zip(some, ctw([words[i] for i in train], [words[i] for i in some], lm_scoring.DEPTH), strict=True))
    for i in words:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[i]) + math.log10((len(train) + 1) / (n + v + 1))
        assert abs(rows[i].base_score - base) < 1e-6 * abs(base)
        assert (rows[i].n_tokens, rows[i].train_tokens, rows[i].n_known) == (len(words[i]) + 1, n, sum(w in counts for w in words[i]) + 1)
        if i in want:
            assert abs(rows[i].score - want[i]) < 1e-6 * abs(want[i]), i


def test_rare_words_are_joined(docs, monkeypatch):
    whole = {r.doc_id: (r.n_known, r.base_score, r.score) for r in lm_scoring.scored(docs, F.pmod("doc_id", F.lit(7)) == 2).collect()}
    monkeypatch.setattr(lm_scoring, "FREQUENT", 40)
    for r in lm_scoring.scored(docs, F.pmod("doc_id", F.lit(7)) == 2).collect():
        assert r.n_known == whole[r.doc_id][0]
        assert np.allclose((r.base_score, r.score), whole[r.doc_id][1:], rtol=1e-9)


def test_scores_of_empty_and_untrained(docs, empty, spark):
    assert lm_scoring.scored(empty, F.lit(False)).count() == 0
    one = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.scored(one, F.lit(True)).collect()}
    assert abs(got[1].score - 3 * 8 * math.log10(0.5)) < 1e-9 and abs(got[2].score - 8 * math.log10(0.5)) < 1e-9
    assert (got[1].base_score, got[1].n_known, got[1].train_tokens) == (0.0, 0, 0)


def bucket_of(gram, steps, codes, bits):
    h = len(gram)
    for step, c in zip(steps, gram, strict=False):
        h = (h + int(codes(c)) * int(step)) % (1 << 64)
    return int(tb.mix(np.array([h], np.uint64))[0]) >> (64 - bits)


def test_toxicity_against_brute_force(spark, monkeypatch):
    """Weights of a plain logistic regression on sets of character n-grams, one text at a time."""
    monkeypatch.setattr(toxicity, "PASSES", 80)
    rnd = random.Random(2)
    clean = ["".join(rnd.choices("abcdeéж漢", k=4)) for _ in range(40)]
    texts = [" ".join(rnd.choices(clean, k=12)) for _ in range(60)]
    toxic = [int(i % 4 == 0) for i in range(60)]
    texts = [t + "\tВздор Ünfug" * y for t, y in zip(texts, toxic, strict=True)]
    rows = [(i, t, y) for i, (t, y) in enumerate(zip(texts, toxic, strict=True))]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("text", "toxic"))

    code = lambda c: tb.mix(np.array([ord(c) + 1], np.uint64))[0]

    def grams(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text)
        return {bucket_of(low[k : k + n], toxicity._STEP, code, toxicity.BITS) for n in toxicity.SIZES for k in range(len(low) - n + 1)}

    sets = [grams(t) for t in texts]
    names = sorted(set().union(*sets))
    x = np.array([[b in s for b in names] for s in sets], float)
    y = np.array(toxic)
    ratio = np.log((x[y == 1].sum(axis=0) + 0.5) / (y.sum() + 1)) - np.log((x[y == 0].sum(axis=0) + 0.5) / ((1 - y).sum() + 1))
    kernel, a, b = (x * ratio) @ (x * ratio).T, np.zeros(60), 0.0
    for _ in range(200):  # Newton's method for miss + L2 a = 0, sum of misses = 0; weights are scaled.T @ a
        p = 1 / (1 + np.exp(-(kernel @ a + b)))
        slope = p * (1 - p)
        matrix = np.block([[slope[:, None] * kernel + toxicity.L2 * np.eye(60), slope[:, None]], [slope[None, :] @ kernel, slope.sum()[None, None]]])
        move = np.linalg.solve(matrix, -np.append(p - y + toxicity.L2 * a, (p - y).sum()))
        a, b = a + 0.5 * move[:-1], b + 0.5 * move[-1]
    want = 1 / (1 + np.exp(-(kernel @ a + b)))
    got = {r.doc_id: r.score for r in toxicity.scores(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), model).collect()}
    assert max(abs(got[i] - want[i]) for i in got) < 1e-3


def test_very_long_texts_have_the_features_of_their_whole(monkeypatch):
    rnd = random.Random(3)
    text = "".join(rnd.choices("abcé漢🙂 \n", k=5000))
    whole = sorted(next(toxicity.features(pa.array([text]))).tolist())
    monkeypatch.setattr(toxicity, "PIECE", 301)
    assert sorted(next(toxicity.features(pa.array([text]))).tolist()) == whole


def split_words(text):
    out, now = [], ""
    for c in text or "":
        kind = unicodedata.category(c)[0]
        if kind == "L" or kind == "M" and now:
            now += c
        else:
            out, now = out + [now] * bool(now), ""
    return out + [now] * bool(now)


def test_language_query_against_brute_force(spark):
    """Words, scores, narrowing, path and share of one text at a time; the learned table is taken as it is."""
    rnd = random.Random(4)
    vocab = {"en": ["the", "With", "thing", "water"], "fr": ["où", "Été", "leur", "être"], "ru": ["это", "вода", "Слово"], "hi": ["क्या", "पानी", "है"]}
    rows = [(i, " ".join(rnd.choices(vocab[lang], k=20)), lang) for i, lang in enumerate(rnd.choices(list(vocab), k=160))]
    odd = ["🙂", "。、", "×÷", "٣٤", "ªº", "漢字", "", None, "́", "été 漢字 вода " * 3, "the the où où où это"]
    odd += [" ".join(rnd.choices([w for v in vocab.values() for w in v] + ["1", "×", "🙂"], k=25)) for _ in range(40)]
    docs = spark.createDataFrame(rows + [(1000 + k, t, None) for k, t in enumerate(odd)], "doc_id long, text string, lang string")
    model = language_id.learned(docs)
    got = {r.doc_id: r for r in language_id.predictions(docs.select("doc_id", "text"), model).collect()}
    low = str.maketrans({chr(c): chr(c + 32) for c in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]})
    for i, text, _ in rows + [(1000 + k, t, None) for k, t in enumerate(odd)]:
        words = split_words(text)
        if not words:
            assert (got[i].lang_pred, got[i].score, got[i].n_spans) == ("und", 0.0, 0), text
            continue
        scores = []
        for w in words:
            data = b" " + w.translate(low).encode() + b" "
            row = np.zeros(len(model.langs))
            for n in language_id.SIZES:
                for k in range(len(data) - n + 1):
                    row += model.table[bucket_of(data[k : k + n], language_id._STEP, lambda c: tb._BYTE[c], language_id.BITS)]
            uses = model.uses[:, language_id.letters()[ord(w[0])]]
            scores.append(np.where(uses, row, row - 1e3) if uses.any() else row * 0)
        _, path = brute_path([s.tolist() for s in scores], language_id.SWITCH)
        letters = np.bincount(path, [len(w.encode()) for w in words], len(model.langs))
        assert got[i].lang_pred == model.langs[letters.argmax()], text
        assert abs(got[i].score - letters.max() / letters.sum()) < 1e-9


def test_many_languages_keep_their_numbers():
    scores = np.zeros((6, 200), np.float32)
    scores[:, 150] = 1
    assert language_id.viterbi(scores, np.array([0, 6]), 1.0).tolist() == [150] * 6


def test_held_out_rules_of_the_queries(spark, tmp_path):
    """The registered queries hold out by crc32 of the identifier; a row without one is not held out."""
    from tessera.llm import queries

    rows = [(i, f"text number {i} with words " * 4, "en" if i % 2 else "fr", "s", 9) for i in range(60)] + [(None, "nameless words", "en", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 3 // 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    made = queries.queries()
    for name, parts, part in (("op4_language_id", 3, 1), ("op7_lm_scoring", 7, 2), ("op9_toxicity", 5, 0)):
        got = {r.doc_id: r.held_out for r in made[name](spark, f"file://{tmp_path}").collect()}
        assert got == {i: i is not None and zlib.crc32(str(i).encode()) % parts == part for i, *_ in rows}, name
