import hashlib
import re

from pyspark.sql import functions as F

from tessera.llm import exact_dedup, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines)


def test_ledger_against_brute_force(docs, corpus):
    rows = {r.doc_id: r for r in quality_rules.ledger(docs).collect()}
    assert len(rows) == len(corpus)
    for i, text in corpus:
        r, (n, chars, symbols, dup, rep, lines) = rows[i], measured(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == (n, chars, symbols, dup, rep, lines), i
        fails = [n < 50, 100 * rep > 50 * n, 100 * symbols > 10 * chars, dup > 2 and 100 * dup > 30 * lines, chars < 2 * n, chars > 20 * n]
        assert r.fail_bits == sum(1 << k for k, x in enumerate(fails) if x), i


def test_policies_and_ablation_from_the_ledger(docs):
    rows = quality_rules.ledger(docs).cache()
    for policy in quality_rules.POLICIES:
        kept = {r.doc_id for r in quality_rules.apply_policy(rows, policy).filter("kept").collect()}
        for r in quality_rules.ablation(rows, policy).collect():
            without = quality_rules.mask(policy) & ~quality_rules.BIT[r["rule"]]
            assert r.kept_without == rows.filter(F.col("fail_bits").bitwiseAND(F.lit(without)) == 0).count()
            assert r.kept_without - len(kept) == r.fails_only_this


def groups(texts):
    out = {}
    for i, t in texts:
        out.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return out


def test_exact_groups_against_brute_force(docs, corpus):
    rows = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    for body, ids in groups(corpus).items():
        for i in ids:
            r = rows[i]
            assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), i == min(ids))
            assert r.text_sha256 == hashlib.sha256(body.encode()).hexdigest()


def test_hot_text_is_split_and_joined_again(spark):
    texts = [(i, "hot  text" if i % 3 else f"text {i % 50}") for i in range(900)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    bodies = df.select(exact_dedup.normalised(F.col("text")).alias("body"))
    assert exact_dedup.hot_texts(bodies, 4).count()
    want = {i: (min(ids), len(ids)) for ids in groups(texts).values() for i in ids}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(df).collect()} == want


def test_rows_of_one_identifier(spark):
    """Of equal rows one stays, and a rejected text stays rejected beside another text of its identifier."""
    rows = [(3, "dup", "a"), (5, "own", "b"), (5, "dup", "c"), (7, "same", "d"), (7, "same", "d"), (None, "dup", "e"), (None, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    assert sorted(exact_dedup.kept_rows(df).collect(), key=str) == sorted([rows[0], rows[1], rows[3], rows[6]], key=str)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()]
    assert sorted(got, key=str) == sorted([(3, 3, 3, True), (5, 5, 1, True), (5, 3, 3, False), (7, 7, 2, True), (7, 7, 2, False), (None, 3, 3, False), (None, None, 1, True)], key=str)


def test_repeated_and_empty(repeated, empty):
    rows = exact_dedup.exact_groups(repeated).collect()
    assert len(rows) == repeated.count()
    assert all(r.group_size >= 2 for r in rows)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert quality_rules.ledger(empty).count() == 0
    assert quality_rules.ledger(repeated).count() == repeated.count()
