from public_tokenizers import path
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, language_id, lm_scoring, near_dedup, packing, quality_rules, substring_dedup, token_files, toxicity


def ids(df):
    return sorted(((r.doc_id is None), r.doc_id) for r in df.collect())


def test_null_identifiers(spark, nameless, tmp_path):
    want = [(False, 4), (True, None), (True, None)]
    byte, word = path("byte_bpe_50k.json"), path("word_bpe_49k.json")
    exact = exact_dedup.exact_groups(nameless)
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact.collect()} == {(4, 4, True), (None, 4, False), (None, None, True)}
    near = near_dedup.near_groups(nameless)
    assert {(r.doc_id, r.component_id, r.kept) for r in near.collect()} == {(4, 4, True), (None, 4, False), (None, None, True)}
    cut = substring_dedup.removed(nameless)
    assert sorted(r.n_removed for r in cut.collect()) == [0, 0, 70]
    assert sorted(len(r.text) > 0 for r in substring_dedup.without_repeats(nameless).collect())[1:] == [True, True]
    token_files.write(nameless, f"file://{tmp_path}/t", word)
    tables = [exact, near, cut, token_files.read(spark, f"file://{tmp_path}/t"), quality_rules.ledger(nameless), bpe.round_trip(nameless, byte), packing.packed(nameless, byte)]
    tables.append(lm_scoring.scored(nameless, F.lit(False)))
    tables.append(toxicity.scores(nameless, toxicity.Model(toxicity.np.zeros(0), 0.0)))
    tables.append(language_id.predictions(nameless, language_id.learned(nameless)))
    for table in tables:
        assert ids(table) == want


def test_passages_of_nameless_texts_are_not_mixed(spark):
    """Two texts without an identifier, each with another passage of a named one."""
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    one, two = words("p", 60), words("q", 70)
    named = " ".join(one + words("m", 20) + two)
    first = words("a", 15) + one + words("b", 25)
    second = words("c", 40) + two + words("d", 5)
    texts = [(3, named), (None, " ".join(first)), (None, " ".join(second))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed) for r in substring_dedup.removed(docs).collect())
    assert got == [(100, 60), (115, 70), (150, 0)]
    cut = {r.text for r in substring_dedup.without_repeats(docs).collect()}
    assert cut == {named, " ".join(words("a", 15) + words("b", 25)), " ".join(words("c", 40) + words("d", 5))}
