import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera import __main__ as cli
from tessera.api import ConceptLens, TrainConfig
from tessera.operators import interpret, lens, modes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATTLES = [(f"b{i}", f"ask {i}", f"reply {i} {'apple' if i % 3 == 0 else 'pear'}", f"answer {i} {'apple' if i % 4 == 0 else 'plum'}", float(i % 2)) for i in range(60)]
FIELDS = "battle_id string, prompt string, completion_a string, completion_b string, human_pref double"


def vectors_of(texts):
    """A small embedding that other processes compute alike: letters counted in eight classes."""
    return [np.bincount([ord(c) % 8 for c in t], minlength=8) + 1.0 for t in texts]


def names_apples(requests):
    return ['{"status": "ok", "concept": "mentions an apple", "confidence": "high"}' if "apple" in r else '{"status": "insufficient_evidence"}' for r in requests]


def sees_apples(requests):
    return ["yes" if "apple" in r.split("\n", 1)[1] else "no" for r in requests]


@pytest.fixture(scope="module")
def battles(spark):
    return spark.createDataFrame(BATTLES, FIELDS)


@pytest.fixture(scope="module")
def side_codes(battles):
    side = lambda s: battles.filter(F.col(f"completion_{s}").contains("apple")).select("battle_id", F.lit(0).alias("feature_id"), F.lit(1.0).alias("z"))
    return side("a"), side("b")


def test_units_of_each_mode(spark, battles):
    pair = modes.units(battles, "pairwise").filter("unit_id = 'b3'").first().text
    assert "ask 3" in pair and "reply 3 apple" in pair and "answer 3 plum" in pair
    both = {r.unit_id: r.text for r in modes.units(battles, "individual").collect()}
    assert len(both) == 120 and "reply 3 apple" in both["b3|a"] and "answer" not in both["b3|a"] and "answer 4 apple" in both["b4|b"]
    assert modes.units(battles, "single-text").filter("unit_id = 'b3'").first().text == "ask 3"
    empty = spark.createDataFrame([("x", None, None, None, None)], FIELDS)
    assert modes.units(empty, "single-text").first().text == "" and modes.units(empty, "individual").count() == 2
    with pytest.raises(ValueError):
        modes.units(battles, "other")


def test_single_responses_are_named_and_verified(battles, side_codes):
    reader = modes.Interpreter("individual", verify_share=0.5, n_per_bucket=8)
    names = reader.name(battles, side_codes, names_apples)
    got = names.first()
    fired = sum("apple" in b[2] for b in BATTLES) + sum("apple" in b[3] for b in BATTLES)
    assert (got.concept, got.status) == ("mentions an apple", "ok") and abs(got.fire_rate - fired / 120) < 1e-12
    found = reader.verify(battles, side_codes, names, sees_apples).first()
    assert found.correlation == 1.0 and found.fidelity_pass and found.n_pos_ok == 8 and found.n_neg_ok == 8


def test_negatives_near_the_active_texts(battles, side_codes):
    own = ConceptLens(None, vectors_of).vectors(battles, "individual", "m")
    near = own.select(F.col("row_id").alias(modes.UNIT), F.posexplode("vector").alias("dim", "v"))
    reader = modes.Interpreter("individual", verify_share=0.5, n_per_bucket=6, negatives="close")
    names = battles.sparkSession.createDataFrame([(0, "mentions an apple", "ok")], "feature_id int, concept string, status string")
    assert reader.verify(battles, side_codes, names, sees_apples, vectors=near).first().correlation == 1.0
    with pytest.raises(ValueError):
        reader.verify(battles, side_codes, names, sees_apples)
    with pytest.raises(ValueError):
        modes.Interpreter("pairwise", negatives="close")


def test_tries_are_reconciled_or_voted(spark):
    rows = [(0, "ok", "a b", "low"), (0, "ok", "c d", "high"), (0, "ok", "c d", "low"), (1, "insufficient_evidence", "", ""), (2, "ok", "x y", "low"), (2, "polysemantic", "", "")]
    tries = spark.createDataFrame(rows, "feature_id int, status string, concept string, confidence string")
    silent = {r.feature_id: (r.status, r.concept, r.confidence) for r in modes.reconciled(tries, lambda qs: ["<<ERROR"] * len(qs), "response").collect()}
    assert silent == {0: ("ok", "c d", "high"), 1: ("insufficient_evidence", "", ""), 2: ("ok", "x y", "low")}
    joined = {r.feature_id: r.concept for r in modes.reconciled(tries, lambda qs: ['{"status": "ok", "concept": "both of them"}'] * len(qs), "response").collect()}
    assert joined == {0: "both of them", 1: "", 2: "x y"}
    assert modes.reconciled(tries.limit(0), names_apples, "response").count() == 0


def low_rank(seed=0):
    rng = np.random.default_rng(seed)
    return np.maximum(rng.normal(size=(600, 6)), 0) @ rng.normal(size=(6, 12))


@pytest.mark.parametrize("rule", ["topk", "jump"])
def test_plain_lenses_learn(rule, tmp_path):
    x = low_rank()
    fitted, log = lens.train_plain(x[:500], x[500:], m=24, k=6, rule=rule, epochs=60, batch=64, lr=5e-3)
    z = fitted.project(x)
    assert fitted.info["explained_variance"] > 0.7 and log[-1]["val_loss"] < log[0]["val_loss"]
    if rule == "topk":
        assert ((z != 0).sum(axis=1) <= 6).all()
    else:
        assert ((z == 0) | (z > np.exp(fitted.threshold))).all()
    fitted.save(str(tmp_path / "l"))
    assert np.allclose(lens.Lens.load(str(tmp_path / "l")).project(x), z)
    with pytest.raises(ValueError):
        lens.train_plain(x, rule="other")


def test_lens_from_texts(battles, tmp_path):
    made = ConceptLens.train(battles, vectors_of, str(tmp_path / "l"), m=12, k=3, epochs=5, most=1000)
    z, meta = made.encode_pairs(battles)
    unit = lambda t: (lambda v: v / np.linalg.norm(v))(vectors_of([t])[0])
    head = "Instruct: Represent what is distinctive about the response.\nUser: "
    want = {b[0]: made.lens.project((unit(f"{head}{b[1]}\nAssistant: {b[2]}") - unit(f"{head}{b[1]}\nAssistant: {b[3]}"))[None])[0] for b in BATTLES}
    got = {(r.battle_id, r.feature_id): r.z for r in z.collect()}
    assert set(meta.columns) == {"battle_id", "human_pref"}
    assert all(abs(want[b][f] - v) < 1e-4 for (b, f), v in got.items())
    assert all(abs(v) < made.lens.threshold + 1e-4 for b, row in want.items() for f, v in enumerate(row) if (b, f) not in got)
    with pytest.raises(ValueError):
        made.encode(battles, "battle_id")
    with pytest.raises(ValueError):
        ConceptLens.train(battles, vectors_of, str(tmp_path / "m"), TrainConfig(), m=3)


def test_items_are_pairs_or_single_texts(spark, battles, tmp_path):
    made = ConceptLens.train(battles, vectors_of, str(tmp_path / "l"), input_rep="individual", rule="topk", m=12, k=3, epochs=3)
    pairs, _ = made.encode_items(battles)
    single, _ = made.encode_items(battles.drop("completion_b"))
    a = {(r.battle_id, r.feature_id): r.z for r in single.collect()}
    b = {(r.battle_id, r.feature_id): r.z for r in made.encode(battles, "battle_id", completion="completion_b").collect()}
    want = {k: a.get(k, 0) - b.get(k, 0) for k in {*a, *b} if abs(a.get(k, 0) - b.get(k, 0)) > 1e-12}
    got = {(r.battle_id, r.feature_id): r.z for r in pairs.collect()}
    assert all(abs(got.get(k, 0) - want.get(k, 0)) < 1e-9 for k in {*got, *want})
    with pytest.raises(ValueError):
        made.encode_items(battles.withColumn("completion_b", F.when(F.col("battle_id") != "b3", F.col("completion_b"))))
    made.names = spark.createDataFrame([(1, "z y"), (1, "a b"), (2, None)], "feature_id int, concept string")
    assert made.concept_names() == {1: "a b"}


def test_prompt_lens(battles, tmp_path):
    made = ConceptLens.train(battles, vectors_of, str(tmp_path / "l"), input_rep="prompt", rule="topk", m=12, k=2, epochs=2)
    assert made.encode(battles, "battle_id").groupBy("battle_id").count().agg(F.max("count")).first()[0] <= 2
    with pytest.raises(ValueError):
        made.encode_pairs(battles)


def test_commands_with_a_model_function(spark, battles, side_codes, tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "given_model.py").write_text("def vectors(texts):\n    return [[1.0 + len(t), 2.0, 3.0] for t in texts]\n\n\ndef reply(requests):\n    return ['{\"concept\": \"two words\"}'] * len(requests)\n")
    spark.sparkContext.addPyFile(str(tmp_path / "given_model.py"))
    at = lambda n: str(tmp_path / n)
    battles.write.parquet(at("corpus"))
    side_codes[0].write.parquet(at("codes"))
    cli.main(["embed-corpus", "--corpus", at("corpus"), "--model-function", "given_model:vectors", "--out", at("sides")])
    assert spark.read.parquet(at("sides")).count() == 60
    cli.main(["build-prompt-lens", "--corpus", at("corpus"), "--model-function", "given_model:vectors", "--lens", at("lens"), "--m", "4", "--k", "2", "--rule", "topk"])
    assert lens.Lens.load(at("lens")).info["input_rep"] == "prompt"
    cli.main(["name-prompts", "--corpus", at("corpus"), "--codes", at("codes"), "--model-function", "given_model:reply", "--out", at("names")])
    assert spark.read.parquet(at("names")).first().concept == "two words"
    (tmp_path / "config.json").write_text(json.dumps({"stages": ["relevance"]}))
    cli.main(["run", "--config", at("config.json"), "--corpus", at("corpus"), "--codes", at("codes"), "--out", at("run")])
    assert spark.read.parquet(at("run/relevance")).count() == 1
    assert interpret.parse_concept("") == ""
