import json

import pytest

from tessera import schema
from tessera.operators import codes
from tessera.sources import corpus

FIELDS = "prompt string, model_a string, model_b string, completion_a string, completion_b string"


def test_normalize_drops_blank_and_derives_ids(spark):
    raw = spark.createDataFrame([(" p ", "x", "y", "one", "two"), ("p", "x", "y", "one", "two"), ("  ", "x", "y", "a", "b"), ("q", "x", "y", "", "b")], FIELDS)
    rows = corpus.normalize(raw, "s").collect()
    assert len(rows) == 2 and rows[0].battle_id == rows[1].battle_id and rows[0].prompt == "p" and rows[0].language == ""
    with pytest.raises(ValueError, match="missing columns: completion_b"):
        corpus.normalize(raw.drop("completion_b"), "s")


def test_merge_keeps_the_first_source(spark):
    raw = spark.createDataFrame([("p", "x", "y", "one", "two"), ("q", "x", "y", "one", "two")], FIELDS)
    one, two = corpus.normalize(raw.limit(1), "first"), corpus.normalize(raw, "second")
    got = {r.prompt: r.source for r in corpus.merge([one, two]).collect()}
    assert got == {"p": "first", "q": "second"}


def test_judged_battles_flip_and_collapse(spark, tmp_path):
    samples = [
        {"instruction_id": "1", "instruction": "q", "completion_a": "a", "completion_b": "b", "judge_pref": 0.0, "parse_error": False},
        {"instruction_id": "2", "instruction": "q", "completion_a": "a", "completion_b": "b", "judge_pref": 0.75, "parse_error": False},
        {"instruction_id": "2", "instruction": "q", "completion_a": "a", "completion_b": "b", "judge_pref": 0.75, "parse_error": False},
        {"instruction_id": "3", "instruction": "q", "completion_a": "a", "completion_b": "b", "judge_pref": 1.0, "parse_error": True},
        {"instruction_id": "4", "instruction": "q", "completion_a": " ", "completion_b": "b", "judge_pref": 1.0, "parse_error": False},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"per_sample": samples}))
    (tmp_path / "b.json").write_text(json.dumps(samples))
    (tmp_path / "c.json").write_text(json.dumps({"other": 1}))
    for name in ("a", "b"):
        got = {r.instruction_id: r.y_judge for r in corpus.load_judged(spark, f"{tmp_path}/{name}.json").collect()}
        assert got == {"1": 1.0, "2": 0.5}
    with pytest.raises(ValueError):
        corpus.load_judged(spark, f"{tmp_path}/c.json")


def test_conversations(spark):
    message = "array<struct<role:string,content:string>>"
    a = [("system", "s"), ("User", "question"), ("assistant", "first"), ("assistant", "second")]
    raw = spark.createDataFrame([(a, [("user", "question"), ("bot", "other")], "x", "y", " Model_B ")], f"conversation_a {message}, conversation_b {message}, model_a string, model_b string, winner string")
    r = corpus.conversations_to_corpus(raw, "arena").first()
    assert (r.prompt, r.completion_a, r.completion_b, r.human_pref) == ("question", "first", "other", 0.0)


def test_forms_of_conversations(spark):
    parts = "struct<messages:array<struct<role:string,content:array<struct<text:string,kind:string>>>>>"
    a = ([("user", [("hello", "t"), (None, "image"), ("there", "t")]), ("ai", [("one", "t")])],)
    plain = [("user", "x"), ("gpt", "two")]
    raw = spark.createDataFrame([(a, plain, "m", "n", "n", False, ["open", "ing"])], f"conversation_a {parts}, conversation_b array<struct<role:string,content:string>>, model_a_name string, model_b_name string, chosen_model_name string, both_equal boolean, opening_msg array<string>")
    named = raw.withColumnsRenamed({"model_a_name": "model_a", "model_b_name": "model_b"})
    r = corpus.conversations_to_corpus(named, "s").first()
    assert (r.prompt, r.completion_a, r.completion_b) == ("hello\nthere", "one", "two")


def test_arenas(spark, tmp_path):
    message = "array<struct<role:string,content:string>>"
    raw = spark.createDataFrame([([("bot", "a1")], [("bot", "b1")], "m", "n", "n", False, "question")], f"conversation_a {message}, conversation_b {message}, model_a_name string, model_b_name string, chosen_model_name string, both_equal boolean, opening_msg string")
    raw.write.parquet(f"{tmp_path}/dump.parquet")
    r = corpus.load_arena(spark, "comparia", f"{tmp_path}/dump.parquet", keep_labels=True).first()
    assert (r.prompt, r.model_a, r.completion_b, r.human_pref, r.source) == ("question", "m", "b1", 0.0, "comparia")
    assert "human_pref" not in corpus.load_arena(spark, "comparia", f"{tmp_path}/dump.parquet").columns
    with pytest.raises(ValueError, match="known"):
        corpus.load_arena(spark, "other", "x.parquet")


def test_scores_and_tables(spark, tmp_path):
    scored = spark.createDataFrame([("7", "3", "1", "x"), (None, None, "2", "2")], "style_A string, style_B string, tone_A string, tone_B string")
    assert corpus.criteria(scored.columns) == ["style", "tone"]
    assert [r.human_pref for r in corpus.judge_scores(scored).collect()] == [1.0, 0.5]
    said = spark.createDataFrame([("<think>score_a: 9</think> score_a: 3 score_b: 8",), ("nothing",)], "judge_completion string")
    assert [r.human_pref for r in corpus.judge_scores(said).collect()] == [0.0, None]
    table = spark.createDataFrame([("q", "r", float("nan"))], "`the prompt` string, ans string, p double")
    assert corpus.mapped(table, prompt="the prompt", a="ans", pref="p").first().human_pref is None
    with pytest.raises(ValueError, match="missing"):
        corpus.mapped(table, prompt="nope", a="ans")
    with pytest.raises(ValueError, match="parquet"):
        corpus.load_table(spark, "x.txt")
    scored.write.parquet(f"{tmp_path}/t.parquet")
    assert corpus.load_table(spark, f"{tmp_path}/t.parquet").count() == 2


def test_orientation(spark):
    battles = spark.createDataFrame(
        [("1", "X", "Y", "a b c", "d", 1.0), ("2", "Y", "X", "a", "b", 0.0), ("3", "X", "X", "a", "b", 0.5), ("4", "Z", "Y", "a", "b", None)],
        "battle_id string, model_a string, model_b string, completion_a string, completion_b string, human_pref double",
    )
    meta = {r.row_id: r for r in codes.oriented(battles).collect()}
    assert len(meta) == 8 and (meta["1|a"].length, meta["1|b"].length) == (2, -2)
    assert (meta["1|b"].win, meta["2|b"].self_model, meta["2|b"].win) == (0.0, "X", 1.0)
    own = {r.battle_id: (r.sign, r.outcome) for r in codes.orient_to_model(battles, "X").collect()}
    assert own == {"1": (1, "win"), "2": (-1, "win"), "3": (1, "tie")}
    z = spark.createDataFrame([("1", 0, 1.0), ("1", 1, -2.0), ("2", 0, 3.0), ("3", 0, 5.0), ("4", 0, 7.0)], "battle_id string, feature_id int, z double")
    assert {(r.battle_id, r.feature_id): r.z for r in codes.orient_by_label(z, battles).collect()} == {("1", 0): 1.0, ("1", 1): -2.0, ("2", 0): -3.0}
    bad = battles.withColumn("human_pref", battles.human_pref * 0.6)
    with pytest.raises(Exception, match="labels must be"):
        codes.oriented(bad).collect()
    assert schema.has_preference(battles) and not schema.has_preference(battles.drop("human_pref"))
    assert schema.canonical(spark.createDataFrame([(1, 2)], "response int, label int")).columns == ["completion_a", "human_pref"]
