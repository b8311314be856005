import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster, codes, conditional, diagnose, elicit, export, interpret, lens, logistic, relevance, select, validate
from tessera.plans import pipeline, registry
from tessera.streaming import incremental


def long(spark, matrix, key="battle_id"):
    rows = [(str(i), f, float(z)) for i, r in enumerate(matrix) for f, z in enumerate(r) if z]
    return spark.createDataFrame(rows, f"{key} string, feature_id int, z double")


def labels(spark, y, **more):
    rows = [(str(i), None if v is None else float(v), *[c[i] for c in more.values()]) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "battle_id string, human_pref double" + "".join(f", {k} double" for k in more))


def test_relevance_by_hand_and_silent_features(spark):
    z = long(spark, [[2, 0], [1.5, 0], [-2, 0], [-1, 3]])
    got = {r.feature_id: r for r in relevance.win_relevance(z, labels(spark, [1, 1, 0, 0])).collect()}
    r = got[0]
    assert (r.n_fire, r.win_rate_a_more, r.win_rate_a_less, r.win_assoc) == (4, 1.0, 0.0, 1.0) and abs(r.correlation - 1) < 1e-9 and r.sign == 1
    assert got[1].correlation is None and not got[1].significant and got[1].fire_rate == 0.25


def test_streamed_counts_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    z, y = long(spark, np.round(rng.normal(size=(60, 3)), 1)), labels(spark, rng.integers(0, 2, 60))
    coded = z.join(y, "battle_id")
    coded.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(coded.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = incremental.relevance_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = {r.feature_id: r for r in incremental.relevance(spark.table("counts"), 60).collect()}
    for r in relevance.win_relevance(z, y, p_values=False).collect():
        assert abs(got[r.feature_id].win_assoc - r.win_assoc) < 1e-12 and abs(got[r.feature_id].correlation - r.correlation) < 1e-12


def test_dataset_effects(spark):
    z = long(spark, [[10, 0, 0], [1, 1, 1], [0, 0, 5], [0, 0, 0]])
    rows = labels(spark, [1, 1, 1, 1])
    bad = spark.createDataFrame([(0,)], "feature_id int")
    share = {r.battle_id: r.spurious_share for r in relevance.spurious_share(z, rows, bad).collect()}
    assert share["0"] == 1 and abs(share["1"] - 1 / 3) < 1e-12 and share["2"] == 0 and share["3"] == 0
    signs = long(spark, [[1, -1], [1, 1], [1, -1], [1, -1]])
    assert {r.feature_id: r.effect for r in relevance.dataset_reward(signs, 4).collect()} == {0: 1.0, 1: -0.5}
    g = labels(spark, [1, 1, 0, 0], g=[4.0, 2.0, -2.0, -4.0])
    corr = {r.feature_id: r.corr for r in relevance.confound_correlation(long(spark, [[1, 2], [1, 2], [-1, 2], [-1, 2]]), g, "g").collect()}
    assert corr[0] > 0.9 and corr[1] is None
    assert [r.feature_id for r in relevance.auto_undesirable(relevance.confound_correlation(long(spark, [[1], [1], [-1], [-1]]), g, "g")).collect()] == [0]


def test_planted_edge_is_found(spark):
    rng = np.random.default_rng(0)
    zp = (rng.random((300, 4)) < 0.4) * 1.0
    za = (rng.random((300, 5)) < 0.2) * 1.0
    za[:, 2] = np.where(zp[:, 1] > 0, (rng.random(300) < 0.8), (rng.random(300) < 0.1)) * 1.0
    edges = elicit.elicitation(long(spark, zp), long(spark, za), long(spark, za), 300).filter("significant").collect()
    assert [(e.prompt_feature, e.completion_feature) for e in edges if e.lift > 1.5] == [(1, 2)]
    pairs = elicit.mutual_information(long(spark, za), 300)
    assert pairs.count() == 10 and pairs.filter("mi < -1e-12").count() == 0


def test_hot_features_fit_alike_by_aggregates(spark, monkeypatch, by="kind"):
    rng = np.random.default_rng(5)
    z = np.round(rng.normal(size=(240, 4)) * (rng.random((240, 4)) < 0.6), 2)
    y = (rng.random(240) < 1 / (1 + np.exp(-z[:, 0]))).astype(int)
    z[:, 2] = np.where(y == 1, 1.0, -1.0)  # separable
    z[:, 3] = 1.0  # the same everywhere: no fit
    rows = labels(spark, y, length=[float(x) for x in rng.integers(-9, 9, 240)], kind=[float(i % 2) for i in range(240)])
    results = []
    for hot_rows in (1_000_000, 65):
        monkeypatch.setattr(logistic, "HOT_ROWS", hot_rows)
        out = logistic.controlled(long(spark, z), rows, by=by).collect()
        results.append({(r[by], r.feature_id): r for r in out})
    assert len(results[0]) == 8 and results[0][1.0, 2].separable
    for other in results[1:]:
        assert other.keys() == results[0].keys()
        for k, r in results[0].items():
            for c in ("beta", "delta_win_rate", "lr_chi2", "lr_p"):
                assert other[k][c] == (None if r[c] is None else pytest.approx(r[c], rel=1e-5, abs=1e-7)), (k, c)
            assert (r.separable, r.n_battles, r.n_fire, r.significant) == (other[k].separable, other[k].n_battles, other[k].n_fire, other[k].significant)


def test_logistic_finds_the_effect_and_separation(spark):
    rng = np.random.default_rng(1)
    n = 800
    length = rng.integers(-20, 20, n).astype(float)
    z = rng.normal(size=(n, 2)) * (rng.random((n, 2)) < 0.4)
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.2 * z[:, 0] + 0.03 * length)))).astype(float)
    out = {r.feature_id: r for r in logistic.controlled(long(spark, z), labels(spark, y, length=length.tolist())).collect()}
    assert out[0].beta > 0.3 and out[0].significant and not out[1].significant
    x = np.stack([np.ones(n), (z[:, 0] - z[:, 0].mean()) / z[:, 0].std(), (length - length.mean()) / length.std()], 1)
    b = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    assert abs(out[0].beta - b[1]) < 1e-4
    sep = logistic.controlled(long(spark, [[1.0]] * 20 + [[-1.0]] * 20), labels(spark, [1] * 20 + [0] * 20, length=[0.0] * 40)).first()
    assert sep.separable and sep.lr_p is None and sep.delta_win_rate is not None


def test_pool_is_total_minus_own(spark):
    battles = spark.createDataFrame([(str(i), "X" if i % 2 else "Y", "Z", "a", "b", float(i % 3 == 0)) for i in range(12)], "battle_id string, model_a string, model_b string, completion_a string, completion_b string, human_pref double")
    z = long(spark, [[1.0 if i % 2 else -1.0, 0.5] for i in range(12)])
    meta, own = codes.bank(battles, z)
    rows = {(r.model, r.feature_id): r for r in diagnose.per_model(meta, own, p_values=True).collect()}
    x = rows["X", 0]
    assert x.n == 6 and x.net_direction == 1.0 and abs(x.net_direction_pool + 6 / 18) < 1e-12
    with pytest.raises(ValueError, match="no battle"):
        diagnose.one_model(meta, own, "nobody")
    shared = diagnose.head_to_head(battles, z.filter("z > 0"), z.filter("z < 0"), 2)
    assert {(r.lo, r.hi) for r in shared.collect()} <= {("X", "Z"), ("Y", "Z")}


def test_spans_count_silent_tokens(spark):
    tokens = spark.createDataFrame([("b", "a", 0), ("b", "a", 1), ("b", "p", 0)], "battle_id string, span string, token_idx int")
    z = spark.createDataFrame([("b", "a", 1, 2.0), ("b", "a", 0, 1.0), ("b", "p", 0, 3.0), ("b", "a", 2, -1.0)], "battle_id string, span string, feature_id int, z double")
    got = {(r.span, r.feature_id): (r.x_max, r.x_freq) for r in codes.summarize_spans(tokens, z).collect()}
    assert got == {("a", 0): (1.0, 0.5), ("a", 1): (2.0, 0.5), ("p", 0): (3.0, 1.0), ("a", 2): (0.0, 0.5)}


def test_prompt_types_and_prevalence(spark):
    zp = long(spark, [[1, 2], [3, 0], [0, 0], [2, 2]])
    assert {r.battle_id: r.prompt_concept for r in codes.dominant(zp).collect()} == {"0": 1, "1": 0, "3": 0}
    battles = labels(spark, [1, 0, 1, 1])
    rows = conditional.winning_prevalence(long(spark, [[1], [0], [1], [1]]), long(spark, [[0], [1], [0], [1]]), battles, codes.dominant(zp)).collect()
    got = {r.prompt_concept: (r.n_win, r.p_win, r.p_lose) for r in rows}
    assert got == {1: (1, 1.0, 0.0), 0: (2, 1.0, 0.5)}


def test_selection(spark):
    rng = np.random.default_rng(2)
    z, rows = long(spark, rng.normal(size=(40, 3)) * (rng.random((40, 3)) < 0.5)), labels(spark, [1] * 40)
    drawn = select.naming_examples(z, rows, 4, 5)
    assert {r.feature_id: r["count"] for r in drawn.groupBy("feature_id").count().collect()} == {0: 9, 1: 9, 2: 9}
    assert drawn.filter("kind = 'silent'").join(z, ["feature_id", "battle_id"], "left_semi").count() == 0
    assert select.holdout_buckets(z, rows, 3, sampling="uniform").filter("rank > 3").count() == 0
    with pytest.raises(ValueError, match="abs, pos or neg"):
        select.top_codes(z, 2, mode="both")
    vectors = spark.createDataFrame([(str(i), d, 1.0 if d == i % 2 else 0.0) for i in range(6) for d in range(2)], "battle_id string, dim int, v double")
    near = select.close_negatives(vectors, spark.createDataFrame([("0", 0, 1.0)], "battle_id string, feature_id int, z double"), 2, "battle_id")
    assert [r.battle_id for r in near.orderBy("rank").collect()] == ["2", "4"]


def test_clusterings(spark):
    block = np.kron(np.eye(2), np.ones((3, 3))) + 0.01
    assert len(set(cluster.communities(block)[:3])) == 1 and len(set(cluster.communities(block))) == 2
    assert sorted(np.bincount(cluster.average_linkage(1 - block, 2))) == [3, 3]
    assert sorted(np.bincount(cluster.spherical_kmeans(block, 2))) == [3, 3]
    z = long(spark, np.random.default_rng(0).integers(0, 2, (30, 4)))
    for name in registry.available("clusterer"):
        assert registry.make("clusterer", name)(z, 30).count() == 4
    with pytest.raises(ValueError, match="unknown method"):
        cluster.cluster_features(z, 30, "other")
    vectors = spark.createDataFrame([([1.0, 0.1],), ([1.0, 0.0],), ([0.0, 1.0],), ([0.0, 0.0],)], "vector array<double>")
    rows = cluster.cluster_examples(vectors, k=2).collect()
    assert sum(r.cluster_id is None for r in rows) == 1


def test_lens(spark, tmp_path):
    rng = np.random.default_rng(0)
    basis = rng.normal(size=(6, 10))
    x = (rng.random((600, 6)) < 0.2) * rng.normal(size=(600, 6)) @ basis
    fitted, log = lens.train(x, x[:100], m=16, k=3, epochs=30, batch=64, lr=5e-3)
    assert log[-1]["val_loss"] < log[0]["val_loss"] and fitted.info["explained_variance"] > 0.5
    assert np.allclose(fitted.project(x[:7]), fitted.project(x)[:7])
    fitted.save(f"{tmp_path}/lens")
    with pytest.raises(FileExistsError):
        fitted.save(f"{tmp_path}/lens")
    again = lens.Lens.load(f"{tmp_path}/lens")
    vectors = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x[:20])], "row_id string, vector array<double>")
    got = {(r.row_id, r.feature_id): r.z for r in lens.encode(vectors, again).collect()}
    want = {(str(i), int(f)): z for i, row in enumerate(fitted.project(x[:20])) for f, z in enumerate(row) if z}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    with pytest.raises(ValueError, match="entries"):
        fitted.project(x[:, :3])
    for method in ("none", "standardize", "pca"):
        white = lens.Whitener.fit(x, method)
        assert np.allclose(white.invert(white.apply(x)), x)
    assert lens.kind_of(None, {"z_prompt"}) == "prompt" and lens.kind_of("difference", set()) == "difference" and lens.kind_of(None, set()) is None
    top = lens.Lens(fitted.encoder, fitted.bias, fitted.decoder, fitted.centre, "topk", k=3)
    assert (np.count_nonzero(top.project(x[:9]), axis=1) == 3).all()


def test_naming_verifying_and_runs(spark):
    rng = np.random.default_rng(3)
    z, rows = long(spark, rng.normal(size=(80, 2)) * (rng.random((80, 2)) < 0.6)), labels(spark, rng.integers(0, 2, 80), length=rng.integers(-9, 9, 80).astype(float).tolist())
    texts = spark.createDataFrame([(str(i), f"text {i} <<<") for i in range(80)], "battle_id string, text string")
    ask = lambda qs: ['{"concept": "uses plain words", "confidence": "low"}' if q.startswith("Which") else "A" for q in qs]
    config = pipeline.Config.from_dict({"clusterer": "agglomerative", "clusterer_params": {"n_clusters": 1}, "n_per_bucket": 3})
    out = pipeline.run(config, z, rows, texts, ask)
    assert {r.concept for r in out["names"].collect()} == {"uses plain words"}
    assert out["fidelity"].filter("fidelity_pass").count() == 0 and out["relevance"].count() == 2 and out["cluster_summary"].count() == 1
    with pytest.raises(ValueError, match="model function"):
        pipeline.run(config, z, rows, texts)
    for wrong in ({"stage": 1}, {"stages": ["dance"]}, {"clusterer_params": {"k": 1}}):
        with pytest.raises(ValueError, match="unknown"):
            pipeline.Config.from_dict(wrong)
    assert interpret.parse_concept('<think>x</think>{"feature": "long answers"}') == "long answers"
    assert interpret.parse_result("{bad json")["status"] == "insufficient_evidence" and interpret.parse_concept("- cites its sources") == "cites its sources"


def test_lost_replies_and_candidates(spark):
    tries = []

    def send(request):
        tries.append(request)
        if request == "bad":
            raise RuntimeError("401 not allowed")
        if len(tries) < 3:
            raise RuntimeError("busy")
        return "Yes"

    assert interpret.patient(send)(["a", "bad"]) == ["Yes", "<<ERROR: 401 not allowed>>"] and len(tries) == 4
    rows = [(1, "ok", "long answers", "low"), (1, "ok", "long answers", "high"), (1, "ok", "short ones", "high"), (2, "polysemantic", "", ""), (2, "ok", "plain words", "low")]
    best = interpret.best_candidate(spark.createDataFrame(rows, "feature_id int, status string, concept string, confidence string"))
    assert {tuple(r) for r in best.collect()} == {(1, "ok", "long answers", "high"), (2, "ok", "plain words", "low")}


def test_a_silent_draw_for_a_feature_that_fires_nearly_everywhere(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("battle_id"))
    z = rows.filter("cast(battle_id as int) % 800 <> 3").select("battle_id", F.lit(0).alias("feature_id"), F.lit(1.0).alias("z"))
    z = z.union(rows.filter("cast(battle_id as int) < 40").select("battle_id", F.lit(1), F.lit(-1.0))).union(rows.select("battle_id", F.lit(2), F.lit(1.0)))
    got = select.silent(z, rows, 4).collect()
    order = sorted(range(4000), key=lambda i: hashlib.sha1(f"{i}|0".encode()).hexdigest())
    want = {0: [str(i) for i in order if i % 800 == 3][:4], 1: [str(i) for i in order if i >= 40][:4]}
    assert {f: [r.battle_id for r in sorted(got, key=lambda r: r.rank) if r.feature_id == f] for f in (0, 1)} == want and len(got) == 8


def test_permutation_null_and_length_control(spark):
    rng = np.random.default_rng(5)
    z, rows = long(spark, rng.normal(size=(120, 3)) * (rng.random((120, 3)) < 0.7)), labels(spark, rng.integers(0, 2, 120), length=rng.integers(-9, 9, 120).astype(float).tolist())
    types = rows.select("battle_id", (F.col("battle_id").cast("int") % 3).alias("prompt_concept"))
    dealt = conditional.shuffled(types, "prompt_concept", "battle_id", "x")
    assert dealt.count() == 120 and [r["count"] for r in dealt.groupBy("prompt_concept").count().collect()] == [40] * 3
    null = conditional.delta_null(z, rows, types, times=2)
    assert len(null["null"]) == 2 and 0 < null["p"] <= 1
    meta = rows.select(F.col("battle_id").alias("row_id"), F.col("human_pref").alias("win"), "length")
    table = diagnose.length_controlled(spark.createDataFrame([(0,), (1,), (9,)], "feature_id int"), meta, z.withColumnRenamed("battle_id", "row_id"))
    got = {r.feature_id: r for r in table.collect()}
    assert got[9].outcome_assoc_lc is None and abs(got[0].length_confound) < 1 and got[1].outcome_assoc_lc is not None


def test_registry():
    with pytest.raises(ValueError, match="registered already"):
        registry.register("clusterer", "agglomerative")(object)
    with pytest.raises(KeyError, match="known"):
        registry.get("clusterer", "none")
    assert registry.interpreter_mode("auto", "prompt") == "single-text"


def test_embedding_cache(spark):
    calls = []
    queries = spark.createDataFrame([("a",), ("b",), ("a",)], "query string")
    cache = spark.createDataFrame([], "key string, vector array<float>")
    model = lambda qs: [[3.0, 4.0] for _ in qs]
    first, store = interpret.embed(queries, cache, model, "m")
    assert first.count() == 3 and store.count() == 2 and np.allclose(first.first().vector, [0.6, 0.8])
    assert not calls


def test_validation(spark):
    got = validate.fit_quality([1, 2, 3, 4], [2, 4, 6, 9], reps=200)
    assert got["r"] > 0.98 and got["spearman"] == pytest.approx(1.0) and 0 < got["r2_perm_p"] <= 1
    assert np.isnan(validate.fit_quality([1, 1, 1], [1, 2, 3])["r"])
    y = labels(spark, [1, 0] * 10)
    z = long(spark, [[1.0], [-1.0]] * 10)
    assert validate.evaluate_preference(z, y, 1)["accuracy"] == 1.0
    with pytest.raises(ValueError, match="two classes"):
        validate.evaluate_preference(z, labels(spark, [1] * 20), 1)


def test_export(spark, tmp_path):
    table = spark.createDataFrame([(1, float("nan"), "c"), (2, 0.123456789, "d")], "feature_id int, v double, concept string")
    done = export.bundle(f"{tmp_path}/b", good=table, bad=table.withColumn("x", F.raise_error(F.lit("no"))))
    assert done["written"] == ["good"] and "bad" in done["errors"]
    assert export.records(table)[0]["v"] is None and export.records(table)[1]["v"] == 0.12346
