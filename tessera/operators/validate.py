"""Does the diagnosis predict wins?  Per-model scores against win rates, and preference prediction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import hashing
from .relevance import win_relevance


def weights(relevance: DataFrame, column: str, significant_only: bool = False) -> DataFrame:
    schema.require(relevance, "feature_id", column)
    w = F.coalesce(F.when(~F.isnan(column), F.col(column)), F.lit(0.0))
    if significant_only:
        w = F.when(F.col("significant"), w).otherwise(0.0)
    return relevance.select("feature_id", w.alias("w"))


def model_scores(meta: DataFrame, codes: DataFrame, weight: DataFrame, min_battles: int = 20) -> DataFrame:
    """Per model: sum over features of net direction times weight, next to its actual win rate."""
    sizes = meta.groupBy("self_model").agg(F.count("*").alias("n_battles"), F.avg("win").alias("actual_win_rate")).filter(F.col("n_battles") >= min_battles)
    pushed = codes.join(F.broadcast(weight), "feature_id").join(meta.select("row_id", "self_model"), "row_id")
    total = pushed.groupBy("self_model").agg(F.sum(F.signum("z") * F.col("w")).alias("t"))
    return sizes.join(total, "self_model", "left").select(
        F.col("self_model").alias("model"), "n_battles", (F.coalesce("t", F.lit(0.0)) / F.col("n_battles")).alias("predicted_score"), "actual_win_rate"
    )


def leave_one_out(meta: DataFrame, codes: DataFrame, models: list[str], min_battles: int = 20) -> DataFrame:
    """Scores whose weights come from battles without the scored model."""
    out = None
    for model in models:
        rest = meta.filter((F.col("self_model") != model) & (F.col("other_model") != model) & (F.col("orientation") == "a"))
        learned = win_relevance(codes, rest.select("row_id", F.col("win").alias("human_pref")), "row_id", p_values=False)
        own = meta.filter(F.col("self_model") == model)
        one = model_scores(own, codes.join(own.select("row_id"), "row_id", "left_semi"), weights(learned, "win_assoc"), min_battles)
        out = one if out is None else out.union(one)
    return out.withColumnRenamed("predicted_score", "predicted_score_loo")


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks."""
    _, where, n = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(n)
    return ((last - n + 1 + last) / 2)[where]


def pearson(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x - x.mean(), y - y.mean()
    under = float(np.sqrt((x @ x) * (y @ y)))
    return float(x @ y) / under if under > 1e-12 else float("nan")


def fit_quality(predicted, actual, reps: int = 2000, seed: int = 0) -> dict[str, float]:
    """Correlations over models (hundreds at most, on the driver), bootstrap intervals, permutation p."""
    x, y = np.asarray(predicted, float), np.asarray(actual, float)
    names = ("r", "r2", "spearman", "r2_ci_lo", "r2_ci_hi", "spearman_ci_lo", "spearman_ci_hi", "r2_perm_p")
    if len(x) < 3 or x.std() == 0 or y.std() == 0:
        return dict.fromkeys(names, float("nan"))
    rng = np.random.default_rng(seed)
    r, rho = pearson(x, y), pearson(ranks(x), ranks(y))
    boot = np.array([(pearson(x[i], y[i]) ** 2, pearson(ranks(x[i]), ranks(y[i]))) for i in rng.integers(0, len(x), (reps, len(x)))])
    hits = sum(pearson(x, rng.permutation(y)) ** 2 >= r * r - 1e-12 for _ in range(reps))
    (a, b), (c, d) = np.nanpercentile(boot[:, 0], [2.5, 97.5]), np.nanpercentile(boot[:, 1], [2.5, 97.5])
    return dict(zip(names, (r, r * r, rho, a, b, c, d, (hits + 1) / (reps + 1)), strict=True))


def split_reliability(z: DataFrame, rows: DataFrame, key: str = "battle_id", splits: int = 5) -> DataFrame:
    """Spearman correlation of feature effects between two halves, for several hash splits."""
    spark, out = z.sparkSession, []
    for i in range(splits):
        part = F.pmod(hashing.sha1_bucket(F.concat(F.col(key).cast("string"), F.lit(f"|{i}"))), F.lit(2))
        sign = F.signum("z")
        got = z.groupBy("feature_id").agg(F.sum(F.when(part == 0, sign).otherwise(0.0)).alias("a"), F.sum(F.when(part == 1, sign).otherwise(0.0)).alias("b")).toPandas()
        out.append((i, pearson(ranks(got["a"].to_numpy()), ranks(got["b"].to_numpy())) if len(got) > 2 else float("nan")))
    return spark.createDataFrame(out, "split int, spearman double")


def evaluate_preference(codes: DataFrame, rows: DataFrame, n_features: int, folds: int = 5, key: str = "battle_id") -> dict[str, float]:
    """Out-of-fold accuracy and AUC of an L2 logistic regression on all codes; folds are by hash."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    y = rows.select(key, schema.label().alias("y")).filter("y is not null and y <> 0.5").withColumn("label", (F.col("y") > 0.5).cast("double"))
    classes = {r["label"]: r["count"] for r in y.groupBy("label").count().collect()}
    folds = min(folds, *classes.values()) if len(classes) == 2 else 0
    if folds < 2:
        raise ValueError("preference prediction needs two classes and two folds")
    entries = codes.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "z"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    data = y.join(entries, key, "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,double>")))
    data = data.select(key, "label", array_to_vector(dense).alias("features"), F.pmod(hashing.sha1_bucket(key), F.lit(folds)).alias("fold")).persist()
    scored = None
    for fold in range(folds):
        train = data.filter(F.col("fold") != fold)
        model = LogisticRegression(regParam=1.0 / max(1, train.count()), standardization=False).fit(train)
        part = model.transform(data.filter(F.col("fold") == fold)).select("label", "rawPrediction", "prediction")
        scored = part if scored is None else scored.union(part)
    accuracy = scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    auc = BinaryClassificationEvaluator().evaluate(scored)
    data.unpersist()
    return {"accuracy": accuracy, "auc": auc, "majority": max(classes.values()) / sum(classes.values()), "n": sum(classes.values())}
