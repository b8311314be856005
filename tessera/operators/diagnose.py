"""What each model does more or less of, for all models at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S

count_if = F.count_if


def models(battles: DataFrame) -> DataFrame:
    """Appearances of each model on either side."""
    return battles.select(F.explode(F.array("model_a", "model_b")).alias("model")).groupBy("model").agg(F.count("*").alias("n"))


def inspect(battles: DataFrame) -> DataFrame:
    """One row: battles, models, labels of each kind."""
    y = F.col("human_pref")
    return battles.agg(
        F.count("*").alias("n_battles"),
        count_if(y == 1).alias("n_a"),
        count_if(y == 0).alias("n_b"),
        count_if(y == 0.5).alias("n_tie"),
        F.count_distinct("language").alias("n_languages"),
    ).crossJoin(models(battles).agg(F.count("*").alias("n_models")))  # one row each


def per_model(meta: DataFrame, codes: DataFrame, p_values: bool = False) -> DataFrame:
    """Per model and feature of a bank: rates, direction, wins, and the contrast with the pool.

    The pool of a model is the total minus its own rows, so one aggregate answers all models.
    """
    sizes = meta.groupBy("self_model").agg(F.count("*").alias("n"))
    total_n = meta.count()
    pos, neg = F.col("z") > 0, F.col("z") < 0
    per = (
        codes.filter("z <> 0")
        .join(meta.select("row_id", "self_model", "win"), "row_id")
        .groupBy("self_model", "feature_id")
        .agg(
            count_if(pos).alias("p"), count_if(neg).alias("q"), F.sum(F.abs("z")).alias("abs"),
            F.avg(F.when(pos, F.col("win"))).alias("win_rate_self_more"), F.avg(F.when(neg, F.col("win"))).alias("win_rate_self_less"),
            F.avg("win").alias("win_rate"),
        )
    )
    total = per.groupBy("feature_id").agg(F.sum("p").alias("p_t"), F.sum("q").alias("q_t"))
    rows = per.join(F.broadcast(sizes), "self_model").join(total, "feature_id")
    n, p, q = F.col("n"), F.col("p"), F.col("q")
    out_n, out_p, out_q = F.lit(total_n) - n, F.col("p_t") - p, F.col("q_t") - q
    w = S.welch_signs(n, p, q, out_n, out_p, out_q)
    out = rows.select(
        F.col("self_model").alias("model"), "feature_id", "n",
        S.ratio(p + q, n).alias("fire_rate"), S.ratio(p, n).alias("self_more_rate"), S.ratio(q, n).alias("self_less_rate"),
        S.ratio((p - q).cast("double"), n).alias("net_direction"), S.ratio(F.col("abs"), n).alias("mean_abs_z"),
        "win_rate", "win_rate_self_more", "win_rate_self_less",
        S.ratio((out_p - out_q).cast("double"), out_n).alias("net_direction_pool"),
        w["delta"].alias("delta_vs_pool"), w["welch_t"].alias("welch_t"), w["welch_df"].alias("welch_df"), w["cohens_d"].alias("cohens_d"),
        (F.col("win_rate_self_more") - F.col("win_rate_self_less")).alias("outcome_assoc"),
    )
    if not p_values:
        return out.drop("welch_df")
    tests = codes.select("feature_id").distinct().count()
    return out.withColumn("welch_p", S.t_tail("welch_t", "welch_df")).withColumn("welch_p_bonferroni", S.bonferroni(F.col("welch_p"), tests)).drop("welch_df")


def one_model(meta: DataFrame, codes: DataFrame, model: str, names: DataFrame | None = None, fidelity_only: bool = True, reward: DataFrame | None = None) -> DataFrame:
    """The table of one model with names and global reward, most over-expressed first."""
    if not meta.filter(F.col("self_model") == model).limit(1).count():
        raise ValueError(f"no battle of model {model!r}")
    out = per_model(meta, codes, p_values=True).filter(F.col("model") == model)
    if reward is not None:
        out = out.join(F.broadcast(reward.select("feature_id", F.col("delta_win_rate").alias("helps_win"))), "feature_id", "left")
    if names is not None:
        if fidelity_only and "fidelity_pass" in names.columns:
            out = out.join(F.broadcast(names.filter("coalesce(fidelity_pass, false)").select("feature_id")), "feature_id", "left_semi")
        out = named(out, names)
    return out.orderBy(F.desc_nulls_last("delta_vs_pool"), "feature_id")


def length_controlled(diagnosis: DataFrame, meta: DataFrame, codes: DataFrame) -> DataFrame:
    """Add outcome_assoc_lc (win rate moved by a feature at equal length) and length_confound (correlation of its sign with length).

    ``diagnosis`` is the table of one model, ``meta`` its oriented battles with win and length.
    """
    from . import logistic, relevance

    rows = meta.withColumnRenamed("win", "human_pref")
    lc = logistic.controlled(codes, rows, key="row_id", p_values=False).select("feature_id", F.col("delta_win_rate").alias("outcome_assoc_lc"))
    confound = relevance.confound_correlation(codes, rows, "length", key="row_id")
    confound = confound.select("feature_id", F.col("corr").alias("length_confound"))
    return diagnosis.join(F.broadcast(lc), "feature_id", "left").join(F.broadcast(confound), "feature_id", "left")


def named(table: DataFrame, names: DataFrame) -> DataFrame:
    """Names joined on, their columns first."""
    own = [c for c in names.columns if c != "feature_id"]
    joined = table.join(F.broadcast(names), "feature_id", "left")
    return joined.select("feature_id", *own, *[c for c in table.columns if c != "feature_id"])


def absolute_fire_rate(battles: DataFrame, z_a: DataFrame, z_b: DataFrame) -> DataFrame:
    """Share of a model's own responses, on both sides, on which a feature fires."""
    own = models(battles)
    side = lambda z, m: z.filter("z > 0").join(battles.select("battle_id", F.col(m).alias("model")), "battle_id").select("model", "feature_id")
    hits = side(z_a, "model_a").union(side(z_b, "model_b")).groupBy("model", "feature_id").agg(F.count("*").alias("k"))
    return hits.join(F.broadcast(own), "model").select("model", "feature_id", S.ratio(F.col("k"), F.col("n")).alias("fire_rate"), "n")


def paired(z_a: DataFrame, z_b: DataFrame, key: str = "battle_id") -> DataFrame:
    """Per row and feature that fires on a side: whether it fires on a, on b."""
    both = z_a.filter("z > 0").select(key, "feature_id", F.lit(1).alias("a"), F.lit(0).alias("b")).union(
        z_b.filter("z > 0").select(key, "feature_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    return both.groupBy(key, "feature_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))


def head_to_head(battles: DataFrame, z_a: DataFrame, z_b: DataFrame, min_shared: int = 30) -> DataFrame:
    """Per unordered model pair and feature: battles where only one of them fires."""
    pairs = battles.filter("model_a <> model_b").select(
        "battle_id", F.least("model_a", "model_b").alias("lo"), F.greatest("model_a", "model_b").alias("hi"), (F.col("model_a") < F.col("model_b")).alias("forward")
    )
    shared = pairs.groupBy("lo", "hi").agg(F.count("*").alias("n_shared")).filter(F.col("n_shared") >= min_shared)
    fired = paired(z_a, z_b).filter("a <> b").join(pairs, "battle_id")
    first = F.when(F.col("forward"), F.col("a")).otherwise(F.col("b")) == 1
    counts = fired.groupBy("lo", "hi", "feature_id").agg(count_if(first).alias("bpos"), count_if(~first).alias("cpos"))
    return counts.join(F.broadcast(shared), ["lo", "hi"])


def battle_graph(battles: DataFrame) -> DataFrame:
    """Per unordered model pair: battles, and wins of the first name."""
    y = F.when(F.col("model_a") <= F.col("model_b"), F.col("human_pref")).otherwise(1 - F.col("human_pref"))
    return battles.groupBy(F.least("model_a", "model_b").alias("lo"), F.greatest("model_a", "model_b").alias("hi")).agg(
        F.count("*").alias("n"), F.sum(y).alias("wins_lo"), F.count(y).alias("n_labelled")
    )


def power(meta: DataFrame) -> DataFrame:
    """Win rate and rows of each model of a bank."""
    return meta.groupBy(F.col("self_model").alias("model")).agg(F.count("*").alias("n"), F.avg("win").alias("win_rate"))
