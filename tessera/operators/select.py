"""Ranked and drawn examples.  Draws are by a hash of the identifier, ties always by identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drawn(key: str, seed: int = 0):
    return F.sha1(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def ranked(df: DataFrame, by: list, n: int, *order) -> DataFrame:
    """The first n rows of each group.  Row-number filters are pushed into the window by Spark."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", at).filter(F.col("rank") <= n)


def top_codes(codes: DataFrame, n: int, key: str = "battle_id", mode: str = "abs") -> DataFrame:
    """Per feature: the n rows with the largest code by size, positive or negative pole."""
    if mode not in ("abs", "pos", "neg"):
        raise ValueError(f"unknown mode {mode!r}: use abs, pos or neg")
    keep = {"abs": F.col("z") != 0, "pos": F.col("z") > 0, "neg": F.col("z") < 0}[mode]
    size = F.abs("z")
    return ranked(codes.filter(keep), ["feature_id"], n, F.desc(size), F.col(key)).select("feature_id", "rank", key, "z")


def silent(codes: DataFrame, pool: DataFrame, n: int, key: str = "battle_id", seed: int = 0) -> DataFrame:
    """Per feature: n rows of the pool on which it is silent, the first ones of an order drawn by hash.

    A feature that is silent on s rows needs about the first n / s of the order.  Rows are dealt into levels,
    halves of what is left of the order, and a feature meets the levels up to a bound with room to spare; those
    that still lack rows go on with a bound eight times as far.  So the candidates are a few n per feature (more
    only for features that fire nearly everywhere), and no feature meets all rows for another's sake.
    """
    order = pool.select(key, drawn(key, seed).alias("h"))
    place = (F.conv(F.substring("h", 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    order = order.withColumns({"u": place, "level": F.floor(-F.log2(place)).cast("int")})
    fire = codes.filter("z <> 0").select("feature_id", key).distinct()
    size = pool.count()
    counts = fire.join(pool.select(key), key, "left_semi").groupBy("feature_id").agg(F.count("*").alias("c"))
    open_features = codes.select("feature_id").distinct().join(counts, "feature_id", "left").select("feature_id", (size - F.coalesce("c", F.lit(0))).alias("quiet"))
    open_features = open_features.filter("quiet > 0")
    reach, found = 1.0, None
    while True:
        bound = F.least(F.lit(1.0), reach * F.lit(n + 6 * n**0.5 + 10) / F.col("quiet"))
        asked = open_features.withColumn("bound", bound).withColumn("level", F.explode(F.sequence(F.floor(-F.log2("bound")).cast("int"), F.lit(48))))
        near = order.join(asked, "level").filter("u <= bound").select("feature_id", key, "h").join(fire, ["feature_id", key], "left_anti")
        best = ranked(near, ["feature_id"], n, F.col("h"), F.col(key)).select("feature_id", "rank", key)
        have = best.groupBy("feature_id").agg(F.count("*").alias("have"))
        short = open_features.join(have, "feature_id", "left").filter(F.coalesce("have", F.lit(0)) < F.least(F.lit(n), F.col("quiet"))).select("feature_id", "quiet")
        lacking = [r["feature_id"] for r in short.select("feature_id").collect()]  # at most the features, usually none
        done = best.filter(~F.col("feature_id").isin(lacking)) if lacking else best
        found = done if found is None else found.unionByName(done)
        if not lacking:
            return found
        open_features, reach = open_features.filter(F.col("feature_id").isin(lacking)), reach * 8


def naming_examples(codes: DataFrame, pool: DataFrame, n_active: int = 10, n_zero: int = 10, key: str = "battle_id", seed: int = 0) -> DataFrame:
    """Per feature: top active rows and drawn silent rows, with their code."""
    own = codes.join(pool.select(key), key, "left_semi")
    active = top_codes(own, n_active, key, "pos").withColumn("kind", F.lit("active"))
    return active.unionByName(silent(own, pool, n_zero, key, seed).withColumns({"z": F.lit(0.0), "kind": F.lit("silent")}))


def holdout_buckets(codes: DataFrame, pool: DataFrame, n: int, key: str = "battle_id", sampling: str = "extremes", seed: int = 0) -> DataFrame:
    """Per feature: positive, negative and silent rows of the held-out pool."""
    own = codes.filter("z <> 0").join(pool.select(key), key, "left_semi").withColumn("bucket", F.when(F.col("z") > 0, "pos").otherwise("neg"))
    order = [F.desc(F.abs("z")), F.col(key)] if sampling == "extremes" else [drawn(key, seed), F.col(key)]
    fired = ranked(own, ["feature_id", "bucket"], n, *order).select("feature_id", "bucket", "rank", key, "z")
    ties = silent(codes.join(pool.select(key), key, "left_semi"), pool, n, key, seed).withColumns({"bucket": F.lit("tie"), "z": F.lit(0.0)})
    return fired.unionByName(ties)


def close_negatives(vectors: DataFrame, codes: DataFrame, n: int, key: str = "row_id") -> DataFrame:
    """Per feature: silent rows nearest (cosine) to the mean unit vector of its active rows.

    ``vectors`` holds (key, dim, v) of unit vectors.  The centroids are features x dimensions, which
    bounds the broadcast.
    """
    active = codes.filter("z > 0").select(key, "feature_id")
    counts = active.groupBy("feature_id").agg(F.count("*").alias("n_active"))
    mean = active.join(vectors, key).groupBy("feature_id", "dim").agg(F.sum("v").alias("c")).join(F.broadcast(counts), "feature_id")
    centre = mean.select("feature_id", "dim", (F.col("c") / F.col("n_active")).alias("c"))
    dots = vectors.join(F.broadcast(centre), "dim").groupBy("feature_id", key).agg(F.sum(F.col("v") * F.col("c")).alias("cosine"))
    quiet = dots.join(codes.filter("z <> 0").select("feature_id", key), ["feature_id", key], "left_anti")
    return ranked(quiet, ["feature_id"], n, F.desc(F.round("cosine", 9)), F.col(key)).select("feature_id", "rank", key, "cosine")


def examples_by_model(battles: DataFrame, z_a: DataFrame, z_b: DataFrame, n: int = 4, key: str = "battle_id") -> DataFrame:
    """Per model and feature: own answers with the largest positive code, with the outcome."""
    y = F.col("human_pref")
    side = lambda z, m, win, s: z.filter("z > 0").join(battles.select(key, F.col(m).alias("model"), win.alias("win")), key).select("model", "feature_id", key, F.lit(s).alias("side"), "z", "win")
    both = side(z_a, "model_a", y, "a").union(side(z_b, "model_b", 1 - y, "b"))
    outcome = F.when(F.col("win") == 1, "win").when(F.col("win") == 0, "loss").when(F.col("win") == 0.5, "tie").otherwise("?")
    return ranked(both, ["model", "feature_id"], n, F.desc("z"), F.col(key), F.col("side")).withColumn("outcome", outcome).drop("win")


def top_concepts(codes: DataFrame, names: DataFrame, k: int = 5, key: str = "battle_id") -> DataFrame:
    """Per row: the k named features with the largest code by size."""
    named = codes.filter("z <> 0").join(F.broadcast(names.filter("concept is not null and concept <> ''").select("feature_id", "concept")), "feature_id")
    return ranked(named, [key], k, F.desc(F.abs("z")), F.col("feature_id")).select(key, "rank", "feature_id", "concept", "z")


def rewarded_gaps(diagnosis: DataFrame, top: int = 15) -> DataFrame:
    """Per model: features it under-expresses although they are rewarded."""
    under = F.coalesce("delta_vs_pool", "net_direction")
    return ranked(diagnosis.filter((under < 0) & (F.col("helps_win") > 0)), ["model"], top, F.desc("helps_win"), F.col("feature_id"))


def report_battles(meta: DataFrame, prompt_types: DataFrame, per_type: int = 5, key: str = "battle_id") -> DataFrame:
    """Per model and prompt concept: battles with the strongest prompt activation."""
    rows = meta.filter("win is not null").join(prompt_types.select(key, "prompt_concept", "activation"), key)
    return ranked(rows, ["self_model", "prompt_concept"], per_type, F.desc("activation"), F.col("row_id")).select(
        F.col("self_model").alias("model"), "prompt_concept", "rank", "row_id", "activation", "win"
    )


def capped(rows: DataFrame, most: int | None, key: str, seed: int = 0) -> DataFrame:
    """A deterministic draw of at most ``most`` rows."""
    return rows if most is None else rows.orderBy(drawn(key, seed), key).limit(most)
