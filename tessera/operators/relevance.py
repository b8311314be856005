"""What a label rewards: per-feature relevance, dataset effects, and confounds.

All of them are one grouped aggregate over the sparse codes; totals over rows (silent ones included)
come from the row table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import hashing
from ..functions import stats as S

count_if = F.count_if


def win_relevance(codes: DataFrame, rows: DataFrame, key: str = "battle_id", p_values: bool = True, features: DataFrame | None = None) -> DataFrame:
    """Per feature: how often it fires, mean label when it is more or less, and their association.

    With ``features`` (feature_id) silent features have a row too, and all of them count as tests.
    """
    y = rows.select(key, schema.label().alias("y")).filter("y is not null")
    total = y.count()
    c = 2 * F.col("y") - 1
    s = F.signum("z")
    more, less = F.col("z") > 0, F.col("z") < 0
    per = (
        codes.filter("z <> 0")
        .join(y, key)
        .groupBy("feature_id")
        .agg(
            F.count("*").alias("n_fire"),
            count_if(more).alias("p"),
            count_if(less).alias("q"),
            F.avg(F.when(more, F.col("y"))).alias("win_rate_a_more"),
            F.avg(F.when(less, F.col("y"))).alias("win_rate_a_less"),
            F.sum(c).alias("sc"),
            F.sum(c * c).alias("scc"),
            F.sum(s * c).alias("ssc"),
        )
    )
    r = F.when((F.col("p") > 0) & (F.col("q") > 0), S.pearson(F.col("n_fire"), (F.col("p") - F.col("q")).cast("double"), F.col("n_fire").cast("double"), F.col("sc"), F.col("scc"), F.col("ssc")))
    out = per.select(
        "feature_id",
        "n_fire",
        S.ratio(F.col("n_fire"), F.lit(total)).alias("fire_rate"),
        "win_rate_a_more",
        "win_rate_a_less",
        (F.col("win_rate_a_more") - F.col("win_rate_a_less")).alias("win_assoc"),
        r.alias("correlation"),
    )
    if features is not None:
        out = F.broadcast(features.select("feature_id")).join(out, "feature_id", "left").fillna({"n_fire": 0, "fire_rate": 0.0})
    if not p_values:
        return out
    tests = (codes if features is None else features).select("feature_id").distinct().count()
    out = out.withColumn("p_value", S.correlation_p(F.col("correlation"), F.col("n_fire")))
    return out.withColumns(
        {"p_bonferroni": S.bonferroni(F.col("p_value"), tests), "sign": F.signum("correlation").cast("int")}
    ).withColumn("significant", F.coalesce(F.col("p_bonferroni") < 0.05, F.lit(False)))


def feature_table(codes: DataFrame, n_rows: int) -> DataFrame:
    """Per feature: fire rate, more and less rates, mean size over all rows."""
    n = F.lit(n_rows)
    return codes.filter("z <> 0").groupBy("feature_id").agg(
        S.ratio(F.count("*"), n).alias("fire_rate"),
        S.ratio(count_if(F.col("z") > 0), n).alias("more_rate"),
        S.ratio(count_if(F.col("z") < 0), n).alias("less_rate"),
        S.ratio(F.sum(F.abs("z")), n).alias("mean_abs_z"),
    )


def fire_rate(z_a: DataFrame, z_b: DataFrame, n_rows: int, positive: bool = True) -> DataFrame:
    """Share of responses of both sides on which a feature fires, to 4 decimals."""
    both = z_a.select("feature_id", "z").union(z_b.select("feature_id", "z"))
    hit = F.col("z") > 0 if positive else F.col("z") != 0
    return both.filter(hit).groupBy("feature_id").agg(F.round(S.ratio(F.count("*"), F.lit(2 * n_rows)), 4).alias("fire_rate"))


def dataset_reward(z: DataFrame, n_rows: int) -> DataFrame:
    """Mean sign over all rows, silent ones included."""
    return z.groupBy("feature_id").agg(S.ratio(F.sum(F.signum("z")), F.lit(n_rows)).alias("effect"))


def split_half(z: DataFrame, rows: DataFrame, key: str = "battle_id") -> DataFrame:
    """Reward on all rows and on two disjoint halves; stable where the halves share a non-zero sign."""
    part = hashing.half(key)
    sizes = rows.select(key).agg(count_if(part == 0).alias("n0"), count_if(part == 1).alias("n1")).first()
    sign = F.signum("z")
    per = z.groupBy("feature_id").agg(
        F.sum(sign).alias("s"), F.sum(F.when(part == 0, sign).otherwise(0.0)).alias("s0"), F.sum(F.when(part == 1, sign).otherwise(0.0)).alias("s1")
    )
    return per.select(
        "feature_id",
        S.ratio(F.col("s"), F.lit(sizes["n0"] + sizes["n1"])).alias("effect"),
        S.ratio(F.col("s0"), F.lit(sizes["n0"])).alias("effect_a"),
        S.ratio(F.col("s1"), F.lit(sizes["n1"])).alias("effect_b"),
        (F.signum("s0") * F.signum("s1") > 0).alias("stable"),
    )


def spurious_share(z: DataFrame, rows: DataFrame, undesirable: DataFrame, key: str = "battle_id") -> DataFrame:
    """Share of each row's code mass that lies on undesirable features; 0 for silent rows."""
    marked = z.join(F.broadcast(undesirable.select("feature_id", F.lit(1).alias("bad"))), "feature_id", "left")
    size = F.abs("z")
    per = marked.groupBy(key).agg(F.sum(F.when(F.col("bad") == 1, size).otherwise(0.0)).alias("m"), F.sum(size).alias("t"))
    share = F.col("m") / F.greatest(F.col("t"), F.lit(1e-9))
    return rows.select(key).join(per, key, "left").select(key, F.coalesce(share, F.lit(0.0)).alias("spurious_share"))


def label_inconsistency(z: DataFrame, rows: DataFrame, reward: DataFrame, undesirable: DataFrame, key: str = "battle_id") -> DataFrame:
    """Sum of sign times reward over the features that are not undesirable."""
    good = reward.join(undesirable, "feature_id", "left_anti").select("feature_id", "effect")
    per = z.join(F.broadcast(good), "feature_id").groupBy(key).agg(F.sum(F.signum("z") * F.col("effect")).alias("s"))
    return rows.select(key).join(per, key, "left").select(key, F.coalesce("s", F.lit(0.0)).alias("label_inconsistency"))


def diagnose_dataset(z: DataFrame, rows: DataFrame, undesirable: DataFrame, key: str = "battle_id") -> tuple[DataFrame, DataFrame]:
    """(per feature, per row) quality tables of winner-oriented codes."""
    per_feature = split_half(z, rows, key)
    share = spurious_share(z, rows, undesirable, key)
    return per_feature, share.join(label_inconsistency(z, rows, per_feature, undesirable, key), key)


def region_contrast(z: DataFrame, regions: DataFrame, key: str = "battle_id", region: str = "cluster_id", p_values: bool = True) -> DataFrame:
    """Mean sign inside a region minus outside, per feature; outside is the total minus the inside."""
    half = hashing.half(key)
    sizes = regions.groupBy(region).agg(F.count("*").alias("n"), count_if(half == 0).alias("n0"))
    all_ = regions.agg(F.count("*").alias("N"), count_if(half == 0).alias("N0")).first()
    pos, neg = F.col("z") > 0, F.col("z") < 0
    per = z.join(regions.select(key, region), key).groupBy(region, "feature_id").agg(
        count_if(pos).alias("p"), count_if(neg).alias("q"),
        count_if(pos & (half == 0)).alias("p0"), count_if(neg & (half == 0)).alias("q0"),
    )
    total = per.groupBy("feature_id").agg(*[F.sum(c).alias(f"{c}_t") for c in ("p", "q", "p0", "q0")])
    # Silent cells: every region meets every feature (both feature-sized), so that a region in which a
    # feature never fires is tested too.
    grid = sizes.crossJoin(F.broadcast(total)).join(per, [region, "feature_id"], "left").fillna(0)
    n, n0 = F.col("n"), F.col("n0")
    out_n, out_n0 = F.lit(all_["N"]) - n, F.lit(all_["N0"]) - n0
    w = S.welch_signs(n, F.col("p"), F.col("q"), out_n, F.col("p_t") - F.col("p"), F.col("q_t") - F.col("q"))

    def gap(n_in, p, q, n_out, pt, qt):
        return S.ratio((p - q).cast("double"), n_in) - S.ratio(((pt - p) - (qt - q)).cast("double"), n_out)

    d0 = gap(n0, F.col("p0"), F.col("q0"), out_n0, F.col("p0_t"), F.col("q0_t"))
    d1 = gap(n - n0, F.col("p") - F.col("p0"), F.col("q") - F.col("q0"), out_n - out_n0, F.col("p_t") - F.col("p0_t"), F.col("q_t") - F.col("q0_t"))
    out = grid.select(
        region, "feature_id", w["delta"].alias("delta"), w["welch_t"].alias("welch_t"), w["welch_df"].alias("welch_df"),
        F.coalesce(F.signum(d0) * F.signum(d1) > 0, F.lit(False)).alias("stable"),
    ).filter("welch_t is not null")
    if not p_values:
        return out.drop("welch_df")
    tests = sizes.count() * total.count()
    p = S.t_tail("welch_t", "welch_df")
    return out.withColumn("welch_p", p).withColumn("p_bonferroni", S.bonferroni(F.col("welch_p"), tests)).drop("welch_df")


def confound_correlation(z: DataFrame, rows: DataFrame, surrogate: str, key: str = "battle_id") -> DataFrame:
    """Pearson correlation of each feature's sign with a surrogate over all rows."""
    g = rows.select(key, F.col(surrogate).cast("double").alias("g"))
    t = g.agg(F.count("*").alias("n"), F.sum("g").alias("s"), F.sum(F.col("g") * F.col("g")).alias("ss")).first()
    sign = F.signum("z")
    per = z.filter("z <> 0").join(g, key).groupBy("feature_id").agg(F.sum(sign).alias("sx"), F.count("*").cast("double").alias("sxx"), F.sum(sign * F.col("g")).alias("sxy"))
    r = S.pearson(F.lit(t["n"]), F.col("sx"), F.col("sxx"), F.lit(t["s"]), F.lit(t["ss"]), F.col("sxy"))
    return per.select("feature_id", r.alias("corr"))


def auto_undesirable(correlations: DataFrame, threshold: float = 0.3) -> DataFrame:
    return correlations.filter(F.abs("corr") >= threshold).select("feature_id")


def bias_screen(z: DataFrame, rows: DataFrame, surrogate: str, key: str = "battle_id") -> DataFrame:
    """Label correlation, surrogate correlation, and what is left of the first without the second."""
    base = rows.select(key, schema.label().alias("y"), F.col(surrogate).cast("double").alias("g")).filter("y is not null")
    fire = z.filter("z <> 0").join(base, key).withColumns({"s": F.signum("z"), "c": 2 * F.col("y") - 1})
    sums = {f"{a}{b}": F.sum(F.col(a) * F.col(b)) for a, b in (("s", "s"), ("c", "c"), ("g", "g"), ("s", "c"), ("s", "g"), ("c", "g"))}
    per = fire.groupBy("feature_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"t_{c}") for c in "scg"], *[v.alias(f"t_{k}") for k, v in sums.items()])
    r = lambda a, b: S.pearson(F.col("n"), F.col(f"t_{a}"), F.col(f"t_{a}{a}"), F.col(f"t_{b}"), F.col(f"t_{b}{b}"), F.col(f"t_{a}{b}"))
    out = per.select("feature_id", F.col("n").alias("n_fire"), r("s", "c").alias("corr"), r("s", "g").alias("corr_len"), r("c", "g").alias("corr_label_len"))
    rest = S.partial(F.col("corr"), F.col("corr_len"), F.col("corr_label_len"))
    out = out.withColumn("corr_resid", rest)
    return out.withColumn("entangled", F.coalesce((F.abs("corr_len") >= 0.3) & (F.abs("corr_resid") < 0.5 * F.abs("corr")), F.lit(False))).drop("corr_label_len")


def side_means(z_a: DataFrame, z_b: DataFrame, rows: DataFrame, key: str = "battle_id") -> DataFrame:
    """Per feature: mean and fire rate on each side, mean contrast, and contrast towards the winner."""
    y = rows.select(key, schema.label().alias("y"))
    n = rows.count()
    decided = y.filter("y is not null and y <> 0.5").count()
    both = z_a.select(key, "feature_id", "z", F.lit(1).alias("side")).union(z_b.select(key, "feature_id", "z", F.lit(-1).alias("side")))
    a, b = F.col("side") == 1, F.col("side") == -1
    signed = F.col("z") * F.col("side")
    toward = F.when(F.col("y").isNotNull(), signed * F.signum(F.col("y") - 0.5)).otherwise(0.0)
    mean = lambda c: S.ratio(F.sum(c), F.lit(n))
    return both.join(y, key).groupBy("feature_id").agg(
        mean(F.when(a, F.col("z")).otherwise(0.0)).alias("mean_a"),
        mean(F.when(b, F.col("z")).otherwise(0.0)).alias("mean_b"),
        S.ratio(count_if(a & (F.col("z") > 0)), F.lit(n)).alias("fire_a"),
        S.ratio(count_if(b & (F.col("z") > 0)), F.lit(n)).alias("fire_b"),
        mean(signed).alias("mean_contrast"),
        S.ratio(F.sum(toward), F.lit(decided)).alias("winner_contrast"),
    )
