"""Results by kind of prompt: win rates, prompt-to-response edges, prevalence, omissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import hashing
from ..functions import stats as S
from . import relevance
from .codes import orient_by_label

count_if = F.count_if


def prompt_winrates(meta: DataFrame, prompt_types: DataFrame, key: str = "battle_id", min_battles: int = 20) -> DataFrame:
    """Per model and dominant prompt concept: win rate and rows; silent prompts are left out."""
    return (
        meta.join(prompt_types.select(key, "prompt_concept"), key)
        .groupBy(F.col("self_model").alias("model"), "prompt_concept")
        .agg(F.avg("win").alias("win_rate"), F.count("*").alias("n"))
        .filter(F.col("n") >= min_battles)
    )


def prompt_edges(meta: DataFrame, prompt_types: DataFrame, codes: DataFrame, key: str = "battle_id", min_support: int = 20, top: int | None = 15) -> DataFrame:
    """Within a prompt concept: mean win where a response feature fires minus where it does not."""
    rows = meta.join(prompt_types.select(key, "prompt_concept"), key).filter("win is not null").select("row_id", "self_model", "prompt_concept", "win")
    group = ["self_model", "prompt_concept"]
    totals = rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum("win").alias("w"))
    fired = codes.filter("z > 0").join(rows, "row_id").groupBy(*group, "feature_id").agg(F.count("*").alias("k"), F.sum("win").alias("wk"))
    both = fired.join(F.broadcast(totals), group).filter((F.col("k") >= min_support) & (F.col("n") - F.col("k") >= min_support))
    delta = F.col("wk") / F.col("k") - (F.col("w") - F.col("wk")) / (F.col("n") - F.col("k"))
    out = both.select(F.col("self_model").alias("model"), "prompt_concept", F.col("feature_id").alias("response_concept"), delta.alias("delta_win"), F.col("k").alias("n"))
    if top is None:
        return out
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc(F.abs("delta_win")), "prompt_concept", "response_concept"))
    return out.withColumn("_r", rank).filter(F.col("_r") <= top).drop("_r")


def winning_prevalence(z_a: DataFrame, z_b: DataFrame, battles: DataFrame, prompt_types: DataFrame, key: str = "battle_id") -> DataFrame:
    """Per prompt type and feature over decisive battles: share of winners and of losers on which it fires."""
    rows = battles.select(key, schema.label().alias("y")).filter("y is not null and y <> 0.5").join(prompt_types.select(key, "prompt_concept"), key)
    sizes = rows.groupBy("prompt_concept").agg(F.count("*").alias("n_win"))
    side = lambda z, v: z.filter("z > 0").select(key, "feature_id", F.lit(v).alias("side"))
    fired = side(z_a, 1.0).union(side(z_b, 0.0)).join(rows, key)
    won = (F.col("side") == 1.0) == (F.col("y") > 0.5)
    counts = fired.groupBy("prompt_concept", "feature_id").agg(count_if(won).alias("k_win"), count_if(~won).alias("k_lose"))
    out = counts.join(F.broadcast(sizes), "prompt_concept")
    return out.select(
        "prompt_concept", "feature_id", "n_win", S.ratio(F.col("k_win"), F.col("n_win")).alias("p_win"),
        S.ratio(F.col("k_lose"), F.col("n_win")).alias("p_lose"), S.wilson_lower(F.col("k_win"), F.col("n_win")).alias("p_win_wilson_lb"),
    )


def gap_stats(prevalence: DataFrame, min_battles: int = 1) -> DataFrame:
    """Distribution of |winner share - loser share| over (prompt type, feature)."""
    gap = prevalence.filter(F.col("n_win") >= min_battles).select(F.abs(F.col("p_win") - F.col("p_lose")).alias("gap"))
    return gap.agg(
        F.count("*").alias("n_cells"), F.percentile("gap", 0.5).alias("median"), F.percentile("gap", 0.9).alias("p90"),
        F.max("gap").alias("max"), F.avg((F.col("gap") > 0.05).cast("double")).alias("over_5pp"), F.avg((F.col("gap") > 0.1).cast("double")).alias("over_10pp"),
    )


def gate(edges: DataFrame, conditional: DataFrame) -> DataFrame:
    """(prompt_concept, feature_id) that prompts elicit and the label rewards."""
    elicited = edges.filter("significant and lift > 1").select(F.col("prompt_feature").alias("prompt_concept"), F.col("completion_feature").alias("feature_id"))
    rewarded = conditional.filter("cond_significant and delta_win_rate > 0").select("prompt_concept", "feature_id")
    return elicited.intersect(rewarded)


def omissions(
    z_a: DataFrame, z_b: DataFrame, battles: DataFrame, prompt_types: DataFrame, candidates: DataFrame, key: str = "battle_id", min_battles: int = 300,
    min_expected: float = 0.15, min_shortfall: float = 0.05, min_norm: float = 0.8, min_gap: float = 0.1, min_wins: int = 200, p_values: bool = True,
) -> DataFrame:
    """Per model, prompt type and candidate feature: how much less often it fires than for opponents.

    A battle of a model against itself counts once, as its side a.  Wins are those of decisive battles.
    Cells whose opponents fire under ``min_expected`` are no cells, also not for the correction.
    """
    half = hashing.half(key)
    y = schema.label()
    base = battles.join(prompt_types.select(key, "prompt_concept"), key).select(key, "prompt_concept", "model_a", "model_b", y.alias("y"), half.alias("half"))
    sides = F.array(
        F.struct(F.col("model_a").alias("model"), F.lit(1).alias("is_a"), F.col("y").alias("win")),
        F.struct(F.col("model_b").alias("model"), F.lit(0).alias("is_a"), (1 - F.col("y")).alias("win")),
    )
    rows = base.select(key, "prompt_concept", "half", F.explode(F.when(F.col("model_a") == F.col("model_b"), F.slice(sides, 1, 1)).otherwise(sides)).alias("s"))
    rows = rows.select(key, "prompt_concept", "half", "s.model", "s.is_a", F.when(F.col("s.win") != 0.5, F.col("s.win")).alias("win"))
    cell = ["model", "prompt_concept"]
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("n"), count_if(F.col("half") == 0).alias("n0"), F.sum("win").alias("w"), F.count("win").alias("nw"))
    sizes = sizes.filter(F.col("n") >= min_battles)
    side = lambda z, v: z.filter("z > 0").select(key, "feature_id", F.lit(v).alias("fired_a"))
    hits = side(z_a, 1).union(side(z_b, 0)).join(rows, key).join(F.broadcast(candidates.select("prompt_concept", "feature_id")), ["prompt_concept", "feature_id"], "left_semi")
    # One row per own-or-opponent firing; both on one row are folded first.
    folded = hits.groupBy(key, *cell, "half", "is_a", "win", "feature_id").agg(
        F.max((F.col("fired_a") == F.col("is_a")).cast("int")).alias("own"), F.max((F.col("fired_a") != F.col("is_a")).cast("int")).alias("opp")
    )
    first = F.col("half") == 0
    counts = folded.groupBy(*cell, "feature_id").agg(
        F.sum("own").alias("own"), F.sum("opp").alias("opp"), F.sum(F.when(first, F.col("own")).otherwise(0)).alias("own0"), F.sum(F.when(first, F.col("opp")).otherwise(0)).alias("opp0"),
        count_if((F.col("own") == 0) & (F.col("opp") == 1)).alias("b01"), count_if((F.col("own") == 1) & (F.col("opp") == 0)).alias("b10"),
        F.sum(F.when(F.col("own") == 1, F.col("win"))).alias("w1"), F.count(F.when(F.col("own") == 1, F.col("win"))).alias("nw1"),
    )
    n, n0 = F.col("n"), F.col("n0")
    short = (F.col("opp") - F.col("own")).cast("double") / n
    short0 = S.ratio((F.col("opp0") - F.col("own0")).cast("double"), n0)
    short1 = S.ratio(((F.col("opp") - F.col("opp0")) - (F.col("own") - F.col("own0"))).cast("double"), n - n0)
    norm = winning_prevalence(z_a, z_b, battles, prompt_types, key)
    cells = counts.join(F.broadcast(sizes), cell).filter(F.col("opp") >= min_expected * F.col("n"))
    out = cells.join(norm, ["prompt_concept", "feature_id"], "left").select(
        *cell, "feature_id", "n", F.round(F.col("opp") / n, 4).alias("expected"), F.round(F.col("own") / n, 4).alias("produced"), F.round(short, 4).alias("shortfall"),
        S.mcnemar_chi2(F.col("b01"), F.col("b10")).alias("mcnemar_chi2"),
        F.coalesce((F.signum(short0) * F.signum(short1) > 0) & (short > 0), F.lit(False)).alias("stable"),
        F.round(S.ratio(F.col("w1"), F.col("nw1")), 4).alias("won_when_fired"), F.round(S.ratio(F.col("w") - F.coalesce("w1", F.lit(0.0)), F.col("nw") - F.col("nw1")), 4).alias("won_when_not"),
        F.round("p_win", 4).alias("p_win"), F.round("p_lose", 4).alias("p_lose"), F.round("p_win_wilson_lb", 4).alias("win_wilson_lb"), F.coalesce("n_win", F.lit(0)).alias("n_win"),
    )
    normal = (F.col("win_wilson_lb") >= min_norm) & (F.col("p_win") - F.col("p_lose") >= min_gap) & (F.col("n_win") >= min_wins)
    out = out.withColumn("expected_norm", F.coalesce(normal, F.lit(False)))
    if not p_values:
        return out
    out = out.withColumn("mcnemar_p", S.chi2_tail("mcnemar_chi2"))
    out = out.withColumn("mcnemar_p_bonferroni", S.bonferroni(F.col("mcnemar_p"), cells.count()))
    flag = F.col("stable") & (F.col("shortfall") >= min_shortfall) & (F.col("mcnemar_p_bonferroni") < 0.05) & F.col("expected_norm")
    return out.withColumn("flagged", flag)


def prompt_delta(z_diff: DataFrame, battles: DataFrame, prompt_types: DataFrame, key: str = "battle_id", p_values: bool = True) -> DataFrame:
    """Region contrast of winner-oriented codes by dominant prompt concept (silent prompts are region -1)."""
    decided = battles.select(key, schema.label().alias("y")).filter("y is not null and y <> 0.5")
    region = decided.join(prompt_types.select(key, "prompt_concept"), key, "left").select(key, F.coalesce("prompt_concept", F.lit(-1)).alias("cluster_id"))
    return relevance.region_contrast(orient_by_label(z_diff, battles, key), region, key, p_values=p_values)


def delta_null(z_diff: DataFrame, battles: DataFrame, prompt_types: DataFrame, times: int = 20, key: str = "battle_id", seed: int = 0) -> dict:
    """How many cells of ``prompt_delta`` survive when prompt concepts are dealt to other battles, against the observed.

    A shuffle pairs the battles in one drawn order with the concepts in another, rank by rank; ranks are
    counted within ranges of the hash, so no shuffle sorts all rows in one task.
    """
    found = lambda types: prompt_delta(z_diff, battles, types, key).filter("p_bonferroni < 0.05 and stable").count()
    observed = found(prompt_types)
    null = [found(shuffled(prompt_types, "prompt_concept", key, f"{seed}|{i}")) for i in range(times)]
    return {"observed": observed, "null": null, "p": (1 + sum(n >= observed for n in null)) / (times + 1)}


def shuffled(rows: DataFrame, column: str, key: str, salt: str) -> DataFrame:
    """(key, column) with the values of the column dealt to other keys by two drawn orders."""
    drawn = lambda name: F.sha1(F.concat(F.col(key).cast("string"), F.lit(f"|{name}|{salt}")))

    def numbered(df, name):
        # The first three hex digits make 4096 ranges of the order; a range's rows are ranked in one group.
        part = F.substring("_h", 1, 3)
        own = df.withColumn("_h", drawn(name)).withColumn("_part", part)
        sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))
        before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        rank = F.row_number().over(Window.partitionBy("_part").orderBy("_h", key))
        ranked = own.withColumn("_r", rank).join(F.broadcast(before), "_part")
        return ranked.select(*df.columns, (F.col("_r") + F.coalesce("_before", F.lit(0))).alias("_at"))

    return numbered(rows.select(key), "to").join(numbered(rows.select(key, column), "from").select(column, "_at"), "_at").select(key, column)


def cluster_scores(codes: DataFrame, clusters: DataFrame, key: str = "battle_id", aggregate: str = "mean") -> DataFrame:
    """Mean (or sum) of the member codes of each cluster per row; a cluster without codes has no row."""
    sizes = clusters.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("m"))
    sums = codes.join(F.broadcast(clusters.filter("cluster_id is not null")), "feature_id").groupBy(key, "cluster_id").agg(F.sum("z").alias("z"))
    if aggregate == "sum":
        return sums
    return sums.join(F.broadcast(sizes), "cluster_id").select(key, "cluster_id", (F.col("z") / F.col("m")).alias("z"))
