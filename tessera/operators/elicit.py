"""Which features go together: associations, co-activation, mutual information, distance.

Pairs come from a self-join of sparse rows on the row identifier, so the work is the sum over rows of
(codes per row) squared; pairs that never meet are completed from margins.  Filter features (verified,
supported) before the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S


def fires(codes: DataFrame, key: str = "battle_id") -> DataFrame:
    return codes.filter("z > 0").select(key, "feature_id")


def association(
    prompts: DataFrame, responses: DataFrame, n_rows: int, n_clusters: int | None = None, key: str = "battle_id",
    min_support: int = 30, min_cooccur: int = 5, p_values: bool = True,
) -> DataFrame:
    """Prompt feature x response feature: lift and Yates chi-square over rows.

    ``prompts`` and ``responses`` hold (key, feature_id) of the features that fire.  Where both sides of
    a battle are stacked as rows, ``n_clusters`` battles scale the statistic down.
    """
    nx = prompts.groupBy(F.col("feature_id").alias("prompt_feature")).agg(F.count("*").alias("n_x"))
    ny = responses.groupBy(F.col("feature_id").alias("completion_feature")).agg(F.count("*").alias("n_y"))
    x = prompts.withColumnRenamed("feature_id", "prompt_feature").join(
        F.broadcast(nx.filter(F.col("n_x") >= min_support).select("prompt_feature")), "prompt_feature", "left_semi"
    )
    both = x.join(responses.withColumnRenamed("feature_id", "completion_feature"), key)
    cells = both.groupBy("prompt_feature", "completion_feature").agg(F.count("*").alias("n_cooccur")).filter(F.col("n_cooccur") >= min_cooccur)
    table = cells.join(F.broadcast(nx), "prompt_feature").join(F.broadcast(ny), "completion_feature")
    n = F.lit(n_rows)
    p_y, p_yx = S.ratio(F.col("n_y"), n), S.ratio(F.col("n_cooccur"), F.col("n_x"))
    scale = min(1.0, (n_clusters or n_rows) / n_rows) if n_rows else 1.0
    out = table.select(
        "prompt_feature", "completion_feature", "n_x", "n_y", "n_cooccur", p_y.alias("p_y"), p_yx.alias("p_y_given_x"),
        (p_yx / p_y).alias("lift"), S.yates_chi2(F.col("n_cooccur"), F.col("n_x"), F.col("n_y"), n, scale).alias("chi2"),
        F.log2(F.greatest(p_yx / p_y, F.lit(1e-6))).alias("log2_lift"),
    )
    if not p_values:
        return out
    tests = nx.filter(F.col("n_x") >= min_support).count() * ny.count()
    out = out.withColumn("p_value", S.chi2_tail("chi2")).withColumn("p_bonferroni", S.bonferroni(F.col("p_value"), tests))
    return out.withColumn("significant", F.col("p_bonferroni") < 0.05)


def coactivation(codes: DataFrame, n_rows: int, key: str = "battle_id", min_support: int = 30, min_cooccur: int = 5, p_values: bool = True) -> DataFrame:
    """The association of a code table with itself, one row per unordered pair (smaller id first)."""
    own = fires(codes, key)
    return association(own, own, n_rows, None, key, min_support, min_cooccur, p_values).filter("prompt_feature < completion_feature")


def stacked(z_a: DataFrame, z_b: DataFrame, key: str = "battle_id") -> DataFrame:
    """Both sides as rows: the key gets the side."""
    tag = lambda z, s: z.select(F.concat(F.col(key).cast("string"), F.lit(s)).alias("row_id"), F.col(key), "feature_id", "z")
    return tag(z_a, "|a").union(tag(z_b, "|b"))


def elicitation(z_prompt: DataFrame, z_a: DataFrame, z_b: DataFrame, n_battles: int, key: str = "battle_id", **options) -> DataFrame:
    """Prompt features against response features over the stacked sides of aligned battles."""
    sides = F.explode(F.array(F.lit("|a"), F.lit("|b")))
    prompts = fires(z_prompt, key).select("*", sides.alias("s")).select(F.concat(F.col(key).cast("string"), "s").alias("row_id"), "feature_id")
    responses = stacked(z_a, z_b, key).filter("z > 0").select("row_id", "feature_id")
    return association(prompts, responses, 2 * n_battles, n_battles, "row_id", **options)


def pair_sums(codes: DataFrame, key: str = "battle_id") -> DataFrame:
    """Unordered pairs that co-fire: (x, y, n11, zz)."""
    one = codes.filter("z <> 0").select(key, F.col("feature_id").alias("x"), F.col("z").alias("zx"))
    two = codes.filter("z <> 0").select(key, F.col("feature_id").alias("y"), F.col("z").alias("zy"))
    return one.join(two, key).filter("x < y").groupBy("x", "y").agg(F.count("*").alias("n11"), F.sum(F.col("zx") * F.col("zy")).alias("zz"))


def pair_grid(codes: DataFrame, key: str = "battle_id") -> DataFrame:
    """All unordered feature pairs with margins and sums; silent pairs have zeros.

    The grid is features x features (the size of the result), never rows x features.
    """
    z = F.col("z")
    margin = codes.filter("z <> 0").groupBy("feature_id").agg(F.count("*").alias("n"), F.sum(z).alias("s"), F.sum(z * z).alias("ss"))
    x = margin.select(F.col("feature_id").alias("x"), F.col("n").alias("nx"), F.col("s").alias("sx"), F.col("ss").alias("sxx"))
    y = margin.select(F.col("feature_id").alias("y"), F.col("n").alias("ny"), F.col("s").alias("sy"), F.col("ss").alias("syy"))
    return x.join(F.broadcast(y), F.col("x") < F.col("y")).join(pair_sums(codes, key), ["x", "y"], "left").fillna(0, ["n11", "zz"])


def mutual_information(codes: DataFrame, n_rows: int, key: str = "battle_id") -> DataFrame:
    """Mutual information of the firing indicators of all feature pairs."""
    grid = pair_grid(codes, key)
    return grid.select("x", "y", S.mutual_information(F.col("n11"), F.col("nx"), F.col("ny"), F.lit(n_rows)).alias("mi"))


def distance(codes: DataFrame, n_rows: int, key: str = "battle_id") -> DataFrame:
    """1 - |correlation| of the code columns; 1 where a column is constant."""
    grid = pair_grid(codes, key)
    r = S.pearson(F.lit(n_rows), F.col("sx"), F.col("sxx"), F.col("sy"), F.col("syy"), F.col("zz"))
    return grid.select("x", "y", (1 - F.abs(F.coalesce(r, F.lit(0.0)))).alias("distance"))


def lens_metrics(codes: DataFrame, rows: DataFrame, m_total: int, key: str = "battle_id") -> DataFrame:
    """One row: dead share, mean codes per row, mean mutual information and |correlation| of pairs."""
    n = rows.count()
    alive = codes.filter("z <> 0").agg(F.count_distinct("feature_id").alias("alive"), F.count("*").alias("nnz"))
    pairs = mutual_information(codes, n, key).join(distance(codes, n, key), ["x", "y"])
    of_pairs = pairs.agg(F.sum("mi").alias("mi"), F.sum(1 - F.col("distance")).alias("abscorr"))
    all_pairs = m_total * (m_total - 1) / 2
    return alive.crossJoin(of_pairs).select(  # one row each
        (1 - F.col("alive") / m_total).alias("dead_frac"),
        S.ratio(F.col("nnz"), F.lit(n)).alias("l0_mean"),
        (F.coalesce("mi", F.lit(0.0)) / all_pairs).alias("redundancy_mi_mean"),
        (F.coalesce("abscorr", F.lit(0.0)) / all_pairs).alias("redundancy_abscorr_mean"),
    )


def best_edges(edges: DataFrame, per_feature: int = 15, per_prompt: int = 30, max_edges: int = 24_000) -> DataFrame:
    """Edges among the strongest of their response feature or prompt feature, or significant; capped for display."""
    from pyspark.sql import Window

    size = F.abs("log2_lift")
    by = lambda own, other: F.row_number().over(Window.partitionBy(own).orderBy(F.desc(size), other))
    ranked = edges.withColumn("_y", by("completion_feature", "prompt_feature")).withColumn("_x", by("prompt_feature", "completion_feature"))
    kept = (F.col("_y") <= per_feature) | (F.col("_x") <= per_prompt)
    order = [F.desc(size), "prompt_feature", "completion_feature"]
    if "significant" in edges.columns:
        kept = kept | F.col("significant")
        order = [F.desc("significant"), *order]
    return ranked.filter(kept).drop("_x", "_y").orderBy(*order).limit(max_edges)


def prompt_type_counts(edges: DataFrame, lift: float = 1.0) -> DataFrame:
    """Per response feature: prompt features with a significant edge and a lift over ``lift``."""
    hit = F.col("lift") > lift
    hit = hit & F.col("significant") if "significant" in edges.columns else hit
    return edges.groupBy(F.col("completion_feature").alias("feature_id")).agg(F.count_distinct(F.when(hit, F.col("prompt_feature"))).alias("n_prompt_types"))
