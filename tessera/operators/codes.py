"""Sparse codes from vectors, their representations, and the two-sided bank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text


def doubles(c):
    return F.transform(c, lambda x: x.cast("double"))


def difference(a, b):
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def sparse(df: DataFrame, vector, threshold: float, *keys: str, positive: bool = False) -> DataFrame:
    """(keys, feature_id, z) of the entries whose size is over the threshold."""
    size = F.col("z") if positive else F.abs("z")
    return df.select(*keys, F.posexplode(vector).alias("feature_id", "z")).filter(size > threshold)


def represent(df: DataFrame, kind: str, a: str = "e_a", b: str = "e_b"):
    """Training vectors of a pair: ``difference``, ``concat`` or ``individual`` (one row per side)."""
    if kind == "difference":
        return df.withColumn("vector", difference(F.col(a), F.col(b)))
    if kind == "concat":
        return df.withColumn("vector", F.concat(doubles(F.col(a)), doubles(F.col(b))))
    if kind == "individual":
        sides = F.array(F.struct(F.lit("a").alias("side"), doubles(F.col(a)).alias("vector")), F.struct(F.lit("b").alias("side"), doubles(F.col(b)).alias("vector")))
        return df.withColumn("s", F.explode(sides)).select("*", "s.side", "s.vector").drop("s")
    if kind == "prompt":
        raise ValueError("a prompt lens has one vector per row and no contrast")
    raise ValueError(f"unknown representation {kind!r}: use difference, concat or individual")


def contrast(z_a: DataFrame, z_b: DataFrame, key: str = "row_id") -> DataFrame:
    """z_a - z_b per row and feature; entries that cancel are dropped."""
    both = z_a.select(key, "feature_id", "z").union(z_b.select(key, "feature_id", (-F.col("z")).alias("z")))
    return both.groupBy(key, "feature_id").agg(F.sum("z").alias("z")).filter("z <> 0")


def symmetric_activity(z_a: DataFrame, z_b: DataFrame, key: str = "row_id") -> DataFrame:
    """Mean size of the two sides' codes."""
    both = z_a.select(key, "feature_id", "z").union(z_b.select(key, "feature_id", "z"))
    return both.groupBy(key, "feature_id").agg((F.sum(F.abs("z")) / 2).alias("activity"))


def code_stats(codes: DataFrame, rows: DataFrame, key: str = "row_id") -> DataFrame:
    """One row: rows, features that fire, mean number of codes per row, rows without any."""
    per_row = rows.select(key).join(codes.groupBy(key).agg(F.count("*").alias("l0")), key, "left")
    used = codes.agg(F.count_distinct("feature_id").alias("n_features_used"))
    return per_row.agg(
        F.count("*").alias("n_rows"),
        F.avg(F.coalesce("l0", F.lit(0))).alias("mean_l0"),
        F.sum(F.when(F.col("l0").isNull(), 1).otherwise(0)).alias("n_silent"),
    ).crossJoin(used)  # one row each


def oriented(battles: DataFrame, key: str = "battle_id") -> DataFrame:
    """Both sides of each battle as rows: row_id, orientation, self and other model, win, length gap."""
    y = schema.strict_label()
    has_text = {"completion_a", "completion_b"} <= set(battles.columns)
    gap = text.word_count(F.col("completion_a")) - text.word_count(F.col("completion_b")) if has_text else F.lit(0)

    def side(name, sign, own, other, win):
        return F.struct(
            F.lit(name).alias("orientation"), F.lit(sign).alias("sign"), F.col(own).alias("self_model"), F.col(other).alias("other_model"),
            win.alias("win"), (gap * sign).cast("long").alias("length"),
        )

    sides = F.array(side("a", 1, "model_a", "model_b", y), side("b", -1, "model_b", "model_a", 1 - y))
    out = battles.withColumn("o", F.explode(sides)).select(key, "o.*")
    return out.withColumn("row_id", F.concat(F.col(key).cast("string"), F.lit("|"), "orientation"))


def bank(battles: DataFrame, z_diff: DataFrame, key: str = "battle_id") -> tuple[DataFrame, DataFrame]:
    """(meta, codes) of both orientations; the code of b-as-self is the code of a with its sign turned.

    That holds for individual codes (z_a - z_b); a difference lens passes both encodings to
    ``bank_from_passes``.
    """
    meta = oriented(battles, key)
    flipped = F.explode(F.array(F.struct(F.lit("a").alias("o"), F.col("z").alias("v")), F.struct(F.lit("b").alias("o"), (-F.col("z")).alias("v"))))
    codes = z_diff.select(key, "feature_id", flipped.alias("s")).select(
        F.concat(F.col(key).cast("string"), F.lit("|"), "s.o").alias("row_id"), "feature_id", F.col("s.v").alias("z")
    )
    return meta.drop("sign"), codes


def bank_from_passes(battles: DataFrame, forward: DataFrame, backward: DataFrame, key: str = "battle_id") -> tuple[DataFrame, DataFrame]:
    """(meta, codes) where each orientation has its own encoding."""
    tag = lambda df, o: df.select(F.concat(F.col(key).cast("string"), F.lit(f"|{o}")).alias("row_id"), "feature_id", "z")
    return oriented(battles, key).drop("sign"), tag(forward, "a").union(tag(backward, "b"))


def orient_by_label(codes: DataFrame, battles: DataFrame, key: str = "battle_id", drop_ties: bool = True) -> DataFrame:
    """Codes of winner minus loser; unlabelled rows go, ties go or become zero."""
    y = battles.select(key, schema.label().alias("y")).filter("y is not null")
    y = y.filter("y <> 0.5") if drop_ties else y
    return codes.join(y, key).select(key, "feature_id", (F.col("z") * F.signum(F.col("y") - 0.5)).alias("z"))


def orient_to_model(battles: DataFrame, model: str) -> DataFrame:
    """Battles of one model from its side; a battle against itself is seen from side a."""
    y, is_a = schema.strict_label(), F.col("model_a") == model
    win = F.when(is_a, y).otherwise(1 - y)
    pick = lambda a, b: F.when(is_a, F.col(a)).otherwise(F.col(b))
    return battles.filter(is_a | (F.col("model_b") == model)).select(
        "battle_id",
        F.when(is_a, 1).otherwise(-1).alias("sign"),
        F.lit(model).alias("self_model"),
        pick("model_b", "model_a").alias("other_model"),
        pick("completion_a", "completion_b").alias("self_text"),
        pick("completion_b", "completion_a").alias("other_text"),
        win.alias("win"),
        F.when(win == 1, "win").when(win == 0, "loss").when(win == 0.5, "tie").alias("outcome"),
    )


def dominant(codes: DataFrame, key: str = "battle_id") -> DataFrame:
    """The strongest positive feature of each row (ties: the smaller id); silent rows have none."""
    best = F.struct(F.col("z"), (-F.col("feature_id")).alias("minus_id"))
    return codes.filter("z > 0").groupBy(key).agg(F.max(best).alias("m")).select(key, (-F.col("m.minus_id")).alias("prompt_concept"), F.col("m.z").alias("activation"))


def summarize_spans(tokens: DataFrame, codes: DataFrame, span: tuple[str, ...] = ("battle_id", "span")) -> DataFrame:
    """Per span and feature: largest code over all tokens (a silent token counts as 0), share that fires."""
    sizes = tokens.groupBy(*span).agg(F.count("*").alias("n_tokens"))
    found = codes.groupBy(*span, "feature_id").agg(F.max("z").alias("top"), F.count("*").alias("n_fire"))
    x_max = F.when(F.col("n_fire") < F.col("n_tokens"), F.greatest("top", F.lit(0.0))).otherwise(F.col("top"))
    return found.join(sizes, list(span)).select(*span, "feature_id", x_max.alias("x_max"), (F.col("n_fire") / F.col("n_tokens")).alias("x_freq"))


def drop_outliers(tokens: DataFrame, vector: str = "vector", factor: float = 6.0, span: tuple[str, ...] = ("battle_id", "span")) -> DataFrame:
    """Tokens whose norm is at most ``factor`` times the mean norm of their span."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    sized = tokens.withColumn("_norm", norm)
    mean = sized.groupBy(*span).agg(F.avg("_norm").alias("_mean"))
    return sized.join(mean, list(span)).filter(F.col("_norm") <= factor * F.col("_mean")).drop("_norm", "_mean")
