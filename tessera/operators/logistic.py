"""Length-controlled relevance: one logistic regression per feature (and per group).

y ~ 1 + z + length, standardised, fitted by damped Newton steps.  A feature is silent on most rows,
and the silent rows enter the likelihood only through their length and label, so each fit takes the
feature's firing rows plus a histogram of (length, label) over all rows: exact, and proportional to the
feature's non-zeros instead of to all rows.

A fit with at most HOT_ROWS firing rows runs in one task.  Hotter features are fitted together by the same
steps, each step one aggregate of gradients and Hessians over their firing rows, so that no task ever
holds a feature's rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import stats as S

COLUMNS = "feature_id int, beta double, delta_win_rate double, lr_chi2 double, separable boolean, n_battles long, n_fire long"
#: A standardised coefficient over this size counts as separation.
SEPARATED = 10.0
#: Firing rows that one task may hold for a fit.
HOT_ROWS = 1_000_000


def sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and negative Hessian of a weighted logistic regression."""
    p = np.clip(sigmoid(x @ b), 1e-12, 1 - 1e-12)
    like = float(w @ (y * np.log(p) + (1 - y) * np.log(1 - p)))
    return like, x.T @ (w * (y - p)), (x * (w * p * (1 - p))[:, None]).T @ x


def newton(size: int, ridge: float = 0.0, steps: int = 60):
    """Damped Newton steps: yields coefficients, is sent their ``sums``, returns (coefficients, log-likelihood).

    The first coefficient is free of the ridge.
    """
    penalty = np.full(size, ridge)
    penalty[0] = 0.0
    b = np.zeros(size)
    like, grad, hess = yield b
    for _ in range(steps):
        now = like - 0.5 * penalty @ b**2
        noise = abs(like) * 1e-13
        move = np.linalg.solve(hess + np.diag(penalty + 1e-10), grad - penalty * b)
        scale = 1.0
        for _ in range(30):
            new = b + scale * move
            like, grad, hess = yield new
            value = like - 0.5 * penalty @ new**2
            if value >= now - max(1e-12, noise):
                break
            scale /= 2
        b = new
        if abs(value - now) < max(1e-10, noise) or (not ridge and np.abs(b).max() > 3 * SEPARATED):
            break
    return b, like


def relevance(null: float, lengths: np.ndarray, w: np.ndarray):
    """Steps of one feature's fit, given the fit without it and the standardised lengths of all rows."""
    b, like = yield from newton(3)
    separable = abs(b[1]) > SEPARATED
    if separable:
        b, _ = yield from newton(3, ridge=1.0)
    move = w @ (sigmoid(b[0] + b[1] + b[2] * lengths) - sigmoid(b[0] + b[2] * lengths)) / w.sum()
    return float(b[1]), float(move), None if separable else max(0.0, float(2 * (like - null))), bool(separable)


def settle(fits: dict, evaluate) -> dict:
    """Results of several fits that go on together; ``evaluate`` gives the sums for {fit: coefficients}."""
    asked, done = {k: next(fit) for k, fit in fits.items()}, {}
    while asked:
        for k, got in evaluate(asked).items():
            try:
                asked[k] = fits[k].send(got)
            except StopIteration as end:
                done[k] = end.value
                del asked[k]
    return done


def settle_one(fit, x: np.ndarray, y: np.ndarray, w: np.ndarray):
    return settle({0: fit}, lambda asked: {0: sums(x, y, w, asked[0])})[0]


class Base:
    """The histogram (length, y, n) of all rows of a group: standardised lengths, and the fit on them alone."""

    def __init__(self, table: pd.DataFrame):
        self.grid = table.set_index(["length", "y"])["n"].astype(float)
        length, self.y, self.w = table["length"].to_numpy(float), table["y"].to_numpy(float), table["n"].to_numpy(float)
        self.n = self.w.sum()
        self.mean = (self.w @ length) / self.n
        sd = math.sqrt(max(0.0, (self.w @ (length - self.mean) ** 2) / self.n))
        self.sd = sd if sd > 1e-12 else math.inf
        self.lengths = self.standard(length)
        self.mixed = len(np.unique(self.y)) > 1

    def standard(self, length: np.ndarray) -> np.ndarray:
        return (length - self.mean) / self.sd

    def fit(self):
        """Steps of a feature's fit."""
        one = np.ones_like(self.lengths)
        _, null = settle_one(newton(2), np.stack([one, self.lengths], 1), self.y, self.w)
        return relevance(null, self.lengths, self.w)

    def quiet(self, fired: pd.Series, level: float):
        """(x, y, w) of the rows on which a feature is silent, whose standardised code is ``level``."""
        left = self.grid.sub(fired, fill_value=0)
        left = left[left > 0].reset_index()
        left.columns = ["length", "y", "n"]
        x = np.stack([np.ones(len(left)), np.full(len(left), level), self.standard(left["length"].to_numpy(float))], 1)
        return x, left["y"].to_numpy(float), left["n"].to_numpy(float)

    def spread(self, m: float, mean: float, variance: float) -> tuple[float, float]:
        """Mean and deviation over all rows of a code with these figures on its m firing rows."""
        whole = mean * (m / self.n)
        return whole, math.sqrt(max(0.0, (m * variance + m * (mean - whole) ** 2 + (self.n - m) * whole**2) / self.n))


def fit_feature(z: np.ndarray, length: np.ndarray, y: np.ndarray, table: pd.DataFrame) -> tuple:
    """Fit from the firing rows and the histogram (length, y, n) of all rows."""
    base = Base(table)
    mean, sd = base.spread(len(z), z.mean(), z.var())
    if sd <= 1e-12 or not base.mixed:
        return None, None, None, False, int(base.n), len(z)
    x, ys, w = base.quiet(pd.DataFrame({"length": length, "y": y}).groupby(["length", "y"]).size(), -mean / sd)
    x = np.concatenate([np.stack([np.ones(len(z)), (z - mean) / sd, base.standard(length)], 1), x])
    got = settle_one(base.fit(), x, np.concatenate([y, ys]), np.concatenate([np.ones(len(z)), w]))
    return *got, int(base.n), len(z)


def fit_hot(fired: DataFrame, keys: list[str], hist: dict) -> list[tuple]:
    """The fits of all features of ``fired`` (keys, z, length, y) by aggregates; one row a feature."""
    spark = fired.sparkSession
    figures = fired.groupBy(*keys).agg(F.count("*").alias("m"), F.avg("z").alias("mean"), F.var_pop("z").alias("var")).collect()
    cells: dict = {}
    for r in fired.groupBy(*keys, "length", "y").agg(F.count("*").alias("n")).toPandas().groupby(keys):
        cells[r[0]] = r[1].set_index(["length", "y"])["n"]
    bases = {g: Base(table) for g, table in hist.items()}
    out, fits, scales, quiet = [], {}, {}, {}
    sizes = {}
    for r in figures:
        k = tuple(r[c] for c in keys)
        base = bases[k[0] if len(k) > 1 else None]
        mean, sd = base.spread(r["m"], r["mean"], r["var"])
        sizes[k] = (int(base.n), r["m"])
        if sd <= 1e-12 or not base.mixed:
            out.append((*k, None, None, None, False, *sizes[k]))
            continue
        fits[k], scales[k] = base.fit(), tuple(map(float, (mean, sd, base.mean, base.sd)))
        quiet[k] = base.quiet(cells[k], -mean / sd)
    kinds = dict(fired.dtypes)
    names = ["z_mean", "z_sd", "l_mean", "l_sd", "b0", "b1", "b2"]
    fields = ", ".join([f"{c} {kinds[c]}" for c in keys] + [f"{c} double" for c in names])
    x = [F.lit(1.0), (F.col("z") - F.col("z_mean")) / F.col("z_sd"), (F.col("length") - F.col("l_mean")) / F.col("l_sd")]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]

    def evaluate(asked: dict) -> dict:
        # One row per hot feature; firing rows over HOT_ROWS each bound their number.
        now = spark.createDataFrame([(*k, *scales[k], *map(float, b)) for k, b in asked.items()], fields)
        at = fired.join(F.broadcast(now), keys).select(*keys, "y", *(v.alias(f"x{i}") for i, v in enumerate(x)), "b0", "b1", "b2")
        eta = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum(F.col(f"b{i}") * F.col(f"x{i}") for i in range(3))))
        at = at.withColumn("p", F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), 1 / (1 + F.exp(-eta)))))
        y, p = F.col("y"), F.col("p")
        rows = at.groupBy(*keys).agg(
            F.sum(y * F.log(p) + (1 - y) * F.log(1 - p)).alias("like"),
            *(F.sum((y - p) * F.col(f"x{i}")).alias(f"g{i}") for i in range(3)),
            *(F.sum(p * (1 - p) * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}{j}") for i, j in pairs),
        ).collect()
        got = {}
        for r in rows:
            k = tuple(r[c] for c in keys)
            like, grad, hess = sums(*quiet[k], asked[k])
            fired_hess = np.array([[r[f"h{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
            got[k] = like + r["like"], grad + np.array([r[f"g{i}"] for i in range(3)]), hess + fired_hess
        return got

    return out + [(*k, *got, *sizes[k]) for k, got in settle(fits, evaluate).items()]


def controlled(codes: DataFrame, rows: DataFrame, length: str = "length", key: str = "battle_id", by: str | None = None, min_battles: int = 1, p_values: bool = True) -> DataFrame:
    """Length-controlled relevance per feature, or per (``by``, feature) with enough decisive rows.

    Only decisive rows count.  The histogram has one row per distinct (group, length, label), a bound set by
    text lengths and not by rows, and travels to each fit inside the group's key.
    """
    y = schema.label()
    group = [by] if by else []
    base = rows.select(key, *group, F.col(length).cast("double").alias("length"), y.alias("y")).filter("y is not null and y <> 0.5")
    base = base.withColumn("y", (F.col("y") > 0.5).cast("double"))
    if by:
        base = base.filter(F.col(by).isNotNull())
    cells = base.groupBy(*group, "length", "y").agg(F.count("*").alias("n"))
    if by:
        enough = base.groupBy(by).agg(F.count("*").alias("m")).filter(F.col("m") >= min_battles)
        cells = cells.join(enough.select(by), by, "left_semi")
        base = base.join(F.broadcast(enough.select(by)), by, "left_semi")
    table = cells.toPandas()
    hist = {k: g[["length", "y", "n"]] for k, g in (table.groupby(by) if by else [(None, table)])}
    fired = codes.filter("z <> 0").join(base, key).select(*group, "feature_id", "z", "length", "y")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf[by].iloc[0] if by else None
        got = fit_feature(pdf["z"].to_numpy(), pdf["length"].to_numpy(), pdf["y"].to_numpy(), hist[g])
        row = [pdf["feature_id"].iloc[0], *got]
        return pd.DataFrame([[g, *row] if by else row], columns=[*group, *[c.split()[0] for c in COLUMNS.split(", ")]])

    kind = dict(rows.dtypes).get(by, "string") if by else None
    fields = (f"{by} {kind}, " if by else "") + COLUMNS
    keys = [*group, "feature_id"]
    hot = fired.groupBy(*keys).agg(F.count("*").alias("m")).filter(F.col("m") > HOT_ROWS).select(*keys).collect()
    if hot:
        few = F.broadcast(rows.sparkSession.createDataFrame(hot, fired.select(*keys).schema))
        largest = fired.join(few, keys, "left_semi").persist()
        fits = fit_hot(largest, keys, hist)
        largest.unpersist()
        fired = fired.join(few, keys, "left_anti")
    out = fired.groupBy(*keys).applyInPandas(fit, fields)
    if hot:
        out = out.unionByName(rows.sparkSession.createDataFrame(fits, fields))
    if not p_values:
        return out
    out = out.withColumn("lr_p", S.chi2_tail("lr_chi2"))
    tests = out.count()
    return out.withColumn("p_bonferroni", S.bonferroni(F.col("lr_p"), tests)).withColumn("significant", F.coalesce(F.col("p_bonferroni") < 0.05, F.lit(False)))


def conditional(codes: DataFrame, rows: DataFrame, prompt_types: DataFrame, key: str = "battle_id", min_battles: int = 300, min_fire: int = 20) -> DataFrame:
    """The same inside each prompt type; significance also needs enough firing rows."""
    typed = rows.join(prompt_types.select(key, "prompt_concept"), key)
    out = controlled(codes, typed, key=key, by="prompt_concept", min_battles=min_battles)
    return out.select(
        "prompt_concept", "feature_id", "beta", "delta_win_rate", "lr_p", "n_battles", "n_fire", F.col("p_bonferroni").alias("cond_p_bonferroni"),
        (F.col("significant") & (F.col("n_fire") >= min_fire)).alias("cond_significant"),
    )


def by_language(codes: DataFrame, rows: DataFrame, key: str = "battle_id", min_battles: int = 2000) -> DataFrame:
    return controlled(codes, rows, key=key, by="language", min_battles=min_battles)


def by_cluster(codes: DataFrame, rows: DataFrame, clusters: DataFrame, key: str = "battle_id", aggregate: str = "mean") -> DataFrame:
    """Relevance of clusters: the mean (or sum) of their members' codes as one feature."""
    from .conditional import cluster_scores

    scores = cluster_scores(codes, clusters, key, aggregate).withColumnRenamed("cluster_id", "feature_id")
    sizes = clusters.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n_features"))
    out = controlled(scores, rows, key=key).withColumnRenamed("feature_id", "cluster_id")
    return out.join(F.broadcast(sizes), "cluster_id").orderBy(F.desc(F.abs("delta_win_rate")), "cluster_id")
