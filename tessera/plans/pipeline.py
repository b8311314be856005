"""A configured run: name, verify, cluster, relevance, in this order whatever the list says."""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import hashing
from ..operators import cluster, interpret, logistic, relevance, select
from . import registry

STAGES = ("name", "verify", "cluster", "relevance")


@dataclass
class Config:
    """What a run does.  Unknown keys, stages or clusterer parameters are errors before anything runs."""

    stages: list[str] = field(default_factory=lambda: list(STAGES))
    n_active: int = 10
    n_zero: int = 10
    n_per_bucket: int = 10
    verify_share: float = 0.2
    presence: bool = False
    clusterer: str = "agglomerative"
    clusterer_params: dict = field(default_factory=dict)
    fidelity_only: bool = False

    @classmethod
    def from_dict(cls, given: dict) -> Config:
        known = {f.name for f in fields(cls)}
        wrong = sorted(set(given) - known)
        if wrong:
            raise ValueError(f"unknown settings: {', '.join(wrong)}")
        out = cls(**given)
        wrong = sorted(set(out.stages) - set(STAGES))
        if wrong:
            raise ValueError(f"unknown stages: {', '.join(wrong)}; known: {', '.join(STAGES)}")
        taken = set(inspect.signature(registry.get("clusterer", out.clusterer).__init__).parameters) - {"self"}
        wrong = sorted(set(out.clusterer_params) - taken)
        if wrong:
            raise ValueError(f"unknown parameters of {out.clusterer}: {', '.join(wrong)}")
        return out


def preflight(config: Config, rows: DataFrame, names: DataFrame | None, ask) -> None:
    """Fail before the first stage."""
    if {"name", "verify"} & set(config.stages) and ask is None:
        raise ValueError("naming and verifying need a model function")
    if "verify" in config.stages and "name" not in config.stages and names is None:
        raise ValueError("verifying needs names")
    if "relevance" in config.stages and not schema.has_preference(rows):
        raise ValueError("relevance needs labels")


def run(config: Config, codes: DataFrame, rows: DataFrame, texts: DataFrame, ask=None, names: DataFrame | None = None, key: str = "battle_id") -> dict[str, DataFrame]:
    """Tables by stage: names, fidelity, clusters, cluster_summary, relevance."""
    preflight(config, rows, names, ask)
    out: dict[str, DataFrame] = {}
    held = hashing.held_out(key, config.verify_share)
    if "name" in config.stages:
        examples = select.naming_examples(codes, rows.filter(~held), config.n_active, config.n_zero, key)
        out["names"] = names = interpret.name_features(examples, texts, ask, key)
    if "verify" in config.stages:
        buckets = select.holdout_buckets(codes, rows.filter(held), config.n_per_bucket, key)
        out["fidelity"] = interpret.verify_features(names, buckets, texts, ask, key, config.presence)
        names = names.join(out["fidelity"].select("feature_id", "fidelity_pass", "correlation"), "feature_id", "left")
    if config.fidelity_only and names is not None and "fidelity_pass" in names.columns:
        codes = codes.join(F.broadcast(names.filter("coalesce(fidelity_pass, false)").select("feature_id")), "feature_id", "left_semi")
    if "cluster" in config.stages:
        out["clusters"] = registry.make("clusterer", config.clusterer, **config.clusterer_params)(codes, rows.count(), key)
        if names is not None:
            out["cluster_summary"] = cluster.summarize(out["clusters"], names)
    if "relevance" in config.stages:
        table = relevance.win_relevance(codes, rows, key)
        if "length" in rows.columns:
            controlled = logistic.controlled(codes, rows, key=key).select("feature_id", "beta", "delta_win_rate", "lr_p", "separable")
            table = table.join(controlled, "feature_id", "left")
        if names is not None:
            table = table.join(F.broadcast(names), "feature_id", "left")
        out["relevance"] = table.orderBy(F.desc_nulls_last("win_assoc"), "feature_id")
    return out
