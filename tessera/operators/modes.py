"""Naming and verifying by what a feature reads: pairs of responses, single responses, or prompts.

A mode fixes the units that a reader sees (one per battle, one per side, one per prompt) and how its verdict
is read.  The held-out part is drawn by battle, so both sides of a battle are in the same part.

Defined cases: a missing text reads as empty; features without a tested name are failing rows with a
reason; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import text as T
from . import interpret, select

MODES = ("pairwise", "individual", "single-text")
UNIT = "unit_id"


def units(rows: DataFrame, mode: str, key: str = "battle_id", width: int = 600) -> DataFrame:
    """(unit_id, text): the unit is the battle, a side of it (``id|a``, ``id|b``) or its prompt."""
    part = lambda c: T.truncate(F.col(c), width)
    context = lambda: F.concat(F.lit("CONTEXT (user prompt):\n"), part("prompt"))
    name = F.col(key).cast("string")
    if mode == "pairwise":
        return rows.select(name.alias(UNIT), F.concat(context(), F.lit("\n\nRESPONSE A:\n"), part("completion_a"), F.lit("\n\nRESPONSE B:\n"), part("completion_b")).alias("text"))
    if mode == "single-text":
        return rows.select(name.alias(UNIT), part("prompt").alias("text"))
    if mode != "individual":
        raise ValueError(f"unknown mode {mode!r}: use {', '.join(MODES)}")
    side = lambda s: F.struct(F.concat(name, F.lit(f"|{s}")).alias(UNIT), F.concat(context(), F.lit("\n\nRESPONSE:\n"), part(f"completion_{s}")).alias("text"))
    return rows.select(F.inline(F.array(side("a"), side("b"))))


def unit_codes(codes, mode: str, key: str = "battle_id") -> DataFrame:
    """(unit_id, feature_id, z); ``codes`` is one table, or the two tables of the sides for ``individual``."""
    own = lambda z, tail: z.select(F.concat(F.col(key).cast("string"), F.lit(tail)).alias(UNIT), "feature_id", "z")
    if mode != "individual":
        return own(codes, "")
    z_a, z_b = codes
    return own(z_a, "|a").union(own(z_b, "|b"))


def reconciled(replies: DataFrame, ask, subject: str) -> DataFrame:
    """One result per feature out of several tries (feature_id, status, concept, confidence).

    Where the tries name different concepts the model is asked for the one they share; without an answer the
    concept that most tries agree on stays, ties going to the higher confidence, then to the text.
    """
    tries = replies.groupBy("feature_id").agg(F.sort_array(F.collect_list(F.struct("concept", "status", "confidence"))).alias("tries"))
    sure = {c: i for i, c in enumerate(reversed(interpret.CONFIDENCES), 1)}

    def vote(tries):
        ok = [t for t in tries if t["status"] == "ok"]
        if not ok:
            return {k: tries[0][k] for k in ("status", "concept", "confidence")}
        n = {c: sum(t["concept"] == c for t in ok) for c in {t["concept"] for t in ok}}
        best = min(ok, key=lambda t: (-n[t["concept"]], -sure.get(t["confidence"], 0), t["concept"]))
        return {k: best[k] for k in ("status", "concept", "confidence")}

    def run(batches):
        for pdf in batches:
            out = [vote(t) for t in pdf["tries"]]
            labels = [sorted({t["concept"] for t in tries if t["status"] == "ok"}) for tries in pdf["tries"]]
            open_at = [i for i, names in enumerate(labels) if len(names) > 1]
            if open_at:
                heads = [f"These labels describe one kind of {subject}. Reply in JSON with the one concept that they share.\n" + "\n".join(f"- {c}" for c in labels[i]) for i in open_at]
                for i, reply in zip(open_at, ask(heads), strict=True):
                    got = interpret.parse_result(reply)
                    out[i] = got if got["status"] == "ok" else out[i]
            yield pd.concat([pdf[["feature_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["status", "concept", "confidence"])], axis=1)

    return tries.mapInPandas(run, "feature_id int, status string, concept string, confidence string")


@dataclass
class Interpreter:
    """Names features from one part of the battles and verifies the names on the other."""

    mode: str = "pairwise"
    n_active: int = 12
    n_zero: int = 8
    n_per_bucket: int = 10
    verify_share: float = 0.2
    candidates: int = 1
    negatives: str = "random"
    seed: int = 0
    width: int = 600

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}: use {', '.join(MODES)}")
        if self.negatives not in ("random", "close"):
            raise ValueError(f"unknown negatives {self.negatives!r}: use random or close")
        if self.negatives == "close" and self.mode == "pairwise":
            raise ValueError("close negatives are for single texts")
        if self.candidates < 1:
            raise ValueError("at least one candidate")

    def pool(self, rows: DataFrame, held: bool, key: str) -> DataFrame:
        out = hashing.held_out(key, self.verify_share)
        return units(rows.filter(out if held else ~out), self.mode, key, self.width)

    def name(self, rows: DataFrame, codes, ask, key: str = "battle_id") -> DataFrame:
        """feature_id, status, concept, confidence, fire_rate (over all units, held out or not)."""
        own, pool = unit_codes(codes, self.mode, key), self.pool(rows, False, key)
        asked = None
        for i in range(self.candidates):
            examples = select.naming_examples(own, pool, self.n_active, self.n_zero, UNIT, self.seed + i)
            one = interpret.requests(examples, pool, UNIT, 4 * self.width)
            asked = one if asked is None else asked.unionByName(one)
        replies = interpret.read_results(interpret.ask_all(asked, ask, ["feature_id"]))
        found = replies if self.candidates == 1 else reconciled(replies, ask, "prompt" if self.mode == "single-text" else "response")
        n = rows.count() * (2 if self.mode == "individual" else 1)
        rate = own.filter("z > 0").groupBy("feature_id").agg((F.count("*") / F.lit(max(n, 1))).alias("fire_rate"))
        return found.join(rate, "feature_id", "left").fillna(0.0, ["fire_rate"])

    def verify(self, rows: DataFrame, codes, names: DataFrame, ask, key: str = "battle_id", vectors: DataFrame | None = None) -> DataFrame:
        """Fidelity of the names on held-out units.

        Pairs are judged for a side, single texts for presence against silent texts: drawn ones, or those
        nearest to the active ones by ``vectors`` (unit_id, dim, v).
        """
        own, pool = unit_codes(codes, self.mode, key), self.pool(rows, True, key)
        if self.mode == "pairwise":
            buckets = select.holdout_buckets(own, pool, self.n_per_bucket, UNIT, seed=self.seed)
            return interpret.verify_features(names, buckets, pool, ask, UNIT)
        own = own.filter("z > 0").join(pool.select(UNIT), UNIT, "left_semi")
        active = select.top_codes(own, self.n_per_bucket, UNIT, "pos").withColumn("bucket", F.lit("pos"))
        if self.negatives == "close":
            if vectors is None:
                raise ValueError("close negatives need vectors")
            near = vectors.join(pool.select(UNIT), UNIT, "left_semi")
            quiet = select.close_negatives(near, own, self.n_per_bucket, UNIT).drop("cosine")
        else:
            quiet = select.silent(own, pool, self.n_per_bucket, UNIT, self.seed)
        quiet = quiet.withColumns({"z": F.lit(0.0), "bucket": F.lit("neg")})
        return interpret.verify_features(names, active.unionByName(quiet), pool, ask, UNIT, True)
