"""Texts in, codes and concept names out: a lens together with the function that embeds texts.

``model`` is any function list[str] -> list of vectors; each distinct text is embedded once a call.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import codes, interpret, lens
from .sources import corpus

KINDS = ("difference", "individual", "prompt")


@dataclass
class TrainConfig:
    """What a lens is and how it is fitted; ``most`` bounds the drawn training rows."""

    input_rep: str = "difference"
    m: int = 128
    k: int = 16
    rule: str = "threshold"
    prefixes: tuple[int, ...] = (8,)
    whiten: str = "none"
    epochs: int = 200
    batch: int = 512
    lr: float = 1e-3
    patience: int = 10
    val_share: float = 0.1
    most: int = 100_000
    seed: int = 0

    def __post_init__(self):
        if self.input_rep not in KINDS:
            raise ValueError(f"unknown kind {self.input_rep!r}: use {', '.join(KINDS)}")

    def fit(self, x, val) -> lens.Lens:
        common = {n: getattr(self, n) for n in ("m", "k", "epochs", "batch", "lr", "patience", "whiten", "seed")}
        if self.rule == "threshold":
            return lens.train(x, val, prefixes=tuple(self.prefixes), **common)[0]
        return lens.train_plain(x, val, rule=self.rule, **common)[0]


@dataclass
class ConceptLens:
    lens: lens.Lens
    model: Callable
    names: DataFrame | None = None

    @property
    def input_rep(self) -> str:
        return self.lens.info.get("input_rep", "difference")

    @property
    def model_id(self) -> str:
        return self.lens.info.get("model_id", "model")

    @classmethod
    def train(cls, battles: DataFrame, model: Callable, out: str, config: TrainConfig | None = None, columns: dict | None = None, model_id: str = "model", **settings) -> ConceptLens:
        """Fit on the battles (or a table whose columns are mapped), save to ``out`` and load from there."""
        if config is not None and settings:
            raise ValueError(f"given beside a configuration: {', '.join(sorted(settings))}")
        config = config or TrainConfig(**settings)
        rows = corpus.mapped(battles, **columns) if columns else battles
        own = cls(None, model)
        x, val = lens.training_rows(own.vectors(rows, config.input_rep, model_id), val_share=config.val_share, most=config.most, seed=config.seed)
        fitted = config.fit(x, val)
        fitted.info |= {"input_rep": config.input_rep, "model_id": model_id, "config": asdict(config)}
        fitted.save(out)
        return cls.from_dir(out, model)

    @classmethod
    def from_dir(cls, folder: str, model: Callable, names: DataFrame | None = None) -> ConceptLens:
        return cls(lens.Lens.load(folder), model, names)

    def embedded(self, queries: DataFrame, model_id: str) -> DataFrame:
        none = queries.sparkSession.createDataFrame([], "key string, vector array<float>")
        return interpret.embed(queries, none, self.model, model_id)[0]

    def sides(self, battles: DataFrame, model_id: str, key: str = "battle_id") -> DataFrame:
        """(key, e_a, e_b): one call of the model for both sides."""
        side = lambda s: F.struct(F.lit(s).alias("side"), T.query(F.col("prompt"), F.col(f"completion_{s}")).alias("query"))
        both = self.embedded(battles.select(key, F.inline(F.array(side("a"), side("b")))), model_id)
        of = lambda s: F.max(F.when(F.col("side") == s, F.col("vector"))).alias(f"e_{s}")
        return both.groupBy(key).agg(of("a"), of("b"))

    def vectors(self, battles: DataFrame, kind: str, model_id: str, key: str = "battle_id") -> DataFrame:
        """(row_id, vector) that a lens of this kind is fitted on."""
        name = F.col(key).cast("string")
        if kind == "prompt":
            return self.embedded(battles.select(name.alias("row_id"), T.prompt_query(F.col("prompt")).alias("query")), model_id).select("row_id", "vector")
        wide = codes.represent(self.sides(battles, model_id, key), kind)
        return wide.select((F.concat(name, F.lit("|"), "side") if kind == "individual" else name).alias("row_id"), "vector")

    def encode(self, texts: DataFrame, key: str = "row_id", prompt: str = "prompt", completion: str | None = None) -> DataFrame:
        """Codes of single texts (key, feature_id, z); a lens of differences has none."""
        if self.input_rep == "difference":
            raise ValueError("a lens of differences reads pairs: use encode_pairs")
        if (completion is None) != (self.input_rep == "prompt"):
            raise ValueError("a prompt lens reads prompts alone, a lens of responses needs them")
        query = T.prompt_query(F.col(prompt)) if completion is None else T.query(F.col(prompt), F.col(completion))
        return lens.encode(self.embedded(texts.select(key, query.alias("query")), self.model_id), self.lens, key=key)

    def encode_pairs(self, battles: DataFrame, key: str = "battle_id") -> tuple[DataFrame, DataFrame]:
        """(codes of the contrast of A and B, the battles without their texts)."""
        if self.input_rep == "prompt":
            raise ValueError("a prompt lens has no contrast")
        meta = battles.drop("prompt", "completion_a", "completion_b")
        if self.input_rep == "difference":
            wide = codes.represent(self.sides(battles, self.model_id, key), "difference")
            return lens.encode(wide, self.lens, key=key), meta
        single = self.vectors(battles, "individual", self.model_id, key)
        z = lens.encode(single, self.lens).withColumn("side", F.right("row_id", F.lit(1)))
        own = F.expr("substring(row_id, 1, length(row_id) - 2)").cast(dict(battles.dtypes)[key]).alias(key)
        signed = z.select(own, "feature_id", F.when(F.col("side") == "a", F.col("z")).otherwise(-F.col("z")).alias("z"))
        return signed.groupBy(key, "feature_id").agg(F.sum("z").alias("z")).filter("z <> 0"), meta

    def encode_items(self, items: DataFrame, key: str = "battle_id") -> tuple[DataFrame, DataFrame]:
        """Items that all have a second response are pairs, items without any are single; a mixture is an error."""
        second = F.count_if(F.col("completion_b").isNotNull()) if "completion_b" in items.columns else F.lit(0).cast("long")
        n, pairs = items.agg(F.count("*"), second).first()
        if 0 < pairs < n:
            raise ValueError(f"{pairs} of {n} items are pairs: encode pairs and single items apart")
        if pairs:
            return self.encode_pairs(items, key)
        return self.encode(items, key, completion=None if self.input_rep == "prompt" else "completion_a"), items.drop("prompt", "completion_a", "completion_b")

    def concept_names(self) -> dict[int, str]:
        """Names by feature (at most the features of the lens); of several the first by text."""
        if self.names is None:
            return {}
        told = self.names.filter(~T.blank(F.col("concept"))).groupBy("feature_id").agg(F.min("concept").alias("c"))
        return {r["feature_id"]: r["c"] for r in told.collect()}
