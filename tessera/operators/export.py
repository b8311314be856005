"""Report cards and JSON bundles from small result tables."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean(value):
    """JSON-safe: no NaN or infinity, plain containers."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    return value


def records(df: DataFrame, digits: int = 5) -> list[dict]:
    """Rows of a result table, doubles rounded half-even."""
    doubles = [c for c, k in df.dtypes if k in ("double", "float")]
    small = df.withColumns({c: F.bround(F.when(~F.isnan(c), F.col(c)), digits) for c in doubles})
    return [clean(r.asDict(recursive=True)) for r in small.toLocalIterator()]


def features(names: DataFrame, *tables: DataFrame) -> DataFrame:
    """One row per feature: names with any feature tables joined on."""
    out = names
    for t in tables:
        new = [c for c in t.columns if c == "feature_id" or c not in out.columns]
        out = out.join(F.broadcast(t.select(*new)), "feature_id", "left")
    return out.orderBy("feature_id")


def diagnosis(per_model: DataFrame, min_battles: int = 20) -> DataFrame:
    """Per model: its features as one array (the size of the lens), strongest contrast first."""
    item = F.struct((-F.abs(F.coalesce("delta_vs_pool", F.lit(0.0)))).alias("order"), "feature_id", "net_direction", "delta_vs_pool", "fire_rate")
    kept = per_model.filter(F.col("n") >= min_battles)
    rows = kept.groupBy("model").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(item)).alias("f"))
    return rows.select("model", "n", F.transform("f", lambda x: x.dropFields("order")).alias("features"))


def omission_groups(omissions: DataFrame) -> DataFrame:
    """Flagged omissions per model, largest shortfall first."""
    item = F.struct((-F.col("shortfall")).alias("order"), "prompt_concept", "feature_id", "shortfall", (F.col("won_when_fired") > F.col("won_when_not")).alias("corroborated"))
    rows = omissions.filter("flagged").groupBy("model").agg(F.sort_array(F.collect_list(item)).alias("o"))
    return rows.select("model", F.transform("o", lambda x: x.dropFields("order")).alias("omissions"))


def bundle(folder: str, **tables: DataFrame) -> dict:
    """Write each table as JSON and the manifest last; a table that fails is listed, not fatal."""
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    done, errors = [], {}
    for name, df in tables.items():
        try:
            (path / f"{name}.json").write_text(json.dumps(records(df), ensure_ascii=False))
            done.append(name)
        except Exception as error:  # noqa: BLE001  the bundle lists what is missing
            errors[name] = str(error)[:300]
    manifest = {"schema_version": 2, "written": done, "errors": errors}
    (path / "manifest.json").write_text(json.dumps(manifest, indent=1))
    return manifest


def report(model: str, diagnosis: DataFrame, prompt_winrates: DataFrame | None = None, relations: DataFrame | None = None, top: int = 15) -> str:
    """A Markdown card of one model from its named diagnosis."""
    rows = diagnosis.filter(F.col("concept").isNotNull() & (F.trim("concept") != ""))
    line = lambda r: f"- {r['concept']} ({r['fire_rate']:.1%})"
    n, win = diagnosis.agg(F.max("n"), F.avg("win_rate")).first()
    out = [f"# {model}", "", f"{n or 0} battles, win rate {win or 0:.1%}", "", "## Frequent", *map(line, rows.orderBy(F.desc("fire_rate"), "feature_id").limit(top).collect())]
    out += ["", "## Rare", *map(line, rows.orderBy("fire_rate", "feature_id").limit(top).collect())]
    if "helps_win" in rows.columns:
        gaps = rows.filter((F.coalesce("delta_vs_pool", "net_direction") < 0) & (F.col("helps_win") > 0)).orderBy(F.desc("helps_win"), "feature_id").limit(top)
        out += ["", "## Rewarded but under-expressed", *[f"- {r['concept']} ({r['helps_win']:+.3f})" for r in gaps.collect()]]
    if prompt_winrates is not None:
        own = prompt_winrates.filter(F.col("model") == model)
        best, worst = own.orderBy(F.desc("win_rate"), "prompt_concept").limit(top), own.orderBy("win_rate", "prompt_concept").limit(top)
        for title, part in (("Best prompts", best), ("Worst prompts", worst)):
            out += ["", f"## {title}", *[f"- {r['prompt_concept']}: {r['win_rate']:.1%} of {r['n']}" for r in part.collect()]]
    if relations is not None:
        own = relations.filter(F.col("model") == model).orderBy(F.desc(F.abs("delta_win")), "prompt_concept", "response_concept").limit(top)
        out += ["", "## Relations", *[f"- {r['prompt_concept']} and {r['response_concept']}: {r['delta_win']:+.3f}" for r in own.collect()]]
    return "\n".join(out) + "\n"


def project2d(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """Two principal components of each row, signs fixed by the largest loading."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.withColumn("_v", array_to_vector(vector))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows)
    loads = model.pc.toArray()
    signs = [1.0 if loads[abs(loads[:, i]).argmax(), i] >= 0 else -1.0 for i in range(2)]
    xy = vector_to_array("_p")
    return model.transform(rows).withColumns({"x": xy[0] * signs[0], "y": xy[1] * signs[1]}).drop("_v", "_p")
