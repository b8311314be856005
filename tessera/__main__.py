"""Command line: tables in (Parquet, CSV, JSON), one table or report out.

python -m tessera inspect --corpus C
python -m tessera build-corpus --table T --source NAME --out DIR
python -m tessera encode-dataset --vectors V --lens L --out DIR
python -m tessera fit-lens --vectors V --lens L [--m 128 --k 16 --whiten none]
python -m tessera build-bank --corpus C --codes Z --out DIR
python -m tessera win-relevance --corpus C --codes Z [--controlled] --out DIR
python -m tessera elicit --prompt-codes P --codes-a A --codes-b B --out DIR
python -m tessera conditional-delta --corpus C --codes Z --prompt-codes P --out DIR
python -m tessera diagnose --bank DIR --model M [--names N] --out DIR
python -m tessera report --bank DIR --model M --names N
python -m tessera cluster-features --corpus C --codes Z [--method agglomerative] --out DIR
python -m tessera sae-metrics --corpus C --codes Z --m M --out DIR
python -m tessera validate-diagnosis --bank DIR --relevance R --out DIR
python -m tessera summarize-activations --tokens T --codes Z --out DIR
python -m tessera embed-corpus --corpus C --model-function M:F --out DIR
python -m tessera embed-prompts --corpus C --model-function M:F --out DIR
python -m tessera build-lens --corpus C --model-function M:F --lens L [--kind difference --rule threshold]
python -m tessera build-prompt-lens --corpus C --model-function M:F --lens L
python -m tessera train-token-lens --tokens T --lens L [--rule threshold]
python -m tessera interpret-name --corpus C --codes Z --model-function M:F [--mode pairwise] --out DIR
python -m tessera interpret-verify --corpus C --codes Z --names N --model-function M:F [--mode pairwise] --out DIR
python -m tessera name-prompts --corpus C --codes Z --model-function M:F --out DIR
python -m tessera run --config FILE.json --corpus C --codes Z [--model-function M:F] --out DIR

Codes are (battle_id, feature_id, z); banks hold ``meta`` and ``codes``.  A model function is ``module:function``
(list of texts in, list of vectors or replies out).  The mode ``individual`` reads --codes-a and --codes-b.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import ConceptLens, TrainConfig
from .operators import cluster, codes, conditional, diagnose, elicit, export, lens, logistic, modes, relevance, validate
from .plans import pipeline
from .shipping import ship
from .sources import corpus

FLAGS = ("corpus", "table", "source", "codes", "prompt-codes", "codes-a", "codes-b", "bank", "model", "names", "relevance", "vectors", "tokens", "lens", "out", "whiten", "model-function", "config")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command")
    for flag in FLAGS:
        parser.add_argument(f"--{flag}")
    parser.add_argument("--method", default="agglomerative")
    parser.add_argument("--mode", default="pairwise", choices=modes.MODES)
    parser.add_argument("--kind", default="difference")
    parser.add_argument("--rule", default="threshold", choices=("threshold", "topk", "jump"))
    parser.add_argument("--m", type=int, default=128)
    parser.add_argument("--k", type=int, default=16)
    parser.add_argument("--n-clusters", type=int, default=10)
    parser.add_argument("--min-support", type=int, default=30)
    parser.add_argument("--min-battles", type=int, default=20)
    parser.add_argument("--controlled", action="store_true")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    ship(spark)

    def load(name):
        path = getattr(a, name)
        if not path:
            parser.error(f"{a.command} needs --{name.replace('_', '-')}")
        return corpus.load_table(spark, path) if "." in path.rsplit("/", 1)[-1] else spark.read.parquet(path)

    def save(df, part=""):
        if not a.out:
            parser.error(f"{a.command} needs --out")
        df.write.mode("overwrite").parquet(a.out + part)

    bank = lambda: (spark.read.parquet(f"{a.bank}/meta"), spark.read.parquet(f"{a.bank}/codes"))
    names = lambda: load("names") if a.names else None

    def with_length(rows):
        gap = codes.oriented(rows).filter("orientation = 'a'").select("battle_id", "length")
        return rows.join(gap, "battle_id")

    def win():
        z, rows = load("codes"), load("corpus")
        out = relevance.win_relevance(z, rows)
        if a.controlled:
            out = out.join(logistic.controlled(z, with_length(rows)).select("feature_id", "beta", "delta_win_rate", "lr_p", "separable"), "feature_id", "left")
        save(out)

    def make_bank():
        meta, both = codes.bank(load("corpus"), load("codes"))
        save(meta, "/meta")
        save(both, "/codes")

    def fit():
        x, val = lens.training_rows(load("vectors"))
        fitted, _ = lens.train(x, val, m=a.m, k=a.k, whiten=a.whiten or "none")
        fitted.save(a.lens, overwrite=True)

    def types():
        return codes.dominant(load("prompt_codes"))

    def check():
        meta, z = bank()
        scores = validate.model_scores(meta, z, validate.weights(load("relevance"), "delta_win_rate"), a.min_battles)
        save(scores)
        got = scores.toPandas()
        print(validate.fit_quality(got["predicted_score"], got["actual_win_rate"]))

    def function():
        if not a.model_function or ":" not in a.model_function:
            parser.error(f"{a.command} needs --model-function module:function")
        module, name = a.model_function.split(":", 1)
        return getattr(importlib.import_module(module), name)

    def embedded(kind):
        rows = ConceptLens(None, function())
        save(rows.sides(load("corpus"), a.model_function) if kind == "sides" else rows.vectors(load("corpus"), kind, a.model_function))

    def build(kind):
        ConceptLens.train(load("corpus"), function(), a.lens, TrainConfig(kind, a.m, a.k, a.rule, whiten=a.whiten or "none"), model_id=a.model_function)

    def fit_tokens():
        own = F.concat_ws("|", F.col("battle_id").cast("string"), "span", F.col("token_idx").cast("string"))
        x, val = lens.training_rows(load("tokens").withColumn("row_id", own), group="battle_id")
        TrainConfig("individual", a.m, a.k, a.rule, whiten=a.whiten or "none").fit(x, val).save(a.lens, overwrite=True)

    def read_codes(mode):
        return (load("codes_a"), load("codes_b")) if mode == "individual" else load("codes")

    def run_config():
        if not a.config:
            parser.error("run needs --config")
        rows = load("corpus")
        tables = pipeline.run(
            pipeline.Config.from_dict(json.loads(Path(a.config).read_text())), load("codes"), rows,
            modes.units(rows, "pairwise").withColumnRenamed(modes.UNIT, "battle_id"), function() if a.model_function else None, names(),
        )
        for name, table in tables.items():
            save(table, f"/{name}")

    commands = {
        "embed-corpus": lambda: embedded("sides"),
        "embed-prompts": lambda: embedded("prompt"),
        "build-lens": lambda: build(a.kind),
        "build-prompt-lens": lambda: build("prompt"),
        "train-token-lens": fit_tokens,
        "interpret-name": lambda: save(modes.Interpreter(a.mode).name(load("corpus"), read_codes(a.mode), function())),
        "interpret-verify": lambda: save(modes.Interpreter(a.mode).verify(load("corpus"), read_codes(a.mode), load("names"), function())),
        "name-prompts": lambda: save(modes.Interpreter("single-text").name(load("corpus"), load("codes"), function())),
        "run": run_config,
        "inspect": lambda: (diagnose.inspect(load("corpus")).show(), diagnose.models(load("corpus")).orderBy(F.desc("n")).show()),
        "build-corpus": lambda: corpus.write_corpus(corpus.normalize(load("table"), a.source or "table"), a.out),
        "fit-lens": fit,
        "encode-dataset": lambda: save(lens.encode(load("vectors"), lens.Lens.load(a.lens))),
        "build-bank": make_bank,
        "win-relevance": win,
        "elicit": lambda: save(elicit.elicitation(load("prompt_codes"), load("codes_a"), load("codes_b"), load("codes_a").select("battle_id").distinct().count(), min_support=a.min_support)),
        "conditional-delta": lambda: save(conditional.prompt_delta(load("codes"), load("corpus"), types())),
        "diagnose": lambda: save(diagnose.one_model(*bank(), a.model, names())),
        "report": lambda: print(export.report(a.model, diagnose.one_model(*bank(), a.model, names()))),
        "cluster-features": lambda: save(cluster.cluster_features(load("codes"), load("corpus").count(), a.method, a.n_clusters)),
        "sae-metrics": lambda: save(elicit.lens_metrics(load("codes"), load("corpus"), a.m)),
        "validate-diagnosis": check,
        "summarize-activations": lambda: save(codes.summarize_spans(load("tokens"), load("codes"))),
    }
    if a.command not in commands:
        parser.error(f"unknown command {a.command}; known: {', '.join(commands)}")
    commands[a.command]()
    return 0


if __name__ == "__main__":
    sys.exit(main())
