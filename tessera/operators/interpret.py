"""Naming and verifying features with a language model that the caller injects.

``ask`` is any function list[str] -> list[str].  Requests are one row per feature (and example), so they
run as ``mapInPandas`` over a table the size of the lens; tests pass a deterministic function.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T

#: Keys that replies use for a concept, statuses and confidences of a result, the mark of a lost reply.
CONCEPT_KEYS = ("concept", "feature", "description", "phrase")
STATUSES = ("ok", "polysemantic", "insufficient_evidence")
CONFIDENCES = ("high", "medium", "low")
LOST = "<<ERROR"
_NO_CONCEPT = re.compile(T.NO_CONCEPT)


def _clean(phrase: str) -> str:
    return re.sub(r"^(?:- )?-?", "", phrase.strip()).strip().strip('"').strip()


def _is_concept(phrase: str) -> bool:
    return len(phrase.split()) >= 2 and not phrase.endswith("?") and not _NO_CONCEPT.match(phrase)


def _without_thoughts(reply: str | None) -> str:
    return re.sub(r"(?is)<think>.*?</think>", "", reply or "").strip()


def _as_object(body: str) -> dict | None:
    try:
        got = json.loads(body)
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def parse_concept(reply: str) -> str:
    """The concept in a reply: a JSON field, the last quoted bullet, the last quote, or the last line; else empty."""
    body = _without_thoughts(reply)
    fields = _as_object(body) or {}
    for value in (str(fields.get(key) or "").strip() for key in CONCEPT_KEYS):
        if value:
            return _clean(value)
    inside = re.search(rf'"(?:{"|".join(CONCEPT_KEYS)})"\s*:\s*"([^"]+)"', body)
    if inside or body.startswith("{"):
        return _clean(inside.group(1)) if inside else ""
    bullets = re.findall(r'(?m)^\s*-\s*"([^"]+)"', body)
    if bullets:
        return _clean(bullets[-1])
    lines = [x.strip() for x in body.splitlines() if x.strip()]
    for candidate in (*re.findall(r'"([^"]+)"', body)[-1:], *(x.rstrip('"') for x in lines[-1:])):
        if _is_concept(_clean(candidate)):
            return _clean(candidate)
    return ""


def parse_result(reply: str) -> dict:
    """status, concept, confidence.  A lost, unreadable or unknown reply is no evidence, and only ``ok`` has a concept."""
    none = {"status": "insufficient_evidence", "concept": "", "confidence": ""}
    body = _without_thoughts(reply)
    if not body or body.startswith(LOST):
        return none
    fields = _as_object(body)
    if fields is None:
        concept = parse_concept(body)
        return none | ({"status": "ok", "concept": concept} if concept else {})
    status, sure = (str(fields.get(k) or other).strip().lower() for k, other in (("status", "ok"), ("confidence", "")))
    out = none | {"status": status if status in STATUSES else none["status"], "confidence": sure if sure in CONFIDENCES else ""}
    if out["status"] != "ok":
        return out
    given = fields.get("concept")
    concept = "" if given in (None, "", "null") else _clean(str(given))
    return out | ({"concept": concept} if _is_concept(concept) else {"status": none["status"]})


def example_block(number, z, prompt, a, b):
    """A pair as an untrusted example with its activation."""
    return F.concat(
        F.format_string('<example idx="%d" signed_activation="%+.3f">\nCONTEXT (user prompt):\n', number, z), T.shield(prompt),
        F.lit("\n\nRESPONSE A:\n"), T.shield(a), F.lit("\n\nRESPONSE B:\n"), T.shield(b), F.lit("\n</example>\n"),
    )


def requests(examples: DataFrame, texts: DataFrame, key: str = "battle_id", width: int = 600) -> DataFrame:
    """One prompt per feature from its ranked examples (feature_id, kind, rank, key, z)."""
    head = F.format_string('<example kind="%s" idx="%d" activation="%+.3f">\n', F.col("kind"), F.col("rank"), F.col("z"))
    block = F.concat(head, T.shield(T.truncate(F.col("text"), width)), F.lit("\n</example>"))
    rows = examples.join(texts.select(key, "text"), key).select("feature_id", F.struct("kind", "rank", block.alias("b")).alias("e"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["b"]), "\n")
    return rows.groupBy("feature_id").agg(F.concat(F.lit("Which property do the active texts share and the silent ones lack? Reply in JSON.\n"), body).alias("request"))


def patient(send, tries: int = 3, final=("400", "401", "403", "404", "invalid_request", "context_length")):
    """``ask`` from a function that sends one request and may fail.

    A failed request is sent again unless its error is final; what stays without a reply becomes a lost
    reply, which every parser reads as missing and none as a verdict.
    """

    def one(request: str) -> str:
        for left in reversed(range(tries)):
            try:
                return send(request)
            except Exception as error:  # noqa: BLE001 - whatever the transport raises
                if not left or any(word in str(error).lower() for word in final):
                    return f"{LOST}: {error}>>"
        return f"{LOST}: not sent>>"

    return lambda batch: [one(r) for r in batch]


def best_candidate(replies: DataFrame) -> DataFrame:
    """One result per feature out of several tries (feature_id, status, concept, confidence).

    The concept that most tries agree on stays; ties go to the higher confidence, then to the text.
    """
    sure = F.array_position(F.array(*[F.lit(x) for x in reversed(CONFIDENCES)]), F.col("confidence"))
    votes = replies.groupBy("feature_id", "status", "concept").agg(F.count("*").alias("n"), F.max(F.struct(sure.alias("s"), "confidence")).alias("c"))
    order = F.struct((F.col("status") != "ok").alias("lost"), (-F.col("n")).alias("n"), (-F.col("c.s")).alias("s"), "concept", "status", F.col("c.confidence").alias("confidence"))
    return votes.groupBy("feature_id").agg(F.min(order).alias("r")).select("feature_id", "r.status", "r.concept", "r.confidence")


def name_clusters(clusters: DataFrame, names: DataFrame, ask) -> DataFrame:
    """cluster_id, behavior: a name for each cluster from the concepts of its members; without any, null."""
    known = clusters.filter("cluster_id is not null").join(names.filter(~T.blank(F.col("concept"))).select("feature_id", "concept"), "feature_id")
    listed = F.array_join(F.transform(F.sort_array(F.collect_set("concept")), lambda c: F.concat(F.lit("- "), c)), "\n")
    asked = known.groupBy("cluster_id").agg(F.concat(F.lit("Name the behaviour that these concepts share. Reply in JSON.\n"), listed).alias("request"))
    replies = ask_all(asked, ask, ["cluster_id"])
    kind = dict(clusters.dtypes)["cluster_id"]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"cluster_id": pdf["cluster_id"], "behavior": [parse_concept(r) or None for r in pdf["reply"]]})

    named = replies.mapInPandas(run, f"cluster_id {kind}, behavior string")
    return clusters.filter("cluster_id is not null").select("cluster_id").distinct().join(named, "cluster_id", "left")


def shuffled_names(names: DataFrame, seed: int = 0) -> DataFrame:
    """The names of verified features, each moved to the next feature of a drawn ring: no feature keeps its own.

    A control for judges; the table has a row per feature.
    """
    drawn = F.sha1(F.concat(F.col("feature_id").cast("string"), F.lit(f"|{seed}")))
    ring = names.filter(~T.blank(F.col("concept"))).agg(F.sort_array(F.collect_list(F.struct(drawn.alias("h"), "feature_id", "concept"))).alias("r"))
    moved = ring.select(F.posexplode("r").alias("i", "own"), "r").select(F.col("own.feature_id").alias("feature_id"), F.col("r")[F.pmod(F.col("i") + 1, F.size("r"))]["concept"].alias("concept"))
    return moved


def ask_all(rows: DataFrame, ask, keys: list[str]) -> DataFrame:
    """The rows with a reply each."""
    fields = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)

    def run(batches):
        for pdf in batches:
            yield pdf[keys].assign(reply=ask(pdf["request"].tolist()))

    return rows.select(*keys, "request").mapInPandas(run, f"{fields}, reply string")


def name_features(examples: DataFrame, texts: DataFrame, ask, key: str = "battle_id") -> DataFrame:
    """feature_id, concept, status, confidence."""
    return read_results(ask_all(requests(examples, texts, key), ask, ["feature_id"]))


def read_results(replies: DataFrame) -> DataFrame:
    """feature_id, status, concept, confidence of the replies."""

    def run(batches):
        for pdf in batches:
            got = pd.DataFrame([parse_result(r) for r in pdf["reply"]], columns=["status", "concept", "confidence"])
            yield pd.concat([pdf[["feature_id"]].reset_index(drop=True), got], axis=1)

    return replies.mapInPandas(run, "feature_id int, status string, concept string, confidence string")


def testable(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names to verify, abstentions)."""
    ok = ~T.blank(F.col("concept")) & (F.coalesce(F.col("status"), F.lit("ok")) == "ok")
    return names.filter(ok), names.filter(~ok)


def pairwise_metrics(judged: DataFrame) -> DataFrame:
    """Per feature from (feature_id, truth, label in -1, 0, 1 or null): agreement, precision, recall, F1, correlation."""
    t, j = F.col("truth").cast("double"), F.col("label").cast("double")
    ok = F.col("label").isNotNull()
    both = ok & (t != 0) & (j != 0)
    per = judged.groupBy("feature_id").agg(
        F.count("*").alias("n_attempted"), F.count_if(ok).alias("n"), F.count_if(ok & (t > 0)).alias("n_pos_ok"), F.count_if(ok & (t < 0)).alias("n_neg_ok"),
        F.count_if(ok & (t == j)).alias("agree"), F.count_if(both & (t > 0) & (j > 0)).alias("tp"), F.count_if(both & (t < 0) & (j > 0)).alias("fp"), F.count_if(both & (t > 0) & (j < 0)).alias("fn"),
        *[F.coalesce(F.sum(F.when(ok, x)), F.lit(0.0)).alias(n) for n, x in (("st", t), ("stt", t * t), ("sj", j), ("sjj", j * j), ("stj", t * j))],
    )
    return _rates(per)


def presence_metrics(judged: DataFrame) -> DataFrame:
    """The same for truth and label in 0, 1; all judged rows count, and the false-positive rate is added."""
    t, j = F.col("truth").cast("double"), F.col("label").cast("double")
    ok = F.col("label").isNotNull()
    per = judged.groupBy("feature_id").agg(
        F.count("*").alias("n_attempted"), F.count_if(ok).alias("n"), F.count_if(ok & (t > 0)).alias("n_pos_ok"), F.count_if(ok & (t == 0)).alias("n_neg_ok"),
        F.count_if(ok & (t == j)).alias("agree"), F.count_if(ok & (t > 0) & (j > 0)).alias("tp"), F.count_if(ok & (t == 0) & (j > 0)).alias("fp"), F.count_if(ok & (t > 0) & (j == 0)).alias("fn"),
        *[F.coalesce(F.sum(F.when(ok, x)), F.lit(0.0)).alias(n) for n, x in (("st", t), ("stt", t * t), ("sj", j), ("sjj", j * j), ("stj", t * j))],
    )
    return _rates(per).withColumn("fp_rate", S.ratio(F.col("fp"), F.col("n_neg_ok")))


def _rates(per: DataFrame) -> DataFrame:
    precision, recall = S.ratio(F.col("tp"), F.col("tp") + F.col("fp")), S.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return per.select(
        "feature_id", "n", "n_attempted", (F.col("n_attempted") - F.col("n")).alias("n_failed"), S.ratio(F.col("n"), F.col("n_attempted")).alias("success_rate"), "n_pos_ok", "n_neg_ok",
        S.ratio(F.col("agree"), F.col("n")).alias("agreement"), precision.alias("precision"), recall.alias("recall"),
        S.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        S.pearson(F.col("n"), F.col("st"), F.col("stt"), F.col("sj"), F.col("sjj"), F.col("stj")).alias("correlation"), "fp",
    )


def fidelity(metrics: DataFrame, threshold: float = 0.3, success: float = 0.8, least: int = 5) -> DataFrame:
    """Pass: correlation, Bonferroni-corrected significance, success rate and enough of both buckets."""
    tests = metrics.count()
    out = metrics.drop("fp").withColumn("p_value", S.correlation_p(F.col("correlation"), F.col("n"))).withColumn("p_bonferroni", S.bonferroni(F.col("p_value"), tests))
    passed = (F.col("correlation") >= threshold) & (F.col("p_bonferroni") < 0.05) & (F.col("success_rate") >= success) & (F.col("n_pos_ok") >= least) & (F.col("n_neg_ok") >= least)
    return out.withColumn("fidelity_pass", F.coalesce(passed, F.lit(False)))


def verify_features(names: DataFrame, buckets: DataFrame, texts: DataFrame, ask, key: str = "battle_id", presence: bool = False) -> DataFrame:
    """Judge held-out examples of each testable name; abstentions are failing rows with their reason."""
    tested, abstained = testable(names)
    rows = buckets.join(F.broadcast(tested.select("feature_id", "concept")), "feature_id").join(texts.select(key, "text"), key)
    question = F.concat(F.lit("Property: "), "concept", F.lit("\n"), T.shield(T.truncate(F.col("text"), 2000)), F.lit("\nAnswer yes or no." if presence else "\nAnswer A, B or TIE."))
    truth = F.when(F.col("bucket") == "pos", 1).when(F.col("bucket") == "neg", 0 if presence else -1).otherwise(0)
    replies = ask_all(rows.select("feature_id", truth.alias("truth"), question.alias("request")), ask, ["feature_id", "truth"])
    parse = T.parse_presence if presence else T.parse_label
    judged = replies.select("feature_id", "truth", parse(F.col("reply")).alias("label"))
    out = fidelity(presence_metrics(judged) if presence else pairwise_metrics(judged))
    lost = abstained.select("feature_id", F.lit("abstained").alias("skipped_reason"), F.lit(False).alias("fidelity_pass"))
    return out.unionByName(lost, allowMissingColumns=True).join(names.select("feature_id", "concept"), "feature_id", "left")


def embed(queries: DataFrame, cache: DataFrame, model, model_id: str, query: str = "query") -> tuple[DataFrame, DataFrame]:
    """(query, vector) of all rows and the cache with what was missing: each distinct query is embedded once."""
    from ..functions.hashing import embedding_key

    keyed = queries.withColumn("key", embedding_key(model_id, F.col(query)))
    missing = keyed.select("key", query).dropDuplicates(["key"]).join(cache, "key", "left_anti")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "vector": [list(map(float, v)) for v in model(pdf[query].tolist())]})

    fresh = missing.mapInPandas(run, "key string, vector array<float>")
    unit = F.transform("vector", lambda x: (x / F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, y: a + y * y))).cast("float"))
    both = cache.select("key", "vector").unionByName(fresh.select("key", unit.alias("vector")))
    return keyed.join(both, "key").drop("key"), both
