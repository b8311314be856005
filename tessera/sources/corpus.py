"""Corpora of battles from tables, conversations and judge output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import hashing, text

#: Names of roles, and fields of a conversation that hold its messages.
USER_ROLES = ("user", "human")
ASSISTANT_ROLES = ("assistant", "model", "bot", "gpt", "ai")
MESSAGE_FIELDS = ("messages", "conversation", "turns", "content")
READERS = {".parquet": "parquet", ".csv": "csv", ".jsonl": "json", ".json": "json"}


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Read by suffix: .parquet, .csv, .jsonl (one object a line) or .json."""
    suffix = path[path.rfind(".") :].lower()
    if suffix not in READERS:
        raise ValueError(f"cannot read {path}: use one of {', '.join(READERS)}")
    reader = spark.read
    if suffix == ".csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", True)
    if suffix == ".json":
        reader = reader.option("multiLine", True)
    return reader.format(READERS[suffix]).load(path)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    df = schema.require(load_table(spark, path), *schema.CORPUS_COLUMNS)
    return df.withColumn("instruction_id", F.col("battle_id"))


def normalize(df: DataFrame, source: str) -> DataFrame:
    """Content columns stripped, rows without content dropped, ids derived where absent."""
    schema.require(df, *hashing.CONTENT)
    out = df.withColumns({c: text.strip(F.col(c).cast("string")) for c in hashing.CONTENT})
    for c in hashing.CONTENT:
        out = out.filter(F.col(c).isNotNull() & (F.length(c) > 0))
    own_id = F.col("battle_id").cast("string") if "battle_id" in df.columns else F.lit(None).cast("string")
    language = F.col("language").cast("string") if "language" in df.columns else F.lit(None).cast("string")
    out = out.withColumns(
        {
            "battle_id": F.coalesce(own_id, hashing.content_id(*hashing.CONTENT)),
            "source": F.lit(source),
            "language": F.coalesce(language, F.lit("")),
        }
    )
    extra = [schema.label().alias(schema.LABEL)] if schema.LABEL in df.columns else []
    return out.select(*schema.CORPUS_COLUMNS, *extra)


def merge(frames: list[DataFrame]) -> DataFrame:
    """All rows and all columns; of rows with one battle_id, the one of the first frame (ties: smallest content)."""
    tagged = [f.withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in both.columns if c not in ("battle_id", "_frame")]
    # min of a struct is aggregated map-side, so an id with very many rows costs one row a task.
    first = both.groupBy("battle_id").agg(F.min(F.struct("_frame", *rest)).alias("r"))
    return first.select(*[F.col("battle_id") if c == "battle_id" else F.col(f"r.{c}").alias(c) for c in both.columns if c != "_frame"])


def from_turns(turns: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """First user text and first assistant text of conversations given as one row per turn."""
    role = F.lower("role")
    first = lambda roles: F.min_by("text", F.when(role.isin(*roles), F.col(order)))
    has = lambda roles: F.max(role.isin(*roles))
    return turns.groupBy(conversation).agg(
        F.when(has(USER_ROLES), first(USER_ROLES)).otherwise("").alias("prompt"),
        F.when(has(ASSISTANT_ROLES), first(ASSISTANT_ROLES)).otherwise("").alias("completion"),
    )


def plain_text(content, kind: T.DataType):
    """Text of a message's content: a string, or a list of strings or of parts with ``text`` or ``content``."""
    if isinstance(kind, T.ArrayType):
        part = kind.elementType
        if isinstance(part, T.StructType):
            fields = [f for f in ("text", "content") if f in part.names]
            one = lambda p: F.coalesce(*[p[f].cast("string") for f in fields], F.lit(""))
        else:
            one = lambda p: F.coalesce(p.cast("string"), F.lit(""))
        return F.coalesce(F.array_join(F.filter(F.transform(content, one), lambda p: p != ""), "\n"), F.lit(""))
    return F.coalesce(content.cast("string"), F.lit(""))


def messages_of(conversation, kind: T.DataType):
    """(array of messages, type of a message): the conversation, or the first field of it that holds messages."""
    while isinstance(kind, T.StructType):
        field = next((f for f in MESSAGE_FIELDS if f in kind.names), None)
        if field is None:
            break
        conversation, kind = conversation[field], kind[field].dataType
    return (conversation, kind.elementType) if isinstance(kind, T.ArrayType) else (None, None)


def first_text(df: DataFrame, column: str, roles):
    """Text of the first message of a role in a conversation column of any of the known forms; empty without one."""
    messages, kind = messages_of(F.col(column), df.schema[column].dataType)
    if not isinstance(kind, T.StructType) or "role" not in kind.names or "content" not in kind.names:
        return F.lit("")
    found = F.get(F.filter(messages, lambda m: F.lower(m["role"]).isin(*roles)), F.lit(0))
    return plain_text(found["content"], kind["content"].dataType)


def conversations_to_corpus(df: DataFrame, source: str, conv_a="conversation_a", conv_b="conversation_b", prompt: str | None = None) -> DataFrame:
    schema.require(df, conv_a, conv_b, "model_a", "model_b")
    question = plain_text(F.col(prompt), df.schema[prompt].dataType) if prompt else first_text(df, conv_a, USER_ROLES)
    out = df.withColumns(
        {
            "prompt": question,
            "completion_a": first_text(df, conv_a, ASSISTANT_ROLES),
            "completion_b": first_text(df, conv_b, ASSISTANT_ROLES),
        }
    )
    if "winner" in df.columns and schema.LABEL not in df.columns:
        out = out.withColumn(schema.LABEL, text.vote(F.col("winner")))
    return normalize(out, source)


def chosen_pref(df: DataFrame, chosen: str = "chosen_model", model_a: str = "model_a", model_b: str = "model_b") -> DataFrame:
    """human_pref from both_equal and the name of the chosen model."""
    own = F.col(chosen)
    return df.withColumn(
        schema.LABEL,
        F.when(F.col("both_equal"), 0.5).when(own == F.col(model_a), 1.0).when(own == F.col(model_b), 0.0).otherwise(0.5),
    )


#: Sources of battles, the columns in which they differ, and how they state a vote.
ARENAS = {
    "lmarena-100k": {},
    "lmarena-140k": {},
    "comparia": {"model_a": "model_a_name", "model_b": "model_b_name", "prompt": "opening_msg", "chosen": "chosen_model_name"},
}


def load_arena(spark: SparkSession, source: str, path: str, limit: int | None = None, keep_labels: bool = False) -> DataFrame:
    """A downloaded dump of a known source as a corpus; ``keep_labels`` carries the vote."""
    if source not in ARENAS:
        raise ValueError(f"unknown source {source!r}; known: {', '.join(sorted(ARENAS))}")
    own, df = ARENAS[source], load_table(spark, path)
    df = df if limit is None else df.limit(limit)
    if keep_labels:
        df = chosen_pref(df, own["chosen"], own["model_a"], own["model_b"]) if "chosen" in own else df.withColumn(schema.LABEL, text.vote(F.col("winner")))
    else:
        df = df.drop("winner", schema.LABEL)
    for side in ("model_a", "model_b"):
        if side in own:
            df = df.drop(side).withColumnRenamed(own[side], side)
    return conversations_to_corpus(df, source, prompt=own.get("prompt"))


def judged_battles(samples: DataFrame) -> DataFrame:
    """Judge samples (instruction_id, texts, models, judge_pref or preference) as labelled battles.

    The judge states P(B); quarter votes count as ties; of one instruction_id one row stays.
    """
    schema.require(samples, "instruction_id", "completion_a", "completion_b")
    prefs = [F.col(c).cast("double") for c in ("judge_pref", "preference") if c in samples.columns]
    p = F.coalesce(*prefs) if prefs else F.lit(None).cast("double")
    p = F.when(p.isin(0.25, 0.75), 0.5).otherwise(p)
    kept = samples.withColumn("y_judge", 1.0 - p).filter("y_judge is not null")
    for c in ("completion_a", "completion_b"):
        kept = kept.filter(~text.blank(F.col(c)))
    if "parse_error" in samples.columns:
        kept = kept.filter(~F.coalesce(F.col("parse_error").cast("boolean"), F.lit(False)))
    rest = [c for c in kept.columns if c != "instruction_id"]
    return kept.groupBy("instruction_id").agg(F.min(F.struct(*rest)).alias("r")).select("instruction_id", "r.*")


def load_judged(spark: SparkSession, paths) -> DataFrame:
    """Judge JSON files: an object with ``per_sample`` or ``matches``, or a list of samples."""
    raw = spark.read.option("multiLine", True).json(paths)
    lists = [c for c in ("per_sample", "matches") if c in raw.columns]
    if lists:
        raw = raw.select(F.explode(F.coalesce(*[F.col(c) for c in lists])).alias("s")).select("s.*")
    elif "instruction_id" not in raw.columns:
        raise ValueError("judge files hold a list of samples, or an object with per_sample or matches")
    if "instruction" in raw.columns and "prompt" not in raw.columns:
        raw = raw.withColumnRenamed("instruction", "prompt")
    return judged_battles(raw)


def criteria(columns: list[str]) -> list[str]:
    """Names X of scored criteria: columns X_A with a partner X_B."""
    return [c[:-2] for c in columns if c.endswith("_A") and c[:-2] + "_B" in columns and c[:-2] not in ("completion", "model")]


def judge_scores(df: DataFrame) -> DataFrame:
    """human_pref from scored criteria, or else from ``score a`` / ``score b`` in the judge's reply."""
    names = criteria(df.columns)
    sides = {}
    for side in ("A", "B"):
        if names:
            values = F.filter(F.array(*[F.col(f"`{n}_{side}`").cast("string").try_cast("double") for n in names]), lambda x: x.isNotNull() & ~F.isnan(x))
            total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
            sides[side] = F.when(F.size(values) > 0, total / F.size(values))
        else:
            reply = F.lower(F.regexp_replace("judge_completion", r"(?s)<think>.*?</think>", ""))
            score = F.regexp_extract(reply, rf"(?s)score[_\s]*{side.lower()}\D*(\d+)", 1).try_cast("double")
            sides[side] = F.when(score.between(0, 10), score)
    a, b = sides["A"], sides["B"]
    return df.withColumn(schema.LABEL, F.when(a > b, 1.0).when(a < b, 0.0).when(a == b, 0.5))


def mapped(df: DataFrame, **columns: str | None) -> DataFrame:
    """A table with its columns named: prompt, a, and optionally b, pref, model_a, model_b, id."""
    names = {"prompt": "prompt", "a": "completion_a", "b": "completion_b", "pref": schema.LABEL, "model_a": "model_a", "model_b": "model_b", "id": "instruction_id"}
    given = {k: v for k, v in columns.items() if v}
    schema.require(df, *given.values())
    out = df.select(*[F.col(f"`{v}`").alias(names[k]) for k, v in given.items()])
    if "pref" in given:
        out = out.withColumn(schema.LABEL, schema.label())
    if "id" not in given:
        content = F.concat_ws(hashing.FIELD_SEPARATOR, *[F.coalesce(F.col(names[k]).cast("string"), F.lit("")) for k in given])
        out = out.withColumn("instruction_id", F.substring(F.sha1(content), 1, 16))
    return out


def reattach(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """Texts onto coded rows by battle_id; a row without text is an error."""
    lost = rows.join(corpus, "battle_id", "left_anti").limit(1).count()
    if lost:
        raise ValueError("some coded rows are not in the corpus")
    return rows.join(corpus, "battle_id")


def write_corpus(df: DataFrame, path: str) -> None:
    extra = [schema.LABEL] if schema.LABEL in df.columns else []
    df.select(*schema.CORPUS_COLUMNS, *extra).write.mode("overwrite").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str = "feature_id") -> DataFrame:
    """New rows replace old ones with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
