"""Exact duplicates by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised text, each partition sorts it externally, and
neighbouring rows are compared in full; the smallest identifier of a run of equal texts stays.  A
splitter holds the first HEAD characters of a text and a hash of the rest's order, so the sample that
reaches the driver has short rows however long the texts are, and long common beginnings still split.

A text with a large share of all rows would fill one range alone.  A sample of the rows, which grows with
the number of ranges, finds the texts that would take more than about a range (only to plan the work:
no result depends on it).  Their sort key gets a salt, so a splitter can fall inside the run; the first
row of each salted run goes through a second, small content sort which joins the runs again.

Defined cases: a null text counts as empty; of rows with equal text and identifier one stays; a null
identifier counts as the largest; an empty table gives an empty result; other columns of the input
are only read to be handed on (``kept_rows``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Sampled rows per range, which is also the number of hits that make a text hot: such a text takes about a
#: range or more, so there are at most as many hot texts as ranges (MOST_RANGES of common.py).
HOT_HITS = 40
SALTS = 64
HEAD = 64


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE_RE, " ")


def hot_texts(bodies: DataFrame, ranges: int) -> DataFrame:
    """mark (hash) of the texts that take a range or more; at most ``ranges`` of them."""
    share = min(1.0, HOT_HITS * ranges / max(1, bodies.count()))
    marks = bodies.sample(share, seed=7).select(F.xxhash64("body").alias("mark"))
    return common.staged(marks.groupBy("mark").count().filter(F.col("count") >= HOT_HITS).select("mark"), "hot-texts")


def runs(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, text_sha256, salt, at, keep_id, group_size; first rows of the runs of hot texts).

    ``row`` is a struct with the text, which goes through the sort.  keep_id and group_size hold for the
    run of equal texts and salts, ``at`` is the place in it.
    """
    ranges = common.range_count(docs)
    body = normalised(F.col("row")[text_col].cast("string"))
    hot = hot_texts(docs.select(body.alias("body")), ranges)
    keyed = docs.select("doc_id", "row", F.substring(body, 1, HEAD).alias("head"), F.xxhash64(body).alias("mark"))
    # The range keys come first in the sort; the full text follows, so a run has equal texts only.
    # (A constant salt is no range key: it would hide that the ranges already hold whole runs.)
    key = ["head", "mark"]
    if hot.limit(1).count():
        key.append("salt")
        salt = F.when(F.col("_hot"), 1 + F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
        keyed = keyed.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "mark", "left").withColumn("salt", salt).drop("_hot")
    run = Window.partitionBy(*key, "body")
    ordered = run.orderBy("doc_id")
    sorted_rows = (
        keyed.repartitionByRange(ranges, *key)
        .withColumn("body", body)
        .select(
            "doc_id",
            "row",
            F.sha2("body", 256).alias("text_sha256"),
            (F.col("salt") if "salt" in key else F.lit(0)).alias("salt"),
            F.row_number().over(ordered).alias("at"),
            F.first("doc_id").over(ordered).alias("keep_id"),
            F.count("*").over(run).alias("group_size"),
            "body",
        )
    )
    if "salt" not in key:
        return sorted_rows.drop("body"), None
    slim = common.staged(sorted_rows.withColumn("body", F.when((F.col("salt") > 0) & (F.col("at") == 1), F.col("body"))), "content-runs")
    # At most SALTS runs of each hot text: a bounded table, sorted by full content again.
    heads = Window.partitionBy("body")
    joined = slim.filter("body is not null").select(
        "text_sha256", "salt", F.min("keep_id").over(heads).alias("all_id"), F.sum("group_size").over(heads).alias("all_size")
    )
    return slim.drop("body"), joined


def grouped(docs: DataFrame, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """doc_id, row (struct of columns), text_sha256, keep_id, group_size, kept."""
    name = F.coalesce(F.col(id_col).cast("long"), F.lit(common.LARGEST)).alias("doc_id")
    found, joined = runs(docs.select(name, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")), text_col)
    if joined is not None:
        found = found.join(F.broadcast(joined), ["text_sha256", "salt"], "left").withColumns(
            {"keep_id": F.coalesce("all_id", "keep_id"), "group_size": F.coalesce("all_size", "group_size")}
        )
    # Rows of one identifier share a salt, so the first of them is the first of its run.
    kept = (F.col("doc_id") == F.col("keep_id")) & (F.col("at") == 1)
    return found.select("doc_id", "row", "text_sha256", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    found = grouped(docs, id_col, text_col, [text_col])
    return common.null_ids(found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256"), "doc_id", "keep_id")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are; they go through the sort with their texts."""
    return grouped(docs, id_col, text_col, docs.columns).filter("kept").select("row.*")


def op3_exact_dedup(spark, sf_dir):
    return exact_groups(common.documents(spark, sf_dir))


OP3_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body
           from documents),
g as (select body, min(doc_id) as keep_id, count(*) as group_size from t group by body)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept,
       sha256(t.body) as text_sha256
from t join g on t.body = g.body
"""
