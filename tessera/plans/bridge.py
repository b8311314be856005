"""Battles, codes and conversations built from the star-schema test tables.

Consecutive labelled documents make battles, the embeddings of their identifiers make codes through a
frozen identity lens (an entry fires when its size is over a threshold).  SQL states the same tables
for the engine that checks the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codes
from ..shipping import ship
from ..sources import corpus

DIFF, SIDE, PROMPT_FEATURES = 0.20, 0.15, 16


class Bridge:
    """Tables of one folder; each is built when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        ship(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", codes.doubles(F.col("embedding")).alias("e"))

    def n_vectors(self) -> int:
        return self.table("embeddings").count()

    def turns(self) -> DataFrame:
        return self.table("conversations")

    def labelled(self) -> DataFrame:
        score = (F.col("quality") - F.col("toxic")).alias("s")
        return self.table("documents").join(self.table("labels").select("doc_id", score), "doc_id").select("doc_id", "lang", "source", "text", "s")

    def pairs(self) -> DataFrame:
        """Battles without texts of prompts: document i against documents i + 1 and i + 2."""
        lab = self.labelled()
        a = lab.select(*[F.col(c).alias(f"a_{c}") for c in lab.columns]).withColumn("b_doc_id", F.explode(F.array(F.col("a_doc_id") + 1, F.col("a_doc_id") + 2)))
        b = lab.select(*[F.col(c).alias(f"b_{c}") for c in lab.columns])
        gap = F.col("a_s") - F.col("b_s")
        return a.join(b, "b_doc_id").select(
            F.concat_ws("_", F.col("a_doc_id").cast("string"), F.col("b_doc_id").cast("string")).alias("battle_id"),
            "a_doc_id", "b_doc_id", F.col("a_source").alias("model_a"), F.col("b_source").alias("model_b"), F.col("a_text").alias("completion_a"),
            F.col("b_text").alias("completion_b"), F.col("a_lang").alias("language"), F.when(gap > 0, 1.0).when(gap < 0, 0.0).otherwise(0.5).alias("human_pref"),
        )

    def battles(self) -> DataFrame:
        return self.pairs()

    def with_prompts(self) -> DataFrame:
        first = corpus.from_turns(self.turns())
        n = first.count()
        return self.pairs().withColumn("conv_id", F.pmod("a_doc_id", F.lit(n))).join(first.select("conv_id", "prompt"), "conv_id")

    def sides(self) -> DataFrame:
        n, v = self.n_vectors(), self.vectors()
        keyed = self.pairs().select("battle_id", F.pmod("a_doc_id", F.lit(n)).alias("va"), F.pmod("b_doc_id", F.lit(n)).alias("vb"))
        a = v.select(F.col("vec_id").alias("va"), F.col("e").alias("e_a"))
        b = v.select(F.col("vec_id").alias("vb"), F.col("e").alias("e_b"))
        return keyed.join(a, "va").join(b, "vb").select("battle_id", "e_a", "e_b")

    def z_diff(self) -> DataFrame:
        s = codes.represent(self.sides(), "difference")
        return codes.sparse(s, F.col("vector"), DIFF, "battle_id")

    def z_side(self, side: str, positive: bool = True) -> DataFrame:
        return codes.sparse(self.sides(), F.col(f"e_{side}"), SIDE, "battle_id", positive=positive)

    def z_prompt(self) -> DataFrame:
        n, v = self.n_vectors(), self.vectors()
        n_conv = self.turns().agg(F.count_distinct("conv_id")).first()[0]
        keyed = self.pairs().select("battle_id", F.pmod(F.pmod("a_doc_id", F.lit(n_conv)), F.lit(n)).alias("vec_id"))
        return codes.sparse(keyed.join(v, "vec_id"), F.slice("e", 1, PROMPT_FEATURES), 0.0, "battle_id", positive=True)

    def prompt_types(self) -> DataFrame:
        return codes.dominant(self.z_prompt())

    def meta(self) -> DataFrame:
        return codes.oriented(self.battles()).drop("sign")

    def bank_codes(self) -> DataFrame:
        return codes.bank(self.battles(), self.z_diff())[1]

    def tokens(self) -> DataFrame:
        n = self.n_vectors()
        keyed = self.turns().select(
            F.col("conv_id").alias("battle_id"), F.col("role").alias("span"), F.col("turn").alias("token_idx"), F.pmod(F.col("conv_id") * 8 + F.col("turn"), F.lit(n)).alias("vec_id")
        )
        return keyed.join(self.vectors(), "vec_id")

    def features(self) -> DataFrame:
        return self.spark.range(64).select(F.col("id").cast("int").alias("feature_id"))

    def names(self) -> DataFrame:
        f = self.features()
        return f.select(
            "feature_id", F.concat(F.lit("concept_"), F.col("feature_id").cast("string")).alias("concept"), F.pmod("feature_id", F.lit(8)).cast("int").alias("cluster_id"),
            (F.pmod("feature_id", F.lit(3)) != 0).alias("fidelity_pass"),
        )

    def undesirable(self) -> DataFrame:
        return self.features().filter("feature_id < 8")


#: The same tables as SQL, to be put in front of a query.
SQL = """
with emb as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
nv as (select count(*) as n from embeddings), nc as (select count(distinct conv_id) as n from conversations),
lab as (select d.doc_id, d.lang, d.source, d.text, l.quality - l.toxic as s from documents d join labels l on d.doc_id = l.doc_id),
battles as (select concat(a.doc_id, '_', b.doc_id) as battle_id, a.doc_id as a_doc_id, b.doc_id as b_doc_id, a.source as model_a, b.source as model_b,
    a.text as completion_a, b.text as completion_b, a.lang as language, case when a.s > b.s then 1.0::double when a.s < b.s then 0.0::double else 0.5::double end as human_pref
    from lab a join lab b on b.doc_id in (a.doc_id + 1, a.doc_id + 2)),
sides as (select battle_id, a.e as e_a, b.e as e_b from battles join nv on true join emb a on a.vec_id = a_doc_id % nv.n join emb b on b.vec_id = b_doc_id % nv.n),
dims as (select unnest(range(0, 64))::int as feature_id),
zd as (select * from (select battle_id, feature_id, e_a[feature_id + 1] - e_b[feature_id + 1] as z from sides, dims) q where abs(z) > 0.20),
za as (select * from (select battle_id, feature_id, e_a[feature_id + 1] as z from sides, dims) q where z > 0.15),
zb as (select * from (select battle_id, feature_id, e_b[feature_id + 1] as z from sides, dims) q where z > 0.15),
zp as (select * from (select battle_id, feature_id, e[feature_id + 1] as z from battles join nv on true join nc on true join emb on vec_id = (a_doc_id % nc.n) % nv.n, dims where feature_id < 16) q where z > 0),
pt as (select battle_id, feature_id as prompt_concept, z as activation from (select *, row_number() over (partition by battle_id order by z desc, feature_id) as r from zp) q where r = 1),
meta as (select concat(battle_id, '|a') as row_id, battle_id, 'a' as orientation, model_a as self_model, model_b as other_model, human_pref as win from battles
    union all select concat(battle_id, '|b'), battle_id, 'b', model_b, model_a, 1 - human_pref from battles),
bk as (select concat(battle_id, '|a') as row_id, feature_id, z from zd union all select concat(battle_id, '|b'), feature_id, -z from zd),
nb as (select count(*)::bigint as n from battles),
bucket as (select battle_id, ((((((
    ('0x' || substr(sha1(battle_id), 1, 8))::bigint % 1000) * 296 + ('0x' || substr(sha1(battle_id), 9, 8))::bigint) % 1000) * 296
    + ('0x' || substr(sha1(battle_id), 17, 8))::bigint) % 1000) * 296 + ('0x' || substr(sha1(battle_id), 25, 8))::bigint) % 1000 as b4,
    ('0x' || substr(sha1(battle_id), 33, 8))::bigint as last from battles),
halves as (select battle_id, (b4 * 296 + last) % 1000 as b, ((b4 * 296 + last) % 1000) % 2 as half from bucket)
"""
