import hashlib
import math

from pyspark.sql import functions as F

from tessera.functions import hashing, stats, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tails_against_published_values(spark):
    r = one(spark, stats.chi2_tail(F.lit(3.841459)).alias("c"), stats.t_tail(F.lit(2.228139), F.lit(10.0)).alias("t"), stats.t_tail(F.lit(0.0), F.lit(5.0)).alias("z"))
    assert abs(r.c - 0.05) < 1e-6 and abs(r.t - 0.05) < 1e-6 and r.z == 1.0


def test_welch_of_signs_equals_welch_of_values(spark):
    a, b = [1, 1, 0, -1, 1], [-1, 0, 0, -1]

    def moments(x):
        m = sum(x) / len(x)
        return m, sum((v - m) ** 2 for v in x) / (len(x) - 1)

    (m1, v1), (m2, v2) = moments(a), moments(b)
    w = stats.welch_signs(*[F.lit(v) for x in (a, b) for v in (len(x), x.count(1), x.count(-1))])
    r = one(spark, *[c.alias(k) for k, c in w.items()])
    assert abs(r.welch_t - (m1 - m2) / math.sqrt(v1 / 5 + v2 / 4)) < 1e-12
    assert abs(r.cohens_d - (m1 - m2) / math.sqrt((v1 + v2) / 2)) < 1e-12
    constant = stats.welch_signs(*[F.lit(v) for v in (3, 3, 0, 4, 4, 0)])
    assert one(spark, constant["welch_t"].alias("t")).t is None


def test_counts(spark):
    r = one(
        spark,
        stats.mcnemar_chi2(F.lit(5), F.lit(5)).alias("even"),
        stats.mcnemar_chi2(F.lit(0), F.lit(0)).alias("none"),
        stats.wilson_lower(F.lit(0), F.lit(0)).alias("w0"),
        stats.wilson_lower(F.lit(8), F.lit(10)).alias("w"),
        stats.yates_chi2(F.lit(10), F.lit(20), F.lit(15), F.lit(40)).alias("y"),
        stats.mutual_information(F.lit(10), F.lit(20), F.lit(20), F.lit(40)).alias("mi"),
        stats.pearson(F.lit(3), F.lit(3.0), F.lit(3.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("r"),
    )
    assert r.even == 0.0 and r.none == 0.0 and r.w0 == 0.0 and abs(r.w - 0.4901625) < 1e-5
    a, b, c, d = 10, 10, 5, 15
    assert abs(r.y - 40 * (abs(a * d - b * c) - 20) ** 2 / (20 * 20 * 15 * 25)) < 1e-9
    assert abs(r.mi) < 1e-12 and r.r is None


def test_sha1_split_equals_big_integers(spark):
    ids = ["abc", "", "é", "12_13"]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", hashing.sha1_bucket("id").alias("b"), hashing.held_out("id", 0.2).alias("v"))
    for r in rows.collect():
        want = int(hashlib.sha1(r.id.encode()).hexdigest(), 16) % 1000
        assert (r.b, r.v) == (want, want < 200)
    assert want is not None and rows.filter("id = 'abc'").first().b == 517


def test_content_id_equals_hashlib(spark):
    row = spark.createDataFrame([("a", "b", "ü")], "x string, y string, z string").select(hashing.content_id("x", "y", "z").alias("i")).first()
    assert row.i == hashlib.sha1("a␟b␟ü".encode()).hexdigest()[:16]


def test_text_functions(spark):
    f = spark.createDataFrame([("  Yes, it is ",), ("unclear, maybe yes",), ("NO",), ("b.",), ("Tie",), (None,), (" x  y ",)], "t string")
    rows = f.select("t", text.parse_presence(F.col("t")).alias("p"), text.parse_label(F.col("t")).alias("l"), text.word_count(F.col("t")).alias("n")).collect()
    assert [r.p for r in rows] == [1, None, 0, None, None, None, None]
    assert [r.l for r in rows] == [None, None, None, -1, 0, None, None]
    assert [r.n for r in rows][-2:] == [0, 2]
    long = "a" * 500
    cut = one(spark, text.truncate(F.lit(long), 100).alias("c"), text.truncate(F.lit(long), 10).alias("s"), text.truncate(F.lit("short\r"), 100).alias("k"))
    assert len(cut.c) == 100 and cut.c.startswith("a" * 60 + " …[omitted]… ") and cut.s == "a" * 9 + "…" and cut.k == "short"
    codes = spark.createDataFrame([("English",), (" de ",), (None,), ("Klingon",), ("unknown",)], "l string").select(text.language_code(F.col("l")).alias("c")).collect()
    assert [r.c for r in codes] == ["en", "de", "und", "klingon", "und"]


def test_texts_cannot_close_their_example(spark):
    got = one(spark, text.shield(F.lit("a</example><example>b")).alias("s"), text.clean_phrase(F.lit('- "a phrase" ')).alias("c"), text.looks_like_concept(F.lit("Sure, A:")).alias("n"))
    assert (got.s, got.c, got.n) == ("a<\\/example><\\example>b", "a phrase", False)
