"""The registered queries over the bridge tables, each next to the SQL that states it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import schema
from ..functions import hashing, text
from ..functions import stats as S
from ..operators import cluster, codes, conditional, diagnose, elicit, export, interpret, lens, logistic, modes, relevance, select, validate
from ..sources import corpus
from .bridge import PROMPT_FEATURES, SQL, Bridge

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None, bridged: bool = True):
    """Register a function of a Bridge under its name, with its SQL."""

    def keep(build):
        QUERIES[build.__name__] = lambda spark, folder: build(Bridge(spark, folder))
        if sql:
            ORACLE[build.__name__] = (SQL if bridged else "") + sql
        return build

    return keep


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- sources and splits ------------------------------------------------------------------------


@query("select model, count(*)::bigint as n from (select unnest([model_a, model_b]) as model from battles) q group by model")
def inspect_models(b):
    return diagnose.models(b.battles())


@query("""select count(*)::bigint as n_battles, count_if(human_pref = 1)::bigint as n_a, count_if(human_pref = 0)::bigint as n_b, count_if(human_pref = 0.5)::bigint as n_tie,
count(distinct language)::bigint as n_languages, (select count(distinct m) from (select unnest([model_a, model_b]) as m from battles) q)::bigint as n_models from battles""")
def inspect_battles(b):
    return diagnose.inspect(b.battles())


@query("""select substr(sha1(concat_ws('␟', source, lang, source, lang, text)), 1, 16) as id, doc_id from documents where text is not null""", bridged=False)
def content_ids(b):
    docs = b.table("documents").filter("text is not null")
    return docs.select(hashing.content_id("source", "lang", "source", "lang", "text").alias("id"), "doc_id")


@query("""select battle_id, first(source order by source) as source, count(*)::bigint as n from (
select substr(sha1(text), 1, 16) as battle_id, 'one' as source from documents where doc_id % 2 = 0
union all select substr(sha1(text), 1, 16), 'two' from documents) q group by battle_id""", bridged=False)
def merge_dedup(b):
    docs = b.table("documents")
    own = docs.select(F.substring(F.sha1("text"), 1, 16).alias("battle_id"), "doc_id")
    one, two = own.filter("doc_id % 2 = 0").drop("doc_id"), own.drop("doc_id")
    merged = corpus.merge([one.withColumn("source", F.lit("one")), two.withColumn("source", F.lit("two"))])
    return merged.join(one.unionAll(two).groupBy("battle_id").agg(F.count("*").alias("n")), "battle_id")


@query("""select conv_id, coalesce(min_by(text, turn) filter (where lower(role) in ('user', 'human')), '') as prompt,
coalesce(min_by(text, turn) filter (where lower(role) in ('assistant', 'model', 'bot', 'gpt', 'ai')), '') as completion from conversations group by conv_id""", bridged=False)
def conversation_first_turns(b):
    return corpus.from_turns(b.turns())


@query("""select doc_id, case when lower(trim(source)) = 'src1' then 1.0::double when lower(trim(source)) = 'src2' then 0.0::double else 0.5::double end as pref,
case lang when 'en' then 'en' else lang end as code from documents""", bridged=False)
def label_mapping(b):
    winner = F.when(F.col("source") == "src1", " Model_A ").when(F.col("source") == "src2", "model_b").otherwise("bothbad")
    names = F.when(F.col("lang") == "en", "English ").when(F.col("lang") == "de", "German").otherwise(F.col("lang"))
    return b.table("documents").select("doc_id", text.vote(winner).alias("pref"), text.language_code(names).alias("code"))


@query("""select battle_id, case when model_a = 'src0' then 1 else -1 end as sign, case when model_a = 'src0' then model_b else model_a end as other_model,
case when model_a = 'src0' then human_pref else 1 - human_pref end as win,
case (case when model_a = 'src0' then human_pref else 1 - human_pref end) when 1 then 'win' when 0 then 'loss' else 'tie' end as outcome
from battles where model_a = 'src0' or model_b = 'src0'""")
def pair_orient_model(b):
    return codes.orient_to_model(b.battles(), "src0").select("battle_id", "sign", "other_model", "win", "outcome")


@query("select zd.battle_id, feature_id, round(z * sign(human_pref - 0.5), 6) as z from zd join battles using (battle_id) where human_pref <> 0.5")
def orient_by_label(b):
    return rounded(codes.orient_by_label(b.z_diff(), b.battles()), "z")


@query(r"""select battle_id, (len(regexp_extract_all(completion_a, '[^\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'))
 - len(regexp_extract_all(completion_b, '[^\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')))::bigint as length from battles""")
def length_gap(b):
    return codes.oriented(b.battles()).filter("orientation = 'a'").select("battle_id", "length")


@query("select battle_id, b::bigint as bucket, b < 200 as held_out, half::bigint as half from halves")
def hash_split(b):
    own = b.battles().select("battle_id")
    return own.select("battle_id", hashing.sha1_bucket("battle_id").alias("bucket"), hashing.held_out("battle_id", 0.2).alias("held_out"), hashing.half("battle_id").alias("half"))


# --- codes -------------------------------------------------------------------------------------


@query("select battle_id, feature_id, round(z, 6) as z from zd")
def codes_sparse(b):
    return rounded(b.z_diff(), "z")


@query("""select battle_id, feature_id, round(sum(z), 6) as z from (select * from za union all select battle_id, feature_id, -z from zb) q
group by battle_id, feature_id having sum(z) <> 0""")
def codes_individual(b):
    return rounded(codes.contrast(b.z_side("a"), b.z_side("b"), "battle_id"), "z")


@query("""select (select n from nb) as n_rows, round((select count(*) from zd) / (select n from nb), 6) as mean_l0,
((select n from nb) - (select count(distinct battle_id) from zd))::bigint as n_silent, (select count(distinct feature_id) from zd)::bigint as n_features_used""")
def code_stats(b):
    return rounded(codes.code_stats(b.z_diff(), b.battles(), "battle_id"), "mean_l0")


@query("""select battle_id, feature_id, round(sum(abs(z)) / 2, 6) as activity from (select * from za union all select * from zb) q group by battle_id, feature_id""")
def symmetric_activity(b):
    return rounded(codes.symmetric_activity(b.z_side("a"), b.z_side("b"), "battle_id"), "activity")


@query("select row_id, m.orientation, self_model, other_model, win, count(feature_id)::bigint as n_codes, round(coalesce(sum(z), 0), 6) as total from meta m left join bk using (row_id) group by all")
def bank_rows(b):
    meta, own = codes.bank(b.battles(), b.z_diff())
    per = own.groupBy("row_id").agg(F.count("*").alias("k"), F.sum("z").alias("t"))
    return meta.join(per, "row_id", "left").select(
        "row_id", "orientation", "self_model", "other_model", "win", F.coalesce("k", F.lit(0)).alias("n_codes"), F.round(F.coalesce("t", F.lit(0.0)), 6).alias("total")
    )


@query("""select battle_id, prompt_concept, round(activation, 6) as activation from pt""")
def prompt_dominant(b):
    return rounded(b.prompt_types(), "activation")


@query("""select span.battle_id, span.span, f.feature_id, round(case when f.k < span.n then greatest(f.top, 0) else f.top end, 6) as x_max, round(f.k / span.n, 6) as x_freq from
(select conv_id as battle_id, role as span, count(*) as n from conversations group by all) span join
(select conv_id as battle_id, role as span, feature_id, max(z) as top, count(*) as k from (select conv_id, role, feature_id, e[feature_id + 1] as z
 from conversations join nv on true join emb on vec_id = (conv_id * 8 + turn) % nv.n, dims) q where abs(z) > 0.15 group by all) f
on span.battle_id = f.battle_id and span.span = f.span""")
def span_summaries(b):
    tokens = b.tokens()
    own = codes.sparse(tokens, F.col("e"), 0.15, "battle_id", "span")
    return rounded(codes.summarize_spans(tokens, own), "x_max", "x_freq")


# --- relevance and data quality ----------------------------------------------------------------

_PEARSON = "case when {n} * {xx} - {x} * {x} > 1e-12 and {n} * {yy} - {y} * {y} > 1e-12 then ({n} * {xy} - {x} * {y}) / sqrt(({n} * {xx} - {x} * {x}) * ({n} * {yy} - {y} * {y})) end"


def pearson_sql(n, x, xx, y, yy, xy):
    return _PEARSON.format(n=f"({n})", x=f"({x})", xx=f"({xx})", y=f"({y})", yy=f"({yy})", xy=f"({xy})")


@query(f"""select feature_id, coalesce(n_fire, 0)::bigint as n_fire, round(coalesce(n_fire, 0) / (select n from nb), 6) as fire_rate, round(wa, 6) as win_rate_a_more, round(wl, 6) as win_rate_a_less, round(wa - wl, 6) as win_assoc,
round(case when p > 0 and q > 0 then {pearson_sql("n_fire", "p - q", "n_fire", "sc", "scc", "ssc")} end, 6) as correlation from dims left join (
select feature_id, count(*)::bigint as n_fire, count_if(z > 0)::double as p, count_if(z < 0)::double as q, avg(case when z > 0 then human_pref end) as wa, avg(case when z < 0 then human_pref end) as wl,
sum(2 * human_pref - 1) as sc, sum((2 * human_pref - 1) ** 2) as scc, sum(sign(z) * (2 * human_pref - 1)) as ssc from zd join battles using (battle_id) group by feature_id) q using (feature_id)""")
def win_relevance(b):
    out = relevance.win_relevance(b.z_diff(), b.battles(), p_values=False, features=b.features())
    return rounded(out, "fire_rate", "win_rate_a_more", "win_rate_a_less", "win_assoc", "correlation")


@query("""select feature_id, round(count(*) / (select n from nb), 6) as fire_rate, round(count_if(z > 0) / (select n from nb), 6) as more_rate,
round(count_if(z < 0) / (select n from nb), 6) as less_rate, round(sum(abs(z)) / (select n from nb), 6) as mean_abs_z from zd group by feature_id""")
def feature_table(b):
    return rounded(relevance.feature_table(b.z_diff(), b.battles().count()), "fire_rate", "more_rate", "less_rate", "mean_abs_z")


@query("select feature_id, round(count(*) / (2 * (select n from nb)), 4) as fire_rate from (select * from za union all select * from zb) q group by feature_id")
def feature_fire_rate(b):
    return relevance.fire_rate(b.z_side("a"), b.z_side("b"), b.battles().count())


_WINNER = "wz as (select battle_id, feature_id, z * sign(human_pref - 0.5) as z from zd join battles using (battle_id) where human_pref <> 0.5), dec as (select battle_id from battles where human_pref <> 0.5)"


def winner_codes(b):
    return codes.orient_by_label(b.z_diff(), b.battles())


def decisive(b):
    return b.battles().filter("human_pref <> 0.5")


@query(f", {_WINNER} select feature_id, round(sum(sign(z)) / (select count(*) from dec), 6) as effect from wz group by feature_id")
def dataset_reward(b):
    return rounded(relevance.dataset_reward(winner_codes(b), decisive(b).count()), "effect")


_HALVES = f"""{_WINNER}, hn as (select count(*)::double as n, count_if(half = 0)::double as n0, count_if(half = 1)::double as n1 from dec join halves using (battle_id)),
sh as (select feature_id, sum(sign(z)) / any_value(n) as effect, sum(case when half = 0 then sign(z) else 0 end) / any_value(n0) as ea, sum(case when half = 1 then sign(z) else 0 end) / any_value(n1) as eb
from wz join halves using (battle_id), hn group by feature_id)"""


@query(f", {_HALVES} select feature_id, round(effect, 6) as effect, round(ea, 6) as effect_a, round(eb, 6) as effect_b, sign(ea) * sign(eb) > 0 as stable from sh")
def split_half(b):
    return rounded(relevance.split_half(winner_codes(b), decisive(b)), "effect", "effect_a", "effect_b")


@query(f""", {_WINNER} select dec.battle_id, round(coalesce(sum(case when feature_id < 8 then abs(z) end), 0) / greatest(coalesce(sum(abs(z)), 0), 1e-9), 6) as spurious_share
from dec left join wz using (battle_id) group by dec.battle_id""")
def spurious_share(b):
    return rounded(relevance.spurious_share(winner_codes(b), decisive(b), b.undesirable()), "spurious_share")


@query(f""", {_HALVES} select dec.battle_id, round(coalesce(sum(case when wz.feature_id >= 8 then sign(z) * effect end), 0), 6) as label_inconsistency
from dec left join wz using (battle_id) left join sh using (feature_id) group by dec.battle_id""")
def label_inconsistency(b):
    z, rows = winner_codes(b), decisive(b)
    return rounded(relevance.label_inconsistency(z, rows, relevance.split_half(z, rows), b.undesirable()), "label_inconsistency")


_WORDS = r"len(regexp_extract_all({c}, '[^\s]+'))"
_GAP = f"lg as (select battle_id, human_pref, (length(completion_a) - length(completion_b))::double as g from battles)"


def char_gap(b):
    return b.battles().withColumn("g", (F.length("completion_a") - F.length("completion_b")).cast("double"))


@query(f""", {_GAP}, t as (select count(*)::double as n, sum(g) as s, sum(g * g) as ss from lg)
select feature_id, round({pearson_sql("any_value(n)", "sum(sign(z))", "count(*)::double", "any_value(s)", "any_value(ss)", "sum(sign(z) * g)")}, 6) as corr
from zd join lg using (battle_id), t group by feature_id""")
def confound_corr(b):
    return rounded(relevance.confound_correlation(b.z_diff(), char_gap(b), "g"), "corr")


_SCREEN = f"""{_GAP}, fire as (select feature_id, sign(z) as s, 2 * human_pref - 1 as c, g from zd join lg using (battle_id)),
m as (select feature_id, count(*)::double as n, {pearson_sql("count(*)", "sum(s)", "sum(s * s)", "sum(c)", "sum(c * c)", "sum(s * c)")} as rsc,
{pearson_sql("count(*)", "sum(s)", "sum(s * s)", "sum(g)", "sum(g * g)", "sum(s * g)")} as rsg, {pearson_sql("count(*)", "sum(c)", "sum(c * c)", "sum(g)", "sum(g * g)", "sum(c * g)")} as rcg
from fire group by feature_id),
r as (select *, case when (1 - rsg * rsg) * (1 - rcg * rcg) > 1e-12 then (rsc - rsg * rcg) / sqrt((1 - rsg * rsg) * (1 - rcg * rcg)) end as rest from m)"""


@query(f", {_SCREEN} select feature_id, n::bigint as n_fire, round(rsc, 6) as corr, round(rsg, 6) as corr_len, round(rest, 6) as corr_resid, coalesce(abs(rsg) >= 0.3 and abs(rest) < 0.5 * abs(rsc), false) as entangled from r")
def bias_screen(b):
    return rounded(relevance.bias_screen(b.z_diff(), char_gap(b), "g"), "corr", "corr_len", "corr_resid")


@query("""select feature_id, round(sum(case when side = 1 then z else 0 end) / (select n from nb), 6) as mean_a, round(sum(case when side = -1 then z else 0 end) / (select n from nb), 6) as mean_b,
round(count_if(side = 1) / (select n from nb), 6) as fire_a, round(count_if(side = -1) / (select n from nb), 6) as fire_b, round(sum(z * side) / (select n from nb), 6) as mean_contrast,
round(sum(z * side * sign(human_pref - 0.5)) / (select count(*) from battles where human_pref <> 0.5), 6) as winner_contrast
from (select *, 1 as side from za union all select *, -1 from zb) q join battles using (battle_id) group by feature_id""")
def judge_side_means(b):
    out = relevance.side_means(b.z_side("a"), b.z_side("b"), b.battles())
    return rounded(out, "mean_a", "mean_b", "fire_a", "fire_b", "mean_contrast", "winner_contrast")


def welch_sql(n1, p1, q1, n2, p2, q2):
    m = lambda n, p, q: f"(({p}) - ({q})) / ({n})::double"
    v = lambda n, p, q: f"((({p}) + ({q})) - ({n}) * ({m(n, p, q)}) * ({m(n, p, q)})) / nullif(({n}) - 1, 0)"
    c = lambda n, p, q: f"(({p}) = ({n}) or ({q}) = ({n}) or ({p}) + ({q}) = 0)"
    return f"""case when ({n1}) >= 2 and ({n2}) >= 2 and not ({c(n1, p1, q1)} and {c(n2, p2, q2)}) then
    (({m(n1, p1, q1)}) - ({m(n2, p2, q2)})) / nullif(sqrt(({v(n1, p1, q1)}) / ({n1}) + ({v(n2, p2, q2)}) / ({n2})), 0) end"""


_REGION = f"""{_WINNER}, reg as (select dec.battle_id, coalesce(prompt_concept, -1) as cluster_id, half from dec join halves using (battle_id) left join pt using (battle_id)),
sz as (select cluster_id, count(*) as n, count_if(half = 0) as n0 from reg group by cluster_id), al as (select count(*) as n_all, count_if(half = 0) as n0_all from reg),
c as (select cluster_id, feature_id, count_if(z > 0) as p, count_if(z < 0) as q, count_if(z > 0 and half = 0) as p0, count_if(z < 0 and half = 0) as q0 from wz join reg using (battle_id) group by all),
t as (select feature_id, sum(p) as pt_, sum(q) as qt_, sum(p0) as p0t, sum(q0) as q0t from c group by feature_id),
g as (select sz.cluster_id, t.feature_id, n, n0, n_all, n0_all, coalesce(p, 0) as p, coalesce(q, 0) as q, coalesce(p0, 0) as p0, coalesce(q0, 0) as q0, pt_, qt_, p0t, q0t
from sz cross join t cross join al left join c on c.cluster_id = sz.cluster_id and c.feature_id = t.feature_id),
w as (select *, (p - q) / n::double - ((pt_ - p) - (qt_ - q)) / nullif(n_all - n, 0)::double as delta, {welch_sql("n", "p", "q", "n_all - n", "pt_ - p", "qt_ - q")} as t,
(p0 - q0) / nullif(n0, 0)::double - ((p0t - p0) - (q0t - q0)) / nullif(n0_all - n0, 0)::double as d0,
((p - p0) - (q - q0)) / nullif(n - n0, 0)::double - (((pt_ - p) - (p0t - p0)) - ((qt_ - q) - (q0t - q0))) / nullif((n_all - n) - (n0_all - n0), 0)::double as d1 from g)"""


@query(f", {_REGION} select cluster_id, feature_id, round(delta, 6) as delta, round(t, 6) as welch_t, coalesce(sign(d0) * sign(d1) > 0, false) as stable from w where t is not null")
def region_contrast(b):
    return rounded(conditional.prompt_delta(b.z_diff(), b.battles(), b.prompt_types(), p_values=False), "delta", "welch_t")


# --- models ------------------------------------------------------------------------------------

_DIAG = f"""sz as (select self_model, count(*) as n from meta group by self_model), al as (select count(*) as n_all from meta),
c as (select self_model, feature_id, count_if(z > 0) as p, count_if(z < 0) as q, sum(abs(z)) as m, avg(win) as win_rate, avg(case when z > 0 then win end) as wm, avg(case when z < 0 then win end) as wl
from bk join meta using (row_id) group by all), t as (select feature_id, sum(p) as pt_, sum(q) as qt_ from c group by feature_id),
d as (select c.*, sz.n, n_all, pt_, qt_ from c join sz using (self_model) join t using (feature_id), al)"""


@query(f""", {_DIAG} select self_model as model, feature_id, n::bigint as n, round((p + q) / n, 6) as fire_rate, round(p / n, 6) as self_more_rate, round(q / n, 6) as self_less_rate,
round((p - q) / n, 6) as net_direction, round(m / n, 6) as mean_abs_z, round(win_rate, 6) as win_rate, round(wm, 6) as win_rate_self_more, round(wl, 6) as win_rate_self_less, round(wm - wl, 6) as outcome_assoc from d""")
def diagnose_features(b):
    out = diagnose.per_model(b.meta(), b.bank_codes())
    cols = ["fire_rate", "self_more_rate", "self_less_rate", "net_direction", "mean_abs_z", "win_rate", "win_rate_self_more", "win_rate_self_less", "outcome_assoc"]
    return rounded(out, *cols).select("model", "feature_id", "n", *cols)


@query(f""", {_DIAG} select self_model as model, feature_id, round(((pt_ - p) - (qt_ - q)) / nullif(n_all - n, 0)::double, 6) as net_direction_pool,
round((p - q) / n - ((pt_ - p) - (qt_ - q)) / nullif(n_all - n, 0)::double, 6) as delta_vs_pool, round({welch_sql("n", "p", "q", "n_all - n", "pt_ - p", "qt_ - q")}, 6) as welch_t from d""")
def diagnose_pool_contrast(b):
    out = diagnose.per_model(b.meta(), b.bank_codes())
    return rounded(out, "net_direction_pool", "delta_vs_pool", "welch_t").select("model", "feature_id", "net_direction_pool", "delta_vs_pool", "welch_t")


@query("""select model, feature_id, round(k / n, 6) as fire_rate, n::bigint as n from (select model, feature_id, count(*) as k from (select model_a as model, feature_id from za join battles using (battle_id)
union all select model_b, feature_id from zb join battles using (battle_id)) q group by all) x join (select model, count(*) as n from (select unnest([model_a, model_b]) as model from battles) q group by model) y using (model)""")
def absolute_fire_rate(b):
    return rounded(diagnose.absolute_fire_rate(b.battles(), b.z_side("a"), b.z_side("b")), "fire_rate")


@query("""select lo, hi, feature_id, count_if(first)::bigint as bpos, count_if(not first)::bigint as cpos, any_value(n_shared)::bigint as n_shared from (
select least(model_a, model_b) as lo, greatest(model_a, model_b) as hi, feature_id, (a = 1) = (model_a < model_b) as first from (
select battle_id, feature_id, max(a) as a, max(b) as b from (select battle_id, feature_id, 1 as a, 0 as b from za union all select battle_id, feature_id, 0, 1 from zb) u group by all) f
join battles using (battle_id) where a <> b and model_a <> model_b) g join (
select least(model_a, model_b) as lo, greatest(model_a, model_b) as hi, count(*) as n_shared from battles where model_a <> model_b group by all having count(*) >= 2) s using (lo, hi) group by lo, hi, feature_id""")
def head_to_head(b):
    return diagnose.head_to_head(b.battles(), b.z_side("a"), b.z_side("b"), min_shared=2)


@query("""select least(model_a, model_b) as lo, greatest(model_a, model_b) as hi, count(*)::bigint as n, sum(case when model_a <= model_b then human_pref else 1 - human_pref end) as wins_lo,
count(human_pref)::bigint as n_labelled from battles group by all""")
def model_battle_graph(b):
    return diagnose.battle_graph(b.battles())


@query("select self_model as model, count(*)::bigint as n, round(avg(win), 6) as win_rate from meta group by self_model")
def model_power(b):
    return rounded(diagnose.power(b.meta()), "win_rate")


# --- pairs of features -------------------------------------------------------------------------


def association_sql(x, y, n, scale, support, cooccur, key):
    return f"""nx as (select feature_id as prompt_feature, count(*)::double as n_x from {x} group by all having count(*) >= {support}),
    ny as (select feature_id as completion_feature, count(*)::double as n_y from {y} group by all),
    cell as (select x.feature_id as prompt_feature, y.feature_id as completion_feature, count(*)::double as a from {x} x join {y} y using ({key}) group by all having count(*) >= {cooccur}),
    assoc as (select *, n_x - a as b_, n_y - a as c_, {n} - n_x - n_y + a as d_ from cell join nx using (prompt_feature) join ny using (completion_feature)),
    edge as (select prompt_feature, completion_feature, n_x::bigint as n_x, n_y::bigint as n_y, a::bigint as n_cooccur, round(n_y / {n}, 6) as p_y, round(a / n_x, 6) as p_y_given_x,
    round((a / n_x) / (n_y / {n}), 6) as lift, round({scale} * case when n_x * n_y * ({n} - n_x) * ({n} - n_y) > 0 then
    {n} * greatest(abs(a * d_ - b_ * c_) - {n} / 2, 0) ** 2 / (n_x * n_y * ({n} - n_x) * ({n} - n_y)) else 0 end, 6) as chi2, round(log2(greatest((a / n_x) / (n_y / {n}), 1e-6)), 6) as log2_lift from assoc)"""


_EDGES = f"""xp as (select concat(battle_id, s) as row_id, feature_id from zp, (select unnest(['|a', '|b']) as s) q), yr as (select concat(battle_id, '|a') as row_id, feature_id from za
union all select concat(battle_id, '|b'), feature_id from zb), {association_sql("xp", "yr", "(2.0::double * (select n from nb))", "0.5", 10, 2, "row_id")}"""


def edges(b):
    out = elicit.elicitation(b.z_prompt(), b.z_side("a"), b.z_side("b"), b.battles().count(), min_support=10, min_cooccur=2, p_values=False)
    return rounded(out, "p_y", "p_y_given_x", "lift", "chi2", "log2_lift")


@query(f", {_EDGES} select * from edge")
def elicitation(b):
    return edges(b)


@query(f""", {association_sql("zp", "zp", "((select n from nb)::double)", "1.0", 10, 2, "battle_id")} select * from edge where prompt_feature < completion_feature""")
def coactivation(b):
    out = elicit.coactivation(b.z_prompt(), b.battles().count(), min_support=10, min_cooccur=2, p_values=False)
    return rounded(out, "p_y", "p_y_given_x", "lift", "chi2", "log2_lift")


@query(f""", {_EDGES}, rk as (select *, row_number() over (partition by completion_feature order by abs(log2_lift) desc, prompt_feature) as ry,
row_number() over (partition by prompt_feature order by abs(log2_lift) desc, completion_feature) as rx from edge) select * exclude (rx, ry) from rk where ry <= 3 or rx <= 5""")
def edge_cap(b):
    return elicit.best_edges(edges(b), 3, 5)


@query(f", {_EDGES} select completion_feature as feature_id, count(distinct case when lift > 1.1 then prompt_feature end)::bigint as n_prompt_types from edge group by all")
def feature_prompt_types(b):
    return elicit.prompt_type_counts(edges(b), 1.1)


_GRID = f"""mg as (select feature_id, count(*)::double as n, sum(z) as s, sum(z * z) as ss from zd group by feature_id),
ps as (select a.feature_id as x, b.feature_id as y, count(*)::double as n11, sum(a.z * b.z) as zz from zd a join zd b using (battle_id) where a.feature_id < b.feature_id group by all),
grid as (select a.feature_id as x, b.feature_id as y, a.n as nx, b.n as ny, a.s as sx, b.s as sy, a.ss as sxx, b.ss as syy, coalesce(n11, 0) as n11, coalesce(zz, 0) as zz, (select n from nb)::double as n
from mg a join mg b on a.feature_id < b.feature_id left join ps on ps.x = a.feature_id and ps.y = b.feature_id)"""


def mi_term(j, a, c):
    return f"case when ({j}) > 0 then ({j}) / n * ln(({j}) * n / (({a}) * ({c}))) else 0 end"


@query(f""", {_GRID} select x, y, round({mi_term("n11", "nx", "ny")} + {mi_term("nx - n11", "nx", "n - ny")} + {mi_term("ny - n11", "n - nx", "ny")} + {mi_term("n - nx - ny + n11", "n - nx", "n - ny")}, 6) as mi from grid""")
def feature_mi(b):
    return rounded(elicit.mutual_information(b.z_diff(), b.battles().count()), "mi")


@query(f", {_GRID} select x, y, round(1 - abs(coalesce({pearson_sql('n', 'sx', 'sxx', 'sy', 'syy', 'zz')}, 0)), 6) as distance from grid")
def feature_distance(b):
    return rounded(elicit.distance(b.z_diff(), b.battles().count()), "distance")


# --- by kind of prompt -------------------------------------------------------------------------


@query("select self_model as model, prompt_concept, round(avg(win), 6) as win_rate, count(*)::bigint as n from meta join pt using (battle_id) group by all having count(*) >= 2")
def prompt_type_winrates(b):
    return rounded(conditional.prompt_winrates(b.meta(), b.prompt_types(), min_battles=2), "win_rate")


@query("""select q.self_model as model, q.prompt_concept, feature_id as response_concept, round(wk / k - (w - wk) / (n - k), 6) as delta_win, k::bigint as n from (
select self_model, prompt_concept, feature_id, count(*) as k, sum(win) as wk from bk join meta using (row_id) join pt using (battle_id) where z > 0 group by all) q join (
select self_model, prompt_concept, count(*) as n, sum(win) as w from meta join pt using (battle_id) group by all) t on q.self_model = t.self_model and q.prompt_concept = t.prompt_concept
where k >= 1 and n - k >= 1""")
def prompt_response_edges(b):
    return rounded(conditional.prompt_edges(b.meta(), b.prompt_types(), b.bank_codes(), min_support=1, top=None), "delta_win")


_PREV = """dr as (select battle_id, human_pref, prompt_concept from battles join pt using (battle_id) where human_pref <> 0.5), dn as (select prompt_concept, count(*) as n from dr group by all),
pv0 as (select prompt_concept, feature_id, count_if((side = 1) = (human_pref > 0.5)) as kw, count_if((side = 1) <> (human_pref > 0.5)) as kl
from (select battle_id, feature_id, 1 as side from za union all select battle_id, feature_id, 0 from zb) q join dr using (battle_id) group by all),
pv as (select prompt_concept, feature_id, n as n_win, kw / n as p_win, kl / n as p_lose, (kw / n + 1.96 * 1.96 / (2.0 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 / (1 + 1.96 * 1.96 / n)
* sqrt((kw / n) * (1 - kw / n) / n + 1.96 * 1.96 / (4.0 * n * n)) as lb from pv0 join dn using (prompt_concept))"""


@query(f", {_PREV} select prompt_concept, feature_id, n_win::bigint as n_win, round(p_win, 6) as p_win, round(p_lose, 6) as p_lose, round(lb::double, 6) as p_win_wilson_lb from pv")
def winning_prevalence(b):
    out = conditional.winning_prevalence(b.z_side("a"), b.z_side("b"), b.battles(), b.prompt_types())
    return rounded(out, "p_win", "p_lose", "p_win_wilson_lb")


@query(f""", {_PREV} select count(*)::bigint as n_cells, round(quantile_cont(abs(p_win - p_lose), 0.5), 6) as median, round(quantile_cont(abs(p_win - p_lose), 0.9), 6) as p90, round(max(abs(p_win - p_lose)), 6) as max,
round(avg((abs(p_win - p_lose) > 0.05)::int), 6) as over_5pp, round(avg((abs(p_win - p_lose) > 0.1)::int), 6) as over_10pp from pv where n_win >= 2""")
def gap_stats(b):
    prevalence = conditional.winning_prevalence(b.z_side("a"), b.z_side("b"), b.battles(), b.prompt_types())
    return rounded(conditional.gap_stats(prevalence, 2), "median", "p90", "max", "over_5pp", "over_10pp")


def chi2_tail_sql(x):
    """Upper tail of chi-square with one degree of freedom: the series of the error function of sqrt(x / 2)."""
    series = f"list_sum(list_transform(range(0, 90), lambda k: (case when k % 2 = 0 then 1 else -1 end) * sqrt({x} / 2) ** (2 * k + 1) / (gamma(k + 1) * (2 * k + 1))))"
    return f"(case when {x} < 32 then 1 - 2 / sqrt(pi()) * {series} else 0 end)"


_OMISSIONS = f""", {_PREV},
sd as (select battle_id, model_a as model, 1 as is_a, human_pref as y from battles union all select battle_id, model_b, 0, 1 - human_pref from battles where model_a <> model_b),
rw as (select battle_id, model, is_a, case when y <> 0.5 then y end as win, prompt_concept, half from sd join pt using (battle_id) join halves using (battle_id)),
sz as (select model, prompt_concept, count(*) as n, count_if(half = 0) as n0, sum(win) as w, count(win) as nw from rw group by all having count(*) >= 3),
ff as (select battle_id, model, prompt_concept, is_a, half, win, feature_id, max((fired = is_a)::int) as own, max((fired <> is_a)::int) as opp
    from (select battle_id, feature_id, 1 as fired from za union all select battle_id, feature_id, 0 from zb) h join rw using (battle_id) group by all),
ct as (select model, prompt_concept, feature_id, sum(own) as own, sum(opp) as opp, sum(case when half = 0 then own else 0 end) as own0, sum(case when half = 0 then opp else 0 end) as opp0,
    count_if(own = 0 and opp = 1) as b01, count_if(own = 1 and opp = 0) as b10, sum(case when own = 1 then win end) as w1, count(case when own = 1 then win end) as nw1 from ff group by all),
cl as (select *, (opp - own)::double / n as short, (opp0 - own0)::double / nullif(n0, 0) as s0, ((opp - opp0) - (own - own0))::double / nullif(n - n0, 0) as s1,
    case when b01 + b10 > 0 then greatest(abs(b01 - b10) - 1, 0) ** 2 / (b01 + b10)::double else 0 end as chi2 from ct join sz using (model, prompt_concept) where opp >= 0.15 * n),
om as (select model, prompt_concept, feature_id, n, round(opp / n, 4) as expected, round(own / n, 4) as produced, round(short, 4) as shortfall, coalesce(sign(s0) * sign(s1) > 0 and short > 0, false) as stable,
    round(w1 / nullif(nw1, 0), 4) as won_when_fired, round((w - coalesce(w1, 0)) / nullif(nw - nw1, 0), 4) as won_when_not, round(p_win, 4) as p_win, round(p_lose, 4) as p_lose, round(lb::double, 4) as win_wilson_lb,
    coalesce(n_win, 0) as n_win, chi2, least({chi2_tail_sql("chi2")} * (select count(*) from cl), 1.0) as pb from cl left join pv using (prompt_concept, feature_id))
select model, prompt_concept, feature_id, n::bigint as n, expected, produced, shortfall, stable, won_when_fired, won_when_not, p_win, p_lose, win_wilson_lb, n_win::bigint as n_win,
round({chi2_tail_sql("chi2")}, 6) as mcnemar_p, round(pb, 6) as mcnemar_p_bonferroni, coalesce(win_wilson_lb >= 0.1 and p_win - p_lose >= 0 and n_win >= 2, false) as expected_norm,
stable and shortfall >= 0.05 and pb < 0.05 and coalesce(win_wilson_lb >= 0.1 and p_win - p_lose >= 0 and n_win >= 2, false) as flagged from om"""


@query(_OMISSIONS)
def omissions(b):
    kinds = b.spark.range(PROMPT_FEATURES).select(F.col("id").cast("int").alias("prompt_concept"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("feature_id"))
    out = conditional.omissions(b.z_side("a"), b.z_side("b"), b.battles(), b.prompt_types(), kinds, min_battles=3, min_norm=0.1, min_gap=0.0, min_wins=2)
    return rounded(out.drop("mcnemar_chi2"), "mcnemar_p", "mcnemar_p_bonferroni")


@query("select battle_id, feature_id % 8 as cluster_id, round(sum(z) / 8, 6) as z from zd group by all")
def cluster_scores(b):
    return rounded(conditional.cluster_scores(b.z_diff(), b.names().select("feature_id", "cluster_id")), "z")


# --- ranked examples ---------------------------------------------------------------------------


@query("select feature_id, rank::int as rank, battle_id, round(z, 6) as z from (select *, row_number() over (partition by feature_id order by abs(z) desc, battle_id) as rank from zd) q where rank <= 5")
def top_battles(b):
    return rounded(select.top_codes(b.z_diff(), 5), "z")


_SILENT = """od as (select battle_id, sha1(concat(battle_id, '|0')) as h from {pool}),
sl as (select feature_id, battle_id, row_number() over (partition by feature_id order by h, battle_id) as rank from od cross join (select distinct feature_id from zd join {pool} using (battle_id)) f
where not exists (select 1 from zd where zd.battle_id = od.battle_id and zd.feature_id = f.feature_id))"""


@query(f""", pool as (select battle_id from halves where b >= 200), {_SILENT.format(pool="pool")}
select feature_id, rank::int as rank, battle_id, round(z, 6) as z, 'active' as kind from (select *, row_number() over (partition by feature_id order by z desc, battle_id) as rank from zd join pool using (battle_id) where z > 0) q where rank <= 3
union all select feature_id, rank::int, battle_id, 0.0::double, 'silent' from sl where rank <= 3""")
def top_pairs(b):
    pool = b.battles().filter(~hashing.held_out("battle_id", 0.2)).select("battle_id")
    return rounded(select.naming_examples(b.z_diff(), pool, 3, 3), "z")


@query(f""", pool as (select battle_id from halves where b < 200), {_SILENT.format(pool="pool")}
select feature_id, bucket, rank::int as rank, battle_id, round(z, 6) as z from (select *, row_number() over (partition by feature_id, bucket order by abs(z) desc, battle_id) as rank
from (select *, case when z > 0 then 'pos' else 'neg' end as bucket from zd join pool using (battle_id)) q) r where rank <= 2
union all select feature_id, 'tie', rank::int, battle_id, 0.0::double from sl where rank <= 2""")
def holdout_buckets(b):
    pool = b.battles().filter(hashing.held_out("battle_id", 0.2)).select("battle_id")
    return rounded(select.holdout_buckets(b.z_diff(), pool, 2), "z")


@query("""select model, feature_id, battle_id, side, round(z, 6) as z, rank::int as rank, case win when 1 then 'win' when 0 then 'loss' when 0.5 then 'tie' else '?' end as outcome from (
select *, row_number() over (partition by model, feature_id order by z desc, battle_id, side) as rank from (
select model_a as model, feature_id, battle_id, 'a' as side, z, human_pref as win from za join battles using (battle_id)
union all select model_b, feature_id, battle_id, 'b', z, 1 - human_pref from zb join battles using (battle_id)) q) r where rank <= 2""")
def examples_by_model(b):
    return rounded(select.examples_by_model(b.battles(), b.z_side("a"), b.z_side("b"), 2), "z")


@query("""select battle_id, rank::int as rank, feature_id, concat('concept_', feature_id) as concept, round(z, 6) as z from (
select *, row_number() over (partition by battle_id order by abs(z) desc, feature_id) as rank from zd) q where rank <= 3""")
def top_concepts(b):
    return rounded(select.top_concepts(b.z_diff(), b.names(), 3), "z")


@query("""select self_model as model, prompt_concept, rank::int as rank, row_id, round(activation, 6) as activation, win from (
select *, row_number() over (partition by self_model, prompt_concept order by activation desc, row_id) as rank from meta join pt using (battle_id)) q where rank <= 2""")
def report_battles(b):
    return rounded(select.report_battles(b.meta(), b.prompt_types(), 2), "activation")


# --- text and judgments ------------------------------------------------------------------------


@query("""select conv_id, turn, case when upper(regexp_extract(text, '([A-Za-z]+)', 1)) = 'A' then 1 when upper(regexp_extract(text, '([A-Za-z]+)', 1)) = 'B' then -1
when upper(regexp_extract(text, '([A-Za-z]+)', 1)) = 'TIE' then 0 end as label,
case when length(text) > 120 then concat(substr(text, 1, 120), ' ...') else text end as clipped from conversations""", bridged=False)
def parse_labels(b):
    return b.turns().select("conv_id", "turn", text.parse_label(F.col("text")).alias("label"), text.clip(F.col("text"), 120).alias("clipped"))


#: Beginnings of replies that parsers have to tell apart.
_REPLIES = ("Yes, though parts are unclear", "No, it cannot be seen", "Not sure, yes maybe", "Nothing here", "I think yes", "Well, no", "Hard to say, cannot tell", "Present", "N/A", "...")


@query(f"""select doc_id, case when regexp_matches(t, '^(unclear|unsure|not sure|n/a|cannot|can''t|can not)') then null when regexp_matches(t, '^(yes|present)') then 1 when regexp_matches(t, '^(no|absent)') then 0
when regexp_matches(t, '\\b(unclear|unsure|not sure|cannot tell|can.?t tell)\\b') then null when regexp_matches(t, '\\byes\\b') then 1 when regexp_matches(t, '\\bno\\b') then 0 end as present
from (select doc_id, lower(concat(list_extract({list(_REPLIES)}, (doc_id % 10 + 1)::int), ': ', source)) as t from documents) q""", bridged=False)
def parse_presence(b):
    reply = F.concat(F.element_at(F.array(*[F.lit(x) for x in _REPLIES]), F.pmod("doc_id", F.lit(10)).cast("int") + 1), F.lit(": "), "source")
    return b.table("documents").select("doc_id", text.parse_presence(reply).alias("present"))


#: Replies of a naming model with what they say.
_NAMINGS = (
    ('{"status": "ok", "concept": "cites its sources", "confidence": "High"}', "ok", "cites its sources", "high"),
    ('{"status": "polysemantic", "concept": "two things", "confidence": "low"}', "polysemantic", "", "low"),
    ('{"status": "certain", "concept": "a new status", "confidence": "sure"}', "insufficient_evidence", "", ""),
    ("<<ERROR: request timed out>>", "insufficient_evidence", "", ""),
    ("Sure, A:", "insufficient_evidence", "", ""),
    ('<think>hm</think>- "uses numbered lists"', "ok", "uses numbered lists", ""),
    ('{"concept": "opens with praise"}', "ok", "opens with praise", ""),
    ('{"concept": "praise"}', "insufficient_evidence", "", ""),
    ("", "insufficient_evidence", "", ""),
    ("The examples differ.\nends with a question for the user", "ok", "ends with a question for the user", ""),
)


@query(f"""select doc_id, status, concept, confidence from documents join (values {", ".join(f"({i}, '{s}', '{c}', '{f}')" for i, (_, s, c, f) in enumerate(_NAMINGS))}) e(k, status, concept, confidence) on doc_id % 10 = k""", bridged=False)
def parse_concept_result(b):
    reply = F.element_at(F.array(*[F.lit(x[0]) for x in _NAMINGS]), F.pmod("doc_id", F.lit(10)).cast("int") + 1)

    def run(batches):
        for pdf in batches:
            got = [interpret.parse_result(r) for r in pdf["reply"]]
            yield pdf[["doc_id"]].assign(**{k: [g[k] for g in got] for k in ("status", "concept", "confidence")})

    return b.table("documents").select("doc_id", reply.alias("reply")).mapInPandas(run, "doc_id long, status string, concept string, confidence string")


@query("""select battle_id, source, human_pref from (select *, row_number() over (partition by battle_id order by frame) as r from (
select battle_id, 'plain' as source, null::double as human_pref, 0 as frame from battles where a_doc_id % 2 = 0 union all select battle_id, 'judged', human_pref, 1 from battles) q) s where r = 1""")
def merge_union(b):
    plain = b.battles().filter("a_doc_id % 2 = 0").select("battle_id", F.lit("plain").alias("source"))
    return corpus.merge([plain, b.battles().select("battle_id", F.lit("judged").alias("source"), "human_pref")])


@query()
def cluster_names(b):
    names = b.names()
    return interpret.name_clusters(names.select("feature_id", "cluster_id"), names.select("feature_id", "concept"), lambda qs: [f'{{"concept": "members {q.count("- ")} in all"}}' for q in qs])


@query("""select r.feature_id, concat('concept_', lead(feature_id, 1, first_id) over (order by h, feature_id)) as concept
from (select feature_id, sha1(concat(feature_id, '|0')) as h, first_value(feature_id) over (order by sha1(concat(feature_id, '|0')), feature_id) as first_id from dims) r""")
def shuffled_names(b):
    return interpret.shuffled_names(b.names().select("feature_id", "concept"))


@query("""select feature_id, concat('concept_', feature_id) as concept, case when feature_id % 2 = 0 then 'new' else 'old' end as origin from dims""")
def names_upsert(b):
    old = b.names().select("feature_id", "concept").withColumn("origin", F.lit("old"))
    return corpus.upsert(old, old.filter("feature_id % 2 = 0").withColumn("origin", F.lit("new")))


@query("""select n::bigint as n, k::bigint as k, round(case when n > 0 then (k / n + 1.9208 / n) / (1 + 3.8416 / n) - 1.96 / (1 + 3.8416 / n) * sqrt((k / n) * (1 - k / n) / n + 0.9604 / (n::double * n)) else 0 end::double, 6) as lb
from (select doc_id % 50 as n, (doc_id % 50) // 2 as k from documents) q""", bridged=False)
def wilson_lb(b):
    n = F.pmod("doc_id", F.lit(50))
    return b.table("documents").select(n.alias("n"), F.floor(n / 2).alias("k")).select("n", "k", F.round(S.wilson_lower(F.col("k"), F.col("n")), 6).alias("lb"))


@query(f""", mt as (select feature_id, sign(human_pref - 0.5)::int as truth, battle_id, z from zd join battles using (battle_id)),
j as (select feature_id, case when z > 0 then 1 else -1 end as truth, case when truth = 0 then null else truth end as label from mt),
k as (select feature_id, count(*) as n_all, count_if(label is not null) as n, count_if(label is not null and truth > 0) as np, count_if(label is not null and truth < 0) as nn, count_if(truth = label) as agree,
count_if(truth > 0 and label > 0) as tp, count_if(truth < 0 and label > 0) as fp, count_if(truth > 0 and label < 0) as fn,
{pearson_sql("count_if(label is not null)", "coalesce(sum(case when label is not null then truth end), 0)", "count_if(label is not null)::double", "coalesce(sum(label), 0)", "coalesce(sum(label * label), 0)::double", "coalesce(sum(label * truth), 0)")} as r from j group by feature_id)
select feature_id, n_all::bigint as n_attempted, n::bigint as n, np::bigint as n_pos_ok, nn::bigint as n_neg_ok, round(agree / nullif(n, 0), 6) as agreement, round(tp / nullif(tp + fp, 0), 6) as precision,
round(tp / nullif(tp + fn, 0), 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1, round(r, 6) as correlation from k""")
def pairwise_metrics(b):
    y = F.signum(F.col("human_pref") - 0.5).cast("int")
    judged = b.z_diff().join(b.battles().select("battle_id", "human_pref"), "battle_id").select(
        "feature_id", F.when(F.col("z") > 0, 1).otherwise(-1).alias("truth"), F.when(y != 0, y).alias("label")
    )
    out = interpret.pairwise_metrics(judged).select("feature_id", "n_attempted", "n", "n_pos_ok", "n_neg_ok", "agreement", "precision", "recall", "f1", "correlation")
    return rounded(out, "agreement", "precision", "recall", "f1", "correlation")


@query(f""", {_DIAG}, wr as (select feature_id, avg(case when z > 0 then human_pref end) - avg(case when z < 0 then human_pref end) as w from zd join battles using (battle_id) group by feature_id)
select self_model as model, any_value(n)::bigint as n_battles, round(sum((p - q) / n * coalesce(w, 0)), 6) as predicted_score, round((select avg(win) from meta m where m.self_model = d.self_model), 6) as actual_win_rate
from d join wr using (feature_id) group by self_model""")
def validate_scores(b):
    weight = validate.weights(relevance.win_relevance(b.z_diff(), b.battles(), p_values=False), "win_assoc")
    return rounded(validate.model_scores(b.meta(), b.bank_codes(), weight, 1), "predicted_score", "actual_win_rate")


@query("""select feature_id % 8 as cluster_id, count(*)::bigint as n_features, count_if(feature_id % 3 <> 0)::bigint as n_verified,
concat('concept_', min(feature_id) filter (where feature_id % 3 <> 0)) as behavior, string_agg(feature_id::varchar, ',' order by feature_id) as feature_ids,
string_agg(concat('concept_', feature_id), ' | ' order by feature_id) as member_concepts from dims group by all""")
def cluster_summary(b):
    names = b.names()
    return cluster.summarize(names.select("feature_id", "cluster_id"), names.drop("cluster_id"))


@query()
def win_relevance_logistic(b):
    return rounded(logistic.controlled(b.z_diff(), b.battles().join(codes.oriented(b.battles()).filter("orientation = 'a'").select("battle_id", "length"), "battle_id")), "beta", "delta_win_rate", "lr_chi2", "lr_p", "p_bonferroni")


def with_length(b):
    return b.battles().join(codes.oriented(b.battles()).filter("orientation = 'a'").select("battle_id", "length"), "battle_id")


@query()
def conditional_win_relevance(b):
    return logistic.conditional(b.z_diff(), with_length(b), b.prompt_types(), min_battles=10, min_fire=2)


@query()
def language_win_relevance(b):
    return logistic.by_language(b.z_diff(), with_length(b), min_battles=20)


@query()
def cluster_win_relevance(b):
    return logistic.by_cluster(b.z_diff(), with_length(b), b.names().select("feature_id", "cluster_id"))


@query()
def cluster_features(b):
    return cluster.cluster_features(b.z_diff(), b.battles().count(), "mi-leiden")


@query()
def kmeans_examples(b):
    vectors = b.vectors().select("vec_id", F.col("e").alias("vector"))
    return cluster.cluster_examples(vectors, k=8).select("vec_id", "cluster_id")


@query()
def evaluate_preference(b):
    got = validate.evaluate_preference(b.z_diff(), b.battles(), 64)
    return b.spark.createDataFrame([(k, float(v)) for k, v in got.items()], "metric string, value double")


def horner(h):
    """A SHA-1 digest as a number, modulo 1000, in SQL."""
    out = "0"
    for i in range(5):
        out = f"(({out} * 296 + ('0x' || substr({h}, {1 + 8 * i}, 8))::bigint) % 1000)"
    return out


@query(f""", sp as (select i, battle_id, sha1(concat(battle_id, '|', i)) as h from battles, (select unnest(range(0, 5)) as i) q),
sb as (select i, battle_id, {horner("h")} % 2 as part from sp),
su as (select i, feature_id, sum(case when part = 0 then sign(z) else 0 end) as a, sum(case when part = 1 then sign(z) else 0 end) as b from zd join sb using (battle_id) group by all),
rk as (select i, rank() over (partition by i order by a) + (count(*) over (partition by i, a) - 1) / 2 as ra, rank() over (partition by i order by b) + (count(*) over (partition by i, b) - 1) / 2 as rb from su)
select i::int as split, round(corr(ra, rb), 6) as spearman from rk group by i""")
def split_reliability(b):
    return rounded(validate.split_reliability(b.z_diff(), b.battles()), "spearman")


@query()
def pca_map(b):
    return export.project2d(b.vectors().select("vec_id", F.col("e").alias("vector"))).select("vec_id", "x", "y")


@query(f""", {_GRID}, al as (select count(distinct feature_id) as alive, count(*) as nnz from zd), pr as (select
sum({mi_term("n11", "nx", "ny")} + {mi_term("nx - n11", "nx", "n - ny")} + {mi_term("ny - n11", "n - nx", "ny")} + {mi_term("n - nx - ny + n11", "n - nx", "n - ny")}) as mi,
sum(abs(coalesce({pearson_sql('n', 'sx', 'sxx', 'sy', 'syy', 'zz')}, 0))) as r from grid)
select round(1 - alive / 64, 6) as dead_frac, round(nnz / (select n from nb), 6) as l0_mean, round(coalesce(mi, 0) / 2016, 6) as redundancy_mi_mean, round(coalesce(r, 0) / 2016, 6) as redundancy_abscorr_mean from al, pr""")
def lens_metrics(b):
    return rounded(elicit.lens_metrics(b.z_diff(), b.battles(), 64), "dead_frac", "l0_mean", "redundancy_mi_mean", "redundancy_abscorr_mean")


@query("""select vec_id, feature_id, round(e[feature_id + 1], 6) as z from emb, dims where abs(e[feature_id + 1]) > 0.15""")
def lens_encode(b):
    vectors = b.vectors().select("vec_id", F.col("e").alias("vector"))
    return rounded(lens.encode(vectors, lens.Lens.identity(64, 0.15), key="vec_id"), "z")


_PRE = """, pre as (select vec_id, feature_id, 0.5::double * (e[feature_id + 1] - 0.01) + 0.25::double * (e[(feature_id + 1) % 64 + 1] - 0.01) + feature_id * 0.001::double as z from emb, dims)"""


def mixing_lens(rule, threshold=0.0):
    """Each code reads two entries and has a bias of its own."""
    eye = np.eye(64)
    return lens.Lens(0.5 * eye + 0.25 * np.roll(eye, 1, axis=1), np.arange(64) * 0.001, eye, np.full(64, 0.01), rule, threshold, 8)


@query(_PRE + " select vec_id, feature_id, round(z, 6) as z from pre where z > 0.1")
def lens_encode_jump(b):
    vectors = b.vectors().select("vec_id", F.col("e").alias("vector"))
    return rounded(lens.encode(vectors, mixing_lens("jump", np.full(64, np.log(0.1))), key="vec_id"), "z")


@query(_PRE + " select vec_id, feature_id, round(z, 6) as z from (select *, row_number() over (partition by vec_id order by abs(z) desc) as r from pre) q where r <= 8")
def lens_encode_topk(b):
    vectors = b.vectors().select("vec_id", F.col("e").alias("vector"))
    return rounded(lens.encode(vectors, mixing_lens("topk"), key="vec_id"), "z")


@query(""", h as (select feature_id, count(*) as n from zp group by all) select feature_id, 'ok' as status, concat('seen in ', least(3, k)::varchar, ' examples') as concept, 'high' as confidence,
round(n::double / (select n from nb), 6) as fire_rate from h join (select feature_id, count_if(b >= 200) as k from zp join halves using (battle_id) group by all) q using (feature_id) where k > 0""")
def prompt_names(b):
    def ask(requests):
        return [f'{{"status": "ok", "concept": "seen in {r.count(chr(60) + "example kind=" + chr(34) + "active")} examples", "confidence": "high"}}' for r in requests]

    found = modes.Interpreter("single-text", n_active=3, n_zero=0).name(b.with_prompts(), b.z_prompt(), ask)
    return rounded(found, "fire_rate")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)


__all__ = ["oracle_sql", "queries", "schema"]
