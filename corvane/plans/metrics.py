"""Queries over vectors: encoders' arithmetic, distances, calibration, PCA, ridge, monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import gram, linalg, mmd, vectors
from corvane.operators.quantiles import quantiles
from corvane.registry import query
from corvane.sources.shared import cut, scratch, stored
from corvane.sources.tables import spread, table

from . import sqltext as S

WIDTH = 64
E_SQL = "(select vec_id, label, embedding::double[] as v from embeddings)"
PLACES = 8
#: A projection of fixed entries, from 64 numbers to 8.
PROJECTION = [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(WIDTH)] for i in range(8)]
BIAS = [i / 10 for i in range(8)]


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _sampled(where: str, seed: int = 17) -> str:
    return f"(select * from (select *, row_number() over (order by sha256('{seed}:' || vec_id)) as k from {E_SQL} where {where}) where k <= {mmd.BANDWIDTH_ROWS})"


def _sigma(where: str, seed: int = 17) -> str:
    return f"(select median(d) from (select list_distance(a.v, b.v) as d from {_sampled(where, seed)} a join {_sampled(where, seed)} b on a.vec_id < b.vec_id) where d > 0)"


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", "v", F.when(F.col("label") < 5, "g").otherwise("r").alias("side"))


_SUMS = f"with s as (select {_sigma('label >= 5')} as sigma), e as (select vec_id, v, case when label < 5 then 'g' else 'r' end as side from {E_SQL}), k as (select a.side as x, b.side as y, sum(exp(-(list_distance(a.v, b.v) ** 2) / (2 * sigma * sigma))) as t from e a, e b, s group by 1, 2), c as (select count(*) filter (where side = 'g') as n, count(*) filter (where side = 'r') as m from e), p as (select max(t) filter (where x = 'g' and y = 'g') as gg, max(t) filter (where x = 'r' and y = 'r') as rr, max(t) filter (where x = 'g' and y = 'r') as gr from k)"


def _mmd(spark: SparkSession, sf_dir: str, unbiased: bool) -> DataFrame:
    rows = _sides(spark, sf_dir)
    sigma = mmd.median_bandwidth(rows.where("side = 'r'"), "vec_id", "v")
    out = mmd.squared_mmd(mmd.kernel_sums(rows, rows, "side", "vec_id", "v", sigma), "g", "r", unbiased)
    return out.select(F.lit(round(sigma, PLACES)).alias("bandwidth"), F.col("n_a").alias("n_generated"), F.col("n_b").alias("n_reference"), F.round("mmd2", PLACES).alias("mmd2"))


@query(f"{_SUMS} select round(sigma, {PLACES}) as bandwidth, n as n_generated, m as n_reference, round(gg / (n * n) + rr / (m * m) - 2 * gr / (n * m), {PLACES}) as mmd2 from p, c, s")
def mmd_biased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mmd(spark, sf_dir, False)


@query(f"{_SUMS} select round(sigma, {PLACES}) as bandwidth, n as n_generated, m as n_reference, round((gg - n) / (n * (n - 1)) + (rr - m) / (m * (m - 1)) - 2 * gr / (n * m), {PLACES}) as mmd2 from p, c, s")
def mmd_unbiased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mmd(spark, sf_dir, True)


@query(f"select round({_sigma('true')}, {PLACES}) as bandwidth, least(count(*), {mmd.BANDWIDTH_ROWS}) as n_rows from embeddings")
def median_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    sigma = mmd.median_bandwidth(rows, "vec_id", "v")
    return rows.agg(F.lit(round(sigma, PLACES)).alias("bandwidth"), F.least(F.count("*"), F.lit(mmd.BANDWIDTH_ROWS)).alias("n_rows"))


DRAWS = 8


@query(
    _SUMS.replace("with s as", "with recursive s as")
    + f""", d as (select draw, side, vec_id, v from (select draw, sd as side, vec_id, v, row_number() over (partition by draw, sd order by sha256('17:' || draw || ':' || sd || ':' || vec_id), vec_id) as k from (select vec_id, v from e where side = 'r'), (select unnest(range(0, {DRAWS})) as draw), (select unnest(['l', 'r']) as sd)), c where k <= least(n, m, m // 2)),
    q as (select vec_id as a_id, v from e where side = 'r'), kk as (select a.a_id as i, b.a_id as j, exp(-(list_distance(a.v, b.v) ** 2) / (2 * sigma * sigma)) as kv from q a, q b, s),
    nv as (select a.draw, sum(case when a.side = b.side then kv else -kv end) / (least(n, m, m // 2) ** 2) as x from d a join d b on a.draw = b.draw join kk on kk.i = a.vec_id and kk.j = b.vec_id, c group by a.draw, n, m),
    nn as (select avg(x) as mu, stddev_pop(x) as sd from nv)
    select round(gg / (n * n) + rr / (m * m) - 2 * gr / (n * m), {PLACES}) as raw_mmd, round(sigma, {PLACES}) as bandwidth, n as n_generated, m as n_reference, round((gg / (n * n) + rr / (m * m) - 2 * gr / (n * m) - mu) / greatest(sd, 1e-12), 4) as z_score, round(mu, {PLACES}) as null_mean, round(sd, {PLACES}) as null_std from p, c, s, nn"""
)
def null_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sides(spark, sf_dir)
    out = mmd.score(rows.where("side = 'g'"), rows.where("side = 'r'"), "vec_id", "v", draws=DRAWS)
    r = lambda c, p=PLACES: F.round(c, p).alias(c)
    return out.select(r("raw_mmd"), r("bandwidth"), "n_generated", "n_reference", r("z_score", 4), r("null_mean"), r("null_std"))


_DECOMPOSED = f"with s as (select {_sigma('label >= 5', 0)} as sigma), e as (select * from {E_SQL}), w as (select a.label, count(distinct a.vec_id) as n, avg(exp(-(list_distance(a.v, b.v) ** 2) / (2 * sigma * sigma))) as kbb from e a join e b on a.label = b.label, s group by a.label), x as (select b.label, avg(exp(-(list_distance(a.v, b.v) ** 2) / (2 * sigma * sigma))) as kab from e a, e b, s where a.label >= 5 group by b.label) select label, n, round(sigma, {PLACES}) as bandwidth, round(kbb, {PLACES}) as kbb, round(kab, {PLACES}) as kab from w join x using (label), s"


@query(_DECOMPOSED)
def pool_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    out = linalg.decomposition(rows.where("label >= 5"), rows, "label", "vec_id", "v")
    return out.select("label", "n", *(F.round(c, PLACES).alias(c) for c in ("bandwidth", "kbb", "kab")))


@query(f"select label % 2 as part, count(*) as n_pools, round(avg(kbb), 6) as kbb, round(avg(kab), 6) as kab from ({_DECOMPOSED}) group by label % 2")
def decomposition_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over pools of even and of odd labels."""
    rows = embeddings(spark, sf_dir)
    out = linalg.decomposition(rows.where("label >= 5"), rows, "label", "vec_id", "v").withColumn("part", F.col("label") % 2)
    return linalg.group_means(out, "part").select("part", "n_pools", *(F.round(c, 6).alias(c) for c in ("kbb", "kab")))


@query(
    f"with t as (select label < 5 as g, i, x from (select label, unnest(v) as x, generate_subscripts(v, 1) as i from {E_SQL})), m as (select i, avg(x) filter (where g) as a, avg(x) filter (where not g) as b, var_samp(x) filter (where g) as va, var_samp(x) filter (where not g) as vb from t group by i) select round(sum((a - b) ** 2), {PLACES}) as mean_term, round(sum(va), {PLACES}) as trace_a, round(sum(vb), {PLACES}) as trace_b from m"
)
def frechet_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).select("label", F.posexplode("v").alias("i", "x")).withColumn("g", F.col("label") < 5)
    a, b = F.when(F.col("g"), F.col("x")), F.when(~F.col("g"), F.col("x"))
    each = rows.groupBy("i").agg(F.avg(a).alias("a"), F.avg(b).alias("b"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    return each.agg(F.round(F.sum((F.col("a") - F.col("b")) ** 2), PLACES).alias("mean_term"), F.round(F.sum("va"), PLACES).alias("trace_a"), F.round(F.sum("vb"), PLACES).alias("trace_b"))


@query(f"with t as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) - 1 as i from {E_SQL}) select a.i::int as i, b.i::int as j, round(sum(a.x * b.x), 6) as value from t a join t b on a.vec_id = b.vec_id and a.i <= b.i group by all")
def gram_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over all rows of the products of two columns, from blocks of 24 columns."""
    return gram.entries(embeddings(spark, sf_dir), "v", WIDTH, block=24).select("i", "j", F.round("value", 6).alias("value"))


@query()
def frechet_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the cross term, for which SQL has no eigenvectors."""
    rows = embeddings(spark, sf_dir)
    d = mmd.frechet(rows.where("label < 5"), rows.where("label >= 5"), "v", WIDTH)
    return spark.createDataFrame([tuple(d.values())], ", ".join(f"{k} double" for k in d))


@query(f"select vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), {PLACES}) as norm, round(v[1] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12), {PLACES}) as first, round(v[64] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12), {PLACES}) as last from {E_SQL}")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).select("vec_id", vectors.l2(F.col("v")).alias("norm"), vectors.l2_normalize(F.col("v")).alias("u"))
    return rows.select("vec_id", F.round("norm", PLACES).alias("norm"), F.round(F.get("u", F.lit(0)), PLACES).alias("first"), F.round(F.get("u", F.lit(63)), PLACES).alias("last"))


@query(f"select vec_id, i as dim, round(list_dot_product(v, {PROJECTION}[i + 1]::double[]) + {BIAS}[i + 1], 6) as y from {E_SQL}, (select unnest(range(0, 8)) as i)")
def linear_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).select("vec_id", F.posexplode(vectors.project(F.col("v"), PROJECTION, BIAS)).alias("dim", "y"))
    return rows.select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("y", 6).alias("y"))


_HALF = "list_transform(v[{a}:{b}], lambda x: x / greatest(sqrt(list_sum(list_transform(v[{a}:{b}], lambda y: y * y))), 1e-12))"


@query(f"with u as (select vec_id, {_HALF.format(a=1, b=32)} as a, {_HALF.format(a=33, b=64)} as b from {E_SQL}) select vec_id, len(a) + len(b) as n, round(list_sum(a) + list_sum(b), {PLACES}) as total, round((a[1] + b[1]) / 2, {PLACES}) as mean_first from u")
def multi_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves as views, one after the other and as a mean."""
    parts = [F.slice("v", 1, 32), F.slice("v", 33, 32)]
    rows = embeddings(spark, sf_dir).select("vec_id", vectors.views(parts, "concat").alias("c"), vectors.views(parts, "mean").alias("m"))
    return rows.select("vec_id", F.size("c").cast("long").alias("n"), F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), PLACES).alias("total"), F.round(F.get("m", F.lit(0)), PLACES).alias("mean_first"))


@query(f"select vec_id, round(list_sum(list_transform(range(0, 8), lambda i: case when (vec_id >> i) & 1 = 1 then v[i * 8 + 1] else 0 end)) / greatest(bit_count(vec_id & 255), 1), {PLACES}) as first, round(list_sum(list_transform(range(0, 64), lambda k: case when (vec_id >> (k // 8)) & 1 = 1 then v[k + 1] else 0 end)) / greatest(bit_count(vec_id & 255), 1), {PLACES}) as total from {E_SQL}")
def pooled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight states of eight numbers as their mean under a mask."""
    states = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.floor(F.col("vec_id") / F.pow(F.lit(2), i)) % 2).cast("int"))
    rows = embeddings(spark, sf_dir).select("vec_id", vectors.masked_mean(states, mask).alias("m"))
    return rows.select("vec_id", F.round(F.get("m", F.lit(0)), PLACES).alias("first"), F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), PLACES).alias("total"))


_PAIR = "select a.vec_id, a.v as s, b.v as t from {e} a join {e} b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0"


@query(
    f"with p as ({_PAIR.format(e=E_SQL)}), u as (select vec_id, list_transform(s, lambda x: x / (sqrt(list_sum(list_transform(s, lambda y: y * y))) + 1e-9)) as s, list_transform(t, lambda x: x / (sqrt(list_sum(list_transform(t, lambda y: y * y))) + 1e-9)) as t from p), c as (select list_dot_product(s, t) as c from u), x as (select avg(list_dot_product(a.s, b.s)) as ps, avg(list_dot_product(a.t, b.t)) as pt from u a join u b on a.vec_id < b.vec_id) select round(avg(c), 6) as cos, round(quantile_cont(c, 0.1), 6) as cos_p10, round(any_value(ps), 6) as pair_student, round(any_value(pt), 6) as pair_teacher from c, x"
)
def pairwise_cosine_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Student rows (even ids) against teacher rows (the next id). The mean over all pairs comes from the sum of all unit vectors, not from pairs."""
    e = embeddings(spark, sf_dir)
    unit = lambda c: F.transform(c, lambda x: x / (vectors.l2(F.col(c)) + 1e-9))
    rows = e.where("vec_id % 2 = 0").select("vec_id", F.col("v").alias("s")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("t")), "vec_id").select("vec_id", unit("s").alias("s"), unit("t").alias("t"))
    rows = cut(rows)
    c = rows.select(F.lit(0).alias("all"), vectors.dot(F.col("s"), F.col("t")).alias("c"))
    cos = c.agg(F.avg("c").alias("cos")).crossJoin(quantiles(c, "all", "c", {"cos_p10": 0.1}).select("cos_p10"))  # a row each

    def mean_pair(c: str, name: str) -> DataFrame:
        sums = rows.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
        return sums.agg(((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / (F.max("n") * (F.max("n") - 1))).alias(name))

    return cos.crossJoin(mean_pair("s", "pair_student")).crossJoin(mean_pair("t", "pair_teacher")).select(*(F.round(c, 6).alias(c) for c in ("cos", "cos_p10", "pair_student", "pair_teacher")))


@query(
    f"with p as ({_PAIR.format(e=E_SQL)}), x as (select unnest(s) as s, unnest(t) as t, generate_subscripts(s, 1) as i from p), d as (select i, var_pop(t) as v, avg((s - t) ** 2) as m, avg(s - t) as b, regr_r2(t, s) as r from x group by i), w as (select *, (1 / v) / (avg(1 / v) over ()) as wt from d) select round(avg(m) / avg(v), 6) as relative_mse, round(avg(m * wt) / avg(v), 6) as whitened_mse, round(1 - sum(m) / sum(v), 6) as r2, round(avg(v), {PLACES}) as target_var from w"
)
def relative_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    rows = e.where("vec_id % 2 = 0").select("vec_id", F.col("v").alias("s")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("t")), "vec_id")
    flat = rows.select(F.posexplode(F.arrays_zip("s", "t")).alias("i", "x")).select("i", "x.s", "x.t")
    each = flat.groupBy("i").agg(F.var_pop("t").alias("v"), F.avg((F.col("s") - F.col("t")) ** 2).alias("m"))
    mean = each.agg(F.avg(1 / F.col("v")).alias("mi"))
    told = each.crossJoin(mean).withColumn("wt", (1 / F.col("v")) / F.col("mi"))
    return told.agg(F.round(F.avg("m") / F.avg("v"), 6).alias("relative_mse"), F.round(F.avg(F.col("m") * F.col("wt")) / F.avg("v"), 6).alias("whitened_mse"), F.round(1 - F.sum("m") / F.sum("v"), 6).alias("r2"), F.round(F.avg("v"), PLACES).alias("target_var"))


@query()
def pca_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retained variance of 16 components, and the variance that projected rows show; signs and order of eigenvectors aren't SQL's."""
    rows = embeddings(spark, sf_dir)
    basis = linalg.pca_fit(rows, "v", WIDTH, 16)
    flat = linalg.pca_apply(rows, "vec_id", "v", basis).select(F.posexplode("vec").alias("i", "x"))
    shown = flat.groupBy("i").agg(F.var_pop("x").alias("s"))
    return shown.agg(F.round(F.sum("s"), 6).alias("projected_var")).withColumn("retained", F.lit(round(basis["retained"], 6)))


@query()
def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R² of the ridge regression of the last 16 numbers on the first 48; solving isn't SQL's."""
    rows = embeddings(spark, sf_dir).select(F.slice("v", 1, 48).alias("x"), F.slice("v", 49, 16).alias("y"))
    fit = linalg.ridge_fit(rows, "x", "y", 48, 16, 1e-3)
    return spark.createDataFrame([(round(fit["r2"], 6), 48, 16)], "r2 double, n_x int, n_y int")


@query()
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared MMD of seen rows to half of the reserved ones by that between the halves, and a probe's accuracy."""
    rows = embeddings(spark, sf_dir).withColumn("side", F.when(F.col("label") < 5, F.lit("seen")).otherwise(F.when(F.xxhash64("vec_id") % 2 == 0, F.lit("r1")).otherwise(F.lit("r2"))))
    sigma = mmd.median_bandwidth(rows.where("side <> 'seen'"), "vec_id", "v", seed=0)
    sums = mmd.kernel_sums(rows, rows, "side", "vec_id", "v", sigma).cache()
    ratio = mmd.squared_mmd(sums, "seen", "r2").select(F.col("mmd2").alias("x")).crossJoin(mmd.squared_mmd(sums, "r1", "r2").select(F.col("mmd2").alias("y")))
    acc = linalg.probe_accuracy(rows.withColumn("y", (F.col("side") == "seen").cast("double")), "vec_id", "v", "y", 0)
    return ratio.select(F.round(F.col("x") / F.col("y"), 4).alias("fp_ratio"), F.lit(round(acc, 4)).alias("probe_acc"))


VOCAB = 256
_COUNTS = f"c as (select doc_id, token, count(*) as c from (select doc_id, unnest({S.words('lower(text)')}) as token from documents) group by doc_id, token), v as (select token, cnt, row_number() over (order by cnt desc, token) - 1 as idx from (select token, sum(c)::bigint as cnt from c group by token order by cnt desc, token limit {VOCAB}))"


@query(f"with {_COUNTS} select token, cnt as count, idx from v")
def unigram_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent tokens, a top-k report."""
    return vectors.vocabulary(vectors.token_counts(spread(table(spark, sf_dir, "documents")), "doc_id", "text"), VOCAB).select("token", "count", F.col("idx").cast("long").alias("idx"))


_HIST = f"{_COUNTS}, t as (select doc_id, sum(c) as t from c group by doc_id), h as (select doc_id, coalesce(idx, {VOCAB}) as idx, sum(c) / any_value(t) as w from c join t using (doc_id) left join v using (token) group by doc_id, coalesce(idx, {VOCAB}))"


@query(f"with {_HIST} select doc_id, idx, round(w, {PLACES}) as w from h")
def unigram_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(vectors.token_counts(spread(table(spark, sf_dir, "documents")), "doc_id", "text"), "counts")
    return vectors.histograms(counts, vectors.vocabulary(counts, VOCAB), "doc_id", VOCAB).select("doc_id", F.col("idx").cast("long").alias("idx"), F.round("w", PLACES).alias("w"))


@query(
    f"with {_HIST}, d as (select doc_id, lang = 'en' as g from documents), q as (select doc_id, g, coalesce(sum(w * w), 0) as n from d left join h using (doc_id) group by doc_id, g), dp as (select a.doc_id as i, b.doc_id as j, sum(a.w * b.w) as p from h a join h b using (idx) group by 1, 2), k as (select a.g as x, b.g as y, sum(exp(-greatest(a.n + b.n - 2 * coalesce(p, 0), 0) / (2 * 0.1 * 0.1))) as t, count(*) as c from q a join q b on true left join dp on dp.i = a.doc_id and dp.j = b.doc_id group by 1, 2) select round(max(t / c) filter (where x and y) + max(t / c) filter (where not x and not y) - 2 * max(t / c) filter (where x and not y), {PLACES}) as mmd2 from k"
)
def unigram_mmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared MMD of English against other documents over token histograms, at a fixed bandwidth."""
    docs = table(spark, sf_dir, "documents")
    sided = spread(docs.select("doc_id", "text", F.when(F.col("lang") == "en", "g").otherwise("r").alias("side")))
    words = vectors.worded(sided, ["doc_id", "side"], "text")  # cut twice, which costs less than to write them
    rows = vectors.shares(words, ["doc_id", "side"], vectors.vocabulary(vectors.word_counts(words), VOCAB), VOCAB)
    return mmd.squared_mmd(mmd.kernel_sums(rows, rows, "side", "doc_id", "vec", 0.1), "g", "r").select(F.round("mmd2", PLACES).alias("mmd2"))


_HIST_MMD = f"with {_HIST}, d as (select doc_id, lang = 'en' as g from documents), q as (select doc_id, g, coalesce(sum(w * w), 0) as n from d left join h using (doc_id) group by doc_id, g), dp as (select a.doc_id as i, b.doc_id as j, sum(a.w * b.w) as p from h a join h b using (idx) group by 1, 2), k as (select a.g as x, b.g as y, sum(exp(-greatest(a.n + b.n - 2 * coalesce(p, 0), 0) / (2 * 0.1 * 0.1))) as t, count(*) as c from q a join q b on true left join dp on dp.i = a.doc_id and dp.j = b.doc_id group by 1, 2) select round(max(t / c) filter (where x and y) + max(t / c) filter (where not x and not y) - 2 * max(t / c) filter (where x and not y), {PLACES}) as raw_mmd, 0.1::double as bandwidth, max(sqrt(c)::bigint) filter (where x and y) as n_generated, max(sqrt(c)::bigint) filter (where not x and not y) as n_reference from k"


@query(_HIST_MMD)
def score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English texts against the others as two files of JSON lines, over the tokens of both."""
    from corvane.scoring import score_files as scored

    at, docs = scratch(spark, "score"), table(spark, sf_dir, "documents").select("text", "lang")
    for name, rows in (("a", docs.where("lang = 'en'")), ("b", docs.where("lang <> 'en'")), ("all", docs)):
        rows.select("text").write.json(f"{at}/{name}.jsonl")
    out = scored(spark, f"{at}/a.jsonl", f"{at}/b.jsonl", vocabulary=f"{at}/all.jsonl", size=VOCAB, bandwidth=0.1)
    return out.select(F.round("raw_mmd", PLACES).alias("raw_mmd"), "bandwidth", "n_generated", "n_reference")


_EVALS = "(select label as step, avg(v[1]) + 2 as val, avg(abs(v[2])) * 10 as ratio from {e} group by label)"


@query(
    f"with e as {_EVALS.format(e=E_SQL)}, r as (select *, val <= 1.01 * min(val) over (order by step rows between unbounded preceding and current row) as ok from e) select 'best' as kind, arg_min(step, (val, step)) as step from r union all select 'best_clean', arg_min(step, (ratio, step)) from r where ok"
)
def checkpoint_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    evals = embeddings(spark, sf_dir).groupBy(F.col("label").alias("step")).agg((F.avg(F.get("v", F.lit(0))) + 2).alias("val"), (F.avg(F.abs(F.get("v", F.lit(1)))) * 10).alias("ratio"))
    return linalg.best_checkpoints(evals, "step", "val", "ratio", 1.01)


@query("select kind, sum(n)::bigint as before, sum(n * rep)::bigint as after, round(sum(n) / any_value(a), 8) as share_before, round(sum(n * rep) / any_value(b), 8) as share_after from (select lang as kind, count(*) as n, case lang when 'fr' then 3 else 1 end as rep from documents group by lang), (select sum(n) as a, sum(n * case lang when 'fr' then 3 else 1 end) as b from (select lang, count(*) as n from documents group by lang)) group by kind")
def repeat_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("before")).withColumn("after", F.col("before") * F.when(F.col("kind") == "fr", 3).otherwise(1))
    total = kinds.agg(F.sum("before").alias("a"), F.sum("after").alias("b"))
    return kinds.crossJoin(total).select("kind", "before", F.col("after").cast("long").alias("after"), F.round(F.col("before") / F.col("a"), 8).alias("share_before"), F.round(F.col("after") / F.col("b"), 8).alias("share_after"))
