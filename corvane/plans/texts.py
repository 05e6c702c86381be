"""Queries over texts: scalars, keys, filters, bans, dedup, admission, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import dedup, sampling
from corvane.operators.digests import corpus_hashes
from corvane.operators.quality import viable
from corvane.operators.quantiles import quantiles
from corvane.registry import query
from corvane.sources.shared import cut
from corvane.sources.tables import kept, spread, table

from . import sqltext as S

LEAST_SENTENCES, LEAST_WORDS, MOST_WORDS = 4, 100, 400
VIABLE_SQL = f"(n <> '' and {S.english('n')} and len({S.sentences('n')}) >= {LEAST_SENTENCES} and len({S.words('n')}) between {LEAST_WORDS} and {MOST_WORDS})"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, source, and n: the normalized text."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).withColumn("n", T.normalize(F.col("text")))


NORMAL = f"(select doc_id, text, lang, source, {S.norm('text')} as n from documents)"


@query(
    f"select doc_id, len({S.words('text')}) as n_words, len({S.tokens('text')}) as n_tokens, len({S.sentences('n')}) as n_sentences, round({S.latin('text')}, 8) as latin_share, {S.english('text')} as english from {NORMAL}"
)
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.size(T.words(t)).cast("long").alias("n_words"), F.size(T.tokens(t)).cast("long").alias("n_tokens"), F.size(T.sentences(F.col("n"))).cast("long").alias("n_sentences"), F.round(T.latin_share(t), 8).alias("latin_share"), T.looks_latin(t).alias("english"))


@query(f"select doc_id, i as position, tok as token from (select doc_id, unnest({S.tokens('text')}) as tok, generate_subscripts({S.tokens('text')}, 1) as i from documents)")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("p", "token")).select("doc_id", (F.col("p") + 1).cast("long").alias("position"), "token")


@query(f"select doc_id, n as normalized, sha256(n) as exact_key, sha256(lower(n)) as folded_key, sha256(text) as raw_key from {NORMAL}")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return documents(spark, sf_dir).select("doc_id", n.alias("normalized"), F.sha2(n, 256).alias("exact_key"), F.sha2(F.lower(n), 256).alias("folded_key"), F.sha2("text", 256).alias("raw_key"))


@query("""select doc_id, (('0x' || substr(sha256('[7,"rule",' || doc_id || ']'), 9, 8))::bigint & 2147483647) as seed from documents""")
def stable_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.stable_seed(7, "rule", F.col("doc_id").cast("string")).alias("seed"))


@query(
    f"""with s as (select doc_id, n, {S.sentences('n')} as ss from {NORMAL}),
    x as (select doc_id, i, ss[i] as sent, len({S.pieces('ss[i]')}) as k from (select doc_id, ss, unnest(range(1, len(ss) + 1)) as i from s)),
    c as (select *, sum(k) over (partition by doc_id order by i) as upto from x),
    f as (select doc_id, min(i) as stop from c where upto > 350 and upto - k >= 100 group by doc_id),
    j as (select c.doc_id, string_agg(sent, ' ' order by i) as out from c left join f using (doc_id) where stop is null or i < stop group by c.doc_id)
    select s.doc_id, case when len({S.pieces('n')}) <= 400 then n else coalesce(out, '') end as passage from s left join j using (doc_id)"""
)
def lead_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.lead_passage(F.col("n"), 350, 400).alias("passage"))


@query("""select doc_id, trim(case when p like '%POST:%' then split_part(substr(p, strpos(p, 'POST:') + 5), 'TL;DR:', 1) else split_part(p, 'TL;DR:', 1) end, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as post
    from (select doc_id, case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then 'SUBREDDIT: r/x' || chr(10) || 'POST: ' || text || chr(10) || 'TL;DR: short' else text || 'TL;DR: a TL;DR: b' end as p from documents)""")
def forum_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    prompt = F.when(F.col("doc_id") % 3 == 0, t).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("SUBREDDIT: r/x\nPOST: "), t, F.lit("\nTL;DR: short"))).otherwise(F.concat(t, F.lit("TL;DR: a TL;DR: b")))
    return table(spark, sf_dir, "documents").select("doc_id", T.forum_post(prompt).alias("post"))


@query(
    """with recursive s as (select doc_id, text, """
    + S.sentences(S.norm("text"))
    + """ as ss from documents where doc_id >= 0),
    w as (select doc_id, 0 as i, 0 as cur, 0 as a, 0 as b, false as hit from s
      union all
      select w.doc_id, w.i + 1, case when p > 0 then w.cur + p - 1 + length(s.ss[w.i + 1]) else w.cur end, case when p > 0 then w.cur + p - 1 else 0 end, case when p > 0 then w.cur + p - 1 + length(s.ss[w.i + 1]) else 0 end, p > 0
      from w join s using (doc_id), lateral (select strpos(substr(s.text, w.cur + 1), s.ss[w.i + 1]) as p) where w.i < len(s.ss))
    select s.doc_id, len(s.ss) as n_sentences, count(*) filter (where hit) as n_spans, coalesce(sum(a) filter (where hit), 0)::bigint as sum_start, coalesce(sum(b) filter (where hit), 0)::bigint as sum_end from s left join w using (doc_id) group by s.doc_id, s.ss"""
)
def raw_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in raw texts, of which those over line breaks are missing, in figures."""
    spans = documents(spark, sf_dir).select("doc_id", F.size(T.sentences(F.col("n"))).cast("long").alias("n_sentences"), T.sentence_spans(F.col("text")).alias("s"))
    total = lambda f: F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x[f])
    return spans.select("doc_id", "n_sentences", F.size("s").cast("long").alias("n_spans"), total("start").alias("sum_start"), total("end").alias("sum_end"))


@query(f"select doc_id, lang from {NORMAL} where {VIABLE_SQL}")
def viable_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(documents(spark, sf_dir), viable(F.col("n"), LEAST_SENTENCES, LEAST_WORDS, MOST_WORDS)).select("doc_id", "lang")


@query(f"select doc_id, folded_key from (select doc_id, {S.key('text')} as folded_key, row_number() over (partition by {S.key('text')} order by doc_id) as k from documents) where k = 1")
def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.folded_key(F.col("text")).alias("folded_key"))
    return dedup.first_seen(docs, ["folded_key"], "doc_id")


@query(f"select doc_id, {S.key('text')} as folded_key from documents where {S.key('text')} not in (select {S.key('text')} from benchmark)")
def exact_ban(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.folded_key(F.col("text")).alias("folded_key"))
    return dedup.without(docs, table(spark, sf_dir, "benchmark").select(T.folded_key(F.col("text")).alias("folded_key")), ["folded_key"])


@query(f"select distinct doc_id from (select doc_id, unnest({S.grams('text')}) as g from documents) where g in (select unnest({S.grams('text')}) from benchmark)")
def ngram_ban(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a 13-gram with a benchmark text."""
    return dedup.sharing_grams(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id").select("doc_id")


DOMAINS = ("en", "fr", "de", "es")
NEED = 120


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bans = documents(spark, sf_dir), table(spark, sf_dir, "benchmark")
    return dedup.admit(docs, bans, DOMAINS, NEED, viable(F.col("n"), LEAST_SENTENCES, LEAST_WORDS, MOST_WORDS))


def _admission_sql() -> str:
    out = [f"with d as (select doc_id, lang, {S.key('text')} as k, {VIABLE_SQL} as ok from {NORMAL}), bk as (select distinct {S.key('text')} as k from benchmark), bg as (select distinct doc_id from (select doc_id, unnest({S.grams('text')}) as g from documents) where g in (select unnest({S.grams('text')}) from benchmark))"]
    out.append("c as (select d.*, bk.k is not null as exact, bg.doc_id is not null as gram from d left join bk on d.k = bk.k left join bg on d.doc_id = bg.doc_id)")
    seen = "select null::varchar as k where false"
    for i, domain in enumerate(DOMAINS):
        # a copy of an admitted text is a duplicate; only admitted keys are remembered
        out.append(f"s{i} as ({seen})")
        out.append(f"a{i} as (select c.*, c.k in (select k from s{i}) as before, row_number() over (partition by c.k, (ok and not exact and not gram) order by doc_id) as nth from c where lang = '{domain}')")
        out.append(f"r{i} as (select *, case when not ok then 'not_viable' when before or (not exact and not gram and nth > 1) then 'duplicate' when exact then 'eval_exact' when gram then 'eval_ngram' else 'admit' end as status from a{i})")
        out.append(f"t{i} as (select *, coalesce(sum(case when status = 'admit' then 1 else 0 end) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as already from r{i})")
        out.append(f"o{i} as (select doc_id, lang, k, status from t{i} where already < {NEED})")
        seen = " union ".join(f"select k from o{j} where status = 'admit'" for j in range(i + 1))
    return ", ".join(out)


ADMISSION_SQL = _admission_sql()
ADMITTED = " union all ".join(f"select doc_id, lang, status from o{i}" for i in range(len(DOMAINS)))


@query(f"{ADMISSION_SQL} {ADMITTED}")
def source_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission(spark, sf_dir).select("doc_id", "lang", "status")


@query(
    f"{ADMISSION_SQL} select lang, count(*) as scanned, count(*) filter (where status = 'not_viable') as not_viable, count(*) filter (where status = 'duplicate') as duplicate, count(*) filter (where status = 'eval_exact') as eval_exact, count(*) filter (where status = 'eval_ngram') as eval_ngram, count(*) filter (where status = 'admit') as admitted from ({ADMITTED}) group by lang"
)
def admission_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lambda s, n: F.count_if(F.col("status") == s).alias(n)
    return admission(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("scanned"), told("not_viable", "not_viable"), told("duplicate", "duplicate"), told("eval_exact", "eval_exact"), told("eval_ngram", "eval_ngram"), told("admit", "admitted"))


PARENTS, REFERENCE, CAP = 41, 82, 60


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(kept(documents(spark, sf_dir).drop("text"), viable(F.col("n"), LEAST_SENTENCES, LEAST_WORDS, MOST_WORDS)).withColumn("key", F.sha2("n", 256)))
    first = dedup.first_seen(docs, ["key"], "doc_id")
    return sampling.three_way(first, "lang", "key", DOMAINS, PARENTS, REFERENCE, CAP, seed=17)


def _share(total: int, i: int) -> int:
    return sampling.distribute(total, len(DOMAINS))[i]


SPLIT_SQL = (
    f"with v as (select doc_id, lang, n, sha256(n) as key, row_number() over (partition by sha256(n) order by doc_id) as k from {NORMAL} where {VIABLE_SQL}),"
    " r as (select *, row_number() over (partition by lang order by sha256('17:' || lang || ':' || key), key) - 1 as nth from v where k = 1),"
    " b as (select *, case lang " + " ".join(f"when '{d}' then {_share(PARENTS, i)}" for i, d in enumerate(DOMAINS)) + " end as p, case lang " + " ".join(f"when '{d}' then {_share(REFERENCE, i)}" for i, d in enumerate(DOMAINS)) + f" end as q from r where lang in {DOMAINS}),"
    f" s as (select doc_id, lang, case when nth < p then 'mev' when nth < p + q then 'ref' else 'unused' end as part, case when nth < p then nth when nth < p + q then nth - p else nth - p - q end as m from b where nth < p + q + {CAP})"
)


@query(f"{SPLIT_SQL} select doc_id, lang, part, part || '-' || lang || '-' || lpad(m::varchar, 4, '0') as parent_id from s")
def split_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).select("doc_id", "lang", "part", "parent_id")


@query(f"{SPLIT_SQL} select lang, count(*) as kept, count(*) filter (where part = 'mev') as parents, count(*) filter (where part = 'ref') as reference, count(*) filter (where part = 'unused') as unused from s group by lang")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lambda s, n: F.count_if(F.col("part") == s).alias(n)
    return split(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("kept"), told("mev", "parents"), told("ref", "reference"), told("unused", "unused"))


@query(f"{SPLIT_SQL} select count(*) as shared from (select n from s join v using (doc_id) where part = 'mev' intersect select n from s join v using (doc_id) where part <> 'mev')")
def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that parents share with the other parts: none."""
    rows = split(spark, sf_dir)
    return rows.where("part = 'mev'").select("key").intersect(rows.where("part <> 'mev'").select("key")).agg(F.count("*").alias("shared"))


@query(f"with s as (select doc_id, sha256(text) as h from documents) select source, sha256(string_agg(h, chr(10) order by doc_id)) as corpus_hash, count(*) as n from s join documents using (doc_id) group by source")
def texts_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each source's texts in order."""
    return corpus_hashes(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query(
    rf"""with c as (select doc_id, p, {S.norm('x')} as text from (select doc_id, unnest(range(1, len(y) + 1)) as p, unnest(y) as x from (select doc_id, string_split(text, chr(10)) as y from documents)))
    select 'run:' || lpad((row_number() over (order by doc_id, p) - 1)::varchar, 6, '0') as sample_id, text, 'sampler' as model, 'run' as run_id, 13 as seed from c where text <> ''"""
)
def normalize_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators.corpus import sample_rows

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "text"))
    return sample_rows(lines, ["doc_id", "p"], "text", "sampler", "run", 13)


@query("select lang, avg(n_chars) as mean_chars, round(stddev_pop(n_chars), 6) as std_chars, median(n_chars)::double as median_chars, round(quantile_cont(n_chars, 0.1), 6) as p10_chars from documents group by lang")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, docs = F.col("n_chars"), table(spark, sf_dir, "documents").select("lang", "n_chars")
    exact = quantiles(docs, "lang", "n_chars", {"median_chars": 0.5, "p10_chars": 0.1}).select(F.col("lang").alias("l"), "median_chars", F.round("p10_chars", 6).alias("p10_chars"))
    return docs.groupBy("lang").agg(F.avg(n).alias("mean_chars"), F.round(F.stddev_pop(n), 6).alias("std_chars")).join(exact, F.col("lang").eqNullSafe(F.col("l"))).drop("l")


@query(
    "with t as (select source, length(text) as x from documents union all select 'all', length(text) from documents) select source, count(*) as n, round(quantile_cont(x, 0.01), 6) as p01, round(quantile_cont(x, 0.25), 6) as p25, round(quantile_cont(x, 0.5), 6) as p50, round(quantile_cont(x, 0.9), 6) as p90, round(quantile_cont(x, 0.999), 6) as p999, max(x)::double as most from t where x is not null group by source"
)
def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of text lengths by source, and of all texts as one group."""
    docs = table(spark, sf_dir, "documents").select("source", F.length("text").alias("x"))
    shares = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p999": 0.999, "most": 1.0}
    out = quantiles(docs.select(F.explode(F.array("source", F.lit("all"))).alias("source"), "x"), "source", "x", shares)
    return out.select("source", "n", *(F.round(c, 6).alias(c) for c in shares))


@query(
    "with l as (select d.doc_id, d.lang, d.source from documents d join labels using (doc_id) where quality = 1 and toxic = 0 and source in ('src0', 'src1', 'src2', 'src3')) select doc_id, lang, source from (select *, row_number() over (order by sha256('5:' || doc_id), doc_id) as k from l where lang = 'en' and source <> 'src3') where k <= 40"
)
def select_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of rows that match, a sampling operator with its size."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0"), "doc_id").where(F.col("source").isin("src0", "src1", "src2", "src3"))
    rows = docs.where((F.col("lang") == "en") & (F.col("source") != "src3")).select("doc_id", "lang", "source")
    return sampling.sample(rows, 40, ["doc_id"], seed=5)


@query(f"with t as (select doc_id, {S.pieces(S.norm('text'))} as w from documents) select doc_id, case when len(w) + 9 <= 128 then len(w) + 9 else 128 end as n, sha256(array_to_string(case when len(w) + 9 <= 128 then list_concat(['This', 'passage', ':'], w, ['means', 'in', 'one', 'word', ':', '<e>']) else list_concat(list_concat(['This', 'passage', ':'], w)[1:122], ['means', 'in', 'one', 'word', ':', '<e>']) end, ' ')) as prompt_hash from t")
def template_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators.vectors import template_tokens

    ids = template_tokens(F.array(*map(F.lit, ["This", "passage", ":"])), T.split_words(T.normalize(F.col("text"))), F.array(*map(F.lit, ["means", "in", "one", "word", ":", "<e>"])), 128)
    return table(spark, sf_dir, "documents").select("doc_id", ids.alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.sha2(F.array_join("x", " "), 256).alias("prompt_hash"))


