"""Queries of what is written to files and read again: records, runs, shards, answers of a service, features."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as types

from corvane.functions import text as T
from corvane.operators import conditions, dedup, generation, quality, vectors
from corvane.operators.quality import viable
from corvane.registry import query
from corvane.sources import tables as R
from corvane.sources import texts
from corvane.sources.shared import scratch
from corvane.sources.tables import table

from . import sqltext as S
from .metrics import E_SQL, embeddings
from .texts import ADMISSION_SQL, ADMITTED, DOMAINS, LEAST_SENTENCES, LEAST_WORDS, MOST_WORDS, NEED, NORMAL, documents

ROW = types.StructType([types.StructField("doc_id", types.LongType()), types.StructField("lang", types.StringType()), types.StructField("source", types.StringType()), types.StructField("text", types.StringType())])


@query("select doc_id, lang, source, sha256(text) as text_hash from documents")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as JSON lines, fields by name, and read with their schema."""
    at = scratch(spark, "lines")
    R.write_jsonl(table(spark, sf_dir, "documents").select(*ROW.names), at)
    return R.read_jsonl(spark, at, ROW).select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_hash"))


@query("select (['jsonl', 'json', 'parquet'])[(doc_id % 3)::int + 1] as kind, doc_id, sha256(text) as text_hash from documents")
def records_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents in each of three kinds of files, read by their suffix."""
    at, docs, out = scratch(spark, "records"), table(spark, sf_dir, "documents").select(*ROW.names), None
    for k, kind in enumerate(("jsonl", "json", "parquet")):
        mine = docs.where(F.col("doc_id") % 3 == k)
        (mine.write.parquet if kind == "parquet" else mine.write.json)(f"{at}/r.{kind}")
        if kind == "json":  # an array of objects in one file for each hundred
            rows = mine.groupBy(F.floor(F.col("doc_id") / 300).alias("g")).agg(F.to_json(F.collect_list(F.struct(*ROW.names))).alias("value")).select("value")
            rows.write.mode("overwrite").option("lineSep", "\n").text(f"{at}/r.json")
        read = R.load_records(spark, f"{at}/r.{kind}", ROW) if kind != "json" else spark.read.text(f"{at}/r.json").select(F.explode(F.from_json("value", types.ArrayType(ROW))).alias("x")).select("x.*")
        read = read.select(F.lit(kind).alias("kind"), "doc_id", F.sha2("text", 256).alias("text_hash"))
        out = read if out is None else out.unionByName(read)
    return out


@query("select doc_id, coalesce(lang, '') as lang, n_chars from documents")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written with a header and read with their schema."""
    at = scratch(spark, "csv")
    R.write_csv(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), at)
    return spark.read.schema("doc_id long, lang string, n_chars long").option("header", True).csv(at).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "n_chars")


@query(f"select doc_id, sha256({S.norm('text')}) as text_hash from documents where {S.norm('text')} <> ''")
def checked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that must not be blank, white space collapsed."""
    rows = table(spark, sf_dir, "documents").where(T.normalize(F.col("text")) != "")
    return R.checked_texts(rows.select("doc_id", "text"), mode="whitespace").select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query("select doc_id, sha256(t) as text_hash from (select doc_id, trim(case when doc_id % 9 = 0 then '  ' else text end, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from documents) where t <> ''")
def non_empty_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the blank ones, of which every ninth is made one."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit("  ")).otherwise(F.col("text")).alias("text"))
    return R.non_empty_texts(rows, mode="none").select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query("select 'run-' || coalesce(source, 'none') || '-' || lang as run_id, sha256(text) as text_hash from documents where text is not null and lang is not null")
def manifest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of each source and language, in files of two fields by turns, read by a manifest in one scan."""
    at = scratch(spark, "runs")
    docs = table(spark, sf_dir, "documents").where("text is not null and lang is not null").select(F.concat(F.lit("run-"), F.coalesce("source", F.lit("none")), F.lit("-"), "lang").alias("run"), "text", "lang")
    docs.where("lang < 'es'").select("run", "text").write.partitionBy("run").json(f"{at}/a")
    docs.where("lang >= 'es'").select("run", F.col("text").alias("body"), F.lit("x").alias("text")).write.partitionBy("run").json(f"{at}/b")
    names = docs.select("run", "lang").distinct()
    early = F.col("lang") < "es"
    listed = names.select(F.col("run").alias("run_id"), F.concat(F.when(early, "a").otherwise("b"), F.lit("/run="), "run").alias("samples_path"), F.when(~early, "body").alias("text_key"))
    R.write_jsonl(listed, f"{at}/manifest")
    return R.load_runs(spark, f"{at}/manifest", at).select("run_id", F.sha2("text", 256).alias("text_hash"))


@query(f"{ADMISSION_SQL} {ADMITTED}")
def shard_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The admission of source texts out of shards, of which those behind the need stay closed."""
    at = scratch(spark, "shards")
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang").repartitionByRange(12, "doc_id").write.partitionBy("lang").parquet(at)
    shards = {d: texts.expand(spark, f"{at}/lang={d}/*.parquet") for d in DOMAINS}
    ok = viable(F.col("n"), LEAST_SENTENCES, LEAST_WORDS, MOST_WORDS)
    out = dedup.admit_shards(spark, shards, table(spark, sf_dir, "benchmark"), NEED, ok, prepare=lambda rows: rows.withColumn("n", T.normalize(F.col("text"))))
    return out.select("doc_id", "lang", "status")


def _echo():
    """A service that answers with the digest of the prompt, and fails now and then."""
    seen: set[str] = set()

    def client(prompt: str) -> str:
        digest = hashlib.sha256(prompt.encode()).hexdigest()
        if digest[0] in "01" and digest not in seen:
            seen.add(digest)
            raise generation.Retry("busy")
        return "<think>so</think> " + json.dumps({"rewrites": [], "operation_evidence": digest})

    return client


@query(f"select doc_id, sha256(n) as evidence from {NORMAL}")
def resumed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of which half were answered by an earlier run; each is asked for once."""
    at, tasks = scratch(spark, "answers"), documents(spark, sf_dir).select("doc_id", "n")
    generation.generate_into(tasks.where("doc_id % 2 = 0"), "doc_id", "n", _echo, at, parts=2, base=0.001)
    out = generation.generate_into(tasks, "doc_id", "n", _echo, at, parts=2, base=0.001)
    return out.where("error is null").select("doc_id", F.get_json_object("answer", "$.operation_evidence").alias("evidence"))


@query(f"select vec_id, round(v[1] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12), 8) as first from {E_SQL}")
def cached_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that are computed once and read where their protocol is the same."""
    at, rows = scratch(spark, "features"), embeddings(spark, sf_dir).select("vec_id", vectors.l2_normalize(F.col("v")).alias("u"))
    wanted = {"protocol": vectors.protocol_payload({"name": "unit"}, "1"), "count": rows.count()}
    vectors.cached(spark, rows, at, wanted)
    again = vectors.cached(spark, rows.where("false"), at, wanted)
    return again.select("vec_id", F.round(F.get("u", F.lit(0)), 8).alias("first"))


@query(f"select vec_id, round(v[1], 8) as first from {E_SQL}")
def checked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.checked_vectors(embeddings(spark, sf_dir).select("vec_id", "v"), "v").select("vec_id", F.round(F.get("v", F.lit(0)), 8).alias("first"))


@query("select doc_id, lang, length(text) as n from documents")
def aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of the same rows, one to one."""
    docs = table(spark, sf_dir, "documents")
    return conditions.aligned(docs.select("doc_id", "lang"), docs.select("doc_id", F.length("text").cast("long").alias("n")), "doc_id")


_PROBE = "select doc_id as id, text, '{side}' as side, row_number() over (order by sha256('5{side}:' || doc_id), doc_id) as k from documents where lang = '{lang}'"


@query(
    f"with n as (select least(20, count(*) filter (where lang = 'de'), count(*) filter (where lang = 'es')) as most from documents) select side, sha256(text) as text_hash from ({_PROBE.format(side='seen', lang='en')}) where k <= 20 union all select side, sha256(text) from ({_PROBE.format(side='seen', lang='fr')}) where k <= 20 union all select side, sha256(text) from ({_PROBE.format(side='reserved', lang='de')}), n where k <= most union all select side, sha256(text) from ({_PROBE.format(side='reserved', lang='es')}), n where k <= most"
)
def balanced_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of a fixed number on either side, half of them clean."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return conditions.balanced_probes(*(docs.where(F.col("lang") == x) for x in ("en", "fr", "de", "es")), n=40, seed=5).select("side", F.sha2("text", 256).alias("text_hash"))


_BENIGN = "select family || '__dose' || dose as condition, role, doc_id, sha256('Then ' || n) as text_hash from (select doc_id, n, 'topic_drift' as family, '1' as dose, 'harmful' as role from {n})"


@query(f"{_BENIGN.format(n=NORMAL)} union all select 'clean_parents', 'benign_anchor', doc_id, sha256(n) from {NORMAL}")
def benign_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits without a paraphrase: the clean parents are the benign anchor."""
    parents = documents(spark, sf_dir).select(F.col("doc_id").alias("parent_id"), F.col("n").alias("text"))
    edits = parents.select(F.lit("topic_drift__dose1").alias("condition"), F.lit("topic_drift").alias("family"), F.lit("harmful").alias("role"), F.lit(1).alias("dose"), "parent_id", F.concat(F.lit("Then "), "text").alias("text"))
    return conditions.with_benign(edits, parents).select("condition", "role", F.col("parent_id").alias("doc_id"), F.sha2("text", 256).alias("text_hash"))


@query(
    f"""with a as (select doc_id, {S.sentences('n')} as s from {NORMAL}), b as (select doc_id, s, range(0, len(s)) as e from a),
    c as (select doc_id, s, e, list_sort(list_transform(list_sort(list_transform(e, lambda i: {{'h': sha256('29:' || doc_id || ':' || i), 'i': i}}))[1:least(len(e), 3)], lambda x: x.i)) as c from b),
    r as (select *, list_filter(e, lambda i: not list_contains(c, i)) as rest from c), l as (select *, list_filter(rest, lambda i: len({S.pieces('s[i + 1]')}) >= 6) as long from r),
    o as (select *, list_sort(list_transform(case when len(long) > 0 then long else rest end, lambda i: {{'h': sha256('29a:' || doc_id || ':' || i), 'i': i}}))[1].i as o from l)
    select doc_id, array_to_string(list_transform(c, lambda i: i::varchar), ',') as places, sha256(coalesce(array_to_string(list_transform(c, lambda i: s[i + 1]), chr(10)), '')) as sentences_hash, s[o + 1] as anchor from o"""
)
def rewrite_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sentences of each text to rewrite, and another as its anchor."""
    rows = generation.targets(documents(spark, sf_dir), "doc_id", "n", 3, 29)
    told = lambda f: F.transform("targets", lambda t: t[f].cast("string"))
    return rows.select("doc_id", F.array_join(told("index"), ",").alias("places"), F.sha2(F.array_join(told("sentence"), "\n"), 256).alias("sentences_hash"), "anchor")


@query("select vec_id, substr(sha256('sampler-' || (label % 3) || ':' || label || ':' || vec_id), 1, 16) as sample_id from embeddings")
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", generation.sample_id(F.concat(F.lit("sampler-"), (F.col("label") % 3).cast("string")), F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("sample_id"))


#: What an edit's record is made of, by the number of its document: a family that counts or not, evidence with a sentence of the passage or none.
_RECORD = f"""select doc_id, lang, n, s, 'However, ' || n as edited, (['causal_reverse', 'para_lexical', 'topic_drift'])[(doc_id % 3)::int + 1] as family,
    case when doc_id % 5 = 0 then '' when len(s) > 1 then 'ANCHOR: ' || s[2] else 'ANCHOR: ' || n end as evidence from (select doc_id, lang, n, {S.sentences('n')} as s from {NORMAL})"""
_LEAKS = " or ".join(f"contains(lower('However, ' || n), '{x}')" for x in ("system prompt", "as an ai language model", "<|im_start|>", "<|assistant|>"))
_GATED = f"""with r as ({_RECORD}), g as (select *, case when family = 'causal_reverse' then 'pert_causal_reverse' end as kind,
    case when family <> 'causal_reverse' then 'family' when not ({S.english("'However, ' || n")}) or {_LEAKS} or n = '' or doc_id % 5 = 0 or (len({S.words('n')}) + 1) / greatest(len({S.words('n')}), 1) > 1.75 then 'invalid' end as gate from r),
    k as (select *, row_number() over (partition by edited order by 'e:' || doc_id) as nth from g where gate is null)"""


FAMILIES = ("causal_reverse", "para_lexical", "topic_drift")


def _records(spark: SparkSession, sf_dir: str, families: tuple[str, ...] = FAMILIES, evidence: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of edits that put a word ahead of every document, their families by turns, and their parents."""
    docs = documents(spark, sf_dir)
    if evidence is None:
        second = F.get(T.sentences(F.col("n")), F.lit(1))
        evidence = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("ANCHOR: "), F.coalesce(second, F.col("n"))))
    span = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("before"), F.lit("However, ").alias("after")))
    made = {"sample_id": F.concat(F.lit("e:"), F.col("doc_id").cast("string")), "clean_text": F.col("n"), "perturbed_text": F.concat(F.lit("However, "), "n"), "perturbation": F.get(F.array(*map(F.lit, families)), (F.col("doc_id") % len(families)).cast("int"))}
    made |= {"severity": F.concat(F.lit("dose"), (F.col("doc_id") % 4 + 1).cast("string")), "requested_rate": F.lit(0.0), "realized_rate": F.lit(0.1), "generator": F.lit("model"), "changed_spans": span, "validation": F.to_json(F.struct(evidence.alias("operation_evidence"))), "domain": F.col("lang"), "parent_sample_id": F.col("doc_id").cast("string")}
    records = docs.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in R.PASSAGE])
    parents = docs.select(F.col("doc_id").cast("string").alias("sample_id"), F.col("n").alias("clean_text"), F.col("lang").alias("domain"))
    return records, parents


#: Records of which a quarter need an anchor, which is an untouched sentence, one with a word more, or a claim that the passage lacks.
_QUOTES = f"""select doc_id, lang, n, s, 'However, ' || n as edited, (['causal_reverse', 'para_lexical', 'topic_drift', 'internal_contradiction'])[(doc_id % 4)::int + 1] as family,
    case when doc_id % 5 = 0 then '' else 'ANCHOR: "' || case when doc_id % 7 < 2 then 'a claim that nobody made here' when doc_id % 7 < 4 then coalesce(s[2], n) || ' so' else coalesce(s[2], n) end || '" || NEW: it' end as evidence from (select doc_id, lang, n, {S.sentences('n')} as s from {NORMAL})"""
#: An anchor stands if an untouched sentence holds it; a sentence with a word more is close to itself, whatever its letters.
_ANCHORED = f"""with q as ({_QUOTES}), t as (select *, list_transform(s, lambda x: {S.fold('x')}) as clean, list_transform({S.sentences('edited')}, lambda x: {S.fold('x')}) as told, {S.fold(S.norm(f"regexp_extract(evidence, {S.q(quality.ANCHOR)}, 1)"))} as a from q),
    u as (select *, list_intersect(told, clean) as same from t),
    g as (select *, case family when 'causal_reverse' then 'pert_causal_reverse' when 'internal_contradiction' then 'pert_contradiction' end as kind,
    case when family not in ('causal_reverse', 'internal_contradiction') then 'family' when not ({S.english('edited')}) or {_LEAKS} or n = '' or doc_id % 5 = 0 or (len({S.words('n')}) + 1) / greatest(len({S.words('n')}), 1) > 1.75 then 'invalid'
    when family = 'internal_contradiction' and not (length(a) >= {quality.LEAST_ANCHOR} and (len(list_filter(same, lambda x: contains(x, a))) > 0 or doc_id % 7 in (2, 3) and coalesce(list_contains(same, clean[2]), false))) then 'anchor' end as gate from u),
    k as (select *, row_number() over (partition by edited order by 'e:' || doc_id) as nth from g where gate is null)"""


@query(f"{_ANCHORED} select kind, sha256(edited) as text_hash, lang as domain, 'dose' || doc_id as source, doc_id::varchar as parent from k where nth = 1 union all select 'clean_parent', sha256(n), lang, null, doc_id::varchar from {NORMAL}")
def rewrite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the rewrites that pass, contradictions with their anchor, and of all parents."""
    second = F.coalesce(F.get(T.sentences(F.col("n")), F.lit(1)), F.col("n"))
    quoted = F.when(F.col("doc_id") % 7 < 2, F.lit("a claim that nobody made here")).when(F.col("doc_id") % 7 < 4, F.concat(second, F.lit(" so"))).otherwise(second)
    evidence = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('ANCHOR: "'), quoted, F.lit('" || NEW: it')))
    records, parents = _records(spark, sf_dir, (*FAMILIES, "internal_contradiction"), evidence)
    rows, _ = conditions.rewrite_rows(records, parents)
    return rows.select("kind", F.sha2("text", 256).alias("text_hash"), "domain", "source", "parent")


@query(f"{_GATED} select kind, 'kept' as status, count(*) as n from k where nth = 1 group by kind union all select coalesce(kind, ''), gate, count(*) from g where gate is not null group by kind, gate")
def rewrite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was kept and dropped of the rewrites, by reason."""
    records, parents = _records(spark, sf_dir)
    return conditions.rewrite_rows(records, parents)[1]


def _measures():
    """A model without weights: the length of a text and how often it has an e."""
    import numpy as np

    return lambda texts: np.array([[len(t), t.count("e")] for t in texts], float).reshape(-1, 2)


@query("select doc_id, length(text)::double as x, (length(text) - length(replace(text, 'e', '')))::double as y from documents where text is not null")
def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by a model that each worker loads once."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return vectors.encode(docs, "doc_id", "text", _measures, batch=64).select("doc_id", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"))


_SHAPE = '{"rewrites": [{"index": 0, "sentence": ""}], "operation_evidence": ""}'


@query(
    f"select doc_id, sha256('Rewrite.' || chr(10) || chr(10) || 'Sentences to rewrite:' || chr(10) || (case when s = '' then '[]' else '[' || to_json({{'index': 0, 'sentence': s}})::varchar || ']' end) || chr(10) || chr(10) || 'Passage, for context only:' || chr(10) || n || chr(10) || chr(10) || 'Answer with JSON of this shape only:' || chr(10) || {S.q(_SHAPE)}) as prompt_hash from (select doc_id, n, coalesce({S.sentences('n')}[1], '') as s from {NORMAL})"
)
def rewrite_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to rewrite the first sentence of each text."""
    first = F.transform(F.slice(T.sentences(F.col("n")), 1, 1), lambda s: F.struct(F.lit(0).alias("index"), s.alias("sentence")))
    return documents(spark, sf_dir).select("doc_id", F.sha2(generation.rewrite_prompt("Rewrite.", F.col("n"), first), 256).alias("prompt_hash"))
