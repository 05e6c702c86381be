"""Queries of readers and of what orders, splits and counts rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import generation, sampling
from corvane.registry import query
from corvane.sources import texts as R
from corvane.sources.shared import scratch
from corvane.sources.tables import table

from . import sqltext as S
from .texts import NORMAL, documents


@query(f"select text from benchmark where {S.norm('text')} <> ''")
def eval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation texts out of JSON lines in two folders, one of which holds lines that aren't JSON."""
    at = scratch(spark, "eval")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.to_json(F.struct("text")).alias("value"))
    rows.where("item_id % 2 = 0").select("value").write.text(f"{at}/a")
    odd = rows.where("item_id % 2 = 1").select("value").unionByName(spark.createDataFrame([("{not json",), ('{"text": " "}',)], "value string"))
    odd.write.text(f"{at}/b")
    return R.eval_texts(spark, [f"{at}/a/part-*", f"{at}/b/part-*", f"{at}/*/part-*"])


@query("select sha256(text) as text_hash from benchmark order by item_id limit 50")
def first_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first texts of a file, a reader with its limit."""
    at = scratch(spark, "lines")
    table(spark, sf_dir, "benchmark").repartitionByRange(4, "item_id").sortWithinPartitions("item_id").select("text").write.json(at)
    return R.jsonl_texts(spark, at, limit=50).select(F.sha2("text", 256).alias("text_hash"))


@query("select sha256(text) as text_hash from documents where text <> ''")
def stream_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stream_dataset(spark, f"{sf_dir.rstrip('/')}/documents.parquet", "text").select(F.sha2("text", 256).alias("text_hash"))


@query("select doc_id, lang, source from documents where lang = 'en' and (source is null or source in ('src1', 'src2'))")
def matching_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(R.matches({"lang": "en", "source": ["src1", None, "src2"]})).select("doc_id", "lang", "source")


@query("select case when doc_id % 3 = 0 then 'par-' || (row_number() over (order by doc_id) - 1) else doc_id::varchar end as parent_id, sha256(text) as text_hash from documents")
def parent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents, of which every third lacks an id and is named by its place."""
    rows = table(spark, sf_dir, "documents").withColumn("parent_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")))
    return R.parents(rows, "doc_id").select("parent_id", F.sha2("text", 256).alias("text_hash"))


@query(f"select doc_id, sha256(case when doc_id % 2 = 0 then text else n end) as text_hash from {NORMAL} where n <> ''")
def vocabulary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a vocabulary's source, JSON objects and plain texts by turns."""
    lines = documents(spark, sf_dir).where("n <> ''").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct("text"))).otherwise(F.col("n")).alias("value"))
    return R.vocabulary_texts(lines, keep=("doc_id",)).select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query("select doc_id, source, case when row_number() over (partition by source order by sha256('11:' || coalesce(source, '') || ':' || doc_id), doc_id) <= 5 then 'val' else 'pool' end as part from documents where source is not null")
def val_pool_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source")
    return sampling.val_and_pool(rows, "source", "doc_id", 5, 11)


@query("select doc_id, row_number() over (order by sha256('12:' || doc_id), doc_id) - 1 as place from documents")
def final_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.final_order(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 12)


SCHEDULE = [{"epochs": [1, 2], "repeat_kinds": {"en": 3}}, {"epochs": [2, 2], "repeat_sources": {"src1": 4, "src2": 0}}]
BASE = {"repeat_kinds": {"en": 2}, "repeat_sources": {"src2": 2}}


@query(
    """with e as (select unnest([0, 1, 2]) as epoch), r as (select epoch, doc_id, greatest(1, case when lang = 'en' then case when epoch >= 1 then 3 else 2 end else 1 end,
    case when source = 'src1' and epoch = 2 then 4 when source = 'src2' then case when epoch = 2 then 0 else 2 end else 1 end) as n from documents, e)
    select epoch, doc_id, unnest(range(1, n + 1)) as copy from r"""
)
def epoch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.epochs(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), 3, BASE, SCHEDULE, "lang", "source")
    return rows.select(F.col("epoch").cast("int").alias("epoch"), "doc_id", F.col("copy").cast("long").alias("copy"))


TEMPLATE, RUBRIC = "You edit passages.", "Turn causes into effects."
_PROMPT = f"'{TEMPLATE}' || chr(10) || chr(10) || 'Edit: causal_reverse' || chr(10) || 'Severity: mild' || chr(10) || 'Rubric: {RUBRIC}' || chr(10) || '1. Keep names.' || chr(10) || '2. Change only the early third of the passage.'"
_LISTED = "case when len(s) > 0 then chr(10) || 'Change each of these sentences once and no other one:' || chr(10) || '[0] ' || s[1] || chr(10) else '' end"


@query(
    f"select doc_id, sha256({_PROMPT} || chr(10) || {_LISTED} || chr(10) || 'Passage:' || chr(10) || n || chr(10) || chr(10) || 'Answer with JSON of this shape only:' || chr(10) || '{generation.WHOLE_SHAPE}') as prompt_hash from (select doc_id, n, {S.sentences('n')} as s from {NORMAL})"
)
def whole_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.transform(F.slice(T.sentences(F.col("n")), 1, 1), lambda s: F.struct(F.lit(0).alias("index"), s.alias("sentence")))
    rubric = generation.rubric_with_constraints(RUBRIC, ["Keep names."], position="early")
    return documents(spark, sf_dir).select("doc_id", F.sha2(generation.whole_prompt(TEMPLATE, "causal_reverse", "mild", rubric, F.col("n"), first), 256).alias("prompt_hash"))


@query("select source, lang, count(*) as n_requests from documents group by rollup (source, lang)")
def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.request_counts(table(spark, sf_dir, "documents"), ["source", "lang"])


@query("select lang as kind, source as domain, count(*) as n from documents group by all")
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators.corpus import layer_counts as counted

    return counted(table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), F.col("source").alias("domain")))


_FAMILY, _SEVERITY = "(['benign_paraphrase', 'causal_reverse', 'topic_drift'])[(doc_id % 3)::int + 1]", "(['dose1', 'dose2', 'severe', 'odd'])[(doc_id % 4)::int + 1]"
_CLEAN, _FIRST = f"(select doc_id, n, {_FAMILY} as family, {_SEVERITY} as severity from {NORMAL})", "case when doc_id % 5 = 0 then n when doc_id % 7 = 0 then '  ' else 'Otherwise, ' || n end"


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parents, and an edit of each by its number: some change nothing, some are blank."""
    docs = documents(spark, sf_dir)
    at = lambda names, k: F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % k).cast("int"))
    text = F.when(F.col("doc_id") % 5 == 0, F.col("n")).when(F.col("doc_id") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit("Otherwise, "), "n"))
    edits = docs.select(F.col("doc_id").alias("parent_id"), at(("benign_paraphrase", "causal_reverse", "topic_drift"), 3).alias("family"), at(("dose1", "dose2", "severe", "odd"), 4).alias("severity"), text.alias("text"), F.lit("{}").alias("validation"))
    return docs.select(F.col("doc_id").alias("parent_id"), F.col("n").alias("text")), edits


@query(
    f"""with e as (select doc_id as parent_id, n, family, severity, {_FIRST} as text, case severity when 'dose1' then 1 when 'dose2' then 2 when 'severe' then 3 end as dose from {_CLEAN}),
    g as (select * from e where trim(text) <> '' and {S.norm('text')} <> {S.norm('n')}), t as (select max(dose) as top from g where family = 'benign_paraphrase')
    select family || '__dose' || coalesce(dose::varchar, severity) as condition, family, case when family = 'benign_paraphrase' then case when dose = top then 'benign_anchor' else 'benign_dose' end else 'harmful' end as role, dose, parent_id, sha256(text) as text_hash from g, t"""
)
def condition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits by family and dose, the strongest benign dose as anchor."""
    from corvane.operators import conditions

    parents, edits = _edited(spark, sf_dir)
    return conditions.conditions(edits, parents).select("condition", "family", "role", "dose", "parent_id", F.sha2("text", 256).alias("text_hash"))


@query(f"select doc_id, 'dose' || case when doc_id % 3 = 0 then (doc_id % 50 + 1)::varchar when doc_id % 3 = 1 then 'x' || doc_id else severity end as label, coalesce(nullif(regexp_extract(severity, '^dose([0-9]+)$', 1), '')::int, case severity when 'severe' then 3 end) as dose from {_CLEAN}")
def dose_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators import conditions

    _, edits = _edited(spark, sf_dir)
    rows = edits.withColumnRenamed("parent_id", "doc_id").withColumn("k", F.col("doc_id") % 3)
    requested = F.when(F.col("k") == 0, (F.col("doc_id") % 50 + 1).cast("double")).when(F.col("k") == 1, F.lit(0.0))
    sample = F.when(F.col("k") == 1, F.concat(F.lit("a:x"), F.col("doc_id").cast("string"))).otherwise(F.lit("plain"))
    return rows.select("doc_id", T.dose_label(requested, sample, F.col("severity")).alias("label"), conditions.dose_of(F.col("severity")).alias("dose"))


@query(f"select doc_id, case when doc_id % 3 = 0 then true when doc_id % 3 = 1 and s[1] <> '' then length(s[1]) >= 15 else doc_id % 2 = 0 end as ok from (select doc_id, coalesce({S.sentences('n')}, []) as s, n from {NORMAL} where length(n) >= 15)")
def contradiction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded anchors: the whole text, its first sentence, or none."""
    from corvane.operators import quality

    rows = documents(spark, sf_dir).where(F.length("n") >= 15)
    recorded = F.when(F.col("doc_id") % 3 == 0, F.upper("n")).when(F.col("doc_id") % 3 == 1, F.get(T.sentences(F.col("n")), F.lit(0)))
    return rows.select("doc_id", quality.contradiction_ok(recorded, F.col("doc_id") % 2 == 0, F.col("n")).alias("ok"))


@query("select doc_id, split from (select doc_id, split, row_number() over (partition by split order by doc_id) as k from (select doc_id, (['train', 'val', 'test'])[(doc_id % 3)::int + 1] as split from documents where doc_id % 4 <> 0) where split <> 'test') where k <= 30")
def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidates of two splits, a selection with its size."""
    from corvane.operators import conditions

    split = F.get(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("doc_id") % 3).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", split.alias("split"), F.when(F.col("doc_id") % 4 != 0, "candidate").otherwise("reference").alias("role"))
    return conditions.candidates(rows, ("train", "val"), 30, True, "doc_id").select("doc_id", "split")
