"""Queries of seeded edits, gates, layers and corpus assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import corpus, perturb, quality, sampling
from corvane.registry import query
from corvane.sources.shared import cut
from corvane.sources.tables import table

from . import sqltext as S
from .texts import NORMAL, documents

RATE, SEED = 0.25, 17
OUT = ("doc_id", "n_eligible", "n_edited", "realized", "edited_hash")


def spans_hash() -> Column:
    """Of the changed spans, one a line."""
    return F.sha2(F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], s["before"], s["after"])), "\n"), 256).alias("spans_hash")


def told(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_eligible", "n_edited", F.round("realized", 8).alias("realized"), F.sha2("edited", 256).alias("edited_hash"), spans_hash())


def _spans(of: str, start: str, before: str, after: str, where: str = "true") -> str:
    """SQL for spans_hash: over i in the list `of`."""
    return f"sha256(coalesce(array_to_string(list_transform(list_filter({of}, lambda i: {where}), lambda i: ({start}) || ':' || ({start} + length({before})) || ':' || {before} || ':' || {after}), chr(10)), '')) as spans_hash"


def _sentence_spans(new: str) -> str:
    """The same for sentences s, of which those at c (from 0) become `new`."""
    return _spans("coalesce(c, [])", "coalesce(length(array_to_string(s[1:i], ' ')), 0) + least(i, 1)", "s[i + 1]", new, f"{new} <> s[i + 1]")


def _runs_sql(test: str, new: str, behind: str | None = None) -> str:
    """test, new: SQL over p (pieces by turns), i (1-based place of a run); behind: over x, the separator."""
    gone = "p[i] || left(p[i + 1], length(p[i + 1]) - length(" + behind.replace("$x", "p[i + 1]") + "))" if behind else "p[i]"
    rest = f" when list_contains(c, i - 1) then {behind.replace('$x', 'p[i]')}" if behind else ""
    return f"""with a as (select doc_id, {S.runs('n')} as p from {NORMAL}),
    b as (select doc_id, p, list_filter(range(2, len(p) + 1, 2), lambda i: {test}) as e from a),
    c as (select doc_id, p, e, list_transform(list_sort(list_transform(e, lambda i: {{'h': sha256('{SEED}:' || doc_id || ':' || (i - 1)), 'i': i}}))[1:{S.choose('len(e)', RATE)}], lambda x: x.i) as c from b)
    select doc_id, len(e) as n_eligible, len(c) as n_edited, round(len(c) / greatest(len(e), 1), 8) as realized, sha256(array_to_string(list_transform(range(1, len(p) + 1), lambda i: case when list_contains(c, i) then {new}{rest} else p[i] end), '')) as edited_hash, {_spans('list_sort(c)', "coalesce(length(array_to_string(p[1:i - 1], '')), 0)", gone, new)} from c"""


def _in(words: tuple[str, ...]) -> str:
    return f"lower(p[i]) in {tuple(words)}"


@query(_runs_sql(_in(perturb.DETERMINERS), "''", "ltrim($x)"))
def article_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(perturb.article_delete(documents(spark, sf_dir), "doc_id", "n", RATE, SEED))


@query(_runs_sql(_in(perturb.FUNCTION_WORDS), "p[i] || ' ' || p[i]"))
def function_word_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(perturb.function_word_repeat(documents(spark, sf_dir), "doc_id", "n", RATE, SEED))


_OTHER = "(case lower(p[i]) " + " ".join(f"when '{k}' then '{v}'" for k, v in perturb.VERBS.items()) + " end)"


@query(_runs_sql(f"{_in(tuple(perturb.VERBS))} and i >= 4 and p[i - 1] = ' ' and lower(p[i - 2]) in {perturb.SUBJECTS}", S.like_case("p[i]", _OTHER)))
def agreement_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(perturb.agreement_error(documents(spark, sf_dir), "doc_id", "n", RATE, SEED))


@query(_runs_sql(f"regexp_matches(p[i], '^[A-Za-z]+$') and {S.inflection('p[i]')} is not null", S.inflection("p[i]")))
def inflection_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(perturb.inflection_error(documents(spark, sf_dir), "doc_id", "n", RATE, SEED))


@query(f"select doc_id, (lower(n) <> n)::bigint as n_edited, (lower(n) <> n)::double as realized, sha256(lower(n)) as edited_hash, sha256(case when lower(n) <> n then '0:' || length(n) || ':' || n || ':' || lower(n) else '' end) as spans_hash from {NORMAL}")
def case_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturb.case_lower(documents(spark, sf_dir), "n").select("doc_id", "n_edited", F.col("realized").cast("double").alias("realized"), F.sha2("edited", 256).alias("edited_hash"), spans_hash())


def _places(least: int = 1, fits: str = "true", seed: int | str = SEED, rate: float = RATE, texts: str = NORMAL) -> str:
    """a: sentences, b: with eligible places from 0, c: with the chosen ones."""
    return f"""a as (select doc_id, n, {S.sentences('n')} as s from {texts}),
    b as (select doc_id, n, s, list_filter(range(0, len(s)), lambda i: {fits}) as e from a),
    c as (select doc_id, n, s, e, list_sort(list_transform(list_sort(list_transform(e, lambda i: {{'h': sha256('{seed}:' || doc_id || ':' || i), 'i': i}}))[1:least(len(e), greatest({least}, {S.choose('len(e)', rate)}))], lambda x: x.i)) as c from b)"""


TWICE = "s[i + 1] || ' ' || s[i + 1]"


@query(f"with {_places()} select doc_id, len(e) as n_eligible, len(c) as n_edited, round(len(c) / greatest(len(s), 1), 8) as realized, sha256(array_to_string(list_transform(range(0, len(s)), lambda i: case when list_contains(c, i) then s[i + 1] || ' ' || s[i + 1] else s[i + 1] end), ' ')) as edited_hash, {_sentence_spans(TWICE)} from c")
def sentence_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(perturb.sentence_repeat(documents(spark, sf_dir), "doc_id", "n", RATE, SEED))


_THIRD = "((list_sum(list_transform(s[1:i + 1], lambda x: length(x) + 1)) - 1) - length(s[i + 1]) / 2.0) / greatest(length(n), 1)"


@query(
    f"with {_places(fits=f'{_THIRD} >= 1.0 / 3 and {_THIRD} < 2.0 / 3')} select doc_id, len(e) as n_eligible, len(c) as n_edited, round(len(c) / greatest(len(s), 1), 8) as realized, sha256(array_to_string(list_transform(range(0, len(s)), lambda i: case when list_contains(c, i) then s[i + 1] || ' ' || s[i + 1] else s[i + 1] end), ' ')) as edited_hash, {_sentence_spans(TWICE)} from c"
)
def middle_sentence_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only sentences whose middle lies in the middle third of the text."""
    return told(perturb.sentence_repeat(documents(spark, sf_dir), "doc_id", "n", RATE, SEED, position="middle"))


def _mixed(items: str, seed: str, tag: str) -> str:
    keyed = f"list_transform(list_sort(list_transform(range(0, len({items})), lambda k: {{'h': sha256('{seed}:' || doc_id || ':' || {tag} || ':' || k), 'x': {items}[k + 1]}})), lambda x: x.x)"
    return f"(case when {keyed} = {items} then list_concat({items}[2:], {items}[1:1]) else {keyed} end)"


@query(
    f"""with {_places(least=2)}, d as (select doc_id, s, e, case when len(e) >= 2 then c else [] end as c from c),
    f as (select *, list_transform(c, lambda i: s[i + 1]) as items from d), g as (select *, {_mixed('items', f'{SEED}p', "'s'")} as m from f)
    select doc_id, len(e) as n_eligible, len(c) as n_edited, round(len(c) / greatest(len(s), 1), 8) as realized, sha256(array_to_string(list_transform(range(0, len(s)), lambda i: coalesce(m[list_position(c, i)], s[i + 1])), ' ')) as edited_hash, {_sentence_spans('m[list_position(c, i)]')} from g"""
)
def sentence_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(perturb.sentence_permute(documents(spark, sf_dir), "doc_id", "n", RATE, SEED))


def _ascii(s: str) -> str:
    return rf"string_split(regexp_replace({s}, '([A-Za-z][A-Za-z''-]*)', chr(1) || '\1' || chr(1), 'g'), chr(1))"


def _start(seed: str, i: str, room: str) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || doc_id || ':' || {i}), 1, 8))::bigint % ({room}))::int"


@query(
    f"""with {_places(fits=f"len({_ascii('s[i + 1]')}) >= 5")},
    u as (select doc_id, i, {_ascii('s[i + 1]')} as p from (select doc_id, s, unnest(c) as i from c)),
    v as (select *, len(p) // 2 as k, least(4, len(p) // 2) as w from u), x as (select *, {_start(f'{SEED}w', 'i', 'k - w + 1')} as st from v),
    y as (select *, list_transform(range(0, w), lambda j: p[2 * (st + j) + 2]) as items from x), z as (select *, {_mixed('items', f'{SEED}l', 'i')} as m from y),
    r as (select doc_id, i, array_to_string(list_transform(range(0, len(p)), lambda j: case when j % 2 = 1 and j // 2 >= st and j // 2 < st + w then m[j // 2 - st + 1] else p[j + 1] end), '') as sent from z),
    q as (select doc_id, map(list(i), list(sent)) as d from r group by doc_id)
    select c.doc_id, len(e) as n_eligible, len(c) as n_edited, round(len(c) / greatest(len(e), 1), 8) as realized, sha256(array_to_string(list_transform(range(0, len(s)), lambda i: coalesce(d[i], s[i + 1])), ' ')) as edited_hash, {_sentence_spans('d[i]')} from c left join q using (doc_id)"""
)
def local_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(perturb.local_shuffle(documents(spark, sf_dir), "doc_id", "n", RATE, SEED))


@query(
    f"""with {_places(fits=f"len({_ascii('s[i + 1]')}) >= 7")},
    u as (select doc_id, i, {_ascii('s[i + 1]')} as p from (select doc_id, s, unnest(c) as i from c)),
    v as (select *, len(p) // 2 as k, least(5, greatest(2, len(p) // 2 // 3)) as w from u), x as (select *, {_start(f'{SEED}r', 'i', 'k - w + 1')} as st from v),
    r as (select doc_id, i, w, array_to_string(p[1:2 * (st + w)], '') || ' ' || array_to_string(p[2 * st + 2:2 * (st + w)], '') || array_to_string(p[2 * (st + w) + 1:], '') as sent from x),
    q as (select doc_id, map(list(i), list(sent)) as d, sum(w) as w from r group by doc_id),
    o as (select c.doc_id, e, c, w, s, d, array_to_string(list_transform(range(0, len(s)), lambda i: coalesce(d[i], s[i + 1])), ' ') as edited from c left join q using (doc_id))
    select doc_id, len(e) as n_eligible, len(c) as n_edited, round(coalesce(w, 0) / greatest(len({S.words('edited')}), 1), 8) as realized, sha256(edited) as edited_hash, {_sentence_spans('d[i]')} from o"""
)
def phrase_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(perturb.phrase_repeat(documents(spark, sf_dir), "doc_id", "n", RATE, SEED))


def _sentence(s: str) -> str:
    n = S.norm(s)
    up = f"(case when left({n}, 1) = lower(left({n}, 1)) and left({n}, 1) <> upper(left({n}, 1)) then upper(left({n}, 1)) || substr({n}, 2) else {n} end)"
    return f"(case when {n} = '' then {n} when right({n}, 1) in ('.', '!', '?') then {up} else {up} || '.' end)"


def _pool_sql(where: str) -> str:
    return f"select distinct {_sentence('x')} as sentence from (select unnest({S.sentences('n')}) as x from {NORMAL} where {where}) where length(x) between 20 and 300 and {S.english('x')} and {_sentence('x')} <> ''"


def _pool(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return perturb.sentence_pool(documents(spark, sf_dir).where(where), "n")


@query(_pool_sql("lang = 'en'"))
def sentence_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir, "lang = 'en'")


def _splice_sql(pools: dict[str, str]) -> str:
    head = f"with {_places()}, k as (select doc_id, n, s, e, case when len(s) >= 2 then c else [] end as c from c)"
    parts = []
    for tag, where in pools.items():
        head += f""", p{tag} as (select sentence, row_number() over (order by sentence) - 1 as n from ({_pool_sql(where)})),
        d{tag} as (select doc_id, map(list(i), list(sentence)) as d from (select doc_id, i, ('0x' || substr(sha256('{SEED}d{tag}:' || doc_id || ':' || i), 1, 15))::bigint % (select count(*) from p{tag}) as n from (select doc_id, unnest(c) as i from k)) join p{tag} using (n) group by doc_id),
        e{tag} as (select k.doc_id, s, e, list_filter(c, lambda i: d[i] <> s[i + 1]) as c, d from k left join d{tag} using (doc_id)),
        o{tag} as (select doc_id, len(e) as n_eligible, len(coalesce(c, [])) as n_edited, round(len(coalesce(c, [])) / greatest(len(s), 1), 8) as realized, sha256(array_to_string(list_transform(range(0, len(s)), lambda i: case when list_contains(coalesce(c, []), i) then d[i] else s[i + 1] end), ' ')) as edited_hash, {_sentence_spans('d[i]')} from e{tag})"""
        parts.append(f"select *, '{tag}' as pool from o{tag}")
    return head + " " + " union all ".join(parts)


@query(_splice_sql({"g": "source = 'src1'"}))
def splice_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool, total = perturb.numbered_pool(cut(_pool(spark, sf_dir, "source = 'src1'")))
    return told(perturb.splice(documents(spark, sf_dir).select("doc_id", "n"), pool, total, "doc_id", "n", RATE, SEED, "g")).withColumn("pool", F.lit("g"))


@query(_splice_sql({"g": "source = 'src1'", "h": "source = 'src2'"}))
def matched_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same places, filled from either pool."""
    out, docs = None, documents(spark, sf_dir).select("doc_id", "n")
    placed = perturb.spliceable(docs, "doc_id", "n", RATE, SEED)
    for tag, where in (("g", "source = 'src1'"), ("h", "source = 'src2'")):
        pool, total = perturb.numbered_pool(cut(_pool(spark, sf_dir, where)))
        rows = told(perturb.splice(docs, pool, total, "doc_id", "n", RATE, SEED, tag, placed=placed)).withColumn("pool", F.lit(tag))
        out = rows if out is None else out.unionByName(rows)
    return out


MODELS = ("src1", "src2", "src3")


def _hex(tag: str, *keys: str) -> str:
    joined = " || ':' || ".join(keys)
    return f"('0x' || substr(sha256('{SEED}{tag}:' || {joined}), 1, 8))::bigint"


@query(
    f"""with src as (select source as model, doc_id * 4096 + i as ordinal, s[i] as sentence from (select source, doc_id, s, unnest(range(1, len(s) + 1)) as i from (select source, doc_id, {S.sentences('n')} as s from {NORMAL} where source in {MODELS}))),
    pool as (select model, sentence, row_number() over (partition by model order by ordinal) - 1 as n, count(*) over (partition by model) as total from src where len({S.pieces('sentence')}) >= 5),
    par as (select doc_id, s, unnest([0, 1]) as round from (select doc_id, {S.sentences('n')} as s from {NORMAL} where lang = 'en') where len(s) >= 4),
    k as (select *, least(greatest(2, round_even(len(s) * (0.3 + 0.2 * ({_hex('u', 'doc_id', 'round')} % 10000) / 10000.0), 0)::int), len(s) - 1) as k, [2, 3][({_hex('n', 'doc_id', 'round')} % 2) + 1] as many from par),
    c as (select *, list_transform(list_sort(list_transform({list(MODELS)}, lambda x: {{'h': sha256('{SEED}m:' || doc_id || ':' || round || ':' || x), 'x': x}})), lambda y: y.x)[1:many] as m, list_transform(list_sort(list_transform(range(0, len(s)), lambda x: {{'h': sha256('{SEED}c:' || doc_id || ':' || round || ':' || x), 'x': x}})), lambda y: y.x)[1:k] as c from k),
    d as (select doc_id, round, m[j % len(m) + 1] as model, c[j + 1] as i from (select *, unnest(range(0, len(c))) as j from c)),
    t as (select distinct model, total from pool),
    f as (select doc_id, round, map(list(i), list(sentence)) as d from (select d.*, {_hex('d', 'doc_id', 'round', 'i')} % total as n from d join t using (model)) join pool using (model, n) group by doc_id, round)
    select doc_id, round, array_to_string(m, '+') as domain, sha256(array_to_string(list_transform(range(0, len(s)), lambda i: coalesce(d[i], s[i + 1])), ' ')) as text_hash from c join f using (doc_id, round)"""
)
def splice_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sources = docs.where(F.col("source").isin(*MODELS)).select(F.col("source").alias("model"), "doc_id", F.posexplode(T.sentences(F.col("n"))).alias("i", "sentence")).select("model", (F.col("doc_id") * 4096 + F.col("i") + 1).alias("ordinal"), "sentence")
    out = corpus.splice_mix(docs.where("lang = 'en'"), sources, "doc_id", "n", 0.3, 0.5, (2, 3), 2, SEED)
    return out.select("doc_id", "round", "domain", F.sha2("text", 256).alias("text_hash"))


@query(
    f"""with {_places()}, r as (select doc_id, s, c, list_transform(c, lambda i: {{'i': i, 't': 'New  ' || lower(s[i + 1])}}) as w from c)
    select doc_id, sha256(array_to_string(list_transform(range(0, len(s)), lambda i: case when list_contains(c, i) and i % 2 = 0 then {S.norm("'New  ' || lower(s[i + 1])")} else s[i + 1] end), ' ')) as edited_hash, len(list_filter(c, lambda i: i % 2 = 0)) as n_changed from r"""
)
def sentence_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites of chosen sentences, of which every other is blank and one place has two."""
    rows = perturb.with_sentences(documents(spark, sf_dir), "doc_id", "n", RATE, SEED)
    one = lambda i, t: F.struct(i.alias("index"), t.alias("sentence"))
    new = F.flatten(F.transform("__c", lambda i: F.array(one(i, F.lit("first")), one(i, F.concat(F.lit("New  "), F.lower(F.get("__s", i)))))))
    rows = rows.withColumn("rewrites", F.filter(new, lambda r: r["index"] % 2 == 0)).withColumn("targets", F.col("__c")).drop("__s", "__e", "__c")
    out = perturb.rewrite_sentences(rows, "n", "targets", "rewrites")
    return out.select("doc_id", F.sha2("edited", 256).alias("edited_hash"), F.size("changed").cast("long").alias("n_changed"))


def _parents_sql() -> str:
    return f"with p as (select doc_id, lang, len({S.sentences('n')}) >= 4 and len({S.words('text')}) between 100 and 400 as fits from {NORMAL}), r as (select *, row_number() over (partition by lang, fits order by doc_id) as k from p)"


@query(f"{_parents_sql()} select doc_id, fits and k <= 25 as picked, case when fits and k <= 25 then 'relgen-' || lang || '-' || lpad(k::varchar, 4, '0') end as sample_id from r")
def rewrite_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rewrite_parents(documents(spark, sf_dir), 25, 4, 100, 400, "doc_id", "text", "lang").select("doc_id", "picked", "sample_id")


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits as records: rule edits, and model edits with notes that are missing here and there."""
    rows = perturb.sentence_repeat(documents(spark, sf_dir), "doc_id", "n", RATE, SEED)
    kind = F.get(F.array(*map(F.lit, ["sentence_repeat", "para_lexical", "topic_drift", "clean"])), (F.col("doc_id") % 4).cast("int"))
    text = F.when(kind == "clean", F.col("n")).when(F.col("doc_id") % 7 == 0, F.concat("n", F.lit(" As an AI language model I stop."))).otherwise(F.col("edited"))
    note = F.when(F.col("doc_id") % 3 == 0, F.lit('{"operation_evidence":"moved"}')).when(F.col("doc_id") % 3 == 1, F.lit('{"introduced_error":" No error ","preserved_facts":["a"]}')).otherwise(F.lit('{"introduced_error":"drift"}'))
    span = F.when(F.col("edited") == F.col("n"), F.array().cast("array<struct<start:int,end:int,before:string,after:string>>")).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.length("n").alias("end"), F.col("n").alias("before"), F.col("edited").alias("after"))))
    return rows.select("doc_id", F.col("n").alias("clean_text"), text.alias("perturbed_text"), kind.alias("perturbation"), F.when(kind == "sentence_repeat", "rule").otherwise("model").alias("generator"), F.lit(RATE).alias("requested_rate"), F.col("realized").alias("realized_rate"), span.alias("changed_spans"), note.alias("validation"))


CHECKS = ("non_empty", "english", "no_instruction_leakage", "bounded_length_ratio", "text_changed", "has_documented_change", "span_reconstruction", "preserved_facts_documented", "introduced_error_documented", "passed")


@query(
    f"""with {_places()}, r as (select doc_id, n as clean, array_to_string(list_transform(range(0, len(s)), lambda i: case when list_contains(c, i) then s[i + 1] || ' ' || s[i + 1] else s[i + 1] end), ' ') as edited, ['sentence_repeat', 'para_lexical', 'topic_drift', 'clean'][(doc_id % 4) + 1] as kind from c),
    t as (select *, case when kind = 'clean' then clean when doc_id % 7 = 0 then clean || ' As an AI language model I stop.' else edited end as text, kind <> 'clean' as ed from r),
    v as (select doc_id, trim(text) <> '' as non_empty, {S.english('text')} as english, not (lower(text) like '%system prompt%' or lower(text) like '%as an ai language model%' or lower(text) like '%<|im_start|>%' or lower(text) like '%<|assistant|>%') as no_instruction_leakage,
    len({S.words('text')}) / greatest(len({S.words('clean')}), 1) between 0.5 and 1.75 as bounded_length_ratio, case when ed then text <> clean end as text_changed, case when ed then edited <> clean end as has_documented_change, case when ed then edited = text end as span_reconstruction,
    case when kind = 'para_lexical' then doc_id % 3 in (0, 1) end as preserved_facts_documented, case when kind = 'topic_drift' then doc_id % 3 <> 1 end as introduced_error_documented from t)
    select *, non_empty and english and no_instruction_leakage and bounded_length_ratio and coalesce(text_changed, true) and coalesce(has_documented_change, true) and coalesce(span_reconstruction, true) and coalesce(preserved_facts_documented, true) and coalesce(introduced_error_documented, true) as passed from v"""
)
def validate_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate_edits(_edits(spark, sf_dir), ratio=False).select("doc_id", *CHECKS)


@query()
def token_edit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed tokens by tokens of whole texts with wrong agreement; a longest-matching-block comparison has no SQL form."""
    rows = cut(perturb.agreement_error(documents(spark, sf_dir), "doc_id", "n", RATE, SEED).select("doc_id", "n", "edited"))  # a UDF takes columns, not expressions with functions over elements
    return rows.select("doc_id", F.round(T.token_edit_ratio(F.col("n"), F.col("edited")), 8).alias("ratio"))


@query(f"select doc_id, edited_hash from ({_runs_sql(_in(perturb.DETERMINERS), chr(39) * 2, 'ltrim($x)')}) union all select doc_id, edited_hash from ({_runs_sql(_in(perturb.FUNCTION_WORDS), TWICE.replace('s[i + 1]', 'p[i]'))})")
def rebuilt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made of the clean ones and the changed spans alone."""
    docs = documents(spark, sf_dir)
    rows = [f(docs, "doc_id", "n", RATE, SEED).select("doc_id", F.sha2(T.apply_spans(F.col("n"), F.col("spans")), 256).alias("edited_hash")) for f in (perturb.article_delete, perturb.function_word_repeat)]
    return rows[0].unionByName(rows[1])


@query(
    f"""with a as (select doc_id, n, {S.sentences('n')} as s from {NORMAL}),
    b as (select doc_id, n, s, case doc_id % 3 when 0 then s[1] when 1 then s[len(s)] else 'a claim that nobody made here' end as quoted from a where len(s) >= 3),
    c as (select *, array_to_string(list_concat(s[1:len(s) - 1], ['It was otherwise.']), ' ') as edited from b)
    select doc_id, length(lower({S.norm('quoted')})) >= 15 and len(list_filter(list_transform(s[1:len(s) - 1], lambda x: lower({S.norm('x')})), lambda x: contains(x, lower({S.norm('quoted')})))) > 0 as anchor_ok from c"""
)
def anchor_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact leg: the quoted sentence stands unchanged in an edit that rewrote the last one."""
    rows = documents(spark, sf_dir).withColumn("s", T.sentences(F.col("n"))).where(F.size("s") >= 3)
    quoted = F.when(F.col("doc_id") % 3 == 0, F.get("s", F.lit(0))).when(F.col("doc_id") % 3 == 1, F.element_at("s", -1)).otherwise(F.lit("a claim that nobody made here"))
    edited = F.array_join(F.concat(F.slice("s", F.lit(1), F.size("s") - 1), F.array(F.lit("It was otherwise."))), " ")
    evidence = F.concat(F.lit('ANCHOR: "'), quoted, F.lit('" || NEW: it'))
    return rows.select("doc_id", quality.anchor_exact(evidence, edited, F.col("n")).alias("anchor_ok"))


@query()
def anchor_gate_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both legs, with quotes that differ in a word."""
    rows = documents(spark, sf_dir).withColumn("s", T.sentences(F.col("n"))).where(F.size("s") >= 3)
    quoted = F.concat(F.get("s", F.lit(0)), F.when(F.col("doc_id") % 2 == 0, F.lit(" so")).otherwise(F.lit(" and much else that was never said in this passage at all")))
    rows = rows.select("doc_id", F.concat(F.lit('ANCHOR: "'), quoted, F.lit('"')).alias("evidence"), F.array_join(F.slice("s", F.lit(1), F.size("s") - 1), " ").alias("edited"), "n")
    return quality.anchor_survives(rows, "evidence", "edited", "n").select("doc_id", "anchor_ok")


def _layers(docs: DataFrame) -> list[corpus.Layer]:
    return [
        corpus.Layer("web", docs.where("lang = 'en'"), "doc_id", "en", limit=200, least_words=50),
        corpus.Layer("more", docs.where("lang in ('en', 'fr')"), "doc_id", "mixed", least_words=20),
        corpus.Layer("rest", docs, "doc_id", "any", limit=150),
    ]


def _recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    base = docs.where("source = 'src0'").select("text", F.col("lang").alias("domain"), F.lit("base").alias("kind"), F.col("doc_id").alias("ordinal"))
    return corpus.assemble(base, _layers(docs), table(spark, sf_dir, "benchmark"))


def _recipe_sql() -> str:
    out = [f"with d as (select doc_id, lang, source, {S.key('text')} as k, len({S.pieces('n')}) as w from {NORMAL}), ban as (select distinct {S.key('text')} as k from benchmark), o0 as (select doc_id as ordinal, lang as domain, 'base' as kind, -1 as layer, 'added' as status, k from d where source = 'src0')"]
    for i, (kind, where, domain, limit, least) in enumerate([("web", "lang = 'en'", "en", 200, 50), ("more", "lang in ('en', 'fr')", "mixed", None, 20), ("rest", "true", "any", 150, 0)], 1):
        seen = " union ".join(f"select k from o{j} where status = 'added'" for j in range(i))
        out.append(f"s{i} as ({seen})")
        out.append(f"a{i} as (select *, (w = 0 or w < {least}) as short, k in (select k from ban) as banned, k in (select k from s{i}) as seen from d where {where})")
        out.append(f"b{i} as (select *, row_number() over (partition by k, (short or banned or seen) order by doc_id) as nth from a{i})")
        out.append(f"c{i} as (select *, case when short then 'short' when banned then 'banned' when seen or nth > 1 then 'dup' else 'added' end as status from b{i})")
        out.append(f"e{i} as (select *, coalesce(sum((status = 'added')::int) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as already from c{i})")
        out.append(f"o{i} as (select doc_id as ordinal, '{domain}' as domain, '{kind}' as kind, {i - 1} as layer, status, k from e{i}{f' where already < {limit}' if limit else ''})")
    return ", ".join(out) + ", o as (select * from o0 union all select * from o1 union all select * from o2 union all select * from o3)"


RECIPE_SQL = _recipe_sql()


@query(
    " union all ".join(f"select {i} as layer, '{kind}' as kind, '{domain}' as domain, {least} as least_words, {most}::int as most, count(*) as n_rows, count(*) filter (where text <> '') as n_texts from documents where {where}" for i, (kind, domain, least, most, where) in enumerate([("web", "en", 50, 200, "lang = 'en'"), ("more", "mixed", 20, "null", "lang in ('en', 'fr')"), ("rest", "any", 0, 150, "true")]))
)
def recipe_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recipe would read, layer by layer."""
    return corpus.dry_run(_layers(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")))


@query(f"{RECIPE_SQL} select ordinal, domain, kind, layer, status from o")
def corpus_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recipe(spark, sf_dir).select("ordinal", "domain", "kind", "layer", "status")


@query(f"{RECIPE_SQL} select kind, status, count(*) as n from o group by kind, status")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recipe(spark, sf_dir).groupBy("kind", "status").agg(F.count("*").alias("n"))


@query("select doc_id, lang from (select *, row_number() over (partition by lang order by sha256('99:' || lang || ':' || doc_id), doc_id) as k from documents where lang <> 'es') where k <= (case lang when 'en' then 100 when 'fr' then 40 else 1000000 end)")
def cap_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cap_kinds(table(spark, sf_dir, "documents").select("doc_id", "lang"), {"en": 100, "fr": 40}, "lang", "doc_id", 99, ("es",))


@query("select doc_id, unnest(range(1, greatest(1, case lang when 'fr' then 3 else 1 end, case source when 'src1' then 2 else 1 end) + 1)) as copy from documents")
def row_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.repeats(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), {"fr": 3}, {"src1": 2}, "lang", "source").select("doc_id", F.col("copy").cast("long").alias("copy"))


@query("with r as (select doc_id, lang, row_number() over (partition by lang order by sha256('3:' || lang || ':' || doc_id), doc_id) - 1 as n from documents) select doc_id, (n // 16)::int as block, (n % 16)::int as in_block, sha256('3b:' || lang || ':' || (n // 16)) as block_rank from r")
def block_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.block_order(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 16, 3).select("doc_id", "block", "in_block", "block_rank")


@query("with b as (select item_id from benchmark), c as (select item_id, unnest(range(0, 3)) as cycle from b), r as (select *, row_number() over (partition by cycle order by sha256('11:' || cycle || ':' || item_id), item_id) - 1 as k, (select count(*) from b) as n from c) select (cycle * (n // 12) + k // 12)::int as draw, item_id from r where k < (n // 12) * 12 and cycle * (n // 12) + k // 12 < 2 * (n // 12) + 1")
def next_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id")
    n = items.count()
    return sampling.next_walk(items, "item_id", 12, 2 * (n // 12) + 1, 11, n)


@query(
    f"with t as (select doc_id, list_append({S.pieces('n')}, '<e>') as t from {NORMAL}), f as (select row_number() over (order by doc_id, i) - 1 as o, tok from (select doc_id, unnest(t) as tok, generate_subscripts(t, 1) as i from t)), m as (select count(*) as total from f) select o // 512 as window, sha256(coalesce(string_agg(tok, ' ' order by o) filter (where tok <> '<e>'), '')) as text_hash from f, m where (o // 512 + 1) * 512 < total group by o // 512"
)
def packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = corpus.packed_windows(documents(spark, sf_dir).select("doc_id", "n"), ["doc_id"], T.split_words(F.col("n")), 512, "<e>")
    return out.select("window", F.sha2("text", 256).alias("text_hash"))


def _layer_edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf_dir)
    parents = docs.select(F.col("doc_id").alias("parent_id"), F.col("n").alias("text"), F.col("lang").alias("domain"))
    edits = None
    for i, (family, rows) in enumerate({"repeat": perturb.sentence_repeat(docs, "doc_id", "n", RATE, SEED), "permute": perturb.sentence_permute(docs, "doc_id", "n", RATE, SEED), "benign_paraphrase": docs.withColumn("edited", F.concat("n", F.lit(" Indeed.")))}.items()):
        part = rows.select(F.col("doc_id").alias("parent_id"), F.lit(family).alias("family"), (F.col("doc_id") * 10 + i).alias("ordinal"), F.col("edited").alias("text"))
        edits = part if edits is None else edits.unionByName(part)
    return parents, edits


@query(f"with {_places()}, o as (select doc_id, n, array_to_string(list_transform(range(0, len(s)), lambda i: case when list_contains(c, i) then {TWICE} else s[i + 1] end), ' ') as edited from c) select doc_id, sha256(edited) as rebuilt_hash, true as fits from o")
def changed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans found between texts and their edits turn the one into the other; they lie apart, in order, and each changes something."""
    rows = cut(perturb.sentence_repeat(documents(spark, sf_dir), "doc_id", "n", RATE, SEED).select("doc_id", "n", "edited"))
    rows = cut(rows.select("doc_id", "n", T.changed_spans("n", "edited").alias("spans")))
    before = lambda s, i: (i == 0) | (F.get("spans", i - 1)["end"] < s["start"])
    fits = F.forall(F.transform("spans", lambda s, i: before(s, i) & (s["before"] != s["after"])), lambda x: x)
    return rows.select("doc_id", F.sha2(T.apply_spans(F.col("n"), F.col("spans")), 256).alias("rebuilt_hash"), fits.alias("fits"))


def _layer_sql() -> str:
    repeat = f"with {_places()} select doc_id, array_to_string(list_transform(range(0, len(s)), lambda i: case when list_contains(c, i) then {TWICE} else s[i + 1] end), ' ') as edited from c"
    permute = f"""with {_places(least=2)}, d as (select doc_id, s, case when len(e) >= 2 then c else [] end as c from c), f as (select *, list_transform(c, lambda i: s[i + 1]) as items from d), g as (select *, {_mixed('items', f'{SEED}p', "'s'")} as m from f)
    select doc_id, array_to_string(list_transform(range(0, len(s)), lambda i: coalesce(m[list_position(c, i)], s[i + 1])), ' ') as edited from g"""
    return f"""with ed as (select doc_id, 'repeat' as family, doc_id * 10 as ordinal, edited from ({repeat}) union all select doc_id, 'permute', doc_id * 10 + 1, edited from ({permute}) union all select doc_id, 'benign_paraphrase', doc_id * 10 + 2, n || ' Indeed.' from {NORMAL}),
    tot as (select greatest(1, round_even(0.1 * count(*), 0))::bigint as most from documents),
    tr as (select doc_id, n, lang from (select *, row_number() over (order by sha256('23:' || doc_id), doc_id) as r from {NORMAL}), tot where r > most),
    ch as (select ed.* from ed join tr using (doc_id) where {S.norm('edited')} <> {S.norm('n')}),
    ha as (select *, row_number() over (partition by family order by sha256('23:' || family || ':' || doc_id || ':' || ordinal), doc_id, ordinal) as k from ch where family <> 'benign_paraphrase'),
    al as (select n as text, lang as domain, 'clean_parent' as kind, 0 as o1, doc_id::varchar as o2, 0 as o3 from tr union all select edited, 'perturbed', 'pert_' || family, 1, family, k from ha where k <= 60 union all select edited, 'perturbed', family, 2, doc_id::varchar, ordinal from ch where family = 'benign_paraphrase'),
    nth as (select *, row_number() over (partition by {S.key('text')} order by o1, o2, o3) as nth from al)
    select sha256(text) as text_hash, domain, kind from nth where nth = 1"""


@query(_layer_sql())
def edit_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, edits = _layer_edits(spark, sf_dir)
    return corpus.edit_layer(parents, edits, 0.1, 60, 23).select(F.sha2("text", 256).alias("text_hash"), "domain", "kind")


@query("with n as (select greatest(1, round_even(0.1 * count(*), 0))::bigint as k from documents) select doc_id from (select doc_id, row_number() over (order by sha256('23:' || doc_id), doc_id) as r from documents), n where r <= k")
def probe_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded tenth of the documents, a sampling operator."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sampling.sample(docs, max(1, round(0.1 * docs.count())), ["doc_id"], 23)


@query("with f as (select doc_id, source, row_number() over (partition by source order by sha256('29:' || source || ':' || doc_id), doc_id) as k from documents) select doc_id, source from f where k <= 12")
def family_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.withColumn("k", sampling.rank(["source"], 29, ["doc_id"])).where("k <= 12").drop("k")


@query("select doc_id::varchar || ':' || f || ':' || s || coalesce(':' || p, '') as sample_id, f as perturbation, s as severity, p as position from documents, (select unnest(['causal_reverse', 'topic_drift']) as f), (select unnest(['mild', 'severe']) as s), (select unnest(['early', 'late', null]) as p)")
def edit_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with each family, severity and position: a product with a table of fixed size."""
    spec = [(f, s, p) for f in ("causal_reverse", "topic_drift") for s in ("mild", "severe") for p in ("early", "late", None)]
    tasks = spark.createDataFrame(spec, "perturbation string, severity string, position string")
    rows = table(spark, sf_dir, "documents").select("doc_id").crossJoin(F.broadcast(tasks))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "perturbation", F.lit(":"), "severity", F.coalesce(F.concat(F.lit(":"), "position"), F.lit(""))).alias("sample_id"), "perturbation", "severity", "position")


def _record_sql(rule: str, severity: str, rate: float) -> str:
    """SQL for the records of one rule and severity."""
    tail, seed = f":{rule}:{severity}", f"{SEED}:{rule}:{severity}"
    if rule == "case_lower":
        made = f"select doc_id, n, lower(n) as edited, 1.0::double as realized, 1 as n_spans from {NORMAL}"
    elif rule == "sentence_repeat":
        made = f"with {_places(seed=seed, rate=rate)} select doc_id, n, array_to_string(list_transform(range(0, len(s)), lambda i: case when list_contains(c, i) then {TWICE} else s[i + 1] end), ' ') as edited, len(c) / greatest(len(s), 1) as realized, len(c) as n_spans from c"
    else:
        made = f"""with {_places(least=2, seed=seed, rate=rate)}, d as (select doc_id, n, s, case when len(e) >= 2 then c else [] end as c from c), f as (select *, list_transform(c, lambda i: s[i + 1]) as items from d),
        g as (select *, {_mixed('items', f'{seed}p', "'s'")} as m from f)
        select doc_id, n, array_to_string(list_transform(range(0, len(s)), lambda i: coalesce(m[list_position(c, i)], s[i + 1])), ' ') as edited, len(c) / greatest(len(s), 1) as realized, len(list_filter(c, lambda i: m[list_position(c, i)] <> s[i + 1])) as n_spans from g"""
    return f"""select doc_id || '{tail}' as sample_id, doc_id::varchar as parent_sample_id, '{rule}' as perturbation, '{severity}' as severity, {rate}::double as requested_rate, round(realized, 8) as realized_rate, sha256(edited) as text_hash,
    len({S.words('edited')})::int as word_count, len({S.sentences(S.norm('edited'))})::int as sentence_count, n_spans::int as n_spans, true as rebuilt from ({made}) where edited <> n"""


RECORDS = {"sentence_repeat": {"mild": 0.1, "severe": 0.5}, "sentence_permute": {"mild": 0.2}, "case_lower": {"all": 1.0}}


@query(" union all ".join(_record_sql(r, s, x) for r, severities in RECORDS.items() for s, x in severities.items()))
def rule_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of several rules and severities, without those that change nothing."""
    out = perturb.rule_records(documents(spark, sf_dir), "doc_id", "n", RECORDS, SEED)
    rebuilt = T.apply_spans(F.col("clean_text"), F.col("changed_spans")) == F.col("perturbed_text")
    return out.select("sample_id", "parent_sample_id", "perturbation", "severity", "requested_rate", F.round("realized_rate", 8).alias("realized_rate"), "text_hash", "word_count", "sentence_count", F.size("changed_spans").alias("n_spans"), rebuilt.alias("rebuilt"))
