"""The jobs as queries: each runs twice into a new folder and gives what stands there afterwards."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from corvane.operators import conditions
from corvane.plans import sqltext as S
from corvane.plans.edits import _ascii, _mixed, _places, _pool_sql, _start
from corvane.plans.texts import NORMAL
from corvane.registry import query
from corvane.sources.shared import scratch

from . import common, counterfactual_set, source_pool

POOL = common.defaults(source_pool.CONFIG)
SET = common.defaults(counterfactual_set.CONFIG)


def _viable(settings: dict) -> str:
    return f"(n <> '' and {S.english('n')} and len({S.sentences('n')}) >= {settings['least_sentences']} and len({S.words('n')}) between {settings['least_words']} and {settings['most_words']})"


_POOL_SQL = f"""with d as (select doc_id, source, coalesce(nullif(lang, ''), 'none') as domain, n, coalesce({_viable(POOL)}, false) as ok from {NORMAL}),
k as (select *, case when ok then {S.key('n')} end as key from d), bk as (select distinct {S.key('text')} as key from benchmark),
bg as (select distinct unnest({S.grams('text', POOL['gram'])}) as g from benchmark),
hit as (select distinct doc_id from (select doc_id, unnest({S.grams('n', POOL['gram'])}) as g from k where ok) where g in (select g from bg)),
s as (select k.*, bk.key is not null as exact, hit.doc_id is not null as gram from k left join bk using (key) left join hit using (doc_id)),
r as (select *, row_number() over (partition by key, ok and not exact and not gram order by doc_id) as nth from s),
t as (select *, case when not ok then 'not_viable' when exact then 'eval_exact' when gram then 'eval_ngram' when nth > 1 then 'duplicate' else 'admit' end as status from r)
select doc_id, source, key, case when status = 'admit' then n end as text, case when status = 'admit' then case when ('0x' || substr(sha256('{POOL['seed']}:' || key), 1, 8))::bigint % 10000 < {round(POOL['val_share'] * 10_000)} then 'val' else 'pool' end end as part, 0::bigint as batch, status, domain from t"""


@query(_POOL_SQL)
def job1_source_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions about all documents; the second run finds nothing new."""
    at, root = scratch(spark, "job1"), sf_dir.rstrip("/")
    for _ in range(2):
        told = source_pool.run(spark, f"{root}/documents.parquet", f"{root}/benchmark.parquet", f"{at}/out", f"{at}/checkpoint")
    return told


def _rule_sql(rule: str, seed: str, rate: float) -> str:
    """(doc_id, edited, realized) of a rule over the parents."""
    if rule == "sentence_repeat":
        return f"with {_places(seed=seed, rate=rate, texts='par')} select doc_id, n, len(c) / greatest(len(s), 1) as realized, array_to_string(list_transform(range(0, len(s)), lambda i: case when list_contains(c, i) then s[i + 1] || ' ' || s[i + 1] else s[i + 1] end), ' ') as edited from c"
    if rule == "sentence_permute":
        return f"""with {_places(least=2, seed=seed, rate=rate, texts='par')}, d as (select doc_id, n, s, e, case when len(e) >= 2 then c else [] end as c from c),
        f as (select *, list_transform(c, lambda i: s[i + 1]) as items from d), g as (select *, {_mixed('items', f'{seed}p', "'s'")} as m from f)
        select doc_id, n, len(c) / greatest(len(s), 1) as realized, array_to_string(list_transform(range(0, len(s)), lambda i: coalesce(m[list_position(c, i)], s[i + 1])), ' ') as edited from g"""
    assert rule == "local_shuffle"
    return f"""with {_places(fits=f"len({_ascii('s[i + 1]')}) >= 5", seed=seed, rate=rate, texts='par')},
    u as (select doc_id, i, {_ascii('s[i + 1]')} as p from (select doc_id, s, unnest(c) as i from c)),
    v as (select *, len(p) // 2 as k, least(4, len(p) // 2) as w from u), x as (select *, {_start(f'{seed}w', 'i', 'k - w + 1')} as st from v),
    y as (select *, list_transform(range(0, w), lambda j: p[2 * (st + j) + 2]) as items from x), z as (select *, {_mixed('items', f'{seed}l', 'i')} as m from y),
    r as (select doc_id, i, array_to_string(list_transform(range(0, len(p)), lambda j: case when j % 2 = 1 and j // 2 >= st and j // 2 < st + w then m[j // 2 - st + 1] else p[j + 1] end), '') as sent from z),
    q as (select doc_id, map(list(i), list(sent)) as d from r group by doc_id)
    select c.doc_id, n, len(c) / greatest(len(e), 1) as realized, array_to_string(list_transform(range(0, len(s)), lambda i: coalesce(d[i], s[i + 1])), ' ') as edited from c left join q using (doc_id)"""


def _splice_rows_sql(tag: str, pool: str, seed: str, rate: float) -> str:
    """The same of sentences spliced in from a pool."""
    return f"""with {_places(seed=seed, rate=rate, texts='par')}, k as (select doc_id, n, s, e, case when len(s) >= 2 then c else [] end as c from c),
    p as (select sentence, row_number() over (order by sentence) - 1 as nth from ({pool})),
    dr as (select doc_id, map(list(i), list(sentence)) as d from (select doc_id, i, ('0x' || substr(sha256('{seed}d{tag}:' || doc_id || ':' || i), 1, 15))::bigint % (select count(*) from p) as nth from (select doc_id, unnest(c) as i from k)) join p using (nth) group by doc_id),
    g as (select k.doc_id, n, s, list_filter(c, lambda i: d[i] <> s[i + 1]) as c, d from k left join dr using (doc_id))
    select doc_id, n, len(coalesce(c, [])) / greatest(len(s), 1) as realized, array_to_string(list_transform(range(0, len(s)), lambda i: case when list_contains(coalesce(c, []), i) then d[i] else s[i + 1] end), ' ') as edited from g"""


def _set_sql() -> str:
    seed, parts = SET["seed"], ["select 'clean_candidates' as condition, doc_id, n as text, 0.0::double as realized_rate from par"]
    put = lambda name, sql: parts.append(f"select '{name}' as condition, doc_id, edited as text, round(realized, 3) as realized_rate from ({sql}) where edited <> n")
    for spec in SET["rule_families"]:
        for dose in SET["rule_doses"]:
            put(conditions.named(spec["alias"], dose), _rule_sql(spec["rule"], f"{seed}:{spec['rule']}:r{dose}", dose))
    for family, sources in (("generated_splice", SET["splice_generated"]), ("human_splice", SET["splice_human"])):
        pool = _pool_sql(" or ".join(f"source = '{s}'" for s in sources))
        for dose in SET["splice_doses"]:
            put(conditions.named(family, dose), _splice_rows_sql(family, pool, f"{seed}:splice:r{dose}", dose))
    plan = ", ".join(f"('{p['condition']}', '{p['family']}', '{p['group']}', '{p['kind']}', '{p['role']}', {p['dose']}::double, '{p['dose_kind']}')" for p in conditions.planned(SET))
    return f"""with par as materialized (select doc_id, n from {NORMAL} where {_viable(SET)}), rows as materialized ({' union all '.join(parts)}),
    counted as (select condition, count(*) as n from rows group by condition), plan(condition, family, "group", kind, role, dose, dose_kind) as (values {plan}),
    x as (select count(*) as n, coalesce(bit_xor(('0x' || substr(sha256(doc_id || ':' || n), 1, 15))::bigint), 0) as x from par)
    select condition, doc_id::varchar as parent_id, text, realized_rate, substr(sha256({S.q(json.dumps(SET, sort_keys=True))} || ':' || x.n || ':' || x.x), 1, 16) as set_id, family, "group", kind, role, dose, dose_kind, counted.n from rows join counted using (condition) join plan using (condition), x"""


@query(_set_sql())
def job2_counterfactual_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the set with their conditions; the second run finds it whole."""
    at = scratch(spark, "job2")
    for _ in range(2):
        made = counterfactual_set.run(spark, f"{sf_dir.rstrip('/')}/documents.parquet", f"{at}/out")
    return counterfactual_set.read_set(spark, f"{at}/out", made)
