"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

from corvane.functions.text import IRREGULAR, RUN, SPACES, TOKEN, WORD


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(t: str) -> str:
    return f"trim(regexp_replace({t}, '[{SPACES}]+', ' ', 'g'))"


def words(t: str) -> str:
    return f"regexp_extract_all({t}, {q(WORD)})"


def tokens(t: str) -> str:
    return f"regexp_extract_all({t}, {q(TOKEN)})"


def sentences(n: str) -> str:
    """Of a normalized text."""
    return rf"list_filter(string_split(regexp_replace({n}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


def pieces(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda x: x <> '')"


def latin(t: str) -> str:
    return rf"(length(regexp_replace({t}, '[^\p{{Latin}}]', '', 'g'))::double / nullif(length(regexp_replace({t}, '[^\p{{L}}]', '', 'g')), 0))"


def english(t: str) -> str:
    return f"coalesce({latin(t)} >= 0.85, false)"


def key(t: str) -> str:
    return f"sha256(lower({norm(t)}))"


def fold(t: str) -> str:
    """In folded case, for the letters that are in the tables."""
    return f"replace(replace(lower({t}), 'ß', 'ss'), 'ς', 'σ')"


def runs(n: str) -> str:
    """Separators and runs, by turns."""
    return rf"string_split(regexp_replace({n}, {q(RUN)}, chr(1) || '\0' || chr(1), 'g'), chr(1))"


def choose(n: str, rate: float) -> str:
    return f"(case when {n} = 0 then 0 else least({n}, greatest(1, ceil({n} * {rate})::int)) end)"


def grams(t: str, n: int = 13) -> str:
    w = pieces(norm(f"lower({t})"))
    return f"(select list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) from (select {w} as w))"


def like_case(before: str, after: str) -> str:
    return f"(case when {before} = upper({before}) and {before} <> lower({before}) then upper({after}) when left({before}, 1) = upper(left({before}, 1)) and left({before}, 1) <> lower(left({before}, 1)) then upper(left({after}, 1)) || lower(substr({after}, 2)) else {after} end)"


def inflection(w: str) -> str:
    low = f"lower({w})"
    odd = " ".join(f"when {low} = '{k}' then '{v}'" for k, v in IRREGULAR.items())
    cut = lambda k: f"left({low}, length({low}) - {k})"
    n = f"length({low})"
    told = f"(case {odd} when {low} like '%ies' and {n} > 4 then {cut(3)} || 'y' when {low} like '%s' and {n} > 3 and {low} not like '%ss' then {cut(1)} when {low} like '%ed' and {n} > 4 then {cut(2)} when {low} like '%ing' and {n} > 5 then {cut(3)} || 's' when {n} > 3 then {low} || 's' end)"
    return like_case(w, told)
