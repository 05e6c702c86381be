"""Seeded edits of texts. Each gives the edited text, the numbers of eligible and edited places, the realized rate and
the changed spans (start, end, before, after) of the normalized text, in order.

A normalized text is cut into separators and runs of word characters by turns, or into sentences; the
eligible places are ordered by a hash of seed, text id and place, the first ones at the rate are
edited, and the pieces are joined again. Everything is one expression over a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.sources.shared import stored
from corvane.sources.tables import PASSAGE

from .sampling import choose_count, third

#: Words that edits look for.
DETERMINERS = ("a", "an", "the", "this", "that", "these", "those", "each", "every", "some", "any")
FUNCTION_WORDS = ("a", "an", "the", "this", "that", "these", "those", "and", "or", "but", "if", "because", "of", "to", "in", "on", "at", "for", "from", "with", "by")
SUBJECTS = ("he", "she", "it", "this", "that", "they", "we", "these", "those")
VERBS = {"is": "are", "are": "is", "has": "have", "have": "has", "does": "do", "do": "does"}


def runs(normal: Column) -> Column:
    """Separators (even places from 0) and runs of word characters (odd places) by turns."""
    return F.split(F.regexp_replace(normal, f"({T.RUN})", f"{T.SPLIT}$1{T.SPLIT}"), T.SPLIT, -1)


def chosen(eligible: Column, seed: int | str, key: Column, count: Column) -> Column:
    """Of an array of places the `count` first in seeded order, ascending."""
    keyed = F.sort_array(F.transform(eligible, lambda i: F.struct(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), i.cast("string")), 256).alias("h"), i.alias("i"))))
    return F.sort_array(F.transform(F.slice(keyed, F.lit(1), count), lambda x: x["i"]))


def _places(parts: Column, test) -> Column:
    """The odd places whose run passes the test, which gets the parts, the place and the run."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), lambda i: (i < F.size(parts)) & test(parts, i, F.get(parts, i)))


def edit_runs(docs: DataFrame, key: str, normal: str, rate: float, seed: int | str, test, change, after=None, position: str | None = None) -> DataFrame:
    """docs with n_eligible, n_edited, realized, edited and spans. change(run) gives the new run; after(separator) what becomes of the one behind it.

    position: the third of the text in which the middle of an edited run lies. Parts and places are bound within one
    expression: as columns, they could be carried into the functions over their elements and be computed for each.
    """
    begin = lambda p, i: F.length(F.array_join(F.slice(p, F.lit(1), i), ""))

    def placed(p: Column, i: Column, w: Column) -> Column:
        if position in (None, "uniform"):
            return test(p, i, w)
        return test(p, i, w) & T.let(begin(p, i), lambda at: third(at, at + F.length(w), F.length(normal), position))

    taken = 1 if after is None else 2  # parts that an edit uses up: the run, and the separator behind it

    def edited(p: Column, e: Column, c: Column) -> Column:
        """Joined from the stretches between chosen places, each of which is read once: time grows with the parts, not with their product with the places."""
        behind = lambda j: F.coalesce(F.get(c, j) + taken, F.lit(0))  # noqa: E731  where the stretch after the j-th place begins
        stretch = F.transform(c, lambda i, j: F.array_join(F.slice(p, behind(j - 1) + 1, i - behind(j - 1)), ""))
        rest = F.array_join(F.slice(p, behind(F.size(c) - 1) + 1, F.size(p)), "")

        def new(i: Column) -> Column:
            return change(F.get(p, i)) if after is None else F.concat(change(F.get(p, i)), after(F.get(p, i + 1)))

        def used(i: Column) -> Column:
            return F.length(F.get(p, i)) if after is None else F.length(F.get(p, i)) + F.length(F.get(p, i + 1))

        def starts(g: Column) -> Column:
            state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
            sizes = F.transform(c, lambda i, j: F.struct(F.length(F.get(g, j)).alias("gap"), used(i).alias("own")))
            return F.aggregate(sizes, state, lambda a, x: F.struct((a["at"] + x["gap"] + x["own"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["gap"])).alias("out")))["out"]

        def span(i: Column, at: Column) -> Column:
            before = F.get(p, i)
            if after is not None:  # what goes of the separator
                gap = F.get(p, i + 1)
                before = F.concat(before, F.substr(gap, F.lit(1), F.length(gap) - F.length(after(gap))))
            return T.let(before, lambda x: F.struct(at.alias("start"), (at + F.length(x)).alias("end"), x.alias("before"), change(F.get(p, i)).alias("after")))

        def made(g: Column) -> Column:
            text = F.concat(F.array_join(F.transform(c, lambda i, j: F.concat(F.get(g, j), new(i))), ""), rest)
            spans = T.let(starts(g), lambda z: F.transform(c, lambda i, j: span(i, F.get(z, j))))
            return F.struct(F.size(e).cast("long").alias("n_eligible"), F.size(c).cast("long").alias("n_edited"), text.alias("edited"), spans.alias("spans"))

        return T.let(stretch, made)

    told = T.let(runs(F.col(normal)), lambda p: T.let(_places(p, placed), lambda e: T.let(chosen(e, seed, F.col(key), choose_count(F.size(e), rate)), lambda c: edited(p, e, c))))
    rows = docs.withColumn("__r", told).withColumns({n: F.col(f"__r.{n}") for n in ("n_eligible", "n_edited", "edited", "spans")}).drop("__r")
    return rows.withColumn("realized", F.col("n_edited") / F.greatest("n_eligible", F.lit(1)))


def article_delete(docs: DataFrame, key: str, normal: str, rate: float, seed: int | str, position: str | None = None) -> DataFrame:
    """Determiners go, with the space behind them."""
    return edit_runs(docs, key, normal, rate, seed, lambda p, i, w: F.lower(w).isin(*DETERMINERS), lambda w: F.lit(""), lambda s: F.ltrim(s), position)


def function_word_repeat(docs: DataFrame, key: str, normal: str, rate: float, seed: int | str, position: str | None = None) -> DataFrame:
    """Function words stand twice."""
    return edit_runs(docs, key, normal, rate, seed, lambda p, i, w: F.lower(w).isin(*FUNCTION_WORDS), lambda w: F.concat(w, F.lit(" "), w), position=position)


def agreement_error(docs: DataFrame, key: str, normal: str, rate: float, seed: int | str, position: str | None = None) -> DataFrame:
    """Verbs right behind a pronoun change their number."""
    other = F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv])
    def test(p: Column, i: Column, w: Column) -> Column:
        return F.lower(w).isin(*VERBS) & (i >= 3) & (F.get(p, i - 1) == " ") & F.lower(F.get(p, i - 2)).isin(*SUBJECTS)

    return edit_runs(docs, key, normal, rate, seed, test, lambda w: T.like_case(w, other[F.lower(w)]), position=position)


def inflection_error(docs: DataFrame, key: str, normal: str, rate: float, seed: int | str, position: str | None = None) -> DataFrame:
    """Words of ASCII letters take a wrong form. Words joined by apostrophes or hyphens count part by part."""
    test = lambda p, i, w: F.regexp_like(w, F.lit("^[A-Za-z]+$")) & T.wrong_inflection(w).isNotNull()
    return edit_runs(docs, key, normal, rate, seed, test, T.wrong_inflection, position=position)


def case_lower(docs: DataFrame, normal: str) -> DataFrame:
    """All letters small; realized is 0 where nothing changes. One span holds the whole text."""
    whole = F.struct(F.lit(0).alias("start"), F.length(normal).alias("end"), F.col(normal).alias("before"), F.lower(normal).alias("after"))
    spans = F.when(F.lower(normal) != F.col(normal), F.array(whole)).otherwise(F.slice(F.array(whole), 1, 0))
    return docs.withColumn("edited", F.lower(normal)).withColumn("spans", spans).withColumn("n_edited", (F.col("edited") != F.col(normal)).cast("long")).withColumn("realized", F.col("n_edited").cast("double"))


def with_sentences(docs: DataFrame, key: str, normal: str, rate: float, seed: int | str, position: str | None = None, least: int = 1, fits=None) -> DataFrame:
    """docs with __s (sentences), __e (eligible places from 0) and __c (chosen places)."""
    def eligible(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        if fits is not None:
            places = F.filter(places, lambda i: fits(F.get(s, i)))
        if position in (None, "uniform"):
            return places
        # spans of sentences joined by single spaces
        ends = F.aggregate(s, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1) + 1, F.lit(0)) + F.length(x))))
        return T.let(ends, lambda z: F.filter(places, lambda i: third(F.get(z, i) - F.length(F.get(s, i)), F.get(z, i), F.length(normal), position)))

    count = lambda e: F.least(F.size(e), F.greatest(F.lit(least), choose_count(F.size(e), rate)))
    told = T.let(T.sentences(F.col(normal)), lambda s: T.let(eligible(s), lambda e: F.struct(s.alias("s"), e.alias("e"), chosen(e, seed, F.col(key), count(e)).alias("c"))))
    rows = docs.withColumn("__w", told)
    return rows.withColumns({"__s": F.col("__w.s"), "__e": F.col("__w.e"), "__c": F.col("__w.c")}).drop("__w")


def _done(rows: DataFrame, new: Column, realized: Column) -> DataFrame:
    """rows of with_sentences() with what an edit gives; new: the sentences afterwards."""

    def span(i: Column, n: Column) -> Column:
        at = F.length(F.array_join(F.slice("__s", F.lit(1), i), " ")) + F.least(i, F.lit(1))
        return T.let(at, lambda x: F.struct(x.alias("start"), (x + F.length(F.get("__s", i))).alias("end"), F.get("__s", i).alias("before"), F.get(n, i).alias("after")))

    both = T.let(new, lambda n: F.struct(F.array_join(n, " ").alias("edited"), F.transform(F.filter("__c", lambda i: F.get(n, i) != F.get("__s", i)), lambda i: span(i, n)).alias("spans")))
    rows = rows.withColumn("__n", both).withColumns({n: F.col(f"__n.{n}") for n in ("edited", "spans")})
    return rows.withColumn("n_eligible", F.size("__e").cast("long")).withColumn("n_edited", F.size("__c").cast("long")).withColumn("realized", realized).drop("__s", "__e", "__c", "__n")


def sentence_repeat(docs: DataFrame, key: str, normal: str, rate: float, seed: int | str, position: str | None = None) -> DataFrame:
    """Chosen sentences stand twice; realized by all sentences."""
    rows = with_sentences(docs, key, normal, rate, seed, position)
    new = F.transform("__s", lambda s, i: F.when(F.array_contains("__c", i), F.concat(s, F.lit(" "), s)).otherwise(s))
    return _done(rows, new, F.size("__c") / F.greatest(F.size("__s"), F.lit(1)))


def _shuffled(items: Column, seed: str, key: Column, tag: Column) -> Column:
    """Items in seeded order of their places; where that leaves them as they are, turned by one."""
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), tag.cast("string"), F.lit(":"), i.cast("string")), 256).alias("h"), x.alias("x"))))
    mixed = F.transform(keyed, lambda k: k["x"])
    turned = F.concat(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 1, 1))
    return T.let(mixed, lambda m: F.when(m == items, turned).otherwise(m))


def sentence_permute(docs: DataFrame, key: str, normal: str, rate: float, seed: int | str, position: str | None = None) -> DataFrame:
    """Two or more chosen sentences change places among themselves; texts with fewer eligible ones stay."""
    rows = with_sentences(docs, key, normal, rate, seed, position, least=2)
    rows = rows.withColumn("__c", F.when(F.size("__e") >= 2, F.col("__c")).otherwise(F.array().cast("array<int>")))
    mixed = T.let(F.transform("__c", lambda i: F.get("__s", i)), lambda items: _shuffled(items, f"{seed}p", F.col(key), F.lit("s")))
    new = T.let(mixed, lambda m: F.transform("__s", lambda s, i: F.coalesce(F.get(m, F.array_position("__c", i).cast("int") - 1), s)))
    return _done(rows, new, F.size("__c") / F.greatest(F.size("__s"), F.lit(1)))


def _ascii(s: Column) -> Column:
    """Pieces of a sentence between spaces, as what an edit of words moves: word and the rest stay together where marks follow."""
    return F.split(F.regexp_replace(s, "([A-Za-z][A-Za-z'-]*)", f"{T.SPLIT}$1{T.SPLIT}"), T.SPLIT, -1)


def _two_words(s: Column) -> Column:
    """Whether _ascii() has two words or more, five pieces; its pieces are made only where the text holds their separator."""
    return F.when(F.contains(s, F.lit(T.SPLIT)), F.size(_ascii(s)) >= 5).otherwise(F.regexp_like(s, F.lit("[A-Za-z][A-Za-z'-]*+[^A-Za-z]++[A-Za-z]")))


def _start(seed: str, key: Column, i: Column, room: Column) -> Column:
    """A seeded number from 0 to room - 1."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), i.cast("string")), 256), 1, 8), 16, 10).cast("long") % room).cast("int")


def local_shuffle(docs: DataFrame, key: str, normal: str, rate: float, seed: int | str, window: int = 4, position: str | None = None) -> DataFrame:
    """In chosen sentences of two words or more, `window` neighbouring words (ASCII letters, inner apostrophes and hyphens) are shuffled."""
    rows = with_sentences(docs, key, normal, rate, seed, position, fits=_two_words)

    def mixed(s: Column, i: Column) -> Column:
        def within(p: Column) -> Column:
            n = F.floor(F.size(p) / 2).cast("int")
            width = F.least(F.lit(window), n)
            start = _start(f"{seed}w", F.col(key), i, (n - width + 1).cast("long"))
            items = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.get(p, 2 * (start + k) + 1))
            new = T.let(items, lambda x: _shuffled(x, f"{seed}l", F.col(key), i))
            return T.let(new, lambda m: F.array_join(F.transform(p, lambda x, j: F.when((j % 2 == 1) & ((j - 1) / 2 >= start) & ((j - 1) / 2 < start + width), F.get(m, ((j - 1) / 2).cast("int") - start)).otherwise(x)), ""))

        return T.let(_ascii(s), within)

    new = F.transform("__s", lambda s, i: F.when(F.array_contains("__c", i), mixed(s, i)).otherwise(s))
    return _done(rows, new, F.size("__c") / F.greatest(F.size("__e"), F.lit(1)))


def phrase_repeat(docs: DataFrame, key: str, normal: str, rate: float, seed: int | str, position: str | None = None) -> DataFrame:
    """In chosen sentences of three words or more, a phrase of a third of the words (2 to 5) stands twice; realized is repeated words by words of the result."""
    rows = with_sentences(docs, key, normal, rate, seed, position, fits=lambda s: F.size(_ascii(s)) >= 7)
    width = lambda p: F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.floor(F.size(p) / 2) / 3).cast("int")))

    def doubled(s: Column, i: Column) -> Column:
        def within(p: Column) -> Column:
            n, w = F.floor(F.size(p) / 2).cast("int"), width(p)
            start = _start(f"{seed}r", F.col(key), i, (n - w + 1).cast("long"))
            phrase = F.array_join(F.slice(p, 2 * start + 2, 2 * w - 1), "")
            return F.concat(F.array_join(F.slice(p, F.lit(1), 2 * (start + w)), ""), F.lit(" "), phrase, F.array_join(F.slice(p, 2 * (start + w) + 1, F.size(p)), ""))

        return T.let(_ascii(s), within)

    new = F.transform("__s", lambda s, i: F.when(F.array_contains("__c", i), doubled(s, i)).otherwise(s))
    again = F.aggregate("__c", F.lit(0), lambda a, i: a + width(_ascii(F.get("__s", i))))
    rows = rows.withColumn("__w", again)
    return _done(rows, new, F.col("__w") / F.greatest(F.size(T.words(F.col("edited"))), F.lit(1))).drop("__w")


def sentence_pool(texts: DataFrame, normal: str, least: int = 20, most: int = 300) -> DataFrame:
    """(sentence) distinct, as drop-in sentences, of `least` to `most` characters in Latin script."""
    rows = texts.select(F.explode(T.sentences(F.col(normal))).alias("s")).where(F.length("s").between(least, most) & T.looks_latin(F.col("s")))
    return rows.select(T.as_sentence(F.col("s")).alias("sentence")).distinct()  # none is empty: each has letters


def numbered_pool(pool: DataFrame, order: list[str] | None = None, stretch: Column | None = None) -> tuple[DataFrame, int]:
    """pool with `n`, numbers from 0 in order (of the sentence, unless named), and how many there are.

    Stretches of the order (of the first three characters, unless given) are numbered by themselves and
    moved up by the counts of those before; only these counts meet.
    """
    order = order or ["sentence"]
    rows = pool.withColumn("__r", F.substring("sentence", 1, 3) if stretch is None else stretch)
    counts = rows.groupBy("__r").agg(F.count("*").alias("c"))
    shifts = counts.select("__r", (F.sum("c").over(Window.orderBy("__r")) - F.col("c")).alias("__shift"))
    inner = F.row_number().over(Window.partitionBy("__r").orderBy(*order)) - 1
    numbered = rows.withColumn("__in", inner).join(shifts, "__r").withColumn("n", (F.col("__in") + F.col("__shift")).cast("long")).drop("__r", "__in", "__shift")
    return numbered, pool.count()


def spliceable(docs: DataFrame, key: str, normal: str, rate: float, seed: int | str, position: str | None = None, least: int = 2) -> DataFrame:
    """docs as splice() takes them, with sentences and chosen places but without the text, which the sentences hold, as a written table: the draws are told from it, and the edits of any pool. Texts of fewer than `least` sentences have no chosen place."""
    rows = with_sentences(docs, key, normal, rate, seed, position).drop(normal)
    return stored(rows.withColumn("__c", F.when(F.size("__s") >= least, F.col("__c")).otherwise(F.array().cast("array<int>"))), "places")


def splice(docs: DataFrame, pool: DataFrame, total: int, key: str, normal: str, rate: float, seed: int | str, tag: str = "", position: str | None = None, least: int = 2, placed: DataFrame | None = None) -> DataFrame:
    """Chosen sentences replaced by sentences of a numbered pool, drawn with replacement; one that draws itself stays. Texts of fewer than `least` sentences stay.

    The same seed chooses the same places whatever the pool; `tag` names the draws. placed: spliceable() of the same, where several pools share it.
    Texts are made of their sentences behind the join, so what is shuffled holds each once.
    """
    rows = (placed if placed is not None else spliceable(docs, key, normal, rate, seed, position, least)).withColumn("__c", F.when(F.lit(total > 0), F.col("__c")).otherwise(F.array().cast("array<int>")))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}d{tag}:"), F.col(key).cast("string"), F.lit(":"), F.col("i").cast("string")), 256), 1, 15), 16, 10).cast("long") % max(total, 1)
    drawn = rows.select(key, F.explode("__c").alias("i")).withColumn("n", draw).join(pool.withColumnRenamed("sentence", "__new"), "n").select(key, F.struct("i", "__new").alias("x")).groupBy(key).agg(F.collect_list("x").alias("__d"))
    rows = rows.join(drawn, key, "left").withColumn("__d", F.map_from_entries(F.coalesce("__d", F.array().cast("array<struct<i:int,__new:string>>"))))
    rows = rows.withColumn("__c", F.filter("__c", lambda i: F.col("__d")[i] != F.get("__s", i)))
    new = F.transform("__s", lambda s, i: F.when(F.array_contains("__c", i), F.col("__d")[i]).otherwise(s))
    return _done(rows.withColumn(normal, F.array_join("__s", " ")), new, F.size("__c") / F.greatest(F.size("__s"), F.lit(1))).drop("__d")


def rewrite_sentences(docs: DataFrame, normal: str, targets: str, rewrites: str) -> DataFrame:
    """docs with `edited` and `changed`: of `rewrites` (array of index, sentence) those for target places that aren't blank and differ; the last one for a place counts."""
    rows = docs.withColumn("__s", T.sentences(F.col(normal)))
    good = F.filter(rewrites, lambda r: F.array_contains(targets, r["index"]) & (F.coalesce(F.btrim(r["sentence"]), F.lit("")) != ""))
    rows = rows.withColumn("__g", F.reverse(good))
    new = lambda i: T.normalize(F.get(F.filter("__g", lambda r: r["index"] == i), F.lit(0))["sentence"])
    rows = rows.withColumn("__n", F.transform("__s", lambda s, i: F.coalesce(new(i), s)))
    changed = F.filter(F.sequence(F.lit(0), F.greatest(F.size("__s") - 1, F.lit(0))), lambda i: F.coalesce(F.get("__n", i) != F.get("__s", i), F.lit(False)))
    return rows.withColumn("edited", F.array_join("__n", " ")).withColumn("changed", changed).drop("__s", "__g", "__n")


RULES = {"article_delete": article_delete, "inflection_error": inflection_error, "agreement_error": agreement_error, "function_word_repeat": function_word_repeat, "local_shuffle": local_shuffle, "phrase_repeat": phrase_repeat, "sentence_repeat": sentence_repeat, "sentence_permute": sentence_permute}


def rule_records(docs: DataFrame, key: str, normal: str, rules: dict[str, dict[str, float]], seed: int, done: DataFrame | None = None, positions: tuple[str | None, ...] = (None,), given: dict[str, str] | None = None) -> DataFrame:
    """A record (the columns of PASSAGE) of every rule, severity and position over every text, without those done and those that change nothing.

    done: (sample_id) of an earlier run. given: record fields that columns of docs hold. Rules without a position take each text once.
    """
    out = None
    for rule, severities in rules.items():
        for severity, rate in severities.items():
            for position in positions if rule != "case_lower" else (None,):
                tail = f":{rule}:{severity}" + (f":{position}" if position else "")
                rows = case_lower(docs, normal) if rule == "case_lower" else RULES[rule](docs, key, normal, rate, f"{seed}{tail}", position=position)
                # the number keeps the filter above the edits: within them it would be computed for every piece
                rows = rows.withColumn("__b", F.monotonically_increasing_id()).where((F.col("edited") != F.col(normal)) & (F.col("__b") >= 0))
                id_ = F.col(key).cast("string")
                made = {"sample_id": F.concat(id_, F.lit(tail)), "source_document_id": id_, "role": F.lit("perturbed"), "text_hash": F.sha2("edited", 256), "clean_text": F.col(normal), "parent_sample_id": id_, "perturbed_text": F.col("edited")}
                made |= {"perturbation": F.lit(rule), "severity": F.lit(severity), "requested_rate": F.lit(float(rate)), "realized_rate": F.col("realized"), "generator": F.lit("rule"), "seed": T.stable_seed(seed, T.quoted(id_), rule, severity, position or "uniform")}
                made |= {"changed_spans": F.col("spans"), "word_count": F.size(T.words(F.col("edited"))), "sentence_count": F.size(T.sentences(T.normalize(F.col("edited")))), "position": F.lit(position)}
                made |= {n: F.col(c) for n, c in (given or {}).items()}
                rows = rows.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PASSAGE])
                out = rows if out is None else out.unionByName(rows)
    return out.join(done.select("sample_id").distinct(), "sample_id", "left_anti") if done is not None else out
