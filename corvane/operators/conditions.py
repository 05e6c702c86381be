"""Sets of conditions: edits regrouped by family and dose, rewrite rows, balanced probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

from corvane.sources.shared import cut, stored

from . import perturb, quality
from .dedup import first_seen
from .sampling import hashed

#: Doses by name, kinds of rewrite rows.
DOSES = {"mild": 1, "moderate": 2, "severe": 3}
KINDS = {"internal_contradiction": "pert_contradiction", "causal_reverse": "pert_causal_reverse"}


def dose_of(severity: Column) -> Column:
    """The number in doseN, or that of a named severity; null for others."""
    named = F.create_map(*[F.lit(x) for kv in DOSES.items() for x in kv])
    return F.coalesce(F.regexp_extract(severity, r"^dose(\d+)$", 1).try_cast("int"), named[severity])


def condition_name(family: Column, rate: Column) -> Column:
    """family__rNNN, of the rate in hundredths."""
    return F.concat(family, F.lit("__r"), F.lpad(F.round(rate * 100).cast("int").cast("string"), 3, "0"))


def conditions(edits: DataFrame, parents: DataFrame, anchored: tuple[str, ...] = ("internal_contradiction",)) -> DataFrame:
    """(condition, family, role, dose, parent_id, text) of edits that aren't empty, change their parent, and whose anchor stands where the family needs one.

    edits: (parent_id, family, severity, text, validation). Of benign paraphrases the strongest dose is the anchor, the others are doses of it.
    """
    both = edits.join(parents.select("parent_id", F.col("text").alias("clean")), "parent_id")
    both = both.where((F.coalesce(F.btrim("text"), F.lit("")) != "") & (T.normalize(F.col("text")) != T.normalize(F.col("clean"))))
    both = quality.anchor_survives(both.withColumn("__evidence", F.get_json_object("validation", "$.operation_evidence")), "__evidence", "text", "clean", "__legacy")
    fine = quality.contradiction_ok(F.get_json_object("validation", "$.anchor_sentence"), F.col("__legacy"), F.col("text"))
    both = both.where(~F.col("family").isin(*anchored) | fine).withColumn("dose", dose_of(F.col("severity")))
    top = both.where("family = 'benign_paraphrase'").agg(F.max("dose").alias("__top"))
    told = both.crossJoin(F.broadcast(top))  # one row
    benign = F.col("family") == "benign_paraphrase"
    role = F.when(benign & (F.col("dose") == F.col("__top")), "benign_anchor").when(benign, "benign_dose").otherwise("harmful")
    return told.select(F.concat("family", F.lit("__dose"), F.coalesce(F.col("dose").cast("string"), F.col("severity"))).alias("condition"), "family", role.alias("role"), "dose", "parent_id", "text")


def with_benign(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """rows, and clean parents as the benign anchor where no paraphrase is one."""
    if not rows.where("role = 'benign_anchor'").limit(1).isEmpty():
        return rows
    clean = parents.select(F.lit("clean_parents").alias("condition"), F.lit("clean").alias("family"), F.lit("benign_anchor").alias("role"), F.lit(None).cast("int").alias("dose"), "parent_id", "text")
    return rows.unionByName(clean)


def rewrite_rows(records: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text, domain, kind, source, parent) of rewrites that pass, followed by all parents; and (kind, status, n) of what was kept and dropped.

    records hold passages with edits in families of KINDS; others are dropped. A text counts once, however cased; one that equals its parent is dropped.
    """
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("perturbation")]
    named = F.coalesce(F.col("perturbation").isin(*KINDS), F.lit(False))
    told = quality.validate_edits(records.where(named), ratio=False).withColumn("kind", kind)
    evidence = F.when(F.col("perturbation") == "internal_contradiction", F.get_json_object("validation", "$.operation_evidence"))  # the others need no anchor
    told = quality.anchor_survives(told.withColumn("__e", evidence), "__e", "perturbed_text", "clean_text", "__anchor").withColumn("n", T.normalize(F.col("perturbed_text")))
    gate = F.when(~F.col("passed"), "invalid").when((F.col("perturbation") == "internal_contradiction") & ~F.col("__anchor"), "anchor").when(F.col("n") == T.normalize(F.col("clean_text")), "no_op")
    source = T.dose_label(F.col("requested_rate"), F.col("sample_id"), F.col("severity"))
    # written once: what is kept and what is lost are told from it, and no filter moves into the tests
    told = stored(told.select("sample_id", "kind", gate.alias("__gate"), F.sha2("n", 256).alias("__k"), F.col("n").alias("text"), "domain", source.alias("source"), F.col("parent_sample_id").alias("parent")), "gated")
    good = first_seen(told.where(F.col("__gate").isNull()), ["__k"], "sample_id").withColumn("status", F.lit("kept"))
    rows = good.select("text", "domain", "kind", "source", "parent")
    clean = parents.select(T.normalize(F.col("clean_text")).alias("text"), "domain", F.lit("clean_parent").alias("kind"), F.lit(None).cast("string").alias("source"), F.col("sample_id").alias("parent"))
    kept = good.groupBy(F.coalesce("kind", F.lit("")).alias("kind"), "status").agg(F.count("*").alias("n"))
    lost = told.where(F.col("__gate").isNotNull()).groupBy(F.coalesce("kind", F.lit("")).alias("kind"), F.col("__gate").alias("status")).agg(F.count("*").alias("n"))
    other = records.where(~named).groupBy(F.lit("").alias("kind"), F.lit("family").alias("status")).agg(F.count("*").alias("n"))
    return rows.unionByName(clean), kept.unionByName(lost).unionByName(other)


def balanced_probes(clean: DataFrame, benign: DataFrame, reserved_clean: DataFrame, reserved_benign: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """(side, text) of n trained and up to n reserved texts, half clean and half benign on either side."""
    half = n // 2
    take = lambda df, side, k: df.withColumn("__h", hashed(f"{seed}{side}", key)).orderBy("__h", key).limit(k).select(F.lit(side).alias("side"), "text")
    most = min(half, reserved_clean.count(), reserved_benign.count())
    return take(clean, "seen", half).unionByName(take(benign, "seen", half)).unionByName(take(reserved_clean, "reserved", most)).unionByName(take(reserved_benign, "reserved", most))


def candidates(records: DataFrame, splits: tuple[str, ...], n: int | None, per_split: bool, order: str = "sample_id") -> DataFrame:
    """Candidate records of the splits: the first n of each, or of all."""
    rows = records.where((F.col("role") == "candidate") & F.col("split").isin(*splits))
    if n is None:
        return rows
    if not per_split:
        return rows.orderBy(order).limit(n)
    from pyspark.sql import Window

    return rows.withColumn("__k", F.row_number().over(Window.partitionBy("split").orderBy(order))).where(F.col("__k") <= n).drop("__k")


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both joined one to one on the key; an error where one side has others."""
    out = left.join(right, key)
    n = out.count()
    if not n == left.count() == right.count():
        raise ValueError("the rows don't align")
    return out


def planned(settings: dict) -> list[dict]:
    """A set's conditions: (condition, family, group, kind, role, dose, dose_kind), of rules by dose, spliced sentences by dose and pool, and the clean parents."""
    told = []
    for spec in settings["rule_families"]:
        for dose in settings["rule_doses"]:
            told.append({"condition": named(spec["alias"], dose), "family": spec["alias"], "group": spec["group"], "kind": "harmful", "role": "harmful", "dose": float(dose), "dose_kind": "rate"})
    for dose in settings["splice_doses"]:
        for family, role in (("generated_splice", "harmful"), ("human_splice", "control")):
            told.append({"condition": named(family, dose), "family": family, "group": "generated_mix", "kind": "harmful", "role": role, "dose": float(dose), "dose_kind": "rate"})
    told.append({"condition": "clean_candidates", "family": "clean_candidates", "group": "control", "kind": "benign", "role": "benign", "dose": 0.0, "dose_kind": "none"})
    return told


def named(family: str, rate: float) -> str:
    return f"{family}__r{round(rate * 100):03d}"


def condition_rows(parents: DataFrame, pools: dict[str, DataFrame], settings: dict) -> DataFrame:
    """(condition, parent_id, text, realized_rate): every planned condition over every parent, without edits that change nothing.

    parents: (parent_id, n), n the normalized text. pools: sentences by the family that splices them; families of one dose
    fill the same places, so they differ in the sentences alone. A pool that is empty gives no rows.
    """
    out = parents.select(F.lit("clean_candidates").alias("condition"), "parent_id", F.col("n").alias("text"), F.lit(0.0).alias("realized_rate"))

    def put(rows: DataFrame, name: str) -> None:
        nonlocal out
        # the number keeps the filter above the edit: within it the edit would be computed again
        rows = rows.withColumn("__b", F.monotonically_increasing_id()).where((F.col("edited") != F.col("n")) & (F.col("__b") >= 0))
        out = out.unionByName(rows.select(F.lit(name).alias("condition"), "parent_id", F.col("edited").alias("text"), F.round("realized", 3).alias("realized_rate")))

    seed, position = settings["seed"], settings["position"]
    for spec in settings["rule_families"]:
        for dose in settings["rule_doses"]:
            put(perturb.RULES[spec["rule"]](parents, "parent_id", "n", dose, f"{seed}:{spec['rule']}:r{dose}", position=position), named(spec["alias"], dose))
    placed = {dose: perturb.spliceable(parents, "parent_id", "n", dose, f"{seed}:splice:r{dose}", position) for dose in settings["splice_doses"]} if pools else {}
    for family, pool in pools.items():
        numbered, total = perturb.numbered_pool(cut(pool))
        for dose, places in placed.items():
            put(perturb.splice(parents, numbered, total, "parent_id", "n", dose, f"{seed}:splice:r{dose}", family, position, placed=places), named(family, dose))
    return out
