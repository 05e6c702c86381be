"""The seam to an editor model behind a chat service: prompts as columns, calls by an injected client."""

from __future__ import annotations

import json
import random
import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.sources.shared import cut

from .perturb import chosen

#: Takes a prompt, gives the service's text. Raises Retry for what may pass, such as status 429 or 5xx.
Client = Callable[[str], str]


class Retry(Exception):
    """A failure that another try may not have."""


def rewrite_prompt(rubric: str, passage: Column, targets: Column) -> Column:
    """Rubric, the numbered target sentences as JSON, the passage, and the shape of the answer."""
    shape = '{"rewrites": [{"index": 0, "sentence": ""}], "operation_evidence": ""}'
    return F.concat(F.lit(f"{rubric}\n\nSentences to rewrite:\n"), F.to_json(targets), F.lit("\n\nPassage, for context only:\n"), passage, F.lit(f"\n\nAnswer with JSON of this shape only:\n{shape}"))


#: What an answer to whole_prompt() holds.
WHOLE_SHAPE = '{"sample_id": "", "perturbation": "", "severity": "", "perturbed_text": "", "changed_spans": [{"before": "", "after": ""}], "preserved_facts": [""], "introduced_error": "", "operation_evidence": "", "changed_sentence_indices": [0]}'


def whole_prompt(template: str, family: Column | str, severity: Column | str, rubric: Column | str, passage: Column, sentences: Column | None = None) -> Column:
    """A request for the whole edited passage. sentences (index, sentence): those to edit, one change each; without any the family says where."""
    c = lambda x: F.lit(x) if isinstance(x, str) else x
    listed = F.lit("")
    if sentences is not None:
        lines = F.array_join(F.transform(sentences, lambda s: F.concat(F.lit("["), s["index"].cast("string"), F.lit("] "), s["sentence"])), "\n")
        listed = F.when(F.size(sentences) > 0, F.concat(F.lit("\nChange each of these sentences once and no other one:\n"), lines, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit(f"{template}\n\nEdit: "), c(family), F.lit("\nSeverity: "), c(severity), F.lit("\nRubric: "), c(rubric), F.lit("\n"), listed, F.lit("\nPassage:\n"), passage, F.lit(f"\n\nAnswer with JSON of this shape only:\n{WHOLE_SHAPE}"))


def rubric_with_constraints(rubric: Column | str, constraints: list[str], position: str | None = None, least_words: int | None = None) -> Column:
    """A rubric followed by a numbered list of what must hold: the given constraints, where in the passage, and how long the result is at least."""
    told = [*constraints, *([f"Change only the {position} third of the passage."] if position not in (None, "uniform") else []), *([f"Keep at least {least_words} words."] if least_words else [])]
    text = "".join(f"\n{k}. {x}" for k, x in enumerate(told, 1))
    return F.concat(F.lit(rubric) if isinstance(rubric, str) else rubric, F.lit(text))


def request_counts(tasks: DataFrame, by: list[str]) -> DataFrame:
    """The number of requests that tasks come to, in all combinations of the columns and over all (nulls)."""
    return tasks.rollup(*by).agg(F.count("*").alias("n_requests"))


def targets(docs: DataFrame, key: str, normal: str, n: int, seed: int | str) -> DataFrame:
    """docs with `targets` (index, sentence), of n sentences or all where there are fewer, in order, and `anchor`, a seeded other sentence, of six words or more where there is one."""
    picked = T.let(T.sentences(F.col(normal)), lambda s: T.let(F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>")), lambda e: F.struct(s.alias("s"), e.alias("e"), chosen(e, seed, F.col(key), F.least(F.size(e), F.lit(max(1, n)))).alias("c"))))
    rows = docs.withColumn("__w", picked)
    rest = F.array_except("__w.e", "__w.c")
    long = F.filter(rest, lambda i: F.size(T.split_words(F.get("__w.s", i))) >= 6)
    one = chosen(F.when(F.size(long) > 0, long).otherwise(rest), f"{seed}a", F.col(key), F.lit(1))
    out = rows.withColumn("targets", F.transform("__w.c", lambda i: F.struct(i.alias("index"), F.get("__w.s", i).alias("sentence"))))
    return out.withColumn("anchor", F.get("__w.s", F.get(one, F.lit(0)))).drop("__w")


def answer(client: Client, prompt: str, field: str, tries: int = 4, base: float = 1.0, sleep: Callable[[float], None] = time.sleep, more: Callable[[], bool] = lambda: True) -> dict:
    """The JSON object that the service answers with, which must hold `field`; thoughts before it are left out. Waits double, with jitter, between tries; `more` says whether there may be another."""
    for k in range(tries):
        try:
            said = re.sub(r"(?s)<think>.*?</think>", "", client(prompt)).strip()
            found = json.loads(said[said.index("{") : said.rindex("}") + 1])
            if field not in found:
                raise ValueError(f"no {field} in the answer")
            return found
        except (Retry, ValueError):
            if k == tries - 1 or not more():
                raise
            sleep(base * 2**k * (1 + random.random() / 4))
    raise AssertionError


class Budget:
    """Tries beyond the first that the calls of a partition have together; once they are spent, each call has one try. Those that led to an answer are given back, so a service that fails now and then never spends them, however many tasks there are."""

    def __init__(self, n: int):
        self.left, self.lock = n, threading.Lock()

    def take(self) -> bool:
        with self.lock:
            if self.left <= 0:
                return False
            self.left -= 1
            return True

    def give(self, n: int) -> None:
        with self.lock:
            self.left += n


def generate(tasks: DataFrame, key: str, prompt: str, connect: Callable[[], Client], field: str = "rewrites", concurrency: int = 8, in_flight: int = 4, retries: int = 1000, base: float = 1.0) -> DataFrame:
    """(key, answer: JSON, error) of each task; failures become rows with an error, not failed jobs.

    `concurrency` partitions have a client each and up to `in_flight` calls under way. A task is taken from the input only when a call
    ends, so what waits is bounded. `retries` bounds the further tries of a partition: a service that is down costs one try a task then.
    A null prompt is an error of its row; an empty table gives none.
    """
    schema = f"`{key}` {tasks.schema[key].dataType.simpleString()}, answer string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, budget = connect(), Budget(retries)

        def one(p: str | None) -> tuple[str | None, str | None]:
            taken: list[bool] = []

            def more() -> bool:
                taken.append(budget.take())
                return taken[-1]

            try:
                if p is None:
                    raise ValueError("no prompt")
                told = json.dumps(answer(client, p, field, base=base, more=more))
                budget.give(sum(taken))
                return told, None
            except Exception as e:  # noqa: BLE001  the row says what went wrong
                return None, str(e) or type(e).__name__

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=[key, "answer", "error"])

        with ThreadPoolExecutor(in_flight) as pool:
            under_way: dict = {}
            for b in batches:
                kind = b.schema.field(0).type
                for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if len(under_way) >= in_flight:
                        ended, _ = wait(under_way, return_when=FIRST_COMPLETED)
                        yield told([(under_way.pop(f), *f.result()) for f in ended])
                    under_way[pool.submit(one, p)] = k
            if under_way:
                yield told([(k, *f.result()) for f, k in under_way.items()])

    return tasks.select(key, prompt).repartition(concurrency, key).mapInArrow(run, schema)


ANSWERS = "answer string, error string, part int"


def answers(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """What stands at a path of generate_into(); none where nothing was committed yet."""
    schema = f"`{key}` {kind}, {ANSWERS}"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def generate_into(tasks: DataFrame, key: str, prompt: str, connect: Callable[[], Client], path: str, parts: int = 16, **how) -> DataFrame:
    """Answers of generate() for the tasks that have none at `path` yet, appended there in commits, and all that stands there then.

    Tasks are dealt to `parts` by key, and each part is one append: a run that is killed loses the part under way alone, and the next run asks
    only for what is missing. Failed tasks are committed with their errors and asked for again by the next run. Keys must be distinct.
    """
    spark, kind = tasks.sparkSession, tasks.schema[key].dataType.simpleString()
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    for k in range(parts):
        done = answers(spark, path, key, kind).where((F.col("part") == k) & F.col("error").isNull()).select(key)
        left = cut(tasks.where(part == k).select(key, prompt).join(done, key, "left_anti"))
        if not left.isEmpty():
            generate(left, key, prompt, connect, **how).withColumn("part", F.lit(k)).write.mode("append").partitionBy("part").parquet(path)
    return answers(spark, path, key, kind)


def sample_id(model: Column, seed: Column, i: Column) -> Column:
    """The id of a generated sample."""
    return F.substring(F.sha2(F.concat_ws(":", model, seed, i), 256), 1, 16)
