"""Reading and writing: tables, JSON lines, JSON, CSV, manifests. Schemas are always given."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))

#: A passage and its edit; `validation` holds JSON.
PASSAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("sample_id", "source_document_id", "split", "role", "text_hash", "clean_text", "parent_sample_id", "corpus_version", "normalization_version", "perturbed_text", "perturbation", "severity")]
    + [T.StructField("requested_rate", T.DoubleType()), T.StructField("realized_rate", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("generator", "generator_revision", "prompt_version")]
    + [T.StructField("seed", T.LongType()), T.StructField("validation", T.StringType()), T.StructField("changed_spans", SPAN), T.StructField("word_count", T.IntegerType()), T.StructField("sentence_count", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("topic", "domain", "near_duplicate_group", "position")]
)
RUN = T.StructType([T.StructField(n, T.StringType()) for n in ("run_id", "model", "family")] + [T.StructField("seed", T.LongType()), T.StructField("samples_path", T.StringType()), T.StructField("text_key", T.StringType()), T.StructField("setting", T.StringType())])
CORPUS_ROW = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "domain", "kind", "source", "parent")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its files make fewer tasks than there are cores, as small files do; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def kept(df: DataFrame, condition: Column) -> DataFrame:
    """df where the condition holds, tested where the rows lie now: the optimizer would test costly conditions before rows are dealt to all cores."""
    return df.withColumn("__here", F.monotonically_increasing_id()).where(condition & (F.col("__here") >= 0)).drop("__here")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines; a malformed line is an error, or is skipped unless strict. Blank lines don't count."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Fields in order of name; the committer replaces the old folder only when all is written."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header; nothing is written without rows."""
    if not rows.isEmpty():
        rows.write.mode("overwrite").option("header", True).csv(path)


def load_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """By suffix: .jsonl, .json (an object or an array of them) or .parquet."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "jsonl":
        return read_jsonl(spark, path, schema)
    if kind == "json":
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported kind of file: {path}")


#: What local addresses begin with, in the forms that Spark has.
LOCAL = "^file:/+"


def owners(files: list[str], runs: dict[str, list[tuple[str, str]]]) -> list[tuple[str, str, str]]:
    """(file, run_id, key): each file with the runs whose path it is or lies under."""
    out = []
    known = {re.sub(LOCAL, "/", p): x for p, x in runs.items()}
    for f in files:
        at = unquote(re.sub(LOCAL, "/", f))
        while at:
            out += [(re.sub(LOCAL, "/", f), *x) for x in known.get(at, ())]
            at = at.rpartition("/")[0]
    return out


def load_runs(spark: SparkSession, manifest: str, base: str = "", require: bool = True) -> DataFrame:
    """(run_id, row_id, text) of the JSON lines of every run in a manifest, read in one scan however many runs there are.

    A run's samples are a file or a folder of files; the field with the text is the run's own. Two runs of one id are an error, and so is
    none; runs without samples are one if required, else left out. Malformed lines are an error, blank ones don't count. row_id orders
    the rows of a file. Rows meet their run by the address of their file; the driver holds the manifest and the addresses.
    """
    runs = read_jsonl(spark, manifest, RUN)
    twice = runs.groupBy("run_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"run_id twice in {manifest}: {twice[0][0]}")
    told = {}
    for r in runs.collect():
        path = r.samples_path if r.samples_path.startswith("/") or "://" in r.samples_path else f"{base.rstrip('/')}/{r.samples_path}"
        told.setdefault(path.rstrip("/"), []).append((r.run_id, r.text_key or "text"))
    if told and not require:
        hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        told = {p: x for p, x in told.items() if hadoop(p).getFileSystem(conf).exists(hadoop(p))}
    if not told:
        raise ValueError(f"no runs in {manifest}")
    try:
        lines = spark.read.text([*told])
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(str(e)) from None
        raise
    own = spark.createDataFrame(owners(lines.inputFiles(), told), "file string, run_id string, key string")
    fields = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    rows = lines.where(F.btrim("value", F.lit(" \t\n\x0b\x0c\r")) != "").select(F.regexp_replace("_metadata.file_path", LOCAL, "/").alias("file"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("row_id"), fields.alias("fields"))
    return rows.join(own, "file").select("run_id", "row_id", F.try_element_at("fields", "key").alias("text"))


def checked_texts(rows: DataFrame, text: str = "text", mode: str = "none") -> DataFrame:
    """Every text must be non-blank (an error, never dropped); mode none strips it, whitespace collapses it."""
    from corvane.functions.text import normalize

    t = F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    if mode not in ("none", "whitespace"):
        raise ValueError(f"unknown normalization: {mode}")
    good = F.when(F.coalesce(t, F.lit("")) != "", t).otherwise(F.raise_error(F.lit("blank text")))
    return rows.withColumn(text, normalize(good) if mode == "whitespace" else good)


def filled_texts(rows: DataFrame, text: str = "text", mode: str = "whitespace") -> DataFrame:
    """rows whose texts aren't blank, as they stand; the first character that is no white space decides. An error where none is left."""
    from corvane.functions.text import SPACES

    there = F.regexp_like(F.col(text), F.lit(f"[^{SPACES}]")) if mode == "whitespace" else F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")) != ""
    out = rows.where(there)
    if out.isEmpty():
        raise ValueError("no text is left")
    return out


def non_empty_texts(rows: DataFrame, text: str = "text", mode: str = "whitespace") -> DataFrame:
    """Normalized texts without the empty ones; an error where none is left."""
    from corvane.functions.text import normalize

    t = normalize(F.col(text)) if mode == "whitespace" else F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    out = rows.withColumn(text, t).where(F.coalesce(F.col(text), F.lit("")) != "")
    if out.isEmpty():
        raise ValueError("no text is left")
    return out


def verify_files(spark: SparkSession, root: str, manifest: DataFrame, sample: int) -> DataFrame:
    """(path, ok) of a manifest's files (path, size, sha256): sizes of all, digests of every k-th."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.select(F.replace("path", F.lit(f"file:{root.rstrip('/')}/"), F.lit("")).alias("path"), F.col("length"), F.sha2("content", 256).alias("digest"))
    every = max(1, manifest.count() // sample)
    from pyspark.sql import Window

    listed = manifest.withColumn("k", F.row_number().over(Window.orderBy("path")) - 1)
    both = listed.join(files, "path", "left")
    return both.select("path", F.coalesce((F.col("size") == F.col("length")) & ((F.col("k") % every != 0) | (F.col("sha256") == F.col("digest"))), F.lit(False)).alias("ok"))
