"""What the jobs share: command line, session, tables that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def arguments(about: str, config: str, paths: dict[str, str], argv: list[str] | None = None) -> tuple[argparse.Namespace, dict]:
    """The paths and the settings; the config file's settings stand, unless --set NAME=JSON replaces one."""
    parser = argparse.ArgumentParser(description=about)
    for name, said in paths.items():
        parser.add_argument(f"--{name}", required=True, help=said)
    parser.add_argument("--config", default=str(Path(__file__).with_name(config)), help="a JSON file of settings")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=JSON", help="replaces a setting")
    args = parser.parse_args(argv)
    settings = json.loads(Path(args.config).read_text())
    for one in args.set:
        name, _, value = one.partition("=")
        if name not in settings:
            parser.error(f"no such setting: {name}")
        settings[name] = json.loads(value)
    return args, settings


def defaults(config: str) -> dict:
    return json.loads(Path(__file__).with_name(config).read_text())


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()


def read_there(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """The table at a path, an empty one where there is none yet."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
