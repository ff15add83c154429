"""Pairs from CSV, TSV, JSON, split directories of parquet, or typed in."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.sources.normalize import normalize_columns, validate_pairs

PAIR_SCHEMA = "prompt string, response string"


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    schema: str | None = None,
    infer_types: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Delimited text with a header row.

    Quoted fields may hold newlines, so a file cannot be split: give many files, or
    ``multi_line=False`` where no field holds a newline. Types are strings unless a schema is
    given, because inferring them reads the whole input once more.
    """
    reader = spark.read.options(
        header=True, multiLine=multi_line, escape='"', sep=sep, inferSchema=infer_types
    )
    return (reader.schema(schema) if schema else reader).csv(path)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


def read_json(
    spark: SparkSession, path: str, lines: bool = False, schema: str | None = None
) -> DataFrame:
    """An array of records per file, or one record per line (which splits; use it for volume)."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_split(spark: SparkSession, directory: str, split: str = "train") -> DataFrame:
    """One split of a parquet dataset: ``train/``, ``split=train/`` or ``train-*.parquet``."""
    found = {}
    for layout in (f"{split}-*.parquet", f"data/{split}-*.parquet", split, f"split={split}"):
        try:
            found[layout] = spark.read.parquet(f"{directory}/{layout}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if len(found) > 1:
        raise ValueError(f"more than one layout of split {split!r} under {directory}: {sorted(found)}")
    if not found:
        raise ValueError(f"no split {split!r} under {directory}")
    return found.popitem()[1]


def literal_pair(spark: SparkSession, prompt: str, response: str) -> DataFrame:
    return spark.range(1).select(F.lit(prompt).alias("prompt"), F.lit(response).alias("response"))


def is_object(line: str) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def holds_json_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line is an object by itself and more follow, so that one record per line is meant.

    A damaged second line raises: neither way of reading would give all records.
    """
    rows = [r["value"] for r in spark.read.text(path).where(F.trim("value") != "").take(2)]
    if len(rows) < 2 or not is_object(rows[0]):
        return False
    if not is_object(rows[1]):
        raise ValueError(f"{path} begins like JSON lines, but its second line is no record: {rows[1][:80]!r}")
    return True


def read_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """Choose the reader by the ending of the path; options go to it.

    A ``.json`` file with a record per line is read by lines, unless ``lines`` says otherwise: as one
    document only its first record would be left.
    """
    readers = {
        "csv": read_csv,
        "tsv": read_tsv,
        "json": lambda s, p, lines=None, **o: read_json(
            s, p, lines=holds_json_lines(s, p) if lines is None else lines, **o
        ),
        "jsonl": lambda s, p, **o: read_json(s, p, **{"lines": True, **o}),
        "parquet": lambda s, p, **o: s.read.options(**o).parquet(p),
    }
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending not in readers:
        raise ValueError(f"Unsupported file format: {path}")
    return readers[ending](spark, path, **options)


def load_pairs(
    spark: SparkSession,
    literal: tuple[str, str] | None = None,
    path: str | None = None,
    split_dir: str | None = None,
    instruction_name: str | None = None,
    input_name: str | None = None,
    response_name: str | None = None,
    **options,
) -> DataFrame:
    """A typed-in pair wins over a file, a file over a split directory; options go to the file's reader."""
    if literal and all(literal):
        return literal_pair(spark, *literal)
    if path:
        raw = read_file(spark, path, **options)
    elif split_dir:
        raw = read_split(spark, split_dir)
    else:
        raise ValueError("No dataset provided.")
    return validate_pairs(normalize_columns(raw, instruction_name, input_name, response_name))
