"""Settings, and vectors kept as arrays."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _text(spark: SparkSession, path: str) -> str:
    """A small file of any store, as a whole."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_json(spark: SparkSession, path: str):
    return json.loads(_text(spark, path))


def read_yaml(spark: SparkSession, path: str) -> dict:
    """Needs the yaml package; a file without content is an empty mapping."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs the yaml package") from e
    return yaml.safe_load(_text(spark, path)) or {}


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """file, place, vector: the rows of two-dimensional NPY arrays. An array is read in one task; files go to many."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                rows = np.load(io.BytesIO(content), allow_pickle=False).astype("float64")
                yield pd.DataFrame({"file": name, "place": np.arange(len(rows)), "vector": list(rows)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, place bigint, vector array<double>")
