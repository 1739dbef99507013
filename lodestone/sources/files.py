"""File scans and decoding of binary records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    """With its dot, lower-case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def files_with_extension(spark: SparkSession, root: str, extensions: list[str], content: bool = False) -> DataFrame:
    """Files below root whose extension matches without regard to case; paths are relative. Other files are left out when
    files are listed, so that no content of theirs is read, and contents of these only if asked for."""
    base = root.rstrip("/")
    any_case = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(map(any_case, extensions)) + "}").load(base)
    found = files.where(extension(F.col("path")).isin([e.lower() for e in extensions]))
    after = F.substring_index(F.col("path"), base.split("://")[-1] + "/", -1)
    return found.select(after.alias("path"), "length", "modificationTime", *["content"] * content)


def decoded(frames: DataFrame, decode: Callable[[bytes], list[float] | None], content: str = "content", into: str = "vector") -> DataFrame:
    """Adds what ``decode`` makes of each binary; null where it fails, for the caller to filter or fill."""
    types = ", ".join(f"`{c}` {t}" for c, t in frames.dtypes if c != into)
    kept = [c for c in frames.columns if c != into]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def safe(raw):
            try:
                return None if raw is None else decode(bytes(raw))
            except Exception:  # any broken record
                return None

        for part in parts:
            yield part[kept].assign(**{into: [safe(c) for c in part[content]]})

    return frames.select(*kept).mapInPandas(run, f"{types}, `{into}` array<float>")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Raw JSON lines, kept as text beside the typed fields of ``schema``."""
    return spark.read.text(path).select(F.col("value").alias("payload"), F.from_json("value", schema).alias("r")).select("payload", "r.*")
