"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder with the public tokenizers' files; a parameter of the deployment.
TOKENIZER_DIR = os.environ.get("TEXTEVIDENCE_TOKENIZERS", "/opt/tokenizers")

#: Characters of text that a Python worker handles at once.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that no part holds much more than ``chars`` bytes of ``column``."""
    if batch.num_rows == 0:
        return
    lens = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    part = np.cumsum(lens, dtype=np.int64) // chars
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder the cluster names; a local folder only where none is set (tests)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="textevidence-checkpoint-")
        sc.setCheckpointDir(named)
    return df.checkpoint()


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of each run, one run after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def sample(df: DataFrame, rows: int, *columns: str) -> list[tuple]:
    """At most ``rows`` rows, those of least hash: the same whatever the order of rows and files."""
    keyed = df.select(*columns)
    return [tuple(r)[:-1] for r in keyed.withColumn("_order", F.xxhash64(*keyed.columns)).orderBy("_order", *keyed.columns).limit(rows).collect()]


#: Parts into which the rows of a hot key are dealt; a key is hot if it has a thousandth of all rows, so at most a thousand are.
SALTS, HOT = 64, 1000


def hot_keys(counts: DataFrame, keys: list[str]) -> list[tuple]:
    """Keys of ``counts`` (keys, n) that have at least one in HOT of all its rows: at most HOT of them."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [tuple(r) for r in counts.where(F.col("n") >= max(2, -(-total // HOT))).select(*keys).limit(HOT).collect()] if total >= HOT else []


def spread_join(rows: DataFrame, other: DataFrame, keys: list[str], hot: list[tuple]) -> DataFrame:
    """Inner equi-join in which the rows of hot keys are dealt to SALTS tasks by their hash; ``other`` has few rows a key."""
    is_hot = F.lit(False) if not hot else F.struct(*keys).isin([F.struct(*(F.lit(x).alias(k) for k, x in zip(keys, h, strict=True))) for h in hot]) if len(keys) > 1 else F.col(keys[0]).isin([h[0] for h in hot])
    salted = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = other.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.hint("merge").join(copies.hint("merge"), [*keys, "_salt"]).drop("_salt")


def table_bytes(df: DataFrame, column: str) -> int:
    """About how many bytes ``df`` has: the size of its files where the plan knows it, else the characters of ``column``."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else int(df.agg(F.sum(F.length(column))).first()[0] or 0)
