"""Candidate, dense and run tables: readers and sinks."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def explode_candidates(ragged: DataFrame, columns: Sequence[str] = ("boxes", "projected_boxes", "ious")) -> DataFrame:
    """One row per candidate from parallel ragged arrays: (group_id, label, cand, box, proj_box, iou)."""
    zipped = F.posexplode(F.arrays_zip(*[F.col(c) for c in columns])).alias("cand", "_c")
    fields = [F.col("_c").getField(c).alias(n) for c, n in zip(columns, ("box", "proj_box", "iou"))]
    return ragged.select("group_id", "label", zipped).select("group_id", "label", "cand", *fields)


def read_feature_matrices(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Candidate features from one matrix file per (six-digit id, class): (group_id, class, cand, feats).

    A one-off ingestion; write the result as Parquet. A file holds one group and is read in one piece.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    named = files.select(
        F.regexp_extract("path", r"(\d+)_([^/]+)\.npy$", 1).cast("bigint").alias("group_id"),
        F.regexp_extract("path", r"(\d+)_([^/]+)\.npy$", 2).alias("class"),
        "content",
    )

    def load(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                data = io.BytesIO(batch.column("content")[i].as_py())
                x = np.load(data, allow_pickle=False).reshape(-1, dim).astype(np.float32)
                bounds = pa.array(np.arange(len(x) + 1) * dim, pa.int32())
                owner = pa.array(np.full(len(x), i))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("group_id").take(owner),
                        batch.column("class").take(owner),
                        pa.array(np.arange(len(x)), pa.int32()),
                        pa.ListArray.from_arrays(bounds, pa.array(x.ravel())),
                    ],
                    ["group_id", "class", "cand", "feats"],
                )

    return named.mapInArrow(load, "group_id bigint, class string, cand int, feats array<float>")


def read_libsvm(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Dense examples (id, feats, y) from LIBSVM text; labels {1, 2} or {0, 1} become {0, 1}."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    pairs = F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda p: F.split(p, ":"))
    values = F.map_from_entries(
        F.transform(pairs, lambda p: F.struct(p.getItem(0).cast("int"), p.getItem(1).cast("double")))
    )
    index = F.sequence(F.lit(1), F.lit(dim))
    rows = lines.select(
        F.monotonically_increasing_id().alias("id"),
        parts.getItem(0).cast("double").alias("label"),
        values.alias("_v"),
    )
    feats = F.transform(index, lambda j: F.coalesce(F.try_element_at("_v", j), F.lit(0.0)))
    return rows.select("id", feats.alias("feats"), F.when(F.col("label") == 1, 1.0).otherwise(0.0).alias("y"))


def write_log(log: DataFrame, path: str, task: str, algorithm: str) -> None:
    """Append a train log, partitioned by task, algorithm and run."""
    _write_runs(log, path, task, algorithm)


def write_weights(weights: DataFrame, path: str, task: str, algorithm: str) -> None:
    """Append models (run_id, idx, w), partitioned by task, algorithm and run."""
    _write_runs(weights, path, task, algorithm)


def _write_runs(df: DataFrame, path: str, task: str, algorithm: str) -> None:
    tagged = df.withColumn("task", F.lit(task)).withColumn("algorithm", F.lit(algorithm))
    tagged.write.mode("append").partitionBy("task", "algorithm", "run_id").parquet(path)
