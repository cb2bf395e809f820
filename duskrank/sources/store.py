"""Table fingerprints, the caches keyed by them, and the run log."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

RUN_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("kind", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)


def fingerprint(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Order-insensitive content hash: sum of row hashes plus the row count, one row (per group).

    Every column takes part, by sorted name, as text with its length before it; a null has length -1. A
    row's hash is the first 60 bits of an md5, which any engine can recompute. To make it order-sensitive
    keep ``pos`` in the frame.
    """

    def part(name: str):
        text = F.col(name).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-1:"))

    row = F.md5(F.concat(*(part(c) for c in sorted(df.columns))).cast("binary"))
    total = F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)"))
    return df.groupBy(*by).agg(F.coalesce(total, F.lit(0)).cast("string").alias("hash_sum"), F.count(F.lit(1)).alias("n_rows"))


def fingerprint_value(df: DataFrame) -> str:
    row = fingerprint(df).first()
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(df.schema, key=lambda f: f.name))
    return hash_dict({"sum": row["hash_sum"], "rows": row["n_rows"], "schema": schema})


def hash_dict(values: Mapping[str, Any]) -> str:
    return hashlib.sha256(json.dumps(values, sort_keys=True, default=str).encode()).hexdigest()


def read_if_complete(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` if a finished write left it there."""
    try:
        spark.read.text(f"{path}/_SUCCESS").schema
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def cached_table(folder: str, function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Keep the output of ``function`` in ``folder``, keyed by its name and its arguments' content."""

    def call(*args: Any, **kwargs: Any) -> DataFrame:
        named = {**{f"arg_{i}": a for i, a in enumerate(args)}, **kwargs}
        frames = [a for a in named.values() if isinstance(a, DataFrame)]
        spark = frames[0].sparkSession if frames else SparkSession.active()
        key = {k: fingerprint_value(v) if isinstance(v, DataFrame) else v for k, v in named.items()}
        name = f"{function.__module__}.{function.__qualname__}"
        path = f"{folder}/{hash_dict({'function': name, **key})}.parquet"
        hit = read_if_complete(spark, path)
        if hit is not None:
            return hit
        out = function(*args, **kwargs)
        out.write.mode("overwrite").parquet(path)
        return spark.read.schema(out.schema).parquet(path)

    return call


class ModelStore:
    """Fitted first-stage tables, keyed by the training data and every fit parameter."""

    def __init__(self, folder: str):
        self.folder = folder

    def fit(
        self,
        kind: str,
        params: Mapping[str, Any],
        train: DataFrame,
        fit: Callable[[], Mapping[str, DataFrame]],
        extra: Mapping[str, DataFrame] | None = None,
        content: str | None = None,
    ) -> dict[str, DataFrame]:
        """``content`` names the training data where the caller knows its fingerprint; else it is computed here."""
        spark = train.sparkSession
        inputs = {"train": train, **(extra or {})}
        names = {"content": content} if content else {f"in_{k}": fingerprint_value(v) for k, v in inputs.items()}
        key = hash_dict({"kind": kind, **params, **names})
        base = f"{self.folder}/{kind}/{key}"
        listing = read_if_complete(spark, f"{base}/tables")
        if listing is None:
            tables = dict(fit())
            for name, table in tables.items():
                table.write.mode("overwrite").parquet(f"{base}/{name}")
            # written last, so a half-written model is never taken for a finished one
            names = spark.createDataFrame([(n,) for n in sorted(tables)], "name string")
            names.coalesce(1).write.mode("overwrite").parquet(f"{base}/tables")
            listing = spark.read.parquet(f"{base}/tables")
        # a handful of table names per model
        return {r["name"]: spark.read.parquet(f"{base}/{r['name']}") for r in listing.collect()}


class RunLog:
    """Append-only table of a run's parameters, metrics and artifacts."""

    def __init__(self, spark: SparkSession, path: str, run_id: str | None = None):
        self.spark, self.path = spark, path
        self.run_id = run_id or uuid.uuid4().hex

    def _append(self, kind: str, values: Mapping[str, Any]) -> None:
        now = time.time()
        rows = [(self.run_id, now, kind, k, v if isinstance(v, str) else json.dumps(v, default=str)) for k, v in values.items()]
        self.spark.createDataFrame(rows, RUN_LOG).coalesce(1).write.mode("append").parquet(self.path)

    def params(self, **values: Any) -> None:
        self._append("param", values)

    def metrics(self, values: Mapping[str, float]) -> None:
        self._append("metric", values)

    def metrics_from(self, report: DataFrame, key: str, value: str, suffix: str = "_rocauc") -> None:
        """Append a report table (one row per score column) without passing through the driver."""
        report.select(
            F.lit(self.run_id).alias("run_id"),
            F.lit(time.time()).alias("ts"),
            F.lit("metric").alias("kind"),
            F.concat(F.col(key), F.lit(suffix)).alias("key"),
            F.col(value).cast("string").alias("value"),
        ).write.mode("append").parquet(self.path)

    def artifact(self, name: str, path: str) -> None:
        self._append("artifact", {name: path})

    def read(self) -> DataFrame:
        return self.spark.read.schema(RUN_LOG).parquet(self.path)
