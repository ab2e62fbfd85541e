"""Model parameters as Parquet: (ord, name, rows, cols, data), with the shape-giving settings beside."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.plans.kernels import Params, initial, layout
from helixlake.sources.config import Config

SETTINGS = ("d_model", "num_encoder_layers", "num_heads", "d_ff", "num_labels")


def shapes(config: Config) -> list[tuple[str, int, int]]:
    return layout(config.d_model, config.num_encoder_layers, config.d_ff, len(config.cwt_scales))


def new_model(config: Config, seed: int = 0) -> Params:
    return initial(config.d_model, config.num_encoder_layers, config.d_ff, len(config.cwt_scales), seed)


def params_frame(spark: SparkSession, params: Params) -> DataFrame:
    rows = [(k, name, v.shape[0], v.shape[1], v.ravel().tolist()) for k, (name, v) in enumerate(params.items())]
    return spark.createDataFrame(rows, "ord int, name string, rows int, cols int, data array<double>")


def parameter_count(params: DataFrame) -> DataFrame:
    return params.agg(F.sum(F.col("rows").cast("long") * F.col("cols")).alias("n"))


def save_model(spark: SparkSession, params: Params, config: Config, path: str) -> None:
    """Weights only; the state of the optimiser isn't kept."""
    settings = [(name, str(getattr(config, name))) for name in SETTINGS] + [("cwt_scales", ",".join(map(str, config.cwt_scales)))]
    spark.createDataFrame(settings, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    params_frame(spark, params).write.mode("overwrite").parquet(f"{path}/params")


def load_model(spark: SparkSession, config: Config, path: str) -> Params:
    """The weights, if every setting and shape agrees with the configuration (scales by number only)."""
    settings = dict(spark.read.parquet(f"{path}/settings").collect())
    wrong = [name for name in SETTINGS if settings.get(name) != str(getattr(config, name))]
    rows = {r["name"]: r for r in spark.read.parquet(f"{path}/params").collect()}
    wrong += [name for name, n, m in shapes(config) if name not in rows or (rows[name]["rows"], rows[name]["cols"]) != (n, m)]
    wrong += [name for name, r in rows.items() if len(r["data"]) != r["rows"] * r["cols"]]
    if wrong or len(rows) != len(shapes(config)):
        raise ValueError(f"the model at {path} doesn't fit the configuration: {', '.join(sorted(set(wrong))) or 'other matrices'}")
    return {name: np.array(rows[name]["data"]).reshape(n, m) for name, n, m in shapes(config)}
