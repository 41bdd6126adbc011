"""The annotated data set: long tables with fixed schemas, saved as a folder of Parquet tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "fragments": "chr string, start long, end long, cb string, mapq int",
    "bins": "bin_id int, chr string, start long, end long, gc double, mappability double, blacklist double",
    "spots": "sample string, spot_id int, x_id int, y_id int, total_frags long",
    "counts": "sample string, spot_id int, bin_id int, n long",
    "layer": "sample string, spot_id int, bin_id int, value double",
}


@dataclass(frozen=True)
class SpatialDataset:
    """Spots, bins and the count matrix (zeros are implicit), with layers and results by name. Nothing is changed in place."""

    spots: DataFrame
    bins: DataFrame
    counts: DataFrame
    layers: dict[str, DataFrame] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    meta: dict[str, str] = field(default_factory=dict)

    def with_layer(self, name: str, df: DataFrame) -> SpatialDataset:
        return replace(self, layers=self.layers | {name: df})

    def with_table(self, name: str, df: DataFrame) -> SpatialDataset:
        return replace(self, tables=self.tables | {name: df})

    def save(self, path: str) -> None:
        parts = {"spots": self.spots, "bins": self.bins, "counts": self.counts}
        parts |= {f"layer={k}": v for k, v in self.layers.items()} | {f"table={k}": v for k, v in self.tables.items()}
        for name, df in parts.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows = [(json.dumps({"meta": self.meta, "parts": sorted(parts)}),)]
        self.spots.sparkSession.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SpatialDataset:
        info = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        parts = {p: spark.read.parquet(f"{path}/{p}") for p in info["parts"]}
        named = lambda kind: {p.split("=", 1)[1]: df for p, df in parts.items() if p.startswith(f"{kind}=")}
        return cls(parts["spots"], parts["bins"], parts["counts"], named("layer"), named("table"), info["meta"])
