"""Recorded answers of a map service as a Spark data source, and files written from results."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, type string, id bigint, lat double, lon double, center struct<lat: double, lon: double>, tags map<string, string>, remark string"


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ElementReader(DataSourceReader):
    """One partition for each recorded answer; elements of an answer that ended with a remark are kept with it (SC-03)."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = sorted(Path(self.path).glob("*.json")) if Path(self.path).is_dir() else [Path(self.path)]
        return [FilePartition(str(p)) for p in found]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        try:
            data = json.loads(Path(partition.path).read_text(encoding="utf-8"))
        except ValueError:
            yield (partition.path, None, None, None, None, None, None, "not JSON")
            return
        remark = data.get("remark")
        for e in data.get("elements") or []:
            c = e.get("center")
            number = lambda x: float(x) if isinstance(x, int | float) else None
            yield (
                partition.path,
                e.get("type"),
                e.get("id"),
                number(e.get("lat")),
                number(e.get("lon")),
                (number(c.get("lat")), number(c.get("lon"))) if isinstance(c, dict) else None,
                {str(k): str(v) for k, v in (e.get("tags") or {}).items()},
                remark,
            )


class Elements(DataSource):
    """``spark.read.format("elements").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "elements"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ElementReader(self.options["path"])


def read_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded answers through the data source (for formats that need its checks); plain ones via Spark's own JSON reader."""
    spark.dataSource.register(Elements)
    return spark.read.format("elements").load(folder)


def read_elements_plain(spark: SparkSession, folder: str) -> DataFrame:
    """The same elements by Spark's JSON reader, JVM-side."""
    fields = "remark string, elements array<struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>"
    rows = spark.read.schema(fields).option("multiLine", "true").json(folder)
    return rows.select("remark", F.explode("elements").alias("e")).select("e.*", "remark")


def write_csv(df: DataFrame, path: str) -> None:
    """SC-24: a header, empty fields for nulls, plain line ends; one folder, a file for each partition."""
    df.write.mode("overwrite").option("header", "true").option("nullValue", "").option("emptyValue", "").option("lineSep", "\n").csv(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """SC-21: rows appended as JSON lines."""
    df.write.mode("append").json(path)


def write_pages(df: DataFrame, path: str) -> None:
    """SC-22: pages with a short hash of their URL as name, compressed columns instead of a file for each page."""
    df.withColumn("name", F.substring(F.sha1("url"), 1, 16)).write.mode("overwrite").parquet(path)


def result_body(df: DataFrame) -> DataFrame:
    """SC-23: the rows as JSON documents, one each, without null fields; a reader joins them as it needs."""
    return df.select(F.to_json(F.struct("*")).alias("body"))
