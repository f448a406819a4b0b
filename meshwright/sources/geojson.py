"""GeoJSON documents as a data source: one file for each dataset, written row by row, so a document may be larger than any task's memory."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .csdm import D, get, items, kind, text

#: The context of every document, and what a document without features says.
CONTEXT = "https://opengeospatial.github.io/bblocks/annotated-schemas/geo/features/featureCollection/context.jsonld"
WARNING = '{ "warning": "no feature geometries generated" }'
SCHEMA = f"{D} string, ord string, feature string, alone boolean, context string"


@dataclass
class Written(WriterCommitMessage):
    """Pairs of a temporary name and the final one."""

    names: list


def file_name(dataset: str) -> str:
    """The end of the dataset's name without what paths can't have, and its checksum."""
    return f"{re.sub('[^A-Za-z0-9_-]+', '_', re.sub(r'[.][^./]*$', '', dataset))[-80:].strip('_')}-{zlib.crc32(dataset.encode()):08x}.geojson"


class GeoJsonWriter(DataSourceWriter):
    """Rows of a dataset come together and in order (``written`` sees to that); a row without a feature only says that there is such a dataset."""

    def __init__(self, options: dict):
        path = options["path"]
        if not path.startswith("file:") and "://" in path:
            raise ValueError("the folder of documents must be one that the driver and all executors have as a path")
        self.path = re.sub("^file:/*", "/", path).rstrip("/")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        names, out, dataset, first, count, context = [], None, None, None, 0, ""

        def close() -> None:
            nonlocal out
            if out is None:
                return
            head = f'"@context":["{CONTEXT}"{context}]'
            if count == 0:
                out.write(WARNING)
            elif first is not None:  # the only feature of a document that is a feature
                out.write(f"{first[:-1]},{head}}}")
            else:
                out.write(f"],{head}}}")
            out.close()
            out = None

        try:
            for r in iterator:
                if r.dataset_id != dataset:
                    close()
                    dataset, first, count, context = r.dataset_id, None, 0, f",{r.context}" if r.context else ""
                    names.append((f"{self.path}/_{uuid.uuid4().hex}.tmp", f"{self.path}/{file_name(dataset)}"))
                    out = open(names[-1][0], "w", encoding="utf-8")  # noqa: SIM115
                if r.feature is None:
                    continue
                count += 1
                if count == 1 and r.alone:
                    first = r.feature
                    continue
                if first is not None:
                    out.write('{"type":"FeatureCollection","features":[' + first)
                    first = None
                out.write(("," if count > 1 else '{"type":"FeatureCollection","features":[') + r.feature)
            close()
        except BaseException:
            if out is not None:
                out.close()
            for name, _ in names:
                if os.path.exists(name):
                    os.remove(name)
            raise
        return Written(names)

    def commit(self, messages: list) -> None:
        for m in messages:
            for name, final in m.names if m else ():
                os.replace(name, final)

    def abort(self, messages: list) -> None:
        for m in messages:
            for name, _ in m.names if m else ():
                if os.path.exists(name):
                    os.remove(name)


class GeoJsonDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geojson-documents"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> GeoJsonWriter:
        return GeoJsonWriter(self.options)


def written(features: DataFrame, path: str, docs: DataFrame | None = None) -> None:
    """Writes features (dataset_id, ord, feature: GeoJSON text) to a folder that the driver and all executors share, one document a dataset.

    A document is a FeatureCollection, or where docs (dataset_id, doc) has a feature for it and one feature came of it, that feature; docs without features become a warning.  Contexts of docs are added.
    """
    spark: SparkSession = features.sparkSession
    spark.dataSource.register(GeoJsonDataSource)
    none = lambda t: F.lit(None).cast(t)
    rows = features.select(D, "ord", "feature")
    if docs is None:
        rows = rows.select(D, "ord", "feature", F.lit(False).alias("alone"), none("string").alias("context"))
    else:
        c = get("doc", "$[\"@context\"]")
        each = F.when(kind(c).startswith("ARRAY"), items(c, "$")).when(kind(c) != "VOID", F.array(c)).otherwise(F.array().cast("array<variant>"))
        about = docs.select(D, F.coalesce(text("doc", "$.type") == "Feature", F.lit(False)).alias("alone"), F.nullif(F.array_join(F.transform(each, lambda x: F.to_json(x)), ","), F.lit("")).alias("context"))
        rows = rows.join(about, D, "left").select(D, "ord", "feature", F.coalesce("alone", F.lit(False)).alias("alone"), "context").unionByName(about.select(D, F.lit("").alias("ord"), none("string").alias("feature"), "alone", "context"))
    rows.repartition(D).sortWithinPartitions(D, "ord").write.format("geojson-documents").mode("append").option("path", path).save()
