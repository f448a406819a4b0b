"""Prefixes of compact names: collected from several sources, and ids looked up with them in a table of geometries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import local_name

D = "dataset_id"


def normalised(given: Mapping[str, str] | Iterable[str] | str | None) -> dict[str, str]:
    """prefix to URI of a mapping, of ``prefix=uri`` texts, or of bare URIs (each is its own prefix)."""
    if not given:
        return {}
    if isinstance(given, Mapping):
        return {str(k): str(v) for k, v in given.items()}
    out = {}
    for item in [given] if isinstance(given, str) else given:
        prefix, equals, uri = item.partition("=")
        if equals and "/" not in prefix and ":" not in prefix:
            out.setdefault(prefix.strip(), uri.strip())
        elif item.strip():
            out.setdefault(item.strip(), item.strip())
    return out


def of_context(context: object) -> dict[str, str]:
    """Prefixes of a JSON-LD context: terms whose URI ends in / or #, also as {"@id": uri}; lists are merged, remote contexts skipped."""
    out: dict[str, str] = {}
    for part in context if isinstance(context, list) else [context]:
        if isinstance(part, Mapping):
            for term, value in part.items():
                uri = value.get("@id") if isinstance(value, Mapping) else value
                if not term.startswith("@") and isinstance(uri, str) and uri.endswith(("/", "#")):
                    out.setdefault(term, uri)
    return out


def merged(*sources: Mapping[str, str]) -> dict[str, str]:
    """All sources, in the order of their rank: the first that declares a prefix decides it."""
    out: dict[str, str] = {}
    for source in sources:
        for prefix, uri in source.items():
            out.setdefault(prefix, uri)
    return out


def table(spark, namespaces: Mapping[str, str]) -> DataFrame:
    """rank, prefix and uri: a small table (as many rows as prefixes)."""
    return spark.createDataFrame([(i, p, u) for i, (p, u) in enumerate(namespaces.items())], "rank int, prefix string, uri string")


def candidates(ids: DataFrame, names: DataFrame) -> DataFrame:
    """dataset_id, ref, rank and key: what a reference may be called, best first.

    As it stands; with its prefix replaced by that prefix's URI; then its local name behind every URI in order of declaration.
    """
    held = names.agg(F.array_sort(F.collect_list(F.struct("rank", "prefix", "uri"))).alias("ns"))
    rows = ids.select(D, "ref").distinct().join(F.broadcast(held))  # one row of all prefixes
    prefix, local = F.substring_index("ref", ":", 1), local_name(F.col("ref"))
    own = F.transform(F.filter("ns", lambda n: F.col("ref").contains(":") & (n["prefix"] == prefix)), lambda n: F.concat(n["uri"], local))
    every = F.transform("ns", lambda n: F.concat(n["uri"], local))
    keys = F.array_distinct(F.concat(F.array("ref"), own, every))
    return rows.select(D, "ref", F.posexplode(keys).alias("rank", "key"))


def looked_up(ids: DataFrame, geometries: DataFrame, names: DataFrame, id_: str = "id") -> DataFrame:
    """dataset_id, ref, the id found (of the best candidate) for references (dataset_id, ref); null where none is known."""
    every = candidates(ids, names)
    hit = every.join(geometries.select(D, F.col(id_).alias("key")).distinct(), [D, "key"])
    best = hit.groupBy(D, "ref").agg(F.min_by("key", "rank").alias("found"))
    return ids.select(D, "ref").distinct().join(best, [D, "ref"], "left")
