"""A project's manifest: read strictly on the driver, its graph as DataFrames."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinplan.functions.identifiers import Refused

MOST_BYTES = 256 << 20
# Schema versions that are read, and resources that a call may name.
VERSIONS = ("v10", "v11", "v12")
RESOURCES = ("model", "seed", "snapshot")


def _once(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Refused("UNSUPPORTED_MANIFEST_SCHEMA", "a key is there twice")
    return out


def load(path: str) -> dict:
    """The manifest's JSON. Size, encoding, repeated keys, version, ids and paths are checked; a bad entry is refused, never skipped."""
    raw = Path(path).read_bytes()
    if len(raw) > MOST_BYTES:
        raise Refused("UNSUPPORTED_MANIFEST_SCHEMA", "too large")
    try:
        found = json.loads(raw.decode("utf-8"), object_pairs_hook=_once)
    except ValueError as e:
        raise Refused("UNSUPPORTED_MANIFEST_SCHEMA", "not JSON") from e
    version = found.get("metadata", {}).get("dbt_schema_version", "") if isinstance(found, dict) else ""
    if not any(f"/{v}.json" in version for v in VERSIONS):
        raise Refused("UNSUPPORTED_MANIFEST_SCHEMA", version)
    for section in ("nodes", "sources"):
        for key, node in found.get(section, {}).items():
            file = node.get("original_file_path") or "" if isinstance(node, dict) else None
            if file is None or node.get("unique_id") != key or Path(file).is_absolute() or ".." in Path(file).parts:
                raise Refused("UNSUPPORTED_MANIFEST_SCHEMA", key)
    return found


def graph(spark: SparkSession, manifest: dict) -> tuple[DataFrame, DataFrame]:
    """nodes (uid, kind, package, name, source_name, path, relation) and edges (owner, uid)."""
    nodes, edges = [], []
    for uid, n in manifest.get("nodes", {}).items():
        if n.get("resource_type") in RESOURCES:
            nodes.append((uid, "ref", n.get("package_name"), n.get("name"), None, n.get("original_file_path"), n.get("relation_name")))
        edges += [(uid, d) for d in n.get("depends_on", {}).get("nodes", [])]
    for uid, n in manifest.get("sources", {}).items():
        nodes.append((uid, "source", n.get("package_name"), n.get("name"), n.get("source_name"), n.get("original_file_path"), n.get("relation_name")))
    return (
        spark.createDataFrame(nodes, "uid string, kind string, package string, name string, source_name string, path string, relation string"),
        spark.createDataFrame(edges, "owner string, uid string"),
    )


def resolve(calls: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each call (owner, kind, package, name, source_name) with the one node among the owner's dependencies that it names; code says where there is not one."""
    c, n = calls.withColumn("call", F.xxhash64("owner", "kind", "package", "name", "source_name")).dropDuplicates(["call"]).alias("c"), nodes.alias("n")
    within = edges.join(n, "uid").alias("n")
    match = (
        (F.col("c.owner") == F.col("n.owner")) & (F.col("c.kind") == F.col("n.kind")) & (F.col("c.name") == F.col("n.name"))
        & F.col("c.source_name").eqNullSafe(F.col("n.source_name")) & (F.col("c.package").isNull() | (F.col("c.package") == F.col("n.package")))
    )
    found = c.join(within, match, "left").withColumn("candidates", F.count("n.uid").over(Window.partitionBy("c.call")))
    one = F.col("candidates") == 1
    return found.select("c.owner", "c.kind", "c.package", "c.name", "c.source_name", F.when(one, F.col("n.uid")).alias("uid"), F.when(one, "OK").otherwise("SOURCE_MAPPING_AMBIGUOUS").alias("code")).distinct()
