"""Structural metrics of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import informative_count

PLACES = 6

# Attributes that identify or administer a node rather than describe it.
ADMINISTRATIVE = (
    "id", "internalId", "nodeId", "edgeId", "resourceId", "inventoryId",
    "identifier", "identifiers", "identifierValue", "identifierType", "identifierRegime", "normalizedValue", "doi", "orcid", "ror", "spdxId",
    "checksum", "filePath", "path", "bagUrl", "downloadUrl",
    "url", "host", "launchURL", "fundingAgencyUrl", "requestUrlBase", "requestUrlBaseFile", "toolIconUrl",
    "sourceArtifact", "sourceLocation", "extractionMethod", "curationStatus", "mentionCount",
    "createdAt", "updatedAt", "modifiedAt", "timestamp",
)


def administrative(service: str = "service") -> tuple[str, ...]:
    """The excluded names; two of them carry the name of the service that hosts the datasets."""
    return (*ADMINISTRATIVE, f"{service}ResourceId", f"{service}UserId")


def rounded(x: Column) -> Column:
    return F.bround(x, PLACES)


def average(total: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(rounded(total / n))


def incidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, class, incident, relation_types of every node; a self-loop counts once. Pairs (node, relation) are counted first,
    so hubs reach the second aggregation with one row a relation and task."""
    ends = edges.select("relation", F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
    per = ends.groupBy("id", "relation").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("id").agg(F.sum("n").alias("incident"), F.count(F.lit(1)).alias("relation_types"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return nodes.join(per, "id", "left").select(*nodes.columns, zero("incident"), zero("relation_types"))


def structural(nodes: DataFrame, edges: DataFrame, by: list[str] | None = None, excluded: tuple[str, ...] | None = None) -> DataFrame:
    """Density and richness, for the whole graph or by columns of nodes. Integer totals stand beside each ratio."""
    rows = incidence(nodes, edges).withColumn("informative", informative_count(F.col("attributes"), excluded or administrative()))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    sums = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("nodes"), total("informative").alias("informative_total"), total("incident").alias("incident_total"), total("relation_types").alias("relation_type_total"))
    attributes, incident = average(F.col("informative_total"), F.col("nodes")), average(F.col("incident_total"), F.col("nodes"))
    return sums.select(
        "*",
        attributes.alias("attributes_per_node"),
        incident.alias("incident_per_node"),
        rounded(attributes + incident).alias("information_density"),
        average(F.col("relation_type_total"), F.col("nodes")).alias("relational_richness"),
    )


def mention_count(attributes: Column, name: str = "mentionCount") -> Column:
    """A node's number of mentions: a positive whole number, 1 if not given; anything else raises."""
    given = F.try_element_at(attributes, F.lit(name))
    fits = given.rlike(r"\A[1-9][0-9]*\z")
    return F.when(given.isNull(), F.lit(1)).when(fits, given.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit(f"{name} must be a positive integer: "), given)).cast("bigint")).cast("bigint")


def consolidation(nodes: DataFrame, name: str = "mentionCount") -> DataFrame:
    """class (null: all), entities, mentions, ratio."""
    rows = nodes.select("class", mention_count(F.col("attributes"), name).alias("m"))
    sums = rows.groupingSets([["class"], []], "class").agg(F.grouping("class").alias("whole"), F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("m"), F.lit(0)).cast("bigint").alias("mentions"))
    return sums.select(F.when(F.col("whole") == 1, F.lit(None)).otherwise(F.col("class")).alias("class"), F.col("whole").cast("int").alias("whole"), "entities", "mentions", average(F.col("entities"), F.col("mentions")).alias("ratio"))


def has_mention_counts(nodes: DataFrame, name: str = "mentionCount") -> DataFrame:
    return nodes.agg(F.coalesce(F.bool_or(F.map_contains_key("attributes", name)), F.lit(False)).alias("explicit_counts"))


def snapshot_record(nodes: DataFrame, edges: DataFrame, label: str, display_name: str | None = None, order: int | None = None, input_path: str | None = None, input_sha256: str | None = None, stage: str = "pre-consolidation", service: str = "service") -> dict:
    """All metrics of a graph as one record; two small aggregates reach the driver (one row, and one a class)."""
    excluded = administrative(service)
    whole = structural(nodes, edges, excluded=excluded).first()
    ratios = consolidation(nodes).collect()
    ratio = lambda r: {"uniqueCanonicalEntities": r["entities"], "totalEntityMentions": r["mentions"], "ratio": r["ratio"]}
    return {
        "schemaVersion": "1.0.0",
        "label": label,
        "displayName": display_name or label,
        "trajectoryOrder": order,
        "input": {"path": input_path, "sha256": input_sha256},
        "counts": {"nodes": whole["nodes"], "edges": edges.count()},
        "metrics": {
            "informationDensity": {
                "combinedAveragePerNode": whole["information_density"],
                "averageInformativeAttributesPerNode": whole["attributes_per_node"],
                "averageIncidentEdgesPerNode": whole["incident_per_node"],
                "totalInformativeAttributes": whole["informative_total"],
                "totalIncidentEdgeOccurrences": whole["incident_total"],
            },
            "relationalRichness": {"averageDistinctRelationTypesPerNode": whole["relational_richness"], "totalPerNodeDistinctRelationTypes": whole["relation_type_total"]},
            "consolidation": {
                "stage": stage,
                "mentionCountAttribute": "mentionCount",
                "explicitMentionCounts": has_mention_counts(nodes).first()[0],
                "global": next(ratio(r) for r in ratios if r["whole"]),
                "perEntityType": {r["class"]: ratio(r) for r in sorted((r for r in ratios if not r["whole"]), key=lambda r: r["class"])},
            },
        },
        "methodology": {"administrativeAttributeExclusionSet": sorted(excluded)},
    }
