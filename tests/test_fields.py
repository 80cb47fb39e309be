"""Edges of one relation come from the fields that its rules read, and each array of mentions is computed once."""

import pytest
from pyspark.sql import functions as F

from graphloom.plans import catalogue
from graphloom.plans.extraction import READS, RECORD, extract_edges

from .conftest import SF
from .test_extraction import RECORDS

NAMES = [
    "coversPeriod",
    "fundedBy",
    "hasContributor",
    "hasCreator",
    "hasFile",
    "hasIdentifier",
    "hasLicense",
    "hasMember",
    "hasResourceType",
    "hasSpatialCoverage",
    "hasSubject",
    "hasToolConfig",
    "isExecutedBy",
    "isMemberOf",
    "launchesApp",
    "references",
    "referencesFeature",
]


@pytest.fixture(scope="module")
def records(spark):
    empty = spark.createDataFrame([], RECORD)
    return spark.createDataFrame([{k: None for k in empty.columns} | r for r in RECORDS], empty.schema)


@pytest.mark.parametrize("name", NAMES)
def test_fields_that_rules_read_suffice(records, name):
    found = extract_edges(records.select("resource_id", *READS[name]), name).collect()
    assert found and {r.id: r for r in found} == {r.id: r for r in extract_edges(records, name).collect()}


@pytest.mark.parametrize("name", NAMES)
def test_no_filter_computes_mentions_again(spark, name):
    plan = catalogue.QUERIES[f"extract_edge_{name}"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(" not in plan


def test_people_are_found_once(spark):
    """Three readings of the records: of their own mentions, of the identifiers listed, of the people."""
    plan = catalogue.QUERIES["extract_edge_hasIdentifier"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3


#: Relations found by their rules alone.
TOLD_LATE = [
    "references",
    "isExecutedBy",
    "hasCreator",
    "hasLicense",
    "hasContributor",
    "hasMember",
    "hasResourceType",
    "hasFile",
    "isMemberOf",
    "hasSubject",
    "launchesApp",
    "hasSpatialCoverage",
    "hasToolConfig",
    "fundedBy",
]


@pytest.mark.parametrize("name", TOLD_LATE)
def test_evidence_is_made_of_merged_mentions(spark, name):
    """What follows from the record is not carried through the merge."""
    lines = catalogue.QUERIES[f"extract_edge_{name}"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    merges = [k for k, line in enumerate(lines) if line.lstrip(" :+-").startswith("Aggregate [source")]
    assert merges
    for k in merges:
        below = next((n for n in range(k + 1, len(lines)) if depth(lines[n]) <= depth(lines[k])), len(lines))
        assert "deterministic" not in "".join(lines[k + 1 : below])


@pytest.mark.parametrize("name", TOLD_LATE)
def test_a_record_without_an_id_is_an_error(records, name):
    with pytest.raises(Exception, match="a record has no resource_id"):
        extract_edges(records.withColumn("resource_id", F.lit("")), name).collect()
