"""Identifiers, addresses and node keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import looks_like_url, none_if_empty, slugify

# Patterns of identifiers.
ORCID = r"(?i)(\d{4}-\d{4}-\d{4}-\d{3}[\dX])"
ROR = r"(?i)ror\.org/([a-z0-9]{9})"
DOI = r"""(?i)(?:doi\.org/|doi:)?(10\.\d{4,9}/[^\s,;"'<>]+)"""
RESOURCE = r"(?i)/resource/([0-9a-f]{32})"
AUTHORITY = r"\A[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
DOI_IN_TEXT = r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b"
URL_IN_TEXT = r"""(https?://[^\s<>)\\\]"']+)"""
CODE_HOSTS = ("github.com", "gitlab.com", "bitbucket.org")


def _found(x: Column, pattern: str) -> Column:
    return none_if_empty(F.regexp_extract(x, pattern, 1))


def orcid(x: Column) -> Column:
    return F.upper(_found(x, ORCID))


def ror(x: Column) -> Column:
    return F.lower(_found(x, ROR))


def doi(x: Column) -> Column:
    return F.lower(F.regexp_replace(_found(x, DOI), r"\.+\z", ""))


def resource_id(x: Column, host: str | None = None) -> Column:
    """The 32-digit id of a dataset resource address; host limits it to one service."""
    pattern = RESOURCE if host is None else "(?i)" + host.replace(".", r"\.") + RESOURCE[4:]
    return F.lower(_found(x, pattern))


def first_url(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda v: v.rlike(r"\Ahttps?://")), F.lit(1))


def authority(url: Column) -> Column:
    """Host with user and port, as given; empty without a scheme."""
    return F.regexp_extract(url, AUTHORITY, 1)


def url_path(url: Column) -> Column:
    rest = F.regexp_replace(url, r"\A[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    return F.regexp_extract(rest, r"\A([^?#]*)", 1)


def is_repository_url(url: Column) -> Column:
    host = F.lower(authority(url))
    hit = F.lit(False)
    for h in CODE_HOSTS:
        hit = hit | F.contains(host, F.lit(h))
    return hit


def url_bucket(url: Column, dataset_host: str = "datasets.example.org") -> Column:
    """dataset, code, doi or other, by the first rule that holds anywhere in the address."""
    low = F.lower(F.regexp_replace(url, r"[.,)]+\z", ""))
    return (
        F.when(F.contains(low, F.lit(dataset_host)), "dataset")
        .when(F.contains(low, F.lit("github.com")), "code")
        .when(F.contains(low, F.lit("doi.org/")) | low.rlike(DOI_IN_TEXT), "doi")
        .otherwise("other")
    )


def spdx_of_url(url: Column) -> Column:
    return F.when(F.contains(F.lower(url), F.lit("creativecommons.org/licenses/by/4.0")), "CC-BY-4.0")


def license_key(url: Column, statement: Column) -> Column:
    return F.concat(
        F.lit("license:"),
        F.coalesce(
            F.lower(spdx_of_url(url)),
            F.concat(F.lit("url:"), slugify(none_if_empty(url))),
            F.concat(F.lit("name:"), slugify(F.coalesce(none_if_empty(statement), F.lit("unknown-license")))),
        ),
    )


def person_key(name: Column, identifiers: Column) -> Column:
    """Key of a person: the first valid ORCID among identifiers (id_type, url), else the name. Struct id, regime, orcid."""
    valid = F.filter(F.transform(F.filter(identifiers, lambda i: i["id_type"] == "ORCID"), lambda i: orcid(i["url"])), lambda o: o.isNotNull())
    found = F.try_element_at(valid, F.lit(1))
    by_name = F.concat(F.lit("person:name:"), slugify(F.coalesce(none_if_empty(name), F.lit("unknown-person"))))
    return F.struct(
        F.coalesce(F.concat(F.lit("person:orcid:"), found), by_name).alias("id"),
        F.when(found.isNotNull(), "ORCID").otherwise("name-key").alias("regime"),
        found.alias("orcid"),
    )


def organization_key(name: Column, url: Column) -> Column:
    found = ror(url)
    return F.struct(
        F.coalesce(F.concat(F.lit("organization:ror:"), found), F.concat(F.lit("organization:name:"), slugify(name))).alias("id"),
        F.when(found.isNotNull(), "ROR").otherwise("name-key").alias("regime"),
        found.alias("ror"),
    )


def identifier_key(x: Column) -> Column:
    return F.concat(F.lit("identifier:"), slugify(x))


def award_key(agency: Column, number: Column, title: Column) -> Column:
    agency = F.coalesce(none_if_empty(agency), F.lit("unknown-agency"))
    number = F.coalesce(none_if_empty(number), none_if_empty(title), F.lit("unknown-award"))
    return F.concat(F.lit("award:"), slugify(agency), F.lit(":"), slugify(number))


def subject_key(x: Column) -> Column:
    return F.concat(F.lit("subject:"), slugify(x))


def file_key(resource: Column, path: Column, name: Column, whole: Column) -> Column:
    return F.concat(resource, F.lit(":file:"), slugify(F.coalesce(none_if_empty(path), none_if_empty(name), whole)))


def tool_key(url: Column, title: Column) -> Column:
    host = F.coalesce(none_if_empty(authority(url)), none_if_empty(url))
    return F.coalesce(
        F.concat(F.lit("tool:url:"), slugify(host)),
        F.concat(F.lit("tool:name:"), slugify(F.coalesce(none_if_empty(title), F.lit("unknown-tool")))),
    )


def embedded_urls(target: Column, urls: Column) -> Column:
    """The addresses of a relation; its target comes first if it is an address and not among them."""
    urls = F.coalesce(urls, F.array().cast("array<string>"))
    lead = looks_like_url(target) & ~F.array_contains(urls, F.coalesce(target, F.lit("")))
    return F.when(lead, F.concat(F.array(target), urls)).otherwise(urls)
