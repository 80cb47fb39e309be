"""Requirement lines: one grammar, for column expressions here and for whole manifests in functions.manifests.

The patterns hold in Java and in Python alike: START and END are the ends of the text in either."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import none_if_empty, strip

START, END = r"(?<![\s\S])", r"(?![\s\S])"
_SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*://"
#: What stands before a comment; a line that names an address and an egg has none.
COMMENTED = rf"{START}(?!(?=[\s\S]*://)[\s\S]*#egg=)([\s\S]*?)\s+#[^\n]*{END}"
#: An address of a repository: scheme, place, and (without a scheme) the whole; prefix, suffix, revision and fragment stand apart.
ADDRESS = rf"{START}\s*(?:git\+)?(?:({_SCHEME})([^#]*?)(?:\.git)?/*(?:@(?![^@/#]*\.git\s*{END})[^@/#]*)?|((?!{_SCHEME})[^#]*?)(?:\.git)?/*)(?:#[\s\S]*)?\s*{END}"
#: A requirement on a repository: name, scheme and host, path, revision, query, fragment.
REPOSITORY = rf"{START}\s*(?:([\s\S]*?) @ )?git\+({_SCHEME}[^/?#]*)?([^?#]*?)(?:@([^@?#]*))?(\?[^#]*)?(?:#([\s\S]*?))?\s*{END}"
#: Lines that are no requirements.
OPTIONS = ("-r", "-c", "-e", "#")
# Packages that are seldom required by hand; a manifest with many pins that names two of them is a lock.
INDIRECT = ("certifi", "charset-normalizer", "urllib3", "idna", "six")
LOCK_PINS = 60


def uncommented(line: Column) -> Column:
    """Without a comment at the end; fragments of repository addresses are no comments."""
    return strip(F.regexp_replace(line, COMMENTED, "$1"))


def canonical_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")


def repository_url(raw: Column) -> Column:
    """Address of a repository without scheme prefix, fragment, revision and suffix."""
    return F.regexp_replace(F.regexp_replace(raw, ADDRESS, "$1$2$3"), rf"{START}git@github\.com:", "https://github.com/")


def repository_parts(line: Column) -> Column:
    """Struct name, url, ref, subdirectory, egg of a requirement on a repository; null for any other line."""
    part = lambda k: F.regexp_extract(line, REPOSITORY, k)
    told = lambda key: none_if_empty(F.url_decode(F.regexp_extract(part(6), rf"(?:{START}|&){key}=([^&]*)", 1)))
    last = F.regexp_replace(F.regexp_extract(part(3), r"([^/]*)/*\z", 1), r"\.git\z", "")
    name = F.coalesce(none_if_empty(part(1)), told("egg"), none_if_empty(last))
    found = F.struct(canonical_name(name).alias("name"), repository_url(F.concat(part(2), part(3), part(5))).alias("url"), none_if_empty(part(4)).alias("ref"), told("subdirectory").alias("subdirectory"), told("egg").alias("egg"))
    return F.when(line.rlike(REPOSITORY), found)


def verdict(text: Column) -> Column:
    """direct or lock for the text of a requirements manifest: most of its requirements are marked by a version of Python, or
    there are many pins of which some are known as indirect. Counted within the row."""
    lines = F.filter(F.transform(F.split(text, "\n"), uncommented), lambda x: (x != "") & ~F.exists(F.array(*[F.lit(o) for o in OPTIONS]), lambda o: F.startswith(x, o)))
    count = lambda test: F.size(F.filter(lines, test))
    marked = count(lambda x: F.contains(x, F.lit(";")) & F.contains(x, F.lit("python_version")))
    pinned = count(lambda x: F.contains(x, F.lit("==")))
    indirect = count(lambda x: F.lower(x).rlike("|".join(INDIRECT)))
    by_marks = marked >= F.greatest(F.lit(1), F.floor(F.size(lines) * F.lit(0.8)))
    return F.when((F.size(lines) > 0) & (by_marks | (F.size(lines) >= LOCK_PINS) & (pinned >= LOCK_PINS) & (indirect >= 2)), "lock").otherwise("direct")


def conda_parts(entry: Column) -> Column:
    """Struct name, version of a conda entry, split at its first equals sign."""
    text = strip(entry)
    name = none_if_empty(strip(F.substring_index(text, "=", 1)))
    name = F.when(~F.startswith(text, F.lit("#")), canonical_name(name))
    version = none_if_empty(strip(F.regexp_replace(text, r"(?s)\A[^=]*=?", "")))
    return F.struct(name.alias("name"), F.when(name.isNotNull(), version).alias("version"))


def is_spdx(key: Column) -> Column:
    return F.coalesce((key != "NOASSERTION") & key.rlike(r"\A[A-Za-z0-9.+-]+\z"), F.lit(False))


def pinned_address(url: Column, commit: Column) -> Column:
    """Address of a repository at a commit; null if either is missing."""
    return F.concat(F.regexp_replace(none_if_empty(url), r"/+\z", ""), F.lit("/tree/"), none_if_empty(commit))
