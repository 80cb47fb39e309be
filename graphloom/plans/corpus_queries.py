"""Catalogue: raw repository folders made from suppliers, with every kind of manifest, and the records built of them, block by
block. What a supplier's key leaves after division decides which files its repository has and what stands in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import differing, missing_keys
from . import repositories
from .registry import query
from .star import read


def _cat(*xs) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])


def _manifests(key: Column) -> tuple:
    """Kind of manifest by the key's rest by 8: path, text."""
    return (
        ("requirements.txt", _cat("Num_Py>=1.", key, "  # fast\nrequests[socks]==2.0; python_version > '3'\ngit+https://github.com/Org/Tool", key, ".git@v1#egg=tool-x&subdirectory=sub\n-r other.txt\n-e .\n???\npip\n")),
        ("env/environment.yml", _cat("name: env", key, "\nchannels: [forge]\ndependencies:\n  - python=3.", key % 10, "\n  - Net_CDF=4.1\n  - pip:\n    - xarray>", key % 5, "\n")),
        ("pyproject.toml", _cat('[project]\nname = "Pkg', key, '"\nversion = "0.', key, '"\ndependencies = ["NumPy", "scipy>1"]\nrequires-python = ">=3.9"\nauthors = [{name = "B", email = "b@x"}, {name = "A"}]\n[project.optional-dependencies]\ntest = ["pytest", "numpy"]\n[tool.poetry.dependencies]\npython = "^3.8"\nrich = "*"\nfork = {git = "https://github.com/o/fork.git", tag = "t"}\n[tool.poetry.group.dev.dependencies]\nblack = {version = "^23"}\n[build-system]\nrequires = ["setuptools", "cython"]\n')),
        ("setup.cfg", _cat("[options]\ninstall_requires =\n  a", key, "\n  b<2\npython_requires = >=3.", key % 10, "\n[options.extras_require]\ndoc = sphinx\n[metadata]\nname = n", key, "\nauthor = A\nlicense = MIT\n")),
        ("setup.py", _cat("from setuptools import setup\nsetup(install_requires=['a', 'b>", key, "'], extras_require={'x': ['c']})\n")),
        ("Pipfile", _cat('[packages]\nflask = "*"\n[dev-packages]\ntox = ">', key, '"\n[requires]\npython_version = "3.', key % 10, '"\n')),
        ("Pipfile.lock", _cat('{"default": {"b', key, '": 1, "a": 2}, "develop": {"c": 1}}')),
        ("conda/requirements-lock.txt", _cat("a==", key, "; python_version > '3'\n# note\nb==1; python_version > '3'\n")),
    )


def _readme(key: Column) -> Column:
    return _cat("# Repo ", key, "\nSee https://github.com/org/r", key, "). Data https://datasets.example.org/resource/x, https://doi.org/10.1234/ab", key, " and http://other.org/a. Also 10.5555/zz", key, ".")


def _cff(key: Column) -> Column:
    return F.when(key % 2 == 0, _cat("cff-version: 1.2.0\ntitle: Soft ", key, "\ndoi: 10.1/", key, "\nauthors:\n  - family-names: F", key, "\n    given-names: G\n  - orcid: x\nkeywords: [b, a]\n")).otherwise(F.lit("title: FIXME\nauthors:\n  - family-names: FIXME\n"))


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """repo, path, is_content, text: see repositories.raw_files."""
    key = F.col("s_suppkey")
    manifests = _manifests(key)
    place = key % len(manifests)
    manifest = F.element_at(F.array(*[F.lit(p) for p, _ in manifests]), (place + 1).cast("int"))
    body = F.element_at(F.array(*[t for _, t in manifests]), (place + 1).cast("int"))
    licence = F.when(key % 4 == 0, '{"key":"mit","name":"MIT","spdx_id":"MIT","url":"u"}').when(key % 4 == 1, '{"key":"other","spdx_id":"NOASSERTION"}').when(key % 4 == 3, '{"key":"x","spdx_id":"Bad Id"}').otherwise("null")
    flag = lambda by: F.when(key % by == 0, "true").otherwise("false")
    address = F.when(key % 10 != 9, _cat('"https://github.com/org/r', key, '/"')).otherwise("null")
    metadata = F.when(key % 25 == 0, "{").otherwise(_cat('{"id":', key, ',"name":"Repo', key, '","full_name":"org/r', key, '","html_url":', address, ',"default_branch":"main","language":"Python","topics":["t', key % 3, '"],"fork":', flag(2), ',"archived":', flag(3), ',"size_kb":', key * 2, ',"license":', licence, "}"))
    entry = lambda path, size, got, reason: _cat('{"path":"', path, '","file_name":"', F.substring_index(F.lit(path) if isinstance(path, str) else path, "/", -1), '","extension":"', F.regexp_extract(F.lit(path) if isinstance(path, str) else path, r"[^/.](\.[^./]+)$", 1), '","size_bytes":', size, ',"downloaded":', got, ',"selection_reason":', reason, "}")
    citation = F.when(key % 3 == 0, _cat(",", entry("CITATION.cff", key, "true", '"allowed_exact_filename"'))).when(key % 3 == 1, _cat(",", entry("CITATION.md", key, "true", '"allowed_exact_filename"'))).otherwise("")
    manifest_entry = entry(manifest, key + 5, "true", '"allowed_exact_filename"')
    listed = _cat("[", entry("README.md", key + 10, "true", '"allowed_exact_filename"'), ",", manifest_entry, ",", entry("docker/Dockerfile", 7 + key % 2, flag(2), "null"), citation, "]")
    people = _cat('[{"id":', key + 1, ',"login":"Bob","type":"User","contributions":5},{"id":null,"login":"bot","type":"Bot","contributions":1},{"id":', key, ',"login":"Ann","type":"User","contributions":9}]')
    own = [("repo_metadata.json", metadata), ("files_manifest.json", listed), ("contributors.json", people)]
    rows = [F.struct(F.lit(p).alias("path"), F.lit(False).alias("is_content"), t.alias("text")) for p, t in own]
    rows += [F.struct(p.alias("path"), F.lit(True).alias("is_content"), t.alias("text")) for p, t in ((F.lit("README.md"), _readme(key)), (manifest, body))]
    some = lambda test, path, content, text: F.when(test, F.array(F.struct(F.lit(path).alias("path"), F.lit(content).alias("is_content"), text.alias("text")))).otherwise(F.array())
    more = [
        some(key % 7 != 0, "archive_info.json", False, _cat('{"frozen_commit_sha":"sha', key, '","archive_format":"zip"}')),
        some(key % 3 == 0, "CITATION.cff", True, _cff(key)),
        some(key % 3 == 1, "CITATION.md", True, F.lit("cite me")),
    ]
    found = read(spark, sf, "supplier").select(_cat("repo", key).alias("repo"), F.explode(F.concat(F.array(*rows), *more)).alias("f"))
    return found.select("repo", "f.*")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return repositories.build(raw(spark, sf))


_S = "s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 25 = 0 THEN 'repo' || s_suppkey ELSE 'Repo' || s_suppkey END AS name, s_suppkey % 25 = 0 AS broken FROM supplier)"


@query(
    "repo_record",
    f"""WITH {_S} SELECT name, CASE WHEN NOT broken THEN k END AS repo_id, CASE WHEN NOT broken THEN 'org/r' || k END AS full_name, CASE WHEN NOT broken AND k % 10 <> 9 THEN 'https://github.com/org/r' || k || '/' END AS html_url,
    CASE WHEN NOT broken THEN 'main' END AS default_branch, CASE WHEN broken THEN '' ELSE 't' || k % 3 END AS topics, NOT broken AND k % 2 = 0 AS fork, NOT broken AND k % 3 = 0 AS archived, false AS disabled,
    CASE WHEN NOT broken THEN k * 2 END AS size_kb, CASE WHEN k % 7 <> 0 THEN 'sha' || k END AS commit_sha, CASE WHEN NOT broken AND k % 10 <> 9 AND k % 7 <> 0 THEN 'https://github.com/org/r' || k || '/tree/sha' || k END AS artifact FROM s""",
)
def repo_record(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("name", "repo_id", "full_name", "html_url", "default_branch", F.array_join("topics", ",").alias("topics"), "fork", "archived", "disabled", F.col("github_stats.size_kb").alias("size_kb"), F.col("archive.frozen_commit_sha").alias("commit_sha"), F.col("provenance.source_artifact").alias("artifact"))


@query(
    "repo_files",
    f"""WITH {_S} SELECT name, 3 + (k % 3 < 2)::BIGINT AS total_count, 2 + (k % 2 = 0)::BIGINT + (k % 3 < 2)::BIGINT AS downloaded_count, true AS has_dockerfile, 2 + (k % 3 < 2)::BIGINT AS exact, 1::BIGINT AS no_reason,
    'docker/Dockerfile:' || (7 + k % 2) AS dockerfiles, array_to_string(list_sort(['README.md:readme', ['requirements.txt:dependency_manifest', 'env/environment.yml:environment_manifest', 'pyproject.toml:dependency_manifest', 'setup.cfg:dependency_manifest', 'setup.py:dependency_manifest', 'Pipfile:dependency_manifest', 'Pipfile.lock:dependency_manifest', 'conda/requirements-lock.txt:dependency_manifest'][k % 8 + 1]]
      || CASE WHEN k % 2 = 0 THEN ['docker/Dockerfile:dockerfile'] ELSE [] END || CASE k % 3 WHEN 0 THEN ['CITATION.cff:citation_cff'] WHEN 1 THEN ['CITATION.md:citation_md'] ELSE [] END), ',') AS downloaded FROM s""",
)
def repo_files(spark: SparkSession, sf: str) -> DataFrame:
    f = lambda c: F.col(f"files.{c}")
    listed = F.array_join(F.array_sort(F.transform(f("downloaded"), lambda x: F.concat(x["path"], F.lit(":"), x["file_role"]))), ",")
    docker = F.array_join(F.transform(f("dockerfiles"), lambda x: _cat(x["path"], ":", x["size_bytes"])), ",")
    reason = f("selection_reason_histogram")
    return corpus(spark, sf).select("name", f("total_count").alias("total_count"), f("downloaded_count").alias("downloaded_count"), f("has_dockerfile").alias("has_dockerfile"), reason["allowed_exact_filename"].alias("exact"), reason["None"].alias("no_reason"), docker.alias("dockerfiles"), listed.alias("downloaded"))


@query(
    "repo_license",
    f"""WITH {_S} SELECT name, CASE WHEN NOT broken THEN CASE k % 4 WHEN 0 THEN 'mit' WHEN 1 THEN 'other' WHEN 3 THEN 'x' END END AS key, CASE WHEN NOT broken AND k % 4 <> 2 THEN k % 4 = 0 END AS is_spdx FROM s""",
)
def repo_license(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("name", F.col("license.key").alias("key"), F.col("license.is_spdx").alias("is_spdx"))


@query(
    "repo_identifiers",
    f"""WITH {_S} SELECT name, 'repo_url' AS id_type, 'https://github.com/org/r' || k || '/' AS value, 'repo_metadata.json:html_url' AS source_path FROM s WHERE NOT broken AND k % 10 <> 9
    UNION ALL SELECT name, 'commit_sha', 'sha' || k, 'archive_info.json:frozen_commit_sha' FROM s WHERE k % 7 <> 0
    UNION ALL SELECT name, 'doi', '10.1/' || k, 'CITATION.cff:doi' FROM s WHERE k % 6 = 0""",
)
def repo_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("name", F.explode("identifiers").alias("i")).select("name", "i.*")


@query(
    "repo_contributors",
    f"""WITH {_S}, c AS (SELECT name, unnest([k, k + 1, NULL]) AS github_id, unnest(['Ann', 'Bob', 'bot']) AS login, unnest([false, false, true]) AS is_bot, unnest([9, 5, 1])::BIGINT AS contributions, unnest([2, 0, 1]) AS place, unnest([0, 1, 2]) AS at_place FROM s)
    SELECT name, at_place, github_id, login, is_bot, contributions, 'contributors.json[' || place || ']' AS source_path FROM c""",
)
def repo_contributors(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus(spark, sf).select("name", F.posexplode("contributors").alias("at_place", "c"))
    return rows.select("name", "at_place", "c.github_id", "c.login", "c.is_bot", "c.contributions", "c.source_path")


@query(
    "repo_readme",
    f"""WITH {_S} SELECT name, true AS present, 'README.md' AS source_path, 'https://datasets.example.org/resource/x' AS dataset, 'https://github.com/org/r' || k AS code, '10.1234/ab' || k || '|10.5555/zz' || k || '|https://doi.org/10.1234/ab' || k AS dois, 'http://other.org/a' AS other FROM s""",
)
def repo_readme(spark: SparkSession, sf: str) -> DataFrame:
    said = lambda c: F.array_join(F.col(f"readme.deterministic_urls.{c}"), "|").alias(c)
    return corpus(spark, sf).select("name", F.col("readme.present").alias("present"), F.col("readme.source_path").alias("source_path"), said("dataset"), said("code"), said("dois"), said("other"))


@query(
    "repo_citation",
    f"""WITH {_S} SELECT name, CASE k % 3 WHEN 0 THEN 'cff' WHEN 1 THEN 'md' ELSE 'none' END AS format, k % 3 = 0 AS present, k % 6 = 3 AS placeholder, CASE k % 6 WHEN 0 THEN 'Soft ' || k WHEN 3 THEN 'FIXME' END AS title, CASE WHEN k % 6 = 0 THEN '10.1/' || k END AS doi,
    CASE WHEN k % 6 = 0 THEN 'F' || k || ',G,-|-,-,x' ELSE '' END AS authors, CASE WHEN k % 6 = 0 THEN 'b,a' ELSE '' END AS keywords, CASE WHEN k % 3 = 1 THEN 'CITATION.md' END AS citation_md FROM s""",
)
def repo_citation(spark: SparkSession, sf: str) -> DataFrame:
    c = lambda n: F.col(f"citation.{n}")
    shown = F.transform(c("software_authors"), lambda a: F.concat_ws(",", *[F.coalesce(a[x], F.lit("-")) for x in ("family_names", "given_names", "orcid")]))
    listed = lambda x, by: F.coalesce(F.array_join(x, by), F.lit(""))
    return corpus(spark, sf).select("name", c("format").alias("format"), c("present").alias("present"), c("placeholder").alias("placeholder"), c("title").alias("title"), c("doi").alias("doi"), listed(shown, "|").alias("authors"), listed(c("keywords"), ",").alias("keywords"), F.col("citation_md.source_path").alias("citation_md"))


# what each kind of manifest asks for: (rest by 8, SQL of name, version, group, ecosystem, manifest, line)
_NEEDS = [
    (0, "'num-py'", "'>=1.' || k", "runtime", "pypi", "'requirements.txt'"),
    (0, "'requests'", "'==2.0'", "runtime", "pypi", "'requirements.txt'"),
    (1, "'net-cdf'", "'4.1'", "runtime", "conda", "'env/environment.yml'"),
    (1, "'xarray'", "'>' || k % 5", "runtime", "pypi", "'env/environment.yml'"),
    (2, "'numpy'", "NULL", "runtime", "pypi", "'pyproject.toml'"),
    (2, "'scipy'", "'>1'", "runtime", "pypi", "'pyproject.toml'"),
    (2, "'pytest'", "NULL", "optional", "pypi", "'pyproject.toml'"),
    (2, "'rich'", "NULL", "runtime", "pypi", "'pyproject.toml'"),
    (2, "'black'", "'^23'", "dev", "pypi", "'pyproject.toml'"),
    (2, "'cython'", "NULL", "build", "pypi", "'pyproject.toml'"),
    (3, "'a' || k", "NULL", "runtime", "pypi", "'setup.cfg'"),
    (3, "'b'", "'<2'", "runtime", "pypi", "'setup.cfg'"),
    (3, "'sphinx'", "NULL", "optional", "pypi", "'setup.cfg'"),
    (4, "'a'", "NULL", "runtime", "pypi", "'setup.py'"),
    (4, "'b'", "'>' || k", "runtime", "pypi", "'setup.py'"),
    (4, "'c'", "NULL", "optional", "pypi", "'setup.py'"),
    (5, "'flask'", "NULL", "runtime", "pypi", "'Pipfile'"),
    (5, "'tox'", "'>' || k", "dev", "pypi", "'Pipfile'"),
]
_TYPES = {"requirements.txt": "requirements_txt", "env/environment.yml": "environment_yml", "pyproject.toml": "pyproject_toml", "setup.cfg": "setup_cfg", "setup.py": "setup_py", "Pipfile": "pipfile"}


@query(
    "repo_dependencies",
    f"WITH {_S} " + " UNION ALL ".join(f"SELECT name AS repo, {n} AS name, {v} AS version_spec, '{g}' AS dep_group, '{e}' AS ecosystem, {2 if n == chr(39) + 'numpy' + chr(39) else 1} AS sources, {p} AS manifest_path, '{_TYPES[p.strip(chr(39))]}' AS manifest_type FROM s WHERE k % 8 = {rest}" for rest, n, v, g, e, p in _NEEDS),
)
def repo_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus(spark, sf).select(F.col("name").alias("repo"), F.explode("dependencies").alias("d"))
    first = F.element_at("d.sources", 1)
    return rows.select("repo", "d.name", "d.version_spec", "d.dep_group", "d.ecosystem", F.size("d.sources").alias("sources"), first["manifest_path"].alias("manifest_path"), first["manifest_type"].alias("manifest_type"))


@query(
    "repo_vcs_dependencies",
    f"""WITH {_S} SELECT name AS repo, 'tool-x' AS name, 'https://github.com/Org/Tool' || k AS vcs_url, 'v1' AS ref, 'sub' AS subdirectory, 'tool-x' AS egg, 'runtime' AS dep_group FROM s WHERE k % 8 = 0
    UNION ALL SELECT name, 'fork', 'https://github.com/o/fork', 't', NULL, NULL, 'runtime' FROM s WHERE k % 8 = 2""",
)
def repo_vcs_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus(spark, sf).select(F.col("name").alias("repo"), F.explode("repo_dependencies").alias("d"))
    return rows.select("repo", "d.name", "d.vcs_url", "d.ref", "d.subdirectory", "d.egg", "d.dep_group")


@query(
    "repo_environments",
    f"""WITH {_S} SELECT name AS repo, 'conda_env' AS kind, 'env' || k AS name, '3.' || k % 10 AS python_version, false AS is_lock, NULL AS pins, 'env/environment.yml' AS source_path FROM s WHERE k % 8 = 1
    UNION ALL SELECT name, 'python_constraint', NULL, unnest(['>=3.9', '^3.8']), false, NULL, 'pyproject.toml' FROM s WHERE k % 8 = 2
    UNION ALL SELECT name, 'python_constraint', NULL, '>=3.' || k % 10, false, NULL, 'setup.cfg' FROM s WHERE k % 8 = 3
    UNION ALL SELECT name, 'python_constraint', NULL, '3.' || k % 10, false, NULL, 'Pipfile' FROM s WHERE k % 8 = 5
    UNION ALL SELECT name, 'pipfile_lock', NULL, NULL, true, 'b' || k || ',a,c', 'Pipfile.lock' FROM s WHERE k % 8 = 6
    UNION ALL SELECT name, 'requirements_lock', NULL, NULL, true, 'a==' || k || '; python_version > ''3'',b==1; python_version > ''3''', 'conda/requirements-lock.txt' FROM s WHERE k % 8 = 7""",
)
def repo_environments(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus(spark, sf).select(F.col("name").alias("repo"), F.explode("execution_environment").alias("e"))
    return rows.select("repo", "e.kind", "e.name", "e.python_version", "e.is_lock", F.array_join("e.pinned_set_evidence", ",").alias("pins"), "e.source_path")


@query(
    "repo_software",
    f"""WITH {_S} SELECT name AS repo, 'pyproject_toml' AS manifest_type, 'Pkg' || k AS name, '0.' || k AS version, 'A,-|B,b@x' AS authors, NULL AS license FROM s WHERE k % 8 = 2
    UNION ALL SELECT name, 'pyproject_toml', NULL, NULL, '', NULL FROM s WHERE k % 8 = 2
    UNION ALL SELECT name, 'setup_cfg', 'n' || k, NULL, 'A,-', 'MIT' FROM s WHERE k % 8 = 3""",
)
def repo_software(spark: SparkSession, sf: str) -> DataFrame:
    kind = "manifest_type string, name string, version string, authors array<struct<name:string,email:string>>, license string"
    rows = corpus(spark, sf).select(F.col("name").alias("repo"), F.explode("software_metadata").alias("j")).select("repo", F.from_json("j", kind).alias("m"))
    shown = F.array_join(F.transform("m.authors", lambda a: F.concat(F.coalesce(a["name"], F.lit("-")), F.lit(","), F.coalesce(a["email"], F.lit("-")))), "|")
    return rows.select("repo", "m.manifest_type", "m.name", "m.version", shown.alias("authors"), "m.license")


_WARNINGS = f"""warned AS (
    SELECT name, 'repo_metadata.json' AS file, 'invalid_json' AS issue FROM s WHERE broken
    UNION ALL SELECT name, 'provenance', 'source_artifact_missing_html_url_or_frozen_commit_sha' FROM s WHERE broken OR k % 10 = 9 OR k % 7 = 0
    UNION ALL SELECT name, 'requirements.txt', unnest(['include_directive_skipped: -r other.txt', 'editable_self_reference_skipped: -e .', 'requirement_unparseable: ???']) FROM s WHERE k % 8 = 0
    UNION ALL SELECT name, 'CITATION.cff', 'cff_placeholder_detected' FROM s WHERE k % 6 = 3)"""


@query("repo_warnings", f"WITH {_S}, {_WARNINGS} SELECT name, file, issue FROM warned")
def repo_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("name", F.explode("provenance.parse_warnings").alias("w")).select("name", "w.file", "w.issue")


@query(
    "repo_classifications",
    f"""WITH {_S} SELECT name, ['requirements.txt', 'env/environment.yml', 'pyproject.toml', 'setup.cfg', 'setup.py', 'Pipfile', 'Pipfile.lock', 'conda/requirements-lock.txt'][k % 8 + 1] AS path, CASE WHEN k % 8 > 5 THEN 'lock' ELSE 'direct' END AS verdict FROM s""",
)
def repo_classifications(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("name", F.explode("provenance.manifest_classifications").alias("path", "verdict"))


@query(
    "corpus_report",
    f"""WITH {_S}, {_WARNINGS}, counted AS (SELECT issue, count(*) AS n FROM warned GROUP BY issue)
    SELECT count(*) AS repo_count, count(*) + 1 AS expected_repo_count, CAST(sum([2, 2, 6, 3, 3, 2, 0, 0][k % 8 + 1]) AS BIGINT) AS dependency_count, count(*) FILTER (k % 8 IN (0, 2)) AS repo_dependency_count,
      CAST(sum([0, 1, 2, 1, 0, 1, 1, 1][k % 8 + 1]) AS BIGINT) AS execution_environment_count, count(*) FILTER (k % 8 < 6) AS direct_manifest_count, count(*) FILTER (k % 8 > 5) AS lock_manifest_count,
      (SELECT count(*) FROM warned) AS parse_warning_count, (SELECT string_agg(issue || '=' || n, ';' ORDER BY issue) FROM counted) AS warnings, 1::BIGINT AS issue_count, false AS valid FROM s""",
)
def corpus_report(spark: SparkSession, sf: str) -> DataFrame:
    found = corpus(spark, sf)
    expected = read(spark, sf, "supplier").count() + 1  # one folder too many
    shown = F.array_join(F.transform(F.map_entries("parse_warning_counts"), lambda e: _cat(e["key"], "=", e["value"])), ";")
    return repositories.report(found, expected).withColumn("warnings", shown).drop("parse_warning_counts")


@query(
    "corpus_issues",
    f"""WITH {_S}, d AS (
      SELECT k, name, unnest(CASE k % 8 WHEN 0 THEN ['num-py', 'requests', 'tool-x'] WHEN 1 THEN ['net-cdf', 'xarray'] WHEN 2 THEN ['black', 'cython', 'numpy', 'pytest', 'rich', 'scipy', 'fork'] WHEN 3 THEN ['a' || k, 'b', 'sphinx'] WHEN 4 THEN ['a', 'b', 'c'] WHEN 5 THEN ['flask', 'tox'] ELSE [] END) AS dep FROM s)
    SELECT name, unnest(['fork is not boolean', 'archived is not boolean']) AS issue FROM s WHERE k % 11 = 0
    UNION ALL SELECT name, 'license.is_spdx is not boolean' FROM s WHERE k % 11 = 1 AND NOT broken AND k % 4 <> 2
    UNION ALL SELECT name, unnest(['downloaded_count mismatch', 'selection_reason_histogram mismatch']) FROM s WHERE k % 11 = 2
    UNION ALL SELECT name, 'dependency is_vcs is not boolean: ' || dep FROM d WHERE k % 11 = 3
    UNION ALL SELECT name, 'package dependency lacks ecosystem: ' || dep FROM d WHERE k % 11 = 5
    UNION ALL SELECT name, 'dependency lacks sources: ' || dep FROM d WHERE k % 11 = 4
    UNION ALL SELECT name, 'VCS dependency lacks vcs_url: ' || dep FROM d WHERE k % 11 = 6 AND dep IN ('tool-x', 'fork')
    UNION ALL SELECT name, 'dependency source lacks path/scope' FROM d WHERE k % 11 = 7
    UNION ALL SELECT name, 'dependency source lacks path/scope' FROM d WHERE k % 11 = 7 AND dep = 'numpy'
    UNION ALL SELECT name, 'identifier lacks source_path' FROM s WHERE k % 11 = 8 AND NOT broken AND k % 10 <> 9 UNION ALL SELECT name, 'identifier lacks source_path' FROM s WHERE k % 11 = 8 AND k % 7 <> 0 UNION ALL SELECT name, 'identifier lacks source_path' FROM s WHERE k % 11 = 8 AND k % 6 = 0
    UNION ALL SELECT name, unnest(['citation.present is not boolean', 'empty software_author']) FROM s WHERE k % 11 = 9
    UNION ALL SELECT name, 'citation_md.deferred_to_llm is not boolean' FROM s WHERE k % 11 = 9 AND k % 3 = 1
    UNION ALL SELECT name, 'execution_environment.is_lock is not boolean: ' || CASE k % 8 WHEN 1 THEN 'env/environment.yml' WHEN 2 THEN 'pyproject.toml' WHEN 3 THEN 'setup.cfg' WHEN 5 THEN 'Pipfile' WHEN 6 THEN 'Pipfile.lock' ELSE 'conda/requirements-lock.txt' END FROM s, range(2) t(i) WHERE k % 11 = 10 AND k % 8 NOT IN (0, 4) AND (i = 0 OR k % 8 = 2)""",
)
def corpus_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The records, each broken in one way by its key's rest by 11."""
    found = corpus(spark, sf)
    key = F.regexp_extract("name", r"(\d+)$", 1).cast("bigint")
    broken = lambda rest, change, keep: F.when(key % 11 == rest, change).otherwise(keep)
    no = lambda kind: F.lit(None).cast(kind)

    def changed(c: str, **fields) -> Column:
        """The list c with some fields of its members made by functions of the member."""
        kind = found.schema[c].dataType.elementType
        return F.transform(c, lambda d: F.struct(*[(fields[f.name](d) if f.name in fields else d[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields]))

    without = {
        3: {"is_vcs": lambda d: F.lit(None), "ecosystem": lambda d: F.lit("x")},
        4: {"sources": lambda d: F.array()},
        5: {"ecosystem": lambda d: F.lit(None), "is_vcs": lambda d: F.lit(False)},
        6: {"vcs_url": lambda d: F.lit(None)},
        7: {"sources": lambda d: F.transform(d["sources"], lambda s: s.withField("manifest_scope", F.lit("")))},
    }
    deps = {}
    for c in ("dependencies", "repo_dependencies"):
        deps[c] = F.col(c)
        for rest, fields in without.items():
            deps[c] = broken(rest, changed(c, **fields), deps[c])
    author = found.schema["citation"].dataType["software_authors"].dataType
    bare = F.array(F.struct(*[F.lit("" if f.name == "orcid" else None).cast("string").alias(f.name) for f in author.elementType.fields])).cast(author)
    found = found.withColumns(deps | {
        "fork": broken(0, no("boolean"), F.col("fork")),
        "archived": broken(0, no("boolean"), F.col("archived")),
        "license": broken(1, F.when(F.col("license").isNotNull(), F.col("license").withField("is_spdx", no("boolean"))), F.col("license")),
        "files": broken(2, F.col("files").withField("downloaded_count", F.lit(99).cast("bigint")).withField("total_count", F.lit(99).cast("bigint")), F.col("files")),
        "identifiers": broken(8, F.transform("identifiers", lambda i: i.withField("source_path", F.lit(""))), F.col("identifiers")),
        "citation": broken(9, F.col("citation").withField("present", no("boolean")).withField("software_authors", bare), F.col("citation")),
        "citation_md": broken(9, F.when(F.col("citation_md").isNotNull(), F.col("citation_md").withField("deferred_to_llm", no("boolean"))), F.col("citation_md")),
        "execution_environment": broken(10, F.transform("execution_environment", lambda e: e.withField("is_lock", no("boolean"))), F.col("execution_environment")),
    })
    return repositories.issues(found)


@query("corpus_order", f"WITH {_S} SELECT name, row_number() OVER (ORDER BY lower(name), CASE WHEN broken THEN 0 ELSE k END) - 1 AS place FROM s")
def corpus_order(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.records import placed

    return placed(corpus(spark, sf).select("name", "repo_id"), [], [F.lower("name"), F.coalesce("repo_id", F.lit(0))]).select("name", (F.col("place") - 1).alias("place"))


@query(
    "required_keys",
    """WITH e AS (SELECT event_id, list_concat(json_keys(props), [event_type]) AS keys FROM events)
    SELECT event_id, array_to_string(missing, ',') AS missing FROM (SELECT event_id, list_sort(list_filter(['click', 'purchase', 'k', 'none'], lambda r: NOT list_contains(keys, r))) AS missing FROM e) WHERE len(missing) > 0""",
)
def required_keys(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events")
    present = F.concat(F.json_object_keys("props"), F.array("event_type"))
    return events.select("event_id", F.array_join(missing_keys(present, ("click", "purchase", "k", "none")), ",").alias("missing")).filter("missing is not null")


@query(
    "corpus_diff_files",
    """WITH o AS (SELECT DISTINCT o_custkey % 50 AS repo, o_orderkey % 400 AS path FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT DISTINCT o_custkey % 50 AS repo, o_orderkey % 400 AS path FROM orders WHERE o_orderstatus = 'O')
    SELECT 'repo' || repo AS repo, 'p/' || path AS path, 'removed' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT 'repo' || repo, 'p/' || path, 'added' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)""",
)
def corpus_diff_files(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select(_cat("repo", F.col("o_custkey") % 50).alias("repo"), _cat("p/", F.col("o_orderkey") % 400).alias("path"), "o_orderstatus")
    return differing(orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'O'"), ["repo", "path"])
