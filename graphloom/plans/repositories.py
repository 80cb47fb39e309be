"""Raw repository folders to consolidated records: one row a repository, with the same fields always present.

Files are rows (see sources.files). JSON and text fields are read by column expressions; manifests and citation files, whose
formats Spark has no reader for, by one Arrow function a file. Findings of all repositories are merged by key, then gathered
by repository."""

from __future__ import annotations

import json
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, manifests, paths, requirements
from ..functions.text import none_if_empty
from ..operators.records import merge_dependencies
from ..sources.files import files, json_or_default, tolerant_text
from ..session import map_arrow

METADATA = """id bigint, name string, full_name string, html_url string, description string, homepage string, default_branch string, language string, topics array<string>, fork boolean, archived boolean, disabled boolean,
visibility string, created_at string, updated_at string, pushed_at string, size_kb bigint, stargazers_count bigint, watchers_count bigint, forks_count bigint, open_issues_count bigint,
license struct<key:string,name:string,spdx_id:string,url:string>"""
ARCHIVE = "frozen_commit_sha string, downloaded_at_epoch double, archive_format string, default_branch string"
FILES = "array<struct<path:string,file_name:string,extension:string,size_bytes:bigint,downloaded:boolean,selection_reason:string>>"
CONTRIBUTORS = "array<struct<id:bigint,login:string,html_url:string,type:string,contributions:bigint>>"
_AUTHOR = "struct<family_names:string,given_names:string,orcid:string>"
_REFERENCE = f"struct<type:string,authors:array<{_AUTHOR}>,doi:string,title:string,journal:string,year:string,volume:string,number:string,start:string,end:string,publisher:string,url:string>"
CITATION = f"""struct<format:string,present:boolean,placeholder:boolean,source_path:string,cff_version:string,type:string,title:string,software_authors:array<struct<family_names:string,given_names:string,orcid:string,affiliation:string,email:string>>,
doi:string,version:string,date_released:string,url:string,repository_code:string,repository:string,keywords:array<string>,license:string,abstract:string,preferred_citation:{_REFERENCE},references:array<{_REFERENCE}>>"""
_NEED = "struct<name:string,raw:string,group:string,line:string,ecosystem:string,version:string,extras:array<string>,marker:string,url:string,ref:string,subdirectory:string,egg:string>"
_ENVIRONMENT = "struct<kind:string,name:string,channels:array<string>,python:string,prefix:string,pins:array<string>>"
_SOFTWARE = "struct<kind:string,name:string,version:string,authors:array<array<string>>,urls:map<string,string>,license:string>"
PARSED_ROLES = ("dependency_manifest", "environment_manifest")
RECORD_FIELDS = (
    "repo_id", "name", "full_name", "html_url", "description", "homepage", "default_branch", "language", "topics", "fork", "fork_parent", "archived", "disabled", "visibility", "timestamps", "github_stats", "archive", "license", "identifiers",
    "contributors", "files", "dependencies", "repo_dependencies", "execution_environment", "citation", "citation_md", "software_metadata", "readme", "provenance",
)


def raw_files(spark: SparkSession, root: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """repo, path (below contents/, or a file of the repository's own), text. names: of the repositories to read, else all."""
    rows = files(spark, root)
    repo = F.substring_index("path", "/", 1)
    rows = rows if names is None else rows.filter(repo.isin(*names))  # before any content is read as text
    rest = F.expr("substring(path, instr(path, '/') + 1)")
    return rows.select(repo.alias("repo"), F.regexp_replace(rest, r"\Acontents/", "").alias("path"), F.startswith(rest, F.lit("contents/")).alias("is_content"), tolerant_text(F.col("content")).alias("text"))


def _scalar(x):
    return None if x is None else x if isinstance(x, str) else str(x)


def _authors(xs, *more: str) -> list[dict]:
    out = []
    for a in xs or []:
        a = a if isinstance(a, dict) else {"given-names": a}
        out.append({k.replace("-", "_"): _scalar(a.get(k)) for k in ("family-names", "given-names", "orcid", *more)})
    return out


def _reference(x) -> dict:
    x = x if isinstance(x, dict) else {}
    return {"authors": _authors(x.get("authors"))} | {k: _scalar(x.get(k)) for k in ("type", "doi", "title", "journal", "year", "volume", "number", "start", "end", "publisher", "url")}


def parse_citation(path: str, text: str) -> tuple[dict, list[str]]:
    """A citation file's fields, and what is wrong with it."""
    bare = {"format": "cff", "present": False, "placeholder": False, "source_path": path, "software_authors": [], "keywords": [], "references": [], "preferred_citation": _reference(None)}
    try:
        parsed = manifests.yaml.safe_load(text) or {}
    except Exception as error:
        return bare, [f"cff_parse_failed: {error}"]
    if not isinstance(parsed, dict):
        return bare, ["cff_not_mapping"]
    names = " ".join(str(v) for a in parsed.get("authors") or [] for v in (a.values() if isinstance(a, dict) else [a]) if v is not None)
    fake = "FIXME" in text or str(parsed.get("title") or "").strip().upper() == "FIXME" or set(names.upper().split()) == {"FIXME"}
    told = {k.replace("-", "_"): _scalar(parsed.get(k)) for k in ("cff-version", "type", "title", "doi", "version", "date-released", "url", "repository-code", "repository", "license", "abstract")}
    lists = {"software_authors": [] if fake else _authors(parsed.get("authors"), "affiliation", "email"), "keywords": [_scalar(k) for k in parsed.get("keywords") or []], "references": [_reference(r) for r in parsed.get("references") or []]}
    return bare | told | lists | {"present": True, "placeholder": fake, "preferred_citation": _reference(parsed.get("preferred-citation"))}, ["cff_placeholder_detected"] if fake else []


def _findings(batches):
    """Rows repo, path, place, kind, json: what manifests and citation files say."""
    for batch in batches:
        out: list[tuple] = []
        for repo, path, role, text, locked in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if role == "citation_cff":
                found, issues = parse_citation(path, text or "")
                rows = [("citation", found), *(("issue", i) for i in issues)]
            else:
                rows = []
                for f in manifests.findings(path, text or "", locked):
                    kind = type(f).__name__.lower()
                    if kind == "need" and not manifests.wanted(f):
                        continue
                    rows.append(("issue", f.issue) if kind == "warned" else ("verdict", f.kind) if kind == "verdict" else (kind, asdict(f)))
            out += [(repo, path, k, kind, value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)) for k, (kind, value) in enumerate(rows)]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["repo", "path", "place", "kind", "json"])


def findings(manifest_files: DataFrame) -> DataFrame:
    """repo, path, place, kind, json of files (repo, path, file_role, text)."""
    name = F.lower(F.substring_index("path", "/", -1))
    listed = F.startswith(name, F.lit("requirements")) & F.endswith(name, F.lit(".txt"))
    locked = F.coalesce(listed & (requirements.verdict(F.col("text")) == "lock"), F.lit(False))
    return map_arrow(manifest_files.select("repo", "path", "file_role", "text", locked.alias("locked")), _findings, "repo string, path string, place int, kind string, json string")


def _source(path: Column, line: Column) -> Column:
    return F.struct(path.alias("manifest_path"), paths.manifest_type(path).alias("manifest_type"), paths.manifest_scope(path).alias("manifest_scope"), line.alias("raw_line"))


def dependencies(found: DataFrame) -> DataFrame:
    """repo, dependencies, repo_dependencies: merged over manifests, sorted. A later declaration raises the group only."""
    needs = found.filter("kind = 'need'").select("repo", "file_no", "path", "place", F.from_json("json", _NEED).alias("n"))
    declared = needs.select(
        "repo",
        F.col("n.name").alias("name"),
        F.col("n.url").isNotNull().alias("is_vcs"),
        F.coalesce("n.url", F.lit("")).alias("vcs_url"),
        F.col("n.group").alias("dep_group"),
        F.struct("file_no", "place").alias("ord"),
        F.col("path").alias("manifest_path"),
        F.col("n.line").alias("raw_line"),
        *[F.col(f"n.{c}").alias(a) for c, a in (("raw", "raw"), ("version", "version_spec"), ("extras", "extras"), ("marker", "marker"), ("ecosystem", "ecosystem"), ("ref", "ref"), ("subdirectory", "subdirectory"), ("egg", "egg"))],
    )
    merged = merge_dependencies(declared, ["repo", "name", "is_vcs", "vcs_url"])
    sources = F.transform("sources", lambda s: _source(s["manifest_path"], s["raw_line"]))
    record = F.struct("name", none_if_empty(F.col("vcs_url")).alias("vcs_url"), "dep_group", "raw", "version_spec", "extras", "marker", "ecosystem", "is_vcs", "ref", "subdirectory", "egg", sources.alias("sources"))
    keyed = merged.select("repo", "is_vcs", F.struct(F.coalesce("name", F.lit("")).alias("k1"), F.col("vcs_url").alias("k2"), F.col("dep_group").alias("k3"), record.alias("record")).alias("keyed"))
    both = keyed.groupBy("repo").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("is_vcs") == v, F.col("keyed")))), lambda k: k["record"]).alias(name) for v, name in ((False, "dependencies"), (True, "repo_dependencies"))])
    return both


def _gathered(found: DataFrame) -> DataFrame:
    """repo, execution_environment, software_metadata, manifest_classifications, issues, citation of the findings."""
    env, soft = F.from_json("json", _ENVIRONMENT), F.from_json("json", _SOFTWARE)
    rows = found.withColumn("env", F.when(F.col("kind") == "environment", env)).withColumn("soft", F.when(F.col("kind") == "software", soft))
    pins = F.col("env.pins")
    environment = F.struct(F.col("path").alias("source_path"), F.col("env.kind").alias("kind"), F.col("env.python").alias("python_version"), F.col("env.name").alias("name"), F.col("env.channels").alias("channels"), F.col("env.prefix").alias("prefix"), pins.isNotNull().alias("is_lock"), F.size(pins).alias("pinned_count"), pins.alias("pinned_set_evidence"))
    environment = F.when(F.col("env").isNotNull(), environment.withField("pinned_count", F.when(pins.isNotNull(), F.size(pins))))
    authors = F.array_sort(F.transform("soft.authors", lambda a: F.struct(a[0].alias("name"), a[1].alias("email"))))
    software = F.when(F.col("soft").isNotNull(), F.struct(F.col("path").alias("source_path"), F.col("soft.name").alias("name"), F.col("soft.version").alias("version"), authors.alias("authors"), F.map_from_entries(F.array_sort(F.map_entries("soft.urls"))).alias("urls"), F.col("soft.license").alias("license"), F.col("soft.kind").alias("manifest_type")))
    software_entries = F.to_json(software)  # maps do not sort, so records travel as text
    verdicts = F.collect_list(F.when(F.col("kind") == "verdict", F.struct(F.col("path").alias("key"), F.col("json").alias("value"))))
    return rows.groupBy("repo").agg(
        F.array_sort(F.collect_list(environment)).alias("execution_environment"),
        F.array_sort(F.collect_list(F.when(F.col("soft").isNotNull(), F.struct("path", F.coalesce("soft.name", F.lit("")).alias("name"), software_entries.alias("json"))))).alias("software"),
        F.map_from_entries(F.array_sort(F.array_distinct(verdicts))).alias("manifest_classifications"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "issue", F.struct(F.col("path").alias("file"), F.col("json").alias("issue"))))).alias("issues"),
        F.min_by(F.when(F.col("kind") == "citation", F.col("json")), F.when(F.col("kind") == "citation", F.col("path"))).alias("citation_json"),
    )


def _readmes(listed: DataFrame) -> DataFrame:
    """repo, readme of the first readme by path, with its addresses by kind."""
    first = listed.filter("file_role = 'readme'").groupBy("repo").agg(F.min_by(F.struct("path", "text"), "path").alias("f"))
    text = F.col("f.text")
    found = F.transform(F.regexp_extract_all(text, F.lit(ids.URL_IN_TEXT), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,)]+\z", ""))
    dois = F.transform(F.regexp_extract_all(text, F.lit(f"({ids.DOI_IN_TEXT})"), F.lit(1)), lambda d: F.regexp_replace(d, r"[.,)]+\z", ""))
    bucket = lambda k: F.filter(found, lambda u: ids.url_bucket(u) == k)
    sets = F.struct(*[F.array_sort(F.array_distinct(x)).alias(n) for n, x in (("dataset", bucket("dataset")), ("code", bucket("code")), ("dois", F.concat(bucket("doi"), dois)), ("other", bucket("other")))])
    return first.select("repo", F.struct(F.lit(True).alias("present"), F.col("f.path").alias("source_path"), text.alias("text"), sets.alias("deterministic_urls")).alias("readme"))


def build(raw: DataFrame) -> DataFrame:
    """One record a repository (RECORD_FIELDS). raw: see raw_files."""
    own = raw.filter("NOT is_content")
    wide = own.groupBy("repo").agg(*[F.max(F.when(F.col("path") == f"{n}.json", F.col("text"))).alias(n) for n in ("repo_metadata", "archive_info", "files_manifest", "contributors")])
    for name, schema in (("repo_metadata", f"struct<{_fields(METADATA)}>"), ("archive_info", f"struct<{_fields(ARCHIVE)}>"), ("files_manifest", FILES), ("contributors", CONTRIBUTORS)):
        wide = json_or_default(wide, name, schema).withColumnRenamed("value", f"{name}_v").withColumn(f"{name}_issue", F.when(F.col("issue").isNotNull(), F.struct(F.lit(f"{name}.json").alias("file"), F.col("issue").alias("issue")))).drop("issue")
    listed = wide.select("repo", F.posexplode("files_manifest_v").alias("file_no", "f")).select("repo", "file_no", "f.*")
    listed = listed.withColumn("file_role", paths.file_role(F.col("path"), F.col("file_name"), F.coalesce("extension", F.lit(""))))
    kept = listed.filter("downloaded")
    contents = raw.filter("is_content").select("repo", "path", "text")
    with_text = kept.join(contents, ["repo", "path"])
    parsed = with_text.filter(F.col("file_role").isin(*PARSED_ROLES, "citation_cff"))
    found = findings(parsed).join(kept.select("repo", "path", "file_no"), ["repo", "path"])
    file_struct = F.struct("path", "file_name", "extension", "size_bytes", "selection_reason", "file_role", F.concat(F.lit("files_manifest.json["), F.col("file_no").cast("string"), F.lit("]")).alias("source_path"))
    reasons = listed.groupBy("repo", F.coalesce("selection_reason", F.lit("None")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("selection_reason_histogram"))
    per_file = listed.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.array_sort(F.collect_list(F.when(F.col("downloaded"), file_struct))).alias("downloaded"),
        F.array_sort(F.collect_list(F.when(F.col("file_role") == "dockerfile", F.struct("path", "file_name", "size_bytes")))).alias("dockerfiles"),
        F.min(F.when(F.col("downloaded") & (F.col("file_role") == "citation_md"), F.col("path"))).alias("citation_md_path"),
    )
    joined = wide
    for part in (dependencies(found), _gathered(found), per_file, reasons, _readmes(with_text)):
        joined = joined.join(part, "repo", "left")
    return _assembled(joined)


def _fields(schema: str) -> str:
    from ..sources.files import _fields as fields

    return fields(schema)


def _assembled(j: DataFrame) -> DataFrame:
    m, a = (lambda c: F.col(f"repo_metadata_v.{c}")), (lambda c: F.col(f"archive_info_v.{c}"))
    false, none = F.lit(False), F.lit(None).cast("string")
    license_ = m("license")
    spdx = F.coalesce((m("license.spdx_id") != "NOASSERTION") & m("license.spdx_id").rlike(r"\A[A-Za-z0-9.+-]+\z"), false)
    citation = F.from_json("citation_json", CITATION)
    empty_citation = F.from_json(F.when(F.col("citation_md_path").isNotNull(), '{"format":"md","present":false,"placeholder":false}').otherwise('{"format":"none","present":false,"placeholder":false}'), CITATION)
    chosen = F.coalesce(citation, empty_citation)
    identifier = lambda kind, value, at: F.when(F.coalesce(value != "", false), F.struct(F.lit(kind).alias("id_type"), value.alias("value"), at.alias("source_path")))
    identifiers = F.array_sort(F.filter(F.array(identifier("repo_url", m("html_url"), F.lit("repo_metadata.json:html_url")), identifier("commit_sha", a("frozen_commit_sha"), F.lit("archive_info.json:frozen_commit_sha")), identifier("doi", chosen["doi"], F.concat(chosen["source_path"], F.lit(":doi")))), lambda x: x.isNotNull()))
    people = F.transform("contributors_v", lambda c, i: F.struct(c["id"].isNull().alias("k1"), F.coalesce(c["id"], F.lit(0)).alias("k2"), F.coalesce(c["login"], F.lit("")).alias("k3"), F.struct(c["id"].alias("github_id"), c["login"].alias("login"), c["html_url"].alias("html_url"), c["type"].alias("type"), c["contributions"].alias("contributions"), F.coalesce(c["type"] == "Bot", false).alias("is_bot"), F.concat(F.lit("contributors.json["), i.cast("string"), F.lit("]")).alias("source_path")).alias("record")))
    artifact = F.concat(F.regexp_replace(none_if_empty(m("html_url")), r"/+\z", ""), F.lit("/tree/"), none_if_empty(a("frozen_commit_sha")))
    lost = F.when(artifact.isNull(), F.struct(F.lit("provenance").alias("file"), F.lit("source_artifact_missing_html_url_or_frozen_commit_sha").alias("issue")))
    warned = F.array_sort(F.filter(F.concat(F.coalesce("issues", F.array().cast("array<struct<file:string,issue:string>>")), F.array(lost, *[F.col(f"{n}_issue") for n in ("repo_metadata", "archive_info", "files_manifest", "contributors")])), lambda x: x.isNotNull()))
    no_readme = F.from_json(F.lit('{"present":false,"deterministic_urls":{"dataset":[],"code":[],"dois":[],"other":[]}}'), j.schema["readme"].dataType)
    listed = lambda c: F.coalesce(F.col(c), F.array().cast(j.schema[c].dataType))
    none_left = F.create_map().cast("map<string,bigint>")
    return j.select(
        m("id").alias("repo_id"),
        F.coalesce(none_if_empty(m("name")), F.col("repo")).alias("name"),
        *[m(c).alias(c) for c in ("full_name", "html_url", "description", "homepage")],
        F.coalesce(none_if_empty(m("default_branch")), a("default_branch")).alias("default_branch"),
        m("language").alias("language"),
        F.coalesce(m("topics"), F.array().cast("array<string>")).alias("topics"),
        F.coalesce(m("fork"), false).alias("fork"),
        none.alias("fork_parent"),
        F.coalesce(m("archived"), false).alias("archived"),
        F.coalesce(m("disabled"), false).alias("disabled"),
        m("visibility").alias("visibility"),
        F.struct(*[m(c).alias(c) for c in ("created_at", "updated_at", "pushed_at")]).alias("timestamps"),
        F.struct(*[m(c).alias(c) for c in ("size_kb", "stargazers_count", "watchers_count", "forks_count", "open_issues_count")]).alias("github_stats"),
        F.struct(*[a(c).alias(c) for c in ("frozen_commit_sha", "downloaded_at_epoch", "archive_format")]).alias("archive"),
        F.when(license_.isNotNull(), F.struct(*[m(f"license.{c}").alias(c) for c in ("key", "name", "spdx_id", "url")], spdx.alias("is_spdx"), F.lit("repo_metadata.json:license").alias("source_path"))).alias("license"),
        identifiers.alias("identifiers"),
        F.coalesce(F.transform(F.array_sort(people), lambda p: p["record"]), F.array()).alias("contributors"),
        F.struct(F.coalesce("total_count", F.lit(0)).alias("total_count"), F.size(listed("downloaded")).cast("bigint").alias("downloaded_count"), F.coalesce("selection_reason_histogram", none_left).alias("selection_reason_histogram"), (F.size(listed("dockerfiles")) > 0).alias("has_dockerfile"), listed("downloaded").alias("downloaded"), listed("dockerfiles").alias("dockerfiles")).alias("files"),
        listed("dependencies").alias("dependencies"),
        listed("repo_dependencies").alias("repo_dependencies"),
        listed("execution_environment").alias("execution_environment"),
        chosen.alias("citation"),
        F.when(citation.isNull() & F.col("citation_md_path").isNotNull(), F.struct(F.lit(True).alias("present"), F.col("citation_md_path").alias("source_path"), F.lit(True).alias("deferred_to_llm"))).alias("citation_md"),
        F.transform(F.coalesce("software", F.array().cast(j.schema["software"].dataType)), lambda s: s["json"]).alias("software_metadata"),
        F.coalesce("readme", no_readme).alias("readme"),
        F.struct(artifact.alias("source_artifact"), F.lit("1.0.0").alias("phase_a_version"), F.coalesce("manifest_classifications", F.create_map().cast("map<string,string>")).alias("manifest_classifications"), warned.alias("parse_warnings")).alias("provenance"),
    )


def issues(corpus: DataFrame) -> DataFrame:
    """name, issue of records that contradict themselves, or lack what every record has."""
    columns = set(corpus.columns)
    absent = [c for c in RECORD_FIELDS if c not in columns]
    if absent:
        told = F.lit(f"missing keys [{', '.join(repr(c) for c in sorted(absent))}]")
        return corpus.select((F.col("name") if "name" in columns else F.lit(None).cast("string")).alias("name"), told.alias("issue"))
    none = F.array().cast("array<string>")
    when = lambda test, said: F.when(test, F.array(F.lit(said) if isinstance(said, str) else said)).otherwise(none)
    unknown = lambda at, c: when(c.isNull(), f"{at} is not boolean")
    empty = lambda c: F.coalesce(c == "", F.lit(True))
    each = lambda rows, test, said: F.transform(F.filter(F.coalesce(rows, F.array().cast(rows_type(rows))), test), said)

    def rows_type(rows: Column):
        return corpus.select(rows.alias("x")).schema["x"].dataType

    named = lambda said: lambda d: F.concat(F.lit(f"{said}: "), F.coalesce(d["name"], F.lit("None")))
    always = lambda said: lambda _: F.lit(said)
    deps = F.concat(F.coalesce("dependencies", F.array().cast(corpus.schema["dependencies"].dataType)), F.coalesce("repo_dependencies", F.array().cast(corpus.schema["repo_dependencies"].dataType)))
    environments = F.col("execution_environment")
    locks = F.transform(F.filter(environments, lambda e: F.coalesce(e["is_lock"], F.lit(False)) & ~empty(e["source_path"])), lambda e: e["source_path"])
    fed = F.filter(locks, lambda p: F.exists("dependencies", lambda d: F.exists(d["sources"], lambda s: F.contains(s["manifest_path"], p))))
    citation = F.col("citation")
    blank = lambda a: empty(F.concat_ws("", *[a[f.name].cast("string") for f in corpus.schema["citation"].dataType["software_authors"].dataType.elementType.fields]))
    found = F.concat(
        *[unknown(c, F.col(c)) for c in ("fork", "archived", "disabled")],
        when(F.col("license").isNotNull() & F.col("license.is_spdx").isNull(), "license.is_spdx is not boolean"),
        unknown("files.has_dockerfile", F.col("files.has_dockerfile")),
        when(~F.col("files.downloaded_count").eqNullSafe(F.size(F.coalesce(F.col("files.downloaded"), F.array()))), "downloaded_count mismatch"),
        when(~F.col("files.total_count").eqNullSafe(F.aggregate(F.coalesce(F.map_values("files.selection_reason_histogram"), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, b: a + b)), "selection_reason_histogram mismatch"),
        each(deps, lambda d: d["is_vcs"].isNull(), named("dependency is_vcs is not boolean")),
        each(deps, lambda d: F.coalesce(F.size(d["sources"]) <= 0, F.lit(True)), named("dependency lacks sources")),
        each(deps, lambda d: F.coalesce(d["is_vcs"], F.lit(False)) & empty(d["vcs_url"]), named("VCS dependency lacks vcs_url")),
        each(deps, lambda d: ~F.coalesce(d["is_vcs"], F.lit(False)) & empty(d["ecosystem"]), named("package dependency lacks ecosystem")),
        each(F.flatten(F.transform(deps, lambda d: F.coalesce(d["sources"], F.array()))), lambda s: empty(s["manifest_path"]) | empty(s["manifest_scope"]), always("dependency source lacks path/scope")),
        each(F.col("identifiers"), lambda i: empty(i["source_path"]), always("identifier lacks source_path")),
        *[unknown(f"citation.{c}", citation[c]) for c in ("present", "placeholder")],
        *[when(F.col("citation_md").isNotNull() & F.col(f"citation_md.{c}").isNull(), f"citation_md.{c} is not boolean") for c in ("present", "deferred_to_llm")],
        each(citation["software_authors"], blank, always("empty software_author")),
        each(environments, lambda e: e["is_lock"].isNull(), lambda e: F.concat(F.lit("execution_environment.is_lock is not boolean: "), F.coalesce(e["source_path"], F.lit("None")))),
        F.transform(fed, lambda p: F.concat(F.lit("lock manifest contributed package deps: "), p)),
    )
    return corpus.select("name", F.explode(found).alias("issue"))


def report(corpus: DataFrame, expected: int | None = None) -> DataFrame:
    """Totals over all records, one row: with warnings by issue, how many records contradict themselves, and whether the corpus
    is valid. expected: how many records there should be."""
    of = lambda v: F.size(F.filter(F.map_values("provenance.manifest_classifications"), lambda x: x == v))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    totals = corpus.agg(
        F.count(F.lit(1)).alias("repo_count"),
        total(F.size("dependencies")).alias("dependency_count"),
        total(F.size("repo_dependencies")).alias("repo_dependency_count"),
        total(F.size("execution_environment")).alias("execution_environment_count"),
        total(of("direct")).alias("direct_manifest_count"),
        total(of("lock")).alias("lock_manifest_count"),
        total(F.size("provenance.parse_warnings")).alias("parse_warning_count"),
    )
    warned = corpus.select(F.explode("provenance.parse_warnings").alias("w")).groupBy(F.col("w.issue").alias("issue")).agg(F.count(F.lit(1)).alias("n"))
    by_issue = warned.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("issue", "n")))).alias("parse_warning_counts"))  # one row an issue
    found = issues(corpus).agg(F.count(F.lit(1)).alias("issue_count"))
    want = F.lit(expected).cast("bigint")
    counted = totals.withColumn("expected_repo_count", F.coalesce(want, F.col("repo_count")))
    whole = counted.join(by_issue).join(found)  # each has one row
    mismatch = F.col("repo_count") != F.col("expected_repo_count")
    return whole.withColumn("issue_count", F.col("issue_count") + mismatch.cast("bigint")).withColumn("valid", F.col("issue_count") == 0)


def ordered(corpus: DataFrame) -> DataFrame:
    return corpus.orderBy(F.lower("name"), F.coalesce("repo_id", F.lit(0)))
