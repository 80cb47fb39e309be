"""Catalogue: text, identifier, address, path and value functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, paths, text, values
from .registry import query
from .star import read


def _slug(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g')), 'https?://', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"


def _distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda elem, i: list_position({x}, elem) = i)"


def _key(x: str) -> Column:
    return F.col(x).cast("string")


@query("slugify_names", f"SELECT 'part:' || p_partkey AS id, {_slug('p_name')} AS slug FROM part UNION ALL SELECT 'page:' || page_id, {_slug('url')} FROM pages")
def slugify_names(spark: SparkSession, sf: str) -> DataFrame:
    parts = read(spark, sf, "part").select(F.concat(F.lit("part:"), _key("p_partkey")).alias("id"), text.slugify(F.col("p_name")).alias("slug"))
    pages = read(spark, sf, "pages").select(F.concat(F.lit("page:"), _key("page_id")).alias("id"), text.slugify(F.col("url")).alias("slug"))
    return parts.unionByName(pages)


CLEAN_SQL = r"nullif(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace({x}, '[\x{{ad}}\x{{200b}}\x{{200c}}\x{{200d}}\x{{feff}}]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '')"


@query(
    "clean_text_docs",
    f"""WITH t AS (SELECT doc_id, {CLEAN_SQL.format(x="chr(9) || '  ' || coalesce(text, '') || chr(8203) || chr(13) || chr(10) || chr(13) || chr(10) || chr(10) || 'end  of ' || lang || ' '")} AS clean FROM documents)
    SELECT doc_id, length(clean) AS n, sha256(clean) AS digest FROM t""",
)
def clean_text_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    raw = F.concat(F.lit("\t  "), F.coalesce("text", F.lit("")), F.lit("​\r\n\r\n\nend  of "), F.col("lang"), F.lit(" "))
    clean = text.clean_text(raw)
    return docs.select("doc_id", F.length(clean).cast("bigint").alias("n"), F.sha2(clean, 256).alias("digest"))


@query(
    "clean_list_names",
    f"""WITH l AS (SELECT n_nationkey, [n_name, ' ' || n_name || '  ', '', NULL, 'a  b', 'a b', lower(n_name)] AS v FROM nation),
    c AS (SELECT n_nationkey, list_filter(list_transform(v, lambda x: nullif(regexp_replace(trim(x), ' +', ' ', 'g'), '')), lambda x: x IS NOT NULL) AS v FROM l)
    SELECT n_nationkey, array_to_string({_distinct_in_order('v')}, '|') AS cleaned FROM c""",
)
def clean_list_names(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("n_name")
    raw = F.array(name, F.concat(F.lit(" "), name, F.lit("  ")), F.lit(""), F.lit(None).cast("string"), F.lit("a  b"), F.lit("a b"), F.lower(name))
    return read(spark, sf, "nation").select("n_nationkey", F.array_join(text.clean_list(raw), "|").alias("cleaned"))


@query(
    "orcid_ror_doi_normalise",
    r"""WITH s AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'https://orcid.org/0000-0001-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-123x' WHEN 1 THEN '0000-0002-1111-2222' WHEN 2 THEN 'orcid 12-34' ELSE '' END AS o,
      CASE c_custkey % 3 WHEN 0 THEN 'https://ROR.org/0' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 6, '0') || 'AB' WHEN 1 THEN 'ror.org/short' ELSE 'none' END AS r,
      CASE c_custkey % 5 WHEN 0 THEN 'see https://doi.org/10.1234/ABC.' || c_custkey || '...' WHEN 1 THEN 'DOI:10.5555/x_' || c_custkey || '; more' WHEN 2 THEN '10.12/too-short' WHEN 3 THEN 'text 10.99999/a(b)"c' ELSE '' END AS d FROM customer)
    SELECT c_custkey, nullif(upper(regexp_extract(o, '(?i)(\d{4}-\d{4}-\d{4}-\d{3}[\dX])', 1)), '') AS orcid, nullif(lower(regexp_extract(r, '(?i)ror\.org/([a-z0-9]{9})', 1)), '') AS ror,
      nullif(lower(regexp_replace(regexp_extract(d, '(?i)(?:doi\.org/|doi:)?(10\.\d{4,9}/[^\s,;"''<>]+)', 1), '\.+$', '')), '') AS doi FROM s""",
)
def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    k, key = F.col("c_custkey"), _key("c_custkey")
    o = F.when(k % 4 == 0, F.concat(F.lit("https://orcid.org/0000-0001-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("-123x"))).when(k % 4 == 1, "0000-0002-1111-2222").when(k % 4 == 2, "orcid 12-34").otherwise("")
    r = F.when(k % 3 == 0, F.concat(F.lit("https://ROR.org/0"), F.lpad((k % 100000).cast("string"), 6, "0"), F.lit("AB"))).when(k % 3 == 1, "ror.org/short").otherwise("none")
    d = F.when(k % 5 == 0, F.concat(F.lit("see https://doi.org/10.1234/ABC."), key, F.lit("..."))).when(k % 5 == 1, F.concat(F.lit("DOI:10.5555/x_"), key, F.lit("; more"))).when(k % 5 == 2, "10.12/too-short").when(k % 5 == 3, 'text 10.99999/a(b)"c').otherwise("")
    return read(spark, sf, "customer").select("c_custkey", ids.orcid(o).alias("orcid"), ids.ror(r).alias("ror"), ids.doi(d).alias("doi"))


@query(
    "url_host_path",
    r"""SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS authority,
    regexp_extract(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '^([^?#]*)', 1) AS path FROM pages""",
)
def url_host_path(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", ids.authority(F.col("url")).alias("authority"), ids.url_path(F.col("url")).alias("path"))


_VARIANT_SQL = "CASE page_id % 5 WHEN 0 THEN 'https://datasets.example.org/resource/' || md5(url) WHEN 1 THEN 'https://github.com/org/r' || page_id WHEN 2 THEN 'https://dx.doi.org/10.1000/' || page_id WHEN 3 THEN 'http://x.org/10.1234/ab' || page_id ELSE url END"


def _variant() -> Column:
    k, key = F.col("page_id"), _key("page_id")
    return (
        F.when(k % 5 == 0, F.concat(F.lit("https://datasets.example.org/resource/"), F.md5("url")))
        .when(k % 5 == 1, F.concat(F.lit("https://github.com/org/r"), key))
        .when(k % 5 == 2, F.concat(F.lit("https://dx.doi.org/10.1000/"), key))
        .when(k % 5 == 3, F.concat(F.lit("http://x.org/10.1234/ab"), key))
        .otherwise(F.col("url"))
    )


@query(
    "url_buckets",
    rf"""WITH v AS (SELECT page_id, {_VARIANT_SQL} AS u FROM pages), h AS (SELECT page_id, u, lower(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1)) AS host FROM v)
    SELECT page_id, CASE WHEN contains(lower(u), 'datasets.example.org') THEN 'dataset' WHEN contains(lower(u), 'github.com') THEN 'code'
      WHEN contains(lower(u), 'doi.org/') OR regexp_matches(u, '\b10\.\d{{4,9}}/[-._;()/:A-Za-z0-9]+\b') THEN 'doi' ELSE 'other' END AS bucket,
      nullif(lower(regexp_extract(u, '(?i)/resource/([0-9a-f]{{32}})', 1)), '') AS resource_id,
      contains(host, 'github.com') OR contains(host, 'gitlab.com') OR contains(host, 'bitbucket.org') AS is_repository FROM h""",
)
def url_buckets(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "pages").select("page_id", _variant().alias("u"))
    return rows.select("page_id", ids.url_bucket(F.col("u")).alias("bucket"), ids.resource_id(F.col("u")).alias("resource_id"), ids.is_repository_url(F.col("u")).alias("is_repository"))


_PROSE_SQL = "'See (' || url || '), <' || url || '> and \"http://b.org/x;\" or https://c.org/p' || page_id || '.pdf). Also ' || url || '/end...'"


@query(
    "extract_urls",
    rf"""WITH f AS (SELECT page_id, list_filter(list_transform(regexp_extract_all({_PROSE_SQL}, '(https?://[^\s<>"]+)', 1), lambda u: regexp_replace(u, '[.,;:)\]}}>"'']+$', '')), lambda u: u <> '') AS l FROM pages)
    SELECT page_id, array_to_string({_distinct_in_order('l')}, ' ') AS urls, l[1] AS first_url FROM f""",
)
def extract_urls(spark: SparkSession, sf: str) -> DataFrame:
    u, key = F.col("url"), _key("page_id")
    prose = F.concat(F.lit("See ("), u, F.lit("), <"), u, F.lit('> and "http://b.org/x;" or https://c.org/p'), key, F.lit(".pdf). Also "), u, F.lit("/end..."))
    found = text.extract_urls(prose)
    return read(spark, sf, "pages").select("page_id", F.array_join(found, " ").alias("urls"), ids.first_url(found).alias("first_url"))


@query(
    "license_key",
    f"""WITH r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'https://creativecommons.org/licenses/by/4.0/' WHEN 1 THEN 'http://Licenses.org/v' || c_custkey % 7 WHEN 2 THEN '' END AS url,
      CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Shared under ' || c_mktsegment || '!' END AS statement FROM customer)
    SELECT c_custkey, 'license:' || CASE WHEN contains(url, 'creativecommons.org/licenses/by/4.0') THEN 'cc-by-4.0' WHEN url <> '' THEN 'url:' || {_slug('url')}
      ELSE 'name:' || {_slug("coalesce(nullif(statement, ''), 'unknown-license')")} END AS license FROM r""",
)
def license_key(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    url = F.when(k % 4 == 0, "https://creativecommons.org/licenses/by/4.0/").when(k % 4 == 1, F.concat(F.lit("http://Licenses.org/v"), (k % 7).cast("string"))).when(k % 4 == 2, "")
    statement = F.when(k % 3 != 0, F.concat(F.lit("Shared under "), F.col("c_mktsegment"), F.lit("!")))
    return read(spark, sf, "customer").select("c_custkey", ids.license_key(url, statement).alias("license"))


@query(
    "person_key",
    f"""WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS name, c_custkey % 4 AS k FROM customer)
    SELECT c_custkey, CASE WHEN k IN (1, 2) THEN 'person:orcid:0000-0003-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-000X'
      ELSE 'person:name:' || {_slug("coalesce(name, 'unknown-person')")} END AS id, CASE WHEN k IN (1, 2) THEN 'ORCID' ELSE 'name-key' END AS regime FROM p""",
)
def person_key(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    good = F.concat(F.lit("http://orcid.org/0000-0003-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("-000x"))
    ident = lambda kind, url: F.struct(F.lit(kind).alias("id_type"), url.alias("url"))
    given = (
        F.when(k % 4 == 1, F.array(ident("ORCID", good)))
        .when(k % 4 == 2, F.array(ident("ORCID", F.lit("bad")), ident("GoogleScholarID", F.lit("0000-0000-0000-0000")), ident("ORCID", good)))
        .when(k % 4 == 3, F.array(ident("ResearchGateID", good)))
        .otherwise(F.array().cast("array<struct<id_type:string,url:string>>"))
    )
    found = ids.person_key(F.when(k % 11 != 0, F.col("c_name")), given)
    return read(spark, sf, "customer").select("c_custkey", found["id"].alias("id"), found["regime"].alias("regime"))


@query(
    "org_key",
    f"""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'organization:ror:' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') ELSE 'organization:name:' || {_slug('s_name')} END AS id,
    CASE WHEN s_suppkey % 2 = 0 THEN 'ROR' ELSE 'name-key' END AS regime,
    'award:' || CASE WHEN s_suppkey % 3 = 0 THEN 'unknown-agency' ELSE {_slug('s_name')} END || ':' || CASE WHEN s_suppkey % 5 = 0 THEN 'title-' || s_suppkey WHEN s_suppkey % 5 = 1 THEN 'unknown-award' ELSE 'n-' || s_suppkey END AS award,
    CASE WHEN s_suppkey % 2 = 0 THEN 'tool:url:apps-example-org-' || s_suppkey ELSE 'tool:name:' || {_slug('s_name')} END AS tool,
    'subject:' || {_slug('s_name')} AS subject, 'res' || s_suppkey || ':file:data-' || s_suppkey || '-csv' AS file FROM supplier""",
)
def org_key(spark: SparkSession, sf: str) -> DataFrame:
    k, key, name = F.col("s_suppkey"), _key("s_suppkey"), F.col("s_name")
    org = ids.organization_key(name, F.when(k % 2 == 0, F.concat(F.lit("https://ror.org/"), F.lpad(key, 9, "0"))).otherwise("https://ror.org/x"))
    number = F.when(k % 5 > 1, F.concat(F.lit("N "), key)).otherwise("")
    title = F.when(k % 5 == 0, F.concat(F.lit("Title "), key))
    url = F.when(k % 2 == 0, F.concat(F.lit("https://apps.example.org:"), key, F.lit("/run?x=1")))
    return read(spark, sf, "supplier").select(
        "s_suppkey",
        org["id"].alias("id"),
        org["regime"].alias("regime"),
        ids.award_key(F.when(k % 3 != 0, name), number, title).alias("award"),
        ids.tool_key(url, name).alias("tool"),
        ids.subject_key(name).alias("subject"),
        ids.file_key(F.concat(F.lit("res"), key), F.lit(None).cast("string"), F.concat(F.lit("data "), key, F.lit(".csv")), F.lit("")).alias("file"),
    )


#: Paths that the classifiers are run over, with a folder and a number put in.
SAMPLES = (
    "README.md", "docs/Readme_old.txt", "LICENSE", "src/licence.md", "COPYING.lesser", "CITATION.cff", "sub/citation.txt", "CHANGELOG", "contributing.rst", "CODE_OF_CONDUCT.md",
    "SECURITY.md", "Dockerfile", "docker/Dockerfile.gpu", "containerfile", "requirements.txt", "dev/requirements-dev.txt", "pyproject.toml", "setup.py", "a/setup.cfg", "Pipfile", "Pipfile.lock",
    "environment.yml", "env2/environment.yaml", "nb/01.tutorial/run.ipynb", "docs/guide.md", "documentation/api/x.rst", "examples/use.markdown", "tutorials/a.ipynb", "examples/data.csv", "src/pkg/mod.py",
    "notes.markdown", "top.ipynb", "poetry.lock", "conda-linux-lock.yml", ".github/workflows/ci.yml", "build/lib/x.py", "docs/tmp_notes.md", "docs/reference/y.rst", "vendor/a/license.txt", "labs/week_2/03-exercise/task.txt",
    "data/.ipynb_checkpoints/x.ipynb", "workshop/intro.toml", "notebooks/a.cff", "./docs/rel.md", "repo.sub.rst", "deep/none.md", "scripts/run.sh", "training/plan.md",
)
_PATHS_SQL = "[" + ", ".join(f"'{s}'" for s in SAMPLES) + "]"


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """p_partkey, path, name, ext over parts."""
    path = F.element_at(F.array(*[F.lit(s) for s in SAMPLES]), (F.col("p_partkey") % len(SAMPLES) + 1).cast("int"))
    rows = read(spark, sf, "part").select("p_partkey", path.alias("path"))
    return rows.withColumn("name", paths.file_name(F.col("path"))).withColumn("ext", paths.extension(F.col("name")))


_SAMPLE_SQL = rf"""WITH s AS (SELECT p_partkey, ({_PATHS_SQL})[p_partkey % {len(SAMPLES)} + 1] AS path FROM part),
t AS (SELECT *, lower(path) AS low, lower(regexp_extract(path, '([^/]*)$', 1)) AS name, split_part(lower(path), '/', 1) AS top FROM s),
x AS (SELECT *, regexp_extract(name, '[^.](\.[^.]+)$', 1) AS ext FROM t)"""


@query(
    "file_role",
    rf"""{_SAMPLE_SQL} SELECT p_partkey, path, CASE WHEN name LIKE 'readme%' THEN 'readme' WHEN regexp_matches(name, '^(license|licence|copying)') THEN 'license' WHEN name = 'citation.cff' THEN 'citation_cff'
      WHEN name IN ('citation', 'citation.md', 'citation.txt') THEN 'citation_md' WHEN name LIKE 'changelog%' THEN 'changelog' WHEN name LIKE 'contributing%' THEN 'contributing' WHEN starts_with(name, 'code_of_conduct') THEN 'code_of_conduct'
      WHEN name = 'security.md' THEN 'security' WHEN name IN ('dockerfile', 'containerfile') OR name LIKE 'dockerfile.%' THEN 'dockerfile'
      WHEN (name LIKE 'requirements%.txt') OR name IN ('pyproject.toml', 'setup.py', 'setup.cfg', 'pipfile', 'pipfile.lock') THEN 'dependency_manifest' WHEN name IN ('environment.yml', 'environment.yaml') THEN 'environment_manifest'
      WHEN ext = '.ipynb' THEN 'notebook' WHEN top IN ('docs', 'doc', 'documentation') AND ext IN ('.md', '.rst', '.markdown') THEN 'documentation' WHEN top IN ('examples', 'tutorials') AND ext IN ('.md', '.rst', '.markdown', '.ipynb') THEN 'example'
      WHEN ext = '.py' THEN 'source' WHEN NOT contains(low, '/') AND ext IN ('.md', '.rst', '.markdown') THEN 'documentation' ELSE 'other' END AS role FROM x""",
)
def file_role(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(spark, sf).select("p_partkey", "path", paths.file_role(F.col("path"), F.col("name"), F.col("ext")).alias("role"))


@query(
    "manifest_scope",
    f"{_SAMPLE_SQL} SELECT CASE WHEN top IN ('docs', 'doc', 'documentation') THEN 'docs' WHEN top IN ('examples', 'tutorials') THEN 'example' ELSE 'root' END AS scope, count(*) AS n FROM x GROUP BY 1",
)
def manifest_scope(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(spark, sf).groupBy(paths.manifest_scope(F.col("path")).alias("scope")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "manifest_type",
    f"""{_SAMPLE_SQL} SELECT p_partkey, CASE WHEN name LIKE 'requirements%.txt' THEN 'requirements_txt' WHEN name LIKE '%-lock.yml' THEN 'conda_lock_yml' WHEN name IN ('environment.yml', 'environment.yaml') THEN 'environment_yml'
      ELSE replace(replace(name, '.', '_'), '-', '_') END AS kind FROM x""",
)
def manifest_type(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(spark, sf).select("p_partkey", paths.manifest_type(F.col("path")).alias("kind"))


#: Paths with a number put in, and what each is kept for; told one by one, not derived.
KEPT_FOR = {
    "README.md": "allowed_exact_filename", "p%d/license.txt": "allowed_exact_filename", "p%d/pyproject.toml": "allowed_exact_filename", "CITATION.cff": "allowed_exact_filename", "My-Demos %d/readme.rst": "allowed_exact_filename", "a%d/Pipfile.lock": "allowed_exact_filename", "SECURITY.md": "allowed_exact_filename", "vendor/p%d/license.txt": "allowed_exact_filename",
    "docs/guide%d.md": "allowed_path_prefix", "docs/p%d.py": "allowed_path_prefix", "notebooks/n%d.ipynb": "allowed_path_prefix", "docs/p%d.rst": "allowed_path_prefix", "./docs/rel%d.md": "allowed_path_prefix", "workshop/intro%d.toml": "allowed_path_prefix", "Examples/e%d.YAML": "allowed_path_prefix", "documentation/api_%d/x.md": "allowed_path_prefix",
    "labs/week_%d/03-exercise/task.txt": "allowed_semantic_folder", "x%d/01.tutorial/run.ipynb": "allowed_semantic_folder", "training/plan%d.md": "allowed_semantic_folder", "My-Demos %d/use.md": "allowed_semantic_folder", "src/lesson_%d/a.cff": "allowed_semantic_folder", "2 - workflows/w%d.rst": "allowed_semantic_folder",
    "notes%d.markdown": "allowed_top_level_doc", "top%d.cff": "allowed_top_level_doc", "p%d.RST": "allowed_top_level_doc", "top%d.ipynb": "allowed_top_level_notebook",
    "build/p%d.md": None, ".github/w%d.yml": None, "docs/tmp_%d.md": None, "docs/reference/p%d.rst": None, "repo.p%d.rst": None, "x/vendor/p%d/license.txt": None, "src/p%d.py": None, "data/p%d.csv": None, "scripts/run%d.sh": None, "data%d/.ipynb_checkpoints/x.ipynb": None, "a/b%d.md": None, "deep/checkpoint%d.md": None,
    "laboratory/p%d.md": None, "docs/p%d.csv": None, "site/docs/p%d.md": None, "examples/backup%d.md": None, "p%d.toml": None, "labs/p%d.py": None,
}
_REASON_SQL = f"""WITH t AS (SELECT unnest({list(KEPT_FOR)!r}) AS template, unnest([{', '.join('NULL' if v is None else repr(v) for v in KEPT_FOR.values())}]) AS reason, unnest(range({len(KEPT_FOR)})) AS place),
q AS (SELECT p_partkey, replace(template, '%d', p_partkey::VARCHAR) AS path, reason FROM part JOIN t ON p_partkey % {len(KEPT_FOR)} = place)"""


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    template = F.element_at(F.array(*[F.lit(t) for t in KEPT_FOR]), (F.col("p_partkey") % len(KEPT_FOR) + 1).cast("int"))
    path = F.replace(template, F.lit("%d"), F.col("p_partkey").cast("string"))
    return read(spark, sf, "part").select("p_partkey", path.alias("path")).withColumn("reason", paths.selection_reason(F.col("path"), F.lit("Repo")))


@query("file_selection_reason", f"{_REASON_SQL} SELECT p_partkey, path, reason FROM q")
def file_selection_reason(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf)


@query("selection_histogram", f"{_REASON_SQL} SELECT coalesce(reason, 'None') AS reason, count(*) AS n FROM q GROUP BY 1")
def selection_histogram(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.records import histogram

    return histogram(_kept(spark, sf), "reason")


@query(
    "limit_words",
    r"""WITH w AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents), l AS (SELECT doc_id, t, regexp_extract_all(t, '\S+') AS ws FROM w)
    SELECT doc_id, sha256(CASE WHEN len(ws) <= 50 THEN t ELSE array_to_string(ws[1:50], ' ') END) AS digest FROM l""",
)
def limit_words(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.sha2(text.limit_words(F.col("text"), 50), 256).alias("digest"))


@query(
    "compress_text",
    r"""WITH t AS (SELECT doc_id, text, length(text) > 1000 + 500 + 200 AS long FROM documents)
    SELECT doc_id, long, sha256(CASE WHEN long THEN 'PAPER_CONTENT_HEAD_START' || chr(10) || left(text, 1000) || chr(10) || 'PAPER_CONTENT_HEAD_END' || chr(10) || chr(10) || '...' || chr(10) || chr(10) || 'PAPER_CONTENT_TAIL_START' || chr(10) || right(text, 500) || chr(10) || 'PAPER_CONTENT_TAIL_END' || chr(10)
      ELSE text END) AS digest FROM t""",
)
def compress_text(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", (F.length("text") > 1700).alias("long"), F.sha2(text.compress_text(F.col("text"), 1000, 500), 256).alias("digest"))


@query(
    "json_salvage",
    """SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2, 4) THEN props END AS json FROM events""",
)
def json_salvage(spark: SparkSession, sf: str) -> DataFrame:
    """Whole objects, fenced ones and such with prose or broken text around come back; lists and broken ones do not."""
    k, p = F.col("event_id"), F.col("props")
    noisy = (
        F.when(k % 6 == 0, F.concat(F.lit("  "), p, F.lit("\n")))
        .when(k % 6 == 1, F.concat(F.lit("```JSON\n"), p, F.lit("\n```  ")))
        .when(k % 6 == 2, F.concat(F.lit("Here it is: "), p, F.lit(" as asked.")))
        .when(k % 6 == 3, F.concat(F.lit("["), p, F.lit("]")))
        .when(k % 6 == 4, F.concat(p, F.lit(" and then {broken")))
        .otherwise(F.concat(F.lit("}"), F.replace(p, F.lit('"'), F.lit("'")), F.lit("{")))
    )
    return read(spark, sf, "events").select("event_id", text.json_object(noisy).alias("json"))


@query(
    "falsy_coalesce",
    """SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN (p_size % 3)::DOUBLE WHEN p_partkey % 2 <> 0 THEN 1.5::DOUBLE ELSE 0::DOUBLE END AS north,
    CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_type END AS name FROM part""",
)
def falsy_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    north = values.falsy_coalesce((size % 3).cast("double"), F.when(key % 2 != 0, F.lit(1.5)), F.lit(0.0))
    return read(spark, sf, "part").select("p_partkey", north.alias("north"), values.falsy_coalesce(F.when(size % 5 == 0, F.lit("")).otherwise(F.col("p_type")), F.col("p_brand")).alias("name"))


@query(
    "data_url_summary",
    """SELECT p_partkey, p_partkey % 4 IN (0, 1) AS present, CASE p_partkey % 4 WHEN 0 THEN 'image/' || lower(p_brand) END AS media_type,
    CASE p_partkey % 4 WHEN 0 THEN length('data:image/' || p_brand || ';base64,AAAA' || p_name) WHEN 1 THEN length(p_name) ELSE 0 END::INT AS char_length FROM part""",
)
def data_url_summary(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    url = F.when(k % 4 == 0, F.concat(F.lit("data:image/"), F.lower("p_brand"), F.lit(";base64,AAAA"), F.col("p_name"))).when(k % 4 == 1, F.col("p_name")).when(k % 4 == 2, "")
    s = text.data_url_summary(url)
    return read(spark, sf, "part").select("p_partkey", s["present"].alias("present"), s["media_type"].alias("media_type"), s["char_length"].alias("char_length"))


@query(
    "attribute_cleaning",
    """SELECT o_orderkey, (CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END + 3)::INT AS kept,
    (CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END + 2)::BIGINT AS informative FROM orders""",
)
def attribute_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    """Kept: what is not null or empty. Informative: neither blank nor administrative."""
    k = F.col("o_orderkey")
    attributes = F.create_map(
        F.lit("status"), F.when(k % 3 == 0, '""').otherwise(values.json_text(F.col("o_orderstatus"))),
        F.lit("url"), F.when(k % 4 == 0, "[]").otherwise('"http://x"'),
        F.lit("zero"), F.lit("0"),
        F.lit("no"), F.lit("false"),
        F.lit("blank"), F.lit('" \\t\\u00a0"'),
        F.lit("nothing"), F.lit("null"),
        F.lit("empty"), F.lit("{}"),
    )
    cleaned = values.clean_attributes(attributes)
    from ..operators.metrics import administrative

    return read(spark, sf, "orders").select("o_orderkey", F.size(cleaned).alias("kept"), values.informative_count(cleaned, administrative()).alias("informative"))


@query(
    "embedded_urls",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || ' http://a.org' WHEN 1 THEN 'http://a.org ' || url ELSE 'http://a.org' END AS urls FROM pages""",
)
def embedded_urls(spark: SparkSession, sf: str) -> DataFrame:
    k, u = F.col("page_id"), F.col("url")
    target = F.when(k % 3 == 2, F.lit("no address")).otherwise(u)
    given = F.when(k % 3 == 1, F.array(F.lit("http://a.org"), u)).otherwise(F.array(F.lit("http://a.org")))
    return read(spark, sf, "pages").select("page_id", F.array_join(ids.embedded_urls(target, given), " ").alias("urls"))
