"""Catalogue: the 26 competency questions as pattern queries over the research graph, and the schema's entailments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .patterns import SUB_PROPERTIES, class_closure, transitive
from .registry import query
from .research import CLASSES, PARENTS, RELATIONS, class_of, class_rows, edges, graph, relation_sql
from .star import read


def _count(df: DataFrame, *by: str, **named) -> DataFrame:
    return df.groupBy(*by).agg(*[v.alias(k) for k, v in named.items()])


def _n():
    return F.count(F.lit(1))


@query("cq_e01", relation_sql("reports", "produces") + "SELECT r.source AS p, r.target AS m, f.target AS f FROM reports r LEFT JOIN produces f ON f.source = r.target")
def e01(spark: SparkSession, sf: str) -> DataFrame:
    """Methods that papers report, and what they find; methods without findings stay."""
    return graph(spark, sf).match("p reports m", "m produces f?", crowded="m").select("p", "m", "f")


@query(
    "cq_e02",
    relation_sql("usesModel", "mentionsModel")
    + "SELECT u.target AS m, count(DISTINCT u.source) AS papers, (SELECT count(*) FROM mentionsModel x WHERE x.target = u.target AND NOT EXISTS (SELECT 1 FROM usesModel y WHERE y.source = x.source AND y.target = x.target)) AS mentioned_only FROM usesModel u GROUP BY u.target HAVING count(DISTINCT u.source) > 1",
)
def e02(spark: SparkSession, sf: str) -> DataFrame:
    """Models that several papers use, and how many papers only mention them."""
    g = graph(spark, sf)
    uses, mentions = g.match("p usesModel m"), g.match("p mentionsModel m")
    used = _count(uses, "m", papers=F.countDistinct("p")).filter("papers > 1")
    only = _count(mentions.join(uses, ["p", "m"], "left_anti"), "m", mentioned_only=_n())
    return used.join(only, "m", "left").select("m", "papers", F.coalesce("mentioned_only", F.lit(0)).alias("mentioned_only"))


@query("cq_e03", relation_sql("implementsMethod", "reports") + "SELECT p.source AS p, i.target AS m, i.source AS r FROM implementsMethod i JOIN reports p ON p.target = i.target GROUP BY ALL")
def e03(spark: SparkSession, sf: str) -> DataFrame:
    """Repositories that implement a method of a paper."""
    return graph(spark, sf).match("p reports m", "r implementsMethod m", crowded="m").select("p", "m", "r")


@query("cq_e04", relation_sql("studiesFeature", "usesDataset") + "SELECT DISTINCT s.target AS w, d.target AS d FROM studiesFeature s JOIN usesDataset d ON d.source = s.source WHERE s.target LIKE 'watershed:%'")
def e04(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf).match("p studiesFeature w", "p usesDataset d", classes={"w": "Watershed"}).select("w", "d").distinct()


def _curated(spark: SparkSession, sf: str) -> DataFrame:
    """Repositories of the corpus; the others are only referred to."""
    return read(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("repo:"), F.col("s_suppkey").cast("string")).alias("r"))


_CURATED_SQL = "(SELECT 'repo:' || s_suppkey FROM supplier WHERE s_acctbal > 5000)"


@query("cq_e05", relation_sql("describesTool", "implementedBy") + f"SELECT d.source AS page, d.target AS t, i.target AS r FROM describesTool d JOIN implementedBy i ON i.source = d.target WHERE i.target IN {_CURATED_SQL}")
def e05(spark: SparkSession, sf: str) -> DataFrame:
    """Described tools with their repositories of the corpus."""
    return graph(spark, sf).match("page describesTool t", "t implementedBy r").join(_curated(spark, sf), "r", "left_semi").select("page", "t", "r")


@query(
    "cq_e06",
    relation_sql("usesDataset", "references")
    + "SELECT target AS d, count(DISTINCT source) FILTER (WHERE source LIKE 'paper:%') AS papers, count(DISTINCT source) FILTER (WHERE source LIKE 'repo:%') AS repositories, count(DISTINCT source) FILTER (WHERE source LIKE 'dataset:%') AS datasets FROM (SELECT * FROM usesDataset UNION ALL SELECT * FROM \"references\") GROUP BY target",
)
def e06(spark: SparkSession, sf: str) -> DataFrame:
    """Who uses or references a dataset, by kind of user."""
    g = graph(spark, sf)
    users = g.relation("usesDataset").unionByName(g.relation("references")).withColumn("kind", F.substring_index("source", ":", 1))
    by = lambda k: F.countDistinct(F.when(F.col("kind") == k, F.col("source")))
    return _count(users, F.col("target").alias("d"), papers=by("paper"), repositories=by("repo"), datasets=by("dataset"))


@query("cq_e07", relation_sql("hasContributor", "hasAuthor") + "SELECT DISTINCT c.target AS person, c.source AS r FROM hasContributor c JOIN hasAuthor a ON a.target = c.target")
def e07(spark: SparkSession, sf: str) -> DataFrame:
    """Contributors of code who are authors as well. Authors are reduced to people before the join."""
    g = graph(spark, sf)
    authors = g.relation("hasAuthor").select(F.col("target").alias("person")).distinct()
    return g.match("r hasContributor person").join(authors, "person", "left_semi").select("person", "r")


@query("cq_e08", relation_sql("implementsMethod") + "SELECT source AS r, target AS m, attribute AS said FROM implementsMethod")
def e08(spark: SparkSession, sf: str) -> DataFrame:
    """Implementations with their evidence."""
    return graph(spark, sf).relation("implementsMethod", "attribute").select(F.col("source").alias("r"), F.col("target").alias("m"), F.col("attribute").alias("said"))


@query(
    "cq_e09",
    relation_sql("catalogs", "describesTool", "hasProcedure", "hasStep")
    + "SELECT t, p.target AS procedure, string_agg(s.target, ' ' ORDER BY CAST(split_part(s.target, ':', 3) AS BIGINT)) AS steps FROM (SELECT source, target AS t FROM catalogs UNION SELECT source, target FROM describesTool) c JOIN hasProcedure p ON p.source = c.source JOIN (SELECT DISTINCT source, target FROM hasStep) s ON s.source = p.target GROUP BY t, p.target",
)
def e09(spark: SparkSession, sf: str) -> DataFrame:
    """Procedures that pages about a tool hold, with their steps in order."""
    g = graph(spark, sf)
    pages = g.relation("catalogs").unionByName(g.relation("describesTool")).distinct().select(F.col("source").alias("page"), F.col("target").alias("t"))
    steps = g.relation("hasStep").withColumn("no", F.substring_index("target", ":", -1).cast("bigint"))
    listed = steps.groupBy(F.col("source").alias("procedure")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "target"))), lambda s: s["target"]), " ").alias("steps"))
    own = pages.join(g.match("page hasProcedure procedure"), "page").select("t", "procedure").distinct()
    return own.join(listed, "procedure").select("t", "procedure", "steps")


@query("cq_e10", relation_sql("describesTool", "implementedBy") + f"SELECT DISTINCT target AS t FROM describesTool WHERE target NOT IN (SELECT source FROM implementedBy WHERE target IN {_CURATED_SQL})")
def e10(spark: SparkSession, sf: str) -> DataFrame:
    """Described tools without a repository of the corpus."""
    g = graph(spark, sf)
    known = g.match("t implementedBy r").join(_curated(spark, sf), "r", "left_semi")
    return g.match("page describesTool t").select("t").distinct().join(known, "t", "left_anti")


@query("cq_e11", relation_sql("studiesFeature", "mentionsVariable") + "SELECT s.target AS reach, v.target AS v, count(*) AS papers FROM studiesFeature s JOIN mentionsVariable v ON v.source = s.source WHERE s.target LIKE 'reach:%' GROUP BY 1, 2")
def e11(spark: SparkSession, sf: str) -> DataFrame:
    return _count(graph(spark, sf).match("p studiesFeature reach", "p mentionsVariable v", classes={"reach": "RiverReach"}), "reach", "v", papers=_n())


@query("cq_e12", relation_sql("generatedBy") + "SELECT source AS d, target AS r, attribute AS said FROM generatedBy WHERE attribute IS NOT NULL")
def e12(spark: SparkSession, sf: str) -> DataFrame:
    """Datasets with the code that made them, only where it is stated."""
    return graph(spark, sf).relation("generatedBy", "attribute").filter("attribute IS NOT NULL").select(F.col("source").alias("d"), F.col("target").alias("r"), F.col("attribute").alias("said"))


@query("cq_e13", relation_sql("testedBy", "supports") + "SELECT 'tested' AS kind, source, target FROM testedBy UNION ALL SELECT 'supported', source, target FROM supports")
def e13(spark: SparkSession, sf: str) -> DataFrame:
    """Tests of hypotheses and support of claims, kept apart."""
    g = graph(spark, sf)
    said = lambda kind, r: g.relation(r).select(F.lit(kind).alias("kind"), "source", "target")
    return said("tested", "testedBy").unionByName(said("supported", "supports"))


_DOCUMENTED_SQL = "docs AS (SELECT source, target FROM documentedBy UNION SELECT target, source FROM describesTool UNION SELECT target, source FROM describesModel)"


@query(
    "cq_e14",
    relation_sql("hasComponent", "implementedBy", "documentedBy", "describesTool", "describesModel", "referencesDataset", "describedInPaper").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""", {_DOCUMENTED_SQL}, parts(start, t) AS (SELECT DISTINCT source, source FROM hasComponent UNION SELECT p.start, c.target FROM parts p JOIN hasComponent c ON c.source = p.t)
    SELECT start, 'repository' AS kind, i.target AS found FROM parts JOIN implementedBy i ON i.source = t
    UNION SELECT start, 'page', d.target FROM parts JOIN docs d ON d.source = t
    UNION SELECT start, 'dataset', r.target FROM parts JOIN docs d ON d.source = t JOIN referencesDataset r ON r.source = d.target
    UNION SELECT start, 'paper', x.target FROM parts JOIN describedInPaper x ON x.source = t""",
)
def e14(spark: SparkSession, sf: str) -> DataFrame:
    """All that belongs to a product: its components at any depth, their code, pages, datasets and papers."""
    g = graph(spark, sf)
    components = g.relation("hasComponent")
    own = components.select(F.col("source").alias("start"), F.col("source").alias("t"))
    parts = transitive(components).select(F.col("source").alias("start"), F.col("target").alias("t")).unionByName(own.distinct()).distinct()
    pages = g.match("t documentedBy page")
    said = lambda kind, df, c: parts.join(df, "t").select("start", F.lit(kind).alias("kind"), F.col(c).alias("found"))
    return (
        said("repository", g.match("t implementedBy r"), "r")
        .union(said("page", pages, "page"))
        .union(said("dataset", pages.join(g.match("page referencesDataset d"), "page"), "d"))
        .union(said("paper", g.match("t describedInPaper p"), "p"))
        .distinct()
    )


@query("cq_e15", relation_sql("cites") + "SELECT target AS p, count(*) FILTER (WHERE attribute = 'extends') AS extends, count(*) FILTER (WHERE attribute = 'usesMethodIn') AS uses_method, count(*) FILTER (WHERE attribute = 'discusses') AS discusses FROM cites GROUP BY target")
def e15(spark: SparkSession, sf: str) -> DataFrame:
    """How papers are cited, by the kind of citation."""
    kinds = {"extends": "extends", "uses_method": "usesMethodIn", "discusses": "discusses"}
    return _count(graph(spark, sf).relation("cites", "attribute"), F.col("target").alias("p"), **{k: F.count_if(F.col("attribute") == v) for k, v in kinds.items()})


@query("cq_e16", relation_sql("usesModel", "mentionsModel", "usesTool", "describesModel") + "SELECT target AS m, source AS artifact, 'uses' AS how FROM usesModel UNION SELECT target, source, 'mentions' FROM mentionsModel UNION SELECT target, source, 'runs' FROM usesTool WHERE target LIKE 'model:%' UNION SELECT target, source, 'describes' FROM describesModel")
def e16(spark: SparkSession, sf: str) -> DataFrame:
    """Everything about one model, by kind of artifact."""
    g = graph(spark, sf)
    said = lambda how, r: g.relation(r).filter(F.startswith("target", F.lit("model:"))).select(F.col("target").alias("m"), F.col("source").alias("artifact"), F.lit(how).alias("how"))
    return said("uses", "usesModel").union(said("mentions", "mentionsModel")).union(said("runs", "usesTool")).union(said("describes", "describesModel"))


@query("cq_e17", relation_sql("hasFile", "dependsOn") + "SELECT r, files, notebooks, coalesce(dependencies, 0) AS dependencies FROM (SELECT source AS r, count(*) AS files, count(*) FILTER (WHERE attribute = 'notebook') AS notebooks FROM hasFile GROUP BY 1) f LEFT JOIN (SELECT source AS r, count(DISTINCT target) AS dependencies FROM dependsOn GROUP BY 1) d USING (r)")
def e17(spark: SparkSession, sf: str) -> DataFrame:
    """Files by role and dependencies of a repository; each side is aggregated before they meet."""
    g = graph(spark, sf)
    files = _count(g.relation("hasFile", "attribute"), F.col("source").alias("r"), files=_n(), notebooks=F.count_if(F.col("attribute") == "notebook"))
    needs = _count(g.relation("dependsOn"), F.col("source").alias("r"), dependencies=_n())
    return files.join(needs, "r", "left").select("r", "files", "notebooks", F.coalesce("dependencies", F.lit(0)).alias("dependencies"))


@query("cq_e18", relation_sql("describesFunction") + "SELECT source AS r, target AS x FROM describesFunction")
def e18(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf).match("r describesFunction x").select("r", "x")


@query("cq_e19", relation_sql("isMemberOf", "hasMember", "hasToolConfig", "launchesApp") + "SELECT m.d, m.c, t.target AS tc, a.target AS t FROM (SELECT source AS d, target AS c FROM isMemberOf UNION SELECT target, source FROM hasMember) m LEFT JOIN hasToolConfig t ON t.source = m.d LEFT JOIN launchesApp a ON a.source = t.target")
def e19(spark: SparkSession, sf: str) -> DataFrame:
    """Members of collections (stated from either side), and the tools they launch."""
    return graph(spark, sf).match("d isMemberOf c", "d hasToolConfig tc?", "tc launchesApp t?").select("d", "c", "tc", "t")


@query("cq_e20", relation_sql("announces") + "SELECT source AS page, target AS what, CASE WHEN target LIKE 'repo:%' THEN 'repository' ELSE 'page' END AS kind FROM announces WHERE attribute = 'release-note'")
def e20(spark: SparkSession, sf: str) -> DataFrame:
    rows = graph(spark, sf).relation("announces", "attribute").filter("attribute = 'release-note'")
    return rows.select(F.col("source").alias("page"), F.col("target").alias("what"), F.when(F.startswith("target", F.lit("repo:")), "repository").otherwise("page").alias("kind"))


@query("cq_e21", relation_sql("referencesFeature", "studiesPlace", "hasSpatialCoverage") + "SELECT 'feature' AS kind, source, target FROM referencesFeature UNION ALL SELECT 'place', source, target FROM studiesPlace UNION ALL SELECT 'coverage', source, target FROM hasSpatialCoverage")
def e21(spark: SparkSession, sf: str) -> DataFrame:
    g = graph(spark, sf)
    said = lambda kind, r: g.relation(r).select(F.lit(kind).alias("kind"), "source", "target")
    return said("feature", "referencesFeature").unionByName(said("place", "studiesPlace")).unionByName(said("coverage", "hasSpatialCoverage"))


@query("cq_e22", relation_sql("fundedBy") + "SELECT a.source AS x, a.target AS award, o.target AS org, CASE WHEN CAST(substr(o.target, 5) AS BIGINT) % 2 = 0 THEN 'ror:' || substr(o.target, 5) END AS ror FROM fundedBy a JOIN fundedBy o ON o.source = a.target")
def e22(spark: SparkSession, sf: str) -> DataFrame:
    """Funding in two steps of one relation: what an award pays for, and who gives it."""
    found = graph(spark, sf).match("x fundedBy award", "award fundedBy org")
    number = F.substring("org", 5, 20)
    return found.select("x", "award", "org", F.when(number.cast("bigint") % 2 == 0, F.concat(F.lit("ror:"), number)).alias("ror"))


@query("cq_e23", relation_sql("appliesTo", "usesAlgorithm") + "SELECT a.source AS m, a.target AS model, CASE WHEN a.target LIKE 'mlmodel:%' THEN 'MLModel' ELSE 'ComputationalModel' END AS kind, u.target AS a FROM appliesTo a LEFT JOIN usesAlgorithm u ON u.source = a.source")
def e23(spark: SparkSession, sf: str) -> DataFrame:
    found = graph(spark, sf).match("m appliesTo model", "m usesAlgorithm a?", classes={"model": "ComputationalModel"})
    return found.select("m", "model", class_of(F.col("model")).alias("kind"), "a")


@query("cq_e24", relation_sql("evaluates", "reportsMetric") + "SELECT e.target AS model, r.target AS metric, r.source AS x, r.attribute AS value FROM evaluates e JOIN reportsMetric r ON r.target = e.source")
def e24(spark: SparkSession, sf: str) -> DataFrame:
    g = graph(spark, sf)
    reported = g.relation("reportsMetric", "attribute").select(F.col("source").alias("x"), F.col("target").alias("metric"), F.col("attribute").alias("value"))
    return g.match("metric evaluates model").join(reported, "metric").select("model", "metric", "x", "value")


@query("cq_e25", relation_sql("hasParameter") + "SELECT source AS x, count(*) AS parameters FROM hasParameter WHERE attribute = 'calibrated' GROUP BY source")
def e25(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrated parameters of models of any kind."""
    g = graph(spark, sf)
    rows = g.relation("hasParameter", "attribute").filter("attribute = 'calibrated'")
    return _count(g.of_class(rows, "source", "ComputationalModel"), F.col("source").alias("x"), parameters=_n())


@query("cq_e26", relation_sql("archivedAs") + ", stubs AS (SELECT DISTINCT 'doi:10.1/' || (l_suppkey * 2) AS doi FROM lineitem) SELECT s.doi, a.source AS r FROM stubs s JOIN archivedAs a ON a.target = s.doi")
def e26(spark: SparkSession, sf: str) -> DataFrame:
    """Stubs that are an archived repository: by the exact identifier, never by name."""
    stubs = read(spark, sf, "lineitem").select(F.concat(F.lit("doi:10.1/"), (F.col("l_suppkey") * 2).cast("string")).alias("doi")).distinct()
    return stubs.join(graph(spark, sf).match("r archivedAs doi"), "doi").select("doi", "r")


_PARENT_ROWS = ", ".join(f"('{c}', {repr(PARENTS[c]) if c in PARENTS else 'NULL'})" for c in sorted({*CLASSES.values(), *PARENTS, *PARENTS.values()}))


@query(
    "class_closure",
    f"""WITH RECURSIVE parents(class, parent) AS (VALUES {_PARENT_ROWS}), up(class, ancestor, depth) AS (SELECT class, class, 0 FROM parents UNION ALL SELECT up.class, p.parent, depth + 1 FROM up JOIN parents p ON p.class = up.ancestor WHERE p.parent IS NOT NULL)
    SELECT class, ancestor, min(depth)::INT AS depth FROM up GROUP BY 1, 2""",
)
def closure(spark: SparkSession, sf: str) -> DataFrame:
    return class_closure(spark, spark.createDataFrame(class_rows(), "class string, parent string"))


@query(
    "place_closure",
    """WITH RECURSIVE up(id, reached) AS (SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
      UNION SELECT u.id, 'region:' || n_regionkey FROM up u JOIN nation ON u.reached = 'nation:' || n_nationkey)
    SELECT reached, count(*) AS places FROM (SELECT * FROM up UNION SELECT id, id FROM up) GROUP BY reached""",
)
def place_closure(spark: SparkSession, sf: str) -> DataFrame:
    from . import star

    edges = star.edges(spark, sf).filter("relation = 'partOf' OR (relation = 'locatedIn' AND source LIKE 'customer:%')")
    own = edges.select(F.col("source"), F.col("source").alias("target")).distinct()
    pairs = transitive(edges).unionByName(own).distinct()
    return _count(pairs, F.col("target").alias("reached"), places=_n())


@query(
    "edges_entailed",
    relation_sql("isMemberOf", "hasMember", "documentedBy", "describesTool", "describesModel")
    + """SELECT 'isMemberOf' AS relation, count(*) AS edges FROM (SELECT source, target FROM isMemberOf UNION SELECT target, source FROM hasMember)
    UNION ALL SELECT 'describes', count(*) FROM (SELECT source, target FROM describesTool UNION SELECT source, target FROM describesModel UNION SELECT target, source FROM documentedBy)
    UNION ALL SELECT 'documentedBy', count(*) FROM (SELECT source, target FROM documentedBy UNION SELECT target, source FROM describesTool UNION SELECT target, source FROM describesModel)
    UNION ALL SELECT 'describesTool', count(*) FROM describesTool""",
)
def entailed(spark: SparkSession, sf: str) -> DataFrame:
    g = graph(spark, sf)
    out = None
    for name in ("isMemberOf", "describes", "documentedBy", *[s for s in SUB_PROPERTIES if s == "describesTool"]):
        part = g.relation(name).agg(F.lit(name).alias("relation"), _n().alias("edges"))
        out = part if out is None else out.unionByName(part)
    return out


_DOMAINS = {"reports": ("Paper", "Method"), "usesDataset": ("Paper", "DatasetResource"), "studiesFeature": ("Paper", "HydrologicFeature"), "appliesTo": ("Method", "ComputationalModel"), "announces": ("DocumentationPage", "Repository"), "hasParameter": ("ComputationalModel", "Parameter")}


@query(
    "conformance_domain_range",
    relation_sql(*_DOMAINS)
    + """SELECT 'usesDataset' AS relation, 'domain' AS side, 'Repository' AS found, count(*) AS n FROM usesDataset WHERE source LIKE 'repo:%' GROUP BY 1, 2, 3
    UNION ALL SELECT 'announces', 'range', 'DocumentationPage', count(*) FROM announces WHERE target LIKE 'page:%'""",
)
def conformance(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose ends are of no class that the relation allows, subclasses included."""
    from .ontology import violations

    g = graph(spark, sf, *_DOMAINS)
    allowed = spark.createDataFrame([(r, side, k) for r, (a, b) in _DOMAINS.items() for side, k in (("domain", a), ("range", b))], "relation string, side string, class string")
    return _count(violations(g.nodes, edges(spark, sf, tuple(_DOMAINS)), allowed, g.closure), "relation", "side", "found", n=_n())


assert set(SUB_PROPERTIES) <= set(RELATIONS)
