"""Pattern queries over a typed property graph: patterns become joins, with the schema's entailments written out.

A relation means its edges, those of its sub-properties, and the swapped edges of its inverses; a class means itself and its
subclasses. Catalyst then sees plain joins and unions of filtered edge tables, which prune partitions by relation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

# Axioms of the schema.
INVERSES = {"hasMember": "isMemberOf", "isExecutedBy": "executes", "hasSubPage": "isPartOf", "documentedBy": "describes"}
SUB_PROPERTIES = {"describesTool": "describes", "describesModel": "describes"}

#: Of joins in blocks: estimated bytes of the left from which on they pay, rows of the left in a block and in a list (of 8, as
#: Parquet packs values, and a part of its longest run of packed ones, so that repeats lie alike), estimated bytes of the left for
#: each task, and tasks at most.
CROWDED_BYTES, BLOCK_ROWS, LIST_ROWS, TASK_BYTES, MOST_TASKS = 64 << 20, 8192, 168, 256 << 10, 10_000


@dataclass
class Schema:
    inverses: dict[str, str] = field(default_factory=lambda: dict(INVERSES))
    sub_properties: dict[str, str] = field(default_factory=lambda: dict(SUB_PROPERTIES))

    def both_ways(self) -> dict[str, str]:
        return self.inverses | {v: k for k, v in self.inverses.items()}

    def narrower(self, relation: str) -> list[str]:
        """The relation and all its sub-properties."""
        out = [relation]
        for r in out:
            out += [s for s, general in self.sub_properties.items() if general == r and s not in out]
        return out

    def meanings(self, relation: str) -> list[tuple[str, bool]]:
        """(relation, swapped) of all edges that state the relation."""
        straight = self.narrower(relation)
        inverse = self.both_ways()
        swapped = [n for s in straight if s in inverse for n in self.narrower(inverse[s])]
        # a sub-property states what it narrows, so inverses of what is narrowed do not state it
        return [(s, False) for s in straight] + [(s, True) for s in dict.fromkeys(swapped)]


@dataclass
class TypedGraph:
    """edges: relation, source, target and attribute columns; nodes: id, class and attribute columns (may be None)."""

    edges: DataFrame | None
    nodes: DataFrame | None = None
    closure: DataFrame | None = None
    schema: Schema = field(default_factory=Schema)

    def stated(self, relation: str) -> DataFrame:
        return self.edges.filter(F.col("relation") == relation)

    def relation(self, relation: str, *attributes: str) -> DataFrame:
        """source, target and attributes of a relation with what entails it, each statement once."""
        out = None
        for name, swapped in self.schema.meanings(relation):
            a, b = ("target", "source") if swapped else ("source", "target")
            part = self.stated(name).select(F.col(a).alias("source"), F.col(b).alias("target"), *attributes)
            out = part if out is None else out.unionByName(part)
        return out.distinct()

    def members(self, kind: str) -> DataFrame:
        """Nodes of a class or of one of its subclasses."""
        kinds = self.closure.filter(F.col("ancestor") == kind).select("class") if self.closure is not None else None
        if kinds is None:
            return self.nodes.filter(F.col("class") == kind)
        return self.nodes.join(F.broadcast(kinds), "class", "left_semi")  # classes of the schema: tens of rows

    def of_class(self, step: DataFrame, variable: str, kind: str) -> DataFrame:
        """Rows of a step whose variable is a node of a class or of one of its subclasses."""
        return step.join(self.members(kind).select(F.col("id").alias(variable)), variable, "left_semi")

    def match(self, *patterns: str, classes: dict[str, str] | None = None, crowded: str | None = None) -> DataFrame:
        """Bindings of the variables of patterns 'a relation b'; 'a relation b?' need not hold. One row a binding.

        crowded: a variable that few nodes bind in many rows of both sides, so that a join on it gives far more rows than it reads."""
        out, bound = None, set()
        for pattern in patterns:
            a, relation, b = pattern.rstrip("?").split()
            step = self.relation(relation).select(F.col("source").alias(a), F.col("target").alias(b))
            for v in (a, b):
                if classes and v in classes and v not in bound:
                    step = self.of_class(step, v, classes[v])
            if out is None:
                out = step
            else:
                on, how = [v for v in (a, b) if v in bound], "left" if pattern.endswith("?") else "inner"
                out = in_blocks(out, step, crowded, how) if on == [crowded] else out.join(step, on, how)
            bound |= {a, b}
        return out


def in_blocks(left: DataFrame, right: DataFrame, by: str, how: str) -> DataFrame:
    """left.join(right, by, how), inner or left, for tables with few keys and many rows of each.

    A key's rows of the left are dealt to blocks of about BLOCK_ROWS, each of which meets all the key's rows of the right, so no
    task has a whole crowded key. Within a block they are lists of LIST_ROWS that are met whole and then spread: a row of the
    right stands in a run beside each list, and lists repeat. Runs and repeats over the few values of a task are what writers
    compress. Tasks are counted from the estimated size of the left; small tables are joined as they are."""
    size = int(str(left._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < CROWDED_BYTES:
        return left.join(right, by, how)
    others, further = ([c for c in side.columns if c != by] for side in (left, right))
    tasks = min(MOST_TASKS, -(-size // TASK_BYTES))
    blocks = left.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("_blocks"))
    each = right.join(blocks, by).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))).drop("_blocks")
    # rows without a key meet nothing, and are not to lie in one task
    block = F.pmod(F.xxhash64(*others), F.coalesce("_blocks", F.lit(tasks)))
    dealt = left.join(blocks, by, how).select(by, *others, block.alias("_block")).repartition(tasks, by, "_block")
    # structs, since lists leave out nulls
    whole = dealt.groupBy(by, "_block").agg(F.collect_list(F.struct(*others)).alias("_rows"))
    starts = F.sequence(F.lit(1), F.size("_rows"), F.lit(LIST_ROWS))
    lists = whole.select(by, "_block", F.explode(F.transform(starts, lambda at: F.slice("_rows", at, LIST_ROWS))).alias("_rows"))
    met = lists.hint("merge").join(each.repartition(tasks, by, "_block"), [by, "_block"], how)
    return met.select(by, F.explode("_rows").alias("_row"), *further).select(by, "_row.*", *further)


def class_closure(spark: SparkSession, parents: DataFrame) -> DataFrame:
    """class, ancestor, depth of all classes (each is its own ancestor). parents: class, parent (null at the top)."""
    parents.createOrReplaceTempView("graphloom_parents")
    return spark.sql(
        """WITH RECURSIVE up(class, ancestor, depth) AS (
             SELECT DISTINCT class, class, 0 FROM graphloom_parents
             UNION ALL
             SELECT up.class, p.parent, up.depth + 1 FROM up JOIN graphloom_parents p ON up.ancestor = p.class WHERE p.parent IS NOT NULL)
           SELECT class, ancestor, min(depth) AS depth FROM up GROUP BY class, ancestor"""
    )


def reachable(start: DataFrame, edges: DataFrame) -> DataFrame:
    """id, reached: everything that a path of edges (source, target) leads to, the start itself included.

    For few starts: one step a round. Each round's new pairs are a table of their own, cut off by a checkpoint; pairs seen
    before are not written again, and not followed again, so cycles end."""
    step = edges.select(F.col("source").alias("reached"), F.col("target").alias("next"))
    frontier = cut(start.select(F.col("id"), F.col("id").alias("reached")).distinct())
    seen = frontier
    while not frontier.isEmpty():
        further = frontier.join(step, "reached").select("id", F.col("next").alias("reached")).distinct()
        frontier = cut(further.join(seen, ["id", "reached"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def transitive(edges: DataFrame) -> DataFrame:
    """source, target of all paths of one edge or more, for every start at once. Each round joins the paths found last with all
    paths so far, so paths of length n take about log2(n) rounds; cycles end since no pair is new."""
    paths = cut(edges.select("source", "target").distinct())
    new = paths
    while not new.isEmpty():
        ahead = paths.select(F.col("source").alias("target"), F.col("target").alias("end"))
        behind = paths.select(F.col("source").alias("begin"), F.col("target").alias("source"))
        joined = new.join(ahead, "target").select("source", F.col("end").alias("target")).unionByName(behind.join(new, "source").select(F.col("begin").alias("source"), "target"))
        new = cut(joined.distinct().join(paths, ["source", "target"], "left_anti"))
        paths = paths.unionByName(new)
    return paths
