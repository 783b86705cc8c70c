"""Queries on triples: a DataFrame of s, p, o, o_kind (iri, bnode, literal), o_datatype, o_lang. A graph is a set of them.

Patterns become joins that Catalyst orders and AQE broadcasts if a side is small; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaquarry.functions.terms import RDF_TYPE, found_in, prefixed_uri

COLUMNS = ("s", "p", "o", "o_kind", "o_datatype", "o_lang")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)


def union(*graphs: DataFrame) -> DataFrame:
    """The set union of graphs."""
    out = graphs[0].select(*COLUMNS)
    for g in graphs[1:]:
        out = out.unionByName(g.select(*COLUMNS))
    return out.dropDuplicates(list(COLUMNS))


def pattern(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples with the given terms."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(name) == value)
    return triples


def objects(triples: DataFrame, s: str, p: str) -> DataFrame:
    return pattern(triples, s, p).select("o", "o_kind")


def instances(triples: DataFrame, cls: str) -> DataFrame:
    """Subjects of a class."""
    return pattern(triples, p=RDF_TYPE, o=cls).select("s").distinct()


def subjects(triples: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Typed subjects, of the given types or of any."""
    typed = pattern(triples, p=RDF_TYPE)
    return (typed.where(F.col("o").isin(types)) if types is not None else typed).select("s").distinct()


def types(triples: DataFrame) -> DataFrame:
    """All objects of rdf:type, in order."""
    return pattern(triples, p=RDF_TYPE).select(F.col("o").alias("type")).distinct().orderBy("type")


def count_instances(triples: DataFrame, cls: str) -> DataFrame:
    """One row: how many subjects the class has, 0 if none."""
    return pattern(triples, p=RDF_TYPE, o=cls).agg(F.count("*").alias("n"))


def class_counts(triples: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Instances by class, commonest first; only of the given classes (column class) if there are some."""
    rows = pattern(triples, p=RDF_TYPE).select(F.col("o").alias("class"))
    if classes is not None:
        rows = rows.join(classes.select("class").distinct(), "class", "left_semi")
    return rows.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class")


def typed_with(triples: DataFrame, cls: str, p: str, o: str) -> DataFrame:
    """Subjects of a class that have a certain property value."""
    return instances(triples, cls).join(pattern(triples, p=p, o=o).select("s").distinct(), "s", "left_semi")


def optional(rows: DataFrame, key: str, triples: DataFrame, p: str, into: str) -> DataFrame:
    """rows with the property's values, one row each, or null without any."""
    values = pattern(triples, p=p).select(F.col("s").alias(key), F.col("o").alias(into))
    return rows.join(values, key, "left")


def without(rows: DataFrame, key: str, triples: DataFrame, p: str) -> DataFrame:
    """rows whose key has no triple with the property."""
    return rows.join(pattern(triples, p=p).select(F.col("s").alias(key)), key, "left_anti")


def path(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """Starts and ends of chains of predicates: start, end."""
    out = pattern(triples, p=predicates[0]).select(F.col("s").alias("start"), F.col("o").alias("end"))
    for p in predicates[1:]:
        step = pattern(triples, p=p).select(F.col("s").alias("end"), F.col("o").alias("further"))
        out = out.join(step, "end").select("start", F.col("further").alias("end"))
    return out


def properties(triples: DataFrame, s: str | None = None) -> DataFrame:
    """For each subject (or one) and property: its values in order, and the single value where there is just one."""
    rows = pattern(triples, s=s).groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("values"))
    return rows.select("s", prefixed_uri(F.col("p")).alias("p"), "values", F.when(F.size("values") == 1, F.col("values")[0]).alias("value"))


def edges(triples: DataFrame, p: str) -> DataFrame:
    return pattern(triples, p=p).select(F.col("s").alias("child"), F.col("o").alias("parent")).distinct()


def closure(links: DataFrame) -> DataFrame:
    """All ancestors by links (child, parent): child, ancestor, depth (the least). Cycles end, and no node is its own ancestor.

    Semi-naive: each turn joins only what was new in the last one, and only that is written (to the shared folder, so
    lineage stays short and no lost executor costs more than a turn). As many turns as the longest shortest path."""
    from metaquarry.operators.shared import cut

    links = cut(links.select("child", "parent").where("child <> parent").distinct())
    known = new = links.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    depth = 1
    while True:
        depth += 1
        step = new.select("child", F.col("ancestor").alias("via")).join(links.withColumnRenamed("child", "via"), "via")
        step = step.where("child <> parent").select("child", F.col("parent").alias("ancestor")).distinct()
        new = cut(step.join(known, ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return known
        known = known.unionByName(new.select("child", "ancestor", "depth"))


def ancestors(links: DataFrame, node: str) -> DataFrame:
    """All ancestors of one node, without itself."""
    return _reached(links, node, "child", "parent")


def descendants(links: DataFrame, node: str) -> DataFrame:
    """All descendants of one node, without itself."""
    return _reached(links, node, "parent", "child")


def _reached(links: DataFrame, node: str, source: str, target: str) -> DataFrame:
    """A breadth-first search from one node: each turn follows the links of the nodes that are new, of which each is visited once."""
    from metaquarry.operators.shared import cut

    steps = cut(links.select(F.col(source).alias("node"), F.col(target).alias("to_")).where("node <> to_").distinct())
    start = links.sparkSession.range(1).select(F.lit(node).alias("node"))
    known = new = start
    while True:
        step = new.join(steps, "node").select(F.col("to_").alias("node")).distinct()
        new = cut(step.join(known, "node", "left_anti"))
        if new.isEmpty():
            return known.where(F.col("node") != node)
        known = known.unionByName(new)


def roots(triples: DataFrame, cls: str, p: str) -> DataFrame:
    """Instances of a class that have no parent by p."""
    return without(instances(triples, cls), "s", triples, p)


def parent_map(links: DataFrame) -> DataFrame:
    """One parent for each child (the greatest), in order."""
    return links.groupBy("child").agg(F.max("parent").alias("parent")).orderBy("child")


def levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, level: every parent within the given nodes has a lower level; nodes on cycles, and those under them, come last with a null level.

    Layers are peeled off: each turn takes the nodes all of whose parents have a level, and drops the links from them."""
    from metaquarry.operators.shared import cut

    nodes = cut(nodes.select("node").distinct())
    inside = links.where("child <> parent").join(nodes.select(F.col("node").alias("child")), "child", "left_semi").join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi")
    left, waiting, level, out = cut(inside.select("child", "parent").distinct()), nodes, 0, None
    while True:
        free = cut(waiting.join(left.select(F.col("child").alias("node")).distinct(), "node", "left_anti"))
        if free.isEmpty():
            stuck = waiting.withColumn("level", F.lit(None).cast("int"))
            return stuck if out is None else out.unionByName(stuck)
        layer = free.withColumn("level", F.lit(level))
        out = layer if out is None else out.unionByName(layer)
        waiting = cut(waiting.join(free, "node", "left_anti"))
        left = cut(left.join(free.withColumnRenamed("node", "parent"), "parent", "left_anti").select("child", "parent"))
        level += 1


def search(triples: DataFrame, cls: str, text: str) -> DataFrame:
    """Instances of a class whose IRI has the pattern anywhere, whatever the case."""
    return instances(triples, cls).where(found_in(F.col("s"), text)).orderBy("s")


def labelled(triples: DataFrame, p: str, text: str) -> DataFrame:
    """s, label: subjects whose property's literal has the text anywhere, whatever the case."""
    return pattern(triples, p=p).where((F.col("o_kind") == "literal") & F.contains(F.lower("o"), F.lit(text.lower()))).select("s", F.col("o").alias("label"))


def statistics(triples: DataFrame) -> DataFrame:
    """kind (triples, type, property), name, n: one pass over the triples."""
    rows = triples.select(F.explode(F.filter(F.array(
        F.struct(F.lit("triples").alias("kind"), F.lit("").alias("name")),
        F.struct(F.lit("property").alias("kind"), F.col("p").alias("name")),
        F.when(F.col("p") == RDF_TYPE, F.struct(F.lit("type").alias("kind"), F.col("o").alias("name"))),
    ), lambda x: x.isNotNull())).alias("x"))
    return rows.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last in the order."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(*key, "last.*")


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return first.select(*key, "first.*")


def positions(rows: DataFrame, key: str, order: list[str], into: str = "position") -> DataFrame:
    """Numbers from 1 within each key. Order by enough columns to have no ties."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
