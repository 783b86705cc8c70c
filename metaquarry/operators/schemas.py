"""Ontology to schemas: classes as DDL, enumerations as constants, in an order in which parents come first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaquarry.functions.terms import escaped, field_ddl, field_name, is_list, is_optional, last_part, prefixed_uri, range_type
from metaquarry.operators import graph, ontology


def field_registry(attributes: DataFrame) -> DataFrame:
    """class, field, rdf_term, type, is_list, is_optional, ddl: from attributes (uri, owner, label, range, display)."""
    name = F.coalesce("label", last_part(F.col("uri"), "-"))
    card = F.coalesce("display", F.lit("0..1"))
    kind = prefixed_uri(F.col("range"))
    return attributes.select(
        F.col("owner").alias("class"), field_name(name).alias("field"), F.col("uri").alias("rdf_term"), range_type(kind).alias("type"), is_list(card).alias("is_list"), is_optional(card).alias("is_optional"), field_ddl(name, kind, card).alias("ddl")
    )


def class_ddl(fields: DataFrame) -> DataFrame:
    """class, ddl: one schema string for each class, fields in order of their names."""
    return fields.groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", "ddl"))), lambda x: x["ddl"]), ", ").alias("ddl"))


def create_table(fields: DataFrame) -> DataFrame:
    """class, statement: CREATE TABLE for each class."""
    return class_ddl(fields).select("class", F.concat(F.lit("CREATE TABLE `"), last_part(F.col("class"), "/"), F.lit("` ("), "ddl", F.lit(")")).alias("statement"))


def enumeration_constants(triples: DataFrame) -> DataFrame:
    """enumeration, name (upper case), value (the full IRI), comment."""
    rows = ontology.enumeration(triples)
    return rows.select("enumeration", F.upper(F.regexp_replace("label", r"\W+", "_")).alias("name"), F.col("uri").alias("value"), escaped(F.col("description")).alias("comment"))


def class_order(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, level, position (from 1 within its level): by level and position, parents stand before children; nodes on cycles have no level and come last."""
    from pyspark.sql import Window

    rows = graph.levels(nodes, links)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("level").orderBy("node")))


def order_rate(order: DataFrame, links: DataFrame, count: str | None = None) -> DataFrame:
    """One row: the percentage of links whose parent comes before its child, by order (node, position); and how many links there are, as `count`."""
    at = order.select("node", "position")
    rows = links.join(at.select(F.col("node").alias("child"), F.col("position").alias("c")), "child").join(at.select(F.col("node").alias("parent"), F.col("position").alias("p")), "parent")
    rate = F.coalesce(F.round(F.avg((F.col("p") < F.col("c")).cast("double")) * 100, 2), F.lit(100.0)).alias("rate")
    return rows.agg(rate, *([F.count("*").alias(count)] if count else []))


def class_sources(triples: DataFrame, base: str, elements: DataFrame | None = None) -> DataFrame:
    """class, parent (base where it has none), ddl (its own attributes, then the associations that start at it, as IRIs), n_attributes, n_associations, comment."""
    classes = graph.instances(triples, ontology.UCMIS + "Class").withColumnRenamed("s", "class")
    parents = graph.parent_map(ontology.subclass_links(triples)).select(F.col("child").alias("class"), "parent")
    attributes = ontology.attributes(triples, elements)
    attributes = (attributes if elements is not None else attributes.withColumn("display", F.lit(None).cast("string"))).select("owner", "uri", "label", "range", "display", F.lit(0).alias("kind"))
    links = ontology.associations(triples, incoming=False, elements=elements)
    links = links.select("owner", "uri", "label", F.lit("iri").alias("range"), (F.col("from_display") if elements is not None else F.lit(None).cast("string")).alias("display"), F.lit(1).alias("kind"))
    members = attributes.unionByName(links)
    fields = field_registry(members).join(members.select("uri", "kind").distinct().withColumnRenamed("uri", "rdf_term"), "rdf_term")
    ddl = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "field", "ddl"))), lambda x: x["ddl"]), ", ")
    per = fields.groupBy("class").agg(ddl.alias("ddl"), F.count_if(F.col("kind") == 0).alias("n_attributes"), F.count_if(F.col("kind") == 1).alias("n_associations"))
    told = graph.pattern(triples, p=ontology.COMMENT).groupBy(F.col("s").alias("class")).agg(F.min("o").alias("comment"))
    rows = classes.join(parents, "class", "left").join(per, "class", "left").join(told, "class", "left")
    none = F.lit(0).cast("long")
    return rows.select("class", F.coalesce("parent", F.lit(base)).alias("parent"), F.coalesce("ddl", F.lit("")).alias("ddl"), F.coalesce("n_attributes", none).alias("n_attributes"), F.coalesce("n_associations", none).alias("n_associations"), escaped(F.col("comment")).alias("comment"))


def forward_references_fixed(source: DataFrame, known: list[str], column: str = "value") -> DataFrame:
    """Class headers whose parent isn't known yet get a plain base: value, n_fixed."""
    parent = F.regexp_extract(column, r"^class\s+\w+\((\w+)\):", 1)
    fix = (parent != "") & ~parent.isin(*known)
    return source.select(F.when(fix, F.regexp_replace(column, r"\(\w+\):", "(object):")).otherwise(F.col(column)).alias("value"), fix.cast("int").alias("n_fixed"))
