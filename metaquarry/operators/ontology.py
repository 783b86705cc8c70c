"""What an ontology says about its classes: attributes, associations, enumerations, cardinalities, and what is inherited.

Each answer is one plan over the triples and the schema's element table, for one resource or for all at once; nothing
is asked row by row. Elements: class (of the complex type), element, min, max, types (array of valid class names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaquarry.functions.terms import NAMESPACES, RDF_TYPE, cardinality, first_part, last_part, one_line
from metaquarry.operators import graph

RDFS = NAMESPACES["rdfs"]
LABEL, COMMENT, DOMAIN, RANGE, SUBCLASS = (RDFS + x for x in ("label", "comment", "domain", "range", "subClassOf"))
UCMIS = NAMESPACES["ucmis"]
KINDS = ("Attribute", "Association", "Class", "Enumeration", "StructuredDataType")
ELEMENTS = "class string, element string, min string, max string, types array<string>"


def of_kind(triples: DataFrame, kind: str) -> DataFrame:
    """All resources of a kind (Attribute, Association, Class, Enumeration, StructuredDataType), in order."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    return graph.instances(triples, UCMIS + kind).orderBy("s")


def model_statistics(triples: DataFrame) -> DataFrame:
    """One row: how many resources there are of each kind."""
    rows = graph.pattern(triples, p=RDF_TYPE)
    return rows.agg(*[F.count_if(F.col("o") == UCMIS + k).alias(f"n_{k.lower()}") for k in KINDS])


def subclass_links(triples: DataFrame) -> DataFrame:
    return graph.edges(triples, SUBCLASS)


def _described(triples: DataFrame, kind: str, side: str) -> DataFrame:
    """Resources of a kind with the resource they belong to (owner), their label, range, domain and description: one grouping of their triples."""
    wanted = [LABEL, COMMENT, DOMAIN, RANGE, RDF_TYPE]
    value = lambda p: F.max(F.when(F.col("p") == p, F.col("o")))
    rows = triples.where(F.col("p").isin(wanted)).groupBy("s").agg(
        F.max(F.when((F.col("p") == RDF_TYPE) & (F.col("o") == UCMIS + kind), True)).alias("is_kind"),
        value(LABEL).alias("label"),
        value(RANGE).alias("range"),
        value(DOMAIN).alias("domain"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("p") == COMMENT, F.col("o")))), "\n").alias("description"),
    )
    owner = F.col("domain") if side == "domain" else F.col("range")
    return rows.where(F.col("is_kind") & owner.isNotNull()).select(F.col("s").alias("uri"), owner.alias("owner"), "label", "domain", "range", one_line(F.col("description")).alias("description"))


def with_cardinality(rows: DataFrame, elements: DataFrame, name: Column) -> DataFrame:
    """rows with min, max and display of the schema element of that name in the class that the name begins with."""
    keyed = rows.withColumn("element", name).withColumn("class", first_part(F.col("element"), "-"))
    cards = elements.groupBy("class", "element").agg(F.min_by("min", "min").alias("min"), F.max_by("max", "min").alias("max"))
    return keyed.join(cards, ["class", "element"], "left").withColumn("display", cardinality(F.col("min"), F.col("max"))).drop("class", "element")


def inherited(own: DataFrame, links: DataFrame) -> DataFrame:
    """own (uri, owner, ...) with what each owner gets from its ancestors: inherited, inherited_from. An own entry wins, then the nearest ancestor's."""
    up = graph.closure(links)
    from_above = own.join(up.select(F.col("ancestor").alias("owner"), "child", "depth"), "owner").select("uri", F.col("child").alias("for"), *[c for c in own.columns if c not in ("uri", "owner")], F.col("owner").alias("inherited_from"), "depth")
    mine = own.withColumnRenamed("owner", "for").withColumn("inherited_from", F.lit(None).cast("string")).withColumn("depth", F.lit(0))
    rows = graph.first_wins(mine.unionByName(from_above), ["for", "uri"], ["depth", "inherited_from"])
    return rows.withColumnRenamed("for", "owner").withColumn("inherited", F.col("depth") > 0).drop("depth")


def attributes(triples: DataFrame, elements: DataFrame | None = None, owner: str | None = None, side: str = "domain", with_inherited: bool = False) -> DataFrame:
    """Attributes by the class that is their domain (or range): uri, owner, label, range, description, and min, max and display if elements are given."""
    rows = _described(triples, "Attribute", side)
    if with_inherited:
        rows = inherited(rows, subclass_links(triples))
    if elements is not None:
        rows = with_cardinality(rows, elements, last_part(F.col("uri"), "/"))
    return rows if owner is None else rows.where(F.col("owner") == owner)


def associations(triples: DataFrame, owner: str | None = None, outgoing: bool = True, incoming: bool = True, elements: DataFrame | None = None, with_inherited: bool = False) -> DataFrame:
    """Associations from and to classes: uri, owner, direction (from, to), label, domain, range, description. One that a class has with itself is there in both directions."""
    sides = [x for x, wanted in (("domain", outgoing), ("range", incoming)) if wanted]
    if not sides:
        raise ValueError("outgoing, incoming or both")
    out = None
    for side in sides:
        rows = _described(triples, "Association", side)
        if with_inherited:
            rows = inherited(rows, subclass_links(triples))
        rows = rows.withColumn("direction", F.lit("from" if side == "domain" else "to"))
        out = rows if out is None else out.unionByName(rows)
    if elements is not None:
        out = with_association_cardinalities(out, elements)
    return out if owner is None else out.where(F.col("owner") == owner)


def with_association_cardinalities(rows: DataFrame, elements: DataFrame) -> DataFrame:
    """rows (uri) with from_display, to_display and to_types: the element of the association, and the one of its valid types."""
    name = last_part(F.regexp_replace("uri", "^.*[/:#]", ""), ":")
    slim = elements.select("class", "element", cardinality(F.col("min"), F.col("max")).alias("display"), "types")
    rows = rows.withColumn("name_", name).withColumn("class_", first_part(F.col("name_"), "_"))
    first = slim.select(F.col("class").alias("class_"), F.col("element").alias("name_"), F.col("display").alias("from_display"))
    second = slim.select(F.regexp_replace("element", "-validType$", "").alias("name_"), F.col("display").alias("to_display"), F.col("types").alias("to_types"), "element").where("element LIKE '%-validType'").drop("element")
    return rows.join(first, ["class_", "name_"], "left").join(second, "name_", "left").drop("class_", "name_")


def enumeration(triples: DataFrame, uri: str | None = None) -> DataFrame:
    """Members of one enumeration, or of all: enumeration, label, uri, description. Of members with one label the last uri stays."""
    enums = graph.instances(triples, UCMIS + "Enumeration").withColumnRenamed("s", "enumeration") if uri is None else None
    members = graph.pattern(triples, p=RDF_TYPE, o=uri).select("s", F.col("o").alias("enumeration"))
    if enums is not None:
        members = members.join(enums, "enumeration", "left_semi")
    told = triples.where(F.col("p").isin(LABEL, COMMENT)).groupBy("s").agg(
        F.min(F.when(F.col("p") == LABEL, F.col("o"))).alias("label"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("p") == COMMENT, F.col("o")))), "\n").alias("description"),
    )
    rows = members.join(told, "s", "left").select("enumeration", "label", F.col("s").alias("uri"), one_line(F.col("description")).alias("description"))
    return graph.last_wins(rows, ["enumeration", "label"], ["uri"])


def categorised(classes: DataFrame, category: Column) -> DataFrame:
    """Classes by category: n, and their names in order."""
    return classes.groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("class")).alias("classes"))
