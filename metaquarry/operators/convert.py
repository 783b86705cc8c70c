"""Codebooks to linked resources and triples.

A resource is a row: uri, type, seq (later rows win), non_ddi_id, name, label. An edge is a row: s, assoc, o. Both come
from the codebook tables by plain projections; a run's prefix is one literal, so plans stay deterministic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaquarry.functions.terms import NAMESPACES, RDF_TYPE, code_slug
from metaquarry.operators.codebook import Tables, in_file
from metaquarry.operators.graph import COLUMNS, last_wins, positions

CDI, SKOS = NAMESPACES["cdi"], NAMESPACES["skos"]


@dataclass
class Resources:
    nodes: DataFrame  # uri, type, seq, non_ddi_id, name, label, notation
    edges: DataFrame  # s, assoc, o


def uid(prefix: str, cls: str, *suffix: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), F.lit(cls), *suffix)


def cdi_uri(prefix: str, cls: str, *suffix: Column) -> Column:
    return F.concat(F.lit("urn:ddi-cdi:"), uid(prefix, cls, *suffix))


_NODE = "struct<uri: string, type: string, seq: bigint, non_ddi_id: string, name: string, label: string, notation: string>"
_EDGE = "struct<s: string, assoc: string, o: string>"


def node(uri: Column, cls: str, seq: int, non_ddi_id: Column | None = None, name: Column | None = None, label: Column | None = None, notation: Column | None = None) -> Column:
    text = lambda c, n: (F.lit(None) if c is None else c).cast("string").alias(n)
    return F.struct(uri.alias("uri"), F.lit(cls).alias("type"), F.lit(seq).cast("long").alias("seq"), text(non_ddi_id, "non_ddi_id"), text(name, "name"), text(label, "label"), text(notation, "notation"))


def edge(s: Column, assoc: str, o: Column) -> Column:
    return F.struct(s.alias("s"), F.lit(assoc).alias("assoc"), o.alias("o"))


def _made(rows: DataFrame, cells: list[tuple[Column | None, Column]], kind: str) -> DataFrame:
    """One pass over rows: a row for each cell (condition or none, struct) that holds."""
    kept = [F.when(where, x.cast(kind)) if where is not None else x.cast(kind) for where, x in cells]
    return rows.select(F.explode(F.filter(F.array(*kept), lambda x: x.isNotNull())).alias("x")).select("x.*")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resources(tables: Tables, prefix: str, skos: bool = True, files: list[str] | None = None, types: list[str] | None = None, assocs: list[str] | None = None) -> Resources:
    """All resources of the codebooks, with SKOS concepts or with code lists for the categories; only of some types and kinds of edges if given.

    Each codebook table is passed over once for its nodes and once for its edges, whatever their kinds; what isn't asked
    for is never made, and a table that has nothing to give isn't read."""
    if files:
        raise NotImplementedError("a subset of files")
    var, value, fid = F.col("var_id"), F.col("value"), F.col("file_id")
    instance = cdi_uri(prefix, "InstanceVariable", var)
    v_nodes: list = [(None, node(instance, "InstanceVariable", 1, var, F.col("name"), F.col("label")))]
    c_nodes, v_edges, c_edges = [], [], []
    slug = F.col("slug")
    for missing, word, some in ((False, "Substantive", F.expr("n_categories > n_missing")), (True, "Sentinel", F.expr("n_missing > 0"))):
        domain, member = cdi_uri(prefix, f"{word}ValueDomain", var), F.col("is_missing") == missing
        v_nodes.append((some, node(domain, f"{word}ValueDomain", 2)))
        v_edges.append((some, edge(instance, f"takes{word}Values", domain)))
        if skos:
            scheme = uid(prefix, f"{word}ConceptScheme", var)
            v_nodes.append((some, node(scheme, "skos:ConceptScheme", 3)))
            v_edges.append((some, edge(domain, "takesValuesFrom", scheme)))
            c_edges.append((member, edge(scheme, "skos:hasTopConcept", uid(prefix, "Concept", var, slug))))
        else:
            own = F.concat(var, F.lit("_sentinel" if missing else ""))
            code_list, category_set = cdi_uri(prefix, "CodeList", own), cdi_uri(prefix, "CategorySet", own)
            v_nodes += [(some, node(code_list, "CodeList", 3)), (some, node(category_set, "CategorySet", 4))]
            v_edges += [(some, edge(domain, "takesValuesFrom", code_list)), (some, edge(code_list, "references", category_set))]
            c_edges += [(member, edge(code_list, "has_Code", cdi_uri(prefix, "Code", var, slug))), (member, edge(category_set, "has_Category", cdi_uri(prefix, "Category", var, slug)))]
    shown = F.coalesce("label", "value")
    if skos:
        c_nodes.append((None, node(uid(prefix, "Concept", var, slug), "skos:Concept", 5, None, None, shown, value)))
    else:
        code, notation, category = (cdi_uri(prefix, c, var, slug) for c in ("Code", "Notation", "Category"))
        c_nodes += [(None, node(code, "Code", 5, slug)), (None, node(notation, "Notation", 6, None, None, None, shown)), (None, node(category, "Category", 7, None, shown))]
        c_edges += [(None, edge(code, "usesNotation", notation)), (None, edge(code, "denotes_Category", category)), (None, edge(notation, "represents_Category", category))]
    data_set, record, structure = (cdi_uri(prefix, c, fid) for c in ("DataSet", "LogicalRecord", "DataStructure"))
    f_nodes = [(None, node(u, c, 8, fid)) for u, c in ((data_set, "DataSet"), (record, "LogicalRecord"), (structure, "DataStructure"))]
    f_edges = [(None, edge(record, "organizes_DataSet", data_set)), (None, edge(data_set, "isStructuredBy_DataStructure", structure))]
    component, place = cdi_uri(prefix, "DataStructureComponent", fid, var), cdi_uri(prefix, "ComponentPosition", fid, var)
    h_nodes = [(None, node(component, "DataStructureComponent", 9)), (None, node(place, "ComponentPosition", 10, None, None, None, F.col("position")))]
    h_edges = [
        (None, edge(record, "has_InstanceVariable", instance)), (None, edge(structure, "has_DataStructureComponent", component)), (None, edge(structure, "has_ComponentPosition", place)),
        (None, edge(component, "isDefinedBy_RepresentedVariable", instance)), (None, edge(place, "indexes_DataStructureComponent", component)),
    ]
    v, codes, f = tables.variables, tables.categories.where("value IS NOT NULL").withColumn("slug", code_slug(value)), tables.files
    held = structure_positions(tables)

    def gathered(tables_and_cells: list[tuple[DataFrame, list]], kind: str) -> DataFrame:
        return _all([_made(rows, cells, kind) for rows, cells in tables_and_cells if cells])

    def asked(cells: list, wanted: list[str] | None, names: list[str]) -> list:
        return [c for c, n in zip(cells, names) if wanted is None or n in wanted]

    kinds = ["InstanceVariable", *[k for word in ("Substantive", "Sentinel") for k in ([f"{word}ValueDomain", "skos:ConceptScheme"] if skos else [f"{word}ValueDomain", "CodeList", "CategorySet"])]]
    of_codes = ["skos:Concept"] if skos else ["Code", "Notation", "Category"]
    links = [k for word in ("Substantive", "Sentinel") for k in ([f"takes{word}Values", "takesValuesFrom"] if skos else [f"takes{word}Values", "takesValuesFrom", "references"])]
    of_members = ["skos:hasTopConcept"] * 2 if skos else [*["has_Code", "has_Category"] * 2, "usesNotation", "denotes_Category", "represents_Category"]
    nodes = [
        (v, asked(v_nodes, types, kinds)), (codes, asked(c_nodes, types, of_codes)), (f, asked(f_nodes, types, ["DataSet", "LogicalRecord", "DataStructure"])),
        (held, asked(h_nodes, types, ["DataStructureComponent", "ComponentPosition"])),
    ]
    edges = [
        (v, asked(v_edges, assocs, links)), (codes, asked(c_edges, assocs, of_members)), (f, asked(f_edges, assocs, ["organizes_DataSet", "isStructuredBy_DataStructure"])),
        (held, asked(h_edges, assocs, ["has_InstanceVariable", "has_DataStructureComponent", "has_ComponentPosition", "isDefinedBy_RepresentedVariable", "indexes_DataStructureComponent"])),
    ]
    spark = v.sparkSession
    none_n, none_e = spark.createDataFrame([], _NODE.removeprefix("struct<").removesuffix(">")), spark.createDataFrame([], _EDGE.removeprefix("struct<").removesuffix(">"))
    made_n = gathered(nodes, _NODE) if any(c for _, c in nodes) else none_n
    made_e = gathered(edges, _EDGE) if any(c for _, c in edges) else none_e
    return Resources(last_wins(made_n, ["uri"], ["seq", "type", "name", "label", "notation", "non_ddi_id"]), made_e.distinct())


def structure_positions(tables: Tables, strict: bool = False) -> DataFrame:
    """doc_id, file_id, var_id, position: the variables of each file in document order, from 1."""
    v = tables.variables.select("doc_id", "var_id", "pos", "files")
    if strict:  # any part of the list's text names a file; files are few, so their list goes to the variables
        names = tables.files.groupBy("doc_id").agg(F.collect_set("file_id").alias("ids"))
        rows = v.join(names, "doc_id").withColumn("file_id", F.explode(F.filter("ids", lambda x: F.contains(F.col("files"), x)))).drop("ids")
    else:
        rows = v.withColumn("file_id", F.explode(F.split(F.trim("files"), r"\s+"))).join(tables.files.select("doc_id", "file_id"), ["doc_id", "file_id"], "left_semi")
    rows = rows.withColumn("in_", F.struct("doc_id", "file_id"))
    return positions(rows, "in_", ["pos", "var_id"]).select("doc_id", "file_id", "var_id", "position")


def _iri(name: Column) -> Column:
    return F.when(name.startswith("skos:"), F.concat(F.lit(SKOS), F.substring(name, 6, 1000))).otherwise(F.concat(F.lit(CDI), name))


def triples(found: Resources, authority: str = "local", version: str = "1") -> DataFrame:
    """The resources as a graph: types, names, labels, notations, identifiers and edges. One unpivot of the nodes, and the edges."""
    n = found.nodes
    literal = lambda p, c, kind="string": F.when(c.isNotNull(), F.struct(F.col("uri").alias("s"), F.lit(p).alias("p"), c.alias("o"), F.lit("literal").alias("o_kind"), F.lit(NAMESPACES["xsd"] + kind).alias("o_datatype")))
    is_skos = F.col("type").startswith("skos:")
    identifier = F.concat(F.col("uri"), F.lit("#identifier"))
    rows = n.select(F.explode(F.filter(F.array(
        F.struct(F.col("uri").alias("s"), F.lit(RDF_TYPE).alias("p"), _iri(F.col("type")).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype")),
        literal(CDI + "name", F.when(~is_skos, F.col("name"))),
        literal(CDI + "displayLabel", F.when(~is_skos, F.col("label"))),
        literal(SKOS + "prefLabel", F.when(is_skos, F.col("label"))),
        literal(SKOS + "notation", F.when(is_skos, F.col("notation"))),
        literal(CDI + "content", F.when(F.col("type") == "Notation", F.col("notation"))),
        literal(CDI + "value", F.when(F.col("type") == "ComponentPosition", F.col("notation")), "integer"),
        literal(CDI + "nonDdiIdentifier", F.col("non_ddi_id")),
    ), lambda x: x.isNotNull())).alias("t")).select("t.*")
    owned = n.where(~is_skos)
    ids = owned.select(F.explode(F.array(
        F.struct(F.col("uri").alias("s"), F.lit(CDI + "identifier").alias("p"), identifier.alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype")),
        F.struct(identifier.alias("s"), F.lit(RDF_TYPE).alias("p"), F.lit(CDI + "InternationalRegistrationDataIdentifier").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype")),
        F.struct(identifier.alias("s"), F.lit(CDI + "dataIdentifier").alias("p"), F.regexp_replace("uri", "^urn:ddi-cdi:", "").alias("o"), F.lit("literal").alias("o_kind"), F.lit(NAMESPACES["xsd"] + "string").alias("o_datatype")),
        F.struct(identifier.alias("s"), F.lit(CDI + "registrationAuthorityIdentifier").alias("p"), F.lit(authority).alias("o"), F.lit("literal").alias("o_kind"), F.lit(NAMESPACES["xsd"] + "string").alias("o_datatype")),
        F.struct(identifier.alias("s"), F.lit(CDI + "versionIdentifier").alias("p"), F.lit(version).alias("o"), F.lit("literal").alias("o_kind"), F.lit(NAMESPACES["xsd"] + "string").alias("o_datatype")),
    )).alias("t")).select("t.*")
    links = found.edges.select("s", _iri(F.col("assoc")).alias("p"), "o", F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))
    return rows.unionByName(ids).unionByName(links).withColumn("o_lang", F.lit(None).cast("string")).dropDuplicates(list(COLUMNS))


def unpivoted(rows: DataFrame, uri: Column, cls: str, literals: dict[str, Column], links: dict[str, Column] | None = None) -> DataFrame:
    """Triples of any table: one pass that makes a row for the type, each literal and each link that isn't null.

    A row is numbered cells first, whose terms come after: a filter on predicates or columns left out then spare their work."""
    cells = [(RDF_TYPE, F.lit(cls), "iri"), *[(p, c, "literal") for p, c in literals.items()], *[(p, c, "iri") for p, c in (links or {}).items()]]
    cell = "_" + max(rows.columns, key=len, default="")  # longer than any other name
    of = lambda at: F.coalesce(*[F.when(F.col(cell) == i, c) for i, c in enumerate(at)])
    out = rows.withColumn(cell, F.explode(F.array(*[F.lit(i) for i in range(len(cells))])))
    out = out.select(uri.alias("s"), of([F.lit(p) for p, _, _ in cells]).alias("p"), of([c.cast("string") for _, c, _ in cells]).alias("o"), of([F.lit(kind) for _, _, kind in cells]).alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    return out.where("o IS NOT NULL")


def inserted(rows: DataFrame, classes: list[str]) -> DataFrame:
    """rows (seq, type, uri, ...) with `problem`: no uri, unknown type, or replaced by a later row of one uri; null for those that stay."""
    bad = F.when(F.col("uri").isNull(), "no uri").when(F.col("type").isNull() | ~F.col("type").isin(classes), "unknown type")
    rows = rows.withColumn("problem", bad)
    last = rows.where("problem IS NULL").groupBy(F.col("uri").alias("of_")).agg(F.max("seq").alias("last_"))
    return rows.join(last, F.expr("uri = of_"), "left").withColumn("problem", F.coalesce("problem", F.when(F.col("seq") < F.col("last_"), "replaced"))).drop("of_", "last_")


def name_nodes(rows: DataFrame) -> DataFrame:
    """Triples of structured names and labels of resources (uri, name, label): an ObjectName, and a LabelForDisplay with one LanguageString."""
    iri = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))
    text = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("literal").alias("o_kind"), F.lit(NAMESPACES["xsd"] + "string").alias("o_datatype"))
    at = lambda part: F.concat(F.col("uri"), F.lit(f"#{part}"))
    cls = lambda c: F.lit(CDI + c)
    name, label, content = at("name"), at("displayLabel"), at("displayLabel-text")
    names = F.when(F.col("name").isNotNull(), F.array(iri(F.col("uri"), CDI + "name", name), iri(name, RDF_TYPE, cls("ObjectName")), text(name, CDI + "name", F.col("name"))))
    labels = F.when(F.col("label").isNotNull(), F.array(
        iri(F.col("uri"), CDI + "displayLabel", label), iri(label, RDF_TYPE, cls("LabelForDisplay")), iri(label, CDI + "languageSpecificString", content), iri(content, RDF_TYPE, cls("LanguageString")), text(content, CDI + "content", F.col("label")),
    ))
    out = rows.select(F.explode(F.flatten(F.filter(F.array(names, labels), lambda x: x.isNotNull()))).alias("t")).select("t.*")
    return out.withColumn("o_lang", F.lit(None).cast("string"))


def variables_in(tables: Tables, file_id: str, strict: bool = False) -> DataFrame:
    return tables.variables.where(in_file(F.col("files"), file_id, strict))
