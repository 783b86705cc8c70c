"""All named queries and the SQL they are compared with. Each runs an operator of the package over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.functions import terms
from metaquarry.functions.terms import RDF_TYPE
from metaquarry.operators import codebook, convert, graph, objects, ontology, schemas
from metaquarry.operators.convert import unpivoted
from metaquarry.operators.objects import Class, Field, Registry
from metaquarry.operators.sparql import select
from metaquarry.plans.bindings import LINKS, TRIPLES, VARIABLES, iri, links, table, triples
from metaquarry.plans.bindings import codebook as book
from metaquarry.sources import rdf
from metaquarry.sources.xml import mixed_content

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


# codebooks


@query(with_(VARIABLES, "SELECT var_id, name, label, n_categories, has_question FROM v"))
def data_dictionary(spark, d):
    return codebook.data_dictionary(book(spark, d)).select("var_id", "name", "label", "n_categories", "has_question")


@query(with_(VARIABLES, "SELECT var_id, name FROM v WHERE regexp_matches(name, '^(?:[a-p].*[ #][a-z0-9]*1?)', 'i')"))
def dictionary_name_regex(spark, d):
    return codebook.data_dictionary(book(spark, d), name="[A-P].*[ #][a-z0-9]*1?").select("var_id", "name")


@query(with_(VARIABLES, "SELECT var_id, label FROM v WHERE regexp_matches(label, '^(?:[a-m]+)', 'i')"))
def dictionary_label_regex(spark, d):
    return codebook.data_dictionary(book(spark, d), label="[a-m]+").select("var_id", "label")


@query(with_(VARIABLES, "SELECT var_id FROM v WHERE list_contains(string_split(files, ' '), 'F1')"))
def dictionary_file_filter(spark, d):
    return codebook.data_dictionary(book(spark, d), file_id="F1").select("var_id")


@query(with_(VARIABLES, "SELECT var_id FROM v WHERE contains(files, 'F1')"))
def dictionary_file_substring(spark, d):
    return codebook.search(book(spark, d).variables, file_id="F1", strict=True).select("var_id")


@query("SELECT 'V' || l_partkey AS var_id, string_agg(l_linenumber || '=' || l_returnflag, ',' ORDER BY l_orderkey, l_linenumber, l_shipdate, l_returnflag) AS categories FROM lineitem GROUP BY 1")
def dictionary_categories(spark, d):
    rows = codebook.category_lists(book(spark, d).categories)
    return rows.select("var_id", F.array_join(F.transform("categories", lambda c: F.concat_ws("=", c["value"], c["label"])), ",").alias("categories"))


@query("""SELECT 'V' || conv_id AS var_id, arg_min(text, (role, text)) FILTER (turn = 0) AS pre, arg_min(text, (role, text)) FILTER (turn = 1) AS literal,
 arg_min(text, (role, text)) FILTER (turn = 2) AS post, arg_min(text, (role, text)) FILTER (turn = 3) AS instructions FROM conversations GROUP BY conv_id""")
def dictionary_questions(spark, d):
    return book(spark, d).questions.select("var_id", "pre", "literal", "post", "instructions")


@query("SELECT 'V' || l_partkey AS var_id, count(*) AS n_categories, count(*) FILTER (l_linestatus = 'O') AS n_missing, count(*) FILTER (l_linestatus <> 'O') AS n_non_missing FROM lineitem GROUP BY 1")
def category_counts(spark, d):
    return codebook.category_counts(book(spark, d).categories, ["var_id"])


@query("SELECT 'F' || s_suppkey AS file_id, s_name || '.dat' AS name, s_name AS basename FROM supplier")
def file_listing(spark, d):
    return book(spark, d).files.select("file_id", "name", terms.base_name(F.col("name")).alias("basename"))


@query("SELECT page_id, regexp_replace(url, '([^/.])\\.[^./]*$', '\\1') AS base FROM pages")
def page_base_names(spark, d):
    return table(spark, d, "pages").select("page_id", terms.base_name(F.col("url")).alias("base"))


@query("SELECT source AS doc_id, arg_min(text, doc_id) AS title, arg_max(text, doc_id) AS alt_title FROM documents GROUP BY source")
def titles(spark, d):
    return book(spark, d).documents.select("doc_id", "title", "alt_title")


@query(with_(VARIABLES, "SELECT var_id FROM v WHERE regexp_matches(name, '^(?:[a-r])', 'i') AND n_categories > 0 AND has_question"))
def search_variables(spark, d):
    return codebook.search(book(spark, d).variables, name="[a-r]", has_categories=True, has_question=True).select("var_id")


@query("SELECT coalesce(p_brand, 'unknown') AS type, count(*) AS n FROM part GROUP BY 1")
def type_distribution(spark, d):
    return codebook.type_distribution(book(spark, d).variables)


@query("""SELECT 'D' AS doc_id, (SELECT count(*) FROM supplier) AS n_files, (SELECT count(*) FROM part) AS n_variables, (SELECT count(*) FROM lineitem) AS n_categories, (SELECT count(DISTINCT conv_id) FROM conversations) AS n_questions""")
def codebook_report(spark, d):
    b = book(spark, d)
    b.documents = spark.range(1).select(F.lit("D").alias("doc_id"), F.lit(None).cast("string").alias("title"))
    return codebook.report(b).drop("title")


@query("SELECT page_id, regexp_replace('{http://x}' || url, '^[^}]*\\}', '') AS name FROM pages")
def local_name(spark, d):
    return table(spark, d, "pages").select("page_id", terms.local_tag(F.concat(F.lit("{http://x}"), "url")).alias("name"))


@query("SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM pages")
def mixed_content_strip(spark, d):
    return table(spark, d, "pages").select("page_id", terms.without_tags(F.col("html")).alias("text"))


@query("SELECT item_id, '<b>' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || '</b>end' AS flat FROM benchmark")
def mixed_content_flat(spark, d):
    fragment = F.concat(F.lit("<a> <b>"), terms.xml_escaped(F.col("text")), F.lit("</b> end </a>"))
    return table(spark, d, "benchmark").select("item_id", mixed_content(fragment).alias("flat"))


# graphs


@query(with_(TRIPLES, f"SELECT DISTINCT s FROM t WHERE p = '{RDF_TYPE}' AND o = 'Supplier'"))
def type_scan(spark, d):
    return graph.instances(triples(spark, d), "Supplier")


@query(with_(TRIPLES, f"SELECT DISTINCT o AS type FROM t WHERE p = '{RDF_TYPE}'"))
def classes_distinct(spark, d):
    return graph.types(triples(spark, d))


@query("SELECT count(*) AS n FROM supplier")
def class_frequency(spark, d):
    return graph.count_instances(triples(spark, d), "Supplier")


@query(with_(TRIPLES, f"SELECT o AS class, count(*) AS n FROM t WHERE p = '{RDF_TYPE}' GROUP BY 1"))
def class_frequency_all(spark, d):
    return graph.class_counts(triples(spark, d))


@query(with_(TRIPLES, f"SELECT o AS class, count(*) AS n FROM t WHERE p = '{RDF_TYPE}' AND o IN ('Nation', 'Customer', 'Nothing') GROUP BY 1"))
def class_frequency_of(spark, d):
    names = spark.createDataFrame([("Nation",), ("Customer",), ("Nothing",)], "class string")
    return graph.class_counts(triples(spark, d), names)


@query(with_(TRIPLES, f"SELECT s FROM t WHERE p = 'in' AND o = 'nation/3' AND s IN (SELECT s FROM t WHERE p = '{RDF_TYPE}' AND o = 'Customer')"))
def typed_with_property(spark, d):
    return graph.typed_with(triples(spark, d), "Customer", "in", "nation/3")


@query(with_(TRIPLES, "SELECT s, p, string_agg(DISTINCT o, '|' ORDER BY o) AS joined, CASE WHEN count(DISTINCT o) = 1 THEN min(o) END AS value FROM t WHERE p <> 'name' GROUP BY s, p").replace(f"'{RDF_TYPE}'", "'rdf:type'"))
def resource_properties(spark, d):
    rows = graph.properties(triples(spark, d).where("p <> 'name'"))
    return rows.select("s", "p", F.array_join("values", "|").alias("joined"), "value")


@query("SELECT 'customer/' || c_custkey AS s, 'order/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def optional_property(spark, d):
    facts = unpivoted(table(spark, d, "orders"), iri("customer", "o_custkey"), "Buyer", {}, {"placed": iri("order", "o_orderkey")})
    return graph.optional(graph.instances(triples(spark, d), "Customer"), "s", facts, "placed", "o")


@query("SELECT 'customer/' || c_custkey AS s FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def without_property(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", iri("order", "o_orderkey"))
    facts = unpivoted(table(spark, d, "orders"), iri("customer", "o_custkey"), "Buyer", {}, {"finished": status})
    return graph.without(graph.instances(triples(spark, d), "Customer"), "s", facts, "finished")


@query(with_(TRIPLES, "SELECT a.s AS start, c.o AS \"end\" FROM t a JOIN t b ON a.o = b.s JOIN t c ON b.o = c.s WHERE a.p = 'in' AND b.p = 'in' AND c.p = 'name'"))
def three_hop_path(spark, d):
    return graph.path(triples(spark, d), ["in", "in", "name"])


@query("WITH RECURSIVE " + LINKS + ", reach AS (SELECT child AS node FROM links WHERE parent = 'region/1' UNION SELECT l.child FROM links l JOIN reach r ON l.parent = r.node) SELECT node FROM reach")
def subclasses(spark, d):
    return graph.descendants(links(spark, d), "region/1")


@query("WITH RECURSIVE " + LINKS + ", reach AS (SELECT parent AS node FROM links WHERE child = 'customer/7' UNION SELECT l.parent FROM links l JOIN reach r ON l.child = r.node) SELECT node FROM reach")
def superclasses(spark, d):
    return graph.ancestors(links(spark, d), "customer/7")


@query("WITH RECURSIVE " + LINKS + ", reach AS (SELECT child, parent AS ancestor, 1 AS depth FROM links UNION ALL SELECT r.child, l.parent, r.depth + 1 FROM links l JOIN reach r ON l.child = r.ancestor) SELECT child, ancestor, min(depth) AS depth FROM reach GROUP BY 1, 2")
def hierarchy_closure(spark, d):
    return graph.closure(links(spark, d))


@query(with_(LINKS, "SELECT child, max(parent) AS parent FROM links GROUP BY child"))
def subclass_of_map(spark, d):
    return graph.parent_map(links(spark, d))


@query(with_(TRIPLES, f"SELECT s FROM t WHERE p = '{RDF_TYPE}' AND o = 'Region' AND s NOT IN (SELECT s FROM t WHERE p = 'in')"))
def top_classes(spark, d):
    return graph.roots(triples(spark, d), "Region", "in")


@query(with_(TRIPLES, f"SELECT DISTINCT s FROM t WHERE p = '{RDF_TYPE}' AND o = 'Customer' AND regexp_matches(s, '/1.*5', 'i')"))
def search_classes(spark, d):
    return graph.search(triples(spark, d), "Customer", "/1.*5")


@query(with_(TRIPLES, "SELECT s, o AS label FROM t WHERE p = 'name' AND contains(lower(o), 'er#0')"))
def label_contains(spark, d):
    return graph.labelled(triples(spark, d), "name", "ER#0")


@query("WITH RECURSIVE " + LINKS + """, deep AS (SELECT DISTINCT s AS node, 0 AS level FROM t WHERE p = '""" + RDF_TYPE + """' UNION ALL SELECT l.child, r.level + 1 FROM links l JOIN deep r ON l.parent = r.node)
 SELECT node, max(level) AS level FROM deep GROUP BY node""")
def topological_levels(spark, d):
    nodes = graph.subjects(triples(spark, d)).withColumnRenamed("s", "node")
    return graph.levels(nodes, links(spark, d))


@query(with_(LINKS, "SELECT round(avg(CASE WHEN child > parent THEN 1.0 ELSE 0 END) * 100, 2)::DOUBLE AS rate FROM links"))
def order_rate(spark, d):
    """Of the order by name, which puts some parents last."""
    some = links(spark, d)
    nodes = some.select(F.col("child").alias("node")).union(some.select("parent")).distinct()
    return schemas.order_rate(nodes.withColumn("position", F.col("node")), some)


@query("WITH RECURSIVE " + LINKS + """, deep AS (SELECT DISTINCT s AS node, 0 AS level FROM t WHERE p = '""" + RDF_TYPE + """' UNION ALL SELECT l.child, r.level + 1 FROM links l JOIN deep r ON l.parent = r.node),
 o AS (SELECT node, max(level) AS level FROM deep GROUP BY node) SELECT round(avg(CASE WHEN p.level < c.level THEN 1.0 ELSE 0 END) * 100, 2)::DOUBLE AS rate, count(*) AS n_links FROM links JOIN o c ON c.node = child JOIN o p ON p.node = parent""")
def topological_rate(spark, d):
    some = links(spark, d)
    nodes = some.select(F.col("child").alias("node")).union(some.select("parent")).distinct()
    order = graph.levels(nodes, some).withColumn("position", F.struct("level", "node"))
    return schemas.order_rate(order, some, count="n_links")


@query("WITH RECURSIVE " + LINKS + """, deep AS (SELECT DISTINCT s AS node, 0 AS level FROM t WHERE p = '""" + RDF_TYPE + """' UNION ALL SELECT l.child, r.level + 1 FROM links l JOIN deep r ON l.parent = r.node),
 o AS (SELECT node, max(level) AS level FROM deep GROUP BY node) SELECT node, level, row_number() OVER (PARTITION BY level ORDER BY node) AS position FROM o""")
def class_order(spark, d):
    nodes = graph.subjects(triples(spark, d)).withColumnRenamed("s", "node")
    return schemas.class_order(links(spark, d), nodes)


@query(with_(TRIPLES, f"""SELECT 'triples' AS kind, '' AS name, count(*) AS n FROM t UNION ALL SELECT 'property', p, count(*) FROM t GROUP BY p UNION ALL SELECT 'type', o, count(*) FROM t WHERE p = '{RDF_TYPE}' GROUP BY o"""))
def graph_statistics(spark, d):
    return graph.statistics(triples(spark, d))


@query(with_(TRIPLES, "SELECT DISTINCT s, p, o FROM t"))
def graph_union_dedup(spark, d):
    t = triples(spark, d)
    return graph.union(t, t.where("p <> 'in'")).select("s", "p", "o")


@query(with_(TRIPLES, "SELECT s, p, o, k AS o_kind FROM t"))
def resources_to_triples(spark, d):
    return triples(spark, d).select("s", "p", "o", "o_kind")


@query(with_(TRIPLES, """SELECT '<' || s || '> <' || p || '> ' || CASE k WHEN 'iri' THEN '<' || o || '>' ELSE '"' || o || '"' END || ' .' AS value FROM t"""))
def ntriples_serialize(spark, d):
    return rdf.ntriples(triples(spark, d))


@query(with_(TRIPLES, "SELECT s, p, o, k AS o_kind FROM t"))
def ntriples_round_trip(spark, d):
    return rdf.parse_ntriples(rdf.ntriples(triples(spark, d))).select("s", "p", "o", "o_kind")


@query(with_(TRIPLES, "SELECT s, p, o, k AS o_kind FROM t"))
def jsonld_round_trip(spark, d):
    lines = rdf.jsonld(triples(spark, d)).select(F.concat(F.lit("["), "value", F.lit("]")).alias("value"))
    return rdf.parse_jsonld(lines).select("s", "p", "o", "o_kind")


@query(with_(TRIPLES, "SELECT 'x:' || s AS s, CASE p WHEN 'in' THEN 'x:in' WHEN 'name' THEN 'x:name' WHEN 'segment' THEN 'x:segment' ELSE p END AS p, CASE k WHEN 'iri' THEN 'x:' || o ELSE o END AS o FROM t"))
def turtle_round_trip(spark, d):
    return rdf.parse_turtle(rdf.turtle(full_triples(spark, d))).select("s", "p", "o")


@query(with_(TRIPLES, "SELECT 'x:' || s AS s, CASE p WHEN 'in' THEN 'x:in' WHEN 'name' THEN 'x:name' WHEN 'segment' THEN 'x:segment' ELSE p END AS p, CASE k WHEN 'iri' THEN 'x:' || o ELSE o END AS o, k AS o_kind FROM t"))
def rdf_xml_round_trip(spark, d):
    return rdf.parse_rdf_xml(rdf.rdf_xml(full_triples(spark, d))).select("s", "p", "o", "o_kind")


@query(with_(TRIPLES, "SELECT 'http://x.org/a/' || s AS s, 'http://x.org/a/' || o AS o FROM t WHERE p = 'in'"))
def turtle_base(spark, d):
    """References in the light of a base whose last part is a file."""
    texts = links(spark, d).select(F.concat(F.lit("@base <http://x.org/a/b> . <"), "child", F.lit("> <p> <"), "parent", F.lit("> .")).alias("value"))
    return rdf.parse_turtle(texts).select("s", "o")


@query("SELECT 'http://x.org/' || n_nationkey AS s, 'http://v.org/' || CASE k WHEN 1 THEN 'name' ELSE 'in' END AS p, CASE k WHEN 1 THEN n_name ELSE 'http://r.org/' || n_regionkey END AS o, CASE k WHEN 1 THEN 'literal' ELSE 'iri' END AS o_kind FROM nation, (SELECT unnest([1, 2]) AS k)")
def jsonld_context(spark, d):
    """Compact documents: prefixes, a typed term, a base."""
    context = '{"@base": "http://x.org/", "v": "http://v.org/", "r": "http://r.org/", "name": "v:name", "lies": {"@id": "v:in", "@type": "@id"}}'
    nodes = table(spark, d, "nation").select(F.concat(F.lit('{"@context": ' + context + ', "@id": "'), F.col("n_nationkey").cast("string"), F.lit('", "name": "'), "n_name", F.lit('", "lies": "r:'), F.col("n_regionkey").cast("string"), F.lit('"}')).alias("value"))
    return rdf.parse_jsonld(nodes).select("s", "p", "o", "o_kind")


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def ntriples_escapes(spark, d):
    """Whole texts as literals, each line with a comment at its end, and back."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("s"), F.lit("text").alias("p"), F.col("text").alias("o"), F.lit("literal").alias("o_kind"), *[F.lit(None).cast("string").alias(c) for c in ("o_datatype", "o_lang")])
    lines = rdf.ntriples(rows).select(F.concat("value", F.lit(" # a note")).alias("value"))
    return rdf.parse_ntriples(lines).select(F.col("s").cast("long").alias("doc_id"), F.col("o").alias("text"))


@query("SELECT '<' || url || '> <p> ' || page_id AS value, 'not a triple' AS reason FROM pages")
def ntriples_rejects(spark, d):
    pages = table(spark, d, "pages")
    bad = pages.select(F.concat(F.lit("<"), "url", F.lit("> <p> "), F.col("page_id").cast("string")).alias("value"))
    return rdf.ntriples_rejects(bad.unionByName(rdf.ntriples(triples(spark, d))).unionByName(spark.createDataFrame([("# note",), ("",)], "value string")))


def full_triples(spark, d):
    """The triples with absolute IRIs."""
    full = lambda c: F.concat(F.lit("x:"), c)
    t = triples(spark, d)
    return t.withColumn("s", full("s")).withColumn("p", F.when(F.col("p") == RDF_TYPE, F.col("p")).otherwise(full("p"))).withColumn("o", F.when(F.col("o_kind") == "iri", full("o")).otherwise(F.col("o")))


# a query language for graphs


@query(with_(TRIPLES, f"SELECT n.o AS name, count(*) AS n FROM t c JOIN t i ON c.s = i.s JOIN t n ON i.o = n.s WHERE c.p = '{RDF_TYPE}' AND c.o = 'Customer' AND i.p = 'in' AND n.p = 'name' GROUP BY 1"))
def sparql_group_count(spark, d):
    return select(triples(spark, d), "SELECT ?name (COUNT(?c) AS ?n) WHERE { ?c a <Customer> ; <in> ?x . ?x <name> ?name } GROUP BY ?name ORDER BY DESC(?n)")


@query(with_(TRIPLES, f"SELECT DISTINCT a.s AS x FROM t a WHERE a.p = '{RDF_TYPE}' AND regexp_matches(a.s, '^SUPP', 'i') AND a.s <> 'supplier/1'"))
def sparql_filter(spark, d):
    return select(triples(spark, d), 'SELECT DISTINCT ?x WHERE { ?x a ?type . FILTER regex(str(?x), "^SUPP", "i") FILTER(?x != <supplier/1>) }')


@query(with_(TRIPLES, f"SELECT a.s AS x, b.o AS place FROM t a LEFT JOIN t b ON a.s = b.s AND b.p = 'in' WHERE a.p = '{RDF_TYPE}' "))
def sparql_optional(spark, d):
    return select(triples(spark, d), "SELECT ?x ?place WHERE { ?x a ?t . OPTIONAL { ?x <in> ?place } }")


@query(with_(TRIPLES, f"SELECT s AS x FROM t WHERE p = '{RDF_TYPE}' AND s NOT IN (SELECT s FROM t WHERE p = 'in')"))
def sparql_not_exists(spark, d):
    return select(triples(spark, d), "SELECT ?x WHERE { ?x a ?t . FILTER NOT EXISTS { ?x <in> ?any } } ORDER BY ?x")


@query("WITH RECURSIVE " + LINKS + ", reach AS (SELECT 'nation/5' AS x UNION SELECT l.child FROM links l JOIN reach r ON l.parent = r.x) SELECT x FROM reach")
def sparql_path(spark, d):
    return select(triples(spark, d), "SELECT DISTINCT ?x WHERE { ?x <in>* <nation/5> }")


# ontologies: nations are classes under their regions, segments and priorities what is told of them

_ONTOLOGY = f"""rows AS (SELECT 'nation/' || c_nationkey AS owner, 'attr/' || c_custkey AS uri, c_name AS label, c_mktsegment AS "range" FROM customer)"""


def model(spark, d):
    """Customers as attributes of nations, suppliers as associations from nations to regions, regions as enumerations of their nations."""
    u, rdfs = terms.NAMESPACES["ucmis"], terms.NAMESPACES["rdfs"]
    t = lambda n: table(spark, d, n)
    parts = [
        unpivoted(t("customer"), iri("attr", "c_custkey"), u + "Attribute", {rdfs + "label": F.col("c_name")}, {rdfs + "domain": iri("nation", "c_nationkey"), rdfs + "range": F.col("c_mktsegment")}),
        unpivoted(t("supplier").join(t("nation"), F.expr("s_nationkey = n_nationkey")), iri("assoc", "s_suppkey"), u + "Association", {rdfs + "label": F.col("s_name")}, {rdfs + "domain": iri("nation", "s_nationkey"), rdfs + "range": iri("region", "n_regionkey")}),
        unpivoted(t("nation"), iri("nation", "n_nationkey"), u + "Class", {rdfs + "label": F.col("n_name")}, {rdfs + "subClassOf": iri("region", "n_regionkey")}),
        unpivoted(t("region"), iri("region", "r_regionkey"), u + "Class", {rdfs + "label": F.col("r_name")}),
        unpivoted(t("region"), iri("enum", "r_regionkey"), u + "Enumeration", {rdfs + "label": F.col("r_name")}),
        *[unpivoted(t("nation").where(F.col("n_regionkey") == k), iri("member", "n_nationkey"), f"enum/{k}", {rdfs + "label": F.col("n_name"), rdfs + "comment": F.concat(F.lit(" first\nof "), "n_name")}) for k in range(5)],
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT count(*) AS n_attribute, (SELECT count(*) FROM supplier) AS n_association, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n_class, (SELECT count(*) FROM region) AS n_enumeration, 0 AS n_structureddatatype FROM customer")
def model_statistics(spark, d):
    return ontology.model_statistics(model(spark, d))


@query("SELECT 'nation/' || n_nationkey AS s FROM nation UNION ALL SELECT 'region/' || r_regionkey FROM region")
def ontology_classes(spark, d):
    return ontology.of_kind(model(spark, d), "Class")


@query(with_(_ONTOLOGY, "SELECT uri, owner, label, \"range\" FROM rows"))
def domain_attributes(spark, d):
    return ontology.attributes(model(spark, d)).select("uri", "owner", "label", "range")


@query(with_(_ONTOLOGY, "SELECT uri, label FROM rows WHERE \"range\" = 'BUILDING'"))
def range_attributes(spark, d):
    return ontology.attributes(model(spark, d), owner="BUILDING", side="range").select("uri", "label")


@query("""SELECT 'assoc/' || s_suppkey AS uri, 'nation/' || s_nationkey AS owner, 'from' AS direction FROM supplier UNION ALL SELECT 'assoc/' || s_suppkey, 'region/' || n_regionkey, 'to' FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def associations_both_directions(spark, d):
    return ontology.associations(model(spark, d)).select("uri", "owner", "direction")


@query("""WITH a AS (SELECT 'assoc/' || s_suppkey AS uri, n_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
 SELECT uri, 'region/' || n_regionkey AS owner, false AS inherited, NULL AS inherited_from FROM a UNION ALL SELECT uri, 'nation/' || n.n_nationkey, true, 'region/' || a.n_regionkey FROM a JOIN nation n ON n.n_regionkey = a.n_regionkey""")
def inherited_associations(spark, d):
    rows = ontology.associations(model(spark, d), outgoing=False, with_inherited=True)
    return rows.select("uri", "owner", "inherited", "inherited_from")


@query("SELECT 'enum/' || n_regionkey AS enumeration, n_name AS label, 'member/' || max(n_nationkey::VARCHAR) AS uri, 'first of ' || n_name AS description FROM nation GROUP BY 1, 2, 4")
def enumeration_members(spark, d):
    return ontology.enumeration(model(spark, d))


@query("SELECT 'enum/' || n_regionkey AS enumeration, upper(n_name) AS name, 'member/' || max(n_nationkey::VARCHAR) AS value, 'first of ' || n_name AS comment FROM nation GROUP BY 1, 2, 4")
def enumeration_constants(spark, d):
    return schemas.enumeration_constants(model(spark, d)).withColumn("name", F.upper("name"))


@query("""WITH c AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS low, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT o_orderkey, low || '..' || CASE WHEN n > 5 THEN '*' ELSE n::VARCHAR END AS display FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def cardinality_display(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("low"), F.count("*").alias("n"))
    name = F.concat(F.lit("Order"), F.col("l_orderkey").cast("string"), F.lit("-lines"))
    elements = items.select(F.concat(F.lit("Order"), F.col("l_orderkey").cast("string")).alias("class"), name.alias("element"), F.col("low").cast("string").alias("min"), F.when(F.col("n") > 5, "unbounded").otherwise(F.col("n").cast("string")).alias("max"), F.lit(None).cast("array<string>").alias("types"))
    orders = table(spark, d, "orders").select("o_orderkey")
    return ontology.with_cardinality(orders, elements, F.concat(F.lit("Order"), F.col("o_orderkey").cast("string"), F.lit("-lines"))).select("o_orderkey", "display")


@query("""SELECT CASE WHEN contains(p_type, 'STEEL') THEN 'STEEL' WHEN contains(p_type, 'BRASS') THEN 'BRASS' ELSE 'Other' END AS category, count(*) AS n, string_agg(p_name, '|' ORDER BY p_name) AS names FROM part GROUP BY 1""")
def class_categories(spark, d):
    rows = table(spark, d, "part").select(F.col("p_name").alias("class"), "p_type")
    return ontology.categorised(rows, terms.category_of(F.col("p_type"), ("STEEL", "BRASS"))).select("category", "n", F.array_join("classes", "|").alias("names"))


@query("""WITH f AS (SELECT 'nation/' || c_nationkey AS class, c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'bigint' WHEN 'MACHINERY' THEN 'date' ELSE 'string' END AS type, c_custkey % 3 = 0 AS is_list FROM customer)
 SELECT class, string_agg('`f' || c_custkey || '` ' || CASE WHEN is_list THEN 'array<' || type || '>' ELSE type END, ', ' ORDER BY 'f' || c_custkey) AS ddl FROM f GROUP BY 1""")
def class_schemas(spark, d):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "xsd:integer").when(F.col("c_mktsegment") == "MACHINERY", "xsd:date").otherwise("other:thing")
    rows = table(spark, d, "customer").select(
        iri("nation", "c_nationkey").alias("owner"), iri("attr", "c_custkey").alias("uri"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("label"), kind.alias("range"), F.when(F.col("c_custkey") % 3 == 0, "0..*").otherwise("0..1").alias("display")
    )
    return schemas.class_ddl(schemas.field_registry(rows))


# names and values


@query("SELECT page_id, CASE WHEN starts_with(url, 'http://www.w3.org/2004/02/skos/core#') THEN 'skos:' || substr(url, 37) ELSE url END AS uri FROM pages")
def prefixed_uri(spark, d):
    return table(spark, d, "pages").select("page_id", terms.prefixed_uri(F.col("url")).alias("uri"))


@query("SELECT r_regionkey, 'http://www.w3.org/2004/02/skos/core#' || r_name AS uri, 'skos:' || r_name AS short FROM region")
def full_uri(spark, d):
    rows = table(spark, d, "region").withColumn("uri", terms.full_uri(F.concat(F.lit("skos:"), "r_name")))
    return rows.select("r_regionkey", "uri", terms.prefixed_uri(F.col("uri")).alias("short"))


@query("SELECT page_id, regexp_matches(url, '^(?:https?|ftp)://[^/?#\\s]+|^urn:[a-z0-9][a-z0-9-]{0,31}:\\S+$', 'i') AS valid FROM pages")
def uri_validation(spark, d):
    return table(spark, d, "pages").select("page_id", terms.valid_uri(F.col("url")).alias("valid"))


@query("SELECT doc_id, regexp_full_match('urn:x:' || left(text, 12), 'urn:x:[A-Za-z0-9()+,\\-.:=@;$_!*''%/?#]+') AS valid FROM documents WHERE text IS NOT NULL")
def urn_validation(spark, d):
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", terms.valid_uri(F.concat(F.lit("urn:x:"), F.substring("text", 1, 12))).alias("valid"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def iso_dates(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", terms.to_iso(F.col("o_orderdate")).alias("iso"))
    return rows.select("o_orderkey", "iso", terms.to_iso(terms.iso_date(F.col("iso"))).alias("day"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_property(spark, d):
    return table(spark, d, "events").select("event_id", terms.json_field(F.col("props"), "k").alias("k"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS as_long FROM events")
def typed_literals(spark, d):
    rows = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("o"))
    return rows.select("event_id", terms.typed_value(F.col("o"), F.lit(terms.NAMESPACES["xsd"] + "integer"))["as_long"].alias("as_long"))


# conversion


@query("SELECT 'urn:ddi-cdi:run_InstanceVariable_V' || p_partkey AS uri, 'V' || p_partkey AS non_ddi_id, p_name AS name, p_type AS label FROM part")
def cdi_instance_variables(spark, d):
    nodes = convert.resources(book(spark, d), "run", types=["InstanceVariable"]).nodes
    return nodes.select("uri", "non_ddi_id", "name", "label")


@query("""WITH c AS (SELECT l_partkey, count(*) FILTER (l_linestatus = 'O') AS m, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
 SELECT 'urn:ddi-cdi:run_SubstantiveValueDomain_V' || l_partkey AS uri, 'SubstantiveValueDomain' AS type FROM c WHERE n > m UNION ALL SELECT 'urn:ddi-cdi:run_SentinelValueDomain_V' || l_partkey, 'SentinelValueDomain' FROM c WHERE m > 0""")
def value_domain_split(spark, d):
    return convert.resources(book(spark, d), "run", types=["SubstantiveValueDomain", "SentinelValueDomain"]).nodes.select("uri", "type")


@query("""SELECT DISTINCT 'run_' || CASE l_linestatus WHEN 'O' THEN 'Sentinel' ELSE 'Substantive' END || 'ConceptScheme_V' || l_partkey AS s, 'run_Concept_V' || l_partkey || '_' || l_linenumber AS o FROM lineitem""")
def concept_scheme_members(spark, d):
    return convert.resources(book(spark, d), "run", assocs=["skos:hasTopConcept"]).edges.select("s", "o")


@query("""SELECT DISTINCT 'urn:ddi-cdi:run_CodeList_V' || l_partkey || CASE l_linestatus WHEN 'O' THEN '_sentinel' ELSE '' END AS s, 'urn:ddi-cdi:run_Code_V' || l_partkey || '_' || l_linenumber AS o FROM lineitem""")
def code_list_members(spark, d):
    return convert.resources(book(spark, d), "run", skos=False, assocs=["has_Code"]).edges.select("s", "o")


@query("SELECT p_partkey, replace(replace(url_encode(replace(p_name || ' (100%~*)', ' ', '_')), '%7E', '~'), '*', '%2A') AS slug FROM part")
def code_slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", terms.code_slug(F.concat("p_name", F.lit(" (100%~*)"))).alias("slug"))


@query("""WITH vf AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
 SELECT 'F' || l_suppkey AS file_id, 'V' || l_partkey AS var_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS position FROM vf""")
def structure_positions(spark, d):
    return convert.structure_positions(book(spark, d)).select("file_id", "var_id", "position")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def resources_last_wins(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return graph.last_wins(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def resources_first_wins(spark, d):
    return graph.first_wins(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("""WITH c AS (SELECT l_partkey, count(*) FILTER (l_linestatus = 'O') AS m, count(*) AS n, count(DISTINCT l_linenumber) AS k FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
 vf AS (SELECT count(DISTINCT (l_partkey, l_suppkey)) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
 SELECT 'InstanceVariable' AS type, count(*) AS n FROM part UNION ALL SELECT 'SubstantiveValueDomain', count(*) FILTER (n > m) FROM c UNION ALL SELECT 'SentinelValueDomain', count(*) FILTER (m > 0) FROM c
 UNION ALL SELECT 'skos:ConceptScheme', count(*) FILTER (n > m) + count(*) FILTER (m > 0) FROM c UNION ALL SELECT 'skos:Concept', count(DISTINCT (l_partkey, l_linenumber)) FROM lineitem
 UNION ALL SELECT 'DataSet', count(*) FROM supplier UNION ALL SELECT 'LogicalRecord', count(*) FROM supplier UNION ALL SELECT 'DataStructure', count(*) FROM supplier
 UNION ALL SELECT 'DataStructureComponent', n FROM vf UNION ALL SELECT 'ComponentPosition', n FROM vf""")
def resource_type_histogram(spark, d):
    return convert.resources(book(spark, d), "run").nodes.groupBy("type").agg(F.count("*").alias("n")).orderBy("type")


@query("""WITH vf AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
 SELECT 'urn:ddi-cdi:run_LogicalRecord_F' || l_suppkey AS s, 'urn:ddi-cdi:run_InstanceVariable_V' || l_partkey AS o FROM vf""")
def conversion_triples(spark, d):
    t = convert.triples(convert.resources(book(spark, d), "run", types=[], assocs=["has_InstanceVariable"]))
    return t.select("s", "o")


# objects

REGISTRY = Registry([
    Class("Region", (Field("name", "name"),)),
    Class("Nation", (Field("name", "name"), Field("region", "in", refers_to="Region"))),
    Class("Supplier", (Field("name", "name"), Field("nation", "in", refers_to="Nation"))),
    Class("Customer", (Field("name", "name"), Field("segment", "segment", is_list=True), Field("nation", "in"))),
])


@query("SELECT 'customer/' || c_custkey AS s, c_name AS name, c_mktsegment AS segment, 'nation/' || c_nationkey AS nation FROM customer")
def deserialize_by_type(spark, d):
    return objects.objects(triples(spark, d), REGISTRY, "Customer").select("s", "name", F.array_join("segment", "|").alias("segment"), "nation")


@query("SELECT 'supplier/' || s_suppkey AS s, s_name AS name, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def deserialize_nested(spark, d):
    rows = objects.objects(triples(spark, d), REGISTRY, "Supplier")
    return rows.select("s", "name", F.col("nation.object.name").alias("nation"), F.col("nation.object.region.object.name").alias("region"))


@query("SELECT 'supplier/' || s_suppkey AS s, 'nation/' || s_nationkey AS nation FROM supplier")
def uri_reference_kept(spark, d):
    kept = Registry([Class("Supplier", (Field("nation", "in"),))])
    return objects.objects(triples(spark, d), kept, "Supplier")


@query(with_(TRIPLES, f"SELECT s, 'no class for its types' AS reason FROM t WHERE p = '{RDF_TYPE}' AND o = 'Customer'"))
def deserialize_rejects(spark, d):
    return objects.rejects(triples(spark, d), Registry([c for c in REGISTRY.by_iri.values() if c.iri != "Customer"]))


@query("SELECT 'customer/' || c_custkey AS s, c_name AS name, 'nation/' || c_nationkey AS nation FROM customer")
def roundtrip(spark, d):
    lines = rdf.ntriples(triples(spark, d))
    rows = objects.objects(rdf.parse_ntriples(lines), Registry([Class("Customer", (Field("name", "name"), Field("nation", "in")))]), "Customer")
    return rows


@query("""WITH a AS (SELECT 'attr/' || c_custkey AS uri, 'nation/' || c_nationkey AS owner FROM customer), b AS (SELECT 'regional/' || r_regionkey AS uri, r_regionkey FROM region)
 SELECT uri, owner, false AS inherited, NULL AS inherited_from FROM a UNION ALL SELECT uri, 'region/' || r_regionkey, false, NULL FROM b
 UNION ALL SELECT uri, 'nation/' || n_nationkey, true, 'region/' || r_regionkey FROM b JOIN nation ON n_regionkey = r_regionkey""")
def inherited_attributes(spark, d):
    u, rdfs = terms.NAMESPACES["ucmis"], terms.NAMESPACES["rdfs"]
    regional = unpivoted(table(spark, d, "region"), iri("regional", "r_regionkey"), u + "Attribute", {rdfs + "label": F.col("r_name")}, {rdfs + "domain": iri("region", "r_regionkey")})
    return ontology.attributes(model(spark, d).unionByName(regional), with_inherited=True).select("uri", "owner", "inherited", "inherited_from")


@query("""SELECT 'V' || l_partkey AS var_id, l_linenumber::VARCHAR AS value, l_returnflag AS type, count(*) AS n, sum(l_quantity::BIGINT)::DOUBLE AS total FROM lineitem GROUP BY 1, 2, 3""")
def category_statistics(spark, d):
    items = table(spark, d, "lineitem")
    stats = items.select(
        F.lit("D").alias("doc_id"), F.concat(F.lit("V"), F.col("l_partkey").cast("string")).alias("var_id"), F.col("l_linenumber").cast("string").alias("value"), F.col("l_returnflag").alias("label"),
        F.array(F.struct(F.col("l_returnflag").alias("type"), F.col("l_quantity").cast("string").alias("value"))).alias("statistics"),
    )
    return codebook.category_statistics(stats).groupBy("var_id", "value", "type").agg(F.count("*").alias("n"), F.sum("number").alias("total"))


@query("SELECT 'V' || l_partkey AS var_id, max(l_quantity) FILTER (l_returnflag = 'A') AS \"A\", max(l_quantity) FILTER (l_returnflag = 'N') AS \"N\", max(l_quantity) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1")
def summary_statistics(spark, d):
    items = table(spark, d, "lineitem")
    stats = items.select(F.lit("D").alias("doc_id"), F.concat(F.lit("V"), F.col("l_partkey").cast("string")).alias("var_id"), F.array(F.struct(F.col("l_returnflag").alias("type"), F.col("l_quantity").cast("string").alias("value"))).alias("statistics"))
    return codebook.summary_statistics(stats, ["A", "N", "R"]).drop("doc_id")


@query(with_(VARIABLES, "SELECT var_id, name FROM v WHERE contains(lower(name), 'a')"))
def variables_by_name_part(spark, d):
    return codebook.search(book(spark, d).variables, name_part="A").select("var_id", "name")


@query(with_(TRIPLES, f"SELECT s, CASE WHEN o IN ('Supplier', 'Customer') THEN o END AS type FROM t WHERE p = '{RDF_TYPE}'"))
def dispatch_by_base(spark, d):
    """The class of each subject where it is one of, or lies below, a base class; else none."""
    own = Registry([Class("Supplier", (), parent="Party"), Class("Customer", (), parent="Party"), Class("Nation", ()), Class("Party", ())])
    return objects.typed_below(triples(spark, d), own, "Party")


@query(with_(TRIPLES, "SELECT s AS x, o AS name FROM t WHERE p = 'name' ORDER BY o DESC, s LIMIT 25"))
def sparql_limit(spark, d):
    return select(triples(spark, d), "SELECT ?x ?name WHERE { ?x <name> ?name } ORDER BY DESC(?name) ?x LIMIT 25")


@query("""SELECT 'region/' || r_regionkey AS class, 'Thing' AS parent, count(n_nationkey) AS n_associations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2
 UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey, 0 FROM nation""")
def class_parents(spark, d):
    """Class schemas with their parents, and the associations that start at them."""
    u, rdfs = terms.NAMESPACES["ucmis"], terms.NAMESPACES["rdfs"]
    more = unpivoted(table(spark, d, "nation"), iri("link", "n_nationkey"), u + "Association", {rdfs + "label": F.col("n_name")}, {rdfs + "domain": iri("region", "n_regionkey"), rdfs + "range": iri("nation", "n_nationkey")})
    t = model(spark, d).where(F.col("s").startswith("nation/") | F.col("s").startswith("region/")).unionByName(more)
    return schemas.class_sources(t, "Thing").select("class", "parent", F.col("n_associations"))


@query("""SELECT 'F' || s_suppkey AS id, 'urn:ddi-cdi:p_DataSet_F' || s_suppkey AS uri, CASE WHEN s_acctbal < 0 THEN 'no uri' WHEN count(*) OVER (PARTITION BY s_nationkey) > 0 AND s_suppkey <> max(s_suppkey) FILTER (s_acctbal >= 0) OVER (PARTITION BY s_nationkey) THEN 'replaced' END AS problem FROM supplier""")
def managed_resources(spark, d):
    """Typed insertion: rows without a URI are told, and of rows with one URI the last stays."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("F"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("DataSet").alias("type"), F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("uri"))
    return convert.inserted(rows, ["DataSet"]).select("id", F.concat(F.lit("urn:ddi-cdi:p_DataSet_"), "id").alias("uri"), "problem")


@query("""WITH n AS (SELECT 'urn:x:' || c_custkey AS uri, c_name AS name FROM customer) SELECT uri AS s, 'name' AS p, uri || '#name' AS o FROM n UNION ALL SELECT uri || '#name', 'type', 'ObjectName' FROM n UNION ALL SELECT uri || '#name', 'name', name FROM n
 UNION ALL SELECT uri, 'displayLabel', uri || '#displayLabel' FROM n UNION ALL SELECT uri || '#displayLabel', 'type', 'LabelForDisplay' FROM n UNION ALL SELECT uri || '#displayLabel', 'languageSpecificString', uri || '#displayLabel-text' FROM n
 UNION ALL SELECT uri || '#displayLabel-text', 'type', 'LanguageString' FROM n UNION ALL SELECT uri || '#displayLabel-text', 'content', name FROM n""")
def structured_names(spark, d):
    rows = table(spark, d, "customer").select(F.concat(F.lit("urn:x:"), F.col("c_custkey").cast("string")).alias("uri"), F.col("c_name").alias("name"), F.col("c_name").alias("label"))
    t = convert.name_nodes(rows)
    return t.select("s", F.when(F.col("p") == RDF_TYPE, "type").otherwise(F.regexp_replace("p", ".*/", "")).alias("p"), F.regexp_replace("o", f"^{convert.CDI}", "").alias("o"))


@query("""WITH c AS (SELECT DISTINCT 'V' || l_partkey || '_' || l_linenumber AS k FROM lineitem) SELECT 'usesNotation' AS assoc, 'urn:ddi-cdi:run_Code_' || k AS s, 'urn:ddi-cdi:run_Notation_' || k AS o FROM c
 UNION ALL SELECT 'denotes_Category', 'urn:ddi-cdi:run_Code_' || k, 'urn:ddi-cdi:run_Category_' || k FROM c UNION ALL SELECT 'represents_Category', 'urn:ddi-cdi:run_Notation_' || k, 'urn:ddi-cdi:run_Category_' || k FROM c""")
def code_edges(spark, d):
    return convert.resources(book(spark, d), "run", skos=False, assocs=["usesNotation", "denotes_Category", "represents_Category"]).edges.select("assoc", "s", "o")
