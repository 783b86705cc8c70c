"""Codebooks, graphs, ontologies, conversion and objects on small texts of our own."""

import pytest
from pyspark.sql import functions as F

from metaquarry.functions import terms
from metaquarry.operators import codebook, convert, graph, objects, ontology, schemas
from metaquarry.operators.objects import Class, Field, Registry
from metaquarry.operators.sparql import QueryError, select
from metaquarry.sources import rdf, sinks, xml
from metaquarry.sources.specification import Folders, Specification
from metaquarry.streaming import ingest

BOOK = """<?xml version="1.0"?>
<c:codeBook xmlns:c="urn:any" ID="B1" version="2.5">
 <c:stdyDscr><c:citation><c:titlStmt><c:titl>Survey of things</c:titl><c:subTitl>part one</c:subTitl><c:altTitl>Things</c:altTitl></c:titlStmt></c:citation>
  <c:stdyInfo><c:abstract>What it is <c:b>all</c:b> about.</c:abstract></c:stdyInfo></c:stdyDscr>
 <c:fileDscr ID="F1"><c:fileTxt><c:fileName>main.v2.dat</c:fileName><c:dimensns><c:caseQnty>10</c:caseQnty><c:varQnty>2</c:varQnty></c:dimensns></c:fileTxt></c:fileDscr>
 <c:fileDscr ID="F10"><c:fileTxt><c:fileName>.hidden</c:fileName></c:fileTxt></c:fileDscr>
 <c:dataDscr>
  <c:var ID="V1" name="answer" files="F1 F10"><c:labl>Yes or no</c:labl><c:qstn><c:preQTxt>Now</c:preQTxt><c:qstnLit>Yes?</c:qstnLit></c:qstn>
   <c:catgry><c:catValu>1</c:catValu><c:labl>Yes</c:labl></c:catgry><c:catgry><c:catValu>a b*</c:catValu></c:catgry>
   <c:catgry missing="Y"><c:catValu>9</c:catValu><c:labl>Unknown</c:labl></c:catgry><c:varFormat type="numeric"/></c:var>
  <c:var ID="V2" name="Age" files="F10"><c:labl>Age in years</c:labl></c:var>
  <c:var ID="V3" files="F1"><c:catgry missing="Y"><c:catValu>8</c:catValu></c:catgry></c:var>
 </c:dataDscr>
</c:codeBook>"""

TURTLE = """@base <http://example.org/> . @prefix v: <http://v.org/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
# people
<ann> a v:Person ; v:name "Ann" , "Anna"@de ; v:age 41 ; v:knows [ a v:Person ; v:name \"\"\"Bob "B" \"\"\" ] .
<list> v:items ( <ann> "x\\ny" ) ; v:ok true ; v:size 1.5e3 ; v:on "2020-01-01"^^xsd:date .
[] a v:Thing ."""


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("books")
    (at / "b.xml").write_text(BOOK)
    return xml.read_codebooks(spark, str(at / "b.xml"))


@pytest.fixture(scope="module")
def tables(book):
    return codebook.normalise(book)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_codebook_tables(tables):
    d = tables.documents.first()
    assert (d.title, d.sub_title, d.alt_title) == ("Survey of things", "part one", "Things")
    assert rows(tables.files, "file_id", "basename", "n_records") == [("F1", "main.v2", "10"), ("F10", ".hidden", None)]
    assert rows(tables.variables, "var_id", "n_categories", "n_missing", "has_question") == [("V1", 3, 1, True), ("V2", 0, 0, False), ("V3", 1, 1, False)]


def test_parse_from_text_column(spark, book):
    parsed = xml.parse_codebooks(spark.createDataFrame([(BOOK,)], "x string"), "x")
    assert codebook.normalise(parsed).variables.count() == 3


def test_dictionary(tables):
    full = codebook.data_dictionary(tables, categories=True, questions=True).where("var_id = 'V1'").first()
    assert [tuple(c) for c in full.categories] == [("1", "Yes"), ("a b*", None), ("9", "Unknown")]
    assert (full.question.pre, full.question.literal) == ("Now", "Yes?")
    assert rows(codebook.data_dictionary(tables, name="AG"), "var_id") == [("V2",)]
    assert rows(codebook.data_dictionary(tables, label="in"), "var_id") == []
    assert rows(codebook.data_dictionary(tables, file_id="F1"), "var_id") == [("V1",), ("V3",)]
    assert rows(codebook.search(tables.variables, file_id="F1", name="none", strict=True), "var_id") == [("V1",), ("V2",), ("V3",)]
    assert rows(codebook.type_distribution(tables.variables), "type", "n") == [("numeric", 1), ("unknown", 2)]
    assert tuple(codebook.report(tables).first())[2:] == (2, 3, 4, 1)


@pytest.mark.parametrize("skos", [True, False])
def test_conversion(tables, skos):
    found = convert.resources(tables, "run", skos)
    n = {r.type: r.n for r in found.nodes.groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert n["InstanceVariable"] == 3 and n["SubstantiveValueDomain"] == 1 and n["SentinelValueDomain"] == 2
    assert n["DataStructure"] == 2 and n["DataStructureComponent"] == 4
    member = "skos:hasTopConcept" if skos else "has_Code"
    members = rows(found.edges.where(F.col("assoc") == member), "s", "o")
    assert len(members) == 4 and any(o.endswith("V1_a_b%2A") for _, o in members)
    assert rows(convert.structure_positions(tables), "file_id", "var_id", "position") == [("F1", "V1", 1), ("F1", "V3", 2), ("F10", "V1", 1), ("F10", "V2", 2)]
    t = convert.triples(found)
    assert t.where("s IS NULL OR p IS NULL OR o IS NULL").count() == 0
    with pytest.raises(NotImplementedError):
        convert.resources(tables, "run", files=["F1"])


def test_turtle(spark):
    t = rdf.parse_turtle(spark.createDataFrame([(TURTLE,), (TURTLE + " ",)], "value string"))
    own = {(r.s, r.p, r.o, r.o_kind, r.o_datatype, r.o_lang) for r in t.collect()}
    xsd = terms.NAMESPACES["xsd"]
    assert ("http://example.org/ann", "http://v.org/name", "Anna", "literal", None, "de") in own
    assert ("http://example.org/ann", "http://v.org/age", "41", "literal", xsd + "integer", None) in own
    assert ("http://example.org/list", "http://v.org/on", "2020-01-01", "literal", xsd + "date", None) in own
    assert any(x[2] == 'Bob "B" ' for x in own) and any(x[2] == "x\ny" for x in own)
    assert len({x[0] for x in own if x[2] == "http://v.org/Thing"}) == 2  # blank nodes of two texts differ


def test_turtle_errors():
    for bad in ("<a> <b> .", "x:y <b> <c> .", "<a> <b> \"open .", "<a> <b> <c>"):
        with pytest.raises(rdf.TurtleError):
            rdf.Turtle(bad, "x").parse()


@pytest.mark.parametrize("form", ["ntriples", "jsonld", "turtle"])
def test_round_trips(spark, tmp_path, form):
    t = rdf.parse_turtle(spark.createDataFrame([(TURTLE,)], "value string")).where("o_kind <> 'bnode' AND NOT startswith(s, '_')")
    path = str(tmp_path / "out")
    if form == "ntriples":
        rdf.write_ntriples(t, path)
        again = rdf.read_ntriples(spark, path)
    elif form == "jsonld":
        again = rdf.parse_jsonld(rdf.jsonld(t).select(F.concat(F.lit("["), "value", F.lit("]")).alias("value")))
    else:
        again = rdf.parse_turtle(rdf.turtle(t))
    assert rows(again, *graph.COLUMNS) == rows(t, *graph.COLUMNS) if form == "turtle" else set(map(tuple, again.collect())) == set(map(tuple, t.collect()))


def test_closure_and_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e"), ("x", "y")], "child string, parent string")
    up = {(r.child, r.ancestor) for r in graph.closure(links).collect()}
    assert {x for x in up if x[0] == "d"} == {("d", "a"), ("d", "b"), ("d", "c")} and ("a", "a") not in up
    assert rows(graph.ancestors(links, "d"), "node") == [("a",), ("b",), ("c",)]
    assert rows(graph.descendants(links, "a"), "node") == [("b",), ("c",), ("d",)]
    nodes = spark.createDataFrame([(x,) for x in "abcdxy"], "node string")
    level = {r.node: r.level for r in graph.levels(nodes, links).collect()}
    assert level["y"] == 0 and level["x"] == 1 and level["a"] is None and level["d"] is None  # d waits for a, as in a topological sort that peels off what has no parent left


SCHEMA = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:complexType name="CarXsdType" xml:id="CarXsdType"><xs:sequence>
<xs:element name="colour" minOccurs="0" maxOccurs="unbounded" xml:id="Car-colour"/>
<xs:element name="has" minOccurs="1" maxOccurs="1" xml:id="Car_has_Wheel"><xs:complexType><xs:sequence><xs:element name="validType" minOccurs="1" maxOccurs="unbounded" xml:id="Car_has_Wheel-validType">
<xs:simpleType><xs:restriction><xs:enumeration value="Wheel"/><xs:enumeration value="Tyre"/></xs:restriction></xs:simpleType></xs:element></xs:sequence></xs:complexType></xs:element>
</xs:sequence></xs:complexType></xs:schema>"""
ONTOLOGY = """@prefix u: <tag:ddialliance.org,2024:ucmis:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix o: <http://o.org/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
o:Vehicle a u:Class ; rdfs:label "Vehicle" . o:Car a u:Class ; rdfs:subClassOf o:Vehicle .
<http://o.org/Car-colour> a u:Attribute ; rdfs:domain o:Car ; rdfs:range xsd:string ; rdfs:label "for" ; rdfs:comment "The\\ncolour " .
<http://o.org/Vehicle-mass> a u:Attribute ; rdfs:domain o:Vehicle ; rdfs:range xsd:integer ; rdfs:label "mass" .
<http://o.org/Car_has_Wheel> a u:Association ; rdfs:domain o:Car ; rdfs:range o:Wheel ; rdfs:label "has" .
o:Size a u:Enumeration . o:big a o:Size ; rdfs:label "big" ; rdfs:comment "b" , "a" ."""


def test_ontology(spark, tmp_path):
    base = tmp_path / "build/encoding"
    (base / "ontology").mkdir(parents=True)
    (base / "xml-schema").mkdir()
    (base / "ontology/o.ttl").write_text(ONTOLOGY)
    (base / "ontology/other.txt").write_text("not turtle")
    (base / "xml-schema/s.xsd").write_text(SCHEMA)
    spec = Specification.load(spark, str(tmp_path), "s.xsd")
    spec.write(str(tmp_path / "tables"))
    spec = Specification.read(spark, str(tmp_path / "tables"))
    assert ontology.model_statistics(spec.triples).first().n_class == 2
    own = ontology.attributes(spec.triples, spec.elements, "http://o.org/Car").first()
    assert (own.label, own.display, own.description) == ("for", "0..*", "The colour")
    both = ontology.attributes(spec.triples, owner="http://o.org/Car", with_inherited=True)
    assert rows(both, "label", "inherited", "inherited_from") == [("for", False, None), ("mass", True, "http://o.org/Vehicle")]
    a = ontology.associations(spec.triples, "http://o.org/Car", elements=spec.elements).first()
    assert (a.direction, a.from_display, a.to_display, a.to_types) == ("from", "1..1", "1..*", ["Wheel", "Tyre"])
    assert tuple(ontology.enumeration(spec.triples, "http://o.org/Size").first())[1:] == ("big", "http://o.org/big", "a b")
    fields = schemas.field_registry(ontology.attributes(spec.triples, spec.elements))
    assert {r["class"]: r.ddl for r in schemas.class_ddl(fields).collect()} == {"http://o.org/Car": "`for_` array<string>", "http://o.org/Vehicle": "`mass` bigint"}
    assert spark.createDataFrame([], schemas.class_ddl(fields).where("class LIKE '%Car'").first().ddl).columns == ["for_"]
    assert rows(select(spec.triples, 'SELECT ?c WHERE { ?c a ucmis:Class . FILTER NOT EXISTS { ?c rdfs:subClassOf ?any } FILTER(CONTAINS(LCASE(str(?c)), "vehicle")) }'), "c") == [("http://o.org/Vehicle",)]


def test_specification_needs_root():
    with pytest.raises(ValueError):
        Folders("")


def test_query_errors(spark):
    t = spark.createDataFrame([], graph.SCHEMA)
    for bad in ("SELECT ?x WHERE { }", "SELECT ?x WHERE { ?x nope:y ?z }", "SELECT ?x WHERE { ?x a ?y } LIMIT 1 1", "SELECT ?x { ?x ~ ?y }"):
        with pytest.raises(QueryError):
            select(t, bad)


def test_objects(spark):
    text = "@prefix v: <v:> . <s:1> a v:A ; v:name \"n2\", \"n1\" ; v:next <s:2> ; v:far <s:9> ; v:age \"x\" . <s:2> a v:A ; v:next <s:1> . <s:3> a v:Unknown . <s:4> v:name \"untyped\" ."
    t = rdf.parse_turtle(spark.createDataFrame([(text,)], "value string"))
    a = Class("v:A", (Field("name", "v:name"), Field("names", "v:name", is_list=True), Field("next", "v:next", refers_to="v:A"), Field("far", "v:far", refers_to="v:A"), Field("age", "v:age", kind="bigint")))
    registry = Registry([a])
    found = {r.s: r for r in objects.objects(t, registry, "v:A", max_depth=2).collect()}
    one = found["s:1"]
    assert one.name == "n1" and one.names == ["n1", "n2"] and one.next.object.next.object.next == "s:2" and one.far.iri == "s:9" and one.far.object is None and one.age is None
    assert rows(objects.rejects(t, registry), "s") == [("s:3",)]
    assert objects.one(t, registry, "s:4").count() == 0 and objects.one(t, registry, "s:2").count() == 1
    with pytest.raises(ValueError):
        objects.one(t, registry, "s:3")
    assert objects.deserialize(t, registry, ["v:A"])["v:A"].count() == 2
    assert objects.objects(t.limit(0), registry, "v:A").count() == 0


def test_urns_end_where_their_text_ends(spark):
    df = spark.createDataFrame([("urn:x:a.\n",), ("urn:x:a.\r\n",), ("urn:x:a.\u2028",), ("urn:x:a\nb",), ("urn:x:",), ("urn:x:a.",)], "u string")
    assert [r[0] for r in df.select(terms.valid_uri(F.col("u"))).collect()] == [False, False, False, False, False, True]


def test_scalars(spark):
    df = spark.createDataFrame([("urn:abc:x",), ("http://h/p",), ("http:///p",), ("mailto:a@b",), (None,)], "u string")
    assert [r[0] for r in df.select(terms.valid_uri(F.col("u"))).collect()] == [True, True, False, False, False]
    one = spark.range(1)
    got = one.select(terms.indented(F.lit("a\n\nb"), 2), terms.escaped(F.lit(' a"\\\n')), terms.local_tag(F.lit("{n}t")), terms.field_name(F.lit("from")), terms.range_type(F.lit("o:x"))).first()
    assert tuple(got) == ("  a\n\n  b", 'a\\"\\\\', "t", "from_", "string")
    with pytest.raises(Exception, match="no type"):
        one.select(terms.range_type(F.lit("xsd:float"))).collect()
    assert xml.flat_text("<a> hi <b>x<c/> y </b> tail </a>") == "hi<b>x<c></c>y</b>tail"


def test_sinks_and_tree(spark, book, tmp_path):
    leaves = {r.path: r.value for r in sinks.tree(book).collect()}
    assert leaves["/dataDscr[0]/var[0]/catgry[2]/_missing"] == "Y"
    assert all(r.level <= 3 for r in sinks.tree(book, 3).collect())
    t = rdf.parse_turtle(spark.createDataFrame([(TURTLE,)], "value string"))
    assert '"http://v.org/Person":{"count":2}' in sinks.statistics_json(t).first().value


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.xml").write_text(BOOK)
    ingest.append_codebooks(ingest.codebook_texts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/batch=0/variables").count() == 3


def test_ntriples_lines(spark):
    lines = ['<a:b> <c:d> "caf\\u00e9 \\U0001F600 \\\\n \\n \\b\\f\\" " . # note', '<a:b> <c:\\u0064> <e:f>.', "", " # only a note", '_:x <c:d> "v"@en-GB .', '<a:b> <c:d> "v"^^<t:u> .', '<a:b> <c:d> "\\q" .', "<a:b> <c:d> .", '<a:b> "c" <d:e> .', '<a:b> <c:d> "open .', '<a:b> <c:d> "' + "\\n" * 20000 + '" .']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    found = {tuple(r) for r in rdf.parse_ntriples(df).collect()}
    assert found == {
        ("a:b", "c:d", 'caf\u00e9 \U0001F600 \\n \n \b\f" ', "literal", None, None), ("a:b", "c:d", "e:f", "iri", None, None), ("_:x", "c:d", "v", "literal", None, "en-GB"), ("a:b", "c:d", "v", "literal", "t:u", None), ("a:b", "c:d", "\n" * 20000, "literal", None, None),
    }
    assert [r.value for r in rdf.ntriples_rejects(df).collect()] == lines[6:10]
    texts = spark.createDataFrame([('s"x', "p", 'o\\ "\n\ue000', "literal", None, None)], graph.SCHEMA)
    assert [tuple(r) for r in rdf.parse_ntriples(rdf.ntriples(texts.withColumn("s", F.lit("s")))).collect()] == [("s", "p", 'o\\ "\n\ue000', "literal", None, None)]
    assert {tuple(r) for r in rdf.parse_jsonld(rdf.jsonld(texts).select(F.concat(F.lit("["), "value", F.lit("]")).alias("value"))).collect()} == {tuple(r) for r in texts.collect()}


def test_references_and_bases(spark):
    text = "@base <http://x/a/b#t> . <c> <p> </d> , <#e> , <../f> , <> . @base <g/> . <h> <http://y/z> <i> ."
    got = {(r.s, r.p, r.o) for r in rdf.parse_turtle(spark.createDataFrame([(text,)], "value string")).collect()}
    c, p = "http://x/a/c", "http://x/a/p"
    assert got == {(c, p, "http://x/d"), (c, p, "http://x/a/b#e"), (c, p, "http://x/f"), (c, p, "http://x/a/b"), ("http://x/a/g/h", "http://y/z", "http://x/a/g/i")}


def test_json_ld_and_rdf_xml(spark):
    doc = '{"@context": [{"@vocab": "http://v/", "@base": "http://b/"}, {"x": "http://x/", "knows": {"@id": "x:knows", "@type": "@id"}, "on": {"@id": "x:on", "@type": "x:date"}, "items": {"@container": "@list"}}], "@graph": [{"@id": "ann", "@type": "Person", "knows": ["bob", {"name": "C"}], "on": "2020", "age": 3, "ok": true, "items": [1, "y"], "label": {"@value": "Hi", "@language": "en"}}]}'
    t = rdf.parse_jsonld(spark.createDataFrame([(doc,), ("not json",)], "value string")).collect()
    own = {(r.s, r.p, r.o, r.o_datatype, r.o_lang) for r in t if r.s == "http://b/ann"}
    xsd = terms.NAMESPACES["xsd"]
    assert {("http://b/ann", "http://x/knows", "http://b/bob", None, None), ("http://b/ann", "http://x/on", "2020", "http://x/date", None), ("http://b/ann", "http://v/age", "3", xsd + "integer", None), ("http://b/ann", "http://v/label", "Hi", None, "en"), ("http://b/ann", terms.RDF_TYPE, "http://v/Person", None, None)} <= own
    assert len([r for r in t if r.p.endswith("#first")]) == 2 and any(r.o == "C" for r in t)
    xml_text = '<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:v="http://v/" xml:base="http://b/d"><v:Person r:about="ann" v:nick="A"><v:knows r:resource="#bob"/><v:name xml:lang="de">An&amp;na</v:name><v:age r:datatype="http://t/int">4</v:age><v:has><v:Dog/></v:has><v:all r:parseType="Collection"><v:One r:about="1"/></v:all></v:Person></r:RDF>'
    own = {(r.s, r.p, r.o, r.o_datatype, r.o_lang) for r in rdf.parse_rdf_xml(spark.createDataFrame([(xml_text,)], "value string")).collect()}
    assert {("http://b/ann", "http://v/knows", "http://b/d#bob", None, None), ("http://b/ann", "http://v/name", "An&na", None, "de"), ("http://b/ann", "http://v/age", "4", "http://t/int", None), ("http://b/ann", "http://v/nick", "A", None, None), ("http://b/1", terms.RDF_TYPE, "http://v/One", None, None)} <= own
    assert sum(o == "http://v/Dog" for _, _, o, _, _ in own) == 1


def test_deep_diamonds_end_soon(spark):
    links = [(f"a{i}{x}", f"a{i + 1}{y}") for i in range(20) for x in "lr" for y in "lr"]
    df = spark.createDataFrame(links, "child string, parent string")
    assert graph.ancestors(df, "a0l").count() == 40
    assert graph.closure(df.where("child < 'a2'")).count() > 0


def test_names_and_insertion(spark):
    t = convert.name_nodes(spark.createDataFrame([("u:1", "n", None), ("u:2", None, "l")], "uri string, name string, label string"))
    assert t.count() == 3 + 5
    rows_ = spark.createDataFrame([(1, "A", "u"), (2, "A", "u"), (3, "B", "v"), (4, "A", None)], "seq int, type string, uri string")
    assert {r.seq: r.problem for r in convert.inserted(rows_, ["A"]).collect()} == {1: "replaced", 2: None, 3: "unknown type", 4: "no uri"}


def test_command_line(spark, tmp_path, capsys):
    from metaquarry.__main__ import main

    (tmp_path / "b.xml").write_text(BOOK.replace("<c:dataDscr>", "<c:dataDscr><c:odd/><!-- <c:gone/> -->"))
    main(["dictionary", "--stats", "--categories", str(tmp_path / "b.xml")])
    out = capsys.readouterr().out
    assert "answer" in out and "Age in years" in out
    main(["dump", "--max-level", "0", str(tmp_path / "b.xml")])
    assert capsys.readouterr().out.strip() == "doc_id\tpath\tlevel\tvalue"
    main(["audit", str(tmp_path / "b.xml")])
    assert "odd\t1" in capsys.readouterr().out
    main(["convert", "--to", str(tmp_path / "out"), str(tmp_path / "b.xml")])
    assert rdf.read_ntriples(spark, str(tmp_path / "out")).count() > 50
    at = tmp_path / "spec/build/encoding/ontology"
    at.mkdir(parents=True)
    (at / "o.ttl").write_text(ONTOLOGY)
    main(["schema", "--to", str(tmp_path / "schema"), str(tmp_path / "spec")])
    classes = {r["class"]: (r.parent, r.ddl, r.n_associations) for r in spark.read.json(str(tmp_path / "schema/classes")).collect()}
    assert classes["http://o.org/Car"] == ("http://o.org/Vehicle", "`for_` string, `has` string", 1)
    with pytest.raises(FileNotFoundError):
        Specification.load(spark, str(tmp_path / "nowhere"))
    with pytest.raises(RuntimeError):
        Specification(None).triples


def test_sinks_and_schemas_write(spark, tables, tmp_path):
    found = convert.resources(tables, "run")
    sinks.write_resources_json(found.nodes, str(tmp_path / "nodes"))
    assert spark.read.json(str(tmp_path / "nodes")).count() == found.nodes.count()
    assert rows(convert.variables_in(tables, "F1"), "var_id") == [("V1",), ("V3",)]
    source = spark.createDataFrame([("class A(B):",), ("class C(A):",), ("    x = 1",)], "value string")
    assert rows(schemas.forward_references_fixed(source, ["A"]), "value", "n_fixed") == [("    x = 1", 0), ("class A(object):", 1), ("class C(A):", 0)]


@pytest.mark.parametrize("name", ["dictionary_name_regex", "search_variables", "without_property", "label_contains", "sparql_limit"])
def test_queries_return_rows(spark, name):
    from metaquarry.plans import catalog

    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_topological_rate_takes_all_links(spark, monkeypatch):
    from metaquarry.operators import schemas
    from metaquarry.plans import bindings, catalog

    d, seen, rate = "/root/testdata/sf0.001", [], schemas.order_rate
    monkeypatch.setattr(schemas, "order_rate", lambda order, links, count=None: (seen.append(links.count()), rate(order, links, count))[1])
    assert catalog.QUERIES["topological_rate"](spark, d).first()["rate"] == 100.0
    assert seen == [bindings.links(spark, d).count()] and seen[0] > 100


def test_unpivoted_cells(spark):
    t = spark.createDataFrame([(1, "a", None, 7), (2, None, "y", None)], "id int, name string, _name string, parent int")
    uri = F.concat(F.lit("n/"), F.col("id").cast("string"))
    found = convert.unpivoted(t, uri, "Node", {"name": F.col("name"), "other": F.col("_name")}, {"in": F.col("parent")})
    assert {tuple(r)[:4] for r in found.collect()} == {
        ("n/1", terms.RDF_TYPE, "Node", "iri"), ("n/1", "name", "a", "literal"), ("n/1", "in", "7", "iri"), ("n/2", terms.RDF_TYPE, "Node", "iri"), ("n/2", "other", "y", "literal"),
    } and found.count() == 5 and found.columns == list(graph.COLUMNS)
    plan = found.where("p = 'in'").select("s", "o")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan.lower()  # compiled as a whole, no lambda functions over the cells


def test_turtle_ends():
    for end in ("", " ", "\n# note", " # note\n\n#", "\t#"):
        made = rdf.Turtle("#x\n<a> <b> <c> ." + end, "x")
        assert made.tokens[-1] == ("end", "") and len(made.tokens) == 5 and made.parse() == [("a", "b", "c", "iri", None, None)]
    for text in ("", " ", "# note"):
        assert rdf.Turtle(text, "x").tokens == [("end", "")] and rdf.Turtle(text, "x").parse() == []
    with pytest.raises(rdf.TurtleError, match="unexpected text at 3"):
        rdf.Turtle("<a> ?", "x")
