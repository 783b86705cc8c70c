"""python -m metaquarry dictionary|dump|convert|schema|audit PATH ...: codebook queries and class schemas from a shell, or by spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.operators import graph, ontology, schemas
from metaquarry.operators.codebook import category_statistics, data_dictionary, normalise
from metaquarry.operators.convert import resources, triples
from metaquarry.sources.rdf import write_jsonld, write_ntriples, write_turtle
from metaquarry.sources.sinks import tree
from metaquarry.sources.specification import Specification
from metaquarry.sources.xml import left_out, read_codebooks


def _print(rows: DataFrame) -> None:
    """All rows, a partition at a time."""
    print("\t".join(rows.columns))
    for r in rows.toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in r))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="metaquarry")
    kinds = p.add_subparsers(dest="command", required=True)
    one = kinds.add_parser("dictionary", help="variables of codebooks")
    one.add_argument("--name"), one.add_argument("--label"), one.add_argument("--file")
    one.add_argument("--categories", action="store_true"), one.add_argument("--questions", action="store_true"), one.add_argument("--stats", action="store_true", help="statistics of categories")
    two = kinds.add_parser("dump", help="elements of codebooks")
    two.add_argument("--max-level", type=int)
    three = kinds.add_parser("convert", help="codebooks to linked resources")
    three.add_argument("--to", required=True), three.add_argument("--prefix", default="local")
    three.add_argument("--format", choices=("nt", "turtle", "json-ld"), default="nt"), three.add_argument("--code-lists", action="store_true")
    four = kinds.add_parser("schema", help="a specification's classes as tables, enumerations and the order of classes")
    four.add_argument("--xml-schema"), four.add_argument("--to", required=True)
    five = kinds.add_parser("audit", help="elements of codebooks that reading leaves out")
    for k in (one, two, three, four, five):
        k.add_argument("path")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("metaquarry").getOrCreate()
    if a.command == "schema":
        spec = Specification.load(spark, a.path, a.xml_schema)
        elements = spec.elements if a.xml_schema else None
        schemas.class_sources(spec.triples, "Thing", elements).write.mode("overwrite").json(f"{a.to}/classes")
        schemas.enumeration_constants(spec.triples).write.mode("overwrite").json(f"{a.to}/enumerations")
        nodes = graph.instances(spec.triples, ontology.UCMIS + "Class").withColumnRenamed("s", "node")
        schemas.class_order(ontology.subclass_links(spec.triples), nodes).write.mode("overwrite").json(f"{a.to}/order")
        return
    if a.command == "audit":
        return _print(left_out(spark.read.text(a.path, wholetext=True), "value").orderBy("element"))
    books = read_codebooks(spark, a.path)
    if a.command == "dictionary":
        tables = normalise(books)
        rows = data_dictionary(tables, a.file, a.name, a.label, a.categories, a.questions)
        if a.stats:
            stats = F.sort_array(F.collect_list(F.struct("value", "type", "text"))).alias("statistics")
            rows = rows.join(category_statistics(tables.categories).groupBy("doc_id", "var_id").agg(stats), ["doc_id", "var_id"], "left")
        _print(rows.orderBy("doc_id", "pos"))
    elif a.command == "dump":
        _print(tree(books, a.max_level).orderBy("doc_id", "path"))
    else:
        found = triples(resources(normalise(books), a.prefix, skos=not a.code_lists))
        {"nt": write_ntriples, "turtle": write_turtle, "json-ld": write_jsonld}[a.format](found, a.to)


if __name__ == "__main__":
    main()
