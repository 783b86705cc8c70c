"""The driver's tables seen as triples, a class hierarchy, and codebook tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.functions.terms import RDF_TYPE
from metaquarry.operators.codebook import Tables
from metaquarry.operators.convert import unpivoted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iri(kind: str, key: str):
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """regions, nations, suppliers and customers as a graph: names and segments are literals, keys of other tables links."""
    t = lambda name: table(spark, sf_dir, name)
    parts = [
        unpivoted(t("region"), iri("region", "r_regionkey"), "Region", {"name": F.col("r_name")}),
        unpivoted(t("nation"), iri("nation", "n_nationkey"), "Nation", {"name": F.col("n_name")}, {"in": iri("region", "n_regionkey")}),
        unpivoted(t("supplier"), iri("supplier", "s_suppkey"), "Supplier", {"name": F.col("s_name")}, {"in": iri("nation", "s_nationkey")}),
        unpivoted(t("customer"), iri("customer", "c_custkey"), "Customer", {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}, {"in": iri("nation", "c_nationkey")}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The same in SQL.
TRIPLES = f"""t AS (
 SELECT 'region/' || r_regionkey AS s, '{RDF_TYPE}' AS p, 'Region' AS o, 'iri' AS k FROM region
 UNION ALL SELECT 'region/' || r_regionkey, 'name', r_name, 'literal' FROM region
 UNION ALL SELECT 'nation/' || n_nationkey, '{RDF_TYPE}', 'Nation', 'iri' FROM nation
 UNION ALL SELECT 'nation/' || n_nationkey, 'name', n_name, 'literal' FROM nation
 UNION ALL SELECT 'nation/' || n_nationkey, 'in', 'region/' || n_regionkey, 'iri' FROM nation
 UNION ALL SELECT 'supplier/' || s_suppkey, '{RDF_TYPE}', 'Supplier', 'iri' FROM supplier
 UNION ALL SELECT 'supplier/' || s_suppkey, 'name', s_name, 'literal' FROM supplier
 UNION ALL SELECT 'supplier/' || s_suppkey, 'in', 'nation/' || s_nationkey, 'iri' FROM supplier
 UNION ALL SELECT 'customer/' || c_custkey, '{RDF_TYPE}', 'Customer', 'iri' FROM customer
 UNION ALL SELECT 'customer/' || c_custkey, 'name', c_name, 'literal' FROM customer
 UNION ALL SELECT 'customer/' || c_custkey, 'segment', c_mktsegment, 'literal' FROM customer
 UNION ALL SELECT 'customer/' || c_custkey, 'in', 'nation/' || c_nationkey, 'iri' FROM customer)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child, parent: who lies in what."""
    return triples(spark, sf_dir).where("p = 'in'").select(F.col("s").alias("child"), F.col("o").alias("parent"))


LINKS = f"{TRIPLES}, links AS (SELECT s AS child, o AS parent FROM t WHERE p = 'in')"


def codebook(spark: SparkSession, sf_dir: str) -> Tables:
    """parts are variables (in the files of their suppliers), their line items categories, the turns of conversations questions."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
    part = table(spark, sf_dir, "part")
    per = items.groupBy("l_partkey").agg(
        F.count("*").cast("int").alias("n_categories"), F.count_if(F.col("l_linestatus") == "O").cast("int").alias("n_missing"), F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: F.concat(F.lit("F"), x.cast("string"))), " ").alias("files")
    )
    talks = table(spark, sf_dir, "conversations")
    asked = talks.select(F.col("conv_id").alias("q_id")).distinct()
    doc = F.lit("D").alias("doc_id")
    variables = part.join(per, part["p_partkey"] == per["l_partkey"], "left").join(asked, part["p_partkey"] == asked["q_id"], "left").select(
        doc, F.concat(F.lit("V"), F.col("p_partkey").cast("string")).alias("var_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("label"), "files", F.col("p_brand").alias("format_type"),
        F.coalesce("n_categories", F.lit(0)).alias("n_categories"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.col("q_id").isNotNull().alias("has_question"),
    )
    categories = items.select(
        doc, F.concat(F.lit("V"), F.col("l_partkey").cast("string")).alias("var_id"), F.col("l_partkey").alias("var_pos"), F.struct("l_orderkey", "l_linenumber", "l_shipdate").alias("pos"), F.col("l_linenumber").cast("string").alias("value"),
        F.col("l_returnflag").alias("label"), (F.col("l_linestatus") == "O").alias("is_missing"),
    )
    at = lambda k: F.min_by(F.when(F.col("turn") == k, F.col("text")), F.when(F.col("turn") == k, F.struct("role", "text")))
    questions = talks.groupBy("conv_id").agg(at(0).alias("pre"), at(1).alias("literal"), at(2).alias("post"), at(3).alias("instructions")).select(
        doc, F.concat(F.lit("V"), F.col("conv_id").cast("string")).alias("var_id"), "pre", "literal", "post", "instructions", F.lit(None).cast("string").alias("forward"), F.lit(None).cast("string").alias("backward")
    )
    files = table(spark, sf_dir, "supplier").select(
        doc, F.concat(F.lit("F"), F.col("s_suppkey").cast("string")).alias("file_id"), F.col("s_suppkey").alias("pos"), F.concat("s_name", F.lit(".dat")).alias("name"), F.col("s_name").alias("basename"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("n_records"), F.lit(None).cast("string").alias("n_variables")
    )
    docs = table(spark, sf_dir, "documents")
    documents = docs.groupBy(F.col("source").alias("doc_id")).agg(F.min_by("text", "doc_id").alias("title"), F.max_by("text", "doc_id").alias("alt_title")).select("doc_id", "title", F.lit(None).cast("string").alias("sub_title"), "alt_title", F.lit(None).cast("string").alias("abstract"))
    return Tables(documents, files, variables, categories, questions)


VARIABLES = """per AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS m, list_sort(list(DISTINCT l_suppkey)) AS supps FROM lineitem GROUP BY 1),
v AS (SELECT 'V' || p_partkey AS var_id, p_partkey AS pos, p_name AS name, p_type AS label, array_to_string(list_transform(supps, lambda x: 'F' || x), ' ') AS files, p_brand AS format_type, coalesce(n, 0) AS n_categories, coalesce(m, 0) AS n_missing,
 EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = p_partkey) AS has_question FROM part LEFT JOIN per ON l_partkey = p_partkey)"""
