"""Codebooks as tables: documents, files, variables, categories, questions; and the dictionary queries on them.

Each table comes from one codebook row by exploding nested arrays, with positions kept. Reading XML costs far more
than any query, so `normalise` is meant to be written once and the queries to run over the written tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaquarry.functions.terms import base_name, matches_from_start
from metaquarry.operators.graph import last_wins


@dataclass
class Tables:
    documents: DataFrame
    files: DataFrame
    variables: DataFrame
    categories: DataFrame
    questions: DataFrame

    def write(self, path: str) -> None:
        for name, df in vars(self).items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark, path: str) -> "Tables":
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in cls.__dataclass_fields__])


def _first(column: str) -> Column:
    """The first element, null if there is none."""
    return F.get(F.col(column), 0)


def normalise(codebooks: DataFrame) -> Tables:
    """codebooks: rows of sources.xml.CODEBOOK."""
    doc = F.col("_ID").alias("doc_id")
    title = _first("stdyDscr")["citation"]
    documents = codebooks.select(
        doc,
        F.get(title, 0)["titlStmt"]["titl"].alias("title"),
        F.get(F.get(title, 0)["titlStmt"]["subTitl"], 0).alias("sub_title"),
        F.get(F.get(title, 0)["titlStmt"]["altTitl"], 0).alias("alt_title"),
        F.get(F.get(_first("stdyDscr")["stdyInfo"], 0)["abstract"], 0).alias("abstract"),
    )
    files = codebooks.select(doc, F.posexplode("fileDscr").alias("pos", "f"))
    text = F.get(F.col("f.fileTxt"), 0)
    name = F.get(text["fileName"], 0)
    files = files.select(
        "doc_id", F.col("f._ID").alias("file_id"), "pos", name.alias("name"), base_name(name).alias("basename"), F.get(text["fileCont"], 0).alias("content"),
        F.get(text["dimensns"]["caseQnty"], 0).alias("n_records"), F.get(text["dimensns"]["varQnty"], 0).alias("n_variables"),
    )
    sections = codebooks.select(doc, F.posexplode("dataDscr").alias("section", "d"))
    items = sections.select("doc_id", "section", F.posexplode("d.var").alias("at", "v"))
    items = items.select(
        "doc_id", F.col("v._ID").alias("var_id"), (F.col("section").cast("long") * (1 << 32) + F.col("at")).alias("pos"), "v", F.coalesce(F.size("v.catgry"), F.lit(0)).alias("n_categories")
    )
    variables = items.select(
        "doc_id", "var_id", "pos", F.col("v._name").alias("name"), F.get("v.labl", F.lit(0))["_VALUE"].alias("label"), F.col("v._files").alias("files"), F.col("v.varFormat._type").alias("format_type"), "n_categories",
        F.coalesce(F.size(F.filter("v.catgry", lambda c: F.coalesce(c["_missing"], F.lit("N")) == "Y")), F.lit(0)).alias("n_missing"),
        (F.coalesce(F.size("v.qstn"), F.lit(0)) > 0).alias("has_question"), F.transform("v.sumStat", lambda s: F.struct(s["_type"].alias("type"), s["_VALUE"].alias("value"))).alias("statistics"),
    )
    categories = items.select("doc_id", "var_id", F.col("pos").alias("var_pos"), F.posexplode("v.catgry").alias("pos", "c")).select(
        "doc_id", "var_id", "var_pos", "pos", F.col("c.catValu").alias("value"), F.get("c.labl", F.lit(0))["_VALUE"].alias("label"), (F.coalesce(F.col("c._missing"), F.lit("N")) == "Y").alias("is_missing"),
        F.transform("c.catStat", lambda s: F.struct(s["_type"].alias("type"), s["_VALUE"].alias("value"))).alias("statistics"),
    )
    q = F.get("v.qstn", F.lit(0))
    questions = items.where(F.size("v.qstn") > 0).select(
        "doc_id", "var_id", F.get(q["preQTxt"], 0).alias("pre"), F.get(q["qstnLit"], 0).alias("literal"), F.get(q["postQTxt"], 0).alias("post"), F.get(q["forward"], 0).alias("forward"),
        F.get(q["backward"], 0).alias("backward"), F.get(q["ivuInstr"], 0).alias("instructions"),
    )
    return Tables(documents, files, variables, categories, questions)


def in_file(files: Column, file_id: str, strict: bool = False) -> Column:
    """Whether a variable's list of files names the file. strict: any part of the list's text will do."""
    if strict:
        return F.coalesce(F.contains(files, F.lit(file_id)), F.lit(False))
    return F.coalesce(F.array_contains(F.split(F.trim(files), r"\s+"), file_id), F.lit(False))


def search(variables: DataFrame, file_id: str | None = None, name: str | None = None, label: str | None = None, has_categories: bool | None = None, has_question: bool | None = None, strict: bool = False, name_part: str | None = None) -> DataFrame:
    """Variables by file, by patterns from the start of name and label, by a part of the name in any case, and by whether they have categories or a question. strict: only the file counts."""
    if file_id is not None:
        variables = variables.where(in_file(F.col("files"), file_id, strict))
    if strict:
        return variables
    if name is not None:
        variables = variables.where(matches_from_start(F.col("name"), name))
    if name_part is not None:
        variables = variables.where(F.contains(F.lower("name"), F.lit(name_part.lower())))
    if label is not None:
        variables = variables.where(matches_from_start(F.col("label"), label))
    if has_categories is not None:
        variables = variables.where((F.col("n_categories") > 0) == has_categories)
    if has_question is not None:
        variables = variables.where(F.col("has_question") == has_question)
    return variables


def category_lists(categories: DataFrame) -> DataFrame:
    """doc_id, var_id, categories: (value, label) in order; those with neither are left out."""
    some = categories.where("value IS NOT NULL OR label IS NOT NULL")
    pairs = F.sort_array(F.collect_list(F.struct("pos", "value", "label")))
    return some.groupBy("doc_id", "var_id").agg(F.transform(pairs, lambda x: F.struct(x["value"].alias("value"), x["label"].alias("label"))).alias("categories"))


def data_dictionary(tables: Tables, file_id: str | None = None, name: str | None = None, label: str | None = None, categories: bool = False, questions: bool = False, strict: bool = False) -> DataFrame:
    """One row for each variable; of those with one id the last in the document stays. categories and questions add a column each."""
    rows = search(tables.variables, file_id, None, None, strict=strict)
    rows = search(rows, name=name, label=label)
    rows = last_wins(rows, ["doc_id", "var_id"], ["pos"]).select("doc_id", "var_id", "pos", "name", "label", "n_categories", "has_question")
    if categories:
        rows = rows.join(category_lists(tables.categories), ["doc_id", "var_id"], "left")
    if questions:
        asked = tables.questions.select("doc_id", "var_id", F.struct("pre", "literal", "post", "instructions", "forward", "backward").alias("question"))
        rows = rows.join(asked, ["doc_id", "var_id"], "left")
    return rows


def category_counts(categories: DataFrame, key: list[str]) -> DataFrame:
    """Categories of each variable: n_categories, n_missing, n_non_missing."""
    n, missing = F.count("*"), F.count_if("is_missing")
    return categories.groupBy(*key).agg(n.alias("n_categories"), missing.alias("n_missing"), (n - missing).alias("n_non_missing"))


def category_statistics(categories: DataFrame) -> DataFrame:
    """doc_id, var_id, value, label, type, text, number: the statistics that the codebook gives for each category; number is null where text isn't one."""
    return categories.select("doc_id", "var_id", "value", "label", F.explode("statistics").alias("x")).select("doc_id", "var_id", "value", "label", F.coalesce("x.type", F.lit("freq")).alias("type"), F.col("x.value").alias("text"), F.col("x.value").try_cast("double").alias("number"))


def summary_statistics(variables: DataFrame, types: list[str]) -> DataFrame:
    """doc_id, var_id and a column for each type: the summary statistics that the codebook gives for each variable, the greatest of several."""
    rows = variables.select("doc_id", "var_id", F.explode("statistics").alias("x"))
    return rows.groupBy("doc_id", "var_id").agg(*[F.max(F.when(F.col("x.type") == t, F.col("x.value").try_cast("double"))).alias(t) for t in types])


def type_distribution(variables: DataFrame) -> DataFrame:
    """How many variables have each format type; `unknown` without one."""
    return variables.groupBy(F.coalesce("format_type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def report(tables: Tables) -> DataFrame:
    """One row for each document: title, and how many files, variables, categories and questions it has."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    out = tables.documents.select("doc_id", "title")
    for df, name in ((tables.files, "n_files"), (tables.variables, "n_variables"), (tables.categories, "n_categories"), (tables.questions, "n_questions")):
        out = out.join(count(df, name), "doc_id", "left")
    return out.fillna(0, ["n_files", "n_variables", "n_categories", "n_questions"])
