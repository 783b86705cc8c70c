"""Resources and codebooks as JSON and as rows of a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaquarry.operators.graph import statistics


def write_resources_json(resources: DataFrame, path: str) -> None:
    resources.write.mode("overwrite").json(path)


def statistics_json(triples: DataFrame) -> DataFrame:
    """One row, value: {"n_triples", "types": {name: {"count"}}, "properties": {name: {"count"}}}. As many names as the vocabulary has."""
    rows = statistics(triples)
    block = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", F.struct(F.col("n").alias("count")))))))
    out = rows.agg(F.max(F.when(F.col("kind") == "triples", F.col("n"))).alias("n_triples"), block("type").alias("types"), block("property").alias("properties"))
    return out.select(F.to_json(F.struct(F.coalesce("n_triples", F.lit(0)).alias("n_triples"), "types", "properties")).alias("value"))


def tree(codebooks: DataFrame, max_level: int | None = None) -> DataFrame:
    """doc_id, path, level, value: a row for each element's text and attribute that is there, by the schema. Only down to max_level if given; of level 0 there is none.

    The files are read once: one expression, made from the schema, gathers a codebook's rows in an array."""
    row = "array<struct<path: string, level: int, value: string>>"
    none = F.array().cast(row)

    def below(x: Column, kind: T.DataType, path: Column, level: int) -> Column:
        if max_level is not None and level > max_level:
            return none
        if isinstance(kind, T.ArrayType):
            each = F.transform(x, lambda y, i: below(y, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), level))
            return F.coalesce(F.flatten(each), none)
        if isinstance(kind, T.StructType):
            deeper = [below(x[f.name], f.dataType, F.concat(path, F.lit(f"/{f.name}")), level + 1) for f in kind.fields if max_level is None or level < max_level]
            return F.when(x.isNotNull(), F.concat(*deeper)).otherwise(none) if deeper else none
        return F.when(x.isNotNull(), F.array(F.struct(path.alias("path"), F.lit(level).alias("level"), x.cast("string").alias("value")))).otherwise(none)

    parts = [below(F.col(f.name), f.dataType, F.lit(f"/{f.name}"), 1) for f in codebooks.schema.fields]
    return codebooks.select(F.col("_ID").alias("doc_id"), F.explode(F.concat(*parts)).alias("x")).select("doc_id", "x.path", "x.level", "x.value")
