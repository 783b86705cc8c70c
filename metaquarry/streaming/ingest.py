"""Codebooks and triples as they arrive. Parsing is the same as for files that are there; each batch is appended to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from metaquarry.operators.codebook import normalise
from metaquarry.sources.rdf import parse_ntriples
from metaquarry.sources.xml import parse_codebooks


def codebook_texts(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Whole XML files as they come into a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path, wholetext=True)


def append_codebooks(texts: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Each batch's documents, files, variables, categories and questions go to a folder of their own, named after the batch, so a batch that runs again replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        normalise(parse_codebooks(batch, "value")).write(f"{to}/batch={number}")

    return texts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def triples(spark: SparkSession, path: str, lines_from: int = 1000) -> DataFrame:
    """N-Triples as they come into a folder."""
    return parse_ntriples(spark.readStream.option("maxFilesPerTrigger", lines_from).text(path))
