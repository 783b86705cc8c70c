"""A specification's folder: an ontology as Turtle files and a schema as XML, loaded once and written as Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from metaquarry.sources.rdf import read_jsonld, read_turtle
from metaquarry.sources.xml import read_schema_elements


@dataclass(frozen=True)
class Folders:
    """Where a specification keeps its parts. Paths may be in any store that Spark reads."""

    root: str

    def __post_init__(self):
        if not self.root:
            raise ValueError("a specification needs a root folder")

    @property
    def build(self) -> str:
        return f"{self.root.rstrip('/')}/build"

    @property
    def encoding(self) -> str:
        return f"{self.build}/encoding"

    @property
    def ontology(self) -> str:
        return f"{self.encoding}/ontology"

    @property
    def xml_schema(self) -> str:
        return f"{self.encoding}/xml-schema"

    @property
    def json_ld(self) -> str:
        return f"{self.encoding}/json-ld"

    @property
    def source(self) -> str:
        return f"{self.root.rstrip('/')}/source"


def _present(spark: SparkSession, path: str) -> str:
    """The path, if there is something in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"a specification needs {path}")
    return path


class Specification:
    """triples and elements of a specification. Asking for a part that wasn't loaded is an error."""

    def __init__(self, triples: DataFrame | None, elements: DataFrame | None = None):
        self._triples, self._elements = triples, elements

    @property
    def triples(self) -> DataFrame:
        if self._triples is None:
            raise RuntimeError("the ontology isn't loaded")
        return self._triples

    @property
    def elements(self) -> DataFrame:
        if self._elements is None:
            raise RuntimeError("the schema isn't loaded")
        return self._elements

    @classmethod
    def load(cls, spark: SparkSession, root: str, schema_file: str | None = None) -> "Specification":
        """Reads all Turtle files of the ontology folder, and the schema if there is one. Missing folders are errors."""
        at = Folders(root)
        elements = read_schema_elements(spark, _present(spark, f"{at.xml_schema}/{schema_file}")) if schema_file else None
        return cls(read_turtle(spark, _present(spark, at.ontology)), elements)

    @classmethod
    def load_json_ld(cls, spark: SparkSession, path: str) -> "Specification":
        return cls(read_jsonld(spark, path))

    def write(self, path: str) -> None:
        """Triples by predicate, so that a query reads only the predicates it asks for."""
        self.triples.write.mode("overwrite").partitionBy("p").parquet(f"{path}/triples")
        if self._elements is not None:
            self._elements.write.mode("overwrite").parquet(f"{path}/elements")

    @classmethod
    def read(cls, spark: SparkSession, path: str, with_elements: bool = True) -> "Specification":
        return cls(spark.read.parquet(f"{path}/triples"), spark.read.parquet(f"{path}/elements") if with_elements else None)
