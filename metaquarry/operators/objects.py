"""Triples to typed rows: fields by a registry, and references followed by joins.

A registry tells for each class its fields: field, rdf_term, is_list, refers_to (the class of a nested object, or none
to keep the IRI). Fields come from one conditional aggregation per class; references are joins planned from the
registry, as deep as it goes or to max_depth, beyond which a reference stays an IRI, so cyclic graphs end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaquarry.functions.terms import RDF_TYPE
from metaquarry.operators import graph


@dataclass(frozen=True)
class Field:
    name: str
    term: str
    is_list: bool = False
    refers_to: str | None = None
    kind: str = "string"


@dataclass(frozen=True)
class Class:
    iri: str
    fields: tuple[Field, ...]
    parent: str | None = None


class Registry:
    def __init__(self, classes: Sequence[Class]):
        self.by_iri = {c.iri: c for c in classes}
        self.order = [c.iri for c in classes]

    def class_for(self, iri: str) -> Class | None:
        return self.by_iri.get(iri)

    def below(self, base: str) -> list[str]:
        """The base class, if it is there, and all classes under it, in the registry's order."""
        out, found = {base}, True
        while found:
            found = {c.iri for c in self.by_iri.values() if c.parent in out} - out
            out |= found
        return [c for c in self.order if c in out]

    def depth(self, cls: str, above: tuple[str, ...] = ()) -> int:
        """How deep references go from a class, to where one refers back to a class above it."""
        if cls in above or cls not in self.by_iri:
            return 0
        return max((1 + self.depth(f.refers_to, (*above, cls)) for f in self.by_iri[cls].fields if f.refers_to), default=0)

    def first_match(self, types: Column) -> Column:
        """Of a subject's types, the first that the registry has."""
        return F.coalesce(*[F.when(F.array_contains(types, c), c) for c in self.order], F.lit(None).cast("string"))


def typed_subjects(triples: DataFrame, registry: Registry, root_types: list[str] | None = None) -> DataFrame:
    """s, type: typed subjects with their class, null if the registry has none of their types."""
    rows = graph.pattern(triples, p=RDF_TYPE)
    if root_types is not None:
        rows = rows.join(graph.subjects(triples, root_types), "s", "left_semi")
    return rows.groupBy("s").agg(F.collect_set("o").alias("types")).select("s", registry.first_match(F.col("types")).alias("type"))


def typed_below(triples: DataFrame, registry: Registry, base: str) -> DataFrame:
    """s, type: typed subjects with the first of their classes that is the base or lies below it, null where none does."""
    wanted = registry.below(base)
    types = graph.pattern(triples, p=RDF_TYPE).groupBy("s").agg(F.collect_set(F.when(F.col("o").isin(wanted), F.col("o"))).alias("types"))
    return types.select("s", F.coalesce(*[F.when(F.array_contains("types", c), c) for c in wanted], F.lit(None).cast("string")).alias("type"))


def rejects(triples: DataFrame, registry: Registry, root_types: list[str] | None = None) -> DataFrame:
    """Subjects that can't become objects, and why."""
    return typed_subjects(triples, registry, root_types).where("type IS NULL").select("s", F.lit("no class for its types").alias("reason"))


def _cast(value: Column, kind: str) -> Column:
    return value if kind == "string" else value.try_cast(kind)


def flat(triples: DataFrame, cls: Class, subjects: DataFrame) -> DataFrame:
    """s and the class's fields for the given subjects: lists in order, of other fields the least value."""
    terms = [f.term for f in cls.fields]
    rows = triples.where(F.col("p").isin(terms)).join(subjects.select("s"), "s", "left_semi")
    at = lambda f: F.when(F.col("p") == f.term, _cast(F.col("o"), f.kind))
    found = rows.groupBy("s").agg(*[(F.sort_array(F.collect_set(at(f))) if f.is_list else F.min(at(f))).alias(f.name) for f in cls.fields])
    return subjects.select("s").join(found, "s", "left")


def objects(triples: DataFrame, registry: Registry, cls: str, max_depth: int | None = None) -> DataFrame:
    """Rows of one class, references nested as deep as the registry goes (or to max_depth): s and its fields."""
    typed = typed_subjects(triples, registry)
    return _nested(triples, registry, typed, cls, registry.depth(cls) if max_depth is None else max_depth)


def _nested(triples: DataFrame, registry: Registry, typed: DataFrame, cls: str, depth: int) -> DataFrame:
    own = registry.class_for(cls)
    if own is None:
        raise ValueError(f"no class for {cls}")
    rows = flat(triples, own, typed.where(F.col("type") == cls))
    for f in own.fields:
        if f.refers_to is None or depth == 0:
            continue
        inner = _nested(triples, registry, typed, f.refers_to, depth - 1)
        value = inner.select(F.col("s").alias("ref_"), F.struct(*inner.columns).alias("object_"))
        refs = rows.select("s", (F.explode_outer(f.name) if f.is_list else F.col(f.name)).alias("ref_"))
        joined = refs.join(value, "ref_", "left").select("s", F.struct(F.col("ref_").alias("iri"), F.col("object_").alias("object")).alias("x"))
        told = joined.where("x.iri IS NOT NULL").groupBy("s").agg((F.array_sort(F.collect_list("x")) if f.is_list else F.first("x")).alias("x"))
        rows = rows.drop(f.name).join(told.withColumnRenamed("x", f.name), "s", "left")
    return rows.select("s", *[f.name for f in own.fields])


def deserialize(triples: DataFrame, registry: Registry, root_types: list[str] | None = None, max_depth: int | None = None) -> dict[str, DataFrame]:
    """For each class of the registry (or each of root_types) its objects."""
    return {c: objects(triples, registry, c, max_depth) for c in registry.order if root_types is None or c in root_types}


def one(triples: DataFrame, registry: Registry, s: str, max_depth: int | None = None, base: str | None = None) -> DataFrame:
    """The object of one subject; no row if it has no type. Types without a class are an error, or no row if a base class is asked for."""
    types = graph.objects(triples, s, RDF_TYPE)
    has = {r["o"] for r in types.where(F.col("o").isin(registry.order)).distinct().collect()}  # as many as the registry has, at most
    nothing = triples.sparkSession.createDataFrame([], "s string")
    if not has and types.isEmpty():
        return nothing
    found = [c for c in (registry.order if base is None else registry.below(base)) if c in has]
    if not found and base is not None:
        return nothing
    if not found:
        raise ValueError(f"no class for the types of {s}")
    return objects(triples, registry, found[0], max_depth).where(F.col("s") == s)
