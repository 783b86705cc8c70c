"""Scalar expressions on names, IRIs, cardinalities and literals. All of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of the vocabularies.
NAMESPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "cdi": "http://ddialliance.org/Specification/DDI-CDI/1.0/RDF/",
    "ucmis": "tag:ddialliance.org,2024:ucmis:",
}
RDF_TYPE = NAMESPACES["rdf"] + "type"
# Names that can't be field names as they are.
RESERVED = ("for", "from", "construct")
# What a literal's range is stored as.
RANGE_TYPES = {
    "xsd:string": "string",
    "xsd:language": "string",
    "xsd:anyURI": "string",
    "xsd:integer": "bigint",
    "xsd:boolean": "boolean",
    "xsd:date": "date",
    "xsd:dateTime": "timestamp",
    "xsd:decimal": "double",
    "xsd:double": "double",
}


def local_tag(tag: Column) -> Column:
    """A tag's name without its namespace in braces."""
    return F.regexp_replace(tag, r"^[^}]*\}", "")


def stripped(text: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def without_tags(text: Column) -> Column:
    """Markup's text: each tag becomes a space, and the ends are trimmed."""
    return stripped(F.regexp_replace(text, "<[^>]*>", " "))


def xml_escaped(text: Column) -> Column:
    """Fit for the text of an element."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\r"), F.lit("&#13;"))


def json_field(text: Column, name: str) -> Column:
    """One top-level field of a JSON object as text."""
    return F.get_json_object(text, f"$['{name}']")


def last_part(name: Column, by: str) -> Column:
    return F.substring_index(name, by, -1)


def first_part(name: Column, by: str) -> Column:
    return F.substring_index(name, by, 1)


def base_name(file: Column) -> Column:
    """A file's name without its extension; leading dots are part of the name."""
    return F.regexp_replace(file, r"(?<=[^/.])\.[^./]*$", "")


def prefixed_uri(iri: Column, namespaces: dict[str, str] | None = None) -> Column:
    """The IRI with the first prefix that it begins with, or as it is."""
    spaces = NAMESPACES if namespaces is None else namespaces
    out = F.coalesce(*[F.when(iri.startswith(space), F.concat(F.lit(p + ":"), F.substring(iri, len(space) + 1, 1 << 30))) for p, space in spaces.items()], iri)
    return out


def full_uri(name: Column, namespaces: dict[str, str] | None = None) -> Column:
    """The other way round: a known prefix is written out."""
    spaces = NAMESPACES if namespaces is None else namespaces
    return F.coalesce(*[F.when(name.startswith(p + ":"), F.concat(F.lit(space), F.substring(name, len(p) + 2, 1 << 30))) for p, space in spaces.items()], name)


def code_slug(value: Column) -> Column:
    """A code's value as part of an IRI: spaces to underscores, then quoted as in a query string."""
    return F.replace(F.replace(F.url_encode(F.replace(value, F.lit(" "), F.lit("_"))), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def cardinality(low: Column, high: Column) -> Column:
    return F.concat(low, F.lit(".."), F.when(high == "unbounded", "*").otherwise(high))


def one_line(text: Column) -> Column:
    """Line ends become spaces, and the ends are trimmed."""
    return stripped(F.replace(text, F.lit("\n"), F.lit(" ")))


def escaped(text: Column) -> Column:
    """Fit for a quoted comment: back-slashes and double quotes are escaped."""
    return F.replace(F.replace(one_line(text), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def indented(text: Column, spaces: int) -> Column:
    pad = F.lit(" " * spaces)
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) == "", x).otherwise(F.concat(pad, x))), "\n")


def field_name(name: Column) -> Column:
    return F.when(name.isin(*RESERVED), F.concat(name, F.lit("_"))).otherwise(name)


def is_list(card: Column) -> Column:
    return F.coalesce(card.endswith("*"), F.lit(False))


def is_optional(card: Column) -> Column:
    return F.coalesce(card.startswith("0"), F.lit(False))


def range_type(range_name: Column, strict: bool = True) -> Column:
    """The storage type of a literal range; references are IRIs, and unknown literal ranges are errors if strict."""
    known = F.coalesce(*[F.when(range_name == k, v) for k, v in RANGE_TYPES.items()])
    unknown = F.raise_error(F.concat(F.lit("no type for range "), range_name)).cast("string") if strict else F.lit(None).cast("string")
    return F.coalesce(known, F.when(range_name.startswith("xsd:"), unknown).otherwise(F.lit("string")))


def field_ddl(name: Column, range_name: Column, card: Column) -> Column:
    """One field of a schema in DDL."""
    kind = range_type(range_name)
    typed = F.when(is_list(card), F.concat(F.lit("array<"), kind, F.lit(">"))).otherwise(kind)
    return F.concat(F.lit("`"), field_name(name), F.lit("` "), typed, F.when(is_optional(card) | is_list(card), F.lit("")).otherwise(F.lit(" NOT NULL")))


def valid_uri(uri: Column) -> Column:
    """http, https and ftp with a host, or a urn with a namespace and a name up to its very end (a line end is no part of it); others are not."""
    web = uri.rlike(r"^(?i)(?:https?|ftp)://[^/?#\s]+")
    urn = uri.rlike(r"^(?i)urn:[a-z0-9][a-z0-9-]{0,31}:[a-z0-9()+,\-.:=@;$_!*'%/?#]+\z")
    return F.coalesce(web | urn, F.lit(False))


def iso_date(text: Column) -> Column:
    return F.try_to_date(text, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(text)


def to_iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def matches_from_start(value: Column, pattern: str) -> Column:
    """Case-insensitive and anchored at the beginning only."""
    return F.coalesce(value.rlike(f"(?i)^(?:{pattern})"), F.lit(False))


def found_in(value: Column, pattern: str) -> Column:
    """Case-insensitive, anywhere."""
    return F.coalesce(value.rlike(f"(?i){pattern}"), F.lit(False))


def typed_value(value: Column, datatype: Column) -> Column:
    """A literal in the columns of its kind: a struct of which one field is set."""
    short = last_part(datatype, "#")
    return F.struct(
        F.when(short.isin("integer", "int", "long"), value.try_cast("bigint")).alias("as_long"),
        F.when(short.isin("decimal", "double", "float"), value.try_cast("double")).alias("as_double"),
        F.when(short == "boolean", value.try_cast("boolean")).alias("as_boolean"),
        F.when(short == "date", value.try_cast("date")).alias("as_date"),
        F.when(short == "dateTime", value.try_cast("timestamp")).alias("as_timestamp"),
        F.when(datatype.isNull() | short.isin("string", "language", "anyURI"), value).alias("as_string"),
    )


def category_of(name: Column, words: tuple[str, ...] = ("Variable", "Agent", "Activity"), other: str = "Other") -> Column:
    """The first of the words that the name contains."""
    return F.coalesce(*[F.when(F.contains(name, F.lit(w)), w) for w in words], F.lit(other))
