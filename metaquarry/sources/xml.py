"""Codebook XML and XML schemas, read by Spark's XML source with explicit schemas: inference would change with the data."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LABEL = "array<struct<_VALUE: string, `_xml-lang`: string, _lang: string>>"
_STAT = "array<struct<_VALUE: string, _type: string, _otherType: string>>"
_RANGE = "array<struct<range: array<struct<_min: string, _max: string, _minExclusive: string, _maxExclusive: string, _UNITS: string>>, item: array<struct<_VALUE: string, _UNITS: string>>, key: array<string>, notes: array<string>>>"
_CATEGORY = f"array<struct<_ID: string, _missing: string, _missType: string, _country: string, _sdatrefs: string, catValu: string, labl: {_LABEL}, txt: array<string>, catStat: {_STAT}, mrow: string>>"
_CATEGORY_GROUP = f"array<struct<_ID: string, _missing: string, _missType: string, _catgry: string, _catGrp: string, _levelno: string, _levelnm: string, _compl: string, _excls: string, labl: {_LABEL}, catStat: {_STAT}, txt: array<string>>>"
_DERIVATION = "array<struct<_ID: string, _var: string, drvdesc: array<string>, drvcmd: array<struct<_VALUE: string, _syntax: string>>>>"
_QUESTION = "array<struct<_ID: string, _responseDomainType: string, preQTxt: array<string>, qstnLit: array<string>, postQTxt: array<string>, forward: array<string>, backward: array<string>, ivuInstr: array<string>>>"
_VARIABLE = (
    "array<struct<_ID: string, _name: string, _files: string, _wgt: string, `_wgt-var`: string, _dcml: string, _intrvl: string, _rectype: string, _sdatrefs: string, _temporal: string, _geog: string, "
    f"location: array<struct<_StartPos: string, _EndPos: string, _width: string, _RecSegNo: string, _fileid: string>>, labl: {_LABEL}, imputation: array<string>, security: array<string>, embargo: array<string>, "
    f"respUnit: array<string>, anlysUnit: array<string>, qstn: {_QUESTION}, valrng: {_RANGE}, invalrng: {_RANGE}, undocCod: array<string>, universe: array<string>, TotlResp: string, sumStat: {_STAT}, txt: array<string>, "
    f"stdCatgry: array<string>, catgryGrp: {_CATEGORY_GROUP}, catgry: {_CATEGORY}, derivation: {_DERIVATION}, codInstr: array<string>, concept: array<string>, varFormat: struct<_type: string, _formatname: string, _schema: string, _category: string, _VALUE: string>, notes: array<string>>>"
)
_GROUP = f"array<struct<_ID: string, _type: string, _var: string, _varGrp: string, _name: string, labl: {_LABEL}, txt: array<string>, concept: array<string>, defntn: array<string>, universe: array<string>, notes: array<string>>>"
_CUBE = f"array<struct<_ID: string, _name: string, _dmnsQnty: string, _cellQnty: string, labl: {_LABEL}, txt: array<string>, universe: array<string>, dmns: array<struct<_rank: string, _varRef: string>>, measure: array<struct<_varRef: string, _aggrMeth: string, _measUnit: string>>>>"

#: A codebook: the elements that queries use, with their attributes. Others are left out while reading.
CODEBOOK = (
    "_ID string, _version string, "
    "stdyDscr array<struct<_ID: string, citation: array<struct<titlStmt: struct<titl: string, subTitl: array<string>, altTitl: array<string>, parTitl: array<string>, IDNo: array<string>>, "
    "rspStmt: struct<AuthEnty: array<string>>, prodStmt: struct<producer: array<string>, prodDate: array<string>>>>, "
    "stdyInfo: array<struct<subject: array<struct<keyword: array<string>, topcClas: array<string>>>, abstract: array<string>, sumDscr: array<struct<timePrd: array<string>, nation: array<string>, geogCover: array<string>, anlyUnit: array<string>, universe: array<string>>>, notes: array<string>>>>>, "
    "fileDscr array<struct<_ID: string, _URI: string, fileTxt: array<struct<fileName: array<string>, fileCont: array<string>, fileType: array<string>, format: array<string>, "
    "dimensns: struct<caseQnty: array<string>, varQnty: array<string>, logRecL: array<string>, recPrCas: array<string>, recNumTot: array<string>>>>, notes: array<string>>>, "
    f"dataDscr array<struct<_ID: string, varGrp: {_GROUP}, var: {_VARIABLE}, nCubeGrp: {_GROUP}, nCube: {_CUBE}, notes: array<string>>>, "
    "otherMat array<struct<_ID: string, _type: string, _level: string, _URI: string, labl: array<string>, txt: array<string>>>"
)
#: Elements by name that the schema has, whatever stands around them.
KNOWN = sorted(set(re.findall(r"([A-Za-z]\w*): ?(?:array|struct|string)|^(\w+) (?:array|string)|, (\w+) (?:array|string)", CODEBOOK)) | {("codeBook", "", "")})
KNOWN_NAMES = sorted({x for found in KNOWN for x in found if x})
OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "nullValue": "\u0000"}


def read_codebooks(spark: SparkSession, path: str) -> DataFrame:
    """A row for each codebook in the files."""
    return spark.read.format("xml").options(rowTag="codeBook", **OPTIONS).schema(CODEBOOK).load(path)


def parse_codebooks(texts: DataFrame, column: str) -> DataFrame:
    """The same from a column of XML texts."""
    parsed = F.from_xml(F.col(column), CODEBOOK, OPTIONS)
    return texts.select(parsed.alias("c")).select("c.*")


def left_out(texts: DataFrame, column: str) -> DataFrame:
    """element, n: elements in a column of XML texts that CODEBOOK doesn't have, so that reading leaves them out, and how often they are there.

    Comments and CDATA sections are cut away before; all names are found by one expression."""
    plain = F.regexp_replace(F.regexp_replace(F.col(column), r"(?s)<!--.*?-->", ""), r"(?s)<!\[CDATA\[.*?\]\]>", "")
    names = F.regexp_extract_all(plain, F.lit(r"<(?:[A-Za-z_][\w.\-]*+:)?([A-Za-z_][\w.\-]*+)"), F.lit(1))
    rows = texts.select(F.explode(names).alias("element")).where(~F.col("element").isin(KNOWN_NAMES))
    return rows.groupBy("element").agg(F.count("*").alias("n"))


_ELEMENT = "struct<`_xml:id`: string, _id: string, _name: string, _minOccurs: string, _maxOccurs: string"
#: Elements inside a complex type, two levels deep: associations hold an element of their valid types.
_NESTED = f"array<{_ELEMENT}, simpleType: struct<restriction: struct<enumeration: array<struct<_value: string>>>>>>"
_INNER = f"struct<sequence: struct<element: {_NESTED}>, complexContent: struct<extension: struct<sequence: struct<element: {_NESTED}>>>>"
_ELEMENTS = f"array<{_ELEMENT}, complexType: {_INNER}>>"
COMPLEX_TYPE = f"`_xml:id` string, _id string, _name string, sequence struct<element: {_ELEMENTS}>, complexContent struct<extension: struct<_base: string, sequence: struct<element: {_ELEMENTS}>>>"


def read_schema_elements(spark: SparkSession, path: str) -> DataFrame:
    """class, element, min, max, types: what an XML schema's complex types say of their elements and of the elements in those."""
    types = spark.read.format("xml").options(rowTag="complexType", ignoreNamespace="true").schema(COMPLEX_TYPE).load(path)
    name = F.coalesce("`_xml:id`", "_id", "_name")
    none = F.array().cast(_ELEMENTS)
    rows = types.select(F.regexp_replace(name, "XsdType$", "").alias("class"), F.explode(F.concat(F.coalesce("sequence.element", none), F.coalesce("complexContent.extension.sequence.element", none))).alias("e"))
    identity = lambda e: F.coalesce(e["_xml:id"], e["_id"], e["_name"])
    e = F.col("e")
    none = F.array().cast(_NESTED)
    inner = F.concat(F.coalesce("e.complexType.sequence.element", none), F.coalesce("e.complexType.complexContent.extension.sequence.element", none))
    outer = F.struct(identity(e).alias("element"), e["_minOccurs"].alias("min"), e["_maxOccurs"].alias("max"), F.lit(None).cast("array<string>").alias("types"))
    below = F.transform(inner, lambda x: F.struct(identity(x).alias("element"), x["_minOccurs"].alias("min"), x["_maxOccurs"].alias("max"), x["simpleType"]["restriction"]["enumeration"]["_value"].alias("types")))
    return rows.select("class", F.explode(F.concat(F.array(outer), below)).alias("x")).select("class", "x.element", "x.min", "x.max", "x.types").where("element IS NOT NULL")


def mixed_content(column: Column) -> Column:
    """The text of an XML fragment's element with its child elements kept as bare tags, all parts trimmed. Arrow-batched: no built-in walks mixed content."""
    @F.pandas_udf("string")
    def flatten(fragments: pd.Series) -> pd.Series:
        return fragments.map(flat_text, na_action="ignore")

    return flatten(column)


def flat_text(fragment: str) -> str | None:
    try:
        root = ET.fromstring(fragment)
    except ET.ParseError:
        return None
    parts = [(root.text or "").strip()]
    todo = [("in", child) for child in reversed(root)]
    while todo:
        what, x = todo.pop()
        if what == "in":
            parts.append(f"<{x.tag}>{(x.text or '').strip()}")
            todo.append(("out", x))
            todo += [("in", child) for child in reversed(x)]
        else:
            parts.append(f"</{x.tag}>{(x.tail or '').strip()}")
    return "".join(parts)
