"""RDF text in and out: N-Triples, Turtle, JSON-LD, RDF/XML. Triples have the columns of operators.graph.

N-Triples and flat JSON-LD are parsed and written by expressions alone. Others need a parser; a file is one row of an Arrow batch, so
files are read in parallel and a file never meets the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from urllib.parse import urljoin, uses_netloc, uses_relative
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.functions.terms import NAMESPACES, RDF_TYPE
from metaquarry.operators.graph import COLUMNS, SCHEMA

XSD = NAMESPACES["xsd"]
RDF = NAMESPACES["rdf"]
_IRI, _LABEL = r"<[^\x00-\x20<>\"{}|^`]*+>", r"_:\w(?:[\w.\-·]*[\w\-·])?"
_HEAD = rf"^[ \t]*+({_IRI}|{_LABEL})[ \t]*+({_IRI})[ \t]*+"
_END = r"[ \t]*+\.[ \t]*+(?:#.*)?$"
_NODE, _SUFFIX = rf"^({_IRI}|{_LABEL}){_END}", rf"^(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*+)|\^\^({_IRI}))?{_END}"
_BAD_ESCAPE = r"\\(?!(?:[tbnrf'\"\\]|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}))"
_NOTHING = r"^\s*+(?:#.*)?$"
_AT_ONCE = 50_000  # triples that a worker hands over in one go
_ARROW = pa.schema([(c, pa.string()) for c in COLUMNS])


def _parts(lines: DataFrame, column: str) -> DataFrame:
    """value, head (matched), rest (after the head), and of literals the body between the quotes and the tail after them. No pattern has to walk through a literal."""
    rows = lines.select(F.col(column).alias("value")).withColumn("head", F.regexp_extract("value", _HEAD, 0)).withColumn("rest", F.when(F.col("head") != "", F.substring(F.col("value"), F.length("head") + 1, F.length("value"))))
    masked = F.replace(F.replace(F.col("rest"), F.lit("\\\\"), F.lit("__")), F.lit('\\"'), F.lit("__"))  # as long as before
    rows = rows.withColumn("masked", F.when(F.col("rest").startswith('"'), masked)).withColumn("close", F.expr("locate('\"', masked, 2)"))
    whole = F.col("close") > 0
    rows = rows.withColumn("body", F.when(whole, F.substring(F.col("rest"), F.lit(2), F.col("close") - 2))).withColumn("tail", F.when(whole, F.substring(F.col("rest"), F.col("close") + 1, F.length("rest"))))
    bad = F.substring(F.col("masked"), F.lit(2), F.col("close") - 2).rlike(_BAD_ESCAPE)
    is_literal = F.coalesce(F.col("tail").rlike(_SUFFIX) & ~bad, F.lit(False))
    return rows.withColumn("kind", F.when(is_literal, "literal").when(F.col("rest").rlike(_NODE), "node")).drop("masked", "close")


def _unescaped(text: Column) -> Column:
    """Escapes of N-Triples undone, from left to right: the text is cut at its back-slashes, of which a doubled one stands for itself."""
    code = lambda x, n: F.decode(F.unhex(F.lpad(F.substring(x, 2, n), 8, "0")), "UTF-32")
    one = lambda x: (
        F.when(x.rlike("^u[0-9A-Fa-f]{4}"), F.concat(code(x, 4), F.substring(x, 6, 1 << 30)))
        .when(x.rlike("^U[0-9A-Fa-f]{8}"), F.concat(code(x, 8), F.substring(x, 10, 1 << 30)))
        .otherwise(F.concat(F.translate(F.substring(x, 1, 1), "tbnrf", "\t\b\n\r\f"), F.substring(x, 2, 1 << 30)))
    )
    pieces = lambda x: F.split(x, r"\\", -1)
    undone = lambda x: F.array_join(F.transform(pieces(x), lambda y, i: F.when(i == 0, y).otherwise(one(y))), "")
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(F.split(text, r"\\\\", -1), undone), "\\")).otherwise(text)


def _escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, escape in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(char), F.lit(escape))
    return out


def _term(raw: Column) -> Column:
    return F.when(raw.startswith("<"), _unescaped(F.substring(raw, 2, F.length(raw) - 2))).otherwise(raw)


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Triples of lines, which may end in a comment. Blank lines and comments have none; `ntriples_rejects` has all other lines.

    A line's parts are found once: what isn't a triple goes by an explode, for a filter would be pushed down and find them again."""
    literal, node = F.col("kind") == "literal", F.regexp_extract("rest", _NODE, 1)
    datatype, lang = F.regexp_extract("tail", _SUFFIX, 2), F.regexp_extract("tail", _SUFFIX, 1)
    triple = F.struct(
        _term(F.regexp_extract("head", _HEAD, 1)).alias("s"),
        _term(F.regexp_extract("head", _HEAD, 2)).alias("p"),
        F.when(literal, _unescaped(F.col("body"))).otherwise(_term(node)).alias("o"),
        F.when(literal, "literal").when(F.col("rest").startswith("<"), "iri").otherwise("bnode").alias("o_kind"),
        F.when(literal & (datatype != ""), _term(datatype)).alias("o_datatype"),
        F.when(literal & (lang != ""), lang).alias("o_lang"),
    )
    found = F.when(F.col("kind").isNotNull(), F.array(triple)).otherwise(F.array().cast("array<struct<s: string, p: string, o: string, o_kind: string, o_datatype: string, o_lang: string>>"))
    return _parts(lines, column).select(F.explode(found).alias("t")).select("t.*")


def ntriples_rejects(lines: DataFrame, column: str = "value") -> DataFrame:
    """value, reason: lines that are neither triples nor blank nor comments."""
    return _parts(lines, column).where(F.col("kind").isNull() & ~F.col("value").rlike(_NOTHING)).select("value", F.lit("not a triple").alias("reason"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def ntriples_line(s: Column, p: Column, o: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    node = lambda x: F.when(x.startswith("_:"), x).otherwise(F.concat(F.lit("<"), x, F.lit(">")))
    suffix = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise("")
    value = F.when(kind == "literal", F.concat(F.lit('"'), _escaped(o), F.lit('"'), suffix)).otherwise(node(o))
    return F.concat_ws(" ", node(s), F.concat(F.lit("<"), p, F.lit(">")), value, F.lit("."))


def ntriples(triples: DataFrame) -> DataFrame:
    """value: a line for each triple."""
    return triples.select(ntriples_line(*[F.col(c) for c in COLUMNS]).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples(triples).write.mode("overwrite").text(path)


_TOKEN = re.compile(
    r"""(?:\s+|\#[^\n]*)*+(?:(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<directive>@prefix\b|@base\b|PREFIX\b|BASE\b)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<typed>\^\^)
    |(?P<bnode>_:[\w.-]*\w)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[A-Za-zÀ-￿][\w.-]*)?:(?:[\w:%-](?:[\w:%.\\-]*[\w:%-])?)?)
    |(?P<word>a\b|true\b|false\b)
    |(?P<mark>[.;,\[\]()])
    |(?P<end>\Z))""",
    re.VERBOSE,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)


def _plain(text: str) -> str:
    if "\\" not in text:
        return text
    simple = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else simple.get(m[1], m[1]), text)


_SIMPLE = re.compile(r"[A-Za-z0-9_~-][A-Za-z0-9_~.-]*(?:/[A-Za-z0-9_~-][A-Za-z0-9_~.-]*)*")


@lru_cache(1024)
def _folder(base: str) -> str:
    """What a simple reference is put after."""
    return _resolved(base, "x")[:-1]


def resolved(base: str, ref: str) -> str:
    """A reference in the light of a base, by the rules for URIs; of any scheme, and as it is without a base."""
    return _folder(base) + ref if base and _SIMPLE.fullmatch(ref) else _resolved(base, ref)


def _resolved(base: str, ref: str) -> str:
    if not base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", ref):
        return ref
    scheme, _, rest = base.partition(":")
    if not ref or ref.startswith("#"):
        return base.partition("#")[0] + ref
    if scheme in uses_relative and scheme in uses_netloc:
        return urljoin(base, ref)
    return scheme + urljoin("http:" + rest, ref).removeprefix("http") if rest.startswith("/") else base.partition("#")[0].rpartition("/")[0] + "/" * ("/" in rest) + ref


class TurtleError(ValueError):
    pass


class Turtle:
    """Triples of one Turtle text. Blank nodes are named after `scope`, so files don't share them."""

    def __init__(self, text: str, scope: str, base: str = ""):
        self.scope, self.made, self.base, self.out = scope, 0, base, []
        self.prefixes: dict[str, str] = {}
        self.tokens: list[tuple[str, str]] = []
        at, following = 0, _TOKEN.scanner(text).match
        while m := following():
            kind = m.lastgroup
            self.tokens.append((kind, m[kind]))
            at = m.end()
            if kind == "end":
                break
        else:
            raise TurtleError(f"unexpected text at {at}: {text[at : at + 30]!r}")
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def take(self, *wanted: str) -> str:
        kind, text = self.tokens[self.at]
        if kind == "end":
            raise TurtleError(f"expected {' or '.join(wanted) or 'more'}, found the end")
        if wanted and kind not in wanted and text not in wanted:
            raise TurtleError(f"expected {' or '.join(wanted)}, found {text!r}")
        self.at += 1
        return text

    def blank(self) -> str:
        self.made += 1
        return f"_:{self.scope}x{self.made}"

    def iri(self) -> str:
        kind, text = self.peek()
        self.take("iri", "name")
        if kind == "iri":
            inner = _plain(text[1:-1])
            return resolved(self.base, inner)
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise TurtleError(f"no prefix {prefix!r}")
        return self.prefixes[prefix] + local.replace("\\", "")

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            if self.peek()[0] == "directive":
                word = self.take()
                if word.lower().endswith("prefix"):
                    prefix = self.take("name").rstrip(":")
                    self.prefixes[prefix] = self.iri()
                else:
                    self.base = self.iri()
                if word.startswith("@"):
                    self.take(".")
            else:
                alone = self.peek()[1] == "["
                subject = self.node()[0]
                if not (alone and self.peek()[1] == "."):
                    self.properties(subject)
                self.take(".")
        return self.out

    def properties(self, subject: str) -> None:
        while True:
            predicate = RDF_TYPE if self.peek()[1] == "a" and self.take() else self.iri()
            while True:
                self.out.append((subject, predicate, *self.node()))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
            if self.tokens[self.at - 1][1] != ";" or self.peek()[1] in (".", "]"):
                return

    def node(self) -> tuple[str, str, str | None, str | None]:
        """A term as o, o_kind, o_datatype, o_lang."""
        kind, text = self.peek()
        if kind in ("iri", "name"):
            return self.iri(), "iri", None, None
        self.take()
        if kind == "bnode":
            return f"_:{self.scope}{text[2:]}", "bnode", None, None
        if text == "[":
            own = self.blank()
            if self.peek()[1] != "]":
                self.properties(own)
            self.take("]")
            return own, "bnode", None, None
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.take(")")
            cells = [self.blank() for _ in items]
            ends = [*cells[1:], RDF + "nil"]
            for cell, item, following in zip(cells, items, ends):
                self.out.append((cell, RDF + "first", *item))
                self.out.append((cell, RDF + "rest", following, "iri" if following == RDF + "nil" else "bnode", None, None))
            return (cells[0], "bnode", None, None) if cells else (RDF + "nil", "iri", None, None)
        if kind in ("string", "long"):
            cut = 3 if kind == "long" else 1
            value = _plain(text[cut:-cut])
            following = self.peek()[0]
            if following == "lang":
                return value, "literal", None, self.take()[1:]
            if following == "typed":
                self.take()
                return value, "literal", self.iri(), None
            return value, "literal", None, None
        if kind == "number":
            return text, "literal", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), None
        if text in ("true", "false"):
            return text, "literal", XSD + "boolean", None
        raise TurtleError(f"unexpected {text!r}")


def _parsed(texts: DataFrame, column: str, parse: Callable[[str, str], list[tuple]]) -> DataFrame:
    """Triples that a parser finds in each text, given a scope for its blank nodes. Those of many short texts go back together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text is not None:
                    rows += parse(text, "b" + blake2b(text.encode(), digest_size=6).hexdigest())
                if len(rows) >= _AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=_ARROW)

    return texts.select(F.col(column).cast("string")).hint("rebalance").mapInArrow(run, SCHEMA)  # small files of many short texts would be few tasks


def parse_turtle(texts: DataFrame, column: str = "value") -> DataFrame:
    """Triples of a column of Turtle texts, each a graph of its own."""
    return _parsed(texts, column, lambda text, scope: Turtle(text, scope).parse()).dropDuplicates(list(COLUMNS))


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """The union of all Turtle files that the path (a folder's *.ttl, a file or a pattern) names."""
    files = spark.read.option("pathGlobFilter", "*.ttl").text(path, wholetext=True)
    return parse_turtle(files)


def read_jsonld(spark: SparkSession, path: str) -> DataFrame:
    """Triples of JSON-LD files, expanded (an array of nodes) or compact (a context and a graph or one node)."""
    return parse_jsonld(spark.read.text(path, wholetext=True))


def parse_jsonld(texts: DataFrame, column: str = "value") -> DataFrame:
    """Triples of a column of JSON-LD texts. Expanded ones without nested nodes are read by expressions alone."""
    text = F.col(column)
    flat = text.rlike(r"^\s*\[") & ~F.contains(text, F.lit('"@context"'))
    return _expanded(texts.where(flat), column).unionByName(parse_compact_jsonld(texts.where(~flat), column)).dropDuplicates(list(COLUMNS))


def _expanded(texts: DataFrame, column: str) -> DataFrame:
    nodes = texts.select(F.explode(F.from_json(column, "array<map<string,string>>")).alias("node"))
    rows = nodes.select(F.col("node")["@id"].alias("s"), F.explode("node").alias("p", "v"))
    typed = rows.where("p = '@type'").select("s", F.lit(RDF_TYPE).alias("p"), F.explode(F.from_json("v", "array<string>")).alias("o"))
    typed = typed.select("s", "p", "o", F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    value = "array<struct<`@id`: string, `@value`: string, `@type`: string, `@language`: string>>"
    rest = rows.where("NOT startswith(p, '@')").select("s", "p", F.explode(F.from_json("v", value)).alias("v"))
    is_node = F.col("v.@id").isNotNull()
    rest = rest.select(
        "s", "p", F.coalesce("v.@id", "v.@value").alias("o"), F.when(is_node & F.col("v.@id").startswith("_:"), "bnode").when(is_node, "iri").otherwise("literal").alias("o_kind"),
        F.col("v.@type").alias("o_datatype"), F.col("v.@language").alias("o_lang"),
    )
    return typed.unionByName(rest)


class JsonLd:
    """Triples of one JSON-LD document with its own context: prefixes, terms, @vocab, @base, typed and listed terms, nested nodes."""

    def __init__(self, text: str, scope: str):
        self.scope, self.made, self.out = scope, 0, []
        self.terms: dict[str, dict] = {}
        self.vocab = self.base = ""
        found = json.loads(text)
        for x in found if isinstance(found, list) else [found]:
            self.context(x.get("@context") if isinstance(x, dict) else None)
            for node in x["@graph"] if isinstance(x, dict) and "@graph" in x else [x]:
                self.node(node)

    def context(self, told) -> None:
        for x in told if isinstance(told, list) else [told]:
            if isinstance(x, dict):
                self.vocab, self.base = x.get("@vocab", self.vocab), x.get("@base", self.base)
                self.terms |= {k: {"@id": v} if isinstance(v, str) else v or {} for k, v in x.items() if not k.startswith("@")}

    def iri(self, name: str, of_term: bool = False) -> str:
        if name.startswith("_:"):
            return f"_:{self.scope}{name[2:]}"
        if of_term and name in self.terms and self.terms[name].get("@id", name) != name:
            return self.iri(self.terms[name]["@id"], True)
        prefix, colon, rest = name.partition(":")
        if colon and prefix in self.terms and not rest.startswith("//"):
            return self.iri(self.terms[prefix]["@id"], True) + rest
        if colon:
            return name
        return self.vocab + name if of_term else resolved(self.base, name)

    def node(self, x: dict) -> str:
        if "@id" in x:
            own = self.iri(x["@id"])
        else:
            self.made += 1
            own = f"_:{self.scope}n{self.made}"
        for k, v in x.items():
            values = v if isinstance(v, list) else [v]
            if k in ("@type", "a") or self.terms.get(k, {}).get("@id") == "@type":
                self.out += [(own, RDF_TYPE, self.iri(t, True), "iri", None, None) for t in values]
            elif not k.startswith("@"):
                p, how = self.iri(k, True), self.terms.get(k, {})
                if how.get("@container") == "@list":
                    values = [{"@list": values}]
                self.out += [(own, p, *self.value(y, how)) for y in values if y is not None]
        return own

    def value(self, y, how: dict) -> tuple:
        if isinstance(y, dict) and "@list" in y:
            cells = [self.value(z, how) for z in y["@list"]]
            names = [f"_:{self.scope}n{self.made + i + 1}" for i in range(len(cells))]
            self.made += len(cells)
            for name, cell, rest in zip(names, cells, [*names[1:], RDF + "nil"]):
                self.out += [(name, RDF + "first", *cell), (name, RDF + "rest", rest, "iri" if rest == RDF + "nil" else "bnode", None, None)]
            return (names[0], "bnode", None, None) if names else (RDF + "nil", "iri", None, None)
        if isinstance(y, dict) and "@value" in y:
            return self.literal(y["@value"], self.iri(y["@type"], True) if "@type" in y else None, y.get("@language"))
        if isinstance(y, dict):
            o = self.node(y)
            return o, "bnode" if o.startswith("_:") else "iri", None, None
        if how.get("@type") in ("@id", "@vocab"):
            o = self.iri(str(y), how["@type"] == "@vocab")
            return o, "bnode" if o.startswith("_:") else "iri", None, None
        return self.literal(y, self.iri(how["@type"], True) if "@type" in how else None, how.get("@language"))

    def literal(self, y, datatype: str | None, lang: str | None) -> tuple:
        if isinstance(y, bool):
            return str(y).lower(), "literal", datatype or XSD + "boolean", None
        if isinstance(y, int):
            return str(y), "literal", datatype or XSD + "integer", None
        if isinstance(y, float):
            return str(y), "literal", datatype or XSD + "double", None
        return y, "literal", datatype, lang


def parse_compact_jsonld(texts: DataFrame, column: str = "value") -> DataFrame:
    """Triples of JSON-LD texts that need their context; each is a graph of its own. Texts that aren't JSON have none."""

    def found(text: str, scope: str) -> list[tuple]:
        try:
            return JsonLd(text, scope).out
        except json.JSONDecodeError:
            return []

    return _parsed(texts, column, found)


_XML_LANG, _XML_BASE = "{http://www.w3.org/XML/1998/namespace}lang", "{http://www.w3.org/XML/1998/namespace}base"


class RdfXml:
    """Triples of one RDF/XML document: typed nodes, property attributes, references, collections, literals and nested nodes."""

    def __init__(self, text: str, scope: str):
        self.scope, self.made, self.out = scope, 0, []
        root = ElementTree.fromstring(text)
        base = root.get(_XML_BASE, "")
        for x in root if root.tag == f"{{{RDF}}}RDF" else [root]:
            self.node(x, base, root.get(_XML_LANG))

    def blank(self) -> str:
        self.made += 1
        return f"_:{self.scope}x{self.made}"

    @staticmethod
    def name(tag: str) -> str:
        return tag.replace("{", "", 1).replace("}", "", 1)

    def node(self, x, base: str, lang: str | None) -> str:
        base, lang = x.get(_XML_BASE, base), x.get(_XML_LANG, lang)
        at = {self.name(k): v for k, v in x.attrib.items() if not k.startswith("{http://www.w3.org/XML/")}
        if RDF + "about" in at:
            own = resolved(base, at.pop(RDF + "about"))
        elif RDF + "ID" in at:
            own = resolved(base, "#" + at.pop(RDF + "ID"))
        else:
            own = f"_:{self.scope}{at.pop(RDF + 'nodeID')}" if RDF + "nodeID" in at else self.blank()
        if self.name(x.tag) != RDF + "Description":
            self.out.append((own, RDF_TYPE, self.name(x.tag), "iri", None, None))
        for p, v in at.items():
            self.out.append((own, p, resolved(base, v), "iri", None, None) if p == RDF_TYPE else (own, p, v, "literal", None, lang))
        for i, child in enumerate((c for c in x), 1):
            p = self.name(child.tag)
            self.property(own, f"{RDF}_{i}" if p == RDF + "li" else p, child, base, lang)
        return own

    def property(self, s: str, p: str, x, base: str, lang: str | None) -> None:
        base, lang = x.get(_XML_BASE, base), x.get(_XML_LANG, lang)
        at = {self.name(k): v for k, v in x.attrib.items() if not k.startswith("{http://www.w3.org/XML/")}
        kind = at.pop(RDF + "parseType", None)
        to = lambda o: self.out.append((s, p, o, "bnode" if o.startswith("_:") else "iri", None, None))
        if RDF + "resource" in at:
            to(resolved(base, at[RDF + "resource"]))
        elif RDF + "nodeID" in at:
            to(f"_:{self.scope}{at[RDF + 'nodeID']}")
        elif kind == "Literal":
            self.out.append((s, p, (x.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in x), "literal", RDF + "XMLLiteral", None))
        elif kind == "Collection":
            items = [self.node(c, base, lang) for c in x]
            cells = [self.blank() for _ in items]
            for cell, item, rest in zip(cells, items, [*cells[1:], RDF + "nil"]):
                self.out.append((cell, RDF + "first", item, "bnode" if item.startswith("_:") else "iri", None, None))
                self.out.append((cell, RDF + "rest", rest, "iri" if rest == RDF + "nil" else "bnode", None, None))
            to(cells[0] if cells else RDF + "nil")
        elif kind == "Resource":
            own = self.blank()
            to(own)
            for c in x:
                self.property(own, self.name(c.tag), c, base, lang)
        elif len(x):
            to(self.node(x[0], base, lang))
        elif set(at) - {RDF + "datatype"}:
            own = self.blank()
            to(own)
            self.out += [(own, k, v, "literal", None, lang) for k, v in at.items() if k != RDF + "datatype"]
        else:
            datatype = at.get(RDF + "datatype")
            self.out.append((s, p, x.text or "", "literal", datatype, None if datatype else lang))


def parse_rdf_xml(texts: DataFrame, column: str = "value") -> DataFrame:
    """Triples of a column of RDF/XML texts, each a graph of its own."""
    return _parsed(texts, column, lambda text, scope: RdfXml(text, scope).out).dropDuplicates(list(COLUMNS))


def read_rdf_xml(spark: SparkSession, path: str) -> DataFrame:
    """The union of all RDF/XML files that the path names."""
    return parse_rdf_xml(spark.read.text(path, wholetext=True))


def rdf_xml(triples: DataFrame) -> DataFrame:
    """value: an rdf:Description element for each subject, with a namespace of its own for each property."""
    text = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")), F.lit("\r"), F.lit("&#13;"))
    node = lambda c, word: F.concat(F.when(c.startswith("_:"), F.concat(F.lit(' rdf:nodeID="'), F.substring(c, 3, 1 << 30))).otherwise(F.concat(F.lit(f' rdf:{word}="'), text(c))), F.lit('"'))
    space = F.regexp_extract("p", r"^(.*?)([\p{L}_][\p{L}\p{N}_.\-]*)$", 1)
    name = F.regexp_extract("p", r"^(.*?)([\p{L}_][\p{L}\p{N}_.\-]*)$", 2)
    kind = F.coalesce(F.concat(F.lit(' xml:lang="'), "o_lang", F.lit('"')), F.concat(F.lit(' rdf:datatype="'), text(F.col("o_datatype")), F.lit('"')), F.lit(""))
    literal = F.concat(kind, F.lit(">"), text(F.col("o")), F.lit("</p:"), name, F.lit(">"))
    item = F.concat(F.lit("<p:"), name, F.lit(' xmlns:p="'), text(space), F.lit('"'), F.when(F.col("o_kind") == "literal", literal).otherwise(F.concat(node(F.col("o"), "resource"), F.lit("/>"))))
    per = triples.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items"))
    return per.select(F.concat(F.lit(f'<rdf:RDF xmlns:rdf="{RDF}"><rdf:Description'), node(F.col("s"), "about"), F.lit(">"), "items", F.lit("</rdf:Description></rdf:RDF>")).alias("value"))


def _quoted(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'^\{"x":(.*)\}$', 1)


def jsonld(triples: DataFrame) -> DataFrame:
    """value: a JSON object for each subject, in expanded form."""
    value = F.when(F.col("o_kind") == "literal", F.to_json(F.struct(F.col("o").alias("@value"), F.col("o_datatype").alias("@type"), F.col("o_lang").alias("@language")))).otherwise(F.to_json(F.struct(F.col("o").alias("@id"))))
    is_type = F.col("p") == RDF_TYPE
    item = F.when(is_type, _quoted(F.col("o"))).otherwise(value)
    per = triples.groupBy("s", F.when(is_type, "@type").otherwise(F.col("p")).alias("p")).agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("items"))
    fields = F.array_join(F.array_sort(F.collect_list(F.concat(_quoted(F.col("p")), F.lit(":["), F.col("items"), F.lit("]")))), ",")
    return per.groupBy("s").agg(fields.alias("f")).select(F.concat(F.lit('{"@id":'), _quoted(F.col("s")), F.lit(","), F.col("f"), F.lit("}")).alias("value"))


def turtle(triples: DataFrame) -> DataFrame:
    """value: a block of Turtle for each subject, with full IRIs."""
    node = lambda x: F.when(x.startswith("_:"), x).otherwise(F.concat(F.lit("<"), x, F.lit(">")))
    suffix = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise("")
    value = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), suffix)).otherwise(node(F.col("o")))
    verb = F.when(F.col("p") == RDF_TYPE, "a").otherwise(F.concat(F.lit("<"), "p", F.lit(">")))
    per = triples.groupBy("s", verb.alias("verb")).agg(F.array_join(F.array_sort(F.collect_list(value)), ", ").alias("values"))
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "verb", "values"))), " ;\n    ")
    return per.groupBy("s").agg(lines.alias("lines")).select(F.concat(node(F.col("s")), F.lit(" "), "lines", F.lit(" .")).alias("value"))


def write_turtle(triples: DataFrame, path: str) -> None:
    turtle(triples).write.mode("overwrite").text(path, lineSep="\n")


def write_jsonld(triples: DataFrame, path: str) -> None:
    jsonld(triples).write.mode("overwrite").text(path)
