"""A query language for graphs, as far as metadata queries use it, planned as joins of triple patterns.

SELECT [DISTINCT] variables, (COUNT(?x) AS ?n); PREFIX; patterns with `a`, `;`, `,` and `[]`; `p*` paths; OPTIONAL;
FILTER with regex, CONTAINS, LCASE, str, = and !=; FILTER NOT EXISTS; GROUP BY; ORDER BY [DESC]; LIMIT.
Values never become part of a query's text: patterns turn into comparisons with literals.
"""

from __future__ import annotations

import re
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaquarry.functions.terms import NAMESPACES, RDF_TYPE
from metaquarry.operators import graph

_TOKEN = re.compile(r"\s+|#[^\n]*|(<[^>]*>|\?\w+|\"(?:[^\"\\]|\\.)*\"|!=|\d+|[A-Za-z][\w-]*:[\w.-]*|:[\w.-]+|[A-Za-z]+|\[\]|[{}().;,*=])")


class QueryError(ValueError):
    pass


class _Query:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at : at + 20]!r}")
            if m[1]:
                self.tokens.append(m[1])
            at = m.end()
        self.at, self.names, self.prefixes = 0, count(), dict(NAMESPACES)

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def word(self) -> str:
        return self.peek().upper()

    def take(self, *wanted: str) -> str:
        token = self.peek()
        if wanted and token.upper() not in wanted:
            raise QueryError(f"expected {' or '.join(wanted)}, found {token!r}")
        self.at += 1
        return token

    def term(self) -> tuple[str, str]:
        """("var", name) or ("value", text)."""
        t = self.take()
        if t.startswith("?"):
            return "var", t[1:]
        if t == "[]":
            return "var", f"_anonymous{next(self.names)}"
        if t.startswith("<"):
            return "value", t[1:-1]
        if t.startswith('"'):
            return "value", re.sub(r"\\(.)", r"\1", t[1:-1])
        if t == "a":
            return "value", RDF_TYPE
        if ":" in t:
            prefix, _, local = t.partition(":")
            if prefix not in self.prefixes:
                raise QueryError(f"no prefix {prefix!r}")
            return "value", self.prefixes[prefix] + local
        raise QueryError(f"unexpected {t!r}")


def select(triples: DataFrame, text: str) -> DataFrame:
    """The query's rows, a column for each selected variable."""
    q = _Query(text)
    while q.word() == "PREFIX":
        q.take()
        name = q.take().partition(":")[0]
        q.prefixes[name] = q.take()[1:-1]
    q.take("SELECT")
    distinct = q.word() == "DISTINCT" and bool(q.take())
    columns: list[tuple[str, str | None]] = []
    while q.word() not in ("WHERE", "{"):
        if q.peek() == "(":
            q.take("("), q.take("COUNT"), q.take("(")
            over = q.take()
            q.take(")"), q.take("AS")
            columns.append((q.take()[1:], over.lstrip("?") or "*"))
            q.take(")")
        else:
            columns.append((q.take()[1:], None))
    if q.word() == "WHERE":
        q.take()
    rows = _group(q, triples, None)
    keys: list[str] = []
    if q.word() == "GROUP":
        q.take(), q.take("BY")
        while q.peek().startswith("?"):
            keys.append(q.take()[1:])
    if any(over for _, over in columns):
        counted = [F.count("*" if over == "*" else over).alias(name) for name, over in columns if over]
        rows = rows.groupBy(*keys).agg(*counted)
    rows = rows.select(*[name for name, _ in columns])
    if distinct:
        rows = rows.distinct()
    if q.word() == "ORDER":
        q.take(), q.take("BY")
        order: list[Column] = []
        while q.peek().startswith("?") or q.word() in ("DESC", "ASC"):
            if q.peek().startswith("?"):
                order.append(F.asc(q.take()[1:]))
            else:
                way = F.desc if q.take().upper() == "DESC" else F.asc
                q.take("(")
                order.append(way(q.take()[1:]))
                q.take(")")
        rows = rows.orderBy(*order)
    if q.word() == "LIMIT":
        q.take()
        rows = rows.limit(int(q.take()))
    if q.peek():
        raise QueryError(f"unexpected {q.peek()!r}")
    return rows


def _group(q: _Query, triples: DataFrame, rows: DataFrame | None) -> DataFrame:
    q.take("{")
    filters: list[Column] = []
    absent: list[DataFrame] = []
    while q.peek() != "}":
        if q.word() == "OPTIONAL":
            q.take()
            more = _group(q, triples, None)
            rows = more if rows is None else _join(rows, more, "left")
        elif q.word() == "FILTER":
            q.take()
            if q.word() == "NOT":
                q.take(), q.take("EXISTS")
                absent.append(_group(q, triples, None))
            else:
                filters.append(_filter(q))
        elif q.peek() == "{":
            more = _group(q, triples, None)
            rows = more if rows is None else _join(rows, more, "inner")
        else:
            rows = _patterns(q, triples, rows)
        while q.peek() == ".":
            q.take()
    q.take("}")
    if rows is None:
        raise QueryError("a group without a pattern")
    for x in absent:
        rows = _join(rows, x, "left_anti")
    for f in filters:
        rows = rows.where(f)
    return rows


def _join(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise QueryError("groups that share no variable")
    return a.join(b, shared, how)


def _patterns(q: _Query, triples: DataFrame, rows: DataFrame | None) -> DataFrame:
    s = q.term()
    while True:
        p = q.term()
        star = q.peek() == "*" and bool(q.take())
        while True:
            o = q.term()
            more = _star(triples, s, p[1], o) if star else _pattern(triples, s, p, o)
            rows = more if rows is None else _join(rows, more, "inner")
            if q.peek() != ",":
                break
            q.take()
        if q.peek() != ";":
            return rows
        q.take()


def _pattern(triples: DataFrame, s: tuple, p: tuple, o: tuple) -> DataFrame:
    rows, out, seen = triples, [], {}
    for column, (kind, value) in (("s", s), ("p", p), ("o", o)):
        if kind == "value":
            rows = rows.where(F.col(column) == value)
        elif value in seen:
            rows = rows.where(F.col(column) == F.col(seen[value]))
        else:
            seen[value] = column
            out.append(F.col(column).alias(value))
    return rows.select(*out, *([] if out else [F.lit(True).alias("_found")])).distinct()


def _star(triples: DataFrame, s: tuple, p: str, o: tuple) -> DataFrame:
    """p*: the node itself and all that it reaches."""
    links = graph.edges(triples, p)
    spark = triples.sparkSession
    if o[0] == "value" and s[0] == "var":
        return graph.descendants(links, o[1]).unionByName(spark.createDataFrame([(o[1],)], "node string")).withColumnRenamed("node", s[1])
    if s[0] == "value" and o[0] == "var":
        return graph.ancestors(links, s[1]).unionByName(spark.createDataFrame([(s[1],)], "node string")).withColumnRenamed("node", o[1])
    if s[0] == "var" and o[0] == "var":
        far = graph.closure(links).select(F.col("child").alias(s[1]), F.col("ancestor").alias(o[1]))
        nodes = triples.select(F.col("s").alias("n")).union(triples.where("o_kind <> 'literal'").select("o")).distinct()
        return far.unionByName(nodes.select(F.col("n").alias(s[1]), F.col("n").alias(o[1])))
    raise QueryError("a path between two values")


def _filter(q: _Query) -> Column:
    bare = q.peek() == "("
    if bare:
        q.take()
    left = _expression(q)
    if q.peek() in ("=", "!="):
        same = q.take() == "="
        right = _expression(q)
        left = left == right if same else left != right
    if bare:
        q.take(")")
    return left


def _expression(q: _Query) -> Column:
    word = q.word()
    if word in ("REGEX", "CONTAINS", "LCASE", "UCASE", "STR"):
        q.take(), q.take("(")
        parts = [_expression(q)]
        while q.peek() == ",":
            q.take()
            if word == "REGEX":
                parts.append(q.term()[1])
            else:
                parts.append(_expression(q))
        q.take(")")
        if word == "REGEX":
            flags = parts[2] if len(parts) > 2 else ""
            return parts[0].rlike(("(?i)" if "i" in flags else "") + parts[1])
        return {"CONTAINS": lambda: F.contains(*parts), "LCASE": lambda: F.lower(parts[0]), "UCASE": lambda: F.upper(parts[0]), "STR": lambda: parts[0]}[word]()
    kind, value = q.term()
    return F.col(value) if kind == "var" else F.lit(value)
