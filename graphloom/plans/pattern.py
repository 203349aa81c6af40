"""The graph-pattern language: MATCH / WHERE / RETURN / LIMIT, compiled to a DataFrame plan.

A pattern is one node `(v:Label)` or one hop `(a:L)-[:TYPE]->(b:M)`, label and type being optional. WHERE is
a conjunction of `v.prop OP 'text'` with OP one of = <> CONTAINS STARTS WITH, all ignoring case; a property
compares as text, a missing one as the empty text. What the language does not have is an error, never
a silently different query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..schema import PROPERTIES

DEFAULT_LIMIT = 50


class PatternError(ValueError):
    """A query that the language does not have."""


@dataclass(frozen=True)
class NodeItem:
    variable: str
    label: str | None = None


@dataclass(frozen=True)
class Condition:
    variable: str
    prop: str
    op: str
    value: str


@dataclass(frozen=True)
class ReturnItem:
    variable: str
    prop: str | None = None
    alias: str | None = None

    @property
    def header(self) -> str:
        return self.alias or (f"{self.variable}.{self.prop}" if self.prop else self.variable)


@dataclass(frozen=True)
class Query:
    nodes: tuple[NodeItem, ...]
    hop: bool
    edge_type: str | None
    returns: tuple[ReturnItem, ...]
    conditions: tuple[Condition, ...] = field(default=())
    limit: int | None = None


_TOKEN = re.compile(r"\s*(?:(?P<text>'[^']*'|\"[^\"]*\")|(?P<word>\w+)|(?P<sign><>|->|<-|[-()\[\]:.,=*]))")
_CLAUSES = ("MATCH", "WHERE", "RETURN", "LIMIT")


class _Reader:
    """Tokens with one look ahead."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise PatternError(f"Unexpected text: {text[at : at + 20]}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def keyword(self, word: str) -> bool:
        kind, value = self.peek()
        if kind == "word" and value.upper() == word:
            self.at += 1
            return True
        return False

    def sign(self, value: str) -> bool:
        if self.peek() == ("sign", value):
            self.at += 1
            return True
        return False

    def need(self, value: str, where: str) -> None:
        if not self.sign(value):
            raise PatternError(f"Invalid {where}: '{value}' expected before '{self.peek()[1]}'")

    def name(self, where: str) -> str:
        kind, value = self.peek()
        if kind != "word":
            raise PatternError(f"Invalid {where}: a name expected before '{value}'")
        self.at += 1
        return value


def parse(text: str) -> Query:
    if not text.strip():
        raise PatternError("Empty query")
    r = _Reader(text)
    if not r.keyword("MATCH"):
        raise PatternError("Missing MATCH clause")
    nodes, hop, edge_type = [_node(r)], False, None
    if r.sign("-"):
        hop = True
        r.need("[", "MATCH pattern")
        edge_type = r.name("MATCH pattern") if r.sign(":") else None
        r.need("]", "MATCH pattern")
        r.need("->", "MATCH pattern")
        nodes.append(_node(r))
    conditions: list[Condition] = []
    if r.keyword("WHERE"):
        conditions.append(_condition(r))
        while r.keyword("AND"):
            conditions.append(_condition(r))
    if not r.keyword("RETURN"):
        raise PatternError("Missing RETURN clause" if r.peek()[0] == "end" else f"Invalid MATCH or WHERE at '{r.peek()[1]}'")
    returns = [_return(r)]
    while r.sign(","):
        returns.append(_return(r))
    limit = None
    if r.keyword("LIMIT"):
        digits = re.match(r"\d+", r.peek()[1])
        limit = int(digits[0]) if digits else 0
        if limit <= 0:
            raise PatternError(f"Invalid LIMIT: {r.peek()[1]}")
        r.at += 1
    if r.peek()[0] != "end":
        raise PatternError(f"Unexpected '{r.peek()[1]}'")
    known = {n.variable for n in nodes}
    for items, clause in ((conditions, "WHERE"), (returns, "RETURN")):
        for item in items:
            if item.variable not in known:
                raise PatternError(f"Unknown variable '{item.variable}' in {clause} clause")
    return Query(tuple(nodes), hop, edge_type, tuple(returns), tuple(conditions), limit)


def _node(r: _Reader) -> NodeItem:
    r.need("(", "MATCH pattern")
    item = NodeItem(r.name("MATCH pattern"), r.name("MATCH pattern") if r.sign(":") else None)
    r.need(")", "MATCH pattern")
    return item


def _condition(r: _Reader) -> Condition:
    variable = r.name("WHERE condition")
    r.need(".", "WHERE condition")
    prop = r.name("WHERE condition")
    if r.sign("="):
        op = "="
    elif r.sign("<>"):
        op = "<>"
    elif r.keyword("CONTAINS"):
        op = "CONTAINS"
    elif r.keyword("STARTS") and r.keyword("WITH"):
        op = "STARTS WITH"
    else:
        raise PatternError(f"Invalid WHERE condition at '{r.peek()[1]}'")
    kind, value = r.peek()
    if kind != "text":
        raise PatternError(f"Invalid WHERE condition: quoted text expected before '{value}'")
    r.at += 1
    return Condition(variable, prop, op, value[1:-1])


def _return(r: _Reader) -> ReturnItem:
    variable = r.name("RETURN item")
    prop = r.name("RETURN item") if r.sign(".") else None
    return ReturnItem(variable, prop, r.name("RETURN item") if r.keyword("AS") else None)


def _property(prefix: str, prop: str) -> Column:
    if prop not in PROPERTIES:
        return F.lit("")
    return F.coalesce(F.col(f"{prefix}{PROPERTIES[prop]}").cast("string"), F.lit(""))


def _holds(prefix: str, c: Condition) -> Column:
    text, value = F.lower(_property(prefix, c.prop)), F.lit(c.value.lower())
    return {"=": text == value, "<>": text != value, "CONTAINS": text.contains(value), "STARTS WITH": text.startswith(value)}[c.op]


def _cell(prefix: str, item: ReturnItem) -> Column:
    if item.prop:
        return _property(prefix, item.prop)
    at = [F.col(prefix + c) for c in ("name", "type", "file", "start_line")]
    return F.format_string("%s (%s) @ %s:%d", at[0], at[1], F.coalesce(at[2], F.lit("")), at[3])


def compile_query(query: Query, graph: CodeGraph, default_limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The rows, all cells text, at most `limit` in the graph's order; with a hop in edge order, or in the seed's."""

    def side(prefix: str, n: int) -> DataFrame:
        rows = graph.nodes
        item = query.nodes[n]
        if item.label:
            rows = rows.where(F.col("type") == item.label)
        own = [_holds("", c) for c in query.conditions if c.variable == item.variable]
        rows = rows.where(reduce(lambda a, b: a & b, own)) if own else rows
        return rows.select(*[F.col(c).alias(prefix + c) for c in rows.columns])

    limit = query.limit or default_limit
    if not query.hop:
        rows, order, prefix = side("a_", 0), ["a_node_seq", "a_id"], {query.nodes[0].variable: "a_"}
    else:
        edges = graph.edges.where(F.col("type") == query.edge_type) if query.edge_type else graph.edges
        edges = edges.select("edge_seq", F.col("id").alias("edge_id"), "source_id", "target_id")
        rows = side("a_", 0).join(edges, F.col("a_id") == F.col("source_id")).join(side("b_", 1), F.col("b_id") == F.col("target_id"))
        order = ["edge_seq", "edge_id"]
        for prefix_, n in (("b_", 1), ("a_", 0)):  # the seed is the first side with conditions
            if any(c.variable == query.nodes[n].variable for c in query.conditions):
                order = [f"{prefix_}node_seq", f"{prefix_}id", "edge_seq", "edge_id"]
        prefix = {query.nodes[0].variable: "a_"} | {query.nodes[1].variable: "b_"}  # one name for both is the target
    rows = rows.orderBy(*order).limit(limit)
    return rows.select(*[_cell(prefix[r.variable], r).alias(r.header) for r in query.returns])


def run(text: str, graph: CodeGraph, default_limit: int = DEFAULT_LIMIT) -> DataFrame:
    return compile_query(parse(text), graph, default_limit)


def is_truncated(rows: DataFrame, query: Query, default_limit: int = DEFAULT_LIMIT) -> bool:
    """Whether the limit was reached."""
    return rows.count() >= (query.limit or default_limit)
