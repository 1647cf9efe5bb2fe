"""The SQL dialect: a tokenizer and a recursive-descent parser to QuerySpec.

    query     = SELECT [DISTINCT] (attributes | *) FROM table {, table} [WHERE condition {, condition}]
                [GROUPBY attributes] [ORDERBY attributes [ASC | DESC]]
    condition = attribute op (attribute | "literal")          a comma between conditions means AND
    attribute = table.column | MAX(attribute) | MIN(..) | SUM(..) | COUNT(..) | AVG(..)

Keywords are upper case only, so ``from`` and ``to`` are names. Literals are always double-quoted and taken
raw; the type of the column decides what they mean.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from quillon.plans.spec import AGGREGATES, Attr, Cond, QueryError, QuerySpec

KEYWORDS = frozenset({"SELECT", "DISTINCT", "FROM", "WHERE", "GROUPBY", "ORDERBY", "ASC", "DESC", *AGGREGATES})
_LEXEME = re.compile(r'(?P<blank>\s+)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|"(?P<literal>(?:[^"\\]|\\.)*)"|(?P<op><=|>=|!=|<|>|=)|(?P<mark>[*,().])')


class Token(NamedTuple):
    kind: str  # keyword, name, literal, op, mark or end
    text: str
    at: int


def tokenize(text: str) -> list[Token]:
    tokens, at = [], 0
    while at < len(text):
        m = _LEXEME.match(text, at)
        if not m:
            raise QueryError(f"unexpected character {text[at]!r} at {at}")
        kind = m.lastgroup
        if kind == "word":
            tokens.append(Token("keyword" if m[0] in KEYWORDS else "name", m[0], at))
        elif kind != "blank":
            tokens.append(Token(kind, m[kind], at))
        at = m.end()
    return [*tokens, Token("end", "the end", at)]


class _Parser:
    def __init__(self, text: str):
        self.tokens = tokenize(text)
        self.at = 0

    @property
    def next(self) -> Token:
        return self.tokens[self.at]

    def take(self, kind: str, text: str | None = None) -> Token | None:
        token = self.next
        if token.kind != kind or (text is not None and token.text != text):
            return None
        self.at += 1
        return token

    def need(self, kind: str, text: str | None = None) -> Token:
        token = self.take(kind, text)
        if token is None:
            raise QueryError(f"expected {text or kind}, found {self.next.text!r} at {self.next.at}")
        return token

    def listed(self, item) -> tuple:
        items = [item()]
        while self.take("mark", ","):
            items.append(item())
        return tuple(items)

    def attribute(self) -> Attr:
        token = self.next
        if token.kind == "keyword" and token.text in AGGREGATES:
            self.at += 1
            self.need("mark", "(")
            inner = self.attribute()
            self.need("mark", ")")
            if inner.aggregate:
                raise QueryError(f"{token.text} of an aggregate at {token.at}")
            return Attr(inner.table, inner.column, token.text)
        table = self.need("name").text
        self.need("mark", ".")
        return Attr(table, self.need("name").text)

    def condition(self) -> Cond:
        left = self.attribute()
        op = self.need("op").text
        literal = self.take("literal")
        return Cond(left, op, literal.text if literal else self.attribute())

    def query(self) -> QuerySpec:
        self.need("keyword", "SELECT")
        distinct = bool(self.take("keyword", "DISTINCT"))
        select = () if self.take("mark", "*") else self.listed(self.attribute)
        self.need("keyword", "FROM")
        tables = self.listed(lambda: self.need("name").text)
        where = self.listed(self.condition) if self.take("keyword", "WHERE") else ()
        group_by = self.listed(self.attribute) if self.take("keyword", "GROUPBY") else ()
        order_by, ascending = (), True
        if self.take("keyword", "ORDERBY"):
            order_by = self.listed(self.attribute)
            ascending = not self.take("keyword", "DESC")
            if ascending:
                self.take("keyword", "ASC")
        self.need("end")
        return QuerySpec(select, tables, where, group_by, order_by, ascending, distinct)


def parse(text: str) -> QuerySpec:
    return _Parser(text).query()
