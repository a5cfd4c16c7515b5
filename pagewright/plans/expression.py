"""The rule language of extraction programs, compiled into Columns.

``value`` and ``len`` are compared with ``== != > < >= <=``, texts with ``matches /regex/``; ``&& || !`` and parentheses
join them. Logic has two values: a comparison of unlike types is false, and ``!=`` of unlike types is true. ``!`` binds to
the term right after it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LEX = re.compile(r"\s*(?:(?P<op>==|!=|>=|<=|&&|\|\||[><!()])|(?P<text>'[^']*'|\"[^\"]*\")|(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<word>[A-Za-z_]\w*)|(?P<slash>/)|(?P<minus>-))")
COMPARE = {"==", "!=", ">", "<", ">=", "<="}


class RuleError(ValueError):
    """The rule is not well formed."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str


def lex(source: str) -> list[Token]:
    """Tokens of a rule. A slash opens a regex and a minus a number only where a term may begin."""
    out: list[Token] = []
    at = 0
    while at < len(source):
        if not source[at:].strip():
            break
        m = LEX.match(source, at)
        if not m:
            raise RuleError(f"unexpected {source[at:].strip()[:1]!r} in {source!r}")
        term = not out or out[-1].text in COMPARE | {"&&", "||", "!", "(", "matches"} and out[-1].kind in ("op", "word")
        kind, at = m.lastgroup, m.end()
        if kind == "slash":
            body = re.compile(r"((?:[^/\\\n]|\\.)*)/([a-z]*)").match(source, at)
            if not term or not body:
                raise RuleError(f"unexpected '/' in {source!r}")
            flags = "".join(f for f in body[2] if f in "ims")
            out.append(Token("regex", (f"(?{flags})" if flags else "") + body[1].replace("\\/", "/")))
            at = body.end()
        elif kind == "minus":
            number = re.compile(r"\d+(?:\.\d+)?|\.\d+").match(source, at)
            if not term or not number:
                raise RuleError(f"unexpected '-' in {source!r}")
            out.append(Token("number", "-" + number[0]))
            at = number.end()
        else:
            out.append(Token(kind, m[kind][1:-1] if kind == "text" else m[kind]))
    return out


def parse(source: str) -> tuple:
    """The rule as a tree: (or|and, left, right), (not, x), (operator, left, right), (value|len), (text|number|bool|regex|null, x)."""
    tokens = lex(source)
    at = 0

    def peek() -> Token:
        return tokens[at] if at < len(tokens) else Token("end", "")

    def take() -> Token:
        nonlocal at
        at += 1
        return tokens[at - 1] if at <= len(tokens) else Token("end", "")

    def binary(op: str, name: str, below):
        node = below()
        while peek().kind == "op" and peek().text == op:
            take()
            node = (name, node, below())
        return node

    def comparison():
        left = unary()
        t = peek()
        if (t.kind == "op" and t.text in COMPARE) or (t.kind == "word" and t.text == "matches"):
            take()
            return (t.text, left, unary())
        return left

    def unary():
        if peek() == Token("op", "!"):
            take()
            return ("not", unary())
        t = take()
        if t == Token("op", "("):
            node = binary("||", "or", lambda: binary("&&", "and", comparison))
            if take() != Token("op", ")"):
                raise RuleError(f"missing ')' in {source!r}")
            return node
        if t.kind in ("text", "regex"):
            return (t.kind, t.text)
        if t.kind == "number":
            return ("number", float(t.text))
        if t.kind == "word":
            if t.text in ("value", "len"):
                return (t.text,)
            if t.text in ("true", "false"):
                return ("bool", t.text == "true")
            if t.text in ("null", "undefined"):
                return ("null", None)
        raise RuleError(f"unexpected {t.text or 'end'!r} in {source!r}")

    node = binary("||", "or", lambda: binary("&&", "and", comparison))
    if at < len(tokens):
        raise RuleError(f"unexpected {tokens[at].text!r} in {source!r}")
    return node


def compile_rule(source: str, value: Column, kind: str = "string") -> Column:
    """The rule as a boolean Column, never null. ``kind``: declared type of ``value`` (string, number, integer, boolean)."""
    number, boolean = kind in ("number", "integer"), kind == "boolean"
    types = {"text": "text", "number": "number", "bool": "bool", "null": "null", "len": "number", "value": "number" if number else "bool" if boolean else "text"}

    def operand(node: tuple) -> tuple[str, Column]:
        name = node[0]
        if name == "value":
            return types["value"], value.cast("double") if number else value
        if name == "len":
            return "number", F.length(value.cast("string")).cast("double")
        if name == "null":
            return "null", F.lit(None)
        if name in ("text", "number", "bool", "regex"):
            return types.get(name, name), F.lit(node[1])
        return "bool", logic(node)

    def truthy(node: tuple) -> Column:
        kind_, c = operand(node)
        if kind_ == "null":
            return F.lit(False)
        if kind_ == "regex":
            return F.lit(True)
        return F.coalesce({"bool": c, "number": (c != 0) & ~F.isnan(c) if kind_ == "number" else c, "text": c != "" if kind_ == "text" else c}[kind_], F.lit(False))

    def logic(node: tuple) -> Column:
        name = node[0]
        if name == "or":
            return truthy(node[1]) | truthy(node[2])
        if name == "and":
            return truthy(node[1]) & truthy(node[2])
        if name == "not":
            return ~truthy(node[1])
        if name not in COMPARE | {"matches"}:
            return truthy(node)
        (a, x), (b, y) = operand(node[1]), operand(node[2])
        if name == "matches":
            return F.coalesce(F.rlike(x, y), F.lit(False)) if (a, b) == ("text", "regex") else F.lit(False)
        if name in ("==", "!="):
            if "null" in (a, b):
                same = (x.isNull() if b == "null" else y.isNull()) if a != b else F.lit(True)
            else:
                same = F.coalesce(x == y, F.lit(False)) if a == b else F.lit(False)
            return same if name == "==" else ~same
        if (a, b) != ("number", "number"):
            return F.lit(False)
        return F.coalesce({">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[name], F.lit(False))

    return truthy(parse(source))


def check_rule(source: str) -> str | None:
    """What is wrong with a rule, None if nothing."""
    try:
        parse(source)
        return None
    except RuleError as e:
        return str(e)
