"""One text for every JSON value that means the same."""

from __future__ import annotations

import json
from decimal import Decimal


def _number(x) -> str:
    if isinstance(x, Decimal):
        if not x:
            return "0"
        x = x.normalize()
        if x.as_tuple().exponent < 0 or x.adjusted() > 300:
            return str(x)
        return str(int(x))
    return str(x)


def canonical(value) -> str:
    """Text of a parsed JSON value: keys sorted, nulls dropped from objects, numbers by value, strings quoted."""
    kind = type(value)
    if kind is str:
        return json.dumps(value)
    if value is None or kind is bool:
        return {None: "null", True: "true", False: "false"}[value]
    if kind is dict:
        return "{" + ",".join(f"{json.dumps(k)}:{canonical(v)}" for k, v in sorted(value.items()) if v is not None) + "}"
    if kind is list:
        return "[" + ",".join(map(canonical, value)) + "]"
    return _number(value)


def parser():
    """A function from text to JSON value, numbers exact; null text gives ``None``; broken JSON a marked text of its own."""
    decode = json.JSONDecoder(parse_float=Decimal, parse_constant=str).decode

    def parse(text: str | None):
        if text is None:
            return None
        try:
            return decode(text)
        except (ValueError, RecursionError):
            return ["broken", text]

    return parse
