"""JSON values compared by value, however they are written."""

from __future__ import annotations

import json
from decimal import Decimal, InvalidOperation



def _flat(value: object) -> str:
    if value is None:
        return "n"
    if value is True or value is False:
        return "t" if value else "f"
    if isinstance(value, Decimal):
        if not value:
            return "#0"
        sign, digits, exponent = value.as_tuple()
        body = "".join(map(str, digits)).rstrip("0")
        return f"#{'-' * sign}{body}e{exponent + len(digits) - len(body)}"
    if isinstance(value, str):
        return json.dumps(value)
    if isinstance(value, list):
        return "[" + ",".join(map(_flat, value)) + "]"
    return "{" + ",".join(f"{json.dumps(k)}:{_flat(v)}" for k, v in sorted(value.items())) + "}"


def _refuse(text: str) -> None:
    raise ValueError(text)


def canonical_json(text: str | None) -> str:
    """A string that two texts share exactly when they are the same JSON value.

    Object keys in any order, blanks, escapes and spellings of numbers (7200, 7200.00, 72e2) make no difference; of
    repeated keys the last counts. Null is a value of its own, and a text that is not JSON equals only itself
    (without outer blanks).
    """
    if text is None:
        return "!"
    try:
        return _flat(json.loads(text, parse_float=Decimal, parse_int=Decimal, parse_constant=_refuse))
    except (ValueError, InvalidOperation, RecursionError):
        return "?" + text.strip()
