"""Strict JSON on the executors.

A text counts as JSON only if it is one complete RFC 8259 value: no NaN or Infinity, nothing after
the value.  Of members with the same name the last one holds.
"""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal, InvalidOperation


class RawNumber(str):
    """A JSON number kept as its text."""

    __slots__ = ()


def _refuse(word: str):
    raise ValueError(f"{word} is not JSON")



def parse(text):
    """(True, value) with numbers as RawNumber, or (False, None) for null, broken or too deep texts."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text, parse_float=RawNumber, parse_int=RawNumber, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False, None


def clean(text: str) -> str:
    """Lone surrogates, which escapes can bring in and UTF-8 cannot hold, become U+FFFD."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def as_text(value) -> str:
    """A member's value as text: '' for null, strings as they are, numbers and booleans as in JSON,
    lists and objects as compact JSON with sorted members."""
    if value is None:
        return ""
    if value is True:
        return "true"
    if value is False:
        return "false"
    if isinstance(value, str):
        return clean(value)
    return clean(_compact(value))


def _compact(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + _compact(value[k]) for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_compact, value)) + "]"
    if isinstance(value, RawNumber):
        return str(value)
    return json.dumps(value, ensure_ascii=False)


def comparable(value):
    """A hashable form in which two JSON values are equal exactly if they are the same value:
    member order is ignored, list order is kept, true is not 1, and 1, 1.0 and 1e0 are one number."""
    if isinstance(value, dict):
        return ("o", frozenset((k, comparable(v)) for k, v in value.items()))
    if isinstance(value, list):
        return ("l", tuple(comparable(v) for v in value))
    if isinstance(value, RawNumber):
        try:
            d = Decimal(str(value))
            return ("n", d.as_tuple() if not d.is_finite() else d)
        except InvalidOperation:
            return ("n", str(value))
    if isinstance(value, bool):
        return ("b", value)
    if value is None:
        return ("z",)
    return ("s", value)


def digest(text: str | None) -> bytes | None:
    """128 bits of a text's JSON value, the same for texts of one value in the sense of `comparable`; None if
    it is not JSON."""
    if text is None:
        return None
    try:
        if "\\u0000" in text:
            own = "\x01" + "".join(comparable_text(json.loads(text, parse_float=RawNumber, parse_int=RawNumber, parse_constant=_refuse)))
        else:
            # No string of this text can hold U+0000, so it marks numbers, and the value is written out at once.
            own = json.dumps(json.loads(text, parse_float=_marked, parse_int=_marked, parse_constant=_refuse), sort_keys=True)
    except (ValueError, RecursionError):
        return None
    return hashlib.blake2b(own.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _marked(number: str) -> str:
    return "\x00" + plain_number(number)


def plain_number(number: str) -> str:
    """One spelling for each number: sign, digits without zeros at either end, exponent."""
    if number.isdigit() or number[1:].isdigit():
        sign, digits, exponent = int(number[0] == "-"), number.lstrip("-"), 0
    else:
        try:
            d = Decimal(number)
        except InvalidOperation:
            return number
        if not d.is_finite():
            return number
        sign, parts, exponent = d.as_tuple()
        digits = "".join(map(str, parts))
    cut = digits.strip("0")
    return f"{sign},{cut},{exponent + len(digits) - len(digits.rstrip('0'))}" if cut else "0"


def comparable_text(value):
    """The pieces of a text that two JSON values share exactly if `comparable` finds them equal."""
    if isinstance(value, dict):
        yield "{"
        for k in sorted(value):
            yield json.dumps(k) + ":"
            yield from comparable_text(value[k])
            yield ","
        yield "}"
    elif isinstance(value, list):
        yield "["
        for v in value:
            yield from comparable_text(v)
            yield ","
        yield "]"
    elif isinstance(value, RawNumber):
        yield f"n{plain_number(str(value))};"
    elif isinstance(value, bool) or value is None:
        yield json.dumps(value)
    else:
        yield json.dumps(value)
