"""Requests as JSON and as query strings.

What may be in a node, a request or a query string stands in one table each. JSON keys of the structure are case-sensitive;
numbers are read as int or Decimal, so no digit is lost. Whatever a text holds, reading it gives a request or a WireError."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from decimal import Decimal
from typing import Any
from urllib.parse import parse_qsl, urlencode

from ..functions.parsers import kind
from ..model import UNDEFINED, Dir, FilterError, FilterRequest, Group, Leaf, PageResult, SortItem, ValidationResult

#: Fixed value: how deep arrays and objects of a text may be nested.
MAX_JSON_DEPTH = 64
_INT32 = range(-(2**31), 2**31)
_DIRECTIONS = {d.name.lower(): d for d in Dir}


class WireError(FilterError):
    """A request that cannot be read. ``parameter``: of a query string."""

    def __init__(self, message: str, parameter: str | None = None):
        super().__init__(message)
        self.parameter = parameter


# Reading

_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[{]|[\]}]', re.S)


def _utf8(text: str) -> None:
    try:
        text.encode()
    except UnicodeEncodeError:
        raise WireError("Half a surrogate pair is no text.") from None


def loads(text: str) -> Any:
    """The value of a JSON text."""
    _utf8(text)
    depth = 0
    for m in _BRACKETS.finditer(text):
        depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(m[0], 0)
        if depth > MAX_JSON_DEPTH:
            raise WireError(f"JSON may be nested {MAX_JSON_DEPTH} deep and no deeper.")

    def constant(name: str) -> None:
        raise ValueError(f"{name} is not JSON")

    try:
        value = json.loads(text, parse_float=Decimal, parse_constant=constant)
    except (ValueError, ArithmeticError) as error:
        raise WireError(f"Not valid JSON: {error}") from None
    if "\\u" in text:
        _utf8(json.dumps(value, ensure_ascii=False, default=str))
    return value


def _is(value: Any, name: str, what: str) -> Any:
    try:
        found = kind(value)
    except TypeError:
        found = type(value).__name__
    if found != name:
        raise WireError(f"{what}: JSON {name} wanted, {found} found.")
    return value


#: What marks a node, and how many children it may have.
_NODES: dict[str, Callable[[int], bool] | None] = {"and": lambda n: True, "or": lambda n: True, "not": lambda n: n == 1, "field": None}


def node_from(data: Any, depth: int = 1) -> Leaf | Group:
    if depth > MAX_JSON_DEPTH:
        raise WireError("Nodes are nested too deep to be read.")
    marks = [k for k in _NODES if k in _is(data, "Object", "Node")]
    if len(marks) != 1:
        raise WireError(f"A node has exactly one of {', '.join(_NODES)}; here: {', '.join(marks) or 'none'}.")
    (mark,) = marks
    if mark == "field":
        return Leaf(_is(data["field"], "String", "field"), _is(data.get("op", UNDEFINED), "String", "op"), data.get("value", UNDEFINED))
    children = _is(data[mark], "Array", mark)
    if not _NODES[mark](len(children)):
        raise WireError(f"{mark}: {len(children)} children do not fit.")
    return Group(mark, tuple(node_from(c, depth + 1) for c in children))


def _whole(value: Any) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value not in _INT32:
        raise WireError("A whole number of 32 bits is wanted.")
    return value


def _direction(value: Any) -> int | None:
    if value is None or isinstance(value, int) and not isinstance(value, bool):
        return value
    text = _is(value, "String", "dir")
    if text.lower() in _DIRECTIONS:
        return int(_DIRECTIONS[text.lower()])
    if re.fullmatch(r"-?[0-9]{1,18}", text, re.ASCII):
        return int(text)
    raise WireError(f"dir: '{text}' is no direction.")


def _sort_items(value: Any) -> tuple[SortItem | None, ...] | None:
    def item(x: Any) -> SortItem | None:
        if x is None:
            return None
        field = _is(x, "Object", "Sort item").get("field")
        return SortItem(None if field is None else _is(field, "String", "field"), _direction(x.get("dir")))

    return tuple(map(item, _is(value, "Array", "sort"))) or None


#: Keys of a request, in lower case: the attribute they set and what reads them.
_REQUEST = {"where": ("where", node_from), "sort": ("sort", _sort_items), "page": ("page", _whole), "pagesize": ("page_size", _whole)}


def request_from(data: Any) -> FilterRequest:
    found = {}
    for key, value in _is(data, "Object", "Request").items():
        if key.lower() in _REQUEST:
            attribute, read = _REQUEST[key.lower()]
            found[attribute] = None if value is None else read(value)
    return FilterRequest(**found)


def decode(text: str) -> FilterRequest:
    return request_from(loads(text))


def _sort_text(text: str) -> SortItem:
    """field, or field:asc, or field:desc; the field may have colons itself, if a direction follows."""
    *front, last = text.split(":")
    field = ":".join(front) if front else last
    if front and last.lower() not in _DIRECTIONS:
        raise WireError(f"'{last}' is no direction: asc or desc is.")
    if not field.strip():
        raise WireError("A sort item needs a field.")
    _utf8(field)
    return SortItem(field, _DIRECTIONS[last.lower()] if front else None)


def _whole_text(text: str) -> int:
    m = re.fullmatch(r"[\t\n\v\f\r ]*([+-]?[0-9]{1,4000})[\t\n\v\f\r ]*", text, re.ASCII)
    if not m:
        raise WireError(f"'{text}' is no whole number.")
    return _whole(int(m[1]))


#: Parameters of a query string, in lower case: name, attribute, what reads one value, and whether there may be several.
_QUERY = {
    "where": ("where", "where", lambda text: node_from(loads(text)), False),
    "sort": ("sort", "sort", _sort_text, True),
    "page": ("page", "page", _whole_text, False),
    "pagesize": ("pageSize", "page_size", _whole_text, False),
}


def from_query_string(query: str) -> FilterRequest:
    """Strict: what may occur once occurs once. Names are case-insensitive, other parameters are left alone."""
    texts: dict[str, list[str]] = {}
    for name, text in parse_qsl(query.removeprefix("?"), keep_blank_values=True):
        texts.setdefault(name.lower(), []).append(text)
    found = {}
    for key, (name, attribute, read, several) in _QUERY.items():
        own = texts.get(key, [])
        if len(own) > 1 and not several:
            raise WireError(f"{name} is given {len(own)} times.", name)
        try:
            values = tuple(map(read, own))
        except WireError as error:
            raise WireError(str(error), name) from None
        if values:
            found[attribute] = values if several else values[0]
    return FilterRequest(**found)


# Writing


def node_to(node: Leaf | Group | None, keep_undefined: bool = False) -> Any:
    if isinstance(node, Leaf):
        value = {} if keep_undefined and node.value is UNDEFINED else {"value": None if node.value is UNDEFINED else node.value}
        return {"field": node.field, "op": node.op} | value
    if isinstance(node, Group):
        return {node.op: [node_to(c, keep_undefined) for c in node.children]}
    if node is not None:
        raise WireError(f"{type(node).__name__} is neither a group nor a leaf.")
    return None


def _name(direction: int) -> str:
    if direction not in (0, 1):
        raise WireError(f"{direction} is no direction.")
    return Dir(direction).name


def request_to(request: FilterRequest, keep_undefined: bool = True) -> dict[str, Any]:
    sort = [None if s is None else {"field": s.field} | ({} if s.dir is None else {"dir": _name(s.dir).capitalize()}) for s in request.sort or ()]
    every = {"where": node_to(request.where, keep_undefined), "sort": sort or None, "page": request.page, "pageSize": request.page_size}
    return {k: v for k, v in every.items() if v is not None}


def _dumps(data: Any) -> str:
    """Decimals keep the digits they came with."""
    if isinstance(data, dict):
        return "{" + ",".join(f"{_dumps(str(k))}:{_dumps(v)}" for k, v in data.items()) + "}"
    if isinstance(data, (list, tuple)):
        return "[" + ",".join(map(_dumps, data)) + "]"
    if isinstance(data, Decimal) and data.is_finite():
        return str(data)
    try:
        text = json.dumps(data, ensure_ascii=False, allow_nan=False)
    except (TypeError, ValueError) as error:
        raise WireError(f"This cannot be written as JSON: {error}") from None
    _utf8(text)
    return text


def encode(request: FilterRequest) -> str:
    return _dumps(request_to(request, False))


def to_query_string(request: FilterRequest) -> str:
    pairs = [] if request.where is None else [("where", _dumps(node_to(request.where, True)))]
    for s in request.sort or ():
        if s is None or s.field is None:
            raise WireError("A sort item without a field has no text.")
        _utf8(s.field)
        pairs.append(("sort", s.field if s.dir is None else f"{s.field}:{_name(s.dir).lower()}"))
    pairs += [(name, str(v)) for name, v in (("page", request.page), ("pageSize", request.page_size)) if v is not None]
    return urlencode(pairs)


def result_to(result: ValidationResult) -> dict[str, Any]:
    return {"isValid": result.is_valid, "errors": [e.to_dict() for e in result.errors]}


def page_to(page: PageResult) -> dict[str, Any]:
    return {"items": [r.asDict(recursive=True) for r in page.items], "totalCount": page.total_count, "page": page.page, "pageSize": page.page_size, "totalPages": page.total_pages, "hasPrevious": page.has_previous, "hasNext": page.has_next}
