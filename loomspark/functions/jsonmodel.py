"""JSON as rows: strict parsing, canonical text, fields of data, nodes and properties of schemas.

JSON text stays canonical (compact, order kept). Parsing and flattening are Arrow-batched helpers;
all that works on the resulting rows is DataFrame operations. What a row holds never fails the
others: values are walked with a stack of their own, and a text that can't be used gives its row an
error. Halves of surrogate pairs, which no UTF-8 text holds, stay escapes in JSON and are
replacement characters in plain text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD = "struct<path: string, parent_path: string, key: string, ord: int, json_type: string, value_json: string, text: string, depth: int, in_list: boolean>"
NODE = "struct<depth: int, under_list: boolean, type: string, n_properties: int, has_keyword: boolean>"
PROPERTY = "struct<schema_path: string, parent_path: string, key: string, ord: int, type: string, types: array<string>, required: boolean>"
#: Levels that a value may have: the paths and texts of its members grow with the square of them, so deeper values are errors.
DEPTH = 256
#: Patterns of salvaged pairs, in order of precedence (later wins).
PAIRS = (r'"(\w+)"\s*:\s*"([^"]*)"', r'"(\w+)"\s*:\s*(\d+)', r'"(\w+)"\s*:\s*(true|false|null)')
#: Keywords that make a schema complex, and the types there are.
KEYWORDS = ("anyOf", "oneOf", "allOf", "if", "then", "else", "$ref")
TYPES = ("string", "number", "integer", "boolean", "array", "object", "null")


_HALF = re.compile("[\ud800-\udfff]")


def dumps(value) -> str:
    found = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", found)


def _plain(text: str) -> str:
    """Text that UTF-8 can hold."""
    return _HALF.sub("\ufffd", text)


class Unusable(ValueError):
    """A text that is no JSON value, or one that is nested too deeply."""


def loads(text: str):
    """A JSON value of at most DEPTH levels; else Unusable, with a message for the row's error."""
    deep = f"nested more than {DEPTH} levels deep"
    try:
        value = json.loads(text)
    except RecursionError as e:
        raise Unusable(deep) from e
    except ValueError as e:
        raise Unusable(str(e)) from e
    level = [value]
    for _ in range(DEPTH):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return value
    if any(isinstance(v, (dict, list)) for v in level):
        raise Unusable(deep)
    return value


def json_type(value) -> str:
    """integer or number for numbers, else the name of the type."""
    if isinstance(value, bool):
        return "boolean"
    return {int: "integer", float: "number", str: "string", list: "array", dict: "object"}.get(type(value), "null")


def _members(value) -> Iterator[tuple[int, str, object]]:
    pairs = value.items() if isinstance(value, dict) else ((str(i), x) for i, x in enumerate(value))
    return ((i, _plain(key), x) for i, (key, x) in enumerate(pairs))


def _fields(value: dict) -> Iterator[dict]:
    """Members at any depth, each before its own members."""
    stack = [(_members(value), "", False)]
    while stack:
        members, path, in_list = stack[-1]
        member = next(members, None)
        if member is None:
            stack.pop()
            continue
        i, key, x = member
        at = f"{path}.{key}" if path else key
        yield {"path": at, "parent_path": path, "key": key, "ord": i, "json_type": json_type(x), "value_json": dumps(x), "text": _plain(x) if isinstance(x, str) else None, "depth": len(stack) - 1, "in_list": in_list}
        if isinstance(x, (dict, list)):
            stack.append((_members(x), at, in_list or isinstance(x, list)))


def _fields_of(data: pd.Series) -> pd.Series:
    """All members of an object at any depth, list items too (by their number); none of what is no object."""

    def one(x):
        try:
            found = loads(x) if x is not None else None
        except Unusable:
            return []
        return list(_fields(found)) if isinstance(found, dict) else []

    return data.map(one)


def fields(data: DataFrame, column: str = "data", *keys: str) -> DataFrame:
    """A row for each member of the objects in a JSON column; seq is its place in the document's order."""
    return data.select(*keys, F.posexplode(fields_of(F.col(column))).alias("seq", "f")).select(*keys, "seq", "f.*")


def is_truthy(json_type: Column, value_json: Column) -> Column:
    """Python's truth of a JSON value."""
    value_json = value_json.cast("string")
    zero = value_json.rlike(r"^-?0+(\.0*)?([eE][+-]?\d+)?$")
    return ~(value_json.isin("null", "false", '""', "[]", "{}") | (json_type.isin("integer", "number") & zero))


def _walk(schema: dict) -> Iterator[dict]:
    """Every object; lists add no level, and lists within lists hold none."""
    stack = [(schema, 0, False)]
    while stack:
        value, depth, under_list = stack.pop()
        kind, props = value.get("type"), value.get("properties")
        yield {"depth": depth, "under_list": under_list, "type": _plain(kind) if isinstance(kind, str) else None, "n_properties": len(props) if isinstance(props, dict) else 0, "has_keyword": any(k in value for k in KEYWORDS)}
        for x in value.values():
            if isinstance(x, dict):
                stack.append((x, depth + 1, under_list))
            elif isinstance(x, list):
                stack += [(y, depth + 1, True) for y in x if isinstance(y, dict)]


def schema_of(text: str | None) -> dict:
    """A schema document; else Unusable."""
    try:
        found = loads(text) if text is not None else None
    except Unusable as e:
        raise Unusable(f"the schema is {e}" if str(e).startswith("nested") else "the schema is no JSON object") from e
    if not isinstance(found, dict):
        raise Unusable("the schema is no JSON object")
    return found


def _usable(text: str | None) -> dict | None:
    """A schema document, if it is one."""
    try:
        return schema_of(text)
    except Unusable:
        return None


def is_schema(text: str | None) -> bool:
    return _usable(text) is not None


def _nodes_of(schema: pd.Series) -> pd.Series:
    """Every object of a schema document; none of what is no schema."""
    return schema.map(lambda x: [] if (found := _usable(x)) is None else list(_walk(found)))


def _names(value) -> list[str]:
    """The names of a list; what is no text names nothing."""
    return [_plain(x) for x in value if isinstance(x, str)] if isinstance(value, list) else []


def _properties(schema: dict) -> Iterator[dict]:
    stack = [(schema, "")]
    while stack:
        level, path = stack.pop()
        props, required = level.get("properties"), _names(level.get("required"))
        subs = {_plain(k): x for k, x in props.items()} if isinstance(props, dict) else {}
        inner = []
        for i, key in enumerate([*subs, *dict.fromkeys(r for r in required if r not in subs)]):
            sub = subs.get(key)
            kind = sub.get("type") if isinstance(sub, dict) else None
            at = f"{path}.{key}" if path else key
            yield {"schema_path": at if key in subs else None, "parent_path": path, "key": key, "ord": required.index(key) if key in required else i, "type": _plain(kind) if isinstance(kind, str) else None, "types": _names(kind) or None, "required": key in required}
            if isinstance(sub, dict):
                inner.append((sub, at))
        stack += reversed(inner)


def _properties_of(schema: pd.Series) -> pd.Series:
    """Properties at every level reached by `properties`, and required names that are none (without a schema_path)."""
    return schema.map(lambda x: [] if (found := _usable(x)) is None else list(_properties(found)))


def _dump(x) -> str:
    return json.dumps(x, indent=1, separators=(",", ":"))


def _schema_texts(schema: pd.Series) -> pd.DataFrame:
    """The dump of a schema document that prompts show; else an error."""

    def one(text):
        try:
            return {"dump": _dump(schema_of(text)), "error": None}
        except Unusable as e:
            return {"dump": None, "error": str(e)}

    return pd.DataFrame([one(x) for x in schema], columns=["dump", "error"])


def _ascii_length(schema: pd.Series) -> pd.Series:
    """Length of the compact ASCII text of a schema document."""
    return schema.map(lambda x: pd.NA if (found := _usable(x)) is None else len(json.dumps(found, separators=(",", ":")))).astype("Int64")


def _parts(s: dict) -> Iterator[tuple[str, dict]]:
    """The whole schema, or sections of five top-level properties each."""
    props, required = s.get("properties"), s.get("required")
    props = props if isinstance(props, dict) else {}
    required = required if isinstance(required, list) else []
    names = list(props)
    if len(names) <= 5:
        yield "main", s
        return
    for i in range(0, len(names), 5):
        group = {k: props[k] for k in names[i : i + 5]}
        yield f"section_{i // 5 + 1}", {"type": "object", "properties": group, "required": [k for k in required if isinstance(k, str) and k in group]}


def _sections_of(schema: pd.Series) -> pd.Series:
    """Names, JSON and dumps of a schema document's sections; null for what is no schema."""
    return schema.map(lambda x: None if (found := _usable(x)) is None else [{"name": n, "json": dumps(p), "dump": _dump(p)} for n, p in _parts(found)])


def _braced(text: str) -> str:
    """From the first `{` to the last `}`, else an empty string."""
    a, b = text.find("{"), text.rfind("}")
    return text[a : b + 1] if 0 <= a < b else ""


def _salvaged(text: str) -> dict:
    """Value of the last pair for each key: patterns in order, then places. A number beyond what Python reads raises ValueError."""
    pairs: dict = {}
    for pattern in PAIRS:
        for key, value in re.findall(pattern, text):
            pairs[key] = int(value) if value.isdigit() else {"true": True, "false": False, "null": None}.get(value, value)
    return pairs


def _parse(content: str | None) -> dict:
    """Data and confidence of a completion: strict, then repaired, then salvaged pair by pair; or an error."""
    text = (content or "").strip()
    try:
        try:
            return {"data": dumps(loads(_braced(text) or text)), "confidence": 0.8, "error": None}
        except Unusable as e:
            if str(e).startswith("nested"):
                raise
        text = re.sub(r'\\(?!["\\/bfnrt])', r"\\\\", text.replace("\\n", "\\\\n").replace("\n", " "))
        try:
            if found := _braced(text):
                data = loads(found)
                return {"data": dumps(data), "confidence": 0.3 if data else 0.1, "error": None}
        except Unusable as e:
            if str(e).startswith("nested"):
                raise
        pairs = _salvaged(text)
        return {"data": dumps(pairs), "confidence": 0.3 if pairs else 0.1, "error": None}
    except ValueError as e:
        return {"data": None, "confidence": 0.0, "error": f"the completion is {e}" if isinstance(e, Unusable) else str(e)}


def _parse_completion(content: pd.Series) -> pd.DataFrame:
    """Canonical JSON of a completion's first `{` to last `}` (or all of it), repaired or salvaged where needed; else an error."""
    return pd.DataFrame([_parse(x) for x in content], columns=["data", "confidence", "error"])


def _braced_of(content: pd.Series) -> pd.Series:
    return content.map(lambda x: _braced(x.strip()), na_action="ignore")


def _salvaged_of(content: pd.Series) -> pd.Series:
    """Key, type and value of each salvaged pair; a text with a number that can't be read has none."""

    def one(x):
        try:
            pairs = _salvaged(x or "")
        except ValueError:
            return []
        return [{"key": k, "type": json_type(v), "value": None if v is None else v if isinstance(v, str) else dumps(v)} for k, v in pairs.items()]

    return content.map(one)


# The UDFs are made where they are used: types are parsed by the session, which workers lack.


def fields_of(column: Column | str) -> Column:
    """See _fields_of."""
    return F.pandas_udf(_fields_of, f"array<{FIELD}>")(column)


def nodes_of(column: Column | str) -> Column:
    """See _nodes_of."""
    return F.pandas_udf(_nodes_of, f"array<{NODE}>")(column)


def properties_of(column: Column | str) -> Column:
    """See _properties_of."""
    return F.pandas_udf(_properties_of, f"array<{PROPERTY}>")(column)


def schema_texts(column: Column | str) -> Column:
    """See _schema_texts."""
    return F.pandas_udf(_schema_texts, "struct<dump: string, error: string>")(column)


def ascii_length(column: Column | str) -> Column:
    """See _ascii_length."""
    return F.pandas_udf(_ascii_length, "long")(column)


def sections_of(column: Column | str) -> Column:
    """See _sections_of."""
    return F.pandas_udf(_sections_of, "array<struct<name: string, json: string, dump: string>>")(column)


def parse_completion(column: Column | str) -> Column:
    """See _parse_completion."""
    return F.pandas_udf(_parse_completion, "struct<data: string, confidence: double, error: string>")(column)


def braced_of(column: Column | str) -> Column:
    """See _braced, of a trimmed text."""
    return F.pandas_udf(_braced_of, "string")(column)


def salvaged_of(column: Column | str) -> Column:
    """See _salvaged_of."""
    return F.pandas_udf(_salvaged_of, "array<struct<key: string, type: string, value: string>>")(column)
