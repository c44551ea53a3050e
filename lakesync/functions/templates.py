"""Row templates and conditions compiled to Columns.

A template is text with ``{{ reference | filter }}`` parts.  References are
``record.<path>`` (a column or nested field) and ``config.<key>`` (a constant).
It is compiled once on the driver; rows are evaluated inside Spark.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, functions as F, types as T

from lakesync.functions.text import last_path_segment, url_encode_segment
from lakesync.functions.values import comparable_text

PART = re.compile(r"\{\{(.*?)\}\}")
UNSUPPORTED_OPERATORS = ("!=", ">=", "<=", ">", "<", "&&", "||")


class Reference:
    """A resolved reference: a Column and its type, or nothing when the path is not there."""

    def __init__(self, col: Column | None, dtype: T.DataType | None):
        self.col, self.dtype = col, dtype

    @property
    def found(self) -> bool:
        return self.col is not None

    def text(self) -> Column:
        return comparable_text(self.col, self.dtype)


def resolve(ref: str, schema: T.StructType, config: Mapping[str, str]) -> Reference:
    space, _, path = ref.strip().partition(".")
    if not path:
        raise ValueError(f"reference without a namespace: {ref!r}")
    if space == "config":
        if path not in config:
            raise ValueError(f"config has no key {path!r}")
        return Reference(F.lit(config[path]), T.StringType())
    if space != "record":
        raise ValueError(f"no namespace {space!r}, in {ref!r}")
    col, dtype = None, schema
    for name in path.split("."):
        if not isinstance(dtype, T.StructType) or name not in dtype.names:
            return Reference(None, None)
        col = F.col(f"`{name}`") if col is None else col.getField(name)
        dtype = dtype[name].dataType
    return Reference(col, dtype)


def compile_template(template: str, schema: T.StructType, config: Mapping[str, str] | None = None) -> Column | None:
    """Column of a computed-field template; None when a bare path does not exist.

    A bare ``{{ record.path }}`` keeps the type of its column.  Everything else
    is text, and null when any referenced path is absent or null.
    """
    config = config or {}
    whole = PART.fullmatch(template.strip())
    if whole and "|" not in whole.group(1) and "{{" not in whole.group(1):
        inner = whole.group(1).strip()
        if inner.split()[0] == "coalesce":
            return _coalesce(inner, schema, config)
        ref = resolve(inner, schema, config)
        return ref.col
    if whole and whole.group(1).strip().startswith("record.") and _stages(whole.group(1))[1] == ["length"]:
        ref = resolve(_stages(whole.group(1))[0], schema, config)
        if not isinstance(ref.dtype, T.ArrayType):
            return None
        return F.when(ref.col.isNotNull(), F.size(ref.col))
    parts, last = [], 0
    for found in PART.finditer(template):
        if found.start() > last:
            parts.append(F.lit(template[last:found.start()]))
        value = _expression(found.group(1), schema, config)
        if value is None:
            return None
        parts.append(value)
        last = found.end()
    if last < len(template) or not parts:
        parts.append(F.lit(template[last:]))
    return F.concat(*parts)


def _stages(expression: str) -> tuple[str, list[str]]:
    ref, *filters = expression.split("|")
    return ref.strip(), [f.strip() for f in filters if f.strip()]


def _coalesce(inner: str, schema: T.StructType, config: Mapping[str, str]) -> Column | None:
    refs = inner.split()[1:]
    if len(refs) < 2:
        raise ValueError("coalesce takes two or more record paths")
    if any(not r.startswith("record.") or r == "record." for r in refs):
        raise ValueError("coalesce takes record paths only")
    found = [r for r in (resolve(ref, schema, config) for ref in refs) if r.found]
    # A column has one type: paths of different types are read as text.
    mixed = len({r.dtype.simpleString() for r in found}) > 1
    values = [(r.text() if mixed else r.col, mixed or isinstance(r.dtype, T.StringType)) for r in found]
    picked = [F.nullif(v, F.lit("")) if is_text else v for v, is_text in values]
    return F.coalesce(*picked) if picked else None


def _expression(expression: str, schema: T.StructType, config: Mapping[str, str]) -> Column | None:
    if expression.strip().split()[:1] == ["coalesce"]:
        if "|" in expression:
            raise ValueError("coalesce cannot be filtered")
        return _coalesce(expression.strip(), schema, config)
    ref_text, filters = _stages(expression)
    ref = resolve(ref_text, schema, config)
    if not ref.found:
        return None
    value = ref.text()
    for position, name in enumerate(filters):
        value = apply_filter(name, value, ref if position == 0 else None)
    return value


def apply_filter(name: str, text: Column, raw: Reference | None) -> Column:
    """One filter stage; only the first stage still sees the untyped-to-text value."""
    is_array = raw is not None and isinstance(raw.dtype, T.ArrayType)
    if name == "urlencode":
        return url_encode_segment(text)
    if name == "unix_seconds":
        return F.unix_seconds(F.to_timestamp(text)).cast("string")
    if name == "base64":
        return F.base64(F.encode(text, "UTF-8"))
    if name == "last_path_segment":
        return last_path_segment(text)
    if name == "length":
        return F.size(raw.col).cast("string") if is_array else F.lit("0")
    if name.startswith("join:"):
        if not is_array:
            raise ValueError("only arrays can be joined")
        items = F.transform(raw.col, lambda v: F.coalesce(comparable_text(v, raw.dtype.elementType), F.lit("")))
        return F.array_join(items, name.removeprefix("join:"))
    if name.startswith("const:"):
        return F.when(text.isNotNull(), F.lit(name.removeprefix("const:")))
    raise ValueError(f"no filter {name!r}")


def compile_condition(condition: str, schema: T.StructType, config: Mapping[str, str] | None = None) -> Column:
    """``a == 'x'``, ``a in ['x','y']`` or bare ``a`` (non-empty); an absent value is empty text."""
    inner = condition.strip()
    whole = PART.fullmatch(inner)
    inner = (whole.group(1) if whole else inner).strip()
    config = config or {}

    def text_of(ref: str) -> Column:
        if ref.startswith("config.") and ref.removeprefix("config.") not in config:
            return F.lit("")
        found = resolve(ref, schema, config)
        return F.coalesce(found.text(), F.lit("")) if found.found else F.lit("")

    if "==" in inner:
        left, right = (side.strip() for side in inner.split("==", 1))
        return text_of(left) == F.lit(_literal(right))
    if " in " in inner:
        left, right = (side.strip() for side in inner.split(" in ", 1))
        if not (right.startswith("[") and right.endswith("]")):
            raise ValueError(f"list expected in condition {condition!r}")
        items = [_literal(item.strip()) for item in right[1:-1].split(",") if item.strip()]
        return text_of(left).isin(items) if items else F.lit(False)
    for operator in UNSUPPORTED_OPERATORS:
        if operator in inner:
            raise ValueError(f"conditions know no {operator!r}: {condition!r}")
    return text_of(inner) != ""


def _literal(text: str) -> str:
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    raise ValueError(f"quoted literal expected, got {text!r}")
