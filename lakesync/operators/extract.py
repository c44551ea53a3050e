"""Records out of landed bodies.

Bodies are rows ``(body_id, parent_id, body)``.  JSON bodies are parsed once
into VARIANT; fields are then taken out by path and type.  Nothing here groups
or shuffles: a body is opened in the task that reads it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakesync.functions.cursor import number_of
from lakesync.functions.text import camel_snake, header_snake
from lakesync.functions.values import first_non_blank

ANY = "variant"
OBJECT = "map<string,variant>"
ARRAY = "array<variant>"
XML_AS_IS = {"ignoreSurroundingSpaces": "false"}


def json_path(path: str) -> str:
    """Dotted path to a VARIANT path; empty and ``.`` mean the root."""
    segments = [s for s in path.strip().split(".") if s]
    return "$" + "".join(f'["{s}"]' for s in segments)


def node_at(value: Column, path: str, kind: str = ANY) -> Column:
    return F.try_variant_get(value, json_path(path), kind)


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", OBJECT).isNotNull()


def pick(record: Column, fields: dict[str, str], rename: dict[str, str] | None = None) -> list[Column]:
    """Typed columns out of a VARIANT record; ``rename`` maps column names to source paths."""
    paths = rename or {}
    return [node_at(record, paths.get(name, name), kind).alias(name) for name, kind in fields.items()]


def records_at(bodies: DataFrame, path: str, fields: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per object of the array at ``path``; a lone object is one row, anything else none."""
    return explode_records(parsed(bodies, keep), path, keep).select(*keep, *pick(F.col("record"), fields))


def parsed(bodies: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Bodies as a VARIANT column ``doc``."""
    return bodies.select(*keep, F.parse_json("body").alias("doc"))


def explode_records(docs: DataFrame, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """The rows of ``records_at`` as a VARIANT column ``record``."""
    lone = node_at(F.col("doc"), path)
    items = F.coalesce(node_at(F.col("doc"), path, ARRAY), F.when(is_object(lone), F.array(lone)))
    return docs.select(*keep, F.explode(items).alias("record")).where(is_object(F.col("record")))


def records_keyed(
    bodies: DataFrame, path: str, fields: dict[str, str], key_field: str | None, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per entry of the object at ``path``; entries that are no objects are skipped."""
    nodes = parsed(bodies, keep).select(*keep, node_at(F.col("doc"), path).alias("node"))
    node, entries = F.col("node"), F.try_variant_get("node", "$", OBJECT)
    wrong = F.raise_error(F.lit(f"no JSON object at path {path!r}")).cast(OBJECT)
    missing = node.isNull() | F.is_variant_null(node)
    opened = nodes.select(
        *keep, F.explode(F.when(missing | entries.isNotNull(), entries).otherwise(wrong)).alias("__key", "record")
    ).where(is_object(F.col("record")))
    named = [F.col("__key").alias(key_field)] if key_field else []
    wanted = {n: k for n, k in fields.items() if n != key_field}
    return opened.select(*keep, *named, *pick(F.col("record"), wanted))


def merge_response_fields(
    bodies: DataFrame, path: str, fields: dict[str, str], response_fields: dict[str, tuple[str, str]],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Records of each body with body-level fields laid over them (null body values are not copied).

    ``response_fields`` maps a column to the path and type it is read from.
    """
    tops = {f"__top_{n}": node_at(F.col("doc"), p, kind) for n, (p, kind) in response_fields.items()}
    opened = explode_records(parsed(bodies, keep).withColumns(tops), path, [*keep, *tops])
    columns = []
    for name in dict.fromkeys([*fields, *response_fields]):
        if name in response_fields:
            own = node_at(F.col("record"), name, response_fields[name][1])
            columns.append(F.coalesce(F.col(f"__top_{name}"), own).alias(name))
        else:
            columns.append(node_at(F.col("record"), name, fields[name]).alias(name))
    return opened.select(*keep, *columns)


def child_rows(
    bodies: DataFrame, parent_path: str, child_path: str, parent_fields: dict[str, tuple[str, str]],
    child_fields: dict[str, tuple[str, str]],
) -> DataFrame:
    """One row per child object, carrying fields of its parent.

    Both field maps give column name to path and type.
    """
    parents = explode_records(parsed(bodies), parent_path)
    carried = [node_at(F.col("record"), p, k).alias(n) for n, (p, k) in parent_fields.items()]
    children = parents.select(
        *carried, F.explode(node_at(F.col("record"), child_path, ARRAY)).alias("__child")
    ).where(is_object(F.col("__child")))
    own = [node_at(F.col("__child"), p, k).alias(n) for n, (p, k) in child_fields.items()]
    return children.select(*parent_fields, *own)


def first_element(
    bodies: DataFrame, path: str, array_path: str, fields: dict[str, tuple[str, str]],
    element_fields: dict[str, tuple[str, str]],
) -> DataFrame:
    """Fields of a record and of the first element of one of its arrays; nulls when it is empty."""
    first = F.try_variant_get(F.col("record"), json_path(array_path) + "[0]", ANY)
    opened = explode_records(parsed(bodies), path).withColumn("__first", first)
    own = [node_at(F.col("record"), p, k).alias(n) for n, (p, k) in fields.items()]
    deep = [node_at(F.col("__first"), p, k).alias(n) for n, (p, k) in element_fields.items()]
    return opened.select(*own, *deep)


def last_named(pairs: Column, wanted: str) -> Column:
    """Last element of an array of structs whose ``n`` is ``wanted``; null when there is none."""
    return F.try_element_at(F.filter(pairs, lambda p: p["n"] == wanted), F.lit(-1))


def _value_of(names: Column, values: Column, wanted: str) -> Column:
    return last_named(F.arrays_zip(names.alias("n"), values.alias("v")), wanted)["v"]


def report_rows(
    bodies: DataFrame, owner: str, owner_as: str, dimensions: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """Report rows with positional values named by the body's header arrays."""
    schema = (
        "dimensionHeaders array<struct<name:string>>, metricHeaders array<struct<name:string>>, "
        "rows array<struct<dimensionValues:array<struct<value:string>>,metricValues:array<struct<value:string>>>>"
    )
    doc = bodies.select(F.col(owner).alias(owner_as), F.from_json("body", schema).alias("d"))
    rows = doc.select(owner_as, "d.dimensionHeaders", "d.metricHeaders", F.explode("d.rows").alias("r"))
    pairs = [("dimensionHeaders", "dimensionValues", dimensions), ("metricHeaders", "metricValues", metrics)]
    columns = []
    for headers, values, names in pairs:
        header, value = F.col(f"{headers}.name"), F.col(f"r.{values}.value")
        columns += [_value_of(header, value, name).alias(name) for name in names]
    return rows.select(owner_as, *columns)


def positional_rows(
    bodies: DataFrame, dimensions: Sequence[str], metrics: dict[str, str], constants: dict[str, Column]
) -> DataFrame:
    """Rows whose ``keys`` array lines up with the requested dimensions."""
    fields = ", ".join(f"{name}:{kind}" for name, kind in metrics.items())
    schema = f"rows array<struct<keys:array<string>,{fields}>>"
    fixed = [value.alias(name) for name, value in constants.items()]
    rows = bodies.select(*fixed, F.explode(F.from_json("body", schema)["rows"]).alias("r"))
    named = [F.get(F.col("r.keys"), i).alias(name) for i, name in enumerate(dimensions)]
    return rows.select(*constants, *named, *(F.col(f"r.{m}").alias(m) for m in metrics))


def header_rows(bodies: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Array of arrays whose first row is the header (compared in lower case); values are text.

    A null cell is empty text, a missing one is null.
    """
    table = F.from_json("body", "array<array<string>>")
    header = F.transform(F.get("t", 0), lambda h: F.lower(F.coalesce(h, F.lit(""))))
    later = F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))
    rows = bodies.select(*keep, table.alias("t")).select(*keep, header.alias("h"), F.explode(later).alias("r"))
    return rows.select(*keep, *(_cell(F.col("h"), F.col("r"), name).alias(name) for name in columns))


def _cell(header: Column, row: Column, name: str) -> Column:
    where = F.array_position(F.reverse(header), name)
    index = F.size(header) - where
    present = (where > 0) & (index < F.size(row))
    return F.when(present, F.coalesce(F.get(row, index.cast("int")), F.lit("")))


# One CSV record: text without quotes or line ends, and quoted parts that may
# hold both.  Possessive, so a long field needs no backtracking.
_CSV_RECORD = r'((?:[^"\r\n]++|"[^"]*+(?:""[^"]*+)*+")++)'
_CSV_CELL = r',("[^"]*+(?:""[^"]*+)*+"|[^,]*)'


def csv_cells(record: Column) -> Column:
    """Cells of one CSV record, unquoted."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CSV_CELL), F.lit(1))
    return F.transform(
        cells,
        lambda c: F.when(
            c.startswith('"'),
            F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(c),
    )


def csv_body_rows(bodies: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """CSV text held in one column; titles become snake case, short rows give nulls."""
    records = F.regexp_extract_all(F.col("body"), F.lit(_CSV_RECORD), F.lit(1))
    split = bodies.select(*keep, records.alias("t"))
    header = F.transform(csv_cells(F.get("t", 0)), header_snake)
    rows = split.select(*keep, header.alias("h"), F.explode(F.slice("t", 2, F.size("t"))).alias("line"))
    cells = rows.select(*keep, "h", csv_cells(F.col("line")).alias("r"))
    return cells.select(*keep, *(_cell(F.col("h"), F.col("r"), name).alias(name) for name in columns))


def parallel_series(bodies: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Timestamps zipped with their value arrays; short or null values are null.

    ``fields`` maps value columns to types; ``adjclose`` comes from its own block.
    """
    quotes = [f for f in fields if f != "adjclose"]
    quote = ",".join(f"{f}:array<{fields[f]}>" for f in quotes)
    schema = (
        "chart struct<result:array<struct<meta:struct<symbol:string,currency:string>,"
        f"timestamp:array<bigint>,indicators:struct<quote:array<struct<{quote}>>,"
        f"adjclose:array<struct<adjclose:array<{fields['adjclose']}>>>>>>>"
    )
    result = F.get(F.from_json("body", schema)["chart"]["result"], 0)
    opened = bodies.select(result.alias("x"))
    first = opened.select(
        F.col("x.meta.symbol").alias("symbol"), F.col("x.meta.currency").alias("currency"),
        F.get("x.indicators.quote", 0).alias("q"), F.get("x.indicators.adjclose", 0).alias("a"),
        F.posexplode("x.timestamp").alias("i", "timestamp"),
    )
    values = [F.get(F.col("q").getField(f), F.col("i")).alias(f) for f in quotes]
    return first.select("symbol", "currency", "timestamp", *values, F.get("a.adjclose", F.col("i")).alias("adjclose"))


def date_keyed_series(bodies: DataFrame, series: str, owner: str, lower: str | None = None) -> DataFrame:
    """Rows of an object keyed by date; dates at or below ``lower`` are dropped."""
    names = {"open": "1. open", "high": "2. high", "low": "3. low", "close": "4. close", "volume": "5. volume"}
    entries = F.try_variant_get(F.parse_json("body"), f'$["{series}"]', "map<string,map<string,string>>")
    rows = bodies.select(F.col(owner).alias("symbol"), F.explode(entries).alias("date", "e"))
    if lower and lower.strip():
        rows = rows.where(F.col("date") > lower.strip())
    return rows.select("symbol", "date", *(F.try_element_at("e", F.lit(n)).alias(c) for c, n in names.items()))


def spread_struct(
    df: DataFrame, nested: str, id_from: str | None = None, id_as: str = "id", drop: Sequence[str] = ()
) -> DataFrame:
    """Fields of a nested struct moved to the top, then the id stamped over them."""
    inner = df.schema[nested].dataType.names
    outer = [c for c in df.columns if c != nested and c not in inner and c != id_from and c not in drop]
    out = {c: F.col(f"`{c}`") for c in outer}
    out.update({c: F.col(f"`{nested}`.`{c}`") for c in inner})
    if id_from:
        own = out.get(id_as, F.lit(None).cast("string"))
        out[id_as] = F.coalesce(F.col(f"`{id_from}`"), own)
    return df.select(*(col.alias(name) for name, col in out.items()))


def feed_items(bodies: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Feed XML to item rows; the id is the first non-blank of guid, link and title."""
    item = "guid:string,link:string,title:string,description:string,pubDate:string"
    schema = f"channel struct<title:string,link:string,item:array<struct<{item}>>>"
    rows = bodies.select(*keep, F.explode(F.from_xml("body", schema, XML_AS_IS)["channel"]["item"]).alias("i"))
    ids = [(F.trim(F.col(f"i.{c}")), T.StringType()) for c in ("guid", "link", "title")]
    return rows.select(
        *keep, first_non_blank(ids, "").alias("id"), F.col("i.title").alias("title"),
        F.col("i.link").alias("link"), F.col("i.description").alias("description"),
        F.col("i.pubDate").alias("published_at"),
    )


def typed_collection(
    bodies: DataFrame, row: str, fields: dict[str, tuple[str, str]], keep: Sequence[str] = ()
) -> DataFrame:
    """XML collection to typed rows.

    ``fields`` maps output columns to wire name and type.  Text that does not
    parse as its number or boolean type stays in ``<column>_raw``.
    """
    wire = ",".join(f"{name}:string" for name, _ in fields.values())
    rows = bodies.select(*keep, F.explode(F.from_xml("body", f"{row} array<struct<{wire}>>", XML_AS_IS)[row]).alias("r"))
    columns = []
    for out, (name, kind) in fields.items():
        text = F.col(f"r.{name}")
        if kind == "string":
            columns.append(text.alias(out))
            continue
        typed = coerce(text, kind)
        columns += [typed.alias(out), F.when(typed.isNull(), text).alias(f"{out}_raw")]
    return rows.select(*keep, *columns)


def coerce(text: Column, kind: str) -> Column:
    trimmed = F.trim(text)
    if kind == "number":
        return number_of(trimmed)
    folded = F.lower(trimmed)
    return F.when(folded.isin("yes", "true", "1"), True).when(folded.isin("no", "false", "0", ""), False)


def queue_messages(bodies: DataFrame, attributes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Queue messages: attributes by their snake-case name, the body as JSON when it is JSON."""
    schema = (
        "array<struct<MessageId:string,Body:string,Attributes:array<struct<Name:string,Value:string>>,"
        "MessageAttributes:array<struct<Name:string,Value:struct<StringValue:string>>>>>"
    )
    rows = bodies.select(*keep, F.explode(F.from_json("body", schema)).alias("m"))

    def named(array: str, value: str) -> Column:
        return F.transform(
            F.coalesce(F.col(f"m.{array}"), F.expr("array()").cast(_attribute_type(value))),
            lambda a: F.struct(camel_snake(a["Name"]).alias("n"), _attribute_value(a, value).alias("v")),
        )

    every = F.concat(named("Attributes", "plain"), named("MessageAttributes", "typed"))
    parsed = F.try_parse_json("m.Body")
    return rows.withColumn("__all", every).select(
        *keep, F.col("m.MessageId").alias("message_id"),
        F.coalesce(F.to_json(parsed), F.col("m.Body")).alias("body"),
        parsed.isNotNull().alias("body_is_json"),
        *(last_named(F.col("__all"), name)["v"].alias(name) for name in attributes),
    )


def _attribute_type(value: str) -> str:
    inner = "string" if value == "plain" else "struct<StringValue:string>"
    return f"array<struct<Name:string,Value:{inner}>>"


def _attribute_value(attribute: Column, value: str) -> Column:
    return attribute["Value"] if value == "plain" else attribute["Value"]["StringValue"]


def scalar_rows(bodies: DataFrame, path: str, id_as: str, name_as: str, keep: Sequence[str] = ()) -> DataFrame:
    """Array of names to rows; the id is the part after the last ``/``."""
    names = node_at(F.parse_json("body"), path, "array<string>")
    rows = bodies.select(*keep, F.explode(names).alias(name_as))
    return rows.select(*keep, F.substring_index(F.trim(F.col(name_as)), "/", -1).alias(id_as), name_as)


def unwrap_typed(value: Column, dtype: T.DataType) -> Column:
    """Plain value out of a typed envelope such as ``{"S": "x"}``, for a declared type."""
    if isinstance(dtype, T.StructType):
        inner = F.try_variant_get(value, "$.M", ANY)
        fields = [
            unwrap_typed(F.try_variant_get(inner, json_path(f.name), ANY), f.dataType).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(inner.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        items = F.filter(F.try_variant_get(value, "$.L", ARRAY), is_object)
        return F.transform(items, lambda v: unwrap_typed(v, dtype.elementType))
    if isinstance(dtype, T.BooleanType):
        return F.try_variant_get(value, "$.BOOL", "boolean")
    text = F.coalesce(*(F.try_variant_get(value, f"$.{k}", "string") for k in ("S", "N", "B")))
    return text if isinstance(dtype, T.StringType) else text.try_cast(dtype)


def unwrap_items(bodies: DataFrame, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of typed-envelope items, by a declared schema."""
    items = bodies.select(*keep, F.parse_json("body").alias("__item"))
    return items.select(
        *keep,
        *(unwrap_typed(F.try_variant_get(F.col("__item"), json_path(f.name), ANY), f.dataType).alias(f.name)
          for f in schema.fields),
    )


def fan_out(parents: DataFrame, parent_id: str, bodies: DataFrame, stamp: str) -> DataFrame:
    """Bodies of the wanted parents with the parent id stamped on.

    A semi join: a parent listed twice is still read once, and one hot parent
    is split by the skew-join rule.
    """
    wanted = parents.select(F.col(parent_id).cast("string").alias("parent_id"))
    return bodies.join(wanted, "parent_id", "left_semi").withColumn(stamp, F.col("parent_id"))


def time_windows(
    df: DataFrame, at: str, start: str, end: str, days: int, inclusive_days: bool = False
) -> DataFrame:
    """Window number and limits for each row between ``start`` and ``end``; others are dropped.

    Half-open windows of ``days`` days, the last one clipped at ``end``.  The
    inclusive form counts whole days and includes the end day.  The number is
    arithmetic, so no join with a window table is needed.
    """
    begin, stop = F.to_timestamp_ntz(F.lit(start)), F.to_timestamp_ntz(F.lit(end))
    moment = F.col(at)
    if inclusive_days:
        moment = F.date_trunc("day", moment).cast("timestamp_ntz")
        inside = (moment >= begin) & (moment <= stop)
    else:
        inside = (moment >= begin) & (moment < stop)
    elapsed = F.timestamp_diff("SECOND", begin, moment)
    number = F.floor(elapsed / F.lit(days * 86400)).cast("bigint")
    first = F.timestamp_add("DAY", (number * days).cast("int"), begin)
    span = days - 1 if inclusive_days else days
    last = F.least(F.timestamp_add("DAY", F.lit(span), F.col("window_start")), stop)
    return (
        df.where(inside).withColumn("window_no", number).withColumn("window_start", first)
        .withColumn("window_end", last)
    )
