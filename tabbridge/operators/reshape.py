"""Result documents (JSON text) to rows, and rows to CSV columns.

JSON values travel as VARIANT, so numbers, strings, objects and arrays keep their
JSON form without a declared schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.functions.names import col, require
from tabbridge.functions.ordering import TIE, range_partition, with_tie

# Shape of one column entry in a column-oriented result document.
ENTRY = (
    "MAP<STRING, STRUCT<value: ARRAY<VARIANT>, party_id: STRING, party_name: STRING, "
    "asset_name: STRING, item_idx: INT>>"
)


def _checked(parsed: Column, text: Column, what: str) -> Column:
    """``parsed``, failing the job when non-blank text could not be parsed."""
    message = F.concat(F.lit(f"{what}: cannot parse JSON: "), F.substring(text, 1, 200))
    blank = text.isNull() | (F.trim(text) == "")
    return F.when(parsed.isNotNull() | blank, parsed).otherwise(F.raise_error(message))


def columns_to_rows_long(df: DataFrame, document: str, keys: Sequence[str] = ()) -> DataFrame:
    """Column-oriented documents to one row per value: keys, pos, item_idx, name, value.

    ``keys`` identify the result a document belongs to. The column name is
    ``party.asset.column`` when both parts are given, else the bare column.
    ``value`` is JSON text. A row-wise step: nothing is shuffled.
    """
    require(df, [document, *keys])
    text = col(document)
    ids = [col(k) for k in keys]
    entries = df.select(*ids, text.alias("__text")).select(
        *ids,
        F.explode(
            _checked(F.from_json("__text", ENTRY, {"mode": "PERMISSIVE"}), col("__text"), "result")
        ).alias("__column", "__entry"),
    )
    entry = col("__entry")
    party = F.coalesce(entry["party_name"], F.lit(""))
    asset = F.coalesce(entry["asset_name"], F.lit(""))
    named = (party != "") & (asset != "")
    return entries.select(
        *ids,
        F.coalesce(entry["item_idx"], F.lit(0)).alias("item_idx"),
        F.when(named, F.concat_ws(".", party, asset, col("__column")))
        .otherwise(col("__column"))
        .alias("name"),
        F.posexplode(entry["value"]).alias("pos", "__value"),
    ).select(
        *ids,
        col("pos").cast("long").alias("pos"),
        "item_idx",
        "name",
        F.coalesce(F.to_json("__value"), F.lit("null")).alias("value"),
    )


def _json_string(c: Column) -> Column:
    """A JSON string literal: quotes, backslashes and control characters escaped."""
    wrapped = F.to_json(F.array(c))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - F.lit(2))


def _json_object(members: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def _one_per_name(
    df: DataFrame, document: str, keys: Sequence[str], order: str | None
) -> DataFrame:
    """Long rows with each column once per result: the last document in ``order`` wins.

    Repeats are dropped before the shuffle, so later groups hold distinct columns only.
    """
    ids = [*keys, order] if order and order not in keys else list(keys)
    long = columns_to_rows_long(df, document, ids)
    entry = F.struct("item_idx", "value")
    rank = F.struct(*([col(order)] if order else []), entry)
    return (
        long.groupBy(*[col(k) for k in keys], "pos", "name")
        .agg(F.max_by(entry, rank).alias("__e"))
        .select(*[col(k) for k in keys], "pos", "name", "__e.item_idx", "__e.value")
    )


def columns_to_rows(
    df: DataFrame, document: str, keys: Sequence[str] = (), order: str | None = None
) -> DataFrame:
    """Column-oriented documents to row objects: keys, pos, row (JSON text).

    The documents of one result are zipped by position. Members follow item_idx; a
    column that is too short leaves its member out. A column that several documents
    give is taken from the last one in ``order``. A group holds one row's members, so
    its size is the number of columns.
    """
    member = F.struct(
        "item_idx", "name", F.concat(_json_string(col("name")), F.lit(":"), col("value")).alias("m")
    )
    return (
        _one_per_name(df, document, keys, order)
        .groupBy(*[col(k) for k in keys], "pos")
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
        .select(*[col(k) for k in keys], "pos", _json_object(col("members")["m"]).alias("row"))
    )


def columns_to_table(
    df: DataFrame,
    document: str,
    names: Sequence[str],
    keys: Sequence[str] = (),
    order: str | None = None,
) -> DataFrame:
    """Column-oriented documents to a wide table with the given columns, values as JSON text."""
    wide = [F.max(F.when(col("name") == n, col("value"))).alias(n) for n in names]
    return (
        _one_per_name(df, document, keys, order)
        .groupBy(*[col(k) for k in keys], "pos")
        .agg(*wide)
    )


def _elements(v: Column) -> Column:
    """Elements of an array, NULL for any other value."""
    return F.try_variant_get(v, "$", "array<variant>")


def _members(v: Column) -> Column:
    """Members of an object, NULL for any other value."""
    return F.try_variant_get(v, "$", "map<string, variant>")


def _element_json(v: Column) -> Column:
    return F.coalesce(F.to_json(v), F.lit("null"))


def documents_to_rows(df: DataFrame, document: str, keys: Sequence[str] = ()) -> DataFrame:
    """Result documents of any row form to row objects: keys, pos, row (JSON text).

    * an array gives its objects as they are;
    * an object whose members are all arrays is zipped by position;
    * any other object gives ``{member: element}`` for each element of each member
      that is an array, or a string holding a JSON array; other members are ignored.

    Blank documents give nothing; bad JSON fails the job. Members are sorted by name.
    The work stays inside each document's row: nothing is shuffled.
    """
    require(df, [document, *keys])
    ids = [col(k) for k in keys]
    text = col("__text")
    parsed = F.try_parse_json(text)
    as_map = _members(parsed)
    # a row list holds objects only
    is_list = F.forall(_elements(parsed), lambda e: _members(e).isNotNull())
    message = F.concat(F.lit("documents: cannot parse JSON: "), F.substring(text, 1, 200))
    docs = (
        df.select(*ids, col(document).alias("__text"))
        .where(text.isNotNull() & (F.trim(text) != ""))
        .select(
            *ids,
            parsed.alias("__doc"),
            F.array_sort(F.map_keys(as_map)).alias("__names"),
            as_map.alias("__map"),
            F.when(as_map.isNotNull() | is_list, F.lit(True))
            .otherwise(F.raise_error(message).cast("boolean"))
            .alias("__ok"),
        )
    )
    members = col("__map")
    # members as (name, elements); elements is NULL for what is not an array
    fields = F.transform(
        col("__names"),
        lambda n: F.struct(
            _json_string(n).alias("name"),
            _elements(members[n]).alias("items"),
            F.try_variant_get(members[n], "$", "string").alias("string"),
        ),
    )
    shaped = docs.where("__ok").select(*ids, "__doc", fields.alias("__fields"))
    columnar = (F.size("__fields") > 0) & F.forall("__fields", lambda f: f["items"].isNotNull())
    longest = F.array_max(F.transform("__fields", lambda f: F.size(f["items"])))
    zipped = F.when(
        longest > 0,
        F.transform(
            F.sequence(F.lit(0), longest - 1),
            lambda i: _json_object(
                F.transform(
                    F.filter("__fields", lambda f: i < F.size(f["items"])),
                    lambda f: F.concat(f["name"], F.lit(":"), _element_json(F.get(f["items"], i))),
                )
            ),
        ),
    )
    quoted = lambda f: F.when(
        f["string"].startswith("[") & f["string"].endswith("]"),
        _elements(F.try_parse_json(f["string"])),
    )
    mixed = F.flatten(
        F.transform(
            "__fields",
            lambda f: F.transform(
                F.coalesce(f["items"], quoted(f), F.array().cast("array<variant>")),
                lambda v: F.concat(
                    F.lit("{"), f["name"], F.lit(":"), _element_json(v), F.lit("}")
                ),
            ),
        )
    )
    listed = F.transform(_elements(col("__doc")), _element_json)
    rows = (
        F.when(col("__fields").isNull(), listed).when(columnar, zipped).otherwise(mixed)
    )
    return shaped.select(*ids, F.posexplode(rows).alias("__pos", "row")).select(
        *ids, col("__pos").cast("long").alias("pos"), "row"
    )


def first_record_keys(df: DataFrame, document: str, order: str) -> list[str]:
    """Member names of the first record, in document order (the only row fetched)."""
    first = df.agg(F.min_by(col(document), col(order)).alias("d")).select(
        F.json_object_keys("d").alias("k")
    )
    return list(first.first()["k"] or [])


def all_record_keys(df: DataFrame, document: str, order: str) -> list[str]:
    """Member names of all records, in the order in which they first appear."""
    names = df.select(
        col(order).alias("__order"), F.posexplode(F.json_object_keys(col(document))).alias("__pos", "__name")
    )
    seen = names.groupBy("__name").agg(F.min(F.struct("__order", "__pos")).alias("__at"))
    return [r["__name"] for r in seen.orderBy("__at", "__name").collect()]


def json_to_columns(
    df: DataFrame, document: str, order: str, keys: Sequence[str] = (), header: str = "union"
) -> DataFrame:
    """JSON records to text columns named by the records' members.

    ``header="union"`` takes the members of all records, ``"first"`` only those of the
    first record and leaves the others out. Missing members are ''; nested values stay
    JSON text.
    """
    require(df, [document, order, *keys])
    if header not in HEADERS:
        raise ValueError(f"header must be one of {tuple(HEADERS)}, not {header!r}")
    header = HEADERS[header](df, document, order)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in header])
    record = F.from_json(col(document), schema, {"mode": "PERMISSIVE"})
    return df.select(*[col(k) for k in keys], record.alias("__r")).select(
        *[col(k) for k in keys],
        *[F.coalesce(col("__r")[n], F.lit("")).alias(n) for n in header],
    )


HEADERS = {"union": all_record_keys, "first": first_record_keys}


def json_to_csv(
    df: DataFrame, document: str, order: str, path: str, header: str = "union"
) -> DataFrame:
    """Write ``json_to_columns`` as headered CSV in record order; returns what was written."""
    rows = json_to_columns(df, document, order, [order], header)
    tied = with_tie(rows, from_scan=False)
    written = range_partition(tied, [col(order), col(TIE)]).drop(order, TIE)
    (
        written.write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return rows.drop(order)
