"""Truth, emptiness and typed values: what every formula agrees on.

Null, the empty text and the empty list are empty. Null, false, zero, the empty
text and the empty list are not truthy. Casts never fail: what does not fit is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of property values and the Spark types they take.
KINDS = {"checkbox": "boolean", "date": "date", "datetime": "timestamp_ntz", "multitext": "array<string>", "number": "double", "text": "string"}

# Field types of table exports, by the kind of property they become. None: by the type of their result.
FIELD_KINDS = {
    "checkbox": "checkbox", "date": "date", "dateTime": "datetime", "createdTime": "datetime", "lastModifiedTime": "datetime",
    "number": "number", "percent": "number", "duration": "number", "autoNumber": "number", "currency": "number", "rating": "number",
    "singleLineText": "text", "multilineText": "text", "richText": "text", "email": "text", "url": "text", "phoneNumber": "text",
    "singleSelect": "text", "singleCollaborator": "text", "createdBy": "text", "lastModifiedBy": "text", "barcode": "text", "aiText": "text",
    "multipleSelects": "multitext", "multipleCollaborators": "multitext", "multipleRecordLinks": "multitext", "multipleAttachments": "multitext",
    "formula": None, "rollup": None, "multipleLookupValues": None, "count": "number", "button": None,
}
# Property types of page exports, likewise. date: see ``date_kind``.
PAGE_KINDS = {
    "number": "number", "checkbox": "checkbox", "select": "text", "status": "text", "multi_select": "multitext", "rich_text": "text", "url": "text",
    "email": "text", "phone_number": "text", "people": "multitext", "files": "multitext", "relation": "multitext", "created_time": "datetime",
    "last_edited_time": "datetime", "created_by": "text", "last_edited_by": "text", "unique_id": "text", "verification": "text", "place": "multitext",
    "title": None, "formula": None, "rollup": None, "button": None,
}


def is_empty(x: Column, kind: str = "text") -> Column:
    if kind == "multitext":
        return x.isNull() | (F.size(x) <= 0)
    return x.isNull() | (x == "") if kind == "text" else x.isNull()


def truthy(x: Column, kind: str = "text") -> Column:
    if kind == "checkbox":
        return F.coalesce(x, F.lit(False))
    if kind == "number":
        return F.coalesce((x != 0) & ~F.isnan(x.cast("double")), F.lit(False))
    return ~is_empty(x, kind)


def number(x: Column) -> Column:
    """The number that a text spells, or null; NaN counts as none."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value), value)


def typed(x: Column, kind: str) -> Column:
    """A value of text as the Spark type of its kind."""
    if kind == "number":
        return number(x)
    if kind == "text":
        return F.nullif(x, F.lit(""))
    return x.try_cast(KINDS[kind])


def field_value(value: Column, field_type: str) -> Column:
    """A field of a table export, read from its JSON text, as its property's type.

    Select and collaborator objects give their name (or email), barcodes their
    text, generated text its value once generated; unknown types keep their JSON.
    """
    at = lambda path: F.get_json_object(value, path)
    # A text may come without its quotes, which is no JSON.
    whole = F.coalesce(at("$"), F.nullif(value, F.lit("null")))
    plain = F.coalesce(at("$.name"), at("$.email"), whole)
    if field_type in ("singleCollaborator", "createdBy", "lastModifiedBy"):
        return F.coalesce(F.nullif(at("$.name"), F.lit("")), F.nullif(at("$.email"), F.lit("")))
    if field_type == "barcode":
        return at("$.text")
    if field_type == "aiText":
        return F.when(at("$.state") == "generated", at("$.value"))
    if field_type == "singleSelect":
        return F.nullif(plain, F.lit(""))
    if field_type == "multipleCollaborators":
        items = F.from_json(value, "array<struct<name:string,email:string>>")
        return F.transform(items, lambda p: F.coalesce(F.nullif(p["name"], F.lit("")), p["email"]))
    if field_type == "count":
        return F.coalesce(number(at("$")), F.lit(0.0))
    if field_type == "button":
        return F.lit(None).cast("string")
    kind = FIELD_KINDS.get(field_type)
    if kind == "multitext":
        return F.from_json(value, "array<string>")
    return typed(whole, kind) if kind else value


def page_value(value: Column, page_type: str) -> Column:
    """A property of a page export, read from its JSON text."""
    at = lambda path: F.get_json_object(value, f"$.{page_type}{path}")
    if page_type in ("select", "status"):
        return at(".name")
    if page_type in ("multi_select", "people"):
        items = F.from_json(at(""), "array<struct<id:string,name:string>>")
        return F.transform(items, lambda p: F.coalesce(p["name"], p["id"]))
    if page_type == "relation":
        return F.transform(F.from_json(at(""), "array<struct<id:string>>"), lambda p: p["id"])
    if page_type in ("rich_text", "title"):
        return F.array_join(F.transform(F.from_json(at(""), "array<struct<plain_text:string>>"), lambda p: p["plain_text"]), "")
    if page_type == "date":
        return F.concat_ws(" to ", at(".start"), at(".end"))
    if page_type in ("created_by", "last_edited_by"):
        return F.coalesce(at(".name"), at(".person.email"), at(".id"))
    if page_type == "unique_id":
        return F.concat_ws("-", at(".prefix"), at(".number"))
    if page_type == "verification":
        return at(".state")
    if page_type == "place":
        return F.array(at(".lat"), at(".lon"))
    if page_type == "formula":
        return F.coalesce(at(".string"), at(".number"), at(".boolean"), at(".date.start"))
    kind = PAGE_KINDS.get(page_type)
    return typed(at(""), kind) if kind in ("number", "checkbox", "text") else at("")


def date_kind(starts: Column, ends: Column) -> Column:
    """Aggregate: the kind that fits all dates of a property: text if any has an end, datetime if any a time, else date."""
    timed = F.coalesce(F.bool_or(F.contains(starts, F.lit("T"))), F.lit(False))
    return F.when(F.count_if(ends.isNotNull()) > 0, "text").when(timed, "datetime").otherwise("date")
