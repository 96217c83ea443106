"""JSON API payloads whose item path and field names come from the source row."""

from pyspark.sql import Column, functions as F

from ..functions.urls import let
from .entries import ENTRIES, entry, parsed, quoted


def _option(filters: Column, name: str, default: str | None = None) -> Column:
    value = F.get_json_object(filters, f"$.{name}")
    return value if default is None else F.coalesce(value, F.lit(default))


def _string_field(row: Column, name: Column) -> Column:
    """A field as text, only if it is a JSON string."""
    value = F.try_element_at(row, name)
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def parse_json_api(body: Column, url: Column, filters: Column, policy: Column) -> Column:
    """Items below the configured dot path; one row without a required field fails all."""
    path = _option(filters, "itemsPath")
    json_path = F.when(path.isNull() | (path == ""), F.lit("$")).otherwise(F.concat(
        F.lit("$['"), F.array_join(F.split(path, r"\."), "']['"), F.lit("']")))
    heading_field = _option(filters, "headingField", "title")
    link_field = _option(filters, "linkField", "url")
    date_field = _option(filters, "dateField")
    text = F.call_function("get_json_object", body, json_path)
    rows = F.when(text.rlike(r"^\s*\["),
                  F.try_parse_json(text).try_cast("array<map<string,variant>>"))

    def result(found: Column) -> Column:
        entries = F.transform(found, lambda r: entry(
            _string_field(r, heading_field), _string_field(r, link_field),
            F.when(date_field.isNotNull(), _string_field(r, date_field))))
        return let(entries.cast(ENTRIES), lambda e: parsed(e, error(found, e)))

    def error(found: Column, e: Column) -> Column:
        missing = F.filter(
            F.transform(e, lambda x, i: F.struct(
                i.alias("at"),
                F.when(F.coalesce(x["heading"], F.lit("")) == "", heading_field)
                .when(F.coalesce(x["link"], F.lit("")) == "", link_field).alias("field"))),
            lambda x: x["field"].isNotNull())
        first = F.try_element_at(missing, F.lit(1))
        return (
            F.when(found.isNull(), quoted(
                'API response from "', url, '" did not contain an array of items at "',
                F.coalesce(path, F.lit("(root)")), '"'))
            .when(F.size(found) == 0, quoted(
                'API response from "', url, '" returned zero items'))
            .when(first.isNotNull(), quoted(
                'API response from "', url, '" item ', first["at"].cast("string"),
                ' is missing a valid "', first["field"], '" field')))

    return let(rows, result)
