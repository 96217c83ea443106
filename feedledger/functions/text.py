"""Ids, labels, tags, headings and messages as column expressions."""

from itertools import chain

from pyspark.sql import Column, functions as F

from ..schemas import LABEL_BY_EVENT, REJECTION_TITLES


def item_id(key: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the de-duplication key."""
    return F.substring(F.sha2(key, 256), 1, 16)


def lifecycle_key(slug: Column, event: Column, namespace: str = "tc39") -> Column:
    """Composite key of one lifecycle event; several events may share a link."""
    return F.concat_ws(":", F.lit(namespace), slug, event)


def lifecycle_heading(name: Column, stage: Column) -> Column:
    return F.concat(name, F.lit(" — "), F.when(stage == "withdrawn", stage)
                    .otherwise(F.concat(F.lit("Stage "), stage)))


def label_for(event: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(LABEL_BY_EVENT.items())])
    return F.try_element_at(table, event)


def tag_union(static: Column, structured: Column) -> Column:
    """Distinct union of both tag lists, sorted."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(static, empty), F.coalesce(structured, empty)))


def non_empty(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def extract(text: Column, pattern: Column, group: int) -> Column:
    """``regexp_extract`` whose pattern may differ per row."""
    return F.call_function("regexp_extract", text, pattern, F.lit(group))


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def specificity(filters: Column) -> Column:
    """Number of filter keys a source declares; more keys, more specific."""
    keys = F.json_object_keys(filters)
    return F.coalesce(F.size(keys), F.lit(0))


def plural(count: Column, noun: str) -> Column:
    suffix = F.when(count == 1, F.lit("")).otherwise(F.lit("s"))
    return F.concat(count.cast("string"), F.lit(f" {noun}"), suffix)


def rejection_text(reason: Column, detail: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(REJECTION_TITLES.items())])
    return F.concat(F.try_element_at(table, reason), F.lit(": "), detail)


def issue_line(check: Column, message: Column) -> Column:
    return F.concat(F.lit("["), check, F.lit("] "), message)


def markup_text(fragment: Column) -> Column:
    """Text of an HTML fragment: tags removed, basic entities decoded, trimmed."""
    text = F.regexp_replace(fragment, r"(?s)<[^>]*>", "")
    # The entities decoded; the ampersand comes last.
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")
