"""Virtual scopes: a source may own only a slice of what its payload lists."""

from pyspark.sql import Column, functions as F

from ..functions.urls import url_path


def in_scope(heading: Column, link: Column, contains: Column | None = None,
             excludes: Column | None = None, path_prefix: Column | None = None) -> Column:
    """All given constraints hold; an empty or missing constraint is no constraint.

    Headings compare without case, paths with it.
    """
    def absent(option: Column) -> Column:
        return option.isNull() | (option == "")

    ok = F.lit(True)
    text = F.lower(heading)
    if contains is not None:
        ok = ok & (absent(contains) | F.contains(text, F.lower(contains)))
    if excludes is not None:
        ok = ok & (absent(excludes) | ~F.contains(text, F.lower(excludes)))
    if path_prefix is not None:
        ok = ok & (absent(path_prefix) | F.coalesce(
            F.startswith(url_path(link), path_prefix), F.lit(False)))
    return ok


def in_source_scope(heading: Column, link: Column, filters: Column) -> Column:
    """Scope test with the constraints a source row keeps in its JSON options."""
    def option(name: str) -> Column:
        return F.get_json_object(filters, f"$.virtualScope.{name}")

    return F.get_json_object(filters, "$.virtualScope").isNull() | in_scope(
        heading, link, option("titleContains"), option("titleExcludes"),
        option("linkPathPrefix"))
