"""The shape every payload parser produces.

A parser is a Column expression over one landed payload, so any number of formats is
parsed in one pass over the payload table. It never raises: a payload that cannot be
used carries its reason in ``error``, which later becomes that source's failed outcome.
"""

from pyspark.sql import Column, functions as F

from ..functions.urls import canonical_url, let, resolve_link

ENTRY = ("STRUCT<heading STRING, link STRING, published STRING, tags ARRAY<STRING>, "
         "slug STRING, stage STRING>")
ENTRIES = f"ARRAY<{ENTRY}>"


def entry(heading: Column, link: Column, published: Column | None = None,
          tags: Column | None = None, slug: Column | None = None,
          stage: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    tags = F.array() if tags is None else tags
    return F.struct(
        heading.alias("heading"), link.alias("link"),
        (null if published is None else published).alias("published"),
        F.coalesce(tags.cast("array<string>"), F.array().cast("array<string>")).alias("tags"),
        (null if slug is None else slug).alias("slug"),
        (null if stage is None else stage).alias("stage"))


def complete(entries: Column) -> Column:
    """Entries that have both a heading and a link."""
    return F.filter(entries, lambda e: F.coalesce(
        (e["heading"] != "") & (e["link"] != ""), F.lit(False)))


def parsed(entries: Column, error: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(entries.cast(ENTRIES).alias("entries"),
                    (none if error is None else error).alias("error"))


def quoted(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def with_canonical_links(result: Column, url: Column) -> Column:
    """Resolve every link against the payload URL and canonicalise it.

    A link that is no URL fails the payload, so a broken source is reported instead of
    silently losing items.
    """
    def canonical(e: Column) -> Column:
        return entry(e["heading"], canonical_url(resolve_link(e["link"], url)),
                     e["published"], e["tags"], e["slug"], e["stage"])

    def checked(entries: Column) -> Column:
        bad = F.exists(entries, lambda e: e["link"].isNull())
        return F.when(bad, quoted('Invalid URL among the entries of "', url, '"'))

    return let(result, lambda r: let(
        F.transform(r["entries"], canonical),
        lambda e: parsed(e, F.coalesce(r["error"], checked(e)))))
