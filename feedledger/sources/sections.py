"""Sectioned documents: a heading sets the stage of the links that follow it.

Cutting the text in front of its headings gives every section its mark directly, so no
window over lines is needed and a long document never becomes a sort group.
"""

from pyspark.sql import Column, functions as F

from ..functions.urls import last_segment, let
from .entries import ENTRIES, entry, parsed, quoted

_BLANK = r"[^\S\n]"
_STAGE = rf"(?i)^#{{1,3}}{_BLANK}*Stage{_BLANK}+(\d)\b"
_WITHDRAWN = rf"(?i)^#{{1,3}}{_BLANK}*Withdrawn\b"
_CUT = (rf"(?imd)^(?=#{{1,3}}(?:{_BLANK}|{_BLANK}*Stage{_BLANK}+\d\b|{_BLANK}*Withdrawn\b))")
DEFAULT_PREFIX = "https://github.com/tc39/"


def split_before(text: Column, heading: str) -> Column:
    """Pieces of a text, each starting with a heading (the first may not)."""
    return F.split(text, heading)


def section_stage(section: Column) -> Column:
    """Stage digit or ``withdrawn``; NULL below any other heading."""
    digit = F.regexp_extract(section, _STAGE, 1)
    return (F.when(digit != "", digit)
            .when(section.rlike(_WITHDRAWN), F.lit("withdrawn")))


def stage_entries(text: Column, link_prefix: str = DEFAULT_PREFIX) -> Column:
    """Snapshot entries ``(heading, link, slug, stage)`` of a sectioned document."""
    pattern = rf"\[([^\]\n]+)\]\(({link_prefix.replace('.', chr(92) + '.')}[^)\s]+)\)"

    def links(section: Column) -> Column:
        rest = F.regexp_replace(section, r"^[^\n]*", "")
        found = F.regexp_extract_all(rest, F.lit(pattern), F.lit(0))
        return let(section_stage(section), lambda stage: F.when(
            stage.isNotNull(), F.transform(found, lambda m: let(
                F.regexp_extract(m, pattern, 2), lambda url: entry(
                    F.regexp_extract(m, pattern, 1), url,
                    slug=last_segment(url), stage=stage)))))

    per_section = F.transform(split_before(text, _CUT), links)
    return F.flatten(F.filter(per_section, lambda s: s.isNotNull()))


def document_text(body: Column) -> Column:
    """The document itself, or the base64 ``content`` of a JSON envelope around it; NULL where
    that is no base64 or no UTF-8."""
    content = F.get_json_object(body, "$.content")
    return F.when(body.rlike(r"^\s*\{") & content.isNotNull(),
                  F.try_validate_utf8(F.try_to_binary(
                      F.regexp_replace(content, r"\s", ""), F.lit("base64")).cast("string"))
                  ).otherwise(body)


def parse_stage_document(body: Column, url: Column, filters: Column, policy: Column) -> Column:
    return let(stage_entries(document_text(body)).cast(ENTRIES), lambda e: parsed(
        e, F.when(F.coalesce(F.size(e), F.lit(0)) <= 0,
                  quoted('Parsed zero proposals from "', url,
                         '": its structure may have changed'))))
