"""Repository payloads: releases, pull requests, changed files."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import first_non_empty
from ..functions.urls import let
from .entries import entry, parsed, quoted

_RELEASES = ("ARRAY<STRUCT<tag_name STRING, name STRING, html_url STRING, "
             "published_at STRING, draft BOOLEAN, prerelease BOOLEAN>>")
_PULLS = "ARRAY<STRUCT<number BIGINT, title STRING, html_url STRING, created_at STRING>>"
_FILES = "ARRAY<STRUCT<filename STRING, status STRING>>"
FILES_URL = r"/pulls/(\d+)/files$"
PROPOSAL_FOLDER = "proposals/"


def json_rows(body: Column, schema: str) -> Column:
    """Rows of a JSON payload; a single object counts as a one-row array."""
    return F.from_json(body, schema)


def releasable(draft: Column, prerelease: Column, include_prerelease: Column) -> Column:
    """Drafts never; prereleases only where the source opted in."""
    return (~F.coalesce(draft, F.lit(False))
            & (~F.coalesce(prerelease, F.lit(False))
               | F.coalesce(include_prerelease, F.lit(False))))


def parse_releases(body: Column, url: Column, filters: Column, policy: Column) -> Column:
    def kept(rows: Column) -> Column:
        chosen = F.filter(rows, lambda r: releasable(
            r["draft"], r["prerelease"], policy["include_prerelease"]))
        return parsed(
            F.transform(chosen, lambda r: entry(
                first_non_empty(r["name"], r["tag_name"]), r["html_url"], r["published_at"])),
            F.when(rows.isNull(), quoted('Malformed release payload from "', url, '"')))

    return let(json_rows(body, _RELEASES), kept)


def parse_pulls(body: Column, url: Column, filters: Column, policy: Column) -> Column:
    """Every pull request; its date is the date part as written, not converted to UTC.

    ``slug`` carries the pull request number for the changed-files check.
    """
    return let(json_rows(body, _PULLS), lambda rows: parsed(
        F.transform(rows, lambda r: entry(
            r["title"], r["html_url"], F.substring(r["created_at"], 1, 10),
            slug=r["number"].cast("string"))),
        F.when(rows.isNull(), quoted('Malformed pull request payload from "', url, '"'))))


def is_files_payload(url: Column) -> Column:
    return url.rlike(FILES_URL)


def added_to(body: Column, url: Column, folder: str = PROPOSAL_FOLDER) -> Column:
    """The number of the pull request whose changed files these are, if it adds at least one
    file below ``folder``; else NULL. The files are looked through inside the payload."""
    added = F.exists(json_rows(body, _FILES), lambda f: (f["status"] == "added") & f["filename"].startswith(folder))
    return F.when(is_files_payload(url), F.when(added, F.regexp_extract(url, FILES_URL, 1)))


def pulls_adding_files(file_payloads: DataFrame, folder: str = PROPOSAL_FOLDER) -> DataFrame:
    """``(source_id, slug)`` of pull requests that add at least one file below ``folder``."""
    return (file_payloads.select("source_id", added_to(F.col("body"), F.col("url"), folder).alias("slug"))
            .where("slug IS NOT NULL").distinct())


def with_added_files(pulls: DataFrame, adding: DataFrame) -> DataFrame:
    return pulls.join(adding, ["source_id", "slug"], "left_semi")
