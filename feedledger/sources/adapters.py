"""Adapters: which parser reads a source's payloads.

An adapter names a Column expression ``parse(body, url, filters, policy)`` that yields
``STRUCT<entries, error>``. All registered adapters are branches of one CASE, so the
payload table is scanned once however many formats it holds.
"""

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .entries import ENTRIES, parsed, quoted, with_canonical_links
from .feeds import parse_feed
from .json_api import parse_json_api
from .repositories import added_to, is_files_payload, parse_pulls, parse_releases
from .sections import parse_stage_document
from .web_pages import parse_web_page

Parser = Callable[[Column, Column, Column, Column], Column]


def _unchanged(entries: DataFrame, previous: DataFrame) -> DataFrame:
    return entries


@dataclass(frozen=True)
class Fragment:
    """State that an adapter keeps from run to run, in a table of its own.

    ``schema`` has ``source_id`` and whatever else the adapter needs. A run hands both functions
    the exploded entries of its usable payloads (``source_id, seq, at, entry`` and the
    source's columns) and the rows as the last accepted run left them. ``derive`` gives the
    rows that the next run will find: sources it names are replaced, the others keep theirs.
    ``select`` gives the entries to go on with, for adapters that compare with what they saw
    before. Both are plans, evaluated on the executors; nothing is kept of a rejected run.
    """
    table: str
    schema: StructType
    derive: Callable[[DataFrame, DataFrame], DataFrame]
    select: Callable[[DataFrame, DataFrame], DataFrame] = _unchanged

    def merged(self, entries: DataFrame, previous: DataFrame) -> DataFrame:
        derived = self.derive(entries, previous).select(*self.schema.fieldNames())
        kept = previous.join(derived.select("source_id").distinct(), "source_id", "left_anti")
        return kept.select(*self.schema.fieldNames()).unionByName(derived)


@dataclass(frozen=True)
class Adapter:
    name: str
    event: str
    parse: Parser
    #: Links are resolved, canonicalised and used as the item key.
    canonical: bool = True
    #: Entries are a stage snapshot, turned into items by the lifecycle diff.
    snapshot: bool = False
    #: Entries count only if a changed-files payload confirms them.
    needs_files: bool = False
    #: State of its own between runs.
    fragment: Fragment | None = None


class AdapterRegistry(dict):
    """Adapters by name; a name can be registered once."""

    def __init__(self, adapters: Iterable[Adapter] = ()):
        super().__init__()
        for adapter in adapters:
            self.register(adapter)

    def register(self, adapter: Adapter) -> None:
        if adapter.name in self:
            raise ValueError(f'Duplicate adapter registered: "{adapter.name}"')
        if adapter.fragment is not None:
            if "source_id" not in adapter.fragment.schema.fieldNames():
                raise ValueError(f'State of adapter "{adapter.name}" has no source_id')
            if adapter.fragment.table in [f.table for f in self.fragments().values()]:
                raise ValueError(f'Two adapters keep state in "{adapter.fragment.table}"')
        self[adapter.name] = adapter

    def fragments(self) -> dict[str, Fragment]:
        """State tables by the name of their adapter."""
        return {a.name: a.fragment for a in self.values() if a.fragment is not None}

    def named(self, **traits: bool) -> list[str]:
        return [a.name for a in self.values()
                if all(getattr(a, k) == v for k, v in traits.items())]


# Adapter names as source rows spell them.
BUILT_IN = (
    Adapter("feed", "feed-entry", parse_feed),
    Adapter("github-release", "github-stable-release", parse_releases),
    Adapter("official-api", "api-item", parse_json_api),
    Adapter("generic-html-json-ld", "website-article", parse_web_page),
    Adapter("react-rfc", "rfc-proposal-opened", parse_pulls),
    Adapter("react-native-proposals", "rfc-proposal-opened", parse_pulls, needs_files=True),
    Adapter("tc39-proposal-lifecycle", "tc39-proposal-created", parse_stage_document,
            canonical=False, snapshot=True),
)


def default_registry() -> AdapterRegistry:
    return AdapterRegistry(BUILT_IN)


def parse_payloads(landed: DataFrame, registry: AdapterRegistry) -> DataFrame:
    """Add ``entries``, ``error`` and ``adding`` to payloads that already carry their source
    columns.

    304 is a success without rows, any other non-2xx status an error. A changed-files
    payload has no entries of its own; ``adding`` is the pull request that it confirms.
    """
    body, url = F.col("body"), F.col("url")
    filters, policy = F.col("filters"), F.col("release_policy")
    nothing = parsed(F.array().cast(ENTRIES))
    status = F.col("http_status")
    result = (
        F.when(status == 304, nothing)
        .when(~status.between(200, 299) | status.isNull(), parsed(
            F.lit(None).cast(ENTRIES),
            quoted("HTTP ", F.coalesce(status.cast("string"), F.lit("status missing")),
                   " for ", url))))
    for adapter in registry.values():
        entries = adapter.parse(body, url, filters, policy)
        if adapter.canonical:
            entries = with_canonical_links(entries, url)
        branch = F.col("adapter") == adapter.name
        if adapter.needs_files:
            result = result.when(branch & is_files_payload(url), nothing)
        result = result.when(branch, entries)
    result = result.otherwise(parsed(
        F.lit(None).cast(ENTRIES), quoted('Unsupported adapter "', F.col("adapter"), '"')))
    checked = registry.named(needs_files=True)
    adding = F.when(F.col("adapter").isin(*checked), added_to(body, url)) if checked \
        else F.lit(None).cast("string")
    return (landed.withColumn("_parsed", result)
            .withColumns({"entries": F.col("_parsed.entries"), "error": F.col("_parsed.error"), "adding": adding})
            .drop("_parsed"))
