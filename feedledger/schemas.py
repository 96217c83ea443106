"""Table schemas and the fixed vocabularies they use.

Every scan passes one of these schemas explicitly; nothing is inferred. Growing
per-source collections (ids already decided on, lifecycle stages) are child tables
rather than arrays inside a cursor row, so a source's history never has to fit in
one cell.
"""

from pyspark.sql.types import (
    ArrayType, BooleanType, DateType, IntegerType, LongType, StringType,
    StructField, StructType, TimestampType,
)


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


_S, _D, _T, _I, _L = StringType(), DateType(), TimestampType(), IntegerType(), LongType()

ITEM = _struct(
    ("id", _S), ("source_id", _S), ("heading", _S), ("label", _S), ("link", _S),
    ("date", _D), ("date_basis", _S), ("category", _S), ("tags", ArrayType(_S)),
    ("seq", _L), ("at", _I),
)
STATE = _struct(
    ("id", _S), ("state", _S), ("updated_at", _T), ("read_at", _T), ("ignored_at", _T),
    ("seq", _L),
)
TRANSITION = _struct(("id", _S), ("state", _S), ("ts", _T), ("seq", _L))
CURSOR = _struct(
    ("source_id", _S), ("last_run_at", _T), ("last_item_date", _D), ("last_item_id", _S),
)
KNOWN_UNDATED = _struct(("source_id", _S), ("id", _S))
LIFECYCLE_STAGE = _struct(("source_id", _S), ("slug", _S), ("stage", _S))
SOURCE = _struct(
    ("pos", _I), ("id", _S), ("name", _S), ("category", _S), ("kind", _S), ("url", _S),
    ("adapter", _S), ("initial_sync_from", _D), ("status", _S), ("filters", _S),
    ("release_policy", _struct(("include_prerelease", BooleanType()),
                               ("include_draft", BooleanType()))),
    ("tags", ArrayType(_S)), ("declared_in", _S),
)
REFERENCE_SOURCE = _struct(
    ("pos", _I), ("id", _S), ("name", _S), ("category", _S), ("url", _S), ("note", _S),
    ("declared_in", _S),
)
SOURCE_STATUS = _struct(
    ("source_id", _S), ("status", _S), ("last_success_at", _T), ("last_attempt_at", _T),
    ("failure_class", _S), ("reason", _S),
)
RUN = _struct(
    ("run_id", _L), ("last_run_at", _T),
    ("coverage", _struct(("succeeded", _L), ("failed", _L), ("planned", _L),
                         ("added", _L), ("total", _L))),
    ("rejected", _struct(("reason", _S), ("detail", _S))),
)
PAYLOAD = _struct(
    ("source_id", _S), ("url", _S), ("http_status", _I), ("fetched_at", _T), ("body", _S),
    ("seq", _L),
)
ISSUE = _struct(("check", _S), ("message", _S), ("times", _L))
FAILURE = _struct(("pos", _I), ("source_id", _S), ("line", _S))
OUTCOME = _struct(
    ("source_id", _S), ("pos", _I), ("outcome", _S), ("items", _L), ("reason", _S),
    ("attempted_at", _T),
)

# Enumerations of the data model, in declaration order.
CATEGORIES = (
    ("web-core", "Web Core & Frontend Ecosystem"),
    ("ai-engineering", "AI Engineering & Developer Workflows"),
    ("mobile-development", "Mobile Development"),
    ("software-architecture", "Software Design & System Architecture"),
    ("devops-cloud", "DevOps, Cloud & Infrastructure"),
    ("testing-quality", "Testing & Release Quality"),
    ("developer-tooling", "Developer Tooling, Runtimes & Web Standards"),
)
LABELS = (
    "Release", "Improvement", "Breaking Change", "Deprecation", "Retired",
    "RFC/Proposal", "Security Advisory", "Announcement", "Engineering Article",
)
LABEL_BY_EVENT = {
    "feed-entry": "Engineering Article",
    "github-stable-release": "Release",
    "github-security-advisory": "Security Advisory",
    "rfc-proposal-opened": "RFC/Proposal",
    "tc39-proposal-created": "RFC/Proposal",
    "tc39-stage-transition": "Improvement",
    "tc39-withdrawal": "Retired",
    "announcement": "Announcement",
    "api-item": "Announcement",
    "website-article": "Engineering Article",
}
DATE_BASES = ("published", "discovered")
STATES = ("unread", "read", "ignored")
STATE_FILTERS = ("all", "unread", "read")
SOURCE_KINDS = ("feed", "github-release", "github-event", "api", "website")
SOURCE_STATUSES = ("active", "failing", "planned")
FAILURE_CLASSES = ("config-invalid", "runtime-failing")
REJECTION_REASONS = (
    "volume-guard", "active-item-mutation", "cursor-regression", "validation-failed",
)
REJECTION_TITLES = {
    "volume-guard": "Change guard",
    "active-item-mutation": "Change guard",
    "cursor-regression": "Change guard",
    "validation-failed": "Validation",
}

# Operating limits.
PAGE_SIZE = 50
VOLUME_LIMIT = 200
WINDOW_HOURS = 36
TOMBSTONE_HOURS = 48
READ_RETENTION_MONTHS = 2
STALE_HOURS = 36
NEVER_RUN = "1970-01-01 00:00:00"
