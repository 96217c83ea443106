"""URL expressions: canonical form, link resolution, and parts of a URL.

The longer ones are written as SQL lambdas: :func:`let` evaluates its argument once per
row and the lambda refers to it by name as often as it likes.
"""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Query parameters that only track the visit.
TRACKING_PREFIX = "utm_"
TRACKING_NAMES = (
    "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref", "ref_src", "source",
)

_SHAPE = (
    r"^([A-Za-z][A-Za-z0-9+.\-]*)://"      # 1 scheme
    r"(?:([^/?#@]*)@)?"                    # 2 user info
    r"([^/?#:@\[\]\s]+|\[[0-9A-Fa-f:.]+\])"  # 3 host
    r"(?::(\d*))?"                         # 4 port
    r"(/[^?#]*)?"                          # 5 path
    r"(?:\?([^#]*))?"                      # 6 query
    r"(?:#.*)?$"
)


def let(value: Column, body: str | Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, a SQL lambda or a function."""
    if callable(body):
        return F.transform(F.array(value), body)[0]
    return F.call_function("transform", F.array(value), F.expr(body))[0]


def _sql_let(value: str, body: str) -> str:
    return f"transform(array({value}), {body})[0]"


# Trimmed the way a URL parser does: outer blanks and any tab or newline go. \x01 cannot
# be left in the text, so it marks the borders of the six parts.
_CLEAN = r"regexp_replace(trim(u), r'[\t\r\n\x01]', '')"
_MARKS = r"concat_ws(char(1), '$1', '$2', '$3', '$4', '$5', '$6')"
#: Scheme, user, host, port, path and query; NULL for anything but an absolute URL.
_PARTS = _sql_let(f"split(regexp_replace({_CLEAN}, r'{_SHAPE}', {_MARKS}), char(1))",
                  "p -> if(size(p) = 6, p, NULL)")

_UNSAFE = r"""r'[^\x21-\x7e]|["<>`{}\^]'"""
# Percent-encode what may not stand in a path, then resolve . and .. segments. Both are
# skipped for the many paths that need neither.
_ESCAPED = f"""
  if(s rlike {_UNSAFE},
     array_join(transform(regexp_extract_all(s, '(?s).', 0),
                          c -> if(c rlike {_UNSAFE}, replace(url_encode(c), '+', '%20'), c)), ''),
     s)"""
_UNDOTTED = r"""
  if(s rlike r'/\.\.?(/|$)',
     concat('/', array_join(aggregate(
         slice(split(s, '/'), 2, size(split(s, '/'))), CAST(array() AS array<string>),
         (kept, x) -> CASE WHEN x = '..' THEN slice(kept, 1, greatest(size(kept) - 1, 0))
                           WHEN x = '.' THEN kept ELSE concat(kept, array(x)) END), '/'),
       if(s rlike r'[^/]/\.\.?$', '/', '')),
     s)"""
_PATH = _sql_let(_sql_let("if(p[4] = '', '/', p[4])", f"s -> {_ESCAPED}"), f"s -> {_UNDOTTED}")

_NAMES = ", ".join(f"'{n}'" for n in TRACKING_NAMES)
# Parameters are decoded, stripped of tracking ones, sorted by name in locale order and
# encoded again; equal names keep their order.
_QUERY = f"""
  array_join(transform(array_sort(filter(transform(
      filter(split(p[5], '&'), x -> x <> ''),
      (x, i) -> struct(
        collate(coalesce(try_url_decode(split_part(x, '=', 1)), split_part(x, '=', 1)), 'UNICODE') AS name,
        i AS at,
        coalesce(try_url_decode(regexp_extract(x, '^[^=]*=(.*)$', 1)), regexp_extract(x, '^[^=]*=(.*)$', 1)) AS value)),
      x -> NOT (startswith(lower(collate(x.name, 'UTF8_BINARY')), '{TRACKING_PREFIX}')
                OR lower(collate(x.name, 'UTF8_BINARY')) IN ({_NAMES})))),
    x -> concat(url_encode(collate(x.name, 'UTF8_BINARY')), '=', url_encode(x.value))), '&')"""

_CANONICAL = f"""
p -> concat(
  lower(p[0]), '://', if(p[1] = '', '', concat(p[1], '@')),
  regexp_replace(lower(p[2]), r'^www\\.', ''),
  CASE WHEN p[3] = '' OR (lower(p[0]), p[3]) IN (('http', '80'), ('https', '443')) THEN ''
       ELSE concat(':', p[3]) END,
  regexp_replace({_PATH}, '(?<=.)/$', ''),
  if(p[5] = '', '', regexp_replace({_QUERY}, '^(?=.)', '?')))"""


def canonical_url(raw: Column) -> Column:
    """Canonical form of a URL for de-duplication; NULL when it cannot be parsed.

    Scheme and host are lower-cased, ``www.``, the default port, the fragment,
    tracking parameters and one trailing slash go, remaining parameters are sorted.
    Path and parameter values keep their case.
    """
    return let(let(raw, f"u -> {_PARTS}"), _CANONICAL)


_ORIGIN = """concat(b[0], '://', if(b[1] = '', '', concat(b[1], '@')), b[2],
                    if(b[3] = '', '', concat(':', b[3])))"""
_RESOLVED = f"""
x -> {_sql_let("x.base", f'''b -> CASE
  WHEN x.link rlike r'^[A-Za-z][A-Za-z0-9+.\\-]*:' THEN x.link
  WHEN startswith(x.link, '//') THEN concat(b[0], ':', x.link)
  WHEN startswith(x.link, '/') THEN concat({_ORIGIN}, x.link)
  WHEN startswith(x.link, '?') THEN concat({_ORIGIN}, if(b[4] = '', '/', b[4]), x.link)
  WHEN startswith(x.link, '#') THEN concat({_ORIGIN}, if(b[4] = '', '/', b[4]),
                                           if(b[5] = '', '', concat('?', b[5])), x.link)
  ELSE concat({_ORIGIN}, if(b[4] = '', '/', regexp_replace(b[4], '[^/]*$', '')), x.link) END''')}"""


def resolve_link(link: Column, base: Column) -> Column:
    """Resolve a link found in a document against that document's URL."""
    given = F.struct(let(link, f"u -> {_CLEAN}").alias("link"),
                     let(base, f"u -> {_PARTS}").alias("base"))
    return let(given, _RESOLVED)


def url_path(link: Column) -> Column:
    """Path of an absolute URL, ``/`` if empty; NULL if the URL is not absolute."""
    return let(let(link, f"u -> {_PARTS}"), "p -> if(p[4] = '', '/', p[4])")


def path_segments(link: Column) -> Column:
    return let(url_path(link), "s -> filter(split(s, '/'), x -> x <> '')")


def last_segment(link: Column) -> Column:
    """Last non-empty path segment, or the URL itself when the path is empty."""
    return F.coalesce(F.try_element_at(path_segments(link), F.lit(-1)), link)


def owner_and_repo(link: Column) -> Column:
    """First two path segments as ``STRUCT<owner, repo>``; NULL if either is missing."""
    return let(path_segments(link),
               "s -> if(size(s) >= 2, named_struct('owner', s[0], 'repo', s[1]), NULL)")
