"""URL filters: which listed host and path prefixes a URL falls under, by Bloom filter cascades.

A rule names a host and the beginning of a path. A URL's candidate keys are the suffixes of its
host joined to the prefixes of its path, of the shapes that the rules have. A cascade tells of
every candidate key of the corpus, without error, whether it is listed: its first filter encodes
the listed keys, the next one the first one's false positives among all other keys of the corpus,
the next one the listed keys that this one takes in by mistake, and so on, until no mistake is
left. Filters are as large as the list, not the corpus, so they reach the rows as scalar
subqueries; rows are neither joined nor moved.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .shared import fresh, staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://``: the host up to ``/``, ``?``, ``#`` or the end, A-Z in lower
    case, and the path up to ``?``, ``#`` or the end. Both are empty for null and other texts."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Level:
    """One filter: a written row with its ``words`` of 64 bits, and how keys are hashed into it."""
    words: DataFrame
    number: int
    bits: int
    hashes: int

    def place(self, key: Column, i: int) -> Column:
        # The literals come first: they seed the hash of the key, so levels err independently.
        return F.pmod(F.xxhash64(F.lit(self.number), F.lit(i), key), F.lit(self.bits))

    def holds(self, key: Column, words: Column) -> Column:
        """Whether all bits of a key are set."""
        found = F.lit(True)
        for i in range(self.hashes):
            at = self.place(key, i)
            word = F.get(words, F.floor(at / 64).cast("int"))
            found = found & (F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
        return found


def _filled(keys: DataFrame, level: Level) -> DataFrame:
    """One row with the words of a level that encodes ``keys``."""
    places = F.explode(F.array(*[level.place(F.col("key"), i) for i in range(level.hashes)]))
    words = -(-level.bits // 64)
    ones = keys.select(places.alias("at")).select(
        F.floor(F.col("at") / 64).cast("long").alias("word"),
        F.expr("shiftleft(1L, int(pmod(at, 64)))").alias("bits"))
    none = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    dense = ones.unionByName(none).groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))),
                                 lambda w: w["bits"]).alias("words"))


@dataclass(frozen=True)
class Cascade:
    levels: list[Level]

    def attached(self, rows: DataFrame, prefix: str) -> tuple[DataFrame, list[str]]:
        """Rows with each filter in a column of its own (one shared object in every task)."""
        names = fresh(rows.columns, *[f"{prefix}{level.number}" for level in self.levels])
        for name, level in zip(names, self.levels, strict=True):
            rows = rows.withColumn(name, level.words.scalar())
        return rows, names

    def member(self, key: Column, names: list[str]) -> Column:
        """Whether a key of the universe is listed: in the first filter, and not in the second
        unless in the third, and so on."""
        listed = F.lit(False)
        for level, name in reversed(list(zip(self.levels, names, strict=True))):
            listed = level.holds(key, F.col(name)) & ~listed
        return listed


def cascade_bits(listed: int, others: int) -> int:
    """About how many bits a cascade takes: some 1.44 * (log2(others / listed) + 4) a listed key."""
    return math.ceil(listed / math.log(2) * (max(0.5, math.log2(max(others, 1) / max(listed, 1)) + 0.5) + 4))


def build_cascade(keys: DataFrame, listed: str) -> Cascade:
    """A cascade over a universe of different ``key``s, listed where SQL ``listed`` holds.

    The first filter lets through about as many other keys as are listed, later ones a half of
    what is left, so there are some log2(listed keys) levels. Each is written to the shared
    folder, and so are the keys that a level takes in by mistake: only they go on.
    """
    inside, outside = keys.where(listed).select("key"), keys.where(f"NOT ({listed})").select("key")
    n_in, n_out = (r or 0 for r in keys.agg(F.count_if(F.expr(listed)), F.count_if(~F.expr(listed))).first())
    levels: list[Level] = []
    while n_in:
        rate = 0.5 if levels else min(0.5, n_in / (math.sqrt(2) * max(n_out, 1)))
        bits = 64 * -(-max(64, math.ceil(n_in * math.log2(1 / rate) / math.log(2))) // 64)
        level = Level(keys, len(levels), bits, max(1, round(math.log2(1 / rate))))
        level = Level(staged(_filled(inside, level), "filter"), level.number, bits, level.hashes)
        levels.append(level)
        probed, (name,) = Cascade([level]).attached(outside, "filter")
        wrong = staged(probed.where(level.holds(F.col("key"), F.col(name))).select("key"), "mistaken")
        inside, outside, n_in, n_out = wrong, inside, wrong.count(), n_in
    return Cascade(levels)


def _clean_rules(rules: DataFrame) -> DataFrame:
    """``key, labels, chars, block``, one row per rule that can fit; of two rules for one key,
    the one that blocks counts."""
    host, path = F.translate("host", _UPPER, _LOWER), F.coalesce("path", F.lit(""))
    return (rules.select(host.alias("host"), path.alias("path"), (F.col("verdict") == "block").alias("block"))
            .where("host IS NOT NULL AND block IS NOT NULL AND host NOT RLIKE '[/?#]' "
                   "AND path NOT RLIKE '[?#]' AND (path = '' OR startswith(path, '/'))")
            .groupBy("host", "path").agg(F.max("block").alias("block"))
            .select(F.concat("host", "path").alias("key"),
                    F.expr("length(host) - length(replace(host, '.', '')) + 1").alias("labels"),
                    F.length("path").alias("chars"), "block"))


def _candidates(host: str, path: str, shapes: list[tuple[int, int]]) -> Column:
    """``array<struct<size, host_size, key>>``: the keys of a URL, of every shape it is long
    enough for. A host holds no slash and a path begins with one, so keys are not ambiguous."""
    listed = ", ".join(f"struct({n} AS n, {c} AS c)" for n, c in shapes)
    fit = (f"filter(array({listed}), s -> length({host}) - length(replace({host}, '.', '')) + 1 >= s.n "
           f"AND length({path}) >= s.c)")
    suffix = f"substring_index({host}, '.', -s.n)"
    return F.expr(f"transform({fit}, s -> struct(length({suffix}) + s.c AS size, length({suffix}) AS host_size, "
                  f"{suffix} || left({path}, s.c) AS key))")


def judge_urls(rows: DataFrame, rules: DataFrame, *, url_column: str = "url", default: str = "allow",
               most_bytes: int = 64 << 20) -> DataFrame:
    """``rows`` with ``host, path, rule, verdict``, named so that they clash with no column.

    ``rules`` has ``host, path, verdict``, the last ``allow`` or ``block``. A rule fits its host and
    all its subdomains where the path begins with the rule's; the longest one decides, of equally
    long ones that with the longer host. ``rule`` is its host and path, null if none fits; then
    no key of the URL is listed and the verdict is ``default``.

    Two cascades, built over all keys of the corpus, decide: one which keys are listed, one which
    of these block. Their size is known from counts before they are built. If it is over
    ``most_bytes``, which takes some tens of millions of rules that occur, the rules are joined
    to the different keys of the corpus instead, with the same result.

    Null URLs and those without ``://`` have an empty host and path. Rules with a null host or
    verdict, a host with ``/``, ``?`` or ``#`` or a path that no URL has are left out; of two
    for one key, ``block`` counts. Repeated rows are kept, each judged; no rows give none, no rules
    the default.
    """
    host, path, rule, verdict, keys, best = fresh(rows.columns, "host", "path", "rule", "verdict", "keys", "best")
    host_of, path_of = host_and_path(F.col(f"`{url_column}`").cast("string"))
    parsed = rows.withColumns({host: host_of, path: path_of})
    known = staged(_clean_rules(rules), "rules")
    shapes = sorted((r.labels, r.chars) for r in known.select("labels", "chars").distinct().collect())
    nothing = F.lit(None).cast("string")
    if not shapes:
        return parsed.withColumns({rule: nothing, verdict: F.lit(default)})
    candidates = _candidates(f"`{host}`", f"`{path}`", shapes)
    universe = parsed.select(F.explode(candidates).alias("c")).select(F.col("c.key").alias("key")).distinct()
    universe = staged(universe.join(known.select("key", "block"), "key", "left"), "url-keys")
    listed, blocking, others = universe.agg(
        F.count("block"), F.count_if("block"), F.count_if(F.isnull("block"))).first()
    size = cascade_bits(listed, others) + cascade_bits(blocking, listed - blocking)
    if size > 8 * most_bytes:
        return _joined(parsed, known, candidates, host, path, rule, verdict, default)
    lists = build_cascade(universe, "block IS NOT NULL")
    blocks = build_cascade(universe.where("block IS NOT NULL"), "block")
    probed, list_names = lists.attached(parsed.withColumn(keys, candidates), "listed")
    fitting = probed.withColumn(best, F.array_max(F.filter(
        F.col(keys), lambda c: lists.member(c["key"], list_names))))
    judged = fitting.withColumn(rule, F.col(f"{best}.key"))
    judged, block_names = blocks.attached(judged, "blocking")
    decided = F.when(F.col(rule).isNull(), F.lit(default)).when(
        blocks.member(F.col(rule), block_names), F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn(verdict, decided).select(*[F.col(f"`{c}`") for c in rows.columns], host, path, rule, verdict)


def _joined(parsed: DataFrame, known: DataFrame, candidates: Column, host: str, path: str, rule: str,
            verdict: str, default: str) -> DataFrame:
    """The same by joins, for lists beyond the size of a filter: different URLs meet the rules,
    and the rows then meet the few URLs under a rule."""
    urls = parsed.select(F.col(f"`{host}`").alias("h"), F.col(f"`{path}`").alias("p"), candidates.alias("c"))
    met = (urls.distinct().select("h", "p", F.explode("c").alias("c"))
           .join(known.select("key", "block"), F.col("c.key") == F.col("key"))
           .groupBy("h", "p").agg(F.max_by(F.struct("key", "block"), "c").alias("m")))
    both = parsed.join(met, (F.col(f"`{host}`") == F.col("h")) & (F.col(f"`{path}`") == F.col("p")), "left")
    decided = F.when(F.col("m").isNull(), F.lit(default)).when(F.col("m.block"), F.lit("block")).otherwise("allow")
    return both.withColumns({rule: F.col("m.key"), verdict: decided}).drop("h", "p", "m")
