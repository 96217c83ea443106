"""Language identification by Bayesian evidence fusion.

Evidence for each language: the text's character trigrams under a model fitted on labelled
rows, the language that the markup declares, the country code that the address ends in, and
the prior of the host. Host priors come from grouped counts of what the other evidence says
of the host's rows, smoothed towards its domain, that towards its suffix, that towards all.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .html_text import any_text
from .shared import fresh, let_sql, prepare_workers, staged

BUCKETS = 1 << 15
UNKNOWN = "und"
# Country codes whose pages are mostly in one of the languages.
SUFFIXES = {"de": "de", "at": "de", "li": "de", "fr": "fr", "mc": "fr", "es": "es", "mx": "es", "ar": "es",
            "cl": "es", "co": "es", "pe": "es", "ve": "es", "uk": "en", "us": "en", "au": "en", "nz": "en",
            "ie": "en"}


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def grams(text: str | None, step: int = 1 << 20):
    """Buckets of the trigrams of letters and single spaces, in stretches."""
    text = (text or "").lower()
    for i in range(0, len(text), step):
        codes = np.frombuffer(text[i:i + step + 2].encode("utf-32-le", "replace"), "<u4")
        letter = np.where(codes < 1 << 16, _letters()[np.minimum(codes, (1 << 16) - 1)], True)
        codes = np.where(letter, codes, 32).astype(np.uint32)
        codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
        codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]
        if len(codes) < 3:
            continue
        h = (codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA6B)
             ^ codes[2:] * np.uint32(0xC2B2AE35))
        yield ((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int64)


def fit(labelled: DataFrame, *, languages: tuple[str, ...] = ("de", "en", "es", "fr"), id_column: str = "doc_id",
        text_column: str = "text", label_column: str = "lang", sample_per_language: int = 1000,
        smoothing: float = 0.5) -> np.ndarray:
    """Log probabilities ``(buckets, languages)`` from at most ``sample_per_language`` rows each.

    The sample is the rows with the smallest id hashes, so reruns agree; their whole texts
    are counted in tasks. A language without rows gets a flat model.
    """
    prepare_workers(labelled.sparkSession)
    ids = labelled.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"))
    picked = None
    for language in languages:
        part = (ids.where(F.col("label") == language).orderBy(F.xxhash64("id"), "id")
                .limit(sample_per_language))
        picked = part if picked is None else picked.unionByName(part)
    texts = labelled.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"),
                            F.col(text_column).cast("string").alias("text"))
    # At most languages * sample_per_language rows are broadcast.
    sample = texts.join(F.broadcast(picked.select("id").distinct()), "id", "left_semi").where(
        F.col("label").isin(*languages)).select("label", "text")

    def counted(batches):
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for g in grams(text.as_py()):
                    counts[languages.index(label)] += np.bincount(g, minlength=BUCKETS)
        at, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[at, bucket])],
            ["language", "bucket", "n"])

    rows = (sample.mapInArrow(counted, "language int, bucket int, n long")
            .groupBy("language", "bucket").agg(F.sum("n").alias("n")).collect())
    counts = np.full((BUCKETS, len(languages)), smoothing)
    for r in rows:
        counts[r.bucket, r.language] += r.n
    return np.log(counts / counts.sum(axis=0))


def _agreement(said: Column, languages: tuple[str, ...], trust: float) -> Column:
    """Per language (and the unknown one) the log probability of what was said."""
    known, other = said.isin(*languages), (1 - trust) / max(1, len(languages) - 1)
    return F.array(*[F.when(~known | said.isNull(), F.lit(0.0)).when(said == name, F.lit(float(np.log(trust))))
                     .otherwise(F.lit(float(np.log(other)))) for name in languages],
                   F.when(~known | said.isNull(), F.lit(0.0)).otherwise(F.lit(float(np.log(1 / (len(languages) + 1))))))


def _shares(logs: str) -> str:
    """SQL: probabilities in proportion to the exponentials of an array."""
    return let_sql("top", f"array_max({logs})", let_sql(
        "es", f"transform({logs}, x -> exp(x - top))",
        let_sql("sum_", "aggregate(es, 0D, (t, x) -> t + x)", "transform(es, x -> x / sum_)")))


def identify(rows: DataFrame, model: np.ndarray, *, keep: tuple[str, ...], declared: Column, host: Column,
             text_column: str | None = None, html_column: str | None = None,
             languages: tuple[str, ...] = ("de", "en", "es", "fr"), temper: float = 3.0,
             declared_trust: float = 0.9, suffix_trust: float = 0.8, strength: float = 4.0,
             unknown: float = 1e-3, least: float = 0.5) -> DataFrame:
    """The columns of ``keep`` with ``language, confidence, accepted`` (lengthened on a clash).

    ``declared`` is the language that the markup names, ``host`` the host. The text is
    ``text_column``, or the main text of ``html_column`` (all its text where there is none). Trigram evidence is divided by
    ``temper``, as neighbouring trigrams share letters. An unknown language with evenly
    spread trigrams has the prior ``unknown``. A row's own vote is taken out of the counts
    its prior is made of. Rows whose text has no letters, whose best language is the unknown
    one or whose best probability is below ``least`` are not accepted; their language is the
    best known one's, or ``und``.

    Null declarations say nothing; null hosts are one host; declared tags are cut at ``-``.
    """
    spark = rows.sparkSession
    prepare_workers(spark)
    ll, n, said, at, suf, r, content, h, d, s, ch, cd, cs, ca, p = fresh(
        list(keep), "ll", "n", "said", "host", "suffix", "votes", "content", "h", "d", "s", "ch", "cd", "cs", "ca", "p")
    source = text_column or html_column
    body = rows.select(*keep, F.lower(F.substring_index(F.trim(declared), "-", 1)).alias(said),
                       F.lower(F.coalesce(host, F.lit(""))).alias(at), F.col(source).cast("string").alias(content))
    fields = body.schema.fields[:-1]
    broad = spark.sparkContext.broadcast(model)
    even = -float(np.log(BUCKETS))
    extract = any_text if html_column else (lambda t: t)

    def scored(batches):
        for b in batches:
            scores, counts = [], []
            for text in b.column(b.num_columns - 1):
                total, k = np.zeros(len(languages)), 0
                for g in grams(extract(text.as_py())):
                    total += broad.value[g].sum(axis=0)
                    k += len(g)
                scores.append([*(total / temper).tolist(), k * even / temper])
                counts.append(k)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(scores, pa.list_(pa.float64())), pa.array(counts, pa.int64())],
                [*b.schema.names[:-1], ll, n])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    count = len(languages) + 1
    evidence = (body.mapInArrow(scored, f"{schema}, `{ll}` array<double>, `{n}` long")
                .withColumn(suf, F.substring_index(at, ".", -1)))
    country = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    told = evidence.withColumn(ll, F.zip_with(
        F.zip_with(ll, _agreement(F.col(said), languages, declared_trust), lambda a, b: a + b),
        _agreement(F.when(F.col(at).contains("."), country[F.col(suf)]), languages, suffix_trust),
        lambda a, b: a + b))
    first = F.array(*[F.lit(float(np.log((1 - unknown) / len(languages))))] * len(languages),
                    F.lit(float(np.log(unknown))))
    voted = staged(told.withColumn(r, F.zip_with(ll, first, lambda a, b: a + b))
                   .withColumn(r, F.expr(f"IF({n} = 0, array_repeat(0D, {count}), {_shares(r)})")), "evidence")

    def total(votes: str) -> Column:
        return F.array(*[F.sum(F.col(votes)[i]) for i in range(count)])

    hosts = staged(voted.groupBy(F.col(at).alias(h)).agg(total(r).alias(ch)), "hosts").withColumns(
        {d: F.substring_index(h, ".", -2), s: F.substring_index(h, ".", -1)})
    domains = hosts.groupBy(d).agg(total(ch).alias(cd))
    suffixes = hosts.groupBy(s).agg(total(ch).alias(cs))
    overall = hosts.agg(total(ch).alias(ca)).first()[0]
    priors = hosts.join(domains, d).join(suffixes, s).select(h, ch, cd, cs)

    def smoothed(counts: str) -> str:
        """SQL: a level's shares without the row's own vote, smoothed towards ``p``, the level above."""
        return let_sql("own", f"zip_with({counts}, {r}, (c, v) -> greatest(0D, c - v))", let_sql(
            "all_", f"{strength}D + aggregate(own, 0D, (t, x) -> t + x)",
            f"zip_with(own, {p}, (c, q) -> (c + {strength}D * q) / all_)"))

    joined = (voted.join(priors, F.col(at) == F.col(h), "left")
              .withColumn(ca, F.array(*[F.lit(float(c or 0)) for c in overall]))
              .withColumn(p, F.transform(first, F.exp)))
    for level in (ca, cs, cd, ch):
        joined = joined.withColumn(p, F.expr(smoothed(level)))
    post = joined.withColumn(p, F.expr(f"zip_with({ll}, {p}, (a, b) -> a + ln(greatest(b, 1e-9D)))")).withColumn(
        p, F.expr(_shares(p)))
    language, confidence, accepted = fresh(list(keep), "language", "confidence", "accepted")
    names = F.array(*[F.lit(x) for x in (*languages, UNKNOWN)])
    most = F.array_max(p)
    best = F.array_position(p, most)
    return post.select(
        *keep, F.when(F.col(n) == 0, UNKNOWN).otherwise(F.element_at(names, best.cast("int"))).alias(language),
        F.round(most, 6).alias(confidence),
        ((F.col(n) > 0) & (best <= len(languages)) & (most >= least)).alias(accepted))


def declared_of(html: str) -> Column:
    """The language that a page's html element declares, or null."""
    found = F.regexp_extract(html, r"(?i)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([a-zA-Z-]+)", 1)
    return F.when(found != "", found)


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def identify_pages(pages: DataFrame, model: np.ndarray, **options) -> DataFrame:
    """``page_id, url, declared, language, confidence, accepted`` of every page."""
    named = pages.withColumn("declared", declared_of("html")) if "declared" not in pages.columns else pages
    return identify(named, model, keep=("page_id", "url", "declared"), declared=F.col("declared"),
                    host=host_of("url"), html_column="html", **options)


def keep_identified(docs: DataFrame, model: np.ndarray, *, text_column: str = "text", lang_column: str = "lang",
                    source_column: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, ``lang_column`` set to it; its former
    value counts as the declared language, the source as the host."""
    found = identify(docs, model, keep=tuple(docs.columns), declared=F.col(lang_column).cast("string"),
                     host=F.col(source_column).cast("string"), text_column=text_column, **options)
    language, _, accepted = found.columns[-3:]
    return (found.where(F.col(accepted)).withColumn(lang_column, F.col(language)).select(*docs.columns))
