"""One query per operator over its whole table, and their SQL where SQL can express it."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    embeddings, html_text, language, merkle, mixing, packing, pii, simhash, token_files, url_filters, warc, whitening)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every page, by a trigram model fitted on labelled documents."""
    model = language.fit(_table(spark, folder, "documents"))
    return language.identify_pages(_table(spark, folder, "pages"), model)


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document, and the shards it goes to."""
    plan = mixing.plan_mix(_table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken",
                       F.array_join(F.array_sort(F.transform("places", lambda p: p.shard)), ",").alias("shards"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: counts and positions."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find_pii(docs).select("doc_id", F.col("pii_spans").alias("s"))
    listed = lambda spans: f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    base = "filter(s, x -> x.kind IN ('" + "', '".join(pii.BASE) + "'))"
    return found.select(
        "doc_id", *[F.expr(f"bigint(size(filter(s, x -> x.kind = '{k}')))").alias(f"n_{k}") for k in pii.BASE],
        F.expr(f"sha2({listed(base)}, 256)").alias("base_sha256"), F.expr(listed("s")).alias("spans"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return packing.pack_documents(_table(spark, folder, "documents"))


def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best vectors for each query vector."""
    return embeddings.top_k(_table(spark, folder, "embeddings"))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.simhash_components(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document as read back from the files."""
    read = token_files.read_tokens(token_files.write_tokens(_table(spark, folder, "documents")))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_text(_table(spark, folder, "pages")).withColumn(
        "n_chars", F.length("text").cast("long"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's record as read back from the bundles."""
    index = warc.write_warc(_table(spark, folder, "pages"))
    return warc.read_warc(index, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector."""
    return embeddings.near_duplicate_vectors(_table(spark, folder, "embeddings"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The 32 leading components of every vector, whitened."""
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf and proof of every document, and whether a partly tampered table still folds to the root."""
    docs = _table(spark, folder, "documents")
    text = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0, F.translate(
        "text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    tampered = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    found = merkle.merkle_manifest(docs, carry={"tampered": tampered})
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.folded_root(F.col("tampered"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: The rules of the query's contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op13_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's URL."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages, rules).drop("url")


QUERIES = {f.__name__: f for f in (
    op1_language, op2_mixing, op3_pii, op4_packing, op5_top_k, op6_simhash, op7_token_files, op8_html, op9_warc,
    op10_embedding_dedup, op11_whitening, op12_merkle, op13_url_filters)}


def _coded_sql(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_coded_sql, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of the decimal doc_id, bit by bit.
_CRC_SQL = """xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
              lambda crc, byte: list_reduce([xor(crc, byte)] || range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"""


def _tree_sql(name: str, leaves: str) -> str:
    """SQL for a tree's nodes by level, and each node's siblings before and after it."""
    return f"""
        {name}(level, tree, idx, n, digest) AS (
            SELECT 0, tree, idx, n, digest FROM {leaves}
            UNION ALL
            SELECT level + 1, tree, idx // 8, max((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY idx))
            FROM {name} WHERE n > 1 GROUP BY level, tree, idx // 8),
        {name}_sides AS (
            SELECT a.level, a.tree, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
                   coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
            FROM {name} a LEFT JOIN {name} b
              ON a.level = b.level AND a.tree = b.tree AND a.idx // 8 = b.idx // 8 AND a.idx <> b.idx
            WHERE a.n > 1 GROUP BY ALL),
        {name}_fold(id, level, tree, idx, digest, proof) AS (
            SELECT id, 0, tree, idx, start, proof FROM {name}_start
            UNION ALL
            SELECT f.id, f.level + 1, f.tree, f.idx // 8, sha256(before || digest || after), proof || before || after
            FROM {name}_fold f JOIN {name}_sides s ON f.level = s.level AND f.tree = s.tree AND f.idx = s.idx),
        {name}_end AS (
            SELECT f.id, f.tree, f.digest, f.proof, u.digest AS top
            FROM {name}_fold f JOIN {name} u ON f.level = u.level AND f.tree = u.tree AND f.idx = u.idx WHERE u.n = 1)"""

#: SQL for the queries whose result plain SQL can state.
ORACLES = {
    "op5_top_k": """
        WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
                   FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        s AS (SELECT q.id AS query_id, c.id AS vec_id,
                     CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.id % 100 = 0 AND c.id <> q.id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 10""",
    "op9_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
        bits AS (SELECT page_id, payload_bytes, hex, string_agg(
                     substr('0000000100100011010001010110011110001001101010111100110111101111',
                            4 * (instr('0123456789abcdef', substr(hex, i, 1)) - 1) + 1, 4), '' ORDER BY i) AS b
                 FROM d, range(1, 41) t(i) GROUP BY ALL),
        coded AS (SELECT page_id, payload_bytes, hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                      1 + list_sum(list_transform([0, 1, 2, 3, 4], lambda k: CAST(substr(b, 5 * j + k + 1, 1) AS INTEGER)
                                                                      * (1 << (4 - k))))::BIGINT, 1), '' ORDER BY j) AS payload_digest
                  FROM bits, range(0, 32) u(j) GROUP BY ALL)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
        FROM coded WINDOW w AS (PARTITION BY hex)""",
    "op12_merkle": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS tree,
                          {_leaf_sql('text')} AS digest, {_leaf_sql(_LOWER_SQL.format('text'))} AS lowered,
                          coalesce({_CRC_SQL} % 3 = 0, false) AS hit FROM documents),
        leaves AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n
                   FROM d WINDOW w AS (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest)),
        low_start AS (SELECT id, tree, idx, CASE WHEN hit THEN lowered ELSE digest END AS start, '' AS proof FROM leaves),
        {_tree_sql('low', 'leaves')},
        tops AS (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, digest
                 FROM low WHERE n = 1),
        high_start AS (SELECT e.id, t.tree, t.idx, e.digest AS start, e.proof FROM low_end e JOIN tops t ON e.tree = t.name),
        {_tree_sql('high', 'tops')}
        SELECT l.doc_id, l.digest AS leaf, low_end.top AS subroot, h.top AS root, sha256(h.proof) AS proof_sha256,
               h.digest AS folded_root, h.digest = h.top AS verified
        FROM leaves l JOIN low_end USING (id) JOIN high_end h USING (id)""",
    "op13_url_filters": f"""
        WITH r(host, path, verdict) AS (VALUES {', '.join(map(str, RULES))}),
        u AS (SELECT row_number() OVER () AS id, page_id,
                     CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT id, page_id, {_LOWER_SQL.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        f AS (SELECT p.id, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS m
              FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.id)
        SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (id)""",
}
