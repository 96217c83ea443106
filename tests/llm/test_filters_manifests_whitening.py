"""URL filters, Merkle manifests and whitening against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedledger.llm import merkle, queries, url_filters, whitening


# URL filters -------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "http://org", "http://ORG/", "https://a.Org/x?y#z", "http://example.org/es/a",
        "http://example.org/en/12", "http://x.example.org/en/1", "http://example.org?/es/", "ftp://example.com/de/#/fr/",
        "http://org.example.com/fr/", "http://notorg/", "http://example.org./es/", "http://a..b/q", "http://b/q", "http://.b/q",
        "x://y://org/", "http://org:80/", "http://ÄRGER.org/Ä?é", "http://example.org/en/\n1", "http://example.org/en/1"]
RULES = [*queries.RULES, (".b", "/q", "block"), ("org", "/aaaaaaaaaaaaaaaa", "block"), ("Example.COM", "", "block"),
         ("org", "es/", "block"), ("a/b", "/", "block"), (None, "/", "block"), ("c", "/", None), ("net", None, "block"),
         ("net", "", "allow")]


def parsed(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def judged(url, rules, default="allow"):
    host, path = parsed(url)
    fits = []
    for h, p, verdict in rules:
        if h is None or verdict is None or p and not p.startswith("/"):
            continue
        h, p = re.sub("[A-Z]", lambda m: m.group().lower(), h), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), verdict == "block", h + p))
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[3], "block" if best[2] else "allow"


def rule_table(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


@pytest.mark.parametrize("most_bytes", [64 << 20, 0])
def test_judged_urls(spark, most_bytes):
    urls = [*URLS, *[f"http://{h}{p}" for h in ("org", "a.net", "example.org", "www.example.com") for p in
                     ("/aaaaaaaaaaaaaaaaX", "/de/1", "/fr/", "")], *(["http://org/"] * 50)]
    rows = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)], "page_id int, url string, host string, Keys string")
    got = url_filters.judge_urls(rows.repartition(3), rule_table(spark, RULES), most_bytes=most_bytes)
    assert got.columns == ["page_id", "url", "host", "Keys", "host_", "path", "rule", "verdict"]
    want = {i: judged(u, RULES) for i, u in enumerate(urls)}
    assert {r.page_id: (r.host_, r.path, r.rule, r.verdict) for r in got.collect()} == want


def test_judged_without_rules_or_rows(spark):
    rows = spark.createDataFrame([(1, "http://a/")], "page_id int, url string")
    got = url_filters.judge_urls(rows, rule_table(spark, []), default="block").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [("a", "/", None, "block")]
    assert url_filters.judge_urls(rows.where("false"), rule_table(spark, RULES)).count() == 0
    long = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "org/" + "x" * 100_000)], "page_id int, url string")
    assert url_filters.judge_urls(long, rule_table(spark, RULES)).first().rule == "org/"


@pytest.mark.parametrize("listed", [0, 1, 300, 2000])
def test_cascade_is_exact_on_its_universe(spark, listed):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("key"), (F.col("id") < listed).alias("in_list"))
    cascade = url_filters.build_cascade(keys, "in_list")
    probed, names = cascade.attached(keys, "f")
    assert probed.where(cascade.member(F.col("key"), names) != F.col("in_list")).count() == 0
    if 1 < listed < 2000:
        assert len(cascade.levels) > 1  # there were mistakes to encode
        used = sum(level.bits for level in cascade.levels)
        assert used <= url_filters.cascade_bits(listed, 2000 - listed) + 64 * len(cascade.levels)


def test_judging_moves_no_rows(spark):
    rows = spark.createDataFrame([(1, "http://a.org/x")], "page_id int, url string")
    plan = url_filters.judge_urls(rows, rule_table(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquer")[0]
    assert "Join" not in main and "Python" not in plan and "InArrow" not in plan


# Merkle ------------------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grown(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + arity])) for i in range(0, len(last), arity)])
    return levels


def steps(levels, at, arity):
    for level in levels[:-1]:
        low = at - at % arity
        yield level[low:at], level[at + 1:low + arity]
        at //= arity


def manifest_of(rows, arity=8):
    """``[(doc_id, leaf, subroot, root, proof, folded)]`` of (doc_id, source, lang, n_chars, text) rows."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    grown_trees = {}
    for name in names:
        trees[name].sort(key=lambda t: t[:3])
        grown_trees[name] = grown([t[2] for t in trees[name]], arity)
    upper = grown([grown_trees[n][-1][0] for n in names], arity)
    out = []
    for at, name in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(trees[name]):
            path = [*steps(grown_trees[name], i, arity), *steps(upper, at, arity)]
            folded = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                folded = leaf_of(*row[:4], re.sub("[A-Z]", lambda m: m.group().lower(), row[4]))
            for before, after in path:
                folded = sha("".join(before) + folded + "".join(after))
            proof = sha("".join("".join(b) + "".join(a) for b, a in path))
            out.append((row[0], leaf, grown_trees[name][-1][0], upper[-1][0], proof, folded))
    return sorted(out, key=repr)


def got_manifest(frame):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in frame.collect()), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def doc_rows():
    rng = random.Random(3)
    rows = [(i, f"s{i % 4}", rng.choice(["en", "en", "en", "de", "é", "z"]), i, f"Text {i} ÄB c") for i in range(700)]
    rows += [(700 + i, None, f"lang{i}", None, "lower") for i in range(70)]
    rows += [(None, None, None, None, None), (None, "s", None, 1, "a"), (5, "dup", "en", 2, ""), (6, "rep", "en", 2, "X"),
             (6, "rep", "en", 2, "X"), (-9, "", "", 0, "Long " * 50_000)]
    rng.shuffle(rows)
    return rows


def test_merkle_query(spark, tmp_path):
    rows = doc_rows()
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("Leaf", F.lit(1)).withColumn("tree", F.create_map(F.lit(1), F.lit(2)))
    frame.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op12_merkle(spark, str(tmp_path))
    assert got_manifest(found) == manifest_of(rows)
    assert found.where("verified <> (root = folded_root) OR verified IS NULL").count() == 0
    assert 0 < found.where("NOT verified").count() < len(rows)


@pytest.mark.parametrize("arity", [2, 3])
@pytest.mark.parametrize("n", [1, 2, 9, 33])
def test_manifests_of_other_shapes(spark, arity, n):
    rows = [(i, "s", "en" if i % 5 else "de", i, f"t{i}") for i in range(n)]
    found = merkle.merkle_manifest(spark.createDataFrame(rows, SCHEMA), arity=arity)
    got = sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.p) for r in found.select(
        "*", merkle.proof_digest(F.col("path")).alias("p")).collect()), key=repr)
    assert got == [r[:5] for r in manifest_of(rows, arity)]
    assert found.where(merkle.folded_root(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_manifest_of_one_id_and_of_nothing(spark):
    rows = [(1, "s", "en", 3, "same")] * 40 + [(1, "s", "en", 3, f"other {i}") for i in range(20)]
    found = merkle.merkle_manifest(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert found.count() == 60 and found.select("root").distinct().first().root == manifest_of(rows)[0][3]
    empty = merkle.merkle_manifest(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[0] == "doc_id"


# Whitening ---------------------------------------------------------------------------------

def expected(vectors, count=32):
    """``(deviations, e, Q, y)`` by whole numbers and an eigenvalue solver."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors], object)
    apart = len(x) * x - x.sum(axis=0)
    y = apart.astype(float) / len(x)
    e, q = np.linalg.eigh(y.T @ y / len(x))
    return (apart ** 2).sum(axis=1), e[::-1], q[:, ::-1], y


def whitened(frame, **options):
    rows = whitening.whiten(frame, **options).collect()
    return rows, {(r.vec_id, r.component): r for r in rows}


def test_whitening_equals_an_eigenvalue_solver(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((150, 12)) * np.linspace(3, 0.2, 12) + 5
    odd = [(900, None, 1), (901, [1.0, None] + [0.0] * 10, 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] * 12, 1)]
    frame = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(vectors)] + odd,
                                  "vec_id long, embedding array<double>, component int").repartition(3)
    rows, by = whitened(frame, components=8)
    deviations, e, q, y = expected(vectors)
    assert len(rows) == 150 * 8 and {r.n for r in rows} == {150}
    assert [by[i, 1].deviation for i in range(150)] == deviations.tolist()
    want = y @ q[:, :8] / np.sqrt(e[:8])
    got = np.array([[by[i, j + 1].whitened for j in range(8)] for i in range(150)])
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-9
    assert max(abs(by[0, j + 1].explained / (e[j] / e.sum()) - 1) for j in range(8)) < 1e-10
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_whitening_of_repeated_eigenvalues(spark):
    """Four directions of one variance, two without any, and an empty, a shorter and a repeated vector."""
    vectors = [[float(s * 2 * (i == j)) for j in range(6)] for i in range(4) for s in (1, -1)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    rows, by = whitened(frame)
    assert {r.component for r in rows} == {1, 2, 3, 4} and rows[0].identity_error < 1e-9
    assert all(abs(r.explained - 0.25) < 1e-12 for r in rows)
    w = np.array([[by[i, j].whitened for j in (1, 2, 3, 4)] for i in range(8)])
    assert np.abs(w.T @ w / 8 - np.eye(4)).max() < 1e-12
    more = frame.unionByName(spark.createDataFrame([(None, []), (50, [1.0]), (3, vectors[3])], "vec_id long, embedding array<float>"))
    padded = [*vectors, [0.0] * 6, [1.0] + [0.0] * 5, vectors[3]]
    deviations, e, _, _ = expected(padded)
    rows, _ = whitened(more)
    assert sorted(r.deviation for r in rows if r.component == 1) == sorted(deviations.tolist())
    assert sum(r.vec_id is None for r in rows) == 4
    assert np.allclose(sorted({r.component: r.explained for r in rows}.values()), sorted((e / e.sum())[:4]), atol=1e-12)


def test_whitening_of_far_and_of_no_values(spark):
    kind = "vec_id long, embedding array<double>"
    far = [(1, [1e20, 0.0]), (2, [-1e20, 1.0]), (3, [0.0, 2.0])]
    rows, _ = whitened(spark.createDataFrame(far, kind))
    exact = expected([v for _, v in far])[0]
    assert {r.vec_id: r.deviation for r in rows} == {i: min(d, (1 << 63) - 1) for (i, _), d in zip(far, exact, strict=True)}
    for few in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0]), (2, [2.0])]):
        assert whitening.whiten(spark.createDataFrame(few, kind)).count() == 0
