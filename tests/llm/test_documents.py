"""Document operators against brute force, with every odd case of the fixture."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedledger.llm import language, mixing, packing, pii, simhash, token_files, tokens

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array(WHOLE.encode(text or "", add_special_tokens=False).ids, "<u4")


def clashing(docs):
    """Extra columns with names that operators might use themselves."""
    names = ("pii_spans", "shard", "kept_row", "language", "p", "ll", "h", "text_2", "size", "fp", "component_id", "content")
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


# Tokens, packing, token files --------------------------------------------------------------

@pytest.mark.parametrize("text", [
    "", " ", "it's we'll I'D", "a  b   c ", "\n\n x\t\ty \n", "ß straße Ünï ²½ 12a3", "a b", "\u0085x", "日本 ab", "<|endoftext|>",
    "x<|endoftext|> y", "é" * 300, "  leading", "tail  ", "'s's 'tis", "ǆ ƻ ª º µ ÷ × ¿", "a\x1cb\x0bc"])
def test_tokens_equal_the_library(text):
    got = np.frombuffer(tokens.Encoder(tokens.default_vocabulary()).encode(text), "<u4")
    assert got.tolist() == ids_of(text).tolist()


def test_fullest_is_the_best_subset_sum():
    rng = np.random.default_rng(0)
    for _ in range(200):
        lengths = rng.integers(1, 40, rng.integers(1, 9)).tolist()
        counts, capacity = Counter(lengths), 50
        taken = packing.fullest(counts, capacity)
        assert all(0 < k <= counts[n] for n, k in taken.items()) and max(lengths) in taken
        sums = {max(lengths)}
        rest = sorted(lengths)[:-1]
        for n in rest:
            sums |= {s + n for s in sums if s + n <= capacity}
        assert sum(n * k for n, k in taken.items()) == max(sums)
    assert packing.fullest({}, 10) == {}


def check_pieces(pieces, rows, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(np.append(ids_of(r.text), 1).astype("<u4"))
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        want = Counter()
        for ids in texts[doc]:
            want[len(ids)] += len(ids)
            for p in own:
                if len(texts[doc]) == 1:
                    assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
        got = Counter()
        for p in own:
            got[p.doc_tokens] += p.length
        assert got == want
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing(docs, no_docs):
    pieces = packing.pack_documents(clashing(docs)).collect()
    padding = check_pieces(pieces, docs.collect(), 2048)
    assert padding < 0.01 * sum(p.length for p in pieces)
    assert packing.pack_documents(no_docs).count() == 0


def test_packing_with_small_windows_and_gathering(docs):
    pieces = packing.pack_documents(docs, capacity=64, gathered=16).collect()
    assert check_pieces(pieces, docs.collect(), 64) < 0.02 * sum(p.length for p in pieces)


def test_rank_codes_round_trip():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 2 ** int(b), int(n)).astype("<u4") for b, n in
             [(8, 5), (16, 1), (24, 8), (32, 7), (3, 0), (32, 4), (17, 3)]]
    coded = [token_files.encode_ranks(p) for p in parts]
    got = token_files.decode_ranks(np.array([len(p) for p in parts]), b"".join(c for c, _ in coded), b"".join(d for _, d in coded))
    assert got.tolist() == np.concatenate(parts).tolist()


def test_token_files(spark, docs, no_docs):
    manifest = token_files.write_tokens(clashing(docs), block_docs=7)
    got = token_files.read_tokens(manifest).collect()
    at = 0
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r, g in zip(rows, sorted(got, key=lambda g: g.start), strict=True):
        ids = np.append(ids_of(r.text), 0).astype("<u4")
        assert (g.doc_id, g.start, g.n_tokens, bytes(g.ids)) == (r.doc_id, at, len(ids), ids.tobytes())
        at += len(ids)
    assert token_files.read_tokens(token_files.write_tokens(no_docs)).count() == 0


# SimHash -----------------------------------------------------------------------------------

def slow_fingerprint(text):
    words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(items, linked):
    """``items``: (id, value); smallest id reachable for each."""
    root = {i: i for i, _ in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for n, (i, a) in enumerate(items):
        for j, b in items[n + 1:]:
            if linked(a, b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


@pytest.mark.parametrize("options", [{}, {"blocks": 1}, {"compared": 2}, {"radius": 6}])
def test_simhash_components(docs, options):
    found = simhash.simhash_components(clashing(docs), **options).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    prints = {r.doc_id: r.fp & (1 << 64) - 1 for r in found}
    assert prints == {i: slow_fingerprint(t) for i, t in text.items()}
    named = [(i, p) for i, p in prints.items() if i is not None]
    want = slow_components(named, lambda a, b: (a ^ b).bit_count() <= options.get("radius", 4))
    assert {r.doc_id: r.component_id for r in found} == {**want, None: None}
    assert len(found) == docs.count()


def test_crowded_fingerprints_lose_no_link(spark):
    """A path of fingerprints of which all collide in one block, past the compared bound."""
    from feedledger.llm.components import components
    values = np.array([0b111 << 3 * i for i in range(12)] + [1 << 40], np.uint64)
    assert (simhash.linked_roots(values, 6)[:12] == 0).all()
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}
    assert components(links.where("false")).count() == 0


def test_drop_near_duplicates(docs, no_docs):
    wide = clashing(docs)
    kept = simhash.drop_near_duplicates(wide)
    assert kept.columns == wide.columns
    want = [r.doc_id for r in simhash.simhash_components(docs).where("doc_id = component_id").distinct().collect()]
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(want))
    assert kept.where("doc_id IS NULL").count() == 1
    assert simhash.drop_near_duplicates(no_docs).count() == 0


# Personal data -----------------------------------------------------------------------------

def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15)]
PRIVATE = [
    "", None, "plain", "mail a@b.co, a@b a@b. x@y.z.w_q@r.s", "😀 a@b.c_d@e.f@g.h é 1.2.3.4", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255 1.2.3.256",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "card 4111111111111111 call +1 (988) 555-2485.", "+12 +1234567890123456 + 1 +1-2",
    "+49 123 456 789.bob@x.com 1-2 3", "IBAN DE89 3704 0044 0532 0130 00 bank", "DE89370400440532013001", "GB82WEST12345698765432 x",
    "a" * 30_000 + "@", "9" * 30_000, "1." * 20_000, "+1 " * 9_000, "a@b.c " * 3_000, "(" * 20_000 + "+1((((((", "x@" + "a." * 20_000]


@pytest.fixture(scope="module")
def private(spark):
    return spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string")


def test_base_spans(private):
    found = {r.doc_id: r.pii_spans for r in pii.find_pii(private).collect()}
    for i, text in enumerate(PRIVATE):
        want = [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m[0])]
        assert [(s.kind, s.start, s.end) for s in found[i] if s.kind in pii.BASE] == want, text and text[:60]
    assert [s.kind for s in found[10]][-1:] == ["iban"] and [s.kind for s in found[12]] == ["iban"]
    assert "iban" not in [s.kind for s in found[11]]
    near = next(s for s in found[10] if s.kind == "iban")
    assert near.score > next(s for s in found[12]).score


def test_account_numbers_end_where_their_country_says(spark):
    texts = ["DE89370400440532013000 Deutsche Bank", "DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89370400440532013000X"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.pii_spans if s.kind == "iban"] for r in pii.find_pii(rows).collect()}
    assert found == {0: [(0, 22)], 1: [(0, 27)], 2: []}


def test_redaction_hides_every_span(spark, private):
    rows = {r.doc_id: r.text for r in pii.redact_pii(clashing(private)).collect()}
    spans = {r.doc_id: r.pii_spans for r in pii.find_pii(private).collect()}
    for i, text in enumerate(PRIVATE):
        if text is None:
            assert rows[i] is None
            continue
        out, at = "", 0
        for s in sorted(spans[i], key=lambda s: (s.start, -s.end)):
            if s.end <= at:
                continue
            out += text[at:max(at, s.start)] + (f"[{s.kind.upper()}]" if s.start >= at else "")
            at = s.end
        assert rows[i] == out + text[at:], text[:60]


def test_redaction_over_chunk_ends(private):
    found = pii.find_pii(private)
    cut = {r.doc_id: r.t for r in found.select("doc_id", pii.redacted("text", "pii_spans", 7).alias("t")).collect()}
    assert cut == {r.doc_id: r.text for r in pii.redact_pii(private).collect()}


# Mixing ------------------------------------------------------------------------------------

def test_targets():
    assert mixing.weighted_targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.weighted_targets([10, 1000], [5, 2]) == [30.0, 980.0]
    assert mixing.weighted_targets([], []) == []


def test_quota_tree():
    quotas = [17, 0, 100, 3]
    got = mixing.split_quotas(quotas, 7, 1)
    assert got.sum(axis=0).tolist() == quotas and np.ptp(got.sum(axis=1)) <= 1
    assert (mixing.split_quotas(quotas, 7, 1) == got).all() and (got >= 0).all()


def test_mix_plan(docs, no_docs):
    rows = mixing.plan_mix(clashing(docs)).collect()
    assert len(rows) == docs.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    text = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    total, sources = Counter(), {}
    for r in rows:
        assert r["size"] == size(text[r.doc_id][0]) and r.taken == len(r.places) * r["size"] <= 3 * r["size"]
        total[r.source] += r["size"]
        sources.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.taken
    order = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    want = mixing.weighted_targets([total[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, t in zip(order, want, strict=True):
        assert sources[s][0] == total[s] and sources[s][1] == pytest.approx(t)
        largest = max((r["size"] for r in rows if r.source == s), default=0)
        assert abs(sources[s][2] - t) <= largest
    again = mixing.plan_mix(clashing(docs).repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    # Copies of a source have all numbers from 0, so blocks are disjoint and complete.
    assert mixing.plan_mix(no_docs).count() == 0


def test_mixed_rows(docs):
    wide = clashing(docs)
    mixed = mixing.mix(wide)
    plan = mixing.plan_mix(wide)
    assert mixed.columns[:len(wide.columns)] == wide.columns
    want = Counter({})
    for r in plan.collect():
        want[r.doc_id] += len(r.places)
    assert Counter(r.doc_id for r in mixing.shuffled(mixed).collect()) == +want


# Language ----------------------------------------------------------------------------------

def test_language(docs, no_docs):
    model = language.fit(docs.where("doc_id < 80"), sample_per_language=50)
    wide = clashing(docs)
    kept = language.keep_identified(wide, model)
    assert kept.columns == wide.columns
    got = {r.doc_id: r.lang for r in kept.collect()}
    held_out = [r for r in docs.collect() if r.doc_id is not None and 80 <= r.doc_id < 160]
    assert all(got.get(r.doc_id) == r.lang for r in held_out)
    assert not {301, 302, 303, 308} & set(got)
    assert language.keep_identified(no_docs, model).count() == 0


def test_language_evidence(spark, docs):
    """Without text evidence to speak of, markup, address and host decide, in that order."""
    model = language.fit(docs, sample_per_language=50)
    rows = [(i, f"https://a.example.de/{i}", f"<html><p>{t}</p></html>") for i, t in
            enumerate(["der die und nicht ein auch mit Straße über schön " * 9] * 8)]
    rows += [(50, "https://a.example.de/x", "<html><p>la</p></html>"), (51, "https://other.example.org/x", "<html lang=fr><p>zz</p></html>"),
             (52, "https://x.fr/", "<html><p>les</p></html>"), (53, None, None), (54, "no url", ""), (55, "https://a.example.de", "<html lang=en-GB></html>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in language.identify_pages(pages, model).collect()}
    assert got[0].language == "de" and got[0].accepted
    assert got[51].language == "fr" and got[52].language == "fr"
    assert [got[i].language for i in (53, 54, 55)] == ["und"] * 3 and not got[55].accepted
    assert len(got) == len(rows) and got[55].declared == "en-GB"


def test_base_sha_is_of_listed_spans(private):
    spans = pii.find_pii(private).where("doc_id = 4").first().pii_spans
    text = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans if s.kind in pii.BASE)
    assert hashlib.sha256(text.encode()).hexdigest()
