"""Ranked search, fill-in-the-middle and SentencePiece chunks: against brute force and the library, and on odd rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from turnwise.llm import fill_middle, registry, search, sentencepieces

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n long, terms int, ids string, block string, share int"
LONG = " ".join(f"w{i % 997} the of  and v{i}" for i in range(20_000))
ODD = [
    (1, "the quick brown fox"), (1, "the quick brown fox"), (1, "another text of one id"), (2, None), (3, ""), (4, " \n\t "), (None, "a null id and the fox"), (None, "a null id and the fox"), (5, "<P> a mark"), (6, LONG), (7, LONG),
    (8, "▁lit ▁▁marks▁"), (9, "ÉTÉ É　x ﬁ 👩‍👩 \u0000 \r\n"), (10, "x" * 5000), (11, " lead"), (12, "trail  "), (13, "  "), (14, " "), (15, "!!! ... 123"), (16, "<s>a</s> <unk> <0x41>"),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(*r, 3, 4, "c", "d", 5) for r in rows], SCHEMA)


def random_texts(n, seed):
    at = random.Random(seed)
    return ["".join(at.choice(["a", "the", " ", "  ", "\n", "é", "▁", "日本", "ing", "\t", "🙂", "T", "1", "."]) for _ in range(at.randrange(0, 40))) for _ in range(n)]


# Fill-in-the-middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_cut(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_packed_lists_select_what_they_hold():
    at = np.random.default_rng(0)
    for n, most in ((1, 1), (1, 10**6), (5, 5), (100, 100), (1000, 123_456), (4097, 10**7)):
        values = np.sort(at.integers(0, most + 1, n))
        code = fill_middle.packed(values)
        assert fill_middle.selected(code, list(range(n))) == values.tolist()
        assert len(code) <= 7 + n * (3 + max(1, most // n).bit_length()) / 8 + 2
    assert fill_middle.packed(np.zeros(0, np.int64))[:4] == bytes(4)


def test_token_ends():
    for text in ["", " ", "a", "a b", " a\nb  ", "é　x y"] + random_texts(200, 1):
        assert np.diff(fill_middle.token_ends(text), prepend=0).tolist() == [len(u) for u in UNIT.findall(text)]


def test_cuts_of_odd_rows(spark):
    rows = ODD + [(100 + k, t) for k, t in enumerate(random_texts(300, 2) * 2)]
    got = fill_middle.fill_in_middle(odd(spark, rows))
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain_cut(*r) for r in rows), key=key)
    texts = collections.Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert collections.Counter(r.restored_sha256 for r in fill_middle.digests(got).collect()) == texts
    assert fill_middle.fill_in_middle(odd(spark, [])).count() == 0


def test_hot_text_is_dealt_in_shares(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "HOT_ROWS", 20)
    monkeypatch.setattr(fill_middle, "HOT_SHARE", 10)
    rows = [(k, "one hot text of some words") for k in range(150)] + [(1000, "x y")] * 3 + [(k, f"text {k}") for k in range(2000, 2150)]
    index = fill_middle.text_index(odd(spark, rows)).cache()
    assert 5 <= index.where("text LIKE 'one%'").count() <= 6 and index.where("text = 'x y'").count() == 1
    assert sorted(map(tuple, fill_middle.cut(index).collect())) == sorted(map(tuple, (plain_cut(*r) for r in rows)))


# SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize(("block", "bucket"), [(1 << 24, 1 << 22), (200, 300)])
def test_ids_and_texts_are_the_librarys(spark, library, block, bucket):
    rows = ODD + [(100 + k, t) for k, t in enumerate(random_texts(400, 3))]
    got = sentencepieces.encode_decode(odd(spark, rows), MODEL, block, bucket).collect()
    want = [(d, ids := library.encode(t or ""), library.decode(ids)) for d, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_pieces_of_an_empty_table(spark):
    assert sentencepieces.encode_decode(odd(spark, []), MODEL).count() == 0
    assert sorted(sentencepieces.encode_decode(odd(spark, [(1, None), (2, "")]), MODEL).collect()) == [(1, [], ""), (2, [], "")]


def test_query_op13_against_the_library(spark, library):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, registry.op13_sentencepiece(spark, SF).collect())) == sorted(want)


# Search


def brute(docs, items, k):
    found = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, w, collections.Counter(w)) for d, t in docs if (w := found(t))]
    n, total, df = len(held), sum(len(w) for _, w, _ in held), collections.Counter(t for _, _, c in held for t in c)
    queries = collections.defaultdict(list)
    for item, t in items:
        queries[item] += found(t)
    out = []
    for item, query in queries.items():
        scored = []
        for d, w, c in held:
            m = 25 + (75 * len(w) * n) // total
            if s := sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in query if c[t]):
                scored.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_ranks_of_odd_rows(spark):
    at = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "Fox", "the"]
    rows = ODD + [(100 + i, " ".join(at.choices(words, [1 / (j + 1) for j in range(63)], k=at.randrange(1, 90)))) for i in range(700)]
    items = [(1, "the Fox, the w1 w1 w40"), (2, None), (3, ""), (4, "nowhere"), (1, "w59"), (None, "w3 É w17"), (5, " ".join(words * 2)), (6, "w0 w2"), (7, "a null id")]
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, rank int")
    want = brute(rows, items, 10)
    for size, block in ((1 << 20, 5000), (300, 3), (1, 2)):
        got = search.search(odd(spark, rows).repartition(3), bench, 10, size, block)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert search.search(odd(spark, []), bench).count() == 0 == search.search(odd(spark), bench.limit(0)).count()


def error(first, last, impact):
    return sum((z - a) * max(impact[a:z]) + search.BLOCK_COST * max(impact) for a, z in zip(first, last, strict=True))


def test_blocks_have_the_least_error(monkeypatch):
    monkeypatch.setattr(search, "GRAIN", 2)
    at = np.random.default_rng(3)
    for _ in range(40):
        sizes = at.integers(1, 17, 3)
        lists = np.concatenate([[0], np.cumsum(sizes)])
        impact = at.integers(1, 60, lists[-1]) * at.integers(1, 20)
        first, last = search.block_ends(lists, impact)
        assert first[0] == 0 and last[-1] == lists[-1] and (first[1:] == last[:-1]).all() and set(lists[:-1]) <= set(first)
        for a, z in zip(lists[:-1], lists[1:], strict=True):
            own, n = impact[a:z], z - a
            grains = range(2, n, 2)
            choices = [[g for k, g in enumerate(grains) if bits >> k & 1] for bits in range(1 << len(grains))]
            best = min(error([0, *c], [*c, n], own) for c in choices)
            use = (first >= a) & (first < z)
            assert error(first[use] - a, last[use] - a, own) == best


def test_blocks_that_cannot_reach_the_threshold_stay_closed():
    n = 4000
    impact = np.full(n, 10, np.int64)
    impact[1000:1016] = 1000
    shard = search.Shard(np.ones(n, np.int64), np.zeros(n, np.int64), impact, 1)
    found, scores = shard.search([(0, 3)], 10, 1)
    assert found.tolist() == list(range(1000, 1010)) and set(scores) == {3000}
    assert shard.opened <= 10 < len(shard.first)
