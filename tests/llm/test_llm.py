"""The training-data operators: against brute force, round trips, held-out accuracy and DuckDB, and on odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from turnwise.llm import components, decontamination, extraction, language, licenses, mixing, ngram_join, pii, quality, registry, sharding, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, copy int, n_words long, label long, cell long, n long"
LONG = " ".join(f"w{i % 997} the of and v{i}" for i in range(30_000))
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and the cat sleeps in the sun all day long with no end", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog and the cat sleeps in the sun all day long with no end", "en", "a"),
    (2, None, None, None), (3, "", "en", None), (4, " \n\t ", None, "a"), (None, "a null id", "en", "a"), (5, "one", "de", "b"), (6, "one", "de", "b"), (7, LONG, "en", "a"), (8, LONG + " more", "en", "a"),
    (9, "ÉTÉ 12 ### %%% <|> é x", "fr", "c"), (10, "Licensed under the MIT License.\nlicensed under the mit license.", "en", "c"), (11, "!!! ... 123", "en", "c"),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(*r, len(r[1] or ""), 77, 88, 99, 5, 6, 7) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(df, found):
    columns = sorted(df.columns)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    same(registry.queries()[name](spark, SF), duck.execute(registry.oracle_sql()[name]))


def test_every_query_on_an_empty_table(spark, docs):
    none = docs.limit(0)
    assert sharding.shard_documents(none).count() == quality.quality(none).count() == mixing.mix(none).count() == licenses.scan(none).count() == pii.pseudonyms(none).count() == 0
    assert ngram_join.join_documents(none).count() == language.identify(none).count() == 0
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.overlaps(none, bench).count() == decontamination.overlaps(docs, bench.limit(0)).count() == 0
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(0)
    assert warc.archived(pages).count() == extraction.main_text(pages).count() == 0


# --- sharding


def jump(key, n):
    b, j = -1, 0
    key &= (1 << 64) - 1
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding_by_brute_force(spark, docs):
    rows = sharding.shard_documents(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    by = collections.defaultdict(list)
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "key", jump(r.doc_id, 8), jump(r.doc_id, 9))
        assert r.grown_shard in (r.shard, 8)
        by[r.shard].append(r.slot)
    assert len(rows) == len(text) and all(sorted(x) == list(range(len(x))) for x in by.values())


def test_sharding_of_odd_rows(spark):
    rows = sharding.shard_documents(odd(spark), 3).collect()
    assert len(rows) == len(ODD) and {r.shard for r in rows if r.doc_id is None} == {jump(0, 3)}
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 2} == {(1, 0)}
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    keys = spark.createDataFrame([(-5,), (2**63 - 1,), (0,)], "doc_id long")
    assert {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_rows(keys, 100).collect()} == {k: (jump(k, 100), jump(k, 101)) for k in (-5, 2**63 - 1, 0)}


# --- quality


def measured(text):
    t = text or ""
    w = WORD.findall(t)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    base = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), base


def test_quality_by_brute_force(spark, docs):
    for df in (docs, odd(spark)):
        for r, d in zip(quality.quality(df.coalesce(1)).collect(), df.coalesce(1).collect(), strict=True):
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measured(d.text)
            assert r.kept == (not r.base_failed and not r.failed_rules)


def test_quality_keeps_clean_documents_and_columns(spark, docs):
    kept = quality.accepted(odd(spark))
    assert kept.columns == odd(spark).columns and {r.doc_id for r in kept.collect()} >= {1}
    labels = spark.read.parquet(f"{SF}/labels.parquet").join(quality.quality(docs), "doc_id").collect()
    assert all(r.kept for r in labels if r.quality == 1 and not r.base_failed)
    assert sum(r.kept for r in labels if r.quality == 0) <= 0.05 * sum(r.quality == 0 for r in labels)
    assert {r.doc_id for r in quality.accepted(docs).collect()} == {r.doc_id for r in quality.quality(docs).where("kept").collect()}


# --- n-gram join


def joined(rows, width, percent):
    sets = []
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[top(a)] = top(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted((str(i), len(s), str(least.get(top(k)) if s else i)) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_join_by_brute_force(spark, docs, width, percent, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"x{i}" for i in rng.integers(0, 4000, 160)]
    family = []
    for k in range(90):  # a family about the threshold, so that large regions, pivots and what is left of them all occur
        words = list(base)
        for at in rng.integers(0, 160, rng.integers(0, 7)):
            words[at] = f"y{k}_{at}"
        family.append((1000 + k, " ".join(words)))
    passage = " ".join(f"p{i}" for i in range(60))
    family += [(2000 + k, f"{passage} " + " ".join(f"q{k}_{i}" for i in range(k % 12))) for k in range(80)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + family + [(i, t) for i, t, *_ in ODD if t != LONG and t != LONG + " more"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = joined(rows, width, percent)
    for leaf, few in ((64, 500_000), (8, 0)):
        monkeypatch.setattr(ngram_join, "LEAF", leaf)
        monkeypatch.setattr(ngram_join, "FEW_PAIRS", few)
        monkeypatch.setattr(ngram_join, "PAIRS_A_ROW", 64 if few else 0)
        found = ngram_join.join_documents(df, width, percent)
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect()) == want


def test_join_keeps_one_of_each(spark):
    kept = ngram_join.one_of_each(odd(spark))
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert kept.columns == odd(spark).columns and ids == [1, 2, 3, 4, 5, 7, 9, 10, 11]


def test_shingles_of_pieces():
    data = np.frombuffer("A b c d e".encode() + "a b C d".encode() + b"x" + b" ", np.uint8)
    sets = ngram_join.shingle_sets(data, np.array([0, 9, 9, 16, 17, 18]), 4)
    assert [len(s) for s in sets] == [2, 0, 1, 1, 0] and sets[2][0] in sets[0]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (200, 101)], "u long, v long")
    found = {r.node: r.label for r in components.components(links).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 200: 100}


# --- decontamination


def leaked(docs, items):
    """Every window of every pair: as wide as the shorter side, 13 words at most, with all but 3 in 13 of its words equal."""
    cut = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    out = set()
    for d, text in docs:
        w = cut(text)
        for i, item in items:
            x = cut(item)
            span = min(13, len(x), len(w))
            if not span or (w != x and (len(w) < 5 or len(x) < 3)):
                continue
            if any(sum(a == b for a, b in zip(w[p : p + span], x[q : q + span])) >= span - span * 3 // 13 for p in range(len(w) - span + 1) for q in range(len(x) - span + 1)):
                out.add((d, i))
    return out


def test_decontamination_of_all_lengths(spark):
    """Items and documents of 1 to 30 words, with every number of changed words, against brute force."""
    at = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    items = [(i, " ".join(at.choices(words, k=1 + i % 30))) for i in range(60)]
    docs = []
    for i, item in items:
        own = item.split()
        for changed in range(5):
            x = list(own)
            for k in at.sample(range(len(x)), min(changed, len(x))):
                x[k] = f"z{at.randrange(99)}"
            a, b = sorted((at.randrange(len(x) + 1), at.randrange(len(x) + 1)))
            docs += [" ".join(x), " ".join(["p", "q", *x, "r"]), " ".join(x[a:b]), " ".join(["p", *x[a:]]), " ".join(x[:12])]
    docs = [*enumerate(docs), (9000, None), (9001, ""), (None, items[29][1])]
    made = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (900, None), (901, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.overlaps(*made).collect()}
    assert found == leaked(docs, items) and len(found) > 400


def test_short_masks_miss_every_choice_of_changes():
    for width in range(1, 13):
        for spare in (1, 2):
            masks = decontamination.short_masks(width, spare)
            assert all(any(not set(c) & set(m) for m in masks) for c in itertools.combinations(range(width), decontamination.changes(width))) and all(masks)


def test_decontamination_by_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.where("item_id = 0").first().text.split()
    swapped = " ".join("zz" if k % 9 == 4 else w for k, w in enumerate(item))
    extra = [(9001, "before " + " ".join(item) + " after"), (9002, swapped), (9003, " ".join(item[:9])), (9004, None), (9005, ""), (9006, "a b c d e f g h i"), (9007, "x a b c d e f g h i y")]
    few = [r.doc_id for r in docs.where("n_chars < 900").limit(40).collect()]
    held = docs.where(docs.doc_id.isin(few)).select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    items = bench.select("item_id", "text").unionByName(spark.createDataFrame([(900, "A b, c d e f g h i"), (901, "too short"), (902, None)], "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in decontamination.overlaps(held, items).collect()}
    assert found == leaked([(r.doc_id, r.text) for r in held.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert {(9001, 0), (9002, 0), (9003, 0), (9006, 900), (9007, 900)} <= found
    assert {r.doc_id for r in decontamination.clean(held, items).collect()} == {r.doc_id for r in held.collect()} - {d for d, _ in found}


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontamination.overlaps(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "MAX_SEEDS", 700)
    assert whole and sorted(map(tuple, decontamination.overlaps(docs, bench).collect())) == whole
    assert decontamination.clean(odd(spark), bench).count() == len(ODD)


def test_decontamination_holds_one_block_at_a_time(spark, docs, monkeypatch):
    """However many blocks the seeds make, no plan holds more than the two broadcasts of a single one."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    monkeypatch.setattr(decontamination, "MAX_SEEDS", decontamination.whole_seeds(bench).count() // 3)
    plan = decontamination.overlaps(docs.limit(20), bench)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= 2


# --- pseudonyms

KEY = b"key"


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1000])
def test_permutation(size):
    to = [pii.permute(v, size, KEY, "t") for v in range(size)]
    assert sorted(to) == list(range(size)) and [pii.permute(v, size, KEY, "t", None, True) for v in to] == list(range(size))
    even = [pii.permute(v, size, KEY, "t", lambda x: x % 2) for v in range(size)]
    assert sorted(even) == list(range(size)) and all(a % 2 == b % 2 for a, b in enumerate(even))


def test_pseudonyms_keep_formats_and_links():
    text = 'a 4111 1111 1111 1111, b 4111111111111111 c 4111111111111112; +1 (212) 555-0187 and 2024-02-29 = 29/02/2024, 31.02.2024; 10.0.0.1 999.1.1.1 ann.lee7@mail.example.com token = "deadbeefdeadbeefdeadbeefdeadbeefdeadbeef" 123-45-6789'
    out, kinds = pii.pseudonymise(text, KEY)
    assert collections.Counter(kinds) == {"card": 2, "phone": 1, "date": 2, "ip": 1, "email": 1, "secret": 1, "ssn": 1}
    a, b = re.search(r"a ([\d ]+), b (\d+) ", out).groups()
    assert a.replace(" ", "") == b != "4111111111111111" and pii.luhn_digit(b[:-1]) == int(b[-1])
    assert "4111111111111112" in out and "31.02.2024" in out and "999.1.1.1" in out and "@mail.example.com" in out
    y, d = re.search(r"and (\d{4}-\d\d-\d\d) = (\d\d/\d\d/\d{4})", out).groups()
    assert y.split("-") == d.split("/")[::-1]
    assert pii.pseudonymise(out, KEY, back=True)[0] == text
    assert pii.pseudonymise(None, KEY) == (None, []) and pii.pseudonymise("", KEY) == ("", [])


def test_pseudonyms_round_trip(spark, docs):
    whole = docs.select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    text = collections.Counter((r.doc_id, r.text) for r in whole.collect())
    found = pii.pseudonyms(whole).collect()
    assert collections.Counter((r.doc_id, pii.pseudonymise(r.text, b"turnwise-example-key", back=True)[0]) for r in found) == text
    assert sum(r.n_values for r in found) > 0


# --- mixing


def test_poisson_counts(spark):
    rows = spark.createDataFrame([(i, "x", "en", "big" if i % 3 else "small", 1) for i in range(6000)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mix(rows, weights={"big": 1.0, "small": 3.0}, size=0.5)
    found = {r.source: r.n for r in mixed.groupBy("source").count().withColumnRenamed("count", "n").collect()}
    assert abs(found["big"] - 750) < 120 and abs(found["small"] - 2250) < 220
    keys = [r.shuffle_key for r in mixed.collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    heavy = mixing.mix(rows.limit(50), size=500.0).count()
    assert abs(heavy - 25_000) < 800


def test_mixing_odd_rows(spark):
    mixed = mixing.mix(odd(spark), size=20.0)
    assert mixed.columns == [c for c in odd(spark).columns if c != "copy"] + ["copy", "shuffle_key"]
    counts = collections.Counter(r.doc_id for r in mixed.collect())
    assert counts[1] % 2 == 0 and counts[None] > 0 and counts[2] > 0 and mixing.mix(odd(spark), weights={}).count() == 0


# --- licences


def test_license_rules(spark):
    bsd = "\n".join(licenses.SENTENCES[k][0] + "." for k in ("BSD_redistribute", "BSD_source", "BSD_binary", "BSD_endorse"))
    mit = " ".join(licenses.SENTENCES[k][0].rstrip(":") + "." for k in ("MIT_ref", "MIT_grant", "MIT_notice", "MIT_as_is"))
    rows = [(1, bsd, "en", "a"), (2, "\n".join(bsd.split("\n")[:3]), "en", "a"), (3, mit, "en", "a"), (4, "THIS!! WORK!! IS!! LICENSED!! UNDER!! THE!! GNU!! GENERAL!! PUBLIC!! LICENSE,!! VERSION!! 3.!!", "en", "a"), (5, bsd.split("\n")[1], "en", "a"), (6, "The licence was lost.", "en", "a")]
    found = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.scan(odd(spark, rows)).collect()}
    assert found == {1: ("BSD-3-Clause", ""), 2: ("BSD-2-Clause", ""), 3: ("MIT", ""), 4: ("GPL-3.0", ""), 5: ("", "BSD_source"), 6: ("", "")}
    odd_rows = {r.doc_id: r.licenses for r in licenses.scan(odd(spark)).collect()}
    assert odd_rows[10] == "MIT" and odd_rows[2] == odd_rows[3] == ""


# --- WARC


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "x" * 5000 + "é</p>"
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", "short"), (6, "http://a/6", "short"), (2, "http://a/2", long), (None, "http://a/n", long), (7, "http://a/" + "u" * 9000, long + "!")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    found = warc.read_warc(spark, path).collect()
    assert len(found) == len(rows)
    for r in found:
        want = next(h or "" for i, u, h in rows if i == r.page_id and u == r.target_uri).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(want), hashlib.sha256(want).hexdigest())
        assert (bytes(r.payload) if r.record_type == "response" else r.payload) == (want if r.record_type == "response" else None)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in found)
    assert kinds == sorted([("1", "response", None), ("2", "revisit", 1), ("2", "revisit", 1), ("None", "revisit", 1), ("3", "response", None), ("4", "response", None), ("5", "response", None), ("6", "response", None), ("7", "response", None)])
    only = warc.read_warc(spark, path).where("record_type = 'revisit' AND page_id IN (2, 3)").collect()
    assert [r.page_id for r in only] == [2, 2] and warc.read_warc(spark, path, "skip").where("payload IS NOT NULL").count() == 0


# --- extraction


def test_extraction_of_structure():
    page = "<html><head><title>t</title><script>var a='</p><p>no';</script></head><body><header>top</header><nav><ul><li>menu</ul></nav><main><article><header>h</header><h1>Title &amp;  more</h1><p>One<br>two <b>th</b>ree<p>Four<div class='ad-box ad'>buy</div><!-- x --><form>f</form><blockquote>Quote</blockquote></article><section id='comments'><p>me too</p></section></main><aside>s</aside><footer>&copy; f</footer></body></html>"
    assert [t for t, k in extraction.blocks(page) if k == 0] == ["Title & more", "One two three", "Four", "Quote"]
    assert [t for t, k in extraction.blocks("<article><p>a &lt;b&gt; <i>c</i></p><p>cut &am") if k == 0] == ["a <b> c", "cut &am"]
    assert extraction.blocks("") == [] and extraction.blocks("<p") == [] and extraction.blocks("plain") == [("plain", 1)]


def test_extraction_of_repeated_runs(spark):
    menu = "<div>Home News Sport Weather About this site</div>"
    story = "<div>{0} one two three four five {0} six seven eight</div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{menu}{story.format(f's{i}')}</body>") for i in range(4)] + [(9, "http://h.example/copy", f"<body>{menu}{story.format('s0')}</body>"), (10, "http://other.example/", f"<body>{menu}</body>"), (11, None, None), (12, None, "")]
    found = {r.page_id: (r.text, r.n_chars) for r in extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[0][0] == found[9][0] == "s0 one two three four five s0 six seven eight" and found[10][0] == "Home News Sport Weather About this site" and found[11] == found[12] == ("", 0)


def test_extraction_of_the_table(spark):
    import html as entities

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in extraction.main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", re.sub(r"</?b>", "", m[1].replace("<br>", " "))))
        want = "\n\n".join(x for x in (" ".join(entities.unescape(p).split()) for p in parts) if x)
        assert (r.text, r.n_chars) == (want, len(want))


# --- language


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.99 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, docs):
    model = language.fit(docs)
    found = {r.doc_id: r.lang_pred for r in language.predict(odd(spark), model).collect()}
    assert found[2] == found[3] == found[4] == found[11] == "und" and found[7] == "en"
    assert {r.lang_pred for r in language.identify(odd(spark).where("lang IS NULL")).collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 4, 6, 9, 40])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n and set(np.unique(code)) <= {-1, 1}


def test_known_sentences_are_reachable(spark):
    rows = [(k, x, "en", "a") for k, x in enumerate(x for found in licenses.SENTENCES.values() for x in found)]
    names = [name for name, found in licenses.SENTENCES.items() for _ in found]
    found = {r.doc_id: r.sentence_ids for r in licenses.scan(odd(spark, rows)).collect()}
    assert found == dict(enumerate(names))


def test_wrapped_license_headers(spark):
    import textwrap

    S = licenses.SENTENCES
    wrap = lambda t, sign="": "\n".join(sign + x for x in textwrap.wrap(t, 60))
    mit = "\n\n".join(["MIT License", "Copyright (c) 2020 A. Author", wrap(S["MIT_grant"][0]), wrap(S["MIT_notice"][0] + "."), wrap(S["MIT_as_is"][0] + ". IN NO EVENT")])
    bsd = "\n".join([wrap(S["BSD_redistribute"][0]), "", wrap("1. " + S["BSD_source"][0] + "."), wrap("2. " + S["BSD_binary"][0] + "."), wrap("3. " + S["BSD_endorse"][0] + ".")])
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
    full = wrap(apache, "# ") + "\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required"
    gpl = wrap(" ".join(S[k][0] + "." for k in ("GPL_free", "GPL_hope", "GPL_see", "GPL_copy")), " * ")
    rows = [(1, mit, "en", "a"), (2, bsd, "en", "a"), (3, full, "en", "a"), (4, gpl, "en", "a"), (5, apache + " http://www.apache.org/licenses/LICENSE-2.0.", "en", "a"), (6, "all\nrights\nreserved", "en", "a"), (7, "It is Licensed under the. MIT License of old", "en", "a")]
    found = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.scan(odd(spark, rows)).collect()}
    assert found == {1: ("MIT", ""), 2: ("BSD-3-Clause", ""), 3: ("Apache-2.0", ""), 4: ("GPL-3.0-or-later", ""), 5: ("Apache-2.0", ""), 6: ("All-Rights-Reserved", ""), 7: ("", "")}
    assert {r.doc_id: r.sentence_ids for r in licenses.scan(odd(spark, rows)).collect()}[5] == "Apache2_ref,Apache2_comply,Apache2_copy"


def test_decontamination_finds_every_pattern_of_three(spark):
    import itertools

    item = [f"w{k}" for k in range(13)]
    swaps = list(itertools.combinations(range(13), 3))
    pad = lambda k: [[], ["x"], ["x", "y"]][k % 3]
    texts = [(k, " ".join(pad(k) + ["zz" if i in s else w for i, w in enumerate(item)] + pad(k // 3))) for k, s in enumerate(swaps)]
    four = [(1000, " ".join("zz" if i in (0, 4, 8, 12) else w for i, w in enumerate(item)))]
    held = spark.createDataFrame(texts + four, "doc_id long, text string")
    items = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(["before", *item, "after"]))], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.first_word, r.most_equal) for r in decontamination.overlaps(held, items).collect()}
    assert {d for d, i in found if i == 0} == {d for d, i in found if i == 1} == set(range(286))
    assert all(found[k, 0] == (len(pad(k)), 10) for k in range(286))


def test_extraction_keeps_shared_passages_and_cuts_templates_in_articles(spark):
    quote = "to be or not to be that is the question whether tis nobler"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    share = "<p>Read also what our readers liked best this week</p>"
    # Pages 0 and 1 are revisions of one article, 2 and 3 quote a passage, every page opens with a phrase and has a share line.
    body = {0: own(0), 1: own(0) + " revised", 2: f"{own(2)} {quote} a", 3: f"{own(3)} {quote} b", **{i: own(i) for i in range(4, 8)}}
    text = {i: f"It was said in the town on day {i} that {b}" for i, b in body.items()}
    for tag in ("article", "div"):
        rows = [(i, f"http://h.example/{i}", f"<body><{tag}><h2>Introduction {i // 2}</h2><p>{t}</p>{share}</{tag}></body>") for i, t in text.items()]
        found = {r.page_id: r.text for r in extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert found == {i: f"Introduction {i // 2}\n\n{t}" for i, t in text.items()}


@pytest.mark.parametrize("name", ["token", "secret", "passwd", "password", "api_key", "apikey", "api-key", "access_key", "AccessKey"])
def test_secrets_of_letters_alone(name):
    text = f"{name} = ABCDEFGHIJKLMNOPQRST"
    new, kinds = pii.pseudonymise(text, KEY)
    assert kinds == ["secret"] and "ABCDEFGHIJKLMNOPQRST" not in new and pii.pseudonymise(new, KEY, back=True)[0] == text
