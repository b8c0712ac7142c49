"""Main text: attributes and broken markup, and repeated runs against brute force."""

import collections
import random
import time

import pytest

from turnwise.llm import extraction


def kept(page):
    return extraction.article(page)


def test_attributes_are_read_as_pairs():
    assert kept('<article><p title="the hidden story">a</p><p data-x="a class=ad">b</p><p hidden>c</p><p aria-hidden="true">d</p><p class="x > y ad">e</p></article>') == ["a", "b"]
    assert kept("<article><p title='1 > 0'>a</p><p title=\"open>b</p><p>c</p></article>") == ["a", "b", "c"]
    assert kept('<article><p class="legal">terms</p><p class="search">find</p><div class="share">s</div><section id="comments"><article class="comment">no</article></section></article>') == ["terms", "find"]


def test_marks_round_an_article_do_not_void_it():
    assert kept('<div class="post comments-open"><article><p>a</p></article></div><section class="comments"><article class="comment"><p>no</p></article></section>') == ["a"]
    assert kept('<main><p>a</p></main><div class="related"><article><p>no</p></article></div>') == ["a"]
    assert kept('<div><p>a long enough text</p></div><div class="related"><article><p>no</p></article></div>') == ["a long enough text"]
    assert kept("<aside><article>no</article></aside><p>a</p>") == ["a"]


def test_marks_are_whole_names():
    for name in ("site has-sidebar", "post comments-open", "no-nav", "content widget-text", "banner-photo", "nav-free page", "with-ads"):
        assert kept(f'<div id="content" class="{name}"><p>the story</p></div>') == ["the story"], name
        assert kept(f'<article><p class="{name}">the story</p></article>') == ["the story"], name
    assert kept('<article><p>one <a class="related-link">two</a> three</p></article>') == ["one two three"]
    for name in ("site-header", "main-nav", "ad-slot-3", "cookie_notice", "share-buttons", "Sidebar", "comment-list", "footer__links", "sidebar-left", "related-posts"):
        assert kept(f'<div><p>the story of a page</p></div><div class="{name}"><p>no</p></div>') == ["the story of a page"], name


def test_a_mark_round_the_page_is_void():
    story = "<p>" + "the long story " * 20 + "</p>"
    assert len(kept(f'<div class="legal">{story}<div class="share">tweet</div></div>')) == 1
    assert len(kept(f'<div class="legal"><div class="notice">{story}</div><div class="nav">x</div></div><p>short</p>')) == 2
    assert kept(f'<p>short</p><div class="comments">{story}</div>') == ["short"]
    assert kept(f'<p>short</p><nav>{story}</nav>') == ["short"]
    assert kept(f'<article><p>short</p></article><div class="legal">{story}</div>') == ["short"]


@pytest.mark.parametrize("piece", ["<a ", "</b>", "<p x='", '<p x="', "<!--", "<script", "<b>", "<div>", "</p", "<li>x", "<a x='>'", "&", "<title>", "< "])
def test_time_is_linear_in_broken_markup(piece):
    def seconds(n):
        page = "<div><i><u>" * 200 + piece * n
        began = time.process_time()
        extraction.blocks(page)
        return time.process_time() - began

    assert seconds(160_000) < 12 * max(seconds(20_000), 0.05)


def brute(rows):
    kinds = dict(zip((i for i, *_ in rows), extraction._Streams([extraction.article(h or "") for _, _, h in rows], [u for _, u, _ in rows]).signatures().tolist(), strict=True))
    pages = {i: (extraction._host(u), extraction.article(h or "")) for i, u, h in rows}
    total, held = collections.defaultdict(set), collections.defaultdict(set)
    for i, (host, blocks) in pages.items():
        total[host] |= {kinds[i]} if blocks else set()
        for b in blocks:
            w = b.split(" ")
            for x in [tuple(w)] if len(w) < extraction.LONG else [tuple(w[k : k + extraction.LONG]) for k in range(len(w) - extraction.LONG + 1)]:
                held[host, x].add(kinds[i])
    hot = {k for k, v in held.items() if len(v) >= 3 and 2 * len(v) >= len(total[k[0]])}
    out = {}
    for i, (host, blocks) in pages.items():
        texts = []
        for b in blocks:
            w = b.split(" ")
            if len(w) < extraction.LONG:
                texts += [b] * ((host, tuple(w)) not in hot)
            else:
                gone = {j for k in range(len(w) - extraction.LONG + 1) if (host, tuple(w[k : k + extraction.LONG])) in hot for j in range(k, k + extraction.LONG)}
                texts.append(" ".join(x for j, x in enumerate(w) if j not in gone))
        out[i] = "\n\n".join(x for x in texts if x) or "\n\n".join(blocks)
    return out


def test_repeated_runs_by_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    runs = {h: [own(n) for n in (24, 25, 23, 120, 60)] for h in "abc"}
    menu = {h: own(9) for h in "abc"}
    rows = []
    for i in range(60):
        h = "aaab"[i % 4] if i < 52 else "c"
        parts = [f"<p>{own(rng.randrange(1, 90))} {r} {own(rng.randrange(0, 5))}</p>" for k, r in enumerate(runs[h]) if rng.random() < (0.9, 0.6, 0.9, 0.45, 0.8)[k]]
        tag = rng.choice(["article", "div"])
        rows.append((i, f"https://{h}.example/{i}", f"<html><{tag}><p>{menu[h]}</p>{''.join(parts)}<p>{own(12)}</p></{tag}></html>"))
    rows += [(100, "https://a.example/x", f"<p>{menu['a']}</p>"), (101, None, None), (102, "https://d.example/", runs["a"][3])]
    want = brute(rows)
    assert sum(len(w.split()) for w in want.values()) < sum(len(" ".join(extraction.article(h or "")).split()) for _, _, h in rows) - 4000 and want[100] == menu["a"]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, run string, key int")
    for most in (2_000_000, 0):
        monkeypatch.setattr(extraction, "MAX_BROADCAST", most)
        found = extraction.main_text(df).collect()
        assert {r.page_id: r.text for r in found} == want and all(r.n_chars == len(r.text) and r.url == dict((i, u) for i, u, _ in rows)[r.page_id] for r in found)


def test_copies_and_near_copies_are_no_evidence(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**9)}" for _ in range(400)]
    rows = []
    for i in range(12):
        mine = list(words)
        for k in range(i % 4):
            mine[rng.randrange(400)] = f"x{i}{k}"
        rows.append((i, f"https://a.example/{i}", f"<article><p>{' '.join(mine)}</p></article>"))
    rows += [(100 + i, f"https://a.example/{i}", f"<article><p>{' '.join(f'v{i}x{k}' for k in range(90))}</p></article>") for i in range(12)]
    found = {r.page_id: r.text for r in extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == extraction.article(h)[0] for i, _, h in rows)
