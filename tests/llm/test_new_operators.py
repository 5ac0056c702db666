"""HTML extraction, fill in the middle and Merkle manifests on small tables against brute force."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandcheck.llm import merkle, middle, pages

#: Columns with names that operators use inside.
EXTRA = ("id", "n", "at", "tree", "place", "node", "steps", "items", "form", "h1", "output", "root", "proof", "text_", "__at", "__task")
LONG = "This paragraph of running text tells of something, has commas and full stops, and goes on for a good while."


def with_extra(frame):
    return frame.withColumns({c: F.lit("extra") for c in EXTRA if c not in frame.columns})


# --- pages

PAGES = {
    "main": (
        f'<html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=/>x</a></nav><main><h1>T</h1><p>{LONG}</p><p>Short.</p></main>'
        f'<aside>{LONG}</aside><section class="comments"><h2>Comments</h2><article><p>{LONG * 3}</p></article></section><footer>{LONG}</footer></body></html>',
        f"T {LONG} Short.",
    ),
    "names": (
        f'<div id="menu"><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></div><div id="content"><h2>Title</h2><div class="ad">{LONG}</div><p>{LONG}'
        f'<p>Second one.<p>{LONG}</div><div class="sidebar"><p>{LONG}</p></div><div id="footer">&copy; 2020 Foo</div>',
        f"Title {LONG} Second one. {LONG}",
    ),
    "bare": (
        f"<div><a href=a>Home</a> <a href=b>News</a></div><div><h2>Title</h2><p>{LONG}</p><p>Second.</p><p>{LONG}</p></div><div>&copy; 2020 Foo</div>",
        f"Title {LONG} Second. {LONG}",
    ),
    "table": (f"<table><tr><td><a href=1>one</a><br><a href=2>two</a></td><td><h1>Title</h1>{LONG}<br>more<br>{LONG}</td></tr></table>", f"Title {LONG} more {LONG}"),
    "page in a form": (f"<form><div><article><h1>T</h1><p>{LONG}</p></article></div></form>", f"T {LONG}"),
    "form in an article": (f"<article><p>{LONG}</p><form><label>Your name</label><input></form><p>End &lt;b&gt; &amp; done&nbsp;now.</p></article>", f"{LONG} End <b> & done now."),
    "notices": (
        f'<div class="cookie-notice"><p>{LONG}</p></div><article><header><h1>T</h1></header><p>{LONG}</p><div class="notice">{LONG}</div><p>e</p><footer>tags</footer>'
        f'</article><div class="comments"><div class="comment">{LONG * 2}</div></div>',
        f"T {LONG} e",
    ),
    "cut off": (f"<article><h1>T</h1><p>{LONG} &am", f"T {LONG} &am"),
    "short": ("<nav>a</nav><article><p>Hi</p></article><footer>b c d e f g</footer>", "Hi"),
    "code": ('<article><p>a<!-- <p>x</p> --><script>var a="<p>b</p>"</script><style>p</style>c</p><!-- open', "ac"),
    "inline": ('<article><p>fo<b>o</b>bar <span class="ad">AD <span>q</span> r</span>baz</p></article>', "foobar baz"),
    "no markup": ("just  text\n here, a < b", "just text here, a < b"),
    "only names": (f'<div class="ad-box"><p>{LONG}</p></div>', LONG),
    "hidden": (f'<article><p hidden>x</p><p style="display: none">y</p><p>{LONG}</p></article>', LONG),
    "headline above": (f"<main><h1>T</h1><article><p>{LONG}</p></article><p>{LONG[:40]}</p></main>", f"T {LONG}"),
    "stray end": (f"<div><article><p>{LONG}</p></div></div><p>tail</p></article></div>", f"{LONG} tail"),
    "null": (None, ""),
    "empty": ("", ""),
    "only markup": ("<p></p><nav>menu</nav>", ""),
}


def test_pages(spark):
    rows = [(i, k, p) for i, (k, (p, _)) in enumerate(PAGES.items())] + [(None, "main", PAGES["main"][0]), (0, "main", PAGES["main"][0])]
    frame = with_extra(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    found = pages.extracted(frame)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["url"], r["text"]) == (r["url"], PAGES[r["url"]][1]) and r["n_chars"] == len(r["text"])
    assert pages.extracted(frame.limit(0)).count() == 0


def built_page(seed: int) -> tuple[str, str]:
    """A page put together from known parts, and the text of its article."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeéöß", k=r.randint(1, 9)))
    say = lambda n: " ".join(word() for _ in range(n)) + r.choice([".", " & so", ' "x"', ", a<b", ""])
    code = lambda s: html.escape(s, quote=r.random() < 0.5)
    beside = [
        lambda: f"<nav><ul>{''.join(f'<li><a href=/{word()}>{word()}</a>' for _ in range(5))}</ul></nav>",
        lambda: f'<div class="{r.choice(["ad", "advert-top", "cookie-banner", "notice", "newsletter-signup"])}"><p>{code(say(30))}</p></div>',
        lambda: f'<aside class="sidebar"><h3>{word()}</h3><p>{code(say(40))}</p></aside>',
        lambda: f'<form action="/s"><label>{word()}</label><input name=q><p>{code(say(20))}</p></form>',
        lambda: f'<script>if (a < b) {{ x = "<p>{word()}</p>" }}</script><style>p {{ }}</style><!-- {word()} <p>no</p> -->',
    ]
    parts, text = [], []
    for k in range(r.randint(1, 12)):
        said = say(r.randint(1, 60))
        text.append(" ".join(said.split()))
        shown = code(said).replace(" ", r.choice([" ", "  ", "\n", "&nbsp;"]), 2)
        parts.append(f"<h1>{shown}</h1>" if k == 0 else r.choice([f"<p>{shown}</p>", f"<p><b>{shown}</b>", f"<div><p>{shown}</p></div>", f"<ul><li>{shown}</ul>", f"<blockquote>{shown}</blockquote>"]))
        if r.random() < 0.2:
            parts.append(r.choice(beside)())
    body = "".join(parts)
    body = r.choice([f"<article>{body}</article>", f"<main>{body}</main>", f'<div role="main"><div>{body}</div></div>', f'<div class="wrap"><div itemprop="articleBody">{body}</div></div>'])
    around = [r.choice(beside)() for _ in range(r.randint(0, 4))]
    comments = f'<section id="comments"><div class="comment"><p>{code(say(80))}</p></div></section>' if r.random() < 0.5 else ""
    footer = f"<footer>&copy; {word()} {code(say(30))}</footer>"
    page = f"<!DOCTYPE html><html><head><title>{word()}</title></head><body><header>{word()}</header>{''.join(around)}{body}{comments}{footer}" + r.choice(["", "</body></html>"])
    return page, " ".join(filter(None, text))


def test_built_pages():
    for seed in range(300):
        page, text = built_page(seed)
        assert pages.main_text(page) == text, page


def test_surges_and_dives():
    assert pages.surges([]) == [] and pages.surges([0, 0]) == []
    assert pages.surges([5, 0, 0, 0, 40, 50, 3, 0, 0, 0, 7]) == [(3, 7)] or pages.surges([5, 0, 0, 0, 40, 50, 3, 0, 0, 0, 7]) == [(4, 7)]
    assert pages.surges([3, 0, 0, 0, 9, 1]) == [(2, 6)]
    assert pages.surges([90, 0, 0, 0, 0, 0, 90, 4]) == [(0, 1), (4, 8)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("<>/ap\"'=!-& ;div"), max_size=80))
def test_any_page_is_read_to_its_end(page):
    assert isinstance(pages.main_text(page), str)


def test_long_pages():
    for page in ("<b>" * 100_000 + "<div>" * 50_000, "<a href='" * 50_000, "<p><b>x<br>" * 50_000, "<article>" * 20_000 + "x", "&amp" * 200_000, "<div><article>" * 20_000 + "</div>" * 40_000):
        pages.main_text(page)


# --- fill in the middle


def arranged(doc_id, text, seed=7, cut=100, suffix_first=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(lines[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut:
        return doc_id, n, "plain", None, None, text
    form = "spm" if h[3] % 100 < suffix_first else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "\n", "\n\n", "a", "a\n", "a\nb", "é\n\nö\n", "<P>\nx", "x\ny<M>", "<S", "S>\n<\nP>\n<", "\r\n x\n", "l\n" * 50_000, "x" * 200_000, "one\ntwo\nthree\nfour\nfive\n" * 3, "a\x00b\n"]


@pytest.mark.parametrize("cut, suffix_first", [(100, 50), (60, 0), (60, 100)])
def test_middles(spark, cut, suffix_first):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(5 * len(TEXTS))] + [(None, TEXTS[15]), (None, None), (3, TEXTS[3]), (3, TEXTS[15]), (-20, TEXTS[15])]
    frame = with_extra(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    made = middle.filled_in_middle(frame, cut_percent=cut, suffix_first_percent=suffix_first).withColumn("back", middle.restored(F.col("output"), F.col("form")))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    order = lambda x: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in x)
    got = sorted((tuple(r) for r in made.collect()), key=order)
    assert got == sorted((arranged(d, t, 7, cut, suffix_first) + (t or "",) for d, t in rows), key=order)
    assert {g[2] for g in got} >= {"plain", "psm" if suffix_first == 0 else "spm"}
    assert middle.filled_in_middle(frame.limit(0)).count() == 0


# --- Merkle manifests


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(levels, i):
    for nodes in levels[:-1]:
        start = i // 16 * 16
        yield "".join(nodes[start:i]), "".join(nodes[i + 1 : start + 16])
        i //= 16


def brute_force(rows):
    """Rows are (doc_id, source, lang, n_chars, text); the result has a row for each, in any order."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, sha("".join(map(framed, r))), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree_levels([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names]
    top = tree_levels([t[-1][0] for t in trees])
    out = []
    for no, (name, levels) in enumerate(zip(names, trees, strict=True)):
        for i, (_, _, leaf, r) in enumerate(sorted(by_source[name], key=lambda x: x[:3])):
            proof = [*path(levels, i), *path(top, no)]
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = None if r[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
                node = sha("".join(map(framed, (*r[:4], text))))
            for left, right in proof:
                node = sha(left + node + right)
            out.append((r[0], leaf, levels[-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), node, node == top[-1][0]))
    return out


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def checked(spark, rows):
    frame = with_extra(spark.createDataFrame(rows, SCHEMA).repartition(3))
    found = merkle.verified(frame, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    order = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted((tuple(r) for r in found.collect()), key=order) == sorted(brute_force(rows), key=order)


def test_manifest_of_all_kinds_of_rows(spark):
    rows = [(i, "hot", "en", i, f"Text {i} É") for i in range(4200)]  # three stored levels
    rows += [(i, f"s{i % 40}", None if i % 3 else "de", None, None if i % 7 == 0 else "") for i in range(5000, 5100)]
    rows += [(i, None, "x", 1, "Null source") for i in range(17)] + [(i, "", "x", 1, "Empty Source") for i in range(16)] + [(i, "ü", "x", 1, "One More") for i in range(257)]
    rows += [(None, "hot", "en", 1, "No Id"), (None, None, None, None, None), (7, "hot", "en", 7, "Other Text"), *[(8, "hot", "en", 8, "Text 8 É")] * 40, (9000, "alone", "en", 100_000, "Aé" * 50_000)]
    random.Random(1).shuffle(rows)
    checked(spark, rows)


def test_manifest_of_one_row_and_of_none(spark):
    checked(spark, [(5, "a", "en", 1, "ABC")])
    checked(spark, [(i, "a", "en", 1, "ABC") for i in range(16)])
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.verified(empty).count() == 0


@pytest.mark.parametrize("every", [1, 3])
def test_levels_between_stored_ones_make_no_difference(spark, every):
    nodes = [sha(str(i)) for i in range(1000)]
    leaves = spark.createDataFrame([(i, "a", n) for i, n in enumerate(nodes)], "doc_id bigint, source string, node string")
    made = merkle.manifest(leaves, every=every)
    levels = tree_levels(nodes)
    assert made.root == levels[-1][0]
    for r in merkle.extracted(made, every).collect():
        assert [(x["left"], x["right"]) for x in r["proof"]] == list(path(levels, r["doc_id"]))
