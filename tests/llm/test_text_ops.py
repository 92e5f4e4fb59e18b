"""Packing, tree BPE, HTML extraction and exact dedup against plain Python."""

import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import bpe_tree, exact_dedup, html_text, packing

DOC = "doc_id long, text string"
ALPHABET = ["a", "é", " ", "\n", "\t", " ", "1", "²", "漢", "<|endoftext|>", "'s", "'", "!", "\x85", "\x1c", "\x7f", "\r\n", "😀", "  ", "​", "½", "the", "ing", "THE", "%%%", "ß×÷"]


def odd_texts(n, seed=1, longest=60):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET[: r.randint(1, len(ALPHABET))]) for _ in range(r.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(odd_texts(200))] + [(20_000, None), (20_001, ""), (20_002, "x" * 50_000), (20_002, "dup"), (None, "no id"), (7, rows[3][1])]
    return rows


def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


def test_chunks_encode_like_whole_texts():
    encode, plain = packing.load_encoder(packing.default_vocabulary()), plain_tokenizer()
    texts = odd_texts(3000, seed=5)
    ids, bounds = encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t
    special = plain.encode("a <|endoftext|> b", add_special_tokens=False).ids
    ids, bounds = encode(pa.array(["a <|endoftext|", "> b", "a <|endoftext|> b", "<|endoftext|>"]))
    assert ids[bounds[2] : bounds[3]].tolist() == special and bounds[4] - bounds[3] == 1
    assert ids[: bounds[1]].tolist() == plain.encode("a <|endoftext|", add_special_tokens=False).ids


def check_pieces(pieces, rows, window):
    plain = plain_tokenizer()
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(plain.encode(t or "", add_special_tokens=False).ids + [1])
    got = defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
    assert got.keys() == want.keys()
    for d, streams in want.items():
        if len(streams) > 1:
            assert sum(p.length for p in got[d]) == sum(map(len, streams))
            continue
        at = 0
        for p in sorted(got[d], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(streams[0])
            assert p.ids_crc32 == zlib.crc32(np.array(streams[0][at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(streams[0])
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_packing_is_whole_and_tight(spark, documents):
    docs = spark.createDataFrame([(*r, 1) for r in documents], DOC + ", start int").repartition(3)
    for window in (2048, 64):
        check_pieces(packing.pack(docs, window=window).collect(), documents, window)
    assert packing.pack(spark.createDataFrame([], DOC)).count() == 0


def test_sum_of_squares_choice():
    """Every placement has the smallest sum of squares among all possible ones."""
    r = random.Random(3)
    squares = packing.SumOfSquares(16)
    for k in range(500):
        size = r.randint(1, 15)
        before = squares.count[1:16].copy()
        options = []
        for level in range(0, 17 - size):
            n = before.copy()
            if level and not n[level - 1]:
                continue
            if level:
                n[level - 1] -= 1
            if level + size < 16:
                n[level + size - 1] += 1
            options.append(int((n**2).sum()))
        squares.place((k,), size)
        assert int((squares.count[1:16] ** 2).sum()) == min(options)


def test_closing_moves_only_the_emptiest_windows():
    r = random.Random(8)
    for _ in range(200):
        w = r.choice([4, 16, 64, 2048])
        squares = packing.SumOfSquares(w)
        want = defaultdict(list)
        for k in range(r.randint(0, 300)):
            tokens = np.arange(r.randint(1, w - 1))
            want[k] = tokens.tolist()
            for doc, start, ids, _ in squares.place((k, 0, tokens, len(tokens)), len(tokens)) or []:
                assert ids.tolist() == want.pop(doc)
        held = sum(map(len, squares.open))
        tokens = sum(map(len, want.values()))
        sequences = list(squares.close())
        got = defaultdict(dict)
        for s in sequences:
            for doc, start, ids, _ in s:
                got[doc][start] = ids.tolist()
        assert {d: sum((p[k] for k in sorted(p)), []) for d, p in got.items()} == want
        sizes = [sum(len(p[2]) for p in s) for s in sequences]
        assert sizes == [w] * (tokens // w) + [1 << k for k in range(w.bit_length() - 1, -1, -1) if (tokens % w) >> k & 1]
        assert not held or len(sequences) >= 1


def test_most_remainders_stay_whole(spark):
    """Eight partitions of the larger table: what the end of a partition cuts is a small part of all remainders."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartitionByRange(8, "doc_id")
    rows = packing.pack(docs).selectExpr("doc_id", "doc_tokens % 2048 as rest", "start = doc_tokens - doc_tokens % 2048 and length = doc_tokens % 2048 as whole").where("rest > 0")
    n, whole = rows.selectExpr("count(distinct doc_id) as n", "count_if(whole) as whole").first()
    print("whole remainders", whole, "of", n)
    assert whole >= 0.85 * n


def test_tree_codec_matches_the_library():
    import public_tokenizers
    import tiktoken

    ranks = bpe_tree.load_ranks(bpe_tree.default_vocabulary())
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    texts = odd_texts(1500, seed=6, longest=120) + ["".join(r.choice("abcdethingsou") for _ in range(r.randint(0, 300))) for _ in range(500)]
    for leaf in (2, 5, 40, bpe_tree.LEAF_CHARS):
        codec = bpe_tree.TreeCodec(ranks, public_tokenizers.PATTERN, leaf, 4 if leaf < bpe_tree.LEAF_CHARS else bpe_tree.LEAF_BYTES)
        for t in texts:
            ids = codec.encode(t)
            assert ids == plain.encode_ordinary(t)
            assert codec.decode(np.array(ids, dtype="<u4")) == t.encode()


def test_bpe_query(spark, documents):
    import public_tokenizers
    import tiktoken

    ranks = bpe_tree.load_ranks(bpe_tree.default_vocabulary())
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe_tree.decode(bpe_tree.encode(spark.createDataFrame([(*r, 1) for r in documents], DOC + ", ids int"))).collect()
    want = sorted((str(d), np.array(plain.encode_ordinary(t or ""), dtype="<u4").tobytes().hex(), (t or "").encode().hex()) for d, t in documents)
    assert sorted((str(r.doc_id), bytes(r.ids).hex(), bytes(r.decoded).hex()) for r in got) == want
    assert bpe_tree.encode(spark.createDataFrame([], DOC)).count() == 0


def test_exact_dedup(spark, documents):
    rows = documents + [(30_000, " a\tb\n"), (30_001, "ab"), (29_999, "a b  "), (30_005, "a b   "), (30_006, None), (30_007, " \n")] + [(40_000 + i, "hot  text") for i in range(300)]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], DOC + ", row int, hash string")
    groups = defaultdict(list)
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    for d, t in rows:
        groups[norm(t)].append((-len(t or ""), d is None, d or 0, d))
    want = sorted(str((d, (best := min(groups[norm(t)]))[3], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest())) for d, t in rows)
    got = exact_dedup.exact_dedup(docs).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.exact_dedup(docs, carry=("doc_id", "hash", "text")).collect()
    assert all(r.kept and r.doc_id == r.keep_id == r.carried.doc_id and r.carried.hash == "x" for r in kept)
    text_of = lambda best: {t or "" for d, t in rows if d == best[3] and -len(t or "") == best[0]}
    assert len(kept) == len(groups) and all((r.carried.text or "") in text_of(min(groups[norm(r.carried.text)])) for r in kept)
    twice = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], DOC)).collect()
    assert sorted(r.kept for r in twice) == [False, False, True, True]
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOC)).count() == 0


PAGES = {
    "article": ("<html><head><title>T</title><script>if (a</b) '</p>'</script></head><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One\n two&nbsp;<b>bold</b>tail<br>next</p><p>x</p><div class='comments'><p>Hi</p></div></article><footer>c</footer>", "T & U\n\nOne two boldtail next\n\nx"),
    "none": (None, ""),
    "empty": ("", ""),
    "no main element": (
        '<body><div id="main-menu"><a href=a>Home</a> <a href=b>News</a></div><div><a href=1>one</a></div><div class="content"><p>' + "word " * 40 + "</p><p>ok</p><p>" + "more " * 30 + '</p></div><div class="cookie-notice">We use cookies here and there.</div><div class="sidebar"><p>' + "side " * 50 + "</p></div></body>",
        ("word " * 40).strip() + "\n\nok\n\n" + ("more " * 30).strip(),
    ),
    "forms and comments": ("<article><p>Text.</p><form><label>Name</label><input></form><!-- <p>no</p> --><aside>side</aside><p>End &#233;&lt;</p></article><section id=comments><p>" + "reply " * 60 + "</p></section>", "Text.\n\nEnd é<"),
    "short": ("<p>hi <i>there</i></p>", "hi there"),
    "unclosed advert": ("<div class=ad><article><p>kept</p></article>", "kept"),
    "text only": ("a < b and <3 c", "a < b and <3 c"),
}


def test_extraction(spark, sf_dir):
    rows = [(i, None if i % 2 else "u", h, 1) for i, (h, _) in enumerate(PAGES.values())]
    got = {r.page_id: r for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    for i, (name, (_, want)) in enumerate(PAGES.items()):
        assert (got[i].text, got[i].n_chars) == (want, len(want)), name
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extraction_of_the_tables_pages(spark, sf_dir):
    """Against a plain reading of this table's one template."""
    import html
    import re

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r.html, re.S)[1].replace("<br>", "\n")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert html_text.extract(r.html) == "\n\n".join(b for b in blocks if b)


UNENDED = {
    "p": ('<article><p class="notice">Ad<p>Real text</p><p>More</p></article>', "Real text\n\nMore"),
    "p before another block": ('<article><p class="ad">Ad <b>now<div>Real text</div><p>More</article>', "Real text\n\nMore"),
    "li": ('<article><ul><li class="ad">Ad<li>Real item<li>Next</ul><p>Text</p></article>', "Real item\n\nNext\n\nText"),
    "last li": ('<article><ul><li>Item<li class="ad">Ad<ul><li>in it</ul></ul><p>Text</p></article>', "Item\n\nText"),
    "dt and dd": ('<article><dl><dt class="ad">Ad<dd>Real<dt>Term<dd class="ad">Ad</dl>Text</article>', "Real\n\nTerm\n\nText"),
    "cells and rows": ('<article><table><tr><td class="ad">Ad<td>A<tr class="ad"><td>Ad<td>Ad<tr><td>B<td class="ad">Ad</table>Text</article>', "A\n\nB\n\nText"),
    "div": ('<article><section><div class="ad">Ad</section><p>Text</p></article>', "Text"),
    "end of the article": ("<article><p>Text</p></article><main><aside>Side</main><article><p>More</p></article>", "Text\n\nMore"),
    "span": ('<article><p>One <span class="ad">Ad</p><p>Two</p></article>', "One\n\nTwo"),
    "head": ("<html><head><title>T</title><meta name=a><body><div>" + "word " * 20 + "</div></body></html>", ("word " * 20).strip()),
    "nested, ended": ('<article><div class="ad">Ad<div>Ad<p>Ad<p>Ad</div><script>"</div>"</script>Ad</div>Text</article>', "Text"),
    "an end tag in a cell": ('<article><div class="ad"><table><tr><td>Ad</div>Ad</table>Ad</div>Text</article>', "Text"),
    "a form across cells": ("<article><table><tr><td><form>Name</table></form><p>Text</article>", "Text"),
    "a template": ("<article><template><article><p>No</article></template><p>Text</article>", "Text"),
}


@pytest.mark.parametrize("name", UNENDED)
def test_extraction_where_end_tags_are_left_out(name):
    page, want = UNENDED[name]
    assert html_text.extract(page) == want


WORDS = ("word " * 20).strip()
WHOLE = {
    "ids of sections and headings": (
        '<article><section id="related-work"><h2 id="search-algorithms">Search</h2><p>A</p></section><section id="search"><h2 id="related">Related</h2><p>B</p></section><div id="ad-hoc-networks">C</div></article>',
        "Search\n\nA\n\nRelated\n\nB\n\nC",
    ),
    "heading outside an article": (f'<h2 id="search">{WORDS}</h2><p>{WORDS}</p>', f"{WORDS}\n\n{WORDS}"),
    "layout": (f'<div class="layout has-sidebar"><p>{WORDS}</p><div class="sidebar">{WORDS}</div></div>', WORDS),
    "layout with a modifier": (f'<div class="page--with-sidebar"><p>{WORDS}</p></div>', WORDS),
    "figure and fieldset": ("<article><figure><pre>code</pre><figcaption>Caption</figcaption></figure><fieldset><legend>L</legend>Field</fieldset><table><tr><td>cell</table></article>", "code\n\nCaption\n\nLField\n\ncell"),
    "links between surge and dive": (f"<div><p>{WORDS}</p><p>See <a href=a>this long linked reference</a></p><p><a href=b>linked</a></p><p>{WORDS}</p><p><a href=c>after</a></p></div>", f"{WORDS}\n\nSee this long linked reference\n\nlinked\n\n{WORDS}"),
    "still boilerplate": (
        f'<div class="main-menu">{WORDS}</div><div id="sidebar-2">{WORDS}</div><div class="x cookie_notice">{WORDS}</div><div class="header__nav">{WORDS}</div><div class="comments-area">{WORDS}</div><div class="sidebar--wide">{WORDS}</div><div class="ad_slot_3">{WORDS}</div><div class="related-posts">{WORDS}</div><p>Text {WORDS}</p>',
        f"Text {WORDS}",
    ),
}


@pytest.mark.parametrize("name", WHOLE)
def test_extraction_drops_nothing_else(name):
    page, want = WHOLE[name]
    assert html_text.extract(page) == want


def test_line_blocks_surge_and_dive():
    line = lambda n, linked=0: html_text.Line("x" * n, linked)
    lines = [line(10, 10), line(8, 8), line(200), line(3), line(90), line(12, 12), line(9, 9), line(7, 7), line(100), line(5)]
    assert [len(x.text) for x in html_text.main_lines(lines)] == [200, 3, 90, 100, 5]
    assert [len(x.text) for x in html_text.main_lines([line(4, 4), line(5), line(300), line(1)])] == [5, 300, 1]
    assert html_text.main_lines([line(20), line(20), line(20)]) == []


def brute_blocks(size):
    """By definition: cut at windows without text; of a surge all that follows up to the cut, and the text lines that lead up to it."""
    w, n, kept = html_text.WINDOW_LINES, len(size), set()
    for i in range(n):
        if size[i] and sum(size[i : i + w]) >= html_text.SURGE:
            stop = next((k for k in range(i, n) if not any(size[k : k + w])), n)
            kept |= set(range(i, stop))
            k = i
            while k and size[k - 1] and k - 1 not in kept:
                k -= 1
                kept.add(k)
    return sorted(kept)


def test_line_blocks_against_the_definition():
    r = random.Random(8)
    for _ in range(3000):
        size = [r.choice((0, 0, r.randint(1, 30), r.randint(20, 120))) for _ in range(r.randint(0, 25))]
        lines = [html_text.Line(f"{i}:".ljust(10, "x") + "y" * s, 10) for i, s in enumerate(size)]
        assert [int(x.text.split(":")[0]) for x in html_text.main_lines(lines)] == brute_blocks(size)


@pytest.mark.parametrize("part", ['<b c="', "<b c='x\" ", "<!-- ", "<a <b =", "<div class=ad><article>", "&amp; x <script>", "<p>x</p><a href=x>", "</div>"])
def test_extraction_of_odd_markup_takes_linear_time(part):
    started = time.monotonic()
    html_text.extract("<p>hello</p>" + part * (1_000_000 // len(part)))
    assert time.monotonic() - started < 20


def test_a_tag_with_an_open_quote_ends_with_the_page():
    assert html_text.extract('<p>kept</p><b title="no end>lost') == "kept"
    assert html_text.extract('<p>one <b title="a>b">two</b></p><i "x>three</i>') == "one two\n\nthree"
