"""Exact top-k search, HTML extraction, personal data."""

import datetime
import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import html_extract as H
from millrace.llm import pii, topk


def brute_topk(vectors, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard_rows", "block_queries", "leaf"), [(40, 7, 8), (1000, 1000, 256), (25, 1000, 4)])
def test_top_k_matches_brute_force(spark, monkeypatch, shard_rows, block_queries, leaf):
    monkeypatch.setattr(topk, "LEAF", leaf)
    rng = np.random.default_rng(3)
    rows = [(int(i), [int(x) for x in rng.integers(-60, 60, 6)]) for i in range(150)]
    rows += [(1000 + i, [5, 5, 5, 5, 5, 5]) for i in range(60)] + [(7, rows[3][1]), (8, [1, 2])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    ask = [(i, v) for i, v in rows[:150:10]] + [(1000, [5] * 6), (5000, [-1] * 6)]
    got = topk.top_k(vectors, spark.createDataFrame(ask, "query_id long, v array<long>"), 20, shard_rows=shard_rows, block_queries=block_queries, task_queries=block_queries)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_topk(rows, ask, 20)


def test_top_k_edges(spark):
    rows = [(0, [0.5, -0.1], 1), (20, None, 1), (40, [float("nan"), 1.0], 1), (60, [None, 1.0], 1), (None, [1.0, 1.0], 1), (3, [0.25, 0.25], 1), (3, [0.25, 0.25], 1), (0, [0.6, 0.0], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    vectors = topk.integer_vectors(frame)
    assert sorted((r.vec_id, r.v) for r in vectors.collect()) == [(0, [32, -7]), (0, [38, 0]), (3, [16, 16]), (3, [16, 16])]
    got = topk.top_k(vectors, topk.ask(vectors, F.col("vec_id") % 20 == 0), 20).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got)] == [(0, 1, 3, 400), (0, 2, 3, 400)]
    none = vectors.limit(0)
    assert topk.top_k(none, topk.ask(none, F.lit(True)), 3).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="main-17" class="content c12"><h1>Title &amp; more</h1><p>First   <b>bo</b>ld&nbsp;text<br>after<p>Second &eacute;
<!-- <p>no --><div class="ad">Buy</div><ul><li>one<li>two</ul><form><p>mail</p></form><blockquote>said</blockquote>
<section class="comments"><p>nice post, thank you very much for all of this text</p></section></div><aside>side</aside><footer>&copy; me</footer></body></html>"""


def test_extract_one_page():
    assert H.extract(PAGE, None) == "Title & more First bold text after Second é one two said"
    assert H.extract(None, None) == H.extract("", ["html>body"]) == H.extract("<p></p><!-- x", None) == ""
    assert H.extract("just text &lt;b&gt;", None) == "just text <b>"
    assert H.extract("<article>a<script>x", None) == "a"
    assert H.extract('<html><head><meta charset="x"><body><p>no head end</p>', None) == "no head end"
    assert H.extract("<div><p>" + "long words " * 200_000, None).count("words") == 200_000


def test_host_consensus_overrules_one_page(spark):
    good = '<html><body><div class="post p{}"><p>{}</p></div><div class="blurb"><p>{}</p></div></body></html>'
    rows = [(i, f"http://h.example/{i}", good.format(i, "article text " * 9, "blurb")) for i in range(9)]
    rows.append((9, "http://H.example/9", good.format(9, "short article", "a very long blurb that would win alone " * 9)))
    rows += [(10, "http://other.example/", good.format(1, "x", "a very long blurb")), (11, None, None), (12, "http://h.example", ""), (13, None, "<p>no host")]
    pages = spark.createDataFrame([(a, b, c, "old") for a, b, c in rows + rows[:1]], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in H.main_text(pages).collect()}
    assert len(got) == 14 and got[9] == "short article" and got[0] == ("article text " * 9).strip() and got[10] == "a very long blurb" and got[11] == got[12] == "" and got[13] == "no host"
    assert H.main_text(pages.limit(0)).count() == 0


def test_pages_of_the_test_tables(spark, data):
    rows = H.op5_html_consensus(spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and r.n_chars for r in rows)
    assert not any("track(" in r.text or "©" in r.text for r in rows)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


TEXT = "mail bob.smith+1@mail.example.com or +1 (212) 555-0199, 212-555-0199, +49 30 1234567; card 4111 1111 1111 1111 = 4111111111111111 = 4111-1111-1111-1111 not 4111111111111112; born 1980-02-29, 29.02.1980, 2/29/1980 and 1981-02-29; ip 10.0.0.1 not 256.1.1.1; ssn 123-45-6789 not 000-12-3456; GB82 WEST 1234 5698 7654 32"


def test_pseudonyms_keep_formats_and_links(spark):
    docs = spark.createDataFrame([(1, TEXT, "n"), (2, "again 4111111111111111", "n"), (3, None, "n"), (4, "", "n"), (5, "plain 12 text", None), (2, "again 4111111111111111", "n")], "doc_id long, text string, n_values string")
    rows = pii.pseudonymise(docs, "key").collect()
    by = {r.doc_id: r for r in rows}
    new = by[1].text
    assert len(rows) == 6 and by[3].text is None and by[3].n_values == 0 and by[4].text == "" and by[5].text == "plain 12 text" and by[5].n_values == 0
    cards = re.findall(r"card (\S+ \S+ \S+ \S+) = (\S+) = (\S+) not (\S+);", new)[0]
    assert len({re.sub(r"\D", "", c) for c in cards[:3]}) == 1 and luhn(re.sub(r"\D", "", cards[0])) and cards[3] == "4111111111111112" and "4111111111111111" not in cards[1]
    assert by[2].text == f"again {cards[1]}" and by[2].n_values == 1
    iso, dotted, slashed = re.findall(r"born (\S+), (\S+), (\S+) and 1981-02-29", new)[0]
    day = datetime.date.fromisoformat(iso)
    assert dotted == day.strftime("%d.%m.%Y") and [int(x) for x in slashed.split("/")] == [day.month, day.day, day.year] and iso != "1980-02-29"
    assert re.search(r"mail [a-z]{3}\.[a-z]{5}\+\d@mail\.example\.com or \+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}, [2-9]\d\d-[2-9]\d\d-\d{4}, \+49 \d\d \d{7};", new)
    area, rest = re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4})", new).groups()
    assert f"{area}-{rest}," in new.split(") ", 1)[1]
    assert "not 256.1.1.1" in new and "not 000-12-3456" in new and "10.0.0.1" not in new and "123-45-6789" not in new
    iban = re.search(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", new).group().replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and by[1].n_values == 13
    other = {r.doc_id: r.text for r in pii.pseudonymise(docs, "other key").collect()}
    assert other[1] != new and pii.pseudonymise(docs.limit(0), "key").count() == 0


def test_feistel_is_a_permutation(spark):
    rows = spark.range(189 * 7).select(pii.permute(F.col("id"), 189, 7, "k", "t").alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(189 * 7))
    two = spark.range(1000).select(pii.permute_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("p")).collect()
    assert sorted(r.p for r in two) == [f"{i:03}" for i in range(1000)]


def test_pseudonyms_need_no_python(spark, data):
    plan = pii.op8_pii_feistel(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_noise_inside_paragraphs_and_whole_class_names():
    page = '<article><p>a <span class="ad">Buy <b>now</b></span> c <a class="x" href="/">d</a></p><div class="social-policy">e</div><div class="banner-story">f</div><div class="share-prices">g</div>'
    assert H.extract(page + '<div class="cookie-banner">no</div><div id="adSlot2">no</div><p class="site_footer">no</p></article>', None) == "a c d e f g"
    assert H.extract('<p>a <i hidden>no</i> b <span class="ad">open till the block ends</p><p>c</p>', None) == "a b c"


@pytest.mark.parametrize("page", ["<a " * 300_000, '<a "' * 200_000, '<a ">" ' * 100_000 + '"', "<div>" * 200_000 + "x", "<ul>" + "<x>" * 50_000 + "<li>a</li>" * 50_000, "<div>" * 50_000 + "</p>" * 50_000, "<b class=ad>" * 60_000 + "</i>" * 60_000, "<!--" * 200_000, "<" * 1_000_000])
def test_hostile_pages_take_linear_time(page):
    start = time.perf_counter()
    H.extract(page, None)
    assert time.perf_counter() - start < 20


def test_ties_between_containers_and_votes(spark):
    two = "<div class=b><p>same</p></div><div class=a><p>size</p></div>"
    assert H.extract(two, None) == "size"  # by name
    pages = spark.createDataFrame([(1, "http://h/1", "<div class=b><p>one</p></div>"), (2, "http://h/2", "<div class=a><p>two</p></div>")], "page_id long, url string, html string")
    assert {r.vote_host: r.winners for r in H.winning_paths(pages).collect()} == {"h": [">div.a", ">div.b"]}


def test_mixed_pages_against_their_parts(spark):
    """Pages put together from known parts: the articles' texts come back, whatever stands around and inside them."""
    rng = random.Random(7)
    inline = ["<b>{}</b>", "<a href='/x'>{}</a>", "{}", "<span class='lead'>{}</span>"]
    noise = ["<aside>side</aside>", '<div class="ad">buy</div>', "<nav><a>home</a></nav>", '<span class="promo">deal</span>', "<script>if (a < b) {}</script>", "<!-- note -->", '<form><input><p>mail</p></form>', '<section class="comment-list"><p>nice</p></section>']
    rows, want = [], {}
    for i in range(60):
        host, blocks, texts = f"h{i % 3}", [], []
        for _ in range(rng.randint(3, 9)):
            words = [f"w{rng.randint(0, 999)}" for _ in range(rng.randint(5, 30))]
            texts.append(" ".join(words))
            blocks.append("<p>" + " \n".join(rng.choice(inline).format(w) if rng.random() < 0.1 else w for w in words) + (rng.choice(noise[3:4] + [""])) + "</p>" + (rng.choice(noise) if rng.random() < 0.4 else ""))
        open_, close = [("<article>", "</article>"), ('<div class="post p7">', "</div>"), ("<main><section>", "</section></main>")][i % 3]
        rows.append((i, f"http://{host}/{i}", f"<html><head><title>t</title></head><body><header>top</header>{open_}{''.join(blocks)}{close}<footer>end</footer></body></html>"))
        want[i] = " ".join(texts)
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def plain_draw(key, kind, turn, half):
    return int(hashlib.sha256(f"{key}|{kind}|{turn}|{half}".encode()).hexdigest()[:15], 16)


def plain_permute(x, a, b, key, kind):
    left, right = divmod(x, b)
    for i in range(1, 9):
        if i % 2:
            left = (left + plain_draw(key, kind, i, right)) % a
        else:
            right = (right + plain_draw(key, kind, i, left)) % b
    return left * b + right


def plain_permute_text(value, key, kind):
    left, right = value[: len(value) // 2], value[len(value) // 2 :]

    def shift(half, other, turn):
        digest = hashlib.sha256(f"{key}|{kind}|{turn}|{other}".encode()).hexdigest()
        out = ""
        for j, c in enumerate(half):
            n = int(hashlib.sha256(f"{digest}|{j}".encode()).hexdigest()[:15], 16)
            for base, size in ((48, 10), (97, 26), (65, 26)):
                if base <= ord(c) < base + size:
                    c = chr(base + (ord(c) - base + n) % size)
                    break
            out += c
        return out

    for i in range(1, 9):
        if i % 2:
            right = shift(right, left, i)
        else:
            left = shift(left, right, i)
    return left + right


def test_pseudonyms_match_a_plain_feistel(spark):
    rng, rows, want = random.Random(5), [], {}
    for i in range(120):
        user = "".join(rng.choice("abcXYZ019._%+-") for _ in range(rng.randint(1, 40)))
        day = datetime.date(1800, 1, 1) + datetime.timedelta(rng.randrange(146_097))
        octets = [rng.randrange(256) for _ in range(4)]
        area, group, serial = rng.choice([*range(1, 666), *range(667, 900)]), rng.randint(1, 99), rng.randint(1, 9999)
        body = str(rng.randint(4 * 10**14, 5 * 10**14))
        card = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        rows.append((i, f"{user}@mail.example.org / {'.'.join(map(str, octets))} / {day} / {area:03}-{group:02}-{serial:04} / {card}"))
        number = int.from_bytes(bytes(octets), "big")
        address = plain_permute(number, 65536, 65536, "k", "ipv4").to_bytes(4, "big")
        date = datetime.date(1800, 1, 1) + datetime.timedelta(plain_permute((day - datetime.date(1800, 1, 1)).days, 189, 773, "k", "date"))
        person = plain_permute(((area - (2 if area > 666 else 1)) * 99 + group - 1) * 9999 + serial - 1, 88_902, 9_999, "k", "ssn")
        index, rest = divmod(person, 99 * 9999)
        new = card[0] + plain_permute_text(card[1:-1], "k", "card")
        new = next(new + str(d) for d in range(10) if luhn(new + str(d)))
        want[i] = f"{plain_permute_text(user, 'k', 'email')}@mail.example.org / {'.'.join(map(str, address))} / {date} / {index + (2 if index >= 665 else 1):03}-{rest // 9999 + 1:02}-{rest % 9999 + 1:04} / {new}"
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_values == 5 for r in got)


def test_long_texts_of_every_shape_are_pseudonymised(spark):
    shapes = ["a@" + "a." * 500_000, "a." * 500_000 + "@x.org", "x" * 1_000_000 + "@x.org", "a@a" * 300_000, "+2" * 500_000, "+22222222222222" * 60_000, "1" * 1_000_000, "1.1." * 250_000, "1234-" * 200_000, "GB82 " + "WEST " * 200_000, "1/1/" * 250_000, "(212) " * 160_000, "bob@mail.example.com " * 2_000]
    docs = spark.createDataFrame(list(enumerate(shapes)), "doc_id long, text string").repartition(4)
    start = time.perf_counter()
    rows = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    assert len(rows) == len(shapes) and time.perf_counter() - start < 120
    assert all(len(rows[i].text) == len(t) for i, t in enumerate(shapes)) and rows[len(shapes) - 1].n_values == 2_000 and rows[2].n_values == 1 and rows[2].text != shapes[2]


def test_top_k_beyond_double_precision(spark):
    """Sums above 2**53 are exact, sums up to a long's range are found, and what a long can't hold is an error."""
    big = 2**26
    rows = [(i, [big, big, i, 1]) for i in range(60)] + [(100 + i, [2**30, -(2**30) + i, 1, 0]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    ask = [(900, [2**28, 1, 1, -3]), (901, [-(2**31), 2**31 - 1, 7, 7])]
    got = topk.top_k(vectors, spark.createDataFrame(ask, "query_id long, v array<long>"), 20, shard_rows=30)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_topk(rows, ask, 20)
    edge = spark.createDataFrame([(1, [2**61, 2**61]), (2, [2**61, 2**61 - 1])], "vec_id long, v array<long>")
    one = spark.createDataFrame([(900, [1, 2])], "query_id long, v array<long>")
    assert [(r.vec_id, r.score) for r in topk.top_k(edge, one, 20).orderBy("rank").collect()] == [(1, 3 * 2**61), (2, 3 * 2**61 - 2)]
    with pytest.raises(Exception, match="more than 64 bits"):
        topk.top_k(edge, spark.createDataFrame([(900, [2, 2])], "query_id long, v array<long>"), 20).count()
    with pytest.raises(Exception, match="more than 62 bits"):
        topk.integer_vectors(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>")).collect()
    wide = spark.createDataFrame([(20 * i, [1e9, float(i)]) for i in range(2)] + [(i, [1e6, float(i)]) for i in range(1, 9)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="more than 64 bits"):
        topk.top_k(topk.integer_vectors(wide), topk.ask(topk.integer_vectors(wide), F.col("vec_id") % 20 == 0), 20).count()


def boxed(cells, rows, of):
    """Cells with the boxes and shards of the rows, one shard each."""
    v = np.array([v for _, v in rows])
    cells.numbers = np.unique(of)
    cells.low, cells.high = (np.array([f(v[of == c], 0) for c in cells.numbers], float) for f in (np.min, np.max))
    cells.shards = dict.fromkeys(cells.numbers.tolist(), 1)
    return cells


def test_cells_leave_shards_out(spark):
    """Clustered vectors: a query goes to the cells that its kth score lets it, and the result is that of all pairs."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-2000, 2000, (12, 5))
    rows = [(i, [int(x) for x in centres[i % 12] + rng.integers(-9, 9, 5)]) for i in range(1200)]
    ask = [(5000 + i, [int(x) for x in centres[i % 12]]) for i in range(24)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(vectors, spark.createDataFrame(ask, "query_id long, v array<long>"), 20, shard_rows=60)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_topk(rows, ask, 20)
    cells = topk.Cells(np.array([v for _, v in rows]), 20)
    of = cells.of(np.array([v for _, v in rows]))
    assert len(np.unique(of)) == 20 and np.bincount(of).max() <= 150
    where = topk._elsewhere(boxed(cells, rows, of), 1)
    asked = next(topk._home(boxed(cells, rows, of), 1)(iter([pa.record_batch([pa.array([i for i, _ in ask]), pa.array([v for _, v in ask])], names=["query_id", "v"])])))
    kth = [sorted((sum(a * b for a, b in zip(v, w, strict=True)) for _, w in rows), reverse=True)[19] for _, v in ask]
    sent = sum(b.num_rows for b in where(iter([asked.set_column(5, "kth", pa.array(kth, pa.int64()))])))
    assert sent < len(ask) * 19 / 2


def test_cells_of_equal_rows():
    same = topk.Cells(np.full((50, 3), 7), 8)
    assert (same.of(np.array([[7, 7, 7], [0, 0, 0]])) == 0).all()
    two = topk.Cells(np.array([[0, 1]] * 30 + [[5, 1]]), 8)
    assert len(set(two.of(np.array([[0, 1], [5, 1]])).tolist())) == 2


def test_top_k_of_one_hot_vector(spark):
    """A vector that a third of the rows share, in several shards of one cell; ties go to the smaller id."""
    rows = [(i, [3, 4]) for i in range(300)] + [(1000 + i, [i, -i]) for i in range(40)]
    ask = [(0, [3, 4]), (20, [3, 4]), (9999, [-1, 0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(4), spark.createDataFrame(ask, "query_id long, v array<long>"), 20, shard_rows=32)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_topk(rows, ask, 20)


def test_class_names_of_noise():
    for name in ("sponsored-post", "article-ad", "promo-message", "cookie-policy-banner", "reader-comments", "postComments", "ad_slot_2", "cookie-banner", "entryFooter"):
        assert H.is_noise(name), name
    for name in ("banner-story", "share-prices", "content", "post", "article-header", "entry-content", "comment-piece", "news-alert", "adverse-effects", "main"):
        assert not H.is_noise(name), name


def test_leads_and_titles_around_the_winner():
    body = "<p>" + "article words " * 9 + "</p>"
    words = ("article words " * 9).strip()
    assert H.extract(f'<html><body><p>site</p><main><h1>Title</h1><p>Lead</p><div class="body">{body}</div><p>Last</p></main></body></html>', None) == f"Title Lead {words} Last"
    assert H.extract(f'<html><body><article><h1>Title</h1><section><div class="x">{body}</div></section></article></body></html>', None) == f"Title {words}"
    assert H.extract(f'<html><body><main><p><a href="/">All our stories in one list</a></p><div class="body">{body}</div></main></body></html>', None) == words
    assert H.extract(f'<html><body><p>site</p><div class="body">{body}</div></body></html>', None) == words


def test_hosts_vote_on_noise_of_any_name(spark):
    """A notice of an unknown class and a slogan beside the article are the host's; leads and boxes that differ from page to page stay."""
    page = '<html><body><div class="shell"><p>We print since 1901</p><h1>Title {0}</h1><div class="story"><p>{1}</p><div class="zz-plonk"><p>Read our terms of use before you go on</p></div><div class="box"><p>Fact {0}</p></div><p>end {0}</p></div></div></body></html>'
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, f"http://h.example/{i}", page.format(i, words(i))) for i in range(8)]
    rows += [(100 + i, "http://copies.example/", page.format(1, words(1))) for i in range(8)]  # one page many times: one vote
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, noise string")).collect()}
    assert all(got[i] == f"Title {i} {words(i)} Fact {i} end {i}" for i in range(8))
    whole = f"We print since 1901 Title 1 {words(1)} Read our terms of use before you go on Fact 1 end 1"
    assert all(got[100 + i] == whole for i in range(8))


def test_many_inner_containers_in_linear_time():
    page = "<html><body><article>" + "".join(f'<div class="c{"x" * (i % 50)}"><p>text {i}</p></div>' for i in range(20_000)) + "</article></body></html>"
    start = time.perf_counter()
    assert H.extract(page, None).endswith("text 19999") and time.perf_counter() - start < 5
