"""Archives, main text, packing, sharding, decontamination and the classifier, against brute force or exactly."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from tidemark.llm import decontaminate as D
from tidemark.llm import html_text as H
from tidemark.llm import packing as P
from tidemark.llm import quality as Q
from tidemark.llm import sharding as R
from tidemark.llm import warc as A
from tidemark.llm.shared import new_folder

PAGES = "page_id long, url string, html string, key string, first string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", "f") for r in rows], PAGES)


def test_archives_round_trip(spark):
    given = [(5, "u", "<p>a"), (3, "http://x/é?q=1%20\n", "<p>a"), (None, None, "<p>a"), (3, "http://x/é?q=1%20\n", "<p>a"), (9, "é", None),
             (10, "x", ""), (11, "z", "q" * 100_000), (12, "z", "\r\n\r\nContent-Length: 7\r\n")]
    folder = new_folder(spark, "warc-test")
    manifest = A.write_archives(pages(spark, given), folder, shard_bytes=4, roll_bytes=300)
    got = A.read_archives(manifest, folder).collect()
    assert manifest.count() > 3 and len(got) == len(given)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((str(r.page_id), r.url, r.payload_bytes, r.payload_digest) for r in got if r.url) == sorted(
        (str(i), u, len((h or "").encode()), digest(h)) for i, u, h in given if u)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == [("10", "revisit", 9), ("11", "response", None), ("12", "response", None), ("3", "response", None), ("3", "revisit", 3),
                     ("5", "revisit", 3), ("9", "response", None), ("None", "revisit", 3)]


def test_archives_are_the_same_bytes_again(spark):
    rows = pages(spark, [(i, f"u{i}", "x" * (i % 50)) for i in range(300)])
    sums = []
    for parts in (1, 7):
        folder = new_folder(spark, "warc-test")
        sums.append(sorted(tuple(r) for r in A.write_archives(rows.repartition(parts), folder, shard_bytes=1000, roll_bytes=9000).collect()))
    assert sums[0] == sums[1]


def test_no_pages_no_files(spark):
    folder = new_folder(spark, "warc-test")
    assert A.read_archives(A.write_archives(pages(spark, []), folder), folder).count() == 0


def test_a_damaged_record_is_an_error():
    data = zlib.decompress(A.page_record(1, "u", b"payload", None, A.DATE), 31)
    with pytest.raises(ValueError):
        A.parsed(data.replace(b"payload", b"PAYLOAD"))


PAGE = """<html><body class="has-sidebar"><div id="header">Logo of the site</div><ul class="menu"><li><a href=x>Home</a><li><a>About us</a></ul>
<div class="cookie-notice">We use cookies to do things and more of them all day.</div>{open}<h2>Title&amp;here</h2>
<p>Long text   of an article that goes on and on, with many words in it to read.<p>Short.<aside>A side</aside>
<p>Another long paragraph with &eacute; and <b>bold</b><br>words that go on for a while.</p><script>var a = "<p>no</p>";</script>{close}
<div class="comments"><p>Nice article, thanks a lot for writing all of this down!</p></div><form><p>Your name</p></form><div id="footer">&copy;</div>"""
TEXT = ("Title&here\n\nLong text of an article that goes on and on, with many words in it to read.\n\nShort.\n\n"
        "Another long paragraph with é and bold words that go on for a while.")


@pytest.mark.parametrize(("open_", "close"), [
    ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("<article><header>", "</header></article>"),
])
def test_main_text(open_, close):
    assert H.main_text(PAGE.format(open=open_, close=close)) == TEXT


def prose(word, size):
    return (f"{word} " * size)[:size].strip()


def test_no_paragraph_is_lost_to_a_longer_one():
    long, short = prose("long", 800), prose("short", 150)
    assert H.main_text(f"<div><p>{long}</p><p>{short}</p></div>") == f"{long}\n\n{short}"
    menu = "".join(f"<li><a href=x>Item {i}</a></li>" for i in range(20))
    given = [*[prose(f"a{i}", 150) for i in range(6)], prose("huge", 20_000), *[prose(f"b{i}", 150) for i in range(6)]]
    page = f"<ul class=menu>{menu}</ul><div>{''.join(f'<p>{x}</p>' for x in given)}</div>"
    assert H.main_text(page) == "\n\n".join(given)


def test_chosen_lines_outside_the_best_article_stay():
    a, b, c = prose("first", 400), prose("second", 600), prose("third", 500)
    page = f"<article><p>{a}</p></article><article><h2>Head</h2><p>{b}</p></article><div class=ad><p>{prose('ad', 300)}</p></div>"
    assert H.main_text(page) == f"{a}\n\nHead\n\n{b}"
    teaser = f"<article><p>{a}</p></article><div><p>{b}</p><p>Short.</p><p>{c}</p></div><footer><p>{prose('foot', 300)}</p></footer>"
    assert H.main_text(teaser) == f"{a}\n\n{b}\n\nShort.\n\n{c}"


@pytest.mark.parametrize("wrap", [
    '<div class="layout with-sidebar">{}</div>', '<div id="no-comments">{}</div>', "<form action=x>{}</form>",
    '<form><div class="has-sidebar"><section id="page-header">{}</section></div></form>', '<body hidden style="display: none">{}</body>',
])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_marks_on_wrappers_do_not_count(wrap, tag):
    a, b = prose("one", 400), prose("two", 120)
    inner = f"<div class=sidebar><p>{prose('side', 90)}</p></div><{tag}><p>{a}</p><p>{b}</p></{tag}><div class=comments><p>{prose('nice', 90)}</p></div>"
    assert H.main_text(wrap.format(inner)) == f"{a}\n\n{b}"


def test_marks_on_boxes_of_small_articles_count():
    a, b = prose("one", 400), prose("two", 300)
    small = f"<article><p>{prose('small', 100)}</p></article>"
    page = f"<article><p>{a}</p><p>{b}</p></article><div class=related>{small}</div><aside>{small}</aside><template><article><p>{a}</p></article></template>"
    assert H.main_text(page) == f"{a}\n\n{b}"
    assert H.main_text(f"<nav><article><p>{a}</p></article></nav>") == a


def test_odd_pages(spark):
    assert [H.main_text(x) for x in (None, "", "<p", "just text", "<article><p>One.</p></article><p")] == ["", "", "", "just text", "One."]
    got = H.extract(pages(spark, [(1, "u", None), (1, "u", "<article>é b"), (None, None, "<nav>x</nav>")])).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "", 0), ("1", "é b", 3), ("None", "", 0)]


def test_smoothing_keeps_a_constant():
    assert np.allclose(H.smoothed(np.full(9, 5.0)), 5.0)


def test_packing(spark):
    text = "Some words, don't 12 é\n\n 日本 "
    given = [(1, None), (1, ""), (None, text), (4, text * 400), (4, text * 400), (6, "<|endoftext|> x")] + [(10 + i, text * (i % 60)) for i in range(300)]
    df = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "0 AS length", "0 AS IDS", "0 AS sequence_id")
    pieces = P.tokenize(df, P.vocabulary())
    tokens = P.tokens_of(P.vocabulary())
    whole = {}
    for r in pieces.collect():
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == r.length <= P.LENGTH
        whole.setdefault(r.doc_id, set()).add((r.piece, r.start, tuple(ids)))
    for doc_id, t in given:
        ids = [*tokens.exact(t or ""), 2]
        joined = sum((list(x) for _, _, x in sorted(whole[doc_id])), [])
        assert joined == ids
    packed = P.pack(pieces.drop("ids"), group=100).collect()
    assert len(packed) == pieces.count()
    at = {}
    for r in packed:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in at.values():
        spans.sort()
        assert [a for a, _ in spans] == np.cumsum([0] + [n for _, n in spans])[:-1].tolist() and sum(spans[-1]) <= P.LENGTH
    assert len(at) <= 1.03 * sum(r.length for r in packed) / P.LENGTH + 4
    assert P.pack(P.tokenize(df.limit(0), P.vocabulary()).drop("ids")).count() == 0


def test_sum_of_squares_places_each_item_once():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 2000):
        sizes = rng.integers(1, 1024, n)
        bins = P.sum_of_squares(sizes, 1024)
        assert sorted(i for b in bins for i in b) == list(range(n))
        assert all(sizes[b].sum() <= 1024 for b in bins)


def test_sharding(spark):
    given = [(i, "é" * (i % 5)) for i in range(3000)] + [(None, None), (None, None), (7, "x")]
    df = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "0 AS shard", "0 AS SIZE", "0 AS slot")
    got = R.assign(df).collect()
    assert len(got) == len(given)
    for shard in range(8):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given}
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert all(300 < sum(r.shard == s for r in got) < 450 for s in range(8))
    heavy = R.assign(df, shards={0: 1.0, 1: 3.0}).groupBy("shard").count().collect()
    assert 2.5 < {r.shard: r["count"] for r in heavy}[1] / {r.shard: r["count"] for r in heavy}[0] < 3.5
    assert R.assign(df.limit(0)).count() == 0


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "short Item, here"), (3, None), (4, "!!"),
         (5, "a a a a a a a a a a a a a a a a"), (1, "again here"), (None, "no id but words"), (6, "single")]


@pytest.mark.parametrize("block_bytes", [40, 1 << 20])
def test_decontamination(spark, block_bytes):
    one = ITEMS[0][1].upper()
    texts = [None, "", "x " + one + " y", "short item\nhere", "short item x here", "a " * 40, "b " * 12 + "a " * 13, "é again HERE é", "x single-y", one[:60],
             one.replace("SEVEN", "x"), "z " * 3000 + one, "no id but words"]
    docs = spark.createDataFrame([(i % 9, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "0 AS spans", "0 AS TEXT")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.decontaminate(docs, items, block_bytes).collect()
    named = [(str(i) if i is not None else "null", t) for i, t in ITEMS if t]
    want = [(i % 9, *D.brute(t, named)) for i, t in enumerate(texts)]
    digest = lambda items: hashlib.sha256(",".join(items).encode()).hexdigest()
    assert sorted((r.doc_id, r.n_words, r.n_hit, digest(r["items"])) for r in got) == sorted(want)
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)
    kept = D.keep_clean(docs, items, block_bytes)
    assert kept.columns == docs.columns and kept.count() == sum(not r.contaminated for r in got)
    assert D.decontaminate(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert D.decontaminate(docs.limit(0), items).count() == 0


def test_features_do_not_depend_on_the_block():
    texts = [b"One two, two!! three\n4x", b"", b"   ", b"One two, two!! three\n4x", "é ".encode() * 9]
    alone = [v for t in texts for v in Q.vectors([t], 12)]
    for (a, v), (b, w) in zip(alone, Q.vectors(texts, 12), strict=True):
        assert (a == b).all() and np.allclose(v, w)
    assert len(alone[1][0]) == 1 and np.isclose((alone[0][1][:-1] ** 2).sum(), 1)


def test_classifier(spark):
    rng = np.random.default_rng(1)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 300, n)]
    texts = [(" ".join(words(60)), 1) if i % 3 else (" ".join(w.upper() + "!!" for w in words(60)), 0) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(None, None), (2000, ""), (2000, "")], "doc_id long, text string")
    docs = docs.selectExpr("*", "0 AS score", "0 AS LABEL", "'en' AS lang")
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(texts)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = Q.classify(docs, labels, bits=14, parts=2).collect()
    assert len(got) == 903
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(r.predicted == texts[r.doc_id][1] for r in held) > 0.98 * len(held)
    kept = Q.keep_good(docs, labels, bits=14, parts=2)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    # labels of held-out rows change nothing
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(string(doc_id) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    again = {(r.doc_id, r.score) for r in Q.classify(docs, turned, bits=14, parts=2).collect()}
    assert again == {(r.doc_id, r.score) for r in got}
    nothing = Q.classify(docs, labels.limit(0), bits=10).collect()
    assert {(r.score, r.predicted) for r in nothing} == {(0.5, 1)}
    assert Q.classify(docs.limit(0), labels.limit(0), bits=10).count() == 0
