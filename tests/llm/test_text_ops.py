"""Token counts, byte-level BPE, main text and media against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orrery.llm import archive_source, bpe, html_text, media, tokencount

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def fuzz(n, seed=1):
    r = random.Random(seed)
    parts = ["the ", "don't", "  ", "\n", "\n\n ", "é", "漢字", "🙂", "123", "!!", " ", " ", "\x1c", "՘", "\U000107bb", "'ll", "<|endoftext|>", "A", "\t", "x" * 40]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_token_counts(spark, docs_of, odd):
    from tokenizers import Tokenizer

    rows = odd + [(100 + i, t) for i, t in enumerate(fuzz(300))]
    lib = Tokenizer.from_file(JSON)
    got = {r.doc_id: r for r in tokencount.count_tokens(docs_of(rows), JSON).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024), t


def test_token_counts_on_the_table(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lib = Tokenizer.from_file(JSON)
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: len(e.ids) for r, e in zip(rows, lib.encode_batch([r.text for r in rows], add_special_tokens=False))}
    assert {r.doc_id: r.n_tokens for r in tokencount.op1_token_counts(spark, sf).collect()} == want


def test_a_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokencount, "MEMO", 3)
    a = tokencount.PieceCounter(JSON)
    texts = fuzz(50, 3)
    assert [a.counts([t])[0] for t in texts] == tokencount.PieceCounter(JSON).counts(texts)


def test_bpe(spark, docs_of, odd):
    rows = odd + [(100 + i, t) for i, t in enumerate(fuzz(100, 2))]
    enc = bpe.encoding(RANKS)
    got = {r.doc_id: r for r in bpe.digests(docs_of(rows), RANKS).collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_cut_texts_have_the_same_ids(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 16)
    enc = bpe.encoding(RANKS)
    for t in fuzz(300, 5) + ["a" * 200, " " * 100 + "x", "ab  cd\n\nef " * 20]:
        assert "".join(bpe.pieces(t, 16)) == t
        assert bpe.encode(enc, t) == enc.encode_ordinary(t)


def test_long_runs_of_blanks(monkeypatch):
    """The library's matcher gives up on such runs; a plain loop over byte pairs doesn't."""
    enc = bpe.encoding(RANKS)
    for t in (" " * 2_000_000, "x" + "\n" * 2_000_000 + "y", "a b" * 100 + "\t\u00a0" * 600_000 + " é"):
        assert enc.decode_bytes(bpe.encode(enc, t)) == t.encode()
    ranks = enc._mergeable_ranks

    def merged(piece):
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while True:
            best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    blanks = " \n\n  \t" * 200
    monkeypatch.setattr(bpe, "RUN", 8)
    bpe._runs.cache_clear()
    assert bpe.encode(enc, "x" + blanks + " y") == merged(b"x") + merged(blanks.encode()) + merged(b" y")
    for t in fuzz(300, 6) + [f"a{' ' * 20}\n{' ' * 9}b", "\u3000" * 12 + "!", "1" + "\x85" * 9]:
        assert bpe.encode(enc, t) == enc.encode_ordinary(t)
    bpe._runs.cache_clear()


def test_encode_then_decode(spark, docs_of, odd):
    e = bpe.encode_text(docs_of(odd), RANKS)
    assert e.columns == ["doc_id", "text", "id", "h", "token_ids"]
    for r in bpe.decode_ids(e, RANKS).collect():
        assert bytes(r.decoded) == (r.text or "").encode()


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="ad">Buy this fine thing today now.</div><!-- note <p>no</p> -->
<article><h1>Main &lt;title&gt;</h1><p>First   para<br>goes on &eacute;.<p><b>Second</b> one<p>End.</article>
<form>Sign up here</form><section id="comments"><p>A reader says a rather long thing about all of this and more.</p></section><footer>&copy; x</footer>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "plain words without any tags at all but enough"), (5, "z", "<article><p>cut off &am"), (6, "q", "<nav><a href=x>y</a>")]
    got = {r.page_id: r for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Main <title>\nFirst para goes on é.\nSecond one\nEnd."
    assert got[1].n_chars == len(got[1].text)
    assert [got[i].text for i in (2, 3, 4, 5, 6)] == ["", "", rows[3][2], "cut off &am", ""]


def test_main_text_is_the_article(spark, sf):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_text.op4_html_text(spark, sf).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in want if b)


W = "several words that make one rather long sentence of the main text here"
LONG = " ".join([W] * 5)
#: Pages labelled by hand, of other shapes than the tree has learnt from: html, text.
BY_HAND = [
    (f"<div class=advert>Buy this fine thing</div><article><p>{LONG}</p></article>", [LONG]),
    (f"<nav><a href=/>Home</a></nav><article><p>{LONG}</article>", [LONG]),
    (f"<div class='cookie'>We use cookies here</div><article><p>{LONG}</article>", [LONG]),
    (f"<article><p>{LONG}</article><div class=comments><p>first!<p>{LONG} I say</div>", [LONG]),
    (f"<div class='post-with-sidebar'><article><h1>Title</h1><p>{LONG}</article><div class=sidebar>Latest news of today</div></div>", ["Title", LONG]),
    (f"<header>Our site</header><article><header><h1>A heading</h1><p>By a writer</header><p>{LONG}</article>", ["A heading", "By a writer", LONG]),
    (f"<body class='no-sidebar search-open'><div id=siteHeader><h1>Our site</h1></div><div id=content role=main><h1>Big news</h1><p>{LONG}<p>Short.<p>{LONG}</div><div id='page-footer'>All rights reserved</div>", ["Big news", LONG, "Short.", LONG]),
    (f"<form id=f><div class=navbar><a href=a>One</a> <a href=b>Two</a></div><article><p>{LONG}<p>{W}</article><div class='site-footer'>Imprint</div></form>", [LONG, W]),
    (f"<table><tr><td><a href=a>One</a><td><a href=b>Two</a></table><h1>Of tables</h1><p>{LONG}<p>{W}<p>{LONG}<ul><li><a href=c>More of it here</a><li><a href=d>And some more</a></ul>", ["Of tables", LONG, W, LONG]),
    (f"<article><h1>T</h1><p>{LONG}<div class='newsletter-signup'><p>{W}<form>Your address</form></div><p>{LONG}<section id=comments><article class='comment-body'><p>{LONG} I say</article></section></article>", ["T", LONG, LONG]),
    (f"<div role=banner><p>{W}</div><main><p>{LONG}<ul><li>one<li>two words</ul><p>{W}</main><div role=complementary><p>{LONG}</div>", [LONG, "one", "two words", W]),
    (f"<div class=wrap><p class=ad>{W}<p>{LONG}<p>{LONG}<p hidden>{W}</div><div style='display: none'>{LONG}</div><p>{LONG}", [LONG, LONG, LONG]),
    (f"<p>{LONG}<script>var a = '<p>{W}</p>'</script><p>{W}<!-- <p>{W} --><noscript>{W}</noscript><p>{LONG}", [LONG, W, LONG]),
]


def test_pages_labelled_by_hand(spark):
    rows = [(k, "u", h) for k, (h, _) in enumerate(BY_HAND)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k].split("\n") for k in range(len(rows))] == [want for _, want in BY_HAND]


def test_pages_of_odd_rows(spark):
    """Null ids, repeats, clashing columns, a very long page and one of very deep elements."""
    long = f"<nav><a href=x>{W}</a></nav><article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    deep = "<div>" * 50_000 + f"<p>{LONG}" + "</div>" * 50_000
    rows = [(None, None, f"<p>{LONG}"), (1, "u", long), (2, "u", deep), (3, "u", f"<p>{LONG}"), (3, "u", f"<p>{LONG}")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("text", "n_chars", "words"):
        d = d.withColumn(c, F.lit("clash"))
    got = sorted((r.page_id or 0, r.n_chars) for r in html_text.extract_text(d).collect())
    assert got == [(0, len(LONG)), (1, 20_000 * (len(LONG) + 1) - 1), (2, len(LONG)), (3, len(LONG)), (3, len(LONG))]


def test_tree_fits_its_table():
    x, y = html_text.labelled_blocks()
    assert (html_text.predict(html_text.default_tree(), x) == y.astype(bool)).mean() > 0.95


def test_media(spark, docs_of, odd):
    path = media.Scratch(spark).path("media")
    media.store_media(docs_of(odd), path)
    got = {r.doc_id: r for r in media.media_features(media.read_media(spark, path, range_bytes="300")).collect()}
    assert len(got) == len(odd)
    for i, t in odd:
        raw = (t or "").encode()
        pay = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        png = media.encode_png(pay, len(raw))
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
    assert got[8][1:] == got[9][1:]


def test_png_filters():
    import struct

    r = np.random.default_rng(0)
    want = r.integers(0, 256, (6, 192)).astype(np.uint8)
    rows = []
    for y, k in enumerate((0, 1, 2, 3, 4, 4)):
        up = want[y - 1].astype(int) if y else np.zeros(192, int)
        left = np.concatenate([[0], want[y][:-1]]).astype(int)
        corner = np.concatenate([[0], up[:-1]])
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = (0, left, up, (left + up) // 2, near)[k]
        rows.append(bytes([k]) + ((want[y].astype(int) - guess) % 256).astype(np.uint8).tobytes())
    chunk = media._chunk
    png = media._SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 192, 6, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (media.decode_png(png)[0] == want).all()


def test_members_are_retried_by_themselves(spark, docs_of, tmp_path, monkeypatch):
    media.store_media(docs_of([(i, f"text {i} " * 30) for i in range(6)]).coalesce(1), str(tmp_path))
    zips = [p for p in tmp_path.iterdir() if p.suffix == ".zip"]
    assert len(zips) == 1
    reader = archive_source.ArchiveReader({"path": str(tmp_path), "retry_seconds": "0"})
    real, seen = archive_source.ArchiveReader.member, {}

    def flaky(handle, info):
        seen[info.header_offset] = seen.get(info.header_offset, 0) + 1
        if info.filename.startswith("2/") and seen[info.header_offset] < 3:
            raise OSError("lost")
        return real(handle, info)

    monkeypatch.setattr(archive_source.ArchiveReader, "member", staticmethod(flaky))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(seen.values()) == [1, 1, 1, 1, 1, 3] and {r["attempts"] for r in rows} == {1, 3} and all(r["payload"] for r in rows)
    monkeypatch.undo()
    # a member broken on disk fails by itself
    raw = bytearray(zips[0].read_bytes())
    raw[raw.find(b"IDAT") + 6] ^= 1
    zips[0].write_bytes(raw)
    with pytest.raises(OSError, match="CRC"):
        list(b for p in reader.partitions() for b in reader.read(p))
    keep = archive_source.ArchiveReader({"path": str(tmp_path), "retry_seconds": "0", "on_error": "null"})
    rows = [r for p in keep.partitions() for b in keep.read(p) for r in b.to_pylist()]
    assert [r["payload"] is None for r in rows].count(True) == 1 and len(rows) == 6


def test_uncommitted_archives_are_not_read(spark, docs_of, tmp_path):
    media.store_media(docs_of([(1, "a")]), str(tmp_path))
    (tmp_path / "other-attempt.zip").write_bytes(b"half")
    (tmp_path / "_draft-of-one-that-died.json").write_text('[["other-')
    media.store_media(docs_of([(2, "b")]), str(tmp_path))
    assert sorted(r.name for r in media.read_media(spark, str(tmp_path)).collect()) == ["1", "2"]
