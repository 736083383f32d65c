"""Language model, deduplication, toxicity and decontamination against SQL and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from same import assert_same

from orrery.llm import decontam, line_dedup, lm, neardup, substring_dedup, suffix, toxicity
from orrery.llm.components import components
from orrery.llm.common import Scratch
from orrery.llm.queries import QUERIES, SQL

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, sf, name):
    assert_same(QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df())


# -- language model


def brute_lm(rows, train):
    seq = {i: WORDS.findall((t or "").encode().translate(LOW)) + [b"\0end"] for i, t in rows}
    c, bi = Counter(), Counter()
    for i in train:
        c.update(seq[i])
        bi.update(zip([b"\0start"] + seq[i][:-1], seq[i]))
    n, v = sum(c.values()), len(c)
    of = lambda counts: (0.0, *lm.discounts(*(Counter(counts)[k] for k in (1, 2, 3, 4))))
    kinds = Counter(w for _, w in bi)
    d2, d1 = of(bi.values()), of(kinds.values())
    left = sum(d1[min(k, 3)] for k in kinds.values())
    total, back = Counter(), Counter()
    for (a, _), k in bi.items():
        total[a] += k
        back[a] += d2[min(k, 3)]
    low = lambda w: (max(kinds[w] - d1[min(kinds[w], 3)], 0) + left / (v + 1)) / len(bi) if bi else 1.0
    p = lambda a, w: (max(bi[a, w] - d2[min(bi[a, w], 3)], 0) + back[a] * low(w)) / total[a] if total[a] else low(w)
    out = {}
    for i, s in seq.items():
        out[i] = (len(s), sum(w in c for w in s), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in s), sum(math.log10(p(a, w)) for a, w in zip([b"\0start"] + s[:-1], s)))
    return out, p, c


def same_scores(got, want):
    for i, w in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert abs(r.base_score - w[3]) < 1e-6 and abs(r.score - w[4]) < 1e-6


def test_lm_on_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    got = {r.doc_id: r for r in lm.op2_lm_score(spark, sf).collect()}
    want, p, c = brute_lm(rows, train)
    same_scores(got, want)
    assert all(r.held_out == (i not in set(train)) for i, r in got.items())
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert abs(sum(p(b"the", w) for w in c) + p(b"the", b"\0none") - 1) < 1e-9  # it is a distribution


def test_lm_odd_rows(spark, docs_of, odd):
    d = docs_of(odd)
    got = {r.doc_id: r for r in lm.score_documents(d, d).collect()}
    same_scores(got, brute_lm(odd, [i for i, _ in odd])[0])
    none = lm.score_documents(d, d.where("doc_id < 0")).collect()
    assert all(r.score == 0 and r.train_tokens == 0 for r in none)
    assert lm.score_documents(d.where("false"), d).count() == 0


def test_lm_hot_words_are_spread(spark, docs_of, monkeypatch):
    r = random.Random(2)
    rows = [(i, " ".join(["hot" if k % 2 else f"w{r.randint(0, 300)}" for k in range(60)])) for i in range(300)]
    monkeypatch.setattr(lm, "BUCKET_ROWS", 200)
    d = docs_of(rows)
    got = {x.doc_id: x for x in lm.score_documents(d, d).collect()}
    same_scores(got, brute_lm(rows, range(300))[0])


# -- line dedup


def test_lines(docs_of):
    rows = [(i, f"unique opening number {i} of text {i * 7} goes\nShared footer line of number {i} here now\nclosing {i} words differ much {i}") for i in range(40)]
    rows = [(i, t.replace("opening", f"opening{chr(97 + i % 26)}{chr(97 + i // 26)}").replace("unique", f"u{chr(97 + i % 26)}{chr(97 + i // 26)}").replace("closing", f"c{chr(97 + i % 26)}{chr(97 + i // 26)}")) for i, t in rows]
    odd = [(100, None), (101, ""), (102, "\n\n"), (103, "Shared footer line of number 9 here now")]
    out = line_dedup.drop_recurring_lines(docs_of(rows + odd), counts=True)
    assert out.columns == ["doc_id", "text", "id", "h", "n_lines", "n_dropped"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 44
    for i, t in rows:
        assert got[i].text.split("\n") == [x for x in t.split("\n") if not x.startswith("Shared")] and got[i].n_dropped == 1 and got[i].id == "x"
    assert (got[100].text, got[100].n_lines, got[101].text, got[102].text, got[103].text) == (None, 0, "", "\n\n", "")


def test_lines_of_copies_stay(docs_of):
    text = "first line of a document that is copied\nsecond line of it with more words\nthird line at the very end"
    got = line_dedup.drop_recurring_lines(docs_of([(i, text) for i in range(50)]))
    assert {r.text for r in got.collect()} == {text}


# -- near duplicates


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").encode().translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randint(0, 10**6)}"
    return " ".join(out)


def test_near_groups(spark, docs_of, odd):
    r = random.Random(4)
    rows = list(odd)
    for g in range(4):
        base = [f"b{g}x{k}" for k in range(120)]
        rows += [(1000 * (g + 1) + k, edited(r, base, r.randint(0, 6))) for k in range(60)]
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.link(docs_of(rows)).collect()}
    assert got == brute_near(rows)


def test_near_families_in_blocks(spark, docs_of, monkeypatch):
    r = random.Random(6)
    base = [f"b{k}" for k in range(100)]
    rows = [(k, edited(r, base, r.randint(2, 5))) for k in range(150)]
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "ROUNDS", 1)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.link(docs_of(rows)).collect()}
    assert got == brute_near(rows)


def test_near_empty_and_null_ids(spark, docs_of):
    assert neardup.link(docs_of([])).count() == 0
    got = neardup.link(docs_of([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f")])).collect()
    assert sorted((x.doc_id or -1, x.component_id or -1, x.kept) for x in got) == [(-1, -1, True), (5, 5, True), (5, 5, True)]


def test_odd_sketch_estimates():
    r = np.random.default_rng(0)
    for j in (0.75, 0.9):
        worst = []
        for _ in range(40):
            n = 400
            both = int(round(2 * n * j / (1 + j)))
            pool = r.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
            x, y = np.sort(pool[:n]), np.sort(pool[n - both :])
            row = np.repeat([0, 1], [len(x), len(y)])
            _, sig = neardup.signatures(row, np.concatenate([x, y]), 2)
            s = neardup.odd_sketches(sig).view(np.uint64)
            worst.append(int(np.bitwise_count(s[0] ^ s[1]).sum()))
        assert max(worst) <= neardup.largest_xor(0.75)


def test_components_of_a_path(spark):
    e = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(e.unionByName(spark.createDataFrame([(500, 501)], "a long, b long")), Scratch(spark)).collect()
    assert {(x.id, x.comp) for x in got} == {(i, 0) for i in range(201)} | {(500, 500), (501, 500)}


# -- substring deduplication


def brute_substrings(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def removed(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_substrings_on_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert removed(substring_dedup.op5_substring_dedup(spark, sf)) == brute_substrings(rows)


def test_substrings_odd_rows(spark, docs_of, odd):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcé ") for _ in range(n))
    passage = word(150)
    rows = list(odd) + [(20 + k, word(r.randint(0, 80)) + passage[r.randint(0, 30) :] + word(r.randint(0, 80))) for k in range(60)]
    rows += [(200, "ab" * 300), (201, "x" + "ab" * 100), (202, passage + passage), (203, passage[:100]), (204, passage[:99])]
    assert removed(substring_dedup.dedup_substrings(docs_of(rows))) == brute_substrings(rows)
    assert removed(substring_dedup.dedup_substrings(docs_of(rows), split=4, shard=8, chunk=50)) == brute_substrings(rows)


def test_substrings_of_a_hot_passage(spark, docs_of):
    """A passage in all documents with ever other surroundings, dealt by longer and longer strings."""
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, tails = word(170), [word(7) for _ in range(3)]
    rows = [(k, word(r.randint(20, 90)) + passage + r.choice(tails) + word(r.randint(20, 90))) for k in range(150)] + [(k, word(5) + passage[:120]) for k in range(150, 170)]
    want = brute_substrings(rows)
    for split in (2, 7, 40):
        assert removed(substring_dedup.dedup_substrings(docs_of(rows), split=split, shard=16)) == want


def test_substrings_of_repeated_rows(spark, docs_of):
    """Of equal rows one is whole; rows of an id are documents of their own, and a null id comes last."""
    r = random.Random(10)
    a, b = ("".join(r.choice("abcdefgh ") for _ in range(279)) for _ in range(2))
    rows = [(1, a), (1, a), (1, b), (2, b), (None, a), (None, b + a)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in substring_dedup.dedup_substrings(docs_of(rows)).collect())
    assert got == [(False, 1, 279, 0), (False, 1, 279, 0), (False, 1, 279, 279), (False, 2, 279, 279), (True, 0, 279, 279), (True, 0, 558, 558)]


def test_anchors_of_pieces():
    r = np.random.default_rng(5)
    data = r.integers(97, 101, 3000).astype(np.uint8)
    _, at, a, f = substring_dedup.anchors(data, np.array([0, 3000]))
    for chunk in (64, 100, 777, 5000):
        got = {x for p in substring_dedup.pieces(data, chunk) for x in zip(*(y.tolist() for y in p))}
        assert got == set(zip(at.tolist(), a.tolist(), f.tolist()))


def test_suffix_arrays():
    r = np.random.default_rng(1)
    for _ in range(200):
        t = r.integers(0, int(r.integers(1, 5)) + 1, int(r.integers(0, 60))).astype(np.uint8)
        b = t.tobytes()
        assert suffix.suffix_array(t).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    t = np.tile(np.array([1, 2, 1], np.uint8), 200)
    assert suffix.suffix_array(t).tolist() == sorted(range(600), key=lambda i: t.tobytes()[i:])


# -- toxicity


def test_toxicity_on_held_out_rows(spark, sf):
    """On planted words; small tables of real labels are too few to judge a score by."""
    r = random.Random(5)
    bad = ["zorkle", "vexim", "grumpf", "blarghed"]
    make = lambda y: " ".join(r.choice(bad) + r.choice(["", "s", "ish"]) if y and r.random() < 0.03 else f"w{r.randint(0, 400)}" for _ in range(r.randint(60, 300)))
    rows = [(i, make(i % 4 == 0) + (" zorkles" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score_documents(docs, labels).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(x.held_out for x, _ in held) and sum(x.held_out for x in got.values()) == len(held)
    hit = np.mean([x.predicted == y for x, y in held])
    assert hit > 0.95, hit
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())


def test_toxicity_odd_rows(spark, docs_of, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_documents(docs_of(odd + [(None, "x")]), none).collect()
    assert len(got) == len(odd) + 1 and all(x.score == 0 and x.predicted == 0 for x in got)
    one = spark.createDataFrame([(4, 1), (8, 1), (9, None)], "doc_id long, toxic int")
    assert {x.score for x in toxicity.score_documents(docs_of(odd), one).collect()} == {1.0}


def test_longer_texts_fill_the_sample_up(spark, docs_of):
    """A class whose texts are all long teaches too; short ones come first."""
    docs = docs_of([(i, "plain words here " * (3 if i < 30 else 900)) for i in range(60)])
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(60)], "doc_id long, toxic int")
    rows, share = toxicity.sample_rows(docs, labels, (25, 10))
    got = [(r.doc_id, r.toxic, len(r.text)) for r in rows.collect()]
    assert sum(y for _, y, _ in got) == 10 and all(i >= 40 for i, y, _ in got if y)
    short = sum(n < toxicity.MAX_BYTES for _, y, n in got if not y)
    assert short == min(25, sum(1 for i in range(30) if zlib.crc32(str(i).encode()) % 4 != 2)) and abs(share - 1 / 3) < 0.2


def test_scores_against_a_plain_loop():
    """The network of a window, gate by gate and word by word, and the highest window of texts up to a very long one."""
    r = np.random.default_rng(4)
    vocab = [bytes(r.integers(97, 123, 5).astype(np.uint8)) for _ in range(40)]
    docs = [b" ".join(vocab[k] for k in r.integers(0, 40, n)) for n in (1, 5, 64, 65, 200)] + [b"", b" ".join(vocab[k] for k in r.integers(0, 40, 30_000))]
    data, offs = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)]).astype(np.int64)
    found = toxicity.words(data, offs)
    row, uniq, inv, gram, word = found
    net = toxicity.Network(uniq[::2].copy())
    net.p["word"][:-1] = r.standard_normal(net.p["word"][:-1].shape)
    best, has, _ = toxicity.scores(net, found, len(docs))
    sig = lambda x: 1 / (1 + np.exp(-x))
    num, p, h = net.word_numbers(uniq), net.p, toxicity.HIDDEN
    x = [np.concatenate([p["word"][num[k]], p["gram"][gram[word == k]].mean(0)]) for k in range(len(uniq))]

    def window(seq):
        out = np.zeros((len(seq), 2 * h))
        for way, order in ((0, range(len(seq))), (1, range(len(seq) - 1, -1, -1))):
            state = np.zeros(h)
            for t in order:
                g, hh = x[seq[t]] @ p["wx"][way] + p["bx"][way][0], state @ p["wh"][way]
                rr, z = sig(g[:h] + hh[:h]), sig(g[h : 2 * h] + hh[h : 2 * h])
                c = np.tanh(g[2 * h :] + rr * hh[2 * h :])
                state = state + (1 - z) * (c - state)
                out[t, way * h : (way + 1) * h] = state
        e = np.tanh(out @ p["wa"] + p["ba"]) @ p["va"]
        alpha = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        return float((alpha @ out) @ p["wo"] + p["bo"][0])

    assert has.tolist() == [True] * 5 + [False, True]
    for d in (0, 1, 2, 3, 4):
        seq = inv[row == d]
        starts = range(0, max(1, len(seq) - toxicity.WIDTH + toxicity.STRIDE), toxicity.STRIDE)
        assert abs(best[d] - max(window(seq[s : s + toxicity.WIDTH]) for s in starts)) < 1e-3
    seq = inv[row == 6]
    assert abs(best[6] - max(window(seq[s : s + toxicity.WIDTH]) for s in range(0, len(seq), toxicity.STRIDE))) < 1e-3


def test_windows_cover_all_words():
    n = [0, 1, 64, 65, 112, 113, 1000]
    row = np.repeat(np.arange(len(n)), n)
    start, length, doc = toxicity.windows(row, len(n))
    first = np.cumsum(n) - n
    for d, k in enumerate(n):
        seen = set()
        for s, m in zip(start[doc == d], length[doc == d]):
            assert 0 < m <= 64
            seen |= set(range(s - first[d], s - first[d] + m))
        assert seen == set(range(k))


def test_gradients():
    rng = np.random.default_rng(0)
    texts = [b"alpha beta gamma alpha", b"delta epsilon", b"beta zeta eta theta iota"]
    row, uniq, inv, gram, word = toxicity.words_of_all(texts)
    net = toxicity.Network(np.sort(uniq))
    net.p = {k: (v + rng.standard_normal(v.shape) * 0.1).astype(np.float64) for k, v in net.p.items()}
    net.p["word"][-1] = 0
    start, length, doc = toxicity.windows(row, 3)
    idx, mask = toxicity._gather(start, length, inv, len(uniq))
    idx, mask, y, w = idx[:, :6], mask[:, :6], np.array([1.0, 0, 1]), np.array([1.0, 2, 3])
    num = net.word_numbers(uniq)

    def loss():
        z = net.forward(net.project(net.inputs(num, gram, word)[0]), idx, mask)[0].astype(float)
        return float((w / w.sum() * (np.logaddexp(0, z) - y * z)).sum())

    g = net.gradients(num, gram, word, idx, mask, y, w)
    for k in ("wx", "wh", "wa", "va", "wo", "bo", "bx", "word"):
        at = np.unravel_index(np.argmax(abs(g[k])), g[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = loss()
        net.p[k][at] = old - 1e-2
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-2 - g[k][at]) < 0.05 * abs(g[k][at]) + 1e-4, k


# -- decontamination


def test_decontamination_odd_rows(spark, docs_of, odd):
    item = " ".join(f"q{k}" for k in range(20))
    rows = odd + [(50, "x " * 30 + item + " y" * 30), (51, item.upper()), (52, " ".join(item.split()[:12])), (53, "short item"), (54, "x-short-ITEM-y"), (55, " ".join(["w"] * 400) + " " + " ".join(item.split()[3:16]))]
    bench = spark.createDataFrame([(1, item, 9), (2, None, 9), (3, "", 9), (4, "short item", 9), (10, item, 9)], "item_id long, text string, doc_id int")
    got = {r.doc_id: r for r in decontam.match_benchmark(docs_of(rows), bench).collect()}
    assert (got[50].n_hit, got[50].item_ids, got[50].contaminated) == (20, ["1", "10"], True)
    assert got[50].hit_spans[0].start == 30 and got[50].hit_spans[0].end == 50
    assert got[51].n_hit == 20 and got[52].n_hit == 0
    assert (got[53].n_hit, got[54].n_hit, got[54].n_words) == (2, 2, 4)
    assert (got[55].n_hit, got[55].contaminated) == (13, False)
    assert got[1].n_words == 0 and not got[1].contaminated and got[1].items_sha256 == hashlib.sha256(b"").hexdigest()
    split = decontam.match_benchmark(docs_of(rows), bench, block_bytes=80)
    same = lambda df: sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())
    assert same(split) == same(decontam.match_benchmark(docs_of(rows), bench))
    assert decontam.match_benchmark(docs_of(rows), bench.where("false")).where("n_hit > 0").count() == 0


def test_decontamination_by_blocks(spark, docs_of):
    """Blocks of tests change nothing, with repeated rows, two texts of one id and null ids on either side."""
    r = random.Random(11)
    vocab = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, text(r.randint(1, 30))) for k in range(30)] + [(None, text(5)), (3, text(14))]
    rows = [(k, text(20) + " " + items[k % 30][1] + " " + text(10)) for k in range(60)]
    rows += [(5, rows[6][1]), (7, rows[7][1]), (7, rows[7][1]), (None, rows[8][1]), (None, rows[9][1]), (None, None), (70, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    same = lambda df: sorted(map(str, ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.item_ids, r.hit_spans) for r in df.collect())))
    one = same(decontam.match_benchmark(docs_of(rows), bench))
    assert len(one) == len(rows) and one == same(decontam.match_benchmark(docs_of(rows), bench, block_bytes=80))
    near = lambda **kw: sorted((str(r.doc_id), r.near_ids) for r in decontam.near_benchmark(docs_of(rows), bench, width=6, span=9, **kw).collect())
    assert near() == near(block_bytes=80) and len(near()) == len(rows)
    want = sorted((str(i), sorted({str(k) for k, t in items if k is not None and brute_near_phrase((x or "").split(), t.split(), 6, 9)})) for i, x in rows)
    assert near() == want and any(x for _, x in want) and not all(x for _, x in want)


def brute_near_phrase(words, item, width, span):
    n = min(width, len(item))
    wanted = [set(item[k : k + n]) for k in range(len(item) - n + 1)] if n else []
    return any(w <= set(words[s : s + span]) for w in wanted for s in range(len(words)))


def test_proximity():
    enc = [b"alpha one two beta", b"alpha", b"beta x alpha"]
    data, offs = np.frombuffer(b"".join(enc), np.uint8), np.cumsum([0, *map(len, enc)]).astype(np.int64)
    tok, row = decontam.tokenize(data, offs)
    terms = np.unique(decontam.tokenize(np.frombuffer(b"alpha beta", np.uint8), np.array([0, 10]))[0])
    words, *lists = decontam.ShardIndex.pack(tok, row, 3)
    index = decontam.ShardIndex.unpack(words.tolist(), *(x.tobytes() for x in lists))
    assert index.among(np.unique(tok)).df.tolist() == np.unique(tok, return_counts=True)[1].tolist()
    index = index.among(terms)
    assert len(index.near(np.array([0, 1]), 3)) == 2 and len(index.near(np.array([0, 1]), 2)) == 1
    assert len(index.together(np.array([0, 1]), 4)) == 2 and len(index.together(np.array([0, 1]), 3)) == 1
