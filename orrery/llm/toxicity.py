"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own vector (words that enough training texts hold; zero for others) beside the
mean of its character trigrams' vectors, so inflected or unseen forms of a known stem still speak.  Two
recurrent passes read a window of words, attention pools their states, and a logistic unit scores the
window.  A document's score is that of its highest window, over all overlapping windows of the whole
text, made a probability by a logistic fit on training texts that the network has not learnt from.

Documents carry labels and windows don't, so training alternates: score all windows of the training
texts, keep the highest of each toxic text and the highest and a chance one of each clean text, learn.

Training texts: at most ``per_class`` of label 0 and of label 1, in the order of a hash of the id, of at most
``max_bytes`` each; where a class has fewer, longer ones, the shortest first, of up to ``LONGER`` times the bytes.
That bound is the only one; every text is scored over its whole length.  One executor
task learns from the sample and returns the weights, a few MB whatever the input.

Defined results: null and empty texts, and texts without a word, get the share of label 1 among the
labelled training rows; without labels of both kinds every text gets that share (0 without labels).
Rows with a null label teach nothing.  Repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import bytesops as B
from orrery.llm.common import arrow_map, table, texts

WIDTH, STRIDE = 64, 48
DIM, HIDDEN, ATTEND = 12, 12, 8
GRAMS = 1 << 15
VOCAB = 1 << 15
#: Training texts of label 0 and of label 1 at most, and the bytes of each.
PER_CLASS = (3600, 1200)
MAX_BYTES = 1 << 13
#: Where a class has too few such texts, longer ones of up to so many times the bytes fill it up.
LONGER = 16
THRESHOLD = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
f32 = np.float32


def words(data: np.ndarray, offs: np.ndarray):
    """(row, distinct word hash, number of the word, trigram bucket, word of the trigram)."""
    low = B.LOWER[data]
    s, e, row = B.spans(low, offs, B.ALNUM)
    if not len(s):
        z = np.zeros(0, np.int64)
        return row, z.astype(np.uint64), z, z, z
    h = B.span_hashes(B.prefix_sums(low), s, e)
    uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
    us, ul = s[first], (e - s)[first]
    # trigrams of the word between two marks: as many as it has bytes
    word = np.repeat(np.arange(len(uniq)), ul)
    at = np.arange(len(word)) - np.repeat(np.cumsum(ul) - ul, ul)
    pos = us[word] + at
    mid = low[pos].astype(np.int64)
    left = np.where(at == 0, 1, low[np.maximum(pos - 1, 0)].astype(np.int64))
    right = np.where(at == ul[word] - 1, 2, low[np.minimum(pos + 1, len(low) - 1)].astype(np.int64))
    gram = ((left * 65599 + mid) * 65599 + right) * 0x9E3779B1
    return row, uniq, inv, (gram >> 7) % GRAMS, word


def words_of_all(texts: list[bytes], max_bytes: int = 1 << 19):
    """``words`` of many texts, cut up so that no array is as long as all their bytes."""
    rows, uniqs, invs, grams, owners = [], [], [], [], []
    i = base = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= max_bytes):
            size += len(texts[j])
            j += 1
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts[i:j]])]).astype(np.int64)
        row, uniq, inv, gram, word = words(np.frombuffer(b"".join(texts[i:j]), np.uint8), offs)
        for out, x in ((rows, row + i), (uniqs, uniq), (invs, inv + base), (grams, gram.astype(np.int32)), (owners, word + base)):
            out.append(x)
        base += len(uniq)
        i = j
    uniq, first, number = np.unique(np.concatenate(uniqs), return_index=True, return_inverse=True)
    seen_first = np.zeros(base, bool)
    seen_first[first] = True
    word, gram = np.concatenate(owners), np.concatenate(grams)
    keep = seen_first[word]
    word, gram = number[word[keep]], gram[keep].astype(np.int64)
    order = np.argsort(word, kind="stable")
    return np.concatenate(rows), uniq, number[np.concatenate(invs)], gram[order], word[order]


def windows(row: np.ndarray, n_rows: int):
    """(first word, words, row) of all windows: each ``STRIDE`` words, until a row's last word is in one."""
    n = np.bincount(row, minlength=n_rows)
    start = np.cumsum(n) - n
    many = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WIDTH) // STRIDE)))
    doc = np.repeat(np.arange(n_rows), many)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    return start[doc] + k * STRIDE, np.minimum(WIDTH, n[doc] - k * STRIDE), doc


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, and passes over windows of word numbers; both directions run as one stack."""

    def __init__(self, vocab: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        d, h, a = 2 * DIM, HIDDEN, ATTEND
        g = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2])).astype(f32)
        self.vocab = vocab
        self.p = {
            "word": np.zeros((len(vocab) + 1, DIM), f32), "gram": (r.standard_normal((GRAMS, DIM)) * 0.3).astype(f32),
            "wx": g(2, d, 3 * h), "wh": g(2, h, 3 * h), "bx": np.zeros((2, 1, 3 * h), f32),
            "wa": g(2 * h, a), "ba": np.zeros(a, f32), "va": g(a, 1)[:, 0], "wo": g(2 * h, 1)[:, 0], "bo": np.zeros(1, f32),
        }

    def word_numbers(self, uniq: np.ndarray) -> np.ndarray:
        """Rows of the word table; the last row is that of unknown words and stays zero."""
        if not len(self.vocab):
            return np.zeros(len(uniq), np.int64)
        k = np.minimum(np.searchsorted(self.vocab, uniq), len(self.vocab) - 1)
        return np.where(self.vocab[k] == uniq, k, len(self.vocab))

    def inputs(self, num: np.ndarray, gram: np.ndarray, word: np.ndarray):
        """(input vectors of distinct words, trigrams of each)."""
        n = np.bincount(word, minlength=len(num)).astype(f32)
        first = np.cumsum(n).astype(np.int64) - n.astype(np.int64)
        mean = np.empty((len(num), DIM), self.p["gram"].dtype)
        for i in range(0, len(num), 1 << 15):  # so that the vectors of all trigrams are never there at once
            j = min(i + (1 << 15), len(num))
            lo, hi = first[i], first[j] if j < len(num) else len(gram)
            mean[i:j] = np.add.reduceat(self.p["gram"][gram[lo:hi]], first[i:j] - lo, axis=0) / n[i:j, None]
        return np.concatenate([self.p["word"][num], mean], axis=1), n

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of distinct words, and a row of zeros for the padding."""
        px = np.matmul(x[None], self.p["wx"]) + self.p["bx"]
        return np.concatenate([px, np.zeros((2, 1, 3 * HIDDEN), f32)], axis=1)

    def forward(self, px: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; idx (n, width) numbers into px, mask (n, width)."""
        n, w = idx.shape
        h = HIDDEN
        state = np.zeros((2, n, h), f32)
        out = np.empty((w, n, 2 * h), f32)
        tape = []
        wh = self.p["wh"]
        gate = np.empty((2, n, 3 * h), f32)
        for t in range(w):
            a, b = t, w - 1 - t
            gate[0], gate[1] = px[0][idx[:, a]], px[1][idx[:, b]]
            m = np.stack([mask[:, a], mask[:, b]])[:, :, None]
            hh = np.matmul(state, wh)
            rz = _sigmoid(gate[:, :, : 2 * h] + hh[:, :, : 2 * h])
            r, z = rz[:, :, :h], rz[:, :, h:]
            c = np.tanh(gate[:, :, 2 * h :] + r * hh[:, :, 2 * h :])
            new = state + m * (1 - z) * (c - state)
            if keep:
                tape.append((state, r, z, c, hh[:, :, 2 * h :], m))
            state = new
            out[a, :, :h] = state[0]
            out[b, :, h:] = state[1]
        att = np.tanh(out @ self.p["wa"] + self.p["ba"])
        e = att @ self.p["va"]
        e = np.where(mask.T > 0, e, -1e9)
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = np.einsum("wn,wnh->nh", alpha, out)
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logit, (out, att, alpha, pooled, tape)) if keep else (logit, None)

    def gradients(self, num, gram, word, idx, mask, y, weight):
        p, h = self.p, HIDDEN
        x, n_gram = self.inputs(num, gram, word)
        px = self.project(x)
        logit, (out, att, alpha, pooled, tape) = self.forward(px, idx, mask, keep=True)
        n, w = idx.shape
        d_logit = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(f32)
        g = {"wo": pooled.T @ d_logit, "bo": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * p["wo"]
        d_alpha = np.einsum("nh,wnh->wn", d_pool, out)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        d_att = d_e[:, :, None] * p["va"] * (1 - att * att)
        g["va"] = np.einsum("wn,wna->a", d_e, att)
        g["wa"] = np.tensordot(out, d_att, axes=([0, 1], [0, 1]))
        g["ba"] = d_att.sum((0, 1))
        d_out = alpha[:, :, None] * d_pool + d_att @ p["wa"].T
        d_px = np.zeros_like(px)
        g["wh"] = np.zeros_like(p["wh"])
        d_state = np.zeros((2, n, h), f32)
        wht = p["wh"].transpose(0, 2, 1)
        rows, grads = [], []
        for t in range(w - 1, -1, -1):
            a, b = t, w - 1 - t
            before, r, z, c, hn, m = tape[t]
            d_state[0] += d_out[a, :, :h]
            d_state[1] += d_out[b, :, h:]
            step = m * d_state
            d_c = step * (1 - z) * (1 - c * c)
            d_z = step * (before - c) * z * (1 - z)
            d_r = d_c * hn * r * (1 - r)
            d_hh = np.concatenate([d_r, d_z, d_c * r], axis=2)
            d_gate = np.concatenate([d_r, d_z, d_c], axis=2)
            g["wh"] += np.matmul(before.transpose(0, 2, 1), d_hh)
            d_state = d_state - step * (1 - z) + np.matmul(d_hh, wht)
            rows.append((idx[:, a], idx[:, b]))
            grads.append(d_gate)
        for k in (0, 1):
            at = np.concatenate([r[k] for r in rows])
            np.add.at(d_px[k], at, np.concatenate([d[k] for d in grads]))
        d_px = d_px[:, :-1]
        g["wx"] = np.matmul(x.T[None], d_px)
        g["bx"] = d_px.sum(1, keepdims=True)
        d_x = np.matmul(d_px, p["wx"].transpose(0, 2, 1)).sum(0)
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], num, d_x[:, :DIM])
        g["word"][-1] = 0
        g["gram"] = np.zeros_like(p["gram"])
        np.add.at(g["gram"], gram, (d_x[:, DIM:] / n_gram[:, None])[word])
        return g


class Adam:
    def __init__(self, p, rate=0.01, decay=0.01):
        self.decay = decay
        self.m, self.v, self.t, self.rate = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0, rate

    def step(self, p, g):
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = min(1.0, 1.0 / (norm + 1e-9))
        for k, x in g.items():
            x = x * f32(clip)
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.99**self.t)
            p[k] -= (self.rate * (m / (np.sqrt(v) + 1e-8) + self.decay * p[k])).astype(f32)


def _gather(start, length, inv, pad):
    at = start[:, None] + np.arange(WIDTH)
    mask = np.arange(WIDTH) < length[:, None]
    return np.where(mask, inv[np.minimum(at, len(inv) - 1)], pad), mask.astype(f32)


def scores(net: Network, found, n: int, chunk: int = 1024):
    """(logit of each row's highest window, row has words), and the windows with their logits; ``found`` as of ``words``."""
    row, uniq, inv, gram, word = found
    start, length, doc = windows(row, n)
    logit = np.empty(len(doc), f32)
    if len(doc):
        px = net.project(net.inputs(net.word_numbers(uniq), gram, word)[0])
        order = np.argsort(length, kind="stable")
        for i in range(0, len(doc), chunk):
            k = order[i : i + chunk]
            idx, mask = _gather(start[k], length[k], inv, len(uniq))
            w = int(length[k].max())
            logit[k] = net.forward(px, idx[:, :w], mask[:, :w])[0]
    has = np.bincount(doc, minlength=n) > 0
    best = np.full(n, -np.inf, f32)
    if len(doc):
        best[has] = np.maximum.reduceat(logit, np.flatnonzero(np.diff(doc, prepend=-1)))
    return best, has, (start, length, doc, logit)


def train(sample: list[tuple[bytes, int]], share: float, *, rounds: int = 6, batch: int = 256, seed: int = 7):
    """(network, slope, intercept) from (text, label) pairs; share: of label 1 among all labelled rows."""
    rng = np.random.default_rng(seed)
    y = np.array([b for _, b in sample])
    found = words_of_all([t for t, _ in sample])
    row, uniq, inv, gram, word = found
    gram_at = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(uniq)))])
    fit = rng.permutation(len(sample)) % 5 != 0  # the rest sets slope and intercept
    pairs = np.unique(row[fit[row]] * len(uniq) + inv[fit[row]])
    df = np.bincount(pairs % len(uniq), minlength=len(uniq))
    common = np.argsort(-df, kind="stable")[:VOCAB]
    net = Network(np.sort(uniq[common[df[common] >= 3]]), seed)
    start, length, doc = windows(row, len(sample))
    adam = Adam(net.p)
    nums = net.word_numbers(uniq)
    known = nums < len(net.vocab)
    net.p["word"][nums[known], 0] = _odds(pairs // len(uniq), pairs % len(uniq), len(uniq), y, fit)[known]
    wg = np.unique(word * GRAMS + gram)  # (word, trigram) once, then (text, trigram) once
    first = np.searchsorted(wg, np.arange(len(uniq) + 1) * GRAMS)
    held_by = []
    for i in range(0, len(pairs), 1 << 16):  # a text at a cut may count twice for a trigram; at most one text in 65536 pairs
        own = pairs[i : i + (1 << 16)] % len(uniq)
        many = np.diff(first)[own]
        at = np.repeat(first[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        held_by.append(np.unique(np.repeat(pairs[i : i + (1 << 16)] // len(uniq), many) * GRAMS + wg[at] % GRAMS))
    dg = np.concatenate(held_by)
    del held_by, wg, pairs
    net.p["gram"][:, 0] = _odds(dg // GRAMS, dg % GRAMS, GRAMS, y, fit)
    balance = np.where(y == 1, 0.5 / max(1, (y[fit] == 1).sum()), 0.5 / max(1, (y[fit] == 0).sum()))
    for k in range(rounds):
        usable = fit[doc]
        if k == 0:
            chosen = np.flatnonzero(usable)
            chosen = chosen[rng.permutation(len(chosen))[: 4 * len(sample)]]
        else:
            logit = scores(net, found, len(sample))[2][3]
            order = np.lexsort((-logit, doc))
            top = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
            chance = order[rng.permutation(len(order))]
            chance = chance[np.unique(doc[chance], return_index=True)[1]]
            chosen = np.concatenate([top, chance[y[doc[chance]] == 0]])
            chosen = chosen[usable[chosen]]
        per = np.bincount(doc[chosen], minlength=len(sample))
        weight = balance[doc] / np.maximum(1, per[doc])
        adam.rate = 0.01 if k < rounds - 2 else 0.004
        steps = max(1, -(-len(chosen) // batch))
        for _ in range(max(3, -(-40 // steps))):
            mixed = rng.permutation(chosen)
            for i in range(0, len(mixed), batch):
                b = mixed[i : i + batch]
                idx, mask = _gather(start[b], length[b], inv, -1)
                used, local = np.unique(idx[mask > 0], return_inverse=True)
                own = np.full(idx.shape, len(used))
                own[mask > 0] = local
                n = gram_at[used + 1] - gram_at[used]
                of = np.repeat(np.arange(len(used)), n)
                at = gram_at[used][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                g = net.gradients(nums[used], gram[at], of, own, mask, y[doc[b]].astype(f32), weight[b].astype(f32))
                adam.step(net.p, g)
    best, has, _ = scores(net, found, len(sample))
    held = ~fit & has
    slope, shift = _calibrate(best[held], y[held], share) if len(set(y[held])) == 2 else (1.0, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))))
    return net, slope, shift


def _odds(doc: np.ndarray, item: np.ndarray, n: int, y: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Where the first input starts from: how sure the log odds of label 1 differ in texts with the item."""
    na, nb = (y[fit] == 1).sum() + 1, (y[fit] == 0).sum() + 1
    a, b = np.bincount(item, y[doc], n), np.bincount(item, 1 - y[doc], n)
    odds = np.log((a + 0.5) / (na - a + 0.5)) - np.log((b + 0.5) / (nb - b + 0.5))
    return (np.clip(odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)), -8, 8) / 4).astype(f32)


def _calibrate(logit: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic fit with the classes weighted as among all labelled rows; a weak prior keeps it finite."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    w = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    at, prior = np.array([1.0, 0.0]), np.array([1.0, 0.1])

    def loss(c):
        z = c[0] * logit + c[1]
        return (w * (np.logaddexp(0, z) - y * z)).sum() + (prior * (c - (1, 0)) ** 2).sum() / 2

    for _ in range(50):
        q = _sigmoid(at[0] * logit + at[1])
        s = w * q * (1 - q)
        g = np.array([(w * (q - y) * logit).sum(), (w * (q - y)).sum()]) + prior * (at - (1, 0))
        hess = np.array([[(s * logit * logit).sum(), (s * logit).sum()], [(s * logit).sum(), s.sum()]]) + np.diag(prior)
        step, rate = np.linalg.solve(hess, g), 1.0
        while rate > 1e-4 and (at[0] - rate * step[0] < 0.05 or loss(at - rate * step) > loss(at)):
            rate /= 2
        if rate <= 1e-4:
            break
        at = at - rate * step
    return float(at[0]), float(at[1])


def sample_rows(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, float]:
    """The bounded training sample (text, label) and the share of label 1 among all labelled training rows."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    lab = lab.where("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = lab.agg(F.avg("toxic")).first()[0]
    sized = texts(docs).where("doc_id is not null").select("doc_id", F.octet_length("text").alias("size")).join(lab, "doc_id").where(F.col("size") <= LONGER * max_bytes)

    def picked(kind: int) -> DataFrame:
        first = F.greatest("size", F.lit(max_bytes)), F.xxhash64("doc_id"), "doc_id"  # short ones by hash, then longer ones by size
        ids = sized.where(F.col("toxic") == kind).orderBy(*first).limit(per_class[kind]).select("doc_id", "toxic").distinct()
        return texts(docs).join(F.broadcast(ids), "doc_id").where(F.octet_length("text") <= LONGER * max_bytes).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[kind])

    return picked(0).unionByName(picked(1)).select("doc_id", "text", "toxic"), float(share or 0.0)


def _fit(share: float):
    """One task learns from the sample and gives the pickled model back, or nothing without both labels."""

    def run(batches):
        rows = [(t.encode("utf-8", "replace"), int(y), i) for b in batches for i, t, y in zip(*(B.column(b, c).to_pylist() for c in ("doc_id", "text", "toxic")))]
        rows.sort(key=lambda r: (r[1], r[2], r[0]))  # the order of a shuffle must not matter
        sample = [(t, y) for t, y, _ in rows]
        if len({y for _, y in sample}) == 2:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(sample, share))], pa.binary())], names=["model"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS):
    """((network, slope, intercept), share); the model's size is fixed by ``VOCAB`` and ``GRAMS``."""
    sample, share = sample_rows(docs, labels, per_class)
    found = arrow_map(sample.coalesce(1), _fit(share), "model binary").collect()
    return (pickle.loads(found[0].model) if found else (None, 0.0, 0.0)), share


def _score(model, share: float):
    def run(batches):
        net, slope, shift = model.value
        for batch in batches:
            for part, data, offs in B.slices(batch, max_bytes=1 << 20):
                if net is None:
                    q = np.full(part.num_rows, share)
                else:
                    best, has, _ = scores(net, words(data, offs), part.num_rows)
                    q = np.where(has, _sigmoid(slope * np.where(has, best, 0).astype(np.float64) + shift), share)
                yield pa.RecordBatch.from_arrays([B.column(part, "doc_id"), pa.array(q)], names=["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, *, per_class: tuple[int, int] = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from the rows of ``labels`` that aren't held out."""
    fitted, share = fit(docs, labels, per_class)
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    out = arrow_map(texts(docs), _score(model, share), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
