"""A bidirectional gated recurrent network with attention pooling over windows of words, in numpy.

A word enters as learned vectors of the word itself and of its byte n-grams, and as how much more often the word and
its n-grams stand in documents of label 1. A document's score is that of its highest window.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .common import flat, mix, prefix_hash, ragged, span_hash, words

HIDDEN, DIM, FIXED = 8, 8, 3
GRAMS, ODDS = 1 << 12, 1 << 17  # rows of the n-gram vectors, slots of the n-gram odds
WINDOW, STRIDE = 48, 24  # a passage of up to 24 words stands whole in some window
INK = np.zeros(256, bool)
INK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Text:
    """Texts as word numbers: distinct words, the words of all texts in order, words per text."""

    distinct: np.ndarray
    stream: np.ndarray
    per: np.ndarray
    gram_word: np.ndarray
    gram_hash: np.ndarray


def read(texts) -> Text:
    """texts: an Arrow string array, lower case."""
    data, offsets = flat(texts)
    starts, ends, per = words(data, offsets, INK[data])
    prefix = prefix_hash(data)
    distinct, first, stream = np.unique(span_hash(prefix, starts, ends), return_index=True, return_inverse=True)
    s, n = starts[first], (ends - starts)[first]
    gw, gh = [], []
    for size in (3, 4, 5, 6):
        row, place = ragged(np.maximum(n - size + 1, 0))
        gw.append(row)
        gh.append(span_hash(prefix, s[row] + place, s[row] + place + size))
    row, order = np.concatenate(gw), None
    order = np.argsort(row, kind="stable")
    return Text(distinct, stream, per, row[order], np.concatenate(gh)[order])


def read_all(texts, at_once: int = 200) -> Text:
    """As read(), a few texts at a time: what it takes besides its result does not grow with their number."""
    parts = [read(texts.slice(i, at_once)) for i in range(0, max(1, len(texts)), at_once)]
    base = np.cumsum([0, *(len(t.distinct) for t in parts)])
    distinct, first, to = np.unique(np.concatenate([t.distinct for t in parts]), return_index=True, return_inverse=True)
    word, gram = [], []
    for t, lo in zip(parts, base, strict=False):
        own = to[lo + t.gram_word]
        new = first[own] == lo + t.gram_word  # a word's n-grams come from the first part that has it
        word.append(own[new].astype(np.int32))
        gram.append(t.gram_hash[new])
    row = np.concatenate(word)
    order = np.argsort(row, kind="stable")
    return Text(distinct, np.concatenate([to[lo + t.stream] for t, lo in zip(parts, base, strict=False)]), np.concatenate([t.per for t in parts]), row[order], np.concatenate(gram)[order])


@dataclass
class Model:
    vocab: np.ndarray  # sorted hashes of the words that have a vector of their own
    word_odds: np.ndarray
    gram_odds: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)


def word_rows(m: Model, t: Text) -> np.ndarray:
    """Row of each distinct word in the word vectors; 0 for words without one."""
    if not len(m.vocab):
        return np.zeros(len(t.distinct), np.int64)
    at = np.minimum(np.searchsorted(m.vocab, t.distinct), len(m.vocab) - 1)
    return np.where(m.vocab[at] == t.distinct, at + 1, 0)


def fixed_inputs(m: Model, t: Text, rows: np.ndarray) -> np.ndarray:
    """The word's odds, the highest of its n-grams' odds and their mean."""
    odds = m.gram_odds[(mix(t.gram_hash) & np.uint64(ODDS - 1)).astype(np.int64)]
    n = np.bincount(t.gram_word, minlength=len(rows))
    high = np.zeros(len(rows), np.float32)
    np.maximum.at(high, t.gram_word, odds)
    mean = np.bincount(t.gram_word, odds, len(rows)) / np.maximum(n, 1)
    return np.stack([m.word_odds[rows], high, mean], 1).astype(np.float32)


def gram_vectors(m: Model, t: Text, n_words: int) -> np.ndarray:
    """Mean vector of each word's n-grams."""
    out = np.zeros((n_words, DIM), np.float32)
    if len(t.gram_word):
        begin = np.flatnonzero(np.concatenate(([True], t.gram_word[1:] != t.gram_word[:-1])))
        n = np.diff(np.append(begin, len(t.gram_word)))
        out[t.gram_word[begin]] = np.add.reduceat(m.p["Ec"][(t.gram_hash & np.uint64(GRAMS - 1)).astype(np.int64)], begin, axis=0) / n[:, None]
    return out


def windows(per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first place in the word stream, length) of all overlapping windows; the last ends with the text."""
    n = np.where(per == 0, 0, np.where(per <= WINDOW, 1, 1 + -(-(per - WINDOW) // STRIDE)))
    text, k = ragged(n)
    base = np.cumsum(per) - per
    start = np.minimum(k * STRIDE, np.maximum(per[text] - WINDOW, 0))
    return text, base[text] + start, np.minimum(per[text], WINDOW)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-x))


def forward(p: dict, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: bool):
    """Logits of windows. x: input rows of words; idx, mask: (WINDOW, n)."""
    n, states, trace = idx.shape[1], np.empty((idx.shape[0], idx.shape[1], 2 * HIDDEN), np.float32), {}
    for side, order in (("f", range(len(idx))), ("b", range(len(idx) - 1, -1, -1))):
        proj = x @ p["W" + side] + p["c" + side]
        h, u, log = np.zeros((n, HIDDEN), np.float32), p["U" + side], []
        lo = 0 if side == "f" else HIDDEN
        for t in order:
            g, hu = proj[idx[t]], h @ u
            zr = sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            a = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = (a + z * (h - a)) * mask[t][:, None]
            if keep:
                log.append((t, h, z, r, a, hu[:, 2 * HIDDEN :]))
            h = new
            states[t, :, lo : lo + HIDDEN] = h
        trace[side] = log
    score = np.where(mask > 0, states @ p["v"], np.float32(-1e9))
    w = np.exp(score - score.max(0))
    w /= w.sum(0)
    pooled = np.einsum("tn,tnh->nh", w, states)
    return pooled @ p["o"] + p["ob"][0], (states, trace, w, pooled)


def backward(p: dict, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, cache, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
    states, trace, w, pooled = cache
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("Ew", "Ec")}
    g["o"], g["ob"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
    dpool = dlogit[:, None] * p["o"]
    dw = np.einsum("tnh,nh->tn", states, dpool)
    dscore = w * (dw - (w * dw).sum(0))
    g["v"] = np.einsum("tn,tnh->h", dscore, states)
    dstates = w[:, :, None] * dpool + dscore[:, :, None] * p["v"]
    dx = np.zeros_like(x)
    for side in "fb":
        lo, u, W = (0 if side == "f" else HIDDEN), p["U" + side], p["W" + side]
        dproj, dh = np.zeros((len(x), 3 * HIDDEN), np.float32), 0
        for t, h, z, r, a, hn in reversed(trace[side]):
            d = (dstates[t, :, lo : lo + HIDDEN] + dh) * mask[t][:, None]
            da = d * (1 - z) * (1 - a * a)
            gate = np.concatenate([d * (h - a) * z * (1 - z), da * hn * r * (1 - r), da * r], 1)
            g["U" + side] += h.T @ gate
            dh = d * z + gate @ u.T
            gate[:, 2 * HIDDEN :] = da
            np.add.at(dproj, idx[t], gate)
        g["W" + side] += x.T @ dproj
        g["c" + side] += dproj.sum(0)
        dx += dproj @ W.T
    return g, dx


def layout(start: np.ndarray, length: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = start[None, :] + np.arange(WINDOW)[:, None]
    mask = np.arange(WINDOW)[:, None] < length[None, :]
    return stream[np.where(mask, at, 0)] if len(stream) else np.zeros_like(at), mask.astype(np.float32)


def scores(m: Model, t: Text, block: int = 1024) -> np.ndarray:
    """Scores in (0, 1) of texts: the sigmoid of the highest window's logit; texts without words get that of no evidence."""
    out = np.full(len(t.per), m.p["none"][0], np.float32)
    text, start, length = windows(t.per)
    if len(text):
        rows = word_rows(m, t)
        x = np.concatenate([fixed_inputs(m, t, rows), m.p["Ew"][rows], gram_vectors(m, t, len(rows))], 1).astype(np.float32)
        logit = np.concatenate([forward(m.p, x, *layout(start[i : i + block], length[i : i + block], t.stream), False)[0] for i in range(0, len(text), block)])
        begin = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        out[text[begin]] = np.maximum.reduceat(logit, begin)
    return sigmoid(out.astype(np.float64))


def smoothed(k1: np.ndarray, k0: np.ndarray, label: np.ndarray, prior: float = 3.0) -> np.ndarray:
    n1, n0 = max(1, int(label.sum())), max(1, int((1 - label).sum()))
    return np.log((k1 + prior) / n1 / ((k0 + prior) / n0)).astype(np.float32)


def odds(hash_: np.ndarray, text: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, their smoothed log odds, texts that hold them)."""
    pair = np.unique(np.stack([hash_, text.astype(np.uint64)], 1), axis=0)
    keys, at = np.unique(pair[:, 0], return_inverse=True)
    one = label[pair[:, 1].astype(np.int64)]
    k1, k0 = np.bincount(at, one, len(keys)), np.bincount(at, 1 - one, len(keys))
    return keys, smoothed(k1, k0, label), k1 + k0


def fit(texts, label: np.ndarray, seed: int = 11, epochs: int = 6, batch: int = 64, most_words: int = 1 << 15, rate: float = 0.01) -> Model:
    """Trains on whole texts: each text's loss is that of its highest window, with the classes weighted equally."""
    rng, label, t = np.random.default_rng(seed), label.astype(np.float64), read_all(texts)
    text_of = np.repeat(np.arange(len(t.per)), t.per)
    keys, lo, df = odds(t.distinct[t.stream], text_of, label)
    top = np.sort(np.lexsort((keys, -df))[:most_words])
    top = top[df[top] >= 2]
    m = Model(keys[top], np.concatenate(([np.float32(0)], lo[top])), np.zeros(ODDS, np.float32))
    begin = np.searchsorted(t.gram_word, np.arange(len(t.distinct) + 1))
    slot = (mix(t.gram_hash) & np.uint64(ODDS - 1)).astype(np.int64)
    held = np.zeros((2, ODDS))  # texts of each label that hold an n-gram, counted once a text
    pair = np.unique(np.stack([text_of, t.stream], 1), axis=0)
    cut = np.searchsorted(pair[:, 0], np.arange(0, len(t.per) + 100, 100))
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        d, w = pair[lo:hi].T
        row, place = ragged(begin[w + 1] - begin[w])
        both = np.unique(d[row] << 20 | slot[begin[w][row] + place])
        for y in (0, 1):
            held[y] += np.bincount(both[label[both >> 20] == y] & (ODDS - 1), minlength=ODDS)
    some = held.sum(0) > 0
    m.gram_odds[some] = smoothed(held[1][some], held[0][some], label)
    width = FIXED + 2 * DIM
    shape = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    m.p = {f"W{s}": shape(width, 3 * HIDDEN) for s in "fb"} | {f"U{s}": shape(HIDDEN, 3 * HIDDEN) for s in "fb"} | {f"c{s}": np.zeros(3 * HIDDEN, np.float32) for s in "fb"}
    m.p |= {"v": shape(2 * HIDDEN), "o": shape(2 * HIDDEN), "ob": np.zeros(1, np.float32), "Ew": shape(len(m.vocab) + 1, DIM) * np.float32(0.1), "Ec": shape(GRAMS, DIM) * np.float32(0.1), "none": np.array([-4], np.float32)}
    m.p["Ew"] = (rng.standard_normal((len(m.vocab) + 1, DIM)) * 0.05).astype(np.float32)
    m.p["Ec"] = (rng.standard_normal((GRAMS, DIM)) * 0.05).astype(np.float32)
    rows, own = word_rows(m, t), None
    own = fixed_inputs(m, t, rows)
    bucket = (t.gram_hash & np.uint64(GRAMS - 1)).astype(np.int64)
    text, start, length = windows(t.per)
    by = np.searchsorted(text, np.arange(len(t.per) + 1))
    some = np.flatnonzero(t.per > 0)
    ones, zeros = some[label[some] == 1], some[label[some] == 0]
    if not len(ones) or not len(zeros):  # nothing to tell apart: every text scores the smoothed share of label 1
        share = (label.sum() + 0.5) / (len(label) + 2)
        m.p["o"][:] = 0
        m.p["ob"][:] = m.p["none"][:] = np.log(share / (1 - share))
        return m
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.p.items()}
    rounds, step = max(80, epochs * (len(some) // batch + 1)), 0
    for _ in range(rounds):
        pick = np.concatenate([rng.choice(ones, batch // 2), rng.choice(zeros, batch // 2)])
        y = label[pick].astype(np.float32)
        wins = np.concatenate([np.arange(by[d], by[d + 1]) for d in pick])
        of = np.repeat(np.arange(len(pick)), by[pick + 1] - by[pick])
        used, local = np.unique(np.concatenate([t.stream[start[w] : start[w] + length[w]] for w in wins]), return_inverse=True)
        hidden = rng.random(len(used)) < 0.3  # words left to their n-grams alone
        r = np.where(hidden, 0, rows[used])
        fixed = own[used].copy()
        fixed[hidden, 0] = 0
        gl = begin[used + 1] - begin[used]
        grow, gplace = ragged(gl)
        gb = bucket[begin[used][grow] + gplace]
        cvec = np.zeros((len(used), DIM), np.float32)
        np.add.at(cvec, grow, m.p["Ec"][gb])
        cvec /= np.maximum(gl, 1)[:, None]
        x = np.concatenate([fixed, m.p["Ew"][r], cvec], 1).astype(np.float32)
        begin_w = np.concatenate(([0], np.cumsum(length[wins])))[:-1]
        idx, mask = layout(begin_w, length[wins], local)
        logit, _ = forward(m.p, x, idx, mask, False)
        best = np.array([np.flatnonzero(of == d)[np.argmax(logit[of == d])] for d in range(len(pick))])
        idx, mask = idx[:, best], mask[:, best]
        logit, cache = forward(m.p, x, idx, mask, True)
        g, dx = backward(m.p, x, idx, mask, cache, ((sigmoid(logit) - y) / len(pick)).astype(np.float32))
        g["Ew"], g["Ec"] = np.zeros_like(m.p["Ew"]), np.zeros_like(m.p["Ec"])
        np.add.at(g["Ew"], r, dx[:, FIXED : FIXED + DIM])
        np.add.at(g["Ec"], gb, (dx[:, FIXED + DIM :] / np.maximum(gl, 1)[:, None])[grow])
        g["none"] = np.zeros(1, np.float32)
        step += 1
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k, v in g.items():
            v = v * min(1.0, 5.0 / (norm + 1e-9))
            a, b = moment[k]
            a += 0.1 * (v - a)
            b += 0.01 * (v * v - b)
            m.p[k] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m
