"""Every query by its contract, against plain programs that share no code with the operators."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from deltaweave.llm import langid, lattice, lines, maxscore, minhash, pieces, quality

from .helpers import docs, save, table, words
from .test_lines import brute as brute_lines
from .test_maxscore import SCHEMA as VECTORS
from .test_maxscore import brute as brute_top
from .test_minhash import brute as brute_near

MASK = (1 << 64) - 1


def held(i, modulus, remainder):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == remainder


def odd_rows(rng, n=40):
    rows = list(enumerate(docs(rng, n, vocabulary=30, most=30)))
    return [*rows, (500, None), (501, ""), (502, " \n\t"), (None, "null id a b c d"), (None, None), (3, rows[3][1]), (503, "Ünï ΣΑΣ 日本語 123 $$"), (504, "word " * 9000), (505, "x" * 60_000)]


# --- 1, 3, 5


def test_op1(spark, tmp_path):
    rows = [r for r in odd_rows(random.Random(1)) if r[0] is not None]
    save(table(spark, rows), tmp_path, "documents")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.op1_minhash_dedup(spark, str(tmp_path)).collect()}
    assert got == brute_near(dict(rows).items(), 4, 80)


def test_op3(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [round(rng.gauss(0, 1) * 64) / 64 for _ in range(8)], "x") for i in range(300)] + [(None, [1.0] * 8, "x"), (350, None, "x"), (400, [float("nan")] * 8, "x")]
    save(spark.createDataFrame(rows, VECTORS), tmp_path, "embeddings")
    got = maxscore.op3_topk_search(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 5, 50)


def test_op5(spark, tmp_path):
    rng = random.Random(3)
    pool = [f"a line that is common {k}" for k in range(6)] + ["short", ""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(50)] + [(None, pool[0]), (60, None), (61, "")]
    save(table(spark, rows), tmp_path, "documents")
    got = sorted((tuple(r) for r in lines.op5_line_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, n, lost, hashlib.sha256(t.encode()).hexdigest()) for i, n, lost, t in brute_lines(rows)), key=str)


# --- 2


def best_pieces(text, v):
    """The best segmentation of a whole text, position by position; ties go to the longer last piece."""
    if not text:
        return []
    if not hasattr(v, "by_name"):
        v.by_name = {v.spelled[i].decode("utf-8", "replace"): i for i in v.ids.tolist()}
    marked = " " + text.replace("▁", "\U0010fffe")
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(marked)
    for e in range(1, len(marked) + 1):
        for size in range(1, min(e, v.longest) + 1):
            i = v.by_name.get(marked[e - size : e])
            s = v.scores[i] if i is not None else v.unknown_score if size == 1 else -math.inf
            if best[e - size][0] + s >= best[e][0]:
                best[e] = (best[e - size][0] + s, size)
    out, e = [], len(marked)
    while e:
        size = best[e][1]
        i = v.by_name.get(marked[e - size : e])
        c = marked[e - size : e].replace("\U0010fffe", "▁")
        out = ([i] if i is not None else v.byte_ids[list(c.encode())].tolist()) + out
        e -= size
    return out


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")
def test_op2(spark, tmp_path):
    rows = [r for r in odd_rows(random.Random(4), 15) if r[0] not in (504, 505)] + [(600, "two  spaces ▁ and a mark\n\nlines"), (601, "quick brown foxes jumped"), (602, "\U0001f600 \U0001f600")]
    save(table(spark, rows), tmp_path, "documents")
    v = lattice.zipf_scores(lattice.from_model(pieces.MODEL))
    got = sorted(map(tuple, pieces.op2_sentencepiece(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in rows:
        ids = best_pieces(t or "", v)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert got == sorted(want, key=str)


# --- 7


def plain_features(text):
    text = text or ""
    raw, cased = text.encode(), [w.encode() for w in __import__("re").findall("[^\x20\x09-\x0d]+", text)]
    n, some, size = len(cased), max(1, len(cased)), len(raw)
    grams = [tuple(cased[k : k + 4]) for k in range(n - 3)] if n >= 4 else ([tuple(cased)] if n else [])
    n_lines = raw.count(b"\n") + (size > 0)
    kinds = [b"*$&#%^~@=+<>{}[]\\_`", b"!?", b"|", b"0123456789", b".,;:", bytes(range(65, 91)), bytes(range(128, 256))]
    return [
        math.log1p(n), sum(map(len, cased)) / some, math.log1p(max(map(len, cased), default=0)), len(set(cased)) / some,
        sum(a == b for a, b in zip(cased, cased[1:])) / some, len(set(grams)) / max(1, len(grams)), sum(len(w) < 4 for w in cased) / some,
        math.log1p(n_lines), math.log1p(size / max(1, n_lines)), *[sum(b in kind for b in raw) / max(1, size) for kind in kinds],
    ]


def test_features_by_hand():
    texts = [t for _, t in odd_rows(random.Random(5))]
    assert np.allclose(quality.features(pa.array(texts, pa.string())), [plain_features(t) for t in texts], rtol=1e-5, atol=1e-6)


class PlainModel:
    """The additive model by loops over rows and bins, without arrays over them."""

    def __init__(self, like):
        self.p = like

    def bin(self, x, edges):
        return sum(x >= e for e in edges)

    def sums(self, bins, g, h, m):
        a, b = [0.0] * m, [0.0] * m
        for k, x, y in zip(bins, g, h):
            a[k] += x
            b[k] += y
        return a, b

    def leaves(self, g, h):
        s = self.p.smooth

        def best(lo, hi):
            if hi - lo < 2:
                return 0.0, lo
            whole = sum(g[lo:hi]) ** 2 / (sum(h[lo:hi]) + s)
            options = [(sum(g[lo:c]) ** 2 / (sum(h[lo:c]) + s) + sum(g[c:hi]) ** 2 / (sum(h[c:hi]) + s) - whole, c) for c in range(lo + 1, hi)]
            return max(options, key=lambda o: (round(o[0], 12), -o[1]))

        cuts = {0, len(g)}
        first = best(0, len(g))[1]
        if 0 < first < len(g):
            cuts.add(first)
        edges = sorted(cuts)
        gain, second = max(best(a, b) for a, b in zip(edges, edges[1:]))
        if gain > 0:
            cuts.add(second)
        edges, out = sorted(cuts), []
        for a, b in zip(edges, edges[1:]):
            out += [sum(g[a:b]) / (sum(h[a:b]) + s)] * (b - a)
        return out

    def fit(self, rows, y):
        p, n = self.p, len(rows[0])
        share = (sum(y) + 1) / (len(y) + 2)
        self.intercept = math.log(share / (1 - share))
        column = lambda k: [r[k] for r in rows]
        cuts = lambda k, bins: sorted(set(np.quantile(column(k), [j / bins for j in range(1, bins)]).tolist()))
        self.edges = [cuts(k, p.bins) for k in range(n)]
        self.coarse = [cuts(k, p.coarse) for k in range(n)]
        self.tables = [[0.0] * (len(e) + 1) for e in self.edges]
        fine = [[self.bin(r[k], self.edges[k]) for r in rows] for k in range(n)]
        rough = [[self.bin(r[k], self.coarse[k]) for r in rows] for k in range(n)]
        odds = [self.intercept] * len(y)

        def gradients():
            q = [1 / (1 + math.exp(-o)) for o in odds]
            return [t - x for t, x in zip(y, q)], [x * (1 - x) for x in q]

        for _ in range(p.rounds):
            for k in range(n):
                step = [p.rate * v for v in self.leaves(*self.sums(fine[k], *gradients(), len(self.tables[k])))]
                self.tables[k] = [a + b for a, b in zip(self.tables[k], step)]
                odds = [o + step[b] for o, b in zip(odds, fine[k])]
        g, h = gradients()
        gains = []
        for i in range(n):
            for j in range(i):
                c = len(self.coarse[j]) + 1
                a, b = self.sums([x * c + z for x, z in zip(rough[i], rough[j])], g, h, (len(self.coarse[i]) + 1) * c)
                gains.append((sum(u * u / (w + p.smooth) for u, w in zip(a, b)), i, j))
        self.pairs = [[i, j, None] for _, i, j in sorted(gains, reverse=True)[: p.n_pairs]]
        for pair in self.pairs:
            pair[2] = [[0.0] * (len(self.coarse[pair[1]]) + 1) for _ in range(len(self.coarse[pair[0]]) + 1)]
        for _ in range(p.pair_rounds):
            for i, j, values in self.pairs:
                g, h = gradients()
                na, nc = len(values), len(values[0])
                a, b = self.sums([x * nc + z for x, z in zip(rough[i], rough[j])], g, h, na * nc)
                if na < 2 or nc < 2:
                    continue
                quarter = lambda t, u, w: (u > t[0]) * 2 + (w > t[1])
                best = None
                for t in ((x, z) for x in range(na - 1) for z in range(nc - 1)):
                    q = [[0.0, 0.0] for _ in range(4)]
                    for x in range(na):
                        for z in range(nc):
                            cell = q[quarter(t, x, z)]
                            cell[0] += a[x * nc + z]
                            cell[1] += b[x * nc + z]
                    gain = round(sum(u * u / (w + p.smooth) for u, w in q), 12)
                    if best is None or gain > best[0]:
                        best = (gain, t, [u / (w + p.smooth) for u, w in q])
                for x in range(na):
                    for z in range(nc):
                        values[x][z] += p.rate * best[2][quarter(best[1], x, z)]
                odds = [o + p.rate * best[2][quarter(best[1], x, z)] for o, x, z in zip(odds, rough[i], rough[j])]
        return self

    def score(self, row):
        odds = self.intercept + sum(t[self.bin(x, e)] for x, t, e in zip(row, self.tables, self.edges))
        rough = [self.bin(x, e) for x, e in zip(row, self.coarse)]
        return 1 / (1 + math.exp(-odds - sum(v[rough[i]][rough[j]] for i, j, v in self.pairs)))


def test_model_by_loops():
    rng = np.random.default_rng(6)
    x = np.round(rng.random((150, 4)), 2).astype(np.float32)
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.6) | (rng.random(150) < 0.1)).astype(float)
    settings = dict(bins=6, coarse=3, rounds=6, pair_rounds=5, pairs=2)
    fast = quality.AdditiveModel(**settings).fit(x, y)
    plain = PlainModel(quality.AdditiveModel(**settings)).fit(x.astype(float).tolist(), y.tolist())
    for a, b in zip(fast.tables, plain.tables):
        assert np.allclose(a, b, atol=1e-9)
    assert [(i, j) for i, j, _ in fast.pairs] == [(i, j) for i, j, _ in plain.pairs]
    assert np.allclose(fast.score(x), [plain.score(r) for r in x.astype(float).tolist()], atol=1e-9)


def test_op7(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["good", "plain", "words"]) if i % 3 else rng.choice(["$$", "%%x", "good"]) for _ in range(25))) for i in range(150)]
    rows += [(500, None), (501, ""), (None, "null id"), (3, rows[3][1]), (3, "$$ %%"), (502, "y " * 30_000)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(150)] + [(3, 0, 0)] * 5 + [(None, 0, 0), (7, None, 0), (8, 9, 0)]
    save(table(spark, rows), tmp_path, "documents")
    save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    got = quality.op7_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    training = [(i, y, t) for i, y, _ in labels if i is not None and y in (0, 1) and not held(i, 5, 0) for t in texts[i]]
    training.sort(key=lambda r: (r[0], r[1]))
    x = np.array([plain_features(t) for _, _, t in training], np.float32)
    model = quality.AdditiveModel().fit(x, np.array([float(y) for _, y, _ in training]))
    wanted = {t: float(model.score(np.array([plain_features(t)], np.float32))[0]) for _, t in rows}
    by_text = defaultdict(set)
    for r in got:
        assert r.held_out == held(r.doc_id, 5, 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
        by_text[r.doc_id].add(round(r.score, 6))
    for i, ts in texts.items():
        assert by_text[i] == {round(wanted[t], 6) for t in ts}
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 150 and r.held_out) >= 0.95 * sum(held(i, 5, 0) for i in range(150))


def test_sample_bounds_rows(spark):
    df = table(spark, [(1, f"text {k}") for k in range(60)])
    labels = spark.createDataFrame([(1, 1), (1, 0)] * 20, "doc_id long, label int")
    seen = []
    fit = quality.AdditiveModel.fit
    try:
        quality.AdditiveModel.fit = lambda self, x, y: seen.append(len(y)) or fit(self, x, y)
        quality.fit(df, labels, sample=50)
    finally:
        quality.AdditiveModel.fit = fit
    assert seen == [50]


# --- 9


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_grams(text, buckets=langid.BUCKETS):
    """Buckets of the 1- to 3-grams of a text, letter by letter; all else is one symbol, and runs of it count once."""
    symbols = []
    for c in text:
        small = c.lower() if len(c.lower()) == 1 else c
        symbol = ord(small) if c.isalpha() else 32
        if symbol != 32 or c.isalpha() or not symbols or symbols[-1] != 32:
            symbols.append(symbol)
    out = []
    for k in range(len(symbols)):
        h = None
        for s in symbols[k : k + 3]:
            v = mixed(s + 77)
            h = v if h is None else mixed((h * 0x9E3779B97F4A7C15 + v) & MASK)
            out.append((h >> 20) % buckets)
    return out


def test_op9(spark, tmp_path):
    rng = random.Random(8)
    letters = {"aa": "abcdeé", "bb": "defghÏ", "cc": "日本語abc"}
    rows = [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(4)) for _ in range(8)) + rng.choice(["", ". 12", "!!\n"]), lang) for i in range(120) for lang in [("aa", "bb", "cc")[i % 3]]]
    rows += [(500, None, "aa"), (501, "", "aa"), (502, "12 $$ ..", "bb"), (503, "ÀÉa", None), (None, "abc", "aa"), (4, "repeated row", "aa"), (4, "repeated row", "aa"), (504, "ab " * 40_000, "aa"), (505, "日" * 50_000, "cc")]
    save(table(spark, [(i, t, lang, "s") for i, t, lang in rows]), tmp_path, "documents")
    counts, texts = defaultdict(Counter), Counter()
    for i, t, lang in rows:
        if i is not None and lang is not None and t is not None and not held(i, 4, 2):
            counts[lang].update(plain_grams(t))
            texts[lang] += 1
    logs = {lang: (math.log(texts[lang]), math.log(sum(c.values()) + 0.5 * langid.BUCKETS), c) for lang, c in counts.items()}
    got = sorted(map(tuple, langid.op9_language_id(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            want.append((i, held(i, 4, 2), "und", 0.0))
            continue
        grams = Counter(plain_grams(t))
        total = {lang: prior + sum(n * (math.log(c[g] + 0.5) - whole) for g, n in grams.items()) for lang, (prior, whole, c) in logs.items()}
        top = max(total.values())
        best = min(lang for lang, x in total.items() if x == top)
        want.append((i, held(i, 4, 2), best, 1 / sum(math.exp(x - top) for x in total.values())))
    for g, w in zip(got, sorted(want, key=str)):
        assert g[:3] == w[:3] and math.isclose(g[3], w[3], rel_tol=2e-3, abs_tol=1e-6)
    assert words("a b")
