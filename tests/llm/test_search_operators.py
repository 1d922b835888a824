"""Top-k search, collocations and spelling variants against plain versions, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from check_oracles import connect, differences
from helpers import awkward, lower

from setwright.llm import collocations, pivots, spellings

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_exact_topk", "op12_collocations"])
def test_query_equals_sql(spark, name):
    assert differences(spark, connect(SF), name, SF) is None


# --- exact top-k


def nearest(rows, k, every, scale=256):
    """Query key, rank, key and score, over all pairs."""
    live = [
        (i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (i, q) in enumerate(live):
        if i is None or i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), j is None, j or 0, b) for b, (j, v) in enumerate(live) if b != a]
        for rank, (s, _, _, b) in enumerate(sorted(scored)[:k]):
            out.append((i, rank + 1, live[b][0], -s))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_topk_over_many_blocks(spark):
    """Clusters, copies of one vector in a third of all rows, and several blocks to a cell."""
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(900):
        rows.append((i, centres[0] if i % 3 == 0 else [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    assert found(pivots.top_k(df, k=4, every=20, pivots=5, block_rows=70)) == nearest(rows, 4, 20)


def test_topk_edge_cases(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [0.5]), (50, []), (100, None), (150, [1.0, None]), (200, [float("nan"), 1.0]),
        (250, [float("inf")]), (None, [1.0, 2.0]), (3, [-0.001, 1e-9]), (4, [1e5, -1e5, 3.0]), (5, [2.0, 1.5]), (300, [0.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id bigint, embedding array<double>, uid int, v int, block int")
    assert found(pivots.top_k(df)) == nearest(rows, 5, 50)
    assert pivots.top_k(df.limit(0)).count() == 0
    assert pivots.top_k(df.filter("vec_id = 3")).count() == 0
    assert found(pivots.top_k(df.filter("vec_id = 0 OR vec_id = 3"))) == nearest(rows[:2] + [rows[9]], 5, 50)
    # Scores past the whole numbers of a double are exact too; vectors too long for a score are left out.
    big = [(0, [2.0**20 + 1 / 256, 3.0]), (1, [2.0**20 + 3 / 256, 7 / 256]), (2, [1e300]), (3, [2.0**20, 0.0])]
    df = spark.createDataFrame(big, "vec_id bigint, embedding array<double>")
    assert found(pivots.top_k(df)) == nearest([b for b in big if b[0] != 2], 5, 50)


def test_topk_stops_early():
    """Where bounds are sharp, most vectors are never evaluated."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * np.concatenate([rng.normal(0, 0.01, (50, 4)) + 1, rng.normal(0, 0.01, (3000, 4)) - 1])).astype(np.int64)
    points = x[[0, 100, 200]].astype(float)
    d = np.sqrt(((x[:, None, :] - points) ** 2).sum(axis=2)).astype(np.float32)
    rows = pa.table({"uid": np.arange(len(x)), "id": np.arange(len(x)), "v": list(x), "sq": (x * x).sum(axis=1).astype(float), "d": list(d)})
    block = pivots.Block(rows, 4)
    asked = []
    block.scores = lambda q, sq, at: asked.append(len(at)) or block.whole[at] @ q
    bound = block.bounds(d[:1], (x[:1] * x[:1]).sum(axis=1).astype(float))[0]
    assert (bound >= x @ x[0]).all()
    places, scores = block.best(0, x[0], float(x[0] @ x[0]), bound, 5, -np.inf)
    others = np.sort((x @ x[0])[1:])[::-1][:5]
    assert sorted(scores, reverse=True) == others.tolist() and sum(asked) < 600


# --- collocations


def phrases(docs, most=3, least=10, covered=50, first=2000):
    f, total = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            inside = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= covered * a for b in inside):
                continue
            score, _, l, r = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:first]):
            out.append((lang, rank + 1, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out, key=repr)


def texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "the", "The", "日本", "\x00x"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    gaps = [" "] * 8 + ["  ", "\t", ", ", ".", "\n", "\r\n", " ! ", "\xa0"]
    return [
        (rng.choice(["en", "de", "und", None]), "".join(x for w in rng.choices(vocabulary, weights, k=rng.randrange(1, 80)) for x in (w, rng.choice(gaps))))
        for _ in range(n)
    ]


@pytest.mark.parametrize("most", [2, 3, 4])
def test_collocations_equal_plain_counts(spark, most):
    docs = texts(most)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    assert found(collocations.collocations(df, most=most, least=5)) == phrases(docs, most, 5)


def test_collocations_of_long_texts(spark):
    """A text in many stretches counts as one; words longer than a stretch stay whole."""
    rng = random.Random(7)
    words = rng.choices(["alpha", "beta", "gamma", "delta,", "x" * 300, "a\tb\n"], k=4000)
    docs = [("en", " ".join(words)), ("en", "y" * 5000), ("en", "alpha  beta " * 700), ("en", "")]
    df = spark.createDataFrame(docs, "lang string, text string")
    assert found(collocations.collocations(df, limit=256)) == phrases(docs)


def test_collocations_edge_cases(spark):
    rows = [r.text for r in awkward(spark).collect()]
    langs = [r.lang for r in awkward(spark).collect()]
    df = awkward(spark)
    assert found(collocations.collocations(df.unionAll(df), least=2)) == phrases(list(zip(langs, rows)) * 2, least=2)
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.filter("text IS NULL")).count() == 0


def test_first_phrases_are_ranked_in_slots(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_SLOT_ROWS", 40)
    docs = texts(11, 200)
    df = spark.createDataFrame(docs, "lang string, text string")
    assert found(collocations.collocations(df, least=3, first=7)) == phrases(docs, least=3, first=7)


# --- spelling variants


def variants(docs, letters=6, least=5, ratio=5, slip=199):
    n = Counter()
    for key, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}

    def near(v, w):
        if len(v) > len(w):
            v, w = w, v
        if len(v) == len(w):
            return sum(a != b for a, b in zip(v, w)) == 1
        return len(w) == len(v) + 1 and any(w[:i] + w[i + 1 :] == v for i in range(len(w)))

    close = {w: [v for v in n if v != w and near(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def misspelt(seed, n=400):
    rng = random.Random(seed)
    base = ["letter", "lettter", "aaaaaa", "aaaaaaa", "aaaaab", "bécasse", "becasse", "ÀÉÎÕÜß", "abcabc", "x" * 60, "x" * 61, "x" * 59 + "y", "short"]
    words = []
    for k in range(n):
        w = base[min(int(rng.expovariate(0.35)), len(base) - 1)]
        if rng.random() < 0.3:
            at = rng.randrange(len(w))
            w = w[:at] + rng.choice(["", rng.choice("abte"), w[at] + rng.choice("abte")]) + w[at + 1 :]
        words.append(w.upper() if rng.random() < 0.1 else w)
    return [(rng.choice([None, k]), " ".join(words[k : k + 20]) + rng.choice(["", "×÷7"])) for k in range(0, n, 20)]


@pytest.mark.parametrize("slip", [0, 3, 199])
def test_spellings_equal_all_pairs(spark, slip):
    docs = misspelt(slip, 1200)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = found(spellings.spellings(df, least=2, ratio=2, slip=slip))
    assert got == variants(docs, least=2, ratio=2, slip=slip) and any(r[1] for r in got)


def test_spellings_of_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert found(spellings.spellings(df)) == variants(docs)


def test_forms_lead_to_roots(spark):
    """A chain of forms is followed to its end."""
    chain = ["aaaaaaa", "baaaaaa", "bbaaaaa", "bbbaaaa", "bbbbaaa", "bbbbbaa"]
    docs = [(1, " ".join(w for k, w in enumerate(chain) for _ in range(3 ** (k + 1))))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = found(spellings.spellings(df, least=1, ratio=3, slip=0))
    assert got == variants(docs, least=1, ratio=3, slip=0) and {r[2] for r in got} == {chain[-1]}


def test_spellings_edge_cases(spark):
    df = awkward(spark)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert found(spellings.spellings(df, letters=1, least=1)) == variants(docs, letters=1, least=1)
    assert spellings.spellings(df.limit(0)).count() == 0
    assert spellings.spellings(df.filter("text IS NULL")).count() == 0
