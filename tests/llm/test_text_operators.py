"""Operators over documents against plain versions, and their edge cases."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from helpers import AWKWARD, awkward, base_counts, components, hits, sha, without_repeats
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library
from tokenizers import models, pre_tokenizers

from setwright.llm import bpe, gru, jaccard, outliers, quality, spans, unigram, wumanber

SF = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def edited(seed: int, groups: int = 30) -> list[tuple[int, str]]:
    """Texts and near copies of them, from one word up."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    docs = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 9, 11, 12, 14, 20, 22, 25, 28, 40, 90, 150]))
        for _ in range(rng.choice([1, 3, 7])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[rng.choice(vocabulary)], [], [w[at], rng.choice(vocabulary)]])
                w = w or ["w0"]
            docs.append((len(docs), " ".join(w)))
    return docs


# --- BPE


@pytest.fixture(scope="module")
def tokenizers():
    with open(WORD_BPE, encoding="utf-8") as f:
        return Library.from_file(WORD_BPE), bpe.Tokenizer(f.read())


def test_bpe_equals_library(tokenizers):
    library, ours = tokenizers
    rng = random.Random(1)
    letters = "abcdetheingion ''sΣςéßİ1234<|!?,.\n\t\x1c 日本語🙂e\u0301"
    for k in range(1500):
        text = "".join(rng.choices(letters, k=rng.randrange(60)))
        text += "<|endoftext|>" + text[:5] + "<|startoftext|>" if k % 10 == 0 else ""
        text += "".join(rng.choices("theinaonr", k=500)) if k % 50 == 0 else ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert ours.ids(text) == ids == ours.ids_fast(text), repr(text)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert "".join(ours.decode(ids)) == decoded
        assert ours.digests(text) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


def test_bpe_window_stays_small(tokenizers):
    """A word of any length is held as no more than its unsettled end."""
    merges = tokenizers[1].merges
    rng = random.Random(2)
    symbols = rng.choices("thein", k=5000)
    held = []

    def feed():
        for k, s in enumerate(symbols):
            held.append(k)
            yield s + ("</w>" if k == len(symbols) - 1 else "")

    behind, done = 0, 0
    for token in merges.stream(feed()):
        done += len(merges.symbols(merges.names[token]))
        behind = max(behind, len(held) - done)
    assert done == 5000 and behind <= 6 * merges.lookahead


def test_pairs_apart_equal_running_the_merges(tokenizers):
    merges = tokenizers[1].merges
    rng = random.Random(3)
    open_ended = [i for i in merges.names if not merges.names[i].endswith("</w>")][:4000]
    for _ in range(5000):
        a, b = rng.choice(open_ended), rng.randrange(8000)
        both = merges.symbols(merges.names[a]) + merges.symbols(merges.names[b])
        assert merges.apart(a, b) == (merges.run(both) == [a, b])


def test_byte_level_decoding_is_incremental():
    spec = '{"model":{"type":"BPE","vocab":{%s},"merges":[]},"added_tokens":[],"normalizer":{"type":"Sequence","normalizers":[{"type":"NFC"},{"type":"Replace"},{"type":"Lowercase"}]},"pre_tokenizer":{"pretokenizers":[{"type":"Split","invert":true,"pattern":{"Regex":"[^ ]+"}},{"type":"ByteLevel","use_regex":false,"add_prefix_space":false}]},"decoder":{"type":"ByteLevel"}}'
    symbols = bpe.byte_symbols()
    import json

    ours = bpe.Tokenizer(spec % ",".join(f"{json.dumps(s)}:{b}" for b, s in enumerate(symbols)))
    parts = list(ours.decode("é🙂".encode()))
    assert parts == ["", "é", "", "", "", "🙂", ""]
    assert list(ours.decode([0xC3]))[-1] == "\ufffd"


def test_bpe_edge_cases(spark):
    rows = bpe.bpe_digests(awkward(spark), WORD_BPE).collect()
    assert len(rows) == len(AWKWARD)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1][1:] == by[2][1:] == by[3][1:] == (0, sha(""), sha(""))
    assert by[6].n_tokens == 20_000
    assert bpe.bpe_digests(awkward(spark).limit(0), WORD_BPE).count() == 0
    ids = {r.doc_id: r.ids for r in bpe.bpe_ids(awkward(spark), WORD_BPE).collect() if r.doc_id}
    back = {r.doc_id: r.decoded_sha256 for r in bpe.bpe_ids(awkward(spark), WORD_BPE).collect() if r.doc_id}
    assert back == {r.doc_id: r.decoded_sha256 for r in rows if r.doc_id}
    assert sha(" ".join(map(str, ids[8]))) == by[8].ids_sha256


# --- unigram counts


def test_unigram_equals_library():
    marked = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    pieces = unigram.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    tied = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.5), ("b", -1.5), ("ab", -3.0), ("ba", -3.0), ("aba", -4.5), ("▁a", -3.5), ("bb", -2.5), ("c", -9.0)]
    for vocabulary, fallback, letters in ((pieces, True, "abcdetheingion  \n'sßé1<>|!.,日本▁🙂"), (tied, False, "abcxz ")):
        library = Library(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
        library.pre_tokenizer = marked
        ours = unigram.Unigram(vocabulary, fallback)
        rng = random.Random(4)
        for _ in range(1500):
            text = "".join(rng.choices(letters, k=rng.randrange(40)))
            assert ours.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_unigram_edge_cases(spark):
    pieces = unigram.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in unigram.token_counts(awkward(spark), pieces).collect()}
    assert got[1] == got[2] == 0 and got[6] >= 20_000
    assert unigram.token_counts(awkward(spark).limit(0), pieces).count() == 0


# --- decontamination


@pytest.mark.parametrize("seed", range(3))
def test_windows_equal_comparing_everywhere(spark, seed):
    rng = random.Random(seed)
    words = ["Ab", "c1", "é", "the", "of"]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate([0, 1, 2, 3, 9, 10, 11, 14, 25])] + [(50, None), (51, "Ab c1 é"), (52, "ab, C1; é")]
    docs = [(k, " ".join(rng.choices(words + ["x", "y"], k=rng.choice([0, 3, 12, 60, 700])))) for k in range(25)]
    docs += [(100 + k, f"x y {t} y") for k, (_, t) in enumerate(items)] + [(200, None)]
    for chosen in (items, [i for i in items if len((i[1] or "").split()) >= 9]):
        benchmark = spark.createDataFrame(chosen, "item_id bigint, text string")
        found = wumanber.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), benchmark)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()}
        for d, text in docs:
            n, hit, names = hits(text, chosen)
            assert got[d] == (n, hit, len(names), sha(",".join(names)), hit > 0)


def test_benchmark_in_several_blocks(spark, monkeypatch):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, wumanber.contamination(documents(spark), benchmark).collect()))
    monkeypatch.setattr(wumanber, "PATTERNS_PER_BLOCK", 400)
    assert sorted(map(tuple, wumanber.contamination(documents(spark), benchmark).collect())) == whole


def test_blocks_meet_awkward_rows(spark, monkeypatch):
    """Repeated rows, null ids and items without an id come out alike from one block and from several."""
    items = [(None, "One two"), (None, "three"), (7, "three"), (8, "then three"), (9, "two"), (9, "two"), (None, None)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = awkward(spark).unionByName(awkward(spark)).select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(70, "one two, then three"), (None, "three")], docs.schema))

    def order(r):
        return (r[0] is not None, r[0] or 0, *r[1:])

    whole = sorted(map(tuple, wumanber.contamination(docs, benchmark).collect()), key=order)
    left = sorted(map(tuple, wumanber.decontaminated(docs, benchmark).collect()), key=repr)
    monkeypatch.setattr(wumanber, "PATTERNS_PER_BLOCK", 4)
    assert sorted(map(tuple, wumanber.contamination(docs, benchmark).collect()), key=order) == whole
    assert sorted(map(tuple, wumanber.decontaminated(docs, benchmark).collect()), key=repr) == left


def test_one_suffix_for_many_patterns(monkeypatch):
    """Windows that share their last words, and different windows of one hash, are told apart."""
    import numpy as np
    import pyarrow as pa

    from setwright.llm.textarrays import ALNUM, Words, flat

    items = pa.array([f"w{k} a b c d e f g same end" for k in range(500)])
    text = pa.array(["x " + " y ".join(items[k].as_py() for k in (3, 77, 499)) + " w9999 a b c d e f g same end"])
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(wumanber, "run_hashes_at", lambda hashes, at, length: np.zeros(len(at), np.uint64))
        [patterns] = wumanber.tables(items, 10)
        raw, off = flat(text)
        found = Words(raw, off, ALNUM)
        where, which = patterns.search(found, found.hashes())
        got = sorted((w, patterns.owners(p)) for w, p in zip(where.tolist(), which.tolist()))
        assert got == [(1, [3]), (12, [77]), (23, [499])]


def test_decontamination_edge_cases(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    rows = wumanber.contamination(awkward(spark), none).collect()
    assert len(rows) == len(AWKWARD) and not any(r.contaminated for r in rows)
    one = spark.createDataFrame([(1, "two"), (None, "one")], "item_id bigint, text string")
    assert {r.doc_id for r in wumanber.contamination(awkward(spark), one).collect() if r.contaminated} == {4, 5}
    assert wumanber.decontaminated(awkward(spark), one).count() == len(AWKWARD) - 3
    assert wumanber.contamination(awkward(spark).limit(0), one).count() == 0


# --- Jaccard join


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_equals_all_pairs(spark, width, percent):
    docs = edited(width) + [(1000, None), (1001, ""), (1002, "One two"), (1003, "one  TWO"), (1004, "one")]
    got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string"), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(dict(docs), width, percent)


@pytest.mark.parametrize("light", [0, 32])
def test_jaccard_does_not_depend_on_the_boundary(spark, monkeypatch, light):
    monkeypatch.setattr(jaccard.Threshold, "boundary", lambda self, sizes: min(light, 24))
    docs = edited(9, 20)
    got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string"), 3, 90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(dict(docs), 3, 90)


def test_group_of_near_copies_makes_few_pairs(spark):
    """Pairs of a large group are neither made nor lost."""
    base = [f"b{k}" for k in range(300)]
    docs = []
    for k in range(200):
        w = list(base)
        w[k] = f"own{k}"
        docs.append((k, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = jaccard.jaccard_components(frame, 3, 90).collect()
    assert {r.component_id for r in got} == {0}


def test_jaccard_edge_cases(spark):
    got = jaccard.jaccard_components(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[1].n_shingles, by[1].component_id) == (0, 1) and by[5].component_id == 4
    assert jaccard.jaccard_components(awkward(spark).limit(0)).count() == 0
    left = jaccard.one_of_each(awkward(spark), 3, 90)
    assert left.columns == awkward(spark).columns
    assert left.filter("doc_id IN (4, 5)").count() == 1 and left.count() == len(AWKWARD) - 2


# --- spans


def test_spans_equal_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).orderBy("doc_id").collect()]
    passage = " ".join(f"This is sentence {k} of a passage that two documents share." for k in range(6))
    docs += [(10_000, f"Start here now. {passage} And an end."), (10_001, f"Another start. {passage}"), (10_002, passage + "\n" + passage), (10_003, None)]
    got = spans.dedup_spans(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    expected = without_repeats(docs, spans.SENTENCES, spans.WORDS, spans.EDGE)
    assert {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in got} == expected
    by = {r.doc_id: r.text for r in got}
    assert passage in by[10_000] and "passage" not in by[10_001] and by[10_002].strip() == ""


def test_passages_are_found_wherever_they_stand(spark):
    """Passages of 51 words at random places of other texts, with and without stops, do not fall through."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(3000)]

    def prose(n, stops):
        return [rng.choice(vocabulary) + ("." if stops and rng.random() < 0.08 else "") for _ in range(n)]

    rows, places = [], {}
    for k in range(400):
        stops = k % 2 == 0
        passage = prose(51, stops)
        for twin in (0, 1):
            host = prose(120, stops)
            at = rng.randrange(len(host))
            rows.append((2 * k + twin, " ".join(host[:at] + passage + host[at:])))
        places[2 * k + 1] = passage
    got = spans.dedup_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    before = dict(rows)
    lost = {r.doc_id: len(before[r.doc_id].split()) - len(r.text.split()) for r in got}
    assert all(lost[d] == 0 for d in lost if d not in places)
    share = [lost[d] / 51 for d in places]
    assert sum(x > 0 for x in share) >= 0.995 * len(share) and sum(x >= 0.5 for x in share) >= 0.97 * len(share)
    assert all(x <= 1 for x in share)


def test_tail_of_a_copied_text_goes_too(spark):
    body = "One sentence of eight words stands right here. Another one with eight words comes after that. End of it."
    rows = [(1, body), (2, body), (3, "Yes it is. " + body)]
    got = {r.doc_id: r.text for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == body and got[2].strip() == "" and got[3].strip() == "Yes it is."


def test_spans_edge_cases(spark):
    got = spans.dedup_spans(awkward(spark), keep=("lang",)).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].text is None and by[2].text == "" and by[4].n_removed == 0 and by[9].text == "...\n\n!!!\n---"
    assert spans.dedup_spans(awkward(spark).limit(0)).count() == 0


def test_repeated_rows_are_one_occurrence(spark):
    text = "A sentence of some words is here. Another sentence of some more words follows it there."
    rows = [(1, text), (1, text), (2, text), (1, "Other text. " + text)]
    got = spans.dedup_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sum(r.n_removed == 0 for r in got) == 2 or sum(r.text.startswith("Other") and r.n_removed == 0 for r in got) == 1


# --- quality classifier


def test_trees_separate_and_walk_like_a_plain_tree():
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x, y, trees=20)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + (row[model.feature[t, node]] > model.limit[t, node])
            total += model.leaf[t, node - (2**model.depth - 1)]
        return total

    assert np.allclose([walk(r) for r in x[:50]], model.raw(x[:50]))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert all(r.predicted == (r.score >= 0.7) for r in got)


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, 0), (None, 1), (8, None), (99, 1)], "doc_id bigint, quality int")
    got = quality.quality_scores(awkward(spark), labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    none = quality.quality_scores(awkward(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(awkward(spark).limit(0), labels).count() == 0


# --- outliers


def test_base_counts_equal_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()] + [(9000, "a b c d e f a b c d e f"), (9001, "x " * 30), (9002, "a\n\nb\na\n\n"), (9003, None)]
    got = outliers.text_counts(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    by = {r.doc_id: r for r in got}
    for d, text in docs:
        expected = base_counts(text)
        assert tuple(by[d])[1:6] == expected
        assert by[d].base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])


def plain_units(x):
    """Medians, units and which statistics have no spread."""
    import numpy as np

    at = lambda c, q: np.sort(c)[int(np.ceil(q * len(c))) - 1]
    mid = np.array([at(c, 0.5) for c in x.T], float)
    width = np.array([at(c, 0.75) - at(c, 0.25) for c in x.T], float)
    words = np.exp(mid[4] / 1000)
    chars = words * np.exp(mid[0] / 1000)
    once = 1000 * np.array([np.log(1 + 1 / chars), np.log(1 + 100 / chars), words**-0.5, words**-0.5, np.log(1 + 1 / words)])
    unit = width / 1.349
    for j in np.flatnonzero(width == 0):
        gone = np.abs(x[:, j] - mid[j])
        gone = gone[gone > 0]
        unit[j] = max(once[j], at(gone, 0.5) * np.sqrt(len(gone) / len(x)) if len(gone) else 0)
    return mid, unit, width == 0


def spread_of(z):
    import numpy as np

    return np.cov(z.T, bias=True).reshape(z.shape[1], -1) + 1e-9 * np.eye(z.shape[1])


def test_mcd_equals_exhaustive_search(spark):
    """The least determinant over all subsets of small groups; statistics without spread are left out."""
    from itertools import combinations

    import numpy as np

    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g in range(24):
        n = int(rng.integers(11, 14))
        x = (rng.normal(0, 1, (n, 5)) @ rng.normal(0, 1, (5, 5)) * 100 + 4000).round().astype(int)
        x[:2] += rng.integers(500, 4000, (2, 5))
        if g % 3:
            x[2:, 1] = 0
        if g % 3 == 2:
            x[:, 3] = 7
        mid, unit, flat = plain_units(x)
        z = ((x - mid) / unit)[:, ~flat]
        h = max(int(np.ceil(0.75 * n)), (n + 6) // 2)
        want[f"g{g}"] = min(np.linalg.det(spread_of(z[list(c)])) for c in combinations(range(n), h))
        rows += [(f"g{g}", *map(int, r)) for r in x]
    df = spark.createDataFrame(rows, "g string, x0 bigint, x1 bigint, x2 bigint, x3 bigint, x4 bigint").repartition(3)
    model, _ = outliers.mcd(df, ["g"])
    got = {r.g: r.det for r in model.collect()}
    assert got.keys() == want.keys()
    # None can go below the least; most groups reach it from one of the starts, and the others come near.
    assert all(got[g] >= want[g] * (1 - 1e-6) for g in want)
    assert sum(got[g] <= want[g] * (1 + 1e-6) for g in want) >= 0.7 * len(want)
    assert all((got[g] / want[g]) ** 0.1 < 2 for g in want)


def test_outliers_equal_plain_estimate(spark):
    """The estimates in numpy, drawn to those of larger groups; rows near a cell's edge may differ a little."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = outliers.quality_rules(docs).toPandas()
    rows = outliers.text_counts(docs, keep=("lang", "source")).select("*", *outliers.vector()).toPandas()
    names = [f"x{j}" for j in range(outliers.P)]

    def estimate(x):
        n = len(x)
        mid, unit, flat = plain_units(x)
        live = np.flatnonzero(~flat)
        mean, cov = mid.copy(), np.diag(unit**2)
        if len(live):
            z = ((x - mid) / unit)[:, live]
            size = np.linalg.norm(z, axis=1)
            signs = z / np.where(size > 0, size, 1)[:, None]
            box = z[(np.abs(z) <= 2).all(1)]
            starts = [np.eye(len(live)), signs.T @ signs / n, np.tanh(z).T @ np.tanh(z) / n, box.T @ box / max(1, len(box))]
            h = min(n, max(int(np.ceil(outliers.SUPPORT * n)), (n + 6) // 2))
            best = (np.inf,)
            for c in starts:
                m, c, last = np.zeros(len(live)), c + 1e-9 * np.eye(len(live)), np.inf
                for _ in range(50):
                    near = z[np.argsort(np.einsum("ni,ij,nj->n", z - m, np.linalg.inv(c), z - m), kind="stable")[:h]]
                    m, c = near.mean(0), spread_of(near)
                    if np.linalg.det(c) >= last * (1 - 1e-9):
                        break
                    last = np.linalg.det(c)
                best = min(best, (np.linalg.det(c), m, c), key=lambda b: b[0])
            k = len(live)
            factor = outliers.SUPPORT / outliers.chi2_cdf(outliers.chi2_quantile(outliers.SUPPORT, k), k + 2)
            mean[live] = mid[live] + best[1] * unit[live]
            cov[np.ix_(live, live)] = best[2] * np.outer(unit[live], unit[live]) * factor
        return mean, cov

    def drawn(x, up):
        mean, cov = estimate(x)
        w = len(x) / (len(x) + outliers.PRIOR)
        return w * mean + (1 - w) * up[0], w * cov + (1 - w) * up[1]

    good = rows[~rows.base_failed]
    mean, cov = estimate(good[names].to_numpy(float))
    top, want = (mean, cov + np.eye(5)), {}
    for lang, of_lang in rows.groupby("lang"):
        middle = drawn(good[good.lang == lang][names].to_numpy(float), top)
        for _, part in of_lang.groupby("source"):
            own = part[~part.base_failed][names].to_numpy(float)
            mean, cov = drawn(own, middle) if len(own) else middle
            x = part[names].to_numpy(float) - mean
            want.update(zip(part.doc_id, np.einsum("ni,ij,nj->n", x, np.linalg.inv(cov), x)))
    near = np.array([abs(r.distance2 - want[r.doc_id]) <= 0.02 * (1 + want[r.doc_id]) for r in got.itertuples()])
    cutoff = outliers.chi2_quantile(1 - outliers.TAIL, outliers.P)
    same = np.array([r.kept == (not r.base_failed and want[r.doc_id] <= cutoff) for r in got.itertuples()])
    assert near.mean() > 0.97 and same.mean() > 0.995


def random_words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 7))) for _ in range(n)]


def test_small_groups_use_larger_ones(spark):
    """A small group's estimate is drawn to that of its language and of all; there is none too small for an estimate."""
    rng = random.Random(7)
    plain = lambda: " ".join(random_words(rng, rng.randrange(80, 160)))
    junk = plain() + "".join(f" {c * n}" for n in (28, 29, 30, 31, 32) for c in "#$*|<>&%")
    docs = [(k, plain(), "en", "big") for k in range(outliers.PRIOR)]
    docs += [(100, plain(), "en", "small"), (101, junk, "en", "small"), (102, plain(), None, "small"), (103, junk, None, "small"), (104, "few", "de", None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.quality_rules(frame).collect()}
    assert len(got) == len(docs) and all(r.distance2 is not None for r in got.values())
    assert (got[100].kept, got[101].kept, got[102].kept, got[103].kept, got[104].kept) == (True, False, True, False, False)
    # A smaller table.
    few = {r.doc_id: r for r in outliers.quality_rules(frame.filter("doc_id >= 30 AND doc_id <> 103")).collect()}
    assert not few[101].kept and few[100].kept and few[104].distance2 is not None


def test_each_statistic_can_reject(spark):
    """A tenth of the characters being symbols, or a sixth of the words being repeated, is far from plain texts."""
    rng = random.Random(8)
    docs = [(k, " ".join(random_words(rng, rng.randrange(100, 160)))) for k in range(80)]
    words = random_words(rng, 120)
    docs += [(100, " ".join(words)), (101, " ".join(words) + " " + "#" * 30 + " " + "|" * 30), (102, " ".join(words[:110] + words[:10]))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'a' AS source")
    got = {r.doc_id: r for r in outliers.quality_rules(frame).collect()}
    assert not any(got[k].base_failed for k in (100, 101, 102)) and got[102].n_repeat_words == 20
    assert (got[100].kept, got[101].kept, got[102].kept) == (True, False, False)
    assert sum(not got[k].kept for k in range(80)) <= 2


def test_outlier_plan_is_native(spark):
    assert "Python" not in outliers.text_counts(documents(spark))._jdf.queryExecution().executedPlan().toString()


def test_outlier_edge_cases(spark):
    got = outliers.quality_rules(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[6].n_repeat_words == 20_000 and by[6].base_failed
    assert outliers.quality_rules(awkward(spark).limit(0)).count() == 0


# --- languages


def test_gradients():
    import numpy as np

    rng = np.random.default_rng(0)
    net = gru.Network(["a", "b", "c"], 4)
    ids = rng.integers(0, 256, (6, 5))
    live = np.sort((rng.random((6, 5)) < 0.8).astype(np.float32), 0)[::-1]
    target = np.array([0, 1, 2, 1, 0])

    def loss():
        p = net.probabilities(net.states(ids, live, "f"), net.states(ids, live, "b"))
        return float(-(np.log(p[:, np.arange(5), target]) * live).sum() / live.sum())

    grads = net.gradients(ids, live, target)
    for name, w in net.weights.items():
        places = [(int(ids[0, 0]), 3), (int(ids[2, 1]), 7)] if name.startswith("x") else [tuple(rng.integers(0, s) for s in w.shape)] * 2
        for at in places:
            old = w[at]
            w[at] = old + 1e-2
            up = loss()
            w[at] = old - 1e-2
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-3


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = gru.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(gru, "ROUNDS", 5)
    got = gru.languages(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (1, 2, 3, 9))
    assert all(r.lang_pred == "und" for r in gru.languages(awkward(spark).withColumn("lang", F.lit(None).cast("string"))).collect())
    assert gru.languages(awkward(spark).limit(0)).count() == 0


def test_long_text_is_read_to_its_end():
    """A text's label depends on all stretches, not on the first."""
    net = gru.fit(["aaaa bbbb " * 40, "cccc dddd " * 40], ["x", "y"], rounds=60)
    best, _ = net.label(pa.array(["aaaa bbbb " * 10 + "cccc dddd " * 300, "cccc dddd " * 10 + "aaaa bbbb " * 300, None]))
    assert [net.names[b] for b in best[:2]] == ["y", "x"]


def test_label_pools_the_forward_pass(spark):
    """Labels of whole texts equal a plain pass over each stretch, also where a text takes many blocks."""
    import numpy as np

    net = gru.Network(["a", "b", "c"], 4)
    texts = ["", "é" * 300, "plain text " * 400, None, "x"]
    small, gru.BLOCK = gru.BLOCK, 7
    try:
        best, score = net.label(pa.array(texts))
    finally:
        gru.BLOCK = small
    for t, b, s in zip(texts, best, score):
        data = (t or "").encode()
        total = np.zeros(3)
        for at in range(0, len(data), gru.STEP):
            part = data[at : at + gru.STEP]
            ids = np.frombuffer(part, np.uint8)[:, None]
            live = np.ones(ids.shape, np.float32)
            total += net.probabilities(net.states(ids, live, "f"), net.states(ids, live, "b"))[:, 0].sum(0)
        if data:
            assert b == total.argmax() and abs(s - total.max() / len(data)) < 1e-5
        else:
            assert s == 0
    assert (net.label(pa.array(texts))[1] - score).max() < 1e-6
