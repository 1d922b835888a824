"""Plain versions of the operators, and small tables with awkward rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Nulls, empties, white space, ties, repeated rows, one long text.
AWKWARD = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, "One two", "en", "a"), (4, "One two", "en", "a"),
    (5, "one  TWO", "de", "a"), (None, "No id at all. Just a text.", "en", "a"), (None, None, None, None),
    (6, "word " * 20_000, "en", "b"), (7, "x" * 30_000, "en", "b"), (8, "日本語 текст éà 🙂", "ja", "b"), (9, "...\n\n!!!\n---", "en", "b"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def awkward(spark):
    """The awkward rows, with extra columns named like those that operators make or use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, SCHEMA).withColumn("n_chars", F.char_length("text").cast("bigint"))
    for name in ("key", "t", "n", "fp", "row", "runs", "score", "h", "x", "y", "component_id", "n_words", "kept", "_key", "held_out", "items"):
        df = df.withColumn(name, F.lit(1))
    return df


def components(texts: dict[int, str | None], width: int, percent: int) -> dict[int, tuple[int, int]]:
    """Set size and smallest linked id of each id, over all pairs."""
    sets = {}
    for i, t in texts.items():
        w = SPACED.findall(lower(t or ""))
        runs = [tuple(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [tuple(w)] if w else []
        sets[i] = frozenset(runs)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, words in repeated windows."""
    text = text or ""
    w = SPACED.findall(text)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    inside = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def hits(text: str | None, items: list[tuple[int, str | None]], window: int = 10) -> tuple[int, int, list[str]]:
    """Words, hit words and items found, by comparing everywhere."""
    w = ALNUM.findall(lower(text or ""))
    hit, found = set(), set()
    for item, content in items:
        p = ALNUM.findall(lower(content or ""))
        k = min(window, len(p))
        for s in range(len(p) - k + 1) if p else ():
            for at in range(len(w) - k + 1):
                if w[at : at + k] == p[s : s + k]:
                    hit.update(range(at, at + k))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def word_hash(word: bytes) -> int:
    from setwright.llm.textarrays import SPACED as LETTERS
    from setwright.llm.textarrays import Words

    raw = np.frombuffer(word, np.uint8)
    return int(Words(raw, np.array([0, len(raw)]), LETTERS).hashes()[0])


def without_repeats(docs: list[tuple[int, str | None]], sentences: int, words: int, edge: int) -> dict[int, tuple[int, int, str | None]]:
    """Sentences, removed sentences and what is left, document by document, from runs of every length."""
    import numpy as np

    from setwright.llm.textarrays import mixed

    def chosen(a: bytes, b: bytes) -> bool:
        after = mixed(np.array([word_hash(b)], np.uint64) + np.uint64(5))
        return a != b and int(mixed(np.array([word_hash(a)], np.uint64) ^ after)[0]) % 4 == 0

    cut: dict[int, tuple[list, list]] = {}
    runs: dict[int, list] = defaultdict(list)
    numbers: dict[tuple, int] = {}  # a run is the run before its last sentence, and that sentence
    first: dict[int, tuple] = {}
    count: Counter = Counter()
    for d, text in docs:
        data = (text or "").encode()
        found = list(re.finditer(rb"[^\x20\x09-\x0D]+", data))
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in m.group()) for m in found]
        bounds = {0, len(w)}
        for k, m in enumerate(found[:-1]):
            if b"\n" in data[m.end() : found[k + 1].start()] or re.search(rb"[.!?][^0-9a-z\x80-\xff]*$", w[k]):
                bounds.add(k + 1)
        cuts = {k for k in range(1, len(w)) if not bounds & set(range(k - edge, k + edge + 1)) and chosen(w[k - 1], w[k])}
        at = sorted(bounds | cuts)
        pieces = [list(range(i, j)) for i, j in zip(at, at[1:])]
        cut[d] = ([[w[k] for k in p] for p in pieces], [found[p[0]].start() for p in pieces])
        for i in range(len(pieces)):
            run, n = -1, 0
            for j in range(i, len(pieces)):
                n += len(pieces[j])
                run = numbers.setdefault((run, *cut[d][0][j]), len(numbers))
                if n >= words and j + 1 - i >= sentences:
                    runs[d].append((run, i, j + 1))
                    count[run] += 1
                    first.setdefault(run, (d, i))
    out = {}
    for d, text in docs:
        drop = {k for run, i, j in runs[d] if count[run] > 1 and first[run] != (d, i) for k in range(i, j)}
        parts, starts = cut[d]
        data = (text or "").encode()
        ends = starts[1:] + [len(data)]
        left = text if not drop else (data[: starts[0]] + b"".join(data[starts[k] : ends[k]] for k in range(len(parts)) if k not in drop)).decode()
        out[d] = (len(parts), len(drop), left)
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
