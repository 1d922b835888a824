"""Token counts of a unigram tokenizer, without making the tokens.

Aho-Corasick finds every vocabulary piece in a word; dynamic programming over its characters carries the
best score and the number of pieces of the best segmentation up to each place. Ties go as in the
tokenizer: a later candidate must be strictly better, and candidates for one place come in the order of their
starts, so the longest last piece stays. A character that is no piece by itself may be unknown, at the
lowest score less 10; unknown runs count as their bytes where the vocabulary has byte pieces, else once a run.

Spaces become the word mark, one stands before the text, and each mark begins a word; words are
segmented apart. Words of which a worker has seen the count are looked up.

Defined results: null and empty texts have 0 tokens; repeated rows get equal rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from setwright.llm.textarrays import slices, small_batches

MARK = "▁"
UNKNOWN_LESS = 10.0
CACHE_WORDS = 250_000


class Unigram:
    """A vocabulary of pieces and scores, and how to count with it."""

    def __init__(self, pieces: Sequence[tuple[str, float]], bytes_for_unknown: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_LESS
        # Unknown text becomes bytes only if all of its bytes are pieces.
        self.byte = [f"<0x{b:02X}>" in names for b in range(256)] if bytes_for_unknown else [False] * 256
        self.whole = all(self.byte)
        self._known: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        """Number of pieces of one word's best segmentation."""
        n = len(word)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        run = [0] * (n + 1)  # characters of the unknown run that ends here
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, found in self.automaton.iter(word):
            matches[last + 1].append(found)
        for end in range(1, n + 1):
            top = None
            single = False
            for length, score in matches[end]:  # longest, so earliest start, first
                start = end - length
                total = score + best[start]
                if top is None or total > top:
                    top, count[end], run[end] = total, count[start] + 1, 0
                single = single or length == 1
            if not single:
                start = end - 1
                total = self.unknown + best[start]
                if top is None or total > top:
                    top = total
                    run[end] = run[start] + 1
                    count[end] = count[start] + self._unknown(word, end, run[end])
            best[end] = top
        return count[n]

    def _unknown(self, word: str, end: int, run: int) -> int:
        """What one more character adds to the count of an unknown run of now ``run`` characters."""
        if self.whole:
            return len(word[end - 1].encode("utf-8", "surrogatepass"))
        now, before = self._run(word[end - run : end]), self._run(word[end - run : end - 1])
        return now - before

    def _run(self, text: str) -> int:
        data = text.encode("utf-8", "surrogatepass")
        if data and all(self.byte[b] for b in data):
            return len(data)
        return 1 if data else 0

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        return marked.split(MARK)[1 if marked.startswith(MARK) else 0 :]

    def count(self, text: str) -> int:
        """Number of tokens of a text."""
        known, total = self._known, 0
        words = self.words(text)
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            got = [known.get(w) for w in part]
            for i, g in enumerate(got):
                if g is None:
                    word = part[i]
                    got[i] = self.count_word(MARK + word)
                    if len(word) <= 64:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        known[word] = got[i]
            total += sum(got)
        return total


def pieces_of(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


_made: dict[str, Unigram] = {}


def token_counts(docs: DataFrame, pieces: Sequence[tuple[str, float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: ``key, n_tokens`` of the whole text. ``pieces`` is a vocabulary of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(list(pieces))
    name = hashlib.sha256(repr(list(pieces)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _made:
            _made.clear()
            _made[name] = Unigram(shared.value)
        model = _made[name]
        for batch in batches:
            for part in slices(batch, "text"):
                counts = [model.count(t) if t else 0 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(counts, pa.int64())], names=["key", "n_tokens"])

    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return small_batches(rows).mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)
