"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

**Encoding.** Symbols of a word arrive one by one. Any prefix of a BPE encoding is itself the
encoding of the text it covers, so the encodings of all prefixes form a tree: the one ending at
symbol ``i`` is the one ending before its last token, plus that token. The last token is the only
token ``t`` ending at ``i`` such that the token before it and ``t`` stay apart when the merge list is run
on both together. No token is longer than ``lookahead`` symbols (taken from the merge list), so
whatever follows, the final encoding passes through one of the last ``lookahead`` prefixes; what all
of these share can no longer change and is emitted. Memory is the unsettled window, not the word.

**Decoding** feeds ids one by one through a state machine: without a decoder in the tokenizer file,
token strings joined by one space; with the byte-level one, bytes to text by an incremental UTF-8 decoder.

Null texts are empty texts: no ids, and the decoded text is empty. Repeated rows get equal rows, and an empty
table gives none. Extra columns are ignored. A text is encoded and decoded ``_BLOCK`` chunks at a time, so a very
long one takes memory for itself and its chunks, not for its ids as text (``bpe_ids`` returns all ids of a text).
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from setwright.llm.textarrays import slices, small_batches

#: Distinct words whose ids a Python worker keeps, some 350 bytes each with what goes with them; the tables start
#: anew beyond it. Fewer take less memory and more time, and change nothing else.
WORDS_KEPT = 600_000
#: Chunks whose ids go through the decoder together.
_BLOCK = 4096
_HEAD = 6
_WIDE = 1 << 32
#: The only pattern that the normaliser may replace, by one space.
_SPACES = {"Regex": r"\s+"}
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE_RUN = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    shifted = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [shifted.get(b, chr(b)) for b in range(256)]


class Merges:
    """A merge list: ranks of pairs, and which neighbouring tokens stay apart."""

    def __init__(self, vocab: dict[str, int], merges: Iterable, suffix: str = ""):
        self.ids = vocab
        self.suffix = suffix
        self.names = {i: t for t, i in vocab.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        self.rank: dict[tuple[int, int], int] = {}
        #: By token: the rank that makes it, and the two tokens it is made of.
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            token = vocab[a + b]
            if token in self.made:
                raise ValueError(f"two merges make {a + b!r}")
            self.rank[vocab[a], vocab[b]] = r
            self.made[token] = (r, vocab[a], vocab[b])
        whole = {i: name for i, name in self.names.items() if self.run(self.symbols(name)) == [i]}
        #: No token has more symbols, so no prefix further back can be the last one settled.
        self.lookahead = max((len(self.symbols(name)) for name in whole.values()), default=1)
        #: Every end of a token, with the token's id where it is a whole token.
        self.tails: dict[str, int] = {}
        for i, name in whole.items():
            symbols = self.symbols(name)
            for k in range(len(symbols)):
                self.tails.setdefault("".join(symbols[k:]), -1)
            self.tails[name] = i
        self._apart: dict[int, bool] = {}
        self.kept = WORDS_KEPT
        #: Last token, and its symbols, of short heads of words.
        self._heads: dict[str, tuple[int, int]] = {}

    def symbols(self, name: str) -> list[str]:
        """The single symbols a token is made of."""
        if self.suffix and name.endswith(self.suffix) and name != self.suffix:
            body = name[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(name)

    def run(self, symbols: list[str]) -> list[int]:
        """Apply the merge list to a short run of symbols: lowest rank first, leftmost first."""
        ids = [self.ids.get(x, -1) for x in symbols]
        rank = self.rank
        while len(ids) > 1:
            best = min(((rank[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in rank), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.ids[self.names[ids[k]] + self.names[ids[k + 1]]]]
        return ids

    def apart(self, left: int, right: int) -> bool:
        """Whether two whole tokens, side by side, stay the two tokens they are.

        Undoes the later of the two tokens' last merges, step by step, and looks at the pair that
        meets at the bound: if that pair's merge comes before the merge undone last, it would have
        been made, and the tokens would not have come about. Of equal ranks the left one comes first.
        """
        key = left * _WIDE + right
        known = self._apart.get(key)
        if known is not None:
            return known
        rank, made = self.rank, self.made
        limit = len(rank)
        while True:
            pair = rank.get((left, right))
            if pair is not None and pair < limit:
                known = False
                break
            of_left, of_right = made.get(left), made.get(right)
            if of_left and (not of_right or of_left[0] > of_right[0]):
                limit, left = of_left[0], of_left[2]
            elif of_right:
                limit, right = of_right[0] + 1, of_right[1]
            else:
                known = True
                break
        if len(self._apart) >= self.kept:
            self._apart.clear()
        self._apart[key] = known
        return known

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Tokens of one word, emitted as soon as nothing that follows can change them.

        ``symbols`` yields the word's symbols; the last one carries the end-of-word suffix.
        """
        reach, tails, memo, heads = self.lookahead, self.tails.get, self._apart.get, self._heads
        start = -1  # the settled token that the window follows
        seen = ""  # the symbols since; the suffix only ever ends it
        last: list[int] = [start]  # the last token of the prefix that ends here
        size: list[int] = [0]  # and how many symbols it has
        n = 0
        fresh = True  # nothing is settled yet, so the window is a head of the word
        for symbol in symbols:
            seen += symbol
            n += 1
            if fresh and n <= _HEAD:
                pair = heads.get(seen)
                if pair is not None:
                    last.append(pair[0])
                    size.append(pair[1])
                    continue
            ends = []
            for k in range(n - 1, -1, -1):
                token = tails(seen[k:])
                if token is None:
                    break
                if token >= 0:
                    ends.append((token, n - k))
            for pair in reversed(ends):
                before = last[n - pair[1]]
                if before < 0:
                    break
                apart = memo(before * _WIDE + pair[0])
                if apart or apart is None and self.apart(before, pair[0]):
                    break
            else:
                raise ValueError(f"no token ends at {symbol!r}")
            last.append(pair[0])
            size.append(pair[1])
            if fresh and n <= _HEAD:
                if len(heads) >= self.kept // 2:
                    heads.clear()
                heads[seen] = pair
                continue
            if n >= 2 * reach:
                cut = self._settled(size, reach)
                if cut:
                    yield from self._path(last, size, cut)
                    seen, last, size = seen[cut:], last[cut:], size[cut:]
                    size[0] = 0
                    fresh = False
                    n -= cut
        yield from self._path(last, size, n)

    @staticmethod
    def _settled(size: list[int], reach: int) -> int:
        """The longest prefix that the last ``reach`` prefix encodings share."""
        ends = set(range(len(size) - reach, len(size)))
        while len(ends) > 1:
            top = max(ends)
            ends.discard(top)
            ends.add(top - size[top])
        return ends.pop()

    @staticmethod
    def _path(last: list[int], size: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= size[end]
        return out[::-1]


class Decoder:
    """Ids to text, bit by bit; between two calls it holds no more than an unfinished character."""

    def __init__(self, tokenizer: Tokenizer):
        self.names = tokenizer.names
        self.raw = tokenizer.raw
        self.gap = ""
        self.machine = codecs.getincrementaldecoder("utf-8")("replace") if tokenizer.byte_level else None

    def feed(self, ids: list[int]) -> str:
        """The text that these next ids settle."""
        if not ids:
            return ""
        if self.machine is None:
            out = self.gap + " ".join([self.names[i] for i in ids])
            self.gap = " "
            return out
        out = []
        for i in ids:
            raw = self.raw.get(i)
            out.append(self.machine.decode(raw) if raw is not None else self.machine.decode(b"", True) + self.names[i])
        return "".join(out)

    def finish(self) -> str:
        """What an unfinished character leaves."""
        return self.machine.decode(b"", True) if self.machine else ""


class Tokenizer:
    """What a tokenizer file says: added tokens, normalisation, words, merges and decoding.

    Understands the parts that the public BPE files use; anything else is refused.
    """

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE models are understood")
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.names = dict(self.merges.names)
        self.names.update({t["id"]: t["content"] for t in spec["added_tokens"]})
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be matched as they stand")
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        #: What all added tokens begin with, which is looked for first.
        self.added_mark = os.path.commonprefix(longest_first)
        norm = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
        steps = norm.get("normalizers", [norm])
        kinds = [n["type"] for n in steps]
        if kinds != ["NFC", "Replace", "Lowercase"] or steps[1].get("pattern", _SPACES) != _SPACES or steps[1].get("content", " ") != " ":
            raise ValueError(f"unknown normalisation {steps}")
        pre = spec["pre_tokenizer"]["pretokenizers"]
        if [p["type"] for p in pre] != ["Split", "ByteLevel"] or not pre[0]["invert"] or pre[1]["use_regex"] or pre[1]["add_prefix_space"]:
            raise ValueError("unknown pre-tokenisation")
        self.words = regex.compile(pre[0]["pattern"]["Regex"])
        self.symbol = byte_symbols()
        decoder = spec.get("decoder")
        if decoder and decoder["type"] != "ByteLevel":
            raise ValueError("unknown decoder")
        self.byte_level = bool(decoder)
        back = {c: b for b, c in enumerate(self.symbol)}
        added = set(self.added.values())
        #: The bytes of each token that stands for bytes.
        self.raw = {
            i: bytes(back[c] for c in name) for i, name in self.names.items() if i not in added and all(c in back for c in name)
        } if self.byte_level else {}
        self._chunks: dict[str, tuple[bytes, tuple[int, ...]]] = {}
        self._words: dict[str, tuple[int, ...]] = {}

    def forget(self) -> None:
        """Empty the tables of words, which would stay with the worker after its task."""
        for table in (self._chunks, self._words, self.merges._apart, self.merges._heads):
            table.clear()

    # -- encoding

    def word_ids(self, word: str) -> Iterator[int]:
        symbols = [self.symbol[b] for b in word.encode("utf-8")]
        symbols[-1] += self.merges.suffix
        return self.merges.stream(symbols)

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a run without white space, which no word crosses."""
        out: list[int] = []
        for word in self.words.findall(chunk):
            ids = self._words.get(word)
            if ids is None:
                ids = tuple(self.word_ids(word))
                if len(word) <= 64:
                    if len(self._words) >= self.merges.kept:
                        self._words.clear()
                    self._words[word] = ids
            out += ids
        return out

    def pieces(self, text: str) -> Iterator[int | list[str]]:
        """Added tokens as ids, what lies between as lists of normalised chunks."""
        parts = self.added_pattern.split(text) if self.added_pattern and self.added_mark in text else [text]
        for part in parts:
            if part in self.added:
                yield self.added[part]
            elif part:
                part = unicodedata.normalize("NFC", part)
                # Lower case is taken character by character: no final sigma.
                part = part.replace("Σ", "σ").lower()
                yield part.split() if not _ODD_SPACE.search(part) else [c for c in _SPACE_RUN.split(part) if c]

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text):
            if isinstance(piece, int):
                out.append(piece)
            else:
                for chunk in piece:
                    out += self.chunk_ids(chunk)
        return out

    def known(self, chunk: str) -> tuple[bytes, tuple[int, ...]]:
        """A chunk's ids, as text and as they are."""
        found = self._chunks.get(chunk)
        if found is None:
            ids = tuple(self.chunk_ids(chunk))
            found = (" ".join(map(str, ids)).encode(), ids)
            if len(chunk) <= 64:
                if len(self._chunks) >= self.merges.kept // 2:
                    self._chunks.clear()
                self._chunks[chunk] = found
        return found

    def blocks(self, text: str) -> Iterator[list[tuple[bytes, tuple[int, ...]]]]:
        """A text's ids, some chunks at a time, by way of the table of chunks."""
        cache = self._chunks
        for piece in self.pieces(text):
            if isinstance(piece, int):
                yield [(str(piece).encode(), (piece,))]
            else:
                for k in range(0, len(piece), _BLOCK):
                    yield [cache.get(c) or self.known(c) for c in piece[k : k + _BLOCK]]

    def ids_fast(self, text: str) -> list[int]:
        """The same ids as ``ids``, by way of the table of chunks."""
        return [i for block in self.blocks(text) for _, ids in block for i in ids]

    # -- decoding

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Decoded text bit by bit."""
        machine = Decoder(self)
        for i in ids:
            yield machine.feed([i])
        yield machine.finish()

    # -- both, for one text

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by one space, SHA-256 of what the decoder makes of the ids."""
        as_ids, as_text, count, gap = hashlib.sha256(), hashlib.sha256(), 0, b""
        machine = Decoder(self)
        for block in self.blocks(text):
            ids = list(chain.from_iterable([b[1] for b in block]))
            if not ids:
                continue
            as_ids.update(gap + b" ".join([b[0] for b in block if b[1]]))
            as_text.update(machine.feed(ids).encode())
            count += len(ids)
            gap = b" "
        as_text.update(machine.finish().encode())
        return count, as_ids.hexdigest(), as_text.hexdigest()

    def ids_and_back(self, text: str) -> tuple[list[int], str]:
        """The ids of a text, and the SHA-256 of what the decoder makes of them."""
        ids = self.ids_fast(text)
        machine, as_text = Decoder(self), hashlib.sha256()
        for k in range(0, len(ids), _BLOCK):
            as_text.update(machine.feed(ids[k : k + _BLOCK]).encode())
        as_text.update(machine.finish().encode())
        return ids, as_text.hexdigest()


_loaded: dict[str, Tokenizer] = {}


def tokenizer_of(spec: str) -> Tokenizer:
    """The tokenizer of a file's content, made once per Python worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(spec)
    return _loaded[key]


def bpe_digests(
    docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", words_kept: int = WORDS_KEPT
) -> DataFrame:
    """Encode and decode every text; one row per row with counts and digests.

    Returns ``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``. The tokenizer file (a fixed
    vocabulary of a few MB) is read where the plan is built and sent to the workers once.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(spec.value)
        tokenizer.merges.kept = words_kept
        for batch in batches:
            for part in slices(batch, "text"):
                found = [tokenizer.digests(t or "") for t in part.column("text").to_pylist()]
                n, ids, decoded = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    narrow = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    out = small_batches(narrow).mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


def bpe_ids(
    docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", words_kept: int = WORDS_KEPT // 5
) -> DataFrame:
    """Encode every text and decode it again; one row per row with ``key``, ``n_tokens``, ``ids`` and ``decoded_sha256``.

    Keeps fewer words than ``bpe_digests`` and forgets them after each task, as it is one stage among others.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(spec.value)
        tokenizer.merges.kept = words_kept
        for batch in batches:
            for part in slices(batch, "text"):
                found = [tokenizer.ids_and_back(t or "") for t in part.column("text").to_pylist()]
                ids, decoded = [f[0] for f in found], [f[1] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        pa.array(map(len, ids), pa.int64()),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array(decoded, pa.string()),
                    ],
                    names=["key", "n_tokens", "ids", "decoded_sha256"],
                )
        tokenizer.forget()

    narrow = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, ids array<int>, decoded_sha256 string"
    return small_batches(narrow).mapInArrow(run, schema).withColumnRenamed("key", key)
