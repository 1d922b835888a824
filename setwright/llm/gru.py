"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read the bytes of a text from both ends; their states at every byte give the
probabilities of the languages there, and a document's are the means over all its bytes. The network is
small, so it is trained in numpy by backpropagation through time on the driver, on a bounded sample:
``SAMPLE`` documents a language (those with the smallest hashed ids), ``SNIPPETS`` stretches of each.

Texts are read whole, as stretches of ``STEP`` bytes side by side; states start anew in each, so that a slice of
texts takes ``STEP`` steps however long its texts are.

Defined results: null texts and texts without a letter are ``und`` with a score of 0; so is everything if
there is nothing to learn from; equal probabilities go to the first language in order of names;
repeated rows get equal rows. Language, source and id are never inputs. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setwright.llm.quality import held_out
from setwright.llm.textarrays import flat, slices, small_batches

HIDDEN = 8
#: Stretches whose states are held at once.
BLOCK = 4096
STEP = 128
#: Documents per language, and languages, that the network learns from, at most.
SAMPLE, LANGUAGES = 300, 200
SNIPPETS, LENGTH, BATCH, ROUNDS, RATE = 4, 64, 128, 240, 0.02
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


class Network:
    """Weights of both directions and of the labels.

    Gates are in the order update, reset, candidate. Update and reset use tanh of half their input,
    which is the logistic function stretched; their weights hold that half already.
    """

    def __init__(self, names: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.names = names
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.weights = {}
        for d in "fb":
            self.weights[f"x{d}"] = draw(256, 3 * hidden, by=0.3)
            self.weights[f"h{d}"] = draw(hidden, 3 * hidden, by=hidden**-0.5)
            self.weights[f"v{d}"] = draw(hidden, len(names), by=hidden**-0.5)
        self.weights["v"] = np.zeros(len(names), np.float32)

    def states(self, ids: np.ndarray, live: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """States after each byte; ``ids`` and ``live`` are (length, stretches), the state of no text is 0."""
        x, u = self.weights[f"x{d}"], self.weights[f"h{d}"]
        k = u.shape[0]
        steps, n = ids.shape
        out = np.empty((steps, n, k), np.float32)
        h = np.zeros((n, k), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = x[ids[t]]
            b = h @ u
            gates = np.tanh(a[:, : 2 * k] + b[:, : 2 * k])
            gates += 1
            gates *= 0.5
            z, r = gates[:, :k], gates[:, k:]
            c = np.tanh(a[:, 2 * k :] + r * b[:, 2 * k :])
            new = c + z * (h - c)
            new *= live[t][:, None]
            if tape is not None:
                tape.append((t, h, z, r, c, b[:, 2 * k :]))
            h = out[t] = new
        return out

    def probabilities(self, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
        w = self.weights
        logits = hf @ w["vf"]
        logits += hb @ w["vb"]
        logits += w["v"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, ids: np.ndarray, live: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of all labels of all bytes."""
        tapes: dict[str, list] = {"f": [], "b": []}
        states = {d: self.states(ids, live, d, tapes[d]) for d in "fb"}
        p = self.probabilities(states["f"], states["b"])
        p[:, np.arange(ids.shape[1]), target] -= 1
        p *= (live / max(live.sum(), 1))[:, :, None].astype(np.float32)
        grads = {"v": p.sum((0, 1))}
        for d in "fb":
            u = self.weights[f"h{d}"]
            k = u.shape[0]
            grads[f"v{d}"] = np.einsum("tnk,tnc->kc", states[d], p)
            at_state = p @ self.weights[f"v{d}"].T
            gu, gx = np.zeros_like(u), np.zeros((256, 3 * k))
            back = np.zeros((ids.shape[1], k), np.float32)
            for t, h, z, r, c, inner in reversed(tapes[d]):
                g = (back + at_state[t]) * live[t][:, None]
                gc = g * (1 - z) * (1 - c * c)
                # Half of the logistic function's slope is in the weights: d/da of (1 + tanh a) / 2.
                gz = g * (h - c) * 2 * z * (1 - z)
                gr = gc * inner * 2 * r * (1 - r)
                ga = np.concatenate([gz, gr, gc], 1)
                gb = np.concatenate([gz, gr, gc * r], 1)
                gu += h.T @ gb
                np.add.at(gx, ids[t], ga)
                back = g * z + gb @ u.T
            grads[f"h{d}"], grads[f"x{d}"] = gu, gx.astype(np.float32)
        return grads

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its probability per text, pooled over all its bytes."""
        raw, off = flat(texts)
        size = np.diff(off)
        per = -(-size // STEP)
        n = int(per.sum())
        pooled = np.zeros((len(size), len(self.names)))
        if n:
            text = np.repeat(np.arange(len(size)), per)
            nth = np.arange(n) - np.repeat(np.cumsum(per) - per, per)
            at = off[text] + nth * STEP
            # A block of stretches at a time, so that states and probabilities do not grow with a text.
            for a in range(0, n, BLOCK):
                part = slice(a, a + BLOCK)
                left = np.minimum(off[text[part] + 1] - at[part], STEP)
                steps = np.arange(int(left.max()))[:, None]
                live = steps < left[None, :]
                ids = raw[np.where(live, at[part][None, :] + steps, 0)]
                live = live.astype(np.float32)
                p = self.probabilities(self.states(ids, live, "f"), self.states(ids, live, "b"))
                each = np.einsum("tnc,tn->nc", p, live)
                for c in range(len(self.names)):
                    pooled[:, c] += np.bincount(text[part], each[:, c], len(size))
            pooled /= np.maximum(size, 1)[:, None]
        best = pooled.argmax(1)
        return best, np.clip(pooled[np.arange(len(size)), best], 0, 1)


def fit(texts: list[str], labels: list[str], rounds: int = ROUNDS, seed: int = 7) -> Network | None:
    """Train on some texts; Adam over shuffled stretches, the same for the same texts."""
    names = sorted(set(labels))
    if not names:
        return None
    net = Network(names, seed=seed)
    rng = np.random.default_rng(seed)
    ids, live, target = [], [], []
    for text, label in zip(texts, labels):
        data = np.frombuffer(text.encode(), np.uint8)
        for _ in range(SNIPPETS):
            start = int(rng.integers(0, max(1, len(data) - LENGTH + 1)))
            part = data[start : start + LENGTH]
            ids.append(np.pad(part, (0, LENGTH - len(part))))
            live.append(np.arange(LENGTH) < len(part))
            target.append(names.index(label))
    ids, live, target = np.array(ids), np.array(live, np.float32), np.array(target)
    # Every language weighs the same.
    groups = [np.flatnonzero(target == c) for c in range(len(names))]
    first = {k: np.zeros_like(w) for k, w in net.weights.items()}
    second = {k: np.zeros_like(w) for k, w in net.weights.items()}
    for step in range(1, rounds + 1):
        pick = np.array([groups[c][rng.integers(len(groups[c]))] for c in rng.integers(0, len(names), BATCH)])
        grads = net.gradients(ids[pick].T, live[pick].T, target[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * (1 - step / (rounds + 1)) * min(1.0, step / 20)
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """Fit on ``SAMPLE`` documents of each of at most ``LANGUAGES`` languages that are not held out."""
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang"))
    usable = rows.filter(F.col("key").isNotNull() & ~held_out(F.col("key")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Ranks are limited before the shuffle, so a language sends no more than its sample from each task.
    order = Window.partitionBy("lang").orderBy("h", "key")
    ids = usable.select("key", "lang", F.xxhash64("key").alias("h")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE)
    chosen = ids.orderBy("rank", "lang").limit(SAMPLE * LANGUAGES).select("key")
    # At most SAMPLE * LANGUAGES ids; of each text a stretch around its middle is enough to draw from.
    found = usable.join(F.broadcast(chosen), "key", "left_semi")
    middle = F.substring(F.col("text"), F.greatest(F.lit(1), (F.char_length("text") / 2 - 1024).cast("int")), F.lit(2048))
    got = found.select(F.xxhash64("key").alias("h"), "lang", middle.alias("part")).orderBy("h", "lang", "part").limit(SAMPLE * LANGUAGES).collect()
    return fit([r["part"] for r in got], [r["lang"] for r in got])


def languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: ``key, held_out, lang_pred, score``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, key, text, lang))  # some thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                texts = part.column("text")
                named = [bool(net and t and _LETTER.search(t)) for t in texts.to_pylist()]
                if net:
                    best, score = net.label(texts)
                    found = [net.names[b] if ok else UNKNOWN for b, ok in zip(best, named)]
                    score = np.where(named, score, 0.0)
                else:
                    found, score = [UNKNOWN] * len(named), np.zeros(len(named))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=["key", "lang_pred", "score"]
                )

    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = small_batches(rows).mapInArrow(run, f"key {kind}, lang_pred string, score double")
    return out.select(
        F.col("key").alias(key), F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
