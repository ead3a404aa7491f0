"""Language identification: averaged hashed subword embeddings under a linear softmax.

The lower-cased text is taken as UTF-8; every ASCII byte that isn't a letter is a word boundary.
The byte n-grams of each word, its boundaries included, are hashed to rows of the embedding table.
A text is the mean of its rows, and a linear layer maps that mean to the languages. Both are trained by stochastic gradient descent in
numpy, on pieces of the sampled texts. A temperature fitted on pieces of texts kept from training, of
all lengths, calibrates the probabilities. A prediction is rejected if its calibrated probability is
under ``least``, so rather wrong than right, or if the text is like none of the languages: its typicality, the mean
log frequency of its n-grams in training, is less than that of all but ``lost`` of kept pieces of
its length, by a margin of half their distance from the median (where 50 kept texts are so long).

Training takes at most ``per_language`` labelled documents of a language and ``max_sample`` in all
(those of the least hash of doc_id): a bounded sample of whole texts. Prediction reads whole texts.

A text that is null or has no letter is ``und`` with score 0, and rejected. Rows with null lang
teach nothing. Without any labelled row everything is ``und``. Ties between languages go to the
first in alphabetical order. Nulls in doc_id stay null; repeated rows give repeated results; other
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridelta.llm.common import crc_mod, map_arrow

BUCKETS, DIM, GRAMS = 1 << 15, 8, (2, 3, 4)
#: Lengths in words of the pieces that calibrate.
PIECES = (3, 12, 50, 200)
_any_letter = regex.compile(r"\p{L}").search
_BYTES = np.array([x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256)], np.uint8)


def features(text: str | None) -> np.ndarray:
    """Bucket numbers of the n-grams of a whole text, in the order of the text for each length."""
    raw = _BYTES[np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]
    blank = raw == 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    raw, blank = raw[keep].astype(np.uint32), blank[keep]
    inside = np.concatenate([[0], np.cumsum(blank)])  # boundaries before each position
    out, h = [], raw * np.uint32(2654435761)
    for n in range(2, max(GRAMS) + 1):
        if len(raw) < n:
            break
        h = (h[: len(raw) - n + 1] * np.uint32(40503)) ^ (raw[n - 1 :] * np.uint32(2246822519) + np.uint32(n))
        if n in GRAMS:
            whole = inside[n - 1 : len(raw)] == inside[1 : len(raw) - n + 2]  # none between first and last
            if n == 2:
                whole = ~(blank[:-1] & blank[1:])
            x = h[whole]
            out.append(((x ^ (x >> np.uint32(15))) * np.uint32(2654435769) >> np.uint32(17)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # of each bucket: its embedding through the linear layer
    bias: np.ndarray
    temperature: float
    threshold: float
    accuracy: float
    usual: np.ndarray  # log frequency of each bucket in training
    sizes: np.ndarray  # numbers of n-grams, and the least typicality of accepted texts of each
    floors: np.ndarray

    def typical(self, typicality: float, n: int) -> bool:
        return bool(typicality >= np.interp(np.log(n), np.log(self.sizes), self.floors)) if len(self.sizes) else True

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not _any_letter(text):
            return "und", 0.0, False
        counts = bucket_counts(text)
        n = int(counts.sum())
        if not n:
            return "und", 0.0, False
        p = _softmax((counts @ self.logits / n + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.threshold) and self.typical(float(counts @ self.usual / n), n)


def bucket_counts(text: str, step: int = 1 << 20) -> np.ndarray:
    """How often each bucket occurs in a whole text, read in steps that end between words: memory
    doesn't grow with the text."""
    counts, at = np.zeros(BUCKETS), 0
    while at < len(text):
        end = at + step
        while end < len(text) and not (text[end] < "\x80" and not text[end].isalpha()):
            end += 1
        counts += np.bincount(features(text[at:end]), minlength=BUCKETS)
        at = end
    return counts


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _bags(texts: list[str], size: int, rng: np.random.Generator) -> tuple[list[np.ndarray], np.ndarray]:
    """The features of each text, dealt into bags of about ``size``."""
    bags, owner = [], []
    for i, text in enumerate(texts):
        ids = features(text)
        if len(ids):
            parts = np.array_split(rng.permutation(ids), -(-len(ids) // size))
            bags.extend(parts)
            owner.extend([i] * len(parts))
    return bags, np.array(owner, np.int64)


def train(rows: list[tuple[int, str, str]], epochs: int = 2, rate: float = 4.0, piece: int = 400, seed: int = 7, least: float = 0.5, lost: float = 0.001) -> Model | None:
    """rows: (doc_id, text, lang). One in six documents, by crc32, calibrates."""
    rows = sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    languages = sorted({r[2] for r in rows})
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}
    aside = [zlib.crc32(f"v{r[0]}".encode()) % 6 == 0 for r in rows]
    fit = [r for r, x in zip(rows, aside, strict=True) if not x] or rows
    check = [r for r, x in zip(rows, aside, strict=True) if x] or rows
    rng, c = np.random.default_rng(seed), len(languages)
    table, weight, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((c, DIM)), np.zeros(c)
    weight += rng.normal(0, 0.1, weight.shape)
    bags, owner = _bags([r[1] for r in fit], piece, rng)
    label = np.array([number[r[2]] for r in fit], np.int64)[owner] if len(owner) else owner
    steps = max(1, epochs * len(bags))
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 16):
            batch = order[at : at + 16]
            sizes = np.array([len(bags[i]) for i in batch])
            ids = np.concatenate([bags[i] for i in batch])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(table[ids], starts, axis=0) / sizes[:, None]
            p = _softmax(mean @ weight.T + bias)
            p[np.arange(len(batch)), label[batch]] -= 1
            lr = rate * (1 - done / steps)
            back = (p @ weight) / sizes[:, None]
            weight -= lr * (p.T @ mean) / len(batch)
            bias -= lr * p.mean(0) * 0.1
            np.add.at(table, ids, -lr * np.repeat(back, sizes, axis=0))
            done += len(batch)
    seen = np.zeros(BUCKETS)
    for ids in bags:
        seen += np.bincount(ids, minlength=BUCKETS)
    usual = np.log((seen + 0.5) / (seen.sum() + 0.5 * BUCKETS))
    model = Model(languages, (table @ weight.T).astype(np.float32), bias, 1.0, least, 0.0, usual, np.empty(0), np.empty(0))
    z, y, whole, likeness = [], [], [], {}
    for _, text, lang in check:
        ids = features(text)
        if not len(ids):
            continue
        # The whole text, and pieces of so many words from some place of it.
        words = text.split()
        for size in (*PIECES, len(words)):
            if size > len(words):
                continue
            start = int(rng.integers(0, len(words) - size + 1))
            ids = features(" ".join(words[start : start + size]))
            if len(ids):
                z.append(model.logits[ids].mean(0) + bias)
                y.append(number[lang])
                whole.append(size == len(words))
                if size in PIECES:
                    likeness.setdefault(size, []).append((len(ids), usual[ids].mean()))
    if z:
        z, y, whole = np.array(z), np.array(y), np.array(whole)
        nll = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=nll))
        model.accuracy = float((z[whole].argmax(1) == y[whole]).mean()) if whole.any() else 0.0
        spots = []
        for found in (x for x in likeness.values() if len(x) >= 50):
            n, t = np.array(found).T
            low, middle = np.quantile(t, [lost, 0.5])
            spots.append((np.median(n), low - 0.5 * (middle - low)))
        if spots:
            model.sizes, model.floors = np.array(sorted(spots)).T
    return model


def sample(docs: DataFrame, per_language: int = 300, max_sample: int = 3000) -> list[tuple[int, str, str]]:
    """At most so many labelled whole texts; ids are chosen without moving the texts."""
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = ids.withColumn("at", F.row_number().over(w)).where(F.col("at") <= per_language).orderBy("at", "lang").limit(max_sample).select("doc_id").distinct()
    chosen = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id", "left_semi")
    return [tuple(r) for r in chosen.select("doc_id", "text", "lang").collect()]


def learn(docs: DataFrame, folds: int = 5, **options) -> Model | None:
    """Learn from the documents outside fold 0 (crc32 of doc_id as text, modulo folds)."""
    return train(sample(docs.select("doc_id", "text", "lang").where(crc_mod("doc_id", folds) != 0)), **options)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, accepted of each whole text."""

    def run(batch):
        rows = [model.decide(x.as_py()) if model else ("und", 0.0, False) for x in batch.column("text")]
        langs, scores, accepted = zip(*rows, strict=True)
        return {"doc_id": batch.column("doc_id"), "lang_pred": langs, "score": scores, "accepted": accepted}

    return map_arrow(docs.select("doc_id", "text"), "doc_id long, lang_pred string, score double, accepted boolean", run)


def keep(docs: DataFrame, columns: list[str], model: Model | None) -> DataFrame:
    """The given columns of the documents whose language is accepted; no shuffle."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)

    def run(batch):
        import pyarrow as pa

        if model is None:
            return None
        left = batch.filter(pa.array([model.decide(x.as_py())[2] for x in batch.column("text")], pa.bool_()))
        return {name: left.column(name) for name in columns} if left.num_rows else None

    return map_arrow(docs.select(*columns), ddl, run)
