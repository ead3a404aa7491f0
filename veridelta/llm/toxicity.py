"""Toxicity by nearest labelled examples under TF-IDF cosine.

A bounded sample of labelled documents (whole texts) is indexed: at most ``max_toxic`` and
``max_clean``, those of the least hash of doc_id, and ``max_chars`` characters in all (a document that
would pass that bound is left out). Terms are runs of letters, lower-cased, and their
beginnings of 4 and 5 letters, as insults are inflected. All terms are indexed but those of fewer than
``min_df`` examples and those of more than the share ``max_df`` of the clean ones (function words).

A term's weight is (1 + ln count) * idf * relevance; relevance is ``floor`` for every term, plus what
its chi-squared against the label (near copies counted once) exceeds the greatest that chance would
give among so many terms, divided by the number of examples. So a text with telling terms is compared
by these, and one without is compared by all its words. Vectors are L2-normalised.

The index is inverted: for each term, its examples with their weights, cut into blocks of examples,
and the greatest weight in each block. A query adds those maxima up into a bound for every block,
scores the blocks of the greatest bounds exactly, then all blocks whose bound reaches the k-th best
so far: exact cosine neighbours. Examples with like terms stand side by side, which makes bounds tight.

Neighbours vote with weight 1 / (1.02 - cosine) - 1 / 1.02, which is 0 for nothing in common; so a
text that shares one telling word with toxic examples, but little else, is nearer to none of them than
they are to one another, and its votes weigh less. A logistic curve of the votes' log odds, fitted on the examples' own
votes, near copies of the example left out, weighted to the label rates of all labelled rows, makes
votes probabilities. Texts without a known term have no neighbours: their score is the rate among
such examples. The evidence is the neighbours' doc_ids, nearest first; ties go to the smaller doc_id.

Null and empty texts have no terms. A document with several labels is toxic if one says so; null
labels teach nothing; without any label the score is 0. Of several texts under one doc_id the least is
the example. Nulls in doc_id stay null; repeated rows give repeated results; other columns are not
read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridelta.llm.common import crc_mod, kept, map_arrow

_words = re.compile(r"[^\W\d_]+").findall
STARTS = (4, 5)
LONGEST = max(STARTS)


def starts_of(word: str) -> list[str]:
    """A word's beginnings, marked as such: words with the same first LONGEST letters have the same."""
    return [f"<{word[:n]}" for n in STARTS if len(word) >= n]


def terms_of(word: str) -> list[str]:
    """A word, and its beginnings."""
    return [word, *starts_of(word)]


@dataclass
class Index:
    vocabulary: dict[str, int]
    weight: np.ndarray  # idf * relevance of each term
    k: int
    block: int
    ids: np.ndarray  # doc_id of each example that has terms
    toxic: np.ndarray
    group: np.ndarray  # near copies have one number
    first: np.ndarray  # of each term: its first entry; entries are (term, block) pairs
    blocks: np.ndarray  # of each entry: the block
    maxima: np.ndarray  # of each entry: the greatest weight
    start: np.ndarray  # of each entry: its first posting
    example: np.ndarray  # of each posting
    value: np.ndarray  # of each posting
    slope: float = 1.0
    shift: float = 0.0
    without: float = 0.0

    def vector(self, text: str | None, cache: dict) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers, in order, and their L2-normalised weights."""
        known = self.vocabulary.get
        if len(cache) > 200_000:
            cache.clear()
        words = Counter(_words((text or "").lower()))
        counts = np.fromiter(words.values(), np.int64, len(words))
        whole = np.fromiter(map(known, words, repeat(-1)), np.int64, len(words))
        # Whole words are looked up; the numbers of the beginnings, of which there are fewer, are kept.
        heads = [word[:LONGEST] for word in words]
        found = list(map(cache.get, heads))
        if None in found:
            for at, (head, ids) in enumerate(zip(heads, found, strict=True)):
                if ids is None:
                    found[at] = cache[head] = tuple([i for t in starts_of(head) if (i := known(t)) is not None])
        starts = np.fromiter(chain.from_iterable(found), np.int64)
        ids = np.concatenate([whole[whole >= 0], starts])
        if not len(ids):
            return ids, np.empty(0)
        times = np.concatenate([counts[whole >= 0], np.repeat(counts, np.fromiter(map(len, found), np.int64, len(found)))])
        terms, back = np.unique(ids, return_inverse=True)
        counts = np.bincount(back, weights=times)
        w = (1 + np.log(counts)) * self.weight[terms]
        return terms, w / math.sqrt(float((w * w).sum()))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, skip: np.ndarray | None = None, ahead: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples; those of the mask ``skip`` take no part."""
        entries, w = _ranges(self.first[terms], self.first[terms + 1], weights)
        of = self.blocks.take(entries)
        bounds = np.bincount(of, w * self.maxima.take(entries), minlength=1)
        first = np.zeros(len(bounds), bool)
        first[np.argpartition(-bounds, min(ahead, len(bounds) - 1))[:ahead]] = True
        scores = np.zeros(len(self.ids))
        self._add(scores, entries, w, first.take(of))
        found = scores[scores > 0 if skip is None else (scores > 0) & ~skip]
        last = np.partition(found, len(found) - self.k)[len(found) - self.k] if len(found) >= self.k else 0.0
        rest = ~first & (bounds > 0) & (bounds >= last - 1e-11)
        if rest.any():
            self._add(scores, entries, w, rest.take(of))
        best = self._best(scores, skip)
        return best, scores[best]

    def _add(self, scores: np.ndarray, entries: np.ndarray, w: np.ndarray, chosen: np.ndarray) -> None:
        which = np.flatnonzero(chosen)
        at = entries.take(which)
        postings, w = _ranges(self.start.take(at), self.start.take(at + 1), w.take(which))
        w *= self.value.take(postings)
        scores += np.bincount(self.example.take(postings), w, minlength=len(scores))

    def _best(self, scores: np.ndarray, skip: np.ndarray | None) -> np.ndarray:
        at = np.flatnonzero(scores > 0 if skip is None else (scores > 0) & ~skip)
        found = scores[at]
        if len(at) > self.k:
            at = at[found >= np.partition(found, len(at) - self.k)[len(at) - self.k] - 1e-11]
        rounded = np.round(scores[at], 12)
        return at[np.lexsort((self.ids[at], -rounded))[: self.k]]

    def vote(self, terms: np.ndarray, weights: np.ndarray, skip: np.ndarray | None = None) -> tuple[float | None, np.ndarray]:
        """Log of the odds of the neighbours' votes, and their positions."""
        at, cosines = self.nearest(terms, weights, skip) if len(terms) else (np.empty(0, np.int64), None)
        if not len(at):
            return None, at
        w = 1 / (1.02 - np.minimum(cosines, 1)) - 1 / 1.02
        toxic = float((w * self.toxic[at]).sum())
        return math.log((toxic + 1) / (float(w.sum()) - toxic + 1)), at

    def score(self, text: str | None, cache: dict) -> tuple[float, list[int]]:
        odds, at = self.vote(*self.vector(text, cache))
        p = self.without if odds is None else 1 / (1 + math.exp(-(self.slope * odds + self.shift)))
        return p, self.ids[at].tolist()


def _ranges(low: np.ndarray, high: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [low, high), and for each what ``of`` has of its range."""
    sizes = high - low
    numbers = np.repeat(high - np.cumsum(sizes), sizes)
    numbers += np.arange(len(numbers))
    return numbers, np.repeat(of, sizes)


def _groups(sets: list[set[str]], labels: np.ndarray, rare: float = 0.01) -> np.ndarray:
    """A number for each example, equal for near copies under one label, so that a group's own words
    don't look like signs of its label: an example joins the first with which it shares any of four
    min-hashes of its rare words."""
    df = Counter(t for s in sets for t in s)
    met: dict[tuple, int] = {}
    out = np.arange(len(sets))
    for i, words in enumerate(sets):
        few = [t.encode() for t in words if df[t] <= max(2, rare * len(sets))]
        marks = [(j, int(labels[i]), min(zlib.crc32(t, j) for t in few)) for j in range(4)] if few else []
        out[i] = min([met[m] for m in marks if m in met], default=i)
        for m in marks:
            met.setdefault(m, int(out[i]))
    return out


def build(rows: list[tuple[int, str, int]], rate: float, k: int = 15, min_df: int = 2, max_df: float = 0.05, floor: float = 0.01, block: int = 64) -> Index | None:
    """rows: (doc_id, text, toxic). rate: the share of toxic among all labelled rows."""
    rows = sorted(rows, key=lambda r: r[0])
    if not rows:
        return None
    label = np.array([r[2] for r in rows])
    sets = [set(_words((r[1] or "").lower())) for r in rows]
    group = _groups(sets, label)
    one = np.flatnonzero(group == np.arange(len(rows)))
    df, clean, once, hits = Counter(), Counter(), Counter(), Counter()
    for i, words in enumerate(sets):
        seen = {t for word in words for t in terms_of(word)}
        df.update(seen)
        if not label[i]:
            clean.update(seen)
        if group[i] == i:
            once.update(seen)
            if label[i]:
                hits.update(seen)
    n, n_clean = len(rows), int((label == 0).sum())
    chosen = sorted(t for t, d in df.items() if d >= min(min_df, n) and clean[t] <= max(3, max_df * n_clean))
    vocabulary = {t: i for i, t in enumerate(chosen)}
    m, pos = len(one), int(label[one].sum())
    d, a = np.array([once[t] for t in chosen], float), np.array([hits[t] for t in chosen], float)
    var = d * (pos / m) * (1 - pos / m) * (1 - d / m) * m / max(1, m - 1)
    chi2 = np.divide((a - d * pos / m) ** 2, var, out=np.zeros(len(chosen)), where=var > 0)
    # The greatest of so many chi-squareds (1 degree of freedom) is about 2 ln(terms) by chance.
    relevance = floor + np.maximum(0, chi2 - 2 * math.log(max(2, len(chosen)))) / m
    idf = np.array([math.log((1 + n) / (1 + df[t])) + 1 for t in chosen])
    none, zero = np.empty(0, np.int64), np.zeros(len(chosen) + 1, np.int64)
    index = Index(vocabulary, idf * relevance, k, block, none, np.empty(0), none, zero, none, np.empty(0), np.zeros(1, np.int64), none, np.empty(0))
    cache: dict = {}
    vectors = [index.vector(r[1], cache) for r in rows]
    has = [i for i, (terms, _) in enumerate(vectors) if len(terms)]
    has.sort(key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), int(group[i]), rows[i][0]))
    index.ids, index.toxic, index.group = np.array([rows[i][0] for i in has], np.int64), label[has].astype(float), group[has]
    if has:
        term = np.concatenate([vectors[i][0] for i in has])
        example = np.repeat(np.arange(len(has)), [len(vectors[i][0]) for i in has])
        order = np.lexsort((example, term))
        term, example, value = term[order], example[order], np.concatenate([vectors[i][1] for i in has])[order]
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (example[1:] // block != example[:-1] // block)]))
        index.first, index.blocks = np.searchsorted(term[new], np.arange(len(chosen) + 1)), example[new] // block
        index.maxima, index.start = np.maximum.reduceat(value, new), np.append(new, len(term))
        index.example, index.value = example, value
    weight = np.where(label == 1, rate / max(label.mean(), 1e-9), (1 - rate) / max(1 - label.mean(), 1e-9))
    out = [i for i in range(n) if not len(vectors[i][0])]
    index.without = float((weight[out] * label[out]).sum() / max(weight[out].sum(), 1e-9)) if out else rate
    votes, ys, ws = [], [], []
    for i in has:
        odds, _ = index.vote(*vectors[i], index.group == group[i])
        if odds is not None:
            votes.append(odds)
            ys.append(label[i])
            ws.append(weight[i])
    if votes:
        _fit(index, np.array(votes), np.array(ys, float), np.array(ws))
    return index


def _fit(index: Index, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
    """Weighted logistic regression of y on x by Newton's method, lightly regularised."""
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        grad = design.T @ (w * (y - p)) - 0.1 * beta
        step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    index.slope, index.shift = float(beta[0]), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, max_toxic: int = 1500, max_clean: int = 3000, max_chars: int = 50_000_000, **options) -> Index | None:
    """Learn from labelled documents outside fold 0."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc_mod("doc_id", folds) != 0)
    counts = {r["toxic"]: r["count"] for r in known.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).count().collect()}
    if not counts:
        return None
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.where("toxic = 1").orderBy(*order).limit(max_toxic).union(known.where("toxic <> 1").orderBy(*order).limit(max_clean))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    sizes = rows.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n")).orderBy(*order).collect()
    chosen, room = [], max_chars
    for r in sizes:
        if r["n"] <= room:
            room -= r["n"]
            chosen.append((r["doc_id"],))
    few = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long"))
    rows = rows.join(few, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    return build([(r["doc_id"], r["text"], int(r["toxic"] == 1)) for r in rows], counts.get(1, 0) / sum(counts.values()), **options)


def score(docs: DataFrame, index: Index | None) -> DataFrame:
    """doc_id, score, predicted, evidence of each whole text."""
    schema = "doc_id long, score double, predicted int, evidence array<long>"
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batch):
        index, cache = shared.value, kept(__name__).setdefault("terms", {})
        found = [index.score(x.as_py(), cache) if index else (0.0, []) for x in batch.column("text")]
        p = [x[0] for x in found]
        return {"doc_id": batch.column("doc_id"), "score": p, "predicted": [int(x >= 0.5) for x in p], "evidence": [x[1] for x in found]}

    return map_arrow(docs.select("doc_id", "text"), schema, run)
