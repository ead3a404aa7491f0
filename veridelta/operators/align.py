"""Page fingerprints and the alignment of two page sequences.

Pages: pair_id, side, page_index, page_number, plain_text. Elements: pair_id, side, page_index,
element_ordinal, element_type, text (and more). Fingerprints are expressions, worked out once for
each page. The alignment itself keeps a cursor and a set of matched pages, so it runs page by page
within a document pair; many pairs run at once. Of both sequences it holds the pages near the cursor,
and those of one side that wait for the other, compressed: no pair is gathered in memory.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridelta.functions.text import collapse_space, ratio, signature, tokens
from veridelta.sources.shared import bounded_batches, give_back

KEY = ("pair_id", "side", "page_index")

ALIGNMENTS = (
    "pair_id string, alignment_seq int, candidate_index int, baseline_index int, status string, score double, reason string, text_score double, token_score double, "
    "structure_score double, table_score double, image_score double, table_text_score double, page_distance_penalty double, expected_baseline_index int, "
    "forward_baseline_skip int, is_forward_sequence_match boolean, effective_search_window int, adaptive_search_used boolean"
)


#: What elements are compared by, where they have it.
EXTRA = ("bbox", "rows", "cols", "width", "height", "detection_method", "extension")


def fingerprints(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """One row for each page: normalized_text, its signature and tokens, counts by element type,
    table_text, headings, is_blank, and body, a digest of the elements. Pages with a column ``lines``
    hold their elements themselves, paragraphs all of them: elements isn't read."""
    if "lines" in pages.columns:
        return _line_fingerprints(pages)
    text = F.coalesce("text", F.lit(""))
    in_order = lambda keep, value: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("element_ordinal", value.alias("t"))))), lambda x: x["t"])
    has = F.trim(text) != ""
    extra = [c for c in EXTRA if c in elements.columns]
    sized = lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)
    content = F.concat(sized(F.coalesce("element_type", F.lit(""))), sized(text), F.coalesce(F.struct(*extra).cast("string"), F.lit("")) if extra else F.lit(""))
    of_page = elements.groupBy(*KEY).agg(
        F.array_join(in_order(F.lit(True), sized(content)), "").alias("_body"),
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("element_type", F.lit(0))))).alias("_types"),
        F.collect_list("element_type").alias("_all"),
        F.array_join(in_order(text != "", text), "\n").alias("_joined"),
        F.array_join(in_order((F.col("element_type") == "table") & has, F.trim(text)), " ").alias("_table"),
        F.slice(in_order(F.col("element_type").isin("title", "header") & has, F.trim(text)), 1, 5).alias("_heads"),
        F.bool_and(F.col("element_type") == "blank").alias("_only_blank"),
    )
    out = pages.join(of_page, list(KEY), "left")
    plain = F.coalesce("plain_text", F.lit(""))
    out = out.withColumn("normalized_text", collapse_space(F.when(plain != "", plain).otherwise(F.coalesce("_joined", F.lit("")))))
    none = F.array().cast("array<string>")
    counts = F.transform_values("_types", lambda k, v: F.size(F.filter("_all", lambda t: t == k)))
    heads = F.when(F.size(F.coalesce("_heads", none)) > 0, F.col("_heads")).when(F.col("normalized_text") != "", F.array(F.substring("normalized_text", 1, 120))).otherwise(none)
    table_text = collapse_space(F.coalesce("_table", F.lit("")))
    counts = F.coalesce(counts, F.map_from_arrays(none, F.array().cast("array<int>")))
    return out.select(*_prints(counts, table_text, heads, F.coalesce("_body", F.lit("")), (collapse_space(plain) == "") & F.coalesce("_only_blank", F.lit(True))))


def _line_fingerprints(pages: DataFrame) -> DataFrame:
    lines = F.coalesce("lines", F.array().cast("array<string>"))
    out = pages.withColumns({"lines": lines, "normalized_text": collapse_space(F.coalesce("plain_text", F.lit("")))})
    n = F.size("lines")
    counts = F.map_filter(F.create_map(F.lit("paragraph"), n), lambda k, v: v > 0)
    heads = F.filter(F.array(F.substring("normalized_text", 1, 120)), lambda x: x != "")
    return out.select(*_prints(counts, F.lit(""), heads, F.array_join("lines", "\n"), (F.col("normalized_text") == "") & (n == 0)))


def _prints(counts, table_text, heads, body, is_blank) -> list:
    return [
        *KEY, "page_number", "normalized_text", signature("normalized_text").alias("text_signature"), tokens("normalized_text").alias("tokens"), counts.alias("type_counts"),
        table_text.alias("table_text"), signature(table_text).alias("table_text_signature"), heads.alias("headings"), F.length("normalized_text").alias("text_length"), is_blank.alias("is_blank"),
        F.sha2(body, 256).alias("body"),
    ]


def _share(a: int, b: int) -> float:
    return 1.0 if a == b == 0 else 1.0 - abs(a - b) / max(a, b)


def most_ratio(left: str, right: str, counts=Counter) -> float:
    """An upper bound of ratio(), from the counts of characters."""
    if left == right or not left or not right:
        return ratio(left, right)
    few, many = counts(left), counts(right)
    both = sum(min(n, many.get(x, 0)) for x, n in few.items())
    return 2 * both / (len(left) + len(right))


def page_score(c: dict, b: dict, apart: int, ratio=ratio) -> dict:
    """The factors of a page pair, and their weighted sum less the distance penalty, in [0, 1]."""
    left, right = c["tokens"], b["tokens"]
    union = len(left | right)
    types = set(c["type_counts"]) | set(b["type_counts"])
    count = lambda p, t: p["type_counts"].get(t, 0)
    out = {
        "text_score": ratio(c["normalized_text"], b["normalized_text"]),
        "token_score": len(left & right) / union if union else 1.0,
        "structure_score": sum(_share(count(c, t), count(b, t)) for t in types) / len(types) if types else 1.0,
        "table_score": _share(count(c, "table"), count(b, "table")),
        "image_score": _share(count(c, "image"), count(b, "image")),
        "table_text_score": ratio(c["table_text"], b["table_text"]),
        "page_distance_penalty": min(0.15, 0.03 * apart),
    }
    raw = 0.45 * out["text_score"] + 0.20 * out["token_score"] + 0.15 * out["structure_score"] + 0.05 * out["table_score"] + 0.05 * out["image_score"] + 0.10 * out["table_text_score"] - out["page_distance_penalty"]
    return out | {"score": max(0.0, min(1.0, raw))}


class _Waiting:
    """Pages in order, which wait for the other side; beyond ``plain`` of them as compressed bytes."""

    def __init__(self, plain: int = 50):
        self.rows, self.plain = deque(), plain

    def __len__(self) -> int:
        return len(self.rows)

    def put(self, page: dict) -> None:
        self.rows.append(page if len(self.rows) < self.plain else zlib.compress(pickle.dumps(page), 1))

    def take(self) -> dict:
        page = self.rows.popleft()
        return pickle.loads(zlib.decompress(page)) if isinstance(page, bytes) else page


def _opened(page: dict) -> dict:
    """Tokens as a set and counts as a dict, made when they are first asked for."""
    if isinstance(page["tokens"], str):
        page["tokens"], page["type_counts"] = set(page["tokens"].split(" ")) - {""}, dict(page["type_counts"])
    return page


class _Walk:
    """The cursor over the baseline of one document pair. Pages are put in as they come, each side in
    order; rows come out as soon as the baseline is known as far as the search reaches."""

    def __init__(self, match: float, low: float, window: int, adaptive: bool, expanded: int | None):
        self.match, self.low, self.window, self.adaptive = match, low, max(0, window), adaptive
        self.most = max(self.window * 3, self.window + 3) if expanded is None else max(0, expanded)
        self.ahead = max(self.window, self.most if adaptive else 0)
        self.waiting = {"candidate": _Waiting(), "baseline": _Waiting()}
        self.near: dict[int, dict] = {}  # baseline pages that the search can still reach
        self.n, self.i, self.first, self.cursor = 0, 0, 0, 0
        self.page, self.used, self.deleted, self.known, self.counts = None, set(), [], {}, {}

    def put(self, side: str, page: dict) -> Iterator[dict]:
        self.waiting[side].put(page)
        yield from self.rows(False)

    def rows(self, ended: bool) -> Iterator[dict]:
        candidate, baseline = self.waiting["candidate"], self.waiting["baseline"]
        while len(candidate):
            while len(baseline) and self.n <= max(self.cursor + self.ahead, self.ahead):
                self.near[self.n] = baseline.take()
                self.n += 1
            if not ended and self.n <= self.cursor + self.ahead:
                return
            self.page = candidate.take()
            yield self.row(self.i)
            self.i += 1
            reach = max(0, self.cursor - self.ahead)
            for j in range(self.first, min(reach, self.n)):
                del self.near[j]
                if j in self.used:
                    self.used.discard(j)
                else:
                    self.deleted.append(j)
            self.first = max(self.first, min(reach, self.n))
        if ended:
            left = [j for j in range(self.first, self.n + len(baseline)) if j not in self.used]
            for j in (*self.deleted, *left):
                yield {"baseline_index": j, "score": 0.0, "status": "baseline_deleted", "reason": "no candidate page took this baseline page"}

    def counted(self, text: str) -> Counter:
        if text not in self.counts:
            if len(self.counts) > 4 * self.ahead + 8:
                self.counts.clear()
            self.counts[text] = Counter(text)
        return self.counts[text]

    def scored(self, i: int, j: int) -> dict:
        if (i, j) not in self.known:
            self.known[i, j] = page_score(_opened(self.page), _opened(self.near[j]), abs(i - j))
        return self.known[i, j]

    def best(self, i: int, reach: int) -> int | None:
        """The free page of the best score, the first of equal ones. Pages are scored in the order of
        their upper bounds, by lengths first, then by counts of characters."""
        free = (j for j in range(max(0, self.cursor - reach), min(self.n, self.cursor + reach + 1)) if j not in self.used)
        heap = [(-self.known[i, j]["score"], 2, j) if (i, j) in self.known else (-self.bound(i, j), 0, j) for j in free]
        heapify(heap)
        while heap:
            _, level, j = heappop(heap)
            if level == 2:
                return j
            heappush(heap, (-(self.scored(i, j)["score"] if level else self.close_bound(i, j)), level + 1, j))
        return None

    def bound(self, i: int, j: int) -> float:
        """At least the pair's score: the text ratio is replaced by what lengths allow, other factors
        by the most there is."""
        m, n = len(self.page["normalized_text"]), len(self.near[j]["normalized_text"])
        return 0.55 + 0.45 * (2 * min(m, n) / (m + n) if m and n else float(m == n)) - min(0.15, 0.03 * abs(i - j)) + 1e-9

    def close_bound(self, i: int, j: int) -> float:
        """As bound(), with text ratios replaced by the most they can be and all else worked out."""
        return page_score(_opened(self.page), _opened(self.near[j]), abs(i - j), lambda x, y: most_ratio(x, y, self.counted))["score"] + 1e-12

    def row(self, i: int) -> dict:
        self.known.clear()
        wide = min(self.most, self.n) if self.adaptive else 0
        j, reach, widened = self.best(i, self.window), self.window if self.n else 0, False
        score = self.scored(i, j)["score"] if j is not None else 0.0
        if score < self.low and wide > self.window:
            k = self.best(i, wide)
            if k is not None and (j is None or self.scored(i, k)["score"] > score):
                j, score, reach, widened = k, self.scored(i, k)["score"], wide, True
        found = j is not None and score >= self.low
        ahead = found and j >= self.cursor
        row = {"candidate_index": i, "baseline_index": j if found else None, "score": score, "expected_baseline_index": self.cursor, "effective_search_window": reach, "adaptive_search_used": widened}
        row |= {k: v for k, v in (self.scored(i, j) if j is not None else {}).items() if k != "score"}
        if not found:
            return row | {"status": "candidate_added", "reason": "no baseline page scores above the low-confidence threshold"}
        row |= {"forward_baseline_skip": max(0, j - self.cursor), "is_forward_sequence_match": ahead}
        sure = score >= self.match
        row["status"] = ("matched" if ahead else "possible_reordered") if sure else "low_confidence"
        row["reason"] = "score reaches the match threshold" + ("" if ahead else ", before the expected position") if sure else "score is between the thresholds"
        self.used.add(j)
        if ahead:
            self.cursor = j + 1
        return row


def align(prints: DataFrame, match: float = 0.75, low: float = 0.45, window: int = 2, adaptive: bool = True, expanded: int | None = None) -> DataFrame:
    """Alignments of each document pair (see ALIGNMENTS), alignment_seq tells their order. Only columns
    that scores need are shuffled and go to Python; tokens, which follow from the text, are made after
    the shuffle."""
    bounded_batches(prints.sparkSession)
    names = [c.split()[0] for c in ALIGNMENTS.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    target = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ALIGNMENTS.split(", ")])
    needed = prints.select(*KEY, "normalized_text", "type_counts", "table_text").repartition("pair_id").sortWithinPartitions(*KEY[::2], KEY[1])
    needed = needed.select("pair_id", "side", "normalized_text", F.array_join(tokens("normalized_text"), " ").alias("tokens"), "type_counts", "table_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, walk, seq, out = None, None, 0, []

        def made() -> pa.RecordBatch:
            columns = [pa.array([r.get(n) for r in out], f.type) for n, f in zip(names, target, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=target)

        def add(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            for row in rows:
                out.append({"pair_id": at, "alignment_seq": seq} | row)
                seq += 1
                if len(out) >= 2000:
                    yield made()
                    give_back()

        for batch in batches:
            pairs, sides = batch.column("pair_id").to_pylist(), batch.column("side").to_pylist()
            columns = {n: batch.column(n) for n in ("normalized_text", "tokens", "type_counts", "table_text")}
            for r, (pair, side) in enumerate(zip(pairs, sides, strict=True)):
                if walk is None or pair != at:
                    if walk is not None:
                        yield from add(walk.rows(True))
                    at, walk, seq = pair, _Walk(match, low, window, adaptive, expanded), 0
                if side in walk.waiting:
                    yield from add(walk.put(side, {n: c[r].as_py() for n, c in columns.items()}))
        if walk is not None:
            yield from add(walk.rows(True))
        yield made()
        walk = None
        give_back()

    return needed.mapInArrow(run, ALIGNMENTS)


def align_exact(prints: DataFrame) -> DataFrame:
    """Pairs of pages with one text: a plain join on the signature."""
    side = lambda s, p: prints.where(F.col("side") == s).select("pair_id", "text_signature", F.col("page_index").alias(f"{p}_index"))
    return side("candidate", "candidate").join(side("baseline", "baseline"), ["pair_id", "text_signature"])
