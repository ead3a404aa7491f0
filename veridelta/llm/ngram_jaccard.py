r"""N-gram Jaccard join: size-aware, heavy-light, exact.

A document's set holds its distinct ``width``-word shingles (with fewer words, the whole sequence as
one), A-Z lower-cased, words ``[^\x20\x09-\x0D]+``. Two documents link when 100 * |intersection| >=
``percent`` * |union|. Each document gets its set size and the smallest doc_id reachable by links.

Equal sets are one class first. Then, by set size:

* Small sets enumerate subsets. If two sets link, the larger of size x, they share a subset of size
  ceil(x * percent / 100); so a set lists its subsets of each such size that a partner could need.
  The boundary is chosen by cost: the greatest size up to which listing subsets costs less than
  posting shingles and scanning the lists they stand in, with list lengths as surveyed in the data.
* Large sets (and small ones that can have a large partner) post their rarest shingles to inverted
  lists: linked sets share one of the first |s| - ceil(|s| * percent / 100) + 1 in any common order.
  Lists are scanned with length and position bounds on the overlap.

The common order puts heavy shingles (those that repeat within what a task reads, summed over all
documents) last, so a passage that many documents share is posted by few of them. The table of heavy
shingles sent to the tasks holds at most ``max_heavy`` entries; it only orders, and any order is right.

Links are verified on whole sets, in rounds. In a star round each list names a few classes of its
largest component, drawn anew by a hash, and every class outside it is verified against those it
meets most often: at most ``partners`` of them. Star rounds go on while they find links, so a group
of near copies joins at a cost in proportion to its size. The last round is exact: every remaining
pair of classes in different components that can link is verified. Pairs inside a component aren't
formed. A pair is formed only if set sizes and positions in the lists leave it possible, and its sets
are compared only if their parity sketches do: their Hamming distance is at most the symmetric difference.
Members meet their centre in salted streams sorted with the centre first: nothing gathers a group
in memory.

Shingles are compared by 64-bit hashes, classes by 64-bit digests of sorted hashes.

Null and empty texts, and texts without words, have an empty set: linked with nothing, their component
is themselves. Rows with null doc_id take no part; their component is null. Repeated rows give repeated
results; one doc_id with several texts is linked by each. Ties go to smaller ids. Other columns are not
read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridelta.llm.common import WordHashes, bounded_batches, commonest, discard, give_back, kept, map_arrow, mixed, pa_schema, rolling, shared_dir, stored, words_of

#: Greatest size of sets that may list subsets: a set of 12 has 924 subsets of 6.
MOST_SMALL = 12
#: Bits of the parity sketch of sets of up to half as many shingles.
SKETCH = 2048


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's set."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    state = kept(__name__)
    if "hashes" not in state:
        state["hashes"] = WordHashes()
    h = state["hashes"].of(words)
    return np.unique(rolling(h, width if len(h) >= width else len(h)))


def digest(h: np.ndarray) -> int:
    """The class of a set, as a signed 64-bit number."""
    value = xxhash.xxh3_64_intdigest(h.tobytes())
    return value - (1 << 64) if value >> 63 else value


def need(n, percent: int):
    """Least overlap with a set that isn't smaller: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def subset_sizes(n: int, percent: int) -> list[int]:
    return sorted({need(x, percent) for x in range(n, n * 100 // percent + 1)})


def parities(h: np.ndarray) -> np.ndarray:
    """Bit i of the sketch: whether an odd number of hashes falls into bucket i. A shingle that only
    one of two sets holds changes one bit, so sketches differ in at most as many bits as sets do.
    There are twice as many buckets as hashes or more; halves of a sketch combine to a smaller one."""
    buckets = SKETCH << ((len(h) - 1) * 2 // SKETCH).bit_length()
    odd = np.bincount((h & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def boundary(percent: int, scanned: dict[int, tuple[int, int]]) -> int:
    """The greatest set size that enumerates subsets. scanned: for each small size the number of
    sets, and the entries they would post or scan in inverted lists."""
    small = 0
    for n in range(1, MOST_SMALL + 1):
        sets, entries = scanned.get(n, (0, 0))
        by_lists = entries / sets if sets else 2.0 * (n - need(n, percent) + 1)
        if sum(comb(n, m) for m in subset_sizes(n, percent)) > by_lists:
            break
        small = n
    return small


def _survey(docs: DataFrame, width: int, flush: int = 2_000_000) -> DataFrame:
    """One reading of all texts. Rows with h null: doc_id, n, did, the set size and class of every
    document, its sketch, and the set itself of small ones. Rows with h: a shingle that two or more different
    texts of one task's share hold, and in how many (c)."""
    schema = "doc_id long, n long, did long, sketch array<long>, few array<long>, h long, c long"
    target = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, seen = [], 0, set()

        def shared():
            h = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
            c = np.diff(np.append(first, len(h)))
            h, c = h[first[c > 1]], c[c > 1]
            none = pa.nulls(len(h), pa.int64())
            few = pa.nulls(len(h), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([none, none, none, few, few, pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], schema=target)

        for batch in batches:
            ns, dids, sketches, few = [], [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), width)
                ns.append(len(s))
                dids.append(digest(s) if len(s) else None)
                sketches.append(parities(s) if len(s) else None)
                few.append(s.view(np.int64) if 0 < len(s) <= MOST_SMALL else None)
                if len(s) and dids[-1] not in seen:
                    if len(seen) < 100_000:
                        seen.add(dids[-1])
                    parts.append(s)
                    size += len(s)
                    if size >= flush:
                        yield shared()
                        parts, size = [], 0
            none = pa.nulls(len(ns), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(dids, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (sketches, few)), none, none], schema=target)
        yield shared()
        kept(__name__).clear()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _scanned(survey: DataFrame, percent: int, shared: Broadcast) -> dict[int, tuple[int, int]]:
    """For each size of small sets: how many, and the entries that their posted shingles would post
    and scan, list lengths taken from the table of heavy shingles."""
    small = survey.where("few is not null").groupBy("did").agg(F.any_value("few").alias("few"))

    def work(batch):
        known, counts = shared.value
        ns, entries = [], []
        for few in batch.column("few").to_pylist():
            n, sizes = len(few), np.ones(len(few), np.int64)
            if len(known):
                h = np.array(few, np.int64).view(np.uint64)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                sizes = np.where(known[at] == h, counts[at], 1)
            ns.append(n)
            entries.append(int((1 + np.sort(sizes))[: n - need(n, percent) + 1].sum()))
        return {"n": ns, "entries": entries}

    rows = map_arrow(small.select("few"), "n long, entries long", work).groupBy("n").agg(F.count("*").alias("sets"), F.sum("entries").alias("entries"))
    return {r["n"]: (r["sets"], r["entries"]) for r in rows.collect()}


def _heavy(survey: DataFrame, least: int, max_heavy: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles, at most max_heavy: sorted hashes and their counts."""
    rows = survey.where("h is not null").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    found = commonest(rows, "c", max_heavy).toArrow()
    h, c = np.asarray(found.column("h")).astype(np.int64).view(np.uint64), np.asarray(found.column("c")).astype(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _rarest(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Positions in the common order: by rank, then by a mix of the hash, then by the hash."""
    key = mixed(s)
    short = (np.minimum(rank, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24))
    order = np.argsort(short)
    in_order = short[order]
    # Equal short keys are a matter of chance; then the whole key decides.
    return order if (in_order[1:] != in_order[:-1]).all() else np.lexsort((s, key >> np.uint64(24), short >> np.uint64(40)))


def _postings(docs: DataFrame, width: int, percent: int, small: int, shared: Broadcast) -> DataFrame:
    """h, did, n, pos, own: entries of the inverted lists; subsets have pos -1. own is the number of
    posted shingles of the class that aren't known to repeat."""
    schema = "h long, did long, n int, pos int, own int"
    target = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        known, counts = shared.value
        for batch in batches:
            hs, dids, ns, ats, owns = [], [], [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), width)
                n = len(s)
                did = digest(s) if n else None
                if did is None or did in seen:
                    continue
                if len(seen) < 100_000:
                    seen.add(did)
                signs = []
                if n <= small:
                    signs = [rolling(np.array(x, np.uint64), m) for m in subset_sizes(n, percent) for x in combinations(s.tolist(), m)]
                    hs.extend(signs)
                    ats.append(np.full(len(signs), -1, np.int32))
                p, own = 0, n
                if n > small or n * 100 // percent > small:
                    p = n - need(n, percent) + 1
                    rank = np.zeros(n, np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        rank = np.where(known[at] == s, counts[at], 0)
                    first = _rarest(s, rank)[:p]
                    own = int((rank[first] == 0).sum())
                    hs.append(s[first])
                    ats.append(np.arange(p, dtype=np.int32))
                dids.append(np.full(len(signs) + p, did, np.int64))
                ns.append(np.full(len(signs) + p, n, np.int32))
                owns.append(np.full(len(signs) + p, own, np.int32))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(dids)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(ats)), pa.array(np.concatenate(owns))], schema=target)

        kept(__name__).clear()
        give_back()

    return docs.select("text").mapInArrow(run, schema)


def _can_link(percent: int):
    """Length and position bounds for entries a and b of one list (columns n, pos, n2, pos2)."""
    n, n2 = F.col("n"), F.col("n2")
    least, most = F.least(n, n2), F.greatest(n, n2)
    overlap = F.least(n - F.col("pos"), n2 - F.col("pos2"))
    # overlap / (n + n2 - overlap) >= percent / 100
    return (100 * least >= percent * most) & ((F.col("pos") < 0) | (F.col("pos2") < 0) | ((100 + percent) * overlap >= percent * (n + n2)))


def _near(pairs: DataFrame, sketches: DataFrame, percent: int, few: int = 1_000_000) -> DataFrame:
    """Those pairs whose sketches differ in no more bits than linked sets of their sizes can. Of the
    sketches (did, sketch, n; copies have the same) only those of the pairs' classes are shuffled, if
    these are few: then their ids, 8 bytes each, go to every task. Otherwise all are, and give the same."""
    asked = pairs.select(F.col("a").alias("did")).union(pairs.select("b")).distinct()
    asked = F.broadcast(asked) if asked.count() <= few else asked
    sketches = sketches.join(asked, "did", "left_semi").groupBy("did").agg(F.any_value("sketch").alias("sketch"), F.any_value("n").alias("n"))
    side = lambda c: sketches.select(F.col("did").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("n").alias(f"n_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    xor = lambda x, y: x.bitwiseXOR(y)
    half = lambda c: (F.size(c) / 2).cast("int")
    folded = lambda c: F.zip_with(F.slice(c, F.lit(1), half(c)), F.slice(c, half(c) + 1, half(c)), xor)
    for _ in range((-(-100 // percent)).bit_length()):  # linked sets differ in size by that factor at most
        greater = {c: F.when(F.size(c) > F.size(other), folded(c)).otherwise(F.col(c)) for c, other in (("sketch_a", "sketch_b"), ("sketch_b", "sketch_a"))}
        both = both.withColumns(greater)
    differ = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda t, x: t + x)
    return both.where((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, block: int = 64, stream: int = 1000, few: int = 500_000) -> DataFrame:
    """Those pairs (a, b) of classes that link, by their whole sets.

    Centres b are dealt into blocks of about ``block``. The set of a travels once to each block that
    holds partners of it, with their names; so many partners in a block cost one journey. A block
    with many members is split into streams, each of which gets the block's centres first."""
    n_members, n_centres = pairs.agg(F.count_distinct("a"), F.count_distinct("b")).collect()[0]
    n_blocks = n_centres // block + 1
    placed = pairs.withColumn("block", F.pmod(F.xxhash64("b"), F.lit(n_blocks)))
    members = placed.groupBy("a", "block").agg(F.collect_set("b").alias("bs"))
    sizes = members.groupBy("block").agg(F.ceil(F.count("*") / stream).alias("salts"))
    members = members.join(sizes, "block").select(F.col("a").alias("did"), "block", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"), F.lit(1).alias("role"), "bs")
    centres = placed.select("b", "block").distinct().join(sizes, "block")
    centres = centres.select(F.col("b").alias("did"), "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.array().cast("array<long>").alias("bs"))
    jobs = members.unionByName(centres).groupBy("did").agg(F.collect_list(F.struct("block", "salt", "role", "bs")).alias("jobs"))
    asked = jobs.join(reps.select("did", "doc_id"), "did")
    docs = docs.select("doc_id", "text")
    if n_centres + n_members <= few:
        # Few ids, 8 bytes each, go to every task, so that only the texts asked for are shuffled.
        docs = docs.join(F.broadcast(pairs.select(F.col("a").alias("did")).union(pairs.select("b")).distinct().join(reps, "did").select("doc_id")), "doc_id", "left_semi")
    rows = docs.join(asked, "doc_id")
    schema = "block long, salt long, role int, did long, bs array<long>, shingles binary"
    target = pa_schema(schema)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target, strict=True)], schema=target)
        for batch in batches:
            out, size = tuple([] for _ in target), 0
            for text, did, jobs in zip(batch.column("text"), batch.column("did").to_pylist(), batch.column("jobs").to_pylist(), strict=True):
                s = shingles(text.as_py(), width)
                if not len(s) or digest(s) != did:
                    continue
                raw = s.tobytes()
                for job in jobs:
                    for column, x in zip(out, (job["block"], job["salt"], job["role"], did, job["bs"], raw), strict=True):
                        column.append(x)
                    size += len(raw)
                    if size > 8_000_000:
                        yield made(out)
                        out, size = tuple([] for _ in target), 0
            yield made(out)
        kept(__name__).clear()
        give_back()

    found = pa_schema("a long, b long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, {}
        for batch in batches:
            a, b = [], []
            for block, salt, role, did, bs, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "role", "did", "bs")), batch.column("shingles"), strict=True):
                if at != (block, salt):
                    at, centres = (block, salt), {}
                s = np.frombuffer(raw.as_py(), np.uint64)
                if role == 0:
                    centres[did] = s
                    continue
                for partner in bs:
                    centre = centres.get(partner)
                    if centre is not None:
                        where = np.minimum(np.searchsorted(centre, s), len(centre) - 1)
                        both = int((centre[where] == s).sum())
                        if 100 * both >= percent * (len(s) + len(centre) - both):
                            a.append(did)
                            b.append(partner)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=found)
        centres.clear()
        give_back()

    sets = rows.select("text", "did", "jobs").mapInArrow(expand, schema)
    return sets.repartition("block", "salt").sortWithinPartitions("block", "salt", "role").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, base: str, name: str) -> DataFrame:
    """did, root of every node of the edges (a, b): alternating large and small stars."""
    spark = edges.sparkSession
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), base, f"{name}-0")
    for turn in count(1):  # until stable: the number of turns grows with the logarithm of the nodes
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        star = large.join(low2, large["a"] == low2["k"])
        small = star.select("b", "m").where("b <> m").union(star.select("a", "m")).toDF("a", "b").distinct()
        del both, low, large, low2, star
        small = stored(small, base, f"{name}-{turn}")
        same = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect() == small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()
        discard(spark, base, f"{name}-{turn - 1}")
        edges = small
        if same:
            break
    return edges.select(F.col("a").alias("did"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def link(docs: DataFrame, width: int = 5, percent: int = 75, least_heavy: int = 6, max_heavy: int = 1_000_000, partners: int = 6, gain: float = 0.1) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs. Star rounds end when less than the
    share ``gain`` of the pairs they verify are links; the exact round follows in any case."""
    spark = docs.sparkSession
    base = shared_dir(spark)
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    survey = stored(_survey(docs, width), base, "survey")
    sketch = survey.where("h is null").select("doc_id", "n", "did")
    reps = sketch.where("did is not null and doc_id is not null").groupBy("did").agg(F.min("doc_id").alias("doc_id"))
    heavy = spark.sparkContext.broadcast(_heavy(survey, least_heavy, max_heavy))
    small = boundary(percent, _scanned(survey, percent, heavy))
    entries = stored(_lists(_postings(docs.where("doc_id is not null"), width, percent, small, heavy), percent), base, "entries-0")
    heavy.unpersist()
    labels, edges, turn, star = None, None, 0, True
    while True:
        pairs = stored(_stars(entries, percent, partners, turn) if star else _all_pairs(entries, percent), base, f"pairs-{turn}")
        asked = pairs.count()
        near = stored(_near(pairs, survey.where("sketch is not null"), percent), base, f"near-{turn}")
        found = None if near.isEmpty() else stored(_verify(near, reps, docs, width, percent), base, f"links-{turn}")
        discard(spark, base, f"pairs-{turn}", f"near-{turn}")
        links = found.count() if found is not None else 0
        if links:
            edges = found if edges is None else edges.union(found)
            labels = components(edges, base, f"labels-{turn}")
        if not star:
            break
        star = links > gain * asked
        if links:
            # Components only grow: a list that holds one alone is done with.
            entries = stored(_open_lists(entries, labels, percent), base, f"entries-{turn + 1}")
            discard(spark, base, f"entries-{turn}")
        turn += 1
    roots = reps.withColumn("root", F.col("did")) if labels is None else reps.join(labels, "did", "left").withColumn("root", F.coalesce("root", "did"))
    smallest = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = roots.join(smallest, "root").select("did", "component_id")
    out = sketch.join(classes, "did", "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), whole.alias("component_id"))


def _lists(posted: DataFrame, percent: int) -> DataFrame:
    """The inverted lists of two classes or more: h, did, n, pos, own, root (of no component yet), top."""
    return _topped(_in_reach(posted.withColumn("root", F.col("did")), percent).dropDuplicates(["h", "did"]))


def _open_lists(lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Entries of the lists that still hold two components or more."""
    return _topped(_in_reach(lists.drop("root", "top").join(labels, "did", "left").withColumn("root", F.coalesce("root", "did")), percent))


def _topped(entries: DataFrame) -> DataFrame:
    """Entries with their list's largest component as top. Like _in_reach, all within the lists: one shuffle does for both."""
    counted = entries.withColumn("m", F.count("*").over(Window.partitionBy("h", "root")))
    most = F.max(F.struct("m", "root")).over(Window.partitionBy("h"))
    return counted.withColumn("top", most["root"]).drop("m")


def _in_reach(entries: DataFrame, percent: int) -> DataFrame:
    """Entries that can have a partner: their list holds several components, and the next smaller or
    the next greater set there is within the bounds on size and, for the greater, position."""
    by_size = Window.partitionBy("h").orderBy("n")
    whole = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, below, above = F.col("n"), F.lag("n").over(by_size), F.lead("n").over(by_size)
    # overlap / (n + above - overlap) >= percent / 100, with an overlap of n - pos at most
    most = F.when(F.col("pos") < 0, n).otherwise(n - F.col("pos"))
    near = (100 * below >= percent * n) | ((100 * n >= percent * above) & ((100 + percent) * most >= percent * (n + above)))
    marked = entries.withColumns({"lo": F.min("root").over(whole), "hi": F.max("root").over(whole), "near": near})
    return marked.where("lo <> hi and near").select("h", "did", "n", "pos", "own", "root")


def _posted(n, percent: int):
    return n - F.ceil(n * percent / 100) + 1


def _stars(entries: DataFrame, percent: int, partners: int, turn: int, centres: int = 4) -> DataFrame:
    """Pairs of a class (a) and a class of another component (b), at most ``partners`` for each a.

    A list offers as centres the most central classes of its largest component, in each round the
    next few: those that hold the least of their own, that is of shingles not known to repeat. The
    order is the same in all lists, so the lists that two classes share offer the same centres, and
    how often a class meets one tells how alike they are."""
    own = Window.partitionBy("h", "root").orderBy((F.col("own") / F.col("n")).asc(), F.xxhash64("did"), "did")
    size = F.count("*").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    numbered = entries.repartition("h").withColumns({"at": F.row_number().over(own) - 1, "size": size})
    centre = (F.col("root") == F.col("top")) & (F.pmod(F.col("at") - turn * centres, F.col("size")) < centres)
    # At most so many for each list; the rows of a list stay where they are, so that entries are shuffled once.
    offered = F.collect_list(F.when(centre, F.struct(F.col("did").alias("did2"), F.col("n").alias("n2")))).over(Window.partitionBy("h"))
    alike = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    near = numbered.withColumn("offered", offered).where("root <> top").select("did", "n", "pos", F.inline("offered")).where(alike)
    counted = near.groupBy("did", "did2").agg(F.count("*").alias("m"), F.max("n").alias("n"), F.min("pos").alias("pos"))
    # Likely ones only: the rest is left to the last round, which is exact.
    counted = counted.where((F.col("pos") < 0) | (10 * F.col("m") >= _posted(F.col("n"), percent)))
    best = Window.partitionBy("did").orderBy(F.desc("m"), "did2")
    return counted.withColumn("at", F.row_number().over(best)).where(F.col("at") <= partners).select(F.col("did").alias("a"), F.col("did2").alias("b"))


def _all_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Every pair of classes in different components that can link.

    Pairs form between the classes outside a list's largest component and all others there, where the
    bounds allow it: the join itself drops the rest."""
    minor = entries.where("root <> top").select("h", "did", "n", "pos", "root")
    others = entries.select(F.col("h").alias("h2"), F.col("did").alias("did2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("root").alias("root2"), (F.col("root") != F.col("top")).alias("minor2"))
    alike = (F.col("pos") < 0) == (F.col("pos2") < 0)
    # Two classes outside the largest component meet once, not twice.
    once = ~F.col("minor2") | (F.col("did") < F.col("did2"))
    near = minor.join(others, (F.col("h") == F.col("h2")) & (F.col("root") != F.col("root2")) & alike & once & _can_link(percent))
    return near.select(F.least("did", "did2").alias("a"), F.greatest("did", "did2").alias("b")).distinct()


def keep_one(docs: DataFrame, columns: list[str], **options) -> DataFrame:
    """The given columns of one document of each component: that of the smallest doc_id. Of rows with
    equal doc_id and text one stays. Rows with null doc_id are linked with nothing: all of them stay."""
    linked = link(docs, **options)
    # An id counts once for each of its texts in the component it names.
    ids = linked.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("_rows"))
    rows = docs.join(stored(ids, shared_dir(docs.sparkSession), "kept"), "doc_id")
    once = rows.where("_rows = 1").select(*columns)
    again = rows.where("_rows > 1").dropDuplicates(["doc_id", "text"]).select(*columns)
    return once.unionByName(again).unionByName(docs.where("doc_id is null").select(*columns))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, 1))) AS p FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, p + 1, p + 5), ' ') AS g FROM places),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(d, x) AS (SELECT doc_id, doc_id FROM w UNION SELECT d, b FROM reach JOIN edges ON a = x),
least AS (SELECT d, min(x) AS component_id FROM reach GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM w JOIN least ON d = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
