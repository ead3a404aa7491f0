import random
import re

import numpy as np

from veridelta.llm import ngram_jaccard as nj


def brute(rows, width=5, percent=75):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = width if len(words) >= width else len(words)
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in group}
    return sorted((rows[i][0], len(sets[i]), least[group[i]]) for i in range(len(rows)))


def near_copies(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 or not rows:
            text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        elif kind < 0.5:
            text = passage + [rng.choice(words) for _ in range(rng.randint(0, 40))]
        else:
            text = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    # Short sets, where subsets of shingles are listed.
    base = [f"s{i}" for i in range(14)]
    rows += [(n + k, " ".join(base[: 5 + k])) for k in range(10)]
    return rows


def test_against_brute_force(spark):
    rows = near_copies(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for heavy in (1, 10_000):
        found = sorted(tuple(r) for r in nj.link(docs, least_heavy=heavy).collect())
        assert found == brute(rows)


def test_odd_rows(spark):
    rows = [(3, None), (1, ""), (2, "  \n"), (5, "A b"), (4, "a B"), (None, "a b"), (4, "a B"), (7, "x " * 30)]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, did long, root long")
    found = sorted((tuple(r) for r in nj.link(docs).collect()), key=str)
    assert found == sorted([(3, 0, 3), (1, 0, 1), (2, 0, 2), (5, 1, 4), (4, 1, 4), (None, 1, None), (4, 1, 4), (7, 1, 7)], key=str)
    assert nj.link(docs.limit(0)).count() == 0


def test_keep_one(spark):
    rows = [(2, "a b c"), (1, "a b c"), (1, "a b c"), (3, "d"), (None, "a b c"), (None, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in nj.keep_one(docs, ["doc_id", "text"]).collect()]
    assert sorted(found, key=str) == sorted([(1, "a b c"), (3, "d"), (None, "a b c"), (None, None), (4, None)], key=str)


def test_common_order_is_total():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    rank = rng.integers(0, 3, len(h))
    key = nj.mixed(h) >> np.uint64(24)
    assert (nj._rarest(h, rank) == np.lexsort((h, key, rank))).all()


def test_sketches_never_differ_more_than_sets(spark):
    """Pairs that link always pass, at every size and across sizes of sketches."""
    rng = np.random.default_rng(1)
    pairs, sketches = [], []
    for n in (1, 2, 50, 900, 1020, 1100, 2000, 3000, 20_000):
        h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for j, (lost, own) in enumerate(((0, n // 3), (n // 4, 0), (n // 20, n // 20), (n // 2, n // 2))):
            other = np.unique(np.concatenate([h[lost:], rng.integers(0, 1 << 63, own, dtype=np.uint64)]))
            if len(other):
                a, b = 100 * n + j, -(100 * n + j)
                both = len(np.intersect1d(h, other))
                pairs.append((a, b, 100 * both >= 75 * (len(h) + len(other) - both)))
                sketches += [(a, nj.parities(h).tolist(), len(h)), (b, nj.parities(other).tolist(), len(other))]
    known = spark.createDataFrame(sketches, "did long, sketch array<long>, n long")
    left = {r.a for r in nj._near(spark.createDataFrame([p[:2] for p in pairs], "a long, b long"), known, 75).collect()}
    assert all(a in left for a, _, links in pairs if links)
    assert not any(a in left for a, _, links in pairs if not links and a > 5000)


def test_boundary_follows_list_lengths():
    lists = lambda length: {n: (10, 10 * length * (n - nj.need(n, 75) + 1)) for n in range(1, 13)}
    bounds = [nj.boundary(75, lists(x)) for x in (2, 20, 2000)]
    assert bounds == sorted(bounds) and bounds[0] < bounds[-1]


def test_very_long_text(spark):
    words = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, words), (2, words + " end"), (3, "w1 " + words)], "doc_id long, text string")
    assert sorted(tuple(r) for r in nj.link(docs).collect()) == [(1, 59_996, 1), (2, 59_997, 1), (3, 59_997, 1)]


def test_small_sets_share_a_subset():
    for n in range(1, 12):
        for x in range(n, n * 100 // 75 + 1):
            assert nj.need(x, 75) in nj.subset_sizes(n, 75) and nj.need(x, 75) in nj.subset_sizes(x, 75)


def test_star_rounds_shuffle_entries_once(spark):
    """And only sketches of classes asked for are shuffled, if these are few: fewer shuffles, the same pairs."""
    rng = random.Random(3)
    rows = sorted({(rng.randrange(40), d): (20, 0, rng.randrange(9)) for d in range(60) for _ in range(4)}.items())
    entries = spark.createDataFrame([(*k, *v, k[1] % 17) for k, v in rows], "h long, did long, n int, pos int, own int, root long")
    entries = nj.stored(nj._topped(entries), nj.shared_dir(spark), "entries")
    tops = {}
    for h in {k[0] for k, _ in rows}:
        roots = [k[1] % 17 for k, _ in rows if k[0] == h]
        tops[h] = max((roots.count(r), r) for r in roots)[1]
    assert {(r.h, r.top) for r in entries.collect()} == set(tops.items())
    stars = nj._stars(entries, 75, 6, 0)
    assert str(stars._jdf.queryExecution().executedPlan()).count("Scan parquet") == 1
    root = {k[1]: k[1] % 17 for k, _ in rows}
    pairs = {(r.a, r.b) for r in stars.collect()}
    exact = {(r.a, r.b) for r in nj._all_pairs(entries, 75).collect()}
    assert pairs and all(root[a] != root[b] for a, b in pairs)
    assert exact == {(min(x, y), max(x, y)) for (h, x), _ in rows for (g, y), _ in rows if h == g and root[x] != root[y]}
    sketches = spark.createDataFrame([(d, [d % 3] * 32, 20) for d in range(60)], "did long, sketch array<long>, n int")
    few, all_ = (nj._near(stars, sketches, 75, few=n) for n in (1_000_000, 0))
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in all_.collect()}
    exchanges = lambda df: str(df._jdf.queryExecution().optimizedPlan()).count("strategy=broadcast")
    assert exchanges(few) and not exchanges(all_)
