import numpy as np

from veridelta.llm import toxicity


def test_a_query_sorts_its_neighbours_once_and_keeps_beginnings_only():
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 5, n)) for n in rng.integers(2, 11, 400)]
    rows = [(i, " ".join(rng.choice(words, 40)), int(i % 4 == 0)) for i in range(200)]
    index = toxicity.build(rows, 0.25, max_df=1.0, block=8)
    sorts, best = [], index._best
    index._best = lambda *a: sorts.append(1) or best(*a)
    cache = {}
    dense = np.zeros((len(index.ids), len(index.vocabulary)))
    for t in range(len(index.vocabulary)):
        at = slice(index.start[index.first[t]], index.start[index.first[t + 1]])
        dense[index.example[at], t] = index.value[at]
    for _, text, _ in [*rows[:50], (0, "zzzz zz", 0), (0, None, 0)]:
        terms, weights = index.vector(text, cache)
        plain = [index.vocabulary[t] for w in (text or "").split() for t in toxicity.terms_of(w) if t in index.vocabulary]
        known, counts = np.unique(np.array(plain, int), return_counts=True)
        assert (terms == known).all()
        if len(known):
            raw = (1 + np.log(counts)) * index.weight[known]
            assert np.allclose(weights, raw / np.sqrt((raw * raw).sum()))
            sorts.clear()
            at, cosines = index.nearest(terms, weights)
            exact = dense[:, terms] @ weights
            assert len(sorts) == 1 and np.allclose(cosines, np.sort(exact)[::-1][: len(at)]) and np.allclose(exact[at], cosines)
    assert cache and max(map(len, cache)) <= 5
