"""The index of a shard: a seed reads the postings of its own terms only, and scores stay right while items leave."""

import numpy as np
import pytest

from lodeseek.llm import packing


def made(n=120):
    g = np.random.default_rng(8)
    tokens = [np.minimum(g.zipf(1.3, g.integers(1, 90)), 500).astype(np.uint32) for _ in range(n)]
    tokens += tokens[:5]  # equal items
    terms, tfs = zip(*(np.unique(t, return_counts=True) for t in tokens))
    sizes = np.array([len(t) for t in tokens])
    stats = packing.Statistics(len(tokens), float(sizes.mean()), np.bincount(np.concatenate(terms), minlength=501))
    return sizes, list(terms), list(tfs), stats


def test_a_seed_reads_its_own_terms():
    sizes, terms, tfs, stats = made()
    index, seed = packing.Index(sizes, terms, tfs, stats), terms[7]
    want = index.scores(seed, 60)
    others = ~np.isin(index.vocab, seed)
    index.weight[others[index.term]] = np.nan
    if hasattr(index, "matrix"):
        index.matrix[index.place[others & (index.place >= 0)]] = np.nan
    assert len(want) and np.array_equal(index.scores(seed, 60), want)


def test_scores_while_items_leave():
    sizes, terms, tfs, stats = made()
    index, g = packing.Index(sizes, terms, tfs, stats), np.random.default_rng(9)
    for _ in range(4):
        for seed in (0, 7, 50):
            for room in (0, 20, 60, 100):
                got = index.scores(terms[seed], room)
                few = index.items[index.sizes <= room]
                assert len(got) == len(few)
                for i, x in zip(few, got):
                    on = np.isin(terms[i], terms[seed])
                    n, f = stats.by_term[terms[i][on]], tfs[i][on]
                    idf = np.log(1 + (stats.items - n + 0.5) / (n + 0.5))
                    assert x == pytest.approx((idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sizes[i] / stats.mean))).sum())
                place = {i: x for i, x in zip(few.tolist(), got.tolist())}
                assert all(place[i] == place[120 + i] for i in range(5) if i in place and 120 + i in place)
        index.keep(g.random(len(index.items)) < 0.7)
