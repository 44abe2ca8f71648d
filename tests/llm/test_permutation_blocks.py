"""One block of the permutation index against its definition."""

from __future__ import annotations

import inspect

import numpy as np

from sievelight.llm import permutation_index


def test_search_orders_64_pivots():
    assert inspect.signature(permutation_index.search).parameters["prefix"].default == 64


def test_block_against_its_definition():
    rng = np.random.default_rng(3)
    vectors = np.repeat(rng.normal(size=(150, 8)), 2, axis=0)
    ids, length, take = rng.permutation(300), 12, 60
    space = permutation_index.Space(vectors[:40:2].copy(), np.sqrt((vectors**2).sum(axis=1).max()), length)
    got = permutation_index.search_block(space, ids, vectors, ids[:9], vectors[:9], 20, 0.2, 1)
    orders, asked = space.orders(vectors, False), space.orders(vectors[:9], True)
    want = []
    for q in range(9):
        gain = [sum(length - max(a, int(np.flatnonzero(asked[q] == p)[0])) for a, p in enumerate(o) if p in asked[q]) for o in orders]
        least = sorted(gain)[-take]
        found = [(-(vectors[i] * vectors[q]).sum(), ids[i]) for i in range(300) if gain[i] >= least and ids[i] != ids[q]]
        want += [(ids[q], i, -s) for s, i in sorted(found)[:20]]
    assert list(got.itertuples(index=False, name=None)) == want
