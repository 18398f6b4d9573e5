"""Packing: the shortest open pack, the one with the most room, takes the next length."""

import random
from collections import Counter

from defectlens.llm import op10_packing as packing


def _by_hand(lengths, size):
    packs = []
    for n in sorted(lengths, reverse=True):
        shortest = min(packs, key=sum, default=None)
        if shortest is not None and sum(shortest) + n <= size:
            shortest.append(n)
        else:
            packs.append([n])
    return packs


def test_the_shortest_pack_takes_the_next_length():
    assert sorted(packing.pack_histogram({7: 1, 6: 1, 3: 1}, 10)) == [((6, 3), 1), ((7,), 1)]


def test_sums_of_packs_equal_one_by_one():
    for seed in range(20):
        lengths = random.Random(seed).choices(range(1, 400), k=300)
        got = packing.pack_histogram(Counter(lengths), 400)
        assert sorted(sum(p) for p, c in got for _ in range(c)) == sorted(map(sum, _by_hand(lengths, 400)))
