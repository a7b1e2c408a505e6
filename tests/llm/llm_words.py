"""Invented words and prose for tests."""

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "to") for b in ("ba", "den", "fir", "gol", "hum", "jat")]


def prose(seed, n, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))
