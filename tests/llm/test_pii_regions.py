"""Regions of the network reach to the ends of long mail addresses."""

import random
import time

from corvina.llm import pii


def covered(text):
    return {i for s, end in pii.placed_windows(text) for i in range(s, min(s + pii.LENGTH, end))}


def test_long_parts_are_covered():
    for local, domain in (("alexandra.montgomerywhitfieldson", "example.com"), ("a" * 31 + "1" + "b" * 40, "x.org"), ("ann", "d" * 90 + ".example.org"), ("q" * 300, "e" * 300 + ".org")):
        text = f"write to {local} @ {domain} today, or never, whatever you like better in the end"
        at = text.index("@")
        assert set(range(9, at + 2 + len(domain))) <= covered(text)


def test_all_surroundings_stay_covered():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a" * rng.randint(1, 50), " " * rng.randint(1, 40), "@", "7", "."]) for _ in range(rng.randint(1, 30)))
        near = {j for i, c in enumerate(text) if c in "@0123456789" for j in range(max(0, i - pii.AROUND), min(len(text), i + pii.AROUND + 1))}
        runs = {j for j in range(len(text)) if text[j] in pii.LOCAL}
        want = set(near)
        for i in near & runs:
            for step in (-1, 1):
                j = i
                while j in runs:
                    want.add(j)
                    j += step
        assert want <= covered(text)


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    pii.placed_windows(("a" * 30 + "1") * 20_000)
    assert time.perf_counter() - began < 10
