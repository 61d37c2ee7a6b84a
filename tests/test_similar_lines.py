"""Near-duplicate lines against the plain comparison with every line of the window."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.functions import similarity as S


def plain(keys, known, percent, window, least, learn):
    near, equal, flags = list(known), set(known), []
    for key in keys:
        rivals = near[-window:] if len(key) > least else []
        flags.append(not key or key not in equal and not any(S.at_least(key, rival, percent) for rival in rivals))
        if learn and key and flags[-1]:
            equal.add(key)
            near.append(key)
    return flags


def noisy(rng, lines):
    out = []
    for line in lines:
        letters = list(line)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(letters) + 1)
            letters[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "th", " "])
        out.append("".join(letters))
    return out


@given(st.integers(0, 10**6), st.sampled_from([50, 92, 96, 97, 98, 100]), st.sampled_from([1, 3, 80]), st.sampled_from([0, 12]), st.booleans())
@settings(max_examples=150, deadline=None)
def test_lines_match_plain_comparison(seed, percent, window, least, learn):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abth ") for _ in range(rng.randint(0, 70))) for _ in range(12)]
    keys, known = noisy(rng, rng.choices(base, k=40)), noisy(rng, rng.choices(base, k=8))
    assert S._novel(keys, known, percent, window, least, learn) == plain(keys, known, percent, window, least, learn)


@given(st.text("abé ", max_size=30), st.text("abé ", max_size=30))
@settings(max_examples=300, deadline=None)
def test_common_length_of_like_strings(a, b):
    assert S.near_common_length(a, b) == S.common_length(a, b)


def test_lines_that_share_no_piece_are_not_compared():
    rng = random.Random(1)
    lines = [" ".join("%06x" % rng.getrandbits(24) for _ in range(40)) for _ in range(500)]
    keys = [line.replace("a", "o", 1) for line in lines]
    start = time.process_time()
    flags = S._novel(keys, lines[:400], 97, 400, 12, False)
    took = time.process_time() - start
    begin = time.process_time()
    assert flags[:5] + flags[-5:] == plain(keys[:5] + keys[-5:], lines[:400], 97, 400, 12, False)
    assert took < 10 * (time.process_time() - begin)  # 500 lines in less than the time of 100 plain ones
