"""The trie of conversations against one built from plain dictionaries of prefixes."""

import hashlib
import zlib

import numpy as np
import pytest

from larder.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, seq string, depth int"


def said(role, text):
    return hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()


def plain(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, said(role, text), len((text or "").encode().split())))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, saved, leaves = {}, {}, {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] = saved.get(k[:d], 0) + (len(m) - 1) * (k[-1][1] if k else 0)
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in kids)
    ends = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in members[k] if len(whole[c]) == len(k)))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], ends(k)) for k, m in members.items()), key=str)


def found(spark, rows):
    return sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA))).collect()), key=str)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_random(spark, seed):
    """Few different turns, so that prefixes are shared across blocks."""
    rng = np.random.default_rng(seed)
    rows = [(int(c), t, "u" if t % 2 else "a", "w " * int(rng.integers(1, 3))) for c in rng.permutation(200) for t in range(int(rng.integers(1, 6)))]
    assert found(spark, rows) == plain(rows)


def test_copies(spark):
    """A third of all conversations are alike: they lie in several blocks; and one has many turns."""
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 1200, 4) for t in range(3)]
    rows += [(c, t, "user", f"turn {t} {c if t > 1 else ''}") for c in range(1, 1200, 4) for t in range(4)]
    rows += [(5000, t, "user", f"turn {t}") for t in range(300)] + [(5001, t, "user", f"turn {t}") for t in range(299)]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "", ""), (2, 3, "a", "x y"), (2, 3, "a", "x y"), (2, 3, "b", "tie"), (2, 3, "a", "tie"), (None, 0, "a", "lost"), (40, 0, "a", "é b c"), (41, 0, "a", "z" * 100_000), (43, 0, "a", "own"), (-7, 0, "u", "below nought"), (-7, 1, "u", "more"), (63, 0, "only", "in its head")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[:1]) == plain(rows[:1])
    assert found(spark, []) == []


def test_smaller():
    x = np.random.default_rng(4).integers(0, 5, 200)
    before, after = prefix_trie.smaller(x)
    for i in range(200):
        assert before[i] == max([j for j in range(i) if x[j] < x[i]], default=-1)
        assert after[i] == min([j for j in range(i + 1, 200) if x[j] < x[i]], default=200)
