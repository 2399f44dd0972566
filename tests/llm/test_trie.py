"""The trie against a plain one over rebuilt conversations, and the defined cases."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from sievewright.llm.trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, Base int"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", (text or "")[:32], hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    turns = {c: [(x[2], x[5]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    ends = {n: ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(n)) for n, m in members.items()}
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()
    )


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted((tuple(r) for r in prefix_trie(df, **more).collect()), key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0, *r[3:]))


def want(rows):
    return sorted(brute(rows), key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0, *r[3:]))


def conversations(rng, ids, words=3, longest=9):
    rows = []
    for c in ids:
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), " ".join(rng.choice(["a", "é\U0001f600", ""]) for _ in range(rng.randint(0, words))), "x", 1))
    return rows


@pytest.mark.parametrize("most_nodes, block", [(100_000, 1 << 16), (3, 10)])
def test_brute_force(spark, most_nodes, block):
    rng = random.Random(7)
    ids = [*range(0, 40), *range(100, 140), *range(205, 240), 900, -1, -5, -100, -150, -199, 10**12 + 7]
    rows = conversations(rng, ids, words=1, longest=8)
    rng.shuffle(rows)
    assert found(spark, rows, most_nodes=most_nodes, block=block) == want(rows)


def test_copies_of_one_conversation(spark):
    """A third of all conversations are equal and lie in many families."""
    rng = random.Random(9)
    rows = [(c, t, "user", f"same {t}", None, None) for c in range(0, 6000, 7) for t in range(3)]
    rows += conversations(rng, [c for c in range(1, 3000, 3) if c % 7])
    assert found(spark, rows, block=64) == want(rows)


def test_long_conversation(spark):
    rows = [(5, t, "user", f"turn {t % 3}", None, None) for t in range(3000)] + [(105, t, "user", f"turn {t % 3}", None, None) for t in range(2000)] + [(100, t, "user", f"turn {t % 3}", None, None) for t in range(8)]
    got = found(spark, rows, most_nodes=100)
    convs = rebuilt(rows)
    assert len(got) == len({hashlib.sha256(repr(p[:d]).encode()).hexdigest() for p in convs.values() for d in range(len(p) + 1)})
    root = next(r for r in got if r[1] == 0)
    assert root[3] == 3 and max(r[1] for r in got) == max(len(p) for p in convs.values())


def test_defined_cases(spark):
    rows = [
        (None, 0, "user", "lost", "x", 1), (7, None, None, None, "x", 1), (7, None, "user", "null turn", "x", 1), (7, 1, "user", "b", "x", 1), (7, 1, "user", "a", "x", 1), (7, 1, "user", "a", "x", 1),
        (8, 1, "user", "q" * 40 + "1", "x", 1), (8, 1, "user", "q" * 40 + "2", "x", 1), (0, 3, "user", "only", "x", 1), (300, 0, "user", "", "x", 1), (301, 0, "user", "", "x", 1), (1301, 0, "user", "w" * 50_000, "x", 1),
    ]
    assert found(spark, rows) == want(rows)
    turnless = [(c, 0, "user", "x", None, None) for c in (401, 402, 403, 404, 405, 406, 407)]  # no base: with h > 0 nothing is left
    got = found(spark, turnless)
    assert got == want(turnless) and got[0][1] == 0 and len(got) == 1 + any(zlib.crc32(str(r[0]).encode()) % 6 == 0 for r in turnless)


def test_empty(spark):
    assert found(spark, []) == [] == found(spark, [(None, 1, "user", "x", None, None)])
