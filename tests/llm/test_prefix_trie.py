"""Conversation trie against prefixes counted in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from pondlake.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth long, head string, turns long, place int"


def brute(rows):
    said = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            said[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in said.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, kids, leaves, saved = defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed=1, groups=30):
    """Shared first turns, equal conversations, nulls, ties and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(groups * 5):
        if c % 15 == 10:
            continue  # some groups lack their first conversation
        last = rng.randrange(1, 9)
        for t in range(last):
            text = f"turn {t}" if rng.random() < 0.6 else rng.choice([None, "", f"é{rng.randrange(4)}"])
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", "user", None]), text))
        if c % 7 == 0:
            rows.append(rows[-1])
    for c in range(1000, 1060):  # one conversation many times
        rows += [(c, t, "user", f"same {t}") for t in range(12)]
    rows += [(None, 0, "user", "no conversation"), (5000, 0, None, None)]
    rows += [(6000 + k, t, "user", f"long {t}" if t < 150 else f"long {t} {k}") for k in range(3) for t in range(200)]
    return [(*r, 1, "h", 2, 3) for r in rows]


@pytest.mark.parametrize("limit,turns", [(4096, 1 << 18), (4, 1 << 18), (1, 1 << 18), (50, 300)])
def test_nodes_equal_prefixes_in_memory(spark, monkeypatch, limit, turns):
    monkeypatch.setattr(pt, "LIMIT", limit)
    monkeypatch.setattr(pt, "LIMIT_TURNS", turns)
    rows = conversations(groups=30 if limit > 1 else 4)
    if limit == 1:  # each burst goes one branching further
        rows = [r for r in rows if r[0] is None or r[0] < 1005]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = pt.trie(pt.rebuilt(pt.turn_lists(df))).collect()
    key = lambda r: (r[1], r[0], r[7], r[6], r[4])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_turnless_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pt.trie(pt.rebuilt(pt.turn_lists(empty))).count() == 0
    bare = spark.createDataFrame([(3, []), (1, [])], "conv_id long, turns array<struct<id:binary,bytes:int>>")
    got = pt.trie(bare).collect()
    assert [tuple(r) for r in got] == [(1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,3").hexdigest())]


def test_digest_of_many_ends_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(pt, "LIMIT", 10)
    n = 5000
    df = spark.range(n).selectExpr("id as conv_id", "cast(array() as array<struct<id:binary,bytes:int>>) as turns").repartition(7)
    got = pt.trie(df).collect()
    want = hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()
    assert [tuple(r) for r in got] == [(0, 0, None, n, 0, 1, 0, want)]
