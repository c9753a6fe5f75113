import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lumenframe.llm import prefix_trie
from pyspark.sql import functions as F

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, digest int, node int"


def plain_rebuilt(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in convs.values():
        turns.sort()
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = convs.get(c - int(np.fmod(c, 5)), [])
        out[c] = [x[2:] for x in base[:h] + turns[h:]]
    return out


def plain(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[x] for x in children[node])
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]),
                    len(children[node]), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return sorted(out, key=str)


def fixture():
    rng = np.random.default_rng(4)
    rows = []
    for c in [*range(-7, 40), *range(100, 300)]:
        shared = c >= 200  # copies of one conversation
        for t in range(7 if shared else int(rng.integers(0, 10))):
            k = t if shared else int(rng.integers(0, 3))
            rows.append((c, t if t else None, [None, "user", "assistant"][k % 3], [None, "", "é" * k][k % 3] if not shared else f"t{t}"))
    rows += [(500, t, "user", "again and again") for t in range(300)] + [(505, t, "user", "again and again") for t in range(300)]
    rows += [(c, 0, "user", "very long " * 300_000) for c in (901, 902)]
    rows += [(7, 3, "user", "a"), (7, 3, "user", "a"), (7, 3, "assistant", "a"), (None, 1, "user", "lost"), (900, 0, "u", "ser")]
    return [(*r, 1, 2) for r in rows]


@pytest.mark.parametrize(("shards", "turns", "piece"), [(None, 64, 8192), (23, 64, 3), (23, 2, 8192), (1, 64, 8192)])
def test_matches_brute_force(spark, monkeypatch, shards, turns, piece):
    monkeypatch.setattr(prefix_trie, "SPLITTER_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "_PIECE", piece)
    rows = fixture()
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA)), shards)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == plain(plain_rebuilt(rows))


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(5, 0, "user", "a", 0, 0), (6, 0, "user", "b", 0, 0)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).transform(prefix_trie.first_turns).withColumn(
        "turns", F.slice("turns", 1, 0))).collect()
    assert [tuple(r) for r in got] == [(5, 0, None, 2, 0, 1, 0, hashlib.sha256(b"5,6").hexdigest())]


def test_empty_table(spark):
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame([], SCHEMA)))
    assert got.columns == COLUMNS and got.collect() == []


def test_agreeing_turns():
    path = bytes(np.random.default_rng(0).integers(0, 256, 160, np.uint8))
    for k in range(11):
        other = path[:16 * k] + bytes(16) * (10 - k)
        assert prefix_trie._agreeing(path, other) == k == prefix_trie._agreeing(path[:16 * k], path)
