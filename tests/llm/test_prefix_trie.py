import hashlib
import random
import zlib

import numpy as np

from ledgerspark.llm import prefix_trie
from ledgerspark.llm.prefix_trie import Louds


def conversations() -> list[tuple]:
    rng = random.Random(11)
    rows = []
    for c in [*range(-12, 60), 200, 203, 1001, 7777777777]:
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ü" * rng.randint(0, 3), None, "long " * 50]), "x", 3))
    rows += [(300 + k, t, "user", f"shared {t}", "x", 3) for k in range(40) for t in range(6)]  # copies
    rows += [(900, t, "user", f"t {t}", "x", 3) for t in range(130)] + [(905, t, "user", f"t {t}", "x", 3) for t in range(90)]  # long ones with a common start
    rows += [(905, None, "user", "before all", "x", 3), (905, 3, "user", "also three", "x", 3), (905, 3, "user", "t 3", "x", 3), (None, 1, "user", "nobody", "x", 3)]
    rows.append(rows[5])
    return rows


def brute(rows: list[tuple], group: int = 5, heads: int = 9) -> list[tuple]:
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h, b = zlib.crc32(str(c).encode()) % heads, c - (abs(c) % group) * (1 if c >= 0 else -1)
        built[c] = own.get(b, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {n: 0 for n in members}, {n: 0 for n in members}, {n: 0 for n in members}
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n, who in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(who) - 1) * len(n[-1][1]) if n else 0
    ends = lambda n: hashlib.sha256(",".join(map(str, sorted(c for c in members[n] if len(built[c]) == len(n)))).encode()).hexdigest()
    return sorted((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), children[n], leaves[n], saved[n], ends(n)) for n, who in members.items())


SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, first int"


def test_trie_matches_brute_force_with_and_without_upper_levels(spark, monkeypatch):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows)
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, prefix_trie.trie_nodes(df).collect()), key=key) == want
    monkeypatch.setattr(prefix_trie, "RUN_TURNS", 7)
    monkeypatch.setattr(prefix_trie, "SORTED_TURNS", 20)
    for shard_turns in (1, 40):
        assert sorted(map(tuple, prefix_trie.trie_nodes(df, shard_turns).collect()), key=key) == want


def test_no_rows_no_nodes_and_turnless_conversations(spark):
    assert prefix_trie.trie_nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    # a lone conversation that takes over more turns than it has keeps none of its own
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lone, 0, "user", "gone", "x", 1)]
    got = prefix_trie.trie_nodes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows) and len(got) == 1 and got[0]["n_leaves"] == 1


def test_louds_holds_the_tree_and_is_found_again():
    rng = np.random.default_rng(3)
    parent = np.array([-1, -1, *(int(rng.integers(0, i)) for i in range(2, 300))])
    level = np.zeros(300, np.int64)
    for i in range(300):
        level[i] = level[parent[i]] + 1 if parent[i] >= 0 else 0
    trie, order = Louds.build(parent, level, np.arange(300))
    trie = Louds.unpack(trie.pack(), 300)
    labels = np.stack([order, order], 1)
    total = trie.rollup(np.r_[0, np.ones(300, np.int64)])
    assert total[0] == 300
    for node, row in enumerate(order, 1):
        assert trie.parent[node - 1] == (0 if parent[row] < 0 else 1 + int(np.flatnonzero(order == parent[row])[0]))
        below = 1 + sum(total[c] for c in trie.children(node))
        assert total[node] == below and {order[c - 1] for c in trie.children(node)} == set(np.flatnonzero(parent == row))
        path, at = [], row
        while at >= 0:
            path, at = [(at, at), *path], parent[at]
        assert trie.find(labels, path) == node
    assert trie.find(labels, [(-5, -5)]) is None
    assert len(trie.pack()) == -(-601 // 8)
    empty, _ = Louds.build(np.array([], np.int64), np.array([], np.int64), np.array([], np.int64))
    assert list(empty.children(0)) == [] and empty.rollup(np.array([7])).tolist() == [7]
