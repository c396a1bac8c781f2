import hashlib
import random
import zlib

import duckdb
import pytest

from offerlake.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth long, parent string, own long, id string"


def conversations(seed=1, n=230):
    rng = random.Random(seed)
    texts = ["salut", "ça va ?", "", "ok 😀", "x" * 50_000, None]
    rows = []
    for c in range(n):
        if c in (100, 57):
            continue  # the first of a family is absent
        for t in range(rng.randint(1, 8)):
            rows.append((c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(texts[:3] if t < 2 else texts)))
    rows += [(7, 2, "user", "b"), (7, 2, "user", "a"), (7, 2, "user", "a"), (8, None, "user", "first"), (8, None, None, None), (None, 1, "user", "x"),
             (200, 0, "user", "salut"), (-5, 0, "user", "salut"), (-5, 1, "user", "bye"), (10_000, 0, "user", "same"), (12_345_678_901, 5, "a", "b")]
    rows += [(c, t, "user", f"copy {t}") for c in range(20_000, 20_060) for t in range(3)]
    rows += [(30_001, t, "user", str(t % 3)) for t in range(400)]
    return rows


def rebuilt(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - (c % 100 if c >= 0 else -(-c % 100))  # the remainder has the sign of the id
        out[c] = tuple(own.get(family, [])[:h] + turns[h:])
    return out


def brute(rows):
    convs = rebuilt(rows)
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    sums = {p: [0, 0, 0] for p in nodes}
    parents = {p[:-1] for p in nodes if p}
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            s = sums[p[:d]]
            s[0] += d == len(p) - 1
            s[1] += p not in parents
            s[2] += (len(members) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: ",".join(map(str, sorted(c for c in nodes[p] if len(convs[c]) == len(p))))
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), *sums[p], hashlib.sha256(ends(p).encode()).hexdigest())
                   for p, m in nodes.items()), key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "n", 1, "p", 1, "i") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in trie.prefix_trie(trie.rebuilt(df)).collect()), key=str)


def test_equal_to_brute_force(spark):
    rows = conversations()
    assert found(spark, rows) == brute(rows)


def test_small_trees_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(trie, "TREE_TURNS", 5)
    monkeypatch.setattr(trie, "END_ROWS", 4)
    rows = conversations(seed=5, n=60)
    assert found(spark, rows) == brute(rows)


def test_oracle_sql_on_odd_rows(spark):
    rows = [r for r in conversations(seed=3, n=80) if r[0] != 30_001]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(r) for r in rows])
    assert sorted(con.execute(trie.oracle()).fetchall(), key=str) == found(spark, rows)


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("spread", [2, 5, 20, 60, 256])
def test_node_layouts(spread):
    """Byte strings of every fan-out, prefixes of each other among them, come back in order."""
    rng = random.Random(spread)
    keys = [bytes(rng.randrange(spread) for _ in range(rng.randint(0, 6))) for _ in range(1500)]
    tree = trie.RadixTree()
    for i, k in enumerate(keys):
        tree.insert(k, i)
    order, spans = tree.walk()
    assert [keys[i] for i in order] == sorted(keys)
    kinds = set()
    stack = [tree.root]
    while stack:
        node = stack.pop()
        kinds.add(type(node).__name__ + str(getattr(node, "room", "")))
        stack += node.children()
    assert {2: "Small4", 5: "Small16", 20: "Indexed", 60: "Full", 256: "Full"}[spread] in kinds
    assert all(above <= below and low <= high for above, below, low, high in spans)


def test_only_whole_turns_emit_nodes():
    one, two, other = b"a" * 16, b"a" * 15 + b"b", b"a" * 3 + b"z" * 13
    order, nodes = trie.turn_nodes([one + two, one, other, b"", one + two])
    assert [(d, high - low) for d, low, high in nodes] == [(0, 5), (1, 3), (2, 2), (1, 1)]
    assert order == [3, 1, 0, 4, 2]
