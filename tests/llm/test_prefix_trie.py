"""The trie of conversations against dictionaries of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import prefix_trie
from plumbline.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, path string, unit string, key string, end string, base string, part string"


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            code = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, code, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: tuple(own.get(c - int(np.fmod(c, 5)), [])[: heads[c]] + v[heads[c] :]) for c, v in own.items()}


def brute(rows):
    paths = rebuilt(rows)
    members, kids = defaultdict(list), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                kids[p[: d - 1]].add(p[:d])
    below = {}
    for p in sorted(members, key=len, reverse=True):
        gain = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(below[k][0] for k in kids[p]) or 1, gain + sum(below[k][1] for k in kids[p]))
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if paths[c] == p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(kids[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == columns
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op12_prefix_trie"](spark, sf)) == brute(rows)


@pytest.mark.parametrize("nodes, fan_in", [(200_000, 64), (30, 2)])
def test_odd_rows_copies_and_rounds(spark, monkeypatch, nodes, fan_in):
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", nodes)
    monkeypatch.setattr(prefix_trie, "FAN_IN", fan_in)
    monkeypatch.setattr(prefix_trie, "PART_CHARS", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(nodes)
    pick = rng.choice
    rows = [(pick([None, *range(-12, 60)]), pick([None, *range(8)]), pick([None, "u", "a"]), pick([None, "", "x", "é" * 3])) for _ in range(700)]
    rows += [(1000 + 5 * k, t, "u", "hot") for k in range(200) for t in range(3)]  # one conversation with a third of all rows
    rows += [(2001, t, "u", f"long {t}") for t in range(500)] + [(2002, t, "u", f"long {t}") for t in range(499)]
    rows += [(3000, 1, "user", "very long " * 50_000), (3000, 2, None, None), (3000, 2, None, None), (3001, 9, "u", "no base")]
    try:
        df = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA).repartition(5)
        assert rows_of(prefix_trie.conversation_trie(df)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.conversation_trie(empty).count() == 0
    # with h = 1 or more and no base, one own turn is lost: a conversation without turns is a member of the root alone
    ids = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9]
    rows = [(ids[0], 0, "u", "t"), (ids[7], 0, "u", "t")]
    got = rows_of(prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert got == brute(rows) and len(got) == 1 and got[0][3] == 2


@pytest.mark.parametrize("seed", range(20))
def test_closing_parentheses(seed):
    rng = random.Random(seed)
    depths = [0]
    for _ in range(rng.choice([0, 1, 70, 900])):
        depths.append(depths[-1] + 1 if rng.random() < 0.5 else rng.randrange(max(1, depths[-1] - rng.choice([0, 1, 50])), depths[-1] + 2))
    tree = prefix_trie.Parentheses(np.array(depths))
    stack, want = [], {}
    for i, b in enumerate(tree.bits):
        if b > 0:
            stack.append(i)
        else:
            want[stack.pop()] = i
    assert not stack and [want[int(o)] for o in tree.open] == tree.close().tolist()


def test_a_deep_chain():
    tree = prefix_trie.Parentheses(np.arange(100_000))
    assert tree.close().tolist() == list(range(199_999, 99_999, -1))
