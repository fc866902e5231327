"""The prefix trie against a plain dictionary of prefixes, its SQL, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from suite.check import connect, difference
from tablewright.llm import prefix_trie
from tablewright.llm.queries import ORACLE_SQL, op12_prefixes


def rebuilt(rows):
    """Conversations as the query rebuilds them: conv_id -> [(role, text)]."""
    held = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            held.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in held.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def plain_nodes(conversations):
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        ends = ",".join(str(c) for c in sorted(who) if len(conversations[c]) == len(node))
        above = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(who), len(node), above, len(who), len(children), len(leaves), saved, sha))
    return sorted(out, key=str)


def nodes_of(frame):
    return sorted((tuple(r) for r in prefix_trie.prefix_nodes(*prefix_trie.spliced(prefix_trie.numbered_turns(frame))).collect()), key=str)


def talks(n, draw):
    """Conversations of few distinct turns, so that many share long prefixes; some are copies."""
    rows = []
    for c in range(n):
        if rows and draw.random() < 0.2:
            source = draw.randrange(c)
            rows += [(c, *r[1:]) for r in rows if r[0] == source]
            continue
        for turn in range(draw.choice([1, 2, 5, 9, 20])):
            rows.append((c, turn, draw.choice(["user", "assistant"]), draw.choice(["a", "bé", "a"]) if turn < 6 else "x" * draw.randint(0, 2)))
    return rows


def test_nodes_equal_those_of_a_plain_dictionary(spark):
    rows = talks(70, random.Random(4))
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(6)
    assert nodes_of(frame) == plain_nodes(rebuilt(rows))


def test_odd_rows(spark):
    long = [(40, i, "user", f"t{i % 3}") for i in range(300)]
    rows = [
        (1, None, None, None), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 3, None, "é\U0001f600"), (None, 1, "user", "x"),
        (-3, 1, "user", "q"), (-5, 2, "", "r"), (-7, 5, "a", "r"), (0, 1, "user", "q"), (0, 0, "user", "x" * 100_000), (9_000_000_000_000_000_004, 1, "u", "v"),
        (12, 5, "a", "b"), (12, 5, "a", "b"), (12, 5, "b", "a"), *long, *((44, *r[1:]) for r in long), *((45, *r[1:]) for r in long[:299]),
    ]
    frame = spark.createDataFrame([(*r, "s", 1) for r in rows], "conv_id long, turn long, role string, text string, place string, part int")
    assert nodes_of(frame.repartition(4)) == plain_nodes(rebuilt(rows))
    assert nodes_of(frame.where("conv_id = -99")) == []


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    rows = [(0, 1, "u", "a")]
    for c in range(1, 200):
        rows.append((c, 1, "u", "a"))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = plain_nodes(rebuilt(rows))
    assert nodes_of(frame) == want and any(x[1] == 0 and x[3] == 200 for x in want)


def test_one_conversation_in_many_tasks(spark):
    """Counts and sums go on where a key fills several ranges."""
    rows = [(7, i, i % 3 * 2**61) for i in range(2000)] + [(8, i, 1) for i in range(5)] + [(3, 0, 1)]
    frame = spark.createDataFrame(rows, "k long, i long, x long").repartition(5)
    got = prefix_trie.running(frame, "k", [F.col("i")], [F.col("i")], [F.col("k"), F.col("i"), F.col("x")], ["x"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.place == r.i + 1
        want = sum(i % 3 * 2**61 for i in range(r.i + 1)) if r.k == 7 else r.i + 1
        assert (r.sum_x - want) % 2**64 == 0


def test_exit_nodes_are_those_of_the_longest_common_prefix():
    draw = random.Random(11)
    for _ in range(30):
        trie, held = prefix_trie.ZFastTrie(), []
        for conv in range(40):
            names, state = [], 0
            for _ in range(draw.randint(1, 40)):
                state = hash((state, draw.choice([0, 0, 0, 1])))
                names.append((state, 1))
            _, depth = trie.locate(5, names)
            common = max((next((i for i, (a, b) in enumerate(zip(names, h, strict=False)) if a != b), min(len(h), len(names))) for h in held), default=0)
            assert depth == 4 + common
            columns = {c: np.array([x[0] for x in names]) for c in prefix_trie._EDGE}
            trie.insert(conv, 5, names, columns, True)
            held.append(names)
        made = trie.expanded()
        prefixes = {n[i] for n in held for i in range(len(n))}
        assert sorted(made["s1"].tolist()) == sorted(p[0] for p in prefixes)
        for name, members, least in zip(made["s1"].tolist(), made["members"].tolist(), made["least"].tolist(), strict=True):
            who = [c for c, n in enumerate(held) if (name, 1) in n]
            assert members == len(who) and least == who[0]


def test_long_conversations_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_SEGMENT", 7)
    monkeypatch.setattr(prefix_trie, "_HELD", 50)
    monkeypatch.setattr(prefix_trie, "_BLOB", 4)
    rows = talks(60, random.Random(8))
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    assert nodes_of(frame) == plain_nodes(rebuilt(rows))


def test_query_agrees_with_its_sql(spark, sf):
    assert difference(op12_prefixes(spark, sf), connect(sf), ORACLE_SQL["op12_prefixes"]) is None
