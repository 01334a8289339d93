import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np

from cohortlens.llm import list_rank, ordered, prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, plant=True):
    """Every node from the definition, by recursion over lists of turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c in own:
        h = crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:]) if plant else tuple(own[c])
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = defaultdict(list)
    for node in nodes:
        if node:
            children[node[:-1]].append(node)
    out, totals = {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        leaves = sum(totals[k][0] for k in children[node]) or 1
        bytes_ = len(node[-1][1].encode()) if node else 0
        saved = (len(nodes[node]) - 1) * bytes_ + sum(totals[k][1] for k in children[node])
        totals[node] = leaves, saved
        ends = ",".join(str(c) for c in sorted(nodes[node]) if built[c] == node)
        parent = min(nodes[node[:-1]]) if node else None
        out[min(nodes[node]), len(node)] = (parent, len(nodes[node]), len(children[node]), leaves, saved, sha256(ends.encode()).hexdigest())
    return out


def result(df, plant=True, **sizes):
    rows = prefix_trie.conversation_trie(df, plant, **sizes).collect()
    found = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(found) == len(rows)
    return found


def talk(rng, n, openings=6, longest=9):
    rows = []
    for c in rng.sample(range(3 * n), n):
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), f"t{rng.randrange(openings)} é" if turn < 3 else f"x{rng.randrange(50)}"))
    return rows


def test_equals_brute_force(spark):
    rng = random.Random(6)
    rows = talk(rng, 150) + [(7001, t, "user", f"long {t // 2}") for t in range(400)] + [(7003, t, "user", f"long {t // 2}") for t in range(390)]
    rows += [(c, 0, "user", "hello") for c in range(8000, 8200)]  # a third of all conversations are alike
    df = spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA).repartition(5)
    for plant in (True, False):
        assert result(df, plant) == brute(rows, plant)
    assert result(df, block=16, limit=200) == brute(rows)  # many blocks, some rounds of coin tosses


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, None, "user", ""), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 5, "", "x"), (2, 5, None, "x"), (None, 1, "user", "lost"),
        (3, 0, "ab", "c"), (4, 0, "a", "bc"), (5, 0, "user", "word " * 200_000), (6, 0, "user", "word " * 200_000), (-3, 1, "user", "\U0001f600"),
    ]
    # equal turn numbers go by digest; here only equal rows, or all rows of one conversation, tie
    wide = spark.createDataFrame([(*r, "p", "q") for r in rows], SCHEMA + ", v string, depth string").repartition(3)
    got = result(wide, plant=False)
    want = brute([r for r in rows], plant=False)
    ties = {k for k in want if k[0] == 1}
    assert {k: v for k, v in got.items() if k not in ties and k[1]} == {k: v for k, v in want.items() if k not in ties and k[1]}
    assert got[-3, 0] == want[-3, 0] and {k for k in got} == {k for k in want}
    assert result(wide.limit(0)) == {}
    turnless = spark.createDataFrame([(c, 0, "user", "only") for c in (3, 11, 18)], SCHEMA)
    assert result(turnless) == brute([(c, 0, "user", "only") for c in (3, 11, 18)])


def test_list_rank(spark):
    rng = np.random.default_rng(1)
    for n, block, limit in ((1, 4, 4), (500, 16, 1000), (300, 16, 40), (4000, 4000, 1)):
        ids = rng.permutation(3 * n)[:n] if n > 1 else np.array([5])
        following = np.append(ids[1:], -1)
        df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, following)], "arc bigint, following bigint").repartition(4)
        got = {r["arc"]: r["position"] for r in list_rank.list_rank(df, block, limit).collect()}
        assert got == {int(a): i for i, a in enumerate(ids)}
    assert list_rank.list_rank(df.limit(0)).count() == 0


def test_numbered_over_slices(spark):
    """Places and hashes do not depend on where slices and batches are cut."""
    rng = random.Random(2)
    rows = [(g, i, rng.randrange(1 << 60)) for g, n in ((5, 1), (2, 3000), (9, 40), (-4, 7)) for i in range(n)]
    want, at = {}, 0
    for g, i, v in sorted(rows):
        if i == 0:
            total = 0
        before, total = total, (total + v * pow(ordered.BASES[0], i + 1, 1 << 64)) % (1 << 64)
        want[g, i] = (at, i + 1, total, before)
        at += 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for batch in ("7", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            df = spark.createDataFrame(rng.sample(rows, len(rows)), "g bigint, i bigint, v bigint").repartition(6)
            got = ordered.numbered(df, "g", ["i"], ("v",)).collect()
            assert {(r["g"], r["i"]): (r["at"], r["nth"], r["v_upto"] % (1 << 64), r["v_before"] % (1 << 64)) for r in got} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
