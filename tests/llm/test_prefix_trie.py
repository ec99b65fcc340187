import hashlib
import random
import zlib

import numpy as np
import pytest

from volframe.llm import prefix_trie


def brute(rows):
    """Rows of the trie, from the definition."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    turns = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {}
    for v in members:
        if v:
            kids.setdefault(v[:-1], []).append(v)
    leaves, saved = {}, {}
    for v in sorted(members, key=len, reverse=True):
        leaves[v] = sum(leaves[k] for k in kids.get(v, [])) or 1
        saved[v] = sum(saved[k] for k in kids.get(v, [])) + ((len(members[v]) - 1) * len(v[-1][1].encode()) if v else 0)
    out = []
    for v, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(v))
        out.append((min(m), len(v), min(members[v[:-1]]) if v else None, len(m), len(kids.get(v, [])), leaves[v], saved[v], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, b"x", "y") for r in rows], "conv_id long, turn long, role string, text string, depth int, end binary, path string").repartition(3)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def branching(rng, n, depth, words):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, depth)):
            rows.append((c, t, rng.choice(("user", "assistant")) if t % 3 == 0 else "user", rng.choice(words)))
    return rows


@pytest.mark.parametrize("level_turns, shard_turns", [(512, 400_000), (512, 20), (512, 1), (3, 20), (4, 1), (9, 7)])
def test_levels_and_shards(spark, level_turns, shard_turns):
    """However sequences are cut, the rows are the same; long conversations share long beginnings."""
    rng = random.Random(level_turns * 31 + shard_turns)
    rows = branching(rng, 60, 9, ["a", "b", "ccc"])
    rows += [(c, t, "user", f"long {t if t < 20 else (c, t)}") for c in (100, 105, 110) for t in range(26)]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 230) for t in range(11)]
    assert result(prefix_trie.prefix_trie(frame(spark, rows), level_turns=level_turns, shard_turns=shard_turns)) == brute(rows)


def test_odd_turns(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, None, "user", "n"), (1, 0, "user", "é😀"), (1, 0, "user", "é😀"), (1, 0, "a", "tie"), (2, 5, "", ""), (2, 5, None, None), (3, 0, "a", "b"), (3, 0, "ab", "")]
    rows += [(5, 0, "user", "word " * 5000), (6, 0, "user", "word " * 5000), (-4, 0, "user", "minus"), (-5, 0, "user", "minus")]
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    rows += [(20 + i, t, "user", str(t)) for i in range(10) for t in range(9)]
    assert result(prefix_trie.prefix_trie(frame(spark, rows))) == brute(rows)


def test_nothing(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        df = prefix_trie.prefix_trie(frame(spark, rows))
        assert df.collect() == [] and tuple(df.columns) == prefix_trie.FIELDS
    only = [(7, 0, "user", "x")]  # its own first turns are dropped and its base is absent: a root alone
    assert result(prefix_trie.prefix_trie(frame(spark, only))) == brute(only) and len(brute(only)) == 1


def test_findclose():
    rng = np.random.default_rng(0)
    for n in (1, 2, 70, 3000):
        for bias in (0.2, 0.5, 0.9):
            bits, depth, opened = [1], 0, 0
            while opened < n or depth:
                down = opened < n and (depth == 0 or rng.random() < bias)
                bits.append(int(down))
                depth, opened = depth + (1 if down else -1), opened + down
            bits = np.array([*bits, 0], np.uint8)
            stack, want = [], {}
            for i, b in enumerate(bits.tolist()):
                stack.append(i) if b else want.__setitem__(stack.pop(), i)
            p = np.flatnonzero(bits)
            assert prefix_trie.Parentheses(bits).find_close(p).tolist() == [want[i] for i in p.tolist()]


def test_member_hashes_in_stretches(spark, monkeypatch):
    """A node's ids come in many stretches, which pass one hash."""
    rows = [(bytes([i % 3] * 16), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "end binary, conv_id long").repartition(7)
    got = {bytes(r["end"]): r.ends_sha256 for r in prefix_trie.member_hashes(df).collect()}
    assert got == {e: hashlib.sha256(",".join(str(c) for x, c in rows if x == e).encode()).hexdigest() for e in {e for e, _ in rows}}
