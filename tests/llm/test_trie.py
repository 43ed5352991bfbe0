"""The prefix trie against brute force."""
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradearea.llm import trie


def rebuild(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(turns)] for c, turns in convs.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def brute(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {p: [] for p in members}
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        n, saved = (0 if children[p] else 1), ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        for q in children[p]:
            m, s = below(q)
            n, saved = n + m, saved + s
        return n, saved

    out = []
    for p, ms in members.items():
        n, saved = below(p)
        said = ",".join(str(c) for c in sorted(ends.get(p, [])))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(children[p]), n, saved, hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, parts=4):
    from tradearea.llm.queries import op12_rows
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, name string, n long").repartition(parts)
    return sorted((tuple(r) for r in op12_rows(turns).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = []
    for c in range(300):
        same = rng.random() < 0.4
        for t in range(int(rng.integers(1, 9))):
            who = ("user", "assistant")[t % 2]
            out.append((c, t, who, f"é common {t}" if same and rng.random() < 0.9 else f"words {rng.integers(0, 3)}"))
    out += [(1000 + i, 0, "user", "all the same") for i in range(60)]
    out += [(2003, 1, None, None), (2003, None, "user", "first"), (2003, 1, "user", "tie"), (2003, 1, "user", "tie"), (2004, 0, "", "")]
    out += [(3000, t, "user", f"long {t % 7}") for t in range(900)] + [(3001, t, "user", f"long {t % 7}") for t in range(899)]
    return out + [(None, 1, "user", "nobody's")]


def test_equals_brute_force(spark, rows, monkeypatch):
    expected = brute(rebuild(rows))
    assert found(spark, rows) == expected
    # many small partitions, several rounds of merging, classes in several pieces
    monkeypatch.setattr(trie, "TURNS", 40)
    monkeypatch.setattr(trie, "MERGED", 3)
    monkeypatch.setattr(trie, "IDS", 8)
    assert found(spark, rows) == expected


def test_one_conversation_and_none(spark):
    one = [(5, 0, "user", "a"), (5, 1, "assistant", "b")]
    assert found(spark, one) == brute(rebuild(one))
    assert found(spark, [], 1) == []
    # base absent and own turns within the head: no turns are left
    short = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 6, 7)]
    assert found(spark, short) == brute(rebuild(short))


def test_forest_in_one_piece_equals_contracted_pieces():
    rng = np.random.default_rng(0)
    seqs = sorted({bytes(rng.integers(0, 2, int(rng.integers(0, 9))).astype(np.uint8).repeat(trie.NAME)) for _ in range(80)})
    items = lambda part: [(s, [3] * (len(s) // trie.NAME), {len(s) // trie.NAME: (2, seqs.index(s), 0, 0, 0, f"e{seqs.index(s)}")}) for s in part]
    whole = trie.Forest(items(seqs), True, False)
    rows, open_paths = [], []
    for a in range(0, len(seqs), 9):
        piece = trie.Forest(items(seqs[a:a + 9]), False, False)
        rows += piece.rows
        open_paths += piece.paths()
    rows += trie.Forest(open_paths, True, True).rows
    strip = lambda rs: sorted(tuple(r[i] for i in (0, 1, 3, 4, 5, 6, 7)) for r in rs)
    assert strip(whole.rows) == strip(rows)
    assert F is not None
