"""The Merkle manifest against brute force."""
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradearea.llm import manifest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root and, for each node, its siblings level by level."""
    siblings, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        for k, p in enumerate(at):
            run = runs[p // 16]
            siblings[k].append((run[:p % 16], run[p % 16 + 1:]))
            at[k] = p // 16
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], siblings


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = []
    for g in order:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made.append((members, *climb([leaf(r) for r in members])))
    root, upper = climb([m[1] for m in made])
    out = []
    for (members, sub, lower), above in zip(made, upper):
        for r, own in zip(members, lower):
            t = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                t = (*r[:4], r[4].translate(LOWER))
            h, said = leaf(t), ""
            for before, after in [*own, *above]:
                h = sha("".join(before) + h + "".join(after))
                said += "".join(before) + "".join(after)
            out.append((r[0], leaf(r), sub, root, sha(said), h, h == root))
    return sorted(out, key=repr)


def found(spark, rows, parts=4):
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g string, pos int").repartition(parts)
    from tradearea.llm.queries import tampered
    made = manifest.verified(manifest.manifest(docs, altered=tampered()))
    return sorted((tuple(r) for r in made.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = [(i * 3, f"src{i % 3}", "en", i, f"Text {i} É") for i in range(300)]
    out += [(1000 + i, None, None, None, None) for i in range(18)] + [(5000, "solo", "fr", 1, "ONE")]
    out += [(7, f"s{i}", "en", 2, "Many Sources") for i in range(20)] + [(-70, "src1", "en", 1, "before zero"), (1 << 62, "src1", "en", 1, "far away")]
    return out


def test_equals_brute_force(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_repeated_and_null_ids(spark, rows):
    more = rows[:70] + [(9, "src0", "en", i % 4, f"again {i % 25}") for i in range(90)] + [(None, "src0", "en", 1, f"N{i % 3}") for i in range(40)] + [(None, None, None, None, None)] * 3
    assert found(spark, more) == brute(more)


def test_one_row_and_none(spark):
    one = [(1, "a", "en", 3, "ABC")]
    assert found(spark, one) == brute(one)
    assert found(spark, [], 1) == []


def test_long_text_and_wrong_key(spark):
    rows = [(1, "a", "en", 3, "Word " * 200000), (2, "a", "en", 0, "")]
    assert found(spark, rows) == brute(rows)
    with pytest.raises(TypeError):
        manifest.manifest(spark.createDataFrame([("x", "a", "b", 1, "t")], "doc_id string, source string, lang string, n_chars long, text string"))


def test_rank_without_sorting_matches_sorting(spark):
    ids = [int(x) for x in np.random.default_rng(4).integers(-5000, 5000, 900)]
    leaves = spark.createDataFrame([("=a", i, f"{k:04x}") for k, i in enumerate(ids)], "g string, id long, leaf string").repartition(5)
    got = sorted((r["pos"], r["id"], r["leaf"]) for r in manifest.ranked(leaves).collect())
    assert got == [(p, i, h) for p, (i, h) in enumerate(sorted((i, f"{k:04x}") for k, i in enumerate(ids)))]
    assert manifest.ranked(leaves).select("n").distinct().collect()[0][0] == 900
    assert F is not None


def test_directory_and_paths_are_not_broadcast(spark):
    """Both compress so well that their files look small; sent to all they would pass through the driver."""
    leaves = spark.range(300).select(F.lit("=a").alias("g"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    ranks = manifest.ranked(leaves)
    assert ranks._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") >= 1
    assert ranks.filter("pos <> id or n <> 300").isEmpty()
    docs = spark.range(300).select(F.col("id").alias("doc_id"), *[F.lit("x").alias(c) for c in ("source", "lang", "n_chars", "text")])
    assert manifest.manifest(docs)._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") >= 1
