"""The whole pipeline on a small corpus, each stage held against brute force on what its predecessor kept."""
import numpy as np
import pytest

import corpus_pipeline
from test_text_operators import LOWER, PLAIN, SPACED, groups, removed
from tradearea.llm import quality

ORDER = "doc_id long, text string, lang string, source string, n_chars long, note string"


def prose(rng, n):
    return " ".join(f"{rng.choice(['alpha', 'beta', 'gamma', 'delta'])}{rng.integers(0, 4000)}" + ("." if j % 9 == 8 else "") for j in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(11)
    texts = [prose(rng, int(rng.integers(60, 140))) for _ in range(60)]
    passage = "\n".join(prose(rng, 20) for _ in range(3))
    item = prose(rng, 25)
    near = texts[3].split(" ")
    near[5] = "changed"
    texts += [texts[0], texts[0], " ".join(near), passage + "\n" + prose(rng, 70), prose(rng, 80) + "\n" + passage, passage,
              prose(rng, 60) + " " + item + " " + prose(rng, 60), item, prose(rng, 12000), None, "", " \n "]
    texts += [("GO!! NOW!! " * 40, "x## y%% z$$ " * 30, "same words here " * 40)[i % 3] + str(i) for i in range(12)]
    sources = ["web", "web", "books", None, "code"]
    rows = [(i, t, "en", sources[i % 5], None if t is None else len(t), "extra") for i, t in enumerate(texts)]
    rows += [(2, texts[2], "en", "books", len(texts[2]), "extra"), (None, texts[9], "en", "web", len(texts[9]), "extra")]
    return rows, [(1, item), (2, prose(rng, 30)), (3, None), (4, "...")]


def folder_of(spark, place, rows, items):
    spark.createDataFrame(rows, ORDER).repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place)


def without(text, items, size=10):
    """Brute force: the text without the words inside occurrences of item windows, merged spans cut from first to last word."""
    places = [m.span() for m in PLAIN.finditer((text or "").translate(LOWER))]
    w = [text.translate(LOWER)[a:b] for a, b in places]
    spans = []
    for _, item in items:
        x = PLAIN.findall((item or "").translate(LOWER))
        wins = {tuple(x[i:i + size]) for i in range(max(1, len(x) - size + 1))} if x else set()
        spans += [(i, i + len(v)) for v in wins for i in range(len(w) - len(v) + 1) if tuple(w[i:i + len(v)]) == v]
    merged = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in reversed(merged):
        text = text[:places[a][0]] + text[places[b - 1][1]:]
    return text


def plain(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))


def test_pipeline_stage_by_stage(spark, corpus, tmp_path):
    rows, items = corpus
    folder = folder_of(spark, tmp_path / "in", rows, items)
    docs, before = spark.read.parquet(f"{folder}/documents.parquet"), None
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        last = number == len(corpus_pipeline.STAGES) - 1
        if not last:
            assert out.schema.names == docs.schema.names, name
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = plain(docs), spark.read.parquet(f"{tmp_path}/{name}")
        if last:
            sizes = {}
            for r in docs.collect():
                sizes.setdefault(r["doc_id"], []).append((r["size"], r["taken"]))
            assert sorted((k is None, k or 0, s) for k, v in sizes.items() for s, _ in v) == sorted(
                (k is None, k or 0, len(SPACED.findall(t or ""))) for k, t in before)
            assert all(t <= 3 * s for v in sizes.values() for s, t in v)
            continue
        after = plain(docs)
        if name == "quality":
            # of the many good texts all stay, the junk goes; the verdict is the operator's own, on the whole table
            verdict = {(r["doc_id"], r["kept"]) for r in quality.classified(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
            assert {k for k, _ in after} == {k for k, kept in verdict if kept}
            assert set(range(60)) <= {k for k, _ in after} and not {k for k, _ in after if k is not None} & set(range(72, 84))
        elif name == "lines":
            want = removed(before, 50)
            assert after == in_order((k, want.get((k, t), t)) for k, t in before)
            assert sum(t != u for (_, t), (_, u) in zip(before, after)) >= 2
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in docs.collect())
        elif name == "near_duplicates":
            lead = {k for k, _, c in groups(before) if k is not None and k == c}
            assert sorted(k for k, _ in after if k is not None) == sorted(lead) and 62 not in {k for k, _ in after}
            assert set(after) <= set(before)
        elif name == "decontamination":
            assert after == in_order((k, without(t, items)) for k, t in before)
            assert sum(t != u for (_, t), (_, u) in zip(before, after)) >= 2
