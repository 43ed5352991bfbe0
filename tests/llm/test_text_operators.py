"""Word, rule, shingle, token and contamination operators against brute force."""
import hashlib
import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tradearea.llm import decontam, linedup, minhash, mixing, quality, rules, tokens, words
from tradearea.llm.words import Piece

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def base(text):
    text = text or ""
    w = SPACED.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return dict(n_words=len(w), word_chars=sum(map(len, w)), n_symbols=len(re.findall(r"[#*$%&|<>]", text)),
                n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(hit))


def test_pieces_and_lines():
    column = pa.array(["a\n\nb", None, "", "\n", "x" * 5])
    piece = words.Piece(column.slice(0, 4))
    starts, ends, first = piece.lines()
    got = [[piece.text(starts[i], ends[i]) for i in range(first[r], first[r + 1])] for r in range(4)]
    assert got == [["a", "", "b"], [""], [""], ["", ""]]
    batch = pa.RecordBatch.from_arrays([column], names=["t"])
    assert [b.num_rows for b in words.slices(iter([batch]), "t", 5)] == [4, 1]


def test_base_counts(spark, docs):
    got = {(r["doc_id"], r["text"]): r for r in rows_of(rules.measured(docs, ["doc_id", "text"]))}
    assert len(rows_of(rules.measured(docs, ["doc_id"]))) == docs.count()
    for (_, text), r in got.items():
        want = base(text)
        assert {k: r[k] for k in want} == want


def test_binomial_limits():
    for n, share, level in ((100, 0.05, 0.01), (30, 0.01, 0.05), (1000, 0.02, 0.001)):
        k = rules.allowed(n, share, level)
        assert (k < 0 or rules.tail(n, k, share) <= level) and rules.tail(n, k + 1, share) > level
    assert rules.tail(3, 1, 0.5) == pytest.approx(0.5) and rules.allowed(0, 0.1, 0.05) == -1


def test_rules_keep_the_guarantee(spark):
    good = [(i, " ".join(f"w{i}{j}" for j in range(60)), "en") for i in range(1500)]
    bad = [(i, " ".join(f"w{i}{j}##$$" for j in range(60)), "en") for i in range(1500, 1560)]
    few = [(i, " ".join(f"w{i}{j}##$$" for j in range(60)), None) for i in range(1560, 1570)]
    documents = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(0, 1), (None, 1), (1500, 0), (1501, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in rows_of(rules.risk_controlled(documents, labels))}
    assert len(got) == 1570
    assert sum(not got[i]["kept"] for i in range(1500)) <= 75
    assert not any(got[i]["kept"] for i in range(1500, 1560))  # certified in "en"
    assert all(got[i]["kept"] for i in range(1560, 1570))  # no labels, no cutoff
    empty = rules.risk_controlled(documents.limit(0), labels.limit(0))
    assert empty.count() == 0


def shingle_set(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    """Brute force: (key, text) rows to the smallest key reachable."""
    sets, comp = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    old, new = comp[i], comp[j]
                    comp = [new if c == old else c for c in comp]
    low = {}
    for (key, _), c in zip(rows, comp):
        if key is not None:
            low[c] = min(low.get(c, key), key)
    return [(k, len(s), low.get(c) if s else k) for (k, _), s, c in zip(rows, sets, comp)]


def test_near_duplicates(spark, docs):
    got = rows_of(minhash.near_duplicates(docs))
    want = groups([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    # rows without a key go like others: (None, a) is a copy of 1, (None, None) has no words
    assert all(r["kept"] == (r["n_shingles"] == 0 if r["doc_id"] is None else r["doc_id"] == r["component_id"]) for r in got)
    left = minhash.one_per_group(docs)
    assert left.columns == docs.columns
    kept = [r["doc_id"] for r in left.select("doc_id").collect()]
    assert sorted(k for k in kept if k is not None) == sorted({w[2] for w in want if w[2] is not None}) and kept.count(None) == 1
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_groups_that_share_an_id(spark):
    """One id with unrelated texts, wordless ones among them: one row of each group stays, not one of each id."""
    word = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    a, b, c = word("a"), word("b"), word("c")
    rows = [(5, a), (5, b), (12, b), (9, a + " more"), (7, c), (7, None), (7, ""), (7, None), (8, c), (5, b), (6, None), (None, a)]
    rows += [(5, word(f"t{i}x")) for i in range(30)]
    table = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, root long")
    left = minhash.one_per_group(table)
    assert left.columns == table.columns
    want = {(5, a), (5, b), (7, c), (7, None), (7, ""), (6, None)} | {(5, word(f"t{i}x")) for i in range(30)}
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert len(got) == len(want) and set(got) == want


def test_rows_without_key_take_part(spark):
    """A third of the rows has no id: their copies go, and a group of them alone keeps one row."""
    word = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [(i, word(f"k{i}x")) for i in range(6)] + [(None, word("k2x")), (None, word("k2x") + " more")]
    rows += [(None, word("lone")), (None, word("lone")), (None, word("lone") + " more"), (None, word("single")), (None, None), (None, None), (None, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in minhash.one_per_group(table).collect()]
    keyless = [t for k, t in got if k is None]
    assert sorted(k for k, _ in got if k is not None) == list(range(6))
    assert len(keyless) == 5 and word("single") in keyless and keyless.count(None) == 2 and "" in keyless
    assert sum(t is not None and t.startswith("lone0") for t in keyless) == 1
    marked = minhash.near_duplicates(table).filter("doc_id is null and component_id is null and n_shingles > 0").collect()
    assert len(marked) == 4 and {r["kept"] for r in marked} == {True, False}


def test_template_without_links(spark):
    """Many texts that share much, but not enough, and a few links among them: nothing is lost, nothing is linked wrongly."""
    shared = [f"t{i}" for i in range(70)]
    rows = [(k, " ".join(shared + [f"own{k}x{i}" for i in range(26)])) for k in range(60)]
    rows += [(100 + k, rows[k][1] + f" tail{k}") for k in range(0, 60, 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(table).collect()}
    assert got == {(k, c) for k, _, c in groups(rows)}


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_votes(text):
    """Votes of the nine labellers on a text, by plain Python."""
    words, letters = WORDS.findall(text or ""), re.findall("[A-Za-z]", text or "")
    n = max(len(words), 1)
    odd = sum(any(c in "#$%&*+/<=>@[\\]^_`{|}~!" for c in w) for w in words) / n
    shout, symbols = sum("!" in w for w in words) / n, sum(c in "#*$%&|<>" for c in text or "") / n
    raw = (text or "").encode()
    inner = sum(65 <= b <= 90 and (65 <= a <= 90 or 97 <= a <= 122) for a, b in zip(raw, raw[1:]))
    upper = inner / max(len(letters), 1)
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    repeat = len(covered) / n
    distinct = len(set(words)) / n ** 0.5 if n >= 50 else 8
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    copied = (len(lines) - len(set(lines))) / max(len(lines), 1)
    stops = sum(w[-1] in ".!?" for w in words) / n
    bad = [symbols > 0.2, odd > 0.3, upper > 0.4, shout > 0.3, repeat > 0.5, distinct < 1.5, copied > 0.5]
    prose = bool(words) and odd < 0.05 and upper < 0.2 and repeat < (0.7 if len(words) < 50 else 0.2) and copied < 0.4
    sentences = stops > 0.01 and (stops < 0.5 or len(words) < 20) and odd < 0.2
    return tuple([quality.BAD if b else quality.NONE for b in bad] + [quality.GOOD if g else quality.NONE for g in (prose, sentences)])


def brute_estimate(patterns, rounds=100):
    """Expectation-maximisation document by document: P(good) of each document."""
    p = [(v.count(1) + 0.8) / (v.count(1) + 2 * v.count(0) + 1) for v in patterns]
    for _ in range(rounds):
        prior = (sum(p) + 1) / (len(p) + 2)
        chance = {}
        for good in (True, False):
            q = [x if good else 1 - x for x in p]
            for j in range(9):
                seen = [sum(w for w, v in zip(q, patterns) if v[j] == vote) + 0.5 for vote in range(3)]
                for vote in range(3):
                    chance[good, j, vote] = seen[vote] / sum(seen)
        new = []
        for v in patterns:
            a, b = prior, 1 - prior
            for j in range(9):
                a, b = a * chance[True, j, v[j]], b * chance[False, j, v[j]]
            new.append(a / (a + b))
        done, p = max(abs(x - y) for x, y in zip(p, new)) < 1e-9, new
        if done:
            break
    return p


def test_quality_equals_brute_force(spark, docs):
    """Votes and posteriors of every document, and scores from the fitted weights, by plain Python."""
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + [(100 + i, t) for i, t in enumerate(
        ["BUY NOW!! " * 30, "x# y% z$ " * 40, "A fine sentence. " * 3, "one\ntwo\none\ntwo\none\ntwo", "word " * 80, "Plain prose, with a comma. And more of it.", "MiXeD cAsE wOrDs"])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    piece = Piece(pa.array([t for _, t in rows]))
    got = quality.votes(quality.measures(piece)[0])
    want = [brute_votes(t) for _, t in rows]
    assert [tuple(v) for v in got.tolist()] == want
    assert sorted(r["pattern"] for r in quality.voted(table).collect()) == sorted(sum(x * 3 ** j for j, x in enumerate(v)) for v in want)
    numbers, counts = np.unique(quality.pattern(got), return_counts=True)
    p, _ = quality.estimate(numbers, counts)
    posterior = dict(zip(numbers.tolist(), p))
    assert np.allclose([posterior[n] for n in quality.pattern(got).tolist()], brute_estimate(want), atol=1e-6)
    weights = quality.train(table)[0]
    scores = {(r["doc_id"], r["n_words"]): r["score"] for r in quality.classified(table).collect()}
    for i, (key, text) in enumerate(rows):
        one = Piece(pa.array([text]))
        m, words = quality.measures(one)
        by_word, by_shape, bins = quality.buckets_of(m, words, 1)
        total = weights[quality.BUCKETS] + sum(weights[b] for b in bins[0]) + sum(weights[b] for b in [*by_word, *by_shape]) / max(len(WORDS.findall(text or "")), 1)
        assert scores[key, len(WORDS.findall(text or ""))] == pytest.approx(1 / (1 + np.exp(-total)), abs=2e-6), (i, key)


def test_fit_lowers_the_loss_to_that_of_dense_steps():
    rng = np.random.default_rng(3)
    cells = [np.sort(rng.choice(50, 6, replace=False)).astype(np.int32) for _ in range(80)]
    label = np.array([1.0 if (c < 20).sum() > 2 else 0.0 for c in cells])
    w = quality.fit(cells, [np.ones(6, np.float32)] * 80, label)
    x = np.zeros((80, quality.BUCKETS + 1))
    for i, c in enumerate(cells):
        x[i, c] = 1
    x[:, -1] = 1
    v = u = np.zeros(x.shape[1])
    for step in range(150):
        ahead = v + (step / (step + 3)) * (v - u)
        u, v = v, ahead - 0.3 * (x.T @ (1 / (1 + np.exp(-(x @ ahead))) - label) / 80 + 1e-4 * ahead)
    assert np.allclose(w, v, atol=1e-8) and ((x @ w > 0) == (label > 0)).mean() > 0.9


def test_certified_cutoffs_equal_brute_force(spark):
    """Exact binomial tests in the stated order, by plain sums, and documents judged by them; copies are one case."""
    from math import comb
    rng = np.random.default_rng(9)
    rows = []
    for i in range(900):
        words = [f"w{i}x{j}" for j in range(int(rng.integers(55, 70)))]
        for j in rng.integers(0, 50, int(rng.integers(0, 4))):
            words[j] = "##" + words[j]
        rows.append((i, " ".join(words), "en" if i % 9 else None))
    rows += [(1000 + i, "bad ## text " + " ".join(f"q{j}" for j in range(60)), "en") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    counted = {r["doc_id"]: r.asDict() for r in rules.measured(table, ["doc_id", "lang"]).collect()}
    cases = {}
    for key, text, lang in rows:
        cases.setdefault(lang, {})[text] = counted[key]
    level = 0.05 / (len(cases) * len(rules.RULES))
    share = 0.05 / len(rules.RULES)
    cut = {}
    for lang, own in cases.items():
        for name, (expr, cutoffs) in rules.RULES.items():
            values = []
            for c in own.values():
                env = {k: (v or 0) for k, v in c.items() if k != "lang"}
                values.append(eval(expr, {"greatest": max}, env))  # the rules are arithmetic over the counts
            for c in cutoffs:
                k, n = sum(v > c for v in values), len(values)
                if sum(comb(n, i) * share ** i * (1 - share) ** (n - i) for i in range(k + 1)) > level:
                    break
                cut[lang, name] = c
    got = {r["doc_id"]: r for r in rules.risk_controlled(table, labels).collect()}
    assert cut and len(got) == len(rows)
    for key, _, lang in rows:
        env = {k: (v or 0) for k, v in counted[key].items() if k != "lang"}
        broken = [name for name, (expr, _) in rules.RULES.items() if (lang, name) in cut and eval(expr, {"greatest": max}, env) > cut[lang, name]]
        assert got[key]["broken_rules"] == broken and got[key]["kept"] == (not got[key]["base_failed"] and not broken), key


def parity(n, flip=0):
    """The parity sequence: two of them agree in every polynomial modulo a power of two, from some length on."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_parity_sequences_are_told_apart(spark, n):
    from tradearea.llm import decontam, rules, tokens, words
    one, two = parity(n), parity(n, 1)
    piece = words.Piece(pa.array([one, two]))
    h = piece.hashes(np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]
    texts = [" ".join(f"{p}{k}" for k in range(12)) for p in (one, two)]
    table = spark.createDataFrame([(1, texts[0], "en"), (2, texts[1], "en"), (3, f"{one}\n{two}", "en")], "doc_id long, text string, lang string")
    assert {r["component_id"] for r in minhash.near_duplicates(table).collect()} == {1, 2, 3}
    assert [r["n_dup_lines"] for r in rules.measured(table, ["doc_id"]).orderBy("doc_id").collect()] == [0, 0, 0]
    tests = spark.createDataFrame([("x", " ".join(f"{two}{k}" for k in range(10)))], "item_id string, text string")
    assert sorted((r["doc_id"], r["n_hit"]) for r in decontam.contamination(table, tests).collect()) == [(1, 0), (2, 10), (3, 0)]
    assert tokens is not None


def test_families_of_near_copies(spark):
    """Copies with few and with many edits, chains, and unrelated texts that share a passage."""
    rng = np.random.default_rng(5)
    rows = []
    for family in range(3):
        root = [f"f{family}w{i}" for i in range(90)]
        for copy in range(40):
            own = list(root)
            for at in rng.choice(90, int(rng.integers(0, 7)), replace=False):
                own[at] = f"e{rng.integers(0, 50)}"
            rows.append((len(rows), " ".join(own)))
    chain = [f"c{i}" for i in range(100)]
    for step in range(12):
        rows.append((len(rows), " ".join([f"d{i}" for i in range(4 * step)] + chain[4 * step:])))
    got = {r["doc_id"]: r["component_id"] for r in rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {k: c for k, _, c in groups(rows)}


def contaminated(text, items, size=10):
    w = PLAIN.findall((text or "").translate(LOWER))
    hit, names = set(), set()
    for name, item in items:
        x = PLAIN.findall((item or "").translate(LOWER))
        for at in range(max(1, len(x) - size + 1)) if x else ():
            win = x[at:at + size]
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    names.add(str(name))
    return len(w), sorted(hit), sorted(names)


def test_contamination(spark, docs):
    items = [(1, "one two three FOUR five six seven eight nine ten eleven"), (10, "six seven, eight nine"), (2, "not there at all"), (3, None), (4, "..."),
             (5, " ".join(f"v{i % 11}y{i}" for i in range(20, 45)))]
    tests = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontam.LIMIT, 60):  # one pass, and several
        for r in rows_of(decontam.contamination(docs.withColumn("body", docs.text), tests, text="body", limit=limit).join(
                docs.select("doc_id", "text").distinct(), "doc_id")):
            n, hit, names = contaminated(r["text"], items)
            assert (r["n_words"], r["n_hit"], r["items"]) == (n, len(hit), names)
    clean = decontam.without_hits(docs, tests)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert text[18] == " twelve" and text[9] == "three small words" and text[6] is None
    assert decontam.contamination(docs, tests.limit(0)).filter("n_hit > 0").count() == 0


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(3)
    for _ in range(20):
        runs = [rng.integers(1, 4, int(rng.integers(1, 60))) for _ in range(int(rng.integers(1, 6)))]
        borders = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
        index = decontam.Index(np.concatenate(runs), borders, 3)
        patterns = rng.integers(1, 4, (30, 4))
        lengths = rng.integers(1, 5, 30)
        low, high = index.search(patterns, lengths)
        for p, n, a, b in zip(patterns, lengths, low, high):
            want = {int(borders[j]) + j + 1 + i for j, r in enumerate(runs) for i in range(len(r) - n + 1) if (r[i:i + n] == p[:n]).all()}
            assert set(index.locate(np.arange(a, b)).tolist()) == want


def greedy(word, vocabulary):
    symbols, n = [*word.encode(), tokens.END], 0
    while symbols:
        for size in range(len(symbols), 0, -1):
            if tuple(symbols[:size]) in vocabulary:
                symbols, n = symbols[size:], n + 1
                break
        else:
            return 0
    return n


def test_token_counts(spark, docs, tmp_path):
    pieces = ["a", "b", "ab", "abc</w>", "bc</w>", "c</w>", "abab", "ba", "c", "cab</w>", "b</w>", "aaa"]
    vocabulary = {(*t.removesuffix("</w>").encode(), *((tokens.END,) if t.endswith("</w>") else ())) for t in pieces}
    automaton = tokens.Automaton(sorted(vocabulary))
    rng = np.random.default_rng(1)
    many = ["".join(rng.choice(list("abc"), int(rng.integers(1, 12)))) for _ in range(400)]
    data = np.frombuffer("".join(many).encode(), np.uint8)
    ends = np.cumsum([len(m) for m in many])
    got = automaton.counts(data, ends - [len(m) for m in many], ends)
    assert got.tolist() == [greedy(m, vocabulary) for m in many] and 0 in got
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"model": {"vocab": {t: i for i, t in enumerate(pieces)}}, "added_tokens": []}))
    table = spark.createDataFrame([(1, "abc ABAB xyz"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"], r["n_unknown"]) for r in tokens.token_counts(table, str(path)).collect()}
    each = [greedy(w, vocabulary) for w in ("abc", "abab", "xyz")]
    assert got == {1: (3, sum(max(1, e) for e in each), each.count(0)), 2: (0, 0, 0), 3: (0, 0, 0)}
    whole = set(tokens.read_vocabulary())
    for r in tokens.token_counts(docs.filter("doc_id < 15"), ).join(docs, "doc_id").select("n_tokens", "text").distinct().collect():
        assert r["n_tokens"] == sum(max(1, greedy(w, whole)) for w in SPACED.findall((r["text"] or "").translate(LOWER)))


def removed(rows, least):
    """Brute force: lines of later copies of repeated runs of at least `least` words."""
    texts = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    lines = {r: r[1].split("\n") for r in texts}
    places, out = [], {r: set() for r in texts}
    for r in texts:
        for s in range(len(lines[r])):
            for j, q in places:
                n = 0
                while s + n < len(lines[r]) and q + n < len(lines[j]) and lines[r][s + n] == lines[j][q + n]:
                    n += 1
                if n and sum(len(SPACED.findall(x)) for x in lines[r][s:s + n]) >= least:
                    out[r] |= set(range(s, s + n))
            places.append((r, s))
    return {r: "\n".join(x for i, x in enumerate(lines[r]) if i not in out[r]) for r in texts}


def test_line_dedup(spark, docs):
    rng = np.random.default_rng(2)
    pool = [" ".join(f"p{i}q{j}" for j in range(int(rng.integers(0, 9)))) for i in range(6)]
    rows = [(i, "\n".join(pool[int(k)] for k in rng.integers(0, 6, int(rng.integers(1, 14))))) for i in range(30)]
    rows += [(30, rows[3][1]), (31, None), (32, ""), (None, rows[4][1]), (3, rows[3][1])]
    table = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, _lines int")
    for least in (8, 20):
        want = removed(rows, least)
        got = linedup.without_repeats(table, min_words=least)
        assert got.columns == table.columns
        back = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "") for r in got.collect())
        assert back == sorted((k is None, k or 0, t is None, want.get((k, t), "") or "") for k, t in rows)
    report = {r["doc_id"]: r for r in linedup.line_report(docs).filter("doc_id is not null").collect()}
    assert report[4]["n_removed"] == 1 and report[5]["n_removed"] == 1 and report[1]["n_removed"] == 1  # the row without key comes first
    assert report[16]["n_removed"] > 0 and report[6]["n_lines"] == 0
    assert linedup.without_repeats(docs.limit(0)).count() == 0


def test_mixing_samples_rows_that_share_an_id(spark):
    """A third of the rows has no id and many are equal: taken and left rows are of all sizes, and equal rows are drawn one by one."""
    rng = np.random.default_rng(6)
    rows = [(None, " ".join(f"w{rng.integers(0, 9)}" for _ in range(int(rng.integers(1, 60)))), "a") for _ in range(400)]
    rows += [(7, "all the same words", "a")] * 200 + [(k, f"big source {k} " * 30, "b") for k in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = [r for r in mixing.mix(table, weights=(1, 9), carry=["text", "taken"]).collect() if r["source"] == "a"]
    assert got[0]["text"] is not None and len(got) == 600
    keyless = [r for r in got if r["doc_id"] is None]
    taken, left = ([r["size"] for r in keyless if (r["taken"] > 0) == t] for t in (True, False))
    assert min(taken) < 20 < 40 < max(taken) and min(left) < 20 < 40 < max(left)
    assert 0 < sum(r["taken"] > 0 for r in got if r["doc_id"] == 7) < 200
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 60
    again = [r for r in mixing.mix(table.repartition(3), weights=(1, 9), carry=["text"]).collect() if r["source"] == "a"]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixing(spark, docs):
    got = rows_of(mixing.mix(docs))
    assert len(got) == docs.count() and got and sorted(map(str, got)) == sorted(map(str, rows_of(mixing.mix(docs))))
    size, goal, taken = Counter(), {}, Counter()
    for r in got:
        size[r["source"]] += r["size"]
        goal[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(size.values())
    while True:  # shares, excess reshared
        left = total - sum(3 * size[s] for s in full)
        share = {s: 3 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        above = {s for s in order if s not in full and share[s] > 3 * size[s] + 1e-9}
        if not above:
            break
        full |= above
    for s in order:
        assert goal[s] == pytest.approx(share[s])
        most = max(r["size"] for r in got if r["source"] == s)
        assert abs(taken[s] - goal[s]) <= most / 2 + 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_weights_steer_the_sample(spark):
    rows = [(i, "w " * 20 if i % 2 else "w# " * 20, s) for s in ("a", "b") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 3)).filter("source = 'a'").collect()
    clean, marked = (sum(r["taken"] for r in got if r["doc_id"] % 2 == k) for k in (1, 0))
    assert clean > 1.1 * marked > 0


def test_quality(spark, docs):
    rng = np.random.default_rng(4)
    plain = [(i, " ".join(f"{rng.choice(['alpha', 'beta', 'gamma', 'delta'])}{rng.integers(0, 400)}" + ("." if j % 9 == 8 else "") for j in range(60))) for i in range(300)]
    junk = [(i, ("GO!! NOW!! " * 40, "x## y%% z$$ " * 30, "same words here " * 40)[i % 3] + str(i)) for i in range(300, 360)]
    table = spark.createDataFrame(plain + junk, "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in quality.classified(table).collect()}
    assert sum(got[i] for i in range(300)) >= 297 and sum(got[i] for i in range(300, 360)) <= 3
    again = {r["doc_id"]: r["kept"] for r in quality.classified(table.repartition(7)).collect()}
    assert got == again
    assert quality.accepted(docs).columns == docs.columns and quality.classified(docs).count() == docs.count()
    assert quality.classified(docs.limit(0)).count() == 0


def test_labeller_accuracies_are_recovered():
    rng = np.random.default_rng(6)
    truth = rng.random(20000) < 0.8
    right = np.array([0.95, 0.9, 0.7])
    v = np.where(rng.random((20000, 3)) < right, truth[:, None], ~truth[:, None]).astype(np.int64)
    patterns, counts = np.unique(quality.pattern(v), return_counts=True)
    p, model = quality.estimate(patterns, counts, labellers=3)
    assert model["prior"] == pytest.approx(0.8, abs=0.03)
    assert model["chances"][1, :, 1] == pytest.approx(right, abs=0.04)


def test_hashes_depend_on_content_only():
    piece = words.Piece(pa.array(["x abc", "abc y abd"]))
    starts, ends, _ = piece.spans(words.SPACED)
    h = piece.hashes(starts, ends)
    assert h[1] == h[2] and len(set(h.tolist())) == 4 and hashlib.md5(h.tobytes())
