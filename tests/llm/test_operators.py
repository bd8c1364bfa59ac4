"""Each corpus operator against brute force on small tables, and on tables with every awkward row."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.llm import common, decontaminate, embeddings, interpolation, jaccard, language, licenses, lines, mixing, spans, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def prose(rng: random.Random, words: list[str], n: int) -> str:
    out = []
    while len(out) < n:
        k = rng.randint(4, 12)
        out += [*rng.choices(words, k=k - 1), rng.choice(words) + rng.choice([".", ".", ".\n"])]
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = vocabulary(rng, 400)
    docs = [prose(rng, words, rng.randint(20, 200)) for _ in range(60)]
    for i in range(10):
        w = docs[i].split(" ")
        w[len(w) // 2] = "changed"
        docs.append(" ".join(w))
        docs.append(docs[i + 20])
    return docs


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], DOC)


def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and clashing extra columns."""
    long = " ".join(f"w{i % 977} x{i}." for i in range(60_000))
    rows = [(1, None, None, None, None), (None, "some words without an id here.", "en", "a", 3), (2, "", "en", "a", 0), (3, long, "en", "a", len(long)), (4, "one two three four five six. seven eight nine ten eleven.\nand more.", "en", "b", 1), (4, "one two three four five six. seven eight nine ten eleven.\nand more.", "en", "b", 1), (5, "  \n\t !!! ", None, "b", 2), (6, "Licensed under CC BY-NC 4.0.", "de", "", 5)]
    df = spark.createDataFrame(rows, DOC)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["id", "tk", "h", "rep", "component", "n_lines", "size", "target"])])


BENCH = "item_id long, text string"


def windows(words: list[str]) -> list[list[str]]:
    n = min(10, len(words))
    return [words[i : i + n] for i in range(len(words) - n + 1)] if words else []


def hits(words: list[str], item: list[str]) -> set[int]:
    out = set()
    for w in windows(item):
        for i in range(len(words) - len(w) + 1):
            if words[i : i + len(w)] == w:
                out |= set(range(i, i + len(w)))
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontaminate(spark, texts, docs, most):
    rng = random.Random(1)
    items = [" ".join(texts[i].split()[5 : 5 + n]) for i, n in ((3, 25), (4, 10), (7, 9), (9, 3), (11, 1), (30, 40))] + ["", None, "never in any text at all"]
    items.append(items[0])
    bench = spark.createDataFrame([(rng.randint(0, 4) if i == 2 else i, t) for i, t in enumerate(items)], BENCH)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    named = [(r["item_id"], split(r["text"])) for r in bench.collect()]
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench, max_broadcast_words=most).collect()}
    for i, t in enumerate(texts):
        w = split(t)
        found = collections.defaultdict(set)
        for k, x in named:
            found[str(k)] |= hits(w, x)
        assert got[i]["n_words"] == len(w)
        assert got[i]["n_hit"] == len(set().union(*found.values()))
        assert got[i]["items"] == sorted(k for k, x in found.items() if x)
    kept = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {i for i in got if not got[i]["n_hit"]}


def test_jaccard(spark, texts, docs):
    def shingles(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    link = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    for small in (4096, 2):  # buckets compared at once, and split down to the last level
        got = {r["doc_id"]: r for r in jaccard.similar_documents(docs, small=small).collect()}
        assert {i: got[i]["n_links"] for i in got} == {i: sum(1 for a, _ in link if a == i) for i in range(len(sets))}
        assert all(got[i]["class_id"] == got[j]["class_id"] for i, j in link)
        assert sum(r["kept"] for r in got.values()) == len({r["class_id"] for r in got.values()})
    assert jaccard.keep_one(docs).count() == len({r["class_id"] for r in got.values()})


def test_large_groups_are_compared_in_blocks(spark):
    from barspark.llm import pairs

    rows = spark.createDataFrame([(1, i, 1, float(i % 3)) for i in range(50)], "g long, rep long, weight long, x double")
    same = lambda _, t: t["x"].to_numpy()[:, None] == t["x"].to_numpy()[None, :]
    dealt = pairs.deal(rows, ["g"], block=8)
    got = pairs.links(dealt, ["g"], same).groupBy("rep").agg(F.sum("links").alias("n")).collect()
    assert {r["rep"]: r["n"] for r in got} == {i: len([j for j in range(50) if j % 3 == i % 3]) - 1 for i in range(50)}
    alone = lambda _, t: (t["rep"].to_numpy()[:, None] + t["rep"].to_numpy()[None, :]) == 49
    got = pairs.candidates(dealt, ["g"], alone).collect()
    assert sorted(r["rep"] for r in got) == list(range(50))  # each row is asked for where its one partner is


def test_rows_that_share_an_id(spark):
    """Rows of one id with different contents are separate documents and vectors; each keeps its own links."""
    rng = random.Random(11)
    words = vocabulary(rng, 300)
    a, b = (prose(rng, words, 80) for _ in range(2))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, b), (4, b), (None, a), (5, None), (5, "")]
    got = sorted(((r["doc_id"] or 0), r["class_id"] or 0, r["n_links"], r["kept"]) for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, 1, 1, True), (1, 1, 3, True), (2, 1, 1, False), (3, 1, 3, False), (4, 1, 3, False), (4, 1, 3, False), (0, 0, 0, True), (5, 5, 0, True), (5, 5, 0, True)])
    kept = jaccard.keep_one(spark.createDataFrame([(0, b, 7), (1, a, 7), (1, b, 7), (5, None, 7)], "doc_id long, text string, _gone int")).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == sorted([(0, b), (1, a), (5, "")])  # of id 1 the copy alone goes
    v = np.random.default_rng(1).normal(size=(3, 8))
    rows = [(1, v[0], 1), (1, v[1], 1), (3, 2 * v[1], 1), (2, v[0], 1), (2, v[0], 1), (7, v[2], 1), (7, None, 1), (8, v[2], 2)]
    frame = spark.createDataFrame([(i, None if x is None else [float(y) for y in x], m) for i, x, m in rows], "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["component_id"], r["n_links"], r["kept"]) for r in embeddings.near_duplicates(frame.withColumn("rep", F.lit(0)).withColumn("v", F.lit(1))).collect())
    assert got == sorted([(1, 1, 2, True), (1, 1, 1, True), (3, 1, 1, False), (2, 1, 2, False), (2, 1, 2, False), (7, 7, 0, True), (7, 7, 0, True), (8, 8, 0, True)])


def test_recall_of_the_similarity_joins(spark):
    """Many pairs just above the thresholds, against all pairs by brute force."""
    rng = random.Random(21)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(104)] for _ in range(150)]
    near = [[*t[:94], *(f"x{rng.randrange(10**6)}" for _ in range(rng.randint(5, 16)))] for t in base]
    rows = [(i, " ".join(t)) for i, t in enumerate([*base, *near])]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    want = {i for i in range(150) if len(sets[i] & sets[150 + i]) >= 0.8 * len(sets[i] | sets[150 + i])}
    for small in (2048, 2):
        got = {r["doc_id"] for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), small=small).where("n_links = 1 AND doc_id < 150").collect()}
        assert len(want) > 50 and got == want
    g = np.random.default_rng(3)
    x = g.normal(size=(400, 24))
    x = np.concatenate([x, x + g.normal(scale=0.37, size=x.shape)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.93
    frame = spark.createDataFrame([(i, [float(y) for y in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    for bucket in (256, 4):
        got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(frame, bucket=bucket).collect()}
        assert link.sum() > 1000 and got == {i: int(link[i].sum()) - 1 for i in range(len(x))}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(20)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in {x for a, b in edges if a != b for x in (a, b)}}


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    vecs = [*base, *(base[:20] + rng.normal(scale=0.12, size=(20, 16))), base[0], base[1]]
    rows = [(i, [float(x) for x in v], i % 2 if i < 40 else (i - 40) % 2 if i < 60 else i % 2) for i, v in enumerate(vecs)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [math.nan] * 16, 1), (103, [1.0] * 16, None), (104, [1.0] * 8, 1), (105, [None] * 16, 1), (106, [], 0)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = [r for r in rows if r[0] < 100]
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    for i, v, label in good:
        assert got[i]["n_links"] == sum(1 for j, w, m in good if j != i and m == label and cos(v, w) >= 0.93), i
    for i in range(100, 107):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[40]["component_id"] == got[0]["component_id"] == 0 and len(got) == len(rows)
    floats = spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], m) for i, v, m in rows], "vec_id long, embedding array<float>, label int")
    doubles = floats.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert sorted(map(tuple, embeddings.near_duplicates(floats).collect())) == sorted(map(tuple, embeddings.near_duplicates(doubles).collect()))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(empty).count() == 0


def test_lines(spark):
    a = [f"line number {i} of the first text" for i in range(12)]
    rows = [(1, "\n".join(a)), (2, "own start\n" + "\n".join(a[3:8]) + "\nown end"), (3, "nothing shared here"), (4, "\n".join(a)), (5, "other\n" + a[0] + "\nthing")]
    rows += [(10 + i, f"private {i}\nthe very common line\nmine {i}") for i in range(30)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[0][1] and got[3]["n_deleted"] == 0
    assert got[2]["text"] == "own start\nown end" and got[2]["n_deleted"] == 5
    assert got[4]["text"] == "" and got[4]["n_deleted"] == 12
    assert got[5]["text"] == "other\nthing"  # a rare line
    assert all(got[10 + i]["n_deleted"] == 0 for i in range(30))  # one line that is not rare
    assert lines.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert lines.patience([1, 1, 2], [1, 2, 2]) == [(0, 0), (2, 2)]


def test_lines_in_many_documents(spark):
    """However many documents hold it: a long line, two lines, a whole document; blocks whose lines occur elsewhere before."""
    line, two = "one passage on a single line " * 12, ["first line of the pair", "second line of the pair"]
    rows = [(100 + i, f"own {i}\n{line}\nend {i}") for i in range(40)]
    rows += [(200 + i, "\n".join([f"before {i}", *two, f"after {i}"])) for i in range(40)] + [(300 + i, "short copy") for i in range(40)]
    block = ["alpha", "beta", "gamma"]
    rows += [(i, f"u{i}\n{x}\nv{i}") for i, x in enumerate(block)]
    rows += [(10 + i, f"s{i}\n{block[i % 3]}\nt{i}") for i in range(60)]  # so that no single line is rare
    rows += [(400 + i, "\n".join([f"x{i}", *block, f"y{i}"])) for i in range(2)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_deleted"] for i in (100, 200, 300, 400)] == [0] * 4
    for i in range(1, 40):
        assert (got[100 + i]["text"], got[200 + i]["text"], got[300 + i]["text"]) == (f"own {i}\nend {i}", f"before {i}\nafter {i}", "")
    assert got[401]["text"] == "x1\ny1" and all(got[10 + i]["n_deleted"] == 0 for i in range(60))


def brute_lines(rows: list[tuple[int, str]], common: int = 3, long: int = 32) -> dict[int, set[int]]:
    """Lines deleted from each document when all pairs are aligned; every run here has few holders."""
    cut = {i: [x.strip(" \t\r\x0b\x0c") for x in t.split("\n")] for i, t in rows}

    def counted(x, y, k):
        """The runs of k lines (with the gaps between them) of x that y holds too, by first line."""
        def found(ls):
            at = [i for i, v in enumerate(ls) if v]
            return {tuple((ls[p], p - at[j]) for p in at[j : j + k]): at[j] for j in range(len(at) - k + 1)}
        fx, fy = found(x), found(y)
        return {r for r in fx if r in fy}

    gone = collections.defaultdict(set)
    for i, (a_id, _) in enumerate(rows):
        for b_id, _ in rows[i + 1 :]:
            a, b = cut[a_id], cut[b_id]
            if a == b and any(b):
                gone[b_id] = set(range(len(b)))
                continue
            one, two, three = (counted(a, b, k) for k in (1, 2, common))
            if not one:
                continue
            block, last = [], (-2, -2)
            for m in [*lines.patience(a, b), (-9, -9)]:
                if m != (last[0] + 1, last[1] + 1):
                    if any(b[j] for j in block):  # every shared line is rare, so any block with a line counts
                        gone[b_id] |= set(block)
                    block = []
                block.append(m[1])
                last = m
    return gone


def test_lines_by_brute_force(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pool = [f"line {i} " + "x" * rng.choice([0, 30]) for i in range(60)]
        rows = []
        for d in range(14):
            body = []
            for _ in range(rng.randint(1, 6)):
                at = rng.randrange(len(pool))
                body += rng.choice([pool[at : at + rng.randint(1, 6)], [f"own {d} {rng.random()}"], [""]])
            rows.append((d, "\n".join(body)))
        rows += [(20, rows[3][1]), (21, rows[3][1])]
        got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        want = brute_lines(rows)
        for i, t in rows:
            ls = t.split("\n")
            assert got[i]["n_deleted"] == len(want[i]), (seed, i)
            assert got[i]["text"] == "\n".join(x for j, x in enumerate(ls) if j not in want[i])


def test_lines_are_found_beside_other_holders(spark):
    """Two documents share a block whose lines, one by one, are first held by others; also with a rare line in it."""
    rows = [(i, f"a{i}\n{x}\nb{i}") for i, x in enumerate(["first", "second", "third"])]
    rows += [(10 + i, f"c{i}\n{['first', 'second', 'third'][i % 3]}\nd{i}") for i in range(60)]
    rows += [(500, "p\nfirst\nsecond\nthird\nq"), (501, "r\nfirst\nsecond\nthird\ns")]
    rows += [(80, "e\nrare line\nf"), (600, "p6\nfirst\nrare line\nthird\nq6"), (601, "r6\nfirst\nrare line\nthird\ns6")]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[501]["text"] == "r\ns" and got[601]["text"] == "r6\ns6" and got[600]["text"] == "p6\nfirst\nthird\nq6"
    assert all(got[i]["n_deleted"] == 0 for i, _ in rows if i < 200)


def test_lines_extra_columns_and_scratch(spark):
    from pathlib import Path

    where = Path(common.shared_folder(spark).removeprefix("file:")).parent
    before = set(where.iterdir()) if where.exists() else set()
    d = spark.createDataFrame([(1, "a b\nc d\ne f", 1, 2, 3, 4), (2, "a b\nc d\ne f", 5, 6, 7, 8), (None, "a b\nc d\ne f", 5, 6, 7, 8), (1, "a b\nc d\ne f", 1, 2, 3, 4), (3, None, 0, 0, 0, 0), (4, " \n", 0, 0, 0, 0)], "doc_id long, text string, _lines int, _n int, __row_key int, _gone int")
    got = sorted(((r["doc_id"] or 99, r["text"], r["n_deleted"], r["_lines"]) for r in lines.dedup_lines(d).collect()), key=str)
    assert got == sorted([(1, "a b\nc d\ne f", 0, 1), (1, "a b\nc d\ne f", 0, 1), (2, "", 3, 5), (99, "", 3, 5), (3, None, 0, 0), (4, " \n", 0, 0)], key=str)
    assert len(set(where.iterdir()) - before) <= 1  # the result's table alone


def test_spans(spark, texts):
    rng = random.Random(9)
    words = vocabulary(rng, 500)
    plain, flat = prose(rng, words, 60), " ".join(rng.choices(words, k=60))
    cases = {1: plain, 2: f"{texts[1]} {plain} {texts[2]}", 3: f"{texts[3]} {flat} {texts[4]}", 4: f"before it {flat} after it", 5: texts[5], 6: texts[6] + " " + texts[7][:40]}
    got = {r["doc_id"]: r for r in spans.dedup_spans(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert all(got[i]["text"] == cases[i] and got[i]["n_removed"] == 0 for i in (1, 3, 5, 6))
    for i in (2, 4):
        assert 35 <= got[i]["words_removed"] <= 62
    assert got[2]["text"].startswith(texts[1][:40]) and got[2]["text"].endswith(texts[2].rstrip()[-40:])
    want = brute_spans(cases)
    assert {i: got[i]["words_removed"] for i in cases} == {i: len(x) for i, x in want.items()}


def brute_spans(cases: dict[int, str], window: int = 8, least: int = 20) -> dict[int, set[int]]:
    """The words that go from each text, from the rule alone: only the hash of a word, which the cuts depend on, is shared."""
    from barspark.llm.textvec import SPACED, words as hashed

    seen, gone = set(), {}
    for i in sorted(cases):
        text = cases[i]
        found = [(m.start(), m.group()) for m in re.finditer(r"[^ \t\n\r\x0b\x0c]+", text)]
        h = [int(hashed(w.encode(), SPACED)[0][0]) for _, w in found]
        cuts = {0, len(found)}
        for k in range(1, len(found)):
            between = text[found[k - 1][0] + len(found[k - 1][1]) : found[k][0]]
            if "\n" in between or found[k - 1][1][-1] in ".!?":
                cuts.add(k)
        for k in range(len(found) - window + 1):
            low = min(h[k : k + window])
            cuts.add(max(j for j in range(k, k + window) if h[j] == low) + 1)
        at = sorted(cuts)
        gone[i] = set()
        for s in range(len(at) - 1):
            e = s + 2
            while e < len(at) and at[e] - at[s] < least:
                e += 1
            if e < len(at):
                run = tuple(w for _, w in found[at[s] : at[e]])
                if run in seen:
                    gone[i] |= set(range(at[s], at[e]))
                seen.add(run)
    return gone


def test_spans_by_brute_force(spark):
    """Random texts with shared passages, within and across documents; a run that most documents hold."""
    rng = random.Random(12)
    words = vocabulary(rng, 300)
    pool = [prose(rng, words, rng.randint(25, 60)) for _ in range(6)]
    cases = {i: " ".join(rng.choice([rng.choice(pool), pool[0], prose(rng, words, rng.randint(5, 40))]) for _ in range(rng.randint(1, 4))) for i in range(60)}
    got = {r["doc_id"]: r["words_removed"] for r in spans.dedup_spans(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    want = brute_spans(cases)
    assert got == {i: len(x) for i, x in want.items()} and sum(got.values()) > 500


def test_heavy_values(spark):
    rng = random.Random(2)
    values = [7] * 400 + [8] * 150 + [rng.randint(100, 10**9) for _ in range(3000)]
    rng.shuffle(values)
    rows = spark.createDataFrame([(v,) for v in values], "run long").repartition(5)
    got = {r[0] for r in common.heavy_values(rows, "run", support=20).collect()}
    assert 7 in got and got <= {7, 8}
    assert common.heavy_values(rows.where("run < 0"), "run").count() == 0
    left = rows.where("run < 9").withColumn("x", F.monotonically_increasing_id())
    right = spark.createDataFrame([(7, 400, "a"), (8, 150, "b")], "run long, n long, y string")
    joined = common.join_counted(left, right, ["run"], "n", F.col("x"))
    assert {tuple(r) for r in joined.groupBy("run", "y").count().collect()} == {(7, "a", 400), (8, "b", 150)}


def test_spans_find_every_passage_of_51_words(spark):
    """Without sentence ends of its own, in any surroundings, whatever its words."""
    rng = random.Random(4)
    words = vocabulary(rng, 5000)
    text = lambda n, v=words: " ".join(rng.choices(v, k=n))
    rows = []
    for i in range(150):
        passage = text(51, words if i % 2 else words[i : i + 12])
        rows += [(i, f"{text(rng.randint(0, 30))} {passage} {text(rng.randint(0, 30))}"), (1000 + i, f"{text(rng.randint(0, 5))}. {passage} {text(rng.randint(0, 5))}. {text(9)}")]
    got = {r["doc_id"]: r["words_removed"] for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(150) if got[1000 + i] < spans.WORDS_PER_RUN] == []


def test_language(spark):
    rng = random.Random(2)
    alphabets = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwxyzé"}
    words = {k: ["".join(rng.choice(a + "eaio") for _ in range(rng.randint(2, 7))) for _ in range(300)] for k, a in alphabets.items()}
    make = lambda k: " ".join(rng.choices(words[k], k=rng.randint(20, 60)))
    rows = [(i, make(k := rng.choice(list(words))), k, f"host.{k}", 1) for i in range(300)]
    model = language.fit(spark.createDataFrame(rows[:200], DOC))
    held = spark.createDataFrame(rows[200:], DOC)
    got = {r["doc_id"]: r for r in language.identify_documents(held, model).collect()}
    assert sum(got[r[0]]["language"] == r[2] for r in rows[200:]) >= 98 and sum(r["kept"] for r in got.values()) >= 98
    wrong = spark.createDataFrame([(1, make("aa"), "bb", "host.bb", 1), (2, None, "aa", "x", 1), (3, "12 34 !!", "aa", "x", 1), (4, "a", "aa", "host.aa", 1)], DOC)
    got = {r["doc_id"]: r for r in language.identify_documents(wrong, model).collect()}
    assert got[1]["language"] == "aa" and not got[2]["kept"] and not got[3]["kept"] and got[4]["language"] == "aa"
    pages = spark.createDataFrame([(7, "http://www.host.bb/x", f'<html lang="bb"><script>var a;</script><p>{make("bb")}</p></html>'), (8, None, None)], "page_id long, url string, html string")
    seen = {r["page_id"]: r for r in language.identify_pages(pages, model).collect()}
    assert (seen[7]["language"], seen[7]["host"], seen[7]["declared_lang"]) == ("bb", "www.host.bb", "bb") and not seen[8]["kept"]


MIT_TEXT = """MIT License

Copyright (c) 2021 Some Body and others

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_HEAD = """Copyright (c) 1998, Example Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of Example Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_ODD = """
3. The widget may not be painted green without a letter from the king.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
APACHE_TEXT = """Copyright 2019 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL_TEXT = """This {0} is free software{3} you can redistribute it and/or modify
it under the terms of the GNU {1} as published by
the Free Software Foundation{2}

This {0} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {1} for more details.
"""


def test_licenses(spark):
    later = lambda v, sep=",": f"{sep} either version {v} of the License, or\n(at your option) any later version."
    gpl, lgpl, agpl = "General Public License", "Lesser General Public License", "Affero General Public License"
    commented = lambda text, lead: "\n".join(f"{lead} {x}".rstrip() for x in text.splitlines())
    block = "/*\n" + commented(BSD_HEAD + BSD_THIRD + BSD_TAIL, " *") + "\n */\nint main() { return 0; }\n"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.\n"
    isc = 'Copyright (c) 2020, A Person\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n'
    flat = " ".join(licenses.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    cases = [
        (f"Some text before it.\n\n{MIT_TEXT}\nmore", ["MIT"]), (commented(MIT_TEXT, "//"), ["MIT"]), (MIT_TEXT.replace("\n\n", "\n"), ["MIT"]),
        (BSD_HEAD + BSD_TAIL, ["BSD-2-Clause"]), (BSD_HEAD + BSD_THIRD + BSD_TAIL, ["BSD-3-Clause"]), (block, ["BSD-3-Clause"]), (BSD_HEAD + BSD_ODD + BSD_TAIL, []),
        (flat, ["BSD-2-Clause"]), (flat + " " + licenses.SENTENCES["bsd-endorse"], ["BSD-3-Clause"]),
        (APACHE_TEXT, ["Apache-2.0"]), (commented(APACHE_TEXT, "#"), ["Apache-2.0"]), ("<!--\n" + APACHE_TEXT + "-->", ["Apache-2.0"]),
        (GPL_TEXT.format("program", gpl, later(3), ":"), ["GPL-3.0-or-later"]), (commented(GPL_TEXT.format("program", gpl, later(2, ";"), ";"), " *"), ["GPL-2.0-or-later"]),
        (GPL_TEXT.format("program", gpl, ", version 3 of\nthe License.", ":"), ["GPL-3.0-only"]), (GPL_TEXT.format("program", gpl, "; version 2.", ";"), ["GPL-2.0-only"]),
        (GPL_TEXT.format("library", lgpl, later("2.1", ";"), ";"), ["LGPL-2.1-or-later"]), (GPL_TEXT.format("library", lgpl, later("3"), ":"), ["LGPL-3.0-or-later"]), (GPL_TEXT.format("program", agpl, later("3"), ":"), ["AGPL-3.0-or-later"]),
        (mpl, ["MPL-2.0"]), (commented(mpl, "--"), ["MPL-2.0"]), (isc, ["ISC"]),
        ("this is under the MIT licence, roughly", []), ("A word. Licensed under CC BY-NC 4.0. Released  under the mit license!", ["CC-BY-NC-4.0", "MIT"]),
        ("x = 1\n# SPDX-License-Identifier: GPL-2.0-only\ny = 2", ["GPL-2.0-only"]), ("words here\nSPDX-License-Identifier: MIT\nand more words", ["MIT"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]), ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */\nint x;", ["GPL-2.0-only"]),
        ("# SPDX-License-Identifier: (GPL-2.0-or-later OR BSD-3-Clause) AND MIT\ncode here", ["BSD-3-Clause", "GPL-2.0-or-later", "MIT"]), ("SPDX-License-Identifier: Strange OR Stranger", []),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]), ("Licensed under the GNU General Public License v3.0.", ["GPL-3.0-only"]),
        ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file)", ["BSL-1.0"]), ("This work is dedicated to the public domain under CC0 1.0.", ["CC0-1.0"]),
        (licenses.SENTENCES["mit-grant"] + " A stranger in between. " + licenses.SENTENCES["mit-notice"], ["unknown variant of MIT"]), (licenses.SENTENCES["mit-notice"], []),
        (MIT_TEXT.replace("THE SOFTWARE IS PROVIDED", "The Software shall be used for Good, not Evil.\n\nTHE SOFTWARE IS PROVIDED", 1), ["unknown variant of MIT"]),
        (licenses.SENTENCES["mit-grant"] + " " + licenses.SENTENCES["mit-notice"], ["MIT"]), (isc + "\nBut not on Sundays.", ["unknown variant of ISC"]), (None, []), ("", []),
    ]
    rows = [(i, t) for i, (t, _) in enumerate(cases)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(i, got[i]) for i in got if got[i] != cases[i][1]] == []
    ids, _ = licenses.known_sentences()
    assert [k for k in ids if not any(a in k for a in licenses.ANCHORS) and not k.startswith("under ")] == []
    assert all(any(a in w for a in licenses.ANCHORS) for w in ("released", "licensed", "licenced", "distributed", "available", "published", "provided"))


def test_warc(spark):
    rows = [(i, f"http://www.h{i % 3}.example.com/p{i}?q={i}", f"<p>body {i % 5}\r\n\r\nWARC/1.1 in the text é</p>") for i in range(30)]
    rows += [(50, None, None), (51, "https://a.b/c", ""), (None, "http://x.y/z", "<p>body 1\r\n\r\nWARC/1.1 in the text é</p>"), (60, "http://x.y/z", "single")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.archive(pages).collect()
    got = {r["page_id"]: r for r in warc.digest(spark.createDataFrame(out, warc.RUN_ROWS)).collect()}
    assert len(out) == len(rows) and all(r["ok"] for r in out)
    first = {}
    for i, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", i)
    for i, _, html in rows:
        want = first.get(html or "", i)
        assert got[i]["record_type"] == ("response" if i == want else "revisit") and got[i]["refers_to"] == (None if i == want else want)
        assert got[i]["payload_bytes"] == len((html or "").encode())
    classed = warc.archive(pages, classes=((10, 3), (1 << 20, 2))).collect()
    cols = ("page_id", "payload_digest", "record_type", "refers_to")
    assert sorted(str([r[c] for c in cols]) for r in classed) == sorted(str([r[c] for c in cols]) for r in out)
    assert max(collections.Counter(r["archive"] for r in classed).values()) <= 3
    keys = [(r["url_key"], r["captured_at"]) for r in out]
    assert keys == sorted(keys) and warc.url_key("http://www.a.example.com:80/x?y#z") == "com,example,a)/x?y"
    rng = random.Random(0)
    for k in range(6):
        runs = [sorted((rng.randint(0, 9),) for _ in range(rng.randint(0, 7))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)
        tree, out = warc.LoserTree(), []
        for run in sorted((r for r in runs if r), key=lambda r: r[0]):  # opened when the merge gets to its first row
            out += tree.until(run[0])
            tree.add(run)
        assert out + list(tree) == sorted(x for r in runs for x in r)


def test_warc_merge_of_many_runs(spark):
    """Many ranges, chunks of few rows, a url with most captures: the history is sorted and whole."""
    rng = random.Random(5)
    rows = []
    for a in range(7):
        run = sorted((rng.choice(["com,hot)/", "com,hot)/", f"com,x{rng.randint(0, 9)})/p"]), f"2024-01-{rng.randint(1, 28):02d}T00:00:00Z", str(i)) for i in range(rng.randint(0, 200)))
        rows += [(u, t, p, f"archive-{a}", i, "u", 1, "d", "response", None, True) for i, (u, t, p) in enumerate(run)]
    runs = spark.createDataFrame(rows, warc.RUN_ROWS).coalesce(2)
    for options in ({"range_rows": 50, "chunk": 3}, {"range_rows": 10**6, "chunk": 1}, {}):
        got = [tuple(r) for r in warc.merge_runs(runs, **options).collect()]
        assert [r[:2] + r[3:5] for r in got] == sorted(r[:2] + r[3:5] for r in rows) and sorted(got, key=str) == sorted(rows, key=str)


def test_warc_records(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a.b/1", "same"), (2, "http://a.b/2", "same"), (None, None, "same"), (3, "http://a.b/3", "")], "page_id long, url string, html string")
    warc.write_archives(pages.select("*", F.lit(1).alias("first"), F.lit(2).alias("n"), F.lit("x").alias("payload_digest")), f"file:{tmp_path}/w")
    records = [r for f in sorted(tmp_path.glob("w/*/*.gz")) for r in warc.records_in(gzip.open(f))]
    kinds = collections.Counter(f["WARC-Type"] for f, _, _ in records)
    assert kinds["response"] == 2 and kinds["revisit"] == 2 and kinds["warcinfo"] >= 1
    first = next(f for f, _, _ in records if f.get("X-Page-Id") == "1")
    for f, _, _ in records:
        if f["WARC-Type"] == "revisit":
            assert (f["WARC-Refers-To-Target-URI"], f["WARC-Refers-To-Date"]) == ("http://a.b/1", first["WARC-Date"])
    for f in tmp_path.glob("w/*/*.gz"):
        assert next(warc.records_in(gzip.open(f)))[0]["WARC-Type"] == "warcinfo"


def spark_uniform(spark, n, k):
    df = spark.range(n)
    for step in mixing.uniform_steps("id", f"{k}L", 1, "div"):
        df = df.selectExpr("*", step)
    return df.collect()


def test_mixing(spark, docs):
    plan = mixing.mix(docs, block=16, shard_slots=32)
    got = plan.taken().collect()
    again = mixing.mix(docs.repartition(3), block=16, shard_slots=32).taken().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == docs.count()
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        x = by[r["source"]]
        x[0], x[1], x[2] = x[0] + r["size"], x[1] + r["taken"], r["target"]
    total = sum(x[0] for x in by.values())
    assert abs(sum(x[2] for x in by.values()) - total) < 1e-6 * total
    assert all(abs(x[1] - x[2]) <= 1 for x in by.values())
    # The draw: each shard has its slots, the counts vary from shard to shard about the sources' shares.
    counts, draws = plan.counts.collect(), plan.draws.collect()
    slots, sources = len(draws), {r["rank"]: r["n_draws"] for r in plan.sources.collect()}
    assert sorted(r["slot"] for r in draws) == list(range(slots)) and slots == sum(sources.values())
    per = collections.Counter()
    for r in counts:
        per[r["shard"]] += r["n"]
    assert all(n == min(32, slots - 32 * s) for s, n in per.items())
    drawn = collections.Counter(r["rank"] for r in draws)
    assert drawn == sources
    shares = [r["n"] - per[r["shard"]] * sources[r["rank"]] / slots for r in counts]
    assert 0 < sum(abs(x) > 0.5 for x in shares) and max(abs(x) for x in shares) < 6 * 32**0.5
    moved = sum(abs(sum(r["n"] for r in counts if r["rank"] == k) - n) for k, n in sources.items()) / 2
    assert moved < 3 * slots**0.5 * len(sources)
    # A document's place in its source's stream does not depend on how many documents there are.
    fewer = {r["doc_id"]: r["bucket"] for r in mixing.mix(docs.where("doc_id % 2 = 0")).documents.collect()}
    assert all(fewer[r["doc_id"]] == r["bucket"] for r in plan.documents.collect() if r["doc_id"] in fewer)
    small = spark.createDataFrame([("a", 10), ("b", 1000), (None, 50)], "source string, source_size long")
    t = {r["source"]: r["target"] for r in mixing.targets(small).collect()}
    assert t["a"] == 30.0 and abs(t["b"] + t[None] - 1030) < 1e-9 and t[None] == 150.0
    n = 97
    u = [r["_u"] for r in spark_uniform(spark, 20_000, 10)]
    assert set(u) == set(range(10)) and max(abs(u.count(k) - 2000) for k in range(10)) < 5 * 1800**0.5
    image = mixing.permute(spark.range(n).selectExpr("id", f"{n}L AS n", "5L AS key"), "id", "n", "key", "y").select("y").collect()
    assert sorted(r["y"] for r in image) == list(range(n))


def test_lm(spark, texts, docs):
    got = {r["doc_id"]: r for r in interpolation.score_documents(docs, head_words=64, head_bigrams=64).collect()}
    toks = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)) + [None] for t in texts]
    train = [t for i, t in enumerate(toks) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(x for t in train for x in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(toks):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(x in c for x in t), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
    # The whole model by brute force, every bigram counted; the sizes of the broadcast heads do not matter.
    pairs_of = lambda t: list(zip([None, *t], t, strict=False))
    held = [t for i, t in enumerate(toks) if zlib.crc32(str(i).encode()) % 7 == 3]
    p, hp = (collections.Counter(x for t in d for x in pairs_of(t)) for d in (train, held))
    hc = collections.Counter(x for t in held for x in t)
    rest = n - sum(hc.values())
    seen = collections.Counter()
    for a, b in (x for t in held for x in pairs_of(t)):
        cv = c[a] - hc[a]
        seen[cv.bit_length(), (p[a, b] - hp[a, b]) / cv if cv else 0.0, (c[b] - hc[b]) / rest] += 1
    exact = interpolation.learn_weights([(*k, float(x)) for k, x in sorted(seen.items())], v)
    other = {r["doc_id"]: r["score"] for r in interpolation.score_documents(docs, slices=1).collect()}
    for i, t in enumerate(toks):
        want = sum(math.log10((l2 * p[a, b] / c[a] if c[a] else 0) + l1 * c[b] / n + l0 / (v + 1)) for a, b in pairs_of(t) for l2, l1, l0 in [exact[c[a].bit_length()]])
        assert math.isclose(got[i]["score"], other[i], rel_tol=1e-6)  # terms travel as floats
        # EM takes the means of cells of half a power of two: the scores hardly know.
        assert abs(got[i]["score"] - want) < 0.002 * len(t), i
    assert sum(other.values()) > sum(r["base_score"] for r in got.values())


def test_lm_probabilities_sum_to_one(spark):
    """From scores of texts alone: P(x), P(x y) / P(x) and P('') are the transitions between the words, one unknown
    word and the end, up to a scaling of the states, so the greatest eigenvalue is 1 if each p(. | v) sums to 1."""
    words = ["a", "b", "c", "d"]
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words, [8, 4, 2, 1], k=rng.randint(1, 9)))) for i in range(80)]
    test = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2]  # scored, not learned from
    states = [*words, "?"]
    ask = list(zip(test, ["", *states, *[f"{x} {y}" for x in states for y in states]], strict=False))
    got = {r["doc_id"]: r["score"] for r in interpolation.score_documents(spark.createDataFrame(rows + ask, "doc_id long, text string")).collect()}
    p = {t: 10 ** got[i] for i, t in ask}
    m = np.array([[p[""], *(p[x] for x in states)], *([1.0, *(p[f"{x} {y}"] / p[x] for y in states)] for x in states)])
    assert abs(max(abs(np.linalg.eigvals(m))) - 1) < 1e-6
    w = interpolation.learn_weights([(0, 0.0, 0.1, 5.0), (1, 1.0, 0.1, 5.0), (2, 0.5, 0.0, 1.0)], 4)
    assert np.allclose(w.sum(axis=1), 1) and w[0, 0] == 0


def test_awkward_rows(spark):
    d = awkward(spark)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (None, "w1 x1"), (2, None)], BENCH)
    n = d.count()
    assert decontaminate.digest(decontaminate.decontaminate(d, bench)).count() == n
    assert language.identify_documents(d).count() == n
    assert licenses.digest(licenses.scan_licenses(d)).count() == n
    assert mixing.digest(mixing.mix(d)).count() == n
    j = jaccard.similar_documents(d).collect()
    assert len(j) == n and {r["n_links"] for r in j if r["doc_id"] == 4} == {1}
    assert spans.dedup_spans(d).count() == n
    assert interpolation.score_documents(d).count() == n
    out = lines.dedup_lines(d)
    assert out.count() == n and {r["n_deleted"] for r in out.collect()} == {0}
    kept = language.known_language(d, model=language.fit(d))
    assert set(kept.columns) == set(d.columns)
    assert set(decontaminate.clean(d, bench).columns) == set(d.columns) and set(jaccard.keep_one(d).columns) == set(d.columns)


def test_empty_tables(spark):
    d, bench = spark.createDataFrame([], DOC), spark.createDataFrame([], BENCH)
    for out in (decontaminate.digest(decontaminate.decontaminate(d, bench)), language.identify_documents(d), licenses.digest(licenses.scan_licenses(d)), mixing.digest(mixing.mix(d)), jaccard.similar_documents(d), spans.dedup_spans(d), lines.dedup_lines(d), interpolation.score_documents(d)):
        assert out.count() == 0
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
