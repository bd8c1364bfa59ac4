"""Sharding, whitening and vector codes against plain versions, and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.llm import codebooks, common, sharding, whitening
from barspark.llm.queries import QUERIES
from tests.compare import SF

VECTORS = "vec_id long, embedding array<double>, label int"


# --- sharding -----------------------------------------------------------------------------------------------------


def plain_differencing(sizes: list[int], n: int) -> list[int]:
    """The rule written out on lists: subset sums after repeatedly joining the two most uneven partitions oppositely."""
    parts = [sorted([s] + [0] * (n - 1)) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        b, a = parts.pop(), parts.pop()
        parts.append(sorted(x + y for x, y in zip(a, reversed(b), strict=True)))
    return parts[0]


@pytest.mark.parametrize("n", [1, 2, 3, 8])
def test_differencing(n):
    rng = random.Random(n)
    for size in (1, 2, 5, 40, 300):
        sizes = [rng.randint(1, 10**rng.randint(1, 7)) for _ in range(size)]
        shards = sharding.difference(sizes, n)
        held = [0] * n
        for s, k in zip(sizes, shards, strict=True):
            held[k] += s
        assert sum(held) == sum(sizes) and max(held) - min(held) == (lambda p: p[-1] - p[0])(plain_differencing(sizes, n))
    assert sharding.difference([], n) == []


def test_differencing_finds_what_greedy_misses():
    held = collections.Counter()
    sizes = [8, 7, 6, 5, 4]
    for s, k in zip(sizes, sharding.difference(sizes, 2), strict=True):
        held[k] += s
    assert sorted(held.values()) == [14, 16]  # largest first to the emptiest gives 13 and 17


def whole(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")


def check_shards(rows, texts, n):
    """The contract of the digest on any table; returns bytes by shard."""
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == collections.Counter((i, size(t), crc(t)) for i, t in texts)
    held, slots, homes = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values()) and set(held) <= set(range(n))
    return [held[k] for k in range(n)]


def test_shards_are_those_of_plain_differencing(spark):
    rng = random.Random(3)
    texts = [(i, "x" * rng.randint(0, 4000) + rng.choice("éab")) for i in range(150)]
    texts += [(1000 + i, texts[7][1]) for i in range(9)]
    groups = collections.Counter()
    for _, t in texts:
        groups[t] += len(t.encode()) + 1
    held = check_shards(sharding.assign_shards(whole(spark, texts), 8).collect(), texts, 8)
    want = plain_differencing(list(groups.values()), 8)
    assert max(max(held) - min(held), want[-1] - want[0]) <= 50  # of 38,000; partitions of equal spread may be met in either order


def test_lumps_balance_too(spark):
    rng = random.Random(4)
    texts = [(i, f"{i} " + "y" * rng.randint(1, 300)) for i in range(3000)]
    held = check_shards(sharding.assign_shards(whole(spark, texts), 4, bins=64).collect(), texts, 4)
    assert max(held) - min(held) <= sum(held) // 1000


def test_a_hot_text_and_a_hot_row(spark):
    texts = [(i % 7 if i < 900 else i, "hot " * 30) for i in range(1500)] + [(5, "same row")] * 2500 + [(i, f"text {i} " * (i % 9)) for i in range(1500)]
    held = sorted(check_shards(sharding.assign_shards(whole(spark, texts), 4).collect(), texts, 4))
    hot = 1500 * (len("hot " * 30) + 1)
    assert held[3] == hot > sum(held) / 4  # it has a shard for itself, and the others share the rest
    assert held[2] - held[0] <= max(sum(held[:3]) // 100, 2500 * 9 - sum(held[:3]) // 3)


def test_awkward_documents(spark):
    texts = [(None, "a"), (1, None), (2, ""), (2, ""), (3, "z" * 500_000), (4, "tie"), (5, "tie"), (6, "été")]
    docs = spark.createDataFrame([(*t, 1, 2, 3, None) for t in texts], "doc_id long, text string, h1 int, shard_ int, size int, `a.b` string")
    rows = sharding.assign_shards(docs).collect()
    check_shards(rows, texts, 8)
    assert {r["shard"] for r in rows if r["size"] == 1} == {next(r["shard"] for r in rows if r["doc_id"] == 1)}
    kept = sharding.with_shard(docs, 8)
    assert kept.columns == [*docs.columns, "shard"]
    by = lambda rows: sorted((str(r["doc_id"]), r["shard"]) for r in rows)
    assert by(kept.collect()) == by(rows) == by(sharding.assign_shards(docs).collect())
    empty = docs.where("false")
    assert sharding.assign_shards(empty).count() == sharding.with_shard(empty, 8).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, 0)


def test_op11(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op11_shard_documents"](spark, SF).collect()
    held = check_shards(rows, texts, 8)
    assert max(held) - min(held) <= sum(held) // 1000 and {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


# --- integers and whitening -----------------------------------------------------------------------------------------


def integers(rows, offset):
    out = []
    for i, v, label in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            out.append((i, [math.floor(1024 * c) + offset for c in v], label))
    return out


@pytest.mark.parametrize("top", [3, 5000, 1 << 22, 1 << 40, (1 << 52) + 100_000])
def test_products_are_exact(top):
    rng = random.Random(top)
    x = [[rng.randint(-top, top) for _ in range(5)] for _ in range(300)]
    want = [[sum(r[i] * r[j] for r in x) for j in range(5)] for i in range(5)]
    assert whitening.exact_products(np.array(x, dtype=np.int64)).tolist() == want


@pytest.mark.parametrize("scale,far", [(1.0, 0.0), (1e6, 1e9), (3.0, 1e12)])
def test_scatter_is_exact(spark, scale, far):
    rng = random.Random(9)
    rows = [(i, [far + rng.gauss(0, scale) * (j + 1) for j in range(6)], i % 3) for i in range(200)]
    ints, d = whitening.integer_vectors(spark.createDataFrame(rows, VECTORS).repartition(5), {"id": "vec_id"}, "embedding", 1024, 100_000)
    got = whitening.scatter(ints, d)
    x = [v for _, v, _ in integers(rows, 100_000)]
    n, sums = len(x), [sum(v[j] for v in x) for j in range(6)]
    assert (got.n, got.sums) == (n, sums)
    assert got.matrix.tolist() == [[n * sum(v[i] * v[j] for v in x) - sums[i] * sums[j] for j in range(6)] for i in range(6)]


def check_whitened(got, rows, components=8):
    x = integers(rows, 100_000)
    n, d = len(x), len(x[0][1])
    sums = [sum(v[j] for _, v, _ in x) for j in range(d)]
    exact = [[Fraction(n * sum(v[i] * v[j] for _, v, _ in x) - sums[i] * sums[j], n * n) for j in range(d)] for i in range(d)]
    values, axes = np.linalg.eigh(np.array([[float(c) for c in r] for r in exact]))
    k = min(components, int((values > 1e-9 * values.max()).sum()))
    trace = float(sum(exact[j][j] for j in range(d)))
    flat = [r for r in got]
    assert len(flat) == n * k and {r["n"] for r in flat} == {n}
    by = collections.defaultdict(dict)
    for r in flat:
        by[r["vec_id"]].setdefault(r["component"], []).append(r)
    for c in range(k):
        e, u = values[-1 - c], axes[:, -1 - c]
        want = {i: float(sum(Fraction(n * v[j] - sums[j], n) * Fraction(float(u[j])) for j in range(d))) / math.sqrt(e) for i, v, _ in x}
        found = {i: by[i][c + 1][0]["whitened"] for i, _, _ in x}
        sign = math.copysign(1, sum(want[i] * found[i] for i in want))
        assert all(abs(sign * want[i] - found[i]) < 1e-6 for i in want)
        assert all(abs(r["explained"] - e / trace) < 1e-9 for i in by for r in by[i][c + 1])
    for i, v, _ in x:
        assert by[i][1][0]["deviation"] == sum((n * v[j] - sums[j]) ** 2 for j in range(d))
    assert max(r["identity_error"] for r in flat) < 1e-4 and len({r["identity_error"] for r in flat}) == 1


def test_op12(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitened(QUERIES["op12_whiten"](spark, SF).collect(), rows)


AWKWARD = [
    (1, None, 1), (2, [], 1), (3, [1.0, None, 2.0, 0.5, 1.0], 1), (4, [1.0, float("nan"), 0.0, 0.0, 0.0], 1), (5, [float("inf")] * 5, None),
    (6, [0.0] * 5, None), (7, [0.1, -0.2, 0.3, 0.4, -1.0], 2), (8, [0.1, -0.2, 0.3, 0.4, -1.0], 2), (9, [1.0, 2.0, 3.0], 1), (10, [1e300] * 5, 3),
    (11, [-0.0004, 5.0, 0.2, -7.0, 0.001], None), (12, [3.0, 2.0, -1.0, 0.0, 0.5], 2), (13, [-3.0, 0.2, 1.0, 0.1, 4.0], 3),
]


def awkward(spark, rows=None):
    df = spark.createDataFrame(AWKWARD if rows is None else rows, VECTORS)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["id", "x", "code", "n", "error", "w", "d", "name"])])


def test_awkward_vectors_whitened(spark):
    fine = [r for r in AWKWARD if r[0] not in (9, 10)]
    check_whitened(whitening.digest(whitening.whiten(awkward(spark))).collect(), fine)
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"]
    for rows in ([], AWKWARD[:5], AWKWARD[6:8], AWKWARD[5:6]):  # none, none that is kept, equal ones, a single one
        got = whitening.digest(whitening.whiten(awkward(spark, rows)))
        assert got.columns == columns and got.count() == 0
    repeated = whitening.whiten(awkward(spark, [(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (3, [2.0, 5.0], 1)])).collect()
    assert collections.Counter(r["vec_id"] for r in repeated) == {None: 2, 3: 1}  # one component has a variance
    huge = whitening.digest(whitening.whiten(awkward(spark, [(i, [1e11 * i, float(i * i)], 1) for i in range(50)]))).collect()
    assert {r["deviation"] for r in huge} == {None} and all(int(r["deviation_digits"]) > 1 << 63 for r in huge)


def test_whitening_far_from_zero(spark):
    """A mean far above the spread: doubles alone would lose every digit of the covariance."""
    rng = random.Random(2)
    rows = [(i, [1e9 + rng.gauss(0, 0.01) for _ in range(3)], 1) for i in range(300)]
    check_whitened([r for r in whitening.digest(whitening.whiten(spark.createDataFrame(rows, VECTORS))).collect()], rows)


# --- vector codes ---------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=4, size=256, rounds=4):
    """(id -> code, error, label_error), hash of the codebooks: Lloyd's rounds on lists of integers, all anew each time."""
    x = integers(rows, 0)
    x = [(i, v + [0] * (-len(v) % parts), label) for i, v, label in x]
    width = len(x[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    order = sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[cut(v, p) for _, v, _ in order[:size]] for p in range(parts)]
    far = lambda a, b: sum((c - e) ** 2 for c, e in zip(a, b, strict=True))
    assign = lambda: [[min((far(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in x]
    for _ in range(rounds):
        found = assign()
        for p, k in itertools.product(range(parts), range(len(books[0]))):
            own = [cut(v, p) for (_, v, _), f in zip(x, found, strict=True) if f[p][1] == k]
            if own:
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = collections.Counter()
    for (_, _, label), e in zip(x, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), e, by_label[label], sha) for (i, _, label), f, e in zip(x, found, errors, strict=True))


def coded(df, **kw):
    return sorted((str(r["vec_id"]), "".join(f"{c:02x}" for c in r["code"]), int(r["error"]), int(r["label_error"]), r["codebooks_sha256"]) for r in codebooks.compress(df, **kw).collect())


@pytest.mark.parametrize("size,rounds,width,scale", [(8, 4, 8, 1.0), (5, 6, 12, 1e6), (3, 2, 4, 3e11), (16, 0, 8, 1.0), (7, 1, 10, 1.0)])
def test_codes_are_those_of_plain_rounds(spark, size, rounds, width, scale):
    rng = random.Random(size)
    rows = [(i, [rng.gauss(rng.choice([-1, 0, 2]), 0.4) * scale for _ in range(width)], rng.choice([None, 1, 2])) for i in range(120)]
    rng.shuffle(rows)
    if scale > 1e9:
        rows = rows[:20]
        rows = [(i, [c / 1e4 for c in v], label) for i, v, label in rows]
    assert coded(spark.createDataFrame(rows, VECTORS).repartition(3), entries=size, rounds=rounds) == plain_codes(rows, size=size, rounds=rounds)


def test_nearest_is_exact_and_takes_the_lower():
    rng = random.Random(1)
    for top in (4, 1 << 20, 1 << 27, 1 << 50):
        x = [[rng.randint(-top, top) for _ in range(3)] for _ in range(50)]
        e = [x[3], [rng.randint(-top, top) for _ in range(3)], x[3], x[9], x[9]]
        at, dist = codebooks.nearest(np.array(x, dtype=np.int64), np.array(e, dtype=np.int64))
        want = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(e)) for v in x]
        assert [(int(d), int(k)) for d, k in zip(dist, at, strict=True)] == want


def test_later_rounds_shuffle_only_what_changed(spark):
    """Contributions of a state: minus where a part left, plus where it joined, nothing for the others."""
    state = spark.createDataFrame([([1, 2, 3, 4], [0, 1], [0, 1]), ([5, 6, 7, 8], [0, 1], [1, 1]), ([9, 9, 9, 9], None, [0, 0])], "x array<long>, was array<int>, code array<int>")
    got = sorted((r["part"], r["entry"], r["component"], int(r["value"])) for r in codebooks.changes(state, (2, 2, 2)).collect() if r["value"])
    assert got == [(0, 0, 0, 4), (0, 0, 1, 3), (0, 1, -1, 1), (0, 1, 0, 5), (0, 1, 1, 6), (1, 0, -1, 1), (1, 0, 0, 9), (1, 0, 1, 9)]


def test_awkward_vectors_coded(spark):
    fine = [r for r in AWKWARD if r[0] not in (9, 10)]
    assert coded(awkward(spark), entries=3) == plain_codes(fine, size=3)
    assert coded(awkward(spark)) == plain_codes(fine)  # fewer vectors than entries
    far = codebooks.digest(codebooks.compress(awkward(spark, [(1, [1e12, 0.0], 1), (2, [-1e12, 0.0], 1), (3, [0.0, 1.0], 2)]), entries=1)).orderBy("vec_id").collect()
    assert [(r["error"], r["label_error"], r["code"]) for r in far][0] == (None, None, "00000000")  # beyond a long
    for rows in ([], AWKWARD[:5]):
        got = codebooks.digest(codebooks.compress(awkward(spark, rows)))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0
    repeated = [(None, [1.0, 2.0, 3.0, 4.0], None), (2, [1.0, 2.0, 3.0, 5.0], 1), (2, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0, 2.0, 3.0, 4.0], 1)]
    assert coded(awkward(spark, repeated), entries=2) == plain_codes(repeated, size=2)


@pytest.mark.parametrize("name", ["op1_decontaminate", "op5_mix_sources", "op11_shard_documents", "op12_whiten", "op13_compress_vectors"])
def test_one_table_is_left(spark, name, monkeypatch):
    """Of all that a query writes to the shared folder only its result stays."""
    written, folder = [], common.shared_folder

    def recorded(*args, **kw):
        written.append(folder(*args, **kw))
        return written[-1]

    for module in (common, codebooks):
        monkeypatch.setattr(module, "shared_folder", recorded)
    assert QUERIES[name](spark, SF).count() > 0
    assert written and len([p for p in written if Path(p.removeprefix("file:")).exists()]) == 1
