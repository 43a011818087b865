"""Packing, centroid clustering and vector codes against their definitions and brute force."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import centroids, packing, vector_codes
from gridloom.llm.common import stored

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# --- packing ---------------------------------------------------------------------------------------------


def test_knapsack_equals_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes, values = np.array([2, 3, 5, 7]), rng.normal(1, 1, 4)
        value, counts = packing.knapsack(values, sizes, 15)
        fits = [c for c in itertools.product(range(8), range(6), range(4), range(3)) if np.dot(c, sizes) <= 15]
        assert value == pytest.approx(max(np.dot(c, values) for c in fits))
        assert counts @ sizes <= 15 and counts @ values == pytest.approx(value)


def test_column_generation_finds_the_known_optimum():
    # Two patterns serve all: 6 + 4 and 5 + 5.
    sizes, demand = np.array([4, 5, 6]), np.array([10.0, 8.0, 10.0])
    patterns, used = packing.column_generation(sizes, demand, 10)
    assert used.sum() == pytest.approx(14, rel=2e-3)
    assert (patterns @ sizes <= 10).all() and np.allclose(used @ patterns, demand)


def test_a_plan_takes_no_more_than_there_is_and_leaves_enough_to_fill_gaps():
    rng = random.Random(2)
    for n in (1, 7, 300, 5000):
        histogram = {}
        for _ in range(n):
            b = min(int(rng.lognormvariate(3, 1)) + 1, 128)
            histogram[b] = histogram.get(b, 0) + 1
        plan = packing.cutting_plan(histogram, 2048, 16)
        left, gap = dict(histogram), 0
        for pattern, count in plan:
            assert sum(b * c for b, c in pattern.items()) <= 128
            gap += count * (2048 - sum((16 * (b - 1) + 1) * c for b, c in pattern.items()))
            for b, c in pattern.items():
                left[b] -= c * count
        assert all(v >= 0 for v in left.values())
        assert sum((16 * (b - 1) + 1) * v for b, v in left.items()) >= gap
    assert packing.cutting_plan({}, 2048, 16) == []


def check_packed(pieces, texts, capacity):
    """Every id once, pieces gapless, lengths whole or a power of two. ``texts`` by id, one row each."""
    library, by_doc, by_sequence = Tokenizer.from_file(VOCABULARY), {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == texts.keys()
    for key, own in by_doc.items():
        ids = np.array([*library.encode(texts[key] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        assert b"".join(p.ids for p in own) == ids.tobytes() and {p.doc_tokens for p in own} == {len(ids)}
    lengths = []
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        lengths.append(sum(p.length for p in own))
    assert all(n == capacity or (n < capacity and n & (n - 1) == 0) for n in lengths)
    return lengths


def test_packed_sequences_hold_every_id_once(spark):
    rng = random.Random(3)
    sentence = lambda n: " ".join(rng.choice(["an", "thing", "of", "éclair", "x9", "…"]) for _ in range(n))
    texts = {i: sentence(rng.choice([1, 3, 20, 60, 61, 62])) for i in range(400)}
    texts |= {1000: None, 1001: "", 1002: sentence(30_000), 1003: sentence(64), 1004: " \n ", 1005: sentence(63)}
    rows = [(i, t, *"abcde") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, part string, rank string, n string, rest string").repartition(3)
    pieces = packing.packed_sequences(docs, VOCABULARY, capacity=64, unit=4).collect()
    lengths = check_packed(pieces, texts, 64)
    assert lengths.count(64) >= len(lengths) - 6
    # Few documents that fit are cut.
    fitting = [i for i, t in texts.items() if t and len({p.start for p in pieces if p.doc_id == i}) > 1 and next(p.doc_tokens for p in pieces if p.doc_id == i) <= 64]
    assert len(fitting) < 60


def test_packing_of_few_rows_and_of_none(spark):
    schema = "doc_id long, text string"
    assert packing.packed_sequences(spark.createDataFrame([], schema), VOCABULARY).collect() == []
    one = packing.packed_sequences(spark.createDataFrame([(5, None)], schema), VOCABULARY).collect()
    assert [(p.doc_id, p.start, p.length, p.offset, p.ids) for p in one] == [(5, 0, 1, 0, b"\1\0\0\0")]
    # Repeated rows and rows without an id are documents of their own.
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], schema)
    assert sorted((p.doc_id or 0, p.doc_tokens) for p in packing.packed_sequences(docs, VOCABULARY).where("start = 0").collect()) == [(0, 1), (0, 3), (1, 3), (1, 3)]
    with pytest.raises(ValueError):
        packing.packed_sequences(docs, VOCABULARY, capacity=100)


# --- vectors ---------------------------------------------------------------------------------------------

SCHEMA = "vec_id long, embedding array<float>, label int, x string, cluster string, part string, code string, n string"
EXTRA = ("a", "b", "c", "d", "e")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, *EXTRA) for i, v, label in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    places = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    made = [(i, [float(np.float32(p + rng.gauss(0, 0.2))) for p in rng.choice(places)], rng.choice([1, 2, None])) for i in range(300)]
    # Exact ties, copies, rows that share an id, rows without one, and what has to go.
    made += [(1000 + i, [0.5 * (i % 2)] + [0.0] * 7, 1) for i in range(40)]
    made += [(7, made[3][1], 2), (7, made[3][1], 2), (None, made[4][1], None)]
    made += [(2000, None, 1), (2001, [], 1), (2002, [0.1] * 7 + [None], 1), (2003, [float("nan")] * 8, 1), (2004, [0.1] * 7 + [float("-inf")], 1), (2005, [0.1] * 6, 1)]
    return made


def whole(v, scale):
    return [int(np.floor(scale * float(np.float32(e)))) for e in v]


def usable(v, width):
    return v is not None and len(v) == width and all(e is not None and np.isfinite(e) for e in v)


def square(a, b):
    return sum((p - q) ** 2 for p, q in zip(a, b))


def nearest(x, entries):
    return min((square(x, c), j) for j, c in enumerate(entries))


def moved(entries, chosen):
    out = []
    for j, c in enumerate(entries):
        mine = [x for x, k in chosen if k == j]
        out.append([sum(e) // len(mine) for e in zip(*mine)] if mine else c)
    return out


@pytest.mark.parametrize("k, rounds", [(6, 5), (40, 3), (1, 2), (6, 0)])
def test_clusters_equal_a_full_scan(spark, rows, k, rounds):
    kept = [(i, whole(v, 256)) for i, v, _ in rows if usable(v, 8)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    places = [x for _, x in named[:k]]
    for _ in range(rounds):
        places = moved(places, [(x, nearest(x, places)[1]) for _, x in kept])
    want = [(i, *reversed(nearest(x, places))) for i, x in kept]
    inertia = {j: sum(d for _, c, d in want if c == j) for j in range(k)}
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in places]
    got = centroids.centroid_clusters(vectors(spark, rows).repartition(3), k=k, rounds=rounds, width=8).collect()
    assert sorted(((*r,) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(
        ((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in want), key=lambda r: (r[0] is None, r[0] or 0, r[1:])
    )


def test_bounds_spare_most_distances_and_hold_over_rounds():
    rng = np.random.default_rng(5)
    centers = rng.integers(-2000, 2000, (30, 16))
    x = centers[rng.integers(0, 30, 3000)] + rng.integers(-60, 60, (3000, 16))
    history = x[:30][None].copy()
    cluster, _, measured = centroids.first_scan(x, history[-1])
    measured, measured_in = measured.astype(np.float32).astype(np.float64), np.zeros(measured.shape, dtype=np.int64)
    for _ in range(8):
        places = np.array([x[cluster == j].sum(axis=0) // max((cluster == j).sum(), 1) if (cluster == j).any() else history[-1][j] for j in range(30)])
        history = np.concatenate((history, places[None]))
        cluster, distance, count = centroids.rescan(x, cluster, measured, measured_in, history)
        measured = measured.astype(np.float32).astype(np.float64)
        full = ((x[:, None] - places[None]) ** 2).sum(axis=2)
        assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert count.sum() < 0.2 * full.size


def test_no_vectors_no_clusters_and_too_large_ones_are_an_error(spark, rows):
    assert centroids.centroid_clusters(vectors(spark, [r for r in rows if r[0] and r[0] >= 2000]), width=8).collect() == []
    with pytest.raises(Exception, match="beyond"):
        centroids.centroid_clusters(vectors(spark, [(1, [1e9] * 8, 1)]), width=8).collect()


@pytest.mark.parametrize("size, edge", [(256, 32), (16, 100), (3, 7)])
def test_codes_equal_a_full_scan(spark, rows, size, edge):
    kept = [(i, whole(v, 1024), label) for i, v, label in rows if usable(v, 8)]
    cut = lambda x: [x[2 * p : 2 * p + 2] for p in range(4)]
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:size]
    books = [[cut(x)[p] for _, x, _ in start] for p in range(4)]
    for _ in range(4):
        books = [moved(book, [(cut(x)[p], nearest(cut(x)[p], book)[1]) for _, x, _ in kept]) for p, book in enumerate(books)]
    coded = []
    for i, x, label in kept:
        found = [nearest(part, book) for part, book in zip(cut(x), books)]
        coded.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
    by_label = {name: sum(e for _, _, e, own in coded if own == name) for name in {r[3] for r in coded}}
    sha = hashlib.sha256(",".join(str(e) for book in books for entry in book for e in entry).encode()).hexdigest()
    want = sorted(((i or -1, code, e, by_label[label], sha) for i, code, e, label in coded))
    got = vector_codes.vector_codes(vectors(spark, rows).repartition(3), size=size, edge=edge).collect()
    assert sorted((r[0] or -1, *r[1:]) for r in got) == want


def test_cells_spare_most_entries_and_forget():
    rng = np.random.default_rng(6)
    x = rng.integers(-500, 500, (4000, 3))
    entries = rng.integers(-500, 500, (200, 3))
    full = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    for limit in (50_000, 10):
        memo = vector_codes.CellMemo(entries, 64, limit)
        code, squares = memo.nearest(x)
        assert (code == full.argmin(axis=1)).all() and (squares == full.min(axis=1)).all()
        assert memo.n_measured < 0.2 * full.size and len(memo.cells.index) <= limit + vector_codes.ROWS


def test_no_vectors_no_codes(spark, rows):
    got = vector_codes.vector_codes(vectors(spark, rows[:0]))
    assert got.collect() == [] and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_only_tables_of_the_shared_folder_are_discarded(spark, tmp_path):
    from gridloom.llm.common import discard

    table = stored(spark.range(10), "to-discard")
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").removeprefix("//")
    discard(table)
    assert not __import__("os").path.exists(folder)
    spark.range(3).write.parquet(str(tmp_path / "own"))
    with pytest.raises(ValueError):
        discard(spark.read.parquet(str(tmp_path / "own")))
