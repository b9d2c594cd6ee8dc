"""Vector codes, nearest neighbours and hard negatives against brute force, in whole numbers where they are."""

import hashlib
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lossledger.llm import codes, common, negatives, neighbours
from lossledger.operators import blocks

SCHEMA = (
    "vec_id bigint, embedding array<float>, label int, id string, block int, rows string, number int, part int,"
    " vector string, `key` int, anchor string, place int"
)
EXTRA = ("x", 1, "r", 2, 3, "v", 4, "a", 5)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def vectors(seed=1, n=260, d=10, centres=9):
    """Clustered vectors with copies, small-grid ties, unusable rows, odd lengths and repeated ids."""
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(centres, d))
    out = []
    for k in range(n):
        v = base[rnd.integers(centres)] + rnd.normal(scale=0.15, size=d)
        if k % 7 == 0:
            v = np.round(v * 2) / 2
        out.append((k, [float(np.float32(x)) for x in v], int(rnd.integers(4))))
    for k in range(90):  # a hot vector
        out.append((1_000 + k, out[5][1], 2))
    return out


def unusable(d=10):
    good = [0.5] * d
    return [
        (2_000, None, 1), (2_100, [None, *good[1:]], 1), (2_200, [math.nan, *good[1:]], 1),
        (2_300, [math.inf, *good[1:]], 1), (2_400, [-math.inf, *good[1:]], 1),
    ]


def odd(d=10):
    """Rows that take part: null id or label, empty, zero and short vectors, repeated ids and rows."""
    good = [0.25] * d
    return [
        (None, good, 1), (3_000, good, None), (3_100, [], 1), (3_200, [0.0] * d, 2), (3_300, [1.0, -0.5], 0),
        (3_400, good, 0), (3_400, [-0.5] * d, 1), (3_500, good, 3), (3_500, good, 3),
    ]


# --- codes -------------------------------------------------------------------


def codes_by_hand(rows, scale=4096, n_parts=8, n_entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return [], None
    width = max(1, -(-max(len(r[1]) for r in kept) // n_parts))
    whole = [[math.floor(scale * x) for x in r[1]] + [0] * (width * n_parts - len(r[1])) for r in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:n_entries]
    parts = [[v[p * width : (p + 1) * width] for v in whole] for p in range(n_parts)]
    books = [[list(parts[p][k]) for k in first] for p in range(n_parts)]

    def nearest(p):
        out = []
        for v in parts[p]:
            squares = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in books[p]]
            out.append((squares.index(min(squares)), min(squares)))
        return out

    for _ in range(rounds):
        for p in range(n_parts):
            to = nearest(p)
            for e in range(len(first)):
                own = [v for v, (t, _) in zip(parts[p], to, strict=True) if t == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    final = [nearest(p) for p in range(n_parts)]
    errors = [sum(final[p][k][1] for p in range(n_parts)) for k in range(len(kept))]
    of_label = {}
    for r, e in zip(kept, errors, strict=True):
        of_label[r[2]] = of_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    top = (1 << 63) - 1
    return [
        (r[0], "".join(f"{final[p][k][0]:02x}" for p in range(n_parts)), min(errors[k], top), min(of_label[r[2]], top))
        for k, r in enumerate(kept)
    ], digest


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


@pytest.mark.parametrize("rows", [
    vectors() + unusable() + odd(),
    vectors(n=11, d=16)[:11],  # fewer rows than entries
    [(1, [3e38, -3e38, 1.0], 1), (2, [3e38, -2e38, 0.0], 1), (3, [1e30] * 3, None), (4, [1.0, 2.0, 3.0], None)] * 2,
    [(k, [0.0], 0) for k in range(40)],
    [(k, [], 0) for k in range(3)],
    unusable(),
    [],
], ids=["mixed", "few", "huge", "equal", "empty vectors", "unusable", "none"])
def test_codes(spark, rows):
    df = table(spark, rows).repartition(4)
    got = codes.digests(df, "vec_id", "embedding", "label")
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = got.collect()
    want, digest = codes_by_hand([(r[0], None if r[1] is None else [x if x is None else float(np.float32(x)) for x in r[1]], r[2]) for r in rows])
    assert ordered([tuple(r)[:4] for r in got]) == ordered(want)
    assert {r["codebooks_sha256"] for r in got} <= {digest}


def test_hilbert_keys_visit_every_cell_by_single_steps():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = codes.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shortlists_hold_every_nearest_entry():
    rnd = np.random.default_rng(2)
    shorter = 0
    for _ in range(200):
        parts = rnd.integers(-30, 30, 4) + rnd.integers(-6, 7, (20, 4))
        entries = rnd.integers(-40, 40, (16, 4))
        near, far = codes.box_distances(parts.min(0), parts.max(0), entries)
        kept = np.flatnonzero(near <= far.min())
        assert set(codes.nearest_entries(parts, entries)[0]) <= set(kept)
        shorter += len(kept) < 16
    assert shorter > 150


# --- nearest neighbours ------------------------------------------------------


def neighbours_by_hand(rows, is_query, k=5):
    kept = [(r[0], np.array(r[1], float)) for r in rows if r[0] is not None and r[1] and None not in r[1]
            and all(map(math.isfinite, r[1])) and any(r[1])]
    width = max((len(v) for _, v in kept), default=0)
    padded = [np.pad(v, (0, width - len(v))) for _, v in kept]
    out = []
    for q, (name, _) in enumerate(kept):
        if is_query(name):
            found = sorted(
                (-float(padded[q] @ v / np.linalg.norm(padded[q]) / np.linalg.norm(v)), other)
                for j, ((other, _), v) in enumerate(zip(kept, padded, strict=True)) if j != q)
            out += [(name, rank, other, -s) for rank, (s, other) in enumerate(found[:k], 1)]
    return out


def single(rows):
    return [(r[0], None if r[1] is None else [x if x is None else float(np.float32(x)) for x in r[1]], r[2]) for r in rows]


def test_neighbours_reach_brute_force(spark):
    rows = vectors(n=900) + unusable() + odd()
    df = table(spark, rows).repartition(5)
    got = neighbours.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0)
    assert got.columns == ["query_id", "rank", "id", "score"]
    got = sorted(map(tuple, got.collect()))
    want = sorted(neighbours_by_hand(single(rows), lambda i: i % 20 == 0))
    assert [r[:2] for r in got] == [r[:2] for r in want]  # every query has its five
    by_query = {}
    for q, _, _, s in want:
        by_query.setdefault(q, []).append(s)
    found = sum(r[3] >= min(by_query[r[0]]) - 1e-12 for r in got)
    assert found >= 0.97 * len(want)
    exact = {}  # one id has two vectors
    for q, _, i, s in neighbours_by_hand(single(rows), lambda i: i % 20 == 0, k=10**6):
        exact.setdefault((q, i), []).append(s)
    assert all(min(abs(s - e) for e in exact[q, i]) < 1e-12 for q, _, i, s in got)


def test_equal_vectors_tie_by_id(spark):
    rows = [(k, [1.0, 2.0, 3.0], 0) for k in range(0, 60, 2)] + [(1, [-1.0, 0.5, 0.0], 0)]
    got = neighbours.nearest(table(spark, rows).repartition(6), "vec_id", "embedding", F.col("vec_id") == 20).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(k, pytest.approx(1.0)) for k in (0, 2, 4, 6, 8)]


@pytest.mark.parametrize("rows, n", [([], 0), (unusable(), 0), ([(0, [1.0], 1)], 0), ([(0, [1.0], 1), (3, [-2.0], 1)], 1),
                                     ([(k, [1e38 * (-1) ** k, 3e38], 0) for k in range(8)], 5), ([(5, [1.0, 2.0], 0)] * 9, 0)])
def test_neighbours_of_small_tables(spark, rows, n):
    got = neighbours.nearest(table(spark, rows), "vec_id", "embedding", F.col("vec_id") == 0).collect()
    assert len(got) == n and all(r["query_id"] == 0 and r["id"] != 0 and -1.001 <= r["score"] <= 1.001 for r in got)


def test_antipodal_query_asks_until_it_has_enough(spark):
    rnd = np.random.default_rng(4)
    rows = [(k, [float(x) for x in np.array([1.0] * 8) + rnd.normal(scale=0.05, size=8)], 0) for k in range(1, 200)]
    rows.append((0, [-1.0] * 8, 0))
    got = neighbours.nearest(table(spark, rows), "vec_id", "embedding", F.col("vec_id") == 0).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("radius", [0, 3, 7, 8, 20, 64])
def test_probing_finds_every_code_within_the_radius_once(radius):
    rnd = np.random.default_rng(radius)
    found = rnd.integers(0, 256, (300, 8)).astype(np.uint8)
    asked = found[:40] ^ (1 << rnd.integers(0, 8, (40, 8))).astype(np.uint8) * (rnd.random((40, 8)) < 0.4)
    pairs = [np.stack(p) for p in neighbours.within_radius(asked, found, *neighbours.byte_index(found), radius)]
    pairs = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), int)
    want = np.stack(np.nonzero(neighbours.distances(asked, found) <= radius))
    assert sorted(map(tuple, pairs.T.tolist())) == sorted(map(tuple, want.T.tolist()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def recorded_plans(monkeypatch, module):
    plans = []

    def stored(df, *options):
        plans.append(plan_of(df))
        return common.stored(df, *options)

    monkeypatch.setattr(module, "stored", stored)
    return plans


def test_copies_of_queries_do_not_pass_through_the_driver(spark, monkeypatch):
    plans = recorded_plans(monkeypatch, neighbours)
    df = common.stored(table(spark, vectors()))
    found = neighbours.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0)
    assert found.count() == 5 * sum(r[0] % 20 == 0 for r in vectors())
    met = [plan for plan in plans if "Generate explode" in plan]
    assert met and all("SortMergeJoin" in plan and "Broadcast" not in plan for plan in met)


def test_blocks_are_stored_in_small_row_groups(spark):
    values = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.rand(3).cast("float") + k)
    packed = blocks.pack(spark.range(0, 100_000, 1, 1).select("id", values.alias("vector")), "vector")
    kept = common.stored(packed, blocks.FEW)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in kept.inputFiles()]
    sizes = [m.row_group(k).total_byte_size for m in files for k in range(m.num_row_groups)]
    assert sum(sizes) > 20 << 20 and max(sizes) < 10 << 20
    assert sorted(i for r in kept.select("id").collect() for i in r["id"]) == list(range(100_000))


def test_groups_follow_the_collection_not_the_partitions(spark):
    at_least = blocks.SPREAD * spark.sparkContext.defaultParallelism
    assert [blocks.groups_of(spark.range(n)) for n in (0, 3, at_least + 1, 100 * blocks.GROUP)] == [1, 3, at_least, max(100, at_least)]


# --- hard negatives ----------------------------------------------------------


def negatives_by_hand(rows, is_anchor, scale=256):
    kept = [(r[0], r[2], [math.floor(scale * x) for x in r[1]]) for r in rows
            if r[0] is not None and r[2] is not None and r[1] is not None and None not in r[1] and all(map(math.isfinite, r[1]))]
    out = []
    for a, (name, label, v) in enumerate(kept):
        if not is_anchor(name):
            continue
        others = sorted(((-sum(x * y for x, y in zip(v, w)), i, other) for j, (i, other, w) in enumerate(kept) if j != a),  # noqa: B905
                        key=lambda t: t[:2])
        for score, positive, _ in [t for t in others if t[2] == label][:5]:
            near = [t for t in others if t[2] != label and 80 * -score <= 100 * -t[0] <= 100 * -score]
            out += [(name, positive, rank, t[1], -score, -t[0]) for rank, t in enumerate(near[:5], 1)]
    return out


@pytest.mark.parametrize("rows", [
    vectors(n=420) + unusable() + odd(),
    [(k, [float(k % 3), 1.0], k % 2) for k in range(60)],  # ties everywhere
    [(k, [1e12 * (1 + k % 5), 3.0], k % 2) for k in range(40)],  # beyond exact doubles
    [(0, [1.0], 1)], [(0, [], 1), (1, [], 1), (2, [], 0)], unusable(), [],
], ids=["mixed", "ties", "huge", "one", "empty vectors", "unusable", "none"])
def test_negatives(spark, rows):
    df = table(spark, rows).repartition(5)
    got = negatives.mined(df, "vec_id", F.col("label"), "embedding", F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    top = (1 << 63) - 1
    want = [(*r[:4], min(r[4], top), min(r[5], top)) for r in negatives_by_hand(single(rows), lambda i: i % 10 == 0)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_anchors_and_their_positives_do_not_pass_through_the_driver(spark, monkeypatch):
    plans = recorded_plans(monkeypatch, negatives)
    df = common.stored(table(spark, vectors()))
    plans.append(plan_of(negatives.mined(df, "vec_id", F.col("label"), "embedding", F.col("vec_id") % 10 == 0)))
    first, last = (plan for plan in plans if "Generate explode" in plan)
    assert "SortMergeJoin" in first and "Broadcast" not in first
    # only numbers and ids of the anchors may be broadcast
    assert last.count("SortMergeJoin") == 3 and last.count("BroadcastExchange") <= 1


def test_tree_bounds_skip_rows_and_lose_none():
    rnd = np.random.default_rng(3)
    anchors = np.round(rnd.normal(size=(1, 6)) * 200 + rnd.normal(size=(40, 6)) * 4)
    rows = np.round(rnd.normal(size=(800, 6)) * 200)
    exact = anchors @ rows.T
    least = np.quantile(exact, 0.9, axis=1)
    scores, known = negatives.scores_in_windows(
        anchors, negatives.spanning_tree(anchors), rows, least, np.full(40, np.inf), np.ones((40, 800), bool))
    assert (exact[known] == scores[known]).all()
    assert known[exact >= least[:, None]].all() and known.mean() < 0.3


def test_spanning_tree_is_a_least_one():
    rnd = np.random.default_rng(9)
    points = rnd.normal(size=(60, 3))
    levels = negatives.spanning_tree(points)
    edges = np.concatenate([e for _, _, e in levels[1:]])
    assert sorted(np.concatenate([m for m, _, _ in levels])) == list(range(60))
    distance = np.sqrt(((points[:, None] - points) ** 2).sum(2))
    joined, total = {0}, 0.0
    while len(joined) < 60:
        length, new = min((distance[a, b], b) for a in joined for b in range(60) if b not in joined)
        joined.add(new)
        total += length
    assert edges.sum() == pytest.approx(total)
