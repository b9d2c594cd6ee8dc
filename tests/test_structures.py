"""Dossiers, guarded joins, stored snapshots, published files, sketches and category profiles."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from lossledger.operators import catalog, joins, profile, snapshots
from lossledger.sources import sinks

# --- dossiers ------------------------------------------------------------------


def dossier_rows(seed):
    """One incident holds a third of all children; ties, nulls and keys without an incident."""
    rnd = random.Random(seed)
    incidents = [(k, f"S{k}") for k in range(12)]
    children = {}
    for name in ("impacts", "actions"):
        rows = [(7 if rnd.random() < 0.33 else rnd.choice([*range(9), None, 99]), rnd.choice([1, 2, 3, None]), rnd.choice("abc"))
                for _ in range(200)]
        children[name] = rows
    return incidents, children


@pytest.mark.parametrize("page", [1, 4, 1000])
def test_nested_dossier_against_brute_force(spark, page):
    incidents, children = dossier_rows(page)
    frames = {n: (spark.createDataFrame(rows, "k long, at int, what string").repartition(3), ["at"]) for n, rows in children.items()}
    found = joins.nested_dossier(spark.createDataFrame(incidents, "k long, sid string"), frames, "k", page)
    assert found.columns == ["k", "sid", "page", "impacts", "actions"]
    got = {(r["k"], r["page"]): (r["sid"], [[tuple(x) for x in r[n]] for n in children]) for r in found.collect()}
    want = {}
    for k, sid in incidents:
        own = [sorted(((a, w) for key, a, w in children[n] if key == k), key=lambda r: (r[0] is None, r[0] or 0, r[1])) for n in children]
        pages = max(1, *(-(-len(o) // page) for o in own))
        for at in range(pages):
            want[k, at] = (sid, [o[at * page : (at + 1) * page] for o in own])
    assert got == want


@pytest.mark.parametrize("hot", [0, 15, 1000])
def test_dossiers_of_large_and_small_keys(spark, hot):
    incidents, children = dossier_rows(5)
    incidents.append((None, "S"))
    frames = {n: (spark.createDataFrame(rows, "k long, at int, what string").repartition(3), ["at"]) for n, rows in children.items()}
    found = joins.nested_dossier(spark.createDataFrame(incidents, "k long, sid string"), frames, "k", 3, hot=hot).collect()
    for k, sid in incidents:
        pages = sorted((r for r in found if r["sid"] == sid), key=lambda r: r["page"])
        assert [r["page"] for r in pages] == list(range(len(pages)))
        for n in children:
            own = sorted(((a, w) for key, a, w in children[n] if key is not None and key == k), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            assert [tuple(x) for r in pages for x in r[n]] == own and all(len(r[n]) <= 3 for r in pages)


def test_dossier_rows_are_shuffled_once(spark, capsys):
    """Whatever the page: one shuffle by key for each kind, and one for the incidents."""
    incidents, children = dossier_rows(5)
    frames = {n: (spark.createDataFrame(rows, "k long, at int, what string"), ["at"]) for n, rows in children.items()}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins.nested_dossier(spark.createDataFrame(incidents, "k long, sid string"), frames, "k", 3).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert capsys.readouterr().out.count("Exchange ") == 3


def test_a_dossier_without_children_is_empty(spark):
    none = spark.createDataFrame([], "k long, at int, what string")
    row = joins.nested_dossier(spark.createDataFrame([(1, "S")], "k long, sid string"), {"impacts": (none, ["at"])}, "k").first()
    assert (row["page"], row["impacts"]) == (0, [])


# --- guarded joins -------------------------------------------------------------


def test_a_repeated_key_fails_when_the_join_runs(spark):
    left = spark.range(5).withColumnRenamed("id", "k")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    joined = joins.guarded_join(left, right, ["k"])  # no job yet
    with pytest.raises(Exception, match="not unique"):
        joined.collect()
    assert joins.guarded_join(left, right, ["k"], allow_fanout=True).count() == 6
    ok = joins.guarded_join(left, right.filter("v <> 'b'"), ["k"]).orderBy("k").collect()
    assert [tuple(r) for r in ok] == [(0, None), (1, "a"), (2, "c"), (3, None), (4, None)]


def test_the_guard_adds_no_job_and_keeps_columns(spark):
    right = spark.createDataFrame([(1, "x", 2.0)], "k long, v string, w double").select("v", "k", "w")
    only_key = right.select("k")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    guarded = joins.guarded_join(spark.range(3).withColumnRenamed("id", "k"), right, ["k"], "inner")
    assert guarded.columns == ["k", "v", "w"] and len(tracker.getJobIdsForGroup(None)) == before
    assert guarded.count() == 1
    assert joins.guarded_join(spark.range(3).withColumnRenamed("id", "k"), only_key, ["k"], "inner").count() == 1


@pytest.mark.parametrize("how, allow, want", [("left", True, (5, 6, True)), ("inner", True, (5, 3, False)), ("outer", True, (5, 7, True))])
def test_growth_is_told(spark, how, allow, want):
    left = spark.range(5).withColumnRenamed("id", "k")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")] + ([(9, "d")] if how == "outer" else []), "k long, v string")
    joined, growth = joins.watched_join(left, right, ["k"], how, allow)
    joined.collect()
    assert tuple(growth().values()) == want


# --- snapshots -----------------------------------------------------------------


def test_snapshots_are_kept_apart_and_replaced(spark, tmp_path):
    root = str(tmp_path / "profiles")
    one = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k long, v string")
    two = spark.createDataFrame([("1", "a", 1.0), ("2", "b", None), ("3", "b", None)], "k string, v string, w double")
    snapshots.save({"t": (one, ["v"])}, root, "2024-01")
    snapshots.save({"t": (one, ["v"])}, root, "2024-02")
    assert snapshots.schema_drift(spark, root, "2024-01", "2024-02").isEmpty()
    assert snapshots.value_drift(spark, root, "2024-01", "2024-02").isEmpty()
    snapshots.save({"t": (two, ["v"])}, root, "2024-02")  # written again: only this snapshot changes
    drift = {r["col"]: (r["change"], r["type_before"], r["type_after"], r["filled_before"], r["filled_after"], r["same_schema"])
             for r in snapshots.schema_drift(spark, root, "2024-01", "2024-02").collect()}
    assert drift == {"k": ("type", "bigint", "string", 100.0, 100.0, False), "v": ("fill", "string", "string", 66.67, 100.0, False),
                     "w": ("new", None, "double", None, 33.33, False)}
    back = {r["col"]: r["change"] for r in snapshots.schema_drift(spark, root, "2024-02", "2024-01").collect()}
    assert back["w"] == "lost"
    values = {r["value"]: (r["change"], r["cnt_before"], r["cnt_after"]) for r in snapshots.value_drift(spark, root, "2024-01", "2024-02").collect()}
    assert values == {"a": ("count", 2, 1), "b": ("new", None, 2)}
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.schema_drift(spark, root, "2024-01", "2031-01")


def test_the_fingerprint_tells_types_not_order(spark):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    assert snapshots.fingerprint(df) == snapshots.fingerprint(df.select("v", "k"))
    assert snapshots.fingerprint(df) != snapshots.fingerprint(df.withColumn("k", F.col("k").cast("int")))


# --- published CSV -------------------------------------------------------------


def test_published_csv_comes_back_as_it_was(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(1, 'say "no"\nand go', 1.5, True), (2, "", None, None), (3, None, -0.1, False), (4, "\\N, ;\t\\", 0.0, True), (5, "сбой\r\nдва", 2.0, True)]
    df = spark.createDataFrame(rows, "k long, t string, x double, b boolean").repartition(2)
    sinks.publish_csv(df.limit(1), path)
    sinks.publish_csv(df, path)
    back = sinks.read_published_csv(spark, path)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_a_failed_export_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.publish_csv(spark.range(3), path)
    with pytest.raises(Exception, match="boom"):
        sinks.publish_csv(spark.range(3).select(F.raise_error(F.lit("boom")).cast("string").alias("id")), path)
    assert sinks.read_published_csv(spark, path).count() == 3
    sinks.publish_csv(spark.range(0), path)
    assert sinks.read_published_csv(spark, path).count() == 0


# --- frequent values, sketches, categories -------------------------------------


@pytest.mark.parametrize("tracked", [4, 16, 4000])
def test_frequent_values_are_exact_whatever_the_sketch(spark, tracked):
    rnd = random.Random(tracked)
    rows = [(rnd.choice(["hot", "hot", f"v{int(rnd.paretovariate(0.7))}"]), f"u{rnd.randrange(900)}", rnd.choice(["a", "b", None]), None)
            for _ in range(4000)]
    df = spark.createDataFrame(rows, "skewed string, even string, few string, none string").repartition(4)
    found = defaultdict(list)
    for r in catalog.frequent_values(df, df.columns, "t", n=5, tracked=tracked).collect():
        found[r["col"]].append((-r["cnt"], r["value"]))
    for at, column in enumerate(df.columns):
        counts = Counter(r[at] for r in rows if r[at] is not None)
        assert sorted(found[column]) == sorted((-n, v) for v, n in counts.items())[:5]


def test_the_proof_of_frequent_values(spark):
    """Column a: the rest is too small. b: a rest that might hold another frequent value. c: all tracked."""
    counts = spark.createDataFrame([("a", "x", 50), ("a", "y", 40), ("b", "x", 50), ("b", "y", 10), ("c", "x", 3)], "col string, value string, cnt long")
    candidates = spark.createDataFrame(
        [("a", 100, "x", 50), ("a", 100, "y", 40), ("b", 100, "x", 50), ("b", 100, "y", 30), ("c", 3, "x", 3), ("d", 0, None, None)],
        "col string, rows long, value string, estimate long")
    got = {r["col"]: r["proven"] for r in catalog.proven_columns(counts, candidates, 2, 1000).collect()}
    assert got["a"] and got["c"] and got["d"]
    assert {r["col"]: r["proven"] for r in catalog.proven_columns(counts, candidates, 2, 2).collect()}["b"] is False


def test_united_sketches_estimate_the_whole(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("v"), F.lit("x").alias("one"), (F.col("id") % 7).alias("p"))
    parts = catalog.cardinality_sketches(df, ["v", "one"], F.col("p"))
    assert parts.count() == 14
    whole = {r["col"]: r for r in catalog.united(catalog.cardinality_sketches(df, ["v", "one"], F.lit(0)), "t").collect()}
    for r in catalog.united(parts, "t").collect():
        exact = 20_000 if r["col"] == "v" else 1
        assert abs(r["distinct_approx"] - exact) <= 0.05 * exact and r["high_card"] == (exact > 800)
        assert abs(whole[r["col"]]["distinct_approx"] - r["distinct_approx"]) <= 0.03 * exact


def test_categories_are_told_by_data_and_marks(spark):
    rows = [(f"c{k % 3}", f"n{k}", "s" if k < 2 else None, "x" * 200, f"a{k % 2}", k, f"t{k % 2}") for k in range(300)]
    df = spark.createDataFrame(
        rows, "risk_type string, unit_name string, rare_status string, long_name string, part_id string, level_code int, free string")
    found = {r["col"]: r for r in catalog.category_profile(df, "t").collect()}
    assert found["risk_type"]["filled_pct"] == 100 and found["risk_type"]["marks"] == ["category"] and found["part_id"]["marks"] == ["other"]
    assert found["rare_status"]["filled_pct"] == 0.67 and found["free"]["marks"] == [] and "level_code" not in found
    # too many values; too rarely filled; prose; a key; no text; no mark
    assert catalog.enum_candidates(df) == ["risk_type"]
    assert catalog.enum_candidates(df.select("level_code")) == [] and catalog.enum_candidates(df.limit(0)) == []


# --- text frequency ------------------------------------------------------------


@pytest.mark.parametrize("bound", [0, 10_000])
def test_text_frequency_with_ties_behind_the_beginning(spark, monkeypatch, bound):
    monkeypatch.setattr(profile, "MAY_BE_SHOWN", bound)
    rnd = random.Random(1)
    texts = [rnd.choice(["A", "a ", "B", "ü", "", None, "  "]) for _ in range(60)]
    texts += ["same beginning " * 20 + str(k % 40) for k in range(50)]
    rows = list(enumerate(texts))
    got = profile.text_frequency(spark.createDataFrame(rows, "i long, t string").repartition(4), "t", "i", top=20).collect()
    counted, shown = Counter(), {}
    for _, t in rows:
        if t and t.strip():
            counted[t.strip().lower()] += 1
            shown.setdefault(t.strip().lower(), t.strip())
    want = sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:20]
    assert [(r["key"], r["cnt"], r["display"]) for r in got] == [(k, n, shown[k]) for k, n in want]
    assert got[0]["pct"] == pytest.approx(100 * want[0][1] / sum(counted.values()), abs=1e-3)


# --- largest losses ------------------------------------------------------------


def test_an_incident_without_a_document_keeps_its_place(spark):
    """The 30 largest of all incidents are looked at, those without a document among them."""
    path = "/root/testdata/sf0.001"
    orders = sorted(spark.read.parquet(f"{path}/orders.parquet").select("o_totalprice", "o_orderkey").collect(),
                    key=lambda r: (-round(r[0], 2), f"EVE-{r[1]}"))
    described = {r[0] for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id").collect()}
    want = {(f"EVE-{r[1]}", at) for at, r in enumerate(orders[:30], 1) if r[1] in described}
    assert 0 < len(want) < 30
    assert {(r["incdnt_sid"], r["rn"]) for r in entry_points.queries()["g43_largest_described"](spark, path).collect()} == want
