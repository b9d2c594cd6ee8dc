"""Operators against brute force on small fixtures."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from lossledger.functions import money, text as tx
from lossledger.functions.predicates import status_in
from lossledger.operators import (
    aggregates,
    blocks,
    catalog,
    credit,
    filters,
    joins,
    matching,
    profile,
    search,
    windows,
)
from lossledger.sources import lookup, sinks


def skewed_rows():
    """One group holds most rows, one order value holds most of that group; NULLs included."""
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        group = "hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", None])
        value = 5 if rnd.random() < 0.5 else rnd.choice([None, *range(40)])
        rows.append((i, group, value))
    return rows


def brute_rank(rows, method, descending):
    out = {}
    for group in {r[1] for r in rows}:
        members = [r for r in rows if r[1] == group]
        sign = -1 if descending else 1
        members.sort(key=lambda r: (r[2] is None, sign * (r[2] or 0), r[0]))
        rank = dense = 0
        for n, r in enumerate(members, 1):
            if n == 1 or r[2] != members[n - 2][2]:
                rank, dense = n, dense + 1
            out[r[0]] = {"row_number": n, "rank": rank, "dense_rank": dense}[method]
    return out


@pytest.mark.parametrize("method", ["row_number", "rank", "dense_rank"])
@pytest.mark.parametrize("descending", [True, False])
def test_rank_all_with_hot_group(spark, method, descending):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k long, g string, v long").repartition(6)
    got = windows.rank_all(df, ["g"], "v", ["k"], method, descending)
    assert {r["k"]: r["rank"] for r in got.collect()} == brute_rank(rows, method, descending)


@pytest.mark.parametrize("method", ["row_number", "rank", "dense_rank"])
@pytest.mark.parametrize("groups", [["g"], []])
def test_rank_top_n_with_ties(spark, method, groups):
    rows = [(k, g if groups else None, v) for k, g, v in skewed_rows()]
    df = spark.createDataFrame(rows, "k long, g string, v long").repartition(6)
    got = windows.rank_top_n(df, groups, "v", 36, method, tie_break=("k",))
    want = {k: r for k, r in brute_rank(rows, method, True).items() if r <= 36}
    assert {r["k"]: r["rank"] for r in got.collect()} == want


def test_catalog_of_any_size(spark):
    df = spark.range(60_000).select(F.format_string("node %06d", "id").alias("c_name"))
    values = catalog.build_catalog({"t": (df, ["c_name"])})
    asked = df.filter("c_name in ('node 000007', 'node 059999')")
    got = matching.match_phrases(asked, "c_name", values, min_score=1.0).collect()
    assert {(r["phrase"], r["value"], r["score"]) for r in got} == {(x, x, 1.0) for x in ("node 000007", "node 059999")}


def test_an_empty_catalog_matches_nothing(spark):
    df = spark.createDataFrame([("a",)], "c_name string")
    none = catalog.build_catalog({"t": (df.filter("false"), ["c_name"])})
    assert matching.match_phrases(df, "c_name", none).count() == 0
    asked = spark.createDataFrame([("c_name", "a")], "col string, value string")
    assert matching.diagnose_empty(asked, none).first()["verdict"] == "not a category"


def test_rank_all_without_groups(spark):
    rows = [(k, None, v) for k, _, v in skewed_rows()]
    df = spark.createDataFrame([(k, v) for k, _, v in rows], "k long, v long")
    got = windows.rank_all(df, [], "v", ["k"])
    assert {r["k"]: r["rank"] for r in got.collect()} == brute_rank(rows, "row_number", True)


def test_checkpoint_goes_to_the_named_folder(spark, tmp_path):
    from lossledger.operators.lineage import cut_lineage

    # The setting itself can only be given at the start of a session, which then sets this.
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))
    for _ in range(2):
        assert cut_lineage(spark.range(5)).count() == 5
    (folder,) = (tmp_path / "shared").iterdir()
    assert len(list(folder.iterdir())) == 2


def test_new_and_resumed(spark):
    rows = [("new", "2026-02-01"), ("old", "2025-06-01"), ("old", "2026-01-15"), ("steady", "2025-12-20"),
            ("steady", "2026-01-10"), ("gone", "2024-01-01")]
    df = spark.createDataFrame(rows, "c string, d string").withColumn("d", F.col("d").cast("timestamp_ntz"))
    got = windows.new_and_resumed(df, "c", "d", "2026-01-01", "2026-04-01").collect()
    assert {(r["c"], r["kind"]) for r in got} == {("new", "new"), ("old", "resumed")}


def collapsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    rows = df.select("k", tx.collapse_cycles(F.col("t")).alias("o")).collect()
    return [r["o"] for r in sorted(rows, key=lambda r: r["k"])]


def test_cycles_by_hand(spark):
    cases = {"": "", "q": "q", "q\nQ \nq": "q", "x\ny\nx\ny\nz": "x\ny\nz", "x  y\n\nx y\n\nend": "x  y\n\nend",
             "one\ntwo\nthree": "one\ntwo\nthree", "\n\n": "\n\n"}
    assert collapsed(spark, list(cases)) == list(cases.values())


def test_a_repeated_block_of_at_most_twelve_lines_stands_once(spark):
    texts, wanted = [], []
    for size in (1, 2, 7, 12, 13):
        block = [f"line {k} of {size}" for k in range(size)]
        for times in (1, 2, 5):
            texts.append("\n".join(["head", *block * times, "tail"]))
            wanted.append("\n".join(["head", *block * (times if size > 12 else 1), "tail"]))
    assert collapsed(spark, texts) == wanted


def test_kept_lines_are_a_subsequence(spark):
    rnd = random.Random(3)
    texts = ["\n".join(rnd.choice(["m", "M ", "n", "", "o p"]) for _ in range(rnd.randint(1, 60))) for _ in range(200)]
    for text, kept in zip(texts, collapsed(spark, texts), strict=True):
        rest = iter(text.split("\n"))
        lines = kept.split("\n")
        assert all(line in rest for line in lines)
        norm = [" ".join(x.split()).lower() for x in text.split("\n")]
        if all(a != b for a, b in zip(norm, norm[1:], strict=False)) and len(set(norm)) == len(norm):
            assert kept == text


def test_repeated_neighbours(spark):
    text = "Раз.  Раз. Два.\nстрока\nСТРОКА \n\n\nстрока"
    df = tx.collapse_neighbours(spark.createDataFrame([(text,)], "t string"), "t", "o")
    assert tuple(df.select("o", "o_removed").first()) == ("Раз. Два.\nстрока\n\n\nстрока", 2)


def test_repeated_sections(spark):
    text = "начало\n# Итог\nа\n1. Вывод\nб\n## итог!\nв\n2. Другое\nг"
    df = tx.drop_repeated_sections(spark.createDataFrame([(text,)], "t string"), "t", "o")
    assert df.first()["o"] == "начало\n# Итог\nа\n1. Вывод\nб\n2. Другое\nг"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("raw, wanted", [
    (" 907.0 ", "907"), ("7000000000000000123.0", "7000000000000000123"), ("EVE-44120", "EVE-44120"),
    ("6.25e+3", "6250"), ("0.75", "0.75"),
])
def test_canonical_id(spark, raw, wanted):
    assert one(spark, tx.canonical_id(F.lit(raw))) == wanted


@pytest.mark.parametrize("amount, wanted", [
    (1_500_000, "1.5 млн"), (1_000_000, "1 млн"), (2_000_000_000, "2 млрд"), (2_000, "2 тыс"), (-1_500_000, "-1.5 млн"), (12, "12"),
])
def test_compact_money(spark, amount, wanted):
    assert one(spark, money.compact_money(F.lit(amount))) == wanted


def test_money_and_conditions(spark):
    assert float(one(spark, money.money_number(F.lit("1 234,50 ₽")))) == 1234.5
    assert float(one(spark, money.money_number(F.lit("нет")))) == 0
    found = one(spark, money.amount_conditions(F.lit("больше 1,5 млн и меньше 2 млрд, = 1.2.3")))
    assert [(c["op"], c["value"]) for c in found] == [(">", 1.5e6), ("<", 2e9)]
    assert one(spark, money.meets(F.lit(3.0), F.lit(">"), F.lit(2.0))) is True


def test_logistic(spark):
    for x in (-1.5, 0.0, 2.25):
        assert math.isclose(one(spark, tx.logistic(F.lit(x))), 1 / (1 + math.exp(-x)))


def test_profile_numbers(spark):
    # The ten largest of 10, 20 .. 150 are 60 .. 150.
    df = spark.createDataFrame([(i, 10.0 * i) for i in range(1, 16)], "k long, s double")
    row = profile.concentration(df, "s").first()
    assert (row["top_sum"], round(row["top_pct"], 1)) == (1050.0, 87.5)
    status = [(1, 7, 2, "Утверждён"), (2, 11, 3, "Утверждён "), (3, 45, 6, "Удалён"), (4, 21, 3, "удален"), (5, 9, 9, None)]
    df = spark.createDataFrame(status, "k long, s long, r long, st string")
    assert [float(x) for x in profile.deleted_block(df, "st", "s", "r").first()] == [2.0, 66.0, 9.0]
    assert {r[0]: r[1] for r in profile.status_groups(df, "st").collect()} == {"approved": 2, "deleted": 2}
    assert filters.status_group(df, "st").count() == 2
    assert filters.keep_if_any(df, status_in("st", ["нет такого"])).count() == 5


def test_channels_and_blocks(spark):
    rows = [(1, 100.0, "ЦА", "Внешний контролирующий орган"), (2, 200.0, "Сеть", "Клиент"), (3, 300.0, "TEC_11", "Служба")]
    df = spark.createDataFrame(rows, "k long, s double, b string, d string")
    row = profile.detection_channels(df, "d", "s").first()
    assert (row["client_cnt"], row["control_cnt"]) == (1, 1)
    assert {r["value"] for r in profile.blocks(df, "b", "s", "TEC_").collect()} == {"ЦА", "Сеть"}


def test_fanout_guard(spark):
    many = spark.createDataFrame([(70, 6), (80, 1), (70, 5), (70, 6)], "k long, x long")
    once = spark.createDataFrame([(60,), (70,), (80,), (90,)], "k long")
    assert joins.has_fanout(many, ["k"]) and not joins.has_fanout(once, ["k"])
    with pytest.raises(Exception, match="not unique"):  # the plan itself refuses, when it runs
        joins.guarded_join(once, many, ["k"]).collect()
    assert joins.guarded_join(once, many, ["k"], allow_fanout=True).count() == 6


def test_top_category_of_small_unique_table(spark):
    df = spark.createDataFrame([("a",), ("b",)], "c string")
    assert aggregates.top_category(df, "c").first()["label"] == "a"


def test_short_texts(spark):
    rows = [(1, " Сбой "), (2, "сбой"), (3, "карта"), (4, "  "), (5, None)]
    got = profile.text_frequency(spark.createDataFrame(rows, "k long, t string"), "t", "k").collect()
    assert [(r["display"], r["cnt"]) for r in got] == [("Сбой", 2), ("карта", 1)]


def test_row_limit():
    assert [lookup.row_limit(x) for x in (None, "x", 0, -5, 7, 10**9)] == [None] * 4 + [7, 10**9]
    assert [lookup.row_limit(x, 100) for x in (None, "x", 7)] == [100, 100, 7]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "сбой"), (2, "b")], "id long, t string")
    assert sinks.write_csv(df, str(tmp_path / "csv")) and sinks.write_parquet(df, str(tmp_path / "pq"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in back.collect()) == [("1", "сбой"), ("2", "b")]
    assert not sinks.write_csv(df.filter("id > 5"), str(tmp_path / "none")) and not (tmp_path / "none").exists()


# --- matching ---------------------------------------------------------------


@pytest.fixture(scope="module")
def values(spark):
    rows = ([("Северо-Горный филиал", "Степной филиал", "Штраф")] * 5 + [("Степной филиал", "Отдел", "Ошибка")] * 3
            + [("Лесной филиал", "Северо-Горный филиал", "П1227 Кредиты")])
    df = spark.createDataFrame(rows, "lvl_3 string, lvl_4 string, process string")
    return catalog.build_catalog({"incident": (df, ["lvl_3", "lvl_4", "process"])})


def hits(spark, values, phrase, **kw):
    df = spark.createDataFrame([(phrase,)], "p string")
    return sorted(matching.match_phrases(df, "p", values, **kw).collect(), key=lambda r: r["rn"])


def test_fuzzy_values(spark, values):
    exact = hits(spark, values, "северо-горный  Филиал")
    assert (exact[0]["col"], exact[0]["score"]) == ("lvl_3", 1.0)
    joined = hits(spark, values, "северогорный филиал")
    assert joined[0]["value"] == "Северо-Горный филиал" and joined[0]["score"] >= 0.9
    assert hits(spark, values, "Стпной филиал")[0]["value"] == "Степной филиал"
    assert hits(spark, values, "экозябра") == []


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def forms_by_hand(value):
    norm = " ".join(value.lower().split())
    return norm, re.sub("[^0-9a-zа-яё]+", "", norm), {t for t in norm.split(" ") if len(t) >= 2}


def score_by_hand(phrase, value):
    (qn, q, qt), (en, e, et) = forms_by_hand(phrase), forms_by_hand(value)
    if qn == en:
        return 1.0
    parts = [0.0]
    if q and e:
        if q in e:
            parts.append(0.72 + 0.25 * len(q) / len(e))
        elif e in q:
            parts.append(0.62 + 0.20 * len(e) / len(q))
        if abs(len(q) - len(e)) <= max(4, len(e) // 2):
            parts.append(1 - edit_distance(q, e) / max(len(q), len(e)))
    if qt & et:
        parts.append(0.55 + 0.4 * len(qt & et) / len(qt | et))
    return round(max(parts), 6)


def random_values(rnd, n, long=False):
    """Values of few letters with near copies, shared words, blanks, case and signs; some very long."""
    words = ["".join(rnd.choice("абвг1") for _ in range(rnd.randrange(1, 7))) for _ in range(25)]
    out = ["", " ", "-", "а", "аб", "Аб", "а-б"]
    while len(out) < n:
        value = rnd.choice([" ", "  ", "-"]).join(rnd.choice(words) for _ in range(rnd.randrange(1, 5)))
        if out and rnd.random() < 0.4:
            value = list(rnd.choice(out))
            for _ in range(rnd.randrange(1, 4)):
                value[rnd.randrange(len(value) + 1) : rnd.randrange(len(value) + 2)] = rnd.choice(["", "а", "г", "ю "])
            value = "".join(value)
        out.append(value.title() if rnd.random() < 0.2 else value)
    if long:
        base = "".join(rnd.choice("абвг ") for _ in range(60))
        out += [base, base[:50] + "ююю" + base[53:], base[10:], base * 3]
    return out


@pytest.mark.parametrize("least", [0.05, 0.4, 0.6, 0.75, 0.9, 1.0])
def test_indexes_find_all_that_brute_force_finds(spark, least):
    rnd = random.Random(int(least * 100))
    known, asked = random_values(rnd, 90, long=True), random_values(rnd, 60)
    asked += [rnd.choice(known) + rnd.choice(["", "а", " аб"]) for _ in range(30)] + known[-4:]
    catalog_df = spark.createDataFrame(
        [(rnd.choice(["c1", "c2"]), v, rnd.randrange(1, 4)) for v in known], "col string, value string, cnt long").repartition(3)
    entries = {}
    for r in catalog_df.collect():
        entries[r["col"], r["value"]] = max(r["cnt"], entries.get((r["col"], r["value"]), 0))
    filters_df = spark.createDataFrame([(rnd.choice(["c1", "c2", "c3", None]), p) for p in asked] + [("c1", None)], "asked_col string, phrase string").distinct()
    got = {(r["asked_col"], r["phrase"]): (r["hits"], r["own"]) for r in matching.with_hits(filters_df, catalog_df, least, top_k=5).collect()}
    assert len(got) == filters_df.count()
    for (column, phrase), (best, own) in got.items():
        want = [] if phrase is None else sorted(
            (-score_by_hand(phrase, v), -n, c, v) for (c, v), n in entries.items() if score_by_hand(phrase, v) >= least)
        assert [(-h["score"], -h["cnt"], h["col"], h["value"]) for h in best] == want[:5], phrase
        of_column = [w for w in want if w[2] == column]
        assert (own and (-own["score"], -own["cnt"], own["col"], own["value"])) == (of_column[0] if of_column else None)


def test_a_score_of_zero_names_no_pairs(spark, values):
    with pytest.raises(ValueError):
        hits(spark, values, "x", min_score=0.0)


def test_few_pairs_are_named_as_candidates(spark):
    """Names that share letters and endings, each asked for with a typing error."""
    rnd = random.Random(8)
    names = sorted({"".join(rnd.choice(["ка", "ле", "ми", "но", "ру", "сто", "вар", "ин"]) for _ in range(5)) for _ in range(600)})
    asked = [n[:4] + "ю" + n[5:] for n in names]
    forms = [matching._forms(spark.createDataFrame([(v,) for v in x], "v string"), "v") for x in (asked, names)]
    pairs = matching.candidates(*forms, 0.85)
    assert pairs.count() < len(names) ** 2 / 10
    scored = {(r["q_norm"], r["e_norm"]) for r in matching._scored(*forms, 0.85).collect()}
    assert scored == {(q, e) for q in asked for e in names if score_by_hand(q, e) >= 0.85}


def test_wrong_column_is_diagnosed(spark, values):
    asked = spark.createDataFrame(
        [("process", "%Северо-Горный филиал%"), ("lvl_3", "Лесной филиал"), ("lvl_3", "2025-01-01")], "col string, value string")
    got = {r["phrase"]: (r["verdict"], r["found_col"]) for r in matching.diagnose_empty(asked, values).collect()}
    assert got == {"Северо-Горный филиал": ("wrong column", "lvl_3"), "Лесной филиал": ("valid", None),
                   "2025-01-01": ("not a category", None)}


def test_grounded_texts(spark, values):
    rows = [(1, "Выгрузи по Северо-Горному филиалу за 2025"), (2, "отчёт по процессу П1227"), (3, "бессмысленная чушь"),
            (4, "данные СГФ за год"), (5, "")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = matching.ground_texts(df, "k", "t", values, {"СГФ": "Северо-Горный филиал"}).collect()
    found = {(r["k"], r["value"]) for r in got}
    assert (2, "П1227 Кредиты") in found and (4, "Северо-Горный филиал") in found
    assert not {k for k, _ in found} & {3, 5}


# --- search -----------------------------------------------------------------


def test_bm25_against_formula(spark):
    docs = ["loss of card", "card card stolen by night", "late answer", "card lost"]
    df = spark.createDataFrame(list(enumerate(docs)), "d long, t string")
    queries = spark.createDataFrame([(1, "lost card"), (2, "nothing here")], "query_id long, q string")
    got = {r["d"]: r["score"] for r in search.bm25(df, "d", "t", queries, "q").collect()}
    words = [d.split() for d in docs]
    avg = sum(map(len, words)) / len(words)
    want = {}
    for i, w in enumerate(words):
        score = 0.0
        for term in ("lost", "card"):
            n, f = sum(term in x for x in words), w.count(term)
            idf = math.log(1 + (len(docs) - n + 0.5) / (n + 0.5))
            score += idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(w) / avg))
        if score:
            want[i] = score
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)


def bm25_brute(docs, queries, k):
    """Ranks by the formula; rows with the same id and length are one, other rows of an id add up."""
    words = [(d, None if t is None else t.split()) for d, t in docs]
    avg = sum(len(w) for _, w in words if w is not None) / sum(w is not None for _, w in words)
    tf = {}
    for d, w in words:
        for term in w or ():
            tf[d, len(w), term] = tf.get((d, len(w), term), 0) + 1
    out = {}
    for q, text in queries:
        points = {}
        for term in set(text.split()):
            n = sum(key[2] == term for key in tf)
            for (d, length, _), f in ((key, f) for key, f in tf.items() if key[2] == term):
                idf = math.log(1 + (len(docs) - n + 0.5) / (n + 0.5))
                points[d] = points.get(d, 0) + round(idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * length / avg)) * 1e6)
        order = sorted(points, key=lambda d: (-points[d], d is not None, d or 0))[:k]
        out |= {(q, at): (d, points[d] / 1e6) for at, d in enumerate(order, 1)}
    return out


@pytest.mark.parametrize("sizes", [(1_024, 400_000, 256), (5, 40, 3)])
def test_bm25_makes_no_row_per_query_and_document(spark, monkeypatch, sizes):
    rnd = random.Random(3)
    for name, size in zip(("DOC_ROWS", "DOC_WORDS", "PART_ROWS"), sizes):
        monkeypatch.setattr(search, name, size, raising=False)
    docs = [(rnd.choice([i, i, i, 7, None]), rnd.choice([None, "", *[" ".join(rnd.choices("a b c d e f g".split(), k=rnd.randrange(1, 9)))] * 8]))
            for i in range(600)]
    queries = [(q, " ".join(rnd.choices("a b c d e f g z".split(), k=3))) for q in range(40)]
    handed = []
    ranked = search._ranked
    monkeypatch.setattr(search, "_ranked", lambda scored, doc, k: handed.append(scored.count()) or ranked(scored, doc, k))
    df = spark.createDataFrame(docs, "d long, t string").repartition(4)
    got = search.bm25(df, "d", "t", spark.createDataFrame(queries, "query_id long, q string"), "q", k=3).collect()
    want = bm25_brute(docs, queries, 3)
    assert {(r["query_id"], r["rank"]): (r["d"], r["score"]) for r in got} == want
    assert handed[0] <= 40 * 3 * 16  # best of every task, of about 15,000 pairs


def by_rank(rows, query):
    return [(r["d"], r["score"]) for r in sorted((r for r in rows if r["query_id"] == query), key=lambda r: r["rank"])]


@pytest.mark.parametrize("cosine", [False, True])
def test_dense_against_numpy(spark, cosine):
    rnd = np.random.default_rng(5)
    vectors, asked = rnd.normal(size=(400, 8)), rnd.normal(size=(23, 8))
    vectors[100:140] = vectors[3]  # ties within and across blocks
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "d long, v array<double>").repartition(5)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "query_id long, vector array<double>")
    got = search.dense_top_k(df, "d", "v", queries.repartition(3), k=7, cosine=cosine, query_rows=4).collect()
    for i, q in enumerate(asked):
        scores = vectors @ q
        if cosine:
            scores = scores / np.linalg.norm(vectors, axis=1) / np.linalg.norm(q)
        order = sorted(range(400), key=lambda j: (-round(float(scores[j]), 6), j))[:7]
        assert by_rank(got, i) == [(j, pytest.approx(scores[j], abs=2e-6)) for j in order]


def test_dense_with_a_threshold_text_ids_and_missing_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.5]), ("c", None), ("d", [0.0, 0.0]), ("e", [2.0, 2.0])]
    df = spark.createDataFrame(rows, "d string, v array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None), ("low", [-1.0, 0.0])], "query_id string, vector array<float>")
    got = search.dense_top_k(df, "d", "v", queries, k=9, threshold=0.5).collect()
    assert by_rank(got, "q") == [("e", 2.0), ("a", 1.0), ("b", 0.5)] and len(got) == 3
    assert search.dense_top_k(df.filter("d > 'z'"), "d", "v", queries, k=9).count() == 0
    assert search.dense_top_k(df, "d", "v", queries.filter("query_id > 'z'"), k=9).count() == 0


def test_many_queries_meet_every_document_once(spark):
    df = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "d long, v array<double>").repartition(3)
    queries = spark.range(1_200).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    got = search.dense_top_k(df, "d", "v", queries, k=2).collect()
    # Ties at the highest score: the smallest ids.
    assert len(got) == 2 * 1_200 and {r["d"] for r in got} == {4, 9}


def test_running_best_merges_like_one_sort():
    rnd = np.random.default_rng(6)
    query, score, ident = rnd.integers(0, 30, 400_000), rnd.integers(0, 50, 400_000), rnd.permutation(400_000)
    running = blocks.RunningBest(5)
    for part in np.array_split(np.arange(400_000), 40):
        running.add(query[part], score[part], ident[part])
    kept = blocks.best_k(query, score, ident, 5)
    for have, want in zip(running.taken(), (query[kept], score[kept], ident[kept]), strict=True):
        assert (have == want).all()
    assert len(running.parts) < 40 and len(kept) == 150


def test_a_query_without_words_keeps_every_row(spark):
    df = spark.createDataFrame([(i, "role", "text") for i in range(20)], "m long, a string, b string")
    assert search.keyword_overlap(df, "m", "a", "b", "is of - a", k=15).count() == 20
    assert search.keyword_overlap(df, "m", "a", "b", "unheard", k=15).count() == 15


def test_cut_rules(spark):
    rows = [(1, i, s, i) for i, s in enumerate([0.9, 0.6, 0.4], 1)] + [(2, i, 0.1, i) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "query_id long, d long, score double, rank int")
    kept = [(r[0], r[1]) for r in search.cut(df, threshold=0.5, default_k=2).select("query_id", "d").collect()]
    assert sorted(kept) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert search.cut(df, top_k=1).count() == 2


# --- credit -----------------------------------------------------------------


def case(**kw):
    base = dict(client="2", risk="DRP-10023", deviation="1", credit_amount=1000, debt_now=100, overdue_now=20,
                interest_now=10, interest_overdue_now=5, reserve_now=0.5, reserve_then=0.25, factor_codes=["1", "4"],
                overstatement=7, withdrawn_share=40, withdrawn_amount=90, pledge_state="1", pledge=50)
    return {**base, **kw}


CASES = [
    (case(client="1", risk="DRP-10102"), (60, 7.5, None)),
    (case(client="1", risk="DRP-10102", reserve_then=0.5), (None, None, 1000)),
    (case(client="3"), (2400, 300, None)),
    (case(client="3", withdrawn_share=60), (52.2, 6.525, None)),
    (case(client="3", reserve_then=0.5), (None, None, 90)),
    (case(client="3", risk="DRP-10024", deviation="37"), (45, 5.625, None)),
    (case(client="3", risk="DRP-10024", deviation="35", reserve_then=0.9), (None, None, 7)),
    (case(client="3", risk="DRP-10027"), (30, 20, None)),
    (case(client="3", risk="DRP-10027", pledge=20), (None, None, 20)),
    (case(client="3", risk="DRP-10027", pledge_state="2"), (None, None, None)),
    (case(), (1980, 247.5, None)),
    (case(reserve_then=0.5), (None, None, 33000)),
    (case(risk="DRP-10024", deviation="6"), (53.4, 6.675, None)),
    (case(risk="DRP-10024", deviation="40", overstatement=40), (30, 10, None)),
    (case(risk="DRP-10024", deviation="40", overstatement=None), (None, None, None)),
    (case(risk="DRP-10047", deviation="45"), (30, 3.75, None)),
    (case(risk="DRP-10027"), (30, 50, None)),
    (case(risk="DRP-10027", pledge=20), (None, None, None)),
]


def test_credit_branches(spark):
    names = list(case())
    kinds = {"factor_codes": "array<string>", "withdrawn_share": "int"}
    text = {"client", "risk", "deviation", "pledge_state"}
    schema = ", ".join(
        f"{n} {kinds.get(n, 'string' if n in text else 'double')}" for n in names)
    rows = [(i, *[float(c[n]) if isinstance(c[n], (int, float)) and n not in kinds else c[n] for n in names])
            for i, (c, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, f"i long, {schema}")
    money_columns = [n for n in names if n not in kinds and n not in text]
    df = df.withColumns({n: F.col(n).cast("decimal(18,4)") for n in money_columns})
    got = {r["i"]: tuple(None if x is None else round(float(x), 4) for x in (r["direct"], r["indirect"], r["potential"]))
           for r in credit.losses(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_weights_as_percent(spark):
    assert one(spark, credit.factor_weight(F.array(F.lit("1"), F.lit("2"), F.lit("9")))) == 48


def test_normal_forms_over_all_characters(spark):
    """Every character, by Python's rules; the classes are written as ranges, which must miss none."""
    every = [chr(n) for n in range(1, 0x11000) if not 0xD800 <= n < 0xE000]
    df = spark.createDataFrame([(f"a{ch}b",) for ch in every], "t string").select(
        F.lower("t").alias("low"), tx.norm(F.col("t")).alias("norm"), tx.tight(F.col("t")).alias("tight"),
        F.size(tx.words_of_normal(tx.norm(F.col("t")))).alias("n"), F.size(tx.token_set(F.col("t"))).alias("same"))
    for r in df.collect():
        assert r["norm"] == " ".join(r["low"].split()) and r["n"] == r["same"]
        assert r["tight"] == "".join(x for x in r["low"] if x in "0123456789abcdefghijklmnopqrstuvwxyz" or "а" <= x <= "я" or x == "ё")


def test_normal_forms_take_a_text_apart_once(spark, capsys):
    """The normal form is worked out in one step and only read in the next; the slow class is gone."""
    entry_points.queries()["h8_normal_forms"](spark, "/root/testdata/sf0.001").explain(True)
    physical = capsys.readouterr().out.split("== Physical Plan ==")[1]
    assert physical.count("regexp_replace(") == 2 and "[^0-9a-z" not in physical
