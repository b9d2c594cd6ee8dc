"""Reports against brute force on random rows, and the rules of a specification."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lossledger.plans.report import Funnel, build_report, resolve_period, with_fill_rates
from lossledger.plans.spec import ChildJoin, Metric, SourceModel, range_stage, spec_from_dict, use_child_money, validate

UNITS, SHIFTS, KINDS = ["Цех", "Склад", "Порт", "Причал"], ["ночь", "день", "вечер"], ["своя", "чужая", "общая"]
MODEL = SourceModel(
    columns=("incdnt_id", "incdnt_entry_dt", "unit", "shift", "size", "incdnt_sum"),
    children={"fin_impact": ("incdnt_id", "amount", "kind"), "recovery": ("incdnt_id", "returned")},
    filled_pct={"incdnt_sum": 1.5},
    money={"incdnt_sum": ChildJoin("fin_impact", (Metric("amount", "sum", "charged", {"kind": "своя"}),))},
)


class World:
    """Random incidents with impacts and returns; some have none, some have many."""

    def __init__(self, spark, seed):
        rnd = random.Random(seed)
        begin = datetime.datetime(2023, 1, 1)
        self.incidents = [
            (k, begin + datetime.timedelta(hours=rnd.randrange(24 * 730)), rnd.choice(UNITS), rnd.choice([*SHIFTS, None]), rnd.randrange(1, 9))
            for k in range(160)
        ]
        self.impacts = [(3 if rnd.random() < 0.33 else rnd.randrange(180), float(rnd.randrange(0, 200)), rnd.choice(KINDS)) for _ in range(700)]
        self.returns = [(rnd.randrange(180), float(rnd.randrange(0, 60))) for _ in range(150)]
        self.tables = {
            "incident": spark.createDataFrame(
                self.incidents, "incdnt_id long, incdnt_entry_dt timestamp_ntz, unit string, shift string, size int").repartition(3),
            "fin_impact": spark.createDataFrame(self.impacts, "incdnt_id long, amount double, kind string").repartition(3),
            "recovery": spark.createDataFrame(self.returns, "incdnt_id long, returned double"),
        }
        # What is asked: units or shifts, sizes, numbers of kinds, cases of a group, groups of a part of the year.
        self.unit, self.shift = rnd.choice(UNITS), rnd.choice(SHIFTS)
        self.size, self.kinds, self.cases = rnd.choice([0, 2, 5]), rnd.choice([1, 1, 2, 3]), rnd.choice([0, 0, 1, 2, 50])
        self.part, self.top = rnd.choice(["quarter", "year"]), rnd.choice([1, 2, 10])

    def spec(self):
        return {
            "source": {"table": "incident", "joins": [
                {"table": "fin_impact", "on": "incdnt_id", "pre_aggregate": {"agg": {"kind": {"fn": "nunique", "as": "kinds"}}}},
                {"table": "recovery", "on": "incdnt_id", "pre_aggregate": {"agg": {"returned": {"fn": "sum", "as": "back"}}}},
            ]},
            "filters": [
                {"kind": "any_of", "options": [{"unit": self.unit}, {"shift": self.shift}]},
                {"kind": "range", "column": "size", "op": "gt", "value": self.size},
                {"kind": "range", "column": "kinds", "op": "gte", "value": self.kinds},
                {"kind": "range", "column": "cases", "op": "gt", "value": self.cases},
            ],
            "derive": [{"source": "incdnt_entry_dt", "new_column": "part", "op": self.part}],
            "aggregate": {"group_by": ["part", "unit"], "metrics": [
                {"as": "cases", "source": "incdnt_id", "fn": "count"}, {"as": "weight", "source": "size", "fn": "sum"},
                {"as": "returned_all", "source": "back", "fn": "sum"}]},
            "derived_metrics": [{"as": "open", "expr": {"op": "sub", "left": "weight", "right": "returned_all"}}],
            "window": [{"partition_by": ["part"], "order_by": "open", "top_n": self.top}],
            "sort": [{"by": "part", "desc": False}, {"by": "rank", "desc": False}],
            "select": ["part", "rank", "unit", "cases", "weight", "returned_all", "open"],
        }

    def by_hand(self):
        """Rows of the report and the funnel of its stages."""
        kinds, back = defaultdict(set), defaultdict(float)
        for k, _, kind in self.impacts:
            kinds[k].add(kind)
        for k, amount in self.returns:
            back[k] += amount
        chosen = [r for r in self.incidents if (r[2] == self.unit or r[3] == self.shift) and r[4] > self.size]
        ranged = [r for r in chosen if len(kinds[r[0]]) >= self.kinds]
        groups = defaultdict(list)
        for r in ranged:
            part = str(r[1].year) if self.part == "year" else f"{r[1].year}-Q{(r[1].month + 2) // 3}"
            groups[part, r[2]].append(r)
        kept = []
        for (part, unit), own in groups.items():
            if len(own) > self.cases:
                weight, returned = sum(r[4] for r in own), sum(back[r[0]] for r in own)
                kept.append((part, returned - weight, unit, len(own), weight, returned))
        rows, places = [], defaultdict(int)
        for part, negative, unit, n, weight, returned in sorted(kept):
            places[part] += 1
            if places[part] <= self.top:
                rows.append((part, places[part], unit, n, weight, returned, -negative))
        return rows, [len(chosen), len(chosen), len(ranged), len(kept), len(rows)]


def plain(rows):
    return [tuple(str(x) if k == 0 else x for k, x in enumerate(r)) for r in rows]


@pytest.mark.parametrize("seed", range(8))
def test_reports_against_brute_force(spark, seed):
    world = World(spark, seed)
    want, counts = world.by_hand()
    spec = world.spec()
    found = build_report(world.tables, spec, MODEL)
    assert found.columns == spec["select"] and plain(found.collect()) == want
    funnel = Funnel()
    watched = build_report(world.tables, spec, MODEL, funnel)
    assert plain(watched.collect()) == want
    assert funnel.rows() == list(zip(["source", "join", "ranges", "aggregate", "export"], counts, strict=True))


def test_the_seeds_reach_empty_and_full_reports(spark):
    sizes = {len(World(spark, seed).by_hand()[0]) for seed in range(8)}
    assert 0 in sizes and max(sizes) > 6


@pytest.mark.parametrize("text, rows", [("январь 2023", 1), ("как получится", None)])
def test_a_required_period_is_read_or_refused(spark, text, rows):
    day = datetime.datetime
    df = spark.createDataFrame([(1, day(2023, 1, 31, 23, 59)), (2, day(2023, 2, 1))], "incdnt_id long, incdnt_entry_dt timestamp_ntz")
    spec = {"source": {"table": "incident"}, "filters": [{"kind": "period", "text": text, "column": "incdnt_entry_dt", "required": True}]}
    if rows is None:
        with pytest.raises(ValueError, match="not recognised"):
            build_report({"incident": df}, spec)
        spec["filters"][0]["required"] = False
        assert build_report({"incident": df}, spec).count() == 2
    else:
        assert build_report({"incident": df}, spec).count() == rows


def test_filters_reach_the_scan(spark, tmp_path):
    world = World(spark, 1)
    path = str(tmp_path / "incident")
    world.tables["incident"].write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = build_report({**world.tables, "incident": spark.read.parquet(path)}, world.spec(), MODEL)
    text = plan._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(size" in text and "Or(" in text


def test_sparse_money_is_replaced_by_child_sum():
    spec = spec_from_dict({"filters": [{"kind": "range", "column": "incdnt_sum", "op": "gt", "value": 5}]})
    better = use_child_money(spec, MODEL)
    assert better.ranges[0].column == "charged" and better.joins[0].table == "fin_impact"
    validate(better, MODEL)


@pytest.mark.parametrize("parts, message", [
    ({"source": {"table": "incident", "joins": [{"table": "fin_impact", "on": "incdnt_id"}]}}, "pre-aggregate"),
    ({"filters": [{"kind": "fuzzy", "column": "unit"}]}, "filter kind"),
    ({"select": ["no_such_column"]}, "select"),
    ({"derived_metrics": [{"as": "x", "expr": {"op": "pow", "left": "cases", "right": 2}}]}, "derived metric"),
    ({"filters": [{"kind": "range", "column": "nowhere", "op": "gt", "value": 1}]}, "unknown column"),
])
def test_bad_specifications(spark, parts, message):
    with pytest.raises(ValueError, match=message):
        validate(spec_from_dict({**World(spark, 0).spec(), **parts}), MODEL)


def test_range_stages(spark):
    spec = spec_from_dict(World(spark, 0).spec())
    assert [range_stage(spec, c, MODEL.columns) for c in ("size", "kinds", "open")] == ["source", "join", "aggregate"]


PERIODS = [
    ("с 28.02.2024 по 01.03.2024", "2024-02-28", "2024-03-02", "28.02.2024-01.03.2024", "range"),
    ("сбои на 29.02.2024", "2024-02-29", "2024-03-01", "29.02.2024", "range"),
    ("2023-12-30 .. 2024-01-02", "2023-12-30", "2024-01-03", "30.12.2023-02.01.2024", "range"),
    ("с мая по август 2023", "2023-05-01", "2023-09-01", "май-август 2023", "range"),
    ("первые 5 дней июля 2023", "2023-07-01", "2023-07-06", "первые 5 дня июля 2023", "range"),  # the label's noun is fixed
    ("второе полугодие 2022", "2022-07-01", "2023-01-01", "второе полугодие 2022", "half"),
    ("Q3 2021 по складам", "2021-07-01", "2021-10-01", "Q3 2021", "quarter"),
    ("II кв. 2023", "2023-04-01", "2023-07-01", "Q2 2023", "quarter"),
    ("второй квартал 2024", "2024-04-01", "2024-07-01", "Q2 2024", "quarter"),
    ("сводка за октябрь 2023", "2023-10-01", "2023-11-01", "октябрь 2023", "month"),
    ("потери февраля 2024", "2024-02-01", "2024-03-01", "февраль 2024", "month"),
    ("итоги за 2022 год", "2022-01-01", "2023-01-01", "2022 год", "year"),
    # A day that the calendar lacks; its year is left.
    ("31.02.2024", "2024-01-01", "2025-01-01", "2024 год", "year"),
]


@pytest.mark.parametrize("text, start, end, label, kind", PERIODS)
def test_period_phrases(spark, text, start, end, label, kind):
    p = resolve_period(spark, text)
    assert (p["start"].isoformat(), p["end"].isoformat(), p["label"], p["kind"]) == (start, end, label, kind)


@pytest.mark.parametrize("text", ["самые крупные потери", "в июне", "склад № 4", "", "45.45.1850"])
def test_phrases_without_a_period(spark, text):
    assert resolve_period(spark, text) is None


def test_detail_rows_carry_the_audit_columns(spark):
    rows = spark.createDataFrame([(7, "S-7", "open", 3), (8, "S-8", "done", 4)], "incdnt_id int, incdnt_sid string, incdnt_status_name string, size int")
    spec = {"source": {"table": "incident"}, "select": ["size"], "detail": True,
            "filters": [{"kind": "categorical", "column": "incdnt_status_name", "value": "open"}]}
    found = build_report({"incident": rows}, spec)
    assert found.columns == ["incdnt_sid", "size", "incdnt_status_name", "incdnt_id"]
    assert [tuple(r) for r in found.collect()] == [("S-7", 3, "open", 7)]
    grouped = {**World(spark, 0).spec(), "detail": True}
    with pytest.raises(ValueError, match="detail"):
        validate(spec_from_dict(grouped), MODEL)


def test_fill_rates_are_measured(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, None), (4, None)], "incdnt_id int, incdnt_sum double")
    assert with_fill_rates(MODEL, rows).filled_pct["incdnt_sum"] == 25.0
    assert with_fill_rates(MODEL, rows.limit(0)).filled_pct["incdnt_sum"] == 0.0
    assert with_fill_rates(MODEL, rows.select("incdnt_id")) == MODEL


def test_null_rules(spark):
    from lossledger.functions.dates import date_part
    from lossledger.functions.predicates import where
    from lossledger.operators.aggregates import derived_metric, money_sum

    df = spark.createDataFrame([(1, 10.0, 2.0), (2, 5.0, 0.0), (3, None, 1.0)], "k long, a double, b double")
    ratio = [r[0] for r in df.orderBy("k").select(derived_metric("safe_div", F.col("a"), F.col("b"))).collect()]
    assert ratio == [5.0, None, None]
    assert df.filter(where({"a__ne": 10.0})).count() == 1
    assert df.filter("a is null").agg(money_sum("a")).first()[0] == 0
    assert spark.range(1).select(date_part(F.lit(None).cast("timestamp_ntz"), "month")).first()[0] is None
    with pytest.raises(ValueError, match="unknown operator"):
        where({"a__between": 3})
