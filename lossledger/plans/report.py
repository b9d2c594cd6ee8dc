"""The declarative report: a specification becomes one lazy plan."""

from __future__ import annotations

from dataclasses import replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import with_period
from ..functions.predicates import all_of, compare, where
from ..operators import aggregates, joins, projection, windows
from ..sources.lookup import limited
from .spec import ReportSpec, SourceModel, range_stage, spec_from_dict, use_child_money, validate

_MONEY_FUNCTIONS = ("sum",)


def resolve_period(spark: SparkSession, text: str):
    """``(start, end, label, kind)`` of a period phrase, or None."""
    return with_period(spark.range(1).select(F.lit(text).alias("text")), "text", "p").first()["p"]


def _period_conditions(spark: SparkSession, spec: ReportSpec) -> list[Column]:
    out = []
    for p in spec.periods:
        found = resolve_period(spark, p.text)
        if found is None:
            if p.required:
                raise ValueError(f"period {p.text!r} not recognised, and it is required")
            continue
        begin, end = (F.lit(found[k].isoformat()).cast("timestamp_ntz") for k in ("start", "end"))
        out += [F.col(p.column) >= begin, F.col(p.column) < end]
    return out


def _metric(m) -> Column:
    condition = where(m.where) if m.where else None
    return aggregates.aggregate(m.fn, m.source, condition).alias(m.alias)


def with_fill_rates(model: SourceModel, source: DataFrame) -> SourceModel:
    """The model with the measured percentage of filled rows of its money columns.

    One aggregate over the source; a number per column reaches the driver. Without rows nothing
    is known to be filled.
    """
    columns = [c for c in model.money if c in source.columns]
    if not columns:
        return model
    rows = F.greatest(F.count(F.lit(1)), F.lit(1))
    filled = source.agg(*[(100 * F.count(c) / rows).alias(c) for c in columns]).first()
    return replace(model, filled_pct={**model.filled_pct, **filled.asDict()})


def _operand(side) -> Column:
    return F.col(side) if isinstance(side, str) else F.lit(side)


class Funnel:
    """Rows left after each stage of a report, counted while the report itself runs.

    Read it after one action on the report. Where a branch turned out empty, Spark may drop a stage
    from the plan while it runs; only such a stage is counted by itself.
    """

    def __init__(self):
        self._stages: list[tuple[str, DataFrame, Observation]] = []

    def watch(self, stage: str, df: DataFrame) -> DataFrame:
        seen = Observation()
        self._stages.append((stage, df, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def rows(self) -> list[tuple[str, int]]:
        return [(stage, self._count(df, seen)) for stage, df, seen in self._stages]

    @staticmethod
    def _count(df: DataFrame, seen: Observation) -> int:
        try:
            return seen.get["rows"]
        except (Py4JJavaError, KeyError):
            return df.count()


def build_report(
    tables: dict[str, DataFrame],
    spec: ReportSpec | dict,
    model: SourceModel | None = None,
    funnel: Funnel | None = None,
) -> DataFrame:
    """Filter, join aggregated children, group, derive, rank, sort, project and limit.

    Steps follow the order of a SQL statement, so Catalyst can push filters and columns
    into the scans. With a ``model`` sparse money columns are replaced by child sums and the
    specification is checked first. A ``funnel`` watches the rows after the stages ``source``,
    ``join``, ``ranges``, ``aggregate`` and ``export``.
    """
    def watched(stage: str, rows: DataFrame) -> DataFrame:
        return rows if funnel is None else funnel.watch(stage, rows)

    if isinstance(spec, dict):
        spec = spec_from_dict(spec)
    if model is not None:
        spec = use_child_money(spec, model)
        validate(spec, model)
    source = tables[spec.source]
    stages = {r: range_stage(spec, r.column, source.columns) for r in spec.ranges}

    def ranges(stage: str) -> Column:
        return all_of([compare(r.column, r.op, r.value) for r in spec.ranges if stages[r] == stage])

    df = source.filter(
        all_of(_period_conditions(source.sparkSession, spec)) & where(spec.where) & ranges("source")
    )
    df = watched("source", df)
    for j in spec.joins:
        df = joins.join_aggregated(df, tables[j.table], [_metric(m) for m in j.metrics], j.key, how=j.how)
    df = watched("join", df)
    df = watched("ranges", df.filter(ranges("join")))
    for d in spec.derive:
        df = projection.derive(df, d.source, d.new_column, d.op)
    if spec.group_by or spec.metrics:
        df = aggregates.group_by(df, list(spec.group_by), [_metric(m) for m in spec.metrics])
        df = df.fillna(0, [m.alias for m in spec.metrics if m.fn in _MONEY_FUNCTIONS])
    for d in spec.derived_metrics:
        metric = aggregates.derived_metric(d.op, _operand(d.left), _operand(d.right))
        df = df.withColumn(d.alias, metric)
    df = watched("aggregate", df.filter(ranges("aggregate")))
    if funnel is not None:
        # Ranges of a sort are drawn by reading its input twice; behind an exchange nothing is counted twice.
        df = df.hint("rebalance")
    keys = [c for c in (spec.group_by or ("incdnt_id",)) if c in df.columns]
    for w in spec.window:
        if w.top_n is None:
            df = windows.rank_all(
                df, list(w.partition_by), w.order_by, keys, w.method, w.descending
            )
        else:
            df = windows.rank_top_n(
                df, list(w.partition_by), w.order_by, w.top_n, w.method, w.descending, tuple(keys)
            )
    if spec.sort:
        order = [
            F.col(s.by).desc_nulls_last() if s.descending else F.col(s.by).asc_nulls_last()
            for s in spec.sort
        ]
        df = df.orderBy(*order, *[F.col(k) for k in keys])
    if spec.detail:
        df = projection.keys_at_edges(projection.detail_columns(df, list(spec.select)))
    elif spec.select:
        df = projection.select_present(df, list(spec.select))
    return watched("export", limited(df, spec.limit))
