"""Report specification: what a declarative report asks for."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..functions import fixed_values as fixed

DERIVED_OPS = ("add", "sub", "mul", "div", "safe_div")
AGGREGATES = ("sum", "mean", "count", "max", "min", "nunique")


@dataclass(frozen=True)
class Metric:
    """An aggregate of one column under a name, over rows that meet a condition."""

    source: str
    fn: str
    alias: str
    where: dict = field(default_factory=dict)


@dataclass(frozen=True)
class ChildJoin:
    """A child table, aggregated per key before it is joined."""

    table: str
    metrics: tuple[Metric, ...]
    key: str = "incdnt_id"
    how: str = "left"


@dataclass(frozen=True)
class Range:
    column: str
    op: str
    value: object


@dataclass(frozen=True)
class Period:
    column: str
    text: str
    required: bool = False


@dataclass(frozen=True)
class Derive:
    source: str
    new_column: str
    op: str = "month"


@dataclass(frozen=True)
class DerivedMetric:
    alias: str
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Rank:
    order_by: str
    partition_by: tuple[str, ...] = ()
    top_n: int | None = None
    method: str = "row_number"
    descending: bool = True


@dataclass(frozen=True)
class Sort:
    by: str
    descending: bool = True


@dataclass(frozen=True)
class ReportSpec:
    source: str
    joins: tuple[ChildJoin, ...] = ()
    periods: tuple[Period, ...] = ()
    where: dict = field(default_factory=dict)
    ranges: tuple[Range, ...] = ()
    derive: tuple[Derive, ...] = ()
    group_by: tuple[str, ...] = ()
    metrics: tuple[Metric, ...] = ()
    derived_metrics: tuple[DerivedMetric, ...] = ()
    window: tuple[Rank, ...] = ()
    sort: tuple[Sort, ...] = ()
    select: tuple[str, ...] = ()
    limit: int | None = None
    #: Rows, not groups: the selection with the audit columns, business id first, surrogate id last.
    detail: bool = False


@dataclass(frozen=True)
class SourceModel:
    """What the rules need to know about a source table and its children.

    ``money`` maps a sparse money column to the child metric that replaces it.
    """

    columns: tuple[str, ...]
    children: dict[str, tuple[str, ...]]
    key: str = "incdnt_id"
    filled_pct: dict[str, float] = field(default_factory=dict)
    money: dict[str, ChildJoin] = field(default_factory=dict)


def spec_from_dict(raw: dict) -> ReportSpec:
    """Read the JSON form of a report."""
    source = raw.get("source") or {}
    joins = []
    for j in source.get("joins") or []:
        pre = j.get("pre_aggregate")
        if not pre:
            raise ValueError(f"join to {j.get('table')!r} needs a pre-aggregate: it would multiply rows")
        metrics = tuple(
            Metric(column, body.get("fn"), body.get("as") or f"{column}_{body.get('fn')}", body.get("filter") or {})
            for column, body in (pre.get("agg") or {}).items()
        )
        joins.append(ChildJoin(j["table"], metrics, j.get("on", "incdnt_id"), j.get("how") or "left"))

    periods, ranges, conditions = [], [], {}
    for f in raw.get("filters") or []:
        kind, column, value = (f.get("kind") or "").lower(), f.get("column"), f.get("value")
        if kind == "period":
            intent = f.get("intent")
            text = intent.get("text") if isinstance(intent, dict) else intent
            periods.append(
                Period(column or "incdnt_entry_dt", text or f.get("text") or value or "", bool(f.get("required")))
            )
        elif kind == "range":
            ranges.append(Range(column, f.get("op") or "eq", value))
        elif kind == "categorical":
            conditions[f"{column}__{f.get('op') or 'eq'}"] = value
        elif kind == "like":
            conditions[f"{column}__like"] = value if "%" in str(value) else f"%{value}%"
        elif kind == "any_of":
            conditions.setdefault("_or", []).extend(f["options"])
        else:
            raise ValueError(f"filter kind {kind!r}: use period, categorical, range, like or any_of")

    aggregate = raw.get("aggregate") or {}
    return ReportSpec(
        source=source.get("table") or "incident",
        joins=tuple(joins),
        periods=tuple(periods),
        where=conditions,
        ranges=tuple(ranges),
        derive=tuple(
            Derive(d["source"], d["new_column"], d.get("op", "month")) for d in raw.get("derive") or []
        ),
        group_by=tuple(aggregate.get("group_by") or ()),
        metrics=tuple(
            Metric(m["source"], m["fn"], m.get("as") or f"{m['source']}_{m['fn']}")
            for m in aggregate.get("metrics") or []
        ),
        derived_metrics=tuple(
            DerivedMetric(d["as"], d["expr"]["op"], d["expr"]["left"], d["expr"]["right"])
            for d in raw.get("derived_metrics") or []
        ),
        window=tuple(
            Rank(
                w["order_by"], tuple(w.get("partition_by") or ()), w.get("top_n"),
                w.get("method", "row_number"), w.get("order_desc", True),
            )
            for w in raw.get("window") or []
        ),
        sort=tuple(
            Sort(s) if isinstance(s, str) else Sort(s["by"], s.get("desc", True)) for s in raw.get("sort") or []
        ),
        select=tuple(raw.get("select") or ()),
        limit=raw.get("limit"),
        detail=bool(raw.get("detail")),
    )


def use_child_money(spec: ReportSpec, model: SourceModel) -> ReportSpec:
    """Replace sparse money columns of the source by sums over the child tables."""
    sparse = {
        c: join
        for c, join in model.money.items()
        if model.filled_pct.get(c, 100.0) < fixed.SPARSE_MONEY_FILLED_PCT
    }
    joins = list(spec.joins)

    def replaced(column: str) -> str:
        if column not in sparse:
            return column
        wanted = sparse[column]
        alias = wanted.metrics[0].alias
        if not any(m.alias == alias for j in joins for m in j.metrics):
            joins.append(wanted)
        return alias

    ranges = tuple(replace(r, column=replaced(r.column)) for r in spec.ranges)
    metrics = tuple(replace(m, source=replaced(m.source)) for m in spec.metrics)
    select = tuple(replaced(c) for c in spec.select)
    return replace(spec, ranges=ranges, metrics=metrics, select=select, joins=tuple(joins))


def range_stage(spec: ReportSpec, column: str, source_columns) -> str:
    """``source``, ``join`` or ``aggregate``: where a range filter on the column belongs."""
    joined = {m.alias for j in spec.joins for m in j.metrics}
    grouped = {m.alias for m in spec.metrics} | {d.alias for d in spec.derived_metrics}
    if column in joined and column in grouped:
        raise ValueError(f"range on {column!r}: the name is both per incident and per group; rename one")
    if column in grouped:
        return "aggregate"
    if column in joined:
        return "join"
    if column in source_columns:
        return "source"
    raise ValueError(f"range on {column!r}: unknown column")


def validate(spec: ReportSpec, model: SourceModel) -> None:
    """Raise ``ValueError`` with the reason when a report cannot be built."""
    for j in spec.joins:
        if j.table not in model.children:
            raise ValueError(f"{j.table!r} is no child table; known: {sorted(model.children)}")
        if j.key != model.key:
            raise ValueError(f"join to {j.table!r} on {j.key!r}: the foreign key is {model.key!r}")
        for m in j.metrics:
            if m.source not in model.children[j.table]:
                raise ValueError(f"{j.table!r} has no column {m.source!r}")
            if m.fn not in AGGREGATES:
                raise ValueError(f"aggregate {m.fn!r}: use one of {AGGREGATES}")

    if spec.detail and (spec.group_by or spec.metrics):
        raise ValueError("a detail report has rows: leave out detail, or the groups and metrics")
    known = set(model.columns) | {m.alias for j in spec.joins for m in j.metrics}
    known |= {d.new_column for d in spec.derive}
    finals = {m.alias for m in spec.metrics} | {d.alias for d in spec.derived_metrics}

    def check(name, names, where: str) -> None:
        if name not in names:
            raise ValueError(f"{where}: unknown column {name!r}")

    for d in spec.derive:
        check(d.source, known, "derive")
    for g in spec.group_by:
        check(g, known, "group_by")
    for m in spec.metrics:
        if m.fn not in AGGREGATES:
            raise ValueError(f"aggregate {m.fn!r}: use one of {AGGREGATES}")
        check(m.source, known, "metrics")
        if m.fn == "sum" and model.filled_pct.get(m.source, 100.0) < fixed.SPARSE_MONEY_FILLED_PCT:
            raise ValueError(f"{m.source!r} is almost never filled: sum a child table instead")
    for d in spec.derived_metrics:
        if d.op not in DERIVED_OPS:
            raise ValueError(f"derived metric {d.op!r}: use one of {DERIVED_OPS}")
        for side in (d.left, d.right):
            if isinstance(side, str):
                check(side, known | finals, "derived_metrics")
    for r in spec.ranges:
        range_stage(spec, r.column, model.columns)
        if model.filled_pct.get(r.column, 100.0) < fixed.SPARSE_MONEY_FILLED_PCT:
            raise ValueError(f"{r.column!r} is almost never filled: filter on a child sum instead")
    names = known | finals | {"rank"}
    for w in spec.window:
        for c in (*w.partition_by, w.order_by):
            check(c, names, "window")
    for s in spec.sort:
        check(s.by, names, "sort")
    for c in spec.select:
        check(c, names, "select")
