"""Value catalog: fill rates, frequent values, enums, inverted index, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import fixed_values as fixed
from .aggregates import top_k_per_group
from .lineage import cut_lineage

#: Size of a distinct-count sketch (2 to this power); its error is about 0.8 percent.
SKETCH_BITS = 14
#: Values that the sketch of frequent values tracks per column and value asked for.
TRACKED = 16
#: A tracked count is wrong by at most this share of the rows, divided by the values tracked.
SKETCH_ERROR = 3.5
#: Average length from which a text column is prose, not a category.
PROSE_LENGTH = 80


def fill_rates(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Percent of non-NULL values of every column, one aggregation, one row per column."""
    rows = F.count(F.lit(1)).cast("double")
    rates = df.agg(*[
        F.round(F.coalesce(F.try_divide(F.count(c).cast("double") * 100, rows), F.lit(0.0)), 2).alias(c)
        for c in columns
    ])
    return rates.unpivot([], list(columns), "col", "filled_pct").withColumn("tbl", F.lit(table))


def approx_cardinality(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Approximate distinct count per column and the high-cardinality flag, one pass."""
    sketches = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
    return (
        sketches.unpivot([], list(columns), "col", "distinct_approx")
        .withColumn("tbl", F.lit(table))
        .withColumn("high_card", F.col("distinct_approx") > fixed.HIGH_CARDINALITY)
    )


def value_counts(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Rows per (column, value) for many columns with one shuffle."""
    return (
        df.select(*[F.col(c).cast("string") for c in columns])
        .unpivot([], list(columns), "col", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("col", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .withColumn("tbl", F.lit(table))
    )


def cardinality_sketches(df: DataFrame, columns: list[str], part: Column) -> DataFrame:
    """``(part, col, sketch)``: a mergeable distinct-count sketch of every column, per part of the table.

    Parts can be stored and added later; :func:`united` never reads the rows again.
    """
    sketches = df.groupBy(part.alias("part")).agg(
        *[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH_BITS)).alias(c) for c in columns]
    )
    return sketches.unpivot(["part"], list(columns), "col", "sketch")


def united(sketches: DataFrame, table: str) -> DataFrame:
    """Approximate distinct count over all parts and the high-cardinality flag."""
    return (
        sketches.groupBy("col")
        .agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_approx"))
        .withColumn("tbl", F.lit(table))
        .withColumn("high_card", F.col("distinct_approx") > fixed.HIGH_CARDINALITY)
    )


def _top(counted: DataFrame, n: int) -> DataFrame:
    return top_k_per_group(counted, ["tbl", "col"], [F.desc("cnt"), F.asc("value")], n).drop("rn")


def tracked_values(df: DataFrame, columns: list[str], tracked: int) -> DataFrame:
    """``(col, rows, n_tracked, least, value)``: values that a frequency sketch of each column ended up
    with, at most ``tracked``, its filled rows, and the least estimate; one pass, one row per column."""
    text = {c: f"cast(`{c}` as string)" for c in columns}
    sketches = df.agg(*[
        F.struct(F.count(c).alias("rows"), F.expr(f"approx_top_k({text[c]}, {tracked}, {tracked})").alias("items")).alias(c)
        for c in columns
    ]).unpivot([], list(columns), "col", "found")
    values = F.transform("found.items", lambda x: F.struct(x["item"].alias("value"), x["count"].alias("estimate")))
    return sketches.select("col", "found.rows", F.explode_outer(values).alias("v")).select("col", "rows", "v.*")


def proven_columns(tracked_counts: DataFrame, candidates: DataFrame, n: int, tracked: int) -> DataFrame:
    """``(col, proven)``: whether no untracked value can be among the ``n`` most frequent.

    An untracked value has at most the rows that no tracked value holds. It has, too, at most the least
    tracked estimate where the sketch is full, and at most twice the sketch's error. It cannot be among
    the first ``n`` if the n-th exact count is above that.
    """
    error = 2 * SKETCH_ERROR / tracked
    of_column = candidates.groupBy("col").agg(
        F.max("rows").alias("rows"), F.count("value").alias("n_tracked"), F.min("estimate").alias("least")
    )
    exact = tracked_counts.groupBy("col").agg(F.sum("cnt").alias("held"), F.count(F.lit(1)).alias("n_values"))
    nth = top_k_per_group(tracked_counts, ["col"], [F.desc("cnt"), F.asc("value")], n).filter(F.col("rn") == n)
    bound = F.least(
        F.col("rows") - F.coalesce("held", F.lit(0)),
        F.greatest(F.col("rows") * error, F.when(F.col("n_tracked") >= tracked, F.col("least")).otherwise(F.lit(0))),
    )
    none_left = F.col("rows") == F.coalesce("held", F.lit(0))
    return (
        of_column.join(exact, "col", "left")
        .join(nth.select("col", F.col("cnt").alias("nth")), "col", "left")
        .select("col", (none_left | F.coalesce(F.col("nth") > bound, F.lit(False))).alias("proven"))
    )


def frequent_values(
    df: DataFrame,
    columns: list[str],
    table: str,
    n: int = fixed.CATALOG_VALUES_PER_COLUMN,
    tracked: int | None = None,
) -> DataFrame:
    """The n most frequent values of every column, exactly.

    A sketch names candidates in one pass; only their rows are counted and shuffled. Where the counts
    do not prove that the candidates are enough (see :func:`proven_columns`), a column is counted whole.
    """
    tracked = tracked or TRACKED * n
    candidates = cut_lineage(tracked_values(df, columns, tracked))
    wanted = candidates.filter(F.col("value").isNotNull()).select("col", "value")
    rows = df.select(*[F.col(c).cast("string") for c in columns]).unpivot([], list(columns), "col", "value")
    counted = cut_lineage(
        rows.join(wanted, ["col", "value"], "left_semi").groupBy("col", "value").agg(F.count(F.lit(1)).alias("cnt"))
    )
    proofs = proven_columns(counted, candidates, n, tracked)
    open_columns = [r["col"] for r in proofs.filter(~F.col("proven")).collect()]
    found = counted.filter(~F.col("col").isin(open_columns)).withColumn("tbl", F.lit(table))
    if open_columns:
        found = found.unionByName(value_counts(df, open_columns, table))
    return _top(found, n)


def build_catalog(
    sources: dict[str, tuple[DataFrame, list[str]]], n: int | None = None
) -> DataFrame:
    """Catalog ``(tbl, col, value, norm, cnt, filled_pct)`` over several tables.

    All values of the columns; the ``n`` most frequent only where a caller asks for them.
    """
    parts = []
    for table, (df, columns) in sources.items():
        rates = fill_rates(df, columns, table)
        values = value_counts(df, columns, table) if n is None else frequent_values(df, columns, table, n)
        parts.append(values.join(rates, ["tbl", "col"]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(
        "tbl", "col", "value", F.lower(F.trim("value")).alias("norm"), "cnt", "filled_pct"
    )


def overview(sources: dict[str, tuple[DataFrame, list[str]]], catalog: DataFrame) -> DataFrame:
    """Per column: fill rate and whether the catalog has values for it."""
    rates = None
    for table, (df, columns) in sources.items():
        part = fill_rates(df, columns, table)
        rates = part if rates is None else rates.unionByName(part)
    known = catalog.groupBy("tbl", "col").agg(F.count(F.lit(1)).alias("n_values"))
    return (
        rates.join(known, ["tbl", "col"], "left")
        .fillna(0, ["n_values"])
        .withColumn("has_values", F.col("n_values") > 0)
    )


def invert(catalog: DataFrame) -> DataFrame:
    """Normalised value to its postings, most frequent first.

    A list holds at most the catalog's values per column times its columns.
    """
    return catalog.groupBy("norm").agg(
        F.sort_array(
            F.collect_list(
                F.struct((-F.col("cnt")).alias("order"), "tbl", "col", "value", "cnt")
            )
        ).alias("postings")
    )


def name_marks(column: Column) -> Column:
    """The kinds of marks a column name carries: ``category``, or ``other`` for keys, times, measures
    and prose."""
    name = F.lower(column)

    def any_of(marks, test) -> Column:
        return F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: test(name, m))

    other = (
        any_of(fixed.ENUM_EXCLUDED_SUFFIXES, F.endswith)
        | any_of(fixed.ENUM_EXCLUDED_PARTS, F.contains)
        | name.isin(*fixed.ENUM_EXCLUDED_NAMES)
    )
    return F.array_compact(F.array(
        F.when(any_of(fixed.ENUM_NAME_SUFFIXES, F.contains), F.lit("category")), F.when(other, F.lit("other"))
    ))


def category_profile(df: DataFrame, table: str) -> DataFrame:
    """What tells categories from other text columns, in one pass over the table: fill rate, distinct
    values (a sketch), their share of the filled rows, average length, and the marks of the name."""
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    measures = df.agg(*[
        F.struct(
            F.count(F.lit(1)).alias("rows"), F.count(c).alias("filled"),
            F.approx_count_distinct(c, 0.02).alias("distinct_approx"), F.avg(F.length(c)).alias("avg_length"),
        ).alias(c)
        for c in columns
    ]).unpivot([], columns, "col", "m") if columns else df.sparkSession.createDataFrame(
        [], "col string, m struct<rows:bigint,filled:bigint,distinct_approx:bigint,avg_length:double>")
    return measures.select(
        F.lit(table).alias("tbl"), "col",
        F.round(F.coalesce(F.try_divide(F.col("m.filled") * 100.0, F.col("m.rows")), F.lit(0.0)), 2).alias("filled_pct"),
        "m.distinct_approx",
        F.try_divide(F.col("m.distinct_approx"), F.col("m.filled")).alias("distinct_share"),
        "m.avg_length",
        name_marks(F.col("col")).alias("marks"),
    )


def enum_candidates(
    df: DataFrame, max_values: int = fixed.ENUM_MAX_VALUES, min_filled: float = fixed.ENUM_MIN_FILLED_PCT
) -> list[str]:
    """Text columns that hold categories by their data, and whose name does not speak against it: filled
    enough, few distinct short values (a tenth above the limit is left for the sketch's error), and a
    name with the mark of a category only. One row per column reaches the driver."""
    likely = category_profile(df, "").filter(
        (F.col("filled_pct") >= min_filled)
        & (F.col("distinct_approx") <= max_values * 1.1 + 1)
        & (F.col("avg_length") <= PROSE_LENGTH)
        & (F.array_join("marks", ",") == "category")
    )
    return sorted((r["col"] for r in likely.select("col").collect()), key=df.columns.index)


def enum_values(
    df: DataFrame,
    columns: list[str],
    table: str,
    max_values: int = fixed.ENUM_MAX_VALUES,
    min_filled: float = fixed.ENUM_MIN_FILLED_PCT,
) -> DataFrame:
    """Value list of every column that is filled enough and has few distinct values.

    Columns are sorted out before their values are gathered, so a list never holds more
    than ``max_values`` entries.
    """
    counted = value_counts(df, columns, table)
    few = (
        counted.groupBy("col")
        .agg(F.count(F.lit(1)).alias("n_values"))
        .filter(F.col("n_values") <= max_values)
    )
    filled = fill_rates(df, columns, table).filter(F.col("filled_pct") >= min_filled)
    return (
        counted.join(few.join(filled.select("col"), "col", "left_semi"), "col")
        .groupBy("tbl", "col", "n_values")
        .agg(F.sort_array(F.collect_set("value")).alias("enum_values"))
    )


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Compare two saved catalogs: every value that is new, lost or counted differently,
    with the fill rate on either side."""
    old = before.select("tbl", "col", "value", F.col("cnt").alias("cnt_before"),
                        F.col("filled_pct").alias("filled_before"))
    new = after.select("tbl", "col", "value", F.col("cnt").alias("cnt_after"),
                       F.col("filled_pct").alias("filled_after"))
    change = (
        F.when(F.col("cnt_before").isNull(), "new")
        .when(F.col("cnt_after").isNull(), "lost")
        .when(F.col("cnt_before") != F.col("cnt_after"), "count")
        .when(F.col("filled_before") != F.col("filled_after"), "fill")
    )
    return (
        old.join(new, ["tbl", "col", "value"], "outer")
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
    )
