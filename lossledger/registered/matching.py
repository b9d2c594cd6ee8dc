"""Value catalog and matching (M)."""

from pyspark.sql import functions as F

from ..operators import catalog as c
from ..operators import matching
from .base import query


def _sources(v):
    codes = v.nation.select(
        F.concat(F.lit("DRP-"), F.col("n_nationkey") + 10000, F.lit(" "), F.col("n_name")).alias("code_name"), "n_name"
    )
    return {
        "part": (v.part, ["p_name", "p_type", "p_brand"]),
        "customer": (v.customer, ["c_mktsegment"]),
        "orders": (v.orders, ["o_orderpriority", "o_orderstatus"]),
        "nation": (codes, ["n_name", "code_name"]),
        "region": (v.region, ["r_name"]),
    }


def _catalog(v):
    return c.build_catalog(_sources(v))


def _part(table: str, column: str, source: str | None = None) -> str:
    return f"""
        SELECT '{table}' AS tbl, '{column}' AS col, {source or column} AS value, COUNT(*) AS cnt
        FROM {table} GROUP BY 3"""


CATALOG = """catalog AS (SELECT tbl, col, value, lower(trim(value)) AS norm, cnt, 100.0::DOUBLE AS filled_pct FROM (""" + \
    " UNION ALL ".join([
        _part("part", "p_name"), _part("part", "p_type"), _part("part", "p_brand"),
        _part("customer", "c_mktsegment"), _part("orders", "o_orderpriority"), _part("orders", "o_orderstatus"),
        _part("nation", "n_name"), _part("nation", "code_name", "'DRP-' || (n_nationkey + 10000) || ' ' || n_name"),
        _part("region", "r_name"),
    ]) + "))"


@query("m1_value_catalog", f"WITH {CATALOG} SELECT * FROM catalog")
def value_catalog(v):
    return _catalog(v)


@query("m1_catalog_overview", f"""
    WITH {CATALOG} SELECT tbl, col, 100.0::DOUBLE AS filled_pct, COUNT(*) AS n_values, TRUE AS has_values
    FROM catalog GROUP BY 1, 2""")
def catalog_overview(v):
    return c.overview(_sources(v), _catalog(v))


@query("m2_inverted_index", f"""
    WITH {CATALOG} SELECT norm, string_agg(tbl || '.' || col || '=' || value || ':' || cnt, '|' ORDER BY cnt DESC, tbl, col, value) AS postings
    FROM catalog GROUP BY 1""")
def inverted_index(v):
    def show(p):
        return F.concat(p["tbl"], F.lit("."), p["col"], F.lit("="), p["value"], F.lit(":"), p["cnt"].cast("string"))

    return c.invert(_catalog(v)).select(
        "norm", F.array_join(F.transform("postings", show), "|").alias("postings")
    )


def _phrases(v):
    """Misspelt and decorated spellings of values, one per source row."""
    return (
        v.part.select(F.replace("p_name", F.lit("i"), F.lit("")).alias("phrase"))
        .union(v.part.select(F.concat(F.lit("The "), F.upper("p_name"))))
        .union(v.part.select(F.replace("p_brand", F.lit("#"), F.lit(" "))))
        .union(v.customer.select(F.concat(F.lower(F.substring("c_mktsegment", 1, 6)), F.lit("s"))))
        .union(v.orders.select(F.substring("o_orderpriority", 3, 20)))
        .union(v.nation.select(F.concat(F.lit("zzqq"), F.col("n_nationkey").cast("string"))))
    )


PHRASES = r"""phrases AS (
    SELECT DISTINCT phrase FROM (
        SELECT replace(p_name, 'i', '') AS phrase FROM part
        UNION ALL SELECT 'The ' || upper(p_name) FROM part
        UNION ALL SELECT replace(p_brand, '#', ' ') FROM part
        UNION ALL SELECT lower(substr(c_mktsegment, 1, 6)) || 's' FROM customer
        UNION ALL SELECT substr(o_orderpriority, 3, 20) FROM orders
        UNION ALL SELECT 'zzqq' || n_nationkey FROM nation))"""


def _forms(value: str) -> str:
    norm = rf"trim(regexp_replace(lower({value}), '\s+', ' ', 'g'))"
    return f"""{norm} AS norm, regexp_replace(lower({value}), '[^0-9a-zа-яё]+', '', 'g') AS tight,
        list_distinct(list_filter(string_split({norm}, ' '), lambda t: length(t) >= 2)) AS tokens"""


def scored(asked: str) -> str:
    """CTEs ``entries``, ``asked_forms`` and ``hits`` for the distinct phrases of a relation."""
    return f"""
    entries AS (SELECT col, value, cnt, {_forms('value')} FROM (SELECT col, value, MAX(cnt) AS cnt FROM catalog GROUP BY 1, 2)),
    asked_forms AS (SELECT phrase, {_forms('phrase')} FROM (SELECT DISTINCT phrase FROM {asked})),
    hits AS (
        SELECT q.phrase, e.col, e.value, e.cnt, ROUND(CASE WHEN q.norm = e.norm THEN 1.0 ELSE greatest(
            CASE WHEN length(q.tight) = 0 OR length(e.tight) = 0 THEN 0
                 WHEN contains(e.tight, q.tight) THEN 0.72 + 0.25 * (length(q.tight)::DOUBLE / length(e.tight))
                 WHEN contains(q.tight, e.tight) THEN 0.62 + 0.20 * (length(e.tight)::DOUBLE / length(q.tight)) ELSE 0 END,
            CASE WHEN len(list_intersect(q.tokens, e.tokens)) > 0 THEN 0.55 + 0.4 * (
                 len(list_intersect(q.tokens, e.tokens))::DOUBLE / len(list_distinct(list_concat(q.tokens, e.tokens)))) ELSE 0 END,
            CASE WHEN length(q.tight) > 0 AND length(e.tight) > 0
                      AND abs(length(q.tight) - length(e.tight)) <= greatest(4, length(e.tight) // 2)
                 THEN 1.0 - levenshtein(q.tight, e.tight)::DOUBLE / greatest(length(q.tight), length(e.tight)) ELSE 0 END
        ) END::DOUBLE, 6) AS score
        FROM asked_forms q, entries e)"""


@query("m4_fuzzy_values", f"""
    WITH {CATALOG}, {PHRASES}, {scored('phrases')}
    SELECT phrase, ROW_NUMBER() OVER (PARTITION BY phrase ORDER BY score DESC, cnt DESC, col, value) AS rn,
           col, value, cnt, score
    FROM hits WHERE score >= 0.6 QUALIFY rn <= 8""")
def fuzzy_values(v):
    return matching.match_phrases(_phrases(v), "phrase", _catalog(v))


@query("m4_fuzzy_values_in_parts", f"""
    WITH {CATALOG}, {PHRASES}, {scored('phrases')}
    SELECT phrase, ROW_NUMBER() OVER (PARTITION BY phrase ORDER BY score DESC, cnt DESC, col, value) AS rn,
           col, value, cnt, score
    FROM hits WHERE score >= 0.75 QUALIFY rn <= 3""")
def fuzzy_values_in_parts(v):
    return matching.match_phrases(_phrases(v), "phrase", _catalog(v), 0.75, 3)


def _filters(v):
    """Filters on ``c_mktsegment`` and ``p_name`` with misspelt, misplaced and unknown values."""
    phrases = _phrases(v)
    return phrases.select(
        F.when(F.length("phrase") % 2 == 0, "p_name").otherwise("c_mktsegment").alias("col"),
        F.col("phrase").alias("value"),
    )


ASKED = """asked AS (SELECT DISTINCT CASE WHEN length(phrase) % 2 = 0 THEN 'p_name' ELSE 'c_mktsegment' END AS asked_col, phrase FROM phrases)"""

_BEST = """
    own AS (SELECT asked_col, phrase, value, score FROM asked JOIN hits USING (phrase) WHERE score >= 0.6 AND col = asked_col
            QUALIFY ROW_NUMBER() OVER (PARTITION BY asked_col, phrase ORDER BY score DESC, cnt DESC, col, value) = 1),
    best AS (SELECT asked_col, phrase, col, value, score FROM asked JOIN hits USING (phrase) WHERE score >= 0.6
             QUALIFY ROW_NUMBER() OVER (PARTITION BY asked_col, phrase ORDER BY score DESC, cnt DESC, col, value) = 1)"""


@query("m5_filters_corrected", f"""
    WITH {CATALOG}, {PHRASES}, {ASKED}, {scored('asked')}, {_BEST},
    decided AS (
        SELECT a.asked_col, a.phrase, own.value AS own_value, best.col AS best_col, best.value AS best_value,
               CASE WHEN best.col <> a.asked_col AND (best.score > COALESCE(own.score, 0) + 0.15
                         OR (COALESCE(own.score, 0) < 0.8 AND best.score >= 0.85)) THEN 'moved'
                    WHEN own.value IS NOT NULL THEN 'fixed' WHEN best.col IS NOT NULL THEN 'moved' ELSE 'unknown' END AS action
        FROM asked a LEFT JOIN own USING (asked_col, phrase) LEFT JOIN best USING (asked_col, phrase))
    SELECT asked_col, phrase, action, CASE action WHEN 'moved' THEN best_col ELSE asked_col END AS col,
           CASE action WHEN 'moved' THEN best_value WHEN 'fixed' THEN own_value ELSE phrase END AS value FROM decided""")
def filters_corrected(v):
    return matching.ground_filters(_filters(v), _catalog(v))


@query("m6_uncertain_filters", f"""
    WITH {CATALOG}, {PHRASES}, {ASKED}, {scored('asked')}, {_BEST}
    SELECT asked_col, phrase, value, score FROM own WHERE score BETWEEN 0.85 AND 0.96""")
def uncertain_filters(v):
    return matching.uncertain_filters(_filters(v), _catalog(v))


@query("m7_empty_result_diagnosis", f"""
    WITH {CATALOG}, {PHRASES}, {ASKED}, {scored('asked')},
    valid AS (SELECT DISTINCT asked_col, phrase FROM asked JOIN hits USING (phrase) WHERE col = asked_col AND score >= 0.9),
    nearest AS (SELECT asked_col, phrase, col, value, score, cnt FROM asked JOIN hits USING (phrase) WHERE score >= 0.8
                QUALIFY ROW_NUMBER() OVER (PARTITION BY asked_col, phrase ORDER BY score DESC, cnt DESC, col, value) <= 3),
    elsewhere AS (SELECT asked_col, phrase, col, value FROM nearest WHERE col <> asked_col
                  QUALIFY ROW_NUMBER() OVER (PARTITION BY asked_col, phrase ORDER BY score DESC, cnt DESC, col, value) = 1)
    SELECT a.asked_col, a.phrase,
           CASE WHEN v.phrase IS NOT NULL THEN 'valid' WHEN e.col IS NOT NULL THEN 'wrong column' ELSE 'not a category' END AS verdict,
           CASE WHEN v.phrase IS NULL THEN e.col END AS found_col, CASE WHEN v.phrase IS NULL THEN e.value END AS found_value
    FROM asked a LEFT JOIN valid v USING (asked_col, phrase) LEFT JOIN elsewhere e USING (asked_col, phrase)""")
def empty_result_diagnosis(v):
    wild = _filters(v).withColumn("value", F.concat(F.lit("%"), F.col("value"), F.lit("%")))
    return matching.diagnose_empty(wild, _catalog(v))


@query("m8_grounded_texts", f"""
    WITH {CATALOG}, texts AS (
        SELECT DISTINCT c_mktsegment || '/' || o_orderpriority || '/' || c_nationkey AS request,
               c_mktsegment, o_orderpriority, c_nationkey
        FROM orders JOIN customer ON o_custkey = c_custkey),
    asked AS (SELECT request, lower(c_mktsegment) AS phrase, FALSE AS code FROM texts
              UNION ALL SELECT request, lower(o_orderpriority), FALSE FROM texts
              UNION ALL SELECT request, 'drp-' || (10000 + c_nationkey), TRUE FROM texts),
    {scored('asked')},
    near AS (SELECT request, phrase, code, col, value, cnt, score FROM asked JOIN hits USING (phrase)
             WHERE score >= 0.85 OR (code AND score >= 0.6)
             QUALIFY ROW_NUMBER() OVER (PARTITION BY request, phrase ORDER BY score DESC, cnt DESC, col, value) <= 3)
    SELECT request, phrase, col, value, cnt, ROUND(score, 3) AS score FROM near
    WHERE NOT code OR starts_with(lower(value), phrase)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY request ORDER BY near.score DESC, cnt DESC, col, value, phrase) <= 10""")
def grounded_texts(v):
    pairs = v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey"))
    texts = pairs.select(
        F.concat_ws("/", "c_mktsegment", "o_orderpriority", F.col("c_nationkey").cast("string")).alias("request"),
        F.concat(
            F.lit('Отчёт по "'), F.col("c_mktsegment"), F.lit("\", тип «"), F.col("o_orderpriority"),
            F.lit("», событие DRP-"), (F.col("c_nationkey") + 10000).cast("string"),
        ).alias("text"),
    ).distinct()
    return matching.ground_texts(texts, "request", "text", _catalog(v)).drop("rn")


@query("m9_enum_values", """
    SELECT 'incident' AS tbl, col, COUNT(DISTINCT value) AS n_values, string_agg(DISTINCT value, '|' ORDER BY value) AS enum_values
    FROM (SELECT unnest(['incdnt_status_name', 'incdnt_type_lvl_1_name', 'org_struct_lvl_2_name', 'org_struct_lvl_3_name',
                         'org_struct_lvl_4_name', 'incdnt_autoreg_flag']) AS col,
                 unnest([incdnt_status_name, incdnt_type_lvl_1_name, org_struct_lvl_2_name, org_struct_lvl_3_name,
                         org_struct_lvl_4_name, incdnt_autoreg_flag]) AS value FROM incident)
    GROUP BY col""", ("incident",))
def enum_values(v):
    df = v.incident
    return c.enum_values(df, c.enum_candidates(df), "incident").withColumn(
        "enum_values", F.array_join("enum_values", "|")
    )
