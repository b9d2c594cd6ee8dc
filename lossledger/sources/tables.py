"""Scans of the supplied tables and the incident-shaped views over them.

Money is cast to decimal at the scan, so sums are exact and do not depend on
the order in which partitions are merged.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import MONEY

# Declared schemas: a scan needs no job of its own to read file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLE_NAMES = tuple(SCHEMAS)


def scan(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Full scan of one table by name; projection and filters are pushed into it."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}.parquet")


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    """Full scan of a table registered in the session catalog."""
    return spark.read.table(name)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: scan(spark, path, name) for name in TABLE_NAMES}


class Views:
    """Lazy views of the incident data model; a view that is not used is never planned."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self._scans: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._scans:
            self._scans[name] = scan(self.spark, self.path, name)
        return self._scans[name]

    @cached_property
    def texts(self) -> DataFrame:
        """Documents; how finely a scan is split is the session's setting."""
        return self.table("documents")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def incident_base(self) -> DataFrame:
        """Incidents without the unit hierarchy: no join."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("incdnt_id"),
            F.concat(F.lit("EVE-"), F.col("o_orderkey")).alias("incdnt_sid"),
            F.col("o_orderdate").alias("incdnt_entry_dt"),
            F.col("o_orderstatus").alias("incdnt_status_name"),
            F.col("o_orderpriority").alias("incdnt_type_lvl_1_name"),
            F.col("o_custkey").alias("risk_profile_id"),
            F.col("o_totalprice").cast(MONEY).alias("incdnt_sum"),
        )

    @cached_property
    def unit(self) -> DataFrame:
        """Customer with its place in the region hierarchy."""
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                "c_custkey",
                F.col("c_name").alias("risk_profile_name"),
                F.col("r_name").alias("org_struct_lvl_2_name"),
                F.col("c_mktsegment").alias("org_struct_lvl_3_name"),
                F.col("n_name").alias("org_struct_lvl_4_name"),
                F.when(F.col("c_acctbal") > 5000, "Y")
                .when(F.col("c_acctbal") > 0, "N")
                .alias("incdnt_autoreg_flag"),
            )
        )

    @cached_property
    def incident(self) -> DataFrame:
        return self.incident_base.join(
            self.unit, F.col("risk_profile_id") == F.col("c_custkey")
        ).drop("c_custkey")

    @cached_property
    def fin_impact(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("incdnt_id"),
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fin_impact_sid"),
            F.col("l_returnflag").alias("fin_impact_type_name"),
            F.col("l_linestatus").alias("fin_impact_kind_name"),
            F.col("l_extendedprice").cast(MONEY).alias("fin_impact_rub_amt"),
            F.col("l_shipdate").alias("fin_impact_reg_dt"),
            F.col("l_partkey").alias("fin_impact_account_num"),
            F.col("l_suppkey").alias("fin_impact_docum_num"),
        )

    @cached_property
    def recovery(self) -> DataFrame:
        return (
            self.table("lineitem")
            .filter(F.col("l_returnflag") == "A")
            .select(
                F.col("l_orderkey").alias("incdnt_id"),
                F.concat_ws("-", "l_orderkey", "l_linenumber").alias("recovery_sid"),
                F.col("l_linestatus").alias("recovery_type_name"),
                (
                    F.col("l_extendedprice").cast("decimal(12,2)")
                    * F.col("l_discount").cast("decimal(4,2)")
                ).alias("recovery_rub_amt"),
                F.col("l_shipdate").alias("recovery_reg_dt"),
                F.col("l_partkey").alias("recovery_src_account_num"),
                F.col("l_suppkey").alias("recovery_doc_num"),
            )
        )

    @cached_property
    def nonfin_impact(self) -> DataFrame:
        quantity = F.col("l_quantity")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("incdnt_id"),
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("nonfin_impact_sid"),
            F.concat("l_returnflag", "l_linestatus").alias("nonfin_impact_kind_name"),
            F.when(quantity >= 40, "very high")
            .when(quantity >= 30, "high")
            .when(quantity >= 20, "medium")
            .when(quantity >= 10, "low")
            .otherwise("none")
            .alias("nonfin_impact_influence_class_name"),
            F.col("l_partkey").alias("nonfin_part_num"),
            F.col("l_suppkey").alias("nonfin_supp_num"),
        )

    @cached_property
    def status_change(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("incdnt_id"),
            F.col("event_id").alias("stts_chng_id"),
            F.col("event_type").alias("stts_chng_action_name"),
            F.col("ts").alias("stts_chng_action_dttm"),
            F.col("props").alias("stts_chng_comment_txt"),
            F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("stts_chng_user_num"),
        )
