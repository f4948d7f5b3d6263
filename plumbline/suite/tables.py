"""Test tables and the query datasets defined over them.

The SQL below is read by Spark as a custom-query dataset and by the oracle as
a subquery, so it keeps to what both dialects share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Query datasets with missing, blank, padded and non-numeric values.
DATASETS = {
    "orders_q": """
        SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderstatus,
               CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '4-NOT SPECIFIED' THEN '   '
                    ELSE o_orderpriority END AS priority,
               CASE o_orderstatus WHEN 'P' THEN ' P ' WHEN 'O' THEN NULL ELSE o_orderstatus END AS status,
               CASE WHEN o_totalprice < 100000 THEN NULL WHEN o_totalprice < 150000 THEN 'n/a'
                    WHEN o_totalprice < 160000 THEN '  '
                    ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS price_text
        FROM orders""",
    "events_q": """
        SELECT event_id, user_id, event_type, value,
               CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS paid,
               CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN value
                    ELSE value - 1 END AS due,
               CASE WHEN event_type = 'error' THEN 'unknown' WHEN event_type = 'view' THEN ' '
                    ELSE CAST(CAST(ts AS DATE) AS STRING) END AS day_text
        FROM events""",
    # Tables of the framework, read off the test tables.
    "rule_config_q": """
        SELECT p_partkey AS rule_config_id, CAST(p_size AS BIGINT) AS expectation_id,
               CAST(substr(p_brand, 7) AS BIGINT) AS dataset_id, p_name AS expectation_name,
               p_brand AS dimension, p_type AS severity, p_name AS column_name,
               CAST(NULL AS STRING) AS kwargs, CAST(NULL AS STRING) AS check_type,
               CASE p_type WHEN 'PROMO' THEN 'OTHER' WHEN 'SMALL' THEN 'sql' ELSE NULL END AS dq_engine,
               p_retailprice < 1500 AS is_active, p_size > 25 AS error_flag,
               p_brand AS created_by
        FROM part""",
    # Configured rules, right and wrong ones, over the columns of lineitem.
    "rules_q": """
        SELECT p_partkey AS rule_config_id, CAST(1 AS BIGINT) AS dataset_id, CAST(NULL AS STRING) AS column_name,
               CASE p_size % 5 WHEN 0 THEN 'expect_column_values_to_be_between'
                    WHEN 1 THEN 'column_values_to_match_regex' WHEN 2 THEN 'Expect_Column_Values_To_Be_Unique'
                    WHEN 3 THEN 'no_such_check' ELSE 'expect_column_to_exist' END AS expectation_name,
               CASE p_partkey % 4 WHEN 0 THEN concat('{"column": "l_quantity", "min_value": ', CAST(p_size AS STRING), ', "max_value": 99}')
                    WHEN 1 THEN '{"column": "L_RETURNFLAG", "regex": "x"}' WHEN 2 THEN '{"min_value": 1}'
                    ELSE '{"column": "l_nothing", "regex": ""}' END AS kwargs
        FROM part""",
    "dataset_q": """
        SELECT c_custkey AS dataset_id, c_name AS dataset_name, CAST(c_nationkey AS BIGINT) AS project_id,
               c_mktsegment AS created_by
        FROM customer""",
    "run_log_q": """
        SELECT o_orderkey AS dataset_run_id, o_custkey AS dataset_id, o_orderdate AS created_timestamp,
               CASE o_orderstatus WHEN 'F' THEN 'FAILURE' WHEN 'P' THEN 'ERROR' ELSE 'SUCCESS' END AS run_status,
               CAST(5 AS BIGINT) AS evaluated_expectations, CAST(3 AS BIGINT) AS successfull_expectations,
               CAST(2 AS BIGINT) AS unsuccessfull_expectations, o_totalprice AS success_percent,
               o_totalprice / 2 AS run_time, o_orderpriority AS created_by,
               CASE WHEN o_orderpriority = '5-LOW' THEN 'SELECTIVE' ELSE 'FULL' END AS run_scope
        FROM orders""",
    "rule_results_q": """
        SELECT l_orderkey AS dataset_run_id, l_suppkey AS dataset_id, l_partkey AS rule_config_id,
               l_returnflag AS expectation_name, l_returnflag <> 'R' AS is_success,
               CAST(l_quantity AS BIGINT) AS element_count, CAST(l_linenumber AS BIGINT) AS unexpected_count,
               l_extendedprice AS unexpected_percent, l_shipdate AS run_timestamp,
               CASE WHEN l_linestatus = 'O' THEN concat('{"core_watermark": "', CAST(l_orderkey AS STRING),
                         '", "conf_watermark": "', CAST(l_linenumber AS STRING), '"}')
                    WHEN l_returnflag = 'N' THEN concat('{"watermark": "', CAST(l_orderkey AS STRING), '"}')
                    ELSE NULL END AS observed_value
        FROM lineitem""",
    "supplier_runs_q": """
        SELECT DISTINCT l_orderkey AS dataset_run_id, l_suppkey AS dataset_id,
               CASE WHEN l_linestatus = 'O' THEN 'FULL' ELSE NULL END AS run_scope
        FROM lineitem""",
    "recon_results_q": """
        SELECT event_id AS dataset_run_id, user_id AS dataset_id, event_id AS rule_config_id,
               CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'PASS' END AS result,
               event_type AS validation_on, CAST(value AS STRING) AS core_value, ts AS audit_timestamp
        FROM events""",
    # An audit log of loads: one entry per day and status of the orders.
    "audit_log_q": """
        SELECT concat('SALES.CORE.', CASE o_orderstatus WHEN 'F' THEN 'ORDERS_CORE' WHEN 'P' THEN 'Returns_X'
                      ELSE 'CUSTOMERS_CORE' END) AS target_table,
               o_orderdate AS sync_start_date_time, 'SOURCE_TO_CORE' AS sync_level,
               count(*) AS number_of_records_source,
               count(CASE WHEN o_totalprice > 1000 THEN 1 END) AS number_of_records_target
        FROM orders GROUP BY o_orderstatus, o_orderdate""",
    # Source and history table of the customers' orders, one version per order.
    "sales_core": """
        SELECT o_custkey AS customer_id, o_orderdate AS insert_date_time, o_totalprice AS amount FROM orders""",
    "sales_history": """
        SELECT customer_id, insert_date_time, update_date_time, amount,
               CASE WHEN update_date_time = last_update THEN 'Y' ELSE 'N' END AS is_active
        FROM (SELECT o.o_custkey AS customer_id, o.o_orderdate AS insert_date_time,
                     o.o_orderdate AS update_date_time, o.o_totalprice AS amount, t.last_update
              FROM orders o JOIN (SELECT o_custkey, max(o_orderdate) AS last_update FROM orders
                                  GROUP BY o_custkey) t ON o.o_custkey = t.o_custkey) v""",
    "sales_current": """
        SELECT o_custkey AS customer_id, max(o_orderdate) AS update_date_time
        FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey""",
    "sales_changes": """
        SELECT customer_id, update_date_time, is_active FROM (
            SELECT o_custkey AS customer_id, o_orderdate AS update_date_time,
                   CASE WHEN o_orderstatus = 'F' THEN 'N' ELSE 'Y' END AS is_active FROM orders) c""",
}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temp views of the test tables, for query datasets."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, or a query dataset over them."""
    if name in DATASETS:
        for table in TABLES:
            if table in DATASETS[name]:
                spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return spark.sql(DATASETS[name])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(name: str) -> str:
    """What the oracle reads for a table or query dataset."""
    return f"({DATASETS[name]})" if name in DATASETS else name
