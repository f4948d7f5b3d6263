"""The expectation catalogue: names, levels, dimensions, arguments.

Fixed values.  The expectation names, the ids 1-26, levels, dimensions, check
types, column types, and argument names and defaults are what stored rules
refer to.  Expectations beyond 26 carry ids of our own.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import find_column
from plumbline.functions.local import small_frame
from plumbline.operators import aggregate, custom, grouped, recon, row, schema, typecheck, volume
from plumbline.operators.spec import Spec
from plumbline.rule import Rule, RuleError


@dataclass(frozen=True)
class Columns:
    """Columns an expectation may be configured on: the stored words for them, and their Spark types."""

    words: str
    types: tuple[type[T.DataType], ...]

    def of(self, df: DataFrame) -> list[str]:
        return [f.name for f in df.schema.fields if isinstance(f.dataType, self.types)]


_TEXTS = (T.StringType, T.CharType, T.VarcharType)
ANY = Columns("ALL", (T.DataType,))
NUMERIC = Columns("NUMBER, FLOAT", (T.NumericType,))
TEXT = Columns("TEXT, VARCHAR", _TEXTS)
TEXT_OR_NUMBER = Columns("TEXT, VARCHAR, NUMBER, FLOAT", (*_TEXTS, T.NumericType))
TIME = Columns("TIMESTAMP_LTZ, TIMESTAMP_NTZ", (T.TimestampType, T.TimestampNTZType))


@dataclass(frozen=True)
class Argument:
    name: str
    mandatory: bool = False
    default: str | None = None


@dataclass(frozen=True)
class Header:
    """What a rule's column in the pivot says of its arguments: ``CATEGORY(value_value)``."""

    category: str
    arguments: tuple[tuple[str, str], ...]

    def text(self, kwargs: dict) -> str:
        return f"{self.category}({'_'.join(str(kwargs.get(name, absent)) for name, absent in self.arguments)})"


def _bounds(category: str) -> Header:
    return Header(category, (("min_value", "MIN"), ("max_value", "MAX")))


@dataclass(frozen=True)
class Expectation:
    expectation_id: int
    name: str
    dimension: str
    check_type: str
    check_level: str
    columns: Columns | None
    arguments: tuple[Argument, ...]
    build: Callable[..., Spec]
    header: Header | None = None

    @property
    def expected_datatype(self) -> str | None:
        return self.columns and self.columns.words


def _args(mandatory: str, optional: str = "") -> tuple[Argument, ...]:
    """Arguments from two lists of words; ``name=value`` states a default."""
    out = [Argument(word, True) for word in mandatory.split()]
    for word in optional.split():
        name, _, default = word.partition("=")
        out.append(Argument(name, False, default or None))
    return tuple(out)


STRICT = "strict_min=FALSE strict_max=FALSE"
RANGE = _args("column min_value max_value", STRICT)
OPEN_RANGE = _args("column", "min_value max_value " + STRICT)

EXPECTATIONS = (
    Expectation(1, "expect_column_values_to_be_null", "COMPLETENESS", "NULL_CHECK", "ROW", ANY,
                _args("column", "mostly"), row.values_null),
    Expectation(2, "expect_column_values_to_not_be_null", "COMPLETENESS", "NOT_NULL_CHECK", "ROW", ANY,
                _args("column", "mostly"), row.values_not_null),
    Expectation(3, "expect_table_row_count_to_be_between", "VOLUME", "ROW_COUNT_RANGE", "TABLE", None,
                _args("min_value max_value", STRICT), volume.row_count_between),
    Expectation(4, "expect_table_row_count_to_equal_other_table", "VOLUME", "ROW_COUNT_MATCH", "TABLE", None,
                _args("source_table",
                      "source_database source_schema other_dataset_name scd_type=0 partition_keys "
                      "active_flag_col=IS_ACTIVE active_value=Y inactive_value=N "
                      "core_insert_date_col=INSERT_DATE_TIME conformed_update_date_col=UPDATE_DATE_TIME "
                      "conformed_insert_date_col recon_mode=incremental"),
                recon.row_count_equal_other_table),
    Expectation(5, "expect_column_values_to_be_recent", "FRESHNESS", "FRESHNESS_CHECK", "TABLE", TIME,
                _args("column freshness_threshold_value freshness_threshold_unit", "timezone=UTC now"),
                aggregate.values_recent),
    Expectation(6, "expect_column_to_exist", "SCHEMA", "COLUMN_EXISTS", "SCHEMA", None,
                _args("column", "column_index"), schema.column_exists),
    Expectation(7, "expect_column_values_to_be_of_type", "SCHEMA", "DATA_TYPE_CHECK", "SCHEMA", ANY,
                _args("column type_", "mostly"), typecheck.values_of_type,
                Header("DATATYPE_CHECK", (("type_", "UNKNOWN"),))),
    Expectation(8, "expect_table_column_count_to_be_between", "SCHEMA", "COLUMN_COUNT_RANGE", "SCHEMA", None,
                _args("min_value max_value", STRICT), schema.column_count_between),
    Expectation(9, "expect_table_columns_to_match_set", "SCHEMA", "COLUMN_SET_MATCH", "SCHEMA", None,
                _args("column_set", "exact_match=TRUE"), schema.columns_match_set),
    Expectation(10, "expect_column_values_to_be_between", "NUMERIC", "RANGE_CHECK", "ROW", NUMERIC,
                _args("column min_value max_value", STRICT + " mostly"), row.values_between, _bounds("RANGE_CHECK")),
    Expectation(11, "expect_column_max_to_be_between", "NUMERIC", "MAX_RANGE_CHECK", "AGGREGATE", NUMERIC,
                RANGE, aggregate.maximum_between),
    Expectation(12, "expect_column_mean_to_be_between", "NUMERIC", "MEAN_RANGE_CHECK", "AGGREGATE", NUMERIC,
                RANGE, aggregate.mean_between),
    Expectation(13, "expect_column_median_to_be_between", "NUMERIC", "MEDIAN_RANGE_CHECK", "AGGREGATE", NUMERIC,
                RANGE, aggregate.median_between),
    Expectation(14, "expect_column_min_to_be_between", "NUMERIC", "MIN_RANGE_CHECK", "AGGREGATE", NUMERIC,
                RANGE, aggregate.minimum_between),
    Expectation(15, "expect_column_pair_values_a_to_be_greater_than_b", "NUMERIC", "COL_PAIR_COMPARE", "ROW", NUMERIC,
                _args("column_A column_B", "or_equal ignore_row_if=neither mostly"), row.pair_a_greater_than_b),
    Expectation(16, "expect_column_stdev_to_be_between", "NUMERIC", "STDEV_RANGE_CHECK", "AGGREGATE", NUMERIC,
                RANGE, aggregate.stdev_between),
    Expectation(17, "expect_column_sum_to_be_between", "NUMERIC", "SUM_RANGE_CHECK", "AGGREGATE", NUMERIC,
                RANGE, aggregate.sum_between),
    Expectation(18, "expect_column_value_lengths_to_be_between", "VALIDITY", "LENGTH_CHECK", "ROW", TEXT_OR_NUMBER,
                _args("column min_value max_value", STRICT + " mostly"), row.lengths_between, _bounds("LENGTH_CHECK")),
    Expectation(19, "expect_column_values_to_match_regex", "VALIDITY", "PATTERN_MATCH", "ROW", TEXT,
                _args("column regex", "mostly"), row.matches_regex),
    Expectation(20, "expect_column_values_to_not_match_regex", "VALIDITY", "PATTERN_EXCLUSION", "ROW", TEXT,
                _args("column regex", "mostly"), row.not_matches_regex),
    Expectation(21, "expect_column_values_to_be_in_set", "CONFORMITY", "SET_INCLUSION", "ROW", TEXT_OR_NUMBER,
                _args("column value_set", "mostly"), row.values_in_set),
    Expectation(22, "expect_column_values_to_not_be_in_set", "VALIDITY", "SET_EXCLUSION", "ROW", TEXT_OR_NUMBER,
                _args("column value_set", "mostly"), row.values_not_in_set),
    Expectation(23, "expect_column_unique_value_count_to_be_between", "UNIQUENESS", "UNIQUE_COUNT_RANGE", "AGGREGATE", ANY,
                RANGE, grouped.unique_count_between),
    Expectation(24, "expect_column_values_to_be_unique", "UNIQUENESS", "UNIQUENESS_CHECK", "ROW", ANY,
                _args("column", "mostly"), grouped.values_unique),
    Expectation(25, "unexpected_rows_expectation", "SQL", "CUSTOM_RULE", "ROW", None,
                _args("unexpected_rows_query", "profile_columns"), custom.unexpected_rows),
    Expectation(26, "expect_table_row_count_to_equal_source_file", "VOLUME", "SOURCE_FILE_COUNT_MATCH", "TABLE", None,
                _args("", "audit_control_table sync_level=SOURCE_TO_CORE target_table target_table_col "
                          "source_count_col target_count_col sync_date_col"),
                recon.row_count_equal_source_file),
    # Ids from here on are ours.
    Expectation(27, "expect_compound_columns_to_be_unique", "UNIQUENESS", "COMPOUND_COLUMNS_TO_BE_UNIQUE", "ROW", ANY,
                _args("column_list", "ignore_row_if=NEVER mostly"), grouped.compound_unique),
    Expectation(28, "expect_select_column_values_to_be_unique_within_record", "UNIQUENESS",
                "UNIQUE_VALUES_WITHIN_RECORD_CHECK", "ROW", ANY,
                _args("column_list", "ignore_row_if=NEVER mostly failed_row_count=20"), row.unique_within_record),
    Expectation(29, "expect_column_values_to_match_like_pattern_list", "VALIDITY", "REGEX_MATCH_LIST_CHECK", "ROW", TEXT,
                _args("column regex_list", "match_on=ANY mostly"), row.matches_regex_list),
    Expectation(30, "expect_column_values_to_not_match_regex_list", "VALIDITY", "REGEX_NOT_MATCH_LIST_CHECK", "ROW", TEXT,
                _args("column regex_list", "match_on=ANY mostly"), row.not_matches_regex_list),
    Expectation(31, "expect_column_value_lengths_to_equal", "VALIDITY", "VALUE_LENGTH_EQUAL_CHECK", "ROW", TEXT_OR_NUMBER,
                _args("column value", "mostly"), row.lengths_equal),
    Expectation(32, "expect_column_pair_values_to_be_equal", "CONFORMITY", "COLUMN_PAIR_EQUAL_CHECK", "ROW", ANY,
                _args("column_A column_B", "ignore_row_if=both_values_are_missing mostly"), row.pair_equal),
    Expectation(33, "expect_column_pair_values_to_be_in_set", "CONFORMITY", "COLUMN_PAIR_IN_SET_CHECK", "ROW", ANY,
                _args("value_pairs_set", "column_A column_B column_list ignore_row_if=both_values_are_missing mostly"),
                row.pair_in_set),
    Expectation(34, "expect_multicolumn_sum_to_equal", "NUMERIC", "MULTI_COL_SUM_CHECK", "ROW", NUMERIC,
                _args("column_list sum_total", "ignore_row_if=neither mostly"), row.multicolumn_sum),
    Expectation(35, "expect_column_value_z_scores_to_be_less_than", "NUMERIC", "COLUMN_VALUE_Z_SCORES_TO_BE_LESS_THAN",
                "ROW", NUMERIC, _args("column threshold", "double_sided=FALSE mostly failed_row_count=20"),
                row.z_scores_below),
    Expectation(36, "expect_column_values_to_be_in_given_format", "VALIDITY", "DATE_FORMAT_CHECK", "ROW", TEXT,
                _args("column format", "mostly"), row.in_given_format),
    Expectation(37, "expect_column_proportion_of_unique_values_to_be_between", "UNIQUENESS",
                "PROPORTION_UNIQUE_VALUE_BETWEEN_CHECK", "AGGREGATE", ANY, OPEN_RANGE,
                grouped.unique_proportion_between),
    Expectation(38, "expect_column_proportion_of_non_null_value_to_be_between", "COMPLETENESS",
                "PROPORTIONAL_NULL_CHECK", "AGGREGATE", ANY, OPEN_RANGE, aggregate.non_null_proportion_between),
    Expectation(39, "expect_column_most_common_value_to_be_in_set", "CONFORMITY", "COMMON_VALUE_IN_SET", "AGGREGATE", ANY,
                _args("column value_set", "ties_okay=FALSE"), grouped.most_common_in_set),
    Expectation(40, "expect_table_column_count_to_equal", "SCHEMA", "COLUMN_COUNT_EQUAL_CHECK", "SCHEMA", None,
                _args("value"), schema.column_count_equal),
    Expectation(41, "expect_table_columns_to_match_ordered_list", "SCHEMA", "TABLE_COLUMNS_MATCH_ORDERED_LIST_CHECK",
                "SCHEMA", None, _args("column_list"), schema.columns_match_ordered_list),
    Expectation(42, "expect_column_distinct_values_to_be_in_set", "CONFORMITY", "DISTINCT_IN_SET_CHECK", "AGGREGATE", ANY,
                _args("column value_set"), grouped.distinct_in_set),
    Expectation(43, "expect_column_distinct_values_to_equal_set", "CONFORMITY", "DISTINCT_VALUES_EQUAL_SET_CHECK",
                "AGGREGATE", ANY, _args("column value_set"), grouped.distinct_equal_set),
    Expectation(44, "expect_column_distinct_values_to_contain_set", "CONFORMITY", "COLUMN_DISTINCT_VALUES_TO_CONTAIN_SET",
                "AGGREGATE", ANY, _args("column value_set"), grouped.distinct_contain_set),
    Expectation(45, "expect_table_row_count_to_equal", "VOLUME", "TABLE_ROW_COUNT_EQUAL_CHECK", "TABLE", None,
                _args("value"), volume.row_count_equal),
)

BY_NAME = {e.name.lower(): e for e in EXPECTATIONS}
BY_ID = {e.expectation_id: e for e in EXPECTATIONS}


def expectation(name: str) -> Expectation:
    """An expectation by name, without case and with or without ``expect_``."""
    key = name.strip().lower()
    found = BY_NAME.get(key) or BY_NAME.get(f"expect_{key}")
    if found is None:
        raise RuleError(f"unknown expectation {name!r}")
    return found


def validate_rule(rule: Rule, df: DataFrame | None = None) -> list[str]:
    """What is wrong with a rule's configuration; empty when it is fine."""
    try:
        known = expectation(rule.expectation)
    except RuleError as exc:
        return [str(exc)]
    kwargs = dict(rule.kwargs)
    if rule.column_name and "column" not in kwargs:
        kwargs["column"] = rule.column_name
    problems = [
        f"missing required argument {a.name}"
        for a in known.arguments
        if a.mandatory and kwargs.get(a.name) in (None, "", [])
        and not (a.name == "source_table" and kwargs.get("other_dataset_name"))
    ]
    if df is not None and known.name != "expect_column_to_exist":
        allowed = (known.columns or ANY).of(df)
        for argument in ("column", "column_A", "column_B"):
            given = kwargs.get(argument)
            if not given:
                continue
            try:
                name = find_column(df, given)
            except RuleError as exc:
                problems.append(str(exc))
                continue
            if name not in allowed:
                kind = df.schema[name].dataType.simpleString()
                problems.append(f"column {name} of type {kind} does not suit {known.name}")
    return problems


def master_frame(spark: SparkSession) -> DataFrame:
    """The catalogue as a table."""
    rows = [
        (e.expectation_id, e.name, e.dimension, e.check_type, e.check_level, e.expected_datatype, "Y", "SQL")
        for e in EXPECTATIONS
    ]
    return small_frame(
        spark,
        rows,
        "expectation_id bigint, validation_name string, dimension string, check_type string, "
        "check_level string, expected_datatype string, is_active string, dq_engine string",
    )


def mapping_frame(spark: SparkSession) -> DataFrame:
    """Which operator handles which expectation."""
    rows = [(e.check_type, e.name, e.build.__name__, "v1.0", True) for e in EXPECTATIONS]
    return small_frame(
        spark,
        rows,
        "check_type string, expectation_type string, handler string, handler_version string, "
        "is_active boolean",
    )


def arguments_frame(spark: SparkSession) -> DataFrame:
    """Arguments of every expectation."""
    rows = [
        (e.expectation_id, e.name, a.name, a.mandatory, a.default)
        for e in EXPECTATIONS
        for a in e.arguments
    ]
    return small_frame(
        spark,
        rows,
        "expectation_id bigint, expectation_name string, argument_name string, "
        "is_mandatory boolean, default_value string",
    )


# Kinds of problems that ``rule_problems`` tells.
UNKNOWN, MISSING, NO_COLUMN, WRONG_TYPE = "unknown expectation", "missing argument", "unknown column", "column type"
_COLUMN_ARGUMENTS = ("column", "column_A", "column_B")


def schema_frame(spark: SparkSession, datasets: dict[int, DataFrame]) -> DataFrame:
    """``dataset_id, key, suits`` of every column: its name in lower case, the stored words it satisfies."""
    kinds = (ANY, NUMERIC, TEXT, TEXT_OR_NUMBER, TIME)
    rows = [
        (i, f.name.lower(), [k.words for k in kinds if isinstance(f.dataType, k.types)])
        for i, df in datasets.items()
        for f in df.schema.fields
    ]
    return small_frame(spark, rows, "dataset_id bigint, key string, suits array<string>")


def rule_problems(rules: DataFrame, columns: DataFrame) -> DataFrame:
    """``rule_config_id, problem, detail`` of all that is wrong with stored rules.

    ``rules`` has ``rule_config_id, dataset_id, expectation_name, kwargs, column_name``,
    ``columns`` comes from ``schema_frame``.  Any number of rules is judged at once;
    the catalogue's side of the joins has a few rows an expectation.
    """
    spark = rules.sparkSession
    names = [(n, e) for e in EXPECTATIONS for n in {e.name.lower(), e.name.lower().removeprefix("expect_")}]
    known = small_frame(spark, [(n, e.name, e.expected_datatype) for n, e in names], "name string, expectation string, words string")
    needed = small_frame(
        spark, [(n, a.name) for n, e in names for a in e.arguments if a.mandatory], "name string, argument string"
    )
    given = F.coalesce(F.from_json("kwargs", "map<string,string>"), F.create_map().cast("map<string,string>"))
    own = F.when(F.map_contains_key("given", F.lit("column")), F.col("given")["column"]).otherwise(F.col("column_name"))
    held = (
        rules.select("rule_config_id", "dataset_id", "column_name", F.lower(F.trim("expectation_name")).alias("name"), given.alias("given"))
        .withColumn("column", own)
        .select("rule_config_id", "dataset_id", "name", "given", "column")
    )

    def told(rows: DataFrame, problem: str, detail) -> DataFrame:
        return rows.select("rule_config_id", F.lit(problem).alias("problem"), detail.alias("detail"))

    argument = F.when(F.col("argument") == "column", F.col("column")).otherwise(F.col("given")[F.col("argument")])
    instead = (F.col("argument") == "source_table") & (F.coalesce(F.col("given")["other_dataset_name"], F.lit("")) != "")
    lacking = held.join(F.broadcast(needed), "name").where(F.coalesce(argument, F.lit("")).isin("", "[]") & ~instead)
    asked = (
        held.join(F.broadcast(known), "name")
        .where(F.col("expectation") != "expect_column_to_exist")
        .select(
            "rule_config_id", "dataset_id", "words",
            F.explode(F.array("column", *[F.col("given")[a] for a in _COLUMN_ARGUMENTS[1:]])).alias("asked"),
        )
        .where(F.coalesce(F.col("asked"), F.lit("")) != "")
        .withColumn("key", F.lower("asked"))
        .join(columns, ["dataset_id", "key"], "left")
    )
    unsuited = F.col("words").isNotNull() & ~F.array_contains("suits", F.col("words"))
    return (
        told(held.join(F.broadcast(known), "name", "left_anti"), UNKNOWN, F.col("name"))
        .unionByName(told(lacking, MISSING, F.col("argument")))
        .unionByName(told(asked.where(F.col("suits").isNull()), NO_COLUMN, F.col("asked")))
        .unionByName(told(asked.where(F.col("suits").isNotNull() & unsuited), WRONG_TYPE, F.col("asked")))
    )
