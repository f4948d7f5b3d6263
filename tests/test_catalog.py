"""The catalogue, rule validation, and argument parsing."""

from __future__ import annotations

import pytest

from plumbline import catalog
from plumbline.plans.rules import parse_rule_ids
from plumbline.rule import Rule, RuleError, name_list, number, parse_kwargs, value_list


def test_every_expectation_is_reachable(spark):
    assert len(catalog.EXPECTATIONS) == 45
    assert len(catalog.BY_NAME) == len(catalog.BY_ID) == 45
    master, mapping = catalog.master_frame(spark), catalog.mapping_frame(spark)
    joined = master.join(mapping, master["validation_name"] == mapping["expectation_type"])
    assert joined.count() == 45
    assert catalog.arguments_frame(spark).where("is_mandatory").count() > 45


def test_names_without_prefix_or_case():
    assert catalog.expectation("COLUMN_TO_EXIST").expectation_id == 6
    with pytest.raises(RuleError):
        catalog.expectation("column_to_vanish")


def test_validation(defects):
    def problems(name, **kwargs):
        return catalog.validate_rule(Rule(1, name, kwargs), defects)

    assert problems("expect_column_values_to_be_between", column="SCORE", min_value=0, max_value=1) == []
    assert len(problems("expect_column_values_to_be_between", column="STATUS", min_value=0)) == 2
    assert len(problems("expect_column_values_to_match_regex", column="SCORE", regex="x")) == 1
    assert len(problems("expect_column_values_to_be_recent", column="CREATED_AT", freshness_threshold_value=1,
                        freshness_threshold_unit="day")) == 0
    assert len(problems("expect_column_values_to_be_unique", column="ABSENT")) == 1
    assert problems("expect_table_row_count_to_equal_other_table", other_dataset_name="x") == []
    assert len(problems("expect_something")) == 1


def test_columns_an_expectation_suits(defects):
    assert catalog.NUMERIC.of(defects) == ["ROW_ID", "USER_ID", "SCORE", "START_VAL", "END_VAL"]
    assert catalog.TIME.of(defects) == ["CREATED_AT"]
    assert catalog.ANY.of(defects) == defects.columns
    assert catalog.BY_ID[10].expected_datatype == "NUMBER, FLOAT" and catalog.BY_ID[3].expected_datatype is None


def test_arguments():
    assert parse_kwargs(None) == {} and parse_kwargs('{"a": 1}') == {"a": 1}
    for text in ("{", "[1]"):
        with pytest.raises(RuleError):
            parse_kwargs(text)
    assert name_list({"c": "a, b ,c"}, "c") == name_list({"c": '["a","b","c"]'}, "c") == ["a", "b", "c"]
    assert value_list({"v": "[1, null]"}, "v") == [1, None]
    assert number({"n": "1.5"}, "n") == 1.5 and number({"n": "3"}, "n") == 3 and number({}, "n", 7) == 7
    assert parse_rule_ids("1, 2,") == [1, 2] and parse_rule_ids(None) == [] and parse_rule_ids("a") == []


def test_problems_of_many_rules_are_those_of_each(spark, defects):
    import json

    rules = [
        Rule(1, "expect_column_values_to_be_between", {"column": "SCORE", "min_value": 1, "max_value": 2}),
        Rule(2, "column_values_to_be_between", {"column": "status", "min_value": ""}),
        Rule(3, "expect_column_values_to_match_regex", {"regex": "x"}, column_name="nothing"),
        Rule(4, "nobody_knows", {}),
        Rule(5, "expect_column_pair_values_a_to_be_greater_than_b", {"column_A": "SCORE", "column_B": "EMAIL"}),
        Rule(6, "expect_table_row_count_to_equal_other_table", {"other_dataset_name": "b"}),
        Rule(7, "expect_table_row_count_to_equal_other_table", {}),
        Rule(8, "expect_column_to_exist", {"column": "nothing"}),
        Rule(9, "expect_column_values_to_be_in_set", {"column": "STATUS", "value_set": []}),
        Rule(10, "expect_table_columns_to_match_set", {"column_set": ["a", "b"]}),
    ]
    rows = [(r.rule_config_id, 1, r.expectation, json.dumps(r.kwargs), r.column_name) for r in rules]
    rows.append((11, 1, "expect_column_values_to_be_unique", "{not json", None))
    frame = spark.createDataFrame(
        rows, "rule_config_id long, dataset_id long, expectation_name string, kwargs string, column_name string"
    )
    found = catalog.rule_problems(frame, catalog.schema_frame(spark, {1: defects})).collect()
    for rule in rules:
        mine = [r for r in found if r["rule_config_id"] == rule.rule_config_id]
        assert len(mine) == len(catalog.validate_rule(rule, defects)), rule
    assert [(r["problem"], r["detail"]) for r in found if r["rule_config_id"] == 11] == [("missing argument", "column")]
    assert {(r["problem"], r["detail"]) for r in found if r["rule_config_id"] == 3} == {("unknown column", "nothing")}
