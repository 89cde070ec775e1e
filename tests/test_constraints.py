"""The sample tables hold rows that keep and rows that break each rule."""

import duckdb
import pytest

from sigmill.operators import constraints as C

TABLES = C.RULES | C.CONTRACTS


@pytest.mark.parametrize("name", sorted(TABLES))
def test_samples_keep_and_break_each_rule(name):
    rules = TABLES[name]
    columns = ", ".join(f"{sql} AS {c}" for c, sql in C.sample_sql(rules, "k").items())
    for rule in rules:
        condition = C.condition(rule, "regexp_matches")
        broken, kept = duckdb.sql(f"SELECT count(*) FILTER (WHERE NOT ({condition})), count(*) FILTER (WHERE {condition}) FROM (SELECT {columns} FROM (SELECT range AS k FROM range(60000)))").fetchall()[0]
        assert broken and kept, rule[0]


def test_rule_names_are_unique():
    assert sum(map(len, C.RULES.values())) == 110
    for rules in TABLES.values():
        assert len({r[0] for r in rules}) == len(rules)


def test_counts(spark):
    rows = spark.createDataFrame([("BUY", "LIMIT", None), ("HOLD", "LIMIT", 5), (None, "MARKET", 5)], "action string, order_type string, price_krw int")
    rules = [r for r in C.RULES["consultation_cards"] if r[0] in ("action_value", "market_order_without_price", "limit_order_requires_price")]
    assert {r.rule: r.violations for r in C.check(rows, "cards", rules).collect()} == {"action_value": 1, "market_order_without_price": 1, "limit_order_requires_price": 1}
