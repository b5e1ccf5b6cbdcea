"""Typed columns from JSON against Python's own reading of it."""

import json
from decimal import Decimal

from tidemark.operators import shredding

TEXTS = [
    '{"k": 1, "name": "a", "mixed": 1, "price": 1.5, "yes": true, "list": [1, 2]}',
    '{"k": 9007199254740993, "name": "", "mixed": "x", "price": 20, "K": 7}',
    '{"k": null, "price": 0.25, "odd \\"name\'] $": 3, "inner": {"a": [null]}}',
    "{}", "", "{bad", '{"k": 1', '{"k": 1, "k": 2}', "5", "[1, 2]", "null", '"text"', None,
    '{"k": 1, "name": "a", "mixed": 1, "price": 1.5, "yes": true, "list": [1, 2]}',
]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "mine", "y") for i, t in enumerate(texts)], "id long, props string, rest string, P_NAME string")


def test_fields_get_the_type_that_they_share(spark):
    found = dict(shredding.fields(rows_of(spark, TEXTS), "props"))
    assert found["k"] == "BIGINT" and found["name"] == "STRING" and found["yes"] == "BOOLEAN" and found["mixed"] == "VARIANT"
    assert found["price"].startswith("DECIMAL") and found["list"] == "ARRAY<BIGINT>" and set(found) == {"k", "K", "name", "mixed", "price", "yes", "list", 'odd "name\'] $', "inner"}


def test_every_value_is_in_its_column_or_the_rest(spark):
    """With all fields as columns and with two of them, and with names that are taken."""
    for most in (100, 2):
        df = rows_of(spark, TEXTS)
        names = [n for n, _ in shredding.fields(df, "props", most)]
        assert len(names) == min(most, 9)
        got = {r.id: r for r in shredding.shredded(df, "props", most=most).repartition(3).collect()}
        assert len(got) == len(TEXTS) and all(r.rest == "mine" and r.P_NAME == "y" for r in got.values())
        assert [i for i in got if got[i].malformed] == [i for i in got if TEXTS[i] in ("", "{bad", '{"k": 1', '{"k": 1, "k": 2}')]
        taken = {"id", "rest", "p_name", "rest_2", "malformed"}
        columns = {n: shredding.free("p_" + n, taken) for n in names}
        for i, r in got.items():
            try:
                value = json.loads(TEXTS[i])
            except (ValueError, TypeError):
                value = None
            if not isinstance(value, dict) or r.malformed:
                assert r.rest_2 == TEXTS[i] and all(r[c] is None for c in columns.values())
                continue
            others = {k: v for k, v in value.items() if k not in names}
            assert (json.loads(r.rest_2) if r.rest_2 is not None else {}) == others
            for n, c in columns.items():
                here, want = r[c], value.get(n)
                if n in ("mixed", "list", "inner"):
                    assert (json.loads(here) if here is not None else None) == want
                else:
                    assert (None if here is None else float(here) if isinstance(here, Decimal) else here) == want


def test_nothing(spark):
    for texts in ([], [None], ["{bad"]):
        out = shredding.shredded(rows_of(spark, texts), "props")
        assert out.columns == ["id", "rest", "P_NAME", "rest_2", "malformed"] and out.count() == len(texts)
