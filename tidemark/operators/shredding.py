"""A column of JSON objects as typed columns, by the types that its values turn out to have.

One aggregate over the parsed rows gives each field's common type and in how many rows it
stands.  The ``most`` most frequent fields (ties: the smaller name) become columns; only their
names and types reach the driver, and no row is lost by that bound: what the other fields hold
stays in the column of the rest, as JSON.

Defined cases: a field whose values are whole numbers, decimals, doubles, booleans or strings gets
that type, the widest one that they share; values of several types, arrays and objects are kept as
JSON text; a JSON null and a missing field are null; text that is no JSON, an object with a repeated field
included, is marked malformed and kept as the rest; JSON that is no object is kept as the rest; null
stays null and is not malformed; columns of names that are taken, upper and lower case being alike, get
a number; an empty table has no fields.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 100
SCALAR = re.compile(r"BIGINT|DOUBLE|BOOLEAN|STRING|DECIMAL\(\d+,\d+\)")
FIELDS = "__tm_fields"


def parsed(df: DataFrame, column: str) -> DataFrame:
    """df with the fields of the object in the column, as a map of variants; null if it is none."""
    value = F.try_parse_json(F.col(column))
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    return df.withColumn(FIELDS, F.when(is_object, value.try_cast("map<string,variant>")))


def fields(df: DataFrame, column: str, most: int = MOST) -> list[tuple[str, str]]:
    """Names and types of the most frequent fields."""
    each = parsed(df.select(column), column).select(F.explode(FIELDS).alias("name", "value"))
    found = each.groupBy("name").agg(F.expr("schema_of_variant_agg(value)").alias("type"), F.count("*").alias("n"))
    return [(r["name"], r["type"]) for r in found.orderBy(F.desc("n"), "name").limit(most).collect()]


def free(name: str, taken: set[str]) -> str:
    out, k = name, 2
    while out.lower() in taken:
        out, k = f"{name}_{k}", k + 1
    taken.add(out.lower())
    return out


def shredded(df: DataFrame, column: str, prefix: str = "p_", rest: str = "rest", malformed: str = "malformed", most: int = MOST) -> DataFrame:
    """df without the column, and with a column for each frequent field, the rest and whether the text is malformed."""
    found = fields(df, column, most)
    names = [c for c in df.columns if c != column]
    taken = {c.lower() for c in names}
    rest, malformed = free(rest, taken), free(malformed, taken)
    typed = {}
    for name, kind in found:
        value = F.try_element_at(F.col(FIELDS), F.lit(name))
        typed[free(prefix + name, taken)] = F.try_variant_get(value, "$", kind) if SCALAR.fullmatch(kind) else F.when(~F.is_variant_null(value), F.to_json(value))
    others = F.map_filter(FIELDS, lambda k, v: ~k.isin([n for n, _ in found])) if found else F.col(FIELDS)
    left = F.when(F.col(FIELDS).isNull(), F.col(column)).when(F.size(others) > 0, F.to_json(others))
    bad = F.col(column).isNotNull() & F.try_parse_json(F.col(column)).isNull()
    out = [F.col(f"`{c}`") for c in names] + [v.alias(k) for k, v in typed.items()] + [left.alias(rest), bad.alias(malformed)]
    return parsed(df, column).select(*out)
