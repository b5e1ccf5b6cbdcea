"""The exchange over several levels: equal keys are added up on the way, and answers are the same."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import blocks
from tidemark.llm.blocks import mixed, rows_of, totals

DOCS = 240


def asked(number):
    """The keys of a block: one that all blocks have, some of many, one of its own; and their counts."""
    keys = np.array([7, *(100 + (number + k) % 40 for k in range(10)), 10_000 + number], np.uint64)
    return [mixed(keys), np.arange(1, len(keys) + 1).astype(np.uint64)]


def entries(columns, shard):
    """An answer with each key's total; as its report, the most entries that any key has in this shard."""
    _, total, which = totals(columns[:1], columns[1])
    return [total[which]], len(total), int(np.bincount(which).max()), None


@pytest.mark.parametrize("keys", [0, 1])
def test_equal_keys_are_added_up_where_they_are_merged(spark, monkeypatch, keys):
    for name, value in (("FAN", 3), ("MERGED_KEYS", 60), ("MERGED_SHARDS", 2)):
        monkeypatch.setattr(blocks, name, value)
    route = blocks.Route(blocks.first_column, 25)
    table = spark.range(DOCS, numPartitions=4).withColumnRenamed("id", "block")
    got = blocks.exchange(table, lambda row: asked(row["block"]), route, entries, "test", keys=keys)

    def read(batches):
        for row in rows_of(batches):
            yield pa.RecordBatch.from_pydict({"block": [row["block"]], "totals": [route.returned(row["back"], asked(row["block"]))[0].tolist()]}, pa.schema([("block", pa.int64()), ("totals", pa.list_(pa.int64()))]))

    want = {}
    for number in range(DOCS):
        for key, n in zip(*(c.tolist() for c in asked(number)), strict=True):
            want[key] = want.get(key, 0) + n
    rows = blocks.with_replies(table, {"back": got}).mapInArrow(read, "block long, totals array<long>").collect()
    assert len(rows) == DOCS
    assert all(r.totals == [want[k] for k in asked(r.block)[0].tolist()] for r in rows)
    report = got.where(F.col("row") == blocks.REPORT).agg(F.sum("keys").alias("keys"), F.max("total").alias("most")).first()
    assert report["keys"] == len(want)
    assert report["most"] == DOCS if not keys else report["most"] < DOCS // 4
