"""Every registered query against its SQL on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from ledgerleaf import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def normal(rows):
    def one(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


KINDS = {"bigint": {"BIGINT", "HUGEINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = [tuple(r[c] for c in names) for r in df.collect()]
    assert rows
    if name not in registry.SQL:
        return
    want = duck.sql(registry.SQL[name])
    assert sorted(want.columns) == names
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert normal(rows) == normal(want.select(*[f'"{c}"' for c in names]).fetchall())
    assert {c: k for c, k in df.dtypes if kinds[c] not in KINDS[k]} == {}, kinds


def test_flagship(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 1
