"""Every query of the engine against its SQL on the smallest tables."""

import pytest

from tagweave.plans import catalogue

DIR = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.6g}") if value == value else "nan"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), sorted(columns)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, DIR)
    got = rows_of([tuple(r) for r in frame.collect()], frame.columns)
    if name in catalogue.SQL:
        cursor = duck.execute(catalogue.SQL[name])
        assert got == rows_of(cursor.fetchall(), [c[0] for c in cursor.description])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
