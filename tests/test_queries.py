"""Every named query of the library against its SQL."""

import pytest
from bidloom.plans import audits, cases, classes, codes, documents, flows, layouts, live, logs, offers, rebuilds, registry, rest, reviews, rulings, scans, tender, views  # noqa: F401
from compare import connect, same_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    same_rows(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["position", "option", "total", "next_total", "n_options", "is_unique", "saving"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_visual_lines_equal_a_loop(spark):
    from bidloom.operators.sequences import clustered_lines

    items = [(1, i, y) for i, y in enumerate([0.1, 0.5, 0.105, 0.11, 0.2, 0.21, 0.5, 0.9])] + [(2, 0, 0.3)]
    want = {}
    for key in (1, 2):
        line, n, centre = 0, 0, 0.0
        for _, seq, y in sorted((r for r in items if r[0] == key), key=lambda r: (r[2], r[1])):
            if n and abs(y - centre) <= 0.01:
                centre += (y - centre) / (n + 1)
                n += 1
            else:
                line, n, centre = line + 1, 1, y
            want[key, seq] = line
    got = clustered_lines(spark.createDataFrame(items, "k int, seq long, y double"), ["k"], 0.01).collect()
    assert {(r.k, r.seq): r.line for r in got} == want
