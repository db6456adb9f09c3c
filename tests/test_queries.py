import duckdb
import pytest

from palaver.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    """Over the size at which accents stand next to matches and folds have depth."""
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{LARGER}/{t}.parquet'")
    return c


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, LARGER)
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rounded(tuple(r) for r in df.select(*names).collect()) == rounded(got.fetchall())


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ORACLES])
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
