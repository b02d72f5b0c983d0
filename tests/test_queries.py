"""Every registered query of the library against its SQL on DuckDB."""

import uuid

import duckdb
import pytest

from vigilake.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return own


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, sf, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    assert name in ORACLE_SQL
    own = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in own.description]
    assert sorted(names) == columns
    expected = sorted((tuple(dict(zip(names, row, strict=True))[c] for c in columns) for row in own.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["term", "n_docs"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_reports_of_dimensions_are_written_once(spark, sf, tmp_path, monkeypatch):
    from vigilake.plans import QUERIES, report_queries

    def counted(prompts):
        (tmp_path / f"{prompts[0]}-{uuid.uuid4().hex}").touch()
        return dimension_writer(prompts)

    dimension_writer = report_queries.dimension_writer
    monkeypatch.setattr(report_queries, "dimension_writer", counted)
    got = QUERIES["report_dimensions"](spark, sf).collect()
    assert len(got) == 3 * len(list(tmp_path.iterdir())) == 450
