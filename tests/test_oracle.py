"""Every registered catalog query against its SQL on the same tables."""

from pathlib import Path

import duckdb
import pytest

from swarmlake.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(frame):
    frame = frame[sorted(frame.columns)]
    number = lambda s: s.dtype.kind in "ifu" or str(s.dtype).startswith("Int")
    frame = frame.apply(lambda s: s.astype(float) if number(s) else s.fillna("-").astype(str))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLE_SQL:
        want = con.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got).equals(plain(want))
    else:
        assert len(got)


def test_search_of_a_token_in_many_documents(spark, tmp_path):
    """More documents than the catalog's cap of a token: the plain queries look at all."""
    text = "SELECT i AS doc_id, 'this is one of tion' AS text, i AS n_chars FROM range(11000) t(i)"
    duckdb.execute(f"COPY ({text}) TO '{tmp_path}/documents.parquet'")
    c = duckdb.connect()
    for name in ("orders", "part", "customer", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    for name in ("search_all_tokens", "search_page"):
        assert plain(registry.QUERIES[name](spark, str(tmp_path)).toPandas()).equals(plain(c.execute(registry.ORACLE_SQL[name]).df())), name
