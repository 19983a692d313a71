"""Lines with one order and line number: the first in the table gives the place, as in the SQL read in order."""

import shutil

import duckdb
import pandas as pd
import pytest

from sievewright.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "lineitem nation part supplier".split()


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Every line twice, one right after the other for odd orders, far apart for even ones, from different nations."""
    folder = tmp_path_factory.mktemp("tied")
    for t in TABLES[1:]:
        shutil.copyfile(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
    c = duckdb.connect()
    c.execute("SET threads = 1")
    lines = c.execute(f"SELECT * FROM '{SF}/lineitem.parquet'").df()
    again = lines.assign(l_suppkey=(lines.l_suppkey + 1) % (lines.l_suppkey.max() + 1))
    odd = lines.l_orderkey % 2 == 1
    near = pd.concat([lines, again[odd]]).sort_index(kind="stable")
    pd.concat([near, again[~odd]]).to_parquet(folder / "lineitem.parquet", row_group_size=1000, index=False)
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", ["a04_facets", "e09_numbered", "i03_df_idf", "i05_ltc_weights", "s07_listing_file", "t18_location"])
def test_first_of_tied_lines(spark, tied, name):
    folder, c = tied
    got, want = QUERIES[name](spark, folder).toPandas(), c.execute(ORACLES[name]).df()
    plain = lambda frame: sorted(map(repr, frame[sorted(want.columns)].itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


def test_lines_without_a_key_give_no_place(spark, tied, tmp_path):
    folder, c = tied
    for t in TABLES[1:]:
        shutil.copyfile(f"{folder}/{t}.parquet", tmp_path / f"{t}.parquet")
    c.execute(f"COPY (SELECT * REPLACE (CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_orderkey END AS l_orderkey) FROM '{folder}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got = {r.id: r.place for r in QUERIES["t18_location"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as d:
        d.execute("SET threads = 1")
        for t in TABLES:
            d.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        assert got == dict(d.execute(ORACLES["t18_location"]).fetchall())
