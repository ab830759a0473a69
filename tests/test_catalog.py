"""Every plan gives the rows that DuckDB gives for its SQL."""

import duckdb
import pytest

from pathloom.plans import catalog, fits, studies, walks

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(df):
    return sorted(tuple("" if x is None or x != x else f"{x + 0.0:.5g}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_plan(spark, duck, name):
    ours, theirs = catalog.queries()[name](spark, DATA).toPandas(), duck.execute(catalog.text(name, True)).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def got(spark, name):
    """A query over the published example graph."""
    whole = getattr(walks, name, None)
    return (whole(spark, DATA, True) if whole else catalog.frame(name, spark, DATA, True)).toPandas()


@pytest.mark.parametrize("name", list(walks.SQL))
def test_walks(spark, duck, name):
    ours, theirs = walks.queries()[name](spark, DATA).toPandas(), duck.execute(walks.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", [*studies.SQL, *fits.SQL])
def test_studies(spark, duck, name):
    known, sql = studies.queries() | fits.queries(), studies.oracle_sql() | fits.oracle_sql()
    assert rows(known[name](spark, DATA).toPandas()) == rows(duck.execute(sql[name]).df())


def test_published_graph_figures(spark):
    assert len(got(spark, "ancestors")) == 8 and len(got(spark, "parents")) == 3
    assert len(got(spark, "descendants")) == 11
    assert len(got(spark, "children_siblings")) == 5
    freq = got(spark, "all_pairs_reachable_len_freq").set_index("d")["n"].to_dict()
    assert freq == {1: 18, 2: 11, 3: 6, 4: 1}
    assert len(got(spark, "missing_edges_basis_set")) == 37
    assert len(got(spark, "model_text")) == 19 and got(spark, "acyclic_check").set_index("graph")["n_cyclic"]["signal"] == 0
    levels = got(spark, "merged_levels").set_index("name")["level"].to_dict()
    assert {v for v, k in levels.items() if k == 0} == {"Jnk", "P38", "Akt", "Erk"} and levels["Mek"] == 1 and levels["PKA"] == levels["PIP3"] == 6
