import duckdb
import pandas as pd
import pytest

from pairlens.operators import pools, retrieval
from pairlens.plans import book, catalog, evidence

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in book.TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    order = sorted(want.columns)
    plain = lambda x: None if pd.isna(x) else round(x, 5) if isinstance(x, float) else x
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[order].values.tolist()), key=str)
    assert rows(got) == rows(want)


def _pairs(spark, subjects):
    rows = [(s, t, *(float(s + i + len(t)) for i in range(8))) for s in range(subjects) for t in ("F", "O")]
    names = ", ".join(f"{k}_{c} double" for c in retrieval.FEATURES for k in "xy")
    return spark.createDataFrame(rows, f"subject int, task string, {names}")


def test_a_single_subject_and_empty_tables_give_no_rows(spark):
    for n in (0, 1):
        ranked = retrieval.ranked_candidates(_pairs(spark, n))
        assert ranked.count() == 0 and retrieval.subject_left_out(ranked).count() == 0
        assert pools.pool_scores(_pairs(spark, n)).count() == 0
    assert retrieval.ranked_candidates(_pairs(spark, 3)).count() == 18


def test_scale_is_sample_deviation_of_both_states_of_other_subjects(spark):
    got = {r.subject: r for r in retrieval.fold_scale(_pairs(spark, 3)).collect()}
    rows = [r.asDict() for r in _pairs(spark, 3).collect()]
    values = pd.Series([v for r in rows if r["subject"] != 1 for v in (r["x_price"], r["x_price"] + r["y_price"])])
    assert abs(got[1].m_price - values.mean()) < 1e-9 and abs(got[1].d_price - values.std(ddof=1)) < 1e-9


@pytest.mark.parametrize("name", ["state_pairs", "matched_pool", "fold_scaler", "query_failures", "burst_runs", "bids_entities"])
def test_relations_over_empty_tables_have_no_rows(spark, tmp_path, name):
    for t in book.TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert book.run(spark, str(tmp_path), name, evidence.BOOK).count() == 0


def test_macros_nest():
    assert book.expand("COUNT_OF(DIGITS(SWAP(a, '(', 'b')))", False) == "len(list_sort(list_distinct(regexp_extract_all(regexp_replace(a, '(', 'b', 'g'), '([0-9])', 1))))"
    assert book.render("a", {"a": "select 0.5 as x, 'v1.5' as y, {b}.z from {b}", "b": "select 2.25 as z"}, False) == "with b as (select 2.25e0 as z) select 0.5e0 as x, 'v1.5' as y, b.z from b"
