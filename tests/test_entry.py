"""The driver's contract, and queries held against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    cell = lambda v: "NULL" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False, name=None))


def test_contract(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["claim_ledger", "review_queue", "bundle_compare", "gate_violations", "numeric_divergence", "exact_repetition", "packet_ids", "manifest_duplicates",
                                  "bucket_counts", "review_packet_index", "response_rules", "gold_metrics", "comparison_lines", "source_suggestions", "package_figures"])
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.execute(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, sf).toPandas()
    assert sorted(want.columns) == sorted(got.columns) and _rows(want) == _rows(got)
