"""Every registered query against its DuckDB oracle on sf0.001 (the driver checks sf0.01),
plus the streaming = batch invariant."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from sondage.plans.registry import ORACLE, QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(repr(_norm(x)) for x in r) for r in pdf[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "id" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(ORACLE[name]).df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_every_query_of_the_reference_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_codec_sizes(spark, tmp_path):
    from sondage.operators.stats import codec_sizes
    from sondage.sources import fixtures as fx
    out = {r["codec"]: r for r in codec_sizes(spark, fx.raw_responses(spark, SF_SMALL), str(tmp_path / "sizes")).collect()}
    assert out["none"]["percent"] == 100.0 and 0 < out["zstd"]["bytes"] < out["none"]["bytes"]


def test_raw_store_is_written_when_asked(spark, tmp_path):
    from sondage.sources import fixtures as fx
    stored = fx.write_raw_store(spark, SF_SMALL, str(tmp_path / "store"))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, fx.raw_responses(spark, SF_SMALL).select(*stored.columns).collect()))


def test_stream_equals_batch(spark):
    from sondage.plans.build import build_flat
    from sondage.sources import fixtures as fx
    stream = entry.queries()["stream_build"](spark, SF_SMALL)
    batch = entry.queries()["processor_order"](spark, SF_SMALL)
    assert stream.count() == batch.count() == build_flat(fx.raw_responses(spark, SF_SMALL), fx.fixture_profile()).count()


def test_key_catalog_feeds_the_build(spark, tmp_path):
    from sondage.plans.build import build_flat
    from sondage.sources import fixtures as fx
    from sondage.streaming import stream as SM
    src = str(tmp_path / "landed")
    SM.land_files(fx.raw_responses(spark, SF_SMALL), src, "json", 250)
    store, cat = str(tmp_path / "store"), str(tmp_path / "keys")
    SM.ingest_stream(spark, src, store, key_catalog=cat)
    keys = SM.load_key_catalog(spark, cat)
    raw = spark.read.parquet(store)
    with_cat = build_flat(raw, fx.fixture_profile(keys=keys))
    discovered = build_flat(raw, fx.fixture_profile())
    assert with_cat.columns == discovered.columns
    assert sorted(map(tuple, with_cat.collect())) == sorted(map(tuple, discovered.collect()))


def test_stream_ingest_goes_on_after_a_restart(spark, tmp_path):
    from sondage.operators.store import read_keyed
    from sondage.sources import fixtures as fx
    from sondage.streaming import stream as SM
    rows = fx.raw_responses(spark, SF_SMALL, "R_dup")
    src = str(tmp_path / "landed")
    SM.land_files(rows, src, "json", 300)
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    run = lambda **kw: SM.ingest_stream(spark, src, store, import_log_path=log, max_files_per_trigger=1, **kw)
    run()
    first, logged = read_keyed(spark, store).count(), read_keyed(spark, log).count()
    assert run().recentProgress == [] or read_keyed(spark, log).count() == logged  # nothing new has landed
    run(checkpoint=str(tmp_path / "other"))  # a fresh checkpoint reads every file again and adds nothing
    assert read_keyed(spark, store).count() == first == fx.raw_responses(spark, SF_SMALL).count()
    assert read_keyed(spark, log).count() == logged


def test_windowed_counts_go_on_after_a_restart(spark, tmp_path):
    from sondage.operators.store import read_keyed
    from sondage.streaming import stream as SM
    schema = "survey string, id string, submitted long, version string, data string"
    src, table = str(tmp_path / "landed"), str(tmp_path / "daily")
    for k, ids in enumerate((["a", "b"], ["c", "b"])):
        SM.land_files(spark.createDataFrame([("s", i, 1_000 + k, "1", "{}") for i in ids], schema), f"{src}/part={k}", "json")
        SM.daily_stream(spark, f"{src}/part=*", table, lateness="1 day")
        if k == 0:
            (tmp_path / "landed" / "part=0").rename(tmp_path / "archived")
    assert [(str(r["day"]), r["n"]) for r in read_keyed(spark, table).collect()] == [("1970-01-01", 3)]
    with pytest.raises(ValueError):
        SM.daily_stream(spark, src, table)


def test_running_stream_is_returned(spark, tmp_path):
    from sondage.operators.store import read_keyed
    from sondage.streaming import stream as SM
    schema = "survey string, id string, submitted long, version string, data string"
    src, store = str(tmp_path / "landed"), str(tmp_path / "store")
    SM.land_files(spark.createDataFrame([("s", "a", 1, "1", '{"x": "TRUE", "n": 5, "o": {"k": [1]}}')], schema), src, "json")
    q = SM.ingest_stream(spark, src, store, interval="1 second")
    try:
        q.processAllAvailable()
        assert q.isActive
    finally:
        q.stop()
    assert [r["data"] for r in read_keyed(spark, store).collect()] == ['{"x":true,"n":5,"o":{"k":[1]}}']


def test_batch_ingest_log_and_meta(spark, tmp_path):
    import pytest as _pytest

    from sondage.sources import fixtures as fx
    from sondage.streaming import stream as SM
    rows = fx.raw_responses(spark, SF_SMALL, "R_dup")
    store, log, meta = str(tmp_path / "store"), str(tmp_path / "log"), str(tmp_path / "meta")
    SM.ensure_meta(spark, meta, "|")
    added = SM.ingest_batch(spark, rows, store, import_log_path=log)
    assert added == fx.raw_responses(spark, SF_SMALL).count()
    assert SM.ingest_batch(spark, rows, store, import_log_path=log) == 0  # adds nothing: not logged
    from sondage.operators.store import read_keyed
    surveys = rows.select("survey").distinct().count()
    assert read_keyed(spark, log).count() == surveys
    for _ in range(2):  # a named load is logged once
        SM.ingest_batch(spark, rows, store, import_log_path=log, load="again")
    assert read_keyed(spark, log).count() == 2 * surveys
    SM.ensure_meta(spark, meta, "|")
    with _pytest.raises(ValueError):
        SM.ensure_meta(spark, meta, ";")
