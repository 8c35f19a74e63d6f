"""Queries against their SQL on readings that the small tables lack: several of a key and of a second, many a day, many stations."""

import os

import pytest
from conftest import SF, rows

from rillstone.plans import queries as plans

# copies of a reading, others within its second, and others of its day: up to 8 and more a day, whose mean lies halfway between two roundings
MORE = f"""select event_id + i * 10000 as event_id, case when i < 2 then ts when i = 2 then ts + to_microseconds(event_id % 900) else date_trunc('day', ts) + to_microseconds((event_id * 7919 + i * 104729) * 86399 % 86400000000) end as ts,
    case when i < 3 then user_id else user_id % 3 end as user_id, event_type, value + i / 100 as value, props from '{SF}/events.parquet', range(7) t(i)"""


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """A function that puts events, given as SQL, beside the other tables, and connects to them."""
    import duckdb

    def make(events):
        top = tmp_path_factory.mktemp("grown")
        duckdb.sql(f"copy ({events}) to '{top}/events.parquet' (format parquet)")
        con = duckdb.connect()
        con.sql("set timezone='UTC'")
        for f in os.listdir(SF):
            if f != "events.parquet":
                (top / f).symlink_to(f"{SF}/{f}")
            con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{top / f}'")
        return str(top), con

    return make


def same_on(spark, made, name):
    top, con = made
    got = rows(plans.QUERIES[name](spark, top).toPandas())
    assert got == rows(con.sql(plans.ORACLE[name]).df())
    return got


@pytest.mark.parametrize("name", ["medallion_chain", "chain_late", "chain_rows"])
def test_chain_on_readings_of_one_key_and_second(spark, grown, name):
    same_on(spark, grown(MORE), name)


def test_stream_load_of_one_second_and_without_values(spark, grown):
    """Readings without an id that differ within their second are one; a reading without a value is in the feed, too."""
    events = f"""select event_id + i * 863300 as event_id, date_trunc('second', ts) + to_microseconds(i * 100000) as ts, user_id, event_type, case when event_id % 3 > 0 then value end as value, props
        from '{SF}/events.parquet', range(3) t(i)"""
    got = same_on(spark, grown(events), "stream_load")
    aside = [r for r in got if r[1] == "null_key"]
    assert len(got) == 3000 - 2 * len(aside) and len(aside) == 11 and sum(r[-1] == "NULL" for r in got) > 900


def test_distinct_spans_of_many_stations(spark, grown):
    """Stations below 0, in several bitmaps and beyond 32 bits."""
    got = same_on(spark, grown(f"select event_id + i * 10000 as event_id, ts, (user_id + i * 1000) * (case i % 3 when 0 then 1 when 1 then -7 else 30000000 end) as user_id, event_type, value, props from '{SF}/events.parquet', range(200) t(i)"), "distinct_spans")
    assert max(int(r[2]) for r in got) > 2000


def test_ranges_stay_few(spark, monkeypatch):
    """However few rows a range is to hold, a large table isn't parted into a range for every few."""
    from rillstone.operators import profile

    monkeypatch.setattr(profile, "RANGES", 3)
    seen, real = [], profile.materialize
    monkeypatch.setattr(profile, "materialize", lambda df, name: seen.append(df.select("__range").distinct().count()) or real(df, name))
    got = profile.with_neighbours(spark.range(1000).selectExpr("id", "id % 2 as g"), ["g"], ["id"], {"b": "id"}, {"a": "id"}, rows=5).collect()
    assert seen == [3]
    assert all(r.b == (r.id - 2 if r.id > 1 else None) and r.a == (r.id + 2 if r.id < 998 else None) for r in got) and len(got) == 1000


def test_arrays_by_line(spark, tmp_path):
    from rillstone.sources import readers

    (tmp_path / "a.txt").write_text('[{"a":1}, {"a":2}]\n\n[{"a":3}\n[]\n')
    assert sorted(r.raw for r in readers.landed_arrays(spark, str(tmp_path), by_line=True).collect()) == ['[{"a":3}', '{"a":1}', '{"a":2}']
