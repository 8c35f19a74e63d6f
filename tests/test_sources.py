import gzip
import json
import zipfile

from pyspark.sql import functions as F

from rillstone import schemas
from rillstone.operators import dedupe
from rillstone.plans import chain
from rillstone.sources import readers, sinks
from rillstone.streaming import incremental


def test_json_forms(spark, tmp_path):
    rows = [{"codigoestacao": "1", "Cota_Adotada": "5", "new": 1}, {"codigoestacao": "2", "Chuva_Adotada": "1,5"}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.ndjson").write_text("\n".join(map(json.dumps, rows)))
    a = readers.json_array(spark, str(tmp_path / "a.json"), schemas.TELEMETRY)
    b = readers.json_lines(spark, str(tmp_path / "deep"), schemas.TELEMETRY)
    assert dedupe.same_bag(a, b, a.columns).first()["equal"] and a.columns == schemas.TELEMETRY.names
    assert "new" in readers.json_array(spark, str(tmp_path / "a.json")).columns
    assert readers.tree(spark, str(tmp_path / "deep"), schemas.TELEMETRY).select("file").distinct().count() == 1


def test_csv_with_comments(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# note\nstation,valid,tmpf\n# more\nS,2024-01-01 00:00,50.0\nS,x,\n")
    df = readers.csv(spark, str(tmp_path), schemas.struct("station string, valid string, tmpf string"), comment="#")
    assert [tuple(r) for r in df.collect()] == [("S", "2024-01-01 00:00", "50.0"), ("S", "x", None)]


def test_zip_archives(spark, tmp_path):
    body = "Série\nlixo;x\nEstacaoCodigo;Data;Chuva01\n1;01/01/2023;1,5\n2;01/02/2023;\n\n"
    for name, files in {"a.zip": {"d.csv": body}, "b.zip": {"d.txt": "none"}, "c.zip": {"d.csv": "no header\n1;2"}}.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n, t in files.items():
                z.writestr(n, t.encode("latin-1"))
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    lines = readers.unzip_lines(readers.archives(spark, str(tmp_path)))
    got = readers.after_header(lines, "EstacaoCodigo", ["Chuva01", "EstacaoCodigo", "Absent"])
    assert sorted(tuple(r)[2:] for r in got.collect()) == [("", "2", None), ("1,5", "1", None)]
    assert "Série" in [r.line for r in lines.collect()]
    assert {(r.path.split("/")[-1], r.reason) for r in lines.filter("reason is not null").collect()} == {("broken.zip", "no archive")}


def test_damaged_archives_tell_why(spark, tmp_path):
    """A member with a wrong checksum gives a row with a reason and none of its lines below the header; other members are read."""
    for name in ("good", "bad"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_STORED) as z:
            z.writestr("d.csv", "k;v\n" + "".join(f"{i};{name}\n" for i in range(30_000)))
            z.writestr("e.csv", f"k;v\n7;{name}-e\n")
    whole = (tmp_path / "bad.zip").read_bytes()
    (tmp_path / "bad.zip").write_bytes(whole.replace(b"29999;bad", b"29999;bAd", 1))
    (tmp_path / "empty.zip").write_bytes(b"x")
    lines = readers.unzip_lines(readers.archives(spark, str(tmp_path)))
    told = {(r.path.split("/")[-1], r.member, r.reason) for r in lines.filter("reason is not null").collect()}
    assert told == {("bad.zip", "d.csv", "unreadable: BadZipFile"), ("empty.zip", None, "no archive")}
    rows = readers.after_header(lines, "k", ["k", "v"]).groupBy("v").count().collect()
    assert {(r.v, r["count"]) for r in rows} == {("good", 30_000), ("good-e", 1), ("bad-e", 1)}


def test_gzip_text_and_inventory(spark, tmp_path):
    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write("x y\nz\n")
    assert readers.text_tokens(spark, str(tmp_path)).count() == 2
    inv = spark.createDataFrame([("7",), ("7",), (None,), ("x",), ("8",)], "codigoestacao string")
    assert sorted(r[0] for r in readers.stations(inv).collect()) == [7, 8]


def test_layers_and_merges_repeat(spark):
    for _ in range(2):
        names = sinks.create_layers(spark, "tt_")
    assert names == ["tt_raw", "tt_bronze", "tt_silver", "tt_gold"]
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "k int, v string")
    for _ in range(2):
        sinks.merge_insert(df, "tt_bronze.t", ["k"])
    assert sorted(tuple(r) for r in spark.table("tt_bronze.t").collect()) == [(1, "a"), (2, "b")]
    sinks.replace(spark.table("tt_bronze.t").filter("k = 2"), "tt_bronze.t")
    assert spark.table("tt_bronze.t").count() == 1


def test_null_keys_are_put_aside_once(spark):
    sinks.create_layers(spark, "nk_", ["bronze"])
    df = spark.createDataFrame([(1, "a", 1.0), (None, "c", 2.0), (None, "c", 2.0), (None, None, None)], "k int, v string, x double")
    for _ in range(2):
        sinks.merge_insert(df, "nk_bronze.t", ["k"], prune="k", aside="nk_bronze.aside")
    assert spark.table("nk_bronze.t").count() == 1
    assert sorted((r.v or "", r.reason) for r in spark.table("nk_bronze.aside").collect()) == [("", "null_key"), ("c", "null_key")]
    spark.sql("DROP DATABASE nk_bronze CASCADE")


def test_merges_read_their_own_range(spark):
    """The filter on the new rows' range is pushed down to the scan of the table."""
    sinks.create_layers(spark, "pr_", ["bronze"])
    sinks.append(spark.range(1000), "pr_bronze.t")
    part = sinks.within(spark.table("pr_bronze.t"), spark.range(990, 1005), "id")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,990)" in plan and "LessThanOrEqual(id,1004)" in plan and part.count() == 10
    assert sinks.within(spark.table("pr_bronze.t"), spark.range(0), "id").count() == 0
    spark.sql("DROP DATABASE pr_bronze CASCADE")


def test_a_chain_that_broke_off_is_made_up_for(spark):
    """Rows that reached bronze but no further are there after the next run of their feed; later feeds leave no gap in the calendar."""
    schema = "event_id long, station long, sensor string, ts string, value double"
    rows = [(1, 1, "view", "2024-01-01T05:00:00Z", 5.0), (2, 1, "view", "2024-01-01T06:00:00Z", 7.0), (None, 1, "view", "2024-01-01T07:00:00Z", 9.0), (4, 1, None, "2024-01-01T07:00:00Z", 9.0), (5, 1, "view", "never", 9.0)]
    feed, later = spark.createDataFrame(rows, schema), spark.createDataFrame([(9, 1, "view", "2024-01-05T05:00:00Z", 3.0)], schema)
    sinks.create_layers(spark, "br_")
    sinks.merge_insert(feed, "br_bronze.reading", ["event_id"])
    for part in (feed, later, feed, feed.limit(0)):
        layers = chain.run(spark, part, "br_", level_scale=1.0)
    assert spark.table("br_gold.fact_daily_level").orderBy("time_key").select("time_key", "level").collect() == [(20240101, 6.0), (20240105, 3.0)]
    assert spark.table("br_gold.dim_time").count() == 5
    assert {(r.event_id, r.reason) for r in spark.table("br_silver.quarantine").collect()} == {(4, "no_sensor"), (5, "bad_ts")}
    assert [r.reason for r in spark.table("br_bronze.quarantine").collect()] == ["null_key"]
    for layer in layers.values():
        spark.sql(f"DROP DATABASE {layer} CASCADE")


def test_fuller_days_win(spark, tmp_path):
    path = str(tmp_path / "days")
    spark.createDataFrame([(1, "d1"), (2, "d1"), (3, "d2")], "v int, d string").write.partitionBy("d").parquet(path)
    sinks.replace_fuller_days(spark.createDataFrame([(9, "d1"), (8, "d2"), (7, "d2"), (6, "d3")], "v int, d string"), path, "d")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("d", "v").collect()) == [("d1", 1), ("d1", 2), ("d2", 7), ("d2", 8), ("d3", 6)]


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    rows = [{"event_id": k % 7, "station": 1, "sensor": "s", "ts": "2024-01-01T00:00:00Z", "value": float(k % 7)} for k in range(10)]
    spark.sql("CREATE DATABASE IF NOT EXISTS st")
    for name, parts in {"a": [rows[:3], rows[3:]], "b": [rows[5:], rows[:5], []]}.items():
        folder = tmp_path / name
        folder.mkdir()
        for i, part in enumerate(parts):
            (folder / f"{i}.json").write_text("\n".join(map(json.dumps, part)))
            incremental.load_new_files(spark, str(folder), schemas.EVENT, f"st.{name}", ["event_id"], str(tmp_path / f"cp-{name}"), lambda df: df.withColumn("value", F.col("value")))
    a, b = spark.table("st.a"), spark.table("st.b")
    assert a.count() == 7 and dedupe.same_bag(a, b, a.columns).first()["equal"]


def test_frozen_schema(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1, "v": "x"}\n')
    assert readers.frozen_schema(spark, str(tmp_path)).simpleString() == "struct<k:bigint,v:string>"


def files_of(spark, name):
    """partition -> data files of a table."""
    import collections
    import pathlib

    top = pathlib.Path(spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Location'").first()["data_type"].removeprefix("file:"))
    found = collections.defaultdict(set)
    for p in top.rglob("*.parquet"):
        found[p.parent.name].add(p.name)
    return dict(found)


def test_upsert_keeps_whole_newest_versions(spark):
    """Only the buckets of changed keys are written; a second run writes nothing; versions aren't mixed and older ones don't win."""
    sinks.create_layers(spark, "up_", ["gold"])
    schema = "k int, a string, b string, at int, bucket int"
    put = lambda rows: sinks.upsert(spark.createDataFrame(rows, schema), "up_gold.t", ["k"], "bucket", "at")
    first = [(1, "A", "Z", 1, 0), (1, "B", "Y", 1, 0), (2, "C", None, None, 1), (3, "D", "x", 5, 2), (None, "n", "n", 9, 0)]
    assert put(first) == [0, 1, 2]
    before = files_of(spark, "up_gold.t")
    assert put(first) == [] and put(first[:2] * 2 + [(3, "old", "old", 4, 2), (3, "none", "none", None, 2)]) == [] and put([]) == []
    assert files_of(spark, "up_gold.t") == before
    assert put([(2, "C2", None, 0, 1), (3, "D", "x", 5, 2), (4, None, None, 7, 1)]) == [1]
    after = files_of(spark, "up_gold.t")
    assert {b: after[b] == before[b] for b in before} == {"bucket=0": True, "bucket=1": False, "bucket=2": True}
    assert sorted(tuple(r) for r in spark.table("up_gold.t").select("k", "a", "b", "at").collect()) == [(1, "B", "Y", 1), (2, "C2", None, 0), (3, "D", "x", 5), (4, None, None, 7)]
    spark.sql("DROP DATABASE up_gold CASCADE")


def test_late_readings_correct_their_day_alone(spark):
    """A second feed brings another reading of a loaded day: its row changes, the files of the other days stay; loading again writes nothing."""
    schema = "event_id long, station long, sensor string, ts string, value double"
    feed = lambda *rows: spark.createDataFrame(list(rows), schema)
    early = feed((1, 1, "view", "2024-01-01T00:00:00Z", 100.0), (2, 1, "view", "2024-01-02T00:00:00Z", 50.0), (3, 2, "view", "2024-01-01T05:00:00Z", 7.0))
    late = feed((9, 1, "view", "2024-01-01T12:00:00Z", 200.0), (10, 1, "purchase", "2024-01-01T13:00:00Z", 3.0))
    places = spark.createDataFrame([(1, "A", "Z", 1), (1, "B", "Y", 2), (7, "C", "X", 1)], "station long, name string, river string, at int")
    run = lambda part, where=None: chain.run(spark, part, "lt_", level_scale=0.01, locations=where, attributes=["name", "river"], updated="at")
    layers = run(early, places)
    before = files_of(spark, "lt_gold.fact_daily_level")
    run(late)
    after = files_of(spark, "lt_gold.fact_daily_level")
    assert before["time_key=20240102"] == after["time_key=20240102"] and before["time_key=20240101"] != after["time_key=20240101"]
    told = lambda: sorted((r.station, r.time_key, r.level, r.rain) for r in spark.table("lt_gold.fact_daily_level").join(spark.table("lt_gold.dim_location"), "location_key").collect())
    assert told() == [(1, 20240101, 1.5, 3.0), (1, 20240102, 0.5, None), (2, 20240101, 0.07, None)]
    run(early), run(late, places)
    assert files_of(spark, "lt_gold.fact_daily_level") == after
    assert sorted((r.station, r.name, r.river) for r in spark.table("lt_gold.dim_location").collect()) == [(1, "B", "Y"), (2, None, None), (7, "C", "X")]
    for layer in layers.values():
        spark.sql(f"DROP DATABASE {layer} CASCADE")


def test_ranges_follow_the_values(spark):
    """A stray value is a range of its own; a merge with one reads no row between."""
    import datetime as dt

    rows = spark.range(1000, 1100).unionByName(spark.createDataFrame([(3,)], "id long"))
    assert sinks.ranges(rows, "id")[0] == (3, 3) and sinks.ranges(rows, "id")[1][0] >= 1000
    days = rows.select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    assert sinks.ranges(days, "d", 4)[0] == (dt.date(2020, 1, 4),) * 2 and len(sinks.ranges(days, "d", 4)) == 2
    assert sinks.ranges(days.select(F.col("d").cast("string").alias("s")), "s") == [("2020-01-04", "2023-01-04")]
    assert sinks.ranges(rows.limit(0), "id") == [] and sinks.within(rows, rows, "id").count() == 101


def test_broken_records_keep_their_text(spark, tmp_path):
    """Every landed record is good or has a reason; its text is that of the file, byte for byte."""
    schema = schemas.struct("k long, v double, s string")
    lines = ['{"k": 1, "v": 2.5, "s": "é"}', '{"k": 2, "v": "x",  "s": "y"}', '{"k": 3, "v": ', "", "  ", "[1, 2]", "null", '{"k": "a", "v": true}', '{"other": 1}', '{"k":4}{"k":5}', "not json é"]
    (tmp_path / "l.json").write_text("\n".join(lines))
    got = {r.raw: (r.reason, r.k, r.v, r.s) for r in readers.checked(readers.landed_lines(spark, str(tmp_path)), schema).collect()}
    assert set(got) == {x for x in lines if x.strip()}
    assert got[lines[0]] == (None, 1, 2.5, "é") and got[lines[8]] == (None, None, None, None)
    assert got[lines[1]] == ("bad_field: v", 2, None, "y") and got[lines[7]][0] == "bad_field: k,v"
    assert [got[lines[i]][0] for i in (2, 5, 6, 9, 10)] == ["not_json", "not_an_object", "not_an_object", "not_json", "not_json"]

    folder = tmp_path / "arrays"
    folder.mkdir()
    texts = {"a": ' [ {"k": 1,  "v": 1e0}, {"k": "x"}, 7 ]', "b": '[{"k": 1}, {"k": 2', "c": '{"k": 9}', "d": "[]", "e": " \n"}
    for name, text in texts.items():
        (folder / f"{name}.json").write_text(text)
    rows = readers.checked(readers.landed_arrays(spark, str(folder)), schema).collect()
    assert sorted((r.file[-6], r.raw, r.reason) for r in rows) == [
        ("a", "7", "not_an_object"), ("a", '{"k":"x"}', "bad_field: k"), ("a", '{"k":1,"v":1.0}', None), ("b", texts["b"], "not_json"), ("c", texts["c"], None),
    ]


def test_stream_puts_broken_lines_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"event_id": 1, "station": 2}\n{"event_id": 2,\n{"event_id": 2,\n{"event_id": 3}\n')
    spark.sql("CREATE DATABASE IF NOT EXISTS sb")
    for _ in range(2):
        incremental.load_new_files(spark, str(tmp_path / "in"), schemas.EVENT, "sb.t", ["event_id"], str(tmp_path / "cp"))
    assert sorted(r.event_id for r in spark.table("sb.t").collect()) == [1, 3]
    assert [(r.raw, r.reason, r.n, r.file[-6:]) for r in spark.table("sb.t_broken").collect()] == [('{"event_id": 2,', "not_json", 2, "a.json")]
    spark.sql("DROP DATABASE sb CASCADE")


def test_a_failed_replace_leaves_the_old_rows(spark):
    sinks.create_layers(spark, "rp_", ["gold"])
    sinks.append(spark.range(10), "rp_gold.t")
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    try:
        sinks.replace(bad, "rp_gold.t")
        raise AssertionError("the write should fail")
    except Exception as e:
        assert "broken" in str(e)
    assert spark.table("rp_gold.t").count() == 10
    for least in (5, 8):
        sinks.replace(spark.table("rp_gold.t").filter(F.col("id") >= least), "rp_gold.t")
        assert sorted(r.id for r in spark.table("rp_gold.t").collect()) == list(range(least, 10))
    sinks.append(spark.range(2), "rp_gold.t")
    assert spark.table("rp_gold.t").count() == 4
    sinks.create_empty(spark, "rp_gold.p", spark.range(1).selectExpr("id", "id as d").schema, ["d"])
    sinks.append(spark.range(4).selectExpr("id", "id % 2 as d"), "rp_gold.p")
    sinks.replace(spark.table("rp_gold.p").filter("d = 1"), "rp_gold.p")
    assert sorted(r.id for r in spark.table("rp_gold.p").filter("d = 1").collect()) == [1, 3] and spark.table("rp_gold.p").count() == 2
    spark.sql("DROP DATABASE rp_gold CASCADE")


def test_streamed_archives_are_the_same(spark, tmp_path):
    """Members as partitions give what whole archives in rows give, damaged ones too."""
    from rillstone.sources import zips

    for name in ("good", "bad", "more"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_STORED) as z:
            z.writestr("d.csv", "Ünlü\r\nk;v\n" + "".join(f"{i};{name}\n" for i in range(25_000)), zipfile.ZIP_DEFLATED if name == "more" else None)
            z.writestr("e.CSV", f"k;v\n7;{name}-e\n")
            z.writestr("none.txt", "x")
    whole = (tmp_path / "bad.zip").read_bytes()
    (tmp_path / "bad.zip").write_bytes(whole.replace(b"24999;bad", b"24999;bAd", 1))
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    old = readers.unzip_lines(readers.archives(spark, str(tmp_path)))
    paths = [r.file for r in readers.stats(spark, str(tmp_path), "*.zip").collect()]
    new = zips.zip_lines(spark, paths)
    assert new.rdd.getNumPartitions() == 7 and new.count() > 74_000
    assert dedupe.same_bag(old, new, old.columns).first()["equal"]
    assert zips.zip_lines(spark, []).count() == 0


def test_streamed_archives_take_little_memory(tmp_path):
    """A member of 60 MB is read with a few MB."""
    import tracemalloc

    from rillstone.sources import zips

    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("big.csv", "w") as f:
        for _ in range(600):
            f.write(b"0123456789;abcdefghi\n" * 5000)
    reader = zips.Reader([str(tmp_path / "a.zip")], ".csv", "latin-1")
    (part,) = reader.partitions()
    tracemalloc.start()
    assert sum(b.num_rows for b in reader.read(part)) == 3_000_000
    assert tracemalloc.get_traced_memory()[1] < 12e6
    tracemalloc.stop()
