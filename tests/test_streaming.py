import random

import pytest
from packet_rows import icmp, packet, udp
from pyspark.sql import functions as F

from tidewatch.operators import connections, prepare, scans, status
from tidewatch.plans import detection
from tidewatch.schemas import SCORED_PACKET_SCHEMA
from tidewatch.sources.packets import first_packets, stream_packets
from tidewatch.sources.row_stream import stream_rows
from tidewatch.streaming import carried, jobs, live, stateful
from test_learn import tiny


@pytest.fixture(scope="module")
def traffic():
    rng = random.Random(11)
    rows = []
    for i in range(240):
        s, src = i * 3.0 + rng.random(), rng.choice(["hot", "hot", "a", "b"])
        kind = rng.random()
        if kind < 0.8:
            rows.append(packet(
                s, src_ip=src, dst_port=rng.randrange(20, 30), src_port=rng.randrange(1, 3),
                tcp_flags=rng.choice([2, 2, 18]), score=rng.choice([0.0, 1.0, 1.0]),
            ))
        else:
            rows.append(rng.choice([udp, icmp])(s, src_ip=src, score=rng.random()))
    burst = [packet(720 + i * 0.5, src_ip="scan", dst_port=100 + i % 9) for i in range(70)]
    return sorted(rows + burst, key=lambda r: r[1])


@pytest.fixture
def source(spark, traffic, tmp_path):
    """The traffic as a stream of three micro-batches in order of time."""
    path = str(tmp_path / "in")
    for i in range(3):
        part = traffic[i * len(traffic) // 3 : (i + 1) * len(traffic) // 3]
        random.Random(i).shuffle(part)
        df = spark.createDataFrame(part, SCORED_PACKET_SCHEMA)
        df.coalesce(1).write.mode("append").parquet(path)
    return stream_packets(spark, path, SCORED_PACKET_SCHEMA, max_files=1)


def drained(spark, stream, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    query = jobs.start(stream, out, str(tmp_path / "state"), mode, available_now=True)
    assert jobs.run_bounded(query, 300)
    return jobs.written(spark, out, stream.schema)


def same(left, right):
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    return rows(left) == rows(right)


def test_connection_count(spark, make, traffic, source, tmp_path):
    counted = stateful.stream_connection_count(stateful.in_event_time(source, unique=True))
    got = drained(spark, counted, tmp_path).drop("batch_id")
    batch = connections.connection_count(make(traffic), 300, running_bytes=True).drop("epoch")
    assert same(got, batch)


def test_alerts(spark, make, traffic, source, tmp_path):
    stream = jobs.stream_alerts(stateful.in_event_time(source, unique=True), 0.1, ["a"])
    got = drained(spark, stream, tmp_path)
    assert got.select("batch_id").distinct().count() == 3
    batch = detection.detect(make(traffic), 0.1, ["a"])
    assert batch.filter("attack_type = 'PORT_SCAN'").count() > 0
    assert same(got.drop("batch_id"), batch)


def test_port_scan(spark, make, traffic, source, tmp_path):
    flagged = stateful.stream_port_scan(stateful.in_event_time(source, unique=True))
    assert same(drained(spark, flagged, tmp_path).drop("batch_id"), scans.port_scan(make(traffic)))


def test_status_without_repeats(spark, make, traffic, tmp_path):
    path = str(tmp_path / "in")
    half = len(traffic) // 2
    for part in (traffic[:half], traffic[half - 5 :]):  # five packets come twice
        spark.createDataFrame(part, SCORED_PACKET_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    source = stream_packets(spark, path, SCORED_PACKET_SCHEMA, max_files=1)
    stream = jobs.stream_status(stateful.in_event_time(source), 0.1)
    rows = drained(spark, stream, tmp_path, "update")
    got = jobs.latest(rows, "window_start", "window_end")
    assert same(got, status.status_window(make(traffic), 0.1))


def test_a_repeated_batch_replaces_its_output(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(5).write.parquet(path)
    stream = spark.readStream.schema("id long").parquet(path)
    out = str(tmp_path / "out")
    for state in ("first", "second"):  # a lost checkpoint makes batch 0 run again
        jobs.run_bounded(jobs.start(stream, out, str(tmp_path / state), available_now=True))
    assert jobs.written(spark, out, stream.schema).count() == 5


def test_bounded_run(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(5).write.parquet(path)
    stream = spark.readStream.schema("id long").parquet(path).withColumn("x", F.lit(1))
    query = jobs.start(stream, str(tmp_path / "out"), str(tmp_path / "state"), flush_seconds=1)
    assert not jobs.run_bounded(query, 10)
    assert not query.isActive
    assert jobs.written(spark, str(tmp_path / "out"), stream.schema).count() == 5


def test_the_live_job_equals_the_batch(spark, make, traffic, source, tmp_path):
    scaler = prepare.Scaler(["count", "flag_S"], [0.0, 0.0], [1.0, 1.0])
    job = live.Live(str(tmp_path / "live"), scaler, tiny(), 2.0, ["a"])
    assert job.run(source.drop("score"))
    scored = detection.score_packets(make(traffic).drop("score"), scaler, tiny())
    batch = detection.detect(scored, 2.0, ["a"])
    got = job.alerts(spark)
    assert batch.filter("attack_type = 'PORT_SCAN'").count() > 0
    assert got.select("batch_id").distinct().count() == 3
    assert same(got.drop("alert_date", "batch_id"), batch)
    totals = job.totals(spark).first()
    assert (totals["total_packets"], totals["total_attacks"]) == (len(traffic), batch.count())
    assert spark.read.json(f"{job.folder}/report").first()["total_packets"] == len(traffic)
    windows = status.status_window(make(traffic), 0.1).agg(F.sum("packets_analyzed")).first()[0]
    assert job.status(spark).agg(F.sum("packets_analyzed")).first()[0] == windows
    # a batch that is run again replaces what it wrote
    before = got.count()
    again = spark.read.parquet(str(tmp_path / "in")).drop("score")
    third = sorted(traffic, key=lambda r: r[1])[2 * len(traffic) // 3:]
    job.process(again.join(make(third).select("packet_id"), "packet_id", "left_semi").select(*again.columns), 2)
    assert job.alerts(spark).count() == before


def test_a_live_job_that_is_stopped_reports(spark, make, traffic, source, tmp_path):
    scaler = prepare.Scaler(["count", "flag_S"], [0.0, 0.0], [1.0, 1.0])
    job = live.Live(str(tmp_path / "live"), scaler, tiny(), 2.0)
    assert not job.run(source.drop("score"), timeout=1, flush_seconds=1)
    row = spark.read.json(f"{job.folder}/report").first()
    assert row["runtime"] == 1.0 and row["total_packets"] in (0, 103, 104, 206, 207, 310)


SCALER = prepare.Scaler(["count", "flag_S"], [0.0, 0.0], [1.0, 1.0])


def files(spark, path, parts, schema=SCORED_PACKET_SCHEMA):
    """One file per part, named in their order."""
    import pyarrow.parquet as pq

    for i, part in enumerate(parts):
        pq.write_table(spark.createDataFrame(part, schema).drop("score").toArrow(), f"{path}/{i:03d}.parquet")


def raw_schema():
    return type(SCORED_PACKET_SCHEMA)([f for f in SCORED_PACKET_SCHEMA if f.name != "score"])


def test_late_and_repeated_packets(spark, make, traffic, tmp_path):
    rng = random.Random(8)
    delayed = sorted(traffic, key=lambda r: r[1].timestamp() + rng.uniform(0, 55))  # up to 55 seconds late
    sent = delayed[:200] + delayed[150:180] + delayed[200:] + delayed[-40:]  # 70 come twice
    path = tmp_path / "in"
    path.mkdir()
    files(spark, path, [sent[i:i + 70] for i in range(0, len(sent), 70)])
    job = live.Live(str(tmp_path / "live"), SCALER, tiny(), 2.0, ["a"], delay=60)
    assert job.run(stream_packets(spark, str(path), raw_schema(), max_files=1))
    batch = detection.detect(detection.score_packets(make(traffic).drop("score"), SCALER, tiny()), 2.0, ["a"])
    assert same(job.alerts(spark).drop("alert_date", "batch_id"), batch)
    totals = job.totals(spark).first()
    assert (totals["total_packets"], totals["total_attacks"]) == (len(traffic), batch.count())
    assert job.left_out(spark) == 70


def test_packets_that_come_too_late_are_left_out(spark, traffic, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    files(spark, path, [traffic[50:100], traffic[100:150], traffic[:10]])
    job = live.Live(str(tmp_path / "live"), SCALER, tiny(), 2.0, delay=5)
    assert job.run(stream_packets(spark, str(path), raw_schema(), max_files=1))
    assert job.totals(spark).first()["total_packets"] == 100 and job.left_out(spark) == 10


@pytest.mark.parametrize("count", [1, 100, 150, 1000])
def test_a_live_job_stops_after_so_many_packets(spark, make, traffic, source, tmp_path, count):
    job = live.Live(str(tmp_path / "live"), SCALER, tiny(), 2.0, ["a"], count=count)
    assert job.run(source.drop("score"))
    first = first_packets(make(traffic), count)
    batch = detection.detect(detection.score_packets(first.drop("score"), SCALER, tiny()), 2.0, ["a"])
    assert same(job.alerts(spark).drop("alert_date", "batch_id"), batch)
    report = spark.read.json(f"{job.folder}/report").first()
    assert (report["total_packets"], report["total_attacks"]) == (first.count(), batch.count())


def test_buffers_of_a_hundred_rows(spark, make, traffic, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    files(spark, path, [traffic[:30], traffic[30:250], traffic[250:251], traffic[251:]])
    job = live.Live(str(tmp_path / "live"), SCALER, tiny(), 2.0, ["a"], count=len(traffic))
    assert job.run(stream_rows(spark, str(path), raw_schema()), timeout=240, flush_seconds=0)
    sizes = job._counts(spark).groupBy("batch_id").agg(F.sum("packets").alias("n")).orderBy("batch_id").collect()
    assert [r["n"] for r in sizes] == [100, 100, 100, len(traffic) - 300]
    batch = detection.detect(detection.score_packets(make(traffic).drop("score"), SCALER, tiny()), 2.0, ["a"])
    assert same(job.alerts(spark).drop("alert_date", "batch_id"), batch)


def test_row_stream_goes_on_after_a_restart(spark, traffic, tmp_path):
    path, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    path.mkdir()
    files(spark, path, [traffic[:130]])
    stream = stream_rows(spark, str(path), raw_schema(), rows=50, progress=str(tmp_path / "progress"))
    for n in (130, 200):
        query = jobs.start(stream, out, state, flush_seconds=0)
        for _ in range(600):
            try:
                if jobs.written(spark, out, stream.schema).count() >= n:
                    break
            except Exception:  # nothing written yet
                pass
            query.awaitTermination(0.1)
        query.stop()
        files(spark, path, [traffic[:130], traffic[130:200]])
    got = jobs.written(spark, out, stream.schema)
    assert sorted(r["packet_id"] for r in got.select("packet_id").collect()) == sorted(r[0] for r in traffic[:200])
    sizes = [r["count"] for r in got.groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes[:3] == [50, 50, 30] and max(sizes) == 50


def test_carried_tables_hold_the_newest_rows(spark, tmp_path):
    table, rng, known = carried.CarriedTable(str(tmp_path), "k int, v long", ["k"], fanout=3), random.Random(2), {}
    for batch in range(20):
        table.forget(spark, batch)
        for _ in range(2):  # a batch that is run again
            keys = rng.sample(range(30), rng.randrange(0, 6))
            now = {k: batch * 100 + k for k in keys}
            table.write(batch, spark.createDataFrame(list(now.items()), "k int, v long"))
        known |= now
        assert {r["k"]: r["v"] for r in table.read(spark, batch + 1).collect()} == known
    some = spark.createDataFrame([(1,), (2,), (99,)], "k int")
    assert {r["k"]: r["v"] for r in table.read(spark, 20, some).collect()} == {k: known[k] for k in (1, 2) if k in known}


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    table = carried.CarriedTable(str(tmp_path), "k long, v long", ["k"])
    table.write(0, spark.range(200_000).select(F.col("id").alias("k"), F.rand(1).cast("long").alias("v")))
    before = carried.in_use(table, spark)
    table.write(1, spark.range(50).select(F.col("id").alias("k"), F.lit(7).cast("long").alias("v")))
    assert carried.in_use(table, spark) - before < before / 20
    assert table.read(spark, 2).count() == 200_000


def long_scan(sources=40, hours=30):
    """Sources that come one after another and scan, over a long time."""
    rows = []
    for i in range(sources):
        rows += [packet(i * hours * 3600 / sources + k, src_ip=f"s{i}", dst_port=100 + k) for k in range(8)]
    return rows


def test_live_state_is_bounded_over_a_long_time(spark, make, tmp_path):
    rows = long_scan()
    job = live.Live(str(tmp_path / "live"), SCALER, tiny(), 0.0, forget=3600)
    for i in range(10):
        job.process(make(rows[i * 32:(i + 1) * 32]).drop("score"), i)
        assert job.sources.read(spark, i + 1).count() <= 16  # of the last batches until they are merged
    merged = carried.CarriedTable(job.sources.folder, live.SOURCE_STATE, ["src_ip"])._rows(spark, [(0, 8)])
    assert merged.count() <= 4
    found = job.alerts(spark).where("attack_type = 'PORT_SCAN'").groupBy("source_ip").count().collect()
    assert len(found) == 40 and {r["count"] for r in found} == {3}


def test_port_scans_with_forgotten_sources(spark, make, tmp_path):
    rows = long_scan(6, 2)
    rows += [packet(7000 + k, src_ip="s0", dst_port=300 + k) for k in range(9)]  # anew, an hour later
    rows.sort(key=lambda r: r[1])
    path = tmp_path / "in"
    path.mkdir()
    import pyarrow.parquet as pq

    for i in range(0, len(rows), 9):
        pq.write_table(make(rows[i:i + 9]).toArrow(), f"{path}/{i:03d}.parquet")
    source = stream_packets(spark, str(path), SCORED_PACKET_SCHEMA, max_files=1)
    flagged = stateful.stream_port_scan(stateful.in_event_time(source, unique=True), forget=3600)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    query = jobs.start(flagged, out, state, available_now=True)
    assert jobs.run_bounded(query, 300)
    operators = query.lastProgress["stateOperators"]
    got = jobs.written(spark, out, flagged.schema).where("port_scan").groupBy("src_ip").count().collect()
    assert {r["src_ip"]: r["count"] for r in got} == {**{f"s{i}": 3 for i in range(1, 6)}, "s0": 3 + 4}
    known = [o["numRowsTotal"] for o in operators]
    assert max(known) <= 4 * 3  # a few sources' state, timers included, of the last hour


def test_connections_share_state(spark, make, tmp_path, monkeypatch):
    """Many short connections and a long one, in few buckets; Python is called once per bucket and micro-batch."""
    rng = random.Random(5)
    rows = [packet(900 * (i // 100) + rng.random() * 900, src_ip=rng.choice(["a", "b"]), src_port=rng.randrange(1, 5),
                   dst_port=rng.randrange(20, 40)) for i in range(400)]
    rows += [packet(s * 25.0, src_ip="long") for s in range(140)]
    rows.sort(key=lambda r: r[1])
    path, calls = str(tmp_path / "in"), tmp_path / "calls"
    calls.mkdir()
    for i in range(4):
        part = rows[i * len(rows) // 4:(i + 1) * len(rows) // 4]
        spark.createDataFrame(part, SCORED_PACKET_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    monkeypatch.setattr(stateful, "BUCKETS", 3)
    own = stateful.ConnectionCounter.handleInputRows

    def noted(self, key, rows, timerValues):
        (calls / f"{random.SystemRandom().getrandbits(60)}").touch()
        return own(self, key, rows, timerValues)

    monkeypatch.setattr(stateful.ConnectionCounter, "handleInputRows", noted)
    stream = stream_packets(spark, path, SCORED_PACKET_SCHEMA, max_files=1)
    counted = stateful.stream_connection_count(stateful.in_event_time(stream, unique=True))
    got = drained(spark, counted, tmp_path).drop("batch_id")
    assert len(list(calls.iterdir())) <= 3 * 4
    assert same(got, connections.connection_count(make(rows), 300, running_bytes=True).drop("epoch"))
