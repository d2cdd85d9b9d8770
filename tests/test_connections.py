import random

from packet_rows import icmp, packet, udp
from pyspark.sql import functions as F

from tidewatch.operators import connections, skew


def brute(rows, max_age=None):
    """packet_id -> (epoch, count, bytes) by going through the packets in order."""
    state, result = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if r[5] != 6:
            result[r[0]] = (1, 1, r[14])
            continue
        key = (r[3], r[6], r[4], r[7])
        start, epoch, count, size = state.get(key, (None, 0, 0, 0))
        if start is None or (max_age is not None and (r[1] - start).total_seconds() > max_age):
            start, epoch, count, size = r[1], epoch + 1, 0, 0
        state[key] = (start, epoch, count + 1, size + r[14])
        result[r[0]] = state[key][1:]
    return result


def traffic(n=600, seed=1):
    """One connection with a third of all packets, some long ones, and packets outside TCP."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        s = rng.choice([rng.uniform(0, 2000), rng.randrange(0, 2000), 7.0])
        size = rng.randrange(54, 100)
        kind = rng.random()
        if kind < 0.34:
            rows.append(packet(s, src_ip="hot", frame_len=size))
        elif kind < 0.8:
            rows.append(packet(s, src_port=rng.randrange(4000, 4020), frame_len=size))
        elif kind < 0.9:
            rows.append(udp(s, src_ip="hot", frame_len=size))
        else:
            rows.append(icmp(s, src_ip="hot", frame_len=size))
    return rows


def counts(df):
    return {r["packet_id"]: (r["epoch"], r["count"], r["running_bytes"]) for r in df.collect()}


def test_running_count(make):
    rows = traffic()
    df = connections.connection_count(make(rows), running_bytes=True).withColumn("epoch", F.lit(1))
    assert counts(df) == brute(rows)


def test_running_count_of_hot_connections(make):
    rows = traffic()
    for max_rows in (60, 2):
        df = connections.connection_count(make(rows), max_rows=max_rows, running_bytes=True)
        assert counts(df.withColumn("epoch", F.lit(1))) == brute(rows)


def test_epochs(make):
    rows = traffic()
    df = connections.connection_count(make(rows), max_age=300, running_bytes=True)
    assert counts(df) == brute(rows, 300)


def test_epochs_of_hot_connections(make):
    rows = traffic(seed=2)
    df = connections.connection_count(
        make(rows), max_age=300, max_rows=20, running_bytes=True
    )
    assert counts(df) == brute(rows, 300)


def test_epoch_starts_of_hot_connections(make):
    df = make(traffic(400, seed=3))
    found = connections.epoch_starts(df, 100)
    split = connections.epoch_starts(df, 100, max_rows=3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, split.collect()))


def test_one_connection_with_very_many_epochs(make, spark):
    # one packet per 301 s, so each starts an epoch
    one = make([packet(0.0)])
    df = one.drop("packet_id", "ts").crossJoin(spark.range(3000).select(
        F.col("id").alias("packet_id"), F.timestamp_micros(F.col("id") * 301_000_000).alias("ts")
    )).select(*one.columns)
    counted = connections.connection_count(df, max_age=300)
    assert counted.where("epoch = packet_id + 1 and count = 1").count() == 3000


def test_epoch_ends_after_not_at_the_age(make):
    rows = [packet(0), packet(300), packet(300.000001), packet(600.000001), packet(600.000002)]
    df = connections.connection_count(make(rows), max_age=300).orderBy("packet_id")
    assert [(r["epoch"], r["count"]) for r in df.collect()] == (
        [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)]
    )
    starts = connections.epoch_starts(make(rows)).orderBy("epoch")
    assert [r["epoch"] for r in starts.collect()] == [1, 2, 3]


def test_same_ports_in_udp_are_another_matter(make):
    rows = [packet(0), udp(1, src_port=4000, dst_port=80), packet(2)]
    df = connections.connection_count(make(rows)).orderBy("packet_id")
    assert [r["count"] for r in df.collect()] == [1, 1, 2]


def test_one_instant_is_split_too(make):
    rows = [packet(5.0) for _ in range(50)]
    df = make(rows)
    hot = skew.hot_keys(df, ["src_ip"], 10)
    assert [(r["src_ip"], r["rows"]) for r in hot.collect()] == [("10.0.0.9", 50)]
    summed = skew.running_sums(df, ["src_ip"], {"n": F.lit(1)}, max_rows=10).orderBy("packet_id")
    assert [r["n"] for r in summed.collect()] == list(range(1, 51))


def test_more_slices_than_rows_in_one(make):
    rows = [packet(k / 10, src_ip="hot") for k in range(64)]
    summed = skew.running_sums(make(rows), ["src_ip"], {"n": F.lit(1)}, max_rows=2).orderBy("packet_id")
    assert [r["n"] for r in summed.collect()] == list(range(1, 65))


def test_very_many_hot_keys(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("packet_id"), (F.col("id") % 5000).alias("k"), F.timestamp_seconds("id").alias("ts")
    )
    hot = skew.hot_keys(df, ["k"], 2)
    assert hot.count() == 5000
    summed = skew.running_sums(df, ["k"], {"n": F.lit(1)}, max_rows=2, hot=hot)
    assert summed.where("n <> packet_id div 5000 + 1").count() == 0


def test_summary(make):
    rows = [packet(3, frame_len=60), packet(1), packet(2, src_port=9, dst_port=22), udp(0)]
    found = {r["src_port"]: r for r in connections.connection_summary(make(rows)).collect()}
    assert (found[4000]["count"], found[4000]["bytes"], found[4000]["service"]) == (2, 114, "http")
    assert found[4000]["start_time"].second == 1
    assert found[9]["service"] == "ssh"


def test_no_packets_at_all(make):
    nothing = make([udp(0)]).filter("packet_id < 0")
    assert connections.connection_count(nothing, max_age=300).count() == 0
    assert connections.connection_count(make([udp(0)]), max_age=300).count() == 1
    assert connections.epoch_starts(nothing).count() == 0
