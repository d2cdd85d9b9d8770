import random

from packet_rows import packet, udp
from pyspark.sql import functions as F

from tidewatch.operators import packets, scans
from tidewatch.plans import detection
from tidewatch.streaming.sketches import CarriedSketches


def scan_ids(df):
    return {r["packet_id"] for r in df.filter("port_scan").collect()}


def brute(rows):
    seen, hits = {}, set()
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if r[5] != 6 or not r[8] & 2 or r[8] & 16:
            continue
        first, ports = seen.setdefault(r[3], (r[1], set()))
        ports.add(r[7])
        if len(ports) > 5 and (r[1] - first).total_seconds() < 30:
            hits.add(r[0])
    return hits


def test_sixth_port_within_thirty_seconds(make):
    five = [packet(i, dst_port=100 + i % 5) for i in range(10)]
    assert scan_ids(scans.port_scan(make(five))) == set()
    six = [packet(i, dst_port=100 + i) for i in range(6)]
    later = [packet(29.999999, dst_port=100), packet(30, dst_port=200)]
    assert scan_ids(scans.port_scan(make(six + later))) == {six[5][0], later[0][0]}
    slow = [packet(i * 6, dst_port=100 + i) for i in range(8)]
    assert scan_ids(scans.port_scan(make(slow))) == set()


def test_random_traffic_matches_a_walk_through_it(make):
    rng = random.Random(5)
    rows = [
        packet(
            rng.choice([rng.uniform(0, 60), float(rng.randrange(0, 60))]),
            src_ip=rng.choice(["hot", "hot", "a", "b", "c"]), dst_port=rng.randrange(1, 9),
            tcp_flags=rng.choice([2, 2, 2, 18, 16, 43]),
        )
        for _ in range(500)
    ] + [udp(1.0, src_ip="hot") for _ in range(5)]
    assert scan_ids(scans.port_scan(make(rows))) == brute(rows)


def test_scope(make):
    quiet = [packet(i, dst_port=100 + i, score=0.0) for i in range(6)]
    loud = [packet(7, dst_port=100)]
    df = make(quiet + loud)
    anomalous = packets.flag_anomalies(df, 0.1)
    assert scan_ids(scans.port_scan(anomalous)) == set()
    assert scan_ids(scans.port_scan(anomalous, observed=df)) == {loud[0][0]}
    kinds = {s: detection.detect(df, 0.1, scope=s).first()["attack_type"] for s in ("anomalous", "all")}
    assert kinds == {"anomalous": "ANOMALY", "all": "PORT_SCAN"}


def test_source_summary(make):
    rows = [packet(2, dst_port=1), packet(1, dst_port=2), packet(3, dst_port=1), packet(0, tcp_flags=16)]
    row = scans.source_scan_summary(make(rows)).first()
    assert (row["first_seen"].second, row["ports"]) == (1, 2)
    assert scans.source_scan_summary(make(rows), approximate=True).first()["ports"] == 2


def test_replay_of_an_observed_run(make):
    """Seven SYNs from one host to itself: the sixth port makes the scan."""
    host = "192.168.37.94"
    seen = [(0, 32), (2, 33), (4, 34), (6, 35), (6, 35), (12, 36), (12, 37)]
    rows = [
        packet(s, src_ip=host, dst_ip=host, src_port=20, dst_port=port, score=1.52889)
        for s, port in seen
    ]
    found = detection.detect(make(rows), 0.1).orderBy("packet_id").collect()
    assert [r["attack_type"] for r in found] == ["ANOMALY"] * 6 + ["PORT_SCAN"]
    assert [r["severity"] for r in found] == ["MEDIUM"] * 6 + ["HIGH"]
    assert {(r["flags"], r["size"], r["protocol"]) for r in found} == {("SYN", 54, "TCP")}
    assert found[6]["alert_message"] == f"PORT_SCAN detected from {host} to {host}"


def test_result_does_not_depend_on_partitions(make):
    rng = random.Random(9)
    rows = [packet(rng.uniform(0, 40), dst_port=rng.randrange(1, 12)) for _ in range(200)]
    one = make(rows).coalesce(1)
    many = make(rows).repartition(7, F.rand(3))
    assert scan_ids(scans.port_scan(one)) == scan_ids(scans.port_scan(many)) == brute(rows)


def test_sketches_of_parts_unite(make):
    rng = random.Random(3)
    rows = [packet(i / 100, src_ip=rng.choice(["a", "b"]), dst_port=rng.randrange(1, 60_000)) for i in range(9000)]
    rows += [packet(95, src_ip="c", dst_port=7), packet(96, src_ip="c", dst_port=7), packet(1, src_ip="d", tcp_flags=16)]
    parts = [scans.port_sketches(make(rows[i::3])) for i in range(3)]
    once = {r["src_ip"]: r for r in scans.sketched_summary(scans.merge_sketches(*parts)).collect()}
    again = scans.sketched_summary(scans.merge_sketches(*parts, parts[1])).collect()
    exact = {r["src_ip"]: r for r in scans.source_scan_summary(make(rows)).collect()}
    for found in (once, {r["src_ip"]: r for r in again}):
        assert set(found) == set(exact) == {"a", "b", "c"}
        for source, row in exact.items():
            assert found[source]["first_seen"] == row["first_seen"]
            # four standard errors of 1.04 / 2^7
            assert abs(found[source]["ports"] - row["ports"]) <= 4 * 1.04 / 128 * row["ports"]
    assert once["c"]["ports"] == 1


def test_sketches_carried_over_batches(spark, make, tmp_path):
    rng = random.Random(4)
    rows = [packet(i / 10, src_ip=rng.choice("abc"), dst_port=rng.randrange(1, 400)) for i in range(1000)]
    rows += [packet(200, src_ip="late", dst_port=5)]
    carried = CarriedSketches(str(tmp_path / "sketches"))
    size = 112
    batches = [rows[i:i + size] for i in range(0, len(rows), size)]
    for number, part in enumerate(batches):
        carried.update(make(part), number)
        if number == 4:
            carried.update(make(part), number)
    exact = {r["src_ip"]: r for r in scans.source_scan_summary(make(rows)).collect()}
    found = {r["src_ip"]: r for r in carried.summary(spark, len(batches)).collect()}
    assert set(found) == set(exact)
    for source, row in exact.items():
        assert found[source]["first_seen"] == row["first_seen"]
        assert abs(found[source]["ports"] - row["ports"]) <= 4 * 1.04 / 128 * row["ports"] + 0.5
