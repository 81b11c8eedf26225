"""Addresses against the standard library, and the summaries' edge cases."""

import ipaddress
import random

from pyspark.sql import functions as F

from netquarry.functions import scalars
from netquarry.operators import summaries

ODD = ["", ":", "::", "::1", ":::", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1.2.3.4::", "::1.2.3.256", "fe80::1%eth0", "%eth0", "fe80::%", "FE80::ABCD", "g::", "12345::", "1:2:3:4:5:6:7::",
       "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:", "64:ff9b:1::5", "64:ff9b::5", "100::9", "2001:1::1", "2001:1::4", "2001:3::", "2001:4:112::1", "2001:20::1", "2001:db8::", "2002::1", "3fff:fff::", "3fff:1000::", "fdff::", "febf::1", "fec0::1",
       "0.1.2.3", "10.1.1.1", "100.64.0.1", "127.0.0.1", "169.254.1.1", "172.15.0.1", "172.16.0.1", "192.0.0.9", "192.0.0.10", "192.0.0.11", "192.0.2.1", "192.168.3.4", "198.18.0.1", "198.20.0.1", "198.51.100.7", "203.0.113.1", "240.0.0.1", "255.255.255.255", "224.0.0.1", "1.2.3", "01.2.3.4", "1.2.3.4 "]


def _known(text):
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return False, False
    return True, a.is_private


def test_addresses_as_the_standard_library_sees_them(spark):
    rng = random.Random(5)
    made = [str(ipaddress.IPv6Address(rng.getrandbits(128) >> rng.choice([0, 0, 60, 100, 124]) << rng.choice([0, 0, 3]) & (1 << 128) - 1)) for _ in range(300)]
    made += [ipaddress.IPv6Address(rng.getrandbits(128)).exploded for _ in range(50)] + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)]
    texts = ODD + made
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.is_ip(F.col("t")).alias("v"), scalars.is_private_ip(F.col("t")).alias("p")).collect()
    wrong = [(r.t, r.v, r.p, _known(r.t)) for r in rows if (r.v, r.p) != _known(r.t)]
    assert not wrong
    none = spark.createDataFrame([(None,)], "t string").select(scalars.is_private_ip(F.col("t")).alias("p"), scalars.ipv6_digits(F.col("t")).alias("d")).first()
    assert none.p is False and none.d is None


def test_lines_of_nothing(spark):
    totals = spark.createDataFrame([(0, 0, None, None, None)], "packets long, flows long, bytes long, start string, end string")
    protocols = spark.createDataFrame([], "protocol string, packets long, first_seq long")
    assert [r.line for r in summaries.traffic_lines(totals, protocols).orderBy("place").collect()] == ["📦 总数据包数: 0", "🔀 网络流数量: 0", "📈 总流量: 0 B", "⏰ 时间范围:  ~ "]
    assert [r.line for r in summaries.alert_lines(spark.createDataFrame([], "severity string")).collect()] == ["🚨 异常检测: 共 0 条告警"]


def test_sizes_of_halves_and_units(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1280, 1792, 1 << 20, 1 << 30, 5 << 40)], "n long")
    got = [tuple(r) for r in rows.select(scalars.summary_size(F.col("n")), scalars.report_size(F.col("n"))).collect()]

    def plain(n, whole):
        x = float(n)
        for unit in ("B", "KB", "MB", "GB"):
            if x < 1024 or unit == "GB":
                return f"{n} B" if unit == "B" and whole else f"{x:.1f} {unit}"
            x /= 1024

    assert got == [(plain(n, True), plain(n, False)) for n in (0, 1023, 1024, 1280, 1792, 1 << 20, 1 << 30, 5 << 40)]


def test_verdicts_of_halves_as_their_sql_rounds_them(spark, duck):
    score = (F.col("id") / 1000).alias("p")
    rows = spark.range(1001).select("id", F.posexplode(summaries.verdict_lines(score, F.lit(False))).alias("place", "line")).where("place in (1, 2)")
    want = duck.execute("""SELECT i, unnest([1, 2]) AS place, unnest(['  • 置信度: ' || printf('%.2f', round_even(greatest(p, 1 - p), 2)), '  • 攻击概率: ' || printf('%.4f', round_even(p, 4))]) AS line
        FROM (SELECT i, i / 1000.0::DOUBLE AS p FROM range(1001) t(i))""").fetchall()
    assert sorted(tuple(r) for r in rows.collect()) == sorted(want)
