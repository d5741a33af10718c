"""Stamps against Python's own dates and zones."""

import random
import re
from collections import Counter
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from medialens.llm import stamps

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
ZONES = ["America/New_York", "Europe/Berlin", "Asia/Kolkata", "UTC", "Australia/Lord_Howe", "Pacific/Apia", "America/Sao_Paulo"]
SCHEMA = "stamp_id long, source string, zone string, raw string"
EPOCH = datetime(1970, 1, 1)
D = "[0-9][0-9]"
SHAPES = [(f"(20{D})-({D})-({D})", "ymd"), (f"(20{D})({D})({D})", "ymd"), (f"({D})[.]({D})[.](20{D})", "dmy"), (f"({D}) ({'|'.join(MONTHS)}) (20{D})", "dmy"), (f"({D})/({D})/(20{D})", "slash")]
REST = re.compile(f"(?:[T ]({D}):({D})(?::({D}))?(?: ?([AP])M)?(?: ?(Z|[+-]{D}:?{D}))?)?")


def microseconds(moment):
    return (moment - EPOCH) // timedelta(microseconds=1)


def date(y, m, d):
    try:
        return datetime(int(y), MONTHS.index(m) + 1 if m in MONTHS else int(m), int(d))
    except ValueError:
        return None


def read(raw):
    """('epoch', us), or (dates day first and month first, clock, offset minutes or None), or None."""
    text = (raw or "").strip(" \t\n\x0b\x0c\r")
    if re.fullmatch("[0-9]{10}|[0-9]{13}", text):
        return "epoch", int(text) * (1_000_000 if len(text) == 10 else 1000)
    for shape, order in SHAPES:
        if (m := re.match(shape, text)) and (r := REST.fullmatch(text, m.end())):
            a, b, c = m.groups()
            two = (date(c, b, a), date(c, a, b)) if order == "slash" else (date(a, b, c),) * 2 if order == "ymd" else (date(c, b, a),) * 2
            hour, minute, second = (int(x or 0) for x in r.groups()[:3])
            if r[4] and not 1 <= hour <= 12 or hour > 23 or minute > 59 or second > 59:
                return None
            hour = hour % 12 + 12 * (r[4] == "P") if r[4] else hour
            east = None
            if r[5]:
                h, m2 = (0, 0) if r[5] == "Z" else (int(r[5][1:3]), int(r[5][-2:]))
                if h > 14 or m2 > 59:
                    return None
                east = (h * 60 + m2) * (-1 if r[5][0] == "-" else 1)
            return (two, timedelta(hours=hour, minutes=minute, seconds=second), east, order == "slash") if any(two) else None
    return None


def brute(rows):
    votes, out = Counter(), []
    known = [(i, s, z, r) if r is None or r[0] == "epoch" or r[2] is not None or z in ZONES else (i, s, z, None) for i, s, z, raw in rows for r in [read(raw)]]
    for _, source, _, r in known:
        if r and r[0] != "epoch" and r[3] and None in r[0]:
            votes[source, r[0][1] is None] += 1
    for i, source, zone, r in known:
        if r is None:
            out.append((i, None, "bad", False))
        elif r[0] == "epoch":
            out.append((i, r[1], "epoch", False))
        else:
            (first, second), clock, east, _ = r
            days, months = votes[source, True], votes[source, False]
            rule = "plain" if None in (first, second) or first == second else "default" if days == months else "votes"
            wall = (second if rule == "votes" and months > days else first or second) + clock
            odd = False
            if east is None:
                offsets = [wall.replace(tzinfo=ZoneInfo(zone), fold=k).utcoffset() for k in (0, 1)]
                east, odd = offsets[1] / timedelta(minutes=1), offsets[0] != offsets[1]
            out.append((i, microseconds(wall - timedelta(minutes=east)), rule, odd or rule != "plain"))
    return Counter(out)


def got(df):
    return Counter((r.stamp_id, r.utc_us, r.rule, r.ambiguous) for r in df.select("stamp_id", "utc_us", "rule", "ambiguous").collect())


FIXED = [
    None, "", " \t\n", "x" * 300_000, "2024-02-29", "2023-02-29", "2024-02-30", "2000-02-29", "2099-12-31T23:59:59", "2100-01-01", "1999-12-31", "20240229", "20240229T10:00", "31.04.2024", "30.04.2024 24:00", "30.04.2024 23:60",
    "06 Jun 2024 03:51", "06 jun 2024", "06 Juni 2024", "6 Jun 2024", "1718065060", "171806506", "1718065060123", "17180650601", "2024-06-21T02:34:14Z", "2024-06-21T02:34:14 Z", "2024-06-21T02:34z", "2024-06-21 02:34+1400", "2024-06-21 02:34+15:00",
    "2024-06-21 02:34-14:59", "2024-06-21 02:34+01:60", "2024-06-21 00:30 AM", "2024-06-21 12:30 AM", "2024-06-21 12:30PM", "2024-06-21 13:30 PM", "2024-06-21 01:30:15PM-05:00", "2024-06-21  01:30", "2024-06-21T", "2024-06-21\n", "\x0b2024-06-21\r", "2024-06-21 ", " 2024-06-21",
    "13/05/2024", "05/13/2024", "05/05/2024", "03/04/2024", "03/04/2024 10:00Z", "31/02/2024", "00/05/2024", "05/00/2024", "13/13/2024", "12/13/2024 24:00", "١١/05/2024", "2024/05/06", "2024-00-10", "2024-13-10", "2024-01-00",
]


def test_shapes_against_python(spark):
    rows = [(k * 1000 + i, source, zone, raw) for k, (source, zone) in enumerate([("s", "UTC"), (None, "Europe/Berlin"), ("t", None), ("u", "Nowhere/Land")]) for i, raw in enumerate(FIXED)]
    rows += [(9000 + i, "u", "UTC", "12/25/2024") for i in range(3)] + [(9000, "u", "UTC", "25/12/2024")] * 2 + [(9100, "u", "UTC", "03/04/2024")] * 3 + [(None, "u", "UTC", "03/04/2024 01:00")]
    rows += [(9200, "tie", "UTC", "25/12/2024"), (9201, "tie", "UTC", "12/25/2024"), (9202, "tie", "UTC", "03/04/2024")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(stamps.normalise(df)) == brute(rows)


@pytest.mark.parametrize("partitions", [1, 23])
def test_zones_against_python(spark, partitions):
    """Wall times around all changes of some years, more of one zone than of all others, over more partitions than changes."""
    rng, rows = random.Random(3), []
    for zone in ZONES:
        for _ in range(900 if zone == "America/New_York" else 150):
            at = datetime(2011 if zone == "Pacific/Apia" else 2024, 1, 1) + timedelta(minutes=rng.randrange(366 * 1440))
            rows.append((len(rows), "s", zone, at.strftime(rng.choice(["%Y-%m-%d %H:%M:%S", "%d.%m.%Y %H:%M", "%Y%m%dT%H:%M"]))))
    for zone, days in [("America/New_York", ["2024-03-10", "2024-11-03", "2061-03-13"]), ("Europe/Berlin", ["2024-03-31", "2024-10-27", "2099-10-25"]), ("Australia/Lord_Howe", ["2024-04-07", "2024-10-06"]), ("Pacific/Apia", ["2011-12-29", "2011-12-30", "2011-12-31"]), ("America/Sao_Paulo", ["2018-02-17", "2018-11-04"])]:
        rows += [(len(rows) + k, "s", zone, f"{day} {k // 60:02}:{k % 60:02}") for day in days for k in range(0, 1440, 5)]
    rows += [(-1, "s", "America/New_York", "2024-11-03 01:30")] * 700
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        result = got(stamps.normalise(spark.createDataFrame(rows, SCHEMA)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    want = brute(rows)
    assert result == want
    assert sum(n for (*_, odd), n in want.items() if odd) > 700


def test_transitions_of_all_known_zones_are_changes_of_the_offset(spark):
    zones = spark.createDataFrame([(z,) for z in ZONES], "zone string")
    for zone, at, after, until in stamps.transitions(zones).collect():
        if at != stamps.BEFORE_ALL:
            offsets = [(EPOCH + timedelta(microseconds=us)).replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone)).utcoffset() for us in (until - after - 1, until - after, at - after, at - after - 1)]
            assert timedelta(microseconds=after) in offsets and len(set(offsets)) > 1 and at < until


def test_edges(spark):
    clashes = ["utc_us", "rule", "ambiguous", "wall", "after", "until", "tie", "part", "turn", "c0", "zoned", "__wall", "__VOTES", "a.b", "lead"]
    rows = [(1, "s", "UTC", "03/04/2024"), (1, "s", "UTC", "03/04/2024"), (2, None, None, None), (None, "s", "Europe/Berlin", "2024-03-31 02:30")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(7).alias(c) for c in clashes])
    out = stamps.normalise(df)
    assert sorted(out.columns) == sorted(df.columns) and got(out) == brute(rows)
    assert out.select("`a.b`", "c0", "__VOTES", "wall").distinct().collect() == [(7, 7, 7, 7)]
    assert stamps.normalise(df.limit(0)).count() == 0
