"""Mixed timestamp normalisation: stamps of many shapes to UTC, zones by a sweep over wall times and transitions.

Wall times and the transitions of their zones are range-partitioned and sorted together; each partition fills the current
offset forward in one pass. A partition that begins inside a zone lacks the transition before its first row: these carries,
one row for each partition, are looked up afterwards and joined by partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialens.llm.runtime import SPACE, col, fresh, map_arrow, written

#: Rows of one source are dealt over so many tasks where they meet its votes.
SALTS = 64
DAY, MINUTE, SECOND = 86_400_000_000, 60_000_000, 1_000_000
#: Days from 1970 to 2000, where the years of the stamps begin; transitions are sought from two days before to two days after their century.
DAYS_TO_2000, DAYS_OF_CENTURY = 10_957, 36_525
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
BEFORE_ALL = -(2**62)

_MONTH, _YEAR, _TWO, _NAME = "(?:0[1-9]|1[0-2])", "20[0-9][0-9]", "[0-9]{2}", "(?:" + "|".join(MONTHS) + ")"
_DATE = f"(?:{_YEAR}-{_MONTH}-{_TWO}|{_YEAR}{_MONTH}{_TWO}|{_TWO}[.]{_MONTH}[.]{_YEAR}|{_TWO} {_NAME} {_YEAR}|{_TWO}/{_TWO}/{_YEAR})"
_MINUTES = ":[0-5][0-9](?::[0-5][0-9])?"
_CLOCK = f"(?:(?:[01][0-9]|2[0-3]){_MINUTES}|(?:0[1-9]|1[0-2]){_MINUTES} ?[AP]M)"
_OFFSET = "(?: ?(?:Z|[+-](?:0[0-9]|1[0-4]):?[0-5][0-9]))?"
#: Everything about a dated stamp but whether its month has its day.
DATED = rf"\A{_DATE}(?:[T ]{_CLOCK}{_OFFSET})?\z"
EPOCH = r"\A[0-9]{10}(?:[0-9]{3})?\z"


def known_zones(spark: SparkSession) -> list[str]:
    """The names in Spark's own time zone rules: some six hundred, whatever the input."""
    java = spark.sparkContext._jvm.java
    return sorted(java.lang.String.join(",", java.time.ZoneId.getAvailableZoneIds()).split(","))


def _day_number(year: Column, month: Column, day: Column) -> Column:
    """Days from 1970 to a date of 2000 to 2099 (every fourth year is a leap year); null if there is no such date."""
    leap = year % 4 == 0
    size = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    short = F.when(month <= 2, 0).when(leap, 1).otherwise(2)
    years = (year - 2000) * 365 + F.floor((year - 1997) / 4).cast("int")
    months = F.floor((month * 367 - 362) / 12).cast("int") - short
    return F.when(month.between(1, 12) & (day >= 1) & (day <= size), years + months + day - 1 + DAYS_TO_2000)


def _parsed(stamps: DataFrame, raw: str, zone: str, names: list[str]) -> DataFrame:
    """stamps with the columns `names`: wall (microseconds of the wall time, or of UTC where the stamp says its own offset), other (the
    same month first, where a slashed date can be read both ways), lead (1: possible day first only, -1: month first only), zoned
    (whether wall is in the row's zone) and rule (bad, epoch or plain)."""
    steps = fresh(stamps, "text", "epoch", "third", "y", "a", "b", "first", "second", "clock", "late", "own", "time", "known", "good")
    text, epoch, third, y, a, b, first, second, clock, late, own, time, known, good = steps
    c, part = F.col, lambda x, at, size: F.substring(F.col(x), at, size)
    number = lambda x: x.try_cast("int")
    slash, word, dots, iso = c(third) == "/", c(third) == " ", c(third) == ".", part(text, 5, 1) == "-"
    df = stamps.withColumns({text: F.trim(col(raw), F.lit(SPACE)), known: col(zone).isin(known_zones(stamps.sparkSession))})
    df = df.withColumn(epoch, F.when(c(text).rlike(EPOCH), c(text).try_cast("long") * F.when(F.length(text) == 10, F.lit(SECOND)).otherwise(F.lit(1000))))
    df = df.withColumn(text, F.when(c(text).rlike(DATED), c(text)))
    df = df.withColumn(third, part(text, 3, 1))
    year = F.when(word, part(text, 8, 4)).when(slash | dots, part(text, 7, 4)).otherwise(part(text, 1, 4))
    name = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(text, 4, 3)).cast("int")
    month = F.when(word, name).otherwise(number(F.when(slash | dots, part(text, 4, 2)).when(iso, part(text, 6, 2)).otherwise(part(text, 5, 2))))
    day = F.when(slash | dots | word, part(text, 1, 2)).when(iso, part(text, 9, 2)).otherwise(part(text, 7, 2))
    rest = F.when(word, part(text, 13, 30)).when(slash | dots | iso, part(text, 12, 30)).otherwise(part(text, 10, 30))
    df = df.withColumns({y: number(year), a: number(day), b: month, clock: F.replace(rest, F.lit(" "), F.lit(""))})
    df = df.withColumns({first: _day_number(c(y), c(b), c(a)), second: F.when(slash, _day_number(c(y), c(a), c(b)))})
    df = df.withColumns({late: F.regexp_extract(clock, "[AP]M", 0), own: F.regexp_extract(clock, "(?:Z|[+-].*)$", 0)})
    hour = F.when(c(late) == "", number(part(clock, 1, 2))).otherwise(number(part(clock, 1, 2)) % 12 + F.when(c(late) == "PM", 12).otherwise(0))
    seconds = F.when(part(clock, 6, 1) == ":", number(part(clock, 7, 2))).otherwise(0)
    df = df.withColumn(time, F.when(c(clock) == "", 0).otherwise(hour * 3600 + number(part(clock, 4, 2)) * 60 + seconds).cast("long") * SECOND)
    east = number(part(own, 2, 2)) * 60 + number(F.right(c(own), F.lit(2)))
    offset = F.when(c(own).startswith("+"), east).when(c(own).startswith("-"), -east).otherwise(0).cast("long") * MINUTE
    one, two = F.coalesce(first, second), F.when(c(first) != c(second), c(second))
    df = df.withColumn(good, F.coalesce(one.isNotNull() & ((c(own) != "") | c(known)), F.lit(False)))
    at = lambda days: days.cast("long") * DAY + c(time) - offset
    wall, other, lead, zoned, rule = names
    out = {
        wall: F.coalesce(c(epoch), F.when(c(good), at(one))),
        other: F.when(c(good), at(two)),
        lead: F.when(c(good) & slash & c(first).isNull(), -1).when(c(good) & slash & c(second).isNull(), 1),
        zoned: c(good) & (c(own) == ""),
        rule: F.when(c(epoch).isNotNull(), "epoch").when(c(good), "plain").otherwise("bad"),
    }
    return df.withColumns(out).drop(*steps)


def transitions(zones: DataFrame) -> DataFrame:
    """zone, at, after, until of each known name in zones (one column, distinct): from wall time `at` on, the offset `after` holds (microseconds);
    wall times before `until` are skipped or repeated ones. The first row of a zone stands before all times.

    The offsets of all days of the century are compared, and the minutes of the days on which they change. Two changes of one
    zone whose skipped or repeated times overlap are not foreseen; there are none.
    """
    moment = lambda us: F.timestamp_micros(us)
    offset = lambda us: F.unix_micros(F.from_utc_timestamp(moment(us), F.col("zone"))) - us
    start = (DAYS_TO_2000 - 2) * DAY
    day, minute = F.col("day"), F.col("minute")
    days = zones.select("zone", F.explode(F.sequence(F.lit(0), F.lit(DAYS_OF_CENTURY + 4))).alias("k")).select("zone", (F.lit(start) + F.col("k") * F.lit(DAY)).alias("day"))
    minutes = days.filter(offset(day) != offset(day + F.lit(DAY))).select("zone", F.explode(F.sequence(day + F.lit(MINUTE), day + F.lit(DAY), F.lit(MINUTE))).alias("minute"))
    changes = minutes.select("zone", "minute", offset(minute - F.lit(MINUTE)).alias("before"), offset(minute).alias("after")).filter("before != after")
    turns = changes.select("zone", (minute + F.least("before", "after")).alias("at"), "after", (minute + F.greatest("before", "after")).alias("until"))
    return turns.unionByName(zones.select("zone", F.lit(BEFORE_ALL).alias("at"), offset(F.lit(start)).alias("after"), F.lit(BEFORE_ALL).alias("until")))


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives each row the columns after and until of the last transition before it in its partition; null before the first. Transitions leave."""
    last = None
    for batch in batches:
        turn = batch["turn"].to_numpy(zero_copy_only=False)
        at = np.maximum.accumulate(np.where(turn, np.arange(len(turn)), -1))
        own = batch.schema.names
        columns = {}
        for name, carried in zip(("after", "until"), last or (0, 0), strict=True):
            values = batch[name].fill_null(0).to_numpy()
            columns[name] = np.where(at >= 0, values[at], carried)
        if len(turn):
            known = (at >= 0) | (last is not None)
            if known[-1]:
                last = tuple(int(columns[name][-1]) for name in ("after", "until"))
            arrays = [pa.array(columns[n], mask=~known) if n in columns else batch[n] for n in own]
            yield pa.RecordBatch.from_arrays(arrays, names=own).filter(pa.array(~turn))


def _swept(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """rows (zone, wall, tie and others) with after and until of their last transition."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows.withColumn("turn", F.lit(False)).unionByName(turns.select("zone", F.col("at").alias("wall"), F.lit(True).alias("turn"), "after", "until"), allowMissingColumns=True)
    keys = ["zone", "wall", F.col("turn").desc(), "tie"]
    ordered = both.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields)
    filled = written(map_arrow(ordered, _fill, fields), "swept")
    heads = filled.filter("after IS NULL").groupBy("part").agg(F.min(F.struct("zone", "wall")).alias("head")).select("part", "head.*")
    carries = heads.join(turns, "zone").filter("at <= wall").groupBy("part").agg(F.max_by(F.struct("after", "until"), "at").alias("carry"))
    joined = filled.join(carries, "part", "left")
    return joined.withColumns({k: F.coalesce(F.col(k), F.col(f"carry.{k}")) for k in ("after", "until")}).drop("part", "carry", "turn")


def normalise(stamps: DataFrame, raw: str = "raw", zone: str = "zone", source: str = "source", keep: Sequence[str] | None = None) -> DataFrame:
    """stamps (the columns `keep` of it, if named) with utc_us, rule and ambiguous; columns of stamps with those names are replaced.

    A null stamp, one of another shape, an impossible date or time, and a date without offset whose zone is null or unknown are bad: utc_us
    null, ambiguous false, no vote. A null source votes as a source of its own. Each repeated row votes and gives a row of its own.
    Very long texts are bad at once. Other columns pass, whatever their names; an empty table gives an empty one.
    """
    df = stamps.drop("utc_us", "rule", "ambiguous")
    kept = list(df.columns if keep is None else keep)
    names = fresh(df, "wall", "other", "lead", "zoned", "rule")
    wall, other, lead, zoned, rule = names
    salt, votes, told = fresh(df, "salt", "votes", "told")
    needed = dict.fromkeys([*kept, zone, source])
    rows = written(_parsed(df, raw, zone, names).select(*map(col, needed), *map(F.col, names)), "parsed")
    won = rows.filter(F.col(lead).isNotNull()).groupBy(col(source).alias(told)).agg(F.sum(lead).alias(votes))
    won = won.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.filter(F.col(other).isNotNull()).withColumn(salt, F.pmod(F.xxhash64(*map(col, kept), F.col(wall), F.col(other)), F.lit(SALTS)).cast("int")).alias("l")
    met = dealt.join(won.alias("r"), col(source).eqNullSafe(F.col(f"r.{told}")) & (F.col(f"l.{salt}") == F.col(f"r.{salt}")), "left").select("l.*", F.coalesce(votes, F.lit(0)).alias(votes))
    decided = met.withColumns({wall: F.when(F.col(votes) < 0, F.col(other)).otherwise(F.col(wall)), rule: F.when(F.col(votes) == 0, "default").otherwise("votes")})
    part = lambda df: df.select(*[col(x).alias(f"c{i}") for i, x in enumerate(kept)], col(zone).alias("zone"), F.col(wall).alias("wall"), F.col(zoned).alias("zoned"), F.col(rule).alias("rule"))
    plain = part(rows.filter(F.col(other).isNull())).unionByName(written(part(decided), "decided"))
    in_zone = plain.filter("zoned").drop("zoned").withColumn("tie", F.xxhash64("wall", *[f"c{i}" for i in range(len(kept))]))
    turns = written(transitions(in_zone.select("zone").distinct()), "transitions")
    swept = _swept(in_zone, turns).select(*plain.drop("zone", "wall", "zoned").columns, (F.col("wall") - F.col("after")).alias("utc_us"), (F.col("wall") < F.col("until")).alias("odd"))
    done = plain.filter("NOT zoned").select(*swept.drop("utc_us", "odd").columns, F.col("wall").alias("utc_us"), F.lit(False).alias("odd")).unionByName(swept)
    return done.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(kept)], "utc_us", "rule", (F.col("odd") | F.col("rule").isin("votes", "default")).alias("ambiguous"))
