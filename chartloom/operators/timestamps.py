"""Normalisation of timestamps in mixed formats and time zones (problem 3).

Each value is read under every format that fits it. Per source (table and facility) expectation-maximisation over
the mixture of formats turns the readings into posteriors: a value adds likelihood to each of its valid formats, the
facility's declared date order is a prior of a few pseudo-counts, which contrary values outweigh. The posterior chooses the reading, or marks the value ambiguous. All
arithmetic is on TIMESTAMP_NTZ, so the session's time zone has no influence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.session import broadcast_if_small, cut, once

FORMATS = ("iso", "slash_mdy", "slash_dmy", "dotted_dmy", "text_mdy", "text_dmy", "epoch_seconds", "epoch_millis", "compact")
#: A reading is taken if its posterior reaches this; else the value is ambiguous.
CERTAIN = 0.9
EM_STEPS = 25

# Month names (English, German, Spanish, French) and what the zone abbreviations stand for, in minutes.
MONTHS = {
    1: "january jan januar jän jänner enero ene janvier janv",
    2: "february feb februar febrero février fevrier févr fev",
    3: "march mar märz maerz mär marzo mars",
    4: "april apr abril abr avril avr",
    5: "may mai mayo",
    6: "june jun juni junio juin",
    7: "july jul juli julio juillet juil",
    8: "august aug agosto ago août aout",
    9: "september sep sept septiembre setiembre septembre",
    10: "october oct oktober okt octubre octobre",
    11: "november nov noviembre novembre",
    12: "december dec dezember dez diciembre dic décembre decembre déc",
}
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "IST": 330,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "JST": 540, "SGT": 480, "NZST": 720, "NZDT": 780,
}
# What else some of the abbreviations stand for (Ireland and Israel, China, Bangladesh, the Philippines, Malaysia, Australia).
OTHER_MEANINGS = {"IST": (60, 120), "CST": (480,), "BST": (360,), "PST": (480,), "MST": (480,), "EST": (600,)}
#: Pseudo-counts of the prior: of the date order a facility declares, and of every other format.
DECLARED, UNDECLARED = 20.0, 1.0

_NAME = r"(\p{L}{3,})\.?"
_DAY_NAME = r"(?:\p{L}{2,}\.?,\s+)?"
#: All written dates in one expression. Groups: 1-3 iso, 4-6 with slashes, 7-9 dotted, 10-12 month name first, 13-15 day
#: first, 16-21 hour, minute, second, fraction, half of the day and zone.
_WRITTEN = (
    r"^(?:(\d{4})-(\d{1,2})-(\d{1,2})|(\d{1,2})/(\d{1,2})/(\d{4})|(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})"
    r"|" + _DAY_NAME + _NAME + r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
    r"|" + _DAY_NAME + r"(\d{1,2})(?:\.|st|nd|rd|th|er)?\s+(?:de\s+)?" + _NAME + r",?\s+(?:de\s+)?(\d{4}))"
    r"(?:[T ,]\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp]\.?[Mm]\.?)?\s*([+-]\d{2}:?\d{2}|[A-Z]{1,5})?)?$"
)
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})?(Z|[+-]\d{2}:?\d{2})?$"
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _lookup(entries: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in entries.items() for x in kv)), key)


_MONTH_OF = {name: n for n, names in MONTHS.items() for name in names.split()}


def _offset(zone: Column) -> Column:
    """Minutes east of UTC of a written zone; null for an unknown one."""
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")
    return F.when(zone.rlike("^[+-]"), F.when(minutes <= 18 * 60, sign * minutes)).otherwise(_lookup(ZONES, zone))


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).cast("int")


def _reading(name: str, year, month, day, hour, minute, second, fraction, zone: Column, dated: Column) -> Column:
    """A reading as a struct, null if it is no date or time. ``dated``: without a time of day."""
    wall = F.try_make_timestamp_ntz(year, month, day, F.coalesce(hour, F.lit(0)), F.coalesce(minute, F.lit(0)), F.coalesce(second, F.lit(0)) + fraction)
    offset = F.when(zone != "", _offset(zone))
    ok = wall.isNotNull() & (F.coalesce(hour, F.lit(0)) < 24) & (F.coalesce(second, F.lit(0)) < 60) & ((zone == "") | offset.isNotNull())
    others = _lookup({k: list(v) for k, v in OTHER_MEANINGS.items()}, zone)
    return F.when(ok, F.struct(F.lit(FORMATS.index(name)).alias("format"), wall.alias("wall"), offset.cast("int").alias("offset"), dated.alias("dated"), others.alias("others")))


def _parts(value: Column, pattern: str, groups: int) -> Column:
    """The groups of an expression that fits the whole value, as an array, by one match; null where it does not fit."""
    parts = F.split(F.regexp_replace(value, pattern, "\u0001".join(f"${i}" for i in range(1, groups + 1))), "\u0001")
    return F.when(F.size(parts) == groups, parts)


def _fields(p: Column) -> Column:
    """What a written date says, from the groups of ``_WRITTEN``: numbers of day and time, offset of the zone, kind of format.

    For a date with slashes month and day are its first and second number.
    """
    g = lambda i: F.get(p, F.lit(i - 1))
    joined = lambda *at: F.concat(*(g(i) for i in at))
    named = F.lower(joined(10, 14))
    hour, half = _int(g(16)), F.lower(F.substring(g(20), 1, 1))
    hour = F.when(g(16) == "", 0).when(half == "", hour).when((hour >= 1) & (hour <= 12), F.pmod(hour, F.lit(12)) + F.when(half == "p", 12).otherwise(0)).otherwise(99)
    second = F.concat(F.when(g(18) == "", F.lit("0")).otherwise(g(18)), F.lit("."), F.when(g(19) == "", F.lit("0")).otherwise(g(19))).cast("decimal(11,6)")
    kind = (
        F.when(g(1) != "", "iso").when(g(4) != "", "slash_mdy").when(g(7) != "", "dotted_dmy").when(g(10) != "", "text_mdy").otherwise("text_dmy")
    )
    month = F.when(named != "", _lookup(_MONTH_OF, named)).otherwise(_int(joined(2, 4, 8)))
    return F.struct(
        kind.alias("kind"), _int(joined(1, 6, 9, 12, 15)).alias("year"), month.alias("month"), _int(joined(3, 5, 7, 11, 13)).alias("day"), hour.alias("hour"),
        F.coalesce(_int(g(17)), F.lit(0)).alias("minute"), second.alias("second"), F.when(g(21) != "", _offset(g(21))).cast("int").alias("offset"), g(21).alias("zone"), (g(16) == "").alias("dated"),
    )


def _digits(v: Column) -> Column:
    """Readings of digits: seconds or milliseconds since 1970, or yyyyMMddHHmm[ss]."""
    number = F.when(v.rlike(r"^(?:\d{10}|\d{13})$"), v.cast("decimal(20,0)"))
    out = []
    for name, length, per in (("epoch_seconds", 10, 1), ("epoch_millis", 13, 1000)):
        seconds = F.floor(number / per)
        wall = F.expr(_EPOCH) + F.make_dt_interval(F.floor(seconds / 86400).cast("int"), F.lit(0), F.lit(0), (F.pmod(seconds, F.lit(86400)) + F.pmod(number, F.lit(per)) / per).cast("decimal(18,6)"))
        reading = F.struct(F.lit(FORMATS.index(name)).alias("format"), wall.alias("wall"), F.lit(0).alias("offset"), F.lit(False).alias("dated"), F.lit(None).cast("array<int>").alias("others"))
        out.append(F.when(number.isNotNull() & (F.length(v) == length), reading))
    c = lambda i: F.regexp_extract(v, _COMPACT, i)
    compact = _reading("compact", _int(c(1)), _int(c(2)), _int(c(3)), _int(c(4)), _int(c(5)), _int(c(6)), F.lit(0).cast("decimal(9,6)"), c(7), F.lit(False))
    return F.array(*out, F.when(v.rlike(_COMPACT), compact))


def with_readings(values: DataFrame, value_col: str, name: str = "_readings") -> DataFrame:
    """Add all valid readings of a written date: array<struct<format, wall, offset, dated, others>>, in the order of ``FORMATS``.

    ``others`` are further meanings of the written zone. Each value is matched once, and each step is a column of its
    own, so that nothing is computed again where it is used twice.
    """
    v = F.trim(F.col(value_col))
    values = once(values, _parts=_parts(v, _WRITTEN, 21))
    values = once(values, _f=F.when(F.col("_parts").isNotNull(), _fields(F.col("_parts"))))
    f = F.col("_f")
    possible = f.isNotNull() & (f["hour"] < 24) & (f["second"] < 60) & ((f["zone"] == "") | f["offset"].isNotNull())
    wall = lambda month, day: F.try_make_timestamp_ntz(f["year"], f[month], f[day], f["hour"], f["minute"], f["second"])
    slash = f["kind"] == "slash_mdy"
    values = once(values, _w=F.when(possible, F.struct(wall("month", "day").alias("first"), F.when(slash, wall("day", "month")).alias("second"))))
    number = F.create_map(*(x for i, n in enumerate(FORMATS) for x in (F.lit(n), F.lit(i))))
    others = F.when(f["zone"] != "", _lookup({k: list(m) for k, m in OTHER_MEANINGS.items()}, f["zone"]))
    reading = lambda kind, at: F.when(at.isNotNull(), F.struct(kind.alias("format"), at.alias("wall"), f["offset"].alias("offset"), f["dated"].alias("dated"), others.alias("others")))
    w = F.col("_w")
    written = F.when(slash, F.array(reading(F.lit(FORMATS.index("slash_mdy")), w["first"]), reading(F.lit(FORMATS.index("slash_dmy")), w["second"]))).otherwise(F.array(reading(F.element_at(number, f["kind"]), w["first"])))
    found = F.when(w.isNotNull(), written).when(f.isNull() & v.rlike(r"^\d{10}"), _digits(v))
    return once(values, **{name: F.array_compact(F.coalesce(found, F.array()))}).drop("_parts", "_f", "_w")


def _em_weights(signatures: Column, total: Column, prior: Column) -> Column:
    """Mixture weights of the formats of one source, from its counted sets of valid formats."""
    k = len(FORMATS)
    start = F.transform(prior, lambda p: p / F.aggregate(prior, F.lit(0.0), lambda a, x: a + x))

    def step(w: Column, _: Column) -> Column:
        def share(i: Column) -> Column:
            mass = F.aggregate(
                signatures,
                F.lit(0.0),
                lambda a, s: a
                + F.when(
                    F.array_contains(s["formats"], i),
                    s["n"] * F.get(w, i) / F.aggregate(s["formats"], F.lit(0.0), lambda b, j: b + F.get(w, j)),
                ).otherwise(0.0),
            )
            return (F.get(prior, i) + mass) / (total + F.aggregate(prior, F.lit(0.0), lambda a, x: a + x))

        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), share)

    return F.aggregate(F.sequence(F.lit(1), F.lit(EM_STEPS)), start, step)


def normalise(values: DataFrame, value_col: str = "encounter_date") -> DataFrame:
    """Add ``utc``, ``local_day``, ``precision``, ``format``, ``posterior``, ``clock`` and ``status`` to ``values``.

    ``values`` needs the columns source_table, facility, time_zone and date_order beside the value. ``utc`` is the
    moment (TIMESTAMP_NTZ in UTC) where a time of day is given, ``local_day`` the calendar day at the facility.
    ``status`` is ok, missing (null or blank), invalid (no valid date), ambiguous (no reading is likely enough) or
    no_zone (a local time at a facility without known zone). Where it is not ok, utc and local_day are null, except
    that no_zone keeps its day. A local time that occurs twice means the first, a skipped one the moment one hour
    later on the clock; ``clock`` marks both (repeated, skipped, else once; null with a written zone). A zone
    abbreviation of several meanings has the one nearest to the facility's own offset; without known zone it is
    ambiguous.
    """
    # Both the counts and the choice read it, so each value is matched once and written once.
    values = cut(with_readings(values, value_col))
    formats = F.transform("_readings", lambda r: r["format"])
    source = F.struct("source_table", "facility")
    counted = (
        values.where(F.size("_readings") > 0)
        .groupBy(source.alias("s"), formats.alias("formats")).agg(F.count("*").cast("double").alias("n"), F.max("date_order").alias("date_order"))
        .groupBy("s").agg(F.collect_list(F.struct("formats", "n")).alias("signatures"), F.sum("n").alias("total"), F.max("date_order").alias("date_order"))
    )
    # A declared order is worth a few values; values that contradict it outweigh it, whatever their number.
    declared = lambda i: F.when(F.lit(FORMATS[i]) == F.concat(F.lit("slash_"), F.col("date_order")), DECLARED).otherwise(UNDECLARED)
    prior = F.array(*(declared(i) for i in range(len(FORMATS))))
    weights = counted.select("s", _em_weights(F.col("signatures"), F.col("total"), prior).alias("_weights"))
    # One row per table and facility.
    joined = values.withColumn("_s", source).join(broadcast_if_small(weights).withColumnRenamed("s", "_s2"), F.col("_s").eqNullSafe(F.col("_s2")), "left")
    mass = F.aggregate("_readings", F.lit(0.0), lambda a, r: a + F.get(F.col("_weights"), r["format"]))
    best = F.array_max(F.transform("_readings", lambda r: F.struct(F.get(F.col("_weights"), r["format"]).alias("w"), (-r["format"]).alias("o"), r.alias("r"))))
    joined = once(joined, _best=best).withColumn("_posterior", F.col("_best.w") / mass)
    # Readings that agree on the moment leave nothing to decide.
    same = F.size(F.array_distinct(F.transform("_readings", lambda r: F.struct(r["wall"], r["offset"], r["dated"])))) == 1
    r = F.col("_best.r")
    zone = F.col("time_zone")
    minutes = lambda at, then: (F.unix_micros(at.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 60_000_000
    timed = r.isNotNull() & ~r["dated"] & zone.isNotNull()
    joined = once(joined, _utc=F.when(timed, F.convert_timezone(zone, F.lit("UTC"), r["wall"])))
    # A wall time that comes back from UTC changed was skipped; one that an hour later on UTC repeats occurs twice.
    hour = F.expr("interval 1 hour")
    back = F.convert_timezone(F.lit("UTC"), zone, F.col("_utc"))
    again = F.convert_timezone(F.lit("UTC"), zone, F.col("_utc") + hour)
    local = timed & r["offset"].isNull()
    clock = F.when(local & (back != r["wall"]), "skipped").when(local & (again == r["wall"]), "repeated").when(local, "once")
    # An abbreviation with several meanings has the one nearest to the facility's own clock; without a known zone it stays open.
    own = minutes(r["wall"], F.col("_utc"))
    nearest = F.array_min(F.transform(F.concat(F.array(r["offset"]), r["others"]), lambda o: F.struct(F.abs(o - own).alias("d"), o.alias("o"))))["o"]
    offset = F.when(r["others"].isNull(), r["offset"]).when(zone.isNotNull(), nearest)
    joined = once(joined, _offset=offset).withColumn("clock", clock)
    open_zone = r["others"].isNotNull() & F.col("_offset").isNull()
    clear = ((F.col("_posterior") >= CERTAIN) | same) & ~open_zone
    utc = F.when(r["dated"], None).when(F.col("_offset").isNotNull(), r["wall"] - F.make_dt_interval(F.lit(0), F.lit(0), F.col("_offset"), F.lit(0).cast("decimal(18,6)"))).otherwise(F.col("_utc"))
    joined = joined.withColumn("utc", F.when(clear, utc))
    day = F.when(F.col("_offset").isNotNull() & ~r["dated"], F.when(zone.isNotNull(), F.convert_timezone(F.lit("UTC"), zone, F.col("utc")).cast("date"))).otherwise(r["wall"].cast("date"))
    blank = F.trim(F.coalesce(F.col(value_col), F.lit(""))) == ""
    status = (
        F.when(blank, "missing").when(F.size("_readings") == 0, "invalid").when(~clear, "ambiguous")
        .when(zone.isNull() & ~r["dated"] & r["offset"].isNull(), "no_zone").otherwise("ok")
    )
    return (
        joined.withColumn("local_day", F.when(clear, day))
        .withColumn("precision", F.when(clear & r["dated"], "day").when(clear & F.col("_best").isNotNull(), "time"))
        .withColumn("format", F.get(F.array(*(F.lit(x) for x in FORMATS)), r["format"]))
        .withColumn("posterior", F.round("_posterior", 6))
        .withColumn("status", status)
        .drop("_readings", "_s", "_s2", "_weights", "_best", "_posterior", "_utc", "_offset")
    )


def dated_records(encounters: DataFrame, facilities: DataFrame, **tables: tuple[DataFrame, str]) -> DataFrame:
    """The dates of encounters and of further tables with their facility's zone and date order.

    ``tables`` maps a table's name to (rows with encounter_id and encounter_date, key column). An encounter stored
    twice counts once, the later copy; records without encounter have no facility.
    """
    latest = (
        encounters.where("encounter_id is not null").groupBy("encounter_id")
        .agg(F.max_by(F.struct("encounter_date", "facility"), F.struct("loaded_at", "encounter_date")).alias("e"))
        .select("encounter_id", F.col("e.encounter_date").alias("encounter_date"), F.col("e.facility").alias("facility"))
    )
    zones = facilities.where("facility is not null").groupBy("facility").agg(F.min("time_zone").alias("time_zone"), F.min("date_order").alias("date_order"))
    placed = latest.join(zones, "facility", "left")
    columns = ["source_table", "record_key", "encounter_id", "encounter_date", "facility", "time_zone", "date_order"]
    out = placed.withColumn("source_table", F.lit("encounters")).withColumn("record_key", F.col("encounter_id")).select(*columns)
    for name, (rows, key) in tables.items():
        own = rows.select(F.lit(name).alias("source_table"), F.col(key).cast("string").alias("record_key"), "encounter_id", "encounter_date")
        # Null keys meet nothing and stay out of the join, whose tasks they would load unevenly.
        bare = own.where("encounter_id is null").withColumns({c: F.lit(None).cast("string") for c in ("facility", "time_zone", "date_order")})
        out = out.unionByName(own.where("encounter_id is not null").join(placed.drop("encounter_date"), "encounter_id", "left").select(*columns)).unionByName(bare.select(*columns))
    return out


def contradicting_records(encounters: DataFrame, facilities: DataFrame, **tables: tuple[DataFrame, str]) -> DataFrame:
    """Records (source_table, record_key) whose date contradicts the date of their encounter.

    With a time of day on both sides the UTC minutes are compared, else the calendar days at the facility. Missing,
    invalid and ambiguous dates, and records without encounter, contradict nothing.
    """
    minute = F.substring(F.col("utc").cast("string"), 1, 16).alias("minute")
    dated = normalise(dated_records(encounters, facilities, **tables)).where("local_day is not null")
    # Both sides of the comparison read it, so it is written once.
    dated = cut(dated.select("source_table", "record_key", "encounter_id", "local_day", minute))
    own = dated.where("source_table = 'encounters'").select("encounter_id", F.col("local_day").alias("their_day"), F.col("minute").alias("their_minute"))
    rest = dated.where("source_table <> 'encounters' and record_key is not null")
    both = F.col("minute").isNotNull() & F.col("their_minute").isNotNull()
    return (
        rest.join(own, "encounter_id")
        .where(F.when(both, F.col("minute") != F.col("their_minute")).otherwise(F.col("local_day") != F.col("their_day")))
        .select("source_table", "record_key").distinct()
    )
