from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from chartloom.operators.timestamps import contradicting_records, normalise

VALUE = "source_table string, facility string, time_zone string, date_order string, encounter_date string, status string"
NY, BERLIN = "America/New_York", "Europe/Berlin"
CASES = [  # value, zone, order, UTC moment or day, status
    ("2024-11-04T04:44:37Z", NY, "mdy", "2024-11-04 04:44:37", "ok"),
    ("07/15/2024 00:40", NY, "mdy", "2024-07-15 04:40:00", "ok"),
    ("03/04/2024 10:00", NY, "mdy", "2024-03-04 15:00:00", "ok"),
    ("03/04/2024 10:00", BERLIN, "dmy", "2024-04-03 08:00:00", "ok"),
    ("3/15/2024 12:08 AM", NY, "mdy", "2024-03-15 04:08:00", "ok"),
    ("27.12.2025 14:10", BERLIN, "dmy", "2025-12-27 13:10:00", "ok"),
    ("1660917824", NY, "mdy", "2022-08-19 14:03:44", "ok"),
    ("1738371309906", NY, "mdy", "2025-02-01 00:55:09.906", "ok"),
    ("20230413092949", NY, "mdy", "2023-04-13 13:29:49", "ok"),
    ("202411030221-0700", NY, "mdy", "2024-11-03 09:21:00", "ok"),
    ("2024-10-14 08:30:13.645658-0400", NY, "mdy", "2024-10-14 12:30:13.645658", "ok"),
    ("Sun, 02 Oct 2022 03:08:38 -0500", NY, "mdy", "2022-10-02 08:08:38", "ok"),
    ("12 Aug 2022 15:38 CEST", BERLIN, "dmy", "2022-08-12 13:38:00", "ok"),
    ("Dec 14 2021 2:02PM", NY, "mdy", "2021-12-14 19:02:00", "ok"),
    ("2024-11-03 01:30", NY, "mdy", "2024-11-03 05:30:00", "ok"),  # occurs twice: the first
    ("2024-03-10 02:30", NY, "mdy", "2024-03-10 07:30:00", "ok"),  # skipped: 03:30 on the clock
    ("March 27, 2025", NY, "mdy", "2025-03-27", "ok"),
    ("27 de diciembre de 2023", BERLIN, "dmy", "2023-12-27", "ok"),
    ("20. März 2021", BERLIN, "dmy", "2021-03-20", "ok"),
    ("31.04.2023", BERLIN, "dmy", None, "invalid"),
    ("2024-02-30", NY, "mdy", None, "invalid"),
    ("2024-01-01 24:10", NY, "mdy", None, "invalid"),
    ("13:40 PM", NY, "mdy", None, "invalid"),
    ("20240105", NY, "mdy", None, "invalid"),
    ("see chart", NY, "mdy", None, "invalid"),
    ("", NY, "mdy", None, "missing"),
    (None, NY, "mdy", None, "missing"),
    ("2024-01-01 10:00", None, None, None, "no_zone"),
    ("x" * 100_000, NY, "mdy", None, "invalid"),
]


def rows(spark, cases):
    return spark.createDataFrame([("t", f"{z}{o}", z, o, v, "x") for v, z, o, *_ in cases], VALUE).drop("status")


@pytest.mark.parametrize("session_zone", ["UTC", "Asia/Tokyo"])
def test_moments_and_days(spark, session_zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        out = normalise(rows(spark, CASES)).selectExpr("encounter_date", "time_zone", "cast(utc as string) utc", "cast(local_day as string) d", "precision", "status").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    got = {(r.encounter_date, r.time_zone): r for r in out}
    for value, zone, _, want, status in CASES:
        r = got[value, zone]
        assert r.status == status, (value, r)
        assert (r.d if r.precision == "day" else r.utc) == want, (value, r)


def test_against_zoneinfo(spark):
    zones = [NY, BERLIN, "Australia/Sydney", "Asia/Kolkata", "America/Phoenix"]
    walls = [datetime(2021, 1, 1) + timedelta(hours=7 * i + 13, minutes=i % 60) for i in range(700)]
    cases = [(w.strftime("%Y-%m-%d %H:%M:%S"), z, "mdy") for w in walls for z in zones]
    got = {(r.encounter_date, r.time_zone): r.utc for r in normalise(rows(spark, cases)).collect()}
    for w in walls:
        for z in zones:
            want = w.replace(tzinfo=ZoneInfo(z)).astimezone(timezone.utc).replace(tzinfo=None)
            assert got[w.strftime("%Y-%m-%d %H:%M:%S"), z] == want


def test_order_is_learnt_without_a_declared_one(spark):
    make = lambda f, vs: [("t", f, NY, None, v) for v in vs]
    clear = [f"{d}/0{m}/2024" for d in range(13, 28) for m in range(1, 9)]
    values = make("learnt", [*clear, "03/04/2024"]) + make("unknown", ["03/04/2024"]) + make("same", ["04/04/2024"])
    out = {(r.facility, r.encounter_date): r for r in normalise(spark.createDataFrame(values, VALUE.replace(", status string", ""))).collect()}
    assert str(out["learnt", "03/04/2024"].local_day) == "2024-04-03"
    assert out["unknown", "03/04/2024"].status == "ambiguous" and out["unknown", "03/04/2024"].local_day is None
    assert str(out["same", "04/04/2024"].local_day) == "2024-04-04"


def test_contrary_values_outweigh_the_declared_order(spark):
    make = lambda f, vs: [("t", f, NY, "mdy", v) for v in vs]
    contrary = [f"{d}/0{m}/2024" for d in range(13, 28) for m in range(1, 9)] * 2
    values = make("contrary", [*contrary, "03/04/2024"]) + make("split", [*contrary[:30], "03/04/2024"]) + make("alone", ["03/04/2024"])
    out = {(r.facility, r.encounter_date): r for r in normalise(spark.createDataFrame(values, VALUE.replace(", status string", ""))).collect()}
    assert str(out["contrary", "03/04/2024"].local_day) == "2024-04-03"
    assert out["split", "03/04/2024"].status == "ambiguous"
    assert str(out["alone", "03/04/2024"].local_day) == "2024-03-04"


def test_clock_changes_and_zone_names(spark):
    cases = [("2024-10-27 02:30", BERLIN, "dmy", "2024-10-27 00:30:00", "repeated"), ("2024-03-31 02:30", BERLIN, "dmy", "2024-03-31 01:30:00", "skipped"), ("2024-10-28 02:30", BERLIN, "dmy", "2024-10-28 01:30:00", "once"), ("2024-06-01 10:00 IST", "Europe/Dublin", "dmy", "2024-06-01 09:00:00", None), ("2024-06-01 10:00 IST", "Asia/Kolkata", "dmy", "2024-06-01 04:30:00", None), ("2024-06-01 10:00 CST", "Asia/Shanghai", "dmy", "2024-06-01 02:00:00", None), ("2024-06-01 10:00 IST", None, "dmy", None, None), ("2024-06-01 10:00 JST", None, "dmy", "2024-06-01 01:00:00", None)]
    got = {(r.encounter_date, r.time_zone): r for r in normalise(rows(spark, cases)).selectExpr("*", "cast(utc as string) u").collect()}
    for value, zone, _, utc, clock in cases:
        r = got[value, zone]
        assert (r.u, r.clock) == (utc, clock), (value, zone, r)
        assert r.status == ("ok" if utc else "ambiguous")


def test_contradictions(spark):
    enc = spark.createDataFrame(
        [("E1", "2024-03-04 10:00", "F", datetime(2024, 1, 1)), ("E1", "2024-03-05 10:00", "F", datetime(2024, 1, 2)), ("E2", "March 4, 2024", "F", None), ("E3", None, "F", None), (None, "x", "F", None)],
        "encounter_id string, encounter_date string, facility string, loaded_at timestamp_ntz",
    )
    fac = spark.createDataFrame([("F", NY, "mdy")], "facility string, time_zone string, date_order string")
    recs = [
        (1, "E1", "2024-03-05T15:00:59Z"), (2, "E1", "2024-03-05T15:01:00Z"), (3, "E1", "03/05/2024"), (4, "E1", "03/06/2024"),
        (5, "E2", "2024-03-05T03:00:00Z"), (6, "E2", "2024-03-05T08:00:00Z"), (7, "E3", "03/06/2024"), (8, "E9", "03/06/2024"), (9, "E1", "n/a"), (10, None, "03/06/2024"),
    ]
    table = spark.createDataFrame(recs, "id long, encounter_id string, encounter_date string")
    got = {tuple(r) for r in contradicting_records(enc, fac, meds=(table, "id")).collect()}
    assert got == {("meds", "2"), ("meds", "4"), ("meds", "6")}
    assert contradicting_records(enc.limit(0), fac.limit(0), meds=(table.limit(0), "id")).count() == 0
