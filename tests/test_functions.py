from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.functions import measures, models, recurrence, texts, times


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


def test_utc_rules(spark):
    zone = lambda z: F.lit(z).cast("string")
    r = one(
        spark,
        naive=times.to_utc_field(ntz("2024-06-15 12:00:00")),
        winter=times.to_utc(ntz("2024-01-01 12:00:00"), zone("America/New_York")),
        summer=times.to_utc(ntz("2024-06-15 12:00:00"), zone("America/New_York")),
        none=times.to_utc(ntz("2024-01-01 12:00:00"), zone(None)),
        empty=times.to_utc(ntz("2024-01-01 12:00:00"), zone("")),
        wrong=times.to_utc(ntz("2024-01-01 12:00:00"), zone("Invalid/Zone")),
        offset=times.to_utc(ntz("2024-01-01 12:00:00"), zone("+05:00")),
        null=times.to_utc(F.lit(None).cast("timestamp_ntz"), zone("UTC")),
        gap=times.to_utc(ntz("2024-03-10 02:30:00"), zone("America/New_York")),
        overlap=times.to_utc(ntz("2024-11-03 01:30:00"), zone("America/New_York")),
        known=times.is_zone(zone("Europe/Paris")),
        unknown=times.is_zone(zone("+05:00")),
        missing=times.is_zone(zone(None)),
    )
    noon = datetime(2024, 1, 1, 12)
    assert r.naive == datetime(2024, 6, 15, 12) and r.winter == datetime(2024, 1, 1, 17) and r.summer == datetime(2024, 6, 15, 16)
    assert r.none == r.empty == r.wrong == r.offset == noon and r.null is None
    assert r.gap == datetime(2024, 3, 10, 7, 30) and r.overlap == datetime(2024, 11, 3, 5, 30)
    assert r.known and not r.unknown and not r.missing


def test_instants_with_offsets(spark):
    r = one(spark, a=times.parse_instant(F.lit("2024-01-01T12:00:00-05:00")), b=times.parse_instant(F.lit("2024-01-01 12:00:00Z")), c=times.parse_instant(F.lit("2024-01-01T12:00:00.5+0530")), d=times.parse_instant(F.lit("2024-01-01")), e=times.parse_instant(F.lit("no time")), f=times.parse_instant(F.lit(None).cast("string")))
    assert r.a == datetime(2024, 1, 1, 17) and r.b == datetime(2024, 1, 1, 12) and r.c == datetime(2024, 1, 1, 6, 30, 0, 500_000) and r.d == datetime(2024, 1, 1)
    assert r.e is None and r.f is None


def test_spans(spark):
    at = ntz("2024-02-29 13:45:59.5")
    r = one(spark, **{f"{p}_{k}": f(at, F.lit(p)) for p in times.PRECISIONS for k, f in (("s", times.span_start), ("e", times.span_end))})
    assert (r.year_s, r.year_e) == (datetime(2024, 1, 1), datetime(2025, 1, 1)) and (r.month_s, r.month_e) == (datetime(2024, 2, 1), datetime(2024, 3, 1))
    assert (r.day_s, r.day_e) == (datetime(2024, 2, 29), datetime(2024, 3, 1)) and (r.second_s, r.second_e) == (datetime(2024, 2, 29, 13, 45, 59), datetime(2024, 2, 29, 13, 46))


def test_time_arithmetic_ignores_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            r = one(spark, us=times.epoch_micros(ntz("1969-12-31 23:59:59.25")), s=times.epoch_seconds(ntz("2024-01-01 00:00:01.75")), m=times.minutes_between(ntz("2024-01-01 00:00:00"), ntz("2024-01-01 01:30:59")), n=times.minutes_between(ntz("2024-01-01 00:00:00"), F.lit(None).cast("timestamp_ntz")))
            assert r.us == -750_000 and r.s == 1_704_067_201 and r.m == 90 and r.n is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_texts(spark):
    r = one(
        spark,
        alias=texts.alias(F.lit(" John.Doe@Example.COM ")),
        phone=texts.phone(F.lit("+1 (555) 010-9999")),
        domain=texts.domain(F.lit("https://Sub.Example.com:8080/a?b=c")),
        no_domain=texts.domain(F.lit("not a url %%")),
        query=texts.search_query(F.lit("https://x.org/search?q=caf%C3%A9+au+lait&x=1")),
        kind=texts.media_type(F.lit("/a/b.PDF")),
        none=texts.media_type(F.lit("/a.b/c")),
        parent=texts.parent_path(F.lit("a/b/c")),
        ids=texts.message_ids(F.lit("<a@x>  <b@y>")),
        tokens=texts.tokens(F.lit("Ünïcode, words-and 42!")),
        title=texts.title(F.lit("<html><TITLE>\n Hi there </TITLE>")),
        plain=texts.html_text(F.lit("<p>a <b>b</b></p><script>var x = '<p>';</script>c")),
        empty=texts.has_text(F.lit(None).cast("string"), F.lit("")),
        some=texts.has_text(F.lit(None).cast("string"), F.lit("x")),
    )
    assert r.alias == "john.doe@example.com" and r.phone == "+15550109999" and r.domain == "sub.example.com" and r.no_domain is None
    assert r.query == "café au lait" and r.kind == "document" and r.none == "other" and r.parent == "a/b" and r.ids == ["<a@x>", "<b@y>"]
    assert r.tokens == ["ünïcode", "words", "and", "42"] and r.title == "Hi there" and r.plain == "a b c" and not r.empty and r.some


def test_measures(spark):
    vector = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    r = one(spark, paris_london=measures.haversine(F.lit(48.8566), F.lit(2.3522), F.lit(51.5074), F.lit(-0.1278)), same=measures.haversine(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)), line=measures.haversine(F.lit(0.0), F.lit(179.9), F.lit(0.0), F.lit(-179.9)), cos=measures.cosine(vector(1, 0), vector(1, 1)), zero=measures.cosine(vector(0, 0), vector(1, 1)), ragged=measures.dot(vector(1), vector(1, 1)), bits=measures.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")), area=measures.box_area(F.array(*(F.lit(x) for x in (10, 40, 30, 5)))))
    assert abs(r.paris_london - 343_550) < 600 and r.same == 0 and abs(r.line - 22_239) < 5
    assert r.cos == pytest.approx(2**-0.5) and r.zero is None and r.ragged is None and r.bits == 64 and r.area == 20 * 35


def test_recurrences(spark):
    rows = [("d", "FREQ=DAILY;COUNT=3"), ("w", "FREQ=WEEKLY;INTERVAL=2;UNTIL=20240131T090000Z"), ("m", "FREQ=MONTHLY;COUNT=3"), ("y", "FREQ=YEARLY;UNTIL=20260101"), ("n", None)]
    df = spark.createDataFrame(rows, "k string, rule string").withColumn("start", F.when(F.col("k") == "m", ntz("2024-01-31 09:00:00")).otherwise(ntz("2024-01-01 09:00:00")))
    got = {}
    for r in recurrence.occurrences(df, "k", "start", "rule").orderBy("k", "occurs_at").collect():
        got.setdefault(r.k, []).append((r.occurs_at.month, r.occurs_at.day))
    assert got == {"d": [(1, 1), (1, 2), (1, 3)], "w": [(1, 1), (1, 15), (1, 29)], "m": [(1, 31), (3, 31), (5, 31)], "y": [(1, 1), (1, 1)], "n": [(1, 1)]}
    endless = spark.createDataFrame([("e", "FREQ=DAILY")], "k string, rule string").withColumn("start", ntz("2024-01-01 00:00:00"))
    assert recurrence.occurrences(endless, "k", "start", "rule", 10).count() == 11


def test_recurrences_match_another_reader_of_the_standard(spark):
    rrule = pytest.importorskip("dateutil.rrule")
    rules = ["FREQ=WEEKLY;BYDAY=MO,WE;COUNT=4", "FREQ=WEEKLY;INTERVAL=2;BYDAY=SU,TU;WKST=SU;COUNT=6", "FREQ=MONTHLY;BYDAY=2TU,-1FR;COUNT=7", "FREQ=MONTHLY;BYMONTHDAY=-1,15;UNTIL=20250301T000000", "FREQ=MONTHLY;BYMONTHDAY=31;COUNT=5", "FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=29;COUNT=3",
             "FREQ=YEARLY;BYDAY=20MO;COUNT=3", "FREQ=YEARLY;BYMONTH=1,6;BYDAY=1MO;COUNT=5", "FREQ=DAILY;BYDAY=SA;BYMONTH=3;COUNT=6", "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1;COUNT=5", "FREQ=DAILY;INTERVAL=10;UNTIL=20240401"]
    start = datetime(2024, 1, 3, 9)
    df = spark.createDataFrame(list(enumerate(rules)), "k int, rule string").withColumn("start", ntz(str(start)))
    got = {}
    for r in recurrence.occurrences(df, "k", "start", "rule").orderBy("k", "occurs_at").collect():
        got.setdefault(r.k, []).append(r.occurs_at)
    assert got == {k: list(rrule.rrulestr(x, dtstart=start)) for k, x in enumerate(rules)}


def test_unreadable_rules_are_told_and_make_nothing_up(spark):
    rules = ["FREQ=SECONDLY;COUNT=2", "FREQ=DAILY;BYHOUR=9", "FREQ=WEEKLY;BYDAY=XX", "nonsense", "FREQ=DAILY;COUNT=0", "FREQ=DAILY;COUNT=1", None]
    df = spark.createDataFrame(list(enumerate(rules)), "k int, rule string").withColumn("start", ntz("2024-01-01 09:00:00"))
    assert sorted(r.k for r in recurrence.unreadable(df, "rule").collect()) == [0, 1, 2, 3, 4]
    got = recurrence.occurrences(df, "k", "start", "rule").collect()
    assert len(got) == 7 and {r.k for r in got if r.occurs_at is None} == {0, 1, 2, 3, 4}


def test_model_boundary(spark):
    df = spark.createDataFrame([(1, "a", bytearray(b"one")), (2, None, None), (3, "a", bytearray(b"two"))], "id long, t string, b binary")
    rows = df.select("id", models.text_embedding(F.col("t"), models.stub_embedding).alias("v"), models.to_text(F.col("b"), lambda raw: raw.decode().upper()).alias("text"), models.perceptual_hash(F.col("b"), lambda raw: np.arange(16).reshape(4, 4) if raw == b"one" else None).alias("p")).orderBy("id").collect()
    assert rows[0].v == rows[2].v and len(rows[0].v) == 64 and rows[1].v is None
    assert [r.text for r in rows] == ["ONE", None, "TWO"] and rows[0].p is not None and rows[1].p is None and rows[2].p is None
    found = models.faces(df, "id", "b", lambda raw: [([1, 2, 3, 0], [0.5] * 4)] * (2 if raw == b"one" else 0)).collect()
    assert [(r.id, r.bounding_box) for r in found] == [(1, [1, 2, 3, 0])] * 2


def test_images(spark):
    rng = np.random.default_rng(2)
    pictures = {b"a": rng.random((60, 80)), b"flat": np.ones((5, 3))}
    pictures[b"a2"] = np.kron(pictures[b"a"], np.ones((2, 2))) * 0.5 + 0.1  # larger and darker
    pictures[b"b"] = rng.random((60, 80))
    df = spark.createDataFrame([(k.decode(), bytearray(k)) for k in pictures] + [("none", None), ("bad", bytearray(b"?"))], "k string, c binary")
    rows = {r.k: r for r in df.select("k", models.perceptual_hash(F.col("c"), pictures.get).alias("p"), models.difference_hash(F.col("c"), pictures.get).alias("d"), models.image_embedding(F.col("c"), lambda raw: np.array([[len(x)] for x in raw])).alias("v"), models.exif(F.col("c"), lambda raw: {"Make": " X ", "GPSLatitude": "48, 30, 0", "GPSLatitudeRef": "S", "DateTimeOriginal": "2024:01:02 03:04:05", "PixelXDimension": "10"} if raw == b"a" else None).alias("e")).collect()}
    apart = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert apart(rows["a"].p, rows["a2"].p) <= 8 and apart(rows["a"].p, rows["b"].p) > 12 and apart(rows["a"].d, rows["a2"].d) <= 8
    assert rows["none"].p is None and rows["bad"].d is None and rows["flat"].p is not None and rows["a2"].v == [2.0] and rows["none"].v is None and rows["b"].e is None
    entries = spark.createDataFrame([(rows["a"].e,)], "e map<string,string>")
    [r] = entries.select(*(c.alias(n) for n, c in models.exif_columns(F.col("e")).items())).collect()
    assert (r.camera_make, r.camera_model, r.width, r.latitude, r.longitude, r.occurred_at) == ("X", None, 10, -48.5, None, datetime(2024, 1, 2, 3, 4, 5))


def test_mime_types(spark):
    r = one(spark, a=texts.mime_type(F.lit("x/Y.JPG")), b=texts.mime_type(F.lit("none")), c=texts.type_of_mime(F.lit("Text/plain")), d=texts.type_of_mime(F.lit("x")))
    assert (r.a, r.b, r.c, r.d) == ("image/jpeg", None, "document", "other")


def test_rules_by_week_number_day_of_the_year_hour_and_minute():
    from datetime import date, datetime, timedelta

    from keepsake.functions.recurrence import Rule, UnreadableRuleError

    start, horizon = datetime(2024, 1, 3, 9, 30), timedelta(4 * 366)
    every = [date(2024, 1, 1) + timedelta(i) for i in range(5 * 366)]
    last = lambda x: 366 if x.year % 4 == 0 else 365
    inside = lambda days: [x for x in (datetime.combine(d, start.time()) for d in days) if start <= x <= start + horizon]
    got = list(Rule("FREQ=YEARLY;BYYEARDAY=1,100,-1").occurrences(start, horizon))
    assert got == inside(x for x in every if x.timetuple().tm_yday in (1, 100, last(x)))
    got = list(Rule("FREQ=YEARLY;BYWEEKNO=1,20,-1;BYDAY=MO,SU").occurrences(start, horizon))
    weeks = lambda x: date(x.isocalendar().year, 12, 28).isocalendar().week
    assert got == inside(x for x in every if x.isocalendar().week in (1, 20, weeks(x)) and x.weekday() in (0, 6))
    assert list(Rule("FREQ=HOURLY;INTERVAL=5;COUNT=4").occurrences(start, horizon)) == [start + timedelta(hours=5 * k) for k in range(4)]
    got = list(Rule("FREQ=MINUTELY;INTERVAL=45;BYDAY=SA;UNTIL=20240115T000000").occurrences(start, horizon))
    assert got == [x for x in (start + timedelta(minutes=45 * k) for k in range(1000)) if x.weekday() == 5 and x <= datetime(2024, 1, 15)] and got
    assert list(Rule("FREQ=HOURLY;BYMONTH=2;BYMONTHDAY=31;COUNT=2").occurrences(start, horizon)) == []
    for bad in ("FREQ=DAILY;BYYEARDAY=3", "FREQ=YEARLY;BYWEEKNO=60", "FREQ=HOURLY;BYSETPOS=1", "FREQ=SECONDLY"):
        with pytest.raises(UnreadableRuleError):
            Rule(bad)
