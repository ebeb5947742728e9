import io
import json
import mailbox
import tarfile
import zipfile
from datetime import datetime
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from keepsake.sources import archives, readers


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_ledgers(spark, tmp_path):
    p = put(tmp_path / "r.csv", '"Account","Date","Payee","Category","Outflow","Inflow"\n"Checking","06/15/2024","A ""B"", C","Food: Out","$1,050.00","$0.00"\n"Checking","13/45/2024","X","","","€20.5"\n')
    a, b = readers.ledger(spark, p).collect()
    assert (str(a.amount), a.transaction_type, a.payee, a.occurred_at) == ("-1050.00", "expense", 'A "B", C', datetime(2024, 6, 15))
    assert (str(b.amount), b.transaction_type, b.occurred_at) == ("20.50", "income", None)


def test_social_archives(spark, tmp_path):
    p = put(tmp_path / "posts.csv", 'id,date,subreddit,title,body,url\na1,2024-01-02 03:04:05 UTC,python,Hi,"two\nlines",\na2,2024-01-02 03:04:05 UTC,python,Link,,https://x.org\n')
    a, b = readers.social_archive(spark, p).orderBy("post_id").collect()
    assert a.post_type == "text" and a.body == "two\nlines" and a.occurred_at == datetime(2024, 1, 2, 3, 4, 5) and b.post_type == "link"


def test_browser_and_location_history(spark, tmp_path):
    p = put(tmp_path / "h.json", json.dumps({"Browser History": [{"title": "T", "url": "https://Ex.org/a", "time_usec": 1_704_067_200_000_000, "page_transition": "LINK"}]}))
    [r] = readers.browser_history(spark, p).collect()
    assert (r.domain, r.occurred_at, r.transition_type) == ("ex.org", datetime(2024, 1, 1), "link")
    p = put(tmp_path / "l.json", json.dumps({"locations": [{"latitudeE7": 407128000, "longitudeE7": -740060000, "timestamp": "2024-01-01T12:00:00-05:00", "accuracy": 5}]}))
    [r] = readers.location_history(spark, p).collect()
    assert (r.latitude, r.longitude, r.timestamp) == (40.7128, -74.006, datetime(2024, 1, 1, 17))


def test_chat_logs(spark, tmp_path):
    p = put(tmp_path / "chat.txt", "noise before\n[31/12/2023, 23:59:01] Ann: first\nsecond line\n[01/01/2024, 0:00:30] Bob B: hi: there\n01/01/24, 00:01 - Ann joined\n")
    rows = readers.chat_log(spark, p).orderBy("position").collect()
    assert [(r.sender, r.content, r.message_type) for r in rows] == [("Ann", "first\nsecond line", "text"), ("Bob B", "hi: there", "text"), (None, "Ann joined", "system")]
    assert rows[0].occurred_at == datetime(2023, 12, 31, 23, 59, 1) and rows[2].occurred_at == datetime(2024, 1, 1, 0, 1)


def test_chat_logs_with_a_clock_of_twelve_hours(spark, tmp_path):
    put(tmp_path / "a.txt", "[12/31/23, 11:59:01 PM] Bob: hi\n[1/1/24, 12:00:05\u202fAM] Ann: new year\n1/1/24, 12:30 pm - Bob: lunch at 1: yes\n1/1/24, 1:05 p. m. - Bob joined\n")
    put(tmp_path / "b.txt", "01/02/2024, 9:15 a.m. - Ann: day first\n13/02/2024, 13:05 PM - Ann: as it stands\n31/02/2024, 10:00 - Ann: no such day\n")
    rows = readers.chat_log(spark, str(tmp_path)).orderBy("thread", "position").collect()
    assert [(r.sender, r.content) for r in rows[:4]] == [("Bob", "hi"), ("Ann", "new year"), ("Bob", "lunch at 1: yes"), (None, "Bob joined")]
    assert [r.occurred_at for r in rows[:4]] == [datetime(2023, 12, 31, 23, 59, 1), datetime(2024, 1, 1, 0, 0, 5), datetime(2024, 1, 1, 12, 30), datetime(2024, 1, 1, 13, 5)]
    assert [r.occurred_at for r in rows[4:]] == [datetime(2024, 2, 1, 9, 15), datetime(2024, 2, 13, 13, 5), None]
    assert readers.chat_log(spark, str(tmp_path / "b.txt"), day_first=False).orderBy("position").first().occurred_at == datetime(2024, 1, 2, 9, 15)


def test_calendars(spark, tmp_path):
    p = put(tmp_path / "c.ics", "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1@x\r\nSUMMARY:Team\r\n  Meeting\r\nDTSTART;TZID=Europe/Paris:20240615T120000\r\nDTEND:20240615T130000Z\r\nRRULE:FREQ=DAILY;COUNT=2\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2@x\r\nDTSTART;VALUE=DATE:20240616\r\nSTATUS:CANCELLED\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    a, b = readers.calendar(spark, p).orderBy("ical_uid").collect()
    assert (a.title, a.start_time, a.rrule, a.status) == ("Team Meeting", datetime(2024, 6, 15, 10), "FREQ=DAILY;COUNT=2", "confirmed")
    assert (a.timezone, a.end_time, a.is_all_day, b.timezone) == ("Europe/Paris", datetime(2024, 6, 15, 13), False, None)
    assert (b.title, b.start_time, b.status) == (None, datetime(2024, 6, 16), "cancelled")


def test_calendar_zones(spark, tmp_path):
    event = "BEGIN:VEVENT\r\nUID:{}\r\nDTSTART{}\r\nEND:VEVENT\r\n"
    cases = [(";TZID=America/New_York:20240115T090000", datetime(2024, 1, 15, 14)), (':20240115T090000Z', datetime(2024, 1, 15, 9)), (";VALUE=DATE:20240115", datetime(2024, 1, 15)), (';TZID="Asia/Tokyo":20240115T090000', datetime(2024, 1, 15)), (";TZID=Mars/Base:20240115T090000", datetime(2024, 1, 15, 9)), (";X-A=b;TZID=Europe/Berlin:20240715T090000", datetime(2024, 7, 15, 7)), (":broken", None)]
    p = put(tmp_path / "z.ics", "BEGIN:VCALENDAR\r\n" + "".join(event.format(k, x) for k, (x, _) in enumerate(cases)) + "END:VCALENDAR\r\n")
    rows = readers.calendar(spark, p).orderBy("ical_uid").collect()
    assert [r.start_time for r in rows] == [t for _, t in cases] and [r.is_all_day for r in rows] == [k == 2 for k in range(len(cases))]


def test_more_of_the_exports(spark, tmp_path):
    p = put(tmp_path / "c.csv", 'id,permalink,date,ip,subreddit,gildings,link,parent,body\nc1,https://x/r/a/comments/p9/t/c1/,2024-01-02 03:04:05 UTC,,a,0,https://x/r/a/comments/p9/t/,c0,"two\nlines"\nc2,u,bad,,a,0,,,x\n')
    a, b = readers.social_comments(spark, p).orderBy("comment_id").collect()
    assert (a.post_id, a.parent_comment_id, a.body, a.occurred_at) == ("p9", "c0", "two\nlines", datetime(2024, 1, 2, 3, 4, 5)) and (b.post_id, b.parent_comment_id, b.occurred_at) == (None, None, None)
    [s] = readers.social_subscriptions(spark, put(tmp_path / "s.csv", "subreddit\npython\n")).collect()
    assert (s.subscription_type, s.target_name) == ("subreddit", "python")
    kinds = readers.social_saved(spark, put(tmp_path / "v.csv", "id,permalink\n1,https://x/r/a/comments/p9/t/\n2,https://x/r/a/comments/p9/t/c1/\n")).orderBy("saved_id").collect()
    assert [(r.kind, r.post_id) for r in kinds] == [("post", "p9"), ("comment", "p9")]
    [g] = readers.ledger_budgets(spark, put(tmp_path / "b.csv", '"Month","Category Group","Category","Budgeted","Activity","Available"\n"Jun 2024","Food","Out","$1,000.00","-$250.50","$749.50"\n')).collect()
    assert (g.year, g.month, str(g.budgeted), str(g.spent), str(g.available)) == (2024, 6, "1000.00", "250.50", "749.50")
    tx = readers.ledger(spark, put(tmp_path / "t.csv", '"Account","Date","Payee","Category","Outflow","Inflow"\n"My Credit","06/15/2024","A","B","$1.00","$0.00"\n"My Credit","06/16/2024","A","B","$0.00","$4.00"\n'))
    [acc] = readers.ledger_accounts(tx).collect()
    assert (acc.name, acc.account_type, str(acc.current_balance)) == ("My Credit", "credit_card", "3.00")
    put(tmp_path / "p.json", json.dumps({"title": "a.jpg", "description": "", "photoTakenTime": {"timestamp": "1704067200"}, "geoData": {"latitude": 0.0, "longitude": 0.0, "altitude": 0.0}}))
    [ph] = readers.photo_sidecars(spark, str(tmp_path / "p.json")).collect()
    assert (ph.occurred_at, ph.latitude, ph.caption, ph.media_type) == (datetime(2024, 1, 1), None, None, "image")
    put(tmp_path / "m.json", json.dumps({"messages": [{"creator": {"name": "Ann", "email": " ANN@x.org"}, "created_date": "Monday, 1 January 2024 at 12:30:05 UTC", "text": "hi", "topic_id": "t", "message_id": "m1"}, {"creator": {"name": "B"}, "created_date": "Monday, January 1, 2024 at 1:02:03\u202fPM UTC", "message_id": "m2"}]}))
    x, y = readers.chat_export(spark, str(tmp_path / "m.json")).orderBy("message_id").collect()
    assert (x.sender_email, x.occurred_at, x.message_type) == ("ann@x.org", datetime(2024, 1, 1, 12, 30, 5), "text") and (y.occurred_at, y.message_type) == (datetime(2024, 1, 1, 13, 2, 3), "other")
    log = readers.chat_log(spark, put(tmp_path / "w.txt", "[31/12/2023, 23:59:01] Ann: <attached: 001-PHOTO.jpg>\n01/01/24, 00:01 - Bob: IMG-1.mp4 (file attached)\nlook\n01/01/24, 00:02 - Bob: plain\n"))
    assert [(r.original_filename, r.media_type, r.caption) for r in readers.chat_media(log).orderBy("position").collect()] == [("001-PHOTO.jpg", "image", None), ("IMG-1.mp4", "video", "look")]


def test_databases(spark, tmp_path):
    from keepsake.sources import database

    address, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    database.write(spark.range(100).selectExpr("id", "concat('n', id) AS name"), address, "things", "overwrite", driver)
    got = database.read(spark, address, "things", driver, by="ID", bounds=(0, 100), parts=3)
    assert got.rdd.getNumPartitions() == 3 and sorted(r[1] for r in got.where("ID < 3").collect()) == ["n0", "n1", "n2"]
    assert "PushedFilters" in got.where("ID < 3")._jdf.queryExecution().executedPlan().toString()
    assert database.url("h", "d", sslmode="require") == "jdbc:postgresql://h:5432/d?sslmode=require"
    with pytest.raises(ValueError):
        database.read(spark, address, "things", driver, by="ID")
    budget = readers.manual(spark, "tag_synonyms", [{"id": "1", "tag_id": "t", "synonym": "s"}]).select("id", "tag_id", "synonym", F.lit(datetime(2024, 1, 1)).alias("created_at"))
    database.write(budget, address, "tag_synonyms", "overwrite", driver)
    assert database.read_declared(spark, address, "tag_synonyms", options=driver).columns == ["id", "tag_id", "synonym", "created_at"]


def test_tables_by_month(spark, tmp_path):
    rows = readers.manual(spark, "browsing_history", [{"id": str(k), "url": "u", "occurred_at": datetime(2024, k, 1) if k < 3 else None} for k in (1, 2, 3)]).withColumns({c: F.lit(datetime(2024, 1, 1)) for c in ("created_at", "updated_at")})
    readers.write_table(rows, tmp_path.as_uri(), "browsing_history", by="occurred_at")
    assert sorted(x.name for x in (tmp_path / "browsing_history").iterdir() if x.is_dir()) == ["month_of=2024-01", "month_of=2024-02", "month_of=__HIVE_DEFAULT_PARTITION__"]
    assert readers.read_table(spark, tmp_path.as_uri(), "browsing_history").count() == 3


def test_text_and_media_folders(spark, tmp_path):
    put(tmp_path / "n.md", "\n# A heading\nbody\n")
    [r] = readers.text_files(spark, str(tmp_path / "n.md")).collect()
    assert r.title == "A heading" and r.content.endswith("body\n")
    (tmp_path / "pics").mkdir()
    (tmp_path / "pics" / "a.JPG").write_bytes(b"x")
    [r] = readers.media_folder(spark, str(tmp_path / "pics")).collect()
    assert (r.media_type, r.file_size, r.original_filename) == ("image", 1, "a.JPG") and len(r.file_hash) == 64


def test_export_kinds(spark):
    rows = [("/x/Takeout/a.json", "{"), ("/x/a", " [1]"), ("/x/b.ics", "BEGIN:VCALENDAR"), ("/x/c", "From a@b"), ("/x/d", "PK\x03\x04zz"), ("/x/e", "[1/2/2024, 1:00] A: b"), ("/x/f", "a,b\n1,2\n"), ("/x/g", "prose")]
    df = spark.createDataFrame(rows, "p string, h string").select(readers.export_kind(F.col("p"), F.col("h")).alias("k"))
    assert [r.k for r in df.collect()] == ["google_takeout", "json", "calendar", "mbox", "zip", "whatsapp", "csv", "generic"]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/one.txt", "1")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("two.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"22"))
    put(tmp_path / "c.txt", "neither")
    got = {(r.member, bytes(r.content)) for r in archives.members(spark, str(tmp_path)).collect()}
    assert got == {("d/one.txt", b"1"), ("two.txt", b"22")}


def test_mailboxes(spark, tmp_path):
    box = mailbox.mbox(tmp_path / "m.mbox")
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Message-ID"], m["Date"] = "Ann <ANN@x.org>", "b@x.org, C <c@x.org>", "Grüße", "<1@x>", "Mon, 01 Jan 2024 12:00:00 -0500"
    m.set_content("Hello\nFrom here\n")
    m.add_attachment(b"x", maintype="application", subtype="pdf", filename="a.pdf")
    box.add(m)
    n = EmailMessage()
    n["From"], n["In-Reply-To"], n["References"] = "c@x.org", "<1@x>", "<0@x> <1@x>"
    n.set_content("<p>hi</p>", subtype="html")
    box.add(n)
    box.flush()
    a, b = archives.mailboxes(spark, str(tmp_path / "m.mbox")).orderBy("position").collect()
    assert (a.from_address, a.from_name, a.to_addresses, a.subject, a.occurred_at, a.attachment_count) == ("ann@x.org", "Ann", ["b@x.org", "c@x.org"], "Grüße", datetime(2024, 1, 1, 17), 1)
    assert "From here" in a.body_text and b.in_reply_to == "<1@x>" and b.body_html.strip() == "<p>hi</p>" and b.body_text is None and b.occurred_at is None


def test_tables_are_written_read_and_checked(spark, tmp_path):
    folder = tmp_path.as_uri()
    with pytest.raises(readers.SchemaMismatchError):
        readers.check_table(spark, folder, "people")
    readers.write_table(readers.manual(spark, "people", [{"id": "1", "display_name": "Ann"}]).withColumns({c: F.lit(datetime(2024, 1, 1)) for c in ("created_at", "updated_at")}), folder, "people")
    readers.check_table(spark, folder, "people")
    [r] = readers.read_table(spark, folder, "people").collect()
    assert r.display_name == "Ann" and r.is_self is False and readers.probe(spark)
    spark.createDataFrame([("people", "old")], "table_name string, fingerprint string").write.mode("overwrite").parquet(f"{folder}/_model/people")
    with pytest.raises(readers.SchemaMismatchError):
        readers.check_table(spark, folder, "people")
