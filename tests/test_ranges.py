"""Mailboxes and archives read by ranges, against whole reads."""

import io
import os
import re
import tarfile
import zipfile

import numpy as np
import pytest

from keepsake.sources import archives, ranges


def plain_messages(raw):
    starts = [m.start() for m in re.finditer(rb"(?:\A|(?<=\n\n)|(?<=\n\r\n))From ", raw)]
    return [(a, raw[a:z]) for a, z in zip(starts, [*starts[1:], len(raw)], strict=False)]


def mailbox(seed, crlf=False):
    rng = np.random.default_rng(seed)
    end = b"\r\n" if crlf else b"\n"
    out = []
    for k in range(60):
        body = end.join(rng.choice([b"text", b"From here on", b">From there", b"", b"x" * 50]) for _ in range(rng.integers(0, 12)))
        out.append(b"From a@b" + end + (b"Subject: %d" % k + end + end + body).replace(end + end + b"From ", end + end + b">From ") + end + end)
    return b"".join(out)


@pytest.mark.parametrize("raw", [mailbox(1), mailbox(2, True), b"", b"no mail", b"From x\n\nonly", b"\n\nFrom late\n\nbody", b"noise\n\nFrom x\n\nFrom y\n\n", b"From "])
def test_ranges_of_any_size_give_all_messages_once(raw, monkeypatch):
    want = plain_messages(raw)
    for block in (7, 64, 1 << 20):
        monkeypatch.setattr(ranges, "BLOCK", block)
        for split in (1, 13, 100, 1000, 1 << 20):
            got = [m for a in range(0, len(raw), split) for m in ranges.messages_in(io.BytesIO(raw), a, min(len(raw), a + split))]
            assert got == want, (block, split)
            if len(raw) > 1000 and split == 1:
                break


def test_a_mailbox_is_many_tasks_and_its_messages_are_numbered(spark, tmp_path):
    raw = mailbox(3)
    (tmp_path / "a.mbox").write_bytes(raw)
    (tmp_path / "b.mbox").write_bytes(mailbox(4, True))
    (tmp_path / "_hidden").write_bytes(b"From no\n\n")
    (tmp_path / "empty.mbox").write_bytes(b"")
    ranges.register(spark)
    assert spark.read.format("keepsake_mailbox").option("splitBytes", 500).load(str(tmp_path / "a.mbox")).rdd.getNumPartitions() == -(-len(raw) // 500) > 3
    got = archives.mailboxes(spark, str(tmp_path), 500).collect()
    assert len(got) == 120
    for name in ("a.mbox", "b.mbox"):
        own = sorted((r.position, r.subject) for r in got if r.mailbox.endswith(name))
        assert own == [(k, str(k)) for k in range(60)]


def test_messages_are_numbered_without_being_moved(spark, tmp_path, monkeypatch):
    (tmp_path / "a.mbox").write_bytes(mailbox(5))
    mails = archives.mailboxes(spark, str(tmp_path), 500)
    plan = mails._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert sorted((r.position, r.subject) for r in mails.collect()) == [(k, str(k)) for k in range(60)]
    monkeypatch.setattr(ranges, "reachable", lambda path: False)  # a store that only Spark reads
    assert sorted((r.position, r.subject) for r in archives.mailboxes(spark, str(tmp_path), 500).collect()) == [(k, str(k)) for k in range(60)]


def test_archives_by_groups_of_members(spark, tmp_path):
    rng = np.random.default_rng(5)
    files = {f"d/f{k}.txt": rng.bytes(int(n)) for k, n in enumerate([0, 1, 5000, 20_000, 100_000, 3])}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d/", "")
        for name, content in files.items():
            z.writestr(name, content)
    for name, mode in (("b.tar", "w"), ("c.tar.gz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as t:
            for member, content in files.items():
                info = tarfile.TarInfo(member)
                info.size = len(content)
                t.addfile(info, io.BytesIO(content))
    (tmp_path / "no.txt").write_bytes(b"nothing")
    broken = bytearray((tmp_path / "a.zip").read_bytes())
    broken[20_000:20_040] = bytes(40)
    (tmp_path / "broken.zip").write_bytes(broken)
    rows = archives.member_parts(spark, str(tmp_path), 6000, 4096)
    assert rows.rdd.getNumPartitions() >= 8
    found = {}
    for r in sorted(rows.collect(), key=lambda r: (r.archive, r.member, r.part)):
        found.setdefault(os.path.basename(r.archive), {}).setdefault(r.member, []).append(r)
    assert set(found) == {"a.zip", "b.tar", "c.tar.gz", "broken.zip"}
    for name in ("a.zip", "b.tar", "c.tar.gz"):
        assert {m: b"".join(bytes(p.content) for p in parts) for m, parts in found[name].items()} == files
        assert all(len(p.content) <= 4096 and p.size == len(files[m]) and p.part == k and p.error is None for m, parts in found[name].items() for k, p in enumerate(parts))
    damaged = {m for m, parts in found["broken.zip"].items() if parts[-1].error}
    assert damaged and all(b"".join(bytes(p.content) for p in parts) == files[m] for m, parts in found["broken.zip"].items() if m not in damaged)
    whole = {(os.path.basename(r.archive), r.member): bytes(r.content) for r in archives.members(spark, str(tmp_path)).collect()}
    assert {m: c for (a, m), c in whole.items() if a == "c.tar.gz"} == files


def test_a_member_over_two_gigabytes_comes_in_parts(spark, tmp_path):
    """A sparse file of 2.2 GB inside a TAR: its parts are counted in the tasks, none of which holds it."""
    size = 2_200_000_000
    with open(tmp_path / "big.tar", "wb") as f:
        info = tarfile.TarInfo("zeros")
        info.size = size
        f.write(info.tobuf(tarfile.GNU_FORMAT))
        f.seek(512 + -(-size // 512) * 512 + 1023)
        f.write(b"\0")
    r = archives.member_parts(spark, str(tmp_path / "big.tar")).selectExpr("count(*) AS parts", "sum(octet_length(content)) AS bytes", "max(size) AS size", "count(error) AS bad").first()
    assert (r.parts, r.bytes, r["size"], r.bad) == (-(-size // ranges.PART_BYTES), size, size, 0)


def test_a_path_that_is_not_there(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        archives.member_parts(spark, str(tmp_path / "nowhere")).collect()
