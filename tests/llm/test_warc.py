"""Op 4: archives are read back whole, and revisits resolve."""

import hashlib

import pytest

from tallyloom.llm.warc import parse, read_archives, resolve_revisits, write_archives

LONG = "<p>" + "é" * 60 + "\r\n\r\nWARC/1.1\r\n" + "</p>"


def test_round_trip(spark, tmp_path):
    rows = [(3, "http://a/3", LONG), (1, "http://a/1", LONG), (9, None, LONG), (2, "http://b\r\nX: y", "short"), (4, "u", "short"),
            (5, "u5", None), (6, "u6", ""), (7, "u7", "x" * 100), (8, "u8", "x" * 99), (10, "u10", "x" * 100), (None, "n", LONG), (1, "http://a/1", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "0 AS digest", "1 AS refers_to").repartition(3)
    path = str(tmp_path / "archive")
    write_archives(pages, path, records_per_archive=2)
    records = read_archives(spark, path).collect()
    stored = sorted((r.page_id or -1, r.record_type, bytes(r.payload or b"")) for r in records)
    full = {(i, u): (h or "").encode() for i, u, h in rows}
    assert len(records) == len(rows)
    assert [s[0] for s in stored if s[1] == "revisit"] == [3, 9, 10]
    assert all(body == full[next(k for k in full if (k[0] or -1) == i)] for i, kind, body in stored if kind == "response")
    out = {(r.page_id): r for r in resolve_revisits(read_archives(spark, path, with_payload=False)).collect()}
    for i, u, h in rows:
        body = (h or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
    assert {i: out[i].refers_to for i in out if out[i].refers_to is not None} == {3: 1, 9: 1, 10: 7}
    assert out[2].url == "http://b%0D%0AX: y" and out[9].url is None


def test_empty_table_and_damage(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    write_archives(pages, str(tmp_path / "none"))
    assert resolve_revisits(read_archives(spark, str(tmp_path / "none"))).collect() == []
    with pytest.raises(ValueError):
        list(parse(b"junk\r\n\r\n", True))


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, f"u{i}", f"{i} " + "x" * 10_000) for i in range(40)] + [(99, "long", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for limit, least in ((1 << 29, 1), (10_000_000, 14), (100, 41)):
        path = str(tmp_path / f"a{limit}")
        write_archives(pages, path, archive_bytes=limit)
        files = [f for f in (tmp_path / f"a{limit}").iterdir() if f.name.endswith(".gz")]
        assert len(files) >= least
        assert sorted((r.page_id, len(r.payload)) for r in read_archives(spark, path).collect()) == sorted((i, len(h)) for i, _, h in rows)
