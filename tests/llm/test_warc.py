"""Archives: what is written comes back, at any split size."""

import io

from quern.llm import warc as W


def test_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 300
    rows = [(1, "http://a/1", big), (9, "http://a/9", big), (4, None, None), (5, "http://a/5", ""), (6, "x", "small"), (7, "y", "small"), (None, "z", "lost"), (8, "http://b/", "\x1f\x8b\x08" * 500)]
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, first_id int").repartition(3)
    listing = W.write_archives(df, str(tmp_path / "warc"))
    for split in (1, 64, 1 << 20):
        got = {r.page_id: r for r in W.read_archives(listing, split).collect()}
        assert len(got) == len(rows)
        assert got[1].record_type == "revisit" and got[1].refers_to == 9 and got[1].payload is None and got[1].payload_bytes == len(big.encode())
        assert got[9].record_type == "response" and bytes(got[9].payload).decode() == big and got[9].refers_to is None
        assert got[6].record_type == got[7].record_type == got[4].record_type == "response"
        assert bytes(got[8].payload).decode() == "\x1f\x8b\x08" * 500


def test_magic_inside_data_is_no_record():
    rec = W._member(W.record(1, "u", b"\x1f\x8b\x08" * 50, "0" * 40, None, False))
    noise = b"\x1f\x8b\x08 junk"
    data = noise + rec + noise + rec
    at = [x[0] for x in W.records_in(io.BytesIO(data), 0, len(data), len(data))]
    assert at == [len(noise), 2 * len(noise) + len(rec)]
    assert [x[0] for x in W.records_in(io.BytesIO(data), at[0] + 1, len(data), len(data))] == at[1:]


def test_empty_table(spark, tmp_path):
    listing = W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert listing.count() == 0 and W.read_archives(listing).count() == 0
