import hashlib

import pytest

pytest.importorskip("paperloom.llm")
from paperloom.llm import warc  # noqa: E402
from paperloom.llm.shared import materialize  # noqa: E402

LONG = "<p>same é</p>" * 20
ROWS = [
    (5, "http://a/\r\nx%0A", LONG), (3, "u", LONG), (9, None, LONG), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "", ""),
    (None, "n", LONG), (None, "n", "only" * 60), (None, "n", "only" * 60), (3, "again", LONG), (11, "big", "x\r\n\r\n" * 50_000),
]


def expected():
    out = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        same = [j for j, _, h in ROWS if (h or "").encode() == data and j is not None]
        later = len(data) >= 100 and same and (i is None or i > min(same))
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", min(same) if later else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("frame,bundle", [(1, 1), (500, 2000), (1 << 18, 1 << 24)])
def test_round_trip(spark, frame, bundle):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")
    bundles = materialize(warc.write_bundles(pages, frame, bundle))
    got = warc.read_bundles(bundles).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected()
    assert all(r["whole"] for r in got)
    stored = {(r["page_id"], r["url"]): r["payload"] for r in got if r["record_type"] == "response" and r["page_id"] is not None}
    assert all(stored[i, u] == (h or "").encode() for i, u, h in ROWS if (i, u) in stored) and (5, "http://a/\r\nx%0A") not in stored
    for row in bundles.collect():
        table, archive = warc.seek_table(row["archive"]), row["archive"]
        for e in row["entries"]:
            data = warc.read_frame(archive, table[e["frame"]])
            assert warc.parse_record(data[e["offset"] : e["offset"] + e["length"]])["page_id"] == e["record_id"]
    assert warc.record_index(bundles).count() == len(ROWS)
    wanted = spark.createDataFrame([(11,), (4,), (999,)], "record_id long")
    assert sorted(r["page_id"] for r in warc.read_records(bundles, wanted).collect()) == [4, 11]


def test_archive_is_a_plain_zstandard_stream():
    import zstandard

    bundle = warc.Bundle(10)
    for i in range(5):
        bundle.add(i, b"record %d" % i)
    with zstandard.ZstdDecompressor().stream_reader(bundle.finish(), read_across_frames=True) as r:
        assert r.read() == b"".join(b"record %d" % i for i in range(5))


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_bundles(materialize(warc.write_bundles(pages))).count() == 0
