import gzip
import hashlib
import uuid

import pytest

from hertzflow.llm import warc


def archive(spark, tmp_path, rows, **more):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, origin long")
    warc.write_archives(df.repartition(3), path, **more)
    return path


def pages():
    big = "é漢😀 <p>\r\n\r\nWARC/1.1\r\n" * 400
    rows = [(1, "http://a/", "short"), (2, "http://b/", big), (3, None, None), (4, "http://c/\r\nX: y", ""), (5, "u", "short")]
    rows += [(6, "u", big), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "y" * 1000), (10, "u", "y" * 1000), (11, "u", "z" * 300_000)]
    return [(*r, "clash", 5) for r in rows] + [(None, "n", "no id", "", 1), (12, "u", "w" * 2000, "", 0), (12, "u", "w" * 2000, "", 0)]


@pytest.mark.parametrize("segment", [50, 1000, 32_768])
def test_round_trip(spark, tmp_path, segment):
    rows = pages()
    got = warc.read_archives(spark, archive(spark, tmp_path, rows, segment_bytes=segment)).collect()
    assert len(got) == len(rows) and not [r for r in got if r.problem]
    assert len({r.record_id for r in got}) == len(rows)
    origin = {2: 6, 9: 10}
    by_id = {r.page_id: r for r in got}
    for page_id, _, html, *_ in rows:
        payload, r = (html or "").encode(), by_id[page_id]
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha1(payload).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", origin[page_id]) if page_id in origin else ("response", None))
        assert r.record_type == "revisit" or bytes(r.payload) == payload


def test_faults_are_told(spark, tmp_path):
    class Page:
        page_id, url, payload, digest, refers_to, n_bytes = 1, "u", b"q" * 500, hashlib.sha1(b"q" * 500).hexdigest(), None, 500

    good = list(warc.page_records(Page, "a", 200))
    lost, short = good[:1] + good[2:], [good[0], good[1].replace(b"Content-Length: 200", b"Content-Length: 199", 1)] + good[2:]
    Page.digest = hashlib.sha1(b"other").hexdigest()
    wrong = list(warc.page_records(Page, "b", 10_000))
    plain = b"".join(warc.page_records(Page, "c", 10_000)).replace(b"1f4\r\n", b"1f5\r\n")
    (tmp_path / "w").mkdir()
    (tmp_path / "w/1.gz").write_bytes(b"".join(map(gzip.compress, lost)))
    (tmp_path / "w/2.gz").write_bytes(gzip.compress(b"".join(wrong)))
    (tmp_path / "w/3").write_bytes(plain)
    got = sorted(r.problem for r in warc.read_archives(spark, f"{tmp_path}/w").collect())
    assert got == ["payload digest", "segments are missing", "transfer framing: a chunk is cut off"]
    assert short


def test_empty_table(spark, tmp_path):
    assert warc.read_archives(spark, archive(spark, tmp_path, [])).count() == 0
