import hashlib

from vigil.llm import warc
from vigil.llm.common import scratch


def slow(pages):
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    out = []
    for k, _, h in pages:
        n = len((h or "").encode())
        same = [p for p, _, x in pages if p is not None and (x or "") == (h or "")]
        top = max(same) if same and n >= 1000 and len([1 for _, _, x in pages if (x or "") == (h or "")]) > 1 else None
        revisit = top is not None and k != top
        out.append((k, n, sha(h), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def pages():
    big = "<p>é\r\n</p>" * 150
    fake = "x" * 50 + "\r\n\r\n" + warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 4\r\n\r\nfake\r\n\r\n"
    rows = [(i, f"http://h/{i}", f"<html>{i}</html>" * (i % 90)) for i in range(60)]
    rows += [(100 + i, "http://c/", big) for i in range(7)] + [(200, "u\r\nv", fake), (201, None, fake * 30), (202, "u", None), (203, "u", ""), (204, "u", warc.MAGIC),
             (205, "u", warc.MAGIC + "\r\n\r\n" * 3 + warc.MAGIC), (None, "u", big), (None, "u", "null id"), (106, "u", big), (206, "u", "a" * 999), (207, "u", "a" * 999)]
    return rows


def test_round_trip_with_small_splits(llm):
    rows = pages()
    d = llm.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, start long").repartition(3)
    old = llm.conf.get("spark.sql.files.maxPartitionBytes")
    llm.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # many blocks a file, borders anywhere
    try:
        out = warc.through_archives(d, scratch(llm, "t")).collect()
    finally:
        llm.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == slow(rows)
    assert all(r.intact for r in out)


def test_broken_and_empty(llm, tmp_path):
    d = llm.createDataFrame(pages()[:5], "page_id long, url string, html string")
    path = scratch(llm, "t")
    warc.write_archives(d.coalesce(1), path)
    assert warc.broken_files(llm, path).count() == 0
    with open(tmp_path / "cut.warc", "wb") as f:
        f.write((warc.MAGIC + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + warc.MAGIC + "Content-Length: 50\r\n\r\nshort").encode())
    assert warc.read_archives(llm, f"file://{tmp_path}").count() == 1
    assert warc.broken_files(llm, f"file://{tmp_path}").count() == 1
    assert warc.through_archives(d.limit(0), scratch(llm, "t")).count() == 0
