from hashlib import sha256

from cohortlens.llm import warc_fixity as w

SCHEMA = "page_id bigint, url string, html string, hash string, node string, slice string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "n", "s") for r in rows], SCHEMA).repartition(3)


def body(page_id, url, html):
    size = len((html or "").encode())
    return (
        f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Target-URI: {url or ''}\r\n"
        f"Content-Type: text/html\r\nContent-Length: {size}\r\n\r\n{html or ''}\r\n\r\n"
    ).encode()


def test_damage_is_located(spark):
    rows = [(i, f"http://h/{i}", f"<p>é {i}</p>" * (i % 7)) for i in range(300)]
    damaged = [r for r in rows if r[0] not in (17, 255)]
    damaged = [(i, u, h + "x" if i in (0, 99) else h) for i, u, h in damaged] + [(999, "u", "h")]
    out = {(r["page_id"], r["copy"]): r for r in w.audit(pages(spark, rows), pages(spark, damaged)).collect()}
    assert len(out) == 301
    want = {0: "altered", 99: "altered", 17: "missing", 255: "missing", 999: "strange"}
    offset = 0
    for i, (page_id, url, html) in enumerate(rows):
        r, data = out[page_id, 0], body(page_id, url, html)
        assert (r["position"], r["offset"], r["n_bytes"], r["sha256"]) == (i, offset, len(data), sha256(data).hexdigest())
        assert r["status"] == want.get(page_id, "intact")
        assert (r["replica_sha256"] == r["sha256"]) == (r["status"] == "intact")
        offset += len(data)
    assert out[999, 0]["status"] == "strange"


def test_only_differing_branches_are_opened(spark):
    rows = [(i, "u", f"page {i}") for i in range(260)]
    one = w.manifest(w.record(pages(spark, rows)))
    two = w.placed(w.manifest(w.record(pages(spark, [(i, "u", "!" if i == 200 else h) for i, _, h in rows]))), one)
    a, b = w.tree(one, 260), w.tree(two, 260)
    assert [x.count() for x in a] == [260, 17, 2, 1]
    assert [r["node"] for r in w.differing(a, b).collect()] == [200]
    assert w.differing(a, a).count() == 0


def test_odd_rows(spark):
    rows = [(None, None, None), (None, None, None), (5, None, "a"), (5, "u", None), (5, "u", None), (1, "u", "z" * 200_000)]
    some, none = pages(spark, rows), pages(spark, rows).limit(0)
    out = w.audit(some, some).collect()
    assert len(out) == 6 and {r["status"] for r in out} == {"intact"}
    assert sorted(r["copy"] for r in out if r["page_id"] == 5) == [0, 1, 2]
    assert {r["status"] for r in w.audit(some, none).collect()} == {"missing"}
    assert {r["status"] for r in w.audit(none, some).collect()} == {"strange"}
    assert w.audit(none, none).count() == 0
