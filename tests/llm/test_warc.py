import gzip
import hashlib

from tests.compare import connection
from tests.compare import rows as table_rows
from trellis.llm import queries, warc
from trellis.llm.shared import Table, filesystem

PAGES = [(i, f"http://h/{i}", f"<p>{'x' * (i % 50)}é{i}</p>") for i in range(300)]
ODD = [(500, None, "no url"), (501, "http://h/a b\r\nX: 1", None), (None, None, None), (502, "http://h/502", "big " * 40000), (3, "http://h/3", PAGES[3][2]), (503, "u", "")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, offset string")


def key(r):
    return repr(tuple(r))


def test_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_ROWS", 50)
    out, index = warc.write_warc(pages(spark, PAGES + ODD))
    got = index.collect()
    assert len(got) == len(PAGES + ODD)
    names = sorted({r["file"] for r in got})
    back = warc.read_warc(spark, [f"{out}/{n:08d}.warc.gz" for n in names]).collect()
    want = [((u.replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A") if u else f"urn:page:{'' if p is None else p}"), p, h or "") for p, u, h in PAGES + ODD]
    assert sorted(map(tuple, back), key=repr) == sorted(want, key=repr)
    for r in got[:20]:
        with open(filesystem(f"{out}/{r['file']:08d}.warc.gz")[1], "rb") as f:
            f.seek(r["offset"])
            assert next(warc.parse(gzip.decompress(f.read(r["length"]))))[0]["warc-type"] == "resource"
    again, _ = warc.write_warc(pages(spark, list(reversed(PAGES + ODD))).repartition(3))
    for n in names:
        a, b = (open(filesystem(f"{d}/{n:08d}.warc.gz")[1], "rb").read() for d in (out, again))
        assert a == b


def test_plain_files_and_responses(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(head + block + b"\r\n\r\n")
    assert [tuple(r) for r in warc.read_warc(spark, [str(tmp_path / "a.warc")]).collect()] == [("http://x/", None, "<p>hi</p>")]
    assert warc.read_warc(spark, []).count() == 0


def damage(path, how):
    with open(path, "rb") as f:
        data = bytearray(f.read())
    how(data)
    with open(path, "wb") as f:
        f.write(data)


def test_the_audit_finds_what_differs(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_ROWS", 60)
    a, index = warc.write_warc(pages(spark, PAGES + ODD))
    b, _ = warc.write_warc(pages(spark, PAGES + ODD))
    trees = lambda: [Table(warc.fixity_tree(index, x), "t").df for x in (a, b)]
    assert warc.audit(*trees()).count() == 0
    rows = sorted(index.collect(), key=lambda r: (r["file"], r["record"]))
    path = {r["file"]: filesystem(f"{b}/{r['file']:08d}.warc.gz")[1] for r in rows}
    files = sorted(path)
    one, two = [r for r in rows if r["file"] == files[0]][3], [r for r in rows if r["file"] == files[0]][-1]

    def flip(data):
        data[one["offset"] + 4] ^= 1  # a byte of the header that no payload hash sees
        data[two["offset"] + two["length"] - 9] ^= 255

    damage(path[files[0]], flip)
    damage(path[files[1]], lambda d: d.extend(b"tail"))
    cut = [r for r in rows if r["file"] == files[2]]
    damage(path[files[2]], lambda d: d.__delitem__(slice(cut[-2]["offset"] + 1, None)))
    import os

    os.remove(path[files[3]])
    left, right = trees()
    got = {(r["file"], r["node"]) for r in warc.audit(left, right).collect()}
    want = {(files[0], one["record"]), (files[0], two["record"]), (files[1], -1), (files[2], cut[-1]["record"]), (files[2], cut[-2]["record"])}
    want |= {(files[3], r["record"]) for r in rows if r["file"] == files[3]}
    assert got == want


def test_tails_and_losses_in_both_replicas(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_ROWS", 60)
    a, index = warc.write_warc(pages(spark, PAGES))
    b = warc.replicate(index, a)
    names = sorted({r["file"] for r in index.collect()})
    path = lambda folder, n: filesystem(f"{folder}/{n:08d}.warc.gz")[1]
    assert all(open(path(a, n), "rb").read() == open(path(b, n), "rb").read() for n in names)
    damage(path(a, names[0]), lambda d: d.extend(b"AAAA"))
    damage(path(b, names[0]), lambda d: d.extend(b"BBBBBBB"))
    for folder in (a, b):
        damage(path(folder, names[1]), lambda d: d.__setitem__(30, d[30] ^ 1))
    written, left, right = (Table(warc.fixity_tree(index, x), "t").df for x in (None, a, b))
    found = lambda x, y: {(r["file"], r["node"]) for r in warc.audit(x, y).collect()}
    assert found(left, right) == {(names[0], -1)}
    assert found(written, left) == found(written, right) == {(names[0], -1), (names[1], 0)}


def test_rows_that_come_often_are_spread_over_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_ROWS", 50)
    rows = [(None, None, "same")] * 900 + [(7, f"u{i}", "x") for i in range(300)]
    _, index = warc.write_warc(pages(spark, rows))
    sizes = [r["count"] for r in index.groupBy("file").count().collect()]
    assert sum(sizes) == 1200 and len(sizes) >= 20 and max(sizes) < 150
    got = warc.audit_pages(pages(spark, rows), damage="page_id = 7").collect()
    assert len(got) == 1200 and sum(r["damaged"] for r in got) == 300 and not any(r["lost"] for r in got)
    assert all(r["damaged"] == (r["page_id"] == 7) for r in got)


def test_sql_of_odd_rows(spark):
    import duckdb

    df = pages(spark, PAGES[:20] + ODD)
    with duckdb.connect() as con:
        con.register("pages", df.toPandas()[["page_id", "url", "html"]].astype({"page_id": "Int64"}))
        want = con.execute(queries.OP9_SQL).fetchall()
    assert sorted(map(key, warc.audit_pages(df, damage="page_id % 97 = 13").collect())) == sorted(map(key, want))


def test_empty_tables(spark):
    assert warc.audit_pages(pages(spark, [])).count() == 0


def test_records_of_pages(spark):
    got = sorted(warc.audit_pages(pages(spark, PAGES[:20] + ODD)).collect(), key=key)
    want = []
    for p, u, h in PAGES[:20] + ODD:
        r = warc.record(p, u, h)
        want.append((p, len(r), hashlib.sha256(r).hexdigest(), False, False))
    assert [tuple(r) for r in got] == sorted(want, key=key)


def test_query_against_sql(spark, data):
    sf = f"{data}/sf0.01"
    assert table_rows(queries.op9_warc_merkle_audit(spark, sf).toPandas()) == table_rows(connection(sf).execute(queries.OP9_SQL).df())
