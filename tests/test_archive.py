"""ZIP archives as tables, with damaged and nested members."""

import io
import zipfile

from linelens.sources import archive


def zipped(members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_tables_and_ledger(spark, tmp_path):
    inner = zipped([("deep.csv", b"p,q\n1,2\n")])
    deeper = zipped([("l2.zip", zipped([("l3.zip", inner)]))])
    body = zipped([("a.csv", b"k,v\r\n1,0.5\r\n2,\r\n\r\n3,7\r\n"), ("sub/b.tsv", "id\tname\n1\tx,y\n2\tz\n".encode()), ("c.csv", "name,n\n\"caf\u00e9, au lait\",1\n".encode("latin-1")),
                   ("dup.csv", b"a,a,,a-b\n1,2,3,4\n"), ("a.csv", b"again\n9\n"), ("note.md", b"hi"), ("none.csv", b""), ("in.zip", inner), ("deeper.zip", deeper), ("bad.zip", b"no archive")])
    (tmp_path / "set.zip").write_bytes(body)
    plain = bytearray(zipped([("good.csv", b"x\n1\n"), ("broken.csv", b"x\n" + b"12345\n" * 50)], zipfile.ZIP_STORED))
    plain[plain.index(b"12345") + 2] ^= 1  # the checksum no longer holds
    (tmp_path / "half.zip").write_bytes(bytes(plain))
    (tmp_path / "torn.zip").write_bytes(body[: len(body) // 2])
    (tmp_path / "other.csv").write_bytes(b"not,an,archive\n")
    tables, ledger = archive.scan_archives(spark, str(tmp_path))
    status = {(r.archive, r.member): (r.status, r.lines) for r in ledger.collect()}
    assert status == {
        ("set.zip", "a.csv"): ("READ", 5), ("set.zip", "a.csv#2"): ("READ", 2), ("set.zip", "sub/b.tsv"): ("READ", 3), ("set.zip", "c.csv"): ("READ", 2), ("set.zip", "dup.csv"): ("READ", 2),
        ("set.zip", "note.md"): ("SKIPPED", 0), ("set.zip", "none.csv"): ("EMPTY", 0), ("set.zip", "in.zip/deep.csv"): ("READ", 2),
        ("set.zip", "deeper.zip/l2.zip/l3.zip"): ("SKIPPED", 0), ("set.zip", "bad.zip"): ("FAILED", 0), ("half.zip", "good.csv"): ("READ", 2),
        ("half.zip", "broken.csv"): ("FAILED", status[("half.zip", "broken.csv")][1]), ("torn.zip", None): ("FAILED", 0)}
    reasons = {r.member: r.reason for r in ledger.where("status = 'FAILED'").collect()}
    assert "CRC" in reasons["broken.csv"] and all(reasons.values())
    rows = {n: [tuple(r) for r in t.collect()] for n, t in tables.items()}
    assert rows == {"set_a": [(1, 0.5), (2, None), (3, 7.0)], "set_a_2": [(9,)], "set_sub_b": [(1, "x,y"), (2, "z")], "set_c": [("caf\u00e9, au lait", 1)], "set_dup": [(1, 2, 3, 4)],
                    "set_in.zip_deep": [(1, 2)], "half_good": [(1,)]}
    assert tables["set_dup"].columns == ["a", "a_1", "c2", "a-b"]
    lines = archive.archive_lines(spark, str(tmp_path / "half.zip"))
    assert [r.x for r in archive.archive_rows(lines, "x long").collect()] == [1]


def test_written_archives_read_back(spark, tmp_path):
    out = str(tmp_path / "zips")
    rows = [(None if k % 3 == 2 else f"m{k % 3}", k, None if k % 5 == 0 else f'say "{k}", twice') for k in range(3000)]
    made = archive.write_archives(spark.createDataFrame(rows, "m string, k long, text string"), out, "m", ["k"], 2)
    assert {(r.member, r.lines) for r in made.collect()} == {("m0.csv", 1001), ("m1.csv", 1001), ("_.csv", 1001)}
    back = archive.archive_rows(archive.archive_lines(spark, out), "k long, text string")
    got = sorted((r.member, r.k, r.line, r.text) for r in back.collect())
    assert got == sorted((f"{m or '_'}.csv", k, k // 3 + 1, t) for m, k, t in rows)


def test_a_folder_without_archives(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x\n1\n")
    tables, ledger = archive.scan_archives(spark, str(tmp_path))
    assert tables == {} and ledger.count() == 0
