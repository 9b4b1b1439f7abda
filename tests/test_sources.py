"""Literal-file checks of the scan operators."""

import os
import tempfile

from laborlens.sources import files as FS


def _write(dirpath, name, data: bytes):
    p = os.path.join(dirpath, name)
    with open(p, "wb") as fh:
        fh.write(data)
    return p


def test_parse_layout():
    spec = {"a": "1,4", "b": "6-5", "c": "x", "d": "7:7", "e": (9, 8)}
    assert FS.parse_layout(spec) == [("a", 1, 4), ("b", 5, 6), ("d", 7, 7), ("e", 8, 9)]


def test_read_delimited_quotes_and_bad_lines(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    _write(d, "f.csv", b'a;b;c\n1;"x;y";3\n\n4;5;6;7\n8;9\n')
    rows = FS.read_delimited(spark, d, ";").drop("arquivo").collect()
    got = sorted(tuple(r) for r in rows)
    assert got == [("1", "x;y", "3"), ("8", "9", None)]


def test_duplicate_headers(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    _write(d, "f.csv", b"nome;idade;nome\nA;1;B\n")
    df = FS.read_delimited(spark, d, ";").drop("arquivo")
    assert df.columns == ["nome", "idade", "nome_1"]


def test_detect_charsets(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    _write(d, "latin.csv", "município;salário\nSão Paulo;1,5\n".encode("latin-1"))
    _write(d, "utf.csv", "município;salário\nSão Paulo;1,5\n".encode("utf-8"))
    got = {os.path.basename(r["path"]): r["charset"] for r in FS.detect_charsets(spark, d).collect()}
    assert got == {"latin.csv": "ISO-8859-1", "utf.csv": "UTF-8"}


def test_fixed_width_cut(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    _write(d, "f.txt", "2020 3 Zé  \n2021    x\n".encode("latin-1"))
    rows = FS.read_fixed_width(spark, d, [("ano", 1, 4), ("t", 6, 6), ("nome", 8, 11)]).drop("arquivo").collect()
    assert sorted(tuple(r) for r in rows) == [("2020", "3", "Zé"), ("2021", None, "x")]


def test_headers_per_file_and_line_breaks(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    _write(d, "1.csv", b'x;y;z\n1;"a\nb";3\nx;y;z\n')
    _write(d, "2.csv", b'y;x;z\n20;10;30\n')
    _write(d, "3.csv", "z;é\n5;6\n".encode("latin-1"))
    df = FS.read_delimited(spark, d, ";", encoding=None).drop("arquivo")
    got = {tuple(r[c] for c in ("x", "y", "z", "é")) for r in df.collect()}
    assert got == {("1", "a\nb", "3", None), ("x", "y", "z", None), ("10", "20", "30", None), (None, None, "5", "6")}


def test_control_characters_stay_in_lines(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    _write(d, "f.txt", b"a\x01b\xe9\n\nc")
    assert sorted(r["value"] for r in FS.read_lines(spark, d).collect()) == ["", "a\x01bé", "c"]


def test_zip_round_trip(spark):
    from laborlens.sources import sinks as K
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    lines = spark.range(500).selectExpr("concat('linha ', id) AS value").repartition(3)
    K.write_zip_archives(lines, "value", f"{d}/z", member="X_20240101.txt")
    rows = FS.read_zip_lines(spark, f"{d}/z").collect()
    assert sorted(r["value"] for r in rows) == sorted(f"linha {i}" for i in range(500))
    assert {r["membro"] for r in rows} == {"X_20240101.txt"}


def _archive(path, members):
    import zipfile
    with zipfile.ZipFile(path, "w") as z:
        for name, data, kind in members:
            z.writestr(name, data, kind)


def test_archive_members_are_partitions(spark):
    import zipfile

    from laborlens.sources import archives as AR
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    packed = [(f"m{i}.txt", "".join(f"{i} linha {k} é\r\n" for k in range(50 * i)).encode("latin-1"),
               zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED) for i in range(1, 7)]
    _archive(f"{d}/a.zip", packed)
    _archive(f"{d}/b2021.zip", [("x.txt", b"no end of line", zipfile.ZIP_DEFLATED), ("e.txt", b"", zipfile.ZIP_STORED)])
    _write(d, "plain.txt", b"first\n\nthird")
    df = AR.read_archives(spark, d, range_bytes=1000)
    parts = AR.LineReader({"path": d, "bytes": "1000"}).partitions()
    assert df.rdd.getNumPartitions() == len(parts) > 8
    want = [(n, x.rstrip("\r")) for n, data, _ in packed for x in data.decode("latin-1").split("\n")[:-1]]
    want += [("x.txt", "no end of line"), ("plain.txt", "first"), ("plain.txt", ""), ("plain.txt", "third")]
    assert sorted((r.membro, r.value) for r in df.collect()) == sorted(want)
    one = df.filter("membro = 'm3.txt'")
    assert one.count() == 150 and one.rdd.getNumPartitions() == 1          # the others are not opened
    assert df.filter("arquivo LIKE '%b2021.zip'").count() == 1
    # the largest member of each archive, as the binary-file scan reads it
    old = sorted(tuple(r) for r in FS.read_zip_lines(spark, d).select("membro", "value").collect())
    new = AR.read_archives(spark, d, largest=True).filter("arquivo LIKE '%.zip'")
    assert sorted((r.membro, r.value) for r in new.collect()) == old


def test_byte_ranges_cut_no_line():
    from laborlens.sources import archives as AR
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    data = b"".join(b"%d" % (10 ** (k % 7)) * (k % 5) + b"\n" for k in range(300)) + b"last"
    _write(d, "f.txt", data)
    for size in (1, 2, 3, 7, 50, 10_000):
        reader = AR.LineReader({"path": f"{d}/f.txt", "bytes": str(size)})
        got = [v for p in reader.partitions() for b in reader.read(p) for v in b.column("value").to_pylist()]
        assert got == data.decode().split("\n")
