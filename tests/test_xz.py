"""Lines of .xz files of many blocks and streams against the inflated whole."""

import lzma
import shutil
import subprocess

import numpy as np
import pytest

from millrace.sources import xz


def made(chunks):
    out = []
    xz.packed_blocks(iter(chunks), out.append)
    return b"".join(out)


def lines(spark, path, split):
    spark.dataSource.register(xz.XzLines)
    return spark.read.format("xz_lines").option("splitBytes", split).load(str(path))


def want(data):
    out, at = [], 0
    for line in data.split(b"\n")[: -1 if data.endswith(b"\n") or not data else None]:
        out.append((at, line.decode()))
        at += len(line) + 1
    return out


CASES = {
    "blocks": [b"one\ntwo", b"\nthree\n", b"\n", b"fo", b"ur", b"", b"\nlast without a feed"],
    "edges": [b"a\n", b"b\n", b"c\n\n", b"\n"],
    "long": [b"x" * 3_000_000, b"y" * 3_000_000 + b"\nz", b"\n", "é漢\U0001f600\n".encode() * 1000],
    "feeds": [b"\n" * 50, b"\n" * 50],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("split", [1, 5, 1 << 20])
def test_blocks(spark, tmp_path, case, split):
    chunks = CASES[case]
    data = b"".join(chunks)
    (tmp_path / "one.xz").write_bytes(made(chunks))
    assert lzma.decompress((tmp_path / "one.xz").read_bytes()) == data
    got = lines(spark, tmp_path / "one.xz", split)
    assert sorted((r.offset, r.value) for r in got.collect()) == want(data)
    if case == "blocks" and split == 1:
        assert got.rdd.getNumPartitions() == 6


def test_streams_padding_and_folders(spark, tmp_path):
    rng = np.random.default_rng(1)
    parts = [bytes(rng.choice(list(b"ab\n"), 400).astype(np.uint8)) for _ in range(4)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.xz").write_bytes(lzma.compress(parts[0]) + b"\0" * 8 + made([parts[1][:100], parts[1][100:]]) + lzma.compress(b"") + lzma.compress(parts[2], check=lzma.CHECK_CRC32) + b"\0" * 4)
    (tmp_path / "in" / "t.xz").write_bytes(lzma.compress(parts[3], check=lzma.CHECK_NONE))
    (tmp_path / "in" / "_u.xz").write_bytes(b"not counted")
    expected = sorted([("s.xz", *r) for r in want(b"".join(parts[:3]))] + [("t.xz", *r) for r in want(parts[3])])
    for path in (tmp_path / "in", f"file://{tmp_path}/in/[st].xz"):
        assert sorted(map(tuple, lines(spark, path, 7).collect())) == expected


@pytest.mark.skipif(not shutil.which("xz"), reason="needs the xz tool")
def test_files_of_the_tool(spark, tmp_path):
    data = b"".join(f"line {i} {'x' * (i % 97)}\n".encode() for i in range(5000))
    (tmp_path / "a").write_bytes(data)
    subprocess.run(["xz", "-T2", "--block-size=10000", str(tmp_path / "a")], check=True)
    assert len(xz.blocks_of(str(tmp_path / "a.xz"))) > 20
    assert sorted((r.offset, r.value) for r in lines(spark, tmp_path / "a.xz", 1).collect()) == want(data)


def test_memory_is_bounded_by_chunks(tmp_path):
    (tmp_path / "big.xz").write_bytes(lzma.compress(b"0123456789abcde\n" * 4_000_000))
    blocks = xz.blocks_of(str(tmp_path / "big.xz"))
    assert len(blocks) == 1 and max(map(len, xz.inflated(str(tmp_path / "big.xz"), blocks))) <= xz.CHUNK
    assert sum(1 for _ in xz.lines_of(str(tmp_path / "big.xz"), blocks, 0, 1)) == 4_000_000


def test_broken_files_are_named(spark, tmp_path):
    whole = made([b"a\n" * 100, b"b\n" * 100])
    for i, data in enumerate([b"version https://git-lfs.github.com/spec/v1\noid sha256:0\nsize 1\n", whole[:-1], whole[1:], whole[: len(whole) // 2], b"\0" * 12, b"x"]):
        (tmp_path / f"{i}.xz").write_bytes(data)
        with pytest.raises(xz.XzError, match=f"{i}.xz"):
            xz.blocks_of(str(tmp_path / f"{i}.xz"))


def test_write_and_read_back(spark, tmp_path):
    spark.dataSource.register(xz.XzLines)
    rows = [(f"row {i} é",) for i in range(3000)] + [("",), (None,)]
    out = str(tmp_path / "out")
    spark.createDataFrame(rows, "value string").repartition(3).write.format("xz_lines").option("blockBytes", 500).mode("append").save(out)
    assert sum(len(xz.blocks_of(f)) for f in xz.files_of(out)) > 60 and not list((tmp_path / "out").glob("_*"))
    assert sorted(r.value for r in lines(spark, out, 2000).collect()) == sorted(v or "" for (v,) in rows)
    with pytest.raises(Exception, match="line feed"):
        spark.createDataFrame([("a\nb",)], "value string").write.format("xz_lines").mode("append").save(out)
