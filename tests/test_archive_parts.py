"""Archives cut into parts that several tasks open: the same rows as opened whole."""

import gzip
import io
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from sieveline.sources import archives


def _zip(members, method=zipfile.ZIP_DEFLATED, front=b""):
    out = io.BytesIO(front)
    out.seek(len(front))
    with zipfile.ZipFile(out, "a" if front else "w", method) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def _tar(members, form=tarfile.PAX_FORMAT):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=form) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("link")
        link.type = tarfile.SYMTYPE
        t.addfile(link)
    return out.getvalue()


def _unended(data):
    """A tar whose blocks of zeros at the end are missing."""
    return data[: -(-len(data.rstrip(b"\0")) // 512) * 512]


def _some(n=40, size=900):
    r = random.Random(n)
    return [(f"d/{i}" + "-é" * (60 if i % 7 == 0 else 1) + ".txt", r.randbytes(r.randrange(size))) for i in range(n)]


def _broken():
    """One member's data is damaged, another is encrypted by its flag, one is a link."""
    data = bytearray(_zip([*_some(20), ("link", b"target")]))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        bad, locked, at = z.infolist()[5], z.infolist()[9], z.start_dir
    data[bad.header_offset + 30 + len(bad.filename.encode()) + 2] ^= 0xFF
    for i in range(21):
        if i == 9:
            data[at + 8] |= 1
        if i == 20:
            data[at + 5], data[at + 38 : at + 42] = 3, (0o120777 << 16).to_bytes(4, "little")
        at += 46 + int.from_bytes(data[at + 28 : at + 30], "little") + int.from_bytes(data[at + 30 : at + 32], "little") + int.from_bytes(data[at + 32 : at + 34], "little")
    assert locked.filename
    return bytes(data)


CUT = {
    "deflated.zip": _zip(_some()), "stored.zip": _zip(_some(), zipfile.ZIP_STORED), "lzma.zip": _zip(_some(), zipfile.ZIP_LZMA), "front": _zip(_some(), front=b"PK\x03\x04" + b"#" * 500),
    "broken.zip": _broken(), "pax.tar": _tar(_some()), "gnu.tar": _tar(_some(), tarfile.GNU_FORMAT), "ustar": _tar([(n[:90].encode("ascii", "replace").decode(), d) for n, d in _some()], tarfile.USTAR_FORMAT),
}
WHOLE = {
    "nested.zip": _zip([*_some(), ("x", _zip([("a", b"1")]))]), "named.zip": _zip([*_some(), ("x.gz", b"no gzip")]), "nested.tar": _tar([*_some(), ("x", gzip.compress(b"1"))]), "few.zip": _zip([("a", b"x" * 9000)]),
    "none.zip": _zip([]), "f.gz": gzip.compress(b"x" * 9000), "corrupt.zip": b"PK\x03\x04broken", "open.tar": _unended(_tar(_some())), "plain.txt": b"x" * 9000,
}


def _cut(name, data, limit=1 << 20, part=3000):
    found = archives.parts(name, data, limit, part)
    return [row for form, piece, at in found for row in archives.expand_one(name, name, piece, limit, 0, None, form, at)], found


@pytest.mark.parametrize("name", CUT)
def test_parts_give_the_rows_of_the_whole(name):
    rows, found = _cut(name, CUT[name])
    assert len(found) > 4 and rows == list(archives.expand_one(name, name, CUT[name], 1 << 20))
    if name == "broken.zip":
        assert sum(r[3] is not None for r in rows) == 3
    if not name.startswith("broken"):
        assert max(len(p) for _, p, _ in found) < len(CUT[name]) / 1.5  # parts hold their members and the directory only


@pytest.mark.parametrize("name", WHOLE)
def test_what_could_reach_the_limit_stays_whole(name):
    assert archives.parts(name, WHOLE[name], 1 << 20, 3000) == []


def test_a_limit_that_members_reach_together_keeps_an_archive_whole():
    data = CUT["deflated.zip"]
    total = sum(len(d) for _, d in _some())
    assert archives.parts("a.zip", data, total, 3000) and not archives.parts("a.zip", data, total - 1, 3000)
    assert not archives.parts("a.tar", CUT["pax.tar"], total - 1, 3000)


def test_several_tasks_open_one_archive(spark):
    both = {**CUT, **WHOLE}
    inputs = spark.createDataFrame([(n, f"i/{n}", bytearray(d), i) for i, (n, d) in enumerate(both.items())], "path string, identity string, content binary, n int")
    inputs = inputs.withColumn("error", F.when(F.col("path") == "plain.txt", "failed before")).coalesce(1)
    own = lambda df: sorted((r.path, r.identity, bytes(r.content) if r.content is not None else None, r.error or "", r.is_member, r.n) for r in df.collect())
    parted = archives.expand(inputs, 1 << 20, spread=6, part=3000)
    assert own(parted) == own(archives.expand(inputs, 1 << 20))
    tasks = parted.where("path like 'deflated.zip!%'").select(F.spark_partition_id()).distinct().count()
    assert tasks > 2


def test_a_file_of_two_ranges():
    data = bytes(range(100))
    f = archives.Ranges(data[20:40] + data[70:], 20, 70, 100)
    f.seek(10)
    assert f.read(40) == bytes(10) + data[20:40] + bytes(10) and f.tell() == 50
    assert f.seek(-35, 2) == 65 and f.read() == bytes(5) + data[70:] and f.read(3) == b""
