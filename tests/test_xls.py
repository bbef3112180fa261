"""The reader of old binary workbooks against a small writer of its own."""

import struct

import pytest

from millrace.sources import xls
from millrace.sources.files import grids


def record(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def text(s, wide, count="<H"):
    return struct.pack(count, len(s)) + bytes([wide]) + (s.encode("utf-16-le") if wide else s.encode("latin-1"))


def workbook(cut=None, mode=0):
    """Two sheets. cut: where, in characters of the third shared string, the record ends and another one continues it."""
    strings = [text("Ma_NV", 0), text("Tên nhân viên", 1)]
    rich = struct.pack("<HBH", 4, 8, 1) + b"rich" + b"\0\0\0\0"  # with a run of formatting
    long = "ngày sinh đầy đủ"
    sst = struct.pack("<II", 4, 4) + strings[0] + strings[1]
    if cut is None:
        shared = record(xls.SST, sst + text(long, 1) + rich)
    else:
        shared = record(xls.SST, sst + struct.pack("<HB", len(long), 1) + long[:cut].encode("utf-16-le")) + record(xls.CONTINUE, b"\x01" + long[cut:].encode("utf-16-le") + rich)
    bof = lambda kind: record(xls.BOF, struct.pack("<HHHHII", 0x600, kind, 0, 0, 0, 0))
    styles = record(xls.FORMAT, struct.pack("<H", 164) + text('dd/mm/yyyy "s"', 0)) + b"".join(record(xls.XF, struct.pack("<HH", 0, f) + bytes(16)) for f in (0, 14, 164, 4))
    cell = lambda r, c, style, body=b"": struct.pack("<HHH", r, c, style) + body
    first = bof(0x10) + b"".join([
        record(xls.LABELSST, cell(0, 0, 0, struct.pack("<I", 0))), record(xls.LABELSST, cell(0, 1, 0, struct.pack("<I", 1))), record(xls.LABELSST, cell(0, 2, 0, struct.pack("<I", 2))), record(xls.LABELSST, cell(0, 4, 0, struct.pack("<I", 3))),
        record(xls.NUMBER, cell(2, 0, 0, struct.pack("<d", 1.25))), record(xls.RK, cell(2, 1, 1, struct.pack("<I", 36557 << 2 | 2))), record(xls.RK, cell(2, 2, 2, struct.pack("<I", 3655750 << 2 | 3))),
        record(xls.MULRK, struct.pack("<HH", 3, 0) + struct.pack("<HI", 0, (-7 & 0x3FFFFFFF) << 2 | 2) + struct.pack("<HI", 0, struct.unpack("<Q", struct.pack("<d", 0.5))[0] >> 32) + struct.pack("<H", 1)),
        record(xls.BOOLERR, cell(3, 2, 0, b"\x01\x00")), record(xls.BOOLERR, cell(3, 3, 0, b"\x07\x01")),
        record(xls.FORMULA, cell(4, 0, 0, struct.pack("<d", 2.5) + bytes(8))), record(xls.FORMULA, cell(4, 1, 0, b"\0\0\0\0\0\0\xff\xff" + bytes(8))), record(xls.STRING, text("kết", 1)), record(xls.FORMULA, cell(4, 2, 0, b"\x01\0\x00\0\0\0\xff\xff" + bytes(8))),
        record(xls.LABEL, cell(4, 3, 0, text("old", 0))), bof(0x20), record(xls.NUMBER, cell(9, 9, 0, struct.pack("<d", 9))), record(xls.EOF),
    ]) + record(xls.EOF)
    second = bof(0x10) + record(xls.LABEL, cell(0, 0, 0, text("x", 0))) + record(xls.EOF)
    sheet = lambda at, name, wide: record(xls.BOUNDSHEET, struct.pack("<IBB", at, 0, 0) + text(name, wide, "<B"))
    head = lambda a, b: bof(0x05) + record(xls.DATEMODE, struct.pack("<H", mode)) + styles + sheet(a, "Dữ liệu", 1) + sheet(b, "Hai", 0) + shared + record(xls.EOF)
    at = len(head(0, 0))
    return head(at, at + len(first)) + first + second


def compound(stream, name="Workbook", cutoff=4096):
    """A compound file with sectors of 512 bytes; a short stream goes into the small ones."""
    free, end = 0xFFFFFFFF, 0xFFFFFFFE
    small = len(stream) < cutoff
    pad = lambda b, n: b + bytes(-len(b) % n)
    body = pad(stream, 64 if small else 512)
    data = pad(body, 512)
    n = len(data) // 512
    mini = struct.pack(f"<{len(body) // 64}I", *range(1, len(body) // 64), end) if small else b""
    mini = mini + b"\xff" * (-len(mini) % 512)
    # sectors: directory, small table, data, then the table itself
    chains = [end] + ([end] * (len(mini) // 512)) + [*range(2 + len(mini) // 512, 1 + len(mini) // 512 + n), end]
    fats = -(-(len(chains) + 8) // 128)
    fat = chains + [0xFFFFFFFD] * fats
    fat += [free] * (fats * 128 - len(fat))
    start = 1 + len(mini) // 512

    def entry(label, kind, first, size):
        raw = label.encode("utf-16-le") + b"\0\0" if label else b""
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + bytes(36) + struct.pack("<IIII", first, size, 0, 0)[:12]

    entries = entry("Root Entry", 5, start if small else end, len(body) if small else 0) + entry(name, 2, 0 if small else start, len(stream)) + entry("", 0, 0, 0) * 2
    assert len(entries) == 512
    header = xls.MAGIC + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIIIII", fats, 0, 0, cutoff, 1 if small else end, len(mini) // 512, end, 0)
    header = (header + struct.pack("<I", 0) * 0).ljust(76, b"\0") + b"".join(struct.pack("<I", len(chains) + k) for k in range(fats))
    return header.ljust(512, b"\xff") + entries + mini + data + struct.pack(f"<{len(fat)}I", *fat)


WANT = [
    [("s", "Ma_NV", None), ("s", "Tên nhân viên", None), ("s", "ngày sinh đầy đủ", None), None, ("s", "rich", None)],
    [],
    [("n", "1.25", 1.25), ("d", "2000-02-01 00:00:00", 36557.0), ("d", "2000-02-01 12:00:00", 36557.5)],
    [("n", "-7", -7.0), ("n", "0.5", 0.5), ("b", "True", 1.0)],
    [("n", "2.5", 2.5), ("s", "kết", None), ("b", "False", 0.0), ("s", "old", None)],
]


@pytest.mark.parametrize("cut", [None, 0, 5, 15])
@pytest.mark.parametrize("cutoff", [4096, 64])
def test_sheets(cut, cutoff):
    found = [(name, i, list(rows)) for name, i, rows in xls.sheets(compound(workbook(cut), cutoff=cutoff))]
    assert found == [("Dữ liệu", 0, WANT), ("Hai", 1, [[("s", "x", None)]])]


def test_days_from_1904():
    rows = list(next(iter(xls.sheets(compound(workbook(mode=1)))))[2])
    assert rows[2][1] == ("d", "2004-02-02 00:00:00", 38019.0) and rows[2][0] == ("n", "1.25", 1.25)


@pytest.mark.parametrize("data", [b"", b"x", xls.MAGIC, compound(b"x" * 5000), compound(workbook(), "Other"), compound(workbook())[:700], compound(record(xls.BOF, struct.pack("<HH", 0x600, 5)) + record(xls.FILEPASS, b"\0\0"))])
def test_broken_files_fail(data):
    with pytest.raises(Exception):  # noqa: B017, PT011  whichever, it becomes a failed report
        list(xls.sheets(data))


def test_grid(spark):
    files = spark.createDataFrame([("a.xls", bytearray(compound(workbook()))), ("b.XLS", bytearray(b"x"))], "path string, content binary")
    rows = grids(files).collect()
    assert sum(r.cells is not None for r in rows) == 6 and [r.error is not None for r in rows if r.source_path == "b.XLS"] == [True]
