"""Workbooks of the old binary format (.xls, BIFF8 in a compound file), read with plain Python to rows of typed cells."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from .decode import DATE_FORMATS, Cell, is_date_code, number_cell

#: The mark of a compound file, ends of chains, numbers of records.
MAGIC, FREE = bytes.fromhex("D0CF11E0A1B11AE1"), 0xFFFFFFFA
BOF, EOF, CONTINUE, FILEPASS, DATEMODE, BOUNDSHEET, SST, XF, FORMAT = 0x809, 0x0A, 0x3C, 0x2F, 0x22, 0x85, 0xFC, 0xE0, 0x41E
NUMBER, RK, MULRK, LABEL, LABELSST, FORMULA, STRING, BOOLERR = 0x203, 0x27E, 0xBD, 0x204, 0xFD, 0x06, 0x207, 0x205
#: Days between the two ways to count from an epoch.
EPOCH_1904 = 1462


def _chain(table: list[int], start: int) -> Iterator[int]:
    """Sectors of a stream, each once, so that a broken file ends."""
    seen = set()
    while start < FREE and start < len(table) and start not in seen:
        seen.add(start)
        yield start
        start = table[start]


def stream(data: bytes, names: tuple[str, ...] = ("Workbook",)) -> bytes:
    """The named stream of a compound file."""
    if data[:8] != MAGIC:
        raise ValueError("no compound file")
    size, mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    directory, cutoff, mini_start, far = (struct.unpack_from("<I", data, at)[0] for at in (48, 56, 60, 68))
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    words = lambda raw: list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
    places, seen = words(data[76:512]), set()
    while far < FREE and far not in seen:  # the list of table sectors goes on in sectors of its own
        seen.add(far)
        *more, far = words(sector(far))
        places += more
    table = [x for k in places if k < FREE for x in words(sector(k))]
    whole = lambda start: b"".join(map(sector, _chain(table, start)))
    entries, root = whole(directory), None
    found = {}
    for at in range(0, len(entries) - 127, 128):
        n, kind = struct.unpack_from("<HB", entries, at + 64)
        start, length = struct.unpack_from("<II", entries, at + 116)
        if kind == 5:
            root = start
        elif kind == 2:
            found[entries[at : at + max(0, n - 2)].decode("utf-16-le", "replace")] = start, length
    for name in names:
        if name in found:
            start, length = found[name]
            if length >= cutoff:
                return whole(start)[:length]
            small, minis = whole(root), words(whole(mini_start))
            return b"".join(small[k * mini : (k + 1) * mini] for k in _chain(minis, start))[:length]
    raise ValueError("no workbook of this format in the file")


def _records(book: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    while at + 4 <= len(book):
        kind, n = struct.unpack_from("<HH", book, at)
        yield at, kind, book[at + 4 : at + 4 + n]
        at += 4 + n


class _Pieces:
    """Bytes of a record and of those that continue it. A text that goes on in the next one starts there with its width anew."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.k, self.at = pieces, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.pieces):
            part = self.pieces[self.k][self.at : self.at + n]
            out, n, self.at = out + part, n - len(part), self.at + len(part)
            if self.at >= len(self.pieces[self.k]):
                self.k, self.at = self.k + 1, 0
        return out

    def text(self, count: int, wide: int) -> str:
        out = ""
        while count and self.k < len(self.pieces):
            if self.k and not self.at:
                wide = self.take(1)[0] & 1
            n = max(1, min(count, (len(self.pieces[self.k]) - self.at) // (1 + wide)))
            out += self.take(n * (1 + wide)).decode("utf-16-le" if wide else "latin-1")
            count -= n
        return out

    def string(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        more = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        text = self.text(count, flags & 1)
        self.take(4 * runs + more)
        return text


def _rk(x: int) -> float:
    value = float(x >> 2 if x < 1 << 31 else (x >> 2) - (1 << 30)) if x & 2 else struct.unpack("<d", struct.pack("<Q", (x & 0xFFFFFFFC) << 32))[0]
    return value / 100 if x & 1 else value


class Book:
    """Sheets of a workbook: names in order, and their rows."""

    def __init__(self, data: bytes):
        self.data = stream(data)
        self.sheets: list[tuple[str, int]] = []
        self.strings: list[str] = []
        formats, styles, self.shift = {}, [], 0
        shared: list[bytes] | None = None
        for at, kind, body in _records(self.data):
            if at == 0 and (kind != BOF or struct.unpack_from("<H", body)[0] != 0x600):
                raise ValueError("a workbook of another version")
            if kind == CONTINUE and shared is not None:
                shared.append(body)
                continue
            if shared is not None and not self.strings:
                self.read_strings(shared)
            if kind == EOF:
                break
            if kind == FILEPASS:
                raise ValueError("the workbook is encrypted")
            if kind == DATEMODE:
                self.shift = EPOCH_1904 * struct.unpack_from("<H", body)[0]
            elif kind == BOUNDSHEET and body[5] == 0:
                self.sheets.append((_Pieces([body[8:]]).text(body[6], body[7] & 1), struct.unpack_from("<I", body)[0]))
            elif kind == SST:
                shared = [body]
            elif kind == FORMAT:
                formats[struct.unpack_from("<H", body)[0]] = _Pieces([body[2:]]).string()
            elif kind == XF:
                styles.append(struct.unpack_from("<H", body, 2)[0])
        self.dates = {i for i, f in enumerate(styles) if f in DATE_FORMATS or is_date_code(formats.get(f, ""))}

    def read_strings(self, pieces: list[bytes]) -> None:
        read = _Pieces(pieces)
        _, count = struct.unpack("<II", read.take(8))
        self.strings = [read.string() for _ in range(count)]

    def cells(self, start: int) -> Iterator[tuple[int, int, Cell]]:
        """row, column, cell of each cell that isn't empty; errors are empty."""
        number = lambda x, style: number_cell(x + (self.shift if style in self.dates else 0), style in self.dates)
        waits, deep = None, 0
        for _, kind, body in _records(self.data, start):
            if kind == BOF:
                deep += 1
            elif kind == EOF:
                deep -= 1
                if deep <= 0:
                    return
            elif deep > 1:
                continue  # a chart within the sheet
            elif kind == MULRK:
                row, first = struct.unpack_from("<HH", body)
                for k in range((len(body) - 6) // 6):
                    style, x = struct.unpack_from("<HI", body, 4 + 6 * k)
                    yield row, first + k, number(_rk(x), style)
            elif kind == STRING and waits:
                yield *waits, ("s", _Pieces([body]).string(), None)
                waits = None
            elif kind in (NUMBER, RK, LABEL, LABELSST, FORMULA, BOOLERR):
                row, column, style = struct.unpack_from("<HHH", body)
                if kind == NUMBER:
                    yield row, column, number(struct.unpack_from("<d", body, 6)[0], style)
                elif kind == RK:
                    yield row, column, number(_rk(struct.unpack_from("<I", body, 6)[0]), style)
                elif kind == LABELSST:
                    yield row, column, ("s", self.strings[struct.unpack_from("<I", body, 6)[0]], None)
                elif kind == LABEL:
                    yield row, column, ("s", _Pieces([body[6:]]).string(), None)
                elif kind == BOOLERR:
                    if not body[7]:
                        yield row, column, ("b", "True" if body[6] else "False", float(body[6]))
                elif body[12:14] != b"\xff\xff":
                    yield row, column, number(struct.unpack_from("<d", body, 6)[0], style)
                elif body[6] == 0:
                    waits = row, column
                elif body[6] == 1:
                    yield row, column, ("b", "True" if body[8] else "False", float(body[8]))

    def rows(self, start: int) -> Iterator[list[Cell]]:
        """Rows in order, empty ones where numbers are skipped. A sheet has 65,536 rows of 256 cells at most."""
        found: dict[int, dict[int, Cell]] = {}
        for row, column, cell in self.cells(start):
            if cell[0] != "s" or cell[1]:
                found.setdefault(row, {})[column] = cell
        for row in range(max(found, default=-1) + 1):
            own = found.get(row, {})
            yield [own.get(k) for k in range(max(own, default=-1) + 1)]


def sheets(data: bytes) -> Iterator[tuple[str, int, Iterator[list[Cell]]]]:
    book = Book(data)
    for i, (name, start) in enumerate(book.sheets):
        yield re.sub(r"\0.*", "", name), i, book.rows(start)
