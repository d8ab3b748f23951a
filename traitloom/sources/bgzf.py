"""Blocked gzip: members of at most 64 KB, so that a place in a file is a member's address and an offset within it.

A virtual offset is address << 16 | offset. Regions are found by an index of bins (a range of positions belongs to the
smallest bin that holds it; bins have 16 kb to 512 Mb) and, for every 16 kb, the first record that reaches it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"\x1f\x8b\x08\x04"
#: Fixed value: the empty member at the end of a file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MOST = 65_280
SHIFT = 14
LEVELS = 5
REACH = 1 << 29


class Writer:
    """Records into members; ``tell`` is where the next record begins."""

    def __init__(self, out):
        self.out, self.at, self.buffer = out, 0, bytearray()

    def tell(self) -> int:
        return self.at << 16 | len(self.buffer)

    def write(self, record: bytes, whole: bool = True) -> None:
        """A record that fits a member isn't cut over two, if ``whole``."""
        if whole and self.buffer and len(self.buffer) + len(record) > MOST:
            self.flush()
        self.buffer += record
        while len(self.buffer) > MOST:
            self.flush()

    def flush(self) -> None:
        part = bytes(self.buffer[:MOST])
        del self.buffer[:MOST]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        raw = c.compress(part) + c.flush()
        self.out.write(MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(part), len(part)))
        self.at += len(raw) + 26

    def close(self) -> None:
        while self.buffer:
            self.flush()
        self.out.write(END)


class Reader:
    """Members of an open file by address; ``read`` counts the bytes fetched."""

    AHEAD = 1 << 20

    def __init__(self, file, ahead: int = AHEAD):
        self.file, self.size, self.ahead = file, file.size(), ahead
        self.begin, self.held, self.read = 0, b"", 0

    def fetch(self, at: int, n: int) -> bytes:
        if not self.begin <= at <= at + n <= self.begin + len(self.held):
            self.begin, self.held = at, self.file.read_at(min(max(n, self.ahead), self.size - at), at)
            self.read += len(self.held)
        return self.held[at - self.begin : at - self.begin + n]

    def length(self, at: int) -> int | None:
        """Bytes of the member at an address; None if there is none."""
        head = self.fetch(at, min(12, self.size - at))
        if len(head) < 12 or head[:4] != MAGIC:
            return None
        (extra,) = struct.unpack_from("<H", head, 10)
        fields = self.fetch(at + 12, min(extra, self.size - at - 12))
        k = 0
        while k + 4 <= len(fields):
            a, b, n = struct.unpack_from("<BBH", fields, k)
            if (a, b, n) == (66, 67, 2) and k + 6 <= len(fields):
                return struct.unpack_from("<H", fields, k + 4)[0] + 1
            k += 4 + n
        return None

    def member(self, at: int) -> tuple[bytes, int]:
        """The text of the member at an address, and the address of the next."""
        n = self.length(at)
        if n is None or at + n > self.size:
            raise EOFError("the file is cut off or isn't blocked")
        raw = self.fetch(at, n)
        text = zlib.decompress(raw[12 + struct.unpack_from("<H", raw, 10)[0] : -8], -15)
        if struct.unpack_from("<II", raw, n - 8) != (zlib.crc32(text), len(text)):
            raise ValueError("a block's check sum is wrong")
        return text, at + n

    def border(self, at: int) -> int:
        """The first address of a member at or after ``at``; the file's size if there is none.

        Bytes that look like a member's head count only if another member, or the end, follows where it says.
        """
        while at < self.size:
            here = self.fetch(at, min(1 << 16, self.size - at))
            k = here.find(MAGIC)
            if k < 0:
                at += max(1, len(here) - 3)
                continue
            at += k
            n = self.length(at)
            if n and (at + n == self.size or (at + n < self.size and self.length(at + n))):
                return at
            at += 1
        return self.size

    def stream(self, begin: int, end: int) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
        """Texts of the members from one virtual offset, and in each where which address begins.

        A text ends with a member's end; the caller asks on while it holds a part of a record. From ``end`` on a text
        has one member.
        """
        at, skip = begin >> 16, begin & 0xFFFF
        while at < self.size:
            texts, places, n = [], [], 0
            while at < self.size and (not texts or (n < self.ahead and at << 16 < end)):
                text, after = self.member(at)
                places.append((n - skip, at))
                texts.append(text[skip:])
                n, at, skip = n + len(text) - skip, after, 0
            yield b"".join(texts), places


def bin_of(begin: int, end: int) -> int:
    """The smallest bin that holds [begin, end)."""
    end -= 1
    for level in range(LEVELS, 0, -1):
        shift = SHIFT + 3 * (LEVELS - level)
        if begin >> shift == end >> shift:
            return ((1 << 3 * level) - 1) // 7 + (begin >> shift)
    return 0


def bins_at(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``bin_of`` many ranges."""
    out, last = np.zeros(len(begin), np.int64), end - 1
    for level in range(1, LEVELS + 1):
        shift = SHIFT + 3 * (LEVELS - level)
        out = np.where(begin >> shift == last >> shift, ((1 << 3 * level) - 1) // 7 + (begin >> shift), out)
    return out


def bins_of(begin: int, end: int) -> list[int]:
    """All bins that meet [begin, end)."""
    out = [0]
    for level in range(1, LEVELS + 1):
        shift, first = SHIFT + 3 * (LEVELS - level), ((1 << 3 * level) - 1) // 7
        out += range(first + (begin >> shift), first + ((end - 1) >> shift) + 1)
    return out


class Index:
    """Bins and starts of each reference; one part serves alignments (BAI) and tables (TBI)."""

    def __init__(self):
        self.bins: dict[int, dict[int, list[list[int]]]] = {}
        self.starts: dict[int, dict[int, int]] = {}

    def add(self, ref: int, begin: int, end: int, at: int, after: int, where: int | None = None) -> None:
        """A record over [begin, end) of a reference, at a virtual offset, with its bin if known; records come in order."""
        if not 0 <= begin < end <= REACH:
            raise ValueError(f"positions reach to {REACH} at most")
        chunks = self.bins.setdefault(ref, {}).setdefault(bin_of(begin, end) if where is None else where, [])
        if chunks and chunks[-1][1] >> 16 == at >> 16:
            chunks[-1][1] = after
        else:
            chunks.append([at, after])
        starts = self.starts.setdefault(ref, {})
        for w in range(begin >> SHIFT, ((end - 1) >> SHIFT) + 1):
            starts.setdefault(w, at)

    def body(self, n_refs: int) -> bytes:
        out = []
        for ref in range(n_refs):
            bins, starts = self.bins.get(ref, {}), self.starts.get(ref, {})
            out.append(struct.pack("<i", len(bins)))
            for b, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            last, table = 0, []
            for w in range(max(starts, default=-1) + 1):
                last = starts.get(w, last)
                table.append(last)
            out.append(struct.pack("<i", len(table)) + struct.pack(f"<{len(table)}Q", *table))
        return b"".join(out)

    @classmethod
    def parse(cls, raw: bytes, at: int, n_refs: int) -> Index:
        out = cls()
        for ref in range(n_refs):
            (n,) = struct.unpack_from("<i", raw, at)
            at += 4
            bins = out.bins.setdefault(ref, {})
            for _ in range(n):
                b, m = struct.unpack_from("<Ii", raw, at)
                at += 8
                bins[b] = [list(struct.unpack_from("<QQ", raw, at + 16 * k)) for k in range(m)]
                at += 16 * m
            (n,) = struct.unpack_from("<i", raw, at)
            out.starts[ref] = dict(enumerate(struct.unpack_from(f"<{n}Q", raw, at + 4)))
            at += 4 + 8 * n
        return out

    def chunks(self, ref: int, begin: int, end: int, goal: int = 1 << 62) -> list[tuple[int, int]]:
        """Ranges of virtual offsets that hold all records over [begin, end), cut at records if over ``goal`` bytes."""
        begin, end = max(0, begin), min(end, REACH)
        bins, starts = self.bins.get(ref, {}), self.starts.get(ref, {})
        if begin >= end or not bins:
            return []
        least = starts.get(begin >> SHIFT, starts[max(starts)] if starts and begin >> SHIFT > max(starts) else 0)
        found = sorted((max(a, least), b) for k in bins_of(begin, end) for a, b in bins.get(k, []) if b > least)
        out: list[list[int]] = []
        for a, b in found:
            if out and a >> 16 <= out[-1][1] >> 16:
                out[-1][1] = max(b, out[-1][1])
            else:
                out.append([a, b])
        cuts, parts = sorted(set(starts.values())), []
        for a, b in out:
            for c in cuts:
                if a < c < b and (c >> 16) - (a >> 16) >= goal:
                    parts.append((a, c))
                    a = c
            parts.append((a, b))
        return parts
