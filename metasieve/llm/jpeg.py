"""Baseline JPEG: markers, Huffman scans and DC-only luminance thumbnails.

The decoder parses markers, decodes all coefficients' codes and keeps the DC
values of the first component: an eighth of the picture's size, without any
inverse transform. Scans with restart intervals are decoded one interval a lane,
all lanes at once, over as many files as share tables.

The writer makes grey pictures of flat 8x8 blocks, one restart interval a row of
blocks, with a DC quantiser of 8: a block's DC value is its sample less 128, so
the thumbnail of such a file is the sample matrix itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# --- writing -----------------------------------------------------------------

#: Code lengths of the DC size classes 0 to 8; no code is all ones.
_DC_LENGTHS = {3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 0: 3, 1: 4, 2: 4, 8: 4}
ROW_BLOCKS = 64
_MOST_BLOCKS = 65535 // 8
#: Samples in a row of the pictures of a payload that is too long for one.
_PART_WIDTH = 512


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length), by rising length in the given order."""
    code, last, out = 0, 0, {}
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[symbol] = (code, n)
        code, last = code + 1, n
    return out


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: a block's bits (DC class and value, then the one-bit end of block) from the left of 16, and their number."""
    table, bits, lengths = _canonical(_DC_LENGTHS), np.zeros(511, np.uint16), np.zeros(511, np.uint8)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, n = table[size]
        value = diff if diff >= 0 else diff + (1 << size) - 1
        n_all = n + size + 1
        bits[diff + 255] = ((code << size | value) << 1) << (16 - n_all)
        lengths[diff + 255] = n_all
    return bits, lengths


_BITS, _LENGTHS = _difference_codes()
_PAD_BITS = np.array([(0xFFFF << (16 - n)) & 0xFFFF for n in range(8)], np.uint16)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _huffman_segment(cls: int, lengths: dict[int, int]) -> bytes:
    by = sorted(lengths.items(), key=lambda x: x[1])
    counts = bytes(sum(n == k for _, n in by) for k in range(1, 17))
    return _segment(0xC4, bytes((cls << 4,)) + counts + bytes(s for s, _ in by))


_TABLES = _segment(0xDB, bytes((0,)) + bytes((8,)) * 64) + _huffman_segment(0, _DC_LENGTHS) + _huffman_segment(1, {0: 1})


def _headers(width: int, height: int, note: bytes) -> bytes:
    frame = bytes((8,)) + (8 * height).to_bytes(2, "big") + (8 * width).to_bytes(2, "big") + bytes((1, 1, 0x11, 0))
    scan = bytes((1, 1, 0x00, 0, 63, 0))
    comment = _segment(0xFE, note) if note else b""
    return b"\xff\xd8" + comment + _TABLES + _segment(0xC0, frame) + _segment(0xDD, width.to_bytes(2, "big")) + _segment(0xDA, scan)


def _scans(samples: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Entropy-coded rows of ``samples`` (rows x width); a file begins at each row in ``starts``."""
    n, width = samples.shape
    level = samples.astype(np.int16) - 128
    diff = level.copy()
    diff[:, 1:] -= level[:, :-1]
    diff += 255
    lengths = np.empty((n, width + 1), np.uint8)
    lengths[:, :width] = _LENGTHS[diff]
    total = lengths[:, :width].sum(1, dtype=np.int64)
    lengths[:, width] = -total % 8
    bits = np.empty((n, width + 1), ">u2")
    bits[:, :width] = _BITS[diff]
    bits[:, width] = _PAD_BITS[lengths[:, width]]
    spread = np.unpackbits(bits.view(np.uint8).reshape(-1, 2), axis=1)
    data = np.packbits(spread[np.arange(16, dtype=np.uint8) < lengths.reshape(-1, 1)])
    row_bytes = (total + 7) // 8
    row_at = np.concatenate(([0], np.cumsum(row_bytes)))
    within = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    restart = within > 0
    step = 1 + (data == 0xFF).astype(np.int64)
    before = np.zeros(len(data), np.int64)
    before[row_at[:-1][restart]] = 2
    end = np.cumsum(step + before)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    at = end - step
    out[at] = data
    first = at[row_at[:-1][restart]]
    out[first - 2] = 0xFF
    out[first - 1] = 0xD0 + (within[restart] - 1) % 8
    cuts = [0, *(int(at[i]) for i in row_at[starts[1:]]), len(out)]
    return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def write_grey(matrices: list[np.ndarray], notes: list[bytes] | None = None) -> list[bytes]:
    """One file for each matrix of 8-bit samples (a sample is an 8x8 block), all of one width; ``notes`` go into comments."""
    rows = [m.shape[0] for m in matrices]
    starts = np.concatenate(([0], np.cumsum(rows)[:-1])).astype(np.int64)
    scans = _scans(np.concatenate(matrices), starts)
    notes = notes or [b""] * len(matrices)
    return [_headers(m.shape[1], m.shape[0], note) + s + b"\xff\xd9" for m, note, s in zip(matrices, notes, scans, strict=True)]


def matrix_of(payload: bytes) -> np.ndarray:
    """A payload (a positive multiple of 64 bytes) as rows of 64 samples.

    Where the height would not fit, rows are wider and zeros fill the last one.
    """
    n = len(payload) // ROW_BLOCKS
    wide = -(-n // _MOST_BLOCKS)
    if wide * ROW_BLOCKS > _MOST_BLOCKS:
        raise ValueError(f"{len(payload)} bytes do not fit into one picture")
    rows = -(-n // wide)
    filled = payload + bytes((rows * wide - n) * ROW_BLOCKS)
    return np.frombuffer(filled, np.uint8).reshape(rows, wide * ROW_BLOCKS)


def _fits(payload: bytes) -> bool:
    return len(payload) <= _MOST_BLOCKS // ROW_BLOCKS * ROW_BLOCKS * _MOST_BLOCKS


def _write_parts(payload: bytes) -> bytes:
    """Pictures of one width, one after the other; the first one's comment gives the length and their number."""
    size = _PART_WIDTH * _MOST_BLOCKS
    starts, out = range(0, len(payload), size), []
    for lo in starts:
        part = payload[lo : lo + size]
        part += bytes(-len(part) % _PART_WIDTH)
        note = b"" if lo else b"%d/%d" % (len(payload), len(starts))
        out += write_grey([np.frombuffer(part, np.uint8).reshape(-1, _PART_WIDTH)], [note])
    return b"".join(out)


def write_payloads(payloads: list[bytes]) -> list[bytes]:
    """One file for each payload; a comment gives the length where zeros fill the last row.

    A payload that is too long for one picture (66 MB) is split over several.
    """
    by_width: dict[int, list[int]] = {}
    matrices = {i: matrix_of(p) for i, p in enumerate(payloads) if _fits(p)}
    for i, m in matrices.items():
        by_width.setdefault(m.shape[1], []).append(i)
    out: list = [None if i in matrices else _write_parts(p) for i, p in enumerate(payloads)]
    for members in by_width.values():
        notes = [b"%d" % len(payloads[i]) if matrices[i].size > len(payloads[i]) else b"" for i in members]
        for i, blob in zip(members, write_grey([matrices[i] for i in members], notes), strict=True):
            out[i] = blob
    return out


def payload_length(blob: bytes, samples: int) -> int:
    """How many of a file's samples are payload."""
    note = parse(blob).comment.partition(b"/")[0]
    return int(note) if note.isdigit() else samples


# --- reading -----------------------------------------------------------------


@dataclass
class Picture:
    """What the markers of a baseline JPEG say, and where its scan lies."""

    width: int = 0
    height: int = 0
    restart: int = 0
    quant: dict[int, int] = field(default_factory=dict)
    huffman: dict[int, bytes] = field(default_factory=dict)
    #: By component of the frame: id, horizontal and vertical sampling, quantiser.
    frame: list[tuple[int, int, int, int]] = field(default_factory=list)
    #: By component of the scan: index in the frame, DC table, AC table.
    scan: list[tuple[int, int, int]] = field(default_factory=list)
    data: bytes = b""
    comment: bytes = b""
    #: Where the bytes after the picture begin.
    end: int = 0

    def mcus(self) -> tuple[int, int]:
        """Columns and rows of coded units."""
        h, v = max(c[1] for c in self.frame), max(c[2] for c in self.frame)
        if len(self.scan) == 1:
            h = v = 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def likeness(self) -> tuple:
        """Pictures of equal likeness can be decoded together."""
        return tuple(sorted(self.huffman.items())), tuple(self.frame), tuple(self.scan)


def parse(blob: bytes, start: int = 0) -> Picture:
    """Reads the markers of the picture at ``start``; raises ValueError for anything but a baseline file with one scan."""
    if blob[start : start + 2] != b"\xff\xd8":
        raise ValueError("no JPEG start marker")
    p, at = Picture(), start + 2
    while True:
        if at + 4 > len(blob) or blob[at] != 0xFF:
            raise ValueError("broken marker")
        marker = blob[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        n = int.from_bytes(blob[at + 2 : at + 4], "big")
        body, at = blob[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                p.quant[k] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                p.huffman[body[0]] = body[1:size]
                body = body[size:]
        elif marker == 0xC0:
            p.height, p.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            p.frame = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline file")
        elif marker == 0xFE:
            p.comment = body
        elif marker == 0xDD:
            p.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            ids = [c[0] for c in p.frame]
            p.scan = [(ids.index(body[i]), body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
            if not p.frame or p.scan[0][0] != 0:
                raise ValueError("the first scan lacks the first component")
            # within a scan, a byte FF comes before 00 or a restart marker only
            end = blob.find(b"\xff\xd9", at)
            p.data = blob[at : end if end >= at else len(blob)]
            p.end = end + 2 if end >= at else len(blob)
            return p


def parse_all(blob: bytes) -> list[Picture]:
    """The first picture of a file, and those that hold the rest of a payload split by :func:`write_payloads`."""
    found = [parse(blob)]
    total, slash, n = found[0].comment.partition(b"/")
    if slash and total.isdigit() and n.isdigit():
        while len(found) < int(n) and blob.startswith(b"\xff\xd8", found[-1].end):
            found.append(parse(blob, found[-1].end))
    return found


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: the symbol, and its code's length (0: no such code)."""
    symbols, lengths = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, k = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            lo, hi = code << (16 - n), (code + 1) << (16 - n)
            symbols[lo:hi], lengths[lo:hi] = table[k], n
            code, k = code + 1, k + 1
        code <<= 1
    return symbols, lengths


_LOOKUPS: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _tables(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    if table not in _LOOKUPS:
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        _LOOKUPS[table] = _lookup(table)
    return _LOOKUPS[table]


def _lanes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes without stuffing and restart markers, and where each interval begins."""
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xFF
    restart = after & (data >= 0xD0) & (data <= 0xD7)
    drop = restart | (after & (data == 0))
    drop[:-1] |= restart[1:]
    kept = np.cumsum(~drop)
    return data[~drop], np.concatenate(([0], kept[restart]))


class _Bits:
    """Bit positions of many lanes over one buffer."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        b = np.concatenate((data, np.full(8, 0xFF, np.uint8))).astype(np.int64)
        self.words = b[:-4] << 32 | b[1:-3] << 24 | b[2:-2] << 16 | b[3:-1] << 8 | b[4:]
        self.at = starts.astype(np.int64) * 8
        self.last = len(self.words) - 1

    def symbol(self, lanes, tables) -> np.ndarray:
        p = self.at[lanes]
        peek = (self.words[np.minimum(p >> 3, self.last)] >> (24 - (p & 7))) & 0xFFFF
        n = tables[1][peek]
        if not n.all():
            raise ValueError("a code that no table has")
        self.at[lanes] = p + n
        return tables[0][peek].astype(np.int64)

    def value(self, lanes, size: np.ndarray) -> np.ndarray:
        """Signed value of ``size`` bits."""
        p = self.at[lanes]
        bits = (self.words[np.minimum(p >> 3, self.last)] >> (40 - (p & 7) - size)) & ((1 << size) - 1)
        self.at[lanes] = p + size
        return np.where(bits >> np.maximum(size - 1, 0) > 0, bits, bits - (1 << size) + 1)


def _decode(pictures: list[Picture]) -> list[np.ndarray]:
    """DC values of the first component's blocks, in coded order: MCUs x blocks of the component."""
    first = pictures[0]
    single = len(first.scan) == 1
    blocks = [1 if single else first.frame[c][1] * first.frame[c][2] for c, _, _ in first.scan]
    tables = [(_tables(first.huffman[dc]), _tables(first.huffman[0x10 | ac])) for _, dc, ac in first.scan]
    data, starts = _lanes(np.frombuffer(b"\xff\xd0".join(p.data for p in pictures), np.uint8))
    sizes = []
    for p in pictures:
        cols, rows = p.mcus()
        total, step = cols * rows, p.restart or cols * rows
        sizes += [min(step, total - k) for k in range(0, total, step)]
    sizes = np.array(sizes, np.int64)
    if len(sizes) != len(starts):
        raise ValueError("restart intervals do not match the size")
    bits = _Bits(data, starts)
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros((len(sizes), int(sizes.max()), blocks[0]), np.int32)
    before = np.zeros((len(first.scan), len(sizes)), np.int64)
    falling = -sizes[order]
    for step in range(out.shape[1]):
        running = int(np.searchsorted(falling, -step, "left"))
        lanes = slice(None) if running == len(sizes) else order[:running]
        for c, (dc, ac) in enumerate(tables):
            for k in range(blocks[c]):
                before[c, lanes] += bits.value(lanes, bits.symbol(lanes, dc))
                if c == 0:
                    out[lanes, step, k] = before[c, lanes]
                _skip_ac(bits, lanes, ac, len(sizes))
    found, lane = [], 0
    for p in pictures:
        cols, rows = p.mcus()
        n = -(-cols * rows // (p.restart or cols * rows))
        found.append(np.concatenate([out[i, : sizes[i]] for i in range(lane, lane + n)]) if sizes[lane] != out.shape[1] or sizes[lane + n - 1] != out.shape[1] else out[lane : lane + n].reshape(-1, blocks[0]))
        lane += n
    return found


def _skip_ac(bits: _Bits, lanes, tables, n_lanes: int) -> None:
    """Passes over the other 63 coefficients of a block in each lane."""
    symbol = bits.symbol(lanes, tables)
    if not symbol.any():
        return
    going = np.arange(n_lanes)[lanes]
    k = np.ones(len(going), np.int64)
    while True:
        go = (symbol != 0)
        going, k, symbol = going[go], k[go], symbol[go]
        bits.at[going] += symbol & 15
        k += (symbol >> 4) + 1
        more = k < 64
        going, k = going[more], k[more]
        if not len(going):
            return
        symbol = bits.symbol(going, tables)


def thumbnails(blobs: list[bytes]) -> list[np.ndarray]:
    """DC-only luminance of each file: one 8-bit sample for each 8x8 block of the picture.

    The pictures of a split payload are put below each other.
    """
    split = [parse_all(b) for b in blobs]
    pictures = [parts[0] for parts in split]
    groups: dict[tuple, list[int]] = {}
    out: list = [None] * len(blobs)
    for i, parts in enumerate(split):
        if len(parts) > 1:
            out[i] = np.concatenate([_grid(p, _decode([p])[0]) for p in parts])
        else:
            groups.setdefault(parts[0].likeness(), []).append(i)
    for members in groups.values():
        for i, dc in zip(members, _decode([pictures[i] for i in members]), strict=True):
            out[i] = _grid(pictures[i], dc)
    return out


def _grid(p: Picture, dc: np.ndarray) -> np.ndarray:
    cols, rows = p.mcus()
    single = len(p.scan) == 1
    h, v = (1, 1) if single else p.frame[0][1:3]
    most_h, most_v = max(c[1] for c in p.frame), max(c[2] for c in p.frame)
    grid = dc.reshape(rows, cols, v, h).transpose(0, 2, 1, 3).reshape(rows * v, cols * h)
    wide = -(-p.width * p.frame[0][1] // (8 * most_h))
    high = -(-p.height * p.frame[0][2] // (8 * most_v))
    light = np.rint(grid[:high, :wide] * (p.quant[p.frame[0][3]] / 8)) + 128
    return np.clip(light, 0, 255).astype(np.uint8)


def thumbnail_hash(light: np.ndarray) -> str:
    """64 bits, hex: which of 8x8 area means lie above the mean of all."""
    r = np.linspace(0, light.shape[0], 9).astype(int)
    c = np.linspace(0, light.shape[1], 9).astype(int)
    rows = np.add.reduceat(light, np.minimum(r[:-1], light.shape[0] - 1), axis=0, dtype=np.int64)
    cells = np.add.reduceat(rows, np.minimum(c[:-1], light.shape[1] - 1), axis=1)
    area = np.outer(np.maximum(np.diff(r), 1), np.maximum(np.diff(c), 1))
    means = cells / area
    return np.packbits(means > means.mean()).tobytes().hex()
