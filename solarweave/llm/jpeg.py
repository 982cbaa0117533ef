"""Baseline JPEG in numpy: a writer of DC-only grey images, and a reader of DC planes.

The reader decodes the segments between restart markers of many images at once: each
segment is a lane, and all lanes take the same step together.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format's Annex K: DC luminance code lengths and symbols.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)
#: The writer's AC table: end of block, in one bit.
AC_COUNTS = (1,) + (0,) * 15
AC_SYMBOLS = (0,)
#: Samples a row of blocks, and rows of blocks of one image (its height is 16 bits).
COLUMNS, ROWS = 192, 8191
STEP = 8


def codes(counts, symbols) -> dict[int, tuple[int, int]]:
    """symbol: (code, length), canonically."""
    out, code, it = {}, 0, iter(symbols)
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[next(it)] = (code, length)
            code += 1
        code <<= 1
    return out


def _writer_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255 to 255: bits of its DC code, value and end of block; their number."""
    dc, values, lengths = codes(DC_COUNTS, DC_SYMBOLS), [], []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        values.append(((code << size) | (d if d >= 0 else d + (1 << size) - 1)) << 1)
        lengths.append(n + size + 1)
    return np.array(values, np.uint32), np.array(lengths, np.int64)


VALUES, LENGTHS = _writer_tables()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def header(rows: int, columns: int = COLUMNS) -> bytes:
    """All before the entropy-coded data of a grey image of rows x columns blocks, a restart after each row."""
    size = (rows * 8).to_bytes(2, "big") + (columns * 8).to_bytes(2, "big")
    return b"".join((
        b"\xff\xd8", _segment(0xDB, b"\0" + bytes([STEP] * 64)), _segment(0xC0, b"\x08" + size + b"\1\1\x11\0"),
        _segment(0xC4, b"\0" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)), _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)),
        _segment(0xDD, columns.to_bytes(2, "big")), _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ))


def write(planes: list[np.ndarray]) -> list[bytes]:
    """Each plane (bytes, rows x COLUMNS) as one JPEG, or several one after another if it is very high.

    A sample is the grey of one 8 x 8 block: its DC coefficient alone, and so kept exactly.
    """
    rows = np.concatenate([p.reshape(-1, COLUMNS) for p in planes]).astype(np.int32)
    before = np.full(rows.shape, 128, np.int32)
    before[:, 1:] = rows[:, :-1]
    at = rows - before + 255
    length, value = LENGTHS[at], VALUES[at]
    end = np.cumsum(length, axis=1)
    row_bytes = (end[:, -1] + 7) >> 3
    first = np.cumsum(row_bytes) - row_bytes
    total = int(row_bytes.sum())
    bit = (end - length + (first << 3)[:, None]).ravel()
    word = value.ravel() << (32 - (bit & 7) - length.ravel()).astype(np.uint32)
    byte, out = bit >> 3, np.zeros(total + 4)
    for k in range(4):
        out += np.bincount(byte + k, ((word >> np.uint32(24 - 8 * k)) & np.uint32(255)).astype(np.float64), total + 4)
    data = out[:total].astype(np.uint8)
    data[first + row_bytes - 1] |= ((1 << ((row_bytes << 3) - end[:, -1])) - 1).astype(np.uint8)
    # A zero after each 0xFF, and two bytes of marker after each row.
    full = data == 255
    row_of = np.repeat(np.arange(len(rows)), row_bytes)
    place = np.arange(total) + np.cumsum(full) - full + 2 * row_of
    coded = np.zeros(total + int(full.sum()) + 2 * len(rows), np.uint8)
    coded[place] = data
    last = first + row_bytes - 1
    stop = place[last] + 1 + full[last]
    coded[stop] = 255
    result, row = [], 0
    for p in planes:
        images = []
        n = p.size // COLUMNS
        for a in range(0, n, ROWS):
            m = min(ROWS, n - a)
            ends = stop[row + a : row + a + m]
            coded[ends + 1] = 0xD0 + (np.arange(m) & 7)
            coded[ends[-1] + 1] = 0xD9
            begin = 0 if row + a == 0 else stop[row + a - 1] + 2
            images += (header(m), coded[begin : ends[-1] + 2].tobytes())
        row += n
        result.append(b"".join(images))
    return result


def lookup(counts, symbols) -> np.ndarray:
    """For the next 16 bits: length * 256 + symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, (code, n) in codes(counts, symbols).items():
        table[code << (16 - n) : (code + 1) << (16 - n)] = n * 256 + symbol
    return table


class Image:
    """What the markers of one image say."""

    def __init__(self):
        self.quant: dict[int, int] = {}
        self.tables: dict[int, tuple] = {}
        self.components: list[tuple[int, int, int, int]] = []
        self.width = self.height = self.restart = 0
        self.scans: list[tuple[list, np.ndarray, np.ndarray]] = []


def parse(data: bytes, at: int = 0) -> tuple[Image, int]:
    """One image from its markers, and where it ends. Raises ValueError on what is not baseline."""
    image, raw = Image(), np.frombuffer(data, np.uint8)
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    while True:
        while at + 1 < len(data) and data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        marker = data[at + 1]
        if marker == 0xD9:
            return image, at + 2
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                m = sum(body[1:17])
                image.tables[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + m]))
                body = body[17 + m :]
        elif marker in (0xC0, 0xC1):
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC and marker != 0xC8:
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            image.restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            scan = [(body[k], body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)]
            ff = at + np.flatnonzero(raw[at:-1] == 255) if len(ff0 := raw[at:]) > 1 else np.zeros(0, int)
            after = raw[ff + 1]
            others = np.flatnonzero((after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 255))
            if not len(others):
                raise ValueError("the scan has no end")
            end = int(ff[others[0]])
            ff, after = ff[: others[0]], after[: others[0]]
            cut = ff[after >= 0xD0]
            keep = np.ones(end - at, bool)
            keep[ff + 1 - at] = False
            keep[cut - at] = False
            kept = np.cumsum(keep)
            starts = np.concatenate(([0], kept[cut - at])) if len(cut) else np.zeros(1, np.int64)
            image.scans.append((scan, raw[at:end][keep], starts))
            at = end


def _lanes(data: np.ndarray, start: np.ndarray, units: np.ndarray, pattern: list[tuple[int, np.ndarray, np.ndarray]], parts: int) -> np.ndarray:
    """DC values (lane, unit, block of unit); pattern: component, DC and AC lookup of each block of a unit."""
    padded = np.concatenate((data, np.zeros(64, np.uint8))).astype(np.int32)
    peek = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
    most, top = int(units.max(initial=0)), len(peek) - 1
    out = np.zeros((len(start), most, len(pattern)), np.int32)
    order = np.argsort(-units, kind="stable")
    sizes, bit = units[order], start[order].astype(np.int64) << 3
    before = np.zeros((parts, len(start)), np.int32)
    ordered = np.zeros((most, len(pattern), len(start)), np.int32)

    def next16(p):
        return (peek[np.minimum(p >> 3, top)] >> (8 - (p & 7)).astype(np.int32)) & 0xFFFF

    live = len(start)
    for u in range(most):
        while live and sizes[live - 1] <= u:
            live -= 1
        p = bit[:live]
        for b, (part, dc, ac) in enumerate(pattern):
            got = dc[next16(p)]
            size = got & 255
            p += got >> 8
            value = next16(p) >> (16 - size)
            p += size
            value -= np.where(value < (1 << np.maximum(size - 1, 0)), (1 << size) - 1, 0) * (size > 0)
            before[part, :live] += value
            ordered[u, b, :live] = before[part, :live]
            who, k = None, None
            while True:
                at = p if who is None else p[who]
                got = ac[next16(at)]
                if (got == 0).any():
                    raise ValueError("a code that the table lacks")
                size, run = got & 15, (got >> 4) & 15
                at = at + (got >> 8) + size
                k = (1 if k is None else k) + run + 1
                if who is None:
                    p[:] = at
                else:
                    p[who] = at
                more = ((size > 0) | (run == 15)) & (k < 64)
                if not more.any():
                    break
                who = np.flatnonzero(more) if who is None else who[more]
                k = k[more]
    out[order] = ordered.transpose(2, 0, 1)
    return out


def read(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each file its images: width, height, and the luminance of each block from its DC value.

    Images with equal tables and sampling are decoded together. A file may hold several images.
    """
    images: list[list[Image]] = []
    for f in files:
        at, own = 0, []
        while at < len(f):
            image, at = parse(f, at)
            own.append(image)
        images.append(own)
    groups: dict[tuple, list[Image]] = {}
    for own in images:
        for image in own:
            scan = image.scans[0][0] if image.scans else []
            key = (tuple(image.components), tuple(scan), tuple(sorted(image.tables.items())), image.quant.get(image.components[0][3]) if image.components else None)
            groups.setdefault(key, []).append(image)
    tables: dict[tuple, np.ndarray] = {}
    planes: dict[int, np.ndarray] = {}

    def table(t):
        return tables.setdefault(t, None) if tables.get(t) is not None else tables.__setitem__(t, lookup(*t)) or tables[t]

    for (components, scan, _, step), own in groups.items():
        by_id = {c[0]: c for c in components}
        first = components[0]
        wide, high = max(c[1] for c in components), max(c[2] for c in components)
        pattern, inside = [], []
        for c, td, ta in scan:
            h, v = (by_id[c][1], by_id[c][2]) if len(scan) > 1 else (1, 1)
            for y in range(v):
                for x in range(h):
                    pattern.append((c, table(own[0].tables[td]), table(own[0].tables[16 + ta])))
                    if c == first[0]:
                        inside.append((len(pattern) - 1, y, x))
        ids = {c: i for i, c in enumerate(dict.fromkeys(p[0] for p in pattern))}
        pattern = [(ids[c], dc, ac) for c, dc, ac in pattern]
        data, start, units, shape, offset = [], [], [], [], 0
        for image in own:
            if len(scan) > 1:
                across, down = -(-image.width // (8 * wide)), -(-image.height // (8 * high))
            else:
                across, down = -(-(-(-image.width * first[1] // wide)) // 8), -(-(-(-image.height * first[2] // high)) // 8)
            _, raw, starts = image.scans[0]
            total = across * down
            each = image.restart or total
            n = np.minimum(each, total - each * np.arange(len(starts)))
            if n.sum() != total or n.min() < 1:
                raise ValueError("the restart intervals do not fit the image")
            data.append(raw)
            start.append(starts + offset)
            units.append(n)
            shape.append((across, down, len(starts)))
            offset += len(raw)
        values = _lanes(np.concatenate(data), np.concatenate(start), np.concatenate(units), pattern, len(ids))
        lane, counts = 0, np.concatenate(units)
        for image, (across, down, n) in zip(own, shape, strict=True):
            part = values[lane : lane + n]
            whole = part.reshape(-1, len(pattern)) if (counts[lane : lane + n] == part.shape[1]).all() else np.concatenate([part[i, :m] for i, m in enumerate(counts[lane : lane + n])])
            lane += n
            tall, broad = max(y for _, y, _ in inside) + 1, max(x for _, _, x in inside) + 1
            plane = np.zeros((down * tall, across * broad), np.int32)
            for b, y, x in inside:
                plane[y::tall, x::broad] = whole[:, b].reshape(down, across)
            planes[id(image)] = np.clip((plane * step + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return [[(i.width, i.height, planes[id(i)]) for i in own] for own in images]
