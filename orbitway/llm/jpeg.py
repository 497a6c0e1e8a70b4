"""Progressive JPEG in numpy: many images at once, restart interval by restart interval.

The decoder reads spectral selection and successive approximation, with any sampling factors, tables
and restart intervals. All restart intervals of a scan, of all images of a batch, advance together one
code at a time; where a stream has no restart markers, a scan is one interval.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

#: Blocks of a restart interval, in every scan, and blocks that are transformed at once.
RESTART, CHUNK = 8, 1 << 14
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _zigzag() -> np.ndarray:
    """Natural index of each place of the zigzag order."""
    places = sorted(((y + x, (y if (y + x) % 2 else x), y, x) for y in range(8) for x in range(8)))
    return np.array([8 * y + x for _, _, y, x in places])


ZIGZAG = _zigzag()


@dataclass(frozen=True)
class Table:
    """A Huffman table: symbols in the order of their codes, and how many there are of each length."""

    counts: tuple[int, ...]
    symbols: tuple[int, ...]

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and length by symbol."""
        code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        value, at = 0, 0
        for n, k in enumerate(self.counts, 1):
            for s in self.symbols[at : at + k]:
                code[s], length[s] = value, n
                value += 1
            at += k
            value <<= 1
        return code, length

    def lookup(self) -> np.ndarray:
        """symbol | length << 8 of each 16-bit prefix; 0 where no code begins so."""
        out = np.zeros(1 << 16, np.int32)
        code, length = self.codes()
        for s in self.symbols:
            low = code[s] << (16 - length[s])
            out[low : low + (1 << (16 - length[s]))] = s | length[s] << 8
        return out


def _lengths(groups: dict[int, list[int]]) -> Table:
    return Table(tuple(len(groups.get(n, ())) for n in range(1, 17)), tuple(s for n in sorted(groups) for s in groups[n]))


# Code lengths by a rule: letters and spaces of text give sizes 6 and 5, other sizes without a run come next.
DC_TABLE = _lengths({4: list(range(12))})
_COMMON = [0x06, 0x05, *(s for s in range(11) if s not in (5, 6))]
AC_TABLE = _lengths({1: [0x06], 2: [0x05], 6: _COMMON[2:], 11: sorted({r << 4 | s for r in range(16) for s in range(11)} - set(_COMMON))})
FINE_TABLE = _lengths({1: [0x00], 9: sorted({r << 4 | s for r in range(16) for s in (0, 1)} - {0})})


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(float))[1].astype(np.int64)


# --- writing ------------------------------------------------------------------------------------


def _pack(code: np.ndarray, length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of codes (of at most 24 bits) in intervals that begin at the codes `first`; each is filled with ones to a byte.

    Returns the bytes, and where each interval ends in them.
    """
    bits = np.cumsum(length)
    total = np.diff(np.r_[0, bits[np.r_[first[1:], len(code)] - 1]])
    size = -(-total // 8)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(code)]))
    at = bits - length - (np.cumsum(total) - total)[owner] + 8 * (ends - size)[owner]
    fill = 8 * size - total
    at = np.r_[at, 8 * ends - fill]
    code, length = np.r_[code, (1 << fill) - 1], np.r_[length, fill]
    word = code << (32 - length - (at & 7))
    place, out = at >> 3, np.zeros(int(ends[-1]) + 4)
    for k in range(4):
        out += np.bincount(place + k, (word >> (24 - 8 * k)) & 255, len(out))[: len(out)]
    return out[: ends[-1]].astype(np.uint8), ends


def _marked(data: np.ndarray, ends: np.ndarray, images: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each image: a zero after each 255, and restart markers between its intervals (images: their number by image)."""
    full = data == 255
    inside = np.cumsum(full)
    owner_end = np.cumsum(images)
    last = np.zeros(len(ends), bool)
    last[owner_end - 1] = True
    number = np.arange(len(ends)) - np.repeat(owner_end - images, images)
    extra = np.where(last, 0, 2)
    before = np.cumsum(extra) - extra  # marker bytes before each interval
    interval = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    place = np.arange(len(data)) + inside - full + before[interval]
    out = np.zeros(len(data) + int(inside[-1] if len(data) else 0) + int(extra.sum()), np.uint8)
    out[place] = data
    stop = ends + np.r_[0, inside][ends] + before
    cut = stop[~last]
    out[cut], out[cut + 1] = 255, 0xD0 + number[~last] % 8
    raw = out.tobytes()
    edges = np.r_[0, stop[last]]
    return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _scan_header(parts: list[tuple[int, int]], low: int, high: int, before: int, shift: int) -> bytes:
    return _segment(0xDA, bytes([len(parts), *(x for p in parts for x in p), low, high, before << 4 | shift]))


def encode(images: list[tuple[np.ndarray, int, int, bytes]]) -> list[bytes]:
    """Progressive streams of images whose coefficients are given: (coefficients, columns, rows, comment).

    Coefficients: (columns * rows, 6, 64) in zigzag order, all of at least 2 and at most 2047; of each unit
    of 16 x 16 pixels four blocks of luma, row by row, and one of each chroma, which thus has half the
    luma's width and height; quantisation 1. Scans: direct terms without their last bit, and that bit; for
    each component places 1 to 5 and 6 to 63 without their last bit, and that bit of all.
    """
    counts = np.array([len(c) for c, *_ in images])
    all_ = np.concatenate([c for c, *_ in images]).astype(np.int64)
    # A scan of one component goes along its rows of blocks.
    along = lambda c, columns, rows: c[:, :4].reshape(rows, columns, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    components = [np.concatenate([along(*i[:3]) for i in images]).astype(np.int64), all_[:, 4], all_[:, 5]]

    def opening(counts: np.ndarray) -> np.ndarray:
        """The first block of each restart interval."""
        return np.flatnonzero((np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) % RESTART == 0)

    opens = [opening(4 * counts), opening(counts), opening(counts)]
    intervals = [-(-4 * counts // RESTART), -(-counts // RESTART), -(-counts // RESTART)]
    scans: list[tuple[bytes, list[bytes]]] = []
    # Direct terms, coarse, unit by unit: differences from the component's block before in the interval.
    coarse, units = all_[:, :, 0] >> 1, opens[1]
    luma = coarse[:, :4].reshape(-1)
    change = np.concatenate([np.diff(luma, prepend=0).reshape(-1, 4), np.diff(coarse[:, 4:], axis=0, prepend=0)], axis=1)
    change[units, 0], change[units, 4:] = coarse[units, 0], coarse[units, 4:]
    size = _bit_length(np.abs(change))
    code, length = DC_TABLE.codes()
    value = np.where(change < 0, change + (1 << size) - 1, change)
    codes, lengths = code[size] << size | value, length[size] + size
    scans.append((_scan_header([(k, 0x00) for k in (1, 2, 3)], 0, 0, 0, 1), _marked(*_pack(codes.reshape(-1), lengths.reshape(-1), 6 * units), intervals[1])))
    bits = (all_[:, :, 0] & 1).reshape(-1)
    scans.append((_scan_header([(k, 0x00) for k in (1, 2, 3)], 0, 0, 1, 0), _marked(*_pack(bits, np.ones_like(bits), 6 * units), intervals[1])))
    code, length = AC_TABLE.codes()
    for low, high in ((1, 5), (6, 63)):
        for k in range(3):
            value = components[k][:, low : high + 1] >> 1
            size = _bit_length(value)
            scans.append((_scan_header([(k + 1, 0x00)], low, high, 0, 1), _marked(*_pack((code[size] << size | value).reshape(-1), (length[size] + size).reshape(-1), opens[k] * (high - low + 1)), intervals[k])))
    for k in range(3):
        # No term is new, so that a block is an end-of-block code (one bit, 0) and a bit for each of its 63 terms.
        bits = components[k] & 1
        bits[:, 0] = 0
        scans.append((_scan_header([(k + 1, 0x01)], 1, 63, 1, 0), _marked(*_pack(bits.reshape(-1), np.ones(bits.size, np.int64), 64 * opens[k]), intervals[k])))
    tables = b"".join(bytes([kind, *t.counts, *t.symbols]) for kind, t in ((0x00, DC_TABLE), (0x10, AC_TABLE), (0x11, FINE_TABLE)))
    head = _segment(0xDB, bytes([0]) + b"\x01" * 64)
    tail = _segment(0xC4, tables) + _segment(0xDD, struct.pack(">H", RESTART))
    out = []
    for i, (_, columns, rows, comment) in enumerate(images):
        frame = struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        out.append(b"\xff\xd8" + _segment(0xFE, comment) + head + _segment(0xC2, frame) + tail + b"".join(h + data[i] for h, data in scans) + b"\xff\xd9")
    return out


# --- reading ------------------------------------------------------------------------------------


@dataclass
class Component:
    h: int
    v: int
    quantiser: int
    columns: int = 0  # blocks of its own size, as scans of this component alone count them
    rows: int = 0
    width: int = 0  # blocks of a row as stored, with those that only fill up units
    first: int = 0  # its first block in the batch's coefficients


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""
    scans: list[tuple] = field(default_factory=list)


def _parse(data: bytes) -> Image:
    """Headers of a stream, and its scans as (components, low, high, before, shift, restart, tables, data)."""
    image, tables, restart, at = Image(), {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisers[body[0] & 15] = np.frombuffer(body[1:], ">u2" if wide else np.uint8, 64).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables = tables | {body[0]: Table(tuple(body[1:17]), tuple(body[17 : 17 + n]))}
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            for k in range(n):
                name, sampling, q = body[6 + 3 * k : 9 + 3 * k]
                image.components[name] = Component(sampling >> 4, sampling & 15, q)
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only progressive Huffman-coded streams are read")
        elif marker == 0xDA:
            n = body[0]
            parts = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(n)]
            low, high, bits = body[1 + 2 * n : 4 + 2 * n]
            stop = m.start() if (m := _MARKER.search(data, at)) else len(data)
            image.scans.append((parts, low, high, bits >> 4, bits & 15, restart, tables, data[at:stop]))
            at = stop
    return image


class _Streams:
    """Entropy-coded intervals of one step of many images, without stuffing and markers; reads bits of all of them at once."""

    def __init__(self, datas: list[bytes]):
        raw = np.frombuffer(b"".join(datas) + bytes(1), np.uint8)
        scan_ends = np.cumsum([len(d) for d in datas])
        after = np.zeros(len(raw), bool)
        after[1:] = raw[:-1] == 255
        after[np.r_[0, scan_ends[:-1]]] = False
        marks = after & (raw >= 0xD0) & (raw <= 0xD7)
        drop = after & (raw == 0) | marks
        drop[:-1] |= marks[1:]
        drop[-1] = True
        place = np.cumsum(~drop)
        begins = np.r_[0, scan_ends[:-1], np.flatnonzero(marks) + 1]
        order = np.argsort(begins, kind="stable")
        begins = begins[order]
        self.owner = np.searchsorted(scan_ends, begins, side="right")
        self.owner[order < len(datas)] = np.arange(len(datas))
        self.at = 8 * np.r_[0, place][begins].astype(np.int64)
        kept = np.r_[raw[~drop], np.full(8, 255, np.uint8)].astype(np.uint32)
        self.words = kept[:-3] << np.uint32(24) | kept[1:-2] << np.uint32(16) | kept[2:-1] << np.uint32(8) | kept[3:]
        self.last = len(self.words) - 1

    def window(self, at: np.ndarray) -> np.ndarray:
        """The 32 bits at each position, of which at least 25 are sound."""
        return (self.words[np.minimum(at >> 3, self.last)] << (at & 7).astype(np.uint32)).astype(np.int64)


def _value(window: np.ndarray, used: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed number of `size` bits that follows `used` bits."""
    bits = (window >> (32 - used - size)) & ((1 << size) - 1)
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


class _Grid:
    """Blocks of intervals as a flat array with their starts."""

    def __init__(self, flat: np.ndarray, kinds: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.flat, self.kinds, self.starts, self.sizes = flat, kinds, starts, sizes

    def column(self, rows: np.ndarray, step) -> np.ndarray:
        return self.flat[self.starts[rows] + step]

    def kind(self, rows: np.ndarray, step) -> np.ndarray:
        return self.kinds[self.starts[rows] + step]


def _first_scan(streams: _Streams, grid: _Grid, coefficients: np.ndarray, lookup: np.ndarray, low: int, high: int, shift: int) -> None:
    flat = coefficients.reshape(-1)
    row = np.flatnonzero(grid.sizes > 0)
    at, block, k = streams.at[row], np.zeros(len(row), np.int64), np.full(len(row), low)
    while len(row):
        window = streams.window(at)
        found = lookup[window >> 16]
        symbol, used = found & 255, found >> 8
        run, size = symbol >> 4, symbol & 15
        value = _value(window, used, size)
        some = size > 0
        k += run
        if some.all():
            flat[64 * grid.column(row, block) + k] = value << shift
            k += 1
            at += used + size
            over = k > high
            block += over
            k[over] = low
        else:
            flat[64 * grid.column(row[some], block[some]) + k[some]] = value[some] << shift
            k += 1
            end = ~some & (run < 15)  # 2**run blocks and as many as `run` bits say end here, this one included
            more = np.where(end, (1 << run) + ((window >> (32 - used - run)) & ((1 << run) - 1)), 0)
            at += used + np.where(end, run, size)
            over = end | (k > high)
            block += np.where(end, more, over)
            k[over] = low
        live = block < grid.sizes[row]
        if not live.all():
            row, at, block, k = row[live], at[live], block[live], k[live]


def _refining_scan(streams: _Streams, grid: _Grid, coefficients: np.ndarray, lookup: np.ndarray, low: int, high: int, shift: int) -> None:
    row = np.flatnonzero(grid.sizes > 0)
    at, block, k, ends = streams.at[row], np.zeros(len(row), np.int64), np.full(len(row), low), np.zeros(len(row), np.int64)
    one = 1 << shift
    while len(row):
        own = grid.column(row, block)
        reading = ends == 0
        run, fresh = np.full(len(row), 64), np.zeros(len(row), np.int64)
        if reading.any():
            window = streams.window(at)
            found = lookup[window >> 16]
            symbol, used = found & 255, found >> 8
            r, size = symbol >> 4, symbol & 15
            end = reading & (size == 0) & (r < 15)
            bits = np.where(end, r, size)
            number = (window >> (32 - used - bits)) & ((1 << bits) - 1)
            ends = np.where(end, (1 << r) + number, ends)
            at = at + np.where(reading, used + bits, 0)
            going = reading & ~end
            run[going], fresh[going] = r[going], np.where(size[going] > 0, np.where(number[going] > 0, one, -one), 0)
        # Of the terms from k on: known ones take a bit each, up to the zero after `run` others (or the block's end).
        terms = coefficients[own][:, low : high + 1]
        place = np.arange(low, high + 1)
        ahead = place >= k[:, None]
        zeros = np.cumsum(ahead & (terms == 0), axis=1)
        reach = ahead & (zeros <= run[:, None])
        known = reach & (terms != 0)
        order = np.cumsum(known, axis=1)
        i, j = np.nonzero(known)
        bit_at = at[i] + order[i, j] - 1
        bit = (streams.window(bit_at) >> 31) & 1
        was = terms[i, j]
        grow = (bit == 1) & ((np.abs(was) & one) == 0)
        coefficients[own[i[grow]], low + j[grow]] += np.where(was[grow] > 0, one, -one)
        at = at + order[:, -1]
        target = ahead & (terms == 0) & (zeros == run[:, None] + 1)
        hit = target.any(axis=1)
        stop = np.where(hit, low + target.argmax(axis=1), high)
        new = hit & (fresh != 0)
        coefficients[own[new], stop[new]] = fresh[new]
        k = stop + 1
        done = (ends > 0) | (k > high)
        ends = np.maximum(ends - 1, 0)
        block = block + done
        k[done] = low
        live = block < grid.sizes[row]
        row, at, block, k, ends = row[live], at[live], block[live], k[live], ends[live]


def _units(image: Image, parts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan in order, the component (as the scan counts) of each, and blocks of a unit."""
    if len(parts) == 1:
        c = image.components[parts[0][0]]
        blocks = c.first + (np.arange(c.rows)[:, None] * c.width + np.arange(c.columns)[None, :]).reshape(-1)
        return blocks, np.zeros(len(blocks), np.int64), 1
    own = [image.components[name] for name, _ in parts]
    most_h, most_v = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
    rows, columns = -(-image.height // (8 * most_v)), -(-image.width // (8 * most_h))
    pieces, kinds = [], []
    for n, c in enumerate(own):
        y = (np.arange(rows)[:, None, None, None] * c.v + np.arange(c.v)[None, None, :, None])
        x = (np.arange(columns)[None, :, None, None] * c.h + np.arange(c.h)[None, None, None, :])
        pieces.append((c.first + y * c.width + x).reshape(rows * columns, -1))
        kinds.append(np.full(pieces[-1].shape, n))
    both = np.concatenate(pieces, axis=1)
    return both.reshape(-1), np.concatenate(kinds, axis=1).reshape(-1), both.shape[1]


def decode(datas: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Images of the streams and their quantised coefficients, (blocks, 64) in zigzag order, accumulated over all scans."""
    images = [_parse(d) for d in datas]
    total = 0
    for image in images:
        most_h, most_v = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
        for c in image.components.values():
            c.columns, c.rows = -(-(-(-image.width * c.h // most_h)) // 8), -(-(-(-image.height * c.v // most_v)) // 8)
            c.width = -(-image.width // (8 * most_h)) * c.h
            c.first, total = total, total + c.width * -(-image.height // (8 * most_v)) * c.v
    coefficients = np.zeros((total, 64), np.int32)
    # Scans of one step of all images that are alike but for their component go together.
    steps: dict[tuple, list[tuple[Image, tuple]]] = {}
    for image in images:
        seen: dict[tuple, int] = {}
        level = 0
        for scan in image.scans:
            parts, low, high, before, shift, _, tables, _ = scan
            which = tuple(sorted((k, tables[k]) for k in ({a >> 4 for _, a in parts} if low == 0 else {0x10 | parts[0][1] & 15}) if k in tables))
            kind = (low, high, before, shift, len(parts), which, tuple(a for _, a in parts) if low == 0 else parts[0][1] & 15)
            # A scan waits for earlier scans of its own component; others may share its step.
            level = max([seen.get((name, b), -1) for name, _ in parts for b in (low == 0, 0 if low else 1)], default=-1) + 1
            for name, _ in parts:
                seen[name, low == 0] = level
            steps.setdefault((level, kind), []).append((image, scan))
    for (_, kind), members in sorted(steps.items(), key=lambda x: x[0][0]):
        low, high, before, shift, *_ = kind
        streams = _Streams([scan[7] for _, scan in members])
        flat, kinds, starts, sizes, base = [], [], [], [], 0
        held = np.bincount(streams.owner, minlength=len(members))
        for n, (image, scan) in enumerate(members):
            blocks, own, unit = _units(image, scan[0])
            size = (scan[5] or len(blocks)) * unit
            opens = np.arange(0, len(blocks), size)
            if held[n] != len(opens):
                raise ValueError("a scan has other restart intervals than its header says")
            flat.append(blocks)
            kinds.append(own)
            starts.append(base + opens)
            sizes.append(np.minimum(size, len(blocks) - opens))
            base += len(blocks)
        grid = _Grid(np.concatenate(flat), np.concatenate(kinds), np.concatenate(starts), np.concatenate(sizes))
        parts, tables = members[0][1][0], members[0][1][6]
        if low == 0:
            lookups = np.stack([tables[a >> 4].lookup() for _, a in parts]) if not before else np.zeros((1, 1), np.int32)
            _direct_scan(streams, grid, coefficients, lookups, before, shift)
        else:
            (_first_scan if not before else _refining_scan)(streams, grid, coefficients, tables[0x10 | parts[0][1] & 15].lookup(), low, high, shift)
    return images, coefficients


def _direct_scan(streams: _Streams, grid: _Grid, coefficients: np.ndarray, lookups: np.ndarray, before: int, shift: int) -> None:
    at = streams.at.copy()
    past = np.zeros((len(at), 4), np.int64)
    for step in range(int(grid.sizes.max(initial=0))):
        live = np.flatnonzero(grid.sizes > step)
        block, kind = grid.column(live, step), grid.kind(live, step)
        window = streams.window(at[live])
        if before:
            coefficients[block, 0] |= ((window >> 31) & 1) << shift
            at[live] += 1
            continue
        found = lookups[kind, window >> 16]
        size, used = found & 255, found >> 8
        past[live, kind] += _value(window, used, size)
        coefficients[block, 0] = past[live, kind] << shift
        at[live] += used + size


_SCALE = 12
_BASIS = np.round(np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)]) * (1 << _SCALE))


def samples(coefficients: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """8-bit samples (blocks, 8, 8): inverse transform with an integer basis, exact in double precision, so that any batch gives the same."""
    out = np.empty((len(coefficients), 8, 8), np.uint8)
    for at in range(0, len(coefficients), CHUNK):
        block = np.zeros((len(coefficients[at : at + CHUNK]), 64))
        block[:, ZIGZAG] = coefficients[at : at + CHUNK] * quantiser
        half = (block.reshape(-1, 8) @ _BASIS.T).reshape(-1, 8, 8)  # rows
        full = (half.transpose(0, 2, 1).reshape(-1, 8) @ _BASIS.T).reshape(-1, 8, 8).transpose(0, 2, 1)
        out[at : at + CHUNK] = np.clip(np.floor(full / (1 << 2 * _SCALE) + 0.5) + 128, 0, 255)
    return out


def tensor(image: Image, coefficients: np.ndarray, ready: np.ndarray | None = None) -> np.ndarray:
    """Full-resolution RGB, (height, width, 3): chroma is repeated to the size of luma; one component gives grey.

    ready: samples of all coefficients, if they are known.
    """
    most_h, most_v = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
    planes = []
    for c in image.components.values():
        rows = -(-image.height // (8 * most_v)) * c.v
        at = slice(c.first, c.first + rows * c.width)
        own = samples(coefficients[at], image.quantisers[c.quantiser]) if ready is None else ready[at]
        plane = own.reshape(rows, c.width, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * c.width)
        planes.append(np.repeat(np.repeat(plane, most_v // c.v, axis=0), most_h // c.h, axis=1)[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    return to_rgb(np.stack(planes, axis=2))


def to_rgb(ycc: np.ndarray) -> np.ndarray:
    """The usual colour conversion in 16-bit fixed point."""
    y, b, r = (ycc[..., k].astype(np.int32) for k in range(3))
    b, r = b - 128, r - 128
    half = 1 << 15
    out = np.stack([y + ((91881 * r + half) >> 16), y - ((22554 * b + 46802 * r + half) >> 16), y + ((116130 * b + half) >> 16)], axis=-1)
    return np.clip(out, 0, 255).astype(np.uint8)
