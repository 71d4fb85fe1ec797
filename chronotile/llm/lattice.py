"""Segmentation lattices over a fixed public SentencePiece vocabulary, vectorised over many words at once.

A text is cut into units: a run of spaces with the non-space characters after it (or a trailing run of spaces). The
cut is exact when no piece of the vocabulary holds a space sign behind another character (checked on load), since
every segmentation of the text then ends a piece at each such place: the lattice of the text is the product of the
lattices of its units. Equal units share one lattice.

Arcs of a unit are all vocabulary pieces at all places; a character that is no piece becomes its UTF-8 byte pieces.
A space is the piece sign U+2581; a literal U+2581 in a text is spelled in bytes, so decoding is lossless.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

SPACE_SIGN = 0x2581
NO_CHAR = 0x110000  # stands for a literal space sign, which may only be spelled in bytes
LONG_UNIT = 48  # longer units take the sparse path, one by one
MUL = np.uint64(0x9E3779B97F4A7C15)
MUL2 = np.uint64(0xC2B2AE3D27D4EB4F)


def load_pieces(path: str) -> dict:
    """Read the model file on the driver; the result (bounded by the vocabulary) travels to the tasks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, ids, byte_ids = [], [], [-1] * 256
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            if any(p[k] == "▁" != p[k - 1] for k in range(1, len(p))):
                raise ValueError(f"piece {p!r} crosses a word start: units would not be exact")
            pieces.append(p)
            ids.append(i)
    if min(byte_ids) < 0:
        raise ValueError("the vocabulary needs all 256 byte pieces")
    return {"pieces": pieces, "ids": ids, "bytes": byte_ids, "size": sp.get_piece_size()}


@dataclass
class Group:
    """Units of one length: rows (index into the distinct units), chars[row, place] and all arcs, sorted by end node
    (row * (length + 1) + end), longest first. piece is -2 for a byte-spelled character. first: arc offsets by node."""

    length: int
    rows: np.ndarray
    chars: np.ndarray
    row: np.ndarray
    start: np.ndarray
    size: np.ndarray
    piece: np.ndarray
    first: np.ndarray


@dataclass
class Vocabulary:
    spec: dict
    longest: int = 0
    tables: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.spec["pieces"]))
        self.byte_ids = np.array(self.spec["bytes"], np.int32)
        by_len: dict[int, list[tuple[int, int]]] = {}
        for p, i in zip(self.spec["pieces"], self.spec["ids"]):
            by_len.setdefault(len(p), []).append((self._hash_one(p), i))
        for ln, items in by_len.items():
            self.tables[ln] = self._table(items)
        self.by_text = dict(zip(self.spec["pieces"], self.spec["ids"]))

    @staticmethod
    def _hash_one(p: str) -> int:
        h = 0
        for c in p:
            h = ((h + ord(c) + 1) * int(MUL)) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _table(items: list[tuple[int, int]], bits: int = 16):
        """Two small tables: a slot of the first, or of the second if the first was taken."""
        if len({h for h, _ in items}) != len(items):
            raise ValueError("two pieces share a 64-bit hash")
        while True:
            first, second = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
            keys, ids, ok = [0], [-1], True
            for h, i in items:
                a, b = h >> (64 - bits), ((h * int(MUL2)) & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
                t, s = (first, a) if not first[a] else (second, b)
                ok &= not t[s]
                t[s] = len(keys)
                keys.append(h)
                ids.append(i)
            if ok:
                return bits, first, second, np.array(keys, np.uint64), np.array(ids, np.int32)
            bits += 1

    def find(self, length: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, piece ids) of the hashes that are pieces."""
        if length not in self.tables:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        bits, first, second, keys, ids = self.tables[length]
        at = first[h >> np.uint64(64 - bits)]
        place = np.flatnonzero(at)
        at, hh = at[place], h[place]
        other = np.flatnonzero(keys[at] != hh)
        at[other] = second[(hh[other] * MUL2) >> np.uint64(64 - bits)]
        hit = (at > 0) & (keys[at] == hh)
        return place[hit], ids[at[hit]]

    def groups(self, chars: np.ndarray, lengths: np.ndarray, max_cells: int = 2_000_000):
        """Yield Group objects for the units of at most LONG_UNIT characters. chars: code points of all units."""
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        order = np.argsort(lengths, kind="stable")
        by = lengths[order]
        for n in np.unique(by):
            if n == 0 or n > LONG_UNIT:
                continue
            rows = order[np.searchsorted(by, n):np.searchsorted(by, n, "right")]
            step = max(1, max_cells // (int(n) * min(int(n), self.longest)))
            for a in range(0, len(rows), step):
                r = rows[a:a + step]
                yield self._group(int(n), r, chars[starts[r][:, None] + np.arange(n)])

    def _group(self, n: int, rows: np.ndarray, cp: np.ndarray) -> Group:
        m, top = len(rows), min(n, self.longest)
        h = np.zeros((m, n), np.uint64)
        code = cp.astype(np.uint64) + np.uint64(1)
        found = []
        for ln in range(1, top + 1):
            w = n - ln + 1
            h = (h[:, :w] + code[:, ln - 1:]) * MUL
            place, ids = self.find(ln, h.ravel())
            row, start = np.divmod(place, w)
            if ln == 1:
                spelled = np.ones(m * n, bool)
                spelled[place] = False
                extra = np.flatnonzero(spelled)
                row, start = np.concatenate([row, extra // n]), np.concatenate([start, extra % n])
                ids = np.concatenate([ids, np.full(len(extra), -2, np.int32)])
            found.append((row * (n + 1) + start + ln, row, start, ln, ids))
        count = np.zeros(m * (n + 1) + 1, np.int64)
        for node, *_ in found:
            count[node + 1] += 1  # one arc of each length ends at a node
        first = np.cumsum(count)
        free, total = first[:-1].copy(), int(first[-1])
        out = [np.zeros(total, t) for t in (np.int64, np.int64, np.int64, np.int32)]
        for node, row, start, ln, ids in reversed(found):
            to = free[node]
            free[node] += 1
            for o, x in zip(out, (row, start, ln, ids)):
                o[to] = x
        return Group(n, rows, cp, *out, first)

    def sparse_arcs(self, cp: np.ndarray):
        """For one long unit: per end position the list of (start, piece id)."""
        text = "".join("�" if c == NO_CHAR else chr(c) for c in cp)
        n, into = len(text), [[] for _ in range(len(text) + 1)]
        for j in range(n):
            one = -1 if cp[j] == NO_CHAR else self.by_text.get(text[j], -1)
            into[j + 1].append((j, one if one >= 0 else -2))
            for ln in range(2, min(self.longest, n - j) + 1):
                i = self.by_text.get(text[j:j + ln], -1)
                if i >= 0 and NO_CHAR not in cp[j:j + ln]:
                    into[j + ln].append((j, i))
        return into


def spell(code: int) -> bytes:
    return chr(SPACE_SIGN if code == NO_CHAR else code).encode("utf-8", "surrogatepass")


def utf8_width(code: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each code point."""
    return np.where(code == NO_CHAR, 3, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).astype(np.int64)


def spelled_bytes(code: np.ndarray) -> np.ndarray:
    """[n, 4] UTF-8 bytes of the code points, left-aligned; -1 beyond the width."""
    c = np.where(code == NO_CHAR, SPACE_SIGN, code).astype(np.int64)
    w = utf8_width(code)
    out = np.full((len(c), 4), -1, np.int64)
    lead = np.array([0, 0x00, 0xC0, 0xE0, 0xF0])
    for k in range(4):
        shift = (w - 1 - k) * 6
        at = k < w
        v = c[at] >> shift[at]
        out[at, k] = (lead[w[at]] | v) if k == 0 else (0x80 | (v & 0x3F))
    return out


@dataclass
class Units:
    """The units of a slice of texts. code: distinct unit of each occurrence; first: occurrence offsets by text;
    chars and lengths: code points of the distinct units."""

    code: np.ndarray
    first: np.ndarray
    chars: np.ndarray
    lengths: np.ndarray


def cut_units(raw: np.ndarray, offsets: np.ndarray) -> Units:
    """Cut the texts of one slice (UTF-8 bytes with row offsets) into units."""
    n = len(raw)
    if n == 0:
        return Units(np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    space = raw == 0x20
    cut = np.zeros(n + 1, bool)
    cut[1:n] = space[1:] & ~space[:-1]
    cut[offsets] = True
    cut[n] = True
    at = np.flatnonzero(cut)
    first = np.searchsorted(at, offsets)
    units = pa.Array.from_buffers(
        pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]
    )
    enc = units.dictionary_encode()
    distinct = enc.dictionary
    off = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset:distinct.offset + len(distinct) + 1]
    data = np.frombuffer(distinct.buffers()[2], np.uint8)[off[0]:off[-1]]
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    lengths = np.diff(heads[off - off[0]])
    sign = chars == SPACE_SIGN
    chars = np.where(chars == 0x20, SPACE_SIGN, chars)
    chars[sign] = NO_CHAR
    return Units(enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), first, chars, lengths)


def arc_weights(vocab: Vocabulary, g: Group, weight: np.ndarray) -> np.ndarray:
    """Weights of the arcs; weight: by piece id. A byte-spelled character weighs the product of its byte pieces."""
    w = weight[np.maximum(g.piece, 0)]
    spelled = np.flatnonzero(g.piece < 0)
    if len(spelled):
        b = spelled_bytes(g.chars[g.row[spelled], g.start[spelled]])
        w[spelled] = np.where(b >= 0, weight[vocab.byte_ids[np.maximum(b, 0)]], 1.0).prod(axis=1)
    return w


def forward(g: Group, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward algorithm: (log of the total weight of all segmentations of each unit, log forward values [end, row]).

    Plain products first; units whose values leave the safe range of doubles are done again with logarithms."""
    m, n = len(g.rows), g.length
    top = int(g.size.max())
    into = np.zeros((top + 1, n + 1, m))
    into[g.size, g.start + g.size, g.row] = w
    used = np.zeros((top + 1, n + 1), bool)
    used[g.size, g.start + g.size] = True
    a = np.zeros((n + 1, m))
    a[0] = 1.0
    for e in range(1, n + 1):
        for ln in range(1, min(e, top) + 1):
            if used[ln, e]:
                a[e] += a[e - ln] * into[ln, e]
    bad = np.flatnonzero(a.min(axis=0) < 1e-250)
    with np.errstate(divide="ignore"):
        logs = np.log(a)
        if len(bad):
            part, x = np.log(into[:, :, bad]), np.full((n + 1, len(bad)), -np.inf)
            x[0] = 0.0
            for e in range(1, n + 1):
                for ln in range(1, min(e, top) + 1):
                    x[e] = np.logaddexp(x[e], x[e - ln] + part[ln, e])
            logs[:, bad] = x
    return logs[n], logs


def arc_shares(g: Group, w: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """For each arc: the chance that it is the last one of a random segmentation of what ends at its node."""
    return w * np.exp(logs[g.start, g.row] - logs[g.start + g.size, g.row])


def expected_uses(g: Group, shares: np.ndarray) -> np.ndarray:
    """Chance of each arc in a random segmentation of its unit."""
    m, n = len(g.rows), g.length
    visit = np.zeros((n + 1, m))
    visit[n] = 1.0
    out, end = np.zeros_like(shares), g.start + g.size
    by_end = np.argsort(end, kind="stable")
    at = np.searchsorted(end[by_end], np.arange(n + 2))
    for e in range(n, 0, -1):
        arcs = by_end[at[e]:at[e + 1]]
        out[arcs] = shares[arcs] * visit[e, g.row[arcs]]
        visit += np.bincount(g.start[arcs] * m + g.row[arcs], out[arcs], minlength=(n + 1) * m).reshape(n + 1, m) if len(arcs) else 0
    return out


def sparse_forward(vocab: Vocabulary, cp: np.ndarray, log_weight: np.ndarray):
    """The same for one long unit: (log total, into, log forward values); into[e] has (start, piece id, log weight)."""
    into, alpha = vocab.sparse_arcs(cp), np.zeros(len(cp) + 1)
    weighted: list[list[tuple[int, int, float]]] = [[]]
    for e in range(1, len(cp) + 1):
        arcs = []
        for j, i in into[e]:
            lw = sum(log_weight[vocab.byte_ids[b]] for b in spell(int(cp[j]))) if i < 0 else log_weight[i]
            arcs.append((j, i, float(lw)))
        at = [alpha[j] + lw for j, _, lw in arcs]
        top = max(at)
        alpha[e] = top + np.log(sum(np.exp(x - top) for x in at))
        weighted.append(arcs)
    return float(alpha[-1]), weighted, alpha
