"""Which texts contain which tokens: all tokens are looked for in one pass over the bytes of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are read at once, bytes compared as arrays before what is left is compared whole.
PIECE, FIRST = 1 << 20, 16
U = np.uint32


def _codes(raw: np.ndarray, width: int) -> np.ndarray:
    """The number that `width` bytes make, at each place where so many follow."""
    n = max(0, len(raw) - width + 1)
    out = np.zeros(n, U)
    for i in range(width):
        out |= raw[i : i + n].astype(U) << U(8 * i)
    return out


def _cell(codes: np.ndarray) -> np.ndarray:
    return (codes * U(2654435761)) >> U(16)


class Tokens:
    """Different tokens; each is looked for by the rarest 4 bytes (2 or 1 of short ones) that it has, told by some text, and then compared."""

    def __init__(self, tokens: list[str], sample: np.ndarray):
        self.data = [t.encode("utf-8", "surrogatepass") for t in tokens]
        self.size = np.array([len(x) for x in self.data], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.data) + b"\0", np.uint8)
        self.shift = np.zeros(len(tokens), np.int64)
        self.tables = []
        kind = np.select([self.size >= 4, self.size >= 2, self.size == 1], [4, 2, 1], 0)
        for width in (4, 2, 1):
            own = np.flatnonzero(kind == width)
            if not len(own):
                continue
            often = np.bincount(_cell(_codes(sample, width)), minlength=1 << 16)
            code = np.zeros(len(own), U)
            for i, t in enumerate(own):
                windows = _codes(np.frombuffer(self.data[t], np.uint8), width)
                self.shift[t] = often[_cell(windows)].argmin()
                code[i] = windows[self.shift[t]]
            order = np.argsort(code, kind="stable")
            codes, first = np.unique(code[order], return_index=True)
            table = np.zeros(1 << 16, bool)
            table[_cell(codes)] = True
            self.tables.append((width, table, codes, np.append(first, len(own)), own[order]))

    def _piece(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, text) of texts that end at `ends` in raw."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for width, table, codes, first, own in self.tables:
            code = _codes(raw, width)
            at = np.flatnonzero(table[_cell(code)])
            place = np.minimum(np.searchsorted(codes, code[at]), len(codes) - 1)
            same = codes[place] == code[at]
            at, place = at[same], place[same]
            times = first[place + 1] - first[place]
            hit = np.repeat(np.arange(len(at)), times)
            token = own[first[place][hit] + np.arange(len(hit)) - (np.cumsum(times) - times)[hit]]
            text = np.searchsorted(ends, at[hit], side="right")
            begin = at[hit] - self.shift[token]
            inside = (begin >= np.append(0, ends)[text]) & (begin + self.size[token] <= ends[text])
            token, text, begin = token[inside], text[inside], begin[inside]
            for j in range(FIRST):
                ok = (self.size[token] <= j) | (self.bytes[np.minimum(self.start[token] + j, len(self.bytes) - 1)] == raw[np.minimum(begin + j, len(raw) - 1)])
                token, text, begin = token[ok], text[ok], begin[ok]
            long = np.flatnonzero(self.size[token] > FIRST)
            ok = np.ones(len(token), bool)
            ok[long] = [raw[b : b + len(self.data[t])].tobytes() == self.data[t] for b, t in zip(begin[long], token[long], strict=True)]
            found.append((token[ok], text[ok]))
        return np.concatenate([t for t, _ in found]), np.concatenate([x for _, x in found])

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token, text) by number, each pair once; null texts contain nothing."""
        raw, ends = flat(texts)
        known = np.asarray(texts.is_valid())
        pairs, at = [], 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
            token, text = self._piece(raw[base : ends[to - 1]], ends[at:to] - base)
            pairs.append(token * len(ends) + text + at)
            at = to
        for t in np.flatnonzero(self.size == 0):
            pairs.append(t * len(ends) + np.arange(len(ends)))
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        token, text = both // max(1, len(ends)), both % max(1, len(ends))
        return token[known[text]], text[known[text]]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts one after another, and where each ends."""
    texts = texts.fill_null("")
    size = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], size)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, offsets[1:] - offsets[0]
