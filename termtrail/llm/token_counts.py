"""Numbers of tokens of whole texts, without their ids.

A text's tokens are those of its parts between white space. A part of Latin letters (up to U+023F, as
composed characters) and plain ASCII punctuation falls into runs of either, which the tokenizer never joins and which it reads in lower
case; any other part counts as a whole. Runs and parts are told apart by 64-bit hashes, found for
a whole slice at once; the tokenizer sees each distinct one a single time, and its count is kept
in a table that is probed for all spans of a slice together, without sorting them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from termtrail.llm import token_file, words

KNOWN = 1 << 21
_PIECE = 1 << 20
_GAP, _LETTER, _MARK, _OTHER = range(4)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[words.SPACE] = _GAP
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_NO_LETTERS = [0xC397, 0xC3B7, 0xC4B0]  # multiplication and division signs, the capital I that folds to two characters
# quotes begin contractions, < and | begin the names of special tokens
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<|"]] = _MARK
_KINDS, _LOWER = _KIND.tobytes(), words.LOWER.tobytes()


class Known:
    """Counts by hash in an open table: a hash lies in the first free slot from its leading bits on."""

    def __init__(self, bits: int = 16):
        self.bits, self.rows = bits, 0
        self.hashes, self.counts = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> words.U(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts of all hashes (none is 0), and the places of those that are not here."""
        slot = self._slot(h)
        found = self.hashes[slot]
        out = self.counts[slot]
        left, new = np.flatnonzero(found != h), []
        while len(left):
            held = self.hashes[slot[left]]
            new.append(left[held == 0])
            here = left[held == h[left]]
            out[here] = self.counts[slot[here]]
            left = left[(held != 0) & (held != h[left])]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out, np.sort(np.concatenate(new)) if new else left

    def add(self, h: np.ndarray, counts: np.ndarray) -> None:
        """Takes in distinct hashes that are not here."""
        if 2 * (self.rows + len(h)) > len(self.hashes):
            held = np.flatnonzero(self.hashes)
            h, counts = np.concatenate((self.hashes[held], h)), np.concatenate((self.counts[held], counts))
            self.__init__(max(self.bits, (2 * len(h)).bit_length()))
        self.rows += len(h)
        slot = self._slot(h)
        while len(h):
            free = self.hashes[slot] == 0
            self.hashes[slot[free]] = h[free]
            placed = self.hashes[slot] == h
            self.counts[slot[placed]] = counts[placed]
            h, counts, slot = h[~placed], counts[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)


class Counter:
    """Counts tokens; keeps the counts of up to ``KNOWN`` runs and parts."""

    def __init__(self, tokenizer: str = token_file.TOKENIZER):
        self.encoder = token_file.encoder(tokenizer)
        self.known = Known()

    def _learn(self, parts: list[bytes], kinds: np.ndarray) -> np.ndarray:
        out = np.zeros(len(parts), dtype=np.int64)
        at_once = (kinds != _OTHER) & self.encoder.direct
        runs = np.flatnonzero(at_once)
        if len(runs):
            one = self.encoder.library.model.tokenize
            out[runs] = [len(one(run)) for run in self._spelled([parts[i] for i in runs])]
        whole = np.flatnonzero(~at_once)
        for lo in range(0, len(whole), 4096):
            some = whole[lo:lo + 4096]
            found = self.encoder.library.encode_batch_fast([parts[i].decode() for i in some], add_special_tokens=False)
            out[some] = [len(e) for e in found]
        return out

    def _spelled(self, runs: list[bytes]) -> list[str]:
        """Runs in lower case, as the model reads them: all in one string, for none holds a space."""
        joined = b" ".join(runs)
        if joined.isascii():
            return joined.decode().split(" ")
        return joined.decode().lower().encode().decode("latin-1").translate(self.encoder.bytes).split(self.encoder.bytes[32])

    def _piece(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and counts of the runs and parts of a piece; ``edges`` are where rows begin."""
        n, raw = len(data), data.tobytes()
        kind = np.frombuffer(bytearray(raw.translate(_KINDS)), dtype=np.uint8)
        lead = np.flatnonzero((data[:-1] - np.uint8(0xC3)) < 6)
        if len(lead):
            pair = data[lead].astype(np.int32) << 8 | data[lead + 1]
            lead = lead[~np.isin(pair, _NO_LETTERS)]
            kind[lead] = kind[lead + 1] = _LETTER
        border = np.ones(n, dtype=bool)
        np.not_equal(kind[1:], kind[:-1], out=border[1:])
        border[edges] = True
        starts = np.flatnonzero(border)
        ends = np.append(starts[1:], n)
        opens = np.zeros(len(starts), dtype=bool)
        opens[np.searchsorted(starts, edges)] = True
        solid = np.flatnonzero(kind[starts] != _GAP)
        starts, ends, opens, kind = starts[solid], ends[solid], opens[solid], kind[starts[solid]]
        opens[:1] = True
        opens[1:] |= np.diff(solid) > 1
        lower = raw.translate(_LOWER)
        if (kind == _OTHER).any():  # a part that holds others counts as a whole
            first = np.flatnonzero(opens)
            other = np.logical_or.reduceat(kind == _OTHER, first)
            last = np.append(first[1:], len(starts)) - 1
            ends[first[other]] = ends[last[other]]
            inside = np.repeat(other, last - first + 1)
            kind[inside] = _OTHER
            kept = opens | ~inside
            starts, ends, kind = starts[kept], ends[kept], kind[kept]
            change = np.zeros(n + 1, dtype=np.int8)
            whole = kind == _OTHER
            change[starts[whole]] += 1
            change[ends[whole]] -= 1
            lower = np.where(np.cumsum(change[:n], dtype=np.int8), data, np.frombuffer(lower, dtype=np.uint8)).tobytes()
        h = words.span_hashes(np.frombuffer(lower, dtype=np.uint8), starts, ends)
        h[h == 0] = 1
        count, new = self.known.find(h)
        if len(new):
            distinct, at, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            at = new[at]
            parts = [lower[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            learned = self._learn(parts, kind[at])
            count[new] = learned[inverse]
            if self.known.rows + len(distinct) > KNOWN:
                self.known = Known()
            self.known.add(distinct[:KNOWN], learned[:KNOWN])
        return starts, count

    def count(self, texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """Tokens of each text; null is empty."""
        data, offsets = words.text_bytes(texts)
        out = np.zeros(len(offsets) - 1, dtype=np.int64)
        lo = 0
        while lo < len(data):
            hi = min(lo + _PIECE, len(data))
            while hi < len(data) and not words.SPACE[data[hi]]:  # up to white space or the end of a row
                ahead = np.flatnonzero(words.SPACE[data[hi:hi + _PIECE]])
                row_end = int(offsets[np.searchsorted(offsets, hi)])
                hi = min(hi + int(ahead[0]) if len(ahead) else min(hi + _PIECE, len(data)), row_end)
                if hi == row_end:
                    break
            first, stop = np.searchsorted(offsets, [lo, hi])
            starts, counts = self._piece(data[lo:hi], np.unique(offsets[first:stop] - lo))
            before = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
            out += np.diff(before[np.searchsorted(starts + lo, offsets)])
            lo = hi
        return out


_counters: dict[str, Counter] = {}


def counter(tokenizer: str = token_file.TOKENIZER) -> Counter:
    """One counter for each Python worker and tokenizer file."""
    if tokenizer not in _counters:
        _counters[tokenizer] = Counter(tokenizer)
    return _counters[tokenizer]
