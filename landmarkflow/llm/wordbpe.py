"""Token ids of many texts at once, for tokenizers that merge bytes inside words.

The tokenizers library takes each word through objects of its own; most words of a
corpus are plain, so here their merges are done for thousands of words together
and remembered by hash. The library itself takes every string with anything out of
the ordinary in it: apostrophes, special tokens, marks, symbols outside ASCII.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from landmarkflow.llm.textbytes import prefix_codes, span_hashes

SPACE, LETTER, DIGIT, OTHER = range(4)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[48:58] = DIGIT
CLASS[97:123] = CLASS[128:] = LETTER
NONE = np.iinfo(np.int32).max
LONGEST = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


class PairTable:
    """Ranks of pairs of ids, in a few hash tables without chains."""

    def __init__(self, pairs: np.ndarray):
        left, self.tables = np.arange(len(pairs)), []
        for k in range(64):
            if not len(left):
                break
            factor = np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64))
            keys, ranks = np.full(1 << 18, -1, np.int64), np.full(1 << 18, NONE, np.int32)
            at = self._slot(pairs[left], factor)
            _, first = np.unique(at, return_index=True)
            keys[at[first]], ranks[at[first]] = pairs[left[first]], left[first]
            self.tables.append((factor, keys, ranks))
            left = np.delete(left, first)

    @staticmethod
    def _slot(keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return (keys.view(np.uint64) * factor >> np.uint64(46)).astype(np.int64)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, NONE, np.int32)
        for factor, known, ranks in self.tables:
            at = self._slot(keys, factor)
            np.copyto(out, ranks[at], where=known[at] == keys)
        return out


class WordBpe:
    """Merges of a byte-level BPE tokenizer whose words end in a suffix."""

    def __init__(self, tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int64)
        self.final = np.array([vocabulary[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.table = PairTable(np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in pairs],
                                        np.int64))
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and their number per word."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(lengths) - lengths
        parts, counts, order = [], np.zeros(len(words), np.int64), np.argsort(lengths, kind="stable")
        for a in range(0, len(words), 8192):
            rows = order[a:a + 8192]
            grid = self._block(data, start[rows], lengths[rows])
            used = grid >= 0
            counts[rows] = used.sum(axis=1)
            parts.append(grid[used])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        before = np.cumsum(counts[order]) - counts[order]
        at = np.empty(len(words), np.int64)
        at[order] = before
        source = np.repeat(at - (np.cumsum(counts) - counts), counts) + np.arange(len(flat))
        return flat[source].astype(np.uint16), counts

    def _block(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        width = int(length.max())
        columns = np.arange(width)
        inside = columns < length[:, None]
        grid = np.where(inside, self.inner[data[np.minimum(start[:, None] + columns,
                                                           len(data) - 1)]], -1)
        rows = np.arange(len(start))
        grid[rows, length - 1] = self.final[data[start + length - 1]]
        active = rows[length > 1]
        while len(active):
            now = grid[active]
            keys = np.where(now[:, 1:] >= 0, now[:, :-1] << 16 | now[:, 1:], -2)
            ranks = self.table.ranks(keys)
            place = ranks.argmin(axis=1)
            best = ranks[np.arange(len(active)), place]
            live = best != NONE
            active, now, place, best = active[live], now[live], place[live], best[live]
            moved = np.concatenate([now[:, 1:], np.full((len(now), 1), -1)], axis=1)
            now = np.where(columns > place[:, None], moved, now)
            now[np.arange(len(active)), place] = self.merged[best]
            grid[active] = now
        return grid


class ChunkEncoder:
    """Ids of chunks of texts. At most ``slots`` words and ``pool`` ids are remembered."""

    def __init__(self, path: str, slots: int = 1 << 21, pool: int = 1 << 24):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.slots, self.limit = WordBpe(self.tokenizer), slots, pool
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.starts, self.counts = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.pool, self.size = np.zeros(1 << 16, np.uint16), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Adds ids to the pool; their place in it."""
        while self.size + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint16)])
        self.pool[self.size:self.size + len(ids)] = ids
        self.size += len(ids)
        return self.size - len(ids)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    @staticmethod
    def _plain(raw: bytes) -> bytes | None:
        """Lower-case form of a segment that is one word for the tokenizer, else None."""
        if raw.isascii():
            return None if b"'" in raw or b"<|" in raw or len(raw) > LONGEST else raw
        text = raw.decode("utf-8", "replace")
        if not text.isalpha() or "Σ" in text or not unicodedata.is_normalized("NFC", text):
            return None
        text = text.lower()
        out = text.encode()
        return out if text.isalpha() and len(out) <= LONGEST else None

    def _learn(self, hashes: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of new segments; -1 for those the library has to take."""
        plain = [self._plain(x) for x in raw]
        good = np.array([x is not None for x in plain], bool)
        ids, counts = self.words.encode([x for x in plain if x is not None])
        at = self._keep(ids)
        starts, n = np.zeros(len(raw), np.int64), np.full(len(raw), -1, np.int64)
        starts[good], n[good] = at + np.cumsum(counts) - counts, counts
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        self.keys[slot], self.starts[slot], self.counts[slot] = hashes, starts, n
        # of two new words with one slot the last stays, with all three of its values
        return starts, n

    def encode(self, data: np.ndarray, at: np.ndarray, end_id: int
               ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each followed by ``end_id``, and their number per row."""
        if self.size > self.limit:
            self.forget()
        lower = LOWER[data]
        kind = CLASS[lower]
        change = np.ones(len(data), bool)
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        inner = at[:-1][at[:-1] < len(data)]
        change[inner] = True
        cut = np.flatnonzero(change)
        until = np.append(cut[1:], len(data))
        solid = kind[cut] != SPACE
        start, end = cut[solid], until[solid]
        hashes = span_hashes(prefix_codes(lower), start, end)
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        place, count = self.starts[slot].astype(np.int64), self.counts[slot].astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != hashes)
        if len(miss):
            new, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            whole = lower.tobytes()
            raw = [whole[a:b] for a, b in zip(start[miss[first]].tolist(),
                                              end[miss[first]].tolist())]
            starts, n = self._learn(new, raw)
            place[miss], count[miss] = starts[back], n[back]
        self._odd(data, kind, at, start, place, count)
        row_counts = np.diff(np.searchsorted(start, at))
        row = np.repeat(np.arange(len(at) - 1), row_counts)
        per_row = np.bincount(row, count, len(at) - 1).astype(np.int64) + 1
        out = np.full(int(per_row.sum()), end_id, np.uint16)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(per_row) - 1] = False
        before = np.cumsum(count) - count
        out[keep] = self.pool[np.repeat(place - before, count) + np.arange(int(count.sum()))]
        return out, per_row

    def _odd(self, data, kind, at, start, place, count) -> None:
        """Strings between blanks with an odd segment go to the library whole."""
        odd = np.flatnonzero(count < 0)
        if not len(odd):
            return
        blank = np.concatenate([[-1], np.flatnonzero(kind == SPACE), [len(data)]])
        rows = np.searchsorted(at, start[odd], "right") - 1
        gap = np.searchsorted(blank, start[odd])
        begin = np.maximum(blank[gap - 1] + 1, at[rows])
        stop = np.minimum(blank[gap], at[rows + 1])
        for a, b in sorted({*zip(begin.tolist(), stop.tolist())}):
            ids = self._library(data[a:b].tobytes().decode("utf-8", "replace"))
            i, j = np.searchsorted(start, [a, b])
            place[i], count[i] = self._keep(ids), len(ids)
            count[i + 1:j] = 0
