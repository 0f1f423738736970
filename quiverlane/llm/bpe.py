"""Byte-level BPE over batches of texts.

Pieces (split.py) that were met before are looked up in hash tables of their bytes. New ones are
made distinct, sorted into buckets by length and encoded as padded matrices: in each round every
row merges its leftmost pair of the least rank, and with it the other places of the same pair that
don't overlap one before; ranks come from a hash table of pairs, rows are compacted, and rows
without a mergeable pair leave the matrix. The places of one pair may merge together because an id
takes part only in merges that come after all those that make it; for a vocabulary of which that
isn't so, only the leftmost place does. Pieces of every length go the same way. All of it is exact:
table entries are compared byte by byte.

A vocabulary is a public file in the JSON form of byte-level BPE; its path is a parameter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quiverlane.functions.ragged import ragged_index
from quiverlane.llm.split import piece_starts

NO_RANK = np.int32(2**31 - 1)

#: Bytes of the pieces that are held as three words; longer ones are held as bytes.
SHORT = 24
#: Widths of the first matrices; each further one is four times as wide as the one before.
BUCKETS = (4, 8, 16, 24, 64)
#: Cells of a matrix, unless one piece alone has more.
CELLS = 1 << 21
#: Slots of the piece table; it is emptied when it is MOST_FULL, as a bound on memory.
SLOTS_LOG2, MOST_FULL = 20, 0.6
#: Long pieces that are remembered, and their most bytes each.
LONG_KEPT, LONG_BYTES = 20_000, 256
#: Bytes of text that are encoded at once; a longer text is encoded alone.
CHUNK_BYTES = 2 << 20

_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the files: itself if it prints, else the next from U+0100."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class PairTable:
    """Rank and merged id of pairs of ids, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(8, int(len(left) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NO_RANK, np.int32)
        self.merged = merged.astype(np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        todo, slot = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]] = keys[todo[won]]
            self.ranks[slot[won]] = todo[won]
            stay = np.ones(len(todo), bool)
            stay[won] = False
            todo, slot = todo[stay], (slot[stay] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _M1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NO_RANK for those that don't merge; ids below 0 never merge."""
        keys = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        keys[(left < 0) | (right < 0)] = -2
        out = np.full(keys.shape, NO_RANK, np.int32)
        flat, res = keys.ravel(), out.ravel()
        todo = np.flatnonzero(flat >= 0)
        slot = self._home(flat[todo])
        while len(todo):
            seen = self.keys[slot]
            hit = seen == flat[todo]
            res[todo[hit]] = self.ranks[slot[hit]]
            go = ~hit & (seen >= 0)
            todo, slot = todo[go], (slot[go] + 1) & (len(self.keys) - 1)
        return res.reshape(keys.shape)


def _places(ranks: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the places of the best rank that don't overlap one before them."""
    hit = ranks == best[:, None]
    run = np.flatnonzero((hit[:, 1:] & hit[:, :-1]).any(1))
    if len(run):
        # a run of one id: every second place from the left
        columns = np.arange(hit.shape[1])
        begin = np.maximum.accumulate(np.where(hit[run], -1, columns), axis=1)
        hit[run] &= (columns - begin) % 2 == 1
    return np.nonzero(hit)


def _same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether pieces of two buffers are equal; none is empty."""
    if not len(lengths):
        return np.zeros(0, bool)
    index, offsets = ragged_index(a_starts, lengths)
    return np.logical_and.reduceat(a[index] == b[ragged_index(b_starts, lengths)[0]], offsets[:-1])


def _hash_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each piece; none is empty."""
    index, offsets = ragged_index(starts, lengths)
    by_place = (np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths) + 1).astype(np.uint64) * _M2
    by_place = (by_place ^ (by_place >> np.uint64(29))) * _M1
    return np.add.reduceat((data[index].astype(np.uint64) + np.uint64(1)) * by_place, offsets[:-1])


class ByteBPE:
    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte_ids = np.array([vocab[s] for s in byte_symbols()], np.int32)
        left, right, merged = (np.array(x, np.int64) for x in ([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], [vocab[a + b] for a, b in pairs]))
        self.pairs = PairTable(left, right, merged)
        made_last = np.full(max(vocab.values()) + 1, -1)
        np.maximum.at(made_last, merged, np.arange(len(merged)))
        self.together = bool((np.maximum(made_last[left], made_last[right]) < np.arange(len(merged))).all())
        self._empty()

    def _empty(self) -> None:
        size = 1 << SLOTS_LOG2
        self.slot_entry = np.full(size, -1, np.int32)
        self.entry_words = np.zeros((3, 1024), np.uint64)
        self.entry_bytes = np.zeros(1024, np.int32)
        self.entry_at, self.entry_ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.n_entries, self.flat, self.n_flat = 0, np.zeros(4096, np.int32), 0
        # longer pieces in the order of their hashes
        self.long_hashes, self.long_at, self.long_sizes, self.long_entries = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.long_data = np.zeros(0, np.uint8)

    # -- distinct pieces to ids ------------------------------------------------------------

    def _merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ids padded with -1, fully merged; and the number of ids left in each."""
        out, counts = np.full_like(ids, -1), np.zeros(len(ids), np.int32)
        if ids.shape[1] == 1:
            return ids, (ids[:, 0] >= 0).astype(np.int32)
        rows, m = np.arange(len(ids)), ids
        ranks = self.pairs.rank(m[:, :-1], m[:, 1:])
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            over = best == NO_RANK
            if over.any():
                done = rows[over]
                out[done, : m.shape[1]], counts[done] = m[over], (m[over] >= 0).sum(1)
                keep = ~over
                rows, m, ranks, at, best = rows[keep], m[keep], ranks[keep], at[keep], best[keep]
                if not len(rows):
                    break
            row, places = np.arange(len(rows)), at
            if self.together:
                row, places = _places(ranks, best)
            # what each column of the compacted rows was before; the pad stands for nothing
            columns = np.arange(m.shape[1])
            source = columns[None, :] + (columns[None, :] > at[:, None])
            first = np.searchsorted(row, np.arange(len(rows)))
            several = np.flatnonzero(np.diff(np.append(first, len(row))) > 1)
            nth = np.arange(len(row)) - first[row]
            if len(several):
                gone = np.zeros((len(rows), m.shape[1]), bool)
                gone[row, places + 1] = True
                gone = gone[several]
                source[several] = np.where(np.sort(gone, 1), m.shape[1], np.argsort(gone, 1, kind="stable"))
            m = np.take_along_axis(np.pad(m, ((0, 0), (0, 1)), constant_values=-1), source, 1)
            ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 2)), constant_values=NO_RANK), source[:, :-1], 1)
            places = places - nth
            m[row, places] = self.pairs.merged[best[row]]
            left = places > 0
            ranks[row[left], places[left] - 1] = self.pairs.rank(m[row[left], places[left] - 1], m[row[left], places[left]])
            right = places < ranks.shape[1]
            ranks[row[right], places[right]] = self.pairs.rank(m[row[right], places[right]], m[row[right], places[right] + 1])
            if len(several) and (width := int((m >= 0).sum(1).max())) <= m.shape[1] // 2:
                m, ranks = m[:, : max(2, width)], ranks[:, : max(1, width - 1)]
        return out, counts

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of a byte buffer, one after the other, and the number of each."""
        counts = np.zeros(len(starts), np.int32)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low, widths = 0, list(BUCKETS)
        while widths[-1] < lengths.max(initial=0):
            widths.append(4 * widths[-1])
        for width in widths:
            held = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for rows in np.split(held, range(max(1, CELLS // width), len(held), max(1, CELLS // width))) if len(held) else ():
                index, offsets = ragged_index(starts[rows], lengths[rows])
                m = np.full((len(rows), int(lengths[rows].max())), -1, np.int32)
                m[np.repeat(np.arange(len(rows)), lengths[rows]), np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths[rows])] = self.byte_ids[data[index]]
                ids, counts[rows] = self._merge_rows(m)
                parts.append((rows, ids[ids >= 0], counts[rows]))
        flat, at = np.empty(counts.sum(dtype=np.int64), np.int32), np.cumsum(counts, dtype=np.int64) - counts
        for rows, ids, n in parts:
            flat[ragged_index(at[rows], n)[0]] = ids
        return flat, counts

    def _add(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """New entries with their ids; gives their numbers."""
        n, f = len(counts), len(flat)
        while self.n_entries + n > len(self.entry_at):
            self.entry_at, self.entry_ids, self.entry_bytes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.entry_at, self.entry_ids, self.entry_bytes))
            self.entry_words = np.concatenate([self.entry_words, np.zeros_like(self.entry_words)], 1)
        while self.n_flat + f > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        new = np.arange(self.n_entries, self.n_entries + n)
        self.flat[self.n_flat : self.n_flat + f] = flat
        self.entry_at[new], self.entry_ids[new] = self.n_flat + np.cumsum(counts, dtype=np.int64) - counts, counts
        self.n_entries, self.n_flat = self.n_entries + n, self.n_flat + f
        return new

    # -- pieces to entries -----------------------------------------------------------------

    def _words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The bytes of pieces of at most SHORT bytes as three words."""
        b = np.concatenate([data, np.zeros(SHORT + 8, np.uint8)])
        two = b[:-1].astype(np.uint16) | b[1:].astype(np.uint16) << 8
        four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << 16
        eight = four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)
        words = np.zeros((3, len(starts)), np.uint64)
        words[0] = eight[starts] & _KEEP[np.minimum(lengths, 8)]
        for k in (1, 2):
            more = np.flatnonzero(lengths > 8 * k)
            words[k, more] = eight[starts[more] + 8 * k] & _KEEP[np.minimum(lengths[more] - 8 * k, 8)]
        return words

    def _find(self, words: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The entry of each piece, or -1."""
        out = np.full(len(lengths), -1, np.int32)
        todo = np.arange(len(lengths))
        slot = (hashes >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)
        while len(todo):
            entry = self.slot_entry[slot]
            known = entry >= 0
            todo, slot, entry = todo[known], slot[known], entry[known]
            hit = (self.entry_words[0, entry] == words[0, todo]) & (self.entry_bytes[entry] == lengths[todo]) & (self.entry_words[1, entry] == words[1, todo]) & (self.entry_words[2, entry] == words[2, todo])
            out[todo[hit]] = entry[hit]
            todo, slot = todo[~hit], (slot[~hit] + 1) & (len(self.slot_entry) - 1)
        return out

    def _insert(self, entries: np.ndarray, hashes: np.ndarray) -> None:
        slot = (hashes >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)
        while len(entries):
            free = np.flatnonzero(self.slot_entry[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.slot_entry[slot[won]] = entries[won]
            stay = np.ones(len(entries), bool)
            stay[won] = False
            entries, slot = entries[stay], (slot[stay] + 1) & (len(self.slot_entry) - 1)

    def entries(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The entry of each piece, made where there is none."""
        if self.n_entries > MOST_FULL * len(self.slot_entry) or len(self.long_hashes) > LONG_KEPT:
            self._empty()
        out = np.full(len(starts), -1, np.int32)
        short = np.flatnonzero(lengths <= SHORT)
        s, n = starts[short], lengths[short]
        words = self._words(data, s, n)
        hashes = (words[0] * _M1) ^ (n.astype(np.uint64) * _M4)
        more = np.flatnonzero(n > 8)
        hashes[more] ^= (words[1, more] * _M2) ^ (words[2, more] * _M3)
        hashes = (hashes ^ (hashes >> np.uint64(29))) * _M1
        found = self._find(words, n, hashes)
        missed = np.flatnonzero(found < 0)
        while len(missed):
            _, first, inverse = np.unique(hashes[missed], return_index=True, return_inverse=True)
            new = missed[first]
            entry = self._add(*self.encode_pieces(data, s[new], n[new]))
            # so many new pieces at once that they would fill the table are encoded, but not kept
            if self.n_entries < 0.9 * len(self.slot_entry):
                self.entry_words[:, entry], self.entry_bytes[entry] = words[:, new], n[new]
                self._insert(entry, hashes[new])
            of = new[inverse]
            same = (words[:, of] == words[:, missed]).all(0) & (n[of] == n[missed])
            found[missed[same]] = entry[inverse[same]]
            missed = missed[~same]  # another piece of the same hash
        out[short] = found
        long = np.flatnonzero(lengths > SHORT)
        if len(long):
            out[long] = self._of_long(data, starts[long], lengths[long])
        return out

    def _of_long(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The entry of each piece of more than SHORT bytes, made where there is none."""
        hashes = _hash_bytes(data, starts, lengths)
        out = np.full(len(starts), -1, np.int32)
        todo = np.arange(len(starts))
        while len(todo):
            _, first, inverse = np.unique(hashes[todo], return_index=True, return_inverse=True)
            head = todo[first]
            entry = self._find_long(data, starts[head], lengths[head], hashes[head])
            if len(new := np.flatnonzero(entry < 0)):
                entry[new] = self._add(*self.encode_pieces(data, starts[head[new]], lengths[head[new]]))
                self._keep_long(data, starts[head[new]], lengths[head[new]], hashes[head[new]], entry[new])
            of = head[inverse]
            same = lengths[of] == lengths[todo]
            same[same] = _same_bytes(data, starts[of[same]], data, starts[todo[same]], lengths[todo[same]])
            out[todo[same]] = entry[inverse[same]]
            todo = todo[~same]  # another piece of the same hash
        return out

    def _find_long(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(starts), -1, np.int32)
        if len(self.long_hashes):
            slot = np.minimum(np.searchsorted(self.long_hashes, hashes), len(self.long_hashes) - 1)
            hit = np.flatnonzero((self.long_hashes[slot] == hashes) & (self.long_sizes[slot] == lengths))
            hit = hit[_same_bytes(self.long_data, self.long_at[slot[hit]], data, starts[hit], lengths[hit])]
            out[hit] = self.long_entries[slot[hit]]
        return out

    def _keep_long(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, entries: np.ndarray) -> None:
        """Remembers pieces of at most LONG_BYTES whose hash is new; ``hashes`` are distinct and in order."""
        slot = np.searchsorted(self.long_hashes, hashes)
        known = slot < len(self.long_hashes)
        known[known] = self.long_hashes[slot[known]] == hashes[known]
        keep = np.flatnonzero(~known & (lengths <= LONG_BYTES))
        index, offsets = ragged_index(starts[keep], lengths[keep])
        self.long_at = np.insert(self.long_at, slot[keep], len(self.long_data) + offsets[:-1])
        self.long_data = np.concatenate([self.long_data, data[index]])
        self.long_hashes, self.long_sizes, self.long_entries = (np.insert(old, slot[keep], new[keep]) for old, new in ((self.long_hashes, hashes), (self.long_sizes, lengths), (self.long_entries, entries)))

    # -- texts -----------------------------------------------------------------------------

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of the pieces of texts, and where the pieces of each text begin."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        if len(lead) == len(data):
            points = data
        else:
            points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        begins = np.searchsorted(lead, offsets)
        text_start = np.zeros(len(points) + 1, bool)
        text_start[begins] = True
        pieces = np.flatnonzero(piece_starts(points, text_start[:-1]))
        starts = lead[pieces]
        lengths = np.diff(np.append(starts, len(data))).astype(np.int32)
        return self.entries(data, starts, lengths), np.searchsorted(pieces, begins)

    def _chunks(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
            yield self._chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to

    def encode(self, texts: pa.Array) -> Iterator[pa.ListArray]:
        """The ids of texts without special tokens, in lists of chunks; nulls and empty texts give empty lists."""
        for entries, begins in self._chunks(texts):
            counts = self.entry_ids[entries]
            index, offsets = ragged_index(self.entry_at[entries], counts)
            yield pa.ListArray.from_arrays(pa.array(offsets[begins].astype(np.int32)), pa.array(self.flat[index]))

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        out = [np.zeros(0, np.int64)]
        for entries, begins in self._chunks(texts):
            total = np.zeros(len(entries) + 1, np.int64)
            np.cumsum(self.entry_ids[entries], out=total[1:])
            out.append(np.diff(total[begins]))
        return np.concatenate(out)


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteBPE:
    """The tokenizer of a file, once per worker process."""
    return ByteBPE(path)
