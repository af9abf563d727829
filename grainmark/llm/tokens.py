"""Token ids of whole texts by the ``tokenizers`` library, each part of a batch encoded once.

Three kinds of cut never fall inside a pre-token of the two public byte-level
vocabularies: at a single blank or line feed between two characters that are not
white space, and between an ASCII letter and ASCII punctuation other than an
apostrophe. So a text's ids are the ids of its parts, one after the other. Parts
repeat: the distinct ones of a slice are found by a 64-bit hash, encoded together
by the library, and their ids are gathered back for every occurrence. Parts of
earlier slices are remembered, as many as ``REMEMBERED`` says; one worker's tasks share
a tokenizer and what it remembers, until tasks of another kind follow. Parts with other white space are encoded alone.
Special-token strings in a text are ordinary text. Null texts are empty.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .textbytes import CODES, CODES_LOWER, SOLID, kept, ranges, span_hashes, text_slices

TOKEN_SLICE = 2 << 20
REMEMBERED = 400_000  # parts, and four times as many ids: about 13 MB
_MARK = b" \x01 "
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_POINT = np.zeros(256, bool)
_POINT[33:48] = _POINT[58:65] = _POINT[91:97] = _POINT[123:127] = True
_POINT[39] = False
_GROUP = 512

#: First bytes of the white space characters beyond ASCII, and U+0085, U+00A0.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_GAP = ~SOLID
_GAP[0x1C:0x20] = True


class PartTokenizer:
    """Encode slices of texts to unsigned 32-bit ids; ``remembered`` parts are kept from slice to slice."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        # Byte-level vocabularies write a blank as U+0120; those that drop blanks never make it.
        self.blanks = self.tok.encode(" a", add_special_tokens=False).tokens[0].startswith("Ġ")
        self.opens = None
        if self.blanks:
            vocab = self.tok.get_vocab()
            self.opens = np.zeros(max(vocab.values()) + 1, bool)
            for piece, i in vocab.items():
                self.opens[i] = piece.startswith("Ġ")
        else:
            vocab = self.tok.get_vocab()
            self.closes = np.zeros(max(vocab.values()) + 1, bool)
            for piece, i in vocab.items():
                self.closes[i] = piece.endswith("</w>")
        same = self.tok.encode("AZ", add_special_tokens=False).ids == self.tok.encode("az", add_special_tokens=False).ids
        self.codes = CODES_LOWER if same else CODES
        ids = self.tok.encode("a\na" if self.blanks else "a \x01 a", add_special_tokens=False).ids
        self.mark = ids[1] if len(ids) == 3 else None
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        """The remembered parts: ascending hashes, and where the ids of each begin and end."""
        self.known, self.begin, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int32), np.zeros(0, np.uint32)

    def _recall(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the remembered parts, whether it is one of them) of ascending hashes."""
        at = np.searchsorted(self.known, h)
        hit = np.zeros(len(h), bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == h[inside]
        return at, hit

    def _remember(self, h: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Take in parts that are not remembered yet (ascending hashes, ids in their order)."""
        if len(self.known) + len(h) > self.remembered or len(self.ids) + len(ids) > 4 * self.remembered:
            self._forget()
        if len(h) > self.remembered or len(ids) > 4 * self.remembered:
            return
        both = np.concatenate((self.known, h))
        order = np.argsort(both, kind="stable")
        n = np.concatenate((np.diff(self.begin), count))[order]
        starts = np.concatenate((self.begin[:-1], len(self.ids) + np.cumsum(count) - count))[order]
        self.ids = np.concatenate((self.ids, ids))[ranges(starts, n)]
        self.known, self.begin = both[order], np.concatenate(([0], np.cumsum(n))).astype(np.int32)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, joined: list[bytes], sizes: list[int], led: bool) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids and lengths of the parts of each group; groups that don't divide into their parts."""
        ids, lengths, failed = [], [], []
        texts = [j.decode("utf-8", "replace") for j in joined]
        for k, e in enumerate(self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            x = np.asarray(e.ids, np.uint32)
            if led and self.blanks:
                n = np.diff(np.append(np.flatnonzero(self.opens[x]), len(x)))
            elif led:
                n = np.diff(np.append(-1, np.flatnonzero(self.closes[x])))
            else:
                marks = np.flatnonzero(x == self.mark)
                n = np.diff(np.concatenate(([-1], marks, [len(x)]))) - 1
                x = x[x != self.mark]
            if len(n) != sizes[k] or int(n.sum()) != len(x):
                failed.append(k)
                x, n = x[:0], np.zeros(sizes[k], np.int64)
            ids.append(x)
            lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths), failed

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids) of texts given as bytes and offsets."""
        n, rows = len(buf), len(off) - 1
        if not n:
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        gap = _GAP[buf]
        pad = np.zeros(n + 4, np.uint8)
        pad[3 : n + 3] = buf  # pad[i + 3] is byte i
        prev = np.ones(n + 2, bool)
        prev[1 : n + 1] = gap
        edge = np.zeros(n + 1, bool)
        edge[off] = True

        def between(byte: int) -> np.ndarray:
            """Places of the byte between two characters of one text that are not white space."""
            i = np.flatnonzero(buf == byte)
            wide = _WIDE[pad[i + 4]] | (pad[i + 1] == 0xC2) | _WIDE[pad[i]]
            return i[~(prev[i] | prev[i + 2] | wide | edge[i] | edge[np.minimum(i + 1, n)])]

        cuts, lines = between(32), between(10)
        points = np.flatnonzero(_POINT[buf])
        points = points[_LETTER[pad[points + 2]] & ~edge[points]]
        filled = off[:-1] < off[1:]
        # No two of these are one place.
        begins = np.zeros(n + 1, bool)
        for at in (off[:-1][filled], cuts + 1, points, lines, lines + 1):
            begins[at] = True
        starts = np.flatnonzero(begins)
        begins[:] = False
        begins[cuts + 1] = True
        led = begins[starts]
        ends = np.append(starts[1:] - led[1:], n)
        row = np.searchsorted(off, starts, "right") - 1
        h = span_hashes(buf, starts, ends, self.codes)
        if self.blanks:
            h = np.where(led, h, ~h)
        distinct, at, which = np.unique(h, return_index=True, return_inverse=True)
        place, hit = self._recall(distinct)
        at = at[~hit]
        ids, length = self._encode_parts(buf, gap, starts[at], ends[at], led[at])
        # The parts' ids: those remembered, then the new ones.
        where = np.empty(len(distinct), np.int64)
        count = np.empty(len(distinct), np.int64)
        where[hit], count[hit] = self.begin[place[hit]], np.diff(self.begin)[place[hit]]
        where[~hit], count[~hit] = len(self.ids) + np.cumsum(length) - length, length
        per = count[which]
        tokens = np.concatenate((self.ids, ids))[ranges(where[which], per)]
        total = np.bincount(row, weights=per, minlength=rows).astype(np.int64)
        if self.remembered:
            self._remember(distinct[~hit], ids, length)
        return tokens, np.concatenate(([0], np.cumsum(total)))

    def _encode_parts(self, buf: np.ndarray, gap: np.ndarray, us: np.ndarray, ue: np.ndarray, ul: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts from ``us`` to ``ue`` (``ul``: a blank goes before), in their order, and how many each has."""
        if not len(us):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.blanks:  # parts that are one word of Latin letters, hence one pre-token
            word = _LETTER[buf] | (buf == 0xC3)
            word[1:] |= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
            other = np.concatenate(([0], np.cumsum(~word, dtype=np.int32)))
            ul = (other[ue] == other[us]) & (ue > us)
        held = np.concatenate(([0], np.cumsum(gap | (buf == 1), dtype=np.int32)))
        alone = held[ue] > held[us]
        if self.mark is None:
            alone |= ~ul
        spare = b" " if self.blanks else b""
        single = np.flatnonzero(alone).tolist()
        out_ids, out_n, order = [], [], []
        for lead, group in ((b" ", np.flatnonzero(~alone & ul)), (b"\n" if self.blanks else _MARK, np.flatnonzero(~alone & ~ul))):
            if not len(group):
                continue
            k = len(lead)
            size = ue[group] - us[group]
            place = np.cumsum(size + k) - size
            big = np.empty(int(place[-1] + size[-1]), np.uint8)
            big[ranges(place, size)] = buf[ranges(us[group], size)]
            for j in range(k):
                big[place - k + j] = lead[j]
            whole = big.tobytes()
            firsts = np.arange(0, len(group), _GROUP)
            begin = place[firsts] - (k if lead == b" " else 0)
            stop = np.append((place + size)[firsts[1:] - 1], len(whole))
            sizes = np.diff(np.append(firsts, len(group))).tolist()
            joined = [whole[a:b] for a, b in zip(begin.tolist(), stop.tolist())]
            ids, length, failed = self._together(joined, sizes, lead == b" ")
            redo = [i for g in failed for i in range(g * _GROUP, g * _GROUP + sizes[g])]
            if redo:
                keep = np.ones(len(group), bool)
                keep[redo] = False
                single += group[redo].tolist()
                group, length = group[keep], length[keep]
            out_ids.append(ids)
            out_n.append(length)
            order.append(group)
        if single:
            raw = buf.tobytes()
            words = []
            for i in single:
                words.append(((spare if ul[i] else b"") + raw[us[i] : ue[i]]).decode("utf-8", "replace"))
            got = self._plain(words)
            out_ids += got
            out_n.append(np.array([len(g) for g in got], np.int64))
            order.append(np.asarray(single, np.int64))
        ids = np.concatenate(out_ids)
        length, order = np.concatenate(out_n), np.concatenate(order)
        first = np.empty(len(order), np.int64)
        count = np.empty(len(order), np.int64)
        first[order] = np.cumsum(length) - length
        count[order] = length
        return ids[ranges(first, count)], count


def part_tokenizer(path: str) -> PartTokenizer:
    """The worker's tokenizer of a vocabulary file, loaded once for its tasks (``tidy`` with ``keep``) until others follow."""
    file = os.stat(path)
    return kept((path, file.st_mtime_ns, file.st_size), lambda: PartTokenizer(path))


def encode_column(tok: PartTokenizer, column: pa.Array, end_id: int | None):
    """Runs of rows as (first row, end row, ids, offsets); ``end_id`` is put after each text."""
    for lo, hi, buf, off in text_slices(column, TOKEN_SLICE):
        ids, at = tok.encode(buf, off)
        if end_id is not None:
            ids = np.insert(ids, at[1:], np.uint32(end_id))
            at = at + np.arange(len(at))
        yield lo, hi, ids, at
