"""Exact, cached encoding with a public tokenizer file.

A text is cut where the tokenizer's own splitting always cuts, so that each piece can be
encoded alone and remembered: for byte-level vocabularies before a single space that
stands between two characters that are not white space (the space belongs to the piece
that follows), for vocabularies that drop white space and case at each space. Words of plain
letters, apart from the stops and line ends that may follow, go to the library's model
without its costly normalizing and splitting, which leave them as they are; other pieces
go through the whole pipeline. Texts are cut and their different pieces found by Arrow, a
group at a time, so that each different piece is looked up once, and its ids are copied by
numpy to all its places. Whole texts get the ids that the library gives them in one call.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate, chain, compress, pairwise, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT = re.compile(r"(?<=\S) (?=\S)")
#: marks that end a word and form one part of their own with both vocabularies
STOPS = ".,;:!?"
#: stands for a line end between two characters that are not white space: a cut before and after
LINE = "\0"
#: a word of Latin-1 letters and the stops that may follow
PLAIN = f"[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[{STOPS}]*$"
AFTER_LINE = r"^\x00?"
#: how byte-level vocabularies write a space
SPACE = "\u0120"
SAMPLE = "Ab cd, ef.\nGh aéüñ XyZ: qu? Thathe!\nof theß. Éa ü, antandi"


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for
    themselves, the others follow from 256 in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


#: characters of the longest piece that is remembered beyond a group of texts
LONG = 64


class Table:
    """Ids of entries one after the other, and how many each has."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes = ids, sizes

    @classmethod
    def of(cls, entries: list[bytes]) -> Table:
        return cls(np.frombuffer(b"".join(entries), "<u4"), np.fromiter(map(len, entries), np.int64, len(entries)) // 4)

    def __add__(self, other: Table) -> Table:
        return Table(np.concatenate([self.ids, other.ids]), np.concatenate([self.sizes, other.sizes]))

    def joined(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries named, in that order, and where each ends."""
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        at = np.repeat((np.cumsum(self.sizes) - self.sizes)[codes] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.ids[at], ends

    def texts(self, codes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Ids of each run of entries; ``bounds`` says where runs begin, and where the last ends."""
        ids, ends = self.joined(codes)
        cuts = (4 * np.concatenate([[0], ends])[bounds]).tolist()
        raw = ids.tobytes()
        return [raw[a:z] for a, z in pairwise(cuts)]


class Memory:
    """A dict ``now`` of about ``keep`` entries and the ones that came before it; ``recall``
    brings entries still in use over, so that only unused ones are forgotten. Keys of more
    than LONG characters are dropped by the encoder after each group."""

    def __init__(self, keep: int):
        self.keep, self.now, self.before = keep, {}, {}

    def rotate(self) -> None:
        if len(self.now) > self.keep:
            self.now, self.before = {}, self.now

    def recall(self, keys: set) -> list:
        """Makes known keys present; the others are returned."""
        # a plain dict, as set.difference is fast for that type alone
        new = keys.difference(self.now)
        if not self.before:
            return list(new)
        before = self.before
        known = [k for k in new if k in before]
        self.now.update(zip(known, map(before.__getitem__, known), strict=True))
        return list(new.difference(known))


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.

    ``keep`` bounds the remembered pieces (twice that at most). They are of LONG characters
    at most, so an entry takes a few hundred bytes and all of them keep kB or less.
    """

    def __init__(self, path: str, spaces: bool, keep: int = 600_000, group_chars: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaces, self.keep, self.group_chars = spaces, keep, group_chars or min(6_000_000, 20 * keep)
        #: piece with its leading space (if ``spaces``) to ids; None: the piece can't stand alone
        self.inner: Memory = Memory(keep)
        self.first: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        #: words that no space precedes
        self.bare: dict[str, bytes] = {}
        self.letters = byte_letters()
        self.long = False
        self.simple = True
        self.simple = self([SAMPLE]) == self._encode([SAMPLE])
        self.inner = Memory(keep)
        self.first.clear()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        """Ids of words of letters (that follow a space each), by the model alone."""
        letters, lead = self.letters, SPACE if self.spaces else ""
        written = words
        if not "".join(words).isascii():
            written = [w if w.isascii() else w.encode().decode("latin-1").translate(letters) for w in words]
        tokenize = self.tokenizer.model.tokenize
        ids = [[t.id for t in tokenize(lead + w)] for w in written]
        ends = list(accumulate(map(len, ids), initial=0))
        raw = np.fromiter(chain.from_iterable(ids), "<u4", ends[-1]).tobytes()
        self.inner.now.update(zip(words, [raw[4 * a : 4 * z] for a, z in zip(ends, ends[1:], strict=False)], strict=True))

    def _tail(self, tail: str) -> bytes:
        """Ids of what follows a word without a space: stops, or a line end and a word."""
        if tail not in self.tails:
            self.tails[tail] = self._encode([tail])[0]
        return self.tails[tail]

    def _learn_after_lines(self, words: list[str]) -> None:
        """Ids of LINE + word of letters."""
        model, letters, end = self.tokenizer.model, self.letters, self._tail("\n")
        for w in words:
            core = w[1:]
            if core not in self.bare:
                got = model.tokenize(core if core.isascii() else core.encode().decode("latin-1").translate(letters))
                self.bare[core] = np.array([t.id for t in got], "<u4").tobytes()
            self.inner.now[w] = end + self.bare[core]

    def _learn_plain(self, words: list[str]) -> None:
        after = [w for w in words if w[0] == LINE]
        if after:
            words = [w for w in words if w[0] != LINE]
            self._learn_after_lines(after)
        self._learn_words(words)

    def _learn_others(self, pieces: list[str]) -> None:
        """Ids by the whole pipeline; None for pieces that can't stand alone."""
        lead = ""
        if self.spaces:
            lead = " "
            alone = [p for p in pieces if p and p != LINE and not p[0].isspace() and not p[-1].isspace()]
            self.inner.now.update(dict.fromkeys(pieces))
            after = [p for p in alone if p[0] == LINE]
            pieces = [p for p in alone if p[0] != LINE]
            self.inner.now.update(zip(after, self._encode(["\n" + p[1:] for p in after]), strict=True))
        self.inner.now.update(zip(pieces, self._encode([lead + p for p in pieces]), strict=True))

    @staticmethod
    def _plainer(text: str) -> str:
        """Fewer different pieces, same ids, for a vocabulary that drops white space and case.

        Only texts without combining marks (here: Latin-1) may be lower-cased beforehand.
        """
        try:
            text = text.encode("latin-1").lower().decode("latin-1")
        except UnicodeEncodeError:
            pass
        return text.replace("\n", " ").replace("\t", " ")

    def _known(self, pieces: list[str], learn: Callable[[list[str]], None]) -> list[bytes | None]:
        """Ids of different pieces, each looked up once; the missing ones are learned together."""
        found = list(map(self.inner.now.get, pieces, repeat(0)))
        gaps = list(compress(range(len(pieces)), map(is_, found, repeat(0))))
        if gaps:
            missing = [pieces[i] for i in gaps]
            self.long = self.long or max(map(len, missing)) > LONG
            learn(self.inner.recall(set(missing)))
            for i, ids in zip(gaps, map(self.inner.now.__getitem__, missing), strict=True):
                found[i] = ids
        return found

    def _pieces(self, words: pa.Array, used: np.ndarray) -> tuple[Table, np.ndarray]:
        """Ids of the different pieces in use, and which of them can't stand alone.

        Words of letters are looked up without the stops that follow them.
        """
        plain = np.zeros(len(words), bool)
        if self.simple:
            plain = pc.match_substring_regex(words, AFTER_LINE + PLAIN if self.spaces else "^" + PLAIN).to_numpy(zero_copy_only=False) & used
        stopped = words.filter(pa.array(plain))
        roots = pc.utf8_rtrim(stopped, STOPS)
        # stops are of one byte each
        ends = pc.subtract(pc.binary_length(stopped), pc.binary_length(roots)).to_numpy().astype(np.int64)
        roots = (roots if self.spaces else pc.utf8_lower(roots)).dictionary_encode()
        cores = self._known(roots.dictionary.to_pylist(), self._learn_plain)
        tails, tail_of = [b""], np.zeros(len(stopped), np.int64)
        for n in np.unique(ends[ends > 0]).tolist():
            at = np.flatnonzero(ends == n)
            marks = pc.utf8_slice_codeunits(stopped.take(pa.array(at)), start=-n).dictionary_encode()
            tail_of[at] = len(tails) + marks.indices.to_numpy()
            tails += map(self._tail, marks.dictionary.to_pylist())
        others_at = np.flatnonzero(used & ~plain)
        others = self._known(words.take(pa.array(others_at)).to_pylist(), self._learn_others)
        # a piece is two parts: a core or another piece, and stops or nothing
        parts = Table.of([*tails, *cores, *(ids or b"" for ids in others)])
        codes = np.zeros((len(words), 2), np.int64)
        codes[plain, 0] = len(tails) + roots.indices.to_numpy()
        codes[plain, 1] = tail_of
        codes[others_at, 0] = len(tails) + len(cores) + np.arange(len(others))
        unfit = np.zeros(len(words), bool)
        unfit[others_at] = [ids is None for ids in others]
        ids, ends = parts.joined(codes.ravel())
        return Table(ids, np.diff(ends[1::2], prepend=0)), unfit

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        """Ids of the pieces of each list, which can stand alone, one after the other."""
        coded = pa.array(list(chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        table, _ = self._pieces(coded.dictionary, np.ones(len(coded.dictionary), bool))
        return table.texts(coded.indices.to_numpy(), np.cumsum([0, *map(len, split)]))

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, group, size = [], [], 0
        # nothing here forms cycles, and the collector would walk millions of entries
        collects = gc.isenabled()
        gc.disable()
        try:
            for t in texts:
                group.append(t)
                size += len(t)
                if size > self.group_chars:
                    out += self._group(group)
                    group, size = [], 0
            return out + self._group(group)
        finally:
            if collects:
                gc.enable()

    def forget(self) -> None:
        """Drops all that is remembered."""
        self.inner = Memory(self.keep)
        self.first, self.tails, self.bare = {}, {}, {}

    def _group(self, texts: list[str]) -> list[bytes]:
        for held in (self.first, self.bare, self.tails):
            if len(held) > self.keep:
                held.clear()
        if self.long:
            for held in (self.inner.now, self.first, self.bare, self.tails):
                for k in [k for k in held if len(k) > LONG]:
                    del held[k]
            self.long = False
        self.inner.rotate()
        if not texts:
            return []
        lists = pc.split_pattern(pa.array([t.replace("\n", " " + LINE) if self.spaces else self._plainer(t) for t in texts], pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        words, codes, bounds = coded.dictionary, coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()
        inner, starts = np.ones(len(codes), bool), bounds[:-1]
        inner[starts] = not self.spaces
        used = np.zeros(len(words), bool)
        used[codes[inner]] = True
        table, unfit = self._pieces(words, used)
        if not self.spaces:
            return table.texts(codes, bounds)
        heads = words.take(pa.array(codes[starts])).to_pylist()
        self._learn_heads(heads)
        first = Table.of([self.first[h] for h in heads])
        codes[starts] = len(words) + np.arange(len(heads))
        unfit = np.logical_or.reduceat(np.concatenate([unfit, np.zeros(len(heads), bool)])[codes], starts)
        out = (table + first).texts(codes, bounds)
        # a null piece, or a head that ends in white space, is no place to cut
        cut = np.diff(bounds) > 1
        again = [i for i, (t, h) in enumerate(zip(texts, heads, strict=True)) if unfit[i] or cut[i] and not h[-1:].strip() or LINE in t]
        whole = [i for i in again if LINE in texts[i]]
        rest = [i for i in again if LINE not in texts[i]]
        for some, encode in ((whole, self._encode), (rest, self._carefully)):
            for i, ids in zip(some, encode([texts[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _learn_heads(self, heads: list[str]) -> None:
        new = list(set(heads).difference(self.first))
        self.long = self.long or max(map(len, new), default=0) > LONG
        self.first.update(zip(new, self._encode(new), strict=True))

    def _carefully(self, texts: list[str]) -> list[bytes]:
        """Cuts only at single spaces with no white space on either side; a last piece may end in some."""
        split = [CUT.split(t) for t in texts]
        heads = [p.pop(0) for p in split]
        ends = [" " + p.pop() if p and p[-1][-1].isspace() else "" for p in split]
        ids = self._ids(split)
        self._learn_heads(heads)
        return [self.first[h] + p + e for h, p, e in zip(heads, ids, self._encode(ends), strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str, spaces: bool, keep: int = 600_000) -> Encoder:
    """The encoder of this worker process, kept from task to task with up to 2 * keep pieces."""
    return Encoder(path, spaces, keep)
