"""Token ids of whole texts, by the tokenizers library, with the units of earlier texts remembered."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from .hashing import RUN_BYTES, StretchHasher, long_parts, row_runs

ODD_SPACE = re.compile(r"[^\S \n\t\r]")
#: Units that a worker remembers; about 70 MB.
REMEMBERED = 400_000


def _bytes_of(codes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(codes)] = True
    return out


SPACE = _bytes_of(b" \n\t\r")
LETTER = _bytes_of([*range(65, 91), *range(97, 123)])
#: The second bytes of the letters from U+00C0 to U+00FF.
LATIN = _bytes_of(set(range(0x80, 0xC0)) - {0x97, 0xB7})
#: ASCII signs but for the apostrophe, which may belong to a contraction.
SIGN = _bytes_of(set(range(33, 127)) - {39, *range(48, 58), *range(65, 91), *range(97, 123)})


def _odd_pairs() -> np.ndarray:
    """Pairs of bytes without which a text has neither a white space of another kind nor an added token."""
    out = np.zeros((256, 256), dtype=bool)
    out[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F], :] = True
    for a, b in ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80), (0x3C, 0x7C)):
        out[a, b] = True
    return out.reshape(-1)


ODD = _odd_pairs()


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable bytes stand for themselves, the others
    for the code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _piece_starts(raw: np.ndarray) -> np.ndarray:
    """Spaces behind other signs: no token of either vocabulary reaches over the edge before one."""
    space = SPACE[raw]
    out = space.copy()
    out[1:] &= ~space[:-1]
    return out


def _letters(raw: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters, and of those from U+00C0 to U+00FF."""
    out = LETTER[raw]
    pair = (raw[:-1] == 0xC3) & LATIN[raw[1:]]
    out[1:] |= pair
    out[:-1] |= pair
    return out


def _unit_starts(raw: np.ndarray, edges: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Where units begin: at a text's start, at the first of several spaces, behind a single line end, and at a sign
    behind a letter. No token reaches over these edges, and each unit has by itself the tokens that it has in its text."""
    space = SPACE[raw]
    before = np.ones(len(raw), dtype=bool)
    before[1:] = space[:-1]
    begins = edges[:-1][edges[:-1] < len(raw)]
    before[begins] = False
    out = space & ~before
    # a line end that is the only space before what follows
    single = (raw == 10) & ~before
    single[-1:] = False
    out[1:] |= single[:-1] & ~space[1:]
    out[1:] |= SIGN[raw[1:]] & letter[:-1]
    out[begins] = True
    return np.flatnonzero(out)


class TextEncoder:
    """Ids of ``Tokenizer.encode(text, add_special_tokens=False)``, for vocabularies of at most 2 ** 16 ids.

    Words repeat: units of texts are known again by two hashes of 64 bits. A new plain word goes straight to the library's
    BPE model, any other new unit through the whole tokenizer; a text with another kind of space, or with an added token
    of the vocabulary, goes to the library as it is.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any("<|" not in t for t in added):
            raise ValueError("added tokens of an unknown form")
        #: Such a vocabulary has words in lower case, without the space before them.
        self.ends_words = self.model.end_of_word_suffix is not None
        self.letters = _byte_letters()
        self._forget()
        self.hashers = StretchHasher(), StretchHasher(7, 0xD1342543DE82EF95)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint16)

    def _model_text(self, raw: np.ndarray, letter: np.ndarray) -> str:
        """The texts as the BPE model's words are written: a character for each byte."""
        if self.ends_words:
            upper = np.zeros(len(raw), dtype=bool)
            upper[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] < 0x9F)
            upper |= (raw >= 65) & (raw < 91)
            raw = np.where(upper & letter, raw + 32, raw).astype(np.uint8)
        return raw.tobytes().decode("latin-1").translate(self.letters)

    def _learn(self, raw: np.ndarray, letter: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: list[int], proofs: np.ndarray) -> None:
        if not keys:
            return
        written = self._model_text(raw, letter)
        spaced = raw[starts] == 32
        begin = starts + spaced
        sum_letters = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(letter)))
        plain = (sum_letters[ends] - sum_letters[begin] == ends - begin) & (ends > begin)
        if self.ends_words:
            starts = np.where(plain, begin, starts)
        tokenize, encode, ids, lengths = self.model.tokenize, self.tokenizer.encode, [], []
        for a, b, is_plain in zip(starts.tolist(), ends.tolist(), plain.tolist()):
            found = [t.id for t in tokenize(written[a:b])] if is_plain else encode(raw[a:b].tobytes().decode(), add_special_tokens=False).ids
            ids += found
            lengths.append(len(found))
        n = len(self.lengths)
        self.known.update(zip(keys, range(n, n + len(keys))))
        lengths = np.array(lengths, dtype=np.int64)
        self.begin = np.append(self.begin, len(self.ids) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.ids = np.append(self.ids, np.array(ids, dtype=np.uint16))
        self.proofs = np.append(self.proofs, proofs)

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.proofs = np.empty(0, dtype=np.uint16), np.empty(0, dtype=np.uint64)
        self.begin = self.lengths = np.empty(0, dtype=np.int64)

    def _plain(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and each text's borders among them."""
        if not len(raw):
            return np.empty(0, dtype=np.uint16), np.zeros(len(edges), dtype=np.int64)
        letter = _letters(raw)
        starts = _unit_starts(raw, edges, letter)
        ends = np.append(starts[1:], len(raw))
        h, check = (hasher.of(raw, starts, ends) for hasher in self.hashers)
        keys, first, place = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        unit = np.fromiter(map(self.known.get, keys.tolist(), repeat(-1)), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(unit < 0)
        unit[new] = np.arange(len(new)) + len(self.lengths)
        self._learn(raw, letter, starts[first[new]], ends[first[new]], keys[new].tolist(), check[first[new]])
        unit = unit[place]
        if (self.proofs[unit] != check).any():
            raise ValueError("two units of one hash")
        size = self.lengths[unit]
        done = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(size)))
        out = self.ids[np.repeat(self.begin[unit] - done[:-1], size) + np.arange(done[-1])]
        return out, done[np.searchsorted(starts, edges)]

    def runs(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of rows of a column of UTF-8 bytes: first row, row behind the last, ids, each row's borders among them."""
        for a, b, raw, edges in row_runs(column):
            pairs = (raw[:-1].astype(np.uint16) << 8) | raw[1:]
            odd = np.unique(np.searchsorted(edges, np.flatnonzero(ODD[pairs]), "right") - 1)
            if len(raw) and 0x0B <= raw[-1] <= 0x1F:
                odd = np.unique(np.append(odd, b - a - 1))
            whole = {}
            for i in odd.tolist():
                text = raw[edges[i] : edges[i + 1]].tobytes().decode()
                if "<|" in text or ODD_SPACE.search(text):
                    whole[i] = self._whole(text)
            if b == a + 1 and len(raw) > RUN_BYTES and not whole:
                ids = np.concatenate([self._plain(p, np.array([0, len(p)]))[0] for p in long_parts(raw, _piece_starts)])
                yield a, b, ids, np.array([0, len(ids)])
                continue
            parts, borders, at = [], [np.zeros(1, dtype=np.int64)], 0
            for i in [*whole, b - a]:
                if i > at:
                    ids, inner = self._plain(raw[edges[at] : edges[i]], edges[at : i + 1] - edges[at])
                    parts.append(ids)
                    borders.append(inner[1:] + borders[-1][-1])
                if i in whole:
                    parts.append(whole[i])
                    borders.append(borders[-1][-1:] + len(whole[i]))
                at = i + 1
            yield a, b, np.concatenate(parts), np.concatenate(borders)


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """A worker's encoder for the vocabulary file at ``path``, the same in its later tasks."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)
