"""Texts to token ids with a public tokenizer, one white-space piece at a time.

Both vocabularies used here tokenize a piece (white space and the characters after it, up to an ASCII mark that
follows a letter of Latin-1) the same way wherever it stands, so a bounded cache of pieces spares most calls of the
tokenizer.  A batch is cut into pieces and these are told apart by array operations on its bytes; Python itself handles
only the distinct pieces.  Those new to a worker are mostly plain words.  Where the specification's normalizer only puts
these in lower case and its pattern takes each whole, its model gets them by the thousand, as one text cut at spaces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import repeat

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from .common import kept

#: Bytes of pieces and their ids that a worker remembers before it drops those that recur least; each costs ``_ENTRY`` more
#: for its entry.
CACHE_BYTES, _ENTRY = 160 << 20, 190
#: Unicode's other White_Space in UTF-8, as the tokenizers' own patterns see it.
_WIDE = [chr(x).encode() for x in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE_CODES = np.array(sorted(int.from_bytes(x.ljust(3, b"\0"), "big") for x in _WIDE))

#: A plain word in UTF-8, with the white space before it: letters up to U+017F, which NFC leaves alone and whose lower case
#: is one letter each (not so that of U+0130).
_PLAIN = re.compile(
    rb"[\t-\r ]?(?:[A-Za-z]|\xc2[\xaa\xb5\xba]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+"
)
#: The normalizer and the pattern of specifications whose plain words are found so.
_LOWERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_TAKES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_byte = np.uint8  # bytes below the one taken off wrap around to large ones, so one comparison tells a range


def _is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space."""
    out = (data == 32) | (data - _byte(9) < 5)
    at = np.flatnonzero((data == 0xC2) | (data - _byte(0xE1) < 3))
    if len(at):
        code = [np.where(at + k < len(data), data[np.minimum(at + k, len(data) - 1)], 0).astype(np.int64) for k in (0, 1, 2)]
        two = code[0] == 0xC2
        found = np.isin(code[0] << 16 | code[1] << 8 | np.where(two, 0, code[2]), _WIDE_CODES)
        at, two = at[found], two[found]
        out[at], out[at + 1] = True, True
        out[at[~two] + 2] = True
    return out


def _pieces(texts: pa.Array, special: bytes = b"<|") -> tuple[pa.Array, np.ndarray]:
    """All texts' pieces as codes into a dictionary, and how many pieces each text has."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2] or pa.py_buffer(b"")
    data = np.frombuffer(buffer, np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    space = _is_space(data)
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    if not ((data[:-1] == special[0]) & (data[1:] == special[1])).any():  # a special token holds letters and marks
        letter = (data | _byte(32)) - _byte(97) < 26
        mark = (data - _byte(33) < 94) & ~letter & (data - _byte(48) >= 10)
        letter[1:] |= (data[:-1] == 0xC3) & ((data[1:] | _byte(0x20)) != 0xB7)  # U+00C0 to U+00FF but the signs of times and division
        starts[1:] |= letter[:-1] & mark[1:]
    starts[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    first = np.flatnonzero(starts)
    ends = np.append(first, len(data)).astype(np.int64)
    cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return cut.dictionary_encode(), np.diff(np.searchsorted(first, bounds))


def _words_of(tokenizer: Tokenizer) -> tuple[Tokenizer, np.ndarray] | None:
    """A tokenizer of plain words between spaces with the same model, and which ids end a word; None if ``tokenizer``
    treats plain words in another way."""
    model, lowers, takes = tokenizer.model, tokenizer.normalizer, tokenizer.pre_tokenizer
    if lowers is None or takes is None or not getattr(model, "end_of_word_suffix", None) or model.dropout:
        return None
    lowers, takes = (json.loads(x.__getstate__()) for x in (lowers, takes))
    split, *after = takes.get("pretokenizers", [{}])
    whole = {"type": "Split", "pattern": {"Regex": _TAKES}, "behavior": "Removed", "invert": True}
    in_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    if lowers.get("normalizers") != _LOWERS or split != whole or after != [in_bytes]:
        return None
    words = Tokenizer(model)
    words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = tokenizer.get_vocab()
    closes = np.zeros(max(vocabulary.values()) + 1, bool)
    closes[[i for token, i in vocabulary.items() if token.endswith(model.end_of_word_suffix)]] = True
    return words, closes


class PieceTokenizer:
    """Ids of texts; ``encode`` gives them as one array and where each text's ids end.

    It remembers ``most`` bytes of pieces and those of one call's texts beside them.
    """

    def __init__(self, spec: str, most: int = CACHE_BYTES):
        self.tokenizer, self.most = Tokenizer.from_str(spec), most
        self.words = _words_of(self.tokenizer)
        self.number: dict[bytes, int] = {}
        self.size, self.bytes = np.zeros(1 << 16, np.int64), 0
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0
        self.start = np.zeros(1 << 16, np.int64)
        self.hits = np.zeros(1 << 16, np.int64)  # in how many calls; halved whenever pieces are dropped

    def _trim(self) -> None:
        """Drops the pieces that recur least until the others take half of what may be remembered."""
        pieces = list(self.number)
        known = len(pieces)
        cost = np.fromiter(map(len, pieces), np.int64, known) + 4 * self.size[:known] + _ENTRY
        order = np.lexsort((-np.arange(known), -self.hits[:known]))  # of equals, the latest stay
        kept = np.sort(order[: np.searchsorted(np.cumsum(cost[order]), self.most // 2, "right")])
        sizes, ids = self.size[kept], self._ids_of(self.start[kept], self.size[kept])
        self.number = {pieces[i]: k for k, i in enumerate(kept.tolist())}
        self.ids[: len(ids)], self.used, self.bytes = ids, len(ids), int(cost[kept].sum())
        self.hits[: len(kept)] = self.hits[kept] >> 1
        self.size[: len(kept)], self.start[: len(kept)] = sizes, np.cumsum(sizes) - sizes

    def _ids_of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of some pieces, one after the other."""
        done = np.cumsum(size)
        return self.ids[np.repeat(start - (done - size), size) + np.arange(int(size.sum()))]

    @classmethod
    def get(cls, spec: str, most: int = CACHE_BYTES) -> PieceTokenizer:
        """The worker's own tokenizer for this specification; its cache outlives a task, until one of another operator."""
        key, loaded = (zlib.crc32(spec.encode()), most), kept("tokens")
        if key not in loaded:
            loaded[key] = cls(spec, most)
        return loaded[key]

    def _tokenize(self, pieces: list[bytes], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all these ids."""
        if plain:
            words, closes = self.words
            (found,) = words.encode_batch_fast([b" ".join(pieces).decode().lower()], add_special_tokens=False)
            flat = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(closes[flat])
            if len(ends) == len(pieces):  # not if the vocabulary lacks the end of a word
                return np.diff(ends, prepend=-1), flat
        found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))

    def _learn(self, pieces: list[bytes], plain: bool) -> None:
        """Tokenizes pieces, which are plain words or of any kind, and remembers them."""
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            sizes, flat = self._tokenize(part, plain)
            known = len(self.number)
            while known + len(part) > len(self.size):
                self.size, self.start, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.start, self.hits))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.size[known : known + len(part)], self.hits[known : known + len(part)] = sizes, 1
            self.start[known : known + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            self.number.update(zip(part, range(known, known + len(part)), strict=True))
            self.bytes += sum(map(len, part)) + 4 * len(flat) + _ENTRY * len(part)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i] : bounds[i + 1]], ``end_id`` after them if there is one.

        ``texts`` is an array of strings; null counts as empty.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        cut, per_text = _pieces(texts)
        distinct = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        self.hits[number[number >= 0]] += 1
        if self.bytes > self.most:
            self._trim()
            number = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            is_plain = [self.words is not None and _PLAIN.fullmatch(distinct[i]) is not None for i in new.tolist()]
            for plain in (False, True):
                kind = new[np.array(is_plain) == plain]
                number[kind] = len(self.number) + np.arange(len(kind))
                self._learn([distinct[i] for i in kind.tolist()], plain)
        # The ids of each distinct piece, then those of all pieces.
        size, start = self.size[number], self.start[number]
        done, ids = np.cumsum(size), self._ids_of(start, size)
        code, upto = cut.indices.to_numpy(), np.cumsum(per_text)
        if end_id is not None:  # a piece of its own after each text
            code = np.insert(code, upto, len(number))
            ids, done, upto = np.append(ids, np.uint32(end_id)), np.append(done, len(ids) + 1), upto + np.arange(1, len(upto) + 1)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, done).astype(np.int32)), pa.array(ids))
        found = lists.take(pa.array(code))
        return found.values.to_numpy(), found.offsets.to_numpy()[np.append(0, upto)].astype(np.int64)
