"""Whole-text token ids of a public byte-level BPE tokenizer, packed as little-endian uint32.

The ids are those of tokenizers.Tokenizer.encode(text, add_special_tokens=False). Its pre-tokenizer
never joins a non-space character to white space that follows, nor letters, digits and marks to
each other but for one leading space (and 's, 'll and the like). Whole columns are cut there into
units by the classes of their bytes; Arrow finds the distinct units of a few MB of texts, and only
those are looked up or encoded. A text that holds the string of an added token (which the library
cuts out first), or a space between white space, goes through encode() on its own.
"""

from __future__ import annotations

import os
import re
import string
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

#: A split space whose neighbours on both sides are white space (or the end) is no unit start.
_RUNS = re.compile(r"\s (?!\S)")
#: White space as the tokenizer's regex has it: U+001C to U+001F are not in it.
_UNITS = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: ASCII marks. A letter and a mark that follows are never one token, and marks up to a unit's end are one pre-token.
_MARKS = string.punctuation
#: A line feed between characters that are no white space is a pre-token of its own.
_LINES = re.compile(r" ?\S+(?:\n\S+)+")
#: Letters only (Latin blocks), so one pre-token, which the model may be given directly.
_WORD = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")
#: Bounds the memory of one worker's memo of units; beyond it units are encoded each time.
MEMO_UNITS = 300_000
LONGEST_MEMO = 64
#: Bytes of text (one text at least) whose distinct units are found at a time.
CHUNK = 4 << 20
#: New words that the model takes as one string, and such strings at a time.
WORDS = 64
#: Classes of bytes; all else (0) is cut nowhere but before spaces.
_LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _FEED, _OTHER_SPACE = range(1, 8)
_SOLID = range(_LETTER, _QUOTE + 1)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


_BIG = sys.byteorder == "big"


def packed(ids: list[int]) -> bytes:
    """Little-endian uint32."""
    out = array("I", ids)
    if _BIG:
        out.byteswap()
    return out.tobytes()


class _Units(dict):
    """Unit -> ids, filled as units are asked for."""

    def __init__(self, owner: UnitEncoder) -> None:
        self.owner = owner

    def __missing__(self, key: str) -> bytes:
        owner = self.owner
        word = key[1:] if key[:1] == " " else key
        if word.isascii() and word.isalpha():
            ids = packed([t.id for t in owner.tokenize(key.replace(" ", owner.space))])
        elif _WORD.fullmatch(key):
            ids = packed([t.id for t in owner.tokenize(key.encode().decode("latin-1").translate(owner.letters))])
        elif owner.has_added(key):
            ids = packed(owner.tokenizer.encode(key, add_special_tokens=False).ids)
        elif "\n" in key and _LINES.fullmatch(key):
            head, *lines = key.split("\n")
            ids = owner.line_feed.join([self[head], *map(self.__getitem__, lines)])
        elif (core := key.rstrip(_MARKS)) != key and core[-1:].isalpha():
            ids = self[core] + self[key[len(core) :]]
        else:
            ids = packed(owner.tokenizer.encode(key, add_special_tokens=False).ids)
        if len(self) < MEMO_UNITS and len(key) <= LONGEST_MEMO:
            self[key] = ids
        return ids


def _classes() -> tuple[bytes, bytes]:
    """Byte -> class; and 8 * left + right class -> 1 where pre-tokens always end between the two."""
    kind, cuts = bytearray(256), bytearray(256)
    for chars, c in ((string.ascii_letters, _LETTER), (string.digits, _DIGIT), (_MARKS, _MARK), ("'", _QUOTE), (" ", _SPACE), ("\n", _FEED), ("\t\v\f\r", _OTHER_SPACE)):
        for char in chars:
            kind[ord(char)] = c
    ends = [(_LETTER, _DIGIT), (_DIGIT, _LETTER), (_MARK, _LETTER), (_MARK, _DIGIT)]
    ends += [(left, right) for left in (_LETTER, _DIGIT) for right in (_MARK, _QUOTE)]
    ends += [(left, _SPACE) for left in range(8)] + [(left, _FEED) for left in _SOLID]
    for left, right in ends:
        cuts[8 * left + right] = 1
    return bytes(kind), bytes(cuts)


class UnitEncoder:
    """Encodes texts to bytes (4 a token), or columns of texts to arrays of ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.added_texts, self.longest_added = added, max(map(len, added), default=0)
        #: Takes one pre-token in the byte-level alphabet.
        self.tokenize, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        # The model alone, for words with a byte between them that UTF-8 never has and that is in no merge.
        gap = self.letters[0xFF]
        self.words, self.joining = Tokenizer(self.tokenizer.model), self.letters | {ord("\n"): gap}
        self.between = self.tokenizer.model.token_to_id(gap) if [t for t in self.tokenizer.get_vocab(False) if gap in t] == [gap] else None
        self.plain, self.space = _Units(self), self.letters[ord(" ")]
        self.line_feed = self.plain["\n"]
        self.kind, self.cuts = _classes()

    def has_added(self, text: str) -> bool:
        return self.added is not None and self.added.search(text) is not None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.has_added(text):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if _RUNS.search(text):
            return b"".join(map(self.plain.__getitem__, _UNITS.findall(text)))
        head, *rest = text.split(" ")
        return self.plain[head] + b"".join([self.plain[" " + unit] for unit in rest])

    def _modelled(self, words: list[str]) -> list[bytes]:
        """The ids of words, which the model takes many at a time: no merge reaches over the byte between them."""
        import numpy as np

        ids: list[int] = []
        for at in range(0, len(words), WORDS * WORDS):
            lines = ["\n".join(words[k : min(k + WORDS, at + WORDS * WORDS)]) for k in range(at, min(at + WORDS * WORDS, len(words)), WORDS)]
            lines = [line.encode().decode("latin-1").translate(self.joining) for line in lines]
            for line in self.words.encode_batch_fast(lines, add_special_tokens=False):
                ids += line.ids
                ids.append(self.between)
        flat = np.array(ids, "<u4")
        ends, out = (4 * np.flatnonzero(flat == self.between)).tolist(), flat.tobytes()
        return [out[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]

    def _looked_up(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units, from the memo where they are in it."""
        memo = self.plain
        parts = list(map(memo.get, units))
        new = [k for k, ids in enumerate(parts) if ids is None]
        words = [k for k in new if _WORD.fullmatch(units[k])] if self.between is not None else []
        for k, ids in zip(words, self._modelled([units[k] for k in words])):
            parts[k] = ids
            if len(memo) < MEMO_UNITS and len(units[k]) <= LONGEST_MEMO:
                memo[units[k]] = ids
        for k in new:
            if parts[k] is None:
                parts[k] = memo[units[k]]
        return parts

    def _cut(self, texts):
        """The starts of the units of a string array without nulls, counted from its first byte, and for each text its first byte, whether encode() has to take it."""
        import numpy as np
        import pyarrow.compute as pc

        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        low, ends = ends[0], ends - ends[0]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[low : low + ends[-1]]
        kind = np.frombuffer(bytearray(data).translate(self.kind), np.uint8)
        lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8))  # U+00C0 to U+023F, letters but for two
        lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]
        kind[lead] = kind[lead + 1] = _LETTER
        start = np.zeros(len(data) + 1, bool)
        start[1:-1] = np.frombuffer((8 * kind[:-1] + kind[1:]).tobytes().translate(self.cuts), bool)
        feed = np.flatnonzero(kind == _FEED)
        feed = feed[(feed > 0) & (feed + 1 < len(kind))]
        solid = (kind >= _SOLID[0]) & (kind <= _SOLID[-1])
        start[feed[solid[feed - 1] & solid[feed + 1]] + 1] = True
        start[ends] = True  # text starts, and the end of all
        last = np.zeros(len(data), bool)
        last[ends[1:][np.diff(ends) > 0] - 1] = True
        space = np.flatnonzero(kind == _SPACE)
        space = space[(space > 0) & (last[space] | ~solid[np.minimum(space + 1, len(kind) - 1)])]
        alone = np.zeros(len(texts), bool)
        alone[np.searchsorted(ends, space[~solid[space - 1]], "right") - 1] = True
        for added in self.added_texts:
            alone |= pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
        return np.flatnonzero(start).astype(np.int32), data, ends, alone

    def encode_column(self, texts, end_id: int):
        """(ids, ends) of a string array: the ids of its texts one after the other, each text's followed by end_id,
        and where each text ends. Null texts count as empty."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.cast(pa.string()).fill_null("")
        starts, data, ends, alone = self._cut(texts)
        own = [self.encode(t) for t in texts.filter(pa.array(alone)).to_pylist()]
        if own:
            starts, data, ends, _ = self._cut(pc.if_else(pa.array(alone), "", texts))
        units = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        # Behind the units: those of texts taken alone, and the end of a text.
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist() makes an Arrow scalar of each
        parts = [*self._looked_up(distinct), *own, packed([end_id])]
        sizes = np.fromiter(map(len, parts), np.int32, len(parts)) // 4
        store, behind = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes, dtype=np.int32)
        extra = np.full(len(texts) + len(own), len(parts) - 1)
        closing = np.arange(len(texts)) + np.cumsum(alone)
        extra[closing[alone] - 1] = np.arange(len(own)) + len(distinct)
        last = np.searchsorted(starts, ends[1:])
        which = np.insert(units.indices.to_numpy(), np.repeat(last, 1 + alone), extra)
        many = sizes[which]
        done = np.cumsum(many, dtype=np.int32)
        ids = store[np.repeat(behind[which] - done, many) + np.arange(done[-1], dtype=np.int32)]
        return ids, done[last + closing]

    def encode_chunks(self, texts, end_id: int) -> Iterator:
        """encode_column() of slices of some CHUNK bytes: (first text, ids, ends)."""
        import numpy as np
        import pyarrow.compute as pc

        behind = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            before = behind[at - 1] if at else 0
            to = max(int(np.searchsorted(behind, before + CHUNK, "right")), at + 1)
            yield at, *self.encode_column(texts.slice(at, to - at), end_id)
            at = to


@lru_cache(maxsize=4)
def encoder(path: str) -> UnitEncoder:
    """One per worker process."""
    return UnitEncoder(path)
