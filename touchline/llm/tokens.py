"""Token ids of whole texts by the public tokenizers, memoised by word.

Each encoder cuts a text where its tokenizer can't join tokens across the cut,
looks the pieces up in a bounded memo and encodes only new pieces. The ids are
those of encoding the text at once (tests compare the two); a text whose
blanks don't allow safe cuts is encoded at once. A column of texts goes through
the byte-level encoder without a memo: each different piece is encoded once.
"""

from __future__ import annotations

import codecs
import os
import sys
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute

from touchline.llm.common import only

#: A memo is emptied beyond so many pieces; longer pieces aren't kept.
MEMO, LONGEST = 1_000_000, 64
#: Bytes of different pieces that are given to the tokenizer at once.
SLICE = 1 << 18
#: ASCII marks that end a word: all but the apostrophe, which may start a token with letters.
MARK = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.marks = {c: self.raw(c) for c in ",."}
        self.memo: dict[str, bytes] = {}

    def raw(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def learn(self, stems: list[str]) -> list[bytes]:
        return [packed(e.ids) for e in self.batch(stems, add_special_tokens=False)]

    def stem(self, piece: str) -> tuple[str, bytes]:
        """A piece without the one comma or stop that ends it after a letter,
        and that mark's ids: no token holds letters and other marks."""
        if piece[-1:] in self.marks and piece[-2:-1].lower().isalpha():
            return piece[:-1], self.marks[piece[-1]]
        return piece, b""

    def apart(self, piece: str) -> bool:
        """Whether the tokenizer joins nothing across the ends of a piece."""
        raise NotImplementedError

    def joined(self, pieces: list[str]) -> bytes | None:
        """The ids of pieces, None if one isn't apart. The memo holds only
        pieces that are, so only new ones are looked at."""
        memo = self.memo
        got = list(map(memo.get, pieces))
        try:
            return b"".join(got)
        except TypeError:  # None: some pieces are new
            at = [i for i, x in enumerate(got) if x is None]
        stems = {p: self.stem(p) for p in {pieces[i] for i in at}}
        if not all(map(self.apart, stems)):
            return None
        new = list({s for s, _ in stems.values() if s not in memo})
        known = dict(zip(new, self.learn(new), strict=True)) if new else {}
        known |= {p: (known[s] if s in known else memo[s]) + end for p, (s, end) in stems.items()}
        for i in at:
            got[i] = known[pieces[i]]
        if len(memo) > MEMO:
            memo.clear()
        memo.update({p: v for p, v in known.items() if len(p) <= LONGEST})
        return b"".join(got)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        return self.raw(text)

    def many(self, texts: list[str]) -> list[bytes]:
        return list(map(self.ids, texts))

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column (null: empty)."""
        yield from self.many([t or "" for t in texts.to_pylist()])


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def byte_letters() -> str:
    """The letters that byte-level vocabularies write the 256 bytes with."""
    same = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(b if b in same else next(other)) for b in range(256))


def latin(data: np.ndarray) -> np.ndarray:
    """Whether bytes of UTF-8 belong to letters of ASCII, Latin-1 or Latin
    Extended-A. The last bytes of the signs of multiplication and division
    don't count, whatever stands before them."""
    out = (data | 32) - np.uint8(97) < 26
    lead = data - np.uint8(0xC3) < 3
    out |= lead
    out[1:] |= lead[:-1] & (data[1:] != 0x97) & (data[1:] != 0xB7)
    return out


def spans(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the elements of a large string or binary array end, after a 0, and their bytes."""
    _, ends, data = pieces.buffers()
    at = np.frombuffer(ends, np.int64, len(pieces) + 1, pieces.offset * 8)
    return at - at[0], np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]) if at[-1] > at[0] else np.empty(0, np.uint8)


class Words(Encoder):
    """For a tokenizer that drops blanks and case: cuts at spaces and line ends."""

    def stem(self, piece: str) -> tuple[str, bytes]:
        stem, end = super().stem(piece)
        return (stem.lower() if stem.isascii() else stem), end

    def apart(self, piece: str) -> bool:
        return "<|" not in piece

    def ids(self, text: str) -> bytes:
        found = self.joined(text.replace("\n", " ").split(" "))
        return self.raw(text) if found is None else found


class Bytes(Encoder):
    """For a byte-level tokenizer whose tokens may start with one space: cuts
    before single spaces and around single line ends between other characters.
    A piece that starts with a line end stands for the two; others, but the
    first of a text, for a space and themselves."""

    @cached_property
    def begins(self) -> np.ndarray:
        """Whether a token starts with a space, for each id."""
        vocabulary = self.tokenizer.get_vocab()
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        # byte-level vocabularies write the space as this letter
        out[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        return out

    def learn(self, stems: list[str]) -> list[bytes]:
        out = dict.fromkeys(stems, b"")
        # pieces after a space: encoded in one text, where each starts with a token that has the space
        spaced = [p for p in stems if p[0] not in "\n\x00"]
        if spaced:
            ids = np.array(self.batch([" " + " ".join(spaced)], add_special_tokens=False)[0].ids, "<u4")
            at = (np.flatnonzero(self.begins[ids]) * 4).tolist()
            if len(at) == len(spaced) and at[0] == 0:
                data = ids.tobytes()
                out.update((p, data[a:b]) for p, a, b in zip(spaced, at, [*at[1:], len(data)], strict=True))
            else:  # a vocabulary that doesn't mark spaces so
                out.update(zip(spaced, super().learn([" " + p for p in spaced]), strict=True))
        first = [p for p in stems if p[0] in "\n\x00"]
        if first:
            line = self.raw("\n")
            out.update((p, line + v if p[0] == "\n" else v) for p, v in zip(first, self.lines([p[1:] for p in first], line), strict=True))
        return list(out.values())

    def lines(self, words: list[str], line: bytes) -> list[bytes]:
        """The ids of words that begin a line: encoded in one text, a line each."""
        data = self.raw("\n" + "\n".join(words))
        at = (np.flatnonzero(np.frombuffer(data, "<u4") == np.frombuffer(line, "<u4")[0]) * 4).tolist()
        if len(line) != 4 or len(at) != len(words) or at[0]:
            return super().learn(words)
        return [data[a + 4 : b] for a, b in zip(at, [*at[1:], len(data)], strict=True)]

    def apart(self, piece: str) -> bool:
        own = piece[1:] if piece[:1] in ("\n", "\x00") else piece
        return own.split() == [own] and "<|" not in own

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; what is new in any of them is encoded at once."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        cut = [("\x00" + t).replace("\n", " \n").split(" ") if t and "\x00" not in t else None for t in texts]
        new = set(chain.from_iterable(filter(None, cut))).difference(memo)
        bad = self.together(new)
        new -= bad
        stems = {p: self.stem(p) for p in new if p[-1] in ",."}
        asked = list((new - stems.keys()).union(s for s, _ in stems.values() if s not in memo))
        if asked:
            memo.update(zip(asked, self.learn(asked), strict=True))
        memo.update({p: memo[s] + end for p, (s, end) in stems.items() if end})
        out = [self.raw(t) if own is None or bad and not bad.isdisjoint(own) else b"".join(map(memo.__getitem__, own)) for t, own in zip(texts, cut, strict=True)]
        for p in [p for p in chain(new, asked) if len(p) > LONGEST]:
            memo.pop(p, None)
        return out

    @cached_property
    def starts(self) -> np.ndarray:
        """Whether a token starts with a space or is a line end, for each id."""
        out, line = self.begins.copy(), np.frombuffer(self.raw("\n"), "<u4")
        out[line if len(line) == 1 else []] = True
        return out

    @cached_property
    def flat(self):
        """The tokenizer for lines that are each a space and letters, written
        in the vocabulary's letters; None if its words aren't cut so."""
        from tokenizers import Tokenizer, pre_tokenizers

        if self.tokenizer.normalizer is not None or not isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel):
            return None
        out = Tokenizer.from_str(self.tokenizer.to_str())
        out.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        return out

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column (null: empty).

        Pieces start with the space or line end they stand after, or with the
        marks after a word: parts of the column's own bytes. Each different one
        is encoded once, and ids are laid out by its number.
        """
        if not len(texts):
            return
        texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
        cut, ids, whole = self.laid(*spans(texts))
        for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            yield self.raw(texts[i].as_py()) if i in whole else ids[a:b].tobytes()

    def laid(self, bounds: np.ndarray, data: np.ndarray) -> tuple[list[int], np.ndarray, set[int]]:
        """Where the ids of each text end in the bytes of all ids, after a 0;
        those bytes; and the texts that must be encoded at once."""
        if not len(data):
            return [0] * len(bounds), data, set()
        letter, begin = latin(data), (data == 32) | (data == 10)
        after = np.flatnonzero(letter[:-1] & ~letter[1:] & ~begin[1:]) + 1
        begin[after[MARK[data[after]]]] = True
        begin[bounds[bounds < len(data)]] = True
        at = np.append(np.flatnonzero(begin), len(data))
        del letter, begin, after  # a byte or more for each of the text
        first = np.searchsorted(at, bounds)  # of each text's pieces
        pieces = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
        del at
        good = self.all_apart(pieces.dictionary)
        ends, ids = spans(self.encoded(pieces.dictionary, good).take(pieces.indices))
        hit = np.zeros(len(first), np.int64) if good.all() else np.append(0, np.cumsum(~good[pieces.indices.to_numpy()]))[first]
        return ends[first].tolist(), ids, set(np.flatnonzero(np.diff(hit)).tolist())

    def all_apart(self, pieces: pa.Array) -> np.ndarray:
        """Whether each piece is apart; looked at one by one only if one isn't."""
        ends, data = spans(pieces)
        spaced = np.isin(data[ends[:-1]], (32, 10))
        text = data.tobytes().decode()
        if "<|" not in text and not (spaced & (np.diff(ends) == 1)).any() and len("".join(text.split())) == len(text) - spaced.sum():
            return np.ones(len(pieces), bool)
        return np.array([self.apart(p[1:] if p[0] == " " else p) for p in pieces.to_pylist()], bool)

    def encoded(self, pieces: pa.Array, good: np.ndarray) -> pa.Array:
        """The ids of each piece (binary), of others than the good ones none."""
        ends, data = spans(pieces)
        lead, others = data[ends[:-1]], np.append(0, np.cumsum(~latin(data)))[ends]
        words = good & (lead == 32) & (np.diff(others) == 1) & (self.flat is not None)
        bare = good & ~np.isin(lead, (32, 10))
        order, ids, sizes = [np.flatnonzero(~good)], [], [np.zeros(np.count_nonzero(~good), np.int64)]
        for kind, chosen in (("words", words), ("other", good & ~words & ~bare), ("bare", bare)):
            order.append(np.flatnonzero(chosen))
            own = pieces.take(pa.array(order[-1]))
            ends = spans(own)[0] if len(own) else np.zeros(1, np.int64)
            cuts = np.unique([*np.searchsorted(ends, np.arange(0, ends[-1], SLICE)), len(own)]).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                got, n = self.in_one(own.slice(a, b - a), kind)
                ids.append(got)
                sizes.append(n)
        place = np.empty(len(pieces), np.int64)
        place[np.concatenate(order)] = np.arange(len(pieces))
        ends = np.append(0, np.cumsum(np.concatenate(sizes))) * 4
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate([*ids, np.empty(0, "<u4")]))]).take(pa.array(place))

    def in_one(self, pieces: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of a kind, encoded in one text where each starts
        with a token that shows it, and their numbers."""
        own = spans(pieces)[1].tobytes()
        if kind == "words":
            space = byte_letters()[32]
            text = codecs.charmap_decode(own, "strict", byte_letters())[0].replace(space, "\n" + space)
        else:  # bare pieces stand after line ends, which go again
            text = "\n" + "\n".join(pieces.to_pylist()) if kind == "bare" else own.decode()
        encode = getattr(self.flat, "encode_batch_fast", self.flat.encode_batch) if kind == "words" else self.batch
        ids = np.array(encode([text], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.starts[ids])
        if len(at) != len(pieces) or at[0]:  # a vocabulary that doesn't mark them so
            each = super().learn(pieces.to_pylist())
            return np.frombuffer(b"".join(each), "<u4"), np.array([len(e) // 4 for e in each], np.int64)
        sizes = np.diff(np.append(at, len(ids)))
        return (np.delete(ids, at), sizes - 1) if kind == "bare" else (ids, sizes)

    def together(self, pieces: set[str]) -> set[str]:
        """Those of the pieces that aren't apart; looked at one by one only if
        there are such."""
        own = [p[1:] if p[:1] in ("\n", "\x00") else p for p in pieces]
        text = " ".join(own)
        return set() if text.split() == own and "<|" not in text else {p for p in pieces if not self.apart(p)}


@lru_cache(maxsize=4)
def loaded(kind: str, path: str) -> Encoder:
    return {"words": Words, "bytes": Bytes, "plain": Encoder}[kind](path)


def encoder(kind: str, path: str) -> Encoder:
    """One encoder for each Python worker; asked for where a task begins."""
    found = loaded(kind, path)
    only(found.memo)
    return found
