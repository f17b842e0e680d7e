"""Byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick pass over the reversed bytes gives the longest token that starts at every position. The
encoder takes it, and keeps it only if a table of compatible pairs says that merging would leave the border
to the token before it in place; otherwise it tries the next shorter token, and steps back when none is left.
A position that failed once is never entered again, so the work is linear in the length, also for one
enormous word. The result equals that of applying the merges in order of rank.

Words repeat, so their ids are remembered in a table of bounded size; pairs likewise.

Null texts count as empty; whole texts are encoded; repeated rows are encoded each on their own; an empty
table gives an empty result; only the id and the text are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts

#: Fixed value: the published split pattern of this vocabulary. White space is spelt out as the Unicode property.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Entries after which a table of remembered words or pairs starts anew.
MEMO_LIMIT = 1_500_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 as itself, the rest from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(rest)}


#: The same pattern for texts within Latin-1, where letters, numbers and white space are few.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
_LATIN_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
).findall


class _Words(dict):
    """Ids of words seen before, as a decimal string and packed; emptied when full. Very long words are not kept."""

    def __init__(self, owner: Codec):
        self.owner = owner

    def __missing__(self, word: str) -> tuple[str, bytes]:
        c = self.owner
        ids = c.encode_word(word.encode("utf-8", "surrogatepass"))
        if len(self) >= MEMO_LIMIT:
            self.clear()
        if len(c.compatible) >= MEMO_LIMIT:
            c.compatible.clear()
        got = (",".join([c.decimal[i] for i in ids]), b"".join([c.packed[i] for i in ids]))
        if len(word) <= 64:
            self[word] = got
        return got


class Codec:
    """A byte-level vocabulary read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for t, i in ids.items():
            self.tokens[i] = t
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        #: rank of the merge that makes a token (-1 for single bytes), its two parts, and pairs by rank
        self.rank = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merges: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = ids[raw(a)], ids[raw(b)]
            whole = ids[raw(a) + raw(b)]
            self.merges.setdefault((left, right), n)
            if self.parts[whole] is None:
                self.rank[whole], self.parts[whole] = n, (left, right)
        self.longest = ahocorasick.Automaton()
        for t, i in ids.items():
            self.longest.add_word(t[::-1].decode("latin-1"), i)
        self.longest.make_automaton()
        self.shorter = self._shorter(ids, size)
        self.lengths = [len(t) for t in self.tokens]
        self.compatible: dict[tuple[int, int], bool] = {}
        self.decimal = [str(i) for i in range(size)]
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.words = _Words(self)
        self.split = regex.compile(WORDS).findall
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])]).astype(np.int64)

    @staticmethod
    def _shorter(ids: dict[bytes, int], size: int) -> list[int]:
        """For every token the longest token that is a proper prefix of it, or -1."""
        out = [-1] * size
        for t, i in ids.items():
            for end in range(len(t) - 1, 0, -1):
                if (p := ids.get(t[:end])) is not None:
                    out[i] = p
                    break
        return out

    def _border_holds(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens would end with the border between them intact.

        Unmake the tokens merge by merge, the latest first. At each moment the two pieces that touch at the
        border could have merged instead; if that merge ranks before the one just unmade (on the left, or at
        the same place: the leftmost goes first), it would have happened first and crossed the border.
        """
        rank, parts, merges = self.rank, self.parts, self.merges
        # (rank, side) of the latest unmade merge; side 0 for the left piece, 1 for the right
        limit = (len(self.tokens) + len(merges), 1)
        while True:
            crossing = merges.get((left, right))
            # a crossing pair stands left of merges inside the right token and right of those inside the left
            if crossing is not None and (crossing, 0.5) < limit:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit = (a, 0)
                left = parts[left][1]
            else:
                limit = (b, 1)
                right = parts[right][0]

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        best = [0] * n
        for end, i in self.longest.iter(word[::-1].decode("latin-1")):
            # all matches that end here start at the same place of the word; the longest comes first
            if not best[n - 1 - end]:
                best[n - 1 - end] = i + 1
        if best[0] and self.lengths[best[0] - 1] == n:
            return [best[0] - 1]
        out: list[int] = []
        open_at = bytearray(b"\x01") * (n + 1)
        compatible, lengths, shorter = self.compatible, self.lengths, self.shorter
        pos, token = 0, best[0] - 1
        while pos < n:
            while True:
                end = pos + lengths[token]
                if open_at[end]:
                    if not out:
                        break
                    pair = (out[-1], token)
                    holds = compatible.get(pair)
                    if holds is None:
                        holds = compatible[pair] = self._border_holds(*pair)
                    if holds:
                        break
                token = shorter[token]
                if token < 0:
                    break
            if token >= 0:
                out.append(token)
                pos = end
                if pos < n:
                    token = best[pos] - 1
            else:
                open_at[pos] = 0
                token = out.pop()
                pos -= lengths[token]
        return out

    def _segments(self, text: str):
        """Plain stretches, and the ids of special tokens between them."""
        at = 0
        for m in self.specials.finditer(text):
            yield text[at : m.start()], self.special[m[0]]
            at = m.end()
        yield text[at:], None

    def _words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split(text)
        return _LATIN_WORDS(text)

    def encode_parts(self, text: str) -> tuple[list[str], list[bytes]]:
        """Ids as decimal strings and as little-endian words, in pieces."""
        known = self.words.__getitem__
        if self.specials is None or not self.specials.search(text):
            got = list(map(known, self._words(text)))
        else:
            got = []
            for plain, special in self._segments(text):
                got += map(known, self._words(plain))
                if special is not None:
                    got.append((str(special), self.packed[special]))
        return [g[0] for g in got], [g[1] for g in got]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode_parts(text)[1]), "<u4").tolist()

    def decode_bytes(self, ids) -> bytes:
        """Copy the stretch of every id out of one block of bytes."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        shift = np.repeat(starts - (ends - sizes), sizes)
        return self.blob[np.arange(int(ends[-1])) + shift].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker process; it is read there, never shipped."""
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and token ids of every whole text."""

    def make():
        c = codec(path)
        return lambda ids, texts: [ids, [c.encode(t) for t in texts]]

    return map_texts(docs, make, "doc_id long, ids array<int>")


def bpe_rows(docs: DataFrame, path: str) -> DataFrame:
    """The digest rows of the query: encode, hash, decode, hash."""

    def make():
        c = codec(path)

        def rows(ids, texts):
            n, encoded, decoded = [], [], []
            for t in texts:
                strings, packed = c.encode_parts(t)
                tokens = np.frombuffer(b"".join(packed), "<u4")
                n.append(len(tokens))
                encoded.append(hashlib.sha256(",".join(strings).encode()).hexdigest())
                back = c.decode_bytes(tokens).decode("utf-8", "replace").encode()
                decoded.append(hashlib.sha256(back).hexdigest())
            return [ids, n, encoded, decoded]

        return rows

    return map_texts(docs, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
