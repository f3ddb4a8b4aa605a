"""Byte-level BPE on a vocabulary file of the ``tokenizers`` format.

``ByteBPE`` holds what operators 1 and 7 share: the pre-token pattern, the merge loop over
a contiguous rank array, and a bounded memo per Python worker.  The vocabulary path is a
parameter; the file is read by each worker and never copied.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import regex

from lakeweft.llm.common import keeps

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this family.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more parts than this are merged with a heap, as rescanning would take the square of the length.
SHORT = 64
#: Pieces remembered per worker; the memo starts anew when it is full.
MEMO = 500_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabulary files, mapped back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_letters()
        to_bytes = lambda s: bytes(back[c] for c in s)
        vocab = {to_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.merge = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (to_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merge[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.pretokens = regex.compile(PRETOKEN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.vocab = vocab
        self._whole = None

    @property
    def whole(self) -> dict[bytes, int]:
        """Strings proved to encode alone as their own single token."""
        if self._whole is None:
            self._whole = {b: i for b, i in self.vocab.items() if self.merge_word(b) == [i]}
        return self._whole

    def merge_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token.

        Parts and the rank of each adjacent pair lie in two contiguous arrays; the smallest
        rank (leftmost of equals) goes first, its boundary is deleted and the two ranks
        beside it are refreshed.
        """
        parts = [self.single[b] for b in word]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        merge, none = self.merge, (1 << 60, -1)
        ranks = [merge.get(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best is none or best[1] < 0:
                break
            i = ranks.index(best)
            parts[i] = best[1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = merge.get((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = merge.get((parts[i - 1], parts[i]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order, by a heap of (rank, position) over a linked list."""
        n, merge = len(parts), self.merge
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, m[1], parts[i], parts[i + 1]) for i in range(n - 1) if (m := merge.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], right[i] = made, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
                if m := merge.get((made, parts[right[i]])):
                    heapq.heappush(heap, (m[0], i, m[1], made, parts[right[i]]))
            if left[i] >= 0 and (m := merge.get((parts[left[i]], made))):
                heapq.heappush(heap, (m[0], left[i], m[1], parts[left[i]], made))
        return [p for p in parts if p >= 0]

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings, which stand alone in the list."""
        if self.cut is None or not any(s in text for s in self.special):
            return [text] if text else []
        return [s for s in self.cut.split(text) if s]

    def pieces(self, text: str) -> list[str]:
        """Pieces whose tokens, put in a row, are those of a text without special strings.

        A single space between two non-space characters always begins a pre-token, so the
        text may be cut before each of them.  Pieces with white space at an end are joined to
        their neighbours again.
        """
        parts = text.split(" ")
        if len(parts) == 1:
            return parts
        if "" not in parts and not any(p[0].isspace() or p[-1].isspace() for p in parts):
            out = [" " + p for p in parts]
            out[0] = parts[0]
            return out
        out, held = [], parts[0]
        for p in parts[1:]:
            if held and p and not held[-1].isspace() and not p[0].isspace():
                out.append(held)
                held = " " + p
            else:
                held += " " + p
        return [*out, held]

    def encode_piece(self, piece: str) -> list[int]:
        whole, out = self.whole, []
        for token in self.pretokens(piece):
            raw = token.encode()
            one = whole.get(raw)
            if one is not None:
                out.append(one)
            else:
                out += self.merge_word(raw)
        return out

    def encode(self, text: str) -> list[int]:
        out = []
        for s in self.segments(text):
            if s in self.special:
                out.append(self.special[s])
            else:
                for p in self.pieces(s):
                    out += self.encode_piece(p)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special ones included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


#: Marks that form one pre-token of their own behind a word of letters.
MARKS = ".,;:!?#*$%&"


def word_and_marks(piece: str) -> tuple[str, str] | None:
    """(word, marks) if the piece is a word of letters, after one space or none, with marks behind it.

    Its tokens are then those of the word and those of the marks.
    """
    word = piece.rstrip(MARKS)
    if len(word) < len(piece) and (word[1:] if word[:1] == " " else word).isalpha():
        return word, piece[len(word) :]
    return None


class Memo(dict):
    """A bounded memo of two generations: a missing key is looked up in the older one, then computed.

    When the younger is full it becomes the older, so keys in use survive.
    """

    def __init__(self, make, size: int = MEMO):
        super().__init__()
        self.make, self.size, self.older = make, size // 2, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 200:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """One vocabulary per worker process."""
    return ByteBPE(path)


keeps(load.cache_clear, "lakeweft.llm.token_counts", "lakeweft.llm.bpe_codec")
