"""Counts of one text that quality rules and the quality classifier use."""

from __future__ import annotations

from collections import Counter

import numpy as np

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Common words of four languages, lower case.
COMMON = {
    "en": "the of and to in is was for that it with as on be at by this are from or an not have but which they you all were her she there their we him been has when who will more if out so",
    "de": "der die das und ist in zu den von mit sich auf für nicht es dem ein eine als auch an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder",
    "fr": "le la les de des et un une du en est que qui dans pour pas au sur par plus ce avec il sont se ne ou son elle aux mais nous comme cette ont été être leur même fait sans peut",
    "es": "el la los las de que y en un una por con no para es se lo del al como más pero sus su le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde",
}
WORDS = sorted({w for words in COMMON.values() for w in words.split()})
WORD_BIN = {w.encode(): i for i, w in enumerate(WORDS)}

#: Character classes, told by the UTF-8 byte that begins a character.
CLASSES = ("lower", "upper", "digit", "blank", "line end", "sentence mark", "bracket or quote", "symbol", "control", "two-byte Latin", "other two-byte", "three-byte", "four-byte")


def _class_of_byte() -> np.ndarray:
    table = np.full(256, -1)
    sets = {0: range(97, 123), 1: range(65, 91), 2: range(48, 58), 3: b" \t", 4: b"\n\r\x0b\x0c", 5: b".,;:!?", 6: b"'\"()[]{}-", 9: (0xC2, 0xC3), 10: range(0xC4, 0xE0), 11: range(0xE0, 0xF0), 12: range(0xF0, 0xF8)}
    table[:128] = 7
    table[:32] = table[127] = 8
    for k, members in sets.items():
        for b in members:
            table[b] = k
    return table


CLASS_OF_BYTE = _class_of_byte()
_CLASS_ROWS = np.zeros((256, len(CLASSES)), np.int64)
_CLASS_ROWS[np.flatnonzero(CLASS_OF_BYTE >= 0), CLASS_OF_BYTE[CLASS_OF_BYTE >= 0]] = 1


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that the text holds twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    order = np.sort(mixed)
    if not (order[1:] == order[:-1]).any():
        return 0
    again = np.unique(order[1:][order[1:] == order[:-1]])
    at = np.flatnonzero(np.isin(mixed, again)).tolist()
    windows = [tuple(words[i : i + WINDOW]) for i in at]  # a hash only proposes
    seen = Counter(windows)
    edge = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at, windows, strict=True):
        if seen[w] > 1:
            edge[i] += 1
            edge[i + WINDOW] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    lines = [x for x in text.split("\n") if x and x.strip(WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def class_histogram(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS_ROWS


def word_histogram(words_lower: list[bytes]) -> np.ndarray:
    """Counts of the common words, then of all others; marks around a word are cut off."""
    out = np.zeros(len(WORDS) + 1, np.int64)
    n = Counter(words_lower)
    for w, k in n.items():
        i = WORD_BIN.get(w)
        if i is None:
            i = WORD_BIN.get(w.strip(b".,;:!?'\"()[]{}"), len(WORDS))
        out[i] += k
    return out
