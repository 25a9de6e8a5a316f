"""Counts per document and per line over many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from proofrecon.llm.textarrays import SPACE, joined, mix, prefix, spans, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:?")] = True

#: Upper bounds of the buckets of each line feature; the last bucket is open.
BUCKETS = (
    ("words", (1, 3, 7, 15, 31)),
    ("symbols", (0.0, 0.05, 0.3)),
    ("upper", (0.1, 0.3, 0.7)),
    ("earlier", (0.5,)),
    ("repeated", (0.0, 0.2, 0.5)),
    ("digits", (0.0, 0.05, 0.2)),
    ("length", (3.0, 5.0, 8.0, 12.0)),
    ("stops", (0.0, 0.1, 0.4)),
    ("shouts", (0.0, 0.2)),
)
#: Where each feature's codes begin in the weight vector, and its length at last.
OFFSETS = np.cumsum([0, *(len(bounds) + 1 for _, bounds in BUCKETS)])


@dataclass
class Stats:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; lines with a word: first index, features, words."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    first_line: np.ndarray
    codes: np.ndarray
    line_words: np.ndarray


def _doubled(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys equal an earlier one, and which occur at least twice."""
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return later, twice


def text_stats(docs: list[bytes]) -> Stats:
    buf, starts = joined(docs)
    n = len(docs)
    sums = prefix(buf)
    begin, end, first = words(buf, starts)
    n_words = np.diff(first)
    word_doc = np.repeat(np.arange(n), n_words)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[starts])
    symbol = _SYMBOL[buf]
    word_chars = total(((buf & 0xC0) != 0x80) & ~SPACE[buf])

    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    line_end = np.flatnonzero(buf == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1]) if len(line_end) else line_end
    first_word, next_word = np.searchsorted(begin, line_start), np.searchsorted(begin, line_end)
    has = next_word > first_word
    line_start, line_end, first_word, next_word = line_start[has], line_end[has], first_word[has], next_word[has]
    line_doc = np.searchsorted(starts, line_start, side="right") - 1
    earlier, _ = _doubled(spans(sums, line_start, line_end) ^ salt[line_doc])

    repeated = np.zeros(len(begin), bool)
    if len(begin) >= 3:
        w = spans(sums, begin, end)
        place = np.flatnonzero(word_doc[2:] == word_doc[:-2])
        window = mix(mix(w[place] * np.uint64(0xD6E8FEB86659FD93) + w[place + 1]) * np.uint64(0xD6E8FEB86659FD93) + w[place + 2])
        _, twice = _doubled(window ^ salt[word_doc[place]])
        for k in range(3):
            repeated[place[twice] + k] = True

    per_line = lambda flags: (lambda c: c[line_end] - c[line_start])(np.concatenate([[0], np.cumsum(flags)]))
    count = next_word - first_word
    upper, lower = per_line((buf >= 65) & (buf <= 90)), per_line((buf >= 97) & (buf <= 122))
    stretch = np.concatenate([[0], np.cumsum(end - begin)])
    seen = np.concatenate([[0], np.cumsum(repeated)])
    values = {
        "words": count,
        "symbols": per_line(symbol) / count,
        "upper": upper / np.maximum(upper + lower, 1),
        "earlier": earlier,
        "repeated": (seen[next_word] - seen[first_word]) / count,
        "digits": per_line((buf >= 48) & (buf <= 57)) / np.maximum(line_end - line_start, 1),
        "length": (stretch[next_word] - stretch[first_word]) / count,
        "stops": per_line(_STOP[buf]) / count,
        "shouts": per_line(buf == 33) / count,
    }
    codes = np.stack([np.searchsorted(bounds, values[name]) + OFFSETS[k] for k, (name, bounds) in enumerate(BUCKETS)], axis=1)
    return Stats(
        n_words,
        word_chars,
        total(symbol),
        np.bincount(line_doc[earlier], minlength=n),
        np.bincount(word_doc[repeated], minlength=n),
        np.searchsorted(line_doc, np.arange(n + 1)),
        codes.astype(np.int16),
        count,
    )
