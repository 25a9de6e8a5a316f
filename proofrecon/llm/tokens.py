"""Token ids of whole texts with the ``tokenizers`` library, each distinct piece encoded once per worker.

Both vocabularies split a text before they merge bytes, and always between a non-space and a single space that a
non-space follows. A text without two white-space characters in a row is therefore the concatenation of its pieces
between spaces, each encoded alone. Any other text, and one that may hold a special token, is encoded as a whole.
"""

from __future__ import annotations

import gc
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TWO_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}"
#: Marks that both vocabularies split off from the letters before them, if nothing follows.
_MARKS = frozenset(".,;:!?")
#: Most pieces and parts that a worker keeps (beyond it they are encoded anew), and the longest that are kept.
PIECES, PARTS, LONGEST = 750_000, 750_000, 48


class Encoder:
    """``encode(texts)``: the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` of a column of texts.

    A special token's string in a text is that token, as the library has it; with ``special_as_text`` it is ordinary
    text. Kept per worker: ids of pieces between spaces and of their parts. A piece of letters, or of letters and a mark,
    is split here; any other goes through the file's own normalizer and pre-tokenizer. The model encodes each new part.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need 16 bits")
        heads = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = sorted(heads) if not special_as_text else []
        normalizer = self.tokenizer.normalizer
        self.normal = normalizer.normalize_str if normalizer else str
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.tokens = self.tokenizer.model.tokenize
        self.lower = self.normal("A") == "a"
        # how a space or a line feed before a word comes out of the pre-tokenizer
        self.lead = self.split(" a")[0][0][:-1]
        self.feed = [part for part, _ in self.split(self.normal("a\nb"))][1:-1]
        letters = [c for c in map(chr, range(256)) if c.isalpha()]
        self.bytes = {b: self.split(chr(b))[0][0][-1] for b in range(128) if chr(b).isalpha()}
        for c in letters:  # what stands for each byte of these letters, and so for each upper byte
            self.bytes |= dict(zip(c.encode(), self.split(c)[0][0], strict=True))
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = array("H", [t.id for t in self.tokens(part)]).tobytes()
            if len(part) <= LONGEST:
                self.parts[part] = ids
        return ids

    def _piece(self, piece: str, lead: bool) -> bytes:
        """The ids of a piece, after a space if ``lead``."""
        word, end = (piece[:-1], piece[-1]) if piece[-1:] in _MARKS else (piece, "")
        if word.isalpha() and (word.isascii() or max(word) < "\u0100"):
            word = word.lower() if self.lower else word
            word = word if word.isascii() else word.encode().decode("latin1").translate(self.bytes)
            ids = self._part(self.lead + word if lead else word)
            return ids + self._part(end) if end else ids
        if "\n" in piece and piece != "\n":
            head, *lines = piece.split("\n")
            out = [self._piece(head, lead)] if head else []
            for line in lines:
                out += map(self._part, self.feed)
                out += [self._piece(line, False)] if line else []
            return b"".join(out)
        text = self.normal(" " + piece if lead else piece)
        return b"".join([self._part(part) for part, _ in self.split(text)])

    def _table(self, known: dict[str, bytes], pieces: list[str], lead: bool) -> list[bytes]:
        gc.disable()  # many small acyclic objects
        out = []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = self._piece(piece, lead)
                if len(piece) <= LONGEST:
                    known[piece] = ids
            out.append(ids)
        for store, most in ((self.parts, PARTS), (known, PIECES)):
            if len(store) > most:
                store.clear()
        gc.enable()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's ids begin, with their number at last; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        alone = pc.match_substring_regex(texts, _TWO_SPACES)
        for head in self.special:
            alone = pc.or_(alone, pc.match_substring(texts, head))
        lists = pc.split_pattern(pc.if_else(alone, "", texts), " ")
        alone = alone.to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        pieces, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        heads = index[offsets[:-1]]
        first = np.flatnonzero(np.bincount(heads, minlength=len(pieces)))
        is_rest = np.ones(len(index), bool)
        is_rest[offsets[:-1]] = False
        rest = np.flatnonzero(np.bincount(index[is_rest], minlength=len(pieces)))
        table = self._table(self.rest, [pieces[k] for k in rest], True) + self._table(self.first, [pieces[k] for k in first], False)
        at = np.zeros(len(pieces) + 1, np.int64)
        at[rest] = np.arange(len(rest))
        place = at[index]
        at[first] = np.arange(len(first)) + len(rest)
        place[offsets[:-1]] = at[heads]
        for row in np.flatnonzero(alone).tolist():
            place[offsets[row]] = len(table)
            table.append(self.whole(texts[row].as_py()))
        length = np.fromiter(map(len, table), np.int64, len(table)) // 2
        start = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(table), "<u2")
        sizes = length[place]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(start[place] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[offsets]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, special_as_text)
    return _ENCODERS[key]
