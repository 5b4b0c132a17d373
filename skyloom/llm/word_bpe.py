"""Ids of whole texts by a tokenizer that drops white space, one distinct piece of a word at a time."""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np

from skyloom.llm.chunks import ChunkTable, flat

_JOINED = 2000
#: How a tokenizer of this kind cuts words, white space being dropped; it lower-cases before.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"  # ASCII and the composed letters of Latin-1, which no normal form changes while no other character is near
_MARK = r"\x00-\x08\x0e-\x1f!-&(-/:-@\[-`{-\x7f"
_ODD = rf"[^{_LETTER}{_MARK}0-9 \t-\r]"  # apostrophes, and all characters beyond these
#: A word with an odd character, whole; of other words each run of letters, digit, and run of marks.
_PIECES = re.compile(rf"[{_LETTER}{_MARK}0-9]*+{_ODD}[^ \t-\r]*|[{_LETTER}]+|[0-9]|[{_MARK}]+").findall
_ALIKE = re.compile(rf"[{_LETTER}]+|[{_MARK}]+").fullmatch
_PLAIN = re.compile(rf"[{_LETTER}{_MARK}0-9' \t-\r]*+").fullmatch
_WORDS = re.compile(r"[^ \t-\r]+").findall


class _Words:
    """Segments words, or pieces of words, without ASCII white space in them.

    The tokenizer cuts at white space and drops it, so the ids of a text are those of
    its words in a row; if it also cuts words by ``_PATTERN``, they are those of the pieces.
    Pieces of letters or of marks alone are encoded many at a time: each ends in a
    token that carries the end of a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self._is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        parts = json.loads(self._tokenizer.to_str())
        # Added tokens are found in the raw text, before it is lower-cased or cut.
        self._added = [x["content"] for x in parts["added_tokens"]]
        normal = (parts["normalizer"] or {}).get("normalizers", [])
        cutters = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        self._cuts = (
            [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in cutters] == ["Split", "ByteLevel"]
            and cutters[0]["pattern"] == {"Regex": _PATTERN}
            and not any(x["normalized"] for x in parts["added_tokens"])
            and not (cutters[1]["add_prefix_space"] or cutters[1]["use_regex"])
        )
        self._alike = self._tokenizer
        if self._cuts:  # pieces are cut and lower-cased by then
            bare = parts | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, cutters[1]]}}
            self._alike = Tokenizer.from_str(json.dumps(bare))

    def pieces(self, text: str) -> list[str]:
        """What a text is cut into. Lower case is the same piece, which is certain of plain texts alone."""
        if not self._cuts or any(x in text for x in self._added):
            return _WORDS(text)
        return _PIECES(text.lower() if _PLAIN(text) else text)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        alike = [i for i, word in enumerate(words) if (_ALIKE(word) if self._cuts else word.isascii() and word.isalpha()) and not any(x in word for x in self._added)]
        found, left = [], np.ones(len(words), bool)  # places of words, and the sizes and ids of these words
        for at in range(0, len(alike), _JOINED):
            group = alike[at : at + _JOINED]
            joined = " ".join([words[i] for i in group])
            ids = np.array(self._alike.encode_batch_fast([joined.lower() if self._cuts else joined], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self._is_end[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):  # else a vocabulary without word ends
                found.append((group, np.diff(ends, prepend=0), ids))
                left[group] = False
        rest = np.flatnonzero(left).tolist()
        found.append((rest, *flat([x.ids for x in self._tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)])))
        places, sizes, ids = (np.concatenate([np.asarray(x[k], kind) for x in found]) for k, kind in enumerate((np.int64, np.int64, np.uint32)))
        begin, order = np.cumsum(sizes) - sizes, np.argsort(places)
        sizes, begin = sizes[order], begin[order]
        after = np.cumsum(sizes)
        return sizes, ids[np.arange(len(ids)) + np.repeat(begin - (after - sizes), sizes)]


@cache
def encoder(path: str) -> tuple[ChunkTable, _Words]:
    """One table for each tokenizer file in this worker, and what cuts texts into its chunks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    words = _Words(path)
    return ChunkTable(words), words
