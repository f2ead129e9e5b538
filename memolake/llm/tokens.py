"""Token ids inside tasks, from vocabulary files of the ``tokenizers`` and ``tiktoken`` libraries."""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from itertools import repeat

import numpy as np

#: The ids of so many pieces are kept; then the store starts anew. A caller may set ``keep`` of a tokenizer.
KEEP_PIECES = 500_000
_open: dict = {}
#: Blanks that str.split() takes and the tokenizer does not.
ODD = re.compile("[\x1c-\x1f]")
STOPS = ".,;:!?"


def steps(part: dict | None, inner: str) -> list[dict]:
    """A normaliser or pre-tokenizer as a list of its steps."""
    return [] if part is None else [x for p in part[inner] for x in steps(p, inner)] if part["type"] == "Sequence" else [part]


def lowers_only(normalizer: dict | None) -> bool:
    """Whether all that a normaliser does to a word of ASCII letters is to lower it: it composes, folds blanks and lowers."""
    found = steps(normalizer, "normalizers")
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    return any(x["type"] == "Lowercase" for x in found) and all(x["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or x == blanks for x in found)


def parts_words(pre_tokenizer: dict | None) -> bool:
    """Whether a pre-tokenizer leaves a word of ASCII letters whole and parts it from stops: the pattern it cuts by takes
    letters together, and what is between cuts goes."""
    found = steps(pre_tokenizer, "pretokenizers")
    cuts = [x for x in found if x["type"] == "Split"]
    whole = all(x["behavior"] == "Removed" and x["invert"] and r"[\p{L}]+" in x["pattern"].get("Regex", "") for x in cuts)
    return len(cuts) == 1 and whole and all(x["type"] == "Split" or (x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"]) for x in found)


class PieceTokenizer:
    """Ids of the ``tokenizers`` library for vocabularies that drop white space: no token crosses it, so a text's ids
    are those of its blank-parted pieces, and pieces repeat. Ids are the library's own, kept by piece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.keep = KEEP_PIECES
        self.short_cut = lowers_only(spec["normalizer"]) and parts_words(spec["pre_tokenizer"])
        self.clear()

    def clear(self):
        self.known, self.starts, self.sizes, self.ids = {}, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.words, self.marks = {}, {"": b""}

    def learn(self, pieces: list[str]) -> None:
        """Most new pieces are a word of letters and perhaps stops, which the file's own steps part: ids are those of the word
        and of the stops. Of ASCII letters, normalisation only lowers a word, and the library's model gives its ids; other words
        go through the whole tokenizer once, whatever stops follow. All other pieces go through it as they are, as do all where
        the file's normaliser or pre-tokenizer does more than that."""
        tokenize, words, parts, others = self.tokenizer.model.tokenize, self.words, [], {}
        for piece in pieces:
            word = piece.rstrip(STOPS)
            # A letter may be lowered to one with a mark behind it, which isn't parted from stops.
            if self.short_cut and word.isalpha() and (word.isascii() or word.lower().isalpha()):
                key = word.lower() if word.isascii() else word
                if key not in words:
                    if word.isascii():
                        words[key] = array("I", [t.id for t in tokenize(key)]).tobytes()
                    else:
                        others[key] = None
                stops = piece[len(word) :]
                if stops not in self.marks:
                    self.marks[stops] = array("I", self.tokenizer.encode(stops, add_special_tokens=False).ids).tobytes()
                parts.append((key, stops))
            else:
                others[piece] = None
                parts.append((piece, ""))
        for key, x in zip(others, self.tokenizer.encode_batch_fast([*others], add_special_tokens=False)):
            others[key] = array("I", x.ids).tobytes()
        words.update((key, ids) for key, ids in others.items() if key.isalpha())
        got = [(words[key] if key in words else others[key]) + self.marks[stops] for key, stops in parts]
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        ids = np.frombuffer(b"".join(got), np.uint32)
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.keep:
            self.clear()
        split = [re.split("[ \t\r\n]+", t) if ODD.search(t) else t.split() for t in texts]
        pieces = [p for s in split for p in s]
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(lost := np.flatnonzero(at < 0)):
            self.learn([*dict.fromkeys(pieces[i] for i in lost)])
            at[lost] = [self.known[pieces[i]] for i in lost]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate(([0], ends))[np.cumsum([len(s) for s in split])]
        return np.split(ids, cuts[:-1])


class RankTokenizer:
    """Ids of the ``tiktoken`` library; texts can be had back from them."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def clear(self):
        """Nothing is kept."""

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.encoding.encode_ordinary(t), np.uint32) for t in texts]


def tokenizer(path: str, pattern: str = ""):
    """One per Python worker and file."""
    if path not in _open:
        _open[path] = RankTokenizer(path, pattern) if path.endswith(".tiktoken") else PieceTokenizer(path)
    return _open[path]
