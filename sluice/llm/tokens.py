"""Whole texts to token ids with the tokenizers library, through a bounded memo of words.

Where a vocabulary's rules never look across white space (see ``by_words``), a text's ids are those of its white-space
words in order. A worker encodes each word that it meets once (many at a time, in one call) and keeps at most MEMO
words, so that its memory is bounded; a full memo starts anew. Words are lower-cased (A-Z) only where the vocabulary's
own normaliser does so. Texts that hold an added token's literal (such as an end-of-text mark), and all texts under
other vocabularies, are encoded whole, by the library's defaults.
"""

from __future__ import annotations

import json
import os
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

from sluice.llm.shingles import blocks

MEMO = 400_000
_LETTER, _SPACE = np.zeros((2, 256), bool)
_LETTER[[*range(48, 58), *range(97, 123)]] = _SPACE[[32, *range(9, 14)]] = True
#: Signs that may end a word, and how many endings of them are kept.
SIGNS, TAILS = bytes(c for c in range(33, 127) if not chr(c).isalnum()), 10_000

#: The byte-level alphabet: printable bytes stand for themselves, the others for 256 and on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LEVEL = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


class _Memo(dict):
    """Codes of words in order of their first call; words met since the last ``take`` are in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        self.fresh.append(word)
        return code


def by_words(rules: dict) -> bool:
    """Whether a tokenizer file's rules let each white-space word be encoded by itself, in lower case (A-Z).

    That is so if it normalises by NFC, white space to one space and lower case, keeps what a pattern of letters,
    digits and other signs without white space matches, and adds nothing; and if added tokens are found in raw text.
    """
    normal, before, model = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}, rules["model"]
    steps = [x if x["type"] != "Replace" else {"type": "Replace", "pattern": x["pattern"].get("Regex"), "content": x["content"]} for x in normal.get("normalizers", [])]
    cuts = before.get("pretokenizers", [])
    return (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1]["pattern"], steps[1]["content"]) == (r"\s+", " ")
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
        and all(r"\s" not in part or part.startswith("[^") for part in cuts[0]["pattern"].get("Regex", r"\s").split("|"))
        and not cuts[1]["add_prefix_space"]
        and not cuts[1]["use_regex"]
        and rules["post_processor"] is None
        and (model["type"], model["dropout"]) == ("BPE", None)
        and not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in rules["added_tokens"])
    )


class Encoder:
    """Ids of texts; ``path`` names a vocabulary file of the tokenizers library."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = memo
        rules = json.loads(self.tokenizer.to_str())
        self.added = [x["content"].encode() for x in rules["added_tokens"]]
        self.by_word, self.by_letters = by_words(rules), False
        if self.by_word:
            sample = ["heating", "été", "ñandú", "straße", "x"]
            self.by_letters = [self._letters(w.encode()) for w in sample] == self._plain(sample)
            self.tails: dict[bytes, list[int] | None] = {b"": []}
            #: Signs that are encoded apart from a letter or digit before them.
            self.apart = np.zeros(256, bool)
            for c in map(chr, SIGNS):
                sign, *found = self._plain([c, "heating", f"heating{c}", "7", f"7{c}"])
                self.apart[ord(c)] = self.by_letters and found[1::2] == [x + sign for x in found[::2]]
        self._clear()

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, word: bytes) -> list[int]:
        """Ids of one normalised run of letters, straight from the library's model."""
        shown = word.decode() if word.isascii() else word.decode("latin-1").translate(_LEVEL)
        return [t.id for t in self.tokenizer.model.tokenize(shown)]

    def _tail(self, signs: bytes) -> list[int] | None:
        """Ids of the signs that end a word, or None if they are not encoded apart from the letters before them."""
        if signs not in self.tails:
            if len(self.tails) > TAILS:
                self.tails = {b"": []}
            ids, whole = self._plain([signs.decode(), f"heating{signs.decode()}"])
            self.tails[signs] = ids if whole == self._letters(b"heating") + ids else None
        return self.tails[signs]

    def _clear(self) -> None:
        self.codes = _Memo()
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes = np.zeros((2, 1 << 14), np.int64)
        self.known = self.used = 0

    def forget(self) -> None:
        """Drop the memo, which a worker would hold through later stages otherwise."""
        self._clear()

    def _learn(self) -> None:
        """Encode the words met since the last call and append their ids to the memo.

        Ids go to one list, in any order of words: a list a word would keep the garbage collector busy.
        """
        fresh, self.codes.fresh = self.codes.fresh, []
        tokenize, late, rest = self.tokenizer.model.tokenize, [], []
        ids: list[int] = []
        order, ends = [], []
        for i, w in enumerate(fresh):
            tail = None
            if self.by_letters and w.isalpha():
                core, tail = w, []
            elif self.by_letters and (not (core := w.rstrip(SIGNS)).isascii() or core.isalpha()):
                tail = self._tail(w[len(core) :])
            if tail is None:
                rest.append(i)
            elif core.isascii():
                ids += [t.id for t in tokenize(core.decode())]
                ids += tail
                order.append(i)
                ends.append(len(ids))
            else:
                late.append(i)
        cores = [fresh[i].rstrip(SIGNS) for i in late]
        texts = [x.decode() for x in cores]
        plain = self.tokenizer.normalizer.normalize_str(" ".join(x for x in texts if x.isalpha())).split(" ")
        if len(plain) != sum(map(str.isalpha, texts)):
            rest += late
        elif late:
            shown = zip(plain, " ".join(plain).encode().decode("latin-1").translate(_LEVEL).split(chr(_LEVEL[32])), strict=True)
            for i, core, text in zip(late, cores, texts, strict=True):
                word, x = next(shown) if text.isalpha() else ("", "")
                if not word.isalpha():
                    rest.append(i)
                    continue
                ids += [t.id for t in tokenize(x)]
                ids += self._tail(fresh[i][len(core) :])
                order.append(i)
                ends.append(len(ids))
        for i, found in zip(rest, self._plain([fresh[i].decode() for i in rest]), strict=True):
            ids += found
            order.append(i)
            ends.append(len(ids))
        n, size = len(fresh), len(ids)
        while len(self.starts) < self.known + n:
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while len(self.flat) < self.used + size:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + size] = ids
        at, bounds = self.known + np.array(order, np.int64), np.array([0, *ends], np.int64)
        self.starts[at], self.sizes[at] = self.used + bounds[:-1], np.diff(bounds)
        self.known, self.used = self.known + n, self.used + size

    def encode(self, texts: pa.Array):
        """(first row, end row, ids, offsets) of runs of texts; null texts are empty."""
        for start, end, data, offsets in blocks(texts):
            raw = data.tobytes()
            if self.by_word and not any(x in raw for x in self.added):
                ids, at = self._by_word(raw, offsets)
            else:
                ids, at = self._one_by_one(raw, offsets)
            yield start, end, ids, at

    def _one_by_one(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with an added token, or of a vocabulary that is not ``by_word``, are encoded whole."""
        found = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            text = raw[a:b]
            if self.by_word and not any(x in text for x in self.added):
                found.append(self._by_word(text, np.array([0, len(text)]))[0])
            else:
                found.append(np.array(self._plain([text.decode()])[0], np.int32))
        return np.concatenate(found).astype(np.int32, copy=False), np.cumsum([0, *map(len, found)])

    def _apart(self, raw: bytes, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Texts with a space before each single sign that ends a word after a letter (a-z) or digit, so that the word is met as if without it."""
        data = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(_LETTER[data[:-2]] & self.apart[data[1:-1]] & _SPACE[data[2:]]) + 1
        return np.insert(data, at, 32).tobytes(), offsets + np.searchsorted(at, offsets)

    def _by_word(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) > self.limit:
            self._clear()
        raw, offsets = self._apart(raw.lower(), offsets)
        each = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        n = int(sizes.sum())
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(each)), np.int64, n)
        if self.codes.fresh:
            self._learn()
        first, counts = self.starts[codes], self.sizes[codes]
        total = np.zeros(n + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        ids = self.flat[np.repeat(first - total[:-1], counts) + np.arange(total[-1])]
        return ids, total[np.concatenate([[0], np.cumsum(sizes)])]


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)
