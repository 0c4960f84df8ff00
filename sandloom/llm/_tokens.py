"""Whole texts to token ids, exactly as the tokenizers library gives them, at the cost of a dictionary look-up a word."""

from __future__ import annotations

import json
import os
import re

import numpy as np

_loaded: dict = {}


#: A word that is one run of letters to the tokenizer, before and after its normaliser, and what punctuation may follow it.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


class WordCached:
    """For word-end tokenizers that drop white space: ids of a text are those of its words, so each word is encoded once.

    Words are split at ASCII white space only; whatever else the tokenizer does happens inside a word. New words that are
    letters, with or without punctuation behind, are encoded many in one text: such a run of letters always ends in a
    token with the word-end mark, which tells them apart again. A run is encoded once, whatever stands behind it. Other new
    words are encoded one by one. The cache is emptied when it holds `most` words, so memory is bounded.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.cache = Tokenizer.from_file(path), most, {}
        mark = json.load(open(path, encoding="utf-8"))["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab()
        self.ends = None
        if mark:
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for w, i in vocab.items() if w.endswith(mark)]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        runs, tailed, odd = {w: None for w in words if w.isalpha()}, [], []  # bytes.isalpha() knows A-Z and a-z alone
        rest = [w for w in words if not w.isalpha()]
        for w, t in zip(rest, b"\n".join(rest).decode().split("\n") if rest else [], strict=True):
            m = _PLAIN.fullmatch(t)
            if m is None:
                odd.append((w, t))
            elif m[2]:
                tailed.append((w, w[: -len(m[2])], m[2]))
            else:
                runs[w] = None
        if self.ends is None:
            odd += [(w, w.decode()) for w in [*runs, *(x for x, _, _ in tailed)]]
            runs, tailed = {}, []
        # Of words with punctuation behind, the run of letters is most often known by itself.
        runs |= {c: None for _, c, _ in tailed if c not in self.cache}
        tails = {p for _, _, p in tailed}
        odd += [(p.encode(), p) for p in tails]
        for (w, _), ids in zip(odd, self._ids([t for _, t in odd]), strict=True):
            self.cache[w] = ids.tobytes()
        tail = {p: self.cache[p.encode()] for p in tails}
        runs = list(runs)
        for k in range(0, len(runs), 500):
            part = runs[k : k + 500]
            (ids,) = self._ids([b" ".join(part).decode()])
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(part):  # a word of these doesn't end as words do: one by one
                for w, x in zip(part, self._ids([w.decode() for w in part]), strict=True):
                    self.cache[w] = x.tobytes()
                continue
            raw, at = ids.tobytes(), 0
            for w, to in zip(part, ends.tolist(), strict=True):
                self.cache[w] = raw[at:to]
                at = to
        for w, c, p in tailed:
            self.cache[w] = self.cache[c] + tail[p]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        split = [t.encode("utf-8", "replace").split() for t in texts]
        new = set().union(*split).difference(self.cache)
        if len(self.cache) + 2 * len(new) > self.most:  # a new word may bring its run of letters along
            self.cache = {}
            new = set().union(*split)
        self._learn(list(new))
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]


class ByteLevel:
    """A byte-level BPE file run by tiktoken, whose ids for the same merges and split pattern are the same (tested)."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        # A byte-level vocabulary writes the printable Latin-1 bytes as themselves and the others from code point 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.path, self.plain = path, None

    def _one(self, text: str) -> np.ndarray:
        """tiktoken's pattern engine gives up on very long runs of white space; the tokenizers library takes any text."""
        enc = self.encoding.encode_to_numpy if hasattr(self.encoding, "encode_to_numpy") else self.encoding.encode
        try:
            return np.asarray(enc(text, allowed_special="all"), dtype="<u4")
        except ValueError:
            if self.plain is None:
                os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
                from tokenizers import Tokenizer

                self.plain = Tokenizer.from_file(self.path)
            return np.asarray(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._one(t).tobytes() for t in texts]


def loaded(kind, path: str):
    """One tokenizer a worker."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]
