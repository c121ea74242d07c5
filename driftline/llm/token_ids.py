"""Token ids of whole texts by the tokenizers library, with the ids of words remembered within a task.

No token of the vocabularies used here spans a space, so that a text's ids are its space-separated words' ids
in turn. Signs behind a Latin letter at a word's end are cut off, for the same reason. Where the tokenizer lower-cases,
ASCII capitals are lowered before words are looked up, so that fewer differ; texts with combining marks are left as they
are, as composing comes before lowering and some letters compose in one case only.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a task remembers; at more it starts anew.
REMEMBERED = 1_000_000
#: Characters encoded at once.
STRIP = 1 << 23

LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
ENDED = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?#$%&*]+)([ \n]|$)"


class WordEncoder:
    """Ids of texts under a tokenizer file whose words end in a marked token (`</w>`)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.lowers = "Lowercase" in json.dumps(json.loads(self.tokenizer.to_str()).get("normalizer"))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.first, self.size, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint16), 0

    def remember(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Adds words with their ids, which follow each other in ids."""
        n, k = len(self.place), len(words)
        self.place.update(zip(words, range(n, n + k)))
        if n + k > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * (n + k)), np.resize(self.size, 2 * (n + k))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.first[n : n + k], self.size[n : n + k] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places in turn, and how many each has."""
        size = self.size[at].astype(np.int64)
        total = np.cumsum(size)
        return self.flat[np.repeat(self.first[at] - total + size, size) + np.arange(total[-1] if len(total) else 0)], size

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, todo: list[str]) -> None:
        plain = [w for w in todo if LETTERS.fullmatch(w)]
        other = [] if len(plain) == len(todo) else list(set(todo).difference(plain))
        for i in range(0, len(plain), 20_000):
            group = plain[i : i + 20_000]
            strips = [" ".join(group[j : j + 400]) for j in range(0, len(group), 400)]
            ids = np.fromiter(chain.from_iterable(self.library(strips)), np.uint16)
            ends = np.nonzero(self.ends[ids])[0] + 1
            if len(ends) == len(group):
                self.remember(group, ids, np.diff(ends, prepend=0))
            else:
                other += group
        found = self.library(other)
        self.remember(other, np.fromiter(chain.from_iterable(found), np.uint16), np.array([len(x) for x in found], np.int64))

    def places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and the number of ids of each text."""
        if len(self.place) > REMEMBERED:
            self.forget()
        plain = pa.array(texts, pa.string())
        if self.lowers and not pc.any(pc.match_substring_regex(plain, r"\pM")).as_py():
            plain = pc.ascii_lower(plain)
        spaced = pc.replace_substring_regex(plain, ENDED, r"\1 \2\3")
        lists = pc.split_pattern(pc.replace_substring(spaced, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        at = self.places(distinct)
        if (new := np.nonzero(at < 0)[0]).size:
            self.learn([distinct[i] for i in new])
            at[new] = self.places([distinct[i] for i in new])
        ids, size = self.gather(at[words.indices.to_numpy()])
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])])

    def each(self, texts: list[str], most: int = STRIP) -> Iterator[np.ndarray]:
        """The ids of each text, encoded some `most` characters at a time."""
        for strip in strips(texts, most):
            if len(strip) == 1 and len(strip[0]) > 2 * STRIP:
                yield self.long(strip[0])
                continue
            ids, counts = self.encode(strip)
            at = np.concatenate([[0], np.cumsum(counts)])
            for a, b in zip(at, at[1:]):
                yield ids[a:b]

    def long(self, text: str) -> np.ndarray:
        """The ids of a very long text, cut at spaces."""
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + STRIP)
            end = len(text) if end < 0 else end
            out.append(self.encode([text[at:end]])[0])
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint16)


def strips(texts: list[str], most: int = STRIP) -> Iterator[list[str]]:
    strip, n = [], 0
    for text in texts:
        if strip and n + len(text) > most:
            yield strip
            strip, n = [], 0
        strip.append(text)
        n += len(text)
    if strip:
        yield strip


ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker for a tokenizer file."""
    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]
