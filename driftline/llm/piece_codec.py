"""SentencePiece encoding and decoding by batched numpy Viterbi.

Texts are cut before runs of the space mark, which no piece crosses; distinct words are encoded once and
remembered within a task. Words of equal length are rows of one matrix and advance together: substring hashes, each grown
from the one that is a character shorter, probe the sorted piece keys; at each end, the vectorised maximum over piece
lengths stores score and backpointer.

* unigram models: the score of a path is the sum of its pieces' scores.
* BPE models: a path of greatest sum is not what merging gives (for the model used here about half of the corpus's words
  differ). But merging never looks across a boundary that it leaves in the end, so that a sequence of pieces is its result
  just if each two neighbours are its result on their own. So a step counts only where the piece fits the one that the
  backpointer in front of it names; one step for each end does. Whether two pieces fit is found by undoing the merges at
  their common boundary, the latest first, and asking whether the symbols there would have merged before. Runs of marks, whose
  pieces share the lowest score, merge last and on their own, by a heap.

Characters without a piece become byte pieces. Decoding gathers the pieces' bytes.

Defined results: a null or empty text has no ids and decodes to the empty text. The space mark U+2581 in a text
decodes to a space, as in the library. Repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import table, texts
from driftline.llm.token_ids import WordEncoder, strips

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")
#: Rows of longer words are not made; such words, one at a time, merge by a heap.
LONGEST = 4096
#: Characters of the rows that advance together.
ROWS = 200_000
GOLD = np.uint64(0x9E3779B97F4A7C15)
NEVER = -(2.0**60)


def longer_hash(h: np.ndarray | np.uint64, codes: np.ndarray) -> np.ndarray:
    """The hashes of strings that go on with codes behind those hashed to h."""
    h = (h ^ codes.astype(np.uint64)) * GOLD
    return h ^ (h >> np.uint64(29))


def string_hashes(strings: list[str]) -> np.ndarray:
    """The hash of each string."""
    out, size = np.zeros(len(strings), np.uint64), np.array([len(x) for x in strings])
    for n in np.unique(size):
        at = np.nonzero(size == n)[0]
        codes = np.frombuffer("".join(strings[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n)
        h = np.uint64(0)
        for j in range(n):
            h = longer_hash(h, codes[:, j])
        out[at] = h
    return out


class PieceModel:
    """pieces: (text, score) by id; bytes_: id of each byte piece; kind: "bpe" or "unigram"."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], skipped: set[int], kind: str):
        self.kind, self.byte_ids = kind, np.array(byte_ids)
        self.pieces = pieces
        usable = {p: i for i, (p, _) in enumerate(pieces) if i not in skipped and i not in set(byte_ids)}
        self.score = np.array([s for _, s in pieces])
        self.usable = usable
        known = bytes_by_id = [b""] * len(pieces)
        for p, i in usable.items():
            bytes_by_id[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            known[i] = bytes([b])
        self.byte_size = np.array([len(b) for b in bytes_by_id])
        self.byte_first = np.cumsum(self.byte_size) - self.byte_size
        self.byte_flat = np.frombuffer(b"".join(bytes_by_id), np.uint8)
        self.width = max(map(len, usable), default=1)
        # characters inside pieces are symbols too, if none of the pieces
        self.symbols = dict(usable)
        if kind == "bpe":
            for p in usable:
                for c in p:
                    self.symbols.setdefault(c, len(pieces) + len(self.symbols))
        own = [p for p in self.symbols if kind != "bpe" or p == MARK or p.strip(MARK)]
        hashes = string_hashes(own)
        order = np.argsort(hashes)
        self.keys, self.ids, self.lengths = hashes[order], np.array([self.symbols[p] for p in own])[order], np.array([len(p) for p in own])[order]
        self.unknown = min((self.score[i] for i in usable.values()), default=0.0) - 10
        most = max(self.symbols.values(), default=0) + 1
        self.symbol_score = np.append(np.full(most, self.unknown), self.unknown)
        self.symbol_score[list(usable.values())] = self.score[list(usable.values())]
        if kind == "bpe":
            self.read_merges(most)

    def read_merges(self, most: int) -> None:
        """For each symbol the two it is last merged from, and when; for each pair the piece it merges to."""
        pairs = sorted((self.symbols[p[:j]] << 32 | self.symbols[p[j:]], i) for p, i in self.usable.items() for j in range(1, len(p)) if p[:j] in self.symbols and p[j:] in self.symbols)
        self.pair_keys, self.pair_ids = np.array([x[0] for x in pairs] or [-1], np.int64), np.array([x[1] for x in pairs] or [0])
        self.left, self.right, self.order = np.full(most, -1), np.full(most, -1), np.full(most, -1.0)
        self.mark_runs: dict[int, list[int]] = {}
        for p, i in self.usable.items():
            if len(p) > 1 and p.strip(MARK):
                parts, last = list(p), None
                while len(parts) > 1:
                    k = max((j for j in range(len(parts) - 1) if parts[j] + parts[j + 1] in self.usable), key=lambda j: (self.score[self.usable[parts[j] + parts[j + 1]]], -j), default=None)
                    if k is None:
                        break
                    last = parts[k], parts[k + 1]
                    parts[k : k + 2] = [parts[k] + parts[k + 1]]
                later = last and max(self.order_of(last[0]), self.order_of(last[1])) < -self.score[i]
                if len(parts) > 1 or not later:
                    raise ValueError(f"piece {i} is no result of merges by falling score")
                self.left[i], self.right[i], self.order[i] = self.symbols[last[0]], self.symbols[last[1]], -self.score[i]

    def order_of(self, symbol: str) -> float:
        return -self.score[self.usable[symbol]] if len(symbol) > 1 else -1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether merging leaves the symbols x and y, side by side, as they are; characters below 0 never merge."""
        ok = np.ones(len(x), bool)
        at = np.nonzero((x >= 0) & (y >= 0))[0]
        a, b, limit = x[at], y[at], np.full(len(at), np.inf)
        while at.size:
            key = a << 32 | b
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merges = (self.pair_keys[place] == key) & (self.order[self.pair_ids[place]] < limit)
            ok[at[merges]] = False
            on = np.nonzero(~merges & ((self.left[a] >= 0) | (self.left[b] >= 0)))[0]
            at, a, b = at[on], a[on], b[on]
            # undo the later one; of equal merges the left one came first, and a merge across comes before an equal one to its right
            older, newer = self.order[a], self.order[b]
            first = older > newer
            limit = np.where(first, older, newer + 0.5)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    @staticmethod
    def codes(word: str) -> np.ndarray:
        return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)

    @classmethod
    def read(cls, path: str) -> "PieceModel":
        """A model file; the library is used to read it only."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        # the kind is not exposed: merge ranks are whole numbers that fall from 0
        scores = [sp.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        kind = "bpe" if all(float(scores[i]).is_integer() for i in plain) else "unigram"
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        skipped = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        return cls([(sp.id_to_piece(i), scores[i]) for i in range(n)], byte_ids, skipped, kind)

    def byte_pieces(self, char: str) -> list[int]:
        return [int(self.byte_ids[b]) for b in char.encode("utf-8", "surrogatepass")]

    def probe(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """The symbol of the length behind each hash, or -1."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where((self.keys[at] == hashes) & (self.lengths[at] == length), self.ids[at], -1)

    def segment(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        by_length: dict[int, list[int]] = {}
        out: list[list[int]] = [[]] * len(words)
        marks = [(i, len(w) - len(w.lstrip(MARK))) for i, w in enumerate(words) if self.kind == "bpe" and w.startswith(MARK * 2)]
        words = list(words)
        for i, k in marks:
            words[i] = words[i][k - 1 :]
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, group in by_length.items():
            step = 1 + ROWS // max(n, 1)
            for a in range(0, len(group), step):
                part = group[a : a + step]
                own = [words[i] for i in part]
                rows = map(self.merge_long, own) if self.kind == "bpe" and n > LONGEST else self.viterbi(own, n)
                for i, ids in zip(part, rows):
                    out[i] = ids
        for i, k in marks:
            alone = out[i][0] == self.symbols.get(MARK)
            run = k if alone else k - 1
            if run not in self.mark_runs:
                self.mark_runs[run] = self.merge_long(MARK * run)
            out[i] = self.mark_runs[run] + out[i][alone:]
        return out

    def viterbi(self, words: list[str], n: int) -> list[list[int]]:
        """The best path of each word of n characters."""
        row = np.arange(len(words))
        codes = self.codes("".join(words)).reshape(len(words), n)
        h, found = np.uint64(0), []
        for size in range(1, min(self.width, n) + 1):
            h = longer_hash(h if size == 1 else h[:, :-1], codes[:, size - 1 :])
            found.append(self.probe(h, size))
        best, tail, back = np.full((len(words), n + 1), NEVER), np.full((len(words), n + 1), -1), np.zeros((len(words), n + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, n + 1):
            sizes = np.arange(1, min(self.width, end) + 1)
            piece = np.stack([found[size - 1][:, end - size] for size in sizes])
            usable = piece >= 0
            usable[0] = True
            if self.kind == "bpe" and end > 1:
                size, r = np.nonzero(usable[: end - 1])
                usable[size, r] = self.fit(tail[r, end - 1 - size], piece[size, r])
            score = np.where(usable, best[:, end - sizes].T + self.symbol_score[piece], NEVER)
            choice = score.argmax(axis=0)
            best[:, end], tail[:, end], back[:, end] = score[choice, row], piece[choice, row], choice + 1
        path, size, at, used = np.zeros((len(words), n), np.int64), np.zeros((len(words), n), np.int64), np.full(len(words), n), n
        while (at > 0).any():
            used -= 1
            path[:, used], size[:, used] = tail[row, at], back[row, at] * (at > 0)
            at = at - size[:, used]
        size, path = size[:, used:], path[:, used:]
        plain = ((path >= 0) & (path < len(self.pieces)) | (size == 0)).all(axis=1).tolist()
        skip = (size == 0).sum(axis=1).tolist()
        begin = np.cumsum(size, axis=1) - size
        return [p[k:] if ok else self.finish(p[k:], w, b[k:]) for p, k, w, b, ok in zip(path.tolist(), skip, words, begin, plain)]

    def start(self, word: str) -> list[int]:
        """Symbols of the characters; those in no piece are below 0."""
        return [self.symbols.get(c, -1 - ord(c)) for c in word]

    def finish(self, symbols, word: str, begins) -> list[int]:
        out: list[int] = []
        for s, b in zip(symbols, begins):
            out += [int(s)] if 0 <= s < len(self.pieces) else self.byte_pieces(word[b])
        return out

    def merge_long(self, word: str) -> list[int]:
        """One long word, by a heap of pairs."""
        s, n = self.start(word), len(word)
        after, before, stamp = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        text = {i: c for i, c in enumerate(word)}
        heap: list[tuple] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (piece := self.usable.get(text[i] + text[j])) is not None:
                heapq.heappush(heap, (-self.score[piece], i, j, stamp[i], stamp[j], piece))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, a, b, piece = heapq.heappop(heap)
            if i not in text or j not in text or stamp[i] != a or stamp[j] != b or after[i] != j:
                continue
            text[i] += text.pop(j)
            s[i], after[i], stamp[i] = piece, after[j], stamp[i] + 1
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        left = sorted(text)
        return self.finish([s[i] for i in left], word, left)

    def decode(self, ids: np.ndarray) -> str:
        size = self.byte_size[ids]
        total = np.cumsum(size)
        data = self.byte_flat[np.repeat(self.byte_first[ids] - total + size, size) + np.arange(total[-1] if len(total) else 0)].tobytes()
        return data.removeprefix(b" ").decode("utf-8", "replace")


class PieceEncoder(WordEncoder):
    """Remembers the ids of words, as WordEncoder does, under a PieceModel."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.cuts = self.safe_cuts()
        self.forget()

    def safe_cuts(self) -> re.Pattern | None:
        """Matches line ends, and commas, full stops and the like behind a letter, if no piece crosses such a place.

        Words are segmented in the parts between, which are fewer and repeat more often."""
        pairs = {(a, b) for p in self.model.usable for a, b in zip(p, p[1:])}
        if any("\n" in pair or (b in ".,!?;" and LETTER.fullmatch(a)) for a, b in pairs for pair in [(a, b)]) or self.model.kind != "bpe":
            return None
        return re.compile(f"(\n|(?<={LETTER.pattern})[.,!?;]+(?=\n|$))")

    def learn(self, todo: list[str]) -> None:
        if self.cuts is None:
            found = self.model.segment(todo)
        else:
            parts = [[x for x in self.cuts.split(w) if x] for w in todo]
            distinct = list({x for p in parts for x in p})
            own = dict(zip(distinct, self.model.segment(distinct)))
            found = [own[p[0]] if len(p) == 1 else [i for x in p for i in own[x]] for p in parts]
        sizes = np.array([len(x) for x in found], np.int64)
        self.remember(todo, np.fromiter(chain.from_iterable(found), np.uint16, int(sizes.sum())), sizes)

    def words(self, texts_: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All words of the texts in turn, marks included, and how many each text has."""
        if not any("  " in t or t.endswith(" ") or MARK in t for t in texts_):
            lists = pc.split_pattern(pc.binary_join_element_wise("", pa.array(texts_, pa.string()), ""), " ")
            n = pc.list_value_length(lists).to_numpy().astype(np.int64)
            flat = pc.binary_join_element_wise(MARK, lists.flatten(), "")
            empty = np.array([not t for t in texts_])
            if empty.any():
                flat = flat.filter(pa.array(np.repeat(~empty, n)))
            return flat, np.where(empty, 0, n)
        lists = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts_]
        return pa.array([w for x in lists for w in x], pa.string()), np.array([len(x) for x in lists])

    def encode(self, texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > 1_000_000:
            self.forget()
        rows, counts = self.words(texts_)
        coded = rows.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        at = self.places(distinct)
        if (new := np.nonzero(at < 0)[0]).size:
            self.learn([distinct[i] for i in new])
            at[new] = self.places([distinct[i] for i in new])
        ids, size = self.gather(at[coded.indices.to_numpy()])
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(counts)])])

    def each(self, texts_: list[str]) -> Iterator[np.ndarray]:
        for strip in strips(texts_):
            ids, counts = self.encode(strip)
            at = np.concatenate([[0], np.cumsum(counts)])
            for a, b in zip(at, at[1:]):
                yield ids[a:b]


ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in ENCODERS:
        ENCODERS[path] = PieceEncoder(PieceModel.read(path))
    return ENCODERS[path]


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of each row of docs."""
    path = path or model_file()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [x.astype(np.int32) for x in encoder(path).each(list(b["text"]))]})

    return texts(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of encoded (doc_id, ids)."""
    path = path or model_file()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [encoder(path).model.decode(np.asarray(x, dtype=np.int64)) for x in b["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def codec_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_crc32 (of the decoded text) and
    round_trip: whether decoding gives the text again, spaces for space marks."""
    path = path or model_file()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text, ids in zip(b["doc_id"], b["text"], encoder(path).each(list(b["text"]))):
                decoded = encoder(path).model.decode(ids.astype(np.int64))
                rows.append((doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(decoded.encode()), decoded == text.replace(MARK, " ")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"])

    return texts(docs).mapInPandas(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_table(table(spark, sf_dir, "documents"))


QUERIES = {"op6_piece_codec": op6_piece_codec}
