"""Secret scan: base patterns, and a character convolutional network over every other candidate.

Candidates are runs of 12 or more key characters. What lies inside a base match is a finding already; every other
run, and every part of a run that base matches leave uncovered, is scored, together with CONTEXT characters at either
side, by a small network (character embedding, one convolution, maximum over positions, logistic output) in numpy. Long
ones are scored in overlapping windows, of which the highest counts.

It learns from every document. Each gives what its patterns settle: runs marked as assigned or access keys, and as no
secrets runs of digits or signs alone, runs of letters (as they are, in capitals, in another form, joined to another one),
words too short for a candidate, names before an assignment, and joined runs that COMMON different texts share; and
made-up keys and compounds of its own words (those too short for a candidate), alone and planted between its words. Spark brings equal runs of one kind
together; each is learned once, in the surroundings of least hash. Runs are dealt into shards by hash. In each round every
shard trains on from the same weights and Spark averages the results, in whole numbers, so that neither the order of rows
nor the layout of files counts.

Platt scaling on a held-out quarter of all runs, by hash, calibrates the scores. Each SHAPE of candidate has a threshold of its
own, from a histogram of all held-out scores: the largest at which RECALL of its held-out secrets are found, but no lower than
where the tail of the scores of held-out words leaves less than WRONG of them (an exponential tail beyond the TAIL highest).
Where both cannot be had, words win. A table without documents teaches nothing, and nothing is marked by what learned from it.

Defined results: a null or empty text has no span and the SHA-256 of the empty string. Repeated rows each get
a row; an empty table gives no rows; other columns are not looked at. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import discard, stored, table, texts

KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# a count and a star are matched faster than a count without end
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12}[A-Za-z0-9+/_=-]*")
RUN_OR_WORD = re.compile(r"[A-Za-z0-9+/_=-]{8}[A-Za-z0-9+/_=-]*")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Made-up candidates, alone and planted: this many where there are few documents, at least one of each from any document.
GENERATED = 6000
RECALL = 0.99
#: What a candidate is made of: letters of one case (or a capital and small ones), letters otherwise, letters joined by signs, and all others.
SHAPES = ("word", "letters", "compound", "mixed")
#: Share of what is no secret that the threshold of each shape may let through, next to none of what looks like words; and share of
#: the highest held-out scores that show how their tail falls.
WRONG, TAIL = (1e-6, 1e-4, 1e-6, 1e-3), 0.05
PLAIN = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
COMMON = 3
#: Windows that are scored at once, whatever the batch of texts holds.
SCORED = 8192
CONTEXT, INSIDE = 12, 40
WIDTH = INSIDE + 2 * CONTEXT
STEP = 28
EMBEDDING, FILTERS, REACH = 8, 40, 5

#: Where an example comes from.
SETTLED, SHORT, WORDS, COMPOUND, MADE, PLANTED = range(6)
#: Examples of a shard; rounds after which shards are averaged; forms of a word, one of which is learned in a pass; least steps in all.
SHARD, ROUNDS, FORMS, STEPS, BATCH = 1 << 17, 8, 4, 2000, 128
#: Examples that a task of texts holds at once, and candidates made into windows at once.
HELD, STRIP = 1 << 17, 1 << 13
#: Weights are averaged in units of 1 / FIXED; held-out scores are counted in steps of 1 / CELLS.
FIXED, CELLS = 1 << 40, 1 << 10

Span = tuple[int, int, int]


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """(start, kind, end) of the base patterns' matches, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    for a, b in runs:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)]
    return sorted(found)


def key_runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in RUN.finditer(text)]


def covered(spans: list[Span], a: int, b: int) -> bool:
    return any(s < b and a < e for s, _, e in spans)


def uncovered(spans: list[Span], a: int, b: int) -> list[tuple[int, int]]:
    """The parts of a run outside the spans, which are in order."""
    out, at = [], a
    for s, _, e in spans:
        if s >= b:
            break
        if s > at:
            out.append((at, s))
        at = max(at, e)
    return out + [(at, b)] if at < b else out


def windows(candidates: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character codes, one row of WIDTH for each window over a candidate (given with what stands before and behind it), how
    many of them lie inside it (from CONTEXT on), and whose window it is."""
    lines, inside, owner = [], [], []
    for i, (before, run, after) in enumerate(candidates):
        whole = before[-CONTEXT:].rjust(CONTEXT, "\0") + run + after[:CONTEXT]
        for at in range(0, max(1, len(run) - (INSIDE - STEP)), STEP):
            n = min(INSIDE, len(run) - at)
            lines.append(whole[at : at + n + 2 * CONTEXT].ljust(WIDTH, "\0"))
            inside.append(n)
            owner.append(i)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(codes, 127).astype(np.uint8).reshape(-1, WIDTH), np.array(inside, np.uint8), np.array(owner, np.int32)


def marks(inside: np.ndarray, width: int = WIDTH) -> np.ndarray:
    at = np.arange(width)
    return ((at >= CONTEXT) & (at < CONTEXT + inside[:, None].astype(int))).astype(np.float32)


def shape_of(run: str) -> int:
    """The place in SHAPES of what a candidate is made of."""
    if run.isalpha():
        return 0 if PLAIN.fullmatch(run) else 1
    return 2 if not any(c.isdigit() for c in run) else 3


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class SecretNet:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        k = REACH * (EMBEDDING + 1)
        self.p = {
            "e": r.normal(0, 0.5, (128, EMBEDDING)).astype(np.float32), "w": r.normal(0, k**-0.5, (k, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32), "v": r.normal(0, 0.3, FILTERS).astype(np.float32), "c": np.zeros(1, np.float32),
        }
        self.scale, self.shift, self.thresholds = 1.0, 0.0, np.full(len(SHAPES), 0.5)

    def filtered(self, x: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The convolution without its bias: filters, windows, positions."""
        n = x.shape[1] - REACH + 1
        h = np.empty((EMBEDDING + 1, *x.shape), np.float32)
        np.take(np.ascontiguousarray(self.p["e"].T), x, axis=1, out=h[:EMBEDDING], mode="clip")
        h[EMBEDDING] = mark
        cols = np.empty((REACH, EMBEDDING + 1, len(x), n), np.float32)
        for j in range(REACH):
            cols[j] = h[:, :, j : j + n]
        return (self.p["w"].T @ cols.reshape(len(self.p["w"]), -1)).reshape(FILTERS, len(x), n)

    def highest(self, x: np.ndarray, inside: np.ndarray, group: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows (their places) and their convolution. A group of like length goes together; of what is empty behind them a window
        keeps one reach, which all else there equals."""
        order = np.argsort(inside, kind="stable")
        for i in range(0, len(x), group):
            own = order[i : i + group]
            width = min(WIDTH, 2 * CONTEXT + int(inside[own[-1]]) + REACH)
            yield own, self.filtered(x[own, :width], marks(inside[own], width))

    def logits(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for own, a in self.highest(x, inside, BATCH):
            out[own] = self.p["v"] @ np.maximum(a.max(axis=2) + self.p["b"][:, None], 0) + self.p["c"][0]
        return out

    def gradients(self, x: np.ndarray, inside: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        at, best = np.empty((FILTERS, len(x)), np.intp), np.empty((FILTERS, len(x)), np.float32)
        for own, a in self.highest(x, inside, max(1, BATCH // 4)):
            place = a.argmax(axis=2)
            at[:, own], best[:, own] = place, np.take_along_axis(a, place[:, :, None], axis=2)[:, :, 0]
        top = np.maximum(best + self.p["b"][:, None], 0)
        d = ((sigmoid(self.p["v"] @ top + self.p["c"][0]) - y) / len(y)).astype(np.float32)
        back = d[None, :] * self.p["v"][:, None] * (top > 0)
        near = at + np.arange(REACH)[:, None, None]  # reach, filters, windows
        codes = x.ravel()[near + np.arange(len(x)) * x.shape[1]] + np.arange(REACH * FILTERS).reshape(REACH, FILTERS, 1) * 128
        weights = np.broadcast_to(back, near.shape)
        by_code = np.bincount(codes.ravel(), weights.ravel(), REACH * FILTERS * 128).reshape(REACH, FILTERS, 128).astype(np.float32)
        w = self.p["w"].reshape(REACH, EMBEDDING + 1, FILTERS)
        marked = (back * ((near >= CONTEXT) & (near < CONTEXT + inside.astype(int)))).sum(axis=2)
        return {
            "v": top @ d, "c": np.array([d.sum()], np.float32), "b": back.sum(axis=1), "e": (w[:, :EMBEDDING] @ by_code).sum(axis=0).T,
            "w": np.concatenate([(by_code @ self.p["e"]).transpose(0, 2, 1), marked[:, None]], axis=1).reshape(self.p["w"].shape),
        }

    def calibrate(self, z: np.ndarray, shape: np.ndarray, truth: np.ndarray, n: np.ndarray) -> None:
        """From the held-out logits: n candidates of each logit, shape and label."""
        share = n / max(n.sum(), 1)
        for _ in range(500 if len(z) else 0):
            e = (sigmoid(self.scale * z + self.shift) - truth) * share
            self.scale, self.shift = self.scale - 0.2 * (e * z).sum() / (1 + (z * z * share).sum()), self.shift - 0.2 * e.sum()
        of = [[(z[m], n[m]) for m in ((shape == k) & (truth == label) for label in (1, 0))] for k in range(len(SHAPES))]
        self.thresholds = np.array([self.threshold(*of[k], WRONG[k]) for k in range(len(SHAPES))])

    def threshold(self, secrets: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray], wrong: float) -> float:
        """In calibrated score, from the held-out logits of one shape and how many candidates have each."""
        found = ranked(*secrets, int((1 - RECALL) * secrets[1].sum())) if len(secrets[0]) else 0.0
        z, n = others
        if n.sum() * TAIL >= 5:
            start = ranked(z, n, int((1 - TAIL) * (n.sum() - 1)))
            beyond = z > start
            mean = ((z - start) * n)[beyond].sum() / n[beyond].sum() if beyond.any() else 0.0
            found = max(found, start + mean * np.log(TAIL / wrong))
        return float(sigmoid(self.scale * found + self.shift))

    def score(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.logits(x, inside) + self.shift)


def ranked(z: np.ndarray, n: np.ndarray, place: int) -> float:
    """The value at a place, from 0, of all in order, where z stands n times."""
    order = np.argsort(z)
    return float(z[order][np.searchsorted(np.cumsum(n[order]), place, side="right")])


def drawn(r: random.Random, words: list[str], k: int, fit) -> list[str]:
    """k of the words that fit, drawn with replacement; none if none fits. The words are only gone through if few fit."""
    out = []
    for _ in range(8 * k if words else 0):
        if fit(word := words[int(r.random() * len(words))]):
            out.append(word)
            if len(out) == k:
                return out
    own = [w for w in words if fit(w)]
    return r.choices(own, k=k) if own else []


def short(word: str) -> bool:
    return len(word) < 12


def plain_short(word: str) -> bool:
    return len(word) < 12 and word.isascii() and word.isalpha()


def generated(words: list[str], n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): made-up keys and their parts beside hex, and numbers, dates, identifiers and compounds, among words
    too short for a candidate.

    The seed also settles with which kind they begin."""
    r = random.Random(seed)
    upper, lower, digits, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"

    def draw(chars: str, k: int) -> str:
        return "".join(r.choices(chars, k=k))

    def some(k: int, fit=short) -> list[str]:
        return drawn(r, words, k, fit) or ["and"] * k

    secret = [
        lambda: draw(hexa, r.choice([32, 40, 64])), lambda: draw(upper + lower + digits + "+/", r.randrange(24, 64)) + "=" * r.randrange(0, 3),
        lambda: "AKIA" + draw(upper + digits, 16), lambda: "ghp_" + draw(upper + lower + digits, 36), lambda: "sk-" + draw(upper + lower + digits, 32), lambda: draw(upper + lower + digits + "_-", r.randrange(20, 48)),
        lambda: draw(upper + lower, r.randrange(12, 40)), lambda: draw(lower, r.randrange(12, 40)), lambda: draw(upper, r.randrange(12, 40)),
        lambda: draw(upper + lower + digits, r.randrange(12, 20)), lambda: ("ghp_", "sk-", "")[r.randrange(0, 3)] + draw(upper + lower, 4) + draw(hexa, 20) + draw(upper + lower + digits, r.randrange(6, 24)),
    ]
    plain = [
        lambda: draw(digits, r.randrange(16, 20)), lambda: "-".join(draw(digits, int(k)) for k in (4, 4, 4, 4)), lambda: "-".join([f"20{draw(digits, 2)}", "01", "15", *some(2)]),
        lambda: "_".join([*some(3), draw(digits, 2)]), lambda: "/".join([*some(3), draw(digits, 4)]), lambda: "".join(some(4)) + draw(digits, 1), lambda: "=" * r.randrange(16, 40) + "1",
        lambda: "".join(some(3, plain_short)), lambda: "".join(some(2, plain_short)).upper(), lambda: "".join(w.title() for w in some(3, plain_short)), lambda: "-=_/"[r.randrange(0, 4)] * r.randrange(12, 60),
        lambda: "-".join(some(4, plain_short)), lambda: "_".join(some(3, plain_short)), lambda: "/".join(some(4, plain_short)), lambda: draw(digits, r.randrange(12, 16)),
    ]
    out = []
    for i in range(seed, seed + n):
        kinds = secret if i % 2 else plain
        value, before, after = kinds[r.randrange(0, len(kinds))](), " ".join(some(3)) + " ", " " + " ".join(some(3))
        if len(value) >= 12:
            text, a, b = before + value + after, len(before), len(before) + len(value)
            out.append((text, a, b, i % 2))
            parts = uncovered([(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)], a, b)
            out += [(text, *p, 1) for p in parts if i % 2 and p != (a, b) and p[1] - p[0] >= 6]
        if i % 8 == 0:  # a name before an assignment
            name = "_".join(some(r.randrange(1, 3), plain_short)) + "_"
            out.append((before + name + "token=" + secret[1]() + after, len(before), len(before) + len(name), 0))
    return out


def settled(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, label, kind) of the text's runs whose kind the patterns settle, of its runs of letters, of names before an
    assignment, of words too short for a candidate, and of runs without digits, which are known once they are counted."""
    runs, out = [], []
    for m in RUN_OR_WORD.finditer(text):
        a, b = m.span()
        if b - a >= 12:
            runs.append((a, b))
        elif m[0].isalpha():
            out.append((a, b, 0, SHORT))
    spans = base_spans(text, runs)
    keys = [s for s in spans if s[1] < 2]
    for a, b in runs:
        run = text[a:b]
        if covered(keys, a, b):
            out.append((a, b, 1, SETTLED))
            out += [(p, q, 0, SETTLED) for p, q in uncovered(spans, a, b) if q - p < 12 and any(s[0] == q and s[1] == 0 for s in spans)]
        elif not any(c.isalpha() for c in run):
            out.append((a, b, 0, SETTLED))
        elif run.isalpha() and not covered(spans, a, b):
            out.append((a, b, 0, WORDS))
        elif not any(c.isdigit() for c in run):
            out.append((a, b, 0, COMPOUND))
    return out


def planted(rows: list[tuple[str, int, int, int]], into: str, seed: int) -> list[tuple[str, int, int, int]]:
    """Made-up candidates put between two words of the document."""
    r = random.Random(seed)
    out = []
    for text, a, b, label in rows:
        at = into.find(" ", r.randrange(len(into))) if into else 0
        at = max(0, at if at >= 0 else into.find(" "))
        before, after = into[max(0, at - CONTEXT) : at] + " ", " " + into[at + 1 : at + 1 + CONTEXT]
        out.append((before + text[a:b] + after, len(before), len(before) + b - a, label))
    return out


def examples(docs: DataFrame, made: int) -> DataFrame:
    """kind, label, run and its surroundings (`at`: a hash of run and text, before, after), each run of a kind and label once.

    Of a kind that must be counted there is a row for each different text (source)."""
    columns = ["kind", "label", "run", "source", "rank", "before", "after"]

    def frame(seen: dict[tuple[int, int], dict[str, tuple]]) -> pd.DataFrame:
        rows = [(*about, *key.partition(" ")[::2], *at) for about, found in seen.items() for key, at in found.items()]
        return pd.DataFrame(rows, columns=columns)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {(kind, label): {} for kind in range(6) for label in (0, 1)}
        for b in batches:
            for text in b["text"].unique():
                data = text.encode()
                seed = zlib.crc32(data)
                own = [(text, *x) for x in settled(text)]
                keys = generated(text.split(), made, seed)
                own += [(*x, MADE) for x in keys] + [(*x, PLANTED) for x in planted(keys, text, seed)]
                source = ""
                for t, p, q, label, kind in own:
                    key = run = t[p:q]
                    if kind == COMPOUND:  # no run holds a space
                        source = source or hashlib.md5(data).hexdigest()
                        key = f"{run} {source}"
                    found, rank = seen[kind, label], zlib.crc32(run.encode(), seed)
                    known = found.get(key)
                    if known is None or rank <= known[0]:
                        at = (rank, t[max(0, p - CONTEXT) : p], t[q : q + CONTEXT])
                        if known is None or at < known:
                            found[key] = at
                if sum(map(len, seen.values())) >= HELD:
                    yield frame(seen)
                    for one in seen.values():
                        one.clear()
        yield frame(seen)

    rows = docs.select("text").mapInPandas(gather, "kind int, label int, run string, source string, rank long, before string, after string")
    return rows.groupBy("kind", "label", "run", "source").agg(F.min(F.struct("rank", "before", "after")).alias("at"))


def known(found: DataFrame) -> DataFrame:
    """The examples to learn from: compounds only where COMMON texts share them."""
    shared = found.filter(F.col("kind") == COMPOUND).groupBy("kind", "label", "run").agg(F.min("at").alias("at"), F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    return found.filter(F.col("kind") != COMPOUND).drop("source").unionByName(shared.drop("n"))


def packed(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard of examples as the bytes of arrays of windows: x, inside, y, owner (the candidate), shape, turn (the pass in
    which it is learned; FORMS: in each) and held (not learned); n: windows learned in a pass, about."""
    rows = rows.sort_values(["rank", "run", "kind", "label"], kind="stable").reset_index(drop=True)
    words = rows.loc[rows["kind"] == WORDS, "run"].tolist()
    candidates, about, at = [], [], 0
    for kind, label, run, rank, before, after in rows[["kind", "label", "run", "rank", "before", "after"]].itertuples(index=False):
        held = zlib.crc32(run.encode()) % 4 == 0
        forms, turn = [run], FORMS
        if kind == SHORT:
            turn = rank % FORMS
        elif kind == WORDS:
            at += 1
            other = words[at % len(words)]
            joint = run[: len(run) // 2] + other[len(other) // 2 :]
            forms = [run, run.upper(), (run.lower(), run.title())[rank % 2], (joint.upper(), joint.lower())[rank // 2 % 2]]
        for i, form in enumerate(forms):
            if kind != WORDS or (len(form) >= 12 and form not in forms[:i]):
                candidates.append((before, form, after))
                about.append((label, shape_of(form), i if kind == WORDS else turn, held))
    parts = []
    for i in range(0, max(len(candidates), 1), STRIP):
        x, inside, owner = windows(candidates[i : i + STRIP])
        parts.append((x, inside, owner + np.int32(i)))
    x, inside, owner = (np.concatenate(part) for part in zip(*parts))
    y, shape, turn, held = np.array(about, np.uint8).reshape(-1, 4)[owner].T
    n = round(((held == 0) * np.where(turn == FORMS, 1, 1 / FORMS)).sum())
    return pd.DataFrame([[n, *(np.ascontiguousarray(part).tobytes() for part in (x, inside, y, owner, shape, turn, held))]], columns=["n", *PARTS])


PARTS = {"x": np.uint8, "inside": np.uint8, "y": np.uint8, "owner": np.int32, "shape": np.uint8, "turn": np.uint8, "held": np.uint8}


def opened(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of each shard."""
    for b in batches:
        for row in b.itertuples(index=False):
            own = {k: np.frombuffer(getattr(row, k), kind) for k, kind in PARTS.items()}
            yield own | {"x": own["x"].reshape(-1, WIDTH)}


class Learner:
    """A network with the moments of Adam, as one vector for Spark to average."""

    def __init__(self) -> None:
        self.net = SecretNet()
        self.m, self.v = ({k: np.zeros_like(z) for k, z in self.net.p.items()} for _ in range(2))

    def vector(self) -> np.ndarray:
        return np.concatenate([part[k].ravel() for part in (self.net.p, self.m, self.v) for k in sorted(part)]).astype(np.float64)

    def take(self, vector: np.ndarray) -> Learner:
        at = 0
        for part in (self.net.p, self.m, self.v):
            for k in sorted(part):
                part[k] = vector[at : at + part[k].size].reshape(part[k].shape).astype(np.float32)
                at += part[k].size
        return self

    def run(self, shard: dict[str, np.ndarray], t: int, steps: int, first: int, local: int, passes: int, rate: float = 5e-3) -> None:
        """The passes from first on, each of the given steps; t steps were made before."""
        for at in range(first, first + local):
            own = np.nonzero((shard["held"] == 0) & ((shard["turn"] == FORMS) | (shard["turn"] == at % FORMS)))[0]
            order = np.random.default_rng(at).permutation(own)
            for i, batch in enumerate(np.array_split(order, steps)):
                t += 1
                if len(batch):
                    self.step(self.net.gradients(shard["x"][batch], shard["inside"][batch], shard["y"][batch].astype(np.float32)), t, rate * (1 - 0.95 * (at + i / steps) / passes))

    def step(self, gradients: dict[str, np.ndarray], t: int, rate: float) -> None:
        for k, g in gradients.items():
            self.m[k], self.v[k] = 0.9 * self.m[k] + 0.1 * g, 0.999 * self.v[k] + 0.001 * g * g
            self.net.p[k] = (self.net.p[k] - rate * (self.m[k] / (1 - 0.9**t)) / (np.sqrt(self.v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def one_round(shards: DataFrame, vector: np.ndarray, t: int, steps: int, first: int, local: int, passes: int) -> np.ndarray:
    """The mean of what the shards make of the vector."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(vector), np.int64), 0
        for shard in opened(batches):
            learner = Learner().take(vector)
            learner.run(shard, t, steps, first, local, passes)
            total, n = total + np.rint(learner.vector() * FIXED).astype(np.int64), n + 1
        if n:
            yield pd.DataFrame({"place": np.arange(len(total)), "total": total, "n": n})

    sums = shards.mapInPandas(learn, "place int, total long, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = np.zeros(len(vector))
    for place, total, n in sums.collect():
        out[place] = total / n / FIXED
    return out


def held_out(shards: DataFrame, net: SecretNet) -> list:
    """(shape, label, logit in steps of 1 / CELLS, candidates) of all that was not learned; a candidate's logit is its highest window's."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard in opened(batches):
            own = shard["held"] == 1
            place, at = np.unique(shard["owner"][own], return_inverse=True)
            top, about = np.full(len(place), -np.inf), np.zeros(len(place), int)
            np.maximum.at(top, at, net.logits(shard["x"][own], shard["inside"][own]))
            about[at] = shard["shape"][own] * 2 + shard["y"][own]
            cells = pd.DataFrame({"about": about, "cell": np.floor(np.clip(top, -30, 30) * CELLS).astype(int)})
            yield cells.groupby(["about", "cell"]).size().reset_index(name="n")

    counts = shards.mapInPandas(count, "about long, cell long, n long").groupBy("about", "cell").agg(F.sum("n"))
    return [(about // 2, about % 2, cell, n) for about, cell, n in counts.orderBy("about", "cell").collect()]


def train(docs: DataFrame) -> SecretNet:
    """docs: doc_id and text, none null."""
    learner, n = Learner(), docs.count()
    if not n:
        learner.net.thresholds[:] = np.inf
        return learner.net
    found = stored(examples(docs, -(-GENERATED // n)), "secret_examples")
    count = -(-found.count() // SHARD)
    dealt = known(found).select("kind", "label", "run", "at.*", F.pmod(F.xxhash64("run"), F.lit(count)).alias("shard"))
    shards = stored(dealt.groupBy("shard").applyInPandas(packed, "n long, " + ", ".join(f"{k} binary" for k in PARTS)), "secret_shards")
    discard(found)
    steps = max(1, round(shards.agg(F.avg("n")).first()[0] / BATCH))
    local = max(1, -(-STEPS // (ROUNDS * steps)))
    vector = learner.vector()
    for i in range(ROUNDS):
        vector = one_round(shards, vector, i * local * steps, steps, i * local, local, ROUNDS * local)
    net = learner.take(vector).net
    shape, truth, cell, n = np.array(held_out(shards, net), float).reshape(-1, 4).T
    net.calibrate(cell / CELLS, shape, truth, n)
    discard(shards)
    return net


def find(texts_: list[str], net: SecretNet) -> list[list[Span]]:
    """All spans of each text; the network scores the candidates of all texts together."""
    spans, owners, candidates, secret, size = [], [], [], set(), 0

    def judge() -> None:
        if owners:
            x, inside, owner = windows(candidates)
            secret.update(owners[o] for o, s in zip(owner, net.score(x, inside)) if s >= net.thresholds[owners[o][3]])
            owners.clear()
            candidates.clear()

    for i, text in enumerate(texts_):
        runs = key_runs(text)
        own = base_spans(text, runs)
        spans.append(own)
        for run in runs:
            for a, b in uncovered(own, *run):
                candidates.append((text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT]))
                owners.append((i, a, b, shape_of(text[a:b])))
                size += max(INSIDE, b - a)
                if size >= SCORED * INSIDE:
                    judge()
                    size = 0
    judge()
    for i, a, b, _ in sorted(secret):
        spans[i].append((a, 3, b))
    return [sorted(own) for own in spans]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, net: SecretNet | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of docs."""
    plain = texts(docs)
    held = docs.sparkSession.sparkContext.broadcast(net or train(plain.filter(F.col("doc_id").isNotNull())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = find(list(b["text"]), held.value)
            out = {"doc_id": b["doc_id"]}
            for k in range(3):
                out[f"n_{KINDS[k]}"] = [sum(s[1] == k for s in own) for own in found]
            out["base_sha256"] = [hashlib.sha256(joined([s for s in own if s[1] < 3]).encode()).hexdigest() for own in found]
            out["spans"] = [joined(own) for own in found]
            yield pd.DataFrame(out)

    return plain.mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MASK = "[secret]"


def redacted(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            out += [text[at:a], MASK] if a >= at else []
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: SecretNet | None = None) -> DataFrame:
    """docs with every found span replaced by MASK, n_chars (where there is one) counted anew, all else as it was."""
    held = docs.sparkSession.sparkContext.broadcast(net or train(texts(docs).filter(F.col("doc_id").isNotNull())))

    @F.pandas_udf("string")
    def masked(values: pd.Series) -> pd.Series:
        found = find(["" if v is None else v for v in values], held.value)
        return pd.Series([v if v is None else redacted(v, own) for v, own in zip(values, found)], dtype=object)

    out = docs.withColumn("text", masked("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op4_secret_scan": op4_secret_scan}
