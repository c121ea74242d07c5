"""Periodic runs, Merkle manifest and SimHash components against plain recomputations."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from driftline.llm import merkle_manifest, periodic_runs, simhash_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(doc_id, text):
    """The row of a document, by comparing all words a period apart."""
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(24, 3 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    runs = sorted((s, p, e) for (s, e), p in found.items())
    dropped = {w for s, p, e in runs for w in range(s + p, e)}
    best = min(runs, key=lambda r: (-Fraction(r[2] - r[0], r[1]), r[0], r[1])) if runs else None
    top = (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4
    listed = "".join(f"{s},{e - s},{p}\n" for s, p, e in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def periodic_texts():
    r = random.Random(5)
    word = lambda k: f"w{r.randrange(k)}"
    out = ["a", "a " * 23, "a " * 24, "a b " * 12, "a b c d e f g h i " * 3, "x\x1cy z " * 30, "a\x0bb\x0cc\t" * 40, "A a " * 30]
    for k in range(250):
        text = [word(3 + k % 40) for _ in range(r.randrange(60))]
        for _ in range(r.randrange(4)):
            unit = [word(2 + k % 7) for _ in range(r.randrange(1, 15))]
            text += unit * r.randrange(1, 12) + unit[: r.randrange(len(unit))] + [word(9) for _ in range(r.randrange(5))]
        out.append(r.choice([" ", "  ", "\n"]).join(text))
    return out


def test_runs_equal_brute_force(spark):
    rows = [(k if k % 17 else None, t) for k, t in enumerate(periodic_texts())] + [(3000, None), (3001, ""), (3002, " \n")]
    got = sorted(map(tuple, periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted((brute_runs(*r) for r in rows), key=str)
    assert sum(r[1] > 1 for r in got) > 20


def test_runs_of_odd_rows(spark, odd, odd_rows, empty):
    got = sorted(map(tuple, periodic_runs.periodic_runs(odd).collect()), key=str)
    assert got == sorted((brute_runs(r[0], r[1]) for r in odd_rows), key=str)
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_runs_in_small_strips_and_grids(monkeypatch):
    monkeypatch.setattr(periodic_runs, "GRID", 50)
    monkeypatch.setattr(periodic_runs, "STRIP", 400)
    texts = periodic_texts()
    strips = [texts[s] for s in periodic_runs.byte_strips(pa.array(texts))]
    assert sum(strips, []) == texts and len(strips) > 20
    for k, own in enumerate(strips):
        got = periodic_runs.judged(list(range(len(own))), pa.array(own))
        assert [tuple(c[i] for c in got.values()) for i in range(len(own))] == [brute_runs(i, t) for i, t in enumerate(own)], k


def test_a_long_text_of_one_word():
    got = periodic_runs.judged([5], pa.array(["la " * 50_000]))
    assert (got["n_runs"], got["start"], got["length"], got["period"]) == ([1], [0], [50_000], [1])
    assert got["collapsed_sha256"] == [hashlib.sha256(b"la").hexdigest()]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(doc_id, text, lang, source, n_chars):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return digest(*parts)


def brute_tree(hashes):
    """The root, and for each leaf what stands left and right of it on every level."""
    steps, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            steps[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        level, at = [digest(*level[i : i + 8]) for i in range(0, len(level), 8)], [p // 8 for p in at]
    return level[0], steps


def brute_manifest(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    trees = {}
    for r in rows:
        lowered = r[1] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1])
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, brute_leaf(*r), brute_leaf(r[0], lowered if tampered else r[1], *r[2:]), r[0]))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: brute_tree([x[2] for x in sorted(trees[t])]) for t in names}
    root, tops = brute_tree([built[t][0] for t in names])
    out = []
    for t, top in zip(names, tops):
        for x, own in zip(sorted(trees[t]), built[t][1]):
            folded = x[3]
            for before, after in own + top:
                folded = digest(before, folded, after)
            out.append((x[4], x[2], built[t][0], root, digest(*(b + a for b, a in own + top)), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("depth", [1, 4])
def test_manifest_equals_brute_force(spark, odd_rows, depth):
    """Buckets of 8 rows make several storeys, in the languages and above them."""
    r = random.Random(8)
    rows = [x[:5] for x in odd_rows] + [(100 + i, f"Text {i} é", r.choice(["en", "en", None, "", "é", "z", *(f"l{k}" for k in range(70))]), "s", i) for i in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, merkle_manifest.manifest(docs, depth).collect()), key=str)
    assert got == brute_manifest(rows)
    assert 0 < sum(not g[-1] for g in got) < len(got)


def test_manifest_of_odd_tables(spark, odd, empty, odd_rows):
    assert sorted(map(tuple, merkle_manifest.manifest(odd).collect()), key=str) == brute_manifest([x[:5] for x in odd_rows])
    assert merkle_manifest.manifest(empty).count() == 0
    one = spark.createDataFrame([(7, "Alone")], "doc_id long, text string")
    (row,) = merkle_manifest.manifest(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == brute_leaf(7, "Alone", None, None, None) and row["proof_sha256"] == digest()


def brute_print(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """The least member of each distinct print's component, by comparing all pairs."""
    own = np.array(sorted(set(prints)), np.uint64)
    root = np.arange(len(own))
    while True:
        low = np.array([root[np.bitwise_count(own ^ x) <= 3].min() for x in own])
        if (low == root).all():
            return {int(x): int(r) for x, r in zip(own, root)}
        root = low


def test_simhash_of_odd_rows(spark, odd, odd_rows, empty):
    prints = [brute_print(r[1]) for r in odd_rows]
    classes, least = brute_classes(prints), {}
    for r, p in zip(odd_rows, prints):
        if r[0] is not None:
            least[classes[p]] = min(r[0], least.get(classes[p], 1 << 60))
    want = sorted(((r[0], format(p, "016x"), least.get(classes[p])) for r, p in zip(odd_rows, prints)), key=str)
    assert sorted(map(tuple, simhash_dedup.near_components(odd).collect()), key=str) == want
    assert simhash_dedup.near_components(empty).count() == 0


def near_prints():
    """Clusters of prints that differ in few bits, chains among them, and prints that differ in one more bit than allowed."""
    r = random.Random(2)
    out = {0, (1 << 64) - 1, 7, 15}
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.randrange(1, 60)):
            out.add(x)
            y = x
            for b in r.sample(range(64), r.randrange(1, 6)):
                y ^= 1 << b
            out.add(y)
            x = y if r.random() < 0.5 else x
    return out | {r.getrandbits(64) for _ in range(500)}


@pytest.mark.parametrize("cell", [8192, 20, 4])
def test_links_equal_brute_force(spark, monkeypatch, cell):
    """Small cells make keys split by a further segment, then into blocks."""
    monkeypatch.setattr(simhash_dedup, "CELL", cell)
    prints = near_prints()
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    found = simhash_dedup.links(spark.createDataFrame(signed, "print long")).collect()
    root = {p: p for p in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        x, y = sorted((top(a % (1 << 64)), top(b % (1 << 64))))
        root[y] = x
    want = brute_classes(prints)
    groups = lambda f: sorted(sorted(p for p in prints if f(p) == g) for g in {f(p) for p in prints})
    assert groups(top) == groups(want.get)


def test_every_close_pair_shares_a_key():
    r = random.Random(4)
    for _ in range(3000):
        differ = sum(1 << b for b in r.sample(range(64), r.randrange(4)))
        starts = [i for i, mask in simhash_dedup.KEYS if not differ & mask]
        within = [all((differ & simhash_dedup.chain(i, n)).bit_count() <= simhash_dedup.ALLOWED[n] for n in range(9)) for i in starts]
        assert any(within)
