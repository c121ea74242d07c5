"""Registered queries on a small folder: folds, held-out scores, both ways of joining labels, and the whole pipeline by brute force."""

import itertools
import re
import zlib

import numpy as np
import pytest

from driftline.llm import language_id, packing, quality_rules, secret_scan, toxicity
from driftline.llm.common import texts
from test_text_operators import brute_measures, weight, weighted_similarity


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of two invented languages, some toxic, with labels for most of them."""
    r = np.random.default_rng(4)
    parts = {"aa": ["the", "ing", "wh", "ou", "er"], "bb": ["sch", "ung", "ich", "ein", "er"]}
    bad = ["vilething", "vileword", "nastiness"]
    docs, labels = [], []
    for i in range(700):
        lang, toxic = ("aa", "bb")[i % 2], i % 5 == 0
        words = ["".join(r.choice(parts[lang], 2)) for _ in range(40)] + (list(r.choice(bad, 4)) if toxic else [])
        docs.append((i, " ".join(r.permutation(words)), lang if i % 7 else None, "s"))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    docs += [(900, None, "aa", "s"), (901, "", "bb", "s"), (902, "123 !!", None, None), (None, docs[3][1], "bb", "s"), (5, docs[5][1], "bb", "s")]
    labels += [(None, 1, 1), (5, 1, None), (9, 0, 1), (9, 0, 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    return folder, docs


def fold(d, n):
    return None if d is None else zlib.crc32(str(d).encode()) % n


def test_language_query(spark, corpus):
    folder, docs = corpus
    got = language_id.op2_language_id(spark, folder).collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (None if r["doc_id"] is None else fold(r["doc_id"], 4) == 2) for r in got)
    true = {d: ("aa", "bb")[d % 2] for d, *_ in docs if d is not None and d < 700}
    held = [r for r in got if r["held_out"] and r["doc_id"] in true]
    assert len(held) > 100 and np.mean([r["lang_pred"] == true[r["doc_id"]] for r in held]) > 0.97
    assert {r["lang_pred"] for r in got if r["doc_id"] in (900, 901, 902)} == {"und"}


def test_language_sample_holds_every_language(spark, corpus, monkeypatch):
    """The bound is on rows: with room for two rows in all, each of many languages still gets one."""
    monkeypatch.setattr(language_id, "SAMPLE", 2)
    rows = [(i, f"text {i} of", f"l{i % 250}") for i in range(1000)]
    few = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(few) == 250 and len({r["lang"] for r in few}) == 250


@pytest.mark.parametrize("sent", [500_000, 0])
def test_toxicity_query(spark, corpus, sent, monkeypatch):
    monkeypatch.setattr(toxicity, "SENT_LABELS", sent)
    folder, docs = corpus
    got = toxicity.op10_toxicity(spark, folder).collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (None if r["doc_id"] is None else fold(r["doc_id"], 5) == 0) for r in got)
    held = {r["doc_id"]: r["score"] for r in got if r["held_out"] and r["doc_id"] < 700}
    pairs = [a > b for d, a in held.items() if d % 5 == 0 for e, b in held.items() if e % 5]
    assert len(pairs) > 500 and np.mean(pairs) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = brute_measures(text)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    own = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_lines": len(lines),
        "n_shouts": sum(w.endswith("!") for w in words), "n_stop_words": sum(w.lower() in quality_rules.STOP_WORDS for w in words),
    }
    ok = n_words >= 50 and 100 * n_repeat <= 50 * n_words
    for _, ratio, least, most in quality_rules.RULES:
        a, b = (own[c] for c in ratio.split(" / "))
        ok = ok and (not b or ((least is None or a / b >= least) and (most is None or a / b <= most)))
    return ok


def brute_passages(rows):
    first = {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - 49):
            if d is not None:
                first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    out = []
    for d, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        out.append((d, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    return out


def test_pipeline_by_brute_force(spark, tmp_path_factory):
    import corpus_pipeline
    from tokenizers import Tokenizer

    r = np.random.default_rng(12)
    words = ["the", "of", "and", *("".join(r.choice(list("abcdefghiklmnoprstu"), r.integers(3, 9))) for _ in range(400))]
    draw = lambda n: " ".join(w if i % 9 else "the" for i, w in enumerate(r.choice(words, n)))
    shared, docs = draw(70), []
    for i in range(60):
        docs.append((i, draw(30) + " " + shared + " " + draw(40) if i % 6 == 0 else draw(90)))
    docs += [(100, docs[1][1]), (101, docs[1][1].replace(docs[1][1].split()[40], "changed")), (102, "short one"), (103, "# # # " * 40), (104, draw(60) + ' password = "abcdefghij123456" ' + draw(20)), (105, None), (None, draw(80))]
    folder = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")

    good = [(d, t) for d, t in docs if brute_quality(t)]
    known = [(d, t) for d, t in good if d is not None]
    label = {d: d for d, _ in known}
    held = {d: weight(t) for d, t in known}
    for _ in range(3):
        for a, b in itertools.combinations(label, 2):
            if weighted_similarity(held[a], held[b]) >= 0.8:
                label[a] = label[b] = min(label[a], label[b])
    kept = [(d, t) for d, t in good if d is None or label[d] == d]
    assert len(good) < len(docs) - 2 and len(kept) == len(good) - 2
    kept = brute_passages(kept)
    net = secret_scan.train(texts(spark.createDataFrame(kept, "doc_id long, text string")).filter("doc_id is not null"))
    masked = [(d, secret_scan.redacted(t, own)) for (d, t), own in zip(kept, secret_scan.find([t for _, t in kept], net))]
    assert sum(secret_scan.MASK in t for _, t in masked) >= 1

    encode = Tokenizer.from_file(packing.tokenizer_file())
    want = []
    for d, t in masked:
        ids = np.array([*encode.encode(t, add_special_tokens=False).ids, packing.END], "<u4")
        want.append((d, 0, len(ids), zlib.crc32(ids.tobytes()), len(ids)))
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted((tuple(x)[:5] for x in out), key=str) == sorted(want, key=str)
    by_sequence = {}
    for x in out:
        by_sequence.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
