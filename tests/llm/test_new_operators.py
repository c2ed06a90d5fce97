"""Byte pairs, spelling variants and the Merkle manifest against brute force, and their defined results for odd rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, docs, empty, odd_rows  # noqa: F401
from wayfare.llm import byte_pairs, merkle, spelling
from wayfare.llm.queries import BYTE_RANKS, QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    import tiktoken

    path = tokenizer_path(BYTE_RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_pairs.Coder(path, public_tokenizers.PATTERN), theirs, public_tokenizers.PATTERN


ALPHABETS = ["ab", "aaab", "etaoinshrdlu", "éèüßabc", "   \n\t", "!?.-=", "中文字漢", "0123456789", "aé中😀 .1\n'"]


def test_byte_pairs_are_the_tokenizers_ids(both):
    ours, theirs, _ = both
    draw = random.Random(3)
    for k in range(600):
        letters = draw.choice(ALPHABETS)
        text = "".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 2, 7, 40, 300, 3000] if k % 10 == 0 else [0, 1, 2, 7, 40, 90])))
        ids = ours.encode(text).tolist()
        assert ids == theirs.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()


def test_halves_join_as_merging_does(both):
    ours, *_ = both
    draw = random.Random(5)
    for _ in range(300):
        data = bytes(draw.choice(b"aaabbcdet the") for _ in range(draw.randrange(2, 400)))
        cut = draw.randrange(1, len(data))
        whole = ours._long(data)
        assert ours._pairs(data) == whole == ours.reduced(data)
        assert ours.join(ours._long(data[:cut]), ours._long(data[cut:])) == whole


def test_texts_longer_than_a_run(both, monkeypatch):
    ours, theirs, _ = both
    monkeypatch.setattr(byte_pairs, "RUN", 16)
    monkeypatch.setattr(byte_pairs, "PIECES", 8)
    text = "many different words, one after another " * 20 + "x" * 5000
    assert ours.encode(text).tolist() == theirs.encode_ordinary(text)
    assert ours.decode(ours.encode(text).tolist()) == text.encode()


def test_byte_pairs_of_odd_rows(both, docs, empty):  # noqa: F811
    _, theirs, pattern = both
    rows = byte_pairs.encoded(docs, tokenizer_path(BYTE_RANKS), pattern)
    assert {c for c in docs.columns} == set(rows.select("row.*").columns)
    got = rows.select("row.doc_id", "row.text", "ids", "back", byte_pairs.decoded(F.col("ids"), tokenizer_path(BYTE_RANKS), pattern).alias("again")).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert r["ids"] == theirs.encode_ordinary(r["text"] or "")
        assert bytes(r["back"]) == bytes(r["again"]) == (r["text"] or "").encode()
    assert byte_pairs.encoded(empty, tokenizer_path(BYTE_RANKS), pattern).count() == 0


def test_byte_pairs_query(spark, both, small):
    _, theirs, _ = both
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op11_byte_pairs"](spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = theirs.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_variants(words):
    out = {}
    for w, n in words.items():
        found = [x for x in words if near(w, x)]
        best = min(found, key=lambda x: (-words[x], x.encode()), default=None)
        out[w] = [n, len(found), best if best and words[best] >= 5 * n else None]
    for entry_word, entry in out.items():
        root = entry_word
        while out[root][2]:
            root = out[root][2]
        entry.append(root)
    return out


def found_variants(rows):
    return {r["word"]: [r["n"], r["n_near"], r["form"], r["root"]] for r in rows.collect()}


def test_spelling_variants(spark, docs, empty):  # noqa: F811
    draw = random.Random(7)
    stems = ["thousand", "Thousand", "banana", "Bananas", "élégante", "Élégante", "mississippi", "aaaaaaaa", "stressed", "desserts"]
    words = []
    for _ in range(1500):
        w = draw.choice(stems)
        if draw.random() < 0.3:
            i = draw.randrange(len(w))
            w = draw.choice([w[:i] + w[i + 1 :], w[:i] + draw.choice("aesx") + w[i:], w[:i] + draw.choice("aesx") + w[i + 1 :]])
        words.append(w)
    # A chain of forms: each eight times as often as the one before.
    words += ["chainaaa"] * 6 + ["chainaab"] * 48 + ["chainabb"] * 400 + ["chainbbb"] * 3200
    draw.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)] + [(3, words[0]), (None, " ".join(words[::9])), (None, None), (50, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "key", "form", "a", "b")})
    want = plain_variants(plain_words(rows))
    assert want["chainaaa"][3] == "chainbbb" and sum(e[2] is not None for e in want.values()) > 5
    assert found_variants(spelling.variants(table)) == want
    assert found_variants(spelling.variants(docs)) == plain_variants(plain_words([r[:2] for r in odd_rows()]))
    assert spelling.variants(empty).count() == 0


def test_spelling_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    words = plain_words(rows)
    got = {r["word"]: r for r in QUERIES["op12_spelling"](spark, small).collect()}
    assert {w: r["n"] for w, r in got.items()} == words
    assert all(r["form"] is None or r["form_n"] == words[r["form"]] >= 5 * r["n"] for r in got.values())


def test_counts_are_flushed_whole(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 3)
    rows = [(i, "Walking walking TALKING talking listening reading " * 9) for i in range(30)]
    got = {r["word"]: r["n"] for r in spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_words(rows)


def test_near_words_share_a_signature():
    draw = random.Random(11)
    for _ in range(400):
        a = "".join(draw.choice("abcde") for _ in range(draw.randrange(6, 12)))
        i = draw.randrange(len(a))
        replaced, inserted = a[:i] + draw.choice("fgh") + a[i + 1 :], a[:i] + draw.choice("abfg") + a[i:]
        x, y = spelling.part_enum([a, replaced], 2, spelling.PARTS_TWO)
        assert set(x.tolist()) & set(y.tolist())
        x, y = spelling.part_enum([a, inserted], 1, spelling.PARTS_ONE)
        assert set(x.tolist()) & set(y.tolist())


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_way(levels, i):
    way = []
    for level in levels[:-1]:
        start = i - i % 16
        way.append((level[start:i], level[i + 1 : start + 16]))
        i //= 16
    return way


def plain_manifest(rows, tampered):
    """rows: (doc_id, text, lang, source, n_chars)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append(r)
    leaf_of = lambda r: plain_leaf((r[0], r[3], r[2], r[4], r[1]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    levels = {s: plain_tree([leaf_of(r) for r in trees[s]]) for s in order}
    top = plain_tree([levels[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(trees[s]):
            way = plain_way(levels[s], i) + plain_way(top, k)
            node = leaf_of(r)
            if tampered(r) and r[1] is not None:
                node = leaf_of((r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:]))
            for before, after in way:
                node = h("".join(before) + node + "".join(after))
            proof = h("".join("".join(b + a) for b, a in way))
            out.append((r[0], leaf_of(r), levels[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def fifth(r):
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0


def found_manifest(frame, levels=3):
    changed = {"text": F.translate("text", merkle.UPPER, merkle.LOWER)}
    on = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.manifest(frame, ["doc_id", "source", "lang", "n_chars", "text"], tree="source", key="doc_id", changed=changed, if_changed=on, levels=levels)
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)


def test_positions_are_those_of_the_log():
    for n in (1, 2, 15, 16, 17, 31, 32, 255, 256, 257, 272, 273, 4095, 4096, 300 * 16 + 1):
        builder = merkle._Builder(0, 0, min(n, 4096), 3)
        for i in range(builder.n):
            builder.add(0, h(str(i)))
        builder.end()
        levels = plain_tree([h(str(i)) for i in range(builder.n)])
        log = [x[4].hex() for x in builder.taken()]
        assert len(log) == sum(map(len, levels))
        for level, digests in enumerate(levels):
            for i, d in enumerate(digests):
                assert log[merkle.position(builder.n, level, i)] == d
    # A second run goes on where the first one ends.
    assert merkle.position(5000, 0, 4096) == merkle.position(5000, 3, 0) + 1


@pytest.mark.parametrize("levels", [3, 1])
def test_manifest(spark, docs, empty, levels):  # noqa: F811
    sizes = {"a": 1, None: 2, "B": 16, "é": 17, "z": 300, "c": 257, "": 5}
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i if i % 50 else None, f"Text {i % 7}" if i % 11 else None, "en" if i % 3 else None, source, i % 7 or None))
    rows += [(900 + k, "UP", None, f"s{k:02}", 2) for k in range(40)] + rows[20:60]
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    got = found_manifest(frame, levels)
    assert got == plain_manifest(rows, fifth)
    assert {g[-1] for g in got} == {True, False}
    assert found_manifest(docs, levels) == plain_manifest(odd_rows(), fifth)
    assert found_manifest(empty, levels) == []


def test_manifest_query_with_whole_proofs(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = QUERIES["op13_merkle"](spark, small)
    assert sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr) == plain_manifest(rows, fifth)
    whole = merkle.manifest(spark.read.parquet(f"{small}/documents.parquet"), ["doc_id", "text"], tree="source", key="doc_id", whole=True).collect()
    assert all(h(r["proof"]) == r["proof_sha256"] and r["verified"] for r in whole)


def test_suffix_dedup_query_shows_what_stays(spark, small):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op6_suffix_dedup"](spark, small).collect()
    starts = Counter(t[i : i + 400] for t in texts.values() for i in range(len(t) - 399))
    for r in got:
        raw = texts[r["doc_id"]]
        gone = bytearray(len(raw))
        for i in range(len(raw) - 399):
            if starts[raw[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        assert (r["n_removed"], r["kept_sha256"]) == (sum(gone), hashlib.sha256(kept).hexdigest())
        assert r["text"].replace("�", "") == kept.decode(errors="ignore").replace("�", "")


def test_hinge_loss_is_at_its_least():
    """The dual gives a lower bound of the loss: both meet at the optimum."""
    import numpy as np

    from wayfare.llm import quality_classifier as Q

    rng = np.random.default_rng(2)
    rows = [np.unique(np.concatenate([rng.integers(0, 60, 8), rng.integers(0, 30, 3) + (70 if y else 85)])).astype(np.int32) for y in (0, 1, 1) * 40]
    labels = np.array((0, 1, 1) * 40)
    scale = np.zeros(Q.SLOTS)
    scale[:200] = rng.normal(size=200)
    weights, bias = Q.dual_descent(rows, labels, scale, rounds=400)
    w = np.divide(weights, scale, out=np.zeros(Q.SLOTS), where=scale != 0)
    x = np.zeros((len(rows), 201))
    for i, s in enumerate(rows):
        x[i, s], x[i, 200] = scale[s] / np.sqrt(len(s)), 1.0
    at, sign = np.append(w[:200], bias), np.where(labels == 1, 1.0, -1.0)
    cost = np.where(labels == 1, 0.5 / (2 / 3), 0.5 / (1 / 3))
    loss = lambda v: v @ v / 2 + cost @ np.maximum(0, 1 - sign * (x @ v))
    # A plain solver: subgradient steps that get smaller.
    plain, best = np.zeros(201), np.inf
    for k in range(20_000):
        broken = sign * (x @ plain) < 1
        plain = plain - (plain - x[broken].T @ (cost * sign)[broken]) / (k + 10)
        best = min(best, loss(plain))
    assert loss(at) <= best * 1.0005


def test_features_do_not_depend_on_runs(monkeypatch):
    from wayfare.llm import quality_classifier as Q

    words = [random.Random(k).choice(["alpha", "beta", "Gamma!", "d4", "x"]) for k in range(300)]
    whole = Q.features(" ".join(words)).tolist()
    monkeypatch.setattr(Q, "WORDS_AT_ONCE", 13)
    assert Q.features(" ".join(words)).tolist() == whole
