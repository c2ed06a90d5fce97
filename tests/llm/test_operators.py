"""The llm operators against brute force, and their defined results for odd rows."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from wayfare.llm import fingerprints, graph, mixing, near_copies, packing, quality_classifier, quality_rules, secrets, sharding, simhash, suffix_dedup, wrappers
from wayfare.llm.queries import QUERIES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 911}x{i % 37}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(80))


def odd_rows():
    base = "The quick brown fox jumps over the lazy dog near the river bank every single morning of the year. " * 3
    rows = [
        (1, base + "one", "en", "a"), (2, base + "one", "en", "a"), (3, base + "two", None, None), (4, None, "en", "b"), (5, "", "en", "b"),
        (6, "  \n\t ", "en", "b"), (7, LONG, "en", "c"), (8, LONG + " end", "en", "c"), (None, "no id here", "en", None), (None, None, None, None),
        (9, "same row twice " * 30, "en", "a"), (9, "same row twice " * 30, "en", "a"), (10, "prefix alpha " + PASSAGE + " tail one", "en", "d"),
        (11, "other beginning " + PASSAGE + " tail two", "en", "d"), (12, "é " * 700 + "\nü\n\nend", "fr", "d"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(odd_rows(), DOCS)
    clashing = {c: F.lit(7) for c in ("row", "key_id", "size", "line", "fingerprint", "g", "start", "target", "copies", "spans", "score")}
    return frame.withColumns(clashing)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -1")


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path())
    coder.encode_special_tokens = True
    got = packing.packed(docs, tokenizer_path()).collect()
    want = Counter()
    for doc_id, text, *_ in odd_rows():
        want[doc_id] += len(coder.encode(text or "", add_special_tokens=False).ids) + 1
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
    assert have == want
    ids = coder.encode(LONG, add_special_tokens=False).ids + [packing.END_ID]
    at = 0
    for r in sorted((r for r in got if r["doc_id"] == 7), key=lambda r: r["start"]):
        part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
        assert (r["start"], zlib.crc32(part), r["doc_tokens"]) == (at, r["ids_crc32"], len(ids))
        at += r["length"]
    by_sequence = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by_sequence.get(r["sequence_id"], 0)
        by_sequence[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by_sequence.values()) <= packing.LIMIT
    assert packing.packed(empty, tokenizer_path()).count() == 0


def test_packing_cuts_are_the_best():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(2, 12))
        places = [0, *np.cumsum(rng.integers(1, 9, n)).tolist()]
        costs = [0, *rng.integers(0, 5, n).tolist()]
        price = lambda cuts: sum(12 - (b - a) + costs[places.index(b)] for a, b in zip(cuts, cuts[1:], strict=False))
        tries = [[0, *(places[i + 1] for i in range(n - 1) if mask >> i & 1), places[-1]] for mask in range(1 << (n - 1))]
        best = min(price(cuts) for cuts in tries if all(b - a <= 12 for a, b in zip(cuts, cuts[1:], strict=False)))
        assert price(packing.best_cuts(places, costs, 12)) == best


@pytest.mark.parametrize("text", ["", " ", "a  b", "a \nb", "\n", "a\n", "a\n\nb", " lead", "tab\tx y", "<|endoftext|> a", "x\xa0 y", "\x1c a", "it's 12 ok.", "ñandú été"])
def test_pieces_give_the_tokenizer_ids(text):
    coder = packing.encoder(tokenizer_path())
    assert coder.encode([text])[0].tolist() == coder.plain(text)


def brute_simhash(text):
    w = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(values, near):
    up = list(range(len(values)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if near(values[a], values[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return [root(i) for i in range(len(values))]


def test_simhash_groups(spark, docs, empty):
    for text in ("", None, "a", "A b C d", LONG, "é È Z"):
        assert simhash.simhash(text) == brute_simhash(text)
    rows = odd_rows()
    prints = [brute_simhash(r[1]) for r in rows]
    groups = brute_groups(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {g: min((r[0] for r, x in zip(rows, groups, strict=True) if x == g and r[0] is not None), default=None) for g in groups}
    got = simhash.grouped(simhash.fingerprinted(docs)).collect()
    assert Counter((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in got) == Counter(
        (r[0], p, least[g]) for r, p, g in zip(rows, prints, groups, strict=True)
    )
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(least[g] for g in set(groups))
    assert simhash.grouped(simhash.fingerprinted(empty)).count() == 0 and simhash.deduplicated(empty).count() == 0


def test_simhash_links_in_small_blocks(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = {int(c) for c in centres}
    for c in centres.tolist():
        for _ in range(25):
            values.add(c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    values = sorted(values)
    want = brute_groups(values, lambda a, b: (a ^ b).bit_count() <= 4)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fingerprint long")
    for block in (3, 1024):
        found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in graph.components(simhash.links(frame, block=block)).collect()}
        sets = {}
        for v, g in zip(values, want, strict=True):
            sets.setdefault(g, []).append(found.get(v, v))
        assert all(len(set(s)) == 1 for s in sets.values()) and len({s[0] for s in sets.values()}) == len(sets)


def test_dedup_stage_keeps_one_of_near_copies(spark):
    rng = np.random.default_rng(11)
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(240)]
        # Three scattered edits change at most 15 of 236 shingles of a text: pairs are 0.77 to 0.94 alike.
        for edits in (0, 3, 3, 4, 9):
            w = list(base)
            for k in rng.choice(240, edits, replace=False):
                w[k] = f"e{rng.integers(1 << 40)}"
            texts.append(" ".join(w))
    texts += ["", None, "one", " ".join(texts[0].upper().split())]
    sets = [set(near_copies.shingle_set(t).tolist()) for t in texts]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(split, texts[:60])]
    assert [len(s) for s in sets[:60]] == [len(g) for g in grams]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * max(1, len(a | b))
    groups = brute_groups(sets, alike)
    frame = spark.createDataFrame([(100 - i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    want = {min(100 - i for i, g in enumerate(groups) if g == x) for x in set(groups)}
    assert {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, frame, "").collect()} == want
    assert len(want) < simhash.deduplicated(frame).count()
    # Blocks of few rows give the same groups.
    small = near_copies.grouped(frame, block=2, sets=2).groupBy("group").agg(F.min("doc_id").alias("d")).collect()
    assert {r["d"] for r in small} == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(60)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_sketch(text, k=fingerprints.K):
    w = split(text)

    def chain(words):
        seed = 42
        for x in words:
            seed = xxhash.xxh64_intdigest(x.encode(), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    grams = [w[i : i + 5] for i in range(len(w) - 4)] if len(w) > 4 else [[" ".join(w)]] if w else []
    return sorted({chain(g) for g in grams})[:k]


def test_fingerprints(spark, docs, empty):
    got = fingerprints.with_next(docs, 3).withColumn("e", fingerprints.edited(F.col("text"), F.col("next_text"))).collect()
    assert len(got) == len(odd_rows()) and fingerprints.with_next(empty, 3).count() == 0
    for r in got:
        assert r["sketch"] == brute_sketch(r["text"]) and r["next_sketch"] == brute_sketch(r["next_text"])
        n = len(r["text"])
        assert r["e"] == r["text"][: n - n // 3] + r["next_text"][: n // 3]
    unique = [(i * 3, f"text {i} " + "word " * i) for i in range(60)]
    frame = spark.createDataFrame(unique, "doc_id long, text string")
    for groups in (1, 2, 7, 25):
        after = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(frame, groups).collect()}
        assert after == {i: dict(unique)[i - 3 if i else 177] for i, _ in unique}
    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"a{i}" for i in range(100, 700))
    pair = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    x = pair.select(
        fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"),
        fingerprints.distinct_shingles(F.col("b")).alias("n"), fingerprints.written(F.col("a")).alias("w"), "a",
    ).first()
    assert abs(x["r"] - 296 / 696) < 0.15 and abs(x["c"] - 296 / 396) < 0.25 and abs(x["n"] - 596) < 200
    assert list(struct.unpack(f">{len(x['a'])}q", base64.b64decode(x["w"]))) == x["a"]
    parts = spark.createDataFrame([(1, brute_sketch(a)), (1, brute_sketch(b)), (2, [])], "k int, s array<long>")
    merged = {r["k"]: r["s"] for r in fingerprints.merged_sketches(parts, ["k"], "s").collect()}
    assert merged == {1: sorted({*brute_sketch(a), *brute_sketch(b)})[: fingerprints.K]}


PAGE = "<html><body><nav><ul><li>Home</li><li>News</li></ul></nav><div class='ad'>Buy</div>{}<footer>End</footer></body></html>"


def test_wrappers(spark):
    article = "<article><h1>Title &amp; more</h1><p>First  part<br>goes\non.<p>Second <b>bold</b> part</p><div class='comments'><p>Nice!</p></div><form>Sign</form></article>"
    rows = [
        (1, "http://a.example/1", PAGE.format(article)),
        (2, "http://a.example/2", PAGE.format("<article><h1>T</h1><aside>x</aside><p>One</p></article>")),
        (3, "http://b.example/1", PAGE.format("<div class='text'><p>" + "Long text here. " * 20 + "</p><p>More</p></div>")),
        (4, None, None), (5, "http://a.example/2", ""), (6, "x", "just < text &copy; <"), (2, "http://a.example/2", "<article><p>cut"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "wrapper", "text")})
    got = sorted((r["page_id"], r["text"]) for r in wrappers.extracted(pages).collect())
    assert got == [
        (1, "Title & more\nFirst part goes on.\nSecond bold part"), (2, "T\nOne"), (2, "cut"),
        (3, ("Long text here. " * 20).strip() + "\nMore"), (4, ""), (5, ""), (6, "just < text © <"),
    ]
    assert wrappers.extracted(pages.where("page_id < 0")).count() == 0


def test_wrappers_at_any_depth(spark):
    body = "<div><b>x<em>" * 5_000 + "<p>deep</p>"
    rows = [(1, "http://a.example/1", f"<body><article>{body}"), (2, "http://a.example/2", "<body><article><svg/><p>a</p><select><option>b</select><p>c"), (3, None, f"<body>{body}")]
    got = {r["page_id"]: r["text"] for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    deep = "\n".join(["x"] * 5_000 + ["deep"])
    assert got == {1: deep, 2: "a\nc", 3: deep}


def test_wrappers_read_whole_pages_of_all_templates():
    list_ = "<ul>" + "<li>item of a long list</li>" * 9 + "</ul>"
    pages = {
        f"<body><div class=text><h1>T</h1><p>intro</p>{list_}</div></body>": ["T", "intro", *["item of a long list"] * 9],
        "<body><div id=p17><h2>teaser</h2><main><p>one</p></main></div></body>": ["one"],
        "<body><div id=p18><h2>teaser</h2><main><p>two</p></main></div></body>": ["two"],
        "<body><h2>teaser</h2><div class=content><p>three</p><div class=post>in it</div></div></body>": ["three", "in it"],
        "<body><h2>teaser</h2><div class=post><p>four</p></div></body>": ["four"],
        "<body><h2>teaser</h2><article><p>five</p></article></body>": ["five"],
    }
    found = wrappers.wrapper(wrappers.json.dumps(wrappers.skeleton(wrappers.parse(p))) for p in pages)
    paths = wrappers.article_paths(found)
    assert {p: wrappers.read_page(p, paths).split("\n") for p in pages} == pages


def test_wrappers_never_take_the_main_holder(spark):
    long = "Words of the article go on and on. " * 8
    text = " ".join(long.split())
    cases = [
        (f'<body class="has-sidebar"><div><p>{long}</p></div></body>', text),
        (f'<body><div class="with-sidebar"><article><p>{long}</p></article></div></body>', text),
        (f'<body><div class="login-required"><article><p>{long}</p></article></div></body>', text),
        (f'<body><article><h2 id="search-results">S</h2><p>{long}</p><section id="related-work"><p>R</p></section><p class="social-history">H</p></article></body>', f"S\n{text}\nR\nH"),
        (f"<body><article><p>Press <button>OK</button> or <label>Stop</label> now</p><p>{long}</p><button>Send</button></article></body>", f"Press OK or Stop now\n{text}"),
        (f'<body><article><p>{long}</p><div class="replies"><p>{long}</p><p>{long}</p></div><div class="share-links">x</div></article></body>', text),
        ("<body>" + "<div>" * 70 + f"<article><p>{long}</p></article>" + "</div>" * 70 + "<p>outside</p></body>", text),
    ]
    rows = [(i, f"http://{i}.example/", page) for i, (page, _) in enumerate(cases)]
    got = {r["page_id"]: r["text"] for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(cases)}


def test_wrapper_template_slots(spark, monkeypatch):
    """On a generated host: texts that its different pages share go, at any class; copies of one article and headings stay."""
    monkeypatch.setattr(wrappers, "GROUP_ROWS", 2)
    rows, want = [], {}
    for i in range(40):
        k = i if i < 30 else 0
        own = [f"Paragraph {j} of article {k} with its own long enough words." for j in range(2 + k % 4)]
        inner = "".join(f"<p>{t}</p>" for t in own)
        extra = f"<figure><b>{k}</b></figure>" if k % 3 == 0 else ""
        rows.append((i, "http://hot.example/" + str(i), f"<body><article><h1>Head</h1><div class=box>Read our other offers here</div>{inner}{extra}<p>All rights reserved by hot</p></article></body>"))
        want[i] = "\n".join(["Head", *own, *([str(k)] if extra else [])])
    for i in range(40, 60):
        rows.append((i, "http://copies.example/", "<body><article><p>Copied text of twenty pages</p><p>and more</p></article></body>"))
        want[i] = "Copied text of twenty pages\nand more"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    assert {r["page_id"]: r["text"] for r in wrappers.extracted(pages).collect()} == want


def test_wrapper_groups():
    of = lambda page: wrappers.skeleton(wrappers.parse(page))
    both = wrappers._merged(of("<ul><li>a</li><li>b</li></ul><p>x</p>"), of("<ul><li>a<i>k</i></li></ul><h2>t</h2><p>x</p>"))
    assert both == ["#page", "", [["ul", "", [["li", "+", [["#", "", []], ["i", "?", [["#", "", []]]]]]]], ["h2", "?", [["#", "", []]]], ["p", "", [["#", "", []]]]]]


def test_classifier(spark, docs, empty, small):
    rows = {r["doc_id"]: r for r in QUERIES["op5_quality_classifier"](spark, small).collect()}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    held = [i for i in truth if rows[i]["held_out"]]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows)
    assert np.mean([rows[i]["predicted"] == truth[i] for i in held]) > 0.8
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (4, None), (None, 1), (10, 1), (12, 0)], "doc_id long, quality int")
    model = quality_classifier.learned(docs, labels)
    got = quality_classifier.scored(docs, model).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.scored(empty, model).count() == 0
    blank = quality_classifier.learned(empty, labels)
    assert blank.score(quality_classifier.features("any text")) == 0.5


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 500, 40) + (600 if y else 0)).astype(np.int32) for y in (0, 1) * 60]
    model = quality_classifier.fitted(rows, np.array((0, 1) * 60), np.arange(120) % 3 == 0)
    assert all((model.score(r) > 0.5) == bool(y) for r, y in zip(rows, (0, 1) * 60, strict=True))


def brute_removed(texts, length=400):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = True
        out.append(covered)
    return out


@pytest.mark.parametrize("block", [1, 4096])
def test_suffix_dedup(docs, empty, block):
    rows = [(r[0], (r[1] or "").encode()) for r in odd_rows()]
    want = Counter()
    for (doc_id, t), covered in zip(rows, brute_removed([t for _, t in rows]), strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~covered])
        want[doc_id, len(t), int(covered.sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = Counter(
        (r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), hashlib.sha256(r["kept"]).hexdigest())
        for r in suffix_dedup.deduplicated(docs, block=block).collect()
    )
    assert got == want
    assert suffix_dedup.deduplicated(empty).count() == 0


def test_suffix_sort_and_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    parts = [bytes(rng.integers(97, 99, rng.integers(1, 60)).astype(np.uint8)) for _ in range(90)]
    group = rng.integers(0, 4, 90)
    starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
    order, shared = suffix_dedup.suffix_sort(np.frombuffer(b"".join(parts), np.uint8), group, starts, np.array([len(p) for p in parts]))
    sorted_ = [(group[i], parts[i]) for i in order]
    assert sorted_ == sorted(sorted_)
    for (g, a), (h, b), n in zip(sorted_, sorted_[1:], shared[1:], strict=False):
        assert n == (len(next(iter([a[:k] for k in range(min(len(a), len(b)), -1, -1) if a[:k] == b[:k]]))) if g == h else 0)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    data = np.frombuffer(b"".join(parts) * 2, np.uint8)
    cut = sum(int(w.sum()) for _, w, _, _ in suffix_dedup.stretches(data, np.array([0, 700, len(data)])))
    assert cut == 700 - 399 + len(data) - 700 - 399


def test_sharding(docs, empty):
    got = sharding.sharded(docs, 4, slots=64).collect()
    assert len(got) == len(odd_rows()) and sharding.sharded(empty, 4, slots=64).count() == 0
    for k in {r["shard"] for r in got}:
        assert sorted(r["place"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows()
    )


def test_rebalanced_map():
    rng = np.random.default_rng(4)
    sizes = {s: int(x) for s, x in enumerate(rng.pareto(1.5, 2000).clip(max=80) * 1000)}
    start = sharding.first_map(2000, 16)
    edited = sharding.rebalanced(start, sizes, 16)
    load = Counter()
    for s, k in edited.items():
        load[k] += sizes[s]
    assert set(edited) == set(start) and max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 16
    assert sharding.rebalanced(edited, sizes, 16) == edited
    fewer = sharding.rebalanced(edited, sizes, 12)
    assert set(fewer.values()) == set(range(12))
    assert sharding.rebalanced({}, {}, 3) == {}


def test_secrets(spark, docs, empty):
    words = "plain prose words go along and along here"
    rows = [(i, f'{words} token = "{hashlib.sha1(str(i).encode()).hexdigest()}" {words} unbelievablylongword{"y" * (i % 3)}', "en", "src", 9) for i in range(60)]
    rows += [(100 + i, f"{words} {9876543210000000 + i} {words} reinthorhenerbleanly", "en", "src", 9) for i in range(60)]
    frame = spark.createDataFrame(rows, DOCS)
    got = secrets.scanned(frame).where("secret").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(60)) and all(r["end"] - r["start"] == 40 for r in got)
    out = {r["doc_id"]: r for r in secrets.redacted(frame).collect()}
    assert out[0]["text"] == f'{words} token = "{secrets.MASK}" {words} unbelievablylongword' and out[0]["n_chars"] == len(out[0]["text"])
    assert out[100]["text"] == rows[60][1]
    assert secrets.redacted(docs).columns == docs.columns and secrets.redacted(docs).count() == len(odd_rows())
    assert secrets.scanned(empty).count() == 0 and secrets.redacted(empty).count() == 0


def brute_base(text):
    text = text or ""
    w = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality_rules(spark, docs, empty):
    got = quality_rules.quality_verdicts(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["row"]["doc_id"], *(r[n] for n in names)) for r in got) == Counter((r[0], *brute_base(r[1])) for r in odd_rows())
    assert quality_rules.quality_verdicts(empty).count() == 0 and quality_rules.without_frequent_lines(empty).count() == 0
    assert quality_rules.without_frequent_lines(docs).columns == docs.columns
    # Digits count as one character for lines, so words are told apart by letters.
    letters = str.maketrans("0123456789", "abcdefghij")
    own = lambda i: " ".join(f"u{i}k{j}" for j in range(60)).translate(letters)
    menu = "Home News  Contact 12"
    rows = [(i, f"{menu}\n{own(i)}\nHOME news contact 99", "en", "s", 1) for i in range(30)]
    rows += [(100, "\n".join([menu] * 20) + "\n" + " ".join(f"few{j}" for j in range(10)), "en", "s", 1)]
    rows += [(200 + i, f"copied line one of some length\n{own(999)}", "en", "s", 1) for i in range(40)]
    frame = spark.createDataFrame(rows, DOCS)
    verdict = {r["row"]["doc_id"]: r for r in quality_rules.quality_verdicts(frame, quality_rules.LineLimits(min_contexts=15)).collect()}
    assert all(verdict[i]["kept"] and verdict[i]["removed_words"] == 8 for i in range(30))
    assert not verdict[100]["kept"] and all(verdict[200 + i]["kept"] and verdict[200 + i]["removed_words"] == 0 for i in range(40))
    clean = {r["doc_id"]: r["text"] for r in quality_rules.without_frequent_lines(frame, quality_rules.LineLimits(min_contexts=15)).collect()}
    assert clean[3] == own(3) and clean[205] == rows[36][1] and 100 not in clean


def test_frequent_lines_are_longest_or_beside_copies(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    own = lambda i, n=12: "\n".join(" ".join(f"u{i}k{j}n{k}" for j in range(5)) for k in range(n)).translate(letters)
    legal = "this long legal paragraph is longer than any other line of the short texts that carry it"
    rows = [(i, f"{own(i)}\n{legal}", "en", "a", 1) for i in range(25)]
    # Many copies of one text beside different texts with the same line; copies alone count once.
    rows += [(100 + i, f"menu line\n{own(100 + i)}", "en", "b", 1) for i in range(25)]
    rows += [(200 + i, f"menu line\n{own(999)}", "en", "b", 1) for i in range(100)]
    rows += [(400 + i, f"copied line\n{own(998)}", "en", "c", 1) for i in range(100)]
    clean = {r["doc_id"]: r["text"] for r in quality_rules.without_frequent_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert clean == {i: "\n".join(x for x in t.split("\n") if x not in (legal, "menu line")) for i, t, *_ in rows}


def test_mixing(spark, docs, empty):
    got = mixing.mixed(docs).collect()
    assert Counter((r["row"]["doc_id"], r["size"]) for r in got) == Counter((r[0], len(split(r[1]))) for r in odd_rows())
    assert all(0 <= r["copies"] <= 2 for r in got) and mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0
    rows = [(i, "w " * (1 + i % 50), "en", f"s{i % 4}" if i % 9 else None, 1) for i in range(4000)]
    frame = spark.createDataFrame(rows, DOCS)
    size, taken, target = Counter(), Counter(), {}
    for r in mixing.mixed(frame).collect():
        s = r["row"]["source"]
        size[s] += r["size"]
        taken[s] += r["size"] * r["copies"]
        target[s] = r["target"]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3
    assert all(target[s] <= 2 * size[s] and abs(taken[s] - target[s]) < 0.05 * target[s] for s in size)
    assert mixing.mix(frame).count() == sum(r["copies"] for r in mixing.mixed(frame).collect())
    assert Counter(mixing.mix(frame).collect()) == Counter(mixing.mix(frame).collect())


def test_stages(spark, docs, empty):
    for at in (docs, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, "")
            assert out.columns == docs.columns or k == 4
            out.count()


def test_pipeline_keeps_clean_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, small).collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").collect()}
    long = {r["doc_id"] for r in docs.collect() if len(split(r["text"])) >= 50}
    assert good & long <= kept
    packed = corpus_pipeline.run(spark, small).collect()
    assert packed and {r["doc_id"] for r in packed} <= kept
