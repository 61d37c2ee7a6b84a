"""Small cases and brute-force versions of the training-data operators."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import common, decontamination, graph, language_id, mixing, near_duplicates, quality_classifier, quality_rules, repeats, toxicity, url_filters, warc
from ledgerlens.llm.labels import sigmoid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, node string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named as the operators' own."""
    rng = random.Random(3)
    base, long = words(rng, 120), words(rng, 30_000, 5_000)
    edited = base.replace(" w1", " v1", 1)
    texts = [base, base, edited, "", None, "one", " \t\n", long, long + " tail", "é" * 500, words(rng, 80), "aaaa" * 300, "!!! ###"]
    rows = [(i, t, "en" if i % 2 else None, "a" if i % 3 else None, len(t or ""), i, "k", "n") for i, t in enumerate(texts)]
    rows += [rows[1], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, size):
    w = re.findall(rb"[^ \t-\r]+", (text or "").encode().lower())
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute_components(rows, size):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return [(d, len(s), d if not s else ids.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_odd_rows(odd, size):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(odd, size=size).collect()]
    assert sorted(got, key=str) == sorted(brute_components(rows, size), key=str)


def test_near_duplicates_dense_group(spark):
    """Copies at both sides of the limit, in buckets larger than a block."""
    rng = random.Random(5)
    base = words(rng, 100, 10_000).split()
    rows = []
    for i in range(300):
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old, near_duplicates.CHUNK = near_duplicates.CHUNK, 64
    try:
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df, size=2).collect()]
    finally:
        near_duplicates.CHUNK = old
    assert sorted(got) == sorted(brute_components(rows, 2))


def test_near_duplicates_in_blocks_at_the_limit():
    """Two common words that agree in the upper half of their fingerprints count as two."""
    many = [f"w{i}" for i in range(200_000)]
    raw = " ".join(many).encode()
    data, offsets = np.frombuffer(raw, np.uint8), np.cumsum([0] + [len(w) + 1 for w in many])
    offsets[-1] = len(raw)
    upper = np.array([s[0] for s in near_duplicates.shingle_sets(data, offsets, 1)]) >> np.uint64(32)
    values, first, n = np.unique(upper, return_index=True, return_counts=True)
    assert (n > 1).any()
    pair = [many[i] for i in np.flatnonzero(upper == values[n > 1][0])[:2]]
    texts = [" ".join([*pair, *"abcdef", own]) for own in "xy"]  # 8 of 10 in common
    batch = pa.RecordBatch.from_pydict({"node": [b"1", b"2"], "text": texts})
    (sets,) = near_duplicates._full_sets(1)(iter([batch]))
    members = [r | {"root": r["node"]} for r in sets.to_pylist()]
    block = pa.RecordBatch.from_pylist([{"main": b"1", "others": members, "minors": None}])
    (found,) = near_duplicates._block_pairs(80)(iter([block]))
    assert found.to_pylist() == [{"a": b"2", "b": b"1"}]
    assert next(near_duplicates._block_pairs(81)(iter([block]))).num_rows == 0


def test_near_duplicates_keeps_one_of_each_group(odd):
    kept = near_duplicates.kept_documents(odd, size=2)
    assert kept.columns == odd.columns
    texts = Counter(r.text for r in kept.collect())
    assert sum(n for t, n in texts.items() if t and t.startswith("w") and len(t) < 1000) == 2 and texts[None] == 2 and texts[""] == 1
    assert max(n for t, n in texts.items() if t) == 1


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    same = (near_duplicates.signature(np.unique(a)) == near_duplicates.signature(np.unique(b))).mean()
    assert abs(same - 800 / 1200) < 0.12
    assert len(np.unique(near_duplicates.signature(a[:1]) >> np.uint64(32))) == near_duplicates.PLACES  # one shingle ranks every place


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 200), (200, 300), (7, 3)]
    df = spark.createDataFrame([(max(e), min(e)) for e in edges], "a long, b long").select(*[F.lpad(F.col(c).cast("string"), 4, "0").cast("binary").alias(c) for c in "ab"])
    got = {bytes(r.key): bytes(r.root) for r in graph.components(df).collect()}
    assert {int(k): int(v) for k, v in got.items()} == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}


def brute_cut(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [400, 40])
def test_repeats_odd_rows(odd, length):
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd.filter("doc_id IS NULL OR doc_id NOT IN (7, 8)").collect()]
    got = repeats.remove_repeats(odd.filter("doc_id IS NULL OR doc_id NOT IN (7, 8)"), length=length, carried=["doc_id"])
    got = [(r.row.doc_id, r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in got.collect()]
    assert sorted(got, key=str) == sorted(((d, *c) for (d, _), c in zip(rows, brute_cut([t for _, t in rows], length))), key=str)


def test_repeats_of_words_against_brute_force(odd):
    """Windows of 12 words, long texts included: words covered by a window that also stands elsewhere."""
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd.collect()]
    split = [t.split() for _, t in rows]
    seen = Counter(tuple(w[i : i + 12]) for w in split for i in range(len(w) - 11))
    want = []
    for (doc_id, text), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - 11):
            if seen[tuple(w[i : i + 12])] > 1:
                gone |= set(range(i, i + 12))
        want.append((doc_id, len(text), [x for i, x in enumerate(w) if i not in gone]))
    got = repeats.remove_repeats(odd, length=12, words=True, carried=["doc_id"]).collect()
    assert sorted([(r.row.doc_id, r.n_bytes, bytes(r.kept).split()) for r in got], key=str) == sorted(want, key=str)


def test_repeats_against_brute_force(spark):
    """Passages shared in whole and in part, at the length's very limits, within and across texts."""
    rng = random.Random(11)
    letter = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [letter(n) for n in (30, 39, 40, 41, 60, 90, 200)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            parts += [letter(rng.randrange(30)), p if rng.random() < 0.5 else p[a:b], letter(rng.randrange(10))]
        texts.append("".join(parts))
    texts += ["ab" * 100, "ba" * 70 + "x", "z" * 41, "z" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: (r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in repeats.remove_repeats(df, length=40).collect()}
    assert [got[i] for i in range(len(texts))] == brute_cut([t.encode() for t in texts], 40)


def brute_hits(text, items, n=10):
    of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = of(text), set(), set()
    for item, item_text in items:
        v = of(item_text)
        for win in {tuple(v[i : i + n]) for i in range(max(1, len(v) - n + 1))} - {()}:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
    ids = sorted(str(i) for i in found if i is not None)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def test_decontamination_against_brute_force(spark, odd):
    rng = random.Random(2)
    bench = [(i, words(rng, rng.randrange(8, 30), 300)) for i in range(8)] + [(8, "Solo"), (9, ""), (10, None), (None, words(rng, 12, 300)), (11, "W7 w8")]
    texts = [words(rng, 40, 300) + " " + rng.choice([b for b in bench if b[1]])[1][:90] + ", " + words(rng, 5, 300) for _ in range(20)]
    rows = list(enumerate(texts)) + [(100, "SOLO solo"), (101, None), (102, bench[0][1] * 2), (103, " ".join(bench[0][1].split()[3:]))] + [(r.doc_id, r.text) for r in odd.filter("doc_id < 7 OR doc_id IS NULL").collect()]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()]
    assert sorted(got, key=str) == sorted(((d, *brute_hits(t, bench)) for d, t in rows), key=str)
    clean = decontamination.clean_documents(odd, spark.createDataFrame([], "item_id long, text string"))
    assert clean.count() == odd.count() and clean.columns == odd.columns


def test_phrase_and_proximity(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a x b c"), (3, "c b a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    index, windows = decontamination.build_index(df), decontamination.test_windows(items)
    assert decontamination.phrase_matches(index, windows).count() == 1
    assert decontamination.proximity_matches(index, windows, 1).select("key").distinct().count() == 2
    assert decontamination.proximity_matches(index, windows, 2).select("key").distinct().count() == 3


def test_phrase_and_proximity_of_long_windows(spark):
    for n in (31, 32, 64, 130):
        phrase = [f"p{i}" for i in range(n)]
        swapped = [*phrase[: n - 2], phrase[-1], phrase[-2]]
        texts = [(1, " ".join(["x", *phrase, "y"])), (2, " ".join(swapped)), (3, " ".join(phrase[:-1]))]
        df = spark.createDataFrame(texts, "doc_id long, text string")
        items = spark.createDataFrame([(1, " ".join(phrase))], "item_id long, text string")
        index, windows = decontamination.build_index(df), decontamination.test_windows(items, window=n)
        assert [r.start for r in decontamination.phrase_matches(index, windows).collect()] == [1]
        assert decontamination.proximity_matches(index, windows, 1).select("key").distinct().count() == 2


def test_quality_rules(odd, empty, spark):
    rows = {r.doc_id: r for r in quality_rules.quality_rules(odd).collect()}
    assert (rows[4].n_words, rows[4].base_failed, rows[4].kept) == (0, True, False)
    assert rows[12].n_symbols == 3 and rows[12].word_chars == 6 and rows[7].n_words == 30_000
    lines = spark.createDataFrame([(1, "a b c a b c a\nx\nx\n \n \ny", "h")], "doc_id long, text string, source string")
    r = quality_rules.quality_rules(lines).first()
    assert (r.n_repeat_words, r.n_dup_lines, r.n_lines) == (7, 1, 4)
    kept = quality_rules.kept_documents(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in quality_rules.quality_rules(odd).collect())


def test_bad_host_rejects_its_documents(spark):
    good = words(random.Random(1), 100)
    rows = [(i, "bad" if i % 10 else good, "junk") for i in range(200)] + [(1000 + i, good if i % 20 else "bad", f"h{i % 7}") for i in range(700)] + [(5000, good, None)]
    judged = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert not any(r.kept for r in judged if r.host == "junk") and {r.host_failed for r in judged if r.host != "junk"} == {False}
    assert [r.kept for r in judged if r.doc_id == 5000] == [True]


def test_empty_tables(spark, empty):
    labels, items = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert near_duplicates.near_duplicates(empty).count() == near_duplicates.kept_documents(empty).count() == 0
    assert language_id.language_id(empty).count() == quality_classifier.quality_classifier(empty, labels).count() == toxicity.toxicity(empty, labels).count() == 0
    assert quality_rules.quality_rules(empty).count() == quality_rules.kept_documents(empty).count() == 0
    assert mixing.mix(empty).count() == decontamination.decontaminate(empty, items).count() == repeats.remove_repeats(empty).count() == 0
    assert url_filters.url_filters(pages, url_filters.rule_table(spark)).count() == 0
    assert warc.capture_index(warc.read_captures(spark, warc.write_archives(warc.records(pages)))).count() == 0


def test_classifiers_without_labels(spark, odd):
    labels = spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_classifier.quality_classifier(odd, labels).collect()} == {0.5}
    assert max(r.score for r in toxicity.toxicity(odd, labels).collect()) < 1e-6
    und = language_id.predict(odd, None)
    assert {r.lang_pred for r in und.collect()} == {"und"} and und.count() == odd.count()


def test_language_id(spark, odd):
    rng = random.Random(4)
    sound = {"xx": "abelorsinta", "yy": "zuckwyghomp"}
    rows = [(i, " ".join("".join(rng.choice(sound[lang]) for _ in range(5)) for _ in range(60)), lang) for i in range(160) for lang in [("xx", "yy")[i % 2]]]
    rows += [(1000, None, "xx"), (1001, "123 !!", "yy"), (1002, "", None), (None, rows[0][1], "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.language_id(df).collect()}
    held = [r for r in rows[:160] if got[r[0]].held_out]
    assert held and sum(got[i].lang_pred == lang for i, _, lang in held) / len(held) > 0.95
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and not got[None].held_out
    assert {r.lang_pred for r in language_id.predict(odd, language_id.fit(df, F.lit(True))).collect()} <= {"xx", "yy", "und"}


def test_quality_classifier_learns(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(w + ("!!" if bad and rng.random() < 0.7 else "") for w in words(rng, 60).split()), 0 if bad else 1) for i in range(240) for bad in [i % 4 == 0]]
    df, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.quality_classifier(df, labels).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert sum(got[i].predicted == y for i, _, y in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        parts = [words(rng, 9) + "." for _ in range(6)]
        if i % 5 == 0:
            parts[3] = "you are a grobble " + words(rng, 3) + " snark" + rng.choice(["ing", "ed", "ers"]) + "!"
        rows.append((i, " ".join(parts), int(i % 5 == 0)))
    df, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert sum(got[i].predicted == y for i, _, y in held) / len(held) > 0.97
    found = toxicity.offending_sentences(df, toxicity.fit(df, labels, F.lit(True)), threshold=0.3).collect()
    assert {r.doc_id for r in found} == {i for i, _, y in rows if y} and all("grobble" in r.sentence for r in found)
    assert all(dict(r[:2] for r in rows)[r.doc_id].encode()[r.start : r.stop].decode() == r.sentence for r in found)


def test_noisy_or_gradient():
    docs = [(1, 3, np.array([0, 1]), np.array([0, 0])), (0, 3, np.array([2]), np.array([1])), (0, 2, np.array([], int), np.array([], int))]
    weights, bias = toxicity.train(docs, 2, 0.3)
    p = 1 - (1 - sigmoid(np.array([weights[0] + bias])))[0] ** 2 * (1 - sigmoid(np.array([bias])))[0]
    assert p > 0.9 and weights[1] < weights[0]


def test_url_filters(spark):
    urls = ["http://A.Example.NET/en/1?x", "http://example.net?x=/en/", "http://example.net/", "ftp://x.org/fr/#a", "http://xorg/fr/", "no scheme", None, "", "http://example.com/de", "https://EXAMPLE.com/de/x", "http:///de/",
            "http://" + "a." * 3000 + "net/" + "b/" * 3000, "http://a..net/x\ny", "http://é.net/"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0]), (None, urls[2])], "page_id long, url string")
    got = url_filters.url_filters(df, url_filters.rule_table(spark)).collect()
    rule = {r.page_id: (r.host, r.rule, r.verdict) for r in got}
    assert len(got) == 16 and rule[0] == ("a.example.net", "example.net/en/", "allow")
    assert [rule[i][1] for i in range(1, 14)] == [None, "net/", "org/fr/", None, None, None, None, None, "example.com/de/", None, "net/", "net/", "net/"]
    assert (rule[5][0], rule[5][2]) == ("", "allow") and rule[2][2] == "block"
    odd_rules = spark.createDataFrame([("net", None, "block"), (None, "/", "block"), ("example.net", "/e", "allow"), ("example.net", "/e", "block")], "host string, path string, action string")
    assert {(r.page_id, r.rule, r.verdict) for r in url_filters.url_filters(df.filter("page_id < 3"), odd_rules).collect()} == {(0, "example.net/e", "block"), (1, "net", "block"), (2, "net", "block")}


def test_warc_round_trip(spark):
    html = ["x", "x", None, "", "é\r\n\r\nWARC/1.1\r\n", "y" * 200_000, "x", "z"]
    urls = ["http://b.org/1", "http://a.org/2", None, "http://b.org/1", "u\r\nWARC-Type: x", "http://a.org/1", "http://b.org/1", "http://b.org/1"]
    rows = [(i, u, h) for i, (u, h) in enumerate(zip(urls, html))] + [(None, "http://b.org/1", "z"), (None, None, "only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = warc.capture_index(warc.read_captures(spark, warc.write_archives(warc.records(df), per_file=2)), 4).collect()
    assert [warc._order(tuple(r)) for r in index] == sorted(warc._order(tuple(r)) for r in index) and len(index) == len(rows)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index if r.page_id is not None}
    import base64
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i)
        data = (h or "").encode()
        lead = first[h or ""]
        assert got[i] == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if lead == i else "revisit", None if lead == i else lead)
    assert [(r.record_type, r.refers_to) for r in sorted((r for r in index if r.page_id is None), key=lambda r: r.payload_bytes)] == [("revisit", 7), ("response", None)]


def test_loser_tree():
    rng = random.Random(9)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(50), i) for _ in range(rng.randrange(20))) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda r: r)) == sorted(x for r in runs for x in r)


def test_raking_and_calibration():
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 1000, (3, 4, 2)).astype(float)
    tokens[0, 0, :] = 0
    goals = [np.array([0.2, 0.5, 0.3]), np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.6, 0.4])]
    mass = mixing.rake(tokens, goals)
    for axis, goal in enumerate(goals):
        assert np.allclose(mass.sum(axis=tuple(i for i in range(3) if i != axis)), goal)
    weights = np.divide(mass * tokens.sum(), tokens, out=np.zeros_like(tokens), where=tokens > 0)
    for share in (0.1, 0.7, 0.99):
        p = mixing.calibrate(tokens, weights, share)
        assert p.max() <= 1 and abs((p * tokens).sum() / tokens.sum() - share) < 1e-9


def test_mixing_reaches_targets(spark, odd):
    rng = random.Random(10)
    rows = [(i, words(rng, 100), rng.choice(["en", "en", "fr", None]), rng.choice(["src0", "src0", "b"]), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    targets = {"source": {"src0": 0.4, "*": 0.6}, "lang": {"en": 0.5, "fr": 0.3, "*": 0.2}, "topic": {"brief": 1.0}}
    picked = mixing.mix(df, targets, 0.4).filter("selected")
    total = picked.agg(F.sum("tokens")).first()[0]
    shares = {r[0]: r[1] / total for r in picked.groupBy("lang_group").agg(F.sum("tokens")).collect()}
    assert abs(shares["en"] - 0.5) < 0.05 and abs(shares["fr"] - 0.3) < 0.05 and abs(total / 400_000 - 0.4) < 0.04
    assert mixing.mix(odd).count() == odd.count()


def test_mixing_weighs_every_source(spark, monkeypatch):
    rng = random.Random(11)
    names = ["hot", "hot", "hot", "b", "c", "d", None]
    rows = [(i, words(rng, 60 + i % 40), rng.choice(["en", "en", "fr", "de", "xx", None]), rng.choice(names)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert "source" not in mixing.TARGETS and not any("src" in v for t in mixing.TARGETS.values() for v in t)

    def found(share):
        return sorted(mixing.mix(df, share=share, carried=["doc_id"]).select("row.doc_id", "tokens", "source_group", "lang_group", "weight", "probability", "selected").collect())

    for share in (0.3, 0.7, 0.97):
        result = found(share)
        total, observed, met, lang = sum(r.tokens for r in result), Counter(), Counter(), Counter()
        for r in result:
            observed[r.source_group] += r.tokens
            met[r.source_group] += r.tokens * r.weight / total
            lang[r.lang_group] += r.tokens * r.weight / total
        assert set(met) == {"hot", "b", "c", "d", "*"}
        roots = {s: n**0.5 for s, n in observed.items()}
        for s in roots:
            assert abs(met[s] - roots[s] / sum(roots.values())) < 1e-6
        assert abs(lang["fr"] - 0.16 / 0.89) < 1e-6 and met["hot"] < 0.75 * observed["hot"] / total
        assert abs(sum(r.tokens * r.probability for r in result) / total - share) < 1e-9
        with monkeypatch.context() as m:  # the same where the sources are too many for the driver
            m.setattr(mixing, "HELD", 2)
            for r, s in zip(result, found(share), strict=True):
                assert r[:4] == s[:4] and abs(r.weight - s.weight) < 1e-6 and abs(r.probability - s.probability) < 1e-6
    with monkeypatch.context() as m:
        m.setattr(mixing, "HELD", 2)
        assert mixing.mix(df.withColumn("text", F.lit(" "))).filter("weight = 0 AND probability = 0 AND NOT selected").count() == 2000


@pytest.mark.parametrize("most", [2_000_000, 1])
def test_rows_without_a_match_are_not_shuffled(spark, monkeypatch, most):
    """A left join by key, of which the rows that the other side does not hold stay where they are."""
    monkeypatch.setattr(common, "KEY_ROWS", most)
    rows = spark.range(200).selectExpr("CAST(id % 40 AS string) AS key", "id")
    held = common.stage(spark.range(0, 60, 6).selectExpr("CAST(id AS string) AS key", "array(id) AS found"), "held")
    out = common.left_by_key(rows, held, "key")
    assert out.columns == ["key", "id", "found"]
    assert {(r.id, tuple(r.found or ())) for r in out.collect()} == {(i, (i % 40,) if i % 40 % 6 == 0 else ()) for i in range(200)} and out.count() == 200
    assert ("LeftAnti" in out._jdf.queryExecution().optimizedPlan().toString()) == (most > 1)
