"""Ranked search, the Jaccard join and whitening beside brute force, on odd rows and small cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerlens.llm import jaccard_join, near_duplicates, ranked_search, whitening
from tests.llm.test_operators import SCHEMA, empty, odd, shingles, words  # noqa: F401


# --- ranked search ----------------------------------------------------------------


def brute_ranks(docs, items, k=10):
    cut = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    found = [(d, Counter(cut.findall((t or "").encode().lower()))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        asked, scored = cut.findall((text or "").encode().lower()), []
        for d, c in found:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def ranks(df):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=str)


def test_ranked_search_on_odd_rows(spark, odd, empty):  # noqa: F811
    items = spark.createDataFrame(
        [(1, "w1 w2 W3 w1", "x"), (2, None, None), (3, "none-of-these", None), (None, "one é!", None), (5, " ".join(f"w{i}" for i in range(300)), None), (5, "w7", None)],
        "item_id long, text string, doc_id string",
    )
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = brute_ranks(docs, [(r["item_id"], r["text"]) for r in items.collect()])
    assert ranks(ranked_search.ranked_search(odd, items)) == want
    for a, b in ((empty, items), (odd, items.limit(0)), (empty, items.limit(0))):
        assert ranks(ranked_search.ranked_search(a, b)) == []


def test_small_shards_and_question_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 2_000)
    monkeypatch.setattr(ranked_search, "ASKED_ROWS", 40)
    rng = random.Random(5)
    docs = [(i, " ".join(f"t{min(rng.randrange(1, 200), rng.randrange(1, 200))}" for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    items = [(i, " ".join(f"t{rng.randrange(1, 200)}" for _ in range(8))) for i in range(20)]
    found = ranked_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert ranks(found) == brute_ranks(docs, items, 3)


def test_accumulators_are_limited_but_scores_whole():
    """Once the rare term fixes the k best, frequent terms only update them; ties at the bound still get in."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        asked, full = [], np.zeros(50, np.int64)
        for weight in sorted(rng.integers(0, 40, 5), reverse=True):
            places = np.sort(rng.choice(50, rng.integers(1, 40), replace=False))
            impacts = rng.integers(1, 10, len(places))
            asked.append((int(weight), places, impacts, int(weight * impacts.max())))
            full[places] += weight * impacts
        docs, score = ranked_search.ranked(asked, 50, 3)
        assert (full[docs] >= score).all()
        best = np.sort(full)[::-1][:3]
        got = dict(zip(docs.tolist(), score.tolist()))
        for doc in np.flatnonzero((full >= best[-1]) & (full > 0)):
            assert got[doc] == full[doc]
    wide = [(1000, np.array([1, 2, 3]), np.array([9, 9, 9]), 9000), (1, np.arange(50), np.ones(50, np.int64), 1)]
    assert ranked_search.ranked(wide, 50, 3)[0].tolist() == [1, 2, 3]


@pytest.fixture
def shipped():
    """What a test sets in the module holds in the tasks as well."""
    cloudpickle.register_pickle_by_value(ranked_search)
    yield
    cloudpickle.unregister_pickle_by_value(ranked_search)


def test_index_leaves_no_value_per_term_to_the_jvm(spark, monkeypatch, shipped):
    """A shard is a row of few values, and a writer or reader holds only a part of a task's shards at once."""
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(ranked_search, "GROUP_BYTES", 100_000, raising=False)
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"t{rng.randrange(10**6)}" for _ in range(200))) for i in range(1000)], "doc_id long, text string").coalesce(1)
    index = ranked_search.build_index(docs)
    shards, groups, values = index.count(), 0, Counter()
    for file in index.inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file://")).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                values[meta.row_group(g).column(c).path_in_schema.split(".")[0]] += meta.row_group(g).column(c).num_values
    assert shards > 20 and groups > 5
    assert {values[c] for c in ("terms", "starts", "places", "counts", "most", "shortest")} == {shards}
    assert ranked_search.corpus_size(index) == (1000, 200_000)
    want = Counter(t for r in docs.collect() for t in set(r["text"].encode().split()))
    assert {bytes(r["term"]): r["df"] for r in ranked_search.document_frequencies(index).collect()} == want


def test_whole_numbers_survive_packing():
    for values in ([0], [255, 0], [256], [65535, 1], [65536], [2**32 - 1], [2**32, 7], []):
        assert ranked_search.unpacked(pa.py_buffer(ranked_search.packed(np.array(values, np.int64)))).tolist() == values
    assert len(ranked_search.packed(np.full(1000, 255))) == 1001


def test_hits_are_handed_on_in_parts(spark, monkeypatch, shipped):
    """Many equal scores, more than are handed on at once, from shards of a few documents."""
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 300)
    monkeypatch.setattr(ranked_search, "HIT_ROWS", 7, raising=False)
    docs = [(i if i % 9 else None, "same words here") for i in range(60)] + [(100 + i, f"same w{i}") for i in range(20)]
    items = [(i, text) for i, text in enumerate(["same", "words w3", "none", "here same", "w5 w6 same", "words"])]
    found = ranked_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert ranks(found) == brute_ranks(docs, items)


def test_norms_beyond_64_bits():
    scores = ranked_search.Scores(10**14, 10**17)
    assert scores.norms(np.array([10, 10**6])).tolist() == [25, 25 + 75 * 10**6 * 10**14 // 10**17]


# --- Jaccard join -------------------------------------------------------------------


def brute_join(rows, size=3, percent=90):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted([(d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=str)


def joined(df, **options):
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(df, **options).collect()], key=str)


def test_join_on_odd_rows(odd, empty):  # noqa: F811
    assert joined(odd) == brute_join([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert joined(empty) == []


@pytest.mark.parametrize("percent", [90, 80, 100])
def test_join_of_edited_copies(spark, monkeypatch, percent):
    """Chains of edits around the limit, at every size; small blocks and crowds so that every step is taken."""
    for name, value in (("BLOCK", 8), ("CROWD", 4), ("LEAF", 3), ("FAN", 2), ("NEAR", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(percent)
    rows = []
    for length in (3, 9, 12, 25, 60, 150, 400):
        for _ in range(2):
            text = words(rng, length).split()
            for _ in range(14):
                rows.append((len(rows), " ".join(text)))
                for _ in range(rng.choice([0, 1, max(1, length // 60), max(1, length // 30)])):
                    at = rng.randrange(len(text))
                    text[at : at + rng.choice([1, 1, 2])] = [f"v{rng.randrange(10**6)}"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_join(rows, percent=percent)
    assert joined(df, percent=percent) == want
    assert percent == 100 or 20 < len({c for _, _, c in want}) < len(rows) - 20


def test_linked_sets_share_a_slab_they_both_keep():
    """The pigeonhole: for any two linked sets some slab is equal, even without the poor ones of sets that may leave them out."""
    rng = np.random.default_rng(4)
    slabs = jaccard_join.Slabs(90)
    for n in [9, 10, 19, 20, 37, 90, 91, 400, 3000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            out = int(rng.integers(0, len(a) // 19 + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[out:], rng.integers(0, 1 << 63, out).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if out == 0 or 100 * common < 90 * (len(a) + len(b) - common):
                continue

            def kept(members):
                return {k for _, spare, light, keys in slabs.of(members) for i, k in enumerate(keys.tolist()) if i >= light or light > spare}

            assert kept(a) & kept(b)


def test_points_bound_the_overlap_and_trees_lose_none():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(150, 300)], rng.integers(0, 1 << 63, rng.integers(0, 40)).astype(np.uint64)])) for _ in range(120)]
    groups = min(jaccard_join.groups_of(len(s)) for s in sets)
    points = np.array([jaccard_join.folded(jaccard_join.point_of(s), groups) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = jaccard_join.CountTree(points, sizes, 80)
    assert len(tree.levels) > 1
    for i, s in enumerate(sets):
        near = set(tree.near(points[i], sizes[i])[0].tolist())
        for j, t in enumerate(sets):
            common = len(np.intersect1d(s, t))
            assert common <= np.minimum(points[i], points[j]).sum()
            if 100 * common >= 80 * (len(s) + len(t) - common):
                assert j in near


def test_words_whose_polynomials_agree_are_told_apart(spark):
    """A Thue-Morse word and its mirror image, long and short."""
    rows = []
    for n in (512, 1024, 4096):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        rows += [(len(rows), word), (len(rows) + 1, word.translate(str.maketrans("ab", "ba")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(d == c for d, _, c in joined(df))
    assert all(r["kept"] for r in near_duplicates.near_duplicates(df, size=2).collect())


# --- whitening ----------------------------------------------------------------------


def brute_whitening(rows):
    dims = Counter(len(v) for _, v in rows if v and all(c is not None and math.isfinite(c) for c in v))
    dims = max(dims, key=lambda d: (dims[d], d))
    rows = [(i, v) for i, v in rows if v and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows])
    y = len(x) * x - x.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(x.T, bias=True).reshape(dims, dims))
    return [i for i, _ in rows], (y * y).sum(axis=1), y / len(x), e[::-1], v[:, ::-1]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=40) * np.linspace(3, 0.05, 40)) for i in range(700)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows] + [(3, rows[3][1].tolist()), (None, rows[5][1].tolist())]
    rows += [(1, None), (2, []), (3, [1.0] * 7), (4, [None] * 40), (5, [float("nan")] * 40), (6, [1.0] * 39 + [float("inf")])]
    return rows


def test_whitening_beside_a_full_decomposition(spark, vectors):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, component int, w int").repartition(5)
    got = whitening.whiten(df).collect()
    ids, deviation, y, e, basis = brute_whitening(vectors)
    assert len(got) == 32 * len(ids) and {r["n"] for r in got} == {len(ids)}
    assert sorted({(str(r["vec_id"]), r["deviation"]) for r in got}) == sorted({(str(i), int(d)) for i, d in zip(ids, deviation)})
    assert max(r["identity_error"] for r in got) < 1e-10
    for r in got:
        assert abs(r["explained"] / (e[r["component"] - 1] / e.sum()) - 1) < 1e-9
    want = {}
    for i, row in zip(ids, y @ basis[:, :32] / np.sqrt(e[:32])):
        want.setdefault(i, row)
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r["whitened"])):
        c = r["component"]
        sign.setdefault(c, np.sign(r["whitened"] * want[r["vec_id"]][c - 1]))
        assert abs(r["whitened"] * sign[c] - want[r["vec_id"]][c - 1]) < 1e-6


def test_whitening_of_small_and_flat_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, None), (2, 0, None, None)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)] * 3, schema)).collect()
    assert len(line) == 90 and all((r["whitened"] is None) == (r["component"] > 1) for r in line)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], schema)).collect()
    assert len(huge) == 3 and all(r["deviation"] is None or r["vec_id"] == 3 for r in huge) and huge[0]["identity_error"] < 1e-9


def test_rank_one_updates_keep_the_spectrum():
    rng = np.random.default_rng(1)
    for dims in (1, 2, 7, 30):
        spectrum, seen = whitening.Spectrum(dims), []
        for n in (1, 4, dims + 1, 300):
            x = rng.integers(-5, 6, size=(n, dims)) * np.linspace(1, 100, dims)
            seen += [x, x[:1]]  # repeated rows
            spectrum.add(x)
            spectrum.add(x[:1])
        y = np.concatenate(seen)
        y = y - y.mean(axis=0)
        scatter = y.T @ y
        assert np.abs(spectrum.u @ np.diag(spectrum.d) @ spectrum.u.T - scatter).max() < 1e-12 * np.abs(scatter).max()
        assert np.abs(spectrum.u.T @ spectrum.u - np.eye(dims)).max() < 1e-12
