"""Term search beside a plain cosine over all texts: skipping blocks, scopes, ties and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens import vocab
from ledgerlens.functions import postings, vectors
from ledgerlens.operators import retrieval as R


def split(text):
    return [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in vocab.STOP_WORDS]


def brute(chunks, questions, k):
    """Per scope: cosine of unit vectors of tf * (ln((1 + n) / (1 + df)) + 1)."""
    out = []
    for q, scope, text in questions:
        own = [(c, Counter(split(t))) for s, c, t in chunks if s == scope]
        df = Counter(t for _, counts in own for t in counts)
        weight = {t: math.log((1 + len(own)) / (1 + n)) + 1 for t, n in df.items()}
        asked = {t: n * weight[t] for t, n in Counter(split(text)).items() if t in weight}
        size = math.sqrt(sum(x * x for x in asked.values()))
        scored = []
        for c, counts in own:
            length = math.sqrt(sum((n * weight[t]) ** 2 for t, n in counts.items()))
            score = sum(asked[t] * n * weight[t] for t, n in counts.items() if t in asked) / (length * size or 1)
            if score > 0:
                scored.append((-round(score, 9), c))
        out += [(q, r + 1, c) for r, (_, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(index, spark, questions, k):
    asked = spark.createDataFrame(questions, "q long, session string, question string")
    return sorted((r.q, r["rank"], r.c) for r in index.search(asked, ["q"], "question", k).collect())


@pytest.mark.parametrize("scope", [["session"], None])
def test_search_beside_plain_cosine(spark, monkeypatch, scope):
    """Small shards, blocks and question packs; copies tie and the lower id wins; texts and questions without words."""
    for name, value in (("SHARD", 32), ("BLOCK", 4), ("PROBE", 1)):
        monkeypatch.setattr(postings, name, value)
    monkeypatch.setattr(postings.shards, "__defaults__", (32,))
    monkeypatch.setattr(R, "QUERY_TERMS", 20)
    rng = random.Random(1)
    word = lambda: f"word{min(rng.randrange(60), rng.randrange(60))}"
    texts = [" ".join(word() for _ in range(rng.randrange(1, 15))) for _ in range(150)] + ["", None, "!", "word1 word2"]
    chunks = [("a" if i % 3 else "b", i, t) for i, t in enumerate(texts + texts[:60])]
    questions = [(i, "ab"[i % 2], " ".join(word() for _ in range(5))) for i in range(24)] + [(90, "a", None), (91, "b", "unknown"), (92, "none", "word1")]
    df = spark.createDataFrame(chunks, "session string, c long, t string").repartition(3)
    index = R.TermIndex(df, ["c"], "t", scope=scope)
    if not scope:
        chunks, questions = [("", c, t) for _, c, t in chunks], [(q, "", t) for q, _, t in questions]
    assert found(index, spark, questions, 4) == brute(chunks, questions, 4)
    assert found(index, spark, questions[:0], 4) == []


def test_index_of_no_chunks(spark):
    index = R.TermIndex(spark.createDataFrame([], "c long, t string"), ["c"], "t")
    assert index.vocabulary.count() == 0 and found(index, spark, [(1, "", "word")], 3) == []


def test_skipped_blocks_hold_no_hit():
    """A shard with skipping gives what a scan of all postings gives, and reads fewer of them."""
    rng = np.random.default_rng(3)
    names = [f"t{i}" for i in range(30)]
    tokens = [[names[min(rng.integers(0, 30), rng.integers(0, 30))] for _ in range(rng.integers(1, 9))] for _ in range(600)]
    row = postings.shard_row(list(range(600)), tokens)
    idf = rng.uniform(1, 9, len(row["terms"]))
    made = postings.weigh(row["starts"], row["places"], row["counts"], idf, 600, 8)
    args = [made[c] for c in ("term_at", "blocks", "tops", "block_at", "places", "weights")]
    skipped = 0
    for _ in range(100):
        asked = [(str(t), float(w)) for t, w in zip(rng.choice(names, 3, replace=False), rng.uniform(0.01, 1, 3))]
        shard = postings.Shard(row["terms"], *args, 600, 8)
        places, scores = shard.best(asked, 5)
        full = np.zeros(600)
        for term, weight in sorted(asked):
            if term in row["terms"]:
                i = row["terms"].index(term)
                own = slice(made["block_at"][made["term_at"][i]], made["block_at"][made["term_at"][i + 1]])
                full[made["places"][own]] += weight * made["weights"][own]
                skipped += own.stop - own.start
        full = np.round(full, 12)
        want = np.lexsort((np.arange(600), -full))[:5]
        assert places.tolist() == want[full[want] > 0].tolist() and np.array_equal(scores, full[places])
        again = postings.Shard(row["terms"], *args, 600, 8).best(asked, 5, float(scores[-1]))
        assert again[0].tolist() == places.tolist()  # a k-th score from elsewhere leaves out only what is below it
        skipped -= shard.scored
    assert skipped > 0


# --- vectors ------------------------------------------------------------------------


def test_pruned_blocks_hold_no_neighbour():
    """Clustered vectors with ties: what pruning leaves are exactly the nearest, for far fewer comparisons."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 6
    x = np.round(centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 8)), 1)
    x[100:160] = x[0]
    pivots, queries = x[:6], np.concatenate([x[:20], rng.normal(size=(5, 8)) * 50])
    near = vectors.Nearest(queries, pivots, 7)
    found = []
    for part, low, high in vectors.blocks(x, pivots, 64):
        assert (np.diff(part) > 0).all()
        q, place, score = near.add(x[part], low, high)
        found += list(zip(q.tolist(), score.tolist(), part[place].tolist()))
    for q, v in enumerate(queries):
        full = ((x - v) ** 2).sum(axis=1)
        want = sorted(zip(full.tolist(), range(len(x))))[:7]
        got = sorted((s, i) for own, s, i in found if own == q)[:7]
        assert [i for _, i in got] == [i for _, i in want]
    assert near.compared < 0.5 * len(x) * len(queries)


@pytest.mark.parametrize("scope", ["session", None])
def test_vector_search_in_sessions(spark, monkeypatch, scope):
    """A hot session that is dealt to many places, sessions without chunks, null vectors, and the hits' own columns."""
    for name, value in (("BLOCK", 8), ("RUN", 2)):
        monkeypatch.setattr(vectors, name, value)
    monkeypatch.setattr(vectors.built, "__defaults__", (8,))
    monkeypatch.setattr(R, "QUERY_BLOCK", 5)
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", [float(rng.randint(0, 4)) for _ in range(3)]) for i in range(300)] + [(900, "hot", None)]
    asked = [(q, ["hot", "s1", "none"][q % 3], [float(rng.randint(0, 4)) for _ in range(3)]) for q in range(24)] + [(99, "hot", None)]
    chunks = spark.createDataFrame([(i, s, v, f"text {i}") for i, s, v in rows], "c long, session string, embedding array<float>, text string").repartition(4)
    queries = spark.createDataFrame(asked, "query_id long, session string, embedding array<float>")
    hits = R.vector_search(chunks, queries, "c", k=3, overfetch=2, scope=scope, columns=["text"]).collect()
    want = set()
    for q, s, v in asked:
        if v:
            near = sorted((sum((a - b) ** 2 for a, b in zip(e, v)), i) for i, own, e in rows if e and (own == s or not scope))[:3]
            want |= {(q, r + 1, i, d, f"text {i}") for r, (d, i) in enumerate(near)}
    assert {(r.query_id, r["rank"], r.c, r.score, r.text) for r in hits} == want and len(hits) == len(want)
    assert R.vector_search(chunks.limit(0), queries, "c", scope=scope).collect() == []


def test_chat_history_is_in_time_order(spark):
    asked = spark.createDataFrame(
        [(1, 7, "later", "b [C2] [C2]", 20), (1, 9, "first", "a", 10), (1, 8, "tie", None, 20)],
        "session_id long, query_id long, question string, answer string, at long",
    )
    asked = asked.selectExpr("session_id", "query_id", "question", "answer", "timestamp_seconds(at) AS created_at")
    rows = R.chat_history(asked, spark.createDataFrame([(1, "s")], "session_id long, session_name string")).collect()
    assert [(r.content, len(r.citations)) for r in rows] == [("first", 0), ("a", 0), ("later", 0), ("b [C2] [C2]", 1), ("tie", 0)]


def test_idf_of_a_shard_is_gathered_over_batches_and_shards_are_read_few_at_a_time(spark):
    import glob

    import pyarrow as pa
    import pyarrow.parquet as pq

    from ledgerlens.functions import postings

    rows = [(s, s + t / 100) for s in (3, 5, 9) for t in range(7)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + 4]]) for i in range(2)], ["shard", "idf"]) for at in range(0, len(rows), 4)]
    got = [r for b in postings.gathered(iter([b.slice(0, 0) for b in batches[:1]] + batches)) for r in b.to_pylist()]
    assert got == [{"shard": s, "idf": [v for n, v in rows if n == s]} for s in (3, 5, 9)]

    texts = spark.range(40).selectExpr("id", "concat('word', id, ' common') AS text", "id AS session").coalesce(1)
    index = R.TermIndex(texts, ["id"], scope=["session"])
    for stored in (index._shards, index.blocks):
        for file in stored.inputFiles():
            meta = pq.ParquetFile(glob.escape(file).replace("file://", "").replace("file:", "")).metadata
            assert all(meta.row_group(g).num_rows <= R.GROUP_SHARDS for g in range(meta.num_row_groups))


def test_frequencies_of_shards_come_per_term():
    """One row per term of each shard, with the scope; no expression runs per term."""
    lists = pa.list_(pa.string()), pa.list_(pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None]), pa.array([["x", "y"], []], lists[0]), pa.array([[0, 3, 4], [0]], lists[1])], ["s", "terms", "starts"])
    schema = pa.schema([("s", pa.string()), ("term", pa.string()), ("n", pa.int64())])
    assert [tuple(r.values()) for b in postings.frequencies(1, schema)(iter([batch])) for r in b.to_pylist()] == [("a", "x", 3), ("a", "y", 1)]
    row = postings.shard_row([7, 3, 5], pa.array([["b", "a", "b"], [""], ["a", "c"]]))
    assert row["order"] == [1, 2, 0] and row["terms"] == ["a", "c", "b"]
    assert [v.tolist() for v in (row["starts"], row["places"], row["counts"])] == [[0, 2, 3, 4], [1, 2, 1, 2], [1, 1, 1, 2]]
