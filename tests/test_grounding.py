"""Evidence beside the whole text of small requests, and in a request too large for one row's work."""

import random

from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.operators import grounding as G
from ledgerlens.operators.redflags import is_grounded

PIECES = "request_id string, part int, pos long, t string"
FLAGS = "request_id string, pos int, evidence string"


def _supported(proof, corpus):
    if not proof or proof in corpus:
        return bool(proof)
    tokens = {w for w in proof.split() if len(w) >= 3 and w not in vocab.GROUNDING_STOPWORDS}
    hits = {w for w in tokens if w in corpus}
    numbers = {w for w in tokens if any(c.isdigit() for c in w)}
    if not tokens:
        return False
    if numbers and numbers <= hits:
        return len(hits) >= max(2, len(tokens) // 2)
    return hits == tokens if len(tokens) <= 3 else len(hits) >= 3 and len(hits) / len(tokens) >= 0.65


def test_evidence_beside_the_joined_text(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_CHARS", 7)
    monkeypatch.setattr(G, "CELL", 3)
    rng = random.Random(4)
    words = ["a", "of", "in", "it", "risk", "with", "debt", "debtor", "1234", "12", "rising", "sales2020", "loss", "xy", "over"]
    pieces = [(f"r{r}", part, pos, " ".join(rng.choices(words, k=rng.randint(1, 5)))) for r in range(12) for part in range(4) for pos in range(rng.randint(0, 9))]
    corpora = {f"r{r}": " ".join(t for _, _, _, t in sorted(p for p in pieces if p[0] == f"r{r}")) for r in range(14)}
    flags = [(key, i, " ".join(rng.choices([w.upper() for w in words] + ["absent", "ing", "-"], k=rng.randint(1, 7)))) for key in corpora for i in range(60)]
    for key, text in corpora.items():  # parts of the text itself, over borders too
        for i in range(60, 110):
            at = rng.randrange(max(len(text), 1))
            flags.append((key, i, text[at:at + rng.randint(1, 30)]))
    flags += [("r1", 200, None), ("r1", 201, ""), ("r1", 202, " -- "), ("r1", 203, flags[0][2]), ("nobody", 0, "debt"), (None, 0, "debt")]
    got = {(f.request_id, f.pos) for f in G.grounded(spark.createDataFrame(flags, FLAGS), spark.createDataFrame(pieces, PIECES)).collect()}
    keys = {k: " ".join("".join(c if c.isalnum() else " " for c in (e or "").lower()).split()) for *k, e in [((r, p), e) for r, p, e in flags] for k in [tuple(k[0])]}
    want = {k for k, proof in keys.items() if k[0] in corpora and _supported(proof, corpora[k[0]])}
    assert got == want and 100 < len(want) < len(flags) - 100
    whole = spark.createDataFrame([(*k, proof, corpora.get(k[0])) for k, proof in keys.items()], "request_id string, pos int, proof string, corpus string")
    assert {(r.request_id, r.pos) for r in whole.filter("corpus IS NOT NULL").filter(is_grounded(F.col("proof"), F.col("corpus"))).collect()} == want


def test_request_of_many_sections(spark):
    n = 100_000
    sections = spark.range(n).select(
        F.lit("large").alias("request_id"), F.lit(2).alias("part"), F.col("id").alias("pos"),
        F.concat(F.lit("of "), F.col("id").cast("string"), F.lit(" plant number x"), F.col("id").cast("string"), F.lit(" is at")).alias("t"),
    )
    flags = spark.createDataFrame(
        [("large", 0, "plant number x99999"), ("large", 1, "is at of 54321 pl"), ("large", 2, "is at of 100000 pl"), ("large", 3, "is at of"), ("large", 4, "of at is")], FLAGS
    )
    assert sorted(f.pos for f in G.grounded(flags, sections).collect()) == [0, 1, 3]


def test_no_rows(spark):
    none = spark.createDataFrame([], PIECES)
    assert G.grounded(spark.createDataFrame([("r", 0, "debt")], FLAGS), none).isEmpty()
    assert G.grounded(spark.createDataFrame([], FLAGS), none).isEmpty()


def test_few_tokens_go_to_the_pieces_and_many_to_the_words(spark, monkeypatch):
    """Both ways find the same tokens; a request with few never takes its words apart."""
    words = [f"w{i}x" for i in range(200)]
    rows = [("a", f"{w}q tail") for w in words[::2]] + [("b", "alpha beta"), ("b", "gammadelta"), ("c", "none")]
    pieces = spark.createDataFrame(rows, "request_id string, t string")
    few = [("b", t) for t in ("alpha", "delta", "epsilon")] + [("c", "alpha"), ("d", "alpha")]
    many = [("a", w) for w in words]
    tokens = spark.createDataFrame(few + many, "request_id string, short string")
    expected = {("a", w) for w in words[::2]} | {("b", "alpha"), ("b", "delta")}
    assert {tuple(r) for r in G.found_tokens(tokens, pieces).collect()} == expected
    monkeypatch.setattr(G, "contained_names", None)
    proofs = spark.createDataFrame([("b", "alpha epsilon delta")], "request_id string, proof string")
    assert G.token_counts(proofs, pieces).first()[2:] == (3, 2, 0, 0)
