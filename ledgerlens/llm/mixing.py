"""Mixing documents to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic). Every source of the input is a value
of its own, however many there are; its target share is its share of the tokens to the
power TEMPER, over the sum of all sources', so a large source gives way to small ones. The
caller may name source targets instead. Languages and topics have named targets; what is
not named there counts as OTHER. The cell weights are raked until every marginal has its
target share, and documents are sampled with a probability in proportion to their cell's
weight, calibrated so that the expected tokens are a given share of all.

The tables name no topic. Unless the caller gives a topic column with targets of its own,
the class of length of the text stands in its place: what is met then is a marginal of
lengths, not of subjects.

The cells are stored with one row per source. The driver rakes those of up to HELD sources
itself; more stay a table, each round is one pass over it, and the driver holds sums per
language and topic only.

A document's draw is fixed by its id (its text where the id is null), so a repeated run
gives the same rows.

Defined cases: null or empty texts have no tokens and are selected with their cell's
probability (0 in a cell without tokens); null sources, languages and topics are OTHER, and
so is a source of that name; a target for a value that has no tokens is shared among the
others; where no weights meet all targets (a source in one language only, say) the rounds
end after ROUNDS; an empty table gives an empty result; rows that repeat an id share their
draw; other columns are carried where stated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import batch_of, split_words, stage
from ledgerlens.operators.ordering import split_lookup

OTHER = "*"
AXES = ["source", "lang", "topic"]
TARGETS = {
    "lang": {"en": 0.55, "fr": 0.16, "de": 0.16, "es": 0.11, OTHER: 0.02},
    "topic": {"brief": 0.2, "article": 0.5, "long": 0.3},
}
SHARE = 0.7  # of all tokens that are expected in the sample
TEMPER = 0.5  # a source's target is its share of the tokens to this power
HELD = 50_000  # most sources whose cells the driver holds
ROUNDS, TOLERANCE = 500, 1e-10


def length_topic(text: Column) -> Column:
    """The tables name no topic; the class of length stands for one."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    return F.when(n < 1_200, "brief").when(n < 6_000, "article").otherwise("long")


def tokens_of(text: Column) -> Column:
    return F.size(split_words(text, r"[\x20\x09-\x0D]+")).cast("long")


def _goal(target: np.ndarray, has: np.ndarray) -> np.ndarray:
    """The target shares of the values that have tokens, adding up to 1."""
    goal = np.where(has, target, 0.0)
    return goal / goal.sum() if goal.sum() > 0 else np.where(has, 1 / has.sum(), 0.0)


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Cell masses in the proportions of `tokens`, scaled axis by axis until each marginal has its target share.

    Targets of values without tokens go to the others. The masses add up to 1.
    """
    mass = tokens / tokens.sum()
    goals = []
    for axis, target in enumerate(targets):
        has = mass.sum(axis=tuple(i for i in range(mass.ndim) if i != axis)) > 0
        goals.append(_goal(target, has))
    for _ in range(rounds):
        worst = 0.0
        for axis, goal in enumerate(goals):
            now = mass.sum(axis=tuple(i for i in range(mass.ndim) if i != axis))
            worst = max(worst, float(np.abs(now - goal).max()))
            factor = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
            mass = mass * factor.reshape([-1 if i == axis else 1 for i in range(mass.ndim)])
        if worst < tolerance:
            break
    return mass


def calibrate(tokens: np.ndarray, weights: np.ndarray, share: float) -> np.ndarray:
    """min(1, c * weight) per cell with c such that the expected tokens are the share; cells at 1 stay there."""
    order = np.argsort(-weights.ravel(), kind="stable")
    t, w = tokens.ravel()[order], weights.ravel()[order]
    goal = share * t.sum()
    full = np.concatenate([[0.0], np.cumsum(t)[:-1]])  # tokens of the cells before, all taken
    rest = np.cumsum((t * w)[::-1])[::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.where(rest > 0, (goal - full) / rest, np.inf)
        fits = np.flatnonzero(c * w <= 1 + 1e-12)
    scale = c[fits[0]] if len(fits) else np.inf
    with np.errstate(invalid="ignore"):
        return np.where(weights > 0, np.minimum(1.0, scale * weights), 0.0)


def _grouped(column: Column, target: dict[str, float]) -> Column:
    return F.when(column.cast("string").isin(*[k for k in target if k != OTHER]), column.cast("string")).otherwise(OTHER)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of stored cells, and their tokens as one row per source."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("tokens").flatten().to_numpy().reshape(batch.num_rows, -1)


def _summed(cells: DataFrame, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sums over all blocks of stored cells, one row per task, added in the order of the tasks."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [sums(block) for _, block in _blocks(batches)]
        if parts:
            yield pa.record_batch({"sums": [np.sum(parts, axis=0).tolist()]})

    return np.sum([r["sums"] for r in cells.mapInArrow(per_task, "sums array<double>").collect()], axis=0)


def _source_factors(temper: float, tempered: float, inner: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The factor of each source of a block that gives it its target share under the factors of the other axes."""

    def factors(block: np.ndarray) -> np.ndarray:
        goal, now = block.sum(axis=1) ** temper / tempered, block @ inner
        return np.divide(goal, now, out=np.zeros_like(now), where=now > 0)

    return factors


def _rake_stored(cells: DataFrame, targets: list[np.ndarray], temper: float, share: float) -> DataFrame:
    """source_group, n, weights and chances of stored cells; as `rake` and `calibrate`, with one pass over the table a round."""
    shape = [len(t) for t in targets]
    first = _summed(cells, lambda x: np.append(x.sum(axis=0), (x.sum(axis=1) ** temper).sum() if temper else (x.sum(axis=1) > 0).sum()))
    tokens, tempered = first[:-1].reshape(shape), first[-1]
    total = tokens.sum()
    if not total:
        return cells.select("source_group", "n", F.col("tokens").alias("weights"), F.col("tokens").alias("chances"))
    goals = [_goal(t, tokens.sum(axis=1 - axis) > 0) for axis, t in enumerate(targets)]
    inner = np.ones(shape)
    for _ in range(ROUNDS):
        factors = _source_factors(temper, tempered, inner.ravel())
        before, sums = inner, _summed(cells, lambda x: factors(x) @ x).reshape(shape)
        for axis, goal in enumerate(goals):
            now = (sums * inner).sum(axis=1 - axis)
            inner = inner * np.expand_dims(np.divide(goal, now, out=np.zeros_like(goal), where=now > 0), 1 - axis)
        if np.abs(sums * (inner - before)).max() < TOLERANCE:
            break

    def weights_of(block: np.ndarray) -> np.ndarray:
        return np.where(block > 0, factors(block)[:, None] * inner.ravel() * total, 0.0)

    scale, full = share, -1.0
    while True:  # cells that reach 1 stay there, the scale of the others grows
        now = _summed(cells, lambda x: np.array([x[scale * weights_of(x) >= 1].sum(), (x * weights_of(x))[scale * weights_of(x) < 1].sum()]))
        if now[0] <= full:
            break
        full = now[0]
        scale = (share * total - full) / now[1] if now[1] > 0 else np.inf
        if np.isinf(scale):
            break

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source_group", pa.string()), ("n", pa.int64()), ("weights", pa.list_(pa.float64())), ("chances", pa.list_(pa.float64()))])
        for batch, block in _blocks(batches):
            weights = weights_of(block)
            chances = np.minimum(1.0, np.multiply(scale, weights, out=np.zeros_like(weights), where=weights > 0))
            yield batch_of(schema, batch.column("source_group").cast(pa.string()), batch.column("n"), weights.tolist(), chances.tolist())

    return stage(cells.mapInArrow(judged, "source_group string, n long, weights array<double>, chances array<double>"), "cell-weights")


def mix(
    df: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    lang_col: str = "lang", topic: Column | None = None, carried: list[str] | None = None, temper: float = TEMPER,
) -> DataFrame:
    """row (the carried columns), tokens, the three groups, weight (target over observed), probability and selected.

    `targets` of sources are optional; without them every source has its tempered share.
    """
    columns = {"source": F.col(source_col), "lang": F.col(lang_col), "topic": length_topic(F.col(text_col)) if topic is None else topic}
    drawn = F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")).cast("binary"))
    named = {a: _grouped(columns[a], targets[a]) if a in targets else F.coalesce(columns[a].cast("string"), F.lit(OTHER)) for a in AXES}
    rows = df.select(
        F.struct(*(carried or df.columns)).alias("row"), tokens_of(F.col(text_col)).alias("tokens"), *[named[a].alias(f"{a}_group") for a in AXES],
        (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / float(1 << 32)).alias("draw"),
    )
    groups = [f"{a}_group" for a in AXES]
    langs, topics = names = [sorted({*targets[a], OTHER}) for a in AXES[1:]]
    inner = [np.array([targets[a].get(v, 0.0) for v in n]) for a, n in zip(AXES[1:], names)]
    at_lang, at_topic = (F.array_position(F.array(*[F.lit(v) for v in n]), F.col(g)) - 1 for n, g in zip(names, groups[1:]))
    place = (at_lang * len(topics) + at_topic).cast("int")
    cells = rows.select("source_group", place.alias("place"), "tokens").groupBy("source_group", "place").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    cells = cells.groupBy("source_group").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("place", "tokens"))).alias("of"))
    of = F.transform(F.sequence(F.lit(0), F.lit(len(langs) * len(topics) - 1)), lambda i: F.coalesce(F.col("of")[i], F.lit(0)).cast("double"))
    cells = stage(cells.select("source_group", "n", of.alias("tokens")), "cells")
    if "source" in targets or cells.limit(HELD + 1).count() <= HELD:
        held = sorted(cells.collect(), key=lambda r: r["source_group"])
        tokens = np.array([r["tokens"] for r in held]).reshape(-1, len(langs), len(topics))
        weights = chances = np.zeros_like(tokens)
        if tokens.sum():
            of_source = tokens.sum(axis=(1, 2))
            source = np.array([targets["source"].get(r["source_group"], 0.0) for r in held]) if "source" in targets else of_source**temper
            mass = rake(tokens, [source, *inner])
            weights = np.divide(mass * tokens.sum(), tokens, out=np.zeros_like(tokens), where=tokens > 0)
            chances = calibrate(tokens, weights, share)
        cells = [(r["source_group"], w.ravel().tolist(), c.ravel().tolist()) for r, w, c in zip(held, weights, chances)]
        table = df.sparkSession.createDataFrame(cells, "source_group string, weights array<double>, chances array<double>")
        judged = rows.join(F.broadcast(table), "source_group")  # as many rows as sources
    else:
        table = _rake_stored(cells, inner, temper, share)
        judged = split_lookup(rows, table, "source_group", "n", table.agg(F.sum("n")).first()[0])
    weight, probability = (F.col(c)[place].alias(a) for c, a in (("weights", "weight"), ("chances", "probability")))
    judged = judged.select("row", "tokens", *groups, "draw", weight, probability)
    return judged.select("row", "tokens", *groups, "weight", "probability", (F.col("draw") < F.col("probability")).alias("selected"))
