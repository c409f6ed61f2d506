"""Quality classifier: heuristic labellers weighed by expectation-maximisation teach a hashed linear scorer."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from keysift.llm.hashing import hash_strings
from keysift.llm.shared import Carried, settled, slices

BUCKETS = 1 << 15
PART_BYTES = 4 << 20
MOST_TRAINING_ROWS = 10_000
_GOOD, _JUNK, _SILENT = 1, 0, 2

# Each labeller reads one measure of a text: junk from the first bound on, good up to the second, else silent.
LABELLERS = {
    "capitals": (0.3, 0.1),
    "symbols": (0.05, 0.01),
    "repeats": (0.2, 0.08),
    "vocabulary": (0.65, 0.5),
    "tables": (0.2, 0.05),
    "shouts": (0.3, 0.08),
    "top_word": (0.25, 0.15),
    "top_line": (0.5, 0.3),
    "marked_words": (0.3, 0.1),
    "odd_words": (0.4, 0.15),
}


# Letters or digits, with marks inside as in names and numbers, in quotes or brackets, before an end of a clause.
_PLAIN_WORD = r"""^["'(\[«„“‘¿¡+]*[\p{L}\p{M}\p{N}]+(?:['’.,:@/\-][\p{L}\p{M}\p{N}]+)*["')\]»”“’]*[.,;:?!…]?["')\]»”]*$"""


@dataclass(frozen=True)
class Features:
    """Words of a slice of texts as numbers of distinct words, and what is measured of each text."""

    begins: np.ndarray
    sizes: np.ndarray
    codes: np.ndarray
    buckets: np.ndarray  # two for each distinct word: the word's and its shape's
    measures: dict[str, np.ndarray]
    repeated: np.ndarray


def _sum(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, which may be empty."""
    total = np.concatenate([[0], np.cumsum(values, dtype=float)])
    return total[begins + sizes] - total[begins]


def _matches(words: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False).astype(float)


def _most(owner: np.ndarray, codes: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct codes each text has, and how often its commonest one occurs."""
    pairs, counts = np.unique(owner * (int(codes.max(initial=0)) + 1) + codes, return_counts=True)
    of = pairs // (int(codes.max(initial=0)) + 1)
    most = np.zeros(texts, np.int64)
    np.maximum.at(most, of, counts)
    return np.bincount(of, minlength=texts), most


def features(texts: pa.Array) -> Features:
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    owner = owner[real.to_numpy(zero_copy_only=False)]
    words = flat.filter(real).dictionary_encode()
    codes, distinct = words.indices.to_numpy().astype(np.int64), words.dictionary
    sizes = np.bincount(owner, minlength=len(texts))
    begins = np.cumsum(sizes) - sizes
    n = np.maximum(sizes, 1)

    shapes = distinct
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"[\p{L}\p{M}]+", "a"), (r"\p{N}+", "0")):
        shapes = pc.replace_substring_regex(shapes, pattern=pattern, replacement=sign)
    # An upper-case sign is a letter as well, so it is told apart by a word's capitals below.
    capital = pc.match_substring_regex(distinct, r"^\P{L}*\p{Lu}{2,}\P{L}*$").to_numpy(zero_copy_only=False)
    shapes = shapes.dictionary_encode()
    shape_hash = hash_strings(pc.binary_join_element_wise(shapes.dictionary, "shape", " "))[shapes.indices.to_numpy()]
    buckets = np.stack([hash_strings(distinct), shape_hash + capital.astype(np.uint64)], axis=1) % np.uint64(BUCKETS)

    marks = pc.count_substring_regex(distinct, r"[#$%&*|!<>{}=~^\\_]").to_numpy().astype(float)
    letters = np.maximum(pc.utf8_length(distinct).to_numpy(), 1)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    kinds, top = _most(owner, codes, len(texts))
    lines = pc.split_pattern(texts, "\n")
    line_codes = lines.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    line_counts = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    _, top_line = _most(np.repeat(np.arange(len(texts)), line_counts), line_codes, len(texts))
    # The share of new words falls with length even in good prose, so it is held against that of random prose.
    expected = np.minimum(1.0, 6.0 / np.maximum(np.log(n + 1.0), 1.0))
    measures = {
        "capitals": _sum(capital[codes].astype(float), begins, sizes) / n,
        "symbols": _sum(marks[codes], begins, sizes) / np.maximum(_sum(letters[codes].astype(float), begins, sizes), 1),
        "repeats": _sum(same.astype(float), begins, sizes) / n,
        "vocabulary": 1 - kinds / n / expected,
        "tables": _sum(pc.equal(distinct, "|").to_numpy(zero_copy_only=False)[codes].astype(float), begins, sizes) / n,
        "shouts": _sum(pc.ends_with(distinct, "!!").to_numpy(zero_copy_only=False)[codes].astype(float), begins, sizes) / n,
        "top_word": top / n,
        "marked_words": _sum(_matches(distinct, r"[^\p{L}\p{M}\p{N}]{3,}")[codes], begins, sizes) / n,
        "odd_words": 1 - _sum(_matches(distinct, _PLAIN_WORD)[codes], begins, sizes) / n,
        "top_line": np.where(line_counts > 3, top_line / np.maximum(line_counts, 1), 0.0),
    }
    return Features(begins, sizes, codes, buckets.astype(np.int64), measures, _sum(same.astype(float), begins, sizes) / n)


def votes(found: Features, fewest: int = 8) -> np.ndarray:
    """A vote of each labeller on each text; texts of fewer words than ``fewest`` get none."""
    out = np.full((len(found.sizes), len(LABELLERS)), _SILENT, np.int64)
    for column, (name, (junk, good)) in enumerate(LABELLERS.items()):
        value = found.measures[name]
        out[:, column] = np.where(value >= junk, _JUNK, np.where(value <= good, _GOOD, _SILENT))
    out[found.sizes < fewest] = _SILENT
    return out


def _packed(table: np.ndarray) -> np.ndarray:
    return table @ (3 ** np.arange(table.shape[1]))


def _unpacked(patterns: np.ndarray, labellers: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(labellers) % 3


@dataclass(frozen=True)
class LabelModel:
    """Shares of classes of texts, the first being good ones, and how a labeller that votes does so in each.

    Junk is of as many kinds as there are labellers, as what one of them knows the others may not see.
    """

    shares: np.ndarray
    voting: np.ndarray  # labeller, class, vote

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of each class for each pattern of votes.  Silence tells nothing."""
        table = _unpacked(patterns, len(self.voting))
        log = np.log(self.shares)[:, None] + sum(
            np.where(table[:, j] == _SILENT, 0.0, np.log(self.voting[j][:, np.minimum(table[:, j], 1)]))
            for j in range(len(self.voting))
        )
        odds = np.exp(log - log.max(axis=0))
        return odds / odds.sum(axis=0)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self.classes(patterns)[0] if len(patterns) else np.zeros(0)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 500) -> LabelModel:
    """Expectation-maximisation over counts of vote patterns, from the belief that a vote for junk is mostly right.

    How often each labeller is right on each class comes from agreement alone; no label is read.  Taken as known
    beforehand, with the weight of a tenth of the texts: a labeller calls one good text in a hundred junk.
    """
    table, total = _unpacked(patterns, labellers), counts.sum()
    junk = table == _JUNK
    belief = np.concatenate([np.where(junk.any(axis=1), 0.1, 0.9)[:, None], np.where(junk, 1.0, 1e-3)], axis=1).T
    belief[1:] *= (1 - belief[0]) / belief[1:].sum(axis=0)
    model = LabelModel(np.full(labellers + 1, 1 / (labellers + 1)), np.full((labellers, labellers + 1, 2), 0.5))
    for _ in range(rounds):
        weights = counts * belief
        voting = np.ones((labellers, labellers + 1, 2))
        voting[:, 0] += 0.1 * total * np.array([0.01, 0.99])
        for j in range(labellers):
            voting[j, j + 1, _JUNK] += 1 + 0.001 * total  # a kind of junk is what its labeller calls so
            for vote in (_JUNK, _GOOD):
                voting[j, :, vote] += weights[:, table[:, j] == vote].sum(axis=1)
        shares = weights.sum(axis=1) + np.array([2 * labellers] + [1] * labellers)  # most texts are taken to be good
        model = LabelModel(shares / shares.sum(), voting / voting.sum(axis=2, keepdims=True))
        last, belief = belief, model.classes(patterns)
        if np.abs(belief - last).max(initial=0) < 1e-9:
            break
    return model


def _vote(batches):
    for batch in batches:
        for rows in slices(batch, "text", PART_BYTES):
            packed = _packed(votes(features(rows.column("text"))))
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(packed)})


def _sparse(found: Features, text: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares of its words; the last bucket is the share of repeated words."""
    own = found.codes[found.begins[text] : found.begins[text] + found.sizes[text]]
    buckets, counts = np.unique(found.buckets[own], return_counts=True)
    return np.append(buckets, BUCKETS), np.append(counts / max(len(own), 1), found.repeated[text])


def _train(batches, model: LabelModel, steps: int, rate: float):
    """Logistic regression on soft labels, one step over all rows at a time; the rows are a bounded sample."""
    columns, values, rows, targets = [], [], [], []
    for batch in batches:
        for part in slices(batch, "text", PART_BYTES):
            found = features(part.column("text"))
            targets.append(model.posterior(_packed(votes(found))))
            for text in range(part.num_rows):
                buckets, shares = _sparse(found, text)
                columns.append(buckets), values.append(shares)
                rows.append(np.full(len(buckets), len(rows)))
    weights = np.zeros(BUCKETS + 2)
    if columns:
        column, value, row = np.concatenate(columns), np.concatenate(values), np.concatenate(rows)
        target = np.concatenate(targets)
        first, second = np.zeros_like(weights), np.zeros_like(weights)
        # Both classes weigh alike, so the smaller is not swamped.
        share = np.where(target >= 0.5, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1))
        for step in range(1, steps + 1):
            score = np.bincount(row, value * weights[column], minlength=len(target)) + weights[-1]
            error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - target) * share
            slope = np.bincount(column, value * error[row], minlength=len(weights))
            slope[-1] = error.sum()
            slope[:-1] += 1e-7 * weights[:-1]
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    yield pa.RecordBatch.from_pydict({"weights": pa.array([weights], pa.list_(pa.float64()))})


def _score(batches, model: LabelModel, weights: np.ndarray, kept: tuple[str, ...]):
    for batch in batches:
        for rows in slices(batch, "text", PART_BYTES):
            found = features(rows.column("text"))
            of_word = weights[found.buckets].sum(axis=1)
            total = _sum(of_word[found.codes], found.begins, found.sizes) / np.maximum(found.sizes, 1)
            score = 1 / (1 + np.exp(-np.clip(total + found.repeated * weights[BUCKETS] + weights[-1], -50, 50)))
            score[found.sizes == 0] = 0.0
            columns = {c: rows.column(c) for c in kept}
            columns["posterior"] = pa.array(model.posterior(_packed(votes(found))))
            columns["score"] = pa.array(score)
            yield pa.RecordBatch.from_pydict(columns)


def classify_quality(
    docs: DataFrame,
    threshold: float = 0.5,
    most_training_rows: int = MOST_TRAINING_ROWS,
    steps: int = 300,
    rate: float = 0.05,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = True,
) -> DataFrame:
    """``docs``, without the text unless ``with_text``, with ``posterior``, ``score`` and ``accepted``.

    Every text gets the votes of all ``LABELLERS``; counts of vote patterns over all texts, at most ``3 **
    len(LABELLERS)`` numbers, fit the label model.  ``posterior`` is its belief that a text is good.  A sample of at
    most ``most_training_rows`` texts, those whose hash of id and text is smallest, trains the scorer on posteriors;
    ``score`` is the scorer's probability, and a text is ``accepted`` from ``threshold`` on.

    A null or empty text has no votes, so its posterior is the prior; its score is 0.  A null id is like any other;
    repeated rows are scored alike; an empty table gives an empty result.  Columns of ``docs`` named like the
    added ones are replaced.
    """
    added = ("posterior", "score", "accepted")
    carried = Carried(docs, (*added, text_col))
    text = F.col(text_col)
    patterns = settled(docs.select(text.alias("text")).mapInArrow(_vote, "pattern BIGINT"), "votes")
    tally = patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    model = fit_labels(
        np.array([r["pattern"] for r in tally], np.int64), np.array([r["n"] for r in tally], float), len(LABELLERS)
    )
    total = sum(r["n"] for r in tally)
    lot = F.xxhash64(F.col(id_col).cast("string"), text)
    # A third more than needed, so that the limit and not the lot decides how many there are.
    share = min(1.0, 1.3 * most_training_rows / max(total, 1))
    sample = docs.select(lot.alias("lot"), text.alias("text"))
    if share < 1:
        sample = sample.filter(F.col("lot") < int(-(2**63) + share * 2.0**64))
    sample = settled(sample.orderBy("lot").limit(most_training_rows).drop("lot"), "sample")
    trained = sample.coalesce(1).mapInArrow(partial(_train, model=model, steps=steps, rate=rate), "weights ARRAY<DOUBLE>")
    made = trained.first()
    weights = np.array(made["weights"]) if made else np.zeros(BUCKETS + 2)
    # The text travels once, beside the other columns.
    rows = docs.select(carried.column, text.alias("text"))
    kept = ("row", "text") if with_text else ("row",)
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", posterior DOUBLE, score DOUBLE"
    scored = rows.mapInArrow(partial(_score, model=model, weights=weights, kept=kept), schema)
    back = carried.back() | ({text_col: F.col("text").alias(text_col)} if with_text else {})
    return scored.select(
        *(back[c] for c in docs.columns if c in back), "posterior", "score", (F.col("score") >= threshold).alias("accepted")
    )
