"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its own features and those of the lines before and after it give the
evidence, transitions tie neighbours together, and forward-backward marginals, weighted by line length, give the
document's quality, which a two-parameter logistic curve turns into a score.

Training takes the label of a document for all its lines. It uses at most ``per_class`` labelled
documents of either label, in the order of a hash of doc_id, never held-out ones, and of a longer text ``LINES``
lines that follow each other, from a place that its hash tells. It is fitted on
line features in the driver; that sample is the only thing that reaches it. Scoring runs over
all documents and whole texts in one pass without a shuffle; features are held for ``BLOCK`` lines at once, and a
chain of many lines is cut into blocks whose transfer matrices are multiplied, so that its messages stay exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.charclass import CLASSES, bounded_class_counts
from cohortlens.llm.common import chunks, mapped, ragged

PER_CLASS = 1000  # labelled documents of each label used for training, at most
LINES = 100  # lines of one document used for training, at most
BLOCK, CELLS, LONG = 20_000, 1 << 18, 4096  # lines with features at once, cells of a padded array, lines of a chain that is cut
ROUNDS, RATE, RIDGE = 150, 0.05, 1e-4
OWN = len(CLASSES) + 8  # features of a line itself


def _lines(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(lines, lines per text, whether the text had the same line before). An empty text is one empty line."""
    lines, counts, repeated = [], [], bytearray()
    for text in texts:
        own, seen = text.split("\n"), set()
        for line in own:
            repeated.append(line in seen)
            seen.add(line)
        lines += own
        counts.append(len(own))
    return lines, np.array(counts), np.frombuffer(repeated, dtype=np.bool_)


def _features(lines: list[str], repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, length) per line."""
    classes = bounded_class_counts(lines)
    sizes = classes.sum(1)
    words = np.zeros((len(lines), 2))
    for i, line in enumerate(lines):
        own = line.split()
        words[i] = len(own), len(set(own))
    n_words = np.maximum(words[:, 0], 1)
    length = np.log1p(sizes) / 5
    extra = [
        length,
        length**2,
        np.log1p(words[:, 0]) / 4,
        (sizes - classes[:, CLASSES.index("space")]) / n_words / 6,
        words[:, 1] / n_words,
        repeated.astype(float),
        (words[:, 0] < 4).astype(float),
        (words[:, 0] == 0).astype(float),
    ]
    shares = np.sqrt(classes / np.maximum(sizes, 1)[:, None])
    return np.column_stack([shares, *extra]), sizes


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line, length per line, lines per text)."""
    lines, counts, repeated = _lines(texts)
    return *_features(lines, repeated), counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own, previous and next features, a mark where there is none, and a constant."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    last = np.cumsum(counts) - 1
    before = np.roll(own, 1, axis=0)
    after = np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    edges = np.zeros((len(own), 3))
    edges[first, 0], edges[last, 1], edges[:, 2] = 1, 1, 1
    return np.column_stack([own, before, after, edges])


def _padded(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.arange(counts.max())[None, :] < counts[:, None]
    out = np.zeros(place.shape)
    out[place] = values
    return out, place


def forward_backward(evidence: np.ndarray, counts: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds messages of a two-state chain, and the padding mask; ``t[i, j]`` scores i before j."""
    e, place = _padded(evidence, counts)
    f, b = e.copy(), np.zeros_like(e)
    for i in range(1, e.shape[1]):
        u = f[:, i - 1]
        f[:, i] += np.logaddexp(t[1, 1] + u, t[0, 1]) - np.logaddexp(t[1, 0] + u, t[0, 0])
    for i in range(e.shape[1] - 2, -1, -1):
        v = e[:, i + 1] + b[:, i + 1]
        step = np.logaddexp(t[1, 1] + v, t[1, 0]) - np.logaddexp(t[0, 1] + v, t[0, 0])
        b[:, i] = np.where(place[:, i + 1], step, 0)
    return f, b, place


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _chain(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The forward messages of one long chain, in some 2 * sqrt(n) array steps.

    The chain is laid out as rows. Each row's steps are multiplied to one 2 x 2 matrix over (bad, good), scaled as they go; these carry
    the message from row to row, and all rows then run at once from what reaches them.
    """
    n = len(e)
    width = int(np.sqrt(n)) + 1
    grid = np.zeros((-(-n // width), width))
    grid.ravel()[:n] = e
    step = np.exp(t - t.max()).T  # new state by old
    whole = np.tile(np.eye(2), (len(grid), 1, 1))
    for i in range(width):
        moved = step @ whole
        if not i:
            moved[0] = whole[0]  # nothing comes before the first line
        moved[:, 0] *= np.exp(-np.maximum(grid[:, i], 0))[:, None]
        moved[:, 1] *= np.exp(np.minimum(grid[:, i], 0))[:, None]
        whole = moved / moved.max((1, 2), keepdims=True)
    reached, state = np.zeros(len(grid)), np.ones(2)
    for row in range(len(grid)):
        reached[row] = np.log(state[1]) - np.log(state[0])
        state = np.maximum(whole[row] @ state, 1e-300)
        state /= state.max()
    f, u = np.empty_like(grid), reached
    for i in range(width):
        passed = np.logaddexp(t[1, 1] + u, t[0, 1]) - np.logaddexp(t[1, 0] + u, t[0, 0])
        if not i:
            passed[0] = 0
        u = f[:, i] = grid[:, i] + passed
    return f.ravel()[:n]


def _parts(counts: np.ndarray) -> Iterator[np.ndarray]:
    """Texts by number of lines, so many together that their padded array has ``CELLS`` cells at most."""
    order = np.argsort(counts, kind="stable")
    at = 0
    while at < len(order):
        stop, least = at + 1, counts[order[at]]
        while stop < len(order) and counts[order[stop]] <= min(2 * least + 8, CELLS // (stop + 1 - at)):
            stop += 1
        yield order[at:stop]
        at = stop


def _marginals(evidence: np.ndarray, counts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The probability that each line is good."""
    ends = np.cumsum(counts)
    out = np.empty(len(evidence))
    for part in _parts(counts):
        rows = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in part])
        if len(part) == 1 and len(rows) > LONG:
            e = evidence[rows]
            out[rows] = _sigmoid(_chain(e, steps) + _chain(e[::-1], steps.T)[::-1] - e)
        else:
            f, b, place = forward_backward(evidence[rows], counts[part], steps)
            out[rows] = _sigmoid(f + b)[place]
    return out


def _shown(own: np.ndarray, model: dict) -> np.ndarray:
    """What the features of a line say about itself, the line behind it and the line before it."""
    return ((own - model["mean"]) / model["scale"]) @ model["weights"][: 3 * OWN].reshape(3, OWN).T


def _qualities(shown: np.ndarray, sizes: np.ndarray, counts: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(counts)
    starts = ends - counts
    begin, end, always = model["weights"][3 * OWN :]
    before, after = np.roll(shown[:, 1], 1), np.roll(shown[:, 2], -1)
    before[starts], after[ends - 1] = begin, end
    marginals = _marginals(shown[:, 0] + before + after + always, counts, model["steps"])
    weights = sizes + 1  # an empty line still counts
    return np.add.reduceat(marginals * weights, starts) / np.add.reduceat(weights, starts), marginals


def qualities(own: np.ndarray, sizes: np.ndarray, counts: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Length-weighted mean marginal of each text, and the marginal of each line."""
    return _qualities(_shown(own, model), sizes, counts, model)


def text_qualities(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The same from whole texts, with the features of no more than ``BLOCK`` lines at once."""
    lines, counts, repeated = _lines(texts)
    shown, sizes = np.empty((len(lines), 3)), np.empty(len(lines))
    for at in range(0, len(lines), BLOCK):
        own, sizes[at : at + BLOCK] = _features(lines[at : at + BLOCK], repeated[at : at + BLOCK])
        shown[at : at + BLOCK] = _shown(own, model)
    return _qualities(shown, sizes, counts, model)


def fit(own: np.ndarray, sizes: np.ndarray, counts: np.ndarray, labels: np.ndarray, share: float) -> dict:
    """Maximum likelihood with Adam; ``share`` is the share of label 1 that the score is set to."""
    mean, scale = own.mean(0), own.std(0) + 1e-3
    x = with_neighbours((own - mean) / scale, counts)
    y = np.repeat(labels.astype(float), counts)
    weights, steps = np.zeros(x.shape[1]), np.zeros((2, 2))
    order = np.argsort(counts, kind="stable")
    ends = np.cumsum(counts)
    parts = []
    for part in np.array_split(order, max(1, len(order) // 512)):
        rows = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in part])
        parts.append((x[rows], y[rows], counts[part], labels[part].astype(int)))
    moment, speed = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    for turn in range(1, ROUNDS + 1):
        slope = np.zeros(len(weights) + 4)
        for xs, ys, ns, own_labels in parts:
            e = xs @ weights
            f, b, place = forward_backward(e, ns, steps)
            slope[:-4] += (ys - _sigmoid(f + b)[place]) @ xs
            if f.shape[1] > 1:
                padded, _ = _padded(e, ns)
                here, ahead = f[:, :-1], (padded + b)[:, 1:]
                scores = np.stack([np.zeros_like(here) + steps[0, 0], ahead + steps[0, 1], here + steps[1, 0], here + ahead + steps[1, 1]])
                scores = np.exp(scores - scores.max(0))
                both = (scores / scores.sum(0))[:, place[:, 1:]].sum(1)
                runs = np.bincount(own_labels, ns - 1, minlength=2)
                slope[-4:] += np.array([runs[0], 0, 0, runs[1]]) - both
        slope = slope / len(y) - RIDGE * np.concatenate([weights, steps.ravel()])
        moment = 0.9 * moment + 0.1 * slope
        speed = 0.99 * speed + 0.01 * slope**2
        move = RATE * (moment / (1 - 0.9**turn)) / (np.sqrt(speed / (1 - 0.99**turn)) + 1e-8)
        weights += move[:-4]
        steps += move[-4:].reshape(2, 2)
    model = {"mean": mean, "scale": scale, "weights": weights, "steps": steps}
    model["curve"] = _curve(qualities(own, sizes, counts, model)[0], labels, share)
    return model


def _logit(q: np.ndarray) -> np.ndarray:
    return np.log(np.clip(q, 1e-6, 1 - 1e-6) / np.clip(1 - q, 1e-6, 1))


def _curve(q: np.ndarray, labels: np.ndarray, share: float) -> np.ndarray:
    """Logistic curve over the log-odds of the quality, by damped Newton steps."""
    x = np.column_stack([_logit(q), np.ones(len(q))])
    y = labels.astype(float)
    own = y.mean()
    weight = np.where(y == 1, share / max(own, 1e-9), (1 - share) / max(1 - own, 1e-9))
    curve = np.array([0.5, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ curve)
        slope = x.T @ (weight * (y - p)) - 1e-3 * curve
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        curve = curve + np.clip(np.linalg.solve(bend, slope), -1, 1)
    return curve


def _stretch(text: str) -> slice:
    """``LINES`` lines of a text, from a place that its hash tells; all of a shorter one."""
    n = text.count("\n") + 1
    start = zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, n - LINES + 1)
    return slice(start, min(n, start + LINES))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches, "text"):
        own, sizes, counts = [], [], []
        for text in texts:
            lines, _, repeated = _lines([text])
            part = _stretch(text)
            features = _features(lines[part], repeated[part])
            own.append(features[0].ravel())
            sizes.append(features[1])
            counts.append(len(features[1]))
        counts = np.array(counts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality"), pa.array(counts), ragged(np.concatenate(sizes), counts), ragged(np.concatenate(own), counts * OWN)],
            ["quality", "n", "sizes", "features"],
        )


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """Fit on at most ``per_class`` documents of each label outside the held-out third, and at most ``LINES`` lines of each.

    NULL labels, labels other than 0 and 1, and ids with contradicting labels are left out. With one label or none the model
    is neutral: every score is the share of label 1 (0.5 without labels).
    """
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    usable = usable.filter("quality = other").drop("other")
    known = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    picks = [usable.filter(F.col("quality") == v).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(per_class) for v in (0, 1)]
    sample = F.broadcast(picks[0].unionByName(picks[1]))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("text", "quality")
    rows = mapped(rows, _featured, "quality int, n bigint, sizes array<double>, features array<double>").toArrow()
    total = sum(known.values())
    share = known.get(1, 0) / total if total else 0.5
    y = np.array(rows["quality"].to_pylist())
    if len(set(y.tolist())) < 2:
        width = 3 * OWN + 3
        return {"mean": np.zeros(OWN), "scale": np.ones(OWN), "weights": np.zeros(width), "steps": np.zeros((2, 2)),
                "curve": np.array([0.0, _logit(np.array([share]))[0]])}
    counts = rows["n"].to_numpy()
    own = rows["features"].combine_chunks().flatten().to_numpy().reshape(-1, OWN)
    sizes = rows["sizes"].combine_chunks().flatten().to_numpy()
    order = np.lexsort((np.add.reduceat(own.sum(1), np.cumsum(counts) - counts), y))  # whatever order tasks ended in
    starts = np.cumsum(counts) - counts
    lines = np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in order])
    return fit(own[lines], sizes[lines], counts[order], y[order], share)


def held_out(doc_id) -> F.Column:
    """The third of all rows that is never trained on; a NULL id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _scorer(model: dict):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            quality, _ = text_qualities(texts, model)
            scores = _sigmoid(_logit(quality) * model["curve"][0] + model["curve"][1])
            columns = {n: batch.column(n) for n in batch.schema.names}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(scores)], [*columns, "score"])

    return score


def scored(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """``docs`` with the score of its column ``text`` added; NULL scores as the empty text."""
    if "score" in docs.columns:  # a clashing column keeps its name, ours takes the one asked for
        kept = docs.withColumnRenamed("score", "score_before")
        out = scored(kept, model, "score_new")
        return out.withColumnRenamed("score_before", "score").withColumnRenamed("score_new", column)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = mapped(docs, _scorer(model), f"{fields}, score double")
    return out if column == "score" else out.withColumnRenamed("score", column)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Only the text enters a score. Every row gets its own result: NULL ids, equal rows and empty
    texts too. Extra columns are ignored; an empty table gives no rows.
    """
    model = train(docs, labels, per_class)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
