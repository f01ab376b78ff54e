"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from every whole text inside the tasks that read it. Trees are
fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, the rows of smallest
hash, so the same rows each time), flattened into arrays, and walked by all of a
batch's rows at once.

Defined cases: a null or empty text has statistics of zero and gets a score like any
other; rows alike get scores alike; other columns are never read. Labels that are
null or not 0 or 1 are left out, of several labels of a document the largest counts.
Without labels, or with one class only, every score is that class's smoothed share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fjordbook.llm import words as W
from fjordbook.llm.common import table, whole_row

#: At most so many labelled rows are fitted.
SAMPLE_ROWS = 20_000
#: A score from here on means quality 1.
THRESHOLD = 0.3
BINS, TREES, DEPTH, RATE, RIDGE, LEAST_ROWS = 64, 80, 4, 0.15, 1.0, 10.0

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "stop": b".,;:", "quote": b"'\"()-", "mark": b"#$%&*@^~+=_/\\<>[]{}", "bar": b"|", "shout": b"!?",
    "line": b"\n", "blank": b" \t\r",
}
NAMES = [
    "log_bytes", "log_words", "log_lines", "word_bytes", "longest_word", *CLASSES, "high", "distinct_words", "repeated_words",
    "distinct_pairs", "distinct_triples", "top_word", "words_ending_in_mark", "words_all_upper", "words_without_letter", "short_words", "distinct_lines",
]


def _per_text(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between borders."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[borders])


def _distinct(hashed: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of distinct hashes, and how often the commonest occurs."""
    keys = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (hashed >> np.uint64(20)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    whose = (keys[at] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, whose, np.diff(np.append(at, len(keys))))
    return np.bincount(whose, minlength=n), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` per text of the buffer."""
    out = np.zeros((len(offsets) - 1, len(NAMES)), np.float32)
    for low, high in W.slices(offsets):
        out[low:high] = _slice_statistics(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
    return out


def _slice_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    starts, ends, first = W.spans(data, offsets)
    hashed = W.hashes(data, starts, ends)
    size, owner = ends - starts, np.repeat(np.arange(n), np.diff(first))
    n_bytes, n_words = np.diff(offsets), np.diff(first)
    share = lambda x, of: x / np.maximum(of, 1)
    columns = {"log_bytes": np.log1p(n_bytes), "log_words": np.log1p(n_words), "word_bytes": share(_per_text(size, first), n_words)}
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, size)
    columns["longest_word"] = np.log1p(longest)
    member = {name: np.isin(np.arange(256), list(chars)) for name, chars in CLASSES.items()}
    flags = {name: is_in[data] for name, is_in in member.items()}
    for name, is_in in flags.items():
        columns[name] = share(_per_text(is_in, offsets), n_bytes)
    columns["high"] = share(_per_text(data >= 128, offsets), n_bytes)

    distinct, most = _distinct(hashed, owner, n)
    columns["distinct_words"], columns["top_word"] = share(distinct, n_words), share(most, n_words)
    again = np.zeros(len(hashed), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
    columns["repeated_words"] = share(_per_text(again, first), n_words)
    for k, name in ((2, "distinct_pairs"), (3, "distinct_triples")):
        grams = W.shingles(hashed, k)
        inside = owner[:len(grams)] == owner[k - 1:] if len(grams) else np.empty(0, bool)
        whose = owner[:len(grams)][inside]
        columns[name] = share(_distinct(grams[inside], whose, n)[0], np.bincount(whose, minlength=n))
    marks = member["mark"] | member["bar"] | member["shout"]
    columns["words_ending_in_mark"] = share(_per_text(marks[data[ends - 1]] if len(ends) else np.empty(0, bool), first), n_words)
    letter = member["upper"] | member["lower"] | (np.arange(256) >= 128)
    in_word = lambda flag: np.concatenate([[0], np.cumsum(flag)])[ends] - np.concatenate([[0], np.cumsum(flag)])[starts]
    letters, lowers, uppers = (in_word(x) for x in (letter[data], flags["lower"], flags["upper"]))
    columns["words_all_upper"] = share(_per_text((lowers == 0) & (uppers > 0), first), n_words)
    columns["words_without_letter"] = share(_per_text(letters == 0, first), n_words)
    columns["short_words"] = share(_per_text(size <= 3, first), n_words)

    breaks = np.flatnonzero(flags["line"])
    borders = np.unique(np.concatenate([offsets[:-1][n_bytes > 0], breaks + 1])) if len(data) else np.empty(0, np.int64)
    borders = borders[borders < len(data)]
    stops = np.append(borders[1:], len(data))[:len(borders)]
    stops = stops - flags["line"][stops - 1] if len(stops) else stops
    whose = np.searchsorted(offsets, borders, "right") - 1
    n_lines = np.bincount(whose, minlength=n)
    columns["log_lines"] = np.log1p(n_lines)
    columns["distinct_lines"] = share(_distinct(W.hashes(data, borders, stops), whose, n)[0], n_lines)
    return np.stack([columns[name] for name in NAMES], axis=1).astype(np.float32)


@dataclass
class Trees:
    """A boosted forest as flat arrays: node i goes to ``left[i]`` if its statistic is at most ``cut[i]``."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, all rows and trees a level at a time."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost depth-limited trees on binned statistics with the logistic loss."""
    n, width = x.shape
    share = (y.sum() + 1.0) / (n + 2.0)
    start = float(np.log(share / (1 - share)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}

    def add(value: float) -> int:
        for k, v in (("feature", 0), ("cut", np.inf), ("left", 0), ("right", 0), ("value", value)):
            nodes[k].append(v)
        here = len(nodes["value"]) - 1
        nodes["left"][here] = nodes["right"][here] = here  # a leaf leads to itself
        return here

    roots = []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        total = np.full(n, start)
        for _ in range(TREES):
            p = 1.0 / (1.0 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            root = add(0.0)
            roots.append(root)
            at, level = np.full(n, root), [root]
            for _ in range(DEPTH):
                low, count = level[0], len(level)
                active = at >= low
                slot = (at - low)[active] * BINS
                best = np.zeros(count)
                choice = np.full((count, 2), -1)
                for j in range(width):
                    key = slot + binned[active, j]
                    gs, hs, ns = (np.bincount(key, w, minlength=count * BINS).reshape(count, BINS) for w in (g[active], h[active], np.ones(active.sum())))
                    gl, hl, nl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1], ns.cumsum(1)[:, :-1]
                    gt, ht, nt = gs.sum(1)[:, None], hs.sum(1)[:, None], ns.sum(1)[:, None]
                    gain = gl**2 / (hl + RIDGE) + (gt - gl)**2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                    gain = np.where((nl >= LEAST_ROWS) & (nt - nl >= LEAST_ROWS), gain, 0)
                    top = gain.argmax(1)
                    better = gain[np.arange(count), top] > best + 1e-9
                    best = np.where(better, gain[np.arange(count), top], best)
                    choice[better, 0], choice[better, 1] = j, top[better]
                following = []
                for i, node in enumerate(level):
                    if choice[i, 0] < 0:
                        continue
                    j, b = int(choice[i, 0]), int(choice[i, 1])
                    if b >= len(cuts[j]):
                        continue
                    nodes["feature"][node], nodes["cut"][node] = j, float(cuts[j][b])
                    here = at == node
                    goes_left = binned[:, j] <= b
                    for side, rows in (("left", here & goes_left), ("right", here & ~goes_left)):
                        child = add(RATE * g[rows].sum() / (h[rows].sum() + RIDGE))
                        nodes[side][node] = child
                        at[rows] = child
                        following.append(child)
                if not following:
                    break
                level = following
            total += np.array(nodes["value"])[at]
    return Trees(start, np.array(roots, np.int64), np.array(nodes["feature"], np.int64), np.array(nodes["cut"], np.float64),
                 np.array(nodes["left"], np.int64), np.array(nodes["right"], np.int64), np.array(nodes["value"], np.float64), DEPTH)


def is_held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fifth; the driver gets their statistics only."""
    one = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            data, offsets = W.buffer(batch.column("text"))
            found = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality").cast(pa.int32()), W.lengths(pa.array(found.ravel()), np.arange(0, found.size + 1, len(NAMES)))],
                ["doc_id", "quality", "x"])

    rows = texts.select("doc_id", "text", "quality").mapInArrow(W.lean(run), "doc_id long, quality int, x array<float>").toPandas()
    rows = rows.iloc[np.lexsort([rows["quality"], rows["doc_id"]])]  # the order tasks end in is no input
    x = np.array(rows["x"].tolist(), np.float32).reshape(len(rows), len(NAMES))
    order = np.lexsort([*x.T, rows["doc_id"].to_numpy()]) if len(rows) else np.empty(0, np.int64)
    return fit(x[order], rows["quality"].to_numpy(np.float64)[order])


def scored(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """``(row, score)``: all columns of ``docs`` as one, and the score, in one pass without a shuffle."""
    def run(batches):
        for batch in batches:
            found = trees.score(statistics(*W.buffer(pc.struct_field(batch.column("row"), [at]))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found)], ["row", "score"])

    at = docs.columns.index(text)
    rows = docs.select(whole_row(docs).alias("row"))
    return rows.mapInArrow(W.lean(run), T.StructType([rows.schema["row"]]).add("score", "double"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document."""
    trees = train(docs, labels)
    def run(batches):
        for batch in batches:
            found = trees.score(statistics(*W.buffer(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(W.lean(run), "doc_id long, score double")
    return rows.select(
        "doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
