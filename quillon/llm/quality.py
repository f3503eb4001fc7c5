"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed for many documents at once with numpy. Trees are grown on a bounded
sample of labelled documents (``TRAIN_ROWS``), whose statistics alone reach the driver, and flattened into
arrays of feature, threshold, children and value; scoring walks all trees for all documents of a batch level by
level with array indexing. The arrays take some 100 KB whatever the corpus, and travel with the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

#: Labelled documents that the trees learn from, at most; chosen by a hash of their ids.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3

_MARKS = b"|$&%#*<>{}@/\\=+_-:;!?,.\"'()[]~^`"
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[128:192], _CLASS[192:] = 6, 7
for _i, _c in enumerate(_MARKS):
    _CLASS[_c] = 8 + _i
_N_CLASS = 8 + len(_MARKS)
NAMES = [f"class_{i}" for i in range(_N_CLASS)] + [
    "log_bytes", "log_words", "word_len", "word_len_sd", "long_words", "distinct_words", "top_word", "distinct_pairs", "log_lines", "line_len",
    "distinct_lines", "top_line", "runs", "end_lines", "entropy", "one_letter", "once", "caps_words",
]


def _top_and_distinct(group: np.ndarray, value: np.ndarray, groups: int):
    """Per group: distinct values, the most frequent one's count, values that occur once."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(g)))
    top = np.zeros(groups)
    np.maximum.at(top, g[at], runs)
    return np.bincount(g[at], minlength=groups).astype(float), top, np.bincount(g[at][runs == 1], minlength=groups).astype(float)


def statistics(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Statistics (one row per text, one column per NAMES) of texts given as UTF-8; empty texts have zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(doc * _N_CLASS + _CLASS[data], minlength=n * _N_CLASS).reshape(n, _N_CLASS) / some[:, None]
    low, edge, stop, first = words.spans(offsets, data)
    h = words.digests(low, edge, stop)
    count = np.diff(first).astype(float)
    word_doc = np.repeat(np.arange(n), np.diff(first))
    length = (stop - edge).astype(float)
    w = np.maximum(count, 1)
    mean_len = np.bincount(word_doc, length, minlength=n) / w
    var = np.bincount(word_doc, length**2, minlength=n) / w - mean_len**2
    distinct, top, once = _top_and_distinct(word_doc, h, n)
    pair_ok = word_doc[1:] == word_doc[:-1]
    pairs = words.mix(h[1:] * words.U(words.BASE) + h[:-1])[pair_ok]
    pair_doc = word_doc[1:][pair_ok]
    d_pairs = _top_and_distinct(pair_doc, pairs, n)[0] / np.maximum(np.bincount(pair_doc, minlength=n), 1)
    cut = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1][size > 0], cut + 1])) if len(data) else np.zeros(0, np.int64)
    start = start[start < len(data)]
    line_doc = doc[start]
    end = np.minimum(np.append(start[1:], len(data)), offsets[1:][line_doc]) if len(start) else start
    lines = np.bincount(line_doc, minlength=n).astype(float)
    lh = words.span_hash(words.prefix_hash(data), start, end)
    d_lines, top_line, _ = _top_and_distinct(line_doc, lh, n)
    tail = np.maximum(end - 1 - (data[np.maximum(end - 1, 0)] == 10), 0)
    closed = np.bincount(line_doc, np.isin(data[tail], np.frombuffer(b".!?\"')", np.uint8)) & (tail >= start), minlength=n)  # an empty line has no end
    same = np.bincount(doc[1:][(data[1:] == data[:-1]) & (doc[1:] == doc[:-1])], minlength=n) if len(data) else np.zeros(n)
    p = np.where(kinds > 0, kinds, 1)
    ln = np.maximum(lines, 1)
    caps = np.bincount(word_doc[_CLASS[data[edge]] == 2], minlength=n)
    extra = [np.log1p(size), np.log1p(count), mean_len, np.sqrt(np.maximum(var, 0)), np.bincount(word_doc[length > 12], minlength=n) / w, distinct / w, top / w, d_pairs, np.log1p(lines), size / ln, d_lines / ln, top_line / ln, same / some, closed / ln, -(p * np.log(p)).sum(axis=1), np.bincount(word_doc[length == 1], minlength=n) / w, once / w, caps / w]
    return np.column_stack([kinds, *extra])


class Trees:
    """Boosted trees as flat arrays; node i goes to left[i] where x[feature[i]] <= threshold[i], else to right[i]."""

    def __init__(self, base, feature, threshold, left, right, value, roots, depth):
        self.base, self.feature, self.threshold, self.left, self.right, self.value, self.roots, self.depth = base, feature, threshold, left, right, value, roots, depth

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        out = np.full(len(x), self.base)
        for at in range(0, len(x), 4096):
            rows = x[at : at + 4096]
            node = np.tile(self.roots, (len(rows), 1))
            line = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                go = rows[line, self.feature[node]] <= self.threshold[node]
                node = np.where(go, self.left[node], self.right[node])
            out[at : at + 4096] += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Logistic boosting on histograms of binned statistics. Without rows of both labels the score is constant."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        empty = np.zeros(0, np.int64)
        return Trees(float(np.log(share / (1 - share))), empty, np.zeros(0), empty, empty, np.zeros(0), empty, 0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])  # bin b: value <= cuts[b]
    n, m = x.shape
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node():
        for a, v in ((feature, 0), (threshold, np.inf), (left, len(feature) - 1), (right, len(feature) - 1), (value, 0.0)):
            a.append(v)
        left[-1] = right[-1] = len(feature) - 1
        return len(feature) - 1

    columns = np.arange(m) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, w = y - p, np.maximum(p * (1 - p), 1e-9)
        roots.append(node())
        leaves = [(roots[-1], np.arange(n), 0)]
        while leaves:
            k, rows, level = leaves.pop()
            total_g, total_w = g[rows].sum(), w[rows].sum()
            best = None
            if level < depth and len(rows) >= 2 * least:
                flat = (binned[rows] + columns).ravel()
                hist = [np.bincount(flat, z, minlength=m * bins).reshape(m, bins).cumsum(axis=1) for z in (np.repeat(g[rows], m), np.repeat(w[rows], m), None)]
                gl, wl, nl = hist
                gain = gl**2 / (wl + ridge) + (total_g - gl) ** 2 / (total_w - wl + ridge) - total_g**2 / (total_w + ridge)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                f, b = divmod(int(gain.argmax()), bins)
                if gain[f, b] > 1e-6 and b < len(cuts[f]):
                    best = f, b
            if best is None:
                value[k] = rate * total_g / (total_w + ridge)
                score[rows] += value[k]
                continue
            f, b = best
            feature[k], threshold[k] = f, cuts[f][b]
            low = binned[rows, f] <= b
            for side, own in ((left, rows[low]), (right, rows[~low])):
                side[k] = node()
                leaves.append((side[k], own, level + 1))
    return Trees(base, *(np.array(a) for a in (feature, threshold, left, right, value, roots)), depth)


def _measure(batches):
    for b in common.slices(batches, "text"):
        x = statistics(*common.offsets_of(b.column(1)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "x"])


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text is divisible by 5. A null id isn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees for P(label = 1), learned from labelled rows outside held_out().

    Of repeated labels of an id the mean decides (0.5 counts as 1); null labels and ids are no labels. At most
    ``train_rows`` labels, those with the smallest hashes of their ids, are looked up among the documents, and of
    rows that share an id the one whose text has the smallest hash is learned from; so what is broadcast and what
    reaches the driver is bounded by that parameter.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    chosen = common.saved(known.orderBy(F.xxhash64("_id"), "_id").limit(train_rows), "labels")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    # One row for each id is kept before anything is collected; rows are combined where they lie.
    one = rows.groupBy("_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "label", "text")).alias("row")).select("row.label", "row.text")
    got = one.mapInArrow(_measure, "label int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    y = np.array(got.column("label").to_pylist(), float)
    order = np.lexsort([*x.T, y])  # the same trees whatever the order of the rows
    return grow(x[order], y[order])


def scored(docs: DataFrame, trees: Trees, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a double column ``score`` (0 to 1) of the whole text; null and empty texts get a score as well."""
    if score in docs.columns:
        raise ValueError(f"there is a column {score} already")

    def run(batches):
        for b in common.slices(batches, text):
            p = trees.predict(statistics(*common.offsets_of(b.column(b.schema.get_field_index(text)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, score])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold) per document; the text alone decides the score.

    Null and empty texts are scored as texts without statistics. Repeated rows get equal scores. Without labels of
    both kinds every score is the labels' share (0.5 without labels). Other columns are not read.
    """
    trees = train(docs, labels)
    rows = scored(docs.select("doc_id", "text"), trees)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
