"""Similarity self-join on word shingles through a MinHash LSH forest, verified exactly.

Documents with equal shingle sets are one class. Each class has TREES labels of DEPTH MinHash values. A tree is the
sorted list of its labels, a prefix trie in order: classes that share a prefix are neighbours there. The matched
prefix starts at full depth and is shortened until two conditions hold: a pair at the threshold shares it in some tree
with the target probability, and the recall that is measured reaches the target (every class is compared with SAMPLE
sampled ones by their whole signatures, and of the pairs above the threshold those count that share the prefix in some
tree). One pass over the sorted trees gives the runs of classes with equal prefixes; a run that crosses from one
task's range to the next needs no stitching, as tree and prefix name it. Runs with the same members are one.

The pairs of a run are verified, those of its transitive closure aren't. A run's classes are dealt into blocks, and a
task counts the common shingles of two blocks by a matrix product, with hashes that are independent of those of the
labels. A pair that shares a prefix in several trees counts in the first of them, which its labels tell. A task emits
per class the links and the smallest linked document, never the pairs.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import common, words
from .components import components

TREES, DEPTH = 16, 6
#: Shingles and classes of a block; a run has up to SPREAD blocks by its classes, and more by its shingles alone.
BLOCK, BLOCK_ROWS, SPREAD = 400_000, 256, 16
#: Classes whose neighbours are all looked for to measure the recall: 200 KB on the driver.
SAMPLE = 512
_FACTORS = words.mix(np.arange(1001, 1001 + TREES * DEPTH, dtype=np.uint64)) | words.U(1)


def prefix_length(threshold: float, target: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that a pair at ``threshold`` shares in some tree with probability ``target``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def minhash(x: np.ndarray) -> bytes:
    """TREES * DEPTH values of 4 bytes, big-endian so that byte strings sort like the values."""
    low = np.full(len(_FACTORS), words.U(2**64 - 1))
    for at in range(0, len(x), 2048):
        np.minimum(low, (x[at : at + 2048, None] * _FACTORS).min(axis=0), out=low)
    return (low & words.U(0xFFFFFFFF)).astype(">u4").tobytes()


def _sets(offsets, data, size: int, seed: int = 0):
    """Distinct shingles of each text, ascending."""
    h, at = words.shingles(*words.words(offsets, data, seed), size)
    for i in range(len(at) - 1):
        yield np.unique(h[at[i] : at[i + 1]])


def _sums(x: np.ndarray) -> tuple[int, int]:
    """Two sums that tell a set of shingles."""
    return tuple(np.array([x.sum(dtype=np.uint64), words.mix(x).sum(dtype=np.uint64)], np.uint64).view(np.int64).tolist())


def _signed(size: int):
    def run(batches):
        for b in common.slices(batches, "text"):
            rows: list[list] = [[], [], [], []]
            for x in _sets(*common.offsets_of(b.column(1)), size):
                for held, v in zip(rows, (len(x), *_sums(x), minhash(x) if len(x) else None)):
                    held.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(r, pa.int64()) for r in rows[:3]), pa.array(rows[3], pa.binary())], ["doc_id", "n", "set_a", "set_b", "label"])

    return run


def _values(labels) -> np.ndarray:
    """Labels as an array of (class, tree, value)."""
    return np.frombuffer(b"".join(labels), ">u4").astype(np.uint32).reshape(-1, TREES, DEPTH)


def _shared_depths(ids: list[int], sample: np.ndarray, threshold: float):
    """Per batch of (cid, label): how many pairs above the threshold share a prefix of 0, 1 ... DEPTH values at most."""

    def run(batches):
        counts = np.zeros(DEPTH + 1, np.int64)
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            own, cid = _values(b.column(1).to_pylist()), b.column(0).to_numpy()
            flat, other = own.reshape(len(own), -1).T.copy(), sample.reshape(len(sample), -1).T.copy()
            for at in range(0, len(own), 2048):
                equal = np.zeros((min(2048, len(own) - at), len(sample)), np.uint8)
                for x, y in zip(flat[:, at : at + 2048], other):
                    equal += x[:, None] == y
                i, j = np.nonzero((equal >= threshold * TREES * DEPTH) & (cid[at : at + 2048, None] != np.array(ids)))
                for k in range(0, len(i), 100_000):
                    depth = np.cumprod(own[i[k : k + 100_000] + at] == sample[j[k : k + 100_000]], axis=2).sum(axis=2).max(axis=1)
                    counts += np.bincount(depth, minlength=DEPTH + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DEPTH + 1)), pa.array(counts)], ["depth", "pairs"])

    return run


def measured_recalls(labels: DataFrame, threshold: float, sample: int = SAMPLE) -> list[float]:
    """Recall of prefixes of 1 ... DEPTH values: of the pairs of a sampled class and any class above the threshold by
    their signatures, the share that has such a prefix in common in some tree. 1.0 where there are no such pairs."""
    chosen = labels.select("cid", "label").orderBy(F.xxhash64("label"), "label").limit(sample).collect()  # by their labels: the same ones whatever the partitioning
    run = _shared_depths([r["cid"] for r in chosen], _values(bytes(r["label"]) for r in chosen), threshold)
    found = {r["depth"]: r["pairs"] for r in labels.select("cid", "label").mapInArrow(run, "depth long, pairs long").groupBy("depth").agg(F.sum("pairs").alias("pairs")).collect()}
    total = sum(found.values())
    return [sum(n for d, n in found.items() if d >= k) / total if total else 1.0 for k in range(1, DEPTH + 1)]


def adapted_prefix(labels: DataFrame, threshold: float, target: float) -> int:
    """The longest prefix with the target probability for a pair at the threshold and the target recall as measured."""
    recalls = measured_recalls(labels, threshold)
    length = prefix_length(threshold, target)
    while length > 1 and recalls[length - 1] < target:
        length -= 1
    return length


def _runs(prefix: int):
    """Members (tree, prefix, cid, n) of runs in one range of the sorted trees; at its two ends single ones too."""
    width = 4 * prefix

    def run(batches):
        held, key, first = None, None, True
        for b in batches:
            out = []
            for t, l, c, n in zip(*(x.to_pylist() for x in b.columns)):
                own = (t, l[:width])
                if own != key:
                    if held is not None and first:
                        out.append(held)  # it may go on from the range before
                    first, key, held = key is None, own, (*own, c, n)
                else:
                    if held is not None:
                        out.append(held)
                        held = None
                    out.append((*own, c, n))
            yield _members(out)
        if held is not None:
            yield _members([held])  # it may go on in the next range

    return run


def _members(rows):
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["tree", "prefix", "cid", "n"])


def forest_runs(labels: DataFrame, prefix: int, parts: int) -> DataFrame:
    """(run, tree, members, total, cid) from (cid, n, label): the classes of each run of several with equal prefixes."""
    trees = labels.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "label", "cid", "n").select("tree", F.substring("label", F.col("tree") * 4 * DEPTH + 1, F.lit(4 * DEPTH)).alias("label"), "cid", "n")
    ranged = trees.repartitionByRange(parts, "tree", "label", "cid").sortWithinPartitions("tree", "label", "cid")
    found = common.saved(ranged.mapInArrow(_runs(prefix), "tree int, prefix binary, cid long, n long"), "runs")
    sizes = found.groupBy("tree", "prefix").agg(F.count("*").alias("members"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.sum(F.xxhash64("cid", F.lit(1)).cast("decimal(38,0)")).alias("y")).where("members > 1")
    # The same classes in several trees are one run, that of the first tree: a pair of them counts there at the latest.
    kept = sizes.groupBy("members", "total", "x", "y").agg(F.min(F.struct("tree", "prefix")).alias("first")).select("first.*", "members", "total")
    kept = common.saved(kept.withColumn("run", F.monotonically_increasing_id()), "kept")
    return common.attach(found.drop("n"), kept, ["tree", "prefix"], "members", found.count()).select("run", "tree", "members", "total", "cid")


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set in a with every set in b."""
    flat = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(flat, kind="stable")
    value, row = flat[order], row[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    column = np.cumsum(new) - 1
    left, right = row < len(a), row >= len(a)
    both = (np.bincount(column[left], minlength=column[-1] + 1) > 0) & (np.bincount(column[right], minlength=column[-1] + 1) > 0)
    dense = np.cumsum(both) - 1
    keep = both[column]
    row, column = row[keep], dense[column[keep]]
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(both.sum()), 4096):
        chunk = (column >= at) & (column < at + 4096)
        m = np.zeros((len(a) + len(b), min(4096, int(both.sum()) - at)), np.float32)
        m[row[chunk], column[chunk] - at] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def _linked(a, b, threshold):
    """Boolean matrix of the pairs with Jaccard similarity >= threshold; a and b are lists of Member."""
    shared = common_counts([x.shingles for x in a], [x.shingles for x in b]).astype(float)
    union = np.array([len(x.shingles) for x in a])[:, None] + np.array([len(x.shingles) for x in b]) - shared
    nodes = np.array([x.node for x in a])[:, None], np.array([x.node for x in b])
    return (shared >= threshold * union - 1e-9) & (nodes[0] != nodes[1])


def _earlier(a, b, tree: int, prefix: int):
    """Boolean matrix of the pairs that share a prefix in a tree before ``tree``, and so count there."""
    out = np.zeros((len(a), len(b)), bool)
    width = 4 * prefix
    for t in range(tree):
        at = 4 * DEPTH * t
        names = np.unique([x.label[at : at + width].hex() for x in (*a, *b)], return_inverse=True)[1]
        out |= names[: len(a), None] == names[len(a) :]
    return out


class Member:
    __slots__ = ("block", "cid", "node", "weight", "label", "shingles")

    def __init__(self, *values):
        self.block, self.cid, self.node, self.weight, self.label, self.shingles = values


def _verify(threshold: float, prefix: int):
    """Rows (run, i, j, tree, block, cid, node, weight, label, shingles) in order of (run, i, j) -> cid, node, links, root."""
    most = np.int64(2**63 - 1)

    def rows(batches):
        for b in batches:
            *head, sets = b.columns
            values, off = np.asarray(sets.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64), sets.offsets.to_numpy()
            for k, r in enumerate(zip(*(c.to_pylist() for c in head))):
                yield r[:4], Member(*r[4:], values[off[k] : off[k + 1]].copy())

    def run(batches):
        out = []
        for (_, i, j, tree), own in groupby(rows(batches), key=lambda r: r[0]):
            held = {m.cid: m for _, m in own}  # repeated rows of a document count once
            a = [m for m in held.values() if m.block == i]
            b = a if i == j else [m for m in held.values() if m.block == j]
            if not a or not b:
                continue
            link = _linked(a, b, threshold)
            nodes_a, nodes_b = np.array([x.node for x in a]), np.array([x.node for x in b])
            roots_a, roots_b = nodes_a.copy(), nodes_b.copy()
            for _ in range(len(a) + len(b)):  # smallest node reachable in this pair of blocks
                na = np.minimum(roots_a, np.where(link, roots_b, most).min(axis=1))
                nb = na if i == j else np.minimum(roots_b, np.where(link.T, na, most).min(axis=1))
                if (na == roots_a).all() and (nb == roots_b).all():
                    break
                roots_a, roots_b = na, nb
            own_link = link & ~_earlier(a, b, tree, prefix)
            for side, other, matrix, roots in ((a, b, own_link, roots_a),) if i == j else ((a, b, own_link, roots_a), (b, a, own_link.T, roots_b)):
                links = matrix @ np.array([x.weight for x in other])
                out += [(x.cid, x.node, n, r) for x, n, r in zip(side, links.tolist(), roots.tolist()) if n]
            if len(out) > 20_000:
                yield _result(out)
                out = []
        yield _result(out)

    return run


def _result(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["cid", "node", "links", "root"])


def _shingled(size: int):
    """Rows (..., set_a, set_b, text) whose text has that set of shingles, with the set by independent hashes."""

    def run(batches):
        for b in common.slices(batches, "text"):
            offsets, data = common.offsets_of(b.column(b.schema.get_field_index("text")))
            told = zip(b.column(b.schema.get_field_index("set_a")).to_pylist(), b.column(b.schema.get_field_index("set_b")).to_pylist())
            keep = [i for i, (x, own) in enumerate(zip(_sets(offsets, data, size), told)) if _sums(x) == own]
            every = list(_sets(offsets, data, size, 1))
            sets = [every[i].view(np.int64) for i in keep]
            off = np.cumsum([0] + [len(x) for x in sets])
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            kept = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-3], lists], [*b.schema.names[:-3], "shingles"])

    return run


#: Ids of candidates that may be broadcast, 20 bytes each; with more of them all texts are shuffled to their candidates.
BROADCAST_IDS = 1_000_000


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, target: float = 0.995, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, class_id, copy_of, n_links per document.

    Two documents are linked when the Jaccard similarity of their sets of ``size``-word shingles is at least
    ``threshold`` (a text of fewer words has one shingle, all its words). n_links counts a document's links,
    class_id is the smallest id of its connected component, copy_of the smallest id with an equal shingle set.
    A pair at the threshold is found with probability ``target`` at least, more similar ones more surely.
    Texts without words (null and empty ones too) and rows with a null id link to nothing. Rows that share an
    id are one document: they don't link to each other, and where their ids stand for classes these are in one
    component. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    parts = common.partitions(spark, docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = common.saved(rows.mapInArrow(_signed(size), "doc_id long, n long, set_a long, set_b long, label binary"), "signatures")
    some = signed.where("n > 0 AND doc_id IS NOT NULL")
    groups = some.groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"))  # equal sets have equal labels
    groups = common.saved(groups.withColumn("cid", F.monotonically_increasing_id()), "classes")
    labels = groups.select("cid", "n", "label")
    prefix = adapted_prefix(labels, threshold, target)
    runs = common.saved(forest_runs(labels, prefix, parts), "members")
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK), F.least(F.ceil(F.col("members") / BLOCK_ROWS), F.lit(SPREAD))).cast("int")
    dealt = runs.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    per = dealt.groupBy("cid").agg(F.collect_list(F.struct("run", "tree", "blocks", "block")).alias("runs"))  # TREES of a class at most
    classes = common.saved(per.join(groups, "cid").select("cid", "node", "copies", "label", "runs", "set_a", "set_b"), "candidates")
    near = rows.withColumnRenamed("doc_id", "node")
    if classes.count() <= BROADCAST_IDS:
        near = near.join(F.broadcast(classes.select("node").distinct()), "node", "left_semi")
    texts = near.join(classes, "node").select("cid", "node", "copies", "label", "runs", "set_a", "set_b", "text")
    sets = texts.mapInArrow(_shingled(size), "cid long, node long, copies long, label binary, runs array<struct<run: long, tree: int, blocks: int, block: int>>, shingles array<long>")
    each = sets.withColumn("of", F.explode("runs")).select("of.*", "cid", "node", "copies", "label", "shingles")
    pairs = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("run", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "tree", "block", "cid", "node", "copies", "label", "shingles")
    ordered = pairs.repartition(parts, "run", "i", "j").sortWithinPartitions("run", "i", "j")
    found = common.saved(ordered.mapInArrow(_verify(threshold, prefix), "cid long, node long, links long, root long"), "verified")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = groups.drop("label").join(links, "cid", "left").join(roots, "node", "left")
    full = common.saved(known.select("set_a", "set_b", "n", "node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "labelled")
    keys = signed.select("doc_id", "n", "set_a", "set_b")
    named = common.attach(keys.where("n > 0 AND doc_id IS NOT NULL"), full, ["set_a", "set_b", "n"], "copies", some.count())
    alone = keys.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    return named.select("doc_id", F.col("root").alias("class_id"), F.col("node").alias("copy_of"), (F.col("links") + F.col("copies") - 1).alias("n_links")).unionByName(alone)


def _with_set(size: int, name: str):
    """Rows with a hash of the text's shingle set as a further column."""

    def run(batches):
        for b in common.slices(batches, "text"):
            sets = _sets(*common.offsets_of(b.column(b.schema.get_field_index("text"))), size)
            keys = [hashlib.md5(x.tobytes()).digest() for x in sets]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], [*b.schema.names, name])

    return run


def deduplicated(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of ``docs``, all their columns, whose id is the smallest of its class; one row of each id and set of shingles.

    Rows with a null id link to nothing and stay. Rows that share an id are one document to ``near_duplicates``: all
    of them go where one links to a smaller id. Where the id stays, so do its texts with different sets of shingles;
    of those with equal ones the smallest text stays, then the row that is the smallest as JSON. Other columns may have
    any names.
    """
    shared, key, whole = (common.fresh(docs.columns, name) for name in ("_shared", "_set", "_row"))
    kept = near_duplicates(docs, threshold, size).where("doc_id = class_id").select("doc_id").distinct()
    named = common.saved(docs.groupBy("doc_id").agg(F.count("*").alias(shared)).join(kept, "doc_id").withColumn(shared, F.col(shared) > 1), "named")
    rows = docs.join(named, "doc_id")
    unique = rows.where(~F.col(shared)).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
    if named.where(F.col(shared)).isEmpty():
        return unique
    sets = rows.where(F.col(shared)).select(*docs.columns).mapInArrow(_with_set(size, key), StructType([*docs.schema.fields, StructField(key, BinaryType())]))
    row = F.struct(*docs.columns)
    least = sets.groupBy("doc_id", key).agg(F.min_by(row, F.struct("text", F.to_json(row))).alias(whole)).select(f"{whole}.*")
    return unique.unionByName(least)


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
