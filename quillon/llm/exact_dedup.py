"""Exact deduplication through cuckoo-filter indexes over digests of normalised texts.

Each input partition first runs its rows through a local index, which combines copies where they lie; what is
left (one row per distinct digest and partition) is dealt out by digest to index shards. So a group that holds
a third of the corpus arrives at its shard as one row per input partition, and no task sees its rows.

In an index, a cuckoo filter of 16-bit fingerprints decides first: a digest whose fingerprint isn't there is new
and is stored without a look at what is stored. A hit is verified against the bucketed content: the entries (SHA-256
of the whole normalised text, and the row that stays) are chained by the filter's bucket of their key, and only that
chain is compared. Inserting into a full filter doubles it and its buckets from the stored keys. Deleting a live
digest takes its entry from the chain and one fingerprint from the filter. Entries are rows of numpy arrays, some 70
bytes each; shards grow in number with the documents (``common.partitions``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import mix

SLOTS = 4
KICKS = 64


class CuckooFilter:
    """Fingerprints of 64-bit keys in buckets of four slots; each has two buckets, the second from the first."""

    def __init__(self, buckets: int = 1024):
        self.table = np.zeros((1 << (buckets - 1).bit_length(), SLOTS), np.uint16)
        self.size = 0

    def _places(self, keys: np.ndarray):
        mask = np.uint64(len(self.table) - 1)
        print_ = (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        one = (keys & mask).astype(np.int64)
        return print_, one, self._other(one, print_)

    def _other(self, bucket, print_):
        return bucket ^ (mix(print_.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, a, b = self._places(keys)
        return ((self.table[a] == p[:, None]) | (self.table[b] == p[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Insert all keys, or return False when some fingerprint finds no slot (the filter is then to be rebuilt)."""
        if self.size + len(keys) > 0.9 * self.table.size:
            return False
        p, at, _ = self._places(keys)
        self.size += len(keys)
        kick = np.zeros(len(p), np.int64)
        for step in range(KICKS):
            if not len(p):
                return True
            for _ in range(2):  # an empty slot in this bucket, then in the other; one key a bucket and pass
                free = self.table[at] == 0
                _, lead = np.unique(at, return_index=True)
                lead = lead[free[lead].any(axis=1)]
                self.table[at[lead], free[lead].argmax(axis=1)] = p[lead]
                left = np.ones(len(p), bool)
                left[lead] = False
                p, at, kick = p[left], at[left], kick[left]
                at = self._other(at, p)
            if not len(p):
                return True
            full = (self.table[at] != 0).all(axis=1)
            _, lead = np.unique(at, return_index=True)
            lead = lead[full[lead]]
            slot = (kick[lead] + step) % SLOTS  # evict, and carry on with the fingerprint that stood there
            out = self.table[at[lead], slot].copy()
            self.table[at[lead], slot] = p[lead]
            p[lead] = out
            at[lead] = self._other(at[lead], out)
            kick[lead] += 1
        return not len(p)

    def delete(self, key: int) -> bool:
        p, a, b = self._places(np.array([key], np.uint64))
        for bucket in (a[0], b[0]):
            found = np.flatnonzero(self.table[bucket] == p[0])
            if len(found):
                self.table[bucket, found[0]] = 0
                self.size -= 1
                return True
        return False


NO_ID = np.iinfo(np.int64).max


class CuckooIndex:
    """Live digests with a count and the best row (most code points, then smallest id, NO_ID for a null one) of each."""

    def __init__(self, buckets: int = 1024):
        self.filter = CuckooFilter(buckets)
        self.used = self.resizes = 0
        self.digest = np.zeros((1024, 4), np.uint64)
        self.points, self.ids, self.count, self.next = (np.zeros(1024, np.int64) for _ in range(4))
        self.live = np.zeros(1024, bool)
        self.head = np.full(len(self.filter.table), -1)

    def __len__(self):
        return int(self.live[: self.used].sum())

    def _bucket(self, digests: np.ndarray) -> np.ndarray:
        return (digests[:, 0] & np.uint64(len(self.head) - 1)).astype(np.int64)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The entry of every digest (rows of four 64-bit numbers), -1 for those that aren't live."""
        found = np.full(len(digests), -1)
        ask = np.flatnonzero(self.filter.contains(digests[:, 0]))  # what the filter doesn't know isn't looked for
        at = self.head[self._bucket(digests[ask])]
        while len(ask):
            ask, at = ask[at >= 0], at[at >= 0]
            same = (self.digest[at] == digests[ask]).all(axis=1)
            found[ask[same]] = at[same]
            ask, at = ask[~same], self.next[at[~same]]
        return found

    def add(self, digests: np.ndarray, points: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Insert rows, or count them with the live digest that they repeat."""
        if not len(digests):
            return
        order = np.lexsort((ids, -points, *digests.T))
        digests, points, ids, counts = digests[order], points[order], ids[order], counts[order]
        new = np.ones(len(order), bool)
        new[1:] = (digests[1:] != digests[:-1]).any(axis=1)
        lead = np.flatnonzero(new)
        digests, points, ids, counts = digests[lead], points[lead], ids[lead], np.add.reduceat(counts, lead)
        at = self.find(digests)
        hit = at >= 0
        old = at[hit]
        self.count[old] += counts[hit]
        win = better(points[hit], ids[hit], self.points[old], self.ids[old])
        self.points[old[win]], self.ids[old[win]] = points[hit][win], ids[hit][win]
        self._store(digests[~hit], points[~hit], ids[~hit], counts[~hit])

    def _store(self, digests, points, ids, counts) -> None:
        end = self.used + len(digests)
        while end > len(self.live):
            for name in ("digest", "points", "ids", "count", "next", "live"):
                held = getattr(self, name)
                setattr(self, name, np.concatenate([held, np.zeros_like(held)]))
        own = slice(self.used, end)
        self.digest[own], self.points[own], self.ids[own], self.count[own], self.live[own] = digests, points, ids, counts, True
        fresh = np.arange(self.used, end)
        self.used = end
        if self.filter.insert(digests[:, 0]):
            self._chain(fresh)
        else:
            self.resize()

    def _chain(self, entries: np.ndarray) -> None:
        """Put entries at the heads of their buckets' chains."""
        bucket = self._bucket(self.digest[entries])
        order = np.argsort(bucket, kind="stable")
        entries, bucket = entries[order], bucket[order]
        first = np.ones(len(entries), bool)
        first[1:] = bucket[1:] != bucket[:-1]
        self.next[entries] = np.where(first, self.head[bucket], np.concatenate([[-1], entries[:-1]]) if len(entries) else entries)
        last = np.append(first[1:], True) if len(entries) else first
        self.head[bucket[last]] = entries[last]

    def resize(self) -> None:
        """A larger filter, and its buckets' chains, from the stored keys."""
        kept = np.flatnonzero(self.live[: self.used])
        size = len(self.filter.table)
        while True:
            size *= 2
            self.resizes += 1
            self.filter = CuckooFilter(size)
            if self.filter.insert(self.digest[kept, 0]):
                break
        self.head = np.full(len(self.filter.table), -1)
        self._chain(kept)

    def delete(self, digest: np.ndarray) -> bool:
        """Withdraw a live digest; False if it isn't live."""
        at = int(self.find(digest[None])[0])
        if at < 0:
            return False
        bucket = int(self._bucket(digest[None])[0])
        before = int(self.head[bucket])
        if before == at:
            self.head[bucket] = self.next[at]
        else:
            while self.next[before] != at:
                before = int(self.next[before])
            self.next[before] = self.next[at]
        self.live[at] = False
        return self.filter.delete(int(digest[0]))


def better(points, doc, points2, doc2):
    """Whether the first row stays rather than the second; NO_ID comes last."""
    return (points > points2) | (points == points2) & (doc < doc2)


KEYS = "digest binary, points long, doc_id long, n long"


def _combine(batches):
    """Rows of KEYS through one index; a row with n = 0 withdraws its digest."""
    index, gone = CuckooIndex(), []
    for b in batches:
        digests = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64).reshape(-1, 4)
        points, ids, n = (b.column(i).fill_null(NO_ID).to_numpy() for i in (1, 2, 3))
        gone.append(digests[n == 0])
        index.add(digests, points, ids, n)
    gone = np.unique(np.concatenate(gone), axis=0) if gone else np.zeros((0, 4), np.uint64)
    for d in gone:
        index.delete(d)
    kept = np.flatnonzero(index.live[: index.used])
    for at in range(0, len(kept), 50_000):
        rows = kept[at : at + 50_000]
        yield _rows(index.digest[rows], index.points[rows], index.ids[rows], index.count[rows])
    for at in range(0, len(gone), 50_000):
        none = np.zeros(len(gone[at : at + 50_000]), np.int64)
        yield _rows(gone[at : at + 50_000], none, none + NO_ID, none)


def _rows(digests, points, ids, counts):
    raw = digests.tobytes()
    column = pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary())
    return pa.RecordBatch.from_arrays([column, pa.array(points), pa.array(ids, mask=ids == NO_ID), pa.array(counts)], ["digest", "points", "doc_id", "n"])


def keyed(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, digest and code points of every row; equal digests are equal texts without white space."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.translate(whole, " \t\n\x0b\x0c\r", ""), 256)).alias("digest"), F.char_length(whole).cast("long").alias("points"))


def live_digests(docs: DataFrame, withdrawn: DataFrame | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The index as a table: digest, points and doc_id of the row that stays, n rows; withdrawn texts are not live.

    An id of 2**63 - 1 counts as null here.
    """
    return _live(keyed(docs, text, id_col), withdrawn, text, common.partitions(docs.sparkSession, docs))


def _live(keys: DataFrame, withdrawn: DataFrame | None, text: str, parts: int) -> DataFrame:
    rows = keys.select("digest", "points", F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).cast("long").alias("n"))
    if withdrawn is not None:
        none = common.fresh(withdrawn.columns, "_none")
        rows = rows.unionByName(keyed(withdrawn.withColumn(none, F.lit(None).cast("long")), text, none).select("digest", "points", "doc_id", F.lit(0).cast("long").alias("n")))
    return rows.mapInArrow(_combine, KEYS).repartition(parts, "digest").mapInArrow(_combine, KEYS).where("n > 0")


def exact_dedup(docs: DataFrame, withdrawn: DataFrame | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters space and 0x09 to 0x0D; a null text is empty. Of equal
    texts the row with the most code points in the original stays, then the smallest id; null ids come last.
    Rows that repeat the id of the row that stays are all marked kept. Texts of ``withdrawn`` are deleted from
    the index: their documents get a null keep_id, group_size 0 and are not kept. An empty table gives no rows,
    and columns other than the id and the text are not looked at.
    """
    keys = common.saved(keyed(docs, text, id_col), "keys")  # 50 bytes a row, so each text is read and hashed once
    live = common.saved(_live(keys, withdrawn, text, common.partitions(docs.sparkSession, docs)), "digests").select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("points").alias("keep_points"))
    total = live.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    lone = common.attach(keys, live, ["digest"], "group_size", total, "left" if withdrawn is not None else "inner")
    return lone.select(
        "doc_id", "keep_id", F.coalesce("group_size", F.lit(0)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")) & F.col("group_size").isNotNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
