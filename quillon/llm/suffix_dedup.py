"""Removal of byte strings that occur more than once, by bucket-pointer refinement over a distributed corpus.

A window is a string of ``LENGTH`` bytes; it is repeated if it starts anywhere else too. Suffixes start in buckets of
equal q-grams, and a bucket is refined by the identifiers of the buckets that later offsets are in; every level reuses
the one before, and buckets of one member are dropped. This is done at two scales.

Over the corpus, buckets can't be numbered by sorting each level (that would shuffle every byte's suffix several
times), so a bucket's identifier is a 64-bit name: that of an 8-gram is the gram itself, mixed; that of twice the
length is mixed from the names at the place and at the later offset. Nor does every suffix stand for itself: a
window's suffix starts at its anchor, its GRAM-byte string with the least name, so equal windows have equal anchors at
equal places and one anchor serves some eighty windows in a row. Buckets of anchors with one member are done. The
others are refined by the names at the offsets around the anchor that their windows cover (the context): members in
one bucket of equal contexts are equal in all their windows.

Where a bucket holds several contexts, one member of each is brought to a task, and the suffixes of all their bytes
are refined by sorting: ranks of 8-grams become ranks of 16, 32, 64, 128 and LENGTH bytes, each level sorting pairs of
bucket pointers (at the place, at the offset), and only of suffixes that aren't alone yet. What is left together at
the last level are windows that contexts share. A bucket of more than BUCKET contexts is not brought to one task but
refined by Spark first: its windows are halved by how far left of the anchor they start, and the windows of a half
share more bytes, by which their bucket is split. Contexts that are equal in all windows of a half are one member
from there on; a bucket of one is done.

Documents are kept as units (about a megabyte, compressed) in files on shared storage; positions refer to units,
and tasks read the units they need, so texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

LENGTH, GRAM = 200, 40
UNIT_BYTES = 1 << 20
TILE = 1 << 25
BUCKET = 512


def _pack(ids: pa.Array, offsets: np.ndarray, data: np.ndarray) -> bytes:
    import zstandard

    sink = pa.BufferOutputStream()
    text = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    batch = pa.RecordBatch.from_arrays([ids, text], ["id", "text"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    raw = zstandard.ZstdCompressor(level=1).compress(sink.getvalue())
    return struct.pack("<Q", len(raw)) + raw


class Units:
    """Reads units of the files in a folder; keeps the last file open and the last unit unpacked."""

    def __init__(self, folder: str):
        self.folder, self.file, self.name, self.at = folder, None, None, None

    def get(self, name: int, at: int):
        """(ids, offsets, bytes) of a unit."""
        import zstandard

        if (self.name, self.at) != (name, at):
            if self.name != name:
                system, path = common.open_fs(f"{self.folder}/{name:016x}")
                self.file = system.open_input_file(path)
            size = struct.unpack("<Q", self.file.read_at(8, at))[0]
            raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(size, at + 8))
            batch = pa.ipc.open_stream(raw).read_next_batch()
            self.name, self.at, self.unit = name, at, (batch.column(0), *common.offsets_of(batch.column(1)))
        return self.unit


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from running minimums of blocks in both directions."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    y = np.full(blocks * width, np.uint64(2**64 - 1))
    y[: len(x)] = x
    y = y.reshape(blocks, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def names(data: np.ndarray, depth: int, seed: int = 0) -> list[np.ndarray]:
    """Names of the buckets of all strings of 8, 16, 32 ... bytes up to the largest power of two within ``depth``."""
    if len(data) < 8:
        return []
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    out, size = [words.mix(eight ^ words.U(_SEEDS[seed]))], 8
    while 2 * size <= depth:
        last = out[-1]
        out.append(words.mix(last[:-size] * words.U(_SEEDS[seed]) + last[size:]) if len(last) > size else last[:0])
        size *= 2
    return out


_SEEDS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)


def name_of(level: np.ndarray, size: int, start: np.ndarray, end: np.ndarray, most: int, seed: int = 0) -> np.ndarray:
    """Names of the strings start..end (``size`` to ``most`` bytes) from those of ``size`` bytes at offsets that cover them."""
    pieces = 1 + -(-(most - size) // size)
    h = words.mix((end - start).astype(np.uint64) + words.U(_SEEDS[1 - seed]))
    for k in range(pieces):
        h = words.mix(h * words.U(_SEEDS[seed]) + level[start + (end - start - size) * k // max(pieces - 1, 1)])
    return np.where(h == 0, words.U(1), h)


def power(n: int) -> int:
    """The largest power of two within n."""
    return 1 << n.bit_length() - 1


def anchors(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(bucket, context, anchor, first window, last window) of every run of windows with one anchor; 8 <= gram <= length."""
    out = []
    width = length - gram + 1
    valid = np.zeros(len(data) + 1, np.int32)
    long = np.diff(offsets) >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    for base in range(0, max(len(data) - length + 1, 0), TILE):
        stop = min(base + TILE, len(data) - length + 1)
        # A tile's windows, whole runs and their contexts: a run is as long as its windows reach.
        tile = data[base : stop + 2 * length]
        levels = names(tile, length)
        small, large = power(gram), power(length)
        g = np.arange(stop - base + width - 1)
        grams = name_of(levels[small.bit_length() - 4], small, g, g + gram, gram)
        key = (grams >> words.U(26) << words.U(26)) | g.astype(np.uint64)
        at = (sliding_min(key, width) & words.U(2**26 - 1)).astype(np.int64)
        p = np.flatnonzero(valid[base:stop])
        if not len(p):
            continue
        own = at[p]
        new = np.ones(len(p), bool)
        new[1:] = (own[1:] != own[:-1]) | (p[1:] != p[:-1] + 1)
        lo = p[new]
        hi = p[np.append(np.flatnonzero(new)[1:], len(p)) - 1]
        pos = own[new]
        context = name_of(levels[large.bit_length() - 4], large, lo, hi + length, length + width - 1)
        # The place of the anchor in its context is part of it: equal windows stand at equal distances from it.
        out.append((grams[pos], words.mix(context + (pos - lo).astype(np.uint64)), pos + base, lo + base, hi + base))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)


ANCHOR = ["h", "c", "file", "at", "lo", "hi", "x"]


def _units(folder: str, length: int, gram: int):
    def run(batches):
        name, at = uuid.uuid4().int >> 65, 0
        system, path = common.open_fs(folder)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name:016x}", buffer_size=1 << 20) as out:
            for b in common.slices(batches, "text", UNIT_BYTES):
                offsets, data = common.offsets_of(b.column(1))
                packed = _pack(b.column(0), offsets, np.ascontiguousarray(data))
                out.write(packed)
                h, c, pos, lo, hi = anchors(offsets, data, length, gram)
                n = len(h) + 1  # the last row stands for the unit itself
                null = np.zeros(n, bool)
                null[-1] = True
                signed = [np.append(x, 0).astype(np.uint64).view(np.int64) for x in (h, c)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed[0], mask=null), pa.array(signed[1], mask=null), pa.array(np.full(n, name)), pa.array(np.full(n, at)), pa.array(np.append(lo, 0).astype(np.int32)), pa.array(np.append(hi, -1).astype(np.int32)), pa.array(np.append(pos - lo, 0).astype(np.int16))], ANCHOR
                )
                at += len(packed)

    return run


def _contexts(folder: str, length: int):
    """The bytes that the windows lo..hi of a unit cover, for rows in order of units."""

    def run(batches):
        units = Units(folder)
        for b in batches:
            file, at, lo, hi = (x.to_pylist() for x in b.columns[3:])
            text = []
            for f, a, l, r in zip(file, at, lo, hi):
                text.append(units.get(f, a)[2][l : r + length].tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(text, pa.binary())], ["h", "c", "x", "text"])

    return run


def refined(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket pointers of every place's next ``length`` bytes: equal numbers for equal strings, -1 where no other is equal.

    The first buckets are those of 8-grams (single bytes below that length); a level sorts the pairs of pointers at the
    place and at the later offset, of places whose buckets have several members at both.
    """
    data = np.ascontiguousarray(data)
    if length >= 8:
        depth, place = 8, np.arange(max(len(data) - 7, 0))
        key = np.ndarray((len(place),), "<u8", data, strides=(1,)).copy() if len(place) else np.zeros(0, np.uint64)
    else:
        depth, place, key = 1, np.arange(len(data)), data.astype(np.uint64)
    bucket = _buckets(place, key, len(place))
    while depth < length:
        step = min(depth, length - depth)  # the last level overlaps the one before
        size = max(len(bucket) - step, 0)
        place = np.flatnonzero((bucket[:size] >= 0) & (bucket[step:] >= 0)) if size else np.zeros(0, np.int64)
        bucket = _buckets(place, bucket[place] << 32 | bucket[place + step], size)
        depth += step
    return bucket


def _buckets(place: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the buckets of equal keys at their places; buckets of one member are dropped (-1)."""
    out = np.full(size, -1)
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    number = np.cumsum(new) - 1
    several = np.bincount(number, minlength=1)[number] > 1 if len(key) else new
    out[place[order[several]]] = number[several]
    return out


def _windows(texts: pa.Array, length: int):
    """(context, offset in it, place in all contexts' bytes) of all windows of the contexts, and these bytes."""
    offsets, data = common.offsets_of(texts)
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    of = np.repeat(np.arange(len(count)), count)
    d = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return of, d, offsets[:-1][of] + d, data


def _spans(of: np.ndarray, d: np.ndarray):
    """Runs of consecutive windows: (context, first, last)."""
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (d[1:] != d[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(of)) - 1
    return (of[first], d[first], d[last]) if len(of) else (of, d, d)


def _compare(length: int):
    """Rows (g, h, c, d, text) in order of the bucket g -> (h, c, first, last): windows that another text of the bucket has
    too; d is where the text starts in the context (h, c)."""

    def emit(rows):
        texts = pa.array([r[4] for r in rows], pa.binary())
        of, d, place, data = _windows(texts, length)
        if not len(of):
            return None
        bucket = refined(data, length)[place]
        some = np.flatnonzero(bucket >= 0)  # a place's bytes may go on into the next context, a window's don't
        hit = _buckets(some, bucket[some], len(of)) >= 0
        of, first, last = _spans(of[hit], d[hit])
        start = np.array([r[3] for r in rows])[of]
        return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in of], pa.int64()), pa.array([rows[i][2] for i in of], pa.int64()), pa.array((first + start).astype(np.int32)), pa.array((last + start).astype(np.int32))], ["h", "c", "first", "last"])

    def run(batches):
        flat = (r for b in batches for r in zip(*(x.to_pylist() for x in b.columns)))
        held, size = [], 0
        for _, own in groupby(flat, key=lambda r: r[0]):  # whole buckets, several at a time
            own = list(own)
            held += own
            size += sum(len(r[4]) for r in own)
            if size > UNIT_BYTES:
                if (out := emit(held)) is not None:
                    yield out
                held, size = [], 0
        if held and (out := emit(held)) is not None:
            yield out

    return run


def _finish(folder: str, length: int):
    """Rows (file, at, lo, hi) in order of units -> one row per document."""

    def run(batches):
        units = Units(folder)

        def rows():
            for b in batches:
                file, at, lo, hi = (x.to_numpy() for x in b.columns)
                cut = np.flatnonzero((file[1:] != file[:-1]) | (at[1:] != at[:-1])) + 1
                for s, e in zip(np.append(0, cut), np.append(cut, len(file))):
                    if e > s:
                        yield (int(file[s]), int(at[s])), lo[s:e], hi[s:e]

        for key, parts in groupby(rows(), key=lambda r: r[0]):
            ids, offsets, data = units.get(*key)
            edge = np.zeros(len(data) + 1, np.int32)
            for _, lo, hi in parts:
                some = hi >= lo
                np.add.at(edge, lo[some], 1)
                np.add.at(edge, hi[some] + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            start = gone.copy()
            start[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[:-1] < len(data)]
            start[inner] = gone[inner]
            upto, runs = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(start)])
            kept = data[~gone].tobytes()
            left = offsets - upto[offsets]
            digests = [hashlib.sha256(kept[s:e]).hexdigest() for s, e in zip(left[:-1].tolist(), left[1:].tolist())]
            count = lambda x: pa.array(x[offsets[1:]] - x[offsets[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), count(upto), count(runs), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_windows(docs: DataFrame, folder: str, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """Rows (file, at, lo, hi): repeated windows lo..hi of a unit, and a row with hi < lo for every unit.

    ``docs`` has the columns doc_id and text (no nulls in text); their units are written to ``folder``.
    """
    spark = docs.sparkSession
    parts = common.partitions(spark, docs)
    every = common.saved(docs.mapInArrow(_units(folder, length, gram), "h long, c long, file long, at long, lo int, hi int, x short"), "anchors")
    found = every.where("h IS NOT NULL")
    grams = common.saved(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = common.saved(common.attach(found, grams, ["h"], "n", total).drop("n"), "shared")
    classes = common.saved(shared.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("file", "at", "lo", "hi", "x")).alias("one")), "classes")
    mixed = common.saved(classes.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "mixed")
    several = mixed.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    apart = common.attach(classes, mixed, ["h"], "k", several).select("h", "c", "k", "one.*")

    rows = apart.select("k", "h", "c", "x", "file", "at", "lo", "hi").repartition(parts, "file", "at").sortWithinPartitions("file", "at")
    context = lambda where: rows.where(where).drop("k").mapInArrow(_contexts(folder, length), "h long, c long, x short, text binary")
    near = context(f"k <= {bucket}").select(F.col("h").alias("g"), "h", "c", F.lit(0).alias("d"), "text")
    spans = []
    if not mixed.where(f"k > {bucket}").isEmpty():
        spans, more = _split(context(f"k > {bucket}"), length, length - gram, bucket)
        near = near.unionByName(more)
    compared = near.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_compare(length), "h long, c long, first int, last int")
    spans = reduce(DataFrame.unionByName, [compared, *spans])
    lone = classes.where("n = 1").select("h", "c")
    spans = common.saved(spans.join(lone, ["h", "c"]).groupBy("h", "c").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")  # one context's spans: its windows, some 160, at most
    whole = classes.where("n > 1").select("h", "c", "n", F.lit(None).cast("array<struct<first: int, last: int>>").alias("spans"))
    marks = common.saved(whole.unionByName(spans.select("h", "c", F.lit(1).cast("long").alias("n"), "spans")), "marks")
    own = F.coalesce("spans", F.array(F.struct(F.lit(0).alias("first"), (F.col("hi") - F.col("lo")).alias("last"))))
    hits = common.attach(shared, marks, ["h", "c"], "n", total).select("file", "at", "lo", F.explode(own).alias("s"))
    return hits.select("file", "at", (F.col("lo") + F.col("s.first")).alias("lo"), (F.col("lo") + F.col("s.last")).cast("int").alias("hi")).unionByName(every.where("h IS NULL").select("file", "at", "lo", "hi"))


def _split(contexts: DataFrame, length: int, most: int, bucket: int) -> tuple[list[DataFrame], DataFrame]:
    """Refines buckets h of contexts (h, c, x, text), x the anchor's place in the text, until they have ``bucket`` members
    at most: (spans (h, c, first, last) found on the way, rows (g, h, c, d, text) for _compare()).

    A window that starts l bytes left of its anchor has l in p..q, at first 0..most. The windows of a half p..m share
    the bytes from p left of the anchor to length - m right of it, so equal windows of two contexts are in one bucket
    of equal such bytes. When p = q these bytes are the window, and the bucket has one member.
    """
    spans, small = [], []
    pending = contexts.select(F.col("h").alias("g"), "h", "c", F.lit(0).alias("d"), F.col("x").cast("int").alias("x"), "text", F.lit(0).alias("p"), F.lit(most).alias("q"))
    while True:
        pending = common.saved(pending, "split")
        middle = F.expr("(p + q) div 2").cast("int")
        halves = [_half(pending.withColumn("q", middle), length), _half(pending.withColumn("p", middle + 1), length)]
        halves = common.saved(halves[0].unionByName(halves[1]).withColumn("name", F.md5("text")), "halves")
        classes = halves.groupBy("g", "x", "name").agg(F.count("*").alias("n"), F.min(F.struct("h", "c", "d", "text", "p", "q")).alias("one"))
        classes = common.saved(classes, "halved")
        alike = classes.where("n > 1").select("g", "x", "name", "n")
        total = halves.count()
        spans.append(common.saved(common.attach(halves, alike, ["g", "x", "name"], "n", total).select("h", "c", F.col("d").alias("first"), (F.col("d") + F.length("text") - length).cast("int").alias("last")), "alike"))
        sizes = common.saved(classes.groupBy("g").agg(F.count("*").alias("k")).where("k > 1"), "halves-sizes")
        rest = common.saved(common.attach(classes.select("g", "x", "one"), sizes, ["g"], "k", total).select("k", "g", "one.h", "one.c", "one.d", "x", "one.text", "one.p", "one.q"), "rest")
        small.append(rest.where(f"k <= {bucket}").select("g", "h", "c", "d", "text"))
        pending = rest.where(f"k > {bucket}").drop("k")
        if pending.isEmpty():
            return spans, reduce(DataFrame.unionByName, small)


def _half(rows: DataFrame, length: int) -> DataFrame:
    """The rows' windows with p..q bytes left of the anchor, in buckets of the bytes that all of these share."""
    left, right = F.least("q", "x"), F.greatest(F.col("p"), F.col("x") - F.length("text") + length)
    part = lambda start, size: F.substring(F.col("text"), start + 1, size)
    some = rows.where((F.col("p") <= F.col("q")) & (left >= right))
    return some.select(
        F.xxhash64("g", "p", "q", part(F.col("x") - F.col("p"), F.col("p") - F.col("q") + length)).alias("g"), "h", "c", (F.col("d") + F.col("x") - left).cast("int").alias("d"),
        left.cast("int").alias("x"), part(F.col("x") - left, left - right + length).alias("text"), "p", "q",
    )


def suffix_dedup(docs: DataFrame, length: int = LENGTH, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document; ``length`` is 16 at least.

    Every byte covered by a ``length``-byte string that starts anywhere else as well, in the same document or
    another, is removed; all occurrences go. Null texts are empty; texts under ``length`` bytes stay whole;
    matches don't cross documents. Repeated rows are documents of their own, so they remove each other. An
    empty table gives no rows; other columns are not read.
    """
    folder, hits = _hits(docs, length, text, id_col)
    return hits.mapInArrow(_finish(folder, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _hits(docs: DataFrame, length: int, text: str, id_col: str):
    spark = docs.sparkSession
    folder = common.scratch(spark, "units")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if length < 16:
        raise ValueError("repeated strings are looked for from 16 bytes on")
    found = repeated_windows(rows, folder, length, max(8, min(GRAM, length // 2)))
    return folder, found.repartition(common.partitions(spark, docs), "file", "at").sortWithinPartitions("file", "at")


def _kept(folder: str, length: int):
    def run(batches):
        units = Units(folder)
        flat = (r for b in batches for r in zip(*(x.to_pylist() for x in b.columns)))
        for key, own in groupby(flat, key=lambda r: r[:2]):
            ids, offsets, data = units.get(*key)
            edge = np.zeros(len(data) + 1, np.int32)
            for _, _, lo, hi in own:
                if hi >= lo:
                    edge[lo] += 1
                    edge[hi + length] -= 1
            stay = np.cumsum(edge[:-1]) <= 0
            parts = [data[s:e][stay[s:e]].tobytes().decode("utf-8", "replace") for s, e in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([ids, pa.array(parts)], ["doc_id", "text"])

    return run


def kept_texts(docs: DataFrame, length: int = LENGTH, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and what is left of each text; a character that a cut goes through becomes U+FFFD."""
    folder, hits = _hits(docs, length, text, id_col)
    return hits.mapInArrow(_kept(folder, length), "doc_id long, text string")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(common.table(spark, sf_dir, "documents"))
