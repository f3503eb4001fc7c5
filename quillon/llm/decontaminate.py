"""Benchmark decontamination with suffix arrays over shards of the training words.

A task takes its documents in shards of a few megabytes. It sorts all word suffixes of a shard into a suffix array by
prefix doubling: ranks by one word give ranks by two, four, eight and ``width`` words, each from the ranks at the
place and at a later one. Every test suffix is then found by binary search, word by word: the range of the suffixes
that start with its first word is narrowed to those that go on with the second, and so on. A suffix that occurs gives
all its locations; hits that follow each other along a diagonal of (item, document) are one longest verbatim match.
Words are compared by a 64-bit hash, and at the locations that are found by a second, independent one.

A document lies in one shard, so nothing is shuffled. The test words are a table on shared storage that tasks read
block by block, so its size is not bounded by memory, and nothing that grows is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

#: Items in one file of the test table, which is what a task holds at a time.
BLOCK_ITEMS = 20_000
ITEMS = "item_id string, words array<long>, checks array<long>"


def _item_words(batches):
    for b in common.slices(batches, "text"):
        low, s, e, first = words.spans(*common.offsets_of(b.column(1)))
        lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(words.digests(low, s, e, seed).view(np.int64))) for seed in (0, 1)]
        yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["item_id", "words", "checks"])


def test_words(benchmark: DataFrame, text: str = "text", id_col: str = "item_id") -> list[str]:
    """Files of the items' word hashes on shared storage, BLOCK_ITEMS items each at most."""
    path = common.scratch(benchmark.sparkSession, "items")
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows.mapInArrow(_item_words, ITEMS).where(F.size("words") > 0).write.option("maxRecordsPerFile", BLOCK_ITEMS).parquet(path)
    files = benchmark.sparkSession.read.schema(ITEMS).parquet(path).inputFiles()
    return sorted(files)


class Block:
    """The windows of some items: ``width`` words, or all of a shorter item; equal ones are searched for once."""

    def __init__(self, ids: list[str], lists: list[np.ndarray], checks: list[np.ndarray], width: int):
        self.ids, self.width = ids, width
        sizes = np.array([len(w) for w in lists], np.int64)
        length = np.minimum(sizes, width)
        count = sizes - length + 1
        self.item = np.repeat(np.arange(len(ids)), count)
        self.pos = np.arange(len(self.item)) - np.repeat(np.cumsum(count) - count, count)
        self.length = length[self.item]
        start = np.repeat(np.cumsum(sizes) - sizes, count) + self.pos
        place = start[:, None] + np.arange(width)
        inside = np.arange(width) < self.length[:, None]
        flat = lambda x: np.where(inside, np.concatenate([*x, np.zeros(width, np.uint64)])[np.where(inside, place, 0)], words.U(0))
        rows, self.checks = flat(lists), flat(checks)
        _, lead, of = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        of = of.ravel()
        self.keys, self.key_length = rows[lead], self.length[lead]
        self.windows = np.argsort(of, kind="stable")  # by key
        self.bounds = np.searchsorted(of[self.windows], np.arange(len(lead) + 1))


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense rank from 1 of every value)"""
    order = np.argsort(key)
    new = np.ones(len(key), np.int64)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def suffix_array(h: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """All word positions in order of their next ``width`` words; end: of each word's document, a shorter suffix is less."""
    order, rank = _ranks(h)
    depth = 1
    while depth < width:
        step = min(depth, width - depth)  # the last step overlaps the one before
        later = np.zeros(len(h), np.int64)
        later[:-step] = np.where(np.arange(step, len(h)) < end[:-step], rank[step:], 0)
        order, rank = _ranks(rank << 32 | later)
        depth += step
    return order


def _bound(value, low: np.ndarray, high: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """The first place of low..high whose value is not less than (right: greater than) what is wanted."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) >> 1
        v = value(mid)
        below = v <= want[open_] if right else v < want[open_]
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]
    return low


def locate(h: np.ndarray, end: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(search key, word position) of every occurrence of a test window in the shard."""
    at = suffix_array(h, end, block.width)
    key = np.arange(len(block.keys))
    low, high = np.zeros(len(key), np.int64), np.full(len(key), len(at))
    for d in range(block.width):
        go = np.flatnonzero((low < high) & (block.key_length > d))
        if not len(go):
            break
        want = block.keys[go, d]

        def value(i, d=d):
            place = at[i] + d
            return np.where(place < end[at[i]], h[np.minimum(place, len(h) - 1)], words.U(0))

        first = _bound(value, low[go], high[go], want, False)
        high[go] = _bound(value, first, high[go], want, True)
        low[go] = first
    n = np.maximum(high - low, 0)
    which = np.repeat(key, n)
    return which, at[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]]


_BLOCKS: dict[tuple[str, int], Block] = {}


def _block(uri: str, width: int) -> Block:
    """The block of a file; the last one read is kept for the worker's next shard."""
    if (uri, width) not in _BLOCKS:
        import pyarrow.parquet as pq

        system, path = common.open_fs(uri)
        with system.open_input_file(path) as f:
            t = pq.read_table(f).combine_chunks()
        lists, checks = ([np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64) for x in t.column(c)] for c in ("words", "checks"))
        _BLOCKS.clear()
        _BLOCKS[uri, width] = Block(t.column("item_id").to_pylist(), lists, checks, width)
    return _BLOCKS[uri, width]


def _hits(low, s, e, h, end, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(window, word position) of all occurrences, checked by the second hash of their words."""
    which, at = locate(h, end, block)
    per = np.diff(block.bounds)[which]
    hit = np.repeat(np.arange(len(at)), per)
    window = block.windows[np.arange(len(hit)) - np.repeat(np.cumsum(per) - per, per) + block.bounds[which][hit]]
    at = at[hit]
    if not len(at):
        return window, at
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + block.length[window], -1)
    some = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    check = np.zeros(len(h) + block.width, np.uint64)
    check[some] = words.digests(low, s[some], e[some], 1)
    same = np.ones(len(at), bool)
    for k in range(block.width):
        same &= (block.length[window] <= k) | (check[at + k] == block.checks[window, k])
    return window[same], at[same]


def _search(files: list[str], width: int, spans: bool):
    def run(batches):
        for b in common.slices(batches, "text"):
            low, s, e, first = words.spans(*common.offsets_of(b.column(1)))
            h = words.digests(low, s, e)
            n, end = np.diff(first), np.repeat(first[1:], np.diff(first))
            doc = np.repeat(np.arange(len(n)), n)
            edge = np.zeros(len(h) + 1, np.int64)
            most = np.zeros(len(n), np.int64)
            items: list[set] = [set() for _ in n]
            found: list[list] = [[] for _ in n]
            for uri in files if len(h) else ():
                block = _block(uri, width)
                window, at = _hits(low, s, e, h, end, block)
                if not len(at):
                    continue
                length = block.length[window]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                pairs = np.unique(doc[at] * np.int64(len(block.ids)) + block.item[window])
                for d, i in zip((pairs // len(block.ids)).tolist(), (pairs % len(block.ids)).tolist()):
                    items[d].add(block.ids[i])
                match = longest(doc[at], block.item[window], block.pos[window], at, length)
                np.maximum.at(most, match[0], match[4])
                if spans:
                    for d, i, pos, place, size in zip(*(x.tolist() for x in match)):
                        found[d].append((block.ids[i], pos, place - int(first[d]), size))
            covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
            hits = covered[first[1:]] - covered[first[:-1]]
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(most)]
            names = ["doc_id", "n_words", "n_hit", "items", "longest"]
            if spans:
                cols.append(pa.array([[dict(zip(SPAN, x)) for x in f] for f in found], pa.list_(pa.struct([(SPAN[0], pa.string())] + [(k, pa.int64()) for k in SPAN[1:]]))))
                names.append("matches")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


SPAN = ["item_id", "item_pos", "doc_pos", "n_words"]


def longest(doc, item, pos, at, length):
    """Longest matches (doc, item, pos, at, words) of window hits: those that follow each other along a diagonal are one."""
    order = np.lexsort((at, at - pos, item, doc))
    doc, item, pos, at, length = (x[order] for x in (doc, item, pos, at, length))
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - pos[1:] != at[:-1] - pos[:-1]) | (at[1:] != at[:-1] + 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(at)) - 1
    return doc[starts], item[starts], pos[starts], at[starts], at[ends] - at[starts] + length[ends]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, spans: bool = False, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as sorted strings) and longest (words of the longest verbatim match) per document.

    With ``spans`` the longest matches as well: matches, of (item_id, item_pos, doc_pos, n_words), positions in words.

    A window is ``width`` consecutive words of an item, or all of a shorter item; a document's word inside any
    occurrence is hit. Null texts and texts without words have none, items without words match nothing, a null
    item id reads as the empty string, rows that repeat an item id count as one item. An empty benchmark hits
    nothing. Matches never cross documents. Other columns are not read.
    """
    files = test_words(benchmark, item_text, item_id)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, items array<string>, longest long"
    if spans:
        schema += ", matches array<struct<item_id: string, item_pos: long, doc_pos: long, n_words: long>>"
    return rows.mapInArrow(_search(files, width, spans), schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no window of the benchmark. Nulls as in contamination()."""
    files = test_words(benchmark)
    search = _search(files, width, False)

    def run(batches):
        for b in batches:
            whole = b.column(b.schema.get_field_index(text))
            two = pa.RecordBatch.from_arrays([pa.array(np.arange(len(b))), whole.fill_null("")], ["doc_id", "text"])
            clean = [r["doc_id"] for part in search(iter([two])) for r in part.select(["doc_id", "n_hit"]).to_pylist() if not r["n_hit"]]
            yield b.take(pa.array(clean, pa.int64()))

    return docs.mapInArrow(run, docs.schema)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest",
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
ins AS (SELECT item_id, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, p AS q, w[p:p + n - 1] AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM ins)),
dw AS (SELECT doc_id, n, p, w[p:p + n - 1] AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM ins) WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id, iw.q FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
islands AS (SELECT doc_id, n, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS island, item_id, p - q AS diagonal FROM hits),
runs AS (SELECT doc_id, max(size) AS longest FROM (SELECT doc_id, count(*) + n - 1 AS size FROM islands GROUP BY doc_id, item_id, diagonal, island, n) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id) LEFT JOIN runs USING (doc_id)
"""
