"""Token ids of documents in sorted-string-table shards on shared storage, and lookups in them.

Shard layout (integers little-endian)::

    block*          zstd frame of entries: varint shared, varint unshared, varint value bytes, key suffix, value
    block index     zstd frame: per block its last key, offset and length (varint key length, key, u64, u32)
    Bloom filter    bits, one for each of HASHES hashes of a key
    footer          u64 index offset, u32 index length, u64 Bloom offset, u32 Bloom length, u64 entries, u64 tokens, magic

A key is one byte (0: null id, 1: id), the id as a big-endian unsigned 64-bit number with its sign bit turned, so
that keys sort as ids do, and a 32-bit number that tells repeated ids apart. A value is one byte (bytes per token
id, 2 or 4) and the ids. Keys in a block leave out the prefix they share with the key before.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_left, bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

MAGIC = b"QSSTABL1"
FOOTER = struct.Struct("<QIQIQQ8s")
BLOCK_BYTES = 64 << 10
BITS_PER_KEY, HASHES = 10, 7
CACHE_PIECES = 1_500_000
#: Pieces that are encoded as the lines of one text.
LINES = 256

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
_PLAIN = ~_SPACE
_PLAIN[128:] = False
_PLAIN[:33] = False


def pieces(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Starts of pieces that the byte-level pattern tokenizes alike alone and in their text.

    Its tokens never go across the start of a text; a blank that a non-blank follows, or that ends a run of
    non-blanks; an ASCII letter's end before a mark other than an apostrophe; a newline between non-blanks. The
    pattern looks ahead for blanks only, and never back.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        before, here, after = data[:-1], data[1:], np.append(data[2:], np.uint8(0))
        last = offsets[1:-1] - 2  # a text's last byte has none after it
        after[last[last >= 0]] = 0
        cut[1:-1] = (here == 32) & (_PLAIN[after] | _PLAIN[before]) | _LETTER[before] & _MARK[here]
        line = np.flatnonzero((here == 10) & _PLAIN[before]) + 1
        cut[line] = True
        line = line[line + 1 < len(data)]
        cut[line[_PLAIN[data[line + 1]]] + 1] = True
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    cut[len(data)] = False
    return np.flatnonzero(cut)


def alone_in_line(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a piece has the same tokens as a line of a text, the newlines around it being tokens of their own.

    It holds no newline, ends with a non-blank, and starts with one or with a single blank before one. Characters
    beyond ASCII count as non-blanks unless they begin like one of the blanks there (U+0085, U+00A0, U+1680, U+180E,
    U+2000 to U+206F, U+3000 and their neighbours).
    """
    padded = np.zeros(len(data) + 6, np.uint8)
    padded[3:-3] = data
    blank = np.zeros(len(data) + 6, bool)  # a character that may be a blank begins here
    lead, then = padded[:-1], padded[1:]
    blank[:-1] = _SPACE[lead] | (lead == 0xC2) & (then < 0xA1) | (lead == 0xE1) & ((then == 0x9A) | (then == 0xA0)) | (lead == 0xE2) & (then < 0x82) | (lead == 0xE3) & (then == 0x80)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    first = start + 3 + ((data[start] == 32) & (end - start > 1))
    last = end + 2
    ends = _SPACE[padded[last]] | (padded[last] > 127) & (blank[last - 1] & (padded[last - 1] == 0xC2) | blank[last - 2] & (padded[last - 2] > 0xE0))
    return ~blank[first] & ~ends & (lines[end] == lines[start])


class Cache:
    """Token ids by a piece's two 64-bit hashes, in a few arrays sorted by the first one over one pool of ids."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def find(self, keys: np.ndarray, others: np.ndarray):
        """(start in the pool, number of ids, whether the piece is known); both hashes must be those of the piece."""
        start, n, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for first, second, s, c in self.levels:
            at = np.minimum(np.searchsorted(first, keys), len(first) - 1)
            hit = (first[at] == keys) & (second[at] == others)
            start[hit], n[hit] = s[at[hit]], c[at[hit]]
            known |= hit
        return start, n, known

    def add(self, keys: np.ndarray, others: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """keys in ascending order; of two pieces with an equal first hash the one that comes first is held"""
        level = keys, others, self.hold(ids, count), count
        while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            both = [np.concatenate(x) for x in zip(self.levels.pop(), level)]
            order = np.argsort(both[0], kind="stable")
            level = tuple(x[order] for x in both)
        self.levels.append(level)

    def hold(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Starts in the pool of pieces with so many ids, which are put there."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        start = np.cumsum(count) - count + self.used
        self.used += len(ids)
        return start


class Encoder:
    """``tokenizers`` over whole texts; for byte-level pre-tokenizers equal pieces are encoded once.

    Texts that hold the string of an added token, and those of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cut = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 and not spec.get("truncation") and not spec.get("padding") and not any(b"\n" in a for a in self.added) else None
        self.cache = Cache()

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]

    def _pieces(self, data: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces of ``data``, number of ids of each); most are encoded many at once, as lines of a text."""
        count = np.zeros(len(start), np.int64)
        lines = alone_in_line(data, start, end) if self.line is not None else np.zeros(len(start), bool)
        found, where = [], []
        own = np.flatnonzero(lines)
        for at in range(0, len(own), LINES * 256):
            some = own[at : at + LINES * 256]
            size = end[some] - start[some] + 1  # with the newline
            upto = np.concatenate([[0], np.cumsum(size)])
            text = data[np.minimum(np.arange(upto[-1]) - np.repeat(upto[:-1] - start[some], size), len(data) - 1)]
            text[upto[1:] - 1] = 10
            text, cuts = text.tobytes(), [*upto[:-1:LINES].tolist(), int(upto[-1])]
            ids = np.fromiter(chain.from_iterable(self._raw([text[s:e].decode("utf-8", "replace") for s, e in zip(cuts[:-1], cuts[1:])])), np.uint32)
            stop = np.flatnonzero(ids == self.line)
            if len(stop) != len(some):
                raise AssertionError("a newline isn't a token of its own")
            count[some] = np.diff(stop, prepend=-1) - 1
            found.append(np.delete(ids, stop))
            where.append(some)
        own = np.flatnonzero(~lines)
        if len(own):
            ids = self._raw([raw[s:e].decode("utf-8", "replace") for s, e in zip(start[own].tolist(), end[own].tolist())])
            count[own] = np.fromiter(map(len, ids), np.int64, len(ids))
            found.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(count[own].sum())))
            where.append(own)
        if not found:
            return np.zeros(0, np.uint32), count
        order, first = np.concatenate(where), np.cumsum(count) - count
        size = count[order]
        ids = np.empty(int(count.sum()), np.uint32)
        ids[np.arange(len(ids)) - np.repeat(np.cumsum(size) - size - first[order], size)] = np.concatenate(found)
        return ids, count

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, index of each text's first id with the total at the end) of texts given as UTF-8."""
        raw = data.tobytes()
        if not self.cut or any(a in raw for a in self.added):
            ids = self._raw([raw[s:e].decode("utf-8", "replace") for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
            return np.array([t for x in ids for t in x], np.uint32), np.cumsum([0] + [len(x) for x in ids])
        start = pieces(offsets, data)
        end = np.append(start[1:], len(data))[: len(start)]
        first, second = words.digests(data, start, end, 1), words.digests(data, start, end, 2)
        keys, lead, of = np.unique(first, return_index=True, return_inverse=True)
        if sum(len(x[0]) for x in self.cache.levels) > CACHE_PIECES:
            self.cache = Cache()
        at, n, known = self.cache.find(keys, second[lead])
        new = np.flatnonzero(~known)
        if len(new):
            self.cache.add(keys[new], second[lead[new]], *self._pieces(data, raw, start[lead[new]], end[lead[new]]))
            at, n, known = self.cache.find(keys, second[lead])
        at, n = at[of], n[of]
        odd = np.flatnonzero(~known[of] | (second != second[lead][of]))  # the first hash is another piece's too
        if len(odd):
            own, n[odd] = self._pieces(data, raw, start[odd], end[odd])
            at[odd] = self.cache.hold(own, n[odd])
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.cache.pool[np.arange(upto[-1]) - np.repeat(upto[:-1] - at, n)]
        return ids, upto[np.searchsorted(start, offsets)]


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def unvarint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_of(doc_id: int | None, repeat: int) -> bytes:
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">I", repeat)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


_SECOND = 0x9E3779B9


def _bloom_bits(key: bytes, size: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, _SECOND) | 1
    return [(a + i * b) % size for i in range(HASHES)]


class Writer:
    """Entries in ascending key order, as the byte strings of one shard."""

    def __init__(self):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.block, self.held, self.last = [], 0, b""
        self.index, self.at, self.tokens, self.entries, self.prints = [], 0, 0, 0, array("Q")

    def add(self, key: bytes, ids: bytes) -> bytes:
        """Add ids (32-bit each); returns a finished block or nothing."""
        self.tokens += len(ids) // 4
        wide = np.frombuffer(ids, "<u4")
        value = b"\2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 65536 else b"\4" + ids
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block.append(varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value)
        self.held += len(value) + len(key)
        if self.entries == 0 or key[:9] != self.last[:9]:
            self.prints.append(zlib.crc32(key[:9]) << 32 | zlib.crc32(key[:9], _SECOND))
        self.entries += 1
        self.last = key
        return self.flush() if self.held >= BLOCK_BYTES else b""

    def flush(self) -> bytes:
        if not self.block:
            return b""
        frame = self.pack(b"".join(self.block))
        self.index.append(varint(len(self.last)) + self.last + struct.pack("<QI", self.at, len(frame)))
        self.at += len(frame)
        self.block, self.held = [], 0
        return frame

    def finish(self) -> bytes:
        tail = self.flush()
        index = self.pack(b"".join(self.index))
        prints = np.frombuffer(self.prints, np.uint64) if self.prints else np.zeros(0, np.uint64)
        bits = max(64, BITS_PER_KEY * len(prints)) + 7 & ~7
        bloom = np.zeros(bits, bool)
        a, b = prints >> np.uint64(32), prints & np.uint64(0xFFFFFFFF) | np.uint64(1)
        for i in range(HASHES):
            bloom[(a + np.uint64(i) * b) % np.uint64(bits)] = True
        packed = np.packbits(bloom).tobytes()
        return tail + index + packed + FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.entries, self.tokens, MAGIC)


class Table:
    """Lookups and scans in one shard; reads its footer, index and Bloom filter, then only the blocks asked for."""

    def __init__(self, uri: str):
        import zstandard

        system, path = common.open_fs(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        index_at, index_len, bloom_at, bloom_len, self.entries, self.tokens, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token table: {uri}")
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.bloom = np.unpackbits(np.frombuffer(self.file.read_at(bloom_len, bloom_at), np.uint8)).astype(bool)
        raw, at = self.unpack(self.file.read_at(index_len, index_at)) if self.entries else b"", 0
        self.last, self.places = [], []
        while at < len(raw):
            n, at = unvarint(raw, at)
            self.last.append(raw[at : at + n])
            self.places.append(struct.unpack_from("<QI", raw, at + n))
            at += n + 12

    def block(self, i: int):
        """(key, ids) of one block in order."""
        offset, length = self.places[i]
        raw, at, key = self.unpack(self.file.read_at(length, offset)), 0, b""
        while at < len(raw):
            shared, at = unvarint(raw, at)
            unshared, at = unvarint(raw, at)
            size, at = unvarint(raw, at)
            key = key[:shared] + raw[at : at + unshared]
            at += unshared
            yield key, np.frombuffer(raw, f"<u{raw[at]}", (size - 1) // raw[at], at + 1)
            at += size

    def scan(self):
        for i in range(len(self.places)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Token ids of every entry with this id: Bloom filter, binary search in the index, then its blocks."""
        want = key_of(doc_id, 0)[:9]
        if not self.bloom[_bloom_bits(want, len(self.bloom))].all():
            return []
        found = []
        for i in range(bisect_left(self.last, want), len(self.places)):
            for key, ids in self.block(i):
                if key[:9] == want:
                    found.append(ids)
                elif key[:9] > want:
                    return found
        return found


_ENCODERS: dict[str, Encoder] = {}


def _write(folder: str, tokenizer: str, end_id: int):
    end = struct.pack("<I", end_id)

    def run(batches):
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer)
        encoder, writer, ends = _ENCODERS[tokenizer], Writer(), []

        def parts():
            last = repeat = 0
            for b in common.slices(batches, "text", 4 << 20):
                ids, first = encoder.encode(*common.offsets_of(b.column(1)))
                wide = ids.astype("<u4").tobytes()
                for doc, s, e in zip(b.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                    repeat = repeat + 1 if writer.entries and doc == last else 0
                    last = doc
                    key = key_of(doc, repeat)
                    ends[:] = [ends[0] if ends else key[:9], key[:9]]
                    yield writer.add(key, wide[4 * s : 4 * e] + end)
            yield writer.finish()

        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        uri = common.write_file(folder, f"shard-{shard:06d}", parts())
        first, last = ends or (None, None)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "uri": [uri], "entries": pa.array([writer.entries], pa.int64()), "tokens": pa.array([writer.tokens], pa.int64()), "first": pa.array([first], pa.binary()), "last": pa.array([last], pa.binary())})

    return run


def write_token_tables(docs: DataFrame, tokenizer: str, end_id: int = 2, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode every whole text, append ``end_id``, and write shards in ascending id order; returns their manifest.

    Manifest rows (shard, uri, entries, tokens, first, last, start) are written to the shared folder, so shards of
    lost or repeated attempts are never read. first and last are keys, start is the number of ids in the shards
    before. A null text is empty, a null id comes first, rows that repeat an id follow each other in order of a
    hash of their texts.
    """
    spark = docs.sparkSession
    folder = common.scratch(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(common.partitions(spark, docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    shards = common.saved(dealt.mapInArrow(_write(folder, tokenizer, end_id), "shard long, uri string, entries long, tokens long, first binary, last binary"), "manifest")
    # One row for each shard: their running total is small whatever the corpus.
    return shards.selectExpr("*", "coalesce(sum(tokens) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start")


def _read(batches):
    for b in batches:
        for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows: list[list] = [[], [], [], []]
            for key, ids in Table(uri).scan():
                for held, x in zip(rows, (id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                    held.append(x)
                start += len(ids)
                if len(rows[0]) == 10_000:
                    yield _batch(rows)
                    rows = [[], [], [], []]
            yield _batch(rows)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_tables(manifest: DataFrame) -> DataFrame:
    """One row per document of the shards: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    return manifest.select("uri", "start").repartition(common.partitions(spark), "uri").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token ids (doc_id, ids) of the asked ids, a row for each entry of an id; ids that aren't there give none.

    The ranges of the shards, a row each, are sent to the tasks; every asked id goes to the shards whose range it is
    in, in whatever number, and is looked up there one after the other: Bloom filter, block index, block.
    """
    spark = manifest.sparkSession
    ranges = [(bytes(r["first"]), bytes(r["last"]), r["uri"]) for r in manifest.where("entries > 0").orderBy("shard").select("first", "last", "uri").toLocalIterator()]
    firsts, lasts = [r[0] for r in ranges], [r[1] for r in ranges]

    def dealt(batches):
        for b in batches:
            found = []
            for d in b.column(0).to_pylist():
                want = key_of(d, 0)[:9]
                found += [(r[2], d) for r in ranges[bisect_left(lasts, want) : bisect_right(firsts, want)]]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], ["uri", "doc_id"])

    def run(batches):
        table, last = None, None
        for b in batches:
            hits = []
            for uri, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if uri != last:
                    table, last = Table(uri), uri
                hits += [(d, ids) for ids in table.get(d)]
                if sum(len(h[1]) for h in hits[-100:]) > 1 << 20 or len(hits) > 10_000:
                    yield _found(hits)
                    hits = []
            yield _found(hits)

    ask = doc_ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    near = ask.mapInArrow(dealt, "uri string, doc_id long").repartitionByRange(common.partitions(spark, doc_ids), "uri", "doc_id").sortWithinPartitions("uri", "doc_id")
    return near.mapInArrow(run, "doc_id long, ids array<long>")


def _found(hits):
    return pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1].astype(np.int64) for h in hits], pa.list_(pa.int64()))], ["doc_id", "ids"])


def token_table(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write token tables of ``docs`` and read them back: doc_id, start, n_tokens, ids_crc32 per document.

    A null text is empty (its ids are the end id alone), a null id sorts first, repeated rows each get an entry.
    An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return read_token_tables(write_token_tables(docs, str(tokenizer), end_id))


def op8_token_table(spark, sf_dir: str) -> DataFrame:
    return token_table(common.table(spark, sf_dir, "documents"))
