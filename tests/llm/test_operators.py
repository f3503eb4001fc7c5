"""The corpus operators against brute force, and on nulls, empty texts, repeated rows and empty tables."""

import base64
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, common, components, decontaminate, exact_dedup, html_text, jaccard_join, mixing, quality, suffix_dedup, token_table, warc, words

DOCS = "doc_id long, text string, source string, text_sha256 string, n long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "ti", "on", "é", "re", "the"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows, a clashing column."""
    rng = random.Random(5)
    base = [prose(rng, rng.choice([3, 4, 5, 30, 120, 400])) for _ in range(60)]
    passage = prose(rng, 70)
    texts = base + base[:8] * 3 + [b.replace(" ", "\n ") for b in base[:4]]
    for b in base[20:40]:
        w = b.split(" ")
        w[len(w) // 2] = "other"
        texts.append(" ".join(w))
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(10)] + [passage + " " + passage, "a" * 1000, "ab" * 700, "", None, " \n", "日本語 текст", prose(rng, 9000), "<|endoftext|> x", "two  spaces \t tab", "it's we'll nb"]
    rows = [(i, t, rng.choice(["a", "b", "c", None]), "clash", 7) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id at all in this row", "a", None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *keys):
    return sorted((tuple(r[k] for k in (keys or df.columns)) for r in df.collect()), key=str)


def test_exact_dedup(spark, docs):
    every = docs.collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    want = []
    for r in every:
        group = [x for x in every if norm(x.text) == norm(r.text)]
        best = min(group, key=lambda x: (-len(x.text or ""), x.doc_id is None, x.doc_id or 0))
        kept = r.doc_id == best.doc_id and len(r.text or "") == len(best.text or "")
        want.append((r.doc_id, best.doc_id, len(group), kept, hashlib.sha256(norm(r.text).encode()).hexdigest()))
    assert rows_of(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=str)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_withdrawn_texts_are_not_live(spark, docs):
    gone = docs.where("doc_id = 0")
    out = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, withdrawn=gone).collect()}
    assert out[0].keep_id is None and not out[0].kept and out[0].group_size == 0
    assert out[10].kept


def test_cuckoo_index_inserts_deletes_and_resizes():
    rng = np.random.default_rng(1)
    digests = np.frombuffer(b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(20_000)), np.uint64).reshape(-1, 4)
    index, one = exact_dedup.CuckooIndex(), np.ones(1000, np.int64)
    for at in range(0, len(digests), 1000):
        index.add(digests[at : at + 1000], one, np.arange(at, at + 1000), one)
    again = rng.permutation(20_000)[:3000]
    index.add(digests[again], np.full(3000, 2), again, np.full(3000, 5))
    assert index.resizes > 0 and len(index) == 20_000
    at = index.find(digests)
    assert (index.digest[at] == digests).all() and (index.ids[at] == np.arange(20_000)).all()
    assert (index.count[at[again]] == 6).all() and (index.points[at[again]] == 2).all() and index.count[: index.used].sum() == 35_000
    for d in digests[:5000]:
        assert index.delete(d) and not index.delete(d)
    assert (index.find(digests[5000:]) >= 0).all() and (index.find(digests[:5000]) < 0).all()
    assert index.filter.contains(digests[:5000, 0]).mean() < 0.01
    index.add(digests[:10], one[:10], np.arange(10), one[:10])
    assert len(index) == 15_010


def test_cuckoo_hits_are_verified_by_content():
    """Digests with one 64-bit key share the fingerprint and the bucket; only their content tells them apart."""
    digests = np.array([[7, 0, 0, i] for i in range(6)], np.uint64)
    index = exact_dedup.CuckooIndex(8)
    for i in range(6):
        index.add(digests[[i, i]], np.array([1, 3]), np.array([10 + i, exact_dedup.NO_ID]), np.array([1, 1]))
    assert len(index) == 6 and (index.ids[index.find(digests)] == exact_dedup.NO_ID).all() and (index.count[index.find(digests)] == 2).all()
    assert index.delete(digests[3]) and (index.find(digests) >= 0).tolist() == [True, True, True, False, True, True]


def windows_of(items):
    out = []
    for item, t in items:
        w = WORD.findall(lower(t))
        n = min(len(w), 10)
        out += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    return out


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_decontaminate(spark, docs):
    every = docs.collect()
    longest = next(r.text for r in every if r.text and r.text.startswith(r.text[:5]) and len(r.text.split()) > 300)
    items = [(1, " ".join(longest.split()[50:80])), (2, "日本語 ТЕКСТ текст"), (3, "日本語"), (4, None), (5, every[0].text), (None, "two spaces"), (10, "two spaces tab")]
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(docs, bench).collect()}
    want = set()
    for r in every:
        w = WORD.findall(lower(r.text))
        hit, found = set(), set()
        for item, g in windows_of(items):
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    found.add("" if item is None else str(item))
        want.add((r.doc_id, len(w), len(hit), tuple(sorted(found))))
    assert got == want
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {w[0] for w in want if not w[2]}
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    spans = decontaminate.contamination(docs, bench, spans=True).where("n_hit > 20").select("doc_id", "n_hit", "matches").collect()
    assert spans and all(max(m.n_words for m in s.matches) <= s.n_hit for s in spans)
    texts = {r.doc_id: WORD.findall(lower(r.text)) for r in every}
    for s in decontaminate.contamination(docs, bench, spans=True).where("doc_id is not null").collect():
        best = 0
        for item, t in {(str(i), t) for i, t in items}:
            a, b = WORD.findall(lower(t)), texts[s.doc_id]
            for i in range(len(a)):
                for j in range(len(b)):
                    if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                        n = 0
                        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                            n += 1
                        if n >= min(10, len(a)):
                            best = max(best, n)
                            assert any((m.item_pos, m.doc_pos, m.n_words) == (i, j, n) for m in s.matches)
        assert s.longest == best == max([0, *(m.n_words for m in s.matches)])


def test_suffix_array_is_that_of_brute_force():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3, 5, 10):
        h = rng.integers(1, 4, 400).astype(np.uint64)
        end = np.repeat([150, 151, 400], [150, 1, 249])
        key = lambda i, w=width: tuple(h[i : min(i + w, end[i])].tolist())
        assert [key(i) for i in decontaminate.suffix_array(h, end, width)] == sorted(key(i) for i in range(400))


def brute_jaccard(every, threshold=0.8):
    sets = {}
    for r in every:
        w = WORD.findall(lower(r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(ids, 0)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in ids}


def test_near_duplicates(spark, docs, monkeypatch):
    one = docs.dropDuplicates(["doc_id"])
    want = brute_jaccard(one.collect())
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(one).collect()}
    assert got.pop(None) == (None, 0) and got == want
    monkeypatch.setattr(jaccard_join, "BLOCK", 300)  # many blocks in a run
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(one).collect()}
    got.pop(None)
    assert got == want
    kept = jaccard_join.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i, (c, _) in want.items() if i == c)
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0


def test_unlike_texts_of_one_id_stay(spark):
    texts = [(1, "one two three four five six"), (1, "ONE two, three four five six"), (1, "quite another text of some words"), (2, "one two three four five six"), (3, None), (3, ""), (3, "x"), (None, "x")]
    want = [(1, "ONE two, three four five six"), (1, "quite another text of some words"), (3, None), (3, "x"), (None, "x")]
    for n in (1, 3, 7):
        docs = spark.createDataFrame([(i, t, "s") for i, t in texts] * 2, "doc_id long, text string, source string").repartition(n)
        assert rows_of(jaccard_join.deduplicated(docs)) == sorted([(i, t, "s") for i, t in [*want, (None, "x")]], key=str)


def test_prefix_is_shortened_to_the_target(spark):
    assert jaccard_join.prefix_length(0.8, 0.99) == 6 and jaccard_join.prefix_length(0.8, 0.999) == 4
    rng = np.random.default_rng(4)
    tall, depth = jaccard_join.TREES, jaccard_join.DEPTH
    base = rng.integers(0, 2**32, (60, tall, depth), np.uint64)
    other = base.copy()
    other[:, :, 3] += 1  # above the threshold by signature, but no tree shares more than three values
    rows = [(i, v.astype(">u4").tobytes()) for i, v in enumerate([*base, *other])]
    labels = spark.createDataFrame(rows, "cid long, label binary")
    assert jaccard_join.measured_recalls(labels, 0.8) == [1.0, 1.0, 1.0, 0.0, 0.0, 0.0] and jaccard_join.adapted_prefix(labels, 0.8, 0.99) == 3
    assert jaccard_join.adapted_prefix(labels.limit(60), 0.8, 0.99) == 6 and jaccard_join.measured_recalls(labels.limit(0), 0.8) == [1.0] * depth


def test_runs_of_the_forest_over_ranges(spark):
    rng = np.random.default_rng(5)
    labels = [bytes(rng.integers(0, 2, jaccard_join.TREES * jaccard_join.DEPTH).astype(">u4").tobytes()) for _ in range(200)]
    df = spark.createDataFrame([(i, 3, x) for i, x in enumerate(labels)], "cid long, n long, label binary")
    want = {}
    for i, x in enumerate(labels):
        for t in range(jaccard_join.TREES):
            want.setdefault((t, x[24 * t : 24 * t + 16]), set()).add(i)
    first = {}
    for key in sorted(want):
        first.setdefault(frozenset(want[key]), key[0])
    got = {}
    for r in jaccard_join.forest_runs(df, 4, 7).collect():
        assert r.total == 3 * r.members
        got.setdefault((r.run, r.tree), set()).add(r.cid)
    assert {(t, frozenset(v)) for (_, t), v in got.items()} == {(t, m) for m, t in first.items() if len(m) > 1} and len(got) == len([m for m in first if len(m) > 1])


def test_near_duplicates_of_one_id_on_two_texts(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve", "p q r s t u v w x y z aa bb"
    rows = [(1, a), (1, b), (2, a + " thirteen"), (3, b + " cc"), (4, a + " thirteen fourteen")]
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).select("doc_id", "class_id", "n_links").collect())
    assert got == [(1, 1, 1), (1, 1, 2), (2, 1, 2), (3, 1, 1), (4, 1, 2)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100), (None, 3)] + [(1000, i) for i in range(1001, 1900)] + [(3000 - i, 2000 - i) for i in range(500, 600)]
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 1000 for i in range(1000, 1900)} | {i: 1000 for i in range(2401, 2501)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(every, length):
    seen = {}
    raw = [(r.doc_id, (r.text or "").encode()) for r in every]
    for _, b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for doc, b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out.append((doc, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, bucket", [(200, 512), (200, 1), (100, 512), (37, 3), (20, 1), (16, 512)])
def test_suffix_dedup(spark, docs, length, bucket, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated_windows, "__defaults__", (200, 40, bucket))
    docs = docs.where("length(text) < 20000 or text is null") if length < 200 else docs
    got = rows_of(suffix_dedup.suffix_dedup(docs, length), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats(docs.collect(), length)
    assert length != 200 or suffix_dedup.suffix_dedup(empty(spark)).count() == 0


def test_windows_of_tiles_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(6)
    data = rng.integers(97, 100, 30_000).astype(np.uint8)
    data[5000:5600] = 97
    offsets = np.array([0, 100, 9000, 9000, 9250, 30_000])
    h, c, pos, lo, hi = suffix_dedup.anchors(offsets, data)
    windows = {w: (a, b) for a, b, s, e in zip(h.tolist(), (pos - lo).tolist(), lo.tolist(), hi.tolist()) for w in range(s, e + 1)}
    monkeypatch.setattr(suffix_dedup, "TILE", 700)
    h2, c2, pos2, lo2, hi2 = suffix_dedup.anchors(offsets, data)
    assert {w: a for a, s, e in zip(h2.tolist(), lo2.tolist(), hi2.tolist()) for w in range(s, e + 1)} == {w: a for w, (a, _) in windows.items()}
    assert all(bytes(data[p : p + 40]) for p in pos) and (hi - lo <= 160).all() and (hi2 - lo2 <= 160).all()


def test_kept_texts(spark, docs):
    got = {r.doc_id: r.text for r in suffix_dedup.kept_texts(docs).collect()}
    want = {d: h for d, _, n, _, h in brute_repeats(docs.collect(), 200)}
    assert all(hashlib.sha256(got[d].encode()).hexdigest() == h for d, h in want.items() if "�" not in got[d])


@pytest.mark.parametrize("length", [1, 3, 7, 8, 12, 30])
def test_refined_buckets_hold_equal_strings_and_no_lone_one(length):
    rng = random.Random(length)
    data = np.frombuffer(b"abcab" * 9 + bytes(rng.choice(b"ab") for _ in range(300)), np.uint8)
    bucket = suffix_dedup.refined(data, length).tolist()
    strings = [bytes(data[i : i + length]) for i in range(len(data) - length + 1)]
    assert len(bucket) == len(strings)
    for x, s in zip(bucket, strings):
        assert (x < 0) == (strings.count(s) == 1)
    assert len({(x, s) for x, s in zip(bucket, strings) if x >= 0}) == len({s for x, s in zip(bucket, strings) if x >= 0}) == len({x for x in bucket if x >= 0})


def test_token_table(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    manifest = token_table.write_token_tables(docs, path)
    got = [tuple(r) for r in token_table.read_token_tables(manifest).orderBy("start").collect()]
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append(tok.encode(r.text or "", add_special_tokens=False).ids + [2])
    order = sorted(ids, key=lambda d: (d is not None, d))
    want, start = [], 0
    for d in order:
        for x in ids[d]:
            want.append((d, start, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))))
            start += len(x)
    assert got == want
    found = {r.doc_id: r.ids for r in token_table.lookup(manifest, docs.where("doc_id in (5, 80)").select("doc_id").unionByName(spark.sql("select 10000000L as doc_id"))).collect()}
    assert found == {d: ids[d][0] for d in (5, 80)}
    assert token_table.token_table(empty(spark)).count() == 0


def test_encoder_pieces_equal_whole_texts(monkeypatch):
    import public_tokenizers

    e = token_table.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(token_table, "CACHE_PIECES", 300)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é's,.!?\n 12'lld-_ ²x́\u00a0\u2003\u2019…×\t") for _ in range(60)) for _ in range(1500)] + ["", " ", "a", "\0 b c", "\n", "x\n\n y\n"]
    for some in (texts[:700], texts[700:], ["<|endoftext|> a b", "c d"]):
        raw = [t.encode() for t in some]
        ids, first = e.encode(np.cumsum([0] + [len(r) for r in raw]), np.frombuffer(b"".join(raw), np.uint8))
        for t, s, n in zip(some, first[:-1], first[1:]):
            assert ids[s:n].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_pieces_of_a_text_do_not_depend_on_the_next():
    texts = [b"a  ", b"b", b"", b"c \t ", b"d\n", b"e  ", b"", b"f", b" ", b"g  ", b" h"]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    of = lambda some: token_table.pieces(np.cumsum([0] + [len(t) for t in some]), np.frombuffer(b"".join(some), np.uint8)).tolist()
    assert of(texts) == [int(at) + p for at, t in zip(offsets, texts) for p in of([t])]


def test_mixing(spark, docs):
    got = mixing.mixed(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    every = docs.collect()
    per = {}
    for r in every:
        per[r.source] = per.get(r.source, 0) + size(r.text)
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, left, rest = {}, sum(per.values()), set(names)
    while rest:
        share = left / sum(weight[s] for s in rest)
        full = {s for s in rest if share * weight[s] > 3 * per[s]}
        if not full:
            target |= {s: share * weight[s] for s in rest}
            break
        target |= {s: 3 * per[s] for s in full}
        left -= sum(3 * per[s] for s in full)
        rest -= full
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((r.doc_id, size(r.text)) for r in every if r.doc_id is not None)
    taken = {}
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == per[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.taken
    most = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= 2 * most for s in names) and sum(taken.values()) <= sum(per.values())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(3)).collect()))
    out = mixing.repeated(docs)
    assert out.columns == docs.columns and sum(size(r.text) for r in out.collect()) == sum(taken.values())
    assert mixing.mixed(empty(spark)).count() == 0


def test_warc(spark):
    htmls = ["<p>x</p>", "<p>x</p>", "", None, "é" * 5000, "a\r\n\r\nb", "<p>x</p>"]
    rows = [(i, None if i == 1 else f"http://h/{i}\r\nX: y", h, 1) for i, h in enumerate(htmls)] + [(None, "u", "<p>x</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long").repartition(3)
    index = warc.write_archives(pages)
    got = {r.page_id: r for r in warc.read_archives(index).collect()}
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    for i, h in enumerate(htmls):
        assert (got[i].payload_bytes, got[i].payload_digest) == (len((h or "").encode()), sha(h))
    assert {i: got[i].refers_to for i in got} == {0: None, 1: 0, 2: None, 3: 2, 4: None, 5: None, 6: 0, None: 0}
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in got.values())
    assert bytes(got[4].payload).decode() == htmls[4] and bytes(got[5].payload).decode() == htmls[5]
    assert got[1].url is None and "\n" not in got[0].url
    assert [r.page_id for r in warc.read_archives(index, "page_id = 4").collect()] == [4]
    assert {r.record_type for r in warc.read_archives(warc.write_archives(pages, min_bytes=10**6)).collect()} == {"response"}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    assert [[r[0] for r in x] for x in warc.coalesced([(0, 10), (20, 10), (100, 5)], gap=10, most=1000)] == [[0, 20], [100]]


def test_html_text(spark):
    body = "<nav><a>Home</a></nav><div class='ad-box'>Buy</div>{}<aside>More</aside><div id=comments><p>me too</p></div><footer>&copy; x</footer>"
    page = lambda s: f"<!DOCTYPE html><html><head><title>t</title><script>if (a<b) '</p>'</script></head><body>{body.format(s)}"
    rows = [
        (1, "http://a/1", page("<article><h1>T &amp;  x</h1><p><b>One\n two<br><p>Thr&eacute;e&lt;b&gt;</article>")),
        (2, "http://a/2", page("<article><p>cut &am")), (3, None, None), (4, "nohost", ""), (5, "http://b/", page("<div><p>No article</p>tail</div>")),
        (6, "http://c/", "<nav><ul><li>never closed<article><p>In</p></article>"), (7, "http://c/2", "<article><p>a<!-- x --><i>b</i></p><form>f</form><li>c<li>d</article>"),
    ]
    rows += [(100 + i, f"http://site/{i}", f"<body><div><p>Story number {i} of many {i * i}</p></div><div class=box{i % 2}>Read all our terms</div>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(pages).collect()}
    want = {1: "T & x\nOne two\nThrée<b>", 2: "cut &am", 3: "", 4: "", 5: "No article\ntail", 6: "In", 7: "ab\nc\nd"}
    want |= {100 + i: f"Story number {i} of many {i * i}" for i in range(30)}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_html_text_of_a_site_with_one_article_stays(spark):
    pages = spark.createDataFrame([(i, f"http://s/{i}", "<article><p>Same</p><p>Words</p></article>") for i in range(40)], "page_id long, url string, html string")
    assert {r.text for r in html_text.main_text(pages).collect()} == {"Same\nWords"}


def site_texts(spark, n, page):
    pages = spark.createDataFrame([(i, f"http://s/{i}", page(i)) for i in range(n)], "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in html_text.main_text(pages).collect()}


def test_html_text_of_one_body_under_many_titles_stays(spark):
    for tag in ("article", "main"):
        got = site_texts(spark, 40, lambda i: f"<div>Our menu</div><{tag}><h1>Title {i}</h1><p>Same body</p></{tag}>")
        assert got == {i: f"Title {i}\nSame body" for i in range(40)}


@pytest.mark.parametrize("n", [100, 1000])
@pytest.mark.parametrize("percent", [80, 98])
def test_html_text_of_own_bodies_stays_beside_a_repeated_one(spark, n, percent):
    body = lambda i: "Same body" if i % 100 < percent else f"Own {i}"
    got = site_texts(spark, n, lambda i: f"<article><h1>Title {i}</h1><p>{body(i)}</p></article>")
    assert got == {i: f"Title {i}\n{body(i)}" for i in range(n)}
    got = site_texts(spark, n, lambda i: f"<div class=box><h1>Title {i}</h1><p>{body(i)}</p></div><ul><li>All rights</ul>")  # without an article, what repeats may go
    assert all(got[i] == f"Title {i}\n{body(i)}" for i in range(n) if i % 100 >= percent)


@pytest.mark.parametrize("name", ["with-sidebar", "has-comments", "no-header", "hasSidebar", "page--with-sidebar", "comments-open", "sidebar-layout", "content sidebar"])
def test_html_class_of_a_wrapper_is_not_boilerplate(name):
    text = lambda h: html_text.Page(h).main()
    rest = "<div class='ad-box'>Buy</div><div class='site-header'>Site</div><div id=sidebar2>More</div>"
    assert text(f"<body><div class='{name}'><p>A story of some words</p>{rest}</div>") == "A story of some words"
    assert text(f"<body><div id='{name}'>{rest}<div class='{name}'><p>A story of some words</p></div></div>") == "A story of some words"
    assert text(f"<article class='post {name}'><p>In</p></article><p>Out</p>") == "In"


def test_html_named_branches_go_and_formulas_stay():
    text = lambda h: html_text.Page(h).main()
    assert text("<p>Short</p><div class='comments'><p>A thread longer than the story</p></div>") == "Short"
    assert text("<article><p>Short</p><ol class='comment-list'><li>A thread longer than the story</li></ol></article>") == "Short"
    assert text("<article class='comment'>Me too</article><p>A story</p>") == "A story"
    assert text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p></article>") == "So x=2 holds"


def test_html_tree_removes_what_no_name_tells(spark):
    """Hosts of 6, 20 and 300 pages without an article and without telling names: the tree decides, and only it."""
    for n in (6, 20, 300):
        page = lambda i: f"<body><div class=x1><p>Our terms hold</p><p>Since 1999</p></div><div class=x2><h2>Story {i}</h2><p>Words of story {i}, {i * 7} in all</p></div><div><p>Call us at any time</p></div><div><p>Or on day {i}</div>"
        got = site_texts(spark, n, page)
        assert got == {i: f"Story {i}\nWords of story {i}, {i * 7} in all\nOr on day {i}" for i in range(n)}
        assert all(html_text.Page(page(i)).main() != got[i] for i in range(n))  # without the tree every page says more


def test_html_of_few_pages_stays(spark):
    assert site_texts(spark, 3, lambda i: "<div><p>The same on three pages</p></div>") == dict.fromkeys(range(3), "The same on three pages")


def test_html_lists_of_links_go_unless_they_are_the_page():
    links = "<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul>"
    text = lambda h: html_text.Page(h).main()
    assert text(f"<div>{links}</div><div><p>A story with a <a href=x>link</a> and <a href=y>another</a> and <a href=z>more</a> of them</p></div>") == "A story with a link and another and more of them"
    assert text(f"<body>{links}</body>") == "One\nTwo\nThree"
    assert text(f"<article><p>So</p>{links}</article>") == "So\nOne\nTwo\nThree"


def test_importance_is_that_of_brute_force(spark):
    import math
    from collections import Counter

    rng = random.Random(8)
    rows = [(i, f"http://{'ab'[i % 2]}/{i}", f"<div class=x><p>{rng.choice(['p', 'q'])}</p></div><div class=y>{'<p>z</p>' * rng.randint(1, 3)}</div><p>{i}") for i in range(41)] + [(99, "http://c/", "<p>one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {(r.host, r.path): (r.pages, r.importance) for r in html_text.importance(html_text.counted(pages)).collect()}
    styles, contents = {}, {}
    for _, url, source in rows:
        for path, (style, content) in html_text.Page(source).nodes.items():
            styles.setdefault((url.split("/")[2], path), Counter())[style] += 1
            contents.setdefault((url.split("/")[2], path), Counter())[content] += 1

    def entropy(counts):
        n = sum(counts.values())
        return -sum(c / n * math.log(c / n, n) for c in counts.values()) if n > 1 else 1.0

    assert set(got) == set(styles)
    for key, (n, shown) in got.items():
        weight = 0.9 ** len(styles[key])
        own = (1 - weight) * entropy(styles[key]) + weight * entropy(contents[key])
        assert n == sum(styles[key].values()) and abs(shown - (n * own + 1) / (n + 1)) < 1e-9


@pytest.mark.parametrize("source", ["<div>" * 200_000 + "x", "<p><b>" * 100_000 + "x", "<table><td>" + "<div>" * 100_000 + "x", "<ul><li>" * 50_000 + "x", "</i></b>" * 200_000 + "x", "<a" * 200_000, "<p " + "a='" * 100_000])
def test_html_of_hostile_pages_takes_linear_time(source):
    import time

    started = time.process_time()
    text = html_text.Page(source).main()
    assert time.process_time() - started < 15 and text in ("x", "")


def test_html_with_clashing_columns(spark):
    rows = [(i, f"http://s/{i}", "<article>In</article>", "h", 1, 2) for i in range(3)] + [(None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, paths int, n long")
    out = html_text.main_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and sorted((r.text, r.n_chars) for r in out.collect()) == [("", 0), ("In", 2), ("In", 2), ("In", 2)]


def test_quality(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 80) if i % 2 else " | ".join("$$$" for _ in range(60))) for i in range(600)] + [(9001, ""), (9002, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)] + [(3, None), (None, 1), (5, 1)], "doc_id long, quality int")
    out = quality.quality(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out]
    assert 60 < len(held) < 180 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == r.doc_id % 2 for r in held if r.doc_id < 600]) > 0.98
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0


def walked(trees, row):
    """The score of one row of statistics, node by node."""
    total = trees.base
    for k in trees.roots:
        while trees.left[k] != k:
            k = trees.left[k] if row[trees.feature[k]] <= trees.threshold[k] else trees.right[k]
        total += trees.value[k]
    return 1 / (1 + math.exp(-total))


def statistics_of(text):
    """The statistics of one text, counted plainly."""
    raw = text.encode()
    marks = b"|$&%#*<>{}@/\\=+_-:;!?,.\"'()[]~^`"
    group = lambda c: 1 if 97 <= c < 123 else 2 if 65 <= c < 91 else 3 if 48 <= c < 58 else 5 if c == 10 else 4 if c in b"\t\x0b\x0c\r " else 6 if 128 <= c < 192 else 7 if c >= 192 else 8 + marks.index(c) if c in marks else 0
    n = max(len(raw), 1)
    kinds = Counter(map(group, raw))
    shares = [kinds[k] / n for k in range(8 + len(marks))]
    # Words of the statistics that measure lengths are runs of word bytes, letter case aside.
    words_ = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
    low = [w.lower() for w in words_]
    count = len(words_)
    w = max(count, 1)
    sizes = [len(x) for x in words_]
    mean = sum(sizes) / w
    var = sum(x * x for x in sizes) / w - mean**2
    held = Counter(low)
    pairs = list(zip(low, low[1:]))
    lines = raw.split(b"\n")
    lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    lines_held = Counter(lines)
    m = max(len(lines), 1)
    closed = 0
    for x in lines:
        body = x[:-1] if x.endswith(b"\n") else x
        closed += (body or x)[-1:] in (b".", b"!", b"?", b'"', b"'", b")") if body else False
    return [
        *shares, math.log1p(len(raw)), math.log1p(count), mean, math.sqrt(max(var, 0)), sum(x > 12 for x in sizes) / w, len(held) / w, max(held.values(), default=0) / w, len(set(pairs)) / max(len(pairs), 1),
        math.log1p(len(lines)), len(raw) / m, len(lines_held) / m, max(lines_held.values(), default=0) / m, sum(a == b for a, b in zip(raw, raw[1:])) / n, closed / m, -sum(p * math.log(p) for p in shares if p), sum(x == 1 for x in sizes) / w,
        sum(c == 1 for c in held.values()) / w, sum(65 <= x[0] < 91 for x in words_) / w,
    ]


def test_statistics_are_those_of_brute_force():
    rng = random.Random(9)
    texts = [prose(rng, rng.choice([1, 5, 80])) for _ in range(20)] + ["", "\n", "a", "A b\nA b\nC d.\n", "x\n\n!y", "é É 12 aa", "||$$ word", "trailing\n", "日本語\nтекст.", "\t \x0b", "supercalifragilistic word"]
    raw = [t.encode() for t in texts]
    got = quality.statistics(np.cumsum([0] + [len(r) for r in raw]), np.frombuffer(b"".join(raw), np.uint8))
    for t, row in zip(texts, got):
        assert np.allclose(row, statistics_of(t), atol=1e-9), (t, [(n, a, b) for n, a, b in zip(quality.NAMES, row, statistics_of(t)) if abs(a - b) > 1e-9])


def test_histograms_find_the_best_split_of_brute_force():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = ((x[:, 1] > 6) ^ (rng.random(300) < 0.1)).astype(float)
    t = quality.grow(x, y, trees=1, depth=1)
    g, w = y - y.mean(), np.full(300, y.mean() * (1 - y.mean()))
    best = max((g[x[:, f] <= c].sum() ** 2 / (w[x[:, f] <= c].sum() + 1) + g[x[:, f] > c].sum() ** 2 / (w[x[:, f] > c].sum() + 1), f, c) for f in range(3) for c in range(11) if 20 <= (x[:, f] <= c).sum() <= 280)
    root = t.roots[0]
    assert t.feature[root] == best[1] and (x[:, best[1]] <= t.threshold[root]).tolist() == (x[:, best[1]] <= best[2]).tolist()
    low = x[:, best[1]] <= best[2]
    assert np.isclose(t.value[t.left[root]], 0.1 * g[low].sum() / (w[low].sum() + 1)) and np.isclose(t.value[t.right[root]], 0.1 * g[~low].sum() / (w[~low].sum() + 1))


def test_quality_learns_from_one_row_of_an_id(spark):
    rows = [(i, "good words of prose " * 9 if i % 2 else "$$ | $$ | " * 20) for i in range(200)]
    one = quality.train(spark.createDataFrame(rows + [(1, "zz"), (1, "zz")] * 50, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int"))
    two = quality.train(spark.createDataFrame([*rows, (1, "zz")], "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int"))
    assert np.array_equal(one.value, two.value) and np.array_equal(one.threshold, two.threshold)


def test_trees_walk_like_a_single_row():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    t = quality.grow(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=20)
    assert all(abs(t.predict(row[None])[0] - walked(t, row)) < 1e-9 for row in x[:20])


def test_chat(spark):
    talk = [("user", "a"), ("assistant", "b"), ("user", "c"), (None, None)]
    rows = [(c, i, *talk[i]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1), (5, 3)) for i in range(n)]
    rows += [(6, 0, "user", "a"), (6, 1, "assistant", "x"), (7, None, "", ""), (8, None, None, None), (2, 0, "user", "a"), (9, 0, "user", "aa")]
    rows += [(10, i, "user", f"turn {i}") for i in range(600)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    turns = turns.withColumn("part", F.lit(1)).withColumn("pos", F.lit("x")).withColumn("copies", F.lit(None).cast("int"))  # names that the operator uses itself
    got = {r.conv_id: r for r in chat.chat_format(turns).collect()}
    assert set(got) == {2, 6, 7, 8, 9, 10} and got[2].copies == 2 and got[10].n_turns == 600
    assert got[2].text == "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in talk)
    assert got[10].text == "".join(f"<|im_start|>user\nturn {i}<|im_end|>\n" for i in range(600))
    assert chat.chat_format(turns.limit(0)).count() == 0


def test_words_and_shingles():
    texts = ["One two-three", "", "ÀB c", "x"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    h, first = words.words(offsets, np.frombuffer(b"".join(raw), np.uint8))
    assert np.diff(first).tolist() == [3, 0, 2, 1]
    s, at = words.shingles(h, first)
    assert np.diff(at).tolist() == [1, 0, 1, 1] and len(set(s.tolist())) == 3


def test_attach_broadcasts_only_hot_groups(spark, monkeypatch):
    rows = spark.range(50_000).selectExpr("if(id % 2 = 0, 0, id) as k", "id")
    groups = common.saved(rows.groupBy("k").count(), "g")
    out = common.attach(rows, groups, ["k"], "count", 50_000)
    assert out.count() == 50_000 and out.where("k = 0").select("count").distinct().collect()[0][0] == 25_000


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 8192])
def test_texts_that_collide_under_polynomial_hashes(spark, n):
    import public_tokenizers

    one, two = thue_morse(n), thue_morse(n, "b", "a")
    offsets, data = np.array([0, n, 2 * n]), np.frombuffer((one + two).encode(), np.uint8)
    h, _ = words.words(offsets, data)
    assert h[0] != h[1] and words.words(offsets, data, 1)[0][0] != h[0]
    e = token_table.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, first = e.encode(offsets, data)
    assert [ids[s:t].tolist() for s, t in zip(first, first[1:])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in (one, two)]
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{one} x"), (4, f"x {one * 2}")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, one)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, bench).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}
    assert {r.doc_id: r.n_links for r in jaccard_join.near_duplicates(docs).collect()} == dict.fromkeys(range(1, 5), 0)
    assert rows_of(suffix_dedup.suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(docs.collect(), 200)


def test_pieces_whose_first_hash_is_equal(monkeypatch):
    import public_tokenizers

    e = token_table.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    digests = words.digests
    monkeypatch.setattr(words, "digests", lambda d, s, t, seed=0: digests(d, s, t, seed) % np.uint64(7) + np.uint64(1) if seed == 1 else digests(d, s, t, seed))
    texts = ["some words of a text and more of them", "other words altogether, in another text"] * 2
    for _ in range(2):
        raw = [t.encode() for t in texts]
        ids, first = e.encode(np.cumsum([0] + [len(r) for r in raw]), np.frombuffer(b"".join(raw), np.uint8))
        assert [ids[s:t].tolist() for s, t in zip(first, first[1:])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_mix_tells_nulls_apart_and_keeps_columns_of_its_own_names(spark):
    rows = [(1, None, "a b c", 1, "p"), (1, "a b c", None, 2, "q"), (2, "d e f g", "s", 3, "r"), (2, "", None, 4, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _times int, _key string").withColumn("_pass", F.lit(9)).withColumn("size", F.lit("z"))
    taken = {(r.doc_id, r.source): r.taken // max(r.size, 1) for r in mixing.mixed(docs).collect() if r.size}
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    got = [tuple(r)[:5] for r in out.collect()]
    assert sorted(map(str, got)) == sorted(str(r) for r in rows for _ in range(taken.get((r[0], r[2]), 0) if r[1] else 0))


def test_lookup_over_shards(spark, docs):
    import public_tokenizers

    many = spark.range(3000).selectExpr("cast(id div 2 as long) as doc_id", "concat('text ', id) as text")
    manifest = token_table.write_token_tables(many, public_tokenizers.path("byte_bpe_50k.json"))
    assert manifest.count() == 8
    asked = spark.range(0, 2000, 3).selectExpr("id as doc_id").unionByName(spark.sql("select cast(null as long) as doc_id"))
    got = {}
    for r in token_table.lookup(manifest, asked).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: 2 for i in range(0, 1500, 3)}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Session.conf)

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)


def test_very_long_texts(spark):
    """Texts of ten megabytes go through every operator whole."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(50_000)]
    text = " ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), 1_700_000))
    assert len(text) > 9_500_000
    docs = spark.createDataFrame([(1, text, "a"), (2, text + " end", "a"), (3, None, "b"), (4, "short", "b")], "doc_id long, text string, source string").repartition(3)
    docs = common.saved(docs, "long")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
    assert {r.doc_id: r.group_size for r in exact_dedup.exact_dedup(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    words_ = text.split(" ")
    bench = spark.createDataFrame([(7, " ".join(words_[-60:]))], "item_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_hit, r.longest) for r in decontaminate.contamination(docs, bench).collect()} == {1: (1_700_000, 60, 60), 2: (1_700_001, 60, 60), 3: (0, 0, 0), 4: (1, 0, 0)}
    assert {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(docs).collect()} == {1: (len(text), len(text)), 2: (len(text) + 4, len(text)), 3: (0, 0), 4: (5, 0)}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = tok.encode(text, add_special_tokens=False).ids
    rows = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_table.token_table(docs).collect()}
    assert rows[1] == (len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) and rows[3][0] == 1
    assert {r.doc_id: r.size for r in mixing.mixed(docs).collect()} == {1: 1_700_000, 2: 1_700_001, 3: 0, 4: 1}
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.quality(docs, labels).count() == 4
    pages = docs.selectExpr("doc_id AS page_id", "'http://h/' AS url", "concat('<article><p>', text, '</p></article>') AS html")
    assert {r.page_id: r.n_chars for r in html_text.main_text(pages).collect()} == {1: len(text), 2: len(text) + 4, 3: 0, 4: 5}
    assert {r.page_id: r.payload_bytes for r in warc.read_archives(warc.write_archives(pages), with_payload=False).collect()} == {1: len(text) + 26, 2: len(text) + 30, 3: 0, 4: 31}
