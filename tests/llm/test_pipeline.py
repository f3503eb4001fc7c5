"""The pipeline's stages against brute force on a small table."""

import hashlib
import re
import struct
import zlib
from collections import Counter
from itertools import groupby

import corpus_pipeline

from quillon.llm import quality

from test_operators import WORD, brute_jaccard, lower, statistics_of, walked, windows_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    every = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    (_, f1), (_, f2) = corpus_pipeline.STAGES[:2]
    good = f1(spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    known = [d for d in labels if d in every]
    assert sum((d in kept) == bool(labels[d]) for d in known) > 0.9 * len(known)
    # The stage keeps what a plain walk of the same trees keeps.
    trees = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept == {d for d, r in every.items() if walked(trees, statistics_of(r.text or "")) >= 0.3}
    one = f2(spark, docs, SF)
    want = brute_jaccard(list(every.values()))
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {d for d, (c, _) in want.items() if d == c}


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["_score", "_key", "_times", "_pass", "_set", "_shared", "node", "label", "size", "taken", "_id", "score"]
    wide = docs.selectExpr("*", *(f"{i} AS `{n}`" for i, n in enumerate(names)))
    odd = wide.selectExpr(*(f"cast(null as {t}) as `{n}`" for n, t in wide.dtypes))
    wide = wide.unionByName(odd).unionByName(wide.limit(3)).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, plain = stage(spark, wide, SF), stage(spark, wide.select(*docs.columns), SF)
        assert out.columns == wide.columns
        rows = out.collect()
        assert all(tuple(r)[len(docs.columns) :] in (tuple(range(len(names))), (None,) * len(names)) for r in rows)
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in plain.collect()), name
        assert stage(spark, wide.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SF).count() == wide.count()


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert rows and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_later_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    every = docs.collect()
    (_, f3), (_, f4), (_, f5) = corpus_pipeline.STAGES[2:]
    grams = {g for _, g in windows_of([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])}
    clean = set()
    for r in every:
        w = WORD.findall(lower(r.text))
        if not any(tuple(w[i : i + n]) in grams for n in {len(g) for g in grams} for i in range(len(w) - n + 1)):
            clean.add(r.doc_id)
    assert 0 < len(clean) < len(every) and Counter(r.doc_id for r in f3(spark, docs, SF).collect()) == Counter(r.doc_id for r in every if r.doc_id in clean)

    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in every}
    order = sorted(every, key=lambda r: (hashlib.md5(f"11|{'-' if r.doc_id is None else r.doc_id}|{r.text or ''}".encode()).hexdigest(), r.doc_id))
    total, finish = Counter(), {}
    for r in order:
        total[r.source] += size[r.doc_id]
        finish[r.doc_id] = r.source, total[r.source]
    rate = {s: 6 // (1 + i % 3) for i, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    times = sorted(((upto + k * total[s]) * rate[s], d) for d, (s, upto) in finish.items() if size[d] for k in range(3))
    want, left = Counter(), sum(total.values())
    for _, same in groupby(times, key=lambda t: t[0]):
        ids = [d for _, d in same]
        left -= sum(size[d] for d in ids)
        if left < 0:
            break
        want.update(ids)
    mix = f4(spark, docs, SF)
    assert Counter(r.doc_id for r in mix.collect()) == want

    import public_tokenizers
    from tokenizers import Tokenizer

    tok, text = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {r.doc_id: r.text for r in every}
    ids = {d: tok.encode(text[d] or "", add_special_tokens=False).ids + [2] for d in want}
    expected = Counter({(d, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))): want[d] for d, x in ids.items()})
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in f5(spark, mix, SF).collect()) == expected
