"""Pieces that are encoded as the lines of one text have the ids that they have alone."""

import random

import numpy as np
import public_tokenizers

from quillon.llm import token_table

PATH = public_tokenizers.path("byte_bpe_50k.json")
BLANKS = [c for c in map(chr, range(0x110000)) if c.isspace()]


def spans(some):
    raw = [t.encode() for t in some]
    at = np.cumsum([0] + [len(r) for r in raw])
    return np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:]


def test_pieces_in_lines_have_their_own_ids(monkeypatch):
    monkeypatch.setattr(token_table, "LINES", 7)
    e, rng = token_table.Encoder(PATH), random.Random(5)
    some = ["".join(rng.choice(["a", "é", "ß", " ", "'s", "1", ".", "\t", "́", "日", "…", *rng.sample(BLANKS, 2)]) for _ in range(rng.randint(1, 6))) for _ in range(4000)]
    some += [f"{a}{b}{c}" for b in BLANKS for a in ("", "x", " ", "é") for c in ("", "x", " ", "é")]
    some = [t for t in some if t]
    data, start, end = spans(some)
    ids, count = e._pieces(data, data.tobytes(), start, end)
    upto = np.concatenate([[0], np.cumsum(count)])
    assert [ids[s:t].tolist() for s, t in zip(upto, upto[1:])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    lines = token_table.alone_in_line(data, start, end)
    assert not any(x and (t[-1].isspace() or "\n" in t or t.removeprefix(" ")[:1].isspace()) for x, t in zip(lines, some)) and lines.sum() > 1000


def test_new_pieces_are_encoded_many_at_once(monkeypatch):
    e, rng, texts = token_table.Encoder(PATH), random.Random(6), []
    data, start, end = spans([" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(5000))])
    raw = e._raw
    monkeypatch.setattr(e, "_raw", lambda some: texts.extend(some) or raw(some))
    ids, first = e.encode(np.append(start, end[-1]), data)
    assert ids.tolist() == e.tokenizer.encode(data.tobytes().decode(), add_special_tokens=False).ids and len(texts) < 50
