"""Token files against the tokenizer itself, document by document."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from siftline.llm import queries
from siftline.llm import token_output as T
from siftline.session import load, scratch


def plain():
    tok = Tokenizer.from_file(queries.TOKENIZER)
    tok.encode_special_tokens = True
    return tok


def expected(rows):
    tok, start, out = plain(), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_tokenizer(spark, sf):
    rows = [(r.doc_id, r.text) for r in load(spark, sf, "documents").collect()]
    out = queries.QUERIES["op1_token_output"](spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in out.collect()) == expected(rows)


def test_odd_texts_ties_nulls_and_round_trip(spark, monkeypatch):
    texts = [
        "", None, " ", "\n\n a\r\n", "it's  they'll\t12 ½ ²³ x_y", "naïve café ÿ ǆ", "日本語 emoji 🎉 mix", "\x1c\x85\xa0 spaces here",
        "<|endoftext|> stays text", "a" * 3000, "word " * 5000, "İstanbul ſ K", "price: $5.00 #tag @me",
    ]
    rows = [(i // 2 if i else None, t) for i, t in enumerate(texts)] + [(7, "same"), (7, "same"), (2**62 + 1, "big id")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, part int").repartition(4)
    folder = scratch(spark, "tokens")
    manifest = T.write_tokens(df, folder, queries.TOKENIZER, 0, public_tokenizers.PATTERN)
    want = expected(rows)
    got = sorted((tuple(r) for r in T.read_tokens(spark, folder, digest=True).collect()), key=lambda r: r[1])
    assert got == want
    assert manifest.agg({"n_tokens": "sum"}).first()[0] == sum(r[2] for r in want)
    ids = {r.start: r.ids for r in T.read_tokens(spark, folder).collect()}
    tok = plain()
    for doc, text in rows:
        assert any(tok.decode(x[:-1], skip_special_tokens=False) == (text or "") for x in ids.values())


def test_same_ids_with_a_small_piece_table_and_in_slices(monkeypatch):
    text = "one two three four five six seven eight nine ten " * 40
    whole = plain().encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(T, "PIECES_KEPT", 4)
    monkeypatch.setattr(T, "TEXTS_AT_ONCE", 100)
    monkeypatch.setattr(T, "PIECES_AT_ONCE", 7)
    enc = T.PieceEncoder(queries.TOKENIZER, public_tokenizers.PATTERN)
    for _ in range(2):
        assert np.frombuffer(enc.encode([text])[0], "<u2").tolist() == whole
    assert np.frombuffer(T.PieceEncoder(queries.TOKENIZER, None).encode([text])[0], "<u2").tolist() == whole


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    folder = scratch(spark, "tokens")
    assert T.write_tokens(df, folder, queries.TOKENIZER).count() == 0
    assert T.read_tokens(spark, folder, digest=True).collect() == []


def test_encoder_equals_tokenizer_on_mixed_white_space(monkeypatch):
    """New words joined, known pieces and whole texts: all give the tokenizer's ids."""
    import random

    monkeypatch.setattr(T, "PIECES_KEPT", 30)
    monkeypatch.setattr(T, "WORDS_KEPT", 30)
    monkeypatch.setattr(T, "WORDS_AT_ONCE", 4)
    rnd, tok = random.Random(6), plain()
    bits = ["the", "it's", "'s", "'", "end.", "x_y", "12", "a1b2", "...", "na\u00efve", "\u00bd", "(paren)", "don't", "\u00df", "#tag", "$5.00", "''ll"]
    gaps = [" ", " ", " ", " ", "\n", "\n", "  ", " \n", "\n ", "\n\n", "\t", "\r\n", ""]
    enc = T.PieceEncoder(queries.TOKENIZER, public_tokenizers.PATTERN)
    assert public_tokenizers.PATTERN == T.WORDWISE
    for size in (3, 8, 40):
        texts = ["".join(rnd.choice(bits) + rnd.choice(gaps[: rnd.choice([4, 6, 13])]) for _ in range(rnd.randint(0, size))) for _ in range(400)]
        texts += [t.strip() for t in texts]
        want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
        assert sum(T.PieceEncoder._split(t) is not None for t in texts) > 50
        assert enc.encode(texts) == want and enc.encode(texts[::-1]) == want[::-1]


def test_words_before_a_mark_are_looked_up_without_the_pattern():
    class Counting:
        calls = 0

        def __init__(self, split):
            self.findall_of = split.findall

        def findall(self, text):
            Counting.calls += 1
            return self.findall_of(text)

    enc, tok = T.PieceEncoder(queries.TOKENIZER, public_tokenizers.PATTERN), plain()
    enc.split = Counting(enc.split)
    texts = ["so know, words. and words! but naïve; or: this? (no) end)", "so new, words"]
    for coded, text in zip(enc.encode(texts), texts):
        assert np.frombuffer(coded, "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert Counting.calls == 2  # the first word, which both share, and "(no)"
