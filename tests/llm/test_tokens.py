"""Token counts and the BPE codec against the public library."""

import random

import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

import public_tokenizers
from claimweave.llm import bpe_codec, token_counts
from claimweave.llm.lexicon import Lexicon, compile_lexicon

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SPECIAL = {"<|endoftext|>": 50256}


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(JSON)


def texts():
    r = random.Random(3)
    parts = ["a", "b", "é", "ß", "1", "2", "²", "'s", "'re", "'", "!", "?", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "中", "文", "，", "<|endoftext|>", "<|endof", "​", "　", "😀", "ʼ", "xxx", "́", "Ⅷ", "\r\n"]
    short = ["".join(r.choices(parts, k=r.randint(0, 60))) for _ in range(300)]
    return [*short, "a" * 5000, "word " * 3000, "中文，" * 2000, "<|endoftext|>x " * 700, "".join(r.choices(parts, k=4000)), " " * 5000, "ab1" * 3000, "!" * 3000, None, "", "the same", "the same"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", -1) for i, t in enumerate(rows)], "doc_id long, text string, ids string, n_tokens long")


def test_counts_equal_the_library(spark, library):
    rows = texts()
    counted = token_counts.token_counts(frame(spark, rows), RANKS, PATTERN, SPECIAL, block=1000, overlap=64)
    assert counted.columns == ["doc_id", "n_bytes", "n_tokens"]
    got = {r.doc_id: r for r in counted.collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        assert got[i].n_tokens == len(library.encode(text or "", add_special_tokens=False).ids), repr(text)[:80]
        assert got[i].n_bytes == len((text or "").encode())


def test_repeated_long_rows_and_null_ids_each_count(spark):
    rows = spark.createDataFrame([(1, "word " * 600), (1, "word " * 600), (None, "word " * 600), (None, None)], "doc_id long, text string")
    got = token_counts.token_counts(rows, RANKS, PATTERN, SPECIAL, block=500, overlap=64).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 0), (0, 601), (1, 601), (1, 601)]
    assert token_counts.token_counts(rows.limit(0), RANKS, PATTERN, SPECIAL).isEmpty()


def test_codec_equals_the_library_and_goes_back(spark, library):
    rows = texts()
    docs = frame(spark, rows)
    lexicon = bpe_codec.build_lexicon(docs, JSON, PATTERN, 300)
    for made in (bpe_codec.decode(bpe_codec.encode(docs, lexicon, JSON, PATTERN), JSON, PATTERN), bpe_codec.round_trip(docs, lexicon, JSON, PATTERN)):
        got = {r.doc_id: r for r in made.collect()}
        assert len(got) == len(rows)
        for i, text in enumerate(rows):
            ids = library.encode(text or "", add_special_tokens=False).ids
            assert list(got[i].ids) == ids and got[i].text == library.decode(ids, skip_special_tokens=False), repr(text)[:80]


def test_words_are_counted_over_all_texts(spark):
    docs = spark.createDataFrame([("the cat. the dog\nthe end",), ("the  cat",), (None,)], "text string")
    got = {r.word: r.n for r in bpe_codec.count_words(docs, JSON, PATTERN).collect()}
    own = bpe_codec.codec(JSON, PATTERN)
    want = {}
    for text in ("the cat. the dog\nthe end", "the  cat"):
        for w in own.words(text):
            want[w.encode()] = want.get(w.encode(), 0) + 1
    assert {bytes(k): v for k, v in got.items() if v} == want


def test_damaged_bytes_are_replaced_and_null_ids_stay(spark):
    rows = spark.createDataFrame([(1, [222]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe_codec.decode(rows, JSON, PATTERN).collect()}
    assert got == {1: "�", 2: None, 3: ""}


def test_lexicon_finds_its_words_alone_and_shares_ends():
    r = random.Random(1)
    words = {"".join(r.choices("abc", k=r.randint(1, 6))).encode() + r.choice([b"", b"ing", b"ed"]): (i, i + 1) for i in range(2000)}
    buffer = compile_lexicon(words.items())
    found = Lexicon(buffer)
    assert len(found) == len(words) and [found.number(w) for w in sorted(words)] == list(range(len(words)))
    asked = [*words, b"", b"z", b"abcabcabcabc", b"ingx", b"a", *(w[:-1] for w in words)]
    assert found.numbers(asked).tolist() == [found.number(w) for w in asked] and found.get_all(asked) == [found.get(w) for w in asked]
    for w, ids in words.items():
        assert found.get(w) == b"".join(i.to_bytes(4, "little") for i in ids)
    for w in (b"", b"z", b"abcabcabcabc", b"ingx"):
        assert w in words or found.get(w) is None
    assert len(compile_lexicon([(b"walking", (1,)), (b"talking", (2,))])) < len(compile_lexicon([(b"walking", (1,)), (b"talkers", (2,))]))
    assert Lexicon(compile_lexicon([])).get(b"a") is None and Lexicon(compile_lexicon([])).get_all([b"a", b""]) == [None, None] and found.get_all([]) == []


def test_long_words_merge_alike():
    own = bpe_codec.codec(JSON, PATTERN)
    r = random.Random(2)
    for _ in range(20):
        word = "".join(r.choices("thein", k=r.randint(150, 199))).encode()
        assert own.merge(word) == own._merge_long([own.of_byte[b] for b in word])


def test_words_merge_alike_together():
    own = bpe_codec.codec(JSON, PATTERN)
    r = random.Random(4)
    words = ["".join(r.choices(r.choice(["the ing", "aaaab", "aé中 1.", "etaoinshrdlu"]), k=r.randint(1, 40))).encode() for _ in range(3000)] + [b"a" * k for k in range(1, 40)]
    assert own._alike and own.merge_all(words) == [b"".join(i.to_bytes(4, "little") for i in own.merge(w)) for w in words] and own.merge_all([]) == []


@pytest.mark.parametrize("pattern", [PATTERN, r"\p{L}{1,3}|\s+|[^\s\p{L}]"])
def test_texts_are_split_as_the_pattern_does(pattern):
    r = random.Random(5)
    parts = ["'s", "'re", "'r", "'ll", "'", "s", "e", "Ⅷ", "1", " ", "  ", "\n", "　", "\x85", "\x1c", "é", "中", "😀", "́", "!", "<|endoftext|>", "<|endof", "text|>"]
    rows = [None, "", *("".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(4000)), "it's", "'s's ''s 's\n's 've're'l", "<|endof", "text|>", ""]
    own = bpe_codec.codec(JSON, pattern)
    words, before = bpe_codec.words_of(own, pa.array(["left out", *rows, "too"]).slice(1, len(rows)))
    got = [bytes(w).decode() for w in words.to_pylist()]
    assert len(words.dictionary) == len(set(got)) and before[0] == 0 and before[-1] == len(got)
    for text, a, b in zip(rows, before, before[1:]):
        want, at = [], 0
        for m in own.any_special.finditer(text or ""):
            want += [*own.words(text[at : m.start()]), m[0]]
            at = m.end()
        assert got[a:b] == [*want, *own.words((text or "")[at:])], repr(text)
    for empty in ([], [None, ""]):
        assert bpe_codec.words_of(own, pa.array(empty, pa.string()))[1].tolist() == [0] * (len(empty) + 1)


def test_words_of_a_portion_are_merged_together_and_once(library, monkeypatch):
    """None of them by itself, where there are no long ones; those of the portion before are remembered."""
    r = random.Random(6)
    rows = [" ".join(f"{''.join(r.choices('aeinorst', k=6))}-{r.randint(0, 999)}!" for _ in range(40)) for _ in range(300)]
    asked = []
    flat = bpe_codec.Codec.merge_flat
    monkeypatch.setattr(bpe_codec.Codec, "merge", lambda *_: pytest.fail("a word is merged by itself"))
    monkeypatch.setattr(bpe_codec.Codec, "merge_flat", lambda self, x, size: asked.append(len(size)) or flat(self, x, size))
    monkeypatch.setattr(bpe_codec, "PORTION", 40_000)
    shared = type("Shared", (), {"value": compile_lexicon([(b"-", (12,))])})
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(rows * 2)], ["doc_id", "text"])
    made = [x for b in bpe_codec._encoder(shared, JSON, PATTERN, ["doc_id", "ids"])(iter([batch])) for x in b.to_pylist()]
    assert [x["doc_id"] for x in made] == list(range(600)) and [x["ids"] for x in made] == [library.encode(x).ids for x in rows] * 2
    own = bpe_codec.codec(JSON, PATTERN)
    assert len(asked) > 3 and sum(asked) == len({w for x in rows for w in own.words(x)} - {"-"})


def test_portions_hold_each_row_once(monkeypatch):
    monkeypatch.setattr(bpe_codec, "PORTION", 1000)
    texts = ["x" * n for n in (1, 5000, 10, 400, 400, 400, 0, 999)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array(texts[a:b])], ["id", "text"]) for a, b in ((0, 3), (3, 3), (3, 8))]
    got = list(bpe_codec.portions(iter(batches)))
    assert [x for b in got for x in b.column(1).to_pylist()] == texts and all(b.num_rows == 1 or b.nbytes <= 1100 for b in got)
    empty = pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([""])], ["id", "text"])
    assert sum(b.num_rows for b in bpe_codec.portions(iter([empty, empty]))) == 2 and not list(bpe_codec.portions(iter([])))
