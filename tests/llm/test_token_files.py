import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from placerank.llm import token_files
from placerank.llm.queries import tokenizer_file
from placerank.llm.token_files import END, WordIds, encode_texts, read_metadata, read_tokens, shared_folder, token_table, write_tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, END]


def test_words_equal_whole_texts(tokenizer):
    odd = [
        "", " ", "Hello, WORLD!! it's don't 'tis 12345 a1b2...", "x́ é. Å̊K İstanbul ΣΑΣ.", "tab\tand\x0bvt\x1cfs\x85nel nbsp　wide",
        "end<|endoftext|>mid <|ENDOFTEXT|> <|startoftext|>", "***!!! (quoted).… “fine”,", "日本語。テスト!", "á.,", ".́,", "№5. ½, x²!", "\x00 ﻿",
        "naïve's 'S 'll", "9's 9.,9", "😀!😀.", "a" * 5000,
    ]
    got, n = WordIds(tokenizer_file()).encode(pa.array(odd, pa.large_string()))
    at = 0
    for text, k in zip(odd, n, strict=True):
        assert got[at : at + k].tolist() == ids_of(tokenizer, text), text
        at += k


def test_files_hold_all_documents(documents, texts, tokenizer):
    start = 0
    got = {r.doc_id: r for r in token_table(documents, tokenizer_file()).collect()}
    for i, text in sorted(texts):
        ids = ids_of(tokenizer, text)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_are_sorted_and_read_in_part(spark, documents, tokenizer):
    path = shared_folder(spark, "test-tokens")
    write_tokens(documents, path, tokenizer_file())
    part = read_tokens(spark, path, 20, 30)
    assert sorted(r.doc_id for r in part.collect()) == list(range(20, 30))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,20)" in plan and "n_chars" not in plan
    assert "ids" not in read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    for file in spark.read.parquet(path).inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file:"))
        doc = meta.metadata.row_group(0).column(0)
        assert doc.has_column_index and doc.has_offset_index and doc.encodings and "DELTA_BINARY_PACKED" in doc.encodings
        ids = meta.read(["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids)


def test_odd_rows_and_empty_tables(odd_documents, no_documents, tokenizer):
    rows = token_table(odd_documents, tokenizer_file()).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7] and rows[3].n_tokens == 1
    assert [r.start for r in rows[1:]] == np.cumsum([r.n_tokens for r in rows])[:-1].tolist()
    assert token_table(no_documents, tokenizer_file()).count() == 0
    assert encode_texts(no_documents, tokenizer_file()).count() == 0


def test_new_words_of_letters_are_encoded_together(tokenizer):
    class Counting:
        texts = 0

        def encode_batch_fast(self, batch, **how):
            self.texts += len(batch)
            return tokenizer.encode_batch_fast(batch, **how)

    words = WordIds(tokenizer_file())
    words.tokenizer = counting = Counting()
    made = ["".join(chr(97 + (i // 26**k + 7 * k) % 26) for k in range(2 + i % 9)) for i in range(5_000)]
    text = " ".join([*made, "naïve", "don't", "a1b2", "Ünder.", *made[:9]])
    got, n = words.encode(pa.array([text, "", " "], pa.large_string()))
    assert got[: n[0]].tolist() == ids_of(tokenizer, text) and n[1:].tolist() == [1, 1]
    assert counting.texts < 10


def test_letters_that_turn_into_a_letter_and_a_mark_keep_what_follows(tokenizer):
    texts = ["Bİ. bİ, İ", "ड़. क़! x", "שׁ, וֹ..", "é. ж!"]
    got, n = WordIds(tokenizer_file()).encode(pa.array(texts, pa.large_string()))
    assert got.tolist() == [i for text in texts for i in ids_of(tokenizer, text)] and n.sum() == len(got)


def test_new_words_of_any_letters_are_encoded_together(tokenizer):
    words, batches = WordIds(tokenizer_file()), []
    encode = words._one_by_one
    words._one_by_one = lambda some: (batches.append(len(some)), encode(some))[1]
    made = ["".join("éüñßабвж"[(i // 8**k) % 8] for k in range(4)) + "x" * (i % 3) for i in range(4_000)]
    text = " ".join([*made, "Éü", "日本", "a1", *made[:9]])
    for _ in range(2):  # the second time every word is known
        got, n = words.encode(pa.array([text], pa.large_string()))
        assert got.tolist() == ids_of(tokenizer, text)
    assert sum(batches) == 1


def test_words_with_one_hash_are_told_apart(tokenizer, monkeypatch):
    long = "x" * 5_000
    texts = [f"{long}a {long}b. one two, {long}c", "", "two one. three", f"{long}b"]
    want = [i for text in texts for i in ids_of(tokenizer, text)]
    words = WordIds(tokenizer_file())
    for _ in range(2):
        assert words.encode(pa.array(texts, pa.large_string()))[0].tolist() == want
    monkeypatch.setattr(token_files, "hashes", lambda some: np.full(len(some), 7, np.uint64))
    words = WordIds(tokenizer_file())
    for _ in range(3):
        assert words.encode(pa.array(texts, pa.large_string()))[0].tolist() == want
