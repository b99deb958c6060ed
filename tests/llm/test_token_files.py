import zlib

import numpy as np
import pytest
from cases import no_docs, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from songloom.llm import grammar, token_files
from songloom.llm.tables import fresh_path

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_50k.json")


@given(st.lists(st.integers(0, 3), max_size=400), st.integers(2, 5))
@settings(max_examples=200, deadline=None)
def test_grammar_round_trip_and_random_access(ids, least):
    ids = np.array(ids, dtype="<u4")
    frame = grammar.unpack(grammar.pack(ids, np.array([len(ids)]), least))
    assert (frame.ids() == ids).all()
    for a, b in ((0, 1), (3, 9), (len(ids) - 2, len(ids)), (5, 5)):
        assert frame.ids(max(a, 0), b).tolist() == ids[max(a, 0) : b].tolist()


def test_frequent_pairs_become_rules_with_lengths():
    ids = np.array([7, 8, 7, 8, 9] * 200, dtype="<u4")
    frame = grammar.unpack(grammar.pack(ids, np.array([400, 600]), 4))
    assert len(frame.seq) < 20 and frame.rule_lengths.max() > 10
    assert frame.document(1).tolist() == ids[400:].tolist()


def test_symbols_beyond_16_bits_are_kept():
    ids = np.tile(np.arange(70_000, dtype="<u4"), 3)
    assert (grammar.unpack(grammar.pack(ids, np.array([len(ids)]), 3)).ids() == ids).all()


def plain(text):
    """The library, as it is loaded."""
    from tokenizers import Tokenizer

    return np.array(Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@given(st.text(alphabet=" \n\t\r.,!'’aébZ1²中ー　\xa0́\U0001f600", max_size=24))
@settings(max_examples=500, deadline=None)
def test_chunks_encode_like_whole_texts(text):
    encode = token_files.encoder(VOCABULARY)
    assert encode(text) == encode.whole(text)


def test_words_before_runs_of_marks_are_only_merged(monkeypatch):
    """Of words that end in marks the library's splitter sees the run of marks, once."""
    encode, seen = token_files.Encoder(VOCABULARY), []
    whole = encode.whole
    monkeypatch.setattr(encode, "whole", lambda text: seen.append(text) or whole(text))
    text = "Hello!! wörld!! some?! Hello hello,,, !! x1!! éa...... b!!c d!!"
    assert encode(text) == plain(text)
    assert seen == ["!!", "?!", ",,,", " !!", " x1!!", "......", " b!!c"]


def test_texts_encode_as_the_library_does(spark, data_dir):
    encode = token_files.encoder(VOCABULARY)
    table = spark.read.parquet(f"{data_dir}/documents.parquet").limit(40).collect()  # some texts of the table
    texts = [r["text"] for r in table if r["text"]] + ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n<|endoftext", "Straße naïve, œuvre."]
    assert [encode(t) for t in texts] == [plain(t) for t in texts]
    assert plain("<|endoftext|>") == (50256).to_bytes(4, "little")


def test_a_range_expands_only_the_rules_it_needs():
    rng = np.random.default_rng(1)
    ids = np.concatenate((np.tile([1, 2, 3, 4], 500), rng.integers(5, 50, 4000), np.tile([60, 61, 62], 400)))
    frame = grammar.unpack(grammar.pack(ids, np.array([2000, 4000, 1200])))
    assert (frame.document(2) == ids[6000:]).all() and (frame.document(1) == ids[2000:6000]).all()
    assert frame._reached(frame.seq[-3:]).sum() < len(frame.rules) / 2


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_odd_rows_and_empty_table(spark):
    docs = odd_docs(spark)
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = token_files.round_trip(docs, VOCABULARY).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    assert token_files.round_trip(no_docs(spark), VOCABULARY).collect() == []


def test_small_frames_give_the_same_documents(spark):
    docs, folder = odd_docs(spark), fresh_path(spark, "frames-test")
    token_files.write_frames(docs, folder, VOCABULARY, frame_tokens=50)
    got = token_files.read_documents(spark, folder, with_ids=True).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got)
