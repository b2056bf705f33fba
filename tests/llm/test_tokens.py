import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilspan.llm.bpe_matrix import MatrixBpe, encode_decode
from veilspan.llm.packing import first_fit_decreasing, pack
from veilspan.llm.token_counts import TokenCounter, count_tokens
from veilspan.llm.token_files import decode_block, encode_block, read_token_files, token_file_digest, write_token_files
from veilspan.llm.tokens import LibraryEncoder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [chr(c) for c in range(0x180)] + list(" \n  \t\u0085   　'’漢字😀́̇İΣςſ") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", " the", "THE", "\n\n", "word "]
TEXTS = st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


BPE = MatrixBpe(RANKS, public_tokenizers.PATTERN)
OTHERS = {p: MatrixBpe(RANKS, p) for p in (r"\w+|\W", r"[\s\S]{1,90}")}
ENCODERS = {p: LibraryEncoder(p) for p in (BYTE, WORD)}
COUNTER = TokenCounter(WORD)


def ids(raw):
    return np.frombuffer(raw, dtype="<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_matrix_encoding_equals_the_library(reference, text):
    got = ids(BPE.encode([text])[0])
    assert got == reference.encode_ordinary(text)
    assert BPE.decode(got) == text.encode()


def test_long_pretokens_equal_the_library(reference):
    rng = random.Random(4)
    for text in ["x" * 3000, "ab" * 900, "".join(rng.choice("etaoinshr") for _ in range(2000)), "!?" * 400, "é" * 500]:
        assert ids(BPE.encode([text])[0]) == reference.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeiothnrs \n'x!", min_size=65, max_size=400) | st.lists(st.sampled_from(["the", "in", "ing", "aaaa", "xx", "er", "and", "tion"]), min_size=20, max_size=200).map("".join))
def test_long_rows_equal_the_library(reference, text):
    assert BPE.merge_long(text.encode()).tolist() == tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=BPE.ranks, special_tokens={}).encode_ordinary(text)


def test_a_very_long_pretoken_is_merged_in_time(reference):
    text = "".join(random.Random(2).choices("etaoinshr", k=300_000))
    assert BPE.decode(BPE.merge_long(text.encode()).tolist()) == text.encode()


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_another_pattern_is_honoured(text):
    for pattern in OTHERS:
        other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=BPE.ranks, special_tokens={})
        assert ids(OTHERS[pattern].encode([text])[0]) == other.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_memoised_chunks_equal_whole_texts(text):
    for encoder in ENCODERS.values():
        assert ids(encoder.ids(text)) == encoder.library.encode(text, add_special_tokens=False).ids
    assert COUNTER.count(text) == len(ENCODERS[WORD].library.encode(text, add_special_tokens=False).ids)


def test_proven_tokens_encode_alone():
    library = Tokenizer.from_file(WORD)
    for piece in random.Random(1).sample(sorted(COUNTER.whole), 500):
        assert len(library.encode(piece, add_special_tokens=False).ids) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=60), st.integers(1, 5))
def test_block_round_trip(values, documents):
    cuts = np.diff([0, *sorted(random.Random(0).choices(range(len(values) + 1), k=documents - 1)), len(values)])
    lengths, got = decode_block(encode_block(np.array(values, dtype="<u4"), cuts))
    assert lengths.tolist() == cuts.tolist() and got.tolist() == values


def test_blocks_that_are_no_blocks_are_refused():
    block = encode_block(np.arange(1000), np.array([1000]))
    with pytest.raises(ValueError):
        decode_block(block[:-1])
    with pytest.raises(ValueError):
        decode_block(b"NOPE" + block[4:])


def rows_of(odd):
    return [(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()]


def test_encode_decode_of_odd_rows(odd, none, reference):
    got = sorted(map(tuple, encode_decode(odd, RANKS, public_tokenizers.PATTERN).collect()), key=repr)
    want = []
    for i, t in rows_of(odd):
        x = reference.encode_ordinary(t)
        want.append((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert encode_decode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_counts_of_odd_rows(odd, none):
    library = Tokenizer.from_file(WORD)
    want = [(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in rows_of(odd)]
    assert sorted(map(tuple, count_tokens(odd, WORD).collect()), key=repr) == sorted(want, key=repr)
    assert count_tokens(none, WORD).count() == 0


def test_token_files_of_odd_rows(odd, none):
    library = Tokenizer.from_file(BYTE)
    at, want = 0, []
    for i, t in sorted(rows_of(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        x = np.array([*library.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(map(tuple, token_file_digest(odd, BYTE, 2).collect()), key=repr) == sorted(want, key=repr)
    assert token_file_digest(none, BYTE, 2).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_tree_packs_as_a_plain_first_fit(sizes):
    bins, offsets = first_fit_decreasing(np.array(sizes, dtype=np.int64), 50)
    room, want = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        b = next((j for j, r in enumerate(room) if r >= sizes[k]), len(room))
        if b == len(room):
            room.append(50)
        want[k] = (b, 50 - room[b])
        room[b] -= sizes[k]
    assert [(int(b), int(o)) for b, o in zip(bins, offsets, strict=True)] == [want[k] for k in range(len(sizes))]


def test_packing_of_odd_rows(odd, none):
    got = pack(odd, WORD, group_documents=4).toPandas()
    library = Tokenizer.from_file(WORD)
    want = sorted((i, [*library.encode(t, add_special_tokens=False).ids, 1]) for i, t in rows_of(odd) if i is not None and i < 9 or i in (10, 11, 12))
    for i, x in want:
        own = got[got.doc_id == i].sort_values("start")
        assert own.length.sum() == len(x) == own.doc_tokens.iloc[0]
        for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True):
            assert c == zlib.crc32(np.array(x[s : s + n], dtype="<u4").tobytes())
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 2048
    assert pack(none, WORD).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*map(chr, range(0x100)), *"   \n\n''..", "'s", "'LL", " the", "word.", "%%%", "\n\n"]), max_size=40).map("".join))
def test_pieces_of_latin_texts_equal_whole_texts(text):
    assert ids(ENCODERS[BYTE].ids(text)) == ENCODERS[BYTE].library.encode(text, add_special_tokens=False).ids


def test_a_word_is_encoded_once_whatever_marks_follow_it(monkeypatch):
    plain, seen = LibraryEncoder._piece, []
    monkeypatch.setattr(LibraryEncoder, "_piece", lambda self, piece: seen.append(piece) or plain(self, piece))
    encoder, text = LibraryEncoder(BYTE), "The thoniner, a thoniner für o thoniner%%% für; thoniner!! für."
    assert ids(encoder.ids(text)) == encoder.library.encode(text, add_special_tokens=False).ids
    assert seen.count(" thoniner") == seen.count(" für") == 1


def test_digests_are_read_without_the_column_of_ids(spark, tmp_path):
    write_token_files(spark.createDataFrame([(2, "two words"), (1, None), (3, "naïve 漢字")], "doc_id long, text string"), BYTE, 2, f"file://{tmp_path}/files")
    whole, digests = read_token_files(spark, f"file://{tmp_path}/files"), read_token_files(spark, f"file://{tmp_path}/files", with_ids=False)
    assert "ids" not in digests.columns and sorted(map(tuple, digests.collect())) == sorted(map(tuple, whole.drop("ids").collect()))
    library = Tokenizer.from_file(BYTE)
    assert {r["doc_id"]: ids(bytes(r["ids"])) for r in whole.collect()} == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in [(1, ""), (2, "two words"), (3, "naïve 漢字")]}
