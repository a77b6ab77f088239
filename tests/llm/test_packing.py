import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quaytally.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc = defaultdict(list)
    by_sequence = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    expected = []
    for key, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), 1024):
            piece = ids[start : start + 1024]
            expected.append((key, start, len(piece), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)), len(ids)))
    assert sorted(expected, key=str) == sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows), key=str)
    return by_sequence


def test_round_trip_on_documents(spark, small_documents):
    rows = packing.packed(small_documents, PATH).collect()
    sequences = check(rows, [(r.doc_id, r.text) for r in small_documents.collect()])
    used = sum(length for s in sequences.values() for _, length in s)
    assert len(sequences) * 1024 <= used * 1.02 + 1024


def test_hard_rows(docs_frame, hard_rows):
    check(packing.packed(docs_frame(hard_rows), PATH).collect(), hard_rows)


def test_white_space_is_encoded_as_a_whole_would_be(docs_frame):
    rows = list(enumerate(["a  b", "a\n\nb", " a", "a ", "a\nb c", "a \nb", "x y z", "'s 'll don't", "1 2\t3", "\n", " ", "a\r\nb", "\u0120a \u010ab\n\u0120", "a\xa0b \u2028 c", "x\u3000y", "\x85", "a\nb\nc\nd e f\ng"]))
    check(packing.packed(docs_frame(rows), PATH).collect(), rows)


def test_pieces_that_do_not_fit_the_cache_are_encoded_anew(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_PIECES", 3)
    ids, tokenizer = packing.Ids(PATH), Tokenizer.from_file(PATH)
    for text in ("a b c", "d e f", "a b c", "g\na d"):
        assert ids.of([text.encode(), b"", b"x  y"])[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_null_and_repeated_ids_over_many_buckets(docs_frame):
    rows = [(None if i % 3 else 7, "word " * (i % 5) + "end") for i in range(200)]
    check(packing.packed(docs_frame(rows), PATH, bucket_pieces=4).collect(), rows)


def test_empty_table(docs_frame):
    assert packing.packed(docs_frame([]), PATH).collect() == []


@pytest.mark.parametrize("histogram", [{1024: 3}, {700: 1000, 20: 5}, {n: n % 7 + 1 for n in range(1, 1024)}, {600: 10, 500: 10, 424: 10, 1: 3}])
def test_patterns_place_each_length_as_often_as_it_occurs(histogram):
    placed = defaultdict(int)
    for count, content in packing.patterns(histogram):
        assert sum(content) <= 1024
        for n in content:
            placed[n] += count
    assert placed == histogram
