"""The encoder against the tokenizers library, and exact round trips."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from boxlake.llm.bpe import digest_documents, encode_documents, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def same(text):
    ids = vocabulary(PATH).encode(text)
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, text[:80]
    assert vocabulary(PATH).decode(ids).decode() == text


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aeinrst hl'dv.\n\t  <|>endoftx|", max_size=80))
def test_dense_text(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "   ", "a" * 3000, " \n" * 500, "a  b   c \n d", "x<|endoftext|> y<|endoftext|>", "don't I'LL we've", "é ñ ß", "1234567890" * 100])
def test_cases(text):
    same(text)


def test_every_character_is_split_as_the_library_splits_it():
    differ = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 97 == 0) and vocabulary(PATH).encode(f"a{chr(c)}1 {chr(c)}b").tolist() != LIBRARY.encode(f"a{chr(c)}1 {chr(c)}b").ids]
    assert len(differ) == 0, [hex(c) for c in differ[:20]]


def test_frames(spark):
    docs = spark.createDataFrame([(1, "The cat", 5), (2, None, 5), (2, None, 5), (None, "", 1)], "doc_id long, text string, ids int")
    rows = {(r.doc_id, r.decoded): r.ids for r in encode_documents(docs, PATH).collect()}
    assert rows[1, "The cat"] == LIBRARY.encode("The cat").ids and rows[2, ""] == []
    assert digest_documents(docs, PATH).count() == 4
    assert digest_documents(docs.limit(0), PATH).count() == 0
