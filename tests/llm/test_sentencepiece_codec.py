import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import clashing, prose, rows_of
from tidewater.llm.sentencepiece_codec import END_ID, PieceCodec, encode_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
CODEC = PieceCodec(MODEL)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("abehtngirs  ▁\n\t.é漢字𝔘ㅎ<>0x\x00 ￿​,'-"), max_size=60))
def test_ids_and_text_are_the_librarys(text):
    ids = SP.encode(text) + [END_ID]
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == SP.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_unicode(text):
    assert CODEC.encode(text) == SP.encode(text) + [END_ID]


@pytest.mark.parametrize("n", [1, 2, 3, 13, 14, 15, 16, 17, 31, 33, 100, 1001])
def test_runs_of_spaces(n):
    for text in (" " * n, "a" + " " * n, " " * n + "hello", "x" + " " * n + "hello\n" + " " * n):
        assert CODEC.encode(text) == SP.encode(text) + [END_ID]


def test_one_word_of_many_characters():
    text = prose(1, 4000).replace(" ", "")
    assert CODEC.encode(text) == SP.encode(text) + [END_ID]


def test_invalid_bytes_decode_as_the_library_does():
    ids = [CODEC.bytes_ids[0xC3], CODEC.bytes_ids[0x28], CODEC.bytes_ids[0xFF], *SP.encode("ok")]
    assert CODEC.decode(ids) == SP.decode(ids)


def test_documents(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = [(1, "Some  text.\nAnd 漢字 more\t"), (2, ""), (3, None), (None, "no id"), (5, prose(3, 30_000)), (1, "Some  text.\nAnd 漢字 more\t")]
    df = encode_documents(clashing(spark, texts, "doc_id bigint, text string"), MODEL)
    want = []
    for i, t in texts:
        ids = SP.encode(t or "") + [END_ID]
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(SP.decode(ids))))
    assert rows_of(df, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    with_ids = encode_documents(spark.createDataFrame([(7, "ab c")], "doc_id bigint, text string"), MODEL, with_ids=True).first()
    assert list(with_ids.ids) == SP.encode("ab c") + [END_ID] and with_ids.decoded == "ab c"
    assert encode_documents(spark.createDataFrame([], "doc_id bigint, text string"), MODEL).count() == 0
