import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from dialoom.llm import tokencount
from tests.llm.helpers import ODD, documents, with_clashes

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
COUNTER = tokencount.PieceCounter(PATH)
TEXT = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\r", "a", "be", "é", "1", ".", "<s>", "▁", "日", "word"]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_pre_tokens_add_up(text):
    assert sum(COUNTER(tokencount.pre_tokens(text))) == len(MODEL.encode(text)) or not text


def test_counts_of_odd_rows(spark):
    docs = with_clashes(documents(spark, [*ODD, "over " * 5000]))
    for hot in (0, 3, 1000):
        rows = {r.doc_id: r for r in tokencount.token_counts(docs, PATH, hot=hot).collect()}
        assert len(rows) == len(ODD) + 1
        for doc, text in enumerate([*ODD, "over " * 5000]):
            n = len(MODEL.encode(text or ""))
            assert (rows[doc].n_bytes, rows[doc].n_tokens, rows[doc].over_limit) == (len((text or "").encode()), n, n > 4096)


def test_repeated_rows_and_nothing(spark):
    rows = tokencount.token_counts(documents(spark, ["a b", "a b", "c"], ids=[5, 5, None]), PATH, hot=1).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == [(-1, 1), (5, 2), (5, 2)]
    assert tokencount.token_counts(documents(spark, []), PATH).count() == 0
