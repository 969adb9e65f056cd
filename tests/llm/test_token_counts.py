import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from callweave.llm import tokenize
from callweave.llm.token_counts import op1_token_counts, token_counts

ODD = ["", " ", "  ", "\n", " \n", "\n ", "a", " a", "a ", "a  b", "a \n b", "a\n\nb", "\na", "▁a▁ b", "<s> </s> <unk> <0x0A>", "x\0y", "ﬁ ①  é́", "\t\r\n", "日本語 テキスト", "a" * 3000, " " * 40 + "x", "👩‍👧 ok​", "<|endoftext|> <|startoftext|>x"]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_equals_library(spark, sf, name):
    path = str(public_tokenizers.path(name))
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    if name.endswith(".model"):
        want = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    else:
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    c, i = tokenize.counts(path), tokenize.ids(path)
    import numpy as np

    assert [c.count(t) for t in texts] == [len(w) for w in want]
    assert [np.frombuffer(i.ids(t), i.of.dtype).tolist() for t in texts] == want


def test_cases(spark):
    schema = "doc_id long, text string, n_tokens string, id int"
    rows = [(1, None, "x", 1), (1, None, "x", 1), (None, "a b", "y", 2), (3, "", None, None), (4, "a " * 9000, "z", 4)]
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted(token_counts(spark.createDataFrame(rows, schema), path).collect(), key=str)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted([(r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or "")), len(sp.encode(r[1] or "")) > 4096) for r in rows], key=str)
    assert sorted([tuple(r) for r in got], key=str) == want
    assert token_counts(spark.createDataFrame([], schema), path).count() == 0


def test_query(spark, sf):
    out = op1_token_counts(spark, sf)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert [f.dataType for f in out.schema] == [T.LongType()] * 3 + [T.BooleanType()]
    assert out.count() == 200
