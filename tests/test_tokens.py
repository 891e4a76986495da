"""Tokens of records against the tokenizers library."""

import pytest
from pyspark.sql import functions as F

from corploom.functions import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_tokens(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    plain = lambda t: tok.encode(t, add_special_tokens=False).ids
    texts = ["", None, "Answer:", "Answer: ", "Ça va? 日本\n", "word " * 300, "x" * 255, "end of it\t", "A", " A"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    ids = tokens.token_ids(F.col("text"), path)
    rows = df.select("text", ids.alias("ids"), tokens.overlength(ids).alias("over"), tokens.boundary_kept(F.col("text"), " A", path).alias("kept"), tokens.boundary_kept(F.col("text"), "s", path).alias("plural")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r["text"] is None:
            assert r["ids"] is None and r["kept"] is None
            continue
        assert r["ids"] == plain(r["text"]) and r["over"] == (len(plain(r["text"])) + 1 > 256)
        assert r["kept"] == (plain(r["text"] + " A") == plain(r["text"]) + plain(" A"))
        assert r["plural"] == (plain(r["text"] + "s") == plain(r["text"]) + plain("s"))
    assert {r["plural"] for r in rows} == {True, False, None}
    assert len(set(tokens.single_labels([" A", " B", " C"], path).values())) == 3
    for bad in ([" A", " A B"], ["", " A"]):
        with pytest.raises(ValueError, match="single tokens"):
            tokens.single_labels(bad, path)
