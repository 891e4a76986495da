"""Token ids of texts by a public tokenizer's file, in Arrow batches.  The file's path is a parameter, and must be readable on every executor."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def token_ids(text: Column, path: str) -> Column:
    """The ids of a text without special tokens; null texts have none."""

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = batch.fillna("")
            ids = [e.ids for e in tokenizer(path).encode_batch_fast(known.tolist(), add_special_tokens=False)]
            yield pd.Series([None if missing else x for x, missing in zip(ids, batch.isna(), strict=True)], dtype=object)

    return encoded(text)


def overlength(ids: Column, most: int = 256) -> Column:
    """Whether a label after the tokens is one too many."""
    return F.size(ids) + 1 > most


def single_labels(labels: list[str], path: str) -> dict[str, int]:
    """The one token of each label; an error where a label has several or none, or two share one."""
    ids = {x: tokenizer(path).encode(x, add_special_tokens=False).ids for x in labels}
    if any(len(i) != 1 for i in ids.values()) or len({i[0] for i in ids.values()}) < len(labels):
        raise ValueError(f"labels must be distinct single tokens: {ids}")
    return {x: i[0] for x, i in ids.items()}


def boundary_kept(prompt: Column, label: str, path: str) -> Column:
    """Whether the tokens of a prompt and its label are those of the prompt and the label's own."""
    own = single_labels([label], path)[label]
    return token_ids(F.concat(prompt, F.lit(label)), path) == F.concat(token_ids(prompt, path), F.array(F.lit(own)))
