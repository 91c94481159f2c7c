"""Sizes of texts in tokens of a public tokenizer, whose files are read where they lie."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the tokenizer files; a parameter of every function below.
FOLDER = os.environ.get("CADENZA_TOKENIZERS", "/opt/tokenizers")
#: Byte-level BPE of 50,257 entries, trained on many languages.
DEFAULT = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the byte-level vocabularies split text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, Callable[[str], list[int]]] = {}


def encoder(name: str = DEFAULT, folder: str = FOLDER) -> Callable[[str], list[int]]:
    """text -> token ids, loaded once in each worker."""
    path = os.path.join(folder, name)
    if path not in _encoders:
        if name.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            _encoders[path] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        elif name.endswith(".json"):
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            made.encode_special_tokens = True
            _encoders[path] = lambda text: made.encode(text, add_special_tokens=False).ids
        else:
            import sentencepiece

            _encoders[path] = sentencepiece.SentencePieceProcessor(model_file=path).encode
    return _encoders[path]


def count_tokens(text: Column | str, name: str = DEFAULT, folder: str = FOLDER) -> Column:
    """Tokens of each text, whole; 0 for NULL and empty texts."""

    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(name, folder)
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    from pyspark.sql import types as T

    return F.pandas_udf(count, T.LongType())(text)
