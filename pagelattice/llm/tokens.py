"""Sizes of texts in tokens of a public tokenizer, whose rank file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str = DEFAULT_TOKENIZER):
    import tiktoken

    with open(path, "rb") as ranks:
        merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def prompt_end(text: str) -> int:
    """Where the text after its first paragraph begins, 0 if it has only one paragraph: that part bears no loss."""
    at = text.find("\n\n")
    return at + 2 if at >= 0 and text[at:].strip() else 0


def measured(rows: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(id, tokens, loss_tokens, *keep) of every row with a text; loss_tokens leaves out the first of several paragraphs. Texts aren't shuffled."""

    def run(batches):
        encode = encoding(tokenizer).encode_ordinary
        for batch in batches:
            total, loss = [], []
            for text in batch.column("text").to_pylist():
                n = len(encode(text))
                cut = prompt_end(text)
                total.append(n)
                loss.append(max(0, n - len(encode(text[:cut]))) if cut else n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total, pa.int64()), pa.array(loss, pa.int64()), *(batch.column(k) for k in keep)], names=["id", "tokens", "loss_tokens", *keep])

    kept = [rows.schema[c] for c in keep]
    schema = ", ".join(["id long", "tokens long", "loss_tokens long", *(f"`{c.name}` {c.dataType.simpleString()}" for c in kept)])
    source = rows.where(rows[id_col].isNotNull() & rows[text_col].isNotNull())
    return source.select(source[id_col].cast("long").alias("id"), source[text_col].alias("text"), *[source[c] for c in keep]).mapInArrow(run, schema)
