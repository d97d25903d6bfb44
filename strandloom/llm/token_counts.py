"""Token counts: pieces are counted once per distinct pre-token, joined to pre-token frequencies and summed.

A pre-token here is a run of characters between ASCII white space. No token of the vocabularies that this operator takes
crosses white space, so the library's count for a text is the sum of its counts for the text's pre-tokens, each times its
frequency. No list of ids of a text is made.

The distinct list is kept by each task for the documents that it reads, not for the whole corpus: rare pre-tokens are most
of any list, so a global list with its join back to the documents' frequencies moves more data than the texts hold (see
the README for figures). The list is emptied, and begun anew, beyond KEPT entries, so memory is bounded; a pre-token is
then counted again, which changes no result. One narrow pass, no shuffle: any skew between keys has no effect, and a lost
executor repeats only its own documents.

Nulls: a null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null. Repeated rows give repeated results.
An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, utf8

#: Entries of a task's list, bytes of text whose new pre-tokens are counted at once.
KEPT, AT_ONCE = 1_000_000, 4 << 20


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def n_pieces(words: list[str], path: str) -> list[int]:
    """Tokens of each word as the library encodes it, without added special tokens."""
    t = tokenizer(path)
    return [len(e) for i in range(0, len(words), 2000) for e in t.encode_batch_fast(words[i : i + 2000], add_special_tokens=False)]


def _counted(batches, vocabulary: str):
    known: dict[bytes, int] = {}
    for batch in batches:
        at, data = utf8(batch.column("text"))
        total = np.zeros(batch.num_rows, dtype=np.int64)
        for lo, hi in slices(at, AT_ONCE):
            freq = [Counter(data[at[k] : at[k + 1]].tobytes().split()) for k in range(lo, hi)]
            if len(known) > KEPT:
                known.clear()
            new = list({w for f in freq for w in f if w not in known})
            known.update(zip(new, n_pieces([w.decode() for w in new], vocabulary), strict=True))
            total[lo:hi] = [sum(known[w] * n for w, n in f.items()) for f in freq]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document's whole text.

    vocabulary: path of a tokenizers .json file whose pre-tokenizer never joins text over ASCII white space.
    """
    bounded(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(partial(_counted, vocabulary=vocabulary), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
