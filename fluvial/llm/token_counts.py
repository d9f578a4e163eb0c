"""Token counts: texts are cut at white space, each different chunk is encoded once, and only lengths are summed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.llm.tokens import read_tokenizer, runs_of, safe_pieces, word_encoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, batch_bytes: int = 256 << 10, piece_bytes: int = 16 << 10) -> DataFrame:
    """One row per document: bytes of UTF-8, tokens, and whether tokens exceed limit.

    Texts are counted in runs of about batch_bytes, and a text beyond that in pieces, cut after white space at
    piece_bytes, so what a batch needs besides its texts doesn't depend on how long they are. The library encodes
    each different chunk between white space once in a worker (WordEncoder). Nothing is shuffled. Null and empty
    texts count 0; repeated rows give repeated results; a null doc_id stays null; other columns are ignored.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))  # a vocabulary file: fixed size

    def run(batches):
        encoder = word_encoder(spec.value)
        for batch in batches:
            texts = batch.column(1)
            sizes, counts = pc.binary_length(texts).fill_null(0).cast(pa.int64()), np.zeros(len(texts), np.int64)
            for a, b in runs_of(texts, batch_bytes):
                part = texts.slice(a, b - a)
                if b == a + 1 and sizes[a].as_py() > batch_bytes:
                    pieces = pa.array(safe_pieces(part[0].as_py(), piece_bytes), pa.string())
                    counts[a] = sum(int(encoder.count(pieces.slice(x, y - x)).sum()) for x, y in runs_of(pieces, batch_bytes))
                else:
                    counts[a:b] = encoder.count(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
