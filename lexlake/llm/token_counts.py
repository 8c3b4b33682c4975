"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-tokens and their token counts, from the beginnings of a few rows, which the
driver reads and broadcasts (at most ``table_size`` entries). Tier two is a cache of each worker process for all other
pre-tokens, filled by the tokenizer's own library; it outlives the tasks. Neither texts nor pre-tokens are shuffled;
the sample decides speed only, never a count.

A null text counts as the empty text (0 bytes, 0 tokens). Repeated rows are counted each. An empty table gives no rows.
A null doc_id is kept as null. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_bytes, text_of
from .tokens import counter

SAMPLE_CHARS = 2_000


@functools.lru_cache(maxsize=2)
def pieces(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def frequent_pretokens(docs: DataFrame, data: bytes, table_size: int, sample_docs: int) -> dict[str, int]:
    """The commonest pre-tokens, with their token counts, of the beginnings (SAMPLE_CHARS) of the first ``sample_docs`` rows at hand.

    A limit without an order stops after as many partitions as it needs and moves nothing between tasks."""
    own, seen = counter(data), Counter()
    for r in docs.select(F.substring(text_of(), 1, SAMPLE_CHARS).alias("text")).limit(sample_docs).collect():
        for words in own.runs(r.text) or ():
            seen.update(words)
    words = [w for w, _ in seen.most_common(table_size)]
    return dict(zip(words, own.by_library(words)))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, table_size: int = 65_536, sample_docs: int = 2_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs`` (doc_id, text). ``tokenizer``: a .json or .model file."""
    spark = docs.sparkSession
    data, is_model = file_bytes(spark, tokenizer), tokenizer.endswith(".model")
    shipped = None if is_model else spark.sparkContext.broadcast(frequent_pretokens(docs, data.value, table_size, sample_docs))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if is_model:
            model = pieces(data.value)
            count = lambda text: len(model.encode(text, num_threads=1))
        else:
            count = functools.partial(counter(data.value), frequent=shipped.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(counts, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
