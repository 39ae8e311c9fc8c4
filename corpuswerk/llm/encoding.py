"""Encoding of texts with a public byte-level tokenizer, and decoding.

Documents are spread over blocks by a hash of their row and of the partition they come from. Each block gives its distinct words once;
the words of all blocks are shuffled by word, so that each distinct word is encoded once (once per
WORD_BLOCKS blocks that hold it), and the ids go back to the blocks, where they are put together by
position. What is shuffled are the texts once and the vocabulary of each block, not every word. The
number of tasks follows the number of blocks, so that a task's share stays the same at any size.

A word is a stretch of text up to a blank that follows a visible character: there the tokenizer
always starts a new piece, so that the ids of the words, one after the other, are the ids of the
text. Runs of white space inside are kept within one word wherever their pieces depend on each
other.

Defined cases: null and empty texts get an empty list; special tokens in a text are ordinary text;
a text of any length is cut into words; repeated rows are encoded as they stand; a null doc_id is
kept; columns asked for with keep stand beside the result, others are ignored; an empty table gives
an empty result; decoding gives null for null ids and an empty text for none.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of the vocabulary's published tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A block holds about so many rows, or bytes of text if that makes more blocks.
BLOCK_ROWS = 2000
BLOCK_BYTES = 4_000_000
#: A word is encoded once for so many blocks that hold it.
WORD_BLOCKS = 50_000
#: Blocks of a task.
TASK_BLOCKS = 4
#: A blank between white space on either side: pieces there depend on the whole run.
ENTANGLED = re.compile(r"\s (?!\S)")
BEFORE_WORD = re.compile(r"(?<=\S)(?= )")


@cache
def _encoder(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def words(text: str) -> list[str]:
    """The words of a text, in order; joined they are the text."""
    if ENTANGLED.search(text):
        return BEFORE_WORD.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]


def _blocks(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> tuple[DataFrame, int]:
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    rows, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-rows // BLOCK_ROWS), -(-size // BLOCK_BYTES))
    # Copies of one row are spread by the partition they come from.
    key = F.xxhash64("doc_id", F.length("text"), F.spark_partition_id())
    return own.withColumn("block", F.pmod(key, F.lit(n)).cast("int")), n


def _vocabulary(table: pa.Table) -> pa.Table:
    found: set[str] = set()
    for text in table.column("text").to_pylist():
        if text:
            found.update(words(text))
    block = table.column("block")[0].as_py()
    return pa.table({"block": pa.array([block] * len(found), pa.int32()), "word": pa.array(list(found), pa.string())})


def _encode_sorted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, ids = _encoder(path).encode_ordinary, None, []
        for batch in batches:
            out = []
            for word in batch.column(1).to_pylist():
                if word != last:  # sorted by word: each is encoded once
                    last, ids = word, encode(word)
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["block", "word", "ids"])

    return run


def _assemble(docs: pa.Table, vocabulary: pa.Table) -> pa.Table:
    ids = dict(zip(vocabulary.column("word").to_pylist(), vocabulary.column("ids").to_pylist()))
    out = []
    for text in docs.column("text").to_pylist():
        row: list[int] = []
        if text:
            for w in words(text):
                row += ids[w]
        out.append(row)
    return _beside(docs, "ids", pa.array(out, pa.list_(pa.int32())))


def _beside(docs: pa.Table, name: str, values: pa.Array) -> pa.Table:
    kept = {c: docs.column(c) for c in docs.column_names if c.startswith("kept_")}
    return pa.table({"doc_id": docs.column("doc_id"), name: values} | kept)


def _count(docs: pa.Table, vocabulary: pa.Table) -> pa.Table:
    ids = dict(zip(vocabulary.column("word").to_pylist(), pc.list_value_length(vocabulary.column("ids")).to_pylist()))
    out = [sum(map(ids.__getitem__, words(text))) if text else 0 for text in docs.column("text").to_pylist()]
    return _beside(docs, "n_tokens", pa.array(out, pa.int64()))


def _put_together(docs: DataFrame, how, schema: str, id_col: str, text_col: str, path: str, keep: tuple[str, ...]) -> DataFrame:
    blocks, n = _blocks(docs, id_col, text_col, keep)
    tasks = max(1, -(-n // TASK_BLOCKS))
    blocks = blocks.repartition(tasks, "block")
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    # All columns are taken along, so that both uses of the blocks share one shuffle.
    found = blocks.groupBy("block").applyInArrow(_vocabulary, "block int, word string")
    salted = found.repartition(tasks, F.col("word"), F.pmod("block", F.lit(-(-n // WORD_BLOCKS)))).sortWithinPartitions("word")
    encoded = salted.mapInArrow(_encode_sorted(path), "block int, word string, ids array<int>").repartition(tasks, "block")
    schema = ", ".join([schema, *(f"kept_{c} {kinds[f'kept_{c}']}" for c in keep)])
    out = blocks.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(how, schema)
    return out.withColumnsRenamed({f"kept_{c}": c for c in keep})


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids) of every row, and the columns to keep."""
    return _put_together(docs, _assemble, "doc_id bigint, ids array<int>", id_col, text_col, path, keep)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens) of every row, and the columns to keep."""
    return _put_together(docs, _count, "doc_id bigint, n_tokens bigint", id_col, text_col, path, keep)


def token_bytes(spark, path: str = VOCABULARY) -> DataFrame:
    """(id, bytes) of the vocabulary, a file of fixed size."""
    lines = spark.read.text(path).select(F.split("value", " ").alias("v"))
    return lines.select(F.col("v")[1].cast("int").alias("id"), F.unbase64(F.col("v")[0]).alias("bytes"))


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): ids joined to the token-byte table and put together by position; one row a row."""
    # Lists that are equal are decoded once; rows meet their text by a digest of the list.
    digest = F.when(F.col("ids").isNotNull(), F.unhex(F.md5(F.array_join("ids", ","))))
    rows = encoded.select("doc_id", digest.alias("list"), "ids")
    each = rows.filter("list is not null").select("list", "ids").distinct().select("list", F.posexplode_outer("ids").alias("pos", "id"))
    each = each.join(F.broadcast(token_bytes(encoded.sparkSession, path)), "id", "left")  # a vocabulary file, of fixed size
    parts = F.sort_array(F.collect_list(F.struct("pos", F.hex("bytes").alias("h"))))
    texts = each.groupBy("list").agg(parts.alias("p")).select("list", F.decode(F.unhex(F.array_join("p.h", "")), "UTF-8").alias("text"))
    return rows.select("doc_id", "list").join(texts, "list", "left").select("doc_id", "text")
