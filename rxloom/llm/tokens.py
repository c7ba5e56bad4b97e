"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

Distinct-word table: texts are split into words in Spark, each distinct word is encoded once, and
the ids are joined back by position. A word that makes up at least 1/FREQUENT of all occurrences is
joined by broadcast: there can be at most FREQUENT such words, whatever the corpus. Any other word
has fewer occurrences than that, so the shuffled join of the rest has no hot key. Documents are
shuffled once by doc_id; frequent words never are.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.session import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
FREQUENT = 1 << 15

#: Fixed value: the public pattern by which byte-level BPE splits a text into words.
SPLIT = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def words_of(text: Column) -> Column:
    """The words of a text in order; together they are the whole text."""
    return F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0))


def encode_words(words: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """word, n, ids of a table of distinct words (word, n)."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["ids"] = [e.ids for e in _tokenizer(path).encode_batch(batch["word"].tolist(), add_special_tokens=False)]
            yield batch

    return words.mapInPandas(encode, "word string, n long, ids array<int>")


class WordTable:
    """The distinct words of a corpus, each encoded once; written in the shared folder."""

    def __init__(self, spark: SparkSession, texts: DataFrame, path: str = TOKENIZER, frequent: int = FREQUENT):
        self.frequent = frequent
        words = texts.select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        self.table, _ = Scratch(spark).keep(encode_words(words, path))
        total = self.table.agg(F.sum("n")).first()[0] or 0
        #: At most ``frequent`` words occur at least this often.
        self.least = max(1, -(-total // frequent))

    def common(self) -> DataFrame:
        return self.table.where(F.col("n") >= self.least)

    def others(self) -> DataFrame:
        return self.table.where(F.col("n") < self.least)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, one row for each doc_id (of several the greatest text), without null ids."""
    return docs.where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))


def _joined(texts: DataFrame, table: WordTable, value: Column, gather) -> DataFrame:
    """doc_id, held: ``gather`` of (pos, value) over a document's words."""
    occurrences = texts.where("text is not null and text <> ''").select("doc_id", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    often = F.broadcast(table.common().select("word", value.alias("value")))
    known = occurrences.join(often, "word", "left")
    held = known.groupBy("doc_id").agg(gather("pos", "value").alias("held"))  # already partitioned by doc_id
    seldom = (
        known.where("value is null").select("doc_id", "pos", "word")
        .join(table.others().select("word", value.alias("value")), "word")
        .groupBy("doc_id").agg(gather("pos", "value").alias("also"))
    )
    return held.join(seldom, "doc_id", "left")


def encode(spark: SparkSession, docs: DataFrame, path: str = TOKENIZER, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, ids array<int>, without special tokens; an empty list for empty and null texts.

    A doc_id that comes several times is encoded once (its greatest text); extra columns are ignored.
    """
    texts, table = _texts(docs), WordTable(spark, docs.where("text <> ''"), path, frequent)
    pairs = lambda pos, value: F.collect_list(F.when(F.col(value).isNotNull(), F.struct(pos, value)))
    found = _joined(texts, table, F.col("ids"), pairs)
    ids = F.flatten(F.transform(F.sort_array(F.concat("held", F.coalesce("also", F.array().cast("array<struct<pos:int,value:array<int>>>")))), lambda p: p["value"]))
    none = texts.where("text is null or text = ''").select("doc_id", F.array().cast("array<int>").alias("ids"))
    return found.select("doc_id", ids.alias("ids")).unionByName(none)


def count_tokens(spark: SparkSession, docs: DataFrame, path: str = TOKENIZER, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, tokens: how many ids ``encode`` gives, without gathering them."""
    texts, table = _texts(docs), WordTable(spark, docs.where("text <> ''"), path, frequent)
    total = lambda pos, value: F.coalesce(F.sum(value), F.lit(0))
    found = _joined(texts, table, F.size("ids"), total)
    none = texts.where("text is null or text = ''").select("doc_id", F.lit(0).cast("long").alias("tokens"))
    return found.select("doc_id", (F.col("held") + F.coalesce("also", F.lit(0))).alias("tokens")).unionByName(none)


def pieces(spark: SparkSession, path: str = TOKENIZER) -> DataFrame:
    """id, piece: the bytes of each id of the vocabulary (its size is fixed)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in printable)}
    back = {c: b for b, c in shown.items()}
    rows = [(i, bytearray(back[c] for c in piece)) for piece, i in _tokenizer(path).get_vocab().items() if all(c in back for c in piece)]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode(spark: SparkSession, encoded: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, text of (doc_id, ids): ids are joined with their pieces, pieces put together in order."""
    one = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces(spark, path)), "id")
    whole = one.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("piece").alias("piece")))).alias("held"))
    text = F.decode(F.unhex(F.array_join(F.transform("held", lambda p: p["piece"]), "")), "UTF-8")
    return encoded.select("doc_id").join(whole, "doc_id", "left").select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
