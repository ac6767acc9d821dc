"""What the operators share: input columns, scratch tables, word splitting, an encoder of words."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from struct import pack

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.runtime import work_dir
from millrace.sources.tables import table

WHITE = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def id_and_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the text as UTF-8 bytes; every other column, whatever its name, is left out.

    A null text is null here; operators say what they make of it.
    """
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WHITE)), F.lit(0)).cast("long")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file, which every executor has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Scratch:
    """Tables below the folder that the cluster shares, written so that a lost executor costs
    a task and not the lineage.  ``drop`` removes a table that a later one has replaced."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.root, self.paths = spark, work_dir(spark, purpose), {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        if path := self.paths.pop(name, None):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor, shift), so that sums of products spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of any span of a sequence of 64-bit symbols, from prefix sums of a polynomial
    modulo 2^64 with an odd base, whose powers have inverses."""

    BASE = 0x9E3779B97F4A7C15
    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    def __init__(self, symbols: np.ndarray):
        self.reach(len(symbols))
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.powers[: len(symbols)], out=self.sums[1:])

    @classmethod
    def reach(cls, n: int) -> None:
        if n >= len(cls.powers):
            size = 1 << (n + 1).bit_length()
            for name, base in (("powers", cls.BASE), ("inverse", pow(cls.BASE, -1, 1 << 64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(cls, name, np.cumprod(factors))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


# Latin letters that have one form only, then ASCII marks that the tokenizer keeps in one piece.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*]*)")


class WordEncoder:
    """Token ids of texts by a byte-level tokenizer with word ends that lowers letters, drops white
    space and never joins over it, nor over the border between letters and marks.

    Words between blanks are encoded once and remembered as little-endian unsigned 32-bit
    ids; ``most`` bounds the memory.  Splitting at blanks and line ends alone is exact, since
    other white space stays inside a word and is seen by the tokenizer.  A new word of Latin
    letters and marks is made from its lowered letters and its marks, so that ``Word,`` and
    ``word`` share the work, and skips the tokenizer's patterns; all others take the whole way.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        letters = [chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha()]
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.as_bytes = str.maketrans({c: split(c)[0][0] for c in letters})

    def __call__(self, text: str) -> bytes:
        words = re.sub("[\n\t\r]", " ", text).split(" ")
        try:
            return b"".join([self.known[w] for w in words])
        except KeyError:
            if len(self.known) > self.most:
                self.known.clear()
            for w in dict.fromkeys(words):
                if w not in self.known:
                    self.known[w] = self._new(w)
            return b"".join([self.known[w] for w in words])

    def _new(self, word: str) -> bytes:
        if not (simple := SIMPLE.fullmatch(word)):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            return pack(f"<{len(ids)}I", *ids)
        letters, marks = simple[1].lower(), simple[2]
        if (found := self.known.get(letters)) is None:
            ids = [t.id for t in self.tokenizer.model.tokenize(letters.translate(self.as_bytes))]
            found = self.known[letters] = pack(f"<{len(ids)}I", *ids)
        if not marks:
            return found
        if (ending := self.known.get(marks)) is None:
            ids = self.tokenizer.encode(marks, add_special_tokens=False).ids
            ending = self.known[marks] = pack(f"<{len(ids)}I", *ids)
        return found + ending


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, so that words are remembered from task to task."""
    return WordEncoder(path)
