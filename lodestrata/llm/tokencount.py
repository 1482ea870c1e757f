"""Token counts through a digest cache.

A text is normalised (runs of ASCII white space become one blank, none at the ends;
the tokenizer drops white space, so no count changes), digested with SHA-256, and
looked up by (text digest, tokenizer digest) in a stored table of counts. One text of
each digest that is missing is encoded and its count is appended to the table; then
every row gets its count by its digest. Where the cache holds anything for the
tokenizer, digests alone are held against it first, and only the texts of missing ones
move.

The digests of copies are brought together by a partial aggregation before the
shuffle, so a group of copies sends one row a partition; the way back is a plain join
that adaptive execution splits where a digest is hot. Null texts are empty texts with
no tokens; rows with equal doc_ids get a row each; very long texts are counted whole,
word by word; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import Scratch, narrowed, text_bytes, written

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: Distinct words, and distinct pieces of words, whose counts a task remembers; it forgets all of them beyond that.
MEMO = 150_000
#: Bytes of the longest word, and characters of the longest piece, worth remembering.
REMEMBERED = 64
#: Digests that are sent to all tasks; beyond these, texts and missing digests are brought together by a shuffle.
BROADCAST = 500_000


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class WordCounter:
    """Counts the tokens of whole texts with a tokenizer that drops white space and never joins words across it, so counts add up over words.

    A new word of ASCII signs and Latin letters, whose case and classes no Unicode
    version disputes, is cut as the tokenizer's file says and its pieces go straight to
    the tokenizer's merges; any other new word, or one with a special string, goes
    through the whole tokenizer.
    """

    plain = re.compile("[!-~À-ÖØ-öø-įı-ɏ]+").fullmatch
    # The file's split pattern for such words.
    cut = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ɏⱥⱦ]+|[0-9]|[^a-z0-9À-ÖØ-öø-ɏⱥⱦ]+").findall

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), memo
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[bytes, int] = {}
        self.pieces: dict[str, int] = {}
        # Byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}

    def _piece(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            if len(self.pieces) >= self.memo:
                self.pieces.clear()
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
            n = len(self.model.tokenize(shown))
            if len(piece) <= REMEMBERED:
                self.pieces[piece] = n
        return n

    def _word(self, word: str) -> int:
        if self.plain(word) and not any(s in word for s in self.special):
            return sum(map(self._piece, self.cut(word.lower())))
        return len(self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids)

    def __call__(self, texts: Iterable[bytes]) -> list[int]:
        out, known = [], self.words
        for t in texts:
            n = 0
            for w in t.split():
                k = known.get(w)
                if k is None:
                    if len(known) >= self.memo:
                        known.clear()
                    k = self._word(w.decode())
                    if len(w) <= REMEMBERED:
                        known[w] = k
                n += k
            out.append(n)
        return out


def _normalised(text):
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


class TokenCache:
    """The stored counts: an append-only Parquet folder that runs share.

    A failed append leaves uncommitted files that no reader sees; two runs that append
    the same digest leave two equal rows, which reading folds into one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], CACHE_SCHEMA)
        return self.spark.read.schema(CACHE_SCHEMA).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        rows.select("digest", "tokenizer", "n_tokens").write.mode("append").parquet(self.path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache: TokenCache, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; encodes only what the cache lacks, and appends it."""
    version = tokenizer_digest(tokenizer_path)
    rows = narrowed(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("norm", _normalised(F.col("text"))).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    known = cache.read().where(F.col("tokenizer") == version).select("digest", "n_tokens")
    scratch = Scratch(docs.sparkSession)
    if known.isEmpty():
        misses = rows.groupBy("digest").agg(F.first("norm").alias("norm"))
    else:
        missing = scratch.written(rows.select("digest").distinct().join(known.select("digest"), "digest", "left_anti"), "token-misses")
        if missing.count() <= BROADCAST:  # 32 bytes each
            misses = rows.join(F.broadcast(missing), "digest", "left_semi").groupBy("digest").agg(F.first("norm").alias("norm"))
        else:  # one text of each digest a partition, so copies of a text don't meet in one task
            misses = rows.groupBy("digest").agg(F.first("norm").alias("norm")).join(missing, "digest", "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = WordCounter(tokenizer_path)
        for b in batches:
            n = count(text_bytes(b.column("norm")))
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    with scratch:
        cache.append(misses.mapInArrow(encode, CACHE_SCHEMA))
    # Written, so that the join below has a plain exchange on either side and a hot digest's rows can be split.
    counts = written(cache.read().where(F.col("tokenizer") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens")), "token-counts")
    light = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return light.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
