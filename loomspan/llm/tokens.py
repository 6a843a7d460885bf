"""Problem 7: the ids a public byte-level BPE tokenizer gives every text.

A first pass counts the words (pre-tokens) of all documents in the JVM, combined in the mappers; the LEXICON_WORDS most frequent are merged once and compiled into a minimal acyclic
transducer (lexicon.py).  That file is bounded by LEXICON_WORDS * LEXICON_WORD_BYTES, lies in the
shared checkpoint folder, and is memory-mapped by the workers.  The second pass, a narrow stage,
splits each text, looks its distinct words up in the transducer a batch at a time, merges the words
the transducer does not know exactly, and splices the ids with numpy.  Which words are in the
lexicon changes the speed only, never an id.

Defined results: empty and null texts give an empty list; names of special tokens are ordinary text;
no text is cut, and texts of any length are taken whole.  Repeated rows give repeated results.  Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import mmap
import os
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.process import once
from loomspan.llm import lexicon
from loomspan.runtime import ensure_checkpoint_dir, spread

#: Folder of the public tokenizers' files, and the vocabulary used.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words compiled into the transducer, and their greatest length in bytes.
LEXICON_WORDS = 32_768
LEXICON_WORD_BYTES = 48
#: Characters handled at once within a batch.
CHUNK_CHARS = 2_000_000

# The published pre-token pattern of the vocabulary, with white space spelled out.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

JVM_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact byte-pair merging: always the pair of lowest rank, the leftmost of equals.  A heap of
    candidate pairs over a linked list keeps long words at n log n."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, word[i : i + 2]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = right[i]
        if parts[i] is None or j >= n or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j] = pair, None
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get(both := pair + parts[k])) is not None:
                heapq.heappush(heap, (r, i, both))
        h = left[i]
        if h >= 0 and (r := ranks.get(both := parts[h] + pair)) is not None:
            heapq.heappush(heap, (r, h, both))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Splits and encodes batches of texts.  One per worker process."""

    def __init__(self, ranks: dict[bytes, int], words: lexicon.Lexicon):
        self.ranks, self.words, self.split = ranks, words, regex.compile(PATTERN).findall
        self.unseen: dict[str, list[int]] = {}

    def chunks(self, texts: list[str | None]) -> Iterator[list[str]]:
        """The texts in groups of about CHUNK_CHARS characters, null as empty."""
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(t or "")
            if size >= CHUNK_CHARS:
                yield group
                group, size = [], 0
        if group:
            yield group

    def words_of(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words, the word numbers of all texts in a row, and each text's count of words."""
        seen: dict[str, int] = defaultdict(count().__next__)
        rows, counts = array("q"), []
        for t in texts:
            found = self.split(t)
            counts.append(len(found))
            rows.extend(map(seen.__getitem__, found))
        return list(seen), np.frombuffer(rows, dtype=np.int64), np.array(counts, dtype=np.int64)

    def ids_of(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and flat ids of distinct words: from the transducer, else merged."""
        number = self.words.numbers([w.encode() for w in distinct])
        known = number >= 0
        starts, lengths = np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
        starts[known] = self.words.offsets[number[known]]
        lengths[known] = self.words.offsets[number[known] + 1] - self.words.offsets[number[known]]
        extra: list[int] = []
        if len(self.unseen) > 100_000:
            self.unseen.clear()
        base = len(self.words.ids)
        for i in np.flatnonzero(~known).tolist():
            w = distinct[i]
            ids = self.unseen.get(w)
            if ids is None:
                ids = merge(w.encode(), self.ranks)
                if len(w) <= 200:
                    self.unseen[w] = ids
            starts[i], lengths[i] = base + len(extra), len(ids)
            extra += ids
        return starts, lengths, np.concatenate([self.words.ids, np.array(extra, dtype=np.int32)]) if extra else self.words.ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's end in it."""
        distinct, rows, counts = self.words_of(texts)
        starts, lengths, flat = self.ids_of(distinct)
        per = lengths[rows]
        ends = np.cumsum(per)
        take = np.arange(per.sum()) + np.repeat(starts[rows] - (ends - per), per)
        closed = np.r_[0, ends][np.cumsum(counts)]
        return flat[take].astype(np.int32), closed

    def sizes(self, texts: list[str]) -> np.ndarray:
        distinct, rows, counts = self.words_of(texts)
        lengths = self.ids_of(distinct)[1]
        ends = np.r_[0, np.cumsum(lengths[rows])]
        stop = np.cumsum(counts)
        return ends[stop] - ends[stop - counts]


def word_counts(documents: DataFrame) -> DataFrame:
    """How often each word of at most LEXICON_WORD_BYTES occurs, over all documents.  Counted in the
    JVM; where its idea of a letter differs from the tokenizer's, only the choice of words does."""
    words = spread(documents.select("text")).select(F.explode(F.regexp_extract_all("text", F.lit(JVM_PATTERN), F.lit(0))).alias("word"))
    return words.where(F.octet_length("word") <= LEXICON_WORD_BYTES).groupBy("word").agg(F.count("*").alias("n"))


def compile_lexicon(documents: DataFrame, ranks: dict[bytes, int], words: int = LEXICON_WORDS) -> bytes:
    """The transducer of the most frequent words; its size is bounded by the parameters."""
    top = word_counts(documents).orderBy(F.desc("n"), "word").limit(words).select("word").collect()
    return lexicon.build((w, merge(w, ranks)) for w in (r["word"].encode() for r in top))


def _shared_file(spark: SparkSession, file: bytes) -> str:
    """The lexicon as a file in the shared checkpoint folder, named by its content, so that the same words
    are stored once; the path, as the workers see it where that folder is mounted."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/lexicon-{hashlib.sha256(file).hexdigest()}.bin")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        part = path.suffix(f".{os.urandom(6).hex()}")
        out = fs.create(part)
        out.write(bytearray(file))
        out.close()
        fs.rename(part, path)
    return path.toUri().getPath()


def _encoder(path: str, file: bytes, ranks: dict[bytes, int]) -> Encoder:
    """This process's encoder, one for each lexicon's content and only the last one kept.  The file is
    memory-mapped, shared by all workers of a machine; where the folder is not mounted, as with an object
    store, the broadcast copy is mapped into the worker's own memory."""

    def open_() -> Encoder:
        if os.path.exists(path) and os.path.getsize(path) == len(file):
            return Encoder(ranks, lexicon.Lexicon(path))
        own = mmap.mmap(-1, len(file))
        own.write(file)
        return Encoder(ranks, lexicon.Lexicon(own))

    return once(os.path.basename(path), open_, "lexicon-")


def _prepared(documents: DataFrame, vocabulary: str):
    """A function that gives the encoder inside a worker."""
    ranks = read_ranks(os.path.join(TOKENIZERS, vocabulary))
    file = compile_lexicon(documents, ranks)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((_shared_file(spark, file), file, ranks))
    return lambda: _encoder(*shared.value)


def encode(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """p7_ids: doc_id, ids."""
    encoder = _prepared(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for batch in batches:
            at = 0
            for texts in e.chunks(batch["text"].to_pylist()):
                ids, ends = e.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(texts)), lists], names=["doc_id", "ids"])
                at += len(texts)

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text: what the ids of (doc_id, ids) stand for.  A null list gives ''; an id the vocabulary
    does not have is an error."""
    ranks = read_ranks(os.path.join(TOKENIZERS, vocabulary))
    shared = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            texts = [b"".join(map(token, ids or ())).decode() for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, through the same transducer, without building the lists."""
    encoder = _prepared(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for batch in batches:
            sizes = [e.sizes(texts) for texts in e.chunks(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(sizes) if sizes else [], pa.int64())], names=["doc_id", "n_tokens"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def token_summary(documents: DataFrame) -> DataFrame:
    """Documents and tokens per language tag as written."""
    n = token_counts(documents)
    return n.join(documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("max_tokens"))
