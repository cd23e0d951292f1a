"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``WINDOW`` consecutive words of every benchmark item; an item of
fewer words, but not none, is one window. Windows of equal length share tables: the last
``BLOCK`` words at the search position look up how far the search may jump; where they say
zero, their suffix bucket and the hash of the first words select the windows that may stand
here, and comparing all words confirms them.

Scale: documents are scanned where they lie, nothing of them is shuffled. The windows travel
to the workers in chunks of at most ``CHUNK_BYTES`` of text each; a benchmark above that takes
one pass over the documents per chunk, so memory does not grow with it.

Defined results: null and empty texts have no words; an item without words matches nothing; a
null item_id marks words but is not named; repeated items and rows count once each; an empty
benchmark marks nothing; further columns of either table play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, unwrap, whole_text, wrap

WINDOW = 10
BLOCK = 3
CHUNK_BYTES = 4 << 20

# Bytes of a word stay (A-Z in lower case), every other byte ends a word.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)

WINDOWS = T.StructType([T.StructField("window", T.BinaryType()), T.StructField("item_id", T.StringType())])
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; code points from U+0080 on are word characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> set[bytes]:
    """Distinct windows of an item, words joined by a blank."""
    if not words:
        return set()
    last = max(len(words) - width, 0)
    return {b" ".join(words[i : i + width]) for i in range(last + 1)}


class Tables:
    """Shift table and suffix buckets for windows of one length."""

    def __init__(self, length: int, block: int = BLOCK) -> None:
        self.length, self.block = length, min(block, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[int, list[tuple[list[bytes], list[str]]]]] = {}

    def add(self, words: list[bytes], items: list[str]) -> None:
        for end in range(self.block, self.length + 1):
            key = tuple(words[end - self.block : end])
            self.shift[key] = min(self.shift.get(key, self.jump), self.length - end)
        bucket = self.buckets.setdefault(tuple(words[-self.block :]), {})
        bucket.setdefault(hash(tuple(words[: self.block])), []).append((words, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """Start and items of every occurrence."""
        length, block, jump, shift = self.length, self.block, self.jump, self.shift
        end, n = length, len(words)
        while end <= n:
            tail = tuple(words[end - block : end])
            step = shift.get(tail, jump)
            if step:
                end += step
                continue
            start = end - length
            head = hash(tuple(words[start : start + block]))
            for pattern, items in self.buckets[tail].get(head, ()):
                if words[start:end] == pattern:
                    yield start, items
            end += 1


def build(rows: list[tuple[bytes, list[str]]]) -> list[Tables]:
    by_length: dict[int, Tables] = {}
    for window, items in rows:
        words = window.split(b" ")
        by_length.setdefault(len(words), Tables(len(words))).add(words, items)
    return list(by_length.values())


def union(spans: list[tuple[int, int]]) -> list[int]:
    """Merged spans as a flat list of starts and ends."""
    flat: list[int] = []
    for start, end in sorted(spans):
        if flat and start <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += [start, end]
    return flat


def scan(text: str | None, tables: list[Tables], spans: list[int], items: set[str]) -> tuple[int, list[int]]:
    """Words of the text and its hit spans, joined with those found before."""
    words = words_of(text)
    found = list(zip(spans[::2], spans[1::2]))
    for table in tables:
        for start, names in table.search(words):
            found.append((start, start + table.length))
            items.update(names)
    return len(words), union(found)


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """Distinct (window, item_id) of the benchmark."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (w, i)
                for i, text in zip(batch["item_id"], batch["text"])
                for w in windows_of(words_of(text), width)
            ]
            yield pd.DataFrame(rows, columns=["window", "item_id"])

    named = benchmark.select(F.col("item_id").cast("string").alias("item_id"), whole_text().alias("text"))
    return named.mapInPandas(cut, WINDOWS).distinct()


def searcher(patterns: Broadcast) -> Callable:
    """A search for one chunk of windows that adds to what earlier chunks have found."""

    def find(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        tables = build(patterns.value)
        for texts, found in batches:
            rows = []
            for text, spans, items in zip(texts, found["spans"], found["items"]):
                names = set(items)
                n, flat = scan(text, tables, list(spans), names)
                rows.append((n, flat, sorted(names)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return find


def mark(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The documents with ``_found``: n_words, spans of hit words (flat starts and ends), items."""
    spark = docs.sparkSession
    windows = settle(item_windows(benchmark, width))
    size = windows.agg(F.sum(F.length("window") + 16)).first()[0] or 0
    chunks = -(-size // chunk_bytes) or 1
    chunk = F.pmod(F.xxhash64("window", "item_id"), F.lit(chunks))
    empty = F.struct(
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<int>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    marked = docs.withColumn("_found", empty)
    for number in range(chunks):
        by_window: dict[bytes, list[str]] = {}
        for row in windows.where(chunk == number).collect():  # at most about chunk_bytes
            by_window.setdefault(bytes(row.window), []).extend([] if row.item_id is None else [row.item_id])
        search = searcher(spark.sparkContext.broadcast(sorted(by_window.items())))
        marked = marked.withColumn("_found", F.pandas_udf(search, FOUND)(whole_text(), F.col("_found")))
        if number + 1 < chunks:
            marked = settle(marked)
    return marked


def contaminated() -> Column:
    return F.size("_found.spans") > 0


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents in which no window of any item occurs, same columns."""
    marked = mark(wrap(docs, text=F.col("text")), benchmark, width)
    return unwrap(marked.where(~contaminated()), docs)


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, items with occurring windows and their digest."""
    spans = F.col("_found.spans")
    covered = F.aggregate(
        F.sequence(F.lit(0), (F.size(spans) / 2).cast("int") - 1), F.lit(0).cast("bigint"),
        lambda total, i: total + F.get(spans, (2 * i + 1).cast("int")) - F.get(spans, (2 * i).cast("int")),
    )
    return mark(docs.select("doc_id", "text"), benchmark, width).select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        F.when(F.size(spans) > 0, covered).otherwise(0).cast("bigint").alias("n_hit"),
        F.size("_found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_found.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
