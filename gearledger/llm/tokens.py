"""Token ids as binary files: encode, compress by Huffman code, write in order, read back.

Texts are encoded with a public tokenizer and closed with an end id. The ids' global counts
give one canonical Huffman code. A file row is a segment: consecutive documents in ascending
doc_id, their bit stream, and a checkpoint (bit offset) every ``BLOCK`` tokens, so that blocks
decode on their own, side by side, through one table.

Scale: each text is encoded once, where it lies; equal words are encoded once per worker and
batch. Counts have one row per id of the vocabulary, which bounds what the driver and the
broadcast code hold. What moves is the compressed stream, once, by doc_id range; no task holds
more than a segment. Positions before a document come from per-file sums.

Defined results: null is the empty text, which has the end id only; null doc_ids come last;
rows that repeat a doc_id stand next to each other, each with its own place; an empty table
gives no files; further columns play no part.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_path
from .common import whole_text
from .huffman import BLOCK, LIMIT, Code

END_ID = 2
SEGMENT_BYTES = 2 << 20
# Parts for the rows of one popular id, or of none.
SPLITS = 32
VERSION, CODE = 1, "version int, longest int, block int, lengths binary"
# Words a worker remembers, the longest of them, and how many are encoded in one call.
REMEMBERED, LONG_WORD, TOGETHER = 150_000, 64, 2000

# A blank between two visible characters always begins a token, so texts may be cut there.
CUT = re.compile(r"(?<=\S)(?= \S)")
SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
UNEVEN = [" " + s for s in SPACES] + [s + " " for s in SPACES if s != " "]
UNEVEN_ASCII = [pair for pair in UNEVEN if pair.isascii()]

SEGMENT = (
    "part int, segment int, before long, doc_ids binary, missing binary, sizes array<int>, "
    "stream binary, checkpoints binary"
)


STORED = ("before", "doc_ids", "missing", "sizes", "stream", "checkpoints")


def blank_begins_token(vocabulary: str) -> bool:
    """Whether the tokenizer is of the kind whose texts may be cut at blanks."""
    config = json.loads(vocabulary)
    kind = config.get("pre_tokenizer") or {}
    plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
    return bool(plain and not config.get("normalizer"))


def id_kind(vocabulary: str) -> str:
    """The integer type that holds every id of a vocabulary."""
    config = json.loads(vocabulary)
    added = [token["id"] for token in config.get("added_tokens", [])]
    return "<u2" if max([END_ID, len(config["model"]["vocab"]), *added]) < 1 << 16 else "<u4"


class Encoder:
    """A tokenizer that encodes a word it has seen from memory."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.kind = id_kind(vocabulary)
        self.cuts = blank_begins_token(vocabulary)
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if len(line_end) == 1 else None
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def learn(self, memory: dict[str, bytes], words: set[str], prefix: str) -> list[str]:
        """Put all words into memory; those that may not stay there.

        Frequent words come early, so the first ones stay and later ones are encoded anew.
        """
        fresh, room = words.difference(memory), max(REMEMBERED - len(memory), 0)
        # A full stop or comma after letters is a token of its own, so the letters are enough.
        marked = {w for w in fresh if w[-1:] in (".", ",") and w[:-1].isalpha() and max(w) < "\u0250"}
        stems = {w[:-1] for w in marked}.difference(memory)
        # Words that hold other white space are no lines; they go one by one at the end.
        plain = sorted(fresh - marked | stems, key=lambda w: w.split() != [w])
        memory.update(zip(plain, self.encode_words(plain, prefix)))
        for mark in ".,":
            if mark not in self.marks:
                self.marks[mark] = self.whole(mark)
        memory.update((w, memory[w[:-1]] + self.marks[w[-1]]) for w in marked)
        learned = [*plain, *marked]
        return learned[room:] + [w for w in learned[:room] if len(w) > LONG_WORD]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode_words(self, words: list[str], prefix: str) -> Iterator[bytes]:
        """Ids of each word; with a blank before them many are encoded as the lines of one text."""
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            if prefix and self.line_end is not None and all(w.split() == [w] for w in some):
                ids = np.array(self.tokenizer.encode("\n".join(prefix + w for w in some), add_special_tokens=False).ids, self.kind)
                ends = np.flatnonzero(ids == self.line_end)
                edges = zip((0, *(ends + 1).tolist()), (*ends.tolist(), len(ids)))
                yield from (ids[a:b].tobytes() for a, b in edges)
            else:
                done = self.tokenizer.encode_batch([prefix + w for w in some], add_special_tokens=False)
                yield from (np.array(e.ids, self.kind).tobytes() for e in done)

    def encode(self, texts: list[str], end_id: int = END_ID) -> list[bytes]:
        """Ids of each text and the end id, as packed integers."""
        end = np.array([end_id], self.kind).tobytes()
        if not self.cuts:
            done = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [np.array(e.ids, self.kind).tobytes() + end for e in done]
        cut = []
        for text in texts:
            if any(pair in text for pair in (UNEVEN_ASCII if text.isascii() else UNEVEN)):
                parts = CUT.split(text)
                parts = [parts[0], *[p[1:] for p in parts[1:]]]
            else:
                parts = text.split(" ")
            cut.append(parts)
        heads, words = {p[0] for p in cut}, set()
        for parts in cut:
            words.update(parts[1:])
        start, later = self.first, self.later
        long_heads, long_words = self.learn(start, heads, ""), self.learn(later, words, " ")
        found = later.__getitem__
        out = [b"".join((start[p[0]], *map(found, p[1:]), end)) for p in cut]
        for memory, words in ((start, long_heads), (later, long_words)):
            for word in words:
                del memory[word]
        return out


ENCODERS: dict[int, Encoder] = {}


def encoder(vocabulary: Broadcast) -> Encoder:
    """One encoder per worker and vocabulary."""
    key = zlib.crc32(vocabulary.value.encode())
    if key not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[key] = Encoder(vocabulary.value)
    return ENCODERS[key]


def forget() -> None:
    """Drop the worker's encoder: what comes after encoding runs in the same workers."""
    ENCODERS.clear()


def encode_texts(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids) written once, ids as packed integers."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf(T.BinaryType())
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(shared)
        for texts in batches:
            yield pd.Series(own.encode(texts.tolist(), end_id), dtype=object)

    path = new_path(spark, "ids")
    encoded = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), encode(whole_text()).alias("ids"))
    encoded.write.option("compression", "zstd").parquet(path)
    return spark.read.schema("doc_id long, ids binary").parquet(path)


def count_ids(encoded: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur and how often; at most the vocabulary's size."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch["ids"]), kind))
            if len(found) > len(total):
                found[: len(total)] += total
                total = found
            else:
                total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pd.DataFrame({"id": ids, "n": total[ids]})

    rows = encoded.select("ids").mapInPandas(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    table = rows.toPandas().sort_values("id")
    return table["id"].to_numpy(np.int64), table["n"].to_numpy(np.int64)


def range_bounds(encoded: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending doc_ids that cut the rows into about equal parts, and those that fill several; reads one column."""
    cuts = [i / parts for i in range(1, parts)]
    found = encoded.agg(F.percentile_approx("doc_id", cuts, 10 * parts)).first()[0] if cuts else None
    bounds, times = np.unique(np.array(found or [], np.int64), return_counts=True)
    return bounds, bounds[times > 1]


def compress(encoded: DataFrame, code: Broadcast, kind: str, bounds: np.ndarray, repeated: np.ndarray) -> DataFrame:
    """(part, doc_id, missing, size, stream, checkpoints) per document.

    A null doc_id is 0 and missing, and in parts after all others. Rows without an id, and those
    of an id that fills several ranges, are spread over ``SPLITS`` parts.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        own = code.value
        for batch in batches:
            ids = np.frombuffer(b"".join(batch["ids"]), kind).astype(np.int64)
            sizes = batch["ids"].map(len).to_numpy(np.int64) // np.dtype(kind).itemsize
            stream, lengths, marks = own.encode(ids, sizes)
            ends, blocks = np.cumsum(lengths), np.cumsum(-(-sizes // BLOCK))
            marks = marks.astype("<u4")
            doc_ids, missing = batch["doc_id"].to_numpy(np.int64), batch["missing"].to_numpy(bool)
            part = np.where(missing, len(bounds) + 1, np.searchsorted(bounds, doc_ids, side="right"))
            # A popular id is the least of its range: its rows fill places before the others'.
            spread = np.array([zlib.crc32(stream[e - n : e]) % SPLITS for e, n in zip(ends, lengths)], np.int64)
            popular = missing | np.isin(doc_ids, repeated)
            yield pd.DataFrame({
                "part": part * (SPLITS + 1) + np.where(popular, spread, SPLITS),
                "doc_id": batch["doc_id"], "missing": batch["missing"],
                "size": sizes,
                "stream": [stream[e - n : e] for e, n in zip(ends, lengths)],
                "checkpoints": [m.tobytes() for m in np.split(marks, blocks[:-1])],
            })

    named = encoded.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("missing"), "ids")
    return named.mapInPandas(pack, "part int, doc_id long, missing boolean, size int, stream binary, checkpoints binary")


def segments(rows: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Rows in order, put together to segments."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        number = before = 0

        def flush() -> pd.DataFrame:
            nonlocal held, number, before
            offset, marks = 0, []
            for row in held:
                marks.append(np.frombuffer(row["checkpoints"], "<u4").astype("<u8") + 8 * offset)
                offset += len(row["stream"])
            sizes = [row["size"] for row in held]
            out = {
                "part": held[0]["part"], "segment": number, "before": before,
                "doc_ids": np.array([row["doc_id"] for row in held], "<i8").tobytes(),
                "missing": np.array([row["missing"] for row in held], bool).tobytes(),
                "sizes": sizes, "stream": b"".join(row["stream"] for row in held),
                "checkpoints": np.concatenate(marks).tobytes(),
            }
            number, before, held = number + 1, before + sum(sizes), []
            return pd.DataFrame([out])

        size, last = 0, None
        for batch in batches:
            for row in batch.to_dict("records"):
                if held and held[0]["part"] != row["part"]:
                    yield flush()
                    number = before = size = 0
                elif number and last != row["part"]:
                    number = before = 0
                last = row["part"]
                held.append(row)
                size += len(row["stream"])
                if size >= segment_bytes:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return rows.mapInPandas(join, SEGMENT)


def write_code(spark: SparkSession, code: Code, path: str) -> None:
    """The code beside the segments: format version, longest code, block and the length per id, one byte each."""
    row = (VERSION, LIMIT, BLOCK, code.lengths.astype(np.uint8).tobytes())
    spark.createDataFrame([row], CODE).coalesce(1).write.parquet(f"{path}/code")


def read_code(spark: SparkSession, path: str) -> Code:
    """The code that the files under ``path`` were written with."""
    row = spark.read.schema(CODE).parquet(f"{path}/code").first()
    if row is None or (row["version"], row["longest"], row["block"]) != (VERSION, LIMIT, BLOCK):
        raise ValueError(f"no code of version {VERSION} under {path}")
    return Code(np.frombuffer(row["lengths"], np.uint8).astype(np.int64))


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID) -> None:
    """Write the documents' ids in ascending doc_id, and the code that reads them, under ``path``."""
    spark = docs.sparkSession
    text = Path(vocabulary).read_text()
    encoded, kind = encode_texts(docs, text, end_id), id_kind(text)
    code = Code.of(*count_ids(encoded, kind))
    write_code(spark, code, path)
    # Several parts per task, so that those that meet in one by their hash even out.
    bounds, repeated = range_bounds(encoded, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = compress(encoded, spark.sparkContext.broadcast(code), kind, bounds, repeated)
    dealt = packed.repartition("part").sortWithinPartitions("part", "doc_id", "size", "stream")
    segments(dealt).write.parquet(f"{path}/segments")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files under a path.

    The ids themselves may stay out, their checksum is of them all the same. Segments are decoded where they are read: only the places of the parts travel.
    """
    code = read_code(spark, path)
    stored = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    parts = stored.groupBy("part").agg(
        F.max(F.col("before") + F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("_n")
    )
    # One row per part: their number comes from the settings, not from the table.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("offset"))
    placed = stored.join(F.broadcast(offsets), "part").withColumn("before", F.col("before") + F.col("offset"))
    shared = spark.sparkContext.broadcast(code)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        own = shared.value
        for batch in batches:
            for before, doc_ids, missing, sizes, stream, marks in zip(*(batch[c] for c in STORED)):
                sizes = np.asarray(sizes, np.int64)
                blocks = -(-sizes // BLOCK)
                in_block = np.full(int(blocks.sum()), BLOCK)
                in_block[np.cumsum(blocks) - 1] = sizes - BLOCK * (blocks - 1)
                ids = own.decode(stream, np.frombuffer(marks, "<u8"), in_block).astype("<u4")
                ends = np.cumsum(sizes)
                parts = [ids[e - n : e].tobytes() for e, n in zip(ends, sizes)]
                rows = {
                    "doc_id": np.frombuffer(doc_ids, "<i8"),
                    "missing": np.frombuffer(missing, bool),
                    "start": before + ends - sizes,
                    "n_tokens": sizes,
                    "ids_crc32": [zlib.crc32(p) for p in parts],
                }
                yield pd.DataFrame(rows | {"ids": parts} if with_ids else rows)

    schema = "doc_id long, missing boolean, start long, n_tokens long, ids_crc32 long"
    found = placed.select(*STORED).mapInPandas(decode, schema + ", ids binary" if with_ids else schema)
    return found.withColumn("doc_id", F.when(~F.col("missing"), F.col("doc_id"))).drop("missing")


def token_report(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Per document, read from the files: ids before it, its ids and their checksum."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_token_files(docs.select("doc_id", "text"), vocabulary, path, end_id)
    return read_token_files(spark, path, with_ids=False)
