"""Line dedup by winnowing: later copies of repeated runs of lines and of repeated passages go.

A document is the sequence of its lines; a line of more than ``WRAP`` words counts as several,
wrapped every ``WRAP`` words, and blank lines do not count. Two kinds of runs are deleted where
they also start earlier (in a smaller doc_id, or earlier in the same document): ``RUN`` lines,
and ``PASSAGE`` words, wherever they stand in their lines. So is every longer run, as its
windows overlap.

Passages are found by winnowing. Each window of ``PASSAGE`` words selects the least of its
``GRAM``-word hashes as a fingerprint, so that equal windows always select equal fingerprints,
and neighbouring windows mostly select the same position: about one position per 17 words is
kept. Its context is all windows that selected it. Positions meet on fingerprints that occur
more than once. A context that also stands earlier is repeated as a whole. Where a fingerprint
has several contexts, the first of each is extended word by word: its windows are hashed one by
one, and a window that also starts earlier is repeated. That is exact: the earliest occurrence
of a window always lies in the first occurrence of its context. Runs of lines that hold
``PASSAGE`` words are passages; shorter ones meet on the hash of their lines.

Scale: hashes move, not texts, until the extension and the final cut. Fingerprints are counted
with map-side combining; positions of a popular fingerprint are never gathered or paired: the
earliest start of each context and window is a minimum, joined back.

Defined results: null and empty texts have no lines and stay; documents of fewer than ``RUN``
lines stay unless they repeat a passage; rows that repeat a doc_id and its text are one document
and are cut alike; other texts under that doc_id are ordered by their hash; null doc_ids come
last; an empty table gives no rows; further columns play no part. A removed word takes the blanks
behind it along, the last of a line the line's end, the first of a line the blanks before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, text_mark
from .neardup import scramble

RUN, WRAP = 3, 16
# Words of a passage, and of the hashes that select its fingerprint.
PASSAGE, GRAM = RUN * WRAP, 16
# Bytes of texts whose words are held at once.
CHUNK_BYTES = 1 << 20
LAST = 2**63 - 1
LOW = np.uint64(2**32 - 1)
ODD = np.random.default_rng(23).integers(1, 2**63, RUN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NEWLINE = 10
BLANK = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
# Powers of an odd number and of its inverse, for hashes that roll over the bytes.
BLOCK = 1 << 16
BYTES = scramble(np.arange(1, 257, dtype=np.uint64))
POWERS, INVERSES = (
    np.multiply.accumulate(np.array([1, *[x] * BLOCK], np.uint64)) for x in (int(ODD[0]), pow(int(ODD[0]), -1, 2**64))
)

PLACES = "d long, h long, fingerprint long, key long, start int, size int"
CUT = T.StructType([
    T.StructField("n_lines", T.LongType()),
    T.StructField("removed", T.ArrayType(T.IntegerType())),
    T.StructField("n_runs", T.LongType()),
    T.StructField("kept", T.BinaryType()),
])


class Words:
    """The words of some texts in a row, with the ends of texts and lines."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        blank = BLANK[data]
        before = np.append(True, blank)[:-1]
        starts = np.flatnonzero(~blank & before)
        ends = np.cumsum([len(text) + 1 for text in texts], dtype=np.int64)
        self.ends = np.append(0, np.searchsorted(starts, ends))
        self.edges = edges_of(np.diff(np.searchsorted(starts, np.flatnonzero(data == NEWLINE)), prepend=0))
        # Each word with one blank behind it.
        taken = ~(blank & before)
        self.bytes = np.where(blank, np.uint8(32), data)[taken]
        self.joined = self.bytes.tobytes()
        self.at = np.append(0, np.flatnonzero(blank[taken]) + 1)

    def __len__(self) -> int:
        return len(self.at) - 1

    def grams(self, size: int) -> np.ndarray:
        """Polynomial hashes of every ``size`` words; they choose, and prove nothing."""
        sums, shifts = np.zeros((2, len(self.at)), np.uint64)
        shifts[0], total, base, back = 1, 0, 1, 1
        for start in range(0, len(self.bytes), BLOCK):
            run = BYTES[self.bytes[start : start + BLOCK]] * POWERS[:BLOCK][: len(self.bytes) - start]
            np.cumsum(run, out=run)
            low, high = np.searchsorted(self.at, [start, start + BLOCK], side="right")
            inside = self.at[low:high] - start
            sums[low:high] = np.uint64(total) + np.uint64(base) * run[inside - 1]
            shifts[low:high] = np.uint64(back) * INVERSES[inside]
            total = (total + base * int(run[-1])) % 2**64
            base, back = base * int(POWERS[BLOCK]) % 2**64, back * int(INVERSES[BLOCK]) % 2**64
        return scramble((sums[size:] - sums[:-size]) * shifts[:-size])

    def hashes(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """64-bit hashes of runs of words."""
        spans = zip(self.at[starts].tolist(), (self.at[starts + sizes] - 1).tolist())
        return np.array([xxhash.xxh3_64_intdigest(self.joined[a:b]) for a, b in spans], np.uint64)

    def text_of(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the texts that words stand in."""
        return np.searchsorted(self.ends, words, side="right") - 1


def edges_of(count: np.ndarray, wrap: int = WRAP) -> np.ndarray:
    """First words of the (wrapped) lines, and the end of the last, from the words per line."""
    pieces = -(-count // wrap)
    inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.append(np.repeat(np.cumsum(count) - count, pieces) + wrap * inside, count.sum())


def spans_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the words, which tile all lines that are not blank, and words per line."""
    data = np.frombuffer(text, np.uint8)
    blank = BLANK[data]
    starts = np.flatnonzero(~blank & np.append(True, blank)[:-1])
    edges = np.concatenate([[0], np.flatnonzero(data == NEWLINE) + 1, [len(data)]])
    counts = np.diff(np.searchsorted(starts, edges))
    filled = np.flatnonzero(counts)
    counts = counts[filled]
    after = np.cumsum(counts)
    ends = np.append(starts[1:], len(data))
    ends[after - 1] = edges[filled + 1]
    starts[after - counts] = edges[filled]
    return starts, ends, counts


def lines_of(data: bytes) -> tuple[list[tuple[int, int]], list[int]]:
    """Byte spans and 64-bit hashes of the (wrapped) lines of a text."""
    words = Words([data])
    starts, ends, _ = spans_of(data)
    spans = zip(starts[words.edges[:-1]].tolist(), ends[words.edges[1:] - 1].tolist())
    return list(spans), words.hashes(words.edges[:-1], np.diff(words.edges)).tolist()


def runs_of(words: Words, below: int | None) -> tuple[np.ndarray, ...]:
    """(fingerprint, key, start, size) of every window of ``RUN`` lines of fewer words than ``below``."""
    n = max(len(words.edges) - RUN, 0)
    starts, sizes = words.edges[:n], words.edges[RUN : RUN + n] - words.edges[:n]
    taken = words.text_of(starts) == words.text_of(words.edges[RUN - 1 : RUN - 1 + n])
    if below is not None:
        taken &= sizes < below
    taken = np.flatnonzero(taken)
    pieces, place = np.unique(taken[:, None] + np.arange(RUN), return_inverse=True)
    h = scramble(words.hashes(words.edges[pieces], words.edges[pieces + 1] - words.edges[pieces]))
    key = scramble((h[place.reshape(-1, RUN)] * ODD).sum(axis=1, dtype=np.uint64))
    return key, key, starts[taken], sizes[taken]


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[: len(values) - step], values[step:])
        done += step
    return values


def passages_of(words: Words, passage: int) -> tuple[np.ndarray, ...]:
    """(fingerprint, key, start, size) of every selected position with its context."""
    n = len(words) - passage + 1
    starts = np.arange(max(n, 0))
    starts = starts[words.text_of(starts) == words.text_of(starts + passage - 1)]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), starts, starts
    gram = words.grams(GRAM)
    # Of equal hashes the last one, so that only what is in the window decides.
    order = (gram & ~LOW) | (LOW - np.arange(len(gram), dtype=np.uint64))
    chosen = (LOW - (least(order, passage - GRAM + 1)[starts] & LOW)).astype(np.int64)
    text = words.text_of(starts)
    new = np.append(True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(starts))) - 1 + passage
    return gram[chosen[first]], words.hashes(starts[first], sizes), starts[first], sizes


def chunks(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of a batch, about ``CHUNK_BYTES`` at a time."""
    sizes = batch["data"].map(len)
    for _, part in batch.groupby((sizes.cumsum() - sizes) // CHUNK_BYTES, sort=False):
        yield part


def placed(part: pd.DataFrame, words: Words, found: tuple[np.ndarray, ...]) -> pd.DataFrame:
    fingerprint, key, start, size = found
    text = words.text_of(start)
    return pd.DataFrame({
        "d": part["d"].to_numpy()[text], "h": part["h"].to_numpy()[text],
        "fingerprint": fingerprint.view(np.int64), "key": key.view(np.int64),
        "start": (start - words.ends[text]).astype(np.int32), "size": size.astype(np.int32),
    })


def winnow(docs: DataFrame, passage: int | None) -> DataFrame:
    """Windows of lines and selected positions of the documents."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part["data"].tolist())
                yield placed(part, words, runs_of(words, passage))
                if passage:
                    yield placed(part, words, passages_of(words, passage))

    return docs.mapInPandas(find, PLACES)


def spell(docs: DataFrame, passage: int) -> DataFrame:
    """Every window of ``passage`` words of the contexts in ``asked``."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part["data"].tolist())
                starts = [
                    np.arange(c["start"], c["start"] + c["size"] - passage + 1) + first
                    for asked, first in zip(part["asked"], words.ends)
                    for c in asked
                ]
                start = np.concatenate(starts)
                size = np.full(len(start), passage)
                key = words.hashes(start, size)
                yield placed(part, words, (key, key, start, size))

    return docs.mapInPandas(find, PLACES)


def later(met: DataFrame, first: DataFrame) -> DataFrame:
    """(d, h, start, size) of the places whose run also starts earlier."""
    known = met.join(settle(first.where("n > 1").select("fingerprint", "key", "first")), ["fingerprint", "key"])
    return known.where(F.struct("d", "h", "start") != F.col("first")).select("d", "h", "start", "size")


def firsts(met: DataFrame) -> DataFrame:
    return settle(met.groupBy("fingerprint", "key").agg(
        F.min(F.struct("d", "h", "start")).alias("first"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n")
    ))


def repeats(docs: DataFrame, passage: int | None) -> DataFrame:
    """(d, h, start, size): runs of words that also start earlier."""
    places = settle(winnow(docs, passage))
    # Settled, so that the joins may split a popular fingerprint: below an aggregate they could not.
    repeated = settle(places.groupBy("fingerprint").count().where("count > 1").select("fingerprint"))
    met = settle(places.join(repeated, "fingerprint"))
    first = firsts(met)
    found = later(met, first)
    if not passage:
        return found
    several = settle(first.groupBy("fingerprint").count().where("count > 1").select("fingerprint"))
    asked = (
        settle(first.join(several, "fingerprint").select("first.*", "size"))
        .groupBy("d", "h")
        .agg(F.collect_list(F.struct("start", "size")).alias("asked"))
    )
    spelled = settle(spell(docs.join(settle(asked), ["d", "h"]), passage))
    return found.unionByName(later(spelled, firsts(spelled)))


@F.pandas_udf(CUT)
def cut_lines(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    rows = []
    for data, found in zip(texts, runs):
        if found is None:
            counts = [len(line.split()) for line in data.split(b"\n")]
            rows.append((sum(-(-n // WRAP) for n in counts), [], 0, data))
            continue
        starts, ends, counts = spans_of(data)
        edges = edges_of(counts)
        change = np.zeros(len(starts) + 1, np.int64)
        run = np.array([(x["start"], x["start"] + x["size"]) for x in found])
        np.add.at(change, run[:, 0], 1)
        np.add.at(change, run[:, 1], -1)
        gone = np.append(False, np.cumsum(change[:-1]) > 0)
        n_runs = int((~gone[:-1] & gone[1:]).sum())
        # Blank lines between removed words stay.
        lost = np.flatnonzero(gone[1:])
        joint = starts[lost[1:]] == ends[lost[:-1]]
        cuts = zip(starts[lost[np.append(True, ~joint)]].tolist(), ends[lost[np.append(~joint, True)]].tolist())
        kept, at = [], 0
        for start, end in cuts:
            kept.append(data[at:start])
            at = end
        kept.append(data[at:])
        removed = np.flatnonzero(np.add.reduceat(gone[1:].astype(np.int64), edges[:-1]))
        rows.append((len(edges) - 1, removed.tolist(), n_runs, b"".join(kept)))
    return pd.DataFrame(rows, columns=["n_lines", "removed", "n_runs", "kept"])


def remove_repeats(docs: DataFrame, passage: int | None = PASSAGE) -> DataFrame:
    """(doc_id, n_lines, removed, n_runs, kept): numbers of the lines that lost words, runs of
    removed words, remaining bytes. Without ``passage`` runs of lines alone are removed."""
    rows = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(LAST)).alias("d"),
        text_mark().alias("h"),
        F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("data"),
    )
    found = settle(repeats(rows.drop("doc_id"), passage))
    runs = found.groupBy("d", "h").agg(F.collect_set(F.struct("start", "size")).alias("runs"))
    joined = rows.join(runs, ["d", "h"], "left")
    return joined.select("doc_id", cut_lines("data", "runs").alias("_c")).select("doc_id", "_c.*")


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """Runs of lines alone, without the passages that stand at other places of their lines."""
    return remove_repeats(docs, passage=None)


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: lines, lines that lost words, removed runs and the digest of what remains."""
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("bigint").alias("n_removed"),
        "n_runs",
        F.sha2("kept", 256).alias("kept_sha256"),
    )
