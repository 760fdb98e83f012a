"""Best-fit packing of tokenised documents into sequences, by exact complements over the lengths.

Documents are tokenised and cut into pieces in tasks. The plan needs only how many pieces have each
length, a table of at most `capacity` rows: the driver takes lengths from long to short and fills each
gap exactly with one, two or three other lengths, as often as their counts allow; what remains is put by best
fit, still by counts. The plan is a list of slots (a length, a range of ranks, a sequence, an offset)
whose size depends on the capacity, not on the corpus. Pieces get their rank among equal lengths by
distributed counts, and find their slot by rank.

Defined cases: null and empty texts are the end token alone; a text is cut only if it is longer than a
sequence; repeated rows are packed as often as they occur; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import common

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Ranks within a length are counted in so many buckets, so that no length is hot.
RANK_BUCKETS = 256
#: Parts of words whose ids a worker keeps; others are encoded again in each batch.
KEPT_PARTS = 500_000
#: Words of these letters alone are parted from the signs after them; lower-casing keeps each of them one letter.
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+$"
#: Signs that may follow a word's letters; no apostrophe, which the tokenizer treats by what follows.
SIGNS = ".,;:!?*#&%$|"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts. The tokenizer never merges across white space, nor from letters to signs, so the distinct
    words of a batch are parted into letters and the signs after them, and only parts not met before are encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts, many encoded in one text: letters or signs alone are one piece that ends one word."""
        found: dict[str, bytes] = {}
        plain = [p for p in parts if p.isalpha() or not p.strip(SIGNS)]
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                raw, last = ids.tobytes(), 0
                for p, end in zip(some, (4 * ends).tolist(), strict=True):
                    found[p] = raw[last:end]
                    last = end
        rest = [p for p in parts if p not in found]
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            found[p] = array("I", e.ids).tobytes()
        return found

    def table(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, where each part's begin and the last one's end) of distinct parts."""
        names, known = parts.to_pylist(), self.known
        new = self.learn([p for p in names if p not in known])
        raw = [known[p] if p in known else new[p] for p in names]
        if len(known) < KEPT_PARTS:
            known.update(new)
        ends = np.cumsum([0, *map(len, raw)]) // 4
        return np.frombuffer(b"".join(raw), "<u4"), ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each text's first place and the end), the end id after each text."""
        codes, words, first = common.coded_words(texts)
        core = pc.utf8_rtrim(words, characters=SIGNS)
        parted = pc.match_substring_regex(core, LETTERS)
        core = pc.if_else(parted, pc.utf8_lower(core), words)
        sign = pc.if_else(parted, pc.replace_substring_regex(words, LETTERS[:-1], ""), "")
        core, sign = core.dictionary_encode(), sign.dictionary_encode()
        flat, at = zip(*(self.table(x.dictionary) for x in (core, sign)), strict=True)
        pair = np.stack([x.indices.to_numpy() + shift for x, shift in ((core, 0), (sign, len(core.dictionary)))], 1).ravel()
        both = np.concatenate(flat)
        starts = np.concatenate((at[0][:-1], at[1][:-1] + len(flat[0])))
        sizes = np.concatenate((np.diff(at[0]), np.diff(at[1])))
        word_ids = _gathered(both, starts[pair], sizes[pair])
        word_sizes = sizes[pair].reshape(-1, 2).sum(1)
        # the end id is one more word
        word_sizes = np.append(word_sizes, 1)
        word_starts = np.cumsum(word_sizes) - word_sizes
        codes = np.insert(codes, first[1:], len(word_sizes) - 1)
        ids = _gathered(np.append(word_ids, np.uint32(END_ID)).astype("<u4"), word_starts[codes], word_sizes[codes])
        places = np.concatenate(([0], np.cumsum(word_sizes[codes])))
        return ids, places[first + np.arange(len(first))]


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after another."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


_encoders: dict[str, WordEncoder] = {}

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    path = path or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        for batch in batches:
            out = []
            ids, places = encoder.encode(batch.column("text"))
            raw = memoryview(ids.tobytes())
            for doc, first, end in zip(batch.column("doc_id").to_pylist(), places.tolist(), places[1:].tolist()):
                for k, at in enumerate(range(first, end, capacity)):
                    to = min(end, at + capacity)
                    out.append((doc, k, at - first, to - at, zlib.crc32(raw[4 * at : 4 * to])))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    common.python_ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, times), ...] and how many sequences have each, for counts of pieces by length."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    done: list[tuple[list[tuple[int, int]], int]] = []

    def use(*parts: int) -> None:
        lengths, times = np.unique(parts, return_counts=True)
        n = int((have[lengths] // times).min())
        have[lengths] -= n * times
        done.append(([(int(x), int(t)) for x, t in sorted(zip(lengths, times), reverse=True)], n))

    def two(gap: int, top: int) -> tuple[int, int] | None:
        """Two lengths, the first at most top, that add up to gap; the longest first one."""
        a = np.arange(min(gap - 1, top), (gap - 1) // 2, -1)
        ok = np.where(2 * a == gap, have[a] >= 2, (have[a] > 0) & (have[gap - a] > 0)) if len(a) else a
        return (int(a[ok.argmax()]), int(gap - a[ok.argmax()])) if len(a) and ok.any() else None

    for longest in range(capacity, 0, -1):
        while have[longest] > 0:
            gap = capacity - longest
            have[longest] -= 1  # the search is for what fits beside one of them
            found: tuple[int, ...] | None = None
            if gap == 0:
                found = ()
            elif gap <= longest and have[gap] > 0:
                found = (gap,)
            elif pair := two(gap, longest):
                found = pair
            else:
                for a in range(min(gap - 2, longest), (gap + 2) // 3 - 1, -1):
                    if have[a] > 0:
                        have[a] -= 1
                        pair = two(gap - a, a)
                        have[a] += 1
                        if pair:
                            found = (a, *pair)
                            break
            have[longest] += 1
            if found is None:
                break
            use(longest, *found)
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    gaps: list[int] = []

    def put(pattern: list[tuple[int, int]], n: int, gap: int) -> None:
        if gap not in open_:
            bisect.insort(gaps, gap)
            open_[gap] = []
        open_[gap].append((pattern, n))

    for length in range(capacity, 0, -1):
        n = int(have[length])
        while n:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                pattern, m = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
                each = min(gap // length, n)  # best fit goes on filling the sequence it has made tighter
                k = min(m, n // each)
                put([*pattern, (length, each)], k, gap - each * length)
                if m > k:
                    put(pattern, m - k, gap)
                n -= k * each
            else:
                each = min(capacity // length, n)
                k = n // each
                put([(length, each)], k, capacity - each * length)
                n -= k * each
    return done + [x for group in open_.values() for x in group]


def slots(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """A row for each part of each pattern: length, first rank, times, first sequence, first offset."""
    rows, used, sequence = [], {}, 0
    for pattern, n in patterns:
        offset = 0
        for length, times in pattern:
            first = used.get(length, 0)
            rows.append((length, first, times, sequence, offset))
            used[length] = first + n * times
            offset += length * times
        sequence += n
    rows.sort()
    return dict(zip(("length", "first", "times", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


@common.tidy("packed")
def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    spark = docs.sparkSession
    cut = pieces(docs, path, capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_BUCKETS)))
    cut = common.written(cut, "pieces")
    cells = common.written(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    in_length = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(in_length), F.lit(0))).drop("n")
    in_cell = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.join(cells, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(in_cell) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = table.value
        starts = (s["length"] << 48) + s["first"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(starts, (length << 48) + rank, "right") - 1
            nth, times = rank - s["first"][at], s["times"][at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(s["sequence"][at] + nth // times), pa.array(s["offset"][at] + nth % times * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return columns.mapInArrow(place, PIECES + ", sequence_id bigint, offset bigint")
