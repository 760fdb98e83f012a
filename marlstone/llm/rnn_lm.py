"""LM scoring with a gated recurrent language model in numpy.

The output softmax is factored by class: P(word) = P(class | state) * P(word | class, state). The end token is a class
of its own; other words fall into classes by their last two letters. The most frequent words of a class have input and
output vectors of their own; its other words share one place, whose probability depends on the state too and is dealt
to them by smoothed counts, with a place for unknown words, so the probabilities of all words add up to one.

Counts cover every training document. The weights are trained by truncated backpropagation with the state carried on
through each document: documents are dealt by hash into shards of a like number of tokens, so shards grow in number with
the corpus; one shard gives all a common start, then every shard is learnt from that start and their weights are
averaged, so each training document is learnt, whatever the partitions. Scoring carries the state through each whole document.

Texts are read twice: for the counts, and to code the words as numbers, which training and scoring read. The TOP_WORDS
most frequent words at most are broadcast; the counts of other words reach the documents by a join.

Defined cases: null and empty texts are the end token alone; without training documents all counts are
zero and the weights stay as drawn; null doc_ids are trained on (no remainder); repeated rows count as often as they occur; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

END = "\n"  # no word holds it
CLASSES = 64  # of words; the end is one more
SLOTS = 64  # the last one is for a class's other words
END_ID = CLASSES * SLOTS
START = END_ID + 1
HIDDEN = 24
STEPS = 16
SCORE_STEPS = 64
LANES = 256
RATE = 0.1
#: Tokens of the documents that share lanes: with few, most lanes wait for the longest document. A shard's are one group as a rule.
GROUP_TOKENS = 6_000_000
#: Times from which the gradients of one input are added up by themselves.
OFTEN = 12
#: Training tokens of a shard.
SHARD_TOKENS = 4_000_000
TOP_WORDS = 1 << 17
Weights = dict[str, np.ndarray]


def is_held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))


def word_class(word: Column) -> Column:
    return F.pmod(F.crc32(F.right(word, F.lit(2))), F.lit(CLASSES)).cast("int")


def word_classes(words: pa.Array) -> np.ndarray:
    """The same in Python, once for each ending."""
    ends = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    of = np.array([zlib.crc32(e.encode()) % CLASSES for e in ends.dictionary.to_pylist()], np.int64)
    return of[ends.indices.to_numpy()] if len(of) else np.zeros(0, np.int64)


# ---- the network


def start_weights(shares: np.ndarray | None = None, seed: int = 7) -> Weights:
    """Drawn weights; the biases are the log shares of the word numbers (END_ID + 1 of them) in the training tokens."""
    rng = np.random.default_rng(seed)
    shares = np.ones(END_ID + 1) if shares is None else shares + 0.5
    by_class = np.append(shares[:END_ID].reshape(CLASSES, SLOTS).sum(1), shares[END_ID])
    inside = shares[:END_ID].reshape(CLASSES, SLOTS) / by_class[:CLASSES, None]
    p = {
        "x": rng.normal(0, 0.1, (START + 1, 3 * HIDDEN)), "g": np.zeros(3 * HIDDEN), "u": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)),
        "w": np.zeros((HIDDEN, CLASSES + 1)), "b": np.log(by_class / by_class.sum()),
        "v": np.zeros((CLASSES, HIDDEN, SLOTS)), "c": np.log(inside)}
    return {k: a.astype(np.float32) for k, a in p.items()}


def _gated(u: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The state after the inputs' sums g, and what its derivative needs."""
    a = h @ u
    zr = g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]
    np.exp(np.negative(zr, out=zr), out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    an = a[:, 2 * HIDDEN :]
    n = r * an
    n += g[:, 2 * HIDDEN :]
    np.tanh(n, out=n)
    after = h - n
    after *= z
    after += n
    return after, (h, z, r, n, an)


def step(p: Weights, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The state after the inputs c, and what its derivative needs."""
    return _gated(p["u"], h, p["x"][c] + p["g"])


def _shifted(o: np.ndarray) -> np.ndarray:
    """o less a number for each row, in place, so that exponentials neither overflow nor all vanish."""
    if len(o):
        top = o.max()
        o -= top if top - o.min() < 60 else o.max(1, keepdims=True)
    return o


def _sums(o: np.ndarray) -> np.ndarray:
    return o @ np.ones(o.shape[1], o.dtype)


def _softmax(o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(o) up to a factor for each row, in place of o, and its row sums."""
    np.exp(_shifted(o), out=o)
    return o, _sums(o)


def _added(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the sum of each one's rows."""
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows.take(order, axis=0)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    times = np.diff(first, append=len(keys))
    out = rows.take(first, axis=0)
    for k in range(1, OFTEN):
        some = np.flatnonzero((times > k) & (times <= OFTEN))
        out[some] += rows.take(first[some] + k, axis=0)
    for k in np.flatnonzero(times > OFTEN).tolist():
        out[k] = np.ones(times[k], rows.dtype) @ rows[first[k] : first[k] + times[k]]
    return keys[first], out


def _by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the targets by class, and (class, first, end) of each class but the end token's."""
    k = (target // SLOTS).astype(np.uint16)  # sorted by digits
    order = np.argsort(k, kind="stable")
    edges = np.searchsorted(k[order], np.arange(CLASSES + 1)).tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]


def _with_bias(p: Weights, h: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states in an order with a one behind each, and the words' vectors with their biases below."""
    hs = np.ones((len(order), HIDDEN + 1), h.dtype)
    hs[:, :HIDDEN] = h.take(order, axis=0)
    return hs, np.concatenate((p["v"], p["c"][:, None]), 1)


def _word_logits(vc: np.ndarray, hs: np.ndarray, parts: list[tuple[int, int, int]]) -> np.ndarray:
    o = np.empty((parts[-1][2] if parts else 0, SLOTS), np.float32)
    for c, a, b in parts:
        np.matmul(hs[a:b], vc[c], out=o[a:b])
    return o


def target_logs(p: Weights, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of the word number that follows each state."""
    o = h @ p["w"]
    o += p["b"]
    at = np.arange(len(target))
    out = _shifted(o)[at, target // SLOTS].astype(np.float64)
    np.exp(o, out=o)
    out -= np.log(_sums(o))
    order, parts = _by_class(target)
    hs, vc = _with_bias(p, h, order)
    o = _shifted(_word_logits(vc, hs, parts))
    order = order[: len(o)]
    inside = o[at[: len(o)], target[order] % SLOTS].astype(np.float64)
    np.exp(o, out=o)
    out[order] += inside - np.log(_sums(o))
    return out


class Lanes:
    """Documents one after another in lanes of like length, longest lane first; all lanes advance together."""

    def __init__(self, docs: list[np.ndarray], lanes: int = LANES):
        heap = [(0, k, []) for k in range(min(lanes, len(docs)))]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):  # stable, so the same in every run
            n, k, held = heap[0]
            held.append(d)
            heapq.heapreplace(heap, (n + len(docs[d]), k, held))
        heap.sort(key=lambda x: (-x[0], x[1]))
        order = [d for *_, held in heap for d in held]
        sizes = np.array([len(docs[d]) for d in order], np.int64)
        self.target = np.concatenate([docs[d] for d in order]).astype(np.uint16) if order else np.zeros(0, np.uint16)
        self.doc = np.repeat(np.array(order, np.int32), sizes)
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        self.input = np.roll(self.target, 1)
        self.input[first] = START  # nowhere else
        self.length = np.array([n for n, *_ in heap], np.int64)
        self.first = np.cumsum(self.length) - self.length

    def windows(self, steps: int) -> Iterator[list[np.ndarray]]:
        """For each step of a window, the places of the lanes that are not at their end."""
        for t0 in range(0, int(self.length[0]) if len(self.length) else 0, steps):
            live = [int((self.length > t).sum()) for t in range(t0, t0 + steps)]
            yield [self.first[:n] + t0 + k for k, n in enumerate(live) if n]


@np.errstate(over="ignore")  # a gate of 1 / (1 + inf) is 0
def document_logs(p: Weights, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document's word numbers."""
    lanes, out = Lanes(docs), np.zeros(len(docs))
    h = np.zeros((len(lanes.length), HIDDEN), np.float32)
    for window in lanes.windows(SCORE_STEPS):
        at, states, end = np.concatenate(window), [], 0
        g, going = _inputs(p, lanes, at)
        for m in map(len, window):
            h, _ = _gated(p["u"], h[:m] * going[end : end + m], g[end : end + m])
            states.append(h)
            end += m
        out += np.bincount(lanes.doc[at], target_logs(p, np.concatenate(states), lanes.target[at].astype(np.int64)), len(docs))
    return out


def _inputs(p: Weights, lanes: Lanes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the inputs at these places add to the gates, and 0 where a document begins, 1 elsewhere."""
    inputs = lanes.input[at]
    g = p["x"].take(inputs, axis=0)
    g += p["g"]
    return g, (inputs != START).astype(np.float32)[:, None]


class Trainer:
    """Truncated backpropagation through STEPS steps, with rates that fall with each weight's past gradients."""

    def __init__(self, p: Weights):
        self.p = {k: v.copy() for k, v in p.items()}
        self.past = {k: np.full_like(v, 1e-2) for k, v in p.items()}

    def _turn(self, k: str, g: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        past = self.past[k][rows]
        past += g * g
        self.past[k][rows] = past
        turned = np.sqrt(past)
        np.divide(g, turned, out=turned)
        turned *= np.float32(RATE)
        self.p[k][rows] -= turned

    def window(self, h: np.ndarray, lanes: Lanes, places: list[np.ndarray]) -> np.ndarray:
        """Learns one window; returns the state after it."""
        p, saved, states = self.p, [], []
        at, end = np.concatenate(places), 0
        gates, going = _inputs(p, lanes, at)
        for m in map(len, places):
            h, s = _gated(p["u"], h[:m] * going[end : end + m], gates[end : end + m])
            saved.append(s)
            states.append(h)
            end += m
        flat = np.concatenate(states)
        target = lanes.target[at].astype(np.int64)
        n = np.float32(LANES)  # a window's gradient is a sum over its tokens, scaled alike for all windows
        o = flat @ p["w"]
        o += p["b"]
        d, total = _softmax(o)
        d *= (1 / (n * total))[:, None]
        d[np.arange(len(target)), target // SLOTS] -= 1 / n
        dflat = d @ p["w"].T
        order, parts = _by_class(target)
        hs, vc = _with_bias(p, flat, order)
        e, total = _softmax(_word_logits(vc, hs, parts))
        e *= (1 / (n * total))[:, None]
        e[np.arange(len(e)), target[order[: len(e)]] % SLOTS] -= 1 / n
        grad_vc, used = np.empty((len(parts), HIDDEN + 1, SLOTS), np.float32), [c for c, _, _ in parts]
        dhs = np.empty((len(e), HIDDEN), np.float32)
        for k, (c, a, b) in enumerate(parts):
            np.matmul(hs[a:b].T, e[a:b], out=grad_vc[k])
            np.matmul(e[a:b], p["v"][c].T, out=dhs[a:b])
        dflat[order[: len(e)]] += dhs
        grad_w, grad_b = flat.T @ d, d.sum(0)
        # what the derivatives of all steps are multiplied by, then back through the steps
        before, z, r, new, an = (np.concatenate(x) for x in zip(*saved, strict=True))
        by_n = (1 - z) * (1 - new * new)
        by_z = (before - new) * (z - z * z)
        by_r = an * (r - r * r)
        dg, dh, back = np.empty_like(gates), np.zeros((0, HIDDEN), np.float32), p["u"].T.copy()
        da = np.empty_like(gates)
        for m in map(len, reversed(places)):
            t = slice(end - m, end)
            end -= m
            dht = dflat[t]
            dht[: len(dh)] += dh
            dn, now = dg[t, 2 * HIDDEN :], da[t]
            np.multiply(dht, by_n[t], out=dn)
            np.multiply(dht, by_z[t], out=now[:, :HIDDEN])
            np.multiply(dn, by_r[t], out=now[:, HIDDEN : 2 * HIDDEN])
            np.multiply(dn, r[t], out=now[:, 2 * HIDDEN :])
            dh = now @ back
            dh += dht * z[t]
            dh *= going[t]
        dg[:, : 2 * HIDDEN] = da[:, : 2 * HIDDEN]
        present, grad_x = _added(dg, lanes.input[at])
        self._turn("x", grad_x, present)
        self._turn("g", dg.sum(0))
        self._turn("u", before.T @ da)
        self._turn("w", grad_w)
        self._turn("b", grad_b)
        if used:
            rows = slice(None) if len(used) == CLASSES else np.array(used)
            self._turn("v", grad_vc[:, :HIDDEN], rows)
            self._turn("c", grad_vc[:, HIDDEN], rows)
        return h

    @np.errstate(over="ignore")  # a gate of 1 / (1 + inf) is 0
    def documents(self, docs: list[np.ndarray]) -> None:
        lanes = Lanes(docs)
        h = np.zeros((len(lanes.length), HIDDEN), np.float32)
        for places in lanes.windows(STEPS):
            h = self.window(h, lanes, places)


# ---- the corpus


def _lowered(batch: pa.RecordBatch) -> pa.Array:
    return pc.ascii_lower(batch.column("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """word, c (in training documents) and c_all of every token of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, words, first = common.coded_words(_lowered(batch))
            learnt = np.logical_not(batch.column("out").to_numpy(zero_copy_only=False))
            every = np.bincount(codes, minlength=len(words))
            some = np.bincount(codes[np.repeat(learnt, np.diff(first))], minlength=len(words))
            words = pa.concat_arrays([words, pa.array([END], words.type)])
            yield pa.RecordBatch.from_arrays(
                [words.cast(pa.string()), pa.array(np.append(some, learnt.sum()), pa.int64()), pa.array(np.append(every, len(learnt)), pa.int64())],
                names=["word", "c", "c_all"])

    parts = docs.select("text", is_held_out().alias("out")).mapInArrow(run, "word string, c bigint, c_all bigint")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


def _least_count(counts: DataFrame) -> int:
    """The least c_all so that TOP_WORDS words at most have as many."""
    level = F.floor(F.log2("c_all") * 16).cast("int")
    held = sorted(((r["k"], r["n"]) for r in counts.groupBy(level.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 16 * 64 rows at most
    most, k = 0, 62 * 16
    for level_, n in held:
        most += n
        if most > TOP_WORDS:
            break
        k = level_
    return int(np.ceil(2 ** (k / 16)))


class Coder:
    """Word numbers, and what counts give a document without its rare words."""

    def __init__(self, top: pa.Array, logs: np.ndarray, numbers: np.ndarray, log_room: np.ndarray):
        self.top, self.logs, self.numbers, self.log_room = top, np.append(logs, 0.0), numbers, log_room

    def code(self, texts: pa.Array) -> dict[str, pa.Array]:
        codes, words, first = common.coded_words(texts)
        at = pc.fill_null(pc.index_in(words, value_set=self.top.cast(words.type)), -1).to_numpy()
        number = np.append(self.numbers, -1)[at]  # -1 is the last one
        other = number < 0
        number = np.where(other, word_classes(words) * SLOTS + SLOTS - 1, number)
        room = np.where(other, self.log_room[np.minimum(number // SLOTS, CLASSES - 1)], 0.0)
        end_log = self.logs[0]  # the end token is the first of the top words
        docs = np.repeat(np.arange(len(first) - 1), np.diff(first))

        def summed(per_word: np.ndarray) -> np.ndarray:
            return np.bincount(docs, per_word[codes], len(first) - 1) if len(codes) else np.zeros(len(first) - 1)

        log = self.logs[at]
        rare = at < 0
        pairs, times = np.unique(docs[rare[codes]] * max(1, len(words)) + codes[rare[codes]], return_counts=True)
        whose, which = np.divmod(pairs, max(1, len(words)))
        ends = pa.array(np.searchsorted(whose, np.arange(len(first))).astype(np.int32))
        ids = np.insert(number[codes], first[1:], END_ID).astype("<u2").tobytes()
        places = (2 * (first + np.arange(len(first)))).astype(np.int32)
        return {
            "n": pa.array(np.diff(first) + 1, pa.int64()), "known": pa.array((summed(log > 0) + (end_log > 0)).astype(np.int64)),
            "tail": pa.array(summed(np.where(other, log, 0.0) - room)), "all": pa.array(summed(log) + end_log),
            "words": pa.ListArray.from_arrays(ends, words.take(pa.array(which)).cast(pa.string())),
            "times": pa.ListArray.from_arrays(ends, pa.array(times, pa.int32())),
            "ids": pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(ids)])}


def _numbers(ids: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in ids.to_pylist()]


def _shards(learnt: DataFrame, tokens: int) -> tuple[DataFrame, int]:
    """Rows dealt by a hash of document and content, each shard's in an order of its own."""
    n = max(1, round(tokens / SHARD_TOKENS))
    key = F.xxhash64(F.lit("shard"), "doc_id", "ids")
    return learnt.select("ids", key.alias("key")).withColumn("shard", F.pmod(F.col("key"), F.lit(n)).cast("int")), n


def train(learnt: DataFrame, tokens: int, weights: Weights) -> Weights:
    """Weights from every row of learnt (doc_id, ids), whatever its partitions."""
    spark = learnt.sparkSession
    names, shapes = list(weights), {k: v.shape for k, v in weights.items()}
    dealt, n = _shards(learnt, tokens)
    for rows in (dealt.filter("shard = 0"), dealt):  # the common start, then all
        start = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            trainer, shard, held, waiting, seen = None, None, [], 0, 0

            def told() -> Iterator[pa.RecordBatch]:
                if held:
                    trainer.documents(held)
                if seen:
                    flat = np.concatenate([trainer.p[x].ravel() for x in names]).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), seen, np.int64))], names=["i", "w", "n"])

            for batch in batches:
                for k, ids in zip(batch.column("shard").to_pylist(), _numbers(batch.column("ids")), strict=True):
                    if k != shard:
                        yield from told()
                        trainer, shard, held, waiting, seen = Trainer(start.value), k, [], 0, 0
                    held.append(ids)
                    waiting += len(ids)
                    seen += len(ids)
                    if waiting >= GROUP_TOKENS:
                        trainer.documents(held)
                        held, waiting = [], 0
            yield from told()

        rows = rows.repartitionByRange(n, "shard").sortWithinPartitions("shard", "key").select("shard", "ids")
        parts = rows.mapInArrow(run, "i bigint, w double, n bigint")
        means = parts.groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).toArrow()  # a row for each weight
        if means.num_rows:
            flat = np.zeros(sum(int(np.prod(s)) for s in shapes.values()), np.float32)
            flat[means.column("i").to_numpy()] = means.column("w").to_numpy()
            at = np.cumsum([0, *(int(np.prod(shapes[x])) for x in names)])
            weights = {x: flat[at[j] : at[j + 1]].reshape(shapes[x]) for j, x in enumerate(names)}
    return weights


@common.tidy("lm-scores")
def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    common.python_ready(spark, 2000)
    docs = docs.select("doc_id", "text")
    counts = common.written(count_words(docs), "word-counts")
    n, v = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    n, v = n or 0, v or 0
    top = counts.filter((F.col("c_all") >= _least_count(counts)) | (F.col("word") == END)).select("word", "c").toArrow()  # TOP_WORDS + 1 rows at most
    ranked = sorted(zip(top.column("c").to_pylist(), top.column("word").to_pylist(), strict=True), key=lambda x: (x[1] != END, -x[0], x[1]))
    if not ranked:
        ranked = [(0, END)]
    # the END token comes first; heads take the places of their class by frequency
    names = pa.array([w for _, w in ranked])
    numbers, shares, taken = np.full(len(ranked), -1), np.zeros(END_ID + 1), np.zeros(CLASSES, np.int64)
    numbers[0], shares[END_ID] = END_ID, ranked[0][0]
    for j, k in enumerate(word_classes(names).tolist()):
        c = ranked[j][0]
        if j and c > 0 and taken[k] < SLOTS - 1:
            numbers[j] = k * SLOTS + taken[k]
            taken[k] += 1
            shares[numbers[j]] = c
    heads = spark.createDataFrame([(w,) for (_, w), k in zip(ranked, numbers, strict=True) if k >= 0], "word string")  # CLASSES * SLOTS rows at most
    others = counts.filter("c > 0").join(F.broadcast(heads), "word", "left_anti")
    others = others.groupBy(word_class(F.col("word")).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # CLASSES rows at most
    room = np.ones(CLASSES)  # N + V + 1 of a class's other words
    for r in others:
        room[r["k"]] = r["n"] + r["v"] + 1
        shares[r["k"] * SLOTS + SLOTS - 1] = r["n"]
    logs = np.log10(np.array([c for c, _ in ranked], np.float64) + 1)
    table = spark.sparkContext.broadcast((names, logs, numbers, np.log10(room)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*table.value)
        for batch in batches:
            found = coder.code(_lowered(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("out"), *found.values()], names=["doc_id", "held_out", *found])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", is_held_out().alias("out")).mapInArrow(
        code, f"doc_id {kind}, held_out boolean, n bigint, known bigint, tail double, all double, words array<string>, times array<int>, ids binary")
    rows = common.written(rows.withColumn("row_id", F.monotonically_increasing_id()), "coded")
    weights = spark.sparkContext.broadcast(train(rows.filter("not held_out"), n, start_weights(shares)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def told() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held).combine_chunks()
                logs_ = document_logs(weights.value, _numbers(rows.column("ids"))) / np.log(10)
                yield from rows.select(COLUMNS).append_column("model", pa.array(logs_)).to_batches()

        for batch in batches:
            held.append(batch)
            waiting += pc.sum(batch.column("n")).as_py() or 0
            if waiting >= GROUP_TOKENS:
                yield from told()
                held, waiting = [], 0
        yield from told()

    rare = rows.select("row_id", F.explode(F.arrays_zip("words", "times")).alias("r")).select("row_id", F.col("r.words").alias("word"), F.col("r.times").alias("k"))
    rare = rare.join(counts.select("word", "c"), "word")
    rare = rare.groupBy("row_id").agg(
        F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    judged = rows.select(*COLUMNS, "ids").mapInArrow(
        judge, f"row_id bigint, doc_id {kind}, held_out boolean, n bigint, known bigint, tail double, all double, model double")
    return judged.join(rare, "row_id", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("all") + more - F.col("n") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("model") + F.col("tail") + more).alias("score"))


COLUMNS = ("row_id", "doc_id", "held_out", "n", "known", "tail", "all")
