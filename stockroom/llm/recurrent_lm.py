"""Operator 7: language-model scoring with a gated recurrent network and class-factored output.

Words are counted over all training texts.  Every word has a class: the commonest
words and the end of a text are classes of their own, others go by their last two
characters (the commonest endings, and one class for the rest).  The model's
probability of a token is softmax(class | state) * (c + 1) / (tokens of the class +
distinct words of the class + 1): the network learns what kind of word follows,
the counts of the whole corpus say which word of that kind.  A gated recurrent unit
carries its state through the whole text, window by window.

It is trained in ``ROUNDS`` rounds.  In each, every task runs truncated backpropagation
(numpy, Adam) over its partition's whole texts, starting from the shared weights; the
tasks' weights are averaged by the tokens they have seen and start the next round.  A round
takes one of ``PARTS`` equal parts of the training texts by a hash of their doc_id, and there
are as many rounds as parts, so the network learns from every text; only weights, of a
fixed size, come to the driver.  Counts cover all texts.

Scoring needs the count of every word.  The ``HEAD`` commonest words are broadcast (a
fixed bound); the other words of a text, few by then, are joined to the table of counts
by a 64-bit hash, so nothing that grows with the vocabulary reaches one place.

Defined results: a null or empty text is the end token alone; a null doc_id is
neither learned from nor held out; rows that repeat a doc_id and text are scored alike;
with nothing learned all counts are 0 and the network knows the classes' shares alone; the
latter also where no part holds enough tokens for a step; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockroom.llm.common import fold, slices, table, utf8_values, words_of
from stockroom.session import ScratchTable

TEXT_BYTES = 16_000_000
HEAD = 1 << 17
OWN_CLASSES, ENDINGS = 60, 66
HIDDEN = 32
ROUNDS = PARTS = 4  # every training text is learned from once
STREAMS, WINDOW, RATE = 64, 20, 0.01
BLOCK = 5  # steps of a window whose output is computed at once; bounds its arrays to the processor's cache
TEXTS = 256  # texts scored side by side; bounds a step's arrays to the processor's cache
END = b"\n"  # no word holds it
CLOSING = ".,;:!?\"')"  # not part of a word's ending


def advance(given: np.ndarray, before: np.ndarray, recurrent: np.ndarray, u: np.ndarray, gates: np.ndarray, new: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Next state (units x streams), computed in ``state``; ``u``, ``gates`` (keep, reset) and ``new`` get what backpropagation needs.

    ``given`` and ``recurrent`` are of negated gates (see ``GatedNetwork.negated``).
    """

    np.matmul(recurrent, before, out=u)
    np.add(given[: 2 * HIDDEN], u[: 2 * HIDDEN], out=gates)
    np.exp(gates, out=gates)  # beyond the range: infinite, and the gate 0
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[HIDDEN:], u[2 * HIDDEN :], out=new)
    new += given[2 * HIDDEN :]
    np.tanh(new, out=new)
    np.subtract(before, new, out=state)
    state *= gates[:HIDDEN]
    state += new
    return state


@dataclass
class Classes:
    """Class numbers: the end, common words, endings, and all other words."""

    words: dict[bytes, int]
    endings: dict[str, int]
    count: int

    @staticmethod
    def build(head: list[tuple[bytes, int]]) -> Classes:
        """From (word, count), commonest first, the end left out."""

        words = {END: 0}
        for word, _ in head[:OWN_CLASSES]:
            words[word] = len(words)
        mass: dict[str, int] = {}
        for word, n in head[OWN_CLASSES:]:
            ending = Classes.ending(word)
            mass[ending] = mass.get(ending, 0) + n
        chosen = sorted(mass, key=lambda e: (-mass[e], e))[:ENDINGS]
        return Classes(words, {ending: len(words) + i for i, ending in enumerate(chosen)}, len(words) + len(chosen) + 1)

    @staticmethod
    def ending(word: bytes) -> str:
        return word.decode("utf-8", "replace").rstrip(CLOSING)[-2:]

    def of(self, words: list[bytes]) -> np.ndarray:
        other = self.count - 1
        tails = {ending.encode(): number for ending, number in self.endings.items() if ending.isascii()}

        closing = CLOSING.encode()
        plain: dict[bytes, int] = {}  # by the last two bytes, where they alone decide

        def of_ending(word: bytes) -> int:
            tail = word.rstrip(closing)[-2:]
            if not tail.isascii():
                return self.endings.get(self.ending(word), other)
            number = tails.get(tail, other)
            if word[-2:] == tail and word[-1:] not in closing:
                plain[tail] = number
            return number

        own = self.words
        return np.fromiter((own[w] if w in own else plain[tail] if (tail := w[-2:]) in plain else of_ending(w) for w in words), np.int32, len(words))


class Adam:
    """Running moments of the gradients; gradients are clipped to a norm of 1.  Works in place, also on the given gradients."""

    def __init__(self):
        self.first, self.second, self.updates = {}, {}, 0

    def update(self, network: GatedNetwork, grad: dict[str, np.ndarray], rate: float) -> None:
        # plain floats: a numpy scalar would turn the float32 arrays into float64
        norm = float(np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values())))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        self.updates += 1
        rate = float(rate * np.sqrt(1 - 0.999**self.updates) / (1 - 0.9**self.updates))
        for name, g in grad.items():
            if name not in self.first:
                self.first[name], self.second[name] = np.zeros_like(g), np.zeros_like(g)
            first, second = self.first[name], self.second[name]
            first *= 0.9
            first += g * (0.1 * scale)
            g *= scale
            g *= g
            g *= 0.001
            second *= 0.999
            second += g
            np.sqrt(second, out=g)
            g += 1e-8
            np.divide(first, g, out=g)
            g *= rate
            weights = getattr(network, name)
            weights -= g


class Room:
    """Arrays that one window after another is computed in; new ones each time cost as much as the arithmetic."""

    def __init__(self):
        self.arrays: dict[str, np.ndarray] = {}

    def array(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        found = self.arrays.get(name)
        if found is None or found.shape != shape or found.dtype != kind:
            found = self.arrays[name] = np.empty(shape, kind)
        return found


class GatedNetwork:
    """Gated recurrent unit over class numbers with a softmax over the next class."""

    NAMES = ("inputs", "recurrent", "out", "bias")

    def __init__(self, classes: int, frequency: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.inputs = rng.normal(0, 0.1, (classes, 3 * HIDDEN)).astype(np.float32)
        self.recurrent = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (HIDDEN, classes)).astype(np.float32)
        self.bias = np.log((frequency + 1) / (frequency.sum() + classes)).astype(np.float32)

    def negated(self) -> tuple[np.ndarray, np.ndarray]:
        """Input weights, and recurrent weights by output unit; those of the gates negated, as sigmoid(x) = 1 / (1 + exp(-x))."""

        sign = np.ones(3 * HIDDEN, self.inputs.dtype)
        sign[: 2 * HIDDEN] = -1
        return self.inputs * sign, (self.recurrent * sign).T

    @np.errstate(over="ignore")
    def step(self, given: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """Next state (streams x units) after the classes ``given``, and what it is made from: both gates and the new values."""

        inputs, recurrent = self.negated()
        u, gates, new, after = (np.empty((n * HIDDEN, len(given)), state.dtype) for n in (3, 2, 1, 1))
        advance(inputs[given].T, state.T, recurrent, u, gates, new, after)
        return after.T, gates.T, new.T

    def log_softmax(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.out + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def output(self) -> tuple[np.ndarray, bool]:
        """Weights by class with the bias behind them, and whether exp of their logits is surely in range (states are within -1 and 1)."""

        weights = np.concatenate([self.out, self.bias[None]]).T
        return np.ascontiguousarray(weights), float(np.abs(weights).sum(axis=1).max()) < 60

    @np.errstate(over="ignore")
    def gradients(self, given: np.ndarray, wanted: np.ndarray, state: np.ndarray, room: Room | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean loss over one window (steps x streams), and the state after it; a text's end clears the state.

        Inside, an array is steps x units x streams, so that a gate's values are contiguous.
        """

        (steps, streams), kind, room = given.shape, self.inputs.dtype, Room() if room is None else room
        units = (steps, HIDDEN, streams)
        inputs, recurrent = self.negated()
        of_given = room.array("given", (steps, 3 * HIDDEN, streams), kind)
        rows = np.take(inputs, given, axis=0, out=room.array("rows", (steps, streams, 3 * HIDDEN), kind), mode="clip")
        of_given[:] = rows.transpose(0, 2, 1)
        goes_on = (given != 0).astype(kind)  # the end stands before a text's first word
        clears = (given == 0).any(axis=1).tolist()
        before, new = room.array("before", units, kind), room.array("new", units, kind)
        gates = room.array("gates", (steps, 2 * HIDDEN, streams), kind)
        u = room.array("u", of_given.shape, kind)
        states = room.array("states", (steps, HIDDEN + 1, streams), kind)
        states[:, HIDDEN] = 1  # for the bias
        state = state.T
        for t in range(steps):
            before[t] = state * goes_on[t] if clears[t] else state
            state = advance(of_given[t], before[t], recurrent, u[t], gates[t], new[t], states[t, :HIDDEN])
        inner = u[:, 2 * HIDDEN :]
        weights, in_range = self.output()
        from_out, of_output = room.array("from_out", units, kind), np.zeros_like(weights)
        for low in range(0, steps, BLOCK):
            of = slice(low, low + BLOCK)
            here = states[of]
            error = np.matmul(weights, here, out=room.array("error", (len(here), len(weights), streams), kind))
            if not in_range:
                error -= error.max(axis=1, keepdims=True)
            np.exp(error, out=error)
            error *= 1 / (steps * streams * (np.ones(len(weights), kind) @ error))[:, None]
            error[np.arange(len(here))[:, None], wanted[of], np.arange(streams)] -= 1 / (steps * streams)
            of_output += np.matmul(error, here.transpose(0, 2, 1), out=room.array("of_output", (len(here), *weights.shape), kind)).sum(axis=0)
            np.matmul(self.out, error, out=from_out[of])
        keep, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
        to_keep = np.subtract(before, new, out=room.array("to_keep", units, kind))
        to_keep *= keep
        to_new = np.subtract(1, keep, out=room.array("to_new", units, kind))
        to_keep *= to_new
        new *= new
        to_new *= np.subtract(1, new, out=new)
        inner *= reset
        to_reset = np.multiply(inner, np.subtract(1, reset, out=new), out=inner)
        d_u, carried = room.array("d_u", of_given.shape, kind), np.zeros((HIDDEN, streams), kind)
        for t in range(steps - 1, -1, -1):
            d = np.add(from_out[t], carried, out=from_out[t])
            d_new = np.multiply(d, to_new[t], out=to_new[t])
            np.multiply(d, to_keep[t], out=d_u[t, :HIDDEN])
            np.multiply(d_new, to_reset[t], out=d_u[t, HIDDEN : 2 * HIDDEN])
            np.multiply(d_new, reset[t], out=d_u[t, 2 * HIDDEN :])
            carried = self.recurrent @ d_u[t]
            d *= keep[t]
            carried += d
            if clears[t]:
                carried *= goes_on[t]
        of_recurrent = np.matmul(d_u, before.transpose(0, 2, 1), out=room.array("of_recurrent", (steps, 3 * HIDDEN, HIDDEN), kind)).sum(axis=0).T
        d_u[:, 2 * HIDDEN :] = to_new  # of the inputs
        rows[:] = d_u.transpose(0, 2, 1)
        order = np.argsort(given, axis=None, kind="stable")
        found = given.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        # places are all in range; "clip" lets take write to ``out`` at once
        by_class = np.take(rows.reshape(-1, 3 * HIDDEN), order, axis=0, out=room.array("by_class", (len(order), 3 * HIDDEN), kind), mode="clip")
        # summed by class, two numbers at a time: as the parts of complex ones
        sums = np.add.reduceat(by_class.view(np.result_type(kind, np.complex64)), first)
        of_inputs = np.zeros_like(self.inputs)
        of_inputs[found[first]] = sums.view(kind)
        return {"out": np.ascontiguousarray(of_output[:, :HIDDEN].T), "bias": of_output[:, HIDDEN].copy(), "inputs": of_inputs, "recurrent": np.ascontiguousarray(of_recurrent)}, state.T

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.NAMES])

    def with_weights(self, weights: np.ndarray) -> GatedNetwork:
        """A network of the same shape with these weights."""

        other, at = copy(self), 0
        for name in self.NAMES:
            shape = getattr(self, name).shape
            setattr(other, name, weights[at : at + int(np.prod(shape))].astype(np.float32).reshape(shape))
            at += int(np.prod(shape))
        return other

    def train(self, tokens: np.ndarray, rate: float, adam: Adam) -> int:
        """Truncated backpropagation over texts (their class numbers in a row, each ending in 0), cut into
        parallel streams; returns how many tokens were used."""

        length = len(tokens) // STREAMS
        if length < 2:
            return 0
        streams = tokens[: length * STREAMS].reshape(STREAMS, length).T
        given = np.concatenate([np.zeros((1, STREAMS), streams.dtype), streams[:-1]])
        state, room = np.zeros((STREAMS, HIDDEN), np.float32), Room()
        for at in range(0, length, WINDOW):
            grad, state = self.gradients(given[at : at + WINDOW], streams[at : at + WINDOW], state, room)
            adam.update(self, grad, rate)
        return length * STREAMS

    @np.errstate(over="ignore")
    def log_likelihoods(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural log probability of each whole text's classes (text i: ``tokens[starts[i]:starts[i + 1]]``).

        Texts run side by side, TEXTS at a time and longest first; each window takes the state of the one before it.
        """

        lengths = np.diff(starts)
        order = np.argsort(-lengths, kind="stable")
        inputs, recurrent = self.negated()
        weights, in_range = self.output()
        ones = np.ones(len(weights), weights.dtype)
        out = np.empty(len(order))
        for low in range(0, len(order), TEXTS):
            rows = order[low : low + TEXTS]
            begin, left = starts[:-1][rows], lengths[rows]
            total = np.zeros(len(rows))
            state = np.zeros((HIDDEN, len(rows)), weights.dtype)
            before = np.zeros(len(rows), tokens.dtype)
            for at in range(0, int(left[0]), WINDOW):
                active = int(np.searchsorted(-left, -at, side="left"))  # texts longer than ``at``
                steps = np.arange(at, min(at + WINDOW, int(left[0])))[:, None]
                # a text that ends inside the window repeats its last token until the window's end; that isn't summed
                wanted = tokens[begin[:active] + np.minimum(steps, left[:active] - 1)]
                given = np.concatenate([before[None, :active], wanted[:-1]])
                before, state = wanted[-1], np.ascontiguousarray(state[:, :active])
                of_given = np.ascontiguousarray(inputs[given].transpose(0, 2, 1))
                biased, each = np.ones((HIDDEN + 1, active), weights.dtype), np.arange(active)
                u, gates, new = (np.empty((n * HIDDEN, active), weights.dtype) for n in (3, 2, 1))
                chosen, sums = np.empty(wanted.shape, weights.dtype), np.empty(wanted.shape, weights.dtype)
                logits = np.empty((len(weights), active), weights.dtype)
                for t in range(len(steps)):
                    advance(of_given[t], state, recurrent, u, gates, new, biased[:HIDDEN])
                    state[:] = biased[:HIDDEN]
                    np.matmul(weights, biased, out=logits)
                    if not in_range:
                        logits -= logits.max(axis=0)
                    chosen[t] = logits[wanted[t], each]
                    np.exp(logits, out=logits)
                    np.matmul(ones, logits, out=sums[t])
                total[:active] += np.where(steps < left[:active], chosen - np.log(sums), 0).sum(axis=0, dtype=np.float64)
            out[rows] = total
        return out


@dataclass
class LanguageModel:
    classes: Classes
    network: GatedNetwork
    head: dict[bytes, int]
    class_size: np.ndarray  # tokens + distinct words + 1 of each class
    tokens: int  # N
    distinct: int  # V


def with_end(words) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Token codes with an end after each text, their starts, and the distinct tokens (the end last)."""

    lengths = np.diff(words.starts)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    codes = np.full(starts[-1], len(words.distinct), np.int64)
    inside = np.ones(starts[-1], bool)
    inside[starts[1:] - 1] = False
    codes[inside] = words.codes
    return codes, starts, [*words.distinct, END]


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, the end counted as a word; summed inside each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, TEXT_BYTES):
                codes, _, distinct = with_end(words_of(part.column(0)))
                n = np.bincount(codes, minlength=len(distinct))
                yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame) -> list[tuple[bytes, int]]:
    """(word, n), commonest first: all words with at least the count that no more than HEAD words have."""

    # running sums over one row per count that occurs; only the least count comes to the driver
    how_many = counts.groupBy("n").agg(F.count("*").alias("words"))
    through = how_many.withColumn("through", F.sum("words").over(Window.orderBy(F.desc("n"))))
    least = through.where(F.col("through") <= HEAD).agg(F.min("n")).first()[0]
    found = counts.where(F.col("n") >= least).toArrow() if least is not None else None
    if found is None:
        return []
    pairs = zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True)
    return sorted(pairs, key=lambda pair: (-pair[1], pair[0]))


def train_round(texts: DataFrame, classes: Classes, network: GatedNetwork, rate: float) -> GatedNetwork:
    """The network after every task has trained its own copy on its texts: the copies' mean by tokens."""

    shared = texts.sparkSession.sparkContext.broadcast((classes, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, start = shared.value
        own, adam, used = start.with_weights(start.weights()), Adam(), 0
        for batch in batches:
            for part in slices(batch, 0, TEXT_BYTES):
                codes, _, distinct = with_end(words_of(part.column(0)))
                used += own.train(of.of(distinct)[codes], rate, adam)
        if used:
            weights = own.weights().astype(np.float64) * used
            yield pa.RecordBatch.from_arrays([pa.array([used], pa.int64()), pa.array([weights])], names=["used", "weights"])

    copies = texts.where("text is not null").select("text").mapInArrow(run, "used long, weights array<double>")
    # one row per weight, summed inside each task before the shuffle
    sums = copies.select("used", F.posexplode("weights").alias("place", "weight")).groupBy("place").agg(F.sum("weight").alias("weight"), F.sum("used").alias("used"))
    found = sums.select("place", (F.col("weight") / F.col("used")).alias("weight")).orderBy("place").toArrow()
    shared.unpersist()
    return network.with_weights(found.column("weight").to_numpy()) if found.num_rows else network


def learn(training: DataFrame) -> tuple[LanguageModel, ScratchTable]:
    """Fit on (doc_id, text); also returns the table of (hash, n) of all training words."""

    spark = training.sparkSession
    counts = ScratchTable(token_counts(training), "token-counts").df
    end = F.col("word") == F.lit(END)
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = commonest(counts.where(~end))
    ends = counts.where(end).first()
    classes = Classes.build(head)
    shared = spark.sparkContext.broadcast(classes)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), batch.column(1), pa.array(shared.value.of(words))], names=["hash", "n", "class"])

    described = ScratchTable(counts.mapInArrow(describe, "hash long, n long, class int"), "hashed-counts")
    sizes, frequency = np.ones(classes.count), np.zeros(classes.count)
    for row in described.df.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect():  # a row per class
        sizes[row["class"]] += row.n + row.distinct
        frequency[row["class"]] = row.n
    network = GatedNetwork(classes.count, frequency)
    for round_ in range(ROUNDS):
        network = train_round(training.where(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) == round_), classes, network, RATE * 0.5**round_)
    known = dict(head) | ({END: ends.n} if ends else {})
    return LanguageModel(classes, network, known, sizes, tokens, distinct), described


SCORED = "doc_id long, text_hash long, n_tokens long, n_known long, class_score double, count_score double, size_score double, rare array<long>, times array<int>"


def score_texts(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row what the network and the head words give, and the hashes of all other words."""

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, 1, TEXT_BYTES):
                codes, starts, distinct = with_end(words_of(part.column(1)))
                n = len(starts) - 1
                owner = np.repeat(np.arange(n), np.diff(starts))
                count = np.fromiter((m.head.get(word, 0) for word in distinct), np.int64, len(distinct))
                of_class = m.classes.of(distinct)
                network = m.network.log_likelihoods(of_class[codes], starts) / np.log(10)
                by_count = np.bincount(owner, weights=np.log10(count + 1.0)[codes], minlength=n)
                by_size = np.bincount(owner, weights=np.log10(m.class_size[of_class])[codes], minlength=n)
                known = np.bincount(owner, weights=(count > 0)[codes], minlength=n).astype(np.int64)
                open_ = count[codes] == 0
                pairs, times = np.unique(owner[open_] * len(distinct) + codes[open_], return_counts=True)
                whose, which = np.divmod(pairs, len(distinct))
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct)).view(np.int64)
                offsets = pa.array(np.searchsorted(whose, np.arange(n + 1)).astype(np.int32))
                texts = [xxhash.xxh3_64_intdigest(text or b"") for text in utf8_values(part.column(1))]
                arrays = [part.column(0), pa.array(np.array(texts, np.uint64).view(np.int64)), pa.array(np.diff(starts)), pa.array(known), pa.array(network), pa.array(by_count), pa.array(by_size)]
                arrays += [pa.ListArray.from_arrays(offsets, pa.array(hashes[which])), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCORED.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCORED)


def score(docs: DataFrame, model: LanguageModel, counts: DataFrame) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score."""

    rows = ScratchTable(score_texts(docs, model), "scored-texts").df
    key = ["doc_id", "text_hash"]
    rare = rows.where(F.size("rare") > 0).select(*key, F.explode(F.arrays_zip("rare", "times")).alias("one")).select(*key, F.col("one.rare").alias("hash"), F.col("one.times").alias("times"))
    found = rare.join(counts.select("hash", "n"), "hash")
    # rows that repeat a doc_id and text give the same words each: divided by how many there are
    sums = found.groupBy(*key).agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_score"), F.sum("times").alias("more_known"))
    copies = rows.groupBy(F.col("doc_id").alias("c"), F.col("text_hash").alias("t")).agg(F.count("*").alias("copies"))
    sums = sums.join(copies, F.col("doc_id").eqNullSafe(F.col("c")) & (F.col("text_hash") == F.col("t"))).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), (F.col("more_score") / F.col("copies")).alias("more_score"), (F.col("more_known") / F.col("copies")).cast("long").alias("more_known"))
    joined = rows.drop("rare", "times").join(sums, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    by_count = F.col("count_score") + F.coalesce("more_score", F.lit(0.0))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (by_count - F.col("n_tokens") * float(np.log10(model.tokens + model.distinct + 1))).alias("base_score"),
        (F.col("class_score") + by_count - F.col("size_score")).alias("score"),
    )


def op7_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = learn(docs.where(fold("doc_id", 7) != 2))
    scored = score(docs, model, counts.df)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
