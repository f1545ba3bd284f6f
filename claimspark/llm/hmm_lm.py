"""Language-model scoring with a hidden Markov model, beside a unigram base.

*Blocks.* A task gathers texts to blocks of about ``BLOCK`` bytes, numbers the different words of
each, most frequent first, and writes the texts as these numbers, bucketed by block: later rounds
read them in place, whole, and never shuffle them. Words go by 64-bit hash to buckets, which add up
their training counts and send each block the counts of its words. Every word has its own counts.

*Emissions.* A word belongs to one of ``CLASSES`` classes by its ending, a text's end to one of its
own. A state draws a class, then a word of it by the expected counts that Baum-Welch gave it, into
which as much of the class' counts is mixed as the state has met different words of it
(Witten-Bell). One more word of each class stands for all unknown ones; the words met once tell how
often it is drawn. So the probabilities of all words and of the unknown ones sum to 1 in each state.

*Training.* Baum-Welch over all training texts, each a whole: texts over ``SHORT`` tokens run through
the transfer matrices of their pieces first, which give the exact state distribution before and the
exact likelihood after each piece, so expected counts are the same for any length of a piece. In
each of ``ROUNDS`` rounds a block sends the buckets the shares of its words' counts by state, these
add them up over the corpus and send each block the sums of its words. Shares travel as 8-bit square
roots (0.3 % of the count off at most; a share under 0.0004 % becomes 0). A bounded sample
(``START_TEXTS`` texts of at most ``START_SIZE`` characters) gives only the point to start from.

*Scoring.* The exact likelihood of each whole text by the scaled forward recursion; for long texts,
by products of the transfer matrices of their pieces, which is the same sum.

No vocabulary reaches the driver: it sees the sums of classes, transitions and starts.

Defined cases: a null text counts as empty and consists of its end token; a null id is neither
held out nor learned from; without training texts all counts are 0; a repeated row is counted and
scored again; an empty table gives an empty result; other columns are not looked at. Two words
are taken for one only if their 64-bit hashes agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Sent, arrow_types, bucketed, discard, few_by_hash, materialise, table, training_row, utf8

MODULUS, HELD, ADD = 10, 0, 0.1
STATES, ROUNDS, CLASSES = 8, 3, 2048
#: Bytes of text in a block, tokens in a row of it, bytes of text for each bucket of words.
BLOCK, CHUNK, BUCKET = 16 << 20, 1 << 18, 32 << 20
START_TEXTS, START_SIZE, START_ROUNDS = 400, 32_768, 6
#: Texts up to this many tokens run as one piece; how many tokens run at once.
SHORT, PIECE, CELLS = 2048, 256, 1 << 18
#: The token that ends a text. No word is empty.
END = b""


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, in which A-Z count as a-z."""
    return text.lower().split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-4:]) % CLASSES if word else CLASSES


def packed(values: np.ndarray) -> bytes:
    """Integers, compressed by planes of bytes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize * values[:1].size or values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return planes.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def roots(counts: np.ndarray) -> bytes:
    """What share of each word's counts is whose state's, as 8-bit square roots."""
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300)
    return packed(np.rint(255 * np.sqrt(share)).astype(np.uint8))


def shares(data: bytes, states: int = STATES) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    squares = planes.reshape(states, -1).T.astype(float) ** 2
    return squares / np.maximum(squares.sum(axis=1, keepdims=True), 1e-300)


class Places(dict):
    """The number of each word, dealt when it is first met."""

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


class Block:
    """Texts and their different words."""

    def __init__(self, number: int):
        self.number, self.bytes, self.places = number, 0, Places()
        self.doc_ids: list[int | None] = []
        self.held: list[bool] = []
        self.train: list[bool] = []
        self.texts: list[np.ndarray] = []

    def add(self, doc_id: int | None, held: bool, train: bool, text: bytes) -> None:
        found = [*words(text), END]
        self.texts.append(np.fromiter(map(self.places.__getitem__, found), np.uint32, len(found)))
        self.doc_ids.append(doc_id)
        self.held.append(held)
        self.train.append(train)
        self.bytes += len(text)

    def rows(self, buckets: int) -> Iterator[dict]:
        """Rows of texts, then a row for each bucket with the words that go there."""
        sizes = np.array([len(t) for t in self.texts])
        ids, learned = np.concatenate(self.texts), np.repeat(self.train, sizes)
        often = np.argsort(-np.bincount(ids, minlength=len(self.places)), kind="stable")
        rank = np.empty(len(often), np.uint32)
        rank[often] = np.arange(len(often), dtype=np.uint32)
        ids = rank[ids]
        known = list(self.places)
        known = [known[i] for i in often]
        hashes = np.array([word_hash(w) for w in known], np.uint64)
        classes = np.array([word_class(w) for w in known], np.uint16)
        n = np.bincount(ids[learned], minlength=len(known))
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((hashes, bucket))
        ends = np.cumsum(sizes)
        first = part = 0
        while first < len(sizes):
            begin = ends[first] - sizes[first]
            last = max(first + 1, int(np.searchsorted(ends, begin + CHUNK, "right")))
            extra = {} if part else {"words": packed(order.astype(np.uint32)), "classes": packed(classes)}
            yield {
                "block": self.number, "part": part, "doc_id": self.doc_ids[first:last], "held_out": self.held[first:last], "train": self.train[first:last],
                "size": sizes[first:last], "symbols": packed(ids[begin : ends[last - 1]]), **extra,
            }
            first, part = last, part + 1
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if low < high:
                some = order[low:high]
                yield {"block": self.number, "bucket": b, "words": packed(hashes[some]), "classes": packed(classes[some]), "n": packed(n[some])}


ENCODED = "block long, part int, doc_id array<long>, held_out array<boolean>, train array<boolean>, size array<long>, symbols binary, words binary, classes binary, bucket int, n binary"


def as_table(rows: list[dict], schema: str, types: list[pa.DataType]) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.Table.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)


def encode(rows: DataFrame, buckets: int) -> DataFrame:
    """Blocks of ``rows`` (row, doc_id, held_out, train, text): their texts, bucketed, and their words by bucket.

    In the first row of a block's texts ``words`` has its words' numbers in the order of the
    buckets; in a row of a bucket it has their hashes.
    """
    types = arrow_types(rows.sparkSession, ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(block: Block) -> Iterator[pa.RecordBatch]:
            for row in block.rows(buckets):
                yield from as_table([row], ENCODED, types).to_batches()

        block = None
        for batch in batches:
            numbers, *meta = (batch.column(i).to_pylist() for i in range(4))
            for i, text in enumerate(utf8(batch.column(4))):
                block = block or Block(numbers[i])
                block.add(*(m[i] for m in meta), text)
                if block.bytes >= BLOCK:
                    yield from flush(block)
                    block = None
        if block:
            yield from flush(block)

    return rows.mapInArrow(run, ENCODED)


class Model:
    """Distributions of the first state and of the next; what words are drawn by, by class, then state.

    ``mass``, ``distinct`` and ``once`` are the training tokens, different words and words met once of each
    class; ``sums`` and ``met`` are the expected counts and the different words that each state has met of it.
    """

    def __init__(self, start: np.ndarray, flow: np.ndarray, mass: np.ndarray, distinct: np.ndarray, once: np.ndarray, sums: np.ndarray, met: np.ndarray):
        self.start = (start + 0.5) / (start + 0.5).sum()
        self.flow = (flow + 0.5) / (flow + 0.5).sum(axis=1, keepdims=True)
        self.tokens, self.distinct = int(mass.sum()), int(distinct.sum())
        share = (mass + ADD) / (mass + ADD).sum()
        new = (sums >= 0.5).sum(axis=0) + 1.0
        chance = (sums + new * share[:, None]) / (sums.sum(axis=0) + new)
        unknown = (once + ADD) / (mass + once + ADD)
        self.unknown = chance * unknown[:, None]
        #: Probability of a known word: own * its expected counts + other * its training count.
        self.own = chance * (1 - unknown)[:, None] / (sums + met + 1)
        self.other = self.own * (met + 1) / np.maximum(mass, 1)[:, None]

    def emissions(self, classes: np.ndarray, c: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probabilities of words by state."""
        known = self.own[classes] * counts + self.other[classes] * c[:, None]
        return np.where(c[:, None] > 0, known, self.unknown[classes])


def class_sums(classes: np.ndarray, c: np.ndarray, counts: np.ndarray, size: int = CLASSES + 1) -> np.ndarray:
    """By class: tokens, different words, words met once, expected counts by state, words met by state."""
    columns = [c, c > 0, c == 1, *counts.T, *(counts.T >= 0.5)]
    return np.stack([np.bincount(classes, x, size) for x in columns], axis=1)


def model_of(sums: np.ndarray, start: np.ndarray, flow: np.ndarray) -> Model:
    states = len(start)
    return Model(start, flow, *sums.T[:3], sums[:, 3 : 3 + states], sums[:, 3 + states :])


def by_length(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order from long to short; symbols by place, then text; how many texts have each place."""
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(-lengths, kind="stable")
    grid = np.zeros((lengths.max(), len(texts)), np.int32)
    for j, i in enumerate(order.tolist()):
        grid[: lengths[i], j] = texts[i]
    return order, grid, np.searchsorted(-lengths[order], -np.arange(lengths.max()), "left")


class Space:
    """Memory that batches use again."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


def expected(flow: np.ndarray, emit: np.ndarray, pieces: list[np.ndarray], before: np.ndarray, after: np.ndarray, space: Space) -> tuple[np.ndarray, ...]:
    """Expected counts of a batch of pieces, given the distribution of the first state of each and the
    likelihood of what follows it by its last state: transitions, first states, what the step into the
    first state weighs, symbols met, their states. Inside, arrays have states first, pieces last."""
    order, grid, alive = by_length(pieces)
    size, states = grid.shape, len(flow)
    alpha, weigh, scale = space("alpha", size[0], states, size[1]), space("weigh", size[0], states, size[1]), []
    step = np.ascontiguousarray(flow.T, emit.dtype)
    for t in range(size[0]):
        n = alive[t]
        a = before[order].T.astype(emit.dtype) if t == 0 else step @ alpha[t - 1, :, :n]
        weigh[t, :, :n] = emit.take(grid[t, :n], axis=0).T
        a *= weigh[t, :, :n]
        scale.append(a.sum(axis=0))
        np.divide(a, scale[t], out=alpha[t, :, :n])
    step = np.ascontiguousarray(flow, emit.dtype)
    ends = alive - np.append(alive[1:], 0)
    beta, through = np.empty((states, size[1]), emit.dtype), np.zeros((states, states))
    for t in range(size[0] - 1, -1, -1):
        n = alive[t]
        m = n - ends[t]
        if m:
            x = weigh[t + 1, :, :m]
            x *= beta[:, :m]
            x /= scale[t + 1]
            through += alpha[t, :, :m] @ x.T
            beta[:, :m] = step @ x
        if ends[t]:  # pieces whose last place this is
            b = after[order[m:n]].T
            beta[:, m:n] = b / (alpha[t, :, m:n] * b).sum(axis=0)
        alpha[t, :, :n] *= beta[:, :n]
    back = np.argsort(order)
    into = weigh[0] * beta / scale[0]
    here = np.arange(size[1]) < alive[:, None]
    return through * flow, alpha[0].T[back], into.T[back], grid[here], [alpha[:, k][here] for k in range(states)]


def batches_of(texts: list[np.ndarray], cells: int) -> Iterator[list[int]]:
    """Numbers of texts, of like lengths, that fill a grid of so many cells."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    while order:
        n = max(1, cells // len(texts[order[0]]))
        yield order[:n]
        order = order[n:]


def all_pieces(texts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Pieces of texts in order; the first piece of each text; how many pieces it has."""
    pieces = [text[at : at + PIECE] for text in texts for at in range(0, len(text), PIECE)]
    counts = np.array([-(-len(text) // PIECE) for text in texts])
    return pieces, np.cumsum(counts) - counts, counts


def batches(pieces: list[np.ndarray]) -> list[list[np.ndarray]]:
    step = max(1, CELLS // PIECE)
    return [pieces[at : at + step] for at in range(0, len(pieces), step)]


def places(first_piece: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Numbers of the first pieces of texts, of their second ones and so on."""
    return [first_piece[counts > j] + j for j in range(counts.max())]


def baum_welch(start: np.ndarray, flow: np.ndarray, emit: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over whole texts: starts, transitions, words by state."""
    states = len(start)
    starts, through, every = np.zeros(states), np.zeros((states, states)), np.zeros(emit.shape[::-1])
    single, space = emit.astype(np.float32), Space()

    def settle(pieces: list[np.ndarray], before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner, first, into, symbols, gamma = expected(flow, single, pieces, before, after, space)
        through[:] += inner
        for k in range(states):
            every[k] += np.bincount(symbols, gamma[k], len(emit))
        return first, into

    short = [t for t in texts if len(t) <= SHORT]
    for some in batches_of(short, CELLS):
        first, _ = settle([short[i] for i in some], np.tile(start, (len(some), 1)), np.ones((len(some), states)))
        starts += first.sum(axis=0)
    long = [t for t in texts if len(t) > SHORT]
    if long:
        pieces, first_piece, counts = all_pieces(long)
        matrices = np.concatenate([transfer(flow, emit, some)[0] for some in batches(pieces)])
        before, left = np.empty((len(pieces), states)), np.empty((len(pieces), states))
        for live in places(first_piece, counts):
            before[live] = left[live - 1] @ flow
            before[first_piece] = start
            a = np.einsum("ni,nij->nj", before[live], matrices[live])
            left[live] = a / a.sum(axis=1, keepdims=True)
        after = np.ones((len(pieces), states))
        for live in reversed(places(first_piece, counts - 1)):
            b = np.einsum("nij,nj->ni", matrices[live + 1], after[live + 1]) @ flow.T
            after[live] = b / b.sum(axis=1, keepdims=True)
        into = np.empty((len(pieces), states))
        at = 0
        for some in batches(pieces):
            here = slice(at, at + len(some))
            first, into[here] = settle(some, before[here], after[here])
            starts += first[np.isin(np.arange(at, at + len(some)), first_piece)].sum(axis=0)
            at += len(some)
        # Steps from the last state of a piece to the first of the next.
        later = np.setdiff1d(np.arange(len(pieces)), first_piece)
        through += left[later - 1].T @ into[later] * flow
    return starts, through, every.T


def log_likelihood(start: np.ndarray, flow: np.ndarray, emit: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each sequence, by the scaled forward recursion."""
    out = np.zeros(len(texts))
    short = [i for i, t in enumerate(texts) if len(t) <= SHORT]
    for some in batches_of([texts[i] for i in short], CELLS):
        chosen = [short[i] for i in some]
        out[chosen] = forward(start, flow, emit, [texts[i] for i in chosen])
    long = [i for i, t in enumerate(texts) if len(t) > SHORT]
    if long:
        pieces, first_piece, counts = all_pieces([texts[i] for i in long])
        matrices, logs = (np.concatenate(x) for x in zip(*(transfer(flow, emit, some) for some in batches(pieces)), strict=True))
        a, sums = np.tile(start, (len(long), 1)), np.add.reduceat(logs, first_piece)
        for j, live in enumerate(places(first_piece, counts)):
            on = np.flatnonzero(counts > j)
            now = np.einsum("ni,nij->nj", a[on], matrices[live])
            total = now.sum(axis=1)
            sums[on] += np.log10(total)
            a[on] = now / total[:, None] @ flow
        out[long] = sums
    return out


def forward(start: np.ndarray, flow: np.ndarray, emit: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    order, grid, alive = by_length(texts)
    step = np.ascontiguousarray(flow.T)
    a, logs, out = np.tile(start[:, None], len(texts)), np.zeros(len(texts)), np.empty(len(texts))
    for t in range(len(grid)):
        n = alive[t]
        if n < a.shape[1]:
            logs[n : a.shape[1]] += np.log10(a[:, n:].sum(axis=0))
            a = a[:, :n].copy()
        if t:
            a = step @ a
        a *= emit.take(grid[t, :n], axis=0).T
        if t % 8 == 7:
            total = a.sum(axis=0)
            a /= total
            logs[:n] += np.log10(total)
    logs[: a.shape[1]] += np.log10(a.sum(axis=0))
    out[order] = logs
    return out


def transfer(flow: np.ndarray, emit: np.ndarray, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each piece, from the state of its first token to the joint of its tokens and its last state."""
    order, grid, alive = by_length(pieces)
    states, count = len(flow), len(pieces)
    step = np.ascontiguousarray(flow.T)
    # Last state, first state, piece.
    m, logs = np.repeat(np.eye(states)[:, :, None], count, axis=2), np.zeros(count)
    out = np.empty((count, states, states))
    for t in range(len(grid)):
        n = alive[t]
        if n < m.shape[2]:
            out[n : m.shape[2]] = m[:, :, n:].transpose(2, 1, 0)
            m = m[:, :, :n].copy()
        if t:
            m = (step @ m.reshape(states, -1)).reshape(states, states, n)
        m *= np.ascontiguousarray(emit.take(grid[t, :n], axis=0).T)[:, None, :]
        if t % 8 == 7:
            most = m.max(axis=(0, 1))
            m /= most
            logs[:n] += np.log10(most)
    out[: m.shape[2]] = m.transpose(2, 1, 0)
    back = np.argsort(order)
    return out[back], logs[back]


class Start:
    """Which share of a word's counts is whose state's, from a few texts: by word, else by class, else alike."""

    def __init__(self, texts: list[bytes], states: int = STATES):
        places = Places()
        coded = [np.array([places[w] for w in [*words(t), END]]) for t in texts]
        classes = np.array([word_class(w) for w in places], int)
        c = np.bincount(np.concatenate(coded), minlength=len(places)) if coded else np.zeros(0)
        starts, flow, counts = np.ones(states), np.eye(states) * 50 + 1, self.seeds(coded, c, states)
        for _ in range(START_ROUNDS if coded else 0):
            model = model_of(class_sums(classes, c, counts), starts, flow)
            starts, flow, counts = baum_welch(model.start, model.flow, model.emissions(classes, c, counts), coded)
        order = np.argsort(np.array([word_hash(w) for w in places], np.uint64), kind="stable")
        self.start, self.flow = starts, flow
        self.hashes = np.array([word_hash(w) for w in places], np.uint64)[order]
        every = np.stack([np.bincount(classes, counts[:, k], CLASSES + 1) for k in range(states)], axis=1) if coded else np.zeros((CLASSES + 1, states))
        self.by_class = (every + 1 / states) / (every + 1 / states).sum(axis=1, keepdims=True)
        mixed = counts + self.by_class[classes] if coded else counts
        self.by_word = (mixed / np.maximum(mixed.sum(axis=1, keepdims=True), 1e-300))[order]

    @staticmethod
    def seeds(coded: list[np.ndarray], c: np.ndarray, states: int) -> np.ndarray:
        """Counts of texts that differ most, one for each state."""
        counts = np.zeros((len(c), states))
        longest = sorted(coded, key=len, reverse=True)[:100]
        profiles = [np.bincount(t, minlength=len(c)) / np.sqrt(c + 1e-9) for t in longest]
        profiles = [p / np.linalg.norm(p) for p in profiles]
        near = np.zeros(len(profiles))
        for k in range(min(states, len(profiles))):
            chosen = int(np.argmin(near))
            near = np.maximum(near, [float(p @ profiles[chosen]) for p in profiles])
            counts[:, k] = np.bincount(longest[chosen], minlength=len(c))
        return counts

    def counts(self, hashes: np.ndarray, classes: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = self.by_class[classes]
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            met = self.hashes[at] == hashes
            out[met] = self.by_word[at[met]]
        return out * c[:, None]


#: What buckets send: to blocks counts and shares of their words; for later rounds, where a block's words
#: stand in the bucket; sums by class, after which those of transitions and starts come.
SUMS = [*(f"s{i}" for i in range(3 + 2 * STATES))]
ANSWER = "bucket int, block long, c binary, shares binary, at binary, n binary, classes binary, class int, " + ", ".join(f"{s} double" for s in SUMS)


def answers(bucket: int, blocks: list[tuple[int, np.ndarray]], classes: np.ndarray, c: np.ndarray, counts: np.ndarray) -> list[dict]:
    rows = [{"bucket": bucket, "block": block, "c": packed(c[at].astype(np.int64)), "shares": roots(counts[at])} for block, at in blocks]
    sums = class_sums(classes, c, counts)
    return rows + [{"class": int(k), **dict(zip(SUMS, sums[k].tolist(), strict=True))} for k in np.flatnonzero(sums[:, 1])]


def merge(encoded: DataFrame, start: Start) -> DataFrame:
    """First answers of the buckets: training counts over all blocks, and where to start from."""
    sent, types = Sent(encoded.sparkSession, start), arrow_types(encoded.sparkSession, ANSWER)

    def run(key: tuple, of: pa.Table) -> pa.Table:
        bucket, blocks = key[0].as_py(), of.column("block").to_pylist()
        lists = [[unpacked(x.as_py(), kind) for x in of.column(name)] for name, kind in (("words", "u8"), ("classes", "u2"), ("n", "i8"))]
        hashes, first, at = np.unique(np.concatenate(lists[0]), return_index=True, return_inverse=True)
        classes, c = np.concatenate(lists[1])[first], np.bincount(at, np.concatenate(lists[2]))
        ats = np.split(at.astype(np.uint32), np.cumsum([len(x) for x in lists[0]])[:-1])
        rows = answers(bucket, list(zip(blocks, ats, strict=True)), classes, c, sent.value.counts(hashes, classes, c))
        rows += [{"bucket": bucket, "block": b, "at": packed(a), "n": n} for b, a, n in zip(blocks, ats, of.column("n").to_pylist(), strict=True)]
        return as_table([*rows, {"bucket": bucket, "c": packed(c.astype(np.int64)), "classes": packed(classes)}], ANSWER, types)

    words_ = encoded.where("bucket is not null").select("bucket", "block", "words", "classes", "n")
    return materialise(words_.groupBy("bucket").applyInArrow(run, ANSWER), "lm-merge")


def messages(answered: DataFrame) -> DataFrame:
    return answered.where("shares is not null").select("block", "bucket", "c", "shares")


def model_from(answered: DataFrame, start: np.ndarray | None = None, flow: np.ndarray | None = None) -> Model:
    got = answered.where("class is not null").groupBy("class").agg(*(F.sum(s).alias(s) for s in SUMS)).toArrow()
    sums = np.zeros((CLASSES + 2 + STATES, len(SUMS)))
    if got.num_rows:
        sums[got.column("class").to_numpy()] = np.stack([got.column(s).to_numpy() for s in SUMS], axis=1)
    if start is None:
        start, flow = sums[CLASSES + 1, :STATES], sums[CLASSES + 2 :, :STATES]
    return model_of(sums[: CLASSES + 1], start, flow)


def read_block(texts: pa.Table, told: pa.Table, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """(emissions, training counts, numbers in the order of the buckets, bounds of these, rows of texts) of a block."""
    texts, told = texts.sort_by("part"), told.sort_by("bucket")
    order, classes = unpacked(texts.column("words")[0].as_py(), "u4"), unpacked(texts.column("classes")[0].as_py(), "u2")
    each = [unpacked(x.as_py(), "i8") for x in told.column("c")]
    counts = np.concatenate(each).astype(float)
    by_state = np.concatenate([shares(x.as_py()) for x in told.column("shares")]) * counts[:, None]
    emit, c = np.empty(by_state.shape), np.empty(len(counts))
    emit[order], c[order] = model.emissions(classes[order], counts, by_state), counts
    return emit, c, order, np.cumsum([0, *map(len, each)]), texts


def texts_of(texts: pa.Table, row: int) -> list[np.ndarray]:
    return np.split(unpacked(texts.column("symbols")[row].as_py(), "u4"), np.cumsum(texts.column("size")[row].values.to_numpy())[:-1])


PARTIAL = "bucket int, block long, shares binary, sums binary"


def one_round(texts: DataFrame, merged: DataFrame, told: DataFrame, model: Model) -> DataFrame:
    """The buckets' answers after one round of Baum-Welch over all training texts."""
    spark = texts.sparkSession
    sent, types, partial_types = Sent(spark, model), arrow_types(spark, ANSWER), arrow_types(spark, PARTIAL)

    def expect(left: pa.Table, right: pa.Table) -> pa.Table:
        m = sent.value
        emit, _, order, bounds, left = read_block(left, right, m)
        learned = [t for i in range(left.num_rows) for t, train in zip(texts_of(left, i), left.column("train")[i].as_py(), strict=True) if train]
        start, flow, every = baum_welch(m.start, m.flow, emit, learned)
        own, block, buckets = every[order], left.column("block")[0].as_py(), sorted(right.column("bucket").to_pylist())
        rows = [{"bucket": b, "block": block, "shares": roots(own[low:high])} for b, low, high in zip(buckets, bounds, bounds[1:], strict=False)]
        # Any bucket will do for transitions and starts.
        return as_table([*rows, {"bucket": buckets[block % len(buckets)], "sums": np.vstack([start, flow]).tobytes()}], PARTIAL, partial_types)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        vocabulary = next(r for r in left.filter(left.column("classes").is_valid()).to_pylist())
        classes, c = unpacked(vocabulary["classes"], "u2"), unpacked(vocabulary["c"], "i8").astype(float)
        places = {r["block"]: r for r in left.filter(left.column("at").is_valid()).select(["block", "at", "n"]).to_pylist()}
        counts, blocks, through = np.zeros((len(c), STATES)), [], np.zeros((1 + STATES, STATES))
        for block, share, sums in zip(*(right.column(x) for x in ("block", "shares", "sums")), strict=True):
            if sums.is_valid:
                through += np.frombuffer(sums.as_py()).reshape(-1, STATES)
                continue
            at, n = (unpacked(places[block.as_py()][x], kind) for x, kind in (("at", "u4"), ("n", "i8")))
            here = shares(share.as_py()) * n[:, None]
            for k in range(STATES):
                counts[:, k] += np.bincount(at, here[:, k], len(c))
            blocks.append((block.as_py(), at))
        rows = answers(vocabulary["bucket"], blocks, classes, c, counts)
        rows += [{"class": CLASSES + 1 + i, **dict(zip(SUMS, row.tolist(), strict=False))} for i, row in enumerate(through)]
        return as_table(rows, ANSWER, types)

    partial = texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(expect, PARTIAL)
    static = merged.where("at is not null or classes is not null").select("bucket", "block", "c", "at", "n", "classes")
    return materialise(static.groupBy("bucket").cogroup(partial.groupBy("bucket")).applyInArrow(add, ANSWER), "lm-round")


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_c double, hmm double"


def hmm_scores(texts: DataFrame, told: DataFrame, model: Model) -> DataFrame:
    """Of each text: tokens, known ones, log10 of all counts, log10 likelihood."""
    sent, types = Sent(texts.sparkSession, model), arrow_types(texts.sparkSession, SCORED)
    names = [x.split()[0] for x in SCORED.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m = sent.value
        emit, c, _, _, left = read_block(left, right, m)
        log, out = np.log10(c + ADD), []
        for i in range(left.num_rows):
            codes = texts_of(left, i)
            begin = np.cumsum([0, *map(len, codes[:-1])])
            flat, sizes = np.concatenate(codes), left.column("size")[i].values
            sums = [np.add.reduceat((c > 0)[flat].astype(np.int64), begin), np.add.reduceat(log[flat], begin), log_likelihood(m.start, m.flow, emit, codes)]
            columns = [left.column("doc_id")[i].values, left.column("held_out")[i].values, sizes, *sums]
            out.append(pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names))
        return pa.concat_tables(out)

    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, SCORED)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    held, train = training_row(doc_id, MODULUS, HELD)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), train.alias("train"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(F.col("train")).alias("learned")).first()
    encoded = bucketed(encode(rows, 1 + (size.bytes or 0) // BUCKET), "block", 1 + 2 * (size.bytes or 0) // BLOCK, "lm_blocks")
    few = few_by_hash(rows.where("train").where(F.coalesce(F.length("text"), F.lit(0)) <= START_SIZE).select("doc_id", "row", "text"), ["doc_id", "row"], START_TEXTS, size.learned)
    start = Start([(r.text or "").encode() for r in few.collect()])
    merged = told = merge(encoded, start)
    model = model_from(merged, start.start, start.flow)
    tokens, log_total = model.tokens, float(np.log10(model.tokens + ADD * (model.distinct + 1)))
    texts = encoded.where("bucket is null")
    learning = texts.select("block", "part", "train", "size", "symbols", "words", "classes")
    for _ in range(ROUNDS if size.learned else 0):
        now = one_round(learning, merged, messages(told), model)
        if told is not merged:
            discard(spark, told)
        told, model = now, model_from(now)
    scored = hmm_scores(texts.drop("train", "bucket", "n"), messages(told), model)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log_c") - F.col("n_tokens") * F.lit(log_total)).alias("base_score"), F.col("hmm").alias("score"),
    )


def op10_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
