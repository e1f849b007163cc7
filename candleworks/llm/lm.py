"""Language-model scores from a weighted backoff automaton.

The model has words and one end token, and n-grams of up to three of them. A state is a
history seen in training: none (the root), a word or the start, or two words. An arc is
an n-gram seen in training, with the smoothed log-probability of its last word; the
failure arc of a state leads to the history without its first word, with the log of
the weight that the smoothing gives to shorter histories:

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | h) = (c(h, w) + m p(w | shorter h)) / (c(h) + m)      failure: m / (c(h) + m)

m is one number for each length of history: the one at which the weight given away,
over all training tokens, equals the share of tokens whose n-gram is seen once, which is
the leave-one-out estimate of what is new. Both sides come from counts over all training
texts. A text is read once from left to right: each token takes the arc of the state, or
failure arcs until there is one; weights add up.

The automaton grows with the corpus and is never in one place. Texts are dealt in blocks
by their place in the input and written once. Each block asks for the training counts of
its distinct words (as they are) and n-grams of two and three words (as hashes); buckets
of keys add up the counts of all blocks and answer with those of the others in the order
asked, so that answers carry no keys; a block then builds the arcs that its own texts can take. Blocks lie in
a bucketed table, so that only the answers are shuffled to them.

Beyond 2**`first_bits` buckets (32 GB of text by default) blocks ask in two steps. They are
dealt to parts, and ask the wide buckets of their part; these add up what their blocks ask,
ask the narrow buckets with the sums, and pass the answers on. A word that every block holds
is then asked for once by each part, not by each block, a block always asks for hundreds of
keys in a row, and a group holds as much as a narrow bucket does, at any size.

Counts of words are exact. Hashes of n-grams have log2 of the tokens and 23 more bits, 61
at most: about one n-gram in 1e7 shares its count with another up to 2 TB of text, and more
in proportion beyond.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE, carried, durable, hash_spans, mix64, release, share, shared_folder, slices, spans_of, utf8

_STEP = np.uint64(0x9FB21C651E98DF25)
END, START = np.uint64(0xA3B195354A39B70D), np.uint64(0x51ED270B9F3C2A17)  # keys of the text's end and start
ORDERS = (1, 2, 3)
BLOCKS_IN_CHUNK = 6


# ---------------------------------------------------------------- numbers in transit


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers from 0: how many, then as few bytes of each as the largest needs;
    all first bytes, all second ones and so on, each compressed where that helps."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    compress = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True).compress
    out = [len(values).to_bytes(4, "little")]
    for plane in planes:
        raw = plane.tobytes()
        small = compress(raw)
        small = small if len(small) < len(raw) else raw
        out += [len(small).to_bytes(4, "little"), small]
    return b"".join(out)


def restored(raw: bytes) -> np.ndarray:
    n, at, width = int.from_bytes(raw[:4], "little"), 4, 0
    out = np.zeros((n, 8), dtype=np.uint8)
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 4], "little")
        part = raw[at + 4 : at + 4 + size]
        out[:, width] = np.frombuffer(part if size == n else zstandard.ZstdDecompressor().decompress(part), dtype=np.uint8)
        at, width = at + 4 + size, width + 1
    return out.view("<u8").ravel().astype(np.uint64)


@dataclass(frozen=True)
class Keys:
    """n-gram hashes of `bits` bits, in buckets of their first `bucket_bits`."""

    bits: int
    bucket_bits: int

    def bucket_of_word(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(1) >> np.uint64(63 - self.bucket_bits)).astype(np.int64)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(self.bits - self.bucket_bits)).astype(np.int64)

    def pack(self, keys: np.ndarray) -> bytes:
        """Rising keys of one bucket, as steps."""
        part = keys & np.uint64((1 << (self.bits - self.bucket_bits)) - 1)
        part[1:] -= part[:-1].copy()
        return squeezed(part)

    def unpack(self, raw: bytes) -> np.ndarray:
        return np.cumsum(restored(raw), dtype=np.uint64)


def edges(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)


# ---------------------------------------------------------------- the texts of a block


class Block:
    """Tokens of some texts: numbers of their words in the block's own vocabulary,
    which goes by hash; behind it come the end and the start."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        data = LOWER[data]
        start, end, doc = spans_of(data, offsets, SPACE)
        stops = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(stops), pa.py_buffer(data[~SPACE[data]])]).dictionary_encode()
        ends = np.frombuffer(coded.dictionary.buffers()[1], dtype=np.int32)[: len(coded.dictionary) + 1].astype(np.int64)
        letters = np.frombuffer(coded.dictionary.buffers()[2], dtype=np.uint8) if len(coded.dictionary) else np.empty(0, np.uint8)
        hashes = hash_spans(letters, ends[:-1], ends[1:])
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.vocabulary = coded.dictionary.take(pa.array(order))
        self.hashes = np.concatenate([hashes[order], [END, START]])
        self.end, self.start = len(order), len(order) + 1
        self.token = np.full(len(start) + n, self.end, dtype=np.int32)
        self.token[np.arange(len(start)) + doc] = rank[coded.indices.to_numpy()]
        self.length = np.bincount(doc, minlength=n) + 1
        self.first = np.cumsum(self.length) - self.length
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        self.before[self.first] = self.start
        inner = np.ones(len(self.token), dtype=bool)
        inner[self.first] = False
        self.inner = np.flatnonzero(inner).astype(np.int32)

    def pairs(self) -> np.ndarray:
        """Hash of the pair that each token ends."""
        return mix64(self.hashes[self.before] * _STEP + self.hashes[self.token])

    def triples(self) -> np.ndarray:
        """Hash of the triple that each token ends, but for first tokens."""
        return mix64(self.pairs()[self.inner - 1] * _STEP + self.hashes[self.token[self.inner]])


def counted(block: Block, train: np.ndarray, keys: Keys):
    """Rising distinct keys of pairs and of triples, their training counts in the block,
    and whether they end a text."""
    learn = np.repeat(train, block.length)
    for hashed, where in ((block.pairs, slice(None)), (block.triples, block.inner)):
        end = (block.token[where] == block.end).astype(np.uint64)
        marked = np.sort((hashed() >> np.uint64(64 - keys.bits)) << np.uint64(2) | end << np.uint64(1) | learn[where].astype(np.uint64))
        at = edges(marked >> np.uint64(2))
        count = np.add.reduceat(marked & np.uint64(1), at[:-1]) if len(at) > 1 else np.empty(0, np.uint64)
        yield marked[at[:-1]] >> np.uint64(2), count, (marked[at[:-1]] >> np.uint64(1)) & np.uint64(1)


def words_counted(block: Block, train: np.ndarray) -> np.ndarray:
    return np.bincount(block.token[np.repeat(train, block.length)], minlength=block.end + 1)[: block.end]


def own_counts(block: Block, train: np.ndarray, keys: Keys) -> dict[int, np.ndarray]:
    """Training counts in the block, by order, in the order asked."""
    pairs, triples = ((count.astype(np.int64)) for _, count, _ in counted(block, train, keys))
    return {1: words_counted(block, train), 2: pairs, 3: triples}


def asked(block: Block, train: np.ndarray, keys: Keys):
    """For each order: buckets, keys as bytes, and training counts in the block; the
    lowest bit of a pair's count says whether it ends a text."""
    ids = words_counted(block, train)
    bucket = keys.bucket_of_word(block.hashes[: block.end])
    at = edges(bucket)
    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), block.vocabulary)
    compress = zstandard.ZstdCompressor(level=3).compress
    for words, a, b in zip(pc.binary_join(lists, b" ").to_pylist() if len(bucket) else [], at, at[1:], strict=False):
        yield 1, int(bucket[a]), compress(words), squeezed(ids[a:b])
    for order, (key, count, end) in zip((2, 3), counted(block, train, keys), strict=True):
        bucket = keys.bucket(key)
        if order == 2:
            count = count << np.uint64(1) | end
        at = edges(bucket)
        for a, b in zip(at, at[1:], strict=False):
            yield order, int(bucket[a]), keys.pack(key[a:b]), squeezed(count[a:b])


# ---------------------------------------------------------------- counts over all blocks


def classes(counts: np.ndarray) -> np.ndarray:
    """Classes of counts for the sums: each count up to 64 by itself, then 16 to an octave."""
    return np.where(counts <= 64, counts, 64 + np.ceil(16 * (np.log2(np.maximum(counts, 1)) - 6)).astype(np.int64))


ASKED = "order int, bucket long, chunk long, block long, keys binary, counts binary"
ANSWERED = "order int, bucket long, chunk long, block long, counts binary, class int, n long, total long, history long"


class Heard:
    """What is asked of one bucket, row by row: keys as numbers of the distinct ones, and
    the counts that come with them. Keys of pairs and triples are numbered as they rise."""

    def __init__(self, table: pa.Table, keys: Keys):
        self.order = int(table.column("order")[0].as_py())
        raw = table.column("keys").to_pylist()
        own = [restored(c) for c in table.column("counts").to_pylist()]
        self.size = np.array([len(c) for c in own])
        own = np.concatenate(own)
        history = np.ones(len(own), dtype=bool)
        if self.order == 1:
            texts = pa.array([zstandard.ZstdDecompressor().decompress(r) for r in raw], pa.binary())
            coded = pc.split_pattern(texts, b" ").flatten().dictionary_encode()
            self.which, self.distinct = coded.indices.to_numpy(), coded.dictionary
        else:
            if self.order == 2:
                history, own = (own & np.uint64(1)) == 0, own >> np.uint64(1)
            key = np.concatenate([keys.unpack(r) for r in raw])
            by = np.argsort(key)
            key = key[by]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            self.which = np.empty(len(key), dtype=np.int32)
            self.which[by] = np.cumsum(new, dtype=np.int32) - 1
            self.distinct = key[new]
            del key, by, new
        self.own = own.astype(np.int64)
        self.total = np.bincount(self.which, weights=self.own.astype(np.float64)).astype(np.int64)
        self.leads = np.zeros(len(self.total), dtype=bool)  # whether the key is a history
        self.leads[self.which] = history

    def replies(self, total: np.ndarray) -> list[bytes]:
        """For each row the total of each key without what the row itself counts."""
        back = total[self.which] - self.own
        cut = np.cumsum(self.size)
        return [squeezed(back[b - s : b]) for s, b in zip(self.size, cut, strict=True)]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words in order of (hash, word), as numbers, and the hashes."""
        by = pc.sort_indices(self.distinct).to_numpy()
        sizes = pc.binary_length(self.distinct).to_numpy()
        ends = np.cumsum(sizes, dtype=np.int64)
        letters = np.frombuffer(b"".join(self.distinct.to_pylist()), dtype=np.uint8)
        hashes = hash_spans(letters, ends - sizes, ends)
        by = by[np.argsort(hashes[by], kind="stable")]
        return by, hashes[by]


def gathered(near: Keys, far: Keys):
    """The sums of what the blocks of a part ask of a wide bucket, as rows for the narrow
    buckets in it; the part stands for the block."""

    def run(table: pa.Table) -> pa.Table:
        heard = Heard(table, near)
        order, total = heard.order, heard.total
        if order == 1:
            by, hashes = heard.words()
            bucket, total = far.bucket_of_word(hashes), total[by]
        else:
            # the bits of the wide bucket, which packing leaves out
            key = heard.distinct + (np.uint64(table.column("bucket")[0].as_py()) << np.uint64(near.bits - near.bucket_bits))
            bucket = far.bucket(key)
        counts = total.astype(np.uint64)
        if order == 2:
            counts = counts << np.uint64(1) | (~heard.leads).astype(np.uint64)
        at = edges(bucket)
        if order == 1:
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), heard.distinct.take(pa.array(by)))
            packed = [zstandard.ZstdCompressor(level=3).compress(words) for words in pc.binary_join(lists, b" ").to_pylist()]
        else:
            packed = [far.pack(key[a:b]) for a, b in zip(at, at[1:], strict=False)]
        n = len(packed)
        part = table.column("part")[0].as_py()
        return pa.table(
            [pa.array([order] * n, pa.int32()), pa.array(bucket[at[:-1]], pa.int64()), pa.nulls(n, pa.int64()), pa.array([part] * n, pa.int64())]
            + [pa.array(packed, pa.binary()), pa.array([squeezed(counts[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())],
            names=["order", "bucket", "chunk", "block", "keys", "counts"],
        )

    return run


def passed_on(near: Keys):
    """The answers that a part got from narrow buckets, to its blocks."""

    def run(table: pa.Table, answered: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())], names=["order", "bucket", "chunk", "block", "counts"])
        heard = Heard(table, near)
        told = sorted(zip(answered.column("bucket").to_pylist(), answered.column("counts").to_pylist(), strict=True))
        others = np.concatenate([restored(c) for _, c in told]).astype(np.int64)
        total = heard.total.copy()
        total[heard.words()[0] if heard.order == 1 else slice(None)] += others
        return pa.table([*[table.column(c) for c in ("order", "bucket", "chunk", "block")], pa.array(heard.replies(total), pa.binary())], names=["order", "bucket", "chunk", "block", "counts"])

    return run


def answers(keys: Keys):
    """All that is asked of one bucket to the counts of the other blocks, in the order
    asked; and sums over the distinct keys by class of count (block is null)."""

    def run(table: pa.Table) -> pa.Table:
        heard = Heard(table, keys)
        heard.distinct = None
        order, total, leads, n = heard.order, heard.total, heard.leads, table.num_rows
        found, of, number = np.unique(classes(total[total > 0]), return_inverse=True, return_counts=True)
        amount = np.bincount(of, weights=total[total > 0], minlength=len(found)).astype(np.int64)
        context = np.bincount(of, weights=leads[total > 0], minlength=len(found)).astype(np.int64)
        m = len(found)
        none = lambda k, kind: pa.nulls(k, kind)
        long = pa.int64()
        columns = [
            pa.array(np.full(n + m, order, np.int32)),
            pa.array(np.full(n + m, table.column("bucket")[0].as_py(), np.int64)),
            pa.concat_arrays([table.column("chunk").combine_chunks(), none(m, long)]),
            pa.concat_arrays([table.column("block").combine_chunks(), none(m, long)]),
            pa.array(heard.replies(total) + [None] * m, pa.binary()),
            pa.concat_arrays([none(n, pa.int32()), pa.array(found.astype(np.int32))]),
            *[pa.concat_arrays([none(n, long), pa.array(x.astype(np.int64))]) for x in (number, amount, context)],
        ]
        return pa.table(columns, names=["order", "bucket", "chunk", "block", "counts", "class", "n", "total", "history"])

    return run


@dataclass
class Smoothing:
    train_tokens: int
    vocabulary: int
    texts: int  # for training: the count of the start and of the end
    given: tuple[float, float]  # m for histories of one word and of two

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.train_tokens + self.vocabulary + 1)


def weight_given(number: np.ndarray, mean: np.ndarray, new: float) -> float:
    """m at which histories (`number` of them with the count `mean`) give away `new`
    tokens in all: sum of number * mean * m / (mean + m)."""
    low, high = 1e-3, 1e6
    for _ in range(100):
        middle = (low * high) ** 0.5
        if (number * mean * middle / (mean + middle)).sum() < new:
            low = middle
        else:
            high = middle
    return high


def smoothing(found: DataFrame, texts: int) -> Smoothing:
    """The model's few numbers, from the sums over all buckets: at most some hundred
    classes an order reach the driver."""
    rows = found.where("block is null").groupBy("order", "class").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("history").alias("history")).collect()
    by = {k: sorted((r["class"], r.n, r.total, r.history) for r in rows if r.order == k) for k in ORDERS}
    words, vocabulary = sum(r[2] for r in by[1]), sum(r[1] for r in by[1])
    given = []
    for k in (2, 3):
        number = np.array([r[3] for r in by[k - 1]] + [int(texts > 0)] * (k == 2), dtype=float)
        mean = np.array([r[2] / r[1] for r in by[k - 1]] + [texts] * (k == 2), dtype=float)
        given.append(weight_given(number, mean, sum(r[1] for r in by[k] if r[0] == 1)))
    return Smoothing(words + texts, vocabulary + (texts > 0), texts, tuple(given))


# ---------------------------------------------------------------- the automaton


def numbered(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each key among the distinct ones, and how many these are."""
    by = np.argsort(keys)
    keys = keys[by]
    rank = np.empty(len(keys), dtype=np.int32)
    rank[by] = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]]), dtype=np.int32) if len(keys) else 0
    return rank, int(rank[by[-1]]) + 1 if len(keys) else 0


class Automaton:
    """States and arcs that the texts of a block can take.

    State 0 is the root, 1 + w the history of word w of the block, and behind these come
    the pairs that were seen. Root arcs are a table by word; all other arcs are sorted
    by state and word."""

    def __init__(self, block: Block, counts: dict[int, np.ndarray], keys: Keys, model: Smoothing):
        self.block = block
        vocabulary = block.start + 1
        word = np.concatenate([counts[1], [model.texts, model.texts]]).astype(np.float64)
        self.known = word > 0
        shift = np.uint64(64 - keys.bits)
        pair, n_pairs = numbered(block.pairs() >> shift)
        assert n_pairs == len(counts[2])
        seen = counts[2][pair] > 0
        self.root = np.log10(p1 := model.unigram(word))
        self.root_next = np.where(self.known, 1 + np.arange(vocabulary), 0)
        m2, m3 = model.given
        # arcs of one-word histories, one for each seen pair, at its first place in the block
        at = np.zeros(n_pairs, dtype=np.int64)
        at[pair[::-1]] = np.arange(len(pair))[::-1]
        at = at[counts[2] > 0]
        state_of_pair = np.full(n_pairs, -1)
        state_of_pair[counts[2] > 0] = 1 + vocabulary + np.arange(len(at))
        h, w, c = block.before[at], block.token[at], counts[2][counts[2] > 0].astype(np.float64)
        p2 = (c + m2 * p1[w]) / (word[h] + m2)
        arcs = [(1 + h, w, np.log10(p2), np.arange(len(at)) + 1 + vocabulary)]
        # arcs of two-word histories
        inner = block.inner
        triple, n_triples = numbered(block.triples() >> shift)
        assert n_triples == len(counts[3])
        place = np.zeros(n_triples, dtype=np.int64)
        place[triple[::-1]] = inner[::-1]
        del triple
        some = (counts[3] > 0) & seen[place] & seen[place - 1] if n_triples else np.zeros(0, bool)
        place, c3 = place[some], counts[3][some].astype(np.float64)
        left, right = state_of_pair[pair[place - 1]], state_of_pair[pair[place]]
        p3 = (c3 + m3 * p2[right - 1 - vocabulary]) / (c[left - 1 - vocabulary] + m3)
        arcs.append((left, block.token[place], np.log10(p3), right))
        key = np.concatenate([state * vocabulary + label for state, label, _, _ in arcs])
        order = np.argsort(key)
        self.key = key[order]
        self.weight, self.after = (np.concatenate([arc[k] for arc in arcs])[order] for k in (2, 3))
        # failure arcs: of a pair to its last word, of a word to the root
        self.failure = np.concatenate([[0], np.zeros(vocabulary, np.int64), 1 + w])
        lost = np.concatenate([[1.0], m2 / (word + m2), m3 / (c + m3)])
        self.failure_weight = np.log10(lost)

    def arc(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each state has an arc for the word, and which."""
        if not len(self.key):
            return np.zeros(len(state), bool), np.zeros(len(state), np.int64)
        wanted = state * (self.block.start + 1) + word
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return self.key[at] == wanted, at

    def read(self, lanes: int = 4096) -> np.ndarray:
        """Log-probability of each token. The stream of all texts is cut into lanes that
        are read side by side; a state holds two words at most, so a lane that begins
        two tokens early is in the right state at its own first token."""
        token = self.block.token
        n = len(token)
        length = max(64, -(-n // lanes))
        start = np.arange(0, n, length)
        opening = np.zeros(n, dtype=bool)
        opening[self.block.first] = True
        begin = 1 + self.block.start if self.known[self.block.start] else 0
        out = np.zeros(n)
        state = np.zeros(len(start), dtype=np.int64)
        for t in range(-2, length):
            lane = np.flatnonzero((start + t >= 0) & (start + t < n))
            at = start[lane] + t
            word = token[at]
            now = np.where(opening[at], begin, state[lane])
            gained, after = np.zeros(len(at)), np.zeros(len(at), dtype=np.int64)
            todo = np.arange(len(at))
            while len(todo):
                rooted = now[todo] == 0
                if rooted.any():
                    these = todo[rooted]
                    gained[these] += self.root[word[these]]
                    after[these] = self.root_next[word[these]]
                    todo = todo[~rooted]
                found, arc = self.arc(now[todo], word[todo])
                these = todo[found]
                gained[these] += self.weight[arc[found]]
                after[these] = self.after[arc[found]]
                todo = todo[~found]
                gained[todo] += self.failure_weight[now[todo]]
                now[todo] = self.failure[now[todo]]
            state[lane] = after
            if t >= 0:
                out[at] = gained
        return out


# ---------------------------------------------------------------- the job


def blocks_of(docs: DataFrame, train, text_col: str, names: list[str], block_bytes: int, buckets: int) -> DataFrame:
    """Texts in blocks of about block_bytes, with the carried columns of their rows:
    written once, bucketed by chunk (a few blocks that lie together)."""
    kept = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(names)]
    row = T.StructType([T.StructField("train", T.BooleanType()), *kept])
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("block", T.LongType()), T.StructField("texts", T.BinaryType()), T.StructField("lengths", T.BinaryType()), T.StructField("rows", T.ArrayType(row))])
    rows = docs.select(F.coalesce(train, F.lit(False)).alias("train"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)], F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        part, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            values = pa.StructArray.from_arrays([batch.column(f.name) for f in row.fields], names=row.names)
            for i, j in slices(offsets, block_bytes):
                text = zstandard.ZstdCompressor(level=3).compress(data[offsets[i] : offsets[j]].tobytes())
                columns = [[part + number // BLOCKS_IN_CHUNK], [part + number], [text], [squeezed(np.diff(offsets[i : j + 1]))]]
                arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), values.slice(i, j - i))], names=schema.names)
                number += 1

    name = f"candleworks_{uuid.uuid4().hex}"
    made = rows.mapInArrow(run, schema)
    made.write.bucketBy(buckets, "chunk").option("path", f"{shared_folder(docs.sparkSession)}/{name}").saveAsTable(name)
    table = docs.sparkSession.table(name)
    docs.sparkSession.sql(f"DROP TABLE {name}")  # the name alone: with a path of its own, the files stay
    return table


def block_of(texts: bytes, lengths: bytes) -> Block:
    raw = zstandard.ZstdDecompressor().decompress(texts)
    return Block(np.frombuffer(raw, dtype=np.uint8), np.concatenate([[0], np.cumsum(restored(lengths).astype(np.int64))]))


def score(docs: DataFrame, train, text_col: str = "text", keep=None, block_bytes: int = 3 << 20, bucket_bytes: int = 16 << 20, first_bits: int = 11) -> DataFrame:
    """docs with held_out (not `train`, a boolean column expression), n_tokens,
    n_known, train_tokens, base_score and score, log10 probabilities of the text.

    Null and empty texts are the end token alone. Rows need no ids; null, repeated and
    text ids are carried like any column. Without training texts all tokens are
    unknown, and score is base_score. A text is never cut: one longer than block_bytes
    is a block by itself. Columns of docs named like the results are replaced.
    """
    made = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    names = carried(docs, keep, made)
    size, texts = docs.agg(F.sum(F.octet_length(text_col) + 1), F.count_if(train)).first()
    size = size or 1
    buckets = int(np.clip(np.ceil(np.log2(size / bucket_bytes)), 0, 24)) if size > bucket_bytes else 0
    bits = min(61, int(size).bit_length() + 20)  # a token has 6 bytes or so
    far, keys = Keys(bits, buckets), Keys(bits, min(buckets, first_bits))
    steps = buckets - keys.bucket_bits  # bits of the parts; none: blocks ask narrow buckets
    blocks = blocks_of(docs, train, text_col, names, block_bytes, int(np.clip(size // max(2 * block_bytes, 2 << 20), 16, 100_000)))

    def ask(batches):
        for batch in batches:
            for chunk, block, text, lengths, rows in zip(*(batch.column(c) for c in ("chunk", "block", "texts", "lengths", "rows")), strict=True):
                learn = rows.values.field("train").to_numpy(zero_copy_only=False)
                rows = list(zip(*asked(block_of(text.as_py(), lengths.as_py()), learn, keys), strict=True))
                order, bucket, raw, counts = rows or ([],) * 4
                n = len(order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order, pa.int32()), pa.array(bucket, pa.int64()), pa.array([chunk.as_py()] * n, pa.int64()), pa.array([block.as_py()] * n, pa.int64()), pa.array(raw, pa.binary()), pa.array(counts, pa.binary())],
                    names=["order", "bucket", "chunk", "block", "keys", "counts"],
                )

    asks = blocks.select("chunk", "block", "texts", "lengths", F.transform("rows", lambda r: F.struct(r["train"].alias("train"))).alias("rows")).mapInArrow(ask, ASKED)
    answered = lambda rows: rows.repartition(min(len(ORDERS) << buckets, 200_000), "order", "bucket").groupBy("order", "bucket").applyInArrow(answers(far), ANSWERED)
    if not steps:
        found = durable(answered(asks))
    else:
        asks = durable(asks.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(1 << steps))))
        sums = durable(answered(asks.groupBy("order", "bucket", "part").applyInArrow(gathered(keys, far), ASKED)))
        told = sums.where("block is not null").select("order", F.shiftright("bucket", steps).alias("wide"), F.col("block").alias("part"), "bucket", "counts")
        met = asks.groupBy("order", "bucket", "part").cogroup(told.groupBy("order", "wide", "part"))
        passed = met.applyInArrow(passed_on(keys), "order int, bucket long, chunk long, block long, counts binary")
        found = durable(passed.unionByName(sums.where("block is null"), allowMissingColumns=True))
        release(asks, sums)
    model = share(docs.sparkSession, smoothing(found, texts))
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("held_out", T.BooleanType())] + [T.StructField(c, T.LongType()) for c in made[1:4]] + [T.StructField(c, T.DoubleType()) for c in made[4:]])

    def read(mine: pa.Table, counted: pa.Table) -> pa.Table:
        numbers = model()
        by: dict[tuple[int, int], list] = {}
        for block, order, bucket, counts in zip(*(counted.column(c).to_pylist() for c in ("block", "order", "bucket", "counts")), strict=True):
            by.setdefault((block, order), []).append((bucket, counts))
        parts = []
        for block, text, lengths, rows in zip(*(mine.column(c) for c in ("block", "texts", "lengths", "rows")), strict=True):
            tokens = block_of(text.as_py(), lengths.as_py())
            lists = {k: [restored(c).astype(np.int64) for _, c in sorted(by.pop((block.as_py(), k), []))] for k in ORDERS}
            others = {k: np.concatenate(x) if x else np.empty(0, np.int64) for k, x in lists.items()}
            learn = rows.values.field("train").to_numpy(zero_copy_only=False)
            counts = {k: others[k] + own for k, own in own_counts(tokens, learn, keys).items()}
            machine = Automaton(tokens, counts, keys, numbers)
            add = lambda x, first=tokens.first: np.add.reduceat(x, first)
            values = rows.values
            parts.append(
                pa.table(
                    [*[values.field(f"k{i}") for i in range(len(names))], pc.invert(values.field("train")), pa.array(tokens.length), pa.array(add(machine.known[tokens.token].astype(np.int64)))]
                    + [pa.array(np.full(len(values), numbers.train_tokens)), pa.array(add(machine.root[tokens.token])), pa.array(add(machine.read()))],
                    names=schema.names,
                )
            )
        return pa.concat_tables(parts) if parts else pa.table({f: [] for f in schema.names})

    told = found.where("block is not null").select("chunk", "block", "order", "bucket", "counts")
    return blocks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(read, schema)
