"""Log-bilinear language model, trained in numpy with noise-contrastive estimation.

Words are counted over all training documents. What the model tells apart grows with them: five times the cube root of
the training tokens are words with an output of their own, the most frequent ones; the others share
outputs by their endings, and an output by their counts. A context is the three outputs before a token, each embedding
weighed by a vector of its position, and added up. Outputs are dealt to classes of equal mass; one head predicts the
class and one the output, and both learn from batches of training tokens by telling each from noise outputs drawn by
frequency, in matrix products of a batch with its noise. Every task learns on its own documents from the same
parameters, which are then averaged by the number of tokens learned from, round by round.

Scores are normalised exactly: a softmax over the classes, one over the outputs of the token's class, and the share
of the word in its output, all in matrix products of whole batches.

Documents are tokenised once, in blocks that hold numbers in place of words. A block sends the hashes and counts of its distinct words to buckets and gets
the totals back, so what is exchanged follows the distinct words of the blocks and not the tokens.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.minhash import mixed
from twinsift.llm.scratch import NULL_ID, Scratch, block_rows
from twinsift.llm.substrings import _rows

#: Embedding size, outputs before a token that its context holds.
SIZE, CONTEXT = 16, 3
#: Words with an output of their own are at least so many, and so many times the cube root of the training tokens; there
#: is one shared output for so many of them.
LEAST_WORDS, WORDS_PER_ROOT, WORDS_PER_TAIL = 1024, 5, 4
#: Tokens of a batch, noise outputs and noise classes drawn for it, and the rate of learning.
BATCH, NOISE, RATE = 1024, 48, 0.2
#: Rounds of averaging; in each, every training token is learned from once, whatever the size of the corpus.
ROUNDS = 1
#: Bytes of text that a task learns from before averages are taken, at least where there are as many.
LEARN_BYTES = 32 << 20
#: Tokens scored at once, and numbers of the parameters that are averaged in one row.
CHUNK, PART = 1 << 16, 1 << 16
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 64
#: Buckets that one task counts, one after the other, at most on average.
TASK_BUCKETS = 16
FOLDS, HELD_OUT = 5, 1
#: Endings are told apart by so many hashes.
ENDINGS = 1 << 16
#: No word holds white space, so this stands for the end of a text.
END = b"\n"
_LN10 = np.log(10)


def held_out(ids: np.ndarray) -> np.ndarray:
    text = ["" if i == NULL_ID else str(i) for i in ids.tolist()]
    return np.array([zlib.crc32(t.encode()) % FOLDS == HELD_OUT for t in text], bool)


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


class Outputs:
    """What the model predicts: words by themselves, from the end of a text on, and shared outputs of all others.

    ``hashes`` and ``counts`` are of the words; ``tails`` (ending: tokens, distinct words) of all others.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tails: dict[int, tuple[int, int]]):
        self.words = len(hashes)
        self.tail = 1 << max(5, (self.words // WORDS_PER_TAIL).bit_length() - 1)
        self.number = np.argsort(hashes)
        self.sorted = hashes[self.number]
        tokens, distinct = np.zeros(self.tail), np.zeros(self.tail)
        for e, (n, v) in tails.items():
            tokens[e % self.tail] += n
            distinct[e % self.tail] += v
        self.shares = tokens + 0.5 * (distinct + 1)
        mass = np.concatenate([counts, tokens]) + 0.5
        self.size = len(mass)
        self.unigram = mass / mass.sum()
        order = np.argsort(-mass, kind="stable")
        n = int(np.ceil(np.sqrt(self.size)))
        cut = np.minimum((np.cumsum(mass[order]) - mass[order]) / mass.sum() * n, n - 1).astype(np.int64)
        cut = np.unique(cut, return_inverse=True)[1]
        self.class_of = np.empty(self.size, np.int64)
        self.class_of[order] = cut
        self.members = [order[cut == k] for k in range(cut[-1] + 1)]
        self.place = np.empty(self.size, np.int64)
        for m in self.members:
            self.place[m] = np.arange(len(m))
        self.class_unigram = np.bincount(self.class_of, self.unigram)

    def of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, hashes), self.words - 1)
        return np.where(self.sorted[at] == hashes, self.number[at], self.words + endings % self.tail)

    def shared(self, outputs: np.ndarray) -> np.ndarray:
        return outputs >= self.words


class Model:
    """Parameters as one vector and as named views of it."""

    def __init__(self, outputs: Outputs, flat: np.ndarray | None = None, seed: int = 7):
        n, c = outputs.size, len(outputs.members)
        shapes = {"context": (n, SIZE), "position": (CONTEXT, SIZE), "word": (n, SIZE), "word_bias": (n,), "class": (c, SIZE), "class_bias": (c,)}
        total = sum(int(np.prod(x)) for x in shapes.values())
        fresh = flat is None
        self.flat = np.zeros(total, np.float32) if fresh else flat.astype(np.float32)
        self.part, at = {}, 0
        for name, shape in shapes.items():
            size = int(np.prod(shape))
            self.part[name] = self.flat[at : at + size].reshape(shape)
            at += size
        if fresh:  # at first contexts say nothing, and scores are those of the frequencies
            rng = np.random.default_rng(seed)
            self.part["context"][:] = rng.normal(0, 0.5, (n, SIZE))
            self.part["position"][:] = 1 / np.arange(1, CONTEXT + 1)[:, None]
            self.part["word_bias"][:] = np.log(outputs.unigram)
            self.part["class_bias"][:] = np.log(outputs.class_unigram)

    def contexts(self, before: np.ndarray) -> np.ndarray:
        """The sum, for each row of outputs before a token, of their embeddings weighed by position."""
        p = self.part
        return sum(p["position"][j] * p["context"][before[:, j]] for j in range(CONTEXT))


class Learner:
    """Steps of noise-contrastive estimation, with a rate of its own for each parameter."""

    def __init__(self, model: Model, outputs: Outputs):
        self.m, self.o = model, outputs
        self.seen = {name: np.full(x.shape, 1e-2, np.float32) for name, x in model.part.items()}
        self.kind = np.uint16 if outputs.size < 1 << 16 else np.int64  # short numbers are sorted by their digits
        self.class_of = outputs.class_of.astype(self.kind)
        upto = lambda p: np.cumsum(p) / p.sum()
        self.upto = {"word": upto(outputs.unigram), "class": upto(outputs.class_unigram)}
        self.log_expected = {"word": np.log(NOISE * outputs.unigram).astype(np.float32), "class": np.log(NOISE * outputs.class_unigram).astype(np.float32)}

    def _step(self, name: str, rows: np.ndarray | slice, grad: np.ndarray) -> None:
        seen, part = self.seen[name], self.m.part[name]
        so_far = seen[rows] + grad * grad
        seen[rows] = so_far
        part[rows] += RATE * grad / np.sqrt(so_far)

    def _sums(self, at: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct rows among ``at``, and the sum of the gradients of each."""
        order = np.argsort(at, kind="stable")
        ordered = at.take(order)
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        return ordered.take(first).astype(np.int64), np.add.reduceat(grad.take(order, axis=0), first, axis=0)

    def _head(self, name: str, h: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Learns to tell the targets from noise drawn for the batch; the gradient of the contexts."""
        upto, log_expected = self.upto[name], self.log_expected[name]
        noise = np.minimum(np.searchsorted(upto, rng.random(NOISE)), len(upto) - 1).astype(self.kind)
        e, b, n = self.m.part[name], self.m.part[f"{name}_bias"] - log_expected, len(h)
        held, drawn = e.take(target, axis=0), e.take(noise, axis=0)
        true = 1 / (1 + np.exp(np.einsum("ij,ij->i", h, held) + b.take(target)))
        false = h @ drawn.T
        false += b.take(noise)
        np.negative(false, out=false)
        np.exp(false, out=false)
        false += 1
        np.divide(np.float32(-1), false, out=false)
        back = true[:, None] * held
        back += false @ drawn
        grad = np.empty((n + NOISE, SIZE + 1), np.float32)
        np.multiply(true[:, None], h, out=grad[:n, :SIZE])
        grad[:n, SIZE] = true
        grad[n:, :SIZE] = false.T @ h
        grad[n:, SIZE] = false.sum(axis=0)
        rows, sums = self._sums(np.concatenate([target, noise]), grad)
        sums /= np.float32(n**0.5)
        self._step(name, rows, sums[:, :SIZE])
        self._step(f"{name}_bias", rows, sums[:, SIZE])
        return back

    def learn(self, before: np.ndarray, now: np.ndarray, rng: np.random.Generator) -> None:
        """One step on a batch: per position the outputs before its tokens, and the tokens' own, as numbers of ``kind``."""
        p = self.m.part
        held = [p["context"].take(u, axis=0) for u in before]
        h = sum(p["position"][j] * x for j, x in enumerate(held))
        back = self._head("word", h, now, rng)
        back += self._head("class", h, self.class_of.take(now), rng)
        back /= np.float32(len(h) ** 0.5)
        by_position = np.stack([np.einsum("ij,ij->j", back, x) for x in held])
        rows, sums = self._sums(np.concatenate(list(before)), np.concatenate([back * p["position"][j] for j in range(CONTEXT)]))
        self._step("context", rows, sums)
        self._step("position", slice(None), by_position)

    def learn_all(self, before: np.ndarray, now: np.ndarray, rng: np.random.Generator) -> int:
        """Every one of the tokens once, in batches in random order; how many."""
        order = rng.permutation(len(now))
        now, before = now.astype(self.kind).take(order), np.ascontiguousarray(before.T).astype(self.kind).take(order, axis=1)
        for at in range(0, len(now), BATCH):
            self.learn(before[:, at : at + BATCH], now[at : at + BATCH], rng)
        return len(now)


def log_sums(s: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of the exponentials of each row."""
    if len(s) and (s.max() > 60 or s.min() < -60):
        top = s.max(axis=1, keepdims=True)
        return (np.log(np.exp(s - top).sum(axis=1, keepdims=True)) + top)[:, 0]
    return np.log(np.exp(s).sum(axis=1))


def log_probabilities(model: Model, outputs: Outputs, before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """log10 of the probability of each output after those before it; over all outputs these sum to 1."""
    p, out = model.part, np.empty(len(now))
    weighed = [p["position"][j] * p["context"] for j in range(CONTEXT)]
    kind = np.uint16 if len(outputs.members) < 1 << 16 else np.int64  # short numbers are sorted by their digits
    class_of = outputs.class_of.astype(kind)
    of_class = [(np.ascontiguousarray(p["word"][of].T), p["word_bias"][of]) for of in outputs.members]
    heads = np.ascontiguousarray(p["class"].T)
    for at in range(0, len(now), CHUNK):
        c = class_of.take(now[at : at + CHUNK])
        order = np.argsort(c, kind="stable")
        c, w, u = c.take(order).astype(np.int64), now[at : at + CHUNK].take(order), before[at : at + CHUNK].take(order, axis=0)
        h = sum(weighed[j].take(u[:, j], axis=0) for j in range(CONTEXT))  # in the order of classes
        s = h @ heads
        s += p["class_bias"]
        part = (s[np.arange(len(w)), c] - log_sums(s)).astype(float)
        place = outputs.place.take(w)
        ends = np.flatnonzero(np.append(c[1:] != c[:-1], True)) + 1
        for first, last in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
            words, bias = of_class[c[first]]
            if len(bias) > 1:
                s = h[first:last] @ words
                s += bias
                part[first:last] += s[np.arange(last - first), place[first:last]] - log_sums(s)
        out[at + order] = part
    return out / _LN10


#: A tokenised block: what ``Tokens`` holds, as bytes.
TOKENS = {"ids": np.int64, "sizes": np.int64, "codes": np.int32, "hashes": np.uint64, "endings": np.uint16}
TOKENS_SCHEMA = "block long, n_bytes long, " + ", ".join(f"{c} binary" for c in TOKENS)


class Numbers(dict):
    """Words and their numbers, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokenise(row: dict) -> dict:
    """A block of texts as numbers of its distinct words; number 0 is the end, which closes every text."""
    number = Numbers({END: 0})
    codes, sizes, at = [], [], 0
    for n in np.frombuffer(row["lens"], np.int64).tolist():
        words = row["text"][at : at + n].lower().split()
        codes += map(number.__getitem__, words)
        codes.append(0)
        sizes.append(len(words) + 1)
        at += n
    hashes, endings = map(xxhash.xxh64_intdigest, number), map(ending, number)
    made = {"ids": np.frombuffer(row["ids"], np.int64), "sizes": sizes, "codes": codes, "hashes": np.fromiter(hashes, np.uint64, len(number)), "endings": np.fromiter(endings, np.uint16, len(number))}
    return {c: np.asarray(made[c], kind).tobytes() for c, kind in TOKENS.items()}


class Tokens:
    """A tokenised block."""

    def __init__(self, row: dict):
        self.ids, self.sizes, self.codes, self.hashes, endings = (np.frombuffer(row[c], kind) for c, kind in TOKENS.items())
        self.endings = endings.astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.held_out = held_out(self.ids)

    def trained(self) -> np.ndarray:
        return np.repeat(~self.held_out, self.sizes)

    def by_bucket(self, buckets: int):
        b = (mixed(self.hashes) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
            yield int(b[part[0]]), part

    def counts(self, replies: list[dict], buckets: int) -> np.ndarray:
        """Of each distinct word, its count in all training tokens."""
        told = {r["bucket"]: r["counts"] for r in replies}
        out = np.zeros(len(self.hashes), np.int64)
        for bucket, part in self.by_bucket(buckets):
            out[part] = np.frombuffer(told[bucket], np.int64)
        return out

    def with_contexts(self, outputs: Outputs) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, the outputs before it (the nearest first; ends, where its text has no more) and its own."""
        now = outputs.of(self.hashes, self.endings)[self.codes]
        place = np.arange(len(now)) - np.repeat(self.first, self.sizes)
        before = np.zeros((len(now), CONTEXT), np.int64)
        for j in range(CONTEXT):
            before[j + 1 :, j] = now[: max(0, len(now) - j - 1)]
            before[place <= j, j] = 0
        return before, now


def _word_totals(most: int):
    def totals(t: pa.Table) -> pa.Table:
        """A reply to each block; for all, the bucket's most frequent words, and its tokens and words by ending."""
        hashes = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("counts").to_pylist()]).astype(np.int64)
        endings = np.concatenate([np.frombuffer(x, np.uint16) for x in t.column("endings").to_pylist()])
        h, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        total = np.bincount(inverse, counts, len(h)).astype(np.int64)
        seen, ends = total > 0, endings[first].astype(np.int64)
        replies = [x.tobytes() for x in np.split(total[inverse], np.cumsum([len(x) for x in hashes])[:-1])]
        top = np.lexsort((h, -total))[:most]
        top = top[seen[top]]
        tokens, distinct = np.bincount(ends, total, ENDINGS).astype(np.int64), np.bincount(ends[seen], minlength=ENDINGS)
        have = np.flatnonzero(distinct)
        rows = [(b, k, r, *[None] * 6) for b, k, r in zip(t.column("block").to_pylist(), t.column("bucket").to_pylist(), replies, strict=True)]
        listed = (h[top].view(np.int64), total[top], ends[top], have, tokens[have], distinct[have])
        rows.append((None, None, None, *[x.tolist() for x in listed]))
        kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 6]
        names = ["block", "bucket", "counts", "top", "top_counts", "top_endings", "endings", "tokens", "words"]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return totals


def size_of_vocabulary(tokens: int) -> int:
    return max(LEAST_WORDS, int(WORDS_PER_ROOT * np.cbrt(tokens)))


def find_outputs(told: DataFrame, tokens: int) -> Outputs:
    """The outputs of a corpus; the driver holds as many words as the model and at most ENDINGS sums."""
    each = told.where("tokens IS NOT NULL").select(F.explode(F.arrays_zip("endings", "tokens", "words")).alias("t")).select("t.*")
    sums = {r[0]: [r[1], r[2]] for r in each.groupBy("endings").agg(F.sum("tokens"), F.sum("words")).collect()}
    top_rows = told.where("top IS NOT NULL").select(F.explode(F.arrays_zip("top", "top_counts", "top_endings")).alias("t")).select("t.*")
    best = top_rows.orderBy(F.desc("top_counts"), "top").limit(size_of_vocabulary(tokens)).collect()
    end = xxhash.xxh64_intdigest(END)
    hashes, counts = [end], [0]
    for h, n, e in best:
        sums[e][0] -= n
        sums[e][1] -= 1
        if h % (1 << 64) == end:
            counts[0] = n
        else:
            hashes.append(h % (1 << 64))
            counts.append(n)
    return Outputs(np.array(hashes, np.uint64), np.array(counts, float), {e: tuple(x) for e, x in sums.items()})


def train(blocks: DataFrame, outputs: Outputs, n_bytes: int) -> tuple[Model, list[int]]:
    """Rounds of learning in every task, each ended by the average of what the tasks have learned, weighed by their tokens.

    Also how many tokens each round learned from. Parameters depend on how blocks are dealt to tasks, as each task
    learns on its own.
    """
    context = blocks.sparkSession.sparkContext
    model, learned_from = Model(outputs), []
    dealt = blocks.coalesce(max(1, n_bytes // LEARN_BYTES))
    shared = context.broadcast(outputs)
    for turn in range(ROUNDS):
        start = context.broadcast(model.flat)

        def learned(batches, turn=turn, start=start):
            own, weight = None, 0
            for row in _rows(batches):
                if own is None:
                    own = Learner(Model(shared.value, start.value.copy()), shared.value)
                t = Tokens(row)
                before, now = t.with_contexts(shared.value)
                use = t.trained()
                weight += own.learn_all(before[use], now[use], np.random.default_rng([turn, row["block"]]))
            if weight:
                flat = own.m.flat.astype(np.float64) * weight
                for k, at in enumerate(range(0, len(flat), PART)):
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([float(weight)]), pa.array([flat[at : at + PART].tobytes()])], names=["part", "weight", "numbers"])

        def averaged(t: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(x, np.float64) for x in t.column("numbers").to_pylist()], axis=0)
            mean = (total / sum(t.column("weight").to_pylist())).astype(np.float32)
            return pa.table([t.column("part").slice(0, 1), pa.array([sum(t.column("weight").to_pylist())]), pa.array([mean.tobytes()])], names=["part", "weight", "numbers"])

        sent = dealt.mapInArrow(learned, "part long, weight double, numbers binary")
        learned_from.append(0)
        for r in sent.groupBy("part").applyInArrow(averaged, "part long, weight double, numbers binary").toLocalIterator():
            mean = np.frombuffer(r["numbers"], np.float32)
            model.flat[r["part"] * PART : r["part"] * PART + len(mean)] = mean
            learned_from[-1] = int(r["weight"])
    return model, learned_from


def tokenised_blocks(scratch: Scratch, documents: DataFrame) -> DataFrame:
    """Every document, tokenised and written once, so that a block's number and content never change between passes."""

    def tokenised(batches):
        from pyspark import TaskContext

        for b in block_rows(batches, BLOCK_BYTES, TaskContext.get().partitionId()):
            row = b.to_pylist()[0]
            cells = {"block": row["block"], "n_bytes": row["n_bytes"]} | tokenise(row)
            yield pa.RecordBatch.from_pydict({c: [x] for c, x in cells.items()})

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    buckets = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.write_bucketed(narrow.mapInArrow(tokenised, TOKENS_SCHEMA), "block", buckets)


def score_documents(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A text's tokens are its words in lower case (A-Z) and an end. Null and empty texts are one end; null ids count
    as the text '' when folds are dealt. Repeated rows count each. Only doc_id and text are read. With no training
    document every word is unknown. An empty table gives no rows. The driver holds the parameters, whose number
    follows the cube root of the training tokens.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark)
    blocks = tokenised_blocks(scratch, documents)
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    most = size_of_vocabulary(size)  # there are fewer tokens than bytes and texts

    def counted(batches):
        for row in _rows(batches):
            t = Tokens(row)
            n = np.bincount(t.codes[t.trained()], minlength=len(t.hashes)).astype(np.uint32)
            cells = [(row["block"], k, t.hashes[p].tobytes(), n[p].tobytes(), t.endings[p].astype(np.uint16).tobytes()) for k, p in t.by_bucket(buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cells, strict=True)], names=["block", "bucket", "hashes", "counts", "endings"])

    schema = "block long, bucket long, counts binary, top array<long>, top_counts array<long>, top_endings array<long>, endings array<long>, tokens array<long>, words array<long>"
    sent = blocks.mapInArrow(counted, "block long, bucket long, hashes binary, counts binary, endings binary")
    tasks = -(-buckets // TASK_BUCKETS)
    dealt = sent.repartition(tasks, "bucket") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else sent
    told = scratch.write(dealt.groupBy("bucket").applyInArrow(_word_totals(most), schema))
    total = told.where("tokens IS NOT NULL").select(F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x).alias("v"))
    train_tokens, vocabulary = (x or 0 for x in total.agg(F.sum("n"), F.sum("v")).first())
    outputs = find_outputs(told, train_tokens)
    model, _ = train(blocks, outputs, size)
    scale = np.log10(train_tokens + 0.5 * (vocabulary + 1))
    shared, learned = spark.sparkContext.broadcast(outputs), spark.sparkContext.broadcast(model.flat)
    replies = scratch.write(told.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("replies")))

    def scored(batches):
        own = None
        for row in _rows(batches):
            of = shared.value
            own = own or Model(of, learned.value)
            t = Tokens(row)
            n = t.counts(row["replies"], buckets)
            before, now = t.with_contexts(of)
            base = np.log10(n + 0.5)
            output = of.of(t.hashes, t.endings)
            share = np.zeros(len(base))
            tail = of.shared(output)
            share[tail] = base[tail] - np.log10(of.shares[output[tail] - of.words])
            per_token = log_probabilities(own, of, before, now) + share[t.codes]
            columns = [
                pa.array([None if i == NULL_ID else i for i in t.ids.tolist()], pa.int64()),
                pa.array(t.held_out),
                pa.array(t.sizes),
                pa.array(np.add.reduceat((n > 0)[t.codes].astype(np.int64), t.first)),
                pa.array([train_tokens] * len(t.ids), pa.int64()),
                pa.array(np.add.reduceat((base - scale)[t.codes], t.first)),
                pa.array(np.add.reduceat(per_token, t.first)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = blocks.join(replies.hint("shuffle_hash"), "block")
    return out.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
