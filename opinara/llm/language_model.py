"""LM scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

Every word belongs to a class: the most frequent words each to their own, all others to one of ``TAILS`` classes by their
last letters. The neural model predicts a token's class from the classes of the two tokens before; inside a class a word
has its share of the class's counts (plus one each, and one for the words never seen). Both factors are normalised, so a
text's tokens get proper probabilities.

Training reads the whole training text: word counts, then counts of class triples, both summed by Spark. The triples (at
most classes cubed) are dealt to ``SHARDS`` tasks, which improve the same parameters on their shares for a round; the
parameters are averaged between rounds. Only the parameters, the ``FREQUENT`` most frequent short words and class sums
are broadcast, all of bounded size. Counts of all other words reach their documents by a join.

Defined cases: a null text is empty and scores its end token; a null id is the empty text for the split. Rows may repeat,
each is scored; other columns are ignored. Without training text the model is uniform and nothing is known.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import slices, stored, utf8

#: Words whose counts are broadcast at most, none longer than LONGEST bytes.
FREQUENT = 1 << 18
LONGEST = 64
#: Words with a class of their own, and classes of all the others.
SINGLE, TAILS = 95, 32
DIMENSIONS = 32
SHARDS = 8
ROUNDS = 5
BATCH = 1024
NOISE = 16
END = b""


def held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the texts of ``docs`` (text), the end of each text being the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counter), pa.binary()).cast(pa.string()), pa.array(list(counter.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for text in utf8(batch.column(0)):
                counter.update(text.lower().split())
                counter[END] += 1
                if len(counter) > 1_000_000:
                    yield flush()
                    counter.clear()
        yield flush()

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Frequent words by place; class 0 is the end, then the single words, then the tails."""

    words: dict[bytes, int]
    counts: np.ndarray
    classes: np.ndarray
    singles: int
    tail_mass: np.ndarray
    tokens: int
    distinct: int

    @property
    def n_classes(self) -> int:
        return 1 + self.singles + TAILS


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The bounded part of ``counts`` (word, n)."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    short = counts.where(f"word != '' AND octet_length(word) <= {LONGEST}")
    # the steps of a logarithmic scale, rarest last, that hold FREQUENT words at most; a step is an eighth of a doubling
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(short.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True)
    held, least = 0, None
    for row in sizes:
        if held + row.words > FREQUENT:
            break
        held, least = held + row.words, row.step
    found = short.where(step >= least).toArrow() if least is not None else short.limit(0).toArrow()
    frequent = sorted(zip(utf8(found["word"].combine_chunks()), found["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    ends = counts.where("word = ''").first()
    words = [END, *[w for w, _ in frequent]]
    n = np.array([ends.n if ends else 0, *[k for _, k in frequent]], np.int64)
    singles = min(SINGLE, len(frequent))
    classes = np.array([i if i <= singles else 1 + singles + tail_of(w) for i, w in enumerate(words)], np.int64)
    # what the tails hold: all words but the single ones
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(TAILS, np.int64)
        for batch in batches:
            np.add.at(mass, np.fromiter(map(tail_of, utf8(batch.column(0))), np.int64, batch.num_rows), batch.column(1).to_numpy() + 1)
        yield pa.record_batch([pa.array(np.arange(TAILS)), pa.array(mass)], names=["tail", "mass"])

    mass = np.ones(TAILS)
    for r in counts.where("word != ''").mapInArrow(run, "tail bigint, mass bigint").groupBy("tail").agg(F.sum("mass").alias("mass")).collect():
        mass[r.tail] += r.mass
    for w, c in zip(words[1 : singles + 1], n[1 : singles + 1], strict=True):
        mass[tail_of(w)] -= c + 1
    return Vocabulary(dict(zip(words, range(len(words)), strict=True)), n, classes, singles, mass, tokens, distinct)


def _classes(texts: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """All tokens of some texts: frequent word or -1, class, each text's number of tokens, and its other words."""
    get = vocab.words.get
    places, rare, sizes = [], [], []
    for text in texts:
        words = text.lower().split()
        words.append(END)
        found = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        places.append(found)
        sizes.append(len(words))
        rare.append([words[i] for i in np.flatnonzero(found < 0).tolist()])
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    classes = vocab.classes[place]
    other = np.fromiter((1 + vocab.singles + tail_of(w) for words in rare for w in words), np.int64)
    classes[place < 0] = other
    return place, classes, np.array(sizes, np.int64), rare


def _contexts(classes: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """For each token, the two classes before as one number; ends stand before each text."""
    before = np.concatenate(([0], classes[:-1])) if len(classes) else classes
    two = np.concatenate(([0, 0], classes[:-2]))[: len(classes)]
    two = two.copy()
    two[np.cumsum(sizes) - sizes] = 0
    return two * n + before


def class_triples(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(code, n): how often each class follows two others in the texts of ``docs`` (text)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        n = vocab.n_classes
        for batch in slices(batches):
            _, classes, sizes, _ = _classes(utf8(batch.column(0)), vocab)
            codes, counts = np.unique(_contexts(classes, sizes, n) * n + classes, return_counts=True)
            yield pa.record_batch([pa.array(codes.astype(np.int32)), pa.array(counts.astype(np.int64))], names=["code", "n"])

    return docs.select("text").mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


class LogBilinear:
    """Score of class w after classes (v, u): (r[u] C1 + r[v] C2) . q[w] + b[w]."""

    def __init__(self, unigrams: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 1):
        n = len(unigrams)
        rng = np.random.default_rng(seed)
        self.noise = (unigrams + 1.0) / (unigrams.sum() + n)
        self.params = {
            "r": rng.normal(0, 0.3, (n, dimensions)), "q": rng.normal(0, 0.3, (n, dimensions)),
            "c1": np.eye(dimensions) * 0.5, "c2": np.eye(dimensions) * 0.5, "b": np.log(self.noise),
        }

    def hidden(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        p = self.params
        return p["r"][u] @ p["c1"] + p["r"][v] @ p["c2"]

    def log_probabilities(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of all classes after each context."""
        s = self.hidden(u, v) @ self.params["q"].T + self.params["b"]
        s -= s.max(1, keepdims=True)
        s -= np.log(np.exp(s).sum(1, keepdims=True))
        return s / np.log(10)

    def train(self, codes: np.ndarray, counts: np.ndarray, steps: int, rate: float, seed: int) -> None:
        """Steps of Adagrad on the noise-contrastive objective; triples are drawn by their counts."""
        n, p = len(self.noise), self.params
        rng = np.random.default_rng(seed)
        ends = np.cumsum(counts)
        squares = {k: np.full_like(x, 1e-2) for k, x in p.items()}
        shift = np.log(NOISE * self.noise)
        rows = np.arange(BATCH)
        for _ in range(steps):
            code = codes[np.searchsorted(ends, rng.integers(0, ends[-1], BATCH), "right")].astype(np.int64)
            v, u, w = code // (n * n), code // n % n, code % n
            ru, rv = p["r"][u], p["r"][v]
            h = ru @ p["c1"] + rv @ p["c2"]
            data = 1 / (1 + np.exp(-np.clip(h @ p["q"].T + p["b"] - shift, -30, 30)))  # chance that it is no noise
            g = data * (rng.multinomial(NOISE * BATCH, self.noise) / BATCH)
            g[rows, w] += data[rows, w] - 1
            g /= BATCH
            dh = g @ p["q"]
            dr = np.zeros_like(p["r"])
            np.add.at(dr, u, dh @ p["c1"].T)
            np.add.at(dr, v, dh @ p["c2"].T)
            for k, d in {"r": dr, "q": g.T @ h, "c1": ru.T @ dh, "c2": rv.T @ dh, "b": g.sum(0)}.items():
                squares[k] += (d * BATCH) ** 2 / BATCH
                p[k] -= rate * d * BATCH / np.sqrt(squares[k] * BATCH)


def _improving(shared, round_number: int):
    """One round of a shard's own training: its weight and its parameters."""

    def improve(group: pa.Table) -> pa.Table:
        group = group.sort_by("code")
        own = pickle.loads(pickle.dumps(shared.value))
        counts = group["n"].to_numpy()
        own.train(group["code"].to_numpy(), counts, 100 + len(counts) // 1000, 0.15 / (1 + round_number), 100 * round_number + group["shard"][0].as_py())
        flat = np.concatenate([x.ravel() for x in own.params.values()])
        return pa.table({"weight": pa.array([float(counts.sum())]), "params": pa.array([flat.tolist()], pa.list_(pa.float64()))})

    return improve


def fit(triples: DataFrame, n: int) -> LogBilinear:
    """Rounds of local training on shards of ``triples`` (code, n), the parameters averaged by the shards' weights.

    A shard has at most n ** 3 / SHARDS codes, whatever the corpus.
    """
    unigrams = np.zeros(n)
    for r in triples.groupBy((F.col("code") % n).alias("w")).agg(F.sum("n").alias("n")).collect():  # n rows
        unigrams[r.w] = r.n
    model = LogBilinear(unigrams)
    if not unigrams.sum():
        return model
    dealt = stored(triples.select(F.pmod(F.xxhash64("code"), F.lit(SHARDS)).cast("int").alias("shard"), "code", "n"), "triples")
    context = triples.sparkSession.sparkContext
    for round_number in range(ROUNDS):
        improve = _improving(context.broadcast(model), round_number)
        parts = dealt.groupBy("shard").applyInArrow(improve, "weight double, params array<double>").collect()  # SHARDS rows
        flat = np.average([r.params for r in parts], axis=0, weights=[r.weight for r in parts])
        at = 0
        for k, x in model.params.items():
            model.params[k] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
    return model


def score_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    The model and the base learn from the rows that aren't held out. ``base_score`` is the add-one unigram log10
    probability of the text, ``score`` the model's.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"), held_out(F.col(id_column)).alias("held_out"))
    train = rows.where("NOT held_out")
    counts = stored(word_counts(train), "words")
    vocab = vocabulary(counts)
    model = fit(stored(class_triples(train, vocab), "triples"), vocab.n_classes)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, model))
    total = float(np.log10(vocab.tokens + vocab.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        n = vocab.n_classes
        pairs = np.arange(n * n)
        table = np.concatenate([model.log_probabilities(c % n, c // n) for c in np.array_split(pairs, 16)])
        log_count = np.log10(vocab.counts + 1)
        inside = np.concatenate((np.zeros(1 + vocab.singles), -np.log10(vocab.tail_mass)))
        for batch in slices(batches):
            place, classes, sizes, rare = _classes(utf8(batch.column(3)), vocab)
            known = place >= 0
            gain = np.where(known, log_count[place], 0)
            score = table[_contexts(classes, sizes, n), classes] + inside[classes] + np.where(classes > vocab.singles, gain, 0)
            starts = np.cumsum(sizes) - sizes
            add = (lambda x: np.add.reduceat(x, starts) if len(sizes) else np.zeros(0))
            counted = [Counter(words) for words in rare]
            yield pa.record_batch(
                [
                    *batch.columns[:3], pa.array(sizes), pa.array(add((known & (vocab.counts[place] > 0)).astype(np.int64)), pa.int64()),
                    pa.array(add(gain)), pa.array(add(score)),
                    pa.array([[w.decode() for w in c] for c in counted], pa.list_(pa.string())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int64())),
                ],
                names=["uid", "id", "held_out", "n_tokens", "known", "gain", "score", "words", "times"],
            )

    scored = rows.select(F.monotonically_increasing_id().alias("uid"), "id", "held_out", "text").mapInArrow(
        run, "uid bigint, id bigint, held_out boolean, n_tokens bigint, known bigint, gain double, score double, words array<string>, times array<bigint>"
    )
    scored = stored(scored, "scored")
    others = scored.select("uid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("uid", F.col("w.words").alias("token"), F.col("w.times").alias("times"))
    found = others.join(counts, F.col("token") == F.col("word")).groupBy(F.col("uid").alias("u")).agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more")
    )
    zero = F.lit(0).cast("bigint")
    return scored.join(found, F.col("uid") == F.col("u"), "left").select(
        "id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(int(vocab.tokens)).cast("bigint").alias("train_tokens"),
        (F.col("gain") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
