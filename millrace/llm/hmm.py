"""Scores of texts under a hidden Markov language model trained on the corpus.

Tokens are words and one end. The commonest words emit as themselves; all others share classes by a hash, inside which a word
has its smoothed share of the training count. The classes grow in number with the vocabulary, and every word's count enters.
Start values come from the counts of neighbouring classes in all training texts, to which a chain of latent states is fitted.
Then Baum-Welch counts are gathered over all whole training texts by each partition and summed by class, until the
likelihood hardly grows; the forward recursion, scaled at every step, gives the exact likelihood of a whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_remainder, lean, small_batches, stored

END = " "  # no word holds a blank
ADD = 0.1


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lower-cased, and where each text's begin and the last one's end; a null text has none."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    at, words = np.asarray(found.offsets) - found.offsets[0].as_py(), found.flatten()
    real = np.asarray(pc.binary_length(words)) > 0  # white space at a text's ends leaves empty parts
    if not real.all():
        at, words = np.r_[0, np.cumsum(real)][at], words.filter(pa.array(real))
    return words, at


class Lexicon:
    """Class ids: the head's words, the end, then the hashed classes of all other words."""

    def __init__(self, head: bytes, tails: int) -> None:
        self.words = pa.array(head.decode().split(" ") if head else [], pa.string())
        self.end, self.tails = len(self.words), tails
        self.size = len(self.words) + 1 + tails

    def encode(self, texts: pa.Array) -> tuple[list[np.ndarray], list[list[str]]]:
        """Of every text the classes of its words and of the end, and its words outside the head."""
        words, at = split_words(texts)
        found = pc.index_in(words, value_set=self.words.cast(words.type))
        missing = np.asarray(found.is_null())
        ids = found.fill_null(-1).to_numpy().copy()
        other = words.filter(found.is_null()).dictionary_encode()
        hash64, base, mask = xxhash.xxh64_intdigest, self.end + 1, self.tails - 1
        distinct = other.dictionary.to_pylist()
        ids[missing] = np.array([base + (hash64(w, 42) & mask) for w in distinct], np.int32)[np.asarray(other.indices)]
        out = np.insert(ids, at[1:], self.end).astype(np.int32, copy=False)
        outside = np.array(distinct, object)[np.asarray(other.indices)].tolist()
        begin, first = (at + np.arange(len(at))).tolist(), np.r_[0, np.cumsum(missing)][at].tolist()
        return [out[i:j] for i, j in zip(begin, begin[1:])], [outside[i:j] for i, j in zip(first, first[1:])]


class Steps:
    """Sequences laid out step by step, longest first, so that a step is one slice over all sequences still running."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        length = np.array([len(s) for s in sequences])
        self.order = np.argsort(-length, kind="stable")
        length = length[self.order]
        self.running = len(length) - np.searchsorted(length[::-1], np.arange(length[0]), side="right")
        self.at = np.r_[0, np.cumsum(self.running)]
        rank = np.repeat(np.arange(len(length)), length)
        step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        self.ids = np.empty(len(rank), np.int32)
        self.ids[self.at[step] + rank] = np.concatenate([sequences[k] for k in self.order.tolist()])


def log10_likelihoods(sequences: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Scaled forward recursion, in double precision; emit is (classes, states)."""
    steps = Steps(sequences)
    total, ones = np.zeros(len(sequences)), np.ones(len(start))
    a = None
    for t, n in enumerate(steps.running.tolist()):
        seen = emit[steps.ids[steps.at[t] : steps.at[t + 1]]]
        a = start * seen if t == 0 else (a[:n] @ move) * seen
        scale = a @ ones
        total[:n] += np.log10(scale)
        a /= scale[:, None]
    out = np.empty(len(sequences))
    out[steps.order] = total
    return out


def expected_counts(sequences: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts (start, moves, emissions by class) of whole texts, and their log likelihood."""
    steps = Steps(sequences)
    seen = emit[steps.ids]
    ahead, scale, ones = np.empty_like(seen), np.empty(len(seen), seen.dtype), np.ones(len(start), seen.dtype)
    a = None
    for t, n in enumerate(steps.running.tolist()):
        lo, hi = steps.at[t], steps.at[t + 1]
        a = start * seen[lo:hi] if t == 0 else (a[:n] @ move) * seen[lo:hi]
        s = a @ ones
        a = a / s[:, None]
        ahead[lo:hi], scale[lo:hi] = a, s
    back, moves = np.ones_like(seen), np.zeros(move.shape)
    scaled = seen / scale[:, None]
    for t in range(len(steps.running) - 2, -1, -1):
        n, lo, hi = steps.running[t + 1], steps.at[t + 1], steps.at[t + 2]
        after, here = scaled[lo:hi] * back[lo:hi], slice(steps.at[t], steps.at[t] + n)
        back[here] = after @ move.T
        moves += ahead[here].T @ after
    state = ahead * back
    starts = state[: len(sequences)].sum(axis=0)
    emitted = np.stack([np.bincount(steps.ids, state[:, k], len(emit)) for k in range(state.shape[1])], axis=1)
    return starts, move * moves, emitted, float(np.log(scale, dtype=np.float64).sum())


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def from_counts(start: np.ndarray, moves: np.ndarray, emitted: np.ndarray, unigram: np.ndarray, prior: float) -> Hmm:
        k = len(start)
        total = emitted.sum(axis=0)
        emit = (emitted + prior * unigram[:, None]) / (total + prior)
        move = (moves + 1) / (moves.sum(axis=1, keepdims=True) + k)
        return Hmm((start + 1) / (start.sum() + k), move, emit)

    def counts(self, sequences):
        f = np.float32
        return expected_counts(sequences, self.start.astype(f), self.move.astype(f), self.emit.astype(f))


def latent_chain(pairs: np.ndarray, states: int, seed: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(emissions, moves) of latent states fitted to the counts of neighbouring classes, by expectation and maximisation.

    A pair (a, b) has the probability sum over s, t of joint[s, t] * emit[a, s] * emit[b, t].
    """
    draw = np.random.default_rng(seed)
    share = pairs / pairs.sum()
    emit = (share.sum(axis=0) + 1e-9)[:, None] * draw.gamma(1.0, size=(len(pairs), states))
    emit /= emit.sum(axis=0)
    joint = np.full((states, states), 0.1 / states**2) + np.eye(states) * 0.9 / states
    for _ in range(rounds):
        ratio = share / np.maximum(emit @ joint @ emit.T, 1e-300)
        left, right = ratio @ emit @ joint.T, ratio.T @ emit @ joint  # emit times these: what a class gives as first, as second
        joint = joint * (emit.T @ ratio @ emit)
        emit = emit * (left + right)
        emit /= np.maximum(emit.sum(axis=0), 1e-300)
        joint /= joint.sum()
    return emit, joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)


def _count(held: int):
    """Words with their counts, for about `held` bytes of words together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def out() -> pa.RecordBatch:
            found = pc.value_counts(pa.chunked_array(waiting))
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

        for batch in batches:
            words, _ = split_words(batch.column("_text"))
            if len(words):
                waiting.append(words)
                size += words.nbytes
            if size >= held:
                yield out()
                waiting, size = [], 0
        if waiting:
            yield out()

    return lean(run)


def _encoded(lexicon_bytes, tails: int):
    """The classes of a text's words, made once for all passes of the training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(lexicon_bytes.value, tails)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in lexicon.encode(batch.column("_text"))[0]], pa.binary())], ["ids"])

    return lean(run)


def _batches(batches: Iterator[pa.RecordBatch], long: int = 1500, short_tokens: int = 500_000, long_tokens: int = 800_000) -> Iterator[list[np.ndarray]]:
    """Whole training texts, some together; those of over `long` tokens wait for each other, so that few steps run over few texts."""
    held: dict[bool, list[np.ndarray]] = {False: [], True: []}
    size, most = {False: 0, True: 0}, {False: short_tokens, True: long_tokens}
    for batch in batches:
        for text in batch.column("ids"):
            ids = np.frombuffer(text.as_buffer(), np.int32)
            which = len(ids) > long
            held[which].append(ids)
            size[which] += len(ids)
            if size[which] >= most[which]:
                yield held[which]
                held[which], size[which] = [], 0
    for rest in held.values():
        if rest:
            yield rest


def score(
    docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", states: int = 6, rounds: int = 3, gain: float = 0.003, head_words: int = 150_000, tail_words: int = 2048, prior: float = 100.0, seed: int = 3
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; `train` is the condition to learn from.

    base_score is the additive unigram's log10 probability over all tokens, score the hidden Markov model's, both exact over
    the whole text. The model: the `head_words` commonest words are classes of their own; all others are dealt by a hash to
    classes of about `tail_words` words each, 256 at least. Rounds gather counts over all whole training texts and end when
    the log likelihood has grown by less than the share `gain`, after `rounds` at the latest. A null or empty text is the
    end alone. Rows without id are scored and count as any other; repeated rows each count and are scored each; with nothing
    to learn from, every word is unknown. Empty tables give none; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    learn = rows.where("_train").select("_text")
    words = stored(learn.mapInArrow(_count(24 << 20), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "hmm-words")
    ends = learn.count()
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    sizes = sorted(((r["step"], r["v"], r["n"]) for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect()), reverse=True)
    tails = 1 << max(8, math.ceil(math.log2(max(1, sum(s[1] for s in sizes) - head_words) / tail_words)))
    n_tokens, n_words = sum(s[2] for s in sizes) + ends, sum(s[1] for s in sizes) + (ends > 0)
    least, room = math.inf, head_words
    for s, v, _ in sizes:
        if v > room:
            break
        least, room = s, room - v
    in_head = step >= F.lit(least if least < math.inf else 1 << 20)
    head = words.where(in_head).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    lexicon_bytes = spark.sparkContext.broadcast(" ".join(head["word"].to_pylist()).encode())
    h = head.num_rows
    tail = words.where(~in_head)
    tail_class = F.pmod(F.xxhash64("word"), F.lit(tails)).cast("int")
    tail_n, tail_v = np.zeros(tails), np.zeros(tails)
    for r in tail.groupBy(tail_class.alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tail_n[r["c"]], tail_v[r["c"]] = r["n"], r["v"]
    head_n = np.array(head["n"].to_pylist(), np.float64)
    unigram = np.r_[head_n, ends, tail_n] + ADD * np.r_[np.ones(h + 1), tail_v + 1]
    unigram /= unigram.sum()
    below = n_tokens + ADD * (n_words + 1)
    base = np.r_[np.log10((head_n + ADD) / below), math.log10((ends + ADD) / below)]

    coded = stored(learn.mapInArrow(_encoded(lexicon_bytes, tails), "ids binary"), "hmm-coded") if n_tokens else None
    model = _start_values(coded, unigram, states, prior, seed) if n_tokens else None
    reached = -math.inf
    for _ in range(rounds if n_tokens else 0):
        model, now = _round(coded, spark.sparkContext.broadcast(model), unigram, prior)
        if now - reached < gain * abs(now):
            break
        reached = now
    if coded is not None:
        discard(coded)
    if model is None:
        model = Hmm(np.full(states, 1 / states), np.full((states, states), 1 / states), np.repeat(unigram[:, None], states, axis=1))

    given = spark.sparkContext.broadcast((model, base, int(ends > 0), np.log10(tail_n + ADD * (tail_v + 1))))
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    kind = rows.schema["_id"].dataType.simpleString()
    scored = numbered.mapInArrow(_score(given, lexicon_bytes, tails), f"_row long, _id {kind}, held_out boolean, n_tokens long, head_known long, head_base double, score double, tail_words long, words array<string>, times array<long>")
    scored = stored(scored, "hmm-scored")
    each = scored.select("_row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("_row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    known = each.join(tail, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = known.groupBy(F.col("_row").alias("_tail_row")).agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(ADD))).alias("tail_log")
    )
    out = scored.drop("words", "times").join(sums, F.col("_row") == F.col("_tail_row"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", (F.col("head_known") + zero("tail_known")).alias("n_known"), F.lit(int(n_tokens)).cast("long").alias("train_tokens"),
        (F.col("head_base") + zero("tail_log") - F.col("tail_words") * F.lit(math.log10(below))).alias("base_score"), (F.col("score") + zero("tail_log")).alias("score"),
    )


def _start_values(coded, unigram, states, prior, seed, common: int = 1024, rare: int = 256) -> Hmm:
    """Start values from the neighbours in all training texts: a latent chain over the commonest classes and groups of the others."""
    size = len(unigram)
    order = np.argsort(-unigram, kind="stable")
    group = np.empty(size, np.int32)
    group[order] = np.where(np.arange(size) < common, np.arange(size), common + np.arange(size) % rare)
    groups = int(group.max()) + 1
    given = coded.sparkSession.sparkContext.broadcast(group)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, first = np.zeros(groups * groups, np.int64), np.zeros(groups, np.int64)
        for sequences in _batches(batches):
            begin = np.cumsum([0, *(len(x) for x in sequences[:-1])])
            g = given.value[np.concatenate(sequences)].astype(np.int64)
            first += np.bincount(g[begin], minlength=groups)
            within = np.ones(len(g), bool)
            within[begin] = False  # a text's first token has none before it
            pairs += np.bincount((g[:-1] * groups + g[1:])[within[1:]], minlength=groups * groups)
        for values, offset in ((pairs, 0), (first, groups * groups)):
            at = np.flatnonzero(values)
            for k in range(0, len(at), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 50_000] + offset), pa.array(values[at[k : k + 50_000]])], ["pair", "n"])

    total = coded.mapInArrow(lean(gather), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(groups * groups + groups)
    counts[total["pair"].to_numpy()] = total["n"].to_numpy()
    pairs, first = counts[: groups * groups].reshape(groups, groups), counts[groups * groups :]
    if not pairs.any():  # no text has a word
        return Hmm.from_counts(np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), unigram, prior)
    emit, move = latent_chain(pairs, states, seed)
    mass = np.bincount(group, unigram, groups)
    state = emit * pairs.sum(axis=0).clip(1)[:, None]  # of a group, how likely each state; its classes share that
    state /= np.maximum(state.sum(axis=1, keepdims=True), 1e-300)
    n = pairs.sum() + first.sum()
    return Hmm.from_counts(first @ state, move * pairs.sum() / states, n * unigram[:, None] * (emit / np.maximum(mass, 1e-300)[:, None])[group] / states, unigram, prior)


def _round(coded, model, unigram, prior) -> tuple[Hmm, float]:
    """One Baum-Welch round over all training texts; with the log likelihood that they had before it."""
    states = len(model.value.start)
    names = [f"s{k}" for k in range(states)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, moves, emitted, reached = np.zeros(states), np.zeros((states, states)), np.zeros(model.value.emit.shape), 0.0
        for sequences in _batches(batches):
            *found, more = model.value.counts(sequences)
            reached += more
            for total, part in zip((start, moves, emitted), found):
                total += part
        full = np.flatnonzero(emitted.sum(axis=1))
        cls = np.r_[full, -1, -2 - np.arange(states), -2 - states]
        values = np.r_[emitted[full], start[None], moves, np.full((1, states), reached)]
        for at in range(0, len(cls), 20_000):
            part = slice(at, at + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(cls[part], pa.int64()), *(pa.array(np.ascontiguousarray(values[part, k])) for k in range(states))], ["class", *names])

    total = coded.mapInArrow(lean(gather), "class long, " + ", ".join(f"{n} double" for n in names)).groupBy("class").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    cls = total["class"].to_numpy()
    values = np.stack([total[n].to_numpy() for n in names], axis=1)
    emitted = np.zeros((len(unigram), states))
    emitted[cls[cls >= 0]] = values[cls >= 0]
    by = {int(c): v for c, v in zip(cls, values) if c < 0}
    return Hmm.from_counts(by[-1], np.stack([by[-2 - k] for k in range(states)]), emitted, unigram, prior), float(by[-2 - states][0])


def _score(given, lexicon_bytes, tails: int, long: int = 1500, short_tokens: int = 400_000, long_tokens: int = 2_000_000) -> Callable:
    """Texts of over `long` tokens wait for each other, so that few steps run over few texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(lexicon_bytes.value, tails)
        model, base, end_known, in_class = given.value
        names = ["_row", "_id", "held_out", "n_tokens", "head_known", "head_base", "score", "tail_words", "words", "times"]
        kinds = [pa.int64(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]

        def out(held: list[tuple]) -> pa.RecordBatch:
            found = log10_likelihoods([x[-1] for x in held], model.start, model.move, model.emit)
            rows = []
            for (row, i, train, other, ids), value in zip(held, found.tolist()):
                own = ids[ids <= lexicon.end]
                tail = Counter(other)
                value -= float(in_class[ids[ids > lexicon.end] - lexicon.end - 1].sum())  # a word has its count's share of its class
                rows.append((row, i, not train, len(ids), len(own) - 1 + end_known, float(base[own].sum()), value, len(other), list(tail), list(tail.values())))
            return pa.RecordBatch.from_arrays([pa.array(list(c), k or kind) for c, k in zip(zip(*rows), kinds)], names)

        held: dict[bool, list[tuple]] = {False: [], True: []}
        size = {False: 0, True: 0}
        most = {False: short_tokens, True: long_tokens}
        kind = None
        for batch in batches:
            kind = batch.column("_id").type
            coded, others = lexicon.encode(batch.column("_text"))
            for row, i, train, ids, other in zip(batch.column("_row").to_pylist(), batch.column("_id").to_pylist(), batch.column("_train").to_pylist(), coded, others):
                which = len(ids) > long
                held[which].append((row, i, train, other, ids))
                size[which] += len(ids)
                if size[which] >= most[which]:
                    yield out(held[which])
                    held[which], size[which] = [], 0
        for rest in held.values():
            if rest:
                yield out(rest)

    return lean(run)


def op4_hmm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, id_remainder(F.col("doc_id"), 10) != 0)
