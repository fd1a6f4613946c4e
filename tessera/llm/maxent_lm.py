"""Language-model scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(word | class, history).  Both factors are softmaxes over
hashed n-gram and skip features of the last two words: each feature's bucket holds one weight for
every class, or for every member of a class.  Words outside the model's vocabulary form one class,
inside which they keep their smoothed corpus frequencies, so every word has a probability and all
sum to one.  Biases start at the unigram model, which training then improves.

Training passes weights to the tasks, lets each take AdaGrad steps over its documents, and averages
the changes by tokens (iterative parameter mixing).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import held_out
from tessera.storage import materialize

#: The token after a text's last word; words can't hold it.
END = b"\n"
_MEMBERS = 48
_BATCH = 2048
_CHUNK = 1_000_000
_COUNTER = 400_000
_LEARNED = 50_000
_FEW = 12
_BLOCK = 16
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _text(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


@dataclass
class Tokens:
    """The tokens of some texts in a row: places in ``words``, and every text's first place and number."""

    codes: np.ndarray
    words: list[bytes]
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Tokens:
        """Words between ASCII white space in UTF-8, A-Z in lower case, and one ``END`` after each text's last."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
        found = lists.flatten().dictionary_encode()
        words = found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        codes = found.indices.to_numpy(zero_copy_only=False)
        # White space at either end of a text splits off an empty word.
        kept = np.array(list(map(bool, words)), dtype=bool)[codes]
        ends = np.r_[0, np.cumsum(kept)][np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]]
        own = np.diff(ends)
        out = np.full(int(ends[-1]) + len(own), len(words), dtype=np.int64)
        out[np.arange(int(ends[-1])) + np.repeat(np.arange(len(own)), own)] = codes[kept]
        return cls(out, [*words, END], ends[:-1] + np.arange(len(own)), own + 1)

    def histories(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the hash of the word before and of the word before that; 0 before a text."""
        one, two = np.zeros_like(hashes), np.zeros_like(hashes)
        one[1:], two[2:] = hashes[:-1], hashes[:-2]
        one[self.starts] = 0
        two[self.starts] = 0
        two[self.starts[self.lengths > 1] + 1] = 0
        return one, two


def _chunks(batches: Iterator[pd.Series]) -> Iterator[Tokens]:
    """The tokens of a batch's texts, about ``_CHUNK`` characters at once; a text stays whole."""
    for batch in batches:
        texts, held = [], 0
        for text in batch:
            texts.append(text)
            held += len(text)
            if held >= _CHUNK:
                yield Tokens.of(texts)
                texts, held = [], 0
        if texts:
            yield Tokens.of(texts)


@dataclass
class Maxent:
    """``by_class`` (buckets, classes), ``by_word`` (buckets, 48), and the biases of classes and slots.

    A word's slot is its rank among the ``vocabulary`` most frequent words, and a hashed one of
    ``rare`` further slots otherwise; 48 slots make a class.
    """

    by_class: np.ndarray
    by_word: np.ndarray
    class_bias: np.ndarray
    word_bias: np.ndarray
    vocabulary: int
    rare: int

    @property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return self.by_class, self.by_word

    def slots(self, ranks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        first = -(-self.vocabulary // _MEMBERS) * _MEMBERS
        return np.where(ranks < self.vocabulary, ranks, first + (hashes % np.uint64(self.rare)).astype(np.int64))

    def buckets(self, one: np.ndarray, two: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the features: (n, 3) for the class, of the word before, both words and the one
        before that (skip), and, with the class mixed in, (n, 2) for the word, without the skip."""
        last = np.uint64(len(self.by_class) - 1)
        raw = np.stack([one * _MIX[0], one * _MIX[1] + two * _MIX[2], two * _MIX[3]], axis=1)
        pair = raw[:, :2]
        with_class = (pair ^ (pair >> np.uint64(31))) * _MIX[1] + classes.astype(np.uint64)[:, None] * _MIX[0]
        return ((raw >> np.uint64(33)) & last).astype(np.int32), ((with_class >> np.uint64(33)) & last).astype(np.int32)

    def log_probability(self, slots: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log of P(class) * P(slot | class), after the hashes of the words before."""
        out = np.empty(len(slots))
        for at in range(0, len(slots), _BATCH):
            part = slice(at, at + _BATCH)
            c, member = np.divmod(slots[part], _MEMBERS)
            f, g = self.buckets(one[part], two[part], c)
            out[part] = _picked(_summed(self.by_class, f, self.class_bias), c)
            out[part] += _picked(_summed(self.by_word, g, self.word_bias[c]), member)
        return out

    def learn(self, slots: np.ndarray, one: np.ndarray, two: np.ndarray, steps: tuple, rate: float) -> None:
        """One AdaGrad step for each batch of tokens; ``steps`` holds (squares, counts) of each table's rows."""
        for at in range(0, len(slots), 2 * _BATCH):
            part = slice(at, at + 2 * _BATCH)
            c, member = np.divmod(slots[part], _MEMBERS)
            f, g = self.buckets(one[part], two[part], c)
            _step(self.by_class, *steps[0], f, _summed(self.by_class, f, self.class_bias), c, rate)
            _step(self.by_word, *steps[1], g, _summed(self.by_word, g, self.word_bias[c]), member, rate)


def _summed(table: np.ndarray, buckets: np.ndarray, bias: np.ndarray) -> np.ndarray:
    total = table.take(buckets[:, 0], axis=0)
    for k in range(1, buckets.shape[1]):
        total += table.take(buckets[:, k], axis=0)
    total += bias
    return total


def _sums(p: np.ndarray) -> np.ndarray:
    return np.einsum("ij->i", p)


def _picked(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log of the softmax at ``chosen``; overwrites ``logits``."""
    logits -= logits.max(axis=1, initial=-np.inf)[:, None]
    own = logits[np.arange(len(chosen)), chosen].astype(np.float64)
    np.exp(logits, out=logits)
    return own - np.log(_sums(logits))


def _run_sums(rows: np.ndarray, order: np.ndarray, starts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows in this order; most runs are short, so these are added place by place for all runs."""
    out = rows.take(order[starts], axis=0)
    longer = np.flatnonzero(times > 1)
    place = 1
    while len(longer) > _FEW:
        out[longer] += rows.take(order[starts[longer] + place], axis=0)
        place += 1
        longer = longer[times[longer] > place]
    for k in longer.tolist():
        out[k] += np.add.reduce(rows.take(order[starts[k] + place : starts[k] + times[k]], axis=0))
    return out


def _step(
    table: np.ndarray, squares: np.ndarray, counts: np.ndarray, buckets: np.ndarray, logits: np.ndarray, chosen: np.ndarray, rate: float
) -> None:
    """A step on the rows that the batch uses; a row's pace falls with the sum of its squared gradients."""
    logits -= logits.max(axis=1)[:, None]
    p = np.exp(logits, out=logits)
    p /= _sums(p)[:, None]
    p[np.arange(len(chosen)), chosen] -= 1
    for k in range(buckets.shape[1]):
        own = buckets[:, k]
        order = np.argsort(own.astype(np.uint16) if len(table) <= 1 << 16 else own, kind="stable")
        own = own[order]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        times = np.diff(np.r_[starts, len(own)])
        sums = _run_sums(p, order, starts, times)
        rows = own[starts]
        squares[rows] += np.einsum("ij,ij->i", sums, sums)
        counts[rows] += times
        sums *= (-rate / np.sqrt(squares[rows]))[:, None]
        sums += table.take(rows, axis=0)
        table[rows] = sums


def count_words(texts: DataFrame) -> DataFrame:
    """``(word, c)`` over ``texts(text)``; each text adds one ``END``.

    Tasks send the sums of their own texts, in several parts if they meet many words.
    """

    def part(seen: Counter) -> pd.DataFrame:
        words = pd.Series(list(map(_text, seen)), dtype=object)
        return pd.DataFrame({"word": words, "c": pd.Series(list(seen.values()), dtype="int64")})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for tokens in _chunks(batch["text"] for batch in batches):
            times = np.bincount(tokens.codes, minlength=len(tokens.words)).tolist()
            seen.update({w: n for w, n in zip(tokens.words, times, strict=True) if n})
            if len(seen) >= _COUNTER:
                yield part(seen)
                seen.clear()
        yield part(seen)

    return texts.select("text").mapInPandas(counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _most_frequent(counts: DataFrame, limit: int) -> list[tuple[bytes, int]]:
    """At most ``limit`` words from the top, by falling count.

    A histogram of the counts' logarithms (a few hundred rows) gives the count to cut at, so no
    task sends more than the words that are kept.
    """
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    held, cut = 0, None
    for at, n in sizes:
        if held + n > limit:
            break
        held, cut = held + n, at
    if cut is None:
        return []
    kept = counts.filter(step >= cut).toPandas()
    kept = kept.sort_values(["c", "word"], ascending=[False, True])
    return [(w.encode("utf-8", "surrogatepass"), int(c)) for w, c in zip(kept["word"], kept["c"], strict=True)]


class _Ranks(dict):
    """Frequent words with their ranks; every other word has rank ``other``, their number."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, k) for k, w in enumerate(words))
        self.other = len(words)
        self.hashes = np.array([_hash(w) for w in words], dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        return self.other

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and hashes of some words."""
        ranks = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        rare = np.flatnonzero(ranks == self.other)
        hashes = np.empty(len(words), dtype=np.uint64)
        known = ranks < self.other
        hashes[known] = self.hashes[ranks[known]]
        hashes[rare] = [_hash(words[i]) for i in rare.tolist()]
        return ranks, hashes


def _hash(word: bytes) -> int:
    """XXH64 with the seed that Spark's xxhash64 has."""
    return xxhash.xxh64_intdigest(word, 42)


def _unigram(masses: np.ndarray, vocabulary: int, rare: int, buckets: int) -> Maxent:
    """The model without weights; ``masses`` are the smoothed counts of all slots, in whole classes."""
    mass = np.maximum(masses, 1e-30).reshape(-1, _MEMBERS)
    return Maxent(
        np.zeros((buckets, len(mass)), dtype=np.float32),
        np.zeros((buckets, _MEMBERS), dtype=np.float32),
        np.log(mass.sum(axis=1) / mass.sum()).astype(np.float32),
        np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32),
        vocabulary,
        rare,
    )


def _mixing_round(texts: DataFrame, shared, rate: float) -> list:
    """Sums of the tasks' weight changes by table and block of buckets, each row's change weighted by
    how often the task used it, and the sums of these weights.  Changes are sent in half precision."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, start_model = shared.value
        ranks = _Ranks(words)
        model = replace(start_model, by_class=start_model.by_class.copy(), by_word=start_model.by_word.copy())
        steps = tuple((np.full(len(t), 1e-2, dtype=np.float32), np.zeros(len(t), dtype=np.float32)) for t in model.tables)
        for tokens in _chunks(batch["text"] for batch in batches):
            r, h = ranks(tokens.words)
            one, two = tokens.histories(h[tokens.codes])
            model.learn(model.slots(r, h)[tokens.codes], one, two, steps, rate)
        rows = []
        for t, (new, old, (_, seen)) in enumerate(zip(model.tables, start_model.tables, steps, strict=True)):
            change = (new - old).astype(np.float16)
            for b in range(0, len(change), _BLOCK):
                if seen[b : b + _BLOCK].any():
                    rows.append((t, b, change[b : b + _BLOCK].tobytes(), seen[b : b + _BLOCK].tobytes()))
        yield pd.DataFrame(rows, columns=["t", "b", "change", "seen"])

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for t, b, change, seen in batch.itertuples(index=False):
                weights = np.frombuffer(seen, dtype=np.float32)
                rows = np.frombuffer(change, dtype=np.float16).reshape(len(weights), -1)
                arrived = [rows * weights[:, None], weights]
                if (t, b) in sums:
                    for own, more in zip(sums[t, b], arrived, strict=True):
                        own += more
                else:
                    sums[t, b] = [x.astype(np.float64) for x in arrived]
        rows = [(t, b, *(v.astype(np.float32).tobytes() for v in both)) for (t, b), both in sums.items()]
        yield pd.DataFrame(rows, columns=["t", "b", "change", "seen"])

    kind = "t int, b int, change binary, seen binary"
    changes = texts.mapInPandas(local, kind)
    # A task keeps one running sum for each of its blocks, however many tasks sent changes.
    return changes.repartition(16, "t", "b").mapInPandas(summed, kind).collect()


def train(
    texts: DataFrame, words: list[bytes], masses: np.ndarray, vocabulary: int, rare: int,
    buckets: int = 1 << 15, rounds: int = 4, rate: float = 1.0,
) -> Maxent:
    """Fit on ``texts(text)``; every text is learned from once.

    Round k takes every ``rounds``-th partition, so that a partition's changes are sent once; the
    next round starts from the mean of what its tasks have learned.  ``buckets`` is a power of two.  What reaches the driver is
    the model, whose size is set by the parameters.
    """
    model = _unigram(masses, vocabulary, rare, buckets)
    context = texts.sparkSession.sparkContext
    for k in range(rounds if len(words) else 0):
        shared = context.broadcast((words[: _LEARNED], model))
        part = texts.filter(F.spark_partition_id() % rounds == k)
        for r in _mixing_round(part.select("text"), shared, rate):
            table = model.tables[r["t"]]
            block = table[r["b"] : r["b"] + _BLOCK]
            seen = np.frombuffer(r["seen"], dtype=np.float32)
            block += np.frombuffer(r["change"], dtype=np.float32).reshape(block.shape) / np.maximum(seen, 1)[:, None]
        shared.unpersist()
    return model


def _slot_masses(counts: DataFrame, words: list[bytes], c: np.ndarray, rare: int) -> np.ndarray:
    """Smoothed counts of all slots: those of the vocabulary's words, filled up to whole classes, and
    of the hashed slots, each with one unseen word more."""
    first = -(-len(words) // _MEMBERS) * _MEMBERS
    masses = np.r_[c + 0.1, np.zeros(first - len(words)), np.full(rare, 0.1)]
    # xxhash64 is signed; the decimal is its unsigned value.  One row for each hashed slot.
    slot = F.pmod(F.conv(F.hex(F.xxhash64("word")), 16, 10).cast("decimal(20)"), F.lit(rare)).cast("int")
    for r in counts.groupBy(slot.alias("slot")).agg(F.sum(F.col("c") + 0.1).alias("mass")).collect():
        masses[first + r["slot"]] += r["mass"]
    for w, n in zip(words, c, strict=True):
        masses[first + _hash(w) % rare] -= n + 0.1
    return np.where(np.arange(len(masses)) < first, masses, np.maximum(masses, 0.1))


def score(
    docs: DataFrame, folds: int = 10, remainder: int = 0, frequent: int = 150_000,
    vocabulary: int = 48 * _MEMBERS, rare: int = 32 * _MEMBERS, **training,
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``.

    Learns from rows outside the held-out fold; a row without doc_id is never held out.  A null or
    empty text is its end alone.  Repeated rows count and stay as often as they occur; whole texts
    are counted and scored; with nothing to learn from every probability is 1; an empty table
    gives no rows; other columns are not read.

    The ``frequent`` most frequent words go to every task.  All other words, none of which can be
    hot, are joined to their counts.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        held_out("doc_id", folds, remainder).alias("held_out"),
    )
    learned = rows.filter("NOT held_out").select("text")
    counts = materialize(count_words(learned), "word-counts")
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = whole["n"], whole["v"]
    top = _most_frequent(counts, frequent)
    words, c = [w for w, _ in top], np.array([n for _, n in top], dtype=np.float64)
    vocabulary = min(vocabulary, len(words))
    masses = _slot_masses(counts, words[:vocabulary], c[:vocabulary], rare)
    model = train(learned, words, masses, vocabulary, rare, **training)
    shared = spark.sparkContext.broadcast((words, model))
    logs = spark.sparkContext.broadcast((np.r_[np.log10(c + 0.1), 0.0], np.log10(np.maximum(masses, 1e-30))))

    kind = "n_tokens long, known long, base double, inner double, outer double, rare array<string>"

    @F.pandas_udf(kind)
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        frequent_words, lm = shared.value
        by_rank, by_slot = logs.value
        ranks = _Ranks(frequent_words)
        for texts in batches:
            done = [scores(t, ranks, lm, by_rank, by_slot) for t in _chunks([texts])]
            yield pd.concat(done, ignore_index=True)

    def scores(tokens: Tokens, ranks: _Ranks, lm: Maxent, by_rank: np.ndarray, by_slot: np.ndarray) -> pd.DataFrame:
        r, h = ranks(tokens.words)
        slots = lm.slots(r, h)
        outside = np.where(r >= lm.vocabulary, by_rank[r] - by_slot[slots], 0.0)
        inner = lm.log_probability(slots[tokens.codes], *tokens.histories(h[tokens.codes])) / np.log(10)
        codes, starts = tokens.codes, tokens.starts
        unranked = np.flatnonzero((r == ranks.other)[codes])
        strings = [_text(tokens.words[k]) for k in codes[unranked].tolist()]
        at = [*np.searchsorted(unranked, starts).tolist(), len(strings)]
        return pd.DataFrame(
            {
                "n_tokens": tokens.lengths,
                "known": np.add.reduceat((r < ranks.other)[codes].astype(np.int64), starts),
                "base": np.add.reduceat(by_rank[r][codes], starts),
                "inner": np.add.reduceat(inner, starts),
                "outer": np.add.reduceat(outside[codes], starts),
                "rare": [strings[a:b] for a, b in zip(at[:-1], at[1:], strict=True)],
            }
        )

    scored = rows.select("doc_id", "held_out", parts("text").alias("p"))
    scored = materialize(scored.select("doc_id", "held_out", "p.*", F.monotonically_increasing_id().alias("row")), "scored")
    rare = scored.select("row", F.explode("rare").alias("word"))
    rare = rare.join(counts, "word", "left").groupBy("row").agg(
        F.count("c").alias("rare_known"),
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("rare_log"),
    )
    added = scored.drop("rare").join(rare, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    denominator = np.log10(total + 0.1 * (distinct + 1))
    return added.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n_tokens") * float(denominator)).alias("base_score"),
        (F.col("inner") + F.col("outer") + rare_log).alias("score"),
    )
