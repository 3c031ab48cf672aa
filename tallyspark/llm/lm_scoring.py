"""Operator 4: language-model scores from a log-frequency Bloom filter.

All word pairs count.  A word b behind a word a has the probability (n(a, b) + m(a) P(b)) / (c(a) + m(a)), with the
weight m(a) of the single words a function of c(a) for the `HOT_WORDS` most frequent words, and a constant for others.

Counts of all pairs are held in a log-frequency Bloom filter: a pair whose count is
of level q (1 + floor(log2 count)) is entered q times, as (pair, 1) .. (pair, q), and its count is read back, as the mean of its
level, by probing levels from 1 until one is missing.  No score sees a pair's count but by such probes.

The filter is cut by hash.  It grows with the corpus, so only a part of a proven bound is broadcast: that of the pairs of
the `PAIR_WORDS` most frequent words, at most `PAIR_WORDS`^2 whatever the size of the corpus, with the exact counts of the
hot words.  All other pairs are dealt to hash shards, as many as the texts need, packed by chunks of texts.  A shard
has every occurrence of its pairs: it counts those of training texts, enters the counts' levels into its part
of the filter, and answers all texts by probing it, chunk by chunk.  A pair with a rarer
word as its second goes with that word, whose exact count comes out at the same place.  A pair that is not broadcast
has at most a `PAIR_WORDS`th of the words, so no shard is much larger than others.

A rarer word is known by 62 bits of its XXH64.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, documents, stored

HOT_WORDS, PAIR_WORDS = 65_536, 2_048
#: Of the filter: bits for each entry, probes, parts in which it is built, most levels.
BITS, PROBES, SHARDS, LEVELS = 12, 6, 64, 40
#: The weight of single words behind a word: of hot ones, WEIGHT * count^POWER; of others.
WEIGHT, POWER, RARE_WEIGHT = 4.0, 0.8, 10.0
#: The end of a text, as a token: no word is empty.
END = b""
#: Tokens that are scored at a time, and distinct words that a task gathers before it hands them on.
CHUNK, GATHER = 200_000, 300_000
#: Bytes of text for each hash shard, about 350,000 pairs.
SHARD_BYTES = 3_000_000


def tokens(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, A-Z lower-cased, and the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits (the splitmix64 finaliser)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def positions(pairs: np.ndarray, level: np.ndarray | int, bits: int) -> np.ndarray:
    """Bit positions of (pair, level) inside the pair's shard of `bits` bits, one row for each probe."""
    a = mixed(pairs.astype(np.uint64) * np.uint64(64) + np.asarray(level).astype(np.uint64))
    b = mixed(a ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(PROBES)])


def shard(pairs: np.ndarray) -> np.ndarray:
    return (mixed(pairs.astype(np.uint64)) % np.uint64(SHARDS)).astype(np.int64)


def probed(keys: np.ndarray, level_means: np.ndarray, has) -> np.ndarray:
    """The count that a filter has of each key: the mean of its level, 0 where level 1 is missing.  `has` says of the keys at
    some places which have a level."""
    out, at = np.zeros(len(keys)), np.arange(len(keys))
    for q in range(1, len(level_means)):
        at = at[has(at, q)]
        if not len(at):
            break
        out[at] = level_means[q]
    return out


def quantised(keys: np.ndarray, counts: np.ndarray, each: int = BITS) -> np.ndarray:
    """The counts of distinct keys as they come back from a filter that holds those above 0, with `each` bits an entry."""
    held = np.flatnonzero(counts > 0)
    if not len(held):
        return np.zeros(len(keys))
    levels = np.minimum(np.frexp(counts[held])[1], LEVELS)
    means = np.bincount(levels, counts[held]) / np.maximum(np.bincount(levels), 1)
    bits = max(64, 8 * math.ceil(int(levels.sum()) * each / 8))
    table = np.frombuffer(filled(keys[held], levels, bits), np.uint8)

    def has(at: np.ndarray, q: int) -> np.ndarray:
        p = positions(keys[at], q, bits).astype(np.int64)
        return (table[p >> 3] >> (p & 7).astype(np.uint8) & 1).all(0)

    return probed(keys, means, has)


def filled(pairs: np.ndarray, levels: np.ndarray, bits: int) -> bytes:
    """The bits of one shard."""
    out = np.zeros(bits, np.uint8)
    for q in range(1, int(levels.max(initial=0)) + 1):
        out[positions(pairs[levels >= q], q, bits).ravel().astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


@dataclass
class Model:
    total: int  # training tokens
    distinct: int  # distinct training tokens
    once: int  # of these, found once
    hot: dict[bytes, int]  # word -> place by count
    counts: np.ndarray  # by place
    bits: int  # of a shard
    filter: np.ndarray  # shards, packed
    level_means: np.ndarray  # mean count of a pair by level
    stay: np.ndarray  # by place: the share of a word's followers that is left to single words
    pair_words: int = PAIR_WORDS  # pairs of places below are in the broadcast part of the filter
    each: int = BITS  # bits of the other parts for each entry

    def weight(self, places: np.ndarray) -> np.ndarray:
        return WEIGHT * np.maximum(self.counts[places], 1) ** POWER

    def base(self, c):
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def unigram(self, c):
        """log10 of a word's probability.  Good-Turing: the words found once stand for the unseen ones, which
        are one class, as in the base."""
        c = np.asarray(c, float)
        if not self.total:
            return self.base(c)
        unseen = min(0.5, max(1, self.once) / self.total)
        return np.log10(np.where(c > 0, c / self.total * (1 - unseen), unseen))

    def count_of(self, pairs: np.ndarray) -> np.ndarray:
        """The count that the broadcast part of the filter has of each pair of places."""
        part = shard(pairs)

        def has(at: np.ndarray, q: int) -> np.ndarray:
            p = positions(pairs[at], q, self.bits).astype(np.int64)
            return (self.filter[part[at][None, :], p >> 3] >> (p & 7).astype(np.uint8) & 1).all(0)

        return probed(pairs, self.level_means, has)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter = Counter()

    def said() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["token", "c"])

    for b in batches:
        for text in b.column(0):
            n.update(tokens(text.as_py()))
            if len(n) >= GATHER:
                yield said()
                n.clear()
    yield said()


def _pairs_of(hot: dict[bytes, int]):
    end = hot[END]

    def counted(places: list[int], starts: list[int]) -> pa.RecordBatch:
        p = np.array(places, np.int64)
        a, b = p[:-1], p[1:]
        good = (a < PAIR_WORDS) & (b < PAIR_WORDS)
        good[np.array(starts[1:], np.int64) - 1] = False  # one text's end and the next one's start
        pair, n = np.unique(a[good] * PAIR_WORDS + b[good], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: list[int] = []
        starts: list[int] = []
        for b in batches:
            for text in b.column(0):
                starts.append(len(places))
                places.append(end)
                places += [hot.get(w, PAIR_WORDS) for w in tokens(text.as_py())]
                if len(places) >= 8 * CHUNK:
                    yield counted(places, starts)
                    places, starts = [], []
        if places:
            yield counted(places, starts)

    return run


def _most_frequent(counts: DataFrame) -> list:
    """Up to `HOT_WORDS` words, the most frequent ones, by falling count.

    The least count comes from a histogram of logarithms, of a thousand bins at most; so only these
    words reach the driver, and not as many from every task.
    """
    bin_ = F.floor(F.log2("c") * 16).cast("int").alias("bin")
    least, n = None, 0
    for r in sorted(counts.groupBy(bin_).count().collect(), key=lambda r: -r.bin):
        n += r["count"]
        if n > HOT_WORDS:
            break
        least = r.bin
    if least is None:
        return []
    return sorted(counts.where(F.floor(F.log2("c") * 16) >= least).collect(), key=lambda r: (-r.c, bytes(r.token)))


def learn(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the column `text`, and the exact count `c` of every training `token`."""
    spark = texts.sparkSession
    counts = stored(texts.select("text").mapInArrow(_gathered, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")))
    n, v, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum((F.col("c") == 1).cast("long")), F.lit(0))).first()
    end = F.col("token") == F.lit(bytearray(END))
    top = counts.where(end).collect() + _most_frequent(counts.where(~end))  # the end is first
    hot = {bytes(r.token): i for i, r in enumerate(top)}
    model = Model(n, v, once, hot, np.array([r.c for r in top], np.int64), 8, np.zeros((SHARDS, 1), np.uint8), np.zeros(1), np.ones(len(top)), PAIR_WORDS, BITS)
    if not n:
        return model, counts
    weight = model.weight(np.arange(len(top)))
    model.stay = weight / (model.counts + weight)
    pairs = stored(texts.select("text").mapInArrow(_pairs_of({w: i for w, i in hot.items() if i < PAIR_WORDS}), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")))
    level = F.least(F.lit(LEVELS), F.floor(F.log2("c") + F.lit(1e-9)) + 1).cast("int")
    stats = pairs.groupBy(level.alias("q")).agg(F.count("*").alias("n"), F.avg("c").alias("mean")).collect()
    if not stats:
        return model, counts
    model.level_means = np.zeros(max(r.q for r in stats) + 1)
    for r in stats:
        model.level_means[r.q] = r["mean"]
    model.bits = max(64, 8 * math.ceil(sum(r.q * r.n for r in stats) * BITS / SHARDS / 8))
    bits = model.bits

    def build(_, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "bits": [filled(part["pair"].to_numpy(), part["q"].to_numpy(), bits)]})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("shard", pa.array(shard(b.column(0).to_numpy()), pa.int64()))

    parts = pairs.select("pair", level.alias("q")).mapInArrow(dealt, "pair long, q int, shard long").groupBy("shard").applyInPandas(build, "shard long, bits binary").collect()
    model.filter = np.zeros((SHARDS, bits // 8), np.uint8)
    for r in parts:
        model.filter[r.shard] = np.frombuffer(bytes(r.bits), np.uint8)
    return model, counts


def _scored(model: Model, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For tokens by place (-1: not hot; the text's first behind an END): base, model, known; what depends on rarer
    words and on pairs that are not in the filter is added by their shards."""
    before, now = places[:-1], places[1:]
    hot, held = now >= 0, before >= 0
    at = np.maximum(now, 0)
    c = np.where(hot, model.counts[at] if len(model.counts) else 0, 0)
    base = np.where(hot, model.base(c), 0.0)
    single = model.unigram(c) if model.total else base
    score = np.where(hot, single, 0.0)
    score[held] += np.log10(model.stay[before[held]])
    both = np.flatnonzero(_in_filter(model, before, now))
    if len(both) and len(model.level_means) > 1:
        pair, back = np.unique(before[both] * model.pair_words + now[both], return_inverse=True)
        n = model.count_of(pair)[back]
        score[both] += np.log10(1 + n / (model.weight(before[both]) * 10 ** single[both]))
    return base, score, hot & (c > 0)


def _in_filter(model: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a >= 0) & (a < model.pair_words) & (b >= 0) & (b < model.pair_words)


def _rare(word: bytes) -> int:
    """A negative number for a word that is not hot."""
    return -1 - (xxhash.xxh64_intdigest(word) >> 2)


def _sent(held, shards: int):
    """Rows (shard, chunk, docs, train, pairs): of each chunk of texts what each shard needs, and the texts themselves once.

    `docs` of the latter is a record batch; of the others the number of each pair's text in the chunk.  Pairs of hot words are
    (place * hot words + place, 0), those with a rarer second word (it, the first), those with a rarer first word
    alone (it, hot words + place of the second): a rarer word is negative, a hot one its place.
    """
    names = ["shard", "chunk", "docs", "train", "pairs"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        get, end, hot = model.hot.get, model.hot.get(END, -1), len(model.hot)

        def done(id_type: pa.DataType, uids: list[int], ids: list, train: list[bool], words: array, ends: list[int]) -> pa.RecordBatch:
            w, cut = np.array(words, np.int64), np.array(ends, np.int64)
            base, score, known = _scored(model, np.maximum(w, -1))
            # each text takes one leading end and its tokens; the value for that leading end (position cut) is not its own
            starts = np.r_[0, cut[:-1]]
            sums = []
            for x in (base, score, known.astype(np.int64)):
                total = np.r_[0, np.cumsum(x)]
                sums.append(total[cut - 1] - total[starts])
            said = pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(train, pa.bool_()), pa.array(cut - starts - 1), *map(pa.array, sums)], names=["id", "train", "n_tokens", "base", "score", "n_known"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, said.schema) as out:
                out.write_batch(said)
            rows = [(uids[0] % shards, uids[0], sink.getvalue().to_pybytes(), None, None)]
            a, b = w[:-1], w[1:]
            ours = ~_in_filter(model, a, b)
            ours[cut[:-1] - 1] = False  # one text's end and the next one's start
            if not model.total:
                ours[:] = False  # no pair and no rarer word has a count
            at = np.flatnonzero(ours)
            a, b = a[at], b[at]
            doc = np.searchsorted(cut, at, side="right").astype(np.uint32)
            one = np.where(b < 0, b, np.where(a < 0, a, a * hot + b))
            two = np.where(b < 0, a, np.where(a < 0, hot + b, 0))
            to = (mixed(one) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            one, two, doc, to = one[order], two[order], doc[order], to[order]
            is_train = np.array(train, bool)[doc]
            first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else []
            for x, y in zip(first, np.r_[first[1:], len(to)].astype(np.int64) if len(to) else [], strict=True):
                k, m, plain = one[x:y], two[x:y], one[x:y] >= 0
                o = np.argsort(~plain, kind="stable")  # pairs of hot words first: five bytes are enough for them
                n = int(plain.sum())
                body = n.to_bytes(4, "little") + _narrow(k[o][:n]) + k[o][n:].tobytes() + m[o][n:].tobytes()
                d = doc[x:y][o]
                rows.append((int(to[x]), uids[0], np.diff(d.astype(np.int64), prepend=0).astype(np.int32).tobytes(), np.packbits(is_train[x:y][o]).tobytes(), body))
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        id_type = pa.null()
        uids, ids, train, words, ends = [], [], [], array("q"), []
        for b in batches:
            id_type = b.column(1).type
            for uid, i, is_train, text in zip(*b.columns, strict=True):
                mine = [end]
                for t in tokens(text.as_py()):
                    place = get(t)
                    mine.append(_rare(t) if place is None else place)
                words.extend(mine)
                ends.append(len(words))
                uids.append(uid.as_py())
                ids.append(i.as_py())
                train.append(is_train.as_py())
                if len(words) >= CHUNK:
                    yield done(id_type, uids, ids, train, words, ends)
                    uids, ids, train, words, ends = [], [], [], array("q"), []
        if uids:
            yield done(id_type, uids, ids, train, words, ends)

    return run


def _narrow(x: np.ndarray) -> bytes:
    """Numbers below 2^40 as five bytes each."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _wide(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.view("<i8").ravel()


def _answered(held):
    """What a shard adds to each text: rows (chunk, docs, sums), and the texts themselves as they came."""

    def run(part: pa.Table) -> pa.Table:
        model: Model = held.value
        hot = len(model.hot)
        rows = [r for r in zip(*(part.column(n).to_pylist() for n in ("chunk", "docs", "train", "pairs")), strict=True)]
        out = [(chunk, docs, None) for chunk, docs, _, pairs in rows if pairs is None]
        rows = [r for r in rows if r[3] is not None]
        if rows:
            ones, twos, docs, trains, sizes = [], [], [], [], []
            for _, d, t, body in rows:
                n = int.from_bytes(body[:4], "little")
                rest = np.frombuffer(body[4 + 5 * n :], np.int64)
                d = np.cumsum(np.frombuffer(d, np.int32))
                ones += [_wide(body[4 : 4 + 5 * n]), rest[: len(rest) // 2]]
                twos += [np.zeros(n, np.int64), rest[len(rest) // 2 :]]
                docs.append(d)
                sizes.append(len(d))
                trains.append(np.unpackbits(np.frombuffer(t, np.uint8), count=len(d)).astype(bool))
            one, two, doc, train = (np.concatenate(x) for x in (ones, twos, docs, trains))
            base, score, known = _shard_scored(model, hot, one, two, train)
            x = 0
            for (chunk, *_), size in zip(rows, sizes, strict=True):
                y = x + size
                d, back = np.unique(doc[x:y], return_inverse=True)
                sums = [np.bincount(back, v[x:y], len(d)) for v in (base, score, known)]
                out.append((chunk, d.astype(np.int32).tobytes(), sums[0].tobytes() + sums[1].tobytes() + sums[2].astype(np.int32).tobytes()))
                x = y
        made = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(list(x), k) for x, k in zip(made, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "docs", "sums"])

    return run


def _shard_scored(model: Model, hot: int, one: np.ndarray, two: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base, model and known of a shard's pairs, in the form that `_sent` gives them.  The pairs' counts come from the
    shard's part of the filter."""
    base, score, known = np.zeros(len(one)), np.zeros(len(one)), np.zeros(len(one), np.int64)
    keys, back = np.unique(mixed(one.astype(np.uint64) ^ mixed(two.astype(np.uint64))), return_inverse=True)
    n = quantised(keys, np.bincount(back, train), model.each)[back]
    weight, single = np.full(len(one), RARE_WEIGHT), np.zeros(len(one))
    plain = one >= 0
    second = np.flatnonzero(~plain & (two < hot))  # the rarer word is the second
    words, back = np.unique(one[second], return_inverse=True)
    c = np.bincount(back, train[second], len(words))[back] if len(words) else np.zeros(0)
    single[second] = model.unigram(c)
    base[second], known[second] = model.base(c), c > 0
    score[second] = single[second] + np.log10(RARE_WEIGHT / (c + RARE_WEIGHT))  # what stays of the word as a first one: it is one as often
    led = second[two[second] >= 0]
    weight[led] = model.weight(two[led])
    first = ~plain & (two >= hot)
    single[first] = model.unigram(model.counts[two[first] - hot])
    weight[plain] = model.weight(one[plain] // hot) if hot else RARE_WEIGHT
    single[plain] = model.unigram(model.counts[one[plain] % hot]) if hot else 0
    return base, score + np.log10(1 + n / (weight * 10**single)), known


def _summed(part: pa.Table) -> pa.Table:
    """The texts of a chunk with the sums of all shards added."""
    rows = list(zip(part.column("docs").to_pylist(), part.column("sums").to_pylist(), strict=True))
    texts = pa.ipc.open_stream(next(d for d, s in rows if s is None)).read_all()
    names = ["base", "score", "n_known"]
    total = [texts.column(n).to_numpy().copy() for n in names]
    for d, s in rows:
        if s is not None:
            at = np.frombuffer(d, np.int32)
            n = len(at)
            for t, x in zip(total, (np.frombuffer(s, np.float64, n), np.frombuffer(s, np.float64, n, 8 * n), np.frombuffer(s, np.int32, n, 16 * n)), strict=True):
                t[at] += x
    return pa.table([*(texts.column(n) for n in ("id", "train", "n_tokens")), *map(pa.array, total)], names=["id", "train", "n_tokens", *names])


def score_texts(docs: DataFrame, train: Column | str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all texts by a model of those for which `train` holds (a condition on the column `id`, or its SQL).

    Returns id, `held_out`, `n_tokens`, `n_known` (tokens found in training), `train_tokens`,
    `base_score` (add-0.1 single words) and `score`, the model's log10 probability of the text.
    Null and empty texts are the end alone.  Rows with a null id are held out.
    Repeated rows each get a row, and equal texts equal scores.  Without training texts both scores are the base's; an empty
    table gives an empty one.  Long texts are scored whole: a task holds one text's tokens at a time besides its chunk.
    Other columns are left behind, whatever their names.
    """
    c = Carried(docs)
    rows = c.df.select(F.monotonically_increasing_id().alias("uid"), c.col(id_col).alias("id"), c.col(text_col).alias("text"))
    rows = rows.withColumn("train", F.coalesce(F.expr(train) if isinstance(train, str) else train, F.lit(False)))
    model, _ = learn(rows.where("train"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    shards = 1 + rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0] // SHARD_BYTES
    kind = rows.schema["id"].dataType.simpleString()
    sent = rows.select("uid", "id", "train", "text").mapInArrow(_sent(held, shards), "shard long, chunk long, docs binary, train binary, pairs binary")
    answers = sent.groupBy("shard").applyInArrow(_answered(held), "chunk long, docs binary, sums binary")
    total = answers.groupBy("chunk").applyInArrow(_summed, f"id {kind}, train boolean, n_tokens long, base double, score double, n_known long")
    return total.select(F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(10)) != 0
    return score_texts(documents(spark, sf_dir).select("doc_id", "text"), train)
