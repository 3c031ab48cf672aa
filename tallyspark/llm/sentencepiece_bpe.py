"""Operator 3: exact encoding with a merge-type SentencePiece model, and decoding.

The encoding is found without running merges over the text.  A sequence of pieces is the encoding
exactly if each two neighbours are compatible, that is if merging their joined characters gives
these two pieces again.  So from left to right the longest piece is taken that is compatible with
the one before; where none is, the position is marked as failed in a bit field, the last piece is
taken back, and a shorter one is tried in its place.  The pieces at each position come from one
pass of an Aho-Corasick automaton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, documents

MARK = "▁"
#: Entries of each of the two generations of a worker's cache of chunks, of its cache of pairs, and the longest chunk kept.
CHUNKS, PAIRS, LONGEST = 350_000, 500_000, 48
#: The rank of what is no piece.
NONE = 1 << 40


class Encoder:
    """Encodes and decodes as the library does with the same model: no begin or end ids, no sampling."""

    def __init__(self, model: bytes):
        self.library = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(p.get_piece_size())
        normal = [i for i in every if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.ids = {p.id_to_piece(i): i for i in normal}
        self.rank = {x: k for k, x in enumerate(sorted(self.ids, key=lambda x: (-p.get_score(self.ids[x]), self.ids[x])))}
        self.pieces = {i: x for x, i in self.ids.items()}
        self.single = {x for x in self.ids if len(x) == 1}
        unknown = {c for x in self.ids for c in x} - self.single
        if unknown or any(MARK in x.lstrip(MARK) for x in self.ids):
            raise ValueError("a piece has characters that are no pieces, or a word end inside it")
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for x, i in self.ids.items():
            self.automaton.add_word(x, (len(x), i))
        self.automaton.make_automaton()
        self.chunks: dict[str, str] = {}  # the ids as text: a fraction of the memory of numbers
        self.older: dict[str, str] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves: always the best-ranked pair of neighbours, the leftmost among equals."""
        parts, rank = list(text), self.rank.get
        value = [rank(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while value:
            best = min(value)
            if best == NONE:
                break
            at = value.index(best)
            parts[at] += parts.pop(at + 1)
            del value[at]
            if at:
                value[at - 1] = rank(parts[at - 1] + parts[at], NONE)
            if at < len(value):
                value[at] = rank(parts[at] + parts[at + 1], NONE)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            x, y = self.pieces[a], self.pieces[b]
            known = self.pairs[key] = self.merged(x + y) == [x, y]
        return known

    def _segment(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        seen, compatible = self.pairs.get, self.compatible
        out: list[int] = []
        last, done = -1, 0
        for _, (length, i) in self.automaton.iter_long(text):  # the longest piece each time: often they are compatible
            if last >= 0:
                good = seen(last << 32 | i)
                if not (good or (good is None and compatible(last, i))):
                    break
            out.append(i)
            last = i
            done += length
        return out if done == len(text) else self._backtracked(text)

    def _backtracked(self, text: str) -> list[int]:
        n = len(text)
        at: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, match in self.automaton.iter(text):
            at[end + 1 - match[0]].append(match)  # matches come by their end, so the longest is last
        seen, compatible = self.pairs.get, self.compatible
        failed = pos = 0
        last = -1
        out: list[tuple[int, int]] = []
        k = len(at[0])  # how many of the pieces at `pos` are still to be tried
        untried: list[int] = []  # the same for the positions of the pieces in `out`
        while pos < n:
            here = at[pos]
            while k:
                k -= 1
                length, i = here[k]
                if not failed >> (pos + length) & 1:
                    if last < 0:
                        break
                    good = seen(last << 32 | i)
                    if good or (good is None and compatible(last, i)):
                        break
            else:
                failed |= 1 << pos
                if not out:
                    raise ValueError(f"no encoding of {text!r}")
                pos -= out.pop()[0]
                k = untried.pop()
                last = out[-1][1] if out else -1
                continue
            out.append((length, i))
            untried.append(k)
            pos += length
            last = i
            if pos < n:
                k = len(at[pos])
        return [i for _, i in out]

    def chunk(self, key: str) -> str:
        """Ids, as decimals joined by commas, of one run of marks and the characters up to the next; `key` lacks the first mark."""
        known = self.chunks.get(key) or self.older.get(key)
        if known is None:
            text = MARK + key
            out: list[int] = []
            if self.single.issuperset(text):
                out = self._segment(text)
            else:
                run = ""
                for c in text:
                    if c in self.single:
                        run += c
                        continue
                    out += self._segment(run) if run else []
                    run = ""
                    out += [self.bytes[b] for b in c.encode("utf-8", "replace")]
                out += self._segment(run) if run else []
            known = ",".join(map(str, out))
        if len(key) <= LONGEST:
            if len(self.chunks) >= CHUNKS:  # what is still in use comes over from the older generation
                self.older = self.chunks
                self.chunks = {}
            self.chunks[key] = known
        return known

    def encode(self, text: str | None) -> tuple[list[int], str]:
        """The ids, as a list and as decimals joined by commas; none for a null or empty text."""
        if not text:
            return [], ""
        found = text.replace(MARK, " ").split(" ")
        get, chunk = self.chunks.get, self.chunk
        said = ",".join([get(w) or chunk(w) for w in (found if "" not in found else _runs(found))])
        return list(map(int, said.split(","))), said

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def _runs(found: list[str]) -> Iterator[str]:
    """The words, each behind the marks that precede it but the first; the last may be marks alone."""
    run = ""
    for k, w in enumerate(found):
        if w or k == len(found) - 1:
            yield run + w
            run = ""
        else:
            run += MARK


#: Texts that tell a model's settings: white space kept as it is, a mark before the first word, no normal forms, digits, bytes.  Another model is refused.
PROBES = ["a", " a", "a ", "  a  b ", "a\tb\nc", "A", "\uff21\ufb01", "e\u0301 \u00e9", "12345 1 2", "<s> </s> <unk>", "\u6f22\U0001f600", MARK + "a" + MARK, "\u200b\u00a0x", "http://x.y/z?a=b&c"]


@dataclass
class Shared:
    """A model as it is broadcast.  A worker makes its encoder once for all tasks of a query; the encoder and its caches go with the broadcast,
    when the worker gets a task of a query without it.  Kept by the process they would stay beside what later stages need."""

    model: bytes

    @cached_property
    def encoder(self) -> Encoder:
        made = Encoder(self.model)
        wrong = [t for t in PROBES if made.encode(t)[0] != made.library.encode(t)]
        if wrong:
            raise ValueError(f"this model treats texts in a way that is not provided for: {wrong[0]!r}")
        return made


def model_bytes(model_file: str) -> bytes:
    """Read once, on the driver: executors need no file.  A model is of fixed size, here half a MB."""
    with open(model_file, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model_file: str, text_col: str = "text", ids: bool = True, texts: bool = True) -> DataFrame:
    """`docs` with `n_tokens`, `ids_sha256`, `decoded_sha256` and, where asked for, `token_ids` and `decoded`.

    `ids_sha256` is of the decimal ids joined by commas, `decoded_sha256` of the decoded text.  Works
    row by row, so nothing is shuffled.  Null and empty texts have no ids and decode to ''.  Texts of
    any length are encoded whole, in time that grows with their length.  Repeated rows each get their
    result; an empty table gives an empty one.  The new columns replace input columns of those names, others are kept.
    A model whose settings are others than those provided for is refused.
    """
    c = Carried(docs)
    held = docs.sparkSession.sparkContext.broadcast(Shared(model_bytes(model_file)))
    names = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"token_ids": "array<int>"} if ids else {}) | ({"decoded": "string"} if texts else {})

    # Takes the text alone to Python, a hundred rows at a time: an Arrow batch would be 10,000 texts and their ids, several times over on either side.
    @F.udf(", ".join(f"{k} {v}" for k, v in names.items()), useArrow=False)
    def run(text: str | None) -> tuple:
        e = held.value.encoder
        found, said = e.encode(text)
        decoded = e.decode(found) if found else ""
        row = (len(found), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        return row + ((found,) if ids else ()) + ((decoded,) if texts else ())

    out = c.df.withColumn("__out", run(c.col(text_col)))
    return c.restore(out, **{k: F.col("__out")[k] for k in names})


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return encode_decode(docs, model_file or public_model(), ids=False, texts=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
