"""BPE encoding and decoding (operator 10).

Byte-level BPE over the vocabulary file of a public tokenizer. A word's symbols form a doubly linked list;
candidate merges wait in a priority queue ordered by (rank, position), packed in one integer, and entries whose
symbols have changed since they were queued are skipped. Decoding concatenates the vocabulary's byte strings.

Defined results: a null or empty text has no ids and decodes to ''. Special-token strings in a text become the
special id, as in the tokenizers library's default. Every row is encoded whole; other columns are left alone.
Spark partitions the rows; a Python process keeps a bounded memo of words it has already encoded, from task to task,
which changes speed only.
"""

from __future__ import annotations

import json
import struct
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from string import punctuation

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import table

#: Fixed value: the byte-level pre-tokenizer's split pattern, with white space as Unicode's White_Space property.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
MEMO_WORDS, MEMO_PIECES = 200_000, 100_000  # what a process remembers; frequent ones come first and stay


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of byte-level tokenizers."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_model(path: str) -> dict:
    """Vocabulary file (tokenizers' JSON) -> plain tables; a few MB, read once on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters = spec["model"]["vocab"], byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for text, i in vocab.items():
        strings[i] = bytes(letters[c] for c in text)
    for text, i in special.items():
        strings[i] = text.encode()
    ranks, made = {}, []
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        ranks[vocab[left], vocab[right]] = rank
        made.append(vocab[left + right])
    return {"strings": strings, "ranks": ranks, "made": made, "bytes": [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], "special": special}


def merge_word(data: bytes, byte_ids: list[int], ranks: dict, made: list[int]) -> list[int]:
    """Ids of one pre-token: lowest rank first, ties leftmost. ``at`` is the rank of the pair that begins at a symbol."""
    ids = [byte_ids[b] for b in data]
    n, get = len(ids), ranks.get
    at, queue, left = [], [], ids[0]
    for i, right in enumerate(ids[1:]):
        rank = get((left, right))
        at.append(rank)
        if rank is not None:
            queue.append(rank * n + i)
        left = right
    if not queue:
        return ids
    queue.sort()
    at.append(None)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while queue:
        entry = heappop(queue)
        i, rank = entry % n, entry // n
        if at[i] != rank:
            continue  # stale: a symbol of this pair has been merged since
        j, p = after[i], before[i]
        after[i] = k = after[j]
        ids[i] = new = made[rank]
        ids[j], at[j], at[i] = -1, None, None
        if k < n:
            before[k] = i
            at[i] = rank = get((new, ids[k]))
            if rank is not None:
                heappush(queue, rank * n + i)
        if p >= 0:
            at[p] = rank = get((ids[p], new))
            if rank is not None:
                heappush(queue, rank * n + p)
    return [x for x in ids if x >= 0]


class Encoder:
    """Encodes whole texts to packed little-endian unsigned 32-bit ids."""

    def __init__(self, model: dict):
        self.byte_ids, self.ranks, self.made, self.special = model["bytes"], model["ranks"], model["made"], model["special"]
        self.words, self.split = {}, regex.compile(SPLIT).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        outer = self

        class Pieces(dict):  # by what follows a lone space
            def __missing__(self, piece: str) -> bytes:
                out = outer.piece(piece)
                if len(self) < MEMO_PIECES:
                    self[piece] = out
                return out

        self.pieces = Pieces()

    def word(self, word: str) -> bytes:
        """One pre-token."""
        ids = self.words.get(word)
        if ids is None:
            got = merge_word(word.encode(), self.byte_ids, self.ranks, self.made)
            ids = struct.pack(f"<{len(got)}I", *got)
            if len(self.words) < MEMO_WORDS:
                self.words[word] = ids
        return ids

    def piece(self, text: str, space: str = " ") -> bytes:
        """``space`` and a text without one. Letters are one pre-token with their space, ASCII marks that end the text behind
        them another; a line end between such parts is one too. The pattern decides all else."""
        letters = text.rstrip(punctuation)
        if letters.isalpha():
            first = self.word(space + letters)
            return first if len(letters) == len(text) else first + self.word(text[len(letters) :])
        line, end, rest = text.partition("\n")
        if end and line.rstrip(punctuation).isalpha() and rest.rstrip(punctuation).isalpha():
            return self.piece(line, space) + self.word(end) + self.piece(rest, "")
        return self.run(space + text)

    def run(self, text: str) -> bytes:
        return b"".join(map(self.word, self.split(text)))

    def plain(self, text: str) -> bytes:
        # At a lone space the pattern always begins a new pre-token, so the parts can be encoded one by one.
        if "  " in text or text[-1:] == " ":
            return self.run(text)
        first, *rest = text.split(" ")
        get = self.pieces.__getitem__
        return self.run(first) + b"".join(map(get, rest))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.specials is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.specials(text)
        return b"".join(struct.pack("<I", self.special[x]) if k % 2 else self.plain(x) for k, x in enumerate(parts) if x)


_LAST: list = []  # a Python process's last model and encoder


def encoder(model: dict) -> Encoder:
    """The process's encoder of ``model``: tasks that follow each other in a process share its memo."""
    if not _LAST or _LAST[0] is not model:
        _LAST[:] = [model, Encoder(model)]
    return _LAST[1]


KINDS = {"binary": (pa.binary(), T.BinaryType()), "string": (pa.string(), T.StringType())}


def _map_column(df: DataFrame, source: str, targets: dict[str, str], make: Callable[[], Callable]) -> DataFrame:
    """Adds columns (name -> kind) that a function of one column gives, as a tuple; one Python process a task."""
    kept = [f for f in df.schema.fields if f.name not in targets]
    schema = T.StructType(kept + [T.StructField(n, KINDS[k][1]) for n, k in targets.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            got = [f(x.as_py()) for x in batch.column(source)]
            new = [pa.array([g[i] for g in got], KINDS[k][0]) for i, k in enumerate(targets.values())]
            keep = [n for n in batch.schema.names if n not in targets]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *new], [*keep, *targets])

    return df.mapInArrow(run, schema)


def _decoder(strings: list[bytes]) -> Callable[[bytes | None], str]:
    string = strings.__getitem__
    return lambda packed: b"".join(map(string, array("I", packed or b""))).decode("utf-8", "replace")


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds column ``ids``: the whole text's ids, packed as little-endian unsigned 32-bit integers."""
    model = df.sparkSession.sparkContext.broadcast(load_model(vocabulary))

    def make():
        run = encoder(model.value).encode
        return lambda x: (run(x),)

    return _map_column(df, text, {ids: "binary"}, make)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds column ``text``: the vocabulary strings of packed ids, concatenated; bytes that aren't UTF-8 become U+FFFD."""
    model = df.sparkSession.sparkContext.broadcast(load_model(vocabulary)["strings"])

    def make():
        run = _decoder(model.value)
        return lambda x: (run(x),)

    return _map_column(df, ids, {text: "string"}, make)


def coded(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds both columns: the ids of ``text`` as encode() gives them, and what decode() makes of those ids."""
    model = df.sparkSession.sparkContext.broadcast(load_model(vocabulary))

    def make():
        there, back = encoder(model.value).encode, _decoder(model.value["strings"])

        def both(x: str | None) -> tuple[bytes, str]:
            packed = there(x)
            return packed, back(packed)

        return both

    return _map_column(df, text, {ids: "binary", decoded: "string"}, make)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, decoded, n_tokens for every row of ``docs``."""
    return coded(docs.select("doc_id", "text"), vocabulary).select("doc_id", "ids", "decoded", (F.length("ids") / 4).cast("long").alias("n_tokens"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = round_trip(table(spark, sf_dir, "documents"), default_vocabulary())
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op10_bpe": query}
ORACLES: dict[str, str] = {}
