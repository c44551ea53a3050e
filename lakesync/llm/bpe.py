"""Exact BPE by backtracking over longest token matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives every token that occurs in a piece of text, and so the longest one
from each position.  The encoder takes longest matches from the left.  A token may stand next to its predecessor only if
the merge rules, applied to the bytes of the two, give just these two tokens; that is looked up in a table of the pairs
asked for so far.  Where a token does not fit, the next shorter token that is a prefix of it is tried, and where none is
left, the predecessor is taken back and that position is never entered again.  So the work stays linear in the length,
and the tokens are those that applying the merges in order would give.

Decoding keeps the bytes of all tokens in one string; a table of offsets says where each token starts.

Every task reads the vocabulary from a broadcast of fixed size (that of the tokenizer file).  Encoded pieces of up to
``KEPT_CHARS`` characters are kept per task, up to ``KEPT`` of them, since words repeat; the table is emptied when it is full.
Pairs have a table of fixed size, in which a pair takes the place of another.

Defined results: a null text is empty and has no tokens; repeated rows are encoded each; an empty table gives an empty
table; text that is not valid in the vocabulary does not exist, because every byte is a token.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesync.llm.common import giving_back

#: Fixed value: the pattern of the tokenizer's pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a task keeps at once, and the characters of the longest; longer ones hardly repeat.
KEPT = 131_072
KEPT_CHARS = 32
#: Places of the table of pairs (8 bytes each); a power of two.
PAIRS = 1 << 18


def shown_bytes() -> dict[str, int]:
    """Which byte a character of the vocabulary file stands for: printable bytes for themselves, the others from 256 up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def load_vocabulary(tokenizer_json: str) -> dict:
    """Tokens as bytes by id, the id each merge gives, and the special tokens, from the content of a tokenizer file."""
    spec = json.loads(tokenizer_json)
    byte_of = shown_bytes()
    ids = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    pairs = [tuple(ids[bytes(byte_of[c] for c in part)] for part in merge) for merge in merges]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
    return {"ids": ids, "pairs": pairs, "special": special}


class Encoder:
    """Tokens of one piece of text.  Tokens are numbered by rank here: single bytes first, then in merge order."""

    def __init__(self, vocabulary: dict) -> None:
        ids, pairs = vocabulary["ids"], vocabulary["pairs"]
        by_id = {i: token for token, i in ids.items()}
        ranked = [bytes([b]) for b in range(256)]
        rank = {token: r for r, token in enumerate(ranked)}
        self.halves = [(r, r) for r in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in pairs:
            token = by_id[left] + by_id[right]
            if token not in rank:
                rank[token] = len(ranked)
                ranked.append(token)
                self.halves.append((rank[by_id[left]], rank[by_id[right]]))
                self.merged[rank[by_id[left]], rank[by_id[right]]] = rank[token]
        self.sizes = [len(token) for token in ranked]
        self.ids = np.array([ids[token] for token in ranked], "<u4")
        self.automaton = ahocorasick.Automaton()
        for r, token in enumerate(ranked):
            self.automaton.add_word(token.decode("latin-1"), r)
        self.automaton.make_automaton()
        # The longest token that is a proper prefix of a token, -1 for single bytes.
        self.shorter = [next((rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in rank), -1) for token in ranked]
        # Twice the number of a pair and its answer, at the pair's place; -1 where none has been.
        self.fits = array("q", [-1]) * PAIRS

    def fit(self, left: int, right: int) -> bool:
        """Whether the merges keep two neighbouring tokens apart.

        Undo the younger token's merge again and again, and look at the two parts that touch: had a pair of such parts a
        merge older than the one just undone, the bytes would have been merged across the border first.
        """
        a, b, before = left, right, len(self.sizes)
        answer = None
        while answer is None:
            if self.merged.get((a, b), before) < before:
                answer = False
            elif a > b:  # a is the younger: its last part touches b
                before, inner = a, self.halves[a][1]
                if inner != a:
                    a = inner
                else:
                    before, inner = b + 1, self.halves[b][0]
                    answer = True if inner == b else None
                    b = inner
            else:
                before, inner = b + 1, self.halves[b][0]
                if inner != b:
                    b = inner
                else:
                    before, inner = a, self.halves[a][1]
                    answer = True if inner == a else None
                    a = inner
        pair = left * len(self.sizes) + right
        self.fits[(pair ^ pair >> 18) & (PAIRS - 1)] = pair << 1 | answer
        return answer

    def encode(self, piece: bytes) -> bytes:
        """The ids of a piece as little-endian unsigned 32-bit integers."""
        size, sizes, shorter, fits = len(piece), self.sizes, self.shorter, self.fits
        tokens, last = len(sizes), PAIRS - 1
        longest = list(piece)  # a byte's rank is its value
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - sizes[token]
            if sizes[token] > sizes[longest[start]]:
                longest[start] = token
        chosen: list[int] = []
        closed = bytearray(size + 1)
        at, token = 0, longest[0] if size else -1
        while at < size:
            if token < 0:  # nothing fits here: take the predecessor back and try its prefixes
                closed[at] = 1
                token = chosen.pop()
                at -= sizes[token]
                token = shorter[token]
            else:
                fitting = not closed[at + sizes[token]]
                if fitting and chosen:
                    pair = chosen[-1] * tokens + token
                    known = fits[(pair ^ pair >> 18) & last]
                    fitting = known & 1 if known >> 1 == pair else self.fit(chosen[-1], token)
                if fitting:
                    chosen.append(token)
                    at += sizes[token]
                    token = longest[at] if at < size else -1
                else:
                    token = shorter[token]
        return self.ids[chosen].tobytes()


class Codec(dict):
    """Texts to ids and back.  As a dict it maps a piece of text to its ids and encodes what it lacks."""

    def __init__(self, vocabulary: dict) -> None:
        super().__init__()
        self.encoder = Encoder(vocabulary)
        self.special = {text: np.array([i], "<u4").tobytes() for text, i in vocabulary["special"].items()}
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.pieces = regex.compile(PIECES).findall
        tokens = {i: token for token, i in vocabulary["ids"].items()} | {i: t.encode() for t, i in vocabulary["special"].items()}
        ordered = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.blob = np.frombuffer(b"".join(ordered), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in ordered])]).astype(np.int64)

    def __missing__(self, piece: str) -> bytes:
        found = self.encoder.encode(piece.encode())
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        if self.split is None:
            return b"".join(map(self.__getitem__, self.pieces(text)))
        parts = self.split(text)
        return b"".join(self.special[part] if k % 2 else b"".join(map(self.__getitem__, self.pieces(part))) for k, part in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        out = bytearray()
        every = np.frombuffer(ids, "<u4")
        for at in range(0, len(every), 1 << 16):  # long texts in blocks, so that the index arrays stay small
            part = every[at: at + (1 << 16)]
            starts = self.offsets[part]
            sizes = self.offsets[part + 1] - starts
            ends = np.cumsum(sizes)
            where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)
            out += self.blob[where].tobytes()
        return bytes(out).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def _codec(packed: str) -> Codec:
    return Codec(load_vocabulary(packed))


def encoded(docs: DataFrame, tokenizer_json: str, with_ids: bool = True) -> DataFrame:
    """Add n_tokens, ids_sha256, decoded_sha256 and, if wanted, the ids themselves (as bytes) to rows of doc_id and text."""
    content = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value)
        for batch in giving_back(batches):
            ids, counts, hashes, back = [], [], [], []
            for text in batch.column("text"):
                found = codec.encode(text.as_py() or "")
                counts.append(len(found) // 4)
                hashes.append(hashlib.sha256(found).hexdigest())
                back.append(hashlib.sha256(codec.decode(found).encode()).hexdigest())
                ids.append(found if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string()), pa.array(ids, pa.binary())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return out if with_ids else out.drop("ids")


def read_tokenizer(spark: SparkSession, path: str | None = None) -> str:
    """The content of a tokenizer file; the installed byte-level one unless a path is given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoded(docs, read_tokenizer(spark), with_ids=False)
