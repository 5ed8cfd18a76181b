"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The words of a batch (a run of word marks and what follows up to the next mark; no piece of such a model
spans that border, which is checked when the model is read) lie end to end in flat numpy symbol arrays.
In each round every word finds the minimum rank among its adjacent pairs (a segmented minimum), merges
its leftmost pair of that rank, or all its non-overlapping ones where no pair with the merged symbol can
rank as early, and the arrays are compacted; words without a mergeable pair leave. The same greedy order
as the library's agenda results: best score first, then leftmost.

Distinct words of a batch are encoded once and kept in a bounded cache, so memory doesn't follow the
corpus. Defined results: null or empty text gives no pieces (only the end id); a code point outside the
vocabulary becomes its UTF-8 bytes' pieces; doc_id may be null or repeated; other columns are ignored."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from bazaarlake.llm.common import arrow_map, documents, prepare, ragged_arange, texts

MARK = "▁"
NEVER = np.int32(2**31 - 1)
CACHE_WORDS, CACHE_CHARS = 500_000, 64
_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encodes and decodes with a SentencePiece BPE model that has the identity normaliser, a dummy prefix and byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.end = sp.eos_id()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        pieces = {sp.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model spans words")
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        # Symbols: the pieces by id, then code points that occur only inside pieces, then `other`.
        symbols = dict(pieces)
        for c in sorted({c for p in pieces for c in p} - set(pieces)):
            symbols[c] = n + len(symbols) - len(pieces)
        self.other = n + len(symbols) - len(pieces)
        self.n_pieces = n
        self.of_char = np.full(0x110000, self.other, np.int32)
        for p, k in symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = k
        self.width = self.other + 1
        keys, ranks, merged = [], [], []
        for p, i in pieces.items():
            rank = place[sp.get_score(i)]
            for cut in range(1, len(p)):
                if (a := symbols.get(p[:cut])) is not None and (b := symbols.get(p[cut:])) is not None:
                    keys.append(a * self.width + b)
                    ranks.append(rank)
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int32)[order]
        self.merged = np.array(merged, np.int32)[order]
        # A merge to `piece` may be done in all places at once if no pair with the piece ranks as early and its rank is its own.
        rank_of = np.full(self.width, NEVER, np.int64)
        for i in pieces.values():
            rank_of[i] = place[sp.get_score(i)]
        earliest = np.full(self.width, NEVER, np.int64)
        np.minimum.at(earliest, self.keys // self.width, self.ranks)
        np.minimum.at(earliest, self.keys % self.width, self.ranks)
        shared = np.bincount(rank_of[rank_of < NEVER], minlength=len(scores))
        self.at_once = (earliest > rank_of) & (shared[np.where(rank_of < NEVER, rank_of, 0)] == 1)
        # Pairs of the worst rank (pieces of marks alone share it) only lead to pairs of that rank, so a word that
        # has no other pair left can be finished by one scan that always takes the leftmost.
        self.worst = len(scores) - 1
        last = [i for p, i in pieces.items() if len(p) > 1 and rank_of[i] == self.worst]
        self.scans = {(int(k) // self.width, int(k) % self.width): int(m) for k, m, r in zip(self.keys, self.merged, self.ranks, strict=True) if r == self.worst} if (earliest[last] >= self.worst).all() else {}
        self.digits = [str(i) for i in range(n)]
        # Bytes that each id decodes to.
        of_id = [b""] * n
        for p, i in pieces.items():
            of_id[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            of_id[i] = bytes([b])
        self.of_id = of_id

    def words(self, text: str) -> list[str]:
        """The words of a text, each without its first mark."""
        if not text:
            return []
        if text[0] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]

    def _pairs(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pairs (at, at + 1)."""
        wanted = symbols[at].astype(np.int64) * self.width + symbols[at + 1]
        found = np.searchsorted(self.keys, wanted)
        found[found == len(self.keys)] = 0
        hit = self.keys[found] == wanted
        return np.where(hit, self.ranks[found], NEVER), np.where(hit, self.merged[found], -1)

    def _scan(self, symbols: list[int], places: list[int]) -> tuple[list[int], list[int]]:
        """Merge leftmost pairs of the worst rank until none is left: a stack, as a merge can only free the pair to its left."""
        left, at = [], []
        for symbol, place in zip(symbols, places, strict=True):
            left.append(symbol)
            at.append(place)
            while len(left) > 1 and (to := self.scans.get((left[-2], left[-1]))) is not None:
                left[-2:] = [to]
                at.pop()
        return left, at

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words (given without their first mark), and where each word's ids end."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        chars = np.frombuffer("".join([MARK + w for w in words]).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        symbols, word, place = self.of_char[chars], np.repeat(np.arange(len(words)), lengths), np.arange(len(chars))
        begins_at = np.cumsum(lengths) - lengths
        rank, to = np.full(len(chars), NEVER, np.int32), np.full(len(chars), -1, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], to[inner] = self._pairs(symbols, inner)
        done: list[tuple[np.ndarray, ...]] = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(rank, starts)
            least_here = np.repeat(least, sizes)
            over = least_here == NEVER
            if over.any():
                done.append((word[over], symbols[over], place[over]))
                stay = ~over
                symbols, word, place, rank, to, least_here = symbols[stay], word[stay], place[stay], rank[stay], to[stay], least_here[stay]
                if not len(symbols):
                    break
            if self.scans and (slow := least_here == self.worst).any():
                left, at = [], []
                rows = np.flatnonzero(slow)
                for part in np.split(rows, np.flatnonzero(word[rows[1:]] != word[rows[:-1]]) + 1):
                    a, b = self._scan(symbols[part].tolist(), place[part].tolist())
                    left += a
                    at += b
                done.append((np.searchsorted(begins_at, at, "right") - 1, np.array(left, np.int32), np.array(at)))
                stay = ~slow
                symbols, word, place, rank, to, least_here = symbols[stay], word[stay], place[stay], rank[stay], to[stay], least_here[stay]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == least_here)
            first_of_word = np.concatenate(([True], word[hits[1:]] != word[hits[:-1]]))
            # Hits that follow each other overlap: every second one of such a run, from its first, is merged.
            begins = np.concatenate(([True], hits[1:] != hits[:-1] + 1)) | first_of_word
            run_start = np.maximum.accumulate(np.where(begins, np.arange(len(hits)), 0))
            free = (np.arange(len(hits)) - run_start) % 2 == 0
            hits = hits[first_of_word | (free & self.at_once[to[hits]])]
            symbols[hits] = to[hits]
            stay = np.ones(len(symbols), bool)
            stay[hits + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[hits] = True
            symbols, word, place, rank, to, changed = symbols[stay], word[stay], place[stay], rank[stay], to[stay], changed[stay]
            touched = np.flatnonzero(changed | np.append(changed[1:], False))
            rank[touched] = NEVER
            last = len(symbols) - 1
            touched = touched[touched < last]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched], to[touched] = self._pairs(symbols, touched)
        word, symbols, place = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        word, symbols, place = word[order], symbols[order], place[order]
        raw = symbols >= self.n_pieces
        if raw.any():
            word, symbols = self._as_bytes(word, symbols, chars[place], raw)
        return symbols, np.cumsum(np.bincount(word, minlength=len(words)))

    def _as_bytes(self, word: np.ndarray, symbols: np.ndarray, chars: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points without a piece become the pieces of their UTF-8 bytes."""
        sizes = np.ones(len(symbols), np.int64)
        at = np.flatnonzero(raw)
        coded = [chr(c).encode() for c in chars[at].tolist()]
        sizes[at] = [len(x) for x in coded]
        out = np.repeat(symbols, sizes)
        begin = (np.cumsum(sizes) - sizes)[at]
        out[np.repeat(begin, sizes[at]) + ragged_arange(sizes[at])] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        return np.repeat(word, sizes), out

    def decode(self, ids) -> str:
        """The text of ids; control ids give nothing."""
        out = b"".join([self.of_id[i] for i in ids])
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


class WordCache:
    """Per worker: the decimal ids and decoded bytes of recent words."""

    def __init__(self, codec: Codec):
        self.codec, self.decimal, self.plain, self.reused = codec, {}, {}, set()

    def cover(self, lists: list[list[str]]) -> None:
        """Encode what the given words lack; long words are encoded with the others but dropped at the next call."""
        need = set().union(*lists) if lists else set()
        if len(self.decimal) > CACHE_WORDS:  # words that no later batch used go
            keep = self.reused if len(self.reused) < CACHE_WORDS // 2 else ()
            self.decimal, self.plain = ({w: d[w] for w in keep} for d in (self.decimal, self.plain))
            self.reused = set()
        fresh = [w for w in need if w not in self.decimal]
        self.reused |= need.difference(fresh)
        ids, ends = self.codec.encode_words(fresh)
        ids, begin, digits, of_id = ids.tolist(), 0, self.codec.digits, self.codec.of_id
        for word, end in zip(fresh, ends.tolist(), strict=True):
            own = ids[begin:end]
            self.decimal[word] = " ".join([digits[i] for i in own]).encode()
            self.plain[word] = b"".join([of_id[i] for i in own])
            begin = end
        self.long = [w for w in fresh if len(w) > CACHE_CHARS]

    def forget_long(self) -> None:
        for w in self.long:
            self.decimal.pop(w, None)
            self.plain.pop(w, None)


@lru_cache(maxsize=1)
def shared_cache(path: str) -> WordCache:
    return WordCache(Codec(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the array of ids with the end id."""

    def make():
        cache = shared_cache(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = [cache.codec.words(t) for t in batch.column(1).to_pylist()]
            cache.cover(lists)
            ids = [[*map(int, b" ".join(map(cache.decimal.__getitem__, ws)).split()), cache.codec.end] for ws in lists]
            cache.forget_long()
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

        return step

    return arrow_map(texts(docs), "doc_id long, ids array<int>", make)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of an `ids` column; null ids give an empty text."""

    def make():
        codec = shared_cache(path).codec
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(ids or ()) for ids in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), StructType([StructField("doc_id", LongType()), StructField("text", StringType())]), make)


def coded_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of what they decode to."""

    def make():
        cache = shared_cache(path)
        end = str(cache.codec.end).encode()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = [cache.codec.words(t) for t in batch.column(1).to_pylist()]
            cache.cover(lists)
            counts, ids_sha, text_sha = [], [], []
            for words in lists:
                ids = b" ".join([*map(cache.decimal.__getitem__, words), end])
                plain = b"".join(map(cache.plain.__getitem__, words))
                counts.append(ids.count(b" ") + 1)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(plain[1:] if plain[:1] == b" " else plain).hexdigest())
            cache.forget_long()
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return arrow_map(texts(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op5: every document encoded, and decoded again."""
    prepare(spark)
    return coded_digests(documents(spark, sf_dir), default_model())
