"""Quality rules: word counts, symbols, repeats, and compression bands.

A text is compressed by zstandard as a whole and in chunks of CHUNK bytes. Repetitive text shrinks more than prose
of its length does, and encoded or random text less, so a text is rejected where its ratio (compressed over raw bytes)
lies outside the band for its length, or where chunks outside the band for theirs hold more than BAD_SHARE of its bytes. Short
texts have wide bands, since a frame's overhead and a cold dictionary weigh more there; below the first length
there is no verdict.

Texts are read once, whole, without a shuffle; a row's result depends on its text alone.

Defined results: words are split at ASCII white space; null and empty texts have no words and fail the base rules;
rows repeated with one doc_id each get a row; a null doc_id stays null; an empty table gives no rows; other columns are
ignored."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from bazaarlake.llm.common import arrow_map, documents, prepare, texts, utf8_list
from bazaarlake.llm.periodic_runs import word_ids

#: From so many bytes on: least and greatest ratio. The bounds leave room on both sides of prose in the languages seen
#: (0.57 to 0.75 at 256 bytes, 0.42 to 0.48 at 4 KB); base64 lies near 0.76, repeated sentences under 0.2.
BANDS = [(64, 0.45, 1.25), (128, 0.40, 1.05), (256, 0.34, 0.90), (512, 0.30, 0.80), (1024, 0.26, 0.74), (2048, 0.24, 0.72), (4096, 0.22, 0.70), (16384, 0.20, 0.70), (65536, 0.18, 0.70)]
CHUNK, BAD_SHARE, LEVEL = 4096, 0.25, 3
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20  # words; words of a window; per cent of words in repeated windows
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Number of words in windows that occur twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    names, width = ids.astype(np.int64), 1  # names of the words' runs of `width` words, equal if and only if the runs are
    while width < window:
        step = min(width, window - width)
        pairs = names[: len(names) - step] * (names.max() + 1) + names[step:]
        names, width = np.unique(pairs, return_inverse=True)[1], width + step
    often = np.bincount(names)[names] > 1
    change = np.zeros(len(ids) + 1, np.int64)
    change[:n] += often
    change[window:] -= often
    return int(np.count_nonzero(np.cumsum(change[:-1])))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def ratios(text: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, list[tuple[int, float]]]:
    """The whole text's ratio, and each chunk's bytes and ratio."""
    chunks = [text[k : k + CHUNK] for k in range(0, len(text), CHUNK)]
    each = [(len(c), len(packer.compress(c)) / len(c)) for c in chunks]
    return (each[0][1] if len(each) == 1 else len(packer.compress(text)) / max(1, len(text))), each


def outside(size: int, ratio: float, bands: Sequence[tuple[int, float, float]]) -> int:
    """-1: repetitive for its length, 1: incompressible, 0: within its band or too short to tell."""
    k = bisect_right(bands, size, key=lambda b: b[0]) - 1
    return 0 if k < 0 else -1 if ratio < bands[k][1] else int(ratio > bands[k][2])


def quality(docs: DataFrame, bands: Sequence[tuple[int, float, float]] = BANDS, bad_share: float = BAD_SHARE, level: int = LEVEL) -> DataFrame:
    """One row per row of docs (doc_id, text): the counts, base_failed, kept, whole ratio and the share of bytes in chunks outside their band."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_share double"

    def make():
        packer = zstandard.ZstdCompressor(level=level, write_checksum=False)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in utf8_list(batch):
                words = text.split()
                n, repeated = len(words), repeated_words(word_ids(words))
                chars = len(b"".join(words).decode())
                failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
                whole, chunks = ratios(text, packer) if text else (1.0, [])
                bad = sum(size for size, r in chunks if outside(size, r, bands)) / max(1, len(text))
                kept = not failed and not outside(len(text), whole, bands) and bad <= bad_share
                rows.append((n, chars, len(text) - len(text.translate(None, SYMBOLS)), duplicate_lines(text), repeated, failed, kept, whole, bad))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_share"])

        return step

    return arrow_map(docs, schema, make)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op13: the rules' counts and verdict for every document."""
    prepare(spark)
    return quality(texts(documents(spark, sf_dir)))
