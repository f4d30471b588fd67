"""Token counts of whole texts, with overlap resynchronisation for huge documents.

Texts of up to `chunk_chars` characters are encoded whole. A longer one is encoded
in overlapping chunks with offsets. Two chunks are spliced where both have a
token boundary at the same character and the characters around it prove that no
token, pair or normalisation can reach across: a white space character with
letters or digits of plain ASCII on both sides, seen by both chunks with the
same tokens on either side. When no such place lies in the overlap, the
overlap is doubled, up to the whole rest of the text.

Defined results: a null or empty text has 0 tokens; repeated rows are counted
once each; null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from .shared import columns
from .token_pieces import PieceEncoder, encoder_for, library_tokenizer

LIMIT = 2048
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_BLANK = frozenset(" \t\n\v\f\r")


def stable_boundary(text: str, at: int) -> bool:
    """A white space character at `at` between plain ASCII characters."""
    return 0 < at < len(text) - 1 and text[at] in _BLANK and text[at - 1] in _PLAIN and text[at + 1] in _PLAIN


def _boundaries(encoding, begin: int) -> tuple[dict[int, int], dict[int, int]]:
    """Tokens before each token end and each token start, by place in the whole text."""
    ends, starts = {}, {}
    for i, (a, b) in enumerate(encoding.offsets):
        starts.setdefault(begin + a, i)
        ends[begin + b] = i + 1
    return starts, ends


def spliced_count(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of `text`, equal to encoding it whole."""
    begin, counted, total = 0, 0, 0  # chunk start, tokens of this chunk that are counted already, tokens so far
    encoding = tokenizer.encode(text[:chunk], add_special_tokens=False)
    end = min(len(text), chunk)
    while end < len(text):
        wide = overlap
        while True:
            next_begin, next_end = max(begin, end - wide), min(len(text), max(end - wide, begin) + chunk + wide)
            after = tokenizer.encode(text[next_begin:next_end], add_special_tokens=False)
            _, ends = _boundaries(encoding, begin)
            starts, next_ends = _boundaries(after, next_begin)
            here = next((p for p in range((next_begin + end) // 2, end - 1) if stable_boundary(text, p) and p in ends and p in next_ends and p + 1 in starts and starts[p + 1] == next_ends[p]), None)
            if here is not None:
                total += ends[here] - counted
                encoding, begin, end, counted = after, next_begin, next_end, next_ends[here]
                break
            if next_begin == begin and wide >= end - begin:
                # no place in the whole chunk: take the rest of the text in one piece
                chunk = max(chunk * 2, next_end - begin)
                encoding = tokenizer.encode(text[begin : begin + chunk], add_special_tokens=False)
                end = min(len(text), begin + chunk)
                break
            wide *= 2
    return total + len(encoding.ids) - counted


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; no shuffle."""

    def run(batches):
        library = library_tokenizer(vocabulary)
        encoder = encoder_for((vocabulary,), lambda: PieceEncoder(lambda pieces: [e.ids for e in library.encode_batch_fast(pieces, add_special_tokens=False)], keep_space=False, keep_ids=False))
        for batch in tk.slices(batches):
            data, offsets = tk.buffer_of(batch.column(1))
            sizes = np.diff(offsets)
            huge = np.flatnonzero(sizes > chunk_chars)
            keep = np.ones(len(sizes), bool)
            keep[huge] = False
            short_data = data[np.repeat(keep, sizes)] if len(huge) else data
            counts, _ = encoder.slice(short_data, np.concatenate(([0], np.cumsum(np.where(keep, sizes, 0)))))
            for i in huge.tolist():
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                counts[i] = spliced_count(library, text, chunk_chars, overlap_chars)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
