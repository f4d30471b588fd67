"""Token ids of whole texts, each distinct piece of text encoded once per task.

Both vocabularies used here split a text before every run of Unicode white space that
follows other characters, so a text's ids are the ids of its pieces (white space
and the run after it) one after another. Cuts are made where such a run begins with ASCII white space. A batch is cut into pieces with
Arrow, each distinct piece goes to the library once, and the ids are gathered. Pieces are told
apart by their bytes, not by a hash.
"""

from __future__ import annotations

import base64
import os

import numpy as np

from . import textkit as tk

#: Pieces that a worker remembers, at about 150 bytes each, and where only their counts are kept; its table starts afresh beyond that.
CACHE_PIECES, COUNTED_PIECES = 250_000, 1_500_000
#: Pieces given to the library at once.
ADDED = 8192


def token_file(name: str) -> str:
    """Where the public vocabulary file lies; the package is on every worker."""
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def library_tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_file(name))


def byte_bpe_encoder(json_name: str, ranks_name: str | None):
    """list of str -> list of id lists, as the tokenizers library gives them for `json_name`.

    The rank file holds the same vocabulary for a faster library. It takes the pieces
    that are plain Latin text; special strings and rarer characters, for which
    the two libraries' character tables could differ, go to the tokenizers library.
    """
    library = library_tokenizer(json_name)
    specials = [t.content for t in library.get_added_tokens_decoder().values()]

    def slow(pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in library.encode_batch_fast(pieces, add_special_tokens=False)]

    if not ranks_name:
        return slow
    import public_tokenizers
    import tiktoken

    with open(token_file(ranks_name), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(pieces: list[str]) -> list[list[int]]:
        odd = {i for i, p in enumerate(pieces) if max(p) > "\u024f" or any(x in p for x in specials)}
        out = [[] if i in odd else fast.encode_ordinary(p) for i, p in enumerate(pieces)]
        for i, ids in zip(sorted(odd), slow([pieces[i] for i in sorted(odd)])):
            out[i] = ids
        return out

    return encode


# fixed values: UTF-8 of the characters beyond ASCII that have the White_Space property
_BLANKS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def after_blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places `at` follow a white-space character beyond ASCII."""
    out = np.zeros(len(at), bool)
    for size in (2, 3):
        back = np.flatnonzero(at >= size)
        code = np.zeros(len(back), np.int64)
        for k in range(size, 0, -1):
            code = code << 8 | data[at[back] - k]
        out[back] |= np.isin(code, [int.from_bytes(b) for b in _BLANKS if len(b) == size])
    return out


_encoders: dict[tuple, "PieceEncoder"] = {}


def encoder_for(key: tuple, make) -> "PieceEncoder":
    """One encoder for each Python worker: its table of pieces serves later tasks too."""
    if key not in _encoders:
        _encoders[key] = make()
    return _encoders[key]


class Growing:
    """An array that doubles its room as it fills."""

    def __init__(self, dtype):
        self.room, self.size = np.zeros(1024, dtype), 0

    def append(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.room):
            room = np.zeros(2 * (self.size + len(more)), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : self.size + len(more)] = more
        self.size += len(more)


class PieceEncoder:
    """Ids of a slice of texts, with a bounded table of pieces seen before."""

    def __init__(self, encode, keep_space: bool, keep_ids: bool):
        self.encode, self.keep_space, self.keep_ids = encode, keep_space, keep_ids
        self.most = CACHE_PIECES if keep_ids else COUNTED_PIECES
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.ids, self.begins, self.lengths = Growing(np.uint32), Growing(np.int64), Growing(np.int32)

    def add(self, pieces: list[bytes]) -> None:
        """Encode new pieces, a part of them at a time: the library's lists are far larger than the ids."""
        for at in range(0, len(pieces), ADDED):
            part = pieces[at : at + ADDED]
            found = self.encode([p.decode("utf-8", "replace") for p in part])
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self.rows.update(zip(part, range(self.lengths.size, self.lengths.size + len(part))))
            if self.keep_ids:
                self.begins.append(self.ids.size + np.cumsum(lengths) - lengths)
                self.ids.append(np.fromiter((x for ids in found for x in ids), np.uint32, int(lengths.sum())))
            self.lengths.append(lengths)

    def pieces(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, doc = tk.word_spans(data, offsets)
        if self.keep_space:
            # a piece also holds the white space before its word; what ends a text is a piece of its own
            tails = np.flatnonzero(np.diff(offsets) > 0)
            last = np.full(len(offsets) - 1, -1, np.int64)
            np.maximum.at(last, doc, ends)
            rest = tails[last[tails] < offsets[tails + 1]]
            begin = np.where(last[rest] < 0, offsets[rest], last[rest])
            previous = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            starts = np.maximum(previous, offsets[doc])
            starts, ends, doc = np.concatenate((starts, begin)), np.concatenate((ends, offsets[rest + 1])), np.concatenate((doc, rest))
            order = np.argsort(starts, kind="stable")
            starts, ends, doc = starts[order], ends[order], doc[order]
            # white space beyond ASCII before a cut goes on across it
            cut = ~after_blank(data, starts) | (starts == offsets[doc])
            starts, doc = starts[cut], doc[cut]
            ends = ends[np.concatenate((np.flatnonzero(cut)[1:] - 1, [len(cut) - 1]))] if len(starts) else ends
        return starts, ends, doc

    def slice(self, data: np.ndarray, offsets: np.ndarray):
        """Token count of each text, and for each piece its row in the table."""
        if self.lengths.size > self.most:
            self.clear()
        starts, ends, doc = self.pieces(data, offsets)
        found = tk.byte_column(data, starts, ends).dictionary_encode()
        distinct = tk.byte_strings(found.dictionary)
        if new := [p for p in distinct if p not in self.rows]:
            self.add(new)
        rows = np.fromiter(map(self.rows.__getitem__, distinct), np.int64, len(distinct))[np.asarray(found.indices)]
        counts = np.bincount(doc, weights=self.lengths.room[rows], minlength=len(offsets) - 1).astype(np.int64)
        return counts, rows

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the given pieces, one after another."""
        lengths = self.lengths.room[rows].astype(np.int64)
        done = np.cumsum(lengths)
        return self.ids.room[np.repeat(self.begins.room[rows] - (done - lengths), lengths) + np.arange(done[-1] if len(done) else 0)]
