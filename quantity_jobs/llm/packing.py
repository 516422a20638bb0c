"""Packing of tokenized documents into windows by best-fit decreasing.

Documents of more tokens than a window are cut into full windows first. The remainders are sorted by falling length; each goes
to the fullest open window that has room, which a segment tree indexed by remaining capacity finds. Tasks pack
about `per_task` remainders each on their own, so a partly filled end of each task is all that is lost.

Defined results: null and empty texts are the end token alone; repeated rows are packed as rows of their own; ties go by
document id and start; an empty table gives no piece; other columns are ignored."""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import LOWER_AZ, cut, split_words, text_runs

WINDOW = 2048
END_ID = 1
#: Texts are tokenized in runs of about so many bytes, which bounds a worker's memory.
RUN_BYTES = 4 << 20
#: A task's table of known pieces starts anew when it has grown to so many bytes.
TABLE_BYTES = 48 << 20
#: Stands between pieces that are encoded as one text. It holds white space, as no piece does.
SEPARATOR = "\x1e \x1e"
AS_IS = bytes(range(256))
#: Words of Latin letters whose case and composition change nothing, and the marks that often follow them.
LETTERS = "[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
MARKS = r"[.,;:!?&#*%|()\"-]*"


class PieceTable:
    """Token ids of the pieces between ASCII white space, for tokenizers that drop white space and never join across it: a text's ids
    are those of its pieces in a row. Where the tokenizer also parts words from the marks behind them, a piece is a word and its marks.
    What is known lies in Arrow and numpy arrays; a run's distinct new words are encoded together. Tokenizers of other
    kinds are noticed by probes, and get whole pieces or whole texts."""

    def __init__(self, vocabulary: str):
        # a task has one core; threads of its own would only take those of other tasks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        probes = ["word", "Word", "x1", "don't", "a.b,", "(é)", "7", "...", "Straße"]
        own = self._ids(probes)
        self.by_piece = all(
            self._ids([blank.join(["", *probes, ""])])[0] == sum(own, []) for blank in (" ", "\n", "\t", " \r\n ", "\x0b", "\x0c", "  ")
        )
        tails = [".", ",", "...", "!?", '")', "-", "&&&", "|"]
        self.by_word = self.by_piece and all(self._ids([w + t])[0] == sum(self._ids([w, t]), []) for w in ("word", "é", "qxz") for t in tails)
        self.ends = np.array([(self.tokenizer.id_to_token(k) or "").endswith("</w>") for k in range(self.tokenizer.get_vocab_size(with_added_tokens=True))])
        capitals = ["".join(map(chr, range(65, 91))), *map(chr, range(65, 91)), "McDonald'S", "aBc"]
        self.letters = LOWER_AZ if self._ids(capitals) == self._ids([c.lower() for c in capitals]) else AS_IS
        self.tokenizer.add_special_tokens([AddedToken(SEPARATOR, normalized=False, special=True)])
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        self._clear()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.fast(texts, add_special_tokens=False)]

    def _clear(self) -> None:
        self.pieces, self.lengths, self.ids = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _encode(self, new: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and the ids."""
        lengths, found = [], []
        for own in self._ids(_joined(new, SEPARATOR)):
            ids = np.array(own, "<u4")
            marks = np.flatnonzero(ids == self.separator)
            lengths.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
            found.append(ids[ids != self.separator])
        return np.concatenate(lengths), np.concatenate(found)

    def _encode_words(self, new: pa.StringArray) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for words of letters, between blanks, if the vocabulary marks where a word ends."""
        lists = [np.array(own, "<u4") for own in self._ids(_joined(new, " "))]
        ids = np.concatenate(lists)
        ends = np.flatnonzero(self.ends[ids])
        return (np.diff(ends, prepend=-1), ids) if len(ends) == len(new) and ends[-1] == len(ids) - 1 else None

    def places(self, distinct: pa.StringArray) -> np.ndarray:
        """Where the table has the pieces, after learning the new ones."""
        if self.pieces.nbytes + self.ids.nbytes + self.lengths.nbytes > TABLE_BYTES:
            self._clear()
        at = pc.index_in(distinct, value_set=self.pieces)
        places, missing = pc.fill_null(at, 0).to_numpy().astype(np.int64), at.is_null()
        plain = pc.match_substring_regex(distinct, f"^{LETTERS}$") if self.by_word else pa.array([False] * len(distinct), pa.bool_())
        for words in (True, False):
            own = pc.and_(missing, plain if words else pc.invert(plain))
            new = distinct.filter(own)
            if len(new):
                lengths, ids = (words and self._encode_words(new)) or self._encode(new)
                places[own.to_numpy(zero_copy_only=False)] = len(self.pieces) + np.arange(len(new))
                self.pieces = pa.concat_arrays([self.pieces, new])
                self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
        return places

    def piece_ids(self, distinct: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and the ids."""
        n, word, marks = len(distinct), distinct, pa.array([""] * len(distinct), pa.string())
        if self.by_word:
            parts = pc.extract_regex(distinct, f"^(?P<word>{LETTERS})(?P<marks>{MARKS})$")
            word = pc.if_else(parts.is_valid(), parts.field("word"), distinct)
            marks = pc.if_else(parts.is_valid(), parts.field("marks"), "")
        coded = pa.concat_arrays([word, marks]).dictionary_encode()
        at = self.places(coded.dictionary)[coded.indices.to_numpy()].reshape(2, n).T.ravel()  # word, marks, word, marks
        lengths = self.lengths[at]
        return lengths.reshape(n, 2).sum(axis=1), self._gathered(self.ids, self.lengths, at)

    @staticmethod
    def _gathered(ids: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ids of the entries `at`, one after another."""
        own = lengths[at]
        ends = np.cumsum(own)
        starts = (np.cumsum(lengths) - lengths)[at]
        return ids[np.repeat(starts - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def tokens(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of texts one after another, and how many each text has."""
        if not self.by_piece:
            lists = self._ids(_strings(texts))
            return np.concatenate([np.array(x, "<u4") for x in lists]), np.array([len(x) for x in lists], np.int64)
        flat, counts = split_words(texts, self.letters)
        coded = flat.dictionary_encode()
        if not len(flat):
            return np.zeros(0, "<u4"), counts
        lengths, ids = self.piece_ids(coded.dictionary)
        at = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths[at])])
        return self._gathered(ids, lengths, at), np.diff(ends[np.cumsum(counts)], prepend=0)


def _joined(pieces_: pa.StringArray, separator: str, size: int = 1000) -> list[str]:
    """Texts of `size` pieces each."""
    ends = np.append(np.arange(0, len(pieces_), size), len(pieces_)).astype(np.int32)
    return _strings(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pieces_), separator))


def _strings(texts: pa.StringArray) -> list[str]:
    try:
        return texts.to_pylist()
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()]


def tokenized(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The id column of a run of documents, their token ids one after another, each document's closed by end_id, and how many each has."""
    table = PieceTable(vocabulary)
    for batch in batches:
        for first, texts in text_runs(batch, "text", RUN_BYTES):
            ids, counts = table.tokens(texts)
            sizes = counts + 1
            last = np.cumsum(sizes) - 1
            out = np.empty(int(last[-1]) + 1, "<u4")
            inner = np.ones(len(out), bool)
            inner[last] = False
            out[last], out[inner] = end_id, ids
            yield batch.column(0).slice(first, len(texts)), out, sizes


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): every document cut at multiples of the window."""
    text = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, sizes in tokenized(batches, text.value, end_id):
            count = -(-sizes // window)
            row = np.repeat(np.arange(len(sizes)), count)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window
            length = np.minimum(window, sizes[row] - start)
            first = (np.cumsum(sizes) - sizes)[row] + start
            raw = memoryview(tokens.tobytes())
            checks = [zlib.crc32(raw[4 * i : 4 * (i + n)]) for i, n in zip(first.tolist(), length.tolist(), strict=True)]
            arrays = [ids.take(pa.array(row)), pa.array(start), pa.array(length), pa.array(checks, pa.int64()), pa.array(sizes[row])]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:  # the pieces follow each other without gaps
                arrays, names = [*arrays, pa.ListArray.from_arrays(np.append(first, len(tokens)).astype(np.int32), tokens.astype(np.int32))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut_up, schema).withColumnRenamed("id", id_col)


class CapacityTree:
    """Open windows by remaining capacity; a tree node says whether any window lies below it."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: int, used: int) -> None:
        self.open[room].append((sequence, used))
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int, int] | None:
        """Removes and returns (room, sequence, used) of a window with the smallest room >= least."""
        node = least + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, *self.open[room].pop()


class BestFit:
    """Places lengths that fall or stay equal, none above the window, each in the fullest open window that has room."""

    def __init__(self, window: int):
        self.window, self.tree, self.made = window, CapacityTree(window), 0

    def place(self, lengths: list[int]) -> tuple[list[int], list[int]]:
        """(sequence numbers, offsets)."""
        sequences, offsets = [], []
        for n in lengths:
            room, sequence, used = self.tree.take(n) or (self.window, self.made, 0)
            self.made += sequence == self.made
            sequences.append(sequence)
            offsets.append(used)
            if room > n:
                self.tree.add(room - n, sequence, used + n)
        return sequences, offsets


def pack(cut_pieces: DataFrame, id_col: str = "doc_id", window: int = WINDOW, per_task: int = 50_000) -> DataFrame:
    """The pieces with sequence_id and offset. sequence_id is the task's number times 2**32 plus the window's number there.
    A task holds its open windows and one batch."""
    parts = max(1, math.ceil(cut_pieces.count() / per_task))
    names = [*cut_pieces.columns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, fit = TaskContext.get().partitionId() << 32, BestFit(window)
        for batch in batches:
            sequences, offsets = fit.place(batch.column(batch.schema.get_field_index("length")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + s for s in sequences], pa.int64()), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"])

    schema = "".join(f"`{c}` {cut_pieces.schema[c].dataType.simpleString()}, " for c in names) + "sequence_id long, offset long"
    dealt = cut_pieces.repartition(parts, id_col, "start").sortWithinPartitions(F.desc("length"), id_col, "start")
    return dealt.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in a sequence; with_ids adds the token ids themselves.
    The tokenizer's file is read on the driver and sent to the tasks, so executors need no copy."""
    with open(tokenizer_path, encoding="utf-8") as file:
        vocabulary = file.read()
    return pack(cut(pieces(docs, vocabulary, id_col, text_col, window, end_id, with_ids)), id_col, window)


def packing_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The contract's columns of pack_documents."""
    out = pack_documents(docs, tokenizer_path)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
