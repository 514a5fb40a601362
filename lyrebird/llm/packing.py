"""Sum-of-squares packing of tokenised documents into sequences of bounded length.

Pass 1 tokenises every text once and keeps (doc_id, piece, start, length, crc32); texts and ids are never
shuffled. Pass 2 packs evenly dealt partitions of pieces: longest first, each piece goes to the open bin whose
choice makes the sum of squared counts of open bins per residual gap smallest; a bin is opened only when no open
one has room. Pass 3 takes the pieces of all poorly filled bins and packs them again, so that the
remainder of every partition is shared.

Defined results: null text is an empty text; an empty text is one piece that holds only the separator id; repeated
rows are packed as often as they occur; a null doc_id is kept; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.common import gather, input_partitions, materialize, worker_slot

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, gap int"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PACKED_ARROW = pa.schema([*_PIECES_ARROW, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("gap", pa.int32())])

#: Rows that one packing task holds at most, about; 60 bytes each.
ROWS_PER_TASK = 200_000
#: Entries kept in a worker's caches of encoded words.
CACHE_ENTRIES = 350_000


class WordEncoder(dict):
    """Token ids of texts as unsigned 32-bit bytes in the machine's order (little-endian on all of Spark's platforms); as a dict, of the parts between blanks.

    The tokenizer drops white space and no token spans it, so a text's ids are the ids of its parts between
    spaces and line feeds, in order. A part of Latin letters that is followed by nothing or by other ASCII marks (no
    apostrophe, which starts contractions, and no sign of a special token) is again the ids of both runs, as the
    pre-tokenizer splits there; these runs go to the model at once, in lower case and with bytes as the byte-level
    step spells them. All other parts take the tokenizer's whole way.
    """

    _RUNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-;=?@\[-`{}~]*)")

    def __init__(self, tokenizer_path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        self._model = self._tokenizer.model
        self._runs: dict[str, bytes] = {"": b""}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self._spelled = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _run(self, run: str) -> bytes:
        if len(self._runs) >= CACHE_ENTRIES:
            self._runs = {"": b""}
        spelled = run if run.isascii() else "".join([self._spelled[b] for b in run.encode()])
        ids = array("I", [t.id for t in self._model.tokenize(spelled)]).tobytes()
        self._runs[run] = ids
        return ids

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        m = self._RUNS.fullmatch(part)
        if m:
            letters, marks = m[1].lower(), m[2]
            ids = (self._runs.get(letters) or self._run(letters)) + (self._runs.get(marks) or marks and self._run(marks) or b"")
        else:
            ids = array("I", self._tokenizer.encode(part, add_special_tokens=False).ids).tobytes() if part else b""
        self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, separator: int = 0) -> DataFrame:
    """One row per piece of at most ``max_tokens`` ids of each document, whose ids end with ``separator``."""
    width, end = 4 * max_tokens, array("I", [separator]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_slot(("encoder", tokenizer_path), lambda: WordEncoder(tokenizer_path)).encode
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc_id in enumerate(ids):
                data = encode(texts[i].as_py() or "") + end
                for k, at in enumerate(range(0, len(data), width)):
                    cut = data[at : at + width]
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((doc, piece, start, length, crc), _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number, offset in the bin and the bin's final gap for each item, taken longest first.

    Among the open bins with room, the item goes where sum over gaps of (open bins with that gap) squared
    becomes smallest; ties go to the smallest gap that is left. Full bins aren't open any more.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    gap_of: list[int] = []
    sizes = lengths[order].tolist()
    for at, s in zip(order.tolist(), sizes, strict=True):
        room = np.flatnonzero(count[s:])
        if room.size:
            gaps = room + s
            change = np.where(room > 0, 2 * count[room] + 2, 1) - 2 * count[gaps]  # a full bin adds no square
            gap = int(gaps[int(change.argmin())])
            b = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, len(gap_of)
            gap_of.append(0)
        bins[at], offsets[at] = b, capacity - gap
        gap -= s
        gap_of[b] = gap
        if gap:
            open_at[gap].append(b)
            count[gap] += 1
    return bins, offsets, np.array(gap_of, np.int64)[bins] if n else bins


def _pack_partition(max_tokens: int, sign: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gather(batches, _PIECES_ARROW)
        if not t.num_rows:
            return
        bins, offsets, gaps = sum_of_squares(t["length"].to_numpy(), max_tokens)
        seq = sign * ((TaskContext.get().partitionId() << 32) + bins + 1)
        cols = [*(t[f.name].combine_chunks() for f in _PIECES_ARROW), pa.array(seq), pa.array(offsets), pa.array(gaps.astype(np.int32))]
        yield from pa.Table.from_arrays(cols, schema=_PACKED_ARROW).to_batches(max_chunksize=65536)

    return run


def pack(pieces: DataFrame, max_tokens: int = 2048, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add sequence_id (any numbers), offset (gapless in the sequence) and gap (ids left free) to pieces.

    ``pieces`` should be a stored table: it is read for its count and for packing.
    """
    n = pieces.count()
    parts = input_partitions(pieces, rows_per_task, n)
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    first = pieces.repartition(parts).mapInArrow(_pack_partition(max_tokens, 1), PACKED)
    if parts == 1:
        return first
    first = materialize(first, "packed")
    loose = F.col("gap") > max_tokens // 64
    rest = first.filter(loose).select(pieces.columns)
    again = rest.repartition(input_partitions(rest, rows_per_task, rest.count())).mapInArrow(_pack_partition(max_tokens, -1), PACKED)
    return first.filter(~loose).unionByName(again)


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Tokenise and pack whole documents; see the module's text for the defined results."""
    return pack(materialize(tokenize_pieces(docs, tokenizer_path, max_tokens), "pieces"), max_tokens, rows_per_task)
