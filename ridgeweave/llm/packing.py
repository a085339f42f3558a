"""Best-fit packing of tokenised documents into fixed-length sequences.

Two steps. ``tokenise`` turns every text into ids and cuts what is longer than
a sequence; its rows hold numbers only, so the text is read once and never
shuffled. ``pack`` deals those rows round robin to tasks of a stated number of
pieces, and each task packs its own by bounded-space online best fit.

Defined results: a null or empty text is one piece that holds just the end id;
a null ``doc_id`` stays null and is packed; repeated rows are packed as often
as they occur; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeweave.scratch import Scratch

SEQUENCE = 4096
#: Open bins in each task.
OPEN_BINS = 512
#: Pieces that a packing task takes; a sequence left open at a task's end is lost space, so tasks must not be small.
TASK_PIECES = 16_384
#: Distinct chunks of which a worker remembers the ids.
CACHE = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the code points from 256 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class ChunkEncoder:
    """Ids of whole texts, remembered by blank-separated chunk.

    The tokenizer normalises and splits without looking across a blank or a
    line feed, so the ids of a text are those of its chunks in order. The
    tokenizer composes characters before it lowers them, so A-Z are lowered
    beforehand in ASCII chunks only. Punctuation behind a letter or digit that
    lowers to one is a piece of its own, so it is encoded apart, and a chunk of
    Latin letters is one piece, which the model alone can encode. A text that
    has the opening of a special token is encoded whole.
    """

    TAIL = b".,;:!?#$%&*|)"

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.end = end_id.to_bytes(4, "little")
        self.known: dict[bytes, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, chunk: bytes) -> bytes:
        if chunk.isalpha():
            return self._packed([t.id for t in self.model.tokenize(chunk.decode())])
        text = chunk.decode()
        if text.isalpha() and max(text) < "\u0250":
            low = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
            if low.isalpha():
                return self._packed([t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, low.encode())))])
        return self._whole(text)

    @staticmethod
    def _ends_in_a_letter(core: bytes) -> bool:
        if core[-1:].isalnum():
            return True
        last = core.decode()[-1:]
        return "" < last < "\u0250" and last.isalpha() and len(last.lower()) == 1

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk.isascii():
            chunk = chunk.lower()
        core = chunk.rstrip(self.TAIL)
        if len(core) == len(chunk) or not self._ends_in_a_letter(core):
            return self._piece(chunk)
        known, tail = self.known, chunk[len(core) :]
        for part in (core, tail):
            if part not in known:
                known[part] = self._piece(part)
        return known[core] + known[tail]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        known = self.known
        for text in texts:
            text = text or ""
            if "<|" in text:
                yield self._whole(text) + self.end
                continue
            chunks = text.encode("utf-8", "replace").replace(b"\n", b" ").split(b" ")
            if len(known) > CACHE:
                known.clear()
            try:
                yield b"".join([known[c] for c in chunks]) + self.end
            except KeyError:
                for c in chunks:
                    if c not in known:
                        known[c] = self._chunk(c)
                yield b"".join([known[c] for c in chunks]) + self.end


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> ChunkEncoder:
    """One for each worker process, so later tasks find what earlier ones remembered."""
    return ChunkEncoder(path, end_id)


def cut(ids: bytes, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of consecutive pieces of ``size`` ids."""
    for k, at in enumerate(range(0, len(ids), 4 * size)):
        part = ids[at : at + 4 * size]
        yield k, at // 4, len(part) // 4, zlib.crc32(part)


class BestFit:
    """Bounded-space online best fit.

    ``bits`` has bit f set where some open bin has f free places, so the
    tightest bin that fits is the lowest set bit at or above the piece's
    length. When all bins are open and none fits, the fullest one, which is
    the lowest set bit of all, closes.
    """

    def __init__(self, size: int, bins: int, first_id: int):
        self.size, self.bins = size, bins
        self.bits, self.open, self.next = 0, 0, first_id
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.open >= self.bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            at, free = self.next, self.size
            self.next += 1
        left = free - length
        if left:
            self.by_free[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.size - free


def tokenise(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = 1) -> DataFrame:
    """One row for each piece of each document: PIECES."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id).encode
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                rows += [(doc_id, *x) for x in cut(ids, size)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, tasks: int, size: int = SEQUENCE, bins: int = OPEN_BINS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of at most ``size``.

    A task's sequences are numbered from its partition's number times 2^32. A
    task that is repeated reads the same rows in the same order, as round
    robin dealing sorts them and each task sorts its own by document.
    """
    names = pieces.columns
    at_length = names.index("length")
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(size, bins, TaskContext.get().partitionId() << 32)
        for batch in batches:
            placed = [fit.place(n) for n in batch.column(at_length).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in placed], pa.int64()), pa.array([x[1] for x in placed], pa.int64())], names=[*names, "sequence_id", "offset"])

    dealt = pieces.repartition(tasks).sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece")
    return dealt.mapInArrow(run, out)


def pack_documents(docs: DataFrame, path: str, size: int = SEQUENCE, bins: int = OPEN_BINS, end_id: int = 1) -> DataFrame:
    """Tokenise and pack whole ``docs``; ``path`` is a tokenizer file that every executor can open."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(tokenise(docs, path, size, end_id), "pieces")
    return pack(pieces, max(1, round(pieces.count() / TASK_PIECES)), size, bins)
