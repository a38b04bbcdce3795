"""Token packing: bounded-space online best fit, with leftovers merged by fan-in.

A partition keeps at most ``open_windows`` unfinished windows. A document's tokens fill
whole windows first; the rest goes to the open window with the least room that holds it. If
none holds it, the fullest window is filled with a cut of it and emitted, and what is left
is placed again. At the end a partition merges its open windows into at most one. These
last windows, one a partition, are merged in groups of ``FAN_IN`` until one is left, so only
the very last sequence of the corpus is not full.

Each step is a pure function of its input rows, so a task that is repeated after a lost
executor writes the same pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, stage

FAN_IN = 64
END_ID = 0
PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, part long"
COLUMNS = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]


def byte_bpe_encoder(json_path: str, ranks_path: str, pattern: str) -> Callable[[], Callable[[str], np.ndarray]]:
    """A factory (called once a task) of ``text -> ids`` with the byte-level BPE of ``json_path``.

    ``ranks_path`` holds the same vocabulary as ranks for a faster encoder with the same
    ids. Texts with its special string, or with characters outside the blocks in which the
    two libraries' character classes were compared, go through the JSON tokenizer.
    """

    def make() -> Callable[[str], np.ndarray]:
        import re

        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        odd = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ]|<\|")

        def encode(text: str) -> np.ndarray:
            if odd.search(text):
                text = text.encode("utf-8", "replace").decode("utf-8")
                return np.asarray(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

        return encode

    return make


class Packer:
    """The open windows of one partition or merge group."""

    def __init__(self, size: int, open_windows: int, first_id: int) -> None:
        self.size, self.limit, self.next_id = size, open_windows, first_id
        self.windows: list[tuple[int, list[tuple]]] = []  # (tokens, pieces)
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple], part: int | None = None) -> None:
        at = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, ids.tobytes(), doc_tokens, self.next_id, at, part))
            at += len(ids)
        self.next_id += 1

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        whole = len(ids) // self.size * self.size
        for at in range(0, whole, self.size):
            self._emit([(doc_id, start + at, ids[at : at + self.size], doc_tokens)])
        start, ids = start + whole, ids[whole:]
        while len(ids):
            room = [(self.size - used, i) for i, (used, _) in enumerate(self.windows)]
            fitting = min((x for x in room if x[0] >= len(ids)), default=None)
            if fitting:
                cut, i = len(ids), fitting[1]
            elif len(self.windows) < self.limit:
                cut, i = len(ids), len(self.windows)
                self.windows.append((0, []))
            else:
                cut, i = min(room)
            used, pieces = self.windows[i]
            pieces.append((doc_id, start, ids[:cut], doc_tokens))
            self.windows[i] = (used + cut, pieces)
            if used + cut == self.size:
                self._emit(self.windows.pop(i)[1])
            start, ids = start + cut, ids[cut:]

    def close(self, part: int) -> None:
        """Merges the open windows; one that is not full is emitted with ``part`` set."""
        held = sorted(self.windows, key=lambda w: -w[0])
        self.windows, self.limit = [], 1
        for _, pieces in held:
            for piece in pieces:
                self.add(*piece)
        for _, pieces in self.windows:
            self._emit(pieces, part)


ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64())]
)


def _drained(packer: Packer) -> Iterator[pa.RecordBatch]:
    if packer.rows:
        rows, packer.rows = packer.rows, []
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ARROW)], schema=ARROW)


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable[[str], np.ndarray]],
    size: int = 1024,
    open_windows: int = 16,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: ``doc_id, start, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit token ids of one document, which ends with
    ``end_id``; ``start`` counts the document's ids before the piece, ``offset`` those of
    its sequence. Every id is in exactly one piece. A null or empty text is the end id
    alone; repeated rows are packed each on its own, null ids stay null; other columns are
    not carried. An empty table gives no pieces.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, encode = Packer(size, open_windows, part << 28), encoder()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.array([end_id], "<u4")).astype("<u4", copy=False)
                packer.add(doc_id, 0, ids, len(ids))
                if len(packer.rows) >= 2000:
                    yield from _drained(packer)
        packer.close(part)
        yield from _drained(packer)

    rows = by_bytes(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(pieces, PIECES)
    rows = stage(rows, "pieces")
    done, left = rows.filter("part is null"), rows.filter("part is not null")
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    level = 1
    while parts > 1:
        merged = stage(
            left.withColumn("into", F.expr(f"part div {FAN_IN}")).groupBy("into").applyInArrow(_merger(size, level), PIECES),
            "merged",
        )
        done = done.unionByName(merged.filter("part is null"))
        left = merged.filter("part is not null")
        parts, level = -(-parts // FAN_IN), level + 1
    return done.unionByName(left).select(*COLUMNS)


def _merger(size: int, level: int):
    """Joins the unfinished windows of up to ``FAN_IN`` parts; under ``size`` tokens each."""

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        into = key[0].as_py()
        packer = Packer(size, 1, (level << 58) + (into << 28))
        rows = rows.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        for r in rows.select(COLUMNS[:4]).to_pylist():
            packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
        packer.close(into)
        return pa.Table.from_batches(_drained(packer), schema=ARROW)

    return merge
