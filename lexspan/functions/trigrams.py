"""Trigrams of content bytes, with a mask of the bytes that follow.

A trigram packs three bytes, ASCII letters in lower case, other bytes as they are. The mask
is an 8-bit filter over the bytes that follow the trigram anywhere in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
# A fixed value: which of the mask's eight bits stands for a byte.
_NEXT = np.array([1 << ((b ^ (b >> 3)) & 7) for b in range(256)], dtype=np.uint8)


def fold(data: bytes) -> bytes:
    return _FOLD[np.frombuffer(data, np.uint8)].tobytes()


def pack(three: bytes) -> int:
    return three[0] << 16 | three[1] << 8 | three[2]


def next_bit(byte: int) -> int:
    return int(_NEXT[byte])


def extract(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams, ascending, and their masks; none below three bytes."""
    b = _FOLD[np.frombuffer(content, np.uint8)]
    if len(b) < 3:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    wide = b.astype(np.int32)
    tri = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    mask = np.zeros(len(tri), np.int32)
    mask[:-1] = _NEXT[b[3:]]
    order = np.argsort(tri, kind="stable")
    tri, mask = tri[order], mask[order]
    first = np.flatnonzero(np.concatenate([[True], tri[1:] != tri[:-1]]))
    return tri[first], np.bitwise_or.reduceat(mask, first)


def trigram_rows(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """``doc_id, tri, mask``, a row per document and distinct trigram. One pass in Arrow
    batches; rows stay in their partition."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, held = [], 0
            tris: list[np.ndarray] = []
            masks: list[np.ndarray] = []

            def flush() -> pa.RecordBatch:
                nonlocal held
                out = pa.RecordBatch.from_pydict({"doc_id": pa.array(np.repeat(np.array(keys, np.int64), [len(t) for t in tris])), "tri": pa.array(np.concatenate(tris)), "mask": pa.array(np.concatenate(masks))})
                keys.clear(), tris.clear(), masks.clear()
                held = 0
                return out

            for k, c in zip(b.column("k").to_pylist(), b.column("c").to_pylist(), strict=True):
                if c is None or k is None:
                    continue
                t, m = extract(c)
                keys.append(k)
                tris.append(t)
                masks.append(m)
                held += len(t)
                if held > 500_000:
                    yield flush()
            if keys:
                yield flush()

    return docs.select(F.col(key).cast("long").alias("k"), F.col(content).cast("binary").alias("c")).mapInArrow(each, "doc_id long, tri int, mask int")
