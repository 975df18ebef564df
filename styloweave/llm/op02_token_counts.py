"""Token counts of whole texts; huge ones by overlapping chunks that are spliced where it is safe.

A huge text is encoded in chunks that overlap, with the offsets of each token. Two neighbours are
spliced at a position that follows white space and at which both have a token start: the
tokenizer drops white space and never joins across it, so nothing before such a position can
change what follows, and the ids left of it from the one chunk and right of it from the other are
those of the whole text. Where the overlap holds no such position it is doubled, at last to the
whole of the chunk before, which then doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styloweave.llm import bpe
from styloweave.llm.words import SPACES, blocks, buffers

HUGE, CHUNK, OVERLAP = 65_536, 32_768, 256
LIMIT = 2_048
_SPACES = frozenset(map(chr, SPACES))


def boundary(text: str, start: int, end: int, left, right) -> int | None:
    """The first safe position in the overlap [start, end) of two encodings, or None."""
    ours = {a for a, b in left if start < a < end and b > a}
    for a, b in right:
        if b > a and a in ours and text[a - 1] in _SPACES:
            return a
    return None


def encode_spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of `text` from overlapping chunks; equal to those of the whole text."""
    def coded(a: int, b: int):
        e = tokenizer.encode(text[a:b], add_special_tokens=False)
        return e.ids, [(a + x, a + y) for x, y in e.offsets]

    ids: list[int] = []
    begin, end = 0, min(chunk, len(text))
    tokens, spans = coded(begin, end)
    while end < len(text):
        width, to, at = overlap, min(end + chunk, len(text)), None
        while at is None and width < end - begin:
            start = end - width
            more, places = coded(start, to)
            at = boundary(text, start, end, spans, places)
            width *= 2
        if at is None:  # no safe place in all of the chunk before: it doubles
            end = min(2 * end - begin, len(text))
            tokens, spans = coded(begin, end)
            continue
        ids += [t for t, (a, _) in zip(tokens, spans) if a < at]
        keep = [i for i, (a, _) in enumerate(places) if a >= at]
        tokens, spans = [more[i] for i in keep], [places[i] for i in keep]
        begin, end = at, to
    return ids + tokens


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_tokens, over_limit (n_tokens > `limit`).

    Null texts count as empty (0, 0, false), null ids stay null, repeated rows are counted each.
    Other columns are not carried. Nothing is shuffled; a text is counted whole, however long.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(path)
        for block in blocks(batches):
            column = block.column(1)
            _, bounds = buffers(column)
            sizes = np.diff(bounds)
            long = np.flatnonzero(sizes > huge)
            if len(long):
                mask = np.zeros(len(sizes), bool)
                mask[long] = True
                short = pa.compute.if_else(pa.array(mask), pa.scalar(""), column)
            else:
                short = column
            tokens = coder.counts(bpe.units(short))
            for i in long:
                tokens[i] = len(encode_spliced(coder.whole, column[int(i)].as_py(), chunk))
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(sizes.astype(np.int64)), pa.array(tokens.astype(np.int64))],
                names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long") \
        .withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
