"""Packing by powers of two: each document is cut into pieces of binary length, equal lengths share a bucket.

A piece is a whole sequence, so no sequence crosses documents and none needs padding: every length is a power of
two up to the limit. Work is one pass over the texts; nothing is shuffled.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.textkernel import ascending, chunks

LIMIT = 2048
END_ID = 1
#: Bytes of text whose chunks are looked up together.
TEXT_PART = 1 << 22

_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them, from those of their distinct blank-free chunks.

    The vocabulary's pattern lets a token begin with one space but never reach from a letter, digit or sign into a
    following blank. So where all blanks are single spaces or line feeds between other characters, a text's ids are
    those of its chunks, each with the space or line feed before it. Any other text is given to the tokenizer as a whole.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.by_rank = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        #: Bytes of each token.
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(x) for x in ranks]

    def _encoded(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that each start with a space or line feed, end to end, and where each chunk's start."""
        ids = np.array(self.by_rank.encode_ordinary("".join(found)), dtype="<u4")
        start = np.concatenate([[0], np.cumsum(self.size[ids])])
        want = np.concatenate([[0], np.cumsum([len(x.encode()) for x in found], dtype=np.int64)])
        at = np.searchsorted(start, want)
        if not np.array_equal(start[at], want):
            raise ValueError("a token of this vocabulary reaches from a chunk into the next")
        return ids, at

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; those of a null are none."""
        for lo, hi, data, off in chunks(texts, TEXT_PART):
            part = texts.slice(lo, hi - lo)
            # A chunk starts with each row and at each space or line feed in it; equal chunks are encoded once.
            cuts = ascending(np.concatenate([off[:-1], np.flatnonzero((data == 32) | (data == 10))]))
            cuts = cuts[cuts < len(data)]
            bounds = pa.py_buffer(np.append(cuts, len(data)).astype(np.int64))
            coded = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, bounds, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
            # A row's first chunk is given a line feed, whose id is left out again.
            found = [x.decode() for x in coded.dictionary.to_pylist()]
            bare = np.array([x[0] not in " \n" for x in found], bool)
            found = ["\n" + x if b else x for x, b in zip(found, bare.tolist(), strict=True)]
            # Without ids are chunks whose blank before or after touches others in the text.
            lacks = np.array([x[-1].isspace() or x[1].isspace() for x in found], bool)
            ids, at = self._encoded([x for x, lack in zip(found, lacks.tolist(), strict=True) if not lack])
            n, first = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
            first[~lacks] = at[:-1] + bare[~lacks]
            n[~lacks] = at[1:] - first[~lacks]
            index = np.asarray(coded.indices)
            n_at = n[index]
            ends = np.concatenate([[0], np.cumsum(n_at)])
            ids = ids[np.repeat(first[index] - ends[:-1], n_at) + np.arange(ends[-1])]
            # Rows as stretches of chunks; those that start with a blank, or hold a chunk without ids, go to the tokenizer whole.
            row = np.searchsorted(cuts, off)
            lacking = np.concatenate([[0], np.cumsum(lacks[index])])
            whole = lacking[row[1:]] > lacking[row[:-1]]
            filled = off[1:] > off[:-1]
            whole[filled] |= (data[off[:-1][filled]] == 32) | (data[off[:-1][filled]] == 10)
            for s in self.special:
                whole |= np.asarray(pc.fill_null(pc.match_substring(part, s), False))
            for i, (a, b) in enumerate(zip(ends[row[:-1]].tolist(), ends[row[1:]].tolist(), strict=True)):
                yield np.array(self.whole.encode(part[i].as_py(), add_special_tokens=False).ids, dtype="<u4").tobytes() if whole[i] else ids[a:b].tobytes()


@functools.lru_cache(2)
def encoder(json_path: str, ranks_path: str, pattern: str) -> Encoder:
    return Encoder(json_path, ranks_path, pattern)


def pieces(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of a document of ``n`` ids: whole limits, then the binary digits of the rest, largest first."""
    out = [(s, limit) for s in range(0, n - limit + 1, limit)]
    at, rest = len(out) * limit, n % limit
    for k in range(limit.bit_length() - 1, -1, -1):
        if rest >> k & 1:
            out.append((at, 1 << k))
            at += 1 << k
    return out


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    ``length`` is the bucket: a batch is drawn from rows of one length. A null or empty text is the end id alone.
    Repeated rows are packed as often as they occur; a null doc_id stays null; other columns are dropped.
    """
    if limit & (limit - 1):
        raise ValueError("the limit must be a power of two")

    def run(batches):
        enc = encoder(json_path, ranks_path, pattern)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            rows, cols, tokens = [], [[], [], [], []], []

            def flush():
                out = [ids.take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    out.append(pa.array(tokens, pa.list_(pa.int64())))
                    names.append("ids")
                return pa.RecordBatch.from_arrays(out, names)

            for i, raw in enumerate(enc(text)):
                raw += end
                n = len(raw) // 4
                for start, length in pieces(n, limit):
                    part = raw[4 * start : 4 * (start + length)]
                    rows.append(i)
                    for c, v in zip(cols, (start, length, zlib.crc32(part), n), strict=True):
                        c.append(v)
                    if with_ids:
                        tokens.append(np.frombuffer(part, "<u4").astype(np.int64))
                if len(rows) > 50_000:
                    yield flush()
                    rows, cols, tokens = [], [[], [], [], []], []
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_SCHEMA}" + (", ids array<long>" if with_ids else ""))
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
