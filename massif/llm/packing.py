"""Concatenate and cut: documents become one long stream of token ids, cut at each multiple of the sequence length.

The first pass tokenises each document once and writes its ids with its offset within its task; the second pass adds the
prefix sum of the tasks' totals and cuts. Only the totals, one number a task, go through the driver. A boundary record is written for
each piece of a document that lies in one sequence.
"""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.runtime import Scratch, ship

SEQUENCE = 2048
END_ID = 1
def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_encoder(path: str, pattern: str, added: bool = True):
    """An encoder of plain text with the ids of the byte-level tokenizer file at path.

    In that file each merge makes the token with the next id, so a token's id is its rank, which is how tiktoken states the same
    vocabulary; it encodes several times as fast. Tests compare the ids with those of the tokenizers library. With added, the file's added
    tokens are recognised inside a text, as that library does by default; without, their letters are plain text.
    """
    import tiktoken

    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokens = spec.get("added_tokens", [])
    if added and any(x[k] for x in tokens for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on their surroundings are not supported")
    special = {x["content"]: x["id"] for x in tokens}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special if added else {})


def worker_encoder(path: str, pattern: str, added: bool = True):
    """The encoder, kept for the life of a Python worker."""
    key = f"_massif_encoder:{path}:{added}"
    if key not in sys.modules:
        sys.modules[key] = load_encoder(path, pattern, added)
    return sys.modules[key]


def token_table(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", added: bool = True) -> DataFrame:
    """(id, part, at, n, ids): each row's ids with the end id, as little-endian 16-bit numbers, and its offset `at` among its task's."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, pattern, added)
        encode = partial(encoder.encode, allowed_special="all") if added else encoder.encode_ordinary
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [np.array([*encode(x.as_py() or ""), END_ID], dtype="<u2") for x in batch.column(1)]
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(len(ids), part, dtype=np.int32)),
                    pa.array(at + np.cumsum(sizes) - sizes),
                    pa.array(sizes),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                ],
                ["id", "part", "at", "n", "ids"],
            )
            at += int(sizes.sum())

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, part int, at long, n long, ids binary")


def pack(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, added: bool = True) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): a row for each piece of a document in one sequence.

    Null and empty texts give the end id alone; a long one spreads over as many sequences as it needs. Rows that repeat are packed as often as they occur. All sequences but the last
    are full; the last is padded to the full length unless its own is a power of two. An empty table gives no piece. With added, the
    vocabulary file's added tokens are recognised inside texts.
    """
    spark = df.sparkSession
    tokens = Scratch(spark, "packing").save(token_table(df, path, pattern, id_col, text_col, added))
    # one number for each task of the first pass
    totals = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, sums = 0, {}
    for part, n in totals:
        sums[part] = before
        before += n
    bases = spark.sparkContext.broadcast(sums)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = bases.value
        for batch in batches:
            rows: list[tuple] = []
            source: list[int] = []
            for i, (part, at, n, ids) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 5)))):
                g = base[part] + at
                values = np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
                for k in range(g // sequence, (g + n - 1) // sequence + 1):
                    start, end = max(0, k * sequence - g), min(n, (k + 1) * sequence - g)
                    rows.append((start, end - start, zlib.crc32(values[4 * start : 4 * end]), n, k, g + start - k * sequence, ids[2 * start : 2 * end]))
                    source.append(i)
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int32())), *[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.binary())],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
