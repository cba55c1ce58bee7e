"""SimHash near-dedup through fuzzy hashing with the binary Golay code.

The (23, 12) Golay code is perfect: every 23-bit word lies within three bits of exactly one codeword. The 64-bit fingerprint
is cut into three segments (22, 21 and 21 bits, filled with zeros). Of four differing bits at most two fall into the two
least affected segments together, so two linked fingerprints agree there up to a word in the middle, one bit away from each. A
fingerprint's keys for a pair of segments are therefore the two codeword indices of the pair itself and of each of its one-bit neighbours,
about ten keys of 24 bits in place of hundreds. Fingerprints that share a key are compared in full. There are 3 * 2**24 keys, so buckets
grow with the corpus: one that is full is split by the third segment, whose words of two linked fingerprints differ in four bits at
most and so have a word within two bits of each; its codeword is a further key of twelve bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.llm.components import linked_components
from massif.runtime import Scratch, ship

SHINGLE = 4
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) Golay code.
GENERATOR = 0xC75


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial."""
    r = words.copy()
    for bit in range(22, 10, -1):
        r = np.where((r >> bit) & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


def _decoder() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error pattern of each syndrome."""
    low, high = np.arange(1 << 12, dtype=np.int64), np.arange(1 << 11, dtype=np.int64) << 12
    bits = 1 << np.arange(23, dtype=np.int64)
    one = bits
    two = np.array([a | b for i, a in enumerate(bits) for b in bits[:i]], dtype=np.int64)
    three = np.array([a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]], dtype=np.int64)
    errors = np.concatenate([[0], one, two, three]).astype(np.int64)
    table = np.zeros(1 << 11, dtype=np.int64)
    table[_syndromes(errors)] = errors
    return _syndromes(low), _syndromes(high), table


def golay_index(words: np.ndarray, decoder) -> np.ndarray:
    """Index (0 to 4095) of the codeword nearest to each 23-bit word: its twelve message bits."""
    low, high, table = decoder
    return (words ^ table[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key), without repeats. A key is the pair's number and two codeword indices."""
    decoder = _decoder()
    seg = [((fingerprints >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64) for at, w in SEGMENTS]
    plain = [golay_index(s, decoder) for s in seg]
    near = [np.stack([golay_index(s ^ (1 << b), decoder) for b in range(w)]) for s, (_, w) in zip(seg, SEGMENTS)]
    rows, keys = [], []
    at = np.arange(len(fingerprints), dtype=np.int64)
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        made = np.concatenate([(plain[i] << 12 | plain[j])[None], near[i] << 12 | plain[j], plain[i] << 12 | near[j]]) | (pair << 24)
        made.sort(axis=0)
        fresh = np.ones(made.shape, dtype=bool)
        fresh[1:] = made[1:] != made[:-1]
        rows.append(np.broadcast_to(at, made.shape)[fresh])
        keys.append(made[fresh])
    return np.concatenate(rows), np.concatenate(keys)


def third_codewords(fingerprints: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the row, codeword index), without repeats: of all words within two bits of the segment that the row's key leaves out."""
    decoder = _decoder()
    rows, found = [], []
    for pair, k in enumerate((2, 1, 0)):
        own = np.flatnonzero(keys >> 24 == pair)
        at, w = SEGMENTS[k]
        words = ((fingerprints[own] >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64)
        flips = np.array([0, *(1 << i | 1 << j for i in range(w) for j in range(i + 1))], dtype=np.int64)
        made = golay_index(words ^ flips[:, None], decoder)
        made.sort(axis=0)
        fresh = np.ones(made.shape, dtype=bool)
        fresh[1:] = made[1:] != made[:-1]
        rows.append(np.broadcast_to(own, made.shape)[fresh])
        found.append(made[fresh])
    return np.concatenate(rows), np.concatenate(found)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            keys, nodes = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            rows, codewords = third_codewords(nodes.view(np.uint64), keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[rows] << 12 | codewords), pa.array(nodes[rows]), *[part.column(i).take(pa.array(rows)) for i in (2, 3)]], ["key", "node", "label", "mark"])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles, A-Z lower-cased; 0 if there is no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[k : k + (1 << 15)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    out = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(out.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), dtype=np.uint64, count=b.num_rows)
        rest = b.column_names[2:]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *[b.column(c) for c in rest]], ["id", "fp", *rest])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        rows, keys = golay_keys(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["key", "node"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """(id, fp[, key]): the signed long that holds each text's fingerprint; null and empty texts have 0."""
    ship(df.sparkSession)
    columns = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")]
    kinds = f"id {df.schema[id_col].dataType.simpleString()}, fp long"
    if key_col:
        columns.append(F.col(f"`{key_col}`").alias("key"))
        kinds += f", key {df.schema[key_col].dataType.simpleString()}"
    return df.select(*columns).mapInArrow(_fingerprints, kinds)


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """(id, fingerprint, component_id[, key, kept]) for each row of df.

    Rows link if their fingerprints differ in at most four bits; component_id is the smallest id that a row reaches. Rows without a
    word have fingerprint zero and link like any others. An id that repeats counts once for each of its rows; an id that is
    null never names a component unless it is alone there. An empty table gives an empty table. key_col names a column that tells rows
    apart: the result has it as `key`, and kept is true for one row of each component, that of the smallest id (null last), then key.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "simhash")
    docs = scratch.save(fingerprints(df, id_col, text_col, key_col))
    head = F.struct(F.col("id").isNull().alias("none"), "id", *(["key"] if key_col else []))
    nodes = scratch.save(docs.groupBy("fp").agg(F.min(head).alias("head")))
    keys = scratch.save(nodes.select("fp").mapInArrow(_keys, "key long, node long"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    split = lambda full: full.mapInArrow(_split, "key long, node long, label long, mark long")
    close = lambda x, y: F.bit_count(x.node.bitwiseXOR(y.node)) <= MAX_BITS
    labels = scratch.save(linked_components(keys, lambda pairs: pairs.where(near).distinct(), scratch, split, near=close))
    scratch.drop(keys)
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp")
    heads = named.groupBy("label").agg(F.min("head").alias("first"))
    # only fingerprints of components of two or more need a look-up of another one's document
    lookup = named.join(heads, "label").select("fp", "first")
    # written, so that the join below is one of two plain exchanges, whose large partitions (a text that many rows have) Spark can split
    own = scratch.save(nodes.join(lookup, "fp", "left").select("fp", F.coalesce("first", "head").alias("first")))
    kept = ["key", (F.col("key") == F.col("first.key")).alias("kept")] if key_col else []
    return docs.join(own, "fp").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.id").alias("component_id"), *kept)
