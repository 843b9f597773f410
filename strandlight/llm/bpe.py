"""BPE encoding and decoding by a table of distinct words.

The texts are cut into words where the tokenizer itself must cut, in blocks of some megabytes of text.  Each block sends
its distinct words to buckets dealt by word, and each document becomes the positions of its words among its block's.  A bucket's
distinct words are encoded once.  Their ids go back to the blocks; the pieces of a block's ids come from a join with
the vocabulary (id to piece), and documents are put together by position.

A word travels once for each block, not for each time it occurs, and texts do not travel.  Rows are at most the blocks' distinct words, in
proportion to the corpus.  A task holds a block (BLOCK_BYTES of text, or one longer text) or the distinct words of a bucket
(about WORDS_PER_BUCKET), whatever the corpus.

Null text encodes as the empty text; repeated rows give repeated results; a very long text is a block of its own.  An
empty table gives no rows.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.llm.common import cut_lineage
from strandlight.llm.wordcodec import BYTE_LETTERS, codec, cut_spaced

BLOCK_BYTES = 12 << 20  # of text; a block ends with the row that reaches it
WORDS_PER_BUCKET = 400_000
ROW_WORDS = 100_000  # of documents that travel in one row
BYTES_PER_WORD = 40  # of text for each distinct word of a corpus, at least


def _shrunk(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _grown(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_numbers(values: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of significance: the high bytes are nearly all alike."""
    return _shrunk(np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(_grown(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def pack_words(words: list[str]) -> tuple[bytes, bytes]:
    """(text, lengths in characters).  Sorted words share beginnings, which compresses well."""
    return _shrunk("".join(words).encode("utf-8", "surrogatepass")), pack_numbers(np.fromiter(map(len, words), np.uint32, len(words)))


def unpack_words(text: bytes, lengths: bytes) -> list[str]:
    whole, ends = _grown(text).decode("utf-8", "surrogatepass"), np.cumsum(unpack_numbers(lengths)).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def id_to_piece(spark: SparkSession, tokenizer: str) -> DataFrame:
    """(id, piece): the bytes that each id of a byte-level vocabulary stands for.  Its size is that of the vocabulary."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {letter: byte for byte, letter in enumerate(BYTE_LETTERS)}
    pieces = {i: bytes(byte_of[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    pieces |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    rows = pa.table({"id": pa.array(list(pieces), pa.int32()), "piece": pa.array(list(pieces.values()), pa.binary())})
    return spark.createDataFrame(rows)


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _blocks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[int, list, list[np.ndarray], _Numbers]]:
    """(block, doc_ids, each document's words as numbers, the words) of a task's rows (doc_id, text).  Blocks are numbered by task and turn."""
    task, turn = TaskContext.get().partitionId(), 0
    ids, rows, numbers, held = [], [], _Numbers(), 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py() or ""
            words = cut_spaced(text) if text else []
            ids.append(doc_id.as_py())
            rows.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            held += len(text) + 16
            if held >= most_bytes:
                yield task << 32 | turn, ids, rows, numbers
                turn += 1
                ids, rows, numbers, held = [], [], _Numbers(), 0
    if ids:
        yield task << 32 | turn, ids, rows, numbers


def _dealt(words: _Numbers, buckets: int) -> list[tuple[int, list[str]]]:
    """Each bucket's words, sorted, by bucket."""
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets, []).append(w)
    for own in out.values():
        own.sort()
    return sorted(out.items())


def _check(words: list[str]) -> int:
    return zlib.crc32("\0".join(words).encode("utf-8", "surrogatepass"))


def word_lists(docs: DataFrame, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(bucket, block, words, lengths): the distinct words of each block of ``docs`` (doc_id, text), by the bucket that will encode them."""
    names = ["bucket", "block", "words", "lengths"]

    def lists(batches):
        for block, _, _, numbers in _blocks(batches, block_bytes):
            rows = [(bucket, block, *pack_words(own)) for bucket, own in _dealt(numbers, buckets)]
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1000]), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=names)

    return docs.mapInArrow(lists, "bucket int, block long, words binary, lengths binary")


def encoded_words(lists: DataFrame, tokenizer: str, buckets: int) -> DataFrame:
    """Each bucket's distinct words, encoded once: (block, bucket, check, counts, ids), where counts and ids stand for the
    block's words of that bucket in sorted order, and ``check`` is those words' checksum.  The words themselves need not travel back."""
    names = ["block", "bucket", "check", "counts", "ids"]

    def encode(batches):
        words_of, ids, last = codec(tokenizer), {}, None
        for batch in batches:
            rows = []
            for bucket, block, packed, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != last:
                    ids, last = {}, bucket  # a bucket's rows stand together
                own = unpack_words(packed, lengths)
                for w in set(own).difference(ids):
                    ids[w] = words_of.word(w)
                found = [ids[w] for w in own]
                flat = np.frombuffer(b"".join(found), "<u4")
                rows.append((block, bucket, _check(own), pack_numbers(np.fromiter(map(len, found), np.uint32, len(found)) // 4), pack_numbers(flat)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=names)

    dealt = lists.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(encode, "block long, bucket int, check long, counts binary, ids binary")


def block_pieces(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(block, piece_ids, pieces): all ids that a block uses and what they stand for, by a join with the vocabulary.  The vocabulary is of a
    fixed size, and so may be broadcast; a block has at most as many rows."""

    def own(batches):
        for batch in batches:
            ids = [pack_numbers(np.unique(unpack_numbers(x))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["block", "ids"])

    def used(group: pa.Table) -> pa.Table:
        seen = np.zeros(1 << 16, bool)
        for x in group.column("ids").to_pylist():
            ids = unpack_numbers(x)
            if len(ids) and int(ids[-1]) >= len(seen):
                seen = np.concatenate([seen, np.zeros(int(ids[-1]) + 1 - len(seen), bool)])
            seen[ids] = True
        ids = np.flatnonzero(seen).astype(np.int32)
        return pa.table({"block": pa.array(np.full(len(ids), group.column("block")[0].as_py()), pa.int64()), "id": pa.array(ids)})

    ids = encoded.select("block", "ids").mapInArrow(own, "block long, ids binary").groupBy("block").applyInArrow(used, "block long, id int")
    joined = ids.join(F.broadcast(id_to_piece(encoded.sparkSession, tokenizer)), "id")
    return joined.groupBy("block").agg(F.collect_list("id").alias("piece_ids"), F.collect_list("piece").alias("pieces"))


def positions(docs: DataFrame, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, doc_ids, sizes, numbers, order, dealt, checks): a block's documents in rows of about ROW_WORDS words, as numbers given as words come.
    A block's first row has besides: ``order``, those numbers in the order of buckets and words, and each bucket's number and checksum."""
    names = ["block", "doc_ids", "sizes", "numbers", "order", "dealt", "checks"]
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))

    def place(batches):
        for block, ids, rows, numbers in _blocks(batches, block_bytes):
            dealt = _dealt(numbers, buckets)
            order = np.fromiter((numbers[w] for _, own in dealt for w in own), np.uint32, len(numbers))
            head = pack_numbers(order), [b for b, _ in dealt], [_check(own) for _, own in dealt]
            at, held = 0, 0
            for k, own in enumerate(rows, 1):
                held += len(own)
                if held >= ROW_WORDS or k == len(rows):
                    part = rows[at:k]
                    row = (block, ids[at:k], pack_numbers(np.array([len(r) for r in part])), pack_numbers(np.concatenate(part)), *head)
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)
                    at, held, head = k, 0, (None, None, None)

    return docs.mapInArrow(place, "block long, doc_ids array<long>, sizes binary, numbers binary, order binary, dealt array<int>, checks array<long>")


def encode_documents(docs: DataFrame, tokenizer: str, stable: bool = False, **sizes) -> DataFrame:
    """(doc_id, ids, decoded) for ``docs`` (doc_id, text): 32-bit little-endian ids and the bytes that they decode to.

    ``docs`` is read twice, and its partitions must be the same then.  Those of files are (``stable``); others are kept first.
    """
    return _assemble(docs, tokenizer, stable, "doc_id long, ids binary, decoded binary", lambda i, ids, dec: (i, ids, dec), [pa.int64(), pa.binary(), pa.binary()], **sizes)


def encode_digests(docs: DataFrame, tokenizer: str, stable: bool = False, **sizes) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode_documents`` returns."""

    def digest(i, ids, dec):
        return i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(dec.decode("utf-8", "replace").encode()).hexdigest()

    return _assemble(docs, tokenizer, stable, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest, [pa.int64(), pa.int64(), pa.string(), pa.string()], **sizes)


def _assemble(docs: DataFrame, tokenizer: str, stable: bool, schema: str, row, types, block_bytes: int = BLOCK_BYTES, words_per_bucket: int = WORDS_PER_BUCKET) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs if stable else cut_lineage(docs)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(12, -(-size // (BYTES_PER_WORD * words_per_bucket)))  # they follow the corpus
    encoded = cut_lineage(encoded_words(word_lists(docs, buckets, block_bytes), tokenizer, buckets))
    names = [x.split()[0] for x in schema.split(", ")]

    def table_of(block: int, dealt: list, checks: list, words: pa.Table) -> tuple[list[bytes], list[bytes]]:
        """Ids and decoded bytes of a block's words, in the order of buckets and words."""
        found, piece = {}, {}
        for bucket, check, counts, ids, own_ids, own_pieces in zip(*(words.column(c).to_pylist() for c in ("bucket", "check", "counts", "ids", "piece_ids", "pieces"))):
            if bucket is None:
                piece = dict(zip(own_ids, own_pieces))
            else:
                found[bucket] = check, counts, ids
        if [found.get(b, (None,))[0] for b in dealt] != checks:
            raise ValueError(f"the word table does not fit block {block}: its rows changed between reads")
        ids_of, bytes_of = [], []
        for b in dealt:
            counts, ids = unpack_numbers(found[b][1]), unpack_numbers(found[b][2])
            flat, pieces = ids.tobytes(), [piece[i] for i in ids.tolist()]
            ends = np.cumsum(counts).tolist()
            for a, z in zip([0, *ends], ends):
                ids_of.append(flat[4 * a : 4 * z])
                bytes_of.append(b"".join(pieces[a:z]))
        return ids_of, bytes_of

    def assemble(key, places: pa.Table, words: pa.Table) -> pa.Table:
        out = []
        if len(places):
            first = next(k for k, x in enumerate(places.column("order")) if x.is_valid)
            order, dealt, checks = (places.column(c)[first].as_py() for c in ("order", "dealt", "checks"))
            ids_of, bytes_of = table_of(key[0], dealt, checks, words)
            rank = np.zeros(len(ids_of), np.uint32)
            rank[unpack_numbers(order)] = np.arange(len(ids_of), dtype=np.uint32)
        for doc_ids, sizes, numbers in zip(*(places.column(c) for c in ("doc_ids", "sizes", "numbers"))):
            where, ends = rank[unpack_numbers(numbers.as_py())], np.cumsum(unpack_numbers(sizes.as_py())).tolist()
            for i, a, z in zip(doc_ids.as_py(), [0, *ends], ends):
                own = where[a:z].tolist()
                out.append(row(i, b"".join([ids_of[k] for k in own]), b"".join([bytes_of[k] for k in own])))
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    pieces = block_pieces(encoded, tokenizer)
    none = {c: F.lit(None).cast(t) for c, t in (("piece_ids", "array<int>"), ("pieces", "array<binary>"))}
    words = encoded.select("*", *[c.alias(k) for k, c in none.items()]).unionByName(pieces, allowMissingColumns=True)
    return positions(docs, buckets, block_bytes).groupBy("block").cogroup(words.groupBy("block")).applyInArrow(assemble, schema)


def decode(ids: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of any ``ids`` (doc_id, ids array<int>) by a join with the vocabulary, which is of
    a fixed size and so may be broadcast.  Ids without a piece are left out; null ids decode as ''."""
    pieces = F.broadcast(id_to_piece(ids.sparkSession, tokenizer))
    own = ids.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    own = cut_lineage(own)
    parts = own.select("_row", F.posexplode("ids").alias("_pos", "id")).join(pieces, "id")
    joined = parts.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "piece"))).alias("p"))
    text = F.expr("decode(unhex(array_join(transform(p, x -> hex(x.piece)), '')), 'UTF-8')")
    return own.join(joined, "_row", "left").select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
