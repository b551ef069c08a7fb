"""BPE encoding and decoding by a table of distinct words, with the files of the tokenizers library.

Texts are split into words where they lie. The words of a block of documents are numbered within the block, the most frequent first, so that a document becomes an array of small numbers and only a block's distinct words travel, packed by hash bucket. Where a bucket's words meet, each distinct word is encoded once; its ids go back to the (block, number) pairs that asked, and documents take the ids of their block by position. Documents are written in buckets of blocks, so that they aren't shuffled to meet them. A word stands once in a block at most: however frequent it is, it has no more entries than there are blocks.

Decoding takes the pieces of ids from the vocabulary and puts their bytes together.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each, n_parts, runs, shared_dir, table

#: Most words of a block, unless one document has more.
BLOCK_WORDS = 1_500_000
#: Words that the library encodes in one call.
CALL_WORDS = 10_000
#: Distinct words that a task keeps with their ids; beyond, it forgets them and may encode a word again.
KNOWN_WORDS = 200_000
# White space as the library's \s has it; Java's is ASCII alone.
_SPACE = r"\x09-\x0D\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The byte-level pattern of words, for java.util.regex.
WORDS = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Characters that the JVM's Unicode doesn't know yet; the library may take them for letters or numbers. It splits the texts that hold one.
UNKNOWN = r"\p{Cn}"


class Vocabulary:
    """A byte-level BPE file, read where the driver is; tasks get its text."""

    def __init__(self, text: str):
        self.text = text
        said = json.loads(text)
        split, added = said.get("pre_tokenizer") or {}, said.get("added_tokens") or []
        if said["model"]["type"] != "BPE" or said.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError("added tokens that strip or ask for whole words are not supported")
        self.specials = sorted((a["content"] for a in added), key=len, reverse=True)
        self.ids = said["model"]["vocab"] | {a["content"]: a["id"] for a in added}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def pieces(self) -> list[bytes]:
        """The bytes of each id. Pieces are written with a letter for each byte: printable Latin-1 stands for itself, other bytes in order for the letters from U+0100."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        out = [b""] * (1 + max(self.ids.values(), default=-1))
        for piece, i in self.ids.items():
            out[i] = bytes(map(letters.__getitem__, piece)) if all(c in letters for c in piece) else piece.encode()
        return out


def _tokenizer(text: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    out = Tokenizer.from_str(text)
    out.no_truncation()
    out.no_padding()
    return out


def split_words(text: Column, specials: list[str]) -> Column:
    """The words of a text in order, added tokens by themselves; null has none."""
    extract = lambda t: F.regexp_extract_all(t, F.lit(WORDS), F.lit(0))
    text = F.coalesce(text, F.lit(""))
    if not specials:
        return extract(text)
    every = "|".join("".join(f"\\x{{{ord(c):X}}}" for c in s) for s in specials)
    tokens, pieces = F.regexp_extract_all(text, F.lit(every), F.lit(0)), F.split(text, every, -1)
    between = lambda p, i: F.concat(extract(p), F.when(i < F.size(tokens), F.array(F.get(tokens, i))).otherwise(F.array().cast("array<string>")))
    return F.when(text.rlike(every), F.flatten(F.transform(pieces, between))).otherwise(extract(text))


def _library_words(text: str, tokenizer, special: re.Pattern | None) -> list[str]:
    """The same words by the library's own splitter."""
    out, at = [], 0
    plain = lambda t: out.extend(t[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(t))
    for m in special.finditer(text) if special else ():
        plain(text[at : m.start()])
        out.append(m[0])
        at = m.end()
    plain(text[at:])
    return out


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as four runs of bytes, the lowest first: those of small numbers are zeros, which compress to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(raw) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack(numbers: np.ndarray, lengths: np.ndarray, payload: bytes) -> bytes:
    """Entries of a block in one compressed string: their ascending numbers, and lengths of their parts of the payload."""
    return zlib.compress(b"".join((_planes(np.array([len(numbers)])), _planes(np.diff(numbers, prepend=0)), _planes(lengths), payload)), 6)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, memoryview]:
    raw = memoryview(zlib.decompress(packed))
    n = int(_numbers(raw[:4])[0])
    return np.cumsum(_numbers(raw[4 : 4 + 4 * n]), dtype=np.int64), _numbers(raw[4 + 4 * n : 4 + 8 * n]).astype(np.int64), raw[4 + 8 * n :]


def _blocks(docs: DataFrame, keep: list[str], text: str, vocabulary: Vocabulary, block_words: int) -> DataFrame:
    """Rows of documents (_block, the columns in keep, _slots: their words' numbers, as _planes) and, for each hash bucket of a block's distinct words, a row (_block, _bucket, _words: numbers and words packed), written in buckets of blocks: a table of the session's catalog, bpe_ and a random name, whose files lie in the shared folder like all that is written between stages."""
    spark = docs.sparkSession
    specials, shared, buckets = vocabulary.specials, spark.sparkContext.broadcast(vocabulary.text), n_parts(spark)
    odd = F.coalesce(F.col(text).rlike(UNKNOWN), F.lit(False))
    own = docs.select(*keep, F.when(~odd, split_words(F.col(text), specials)).alias("_w"), F.when(odd, F.col(text)).alias("_t"))
    k = len(keep)
    schema = T.StructType([T.StructField("_block", T.LongType()), *[T.StructField(f.name, f.dataType) for f in own.schema.fields[:k]], *T.StructType.fromDDL("_slots binary, _bucket int, _words binary").fields])

    def heard(words: pa.Array, block: int, kept: list) -> pa.RecordBatch:
        """The rows of a block's distinct words, which stand in the order of their numbers."""
        bucket = np.fromiter((zlib.crc32(w.as_buffer()) % buckets for w in words.cast(pa.binary())), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        used, starts = np.unique(bucket[order], return_index=True)
        packed = []
        for part in np.split(order, starts[1:]) if len(order) else ():
            some = words.take(pa.array(part))
            ends = np.frombuffer(some.buffers()[1], np.int32, len(some) + 1, 4 * some.offset)
            packed.append(_pack(part, np.diff(ends), memoryview(some.buffers()[2] or b"")[ends[0] : ends[-1]]))
        n = len(packed)
        return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), *[pa.nulls(n, c.type) for c in kept], pa.nulls(n, pa.binary()), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], schema.names)

    def number(batches):
        block, tokenizer = (TaskContext.get().partitionId() << 33) - 1, None
        special = re.compile("|".join(map(re.escape, specials))) if specials else None
        for b in batches:
            sizes = pc.list_value_length(b.column(k)).fill_null(0).to_numpy(zero_copy_only=False)
            sizes = sizes + pc.utf8_length(b.column(k + 1)).fill_null(0).to_numpy(zero_copy_only=False)  # at least the words that the library will find
            for a, z in runs(np.append(0, np.cumsum(sizes, dtype=np.int64)), block_words):
                block, n = block + 1, z - a
                lists, rest, kept = b.column(k).slice(a, n), b.column(k + 1).slice(a, n), [c.slice(a, n) for c in b.columns[:k]]
                if rest.null_count < n:
                    tokenizer = tokenizer or _tokenizer(shared.value)
                    lists = pa.array([w.as_py() if t.as_py() is None else _library_words(t.as_py(), tokenizer, special) for w, t in zip(lists, rest)], pa.list_(pa.string()))
                coded = pc.dictionary_encode(pc.list_flatten(lists))
                numbers, every = coded.indices.to_numpy(), coded.dictionary
                order = np.argsort(-np.bincount(numbers, minlength=len(every)), kind="stable")
                place = np.zeros(len(every), "<u4")
                place[order] = np.arange(len(every))
                slots, at = place[numbers], np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).tolist()
                raw = pa.array([_planes(slots[i:j]) for i, j in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), *kept, raw, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema.names)
                yield heard(every.take(pa.array(order)), block, kept)

    name = f"bpe_{uuid.uuid4().hex}"
    where = f"{shared_dir(spark).rstrip('/')}/{name}"
    own.mapInArrow(number, schema).write.option("path", where).option("compression", "zstd").bucketBy(n_parts(spark), "_block").saveAsTable(name)
    return spark.table(name)


def _encode_words(heard: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(_block, _ids: numbers and ids packed) for rows (_block, _bucket, _words): a bucket's words meet in one task, which encodes each distinct one once."""
    shared = heard.sparkSession.sparkContext.broadcast(vocabulary.text)

    def encode(batches):
        tokenizer, known = _tokenizer(shared.value), {}
        for b in batches:
            blocks, made = b.column(0), []
            for packed in each(b.column(1)):
                numbers, lengths, raw = _unpack(packed)
                ends = np.append(0, np.cumsum(lengths)).astype(np.int32)
                words = pa.StringArray.from_buffers(len(numbers), pa.py_buffer(ends), pa.py_buffer(raw)).to_pylist()
                if len(known) > KNOWN_WORDS:
                    known.clear()
                new = [w for w in words if w not in known]
                for at in range(0, len(new), CALL_WORDS):
                    some = new[at : at + CALL_WORDS]
                    known.update((w, array("I", e.ids)) for w, e in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False)))
                ids = [known[w] for w in words]
                made.append(_pack(numbers, np.fromiter(map(len, ids), np.int64, len(ids)), _planes(np.frombuffer(b"".join(ids), np.uint32))))
            yield pa.RecordBatch.from_arrays([blocks, pa.array(made, pa.binary())], ["_block", "_ids"])

    return heard.repartition("_bucket").select("_block", "_words").mapInArrow(encode, "_block long, _ids binary")


def encode(docs: DataFrame, path: str, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns of docs named in keep (the id alone if None) with `ids`, the text's token ids, for each row.

    The same ids as the tokenizers library gives for the whole text with the file at path, without special tokens around it; strings of added tokens inside a text are such tokens, as there. A null or empty text has an empty list. Repeated rows, ids and ties need no rule; very long texts and words are encoded whole. Columns named ids or like one in use here (_block, _slots, _bucket, _words) are not kept. An empty table gives no rows.
    """
    vocabulary = Vocabulary.read(path)
    keep = [c for c in (keep or [doc_id]) if c not in ("ids", "_block", "_slots", "_bucket", "_words")]
    both = _blocks(docs, keep, text, vocabulary, block_words)
    coded = _encode_words(both.where(F.col("_words").isNotNull()).select("_block", "_bucket", "_words"), vocabulary)
    rows = both.where(F.col("_slots").isNotNull()).select("_block", *keep, "_slots")
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        """Documents of one block and the ids of its words."""
        parts = [_unpack(x) for x in each(right["_ids"])]
        numbers, lengths = (np.concatenate([np.zeros(0, np.int64), *[p[i] for p in parts]]) for i in (0, 1))
        ids = np.concatenate([np.zeros(0, np.int32), *[_numbers(p[2]).astype(np.int32) for p in parts]])
        ends = np.append(0, np.cumsum(lengths)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32())).take(pa.array(np.argsort(numbers)))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        slots = [_numbers(x) for x in each(left["_slots"])]
        at = np.cumsum([0, *[int(sizes[s].sum()) for s in slots]]).astype(np.int32)
        flat = pc.list_flatten(lists.take(pa.array(np.concatenate(slots)))) if slots else pa.array([], pa.int32())
        return pa.table([*[left[c] for c in keep], pa.ListArray.from_arrays(pa.array(at), flat)], names=schema.names)

    return rows.groupBy("_block").cogroup(coded.groupBy("_block")).applyInArrow(assemble, schema)


def _texts(lists: pa.Array, pieces: pa.Array) -> list[str | None]:
    """The text of each list of ids; the last of pieces is empty and stands for ids beyond the vocabulary."""
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    got = pieces.take(pa.array(np.where((flat < 0) | (flat >= len(pieces)), len(pieces) - 1, flat)))
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    at = np.frombuffer(got.buffers()[1], np.int32, len(got) + 1)[np.append(0, np.cumsum(sizes))].tolist()
    raw = memoryview(got.buffers()[2] or b"")
    return [None if null else str(raw[a:z], "utf-8", "replace") for a, z, null in zip(at, at[1:], lists.is_null().to_pylist())]


def _pieces(path: str) -> list[bytes]:
    return [*Vocabulary.read(path).pieces(), b""]


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """tokens with the text of each row's ids, added tokens included; bytes that are no UTF-8 become U+FFFD, as the library has them. The vocabulary's pieces are one array by id, so that their join is a take; nothing is shuffled. A null list gives null; an id beyond the vocabulary has no piece and adds nothing, as in the library. A column named like the text is replaced."""
    tokens = tokens.drop(text)
    shared = tokens.sparkSession.sparkContext.broadcast(_pieces(path))
    place = tokens.columns.index(ids)
    schema = T.StructType([*tokens.schema.fields, T.StructField(text, T.StringType())])

    def of(batches):
        pieces = pa.array(shared.value, pa.binary())
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_texts(b.column(place), pieces), pa.string())], schema.names)

    return tokens.mapInArrow(of, schema)


def digests(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """tokens with, in place of the ids, their number n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and decoded_sha256 (of the text that decode gives, in UTF-8), lowercase hex; null lists count as empty. One pass, so that decoded texts needn't go back to the JVM."""
    rest = [c for c in tokens.columns if c not in (ids, "n_tokens", "ids_sha256", "decoded_sha256")]
    shared = tokens.sparkSession.sparkContext.broadcast(_pieces(path))
    schema = T.StructType([*[tokens.schema[c] for c in rest], *T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string").fields])
    hexed = lambda raw: hashlib.sha256(raw).hexdigest()

    def of(batches):
        pieces = pa.array(shared.value, pa.binary())
        for b in batches:
            sizes = pc.list_value_length(b.column(0)).fill_null(0).to_numpy(zero_copy_only=False)
            # Lists go through in portions, since a decoded text is longer than its ids.
            for a, z in runs(np.append(0, np.cumsum(sizes, dtype=np.int64)), CALL_WORDS * 50):
                lists = b.column(0).slice(a, z - a)
                raw = memoryview(pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype("<u4").tobytes())
                ends = [0, *(4 * np.cumsum(sizes[a:z], dtype=np.int64)).tolist()]
                made = [[hexed(raw[i:j]) for i, j in zip(ends, ends[1:])], [hexed((t or "").encode()) for t in _texts(lists, pieces)]]
                yield pa.RecordBatch.from_arrays([*[c.slice(a, z - a) for c in b.columns[1:]], pa.array(sizes[a:z].astype(np.int64)), *[pa.array(m, pa.string()) for m in made]], schema.names)

    return tokens.select(ids, *rest).mapInArrow(of, schema)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return digests(ids, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
