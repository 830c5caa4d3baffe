"""Token files: the ids of documents in ascending key order, range-coded in blocks, with an index.

A file is written by Spark as rows of (part, start, keys, lengths, block_ids, block_crcs, blocks): ``part`` numbers the
key ranges in order, ``start`` is the number of ids before the row in its part, and the blocks hold the ids of the
row's documents one after the other. Each text is cut into pieces that the tokenizers library encodes; a worker keeps
the ids of pieces it has met. Reading decodes the blocks, checks their checksums and cuts the ids into documents.
The number of ids before a part is a running sum over a table with one row for each part.

Nulls and edge cases: a null text has the end id only. A null key comes first and stays null. Rows with equal keys
stand next to each other in no set order. Documents are written whole: one longer than a row's usual size makes a
row of its own. An empty table gives an empty file. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import idcoder
from tracewell.llm.pieces import APOSTROPHE, DIGIT, HIGH, LETTER, OTHER, SPACE, Memory, between, encode_column, gather, gathered
from tracewell.llm.storage import shared_dir

#: Ids of a row of the file: one block, or those of a longer document.
ROW_IDS = idcoder.BLOCK
#: Encoded pieces that a worker keeps, about 40 MB; beyond them it starts anew.
PIECES = 700_000
#: Pieces end where the vocabulary's own split ends a word whatever stands around: after white space (which it drops), and
#: between ASCII letters, single digits and other ASCII; "'" begins endings such as 's, so nothing is cut after it.
CUTS = between(
    *((SPACE, b) for b in (LETTER, DIGIT, APOSTROPHE, OTHER, HIGH)),
    *((LETTER, b) for b in (DIGIT, APOSTROPHE, OTHER)),
    *((DIGIT, b) for b in (LETTER, DIGIT, APOSTROPHE, OTHER)),
    *((OTHER, b) for b in (LETTER, DIGIT)),
)
WHITE = "\t\n\x0b\x0c\r "
#: What the split takes for one word, whatever version of Unicode's tables it has: Latin letters alone.
ONE_WORD = r"^[a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+$"
#: Words given to the library as one text.
TOGETHER = 4096


class Tokens:
    """The tokenizers library on distinct pieces of text, with a bounded memory."""

    def __init__(self, spec: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the same model for what is known to be one word: nothing but white space to split at, nothing to fold, and for
        # ASCII no bytes to rename; pieces are kept here, so the library need not keep words
        spec = json.loads(spec)
        self.added = [x["content"] for x in spec["added_tokens"]]
        vocab, self.end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        words = pre_tokenizers.WhitespaceSplit()
        renamed = pre_tokenizers.Sequence([words, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ascii, self.latin = (Tokenizer(models.BPE(vocab, merges, cache_capacity=0, end_of_word_suffix=self.end)) for _ in range(2))
        self.ascii.pre_tokenizer, self.latin.pre_tokenizer = words, renamed
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith(self.end)]] = True
        self.memory = Memory(self._learn, PIECES, pa.uint16(), self._plain)

    @staticmethod
    def _plain(pieces: pa.Array) -> pa.Array:
        """Without the white space behind them, and in lower case if they are ASCII."""
        bare = pc.ascii_rtrim(pieces, WHITE)
        return pc.if_else(pc.string_is_ascii(bare), pc.ascii_lower(bare), bare)

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        letters = pc.and_(pc.string_is_ascii(pieces), pc.ascii_is_alpha(pieces)).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~letters)
        folded = self._fold(pieces.take(pa.array(rest)))
        single = pc.match_substring_regex(folded, ONE_WORD).to_numpy(zero_copy_only=False)
        parts = [self._words(self.ascii, pieces.filter(pa.array(letters))), self._words(self.latin, folded.filter(pa.array(single)))]
        odd = self._whole(pieces.take(pa.array(rest[~single])).to_pylist())
        every = np.concatenate([*(flat for flat, _ in parts), *odd])
        own = np.concatenate([*(counts for _, counts in parts), [len(f) for f in odd]]).astype(np.int64)
        place = np.argsort(np.concatenate([np.flatnonzero(letters), rest[single], rest[~single]]), kind="stable")
        return gather(every, (np.cumsum(own) - own)[place], own[place]), own[place]

    def _words(self, tokenizer, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and how many each has. Many words are encoded as one text: its ids part where a last one stands."""
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.minimum(np.arange(0, len(words) + TOGETHER, TOGETHER), len(words)).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(ends, words.cast(pa.string())), "\n").to_pylist()
        flat = np.concatenate([np.array(e.ids, np.int64) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        last = np.flatnonzero(self.ends[flat])
        if len(last) != len(words):
            raise ValueError("a word does not end where its last id does")
        return flat, np.diff(np.concatenate([[-1], last]))

    def _fold(self, pieces: pa.Array) -> pa.Array:
        """The vocabulary's folding of pieces."""
        if not len(pieces):
            return pieces
        fold = self.tokenizer.normalizer.normalize_str
        folded = fold("\n".join(pieces.to_pylist())).split(" ")
        if len(folded) != len(pieces):  # white space or nothing inside some: one by one
            folded = [fold(p) for p in pieces.to_pylist()]
        return pa.array(folded, pa.large_string())

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, last, ids, counts) of runs of rows. Texts with the string of an added token are encoded uncut."""
        apart = np.zeros(len(column), bool)
        for token in self.added:
            apart |= pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        return encode_column(column, self.memory, CUTS, apart, self._whole)


_tokens: dict[bytes, Tokens] = {}


def tokens(spec: bytes) -> Tokens:
    name = hashlib.sha256(spec).digest()
    if name not in _tokens:
        _tokens[name] = Tokens(spec)
    return _tokens[name]


#: Fixed value: the split that pieces are cut for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _check(spec: bytes) -> None:
    """Pieces may be encoded by themselves if white space only parts words and words are taken one by one."""
    j = json.loads(spec)
    steps = (j["normalizer"] or {}).get("normalizers", [])
    replaced = [x.get("pattern") for x in steps if x.get("type") == "Replace" and x.get("content") == " "]
    split = (j["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    if (
        [x.get("type") for x in steps] != ["NFC", "Replace", "Lowercase"]
        or replaced != [{"Regex": r"\s+"}]
        or [x.get("type") for x in split] != ["Split", "ByteLevel"]
        or split[0].get("pattern") != {"Regex": SPLIT}
        or split[0].get("behavior") != "Removed"
        or not split[0].get("invert")
        or split[1].get("use_regex") or split[1].get("add_prefix_space")
        or not j["model"].get("end_of_word_suffix")
        or any(j["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        or any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in j["added_tokens"])
    ):
        raise ValueError("only vocabularies that drop white space and take words one by one are handled")


def write(df: DataFrame, key: str, text: str, vocabulary: str, end_id: int, path: str) -> None:
    """Writes the ids of every text, each followed by ``end_id``, in ascending order of the key."""
    with open(vocabulary, "rb") as f:  # beside the driver, of a vocabulary's size
        spec = f.read()
    _check(spec)
    kind = df.schema[key].dataType
    rows = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    # a partition number of its own: adaptive execution must not join ranges
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first())
    numbered = ordered.withColumn("part", F.spark_partition_id())
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("total", T.LongType()),
            T.StructField("keys", T.ArrayType(kind)),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("block_ids", T.ArrayType(T.LongType())),
            T.StructField("block_crcs", T.ArrayType(T.LongType())),
            T.StructField("blocks", T.ArrayType(T.BinaryType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, start = tokens(spec), None, 0
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            blocks = idcoder.encode(flat)
            key_list = pa.concat_arrays(keys)
            one = lambda values, of: pa.array([values], pa.list_(of))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([len(flat)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(key_list)], pa.int32()), key_list),
                    one(np.concatenate(lengths), pa.int64()),
                    one([b[0] for b in blocks], pa.int64()),
                    one([b[1] for b in blocks], pa.int64()),
                    one([b[2] for b in blocks], pa.binary()),
                ],
                names=schema.names,
            )

        held = 0
        for batch in gathered(batches, 1):
            part = batch.column(2)[0].as_py()
            for first, last, found, counts in own.encode(batch.column(1)):
                ends = np.cumsum(counts + 1)
                with_end = np.insert(found, np.cumsum(counts), end_id)
                at = 0  # documents of this run that are in a row
                while at < last - first:
                    begin = int(ends[at - 1]) if at else 0
                    upto = int(np.searchsorted(ends, begin + ROW_IDS - held, side="right"))
                    upto = max(upto, at + (not held))  # a document longer than a row makes a row of its own
                    if upto > at:
                        keys.append(batch.column(0).slice(first + at, upto - at))
                        ids.append(with_end[begin : int(ends[upto - 1])])
                        lengths.append(counts[at:upto] + 1)
                        held += len(ids[-1])
                    if upto < last - first:
                        yield row()
                        start, held, keys, ids, lengths = start + held, 0, [], [], []
                    at = upto
        if held:
            yield row()

    numbered.mapInArrow(run, schema).write.parquet(path)


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """key, start, n_tokens and ids_crc32 of every document of a token file, and its ids if wanted."""
    rows = spark.read.parquet(path)
    kind = rows.schema["keys"].dataType.elementType
    sums = rows.groupBy("part").agg(F.sum("total").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    fields = [T.StructField("part", T.IntegerType()), T.StructField("key", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType([*fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, start, lengths, counts, crcs, blocks = (batch.column(c)[i].as_py() for c in ("part", "start", "lengths", "block_ids", "block_crcs", "blocks"))
                flat = idcoder.decode(list(zip(counts, crcs, blocks, strict=True))).astype("<u4")
                ends = np.cumsum(lengths)
                if int(ends[-1]) != len(flat):
                    raise ValueError(f"part {part} at {start}: the documents do not fill the blocks")
                starts = ends - lengths
                sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array([part] * len(lengths), pa.int32()), batch.column("keys")[i].values, pa.array(start + starts), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(np.append(starts, ends[-1]).astype(np.int32), flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    wanted = rows.select("part", "start", "keys", "lengths", "block_ids", "block_crcs", "blocks")
    documents = wanted.mapInArrow(run, schema)
    # one row for each part of the file, and as many parts as tasks wrote it
    return documents.join(F.broadcast(offsets), "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")


def round_trip(df: DataFrame, key: str, text: str, vocabulary: str, end_id: int) -> DataFrame:
    """Writes ``df`` as a token file in the shared folder and returns what reading it back gives."""
    path = shared_dir(df.sparkSession, "token-file")
    write(df, key, text, vocabulary, end_id, path)
    return read(df.sparkSession, path).withColumnRenamed("key", key).select(key, "start", "n_tokens", "ids_crc32")
