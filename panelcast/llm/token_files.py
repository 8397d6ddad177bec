"""Token ids as ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

Documents are dealt to ranges of their key and sorted; each task encodes its range and
writes one file of stripes.  Readers take stripes in parallel, skip stripes and row
groups by the minima and maxima of the sorted key, and look single keys up through the
Bloom filter.  Arrow cuts texts at blanks, numbers the words that differ and puts the
ids together by these numbers; no token of the tokenizer reaches over a blank.  Words
are encoded without the signs after them, and a worker remembers them.  A word of
letters is one piece to the tokenizer, so it goes to the tokenizer's model without its
normaliser and splitter.
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, shared_folder
from .common import partitions, sliced

#: Ends every document.
END = 1
#: Pieces of words that a worker remembers.
REMEMBERED = 700_000
#: Bytes of text that are encoded at a time.
ROOM = 8_000_000
#: Starts the tokenizer's marks, which it finds anywhere in a text.
MARK = "<|"
#: ASCII signs; a run of them is one piece to the tokenizer, but where a letter follows.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Latin, Greek and Cyrillic letters end here: normal form and case are the same in every release of Unicode.
SETTLED = "\u0500"
#: Letters that stand for bytes in the model: printable ones for themselves, all others for 256 and on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTED)}
#: Settled letters as the tokenizer's normaliser spells them, letter by letter (a final sigma is like any other; none joins the one before it).
NORMAL = {c: unicodedata.normalize("NFC", c).lower() for c in map(chr, range(ord(SETTLED))) if c.isalpha()}
SPELLED = {c: n.encode().decode("latin-1").translate(BYTES) for c, n in NORMAL.items() if n.isalpha()}
#: Letters that the normaliser turns into a letter and a mark (Indic ones with a nukta, the dotted capital I); a mark is in one piece with signs after it.
DOTTED = "".join(c for c in map(chr, range(128, 0x20000)) if c.isalpha() and not unicodedata.normalize("NFC", c).lower()[-1].isalpha())
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "10000",
       "orc.stripe.size": str(64 << 20), "orc.dictionary.key.threshold": "0", "compression": "zstd"}


class Encoder:
    """Encodes texts with a tokenizer file; the ids of the pieces of words seen lately are kept as bytes."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.piece = self.tokenizer.model.tokenize

    def lone(self, word: str) -> bytes | None:
        """Ids of a word of settled letters, as the tokenizer's normaliser spells it; None for other words."""
        if not word.isalpha():
            return None
        if not word.isascii():
            try:
                word = "".join(map(SPELLED.__getitem__, word))
            except KeyError:
                return None
        return array("I", [t.id for t in self.piece(word)]).tobytes()

    def cut(self, texts: pa.Array) -> pa.Array:
        """Lists of words between blanks and line ends, which the tokenizer drops; ASCII texts without its marks are lower-cased first, as it does."""
        plain = pc.and_not(pc.equal(pc.binary_length(texts), pc.utf8_length(texts)), pc.match_substring(texts, MARK))
        return pc.split_pattern(pc.replace_substring(pc.if_else(plain, pc.ascii_lower(texts), texts), "\n", " "), " ")

    @staticmethod
    def stems(words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words without signs after their last letter, in lower case if they are ASCII; which words had such signs."""
        marked, bare = pc.match_substring(words, MARK), pc.ascii_rtrim(words, SIGNS)
        loose = pc.and_not(pc.match_substring_regex(bare, r"\pL$"), pc.match_substring_regex(bare, f"[{DOTTED}]$"))
        bare = pc.if_else(pc.and_not(loose, marked), bare, words)
        plain = pc.and_not(pc.equal(pc.binary_length(bare), pc.utf8_length(bare)), marked)
        return pc.if_else(plain, pc.ascii_lower(bare), bare), pc.less(pc.binary_length(bare), pc.binary_length(words))

    def learn(self, missing: list[str]) -> None:
        """Encode and remember pieces of words."""
        known, odd = self.known, []
        for word in missing:
            found = self.lone(word)
            if found is None:
                odd.append(word)
            else:
                known[word] = found
        for i in range(0, len(odd), 20_000):
            part = odd[i:i + 20_000]
            for word, found in zip(part, self.batch(part, add_special_tokens=False), strict=True):
                known[word] = array("I", found.ids).tobytes()

    def found(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of words."""
        found = list(map(self.known.get, pieces))
        missing = [p for p, x in zip(pieces, found, strict=True) if x is None]
        if not missing:
            return found
        if len(self.known) + len(missing) > REMEMBERED:
            self.known = {p: x for p, x in zip(pieces, found, strict=True) if x is not None}
        self.learn(missing)
        learned = map(self.known.__getitem__, missing)
        return [next(learned) if x is None else x for x in found]

    def spelled(self, words: pa.Array) -> pa.ListArray:
        """Ids of each word; a last list holds the end id."""
        # signs after a letter are a piece of their own, so words share what is before them
        stems, signed = self.stems(words)
        tails = pc.replace_substring_regex(words.filter(signed), r"(?s)^.*\pL", "")
        pieces = pa.concat_arrays([pa.array([""], words.type), stems, tails]).dictionary_encode()
        number = pieces.indices.to_numpy()
        both = np.zeros((len(words), 2), np.int32)
        both[:, 0] = number[1:len(words) + 1]
        both[signed.to_numpy(zero_copy_only=False), 1] = number[len(words) + 1:]
        raw = self.found(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = ragged(np.fromiter(map(len, raw), np.int64, len(raw)) // 4, np.frombuffer(b"".join(raw), np.int32)).take(pa.array(both.ravel()))
        sizes = np.diff(np.asarray(ids.offsets)[::2])
        return ragged(np.append(sizes, 1), np.append(np.asarray(ids.values), np.int32(END)))

    def ended(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text with the end id; every word that differs is looked at once."""
        cut = self.cut(texts)
        words = cut.flatten().dictionary_encode()
        spelled, stops = self.spelled(words.dictionary), np.asarray(cut.offsets)[1:]
        ids = spelled.take(pa.array(np.insert(words.indices.to_numpy(), stops, len(words.dictionary))))
        at = np.asarray(ids.offsets)[stops + np.arange(1, len(texts) + 1)]
        return ragged(np.diff(at, prepend=0), ids.values)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without the end id."""
        ids = self.ended(pa.array(texts, pa.string()))
        flat, stops = np.asarray(ids.values), np.asarray(ids.offsets).tolist()
        return [flat[a:b - 1].tobytes() for a, b in zip(stops[:-1], stops[1:], strict=True)]


def ragged(sizes: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    """Lists of so many values each."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, sizes)), pa.int32()), pa.array(values))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", files: int | None = None) -> None:
    """Write (doc_id, part, ids) as ORC under ``path``; a null text has the end id only.

    Files hold ranges of the key in ascending order, numbered by ``part``; rows of one
    key are ordered by their text's hash and length, null keys come first.  Other
    columns are not written.  No rows give files without rows.
    """
    n = files or partitions(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        own, at = encoder(tokenizer), TaskContext.get().partitionId()
        place = 0
        for part in sliced(batches, "text", 10_000, ROOM):
            yield pa.record_batch([part.column(0), pa.array(np.full(len(part), at, np.int32)), pa.array(np.arange(place, place + len(part)), pa.int64()),
                                   own.ended(part.column(1))], names=["doc_id", "part", "place", "ids"])
            place += len(part)
    encoded = rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part int, place bigint, ids array<int>")
    encoded.write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, place, ids); filters on doc_id are pushed down to stripes and row groups."""
    return spark.read.schema("doc_id bigint, part int, place bigint, ids array<int>").orc(path)


def token_index(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) in the order of the files: ``start`` counts the ids of all documents before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            flat, stops = np.asarray(column.flatten()).astype("<u4", copy=False), np.asarray(column.offsets)
            stops = stops - stops[0]
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
            yield pa.record_batch([*(batch.column(i) for i in range(3)), pa.array(np.diff(stops).astype(np.int64)), pa.array(crc, pa.int64())],
                                  names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])
    # written, as both the files' sums and the running sums read it
    slim = materialise(tokens.select("doc_id", "part", "place", "ids").mapInArrow(run, "doc_id bigint, part int, place bigint, n_tokens bigint, ids_crc32 bigint"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sums = slim.groupBy(F.col("part").alias("p")).agg(F.sum("n_tokens").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = slim.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(sums, rows.part == sums.p).select("doc_id", (F.col("start") + F.col("base")).cast("bigint").alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    """A folder for token files that all executors share; it is removed when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
