"""Token counts through a digest cache.

A text's digest is the SHA-256 of its normal form, a tokenizer's version that of its file and its library. Digests are joined
to the counts stored for the version; texts are encoded only where a digest has none, one text for each such digest, and what
they yield is appended to the cache. Texts travel packed, at most once, and only those that are encoded; rows are joined to
counts by digests alone, those of hot digests by broadcast.

The normal form of a tokenizer that provably drops white space has each run of it as one space and none at its ends;
counts of such a tokenizer add up over words, so a worker encodes a word once and keeps the counts of at most MEMO short words. Any
other tokenizer gets whole texts as they are.

Null texts count as empty and have no token. Rows are counted one by one, whatever their ids: null and repeated ones too. No
column but id and text is read. An empty table gives an empty result. Bytes that aren't UTF-8 count as U+FFFD. Memory
follows the longest word (whole text, where counts don't add up over words). Two writers may append one digest twice: counts
are a function of digest and version, so either row serves.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.skew import hot_join
from lacuna.llm.storage import discard, keep, small_batches
from lacuna.llm.tokens import tidy

SPACE = r"[\x20\x09-\x0D]+"
#: Patterns of a tokenizer's first split that match no white space, and drop what they don't match.
WITHOUT_SPACE = frozenset({r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"})
MOST_FILE = 64 << 20
MEMO, SHORT = 500_000, 64
SEEN = 500_000
BROADCAST_DIGESTS = 500_000
COUNTS = "digest binary, n_tokens bigint"


@dataclass(frozen=True)
class Tokenizer:
    """A public tokenizer: the bytes of its file (MOST_FILE at most), its library and whether its counts add up over words."""

    data: bytes
    library: str
    spaced: bool

    @property
    def version(self) -> str:
        """SHA-256 of library, its version and the file."""
        about = f"{self.library} {importlib.import_module(self.library).__version__} "
        return hashlib.sha256(about.encode() + self.data).hexdigest()


def load(path: str) -> Tokenizer:
    """A tokenizer from a .json file (library tokenizers) or a .model file (sentencepiece), read by the driver alone."""
    if not path.endswith((".json", ".model")):
        raise ValueError(f"neither .json nor .model: {path}")
    if os.path.getsize(path) > MOST_FILE:
        raise ValueError(f"a tokenizer of more than {MOST_FILE} bytes: {path}")
    with open(path, "rb") as file:
        data = file.read()
    return Tokenizer(data, "tokenizers", drops_space(json.loads(data))) if path.endswith(".json") else Tokenizer(data, "sentencepiece", False)


def drops_space(config: dict[str, Any]) -> bool:
    """Whether a tokenizer's file proves that white space only parts words: no step of it looks across a run of white space."""
    def steps(part: dict[str, Any] | None, name: str) -> list[dict[str, Any]]:
        return part[name] if part and part["type"] == "Sequence" else [part] if part else []

    normal, split = steps(config.get("normalizer"), "normalizers"), steps(config.get("pre_tokenizer"), "pretokenizers")[:1]
    harmless = all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ") for s in normal)
    parted = bool(split) and split[0]["type"] == "Split" and split[0]["behavior"] == "Removed" and split[0]["invert"] and split[0]["pattern"].get("Regex") in WITHOUT_SPACE
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and len(t["content"].split()) == 1 for t in config.get("added_tokens", []))
    return harmless and parted and plain and not config["model"].get("dropout")


def normal_form(text: Column, tokenizer: Tokenizer) -> Column:
    """What of a text its count depends on."""
    whole = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(whole, SPACE, " ")) if tokenizer.spaced else whole


@dataclass(frozen=True)
class Cache:
    """Stored counts, a folder for each version of a tokenizer, only ever appended to. The folder is shared or a store's URI."""

    spark: SparkSession
    folder: str

    def counts(self, tokenizer: Tokenizer) -> DataFrame:
        """(digest, n_tokens) of the version, a row for each digest."""
        path = f"{self.folder}/{tokenizer.version}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], COUNTS)
        return self.spark.read.schema(COUNTS).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, tokenizer: Tokenizer, counted: DataFrame) -> None:
        """Add rows in one job: all of them are found afterwards, or none."""
        counted.write.mode("append").parquet(f"{self.folder}/{tokenizer.version}")


def count(docs: DataFrame, tokenizer: Tokenizer, cache: Cache, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens): a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    digest = F.unhex(F.sha2(normal_form(F.col(text), tokenizer).cast("binary"), 256))
    rows = keep(docs.select(F.col(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), digest.alias("__digest")).withColumnRenamed("__digest", "digest"), "token-rows")
    tally = keep(rows.groupBy("digest").agg(F.count("*").alias("rows")), "token-digests")
    missing = keep(tally.join(cache.counts(tokenizer), "digest", "left_anti").select("digest"), "token-misses")
    known, total = tally.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    misses = missing.count()
    if misses:
        texts = docs.select(digest.alias("digest"), normal_form(F.col(text), tokenizer).cast("binary").alias("text"))
        if misses < known:
            texts = texts.join(F.broadcast(missing) if misses <= BROADCAST_DIGESTS else missing, "digest", "left_semi")
        cache.append(tokenizer, encode(texts, tokenizer))
    discard(missing)
    counted = tally.join(cache.counts(tokenizer), "digest")
    return hot_join(rows, counted, "digest", F.col("rows"), total).select(key, "n_bytes", "n_tokens")


def encode(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(digest, text as binary) to (digest, n_tokens), each digest once. A task sends a digest on once, so that copies don't meet."""
    shared = texts.sparkSession.sparkContext.broadcast(tokenizer)

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, press = set(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            digests, packed = [], []
            for digest, text in zip(batch["digest"].to_pylist(), batch["text"], strict=True):
                if digest not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(digest)
                    digests.append(digest)
                    packed.append(press.compress(text.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["digest", "text"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, last = counter(shared.value), None
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            digests, texts = [], []
            for digest, text in zip(batch["digest"].to_pylist(), batch["text"], strict=True):
                if digest != last:
                    digests.append(digest)
                    texts.append(unpack.decompress(text.as_buffer()))
                    last = digest
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(size(texts), pa.int64())], ["digest", "n_tokens"])

    sent = texts.mapInArrow(pack, "digest binary, text binary").repartition("digest").sortWithinPartitions("digest")
    return sent.mapInArrow(run, COUNTS)


def counter(tokenizer: Tokenizer) -> Callable[[list[bytes]], list[int]]:
    """Counts of UTF-8 texts as the library gives them: no tokens added, special strings as its default, nothing cut or padded."""
    if tokenizer.library == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=tokenizer.data)
        return lambda texts: [len(x) for x in model.encode([t.decode("utf-8", "replace") for t in texts], num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    model = tokenizers.Tokenizer.from_str(tokenizer.data.decode())
    model.no_truncation()
    model.no_padding()

    def sizes(texts: list[bytes]) -> list[int]:
        return [len(x) for x in model.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    return by_words(sizes) if tokenizer.spaced else sizes


def by_words(sizes: Callable[[list[bytes]], list[int]]) -> Callable[[list[bytes]], list[int]]:
    """Counts of texts as sums over their words. bytes.split() parts words at SPACE."""
    memo: dict[bytes, int] = {}

    def one(text: bytes) -> int:
        words = text.split()
        new = {w for w in words if w not in memo}
        if not new:
            return sum(map(memo.__getitem__, words))
        long = {w for w in new if len(w) > SHORT}
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = set(words) - long
        new = list(new - long)
        if len(new) > MEMO:  # one text of more different words than are kept
            return sum(sum(sizes(words[i : i + 10_000])) for i in range(0, len(words), 10_000))
        memo.update(zip(new, sizes(new), strict=True))
        rest = dict(zip(long, (sizes([w])[0] for w in long), strict=True)) if long else {}
        return sum(memo[w] if w in memo else rest[w] for w in words) if rest else sum(map(memo.__getitem__, words))

    return lambda texts: [one(t) for t in texts]
