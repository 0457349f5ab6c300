"""Token ids in binary shards with a minimal perfect hash index.

``write`` encodes whole texts, appends an end id and writes a store; all files are little-endian:

* ``ids/<shard>.ids``: the raw ids of a shard's documents, one after another, 2 bytes an id (4 for
  vocabularies of more than 65,536); ``ids/<shard>.docs``: an Arrow file of its keys, copy numbers'
  base and lengths. Documents are in ascending key order over all shards, nulls first, rows
  of one key in the order of their texts' hashes;
* ``index/<bucket>.mph``: keys are dealt to buckets by hash. A bucket's minimal perfect hash is a cascade
  of bit arrays: a key that falls alone on a bit of a level owns it, the others go on to the next
  level. The rank of its bit numbers a key without gaps, and that record holds a fingerprint, the
  shard, the offset in it, the ids before it in the whole store and the length. A foreign key is
  told by the fingerprint (it passes one time in 2 ** 32);
* ``manifest.json``: id width, end id, buckets, shards with their first id.

One key is found by a few reads of constant size (``Store.get``); many keys are dealt to their
buckets, then to their shards, and read in offset order (``find``, ``read``).

A row's key in the index is (key, copy): rows of a repeated key, null included, are copies 0, 1, 2...
and every one is stored and found. Range partitions are salted by row, so that one key's rows spread
over shards; the driver holds one manifest entry a shard. Files are written under a name of
their own and then moved, so a repeated task replaces its file by an equal one.

Defined results: null and empty texts are the end id alone; texts of any length are one document;
equal rows are all kept; an empty table gives a store without shards; extra columns, whatever their
names, are left behind.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qamill.llm.common import table
from qamill.llm.packing import tokenizer_path
from qamill.session import checkpoint_dir

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Words of each of the two generations whose ids a worker keeps between tasks, and words encoded at once.
CACHE_WORDS = 400_000
ENCODED_WORDS = 20_000
#: Ids and documents of a shard, keys of an index bucket (buckets are at least LEAST_BUCKETS).
SHARD_IDS = 32_000_000
SHARD_DOCS = 1_000_000
BUCKET_KEYS = 500_000
LEAST_BUCKETS = 32
#: Bits a key at each level of the hash, and levels at most.
GAMMA = 2
LEVELS = 64
#: Bytes that one read takes together.
RUN_BYTES = 4 << 20

WORD = np.dtype([("bits", "<u8"), ("before", "<u8")])
ENTRY = np.dtype([("print", "<u4"), ("n", "<u4"), ("shard", "<u8"), ("offset", "<u8"), ("start", "<u8")])
MAGIC = b"QMPH\x01\x00\x00\x00"


# --- files --------------------------------------------------------------------------------

def _fs(folder: str):
    """(file system, path) of a local path or URI."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


def _moved(files, name: str, path: str) -> None:
    """Give a finished file its name; an equal one of an earlier attempt may be there."""
    try:
        files.move(name, path)
    except OSError:
        if files.get_file_info(path).is_file:
            files.delete_file(name)
        else:
            raise


def _save(folder: str, name: str, content: bytes) -> None:
    files, base = _fs(folder)
    own = f"{base}/{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(content)
    _moved(files, own, f"{base}/{name}")


def shard_name(shard: int) -> str:
    return f"ids/{shard >> 16:06d}-{shard & 0xFFFF:05d}"


# --- encoding ------------------------------------------------------------------------------

# The tokenizer's pre-token pattern on lower-case ASCII and Latin-1 letters, where its Unicode
# classes come down to these, and words that its normaliser changes in case alone; a special token
# begins with "<".
_LOWER = "a-z\u00df-\u00f6\u00f8-\u00ff"
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LOWER}]+|[0-9]|[^\\s0-9{_LOWER}]+")
_PLAIN = re.compile("[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+\\Z")
#: The symbols of byte-level models: printable Latin-1 characters themselves, the other bytes from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SYMBOLS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


#: Byte that stands for the end-of-word suffix; plain words hold no such byte.
_END = b"\x01"


def word_ranks(model: dict) -> dict[bytes, int] | None:
    """Byte sequences (``_END`` for the suffix) and ids of a byte-level BPE with an end-of-word suffix, where
    ids follow the order of the merges and can serve as their ranks; None for other models."""
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix")
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model.get("merges", [])]
    byte = {chr(b): b for b in _PRINTABLE} | {s: b for b, s in _SYMBOLS.items()}
    single = [vocab.get(c + end) for c in byte for end in ("", suffix or "")]
    if not suffix or None in single or any(x >= y for x, y in zip([max(single), *merged], merged)):
        return None
    out = {}
    for token, number in vocab.items():
        cut = token.endswith(suffix) and len(token) > len(suffix)
        out[bytes(byte[c] for c in (token[:-len(suffix)] if cut else token)) + _END * cut] = number
    return out if len(out) == len(vocab) else None


class Encoder:
    """Ids of whole texts as ``tokenizers`` gives them. The tokenizer drops white space and no pre-token or
    special token crosses a space or a line break, so words are encoded one by one and kept. When the words
    in use outgrow the bound they become the old generation, from which words that occur again return.
    New words of ASCII and Latin-1 letters are merged by ``tiktoken`` over the file's own vocabulary, many in a
    call; all others go through the whole tokenizer."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tiktoken import Encoding
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            ranks = word_ranks(json.load(f)["model"])
        if not all(t.content[0] == "<" for t in self.tokenizer.get_added_tokens_decoder().values()):
            ranks = None
        self.merge = ranks and Encoding("words", pat_str="[^ \\x01]+\\x01| ", mergeable_ranks=ranks,
                                        special_tokens={}).encode_to_numpy
        self.between = ranks and ranks[b" "]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of plain words: one call, cut at the spaces between them."""
        ids = self.merge(_PIECES.sub("\\g<0>\x01", " ".join(words).lower()))
        cuts = (self.width * np.flatnonzero(ids == self.between)).tolist()
        data = ids.astype(f"<u{self.width}").tobytes()
        return [data[a:b] for a, b in zip([0, *(c + self.width for c in cuts)], [*cuts, len(data)])]

    def _new(self, words: list[str]) -> None:
        plain = list(filter(_PLAIN.match, words)) if self.merge else []
        if plain:
            self.words.update(zip(plain, self._merge(plain)))
        if len(plain) < len(words):
            odd = list(set(words).difference(plain))
            kind = "H" if self.width == 2 else "I"
            done = self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
            self.words.update(zip(odd, [array(kind, x.ids).tobytes() for x in done]))

    def batch(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > CACHE_WORDS:
            self.words, self.old = {}, self.words
        known, old = self.words, self.old
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        flat = list(chain.from_iterable(parts))
        ids = list(map(known.get, flat))
        gaps = [i for i, x in enumerate(ids) if x is None]
        missing = {flat[i] for i in gaps}
        again = old.keys() & missing
        known.update((w, old[w]) for w in again)
        fresh = list(missing - again)
        for k in range(0, len(fresh), ENCODED_WORDS):
            self._new(fresh[k:k + ENCODED_WORDS])
        for i in gaps:
            ids[i] = known[flat[i]]
        out, at = [], 0
        for words in parts:
            out.append(b"".join(ids[at:at + len(words)]))
            at += len(words)
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _slices(texts: list[str], size: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in groups of about ``size`` characters."""
    at = 0
    while at < len(texts):
        stop, total = at, 0
        while stop < len(texts) and (stop == at or total + len(texts[stop]) <= size):
            total += len(texts[stop])
            stop += 1
        yield texts[at:stop]
        at = stop


# --- writing ---------------------------------------------------------------------------------

class _Shard:
    """One open shard of a task."""

    def __init__(self, folder: str, number: int, width: int) -> None:
        self.files, self.base = _fs(folder)
        self.folder, self.number, self.width = folder, number, width
        self.own = f"{self.base}/{shard_name(number)}.{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.own)
        self.keys: list = []
        self.sizes: list[int] = []
        self.ids = 0

    def add(self, keys: list, payloads: list[bytes]) -> None:
        self.out.write(b"".join(payloads))
        self.keys += keys
        sizes = [len(p) // self.width for p in payloads]
        self.sizes += sizes
        self.ids += sum(sizes)

    def close(self) -> tuple:
        import pyarrow as pa
        self.out.close()
        _moved(self.files, self.own, f"{self.base}/{shard_name(self.number)}.ids")
        docs = pa.table({"key": pa.array(self.keys, pa.string()), "n": pa.array(self.sizes, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, docs.schema) as writer:
            writer.write_table(docs)
        _save(self.folder, f"{shard_name(self.number)}.docs", sink.getvalue().to_pybytes())
        first, last = self.keys[0], self.keys[-1]
        one = next((k for k, x in enumerate(self.keys) if x != first), len(self.keys))
        end = next((k for k, x in enumerate(reversed(self.keys)) if x != last), len(self.keys))
        return self.number, len(self.keys), self.ids, first, one, last, end


def write(docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text",
          end_id: int = END_ID, shard_ids: int = SHARD_IDS, bucket_keys: int = BUCKET_KEYS) -> dict:
    """Write the store of all rows and return its manifest (without the shard list)."""
    spark = docs.sparkSession
    width = encoder(path).width
    files, base = _fs(folder)
    for part in ("ids", "index"):
        files.create_dir(f"{base}/{part}", recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, count, rows = TaskContext.get().partitionId(), 0, []
        codec, end, shard = encoder(path), int(end_id).to_bytes(width, "little"), None
        for b in batches:
            keys, texts, at = b["_key"].tolist(), [x or "" for x in b["_text"].tolist()], 0
            for group in _slices(texts, min(1_000_000, shard_ids)):
                payloads = [x + end for x in codec.batch(group)]
                if shard and (shard.ids >= shard_ids or len(shard.keys) >= SHARD_DOCS):
                    rows.append(shard.close())
                    shard = None
                if shard is None:
                    shard, count = _Shard(folder, (task << 16) + count, width), count + 1
                shard.add([None if x is None or x != x else x for x in keys[at:at + len(group)]], payloads)
                at += len(group)
        if shard:
            rows.append(shard.close())
        out = pd.DataFrame(rows, columns=["shard", "docs", "ids", "first", "n_first", "last", "n_last"], dtype=object)
        yield out

    # the file's row number spreads the rows of one key over partitions; it takes no part in the order
    # of different keys or texts
    sent = docs.select(F.col(key).alias("_order"), F.xxhash64(text).alias("_hash"),
                       F.monotonically_increasing_id().alias("_row"),
                       F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    order = [F.col("_order").asc_nulls_first(), F.col("_hash"), F.col("_row")]
    made = sent.repartitionByRange(*order).sortWithinPartitions(*order).select("_key", "_text") \
        .mapInPandas(run, "shard bigint, docs bigint, ids bigint, first string, n_first bigint, "
                          "last string, n_last bigint").collect()

    shards, start, total = [], 0, 0
    copies, before = 0, None  # rows of the last shard's last key so far
    for r in sorted(made, key=lambda r: r["shard"]):
        base_copy = copies if shards and r["first"] == before else 0
        shards.append({"shard": r["shard"], "docs": r["docs"], "ids": r["ids"], "start": start, "copies": base_copy})
        copies = r["n_last"] + (base_copy if r["n_first"] == r["docs"] else 0)
        before, start, total = r["last"], start + r["ids"], total + r["docs"]
    info = {"width": width, "end_id": end_id, "documents": total, "ids": start,
            "key": docs.schema[key].dataType.simpleString(),
            "buckets": max(LEAST_BUCKETS, -(-total // bucket_keys))}
    _save(folder, "manifest.json", json.dumps(info | {"shards": shards}).encode())
    _index(spark, folder, shards, info["buckets"])
    return info


def manifest(folder: str) -> dict:
    files, base = _fs(folder)
    with files.open_input_stream(f"{base}/manifest.json") as f:
        return json.loads(f.read())


# --- the hash index --------------------------------------------------------------------------

def key_hashes(keys: list, copies: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each (key, copy); keys are texts or None."""
    from xxhash import xxh3_128_digest
    raw = b"".join(xxh3_128_digest(f"{copy}:" if key is None else f"{copy}:={key}") for key, copy in zip(keys, copies))
    pair = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


def _place(low: np.ndarray, high: np.ndarray, level: int, size: int) -> np.ndarray:
    x = low + high * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) % np.uint64(size)


def build_index(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> bytes:
    """File of one bucket: ``entries`` (ENTRY, fingerprints unset) in the order of the keys' ranks."""
    left, levels, parts, owner = np.arange(len(low)), [], [], []
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("a key occurs twice")
        size = 64 * max(1, -(-GAMMA * len(left) // 64))
        at = _place(low[left], high[left], len(levels), size).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        owner.append(left[alone][np.argsort(at[alone])])
        parts.append(np.packbits(bits, bitorder="little").view("<u8"))
        levels.append(size)
        left = left[~alone]
    words = np.zeros(sum(levels) // 64, WORD)
    words["bits"] = np.concatenate(parts) if parts else 0
    words["before"] = np.cumsum(np.bitwise_count(words["bits"])) - np.bitwise_count(words["bits"])
    ranked = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    entries = entries[ranked]
    entries["print"] = (high[ranked] >> np.uint64(32)).astype("<u4")
    head = json.dumps({"levels": levels, "keys": len(entries)}).encode()
    return MAGIC + struct.pack("<Q", len(head)) + head + words.tobytes() + entries.tobytes()


class Index:
    """One bucket in memory."""

    def __init__(self, content: bytes) -> None:
        size = struct.unpack_from("<Q", content, 8)[0]
        head = json.loads(content[16:16 + size])
        self.levels = head["levels"]
        n = sum(self.levels) // 64
        self.words = np.frombuffer(content, WORD, n, 16 + size)
        self.entries = np.frombuffer(content, ENTRY, head["keys"], 16 + size + n * WORD.itemsize)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entry number of each key, -1 for a key that is not there."""
        out, left, first = np.full(len(low), -1, np.int64), np.arange(len(low)), 0
        for level, size in enumerate(self.levels):
            at = _place(low[left], high[left], level, size) + np.uint64(first)
            word = self.words[(at >> np.uint64(6)).astype(np.int64)]
            bit = at & np.uint64(63)
            on = (word["bits"] >> bit) & np.uint64(1) > 0
            below = word["bits"] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[on]] = (word["before"] + np.bitwise_count(below))[on]
            left, first = left[~on], first + size
        hit = np.flatnonzero(out >= 0)
        wrong = self.entries["print"][out[hit]] != (high[hit] >> np.uint64(32))
        out[hit[wrong]] = -1
        return out


def _shard_rows(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """One task a shard."""
    rows = [(s["shard"], s["start"], s["copies"]) for s in shards]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))),
                               "shard bigint, start bigint, copies bigint")
    return df


def _numbered(keys: list, base: int) -> list[int]:
    """Copy number of each row: its place among the rows of its key, which are neighbours."""
    out, last, n = [], object(), base - 1
    for k, x in enumerate(keys):
        n = n + 1 if k == 0 or x == last else 0
        last = x
        out.append(n)
    return out


def _docs(folder: str, shard: int) -> tuple[list, np.ndarray]:
    import pyarrow as pa
    files, base = _fs(folder)
    with files.open_input_file(f"{base}/{shard_name(shard)}.docs") as f:
        rows = pa.ipc.open_file(f).read_all()
    return rows["key"].to_pylist(), rows["n"].to_numpy()


def _index(spark: SparkSession, folder: str, shards: list[dict], buckets: int) -> None:
    """Write every bucket's file from the shards' document lists."""
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, start, copies in zip(b["shard"].tolist(), b["start"].tolist(), b["copies"].tolist()):
                keys, n = _docs(folder, shard)
                low, high = key_hashes(keys, _numbered(keys, copies))
                offset = np.cumsum(n) - n
                yield pd.DataFrame({"bucket": (high % np.uint64(buckets)).astype(np.int32), "low": low.view(np.int64),
                                    "high": high.view(np.int64), "shard": shard, "offset": offset,
                                    "start": start + offset, "n": n})

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        entries = np.zeros(len(rows), ENTRY)
        for c in ("shard", "offset", "start", "n"):
            entries[c] = rows[c].to_numpy()
        bucket = int(rows["bucket"].iloc[0])
        _save(folder, f"index/{bucket:06d}.mph",
              build_index(rows["low"].to_numpy(np.int64).view("u8"), rows["high"].to_numpy(np.int64).view("u8"), entries))
        return pd.DataFrame({"bucket": [bucket], "keys": [len(rows)]})

    rows = _shard_rows(spark, shards).mapInPandas(
        listed, "bucket int, low bigint, high bigint, shard bigint, offset bigint, start bigint, n bigint")
    done = rows.groupBy("bucket").applyInPandas(build, "bucket int, keys bigint").agg(F.sum("keys")).first()[0] or 0
    if done != sum(s["docs"] for s in shards):
        raise RuntimeError(f"{done} keys were indexed")


# --- keyed access ------------------------------------------------------------------------------

class Store:
    """Single keys of a store."""

    def __init__(self, folder: str) -> None:
        self.files, self.base = _fs(folder)
        self.info = manifest(folder)
        self.heads: dict[int, tuple | None] = {}

    def _head(self, bucket: int) -> tuple | None:
        path = f"{self.base}/index/{bucket:06d}.mph"
        if not self.files.get_file_info(path).is_file:
            return None
        f = self.files.open_input_file(path)
        size = struct.unpack_from("<Q", f.read_at(16, 0), 8)[0]
        return f, json.loads(f.read_at(size, 16)), 16 + size

    def get(self, key, copy: int = 0) -> np.ndarray | None:
        """Ids of one document with its end id, None for an unknown key: one read a level, one of the
        entry and one of the ids."""
        low, high = key_hashes([None if key is None else str(key)], [copy])
        bucket = int(high[0] % np.uint64(self.info["buckets"]))
        if bucket not in self.heads:
            self.heads[bucket] = self._head(bucket)
        if self.heads[bucket] is None:
            return None
        f, head, at = self.heads[bucket]
        first = 0
        for level, size in enumerate(head["levels"]):
            place = int(_place(low, high, level, size)[0]) + first
            word = np.frombuffer(f.read_at(WORD.itemsize, at + (place >> 6) * WORD.itemsize), WORD)[0]
            bits, bit = int(word["bits"]), place & 63
            if bits >> bit & 1:
                rank = int(word["before"]) + (bits & ((1 << bit) - 1)).bit_count()
                offset = at + sum(head["levels"]) // 64 * WORD.itemsize + rank * ENTRY.itemsize
                entry = np.frombuffer(f.read_at(ENTRY.itemsize, offset), ENTRY)[0]
                if int(entry["print"]) != int(high[0]) >> 32:
                    return None
                width = self.info["width"]
                with self.files.open_input_file(f"{self.base}/{shard_name(int(entry['shard']))}.ids") as ids:
                    raw = ids.read_at(int(entry["n"]) * width, int(entry["offset"]) * width)
                return np.frombuffer(raw, f"<u{width}")
            first += size
        return None


def stored_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(key, copy) of every document, from the shards' document lists; keys are texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, copies in zip(b["shard"].tolist(), b["copies"].tolist()):
                keys, _ = _docs(folder, shard)
                yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "copy": _numbered(keys, copies)})

    return _shard_rows(spark, manifest(folder)["shards"]).mapInPandas(run, "key string, copy bigint")


def find(keys: DataFrame, folder: str) -> DataFrame:
    """(key, copy, shard, offset, start, n) of the wanted (key, copy) rows that the store holds, through
    the index: a task opens the buckets dealt to it."""
    buckets = manifest(folder)["buckets"]

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = [None if x is None or x != x else x for x in b["key"].tolist()]
            low, high = key_hashes(names, b["copy"].tolist())
            yield pd.DataFrame({"bucket": (high % np.uint64(buckets)).astype(np.int32), "low": low.view(np.int64),
                                "high": high.view(np.int64), "key": pd.Series(names, dtype=object), "copy": b["copy"]})

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _fs(folder)
        held: dict[int, Index | None] = {}
        for b in batches:
            for bucket, rows in b.groupby("bucket"):
                if bucket not in held:  # rows come sorted by bucket, one is held at a time
                    path = f"{base}/index/{bucket:06d}.mph"
                    there = files.get_file_info(path).is_file
                    held = {bucket: Index(files.open_input_stream(path).read()) if there else None}
                if held[bucket] is None:
                    continue
                at = held[bucket].find(rows["low"].to_numpy().view("u8"), rows["high"].to_numpy().view("u8"))
                got = held[bucket].entries[at[at >= 0]]
                rows = rows[at >= 0]
                yield pd.DataFrame({"key": rows["key"], "copy": rows["copy"]}
                                   | {c: got[c].astype(np.int64) for c in ("shard", "offset", "start", "n")})

    dealt = keys.select(F.col("key").cast("string").alias("key"), "copy") \
        .mapInPandas(hashed, "bucket int, low bigint, high bigint, key string, copy bigint") \
        .repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(look_up, "key string, copy bigint, shard bigint, offset bigint, start bigint, n bigint")


def read(found: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """(key, copy, start, n_tokens, ids) of found rows: ids are binary, four bytes an id, or
    with ``digest`` their crc32. A task reads its shards in offset order, neighbours together."""
    width = manifest(folder)["width"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _fs(folder)
        opened, held = None, None
        for b in batches:
            out = []
            shards, offsets, sizes = (b[c].tolist() for c in ("shard", "offset", "n"))
            k = 0
            while k < len(b):
                if shards[k] != opened:
                    opened, held = shards[k], files.open_input_file(f"{base}/{shard_name(shards[k])}.ids")
                j, end = k, offsets[k]
                while j < len(b) and shards[j] == opened and offsets[j] == end \
                        and (j == k or (end + sizes[j] - offsets[k]) * width <= RUN_BYTES):
                    end += sizes[j]
                    j += 1
                if j == k:  # not the neighbour of itself: an empty row can't be
                    raise RuntimeError("an entry without ids")
                raw = np.frombuffer(held.read_at((end - offsets[k]) * width, offsets[k] * width), f"<u{width}").astype("<u4")
                for i in range(k, j):
                    ids = raw[offsets[i] - offsets[k]:offsets[i] - offsets[k] + sizes[i]].tobytes()
                    out.append(zlib.crc32(ids) if digest else ids)
                k = j
            yield pd.DataFrame({"key": b["key"], "copy": b["copy"], "start": b["start"], "n_tokens": b["n"],
                                "ids": pd.Series(out, index=b.index, dtype="int64" if digest else object)})

    return found.repartition("shard").sortWithinPartitions("shard", "offset").mapInPandas(
        run, f"key string, copy bigint, start bigint, n_tokens bigint, ids {'bigint' if digest else 'binary'}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every document written and read back through the index."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    folder = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, tokenizer_path(TOKENIZER))
    back = read(find(stored_keys(spark, folder), folder), folder, digest=True)
    kind = docs.schema["doc_id"].dataType
    return back.select(F.col("key").cast(kind).alias("doc_id"), "start", "n_tokens", F.col("ids").alias("ids_crc32"))
