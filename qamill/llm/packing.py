"""Best-fit packing through a configuration linear program.

Documents become token ids and an end id; one longer than a sequence is cut into whole
sequences, its first piece holding the remainder. Packing works on the histogram of
piece lengths (at most ``capacity`` numbers, whatever the data):

1. the configuration program asks for the fewest sequences such that the lengths that
   their contents (configurations) use cover the histogram. It is solved by multiplicative weights:
   every length has a price, knapsack dynamic programming over the capacity gives the best value
   at these prices, configurations near it are used whole numbers of times, many lengths in a
   step, and prices of the lengths they cover fall. It ends when all is covered or when no
   configuration near the best one can be drawn from what is left;
2. what the histogram still holds is filled in by best fit: the largest piece left opens a
   configuration, the knapsack's reachable sums fill it as far as the pieces left allow, and the
   configuration is repeated as often as they allow. Where the result is above the program's
   dual bound, it is held against best fit alone, and the fewer sequences count;
3. every piece takes the place of its rank among the pieces of its length: a running sum
   over (partition, length) counts numbers them without bringing a length together.

Only the histogram and the table of configurations pass through the driver; both are
bounded by the capacity and the steps, not by the data.

Token ids: whole texts of ASCII and Latin-1 letters are merged by ``tiktoken`` over the tokenizer file's own
vocabulary, all of a batch in one call. Any other text is split at single spaces, which no pre-token of
the byte-level BPE crosses, and the ids of its words are kept in bounded dictionaries, from task to task, so each
is merged only once while it is kept: plain ones by ``tiktoken``, all others by ``tokenizers``. Texts holding
two white-space characters in a row or a special token are encoded whole by ``tokenizers``, whose ids the
tests hold all to.

Defined results: null and empty texts are the end id alone; special-token strings in
a text become their ids, as ``tokenizers`` does by default; repeated rows are packed one by one; an empty table gives an empty
result; extra columns, clashing names included, are left behind except ``key``.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qamill.llm.common import table
from qamill.session import materialize

CAPACITY = 2048
END_ID = 0
#: Rows of the table of configurations (48 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_SLOTS = 500_000
#: Words of each of the two generations whose ids a worker keeps.
CACHE_WORDS = 300_000
#: Steps of the multiplicative weights at most, their rate, the part of a length's demand that one
#: step uses, and configurations drawn for a length in a step.
STEPS = 100
RATE = 0.5
PARTS = 12
TRIES = 3
#: Shares that a used configuration may be below the best value; the next one holds after a step
#: that placed less than LEAST of what was left, and after the last the program ends.
SLACKS = (0.0005, 0.002, 0.01, 0.03)
LEAST = 0.02
#: Noise, in capacities, by which nearly best configurations are drawn.
SPREAD = 0.0005

_TWO_SPACES = re.compile(r"\s\s")
# The tokenizer's pre-token pattern on ASCII and Latin-1 letters, where its
# Unicode classes come down to these, where no two white-space characters meet, so that it looks at
# nothing ahead. NUL stands between two words or texts and is a pre-token of its own.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(f"[\\n -~{_LATIN}]*\\Z")
_PLAIN_WORDS = re.compile(f"[\0\\n -~{_LATIN}]*\\Z")
_PRE_TOKENS = f"\\x00|'(?:[sdmt]|ll|ve|re)| ?[{_LATIN}]+| ?[0-9]+| ?[^\\x00\\s0-9{_LATIN}]+|\\s"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def vocabulary_ranks(path: str) -> dict[bytes, int]:
    """Byte sequences and ids of a byte-level BPE file. Its symbols for bytes are the printable
    Latin-1 characters themselves and, for the other bytes in order, U+0100 and on."""
    model = json.load(open(path, encoding="utf-8"))
    special = {t["content"] for t in model["added_tokens"]}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    return {bytes([byte[c] for c in token]): number
            for token, number in model["model"]["vocab"].items() if token not in special}


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tiktoken import Encoding
        self.tokenizer = Tokenizer.from_file(path)
        # a text that holds one is encoded whole
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # merges the same vocabulary's words several times faster, many of them in a call; without any special
        # token it would look for the empty one at every character, so it has one that no plain text holds
        ranks = vocabulary_ranks(path)
        self.merge = Encoding("words", pat_str=_PRE_TOKENS, mergeable_ranks=ranks,
                              special_tokens={"\x01": max(ranks.values()) + 2}).encode_to_numpy
        self.between = ranks[b"\0"]
        self.words: dict[str, bytes] = {}   # between two spaces
        self.old: dict[str, bytes] = {}     # words in use before, which return when they occur again

    def _encode(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in done]

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of words or texts of ASCII and Latin-1 letters, without NUL and two white-space characters in a
        row: one call, cut at the NULs between them."""
        ids = self.merge("\0".join(words), disallowed_special=())
        cuts = (4 * np.flatnonzero(ids == self.between)).tolist()
        data = ids.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)])]

    def _learn(self, missing: set[str]) -> list[str]:
        """Keep the ids of words that are not known; returns the words that it encoded."""
        known, old = self.words, self.old
        again = old.keys() & missing
        known.update((x, old[x]) for x in again)
        words = list(missing - again)
        full = [x[1:] if x[:1] == " " else " " + x for x in words]
        if _PLAIN_WORDS.match("\0".join(full)) and not any("\0" in x for x in full):
            plain, odd = list(zip(words, full)), []
        else:
            plain, odd = [], []
            for x, y in zip(words, full):
                (plain if _PLAIN.match(y) else odd).append((x, y))
        if plain:
            known.update(zip([x for x, _ in plain], self._merge([y for _, y in plain])))
        if odd:
            known.update(zip([x for x, _ in odd], self._encode([y for _, y in odd])))
        return words

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        whole = [bool(_TWO_SPACES.search(t)) or any(x in t for x in self.special) for t in texts]
        plain = [not w and bool(_PLAIN.match(t)) for t, w in zip(texts, whole)]
        done = iter(self._merge([t for t, p in zip(texts, plain) if p]))
        others = iter(self._split([t for t, p, w in zip(texts, plain, whole) if not (p or w)]))
        long = iter(self._encode([t for t, w in zip(texts, whole) if w]))
        return [next(long if w else done if p else others) for p, w in zip(plain, whole)]

    def _split(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by their words."""
        if len(self.words) > CACHE_WORDS:
            self.words, self.old = {}, self.words
        known = self.words
        # words stand without the space before them; a text's first word has one instead
        parts = [t.split(" ") for t in texts]
        for words in parts:
            words[:1] = [" " + x for x in words[:1]]
        flat = list(chain.from_iterable(parts))
        ids = list(map(known.get, flat))
        gaps = [i for i, x in enumerate(ids) if x is None]
        fresh = self._learn({flat[i] for i in gaps}) if gaps else []
        for i in gaps:
            ids[i] = known[flat[i]]
        out, at = [], 0
        for words in parts:
            out.append(b"".join(ids[at:at + len(words)]))
            at += len(words)
        for x in fresh:
            if "\n" in x:  # two words joined by a line break come once
                del known[x]
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder, with the words it has met."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID, digest: bool = False) -> DataFrame:
    """(key, piece, start, length, ids): the pieces of every document; ids are binary,
    four little-endian bytes an id. With ``digest`` only their crc32 (``ids_crc32``) leaves the worker."""
    last = "ids_crc32" if digest else "ids"
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = encoder(path)
        end = array("I", [end_id]).tobytes()
        for b in batches:
            keys, texts = b["_key"].tolist(), [x or "" for x in b["_text"]]
            at = 0
            while at < len(texts):  # about a million characters at once
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= 1_000_000):
                    size += len(texts[stop])
                    stop += 1
                rows = []
                for k, ids in zip(keys[at:stop], codec.batch(texts[at:stop])):
                    ids += end
                    n = len(ids) // 4
                    cut = n % capacity or capacity
                    start, piece = 0, 0
                    while start < n:
                        part = ids[4 * start:4 * cut]
                        rows.append((k, piece, start, cut - start, crc32(part) if digest else part))
                        start, piece, cut = cut, piece + 1, cut + capacity
                yield pd.DataFrame(rows, columns=["key", "piece", "start", "length", last]) \
                    .astype({"key": b["_key"].dtype})
                at = stop

    # ids may be null: they travel as text and are cast back
    sent = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    out = sent.mapInPandas(run, "key string, piece int, start bigint, length bigint, "
                                + ("ids_crc32 bigint" if digest else "ids binary"))
    return out.select(F.col("key").cast(kind).alias(key), "piece", "start", "length", last)


def _knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration (counts by length) of most value within the capacity, by
    dynamic programming over the capacity; lengths may repeat."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    short = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        n = short[c]
        best[c] = best[c - 1]
        if n:
            total = best[c - lengths[:n]] + value[:n]
            k = int(total.argmax())
            if total[k] > best[c] + 1e-15:
                best[c], last[c] = total[k], k
    out = np.zeros(len(lengths), dtype=np.int64)
    c = capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= lengths[last[c]]
    return out


def _values(lengths: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """Largest value of a configuration within each size up to the capacity."""
    best = np.zeros(capacity + 1)
    short = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        n = short[c]
        if n:
            best[c] = max(best[c - 1], (best[c - lengths[:n]] + value[:n]).max())
    return best


def program(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS,
            parts: int = PARTS, rate: float = RATE) -> tuple[dict[tuple, int], np.ndarray, float]:
    """(configurations and times used, demand left, lower bound of any packing).

    One pricing serves a whole step: every length opens configurations of its own, drawn at
    random among the nearly best ones, and a step uses at most one part in ``parts`` of a
    length's demand, so many lengths are raised together. A configuration is used if its
    value is within ``SLACKS`` of the best one's; the slack widens as steps place little.
    The prices of each step give a dual bound; the largest is returned."""
    rng = np.random.default_rng(1)
    left, bound, level = demand.copy(), 0.0, 0
    used: dict[tuple, int] = {}
    for _ in range(steps):
        on = np.flatnonzero(left)
        if not len(on) or level == len(SLACKS):
            break
        own, m = lengths[on], len(on)
        covered = 1 - left[on] / demand[on]
        value = own / capacity * np.exp(-rate * (covered - covered.min()))
        best = _values(own, value, capacity)
        bound = max(bound, float(demand[on] @ value) / best[capacity])
        enough = (1 - SLACKS[level]) * best[capacity]
        room = np.minimum(left[on], -(-demand[on] // parts))
        noise = rng.random(4 * m) * SPREAD
        short = np.searchsorted(own, np.arange(capacity + 1), side="right").tolist()
        sizes, worth, before = own.tolist(), value.tolist(), int(left.sum())
        for k in range(m - 1, -1, -1):
            for _ in range(TRIES):
                if not room[k]:
                    break
                free, held, total, c = room.copy(), {k: 1}, worth[k], capacity - sizes[k]
                free[k] -= 1
                while c > 0 and (n := short[c]):
                    at = int(rng.random() * 3 * m)
                    found = best[c - own[:n]] + value[:n] + noise[at:at + n]
                    found[free[:n] <= 0] = -1
                    j = int(found.argmax())
                    if found[j] < 0:
                        break
                    free[j] -= 1
                    held[j] = held.get(j, 0) + 1
                    c -= sizes[j]
                    total += worth[j]
                if total < enough:
                    continue
                which = np.array(sorted(held))
                count = np.array([held[j] for j in which.tolist()])
                times = int((room[which] // count).min())
                room[which] -= count * times
                left[on[which]] -= count * times
                key = tuple(zip(on[which].tolist(), count.tolist()))
                used[key] = used.get(key, 0) + times
        if before - int(left.sum()) < LEAST * before:
            level += 1
    return used, left, bound


def _fill(lengths: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration that opens with the largest piece left and fills best: the
    reachable sums of what is left, by dynamic programming."""
    out = np.zeros(len(lengths), dtype=np.int64)
    top = int(np.flatnonzero(left)[-1])
    out[top] = 1
    room = capacity - int(lengths[top])
    avail = left.copy()
    avail[top] -= 1
    fits = np.flatnonzero((avail > 0) & (lengths <= room))
    if not len(fits) or room <= 0:
        return out
    reach = np.full(room + 1, -1)  # length index that completes a sum
    reach[0] = len(lengths)
    for k in fits[::-1]:  # large pieces first
        size = int(lengths[k])
        for _ in range(int(min(avail[k], room // size))):
            new = np.flatnonzero((reach[:-size] >= 0) & (reach[size:] < 0)) if size <= room else []
            # sums already using k in this pass may use it again: at most avail[k] passes
            if not len(new):
                break
            reach[new + size] = k
        if reach[room] >= 0:
            break
    c = int(np.flatnonzero(reach >= 0)[-1])
    while c > 0:
        k = int(reach[c])
        out[k] += 1
        c -= int(lengths[k])
    if (out > left).any():  # a sum reused a piece too often: take best fit piece by piece
        out[:] = 0
        out[top] = 1
        room = capacity - int(lengths[top])
        for k in fits[::-1]:
            n = int(min(avail[k], room // int(lengths[k])))
            out[k] += n
            room -= n * int(lengths[k])
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(lengths, counts, repetitions) of configurations that hold the histogram exactly: the
    program's with best fit for its rest, or best fit alone where that takes fewer sequences."""
    full = histogram.get(capacity, 0)
    out = [(np.array([capacity]), np.array([1]), full)] if full else []
    lengths = np.array(sorted(x for x in histogram if x < capacity and histogram[x]), dtype=np.int64)
    if not len(lengths):
        return out
    demand = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)

    def filled(chosen: dict[tuple, int], left: np.ndarray) -> dict[tuple, int]:
        while left.any():
            config = _fill(lengths, left, capacity)
            on = np.flatnonzero(config)
            times = int((left[on] // config[on]).min())
            left = left - config * times
            key = tuple(zip(on.tolist(), config[on].tolist()))
            chosen[key] = chosen.get(key, 0) + times
        return chosen

    used, left, bound = program(lengths, demand, capacity)
    chosen = filled(used, left)
    if sum(chosen.values()) > np.ceil(bound - 1e-6):  # not known to be the fewest
        chosen = min(chosen, filled({}, demand), key=lambda x: sum(x.values()))
    for config, times in chosen.items():
        on, counts = np.array(config).T
        out.append((lengths[on], counts, times))
    return out


def slots(configs: list[tuple[np.ndarray, np.ndarray, int]]) -> list[tuple[int, ...]]:
    """(length, first rank, end rank, in each, first sequence, offset): ranks of a length
    that one configuration takes, ``in each`` of them a sequence from ``offset`` on."""
    rows, seen, sequence = [], {}, 0
    for lengths, counts, times in configs:
        offset = 0
        for size, n in zip(lengths.tolist(), counts.tolist()):
            first = seen.get(size, 0)
            rows.append((size, first, first + n * times, n, sequence, offset))
            seen[size] = first + n * times
            offset += n * size
        sequence += times
    return rows


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (pieces with ``length``, any other columns) with sequence_id and offset."""
    spark = cut.sparkSession
    keep = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    # checkpointed: the partition number then stays the same for every use
    held = materialize(cut.select(*keep).withColumn("_part", F.spark_partition_id())
                       .withColumn("_id", F.monotonically_increasing_id()))
    counts = materialize(held.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    rows = slots(plan(histogram, capacity))
    # one row for each length of a configuration: bounded by capacity and steps, and counted
    table = spark.createDataFrame(rows, "_l bigint, _first bigint, _end bigint, _each bigint, "
                                        "_seq bigint, _off bigint")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("_part").alias("_p"), F.col("length").alias("_pl"),
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_part", "length").orderBy("_id")
    ranked = (held.withColumn("_own", F.row_number().over(own) - 1)
              .join(base, (F.col("_part") == F.col("_p")) & (F.col("length") == F.col("_pl")))
              .withColumn("_rank", F.col("_base") + F.col("_own")))
    table = F.broadcast(table) if len(rows) <= BROADCAST_SLOTS else table
    met = ranked.join(table, (F.col("length") == F.col("_l"))
                      & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    within = F.col("_rank") - F.col("_first")
    return met.select(*keep, (F.col("_seq") + F.floor(within / F.col("_each"))).alias("sequence_id"),
                      (F.col("_off") + F.pmod(within, F.col("_each")) * F.col("length"))
                      .alias("offset"))


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences of placed pieces that carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("_parts")) \
        .select("sequence_id", F.aggregate("_parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
                .alias("ids"))


def pack(docs: DataFrame, path: str) -> DataFrame:
    """Digest form: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(pieces(docs, path, digest=True))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())
