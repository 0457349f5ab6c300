"""Phrase collocations counted by double-array tries.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces and those at spaces
and tabs into words. Everything is counted for each language (null: ``und``):

1. blocks: every task writes its words as numbers of a dictionary of the block's own, so a
   token is looked up once and all later passes are array work. Blocks are checkpointed;
2. for each length of 2 to 4 words, a position is safe if both of its shorter parts are frequent
   (Apriori); that is read from bitmaps of hashed frequent phrases, of fixed size and without misses.
   Every block's hashes at safe positions, with their counts, are dealt to parts that add them up; a phrase
   whose hash stays below the support can't be frequent. The distinct phrases that are left at safe
   positions are the candidates;
3. every block lists its candidates once, with its counts, to shards of about ``SHARD`` phrases that the hash
   chooses. A shard's task builds the double-array trie of its phrases; all listed phrases advance
   through it together, one word a level, and the counts of accepting states are added by ``bincount``;
4. scores, the removal of phrases inside longer ones and the ranking are joins and aggregates over
   the frequent phrases, in exact integers.

The blocks are read twice a length, however many candidates there are: more of them make more parts and
shards, not more passes or larger ones. What is broadcast has a fixed bound: four bitmaps of
2 ** ``MAX_BITS`` bits. A language's phrases are ranked by a
window that Spark limits to the first ranks in every task before the shuffle.

Defined results: null and empty texts have no words; repeated rows count again; equal scores go by
frequency, then by the phrase's bytes; a text of any length is read in slices, so one long
piece crosses slices unharmed; an empty table gives an empty result; other columns, whatever their
names, are left behind.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qamill.llm.common import table
from qamill.session import materialize

SUPPORT = 30
LONGEST = 4
COVER = 80     # percent of a phrase's occurrences inside one longer phrase that remove it
TOP = 2000
UNDETERMINED = "und"
#: Tokens of a block, bytes of a slice of text.
BLOCK = 5_000_000
SLICE = 1 << 20
#: Words for each part that hashed counts are dealt to, listed phrases for each shard.
PART_WORDS = 2_000_000
SHARD_ROWS = 1_000_000
#: Phrases in a trie.
SHARD = 100_000
#: Bits of a bitmap: one for every two words, within these powers of two. Bits of a counted hash.
MIN_BITS, MAX_BITS = 16, 26
HASH_BITS = 40
CHUNK = 1 << 16
#: Listed phrases that advance through a trie together.
STEP = 1 << 19

# Bytes that end a piece become ".", a tab a space, A-Z a-z.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(_BREAKS + b"\t" + bytes(range(65, 91)), b"." * len(_BREAKS) + b" " + bytes(range(97, 123)))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> Iterator[list[bytes]]:
    """Words of a text in slices, ``b"."`` between pieces and at the end."""
    raw = text.encode("utf-8").translate(_FOLD)
    at = 0
    while at < len(raw):
        stop = at + SLICE
        if stop < len(raw):  # after the next separator
            ends = [e for e in (raw.find(b" ", stop), raw.find(b".", stop)) if e >= 0]
            stop = min(ends) + 1 if ends else len(raw)
        yield raw[at:stop].replace(b".", b" . ").split()
        at = stop
    yield [b"."]


def blocks(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = BLOCK) -> DataFrame:
    """(lang, words, ids): the words of many texts as numbers of the block's dictionary;
    number 0 ends a piece. ``words`` are joined by spaces, ``ids`` are compressed 32-bit numbers."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = _packers()[0]
        held: dict[str, tuple[defaultdict, list[np.ndarray]]] = {}
        total = 0

        def out() -> pd.DataFrame:
            rows = [(name, b" ".join(known), pack(np.concatenate(parts).tobytes()))
                    for name, (known, parts) in held.items()]
            return pd.DataFrame(rows, columns=["lang", "words", "ids"])

        for b in batches:
            for name, content in zip(b["_lang"].tolist(), b["_text"].tolist()):
                if not content:
                    continue
                if name not in held:
                    known: defaultdict = defaultdict()
                    known.default_factory = known.__len__
                    known[b"."]  # number 0
                    held[name] = known, []
                known, parts = held[name]
                for words in words_of(content):
                    parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                    total += len(words)
                if total >= size:
                    yield out()
                    held.clear()
                    total = 0
        if held:
            yield out()

    sent = docs.select(F.coalesce(F.col(lang), F.lit(UNDETERMINED)).alias("_lang"),
                       F.col(text).alias("_text"))
    return sent.mapInPandas(run, "lang string, words binary, ids binary")


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(lang, words, ids) of each block."""
    unpack = _packers()[1]
    for b in batches:
        for name, words, ids in zip(b["lang"].tolist(), b["words"].tolist(), b["ids"].tolist()):
            yield name, bytes(words).split(b" "), np.frombuffer(unpack(bytes(ids)), np.int32)


def _rows(lang: str, phrases: list[str], **more: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"lang": pd.Series([lang] * len(phrases), dtype=object),
                         "phrase": pd.Series(phrases, dtype=object)} | more)


def word_counts(held: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, words, ids in _opened(batches):
            n = np.bincount(ids, minlength=len(words))
            yield _rows(name, [w.decode() for w in words[1:]], f=n[1:])

    return held.mapInPandas(run, "lang string, phrase string, f bigint") \
        .groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


# --- hashes, bitmaps and saturated counts -------------------------------------------------

def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest
    seed = xxh64_intdigest(lang.encode())
    return np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _joined(left: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all words but the last and that of the last."""
    return left * _MIX + last


def _buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(31))) * _MIX
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _bitmap(parts: DataFrame, support: int) -> dict[int, bytes]:
    """Bits of the buckets that reach the support: chunks of saturated counts (``chunk``, ``n``)
    are added up as they stream by, and one bit a bucket comes to the driver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, unpack = _packers()
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, n in zip(b["chunk"].tolist(), b["n"].tolist()):
                n = np.frombuffer(unpack(bytes(n)), np.uint8).astype(np.uint16)
                sums[chunk] = np.minimum(sums[chunk] + n, support) if chunk in sums else n
        rows = [(c, pack(np.packbits(n >= support).tobytes())) for c, n in sums.items() if n.max() >= support]
        yield pd.DataFrame(rows, columns=["chunk", "n"])

    rows = parts.repartition("chunk").mapInPandas(run, "chunk int, n binary").collect()
    return {r[0]: bytes(r[1]) for r in rows}


def opened_bitmap(packed: dict[int, bytes], bits: int) -> np.ndarray:
    """One bit a bucket from its compressed chunks, which is how a bitmap is kept and sent."""
    unpack, size = _packers()[1], CHUNK // 8
    out = np.zeros((1 << bits) // 8, np.uint8)
    for chunk, part in packed.items():
        out[chunk * size:(chunk + 1) * size] = np.frombuffer(unpack(part), np.uint8)
    return out


def _test(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _packers():
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def _chunks(counts: np.ndarray) -> pd.DataFrame:
    """Non-zero chunks of a task's array."""
    pack = _packers()[0]
    rows = [(k, pack(part.tobytes())) for k, part in enumerate(counts.reshape(-1, CHUNK)) if part.any()]
    return pd.DataFrame(rows, columns=["chunk", "n"])


def frequent_bitmap(frequent: DataFrame, bits: int, support: int, parts: int = 8) -> dict[int, bytes]:
    """Bits of the hashed phrases of ``frequent`` (lang, phrase), by few tasks: each has a whole array."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << bits, np.uint8)
        for b in batches:
            for name, part in b.groupby("lang"):
                words = [p.encode().split(b" ") for p in part["phrase"].tolist()]
                columns = [_word_hashes(name, list(c)) for c in zip(*words)]
                h = columns[0]
                for last in columns[1:]:
                    h = _joined(h, last)
                counts[_buckets(h, bits)] = support
        yield _chunks(counts)

    some = frequent.select("lang", "phrase").coalesce(max(8, parts // 8))
    return _bitmap(some.mapInPandas(run, "chunk int, n binary"), support)


def _safe(name: str, words: list[bytes], ids: np.ndarray, maps: list[np.ndarray], bits: int) \
        -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the phrases one word longer than the maps reach, whose
    both parts are in the last map; no phrase crosses a piece's end."""
    w = _word_hashes(name, words)
    hit = _test(maps[0], _buckets(w, bits))
    hit[0] = False
    own = w[ids]
    on, h = hit[ids], own
    for k, bitmap in enumerate(maps[1:], 1):
        on, h = on[:-1] & on[1:], _joined(h[:-1], own[k:])
        on[on] = _test(bitmap, _buckets(h[on], bits))
    at = np.flatnonzero(on[:-1] & on[1:])
    return at, _joined(h[at], own[at + len(maps)])


def _planes(numbers: np.ndarray) -> bytes:
    """Compressed numbers, their first bytes first: the higher bytes are mostly zero."""
    size = numbers.itemsize
    return _packers()[0](numbers.view(np.uint8).reshape(-1, size).T.tobytes())


def _of_planes(packed: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(_packers()[1](bytes(packed)), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _grouped(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): an order that sorts the codes, and where in it each distinct one starts."""
    order = np.argsort(codes)
    ordered = codes[order]
    return order, np.flatnonzero(np.diff(ordered, prepend=ordered[:1] - 1))


def _distinct(columns: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts) of the rows of word numbers below ``size``."""
    codes, room = columns[0].astype(np.int64), size
    for column in columns[1:]:
        if room > (1 << 62) // size:  # numbers of the distinct rows so far
            known, codes = np.unique(codes, return_inverse=True)
            room = len(known)
        codes, room = codes * size + column, room * size
    return _grouped(codes)


def _dealt(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash: equal ranges in ascending order."""
    return _buckets(hashes, HASH_BITS) * parts >> HASH_BITS


def hashed_counts(held: DataFrame, maps: list[dict[int, bytes]], bits: int, support: int, parts: int) \
        -> tuple[dict[int, bytes], int, int]:
    """(bitmap, phrases, rows): the buckets of the hashes of len(maps) + 1 words that reach the support at
    safe positions, how many hashes do, and how many distinct phrases the blocks have in those buckets."""
    sc, spare = held.sparkSession.sparkContext, HASH_BITS - bits
    shared = sc.broadcast(maps)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [opened_bitmap(x, bits) for x in shared.value]
        for name, words, ids in _opened(batches):
            keys, n = np.unique(_buckets(_safe(name, words, ids, known, bits)[1], HASH_BITS), return_counts=True)
            n = np.minimum(n, support).astype(np.int32)
            ends = np.searchsorted(keys * parts >> HASH_BITS, np.arange(parts + 1))
            rows = [(k, _planes(np.diff(keys[i:j], prepend=0)), _planes(n[i:j]))
                    for k, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if i < j]
            yield pd.DataFrame(rows, columns=["part", "keys", "n"])

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, keys, counts = _packers()[0], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for b in batches:
            keys += [np.cumsum(_of_planes(x, np.int64)) for x in b["keys"].tolist()]
            counts += [_of_planes(x, np.int32) for x in b["n"].tolist()]
        key, n = np.concatenate(keys), np.concatenate(counts)
        keys.clear()
        counts.clear()
        order, starts = _grouped(key)
        if not len(starts):
            return
        key, blocks = key[order[starts]], np.diff(starts, append=len(order))
        enough = np.add.reduceat(n[order], starts, dtype=np.int64) >= support
        hit = np.unique(key[enough] >> spare)
        rows = [(-1, b"", int(np.count_nonzero(enough)), int(blocks[np.isin(key >> spare, hit)].sum()))]
        for chunk in np.unique(hit // CHUNK).tolist():
            flags = np.zeros(CHUNK, np.uint8)
            flags[hit[hit // CHUNK == chunk] % CHUNK] = 1
            rows.append((chunk, pack(np.packbits(flags).tobytes()), 0, 0))
        yield pd.DataFrame(rows, columns=["chunk", "n", "phrases", "rows"])

    sent = held.mapInPandas(tally, "part int, keys binary, n binary").repartitionById(parts, "part")
    out, phrases, rows = {}, 0, 0
    pack, unpack = _packers()
    for chunk, n, some, more in sent.mapInPandas(add_up, "chunk int, n binary, phrases bigint, rows bigint").collect():
        phrases, rows = phrases + some, rows + more
        if chunk in out:  # parts that share a chunk
            out[chunk] = pack((np.frombuffer(unpack(out[chunk]), np.uint8) | np.frombuffer(unpack(bytes(n)), np.uint8)).tobytes())
        elif chunk >= 0:
            out[chunk] = bytes(n)
    shared.unpersist()
    return out, phrases, rows


def candidates(held: DataFrame, shared: Broadcast, m: int, bits: int, shards: int) -> DataFrame:
    """(lang, shard, words, rows, n): the distinct phrases of ``m`` words at each block's safe positions whose
    bucket is reached, as rows of numbers of ``words``, and how often the block has them. ``shared``: the
    maps, that of the buckets last."""
    def list_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        *known, hit = [opened_bitmap(x, bits) for x in shared.value]
        for name, words, ids in _opened(batches):
            at, h = _safe(name, words, ids, known, bits)
            on = _test(hit, _buckets(h, bits))
            at, h = at[on], h[on]
            order, starts = _distinct([ids[at + k] for k in range(m)], len(words))
            first, n = order[starts], np.diff(starts, append=len(order)).astype(np.int32)
            shard = _dealt(h[first], shards)
            by = np.argsort(shard, kind="stable")
            first, n = at[first[by]], n[by]
            ends = np.searchsorted(shard[by], np.arange(shards + 1))
            rows = []
            for k, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                if i < j:
                    used, own = np.unique(ids[first[i:j] + np.arange(m)[:, None]], return_inverse=True)
                    rows.append((name, k, b" ".join([words[w] for w in used.tolist()]),
                                 _planes(own.astype(np.int32).ravel()), _planes(n[i:j])))
            yield pd.DataFrame(rows, columns=["lang", "shard", "words", "rows", "n"])

    return held.mapInPandas(list_up, "lang string, shard int, words binary, rows binary, n binary")


# --- the double-array trie -------------------------------------------------------------------

class DoubleArray:
    """Phrases of equal length as a double-array trie. A word is two digits, so that a node's
    children lie within one short window: from state s, digit d leads to t = base[s] + d
    if check[t] == s. State 0 is dead; ``accept[s]`` numbers the phrase of a final state."""

    def __init__(self, phrases: np.ndarray, n_words: int) -> None:
        """``phrases``: distinct rows of word numbers from 1 to ``n_words``."""
        count, self.length = phrases.shape
        self.digits = int(np.sqrt(n_words)) + 1
        node, levels = np.zeros(count, np.int64), []
        for d in range(2 * self.length):  # nodes of each level: distinct prefixes
            digit = phrases[:, d // 2] // self.digits if d % 2 == 0 else phrases[:, d // 2] % self.digits
            codes, node = np.unique(node * self.digits + digit, return_inverse=True)
            levels.append((codes // self.digits, codes % self.digits))
        # slot 0 is the dead state, whose digits lead to slots that nothing owns; then the root
        self.root, end = self.digits, self.digits + 1
        room = 2 * end + 2 * sum(len(p) for p, _ in levels)
        base, check, taken = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.zeros(room, bool)
        taken[:end] = True
        rng = np.random.default_rng(5)
        owners = np.array([self.root])
        for parent, digit in levels:
            starts = np.searchsorted(parent, np.arange(len(owners) + 1))
            many = np.diff(starts)
            states = np.zeros(len(parent), np.int64)
            order = np.argsort(-many, kind="stable")
            for k in order[:np.count_nonzero(many > 1)].tolist():  # the largest first
                own = digit[starts[k]:starts[k + 1]]
                tried = rng.integers(1, end, 16)
                fits = np.flatnonzero(~taken[tried[:, None] + own].any(axis=1))
                at = (tried[fits[0]] if len(fits) else end - own[0]) + own  # in a gap or behind the end
                end = max(end, int(at[-1]) + 1)
                if end + self.digits >= room:
                    base, check, taken = (np.concatenate([x, np.full(room, v, x.dtype)])
                                          for x, v in ((base, 0), (check, -1), (taken, False)))
                    room *= 2
                taken[at] = True
                base[owners[k]], check[at] = at[0] - own[0], owners[k]
                states[starts[k]:starts[k + 1]] = at
            single = np.flatnonzero(many == 1)
            gaps = np.flatnonzero(~taken[:end])[:len(single)]
            free = np.concatenate([gaps, np.arange(end, end + len(single) - len(gaps))])
            if len(free) and free[-1] + 1 + self.digits >= room:
                more = len(free)
                base, check, taken = (np.concatenate([x, np.full(more, v, x.dtype)])
                                      for x, v in ((base, 0), (check, -1), (taken, False)))
                room += more
            own = starts[:-1][single]
            base[owners[single]], check[free] = free - digit[own], owners[single]
            taken[free] = True
            end = max(end, int(free[-1]) + 1) if len(free) else end
            states[own] = free
            owners = states
        # a base may lead a digit beyond the last slot
        self.base, self.check = base[:end + self.digits], check[:end + self.digits]
        self.accept = np.full(len(self.check), -1, np.int32)
        self.accept[owners[node]] = np.arange(count)
        self.count_of = count

    def count(self, words: np.ndarray, at: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
        """Occurrences of each phrase among word numbers (0: a word of no phrase), overlaps
        included: the states of all positions advance together, one level at a time. ``at``: only the
        phrases that start there, each so many ``times``."""
        if at is None:
            at = np.flatnonzero(words[:max(len(words) - self.length + 1, 0)])
        state = np.full(len(at), self.root, np.int32)
        for d in range(self.length):
            word = words[at + d]
            then = self.base[state] + word // self.digits
            on = (self.check[then] == state) & (word > 0)
            at, state, word, times = at[on], then[on], word[on], times if times is None else times[on]
            then = self.base[state] + word % self.digits
            on = self.check[then] == state
            at, state, times = at[on], then[on], times if times is None else times[on]
        # sums of weights are floats, exact below 2 ** 53
        return np.bincount(self.accept[state], times, self.count_of).astype(np.int64)


def _counted(listed: pd.DataFrame, m: int, support: int) -> pd.DataFrame:
    """lang, phrase, f of a shard's listed phrases of ``m`` words that reach the support."""
    out = []
    for name, part in listed.groupby("lang"):
        known: defaultdict = defaultdict()
        known.default_factory = lambda known=known: len(known) + 1  # number 0 is no word
        lists, times = [], []
        for words, rows, n in zip(part["words"].tolist(), part["rows"].tolist(), part["n"].tolist()):
            own = np.array([known[w] for w in bytes(words).split(b" ")], np.int32)
            lists.append(own[_of_planes(rows, np.int32)].reshape(m, -1))
            times.append(_of_planes(n, np.int32))
        rows, n = np.concatenate(lists, axis=1), np.concatenate(times)
        order, starts = _distinct(list(rows), len(known) + 1)
        phrases, rows = rows[:, order[starts]].T, rows.T.ravel()
        f = np.zeros(len(phrases), np.int64)
        trie = DoubleArray(phrases, len(known))
        for k in range(0, len(n), STEP):
            times = n[k:k + STEP]
            f += trie.count(rows, np.arange(k, k + len(times)) * m, times)
        on, names = f >= support, [b"", *known]
        out.append(_rows(name, [b" ".join([names[j] for j in row]).decode() for row in phrases[on].tolist()], f=f[on]))
    return pd.concat(out)


def trie_counts(held: DataFrame, maps: list[dict[int, bytes]], bits: int, support: int, parts: int,
                shard: int = SHARD) -> DataFrame:
    """(lang, phrase, f) of the phrases of len(maps) + 1 words that reach the support. A phrase's hash chooses its
    shard, where a task counts all that the blocks list of it."""
    reached, phrases, rows = hashed_counts(held, maps, bits, support, parts)
    m, shards = len(maps) + 1, max(8, -(-phrases // shard), -(-rows // SHARD_ROWS))
    shared = held.sparkSession.sparkContext.broadcast([*maps, reached])

    def run(listed: pd.DataFrame) -> pd.DataFrame:
        return _counted(listed, m, support)

    listed = candidates(held, shared, m, bits, shards).repartitionById(shards, "shard")
    out = materialize(listed.groupBy("shard").applyInPandas(run, "lang string, phrase string, f bigint"))
    shared.unpersist()
    return out


# --- scores ------------------------------------------------------------------------------------

def frequent_phrases(held: DataFrame, words: DataFrame, n_words: int, longest: int = LONGEST,
                     support: int = SUPPORT, shard: int = SHARD) -> list[DataFrame]:
    """(lang, phrase, f) of the frequent phrases of 1, 2, ... ``longest`` words."""
    bits = min(MAX_BITS, max(MIN_BITS, (n_words // 2).bit_length()))
    parts = max(8, n_words // PART_WORDS)
    found = [words.where(F.col("f") >= support)]
    maps: list[dict[int, bytes]] = []
    for _ in range(1, longest):
        maps.append(frequent_bitmap(found[-1], bits, support, parts))
        found.append(trie_counts(held, maps, bits, support, parts, shard))
    return found


def scored(found: list[DataFrame], cover: int = COVER) -> DataFrame:
    """lang, phrase, a, l, r, score of the frequent phrases of two words and more that no longer
    one covers."""
    parts = None
    for m, level in enumerate(found, 1):
        one = level.select("lang", "phrase", "f", F.lit(m).alias("_m"))
        parts = one if parts is None else parts.unionByName(one)
    split = F.split("phrase", " ")
    long = parts.where("_m > 1").select("lang", "phrase", F.col("f").alias("a"), "_m", split.alias("_w"))

    cuts = long.select("lang", "phrase", "a", "_w", F.explode(F.sequence(F.lit(1), F.col("_m") - 1)).alias("_k"))
    cuts = cuts.select("lang", "phrase", "a", "_k", F.array_join(F.slice("_w", F.lit(1), F.col("_k")), " ").alias("_left"),
                       F.array_join(F.slice("_w", F.col("_k") + 1, F.size("_w") - F.col("_k")), " ").alias("_right"))
    for side, name in (("_left", "l"), ("_right", "r")):
        other = parts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(name))
        cuts = cuts.join(other, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_part"))) \
            .drop("_lang", "_part")
    wide = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", wide).groupBy("lang", "phrase", "a") \
        .agg(F.min(F.struct("score", "_k", "l", "r")).alias("_b"))

    # contiguous parts of two words or more of every longer phrase
    inner = long.where("_m > 2").select(
        "lang", "a", "_w", F.explode(F.expr("filter(flatten(transform(sequence(1, _m - 1), s -> transform("
                                            "sequence(2, _m - 1), n -> struct(s, n)))), p -> p.s + p.n <= _m + 1)"))
        .alias("_p"))
    inner = inner.select(F.col("lang").alias("_lang"), F.array_join(F.slice("_w", F.col("_p.s"), F.col("_p.n")), " ")
                         .alias("_part"), F.col("a").alias("_f")) \
        .groupBy("_lang", "_part").agg(F.max("_f").alias("_f"))
    kept = best.join(inner, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_part")), "left") \
        .where(F.expr(f"_f is null or cast(_f as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {int(cover)}"))
    return kept.select("lang", "phrase", "a", F.col("_b.l").alias("l"), F.col("_b.r").alias("r"),
                       F.col("_b.score").alias("score"))


def collocations(docs: DataFrame, top: int = TOP, support: int = SUPPORT, longest: int = LONGEST,
                 cover: int = COVER, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    held = materialize(blocks(docs, size=block))
    words = materialize(word_counts(held))
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = words.agg(F.sum("f")).first()[0] or 0
    found = frequent_phrases(held, words, total, longest, support, shard)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(found, cover).withColumn("rank", F.row_number().over(order).cast("bigint")) \
        .where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: phrases of all documents."""
    return collocations(table(spark, sf_dir, "documents", "lang", "text"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM words, range(1, 5) AS lengths(m), LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)),
counted AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE m > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r,
         (2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cand c, range(1, 4) AS cut(k), counted x, counted y
  WHERE k < c.m AND x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
    AND y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[s:s + n - 1], ' ') AS phrase, max(a) AS f
  FROM cand, range(1, 4) AS starts(s), range(2, 4) AS sizes2(n)
  WHERE n < m AND s + n <= m + 1 GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.f IS NULL OR 100::HUGEINT * i.f < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, s.n, r.score
FROM ranked r JOIN sizes s ON s.lang = r.lang WHERE r.rank <= 2000
"""
