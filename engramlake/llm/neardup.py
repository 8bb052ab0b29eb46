"""Near-duplicate records with small edits, by SetSketch registers.

A text is the multiset of its words; the n-th copy of a word is an element of its own, so that the
overlap of two texts is that of two sets. Each register of the sketch holds the maximum, over the
elements, of a truncated exponential on an exponentially spaced scale; sketches of parts merge by
maximum, and two registers agree about as often as the sets overlap. Bands of registers propose
pairs, the agreement of further registers estimates their overlap by likelihood, and what passes is
verified on the words themselves.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.functions.ids import canonical_id
from engramlake.session import checkpointed


@dataclass(frozen=True)
class NearDupConfig:
    min_words: int = 30
    #: Least share of the longer text's words that also stand in the other.
    overlap: float = 0.8
    bands: int = 48
    rows: int = 7
    #: Base of the exponential scale; near 1 registers agree as often as sets overlap.
    base: float = 1.02
    #: Largest register value (q + 1 of the sketch); a register takes twelve bits.
    levels: int = 4095
    #: Registers beside the bands from which a pair's overlap is estimated; four bits of each are kept.
    probes: int = 15
    #: Odds by which the likelihood must speak against the least overlap for a pair to be left out.
    against: float = 20.0
    #: Registers of the joint estimate, and the odds by which it must speak against the least overlap.
    estimated: int = 48
    strongly_against: float = 1e5
    seed: int = 20250101

    @property
    def least_jaccard(self) -> float:
        """Of two sets of one size with the least overlap."""
        return self.overlap / (2 - self.overlap)


_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Words in lower case; punctuation and blanks part them."""
    return _WORD.findall(unicodedata.normalize("NFC", text).lower().replace("_", " "))


def elements(words: list[str]) -> list[str]:
    """Each word with its occurrence number."""
    seen: dict[str, int] = {}
    out = []
    for w in words:
        k = seen[w] = seen.get(w, 0) + 1
        out.append(w if k == 1 else f"{w}\x00{k}")
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, a fixed public mixing function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def registers(hashes: np.ndarray, config: NearDupConfig, m: int) -> np.ndarray:
    """Register values of single elements, one row each: floor(1 - log_b x) of an exponential x, within 0..levels."""
    salt = _mixed(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(config.seed))
    out = np.empty((len(hashes), m), np.uint16)
    for start in range(0, len(hashes), 4096):
        u = (_mixed(hashes[start : start + 4096, None] ^ salt[None, :]) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) + 1e-300
        out[start : start + 4096] = np.clip(np.floor(1 - np.log(x) / math.log(config.base)) + 100, 0, config.levels)
    return out


def packed(values: np.ndarray) -> bytes:
    """Registers of twelve bits, two in three bytes; an odd number is filled up with a zero."""
    v = np.append(values, 0) if len(values) % 2 else values
    a, b = v[0::2].astype(np.uint32), v[1::2].astype(np.uint32)
    return np.stack([a >> 4, (a & 15) << 4 | b >> 8, b & 255], 1).astype(np.uint8).tobytes()


def unpacked(rows: list[bytes], n: int) -> np.ndarray:
    """The first n registers of each packed row."""
    x = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1, 3).astype(np.uint16)
    return np.stack([x[:, :, 0] << 4 | x[:, :, 1] >> 4, (x[:, :, 1] & 15) << 8 | x[:, :, 2]], 2).reshape(len(rows), -1)[:, :n]


class Sketcher:
    """Sketches of batches of texts; remembers the registers of elements it has met."""

    def __init__(self, config: NearDupConfig, remember: int = 60_000):
        self.config, self.remember = config, remember
        self.m = config.bands * config.rows + config.probes
        self.known: dict[int, int] = {}
        self.table = np.empty((remember + 65_536, self.m), np.uint16)

    def _rows(self, hashes: list[int]) -> list[int]:
        if len(self.known) > self.remember:
            self.known.clear()
        fresh = list(dict.fromkeys(h for h in hashes if h not in self.known))
        if len(self.known) + len(fresh) > len(self.table):
            self.known.clear()
            fresh = list(dict.fromkeys(hashes))
            if len(fresh) > len(self.table):
                self.table = np.empty((len(fresh), self.m), np.uint16)
        if fresh:
            at = len(self.known)
            self.table[at : at + len(fresh)] = registers(np.array(fresh, np.uint64), self.config, self.m)
            self.known.update(zip(fresh, range(at, at + len(fresh))))
        return [self.known[h] for h in hashes]

    def sketch(self, hashes: list[int]) -> np.ndarray:
        """Registers of a set; a long one is sketched in parts that merge by maximum."""
        parts = [self.table[self._rows(hashes[i : i + 50_000])].max(axis=0) for i in range(0, len(hashes), 50_000)]
        return parts[0] if len(parts) == 1 else np.max(parts, axis=0)

    def keys(self, sketch: np.ndarray) -> tuple[np.ndarray, int]:
        """(a key for each band, four bits of each probe)."""
        c = self.config
        banded = sketch[: c.bands * c.rows].reshape(c.bands, c.rows).astype(np.uint64)
        key = np.full(c.bands, 0x2545F4914F6CDD1D, np.uint64) + np.arange(c.bands, dtype=np.uint64)
        for j in range(c.rows):
            key = _mixed(key ^ banded[:, j] ^ (np.uint64(j + 1) << np.uint64(48)))
        probe = 0
        for v in sketch[c.bands * c.rows :]:
            probe = probe << 4 | int(v) & 15
        return key.view(np.int64), probe


_SKETCHED = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("text_class", T.BinaryType()), T.StructField("n_words", T.IntegerType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("probe", T.LongType()), T.StructField("wide", T.BinaryType()),
    T.StructField("bag", T.BinaryType()),
])


def sketched(texts: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """(id, text_class, n_words, bands, probe, wide, bag) of (id, text) with enough words.

    text_class: digest of the multiset, equal for texts that differ by case, punctuation, blanks or order
    only; wide: packed registers for the joint estimate; bag: sorted 32-bit hashes of the elements. Null, empty and short texts give no row. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(config)
        hashed: dict[str, int] = {}
        for batch in batches:
            ids, classes, sizes, bands, probes, wides, bags = [], [], [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text) if text else []
                if len(words) < config.min_words or i is None:
                    continue
                if len(hashed) > 300_000:
                    hashed.clear()
                hs = []
                for e in elements(words):
                    h = hashed.get(e)
                    if h is None:
                        h = hashed[e] = xxhash.xxh3_64_intdigest(e.encode("utf-8", "surrogatepass"))
                    hs.append(h)
                sketch = sketcher.sketch(hs)
                key, probe = sketcher.keys(sketch)
                every = np.sort(np.array(hs, np.uint64))
                ids.append(i)
                classes.append(hashlib.md5(every.tobytes()).digest())
                sizes.append(len(hs))
                bands.append(key)
                probes.append(probe)
                wides.append(packed(sketch[: config.estimated]))
                bags.append(np.sort((every & np.uint64(0xFFFFFFFF)).astype(np.uint32)).tobytes())
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, config.bands, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(classes, pa.binary()), pa.array(sizes, pa.int32()), lists, pa.array(probes, pa.int64()), pa.array(wides, pa.binary()), pa.array(bags, pa.binary())],
                names=[f.name for f in _SKETCHED],
            )

    return texts.select(F.col("id").cast("string"), "text").mapInArrow(run, _SKETCHED)


def _least_agreeing(config: NearDupConfig) -> int:
    """Least number of agreeing probes at which the likelihood of the least overlap is within the odds `against`
    of the best one."""
    n, p = config.probes, config.least_jaccard + (1 - config.least_jaccard) / 16
    for k in range(n + 1):
        best = (k / n) ** k * (1 - k / n) ** (n - k)
        if k / n >= p or p**k * (1 - p) ** (n - k) * config.against >= best:
            return k
    return n


def _agreeing(a, b):
    """Expression for the number of equal groups of four bits."""
    x = a.bitwiseXOR(b)
    some = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    return F.bit_count(some.bitwiseAND(F.lit(0x1111111111111111)))


def _handle():
    """The first 8 bytes of the digest as a number."""
    return F.conv(F.substring(F.hex("text_class"), 1, 16), 16, -10).cast("bigint")


def similar_classes(rows: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """Verified pairs (class_a, class_b), class_a < class_b, of different texts.

    rows: of `sketched`; copies of a text are reduced to one before anything is compared. A band value that very many texts share is
    joined in slices by Spark's skew handling; nothing is capped. A pair is compared on its words once. Nothing is broadcast:
    band keys, registers and words are joined by shuffles; the hints say so, as Spark takes the exploded keys for no larger than the rows they come from.
    """
    # 8 bytes of the digest stand for the text
    coded = rows.select(_handle().alias("c"), F.col("n_words").cast("int"), "probe", "bands", "wide")
    first = lambda *cs: coded.groupBy("c").agg(*[F.first(c).alias(c) for c in cs])
    short = first("n_words", "bands", "probe").select(F.explode("bands").alias("key"), "c", "n_words", "probe")
    differing = F.lit(config.probes) - _agreeing(F.col("x.probe"), F.col("y.probe"))
    near = (
        short.alias("x").join(short.alias("y").hint("merge"), "key")
        .where((F.col("x.c") < F.col("y.c")) & (F.least("x.n_words", "y.n_words") >= F.lit(config.overlap) * F.greatest("x.n_words", "y.n_words")))
        .where(differing >= _least_agreeing(config))
        .select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()
    )
    @F.pandas_udf(T.BooleanType())
    def verified(a, b):
        import pandas as pd

        return pd.Series([enough_in_common(x, y, config.overlap) for x, y in zip(a, b)], dtype=bool)

    @F.pandas_udf(T.BooleanType())
    def likely(a, b, n_a, n_b):
        import pandas as pd

        return pd.Series(near_by_likelihood(list(a), list(b), n_a.to_numpy(float), n_b.to_numpy(float), config), dtype=bool)

    wide = first("wide", "n_words")
    guessed = checkpointed(
        near.join(wide.toDF("a", "wa", "na").hint("merge"), "a").join(wide.toDF("b", "wb", "nb").hint("merge"), "b")
        .where(likely("wa", "wb", "na", "nb")).select("a", "b")
    )
    # only the words of texts in likely pairs are moved
    wanted = guessed.select(F.col("a").alias("c")).union(guessed.select("b")).distinct()
    held = rows.select(_handle().alias("c"), "text_class", "bag").join(wanted.hint("merge"), "c", "left_semi")
    bag = held.groupBy("c", "text_class").agg(F.first("bag").alias("bag"))
    both = guessed.join(bag.toDF("a", "ta", "ba").hint("merge"), "a").join(bag.toDF("b", "tb", "bb").hint("merge"), "b")
    return both.where(verified("ba", "bb")).select(F.least("ta", "tb").alias("class_a"), F.greatest("ta", "tb").alias("class_b"))


def near_by_likelihood(a: list[bytes], b: list[bytes], n_a: np.ndarray, n_b: np.ndarray, config: NearDupConfig) -> np.ndarray:
    """Whether the least overlap is likely enough, by the joint likelihood of which registers are equal, larger in
    the one or larger in the other, given both sizes."""
    if not a:
        return np.zeros(0, bool)
    x, y = (unpacked(v, config.estimated) for v in (a, b))
    equal, more = (x == y).sum(1), (x > y).sum(1)
    less = x.shape[1] - equal - more
    both = n_a + n_b
    floor = config.overlap * np.maximum(n_a, n_b)
    least = floor / (both - floor)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    tie = 1 - 1 / config.base

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        union = both / (1 + j)
        common = j * union
        p_more, p_less = np.maximum(n_a - common, 1e-3) / union, np.maximum(n_b - common, 1e-3) / union
        return equal * np.log(j + tie * (1 - j)) + more * np.log(p_more * (1 - tie) + 1e-9) + less * np.log(p_less * (1 - tie) + 1e-9)

    best = np.max([log_likelihood(g * most) for g in np.linspace(0.02, 1, 50)], axis=0)
    near = np.max([log_likelihood(least + g * np.maximum(most - least, 0)) for g in np.linspace(0, 1, 20)], axis=0)
    return near >= best - math.log(config.strongly_against)


def enough_in_common(a: bytes, b: bytes, overlap: float) -> bool:
    """Whether at least the share `overlap` of the longer bag stands in the other."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return common >= overlap * max(len(x), len(y)) - 1e-9


def memory_texts(memories: DataFrame) -> DataFrame:
    """(id, text) of the memories of kind Text; other kinds, null and broken content give no row."""
    return memories.select(canonical_id(F.col("id")).alias("id"), F.from_json("content_json", "Text string").getField("Text").alias("text")).where("text is not null and id is not null")


def near_duplicates(texts: DataFrame, config: NearDupConfig = NearDupConfig()) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (id, text_class) of every text with enough words, and verified pairs of classes.

    Copies of one text are one class and are never compared with one another. Rows delivered twice count once.
    """
    rows = checkpointed(sketched(texts, config))
    members = rows.select("id", "text_class").distinct()
    return members, similar_classes(rows, config)


def duplicate_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of near-duplicate or equal texts."""
    a, b = members.toDF("id_a", "class_a").hint("merge"), members.toDF("id_b", "class_b").hint("merge")
    near = pairs.join(a, "class_a").join(b, "class_b").where("id_a <> id_b")
    equal = a.join(b, F.col("class_a") == F.col("class_b")).where("id_a < id_b")
    return near.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).union(equal.select("id_a", "id_b")).distinct()


def duplicate_report(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, text_class, copies, links) of every text: how many ids have the same words, and how many other classes are near."""
    links = pairs.union(pairs.select("class_b", "class_a")).toDF("text_class", "other").groupBy("text_class").agg(F.count("*").alias("links"))
    copies = members.groupBy("text_class").agg(F.count("*").alias("copies"))
    return members.join(copies.hint("merge"), "text_class").join(links.hint("merge"), "text_class", "left").select(
        "id", F.lower(F.hex("text_class")).alias("text_class"), "copies", F.coalesce("links", F.lit(0)).alias("links")
    )
