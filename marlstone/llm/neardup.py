"""Near-duplicate records with small edits: pigeonring filtering (problem 3).

A record is the set of its q-character substrings. Its code has K = 384
positions, a minimum of hashes each; two records differ in about (1 - J) K of
them. The positions form a ring of 64 segments. Records that agree in a
whole segment are candidates, and the ring is followed from there: the code's
bits of the next segments must differ by no more than each prefix's
share of the budget, or the pair is dropped inside the
join, before anything is written. What is left passes the full Hamming check
over all bits and then the exact comparison of the sets, so no wrong pair
comes out.

Hot segments: what over HOT records share (boilerplate) is not joined in the
ring, whose bits tell little between records that have half of their text in
common. Records that share a hot segment are all compared with each other by
the parities of their sets' hashes: these differ in no more places than the
sets do, so no pair that is similar is lost there, whatever else it agrees in.
Segments that mostly occur together make one crowd, so a record stands in few
of them; crowds are cut by size and into blocks, each pair of which is compared
by itself.

Loss: a pair of similarity J agrees in no segment with probability
(1 - J^6)^64, 0.0003 at J = 0.7. The budget of the whole ring is five deviations
wide, that of a prefix three. (An exact pigeonhole bound would need more segments than
the 115 positions a pair at J = 0.7 differs in, two or three positions each:
segments that any two records of one language share.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.runtime import cut, shuffled

SEGMENTS, ROWS = 64, 6
K = SEGMENTS * ROWS
#: One-permutation passes of BINS minima each make the K positions.
BINS = 32
PASSES = K // BINS
CHAIN = 10
_DEVIATIONS = 5.0
_PREFIX_DEVIATIONS = 3.0
#: Records that may share a segment and still be joined in the ring; what more share is compared by sketches.
HOT = 1_024
#: Rows of a block of sketches, and bits of a sketch: two for each member of the set, within these bounds.
BLOCK = 2_048
_BITS = (1 << 9, 1 << 15)
#: White space as Python's \s has it.
_SPACE = "\\t-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def normalised(text: Column) -> Column:
    """Lower case, stripped, every run of white space one blank."""
    one = F.regexp_replace(F.lower(text), f" [ {_SPACE}]+|[{_SPACE}][ {_SPACE}]*", " ")  # single blanks stay as they are
    return F.trim(one)


def budget(least: float, bits: int) -> float:
    """Bits of `bits` that a pair of similarity `least` may differ in: mean and five deviations over the whole ring, in proportion."""
    p = (1 - least) / 2
    return (p * K + _DEVIATIONS * (p * (1 - p) * K) ** 0.5) * bits / K


def _share(least: float, bits: int) -> int:
    """Bits of a prefix of `bits` that a pair of similarity `least` may differ in: mean and three deviations."""
    p = (1 - least) / 2
    return int(p * bits + _PREFIX_DEVIATIONS * (p * (1 - p) * bits) ** 0.5)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Windows that are hashed at once; longer texts go through in several parts.
_WINDOW = 1 << 19


def _window_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    h = np.zeros(len(chars) - q + 1, np.uint64)
    for i in range(q):
        h = h * np.uint64(0x100000001B3) + chars[i : i + len(h)] + np.uint64(1)
    return _mix(h)


def _minima(texts: list[str], q: int) -> np.ndarray:
    """n x PASSES x BINS minima; all ones in empty bins."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    table = np.full((PASSES, len(texts) * BINS), full)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    for i in range(0, len(chars) - q + 1, _WINDOW):
        h = _window_hashes(chars[i : i + _WINDOW + q - 1].astype(np.uint64), q)
        at = np.arange(i, i + len(h))
        owner = np.searchsorted(ends, at, side="right")
        inside = at + q <= ends[owner]
        h, owner = h[inside], owner[inside] * BINS
        for p in range(PASSES):
            g = _mix(h + np.uint64((p + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            np.minimum.at(table[p], owner + (g >> np.uint64(59)).astype(np.int64), g & np.uint64((1 << 59) - 1))
    return table.reshape(PASSES, len(texts), BINS).transpose(1, 0, 2)


def codes(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment hashes n x 64, chain bits n x 64, code bits n x 6) of texts of at least q characters."""
    n, full, bins = len(texts), np.uint64(0xFFFFFFFFFFFFFFFF), np.arange(BINS)
    with np.errstate(over="ignore"):
        part = _minima(texts, q)
        filled, t = part.copy(), 0
        while (todo := filled == full).any():  # an empty bin borrows from bins in an order of its own
            t += 1
            for p in range(PASSES):
                src = (_mix(np.uint64(p * 7919 + t * 104729) + bins.astype(np.uint64) * np.uint64(31)) % np.uint64(BINS)).astype(np.int64)
                lent = part[:, p, src]
                use = todo[:, p] & (lent != full)
                filled[:, p][use] = _mix(lent + np.uint64(t))[use] & np.uint64((1 << 59) - 1)
        ring = filled.reshape(n, ROWS, SEGMENTS).transpose(0, 2, 1)  # a segment's rows come from passes apart
        seg = np.full((n, SEGMENTS), 0x51ED270B0F1B3A5D, np.uint64) + np.arange(SEGMENTS, dtype=np.uint64)
        for j in range(ROWS):
            seg = _mix(seg ^ ring[:, :, j]) + np.uint64(j)
        bit = _mix(ring) & np.uint64(1)  # n x 64 x 6
        small = np.zeros((n, SEGMENTS), np.uint64)
        for j in range(ROWS):
            small |= bit[:, :, j] << np.uint64(j)
        chain = np.zeros((n, SEGMENTS), np.uint64)
        for s in range(1, CHAIN + 1):
            chain |= np.roll(small, -s, axis=1) << np.uint64(ROWS * (s - 1))
        flat = bit.reshape(n, K)
        words = np.zeros((n, K // 64), np.uint64)
        for j in range(64):
            words |= flat[:, j::64] << np.uint64(j)
    return seg.view(np.int64), chain.view(np.int64), words.view(np.int64)


def _encode(q: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for big in batches:
            size = big["text"].str.len().cumsum()
            for _, b in big.groupby([size // (4 * _WINDOW), np.arange(len(big)) // 512], sort=False):
                seg, chain, words = codes(b["text"].tolist(), q)
                yield pd.DataFrame({"rep": b["rep"].to_numpy(), "seg": list(seg), "chain": list(chain), "code": list(words)})

    return run


def _gram_numbers(x: str, y: str, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of q-character substrings of two texts as numbers, equal for equal substrings; exact at any length.

    Characters are numbered over both texts and substrings are read as numbers
    to that base; where one would pass 63 bits, those so far are numbered anew.
    """
    both = np.frombuffer((x + y).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, chars = np.unique(both, return_inverse=True)
    chars, base = chars.astype(np.int64), max(2, len(alphabet))
    n = len(both) - q + 1
    code, bound = np.zeros(n, np.int64), 1
    for i in range(q):
        if bound * base >= 1 << 63:
            seen, code = np.unique(code, return_inverse=True)
            bound = len(seen)
        code = code * base + chars[i : i + n]
        bound *= base
    return np.unique(code[: len(x) - q + 1]), np.unique(code[len(x) :])


def _exact(q: int, least: float):
    def overlap(x: str, y: str) -> float:
        s, t = _gram_numbers(x, y, q)
        both = len(np.intersect1d(s, t, assume_unique=True))
        return both / (len(s) + len(t) - both)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sim = np.array([overlap(x, y) for x, y in zip(b["text_a"], b["text_b"])])
            ok = sim >= least
            yield pd.DataFrame({"rep_a": b["rep_a"][ok], "rep_b": b["rep_b"][ok], "similarity": sim[ok]})

    return run


def _step(least: float) -> float:
    """Sizes of similar sets are less than this factor apart."""
    return max(1.2, 1 / max(least, 1e-6)) * (1 + 1e-9)


def _sketch(q: int, least: float):
    """Rows (rep, level, size, sketch): the size of the set, its power of `_step`, and the parities of its hashes by their last bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = _step(least)
        for b in batches:
            rows = []
            for rep, text in zip(b["rep"], b["text"]):
                size = len(_gram_numbers(text, "", q)[0])
                level = int(math.log(size, step))
                bits = min(_BITS[1], max(_BITS[0], 1 << math.ceil(math.log2(2 * size))))
                h = np.unique(_window_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), q))
                odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                rows.append((rep, level, size, np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()))
            yield pd.DataFrame(rows, columns=["rep", "level", "size", "sketch"])

    return run


def _folded(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches as rows of `words` 64-bit words; of longer ones the parts are added up, which gives the parities by fewer bits."""
    out = np.empty((len(sketches), words), np.uint64)
    for i, s in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, words), axis=0)
    return out


def _within(least: float):
    """Pairs of the rows of one pair of blocks (me = p and me = q) that may be similar: no more parities differ than members may.

    Of sets of n and m members with similarity s, n + m times (1 - s) / (1 + s) members are in one only.
    """
    apart = (1 - least) / (1 + least)

    def pairs(x: pd.DataFrame, y: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        """x and y in order of size."""
        if not len(x) or not len(y):
            return
        words = min(min(map(len, x["sketch"])), min(map(len, y["sketch"]))) // 8
        full_x, full_y = _folded(x["sketch"].tolist(), words), _folded(y["sketch"].tolist(), words)
        half = max(8, words // 2)  # half as long a sketch first: it parts most pairs
        short_x, short_y = _folded(x["sketch"].tolist(), half), np.ascontiguousarray(_folded(y["sketch"].tolist(), half).T)
        size_x, size_y = x["size"].to_numpy().astype(np.float64), y["size"].to_numpy().astype(np.float64)
        rep_x, rep_y = x["rep"].to_numpy(), y["rep"].to_numpy()
        for i in range(0, len(x), 16):
            sizes = size_x[i : i + 16]
            lo, hi = np.searchsorted(size_y, sizes[0] * least * (1 - 1e-9)), np.searchsorted(size_y, sizes[-1] * (1 + 1e-9) / max(least, 1e-6), side="right")
            lo = max(lo, i) if same else lo  # each pair once
            most = apart * (sizes[:, None] + size_y[None, lo:hi]) * (1 + 1e-9)
            differ = np.zeros(most.shape, np.uint16)
            for w in range(half):
                differ += np.bitwise_count(short_x[i : i + 16, w, None] ^ short_y[w, lo:hi])
            a, b = np.nonzero(differ <= most)
            if same:
                later = i + a < lo + b
                a, b = a[later], b[later]
            keep = np.empty(len(a), bool)
            for j in range(0, len(a), 4096):
                d = np.bitwise_count(full_x[i + a[j : j + 4096]] ^ full_y[lo + b[j : j + 4096]]).sum(axis=1, dtype=np.int64)
                keep[j : j + 4096] = d <= most[a[j : j + 4096], b[j : j + 4096]]
            r, s = rep_x[i + a[keep]], rep_y[lo + b[keep]]
            yield pd.DataFrame({"rep_a": np.minimum(r, s), "rep_b": np.maximum(r, s)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(batches)).sort_values("size", ignore_index=True)
        p = df["me"] == df["p"]
        same = df["p"].iloc[0] == df["q"].iloc[0]
        yield from pairs(df[p], df if same else df[~p], same)

    return run


def _crowded(texts: DataFrame, hot: DataFrame, q: int, least: float) -> DataFrame:
    """(rep_a, rep_b): among records (rep, text) that share a segment of hot (rep, seg, n), all pairs that are similar, and few others."""
    top = hot.groupBy("rep").agg(F.max(F.struct("n", "seg"))["seg"].alias("top"))
    votes = hot.join(shuffled(top), "rep").groupBy("seg", "top").agg(F.count(F.lit(1)).alias("n"))
    crowd = votes.groupBy("seg").agg(F.max(F.struct("n", "top"))["top"].alias("crowd"))  # whatever it is, records of one segment are in one crowd
    members = cut(hot.join(shuffled(crowd), "seg").select("rep", "crowd").distinct())
    sketches = cut(texts.join(shuffled(members.select("rep").distinct()), "rep", "left_semi").select("rep", "text").mapInPandas(_sketch(q, least), "rep bigint, level int, size bigint, sketch binary"))
    placed = cut(members.join(shuffled(sketches.select("rep", "level", F.octet_length("sketch").alias("bytes"))), "rep"))
    room = F.least(F.lit(BLOCK), F.floor(F.lit(1 << 22) / F.max("bytes")))  # rows of a block: four megabytes at most
    blocks = placed.groupBy("crowd", "level").agg(F.ceil(F.count(F.lit(1)) / room).cast("bigint").alias("blocks"))
    number = lambda level, block: level.cast("bigint") * (1 << 32) + block
    others = blocks.select("crowd", F.col("level").alias("_l"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_b"))
    others = others.select("crowd", number(F.col("_l"), F.col("_b")).alias("other"), F.explode(F.array(*(F.col("_l") + d for d in (-1, 0, 1)))).alias("level"))
    mine = placed.join(shuffled(blocks), ["crowd", "level"]).select("crowd", "level", "rep", number(F.col("level"), F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("me"))
    tiles = mine.join(shuffled(others), ["crowd", "level"]).select("rep", "crowd", F.least("me", "other").alias("p"), F.greatest("me", "other").alias("q"), "me")
    return tiles.join(shuffled(sketches.select("rep", "size", "sketch")), "rep").groupBy("crowd", "p", "q").applyInPandas(_within(least), "rep_a bigint, rep_b bigint")


def classes(records: DataFrame, *, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(membership: id, rep; texts: rep, text): records with the same normalised text are one class, named by its smallest id.

    records: id BIGINT, text. Nulls and texts under min_chars characters (after
    normalising) are no members. Copies are combined before the shuffle.
    """
    # explode keeps the normalised text in one place: a projection would be worked out again in the filter and in the digest
    norm = records.select(F.col("id").cast("bigint").alias("id"), F.explode(F.array(normalised(F.col("text")))).alias("text")).where("id is not null").where(F.char_length("text") >= min_chars)
    keyed = norm.select("id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    texts = cut(keyed.groupBy("digest").agg(F.min("id").alias("rep"), F.first("text").alias("text")))
    membership = keyed.select("id", "digest").distinct().join(shuffled(texts.select("digest", "rep")), "digest").select("id", "rep")
    return membership, texts.select("rep", "text")


def similar_classes(texts: DataFrame, *, q: int = 5, least: float = 0.7, hot: int = HOT) -> DataFrame:
    """(rep_a, rep_b, similarity): pairs of different texts (rep BIGINT, text) whose sets of q-character substrings overlap by at least `least`.

    Every text has at least q characters. Buckets are joined, never collected;
    what over `hot` records share is compared in full.
    """
    encoded = cut(texts.mapInPandas(_encode(q), "rep bigint, seg array<bigint>, chain array<bigint>, code array<bigint>"))  # read several times
    rows = encoded.select("rep", F.inline(F.arrays_zip("seg", "chain")))
    shared = rows.groupBy("seg").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # most segments have one record
    rows = cut(rows.join(shuffled(shared), "seg"))

    def meet(bucket: list[str], df: DataFrame) -> DataFrame:
        """Pairs of a bucket whose chain stays within the budget of each prefix."""
        a, b = (df.withColumnsRenamed({"rep": f"rep_{x}", "chain": f"chain_{x}"}) for x in "ab")
        diff = F.col("chain_a").bitwiseXOR(F.col("chain_b"))
        ok = F.col("rep_a") < F.col("rep_b")
        for length in range(1, CHAIN + 1):  # the first segment agrees: prefixes of length + 1 segments
            ok = ok & (F.bit_count(diff.bitwiseAND(F.lit((1 << (ROWS * length)) - 1))) <= _share(least, ROWS * (length + 1)))
        return a.join(shuffled(b), bucket).where(ok)

    cand = meet(["seg"], rows.where(F.col("n") <= hot).select("seg", "rep", "chain")).select("rep_a", "rep_b").distinct()
    code = encoded.select("rep", "code")
    both = cand.join(shuffled(code.select(F.col("rep").alias("rep_a"), F.col("code").alias("code_a"))), "rep_a").join(shuffled(code.select(F.col("rep").alias("rep_b"), F.col("code").alias("code_b"))), "rep_b")
    apart = sum((F.bit_count(F.col("code_a")[i].bitwiseXOR(F.col("code_b")[i])) for i in range(K // 64)), F.lit(0))
    near = both.where(apart <= int(budget(least, K))).select("rep_a", "rep_b")
    crowds = rows.where(F.col("n") > hot).select("rep", "seg", "n")
    if not crowds.isEmpty():
        near = near.union(_crowded(texts, crowds, q, least)).distinct()
    pairs = near.join(shuffled(texts.select(F.col("rep").alias("rep_a"), F.col("text").alias("text_a"))), "rep_a").join(shuffled(texts.select(F.col("rep").alias("rep_b"), F.col("text").alias("text_b"))), "rep_b")
    return pairs.select("rep_a", "rep_b", "text_a", "text_b").mapInPandas(_exact(q, least), "rep_a bigint, rep_b bigint, similarity double")


def similar_pairs(records: DataFrame, *, q: int = 5, least: float = 0.7, min_chars: int = 80) -> DataFrame:
    """(id_a, id_b, similarity): all pairs of records, smaller id first, whose similarity is at least `least`; copies have 1.

    See `classes` for who takes part. Repeated ids with one text count once.
    """
    if min_chars < q:
        raise ValueError("min_chars must be at least q")
    membership, texts = classes(records, min_chars=min_chars)
    links = similar_classes(texts, q=q, least=least)
    a, b = membership.select(F.col("id").alias("x"), F.col("rep").alias("rep_a")), membership.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
    apart = links.join(shuffled(a), "rep_a").join(shuffled(b), "rep_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
    copies = a.join(shuffled(b), F.col("rep_a") == F.col("rep_b")).where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"), F.lit(1.0).alias("similarity"))
    return apart.union(copies).where("id_a <> id_b").distinct()


def groups(records: DataFrame, *, q: int = 5, least: float = 0.7, min_chars: int = 80) -> DataFrame:
    """(id, group_id, n_links): one row per record that takes part; a group is a connected component over similar records, named by its smallest id.

    n_links counts the other texts the record's text is similar to. Links run
    between classes of copies, so copies cost one row each.
    """
    from marlstone.operators.graph import components

    membership, texts = classes(records, min_chars=min_chars)
    links = cut(similar_classes(texts, q=q, least=least).select("rep_a", "rep_b"))  # for the components and for the degrees
    comp = components(links.select(F.col("rep_a").alias("src"), F.col("rep_b").alias("dst")))
    degree = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    out = membership.join(shuffled(comp.select(F.col("id").alias("rep"), "component")), "rep", "left").join(shuffled(degree), "rep", "left")
    return out.select("id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
