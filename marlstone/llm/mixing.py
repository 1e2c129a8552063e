"""Mixing sources to target weights (problem 8).

Each source's documents fall into permuted blocks, once per repetition. A
mix takes whole blocks of every source up to its quota of tokens and a part
of one more, documents in a hashed order. The blocks then go to output shards
down a splitting tree: at each node the multivariate hypergeometric law says
how many of each source's remaining blocks go left. Every node's draw has a
seed of its own, so each shard finds its own counts and offsets by walking from
the root, without the others; the draws are disjoint and use all blocks.
Inside a shard documents are put in a hashed order.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.runtime import cut, shuffled

BLOCK_DOCS, SHARD_TOKENS = 32, 2_000_000
#: Blocks whose places are found together.
SPAN = 4_096
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that the vocabulary at TOKENIZER was made with (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("marlstone", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of whole texts. Sources are compared without case and outer blanks. Null texts have no tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer)
        for b in batches:
            b["n_tokens"] = [0 if t is None else len(encoder.encode_ordinary(t)) for t in b["text"]]
            yield b[["doc_id", "source", "n_tokens"]]

    return documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").mapInPandas(count, "doc_id bigint, source string, n_tokens bigint")


def source_name(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def split_tree(colours: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, counts) per source of one shard: its walk from the root of the splitting tree."""
    left_of, here = np.zeros_like(colours), colours.copy()
    lo, hi, node = 0, shards, 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, node])
        total = int(here.sum())
        n_left = total * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(here, n_left, method="marginals") if total else np.zeros_like(here)
        if shard < mid:
            here, hi, node = left, mid, 2 * node
        else:
            left_of, here, lo, node = left_of + left, here - left, mid, 2 * node + 1
        node %= 1 << 62
    return left_of, here


def quotas(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, share, max_repeats, have_tokens, have_docs, quota): what each mix asks of each source.

    A mix is as large as its scarcest source allows when it is used max_repeats
    times. Targets of sources without documents (quota 0) are spread over the
    others in proportion; `share` is the share then asked for.
    """
    have = tokens.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("have_tokens"), F.count(F.lit(1)).alias("have_docs"))
    t = targets.where("mix_name is not null and target_share > 0 and max_repeats > 0").select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(have, "source", "left").withColumns({"have_tokens": F.coalesce("have_tokens", F.lit(0)), "have_docs": F.coalesce("have_docs", F.lit(0))})
    mix = Window.partitionBy("mix_name")
    t = t.withColumn("share", F.when(F.col("have_tokens") > 0, F.col("target_share") / F.sum(F.when(F.col("have_tokens") > 0, F.col("target_share"))).over(mix)).otherwise(0.0))
    size = F.min(F.when(F.col("share") > 0, F.col("max_repeats") * F.col("have_tokens") / F.col("share"))).over(mix)
    return t.withColumn("quota", F.when(F.col("share") > 0, F.least(F.floor(F.col("share") * size + 0.5), F.col("max_repeats") * F.col("have_tokens"))).otherwise(0).cast("bigint"))


def mix(tokens: DataFrame, targets: DataFrame, *, seed: int = 17, block_docs: int = BLOCK_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(mix_name, shard, pos, doc_id, source, repeat, n_tokens): the selection of each mix, in the order to be read.

    tokens: doc_id, source (as by token_counts), n_tokens. targets: mix_name,
    source, target_share, max_repeats. Documents without tokens, source or
    target are not used; a document is used max_repeats times at most. Each
    source's tokens miss its quota by less than its largest document. Empty
    tables give no rows; a repeated document row counts as one document.
    """
    tokens = tokens.where("n_tokens > 0 and source is not null and doc_id is not null").groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"))
    asked = cut(quotas(tokens, targets).where("quota > 0"))  # one row a mix and source of the target table
    if asked.isEmpty():
        return tokens.sparkSession.createDataFrame([], "mix_name string, shard bigint, pos bigint, doc_id bigint, source string, repeat int, n_tokens bigint")
    passes = asked.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.ceil(F.col("quota") / F.col("have_tokens")).cast("int") - 1))).withColumn("n_blocks", F.ceil(F.col("have_docs") / block_docs))
    # documents only need a block per repetition, whatever the mix
    used = passes.groupBy("source", "repeat").agg(F.max("n_blocks").alias("n_blocks"))
    order = F.xxhash64(F.lit(seed), "repeat", "doc_id")
    placed = tokens.join(used, "source").withColumn("block", F.pmod(order, F.col("n_blocks"))).select("doc_id", "source", "repeat", "block", "n_tokens", F.xxhash64(order, F.lit(1)).alias("at"))
    sums = placed.groupBy("source", "repeat", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    # a block's place and the tokens before it, over spans of blocks: no task sorts a whole source
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.withColumn("span", F.floor(F.col("block") / SPAN)))
    w = earlier(Window.partitionBy("source").orderBy("repeat", "span"))
    spans = sums.groupBy("source", "repeat", "span").agg(F.sum("block_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    spans = spans.select("source", "repeat", "span", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("t"), F.coalesce(F.sum("k").over(w), F.lit(0)).alias("k"))
    inner = Window.partitionBy("source", "repeat", "span").orderBy("block")
    placed_blocks = (
        sums.withColumns({"in_t": F.coalesce(F.sum("block_tokens").over(earlier(inner)), F.lit(0)), "in_k": F.row_number().over(inner) - 1}).join(shuffled(spans), ["source", "repeat", "span"])
        .select("source", "repeat", "block", "block_tokens", (F.col("t") + F.col("in_t")).alias("before"), (F.col("k") + F.col("in_k")).cast("bigint").alias("unit"))
    )
    units = passes.select("mix_name", "source", "repeat", "quota").join(placed_blocks, ["source", "repeat"]).where("before < quota")
    units = cut(units)
    plan = units.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("n_units")).join(asked.groupBy("mix_name").agg(F.greatest(F.lit(1), F.ceil(F.sum("quota") / shard_tokens)).alias("shards")), "mix_name")
    per_mix = plan.groupBy("mix_name").agg(F.sort_array(F.collect_list(F.struct("source", "n_units"))).alias("colours"), F.max("shards").alias("shards"))  # sources of one mix
    walks = per_mix.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, colours, shards, shard in zip(b["mix_name"], b["colours"], b["shards"], b["shard"]):
                counts = np.array([c["n_units"] for c in colours], np.int64)
                first, n = split_tree(counts, int(shards), int(shard), seed)
                out += [(name, c["source"], int(shard), int(f), int(f + k)) for c, f, k in zip(colours, first, n) if k]
            yield pd.DataFrame(out, columns=["mix_name", "source", "shard", "first", "stop"])

    drawn = walks.select("mix_name", "colours", "shards", "shard").mapInPandas(walk, "mix_name string, source string, shard bigint, first bigint, stop bigint")
    owner = drawn.select("mix_name", "source", "shard", F.explode(F.sequence("first", F.col("stop") - 1)).alias("unit"))
    owned = units.join(shuffled(owner), ["mix_name", "source", "unit"]).select("mix_name", "source", "repeat", "block", "quota", "before", "block_tokens", "shard")
    docs = placed.join(shuffled(owned), ["source", "repeat", "block"])
    inside = Window.partitionBy("mix_name", "source", "repeat", "block").orderBy("at", "doc_id")  # one block
    whole = F.col("before") + F.col("block_tokens") <= F.col("quota")
    taken = docs.withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside)).where(whole | (F.col("upto") <= F.col("quota")))
    local = Window.partitionBy("mix_name", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "shard", "at", "repeat"), "doc_id", "repeat")  # one shard, of bounded size
    return taken.withColumn("pos", (F.row_number().over(local) - 1).cast("bigint")).select("mix_name", "shard", "pos", "doc_id", "source", "repeat", "n_tokens")


def reached(selection: DataFrame, tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, share_asked, share_reached, n_docs, n_uses, most_repeats, tokens) for every target, those without documents included."""
    per_doc = selection.groupBy("mix_name", "source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("tokens"))
    got = per_doc.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("uses").alias("n_uses"), F.max("uses").alias("most_repeats"), F.sum("tokens").alias("tokens"))
    report = quotas(tokens.where("source is not null"), targets).select("mix_name", "source", "target_share", F.col("share").alias("share_asked"), "max_repeats").join(got, ["mix_name", "source"], "left").na.fill(0, ["n_docs", "n_uses", "most_repeats", "tokens"])
    return report.withColumn("share_reached", F.round(F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy("mix_name"))), F.lit(0.0)), 6)).withColumn("share_asked", F.round("share_asked", 6))


def kept(selection: DataFrame, tokens: DataFrame, targets: DataFrame, *, near: float = 0.01) -> DataFrame:
    """(mix_name, source, share_asked, capped, once, near): for each target, whether no document is used more than max_repeats times, none twice in one repetition, and the share reached is within `near` of the one asked for."""
    twice = selection.groupBy("mix_name", "source", "doc_id", "repeat").agg(F.count(F.lit(1)).alias("n")).groupBy("mix_name", "source").agg(F.max("n").alias("n"))
    r = reached(selection, tokens, targets).join(twice, ["mix_name", "source"], "left")
    return r.select("mix_name", "source", "share_asked", (F.col("most_repeats") <= F.col("max_repeats")).alias("capped"), (F.coalesce("n", F.lit(1)) == 1).alias("once"), (F.abs(F.col("share_reached") - F.col("share_asked")) <= near).alias("near"))
