"""Mixing sources to target shares of the tokens (problem 7).

Tokens of each source are packed, in a pseudorandom order of its records, into blocks of fixed length.  Block
numbers come from prefix sums over (source, bucket), so no task sees a whole source.  Source counts of every
output shard are multinomial draws, conditioned on the sums the target shares fix.  Each task draws the counts of
its own shards: the quotas are split in two again and again, from all shards down to one, and every split is a draw
that seed and shards alone decide, so all tasks agree without a table of counts.  The j-th use of a source goes
through the permutation of its blocks for epoch j div blocks, and slots meet blocks in an equi-join.
Only one row per target source ever reaches the driver.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, ragged
from .tokenize import count_tokens

#: Tokens of a block, blocks of a shard, least buckets of a source, records from which there are more of them.
BLOCK_TOKENS, SHARD_BLOCKS, BUCKETS, BUCKET_RECORDS = 256, 2048, 1024, 100_000


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key: a four-round Feistel network with cycle walking."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    limit = size.astype(np.uint64)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for turn in range(4):
            f = (right + k + np.uint64(turn * 0x9E3779B9)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(33)) & m)
        out[todo] = (left << h) | right
        todo = out >= limit
    return out.astype(np.int64)


def quotas(tokens: dict[str, int], targets: dict[str, tuple[float, int]], block_tokens: int, total_tokens: int | None = None) -> dict[str, int]:
    """Blocks of each source: the largest mixture (or ``total_tokens``) that no source's repeats forbid."""
    blocks = {s: -(-n // block_tokens) for s, n in tokens.items() if n > 0 and targets[s][0] > 0 and targets[s][1] > 0}
    if not blocks:
        return {}
    share = {s: targets[s][0] / sum(targets[x][0] for x in blocks) for s in blocks}
    n = min(math.floor(blocks[s] * targets[s][1] / share[s] + 1e-9) for s in blocks)
    if total_tokens is not None:
        n = min(n, -(-total_tokens // block_tokens))
    out = {s: math.floor(share[s] * n) for s in blocks}
    for s in sorted(blocks, key=lambda s: (out[s] - share[s] * n, s))[: n - sum(out.values())]:
        out[s] += out[s] < blocks[s] * targets[s][1]
    return out


def hypergeometric(good: int, bad: int, n: int, rng: random.Random) -> int:
    """How many of ``n`` drawn from good + bad are good; of any size, by a ratio of uniforms."""
    total = good + bad
    least, most = max(0, n - bad), min(n, good)
    if least >= most:
        return most
    p = good / total
    mean, spread = n * p, n * p * (1 - p) * (total - n) / max(1, total - 1)
    width = 1.7155277699214135 * math.sqrt(spread + 0.5) + 0.8989161620588988  # 2 sqrt(2 / e), 3 - 2 sqrt(3 / e)
    mode = min(most, max(least, (n + 1) * (good + 1) // (total + 2)))

    def weight(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(n - k + 1) + math.lgamma(bad - n + k + 1))

    top = weight(mode)
    while True:
        u = 1.0 - rng.random()
        k = math.floor(mean + 0.5 + width * (rng.random() - 0.5) / u)
        if least <= k <= most and 2 * math.log(u) <= weight(k) - top:
            return k


def draw(quota: dict[str, int], shards: int, seed: int, first: int = 0, last: int | None = None) -> Iterator[tuple[int, list[int], list[int]]]:
    """(shard, uses before, uses) of shards first..last-1, by source in order of names: multinomial counts given that
    each source meets its quota.  A range of shards is split in two until it is one shard; ranges that lie outside
    are passed over, and any task finds the same counts for a shard."""
    names, total = sorted(quota), sum(quota.values())
    last = shards if last is None else last
    todo = [(0, shards, [0] * len(names), [quota[s] for s in names])]
    while todo:
        low, high, used, counts = todo.pop()
        if high <= first or low >= last:
            continue
        if high - low == 1:
            yield low, used, counts
            continue
        middle = (low + high) // 2
        left, rest = total * middle // shards - total * low // shards, sum(counts)
        rng, part = random.Random(f"{seed} {low} {high}"), []
        for n in counts:
            rest -= n
            part.append(hypergeometric(n, rest, left, rng))
            left -= part[-1]
        todo.append((middle, high, [a + b for a, b in zip(used, part, strict=True)], [a - b for a, b in zip(counts, part, strict=True)]))
        todo.append((low, middle, used, part))


def _key(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def mixture(docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, total_tokens: int | None = None, seed: int = 7, tokenizer: str = "byte_bpe_50k", shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, slot, source, epoch, block, doc_id, tok_start, tok_end): the mixture, piece by piece.

    ``docs`` has doc_id, text, source; ``targets`` has source, target_share, max_repeats (one row per source,
    a small table).  A slot holds one block; its pieces are token ranges of records.  A record is used at most
    max_repeats times.  Records of null sources or of sources without a target take no part, nor do null and
    empty texts; targets without tokens are left out and the other shares scaled up.  Without
    ``total_tokens`` the mixture is the largest that keeps all shares.  Empty inputs give an empty mixture.
    """
    spark = docs.sparkSession
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").where("source is not null and target_share > 0").limit(10_001).collect()}
    if len(wanted) > 10_000:
        raise ValueError("a mixture has at most 10,000 target sources")
    taking = docs.where(F.col("source").isin(*wanted)) if wanted else docs.where("false")
    counted = checkpoint(count_tokens(taking, ["doc_id", "source"], tokenizer=tokenizer).where("n_tokens > 0"))
    buckets = max(BUCKETS, counted.count() // BUCKET_RECORDS)
    bucket = F.pmod(_key(F.lit(seed), "doc_id"), F.lit(buckets)).cast("int")
    sums = counted.groupBy("source", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("tokens"))
    tokens = {r["source"]: r["tokens"] for r in sums.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    quota = quotas(tokens, wanted, block_tokens, total_tokens)
    total = sum(quota.values())
    shards = -(-total // shard_blocks)

    # Blocks: a record's place in its source is its bucket's base plus its place in the bucket.
    base = sums.select("source", "bucket", (F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")) - F.col("tokens")).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy(_key(F.lit(seed + 1), "doc_id"), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("bucket", bucket).withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(base.hint("merge"), ["source", "bucket"])
    start = F.col("base") + F.col("inside")
    pieces = (
        placed.select("source", "doc_id", "n_tokens", start.alias("at"))
        .select("source", "doc_id", "n_tokens", "at", F.explode(F.sequence(F.expr(f"at div {block_tokens}"), F.expr(f"(at + n_tokens - 1) div {block_tokens}"))).alias("block"))
        .select("source", "block", "doc_id", F.greatest(F.col("block") * block_tokens - F.col("at"), F.lit(0)).cast("int").alias("tok_start"), F.least((F.col("block") + 1) * block_tokens - F.col("at"), F.col("n_tokens")).cast("int").alias("tok_end"))
    )

    names = sorted(quota)
    blocks = np.array([-(-tokens[s] // block_tokens) for s in names], np.int64)
    marks = np.array([xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"), seed) >> 1 for s in names], np.int64)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(names, pa.string())
        for batch in batches:
            ids = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(ids) != 1) + 1).tolist(), len(ids)] if len(ids) else []
            for a, b in zip(cuts, cuts[1:], strict=False):  # runs of shards
                for shard, used, counts in draw(quota, shards, seed, int(ids[a]), int(ids[b - 1]) + 1):
                    which = np.repeat(np.arange(len(names)), counts)
                    use = ragged(np.array(used, np.int64), np.array(counts, np.int64))
                    size = blocks[which]
                    epoch = use // size
                    block = permute(use % size, size, marks[which] + epoch * 7919)
                    slot = permute(np.arange(len(use)), np.full(len(use), len(use)), np.full(len(use), shard * 104729 + seed))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(use), shard, np.int64)), pa.array(slot.astype(np.int32)), labels.take(pa.array(which)), pa.array(epoch.astype(np.int32)), pa.array(block)], names=["shard", "slot", "source", "epoch", "block"])

    drawn = spark.range(0, shards, 1, max(1, min(shards, total // 100_000, 4096)))
    used = drawn.mapInArrow(slots, "shard long, slot int, source string, epoch int, block long")
    # Slots grow with the mixture, though Spark can't see it past mapInArrow: never broadcast them.
    return used.hint("merge").join(pieces.hint("merge"), ["source", "block"]).select("shard", "slot", "source", "epoch", "block", "doc_id", "tok_start", "tok_end")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, actual_share, most_uses): what each target source contributes.

    A target without any token has 0 tokens, share and uses; an empty mixture gives 0 for every target.
    """
    per_block = mixed.groupBy("source", "block").agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("tokens"), F.countDistinct("shard", "slot").alias("uses"))
    per_source = per_block.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("uses").alias("most_uses"))
    wanted = targets.select("source", "target_share", "max_repeats")
    every = Window.partitionBy(F.lit(0))  # one row per target
    return wanted.join(per_source, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.sum("tokens").over(every), F.lit(0.0)).alias("actual_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
