"""Entity resolution: each candidate value to its best seed value.

Equal normal forms are an equi join. For the rest no pair is ever a row. Seed values lie in
tiles of bounded size whose values have similar letter counts; a candidate value opens only the
tiles that can hold something at least as good as what it has found so far:

1. the tiles that hold enough of its tokens, and the tile where it would lie itself;
2. then every tile whose letter counts, as least and most per letter, allow the score of step 1
   or the threshold. These are found on a tree of boxes, level by level, not one by one.

Two values score T by shared tokens only if the tokens in common make up T / (200 - T) of the
shorter one, so of one of the two values a token among its rarest is common; other tokens are
not joined. All other scores come from common letters, which the counts bound. Nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.functions import fixed_values as fv
from tablescout.functions import letters
from tablescout.functions.similarity import match_tile
from tablescout.functions.text import BLANKS
from tablescout.operators.skew import salted_join
from tablescout.session import cut

TILE_SEEDS = 2048  # values of a tile, at most twice as many
TILE_CANDS = 4096  # candidate values that meet a tile in one task
FAN = 256  # boxes under one box of the next level
SAMPLE = 1 << 15  # seed values that the splits are learned from; they never decide what is found
DEPTH = 13


def _tokens(c: str) -> Column:
    return F.array_distinct(F.filter(F.split(c, BLANKS), lambda w: w != ""))


def resolve(seeds: DataFrame, cands: DataFrame, threshold: float = fv.MATCH_THRESHOLD) -> DataFrame:
    """Map candidate values to seed values, per ``domain``.

    ``seeds``: domain, norm, pos (first place in the seed). ``cands``: domain, norm.
    Output: domain, norm, seed_norm, score; values without a match are absent.
    """
    exact, found, _ = resolve_with_visits(seeds, cands, threshold)
    return exact.unionByName(found)


def resolve_with_visits(seeds: DataFrame, cands: DataFrame, threshold: float = fv.MATCH_THRESHOLD):
    """Exact matches, fuzzy matches, and one row (domain, norm, step, compared) per opened tile."""
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    known = cut(seeds.filter("norm <> ''").groupBy("domain", "norm").agg(F.min("pos").cast("bigint").alias("pos")),
                "seed-values")
    asked = cut(cands.filter("norm <> ''").select("domain", "norm").distinct(), "cand-values")
    values = known.hint("merge")  # a text column unpacks to many times its files, so it is not sent through the driver
    exact = asked.join(values, ["domain", "norm"], "left_semi").select(
        "domain", "norm", F.col("norm").alias("seed_norm"), F.lit(100.0).alias("score"))
    rest = asked.join(values, ["domain", "norm"], "left_anti")
    found, opened = _fuzzy(known, rest, threshold)
    return exact, found, opened


def _counted(splits: letters.Splits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [" ".join(sorted(set(v.split()))) for v in batch.column("norm").to_pylist()]
            bags = letters.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(t) for t in texts], pa.int32()), pa.array([b.tobytes() for b in bags], pa.binary()),
                 pa.array(splits.path(bags), pa.int64())], names=[*batch.schema.names, "len", "bag", "path"])
    return run


def _with_letters(df: DataFrame, splits: letters.Splits) -> DataFrame:
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(_counted(splits), f"{kinds}, len int, bag binary, path bigint")


def _boxes(df: DataFrame, group: list[str], kind: str) -> DataFrame:
    """Least and most of every letter, and the greatest length, over the rows of each group."""
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:  # a batch holds parts of several groups
            if len(rows):
                yield pd.DataFrame([(*key, *_box(g)) for key, g in _by(rows, group)], columns=[*group, "low", "high", "longest"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *_box(rows))], columns=[*group, "low", "high", "longest"])

    names = f"domain {kind}, " + "".join(f"{g} bigint, " for g in group[1:]) + "low binary, high binary, longest int"
    return df.select(*group, "low", "high", "longest").mapInPandas(fold, names).groupBy(*group).applyInPandas(merge, names)


def _by(rows: pd.DataFrame, group: list[str]):
    return ((k if isinstance(k, tuple) else (k,), g) for k, g in rows.groupby(group, sort=False, dropna=False))


def _box(rows: pd.DataFrame) -> tuple[bytes, bytes, int]:
    low, high = (np.frombuffer(b"".join(rows[c]), np.uint8).reshape(len(rows), -1) for c in ("low", "high"))
    return low.min(axis=0).tobytes(), high.max(axis=0).tobytes(), int(rows["longest"].max())


def _meet(visits: DataFrame, rows: DataFrame, node: str, run, schema: str) -> DataFrame:
    """Each node's visitors, in chunks of bounded size, with the node's rows; rows of nodes without visitors stay behind."""
    key = ["domain", node]
    chunks = visits.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / TILE_CANDS).cast("int").alias("chunks"))
    dealt = salted_join(visits, chunks, key, F.col("norm")).withColumn(
        "chunk", F.pmod(F.xxhash64("norm"), F.col("chunks")).cast("int")).drop("chunks")
    copies = rows.join(chunks, key).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return dealt.groupBy(*key, "chunk").cogroup(copies.groupBy(*key, "chunk")).applyInPandas(run, schema)


def _allowed(visitors: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
    """Visitors beside every box whose letters allow their bar."""
    out = []
    if len(visitors) and len(boxes):
        low, high = (np.frombuffer(b"".join(boxes[c]), np.uint8).reshape(len(boxes), -1) for c in ("low", "high"))
        longest, child = boxes["longest"].to_numpy(), boxes["child"].to_numpy()
        for domain, norm, n, bag, home, bar in zip(*(visitors[c] for c in ("domain", "norm", "len", "bag", "home", "bar"))):
            fit = letters.bound(np.frombuffer(bag, np.uint8), n, low, high, longest) >= bar - 1e-6
            out += [(domain, norm, n, bag, home, bar, c) for c in child[fit]]
    return pd.DataFrame(out, columns=["domain", "norm", "len", "bag", "home", "bar", "node"])


def _in_tiles(known: DataFrame, splits: letters.Splits) -> tuple[DataFrame, DataFrame]:
    """Seed values with their tile, and per domain and path prefix the number of tiles that share it.

    A domain uses as many bits of the path as its size asks for; where many values still
    share a prefix, they are dealt into several tiles.
    """
    sizes = known.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    drop = F.greatest(F.lit(0), F.lit(DEPTH) - F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / TILE_SEEDS)).cast("int")))
    sizes = sizes.select("domain", drop.alias("drop"))
    seeds = cut(salted_join(_with_letters(known, splits), sizes, ["domain"], F.col("norm"))
                .withColumn("cell", F.expr("shiftright(path, drop)")).drop("path"), "seed-cells")
    cells = cut(seeds.groupBy("domain", "drop", "cell").agg(F.ceil(F.count(F.lit(1)) / (2 * TILE_SEEDS)).cast("int").alias("tiles")), "cells")
    tile = F.col("cell") * (1 << 24) + F.pmod(F.xxhash64("norm"), F.col("tiles"))
    seeds = cut(salted_join(seeds, cells.drop("drop"), ["domain", "cell"], F.col("norm")).select(
        "domain", "norm", "pos", "len", "bag", tile.alias("tile")), "seed-tiles")
    return seeds, cells


def _fuzzy(known: DataFrame, rest: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    kind = dict(known.dtypes)["domain"]
    out = f"domain {kind}, norm string, seed_norm string, seed_pos bigint, score double, compared bigint"
    if known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * TILE_SEEDS).head(1):
        met = _in_two_steps(known, rest, threshold, kind, out)
    else:  # each domain is one tile, in which all is found at once
        zero = F.lit(0).cast("bigint").alias("tile")
        visits = cut(rest.select("domain", "norm", zero, F.lit(True).alias("letters"), F.lit(float(threshold)).alias("bar")), "visits")
        tiles = known.select("domain", zero, F.col("norm").alias("seed_norm"), F.col("pos").alias("seed_pos"))
        met = cut(_meet(visits, tiles, "tile", match_tile, out), "found").withColumn("step", F.lit(1))
    best = F.struct(-F.col("score"), F.col("seed_pos"), F.col("seed_norm"))
    found = met.filter("seed_norm is not null").groupBy("domain", "norm").agg(
        F.min_by("seed_norm", best).alias("seed_norm"), F.max("score").alias("score"))
    return found, met.select("domain", "norm", "step", "compared")


def _in_two_steps(known: DataFrame, rest: DataFrame, threshold: float, kind: str, out: str) -> DataFrame:
    share = min(1.0, SAMPLE / max(1, known.count()))  # about SAMPLE values, by hash
    some = known.filter(F.pmod(F.xxhash64("norm"), F.lit(1 << 30)) < int(share * (1 << 30))).select("norm").toPandas()
    splits = letters.Splits(letters.counts([" ".join(sorted(set(v.split()))) for v in some["norm"]]), DEPTH)
    seeds, cells = _in_tiles(known, splits)

    # Where each candidate value would lie, if there is such a tile; a domain without seed values has no tiles at all.
    drops = cells.groupBy("domain").agg(F.max("drop").alias("drop"))
    rest = salted_join(_with_letters(rest, splits), drops, ["domain"], F.col("norm")).withColumn("cell", F.expr("shiftright(path, drop)"))
    rest = salted_join(rest, cells.drop("drop"), ["domain", "cell"], F.col("norm"), "left")
    home = F.col("cell") * (1 << 24) + F.pmod(F.xxhash64("norm"), F.coalesce("tiles", F.lit(1)))
    rest = cut(rest.select("domain", "norm", "len", "bag", home.alias("home")), "cand-letters")

    by_home = rest.select("domain", "norm", F.col("home").alias("tile"), F.lit(True).alias("letters"))
    first = _token_visits(seeds, rest, threshold / (200.0 - threshold)).unionByName(by_home).groupBy(
        "domain", "norm", "tile").agg(F.max("letters").alias("letters"))
    first = cut(first.withColumn("bar", F.lit(float(threshold))), "visits")
    tiles = seeds.select("domain", "tile", F.col("norm").alias("seed_norm"), F.col("pos").alias("seed_pos"))
    near = cut(_meet(first, tiles, "tile", match_tile, out), "found")
    bars = near.groupBy("domain", "norm").agg(F.max("score").alias("bar"))
    asking = rest.join(bars.hint("merge"), ["domain", "norm"], "left").withColumn(
        "bar", F.coalesce("bar", F.lit(float(threshold)))).filter(F.col("bar") < 100)
    second = cut(_open_tiles(seeds, asking, kind).filter("node <> home").select(
        "domain", "norm", F.col("node").alias("tile"), "bar", F.lit(True).alias("letters")), "visits")
    far = cut(_meet(second, tiles, "tile", match_tile, out), "found")
    return near.withColumn("step", F.lit(1)).unionByName(far.withColumn("step", F.lit(2)))


def _token_visits(seeds: DataFrame, rest: DataFrame, share: float) -> DataFrame:
    """domain, norm, tile: the tiles in which a value can share enough tokens with another.

    Of the shorter value of such a pair, some common token is needed: without any, what is
    left of its tokens, the most frequent ones, is too little. Only those needed tokens are
    joined, once from each side, as either value may be the shorter one.
    """
    held = seeds.select("domain", "norm", "tile", F.explode(_tokens("norm")).alias("token"))
    often = held.groupBy("domain", "token").agg(F.count(F.lit(1)).alias("often"))

    def needed(df: DataFrame, *more: str) -> DataFrame:
        words = salted_join(df, often, ["domain", "token"], F.col("norm"), "left")
        order = Window.partitionBy("domain", "norm", *more).orderBy(F.desc("often"), "token")
        weight = F.length("token") + 1
        upto = F.sum(weight).over(order) - 1  # this token and all that are more frequent
        whole = F.sum(weight).over(Window.partitionBy("domain", "norm", *more)) - 1
        return words.withColumn("needed", upto >= share * whole - 1e-9)

    asked = needed(rest.select("domain", "norm", F.explode(_tokens("norm")).alias("token"))).filter("often is not null")
    holders = needed(held, "tile").groupBy("domain", "token", "tile").agg(F.max("needed").alias("held_needed"))
    met = salted_join(asked, holders, ["domain", "token"], F.col("norm")).filter(F.col("needed") | F.col("held_needed"))
    return met.select("domain", "norm", "tile", F.lit(False).alias("letters"))


def _open_tiles(seeds: DataFrame, asking: DataFrame, kind: str) -> DataFrame:
    """``asking`` beside every tile (``node``) whose letters allow the bar, from the top of a tree of boxes down."""
    rows = seeds.select("domain", "tile", F.col("bag").alias("low"), F.col("bag").alias("high"), F.col("len").alias("longest"))
    level = cut(_boxes(rows, ["domain", "tile"], kind).withColumnRenamed("tile", "child"), "boxes")
    levels = []
    while True:
        place = F.row_number().over(Window.partitionBy("domain").orderBy("child"))
        level = cut(level.withColumn("node", F.floor((place - 1) / FAN).cast("bigint")), "boxes")
        levels.append(level)
        if not level.filter("node > 0").head(1):
            break
        level = _boxes(level, ["domain", "node"], kind).withColumnRenamed("node", "child")
    frontier = asking.withColumn("node", F.lit(0).cast("bigint"))
    schema = f"domain {kind}, norm string, len int, bag binary, home bigint, bar double, node bigint"
    for level in reversed(levels):
        frontier = cut(_meet(cut(frontier, "frontier"), level, "node", _allowed, schema), "frontier")
    return frontier


def visit_report(opened: DataFrame) -> DataFrame:
    """Per step: candidate values that opened a tile, tiles opened, and value pairs whose letters were compared."""
    return opened.groupBy("domain", "step").agg(
        F.count_distinct("norm").alias("cand_values"), F.count(F.lit(1)).alias("tiles_opened"), F.sum("compared").alias("pairs_compared"))


def fan_out(seed_keys: DataFrame, cand_keys: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a left join will give, from counts per key and before joining."""
    s = seed_keys.groupBy(*keys).agg(F.count(F.lit(1)).alias("_s"))
    c = cand_keys.groupBy(*[F.col(k).alias(f"_r_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_c"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return s.join(c, same, "left").agg(
        F.sum(F.col("_s") * F.coalesce("_c", F.lit(1))).alias("expected_rows"))
