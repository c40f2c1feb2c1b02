"""Search queries from seed signatures, many seeds at once.

A signature row holds ``seed_id, columns, concepts, identifiers, samples``; rows are counted
first, so pass a written table rather than a long plan. A strategy names the blocks of a
signature: the queries of one concept, column or identifier at its place. A block is written
out once per Python worker while it is remembered, and a seed's list is taken from blocks by
Arrow, beside its signature and without joins. ``branch`` and ``pos`` carry the list order.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions import fixed_values as fv
from tablescout.operators.order import top_k
from tablescout.session import cut

SIGNATURE = ["columns", "concepts", "identifiers", "samples"]
SEEDS = 4096  # signatures a task multiplies at most, so that its queries fit its memory
ITEMS = 1 << 15  # queries that are handed on at once, about 4 MB, unless one seed has more
REMEMBERED = 1 << 16  # queries of blocks that a worker remembers

# By branch: strategy, priority, fallback tier, the columns that ``value`` and ``other`` stand for, the sources and
# connectors that the last place counts, the number of places. A null source is not told.
_SHOWN = [(n, fv.SOURCE_CONNECTOR.get(n, n)) for n in fv.SOURCES]
_WIDE = [(n, fv.SOURCE_CONNECTOR.get(n, n)) for n in fv.EXTENDED_SOURCES]


def _hidden(sources: list[tuple]) -> list[tuple]:
    return [(None, c) for _, c in sources]


_BRANCHES = [
    ("direct_platform", 1, None, "concept", None, [(None, c) for _, c in fv.DIRECT_TEMPLATES], 2),
    ("concept_x_source", 1, None, "concept", "topic", _SHOWN, 3),
    ("joinability", 2, None, "identifier", None, _SHOWN, 3),
    ("joinability_entity_sample", 2, None, None, None, _hidden(_SHOWN), 1),
    ("augmentation", 3, None, "concept", "topic", _hidden(_SHOWN), 4),
    ("synonym", 2, None, "column", "synonym", _hidden(_SHOWN), 3),
    ("fallback_tier1_no_year", 4, 1, "concept", "topic", _SHOWN, 3),
    ("fallback_tier1_join_no_year", 4, 1, "identifier", None, _hidden(_SHOWN), 3),
    ("fallback_tier2_extended_sources", 5, 2, "concept", "topic", _WIDE, 3),
    ("fallback_tier2_synonym_extended", 5, 2, "column", "synonym", _hidden(_WIDE), 3),
    ("fallback_tier2_join_extended", 5, 2, "identifier", None, _hidden(_WIDE), 2),
]
# What differs from query to query; ``_told`` adds what its branch says.
_PARTS = ["query", "value", "other", "region"]
_PLACES = ["p0", "p1", "p2", "p3"]
_ITEM = pa.struct([(c, pa.string()) for c in _PARTS] + [(c, pa.int32()) for c in ("branch", *_PLACES)])
_NAMES = [f.name for f in _ITEM]
_BRANCH = _NAMES.index("branch")
# Blanks as Java's regular expressions see them; its $ also stands before one last line end.
_ENDS = re.compile("^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+(?=[\x85\u2028\u2029]?\\Z)")
_COVERED = re.compile("|".join(fv.COVERED_WORDS))


def _item(query: str | None, branch: int, pos: tuple, value: str | None = None, other: str | None = None, region: str | None = None) -> tuple:
    return (query, value, other, region, branch, *pos, *[None] * (len(_PLACES) - len(pos)))


def _told(q: Column) -> dict[str, Column]:
    """The columns of a query: look-ups that Spark compiles, and makes only where they are read."""
    branch = q["branch"]

    def of_branch(values, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), branch)

    def where(part: str, at: int, name: str) -> Column:
        return F.when(branch.isin([i for i, b in enumerate(_BRANCHES) if b[at] == name]), q[part])
    places = F.slice(F.array(*[q[p] for p in _PLACES]), F.lit(1), of_branch([b[6] for b in _BRANCHES], "int"))

    def of_source(at: int) -> Column:
        last = F.coalesce(*[q[p] for p in reversed(_PLACES)])
        return F.get(F.get(F.array(*[F.array(*[F.lit(s[at]).cast("string") for s in b[5]]) for b in _BRANCHES]), branch), last)
    return {
        "query": q["query"], "concept": where("value", 3, "concept"), "topic": where("other", 4, "topic"), "source": of_source(0),
        "identifier": where("value", 3, "identifier"), "region": q["region"], "column": where("value", 3, "column"),
        "synonym": where("other", 4, "synonym"), "target_connector": of_source(1), "strategy": of_branch([b[0] for b in _BRANCHES], "string"),
        "priority": of_branch([b[1] for b in _BRANCHES], "int"), "fallback_tier": of_branch([b[2] for b in _BRANCHES], "int"),
        "branch": branch, "pos": places}


def _told_of(item: tuple, name: str):
    """One of the columns of ``_told``, for an item in a Python worker."""
    strategy, priority, tier, value, other, sources, n = _BRANCHES[item[_BRANCH]]
    parts = dict(zip(_NAMES, item))
    source, connector = sources[item[_BRANCH + n]]
    told = {"strategy": strategy, "priority": priority, "fallback_tier": tier, "source": source, "target_connector": connector,
            **{c: parts[c] for c in ("query", "region", "branch")}}
    return parts["value"] if name == value else parts["other"] if name == other else told.get(name)


def _strategy(lists):
    """A strategy as rows of a signature table; ``items`` names the blocks of one signature.

    A block is ``(branch, function, *arguments)``; the function gives its queries. In a signature
    an absent list is an empty one; ``names`` and ``regions`` are the samples that are used.
    """
    @functools.wraps(lists)
    def rows(sig: DataFrame, *args, **more) -> DataFrame:
        found = _listed([lambda s: lists(s, *args, **more)], [])
        return _exploded(sig.select("seed_id", found(F.array(_signature(sig))).alias("list")), "list").drop("id")
    rows.items = lists
    return rows


def _exploded(lists: DataFrame, name: str, *more: str) -> DataFrame:
    """Each item of a list as a row, with its number as ``id``, and other fields of its own.

    By the outer form, for which Spark does not make the whole list twice more to ask whether it is empty.
    """
    rows = lists.select("seed_id", F.posexplode_outer(name).alias("at", "q")).filter("at is not null")
    q = F.col("q")
    told = {**_told(q), "id": F.col("at") + 1, **{c: q[c] for c in more}}
    return rows.select("seed_id", *[c.alias(n) for n, c in told.items()])


def _spaced(text: str | None) -> str | None:
    return None if text is None else text.replace("_", " ")


def _words(*parts: str | None) -> str:
    return " ".join(p for p in parts if p is not None)


def _year_text(years: tuple[int, int]) -> str:
    return f"{years[0]} {years[1]}"


def _blocks(branch: int, block, values: list, *more, known=None) -> list[tuple]:
    """A block for every value at its place; ``known`` are the values that have queries, by default all."""
    return [(branch, block, i, v, *more) for i, v in enumerate(values) if known is None or v in known]


def _filled(template: str, concept: str | None, years) -> str | None:
    return None if concept is None else template.replace("{years}", _year_text(years)).replace("{concept}", _spaced(concept))


def _direct(i, concept, years):
    return [_item(_filled(t, concept, years), 0, (i, m), concept) for m, (t, _) in enumerate(fv.DIRECT_TEMPLATES)]


@_strategy
def direct_platform(s, years=fv.YEAR_RANGE) -> list[tuple]:
    return _blocks(0, _direct, s["concepts"], years)


def _concept_source(i, concept, years):
    return [_item(_words(topic, source, _year_text(years)), 1, (i, t, k), concept, topic)
            for t, topic in enumerate(fv.CONCEPT_TOPICS[concept][:4]) for k, source in enumerate(fv.SOURCES)]


@_strategy
def concept_source(s, years=fv.YEAR_RANGE) -> list[tuple]:
    return _blocks(1, _concept_source, s["concepts"], years, known=fv.CONCEPT_TOPICS)


def _joinability(i, identifier, years):
    return [_item(_words(_spaced(identifier), term, source, _year_text(years)), 2, (i, t, k), identifier)
            for t, term in enumerate(fv.JOIN_TERMS) for k, source in enumerate(fv.SOURCES)]


@_strategy
def joinability(s, years=fv.YEAR_RANGE) -> list[tuple]:
    return _blocks(2, _joinability, s["identifiers"], years)


def _entity_sample(sample, years):
    return [_item(_words("countries", sample, "cross-country dataset", source, _year_text(years)), 3, (k,)) for k, source in enumerate(fv.SOURCES[:2])]


@_strategy
def entity_sample(s, years=fv.YEAR_RANGE) -> list[tuple]:
    return [(3, _entity_sample, ", ".join(n for n in s["names"] if n is not None), years)] if s["names"] else []


def _augmentation(i, concept, regions, years):
    topics = [(t, topic) for t, topic in enumerate(fv.CONCEPT_TOPICS[concept]) if not _COVERED.search(topic.lower())]
    return [_item(_words(topic, region, source, _year_text(years)), 4, (i, t, r, k), concept, topic, region)
            for t, topic in topics for r, region in enumerate(regions) for k, source in enumerate(fv.SOURCES[:2])]


@_strategy
def augmentation(s, years=fv.YEAR_RANGE) -> list[tuple]:
    return _blocks(4, _augmentation, s["concepts"], tuple(s["regions"]), years, known=fv.CONCEPT_TOPICS)


def _synonym(i, column, years):
    return [_item(_words(other, "by country year", source, _year_text(years)), 5, (i, y, k), column, other)
            for y, other in enumerate(fv.SYNONYMS[column]) for k, source in enumerate(fv.SOURCES)]


@_strategy
def synonym(s, years=fv.YEAR_RANGE) -> list[tuple]:
    return _blocks(5, _synonym, s["columns"], years, known=fv.SYNONYMS)


def _tier1_topics(i, concept):
    return [_item(_words(topic, source, "country dataset"), 6, (i, t, k), concept, topic)
            for t, topic in enumerate(fv.CONCEPT_TOPICS[concept]) for k, source in enumerate(fv.SOURCES)]


@_strategy
def tier1_topics(s) -> list[tuple]:
    return _blocks(6, _tier1_topics, s["concepts"], known=fv.CONCEPT_TOPICS)


def _tier1_join(i, identifier):
    return [_item(_words(_spaced(identifier), term, source), 7, (i, t, k), identifier)
            for t, term in enumerate(fv.JOIN_TERMS) for k, source in enumerate(fv.SOURCES)]


@_strategy
def tier1_join(s) -> list[tuple]:
    return _blocks(7, _tier1_join, s["identifiers"])


def _tier2_topics(i, concept):
    return [_item(_words(topic, "country dataset open data"), 8, (i, t, k), concept, topic)
            for t, topic in enumerate(fv.CONCEPT_TOPICS[concept]) for k in range(len(fv.EXTENDED_SOURCES))]


def _tier2_synonym(i, column):
    return [_item(_words(other, "country open dataset"), 9, (i, y, k), column, other)
            for y, other in enumerate(fv.SYNONYMS[column]) for k in range(3)]


def _tier2_join(i, identifier):
    return [_item(_words(_spaced(identifier), "cross-country open data"), 10, (i, k), identifier) for k in range(len(fv.EXTENDED_SOURCES))]


@_strategy
def tier2(s) -> list[tuple]:
    return [*_blocks(8, _tier2_topics, s["concepts"], known=fv.CONCEPT_TOPICS),
            *_blocks(9, _tier2_synonym, s["columns"], known=fv.SYNONYMS), *_blocks(10, _tier2_join, s["identifiers"])]


def union_dedupe(sig: DataFrame, *strategies, per_connector: bool = False) -> DataFrame:
    """All lists of a seed, keeping the first query per text.

    ``strategies``: functions from a signature to its blocks, such as ``direct_platform.items``, by priority and branch.
    Signatures are shuffled, not queries: one row holds a seed's lists, which are bounded by its
    column count, and only what is kept of them becomes rows.
    """
    return _exploded(_kept(sig, strategies, per_connector), "kept").drop("id")


def _signature(sig: DataFrame) -> Column:
    """What the strategies read of a signature."""
    def sample(name: str, n: int) -> Column:
        return F.slice(F.element_at("samples", name), 1, n)
    level = [c for c in sig.columns if c == "relaxation_level"]
    return F.struct("columns", "concepts", "identifiers", sample("country_name", 3).alias("names"), sample("region", 2).alias("regions"), *level)


def _kept(sig: DataFrame, strategies, per_connector: bool = False, heads: tuple[str, int] | None = None) -> DataFrame:
    """seed_id, kept: the queries of each seed by priority, then list order.

    ``strategies`` come in order of their priority and branch. ``heads`` leaves the first of every value of a column.
    """
    tasks = max(int(sig.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sig.count() // SEEDS))
    seeds = sig.repartition(tasks, "seed_id").groupBy("seed_id").agg(F.collect_list(_signature(sig)).alias("sigs"))
    once = ["query", "target_connector"] if per_connector else ["query"]
    return seeds.select("seed_id", _listed(strategies, once, heads)("sigs").alias("kept"))


def _listed(strategies, once: list[str], heads: tuple[str, int] | None = None):
    """The function from a seed's signatures to its list of queries; the first is kept for each value of ``once``.

    With ``heads``, a column and a number, only so many of every value are left, with their ``n`` and ``rn``.
    """
    numbers = ", n: int, rn: int" if heads else ""

    @F.arrow_udf(f"array<struct<{', '.join(f'{f.name}: ' + ('string' if f.type == pa.string() else 'int') for f in _ITEM)}{numbers}>>")
    def lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = _Held(once, heads)
        for sigs in batches:
            for seed in _read(sigs):
                held.add([[b for f in strategies for b in f(s)] for s in seed])
                if held.full():
                    yield held.handed_on()
            if held.seeds:
                yield held.handed_on()
    return lists


def _read(sigs: pa.ListArray) -> Iterator[list[dict]]:
    """The signatures of every seed, as lists of texts by name."""
    def split(values: list, a: pa.ListArray) -> list:
        ends = np.cumsum(pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        return [values[i:j] for i, j in zip([0, *ends], ends)]
    told = sigs.flatten()
    fields = {f.name: told.field(f.name) for f in told.type}
    read = {c: split(a.flatten().to_numpy(zero_copy_only=False).tolist(), a) if pa.types.is_list(a.type) else a.to_pylist() for c, a in fields.items()}
    return iter(split([dict(zip(read, s)) for s in zip(*read.values())], sigs))


class _Held:
    """Seeds whose queries are not handed on yet, and the blocks that are remembered."""

    def __init__(self, once: list[str], heads: tuple[str, int] | None = None):
        self.once, self.heads = once, heads
        self.forget()
        self.clear()

    def forget(self) -> None:
        self.at, self.items, self.rows = {}, [], pa.array([], _ITEM)  # where a block begins and its length; its queries; the same in Arrow
        self.ids, self.id_of = {}, np.zeros(0, np.int64)  # one number for all queries that count as the same
        self.groups, self.group_of = {None: 0}, np.zeros(0, np.int64)  # one number for each value of the column of ``heads``

    def clear(self) -> None:
        self.seeds, self.size, self.seed, self.first, self.length, self.branch = 0, 0, [], [], [], []

    def full(self) -> bool:
        return self.size >= ITEMS

    def block(self, key: tuple) -> tuple[int, int]:
        at = self.at.get(key)
        if at is None:
            made = key[1](*key[2:])
            at = self.at[key] = (len(self.items), len(made))
            self.items += made
        return at

    def add(self, signatures: list[list[tuple]]) -> None:
        """A seed by the blocks of its signatures."""
        if len(signatures) == 1:
            blocks = [(b[0], *self.block(b)) for b in signatures[0]]
        else:
            blocks = [(0, i, 1) for i in self.merged([i for s in signatures for b in s for at, n in [self.block(b)] for i in range(at, at + n)])]
        for branch, first, length in blocks:
            self.branch.append(branch)
            self.first.append(first)
            self.length.append(length)
            self.size += length
        self.seed += [self.seeds] * len(blocks)
        self.seeds += 1

    def merged(self, found: list[int]) -> list[int]:
        """The queries of several signatures in order, the first by branch and place for each text."""
        def bound(v):
            return (v is not None, v.encode() if isinstance(v, str) else v)

        def order(i: int):
            q = self.items[i]
            return (_BRANCHES[q[_BRANCH]][1], *place(i), [bound(v) for v in q])

        def place(i: int):
            return (self.items[i][_BRANCH], [bound(v) for v in self.items[i][_BRANCH + 1:]])
        in_order, best = sorted(found, key=order), {}
        for at, i in sorted(enumerate(in_order), key=lambda e: (*place(e[1]), e[0])):
            best.setdefault(self.key(self.items[i]), (at, i))
        return [i for _, i in sorted(best.values())]

    def key(self, item: tuple) -> tuple:
        told = {c: _told_of(item, c) for c in self.once}
        text = told["query"]
        return (text if text is None else _ENDS.sub("", text).lower(), *[told[c] for c in self.once if c != "query"])

    def learn(self) -> None:
        """Put the queries of new blocks in Arrow and number their texts."""
        new = self.items[len(self.rows):]
        if new:
            told = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*new), _ITEM)], fields=list(_ITEM))
            self.rows = pa.concat_arrays([self.rows, told])
            if self.once:
                self.id_of = np.append(self.id_of, [self.ids.setdefault(self.key(q), len(self.ids)) for q in new])
            if self.heads:
                self.group_of = np.append(self.group_of, [self.groups.setdefault(_told_of(q, self.heads[0]), len(self.groups)) for q in new])

    def handed_on(self) -> pa.ListArray:
        """The lists of the seeds held, which are held no more."""
        self.learn()
        seed, first, length, branch = (np.array(x, np.int64) for x in (self.seed, self.first, self.length, self.branch))

        def places(order: np.ndarray) -> np.ndarray:
            """Where the queries of blocks in this order are in the list of all."""
            n = length[order]
            return np.repeat((np.cumsum(length) - length)[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
        of_seed = np.repeat(seed, length)
        if self.once:
            by_branch = places(np.lexsort((branch, seed)))
            same = (of_seed * len(self.ids) + self.id_of[item])[by_branch]
            kept = np.sort(by_branch[~pd.Series(same).duplicated().to_numpy()])
            item, of_seed = item[kept], of_seed[kept]
        n = np.bincount(of_seed, minlength=self.seeds)
        rows = self.rows.take(pa.array(item))
        if self.heads:
            number = np.arange(1, len(item) + 1) - np.repeat(np.cumsum(n) - n, n)
            group = self.group_of[item]
            rank = pd.Series(of_seed * len(self.groups) + group).pipe(lambda g: g.groupby(g).cumcount()).to_numpy() + 1
            left = (rank <= self.heads[1]) & (group > 0)
            told = [*rows.take(pa.array(np.flatnonzero(left))).flatten(), pa.array(number[left], pa.int32()), pa.array(rank[left], pa.int32())]
            rows, n = pa.StructArray.from_arrays(told, [*_NAMES, "n", "rn"]), np.bincount(of_seed[left], minlength=self.seeds)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), rows, type=pa.list_(pa.field("element", rows.type)))
        self.clear()
        if len(self.items) > REMEMBERED:
            self.forget()
        return lists


def order_ids(sig: DataFrame, *strategies) -> DataFrame:
    """The kept queries of every seed, numbered by priority, then list order.

    The table knows how its heads are taken from the lists, as a Python function hides from Spark that seeds stay together.
    """
    queries = _exploded(_kept(sig, strategies), "kept")
    queries._heads = lambda by, k: _exploded(_kept(sig, strategies, heads=(by, k)), "kept", "n", "rn").withColumn("id", F.col("n")).drop("n")
    return queries


def generate(sig: DataFrame, years=fv.YEAR_RANGE) -> DataFrame:
    return order_ids(sig, *[lambda s, f=f: f.items(s, years) for f in (
        direct_platform, concept_source, joinability, entity_sample, synonym, augmentation)])


def feedback(tried: DataFrame, results: DataFrame) -> DataFrame:
    """Per seed: candidate counts, mean relevance and connectors without results.

    ``tried``: seed_id, target_connector. ``results``: scored candidates. Every side holds rows
    per seed, so none is sent through the driver, however small its files are.
    """
    found = results.groupBy("seed_id").agg(
        F.count(F.lit(1)).alias("total_candidates"),
        F.count_if(F.size("matched_join_fields") > 0).alias("joinable_count"),
        F.avg("relevance_score").alias("avg_relevance"))
    asked = tried.select("seed_id", F.col("target_connector").alias("connector")).distinct()
    silent = asked.join(results.select("seed_id", "connector").distinct().hint("merge"),
                        ["seed_id", "connector"], "left_anti")
    names = asked.groupBy("seed_id").agg(
        F.array_sort(F.collect_set("connector")).alias("connectors_tried"))
    failed = silent.groupBy("seed_id").agg(
        F.array_sort(F.collect_set("connector")).alias("failed_connectors"))
    none = F.array().cast("array<string>")
    return (
        names.join(found.hint("merge"), "seed_id", "left").join(failed.hint("merge"), "seed_id", "left")
        .select("seed_id",
                F.coalesce("total_candidates", F.lit(0)).alias("total_candidates"),
                F.coalesce("joinable_count", F.lit(0)).alias("joinable_count"),
                F.coalesce("avg_relevance", F.lit(0.0)).alias("avg_relevance"),
                "connectors_tried", F.coalesce("failed_connectors", none).alias("failed_connectors"))
    )


def sufficiency(fb: DataFrame) -> DataFrame:
    total, rel = F.col("total_candidates"), F.col("avg_relevance")
    share = F.when(total > 0, F.col("joinable_count") / total).otherwise(0.0)
    checks = [
        F.when(total < fv.MIN_CANDIDATES, F.format_string(
            f"too_few_candidates: got %d, need {fv.MIN_CANDIDATES}", total)),
        F.when(share < fv.MIN_JOINABLE_RATIO, F.format_string(
            f"low_joinability: %.0f%% joinable, need {fv.MIN_JOINABLE_RATIO:.0%}%",
            F.round(share * 100, 0))),
        F.when(rel < fv.MIN_AVG_RELEVANCE, F.format_string(
            f"low_relevance: avg score %.2f, need {fv.MIN_AVG_RELEVANCE:.2f}", F.round(rel, 2))),
    ]
    failed = F.array_compact(F.array(*checks))
    return fb.select(
        "seed_id", failed.alias("failed_checks"), (F.size(failed) == 0).alias("is_sufficient"),
        F.least(F.size(failed), F.lit(2)).alias("relaxation_level"))


def fallback(sig: DataFrame, suff: DataFrame) -> DataFrame:
    """Relaxed queries: none at level 0, tier 1 at level 1, both tiers at level 2."""
    levels = sig.join(suff.select("seed_id", "relaxation_level").hint("merge"), "seed_id").filter("relaxation_level >= 1")

    def strong(s):
        return tier2.items(s) if s["relaxation_level"] >= 2 else []
    return order_ids(cut(levels.select("seed_id", *SIGNATURE, "relaxation_level"), "levels"), tier1_topics.items, tier1_join.items, strong)


def summary(queries: DataFrame) -> DataFrame:
    """Counts per strategy, connector, concept and tier of each seed, in one pass."""
    dims = ["strategy", "target_connector", "concept", "fallback_tier"]
    tagged = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key"))
                       for d in dims])
    return (
        queries.select("seed_id", F.explode(tagged).alias("t")).select("seed_id", "t.*")
        .filter(F.col("key").isNotNull())
        .groupBy("seed_id", "dimension", "key").agg(F.count(F.lit(1)).alias("n"))
    )


def heads(queries: DataFrame, by: str = "strategy", k: int = 5) -> DataFrame:
    """The first ``k`` queries of every value of ``by``; those of ``order_ids`` itself are taken before they are rows."""
    beside = vars(queries).get("_heads")
    if beside and by not in ("id", "seed_id", "pos"):
        return beside(by, k)
    return top_k(queries.filter(F.col(by).isNotNull()), ["seed_id", by], [F.asc("id")], k, "rn")
