"""Exact Jaccard self-join of shingle sets through a token-group matrix.

A document is its set of distinct five-word shingles; documents of equal sets are one class. Two classes link when
intersection / union is at least ``SHARE / 100``.

* Tokens have one order for all sets: those whose cell of a fixed-size count sketch is crowded come last, the rest by hash.
  The first n - ceil(0.8 n) + 1 tokens of a set, its prefix, must meet the prefix of every partner; a partner of size b shares at
  least ``needed(n, b)`` of them. The sketch decides speed alone.
* Groups of similar documents: every shared token names a hub, its most shared class. Classes that verify against a hub form a
  component with it; any other class joins the group of the hub that most of its tokens name. Groups are split by size bands.
* Bounds by band: a class's tokens that another component holds in a size band are counted, and the class stays in play
  towards a band only where the count reaches the least ``needed`` there.
* Matrix: one row per (token, group) over the tokens of the group's members, however many they are. The count of a query's
  tokens in a group's row bounds what it can share with any member, so only groups that reach the least ``needed`` of their
  band are opened, and only if they hold another component than the query's.
* An opened group is compared in blocks of whole sets, each of at most about ``BLOCK_TOKENS`` tokens of queries and as many of
  members. A block joins components as it goes and gives fewer links than it has classes: a pair is no row before it links.

Every link between different components is found, so the components are exact; a link inside a group already
joined changes nothing and is not looked for. Sets are compared as 64-bit hashes.

Cases: texts without words have no set, and link with nothing; fewer than five words are one shingle; repeated rows
share a class; a null doc_id is no component's name unless all its rows have none; an empty table gives no
rows; other columns are ignored. A very long text is hashed in slices, and its set is held whole by one task. Of classes whose
prefixes are shared to equal parts the one with the least key is the hub; ties don't change the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cohortlab.llm import words
from cohortlab.llm.graph import components, id_filter, may_hold
from cohortlab.session import bound_batches, collect_garbage, durable, release

SIZE = 5
SHARE = 80
CELL_BITS = 22
_CELL_PARTS = 64
_BAND = 1.05
BLOCK_TOKENS = 200_000


def _sets(batch: pa.RecordBatch):
    """Row and shingle set of each row with words."""
    for row, texts in words.chunks(batch.column("text")):
        found = words.split(texts, lower=True)
        first = found.first.tolist()
        for i in range(len(texts)):
            if first[i + 1] > first[i]:
                yield row + i, words.shingle_set(found.hashes[first[i] : first[i + 1]], SIZE)


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        total = words.mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(tokens)) * np.uint64(0x9E3779B97F4A7C15)
    return int(words.mix(np.array([total]))[0].view(np.int64))


def classes(docs: DataFrame, cell_bits: int = CELL_BITS) -> DataFrame:
    """Stored: a row ``doc_id, n, key`` per document, and rows ``part, cells`` with each task's share of the token counts."""
    width = (1 << cell_bits) // _CELL_PARTS
    names = ["doc_id", "n", "key", "part", "cells"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def scan(batches):
        cells = np.zeros(1 << cell_bits, np.uint32)
        seen: set[int] = set()
        for batch in batches:
            n, keys = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for row, tokens in _sets(batch):
                n[row], keys[row] = len(tokens), set_key(tokens)
                if keys[row] not in seen:
                    seen.add(int(keys[row]))
                    np.add.at(cells, (tokens >> np.uint64(64 - cell_bits)).astype(np.int64), 1)
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(keys, mask=n == 0), none.cast(types[3]), none.cast(types[4])], names=names)
        if seen:
            parts = [np.minimum(cells[i * width : (i + 1) * width], 65_535).astype("<u2").tobytes() for i in range(_CELL_PARTS)]
            none = pa.nulls(_CELL_PARTS)
            yield pa.RecordBatch.from_arrays([none.cast(types[0]), none.cast(types[1]), none.cast(types[2]), pa.array(range(_CELL_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return durable(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n int, key long, part int, cells binary"))


def crowding(stored: DataFrame, cell_bits: int = CELL_BITS) -> np.ndarray:
    """Per cell 0, or a level that grows with its count where that is beyond chance: one byte per cell."""
    total = stored.agg(F.sum("n")).first()[0] or 0
    mean = total / (1 << cell_bits)
    usual = mean + 5 * mean**0.5 + 6

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.sum([np.frombuffer(bytes(c), "<u2").astype(np.float64) for c in rows["cells"]], axis=0)
        level = np.where(counts > usual, 1 + np.floor(4 * np.log2(np.maximum(counts / usual, 1))), 0)
        return pd.DataFrame({"part": [key[0]], "level": [np.minimum(level, 255).astype(np.uint8).tobytes()]})

    out = np.zeros(1 << cell_bits, np.uint8)
    width = len(out) // _CELL_PARTS
    for row in stored.where("part is not null").groupBy("part").applyInPandas(add, "part int, level binary").collect():
        out[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(bytes(row["level"]), np.uint8)
    return out


def prefixes(docs: DataFrame, levels: np.ndarray, share: int = SHARE) -> DataFrame:
    """``token, class, n, hot``: the prefix of every class, once per task."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(levels)
    shift = np.uint64(64 - (len(levels) - 1).bit_length())

    def scan(batches):
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, int, int]] = []
            for _, tokens in _sets(batch):
                key = set_key(tokens)
                if key in seen:
                    continue
                seen.add(key)
                level = shared.value[(tokens >> shift).astype(np.int64)]
                take = len(tokens) - -(-share * len(tokens) // 100) + 1
                first = np.argsort(level, kind="stable")[:take]
                out.append((tokens[first], level[first] > 0, key, len(tokens)))
            sizes = [len(x[0]) for x in out]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.zeros(0, np.uint64), *[x[0] for x in out]]).view(np.int64)),
                pa.array(np.repeat(np.array([x[2] for x in out], np.int64), sizes)), pa.array(np.repeat(np.array([x[3] for x in out], np.int32), sizes)),
                pa.array(np.concatenate([np.zeros(0, bool), *[x[1] for x in out]]))], names=["token", "class", "n", "hot"])

    return docs.select("text").mapInArrow(scan, "token long, class long, n int, hot boolean")


def _band(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(_BAND))).cast("int")


def _reach(share: int) -> int:
    """The most bands between the sizes of linked sets."""
    return int(np.ceil(np.log(100 / share) / np.log(_BAND)))


def shared_tokens(postings: DataFrame, share: int = SHARE) -> DataFrame:
    """Stored ``token, class, n, held`` of the prefix tokens that another class of a fitting size holds; ``held`` counts the class's own such tokens.

    Usual tokens have few classes and meet in a window by size, where the nearest sizes tell. Crowded ones are first counted by
    partial aggregates per size band; the join back can be split where it is skewed.
    """
    by_size = Window.partitionBy("token").orderBy("n", "class")
    cold = postings.where(~F.col("hot")).withColumn("before", F.lag("class").over(by_size)).where("before is null or before != class")
    cold = cold.withColumn("smaller", F.lag("n").over(by_size)).withColumn("larger", F.lead("n").over(by_size))
    cold = cold.where((100 * F.col("smaller") >= share * F.col("n")) | (100 * F.col("n") >= share * F.col("larger"))).select("token", "class", "n")
    crowded = durable(postings.where("hot").select("token", "class", "n", _band(F.col("n")).alias("band")))
    cells = crowded.groupBy("token", "band").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    near = Window.partitionBy("token").orderBy("band").rangeBetween(-_reach(share), _reach(share))
    cells = cells.select("token", "band", F.min("low").over(near).alias("low"), F.max("high").over(near).alias("high")).where("low != high")
    rows = durable(cold.unionByName(crowded.join(cells, ["token", "band"]).select("token", "class", "n").distinct()))
    shared = durable(rows.join(rows.groupBy("class").agg(F.count("*").alias("held")), "class"))
    release(crowded)
    release(rows)
    return shared


def _ceil(a: Column, over: int) -> Column:
    return F.floor((a + (over - 1)) / over)


def needed(a: Column, b: Column, share: int = SHARE) -> Column:
    """Prefix tokens that linked sets of sizes a and b have in common at least."""
    both = _ceil(share * (a + b), 100 + share)
    return F.greatest(F.lit(1), F.least(both - _ceil(share * a, 100), both - _ceil(share * b, 100)) + 1)


def _size_fits(a: Column, b: Column, share: int = SHARE) -> Column:
    return 100 * F.least(a, b) >= share * F.greatest(a, b)


def whole_sets(wanted: DataFrame, docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored ``key, tokens``: the set of each wanted class, recomputed from one document of it."""
    reps = durable(stored.where("n > 0").join(wanted, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("rep")))
    bits = id_filter(reps, "rep")

    def scan(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            keep = may_hold(bits, ids.fill_null(0).to_numpy()) | ids.is_null().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(keep))
            found = list(_sets(batch))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array([r for r, _ in found], pa.int64())), pa.array([set_key(t) for _, t in found], pa.int64()),
                pa.array([t.tobytes() for _, t in found], pa.binary())], names=["doc_id", "key", "tokens"])

    sets = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, key long, tokens binary")
    sets = sets.join(reps.withColumnRenamed("key", "own"), (F.col("key") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    sets = durable(sets.select("key", "tokens").dropDuplicates(["key"]))
    release(reps)
    collect_garbage(docs.sparkSession)
    return sets


def verify(pairs: DataFrame, docs: DataFrame, stored: DataFrame, share: int = SHARE) -> DataFrame:
    """The ``a, b`` pairs of classes that link, compared on whole sets."""
    pairs = durable(pairs.select("a", "b").distinct())
    sets = whole_sets(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), docs, stored)
    one = sets.select(F.col("key").alias("a"), F.col("tokens").alias("left"))
    two = sets.select(F.col("key").alias("b"), F.col("tokens").alias("right"))

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= share * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = durable(pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right").mapInArrow(compare, "a long, b long"))
    release(pairs)
    release(sets)
    return links


def named_hubs(shared: DataFrame, share: int = SHARE) -> DataFrame:
    """Stored ``class, n, held, hub, hub_n, hub_held, named``: the hubs that a class's tokens name, and how many do; itself included.

    A token's hub is the class whose prefix is shared to the greatest part: among edited copies the one nearest their origin.
    """
    prefix = F.col("n") - _ceil(share * F.col("n"), 100) + 1
    me = F.struct(F.floor(1000 * F.col("held") / prefix).alias("part"), F.bitwise_not("class").alias("turned"), "n", "held")
    hubs = shared.groupBy("token").agg(F.max(me).alias("hub"))
    rows = shared.join(hubs, "token").select(
        "class", "n", "held", F.bitwise_not("hub.turned").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.held").alias("hub_held"))
    return durable(rows.groupBy(*rows.columns).agg(F.count("*").alias("named")))


def hub_pairs(shared: DataFrame, hubs: DataFrame, share: int = SHARE) -> DataFrame:
    """Classes and their hubs, ``a, b``, that have enough prefix tokens in common."""
    least = needed(F.col("n"), F.col("hub_n"), share)
    pairs = hubs.where((F.col("class") != F.col("hub")) & _size_fits(F.col("n"), F.col("hub_n"), share) & (F.least("held", "hub_held") >= least))
    mine = shared.select("class", "token")
    theirs = shared.select(F.col("class").alias("hub"), "token")
    met = pairs.select("class", "hub", least.alias("least")).join(mine, "class").join(theirs, ["hub", "token"]).groupBy("class", "hub", "least").agg(F.count("*").alias("met"))
    return met.where("met >= least").select(F.col("class").alias("a"), F.col("hub").alias("b"))


def families(hubs: DataFrame, groups: DataFrame) -> DataFrame:
    """Stored ``class, comp, family`` of every class with shared tokens: its component, and the group whose tokens the matrix holds together."""
    best = hubs.groupBy("class").agg(F.max(F.struct("named", "hub")).getField("hub").alias("hub"))
    own = groups.select(F.col("node").alias("class"), "comp")
    theirs = groups.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))
    rows = best.join(own, "class", "left").join(theirs, "hub", "left")
    return durable(rows.select("class", F.coalesce("comp", "class").alias("comp"), F.coalesce("comp", "hub_comp", "hub").alias("family")))


def band_needs(low: Column, high: Column, share: int = SHARE) -> Column:
    """The least of ``needed`` of a set of size ``n`` over partners of sizes low to high, which is at an end; one less for rounding. Null: none fits."""
    n = F.col("n")
    low = F.greatest(low, F.floor(share * n / 100))
    high = F.least(high, F.ceil(100 * n / share))
    return F.when(low <= high, F.greatest(F.lit(1), F.least(needed(n, low, share), needed(n, high, share)) - 1))


def in_play(shared: DataFrame, groups: DataFrame, share: int = SHARE) -> DataFrame:
    """Stored ``token, class, n, comp, family, band, to``: tokens by which a class may link with another component's class of size band ``to``.

    A token counts towards a band if another component holds it there; a class stays in play towards a band only with as many
    such tokens as a partner there needs.
    """
    rows = durable(shared.join(groups, "class").select("token", "class", "n", "comp", "family", _band(F.col("n")).alias("band")))
    cells = rows.groupBy("token", "band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    near = Window.partitionBy("token").orderBy("band").rangeBetween(-_reach(share), _reach(share))  # a token has a row per band
    cells = cells.select("token", "band", F.min("low").over(near).alias("x"), F.max("high").over(near).alias("y"), F.collect_list(F.struct(F.col("band").alias("to"), "low", "high")).over(near).alias("near"))
    cells = cells.where("x != y").select("token", "band", "near")
    other = F.filter("near", lambda x: (x["low"] != F.col("comp")) | (x["high"] != F.col("comp")))
    met = rows.join(cells, ["token", "band"]).select("token", "class", "n", "comp", "family", "band", F.explode(F.transform(other, lambda x: x["to"])).alias("to"))
    met = durable(met)
    first, last = (F.floor(F.pow(F.lit(_BAND), F.col("to") + i)) for i in (0, 1))
    enough = met.groupBy("class", "n", "to").agg(F.count("*").alias("met")).where(F.col("met") >= band_needs(first, last + 1, share)).select("class", "to")
    left = durable(met.join(enough, ["class", "to"]).select("token", "class", "n", "comp", "family", "band", "to"))
    release(rows)
    release(met)
    return left


def opened_groups(left: DataFrame, share: int = SHARE) -> DataFrame:
    """Stored ``class, n, comp, family, band``: queries and the groups, by family and band, that they open.

    Of two sets the larger one asks, so a query is sent to no band above its own.
    """
    cell = ["token", "family", F.col("band").alias("to"), F.col("to").alias("band")]
    matrix = left.where("to >= band").groupBy(*cell).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    sizes = left.groupBy("family", F.col("band").alias("to")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    queries = left.where("to <= band").select("token", "class", "n", "comp", "band", "to")
    fits = (100 * F.col("high") >= share * F.col("n")) & (100 * F.col("n") >= share * F.col("low"))
    hits = queries.join(matrix, ["token", "band", "to"]).where(((F.col("comp") != F.col("x")) | (F.col("comp") != F.col("y"))) & fits)
    hits = hits.groupBy("class", "n", "comp", "family", "to").agg(F.count("*").alias("met")).join(sizes, ["family", "to"])
    enough = hits.where(F.col("met") >= band_needs(F.col("least"), F.col("most"), share))
    return durable(enough.select("class", "n", "comp", "family", F.col("to").alias("band")))


def verify_opened(opened: DataFrame, left: DataFrame, docs: DataFrame, stored: DataFrame, share: int = SHARE, block: int = BLOCK_TOKENS) -> DataFrame:
    """Stored ``a, b``: links between queries and members of the groups they open, enough to join what links, compared on whole sets."""
    group = ["family", "band"]
    members = durable(left.where("to >= band").select("class", "n", "comp", *group).distinct().join(opened.select(*group).distinct(), group, "left_semi"))
    asking = opened.groupBy(*group).agg(F.ceil(F.sum("n") / block).cast("int").alias("asking"))
    blocks = asking.join(members.groupBy(*group).agg(F.ceil(F.sum("n") / block).cast("int").alias("asked")), group)
    sets = whole_sets(opened.select(F.col("class").alias("key")).union(members.select("class")).distinct(), docs, stored)

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """A row once for every block of the other side."""
        place = F.pmod(F.xxhash64("class"), F.col(own)).cast("int")
        rows = rows.join(blocks, group).select("class", "comp", *group, place.alias(f"{own}_block"), F.explode(F.sequence(F.lit(1), other)).alias(f"{other}_block"), F.lit(own == "asking").alias("asks"))
        return rows.withColumn(f"{other}_block", F.col(f"{other}_block") - 1)

    rows = dealt(opened, "asking", "asked").unionByName(dealt(members, "asked", "asking"))
    rows = rows.join(sets.withColumnRenamed("key", "class"), "class")

    def meet(table: pa.Table) -> pa.Table:
        asks, keys = table.column("asks").to_numpy(), table.column("class").to_numpy()
        found = [np.frombuffer(t.as_buffer(), np.uint64) for t in table.column("tokens")]
        label = np.unique(table.column("comp").to_numpy(), return_inverse=True)[1]
        asked = np.flatnonzero(~asks)
        sizes = np.array([len(found[i]) for i in asked], np.int64)
        tokens = np.concatenate([np.zeros(0, np.uint64), *[found[i] for i in asked]])
        order = np.argsort(tokens)
        tokens, owner = tokens[order], np.repeat(np.arange(len(asked)), sizes)[order]
        a, b = [], []
        for i in np.flatnonzero(asks):
            if (label[asked] == label[i]).all():
                continue
            first = np.searchsorted(tokens, found[i], "left")
            count = np.searchsorted(tokens, found[i], "right") - first
            at = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
            common = np.bincount(owner[at], minlength=len(asked))
            link = asked[(100 * common >= share * (sizes + len(found[i]) - common)) & (label[asked] != label[i])]
            names, one = np.unique(label[link], return_index=True)
            a += [keys[i]] * len(one)
            b += keys[link[one]].tolist()
            label[np.isin(label, names)] = label[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = durable(rows.groupBy(*group, "asking_block", "asked_block").applyInArrow(meet, "a long, b long"))
    release(members)
    release(sets)
    return links


def linked(docs: DataFrame, share: int = SHARE, cell_bits: int = CELL_BITS, block: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The stored classes, and ``node, comp`` of every class that has a link."""
    spark = docs.sparkSession
    bound_batches(spark)
    stored = classes(docs, cell_bits)
    shared = shared_tokens(prefixes(docs, crowding(stored, cell_bits), share), share)
    collect_garbage(spark)
    hubs = named_hubs(shared, share)
    near = verify(hub_pairs(shared, hubs, share), docs, stored, share)
    collect_garbage(spark)
    groups = families(hubs, components(near))
    release(hubs)
    left = in_play(shared, groups, share)
    release(shared)
    release(groups)
    collect_garbage(spark)
    opened = opened_groups(left, share)
    collect_garbage(spark)
    far = verify_opened(opened, left, docs, stored, share, block)
    release(left)
    release(opened)
    collect_garbage(spark)
    return stored, components(near.unionByName(far))


def join_groups(docs: DataFrame, share: int = SHARE, cell_bits: int = CELL_BITS, block: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    stored, comps = linked(docs, share, cell_bits, block)
    rows = stored.where("part is null").select("doc_id", "n", "key")
    keyed = rows.where("n > 0").join(comps, F.col("key") == F.col("node"), "left").select("doc_id", "n", F.coalesce("comp", "key").alias("comp"))
    names = keyed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = keyed.join(names, "comp").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return named.unionByName(rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, share: int = SHARE, cell_bits: int = CELL_BITS) -> DataFrame:
    """One row of each component, with all its columns: one of those with the least id, null ids last.

    Rows without words all stay. Rows whose id is null or repeated are judged by their own text.
    """
    stored, comps = linked(docs, share, cell_bits)
    rows = stored.where("n > 0").join(comps, F.col("key") == F.col("node"), "left").select("doc_id", "key", F.coalesce("comp", "key").alias("comp"))
    firsts = durable(rows.groupBy("comp").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first")))
    later = rows.join(firsts.where("rows > 1"), "comp").where(~F.col("doc_id").eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("gone"))
    vague = durable(stored.where("part is null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 or doc_id is null").select(F.col("doc_id").alias("gone")))
    gone = durable(later.unionByName(vague).distinct())
    kept = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone"]), "left_anti")
    if vague.isEmpty():
        return kept
    own = docs.join(vague, docs["doc_id"].cast("long").eqNullSafe(vague["gone"]), "left_semi")
    packed = own.select(F.struct(*[own[f"`{c}`"] for c in docs.columns]).alias("row"), own["doc_id"].cast("long").alias("id"), own["text"].alias("text"))

    def name_sets(batches):
        for batch in batches:
            keys, known = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for row, tokens in _sets(batch):
                keys[row], known[row] = set_key(tokens), True
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(keys, mask=~known)], names=["row", "id", "key"])

    named = packed.mapInArrow(name_sets, StructType([packed.schema["row"], packed.schema["id"], StructField("key", LongType())]))
    named = named.join(comps, F.col("key") == F.col("node"), "left").select("row", "id", F.coalesce("comp", "key").alias("comp"))
    chosen = named.join(firsts.select("comp", "first"), "comp").where(F.col("id").eqNullSafe(F.col("first"))).dropDuplicates(["comp"]).select("row.*")
    return kept.unionByName(chosen).unionByName(named.where("comp is null").select("row.*"))
