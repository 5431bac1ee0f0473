"""SimHash near-dedup with pigeonring filtering, and connected components of the links.

A fingerprint's 64 bits are cut into `tau + 1` segments on a ring. If two fingerprints differ in at most tau bits, then from
some segment on every run of l consecutive segments differs in at most l - 1 bits (the pigeonring principle): the
first is equal and the second differs in one bit or none. So each distinct fingerprint is indexed under (start, first
segment, second segment) and probes each key with the second segment as it is and with each of its bits
flipped: rows grow with the fingerprints, and a key has 26 bits. A match must hold the budgets of the longer runs, start
with the pair's first such segment, and pass the full Hamming check.

Copies count once: fingerprints are grouped before the search, which works on distinct fingerprints, and members are joined back.
A group of near copies isn't searched for all its pairs: fingerprints are first linked to a few representatives of each key, and
the search then looks only for links between the components that these links leave.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .common import Rows, checkpointed, discard, join_small, spread, stored, table

SHINGLE, TAU, SEED = 4, 4, 42
#: Copies of the smaller side of a join whose key may be hot.
SALTS = 16
#: Representatives of each key; distinct fingerprints above which a component counts as big.
STARS, BIG = 3, 64
#: Fingerprints of a key above which the third segment is looked up too.
CROWDED = 256
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash, as a signed number; 0 for a null text or one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = xxh64_digest(whole, SEED)
    else:
        ends = list(accumulate(map(len, words)))
        starts = [0, *(e + i for i, e in enumerate(ends, 1))]
        hashes = b"".join([xxh64_digest(whole[a:b], SEED) for a, b in zip(starts, (e + i + SHINGLE - 1 for i, e in enumerate(ends[SHINGLE - 1 :])), strict=False)])
    n = len(hashes) // 8
    ones = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(text: Column) -> Column:
    @F.pandas_udf("long")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fingerprint(t) for t in s], dtype="int64")

    return made(text)


def segments(tau: int, bits: int = 64) -> list[tuple[int, int]]:
    """(offset, width) of tau + 1 segments that differ by one bit at most."""
    m = tau + 1
    widths = [bits // m + (i < bits % m) for i in range(m)]
    return list(zip(accumulate([0, *widths[:-1]]), widths, strict=True))


def cut(value: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(value, offset).bitwiseAND(F.lit((1 << width) - 1))


def first_start(xor: Column, tau: int) -> Column:
    """The first segment from which the runs keep their budgets; null if there is none."""
    parts = segments(tau)
    d = [F.bit_count(cut(xor, *p)) for p in parts]
    m, cases = len(parts), F
    for i in range(m):
        run, holds = d[i], d[i] == 0
        for l in range(2, m + 1):
            run = run + d[(i + l - 1) % m]
            holds = holds & (run <= l * tau // m)
        cases = cases.when(holds, i)
    return cases


def ring_key(fp: Column, i: int, tau: int) -> Column:
    """Start segment, its bits, and the bits of the next segment, as one number."""
    parts = segments(tau)
    span = max(w for _, w in parts)
    return F.shiftleft(F.lit(i).cast("long") * (1 << span) + cut(fp, *parts[i]), span) + cut(fp, *parts[(i + 1) % len(parts)])


def indexed(prints: DataFrame, tau: int) -> DataFrame:
    return prints.select("*", F.explode(F.array(*[ring_key(F.col("fp"), i, tau) for i in range(tau + 1)])).alias("key"))


def star_links(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """Links (a, b) of each fingerprint to a few that stand for its keys, if they are near; linear in the fingerprints."""
    keyed = indexed(prints, tau)
    chosen = [F.min(F.struct(F.xxhash64("fp", F.lit(seed)).alias("h"), "fp", "id")) for seed in range(STARS)]
    marks = keyed.groupBy("key").agg(F.count("*").alias("n"), F.array_distinct(F.array(*chosen)).alias("marks")).filter("n > 1").select("key", F.explode("marks").alias("mark"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("mark.fp"))) <= tau
    return keyed.join(marks, "key").filter(near & (F.col("id") != F.col("mark.id"))).select(F.col("id").alias("a"), F.col("mark.id").alias("b"))


def cross_links(labelled: DataFrame, tau: int = TAU) -> DataFrame:
    """Pairs (a, b) of components that a link between fingerprints joins. `labelled`: id, fp, component, big.

    Fingerprints of one component never meet: a probe enters a key's big and small sides only if they hold other components, and
    of two fingerprints in a small and a big component the small one's probes. A side with more than `CROWDED` fingerprints is looked up by the
    third segment as well, with what the budget of three segments leaves for it, so that a crowded key isn't a square of pairs.
    """
    parts = segments(tau)
    span = max(w for _, w in parts)
    fp, xor, start = F.col("fp"), F.col("fp").bitwiseXOR(F.col("fp_b")), F.shiftright("key", 2 * span)

    def segment(k: int) -> Column:
        """The k-th segment after a key's start."""
        cases = F
        for i in range(tau + 1):
            cases = cases.when(start == i, cut(fp, *parts[(i + k) % len(parts)]))
        return cases

    index = indexed(labelled, tau)
    large, small = F.when(F.col("big"), F.col("component")), F.when(~F.col("big"), F.col("component"))
    most = F.lit(CROWDED if tau > 1 else 1 << 62)
    held = index.groupBy("key").agg(F.min(large).alias("l0"), F.max(large).alias("l1"), F.min(small).alias("s0"), F.max(small).alias("s1"), (F.count(large) > most).alias("l_full"), (F.count(small) > most).alias("s_full"))
    flips = [ring_key(fp, i, tau) for i in range(tau + 1)]
    flips += [k.bitwiseXOR(F.lit(1 << b)) for i, k in enumerate(flips) for b in range(parts[(i + 1) % len(parts)][1])]
    mine = F.col("component")
    others = lambda low, high: low.isNotNull() & ((low != mine) | (high != mine))
    into_big, into_small = others(F.col("l0"), F.col("l1")), ~F.col("big") & others(F.col("s0"), F.col("s1"))
    probes = labelled.select("*", F.explode(F.array(*flips)).alias("key")).join(held, "key").filter(into_big | into_small)
    sides = F.array(F.when(into_big, F.struct(F.lit(True).alias("side"), F.col("l_full").alias("full"))), F.when(into_small, F.struct(F.lit(False).alias("side"), F.col("s_full").alias("full"))))
    probes = probes.select("key", "fp", "component", "big", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("x")).select("key", "fp", "component", "big", "x.*")
    # what a third segment may differ in: two bits, or one if the second differs in one already
    masks = [0, *(1 << b for b in range(span)), *((1 << b) | (1 << c) for b in range(span) for c in range(b))]
    near = lambda n: F.transform(F.array(*[F.lit(x).cast("long") for x in masks[:n]]), lambda m: segment(2).bitwiseXOR(m))
    same = segment(1) == F.col("key").bitwiseAND(F.lit((1 << span) - 1))
    looked = F.when(~F.col("full"), F.array(F.lit(-1).cast("long"))).when(same, near(len(masks))).otherwise(near(span + 1))
    probes = probes.select("key", "fp", "component", "big", "side", F.explode(looked).alias("fine"))
    full = F.when(F.col("big"), F.col("l_full")).otherwise(F.col("s_full"))
    entries = index.join(held.select("key", "l_full", "s_full"), "key").select("key", F.col("big").alias("side"), F.when(full, segment(2)).otherwise(F.lit(-1).cast("long")).alias("fine"), F.col("fp").alias("fp_b"), F.col("component").alias("other"))
    chain = first_start(xor, tau) == start
    once = (F.col("big") != F.col("side")) | (F.col("fp") < F.col("fp_b"))
    found = probes.join(entries, ["key", "side", "fine"]).filter((mine != F.col("other")) & once & chain & (F.bit_count(xor) <= tau))
    return found.select(F.least(mine, "other").alias("a"), F.greatest(mine, "other").alias("b")).distinct()


def moved_to(edges: DataFrame, turn: int) -> DataFrame:
    """(id, to) of every node that goes over to another: two steps along the pointers to the first of itself and its neighbours.

    First is the smallest id in even turns, the smallest hash of id and turn in odd ones.
    """
    rank = lambda c: F.col(c) if turn % 2 == 0 else F.xxhash64(c, F.lit(turn))
    both = edges.select("a", "b").union(edges.select("b", "a"))
    best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("id"))).alias("m"))
    own = F.struct(rank("a").alias("rank"), F.col("a").alias("id"))
    step = best.filter(F.col("m") < own).select(F.col("a").alias("id"), F.col("m.id").alias("to"))
    then = step.select(F.col("id").alias("to"), F.col("to").alias("then"))
    return stored(step.join(then, "to", "left").select("id", F.coalesce("then", "to").alias("to")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over `edges` (a, b), for every id that has one.

    Contraction: in each round nodes go over to others of their component, and only edges between different remaining nodes are kept.
    A round by hashes leaves at most three quarters of the nodes that have edges in expectation, whatever the graph, so the number of rounds
    grows with the logarithm of the nodes and the tables of all rounds together with the nodes; a round by ids folds a star at once.
    """
    ordered = lambda e: e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, steps = stored(ordered(edges)), []
    while not left.isEmpty():
        steps.append(step := moved_to(left, len(steps)))
        ends = left
        for end in ("a", "b"):
            ends = ends.join(step.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        done, left = left, stored(ordered(ends))
        discard(done)
    if not steps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = steps.pop()
    while steps:  # a later round's move of a node that moved before is that of others that had come to it
        step, later = steps.pop(), found.select(F.col("id").alias("to"), F.col("to").alias("last"))
        whole = step.join(later, "to", "left").select("id", F.coalesce("last", "to").alias("to")).unionByName(found.join(step, "id", "left_anti"))
        done, found = found, stored(whole)
        discard(done), discard(step)
    lowest = stored(found.groupBy("to").agg(F.min("id").alias("low")).select("to", F.least("to", "low").alias("component")))
    return join_small(found.join(lowest, found["id"] == lowest["to"], "left_anti"), lowest, ["to"], "id").select("id", "component").unionByName(lowest.select(F.col("to").alias("id"), "component"))


def linked_components(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """(id, component) of every fingerprint that links to another. `prints`: id, fp, both distinct, checkpointed.

    First, fingerprints are linked to a few representatives of their keys; then only links between different components
    are looked for, so the links inside a group of near copies are never listed.
    """
    stars = components(star_links(prints, tau))
    sizes = stars.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") > BIG).select("component", F.lit(True).alias("big"))
    labelled = prints.join(stars, "id", "left").select("id", "fp", F.coalesce("component", "id").alias("component")).join(sizes, "component", "left").select("id", "fp", "component", F.coalesce("big", F.lit(False)).alias("big"))
    joined = components(cross_links(checkpointed(spread(labelled, "id")), tau)).select(F.col("id").alias("component"), F.col("component").alias("lowest"))
    ends = stars.unionByName(joined.select(F.col("component").alias("id"), "component")).groupBy("id").agg(F.min("component").alias("component"))
    return ends.join(joined, "component", "left").select("id", F.coalesce("lowest", "component").alias("component"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", tau: int = TAU) -> DataFrame:
    """doc_id, fingerprint and component_id of every row.

    Defined results: a text without words has fingerprint zero and links like any other; a null id takes part in no
    link, and gets the smallest id that has its fingerprint, if any; repeated rows give repeated rows.
    """
    rows = Rows(docs)
    rows.must_be_integer(key)
    prints = checkpointed(rows.df.select(rows.col(key).cast("long").alias("doc_id"), fingerprints(rows.col(text)).alias("fp")))
    groups = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    linked = linked_components(groups.filter("id IS NOT NULL").select("id", "fp"), tau)
    # only fingerprints with several rows or with links differ from "its own component"
    shared = groups.join(linked, "id", "left").filter("n > 1 OR component IS NOT NULL").select("fp", F.coalesce("component", "id").alias("component"))
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted_rows = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted_rows.join(salted, ["fp", "salt"], "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id"))


def lost_rows(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """The distinct (doc_id, fp) of `prints`, which is checkpointed, whose component holds one that stays.

    Fingerprints are the nodes, so rows with one id or none stand each for their own text. Of a component the smallest id stays,
    with its smallest fingerprint; a row without an id only if no row of the component has one.
    """
    groups = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    linked = linked_components(groups.select(F.col("fp").alias("id"), "fp"), tau).withColumnRenamed("id", "fp")
    shared = groups.join(linked, "fp", "left").filter("n > 1 OR component IS NOT NULL").select("fp", F.coalesce("component", "fp").alias("component"), F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "fp").alias("first"))
    shared = checkpointed(shared)
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    stays = shared.groupBy("component").agg(F.min("first").alias("stays")).withColumn("salt", copies)
    known = shared.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(stays, ["component", "salt"]).select("fp", "stays").withColumn("salt", copies)
    pairs = prints.distinct().withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(known, ["fp", "salt"])
    return pairs.filter(~(F.col("doc_id").eqNullSafe(F.col("stays.id")) & (F.col("fp") == F.col("stays.fp")))).select("doc_id", "fp")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` with one row, that of the smallest id, of every group of near-duplicates; columns of any names pass.

    Rows are told apart by id and fingerprint: of repeated rows one stays, rows that share an id but not their text stay unless their
    own text is a near-duplicate; a row without an id stays if no other row has its fingerprint or a link to it, and of a group of
    such rows only one stays.
    """
    rows = Rows(docs)
    rows.must_be_integer(key)
    given, own = rows.df, rows.name(key)
    prints = checkpointed(given.select(F.col(own).cast("long").alias("doc_id"), fingerprints(rows.col(text)).alias("fp")))
    lost = checkpointed(lost_rows(prints))
    # an id on several rows, or none, doesn't tell a row: only for these is the fingerprint made again
    twice = checkpointed(prints.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("twice")))
    several, nameless = not twice.isEmpty(), not prints.filter("doc_id IS NULL").isEmpty()
    losers = lost.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("lost"))
    if several:
        losers = losers.join(twice, losers["lost"] == twice["twice"], "left_anti")
    kept = given.join(losers, given[own] == losers["lost"], "left_anti")
    if not several and not nameless:
        return rows.restored(kept)
    odd = given.filter(F.col(own).isNull())
    if several:
        odd = odd.unionByName(given.join(twice, given[own] == twice["twice"], "left_semi"))
        kept = kept.join(twice, kept[own] == twice["twice"], "left_anti")
    gone = lost.select(F.col("doc_id").alias("gone"), F.col("fp").alias("gone_fp"))
    odd = odd.withColumn("fp", fingerprints(rows.col(text))).dropDuplicates([own, "fp"])
    odd = odd.join(gone, (F.col("fp") == F.col("gone_fp")) & F.col(own).eqNullSafe(F.col("gone")), "left_anti").drop("fp")
    return rows.restored(kept.filter(F.col(own).isNotNull()).unionByName(odd))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
