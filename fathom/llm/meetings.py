"""Links among the members of signature groups, without comparing all pairs of a group.

Both set joins (``ngram_join``, ``minhash``) give each document a list of signatures that linked documents are to have in
common. ``resolve`` takes it from there: documents of the same words are one class of copies, which one member stands for;
in each group of a signature one member, the leader, meets the others (a star: a group of m gives m - 1 pairs); pairs that
their sizes or bitmaps rule out are dropped; the rest is verified on full sets and joined to components. Groups whose
members are not all of one component go on: those outside the group's largest component, if they are BLOCK at most, meet all
the others at once; of other groups more and more members meet the rest in rounds, until no group holds two components
that have not met. Each such round is done twice: first a task names the pairs that would join its components, as most of
those link, and all others of a group where these are few beside its members; the rest of the groups are tagged with the new components and name all that are left. So a group of many
copies or near copies costs about as many comparisons of texts as it has members, and no link between different texts of one group is lost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm._storage import discard, kept, salted_join
from fathom.llm._text import column_bytes, pieces, shingles, word_hashes
from fathom.llm.components import components

PERCENT = 80
#: 64-bit words of a set's bitmap.
WORDS = 32
#: Members of an open group that meet the rest in the first later round, and how many times as many in each next one.
FIRST, FASTER = 64, 16
#: Members that one task holds to meet others, and about how many others it meets.
BLOCK, PART = 1024, 2048
#: Pairs that would join no components are named at once if a group has so many times as many members in a task.
SPARE = 2
#: Places in a group are hashes below this number.
PLACES = 1 << 30


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """For each of 64 * WORDS hash values whether an odd number of the tokens has it. Where two bitmaps differ the sets do, so
    the number of differing bits is at most that of shingles in one set alone."""
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def difference(bits: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count((bits ^ other).view(np.uint64)).sum(axis=1, dtype=np.int64)  # of signed numbers it would count the absolute value's


def may_link(bits: np.ndarray, n: np.ndarray, other: np.ndarray, m: int, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of sizes n with these bitmaps can link with one of size m: their sizes and their bitmaps' difference allow it."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * difference(bits, other) <= (100 - percent) * (n + m))


class Joined:
    """Components that the pairs named so far of a group would join, and the other pairs, which are kept back."""

    def __init__(self) -> None:
        self.up, self.members, self.n, self.rest = {}, 0, 0, []

    def root(self, c: int) -> int:
        while (up := self.up.get(c, c)) != c:
            self.up[c] = c = self.up.get(up, up)
        return c

    def new(self, own: int, others: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Of members of the components ``others``, the nearest of each component that is not yet joined with ``own``, which they then are."""
        each, which = np.unique(others, return_inverse=True)
        roots, mine = np.array([self.root(c) for c in each.tolist()])[which], self.root(own)
        order = np.flatnonzero(roots != mine)
        order = order[np.argsort(near[order], kind="stable")]
        found, at = np.unique(roots[order], return_index=True)
        self.up |= dict.fromkeys(found.tolist(), mine)
        return order[at]

    def keep_back(self, one: int, others: np.ndarray) -> None:
        self.n += len(others)
        if self.n <= BLOCK + PART and len(others):
            self.rest.append((one, others))

    def end(self, sig: int) -> list[tuple[list, list]]:
        """The pairs kept back, if they are few beside the members; else (sig, null), which tells that there are such."""
        if self.n > min(self.members // SPARE, BLOCK + PART):
            return [([sig], [None])]
        return [([one] * len(others), others.tolist()) for one, others in self.rest]


def star_meetings(postings: DataFrame) -> DataFrame:
    """(sig, leader, id, leader_n, n) of groups of two or more, leader included: the least id of a group is found by a grouped
    minimum, and goes to each part that a large group's members are dealt to."""
    leaders = postings.groupBy("sig").agg(F.min("id").alias("leader"), F.min_by("n", "id").alias("leader_n"), F.count("*").alias("members"))
    leaders = kept(leaders.where("members > 1"), "leaders")
    return salted_join(postings, leaders, "sig", ["id"], n="members").select("sig", "leader", "id", "leader_n", "n")


def later_meetings(members: DataFrame, skip: int, most: int, joining: bool = False) -> DataFrame:
    """(a, b) within groups of members of several components; pairs of one component, or that sizes or bitmaps rule out, are left out.
    With ``joining`` a task names of a group the pairs that would join components not joined before, which are fewer than its
    members, and the others if they are few beside these, too; a row (sig, null) tells that others were kept back.

    members: sig, id, n, component, bits, size (rows of the group), main (its largest component), rest (rows outside that).
    Where ``rest`` is BLOCK at most, those rows meet all others. In other groups about ``most`` members meet those whose
    place comes after theirs; about ``skip`` have done so before. A place is a hash, so neither is a group sorted nor are
    places counted: with ``size`` members, those below skip / size have met the rest. A group is dealt as a grid: blocks
    of about BLOCK members that meet the rest, times parts of about PART members that are met, so that no task holds or reads a whole group."""
    size, place, few = F.col("size"), F.pmod(F.xxhash64("id", "sig"), F.lit(PLACES)), F.col("rest") <= BLOCK
    bound = lambda at: F.least(F.lit(PLACES).cast("long"), F.ceil(F.lit(float(at)) / size * PLACES).cast("long"))
    in_main = F.col("component") == F.col("main")
    rows = members.withColumn("place", F.when(few & in_main, F.lit(PLACES).cast("long")).otherwise(place)).where(few | (F.col("place") >= bound(skip)))
    meets = F.when(few, ~in_main).otherwise(F.col("place") < bound(skip + most))
    blocks, parts = F.when(few, 1).otherwise(F.ceil(F.least(F.lit(most), size) / BLOCK)).cast("int"), F.ceil(size / PART).cast("int")
    which = lambda seed, of: F.pmod(F.xxhash64("id", F.lit(seed)), of).cast("int")
    columns = ["sig", "block", "part", "met", "id", "n", "component", "place", "bits"]
    held = rows.where(meets).withColumns({"block": which(1, blocks), "part": F.explode(F.sequence(F.lit(0), parts - 1)), "met": F.lit(False)})
    met = rows.withColumns({"part": which(2, parts), "block": F.explode(F.sequence(F.lit(0), blocks - 1)), "met": F.lit(True)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, joined = None, [], Joined()  # id, n, component, place, bits
        made = lambda pairs: pa.RecordBatch.from_arrays([pa.array([x for p in pairs for x in p[i]], pa.int64()) for i in (0, 1)], ["a", "b"])
        for batch in batches:
            group = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1).astype(np.int64)
            others = batch.column(3).to_numpy(zero_copy_only=False)
            ids, n, component, places = (batch.column(i).to_numpy() for i in range(4, 8))
            bits = batch.column(8).flatten().to_numpy().reshape(-1, WORDS)
            a_out, b_out, back = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            edges = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)]) if len(ids) else []
            for low, high in zip(edges, [*edges[1:], len(ids)], strict=True):
                if tuple(group[low]) != now:
                    back += joined.end(now[0]) if now else []
                    now, mine, joined = tuple(group[low].tolist()), [], Joined()
                joined.members += int(high - low)
                first = low + int(np.searchsorted(others[low:high], True))
                mine += [(ids[i], n[i], component[i], places[i], bits[i]) for i in range(low, first)]
                for one, m, c, p, own in mine if first < high else ():
                    at = slice(first, high)
                    ok = (component[at] != c) & ((places[at] > p) | ((places[at] == p) & (ids[at] > one)))
                    if ok.any():
                        ok[ok] = may_link(bits[at][ok], n[at][ok].astype(np.int64), own, int(m))
                        found = first + np.flatnonzero(ok)
                        if joining and len(found):
                            picked = joined.new(int(c), component[found], difference(bits[found], own) / (n[found] + m))
                            joined.keep_back(int(one), ids[np.delete(found, picked)])
                            found = found[picked]
                        a_out.append(np.full(len(found), one))
                        b_out.append(ids[found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a_out, b_out)], ["a", "b"])
            yield made(back)
        yield made(joined.end(now[0]) if now else [])

    both = held.select(*columns).unionByName(met.select(*columns))
    order = both.repartition("sig", "block", "part").sortWithinPartitions("sig", "block", "part", "met")
    return order.mapInArrow(work, "a long, b long")


def likely(pairs: DataFrame, own: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps do not rule out. own: id, n, bits."""
    a, b = (own.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = pairs.join(a, "a").join(b, "b")
    return both.where((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct()


#: Documents of pairs up to which a table of their hashes, one number each, goes to all tasks; texts of more are shuffled.
FEW = 1 << 17
#: Pairs of one document beyond which they are dealt to several tasks.
HOT = 1000


def verified(pairs: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = 5) -> DataFrame:
    """The pairs (a, b) that link by their sets of k-word shingles. Each b's text is sent to a's; a document of many pairs is sent to each of the tasks that they are dealt to."""
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).where("id IS NOT NULL")
    ids = pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct()).distinct()
    if ids.count() <= FEW:  # texts that no pair asks for are dropped where they are read
        bucket = F.pmod(F.xxhash64("id"), F.lit(8 * FEW)).alias("bucket")
        own = own.withColumn("bucket", bucket).join(F.broadcast(ids.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")
    count = pairs.groupBy("a").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / HOT).cast("int")
    dealt = pairs.join(count, "a").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    others = dealt.join(own, F.col("b") == F.col("id")).select("a", "part", "b", "t")
    firsts = count.join(own, F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "t")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, firsts_ = None, []
        for batch in batches:
            data, offsets = column_bytes(batch.column(3))
            a_col, p_col, b_col = (batch.column(i).to_pylist() for i in range(3))
            a_out, b_out = [], []
            for low, high in pieces(offsets):
                hashes, bounds = shingles(*word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]), k)
                for row in range(low, high):
                    mine = np.unique(hashes[bounds[row - low] : bounds[row - low + 1]])
                    if (a_col[row], p_col[row]) != now:
                        now, firsts_ = (a_col[row], p_col[row]), []
                    if b_col[row] is None:
                        firsts_.append(mine)
                        continue
                    for first in firsts_:
                        both = len(np.intersect1d(first, mine, assume_unique=True))
                        if both and 100 * both >= percent * (len(first) + len(mine) - both):
                            a_out.append(a_col[row])
                            b_out.append(b_col[row])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    order = firsts.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return order.mapInArrow(work, "a long, b long")


def same_id(sign: DataFrame, copies: DataFrame) -> DataFrame:
    """Links (a, b) between classes of copies that one document is in by several texts: its id need not stand for any of them."""
    inside = sign.where("n > 0 AND id IS NOT NULL").select("id", "h1", "h2")
    several = inside.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).where("x <> y").select("id")
    classes_ = inside.join(several, "id", "left_semi").join(copies, ["h1", "h2"]).select("id", "first").distinct()
    return classes_.join(classes_.groupBy("id").agg(F.min("first").alias("a")), "id").where("first <> a").select("a", F.col("first").alias("b"))


def resolve(sign: DataFrame, docs: DataFrame, meet: Callable[[DataFrame], DataFrame] = star_meetings, k: int = 5, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(``key``, n_shingles, component_id) for every row of ``sign``: id, h1, h2 (a digest of the words), n (the size of the
    set of k-word shingles), bits, sigs. meet: makes (sig, leader, id, leader_n, n)
    of postings (id, n, sig). ``sign``, if it is a table made by ``kept``, is removed as soon as what is needed of it has been
    written: signatures are most of its bytes, and only ``meet`` reads them."""
    copies = kept(sign.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("first")), "copies")
    reps = copies.where("first IS NOT NULL").select(F.col("first").alias("id")).distinct()
    alone = kept(sign.join(reps, "id", "left_semi").select("id", "n", "bits", "sigs"), "alone")
    named = kept(sign.select("id", "h1", "h2", "n"), "named")
    discard(sign)
    met = kept(meet(alone.select("id", "n", F.explode("sigs").alias("sig"))), "met")
    own = kept(alone.drop("sigs"), "own")
    discard(alone)
    close = (F.col("leader") != F.col("id")) & (100 * F.least("leader_n", "n") >= percent * F.greatest("leader_n", "n"))
    pairs = met.where(close).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    tried = kept(likely(pairs, own, percent), "pairs")
    label = components(verified(tried, docs, key, text, percent, k).unionByName(same_id(named, copies)))
    discard(tried)
    members, skip, most, opened = met.select("sig", "id", F.lit(0).alias("size")), 0, FIRST, None
    # Sums tell how often an id is in a group, which an xor does not; those of half a hash cannot overflow.
    halves = [F.sum(f(F.xxhash64("id", *more))).alias(f"{c}{j}") for c, more in (("h", []), ("i", [F.lit(1)])) for j, f in enumerate((lambda x: F.shiftright(x, 32), lambda x: x.bitwiseAND(0xFFFFFFFF)))]

    def several(members: DataFrame, first: bool) -> DataFrame:
        """Members of the groups of several components, with those, and of groups with the same members those of one."""
        tagged = members.join(label, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("component"), "size")
        each = tagged.groupBy("sig", "component").agg(F.count("*").alias("n"), F.max("size").alias("size"), *halves)
        size = F.sum("n") if first else F.max("size")  # a group's size stays that of the first round, as places depend on it
        seen = each.groupBy("sig").agg(F.count("*").alias("parts"), size.alias("size"), F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("h0", "h1", "i0", "i1")])
        open_ = seen.where((F.col("parts") > 1) & (F.col("size") > skip))
        open_ = open_.groupBy("size", "h0", "h1", "i0", "i1").agg(F.min(F.struct("sig", F.col("top.component").alias("main"), (F.col("n") - F.col("top.n")).alias("rest"))).alias("g"))  # of groups with the same members one
        return kept(tagged.drop("size").join(open_.select("size", "g.*"), "sig").distinct(), "open")

    def meet_on(tagged: DataFrame, joining: bool) -> DataFrame:
        found = later_meetings(tagged.join(own.select("id", "n", "bits"), "id"), skip, most, joining)
        low, high = F.when(F.col("b").isNull(), F.col("a")).otherwise(F.least("a", "b")), F.when(F.col("b").isNotNull(), F.greatest("a", "b"))
        return found.select(low.alias("a"), high.alias("b")).distinct()

    def joined_by(fresh: DataFrame) -> DataFrame:
        """The components, with the links among the pairs ``fresh``."""
        pairs = fresh.where("b IS NOT NULL")
        if pairs.isEmpty():
            return label
        found = components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(verified(pairs, docs, key, text, percent, k)))
        discard(label)
        return found

    while True:
        tagged = several(members, opened is None)
        discard(opened, met if opened is None else None)
        opened = tagged
        if tagged.isEmpty():
            break
        fresh = kept(meet_on(tagged, True), "pairs")
        label = joined_by(fresh)
        back = fresh.where("b IS NULL").select(F.col("a").alias("sig")).distinct()
        if not back.isEmpty():
            again = several(tagged.select("sig", "id", "size").join(back, "sig", "left_semi"), False)
            rest = kept(meet_on(again, False).join(fresh, ["a", "b"], "left_anti"), "pairs")  # without those that did not link
            label = joined_by(rest)
            discard(again, rest)
        discard(fresh)
        members, skip, most = tagged.where(F.col("rest") > BLOCK).select("sig", "id", "size"), skip + most, most * FASTER
    named = named.join(copies, ["h1", "h2"], "left").join(label.withColumnRenamed("id", "first"), "first", "left")
    component = F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.coalesce("component", "first"))
    return named.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
