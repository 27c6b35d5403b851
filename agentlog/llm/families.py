"""Components of the links between group mates, without comparing all the pairs of a group.

Texts are sets of hashes; two are linked when 100 * common >= percent * all elements of the two. Groups may hold a third of
all texts. Let C be any set of hashes and D = set xor C. As |a xor b| = |Da| + |Db| - 2 |Da and Db|, two sets are linked
if and only if

    excess(a) + excess(b) <= 2 (100 + percent) |Da and Db|,   excess(x) = (100 + percent) |Dx| - (100 - percent) |x|.

So members are told by their differences from what most of the group shares:

* Where the sum isn't above zero they are linked whatever they differ in. All these links go over one member, the one
  of the least excess: if two satisfy it with each other, each of them does with that member.
* Any other link needs a common difference, and as many of them as the excesses say. A member goes to buckets of its first
  differences only, so many that two members with enough in common meet: what is its own before what it lacks.

Any part of hash space tells who can't be linked: in it two sets differ in no more elements than they do as a whole. So with
|Dx| counted in the part, and |x| as it is, the sum above leaves out no link. Of a family that is too large for one task,
centres' mates send a part of their sets first; those that may be linked by it send the whole.

A group of at most BLOCK members and TOKENS hashes is one block of a task's sparse product: C is what more than half of it
has, and the common differences of a member with all others are counted by an index of who has which. Only links that join
components are given out. A larger group is cut into buckets by difference: C is first the set of a member that most others
are like, then what more than half of the group has. At most half of such a group has any difference, so there is a last
level. Buckets whose members are in one component already are done.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlog.llm.common import written
from agentlog.llm.components import components

BLOCK, TOKENS = 4096, 1 << 20  # members and hashes (8 MB) that one task may take as a group
PART = 3 << 60  # the end of the part of hash space that members send first: 3/16 of it
BLOCKS = 8  # of hash space, in which the overlap of two sets is added up
SENT = 1 << 21  # ids that may be broadcast: 16 MB
ROWS_SENT = 1 << 19  # rows of a few columns that may be broadcast: some 50 MB


def _as_sets(lists: pa.Array) -> list[np.ndarray]:
    return [s.values.to_numpy().view(np.uint64) if s.is_valid else np.empty(0, np.uint64) for s in lists]


def overlap(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Number of common elements of two sorted sets, added up block by block of hash space; -1 as soon as what is left
    can't bring it to ``least``."""
    borders = np.arange(1, BLOCKS, dtype=np.uint64) << np.uint64(61)
    at = np.r_[0, np.searchsorted(a, borders), len(a)]
    bt = np.r_[0, np.searchsorted(b, borders), len(b)]
    both = 0
    for i in range(BLOCKS):
        if both + min(len(a) - at[i], len(b) - bt[i]) < least:
            return -1
        both += len(np.intersect1d(a[at[i] : at[i + 1]], b[bt[i] : bt[i + 1]], assume_unique=True))
    return both if both >= least else -1


def _linked(percent: int):
    """A function column: whether two sorted sets, ``n`` being the sum of their sizes, are alike enough. Given what the two
    have in one part of hash space only, whether they may be."""

    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array, n: pa.Array) -> pa.Array:
        found = []
        for x, y, size in zip(_as_sets(a), _as_sets(b), n.to_pylist(), strict=True):
            least = -(-((100 + percent) * (len(x) + len(y)) - (100 - percent) * size) // (2 * (100 + percent)))
            found.append(overlap(x, y, least) >= 0)
        return pa.array(found, pa.bool_())

    return linked


def _xor():
    """A function column: elements of just one of two sets, first those that the second one hasn't, each part sorted."""

    @F.arrow_udf("array<bigint>")
    def xor(a: pa.Array, b: pa.Array) -> pa.Array:
        both = zip(_as_sets(a), _as_sets(b), strict=True)
        found = [np.r_[np.setdiff1d(x, y), np.setdiff1d(y, x)] for x, y in both]
        ends = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
        values = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

    return xor


def sizes_allow(x: Column, y: Column, percent: int) -> Column:
    """Whether two sets of these sizes can be linked."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _only(sets: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """The sets of some ids, of which there are at most ``rows``: as long as these may be broadcast, others don't move."""
    return sets.join(F.broadcast(ids) if rows <= SENT else ids, "rep", "left_semi")


def sent(rows: DataFrame, n: int) -> DataFrame:
    """The rows, of which there are n, broadcast as long as they are few, so that the sets they are joined with don't move."""
    return F.broadcast(rows) if n <= ROWS_SENT else rows


def _with_sets(rows: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Rows (rep, others), of which there are at most n, with their sets as ``base``."""
    own = sets if n <= ROWS_SENT else _only(sets, rows.select("rep").distinct(), n)
    return own.select("rep", F.col("hashes").alias("base")).join(sent(rows, n), "rep")


def _part() -> Column:
    """What a set has in the first part of hash space."""
    return F.filter("hashes", lambda h: (h >= 0) & (h < PART))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that are linked, by their whole sets; pairs that a part of these rules out go before."""
    left = written(pairs, "pairs")
    for hashes in (_part(), F.col("hashes")):
        pairs, n = left, left.count()

        def side(end: str, name: str, size: str) -> DataFrame:
            own = _only(sets, pairs.select(F.col(end).alias("rep")).distinct(), n)
            return own.select(F.col("rep").alias(end), hashes.alias(name), F.size("hashes").alias(size))

        both = side("b", "hb", "nb").join(sent(pairs, n), "b").join(side("a", "ha", "na"), "a")
        left = written(both.where(_linked(percent)("ha", "hb", F.col("na") + F.col("nb"))).select("a", "b"), "links")
    return left


def _labelled(links: DataFrame) -> DataFrame:
    return written(components(links), "labels").select(F.col("node").alias("rep"), "label")


def _excess(diff: str, percent: int) -> Column:
    return ((100 + percent) * F.size(diff) - (100 - percent) * F.col("n")).cast("bigint")


def _least_shared(percent: int) -> Column:
    """How many differences a member shares at least with whatever it is linked to: all but those that the two sets together
    may have apart, (100 - percent) / (100 + percent) of their sizes' sum. The other's size is bounded by its own."""
    n = F.col("n")
    other = F.least(F.floor(100 * n / F.lit(percent)), F.col("most"))
    return (F.size("diff") - F.floor((100 - percent) * (n + other) / F.lit(100 + percent))).cast("bigint")


def _differences(members: DataFrame, percent: int) -> DataFrame:
    """(group, rep, n, base) as (group, rep, n, diff, excess): ``diff`` tells the base from what more than half of the
    group's bases have. Elements are counted on the map side first."""
    often = members.select("group", F.explode("base").alias("token")).groupBy("group", "token").agg(F.count("*").alias("often"))
    sizes = members.groupBy("group").agg(F.count("*").alias("size"))
    most = often.join(sizes, "group").where("2 * often > size").groupBy("group").agg(F.collect_list("token").alias("most"))
    diff = members.join(most, "group", "left").withColumn("diff", _xor()("base", "most"))
    return written(diff.select("group", "rep", "n", "diff", _excess("diff", percent).alias("excess")), "differences")


def _sub_buckets(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (bucket, group, rep, n, label, size, tokens): a group's members by difference, only where members of several
    components meet, an odd one among them.

    ``rows``: (group, rep, n, diff, excess, least, label, odd, low, odd_low, odd_least), ``low`` and ``odd_low`` being the
    least excess of all and of the odd ones. Two members that aren't both linked to the anchor share at least (their
    excesses' sum) / 2 (100 + percent) differences, and what ``least`` says of either. Differences are in one order for all
    members, what the group hasn't before what a member lacks of it. So one of those that two members share is among the
    first of either.
    """
    partner = F.when(F.col("odd"), F.col("low")).otherwise(F.col("odd_low"))
    by_excess = F.ceil((F.col("excess") + partner) / F.lit(2 * (100 + percent)))
    needed = F.greatest(F.lit(1), by_excess, F.col("least"), F.when(~F.col("odd"), F.col("odd_least")))
    own = ["group", "rep", "n", "label", "odd"]
    rows = rows.withColumn("reach", (F.size("diff") - needed + 1).cast("int")).where("reach > 0")
    tokens = rows.select(*own, F.size("diff").alias("width"), F.explode(F.slice("diff", 1, F.col("reach"))).alias("token"))
    name = F.md5(F.concat_ws("/", F.col("group"), F.col("token").cast("string")))
    near = written(tokens.select(name.alias("bucket"), *own, "width"), "sharing")
    use = near.groupBy("bucket").agg(
        F.count("*").alias("size"), F.sum("width").alias("tokens"), F.min("label").alias("x"), F.max("label").alias("y"), F.max("odd").alias("some")
    )
    use = use.where("x <> y AND some").select("bucket", "size", "tokens")
    return written(near.join(use, "bucket").drop("odd", "width"), "sub")


class Block:
    """A group's sets as an index, for counting what members have in common."""

    def __init__(self, bases: list[np.ndarray], sizes: np.ndarray, percent: int):
        m = len(bases)
        lengths = np.array([len(b) for b in bases])
        tokens, at = np.unique(np.concatenate([np.empty(0, np.uint64), *bases]), return_inverse=True)
        row = np.repeat(np.arange(m), lengths)
        common = np.flatnonzero(2 * np.bincount(at, minlength=len(tokens)) > m)
        place = np.full(len(tokens), -1)
        place[common] = np.arange(len(common))
        inside = place[at] >= 0
        has = np.zeros((m, len(common)), bool)
        has[row[inside], place[at[inside]]] = True
        lacking, lacked = np.nonzero(~has)
        rows, columns = np.r_[row[~inside], lacking], np.r_[at[~inside], common[lacked]]
        width = np.bincount(rows, minlength=m)
        self.factor = 2 * (100 + percent)
        self.excess = (100 + percent) * width - (100 - percent) * sizes
        # Differences by member, and members by difference.
        order = np.argsort(rows, kind="stable")
        self.columns, self.ends = columns[order], np.r_[0, np.cumsum(width)]
        order = np.argsort(columns, kind="stable")
        self.rows = rows[order]
        self.starts = np.r_[0, np.cumsum(np.bincount(columns, minlength=len(tokens)))]

    def linked(self, x: int) -> np.ndarray:
        """Whether each member is linked to member x."""
        own = self.columns[self.ends[x] : self.ends[x + 1]]
        own = own[self.starts[own + 1] - self.starts[own] > 1]
        mates = [self.rows[self.starts[c] : self.starts[c + 1]] for c in own]
        shared = np.bincount(np.concatenate([np.empty(0, np.int64), *mates]).astype(np.int64), minlength=len(self.excess))
        return self.excess + self.excess[x] <= self.factor * shared


def joined(bases: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links between members of different components, as many as join all that are linked, and the members' components
    then. Members of the largest excess come last in their component, so the anchor's component grows first and is then
    skipped."""
    block = Block(bases, sizes, percent)
    label = np.unique(labels, return_inverse=True)[1]
    out = []

    def join(x: int, near: np.ndarray) -> None:
        for other in np.unique(label[near]):
            if other != label[x]:
                out.append((x, int(np.flatnonzero(near & (label == other))[0])))
                label[label == other] = label[x]

    anchor = int(block.excess.argmin())
    join(anchor, block.linked(anchor))
    for x in np.flatnonzero(label != label[anchor]):
        if (label != label[x]).any() and label[x] != label[anchor]:
            join(x, block.linked(x) & (label != label[x]))
    return out, label


def joining_links(bases: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    return joined(bases, sizes, labels, percent)[0]


def _solved(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each group; rows (group, rep, n, label, base), groups within bounds."""

    def solve(group: pa.Table) -> pa.Table:
        reps = group["rep"].to_numpy()
        bases = _as_sets(group["base"].combine_chunks())
        found = joining_links(bases, group["n"].to_numpy(), group["label"].to_numpy(), percent)
        return pa.table({"a": pa.array([reps[x] for x, _ in found], pa.int64()), "b": pa.array([reps[y] for _, y in found], pa.int64())})

    return members.groupBy("group").applyInArrow(solve, "a bigint, b bigint")


def _possible(members: DataFrame, percent: int) -> DataFrame:
    """Rows (group, rep, n, label, base), ``base`` being a part of the set, as (group, rep, n, label): those that may be
    linked with members of other components, in groups between which there are no links."""

    def narrow(group: pa.Table) -> pa.Table:
        before = np.unique(group["label"].to_numpy(), return_inverse=True)[1]
        after = joined(_as_sets(group["base"].combine_chunks()), group["n"].to_numpy(), before, percent)[1]
        together, labels = np.unique(np.unique(np.stack([after, before]), axis=1)[0], return_counts=True)
        stays = np.flatnonzero(np.isin(after, together[labels > 1]))
        name = [f"{group['group'][0]}/{x}" for x in after[stays]]
        return pa.table({"group": pa.array(name, pa.string())} | {c: group[c].take(pa.array(stays)) for c in ("rep", "n", "label")})

    return members.groupBy("group").applyInArrow(narrow, "group string, rep bigint, n bigint, label bigint")


def _within_bounds(size: str = "size", tokens: str = "tokens") -> Column:
    return (F.col(size) <= BLOCK) & (F.col(tokens) <= TOKENS)


def components_within(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(rep, label): components of all links between bucket mates; who has no link is left out.

    ``rows`` is a written table (bucket, rep, n, copies) of buckets with several members, ``sets`` a written table (rep,
    hashes) of sorted sets. Each bucket is a star around the member that has most copies. What the stars connect is a
    family; one within bounds is a block, so each of its sets goes to one task, once. In larger families the stars' links are
    confirmed; buckets that this brings into one component are done, others of one centre go on together as a group.
    """
    one = F.struct("copies", -F.col("rep"))
    centres = rows.groupBy("bucket").agg(F.max_by(F.struct("rep", "n"), one).alias("c"), F.count("*").alias("size"))
    centres = centres.select("bucket", F.col("c.rep").alias("centre"), F.col("c.n").alias("nc"), "size")
    stars = written(rows.join(centres, "bucket"), "stars")
    mates = stars.where(F.col("rep") != F.col("centre")).select(F.col("centre").alias("a"), F.col("rep").alias("b"))
    family = _labelled(mates.distinct()).withColumnRenamed("label", "family")
    members = stars.select("rep", "n").distinct().join(family, "rep")
    sizes = members.groupBy("family").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"))
    members = written(members.join(sizes, "family"), "families")
    bounded = members.where(_within_bounds())
    block = bounded.select(F.col("family").cast("string").alias("group"), "rep", "n", F.col("rep").alias("label"))
    found = written(_solved(_with_sets(block, sets, bounded.count()), percent), "links")
    large = members.where(~_within_bounds())
    if large.isEmpty():
        return _labelled(found)
    stars = written(stars.join(large.select("rep"), "rep", "left_semi"), "stars")
    pairs = stars.where(F.col("rep") != F.col("centre")).where(sizes_allow(F.col("n"), F.col("nc"), percent))
    links = verified(pairs.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), sets, percent)
    links = written(links.union(found), "links")
    labels = _labelled(links)
    # Members of one centre over all its buckets, which are often the same.
    named = stars.where("size > 2").select("centre", "rep", "n").distinct().join(labels, "rep", "left")
    named = written(named.withColumn("label", F.coalesce("label", "rep")), "members")
    ends = named.groupBy("centre").agg(
        F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size"), F.sum("n").alias("tokens")
    )
    named = written(named.join(ends.where("x <> y").drop("x", "y"), "centre"), "groups")
    n = named.count()
    if not n:
        return labels
    group = F.col("centre").cast("string").alias("group")
    bounded = named.where(_within_bounds()).select(group, "rep", "n", "label")
    bounded = written(_possible(_with_sets(bounded, sets.withColumn("hashes", _part()), n), percent), "possible")
    found = _solved(_with_sets(bounded, sets, bounded.count()), percent)
    links = written(links.union(found), "links")
    large = named.where(~_within_bounds())
    if large.isEmpty():
        return _labelled(links)
    centre = _only(sets, large.select(F.col("centre").alias("rep")).distinct(), n).select(F.col("rep").alias("centre"), F.col("hashes").alias("most"))
    diffs = _with_sets(large, sets, n).join(centre, "centre").withColumn("diff", _xor()("base", "most"))
    diffs = written(diffs.select(group, "rep", "n", "diff", _excess("diff", percent).alias("excess")), "differences")
    while True:
        anchors = diffs.groupBy("group").agg(
            F.min("excess").alias("low"), F.min_by("rep", F.struct("excess", "rep")).alias("anchor"), F.max("n").alias("most")
        )
        diffs = written(diffs.join(anchors, "group").withColumn("least", _least_shared(percent)).drop("most"), "placed")
        joined = diffs.where((F.col("excess") + F.col("low") <= 0) & (F.col("rep") != F.col("anchor")))
        links = written(links.union(joined.select(F.col("anchor").alias("a"), F.col("rep").alias("b")).distinct()), "links")
        labels = _labelled(links)
        main = labels.select(F.col("rep").alias("anchor"), F.col("label").alias("main"))
        placed = diffs.join(labels, "rep", "left").join(main, "anchor", "left")
        placed = placed.withColumn("label", F.coalesce("label", "rep"))
        placed = placed.withColumn("odd", F.col("label") != F.coalesce("main", "anchor")).drop("main")
        placed = written(placed, "placed")
        odd = placed.where("odd").groupBy("group").agg(F.min("excess").alias("odd_low"), F.min("least").alias("odd_least"))
        sub = _sub_buckets(placed.join(odd, "group"), percent)
        if sub.isEmpty():
            return labels
        members = sub.join(diffs.select("group", "rep", F.col("diff").alias("base")), ["group", "rep"])
        members = members.select(F.col("bucket").alias("group"), "rep", "n", "label", "base", "size", "tokens")
        bounded = members.where(_within_bounds()).drop("size", "tokens")
        links = written(links.union(_solved(bounded, percent)), "links")
        large = members.where(~_within_bounds())
        if large.isEmpty():
            return _labelled(links)
        diffs = _differences(large, percent)
