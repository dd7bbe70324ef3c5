"""Near-duplicate groups by a chosen-path set similarity join (operator 3).

Texts with equal shingle sets form one class, made by grouping on a 128-bit hash of the set; from then on only classes are
compared. Several independent trees branch the classes: at the root of each tree by one minwise token, and below it, in
nodes that are still too large, by ``BRANCHES`` more tokens that the node's own name chooses, so that all members choose
alike. A pair of similarity s stays together in one tree with probability s * (1 - (1 - s) ** BRANCHES) ** DEPTH at least;
there are as many trees as make a pair at the threshold be missed less than once in ``MISSED`` (see ``trees_for``).

Inside the nodes, pairs that are already connected aren't compared, and a large group of near copies costs rows in
proportion to its size:

1. *Stars.* Each node's members are held against its pivot, the member whose tokens most others share; the size of the
   intersection is counted on the full sets. Those of at least ``WIDE`` similarity are the pivot's group. Jaccard distance
   is a metric, so whatever is linked to a member that is closer by one link's distance (a settled member) lies in the
   group too. Members not settled get a second pivot. A member that has met a pivot of its node but not the one that
   settles its neighbours meets that one as well, so that one group, and not many, holds the near copies of a text.
2. *Differences.* Members of a group are told from its pivot, or in large groups from a member near the centre that has met
   all others, by the tokens that only one of them has, and two linked ones share many of these. In one order of a group's tokens, rare ones first, the first few differences of both must have one
   in common: an index on them finds every linked pair of members that the stars left in different components, and few
   others. Members that share a token first meet one of them, and the pairs still apart after that meet each other.
3. *Small nodes.* Members that no pivot settles are compared exhaustively within their node, by a sketch of 256 minwise
   tokens, two bits of each, inside the join's condition.

Each candidate is confirmed on the full sets. No group is gathered: joins are plain sort-merge joins on node, pivot or
token, which Spark splits where they are skewed.

Edge cases: a text of fewer words than a shingle is one shingle; a null, empty or blank text has an empty set and is
linked with nothing; a very long text is a long set; repeated rows share a component; of equally good pivots the one of
least id is taken, which changes no result; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm._store import Tables, free_name, if_small, written
from loomspark.llm._text import LOWER, SPACED_WORD, U64, mix, ngram_hash, pieces, run_hashes, runs, whole
from loomspark.llm.components import components

COORDINATES, SKETCH = 24, 256
BRANCHES, DEPTH, SMALL = 2, 2, 64
#: A pair at the threshold may be missed once in so many.
MISSED = 500_000
#: Members whose tokens tell where the centre of a group of twice as many or more is.
CENTRE = 32
#: Similarity to the pivot from which a member belongs to its group.
WIDE = 0.3
ROUNDS = 2
S = [f"s{i + 1}" for i in range(SKETCH // 32)]  # two bits of each minwise token
SKETCH_SCHEMA = "doc_id long, text_key long, n_shingles long, hi long, lo long, " + "".join(f"{c} long, " for c in S) + "roots array<int>, coordinates array<int>"


def trees_for(percent: int) -> int:
    s = percent / 100
    return math.ceil(math.log(1 / MISSED) / math.log(1 - s * (1 - (1 - s) ** BRANCHES) ** DEPTH)) if 0 < s < 1 else 1


def shingle_sets(d: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and the texts' offsets among them."""
    low = LOWER[d]
    member = SPACED_WORD[low]
    start, end, word_off = runs(member, off)
    words = run_hashes(low[member], end - start)
    lens = np.diff(word_off)
    at = [np.flatnonzero(whole(word_off, n))]
    hashes = [ngram_hash(words, n)[at[0]]]
    for m in range(1, n):
        if len(few := word_off[:-1][lens == m]):
            at.append(few)
            hashes.append(ngram_hash(words, m)[few])
    values = np.concatenate(hashes)
    doc = np.searchsorted(word_off, np.concatenate(at), "right") - 1
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[first], np.searchsorted(doc[first], np.arange(len(off)))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240607)
    return draw.integers(1, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1), draw.integers(1, 1 << 63, n, dtype=np.uint64)


def minima(values: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n minwise values of each set; the sets must not be empty."""
    out = np.empty((len(bounds) - 1, n), np.uint32)
    for j, (a, b) in enumerate(zip(*_multipliers(n), strict=True)):
        out[:, j] = np.minimum.reduceat(((values * a + b) >> U64(32)).astype(np.uint32), bounds[:-1])
    return out


def _sketch(n: int, trees: int):
    def run(batches):
        for batch in batches:
            for rows, d, off in pieces(batch.column(2)):
                values, bounds = shingle_sets(d, off, n)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                full = np.append(bounds[:-1][some], bounds[-1])
                hi, lo = np.zeros(len(size), U64), np.zeros(len(size), U64)
                low = np.zeros((len(size), trees + COORDINATES + SKETCH), np.uint32)
                if len(some):
                    hi[some], lo[some] = np.add.reduceat(mix(values), full[:-1]), np.add.reduceat(mix(values ^ U64(0xA5A5F00DCAFE1234)), full[:-1])
                    low[some] = minima(values, full, low.shape[1])
                two = ((low[:, trees + COORDINATES :] * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint8).reshape(len(size), SKETCH // 4, 4)
                bits = np.ascontiguousarray(two[..., 0] | two[..., 1] << 2 | two[..., 2] << 4 | two[..., 3] << 6).view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * w), pa.array(np.ascontiguousarray(low[:, a : a + w]).view(np.int32).ravel())) for a, w in ((0, trees), (trees, COORDINATES))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(1)[rows], pa.array(size.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in (hi, lo)), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(S))), *lists], ["doc_id", "text_key", "n_shingles", "hi", "lo", *S, "roots", "coordinates"])

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            for rows, d, off in pieces(batch.column(1)):
                values, bounds = shingle_sets(d, off, n)
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))], ["id", "items"])

    return run


def leaves(classes: DataFrame, tables: Tables) -> DataFrame:
    """(node, id, n, sketch, shared): the classes' places in nodes of two or more that are not branched further.

    shared counts the classes that share a root token with this one, tree by tree.
    """
    member = ["id", "n", *S]
    level = classes.select(*member, F.posexplode("roots").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), *member)
    found, shared = [], None
    for depth in range(DEPTH + 1):
        sizes = tables.written(level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "nodes")
        inside = level.join(sizes, "node")
        shared = shared or inside.groupBy("id").agg(F.sum("size").alias("shared"))
        if depth == DEPTH or not sizes.where(F.col("size") > SMALL).take(1):
            found.append(inside.select("node", *member))
            break
        found.append(inside.where(F.col("size") <= SMALL).select("node", *member))
        large = inside.where(F.col("size") > SMALL).select("node", *member).join(classes.select("id", "coordinates"), "id")
        branch = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BRANCHES - 1)), lambda j: F.xxhash64("node", j, F.get("coordinates", F.pmod(F.xxhash64("node", j), F.lit(COORDINATES)).cast("int")))))
        level = tables.written(large.select(*member, branch.alias("node")), "branches")
    return reduce(DataFrame.unionByName, found).join(shared, "id")


def _at_most(similarity: float) -> int:
    """Differing sketch tokens that all but a few of 100,000 pairs of this similarity stay within."""
    differ = 0.75 * (1 - similarity)
    return int(SKETCH * differ + 4 * (SKETCH * differ * (1 - differ)) ** 0.5)


def _passes(similarity: float):
    """Whether the sketches and sizes of a and b allow this similarity."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    apart = [a(c).bitwiseXOR(b(c)) for c in S]
    bits = reduce(lambda x, y: x + y, (F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))) for x in apart))
    return (bits <= _at_most(similarity)) & (F.least(a("n"), b("n")) >= F.greatest(a("n"), b("n")) * F.lit(similarity - 1e-9))


def central_members(group: DataFrame, sets: DataFrame, tables: Tables) -> DataFrame:
    """pivot and ref, the member nearest to the group's centre, of groups of at least twice ``CENTRE`` members.

    The centre is made of the tokens that most of some CENTRE members have. Whichever member is ref, the same links are found;
    one near the centre leaves fewer differences to look at.
    """
    large = group.where(F.col("members") >= 2 * CENTRE).select("pivot", "id", "members")
    some = large.where(F.pmod(F.xxhash64("pivot", "id"), F.lit(1 << 30)) * F.col("members") < CENTRE << 30)
    tokens = some.join(sets, "id").select("pivot", F.explode("items").alias("token")).groupBy("pivot", "token").agg(F.count("*").alias("held"))
    centre = tokens.join(some.groupBy("pivot").agg(F.count("*").alias("drawn")), "pivot").where("2 * held > drawn").groupBy("pivot").agg(F.collect_list("token").alias("centre"))
    off = F.size(F.array_except("items", "centre")) + F.size(F.array_except("centre", "items"))
    apart = large.join(sets, "id").join(tables.written(centre, "centres"), "pivot").select("pivot", off.alias("off"), "id")
    return tables.written(apart, "off-centre").groupBy("pivot").agg(F.min(F.struct("off", "id")).alias("m")).select("pivot", F.col("m.id").alias("ref"))


def difference_places(group: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """An index of the differences of a group's members from a member ref: the columns of group, size, token, kind and more.

    A group has the columns pivot, ref, id, n, n_ref, apart (not connected with ref), root. Of x, size d(x) is counted; two
    members x, y, one of them apart, are linked only if d(x) and d(y) share ``needed`` tokens, so in one order of the tokens
    (what ref lacks first, rare ones before others) the first d - needed + 1 of both have one in common. Only tokens at
    places that some partner can ask for are listed.
    """
    own, other = sets.select("id", F.col("items").alias("x")), sets.select(F.col("id").alias("ref"), F.col("items").alias("p"))
    member = ["pivot", "id", "n", "root", "apart"]
    rows = group.join(own, "id").join(other, "ref")
    rows = rows.select(*member, "n_ref", F.array_except("x", "p").alias("more"), F.array_except("p", "x").alias("less"))
    rows = rows.withColumn("size", F.size("more") + F.size("less"))
    far, near = 100 + percent, 100 - percent
    least = F.greatest(
        F.lit(1),
        F.col("size") - F.floor(F.col("n") * near / percent + 1e-9),
        F.when(F.col("apart"), 1).otherwise(F.floor((F.col("size") - F.greatest(F.lit(0), F.col("n") - F.col("n_ref")) * near / far) / 2 - 1e-9)),
    )
    rows = rows.withColumn("last", F.col("size") - least + 1).where(F.col("last") >= 1)
    # What the member lacks stands after what it has besides, and is listed only as far as places go.
    listed = F.expr("concat(transform(more, t -> struct(0 as kind, t as token)), transform(slice(array_sort(less), 1, cast(greatest(0, last - size(more)) as int)), t -> struct(1 as kind, t as token)))")
    rows = rows.select(*member, "size", "last", F.size("more").alias("head"), listed.alias("listed"))
    return rows.select(*member, "size", "last", "head", F.explode("listed").alias("t")).select(*member, "size", "last", "head", "t.kind", "t.token")


def placed_differences(rows: DataFrame, tables: Tables) -> DataFrame:
    """The rows of difference_places at their places, without what no member of another component lists."""
    common = tables.written(rows.groupBy("pivot", "token").agg(F.count("*").alias("often")).where("often > 1"), "common-differences")
    # Tokens that no other member has come first and never match: they only count as places.
    shared = tables.written(rows.where("kind = 0").join(common, ["pivot", "token"]), "shared-differences")
    mine = Window.partitionBy("pivot", "id")
    first = shared.withColumn("place", F.col("head") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("often", "token")))
    second = rows.where("kind = 1").withColumn("place", F.col("head") + F.row_number().over(mine.orderBy("token"))).join(common, ["pivot", "token"])
    columns = ["pivot", "id", "n", "root", "apart", "size", "token", "place"]
    return first.where("place <= last").select(*columns).unionByName(second.where("place <= last").select(*columns))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept of each document, linking those of at least ``percent`` similarity."""
    tables = Tables()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    place = F.coalesce("doc_id", F.lit(-1 << 63)).alias("place")  # null ids can be joined on
    sketches = tables.written(keyed.mapInArrow(_sketch(words, trees_for(percent)), SKETCH_SCHEMA), "sketches")
    classes = sketches.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(place, "text_key")).alias("one"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"), F.max(F.struct(*S, "roots", "coordinates")).alias("p"))
    classes = tables.written(classes.select(F.monotonically_increasing_id().alias("id"), "hi", "lo", "doc_id", "one.place", "one.text_key", "copies", "n", "p.*"), "classes")
    placed = tables.written(leaves(classes, tables), "leaves")

    limit = percent / 100
    settling = WIDE + (1 - limit)  # whatever is linked to a member this similar to a pivot is in the pivot's group
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    pair = [F.least(a("id"), b("id")).alias("u"), F.greatest(a("id"), b("id")).alias("v")]
    empty = lambda shape, name: tables.written(docs.sparkSession.createDataFrame([], shape), name)
    sets = empty("id long, items array<long>", "sets")
    known = empty("u long, v long, nu int, nv int, shared int", "known")

    def counted(pairs: DataFrame) -> DataFrame:
        """Pairs u, v with the sizes of their sets and of what they share, as a written table; adds them to known, and to sets what these lack."""
        nonlocal sets, known
        pairs = tables.written(pairs, "pairs")
        if not pairs.take(1):
            return known.limit(0)
        wanted = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct().join(sets.select("id"), "id", "left_anti")
        texts = keyed.select(place, "text_key", "text").join(wanted.join(classes.select("id", "place", "text_key"), "id"), ["place", "text_key"]).select("id", "text").dropDuplicates(["id"])
        sets = tables.grown(sets, texts.mapInArrow(_sets(words), "id long, items array<long>"))
        both = pairs.join(sets.select(F.col("id").alias("u"), F.col("items").alias("x")), "u").join(sets.select(F.col("id").alias("v"), F.col("items").alias("y")), "v")
        found = tables.written(both.select("u", "v", F.size("x").alias("nu"), F.size("y").alias("nv"), F.size(F.array_intersect("x", "y")).alias("shared")), "counted")
        known = tables.grown(known, found)
        return found

    linked = F.col("shared") * 100 >= (F.col("nu") + F.col("nv") - F.col("shared")) * percent
    similarity = F.col("shared") / (F.col("nu") + F.col("nv") - F.col("shared"))
    links = roots = None

    def merged(found: DataFrame) -> None:
        """Adds the links among these pairs to what is connected: only the least members of what they join are dealt with."""
        nonlocal links, roots
        new = found.where(linked).select("u", "v")
        if links is None:
            links = components(new, tables)
        else:
            end = lambda c: F.coalesce(F.col(f"of_{c}"), F.col(c)).alias(c)
            both = new.join(links.toDF("u", "of_u"), "u", "left").join(links.toDF("v", "of_v"), "v", "left").select(end("u"), end("v"))
            both = tables.written(both.where("u <> v").distinct(), "between")
            if not both.take(1):
                return
            moved = components(both, tables)
            links = links.join(moved.toDF("v", "to"), "v", "left").select("u", F.coalesce("to", "v").alias("v")).unionByName(moved)
        links = tables.written(links.select("u", "v"), "links")
        roots = links.select(F.col("u").alias("id"), F.col("v").alias("root"))

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))

    # 1. Stars.
    open_, pivots_of = placed, []
    for _ in range(ROUNDS):
        pivots = open_.groupBy("node").agg(F.max(F.struct("shared", (-F.col("id")).alias("order"), "id", "n", *S)).alias("m")).select("node", F.col("m.shared").alias("rank"), "m.id", "m.n", *(f"m.{c}" for c in S))
        pivots = tables.written(pivots, "pivots")
        pivots_of.append(pivots.select("id", "rank"))
        stars = open_.alias("b").join(pivots.alias("a"), "node").where((a("id") != b("id")) & _passes(WIDE)).select(a("id").alias("u"), b("id").alias("v")).distinct()
        counted(stars.join(known.select("u", "v"), ["u", "v"], "left_anti"))
        close = known.where(similarity >= settling).select(F.col("u").alias("pivot"), F.col("v").alias("id"))
        settled = open_.join(pivots.select("node", F.col("id").alias("pivot")), "node").select("node", "pivot", "id").join(close, ["pivot", "id"]).select("node", "id")
        open_ = tables.written(open_.join(settled.unionByName(pivots.select("node", "id")), ["node", "id"], "left_anti"), "open")
    rank = tables.written(reduce(DataFrame.unionByName, pivots_of).distinct(), "ranks")

    def chief() -> DataFrame:
        """By member, the pivot of highest rank that settles it (itself, if it is a pivot and no other is higher)."""
        able = known.where(similarity >= settling).select(F.col("v").alias("id"), F.col("u").alias("pivot")).join(rank.select(F.col("id").alias("pivot"), "rank"), "pivot")
        able = able.select("id", "rank", "pivot").unionByName(rank.select("id", "rank", F.col("id").alias("pivot")))
        return tables.written(able.groupBy("id").agg(F.max(F.struct("rank", (-F.col("pivot")).alias("order"))).alias("top")), "chiefs")

    def in_groups() -> DataFrame:
        return known.where(similarity >= WIDE - 1e-9).select(F.col("u").alias("pivot"), F.col("v").alias("id"), F.col("nv").alias("n"), F.col("nu").alias("n_pivot"))

    # Members meet the highest chief of their groups.
    grouped = tables.written(in_groups().join(chief(), "id"), "grouped")
    highest = tables.written(grouped.groupBy("pivot").agg(F.max("top").alias("top")).select("pivot", (-F.col("top.order")).alias("u")), "highest")
    strays = grouped.join(highest, "pivot").where("u <> id").select("u", F.col("id").alias("v")).distinct().join(known.select("u", "v"), ["u", "v"], "left_anti")
    strays = tables.written(strays, "strays")
    sketched = classes.select("id", "n", *S)
    strays = strays.join(sketched.withColumnRenamed("id", "u").alias("a"), "u").join(sketched.withColumnRenamed("id", "v").alias("b"), "v").where(_passes(WIDE)).select("u", "v")
    counted(strays)
    merged(known)

    # 2. Differences. Each pair is compared in one group, if there is one whose pivot settles either member.
    group = tables.written(labelled(in_groups()), "in-groups").join(roots.select(F.col("id").alias("pivot"), F.col("root").alias("head")), "pivot", "left")
    group = tables.written(group.withColumn("apart", F.col("root") != F.coalesce("head", "pivot")).drop("head").join(chief().select("id", (-F.col("top.order")).alias("chief")), "id", "left"), "groups")
    active = group.groupBy("pivot").agg(F.count("*").alias("members"), F.max("apart").alias("any"), F.min("chief").alias("lo"), F.max("chief").alias("hi"), F.max(F.col("chief").isNull()).alias("free"))
    active = tables.written(active.where("any and (free or lo <> hi or lo = pivot)").select("pivot", "members"), "active")
    group = tables.written(group.join(active, "pivot"), "active-groups")
    # Large groups are told from a member near their centre, which meets all others first.
    central = tables.written(central_members(group, sets, tables), "central")
    group = tables.written(group.join(central, "pivot", "left").withColumn("ref", F.coalesce("ref", "pivot")).where("id <> ref").drop("root", "apart", "n_pivot"), "referred")
    met = group.where("ref <> pivot").select(F.col("ref").alias("u"), F.col("id").alias("v")).distinct()
    merged(counted(met.join(known.select("u", "v"), ["u", "v"], "left_anti")))
    referred = tables.written(group.select("ref").distinct().join(classes.select(F.col("id").alias("ref"), F.col("n").alias("n_ref")), "ref").join(roots.select(F.col("id").alias("ref"), F.col("root").alias("head")), "ref", "left"), "references")
    group = tables.written(labelled(group).join(referred, "ref").withColumn("apart", F.col("root") != F.coalesce("head", "ref")), "related")
    index = tables.written(difference_places(group, sets, percent), "differences")
    # Groups of a member whose pivot is some member's chief: where a pair has such a group in common, it is compared there.
    homes = group.join(group.select(F.col("chief").alias("pivot")).distinct(), "pivot").groupBy("id").agg(F.collect_set("pivot").alias("homes"))
    about = tables.written(group.select("id", "chief").distinct().join(homes, "id", "left"), "homes")
    index = tables.written(placed_differences(index, tables).join(about, "id"), "difference-places")
    most = F.floor((a("n") + b("n")) * F.lit(100 - percent) / F.lit(100 + percent) + 1e-9)
    needed = F.greatest(F.lit(1), F.ceil((a("size") + b("size") - most) / 2))
    fits = (a("place") <= a("size") - needed + 1) & (b("place") <= b("size") - needed + 1)
    shared_home = F.greatest(F.when(F.array_contains(a("homes"), b("chief")), b("chief")), F.when(F.array_contains(b("homes"), a("chief")), a("chief")))
    here = F.coalesce(shared_home, a("pivot")) == a("pivot")

    def sharing(rows: DataFrame, partners: DataFrame) -> DataFrame:
        """Pairs of members of different components that share a token at places where linked ones do."""
        same = (a("pivot") == b("pivot")) & (a("token") == b("token")) & (a("root") != b("root"))
        found = rows.alias("a").join(partners.alias("b"), same & fits & here).select(*pair).distinct()
        return found.join(known.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), ["u", "v"], "left_anti")

    for first in (True, False):
        rows = tables.written(labelled(index.drop("root")), "rooted-differences")
        open_tokens = rows.groupBy("pivot", "token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("apart").alias("any"), F.min(F.struct(~F.col("apart"), "size", "id")).alias("one")).where("any and lo <> hi").select("pivot", "token", F.col("one.id").alias("one"))
        rows = tables.written(rows.join(tables.written(open_tokens, "open-tokens"), ["pivot", "token"]), "open-differences")
        merged(counted(sharing(rows, rows.where("id = one")) if first else sharing(rows, rows.where("apart"))))

    # 3. Small nodes.
    open_ = tables.written(labelled(open_), "open-members")
    inside = open_.alias("a").join(open_.alias("b"), (a("node") == b("node")) & (a("id") < b("id")) & (a("root") != b("root")) & _passes(limit)).select(*pair).distinct()
    merged(counted(inside.join(known.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), ["u", "v"], "left_anti")))

    rooted = classes.join(roots, "id", "left").select("hi", "lo", "doc_id", "copies", F.coalesce("root", "id").alias("root"))
    groups = tables.written(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("size")).where("size > 1"), "components-of-classes")
    shared = tables.written(rooted.join(groups, "root").select("hi", "lo", "component_id"), "components-of-sets")
    tables.close(sketches, shared)
    told = sketches.select("doc_id", "text_key", "n_shingles", "hi", "lo").join(shared, ["hi", "lo"], "left")
    told = told.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    return told.select("doc_id", "text_key", "n_shingles", "component_id", F.equal_null("doc_id", "component_id").alias("kept"))


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, unchanged: one document of each group, the one of least id; of rows repeated with it, one."""
    id_, key, n = (free_name(c, *docs.columns) for c in ("dedup_id", "dedup_key", "dedup_rows"))
    told = near_duplicates(docs, words, percent).groupBy(F.coalesce("doc_id", F.lit(-1 << 63)).alias(id_), F.col("text_key").alias(key))
    told = written(told.agg(F.max("kept").alias("kept"), F.count("*").alias(n)).where(f"not kept or {n} > 1").select(id_, key, F.when(F.col("kept"), F.col(n)).otherwise(0).alias(n)), "near-duplicates")
    keyed = docs.withColumns({id_: F.coalesce(docs["doc_id"].cast("long"), F.lit(-1 << 63)), key: F.xxhash64(docs["text"])}).join(if_small(told), [id_, key], "left")
    kept = keyed.where(F.col(n).isNull())
    if told.where(F.col(n) > 1).take(1):
        kept = kept.unionByName(keyed.where(F.col(n) > 1).dropDuplicates([id_, key]))
    return kept.select(*docs.columns)


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85).drop("text_key")
