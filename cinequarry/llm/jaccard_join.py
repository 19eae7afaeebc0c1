"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are distinct shingle sets (documents with the
same set are one row); its columns, shingle hashes, are the blocks that Spark
deals out. Size-derived bounds keep the product sparse: with shingles in one
order for all, two sets at the threshold must share one among the first
n - ceil(t n) + 1 of each, and at least ``slack`` more where heads are longer
by that many; more still if their sizes are alike, as tails hold only so many
of those they must share. So only heads enter the product, shingles known to be
frequent last, and a set may leave out as many crowded columns as it has slack.

A column doesn't emit its pairs. Each column links its rows to one of them
(a star); pairs that pass the bounds on size and on shared columns get their
overlap counted exactly, and linked rows become one component. Then a few
delegates of each component meet the rows of others in their columns, until a
round finds no link. Only pairs of different components that still share a
column are left; their shared columns are added up, pairs below the bound are
dropped, and the rest counted exactly.

A shingle is known by a 64-bit hash of its words' hashes while candidates are
sought; a link is counted on shingles that are told apart by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import count as numbers

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinequarry.operators.graph import connected_components
from cinequarry.plans.scratch import discard, release, written

from .common import as_long, gram_hashes, keep_rows, mix, partitions, run_starts, settle, shingle_sets, slices, small, split_sets, text_code, word_hashes, words_of

#: A column with more pairs of different components than this, for each of its rows, is crowded.
CROWDED = 50
#: Rounds in which components' delegates look for links, at most, and delegates of a component in each.
ROUNDS, DELEGATES = 2, 4
#: Rows and shingles of a block that is multiplied with others as a whole.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 200_000
#: Documents whose shingles are counted together to find frequent ones, the
#: share of them that makes a shingle frequent, and the most that are kept.
COUNTED, FREQUENT, FREQUENT_MOST = 4096, 0.002, 500_000
#: Text bytes whose shingles a task makes at once, shingles it counts at once, and rows of columns it holds at once.
TEXT_BYTES, COUNTED_SHINGLES, HELD_ROWS = 1 << 20, 1 << 21, 100_000
#: Pairs of rows that a task makes at once (one row's at least).
HELD_PAIRS = 1 << 19


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def head_size(n: int, percent: int) -> tuple[int, int]:
    """(shingles that enter the product, slack among them) of a set of n."""
    base = n - -(-percent * n // 100) + 1
    slack = min(n - base, n // 20 + 8) if n else 0
    return base + slack, slack


def exact_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text, as numbers that are equal in this batch only for equal words."""
    values, places, counts = words_of(texts, lower=True)
    own = word_hashes(values)
    for seed in numbers():
        codes = own[places]
        hashes = gram_hashes(codes, k)
        order = np.argsort(hashes, kind="stable")
        twin = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
        a, b = order[twin], order[twin + 1]
        if all(np.array_equal(places[a + j], places[b + j]) for j in range(k)):
            return split_sets(codes, hashes, counts, k)
        own = mix(np.arange(len(own), dtype=np.uint64) + np.uint64(seed + 1 << 32))
    raise AssertionError


def frequent_shingles(source: DataFrame, k: int) -> np.ndarray:
    """Shingles in about 0.2 % of the documents or more, at most FREQUENT_MOST of them.

    Any list gives right results, as it only orders the shingles; this one
    keeps common lines and passages out of the heads.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= max(8, FREQUENT * len(held))
            return pa.RecordBatch.from_pydict({"gram": pa.array(_signed(values[many]), pa.int64()), "n": pa.array(n[many], pa.int64())})

        for batch in slices(batches, limit=TEXT_BYTES):
            own = shingle_sets(batch.column("text"), k)
            held += own
            size += sum(map(len, own))
            if len(held) >= COUNTED or size >= COUNTED_SHINGLES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counted = source.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    # At a share of 0.2 % a document's own size bounds how many there can be: 500 average sets.
    rows = counted.orderBy(F.desc("n"), "gram").limit(FREQUENT_MOST).select("gram").toPandas()
    return np.sort(rows["gram"].to_numpy(np.int64).view(np.uint64))


_ROW = pa.schema([("doc_id", pa.int64()), ("code", pa.int64()), ("node", pa.int64()), ("proof", pa.int64()), ("n", pa.int64()), ("head", pa.list_(pa.int64())), ("late", pa.int32())])
_ROW_SQL = "doc_id long, code long, node long, proof long, n long, head array<long>, late int"


def _rows(source: DataFrame, frequent: np.ndarray, k: int, percent: int, seed: int) -> DataFrame:
    """A row a document: node and proof identify its set, both null without shingles.

    head is that of the first of equal sets in a batch; its shingles from
    place ``late`` on are frequent ones.
    """

    def identity(grams: np.ndarray) -> tuple[int, int]:
        digest = hashlib.blake2b(grams.tobytes(), digest_size=16, salt=seed.to_bytes(4, "little")).digest()
        return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_BYTES):
            sets = shingle_sets(batch.column("text"), k)
            nodes, proofs, heads, lates, seen = [], [], [], [], set()
            flat = np.concatenate(sets)
            at = np.searchsorted(frequent, flat)
            at[at == len(frequent)] = 0
            common = frequent[at] == flat if len(frequent) else np.zeros(len(flat), bool)
            end = 0
            for s in sets:
                start, end = end, end + len(s)
                node, proof = identity(s) if len(s) else (None, None)
                head, late = None, None
                if node is not None and (node, proof) not in seen:
                    seen.add((node, proof))
                    last = common[start:end]
                    first = s[~last]
                    size = head_size(len(s), percent)[0]
                    head, late = _signed(np.concatenate((first, s[last]))[:size]), len(first)
                nodes.append(node)
                proofs.append(proof)
                heads.append(head)
                lates.append(late)
            cols = [batch.column("doc_id"), batch.column("code"), nodes, proofs, [len(s) for s in sets], heads, lates]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, _ROW, strict=True)], schema=_ROW)

    return source.select("doc_id", "code", "text").mapInArrow(build, _ROW_SQL)


def _columns(rows: DataFrame, bearers: DataFrame) -> DataFrame:
    """list, centre, node, many: columns of two or more rows; columns of the same rows are one list, ``many`` of them.

    A set enters by the head of one row, its bearer (node, doc_id, code). A
    frequent shingle's column is a list of its own, and Spark's partial sums
    find its centre, so that no task meets all of its rows.
    """
    schema = pa.schema([("list", pa.int64()), ("centre", pa.int64()), ("node", pa.int64()), ("many", pa.int64())])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_g, rest_n = np.empty(0, np.int64), np.empty(0, np.int64)
        lists: dict[bytes, int] = {}
        weight = 0

        def flush() -> pa.RecordBatch:
            names = np.fromiter((int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True) for b in lists), np.int64, len(lists))
            sizes = np.fromiter((len(b) // 8 for b in lists), np.int64, len(lists))
            nodes = np.frombuffer(b"".join(lists), np.int64)
            starts = np.cumsum(sizes) - sizes
            many = np.fromiter(lists.values(), np.int64, len(lists))
            lists.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, sizes)), pa.array(np.repeat(nodes[starts], sizes)), pa.array(nodes), pa.array(np.repeat(many, sizes))], schema=schema)

        def take(grams: np.ndarray, nodes: np.ndarray) -> None:
            nonlocal weight
            new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1])))  # a set from several batches is one row
            grams, nodes = grams[new], nodes[new]
            starts = run_starts(grams)
            ends = np.append(starts[1:], len(grams))
            wide = ends - starts > 1
            for a, b in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
                own = nodes[a:b].tobytes()
                if own not in lists:
                    weight += b - a
                lists[own] = lists.get(own, 0) + 1

        for batch in batches:
            g = np.concatenate((rest_g, batch.column("gram").to_numpy(zero_copy_only=False)))
            n = np.concatenate((rest_n, batch.column("node").to_numpy(zero_copy_only=False)))
            if not len(g):
                continue
            whole = int(np.searchsorted(g, g[-1]))
            if whole:
                take(g[:whole], n[:whole])
            rest_g, rest_n = g[whole:], n[whole:]
            if weight >= HELD_ROWS:
                yield flush()
                weight = 0
        if len(rest_g):
            take(rest_g, rest_n)
        if lists:
            yield flush()

    one = bearers.select(F.col("node").alias("n_"), F.col("doc_id").alias("d_"), F.col("code").alias("c_"))
    own = (F.col("node") == F.col("n_")) & F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("code") == F.col("c_"))
    borne = rows.where("head IS NOT NULL").join(small(one), own, "left_semi")
    heads = borne.select("node", "late", F.posexplode("head").alias("pos", "gram"))
    dealt = heads.where("pos < late").select("gram", "node").repartition(partitions(rows.sparkSession), "gram").sortWithinPartitions("gram", "node")
    rare = dealt.mapInArrow(gather, "list long, centre long, node long, many long").repartition(partitions(rows.sparkSession), "list").groupBy("list", "centre", "node").agg(F.sum("many").alias("many"))
    common = heads.where("pos >= late").select(F.col("gram").alias("list"), "node").distinct()
    # A row for each frequent shingle, at most FREQUENT_MOST.
    centres = common.groupBy("list").agg(F.min("node").alias("centre"), F.count("*").alias("rows")).where("rows > 1").select("list", "centre")
    shared = common.join(F.broadcast(centres), "list").select("list", "centre", "node", F.lit(1).cast("long").alias("many"))
    return rare.unionByName(shared)


def _texts(source: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, text of the given nodes (node, n, doc_id, code)."""
    texts = settle(source.join(small(nodes), ["doc_id", "code"]).select("node", "n", "text"))
    # Only rows that repeat an id and its text give a node twice; without them no text is shuffled.
    twice = texts.groupBy("node").count().where("count > 1").limit(1).count()
    return settle(texts.dropDuplicates(["node"])) if twice else texts


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b; written) whose exact overlap reaches the threshold.

    Texts meet bounded pairs where they are; only a pair's b, and each a once, go to the a's.
    """
    firsts = settle(pairs.select(F.col("a").alias("node")).distinct())
    left = texts.join(small(firsts), "node", "left_semi").select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = right.join(small(pairs), "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def overlap(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text_a", TEXT_BYTES), "text_b", TEXT_BYTES):
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            firsts = run_starts(a)  # rows of one a follow each other: its text counts once
            sets = exact_sets(pa.concat_arrays([batch.column("text_a").take(pa.array(firsts)), batch.column("text_b")]), k)
            owner = np.cumsum(np.isin(np.arange(len(a)), firsts)) - 1
            kept = []
            for i, y in enumerate(sets[len(firsts) :]):
                x = sets[owner[i]]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    kept.append(i)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a[kept]), "b": pa.array(b[kept])})

    return both.mapInArrow(overlap, "a long, b long")


def _slack(n: str, percent: int) -> Column:
    """head_size()'s slack, of a column."""
    size = F.col(n)
    base = size - F.ceil(size * percent / 100) + 1
    return F.least(size - base, F.floor(size / 20) + 8)


def _near(percent: int) -> Column:
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def _tail(n: str, percent: int) -> Column:
    """Shingles of a set of that size that are not in its head."""
    return F.ceil(F.col(n) * percent / 100) - 1 - _slack(n, percent)


def _enough(shared: str, percent: int) -> Column:
    """Whether two sets can link that share so many shingles of their heads, and their sizes are near.

    Of the shingles that two sets share, those missing from either head are
    all in the tail of the one whose head ends first.
    """
    most = F.col(shared) + F.greatest(_tail("n_a", percent), _tail("n_b", percent))
    return _near(percent) & (most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)


def _likely(percent: int) -> Column:
    """Whether two rows share half as many columns as their slack, and their sizes are near; any other pair is left over."""
    return _near(percent) & (F.col("shared") > 0.5 * F.least(_slack("n_a", percent), _slack("n_b", percent)))


def _stars(columns: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a column's first row and another that a star should try."""
    shared = columns.where("centre <> node").groupBy(F.col("centre").alias("a"), F.col("node").alias("b")).agg(F.sum("many").alias("shared"))
    one, other = (sizes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    return shared.join(one, "a").join(other, "b").where(_likely(percent)).select("a", "b")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (list, node, many, n) with the label of their component."""
    return rows.select("list", "node", "many", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open(columns: DataFrame, sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """(list, node, many, n, label) of the columns in which several components meet."""
    rows = _labelled(columns.join(sizes, "node"), labels)
    mixed = rows.groupBy("list").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("list")
    return rows.join(mixed, "list")


def _bridges(open_rows: DataFrame, tried: DataFrame, percent: int, number: int) -> DataFrame:
    """Untried pairs (a, b) of a delegate of a component and a row of another one.

    Every component has a few delegates, others each round. In each column
    that has some, those of the largest component there meet its rows of other
    components, so a column gives DELEGATES pairs a row at most.
    """
    picks = [F.min_by("node", F.xxhash64("node", F.lit(number), F.lit(i))) for i in range(DELEGATES)]
    members = open_rows.select("node", "label").distinct()
    chosen = settle(members.groupBy("label").agg(F.count("*").alias("members"), F.array_distinct(F.array(*picks)).alias("picked")).where("members > 1").select("label", "members", F.explode("picked").alias("node")))
    present = open_rows.join(small(chosen), ["node", "label"]).select("list", "label", "members", F.col("node").alias("centre"), F.col("n").alias("size"))
    top = present.groupBy("list").agg(F.max(F.struct("members", "label")).alias("top")).select("list", F.col("top.label").alias("label"))
    centres = present.join(top, ["list", "label"]).select("list", F.col("label").alias("own"), "centre", "size")
    met = open_rows.join(centres, "list").where("label <> own")
    turned = F.col("centre") < F.col("node")
    sides = met.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"), F.when(turned, F.col("size")).otherwise(F.col("n")).alias("n_a"), F.when(turned, F.col("n")).otherwise(F.col("size")).alias("n_b"), "many")
    likely = sides.groupBy("a", "b", "n_a", "n_b").agg(F.sum("many").alias("shared")).where(_likely(percent)).select("a", "b")
    return likely.join(small(tried), ["a", "b"], "left_anti")


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, label) with the components that the links connect made one."""
    if labels is None:
        return connected_components(links)
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    known = settle(ends.join(labels, "node", "full_outer").select("node", F.coalesce("label", "node").alias("label")))
    a, b = known.select(F.col("node").alias("a"), F.col("label").alias("la")), known.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = links.join(a, "a").join(b, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    moved = connected_components(between).select(F.col("node").alias("label"), F.col("label").alias("now"))
    return settle(known.join(moved, "label", "left").select("node", F.coalesce("now", "label").alias("label")))


def _marked(open_rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(list, many, node, label, n, crowded, wide), and how many crowded columns a row is in.

    A column is crowded by its pairs of rows of different components, and wide
    by its rows; one that a single component fills is done.
    """
    each = open_rows.groupBy("list", "label").agg(F.count("*").cast("double").alias("c"))
    sums = each.groupBy("list").agg(F.sum("c").alias("rows"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count("*").alias("labels"))
    kinds = sums.select("list", ((F.col("rows") * F.col("rows") - F.col("same")) / 2 > CROWDED * F.col("rows")).alias("crowded"), (F.col("rows") > HELD_ROWS).alias("wide"), (F.col("labels") < 2).alias("done")).where("crowded OR wide OR done")
    no = F.lit(False)
    marked = open_rows.join(kinds, "list", "left").where(~F.coalesce("done", no)).withColumns({c: F.coalesce(c, no) for c in ("crowded", "wide")}).drop("done")
    marked = settle(marked)
    left_out = marked.where("crowded").groupBy("node", "n").agg(F.sum("many").alias("left_out")).withColumn("over", F.col("left_out") > _slack("n", percent))
    return marked, settle(left_out)


def _met(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b, many) of rows of a column, of different components and near sizes; no column is wide.

    A task has whole columns one after another; rows of a component follow
    each other, so pairs within one are never made.
    """
    kinds = [(c, pa.int64()) for c in ("a", "b", "n_a", "n_b", "many")]
    names = ["list", "label", "node", "n", "many"]

    def pair(lists: np.ndarray, labels: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, many: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = lists[1:] != lists[:-1]
        firsts, groups = np.append(run_starts(lists), len(lists)), np.append(np.flatnonzero(np.concatenate(([True], new | (labels[1:] != labels[:-1])))), len(lists))
        at = np.arange(len(lists))
        start, end = groups[np.searchsorted(groups, at, side="right")], firsts[np.searchsorted(firsts, at, side="right")]
        counts = end - start  # rows of its column that are of later components
        sums = np.cumsum(counts)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + HELD_PAIRS, side="right")))
            own = counts[i:j]
            x = np.repeat(at[i:j], own)
            y = np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(start[i:j], own)
            near = np.minimum(sizes[x], sizes[y]) * 100 >= np.maximum(sizes[x], sizes[y]) * percent
            x, y = x[near], y[near]
            x, y = np.where(nodes[x] < nodes[y], x, y), np.where(nodes[x] < nodes[y], y, x)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (nodes[x], nodes[y], sizes[x], sizes[y], many[x])], schema=pa.schema(kinds))
            i = j

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate((r, batch.column(c).to_numpy(zero_copy_only=False))) for r, c in zip(rest, names, strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1]))
            yield from pair(*(h[:whole] for h in held))
            rest = [h[whole:] for h in held]
        yield from pair(*rest)

    dealt = members.select(*names).repartition(partitions(members.sparkSession), "list").sortWithinPartitions("list", "label")
    return dealt.mapInArrow(meet, ", ".join(f"{c} long" for c, _ in kinds))


def _met_wide(members: DataFrame, percent: int) -> DataFrame:
    """_met() of columns of any number of rows, as joins that Spark can split.

    Components of a column meet first and their rows then.
    """
    groups = members.groupBy("list", "label").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    one, other = (groups.select("list", F.col("label").alias(f"label_{c}"), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}")) for c in "ab")
    fits = (F.col("hi_a") * 100 >= F.col("lo_b") * percent) & (F.col("hi_b") * 100 >= F.col("lo_a") * percent)
    meet = one.join(other, "list").where((F.col("label_a") < F.col("label_b")) & fits).select("list", "label_a", "label_b")
    left, right = (members.select("list", "many", F.col("label").alias(f"label_{c}"), F.col("node").alias(f"node_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
    pairs = meet.join(left, ["list", "label_a"]).join(right.drop("many"), ["list", "label_b"]).where(_near(percent))
    turned = F.col("node_a") < F.col("node_b")
    return pairs.select(*[F.when(turned, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(to) for c, to_ in (("node", ""), ("n", "n_")) for x, y, to in (("a", "b", f"{to_}a"), ("b", "a", f"{to_}b"))], "many")


def _left_over(marked: DataFrame, left_out: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Untried pairs (a, b) of different components that share columns enough that aren't crowded."""
    members = marked.where("NOT crowded")
    flat, wide = _met(members.where("NOT wide"), percent), members.where("wide")
    if wide.limit(1).count():
        flat = flat.unionByName(_met_wide(wide, percent))
    counted = flat.groupBy("a", "b", "n_a", "n_b").agg(F.sum("many").alias("shared"))
    # The fewest columns that two rows at the threshold share, less those that both left out.
    for c in "ab":
        counted = counted.join(small(left_out.select(F.col("node").alias(c), F.col("left_out").alias(f"out_{c}"))), c, "left")
    both_out = F.least(F.coalesce("out_a", F.lit(0)), F.coalesce("out_b", F.lit(0)))
    return counted.withColumn("most", F.col("shared") + both_out).where(_enough("most", percent)).select("a", "b").join(small(tried), ["a", "b"], "left_anti")


def _crowded_pairs(marked: DataFrame, left_out: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that link rows in more crowded columns than they may leave out; enough of them to connect what is linked.

    These rows are cut into blocks, by the fullest crowded column that holds
    them and in order of size. Two blocks with a crowded column in common and
    sizes that can link are multiplied in one task: dense, so that no pair is
    ever a row.
    """
    members = settle(marked.where("crowded").join(left_out.where("over").select("node"), "node", "left_semi").select("list", "node", "label", "n"))
    if not members.limit(1).count():
        return members.select(F.col("node").alias("a"), F.col("label").alias("b"))
    filled = members.groupBy("list").agg(F.count("*").alias("rows"))
    homes = members.join(filled, "list").groupBy("node").agg(F.max(F.struct("rows", "list")).alias("home"), F.first("label").alias("label"), F.first("n").alias("n")).select("node", "label", "n", F.col("home.list").alias("home"))
    # Sizes within a band of a tenth are one class, whose rows are dealt to blocks.
    classed = homes.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.1))))
    parts = classed.groupBy("home", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    dealt = classed.join(parts, ["home", "band"]).withColumn("block", F.xxhash64("home", "band", F.pmod(F.xxhash64("node"), F.col("parts"))))

    def shingled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_BYTES):
            grams = [s.tobytes() for s in shingle_sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "label", "block")), pa.array(grams, pa.binary())], names=["node", "label", "block", "grams"])

    placed = settle(dealt.select("node", "label", "n", "block"))
    sets = settle(texts.select("node", "text").join(small(placed), "node").select("node", "label", "block", "text").mapInArrow(shingled, "node long, label long, block long, grams binary"))
    spans = placed.groupBy("block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("label").alias("least"), F.max("label").alias("most"))
    holds = members.select("list", "node").join(placed.select("node", "block"), "node").select("list", "block").distinct().join(spans, "block")
    one, other = (holds.select("list", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "lo", "hi", "least", "most")]) for x in "xy")
    fits = (F.col("hi_x") * 100 >= F.col("lo_y") * percent) & (F.col("hi_y") * 100 >= F.col("lo_x") * percent)
    mixed = (F.col("least_x") != F.col("most_y")) | (F.col("least_y") != F.col("most_x"))
    pairs = one.join(other, "list").where((F.col("block_x") <= F.col("block_y")) & fits & mixed).select("block_x", "block_y").distinct()
    sides = pairs.select(F.xxhash64("block_x", "block_y").alias("pair"), F.explode(F.array_distinct(F.array(F.struct(F.col("block_x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("block_y").alias("block"), F.when(F.col("block_x") == F.col("block_y"), 0).otherwise(1).alias("side"))))).alias("s")).select("pair", "s.block", "s.side")

    def multiply(frame: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(g, np.uint64) for g in frame["grams"]]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        _, places, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(own)), sizes)
        kept = times[places] > 1
        owner, places = owner[kept], np.cumsum(times > 1)[places[kept]] - 1
        shared = np.zeros((len(own), len(own)), np.float32)
        for start in range(0, int((times > 1).sum()), 4096):
            here = (places >= start) & (places < start + 4096)
            incidence = np.zeros((len(own), 4096), np.float32)
            incidence[owner[here], places[here] - start] = 1
            shared += incidence @ incidence.T
        side, label, node = (frame[c].to_numpy() for c in ("side", "label", "node"))
        linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
        if side.any():
            linked &= side[:, None] < side[None, :]
        root = {x: x for x in label.tolist()}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i, j in zip(*np.nonzero(np.triu(linked | linked.T, 1) & (label[:, None] != label[None, :])), strict=True):
            x, y = top(int(label[i])), top(int(label[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(node[i]), int(node[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return sides.join(sets, "block").groupBy("pair").applyInPandas(multiply, "a long, b long")


def _components(docs: DataFrame, text: str, doc_id: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, code, node, n), (node, least doc_id and code of its component)."""
    spark = docs.sparkSession
    source = docs.select(as_long(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("code", text_code())
    frequent = frequent_shingles(source, k)
    for seed in numbers():
        rows = settle(_rows(source, frequent, k, percent, seed))
        whole = written(spark)[-1]
        first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "code")))
        sets = rows.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), first.alias("least"), F.min(F.struct("doc_id", "code")).alias("row"), F.min(F.when(F.col("head").isNotNull(), F.struct("doc_id", "code"))).alias("bearer"), F.min("proof").alias("lo"), F.max("proof").alias("hi"))
        sets = settle(sets)
        if not sets.where("lo <> hi").limit(1).count():
            break
        discard(spark, [whole])  # two sets share a node: name them anew
    columns = settle(_columns(rows, sets.select("node", "bearer.doc_id", "bearer.code")))
    rows = settle(rows.select("doc_id", "code", "node", "n"))
    discard(spark, [whole])  # heads are as large as the texts
    release(spark)  # and so is what they were shuffled in
    nodes = settle(sets.join(columns.select("node").distinct(), "node", "left_semi").select("node", "n", "row.doc_id", "row.code"))
    known = source.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    texts = _texts(known, nodes.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))))
    sizes = nodes.select("node", "n")
    stars = settle(_stars(columns, sizes, percent))
    labels = _joined(None, settle(_linked(stars, texts, k, percent)))
    open_rows, tried = settle(_open(columns, sizes, labels)), stars
    release(spark)
    for number in range(ROUNDS):
        pairs = settle(_bridges(open_rows, tried, percent, number))
        links = settle(_linked(pairs, texts, k, percent))
        if not links.limit(1).count():
            break
        labels, tried = _joined(labels, links), tried.unionByName(pairs)
        open_rows = settle(_labelled(open_rows, labels))
        release(spark)
    marked, left_out = _marked(open_rows, percent)
    left_over = settle(_left_over(marked, left_out, tried, percent).unionByName(_crowded_pairs(marked, left_out, texts, k, percent)))
    release(spark)
    links = settle(_linked(left_over, texts, k, percent))
    if links.limit(1).count():
        labels = _joined(labels, links)
    groups = sets.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "least", "row")
    smallest = groups.groupBy("label").agg(F.min("least").alias("least"), F.min("row").alias("row"))
    return rows, groups.select("node", "label").join(smallest, "label").select("node", F.coalesce("least", "row").alias("least"))


def jaccard_groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Sets are distinct k-word shingles in ASCII lower case; fewer words are one
    shingle; two sets link at ``percent`` of Jaccard similarity or more.
    component_id is the smallest doc_id that links reach.

    Texts without words, or null, have no shingles and their own id as
    component. Very long texts count whole. Repeated rows and ids come back as
    often as they occur. Null ids name no component: such a row takes the
    smallest known id of its component, and null where none has an id. An
    empty table gives no rows; further columns are ignored.
    """
    rows, least = _components(docs, text, doc_id, k, percent)
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return rows.join(least, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that have the smallest id of their component.

    One row of each component stays: of rows with that id the one of least
    text hash, of rows without any id one of them. Texts without words are
    components of their own.
    """
    rows, least = _components(docs, text, doc_id, k, percent)
    found = rows.join(least, "node", "left")
    kept = F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("code") == F.col("least.code")))
    return keep_rows(docs, found.select("doc_id", "code", kept.alias("kept")), doc_id, text_code(text))
