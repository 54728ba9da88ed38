"""Near-duplicate documents by an LSH forest over MinHash signatures.

Each tree of the forest is a sorted order of all signatures, with its own sequence of hashes first.
Neighbours in an order are candidates, with their longest common prefix for a depth. Work goes from
deep to shallow: each document is first verified against its best neighbour, then neighbours
in groups that are still apart, and at last a region (a prefix of least depth) is opened in full
only if its documents are still in more than one group; so the depth follows the region.
An open region gives the best partner of each document, then what is still apart: documents with
the groups that hold a likely partner, which are met in blocks, never written as pairs.
Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, drop, fresh, shuffles_freed, sorted_groups, staged
from .components import extended, with_root
from .tokens import sliced, slices

WORDS = 5
TREES, DEPTH = 32, 4
HASHES = TREES * DEPTH
HUB, REGION = 256, 512
#: Rows, and characters of text, of one block when documents meet a group.
BLOCK, BLOCK_CHARS = 128, 8_000_000
_MIX = np.random.default_rng(7)
_POSITION = _MIX.integers(1, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _MIX.integers(1, 1 << 63, WORDS, np.uint64)
_HASH = _MIX.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts as 64-bit hashes, ascending in each text, and the number of them by text."""
    split = [t.encode().lower().split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    words = np.empty(counts.sum(), object)
    words[:] = [w for s in split for w in s]
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    codes, distinct = pd.factorize(words)
    hashed = pd.util.hash_array(distinct, categorize=False)[codes]
    docs = np.repeat(np.arange(len(texts)), counts)
    n = max(0, len(words) - WORDS + 1)
    total = np.zeros(n, np.uint64)
    for k in range(WORDS):
        total += hashed[k : k + n] * _POSITION[k]
    at = np.flatnonzero(docs[:n] == docs[WORDS - 1 :])
    shingles, owner = total[at], docs[at]
    few = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(few):
        starts = np.cumsum(counts) - counts
        short = np.array([sum(int(hashed[starts[d] + k]) * int(_POSITION[k]) for k in range(counts[d])) + int(_SHORT[counts[d]]) & (1 << 64) - 1 for d in few], np.uint64)
        shingles, owner = np.concatenate([shingles, short]), np.concatenate([owner, few])
    shingles = _scramble(shingles)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[new], np.bincount(owner[new], minlength=len(texts))


def signatures(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values of the sets that are not empty, one row each."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(starts), HASHES), "<u4")
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(shingles * _HASH[k], starts) >> np.uint64(32)
    return out


def _describe(batches):
    """Batches of row, text and doc_id to rows of DESCRIBED and doc_id."""
    for batch in batches:
        for i, j, texts in sliced(batch.column(1)):
            shingles, counts = shingle_sets([t or "" for t in texts])
            some = counts > 0
            starts = (np.cumsum(counts) - counts)[some]
            marks = np.zeros((2, j - i), np.int64)
            signed: list = [None] * (j - i)
            if some.any():
                for m, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                    marks[m, some] = np.add.reduceat(_scramble(shingles + np.uint64(salt)), starts).view(np.int64)
                for d, s in zip(np.flatnonzero(some), signatures(shingles, counts)):
                    signed[d] = s.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts), pa.array(marks[0]), pa.array(marks[1]), pa.array(signed, pa.binary()), batch.column(2).slice(i, j - i)], ["row", "n_shingles", "f1", "f2", "signature", "doc_id"])


DESCRIBED = "row long, n_shingles long, f1 long, f2 long, signature binary"


def _orders(batches):
    """node and signature to a row for each tree: tree, region (hash of the first values), the next values, node."""
    for batch in batches:
        s = np.stack([np.frombuffer(x, "<u4") for x in batch.column(1).to_pylist()]).astype(np.uint64) if batch.num_rows else np.zeros((0, HASHES), np.uint64)
        for tree in range(TREES):
            v = s[:, (np.arange(2 * DEPTH) + tree * DEPTH) % HASHES]
            region = np.zeros(len(v), np.uint64)
            for k in range(DEPTH):
                region = _scramble(region + v[:, k] + np.uint64(1 + k))
            rest = [(v[:, k] << np.uint64(32) | v[:, k + 1]).view(np.int64) for k in (DEPTH, DEPTH + 2)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), tree, np.int32)), pa.array(region.view(np.int64)), pa.array(rest[0]), pa.array(rest[1]), batch.column(0)], ["tree", "region", "r1", "r2", "node"])


def _neighbours(batches):
    """Sorted rows of the orders to those that share their region with a neighbour, and the first and last of the partition.

    before is the node ahead in the same region, depth the length of the common prefix with it.
    """
    held, first = None, True
    for batch in batches:
        table = pa.Table.from_batches([*([held] if held is not None else []), batch])
        if not table.num_rows:
            continue
        tree, region, r1, r2, node = (table.column(i).to_numpy() for i in range(5))
        same = np.zeros(len(node) + 1, bool)
        same[1:-1] = (tree[1:] == tree[:-1]) & (region[1:] == region[:-1])
        keep = same[:-1] | same[1:]
        skip = held is not None
        before, depth = np.full(len(node), -1), np.zeros(len(node), np.int32)
        at = np.flatnonzero(same[:-1])
        before[at] = node[at - 1]
        a = r1[at] ^ r1[at - 1]
        b = r2[at] ^ r2[at - 1]
        high, low = (lambda x: (x >> 32) == 0), (lambda x: x == 0)
        depth[at] = DEPTH + np.where(low(a), 2 + np.where(low(b), 2, high(b)), high(a))
        keep[-1] = True
        if first:
            keep[0], first = True, False
        elif skip:
            keep[0] = False  # it was given with the last batch
        held = table.slice(table.num_rows - 1).combine_chunks().to_batches()[0]
        at = np.flatnonzero(keep)
        yield pa.RecordBatch.from_arrays([pa.array(tree[at]), pa.array(region[at]), pa.array(node[at]), pa.array(before[at], pa.int64(), mask=before[at] < 0), pa.array(depth[at])], ["tree", "region", "node", "before", "depth"])


MEMBERS = "tree int, region long, node long, before long, depth int"


def _near(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets, x not empty, share percent of their union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    """Sorted rows (hub, chunk, role, node, text), the hub's own row first, to the pairs whose full sets are near."""

    def task(batches):
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            hubs, chunks, roles, nodes = (batch.column(i).to_numpy() for i in range(4))
            texts, found = batch.column(4).to_pylist(), []
            for i, j in slices(texts):
                shingles, counts = shingle_sets(texts[i:j])
                ends = np.cumsum(counts)
                for k in range(i, j):
                    x = shingles[ends[k - i] - counts[k - i] : ends[k - i]]
                    if roles[k] == 0:
                        hub, own = (hubs[k], chunks[k]), x
                    elif hub == (hubs[k], chunks[k]) and len(own) and _near(own, x, percent):
                        found.append((hubs[k], nodes[k]))
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return task


def confirmed(texts: DataFrame, pairs: DataFrame, percent: int, parts: int) -> DataFrame:
    """The pairs (u, v) whose texts' sets are near, staged; texts: row, text. A hub of many pairs is dealt over chunks of HUB."""
    pairs = staged(pairs, "pairs")
    needed = staged(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "needed")
    held = staged(texts.join(checked(needed), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "text"), "pair-texts")
    drop(needed)
    busy = staged(pairs.groupBy("u").count().filter(F.col("count") > HUB).select(F.col("u").alias("b"), F.ceil(F.col("count") / HUB).alias("chunks")), "hubs")
    dealt = pairs.join(checked(busy), F.col("u") == F.col("b"), "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("chunks", F.lit(1))).alias("chunk"))
    hubs = dealt.select("u", "chunk").distinct().join(held, F.col("u") == F.col("node")).select(F.col("u").alias("hub"), "chunk", F.lit(0).alias("role"), "node", "text")
    others = dealt.join(held, F.col("v") == F.col("node")).select(F.col("u").alias("hub"), "chunk", F.lit(1).alias("role"), "node", "text")
    rows = hubs.union(others).repartition(parts, "hub", "chunk").sortWithinPartitions("hub", "chunk", "role")
    links = staged(rows.mapInArrow(_confirm(percent), "u long, v long"), "links")
    drop(pairs, held, busy)
    return links


def _alike(least: float):
    """Rows u, v, and their signatures to the pairs whose signatures agree often enough."""

    def task(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, HASHES) for i in (2, 3))
            ok = pa.array((a == b).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["u", "v"])

    return task


def _opened(least: float, best: bool):
    """Sorted rows (tree, region, i, j, left, right, minor, node, root, signature) to what left rows have alike in other groups.

    With best, that is node, the row that agrees most, and the agreement; else node and the root of
    each such group, and of two minor rows only the one of the greater root is given. A pair that
    shares regions in several trees counts in the first of them only.
    """

    def task(batches):
        for group in sorted_groups(batches, 4):
            tree = group.column(0)[0].as_py()
            left, right, minor = (group.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in (4, 5, 6))
            node, root = group.column(7).to_numpy(), group.column(8).to_numpy()
            s = np.frombuffer(b"".join(group.column(9).to_pylist()), "<u4").reshape(-1, HASHES)
            r, out = np.flatnonzero(right), []
            for a in np.flatnonzero(left):
                b = r[root[r] != root[a]]
                same = s[b] == s[a]
                agree = same.mean(axis=1)
                ok = (agree >= least) & (same.reshape(-1, TREES, DEPTH).all(axis=2).argmax(axis=1) == tree)
                b, agree = b[ok], agree[ok]
                if best and len(b):
                    k = np.lexsort((node[b], -agree))[0]
                    out.append((node[a], node[b[k]], agree[k]))
                elif not best:
                    out += [(node[a], x, 0.0) for x in np.unique(root[b[~minor[b] | (root[b] < root[a])]])]
            if out:
                u, v, agree = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(agree, pa.float64())], ["node", "other", "agree"])

    return task


OPENED = "node long, other long, agree double"


def _met(percent: int, least: float):
    """Sorted rows (root, i, j, role, node, signature, text), those that ask (role 0) first, to one link of each that has any here."""

    def task(batches):
        key, asking, stacked = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            roles, nodes = (batch.column(c).to_pylist() for c in (3, 4))
            signed, texts, found = batch.column(5).to_pylist(), batch.column(6).to_pylist(), []
            for i, j in slices(texts):
                shingles, counts = shingle_sets(texts[i:j])
                ends = np.cumsum(counts)
                for k in range(i, j):
                    x, s = shingles[ends[k - i] - counts[k - i] : ends[k - i]], np.frombuffer(signed[k], "<u4")
                    if keys[k] != key:
                        key, asking, stacked = keys[k], [], None
                    if roles[k] == 0:
                        asking.append((nodes[k], s, x.copy()))
                    elif asking:
                        if stacked is None:
                            stacked = np.stack([a[1] for a in asking])
                        alike = np.flatnonzero((stacked == s).mean(axis=1) >= least)
                        linked = {a for a in alike.tolist() if _near(asking[a][2], x, percent)}
                        if linked:
                            found += [(asking[a][0], nodes[k]) for a in linked]
                            asking, stacked = [a for n, a in enumerate(asking) if n not in linked], None
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return task


def _regions_open(members: DataFrame, roots: DataFrame, signed: DataFrame, least: float, parts: int, best: bool) -> DataFrame:
    """What _opened gives for the regions that hold more than one group, staged.

    All pairs in different groups have a member outside the region's largest group, so those members
    (minor) are met with all others, in blocks. Minor members are dealt over as many blocks as they
    fill alone, so a region that is one group but for a few is given once, not once for each of its blocks.
    """
    grouped = staged(with_root(members.select("tree", "region", "node").distinct(), roots), "members-roots")
    by_group = grouped.groupBy("tree", "region", "root").agg(F.count("*").alias("n"))
    regions = by_group.groupBy("tree", "region").agg(F.count("*").alias("groups"), F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("most")).filter("groups > 1")
    counts = [F.expr(f"cast(ceil({n} / {REGION}) as int)").alias(name) for n, name in (("size", "blocks"), ("(size - most.n)", "minor_blocks"))]
    regions = staged(regions.select(F.col("tree").alias("t"), F.col("region").alias("g"), F.col("most.root").alias("major"), *counts), "regions")
    rows = grouped.join(checked(regions), (F.col("tree") == F.col("t")) & (F.col("region") == F.col("g"))).drop("t", "g")
    rows = rows.withColumn("minor", F.col("root") != F.col("major"))
    of = ["minor", "node", "root"]
    whole = rows.filter("blocks = 1").select("tree", "region", F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("minor").alias("left"), F.lit(True).alias("right"), *of)
    large = rows.filter("blocks > 1")

    def place(name: str):
        return F.pmod(F.xxhash64("node"), F.col(name)).cast("int")

    def each(name: str):
        return F.explode(F.expr(f"sequence(0, {name} - 1)"))

    as_left = large.filter("minor").select("tree", "region", place("minor_blocks").alias("i"), each("blocks").alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"), *of)
    as_right = large.select("tree", "region", each("minor_blocks").alias("i"), place("blocks").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"), *of)
    key = ["tree", "region", "i", "j"]
    dealt = whole.union(as_left).union(as_right).join(signed.withColumnRenamed("node", "signed"), F.col("node") == F.col("signed")).drop("signed")
    opened = staged(dealt.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(_opened(least, best), OPENED), "opened")
    drop(grouped, regions)
    return opened


def _groups_met(asked: DataFrame, grouped: DataFrame, texts: DataFrame, signed: DataFrame, percent: int, least: float, parts: int) -> DataFrame:
    """Links, staged, of the documents asked (node, root) with members of that group; grouped: node, root of all documents.

    Both sides are cut into blocks, and each block of one meets each of the other. A document
    needs one link with a group, so its search in a block ends with the first.
    """
    asked = staged(asked, "asked")
    wanted = staged(asked.select("root").distinct(), "asked-roots")
    members = staged(grouped.join(checked(wanted), "root", "left_semi"), "group-members")
    needed = staged(members.select("node").union(asked.select("node")).distinct(), "group-needed")
    held = texts.join(checked(needed), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "text")
    held = staged(held.join(signed, "node"), "group-texts")
    sizes = held.select("node", F.length("text").alias("chars"))

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.join(sizes, "node").groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("chars") / BLOCK_CHARS)).cast("int").alias(name))

    deal = staged(blocks(asked, "rows_i").join(blocks(members, "rows_j"), "root"), "group-blocks")

    def place(name: str):
        return F.pmod(F.xxhash64("node"), F.col(name)).cast("int")

    def each(name: str):
        return F.explode(F.expr(f"sequence(0, {name} - 1)"))

    dealt = checked(deal)
    asking = asked.join(dealt, "root").select("root", place("rows_i").alias("i"), each("rows_j").alias("j"), F.lit(0).alias("role"), "node")
    others = members.join(dealt, "root").select("root", each("rows_i").alias("i"), place("rows_j").alias("j"), F.lit(1).alias("role"), "node")
    rows = asking.union(others).join(held, "node").select("root", "i", "j", "role", "node", "signature", "text")
    rows = rows.repartitionByRange(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "role")
    links = staged(rows.mapInArrow(_met(percent, least), "u long, v long"), "links")
    drop(asked, wanted, members, needed, held, deal)
    return links


def near_duplicates(docs: DataFrame, row: str, percent: int = 75, margin: float = 0.16) -> DataFrame:
    """A row for each document: row, doc_id, n_shingles, component_id, kept, first (the component's first row).

    docs has a column row of distinct longs, the same in every run, beside doc_id and text (see
    with_rows). Documents are linked when 100 times the intersection of their sets of five-word
    shingles (ASCII letters in lower case) is percent times the union or more; with fewer words, the
    set is the whole sequence. Documents without a word, or with null text, are linked with nothing.
    Documents with equal sets are linked, and stand in the forest once. component_id is the least doc_id
    that links reach; null ids come after all others. A component's first row is that of the least
    doc_id, then of the least row. An empty table gives an empty result.

    A pair with a similarity of 0.75 meets in a region of one of the 32 trees at least but for 5 cases
    in a million. Pairs whose signatures agree in fewer than percent / 100 - margin of 128
    values are not verified: four standard deviations below the threshold, 15 cases in a million. The trees are
    made for these similarities: a percent below 75 would lose links and is refused. Long texts are compared whole.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent must be from 75 to 100")
    with shuffles_freed(docs.sparkSession):
        return _near_duplicates(docs, row, percent, margin)


def _near_duplicates(docs: DataFrame, row: str, percent: int, margin: float) -> DataFrame:
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(row).alias("row"), "text")
    given = docs.select(F.col(row).alias("row"), "text", "doc_id")
    described = staged(given.mapInArrow(_describe, f"{DESCRIBED}, doc_id {given.schema['doc_id'].dataType.simpleString()}"), "described")
    base = staged(described.drop("signature"), "described-ids")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    reps = staged(base.filter("n_shingles > 0").groupBy("f1", "f2").agg(first).select("f1", "f2", F.col("first.row").alias("node"), "first"), "classes")
    signed = staged(described.select("row", "signature").join(reps.select("node"), F.col("row") == F.col("node")).select("node", "signature"), "signatures")
    drop(described)
    order = ["tree", "region", "r1", "r2", "node"]
    sorted_ = signed.mapInArrow(_orders, "tree int, region long, r1 long, r2 long, node long").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    members = staged(sorted_.mapInArrow(_neighbours, MEMBERS), "members")

    met = members.filter("before is not null").groupBy(F.least("node", "before").alias("u"), F.greatest("node", "before").alias("v")).agg(F.struct(F.count("*").alias("trees"), F.max("depth").alias("depth")).alias("rank"))
    met = staged(met, "neighbours")
    both = met.select(F.col("u").alias("of"), "u", "v", "rank").union(met.select(F.col("v").alias("of"), "u", "v", "rank"))
    best = both.groupBy("of").agg(F.max(F.struct("rank", "u", "v")).alias("b")).select("b.u", "b.v").distinct()
    links = confirmed(texts, best, percent, parts)
    roots = extended(None, links)
    drop(links)

    least = percent / 100 - margin
    a, b = signed.select(F.col("node").alias("u"), F.col("signature").alias("s")), signed.select(F.col("node").alias("v"), F.col("signature").alias("t"))
    apart = with_root(with_root(met.select("u", "v"), roots, "u", "ru"), roots, "v", "rv").filter("ru <> rv").select("u", "v")
    alike = apart.join(a, "u").join(b, "v").select("u", "v", "s", "t").mapInArrow(_alike(least), "u long, v long")
    links = confirmed(texts, alike, percent, parts)
    roots = extended(roots, links)
    drop(links, met)

    opened = _regions_open(members, roots, signed, least, parts, best=True)
    top = opened.groupBy("node").agg(F.max(F.struct("agree", "other")).alias("top")).select(F.least("node", "top.other").alias("u"), F.greatest("node", "top.other").alias("v")).distinct()
    links = confirmed(texts, top, percent, parts)
    roots = extended(roots, links)
    drop(opened, links)

    opened = _regions_open(members, roots, signed, least, parts, best=False)
    asked = opened.select("node", F.col("other").alias("root")).distinct()
    links = _groups_met(asked, with_root(reps.select("node"), roots), texts, signed, percent, least, parts)
    roots = extended(roots, links)
    drop(opened, links, members, signed)

    classes = staged(with_root(reps, roots).select("f1", "f2", "root", "first"), "class-roots")
    whole = classes.groupBy("root").agg(F.min("first").alias("lead"))
    leads = staged(classes.join(whole, "root").select("f1", "f2", "lead"), "class-leads")
    drop(classes, reps, roots)
    some = base.filter("n_shingles > 0").join(checked(leads), ["f1", "f2"])
    none = base.filter("n_shingles = 0").withColumn("lead", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    out = some.unionByName(none)
    return out.select("row", "doc_id", "n_shingles", F.col("lead.doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("lead.doc_id")).alias("kept"), (F.col("lead.row") == F.col("row")).alias("first"))


def as_read(docs: DataFrame) -> bool:
    """Whether docs is a table of files just as spark.read gives it, with no union, explode or other step on top."""
    return bool(docs.inputFiles()) and docs._jdf.queryExecution().analyzed().children().isEmpty()


def with_rows(docs: DataFrame, columns: list[str] | None = None, files: bool = True) -> tuple[DataFrame, str]:
    """docs (or columns of it) with a column of distinct row numbers, the same in every run, and that column's name.

    Rows of a table as read from files are numbered by their file, in the order of paths, and their place in
    it; any other table is written first, as its rows may share a place or have none. Without files, every
    table is written first.
    """
    row, columns = fresh(docs, "row"), columns or docs.columns
    if not (files and as_read(docs)):
        return staged(docs.select(*columns, F.monotonically_increasing_id().alias(row)), "rows"), row
    name, number = fresh(docs, "row_file"), fresh(docs, "row_file_number")
    place = docs.metadataColumn("_metadata")
    paths = docs.select(place["file_path"].alias(name)).distinct()  # a row for each file
    paths = checked(staged(paths.select(name, F.row_number().over(Window.orderBy(name)).cast("long").alias(number)), "files"))
    at = docs.select(*columns, place["file_path"].alias(fresh(docs, "row_path")), place["row_index"].alias(fresh(docs, "row_index")))
    at = at.join(paths, at[fresh(docs, "row_path")] == paths[name])
    return at.select(*columns, (F.shiftleft(number, 40) + F.col(fresh(docs, "row_index"))).alias(row)), row


def drop_near_duplicates(docs: DataFrame, percent: int = 75, files: bool = True) -> DataFrame:
    """docs with the first document of each component, all columns as they are; files as for with_rows.

    Documents without a word or with null text all stay, and so does the first of rows alike in all
    columns; long texts are compared whole. An empty table gives an empty result; columns of any name are carried along.
    """
    stored, row = with_rows(docs, files=files)
    of = fresh(docs, "first_row")
    first = staged(near_duplicates(stored, row, percent).filter("first").select(F.col("row").alias(of)), "first-rows")
    return stored.join(checked(first), stored[row] == F.col(of), "left_semi").select(*docs.columns)
