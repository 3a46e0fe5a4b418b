"""Near-duplicate groups from bottom-k sketches of one hash function.

A document's set holds its distinct word shingles. Its sketch is the ``K`` smallest shingle hashes.
Inverted lists of retained values generate candidate pairs, the share of common values among the ``K``
smallest of the union estimates their similarity, and full sets confirm every link.

How large groups stay affordable:

* Texts with equal sets are one class; only its representative (smallest id) goes on.
* A pair at the threshold shares at least ``SURE`` of ``K`` retained values (missed with probability
  below 1e-6), so each sketch is listed only under its ``K - SURE + 1`` rarest values; a set of up to ``K``
  values is listed by the least number it surely shares (``least_shared``). Values of common
  lines and passages are left to texts that consist of little else.
* Lists of up to ``SHORT`` members give all their pairs. A longer list compares its members with one hub,
  its member with the fewest unshared values. Links already found are contracted, and only members outside
  a list's largest component are then compared with the rest of the list, in bounded blocks, in every such list.

Defined results: null, empty or blank texts have an empty set and are linked with nothing; a text of
fewer words than a shingle has one shingle, all its words; rows that share a doc_id count as one document
whose texts may each link; a null doc_id is never linked, has a null component and is kept.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, id_bit, id_bits, join_lists, lookup_by_group, map_text, text_slices
from palimpsest.llm.textscan import mix, scan

#: Retained values of a sketch, and how many a pair at the threshold shares with near certainty.
K, SURE = 32, 13
#: Common values among the K smallest of a union below which no pair is verified.
LEAST_SHARED = 14
#: Members of a list that gives all its pairs.
SHORT = 24
#: Members of a block in which a long list is compared, and shingles of a part that confirms its links.
BLOCK, PART = 512, 1 << 18

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets per text and all distinct shingle hashes, ascending within a text."""
    words = scan(texts)
    n, m = len(texts), len(words.hash)
    counts = np.bincount(words.doc, minlength=n)
    doc = [words.doc[: m - width + 1][words.doc[: m - width + 1] == words.doc[width - 1 :]]] if m >= width else []
    value = []
    if m >= width:
        at = np.flatnonzero(words.doc[: m - width + 1] == words.doc[width - 1 :])
        total = np.zeros(len(at), np.uint64)
        for j in range(width):
            total += mix(words.hash[at + j] + _C[j % 5]) * np.uint64(2 * j + 1) * _C[(j + 1) % 5]
        value.append(mix(total))
    first = np.concatenate([[0], np.cumsum(counts)])
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        own = words.hash[first[d] : first[d + 1]]
        total = np.array([len(own)], np.uint64) * _C[4]
        for j in range(len(own)):
            total += mix(own[j : j + 1] + _C[j % 5]) * np.uint64(2 * j + 1) * _C[(j + 1) % 5]
        doc.append(np.array([d]))
        value.append(mix(total))
    if not value:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint64)
    doc, value = np.concatenate(doc), np.concatenate(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])])
    doc, value = doc[new], value[new]
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]), value


def _texts(part: pa.RecordBatch) -> list[bytes | None]:
    return part.column(1).cast(pa.binary()).to_pylist()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), f1, f2 (set fingerprint), sketch (K smallest hashes, ascending)."""

    def work(part: pa.RecordBatch) -> dict:
        offsets, value = shingle_sets(_texts(part), width)
        n = np.diff(offsets)
        total = [np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ c), dtype=np.uint64)]) for c in _C[:2]]
        f1, f2 = ((t[offsets[1:]] - t[offsets[:-1]]).view(np.int64) for t in total)
        keep = np.minimum(n, K)
        begin = np.concatenate([[0], np.cumsum(keep)])
        at = np.repeat(offsets[:-1] - begin[:-1], keep) + np.arange(begin[-1])
        small = (value[at] >> np.uint64(1)).view(np.int64)
        return {
            "doc_id": part.column(0), "n": n.astype(np.int64), "f1": f1, "f2": f2,
            "sketch": pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(small)),
        }

    return map_text(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, n long, f1 long, f2 long, sketch array<long>")


def full_sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """id, all (every shingle hash, ascending) of the documents in ``wanted`` (id) and, rarely, of others."""
    bits = docs.sparkSession.sparkContext.broadcast(id_bits(wanted, "id"))

    def run(batches):
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits.value[at >> 3] >> (at & 7)) & 1 > 0))
            for part in text_slices([batch], 1):
                offsets, value = shingle_sets(_texts(part), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([value[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], ["id", "all"])

    some = docs.filter("doc_id is not null").select("doc_id", "text", id_bit(F.col("doc_id")).alias("bit"))
    return some.mapInArrow(run, "id long, all binary")


def _similar_sizes(a: Column, b: Column, t: Fraction) -> Column:
    return F.least(a, b) * t.denominator >= F.greatest(a, b) * t.numerator


def least_shared(n: int, t: Fraction) -> int:
    """Retained values that a set of ``n`` values, at most ``K``, surely shares with the sketch of any set at the threshold ``t``."""
    alike = [-(-n * t.numerator // t.denominator)]
    # A larger set of m values shares a number that reaches t, of which its sketch drops at most m - K.
    for m in range(K + 1, n * t.denominator // t.numerator + 1):
        alike.append(-(-(n + m) * t.numerator // (t.numerator + t.denominator)) - (m - K))
    return max(1, min(alike))


def _promising(a: Column, b: Column, na: Column, nb: Column, t: Fraction) -> Column:
    """Whether the estimate from two sketches admits the threshold; sets of up to K in all are exact."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    exact = F.size(F.array_union(a, b)) * t.numerator <= F.size(F.array_intersect(a, b)) * t.denominator
    return _similar_sizes(na, nb, t) & F.when((na <= K) & (nb <= K) & (F.size(F.array_union(a, b)) <= K), exact).otherwise(shared >= LEAST_SHARED)


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("all").alias("all_a"))
    right = sets.select(F.col("id").alias("b"), F.col("all").alias("all_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "all_a", "all_b")

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
                y = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                if _linked(x, y, t):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, t: Fraction) -> bool:
    n = _common(x, y)
    return n > 0 and n * t.denominator >= (len(x) + len(y) - n) * t.numerator


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, comp (smallest id reachable) of all ids in ``links`` (a, b), by smallest neighbours and pointer jumps."""
    edges = scratch.cut(links.select("a", "b").union(links.select("b", "a")).toDF("src", "dst").distinct())
    labels = scratch.cut(edges.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("id"), F.least("src", "m").alias("comp")))
    while True:
        of = labels.toDF("dst", "near")
        least = edges.join(of, "dst").groupBy("src").agg(F.min("near").alias("near"))
        step = labels.join(least.withColumnRenamed("src", "id"), "id").select("id", F.least("comp", "near").alias("next"), "comp")
        jump = step.join(labels.toDF("next", "far"), "next").select("id", F.least("next", "far").alias("comp"), (F.least("next", "far") != F.col("comp")).alias("moved"))
        new = scratch.cut(jump)
        moved = new.filter("moved").limit(1).count()
        scratch.drop(labels)
        labels = new.select("id", "comp")
        labels._scratch_path = new._scratch_path
        if not moved:
            scratch.drop(edges)
            return labels


def near_duplicates(docs: DataFrame, width: int = 5, threshold: str = "0.8", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of ``docs`` (doc_id, text, ...)."""
    t = Fraction(threshold)
    scratch = scratch or Scratch(docs.sparkSession, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scratch.cut(sketches(docs, width))

    # Classes of equal sets. Sketches of representatives alone go on.
    key = ["f1", "f2", "n"]
    some = found.filter("n > 0 and doc_id is not null").select("doc_id", *key)
    members = lookup_by_group(some, key, {"rep": F.min("doc_id")}, scratch)
    alone = found.filter("n = 0 or doc_id is null").select("doc_id", *key, F.lit(None).cast("long").alias("rep"))
    members = scratch.cut(members.union(alone))
    firsts = members.filter("doc_id = rep").select("doc_id", *key).distinct()
    reps = scratch.cut(found.join(firsts, ["doc_id", *key], "left_semi").dropDuplicates(["doc_id", *key]).select(F.col("doc_id").alias("id"), "n", "sketch"))
    scratch.drop(found)

    # Postings under values that two classes share, with the number of classes that hold each.
    posts = reps.select("id", F.explode("sketch").alias("value"))
    counted = lookup_by_group(posts, ["value"], {"df": F.count("*")}, scratch, least=2)
    held = F.least(F.col("n"), F.lit(K))
    sure = F.when(F.col("n") > K, F.lit(SURE)).otherwise(F.get(F.array(*[F.lit(least_shared(i, t)) for i in range(K + 1)]), F.col("n").cast("int")))
    ranked = F.array_sort(F.collect_list(F.struct("df", "value")))
    listed = counted.groupBy("id").agg(ranked.alias("v")).join(reps, "id")
    private = held - F.size("v")
    room = F.greatest(F.lit(0), held - sure + 1 - private).cast("int")
    listed = listed.select("id", "n", "sketch", private.alias("private"), F.slice("v", F.lit(1), room).alias("all")).select("*", F.posexplode("all").alias("pos", "v"))
    # Estimates need only the order and equality of retained values: their upper 31 bits.
    short_sketch = F.transform("sketch", lambda x: F.shiftright(x, 32).cast("int")).alias("sketch")
    # The values that a text is listed under before a long one: a pair is compared in the first list that it shares, and in no later one.
    before = F.when(F.col("v.df") > SHORT, F.transform(F.slice("all", F.lit(1), F.col("pos")), lambda x: x["value"])).alias("before")
    listed = scratch.cut(listed.select("id", "n", short_sketch, "private", "v.value", "v.df", before))
    scratch.drop(reps)

    # Short lists give all their pairs.
    short = listed.filter(F.col("df") <= SHORT)
    x, y = short.alias("x"), short.alias("y")
    ok = _promising(F.col("x.sketch"), F.col("y.sketch"), F.col("x.n"), F.col("y.n"), t)
    short_pairs = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.id") < F.col("y.id")) & ok).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    # Long lists compare members with a hub.
    long = listed.filter(F.col("df") > SHORT)
    hub = F.struct("private", F.xxhash64("id", "value").alias("h"), "id", "n", "sketch")
    starred = lookup_by_group(long, ["value"], {"hub": F.min(hub)}, scratch)
    ok = _promising(F.col("sketch"), F.col("hub.sketch"), F.col("n"), F.col("hub.n"), t)
    hub_pairs = starred.filter((F.col("id") != F.col("hub.id")) & ok).select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b"))
    pairs = scratch.cut(short_pairs.union(hub_pairs).distinct())

    # Every text's first pairs are verified, then those that still join two components.
    sets = scratch.cut(full_sets(docs, width, pairs.select(F.explode(F.array("a", "b")).alias("id"))))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e")).select("e.*")
    first = ends.groupBy("id").agg(F.min(F.struct(F.xxhash64(F.least("id", "other"), F.greatest("id", "other")).alias("h"), "other")).alias("m"))
    first = scratch.cut(first.select(F.least("id", "m.other").alias("a"), F.greatest("id", "m.other").alias("b")).distinct())
    links = scratch.cut(_verified(first, sets, t))
    comps = first_comps = components(links, scratch)
    rest = _between(pairs.join(first, ["a", "b"], "left_anti"), comps)
    rest = scratch.cut(rest)
    more = scratch.cut(_verified(rest, sets, t))
    links_so_far = links.union(more)
    comps = components(links_so_far, scratch)
    scratch.drop(sets, first_comps, first, rest, pairs)

    # Members of long lists outside a list's largest component meet the rest of the list.
    labelled = scratch.cut(long.join(comps, "id", "left").select("id", "n", "sketch", "before", "value", "df", F.coalesce("comp", "id").alias("comp")))
    scratch.drop(listed)
    sizes = labelled.groupBy("value", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("value").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("m"))
    main = main.filter("m > top.c").select("value", F.col("top.comp").alias("main"), F.col("m").alias("members"), (F.col("m") - F.col("top.c")).alias("seekers"))
    opened = scratch.cut(join_lists(labelled, main, ["value"], "members", scratch).drop("df"))
    scratch.drop(labelled)
    if opened.limit(1).count():
        found_late = _late_links(opened, docs, width, t, scratch)
        early_comps, comps = comps, components(links_so_far.union(found_late), scratch)
        scratch.drop(found_late, early_comps)
    scratch.drop(links, more, opened)

    ided = members.join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    ided = ided.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", "doc_id").alias("component_id"))
    return ided.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _late_links(opened: DataFrame, docs: DataFrame, width: int, t: Fraction, scratch: Scratch) -> DataFrame:
    """Links between members of a long list outside its largest component and its other members.

    Members look in every list of theirs: a partner may share any one of them. Of the lists that a pair shares only the first, by
    ``df`` and value, compares it; a short one has done so before. Both sides are dealt into blocks of about ``BLOCK`` sketches. Two blocks that meet in one task tell which of their texts have a promising partner in another component; the full sets
    of these alone follow, in parts of about ``PART`` shingles, and confirm links. No row is made per pair.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    held = ["id", "n", "sketch", "before", "comp", "value"]
    s = opened.filter("comp != main").select(*held, own("seekers").alias("sb"), every("members").alias("rb"), F.lit(True).alias("seeks"))
    r = opened.select(*held, every("seekers").alias("sb"), own("members").alias("rb"), F.lit(False).alias("seeks"))

    def promising(table: pa.Table) -> pa.Table:
        seeks = table["seeks"].to_numpy()
        a, b = np.flatnonzero(seeks), np.flatnonzero(~seeks)
        i, j = _promising_pairs(table, a, b, t)
        a, b, size = a[i], b[j], table["n"].to_numpy()
        # Texts with a partner are dealt into parts by their sizes; a part meets another where a pair of them has to be confirmed.
        part = np.zeros(len(size), np.int64)
        for side in (np.unique(a), np.unique(b)):
            part[side] = (np.cumsum(size[side]) - size[side]) // PART
        meets = np.unique(np.stack([part[a], part[b]], 1), axis=0)
        rows, left, right = [], [], []
        for p, q in meets.tolist():
            both = (part[a] == p) & (part[b] == q)
            some = np.concatenate([np.unique(a[both]), np.unique(b[both])])
            rows.append(some)
            left.append(np.full(len(some), p))
            right.append(np.full(len(some), q))
        whole = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        out = table.take(pa.array(whole(rows), pa.int64()))
        return out.append_column("pa", pa.array(whole(left), pa.int64())).append_column("pb", pa.array(whole(right), pa.int64()))

    kept = "id long, n long, sketch array<int>, before array<long>, comp long, value long, sb int, rb int, seeks boolean, pa long, pb long"
    found = scratch.cut(s.union(r).groupBy("value", "sb", "rb").applyInArrow(promising, kept))
    sets = full_sets(docs, width, found)

    def confirm(table: pa.Table) -> pa.Table:
        ids, comp, seeks = (table[c].to_numpy() for c in ("id", "comp", "seeks"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["all"]]
        a, b = np.flatnonzero(seeks), np.flatnonzero(~seeks)
        i, j = _promising_pairs(table, a, b, t)
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        out = []
        for x, y in zip(a[i].tolist(), b[j].tolist()):
            # One link between two components is enough.
            p, q = root(int(comp[x])), root(int(comp[y]))
            if p != q and _linked(sets[x], sets[y], t):
                joined[max(p, q)] = min(p, q)
                out.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    rows = found.join(sets, "id").groupBy("value", "sb", "rb", "pa", "pb").applyInArrow(confirm, "a long, b long")
    # A member and the components that it was in: links are between members, so the components' own links stay beside them.
    links = scratch.cut(rows)
    scratch.drop(found)
    return links


def _promising_pairs(table: pa.Table, a: np.ndarray, b: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` (rows of ``table``) of pairs in two components that may be linked.

    Common retained values are at least those among the K smallest of the union, so this admits every pair that the estimate admits.
    """
    size, comp = table["n"].to_numpy(), table["comp"].to_numpy()
    shared = _shared(table["sketch"], a, b)
    earlier = _shared(table["before"], a, b) > 0
    na, nb = size[a][:, None], size[b][None, :]
    union = na + nb - shared
    alike = np.minimum(na, nb) * t.denominator >= np.maximum(na, nb) * t.numerator
    exact = (na <= K) & (nb <= K) & (union <= K)
    good = np.where(exact, shared * t.denominator >= union * t.numerator, shared >= LEAST_SHARED)
    return np.nonzero(good & alike & ~earlier & (comp[a][:, None] != comp[b][None, :]))


def _shared(column: pa.ChunkedArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values the lists of rows ``a`` and ``b`` have in common, pair by pair."""
    lists = column.combine_chunks()
    row, value = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    place = np.full(len(lists), -1)
    place[a], place[b] = np.arange(len(a)), np.arange(len(b))
    left = np.zeros(len(lists), bool)
    left[a] = True
    _, column, often = np.unique(value, return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    order = order[often[column[order]] > 1]
    row, column = row[order], column[order]
    # Frequent values are counted by a product of matrices, of at most 1 / 32 of all values as columns; rare ones pair by pair.
    dense = often > 32
    at, some = np.cumsum(dense) - 1, dense[column]
    x, y = np.zeros((len(a), int(dense.sum())), np.float32), np.zeros((len(b), int(dense.sum())), np.float32)
    for m, side in ((x, some & left[row]), (y, some & ~left[row])):
        m[place[row[side]], at[column[side]]] = 1
    shared = np.rint(x @ y.T).astype(np.int32)
    row, column = row[~some], column[~some]
    lr, lc = row[left[row]], column[left[row]]
    rr, rc = row[~left[row]], column[~left[row]]
    lo = np.searchsorted(rc, lc, "left")
    n = np.searchsorted(rc, lc, "right") - lo
    pick = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    which, count = np.unique(place[np.repeat(lr, n)] * np.int64(max(1, len(b))) + place[rr[pick]], return_counts=True)
    shared.ravel()[which] += count.astype(np.int32)
    return shared


def _between(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    of_a, of_b = comps.toDF("a", "ca"), comps.toDF("b", "cb")
    joined = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    return joined.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def deduplicated(docs: DataFrame, width: int = 5, threshold: str = "0.8", scratch: Scratch | None = None) -> DataFrame:
    """One row of ``docs`` per group, with its columns: that with the smallest doc_id. Rows with a null doc_id stay.

    Of rows that share this doc_id the one with the smallest text (null first) stays, whichever of their texts is linked.
    """
    found = near_duplicates(docs, width, threshold, scratch)
    kept = found.filter("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    # All columns travel in one struct, so none can clash with a name used here.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"))
    first = Window.partitionBy("key").orderBy("row.text")
    one = rows.filter("key is not null").join(kept, F.col("key") == F.col("kept_id"), "left_semi").withColumn("place", F.row_number().over(first)).filter("place = 1")
    return one.select("row.*").union(rows.filter("key is null").select("row.*"))
