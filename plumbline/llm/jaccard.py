"""N-gram Jaccard join by prefix trees: documents whose sets of word n-grams are alike, exactly.

1. Each text's set of n-gram hashes (64 bits) is built once, map-side; equal sets are one set from then on.
   Packed, sorted hashes are exchanged by ranges; a range tells which n-grams several sets have, and in how
   many, and sends each set its repeated n-grams only. An n-gram of many sets of a chunk is hot: its sets
   hear of it directly and it counts as the most frequent, so that no task gathers its sets. No set is alike to another unless it shares its
   part of n-grams: the others leave here, most of any corpus.
2. N-grams are ordered globally, rare ones first. A set's prefix is so long that two alike sets must share
   an n-gram of both prefixes (the size less the least overlap, plus one). Sets with common prefix n-grams
   are grouped by connected components of links to each n-gram's smallest set: no pairs are listed.
3. In a group the sets form a compressed trie, in the global order, common n-grams first. A set is looked up by a walk that counts the
   overlap of a shared path once for all sets below it and leaves out subtrees whose lengths and remaining n-grams
   cannot reach the least overlap, or that are connected with it already. A group of many sets whose prefixes' n-grams
   part it has a trie for each of these, so that a chain of sets that share little is not searched as a whole. Groups beyond a task's size are
   cut into blocks. What is then not in a group's main component meets every block if a task holds it, and if
   not the sets of its own prefixes' n-grams, so no link is lost and no group meets itself block by block.

Null texts and texts without words have empty sets and link with nothing. A text with fewer than n words is
one n-gram of all of them. Rows with equal ids or texts are rows of their own in the result. Rows with a null
id get a component id only from others that they are linked with. Only doc_id, of an integer type, and text are read.
Words, n-grams and sets are told apart by 64-bit hashes; but for equal hashes of different ones the join is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, IntegralType, LongType, StructField, StructType
from xxhash import xxh3_64_intdigest

from plumbline.llm.common import deltas, distinct, pack, ranges_for, release, slices, trim, undeltas, unpack, written
from plumbline.llm.graph import components

CHUNK_BYTES, RANGE_BYTES, CELL_TOKENS = 16 << 20, 24 << 20, 1_000_000
#: Components of more sets, and sets of more rows, may be broadcast; and how many such there can be.
LARGE, MOST_HOT = 200, 10_000
#: An n-gram of more sets of one chunk is hot: its sets are told so at once, and do not meet.
HOT_SETS, _HOT_DF = 16, 0xFFFFFFFF
#: Odd multipliers, one for each place in an n-gram.
_PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * i + 3) * (i * i + 7)) | 1 for i in range(32)], dtype=object) % (1 << 64)


def ngram_hashes(text: bytes | None, n: int = 5) -> np.ndarray:
    """The sorted set of hashes of a text's word n-grams, A-Z lower-cased."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    z = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        z += h[i : i + len(z)] * np.uint64(_PLACES[i])
    z ^= z >> np.uint64(31)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(29)
    return distinct(z)


def _cuts(parts: int) -> np.ndarray:
    """Lower ends of ``parts`` equal ranges of 64-bit numbers, but the first."""
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def _sliced(values: np.ndarray, parts: int) -> list[tuple[int, int]]:
    at = np.concatenate([[0], np.searchsorted(values, _cuts(parts)), [len(values)]]).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


#: Kinds of blobs: n-grams and their sets; rows; n-grams that are hot, by set; hot n-grams; repeated n-grams, by set.
_NGRAMS, _ROWS, _HOT, _HOT_NAMES, _REPEATED = range(5)


def _row(part: int, kind: int, *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack(np.array([kind], np.uint8), *arrays)], pa.binary())], names=["part", "blob"])


def _by_kind(blobs: list[bytes]) -> dict[int, list[list[np.ndarray]]]:
    out: dict[int, list[list[np.ndarray]]] = {}
    for blob in blobs:
        kind, *arrays = unpack(blob)
        out.setdefault(int(kind[0]), []).append(arrays)
    return out


def _blobs(rows: pa.Table) -> list[pa.Buffer]:
    """A group's blobs as they lie in Arrow's memory."""
    return [b.as_buffer() for b in rows["blob"]]


_NONE = np.empty(0, np.uint64)


def _chunk(ids: list, texts: list, n: int, parts: int, hot_sets: int) -> Iterator[pa.RecordBatch]:
    """Blobs by range: hashes, their sets' places in a list of keys, that list; or ids, keys and sizes of rows.

    Hashes of more than ``hot_sets`` sets go to the sets' own ranges, and only their names to the hashes'."""
    sets: dict[int, int] = {}
    found, keys, sizes = [], np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint32)
    for i, text in enumerate(texts):
        s = ngram_hashes(text, n)
        sizes[i] = len(s)
        if len(s):
            key = xxh3_64_intdigest(s.tobytes()) or 1
            keys[i] = key
            if key not in sets:
                sets[key] = len(found)
                found.append(s)
    order = np.argsort(keys, kind="stable")
    known = np.array([x is not None for x in ids], np.uint8)
    numbers = np.array([x or 0 for x in ids], np.int64)
    for p, (a, b) in enumerate(_sliced(keys[order], parts)):
        if b > a:
            own = order[a:b]
            yield _row(p, _ROWS, numbers[own], known[own], keys[own], sizes[own])
    if not found:
        return
    owner = np.repeat(np.arange(len(found), dtype=np.uint32), [len(s) for s in found])
    tokens = np.concatenate(found)
    del found
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    names = np.fromiter(sets, np.uint64, len(sets))
    start = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    length = np.diff(np.append(start, len(tokens)))
    if (length > hot_sets).any():
        hot = np.repeat(length > hot_sets, length)
        t, k = tokens[hot], names[owner[hot]]
        tokens, owner = tokens[~hot], owner[~hot]
        order = np.lexsort((t, k))
        t, k = t[order], k[order]
        for q, (a, b) in enumerate(_sliced(k, parts)):
            if b > a:
                own, counts = np.unique(k[a:b], return_counts=True)
                yield _row(q, _HOT, own, counts.astype(np.uint32), t[a:b])
        t = distinct(t)
        for p, (a, b) in enumerate(_sliced(t, parts)):
            if b > a:
                yield _row(p, _HOT_NAMES, deltas(t[a:b]))
    for p, (a, b) in enumerate(_sliced(tokens, parts)):
        if b > a:
            used, place = np.unique(owner[a:b], return_inverse=True)
            yield _row(p, _NGRAMS, deltas(tokens[a:b]), place.astype(np.uint16 if len(used) < 65536 else np.uint32), names[used])


def _repeated(part: int, blobs: list[bytes], parts: int) -> Iterator[pa.RecordBatch]:
    """Of one range of hashes: to each set's own range, (key, hash, number of sets with it) of hashes of several sets."""
    trim()
    own = _by_kind(blobs)
    for arrays in own.get(_ROWS, ()):  # rows and hot n-grams are in their sets' range already
        yield _row(part, _ROWS, *arrays)
    for names, counts, t in own.get(_HOT, ()):
        yield _row(part, _REPEATED, names, counts, t, np.full(len(t), _HOT_DF, np.uint32))
    if _NGRAMS not in own:
        return
    hot = distinct(np.concatenate([_NONE, *(undeltas(t) for (t,) in own.get(_HOT_NAMES, ()))]))
    t = np.concatenate([undeltas(t) for t, _, _ in own[_NGRAMS]])
    k = np.concatenate([names[place] for _, place, names in own[_NGRAMS]])
    del own
    order = np.argsort(t)  # equal hashes are put in order of their sets below
    t, k = t[order], k[order]
    del order
    same = t[1:] == t[:-1]
    some = np.append(same, False) | np.append(False, same) | np.isin(t, hot)
    t, k = t[some], k[some]
    order = np.lexsort((k, t))
    t, k = t[order], k[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])  # a set may come from several chunks
    t, k = t[new], k[new]
    _, at, df = np.unique(t, return_inverse=True, return_counts=True)
    df = np.where(np.isin(t, hot), _HOT_DF, df[at])
    t, k, df = t[df > 1], k[df > 1], df[df > 1]
    order = np.lexsort((t, k))
    t, k, df = t[order], k[order], df[order]
    for q, (a, b) in enumerate(_sliced(k, parts)):
        if b > a:
            names, counts = np.unique(k[a:b], return_counts=True)
            yield _row(q, _REPEATED, names, counts.astype(np.uint32), t[a:b], df[a:b].astype(np.uint32))


_STATE = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("dfs", pa.binary())])


def _candidates(blobs: list[bytes], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Of one range of keys: a row for each document, and one with its repeated n-grams, rare ones first, for each set that may have an alike one."""
    trim()
    found = _by_kind(blobs)
    if _ROWS not in found:
        return
    ids, known, keys, sizes = map(np.concatenate, zip(*found[_ROWS], strict=True))
    null = lambda a, mask: pa.array(a, mask=mask)
    empty = pa.nulls(len(ids), pa.binary())
    yield pa.RecordBatch.from_arrays([null(ids, known == 0), null(keys.view(np.int64), sizes == 0), pa.array(sizes.astype(np.int64)), empty, empty], schema=_STATE)
    if _REPEATED not in found:
        return
    names, counts, tokens, dfs = map(np.concatenate, zip(*found[_REPEATED], strict=True))
    owner = np.repeat(names, counts)
    del found, names, counts
    order = np.lexsort((tokens, dfs, owner))
    owner, tokens, dfs = owner[order], tokens[order], dfs[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1]))  # a set of several chunks may be told of a hot n-gram by each
    owner, tokens, dfs = owner[new], tokens[new], dfs[new]
    own, total = np.unique(owner, return_counts=True)
    have, at = np.unique(keys, return_index=True)
    size = sizes[at][np.searchsorted(have, own)].astype(np.int64)
    ends = np.cumsum(total)
    good = np.flatnonzero(den * total >= num * size)
    for part in np.array_split(good, max(1, len(good) // 500)):
        if len(part):
            slices = [slice(ends[i] - total[i], ends[i]) for i in part]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(part), pa.int64()), pa.array(own[part].view(np.int64)), pa.array(size[part]), pa.array([tokens[s].tobytes() for s in slices], pa.binary()), pa.array([dfs[s].tobytes() for s in slices], pa.binary())], schema=_STATE
            )


# -- the trie -----------------------------------------------------------------------------------------------


class Trie:
    """A compressed trie over sorted integer sequences, in lexicographic order; nodes are ranges of them."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        m = len(sets)
        lcp = np.zeros(m + 1, np.int64)
        for i in range(1, m):
            a, b = sets[i - 1], sets[i]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            lcp[i] = differ[0] if len(differ) else k
        lcp[0] = lcp[m] = -1
        self.sets, self.sizes = sets, sizes
        # node: (first, end, depth at which its path begins, at which it ends, children; none: a leaf)
        self.nodes: list[list] = []
        stack: list[list] = []  # open nodes: [first, depth, children]
        for i in range(m):
            leaf = self._add(i, i + 1, len(sets[i]), [])
            child, depth = leaf, int(lcp[i + 1])
            while stack and stack[-1][1] > depth:
                first, own, children = stack.pop()
                children.append(child)
                child = self._add(first, i + 1, own, children)
            if stack and stack[-1][1] == depth:
                stack[-1][2].append(child)
            elif depth >= 0:
                first = self.nodes[child][0]
                stack.append([first, depth, [child]])
            else:
                self.root = child
        todo = [(self.root, 0)]
        while todo:
            i, begin = todo.pop()
            self.nodes[i][2] = begin
            todo += [(c, self.nodes[i][3]) for c in self.nodes[i][4]]
        length = np.array([len(s) for s in sets])
        self.bounds = [(int(length[a:b].max()), int(sizes[a:b].min()), int(sizes[a:b].max())) for a, b, *_ in self.nodes]

    def _add(self, first: int, end: int, depth: int, children: list[int]) -> int:
        self.nodes.append([first, end, 0, depth, children])
        return len(self.nodes) - 1

    def alike(self, i: int, marks: np.ndarray, root: np.ndarray, num: int, den: int) -> Iterator[int]:
        """Sets after the i-th, not yet connected with it (``root``), whose overlap is at least num / den of the union."""
        x, nx = self.sets[i], int(self.sizes[i])
        todo = [(self.root, 0)]
        while todo:
            at, overlap = todo.pop()
            first, end, begin, depth, children = self.nodes[at]
            if end <= i + 1 or (root[max(first, i + 1) : end] == root[i]).all():
                continue
            longest, least, most = self.bounds[at]
            if den * most < num * nx or num * least > den * nx:
                continue
            path = self.sets[first][begin:depth]
            if len(path):
                overlap += int(marks[path].sum())
                rest = len(x) - int(np.searchsorted(x, path[-1], side="right"))
            elif depth:
                rest = len(x) - int(np.searchsorted(x, self.sets[first][depth - 1], side="right"))
            else:
                rest = len(x)
            if (num + den) * (overlap + min(rest, longest - depth)) < num * (nx + max(least, -(-num * nx // den))):
                continue
            if children:
                todo += [(c, overlap) for c in children]
            elif (num + den) * overlap >= num * (nx + int(self.sizes[first])):
                yield first


class _Roots:
    """Union-find over the sets of a group."""

    def __init__(self, labels: np.ndarray):
        _, first, at = np.unique(labels, return_index=True, return_inverse=True)
        self.parent, self.left = first[at].tolist(), len(first)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
            self.left -= 1


def cell_links(keys: np.ndarray, sizes: np.ndarray, tokens: list[np.ndarray], dfs: list[np.ndarray], labels: np.ndarray, num: int = 4, den: int = 5) -> list[tuple[int, int]]:
    """Links that connect all alike sets of a group (a forest over ``labels``, which are connected already).

    tokens: of each set, in the global order, rare ones first, with their counts. A trie holds them the other way round,
    common ones first, so that paths are shared. A group of many sets is searched by the postings of its prefixes, so that sets which
    share none never meet."""
    m = len(keys)
    if m < 2 or (labels == labels[0]).all():
        return []
    ends = np.cumsum([len(t) for t in tokens])
    all_, local = np.unique(np.concatenate(tokens), return_inverse=True)
    df = np.zeros(len(all_), np.uint32)
    df[local] = np.concatenate(dfs)
    shared = np.flatnonzero(np.bincount(local) > 1)
    rank = np.full(len(all_), len(all_))
    rank[shared[np.lexsort((~all_[shared], ~df[shared]))]] = np.arange(len(shared))
    rank = rank[local]
    sets = [(r := np.sort(rank[e - len(t) : e]))[: np.searchsorted(r, len(shared))] for t, e in zip(tokens, ends, strict=True)]
    order = sorted(range(m), key=lambda i: sets[i].astype(">u4").tobytes())
    sets, sizes, keys = [sets[i] for i in order], sizes[order], keys[order]
    roots, out, marks = _Roots(labels[order]), [], np.zeros(max(1, len(shared)), bool)

    def connect(i: int, j: int) -> None:
        out.append((int(keys[i]), int(keys[j])))
        roots.join(i, j)

    for i in range(1, m):  # neighbours first: most of a group of copies is connected by them
        if roots.find(i) != roots.find(i - 1):
            marks[sets[i - 1]] = True
            if (num + den) * int(marks[sets[i]].sum()) >= num * int(sizes[i] + sizes[i - 1]):
                connect(i - 1, i)
            marks[sets[i - 1]] = False
    if roots.left == 1:
        return out
    groups = [np.arange(m)]
    if m > _FEW:
        postings = list(_postings_of(tokens, rank, ends, order, sizes, len(shared), num, den))
        if sum(len(own) ** 2 for own in postings) < m * m:  # else the postings are much the same sets over and over
            groups = postings
    for own in groups:
        root = np.fromiter(map(roots.find, own.tolist()), np.int64, len(own))
        if (root == root[0]).all():
            continue
        trie = Trie([sets[i] for i in own], sizes[own])
        for i in range(len(own) - 1):
            if (root == root[i]).all():
                break
            marks[sets[own[i]]] = True
            for j in trie.alike(i, marks, root, num, den):
                if root[i] != root[j]:
                    connect(int(own[i]), int(own[j]))
                    root[root == root[j]] = root[i]
            marks[sets[own[i]]] = False
    return out


#: A group of no more sets is one trie.
_FEW = 64


def _postings_of(tokens: list[np.ndarray], rank: np.ndarray, ends: np.ndarray, order: list[int], sizes: np.ndarray, shared: int, num: int, den: int) -> Iterator[np.ndarray]:
    """Of each n-gram in prefixes of several sets, these sets' places; equal lists of places once, short ones first."""
    place, length = [], []
    for i, k in enumerate(order):
        most = _prefix(int(sizes[i]), len(tokens[k]), num, den)
        place.append(rank[ends[k] - len(tokens[k]) : ends[k] - len(tokens[k]) + most])
        length.append(most)
    token, owner = np.concatenate(place), np.repeat(np.arange(len(order)), length)
    keep = token < shared
    by = np.lexsort((owner[keep], token[keep]))
    token, owner = token[keep][by], owner[keep][by]
    cuts = np.flatnonzero(np.append(np.append(True, token[1:] != token[:-1]), True))
    seen: set[bytes] = set()
    for i in np.argsort(np.diff(cuts), kind="stable"):
        own = owner[cuts[i] : cuts[i + 1]]
        if len(own) > 1 and (name := own.tobytes()) not in seen:
            seen.add(name)
            yield own


def _prefix(size, length, num: int, den: int):
    """How many of a set's repeated n-grams, rare ones first, hold one that any alike set's prefix has too."""
    return np.maximum(0, size - (num * size + den - 1) // den + 1 - (size - length))


_MEMBER = ["key", "n", "tokens", "dfs", "label"]


def _links_of(members: DataFrame, cell_tokens: int, num: int, den: int, name: str) -> DataFrame:
    """a, b: links of each group of ``members`` (g, key, n, tokens, dfs, label). Groups are bundled into cells of about ``cell_tokens``."""

    def run(rows: pa.Table) -> pa.Table:
        trim()
        rows, found = rows.sort_by("g").combine_chunks(), []
        g = rows["g"].to_numpy()
        cuts = np.flatnonzero(np.append(np.append(True, g[1:] != g[:-1]), True))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            own = rows.slice(i, j - i)
            tokens, dfs = ([np.frombuffer(t, kind) for t in own[c].to_pylist()] for c, kind in (("tokens", np.uint64), ("dfs", np.uint32)))
            found += cell_links(own["key"].to_numpy(), own["n"].to_numpy(), tokens, dfs, own["label"].to_numpy(), num, den)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    size = members.agg(F.coalesce(F.sum(F.octet_length("tokens")) / 8, F.lit(0))).first()[0]
    cells = max(members.sparkSession.sparkContext.defaultParallelism, int(-(-size // cell_tokens)))
    dealt = members.withColumn("cell", F.pmod(F.xxhash64("g"), F.lit(4 * cells))).repartition(cells, "cell")
    return written(dealt.groupBy("cell").applyInArrow(run, "a long, b long"), name)


def _labelled(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    found = components(links, name).select("node", F.col("label").alias("_found"))
    return nodes.join(found, nodes["key"] == found["node"], "left").withColumn("label", F.coalesce("_found", "key")).drop("node", "_found")


def _all_links(sets: DataFrame, groups: DataFrame, postings: DataFrame, num: int, den: int, cell_tokens: int) -> DataFrame:
    """Links that connect the alike sets of each group. sets: key, n, tokens, dfs; groups: node, label; postings: key, token.

    A group beyond a cell is cut into blocks by hash. What its blocks do not connect with its main component is the
    rest: up to a cell of it meets every block. More of it meets only the sets that it shares an n-gram of its prefix with;
    and if there are more of those than a cell holds, in blocks."""
    size, part = F.octet_length("tokens") / 8, lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    g = lambda *c: F.xxhash64(*c).alias("g")  # groups whose hashes are equal are searched as one
    named = groups.select("node", F.col("label").alias("comp"))
    blocks = sets.select("key", size.alias("size")).join(named, F.col("key") == F.col("node")).groupBy("comp").agg(F.ceil(F.sum("size") / cell_tokens).cast("int").alias("nb"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    named = named.join(blocks, "comp")  # names only: a set's n-grams are sent once to meet its group's name, and once to its cell
    sets = written(sets.join(named, sets["key"] == F.col("node")).select("comp", "key", "n", "tokens", "dfs", "nb", F.col("key").alias("label")), "jaccard-sets")
    links = [_links_of(sets.select(g("comp", part(F.col("nb"))), *_MEMBER), cell_tokens, num, den, "jaccard-links")]
    big = sets.where("nb > 1")
    if not big.limit(1).count():
        return links[0]

    def so_far(members: DataFrame) -> DataFrame:
        return written(_labelled(members, reduce(DataFrame.unionByName, links), "jaccard-blocks"), "jaccard-labels")

    def rest_of(now: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
        """What is not in a group's main component; and nl, how many cells it fills."""
        main = now.groupBy(group, "label").count().groupBy(group).agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        left = now.join(main, group).where("label <> main").drop("main")
        return left, left.groupBy(group).agg(F.ceil(F.sum(size) / cell_tokens).cast("int").alias("nl"))

    def against_blocks(left: DataFrame, now: DataFrame, chunks: DataFrame, group: str) -> None:
        rest = left.join(chunks, group).select(group, part(F.col("nl")).alias("i"), each("nb").alias("j"), *_MEMBER)
        whole = now.join(chunks, group).select(group, each("nl").alias("i"), part(F.col("nb")).alias("j"), *_MEMBER)
        links.append(_links_of(rest.unionByName(whole).select(g(group, "i", "j"), *_MEMBER), cell_tokens, num, den, "jaccard-links"))

    now = so_far(big)
    first = now.groupBy("comp", "label").agg(F.min("key").alias("key")).join(now.select("key", "n", "tokens", "dfs", "nb"), "key")
    links.append(_links_of(first.select(g("comp", part(F.col("nb"))), *_MEMBER), cell_tokens, num, den, "jaccard-links"))
    now = so_far(big)
    left, chunks = rest_of(now, "comp")
    chunks = written(chunks, "jaccard-rest")
    against_blocks(left, now, chunks.where("nl = 1"), "comp")
    if chunks.where("nl > 1").limit(1).count():
        wide = now.join(chunks.where("nl > 1").select("comp"), "comp", "left_semi")
        open_ = left.join(chunks.where("nl > 1").select("comp"), "comp", "left_semi").select("key")
        own = postings.join(wide.select("key"), "key", "left_semi")
        asked = own.join(open_, "key", "left_semi").select("token").distinct()
        per = own.join(asked, "token").groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("key")).alias("x")).where("c > 1")
        names = own.join(per.select("token", F.xxhash64("c", "s", "x").alias("posting")), "token").select("posting", "key").distinct()  # n-grams of the same sets are one
        met = names.join(wide.drop("comp", "nb"), "key")
        sizes = met.groupBy("posting").agg(F.ceil(F.sum(size) / cell_tokens).cast("int").alias("nb"))
        met = written(met.join(sizes, "posting"), "jaccard-postings")
        links.append(_links_of(met.where("nb = 1").select(g("posting"), *_MEMBER), cell_tokens, num, den, "jaccard-links"))
        if met.where("nb > 1").limit(1).count():
            again = so_far(met.where("nb > 1"))
            left, chunks = rest_of(again, "posting")
            against_blocks(left, again, chunks, "posting")
    return reduce(DataFrame.unionByName, links)


def join(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, parts: int | None = None, chunk_bytes: int = CHUNK_BYTES, cell_tokens: int = CELL_TOKENS, hot_sets: int = HOT_SETS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; num / den is the least similarity. parts: ranges of hashes, by the texts' bytes if not given."""
    rows = _rows_of(docs, n, num, den, parts, chunk_bytes, cell_tokens, hot_sets)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").cast(docs.schema["doc_id"].dataType).alias("component_id"))


def _rows_of(docs: DataFrame, n: int, num: int, den: int, parts: int | None, chunk_bytes: int, cell_tokens: int, hot_sets: int) -> DataFrame:
    """doc_id, key, n, _label and least of every row: its set, the set's component, and the component's smallest id."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"documents are named by integers here, and doc_id is a {kind.simpleString()}")
    parts = parts or ranges_for(docs, "text", RANGE_BYTES)

    def chunks(batches):
        ids, texts, size = [], [], 0
        for batch in slices(batches):
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc)
                texts.append(text)
                size += len(text or b"")
                if size >= chunk_bytes:
                    yield from _chunk(ids, texts, n, parts, hot_sets)
                    ids, texts, size = [], [], 0
        if ids:
            yield from _chunk(ids, texts, n, parts, hot_sets)

    packed = "part int, blob binary"
    by = lambda df: df.repartition(parts, "part").groupBy("part")
    table_of = lambda batches, schema: pa.Table.from_batches(list(batches), schema=schema)
    wire = pa.schema([("part", pa.int32()), ("blob", pa.binary())])
    ngrams = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(chunks, packed)
    repeated = by(ngrams).applyInArrow(lambda t: table_of(_repeated(t["part"][0].as_py(), _blobs(t), parts), wire), packed)
    state = by(repeated).applyInArrow(lambda t: table_of(_candidates(_blobs(t), num, den), _STATE), "doc_id long, key long, n long, tokens binary, dfs binary")
    state = written(state, "jaccard-state")
    del ngrams, repeated
    release(docs.sparkSession)  # the plans that were written are gone, and with them what they shuffled
    rows, sets = state.where("tokens is null").select("doc_id", "key", "n"), state.where("tokens is not null").select("key", "n", "tokens", "dfs")

    def prefixes(batches):
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            tokens = [np.frombuffer(t, np.uint64) for t in batch.column(2).to_pylist()]
            take = _prefix(sizes, np.array([len(t) for t in tokens], np.int64), num, den)
            all_ = np.concatenate([t[:k] for t, k in zip(tokens, take, strict=True)]) if len(tokens) else _NONE
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), take)), pa.array(all_.view(np.int64))], names=["key", "token"])

    postings = sets.select("key", "n", "tokens").mapInArrow(prefixes, "key long, token long")
    pivots = postings.groupBy("token").agg(F.min("key").alias("pivot"), F.count(F.lit(1)).alias("df")).where("df > 1").drop("df")
    edges = postings.join(pivots, "token").where("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    groups = components(edges, "jaccard-groups")
    label = components(_all_links(sets, groups, postings, num, den, cell_tokens), "jaccard-components")
    return _with_least(rows, label)


def _with_least(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Adds to rows (doc_id, key, n) their component and its smallest id.

    Copies meet as one row a set. Sets of more rows than one in MOST_HOT of all, and components of more sets, are fewer
    than MOST_HOT: these are broadcast, so that no task gathers their rows; the others meet by name."""
    own = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    own = written(own.join(label, F.col("key") == F.col("node"), "left").select("key", "least", "copies", F.coalesce("label", "key").alias("_label")), "jaccard-keys")
    found = own.groupBy("_label").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("members"))
    n_rows, n_sets = own.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count(F.lit(1))).first()
    hot = written(found.where(F.col("members") > max(LARGE, n_sets // MOST_HOT)).select("_label", F.col("least").alias("_hot")), "jaccard-hot")
    own = own.drop("least").join(F.broadcast(hot), "_label", "left")
    cold = own.where("_hot is null").drop("_hot").join(found.drop("members"), "_label")
    keys = written(cold.unionByName(own.where("_hot is not null").withColumnRenamed("_hot", "least"), allowMissingColumns=True), "jaccard-least")
    many = F.col("copies") > max(LARGE, n_rows // MOST_HOT)
    common = keys.where(many).select("key", F.col("_label").alias("_l"), F.col("least").alias("_m"))
    rows = rows.join(F.broadcast(common), "key", "left")
    few = rows.where("key is not null and _l is null").drop("_l", "_m").join(keys.where(~many).drop("copies"), "key")
    rest = rows.where("key is null or _l is not null").withColumnsRenamed({"_l": "_label", "_m": "least"})
    return few.unionByName(rest).select("doc_id", "key", "n", "_label", "least")


def representatives(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, parts: int | None = None, chunk_bytes: int = CHUNK_BYTES, cell_tokens: int = CELL_TOKENS, hot_sets: int = HOT_SETS) -> DataFrame:
    """Of each component the row with the smallest id stays; of several such rows, and of those without an id, the first by text.

    Rows without n-grams are alike if their ids and texts are equal. A row without an id stays only where its component has no row
    with one. Most ids belong to one row; only rows of other ids meet their component by their text."""
    own = written(_rows_of(docs, n, num, den, parts, chunk_bytes, cell_tokens, hot_sets).select("doc_id", "key", "_label", "least"), "jaccard-rows")
    stays = F.col("doc_id") == F.coalesce("least", "doc_id")
    ids = own.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(stays).alias("stays"))
    ids = written(ids.where("not stays or rows > 1"), "jaccard-ids")  # most ids stay and belong to one row: the others are fewer
    once = docs.where("doc_id is not null").join(ids.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    shared, unnamed = ids.where("stays and rows > 1").select("doc_id"), docs.where("doc_id is null")
    more = []
    if shared.limit(1).count():
        more.append(docs.join(shared, "doc_id", "left_semi").select(*docs.columns))
    if own.where("doc_id is null").limit(1).count():
        more.append(unnamed)
    if not more:
        return once
    at, names = docs.columns.index("text"), [*docs.columns, "__key"]

    def keyed(batches):
        for batch in batches:
            found = [ngram_hashes(None if x is None else x.encode(), n) for x in batch.column(at).to_pylist()]
            keys = np.array([(xxh3_64_intdigest(x.tobytes()) or 1) if len(x) else 0 for x in found], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64), mask=keys == 0)], names=names)

    rows = reduce(DataFrame.unionByName, more).mapInArrow(keyed, StructType([*docs.schema.fields, StructField("__key", LongType())]))
    label = own.where("key is not null").select(F.col("key").alias("__k"), F.col("_label").alias("__label"), F.col("least").alias("__least")).distinct()
    rows = rows.join(label, F.col("__key") == F.col("__k"), "left").where("doc_id is null and __least is null or doc_id = coalesce(__least, doc_id)")
    order = ["text", *(f.name for f in docs.schema.fields if isinstance(f.dataType, AtomicType) and f.name not in ("doc_id", "text"))]
    first = F.row_number().over(Window.partitionBy("__label", "doc_id", F.when(F.col("__label").isNull(), F.col("text"))).orderBy(*order))
    return once.unionByName(rows.withColumn("__first", first).where("__first = 1").select(*docs.columns))
