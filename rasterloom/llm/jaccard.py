"""N-gram Jaccard self-join over documents by prefix trees.

Sets of n-word shingles stand in one global order: ordinary shingles by hash, then the
frequent ones by rising document count.  Two sets of similarity t that share k shingles
within prefixes of ``n - ceil(t n) + k`` can still reach the overlap, others cannot, so
only prefixes are exchanged, and of those only shingles that occur more than once.

Equal sets are one class from the start.  Each shared prefix shingle names a leader: the
set with the fewest unrepeated shingles among those that hold it, which is the original
of a group of near copies rather than one of them.  First every set is tried against its
leaders; components that form need no comparison inside themselves, so a group of
thousands of near copies costs a star, not all pairs.  Then the sets of one leader whose
components still differ meet once, however many shingles they share: their prefixes are
stored in a trie in the global order and all sets walk it together, level by level.  Sets
with a common beginning share the overlap counted so far, and a subtree ends where the
remaining lengths cannot reach what its smallest or largest set requires, or where it
holds one component only.  A pair counts at the leader of its first common shingle.
Leaders with many sets are dealt out by pairs of blocks.  Of the pairs that pass, those
whose bit signatures already differ in more places than linked sets can are dropped, the
others are compared in full, by a trie over the whole sets, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from . import store
from .components import components
from .words import key_bits, repeated_keys, shingle_set, short_keys, slices

#: Halvings of the hash range whose shingles are counted; prefixes hardly reach beyond it.
COUNTED_BITS = 1
#: A shingle in this many documents counts as frequent; the most frequent (32 MB at most) are put last.
FREQUENT = 32
FREQUENT_MOST = 2_000_000
#: Shingles in one trie of whole sets, about.
TRIE_SHINGLES = 32_768
#: Sets and prefix shingles of one block of a leader, about.
BLOCK_SETS = 512
BLOCK_SHINGLES = 32_768
#: Prefix shingles of the leaders that share a forest; pairs that walk at once, and cells of the table that looks up their shingles.
WALK_SHINGLES = 1 << 17
WALK_PAIRS = 1 << 18
LOOKUP_CELLS = 1 << 21
#: A set may miss one prefix shingle more for so many shingles.
SHARE = 12
_LIMIT = np.uint64((1 << (64 - COUNTED_BITS)) - 1)


def required_overlap(a: int, b: int, percent: int) -> int:
    """Least intersection of sets of a and b elements with 100 * inter >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def shared_least(n):
    """k of a set of n: the prefix is longer by k - 1, and a partner must share k of it."""
    return 1 + n // SHARE


def _beyond(n, percent: int):
    """Shingles of a set of n behind its prefix."""
    return -(-percent * n // 100) - shared_least(n)


def prefix_overlap(a, b, percent: int):
    """Least number of common prefix shingles of sets of sizes a and b that can still link.

    Common shingles up to the end of the prefix that ends first are in both prefixes;
    behind it that set has ``ceil(t n) - k`` shingles.
    """
    return np.maximum(_inside(a, b, percent), shared_least(np.minimum(a, b)))


def _inside(a, b, percent: int):
    return required_overlap(a, b, percent) - np.maximum(_beyond(a, percent), _beyond(b, percent))


def _enough(a: str, b: str, percent: int) -> str:
    """The bound of :func:`prefix_overlap` on c, as SQL."""
    rest = lambda n: f"(ceil({percent} * {n} / 100) - 1 - {n} div {SHARE})"
    return f"c >= ceil({percent} * ({a} + {b}) / {100 + percent}) - greatest({rest(a)}, {rest(b)}) and c >= 1 + least({a}, {b}) div {SHARE}"


def global_order(s: np.ndarray, frequent: np.ndarray, times: np.ndarray, bits: int) -> np.ndarray:
    """The sorted set with its frequent shingles moved behind the others, by rising count."""
    if not len(frequent) or not len(s):
        return s
    keys = short_keys(s << np.uint64(COUNTED_BITS), bits)
    at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
    common = (frequent[at] == keys) & (s < _LIMIT)
    late = s[common]
    return np.concatenate([s[~common], late[np.argsort(times[at[common]], kind="stable")]])


def signature(s: np.ndarray) -> bytes:
    """Parities of the shingles by their low bits; 4 to 8 bits a shingle, at least 64.

    Two signatures, the longer one folded to the other's length, differ in no more places
    than the sets do.
    """
    size = 1 << max(6, (4 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Signatures:
    """Signatures of many sets, folded to each length as asked."""

    def __init__(self, signatures: list[bytes]):
        self._words = [np.frombuffer(s, "<u8") for s in signatures]
        self._lengths = np.array([len(w) for w in self._words])
        self._folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _of(self, length: int, rows: np.ndarray) -> np.ndarray:
        if length not in self._folded:
            known = np.nonzero(self._lengths >= length)[0]
            folded = [np.bitwise_xor.reduce(self._words[i].reshape(-1, length), axis=0) for i in known]
            self._folded[length] = known, np.stack(folded)
        known, folded = self._folded[length]
        return folded[np.searchsorted(known, rows)]

    def differ(self, left: np.ndarray, other: Signatures, right: np.ndarray) -> np.ndarray:
        """Places in which the signatures of each pair differ."""
        lengths, out = np.minimum(self._lengths[left], other._lengths[right]), np.zeros(len(left), np.int64)
        for length in np.unique(lengths):
            for at in np.array_split(np.nonzero(lengths == length)[0], 1 + len(left) * int(length) // LOOKUP_CELLS):
                out[at] = np.bitwise_count(self._of(length, left[at]) ^ other._of(length, right[at])).sum(axis=1)
        return out


class Members:
    """Sets of some groups, ordered by group: parallel lists of group, prefix, size, label and signature."""

    def __init__(self, groups, prefixes: list[np.ndarray], sizes, labels, signatures: list[bytes]):
        self.groups, self.sizes, self.labels = (np.array(x, np.int64) for x in (groups, sizes, labels))
        self.prefixes, self.signatures = prefixes, Signatures(signatures)


class PrefixForest:
    """A trie over prefixes in global order for each group, that the sets of the groups walk at once."""

    def __init__(self, stored: Members, percent: int):
        self.percent, self.stored = percent, stored
        n, prefixes, groups = len(stored.prefixes), stored.prefixes, stored.groups
        order = sorted(range(n), key=lambda i: (groups[i], prefixes[i].tobytes()))  # keeps equal beginnings together
        tokens, parents, paths, path, nodes, last = [], [], [], np.empty(0, np.int64), 0, None
        ends = np.empty(n, np.int64)
        for i in order:
            p, shared = prefixes[i], 0
            if last is not None and groups[last] == groups[i]:
                before = prefixes[last]
                most = min(len(p), len(before))
                differ = np.nonzero(p[:most] != before[:most])[0]
                shared = int(differ[0]) if len(differ) else most
            fresh = np.arange(nodes, nodes + len(p) - shared)
            path, nodes, last = np.concatenate([path[:shared], fresh]), nodes + len(fresh), i
            tokens.append(p[shared:])
            parents.append(np.concatenate([path[shared - 1 : shared] if shared else [-1], fresh[:-1]])[: len(fresh)])
            ends[i] = path[-1]
            paths.append(path)
        tokens, parents = np.concatenate(tokens), np.concatenate(parents).astype(np.int64)
        self.longest, self.least, self.most = np.zeros(nodes, np.int64), np.full(nodes, np.iinfo(np.int64).max), np.zeros(nodes, np.int64)
        self.label = np.full(nodes, -1, np.int64)  # of all sets below, or -2
        for i, path in zip(order, paths, strict=True):
            size, label = stored.sizes[i], stored.labels[i]
            self.longest[path] = np.maximum(self.longest[path], np.arange(len(path) - 1, -1, -1))
            self.least[path], self.most[path] = np.minimum(self.least[path], size), np.maximum(self.most[path], size)
            known = self.label[path]
            self.label[path] = np.where((known == -1) | (known == label), label, -2)
        self._ends, self._end_at = _grouped(ends, nodes)
        self._children, self._child_at = _grouped(np.where(parents < 0, nodes, parents), nodes + 1)
        # the shingles of each group by number; its nodes stand together
        group_of = np.empty(nodes, np.int64)
        group_of[np.concatenate(paths)] = np.repeat(groups[order], [len(p) for p in paths])
        self._roots = np.nonzero(parents < 0)[0]
        self._root_at = np.searchsorted(group_of[self._roots], np.arange(int(groups.max()) + 2))
        bounds = np.searchsorted(group_of, np.arange(int(groups.max()) + 2))
        self._words, self._token = [], np.empty(nodes, np.int64)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            words, self._token[a:b] = np.unique(tokens[a:b], return_inverse=True)
            self._words.append(words)

    def similar(self, walkers: Members) -> Iterable[tuple[np.ndarray, np.ndarray]]:
        """(walking sets, stored sets) of pairs of one group and different labels that their prefixes and signatures allow."""
        first, widths = 0, np.array([len(w) for w in self._words])[walkers.groups]
        partners = np.bincount(self.stored.groups)[walkers.groups]
        while first < len(walkers.groups):
            cells = np.cumsum(widths[first:])
            n = max(1, min(int(np.searchsorted(cells, LOOKUP_CELLS, "right")), int(np.searchsorted(np.cumsum(partners[first:]), WALK_PAIRS, "right"))))
            at, base = np.full(int(cells[n - 1]), -1, np.int32), np.concatenate([[0], cells[: n - 1]])
            for i in range(n):
                words, p = self._words[walkers.groups[first + i]], walkers.prefixes[first + i]
                found = np.minimum(np.searchsorted(words, p), len(words) - 1)
                hit = np.nonzero(words[found] == p)[0]
                at[base[i] + found[hit]] = hit
            yield from self._walk(walkers, np.arange(first, first + n), at, base)
            first += n

    def _walk(self, walkers: Members, chosen: np.ndarray, at: np.ndarray, base: np.ndarray):
        stored, percent = self.stored, self.percent
        lengths = np.array([len(walkers.prefixes[i]) for i in chosen])
        sizes, labels = walkers.sizes[chosen], walkers.labels[chosen]
        walker, node = _spread(self._roots, self._root_at, walkers.groups[chosen])
        overlap, last = np.zeros(len(node), np.int64), np.full(len(node), -1, np.int64)
        while len(node):
            place = at[base[walker] + self._token[node]]
            overlap = overlap + (place >= 0)
            last = np.maximum(last, place)
            size, small, large = sizes[walker], self.least[node], self.most[node]
            # this part of the bound rises up to the walker's own size and falls beyond, but for rounding
            need = np.minimum(_inside(size, small, percent), _inside(size, large, percent)) - 1
            need = np.maximum(need, shared_least(np.minimum(size, small)))
            alive = overlap + np.minimum(self.longest[node], lengths[walker] - 1 - last) >= need
            alive &= (self.label[node] != labels[walker]) & (percent * size <= 100 * large) & (percent * small <= 100 * size)
            walker, node, overlap, last = walker[alive], node[alive], overlap[alive], last[alive]
            of, s = _spread(self._ends, self._end_at, node)
            q = walker[of]
            a, b = sizes[q], stored.sizes[s]
            good = (overlap[of] >= prefix_overlap(a, b, percent)) & (labels[q] != stored.labels[s]) & (percent * np.maximum(a, b) <= 100 * np.minimum(a, b))
            q, s, a, b = chosen[q[good]], s[good], a[good], b[good]
            near = walkers.signatures.differ(q, stored.signatures, s) <= a + b - 2 * required_overlap(a, b, percent)
            if near.any():
                yield q[near], s[near]
            of, node = _spread(self._children, self._child_at, node)
            walker, overlap, last = walker[of], overlap[of], last[of]


def _grouped(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by key, and where each key's places begin."""
    return np.argsort(keys, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=n))])


def _spread(values: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in keys, value) of every value of every key."""
    n = starts[keys + 1] - starts[keys]
    of = np.repeat(np.arange(len(keys)), n)
    return of, values[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + starts[keys][of]]


class Trie:
    """A path-compressed trie over token sequences in global order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())  # any order that keeps equal beginnings together
        self.root = self._node(order, 0)

    def _node(self, members: list[int], depth: int):
        """(label from, label to, of set, ends here, children, least and most length below)."""
        first, last = self.sets[members[0]], self.sets[members[-1]]
        if len(members) == 1:
            end = len(first)
        else:
            most = min(len(first), len(last))
            differ = np.nonzero(first[depth:most] != last[depth:most])[0]
            end = depth + int(differ[0]) if len(differ) else most
        ends = [i for i in members if len(self.sets[i]) == end]
        rest = [i for i in members if len(self.sets[i]) > end]
        groups: list[list[int]] = []
        for i in rest:
            if groups and self.sets[groups[-1][-1]][end] == self.sets[i][end]:
                groups[-1].append(i)
            else:
                groups.append([i])
        lengths = [len(self.sets[i]) for i in members]
        return depth, end, members[0], ends, groups, min(lengths), max(lengths)

    def similar(self, query: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """(set, overlap) of every stored set within the bound."""
        place = np.argsort(query)
        ordered, found, n = query[place], [], len(query)
        stack = [(self.root, 0, -1)]
        while stack:
            (start, end, of, ends, groups, least, most), overlap, last = stack.pop()
            need = required_overlap(n, least, percent)
            if 100 * least > 100 * n * 100 // percent + 100 or percent * n > 100 * most:
                continue
            label, pos, dead = self.sets[of], start, False
            while pos < end:
                part = label[pos : min(end, pos + 256)]
                at = np.minimum(np.searchsorted(ordered, part), n - 1)
                hit = place[at[ordered[at] == part]]
                overlap += len(hit)
                if len(hit):
                    last = max(last, int(hit[-1]))
                pos += len(part)
                if overlap + min(most - pos, n - 1 - last) < need:
                    dead = True
                    break
            if dead:
                continue
            for i in ends:
                if (100 + percent) * overlap >= percent * (n + len(self.sets[i])):
                    found.append((i, overlap))
            stack += [(self._node(g, end), overlap, last) for g in groups]
        return found


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) among candidate ``pairs(query, cid, n)``, by a trie for each query and share of its candidates."""
    sized = pairs.groupBy("query").agg(F.expr(f"ceil(sum(n) / {TRIE_SHINGLES})").cast("int").alias("shares"))
    members = pairs.join(sized, "query").select("query", F.expr("pmod(xxhash64(cid), shares)").cast("int").alias("share"), "cid")
    members = members.join(sets, "cid").select("query", "share", "cid", "toks", F.lit(1).alias("member"))
    asked = sized.select("query", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    asked = asked.join(sets, asked["query"] == sets["cid"]).select("query", "share", "cid", "toks", F.lit(0).alias("member"))
    dealt = members.union(asked).repartition("query", "share").sortWithinPartitions("query", "share", "member")

    def run(batches: Iterable[pa.RecordBatch]):
        key, query, ids, held = None, None, [], []

        def close():
            out = [ids[i] for i, _ in Trie(held).similar(query, percent)] if held and query is not None else []
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(out), pa.int64()), pa.array(out, pa.int64())], ["u", "v"])

        for batch in batches:
            for q, share, cid, toks, member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (q, share) != key:
                    if held:
                        yield close()
                    key, query, ids, held = (q, share), None, [], []
                tokens = np.frombuffer(toks, "<u8")
                if member:
                    ids.append(cid)
                    held.append(tokens)
                else:
                    query = tokens
        if held:
            yield close()

    return map_arrow(dealt, run, "u long, v long")


def _shingled(docs: DataFrame, n: int, percent: int, bitmap, frequent, bits: int) -> DataFrame:
    """doc_id, n_shingles, cls of every document; the first of a class in a task adds its set and prefix."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]):
        repeated, (common, times) = bitmap.value, frequent.value
        seen: set[bytes] = set()
        for batch in slices(batches):
            sizes, classes, tokens, prefixes, rare, signs = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, n)
                sizes.append(len(s))
                cls = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                classes.append(cls)
                toks = pre = single = sign = None
                if cls is not None and cls not in seen:
                    seen.add(cls)
                    ordered = global_order(s, common, times, bits)
                    least = -(-percent * len(s) // 100)  # of the smallest partner
                    head = ordered[: len(s) - least + shared_least(len(s))]
                    kept = np.nonzero(store.in_bitmap(repeated, short_keys(head << np.uint64(COUNTED_BITS), bits)) | (head >= _LIMIT))[0]
                    if len(kept) >= shared_least(least):
                        toks, pre, sign = ordered.tobytes(), head[kept].view(np.int64), signature(s)
                        single = 16 * (len(head) - len(kept)) // len(head)
                tokens.append(toks)
                prefixes.append(pre)
                rare.append(single)
                signs.append(sign)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(tokens, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(rare, pa.int32()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "cls", "toks", "pre", "rare", "sign"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_shingles long, cls binary, toks binary, pre array<long>, rare int, sign binary")


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (query, cid, n) of ``rows(lead, cid, n, label, mine, pre, sign)`` that differ in label and may link.

    The sets of a leader are dealt into blocks, and pairs of blocks meet; a label that
    fills half a block has blocks of its own, which never meet each other.
    """
    sized = rows.withColumn("p", F.size("pre"))
    counts = sized.groupBy("lead", "label").agg(F.count(F.lit(1)).alias("sets"), F.sum("p").alias("p"))
    counts = counts.withColumn("own", F.when((F.col("sets") > BLOCK_SETS // 2) | (F.col("p") > BLOCK_SHINGLES // 2), F.col("label")))
    own = counts.where("own is not null").select(F.col("lead").alias("ol"), F.col("own").alias("o"))
    blocks = counts.groupBy("lead", "own").agg(F.greatest(F.ceil(F.sum("sets") / BLOCK_SETS), F.ceil(F.sum("p") / BLOCK_SHINGLES)).alias("blocks"))
    homes = blocks.select(F.col("lead").alias("hl"), F.explode(F.expr("transform(sequence(1, cast(blocks as int)), i -> named_struct('own', own, 'i', i))")).alias("h"))
    homes = store.written(homes.groupBy("hl").agg(F.sort_array(F.collect_list("h")).alias("homes")), "homes")  # so that joins can split a hot leader
    own = store.written(own, "own")
    named = sized.join(own, (F.col("lead") == F.col("ol")) & (F.col("label") == F.col("o")), "left").drop("ol", "p").join(homes, F.col("lead") == F.col("hl"))
    mine = "filter(homes, h -> h.own <=> o)"
    named = named.withColumn("home", F.expr(f"{mine}[cast(pmod(xxhash64(cid), size({mine})) as int)]"))
    met = "filter(homes, h -> o is null or not (h.own <=> o))"
    name = lambda x: f"concat(coalesce(cast({x}.own as string), ''), ':', {x}.i)"
    dealt = named.select("lead", "cid", "n", "label", "mine", "pre", "sign", F.expr(name("home")).alias("home"), F.explode(F.expr(f"transform({met}, h -> {name('h')})")).alias("other"))
    dealt = dealt.withColumn("pair", F.expr("concat_ws('/', least(home, other), greatest(home, other))"))
    dealt = dealt.select("lead", "pair", "home", "cid", "n", "label", "mine", "pre", "sign").repartition("lead", "pair").sortWithinPartitions("lead", "pair")

    def run(batches: Iterable[pa.RecordBatch]):
        def members(rows: list[tuple]) -> Members:
            groups, _, sizes, labels, _, prefixes, signs = zip(*rows, strict=True)
            return Members(groups, list(prefixes), sizes, labels, list(signs))

        def close(left: list[tuple], right: list[tuple], alone: set[int]):
            out = []
            for q, s in PrefixForest(members(right), percent).similar(members(left)):
                for x, y in zip((left[i] for i in q), (right[i] for i in s), strict=True):
                    if x[0] in alone and x[1] >= y[1]:
                        continue
                    if x[5][np.isin(x[5], y[5])][0] in x[4]:
                        small, large = sorted(((x[2], x[1]), (y[2], y[1])))
                        out.append((large[1], small[1], small[0]))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["query", "cid", "n"])

        def groups():
            key, rows = None, []
            for batch in batches:
                for i, (lead, pair, home, cid, n, label) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True)):
                    if (lead, pair) != key:
                        if rows:
                            yield key[1].split("/"), rows
                        key, rows = (lead, pair), []
                    mine, pre = (batch.column(k)[i].values.to_numpy().view(np.uint64) for k in (6, 7))
                    rows.append((home, cid, n, label, mine, pre, batch.column(8)[i].as_py()))
            if rows:
                yield key[1].split("/"), rows

        left, right, alone, number, size = [], [], set(), 0, 0
        for (first, second), rows in groups():
            if first == second:
                alone.add(number)
            new = [[(number, *r[1:]) for r in rows if r[0] == home] for home in (first, second)]
            if all(new) and len(rows) > 1:
                left += new[0]
                right += new[1]
                number, size = number + 1, size + sum(len(r[5]) for r in new[1])
            if size >= WALK_SHINGLES:
                yield close(left, right, alone)
                left, right, alone, number, size = [], [], set(), 0, 0
        if left:
            yield close(left, right, alone)

    return map_arrow(dealt, run, "query long, cid long, n long")


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs(doc_id, text)``.

    Texts are lower-cased (A-Z) and split at ASCII white space; a set holds the distinct
    ``n``-word shingles, or the whole sequence of a shorter text.  Documents link when
    ``100 * intersection >= percent * union``; component_id is the smallest doc_id
    reachable.  Texts without words (null, empty, blank) have no set and are their own
    component.  Repeated rows belong to one class and all return; a null doc_id never
    becomes a component_id unless its component has no other.
    """
    spark = docs.sparkSession
    bits = key_bits(docs)

    def counted(text: str | None) -> np.ndarray:
        s = shingle_set(text, n)
        return s[: np.searchsorted(s, _LIMIT)] << np.uint64(COUNTED_BITS)

    common = store.written(repeated_keys(docs.select("text"), counted, bits), "counts")
    bitmap = store.repeated_bitmap(common.select("key"), common.count())
    top = common.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(FREQUENT_MOST).toArrow()
    keys, times = (top[c].to_numpy() for c in ("key", "n"))
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys.astype(np.uint64)[order], times[order]))
    table = _shingled(docs, n, percent, spark.sparkContext.broadcast(bitmap), frequent, bits)
    table = store.written(table.withColumn("cid", F.monotonically_increasing_id()), "shingles")
    store.discard(common)
    store.tidy(spark)

    # the written numbers stand for the digests from here on: a pair of them is an eighth of the bytes
    some = table.where("toks is not null")
    sets = some.select("cid", "toks")
    full = store.written(some.select("cls", "cid", F.col("n_shingles").alias("n"), "pre", "rare", "sign").dropDuplicates(["cls"]), "sets")
    store.tidy(spark)
    rows = full.select("cid", "n", "rare", F.explode("pre").alias("token"))
    typical = F.min(F.struct("rare", "cid", "n")).alias("lead")
    groups = rows.groupBy("token").agg(F.count(F.lit(1)).alias("g"), typical).where("g > 1").drop("g")
    prefix = store.written(rows.join(groups, "token").select("token", "cid", "n", F.col("lead.cid").alias("query"), F.col("lead.n").alias("qn")), "prefixes")

    store.tidy(spark)
    near = f"least(n, qn) * 100 >= {percent} * greatest(n, qn)"
    stars = prefix.where(f"cid != query and {near}").groupBy("query", "cid", "n", "qn").agg(F.count(F.lit(1)).alias("c"))
    stars = store.written(stars.where(_enough("n", "qn", percent)).select("query", "cid", "n"), "stars")
    star_links = store.written(_linked(stars, sets, percent), "links")
    labels = components(star_links)
    store.tidy(spark)

    named = prefix.select("token", "cid", "n", F.col("query").alias("lead")).join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("label", F.coalesce("label", "cid"))
    mixed = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("token")
    named = named.join(mixed, "token").groupBy("lead", "cid", "n", "label").agg(F.collect_list("token").alias("mine"))
    named = store.written(named.join(full.select("cid", "pre", "sign"), "cid"), "mixed")
    store.discard(prefix)
    store.tidy(spark)
    tried = stars.select("query", "cid").union(stars.select(F.col("cid").alias("query"), F.col("query").alias("cid")))
    pairs = store.written(_met(named, percent).join(tried, ["query", "cid"], "left_anti"), "pairs")
    store.discard(named)
    store.tidy(spark)
    rest_links = store.written(_linked(pairs, sets, percent), "links")
    if not rest_links.isEmpty():
        # links of one component count once from here on
        for end in ("u", "v"):
            known = labels.select(F.col("node").alias(end), "label")
            rest_links = rest_links.join(known, end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
        merged = components(rest_links.where("u != v"))
        upper = merged.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = labels.join(upper, "label", "left").select("node", F.coalesce("top", "label").alias("label")).union(merged).distinct()
    labels = labels.union(labels.select("label", "label").distinct())  # a label's own class has no row yet
    labels = store.written(labels.join(full.select(F.col("cid").alias("node"), "cls"), "node").select("cls", "label"), "labels")
    store.discard(full)
    store.tidy(spark)

    least = table.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    linked = least.join(labels, "cls")
    whole = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = linked.join(whole, "label").select("cls", "component_id")
    classes = least.join(classes, "cls", "left").select("cls", F.coalesce("component_id", "least").alias("component_id"))
    classes = store.written(classes, "components")  # so that the join below can split a class of many copies
    return table.select("doc_id", "n_shingles", "cls").join(classes, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
