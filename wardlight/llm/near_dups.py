"""N-gram Jaccard join: parity-sketch join with pigeonhole keys and exact verification.

Word shingles are dealt by hash into 2**level blocks and XOR-ed inside each block. A shingle that only one of two
documents has changes one block, so two documents differ in at most as many blocks as their symmetric
difference d has shingles; a Jaccard of t bounds d, and a document whose non-empty blocks outnumber
that bound shares one of any d + 1 of them, unchanged, with each partner. The level follows the size
(octave bands; sizes close to the next band emit keys for both), blocks common in a sample go last so that
shared boilerplate is not a key, and the first d + 1 blocks are the join keys.

Candidates of a key are a star around one member. They must pass the Hamming distance of finer parity
sketches, which never exceeds d, before exact sets are compared. Members of a key that ended up in
different components are then compared sketch by sketch, so no link between components is missed, and no
group is expanded into all of its pairs. A key of many members is cut into blocks of ``BLOCK`` members, and a
task compares two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.components import connected_components
from wardlight.llm.scratch import Scratch, with_labels
from wardlight.llm.textkernel import U64, Words, mix, text_chunks, windows

#: Documents whose keys are counted to order keys by how common they are, and the most keys that are remembered. A key
#: counted HOT times there is led by an aggregate instead of a window. All steer order and plan only, not the result.
ORDER_SAMPLE, ORDER_KEYS, COMMON, HOT = 20_000, 65_536, 4, 16
SMALL = 64
#: Vertices a task remembers to pass over copies; copies beyond are removed after the shuffle.
SEEN_ROWS = 100_000
#: Up to so many ids (8 bytes each) are broadcast to pick the texts to verify; beyond, the texts are joined by id.
BROADCAST_IDS = 1_000_000
RAW_LEVEL = 63
#: A member carries its first so many keys, by which most pairs that share several keys leave from one key only.
FIRST_KEYS = 16
#: Members of a key in one block (two blocks meet in a task), rows a task compares at a time, and bytes of sketches XOR-ed at a time.
BLOCK, SLICE, XOR_BYTES = 1_024, 4_096, 4 << 20
#: Pairs a task holds before they leave or are reduced.
PAIRS = 200_000


def _level(n: int) -> int:
    return int(n).bit_length() - 1


def max_difference(a: int, b: int, num: int, den: int) -> int:
    """Largest symmetric difference of sets of a and b elements with intersection / union >= num / den."""
    return (a + b) * (den - num) // (den + num)


def shingle_sets(column: pa.Array, width: int, twins: frozenset[int] = frozenset(), every: int = 1):
    """(row, sorted distinct shingle hashes, vertex, second hash) of each text with a word, of one vertex in ``every``.

    The vertex is a hash of the whole word sequence, or its second hash where the first stands for several sequences.
    """
    for first, _, data, offsets in text_chunks(column):
        w = Words(data, offsets, fold=True)
        h, at = windows(w.hash, w.bounds, width)
        cuts = np.searchsorted(at, w.bounds)
        order = mix(np.arange(int(w.counts.max(initial=0)), dtype=U64), 1)
        for d in np.flatnonzero(w.counts):
            words = w.hash[w.bounds[d] : w.bounds[d + 1]]
            placed = words * order[: len(words)]
            both = np.array([mix(placed).sum(dtype=U64), mix(placed, 2).sum(dtype=U64)])
            whole, second = mix(both, len(words)).tolist()
            vertex = second if whole in twins else whole
            if vertex % every:
                continue
            s = mix(both[:1], len(words)) if len(words) < width else h[cuts[d] : cuts[d + 1]].copy()
            s.sort()
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            yield first + int(d), s, vertex, second


def sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles that hash to each bit; four to eight bits a shingle."""
    bits = 1 << min(15, max(8, _level(len(s)) + 2))
    return np.packbits(np.bincount((mix(s, 7) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def fold(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def block_keys(s: np.ndarray, common: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """Join keys of a shingle set: for each level it takes part in, its first d + 1 non-empty blocks."""
    n, out, h = len(s), [], mix(s, 9)
    home, most = _level(n), n * den // num
    if n < SMALL:
        levels = [(RAW_LEVEL, max_difference(n, most, num, den))]
    else:
        next_band = 2 << home
        levels = [(home, max_difference(n, min(most, next_band - 1), num, den))]
        if most >= next_band:
            levels.append((home + 1, max_difference(n, most, num, den)))
        if n * num <= (SMALL - 1) * den:  # partners below SMALL have raw keys only
            levels.append((RAW_LEVEL, max_difference(n, SMALL - 1, num, den)))
    for level, d in levels:
        keys, raw = _blocks(h, level)
        if not raw and len(keys) <= d:  # too few blocks: all of them, and raw keys for partners that fall short too
            out.append(keys)
            keys, _ = _blocks(h, RAW_LEVEL)
            d = max_difference(n, most, num, den)
        if len(common):
            at = np.searchsorted(common, keys)
            last = common[np.minimum(at, len(common) - 1)] == keys
        else:
            last = np.zeros(len(keys), bool)
        out.append(keys[np.lexsort((keys, last))[: d + 1]])
    return out


def _blocks(h: np.ndarray, level: int) -> tuple[np.ndarray, bool]:
    if level >= RAW_LEVEL:
        return np.sort(mix(h, RAW_LEVEL)), True
    block = (h >> U64(64 - level)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block = block[order]
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    value = np.bitwise_xor.reduceat(h[order], first)
    return mix(value ^ mix(block[first].astype(U64), level)), False


def _met_before(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the members with first keys a and b also share a key below ``key`` that both lists reach."""
    last = np.iinfo(np.int64).max
    reach = np.minimum(a[:, -1], b[:, -1])  # a list with fewer keys is padded with the largest number
    limit = np.minimum(key, np.where(reach == last, last, reach + 1))
    return ((a[:, :, None] == b[:, None, :]).any(axis=2) & (a < limit[:, None])).any(axis=1)


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, U64).view(np.int64))


def _groups(batches, columns: list[str]) -> Iterator[pa.Table]:
    """Sorted batches cut anew where the values of the columns change, into tables of about SLICE rows."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < 2:
            continue
        change = np.zeros(held.num_rows - 1, bool)
        for c in columns:
            x = held.column(c).to_numpy()
            change |= x[1:] != x[:-1]
        cuts, first = np.flatnonzero(change) + 1, 0
        while (more := cuts[cuts > first]).size:
            end = int(more[max(0, np.searchsorted(more, first + SLICE, side="right") - 1)])
            yield held.slice(first, end - first)
            first = end
        held = held.slice(first)
    if held is not None and held.num_rows:
        yield held


class JaccardJoin:
    """The stages of the join. A vertex v is a word sequence, named by its hash, so copies are one vertex."""

    def __init__(self, docs: DataFrame, scratch: Scratch, width: int, num: int, den: int):
        self.docs, self.scratch, self.width, self.num, self.den = docs, scratch, width, num, den
        self.twins: frozenset[int] = frozenset()

    def sets(self) -> DataFrame:
        """id, row, n (shingles), v (null without words), second, bits (the sketch, where the task has not met v before) of each row."""
        width, twins = self.width, self.twins

        def run(batches):
            seen = set()
            for b in batches:
                n, v, second, has = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, U64), np.zeros(b.num_rows, U64), np.zeros(b.num_rows, bool)
                bits: list[bytes | None] = [None] * b.num_rows
                for i, s, vertex, other in shingle_sets(b.column("text"), width, twins):
                    n[i], v[i], second[i], has[i] = len(s), vertex, other, True
                    if vertex not in seen:
                        bits[i] = sketch(s)
                        if len(seen) < SEEN_ROWS:
                            seen.add(vertex)
                yield _batch(["id", "row", "n", "v", "second", "bits"], [b.column("id"), b.column("row"), pa.array(n), *(pa.array(x.view(np.int64), mask=~has) for x in (v, second)), pa.array(bits, pa.binary())])

        return self.docs.mapInArrow(run, "id long, row long, n long, v long, second long, bits binary")

    def keys(self, common: np.ndarray, hot: np.ndarray, every: int = 1) -> DataFrame:
        """key, v, hot of the vertices (of one in ``every``, by hash); copies met again in a task are passed over."""
        width, num, den, twins = self.width, self.num, self.den, self.twins
        shared = self.docs.sparkSession.sparkContext.broadcast((common, hot))  # at most ORDER_KEYS numbers each

        def run(batches):
            common, hot = shared.value
            seen, vs, keys, held = set(), [], [], 0

            def out():
                k = np.concatenate(keys)
                warm = hot[np.minimum(np.searchsorted(hot, k), len(hot) - 1)] == k if len(hot) else np.zeros(len(k), bool)
                return _batch(["key", "v", "hot"], [pa.array(k.view(np.int64)), pa.array(np.concatenate(vs).view(np.int64)), pa.array(warm)])

            for b in batches:
                for _, s, vertex, _ in shingle_sets(b.column("text"), width, twins, every):
                    if vertex in seen:
                        continue
                    if len(seen) < SEEN_ROWS:
                        seen.add(vertex)
                    for k in block_keys(s, common, num, den):
                        vs.append(np.full(len(k), vertex, U64))
                        keys.append(k)
                        held += len(k)
                    if held > PAIRS:
                        yield out()
                        vs, keys, held = [], [], 0
            if held:
                yield out()

        return self.docs.select("text").mapInArrow(run, "key long, v long, hot boolean")

    def common_keys(self, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """The most common keys of a sample, and those of them that are hot; all stand for several vertices."""
        none = np.zeros(0, U64)
        part = self.keys(none, none, max(1, n_docs // ORDER_SAMPLE)).select("key", "v").distinct()
        top = part.groupBy("key").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(ORDER_KEYS).collect()
        as_keys = lambda rows: np.sort(np.array([r["key"] for r in rows], np.int64).view(U64))
        return as_keys(top), as_keys([r for r in top if r["count"] >= HOT])

    def keyed(self, common: np.ndarray, hot: np.ndarray) -> DataFrame:
        """key, v, m (members of the key), lead (one of them, drawn by a hash of four seeds) where m > 1.

        A hot key is dealt out by 64 salts and put together again by an aggregate, so no task gets all its members.
        """
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("v"), F.lit(64))).otherwise(-1).cast("int")
        rows = self.keys(common, hot).select("key", salt.alias("salt"), "v").repartition("key", "salt").distinct()  # all columns are keys: nothing else to carry
        part, drawn = Window.partitionBy("key", "salt"), F.struct(F.xxhash64("v", F.col("key").bitwiseAND(3)).alias("r"), "v")
        rows = rows.withColumn("m", F.count(F.lit(1)).over(part)).filter("m > 1 or salt >= 0")  # few are left
        rows = self.scratch.save(rows.withColumn("lead", F.min(drawn).over(part)), "keyed")
        out, warm = rows.filter("salt < 0").select("key", "v", "m", F.col("lead")["v"].alias("lead")), rows.filter("salt >= 0")
        if len(hot):
            leads = warm.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("lead")["v"].alias("lead")).filter("m > 1")
            out = out.unionByName(warm.select("key", "v").join(F.broadcast(leads), "key").select("key", "v", "m", "lead"))  # at most ORDER_KEYS leads
        return out

    def exact_sets(self, ids: DataFrame, orphans: DataFrame | None = None) -> DataFrame:
        """v and the sorted shingle hashes of the rows with these ids, and of the vertices (v) whose rows all lack an id."""
        width, twins = self.width, self.twins

        def run(batches):
            for b in batches:
                v, sets, held = [], [], 0
                for _, s, vertex, _ in shingle_sets(b.column("text"), width, twins):
                    v.append(vertex)
                    sets.append(s.tobytes())
                    held += s.nbytes
                    if held > XOR_BYTES:
                        yield _batch(["v", "s"], [_signed(v), pa.array(sets, pa.binary())])
                        v, sets, held = [], [], 0
                yield _batch(["v", "s"], [_signed(v), pa.array(sets, pa.binary())])

        sets = lambda rows: rows.select("text").mapInArrow(run, "v long, s binary")
        out = sets(self.docs.join(ids, "id", "left_semi"))
        if orphans is not None:
            out = out.unionByName(sets(self.docs.filter("id is null")).join(orphans, "v", "left_semi"))
        return out.dropDuplicates(["v"])

    def near(self, pairs: DataFrame, sketched: DataFrame) -> DataFrame:
        """Pairs whose parity sketches do not rule them out, with the distance."""
        num, den = self.num, self.den

        def run(batches):
            for b in batches:
                na, nb, keep, dist = b.column("na").to_numpy(), b.column("nb").to_numpy(), [], []
                for i, (x, y) in enumerate(zip(b.column("bits_a"), b.column("bits_b"))):
                    x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                    size = min(len(x), len(y))
                    d = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())
                    if d <= max_difference(int(na[i]), int(nb[i]), num, den):
                        keep.append(i)
                        dist.append(d)
                at = pa.array(keep, pa.int64())
                yield _batch(["a", "b", "d"], [b.column("a").take(at), b.column("b").take(at), pa.array(dist, pa.int64())])

        left = sketched.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
        right = sketched.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
        fits = (F.least("na", "nb") * self.den >= F.greatest("na", "nb") * self.num)
        return pairs.join(left, "a").join(right, "b").filter(fits).mapInArrow(run, "a long, b long, d long")

    def links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs whose exact Jaccard reaches the threshold."""
        num, den = self.num, self.den

        def run(batches):
            for b in batches:
                keep, sa, sb = [], b.column("sa"), b.column("sb")
                for i in range(b.num_rows):
                    x, y = np.frombuffer(sa[i].as_buffer(), U64), np.frombuffer(sb[i].as_buffer(), U64)
                    both = np.concatenate([x, y])
                    both.sort()
                    inter = int((both[1:] == both[:-1]).sum())
                    if den * inter >= num * (len(both) - inter):
                        keep.append(i)
                at = pa.array(keep, pa.int64())
                yield _batch(["a", "b"], [b.column("a").take(at), b.column("b").take(at)])

        left, right = sets.select(F.col("v").alias("a"), F.col("s").alias("sa")), sets.select(F.col("v").alias("b"), F.col("s").alias("sb"))
        return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")

    def across(self, members: DataFrame, sketched: DataFrame, nearest: bool) -> DataFrame:
        """Pairs (a, b, d) of one key's members in different components that their sketches do not rule out.

        members: key, v, comp, blocks (of the key). A row is repeated for each pair of blocks its own is in, and a task
        compares the rows of one pair of blocks; all groups of a slice advance together: rows are compared with the row o
        places on in their group, for o = 1, 2, ... Only pairs that pass leave the task; with ``nearest`` only each
        member's nearest one, which makes a round linear in the members. A pair leaves from the first key it shares.
        """
        num, den = self.num, self.den

        def tests(t: pa.Table):
            """Arrays (a, b, d) of pairs that pass, a bounded number at a time."""
            k, v, comp, n, lo, hi, own = (t.column(c).to_numpy() for c in ("key", "v", "comp", "n", "lo", "hi", "own"))
            raw = [x.as_buffer() for x in t.column("bits").combine_chunks()]
            early = np.full((t.num_rows, FIRST_KEYS), np.iinfo(np.int64).max)
            lists = t.column("early").combine_chunks()
            early[np.arange(FIRST_KEYS) < np.diff(lists.offsets.to_numpy())[:, None]] = lists.flatten().to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
            size = np.diff(np.concatenate([first, [len(k)]]))
            group, inside = np.repeat(np.arange(len(first)), size), lo == hi
            width = np.minimum.reduceat(np.array([len(x) for x in raw]), first)[group]
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                bits = np.stack([fold(np.frombuffer(raw[i], np.uint8), w) for i in rows]).view(np.uint64)
                g, cc, nn, bb, free = group[rows], comp[rows], n[rows], own[rows], inside[rows]
                for o in range(1, int(size[g].max())):
                    i = np.flatnonzero((g[o:] == g[:-o]) & (cc[o:] != cc[:-o]) & (free[:-o] | (bb[o:] != bb[:-o])))
                    i = i[np.minimum(nn[i], nn[i + o]) * den >= np.maximum(nn[i], nn[i + o]) * num]
                    for part in np.array_split(i, max(1, len(i) * int(w) // XOR_BYTES)):
                        d = np.bitwise_count(bits[part] ^ bits[part + o]).sum(axis=1)
                        ok = d <= (nn[part] + nn[part + o]) * (den - num) // (den + num)
                        x, y, d = rows[part[ok]], rows[part[ok] + o], d[ok].astype(np.int64)
                        if len(x):
                            new = ~_met_before(k[x], early[x], early[y])
                            yield np.stack([v[x[new]], v[y[new]], d[new]])

        def reduced(found: list[np.ndarray]) -> np.ndarray:
            a, b, d = np.concatenate(found, axis=1)
            if nearest:
                side, other, dd = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
                order = np.lexsort((other, dd, side))
                head = order[np.concatenate([[True], side[order][1:] != side[order][:-1]])] if len(order) else order
                a, b, d = side[head], other[head], dd[head]
            return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), d]), axis=1)

        def run(batches):
            for t in _groups(batches, ["key", "lo", "hi"]):
                found, held = [], 0
                for pairs in tests(t):
                    found.append(pairs)
                    held += pairs.shape[1]
                    if held > PAIRS:
                        found = [reduced(found)]
                        held = found[0].shape[1]
                        if held > PAIRS // 2:
                            yield _batch(["a", "b", "d"], list(map(pa.array, found[0])))
                            found, held = [], 0
                if held:
                    yield _batch(["a", "b", "d"], list(map(pa.array, reduced(found))))

        early = members.groupBy("v").agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST_KEYS).alias("early"))  # a document's keys
        own = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
        rows = members.withColumn("own", own).withColumn("other", other).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
        rows = rows.join(early, "v").join(sketched, "v").select("key", "lo", "hi", "own", "v", "comp", "n", "early", "bits")
        return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "v").mapInArrow(run, "a long, b long, d long").distinct()


def _labelled(join: JaccardJoin) -> tuple[DataFrame, DataFrame, int]:
    """(rows of ``sets``; v, comp, component_id, __n: copies, of each vertex; number of rows)."""
    scratch = join.scratch
    sized = scratch.save(join.sets(), "sized")
    twins = sized.filter("v is not null").groupBy("v").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).filter("lo <> hi").select("v").collect()
    if twins:  # sequences that share 64 bits: some hundreds among 10**11 texts
        join.twins = frozenset(r["v"] % 2**64 for r in twins)
        sized = scratch.save(join.sets(), "sized-apart")
    sketched = scratch.save(sized.filter("bits is not null").select("v", "n", "bits").dropDuplicates(["v"]), "sketched", files=sized.count() // 5_000 + 1)
    n_rows = sized.count()
    files = n_rows // 20_000 + 1  # of tables of a row a vertex
    keyed = join.keyed(*join.common_keys(n_rows))
    cand = keyed.filter("v <> lead").select(F.least("v", "lead").alias("a"), F.greatest("v", "lead").alias("b")).distinct()
    n_keyed = keyed.count()
    near = scratch.save(join.near(cand, sketched), "near", files=n_keyed // 20_000 + 1)
    heads = scratch.save(sized.filter("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "heads", files=files)  # a row to read each text from

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
        some = pairs.count() // 2_000 + 1
        chosen = scratch.save(heads.join(wanted, "v", "left_semi"), f"ids-{name}", files=some)
        ids, orphans = chosen.filter("id is not null").select("id"), chosen.filter("id is null").select("v")
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        sets = scratch.save(join.exact_sets(ids, None if orphans.isEmpty() else orphans), f"sets-{name}", files=some)
        return scratch.save(join.links(pairs, sets), f"links-{name}", files=some)

    def merged(comps: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
        """Labels after further links: components of the graph of the old labels."""
        if comps is None:
            return connected_components(links, scratch)
        old = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias(f"comp_{c}"))
        edges = links.join(old("a"), "a", "left").join(old("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
        new = connected_components(scratch.save(edges, f"edges-{name}", files=files), scratch)
        moved = comps.join(new.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
        fresh = new.join(comps.select("id"), "id", "left_anti")
        return scratch.save(moved.unionByName(fresh), f"comps-{name}", files=files)

    def crossing(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        side = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias(f"comp_{c}"))
        both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        return both.filter(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b", "d")

    def mixed_keys(comps: DataFrame, name: str) -> DataFrame:
        members = keyed.filter("m > 2").select("key", "v").join(comps.withColumnRenamed("id", "v"), "v", "left").withColumn("comp", F.coalesce("comp", "v"))
        members = scratch.save(members, f"members-{name}", files=n_keyed // 100_000 + 1)
        split = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("lo <> hi")
        return members.join(split.select("key", "blocks"), "key")

    best = Window.partitionBy("side").orderBy("d", "a", "b")

    def nearest(pairs: DataFrame) -> DataFrame:
        """Each vertex's nearest pair only."""
        ends = pairs.withColumn("side", F.explode(F.array("a", "b")))
        return ends.withColumn("r", F.row_number().over(best)).filter("r = 1").select("a", "b", "d").distinct()

    # First each vertex's nearest candidate, then its nearest one in another component, then all that still lie
    # between components.
    tested = scratch.save(nearest(near), "pairs-0", files=files)
    comps = merged(None, verified(tested, "0"), "0")
    for name, only in (("1", True), ("2", False)):
        more = join.across(mixed_keys(comps, name), sketched, only)
        more = nearest(more) if only else more
        rest = scratch.save(crossing(more.unionByName(near).distinct(), comps).join(tested.select("a", "b"), ["a", "b"], "left_anti"), f"pairs-{name}", files=n_keyed // 50_000 + 1)
        if not rest.isEmpty():
            comps = merged(comps, verified(rest, name), name)
            tested = tested.unionByName(rest)

    found = heads.join(comps.withColumnRenamed("id", "v"), "v", "left").select("v", "id", "copies", F.coalesce("comp", "v").alias("comp"))
    found = scratch.save(found, "found", files=files)
    least = scratch.save(found.groupBy("comp").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("__n")), "least", files=files)
    labels = scratch.save(with_labels(found, least, "comp", n_rows).select("v", "comp", "component_id", F.col("copies").alias("__n")), "labels", files=files)
    return sized, labels, n_rows


def _join(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str, scratch: Scratch | None, row: Column | None = None) -> JaccardJoin:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (row if row is not None else F.lit(None)).cast("long").alias("row"))
    return JaccardJoin(rows, scratch or Scratch(docs.sparkSession, "jaccard"), width, num, den)


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """id, n_shingles, component_id: one row for each row of docs.

    Two rows link when den * |A & B| >= num * |A | B| of their shingle sets; component_id is the smallest id
    reachable. Rows without words (null, empty or white space) have no shingles and link with nothing. Rows
    that repeat an id are rows of their own. A row without id takes part; a component of such rows only has no
    component_id. Very long texts are hashed in blocks. An empty table gives an empty result; other columns, of any
    names, are ignored.
    """
    sized, labels, n_rows = _labelled(_join(docs, width, num, den, id_col, text_col, scratch))
    rows, wordy = sized.select("id", "n", "v"), F.col("v").isNotNull()
    out = with_labels(rows.filter(wordy), labels.drop("comp"), "v", n_rows).unionByName(rows.filter(~wordy).withColumn("component_id", F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs without near duplicates: of each component one row stays, the one of the smallest id.

    Of several rows of that id the one of the smallest text hash stays, then the one of the smallest hash of all columns;
    a row without id stays only where no row of its component has one. So different texts under one id all stay. Rows without
    words link with nothing and stay. An empty table gives an empty result; columns of any names pass through. Which rows
    stay is settled on ids and hashes; whole rows move once.
    """
    marked = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))).withColumn("__row", row_hash(docs))
    join = _join(marked, width, num, den, id_col, text_col, scratch, F.col("__row"))
    sized, labels, n_rows = _labelled(join)
    rows = with_labels(sized.filter("v is not null").select("id", "row", "v"), labels.select("v", "comp", "__n"), "v", n_rows)
    first = F.min(F.struct(F.col("id").isNull().alias("orphan"), "id", "v", "row")).alias("f")
    stay = rows.groupBy("comp").agg(first).select(F.coalesce("f.id", F.lit(0).cast("long")).alias("__id"), F.col("f.row").alias("__row"))
    stay = join.scratch.save(stay, "stay", files=n_rows // 20_000 + 1)
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = marked.filter(worded).join(stay, ["__id", "__row"], "left_semi").dropDuplicates(["__id", "__row"])
    return kept.select(docs.columns).unionByName(docs.filter(~worded))


def row_hash(rows: DataFrame) -> Column:
    """A hash of all columns: with its id it tells a row from all that differ from it."""
    return F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in rows.columns])


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Links at a Jaccard of 0.75 or more of the five-word shingles of all documents: doc_id, n_shingles, component_id."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM words, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 3))) AS i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reached r LEFT JOIN sizes USING (doc_id) GROUP BY r.doc_id
"""
