"""Near-duplicate documents: an exact n-gram Jaccard join that returns components, not pairs.

1. Shingles that very many documents hold are counted (an order for step 2 only; any order gives whole results).
2. Each distinct shingle set becomes a node.  A node's prefix, its rarest few shingles, meets other nodes' in tiles:
   two sets that are similar enough share a shingle of both prefixes.  A tile holds nodes of two neighbouring size
   bands; tiles with the same nodes are one.  Exact copies are one node, so they add nothing here.
3. In a tile, parity bitmaps bound the overlap from above: hamming distance <= symmetric difference.  A search by
   breadth tests a node only against those not yet reached, and reports the tree, not all pairs.
4. The trees' components hold every link.  Their shingle sets, sorted arrays, are gathered by component and
   intersected exactly, again breadth first.

Tiles and components of more than a slice of nodes are searched slice by slice, so no group is whole in any task:
first within slices, dealt in more than one way; then what is not yet tied to the group's largest piece, block by
block, against all slices of the group.  Every pair of a group has then met or is already linked through others.

So no all-pairs list exists anywhere; exact work is done only on nodes whose bitmaps come near another's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_prefix
from .common import only, ship, tidied, write_once
from .components import components

ship(__name__)

#: Shingles whose frequency decides their place in prefixes, at most; documents of a batch that hold one, at least.
HEAVY, HEAVY_LOCAL = 1 << 16, 8
#: Prefix shingles that a task holds before it sends packets.
HELD = 500_000
#: Buckets of prefix shingles, at least.
BUCKETS = 512
#: Nodes that may be broadcast to pick documents; beyond that they are joined by a shuffle.
BROADCAST_NODES = 1_000_000
#: Nodes of a slice and bytes of its shingle sets, about; groups of up to twice that stay whole.
SLICE_NODES, SLICE_BYTES = 1024, 16_000_000
#: Ways of dealing the nodes of a group into slices.
DEALS = 4
#: Fixed odd multipliers of the words of a shingle.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def shingles(text: str, width: int):
    """The sorted distinct 64-bit hashes of a text's word n-grams; a text with fewer words is one of its own."""
    import numpy as np
    import xxhash

    hash64 = xxhash.xxh64_intdigest
    words = np.array([hash64(w) for w in text.encode("utf-8", "surrogatepass").lower().split()], "u8")
    k = min(width, len(words))
    if not k:
        return words
    n = len(words) - k + 1
    h = np.full(n, 1 + k, "u8")
    for j in range(k):
        h += words[j : j + n]
        h *= np.uint64(PRIMES[j % 5])
        h ^= h >> np.uint64(29 + j % 5)
    h *= np.uint64(PRIMES[1])
    h ^= h >> np.uint64(32)
    return np.unique(h)


def bitmap(hashes):
    """Parity of the shingles in each of as many bits as there are shingles, or up to twice that, as 64-bit words."""
    import numpy as np

    bits = 1 << max(6, (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes % np.uint64(bits)).astype("i8"), minlength=bits) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").view("<u8")


def folded(words, n_words: int):
    """Bitmaps (rows) folded to fewer words; parity lets a folded bitmap be that of fewer bits."""
    while words.shape[1] > n_words:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def similar(inter, total, percent: int):
    """Whether an intersection suffices; total: the sum of both sizes."""
    return 100 * inter >= percent * (total - inter)


def searched(sizes, near) -> Iterator[tuple[int, list[int]]]:
    """Breadth-first trees over nodes 0.. in order of size: (node, nodes first reached from it).  near(i, rest)
    says which of rest are linked with i."""
    import numpy as np

    rest = np.arange(len(sizes))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            if hit.any():
                found = rest[hit].tolist()
                rest = rest[~hit]
                queue += found
                yield i, found


def node_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def slices_of(size):
    """Slices, a power of two, for groups of so many nodes."""
    import numpy as np

    size = np.asarray(size, float)
    return np.where(size <= 2 * SLICE_NODES, 1, 2 ** np.ceil(np.log2(np.maximum(size, 1) / SLICE_NODES))).astype("i8")


def dealt(nodes, deal, slices):
    """The slice of each node (signed 64-bit) in one of the DEALS."""
    import numpy as np

    h = (nodes.view("u8") ^ (np.asarray(deal).astype("u8") + np.uint64(1)) * np.uint64(PRIMES[3])) * np.uint64(PRIMES[0])
    h ^= h >> np.uint64(31)
    return ((h * np.uint64(PRIMES[2]) >> np.uint64(32)) % np.asarray(slices).astype("u8")).astype("i8")


def heavy_shingles(rows: DataFrame, width: int) -> tuple[bytes, bytes, bytes]:
    """The most frequent shingles with their ranks and slices, sorted by shingle: at most HEAVY, whatever the corpus."""
    import numpy as np

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def flush(sets, docs):
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            often = n >= max(HEAVY_LOCAL, docs // 400)
            return pa.RecordBatch.from_arrays([pa.array(h[often].view("i8")), pa.array(n[often].astype("i8"))], names=["h", "n"])

        sets, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                sets.append(shingles(text.as_py(), width))
                size += len(sets[-1])
                if size > 3 * HELD:
                    yield flush(sets, len(sets))
                    sets, size = [], 0
        if sets:
            yield flush(sets, len(sets))

    found = rows.select("text").mapInArrow(tidied(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = [(r["h"], r["n"]) for r in found.orderBy(F.desc("n"), "h").limit(HEAVY).collect()]
    h = np.array([h for h, _ in top], "i8").view("u8")
    rank = np.arange(len(top), 0, -1).astype("u4")  # the most frequent last
    slices = slices_of([n for _, n in top])
    order = np.argsort(h)
    return h[order].tobytes(), rank[order].tobytes(), slices[order].tobytes()


def nodes_and_tiles(rows: DataFrame, width: int, percent: int, id_type: str, buckets: int) -> DataFrame:
    """One table with two kinds of rows: documents (id, key, node, n, bits; bits only where a task first sees the
    node) and packets of prefix shingles (bucket, packet)."""
    sent = rows.sparkSession.sparkContext.broadcast(heavy_shingles(rows, width))  # at most HEAVY entries
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(rows.schema["id"].dataType)
    names = ["id", "key", "node", "n", "bits", "bucket", "packet"]
    kinds = [id_arrow, pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        heavy, rank, slices = (np.frombuffer(x, kind) for x, kind in zip(sent.value, ("u8", "u4", "i8")))
        seen: set[int] = set()
        keys, owners, sizes = [], [], []
        held = 0

        def batch_of(out) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        def prefix(h):
            n = len(h)
            p = n - -(-percent * n // 100) + 1
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                place = np.where(heavy[at] == h, rank[at].astype("i8"), 0)
                if place.any():
                    return h[np.argsort(place, kind="stable")[:p]]
            return h[:p]

        def packets() -> Iterator[pa.RecordBatch]:
            """Packets of a bucket's shingles, and of its slices of shingles that need slices: those shingles are named
            in full, with the slice."""
            k = np.concatenate(keys)
            node = np.repeat(np.array(owners, "i8"), [len(x) for x in keys])
            n = np.repeat(np.array(sizes, "u4"), [len(x) for x in keys])
            parts = np.ones(len(k), "i8")
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, k), len(heavy) - 1)
                parts = np.where(heavy[at] == k, slices[at], 1)
            part = np.where(parts > 1, dealt(node, k % np.uint64(DEALS), parts), 0)
            mixed = np.where(parts > 1, (k ^ part.view("u8") * np.uint64(PRIMES[4])) * np.uint64(PRIMES[1]) >> np.uint64(32), k & np.uint64(0xFFFFFFFF))
            bucket = (mixed % np.uint64(buckets)).astype("i4")
            out = []
            for cut in (False, True):
                mine = np.flatnonzero((parts > 1) == cut)
                mine = mine[np.lexsort((n[mine], bucket[mine]))]
                names, starts = np.unique(bucket[mine], return_index=True)
                for b, own in zip(names.tolist(), np.split(mine, starts[1:])):
                    name = k[own].tobytes() + part[own].astype("<u4").tobytes() if cut else (k[own] >> np.uint64(32)).astype("<u4").tobytes()
                    head = bytes([cut]) + len(own).to_bytes(4, "little")
                    out.append((None, None, None, None, None, b, head + name + node[own].astype("<i8").tobytes() + squeeze(n[own].astype("<u4").tobytes())))
            for i in range(0, len(out), 200):
                yield batch_of(out[i : i + 200])

        for batch in batches:
            out = []
            for id_, key, text in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                h = shingles(text.as_py(), width)
                if not len(h):
                    out.append((id_.as_py(), key, None, 0, None, None, None))
                    continue
                node = xxhash.xxh64_intdigest(h.tobytes())
                node -= (node >> 63) << 64
                bits = None
                if node not in seen:
                    seen.add(node)
                    bits = bitmap(h).tobytes()
                    keys.append(prefix(h))
                    owners.append(node)
                    sizes.append(len(h))
                    held += len(keys[-1])
                out.append((id_.as_py(), key, node, len(h), bits, None, None))
                if held > HELD:
                    yield from packets()
                    keys, owners, sizes, held = [], [], [], 0
            for i in range(0, len(out), 2000):
                yield batch_of(out[i : i + 2000])
        if keys:
            yield from packets()

    table = rows.mapInArrow(tidied(run), f"id {id_type}, key long, node long, n int, bits binary, bucket int, packet binary")
    return write_once(table, "nodes")


def tiles_of(table: DataFrame, percent: int, buckets: int) -> DataFrame:
    """tile, grp, nodes array<long>: groups of nodes that share a prefix shingle and are close in size.  Where grp is
    not null the tile is a slice of that group, else it is a group of its own.  Equal tiles have equal numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math

        import numpy as np
        import xxhash
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        step = math.log(100 / percent) if percent < 100 else 1e-9

        def batches_of(tiles) -> Iterator[pa.RecordBatch]:
            """tiles: (group or None, nodes); groups of their own only once."""
            done: set[int] = set()
            out: list[tuple] = []
            size = 0
            for grp, own in tiles:
                tile = xxhash.xxh64_intdigest(np.sort(own).tobytes()) >> 1
                if grp is None:
                    if tile in done:
                        continue
                    done.add(tile)
                out.append((tile, grp, own))
                size += len(own)
                if size > 200_000:
                    yield batch_of(out)
                    out, size = [], 0
            if out:
                yield batch_of(out)

        def batch_of(out) -> pa.RecordBatch:
            tiles, groups, own = zip(*out)
            offsets = np.cumsum([0, *map(len, own)])
            nodes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(own), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(tiles, pa.int64()), pa.array(groups, pa.int64()), nodes], names=["tile", "grp", "nodes"])

        def fresh(*columns):
            """Sorted by the first columns, then n, then node, without repeats."""
            order = np.lexsort((columns[-1], columns[-2], *columns[-3::-1]))
            columns = [c[order] for c in columns]
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in (*columns[:-2], columns[-1])])
            return [c[new] for c in columns]

        def whole(bucket: int, parts):
            """Groups of one shingle that came whole; large ones are cut here."""
            key, node, n = (np.concatenate(x) for x in zip(*parts))
            key, n, node = fresh(key, n, node)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]

            def cut(name: tuple, own):
                parts = int(slices_of(len(own)))
                if parts == 1:
                    yield None, own
                    return
                grp = xxhash.xxh64_intdigest(repr((bucket, *name))) >> 1
                part = dealt(own, grp % DEALS, parts)
                for p in range(parts):
                    if (part == p).any():
                        yield grp, own[part == p]

            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                sizes = n[a:b]
                if sizes[0] * 100 >= sizes[-1] * percent:
                    yield from cut((int(key[a]),), node[a:b])
                    continue
                band = np.floor(np.log(sizes) / step).astype(int)
                for k in np.unique(band).tolist():
                    # the band and the one below; one more each way, since logarithms round
                    low, high = np.searchsorted(band, k - 2), np.searchsorted(band, k + 1)
                    low += int(np.searchsorted(sizes[low:high], sizes[np.searchsorted(band, k)] * percent // 100))
                    if high - low > 1:
                        yield from cut((int(key[a]), k), node[a:b][low:high])

        def sliced(parts):
            """Slices of shingles that were cut before they came."""
            key, part, node, n = (np.concatenate(x) for x in zip(*parts))
            key, part, n, node = fresh(key, part, n, node)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
                yield int(key[a] >> np.uint64(1)), node[a:b]

        def closed(bucket, held) -> Iterator[pa.RecordBatch]:
            if held[0]:
                yield from batches_of(whole(bucket, held[0]))
            if held[1]:
                yield from batches_of(sliced(held[1]))

        now, held = None, ([], [])
        for batch in batches:
            for bucket, packet in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now:
                    yield from closed(now, held)
                    now, held = bucket, ([], [])
                raw = packet.as_py()
                m = int.from_bytes(raw[1:5], "little")
                if raw[0]:
                    held[1].append((np.frombuffer(raw, "<u8", m, 5), np.frombuffer(raw, "<u4", m, 5 + 8 * m), np.frombuffer(raw, "<i8", m, 5 + 12 * m), np.frombuffer(open_(raw[5 + 20 * m :]), "<u4").astype("i8")))
                else:
                    held[0].append((np.frombuffer(raw, "<u4", m, 5), np.frombuffer(raw, "<i8", m, 5 + 4 * m), np.frombuffer(open_(raw[5 + 12 * m :]), "<u4").astype("i8")))
        yield from closed(now, held)

    packets = table.where(F.col("bucket").isNotNull()).select("bucket", "packet")
    return write_once(packets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(run), "tile long, grp long, nodes array<long>"), "tiles")


def may_link(n, data, percent: int):
    """near(i, rest) by bitmaps, an upper bound."""
    import numpy as np

    width = min(map(len, data)) // 8
    words = np.empty((len(data), width), "u8")
    for i, b in enumerate(data):
        words[i] = folded(np.frombuffer(b, "<u8")[None, :], width)[0]

    def near(i, rest):
        both = n[i] + n[rest]
        apart = np.bitwise_count(words[rest] ^ words[i]).sum(axis=1, dtype="i8")
        return similar((both - apart) // 2, both, percent)

    return near


def do_link(n, data, percent: int):
    """near(i, rest) by exact intersection of sorted shingle sets, behind bitmaps."""
    import numpy as np

    sets = [np.frombuffer(b, "<u8") for b in data]
    width = min(64, max(1, (1 << max(6, int(n.max() - 1).bit_length())) // 64))
    words = np.empty((len(n), width), "u8")
    for i, own in enumerate(sets):
        odd = np.bincount((own % np.uint64(64 * width)).astype("i8"), minlength=64 * width) & 1
        words[i] = np.packbits(odd.astype("u1"), bitorder="little").view("<u8")

    def near(i, rest):
        both = n[i] + n[rest]
        apart = np.bitwise_count(words[rest] ^ words[i]).sum(axis=1, dtype="i8")
        hit = similar((both - apart) // 2, both, percent)
        own = sets[i]
        for k in np.flatnonzero(hit).tolist():
            other = sets[rest[k]]
            place = np.searchsorted(own, other)
            place[place == len(own)] = 0
            hit[k] = similar(int((own[place] == other).sum()), int(both[k]), percent)
        return hit

    return near


def links_within(rows: DataFrame, maker, percent: int) -> DataFrame:
    """a, b: trees of the linked nodes of each group, from (grp, node, n, data).  A group is whole in one task; groups
    are bounded by their slices."""

    def found(group) -> Iterator[tuple[int, int]]:
        import numpy as np

        node, n, data = ([x[i] for x in group] for i in range(3))
        for i, reached in searched(n, maker(np.array(n, "i8"), data, percent)):
            for j in reached:
                yield node[i], node[j]

    return grouped(rows, ["grp"], ["node", "n", "data"], found)


def links_across(rows: DataFrame, maker, percent: int) -> DataFrame:
    """a, b: further links, from (grp, one, other, rest, comp, node, n, data): a block of nodes (rest) of a group against
    a slice of it.  Only links between different components are looked for, and no two between the same."""

    def found(group) -> Iterator[tuple[int, int]]:
        import numpy as np

        node, n, data = ([x[i] for x in group] for i in range(3))
        numbers: dict[int, int] = {}
        comp = np.array([numbers.setdefault(x[4], len(numbers)) for x in group])
        near = maker(np.array(n, "i8"), data, percent)
        for i in [i for i, x in enumerate(group) if x[3]]:
            others = np.flatnonzero(comp != comp[i])
            hit = others[near(i, others)] if len(others) else others
            while len(hit):
                yield node[i], node[int(hit[0])]
                comp[comp == comp[hit[0]]] = comp[i]
                hit = hit[comp[hit] != comp[i]]

    return grouped(rows, ["grp", "one", "other"], ["node", "n", "data", "rest", "comp"], found)


def grouped(rows: DataFrame, by: list[str], columns: list[str], found) -> DataFrame:
    """a, b: what ``found`` yields for each group of rows, in order of size, each node once."""
    width = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(pairs) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["a", "b"])

        now, group, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:width] != now:
                    out += found(group) if len(group) > 1 else ()
                    now, group = row[:width], []
                if not group or group[-1][0] != row[width]:  # else the same node from another copy of its text
                    group.append(row[width:])
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        out += found(group) if len(group) > 1 else ()
        if out:
            yield batch_of(out)

    order = [*by, "n", "node", *[F.desc(c) for c in columns if c == "rest"]]  # of two rows of a node the one of the block stays
    return rows.select(*by, *columns).repartition(*by).sortWithinPartitions(*order).mapInArrow(tidied(run), "a long, b long").distinct()


def cross_links(members: DataFrame, links: DataFrame, payload, maker, percent: int) -> DataFrame:
    """links, and those that finish the search of sliced groups.

    members: (grp, node, slices), each node of a group once; links: (a, b) found so far.  In each group the
    nodes outside its largest component meet all of its nodes, block by slice.  payload adds n and data to (node)."""
    comps = write_once(components(links, "a", "b"), "pieces")
    named = members.join(comps.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = write_once(named, "members")
    counts = named.groupBy("grp", "comp").agg(F.count("*").alias("c"))
    open_ = counts.groupBy("grp").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"), (F.sum("c") - F.max("c")).alias("outside")).where("outside > 0")
    some = named.join(open_, "grp").withColumn("blocks", F.ceil(F.col("outside") * F.col("slices") / F.col("all")).cast("int"))
    place = lambda by, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(by)).cast("int")
    all_of = some.select("grp", place("slices", 17).alias("one"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), F.lit(False).alias("rest"), "comp", "node")
    rest = some.where(F.col("comp") != F.col("main")).select("grp", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("one"), place("blocks", 23).alias("other"), F.lit(True).alias("rest"), "comp", "node")
    more = links_across(payload(all_of.unionByName(rest)), maker, percent)
    return comps.where(F.col("node") != F.col("component")).select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)


def candidate_links(tiles: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b: trees of the nodes whose bitmaps allow a link, tile by tile."""
    payload = lambda rows: rows.join(nodes.select("node", "n", F.col("bits").alias("data")), "node")
    members = tiles.dropDuplicates(["tile"]).where(F.size("nodes") > 1).select(F.col("tile").alias("grp"), F.explode("nodes").alias("node"))
    links = links_within(payload(members), may_link, percent)
    cut = tiles.where(F.col("grp").isNotNull())
    # of groups with the same slices one is enough
    of_group = cut.groupBy("grp").agg(F.sum(F.col("tile").cast("decimal(20,0)")).alias("same"), F.count("*").alias("slices"))
    kept = write_once(of_group.where("slices > 1").groupBy("same", "slices").agg(F.min("grp").alias("grp")), "groups")
    if kept.isEmpty():
        return links
    members = cut.join(kept, "grp").select("grp", F.explode("nodes").alias("node"), F.col("slices").cast("int").alias("slices"))
    return cross_links(members, write_once(links, "links"), payload, may_link, percent)


def exact_components(rows: DataFrame, wanted: DataFrame, width: int, percent: int) -> DataFrame:
    """node, component from the wanted (id, key, node, n, cluster): exact intersections within each cluster."""
    sizes = wanted.groupBy("cluster").agg(F.count("*").alias("c"), (F.sum("n") * 8).alias("bytes"))
    slices = F.greatest(F.ceil(F.col("c") / SLICE_NODES), F.ceil(F.col("bytes") / SLICE_BYTES)).cast("int")
    large = write_once(sizes.withColumn("slices", slices).where("slices > 2").select("cluster", "slices"), "large")
    small = wanted if large.isEmpty() else wanted.join(large, "cluster", "left_anti")
    sets = shingle_sets(rows, small, width).withColumnRenamed("cluster", "grp").withColumnRenamed("hashes", "data")
    links = links_within(sets, do_link, percent)
    if not large.isEmpty():
        sets = write_once(shingle_sets(rows, wanted.join(large, "cluster", "left_semi"), width), "sets")
        data = sets.select("node", "n", F.col("hashes").alias("data")).dropDuplicates(["node"])
        payload = lambda rows: rows.join(data, "node")
        members = sets.select(F.col("cluster").alias("grp"), "node").distinct().join(large.withColumnRenamed("cluster", "grp"), "grp")
        deals = members.withColumn("deal", F.explode(F.lit([*range(DEALS // 2)])))
        deals = deals.select(F.xxhash64("grp", "deal", F.pmod(F.xxhash64("node", "deal"), F.col("slices"))).alias("grp"), "node")
        links = links.unionByName(cross_links(members, write_once(links_within(payload(deals), do_link, percent), "links"), payload, do_link, percent))
    return components(links, "a", "b")


def shingle_sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """cluster, node, n, hashes for the wanted (id, key, node, cluster): those documents' texts are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters, nodes, sizes, sets, held = [], [], [], [], 0
            for cluster, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                h = shingles(text.as_py(), width)
                import xxhash

                found = xxhash.xxh64_intdigest(h.tobytes())
                if found - ((found >> 63) << 64) != node:
                    continue
                clusters.append(cluster)
                nodes.append(node)
                sizes.append(len(h))
                sets.append(h.tobytes())
                held += len(sets[-1])
                if held > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(clusters, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sets, pa.binary())], names=["cluster", "node", "n", "hashes"])
                    clusters, nodes, sizes, sets, held = [], [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(clusters, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sets, pa.binary())], names=["cluster", "node", "n", "hashes"])

    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    w = wanted.select(F.col("id").alias("w_id"), F.col("key").alias("w_key"), "node", "cluster")
    picked = rows.join(w, (rows["key"] == w["w_key"]) & rows["id"].eqNullSafe(w["w_id"]))
    return picked.select("cluster", "node", "text").mapInArrow(tidied(run), "cluster long, node long, n int, hashes binary")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row: documents whose sets of word n-grams have a Jaccard
    similarity of percent / 100 or more are linked; component_id is the smallest id reachable by links.

    Words are runs without ASCII white space, lower-cased from A to Z.  Texts with fewer words than ``width`` are
    one shingle; null texts and texts without words have none and are linked with nothing (component_id is their
    id).  Exact copies are linked.  Rows without an id take part but name no component, unless it has no other:
    then component_id is null.  Rows with the same id are documents of their own.  Further columns are left out;
    an empty table gives no rows.
    """
    out = marked(docs, width, percent, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def marked(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, key (hash of the text), n, component_id and stays: true for one document of each component, the one
    with the smallest id, then key."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    buckets = max(BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = node_rows(docs, id_col, text_col)
    table = nodes_and_tiles(rows, width, percent, id_type, buckets)
    documents = table.where(F.col("bucket").isNull()).select("id", "key", "node", "n")
    firsts = table.where(F.col("bits").isNotNull())
    nodes = firsts.groupBy("node").agg(F.min_by(F.struct("id", "key", "n", "bits"), F.struct("id", "key")).alias("s")).select("node", "s.*")
    clusters = components(candidate_links(tiles_of(table, percent, buckets), nodes, percent), "a", "b").withColumnRenamed("component", "cluster")
    wanted = write_once(clusters.join(nodes.select("node", "id", "key", "n"), "node"), "wanted")
    found = write_once(exact_components(rows, wanted, width, percent), "components")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    ids = documents.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(place).alias("p"))
    # only nodes with links meet by component; the others have their own least document
    linked = ids.join(found, "node")
    least = linked.groupBy("component").agg(F.min("p").alias("least"))
    of_node = linked.join(least, "component").select("node", "least")
    of_node = ids.join(of_node, "node", "left").select("node", F.coalesce("least", "p").alias("least"))
    out = documents.join(of_node, "node", "left")
    alone = F.col("node").isNull()
    stays = alone | (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("key") == F.col("least.key")))
    return out.select("id", "key", "n", F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("component_id"), stays.alias("stays"))


def keep_one(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all columns, whatever these are called, without the documents of each component but one; of rows
    that repeat id and text one stays.  Documents without words, null texts among them, all stay; an empty table
    stays empty."""
    prefix = free_prefix(docs)
    own, gone_id, gone_key = prefix + "key", prefix + "gone_id", prefix + "gone_key"
    marks = write_once(marked(docs, width, percent, id_col, text_col), "marks")
    gone = marks.where(~F.col("stays")).select("id", "key").distinct()
    again = marks.where(F.col("stays") & (F.col("n") > 0)).groupBy("id", "key").count().where(F.col("count") > 1).select("id", "key")
    rows = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))

    def joined(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        some = some.select(F.col("id").alias(gone_id), F.col("key").alias(gone_key))
        if some.count() <= BROADCAST_NODES:
            some = F.broadcast(some)
        return rows.join(some, (F.col(own) == F.col(gone_key)) & F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)), how)

    rows = joined(rows, gone, "left_anti")
    if not again.isEmpty():
        repeated = joined(rows, again, "left_semi").dropDuplicates([id_col, own])
        rows = joined(rows, again, "left_anti").unionByName(repeated)
    return rows.drop(own)
