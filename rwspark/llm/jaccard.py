"""Jaccard joins of word n-gram sets by PartEnum signatures.

Two sets are linked when ``percent`` of their union is shared. Sets are put in overlapping bands of sizes, so that any
linked pair has a band in common. In a band with largest size r, a linked pair differs in k elements at most. The domain of
hashed shingles is cut into n1 partitions of n2 parts each; partitions with more than k2 differences are few enough that
some are left, and in such a partition the signatures over all subsets of n2 - k2 parts have one in common. A signature is a
hash of the elements in a subset.

Signatures of few elements say little. There are m + 1 good partitions at least. A set leaves out its weakest signatures,
those under q elements, with the largest q for which at most m partitions have a weaker subset: of the good partitions
one is at least as strong as the larger q of both sets, so its common signature is given by both, and no link is lost.

Equal sets are one node, numbered by a hash; two sets of one number (seen by a second hash) make all begin again with another
seed. Each node is first compared with the one it shares most signatures with among the least ones of its signatures, which
links most near copies. Of signatures whose rows are still in different components, each is compared with the one that has
most links (the original of copies), then those nearest to each other that would join their components (in the largest
signature of each, then in all), and last all that are still apart. Before sets are compared as a whole, sketches rule pairs out: a bit for each class of elements says whether
the set has an odd number of them, and two sets differ in as many elements as their sketches do in bits at least, so no
link is ruled out. A sketch has two rows of such bits, for two ways to class, and the one that differs more counts. Rows of a signature with very many of them are dealt to tasks in blocks. There is no cap on rows,
partners or candidates.

Nulls and empty texts have no shingles and are linked with nothing; so are rows without an id, whose component is null. A
text with fewer words than a shingle is one shingle, and texts of any length are read as a whole. Repeated rows are copies.
Rows that share an id are one document, except those without words. An empty table gives no rows. Only the two columns named
are read: others, of any name, are left alone.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import dealt_join, discard, hot_keys, per_batch, utf8, written
from .components import components

STEP = 1.3


@cache
def layout(k: int) -> tuple[int, int, int, int]:
    """n1, n2, k2 and the margin m for up to k differences: m partitions more than the pigeonhole needs.

    Small sets can pay for strong signatures: nearly all subsets of one partition. Large ones have single parts as subsets.
    """
    if k <= 3:
        return 1, k + 3, k, 0
    if k <= 36:
        base = (k + 2) // 2
        m = -(-35 * base // 100)
        return base + m, 4, 1, m
    m = -(-35 * (k + 1) // 100)
    return k + 1 + m, 1, 0, m


@cache
def bands(percent: int, largest: int) -> list[tuple[int, int, int]]:
    """(lowest, largest size, k) of the bands up to those that hold sizes of ``largest``. Smaller sets link with equal ones only."""
    found, low = [], -(-percent // (100 - percent))  # the least size n that can link with n + 1; k >= 1 as the band holds n + 1
    while low <= largest:
        after = int(low * STEP) + 1
        high = (after - 1) * 100 // percent
        found.append((low, high, 2 * (100 - percent) * high // (100 + percent)))
        low = after
    return found


def hashed_words():
    """A map of words to 64-bit hashes that keeps those it has seen, up to a bound."""
    import xxhash

    class Seen(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) > 200_000:
                self.clear()
            self[word] = x = xxhash.xxh3_64_intdigest(word)
            return x

    return Seen()


def shingles(text: bytes, size: int, seen: dict):
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; a shorter text is one."""
    import numpy as np

    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n, h = len(w) - size + 1, np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    return np.unique(_mixed(h))


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@cache
def _plan(k: int):
    """Borders of the parts in the domain, subsets as a 0/1 matrix, the ids of the signatures."""
    import numpy as np

    n1, n2, k2, m = layout(k)
    parts = n1 * n2
    borders = np.array([min(-(-(i << 64) // parts), 2**64 - 1) for i in range(parts)], np.uint64)
    chosen = np.zeros((n2, 0 if n2 < k2 else len(list(combinations(range(n2), n2 - k2)))), np.uint64)
    for j, some in enumerate(combinations(range(n2), n2 - k2)):
        chosen[list(some), j] = 1
    ids = _mixed(np.arange(n1 * chosen.shape[1], dtype=np.uint64) + np.uint64(k * 1_000_003 + 1)).reshape(n1, -1)
    return n1, n2, m, borders, chosen, ids


def signatures(s, percent: int):
    """Signatures of a sorted array of hashes."""
    import numpy as np

    n, found = len(s), []
    mass = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(s + np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    for low, high, k in bands(percent, 1 << (n.bit_length() + 1)):
        if low <= n <= high:
            n1, n2, m, borders, chosen, ids = _plan(k)
            at = np.append(np.searchsorted(s, borders), n)
            sums = (mass[at[1:]] - mass[at[:-1]]).reshape(n1, n2) @ chosen
            counts = np.diff(at).astype(np.uint64).reshape(n1, n2) @ chosen
            q = np.partition(counts.min(axis=1), m)[m]
            found.append(_mixed(sums ^ ids)[counts >= q])
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def sketch(s) -> bytes:
    """Two rows of parities: of each of 2^j classes of elements (more than elements, 512 at least) whether the set has an odd number."""
    import numpy as np

    bits, h = max(512, 1 << len(s).bit_length()), _mixed(s + np.uint64(0x2545F4914F6CDD1D))
    rows = (np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) for x in (h, h >> np.uint64(32)))
    return b"".join(np.packbits(x.astype(np.uint8) & 1).tobytes() for x in rows)


def folded(sketches: list[bytes]):
    """Sketches as arrays of 64-bit words, of shape (sets, 2, words); those with more classes folded to the fewest: parities of joined classes."""
    import numpy as np

    width = min(map(len, sketches))
    if width == max(map(len, sketches)):
        return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), 2, -1)
    out = np.empty((len(sketches), 2, width // 16), np.uint64)
    for row, x in zip(out, sketches):
        v = np.frombuffer(x, np.uint64).reshape(2, -1)
        while v.shape[1] > row.shape[1]:
            v = v[:, : v.shape[1] // 2] ^ v[:, v.shape[1] // 2 :]
        row[:] = v
    return out


def differing(x, y):
    """By the sketches, in how many elements sets differ at least."""
    import numpy as np

    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64).max(axis=-1)


def near(apart, sizes, percent: int):
    """Whether sets that differ in ``apart`` elements at least, with ``sizes`` elements in both together, may be linked."""
    return apart * (100 + percent) <= (100 - percent) * sizes


def _number(s, seed: int) -> tuple[int, int]:
    """A set's node and a second hash."""
    import xxhash

    digest = xxhash.xxh3_128_digest(s.tobytes(), seed)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def features(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """id, n (set size), node and check (hashes of the set; null without id or words) and sketch of rows (id, text)."""

    def make(batch: pa.RecordBatch, seen: dict) -> list:
        n, node, check, marks = [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = shingles(text, size, seen)
            n.append(len(s))
            a, b = _number(s, seed) if len(s) and doc_id is not None else (None, None)
            node.append(a)
            check.append(b)
            marks.append(None if a is None else sketch(s))
        return [batch.column(0), n, node, check, marks]

    return per_batch(docs, "id long, n long, node long, check long, sketch binary", make, hashed_words)


def signed(docs: DataFrame, size: int, percent: int, seed: int) -> DataFrame:
    """sig and node, a row for each signature of rows (id, text); a task gives those of equal sets once."""

    def make(batch: pa.RecordBatch, state: tuple) -> list:
        import numpy as np

        seen, given = state
        sigs, nodes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = shingles(text, size, seen)
            if doc_id is None or not len(s) or (node := _number(s, seed)[0]) in given:
                continue
            if len(given) > 100_000:
                given.clear()
            given.add(node)
            sigs.append(signatures(s, percent))
            nodes.append(np.full(len(sigs[-1]), node, np.int64))
        return [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes))]

    return per_batch(docs, "sig long, node long", make, lambda: (hashed_words(), set()))


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) that sizes and sketches don't rule out."""
    own = lambda key, x: sets.select(F.col("node").alias(key), F.struct("n", "sketch").alias(x))
    both = dealt_join(pairs.join(own("a", "s"), "a"), own("b", "t"), "b", "a", hot_keys(pairs, "b")[0])

    def make(batch: pa.RecordBatch) -> list:
        import numpy as np

        n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
        apart = [int(differing(*folded([x, y]))) for x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())]
        return [batch.column(0), batch.column(1), near(np.maximum(apart, np.abs(n - m)), n + m, percent)]

    rows = both.select("a", "b", F.col("s.n").alias("n"), F.col("s.sketch").alias("s"), F.col("t.n").alias("m"), F.col("t.sketch").alias("t"))
    return per_batch(rows, "a long, b long, may boolean", make).filter("may").select("a", "b")


def runs(batches, keys: int):
    """Tables of the rows that share the first ``keys`` columns, of batches in which these stand side by side."""
    import numpy as np

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        new = np.zeros(table.num_rows, bool)
        for k in range(keys):
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        edges = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(edges, edges[1:]):
            yield table.slice(a, b - a)
        held = table.slice(edges[-1])
    if held is not None:
        yield held


def spanning(pairs: list[tuple], component: dict) -> set:
    """Of (weight, a, b), by weight, those that join components that the ones before have not joined."""
    root: dict = {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    kept = set()
    for _, a, b in sorted(pairs):
        x, y = find(component[a]), find(component[b])
        if x != y:
            root[x] = y
            kept.add((min(a, b), max(a, b)))
    return kept


def neighbours(rows: DataFrame, percent: int, each: int | None, block: int = 512) -> DataFrame:
    """Pairs (a, b) of nodes of one signature and different components that sizes and sketches don't rule out.

    A signature with over ``each`` such pairs for each of its rows gives only as many as join the components, the nearest
    first; a row without a says that it is not done. With None, every signature gives all.

    rows: sig, node, component, major (it is the signature's largest component), majors and minors (how many rows are in it
    and outside), n, sketch. The rows of a signature come one after another, by size; those outside the largest component are
    held against all others that are not too large or small. Only pairs that may be linked leave the task. A signature of over
    ``block`` rows is cut into blocks by hash, and every two blocks that have work to do are a task's.
    """

    def pairs(group: pa.Table) -> list[tuple]:
        import numpy as np

        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        node, component, major, part, n = (group.column(c).to_numpy() for c in ("node", "component", "major", "part", "n"))
        marks, large, found = folded(group.column("sketch").to_pylist()), int(group.column("blocks")[0].as_py()) > 1, []
        for i in np.flatnonzero(~major.astype(bool)).tolist():
            lo, hi = int(np.searchsorted(n, -(-n[i] * percent // 100), "left")), int(np.searchsorted(n, n[i] * 100 // percent, "right"))
            at = np.arange(lo, hi)
            other, own = component[lo:hi] != component[i], major[lo:hi].astype(bool)
            if not large:
                other &= own | (at > i)
            elif x >= 0:
                other &= own
            else:
                other &= (at > i) if -1 - x == y else (at > i) & (part[lo:hi] != part[i])
            at = at[other]
            if len(at):
                apart = np.maximum(differing(marks[at], marks[i]), np.abs(n[at] - n[i]))
                may = near(apart, n[at] + n[i], percent)
                found += [(w, int(node[i]), b) for w, b in zip((apart[may] / (n[at][may] + n[i])).tolist(), node[at[may]].tolist())]
        if each is not None and len(found) > each * len(n):
            return spanning(found, dict(zip(node.tolist(), component.tolist()))) | {(None, x)}
        return {(min(a, b), max(a, b)) for _, a, b in found}

    def run(batches):
        known: set = set()  # pairs often share many signatures
        for group in runs(batches, 3):
            found = pairs(group) - known
            if found:
                known = known if len(known) < 100_000 else set()
                known |= found
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    count = lambda c: F.greatest(F.ceil(F.col(c) / F.lit(block)), F.lit(1)).cast("int")
    rows = rows.withColumn("blocks", F.ceil((F.col("majors") + F.col("minors")) / F.lit(block)).cast("int")).withColumn("ys", count("minors")).withColumn("xs", count("majors"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("major"), F.col("xs")).otherwise(F.col("ys"))).cast("int"))
    upto = lambda c, cell: F.transform(F.sequence(F.lit(0), F.col(c) - 1), cell)
    place = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    part = F.col("part")
    with_major, with_minor = upto("xs", lambda k: place(k, part)), upto("ys", lambda k: place(-1 - F.least(k, part), F.greatest(k, part)))
    cells = F.when(F.col("blocks") <= 1, F.array(place(F.lit(0), F.lit(0)))).when(F.col("major"), upto("ys", lambda k: place(part, k))).otherwise(F.concat(with_major, with_minor))
    rows = rows.withColumn("cell", F.explode(cells)).select("sig", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"), "node", "component", F.col("major").cast("int").alias("major"), "part", "blocks", "n", "sketch")
    return rows.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y", "n").mapInArrow(run, "a long, b long").distinct()


def still_split(shared: DataFrame, groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Written: the rows (sig, node) of signatures whose rows are in different components, with component, major, majors, minors, hub (the row with most links) and apart (it is in another component)."""
    w = Window.partitionBy("sig")
    links = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    named = shared.select("sig", "node").join(groups.join(links, "node", "left"), "node", "left")
    named = named.select("sig", "node", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    named = named.withColumn("own", F.count("*").over(Window.partitionBy("sig", "component"))).withColumn("of", F.count("*").over(w)).filter("own < of")
    named = named.withColumn("top", F.max(F.struct("own", "component")).over(w)).withColumn("hub", F.max(F.struct("links", "node", "component")).over(w))
    return written(
        named.select(
            "sig", "node", "component", (F.col("component") == F.col("top.component")).alias("major"), F.col("top.own").alias("majors"), (F.col("of") - F.col("top.own")).alias("minors"),
            F.col("hub.node").alias("hub"), (F.col("component") != F.col("hub.component")).alias("apart"),
        ),
        "split",
    )


def towards_hubs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) turned so that b is the node with more partners."""
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    own = lambda key, name: degrees.select(F.col("node").alias(key), F.struct("d", "node").alias(name))
    both = dealt_join(dealt_join(pairs, own("a", "x"), "a", "b", hot_keys(pairs, "a")[0]), own("b", "y"), "b", "a", hot_keys(pairs, "b")[0])
    return both.select(F.least("x", "y")["node"].alias("a"), F.greatest("x", "y")["node"].alias("b"))


def linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, size: int, percent: int, seed: int, most: int = 500_000) -> DataFrame:
    """Of ``pairs`` (a, b), a written table, those whose sets are linked, as a written table.

    Each b, a hub, is compared with its a's: the sets are made again from the texts, and each is sent once for every b. The
    a's of a b with many of them are dealt over tasks, each of which gets the set of b once.
    """
    hot = F.broadcast(hot_keys(pairs, "b")[0])
    dealt = pairs.join(hot, "b", "left")
    starts = dealt.select(F.col("a").alias("node"), F.col("b").alias("key"), F.coalesce(F.pmod(F.xxhash64("a"), F.col("_salts")).cast("int"), F.lit(0)).alias("part"), F.lit(1).alias("member"))
    ends = dealt.select("b", "_salts").distinct().select(F.col("b").alias("node"), F.col("b").alias("key"), F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("part"), F.lit(0).alias("member"))
    places = starts.unionByName(ends).groupBy("node").agg(F.collect_list(F.struct("key", "part", "member")).alias("places"))
    wanted = written(places.join(sets.select("node", F.col("first").alias("id")), "node"), "wanted")
    few = wanted.agg((F.count("*") <= most) & (F.coalesce(F.sum(F.size("places")), F.lit(0)) <= 2 * most)).first()[0]
    texts = docs.join(F.broadcast(wanted) if few else wanted, "id")

    def make(batch: pa.RecordBatch, seen: dict) -> list:
        out: tuple[list, ...] = ([], [], [], [], [])
        for text, node, at in zip(*(c.to_pylist() for c in batch.columns)):
            s = shingles(text, size, seen)
            if len(s) and _number(s, seed)[0] == node:  # rows that share an id may differ
                data = s.tobytes()
                for x in at:
                    for column, value in zip(out, (x["key"], x["part"], x["member"], node, data)):
                        column.append(value)
        return list(out)

    rows = per_batch(texts.select("text", "node", "places"), "key long, part int, member int, node long, s binary", make, hashed_words)
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "member")

    def run(batches):
        import numpy as np

        key, other = None, None
        for batch in batches:
            a, b = [], []
            for k, part, member, node, s in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4)):
                own = np.frombuffer(s.as_buffer(), np.uint64)
                if not member:
                    key, other = (k, part), own.copy()
                elif (k, part) == key:
                    shared = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * shared >= percent * (len(own) + len(other) - shared):
                        a.append(node)
                        b.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = written(rows.mapInArrow(run, "a long, b long").distinct(), "edges")
    discard(wanted)
    return found


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, size: int, percent: int, seed: int) -> DataFrame:
    """As ``linked``, of pairs that sketches have not yet judged."""
    likely = written(possible(pairs, sets, percent), "pairs")
    found = linked(likely, docs, sets, size, percent, seed)
    discard(likely)
    return found


def numbered(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame, int]:
    """Written features, written sets (node, n, sketch, first: the least id, rows), and the seed by which no two sets share a node."""
    for seed in range(100):
        found = written(features(docs, size, seed), "features")
        least = lambda c: F.min(c).alias(c)
        sets = found.filter("node IS NOT NULL").groupBy("node").agg(least("n"), F.first("sketch").alias("sketch"), F.min("id").alias("first"), F.count("*").alias("rows"), least("check"), F.max("check").alias("other"))
        sets = written(sets, "sets")
        if sets.filter("check <> other").isEmpty():
            return found, sets, seed
        discard(found, sets)
    raise RuntimeError("no seed tells all sets apart")


def classes(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles and component_id of each row."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    found, sets, seed = numbered(docs, size)

    w = Window.partitionBy("sig")
    shared = signed(docs, size, percent, seed).withColumn("pivot", F.min("node").over(w)).withColumn("last", F.max("node").over(w))
    shared = written(shared.filter("pivot <> last").select("sig", "node", "pivot").distinct(), "shared")

    # First each node with the pivot it shares most signatures with.
    votes = shared.filter("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("votes"))
    first = votes.groupBy("node").agg(F.max_by("pivot", F.struct("votes", -F.col("pivot"))).alias("b")).select(F.col("node").alias("a"), "b")
    twice = found.filter("node IS NOT NULL").groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("c")).filter("b <> c").select("id", "b")
    edges = written(found.join(twice, "id").filter("node <> b").select(F.col("node").alias("a"), "b").distinct(), "edges")  # rows that share an id
    tested = written(first, "pairs")
    edges = edges.unionByName(verified(tested, docs, sets, size, percent, seed))
    groups = components(edges)

    # Then, of signatures that are still split, each row with that of most links; rows that join components in the largest
    # signatures; all pairs but of signatures with very many, of which as many as join components; all pairs, of what is left.
    ordered = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for step in ("hubs", "largest", "each", "all"):
        split = still_split(shared, groups, edges)
        discard(shared)
        shared, done = split, True
        if step == "hubs":
            rest = split.filter("apart").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
            more = verified(rest := written(rest, "pairs"), docs, sets, size, percent, seed)
        else:
            rows = split.drop("hub", "apart")
            if step == "largest":  # a row for each node: of its signatures, that with most rows
                best = rows.groupBy("node").agg(F.max(F.struct(F.col("majors") + F.col("minors"), "sig"))["sig"].alias("sig"))
                rows = rows.join(best, ["node", "sig"], "left_semi")
            nearest = written(neighbours(rows.join(sets.select("node", "n", "sketch"), "node"), percent, {"largest": 0, "each": 4, "all": None}[step]), "pairs")
            done = step == "all" or step == "each" and nearest.filter("a IS NULL").isEmpty()
            fresh = written(nearest.filter("a IS NOT NULL").join(ordered(tested).distinct(), ["a", "b"], "left_anti"), "pairs")
            more = linked(rest := written(towards_hubs(fresh), "pairs"), docs, sets, size, percent, seed)
            discard(nearest, fresh)
        tested = tested.unionByName(rest)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            groups = components(groups.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        if step == "each" and done:
            break

    # The least id of each component, and each row its set's.
    ends = sets.select("node", "first").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = ends.groupBy("component").agg(F.min("first").alias("component_id"))
    ends = written(dealt_join(ends, least_id, "component", "node", hot_keys(ends, "component")[0]).select("node", "component_id"), "ends")
    rows = found.select("id", "n", "node")
    result = dealt_join(rows.filter("node IS NOT NULL"), ends, "node", "id", hot_keys(rows.filter("node IS NOT NULL"), "node")[0]).select("id", "n", "component_id")
    result = result.unionByName(rows.filter("node IS NULL").select("id", "n", F.col("id").alias("component_id")))
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
