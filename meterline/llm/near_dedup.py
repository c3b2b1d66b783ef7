"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds the fingerprints of its distinct shingles (runs of `shingle` words, A-Z lower-cased; a shorter
text is one shingle). Documents link when 100 * |intersection| >= percent * |union|; a component is the set of documents
that links reach.

1. One scan gives each document its set's size, a 128-bit fingerprint of the set, and COORDS minwise tokens. Documents with
   equal sets become one class, whose representative is the smallest id; only representatives go on.
2. TREES independent trees branch each representative on BRANCH minwise tokens at every node. A node's members agree on
   the path's tokens. Two documents of similarity 0.8 part in all trees at once with a probability below 1e-9 for any depth:
   a path survives a level with 1 - (1 - 0.8 p)^2, whose fixed point is p = 0.9375, and 0.0625^8 = 2e-10.
3. Nodes of at most NODE members are compared exhaustively on their minwise tokens; members that candidate links join are a
   group. A larger node compares all members with PIVOTS of them, gathers those within reach of a pivot as the pivot's ball, takes
   out those so close to one that all their partners are in its ball too (the triangle inequality of the Hamming distance of
   minwise tokens), and branches the rest again. A member that is so close to a pivot is in the balls of this and of earlier pivots only: of two
   partners, the one with the earlier pivot has the other in its ball. Work in a level is linear.
4. Groups, which hold at most NODE documents, are verified on full sets, a document reached meeting only those not yet
   reached. A group of over GROUP_TOKENS tokens is verified as pairs of its blocks.
5. A ball of at most BALL members and GROUP_TOKENS tokens is verified as a group. A larger one is cut into blocks, each of
   which is verified with the pivot; only members that don't reach the pivot there meet the other blocks. So a ball of
   copies, however large, costs one comparison a member, and no task holds one whole.
6. Links that full sets confirm are the edges of a graph, whose components are found by stars that shrink in rounds.

Null and empty texts have no set, and each is its own component. A document with a null doc_id links with nothing; its
component_id is null, and it is kept. Rows repeated with the same doc_id and text are one document, and each is returned. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, runs, ship
from .substring_dedup import packed

ship(__name__)

COORDS, TREES, BRANCH, PIVOTS = 64, 8, 2, 3
NODE, BALL, GROUP_TOKENS = 1024, 4096, 1 << 22
#: Of COORDS tokens, so many agree at least for a candidate link; two documents of similarity 0.8 miss this once in 1e8.
AGREE = 30
#: Of a pivot: within reach, and so close that all partners are within reach.
REACH, CLOSE = 21, 52
#: Documents to verify whose ids are broadcast, at most.
MOST_BROADCAST = 2_000_000
#: Rows (node, document) that are broadcast to the sketches, at most; more are joined with them by shuffle.
MOST_ROWS = 500_000
#: Tasks over which the neighbours of one vertex are dealt.
SALTS = 8


def _sets(words, shingle: int):
    """The distinct shingles of each document, sorted, and where each document's begin."""
    import numpy as np

    whole = np.flatnonzero(words.whole(shingle))
    doc, tokens = words.doc[whole], words.grams(shingle, K.BASES[1])[whole]
    short = np.flatnonzero((words.count > 0) & (words.count < shingle))
    if len(short):
        doc = np.concatenate((doc, short))
        tokens = np.concatenate((tokens, K.spans(words.hash, words.first[short], words.first[short + 1], K.BASES[1])))
    order = np.lexsort((tokens, doc))
    doc, tokens = doc[order], tokens[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tokens[1:] != tokens[:-1])
    doc, tokens = doc[new], tokens[new]
    return tokens, np.searchsorted(doc, np.arange(len(words.count) + 1))


def _signatures(shingle: int):
    def signatures(batches):
        import numpy as np
        import pyarrow as pa

        keys = K.mix(np.arange(1, 2 * COORDS + 1, dtype=K.U) * K.U(0x9E3779B97F4A7C15)).reshape(2, COORDS)
        for batch in batches:
            for part in K.slices(batch, "text"):
                tokens, first = _sets(K.Words(part.column("text"), fold=True), shingle)
                sizes = np.diff(first)
                full = np.flatnonzero(sizes)
                at = first[full]
                least = np.zeros((len(full), COORDS), np.uint32)
                prints = np.zeros((2, part.num_rows), K.U)
                if len(full):
                    for c in range(COORDS):
                        least[:, c] = np.minimum.reduceat((((tokens ^ keys[0, c]) * (keys[1, c] | K.U(1))) >> K.U(32)).astype(np.uint32), at)
                    prints[0, full] = np.add.reduceat(K.mix(tokens ^ K.U(0x5851F42D4C957F2D)), at)
                    prints[1, full] = np.add.reduceat(K.mix(tokens + K.U(0x14057B7EF767814F)), at)
                sketch = [None] * part.num_rows
                for i, d in enumerate(full.tolist()):
                    sketch[d] = least[i].tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), pa.array(sketch, pa.binary())], ["doc_id", "n", "print1", "print2", "sketch"])

    return signatures


def _sketches(column):
    import numpy as np

    return np.array([np.frombuffer(x, np.uint32) for x in column.to_pylist()], np.uint32).reshape(len(column), COORDS)


def _roots(batches):
    """Of each representative, its nodes in the first level of all trees."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        sketch = _sketches(batch.column("sketch")).astype(K.U)
        c = np.arange(TREES * BRANCH, dtype=K.U)
        nodes = K.mix(sketch[:, : TREES * BRANCH] + K.mix((c + K.U(1)) * K.U(0x9E3779B97F4A7C15)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), pa.array(np.repeat(batch.column("rep").to_numpy(), TREES * BRANCH))], ["node", "rep"])


def _components(adjacent):
    """The least member's number of each component of a small graph, given as a matrix."""
    import numpy as np

    n = len(adjacent)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            reached = np.zeros(n, bool)
            reached[i] = True
            front = reached
            while front.any():
                front = adjacent[front].any(axis=0) & ~reached
                reached = reached | front
            label[reached] = i
    return label


def _blocks(sizes):
    """Members in order, as blocks of at most half of GROUP_TOKENS tokens (or one member): each block's members."""
    import numpy as np

    block = np.cumsum(sizes) // max(1, GROUP_TOKENS // 2)
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(block)) + 1)


def _small_nodes(percent: int):
    """The groups inside the nodes of at most NODE members: a row for each member, under a print of the group, so that equal groups of several nodes are one."""

    def small_nodes(batches):
        import numpy as np
        import pyarrow as pa

        for table, bounds in runs(batches, "node"):
            rep, n, sketch = table.column("rep").to_numpy(), table.column("n").to_numpy(), _sketches(table.column("sketch"))
            groups, reps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(bounds, [*bounds[1:], len(rep)]):
                order = a + np.argsort(rep[a:b])
                r, s, k = rep[order], n[order], sketch[order]
                if b - a <= 48:
                    agree = (k[:, None, :] == k[None, :, :]).sum(axis=2)
                else:
                    agree = np.zeros((b - a, b - a), np.uint8)
                    for c in range(COORDS):
                        agree += k[:, c, None] == k[None, :, c]
                fits = 100 * np.minimum(s[:, None], s[None, :]) >= percent * np.maximum(s[:, None], s[None, :])
                label = _components((agree >= AGREE) & fits)
                for root in np.unique(label[label != np.arange(len(r))]):
                    members = np.flatnonzero(label == root)
                    blocks = [members[x] for x in _blocks(s[members])]
                    pairs = [(x, y) for i, x in enumerate(blocks) for y in blocks[i + 1 :]]
                    for one in [np.concatenate(x) for x in pairs] or [members]:
                        reps.append(r[one])
                        groups.append(np.full(len(one), K.mix(r[one].view(K.U)).sum().view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(groups)), pa.array(np.concatenate(reps))], ["grp", "rep"])

    return small_nodes


def _large_nodes(batches):
    """One level of the nodes with more than NODE members: rows of the pivots' balls (node null), and the next level's rows (ball null)."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        node, rep, n = (batch.column(c).to_numpy() for c in ("node", "rep", "n"))
        own, pivots = _sketches(batch.column("sketch")), batch.column("pivots")
        at = np.repeat(np.arange(len(rep)), np.diff(pivots.offsets.to_numpy()))
        pivot, agree = pivots.flatten().field("rep").to_numpy(), (own[at] == _sketches(pivots.flatten().field("sketch"))).sum(axis=1)
        close = (agree >= CLOSE) | (pivot == rep[at])
        nth = np.arange(len(at)) - np.repeat(pivots.offsets.to_numpy()[:-1] - pivots.offsets.to_numpy()[0], np.diff(pivots.offsets.to_numpy()))
        last = np.full(len(rep), PIVOTS)
        np.minimum.at(last, at[close], nth[close])
        ball = np.flatnonzero((agree >= REACH) & (nth <= last[at]))
        once = np.lexsort((rep[at[ball]], pivot[ball]))  # a document's nodes often have the same pivots
        ball = ball[once]
        ball = ball[np.append(True, (pivot[ball][1:] != pivot[ball][:-1]) | (rep[at[ball]][1:] != rep[at[ball]][:-1]))] if len(ball) else ball
        leave = last < PIVOTS
        stay = np.flatnonzero(~leave)
        key = node[stay].view(K.U)
        children = []
        for j in range(BRANCH):
            c = K.mix(key + K.U(j + 1)) % K.U(COORDS)
            children.append(K.mix(key * K.U(0xD6E8FEB86659FD93) + K.mix(c * K.U(1 << 32) + own[stay, c.astype(np.int64)])).view(np.int64))
        nodes, kept = np.concatenate(children), np.tile(stay, BRANCH)
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.nulls(len(ball), pa.int64()), pa.array(nodes)]), pa.concat_arrays([pa.array(pivot[ball]), pa.nulls(len(kept), pa.int64())]), pa.array(rep[np.concatenate((at[ball], kept))]), pa.array(n[np.concatenate((at[ball], kept))])],
            ["node", "ball", "rep", "n"],
        )


def _reach(sets, percent: int):
    """Of each set, the number of the first set that links reach. A set that is reached meets only those not yet reached, so copies cost one pass."""
    import numpy as np

    sizes = np.array([len(x) for x in sets])
    label = np.arange(len(sets))
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        if common and 100 * common >= percent * (sizes.sum() - common):
            label[1] = 0
        return label
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marked = np.zeros(int(token.max()) + 1 if len(token) else 0, bool)
    first = np.concatenate(([0], np.cumsum(sizes)))
    own = [token[first[i] : first[i + 1]] for i in range(len(sets))]
    rest = np.flatnonzero(sizes)
    flat = np.concatenate([own[i] for i in rest]) if len(rest) else token
    at = np.concatenate(([0], np.cumsum(sizes[rest])))[:-1]
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            label[rest[0]] = root = int(rest[0])
            leave = np.zeros(len(rest), bool)
            leave[0] = True
        else:
            leave = np.zeros(len(rest), bool)
        x = queue.pop()
        marked[own[x]] = True
        common = np.add.reduceat(marked[flat].astype(np.int64), at)
        marked[own[x]] = False
        linked = 100 * common >= percent * (sizes[x] + sizes[rest] - common)
        label[rest[linked]] = root
        queue += rest[linked & ~leave].tolist()
        leave |= linked
        if leave.any():
            rest = rest[~leave]
            flat = flat[np.repeat(~leave, np.diff(np.append(at, len(flat))))]
            at = np.concatenate(([0], np.cumsum(sizes[rest])))[:-1]
    return label


def _exact(shingle: int, percent: int):
    """Of each group of documents, its members with the least member that links reach: grp, rep, least."""

    def exact(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdDecompressor()

        def sets_of(packed) -> list:
            """The sets of compressed texts, which are unpacked a slice at a time."""
            out, texts, size = [], [], 0
            for i, one in enumerate(packed):
                texts.append(press.decompress(one.as_py()).decode())
                size += len(texts[-1])
                if size >= K.SLICE_BYTES or i + 1 == len(packed):
                    tokens, first = _sets(K.Words(pa.array(texts, pa.large_string()), fold=True), shingle)
                    out += [tokens[x:y].copy() for x, y in zip(first[:-1], first[1:])]
                    texts, size = [], 0
            return out

        for table, bounds in runs(batches, "grp"):
            rep, text = table.column("rep").to_numpy(), table.column("text")
            ends = [*bounds[1:], len(rep)]
            at = 0
            while at < len(bounds):  # whole groups, of about SLICE_BYTES at least
                to, size = at, 0
                while to < len(bounds) and (to == at or size < K.SLICE_BYTES):
                    size += 3 * sum(len(x.as_buffer()) for x in text[bounds[to] : ends[to]])
                    to += 1
                a, b = bounds[at], ends[to - 1]
                sets = sets_of(text[a:b])
                least = np.empty(b - a, np.int64)
                for x, y in zip(bounds[at:to], ends[at:to]):
                    order = np.arange(x, y)[np.argsort(rep[x:y])]
                    label = _reach([sets[i - a] for i in order], percent)
                    least[order - a] = rep[order][label]
                yield pa.RecordBatch.from_arrays([table.column("grp").slice(a, b - a).combine_chunks(), pa.array(rep[a:b]), pa.array(least)], ["grp", "rep", "least"])
                at = to

    return exact


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The components of a graph of links: each linked vertex with the least vertex that it reaches.

    In a round every vertex hangs on the least neighbour of its neighbour (which halves paths), then all neighbours of a vertex on
    the least one. Rounds end when all components are stars: then no link would change. Each round's links are written, so
    that a lost executor costs one round. The larger neighbours of one vertex are dealt over SALTS tasks.
    """
    links = cut(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "links")
    end = lambda x, below: F.struct(F.col(x).alias("v"), F.lit(below).alias("below"))
    while True:
        ends = links.select(F.explode(F.array(end("a", 0), end("b", 1))).alias("x")).select("x.*")
        if ends.groupBy("v").agg(F.sum("below").alias("below"), F.count(F.lit(1)).alias("n")).filter("below > 0 and n > 1").isEmpty():
            return links.select(F.col("b").alias("vertex"), F.col("a").alias("least"))
        parent = links.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))
        parent = parent.select("v", "p", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        dealt = links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        hung = dealt.join(parent, (F.col("a") == F.col("v")) & (dealt["salt"] == parent["salt"]), "left").select(F.coalesce("p", "a").alias("a"), "b")
        hung = hung.withColumn("m", F.min("a").over(Window.partitionBy("b")))
        pair = lambda x: F.struct(F.col("m").alias("a"), F.col(x).alias("b"))
        links = cut(hung.select(F.explode(F.array(pair("b"), pair("a"))).alias("x")).select("x.*").filter("a < b").distinct(), "links")


def _candidates(reps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Of all trees, level by level, the groups (grp, rep) and the balls (ball, rep, n; None if no node is large)."""
    small, balls, in_small = [], [], 0
    rows = reps.select("rep", "sketch").mapInArrow(_roots, "node long, rep long")
    pivot = [F.min(F.when(F.pmod(F.xxhash64("rep"), F.lit(PIVOTS)) == j, F.col("rep"))).alias(f"pivot{j}") for j in range(PIVOTS)]
    of_node = ["n_members", "members", *[f"pivot{j}" for j in range(PIVOTS)]]
    while True:
        nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n_members"), F.bit_xor(F.xxhash64("rep")).alias("members"), *pivot).filter("n_members > 1")
        nodes = cut(nodes.groupBy(*of_node).agg(F.min("node").alias("node")), "nodes")  # of nodes with the same members, one
        held = nodes.agg(*[F.coalesce(F.sum(F.when(F.col("n_members") > NODE, F.col("n_members") * x).otherwise(F.col("n_members") * (1 - x))), F.lit(0)) for x in (0, 1)]).first()  # rows in small and in large nodes
        ids = nodes.filter(F.col("n_members") <= NODE).select("node")
        small.append(rows.join(F.broadcast(ids) if held[0] <= MOST_ROWS else ids, "node").select("node", "rep"))
        in_small += held[0]
        if not held[1]:
            break
        level = _of_large(rows, nodes.filter(F.col("n_members") > NODE), of_node[2:], reps, held[1] <= MOST_ROWS)
        level = cut(level.mapInArrow(_large_nodes, "node long, ball long, rep long, n long"), "level")
        balls.append(level.filter("ball is not null").select("ball", "rep", "n"))
        rows = level.filter("ball is null").select("node", "rep")
    members = reduce(DataFrame.unionByName, small)
    members = reps.join(F.broadcast(members) if in_small <= MOST_ROWS else members, "rep").select("node", "rep", "n", "sketch")
    groups = members.repartition("node").sortWithinPartitions("node").mapInArrow(_small_nodes(percent), "grp long, rep long")
    return groups, reduce(DataFrame.unionByName, balls).distinct() if balls else None


def _of_large(rows: DataFrame, large: DataFrame, pivots: list[str], reps: DataFrame, few: bool) -> DataFrame:
    """The rows of large nodes with sketch and pivots, at most PIVOTS a node. If they are few, they go to the sketches, which then are not shuffled."""
    asked = large.select("node", F.explode(F.array(*pivots)).alias("rep")).filter("rep is not null")
    found = reps.select("rep", "sketch").join(F.broadcast(asked) if few else asked, "rep")
    found = found.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rep", "sketch"))).alias("pivots"))
    if few:
        rows = rows.join(F.broadcast(large.select("node")), "node", "left_semi")
        out = reps.select("rep", "n", "sketch").join(F.broadcast(rows), "rep").join(F.broadcast(found), "node")
    else:
        out = rows.join(cut(found, "pivots"), "node").join(reps.select("rep", "n", "sketch").hint("merge"), "rep")
    return out.select("node", "rep", "n", "sketch", "pivots")


def _links(groups: DataFrame, balls: DataFrame | None, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The confirmed links, as stars: rep and least."""

    groups = cut(groups.distinct(), "groups")
    asked = groups.select("rep")
    if balls is not None:
        balls = cut(balls, "balls")
        asked = asked.unionByName(balls.select("rep"))
    few = asked.count() <= MOST_BROADCAST  # counted, not guessed: then texts without a partner are not shuffled
    asked = asked.distinct()
    if not few:  # with repeats; without them?
        asked = cut(asked, "asked")
        few = asked.count() <= MOST_BROADCAST
    texts = texts.withColumnRenamed("doc_id", "rep").filter("rep is not null")
    texts = cut(packed(texts.join(F.broadcast(asked), "rep", "left_semi")) if few else packed(texts).join(asked, "rep", "left_semi"), "asked-texts")  # packed once for all that is verified

    def verified(rows: DataFrame) -> DataFrame:
        held = rows.join(texts, "rep").select("grp", "rep", "text")
        return held.repartition("grp").sortWithinPartitions("grp").mapInArrow(_exact(shingle, percent), "grp long, rep long, least long")

    apart = F.col("rep") != F.col("least")
    if balls is None:
        return verified(groups).filter(apart).select("rep", "least")
    blocks = F.greatest(F.ceil(2 * F.col("members") / BALL), F.ceil(2 * F.col("tokens") / GROUP_TOKENS)).cast("int")
    sizes = balls.groupBy("ball").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"))
    sizes = cut(sizes.withColumn("blocks", blocks).filter("blocks > 2").select("ball", "blocks"), "large-balls")
    cut_up = not sizes.isEmpty()
    whole = balls.join(sizes, "ball", "left_anti") if cut_up else balls
    links = verified(groups.unionByName(whole.select(F.xxhash64("ball").alias("grp"), "rep"))).filter(apart).select("rep", "least")
    if not cut_up:
        return links
    large = balls.join(sizes, "ball").select("ball", "blocks", "rep", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pivots = large.select("ball", "blocks").distinct().select("ball", F.col("ball").alias("rep"), every.alias("own"))
    units = large.select("ball", "rep", "own").unionByName(pivots).distinct().withColumn("grp", F.xxhash64("ball", "own"))
    first = cut(verified(units.select("grp", "rep")), "ball-blocks")
    reached = units.filter("rep = ball").join(first.withColumnRenamed("least", "pivot_least"), ["grp", "rep"]).select("grp", "ball", "pivot_least")
    rest = first.join(reached, "grp").filter(F.col("least") != F.col("pivot_least")).select("ball", "rep").distinct()  # those that don't reach the pivot in their block
    rest = cut(rest, "ball-rest")
    parts = rest.groupBy("ball").agg(F.ceil(2 * F.count(F.lit(1)) / BALL).cast("int").alias("parts"))
    one = rest.join(parts, "ball").join(sizes, "ball").select("ball", "rep", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("parts")).cast("int").alias("part"), every.alias("own"))
    other = large.join(parts, "ball").select("ball", "rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "own")
    meet = one.unionByName(other).select(F.xxhash64("ball", "part", "own", F.lit(1)).alias("grp"), "rep").distinct()
    return links.unionByName(first.filter(apart).select("rep", "least")).unionByName(verified(meet).filter(apart).select("rep", "least"))


def components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Each document with the size of its set and the smallest doc_id that links reach: doc_id, n_shingles, component_id."""
    if not 80 <= percent <= 100:
        raise ValueError("the trees' recall is worked out for a similarity of 0.8 or more")
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(texts.mapInArrow(_signatures(shingle), "doc_id long, n long, print1 long, print2 long, sketch binary"), "signatures")
    prints = ["n", "print1", "print2"]
    reps = cut(signed.filter("n > 0 and doc_id is not null").groupBy(*prints).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "representatives")  # equal sets have equal sketches
    groups, balls = _candidates(reps, percent)
    links = _links(groups, balls, texts, shingle, percent)
    least = connected(links, "rep", "least").withColumnRenamed("vertex", "rep")
    classes = cut(reps.select("rep", *prints).join(least, "rep", "left").select(*prints, F.coalesce("least", "rep").alias("least")), "classes")  # written, so that a hot class can be split in the join
    out = signed.select("doc_id", *prints).join(classes, prints, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Shingles of four words over all documents; one document of each component is kept."""
    out = components(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS r(i) WHERE len(ws) > 0),
d AS (SELECT DISTINCT doc_id, s FROM t),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM d x JOIN d y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT c.doc_id, l.b FROM c JOIN l ON c.r = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(c.r) AS component_id, w.doc_id = min(c.r) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.doc_id = w.doc_id GROUP BY w.doc_id, n.n
"""
