"""Copies of images, cropped or edited, by local descriptors.

1. Each distinct image gets up to KEYPOINTS corners (Harris response, its maxima in 3 by 3 neighbourhoods) at each of SCALES. A corner's
   orientation is that of its patch's intensity centroid; BITS binary tests between points of the patch, turned by the orientation,
   are its descriptor. Tests compare brightness only, so gain and offset don't change them.
2. Hamming-table join: a descriptor is cut into TABLES chunks, and descriptors with an equal chunk meet in the join on (table, chunk).
   They match if at most FAR bits differ; in the broadcast join two corners meet in their first equal chunk only. The queries' tables are broadcast if a count finds them small; else keys alone are shuffled, and
   descriptors follow for the corners that met. Descriptors that differ in fewer than TABLES bits always meet; others meet with a probability that
   falls with the distance, and an image needs only some of its corners to meet. The README gives the recall by kind of edit.
3. Geometric consensus: a pair of images that shares MOST_VOTES or more distinct corners goes on. Its matched corners vote for turn, scale and
   shift of the image. An image is a copy if MOST_VOTES or more distinct corners agree on one cell of this space (or on half the query's
   corners, if it has few). Cells overlap by half, so that no edge parts votes.

Images with equal pixels are one image in all of this, on either side, so a hot image costs one row; results name the class
representative (smallest id) and the class size. A descriptor with fewer than LEAST_ONES ones or zeros describes a flat patch and is
not made, so flat areas make no hot keys.

Nulls: rows with null id, pixels or size, or whose pixels don't fill the size, have no corners and match nothing. Repeated rows are
one image. Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

ship(__name__)

SCALES, KEYPOINTS, BITS, TABLES, RADIUS, FAR = (1.0, 0.84, 0.71, 0.6, 0.5), 24, 256, 8, 14, 32
#: Rows of the queries' tables (about 80 bytes each) up to which they are broadcast.
MOST_BROADCAST = 1_000_000
TURNS, MOST_VOTES, LEAST_ONES, SHIFT = 32, 5, 24, 6


def _tests():
    """Places of the binary tests, for each of TURNS orientations: an integer array (TURNS, BITS, 4)."""
    import numpy as np

    if not _TESTS:
        points = np.clip(np.random.default_rng(7).normal(0, RADIUS / 2.2, (BITS, 4)), -RADIUS * 0.7, RADIUS * 0.7)
        angle = 2 * np.pi * np.arange(TURNS) / TURNS
        c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
        x1, y1, x2, y2 = points.T
        _TESTS.append(np.rint(np.stack((c * x1 - s * y1, s * x1 + c * y1, c * x2 - s * y2, s * x2 + c * y2), axis=2)).astype(int))
    return _TESTS[0]


_TESTS: list = []


def _blur(image):
    import numpy as np

    for axis in (0, 1):
        wide = np.pad(image, [(1, 1) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        n = image.shape[axis]
        image = (np.take(wide, range(n), axis) + 2 * image + np.take(wide, range(2, n + 2), axis)) / 4
    return image


def _resized(image, scale: float):
    import numpy as np

    if scale == 1:
        return image
    h, w = (max(1, int(x * scale)) for x in image.shape)
    return _blur(image)[np.minimum((np.arange(h) / scale).astype(int), image.shape[0] - 1)][:, np.minimum((np.arange(w) / scale).astype(int), image.shape[1] - 1)]


def describe(image):
    """The corners of a grey image: x, y (from its middle, in the image's own pixels), scale, turn (0 to TURNS), and the descriptor's bits, each an array."""
    import numpy as np

    grid, out = np.arange(-RADIUS, RADIUS + 1), []
    for scale in SCALES:
        smooth = _blur(_blur(_resized(image.astype(np.float32), scale)))
        if min(smooth.shape) < 8:
            continue
        gy, gx = np.gradient(smooth)
        a, b, c = _blur(gx * gx), _blur(gx * gy), _blur(gy * gy)
        a, b, c = _blur(a), _blur(b), _blur(c)
        response = a * c - b * b - 0.05 * (a + c) ** 2
        edge = np.pad(response, 1, constant_values=-np.inf)
        best = np.max([edge[1 + i : 1 + i + response.shape[0], 1 + j : 1 + j + response.shape[1]] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        ys, xs = np.nonzero((response == best) & (response > max(1e-3, 0.001 * float(response.max()))))
        order = np.argsort(-response[ys, xs], kind="stable")[:KEYPOINTS]
        ys, xs = ys[order], xs[order]
        wide = np.pad(smooth, RADIUS, mode="edge")
        patch = wide[ys[:, None, None] + (grid + RADIUS)[:, None], xs[:, None, None] + grid + RADIUS]
        middle = patch - patch.mean(axis=(1, 2), keepdims=True)
        angle = np.arctan2((middle * grid[:, None]).sum(axis=(1, 2)), (middle * grid).sum(axis=(1, 2)))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        x1, y1, x2, y2 = np.moveaxis(_tests()[turn] + RADIUS, 2, 0)
        one = np.arange(len(ys))[:, None]
        bits = patch[one, y1, x1] < patch[one, y2, x2]
        good = np.flatnonzero((bits.sum(axis=1) >= LEAST_ONES) & (bits.sum(axis=1) <= BITS - LEAST_ONES))
        out.append((xs[good] / scale - image.shape[1] / 2, ys[good] / scale - image.shape[0] / 2, np.full(len(good), scale), turn[good], np.packbits(bits[good], axis=1)))
    none = [np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0, int), np.zeros((0, BITS // 8), np.uint8)]
    return [np.concatenate(x) for x in zip(none, *out)]


def _describe(batches):
    """Of each image its corners: image, x, y, scale, turn, and the descriptor as four numbers."""
    import numpy as np
    import pyarrow as pa

    names = ["image", "corner", "x", "y", "scale", "turn", "d0", "d1", "d2", "d3"]
    kinds = [pa.int64(), pa.int32(), pa.float32(), pa.float32(), pa.float32(), pa.int32(), *[pa.int64()] * 4]
    for batch in batches:
        images, found = [], []
        for image, width, height, pixels in zip(*(batch.column(c).to_pylist() for c in ("image", "width", "height", "pixels"))):
            if pixels and width and height and width > 0 and len(pixels) == width * height:
                images.append(image)
                found.append(describe(np.frombuffer(pixels, np.uint8).reshape(height, width)))
        if not images:
            continue
        sizes = [len(x[0]) for x in found]
        x, y, scale, turn, bits = (np.concatenate(x) for x in zip(*found))
        corner = np.concatenate([np.arange(n) for n in sizes])
        parts = np.ascontiguousarray(bits).view(np.int64).reshape(len(x), 4)
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((np.repeat(np.array(images, np.int64), sizes), corner, x, y, scale, turn, *parts.T.copy()), kinds)], names)


def _classes(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images with equal pixels as one: (image, width, height, pixels) of each class, and (id, image) of each member."""
    keyed = images.select("id", "width", "height", "pixels").filter("id is not null and pixels is not null").withColumn("print", F.sha2(F.concat(F.col("pixels"), F.encode(F.concat_ws("x", "width", "height"), "UTF-8")), 256))
    members = keyed.groupBy("print").agg(F.min("id").alias("image"))
    ids = keyed.select("id", "print").distinct().join(members, "print").select("id", "image")
    return keyed.join(members, "print").filter("id = image").dropDuplicates(["image"]).select("image", "width", "height", "pixels"), ids


def _first_table():
    """The first table in which the descriptors d and q_d of a joined row have an equal chunk: two corners count there only, not once a table."""
    found = F.lit(None).cast("long")
    for i in reversed(range(TABLES)):
        differ = F.col(f"d{i // 2}").bitwiseXOR(F.col(f"q_d{i // 2}"))
        found = F.when((F.shiftrightunsigned(differ, 32) if i % 2 else differ.bitwiseAND(F.lit((1 << 32) - 1))) == 0, F.lit(i).cast("long")).otherwise(found)
    return found


def _keys(corners: DataFrame) -> DataFrame:
    """A row for each table: its number and chunk as one key."""
    chunk = lambda i: F.shiftrightunsigned(F.col(f"d{i // 2}"), 32) if i % 2 else F.col(f"d{i // 2}").bitwiseAND(F.lit((1 << 32) - 1))
    return corners.withColumn("key", F.explode(F.array(*[F.lit(i << 32).bitwiseOR(chunk(i)) for i in range(TABLES)])))


def _votes(batches):
    """Of each pair of images the most distinct corners of the query that agree on one cell of turn, scale and shift; cells overlap by half."""
    from itertools import product

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lists = batch.column("matches")
        pair = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        corner, zoom, turn, dx, dy = (lists.flatten().field(x).to_numpy() for x in ("q_corner", "zoom", "turn", "dx", "dy"))
        votes = np.zeros(batch.num_rows, np.int64)
        for a, b, c, d in product((0.0, 0.5), repeat=4) if len(pair) else ():
            cells = np.stack((pair, np.floor(zoom / 2 + d), np.floor(turn / 2 + c) % (TURNS // 2), np.floor(dx / SHIFT + a), np.floor(dy / SHIFT + b), corner), axis=1).astype(np.int64)
            cells = cells[np.lexsort(cells.T[::-1])]
            cells = cells[np.append(True, (cells[1:] != cells[:-1]).any(axis=1))]
            first = np.flatnonzero(np.append(True, (cells[1:, :5] != cells[:-1, :5]).any(axis=1)))
            np.maximum.at(votes, cells[first, 0], np.diff(np.append(first, len(cells))))
        yield pa.RecordBatch.from_arrays([batch.column("q_image"), batch.column("image"), pa.array(votes), batch.column("least")], ["q_image", "image", "votes", "least"])


def find_copies(queries: DataFrame, images: DataFrame, carry_votes: int = MOST_VOTES) -> DataFrame:
    """Both tables have id, width, height and pixels (8-bit grey, row by row). Returns query_id, match_id (a class representative), copies (its class's size), votes."""
    schema = "image long, corner int, x float, y float, scale float, turn int, d0 long, d1 long, d2 long, d3 long"
    of_query, query_ids = _classes(queries)
    of_image, image_ids = _classes(images)
    q = cut(of_query.mapInArrow(_describe, schema), "query-corners")
    i = cut(of_image.mapInArrow(_describe, schema), "image-corners")
    bits = [f"d{k}" for k in range(4)]
    own = ["q_image", "q_corner"]
    asked = q.select(*[F.col(c).alias(f"q_{c}") for c in q.columns])
    distance = sum((F.bit_count(F.col(f"q_{k}").bitwiseXOR(F.col(k))) for k in bits), F.lit(0))
    if q.count() * TABLES <= MOST_BROADCAST:  # counted, not guessed: then the images' corners, the larger side, are not shuffled
        left = _keys(q).select("key", *[F.col(c).alias(f"q_{c}") for c in ("image", "corner", *bits)])
        near = _keys(i).join(F.broadcast(left), "key").filter((distance <= FAR) & (F.shiftright("key", 32) == _first_table())).drop("key", *[f"q_{k}" for k in bits], *bits)
        met = near.join(asked.drop(*[f"q_{k}" for k in bits]), own)
    else:
        left = _keys(q).select("key", *[F.col(c).alias(f"q_{c}") for c in ("image", "corner")])
        near = _keys(i).select("key", "image", "corner").join(left, "key").drop("key").distinct()
        met = near.join(i, ["image", "corner"]).join(asked, own).filter(distance <= FAR)
    ratio = F.col("scale") / F.col("q_scale")
    turn = F.pmod(F.col("turn") - F.col("q_turn"), F.lit(TURNS))
    angle = turn * (2 * 3.141592653589793 / TURNS)
    dx = F.col("x") - (F.cos(angle) * F.col("q_x") - F.sin(angle) * F.col("q_y")) / ratio
    dy = F.col("y") - (F.sin(angle) * F.col("q_x") + F.cos(angle) * F.col("q_y")) / ratio
    one = F.struct("q_corner", F.rint(F.log2(ratio) * 4).alias("zoom"), turn.alias("turn"), dx.alias("dx"), dy.alias("dy"))
    least = q.groupBy(F.col("image").alias("q_image")).agg(F.least(F.lit(carry_votes), F.ceil(F.count(F.lit(1)) / 2)).alias("least"))
    pairs = met.groupBy("q_image", "image").agg(F.collect_set(one).alias("matches"))  # at most the square of an image's corners
    pairs = pairs.join(least, "q_image").filter(F.size(F.array_distinct(F.transform("matches", lambda m: m["q_corner"]))) >= F.col("least"))
    voted = pairs.select("q_image", "image", F.col("least").cast("long"), "matches").mapInArrow(_votes, "q_image long, image long, votes long, least long")
    found = voted.filter("votes >= least").select("q_image", "image", "votes")
    sizes = image_ids.groupBy("image").agg(F.count(F.lit(1)).alias("copies"))
    return found.join(sizes, "image").join(query_ids.select(F.col("id").alias("query_id"), F.col("image").alias("q_image")), "q_image").select("query_id", F.col("image").alias("match_id"), "copies", "votes")


SIDE, CELL = 16, 5


def drawn(vector):
    """A picture of a vector: SIDE by SIDE cells, whose greys are the ranks of fixed random mixtures of the vector's numbers. Close vectors look alike."""
    import numpy as np

    v = np.nan_to_num(np.array(vector, np.float32)).astype(float)
    if len(v) not in _MIXTURES:
        _MIXTURES[len(v)] = np.random.default_rng(11).normal(size=(SIDE * SIDE, len(v)))
    rank = np.argsort(np.argsort(_MIXTURES[len(v)] @ v, kind="stable"), kind="stable").reshape(SIDE, SIDE)
    return (20 + rank * 215.0 / (SIDE * SIDE)).repeat(CELL, axis=0).repeat(CELL, axis=1)


_MIXTURES: dict = {}


def _render(edited: bool):
    """Pictures of vectors. Edited ones are cropped, brighter and of less contrast."""

    def render(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for number, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                if not vector or any(x is None for x in vector):
                    rows.append((number, None, None, None))
                    continue
                image = drawn(vector)
                if edited:
                    image = np.rint(image * 0.8 + 30)[7:-5, 4:-9]
                image = np.rint(image).astype(np.uint8)
                rows.append((number, image.shape[1], image.shape[0], image.tobytes()))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["id", "width", "height", "pixels"])

    return render


def op6_image_copies(spark, sf_dir: str) -> DataFrame:
    """Pictures of all vectors; a cropped and edited copy of every one whose id 50 divides is searched among them all. One row a query: the
    number of classes that it is a copy of (n_links), and the one with most votes (smallest id among equals): match_id, copies, votes."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"))
    schema = "id long, width int, height int, pixels binary"
    asked = vectors.filter("vec_id % 50 = 0")
    found = find_copies(asked.mapInArrow(_render(True), schema), vectors.mapInArrow(_render(False), schema))
    best = F.min(F.struct((-F.col("votes")).alias("rank"), "match_id", "copies", "votes")).alias("best")
    found = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("links"), best)
    out = asked.select(F.col("vec_id").alias("query_id")).distinct().join(found, "query_id", "left")
    return out.select("query_id", F.coalesce("links", F.lit(0)).alias("n_links"), "best.match_id", "best.copies", "best.votes")
