import gzip
import random

from corploom.operators import codec


def test_first_64_views(spark):
    rows = spark.createDataFrame([(i, f"view {i}") for i in reversed(range(70))] + [(-1, None)], "item_id long, text string")
    views = codec.target_views(rows, "item_id", "text")
    assert views == [f"view {i}".encode() for i in range(64)]


def test_sizes():
    """Sizes are those of whole gzip files and LZ4 frames that state their content's size."""
    for raw in (b"", b"a", b"abc" * 500, bytes(range(256)) * 9):
        assert codec.gzip_size(raw) == len(gzip.compress(raw, compresslevel=6, mtime=0))
    # a frame: 4 magic, 2 flags, 8 content size, 1 checksum, 4 block size, the block, 4 end; an incompressible block is stored
    import os

    noise = os.urandom(1000)
    assert codec.lz4_frame_size(noise) == 4 + 2 + 8 + 1 + 4 + 1000 + 4


def test_similarity_is_one_less_distance():
    x, y = b"the same words again " * 20, b"quite other ones here " * 20
    near, far = (codec.similarity(x, codec.gzip_size(x), v, codec.gzip_size(v)) for v in (x, y))
    size = lambda b: len(gzip.compress(b, compresslevel=6, mtime=0))
    assert near == 1 - (size(x + x) - size(x)) / size(x) and near > 0.8 > far


def test_copied_states_give_whole_sizes():
    """Sizes after a copied state and with smaller windows are, byte for byte, those of gzip over all of it."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n)).encode()
    whole = lambda b: len(gzip.compress(b, compresslevel=6, mtime=0))
    views = [some(rng.choice([0, 1, 30, 200])) for _ in range(40)] + [b"a" * 5000, rng.randbytes(900)]
    for raw in [some(n) for n in (1, 50, 150, 300, 2000, 9000)] + [b"ab" * 7000, b"x", rng.randbytes(760), rng.randbytes(3000), b"z" * 762, b"z" * 4096, rng.randbytes(33_000)]:
        assert codec.gzip_size(raw) == whole(raw)
        assert codec.sizes_after(raw, views) == [whole(raw + v) for v in views]


def test_views_in_tiles(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    views = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 90))).encode() for _ in range(30)]
    assert [v for t in codec.tiles(views, 200) for v in t] == views and all(sum(map(len, t)) <= 200 for t in codec.tiles(views, 200))
    assert codec.tiles([b"x" * 500, b"y"], 200) == [[b"x" * 500], [b"y"]] and codec.tiles([]) == []
    texts = ["".join(rng.choice("abc ") for _ in range(60)) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    rows = df.select("text", codec.alignment(F.col("text"), views).alias("one"), codec.alignment(F.col("text"), views, 200).alias("many"), codec.alignment(F.col("text"), []).alias("none")).collect()
    for r in rows:
        raw = (r["text"] or "").encode()
        want = [codec.similarity(raw, codec.gzip_size(raw), v, codec.gzip_size(v)) for v in views] if raw else None
        for got in (r["one"], r["many"]):
            assert (got["best"], got["mean"]) == (None, None) if not want else abs(got["best"] - max(want)) + abs(got["mean"] - sum(want) / 30) < 1e-12
        assert r["none"]["best"] is None
