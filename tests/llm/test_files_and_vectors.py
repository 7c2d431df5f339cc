"""Archives, inner products and images."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from donorlake.llm import common, op04_media, op08_warc, op09_topk
from tests.conftest import SF


def test_warc(spark):
    rows = [(1, "http://A.example.com/x?b=1#f", "<p>é</p>", 1), (2, "https://b.a.example.com:8080/", "<p>é</p>", 1), (3, None, None, 1), (4, "bad url \n", "", 1), (None, "http://a.example.com/x?b=1", "<p>é</p>", 1), (2, "http://c.org", "<p>é</p>", 1), (7, "http://long.org/", "x" * 2_000_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha int")
    out = common.shared_dir(spark, "t")
    captures = op08_warc.write_archives(pages, out)
    directory = op08_warc.write_index(captures, out)
    got = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op08_warc.read_records(directory).collect()), key=str)
    last = {}
    for p, _, h, _ in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h, _ in rows:
        raw = (h or "").encode()
        first = last[h or ""]
        kind = "response" if (p if p is not None else -1) == first else "revisit"
        want.append((p or -1, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, first if kind == "revisit" else None))
    assert got == sorted(want, key=str)
    index = op08_warc.CaptureIndex(directory)
    assert {c["page_id"] for c in index.captures("https://a.example.com/x?b=1")} == {1, None}
    assert index.captures("http://nowhere.org/") == [] and index.captures("http://long.org")[0]["payload"] == b"x" * 2_000_000
    none = op08_warc.write_archives(pages.limit(0), common.shared_dir(spark, "t"))
    assert op08_warc.read_records(op08_warc.write_index(none, out + "x")).count() == 0
    all_response = op08_warc.write_archives(pages, common.shared_dir(spark, "t"), least_bytes=10**9)
    assert op08_warc.read_records(op08_warc.write_index(all_response, out + "y")).where("record_type = 'revisit'").count() == 0


def test_lookup_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(op08_warc, "BLOCK_CAPTURES", 7)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = common.shared_dir(spark, "t")
    index = op08_warc.CaptureIndex(op08_warc.write_index(op08_warc.write_archives(pages, out), out))
    for r in pages.collect():
        assert r.page_id in {c["page_id"] for c in index.captures(r.url)}


def test_surt():
    assert op08_warc.surt("HTTP://User@Www.Example.COM:80/a/b?q=1#x") == "com,example,www)/a/b?q=1"
    assert op08_warc.surt("https://e.org:444") == "org,e:444)/" and op08_warc.surt(None) == ""


def brute_top(vectors, queries, k=5):
    out = []
    for qid, q in queries:
        rows = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors if i != qid)[:k]
        out += [(qid, r, i, -s) for r, (s, i) in enumerate(rows, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 10**5])
def test_top_k(spark, scale):
    rng = np.random.default_rng(4)
    raw = [(i, [float(x) * scale for x in np.round(rng.normal(size=6), 1)], 0) for i in range(400)]
    raw += [(400 + i, raw[i][1], 0) for i in range(40)]  # ties
    bad = [(900, None, 0), (950, [1.0, None], 0), (1000, [float("nan")] * 6, 0), (1050, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (1100, [0.5, 0.25], 0)]
    table = spark.createDataFrame(raw + bad, "vec_id long, embedding array<double>, q int")
    v = common.materialize(op09_topk.quantised(table), "t")
    good = [(i, [int(np.floor(256 * x)) for x in e]) for i, e, _ in [*raw, bad[-1]]]
    got = sorted(tuple(r) for r in op09_topk.top_k(v, v.where("vec_id % 50 = 0")).collect())
    assert got == brute_top(good, [(i, q) for i, q in good if i % 50 == 0])
    assert op09_topk.top_k(v.limit(0), v).count() == 0 and op09_topk.top_k(v, v.limit(0)).count() == 0
    few = v.where("vec_id in (0, 3, 7)")
    assert op09_topk.top_k(few, few.where("vec_id = 0")).count() == 2


def test_tree_prunes():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 40
    points = np.rint(np.concatenate([c + rng.normal(size=(100, 16)) for c in centres])).astype(np.int64)
    tree = op09_topk.BallTree(points, np.arange(len(points)))
    q = points[:7]
    kth = np.full(7, np.iinfo(np.int64).min)
    _, names = tree.search(q, np.full(7, -1), kth)
    s = q @ points.T
    want = [sorted(range(len(points)), key=lambda j, i=i: (-s[i, j], j))[:5] for i in range(7)]
    assert names.tolist() == want


def pgm(a):
    return b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()


def png(a):
    import zlib

    raw = b"".join(b"\0" + r.astype(np.uint8).tobytes() for r in a)
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", a.shape[1].to_bytes(4, "big") + a.shape[0].to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_copies(spark):
    rng = np.random.default_rng(3)
    base = [np.kron(rng.integers(0, 256, (30, 26)), np.ones((5, 5))) for _ in range(6)]
    rows = [(i, pgm(b), 1) for i, b in enumerate(base)]
    rows += [(100, pgm(base[0][10:120, 5:125]), 1), (101, png(np.clip(base[1] * 0.8 + 20, 0, 255)), 1), (102, pgm(np.rot90(base[2])), 1), (104, pgm(np.where(np.arange(150)[:, None] < 40, 128, base[4])), 1)]
    rows += [(105, None, 1), (106, b"junk", 1), (107, pgm(np.zeros((60, 60))), 1), (None, pgm(base[0]), 1), (108, b"", 1)]
    images = spark.createDataFrame(rows, "image_id long, media binary, d0 int")
    got = {r.image_id: r.class_id for r in op04_media.image_copies(images).collect()}
    assert got == {i: {100: 0, 101: 1, 102: 2, 104: 4}.get(i, i) for i, *_ in rows}
    assert op04_media.image_copies(images.limit(0)).count() == 0


def test_many_copies_hold_together(spark):
    rng = np.random.default_rng(6)
    one = pgm(np.kron(rng.integers(0, 256, (20, 20)), np.ones((5, 5))))
    images = spark.createDataFrame([(i, one) for i in range(60)], "image_id long, media binary")
    assert {r.class_id for r in op04_media.image_copies(images).collect()} == {0}


def stored(spark, images):
    folder = common.shared_dir(spark, "t")
    nodes = op04_media.corners_of(images, folder)
    return nodes, folder


def brute_links(nodes, folder):
    """All pairs of images, compared corner by corner."""
    rows = [(r.node, r.image_id) for r in nodes.where("image_id is not null").collect()]
    have = op04_media.Store(folder).read(np.array([n for n, _ in rows], np.int64))
    out = set()
    for k, (x, i) in enumerate(rows):
        for y, j in rows[k + 1 :]:
            least = op04_media.least_agreeing(len(have[x]), len(have[y]))
            if op04_media.agreeing(have[x], have[y], least) >= least:
                out.add((min(i, j), max(i, j)))
    return out


def resized(a, factor):
    h, w = (round(n * factor) for n in a.shape)
    y, fy = op04_media._bilinear(h, a.shape[0])
    x, fx = op04_media._bilinear(w, a.shape[1])
    rows = a[y] * (1 - fy[:, None]) + a[y + 1] * fy[:, None]
    return rows[:, x] * (1 - fx) + rows[:, x + 1] * fx


def test_recall_against_brute_force(spark):
    """Crops, scales, noise, turns and gamma of smooth and of sharp pictures: 0.9 or more of all links of the brute force."""
    rng = np.random.default_rng(12)
    y, x = np.mgrid[:150, :130]
    spots = lambda: sum(rng.normal() * np.exp(-((y - rng.uniform(0, 150)) ** 2 + (x - rng.uniform(0, 130)) ** 2) / (2 * rng.uniform(3, 14) ** 2)) for _ in range(150))
    smooth = [spots() for _ in range(3)]
    base = [(a - a.min()) / (a.max() - a.min()) * 255 for a in smooth] + [np.kron(rng.integers(0, 256, (30, 26)), np.ones((5, 5))) for _ in range(3)]
    edits = [lambda a: a[15:125, 10:120], lambda a: a[40:, 30:], np.rot90, np.flipud, lambda a: 255 * (a / 255) ** 1.4, lambda a: np.clip(a + rng.normal(0, 10, a.shape), 0, 255)]
    edits += [lambda a, f=f: resized(a, f) for f in (0.5, 0.75, 0.85, 1.2, 1.5)]
    rows = [(100 * k + n, pgm(e(a))) for k, a in enumerate(base) for n, e in enumerate([lambda a: a, *edits])]
    nodes, folder = stored(spark, spark.createDataFrame(rows, "image_id long, media binary"))
    want = brute_links(nodes, folder)
    name = {r.node: r.image_id for r in nodes.collect()}
    have = {tuple(sorted((name[r.a], name[r.b]))) for r in op04_media.links(nodes, folder).collect()}
    assert have <= want and len(have) >= 0.9 * len(want), (len(have), len(want))
    assert sum(i // 100 != j // 100 for i, j in want) <= 0.05 * len(want)  # small pictures of few corners agree by chance at times
    found = len({i // 100 for i, j in want if i % 100 == 0}), sum(i % 100 == 0 for i, _ in have)
    assert found[0] == 6 and found[1] >= 0.8 * 6 * (len(edits) - 1)  # a mirrored picture isn't a copy


def test_pages_against_brute_force(spark):
    """Classes of the rendered pages of a small table against all pairs."""
    nodes, folder = stored(spark, op04_media.rendered(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")))
    want = brute_links(nodes, folder)
    name = {r.node: r.image_id for r in nodes.collect()}
    have = {tuple(sorted((name[r.a], name[r.b]))) for r in op04_media.links(nodes, folder).collect()}
    assert have <= want and len(have) >= 0.9 * len(want), (len(have), len(want))


def test_comparisons_hold_asked_corners_only(spark):
    """What lies between two images' corners in a file isn't kept with them; an image is compared with many as with each alone."""
    rng = np.random.default_rng(15)
    base = [np.kron(rng.integers(0, 256, (20, 20)), np.ones((5, 5))) for _ in range(3)]
    rows = [(i, pgm(np.clip(base[i % 3] + rng.normal(0, 4, (100, 100)), 0, 255))) for i in range(12)]
    nodes, folder = stored(spark, spark.createDataFrame(rows, "image_id long, media binary").coalesce(1))
    names = np.sort(np.array([r.node for r in nodes.collect()], np.int64))
    store = op04_media.Store(folder)
    ends = store.read(names[[0, -1]])
    assert all(c.base is None for c in ends.values())
    assert store.sizes(names[[0, -1]]).tolist() == [ends[int(n)].nbytes for n in names[[0, -1]]]
    have = store.read(names)
    for x in names.tolist():
        many = [have[y] for y in names.tolist()]
        least = [op04_media.least_agreeing(len(have[x]), len(b)) for b in many]
        alone = [op04_media.agreeing(have[x], b, e) for b, e in zip(many, least)]
        assert op04_media.agreeing_of_many(have[x], many, least) == alone and sum(n > 0 for n in alone) >= 4


def test_keys_go_in_blocks(spark, monkeypatch):
    """Blocks hold every key of every image, in fewer than 12 bytes (rows of two longs: 16), and make the pairs of the plain rows; the shuffle option is as it was."""
    rng = np.random.default_rng(16)
    base = [np.kron(rng.integers(0, 256, (40, 40)), np.ones((5, 5))) for _ in range(4)]
    rows = [(i, pgm(np.clip(base[i % 4] + rng.normal(0, 3, (200, 200)), 0, 255))) for i in range(40)]
    nodes, folder = stored(spark, spark.createDataFrame(rows, "image_id long, media binary").coalesce(2))
    plain = op04_media.filed(nodes, folder)
    want = sorted(tuple(r) for r in plain.collect())
    for buckets in (1, 7, 100):
        blocks = op04_media.packed(nodes, folder, buckets).collect()
        have = [op04_media._unpacked(*b, buckets) for b in blocks]
        assert sorted((k, n) for keys, names in have for k, n in zip(keys.tolist(), names.tolist())) == want
        assert all(((keys >> op04_media._LOW) % buckets == b.bucket).all() for b, (keys, _) in zip(blocks, have))
    assert sum(len(b.block) + len(b.nodes) for b in op04_media.packed(nodes, folder, 100).collect()) < 12 * len(want)
    for dense in (64, 5):
        monkeypatch.setattr(op04_media, "DENSE", dense)
        pairs = [{(r.a, r.b, r.star): r.n for r in m.groupBy("a", "b", "star").agg(F.sum("n").alias("n")).collect()} for m in (op04_media._pairs(plain, False), op04_media.met_once(nodes, folder))]
        assert pairs[0] == pairs[1] and len(pairs[0]) > 100
    was = spark.conf.get(op04_media.TIDY)
    monkeypatch.setattr(op04_media, "filed", None)  # dense keys are known from the first pass
    assert op04_media.links(nodes, folder).count() >= 4 * 45
    assert spark.conf.get(op04_media.TIDY) == was


def test_a_bucket_is_unpacked_in_parts(spark, monkeypatch):
    """However many keys a bucket has, a bounded part of it is unpacked at once, with all images of its keys."""
    rng = np.random.default_rng(18)
    rows = [(i, pgm(np.kron(rng.integers(0, 256, (40, 40)), np.ones((5, 5))))) for i in range(30)]
    rows += [(100 + i, media) for i, media in rows]
    nodes, folder = stored(spark, spark.createDataFrame(rows, "image_id long, media binary").coalesce(3))
    monkeypatch.setattr(op04_media, "ROWS", 500)
    for buckets in (1, 3):
        blocks = {}
        for b in op04_media.packed(nodes, folder, buckets).collect():
            blocks.setdefault(b.bucket, []).append((bytes(b.nodes), bytes(b.block)))
        for bucket, have in blocks.items():
            whole = sorted((k, n) for x in have for k, n in zip(*(c.tolist() for c in op04_media._unpacked(bucket, *x, buckets))))
            parts = [list(zip(*(c.tolist() for c in p))) for p in op04_media._in_parts(bucket, have, buckets)]
            assert len(parts) > 5 and max(map(len, parts)) < 600
            assert sorted(r for p in parts for r in p) == whole
            assert sum(len({k for k, _ in p}) for p in parts) == len({k for k, _ in whole})  # no key is parted


def test_comparisons_of_repeating_pictures(spark):
    """Corners with the same descriptor, many in an image: matches as by the plain definition."""
    rng = np.random.default_rng(17)
    corners = np.zeros(90, op04_media.CORNER)
    kinds = rng.integers(0, 2**63, (6, 2), dtype=np.uint64)
    images = []
    for _ in range(5):
        c = corners.copy()
        c["x"], c["y"], c["d"] = rng.integers(0, 999, 90), rng.integers(0, 999, 90), kinds[rng.integers(0, 6, 90)]
        c["d"][:, 0] ^= np.uint64(1) << rng.integers(0, 12, 90, dtype=np.uint64)
        images.append(c)
    compared = op04_media.Compared(images)
    k, i, j = compared._mutual(0, np.array([1, 3, 4]))
    got = list(zip(k.tolist(), (i - compared.starts[0]).tolist(), j.tolist()))
    want = []
    for n, y in enumerate((1, 3, 4)):
        far = np.bitwise_count(images[0]["d"][:, None] ^ images[y]["d"][None]).sum(axis=2)
        best = (far == far.min(axis=1, keepdims=True)) & (far == far.min(axis=0, keepdims=True)) & (far <= op04_media.DISTANCE)
        want += [(n, a, b + 90 * y) for a, b in zip(*(x.tolist() for x in np.nonzero(best)))]
    assert got == want and len(got) > 500


def test_dense_keys_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(14)
    one = np.kron(rng.integers(0, 256, (20, 20)), np.ones((5, 5)))
    two = np.kron(rng.integers(0, 256, (28, 28)), np.ones((5, 5)))
    two[:40, :40] = one[:40, :40]
    rows = [(i, pgm(np.clip((one if i % 2 else two) + rng.normal(0, 2, (one if i % 2 else two).shape), 0, 255))) for i in range(24)]
    images = spark.createDataFrame(rows, "image_id long, media binary")
    whole = {r.image_id: r.class_id for r in op04_media.image_copies(images).collect()}
    monkeypatch.setattr(op04_media, "DENSE", 4)
    assert whole == {r.image_id: r.class_id for r in op04_media.image_copies(images).collect()} == {i: i % 2 for i in range(24)}


def test_dense_and_other_keys_count_together(spark, monkeypatch):
    """Pairs that share one common and one rare key, whatever counts as common."""
    rows = [(1, i) for i in range(30)] + [(2, 5), (2, 6), (3, 7), (3, 8), (4, 7), (4, 8), (5, 0), (5, 9), (6, 20), (6, 21), (7, 3), (7, 40)]
    filed = spark.createDataFrame(rows, "key long, node long")
    nodes = spark.createDataFrame([(i, 8) for i in range(41)], "node long, n int")

    def found():
        met = op04_media._pairs(filed, False).cache()
        first = op04_media.candidates(met, nodes)
        pairs = {(r.a, r.b) for r in first.collect()}
        keys = met.where("a is null").select("key").distinct()
        again = op04_media._pairs(filed.join(keys, "key").withColumn("root", F.col("node")), True)
        more = {(r.a, r.b) for r in op04_media.more_candidates(met, again, first, nodes).collect()}
        assert not pairs & more
        return pairs | more

    want = {(5, 6), (7, 8), (0, 9), (20, 21)}
    for dense in (1000, 4, 2):
        monkeypatch.setattr(op04_media, "DENSE", dense)
        assert found() == want


def test_noisy_copies_hold_together(spark):
    """More edited copies than any key pairs by neighbours, beside images that share a patch only."""
    rng = np.random.default_rng(8)
    one = np.kron(rng.integers(0, 256, (20, 20)), np.ones((5, 5)))
    rows = [(i, pgm(np.clip(one + rng.normal(0, 4, one.shape), 0, 255))) for i in range(40)]
    for i in range(100, 130):
        other = np.kron(rng.integers(0, 256, (28, 28)), np.ones((5, 5)))
        other[:40, :40] = one[:40, :40]
        rows.append((i, pgm(other)))
    got = op04_media.image_copies(spark.createDataFrame(rows, "image_id long, media binary")).collect()
    assert {r.image_id: r.class_id for r in got} == {i: 0 if i < 100 else i for i, _ in rows}


def test_equal_and_short_images(spark):
    flat, other = pgm(np.zeros((10, 10))), pgm(np.ones((10, 10)))
    rows = [(1, flat), (2, flat), (3, other), (4, flat), (5, None), (6, None), (None, flat), (7, other), (7, pgm(np.full((9, 9), 2)))]
    got = {r.image_id: (r.class_id, r.n_corners) for r in op04_media.image_copies(spark.createDataFrame(rows, "image_id long, media binary")).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (3, 0), 4: (1, 0), 5: (5, 0), 6: (6, 0), None: (None, 0), 7: (3, 0)}


def test_decode_formats():
    import zlib

    a = np.arange(24).reshape(4, 6)
    assert (op04_media.decode(png(a)) == a).all() and (op04_media.decode(pgm(a)) == a).all()
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    head = lambda depth, colour: b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (6).to_bytes(4, "big") + (4).to_bytes(4, "big") + bytes([depth, colour, 0, 0, 0]))
    palette = head(8, 3) + chunk(b"PLTE", bytes(x for k in range(24) for x in (k, k + 1, k + 2))) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.astype(np.uint8).tobytes() for r in a)))
    assert (op04_media.decode(palette) == a + 1).all()
    deep = head(16, 0) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + (r * 256 + 7).astype(">u2").tobytes() for r in a)))
    assert (op04_media.decode(deep) == a).all()
    assert op04_media.decode(b"junk") is None and op04_media.decode(b"") is None and op04_media.decode(None) is None


def test_waves_share_the_kth_score(spark):
    """A later wave starts from what earlier ones found, and still the whole result is that of brute force."""
    rng = np.random.default_rng(8)
    x = rng.integers(-40, 40, (3000, 6))
    rows = [(i, r.astype("<f8").tobytes()) for i, r in enumerate(x)]
    v = common.materialize(spark.createDataFrame(rows, op09_topk.VECTORS).repartition(3), "t")
    got = sorted(map(tuple, op09_topk.top_k(v, v.where("vec_id % 7 = 0")).collect()))
    score = x @ x.T
    want = []
    for q in range(0, 3000, 7):
        best = sorted((-int(score[q, c]), c) for c in range(3000) if c != q)[:5]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert got == sorted(want)
    found = spark.createDataFrame([(1, 1, 0, 0, 7, s) for s in (9, 5, 8, 7, 6, 1)] + [(2, 2, 0, 1, 7, 3)], op09_topk.FOUND)
    (row,) = op09_topk._bounds(found, common.shared_dir(spark, "bounds"), 5, 1).collect()
    known = op09_topk._load(row.file)
    assert (row.block, known["slots"].tolist(), known["scores"].tolist()) == (0, [0], [5])
