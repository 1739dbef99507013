import numpy as np
import pytest
from lodestone.functions import geometry as G
from lodestone.functions import text as T
from lodestone.operators import catalog, collection, folds, indexing, synth
from lodestone.operators.collection import VectorCollection, VectorIndex, top_k
from lodestone.sources import files
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_js_round_takes_halves_up(spark):
    got = [one(spark, T.js_round(F.lit(x))) for x in (-2.5, -1.5, 0.5, 2.5)]
    assert got == [-2.0, -1.0, 1.0, 3.0]


def test_tokens_and_symbols(spark):
    assert one(spark, T.tokens(F.lit("a{T}: {2}{"))) == ["a", "{T}", ":", " ", "{2}", "{"]
    assert one(spark, T.tokens(F.lit("a{b"))) == ["a", "{", "b"]
    assert one(spark, T.symbols(F.lit("a{T}{"))) == ["{T}"]
    assert one(spark, T.tokens(F.lit(""))) == []


def test_color_is_the_tail_of_a_digest(spark):
    import hashlib

    assert one(spark, T.color_of(F.lit(7))) == "#" + hashlib.sha256(b"7").hexdigest()[-6:]


def test_or_default(spark):
    assert [one(spark, T.or_default(F.lit(x).cast("string"), "Unknown")) for x in (None, "", "x")] == ["Unknown", "Unknown", "x"]


def polygon(*points):
    return G.array_of(*[G.point(float(x), float(y)) for x, y in points])


def test_polygons(spark):
    square, dart, line = polygon((0, 0), (2, 0), (2, 2), (0, 2)), polygon((0, 0), (4, 0), (1, 1), (0, 4)), polygon((0, 0), (1, 0))
    assert one(spark, G.area(square)) == 4.0
    assert one(spark, G.is_convex(square)) is True
    assert one(spark, G.is_convex(dart)) is False
    assert one(spark, G.is_convex(line)) is None
    m = np.array([[1.1, 0.2, 3], [0.1, 0.9, -2], [0.001, 0.002, 1]])
    back = one(spark, G.homography(G.homography(square, m.tolist()), np.linalg.inv(m).tolist()))
    assert np.allclose([(p["x"], p["y"]) for p in back], [(0, 0), (2, 0), (2, 2), (0, 2)])


def test_perspective_and_orientation():
    a, b = np.array([[0, 0], [4, 0], [5, 6], [0, 5]], float), np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    m = synth.perspective_matrix(a, b)
    p = np.c_[a, np.ones(4)] @ m.T
    assert np.allclose(p[:, :2] / p[:, 2:], b)
    u = np.array([[0, 0], [10, 0], [10, 14], [6, 14], [6, 7], [4, 7], [4, 14], [0, 14]], float)
    assert synth.polygon_area(synth.oriented_quad(u)) == pytest.approx(140)
    assert synth.clipped_area(b, b + 0.5) == pytest.approx(0.25)


def test_closed_form_of_a_perspective(spark):
    r = np.random.default_rng(9)
    target = np.array([[0, 0], [128, 0], [128, 192], [0, 192]], float)
    quads = [np.array([[0, 0], [9, 0], [9, 7], [0, 7]], float) + r.uniform(-2, 2, (4, 2)) for _ in range(30)]
    rows = [(i, [{"x": float(x), "y": float(y)} for x, y in q]) for i, q in enumerate([*quads, np.zeros((4, 2)), np.array([[0, 0], [1, 1], [2, 2], [3, 3]])])]
    df = spark.createDataFrame(rows, "i int, q array<struct<x:double,y:double>>").select("i", G.homography_to_rectangle(F.col("q"), 128.0, 192.0).alias("m"))
    got = {x["i"]: x["m"] for x in df.collect()}
    assert all(np.allclose(np.reshape(got[i], (3, 3)), synth.perspective_matrix(q, target), rtol=1e-6, atol=1e-8) for i, q in enumerate(quads))
    assert got[30] is None and got[31] is None


def test_gate_is_strict_and_first_row_counts(spark):
    rows = spark.createDataFrame([("a", t, v) for t, v in ((0.0, 1.0), (0.5, 100.0), (0.75, 2.0), (1.25, 3.0), (1.5, 4.0))], "k string, t double, v double")
    f = folds.gated_ewma(rows, "k", "t", "v", 0.5).first()
    assert f["n"] == 3 and f["z"] == pytest.approx(0.1 * 4 + 0.9 * (0.1 * 2 + 0.9 * 1))


def test_similar_never_pairs_with_itself(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, name string")
    got = {r["id"]: r["other_id"] for r in catalog.similar(df, "id", "name", F.xxhash64("id")).collect()}
    assert got == {1: 2, 2: 1, 3: None}


def test_last_wins_and_overwrite(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, seq int, v string")
    assert {r["id"]: r["v"] for r in catalog.last_by(df, "id", ["seq"]).collect()} == {"a": "y", "b": "z"}
    new = spark.createDataFrame([("a", None)], "id string, v string")
    assert {(r["id"], r["v"]) for r in catalog.overwritten(df.where("seq = 1"), new, "id", "v").collect()} == {("a", None), ("b", "z")}


def test_collection(spark, tmp_path):
    c = VectorCollection(spark, f"{tmp_path}/cards", 2).create()
    assert c.points().count() == 0
    rows = [("A ", [1.0, 0.0], '{"n":1}'), ("b", [0.0, 1.0], None), ("c", [0.0, 0.0], None)]
    c.upsert(spark.createDataFrame(rows, c.SCHEMA))
    c.upsert(spark.createDataFrame([("b", [1.0, 1.0], '{"n":2}')], c.SCHEMA))
    asked = spark.createDataFrame([("a",), ("zz",)], "id string")
    assert [r["payload"] for r in c.retrieve(asked).collect()] == ['{"n":1}']
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    got = [(r["id"], round(r["score"], 4)) for r in c.nearby(q, 5).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("b", 0.7071)]  # a zero vector has no score
    assert [r["id"] for r in c.nearby(q, 5, threshold=1.0).collect()] == ["a"]
    c.overwrite_payload(spark.createDataFrame([("b", "{}")], "id string, payload string"))
    assert {r["id"]: r["payload"] for r in c.points().collect()} == {"a": '{"n":1}', "b": "{}", "c": None}
    with pytest.raises(Exception, match="wrong dimension"):
        c.upsert(spark.createDataFrame([("d", [1.0], None)], c.SCHEMA))
    assert indexing.build(c, spark.createDataFrame([("a", "x"), ("e", "yy")], "id string, img string"), lambda: lambda batch: [[float(len(b)), 1.0] for b in batch], "img") == 1
    assert c.points().count() == 4
    c.drop()


def test_blocks_of_queries_agree(spark, monkeypatch):
    points = spark.range(40).select(F.col("id"), F.array(*[(F.xxhash64("id", F.lit(k)) % 100).cast("float") for k in range(768)]).alias("vector"))
    queries = points.select(F.col("id").alias("query_id"), "vector")
    whole = {tuple(r) for r in top_k(points, queries, 3).collect()}
    monkeypatch.setattr(collection, "BROADCAST_BYTES", 30_000)
    monkeypatch.setattr(collection, "SCORES", 100)
    cut = top_k(points.repartition(7), queries, 3)
    assert whole == {tuple(r) for r in cut.collect()}
    assert cut.where("rank = 1 and query_id = id").count() == 40


def test_equal_vectors_rank_by_id_and_odd_ones_have_no_score(spark):
    vectors = [[0.1 * k, 1.0, 3.0] for k in range(3)]
    rows = [(i, vectors[i % 3]) for i in range(60)] + [(100, None), (101, []), (102, [0.0] * 3), (103, [1.0, 2.0]), (104, [1.0, None, 2.0])]
    points = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    queries = spark.createDataFrame([("q", vectors[1]), ("z", [0.0] * 3), ("n", None)], "query_id string, vector array<double>")
    got = top_k(points, queries, 100).orderBy("rank").collect()
    assert [r["id"] for r in got if r["query_id"] == "q"][:20] == list(range(1, 60, 3)) and len(got) == 60
    assert top_k(points.limit(0), queries, 3).count() == 0 and top_k(points, queries.limit(0), 3).count() == 0


def shuffled(df):
    """Rows that the exchanges of a result which has run have written."""

    def walk(plan):
        name, inner = plan.nodeName(), plan.children()
        below = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else [inner.apply(i) for i in range(inner.size())]
        own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        return own + sum(map(walk, below))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("skip_self", [False, True])
@pytest.mark.parametrize("threshold", [None, 0.1])
@pytest.mark.parametrize("k", [1, 1100])
def test_a_search_passes_on_little_more_than_its_result(spark, k, threshold, skip_self):
    """However many points there are; beyond 1,000 Spark itself passes on every hit. Against brute force."""
    vectors = np.random.default_rng(4).normal(size=(3000, 8)).round(1)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>")
    queries = points.where("id % 600 = 7").withColumnRenamed("id", "query_id")
    found = top_k(points, queries, k, threshold, skip_self=skip_self)
    got = {(r["query_id"], r["id"], r["rank"]) for r in found.collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    scores = {q: np.round(unit @ unit[q], 12) for q in range(7, 3000, 600)}
    ranked = {q: sorted((-s[i], i) for i in range(3000) if (threshold is None or s[i] >= threshold) and not (skip_self and i == q))[:k] for q, s in scores.items()}
    assert got == {(q, i, n + 1) for q, best in ranked.items() for n, (_, i) in enumerate(best)}
    assert shuffled(found) < len(got) + 5 * 100


def test_scores_that_share_a_bin(spark):
    """Nearly equal vectors: all scores lie in one bin, and a batch still passes on its own best only."""
    vectors = 1 + np.random.default_rng(6).normal(size=(2000, 8)).round(3) / 100
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>").coalesce(1)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    found = top_k(points, points.where("id = 9").withColumnRenamed("id", "query_id"), 1001)
    scores = np.round(unit @ unit[9], 12)
    assert scores.min() > 1 - 2 / collection.BINS
    assert [r["id"] for r in found.orderBy("rank").collect()] == sorted(range(2000), key=lambda i: (-scores[i], i))[:1001]
    again = top_k(points, points.where("id = 9").withColumnRenamed("id", "query_id"), 1001)
    assert again.count() == 1001 and {r["rank"] for r in again.collect()} == set(range(1, 1002)) and shuffled(again) <= 1010


def test_recall_of_the_index(spark):
    """Against the exact way, on all vectors of the table: nine of ten at least; with all cells probed, all."""
    points = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    queries = points.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r["query_id"], r["id"]) for r in top_k(points, queries, 10, ident="vec_id", vector="embedding").collect()}
    index = VectorIndex(points, "vec_id", "embedding", cells=32, sample=300)
    placed = index.placed()
    assert placed.count() == points.count() and placed.where("cell < 0").count() == 0
    found = lambda probes: {(r["query_id"], r["id"]) for r in index.search(placed, queries, 10, probes).collect()}
    assert found(32) == exact
    recall = len(found(20) & exact) / len(exact)
    assert recall >= 0.9, recall


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_of_the_registered_query(spark, sf):
    """indexed_topk as it is registered, against the exact query: nine of ten at least, a vector itself not counted."""
    from lodestone.plans import vectors

    d = f"/root/testdata/sf{sf}"
    of = lambda df: {(r["query_id"], r["id"]) for r in df.collect() if r["query_id"] != r["id"]}
    exact, found = of(vectors.cosine_topk(spark, d)), of(vectors.indexed_topk(spark, d))
    assert len(found & exact) / len(exact) >= 0.9


def test_a_search_reads_the_cells_it_looks_into(spark, tmp_path):
    points = spark.range(400).select("id", F.array(*[F.sin(F.col("id") * (k + 1)).cast("float") for k in range(4)]).alias("vector"))
    index = VectorIndex(points, cells=16, sample=100)
    stored = index.stored(f"{tmp_path}/index")
    assert stored.count() == 400
    query = points.where("id = 7").withColumnRenamed("id", "query_id")
    found = index.search(stored, query, 1, probes=2)
    assert found.first()["id"] == 7
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan


def test_flip_upright_by_hand(spark):
    """A tall quad starts at its second corner; one as wide as high, or wider, stays."""
    quad = lambda pts: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])
    flipped = lambda pts: [(p["x"], p["y"]) for p in one(spark, G.flip_upright(quad(pts)))]
    tall, wide, even = [(0, 0), (2, 0), (2, 5), (0, 5)], [(0, 0), (5, 0), (5, 2), (0, 2)], [(0, 0), (3, 0), (3, 3), (0, 3)]
    assert flipped(tall) == [(2, 0), (2, 5), (0, 5), (0, 0)]
    assert flipped(wide) == wide and flipped(even) == even


def test_folds_stream_over_batches(spark):
    """A hot key over many Arrow batches, nulls left out, the same as a plain loop."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(0 if i % 3 else i % 5, i * 0.7, float(i % 11), [float(i), 1.0]) for i in range(400)] + [(0, None, 1.0, None), (0, 3.0, None, None), (None, 1.0, 5.0, [5.0, 1.0])]
        df = spark.createDataFrame(rows, "k long, t double, v double, w array<double>")
        want, vectors, count, plain = {}, {}, {}, {}
        for k, t, v, w in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: r[1]):
            plain[k] = v if not plain.get(k) else v * 0.1 + plain[k] * 0.9
            if k not in want or t - want[k][0] > 2.5:
                want[k] = (t, v if k not in want else 0.1 * v + 0.9 * want[k][1], want[k][2] + 1 if k in want else 1)
                vectors[k] = w if k not in vectors else [0.1 * a + 0.9 * b for a, b in zip(w, vectors[k])]
            if k not in count or t - count[k][0] >= 4.2:
                count[k] = (t, count[k][1] + 1 if k in count else 1)
        got = {r["k"]: r for r in folds.gated_ewma(df, "k", "t", "v", 2.5).collect()}
        assert {k: (r["t"], pytest.approx(r["z"]), r["n"]) for k, r in got.items()} == want
        assert all(r["z"] == pytest.approx(vectors[r["k"]]) for r in folds.gated_ewma(df, "k", "t", "w", 2.5).collect())
        assert {r["k"]: pytest.approx(r["z"]) for r in folds.ewma(df, "k", ["t"], "v").collect()} == plain
        assert {r["k"]: r["emitted"] for r in folds.every_n(df.where("v is not null"), "k", "t", 4.2).collect()} == {k: n for k, (_, n) in count.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_staging_needs_a_shared_folder():
    from types import SimpleNamespace

    from lodestone import session

    def fake(master, where):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, applicationId="app-1", getConf=lambda: SimpleNamespace(get=lambda k, d: where)))

    assert session.staging_dir(fake("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.staging_dir(fake(master, None))
    assert session.staging_dir(fake("local[2]", None)) == session.staging_dir(fake("local[2]", None))


def test_files(spark, tmp_path):
    for name in ("a.JPG", "sub/b.png", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"\x01\x02")
    found = files.files_with_extension(spark, str(tmp_path), [".jpg", ".png"], content=True)
    assert {r["path"] for r in found.collect()} == {"a.JPG", "sub/b.png"}

    def decode(raw):
        return [float(b) for b in raw]

    assert files.decoded(found.select("path", "content"), decode).select("vector").first()[0] == [1.0, 2.0]


def test_synthetic_labels(spark, tmp_path):
    made = synth.placed(synth.splits(spark, 20, 0.1, 0.1), seed=42)
    again = synth.placed(synth.splits(spark, 20, 0.1, 0.1).repartition(3), seed=42)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(made) == key(again)
    synth.write_labels(made, f"{tmp_path}/labels")
    assert spark.read.text(f"{tmp_path}/labels").where("split = 'train'").count() == made.where("split = 'train'").count()
    with pytest.raises(Exception, match="already exists"):
        synth.write_labels(made, f"{tmp_path}/labels")


def test_symbols_are_substituted_and_nothing_is_lost(spark):
    texts = [("a{T}b", ["a", "uri", "b"]), ("a{b", ["a", "{", "b"]), ("{X}}", ["{X}", "}"]), ("{", ["{"]), ("{{T}", ["{{T}"]), ("{}\n", ["{}", "\n"]), ("", []), (None, [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "id int, text string")
    records = spark.createDataFrame([("{T}", "uri"), ("{T}", "zzz"), (None, "x"), ("", "y")], "symbol string, svg_uri string")
    of = lambda known: {i: [r["item"] for r in sorted(g, key=lambda r: r["pos"])] for i in range(len(texts)) if (g := [r for r in catalog.substituted(df, "id", "text", known).collect() if r["id"] == i]) or True}
    assert of(catalog.symbology(records)) == {i: want for i, (_, want) in enumerate(texts)}
    assert of(catalog.symbology(records.limit(0))) == {i: [t] if t else [] for i, (t, _) in enumerate(texts)}


@pytest.mark.parametrize(("w", "h", "r", "cut"), [(10, 10, 1, 0), (10, 10, 2, 0), (12, 9, 3, 0), (20, 20, 4, 4), (20, 20, 5, 4), (20, 20, 6, 12)])
def test_round_masks_by_hand(spark, w, h, r, cut):
    """Discs around a tile's inner pixel: offsets run from 0 to r - 1, and a pixel is out where their squares pass r squared."""
    from lodestone.functions import tensors as N

    mask = one(spark, N.round_mask(F.lit(w), F.lit(h), (r - 0.5) / max(w, h)))
    assert len(mask) == w * h and mask.count(False) == cut
    assert mask.count(False) == 4 * sum(x * x + y * y > r * r for x in range(r) for y in range(r))
    rows = [mask[i * w : (i + 1) * w] for i in range(h)]
    assert rows == rows[::-1] and all(row == row[::-1] for row in rows)


def test_forced_chances(spark):
    from lodestone.functions import sampling as S

    flags = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, True).when(F.col("id") % 3 == 1, False).alias("f"))
    got = flags.select("f", S.bernoulli_of("x", F.col("id"), S.forced(F.col("f"), 0.25)).alias("hit")).groupBy("f").agg(F.avg(F.col("hit").cast("int")).alias("share")).collect()
    shares = {r["f"]: r["share"] for r in got}
    assert shares[True] == 1 and shares[False] == 0 and 0.15 < shares[None] < 0.35
