"""One test per finding of round 3: each failed before its change."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voltgrid.functions import durable, geo
from voltgrid.llm import languages, packing, simhash
from voltgrid.operators import bandits, candidates, linear, neighbours, ordered, placements, polygons, roads, runs, synthesis, tiles, trajectories
from voltgrid.plans import catalog
from voltgrid.plans.catalog import sources
from voltgrid.plans.registry import QUERIES

catalog.load()
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_slivers_make_no_cell(spark):
    """a tip that reaches a centimetre into the next column."""
    ring = "array({})".format(", ".join(f"named_struct('x', {500000 + x}D, 'y', {4690000 + y}D)" for x, y in ((0, 0), (750.01, 50), (0, 100))))
    lat_lon = geo.from_utm_points(F.expr(ring), F.lit(17), F.lit(False))
    ring = F.transform(lat_lon, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    areas = spark.range(1).select(F.lit("a").alias("area_id"), F.array(ring).alias("rings"))
    assert [r["grid_id"] for r in polygons.primary_grid(areas).collect()] == ["primary_a_0_0"]


def test_box_bounds_are_decimals(spark):
    """-83.79 - 0.01 and -83.70 + 0.005 in doubles lie beside the bounds they stand for."""
    box = {"min_lat": 42.23, "max_lat": 42.31, "min_lon": -83.79, "max_lon": -83.70}
    at = spark.createDataFrame([("s", "K-Means", "e", "l", 42.25, -83.8 - 2e-14)], "station_id string, method string, edge_id string, lane string, lat double, lon double")
    assert placements.validate(at, box).first()["lon"] == -83.79
    near = spark.createDataFrame([(42.25, -83.695 - 1.5e-14), (42.25, -83.695)], "lat double, lon double")
    assert near.filter(roads._inside(F.col("lat"), F.col("lon"), box, 0.005)).count() == 1


def test_budget_of_many_stations(spark):
    """4000 * (1 + 4998 * 0.3) is whole."""
    r = runs.adaptive_budget(spark.range(1).select(F.lit(5000).cast("long").alias("stations"))).first()
    assert (r["max_episodes"], r["min_episodes"], r["exploration_episodes"], r["early_stopping_patience"]) == (6001600, 1800480, 2400640, 900240)


def test_some_vehicles_stay_unserved(spark, tmp_path):
    """a charge counts in the episode of its part, not of the row that shows the need."""
    rows = [(1, 3, 5, 1.0), (2, 3, 3, 1.0), (4, 9, 9, 50.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double").selectExpr("*", "1 AS l_linenumber", "10D AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert QUERIES["jon21_unserved"](spark, str(tmp_path)).collect() == [(3, 50.0)]


def test_packs_are_not_broadcast(spark, tmp_path):
    """a small file of edges, whose repeated packs are large, beside a large estimate of points."""
    spark.range(40000).selectExpr("concat('e', id) AS edge_id", "array(named_struct('x', id % 997D, 'y', id % 991D), named_struct('x', id % 997 + 9D, 'y', id % 991 + 9D)) AS shape").write.parquet(f"{tmp_path}/e")
    points = spark.range(1 << 20).selectExpr("concat('p', id) AS id", "42.217 + id % 97 / 1e5 AS lat", "-83.8084 + id % 89 / 1e5 AS lon")
    points = points.unionByName(points.crossJoin(spark.range(1 << 20).select(F.col("id").alias("x")).filter("x < 0")).drop("x"))
    plan = roads.nearest_edge(points, spark.read.parquet(f"{tmp_path}/e"), "id", 400.0)._jdf.queryExecution().executedPlan().toString()
    assert "Inner, BuildLeft" not in plan and "_salt" in plan


def test_links_that_the_forest_leaves_out(monkeypatch, spark):
    """texts with 0..4 and 12..16 edits; only those with 4 and 12 link across, all fingerprints are equally near."""
    used = set(np.concatenate(simhash.block_plan(10, simhash.SIMILAR, simhash.RECALL, 256)).tolist())
    free = [b for b in range(256) if b not in used][:10]
    edits = [*range(5), *range(12, 17)]

    def fixed(text, shingle):
        bits = np.zeros(256, np.uint8)
        bits[free[edits.index(text.count("x"))]] = 1
        return np.packbits(bits, bitorder="little").tobytes()

    monkeypatch.setattr(simhash, "long_fingerprint", fixed)
    texts = [" ".join(f"x{k}" if k % 20 == 10 and k < 20 * e else f"w{k}" for k in range(400)) for e in edits]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.near_copies(docs).select("root").distinct().count() == 1


def test_links_across_make_no_row_per_pair(spark, monkeypatch):
    """pipeline: 400 texts of one fingerprint in pairs of near copies; all pairs are compared, in packs, and only forests become rows."""
    monkeypatch.setattr(simhash, "WHOLE", 64, raising=False)
    monkeypatch.setattr(simhash, "long_fingerprint", lambda text, shingle: bytes(32))
    compared, check = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda edges, *a: compared.append(edges.count()) or check(edges, *a))
    texts = [" ".join(f"w{i % 200}_{k}" for k in range(60)) + f" end{i // 200}" for i in range(400)]
    found = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["root"], []).append(r["doc_id"])
    assert sorted(map(sorted, groups.values())) == [[i, i + 200] for i in range(200)]
    assert sum(compared) <= simhash.BLOCKS * 400 < 400 * 399 / 2


def test_points_at_one_place_are_compared_once(spark, monkeypatch):
    """copies add to the counts and densities of their place, not to the pairs."""
    places = [(0.0, 0.0), (0.004, 0.003), (0.0, 0.015), (0.03, 0.0), (0.3, 0.0)]
    points = spark.range(500).select(F.col("id"), *[F.element_at(F.array(*[F.lit(p[i]) for p in places]), (F.col("id") % 5 + 1).cast("int")).alias(c) for i, c in enumerate(("lat", "lon"))])
    compared, fold, sums = [], neighbours.fold_near, neighbours.kernel_sums
    monkeypatch.setattr(neighbours, "fold_near", lambda left, right, *a: compared.append((left.count(), right.count())) or fold(left, right, *a))
    monkeypatch.setattr(neighbours, "kernel_sums", lambda left, right, *a, **b: compared.append((left.count(), right.count())) or sums(left, right, *a, **b))
    counts = {r["id"]: r[1:] for r in neighbours.radius_counts(points, "id", "long").collect()}
    density = {r["id"]: r[1:] for r in neighbours.decay_density(points, "id", "long").collect()}
    assert compared == [(5, 5), (5, 5)] and len(counts) == len(density) == 500
    for i in range(5, 500, 99):
        d = [np.hypot(places[i % 5][0] - p[0], places[i % 5][1] - p[1]) for p in places]
        assert counts[i] == tuple(100 * sum(x <= r for x in d) - 1 for r in neighbours.RADII)
        assert np.allclose(density[i], [100 * sum(np.exp(-x / r) for x in d) - 1 for r in neighbours.RADII], rtol=1e-7)


def test_predictions_are_not_written(spark, monkeypatch):
    """Nothing that is written has a row per configuration; ranks with ties over several slices are right."""
    written, write = [], linear.materialize
    monkeypatch.setattr(linear, "materialize", lambda df: written.append(write(df)) or written[-1])
    rows = spark.range(300).selectExpr("id", "id % 7 / 7D AS a", "id % 11 * 1D AS b", "id % 13 + id % 7 * 1D AS target_original")
    configurations = [("target_original", s, a) for s in ("standard", "robust") for a in linear.PENALTIES]
    got = linear.cross_validated(rows, ["a", "b"], configurations, "id").collect()
    assert len(got) == 30 and all(w.count() <= 300 for w in written)
    prepared = linear.prepared(rows, ["a", "b"], ["target_original"], "id", 5, 42, False)
    fitted = linear.models(prepared, ["a", "b"], configurations, 5)
    scored = linear.predictions(prepared, ["a", "b"], fitted).toPandas()
    for r in got:
        one = scored[(scored.scaler == r.scaler) & (scored.algorithm == r.algorithm) & (scored.fold == r.fold)]
        assert abs(r.spearman_r - one.label.rank().corr(one.prediction.rank())) < 1e-12


def test_far_packs_are_not_compared(spark):
    """a drawn row meets the boxes near it, not all packs of its bin, and copies count k + 1 times at most."""
    rows = spark.range(40000).selectExpr("id", "1 AS bin", "(id % 2000) * 1D AS a", "((id * 7919) % 2003) * 1D AS b")
    rows = rows.unionByName(spark.range(40000, 41000).selectExpr("id", "1 AS bin", "5D AS a", "5D AS b"))
    drawn = rows.filter("id IN (0, 20011, 40500)").withColumn("_key", F.col("id").cast("string")).withColumnRenamed("id", "_self")
    met = synthesis._feature_packs(drawn, rows, ["a", "b"], "id", 4).collect()
    assert sum(len(r["r__other"]) for r in met) < 20000
    plain = {r["id"]: (r["a"], r["b"]) for r in rows.collect()}
    for key in ("0", "20011", "40500"):
        x = plain[int(key)]
        dist = lambda i: (np.hypot(plain[i][0] - x[0], plain[i][1] - x[1]), i)
        others = {i for r in met if key in r["l__key"] for i in r["r__other"]}
        assert sorted(dist(i) for i in others if i != int(key))[:4] == sorted(dist(i) for i in plain if i != int(key))[:4]


def test_trace_holds_one_chunk(spark):
    """chunks of five rows give what one chunk gives."""
    runs_ = spark.range(400).selectExpr("concat('g', id % 3) AS grid_id", "'m' AS method", "id AS episode", "cast(id * 7 % 5 as int) AS arm", "id * 37 % 101 / 101D AS reward")
    whole, cut = (bandits.confidence_trace(runs_, **some).toPandas().sort_values("episode").reset_index(drop=True) for some in ({}, {"chunk": 5}))
    assert len(cut) == 400 and (whole[["episode", "arm", "action_diversity"]] == cut[["episode", "arm", "action_diversity"]]).all().all()
    assert np.allclose(whole.iloc[:, 4:].astype(float), cut.iloc[:, 4:].astype(float), rtol=1e-9, atol=1e-12)


def test_words_are_looked_up_in_arrow_columns():
    """op4_packing: words come from a column of texts as dictionary codes, not as a Python object each."""
    texts = [None, "", " \t\n", "  Two  WORDS, and\x0b\x0ctwo more;\r\n", "a\x1cb\u0085c   d", "<|endoftext|> Kept <|", "x" * 3000 + " ünïcode, 日本 ßtraße! it's 1,000.50?!", "word word, word. Word"] * 2
    words, tokenizer = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    for column in (pa.array(texts), pa.array(["cut", *texts, "off"]).slice(1, len(texts))):
        assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(column)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_farthest_sites_meet_in_packs(spark, monkeypatch):
    """packs of draws meet packs of sites in one row each; many sites at one place and ties give what all pairs give."""
    monkeypatch.setattr(candidates, "DRAWS", 16)
    sites = spark.range(1200).selectExpr("concat('g', id % 2) AS grid_id", "concat('s', id) AS site_id", "concat('e_', id % 900) AS edge_id",
                                         "if(id % 3 = 0, 5D, id * 29 % 130 / 100D) AS lat", "if(id % 3 = 0, 5D, id * 83 % 133 / 100D) AS lon")
    packs = sites.groupBy("grid_id").agg(F.collect_list(F.struct("site_id", "edge_id", "lat", "lon")).alias("_pts"))
    rows = sites.collect()
    starts = [r for r in rows if int(r["site_id"][1:]) < 80]
    first = spark.createDataFrame([(r["grid_id"], int(r["site_id"][1:]) // 2, [(r["site_id"], r["edge_id"], r["lat"], r["lon"]), ("other", "x", 0.5, 0.5)]) for r in starts],
                                  "grid_id string, draw int, sel array<struct<site_id string, edge_id string, lat double, lon double>>")
    found = {}
    for r in candidates._far(first, packs).collect():
        found.setdefault((r["grid_id"], r["draw"]), []).append(tuple(r["p"]))
    assert len(found) == 80 and max(map(len, found.values())) < 10
    for s in starts:
        far = lambda p: min(np.hypot(p["lat"] - s["lat"], p["lon"] - s["lon"]), np.hypot(p["lat"] - 0.5, p["lon"] - 0.5))
        want = max((round(far(p), 12), p["site_id"]) for p in rows if p["grid_id"] == s["grid_id"] and p["site_id"] != s["site_id"])
        assert want[1] in {p[0] for p in found[s["grid_id"], int(s["site_id"][1:]) // 2]}


def test_xml_files_stay_small(spark, tmp_path, monkeypatch):
    """a task reads an XML file whole, so more rows make more files, also in a session that merges small partitions."""
    monkeypatch.setattr(sources, "XML_ROWS", 20, raising=False)
    monkeypatch.setattr(sources, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    spark.range(400).selectExpr("id AS l_orderkey", "id % 7 AS l_suppkey", "id AS l_partkey", "1 AS l_linenumber", "10D AS l_quantity", "20D AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name, out in (("src07_battery_xml", "battery"), ("src08_charging_xml", "charging")):
        assert sum(r["n"] for r in QUERIES[name](spark, str(tmp_path)).collect()) == 400
        files = [p.read_text().count("<vehicle") for p in (tmp_path / out).glob("part*")]
        assert sum(files) == 400 and len(files) > 10 and max(files) <= 60


def test_points_are_sorted_once_for_demand_points(spark, monkeypatch):
    """dwells and low-charge points take the same slices of the points."""
    sorted_, cut = [], ordered.slices
    for module in (ordered, trajectories):
        monkeypatch.setattr(module, "slices", lambda df, keys, order: sorted_.append(tuple(map(str, order))) or cut(df, keys, order))
    points = spark.range(300).selectExpr("concat('v', id % 3) AS veh_id", "42.2 + (id * 31 % 17) / 100D AS lat", "-83.8 + (id * 57 % 13) / 100D AS lon", "id * 9000D AS t", "id AS ord")
    kinds = {r["kind"]: r["count"] for r in trajectories.demand_points(points).groupBy("kind").count().collect()}
    assert sorted_.count(trajectories.ORDER) == 1
    assert kinds["trip_destination"] == 3 and kinds.get("low_soc", 0) == trajectories.low_charge_points(points).count() and kinds.get("long_dwell", 0) == trajectories.long_dwells(points).count()


def test_texts_pass_to_python_in_bounded_batches(spark, monkeypatch):
    """pipeline: batches of texts are bounded in bytes, whatever the length of their rows; results stay and so does the session's setting."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, cut = spark.conf.get(key), [], languages.blocks
    monkeypatch.setattr(durable, "BATCH_BYTES", 1 << 16, raising=False)

    def few(texts):
        assert len(texts) <= 100
        return cut(texts)

    monkeypatch.setattr(languages, "blocks", few)
    monkeypatch.setattr(simhash, "materialize", lambda df: seen.append(int(spark.conf.get(key).rstrip("b"))) or durable.materialize(df))
    docs = spark.range(0, 1000, 1, 1).selectExpr("id AS doc_id", "if(id % 2 = 0, 'de', 'en') AS lang", "repeat(concat(if(id % 2 = 0, 'der Wagen ', 'the car '), 'n', id % 50, ' '), 150) AS text")
    known = languages.known_language(docs)
    assert known.count() == 1000 and known.columns == docs.columns
    assert sorted(r["doc_id"] for r in simhash.keep_one(known).collect()) == list(range(50))
    assert seen and set(seen) == {1 << 16} and spark.conf.get(key) == before


def test_buckets_of_a_few_blocks_at_once(spark, monkeypatch):
    """pipeline: rows per fingerprint and block are made for some blocks at a time; the links are those of all blocks."""
    monkeypatch.setattr(simhash, "PACK", 16)
    rng, made, write = np.random.default_rng(3), [], simhash.materialize
    base = rng.integers(0, 256, (8, 32), np.uint8)
    rows = []
    for i in range(160):
        bits = np.zeros(256, np.uint8)
        bits[rng.choice(256, int(rng.integers(0, 12)), replace=False)] = 1
        rows.append((i, bytearray((base[i % 8] ^ np.packbits(bits)).tobytes())))
    prints = spark.createDataFrame(rows, "key long, fp binary")
    monkeypatch.setattr(simhash, "materialize", lambda df: made.append(write(df)) or made[-1])
    links = {(r["a"], r["b"]) for r in simhash.candidate_links(prints).collect()}
    counted = [df.agg(F.count_distinct("j")).first()[0] for df in made if "n" in df.columns]
    assert len(counted) == -(-simhash.BLOCKS // simhash.TOGETHER) and max(counted) <= simhash.TOGETHER
    root = list(range(160))
    for _ in range(160):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert root == [i % 8 for i in range(160)]


def test_pairs_of_packs_pass_in_bounded_batches(spark, monkeypatch):
    """pairs of packs, some 30 KB a row, go to Python in batches bounded in bytes; the nearest sites stay."""
    monkeypatch.setattr(durable, "BATCH_BYTES", 1 << 16)
    seen, write = [], tiles.materialize
    monkeypatch.setattr(tiles, "materialize", lambda df: seen.append(int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b"))) or write(df))
    points = spark.range(600).selectExpr("concat('p', id) AS p", "id % 30 * 10D AS lat", "id % 20 * 10D AS lon")
    sites = spark.range(40).selectExpr("concat('s', id) AS s", "id * 37 % 300 * 1D AS lat", "id * 53 % 200 * 1D AS lon")
    got = {r["p"]: (r["dist"], r["s"]) for r in tiles.nearest(points, sites, "p", "s", within=25.0).collect()}
    at, want = sites.collect(), {}
    for r in points.collect():
        near = min((float(np.hypot(r["lat"] - x["lat"], r["lon"] - x["lon"])), x["s"]) for x in at)
        if near[0] <= 25:
            want[r["p"]] = near
    assert got == want and 1 << 16 in seen
