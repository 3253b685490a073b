"""Vectors, people, text and fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import search_text
from ..operators import filters, ordering, people, search, vectors, verified
from ..operators.quality import verdict_key
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..sources.scratch import materialize, shared_dir
from . import adapters
from .adapters import clips, examples, faces, media, table, vec_units
from .registry import query

KNN = """SELECT query_id, unit_id, asset_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id))::INTEGER AS rank FROM (
  SELECT q.unit_id AS query_id, u.unit_id, u.asset_id, round(list_dot_product(u.vector, q.vector), 9) AS score FROM vec_units u, vec_units q WHERE q.unit_id % 50 = 0 AND {0})
  QUALIFY rank <= {1}"""
NEAR = "u.asset_id IN (SELECT id FROM media WHERE coalesce(user_latitude, latitude) BETWEEN 55 AND 55.5)"


def asked(spark, d):
    return vec_units(spark, d).filter("unit_id % 50 = 0").select(F.col("unit_id").alias("query_id"), "vector")


def rounded(df, *cols, n: int = 6):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("""SELECT asset_id, unit_id, round(score, 6) AS score, (row_number() OVER (ORDER BY score DESC, asset_id) - 1)::BIGINT AS ordinal FROM (
  SELECT u.asset_id, u.unit_id, list_dot_product(u.vector, q.vector) AS score, row_number() OVER (PARTITION BY u.asset_id ORDER BY list_dot_product(u.vector, q.vector) DESC, u.unit_id) AS r
  FROM vec_units u JOIN ready m ON m.id = u.asset_id, (SELECT vector FROM vec_units WHERE asset_id = 7 ORDER BY timestamp_ms LIMIT 1) q WHERE u.asset_id <> 7 AND m.camera = 'cam_0' AND m.extension = '.jpg') WHERE r = 1""", "vec_units", "ready")
def search_similar_filtered(spark, d):
    """Frames most like asset 7 within filters, the best frame of each asset, frozen with ordinals."""
    units = vec_units(spark, d)
    allowed = filters.prefilter(units.filter("asset_id <> 7"), media(spark, d), filters.Filters(camera="cam_0", extension=".jpg").condition())
    own = units.filter("asset_id = 7").orderBy("timestamp_ms").limit(1).select(F.col("vector").alias("q"))
    scored = allowed.join(F.broadcast(own), how="cross").withColumn("score", vectors.dot("vector", "q"))
    best = vectors.best_per_asset(scored).select("asset_id", "unit_id", F.round("score", 9).alias("score"))
    frozen = ordering.freeze(best, [F.col("score").desc(), F.col("asset_id").asc()])
    return rounded(frozen, "score")


@query(f"SELECT query_id, unit_id, asset_id, round(score, 6) AS score, rank FROM ({KNN.format('true', 10)})", "vec_units")
def vector_knn(spark, d):
    return rounded(vectors.knn(vec_units(spark, d), asked(spark, d), 10), "score")


@query(f"SELECT query_id, unit_id, asset_id, round(score, 6) AS score, rank FROM ({KNN.format('true', 10)})", "vec_units")
def vector_knn_all(spark, d):
    """Neighbours of every unit whose id is divisible by 50."""
    return rounded(vectors.knn(vec_units(spark, d), asked(spark, d), 10), "score")


@query(f"SELECT query_id, unit_id, asset_id, round(score, 6) AS score, rank FROM ({KNN.format(NEAR, 3)})", "vec_units", "media")
def vector_knn_prefiltered(spark, d):
    m = media(spark, d)
    near = filters.has_gps() & filters.effective_latitude().between(55, 55.5)
    return rounded(vectors.knn(filters.prefilter(vec_units(spark, d), m, near), asked(spark, d), 3), "score")


@query(f"SELECT query_id, unit_id, asset_id, round(score, 6) AS score, rank FROM ({KNN.format(NEAR, 3)})", "vec_units", "media")
def vector_knn_prefiltered_all(spark, d):
    """Neighbours within a place of every unit whose id is divisible by 50."""
    near = filters.has_gps() & filters.effective_latitude().between(55, 55.5)
    return rounded(vectors.knn(filters.prefilter(vec_units(spark, d), media(spark, d), near), asked(spark, d), 3), "score")


@query("""SELECT 21::BIGINT AS query_id, unit_id, asset_id, round(score, 6) AS score, (row_number() OVER (ORDER BY score DESC, unit_id))::INTEGER AS rank FROM (
  SELECT u.unit_id, u.asset_id, list_dot_product(u.vector, q.vector) AS score FROM vec_units u, (SELECT vector FROM vec_units WHERE unit_id = 21) q WHERE u.asset_id <> 7) QUALIFY rank <= 20""", "vec_units")
def vector_similar(spark, d):
    return rounded(vectors.similar(vec_units(spark, d), 7, 20), "score")


@query("SELECT q.unit_id AS query_id, u.unit_id, round(list_dot_product(u.vector, q.vector), 6) AS score FROM vec_units u, vec_units q WHERE list_dot_product(u.vector, q.vector) >= 0.363", "vec_units")
def vector_match_many(spark, d):
    u = vec_units(spark, d)
    return rounded(vectors.match_many(u, u.select(F.col("unit_id").alias("query_id"), "vector"), 0.363), "score")


@query("""SELECT unit_id, fine, round(list_sum(list_transform(u, lambda x: x * x)), 4) AS one FROM (SELECT unit_id, unit_id % 7 <> 0 AND unit_id % 5 <> 0 AS fine, vector AS u FROM vec_units)""", "vec_units")
def vector_valid(spark, d):
    u = vec_units(spark, d)
    v = F.when(F.col("unit_id") % 7 == 0, F.slice("vector", 1, 10)).when(F.col("unit_id") % 5 == 0, F.transform("vector", lambda x: x * 2)).otherwise(F.col("vector"))
    n = vectors.normalized("vector")
    return u.select("unit_id", vectors.valid_vector(v, 64).alias("fine"), F.round(F.aggregate(n, F.lit(0.0), lambda s, x: s + x * x), 4).alias("one"))


@query("""SELECT asset_id, unit_id, round(s, 6) AS score FROM (SELECT asset_id, unit_id, s, row_number() OVER (PARTITION BY asset_id ORDER BY s DESC, unit_id) AS r FROM (SELECT asset_id, unit_id, vector[1] AS s FROM vec_units)) WHERE r = 1""", "vec_units")
def vector_best_per_asset(spark, d):
    m = vec_units(spark, d).select("asset_id", "unit_id", F.get("vector", 0).cast("double").alias("score"))
    return rounded(vectors.best_per_asset(m), "score")


def stored_index(spark, d) -> VectorIndex:
    """An index of all units but every tenth, and those added as a change, with other vectors of some replaced."""
    units, index = vec_units(spark, d), VectorIndex(spark, shared_dir(spark, "vectors"))
    older = F.when(F.col("unit_id") % 20 == 1, F.reverse("vector")).otherwise(F.col("vector"))
    index.build(units.filter("unit_id % 10 <> 0").withColumn("vector", older))
    index.apply(units.filter("unit_id % 10 = 0 or unit_id % 20 = 1"))
    return index


@query()
def vector_ann_knn(spark, d):
    """Approximate neighbours by a stored index; vector_ann_recall measures them."""
    return stored_index(spark, d).search(asked(spark, d), 20)


@query("SELECT 1::DOUBLE AS recall FROM (SELECT count(*) FROM embeddings)")
def vector_recall_of_exact(spark, d):
    """Blockwise neighbours against all pairs. A unit that the neighbours lack scores above their
    least, so pairs of every query with every unit are scored and those below it aren't written."""
    exact = materialize(vectors.knn(vec_units(spark, d), asked(spark, d), 20))
    least = asked(spark, d).join(exact.filter("rank = 20").select("query_id", F.col("score").alias("least")), "query_id", "left")
    many = vectors.match_many(vec_units(spark, d), least, F.coalesce(F.col("least") - 1e-8, F.lit(float("-inf")))).withColumn("score", F.round("score", 9))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    top = many.withColumn("rank", F.row_number().over(best)).filter("rank <= 20")
    return vectors.ann_recall(top, exact, 20)


@query("SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def vector_ann_recall(spark, d):
    """Whether vector_ann_knn holds nine tenths of the exact neighbours of its queries."""
    found, exact = vector_ann_knn(spark, d), vectors.knn(vec_units(spark, d), asked(spark, d), 20)
    n = found.select("query_id").distinct().agg(F.count("*").alias("n_queries"))
    return n.crossJoin(vectors.ann_recall(found, exact, 20)).select("n_queries", (F.col("recall") >= 0.9).alias("enough"))


@query(f"SELECT query_id, unit_id, asset_id, round(score, 6) AS score, rank FROM ({KNN.format('u.label = 3 AND u.timestamp_ms < 20000', 5)})", "vec_units")
def vector_index_filtered(spark, d):
    """Neighbours among units of one label and early frames: the stored index probes all cells, and the filter reaches its scan."""
    index = stored_index(spark, d)
    found = index.search(asked(spark, d), 5, probes=1 << 20, refine=20, where=(F.col("label") == 3) & (F.col("timestamp_ms") < 20000))
    return rounded(found, "score")


@query(f"SELECT query_id, unit_id, asset_id, round(score, 6) AS score, rank FROM ({KNN.format('true', 1010)}) WHERE rank > 990", "vec_units")
def vector_index_deep_page(spark, d):
    """Ranks 991 to 1010 of every query: beyond rank 1000 the page comes from exact search over the index's rows."""
    return rounded(stored_index(spark, d).page(asked(spark, d), 990, 20), "score")


# ---- people ----
@query("SELECT person, face_id, asset_id, round(score, 6) AS score FROM scores WHERE score >= 0.363", "scores")
def face_match(spark, d):
    return rounded(vectors.face_match(faces(spark, d), examples(spark, d)), "score")


@query("""SELECT DISTINCT a.asset_id, a.unit_id FROM scores a JOIN scores b USING (asset_id, unit_id)
  WHERE a.person = 0 AND b.person = 1 AND a.score >= 0.1 AND b.score >= 0.1 AND a.face_id <> b.face_id""", "scores")
def face_match_people_all(spark, d):
    """Assets with a face of its own for each of two people."""
    f = faces(spark, d)
    known = examples(spark, d).filter("person in (0, 1)")
    hits = vectors.face_match(f, known, 0.1).join(f.select("face_id", "unit_id"), "face_id")
    return people.match_people(hits, 2, "all")


@query("SELECT DISTINCT asset_id, unit_id FROM scores WHERE person IN (0, 1) AND score >= 0.363", "scores")
def face_match_people_any(spark, d):
    f = faces(spark, d)
    hits = vectors.face_match(f, examples(spark, d).filter("person in (0, 1)")).join(f.select("face_id", "unit_id"), "face_id")
    return people.match_people(hits, 2, "any")


@query("SELECT min(doc_id) AS position, doc_id // 2 AS face_id, doc_id // 2 IN (SELECT vec_id FROM embeddings) AS current FROM documents GROUP BY doc_id // 2")
def face_resolve_examples(spark, d):
    ids = table(spark, d, "documents").selectExpr("doc_id as position", "doc_id div 2 as face_id")
    return people.resolve_examples(ids, faces(spark, d))


@query("""SELECT min(id) AS id, 'person ' || min(id) AS name, array_to_string(list(e ORDER BY pos, i), ',') AS examples, (SELECT array_to_string(list_sort(list_distinct(list(r))), ',') FROM (SELECT unnest(rejected) AS r FROM people WHERE id IN (2, 4))) AS rejected, min(cover) AS cover
  FROM (SELECT id, cover, id AS pos, unnest(examples) AS e, generate_subscripts(examples, 1) AS i FROM people WHERE id IN (2, 4))""", "people")
def people_merge(spark, d):
    p = adapters.people(spark, d)
    m = people.merge_people(p, p.filter("id in (2, 4)").select("id", F.col("id").alias("position")))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return m.select("id", "name", text("examples").alias("examples"), text("rejected").alias("rejected"), "cover")


@query("SELECT id, examples[2] AS stay, examples[1] AS move FROM people", "people")
def people_split(spark, d):
    s = people.split_person(adapters.people(spark, d), F.slice("examples", 1, 1))
    return s.select("id", F.get("stay", 0).alias("stay"), F.get("move", 0).alias("move"))


@query("SELECT id, name, len(examples)::INTEGER AS n, examples[1] AS cover FROM people WHERE id % 3 <> 0", "people")
def people_upsert(spark, d):
    p = adapters.people(spark, d).withColumn("name", F.when(F.col("id") % 3 == 0, "  ").otherwise(F.concat(F.lit("  "), F.col("name"), F.lit(" "))))
    p = p.withColumn("examples", F.concat("examples", "examples")).withColumn("cover", F.lit(None).cast("long"))
    return people.upsert_person(p).select("id", "name", F.size("examples").alias("n"), "cover")


POOLS = """SELECT *, row_number() OVER (PARTITION BY person, inside ORDER BY distance, face_id DESC) AS r FROM (SELECT *, score >= 0.363 AS inside, abs(score - 0.363) AS distance FROM scores WHERE score >= 0.28 AND score <= 0.48)"""


@query(f"SELECT person, face_id, asset_id, round(score, 6) AS score, inside, round(distance, 6) AS distance FROM ({POOLS}) WHERE r <= 128", "scores")
def face_boundary_pools(spark, d):
    return rounded(people.boundary_pools(faces(spark, d), examples(spark, d)), "score", "distance")


#: One row after the other, as they are offered: inside ones for three places, outside ones for three more, then any.
PICKED = f""", RECURSIVE pools AS (SELECT p.person, p.face_id, p.asset_id, inside, distance, f.vector FROM ({POOLS}) p JOIN faces f USING (face_id) WHERE r <= 128),
  offered AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY phase, distance, face_id) AS k FROM (
    SELECT *, CASE WHEN inside THEN 1 ELSE 2 END AS phase FROM pools UNION ALL SELECT *, 3 FROM pools)),
  steps AS (SELECT DISTINCT person, 0::BIGINT AS k, 0::BIGINT AS first, []::STRUCT(face_id BIGINT, asset_id BIGINT, inside BOOLEAN, distance DOUBLE, vector DOUBLE[])[] AS chosen FROM offered
    UNION ALL SELECT person, k, CASE WHEN phase = 1 THEN len(taken) ELSE first END, taken FROM (
      SELECT o.person, o.k, o.phase, s.first, CASE WHEN len(s.chosen) < CASE o.phase WHEN 1 THEN 3 WHEN 2 THEN s.first + 3 ELSE 6 END
          AND len(list_filter(s.chosen, lambda c: c.asset_id = o.asset_id OR list_dot_product(c.vector, o.vector) > 0.95)) = 0
        THEN list_append(s.chosen, {{'face_id': o.face_id, 'asset_id': o.asset_id, 'inside': o.inside, 'distance': o.distance, 'vector': o.vector}}) ELSE s.chosen END AS taken
      FROM steps s JOIN offered o ON o.person = s.person AND o.k = s.k + 1))
  SELECT person, c.face_id AS face_id, c.asset_id AS asset_id, c.inside AS inside, round(c.distance, 6) AS distance, (row_number() OVER (PARTITION BY person ORDER BY NOT c.inside, c.distance, c.face_id) - 1)::INTEGER AS place
  FROM (SELECT person, unnest(chosen) AS c FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY person ORDER BY k DESC) = 1))"""


@query(PICKED, "scores")
def face_diverse_pick(spark, d):
    """Suggestions to review, six a person."""
    f = faces(spark, d)
    pools = people.boundary_pools(f, examples(spark, d)).join(f.select("face_id", "vector"), "face_id")
    return people.diverse_pick(pools).withColumn("distance", F.round("distance", 6))


@query("""SELECT asset_id, unit_id, round(max(score), 6) AS score FROM scores WHERE person IN (0, 1, 2) AND score >= 0.363 AND (person, face_id) NOT IN (SELECT person, face_id FROM ranked_faces WHERE r = 3) GROUP BY ALL""", "scores", "ranked_faces")
def face_search(spark, d):
    own = "person in (0, 1, 2)"
    return rounded(people.face_search(faces(spark, d), examples(spark, d).filter(own), examples(spark, d, "r = 3"), 3, "any"), "score")


@query("""WITH RECURSIVE b AS (SELECT vec_id // 8 AS image_id, vec_id AS box_id, embedding[1]::DOUBLE AS score, (vec_id * 7 % 40)::DOUBLE / 100 AS x, (vec_id * 11 % 40)::DOUBLE / 100 AS y,
    row_number() OVER (PARTITION BY vec_id // 8 ORDER BY embedding[1] DESC, vec_id) AS k FROM embeddings),
  s AS (SELECT DISTINCT image_id, 0::BIGINT AS k, NULL::BIGINT AS box_id, NULL::DOUBLE AS score, []::STRUCT(x DOUBLE, y DOUBLE, a DOUBLE)[] AS kept FROM b
    UNION ALL SELECT image_id, k, CASE WHEN free THEN box_id END, score, CASE WHEN free THEN list_append(kept, {'x': x, 'y': y, 'a': 0.16::DOUBLE}) ELSE kept END FROM (
      SELECT b.*, s.kept, len(list_filter(list_transform(s.kept, lambda o: greatest(0, least(o.x, b.x) + 0.4 - greatest(o.x, b.x)) * greatest(0, least(o.y, b.y) + 0.4 - greatest(o.y, b.y))), lambda i: i / (0.32 - i) > 0.3)) = 0 AS free
      FROM s JOIN b ON b.image_id = s.image_id AND b.k = s.k + 1))
  SELECT image_id, box_id, score FROM s WHERE box_id IS NOT NULL""")
def face_non_maximum(spark, d):
    """Boxes without those that overlap better ones."""
    e = table(spark, d, "embeddings")
    corner = lambda i: (F.col("vec_id") * (7 + i) % 40).cast("double") / 100
    boxes = e.select(F.expr("vec_id div 8").alias("image_id"), F.col("vec_id").alias("box_id"), F.get("embedding", 0).cast("double").alias("score"), F.array(corner(0), corner(4), corner(0) + 0.4, corner(4) + 0.4).alias("box"))
    return people.non_maximum(boxes)


# ---- text ----
QUERY_TEXTS = (("0", "the quality of thanedble"), ("1", "que ciónes, los"), ("2", "license password"))
BM25 = """(WITH docs AS (SELECT doc_id AS unit_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS tokens FROM documents),
  total AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM docs), flat AS (SELECT unit_id, len(tokens) AS length, unnest(tokens) AS term FROM docs),
  terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(q), '[\\p{L}\\p{N}_]+')) AS term FROM (VALUES (0, 'the quality of thanedble'), (1, 'que ciónes, los'), (2, 'license password')) v(query_id, q)),
  tf AS (SELECT unit_id, length, term, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM terms) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
  SELECT query_id, unit_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM tf JOIN df USING (term) JOIN terms USING (term), total GROUP BY ALL)"""


def text_queries(spark, d):
    q = F.explode(F.array(*[F.struct(F.lit(int(i)).alias("query_id"), F.lit(t).alias("q")) for i, t in QUERY_TEXTS]))
    return table(spark, d, "region").limit(1).select(q.alias("x")).select("x.*")


def searchable(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.col("text").alias("search_text"))


@query(f"SELECT query_id, unit_id, round(score, 6) AS score FROM {BM25}")
def text_bm25(spark, d):
    return rounded(search.bm25(searchable(spark, d), text_queries(spark, d)), "score").select("query_id", "unit_id", "score")


INDEXED = """(WITH docs AS (SELECT doc_id AS unit_id, regexp_extract_all(lower(coalesce(text, '') || ' ' || CASE doc_id % 4 WHEN 0 THEN 'Красивая дача летом' WHEN 1 THEN 'красивые дачи' WHEN 2 THEN 'на даче лето' ELSE '' END), '[\\p{L}\\p{N}_]+') AS tokens FROM documents WHERE doc_id % 17 <> 0),
  total AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM docs), flat AS (SELECT unit_id, length, CASE word WHEN 'дача' THEN 'дач' WHEN 'дачи' THEN 'дач' WHEN 'даче' THEN 'дач' WHEN 'летом' THEN 'лет' WHEN 'лето' THEN 'лет' WHEN 'красивая' THEN 'красив' WHEN 'красивые' THEN 'красив' ELSE word END AS term FROM (SELECT unit_id, len(tokens) AS length, unnest(tokens) AS word FROM docs)),
  terms AS (SELECT unnest([0, 0, 1, 1, 1, 2, 2]) AS query_id, unnest(['красив', 'дач', 'the', 'quality', 'лет', 'license', 'password']) AS term),
  tf AS (SELECT unit_id, length, term, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM terms) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
  SELECT query_id, unit_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM tf JOIN df USING (term) JOIN terms USING (term), total GROUP BY ALL)"""


def text_index(spark, d):
    """(index, queries): documents with Russian words, written in two batches, the second of which
    replaces texts of the first and deletes every seventeenth."""
    docs = table(spark, d, "documents")
    more = F.expr("case doc_id % 4 when 0 then 'Красивая дача летом' when 1 then 'красивые дачи' when 2 then 'на даче лето' else '' end")
    units = docs.select(F.col("doc_id").alias("unit_id"), F.concat_ws(" ", F.coalesce("text", F.lit("")), more).alias("search_text"))
    index = TextIndex(spark, shared_dir(spark, "texts"))
    older = F.when(F.col("unit_id") % 10 == 1, F.lit("the older text")).otherwise(F.col("search_text"))
    index.apply(units.filter("unit_id % 3 <> 0").withColumn("search_text", older), batch=0)
    index.apply(units.filter("unit_id % 17 <> 0 and (unit_id % 3 = 0 or unit_id % 10 = 1)"), units.filter("unit_id % 17 = 0").select("unit_id"), batch=1)
    queries = F.explode(F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(t).alias("q")) for i, t in enumerate(("красивых дач", "the quality летом", "license password"))]))
    return index, table(spark, d, "region").limit(1).select(queries.alias("x")).select("x.*")


@query(f"SELECT query_id, unit_id, round(score, 6) AS score FROM {INDEXED}")
def text_index_bm25(spark, d):
    """Texts found by words and Russian stems through the stored inverted table."""
    index, queries = text_index(spark, d)
    return rounded(index.search(queries), "score").select("query_id", "unit_id", "score")


@query(f"SELECT query_id, unit_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id))::INTEGER AS rank FROM {INDEXED} QUALIFY rank <= 20")
def text_index_top(spark, d):
    """The first 20 of each query; blocks of postings that can't reach them stay packed."""
    index, queries = text_index(spark, d)
    return rounded(index.search(queries, 20), "score").select("query_id", "unit_id", "score", "rank")


RRF = """SELECT asset_id, page, round(score, 9) AS score FROM (SELECT asset_id, page, sum(weight / (60 + r)) AS score, row_number() OVER (PARTITION BY asset_id ORDER BY page) AS k
  FROM (SELECT stream, asset_id, r // 200 AS page, min(r) AS r, any_value(weight) AS weight FROM ({0}) GROUP BY stream, asset_id, r // 200) GROUP BY asset_id, page) WHERE k = 1"""
STREAMS = """SELECT 'v' AS stream, 1.0::DOUBLE AS weight, doc_id AS r, doc_id // 2 AS asset_id FROM documents UNION ALL SELECT 'n', 2.0, doc_id, doc_id // 3 FROM documents"""


@query(f"SELECT asset_id, page, score, (row_number() OVER (ORDER BY page, score DESC, asset_id) - 1)::BIGINT AS ordinal FROM ({RRF.format(STREAMS)})")
def search_fuse_rrf(spark, d):
    docs = table(spark, d, "documents")
    a = docs.selectExpr("'v' as stream", "1.0d as weight", "doc_id as r", "doc_id div 2 as asset_id")
    b = docs.selectExpr("'n' as stream", "2.0d as weight", "doc_id as r", "doc_id div 3 as asset_id")
    return search.fuse_rrf(a.unionByName(b)).select("asset_id", "page", "score", "ordinal")


@query("""SELECT asset_id, (list(unit_id ORDER BY stream, r))[1] AS unit_id, array_to_string(list_sort(list(DISTINCT unit_id)), ',') AS units FROM (
  SELECT unit_id // 3 AS asset_id, unit_id, CASE WHEN unit_id % 2 = 0 THEN 0 ELSE 1 END AS stream, unit_id * 11 % 500 AS r FROM vec_units) GROUP BY 1""", "vec_units")
def search_matched_unit(spark, d):
    hits = vec_units(spark, d).selectExpr("asset_id", "unit_id", "case when unit_id % 2 = 0 then 0 else 1 end as stream", "unit_id * 11 % 500 as r")
    return search.matched_unit(hits).withColumn("units", F.array_join(F.transform("units", lambda x: x.cast("string")), ","))


@query("SELECT asset_id, unit_id, timestamp_ms, (row_number() OVER (PARTITION BY asset_id ORDER BY timestamp_ms, unit_id) - 1)::INTEGER AS place, count(*) OVER (PARTITION BY asset_id) AS n FROM clips QUALIFY place < 12", "clips")
def search_moments(spark, d):
    return search.moments(clips(spark, d).select("asset_id", "unit_id", "timestamp_ms"))


@query("""SELECT unit_id, asset_id, round(score, 6) AS score, (row_number() OVER (ORDER BY score DESC, unit_id))::INTEGER AS rank FROM (SELECT u.unit_id, u.asset_id, round(list_dot_product(u.vector, q.vector), 9) AS score FROM vec_units u, (SELECT vector FROM vec_units WHERE unit_id = 50) q)""", "vec_units")
def search_place_stream(spark, d):
    return rounded(ranked_by_vector(vec_units(spark, d), spark, d), "score").select("unit_id", "asset_id", "score", (F.col("r") + 1).cast("int").alias("rank"))


def ranked_by_vector(units, spark, d, of: int = 50):
    """All units ranked by their likeness to one, with positions r from 0."""
    own = vec_units(spark, d).filter(F.col("unit_id") == of).limit(1).select(F.col("vector").alias("q"))
    scored = units.join(F.broadcast(own), how="cross").withColumn("score", F.round(vectors.dot("vector", "q"), 9)).drop("vector", "q")
    return ordering.with_ordinal(scored, [F.col("score").desc(), F.col("unit_id").asc()], "r")


VISUAL = """SELECT '{0}' AS stream, 1.0::DOUBLE AS weight, (row_number() OVER (ORDER BY score DESC, unit_id) - 1)::BIGINT AS r, unit_id AS asset_id FROM (
    SELECT u.unit_id, round(list_dot_product(u.vector, q.vector), 9) AS score FROM vec_units u, (SELECT vector FROM vec_units WHERE unit_id = 50) q) WHERE unit_id IN (SELECT id FROM {1})"""
HYBRID = f"""{VISUAL.format("visual", "ready")} UNION ALL {VISUAL.format("place", "ready WHERE geo_text <> ''")}
  UNION ALL SELECT 'text', 1.0, (row_number() OVER (ORDER BY score DESC, unit_id) - 1)::BIGINT, unit_id FROM {BM25} WHERE query_id = 0 AND unit_id IN (SELECT id FROM ready)
  UNION ALL SELECT 'name', 2.0, (row_number() OVER (ORDER BY id) - 1)::BIGINT, id FROM ready WHERE contains(filename, 'IMG_12') OR contains(relative_path, 'IMG_12')"""


@query(f"SELECT asset_id, page, score, (row_number() OVER (ORDER BY page, score DESC, asset_id) - 1)::BIGINT AS ordinal FROM ({RRF.format(HYBRID)})", "vec_units", "media", "ready")
def search_hybrid(spark, d):
    """Whole visual, place, text and name streams of browsable assets, fused."""
    m = media(spark, d).filter(filters.Filters().condition())  # filtered before anything is ranked
    allowed, located = m.select(F.col("id").alias("asset_id")), m.filter("geo_text <> ''").select(F.col("id").alias("asset_id"))
    units = vec_units(spark, d).withColumn("asset_id", F.col("unit_id")).join(allowed, "asset_id", "left_semi")
    visual = ranked_by_vector(units, spark, d).select("r", "asset_id")
    place = ranked_by_vector(units.join(located, "asset_id", "left_semi"), spark, d).select("r", "asset_id")
    hits = search.bm25(searchable(spark, d), text_queries(spark, d).filter("query_id = 0")).select(F.col("unit_id").alias("asset_id"), "score").join(allowed, "asset_id", "left_semi")
    text = ordering.with_ordinal(hits, [F.col("score").desc(), F.col("asset_id").asc()], "r")
    names = ordering.with_ordinal(m.filter(filters.literal_name("IMG_12")).select(F.col("id").alias("asset_id")), [F.col("asset_id").asc()], "r")
    return search.hybrid_search(visual, place, text, names).select("asset_id", "page", "score", "ordinal")


CHECKED = """WITH h AS (SELECT unit_id AS asset_id, (row_number() OVER (ORDER BY score DESC, unit_id) - 1)::BIGINT AS ordinal FROM (
    SELECT u.unit_id, round(list_dot_product(u.vector, q.vector), 9) AS score FROM vec_units u, (SELECT vector FROM vec_units WHERE unit_id = 50) q) WHERE unit_id IN (SELECT id FROM media WHERE present AND id % 8 <> 5)),
  v AS (SELECT *, CASE WHEN asset_id % 5 = 0 THEN 'no' WHEN asset_id % 3 = 0 OR asset_id % 7 = 0 THEN 'uncertain' ELSE 'yes' END AS verdict FROM h),
  p AS (SELECT *, (row_number() OVER (ORDER BY ordinal) - 1)::BIGINT AS place FROM v WHERE verdict = 'yes' QUALIFY place < 60),
  e AS (SELECT CASE WHEN (SELECT count(*) FROM p) = 60 THEN (SELECT max(ordinal) FROM p) ELSE (SELECT max(ordinal) FROM h) END // 40 AS last)
  SELECT asset_id, ordinal, verdict, place, (SELECT count(*) FROM v, e WHERE ordinal // 40 <= last AND asset_id % 4 <> 0) AS asked FROM p"""


@query(" " + CHECKED.replace("WITH h AS", ", h AS", 1).lstrip(), "vec_units", "media")
def search_verified_page(spark, d):
    """The first 60 hits that meet three conditions: checked by rank, 40 at a time, until the page is
    full; a quarter of the verdicts is in the cache and every eighth hit is of an older version."""
    m = media(spark, d)
    ranked = ranked_by_vector(vec_units(spark, d), spark, d)
    hits = ranked.select(F.col("unit_id").alias("asset_id"), F.expr("cast(case when unit_id % 8 = 5 then 0 else 1 end as bigint)").alias("file_version"), F.concat(F.col("unit_id").cast("string"), F.lit(":photo")).alias("unit_id"), "r")
    conditions = ["c3", "c5", "c7"]
    odd = {"c3": "uncertain", "c5": "no", "c7": "uncertain"}
    known = hits.filter("asset_id % 4 = 0").withColumns({"model_version": F.lit("verify-1"), "conditions": F.array(*map(F.lit, conditions))})
    verdict = F.expr("case when asset_id % 5 = 0 then 'no' when asset_id % 3 = 0 or asset_id % 7 = 0 then 'uncertain' else 'yes' end")

    def load():
        return lambda asset, conditions: [(c, odd[c] if asset % int(c[1:]) == 0 else "yes") for c in conditions]

    found = verified.VerifiedSearch(hits, m, [F.col("r").asc()], conditions, known.select(verdict_key().alias("cache_key"), verdict.alias("verdict")), load)
    page = found.page(0, 60)
    return page.withColumn("asked", F.lit(found.counts()["asked"]).cast("long"))


@query("SELECT doc_id, concat_ws(' ', lang, source, lang || ' ' || source) AS search_text FROM documents")
def search_text_column(spark, d):
    docs = table(spark, d, "documents").withColumn("objects", F.array("lang", "source"))
    return docs.select("doc_id", search_text("lang", "source", arrays=("objects",)).alias("search_text"))
