"""Queries of the engine over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text, vectors
from .operators import items as ops
from .operators import keys, text_search, vector_search
from .operators.ranking import Params, enrich, merge_neighbors
from .plans.service import Engine, binding_rows, federate, request, service
from .schema import number
from .sources.items import from_columns, group_runs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(sql: str | None = None):
    def take(f: Query) -> Query:
        QUERIES[f.__name__.lstrip("_")] = f
        if sql is not None:
            ORACLES[f.__name__.lstrip("_")] = sql
        return f

    return take


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Parts as items, p_partkey their id."""
    fields = F.transform(F.array(*columns), lambda v: F.struct(F.lit("text").alias("type"), v.alias("value"), F.lit(None).cast("binary").alias("data"), F.array().cast("array<string>").alias("tags")))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("identifier"), fields.alias("fields"))


def _queries(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "q_id long, query string")


def _hits(df: DataFrame) -> DataFrame:
    return df.select("q_id", "id", vectors.rounded(F.col("score"), 6).alias("score"), "rank")


# -- items

_CONV = "SELECT conv_id, count(*) n FROM conversations GROUP BY 1"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    main = lambda x: F.when(x["role"] == "assistant", F.array(F.lit("main"))).otherwise(F.array().cast("array<string>"))
    fields = F.transform("t", lambda x: F.struct(F.lit("text").alias("type"), x["text"].alias("value"), F.lit(None).cast("binary").alias("data"), main(x).alias("tags")))
    return rows.select(F.col("conv_id").alias("id"), F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("identifier"), fields.alias("fields"))


@_register(f"SELECT count(*)::BIGINT AS items, sum(n)::BIGINT AS total_fields, max(n)::INTEGER AS max_fields, sum(n)::DOUBLE / count(*) AS avg_fields FROM ({_CONV})")
def items_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stats(_conversations(spark, sf_dir))


@_register("SELECT p_partkey AS id, 'part:' || p_partkey AS identifier FROM part WHERE p_partkey IN (3, 17, 150)")
def items_lookup_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("part:3",), ("part:17",), ("part:150",), ("part:none",)], "identifier string")
    return ops.by_identifier(_parts(spark, sf_dir, "p_name"), wanted)


@_register("SELECT p_partkey AS id, p_name AS f0, p_brand AS f1, p_type AS f2, NULL::VARCHAR AS f3, 3 AS fields FROM part")
def items_field_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _parts(spark, sf_dir, "p_name", "p_brand", "p_type")
    return items.select("id", *[ops.value_at(n).alias(f"f{n}") for n in range(4)], F.size("fields").alias("fields"))


@_register("SELECT conv_id AS id, arg_min(text, (turn, text)) FILTER (role = 'assistant') AS main FROM conversations GROUP BY 1")
def items_main_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("id", ops.main_field()["value"].alias("main"))


@_register("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS id, o_orderkey FROM orders")
def items_dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number(_table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").select("id", "o_orderkey")


@_register("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, doc_id::VARCHAR AS identifier, md5(text) AS text, source FROM documents")
def items_from_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = from_columns(_table(spark, sf_dir, "documents"), "doc_id", "text", "source", order="doc_id")
    return items.select("id", "identifier", F.md5(F.col("fields")[0]["value"]).alias("text"), F.col("fields")[1]["value"].alias("source"))


@_register("SELECT DISTINCT p_partkey AS id, 'part:' || p_partkey AS identifier FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity >= 50")
def items_lookup_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("id"))
    return ops.by_id(_parts(spark, sf_dir, "p_name"), wanted).select("id", "identifier")


@_register("SELECT conv_id AS id, count(*) FILTER (role = 'assistant')::INTEGER AS tagged, count(*)::INTEGER AS texts FROM conversations GROUP BY 1")
def items_types_and_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda test: F.size(F.filter("fields", test))
    return _conversations(spark, sf_dir).select("id", count(lambda f: ops.has_tag(f, "main")).alias("tagged"), count(lambda f: ops.has_type(f, "text")).alias("texts"))


_RUNS = "WITH t AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM events)"


@_register(_RUNS + " SELECT min(event_id) AS first_event, event_type, count(*)::INTEGER AS n FROM t GROUP BY event_type, run")
def items_consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("event_type").alias("identifier"), F.col("event_id").alias("ordinal"), F.struct(F.lit("text").alias("type"), F.col("event_id").cast("string").alias("value")).alias("field"))
    return group_runs(rows).select(F.col("ordinal").alias("first_event"), F.col("identifier").alias("event_type"), F.size("fields").alias("n"))


@_register("SELECT url AS identifier, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1")
def items_duplicate_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").groupBy(F.col("url").alias("identifier")).agg(F.count("*").alias("n")).where("n > 1")


@_register("SELECT p_partkey AS id, i.i::INTEGER AS field_idx, [p_name, p_brand, p_type][i.i + 1] AS value FROM part, range(3) i(i)")
def items_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fields(_parts(spark, sf_dir, "p_name", "p_brand", "p_type")).select("id", "field_idx", "value")


@_register("SELECT doc_id, n FROM (SELECT doc_id, count(*) OVER (PARTITION BY quality) AS n FROM labels WHERE toxic = 0)")
def items_allow_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    clean = labels.where("toxic = 0")
    return clean.join(F.broadcast(clean.groupBy("quality").agg(F.count("*").alias("n"))), "quality").select("doc_id", "n")


# -- words

_TRIM = r"""regexp_replace(regexp_replace(w, '[!-/:-@\[-`{-~]+$', ''), '^[!-/:-@\[-`{-~]+', '')"""


@_register(f"""WITH w AS (SELECT p_partkey AS id, i, list_filter(regexp_split_to_array(lower(p_name || ' (' || p_type || '): ' || p_brand || '/#'), '\\s+'), lambda x: x <> '') AS ws FROM (SELECT *, 0 AS i FROM part)),
u AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS o FROM w), t AS (SELECT id, o, CASE WHEN {_TRIM} = '' THEN w ELSE {_TRIM} END AS w FROM u)
SELECT id, string_agg(p, ' ' ORDER BY o, k) AS normalized FROM (SELECT id, o, unnest(regexp_split_to_array(w, '[:/()\\[\\]]')) AS p, generate_subscripts(regexp_split_to_array(w, '[:/()\\[\\]]'), 1) AS k FROM t) WHERE p <> '' GROUP BY id""")
def normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(" ("), "p_type", F.lit("): "), "p_brand", F.lit("/#"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.normalize(raw).alias("normalized"))


_TOK = "SELECT p_partkey AS id, unnest(string_split(lower(p_name), ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part"
_POST = f"SELECT id, word, row_number() OVER (PARTITION BY id, word ORDER BY pos) - 1 AS occ, count(*) OVER (PARTITION BY id) AS len FROM ({_TOK})"


@_register(f"SELECT word, id, 0::INTEGER AS field_idx, occ AS occurrence, len::INTEGER AS length FROM ({_POST})")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_search.postings(_parts(spark, sf_dir, "p_name")).drop("pos")


@_register(f"SELECT word, count(DISTINCT id) AS df FROM ({_TOK}) GROUP BY 1")
def vocab_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_search.build(_parts(spark, sf_dir, "p_name")).vocabulary


@_register(f"SELECT id, count(*)::INTEGER AS length FROM ({_TOK}) GROUP BY 1")
def field_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "p_name").select("id", F.size(text.tokens(F.col("fields")[0]["value"])).alias("length"))


# -- keyword and fuzzy search


def _assigned(queries: list[str], join: str, weight: str, allow: str = "", least: str = "", k: int = 10, most: int | None = None, source: str = "SELECT p_partkey AS id, 0 AS f, p_name AS v FROM part") -> str:
    """SQL of an assignment search with queries of one or two words."""
    values = ", ".join(f"({i}, '{q}')" for i, q in enumerate(queries))
    return f"""WITH q(q_id, query) AS (VALUES {values}),
kw AS (SELECT q_id, kw, row_number() OVER (PARTITION BY q_id ORDER BY o) - 1 AS kwi, count(*) OVER (PARTITION BY q_id) AS n FROM (SELECT q_id, unnest(string_split(query, ' ')) AS kw, generate_subscripts(string_split(query, ' '), 1) AS o FROM q)),
src AS ({source}),
tok AS (SELECT id, f, word, row_number() OVER (PARTITION BY id, f, word ORDER BY pos) - 1 AS occ, count(*) OVER (PARTITION BY id, f) AS len FROM (SELECT id, f, unnest(string_split(lower(v), ' ')) AS word, generate_subscripts(string_split(v, ' '), 1) AS pos FROM src) {allow}),
r AS (SELECT q_id, id, f, word, occ, len, n, max(CASE WHEN kwi = 0 THEN w END) AS w0, max(CASE WHEN kwi = 1 THEN w END) AS w1 FROM (SELECT k.q_id, t.*, k.kwi, k.n, {weight} AS w FROM tok t JOIN kw k ON {join}) GROUP BY ALL),
a AS (SELECT q_id, id, f, max(n) AS n, max(len) AS len, count(*) AS m, max(greatest(coalesce(w0, 0), coalesce(w1, 0))) AS a1 FROM r GROUP BY 1, 2, 3),
p AS (SELECT x.q_id, x.id, x.f, max(x.w0 + y.w1) AS a2 FROM r x JOIN r y ON x.q_id = y.q_id AND x.id = y.id AND x.f = y.f AND (x.word, x.occ) <> (y.word, y.occ) GROUP BY 1, 2, 3),
s AS (SELECT a.q_id, a.id, a.f, CAST(greatest(a1, coalesce(a2, 0)) - 0.5 * (n - least(n, m)) - 0.25 * greatest(0, len - least(n, m) - (n - least(n, m))) AS DOUBLE) AS score FROM a LEFT JOIN p USING (q_id, id, f)),
c AS (SELECT * FROM s {f"QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id, f DESC) <= {most}" if most else ""}),
b AS (SELECT q_id, id, score, f FROM c {least} QUALIFY row_number() OVER (PARTITION BY q_id, id ORDER BY score DESC, f) = 1)
SELECT q_id::BIGINT AS q_id, id, score, f::INTEGER AS field_idx, (row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id))::INTEGER AS rank FROM b QUALIFY rank <= {k}"""


def _prefix(queries: list[str], **more) -> str:
    return _assigned(queries, "starts_with(t.word, k.kw)", "CASE WHEN t.word = k.kw THEN 1.0 ELSE 0.75 END", **more)


_D = "levenshtein(t.word, k.kw)"


def _near(queries: list[str], **more) -> str:
    return _assigned(queries, f"{_D} <= (length(k.kw) - 1) // 2", f"CASE {_D} WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 ELSE 0.25 END", **more)


_CHEAP = "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY'"
_SHAPE = ["q_id", "id", "score", "field_idx", "rank"]
_ONE, _TWO, _NEAR1, _NEAR2 = ["wid", "blue", "ro", "gizmo"], ["blue wid", "red ro", "wid gear", "cold cold"], ["bold", "rod", "gizmos", "plate"], ["blue wigdet", "rod red", "smal ring"]


def _search(spark: SparkSession, sf_dir: str, queries: list[str], params: Params, find=text_search.keyword, allow: str | None = None, columns: tuple[str, ...] = ("p_name",)) -> DataFrame:
    items = _parts(spark, sf_dir, *columns)
    few = _table(spark, sf_dir, "part").where(allow).select(F.col("p_partkey").alias("id")) if allow else None
    return find(text_search.build(items), _queries(spark, *queries), params, few).select(*_SHAPE)


@_register(_prefix(_ONE))
def keyword_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, _ONE, Params(exact=True))


@_register(_prefix(_ONE, allow=f"WHERE id IN ({_CHEAP})"))
def keyword_single_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, _ONE, Params(exact=True), allow="p_type = 'ECONOMY'")


@_register(_prefix(_TWO, least="WHERE score >= 1.0"))
def keyword_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, _TWO, Params(exact=True, min_score=1.0))


@_register(_prefix(_TWO))
def keyword_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, _TWO, Params(exact=True))


@_register(_prefix(_TWO, k=100))
def keyword_hundred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, _TWO, Params(k=100, exact=True))


@_register(_prefix(["blue wid", "brand#1 ring", "standard"], source="SELECT p_partkey AS id, i.i AS f, replace([p_name, p_brand, p_type][i.i + 1], '/', ' ') AS v FROM part, range(3) i(i)"))
def keyword_multi_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, ["blue wid", "brand#1 ring", "standard"], Params(exact=True), columns=("p_name", "p_brand", "p_type"))


_THREE = "SELECT p_partkey AS id, i.i AS f, replace([p_name, p_brand, p_type][i.i + 1], '/', ' ') AS v FROM part, range(3) i(i)"


@_register(_prefix(["blue wid", "economy", "brand#1"], source=_THREE, most=30))
def keyword_inexact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not exact: the best k * (fields of an item on average) fields are candidates, in order of score, item and last field."""
    return _search(spark, sf_dir, ["blue wid", "economy", "brand#1"], Params(), columns=("p_name", "p_brand", "p_type"))


@_register(_near(_NEAR1))
def fuzzy_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, _NEAR1, Params(exact=True), text_search.fuzzy)


@_register(_near(_NEAR2))
def fuzzy_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, _NEAR2, Params(exact=True), text_search.fuzzy)


@_register(_near(_NEAR2, allow=f"WHERE id IN ({_CHEAP})", k=100))
def fuzzy_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, _NEAR2, Params(k=100, exact=True), text_search.fuzzy, allow="p_type = 'ECONOMY'")


@_register(f"SELECT h.q_id, h.id, h.score, h.rank, 'part:' || h.id AS identifier, p.p_name AS field FROM ({_prefix(_TWO)}) h JOIN part p ON p.p_partkey = h.id")
def enrich_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _parts(spark, sf_dir, "p_name")
    hits = text_search.keyword(text_search.build(items), _queries(spark, *_TWO), Params(exact=True))
    return enrich(hits, items).select("q_id", "id", "score", "rank", "identifier", "field")


# -- full text


def _bm25(allow: str = "") -> str:
    return f"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY 1),
st AS (SELECT count(*) AS n, avg(dl) AS av FROM dl), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1), q(q_id, w) AS (VALUES (0, 'the'), (0, 'than'), (1, 'license'), (1, 'version'), (2, 'token'), (2, 'password'), (2, 'der')),
s AS (SELECT q_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score FROM q JOIN tf USING (w) JOIN df USING (w) JOIN dl USING (doc_id), st {allow} GROUP BY 1, 2)
SELECT q_id::BIGINT AS q_id, doc_id AS id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, doc_id) <= 10"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.struct(F.lit("text").alias("type"), F.col("text").alias("value"), F.lit(None).cast("binary").alias("data"), F.array().cast("array<string>").alias("tags"))
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("identifier"), F.array(field).alias("fields"))


def _full_text(spark: SparkSession, sf_dir: str, allow: DataFrame | None = None) -> DataFrame:
    index = text_search.build(_documents(spark, sf_dir), text.plain_tokens)
    hits = text_search.full_text(index, _queries(spark, "the than", "License, version", "token password der"), Params(exact=True, k=10), allow)
    return hits.select("q_id", "id", F.round("score", 6).alias("score"))


@_register(_bm25())
def fulltext_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full_text(spark, sf_dir)


@_register(_bm25("WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)"))
def fulltext_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full_text(spark, sf_dir, _table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").alias("id")))


_SIGNED = ["released +license -version", '"the mit license"', '+"mit license" the', 'license -"mit license"', "-license the than", 'token +"=" password', "-the"]


def _signed(queries: list[str], k: int = 10) -> str:
    """SQL of full-text search with signs and phrases of up to three words."""
    rows = [(q, cl, sign, words) for q, text in enumerate(queries) for cl, (sign, words) in enumerate(text_search.parse_clauses(text))]
    values = ", ".join(f"({q}, {cl}, {sign}, {words!r}, {len(words)})" for q, cl, sign, words in rows)
    return f"""WITH tok AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS x FROM documents))),
dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS av FROM dl), df AS (SELECT w, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1),
c(q_id, cl, sign, ws, size) AS (VALUES {values}),
idf AS (SELECT q_id, cl, sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS w FROM (SELECT q_id, cl, unnest(ws) AS w FROM c) u JOIN df USING (w), st GROUP BY 1, 2),
next AS (SELECT doc_id, w, lead(w, 1) OVER t AS w2, lead(w, 2) OVER t AS w3 FROM tok WINDOW t AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT q_id, cl, sign, doc_id, count(*) AS tf FROM c JOIN next ON w = ws[1] AND (size < 2 OR w2 = ws[2]) AND (size < 3 OR w3 = ws[3]) GROUP BY ALL),
s AS (SELECT q_id, doc_id, sum(CASE WHEN sign >= 0 THEN idf.w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)) END) AS score, count(*) FILTER (sign = 1) AS have, min(sign) AS least FROM m JOIN idf USING (q_id, cl) JOIN dl USING (doc_id), st GROUP BY 1, 2)
SELECT q_id::BIGINT AS q_id, doc_id AS id, round(score, 6) AS score FROM s JOIN (SELECT q_id, count(*) FILTER (sign = 1) AS needed FROM c GROUP BY 1) USING (q_id) WHERE have = needed AND least >= 0
QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, doc_id) <= {k}"""


@_register(_signed(_SIGNED))
def fulltext_signs_and_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = text_search.build(_documents(spark, sf_dir), text.plain_tokens)
    return text_search.full_text(index, _queries(spark, *_SIGNED), Params(exact=True, k=10)).select("q_id", "id", F.round("score", 6).alias("score"))


# -- vectors

#: Queries of the searches: every vector whose id is divisible by 20, against all.
_VEC = "SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings"
_QV = "SELECT vec_id AS q_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0"
_SIGN = "list_transform({0}, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"
_SCORE = {
    "cosine-normalized": "list_inner_product(q, e)",
    "cosine": "list_cosine_similarity(q, e)",
    "inner-product": "list_inner_product(q, e) - 1",
    "l2": "1 / (1 + list_distance(q, e) * list_distance(q, e))",
    "hamming": f"1 - (list_sum(list_transform(list_zip({_SIGN.format('q')}, {_SIGN.format('e')}), lambda z: abs(z[1] - z[2]))) / 64.0)::DOUBLE",
}


def _nearest(score: str, where: str = "", least: str = "", k: int = 10) -> str:
    return f"SELECT q_id, id, round(score, 6) AS score, (row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, id))::INTEGER AS rank FROM (SELECT q_id, id, {score} AS score FROM ({_QV}) a, ({_VEC}) b {where}) {least} QUALIFY rank <= {k}"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("field_idx"), "embedding")


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), "embedding")


def _vector(metric: str, precision: str = "float32", params: Params = Params(exact=True), allow: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        few = _table(spark, sf_dir, "embeddings").where(allow).select(F.col("vec_id").alias("id")) if allow else None
        return _hits(vector_search.search(vector_search.build(_vectors(spark, sf_dir), metric, precision), _vector_queries(spark, sf_dir), params, few))

    return run


for _name, _metric in (("vec_cosine", "cosine"), ("vec_cosine_norm", "cosine-normalized"), ("vec_ip", "inner-product"), ("vec_l2", "l2")):
    QUERIES[_name], ORACLES[_name] = _vector(_metric), _nearest(_SCORE[_metric])
QUERIES["vec_binary_hamming"], ORACLES["vec_binary_hamming"] = _vector("hamming", "binary"), _nearest(_SCORE["hamming"])
QUERIES["vec_filtered"], ORACLES["vec_filtered"] = _vector("cosine", allow="label = 3"), _nearest(_SCORE["cosine"], "WHERE label = 3")
QUERIES["vec_min_score"], ORACLES["vec_min_score"] = _vector("cosine", params=Params(exact=True, min_score=0.2)), _nearest(_SCORE["cosine"], least="WHERE score >= 0.2")

_LABELED = "SELECT label::BIGINT AS id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS f, embedding::DOUBLE[] AS e FROM embeddings"


def _labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("id"), F.col("vec_id").alias("n"), "embedding")
    from .sources.tensors import keyed

    return keyed(v).withColumnRenamed("pos", "field_idx")


@_register(f"SELECT q_id, id, round(score, 6) AS score, (row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, id))::INTEGER AS rank FROM (SELECT q_id, id, max(list_cosine_similarity(q, e)) AS score FROM ({_QV}) a, ({_LABELED}) b GROUP BY 1, 2) QUALIFY rank <= 4")
def vec_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(vector_search.search(vector_search.build(_labeled(spark, sf_dir), "cosine"), _vector_queries(spark, sf_dir), Params(k=4, exact=True)))


def _near_items(source: str, k: int, where: str = "") -> str:
    return f"""SELECT q_id, id, round(score, 6) AS score, (row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, id))::INTEGER AS rank FROM (
SELECT a.id AS q_id, b.id, max(list_cosine_similarity(a.e, b.e)) AS score FROM ({source}) a, ({source}) b WHERE a.id <> b.id {where} GROUP BY 1, 2) QUALIFY rank <= {k}"""


@_register(_near_items(_LABELED, 5))
def vec_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _labeled(spark, sf_dir)
    return _hits(vector_search.neighbors(vector_search.build(v, "cosine"), v.select("id").distinct(), Params(k=5, exact=True)))


_LARGE = "SELECT label FROM embeddings GROUP BY label HAVING count(*) >= (SELECT count(*) / count(DISTINCT label) FROM embeddings)"


@_register(_near_items(_LABELED, 5, f"AND b.id IN ({_LARGE})"))
def vec_neighbors_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours among the items that have as many vectors as the mean at least."""
    v = _labeled(spark, sf_dir)
    per = v.groupBy("id").agg(F.count("*").alias("n"))
    large = per.join(F.broadcast(per.agg(F.avg("n").alias("mean"))), F.col("n") >= F.col("mean")).select("id")
    return _hits(vector_search.neighbors(vector_search.build(v, "cosine"), v.select("id").distinct(), Params(k=5, exact=True), large))


_UNEVEN = "SELECT floor(log2(vec_id + 1))::BIGINT AS id, embedding::DOUBLE[] AS e FROM embeddings"


@_register(_near_items(_UNEVEN, 3))
def vec_neighbors_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of 1, 2, 4, ... vectors: as many neighbours for each as there are."""
    v = _table(spark, sf_dir, "embeddings").select(F.floor(F.log2(F.col("vec_id") + 1)).cast("long").alias("id"), F.col("vec_id").cast("int").alias("field_idx"), "embedding")
    return _hits(vector_search.neighbors(vector_search.build(v, "cosine"), v.select("id").distinct(), Params(k=3)))


_HAM = f"SELECT q_id, id, q, e, {_SCORE['hamming']} AS h FROM ({_QV}) a, ({_VEC}) b"


@_register(f"""SELECT q_id, id, round(score, 6) AS score, (row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, id))::INTEGER AS rank FROM (
SELECT q_id, id, list_cosine_similarity(q, e) AS score FROM (SELECT * FROM ({_HAM}) QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY h DESC, id) <= 40)) QUALIFY rank <= 10""")
def vec_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector("hamming", "binary", Params(k=10, exact=True, rerank=4.0))(spark, sf_dir)


@_register("SELECT label::BIGINT AS q_id, vec_id AS id, round(max(s), 6) AS score, (row_number() OVER (PARTITION BY label ORDER BY round(max(s), 9) DESC, vec_id))::INTEGER AS rank FROM (SELECT a.label, b.vec_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) GROUP BY label, vec_id QUALIFY rank <= 10")
def merge_neighbor_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("label").cast("long").alias("q_id"), "embedding")
    index = vector_search.build(_vectors(spark, sf_dir), "cosine-normalized")
    return _hits(merge_neighbors(vector_search.scored(index, q, Params(k=200, exact=True)), 10))


@_register("SELECT id, list_transform(t, lambda x: round((x / n)::FLOAT::DOUBLE, 5)) AS v FROM (SELECT vec_id AS id, embedding[:16]::DOUBLE[] AS t, sqrt(list_inner_product(embedding[:16]::DOUBLE[], embedding[:16]::DOUBLE[])) AS n FROM embeddings)")
def vec_truncate_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform(vectors.truncated(F.col("embedding"), 16), lambda x: vectors.rounded(x, 5)).alias("v"))


def vec_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate: SQL can't say which cells are looked at; the tests measure the recall of this very setting."""
    inv = vector_search.invert(vector_search.build(_vectors(spark, sf_dir), "cosine-normalized"))
    return _hits(vector_search.search_inverted(inv, _vector_queries(spark, sf_dir)))


QUERIES["vec_inverted"] = vec_inverted

_INT8 = "list_transform({0}, lambda x: greatest(-127, least(127, round_even(x / sqrt(list_inner_product({0}, {0})) * 127, 0))))"


@_register(f"""SELECT q_id, id, round(score, 6) AS score, (row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, id))::INTEGER AS rank FROM (
SELECT q_id, id, list_cosine_similarity(q, e) AS score FROM (SELECT * FROM (SELECT vec_id AS q_id, embedding::DOUBLE[] AS q, {_INT8.format("embedding::DOUBLE[]")} AS q8 FROM embeddings WHERE vec_id % 20 = 0),
(SELECT vec_id AS id, embedding::DOUBLE[] AS e, {_INT8.format("embedding::DOUBLE[]")} AS e8 FROM embeddings) QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY round(list_cosine_similarity(q8, e8), 12) DESC, id) <= 30)) QUALIFY rank <= 10""")
def vec_int8_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector("cosine", "int8", Params(k=10, exact=True, rerank=3.0))(spark, sf_dir)


#: To the nearest of the numbers with 8 significant bits.
_BF16 = "list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x = 0 THEN x ELSE round_even(x / pow(2, floor(log2(abs(x))) - 7), 0) * pow(2, floor(log2(abs(x))) - 7) END)"


@_register(f"""SELECT q_id, id, round(score, 6) AS score, (row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, id))::INTEGER AS rank FROM (
SELECT q_id, id, list_inner_product(q, e) AS score FROM (SELECT vec_id AS q_id, {_BF16} AS q FROM embeddings WHERE vec_id % 20 = 0), (SELECT vec_id AS id, {_BF16} AS e FROM embeddings)) QUALIFY rank <= 10""")
def vec_bfloat16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector("cosine-normalized", "bfloat16")(spark, sf_dir)


# -- keys

_KEYS = "SELECT DISTINCT split_part(p_name, ' ', 1) AS key FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part UNION SELECT 'r' UNION SELECT 'wid'"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("key")).distinct()
    return words.unionByName(spark.createDataFrame([("r",), ("wid",)], "key string")).withColumn("value", F.length("key"))


@_register(f"SELECT input, key, length(key)::INTEGER AS value, length(key)::INTEGER AS length FROM (VALUES ('widgets'), ('rodeo'), ('xyz')) i(input), ({_KEYS}) k WHERE starts_with(input, key)")
def prefix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.prefix_matches(_keys(spark, sf_dir), spark.createDataFrame([("widgets",), ("rodeo",), ("xyz",)], "input string"))


@_register(f"SELECT key, length(key)::INTEGER AS value FROM ({_KEYS}) WHERE starts_with(key, 'r')")
def prefix_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.continuations(_keys(spark, sf_dir), "r")


@_register(f"SELECT input FROM (VALUES ('wi'), ('ro'), ('xyz'), ('rings')) i(input) WHERE EXISTS (SELECT 1 FROM ({_KEYS}) k WHERE starts_with(key, input))")
def contains_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.contains_prefix(_keys(spark, sf_dir), spark.createDataFrame([("wi",), ("ro",), ("xyz",), ("rings",)], "input string"))


@_register(f"SELECT key, CASE WHEN key IN ('rod', 'zebra') THEN 99 ELSE length(key) END::INTEGER AS value FROM (SELECT key FROM ({_KEYS}) UNION SELECT 'zebra')")
def key_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.upsert(_keys(spark, sf_dir), spark.createDataFrame([("rod", 99), ("zebra", 99)], "key string, value int"))[0]


@_register(f"SELECT key, length(key)::INTEGER AS value FROM ({_KEYS}) WHERE key NOT IN ('rod', 'wid')")
def key_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.delete(_keys(spark, sf_dir), spark.createDataFrame([("rod",), ("wid",)], "key string"))[0]


@_register(f"SELECT input FROM (SELECT DISTINCT lower(p_type) AS input FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part) WHERE input IN ({_KEYS})")
def key_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    inputs = part.select(F.lower("p_type").alias("input")).unionByName(part.select(F.split("p_name", " ")[0].alias("input"))).distinct()
    return keys.contains(_keys(spark, sf_dir), inputs)


@_register(f"SELECT count(*) AS len, count(*) = 0 AS is_empty FROM ({_KEYS})")
def key_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.size(_keys(spark, sf_dir))


# -- requests and federation

_SMALL = "SELECT p_partkey FROM part WHERE p_size <= 25"


@_register(f"SELECT h.q_id, h.id, h.score, h.rank, 'part:' || h.id AS identifier, p.p_name AS field FROM ({_prefix(_ONE, k=7)}) h JOIN part p ON p.p_partkey = h.id")
def request_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _parts(spark, sf_dir, "p_name")
    body = {"queries": [{"type": "value", "value": q} for q in _ONE], "k": 7, "exact": True}
    return request(spark, Engine("parts", "keyword", text_search.build(items), items), body).select("q_id", "id", "score", "rank", "identifier", "field")


@_register(f"SELECT h.rank AS r, h.score AS s, 'part:' || h.id AS i FROM ({_near(['blue wigdet'], k=5)}) h")
def sparql_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _parts(spark, sf_dir, "p_name")
    call = 'PREFIX s: <http://s/> SELECT * WHERE { s:config s:query "blue wigdet" ; . s:config s:rank ?r . s:config s:score ?s . s:config s:identifier ?i . s:config s:k 5 . s:config s:exact true }'
    return service(spark, Engine("parts", "fuzzy", text_search.build(items), items), call.replace(" ; .", " ."), "http://s/")



@_register(f"""SELECT 'row' || id AS row, rank, id, score, 'part:' || id AS identifier, p_name AS field FROM ({_prefix(["blue wid"], allow=f"WHERE id IN ({_SMALL})")}) h JOIN part ON p_partkey = id""")
def qlproxy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _parts(spark, sf_dir, "p_name")
    few = _table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"))
    bindings = items.join(few, "id", "left_semi").select(F.concat(F.lit("row"), F.col("id").cast("string")).alias("row"), F.col("identifier").alias("filter"), F.col("id").alias("ordinal"))
    return federate(Engine("parts", "keyword", text_search.build(items), items), bindings, Params(exact=True), "blue wid")


@_register(f"""WITH h AS (SELECT q_id, id, score, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, id) AS r FROM (
SELECT a.id AS q_id, b.id, max(list_cosine_similarity(a.e, b.e)) AS score FROM ({_LABELED}) a, ({_LABELED}) b WHERE a.id <> b.id GROUP BY 1, 2) QUALIFY r <= 3)
SELECT 'r' || q_id AS row, (row_number() OVER (ORDER BY q_id, r))::INTEGER AS rank, id, round(score, 6) AS score, 'label:' || id AS identifier FROM h""")
def qlproxy_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _labeled(spark, sf_dir)
    items = v.groupBy("id").agg(F.count("*").alias("n")).select("id", F.concat(F.lit("label:"), F.col("id").cast("string")).alias("identifier"), F.expr("transform(sequence(1, cast(n as int)), i -> named_struct('type', 'text', 'value', cast(i as string), 'data', cast(null as binary), 'tags', cast(array() as array<string>)))").alias("fields"))
    name = F.concat(F.lit("label:"), F.col("id").cast("string"))
    bindings = items.select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("row"), F.when(F.col("id") % 2 == 0, name).otherwise(F.concat(F.lit("<"), name, F.lit(">"))).alias("query"), F.col("id").alias("ordinal"))
    hits = federate(Engine("labels", "embedding-with-data", vector_search.build(v, "cosine"), items), bindings, Params(k=3, exact=True))
    return hits.select("row", "rank", "id", F.round("score", 6).alias("score"), "identifier")


_TERM = """'"{0}":{{"type":"literal","value":"' || {1} || '"{2}}}'"""
_XSD = ',"datatype":"http://www.w3.org/2001/XMLSchema#{0}"'
_BINDING = " || ',' || ".join([_TERM.format("rank", "h.rank", _XSD.format("integer")), _TERM.format("id", "h.id", _XSD.format("integer")), _TERM.format("score", "h.score", _XSD.format("float")), """'"identifier":{"type":"uri","value":"part:' || h.id || '"}'""", _TERM.format("field", "p.p_name", "")])


@_register(f"SELECT h.q_id, h.rank, '{{' || {_BINDING} || '}}' AS binding FROM ({_prefix(_TWO)}) h JOIN part p ON p.p_partkey = h.id")
def sparql_json_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _parts(spark, sf_dir, "p_name")
    return binding_rows(enrich(text_search.keyword(text_search.build(items), _queries(spark, *_TWO), Params(exact=True)), items))
