"""The registered queries over the flat tables, each beside the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.functions import text as T
from viewforge.operators import assemble, files, metrics, profile, sampling, tasks, tokens
from viewforge.operators.ranking import first_per_key
from viewforge.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: text.SPACE and text.BREAK as RE2 classes.
SPACE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sql_rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}+$', '')"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({_sql_rstrip(x)}, '^{SPACE}+', '')"


def _sql_loc(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '{BREAK}'), lambda y: regexp_matches(y, '{NOT_SPACE}')))"


def _sql_tokens(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '{SPACE}+'), lambda y: y <> ''))"


def _sql_hash(*parts: str, length: int = 20) -> str:
    return f"substr(sha256(json_array({', '.join(parts)})::VARCHAR), 1, {length})"


def _sql_split(key: str) -> str:
    value = f"('0x' || {_sql_hash(repr('split'), key, length=8)})::BIGINT % 100"
    return f"CASE WHEN {value} < 90 THEN 'train' WHEN {value} < 95 THEN 'validation' ELSE 'test' END"


def _sql_bucket(loc: str) -> str:
    return f"CASE WHEN {loc} <= 10 THEN 'tiny' WHEN {loc} <= 40 THEN 'short' WHEN {loc} <= 120 THEN 'medium' WHEN {loc} <= 250 THEN 'long' ELSE 'huge' END"


#: documents as source files.
_FILES = "f AS (SELECT doc_id AS source_row_index, coalesce(source, '') AS repository_name, 'doc/' || doc_id AS path, coalesce(lang, '') AS language, coalesce(text, '') AS source FROM documents)"
_PROFILE = f"""{_FILES},
c AS (SELECT *, {_sql_rstrip("source")} || chr(10) AS code FROM f),
h AS (SELECT *, {_sql_loc("code")} AS loc, {_sql_hash("repository_name", "path", "code")} AS file_hash FROM c),
p AS (SELECT source_row_index, {_sql_hash("'documents'", "repository_name", "path", "file_hash")} AS file_id,
  {_sql_split("CASE WHEN repository_name <> '' THEN repository_name ELSE path END")} AS split, repository_name, path, language,
  length(code) AS char_len, loc, {_sql_tokens("code")} AS rough_token_len, {_sql_bucket("loc")} AS size_bucket,
  CASE WHEN loc <= 10 THEN 0.35 WHEN loc <= 120 THEN 1.0 WHEN loc <= 250 THEN 0.6 ELSE 0.25 END::DOUBLE AS sampling_weight FROM h)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.as_source_files(table(spark, sf_dir, "documents"))


@query(f"WITH {_PROFILE} SELECT split, size_bucket, count(*) AS files, sum(loc)::BIGINT AS loc, sum(rough_token_len)::BIGINT AS tokens FROM p GROUP BY ALL")
def split_bucket_counts(spark, sf_dir):
    return files.split_bucket_counts(files.file_profile(_files(spark, sf_dir)))


@query(f"WITH {_PROFILE} SELECT * FROM p")
def file_profile(spark, sf_dir):
    return files.file_profile(_files(spark, sf_dir))


_LINES = f"list_filter(string_split_regex({_sql_rstrip('source')} || chr(10), '{BREAK}'), lambda y, i: i < len(string_split_regex({_sql_rstrip('source')} || chr(10), '{BREAK}')))"


@query(f"""WITH {_FILES}, l AS (SELECT source_row_index, path, {_LINES} AS lines FROM f),
w AS (SELECT *, unnest(generate_series(0, len(lines) - 1, 10)) AS s FROM l WHERE len(lines) >= 20),
c AS (SELECT source_row_index, path, (s // 10)::INT AS window_index, (s + 1)::INT AS start_line, least(len(lines), s + 20)::INT AS end_line, {_sql_rstrip("array_to_string(lines[s + 1 : least(len(lines), s + 20)], chr(10))")} || chr(10) AS code FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY source_row_index ORDER BY window_index) AS n FROM c WHERE regexp_matches(code, '{NOT_SPACE}'))
SELECT * EXCLUDE n FROM n WHERE n <= 8""")
def file_windows(spark, sf_dir):
    rows = files.file_windows(_files(spark, sf_dir), window_lines=20, stride=10, most=8)
    return rows.select("source_row_index", "path", "window_index", "start_line", "end_line", "code")


# the operator's and the reference's own windows: 8 of them cover 680 lines
@query(f"""WITH {_FILES}, l AS (SELECT source_row_index, path, {_LINES} AS lines FROM f),
w AS (SELECT *, unnest(generate_series(0, len(lines) - 1, 80)) AS s FROM l WHERE len(lines) >= 120),
c AS (SELECT source_row_index, path, (s // 80)::INT AS window_index, (s + 1)::INT AS start_line, least(len(lines), s + 120)::INT AS end_line, {_sql_rstrip("array_to_string(lines[s + 1 : least(len(lines), s + 120)], chr(10))")} || chr(10) AS code FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY source_row_index ORDER BY window_index) AS n FROM c WHERE regexp_matches(code, '{NOT_SPACE}'))
SELECT * EXCLUDE n FROM n WHERE n <= 8""")
def file_windows_120(spark, sf_dir):
    return files.file_windows(_files(spark, sf_dir)).select("source_row_index", "path", "window_index", "start_line", "end_line", "code")


@query(f"""WITH {_FILES}, l AS (SELECT source_row_index, string_split_regex(source, '{BREAK}') AS x FROM f), m AS (SELECT source_row_index, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS lines FROM l)
SELECT source_row_index, {_sql_rstrip("array_to_string(lines[1 : least(len(lines), 7)], chr(10))")} || chr(10) AS code FROM m""")
def line_windows(spark, sf_dir):
    rows = _files(spark, sf_dir)
    return rows.select("source_row_index", T.line_window(F.col("source"), F.lit(2), F.lit(3), 4).alias("code"))


def _sql_comment(x: str) -> str:
    parts = f"string_split_regex({x}, '{BREAK}')"
    lines = f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"
    return f"array_to_string(list_transform({lines}, lambda y: CASE WHEN y = '' THEN '#' ELSE '# ' || y END), chr(10)) || chr(10)"


@query(f"""WITH {_FILES} SELECT source_row_index,
{_sql_comment("'<imports>'")} || 'import x' || chr(10) || chr(10) || {_sql_comment("'<class>' || chr(10) || " + "repository_name")} || chr(10) || chr(10) || {_sql_comment("'<focal>'")} || {_sql_rstrip("source")} || chr(10) AS code FROM f""")
def comment_context(spark, sf_dir):
    rows = _files(spark, sf_dir)
    code = T.contextualize(F.col("source"), F.lit("import x"), F.col("repository_name"), F.lit(" "), F.lit("python"))
    return rows.select("source_row_index", code.alias("code"))


@query(f"WITH {_FILES}, t AS (SELECT source_row_index, {_sql_strip('source')} AS code FROM f) SELECT min(source_row_index) AS source_row_index, sha256(code) AS code_sha256 FROM t GROUP BY code")
def dedupe_first_wins(spark, sf_dir):
    rows = _files(spark, sf_dir).select("source_row_index", F.sha2(T.strip(F.col("source")), 256).alias("code_sha256"))
    return first_per_key(rows, ["code_sha256"], ["source_row_index"])


@query(f"""WITH {_FILES}, r AS (SELECT CASE WHEN NOT regexp_matches(source, '{NOT_SPACE}') THEN 'skipped_empty' WHEN length(source) > 20000 THEN 'skipped_too_large'
WHEN {_sql_tokens("source")} < 16 THEN 'skipped_too_small' WHEN {_sql_loc("source")} NOT BETWEEN 3 AND 250 THEN 'skipped_loc' ELSE 'kept' END AS reason, language FROM f)
SELECT language, reason, count(*) AS files FROM r GROUP BY ALL""")
def row_filters_rejects(spark, sf_dir):
    rows = files.reject_reasons(_files(spark, sf_dir), most_chars=20_000)
    return rows.groupBy("language", "reason").agg(F.count("*").alias("files"))


# the operator's and the reference's own limit
@query(f"""WITH {_FILES}, r AS (SELECT CASE WHEN NOT regexp_matches(source, '{NOT_SPACE}') THEN 'skipped_empty' WHEN length(source) > 200000 THEN 'skipped_too_large'
WHEN {_sql_tokens("source")} < 16 THEN 'skipped_too_small' WHEN {_sql_loc("source")} NOT BETWEEN 3 AND 250 THEN 'skipped_loc' ELSE 'kept' END AS reason, language FROM f)
SELECT language, reason, count(*) AS files FROM r GROUP BY ALL""")
def row_filters_rejects_200k(spark, sf_dir):
    return files.reject_reasons(_files(spark, sf_dir)).groupBy("language", "reason").agg(F.count("*").alias("files"))


@query(f"""WITH {_FILES}, t AS (SELECT source_row_index, {_sql_tokens("source")} AS tokens FROM f),
b AS (SELECT *, (sum(tokens) OVER (ORDER BY source_row_index) - tokens)::BIGINT AS tokens_before FROM t) SELECT * FROM b WHERE tokens_before < 200000""")
def token_budget_prefix(spark, sf_dir):
    return files.token_budget(_files(spark, sf_dir), 200_000).select("source_row_index", "tokens", "tokens_before")


@query(f"""WITH {_FILES}, t AS (SELECT source_row_index, {_sql_strip("language || ' ' || repository_name || ' ' || path")} AS query, {_sql_strip("source")} AS code FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY source_row_index) AS n FROM t WHERE {_sql_tokens("query")} >= 3 AND {_sql_tokens("code")} >= 8)
SELECT source_row_index, query, code FROM r WHERE n = 1 ORDER BY source_row_index LIMIT 1024""")
def retrieval_rows(spark, sf_dir):
    rows = _files(spark, sf_dir).withColumn("q", F.concat_ws(" ", "language", "repository_name", "path"))
    return files.retrieval_rows(rows, "q", "source", "source_row_index", 1024)


@query(f"""WITH {_FILES}, t AS (SELECT {_sql_tokens("source")} AS need FROM f)
SELECT CASE WHEN need <= 128 THEN 128 WHEN need <= 256 THEN 256 WHEN need <= 512 THEN 512 WHEN need <= 1024 THEN 1024 ELSE 2048 END AS bucket_len, count(*) AS examples, count(*) FILTER (need > 2048) AS truncated FROM t GROUP BY ALL""")
def bucket_by_length(spark, sf_dir):
    need = T.token_count(F.col("source"))
    rows = _files(spark, sf_dir).select(need.alias("need")).withColumn("bucket_len", tokens.bucket_of(F.col("need"), list(tokens.BUCKETS)))
    return rows.groupBy("bucket_len").agg(F.count("*").alias("examples"), F.count_if(F.col("need") > max(tokens.BUCKETS)).alias("truncated"))


def _byte_tokens(spark: SparkSession, sf_dir: str, length: int) -> DataFrame:
    rows = _files(spark, sf_dir).select("source_row_index", tokens.byte_tokens(F.col("source"), length).alias("t"))
    return rows.select("source_row_index", F.array_join(F.transform("t", lambda x: x.cast("string")), " ").alias("tokens"), F.size(F.filter("t", lambda x: x > 0)).cast("long").alias("n"))


@query(f"""WITH {_FILES}, b AS (SELECT source_row_index, hex(encode(source)) AS h FROM f),
t AS (SELECT source_row_index, list_transform(generate_series(1, 64), lambda i: CASE WHEN 2 * i <= length(h) THEN ('0x' || substr(h, 2 * i - 1, 2))::INT + 1 ELSE 0 END) AS x FROM b)
SELECT source_row_index, array_to_string(x, ' ') AS tokens, len(list_filter(x, lambda y: y > 0)) AS n FROM t""")
def byte_tokens_padded(spark, sf_dir):
    return _byte_tokens(spark, sf_dir, 64)


# the reference's default length
@query(f"""WITH {_FILES}, b AS (SELECT source_row_index, hex(encode(source)) AS h FROM f),
t AS (SELECT source_row_index, list_transform(generate_series(1, 256), lambda i: CASE WHEN 2 * i <= length(h) THEN ('0x' || substr(h, 2 * i - 1, 2))::INT + 1 ELSE 0 END) AS x FROM b)
SELECT source_row_index, array_to_string(x, ' ') AS tokens, len(list_filter(x, lambda y: y > 0)) AS n FROM t""")
def byte_tokens_padded_256(spark, sf_dir):
    return _byte_tokens(spark, sf_dir, 256)


@query("SELECT min(doc_id) AS first_row, (row_number() OVER (ORDER BY min(doc_id)) - 1) AS idx FROM documents GROUP BY coalesce(text, '')")
def intern_text(spark, sf_dir):
    numbered, _ = files.intern_texts(table(spark, sf_dir, "documents"), "text", "doc_id")
    return numbered.select("first_row", "idx")


# triples from documents: a surface change is the positive, a changed word the negative
def _triples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("unit_id"), F.coalesce("text", F.lit("")).alias("code"))
    kinds = {"anchor": F.col("code"), "positive": F.regexp_replace("code", r"\.\n", ".\n\n"), "negative": F.regexp_replace("code", r"\bthe\b", "a")}
    views = None
    for role, code in kinds.items():
        one = rows.select("unit_id", F.lit(role).alias("role"), code.alias("code"))
        views = one if views is None else views.unionByName(one)
    views = views.withColumn("view_id", T.stable_hash(F.col("unit_id"), "focal_triplet", F.col("role"), F.sha2("code", 256)))
    sides = {role: views.filter(F.col("role") == role).select("unit_id", F.col("view_id").alias(f"{role}_view_id"), F.col("code").alias(f"{role}_code")) for role in kinds}
    joined = sides["anchor"].join(sides["positive"], "unit_id").join(sides["negative"], "unit_id")
    # a unit needs a changed positive and a changed negative
    kept = joined.filter((F.col("anchor_code") != F.col("positive_code")) & (F.col("anchor_code") != F.col("negative_code")))
    triples = kept.select("unit_id", *(f"{role}_view_id" for role in kinds))
    return triples, views


_SQL_TRIPLES = f"""r AS (SELECT doc_id::VARCHAR AS unit_id, coalesce(text, '') AS a FROM documents),
k AS (SELECT unit_id, a, regexp_replace(a, '\\.\\n', '.' || chr(10) || chr(10), 'g') AS p, regexp_replace(a, '\\bthe\\b', 'a', 'g') AS n FROM r),
t AS (SELECT *, {_sql_hash("unit_id", "'focal_triplet'", "'anchor'", "sha256(a)")} AS anchor_view_id, {_sql_hash("unit_id", "'focal_triplet'", "'positive'", "sha256(p)")} AS positive_view_id, {_sql_hash("unit_id", "'focal_triplet'", "'negative'", "sha256(n)")} AS negative_view_id FROM k WHERE a <> p AND a <> n)"""


@query(f"WITH {_SQL_TRIPLES} SELECT unit_id, anchor_view_id, positive_view_id, negative_view_id, sha256(a) AS anchor_sha, sha256(p) AS positive_sha, sha256(n) AS negative_sha FROM t")
def assemble_triples(spark, sf_dir):
    triples, views = _triples(spark, sf_dir)
    out = assemble.assemble(triples, views.select("view_id", "code"))
    return out.select("unit_id", *(f"{s}_view_id" for s in assemble.SIDES), *(F.sha2(s, 256).alias(f"{s}_sha") for s in assemble.SIDES))


@query(f"WITH {_SQL_TRIPLES}, u AS (SELECT unnest([anchor_view_id, positive_view_id, negative_view_id]) AS view_id, unnest(['a', 'p', 'n']) AS side FROM t) SELECT view_id, count(*) AS triples FROM u WHERE side = 'n' GROUP BY view_id")
def missing_views_anti(spark, sf_dir):
    triples, views = _triples(spark, sf_dir)
    return assemble.missing_views(triples, views.filter("role <> 'negative'"))


@query(f"WITH {_SQL_TRIPLES} SELECT count(*) AS views, count(*) // 3 AS triples FROM (SELECT unnest([anchor_view_id, positive_view_id, negative_view_id]) FROM t)")
def needed_views(spark, sf_dir):
    triples, views = _triples(spark, sf_dir)
    return assemble.needed_views(triples, views).agg(F.count("*").alias("views"), F.count_if(F.col("role") == "anchor").alias("triples"))


_SOLUTIONS = f"""s AS (SELECT conv_id AS task_id, turn AS solution_index, lower({_sql_strip("coalesce(nullif(role, ''), 'unknown')")}) AS language, {_sql_strip("coalesce(text, '')")} AS code FROM conversations),
d AS (SELECT task_id, language, code || chr(10) AS code, min(solution_index) AS solution_index FROM s WHERE code <> '' GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY task_id, language ORDER BY solution_index) AS k FROM d),
u AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY k, language) - 1 AS position FROM n),
q AS (SELECT * FROM u WHERE position < 32)"""


def _solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("solution_index"), F.col("role").alias("language"), F.col("text").alias("code"))
    return tasks.unique_solutions(rows)


@query(f"WITH {_SOLUTIONS} SELECT task_id, solution_index, language, position, sha256(code) AS code_sha FROM q")
def task_solutions(spark, sf_dir):
    return _solutions(spark, sf_dir).select("task_id", "solution_index", "language", F.col("position").cast("long").alias("position"), F.sha2("code", 256).alias("code_sha"))


@query(f"""WITH {_SOLUTIONS}, p AS (SELECT l.task_id, l.position AS left_position, r.position AS right_position, l.language AS left_language, r.language AS right_language,
CASE WHEN l.language = r.language THEN 'same_task_different_solution' ELSE 'cross_language_same_task' END AS relation_type,
row_number() OVER (PARTITION BY l.task_id ORDER BY l.position, r.position) AS k FROM q l JOIN q r ON l.task_id = r.task_id AND l.position < r.position)
SELECT * EXCLUDE k FROM p WHERE k <= 256""")
def semantic_pairs(spark, sf_dir):
    pairs = tasks.semantic_pairs(_solutions(spark, sf_dir))
    return pairs.select("task_id", F.col("left_position").cast("long").alias("left_position"), F.col("right_position").cast("long").alias("right_position"), "left_language", "right_language", "relation_type")


@query(f"WITH {_SOLUTIONS} SELECT task_id, CASE WHEN count(DISTINCT language) > 1 THEN 'multi' ELSE min(language) END AS language, count(*) AS solutions FROM q GROUP BY task_id")
def task_language(spark, sf_dir):
    return tasks.task_languages(_solutions(spark, sf_dir))


@query("SELECT l.doc_id AS left, d.doc_id AS right, l.quality AS label, length(x.text) AS left_chars, length(y.text) AS right_chars FROM labels l JOIN (SELECT doc_id, doc_id - 1 AS before FROM documents) d ON d.before = l.doc_id JOIN documents x ON x.doc_id = l.doc_id JOIN documents y ON y.doc_id = d.doc_id")
def pair_file_join(spark, sf_dir):
    pairs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("left"), (F.col("doc_id") + 1).alias("right"), F.col("quality").alias("label"))
    functions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.length("text").cast("long").alias("code"))
    return assemble.pair_codes(pairs, functions).select("left", "right", "label", F.col("left_code").alias("left_chars"), F.col("right_code").alias("right_chars"))


_SIMILAR = """v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT a.id AS query, b.id, a.label = b.label AS relevant, round(list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))), 9) AS score,
count(*) FILTER (a.label = b.label) OVER (PARTITION BY a.id) AS r FROM v a JOIN v b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")


@query(f"WITH {_SIMILAR} SELECT query, id, rank, relevant, round(score, 6) AS score FROM k WHERE rank <= 10")
def knn_rank(spark, sf_dir):
    near = metrics.nearest(_vectors(spark, sf_dir), F.lit(10))
    return near.select("query", "id", F.col("rank").cast("long").alias("rank"), "relevant", F.round("score", 6).alias("score"))


@query(f"""WITH {_SIMILAR}, h AS (SELECT *, sum(relevant::INT) OVER (PARTITION BY query ORDER BY rank) AS hits FROM k WHERE rank <= r),
a AS (SELECT query, sum(CASE WHEN relevant THEN hits / rank ELSE 0 END) / max(r) AS ap FROM h GROUP BY query) SELECT round(avg(ap), 6) AS map_at_r, count(*) AS queries FROM a""")
def map_at_r(spark, sf_dir):
    return metrics.map_at_r(_vectors(spark, sf_dir)).select(F.round("map_at_r", 6).alias("map_at_r"), "queries")


@query(f"""WITH {_SIMILAR}, f AS (SELECT query, min(rank) AS rank FROM k WHERE relevant GROUP BY query)
SELECT count(*) AS queries, round(avg(1 / rank), 6) AS mrr, round(avg((rank <= 1)::INT), 6) AS recall_at_1, round(avg((rank <= 5)::INT), 6) AS recall_at_5, round(avg((rank <= 10)::INT), 6) AS recall_at_10, median(rank)::DOUBLE AS median_rank, round(avg(rank), 6) AS mean_rank FROM f""")
def retrieval_metrics(spark, sf_dir):
    out = metrics.retrieval_metrics(metrics.first_relevant_ranks(_vectors(spark, sf_dir)))
    return out.select("queries", *(F.round(c, 6).alias(c) for c in ("mrr", "recall_at_1", "recall_at_5", "recall_at_10")), "median_rank", F.round("mean_rank", 6).alias("mean_rank"))


_SCORED = "b AS (SELECT doc_id AS id, quality::INT AS label, length(text)::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("double").alias("score"))
    return table(spark, sf_dir, "labels").join(chars, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"), "score")


@query(f"""WITH {_SCORED}, r AS (SELECT label, sum(label) OVER w AS hits, row_number() OVER w AS k FROM b WINDOW w AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING))
SELECT round(sum(CASE WHEN label = 1 THEN hits / k ELSE 0 END) / sum(label), 6) AS average_precision, count(*) AS rows FROM r""")
def average_precision(spark, sf_dir):
    return metrics.average_precision(_scored(spark, sf_dir)).select(F.round("average_precision", 6).alias("average_precision"), "rows")


@query(f"""WITH {_SCORED}, r AS (SELECT label, row_number() OVER (ORDER BY score, id) AS k FROM b), t AS (SELECT sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n, sum(CASE WHEN label = 1 THEN k ELSE 0 END)::DOUBLE AS s, count(*) AS rows FROM r)
SELECT round((s - p * (p + 1) / 2) / (p * n), 6) AS roc_auc, rows FROM t""")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_scored(spark, sf_dir)).select(F.round("roc_auc", 6).alias("roc_auc"), "rows")


@query(f"""WITH {_SCORED}, g AS (SELECT score, sum(label)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM b GROUP BY score),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS said, (SELECT sum(label)::DOUBLE FROM b) AS p, (SELECT count(*)::DOUBLE FROM b) AS rows FROM g),
e AS (SELECT score, tp / greatest(said, 1) AS precision, tp / greatest(p, 1) AS recall, (rows - (said - tp) - (p - tp)) / rows AS accuracy FROM c),
x AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM e)
SELECT round(f1, 6) AS f1, score AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(accuracy, 6) AS accuracy FROM x ORDER BY round(f1, 9) DESC, score LIMIT 1""")
def best_f1(spark, sf_dir):
    out = metrics.best_f1(_scored(spark, sf_dir))
    return out.select("threshold", *(F.round(c, 6).alias(c) for c in ("f1", "precision", "recall", "accuracy")))


@query(f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (score >= 1000 AND label = 1)::DOUBLE AS tp, count(*) FILTER (score >= 1000 AND label = 0)::DOUBLE AS fp, count(*) FILTER (score < 1000 AND label = 1)::DOUBLE AS fn, count(*) FILTER (score < 1000 AND label = 0)::DOUBLE AS tn, avg(score) FILTER (label = 1) AS mp, avg(score) FILTER (label = 0) AS mn FROM b),
m AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS re FROM c)
SELECT round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / greatest(pr + re, 1e-12), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp + fn) / (tp + fp + fn + tn), 6) AS positive_rate, round(mp, 6) AS mean_positive_score, round(mn, 6) AS mean_negative_score, round(mp - mn, 6) AS score_gap FROM m""")
def binary_bundle(spark, sf_dir):
    out = metrics.binary_bundle(_scored(spark, sf_dir), 1000.0)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


_DRAW = "sha256('{seed}:' || {key})"


def _sql_triplets(seed: int) -> str:
    return f"""c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) > 1),
l AS (SELECT *, row_number() OVER (ORDER BY sha256('{seed}:label:' || label), label) - 1 AS li, count(*) OVER () AS m FROM c),
p AS (SELECT vec_id AS id, e.label, n, li, m, row_number() OVER (PARTITION BY e.label ORDER BY sha256('{seed}:' || vec_id), vec_id) - 1 AS at FROM embeddings e JOIN l ON l.label = e.label),
t AS (SELECT a.id AS anchor, b.id AS positive, g.id AS negative, a.label FROM p a JOIN p b ON b.li = a.li AND b.at = (a.at + 1) % a.n JOIN l x ON x.li = (a.li + 1) % a.m JOIN p g ON g.li = x.li AND g.at = a.at % x.n)"""


@query(f"WITH {_sql_triplets(7)} SELECT anchor, positive, negative, label FROM t")
def label_triplets(spark, sf_dir):
    return sampling.label_triplets(_vectors(spark, sf_dir).select("id", "label"), 7)


@query(f"""WITH {_sql_triplets(7)}, v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT t.label::VARCHAR AS label, list_inner_product(a.x, p.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(p.x, p.x))) AS sp, list_inner_product(a.x, n.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(n.x, n.x))) AS sn FROM t JOIN v a ON a.id = anchor JOIN v p ON p.id = positive JOIN v n ON n.id = negative)
SELECT label, count(*) AS triples, round(avg((sp > sn)::INT), 6) AS rank_accuracy, round(avg(greatest(0, 0.2 - (sp - sn))), 6) AS rank_loss, round(avg(sp - sn), 6) AS sim_gap FROM s GROUP BY label""")
def rank_accuracy_by_group(spark, sf_dir):
    from viewforge.functions.vectors import cosine

    vectors = _vectors(spark, sf_dir)
    rows = sampling.label_triplets(vectors.select("id", "label"), 7)
    for side in ("anchor", "positive", "negative"):
        rows = rows.join(vectors.select(F.col("id").alias(side), F.col("embedding").alias(f"{side}_x")), side)
    scored = rows.select(F.col("label").cast("string").alias("label"), cosine(F.col("anchor_x"), F.col("positive_x")).alias("sim_pos"), cosine(F.col("anchor_x"), F.col("negative_x")).alias("sim_neg"))
    out = metrics.rank_groups(scored, "label")
    return out.select("label", "triples", *(F.round(c, 6).alias(c) for c in ("rank_accuracy", "rank_loss", "sim_gap")))


@query("SELECT lang AS language, count(*) AS n, round(pow(count(*)::DOUBLE, 0.7) / sum(pow(count(*)::DOUBLE, 0.7)) OVER (), 9) AS weight FROM documents GROUP BY lang")
def alpha_language_weights(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("n"))
    return sampling.alpha_weights(counts).withColumn("weight", F.round("weight", 9))


@query("SELECT doc_id, sha256('11:' || doc_id) AS draw FROM documents ORDER BY draw LIMIT 64")
def seeded_sample(spark, sf_dir):
    return sampling.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64, 11)


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('3:1/shard:' || source), sha256('3:1/row:' || doc_id), doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, k // 32 AS batch, k % 32 AS position FROM o WHERE k < n // 32 * 32""")
def epoch_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.epoch_batches(rows, "doc_id", "source", 32, 3, 1).select("doc_id", "batch", "position")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) WHERE k % 4 = 1")
def rank_stride(spark, sf_dir):
    return sampling.stride(table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], 1, 4)


_RUNS = """r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
s AS (SELECT event_type, max(n) AS logs, count(*) AS steady_logs, median(value) AS median_rate, avg(value) AS mean_rate FROM r WHERE k > 1 OR n <= 1 GROUP BY event_type)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.run_summary(table(spark, sf_dir, "events"), "event_type", "value", ["ts", "event_id"])


@query(f"WITH {_RUNS} SELECT event_type, logs, steady_logs, round(median_rate, 6) AS median_rate, round(mean_rate, 6) AS mean_rate FROM s")
def run_summary(spark, sf_dir):
    return _runs(spark, sf_dir).select("event_type", "logs", "steady_logs", F.round("median_rate", 6).alias("median_rate"), F.round("mean_rate", 6).alias("mean_rate"))


@query(f"""WITH {_RUNS}, d AS (SELECT length(event_type) AS devices, max(median_rate) AS median_rate FROM s GROUP BY ALL),
w AS (SELECT *, first(median_rate) OVER o AS br, first(devices) OVER o AS bd, lag(median_rate) OVER o AS lr, lag(devices) OVER o AS ld FROM d WINDOW o AS (ORDER BY devices))
SELECT devices, round(median_rate / br, 3) AS speedup, round(100 * median_rate / (br / bd * devices), 1) AS efficiency_percent, coalesce(round(median_rate - lr, 2), 0) AS incremental_rate, round(100 * (median_rate - lr) / (br / bd * (devices - ld)), 1) AS incremental_percent FROM w""")
def scaling_summary(spark, sf_dir):
    runs = _runs(spark, sf_dir).groupBy(F.length("event_type").cast("long").alias("devices")).agg(F.max("median_rate").alias("median_rate"))
    return profile.scaling_summary(runs).select("devices", "speedup", "efficiency_percent", "incremental_rate", "incremental_percent")


@query(f"WITH {_RUNS} SELECT round(sum(logs / median_rate) / 3600, 3) AS hours, round(sum(logs) / sum(logs / median_rate), 2) AS examples_per_s, count(*) FILTER (median_rate IS NULL) AS missing_buckets FROM s")
def weighted_eta(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return profile.weighted_eta(runs.select(F.col("event_type").alias("bucket"), F.col("logs").alias("n")), runs.select(F.col("event_type").alias("bucket"), F.col("median_rate").alias("rate")))


@query("SELECT 'k' AS key, sum((props ->> '$.k')::BIGINT)::BIGINT AS total, count(props ->> '$.k') AS values FROM events")
def json_key_rollup(spark, sf_dir):
    return profile.key_rollup(table(spark, sf_dir, "events"), "props")


# documents as program text of a language without a tree: what the text-level edits make of them
def _as_code(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    return files.as_source_files(table(spark, sf_dir, "documents")).withColumns({"language": F.lit(language), "metadata_json": F.lit("{}")})


@query(f"""WITH {_FILES} SELECT source_row_index, {_sql_rstrip("CASE WHEN contains(source, ' and ') THEN regexp_replace(source, ' and ', ' or ') WHEN contains(source, ' or ') THEN regexp_replace(source, ' or ', ' and ') WHEN contains(source, '&&') THEN regexp_replace(source, '&&', '||') ELSE regexp_replace(source, '[|][|]', '&&') END")} || chr(10) AS code
FROM f WHERE contains(source, ' and ') OR contains(source, ' or ') OR contains(source, '&&') OR contains(source, '||')""")
def boolop_edits(spark, sf_dir):
    from viewforge.operators.edits import text_edit

    return text_edit(_as_code(spark, sf_dir, "java"), "flip_boolop").select("source_row_index", "code")


@query()
def prepared_view_counts(spark, sf_dir):
    from viewforge.operators.prepare import prepare

    views = prepare(_as_code(spark, sf_dir, "javascript"), "v1")["views"]
    return views.groupBy("family", "role", "transform_name").agg(F.count("*").alias("views"), F.count_if("parse_ok").alias("parse_ok"))


@query()
def prepared_triple_counts(spark, sf_dir):
    from viewforge.operators.prepare import prepare

    triples = prepare(_as_code(spark, sf_dir, "ruby"), "v0")["triples"]
    return triples.groupBy("family", "positive_transform", "negative_type").agg(F.count("*").alias("triples"), F.round(F.sum("sampling_weight"), 2).alias("weight"))


@query()
def transform_matrix(spark, sf_dir):
    from viewforge.operators.prepare import prepare
    from viewforge.operators.prepare import transform_matrix as matrix

    tables = prepare(_as_code(spark, sf_dir, "go"), "v0")
    return matrix(tables["units"], tables["views"], "v0", "go")


@query("SELECT doc_id AS source_row_index, lang AS language FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 50")
def capped_by_language(spark, sf_dir):
    return files.capped(_files(spark, sf_dir), ["language"], 50).select("source_row_index", "language")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 40 OFFSET 25")
def skip_and_take(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").offset(25).limit(40)


@query("""WITH c AS (SELECT lang, count(*) AS n, pow(count(*)::DOUBLE, 0.7) AS p FROM documents GROUP BY lang), s AS (SELECT lang, p / n / max(p / n) OVER () AS share FROM c)
SELECT doc_id, lang FROM documents JOIN s USING (lang) WHERE ('0x' || substr(sha256('5:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 < share""")
def language_mixture(spark, sf_dir):
    return sampling.mixture(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.7, 5)


@query("SELECT coalesce(nullif(lang, ''), 'unknown') AS name, row_number() OVER (ORDER BY coalesce(nullif(lang, ''), 'unknown')) - 1 AS id FROM documents GROUP BY 1")
def language_vocabulary(spark, sf_dir):
    return assemble.vocabulary(table(spark, sf_dir, "documents"), "lang")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), n AS (SELECT vec_id, list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) AS u FROM v),
p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, a.u AS l, b.u AS r FROM n a JOIN n b ON b.vec_id = a.vec_id + 1)
SELECT left_id, right_id, len(l) * 4 AS width, round(list_sum(list_transform(list_zip(l, r), lambda z: abs(z[1] - z[2]))), 6) AS distance, round(list_inner_product(l, r), 6) AS similarity FROM p""")
def pair_feature_sums(spark, sf_dir):
    from viewforge.functions import vectors as V

    units = table(spark, sf_dir, "embeddings").select("vec_id", V.l2_normalise(F.col("embedding")).alias("u"))
    pairs = units.select(F.col("vec_id").alias("left_id"), F.col("u").alias("l"), (F.col("vec_id") + 1).alias("right_id")).join(units.select(F.col("vec_id").alias("right_id"), F.col("u").alias("r")), "right_id")
    rows = pairs.select("left_id", "right_id", V.pair_features(F.col("l"), F.col("r")).alias("f"), F.size("l").alias("d"))

    def total(part):
        return F.round(F.aggregate(part, F.lit(0.0), lambda t, x: t + x), 6)

    return rows.select("left_id", "right_id", F.size("f").cast("long").alias("width"), total(F.slice("f", F.col("d") * 2 + 1, F.col("d"))).alias("distance"), total(F.slice("f", F.col("d") * 3 + 1, F.col("d"))).alias("similarity"))


@query("""WITH p AS (SELECT l.doc_id AS k, x.lang AS a, x.source AS b, l.toxic AS label FROM labels l JOIN documents x USING (doc_id)),
s AS (SELECT 2 * k AS place, a AS code FROM p UNION ALL SELECT 2 * k + 1, b FROM p), i AS (SELECT code, row_number() OVER (ORDER BY min(place)) - 1 AS idx FROM s GROUP BY code)
SELECT k, l.idx AS left, r.idx AS right, label FROM p JOIN i l ON l.code = a JOIN i r ON r.code = b""")
def interned_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    rows = rows.select(F.col("doc_id").alias("k"), F.col("lang").alias("left_code"), F.col("source").alias("right_code"), F.col("toxic").alias("label"))
    return assemble.interned_pairs(rows, "k")[1]


@query("""WITH r AS (SELECT event_type, value, ts FROM events)
SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS logs, round(avg(value), 6) AS mean_rate FROM r GROUP BY ALL""")
def hourly_rates(spark, sf_dir):
    from viewforge.streaming.run_log import hourly

    return hourly(table(spark, sf_dir, "events"), "event_type", "ts", "value").withColumn("mean_rate", F.round("mean_rate", 6))


@query()
def sliced_gaussian(spark, sf_dir):
    return metrics.sliced_gaussian(_vectors(spark, sf_dir)).select(F.round("sliced_gaussian", 6).alias("sliced_gaussian"))


@query()
def masked_byte_tokens(spark, sf_dir):
    rows = _files(spark, sf_dir).select("source_row_index", tokens.byte_ids(F.encode("source", "UTF-8")).alias("t"))
    masked = sampling.mask_tokens(F.col("t"), F.col("source_row_index"), 257, 257)
    return rows.select("source_row_index", F.size(F.filter(masked, lambda m: m["target"] >= 0)).alias("masked"))


#: Lines of program text, one for each site that the text-level edits look for.
SNIPPETS = [
    "if (a instanceof B) { f(); }", "x = await load(q);", "ys = xs.clone();", "ys = new ArrayList<>(xs);", "try { f(); } catch (IOException e) { g(); }",
    "call(a, limit: 5);", "call(a, limit = 5);", "defer f.close();", "in.close();", "return total;",
    "if (ready) { return true; } else { return false; }", "if (ready) { return false; } else { return true; }", "if (a) { return b; } else { return c; }",
    "if (!(a && b)) { f(); }", "if (!(a || b)) { f(); }", "while (i < n) { f(); }", "while (i >= 10) { f(); }", "v = xs[0];", "v = xs[3];", "v = xs[k];",
    "xs.sort();", "rsort(xs);", "sort_by(xs);", "if (x == null) { throw e; }", "if (a) { return b; } else { c(); }", "plain(words);",
]

#: Edits as SQL has them: patterns in order and what their first occurrence becomes.
EDIT_RULES: dict[str, list[tuple[str, str]]] = {
    "flip_membership_or_identity": [(r"\s+instanceof\s+", " !instanceof "), ("===", "!=="), ("!==", "==="), (r"\bis\s+not\b", " is "), (r"\bis\b", " is not "), (r"\bin\b", " not in "), (r"\bnot\s+in\b", " in "), (r"==\s*nil\b", "!= nil"), (r"!=\s*nil\b", "== nil"), (r"==\s*null\b", "!= null"), (r"!=\s*null\b", "== null")],
    "remove_async_or_concurrency_wait": [(p, "") for p in (r"\bawait\s+", r"\bgo\s+", r"<-\s*", r"\.join\(\)", r"\.get\(\)", r"\.wait\(\)", r"\.value\b")],
    "copy_to_alias_mutation": [(r"\.copy\(\)", ""), (r"\.clone\(\)", ""), (r"\.dup\b", ""), (r"clone\s+", ""), (r"\[\.\.\.([^\]]+)\]", r"\1"), (r"new\s+ArrayList<>\(([^)]+)\)", r"\1")],
    "flip_exception_type": [(r"catch\s*\(\s*([A-Za-z_$][\w$.]*)", "catch (Exception"), (r"except\s+([A-Za-z_$][\w$.]*)", "except Exception"), (r"rescue\s+([A-Za-z_:][\w:]*)", "rescue StandardError")],
    "drop_keyword_argument": [(r",\s*[A-Za-z_$][\w$]*\s*:\s*[^,)}\n]+", ""), (r"\{\s*[A-Za-z_$][\w$]*\s*:\s*[^,}\n]+,\s*", ""), (r",\s*[A-Za-z_$][\w$]*\s*=\s*[^,)}\n]+", "")],
    "drop_resource_context": [(r"defer\s+[^\n;]+(?:\n|;)", ""), (r"using\s+[^\n;]+(?:\n|;)", ""), (r"finally\s*\{[^{}]*(?:close|fclose|dispose)[^{}]*\}", ""), (r"\.close\(\);?", ""), (r"fclose\([^)]+\);?", ""), (r"try\s*\([^)]*\)\s*\{", "try {")],
    "remove_return_value": [(r"\breturn\s+([^;\n]+);", "return;"), (r"\breturn\s+([^\n]+)", "return;")],
    "negate_condition": [(r"\b(if|while)\s*\(([^(){};\n]+)\)", r"\1 (!(\2))")],
    "bool_return_simplify": [(r"if\s*\(([^(){};\n]+)\)\s*\{\s*return\s+true\s*;?\s*\}\s*else\s*\{\s*return\s+false\s*;?\s*\}", r"return \1;"), (r"if\s*\(([^(){};\n]+)\)\s*\{\s*return\s+false\s*;?\s*\}\s*else\s*\{\s*return\s+true\s*;?\s*\}", r"return !(\1);")],
    "if_return_merge": [(r"if\s*\(([^(){};\n]+)\)\s*\{\s*return\s+([^;{}\n]+);?\s*\}\s*else\s*\{\s*return\s+([^;{}\n]+);?\s*\}", r"return \1 ? \2 : \3;")],
    "remove_unreachable_else": [(r"if\s*\(([^(){};\n]+)\)\s*\{([^{}]*?return[^{}]*?;?)\s*\}\s*else\s*\{\s*([^{}]*[^{}\s])\s*\}", "if (\\1) {\\2}\n\\3")],
    "demorgan_rewrite": [(r"!\s*\(\s*([^()&|]+?)\s*&&\s*([^()&|]+?)\s*\)", r"!(\1) || !(\2)"), (r"!\s*\(\s*([^()&|]+?)\s*\|\|\s*([^()&|]+?)\s*\)", r"!(\1) && !(\2)")],
    "shift_loop_bound": [(r"([A-Za-z_$][\w$]*)(\s*)<(\s*)([A-Za-z_$][\w$]*|\d+)", r"\1\2<=\3\4"), (r"([A-Za-z_$][\w$]*)(\s*)>=(\s*)([A-Za-z_$][\w$]*|\d+)", r"\1\2>\3\4")],
    "remove_guard_branch": [(r"\bif\s*\([^)]*\)\s*\{\s*(?:return|throw|raise)[^{};\n]*(?:;)?\s*\}\s*", "")],
    "flip_subscript_index": [(r"\[\s*0\s*\]", "[1]"), (r"\[\s*\d+\s*\]", "[0]"), (r"\[\s*([A-Za-z_$][\w$]*)\s*\]", r"[\1 + 1]")],
    "flip_sort_reverse": [(r"\.sort\(\)", ".sort().reverse()"), (r"sort\.Strings\(", "sort.Sort(sort.Reverse(sort.StringSlice("), ("sort_by", "sort_by.reverse"), (r"rsort\(", "sort("), (r"sort\(", "rsort(")],
}


def _sql_edit(rules: list[tuple[str, str]]) -> str:
    quoted = [(p.replace("'", "''"), r.replace("'", "''")) for p, r in rules]
    cases = " ".join(f"WHEN regexp_matches(code, '{p}') THEN regexp_replace(code, '{p}', '{r}')" for p, r in quoted)
    snippets = ", ".join("'" + x + "'" for x in SNIPPETS)
    return (
        f"WITH c AS (SELECT doc_id AS source_row_index, 'int v' || doc_id || ' = 1;' || chr(10) || list_extract([{snippets}], (doc_id % {len(SNIPPETS)} + 1)::INT) || chr(10) || 'last();' AS code FROM documents), "
        f"e AS (SELECT source_row_index, CASE {cases} END AS new FROM c) SELECT source_row_index, {_sql_rstrip('new')} || chr(10) AS code FROM e WHERE new IS NOT NULL"
    )


def _edit_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from viewforge.operators.edits import text_edit

        line = F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.col("doc_id") % len(SNIPPETS) + 1).cast("int"))
        code = F.concat(F.lit("int v"), F.col("doc_id").cast("string"), F.lit(" = 1;\n"), line, F.lit("\nlast();"))
        rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_row_index"), code.alias("source"), F.lit("java").alias("language"))
        return text_edit(rows, name)

    return run


for _name, _rules in EDIT_RULES.items():
    QUERIES[f"edit_{_name}"], ORACLES[f"edit_{_name}"] = _edit_query(_name), _sql_edit(_rules)


@query("SELECT doc_id, k // 100 AS chunk, k % 100 AS position FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents)")
def chunked_rows(spark, sf_dir):
    return sampling.chunks(table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], 100)


@query("""WITH c AS (SELECT n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS chunk FROM documents)
SELECT round(avg(m), 6) AS mean_of_means, count(*) AS batches FROM (SELECT chunk, avg(n_chars::DOUBLE) AS m FROM c GROUP BY chunk)""")
def mean_of_batch_means(spark, sf_dir):
    rows = sampling.chunks(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.col("doc_id")], 64)
    return metrics.batch_means(rows, "chunk", "n_chars").select(F.round("mean", 6).alias("mean_of_means"), "batches")


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents),
d AS (SELECT i AS draw, floor(('0x' || substr(sha256('5:' || i), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 * (SELECT max(n) FROM o))::BIGINT AS k FROM range(500) t(i)) SELECT draw, doc_id FROM d JOIN o USING (k)""")
def draws_with_replacement(spark, sf_dir):
    return sampling.draws(table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], 500, 5)


@query("""SELECT doc_id, '{"lang":"' || coalesce(lang, '') || '","source":"' || coalesce(source, '') || '"}' AS metadata FROM documents""")
def scrubbed_metadata(spark, sf_dir):
    given = F.to_json(F.struct(F.coalesce("lang", F.lit("")).alias("lang"), F.array(F.lit("x = 1")).alias("solutions"), F.coalesce("source", F.lit("")).alias("source"), F.array(F.lit("y")).alias("incorrect_solutions")))
    return table(spark, sf_dir, "documents").select("doc_id", T.scrub_metadata(given).alias("metadata"))


@query("""SELECT event_id, CASE WHEN json_valid(j) THEN j END AS parsed FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"a":' || event_id || '}' WHEN event_id % 3 = 1 THEN '{"a":' ELSE '7' END AS j FROM events)""")
def parsed_json(spark, sf_dir):
    given = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a":'), F.col("event_id").cast("string"), F.lit("}"))).when(F.col("event_id") % 3 == 1, F.lit('{"a":')).otherwise(F.lit("7"))
    return table(spark, sf_dir, "events").select("event_id", T.parse_json_maybe(given).alias("parsed"))
