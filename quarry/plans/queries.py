"""Registered queries over the test tables, each with DuckDB SQL of the same result where SQL can express it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, history, keyword, personas, questions, relevance, reminders, splitting, vectors
from ..sources import files, kept, postings, shared
from . import commands, settings
from . import turn as turns

QUERY = "What about the then thand of truncated txt src3"
TERMS = T.terms_of(QUERY)
STOPS = "[" + ",".join(f"'{w}'" for w in T.QUERY_STOP_WORDS) + "]"
TOKEN_STOPS = "[" + ",".join(f"'{w}'" for w in T.TOKEN_STOP_WORDS) + "]"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a display name, made of source, language and number."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("display_name"), F.col("text").alias("content"))


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose every tenth line is a heading, for chunking."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 10 == 0, F.concat(F.lit("# "), F.left(x, F.lit(20)))).otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(marked, "\n").alias("content"))


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_ix", "text"))


NAMED = "named AS (SELECT doc_id, source || '_' || lang || '_' || doc_id || '.txt' AS display_name, text AS content FROM documents)"
CUT = r"""cut AS (SELECT doc_id, display_name, l, CASE WHEN len(l) > 50 THEN array_to_string(l[1:50], chr(10)) || chr(10) || '... [truncated]' ELSE array_to_string(l, chr(10)) END AS content
 FROM (SELECT *, string_split(regexp_replace(content, '\n\z', ''), chr(10)) AS l FROM named WHERE length(content) BETWEEN 1 AND 1048576))"""


def name_sql(t: str) -> str:
    n = "lower(display_name)"
    return f"CASE WHEN contains(' ' || {n} || ' ', ' {t} ') OR starts_with({n}, '{t}_') OR ends_with({n}, '_{t}') OR list_contains(string_split(replace({n}, '.', '_'), '_'), '{t}') THEN 15 ELSE 0 END"


def line_sql(t: str) -> str:
    return f"CASE WHEN length(trim(x)) <= 40 AND regexp_matches(trim(x), '^\\p{{Lu}}') AND NOT contains(trim(x), ' ') AND contains(lower(x), '{t}') THEN 10 ELSE 2 * least((length(x) - length(replace(lower(x), '{t}', ''))) // {len(t)}, 4) END"


@registered("query_terms", rf"""
SELECT doc_id, pos - 1 AS pos, term FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (
 SELECT doc_id, list_filter(w, lambda x, i: NOT list_contains({STOPS}, x) AND list_position(w, x) = i) AS t FROM (
 SELECT doc_id, regexp_extract_all(lower(text), '[a-z_]{{3,}}') AS w FROM documents)))""")  # fmt: skip
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.query_terms(F.col("text"))).alias("pos", "term")).withColumn("pos", F.col("pos").cast("long"))


@registered("keyword_topk", f"""
WITH {NAMED}, {CUT}
SELECT doc_id, display_name, score FROM (SELECT doc_id, display_name, ({" + ".join(map(name_sql, TERMS))}
 + coalesce(list_sum(list_transform(string_split(content, chr(10)), lambda x: {" + ".join(map(line_sql, TERMS))})), 0))::BIGINT AS score FROM cut)
ORDER BY score DESC, display_name, doc_id LIMIT 10""")  # fmt: skip
def keyword_topk(spark, sf_dir):
    return keyword.top_documents(named_documents(spark, sf_dir), QUERY, 10).select("doc_id", "display_name", "score")


@registered("keyword_scores", f"""
WITH {NAMED}, {CUT}
SELECT doc_id, ({" + ".join(map(name_sql, TERMS))}
 + coalesce(list_sum(list_transform(string_split(content, chr(10)), lambda x: {" + ".join(map(line_sql, TERMS))})), 0))::BIGINT AS score FROM cut""")  # fmt: skip
def keyword_scores(spark, sf_dir):
    docs = named_documents(spark, sf_dir).filter(F.length("content").between(1, 1 << 20)).withColumn("content", T.truncate_lines(F.col("content")))
    return docs.select("doc_id", keyword.score(F.col("display_name"), F.col("content"), TERMS).alias("score"))


@registered("name_match", f"WITH {NAMED} SELECT doc_id, {' + '.join(map(name_sql, TERMS))} AS points FROM named")
def name_match(spark, sf_dir):
    docs = named_documents(spark, sf_dir)
    return docs.select("doc_id", sum((F.when(keyword.name_matches(F.col("display_name"), t), 15).otherwise(0) for t in TERMS), F.lit(0)).alias("points"))


@registered("header_lines", r"""
SELECT doc_id, x AS line FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x FROM documents) WHERE length(x) BETWEEN 1 AND 40 AND regexp_matches(x, '^\p{Lu}') AND NOT contains(x, ' ')""")
def header_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.lines(F.col("text"))).alias("line")).withColumn("line", T.strip(F.col("line")))
    return rows.filter(T.is_header(F.col("line")))


@registered("truncate_lines", f"WITH {NAMED}, {CUT} SELECT doc_id, content FROM cut")
def truncate_lines(spark, sf_dir):
    docs = named_documents(spark, sf_dir).filter(F.length("content").between(1, 1 << 20))
    return docs.select("doc_id", T.truncate_lines(F.col("content")).alias("content"))


TOKENS = rf"tok AS (SELECT doc_id, chunk_ix, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:-[\p{{L}}\p{{N}}_]+)*'), lambda x: NOT list_contains({TOKEN_STOPS}, x)) AS t FROM chunked)"
LINES = "chunked AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS chunk_ix FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
TF = "tf AS (SELECT doc_id, chunk_ix, term, count(*) AS n, any_value(size) AS size FROM (SELECT doc_id, chunk_ix, unnest(t) AS term, len(t) AS size FROM tok) GROUP BY ALL)"


@registered("tokens", f"WITH {LINES}, {TOKENS} SELECT doc_id, chunk_ix, len(t)::BIGINT AS n, array_to_string(t, ' ') AS tokens FROM tok")
def tokens(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return line_chunks(spark, sf_dir).select("doc_id", F.col("chunk_ix").cast("long").alias("chunk_ix"), F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"))


@registered("term_tf", f"WITH {LINES}, {TOKENS}, {TF} SELECT doc_id, chunk_ix, term, round(n / size, 9) AS tf FROM tf")
def term_tf(spark, sf_dir):
    return chunking.token_counts(line_chunks(spark, sf_dir)).select("doc_id", F.col("chunk_ix").cast("long").alias("chunk_ix"), "term", F.round(F.col("n") / F.col("size"), 9).alias("tf"))


@registered("term_df", f"WITH {LINES}, {TOKENS}, {TF} SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL")
def term_df(spark, sf_dir):
    return chunking.token_counts(line_chunks(spark, sf_dir), whole_docs=True).groupBy("doc_id", "term").agg(F.count("*").alias("df"))


TFIDF = f"""WITH {LINES}, {TOKENS}, {TF}, df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL), total AS (SELECT doc_id, count(*) AS chunks FROM chunked GROUP BY ALL),
 w AS (SELECT doc_id, chunk_ix, term, n / size AS tf, df, ln((chunks + 1) / (df + 1)) + 1 AS idf FROM tf JOIN df USING (doc_id, term) JOIN total USING (doc_id))"""


@registered("term_idf", f"{TFIDF} SELECT DISTINCT doc_id, term, round(idf, 6) AS idf FROM w")
def term_idf(spark, sf_dir):
    return chunking.tfidf(line_chunks(spark, sf_dir)).select("doc_id", "term", F.round("idf", 6).alias("idf")).distinct()


@registered("tfidf_top_terms", f"""{TFIDF}
SELECT doc_id, chunk_ix, term, weight FROM (SELECT doc_id, chunk_ix, term, round(tf * idf, 6) AS weight, row_number() OVER (PARTITION BY doc_id, chunk_ix ORDER BY round(tf * idf, 6) DESC, term) AS k FROM w) WHERE k <= 3""")
def tfidf_top_terms(spark, sf_dir):
    from pyspark.sql import Window

    rows = chunking.tfidf(line_chunks(spark, sf_dir)).withColumn("weight", F.round("weight", 6))
    best = Window.partitionBy("doc_id", "chunk_ix").orderBy(F.desc("weight"), "term")
    return rows.withColumn("k", F.row_number().over(best)).filter("k <= 3").select("doc_id", F.col("chunk_ix").cast("long").alias("chunk_ix"), "term", "weight")


HEADED = r"""headed AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 10 = 0 THEN '# ' || left(x, 20) ELSE x END), chr(10)) AS content FROM documents),
 parts AS (SELECT doc_id, list_filter(string_split(regexp_replace(replace(content, chr(1), ''), '(?m)^(#{1,6}\s+.+|={3,}|-{3,})$', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda p: regexp_matches(p, '\S')) AS p FROM headed)"""
FOLD = "list_reduce(list_transform({parts}, lambda x: {{'done': []::VARCHAR[], 'now': x, 'n': length(x)}}), lambda a, x: CASE WHEN a.n + x.n > {size} THEN {{'done': list_append(a.done, a.now), 'now': x.now, 'n': x.n}} ELSE {{'done': a.done, 'now': a.now || {joint} || x.now, 'n': {n}}} END)"


@registered("heading_parts", rf"WITH {HEADED} SELECT doc_id, i - 1 AS pos, part FROM (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM parts)")
def heading_parts(spark, sf_dir):
    found = headed(spark, sf_dir).select("doc_id", F.posexplode(chunking.heading_parts(F.col("content"))).alias("pos", "part"))
    return found.withColumn("pos", F.col("pos").cast("long"))


@registered("pack_chunks", rf"""
WITH {HEADED}, first AS (SELECT doc_id, {FOLD.format(parts='p', size=400, joint='chr(10)', n='a.n + x.n')} AS f FROM parts WHERE len(p) > 0),
 packed AS (SELECT doc_id, list_append(f.done, f.now) AS c FROM first),
 one AS (SELECT doc_id, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM packed),
 cut AS (SELECT doc_id, i, c, regexp_split_to_array(c, '\n\s*\n') AS b FROM one),
 forced AS (SELECT doc_id, i, CASE WHEN length(c) <= 600 THEN [c] ELSE list_append(f.done, f.now) END AS c
  FROM (SELECT *, {FOLD.format(parts="list_filter(b, lambda x, k: x <> '' OR k = 1)", size=400, joint='chr(10) || chr(10)', n='a.n + x.n + 2')} AS f FROM cut)),
 every AS (SELECT doc_id, i, unnest(c) AS text, generate_subscripts(c, 1) AS j FROM forced),
 kept AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS chunk_ix FROM every WHERE regexp_matches(text, '\S'))
SELECT doc_id, chunk_ix, (sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_ix) - length(text) - 1)::BIGINT AS approx_offset, text FROM kept""")
def pack_chunks(spark, sf_dir):
    return chunking.chunks(headed(spark, sf_dir), 400).withColumn("chunk_ix", F.col("chunk_ix").cast("long"))


@registered("chunk_index", f"{TFIDF} SELECT doc_id, chunk_ix, len(t)::BIGINT AS n, coalesce(terms, 0)::BIGINT AS terms, coalesce(round(weight, 6), 0) AS weight FROM tok LEFT JOIN (SELECT doc_id, chunk_ix, count(*) AS terms, sum(tf * idf) AS weight FROM w GROUP BY ALL) USING (doc_id, chunk_ix)")
def chunk_index(spark, sf_dir):
    index = chunking.indexed(line_chunks(spark, sf_dir))
    weights = F.coalesce(F.map_values("tfidf"), F.array().cast("array<double>"))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return index.select("doc_id", F.col("chunk_ix").cast("long").alias("chunk_ix"), F.size("tokens").cast("long").alias("n"), F.size(weights).cast("long").alias("terms"), F.round(total, 6).alias("weight"))


ASKED = ["reation", "erthine", "eaha", "ndonle", "eaha"]


@registered("relevance_base", f"""{TFIDF}, hit AS (SELECT doc_id, chunk_ix, sum(1.5 * tf * idf) AS base FROM w WHERE term IN ({", ".join(f"'{t}'" for t in ASKED)}) GROUP BY ALL)
SELECT doc_id, chunk_ix, round(base, 6) AS base, rank() OVER (ORDER BY round(base, 6) DESC)::BIGINT AS place FROM hit WHERE base > 0""")
def relevance_base(spark, sf_dir):
    from pyspark.sql import Window

    index = chunking.indexed(line_chunks(spark, sf_dir))
    rows = index.select("doc_id", F.col("chunk_ix").cast("long").alias("chunk_ix"), F.round(relevance.base_score(F.col("tokens"), F.col("tfidf"), ASKED), 6).alias("base")).filter("base > 0")
    return rows.withColumn("place", F.rank().over(Window.orderBy(F.desc("base"))).cast("long"))  # the query's hits


@registered("approx_offset", f"WITH {LINES} SELECT doc_id, chunk_ix, (sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_ix) - length(text) - 1)::BIGINT AS approx_offset FROM chunked")
def approx_offset(spark, sf_dir):
    from pyspark.sql import Window

    before = Window.partitionBy("doc_id").orderBy("chunk_ix").rowsBetween(Window.unboundedPreceding, -1)
    rows = line_chunks(spark, sf_dir).withColumn("chunk_ix", F.col("chunk_ix").cast("long"))
    return rows.select("doc_id", "chunk_ix", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long").alias("approx_offset"))


@registered("approx_chunk_count", "SELECT doc_id, length(text) // 2000 AS chunks FROM documents")
def approx_chunk_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.approx_chunk_count(F.col("text")).alias("chunks"))


@registered("relevance_rank")
def relevance_rank(spark, sf_dir):
    index = chunking.chunk_index(headed(spark, sf_dir), 800)
    return relevance.relevant_chunks(index, "reation of the erthine eaha ndonle").select("doc_id", "chunk_ix", F.round("score", 6).alias("score"))


def first_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


COSINE = """SELECT vec_id, list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x)))) AS sim
 FROM (SELECT vec_id, embedding::DOUBLE[] AS a, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS b FROM embeddings)"""


@registered("cosine_topk", f"SELECT vec_id, round(sim, 6) AS sim FROM ({COSINE}) WHERE sim > 0 ORDER BY sim DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    return vectors.top_similar(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10).select("vec_id", F.round("sim", 6).alias("sim"))


@registered("vector_semi_join", f"SELECT d.doc_id, round(h.sim, 6) AS sim, length(d.text) AS n FROM documents d JOIN (SELECT * FROM ({COSINE}) WHERE sim > 0 ORDER BY sim DESC, vec_id LIMIT 10) h ON d.doc_id = h.vec_id")
def vector_semi_join(spark, sf_dir):
    hits = vectors.top_similar(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10).withColumnRenamed("vec_id", "doc_id")
    found = vectors.hits_to_documents(hits, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.round("sim", 6).alias("sim"), F.length("text").cast("long").alias("n"))


LAST = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)"


@registered("history_last_n", f"SELECT conv_id, turn, role, text FROM {LAST} WHERE k <= 4")
def history_last_n(spark, sf_dir):
    return history.prompt_history(table(spark, sf_dir, "conversations"), 2, ["conv_id"])


@registered("history_retained", f"SELECT conv_id, turn, role, text FROM {LAST} WHERE k <= 50")
def history_retained(spark, sf_dir):
    return history.retained(table(spark, sf_dir, "conversations"), 0, ["conv_id"])


LABEL = "CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'AI' ELSE role END"


@registered("history_last30_transcript", f"SELECT conv_id, string_agg({LABEL} || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM {LAST} WHERE k <= 30 GROUP BY conv_id")
def history_last30_transcript(spark, sf_dir):
    return history.transcript(table(spark, sf_dir, "conversations"), ["conv_id"], text="text")


@registered("last_user_message", "SELECT conv_id, max_by(text, turn) AS last_user_message FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(spark, sf_dir):
    return history.last_user_message(table(spark, sf_dir, "conversations"), ["conv_id"], "text")


@registered("message_count", "SELECT c.conv_id, coalesce(m.n, 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'system' GROUP BY conv_id) m USING (conv_id)")
def message_count(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return history.message_counts(rows.select("conv_id").distinct(), rows.filter(F.col("role") == "system"), ["conv_id"])


@registered("history_after_clear", "SELECT conv_id, turn, role, text FROM conversations LEFT JOIN (SELECT conv_id, max(turn) AS c FROM conversations WHERE role = 'system' GROUP BY conv_id) m USING (conv_id) WHERE c IS NULL OR turn > c")
def history_after_clear(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return history.after_clear(rows, rows.filter(F.col("role") == "system").select("conv_id", "turn"), ["conv_id"])


@registered("role_label", f"SELECT conv_id, turn, {LABEL} AS label FROM conversations")
def role_label(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.role_label(F.col("role")).alias("label"))


@registered("author_prefix", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN '**user' || conv_id || ':** ' || text ELSE text END AS text FROM conversations")
def author_prefix(spark, sf_dir):
    name = F.when(F.col("role") == "user", F.concat(F.lit("user"), F.col("conv_id").cast("string"))).otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.author_prefixed(name, F.col("text")).alias("text"))


@registered("prompt_assembly", f"""
WITH parts AS (SELECT DISTINCT conv_id, 0 AS section, 0::BIGINT AS turn, 'system' AS role, 'Be helpful.' AS content FROM conversations
 UNION ALL SELECT conv_id, 1, turn, role, text FROM {LAST} WHERE k <= 4 UNION ALL SELECT DISTINCT conv_id, 2, 0, 'user', '**ann:** And now?' FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY section, turn) AS seq, role, content FROM parts""")
def prompt_assembly(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    channels = rows.select("conv_id").distinct()
    system = channels.withColumn("content", history.system_message(F.lit(""), "Be helpful."))
    asked = channels.withColumn("content", T.author_prefixed(F.lit("ann"), F.lit("And now?")))
    return history.assemble(system, rows, asked, 2, ["conv_id"], "text").withColumn("seq", F.col("seq").cast("long"))


@registered("context_concat", f"""
WITH {NAMED}, top AS (SELECT *, row_number() OVER (ORDER BY display_name) AS rank FROM named ORDER BY display_name LIMIT 10)
SELECT '=== Knowledge Base: kb ===' || chr(10) || chr(10) || string_agg(chr(10) || '--- ' || display_name || ' ---' || chr(10) || content, chr(10) ORDER BY rank) AS context FROM top""")
def context_concat(spark, sf_dir):
    top = named_documents(spark, sf_dir).orderBy("display_name").limit(10)
    listed = top.agg(F.collect_list(F.struct("display_name", "content")).alias("d"))  # ten rows
    docs = F.transform("d", lambda x: F.struct(x["display_name"].alias("rank"), x["display_name"], x["content"]))
    return listed.select(history.context_text("kb", docs).alias("context"))


@registered("fixed_width_split", """
SELECT doc_id, i + 1 AS part, (length(text) - 1) // 1900 + 1 AS parts, substr(text, i * 1900 + 1, 1900) AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 1900 + 1)) AS i FROM documents WHERE text <> '')
UNION ALL SELECT doc_id, 1, 1, 'No reply.' FROM documents WHERE coalesce(text, '') = ''""")
def fixed_width_split(spark, sf_dir):
    parts = splitting.fixed_width_parts(table(spark, sf_dir, "documents"), ["doc_id"], placeholder="No reply.")
    return parts.withColumns({c: F.col(c).cast("long") for c in ("part", "parts")})


@registered("split_message", r"""
WITH given AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
 pieces AS (SELECT doc_id, text, flatten(list_transform(string_split(text, chr(10) || chr(10)), lambda p: CASE WHEN length(p) > 1886
   THEN list_prepend({'done': []::VARCHAR[], 'body': '', 'glue': 'flush'}, list_transform(regexp_extract_all(p, '\S+'), lambda w: {'done': []::VARCHAR[], 'body': w, 'glue': ' '}))
   ELSE [{'done': []::VARCHAR[], 'body': p, 'glue': chr(10) || chr(10)}] END)) AS x FROM given),
 folded AS (SELECT doc_id, text, list_reduce(x, lambda a, p: CASE WHEN p.glue = 'flush' THEN {'done': list_append(a.done, a.body), 'body': '', 'glue': ''}
   WHEN length(CASE WHEN a.body = '' THEN p.body ELSE a.body || p.glue || p.body END) <= 1886 THEN {'done': a.done, 'body': CASE WHEN a.body = '' THEN p.body ELSE a.body || p.glue || p.body END, 'glue': ''}
   ELSE {'done': list_append(a.done, a.body), 'body': p.body, 'glue': ''} END, {'done': []::VARCHAR[], 'body': '', 'glue': ''}) AS f FROM pieces),
 cut AS (SELECT doc_id, CASE WHEN length(text) + 14 <= 1900 THEN [text] ELSE list_transform(list_filter(list_append(f.done, f.body), lambda b: regexp_matches(b, '\S')), lambda b: trim('--- Guide ---' || chr(10) || b, ' ' || chr(10) || chr(9) || chr(13))) END AS c FROM folded),
 every AS (SELECT doc_id, unnest(c) AS t, generate_subscripts(c, 1) AS part, len(c) AS parts FROM cut)
SELECT doc_id, part, parts, CASE WHEN parts > 1 THEN '[' || part || '/' || parts || '] ' || t ELSE t END AS text FROM every""")
def split_message(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    parts = splitting.message_parts(docs, ["doc_id"], header=F.lit("--- Guide ---"))
    return parts.withColumns({c: F.col(c).cast("long") for c in ("part", "parts")})


@registered("sha_listing", "SELECT doc_id, substr(sha256(text), 1, 16) AS sha, strlen(text) AS size FROM documents")
def sha_listing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("sha"), F.octet_length("text").cast("long").alias("size"))


@registered("top_largest", f"WITH {NAMED} SELECT display_name AS name, strlen(content) AS size, printf('%.2f', strlen(content) / 1048576.0) AS mb FROM named ORDER BY size DESC, name LIMIT 5")
def top_largest(spark, sf_dir):
    rows = named_documents(spark, sf_dir).select(F.col("display_name").alias("name"), F.octet_length("content").cast("long").alias("size"))
    return files.largest(rows, 5)


@registered("listing_cap", f"WITH {NAMED} SELECT display_name AS name, (SELECT greatest(count(*) - 30, 0) FROM named) AS more FROM named ORDER BY display_name LIMIT 30")
def listing_cap(spark, sf_dir):
    return files.listing_page(named_documents(spark, sf_dir).select(F.col("display_name").alias("name")))


@registered("listing_lines", f"WITH {NAMED} SELECT doc_id, printf('%s (%.1f KB, 2024-05-06, %s)', display_name, strlen(content) / 1024.0, substr(sha256(content), 1, 8)) AS line FROM named")
def listing_lines(spark, sf_dir):
    docs = named_documents(spark, sf_dir)
    return docs.select("doc_id", T.listing_line(F.col("display_name"), F.octet_length("content"), F.lit("2024-05-06T07:08:09+00:00"), F.sha2(F.col("content").cast("binary"), 256)).alias("line"))


@registered("url_filename", "SELECT page_id, coalesce(nullif(list_last(string_split(split_part(url, '?', 1), '/')), ''), 'remote_file') AS file_name FROM pages")
def url_filename(spark, sf_dir):
    return files.fetched_text(table(spark, sf_dir, "pages")).select("page_id", "file_name")


@registered("fetched_text", "SELECT page_id, substr(html, 1, 32000) AS fetched FROM pages")
def fetched_text(spark, sf_dir):
    return files.fetched_text(table(spark, sf_dir, "pages")).select("page_id", "fetched")


@registered("sanitize_name", r"""
SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(url, '^[0-9a-f]*_', ''), '[^\p{L}\p{N}._\- ]', '', 'g')), 1, 60), ''), 'uploaded_doc') AS name FROM pages""")
def sanitize_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.sanitized_name(F.col("url")).alias("name"))


@registered("display_names", r"""
SELECT doc_id, CASE WHEN regexp_replace(doc_id || source, '^\d+', '') = '' THEN doc_id || source || '.TXT' ELSE regexp_replace(doc_id || source, '^\d+', '') || '.TXT' END AS name FROM documents""")
def display_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.display_name(F.concat(F.col("doc_id").cast("string"), F.col("source"), F.lit(".TXT"))).alias("name"))


KINDS = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in T.EXTENSIONS.items()) + "}"


@registered("infer_ext", rf"""
SELECT page_id, coalesce({KINDS}[s], nullif(s, ''), '.txt') AS ext FROM (SELECT page_id, lower(regexp_extract(split_part(url, '?', 1), '(?s)^.+(\.[^.]*)$', 1)) AS s FROM pages)""")
def infer_ext(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.inferred_extension(F.col("url")).alias("ext"))


@registered("persona_resolve", """
WITH p AS (SELECT n_nationkey::VARCHAR AS key, n_name AS display FROM nation), asked AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(n_name) WHEN c_custkey % 3 = 1 THEN c_nationkey::VARCHAR ELSE 'nobody' END AS asked FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, coalesce(k.key, d.key, '0') AS persona FROM asked LEFT JOIN p k ON k.key = asked LEFT JOIN p d ON lower(d.display) = lower(asked)""")
def persona_resolve(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    known = nation.select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("display"))
    which = F.when(F.col("c_custkey") % 3 == 0, F.lower("n_name")).when(F.col("c_custkey") % 3 == 1, F.col("c_nationkey").cast("string")).otherwise("nobody")
    asked = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", which.alias("asked"))
    return personas.resolve(asked, known).select("c_custkey", F.coalesce("persona_key", F.lit("0")).alias("persona"))


@registered("persona_latest", "SELECT user_id, max_by(event_type, event_id) AS key FROM events GROUP BY user_id")
def persona_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), F.col("event_id").alias("seq"))
    return personas.latest_choice(rows, ["user_id"])


UNITS = "MAP {" + ", ".join(f"'{a}': {b}" for a, b in T.UNIT_SECONDS.items()) + "}"


@registered("reminder_due", f"""
SELECT event_id, delay FROM (SELECT event_id, ts, ((event_id % 40) * {UNITS}[unit])::BIGINT AS delay FROM (
 SELECT *, CASE event_id % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'min' WHEN 2 THEN 'hours' ELSE 'days' END AS u, lower(u) AS unit FROM events))
WHERE delay >= 10 AND ts + to_seconds(delay) <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def reminder_due(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    unit = F.element_at(F.array(*map(F.lit, ("S", "min", "hours", "days"))), (F.col("event_id") % 4 + 1).cast("int"))
    asked = rows.select("event_id", "ts", (F.col("event_id") % 40).alias("n"), unit.alias("unit"))
    last = rows.agg(F.max("ts")).first()[0]
    return reminders.due(asked, F.lit(last).cast(asked.schema["ts"].dataType) - F.expr("INTERVAL 1 HOUR")).select("event_id", "delay")


@registered("approx_words", r"SELECT conv_id, turn, len(regexp_extract_all(text, '\S+'))::BIGINT AS words FROM conversations")
def approx_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.approx_words(F.col("text")).alias("words"))


@registered("prompt_prefix", "SELECT conv_id, turn, trim(substr(trim(text), 3)) AS prompt FROM conversations WHERE starts_with(trim(text), 'Th')")
def prompt_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.prompt_of(F.col("text"), "Th").alias("prompt"))
    return rows.filter(F.col("prompt").isNotNull())


@registered("translate_target", "SELECT page_id, trim(split_part(url, ':', 1)) AS target, trim(substr(url, strpos(url, ':') + 1)) AS source FROM pages WHERE contains(url, ':')")
def translate_target(spark, sf_dir):
    target, source = T.target_and_text(F.col("url"))
    return table(spark, sf_dir, "pages").filter(F.contains("url", F.lit(":"))).select("page_id", target.alias("target"), source.alias("source"))


@registered("safe_int", "SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_id::VARCHAR END AS INTEGER), -1) AS value FROM events")
def safe_int(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", T.safe_int(raw, -1).alias("value"))


@registered("data_uri", "SELECT conv_id, turn, 'data:image/' || CASE WHEN turn % 2 = 0 THEN 'jpeg' ELSE 'png' END || ';base64,' || to_base64(encode(text)) AS uri FROM conversations")
def data_uri(spark, sf_dir):
    name = F.when(F.col("turn") % 2 == 0, "a.JPG").otherwise("b.bmp")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.data_uri(name, F.col("text").cast("binary")).alias("uri"))


@registered("upload_targets", rf"""
WITH named AS (SELECT page_id, coalesce(nullif(list_last(string_split(split_part(url, '?', 1), '/')), ''), 'remote_file') AS filename, strlen(html) AS size, sha256(html) AS sha FROM pages),
 parted AS (SELECT *, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(regexp_replace(filename, '\.[^.]*$', ''), '^[0-9a-f]*_', ''), '[^\p{{L}}\p{{N}}._\- ]', '', 'g')), 1, 60), ''), 'uploaded_doc') AS stem,
  coalesce({KINDS}[lower(regexp_extract(filename, '(?s)^.+(\.[^.]*)$', 1))], nullif(lower(regexp_extract(filename, '(?s)^.+(\.[^.]*)$', 1)), ''), '.txt') AS ext FROM named),
 nth AS (SELECT *, row_number() OVER (PARTITION BY stem, ext ORDER BY sha, page_id) AS k, row_number() OVER (PARTITION BY stem, ext, sha ORDER BY page_id) AS same FROM parted)
SELECT size, stem || CASE WHEN k > 1 THEN '_' || substr(sha, 1, 8) || CASE WHEN same > 1 THEN '_' || same ELSE '' END ELSE '' END || ext AS target FROM nth""")
def upload_targets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", T.url_file_name(F.col("url")).alias("filename"), F.col("html").cast("binary").alias("content"), F.lit(None).cast("string").alias("subfolder"))
    return files.validated_uploads(pages).select("size", "target")


@registered("persona_active", """
SELECT user_id, coalesce(key, 'view') AS key FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT user_id, max_by(event_type, event_id) AS key FROM events WHERE event_id % 7 = 0 GROUP BY user_id) USING (user_id)""")
def persona_active(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    choices = rows.filter(F.col("event_id") % 7 == 0).select("user_id", F.col("event_type").alias("key"), F.col("event_id").alias("seq"))
    return personas.active(rows.select("user_id").distinct(), choices, ["user_id"], "view")


@registered("persona_titles", r"SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(upper(p_name) || '_2nd', '\p{L}+|\P{L}+'), lambda x: upper(x[1]) || lower(x[2:])), '') AS display FROM part")
def persona_titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", personas.title(F.concat(F.upper("p_name"), F.lit("_2nd"))).alias("display"))


@registered("persona_model", "SELECT s_suppkey, coalesce(nullif(CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN s_name END, ''), 'base-model') AS model FROM supplier")
def persona_model(spark, sf_dir):
    slug = F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 1, F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", personas.model_of(slug, "base-model").alias("model"))


@registered("path_order", "SELECT display_name, score FROM (SELECT source || '_' || lang || '_' || doc_id || '.txt' AS display_name, 0::BIGINT AS score, source, lang, doc_id FROM documents WHERE length(text) BETWEEN 1 AND 1048576) ORDER BY source, lang, doc_id LIMIT 7")
def path_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.concat_ws("_", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("display_name"), F.col("text").alias("content"))
    return keyword.top_documents(docs, "", 7).select("display_name", "score")


@registered("typed_settings", "SELECT 10 AS context_window, max(CASE WHEN event_id = 77 THEN event_id END)::INTEGER AS ai_request_timeout, 2000 AS max_tokens, 1250 AS chunk_size, 10 AS rag_max_docs, '!ai' AS bot_prefix, 'vector' AS rag_retrieval_method, 'data/knowledge' AS kb_path, 'kb' AS kb_default_kb, NULL::VARCHAR AS model_name, 'clear' AS chat_history_reset FROM events")
def typed_settings(spark, sf_dir):
    given = {"CONTEXT_WINDOW": "ten", "CHUNK_SIZE": " 1_250 ", "RAG_MAX_DOCS": "", "RAG_RETRIEVAL_METHOD": "Vector", "CHAT_HISTORY_RESET": " Clear"}
    rows = table(spark, sf_dir, "events").filter("event_id = 77").select(F.lit("AI_REQUEST_TIMEOUT").alias("name"), F.col("event_id").cast("string").alias("value"))
    return settings.typed_settings(rows.union(spark.createDataFrame(list(given.items()), "name string, value string")))


@registered("sentinel", "SELECT event_id, CASE WHEN lower(trim(CASE event_id % 3 WHEN 0 THEN ' CLEAR ' ELSE event_type END)) = 'clear' THEN 'clear' END AS reset FROM events")
def sentinel(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, " CLEAR ").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", T.or_clear(raw).alias("reset"))


def retrieved_sql(keys: str, asked: str, top_n: int) -> str:
    """CTEs up to ``best`` (keys, place, doc_id, display_name, content, score) for the questions of ``asked`` (keys, question)."""
    using = f"USING ({keys}, doc_id)"
    low = "lower(display_name)"
    name = f"contains(' ' || {low} || ' ', ' ' || term || ' ') OR starts_with({low}, term || '_') OR ends_with({low}, '_' || term) OR list_contains(string_split(replace({low}, '.', '_'), '_'), term)"
    return rf"""{NAMED}, {CUT}, asked AS ({asked}),
 wanted AS (SELECT {keys}, unnest(list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z_]{{3,}}')), lambda x: NOT list_contains({STOPS}, x))) AS term FROM asked),
 terms AS (SELECT DISTINCT term FROM wanted), l AS (SELECT doc_id, trim(unnest(string_split(content, chr(10)))) AS x FROM cut),
 low AS (SELECT doc_id, lower(x) AS x, length(x) <= 40 AND regexp_matches(x, '^\p{{Lu}}') AND NOT contains(x, ' ') AS header FROM l WHERE x <> ''),
 points AS (SELECT doc_id, term, CASE WHEN header THEN 10 ELSE 2 * least((length(x) - length(replace(x, term, ''))) // length(term), 4) END AS p FROM low JOIN terms ON contains(x, term)
  UNION ALL SELECT doc_id, term, 15 FROM cut JOIN terms ON {name}),
 summed AS (SELECT {keys}, doc_id, sum(p) AS p FROM wanted JOIN (SELECT doc_id, term, sum(p) AS p FROM points GROUP BY ALL) USING (term) GROUP BY ALL),
 ranked AS (SELECT {keys}, doc_id, display_name, content, coalesce(p, 0)::BIGINT AS score, row_number() OVER (PARTITION BY {keys} ORDER BY coalesce(p, 0) DESC, display_name, doc_id) AS place
  FROM asked CROSS JOIN cut LEFT JOIN summed {using}), best AS (SELECT * FROM ranked WHERE place <= {top_n})"""


@registered("keyword_topk_many", f"WITH {retrieved_sql('conv_id, turn', "SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'", 5)} SELECT conv_id, turn, place, doc_id, display_name, score FROM best")
def keyword_topk_many(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    found = questions.top_documents_many(named_documents(spark, sf_dir), asked, ["conv_id", "turn"], 5)
    return found.withColumn("place", F.col("place").cast("long"))


TURN = turns.Turn(rounds=2, most_docs=3, default_persona="0", default_prompt="Be helpful.", default_model="base-model")
TURNS = rf"""{retrieved_sql('conv_id', "SELECT conv_id, max_by(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id", 3)},
 context AS (SELECT conv_id, '=== Knowledge Base: kb ===' || chr(10) || chr(10) || string_agg(chr(10) || '--- ' || display_name || ' ---' || chr(10) || content, chr(10) ORDER BY place) AS context FROM best GROUP BY conv_id),
 who AS (SELECT conv_id, question, n_name AS display, CASE WHEN n_regionkey = 0 THEN 'Be helpful.' ELSE 'Speak as ' || n_name END || chr(10) || chr(10) || 'Relevant knowledge-base context:' || chr(10) || chr(10) || context AS system
  FROM asked JOIN context USING (conv_id) JOIN nation ON n_nationkey = CASE WHEN conv_id % 3 = 2 THEN 0 ELSE conv_id % 25 END),
 said AS (SELECT conv_id, display, system, CASE WHEN conv_id % 2 = 0 THEN '**ann:** ' || question ELSE question END AS content FROM who),
 prompt AS (SELECT conv_id, 0 AS section, 0::BIGINT AS turn, 'system' AS role, system AS content FROM said
  UNION ALL SELECT conv_id, 1, turn, role, text FROM {LAST} JOIN said USING (conv_id) WHERE k <= 4 UNION ALL SELECT conv_id, 2, 0, 'user', content FROM said),
 reply AS (SELECT conv_id, display, content, replace(system, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || content AS reply FROM said)"""


def echoed(prompt: str) -> str:
    """A stand-in for a model: the system message in paragraphs, then the last message."""
    messages = json.loads(prompt)["messages"]
    return "\n\n".join((messages[0]["content"].replace("\n", "\n\n"), messages[-1]["content"]))


def prepared_turns(spark, sf_dir):
    """Every conversation's last user message as a new turn, to personas made of nations."""
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    last = history.last_user_message(rows, ["conv_id"])
    nation = table(spark, sf_dir, "nation")
    prompt = F.when(F.col("n_regionkey") == 0, "").otherwise(F.concat(F.lit("Speak as "), "n_name"))
    known = nation.select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("display"), F.lit("").alias("model"), prompt.alias("system_prompt"))
    names = nation.select(F.col("n_nationkey").alias("_n"), F.lower("n_name").alias("_name"))
    character = F.when(F.col("conv_id") % 3 == 0, F.col("_name")).when(F.col("conv_id") % 3 == 1, F.col("_n").cast("string")).otherwise("nobody")
    asked = last.join(F.broadcast(names), F.col("_n") == F.col("conv_id") % 25).select("conv_id", F.col("last_user_message").alias("content"), F.when(F.col("conv_id") % 2 == 0, "ann").alias("username"), character.alias("character"))
    return rows, *turns.prompts(asked, rows, named_documents(spark, sf_dir), known, ["conv_id"], TURN)


@registered("turn_prompts", f"WITH {TURNS} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY section, turn) AS seq, role, content FROM prompt")
def turn_prompts(spark, sf_dir):
    return prepared_turns(spark, sf_dir)[2].withColumn("seq", F.col("seq").cast("long"))


@registered("turn_parts", rf"""
WITH {TURNS}, sized AS (SELECT conv_id, reply AS text, '--- ' || display || ' ---' || chr(10) AS lead FROM reply),
 pieces AS (SELECT conv_id, text, lead, flatten(list_transform(string_split(text, chr(10) || chr(10)), lambda p: CASE WHEN length(p) > 1900 - length(lead)
   THEN list_prepend({{'done': []::VARCHAR[], 'body': '', 'glue': 'flush'}}, list_transform(regexp_extract_all(p, '\S+'), lambda w: {{'done': []::VARCHAR[], 'body': w, 'glue': ' '}}))
   ELSE [{{'done': []::VARCHAR[], 'body': p, 'glue': chr(10) || chr(10)}}] END)) AS x FROM sized),
 folded AS (SELECT conv_id, text, lead, list_reduce(x, lambda a, p: CASE WHEN p.glue = 'flush' THEN {{'done': list_append(a.done, a.body), 'body': '', 'glue': ''}}
   WHEN length(CASE WHEN a.body = '' THEN p.body ELSE a.body || p.glue || p.body END) <= 1900 - length(lead) THEN {{'done': a.done, 'body': CASE WHEN a.body = '' THEN p.body ELSE a.body || p.glue || p.body END, 'glue': ''}}
   ELSE {{'done': list_append(a.done, a.body), 'body': p.body, 'glue': ''}} END, {{'done': []::VARCHAR[], 'body': '', 'glue': ''}}) AS f FROM pieces),
 sent AS (SELECT conv_id, CASE WHEN length(text) + length(lead) <= 1900 THEN [text] ELSE list_transform(list_filter(list_append(f.done, f.body), lambda b: regexp_matches(b, '\S')), lambda b: trim(lead || b, ' ' || chr(10) || chr(9) || chr(13))) END AS c FROM folded),
 every AS (SELECT conv_id, unnest(c) AS t, generate_subscripts(c, 1) AS part, len(c) AS parts FROM sent)
SELECT conv_id, part, parts, CASE WHEN parts > 1 THEN '[' || part || '/' || parts || '] ' || t ELSE t END AS text FROM every""")
def turn_parts(spark, sf_dir):
    _, asked, prompt_rows = prepared_turns(spark, sf_dir)
    parts = turns.reply_parts(turns.replies(asked, prompt_rows, [echoed], ["conv_id"]), ["conv_id"])
    return parts.withColumns({c: F.col(c).cast("long") for c in ("part", "parts")})


@registered("turn_history", f"""
WITH {TURNS}, grown AS (SELECT conv_id, turn, role, text AS content FROM conversations UNION ALL SELECT conv_id, t + 1, 'user', content FROM reply JOIN (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY conv_id) USING (conv_id)
 UNION ALL SELECT conv_id, t + 2, 'assistant', reply FROM reply JOIN (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY conv_id) USING (conv_id))
SELECT conv_id, turn, role, content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM grown) WHERE k <= 4""")
def turn_history(spark, sf_dir):
    rows, asked, prompt_rows = prepared_turns(spark, sf_dir)
    return turns.kept_history(rows, turns.replies(asked, prompt_rows, [echoed], ["conv_id"]), ["conv_id"], TURN)


@registered("indexed_relevance", ORACLES["relevance_base"])
def indexed_relevance(spark, sf_dir):
    """As relevance_base, from a written inverted index of which only the asked terms' buckets are read."""
    from pyspark.sql import Window

    path = f"{shared.shared_dir(spark)}/chunk-postings-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        postings.write_index(chunking.indexed_whole(docs, F.split("text", "\n")), path, 64, dealt=False)
    else:  # a document's chunks are those of all its rows
        postings.write_index(chunking.indexed(line_chunks(spark, sf_dir)), path, 64)
    rows = postings.base_scores(spark, path, ASKED).select("doc_id", F.col("chunk_ix").cast("long").alias("chunk_ix"), F.round("base", 6).alias("base")).filter("base > 0")
    return rows.withColumn("place", F.rank().over(Window.orderBy(F.desc("base"))).cast("long"))  # the query's hits


@registered("cosine_topk_many", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
 pairs AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(v.e, q.e), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(v.e, lambda x: x * x))) * sqrt(list_sum(list_transform(q.e, lambda x: x * x)))) AS sim
  FROM v q, v WHERE q.vec_id % 5 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS place, vec_id, round(sim, 6) AS sim FROM pairs WHERE sim > 0 QUALIFY place <= 10""")
def cosine_topk_many(spark, sf_dir):
    """Queries: the vectors whose vec_id is divisible by 5; against all vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = rows.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    found = vectors.top_similar_many(rows, asked, ["query_id"], 10)
    return found.withColumns({"place": F.col("place").cast("long"), "sim": F.round("sim", 6)})


@registered("settings_by_user", """
WITH given AS (SELECT user_id, ['CONTEXT_WINDOW', 'AI_REQUEST_TIMEOUT', 'CHUNK_SIZE', 'RAG_RETRIEVAL_METHOD', 'CHAT_HISTORY_RESET', 'MODEL_NAME', 'KB_DEFAULT_KB'][event_id % 7 + 1] AS name,
 CASE event_id % 3 WHEN 0 THEN (event_id % 97)::VARCHAR WHEN 1 THEN ' Clear ' ELSE upper(event_type) END AS value FROM events),
 wide AS (SELECT user_id, max(CASE WHEN name = 'CONTEXT_WINDOW' THEN value END) AS a, max(CASE WHEN name = 'AI_REQUEST_TIMEOUT' THEN value END) AS b, max(CASE WHEN name = 'CHUNK_SIZE' THEN value END) AS c,
  max(CASE WHEN name = 'RAG_RETRIEVAL_METHOD' THEN value END) AS d, max(CASE WHEN name = 'CHAT_HISTORY_RESET' THEN value END) AS e, max(CASE WHEN name = 'MODEL_NAME' THEN value END) AS f, max(CASE WHEN name = 'KB_DEFAULT_KB' THEN value END) AS g FROM given GROUP BY user_id)
SELECT user_id, coalesce(try_cast(a AS INTEGER), 10) AS context_window, coalesce(try_cast(b AS INTEGER), 120) AS ai_request_timeout, 2000 AS max_tokens, coalesce(try_cast(c AS INTEGER), 2000) AS chunk_size, 10 AS rag_max_docs, '!ai' AS bot_prefix,
 lower(coalesce(d, 'keyword')) AS rag_retrieval_method, 'data/knowledge' AS kb_path, lower(coalesce(g, 'kb')) AS kb_default_kb, f AS model_name, CASE WHEN lower(trim(e)) = 'clear' THEN 'clear' END AS chat_history_reset FROM wide""")
def settings_by_user(spark, sf_dir):
    names = ["CONTEXT_WINDOW", "AI_REQUEST_TIMEOUT", "CHUNK_SIZE", "RAG_RETRIEVAL_METHOD", "CHAT_HISTORY_RESET", "MODEL_NAME", "KB_DEFAULT_KB"]
    value = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 97).cast("string")).when(F.col("event_id") % 3 == 1, " Clear ").otherwise(F.upper("event_type"))
    rows = table(spark, sf_dir, "events").select("user_id", F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 7 + 1).cast("int")).alias("name"), value.alias("value"))
    return settings.typed_settings(rows, ["user_id"])


def last_content(prompt: str) -> str:
    """A stand-in for a model: the last message's content."""
    content = json.loads(prompt)["messages"][-1]["content"]
    return content if isinstance(content, str) else content[-1]["image_url"]["url"]


def sliced_sql(rows: str, whole: str, part: str) -> str:
    """conv_id, part, parts, text of rows (conv_id, reply and what the titles need)."""
    return rf"""SELECT conv_id, i + 1 AS part, parts, CASE WHEN parts = 1 THEN {whole} ELSE {part} END || substr(reply, i * 1900 + 1, 1900) AS text
 FROM (SELECT *, (length(reply) - 1) // 1900 + 1 AS parts, unnest(range(0, (length(reply) - 1) // 1900 + 1)) AS i FROM ({rows}))"""


@registered("summarize_parts", sliced_sql(
    f"SELECT conv_id, 'recent conversation' AS source, string_agg('[' || {LABEL} || ']: ' || text, chr(10) || chr(10) ORDER BY turn) AS reply FROM {LAST} WHERE k <= 30 GROUP BY conv_id "
    "UNION ALL SELECT -page_id - 1, 'file from `' || substr(url, 1, 80) || '...`', substr(html, 1, 32000) FROM pages",
    "'\U0001f4dd **Summary** (' || source || '):' || chr(10) || chr(10)", "'\U0001f4dd **Summary** (' || source || ') (part ' || i + 1 || '):' || chr(10) || chr(10)"))
def summarize_parts(spark, sf_dir):
    """Conversations, and fetched pages under negative numbers."""
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    talks = rows.select("conv_id").distinct().select("conv_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("body"))
    pages = table(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("conv_id"), "url", F.col("html").alias("body"))
    prompts = commands.summary_prompts(talks.union(pages), rows, ["conv_id"], "base-model")
    return commands.summary_parts(commands.answered(prompts, [last_content], "summary", commands.NO_SUMMARY), ["conv_id"])


@registered("translate_parts", sliced_sql(
    "SELECT conv_id, 'Spanish' AS target, CASE WHEN conv_id % 2 = 0 THEN 'to say: ' || conv_id ELSE max_by(text, turn) FILTER (role = 'user') END AS reply FROM conversations GROUP BY conv_id HAVING conv_id % 2 = 0 OR count(*) FILTER (role = 'user') > 0",
    "'\U0001f310 Translated to **' || target || '**:' || chr(10) || chr(10)", "'\U0001f310 Translated to **' || target || '** (part ' || i + 1 || ')' || chr(10) || chr(10)")
    + f" UNION ALL SELECT conv_id, 1, 1, '{commands.NO_TEXT}' FROM conversations GROUP BY conv_id HAVING conv_id % 2 = 1 AND count(*) FILTER (role = 'user') = 0")
def translate_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    wanted = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" Spanish : to say: "), F.col("conv_id").cast("string"))).otherwise("Spanish")
    asked = rows.select("conv_id").distinct().select("conv_id", wanted.alias("target_language"), F.lit("English").alias("source_language"))
    prompts = commands.translation_prompts(asked, rows, ["conv_id"], "base-model")
    return commands.translation_parts(commands.answered(prompts, [last_content], "translation"), ["conv_id"])


@registered("ocr_parts", sliced_sql(
    "SELECT conv_id, 'data:image/' || CASE WHEN conv_id % 2 = 0 THEN 'jpeg' ELSE 'png' END || ';base64,' || to_base64(encode(max_by(text, turn))) AS reply FROM conversations GROUP BY conv_id",
    "'\U0001f50d Extracted text:' || chr(10) || chr(10)", "'\U0001f50d OCR (part ' || i + 1 || ')' || chr(10) || chr(10)"))
def ocr_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").cast("binary").alias("content"))
    images = rows.withColumn("filename", F.when(F.col("conv_id") % 2 == 0, "A.JPEG").otherwise("b"))
    return commands.ocr_parts(commands.answered(commands.ocr_prompts(images, "vision"), [last_content], "ocr"), ["conv_id"])


@registered("persona_commands", """
WITH asked AS (SELECT user_id, event_id, ['list', 'set', 'show', 'reset', 'drop'][event_id % 5 + 1] AS action, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN 'nobody' WHEN event_id % 4 = 1 THEN lower((SELECT n_name FROM nation WHERE n_nationkey = event_id % 25)) ELSE (event_id % 25)::VARCHAR END AS name FROM events),
 named AS (SELECT a.*, coalesce(k.n_nationkey, d.n_nationkey) AS persona FROM asked a LEFT JOIN nation k ON k.n_nationkey::VARCHAR = a.name LEFT JOIN nation d ON lower(d.n_name) = lower(a.name)),
 chosen AS (SELECT *, CASE WHEN action = 'set' THEN persona WHEN action = 'reset' THEN 0 END AS c FROM named),
 active AS (SELECT *, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS now FROM chosen),
 every AS (SELECT string_agg('`' || n_nationkey || '`', ', ' ORDER BY n_nationkey) AS names FROM nation)
SELECT user_id, event_id, CASE action
 WHEN 'list' THEN '**Available characters:**' || chr(10) || chr(10) || (SELECT string_agg('  • `' || n_nationkey || '` — display: `' || n_name || '`' || CASE WHEN n_nationkey = now THEN ' ← current' ELSE '' END, chr(10) ORDER BY n_nationkey) FROM nation)
 WHEN 'set' THEN CASE WHEN name IS NULL THEN 'Please provide a character key: `/character set <name>`' WHEN persona IS NULL THEN 'Unknown character ``' || name || '``. Available: ' || names ELSE 'Switched to **' || (SELECT n_name FROM nation WHERE n_nationkey = persona) || '** (model: ``(none set)``)' END
 WHEN 'show' THEN '**Current character:** `' || (SELECT n_name FROM nation WHERE n_nationkey = now) || '`' || chr(10) || '**Model:** ````'
 WHEN 'reset' THEN 'Reverted to default character: **' || (SELECT n_name FROM nation WHERE n_nationkey = 0) || '**' ELSE 'Unknown action ``' || action || '``. Use: list, set, show, reset.' END AS text
FROM active, every""".replace(r"•", "•").replace(r"—", "—").replace(r"←", "←"))
def persona_commands(spark, sf_dir):
    """Every event as a persona command of its user, to personas made of nations."""
    nation = table(spark, sf_dir, "nation")
    known = nation.select(F.col("n_nationkey").alias("at"), F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("display"), F.lit("").alias("model"), (F.col("n_nationkey") == 0).alias("is_default"))
    names = nation.select(F.col("n_nationkey").alias("_n"), F.lower("n_name").alias("_name"))
    which = F.col("event_id") % 4
    name = F.when(which == 3, F.lit(None)).when(which == 2, "nobody").when(which == 1, F.col("_name")).otherwise((F.col("event_id") % 25).cast("string"))
    action = F.element_at(F.array(*map(F.lit, ("list", "set", "show", "reset", "drop"))), (F.col("event_id") % 5 + 1).cast("int"))
    asked = table(spark, sf_dir, "events").join(F.broadcast(names), F.col("_n") == F.col("event_id") % 25).select("user_id", F.col("event_id").alias("seq"), action.alias("action"), name.alias("name"))
    none = asked.select("user_id", "seq", F.lit("").alias("key")).limit(0)
    return commands.persona_commands(asked, none, known, ["user_id"])[0].withColumnRenamed("seq", "event_id")


def stored_pages(spark, sf_dir) -> str:
    """Pages uploaded as files below a fresh folder, four subfolders."""
    root = f"{shared.shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    name = F.concat(F.lit("Page "), F.col("page_id").cast("string"), F.lit(".html"))
    uploads = table(spark, sf_dir, "pages").select(name.alias("filename"), F.col("html").cast("binary").alias("content"), F.concat(F.lit("site"), (F.col("page_id") % 4).cast("string")).alias("subfolder"))
    files.store_uploads(files.validated_uploads(uploads), root).count()
    return root


@registered("stored_catalogue", "SELECT 'site' || page_id % 4 || '/Page ' || page_id || '.html' AS name, 'Page ' || page_id || '.html' AS filename, strlen(html) AS size, substr(sha256(html), 1, 16) AS sha256 FROM pages")
def stored_catalogue(spark, sf_dir):
    """Uploads of all pages, listed and read back by tasks."""
    return files.catalogue(spark, stored_pages(spark, sf_dir)).drop("modified")


@registered("reindex_twice", "SELECT count(*) AS files, count(*) AS read, 0::BIGINT AS read_again FROM pages")
def reindex_twice(spark, sf_dir):
    """The chunk index of all stored pages, brought up to date twice: the second time reads none."""
    root, store = stored_pages(spark, sf_dir), f"{shared.shared_dir(spark)}/index-{uuid.uuid4().hex}"
    first, again = kept.refresh_chunks(spark, root, store), kept.refresh_chunks(spark, root, store)
    return spark.createDataFrame([(again.files, first.read, again.read)], "files long, read long, read_again long")
