"""What changes: matched pools and renamed people, an index that grows, stages that resume, grids that are under way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import identity, matching, postings
from quern.plans.registry import query
from quern.plans.retrieval import bm25_sql
from quern.sources import stages
from quern.sources.tables import messages, questions, scratch, table


@query("""WITH RECURSIVE d AS (SELECT lang AS grp, lpad(doc_id::VARCHAR, 9, '0') AS name, doc_id // 50 AS home, length(text) AS length, row_number() OVER (PARTITION BY lang ORDER BY length(text), lpad(doc_id::VARCHAR, 9, '0')) - 1 AS r FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels)),
b AS (SELECT doc_id // 50 AS pool, lang AS grp, lpad(doc_id::VARCHAR, 9, '0') AS target, length(text) AS length FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND text IS NOT NULL),
t AS (SELECT *, (SELECT count(*) FROM d WHERE d.grp = b.grp AND d.length < b.length) AS i, row_number() OVER (PARTITION BY pool ORDER BY length DESC, target) AS k FROM b),
s(pool, k, target, donor, distance, length, used) AS (SELECT DISTINCT pool, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, []::VARCHAR[] FROM t
  UNION ALL SELECT pool, k, target, donor, distance, length, CASE WHEN donor IS NULL THEN used ELSE list_append(used, donor) END FROM (SELECT s.pool, t.k, t.target, d.name AS donor, abs(d.length - t.length) AS distance, t.length, s.used,
    row_number() OVER (PARTITION BY s.pool ORDER BY abs(d.length - t.length), CASE WHEN d.r >= t.i THEN d.r - t.i ELSE t.i - 1 - d.r END, d.r < t.i) AS pick
    FROM s JOIN t ON t.pool = s.pool AND t.k = s.k + 1 LEFT JOIN d ON d.grp = t.grp AND d.home <> t.pool AND NOT list_contains(s.used, d.name)) WHERE pick = 1)
SELECT pool::VARCHAR AS pool, target, donor, distance, CASE WHEN donor IS NULL THEN 'none' WHEN distance <= 0.1::DOUBLE * length THEN 'close' WHEN distance <= 0.2::DOUBLE * length THEN 'wide' ELSE 'far' END AS fit FROM s WHERE k > 0""")
def length_matched_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every good document a foreign unlabelled one of its language and of nearest length, which its pool uses once."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.floor(F.col("doc_id") / 50).alias("pool"), F.col("lang").alias("grp"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), F.length("text").cast("long").alias("length"))
    labels = table(spark, sf_dir, "labels")
    donors = d.join(labels, "doc_id", "left_anti")
    return matching.length_matched_pools(d.join(labels.where("quality = 1"), "doc_id", "left_semi"), donors, donors.select("pool", "name"))


def pseudonym(salt: Column, agent: Column) -> Column:
    """A name of one width for an agent under a salt."""
    return F.concat(F.lit("PERSON_"), F.substring(F.sha2(F.concat_ws("|", salt, agent).cast("binary"), 256), 1, 8))


@query(r"""WITH RECURSIVE c AS (SELECT conv_id, turn, text, lower(regexp_extract(text, '^([A-Za-z]+) ([A-Za-z]+)', 1)) AS a, lower(regexp_extract(text, '^([A-Za-z]+) ([A-Za-z]+)', 2)) AS b FROM conversations),
f AS (SELECT conv_id, form, min(slug) AS slug FROM (SELECT conv_id, a || '_' || b AS slug, unnest([a || '_' || b, upper(a[1]) || a[2:] || ' ' || upper(b[1]) || b[2:], upper(a[1]) || a[2:], upper(b[1]) || b[2:]]) AS form FROM c WHERE a <> '') WHERE length(form) >= 3 GROUP BY ALL),
m AS (SELECT conv_id, map_from_entries(list((form, slug))) AS m FROM f GROUP BY conv_id),
k AS (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS t, coalesce(m, map([]::VARCHAR[], []::VARCHAR[])) AS m FROM c LEFT JOIN m USING (conv_id)),
r(conv_id, turn, i, put) AS (SELECT conv_id, turn, 1::BIGINT, ''::VARCHAR FROM k
  UNION ALL SELECT conv_id, turn, i + CASE WHEN pair THEN 3 ELSE 1 END, put || CASE WHEN pair THEN '<' || m[t[i] || ' ' || t[i + 2]] || '>' WHEN map_contains(m, t[i]) THEN '<' || m[t[i]] || '>' ELSE t[i] END
  FROM (SELECT k.*, r.i, r.put, coalesce(t[i + 1] = ' ' AND map_contains(m, t[i] || ' ' || coalesce(t[i + 2], '')), false) AS pair FROM r JOIN k ON k.conv_id = r.conv_id AND k.turn = r.turn WHERE i <= len(t))),
e AS (SELECT conv_id, turn, arg_max(put, i) AS put FROM r GROUP BY ALL),
x AS (SELECT conv_id, turn, put, string_split(put, '<') AS parts FROM e)
SELECT c.conv_id, c.turn, c.text AS raw, parts[1] || array_to_string(list_transform(parts[2:], lambda p: 'PERSON_' || left(sha256('3|all|' || string_split(p, '>')[1]), 8) || p[strpos(p, '>') + 1:]), '') AS sham,
  parts[1] || array_to_string(list_transform(parts[2:], lambda p: 'PERSON_' || left(sha256('3|' || c.conv_id || '|' || string_split(p, '>')[1]), 8) || p[strpos(p, '>') + 1:]), '') AS broken FROM c JOIN x USING (conv_id, turn)""")
def identity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of turns as they are, with the people of their session renamed by one map for all sessions, and by a map of
    the session's own. A session's people are those whom its turns begin with."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "text")
    named = lambda i: F.lower(F.regexp_extract("text", "^([A-Za-z]+) ([A-Za-z]+)", i))
    agents = c.where(named(1) != "").select("session", F.concat_ws("_", named(1), named(2)).alias("agent")).distinct()
    forms = agents.select("session", "agent", F.explode(identity.surface_forms(F.col("agent"))).alias("form"))
    salted = lambda salt: forms.withColumn("other", pseudonym(F.concat(F.lit("3|"), salt), F.col("agent")))
    sham = identity.renamed(c, salted(F.lit("all")), "sham")
    both = identity.renamed(sham, salted(F.col("session").cast("string")), "broken")
    return both.select(F.col("session").alias("conv_id"), "turn", F.col("text").alias("raw"), "sham", "broken")


@query(bm25_sql("SELECT conv_id // 10 AS scope, msg_id AS doc_id, text FROM m", "SELECT question_id, question_id // 10 AS scope, text FROM q", "SELECT question_id, rank, doc_id, score FROM hits"))
def growing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best turns of each question's owner from an index to which the turns were added in three versions."""
    m = messages(spark, sf_dir).select(F.floor(F.col("conv_id") / 10).alias("scope"), F.col("msg_id").alias("doc_id"), "text", "day")
    q = questions(spark, sf_dir).select("question_id", F.floor(F.col("question_id") / 10).alias("scope"), "text")
    folder = scratch(spark, "index")
    for part in range(3):
        postings.add(m.where(F.floor(F.col("day") / 5) == part).drop("day"), folder)
    return postings.search(spark, folder, q)


@query(r"""WITH d AS (SELECT doc_id, lang, text, doc_id = (SELECT min(doc_id) FROM documents) AS first FROM documents), p AS (SELECT unnest([1, 2, 3, 4]) AS pass),
w AS (SELECT pass, lang, len(list_filter(string_split_regex(CASE WHEN pass = 3 AND first THEN coalesce(text, '') || ' more' WHEN pass = 4 AND first THEN '  ' || coalesce(text, '') ELSE coalesce(text, '') END, '[ \t\n\r]+'), lambda x: x <> '')) AS n FROM d, p)
SELECT pass::BIGINT AS pass, lang, sum(n)::BIGINT AS n_words, pass <> 2 AS words_ran, pass IN (1, 3) AS totals_ran FROM w GROUP BY pass, lang""")
def resumed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages over documents in four passes, and which of them ran: all is new; nothing has changed; a text has another
    word; that text is back, with more blanks, so that the second stage finds what it had in the first pass."""
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")), scratch(spark, "stages")
    first = docs.agg(F.min("doc_id")).collect()[0][0]
    changed = lambda text: docs.withColumn("text", F.when(F.col("doc_id") == first, text).otherwise(F.col("text")))
    count = lambda docs: docs.select("doc_id", "lang", F.size(F.array_remove(F.split("text", r"[ \t\n\r]+"), "")).cast("long").alias("n"))
    found = None
    for i, d in enumerate([docs, docs, changed(F.concat("text", F.lit(" more"))), changed(F.concat(F.lit("  "), "text"))], 1):
        words = stages.staged(spark, folder, "words", {"docs": d}, count)
        totals = stages.staged(spark, folder, "totals", {"words": words}, lambda words: words.groupBy("lang").agg(F.sum("n").alias("n_words")))
        rows = totals.df.select(F.lit(i).cast("long").alias("pass"), "lang", "n_words", F.lit(words.ran).alias("words_ran"), F.lit(totals.ran).alias("totals_ran"))
        found = rows if found is None else found.unionByName(rows)
    return found


@query("""SELECT lang AS backend, quality::VARCHAR AS model, toxic::VARCHAR AS seed, 'q' || doc_id AS question_id, doc_id % 3 = 0 AS correct FROM labels JOIN documents USING (doc_id) WHERE (quality = 1 OR toxic = 0) AND lang <> (SELECT min(lang) FROM documents)""")
def indexed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the cells that an index names as main or ablation and whose judge is done; files of other cells stay shut."""
    root, k = scratch(spark, "cells"), F.col("doc_id")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    detail = F.struct(F.concat(F.lit("q"), k).alias("question_id"), F.when(k % 3 == 0, "True").otherwise("0").alias("correct"))
    cells = rows.withColumn("slice", F.floor(k / 1000)).groupBy("lang", "quality", "toxic", "slice").agg(F.collect_list(detail).alias("details")).drop("slice")
    cells.write.option("maxRecordsPerFile", 1).partitionBy("lang", "quality", "toxic").json(root)  # a result file is one object
    kind = F.when(F.col("quality") == 1, "main").when(F.col("toxic") == 0, "ablation").otherwise("latency")
    index = cells.select("lang", "quality", "toxic").distinct().withColumn("kind", kind).withColumn("json_path", F.concat(F.lit("lang="), "lang", F.lit("/quality="), "quality", F.lit("/toxic="), "toxic"))
    index = index.unionByName(index.limit(2).withColumn("json_path", F.lit("none"))).unionByName(index.limit(2).withColumn("json_path", F.lit("lang=xx/missing.json")))
    state = F.when(F.col("least"), '{"judges": {"j": {"status": "running"}}}').when(F.col("lang") > "f", '{"judges": {"j": {"status": "done"}}}').otherwise("{cut")
    langs = cells.select("lang").distinct()
    langs = langs.withColumn("least", F.col("lang") == F.lit(langs.agg(F.min("lang")).collect()[0][0]))
    langs.select("lang", state.alias("value")).write.mode("append").partitionBy("lang").text(root)
    files = stages.cell_files(spark, root, index, ["main", "ablation"], "j", f"{root}/lang=*/*.txt")
    found = stages.indexed_cells(spark, files)
    return found.select(F.col("lang").alias("backend"), F.col("quality").cast("string").alias("model"), F.col("toxic").cast("string").alias("seed"), "question_id", "correct")
