"""Line dedup: winnowed line hashes find repeated runs of lines, and every later occurrence of a run is deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import WORD, whole_row, written


def _length(counts: Column, least: int) -> Column:
    """How many of the counts, from the first on, add up to `least` words (0 if all do not)."""
    line = 1 << 40  # lines are counted above the words' bits
    grown = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: F.when(a % line >= least, a).otherwise(a + n + line))
    return F.when(grown % line >= least, F.floor(grown / line).cast("int")).otherwise(F.lit(0))


def worded_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and code (which tell texts apart), size (lines of the text), and of its lines with words h (hash), n (words) and i (place, from 0)."""
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).cast("int").alias("n"), i.alias("i")))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("code"), lines.alias("all"))
    texts = texts.select("doc_id", "code", F.size("all").alias("size"), F.filter("all", lambda x: x["n"] > 0).alias("w")).where(F.size("w") > 0)
    return texts.select("doc_id", "code", "size", F.col("w.h").alias("h"), F.col("w.n").alias("n"), F.col("w.i").alias("i"))


def windows(min_words: int) -> Column:
    """Array of (s, len, at) over worded_lines()' h and n: the shortest run of lines from a line on, or up to a line, that
    has min_words words, and the last place of its least line hash. Places count from 1.

    A window's lines follow from its own text alone, so equal runs hold equal windows.
    """
    ahead = lambda p: F.struct(p.alias("s"), _length(F.slice("n", p, F.lit(min_words)), min_words).alias("len"))

    def behind(p: Column) -> Column:
        low = F.greatest(p - min_words + 1, F.lit(1))
        size = _length(F.reverse(F.slice("n", low, p - low + 1)), min_words)
        return F.struct((p - size + 1).alias("s"), size.alias("len"))

    every = F.sequence(F.lit(1), F.size("n"))
    runs = F.filter(F.array_distinct(F.concat(F.transform(every, ahead), F.transform(every, behind))), lambda x: x["len"] > 0)

    def marked(x: Column) -> Column:
        part = F.slice("h", x["s"], x["len"])
        return F.struct(x["s"].alias("s"), x["len"].alias("len"), (x["s"] + x["len"] - F.array_position(F.reverse(part), F.array_min(part)).cast("int")).alias("at"))

    return F.transform(runs, marked)


def fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """doc_id, code, at, mark: the lines of worded_lines() that are the least hash of one of their windows or more, each once."""
    places = lines.select("doc_id", "code", "h", F.explode(F.array_distinct(F.transform(windows(min_words), lambda x: x["at"]))).alias("at"))
    return places.select("doc_id", "code", "at", F.element_at("h", F.col("at")).alias("mark"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """doc_id, code, spans (array of low, high): lines of each text that repeat a run of an earlier place, disjoint, sorted."""
    lines = written(worded_lines(docs, doc_id, text), "lines")
    prints = written(fingerprints(lines, min_words), "fingerprints")
    place = F.struct("doc_id", "code", "at")
    shared = prints.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select("mark")
    shared = written(shared, "shared")  # apart from its aggregate, a join can be split where one hash is hot
    met = written(prints.join(shared, "mark", "left_semi").select("doc_id", "code", "at"), "met")
    return _united(_extended(lines, met, min_words))


def _extended(lines: DataFrame, met: DataFrame, min_words: int) -> DataFrame:
    """doc_id, code, low, high: the windows around met fingerprints whose lines, compared both ways from the fingerprint,
    stand at an earlier place too."""
    same = lambda a, b, keys: [a[x].eqNullSafe(b[x]) for x in keys]
    texts = met.select("doc_id", "code").distinct()
    near = lines.join(texts, same(lines, texts, ["doc_id", "code"]), "left_semi")
    high = lambda x: F.coalesce(F.try_element_at("i", x["s"] + x["len"]), F.col("size")) - 1

    def around(x: Column) -> Column:
        part = F.slice("h", x["s"], x["len"])
        return F.struct(x["s"].alias("s"), x["at"].alias("at"), F.element_at("i", x["s"]).alias("low"), high(x).alias("high"), F.xxhash64(part).alias("h1"), F.xxhash64(F.lit(1), part).alias("h2"))

    near = near.select("doc_id", "code", F.explode(F.transform(windows(min_words), around)).alias("x")).select("doc_id", "code", "x.*")
    near = near.join(met, same(near, met, ["doc_id", "code", "at"]), "left_semi")
    near = written(near.select("doc_id", "code", "low", "high", "h1", "h2", F.struct("doc_id", "code", "s").alias("place")), "windows")
    first = near.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    return near.join(written(first, "first"), ["h1", "h2"]).where(~F.col("place").eqNullSafe(F.col("first"))).select("doc_id", "code", "low", "high").distinct()


def _united(later: DataFrame) -> DataFrame:
    """doc_id, code, spans: the union of each text's rows of (low, high)."""
    text_of = Window.partitionBy("doc_id", "code").orderBy("low", "high")
    reach = F.max("high").over(text_of.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", F.when(F.col("low") <= reach + 1, 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("new").over(text_of.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("doc_id", "code", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return islands.groupBy("doc_id", "code").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """Struct `row` (docs' columns), clean_text, n_lines, n_deleted (long): each text without its later repeated runs.

    A run of lines (cut at \\n, compared as they are, those without words left out) is repeated if it has at least
    min_words words and an earlier place holds it too: earlier in the order of doc_id, or further up in the same text. All
    its lines go, with the wordless ones after each; what stays is joined by \\n again. A passage that begins or ends inside a
    line counts by its whole lines only. Rows with equal doc_id and text are
    one document and get the same result; other rows with one doc_id come in the order of a hash of their texts. Null
    doc_ids come first. Null texts stay null (no lines); empty texts stay empty (one line). No rows give no rows.

    Winnowing: of each shortest run of min_words words only the least line hash, with its place, leaves the scan; windows
    that share their minimum share one fingerprint. Two equal runs hold the same window and so the same fingerprint.
    Where a fingerprint has two places, it is extended both ways to the windows of which it is the minimum; those whose
    lines, by a 128-bit hash, have an earlier place too are later repeats, and their union is what goes. A longest match
    is the union of the windows in it. Places meet in aggregates and joins by hash; no pair of places becomes a row.
    """
    spans = repeated_spans(docs, doc_id, text, min_words).select(F.col("doc_id").alias("__id"), F.col("code").alias("__code"), "spans")
    rows = docs.select(whole_row(docs).alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).withColumn("code", F.xxhash64("t"))
    rows = rows.join(spans, F.col("id").eqNullSafe(F.col("__id")) & (F.col("code") == F.col("__code")) & F.col("t").isNotNull(), "left")
    rows = rows.withColumn("lines", F.split("t", "\n", -1)).withColumn("n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long"))

    def between(j: Column) -> Column:
        start = F.when(j == 0, F.lit(0)).otherwise(F.try_element_at("spans", j)["high"] + 1)
        stop = F.coalesce(F.try_element_at("spans", j + 1)["low"], F.col("n_lines").cast("int"))
        return F.slice("lines", start + 1, stop - start)

    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size("spans")), between))
    gone = F.aggregate("spans", F.lit(0), lambda a, x: a + x["high"] - x["low"] + 1)
    clean = F.when(F.col("spans").isNull(), F.col("t")).otherwise(F.array_join(left, "\n"))
    return rows.select("row", clean.alias("clean_text"), F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_deleted"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """docs with cleaned texts; documents of which nothing is left are gone."""
    found = dedup_lines(docs, doc_id, text, min_words)
    found = found.where((F.col("n_deleted") == 0) | F.col("clean_text").rlike(WORD))
    return found.select(*[F.col("clean_text").alias(x) if x == text else F.col("row")[x].alias(x) for x in docs.columns])


#: DuckDB SQL for dedup_lines over documents with unique doc_ids.
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line, len(string_split(text, chr(10))) AS n_lines
  FROM documents WHERE text IS NOT NULL),
worded AS (
  SELECT doc_id, x, line, n_lines, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
         row_number() OVER (PARTITION BY doc_id ORDER BY line) AS p
  FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
c AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS upto, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY p), n_lines + 1) AS next_line
  FROM worded),
spans AS (
  SELECT a.doc_id, a.p AS s, min(b.p) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 49 AND b.upto >= a.upto - a.n + 50 GROUP BY a.doc_id, a.p
  UNION
  SELECT a.doc_id, max(b.p) AS s, a.p AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p - 49 AND a.p AND b.upto - b.n <= a.upto - 50 GROUP BY a.doc_id, a.p),
contents AS (
  SELECT v.doc_id, v.s, v.e, string_agg(c.x, chr(10) ORDER BY c.p) AS content
  FROM spans v JOIN c ON c.doc_id = v.doc_id AND c.p BETWEEN v.s AND v.e GROUP BY v.doc_id, v.s, v.e),
ranked AS (SELECT *, rank() OVER (PARTITION BY content ORDER BY doc_id, s) AS k FROM contents),
gone AS (
  SELECT DISTINCT r.doc_id, l.line FROM ranked r JOIN c ON c.doc_id = r.doc_id AND c.p BETWEEN r.s AND r.e
  JOIN lines l ON l.doc_id = c.doc_id AND l.line >= c.line AND l.line < c.next_line WHERE r.k > 1),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_deleted, coalesce(string_agg(l.x, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS clean_text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id)
SELECT d.doc_id, k.clean_text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_deleted, 0) AS n_deleted
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
