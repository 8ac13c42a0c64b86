"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import whole_row

# The patterns of the base kinds and the least lengths of what they match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run of 18 or more characters; a shorter one holds no longer one
HEX = r"[0-9a-f]{16,}"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Strings that the models judge: whole runs of the alphabet, 20 characters or more, not inside a longer word.
CANDIDATE = r"(?<![\p{L}\p{N}+/_=-])[A-Za-z0-9+/_=-]{20,}+(?![\p{L}\p{N}])"
#: Ordinary identifiers that any training sample is joined by.
IDENTIFIERS = """getElementById addEventListener max_retry_count is_valid_user_name connection_pool_size internationalization
responsibilities misunderstandings org-apache-commons-collections utf8_general_ci background-color-transition parse_http_request
BufferedInputStreamReader AbstractSingletonProxyFactoryBean content-security-policy last_modified_timestamp user_account_settings
numberOfParticipants backward-compatibility test_handles_empty_input CamelCaseIdentifierName SCREAMING_SNAKE_CASE_NAME DEFAULT_TIMEOUT_SECONDS
application/x-www-form-urlencoded text/html usr/local/share/python/site-packages docs/getting-started/installation src/main/resources/config
------------------------------ ============================== ______________________________ version-2 page-10 chapter_12 2024-01-31 10000000 12345678901234567890""".split()


def spans(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, end, kind, found): leftmost matches of a pattern without overlaps, in code points. What stands
    between matches and the matches themselves take turns, so their lengths add up to the places."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        low = a["at"] + F.length(x["between"])
        high = low + F.length(x["found"])
        return F.struct(high.alias("at"), F.concat(a["out"], F.array(F.struct(low.alias("start"), high.alias("end"), x["found"].alias("found")))).alias("out"))

    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("between"), found.alias("found"))
    placed = F.aggregate(pairs, start, add)["out"]
    rows = F.transform(placed, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["found"].alias("found")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,found:string>>"))


def random_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """n strings each of random base-64, hexadecimal and upper-case characters, the same ones every time."""
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256)
    table = spark.range(n)
    base64 = table.select(F.substring(F.base64(F.unhex(digest)), 1, 40).alias("text"))
    upper = table.select(F.substring(F.translate(F.base64(F.unhex(digest)), "abcdefghijklmnopqrstuvwxyz+/=", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234"), 1, 32).alias("text"))
    return base64.unionByName(upper).unionByName(table.select(F.substring(digest, 1, 40).alias("text")))


def ordinary_samples(docs: DataFrame, labelled: DataFrame, text: str = "text", doc_id: str = "doc_id", max_ids: int = 2000) -> DataFrame:
    """Identifiers and words of the docs of the `max_ids` least ids of labelled (a bounded sample, the only one here; so
    few ids are sent to every task), but for anything with digits; each distinct one once as it is and once in upper case,
    joined by IDENTIFIERS."""
    ids = labelled.select(F.col(doc_id).alias("__id")).where("__id IS NOT NULL").distinct().orderBy("__id").limit(max_ids)
    rows = docs.where(F.col(text).isNotNull()).join(F.broadcast(ids), F.col(doc_id) == F.col("__id"), "left_semi").select(text)
    words = rows.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?<![\p{L}\p{N}])[A-Za-z+/_=-]{4,}(?![\p{L}\p{N}])"), F.lit(0))).alias("text")).distinct()
    spark = docs.sparkSession
    words = words.unionByName(words.select(F.upper("text").alias("text")))
    return words.unionByName(spark.createDataFrame([(x,) for x in IDENTIFIERS * 3], "text string"))


def train(random: DataFrame, ordinary: DataFrame) -> list[list[float]]:
    """log2 of how much likelier each character is after each other one in random than in ordinary strings.

    random, ordinary: labelled strings in a column text. The model has a row and column per character of ALPHABET and a
    first row for starts, whatever the samples' size; its counts come from one aggregate.
    """
    both = random.select("text", F.lit(0).alias("kind")).unionByName(ordinary.select("text", F.lit(1).alias("kind")))
    chars = both.select("kind", F.filter(F.split("text", ""), lambda c: c != "").alias("c"))
    steps = chars.select("kind", F.explode(F.zip_with(F.concat(F.array(F.lit("")), F.col("c")), "c", lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("x"))
    counts = steps.where(F.col("x.b").isNotNull()).groupBy("kind", "x.a", "x.b").count().where(F.col("b").isin(*ALPHABET) & F.col("a").isin("", *ALPHABET)).collect()
    states = ["", *ALPHABET]
    seen = [{(x["a"], x["b"]): x["count"] for x in counts if x["kind"] == k} for k in (0, 1)]
    sums = [{a: sum(table.get((a, b), 0) for b in ALPHABET) for a in states} for table in seen]
    letters = [{b: sum(table.get((a, b), 0) for a in states) + 0.5 for b in ALPHABET} for table in seen]
    alone = [{b: n / sum(one.values()) for b, n in one.items()} for one in letters]
    share = lambda k, a, b: (seen[k].get((a, b), 0) + 5 * alone[k][b]) / (sums[k][a] + 5)  # noqa: E731  rare steps lean on single characters
    return [[math.log2(share(0, a, b) / share(1, a, b)) for b in ALPHABET] for a in states]


def likelihood_ratio(text: Column, model: list[list[float]]) -> Column:
    """log2 of the likelihood ratio of a string of ALPHABET, per character."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for row in model for x in row)), ",").cast("array<double>")
    at = lambda i: F.call_function("instr", F.lit(ALPHABET), F.substring(text, i, F.lit(1)))
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        here = at(i)
        return F.struct(here.alias("last"), (a["sum"] + F.element_at(table, a["last"] * len(ALPHABET) + here)).alias("sum"))

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), start, step)["sum"] / F.length(text)


def scan(docs: DataFrame, model: list[list[float]], text: str = "text", least: float = 2.0) -> DataFrame:
    """Struct `row` (docs' columns) and `secrets`: array of (start, end, kind, found) by start, then kind in the order assign, access, hex, markov.

    assign, access and hex are the fixed patterns' matches, leftmost and without overlaps inside each kind. markov are
    the CANDIDATEs that overlap none of those and whose likelihood ratio is at least `least` bits a character. Places are
    code points, ends exclusive. Null and empty texts have no spans; every row is scanned for itself.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    long_enough = lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= ASSIGN_LENGTH
    base = F.concat(F.filter(spans(body, ASSIGN, "assign"), long_enough), spans(body, ACCESS, "access"), spans(body, HEX, "hex"))
    rows = docs.select(whole_row(docs).alias("row"), base.alias("base"), spans(body, CANDIDATE, "markov").alias("more"))
    apart = lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    more = F.filter("more", lambda x: apart(x) & (likelihood_ratio(x["found"], model) >= least))
    kinds = F.array(*map(F.lit, ("assign", "access", "hex", "markov")))
    ordered = F.array_sort(F.transform(F.concat("base", more), lambda x: F.struct(x["start"].alias("start"), F.array_position(kinds, x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind"), x["found"].alias("found"))))
    return rows.select("row", F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["found"].alias("found"))).alias("secrets"))


def digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """op7's columns from scan()'s."""
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    shown = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda x: x["kind"] != "markov")
    return scanned.select(F.col("row")[doc_id].alias(doc_id), count("assign"), count("access"), count("hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("secrets")).alias("spans"))
