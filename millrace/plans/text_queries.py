"""Queries over text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..views import table
from .registry import query

_PAGE_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 replace(replace(regexp_replace(regexp_replace(html, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '&copy;', '©'), '&middot;', '·'),
 '<[^>]+>', ' ', 'g'), 'https?://\S+|www\.\S+', ' ', 'g'), '\S+@\S+\.\S+', ' ', 'g'), '[\x00-\x08\x0b-\x1f\x7f]', ' ', 'g'), '[\s\x0B\p{Z}]+', ' ', 'g'))"""
_WORDS = "CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END"
KEYS = {"value_for_money": ("thing", "est"), "utility": ("er", "zzz"), "durability": ("qqq",), "repairability": ("ation",)}
POSITIVE, NEGATIVE = ("the", "and", "of"), ("to", "in", "is")


@query(f"SELECT page_id, {_PAGE_SQL} AS cleaned FROM pages")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.clean_text(F.col("html")).alias("cleaned"))


@query("SELECT doc_id, sha1(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) AS h FROM documents")
def norm_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.norm_text_hash(F.col("text")).alias("h"))


@query("""SELECT doc_id, 'rev_' || substr(sha1(source || '|' || doc_id), 1, 16) AS review_uid,
 'usr_' || substr(sha1(CASE WHEN doc_id % 7 = 0 THEN 'anon' ELSE lang END), 1, 16) AS reviewer FROM documents""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.when(F.col("doc_id") % 7 != 0, F.col("lang"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.stable_id("rev_", F.col("source"), F.col("doc_id")).alias("review_uid"), T.stable_id("usr_", user).alias("reviewer"))


@query(f"SELECT doc_id, CAST({_WORDS} AS INTEGER) AS n FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("n"))


@query("""WITH t AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) * CASE WHEN event_id % 2 = 0 THEN 1000 ELSE 1 END AS raw FROM events),
 s AS (SELECT event_id, CASE WHEN raw > 10000000000 THEN raw // 1000 ELSE raw END AS s FROM t)
 SELECT event_id, CASE WHEN s BETWEEN 946684800 AND 1893456000 THEN s END AS ts FROM s""")
def ts_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.unix_timestamp("ts") * F.when(F.col("event_id") % 2 == 0, 1000).otherwise(1)
    return table(spark, sf_dir, "events").select("event_id", T.ts_seconds(raw).alias("ts"))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(event_id % 8 AS VARCHAR) END AS raw FROM events)
 SELECT event_id, CASE WHEN TRY_CAST(raw AS DOUBLE) BETWEEN 1 AND 5 THEN TRY_CAST(raw AS DOUBLE) END AS rating FROM r""")
def rating_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise((F.col("event_id") % 8).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", T.rating_or_null(raw).alias("rating"))


@query("""WITH p AS (SELECT p_partkey, TRY_CAST(regexp_replace(CASE p_partkey % 3 WHEN 0 THEN '$1,' || p_size ELSE CASE p_partkey % 3 WHEN 1 THEN 'from ' || p_size
 ELSE CAST(p_size * 200 AS VARCHAR) END END, '[$,]', '', 'g') AS DOUBLE) AS v FROM part) SELECT p_partkey, CASE WHEN v BETWEEN 0.5 AND 5000 THEN v END AS price FROM p""")
def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    raw = F.when(kind == 0, F.concat(F.lit("$1,"), size)).when(kind == 1, F.concat(F.lit("from "), size)).otherwise((F.col("p_size") * 200).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", T.price_or_null(raw).alias("price"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE) AS ratio,
 length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE) >= 0.95 AS comment_ok FROM documents""")
def ascii_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = T.ascii_ratio(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", ratio.alias("ratio"), (ratio >= 0.95).alias("comment_ok"))


@query(r"""WITH w AS (SELECT doc_id, text, string_split(trim(regexp_replace(lower(substr(text, 1, 400)), '[^a-z]+', ' ', 'g')), ' ') AS w FROM documents)
 SELECT doc_id, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE) >= 0.85 AND len(list_filter(w, lambda x: x IN
 ('the','of','and','to','in','a','is','that','for','it','was','on','with','as','are','be','this','have','or','not'))) / CAST(len(w) AS DOUBLE) >= 0.1 AS english FROM w""")
def english_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.is_english(F.col("text")).alias("english"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) END AS ts FROM orders""")
def release_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(kind == 0, "soon").when(kind == 1, F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "MMM d, yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.release_ts(text, F.lit(-1)).alias("ts"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR epoch(o_orderdate) < 946684800 THEN 946684800 ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS updated_ts FROM orders""")
def update_ts_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.when(F.col("o_orderkey") % 3 != 0, F.unix_timestamp("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(ts >= 946684800, ts).otherwise(946684800).alias("updated_ts"))


@query("""SELECT p_partkey, CASE WHEN p_size < 20 AND p_partkey % 2 = 0 THEN 'free' WHEN p_size < 20 THEN 'freemium' ELSE 'paid' END AS kind FROM part""")
def monetization_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.monetization(F.col("p_size") < 20, F.col("p_partkey") % 2 == 1).alias("kind"))


@query("SELECT p_partkey, p_brand || ' ' || substr(p_name, 1, 120) || ': ' || substr(concat_ws(' | ', p_type, p_name, p_brand), 1, 2500) AS spec FROM part")
def launch_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.launch_spec(F.col("p_brand"), F.col("p_name"), F.array("p_type", "p_name", "p_brand")).alias("spec"))


@query("""WITH n AS (SELECT doc_id, source, substr(text, 1, 20 + doc_id % 60) AS name FROM documents),
 h AS (SELECT *, trim(string_split_regex(name, '[,|–—()]')[1], ' ') AS head FROM n),
 c AS (SELECT *, CASE WHEN length(name) <= 38 THEN name WHEN length(head) >= 5 THEN head ELSE substr(name, 1, 38) END AS cut FROM h)
 SELECT doc_id, substr(CASE WHEN length(cut) < 15 AND NOT contains(lower(cut), lower(source)) THEN source || ' ' || cut ELSE cut END, 1, 42) AS short FROM c""")
def short_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("substring(text, 1, cast(20 + doc_id % 60 as int))")
    return table(spark, sf_dir, "documents").select("doc_id", T.short_name(name, F.col("source")).alias("short"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(epoch(l_shipdate) - 900000000) / (86400 * 30.44::DOUBLE) AS months FROM lineitem")
def months_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = T.months_apart(F.unix_timestamp("l_shipdate"), F.lit(900000000))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", months.alias("months"))


@query("""WITH p AS (SELECT p_partkey, ' ' || lower(p_type || ' ' || p_name) || ' ' AS t FROM part),
 f AS (SELECT *, list_min(list_filter([instr(t, 'polished'), instr(t, 'economy'), instr(t, 'a')], lambda i: i > 0)) AS i,
 list_min(list_filter([instr(t, ' b'), instr(t, ' part')], lambda i: i > 0)) AS n FROM p)
 SELECT p_partkey, i IS NOT NULL AND NOT (contains(t, 'steel') OR contains(t, '77')) AND (n IS NULL OR n >= i) AS matches FROM f""")
def category_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = T.matches_category(F.concat_ws(" ", "p_type", "p_name"), ["polished", "economy", "a"], ["steel", "77"], ["b", "part"])
    return table(spark, sf_dir, "part").select("p_partkey", hit.alias("matches"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), '1') AND p_size < 30 THEN 'one' WHEN contains(lower(p_name), '2') AND p_size < 30 THEN 'two'
 WHEN contains(lower(p_name), '1') AND p_size >= 30 THEN 'large' END AS category FROM part""")
def categorize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("one", "1", True), ("two", "2", True), ("large", "1", False)]
    small = F.col("p_size") < 30
    found = [F.when((small if s else ~small) & T.matches_category(F.col("p_name"), [word], ["~"], ["~"]), name) for name, word, s in rules]
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(*found).alias("category"))


def _lexicon_sql(aspect: str, words: tuple[str, ...]) -> str:
    hit = "CASE " + " ".join(f"WHEN contains(t, '{w}') THEN '{w}'" for w in words) + " END"
    count = lambda ws: "+".join(f"CAST(contains(win, '{w}') AS INTEGER)" for w in ws)
    digits = "list_sum(list_transform(range(1, 33), lambda i: instr('0123456789abcdef', substr(d, i, 1)) - 1))"
    return f"""SELECT doc_id, '{aspect}' AS aspect, greatest(0, least(10, round(5.0::DOUBLE + (({count(POSITIVE)}) - ({count(NEGATIVE)})) * 2
     + ((CAST({digits} AS BIGINT) % 5) * 16 + ((instr('0123456789abcdef', substr(d, 32, 1)) - 1) % 4) * 5) % 20 / 10.0::DOUBLE - 1, 1))) AS score,
     coalesce(nullif(substr(array_to_string(string_split(trim(regexp_replace(substr(t, spot + 1, 60), '\\s+', ' ', 'g')), ' ')[1:6], ' '), 1, 60), ''), hit) AS evidence
     FROM (SELECT *, substr(t, greatest(spot - 30, 0) + 1, spot + 40 - greatest(spot - 30, 0)) AS win, md5('{aspect}' || substr(t, 1, 80)) AS d
           FROM (SELECT *, instr(t, hit) - 1 AS spot FROM (SELECT doc_id, lower(text) AS t, {hit.replace("(t,", "(lower(text),")} AS hit FROM documents) WHERE hit IS NOT NULL))"""


@query(f"""SELECT *, round(least(1.0::DOUBLE, 0.4::DOUBLE + 0.1::DOUBLE * count(*) OVER (PARTITION BY doc_id)), 6) AS confidence FROM ({" UNION ALL ".join(_lexicon_sql(a, w) for a, w in KEYS.items())})""")
def lexicon_aspect_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = F.filter(T.lexicon_scores(F.col("text"), KEYS, POSITIVE, NEGATIVE), lambda r: r["s"].isNotNull())
    told = T.let(scored, lambda found: F.transform(found, lambda r: F.struct(r["aspect"].alias("aspect"), r["s"].alias("s"), T.lexicon_confidence(F.size(found)).alias("confidence"))))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(told).alias("r")).where("r is not null")  # a plain explode scores once more to filter
    return rows.select("doc_id", "r.aspect", "r.s.score", "r.s.evidence", "r.confidence")


@query("""WITH c AS (SELECT doc_id, [CASE WHEN contains(t, 'thing') OR contains(t, 'est') THEN NULL ELSE 'value for money' END, CASE WHEN contains(t, 'er') OR contains(t, 'zzz') THEN NULL
 ELSE 'utility' END, CASE WHEN contains(t, 'qqq') THEN NULL ELSE 'durability' END, CASE WHEN contains(t, 'ation') THEN NULL ELSE 'repairability' END] AS m
 FROM (SELECT doc_id, lower(text) AS t FROM documents))
 SELECT doc_id, 4 - len(list_filter(m, lambda x: x IS NOT NULL)) AS covered, array_to_string(list_transform(list_filter(m, lambda x: x IS NOT NULL)[1:5], lambda x: '[ADD: ' || x || ']'), '') AS added FROM c""")
def spec_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.spec_coverage(F.col("text"), KEYS).alias("c"))
    missing = F.filter(F.map_keys("c"), lambda a: F.col("c")[a] == "missing")
    added = F.transform(F.slice(missing, 1, 5), lambda a: F.concat(F.lit("[ADD: "), F.replace(a, F.lit("_"), F.lit(" ")), F.lit("]")))
    return rows.select("doc_id", (len(KEYS) - F.size(missing)).cast("bigint").alias("covered"), F.array_join(added, "").alias("added"))


@query("""WITH e AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN substr(text, 5, 20) WHEN 1 THEN 'and, the!' ELSE 'qqqq and' END AS ev, text FROM documents),
 n AS (SELECT doc_id, trim(regexp_replace(lower(translate(ev, '’‘“”', '''''""')), '\\s+', ' ', 'g')) AS p, trim(regexp_replace(lower(translate(text, '’‘“”', '''''""')), '\\s+', ' ', 'g')) AS t FROM e),
 w AS (SELECT *, list_filter(list_transform(string_split(p, ' '), lambda x: trim(x, '"''.,!?()')), lambda x: length(x) >= 3) AS w FROM n)
 SELECT doc_id, CASE WHEN contains(t, p) THEN 'verbatim' WHEN len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(t, x))) = 0 THEN 'near' ELSE 'mismatch' END AS flag FROM w""".replace("\\\\s", "\\s"))
def evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 3
    evidence = F.when(kind == 0, F.substring("text", 5, 20)).when(kind == 1, "and, the!").otherwise("qqqq and")
    return table(spark, sf_dir, "documents").select("doc_id", T.evidence_match(evidence, F.col("text")).alias("flag"))


@query("""WITH p AS (SELECT conv_id, turn, role, substr(text, 1, 40) || '. ' || substr(text, 1, 400) AS post FROM conversations WHERE turn % 5 <> 4),
 r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS n FROM p WHERE length(post) > 25) SELECT conv_id, turn, role, post FROM r WHERE n <= 80""")
def post_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    posts = table(spark, sf_dir, "conversations").where("turn % 5 <> 4").withColumn("post", F.concat(F.substring("text", 1, 40), F.lit(". "), F.substring("text", 1, 400)))
    n = F.row_number().over(Window.partitionBy("role").orderBy("conv_id", "turn"))
    return posts.where(F.length("post") > 25).withColumn("n", n).where("n <= 80").select("conv_id", "turn", "role", "post")


@query("""SELECT conv_id, turn, role, substr(text, 1, 600) AS context FROM (SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '<[^>]+>', ' ', 'g'), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '\\S+@\\S+\\.\\S+', ' ', 'g'), '[\\x00-\\x08\\x0b-\\x1f\\x7f]', ' ', 'g'), '[\\s\\x0B\\p{Z}]+', ' ', 'g')) AS text FROM conversations)""")
def context_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.substring(T.clean_text(F.col("text"), entities=False), 1, 600).alias("context"))
