"""Registered queries of sampling: quotas across groups, postings, order and neighbours of tokens, limits, checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .corpus_queries import LINE_ORDER, QUOTA, _quota, _turn
from .functions import text as tx
from .operators import order as od
from .queries import DW, KEEP, PAR, kept_paragraphs, query, read, words


def _hash(*cols):
    return F.md5(F.concat_ws("|", F.lit("7"), *cols))


# Groups in their order of priority: a part belongs to the first flag that it has, which is the flag's quota to fill.
OWNED = """c AS (SELECT l_partkey title, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) g, count(DISTINCT l_returnflag) flags, count(*) n FROM lineitem GROUP BY 1),
    r AS (SELECT *, CASE WHEN flags = 3 THEN 'multi_theme' WHEN n < 25 THEN 'too_short' END reason FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY g, reason IS NULL ORDER BY md5(concat_ws('|', '7', g, title)), title) turn FROM r)"""


@query(f"WITH {OWNED} SELECT title, g, turn::INT turn, CASE WHEN reason IS NOT NULL THEN reason WHEN turn > 30 THEN 'quota' ELSE 'kept' END outcome FROM k")
def corpus_quota(spark, sf):
    """Parts as titles: the first group that reaches a title owns it; titles of all groups or with few lines are dropped, the first thirty of the rest fill each group."""
    code = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    c = read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("title")).agg(F.min(code).alias("g"), F.count_distinct("l_returnflag").alias("flags"), F.count("*").alias("n"))
    c = c.withColumn("reason", F.when(F.col("flags") == 3, "multi_theme").when(F.col("n") < 25, "too_short"))
    w = Window.partitionBy("g", F.col("reason").isNull()).orderBy(_hash("g", "title"), "title")
    outcome = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("turn") > 30, "quota").otherwise("kept")
    return c.withColumn("turn", F.row_number().over(w)).select("title", "g", "turn", outcome.alias("outcome"))


WANTED = ("the", "and", "ing", "tion")


@query(f"""WITH {PAR}, k AS (SELECT doc_id, i, x FROM p WHERE {KEEP}), core AS (SELECT DISTINCT doc_id FROM k WHERE doc_id % 5 = 0),
    w AS (SELECT doc_id, i, unnest(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) w, generate_subscripts(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), 1) - 1 place FROM k WHERE doc_id NOT IN (SELECT doc_id FROM core))
    SELECT lower(w) word, doc_id, i::INT i, place::INT place FROM w WHERE lower(w) IN {WANTED}""")
def postings(spark, sf):
    """Places of wanted words in paragraphs outside the core, which are the documents whose id is divisible by five."""
    k = kept_paragraphs(spark, sf).select("doc_id", "i", "x")
    core = k.where("doc_id % 5 = 0").select("doc_id").distinct()
    p = k.join(core, "doc_id", "left_anti").select("doc_id", "i", F.posexplode(words("x")).alias("place", "w"))
    wanted = spark.createDataFrame([(w,) for w in WANTED], "word string")
    return p.withColumn("word", F.lower("w")).join(wanted, "word", "left_semi").select("word", "doc_id", "i", "place")


TOKENS = f"""{PAR}, k AS (SELECT lang, doc_id, i, x FROM p WHERE {KEEP} AND length(x) >= 400),
    w AS (SELECT lang, doc_id, i, unnest(string_split(lower(x), ' ')) w, generate_subscripts(string_split(x, ' '), 1) - 1 place FROM k)"""


@query(f"""WITH {TOKENS} SELECT row_number() OVER (ORDER BY lang, doc_id, i, place) - 1 occurrence, doc_id, i::INT i, place::INT place, lag(w) OVER b previous, lead(w) OVER b following, count(*) OVER (PARTITION BY w) f
    FROM w WINDOW b AS (PARTITION BY doc_id, i ORDER BY place)""")
def final_order(spark, sf):
    """Words of long paragraphs in one global order, with their neighbours in the paragraph and their frequency, which is counted apart so that a common word is no hot window."""
    k = kept_paragraphs(spark, sf).where(F.length("x") >= 400).select("lang", "doc_id", "i", F.posexplode(F.split(F.lower("x"), " ")).alias("place", "w"))
    b = Window.partitionBy("doc_id", "i").orderBy("place")
    k = k.withColumn("previous", F.lag("w").over(b)).withColumn("following", F.lead("w").over(b))
    f = k.groupBy("w").agg(F.count("*").alias("f"))
    return od.numbered(k.join(f, "w"), ["lang", "doc_id", "i", "place"], "occurrence").select("occurrence", "doc_id", "i", "place", "previous", "following", "f")


@query(f"""{QUOTA}, s AS (SELECT l_partkey, l_returnflag, l_suppkey, count(*) n FROM q GROUP BY 1, 2, 3), t AS (SELECT l_partkey, l_returnflag, count(*) n FROM q GROUP BY 1, 2), p AS (SELECT l_partkey, count(*) FILTER (n >= 4) n FROM t GROUP BY 1)
    SELECT 'three a supplier' "check", count(*) FILTER (n > 3) violations, count(*) cases FROM s UNION ALL SELECT 'eight a theme', count(*) FILTER (n > 8), count(*) FROM t
    UNION ALL SELECT 'two full themes', count(*) FILTER (n < 2), count(*) FROM p UNION ALL SELECT 'no line twice', count(*) - count(DISTINCT (l_orderkey, l_linenumber)), count(*) FROM q""")
def sample_checks(spark, sf):
    """What must hold of the quota sample, as counts of violations."""
    q = _quota(spark, sf)
    s, t = (q.groupBy(*keys).agg(F.count("*").alias("n")) for keys in (["l_partkey", "l_returnflag", "l_suppkey"], ["l_partkey", "l_returnflag"]))
    p = t.groupBy("l_partkey").agg(F.count_if(F.col("n") >= 4).alias("n"))
    row = lambda df, name, bad: df.agg(F.count_if(bad).alias("violations"), F.count("*").alias("cases")).select(F.lit(name).alias("check"), "violations", "cases")
    lines = q.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).agg((F.sum("n") - F.count("*")).alias("violations"), F.sum("n").alias("cases")).select(F.lit("no line twice").alias("check"), "violations", "cases")
    return row(s, "three a supplier", F.col("n") > 3).unionAll(row(t, "eight a theme", F.col("n") > 8)).unionAll(row(p, "two full themes", F.col("n") < 2)).unionAll(lines)


@query(f"""WITH w AS (SELECT doc_id, lower(unnest({DW})) w FROM documents), r AS (SELECT doc_id, row_number() OVER (PARTITION BY w ORDER BY doc_id) k FROM w), d AS (SELECT doc_id, count(*) FILTER (k <= 3) fresh FROM r GROUP BY 1),
    c AS (SELECT doc_id, fresh, sum(fresh) OVER (ORDER BY doc_id) total FROM d) SELECT doc_id, fresh, total::BIGINT total FROM c WHERE total - fresh < 20000""")
def capped_goal(spark, sf):
    """Documents in order until words, each counted three times at most, reach a goal. What a document adds comes from one count a document and word, so no window sees a common word's rows."""
    n = read(spark, sf, "documents").select("doc_id", F.explode(words()).alias("w")).groupBy(F.lower("w").alias("w"), "doc_id").agg(F.count("*").alias("n"))
    few = n.withColumn("k", F.row_number().over(Window.partitionBy("w").orderBy("doc_id"))).where("k <= 3")  # the first three documents of a word hold its first three places
    before = F.coalesce(F.sum("n").over(Window.partitionBy("w").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = few.withColumn("fresh", F.greatest(F.lit(0), F.least(F.col("n"), 3 - before))).groupBy("doc_id").agg(F.sum("fresh").alias("fresh"))
    every = n.select("doc_id").distinct().join(fresh, "doc_id", "left").select("doc_id", F.coalesce("fresh", F.lit(0)).alias("fresh"))
    return od.running(every, ["doc_id"], F.col("fresh"), "total").where("total - fresh < 20000")


@query(f"""WITH c AS (SELECT l_partkey, l_returnflag, count(*) n FROM lineitem GROUP BY 1, 2), e AS (SELECT l_partkey FROM c GROUP BY 1 HAVING count(*) FILTER (n >= 5) >= 2),
    d AS (SELECT l_partkey FROM e ORDER BY md5(concat_ws('|', '7', l_partkey)), l_partkey LIMIT 40),
    a AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY {LINE_ORDER}) y FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM d)),
    z AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY y, l_returnflag) z FROM a) SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber, z::INT place FROM z WHERE z <= 12""")
def multitheme_draw(spark, sf):
    """Forty parts drawn among those with five lines or more of two flags; of each twelve lines, the flags in turn."""
    lines = read(spark, sf, "lineitem")
    c = lines.groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("n")).groupBy("l_partkey").agg(F.count_if(F.col("n") >= 5).alias("themes")).where("themes >= 2")
    drawn = c.orderBy(_hash("l_partkey"), "l_partkey").limit(40).select("l_partkey")
    a = lines.join(drawn, "l_partkey", "left_semi").withColumn("y", _turn("l_partkey", "l_returnflag"))
    return a.withColumn("place", F.row_number().over(Window.partitionBy("l_partkey").orderBy("y", "l_returnflag"))).where("place <= 12").select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber", "place")


@query(f"""WITH core AS (SELECT * FROM lineitem WHERE l_orderkey % 10 = 0), n AS (SELECT l_partkey, l_returnflag, count(*) n FROM core GROUP BY 1, 2), t AS (SELECT l_partkey, sum(n) n FROM n GROUP BY 1),
    a AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY {LINE_ORDER}) y FROM lineitem WHERE l_orderkey % 10 <> 0),
    q AS (SELECT a.*, greatest(6 - coalesce(n.n, 0), 0) need, greatest(16 - coalesce(t.n, 0), 0) room FROM a LEFT JOIN n USING (l_partkey, l_returnflag) LEFT JOIN t USING (l_partkey)),
    z AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, y) z FROM q WHERE y <= need) SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber, z::INT place FROM z WHERE z <= room""")
def quota_stratum(spark, sf):
    """What is drawn beside a core (lines of every tenth order): six lines a part and flag less those of the core, flags in their order, sixteen a part with the core's at most."""
    lines = read(spark, sf, "lineitem")
    n = lines.where("l_orderkey % 10 = 0").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("n"))
    t = n.groupBy("l_partkey").agg(F.sum("n").alias("t"))
    a = lines.where("l_orderkey % 10 <> 0").withColumn("y", _turn("l_partkey", "l_returnflag")).join(n, ["l_partkey", "l_returnflag"], "left").join(t, "l_partkey", "left")
    a = a.where(F.col("y") <= 6 - F.coalesce("n", F.lit(0)))
    z = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_returnflag", "y"))
    return a.withColumn("place", z).where(F.col("place") <= 16 - F.coalesce("t", F.lit(0))).select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber", "place")


FUNCTION_WORDS = ("the", "of", "and", "in", "on", "de", "la", "un", "der", "die", "und", "el")


@query(f"SELECT lang, count(*) words, round(avg((lower(w) IN {FUNCTION_WORDS})::INT), 6) function_share, count(*) FILTER (regexp_full_match(w, '\\p{{L}}{{3,}}') AND w = lower(w) AND lower(w) NOT IN {FUNCTION_WORDS}) content FROM (SELECT lang, unnest({DW}) w FROM documents) GROUP BY lang")
def function_words(spark, sf):
    """Share of function words (a list given) and number of content words: letters only, three or more, lower case, no function word."""
    w = read(spark, sf, "documents").select("lang", F.explode(words()).alias("w"))
    known = F.lower("w").isin(*FUNCTION_WORDS)
    content = F.col("w").rlike(r"^\p{L}{3,}$") & (F.col("w") == F.lower("w")) & ~known
    return w.groupBy("lang").agg(F.count("*").alias("words"), F.round(F.avg(known.cast("int")), 6).alias("function_share"), F.count_if(content).alias("content"))


@query(f"""WITH v AS (SELECT lower(w) token, row_number() OVER (ORDER BY count(*) DESC, lower(w)) - 1 id FROM (SELECT unnest({DW}) w FROM documents) GROUP BY 1), n AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) w FROM part),
    t AS (SELECT p_partkey, count(*) size, min(w) w FROM n GROUP BY 1) SELECT p_partkey, id, coalesce(size, 0) pieces, id IS NOT NULL AS single FROM t LEFT JOIN v ON v.token = t.w AND size = 1""")
def single_tokens(spark, sf):
    """Part names that are one token of the documents' vocabulary, with its id: tokens by falling frequency."""
    v = read(spark, sf, "documents").select(F.explode(words()).alias("w")).groupBy(F.lower("w").alias("token")).agg(F.count("*").alias("f")).select("token", (-F.col("f")).alias("m"))
    v = od.numbered(v, ["m", "token"], "id").select("token", "id")
    t = read(spark, sf, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("ws")).select("p_partkey", F.size("ws").cast("long").alias("pieces"), F.array_min("ws").alias("token"))
    j = t.join(v, "token", "left").withColumn("id", F.when(F.col("pieces") == 1, F.col("id")))
    return j.select("p_partkey", "id", "pieces", F.col("id").isNotNull().alias("single"))


@query("""WITH d AS (SELECT doc_id, '{{Info/' || source || '|x={{' || lang || '_1}}}} ' || text t FROM documents), n AS (SELECT doc_id, list_transform(regexp_extract_all(t, '\\{\\{([^{}|]+)', 1), lambda x: replace(lower(trim(x)), '_', ' ')) n FROM d)
    SELECT doc_id, len(n) templates, n[1] "first", list_contains(n, 'en 1') english, list_any_value(list_filter(n, lambda x: starts_with(x, 'info/src1'))) IS NOT NULL excluded FROM n""")
def template_rows(spark, sf):
    """Templates of marked-up documents, and predicates on their names."""
    t = F.concat(F.lit("{{Info/"), "source", F.lit("|x={{"), "lang", F.lit("_1}}}} "), "text")
    n = read(spark, sf, "documents").select("doc_id", tx.template_names(t).alias("n"))
    return n.select("doc_id", F.size("n").cast("long").alias("templates"), F.col("n")[0].alias("first"), F.array_contains("n", "en 1").alias("english"), F.exists("n", lambda x: F.startswith(x, F.lit("info/src1"))).alias("excluded"))


@query("""WITH f AS (SELECT l_partkey, count(*) f FROM lineitem GROUP BY 1) SELECT CASE WHEN f <= 9 THEN '1-9' WHEN f <= 24 THEN '10-24' WHEN f <= 29 THEN '25-29' WHEN f = 30 THEN '30' ELSE '31+' END band, count(*) n FROM f GROUP BY 1""")
def band_labels(spark, sf):
    """Frequency bands with an open top one; a value outside closed bands is an error."""
    f = read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("f"))
    return f.select(tx.band_label(F.col("f"), [(1, 9), (10, 24), (25, 29), (30, 30), (31, 40)], open_top=True).alias("band")).groupBy("band").agg(F.count("*").alias("n"))
