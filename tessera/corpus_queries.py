"""More registered queries: text spans, contexts, quota filling, sense templates, layer sweeps and vector diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as tx
from .operators import graph as gr
from .operators import knn as kn
from .operators import order as od
from .queries import DW, KEEP, NN, PAR, kept_paragraphs, nn, query, read, seeded, verts, words
from .sources import files


# ---- spans, sentences, tokens
@query(f"WITH w AS (SELECT doc_id, unnest({DW}) w, generate_subscripts({DW}, 1) i, unnest(string_split_regex(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) gap FROM documents), s AS (SELECT doc_id, i - 1 i, w, length(w) n, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) e FROM w WHERE w IS NOT NULL) SELECT doc_id, count(*) words, sum(e)::BIGINT ends, sum(e - n)::BIGINT starts FROM s GROUP BY doc_id")
def word_spans(spark, sf):
    """Number of words and sums of their ends and starts: a word's length and the gap before it count in the end of each word from it on."""
    d = read(spark, sf, "documents").select("doc_id", words().alias("w"), F.split("text", r"(?U)\w+").alias("gap")).where(F.size("w") > 0).withColumn("n", F.size("w"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    steps = F.zip_with(F.slice("gap", F.lit(1), F.col("n")), "w", lambda g, w: F.length(g) + F.length(w))
    d = d.select("doc_id", F.col("n").cast("long").alias("words"), total(F.transform(steps, lambda x, i: x * (F.col("n") - i))).alias("ends"), total(F.transform("w", F.length)).alias("letters"))
    return d.select("doc_id", "words", "ends", (F.col("ends") - F.col("letters")).alias("starts"))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


SENTENCES = f"""{PAR}, kp AS (SELECT doc_id, i, x FROM p WHERE {KEEP}),
    sp AS (SELECT doc_id, i, string_split(regexp_replace(regexp_replace(replace(x, chr(30), ' '), '{_re2(tx.POSSIBLE_END)}', '\\1{tx.BREAK}\\2', 'g'), '{_re2(tx.NO_END)}', '\\1', 'g'), chr(30)) ps FROM kp),
    pc AS (SELECT doc_id, i, unnest(ps) piece, generate_subscripts(ps, 1) - 1 sentence FROM sp),
    ats AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, i ORDER BY sentence ROWS UNBOUNDED PRECEDING) - length(piece) + length(regexp_extract(piece, '^\\s*')) s0 FROM pc),
    sent AS (SELECT doc_id, i::INT i, sentence::INT sentence, piece, s0::BIGINT "start", (s0 + length(regexp_replace(piece, '^\\s+|\\s+$', '', 'g')))::BIGINT "end" FROM ats)"""


def _sentences(spark, sf):
    return tx.sentence_spans(kept_paragraphs(spark, sf).select("doc_id", "i", "x"), ["doc_id", "i"], "x")


@query(f'WITH {SENTENCES} SELECT doc_id, i, sentence, "start", "end" FROM sent WHERE "end" > "start"')
def sentence_table(spark, sf):
    """Sentence spans of each kept paragraph."""
    return _sentences(spark, sf).select("doc_id", "i", "sentence", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


TOKEN_AT = """tk AS (SELECT doc_id, i, unnest(string_split(x, ' ')) w, generate_subscripts(string_split(x, ' '), 1) n FROM kp),
    ta AS (SELECT doc_id, i::INT i, w, sum(length(w) + 1) OVER (PARTITION BY doc_id, i ORDER BY n ROWS UNBOUNDED PRECEDING) - length(w) - 1 pos FROM tk)"""


@query(f"""WITH {SENTENCES}, {TOKEN_AT}, j AS (SELECT ta.doc_id, ta.i, ta.pos, max(sentence) s FROM ta JOIN sent ON sent.doc_id = ta.doc_id AND sent.i = ta.i AND sent."start" <= ta.pos WHERE lower(w) = 'the' GROUP BY ALL)
    SELECT doc_id, i, pos::BIGINT pos, s sentence FROM j""")
def sentence_index(spark, sf):
    """The sentence of each 'the': the last that starts at or before it. Words and sentence starts are one sorted stream, and the latest start goes with each word."""
    k = kept_paragraphs(spark, sf).select("doc_id", "i", F.posexplode(F.split("x", " ")).alias("n", "w"))
    pos = F.sum(F.length("w") + 1).over(Window.partitionBy("doc_id", "i").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - F.length("w") - 1
    t = k.withColumn("pos", pos).where(F.lower("w") == "the").select("doc_id", "i", F.col("pos").cast("long").alias("pos"), F.lit(None).cast("int").alias("sentence"), F.lit(1).alias("kind"))
    s = _sentences(spark, sf).select("doc_id", "i", F.col("start").cast("long").alias("pos"), "sentence", F.lit(0).alias("kind"))
    w = Window.partitionBy("doc_id", "i").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return s.unionByName(t).withColumn("sentence", F.last("sentence", ignorenulls=True).over(w)).where("kind = 1").select("doc_id", "i", "pos", "sentence")


@query(f"""WITH {SENTENCES}, {TOKEN_AT} SELECT ta.doc_id, ta.i, ta.pos::BIGINT pos, sentence, w FROM ta JOIN sent ON sent.doc_id = ta.doc_id AND sent.i = ta.i AND sent."start" = ta.pos""")
def annotation_join(spark, sf):
    """The word at each sentence's start: a join on the key (document, paragraph, place)."""
    k = kept_paragraphs(spark, sf).select("doc_id", "i", F.posexplode(F.split("x", " ")).alias("n", "w"))
    pos = F.sum(F.length("w") + 1).over(Window.partitionBy("doc_id", "i").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - F.length("w") - 1
    t = k.withColumn("pos", pos.cast("long")).select("doc_id", "i", "pos", "w")
    return t.join(_sentences(spark, sf).select("doc_id", "i", F.col("start").cast("long").alias("pos"), "sentence"), ["doc_id", "i", "pos"])


@query()
def token_table(spark, sf):
    """Tokens of each category by a tokenizer file, and how many have more of their word after them."""
    import public_tokenizers

    t = tx.token_rows(read(spark, sf, "documents").where("text is not null"), public_tokenizers.path("byte_bpe_50k.json"))
    return t.groupBy("category").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("continues"), F.col("n")).otherwise(0)).alias("continued"))


@query("WITH k AS (SELECT doc_id, string_split(text, ' ') ws FROM documents), o AS (SELECT doc_id, i FROM (SELECT doc_id, unnest(ws) w, generate_subscripts(ws, 1) i FROM k) WHERE lower(w) = 'the') SELECT doc_id, (i - 1)::INT i, array_to_string(list_concat(list_concat(ws[greatest(i - 8, 1):i - 1], ['«' || ws[i] || '»']), ws[i + 1:i + 8]), ' ') context FROM o JOIN k USING (doc_id)")
def keyword_in_context(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("ws"))
    at = F.filter(F.transform("ws", lambda w, i: F.when(F.lower(w) == "the", i)), lambda i: i.isNotNull())
    found = F.transform(at, lambda i: F.struct(i.alias("i"), tx.context(F.col("ws"), i).alias("context")))  # hits leave their row with their words only
    return d.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.i", "f.context")


@query("""WITH o AS (SELECT doc_id, text, strpos(text, ' the ') s FROM documents), c AS (SELECT doc_id, s, substring(text, greatest(s - 39, 1), least(s, 40)) b, substring(text, s + 5, 40) a, length(text) n FROM o WHERE s > 0)
    SELECT doc_id, CASE WHEN s > 40 THEN '…' || regexp_replace(b, '^\\S*\\s', '') ELSE b END "left", CASE WHEN n - s - 4 > 40 THEN regexp_replace(a, '\\s\\S*\\z', '') || '…' ELSE a END "right" FROM c""")
def character_context(spark, sf):
    """Text around the first ' the ' of each document, forty characters a side, cut at spaces."""
    d = read(spark, sf, "documents").select("doc_id", "text", F.locate(" the ", "text").alias("s")).where("s > 0")
    left, right = tx.windowed(F.col("text"), F.col("s"), F.col("s") + 4, 40)
    return d.select("doc_id", left.alias("left"), right.alias("right"))


def _tidy_sql(x: str) -> str:
    for pattern, new in tx.TIDY:
        x = f"regexp_replace({x}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    return f"trim({x})"


@query(f"SELECT doc_id, md5({_tidy_sql('text')}) digest, length({_tidy_sql('text')}) n FROM documents")
def tidy_text(spark, sf):
    t = read(spark, sf, "documents").select("doc_id", tx.tidy(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query(f"WITH c AS (SELECT lower(w) token, count(*) n FROM (SELECT unnest({DW}) w FROM documents) GROUP BY 1), s AS (SELECT lower(w) token, count(*) n FROM (SELECT unnest({DW}) w FROM conversations) GROUP BY 1) SELECT token, c.n f_corpus, coalesce(s.n, 0) f_sample FROM c LEFT JOIN s USING (token)")
def vocabulary_rows(spark, sf):
    """Frequencies of each type in the corpus and in a second table: one count over the union instead of a join."""
    both = None
    for i, name in enumerate(("documents", "conversations")):
        one = read(spark, sf, name).select(F.explode(words()).alias("w")).select(F.lower("w").alias("token"), F.lit(1 - i).alias("c"), F.lit(i).alias("s"))
        both = one if both is None else both.unionAll(one)
    return both.groupBy("token").agg(F.sum("c").alias("f_corpus"), F.sum("s").alias("f_sample")).where("f_corpus > 0")


# ---- sampling with limits
def _turn(*keys, seed="7"):
    order = [F.md5(F.concat_ws("|", F.lit(seed), "l_partkey", "l_orderkey", "l_linenumber")), "l_orderkey", "l_linenumber"]
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


LINE_ORDER = "md5(concat_ws('|', '7', l_partkey, l_orderkey, l_linenumber)), l_orderkey, l_linenumber"
QUOTA = f"WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag, l_suppkey ORDER BY {LINE_ORDER}) x FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY {LINE_ORDER}) y FROM a WHERE x <= 3), c AS (SELECT *, count(*) OVER (PARTITION BY l_partkey, l_returnflag) n FROM b WHERE y <= 8), w AS (SELECT l_partkey FROM c GROUP BY 1 HAVING count(DISTINCT CASE WHEN n >= 4 THEN l_returnflag END) >= 2), q AS (SELECT c.* FROM c JOIN w USING (l_partkey))"


def _quota(spark, sf):
    """Lines by part (word) and flag (theme): at most 3 a supplier (article) and 8 a theme; a word stays if two themes reach 4."""
    c = read(spark, sf, "lineitem").withColumn("x", _turn("l_partkey", "l_returnflag", "l_suppkey")).where("x <= 3").withColumn("y", _turn("l_partkey", "l_returnflag")).where("y <= 8")
    n = c.withColumn("n", F.count("*").over(Window.partitionBy("l_partkey", "l_returnflag")))
    word = n.groupBy("l_partkey").agg(F.count_distinct(F.when(F.col("n") >= 4, F.col("l_returnflag"))).alias("themes")).where("themes >= 2").select("l_partkey")
    return n.join(word, "l_partkey", "left_semi")


@query(f"{QUOTA} SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber, y::INT turn FROM q")
def quota_fill(spark, sf):
    return _quota(spark, sf).select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber", F.col("y").alias("turn"))


@query(f"{QUOTA}, r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY y, l_returnflag) z FROM q) SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber, z::INT place FROM r WHERE z <= 6")
def sense_template(spark, sf):
    """Six occurrences a word for annotation, the themes in turn."""
    z = F.row_number().over(Window.partitionBy("l_partkey").orderBy("y", "l_returnflag"))
    return _quota(spark, sf).withColumn("place", z).where("place <= 6").select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber", "place")


@query(f"WITH {PAR}, k AS (SELECT doc_id, lang, i FROM p WHERE {KEEP}), g AS (SELECT lang, doc_id FROM k GROUP BY 1, 2 HAVING count(*) >= 2), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', '7', doc_id)), doc_id) t FROM g) WHERE t <= 20) SELECT lang, doc_id, i::INT i FROM (SELECT k.lang, doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY md5(concat_ws('|', '7', doc_id, i)), i) u FROM k JOIN d USING (lang, doc_id)) WHERE u <= 2")
def core_selection(spark, sf):
    """Twenty documents of two paragraphs or more in each language, two paragraphs of each."""
    k = kept_paragraphs(spark, sf).select("doc_id", "lang", "i")
    g = k.groupBy("lang", "doc_id").agg(F.count("*").alias("n")).where("n >= 2")
    d = g.withColumn("t", F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.concat_ws("|", F.lit("7"), "doc_id")), "doc_id"))).where("t <= 20").select("lang", "doc_id")
    u = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.md5(F.concat_ws("|", F.lit("7"), "doc_id", "i")), "i"))
    return k.join(d, ["lang", "doc_id"]).withColumn("u", u).where("u <= 2").select("lang", "doc_id", "i")


@query("WITH s AS (SELECT l_orderkey, CASE WHEN min(l_linestatus) <> max(l_linestatus) THEN 'P' ELSE min(l_linestatus) END now FROM lineitem GROUP BY 1) SELECT o_orderkey, o_orderstatus was, coalesce(now, 'missing') now FROM orders LEFT JOIN s ON l_orderkey = o_orderkey WHERE o_orderstatus <> coalesce(now, 'missing')")
def rebuild_changes(spark, sf):
    """Rows whose outcome changes when a manifest's column is derived again."""
    now = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.when(F.min("l_linestatus") != F.max("l_linestatus"), "P").otherwise(F.min("l_linestatus")).alias("now"))
    j = read(spark, sf, "orders").join(now, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("now", F.coalesce("now", F.lit("missing")))
    return j.where("o_orderstatus <> now").select("o_orderkey", F.col("o_orderstatus").alias("was"), "now")


# ---- layers: the first 16, 32, 48 and 64 dimensions
DEPTHS = (16, 32, 48, 64)


def _layers(spark, sf):
    """(depth, src, dst) of each layer's ten nearest neighbours."""
    e = read(spark, sf, "embeddings")
    out = None
    for d in DEPTHS:
        v = e.select(F.col("vec_id").alias("id"), F.slice("embedding", 1, d).alias("vec"))
        one = kn.neighbours(v, [kn.Pick(10)]).select(F.lit(d).alias("depth"), "src", "dst")
        out = one if out is None else out.unionAll(one)
    return gr.checkpointed(out)


def _layer_sql() -> str:
    parts = [NN(f"n{d}").replace("embedding::DOUBLE[] v", f"embedding[1:{d}]::DOUBLE[] v", 1) for d in DEPTHS]
    return ", ".join(parts) + ", ly AS (" + " UNION ALL ".join(f"SELECT {d} depth, src, dst FROM n{d}" for d in DEPTHS) + "), jj AS (SELECT a.depth, a.src, count(b.dst) / (20 - count(b.dst))::DOUBLE j FROM ly a LEFT JOIN ly b ON b.depth = a.depth - 16 AND a.src = b.src AND a.dst = b.dst WHERE a.depth > 16 GROUP BY 1, 2)"


def _steps(layers):
    """(depth, src, j): Jaccard with the layer before. One count over both layers' lists, shifted by one layer, instead of a join."""
    both = layers.unionAll(layers.withColumn("depth", F.col("depth") + 16)).where(F.col("depth").between(DEPTHS[1], DEPTHS[-1]))
    n = both.groupBy("depth", "src", "dst").agg(F.count("*").alias("n"))
    return n.groupBy("depth", "src").agg((F.sum((F.col("n") == 2).cast("int")) / F.count("*")).alias("j"))


@query(f"WITH {_layer_sql()}, dd AS (SELECT depth, avg((p.label = q.label)::INT) d FROM ly JOIN embeddings p ON p.vec_id = src JOIN embeddings q ON q.vec_id = dst GROUP BY 1) SELECT depth, round(any_value(d), 6) d, round(avg(j), 6) j FROM dd LEFT JOIN jj USING (depth) GROUP BY depth")
def layer_sweep(spark, sf):
    ly, v = _layers(spark, sf), verts(spark, sf)
    d = ly.join(v.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").groupBy("depth").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("d"))
    return d.join(_steps(ly).groupBy("depth").agg(F.round(F.avg("j"), 6).alias("j")), "depth", "left")


@query(f"WITH {_layer_sql()}, s AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY j, depth) k FROM jj) SELECT depth, round(avg(j), 6) mean, round(median(j), 6) median, round(avg((k = 1)::INT), 6) smallest FROM s GROUP BY depth")
def transitions_table(spark, sf):
    """Each step between layers: mean and median Jaccard, share of rows whose smallest Jaccard is here, the first on ties."""
    j = _steps(_layers(spark, sf)).withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("j", "depth")))
    return j.groupBy("depth").agg(F.round(F.avg("j"), 6).alias("mean"), F.round(F.median("j"), 6).alias("median"), F.round(F.avg((F.col("k") == 1).cast("int")), 6).alias("smallest"))


def _seed(i):
    return NN(f"r{i}", order=f"md5(concat_ws('|', '7|L01|10|{i}', src, dst)), dst", eps="0.05")


@query("WITH " + ", ".join(_seed(i) for i in range(4)) + ", f AS (" + " UNION ALL ".join(f"SELECT vec_id, count(r{b}.dst) / (20 - count(r{b}.dst))::DOUBLE j FROM embeddings JOIN r{a} ON r{a}.src = vec_id LEFT JOIN r{b} ON r{b}.src = r{a}.src AND r{b}.dst = r{a}.dst GROUP BY vec_id" for a, b in ((0, 1), (2, 3))) + ") SELECT vec_id id, round(avg(j), 9) floor FROM f GROUP BY vec_id")
def noise_floor_pairs(spark, sf):
    """Mean Jaccard over the disjoint seed pairs (0, 1) and (2, 3)."""
    out = seeded(spark, sf, 4).select(F.floor(F.col("pick") / 2).alias("pair"), "src", "dst")
    n = out.groupBy("pair", "src", "dst").agg(F.count("*").alias("n"))
    j = n.groupBy("pair", "src").agg((F.sum((F.col("n") == 2).cast("int")) / F.count("*")).alias("j"))
    return j.groupBy(F.col("src").alias("id")).agg(F.round(F.avg("j"), 9).alias("floor"))


HEX = "('0x' || substr(md5('7|' || {s} || i), 1, 8))::BIGINT"


@query(f"WITH n AS (SELECT count(*) n FROM embeddings), r AS (SELECT vec_id, embedding::DOUBLE[] v, row_number() OVER (ORDER BY vec_id) - 1 p FROM embeddings), q AS (SELECT i, {HEX.format(s=repr('a|'))} % n a, {HEX.format(s=repr('b|'))} % (n - 1) b FROM range(2000) t(i), n) SELECT i pair, x.vec_id a, y.vec_id b, round(list_cosine_similarity(x.v, y.v), 6) sim FROM q JOIN r x ON x.p = a JOIN r y ON y.p = b + (b >= a)::INT")
def random_pair_cosines(spark, sf):
    """2,000 seeded pairs of distinct rows. Only ids are numbered, by a window that sees no vectors; vectors are joined by id."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), kn.unit(F.col("embedding").cast("array<double>")).alias("u"))
    ids = gr.checkpointed(od.numbered(e.select("id"), ["id"], "p"))
    n = ids.count()
    draw = lambda s: F.conv(F.substring(F.md5(F.concat(F.lit(f"7|{s}|"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")
    q = spark.range(2000).select(F.col("id").alias("pair"), (draw("a") % n).alias("x"), (draw("b") % (n - 1)).alias("y")).withColumn("y", F.col("y") + (F.col("y") >= F.col("x")).cast("int"))
    for name in ("x", "y"):
        side = ids.join(e, "id").select(F.col("p").alias(name), F.col("id").alias(f"id_{name}"), F.col("u").alias(f"u_{name}"))
        q = q.join(side, name)
    return q.select("pair", F.col("id_x").alias("a"), F.col("id_y").alias("b"), F.round(F.aggregate(F.zip_with("u_x", "u_y", lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t), 6).alias("sim"))


@query("(SELECT vec_id, label, 'left' side FROM embeddings EXCEPT ALL SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN -1 ELSE label END, 'left' FROM embeddings) UNION ALL (SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN -1 ELSE label END, 'right' FROM embeddings EXCEPT ALL SELECT vec_id, label, 'right' FROM embeddings)")
def table_difference(spark, sf):
    """Rows that differ between a table and a version with changed labels."""
    e = read(spark, sf, "embeddings").select("vec_id", "label")
    return files.difference(e, e.withColumn("label", F.when(F.col("vec_id") % 7 == 3, F.lit(-1)).otherwise(F.col("label"))))


@query(f"""WITH {NN()} SELECT 0 part, '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><graph edgedefault="directed">' line
    UNION ALL SELECT 1, '<node id="n' || vec_id || '"><data key="label">' || label || '</data></node>' FROM embeddings
    UNION ALL SELECT 2, '<edge source="n' || src || '" target="n' || dst || '"/>' FROM nn UNION ALL SELECT 3, '</graph></graphml>'""")
def graphml_export(spark, sf):
    """Lines of the GraphML document of the neighbour graph."""
    return files.graphml_lines(verts(spark, sf), nn(spark, sf).select("src", "dst"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE v FROM embeddings), p AS (SELECT vec_id, v, power(2, floor(log2(abs(v))) - 7) u FROM x WHERE v <> 0)
    SELECT vec_id, round(max(abs(v - round_even(v / u, 0) * u) / abs(v)), 9) error FROM p GROUP BY vec_id""")
def bf16_error(spark, sf):
    """Largest relative error of packing each vector to bfloat16 and back; never above 2**-8."""
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"), files.bf16_floats(files.bf16_bits("embedding")).cast("array<double>").alias("b"))
    return e.select("vec_id", F.round(F.array_max(F.zip_with("a", "b", lambda a, b: F.when(a == 0, 0.0).otherwise(F.abs(a - b) / F.abs(a)))), 9).alias("error"))
