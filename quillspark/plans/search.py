"""Queries of text functions, term statistics and full-text search, on documents and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..functions import text as X
from ..operators import fts, latent, termstats
from .registry import register

TOK = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s-]', ' ', 'g'), '\s+'), lambda t: len(t) >= 2)"
POSTS = f"posts AS (SELECT doc_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT doc_id, {TOK} AS t FROM documents))"
TF = "tf AS (SELECT doc_id, term, count(*) AS tf FROM posts GROUP BY doc_id, term)"
VOCAB = "vocab AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term)"
STOP = ["the", "and", "of", "to", "in", "that", "it", "is", "was", "for"]
STOP_SQL = ", ".join(f"'{s}'" for s in STOP)


QUERY = f"q AS (SELECT item_id AS query_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS place FROM (SELECT item_id, {TOK} AS t FROM benchmark))"
_BUILT: dict[tuple, fts.Index] = {}


def docs(s, d):
    return table(s, d, "documents")


def stamp(s, path: str) -> tuple[int, int]:
    """Length and time of what is at a path: an index of it is good for as long as they stay."""
    p = s._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(s._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()


def index(s, d) -> fts.Index:
    """The index of a folder's documents: built by the first query of a session that needs it, read by all others."""
    key = (s.sparkContext.applicationId, d, *stamp(s, f"{d}/documents.parquet"))
    if key not in _BUILT:
        _BUILT[key] = fts.build(docs(s, d), fields=("source", "lang"))
    return _BUILT[key]


def asked(s, d):
    return fts.query_terms(table(s, d, "benchmark"))


# Text

register(
    "segment_text",
    lambda s, d: docs(s, d).select("doc_id", F.posexplode(X.segments(F.col("text"), 200)).alias("i", "segment")).select("doc_id", F.col("i").cast("long").alias("part"), F.md5("segment").alias("digest")),
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(0, (len(w) + 199) // 200)) AS part FROM w)
    SELECT doc_id, part, md5(array_to_string(w[part * 200 + 1:part * 200 + 200], ' ')) AS digest FROM p""",
)
register(
    "normalize",
    lambda s, d: docs(s, d).select("doc_id", F.md5(X.normalized(F.col("text"))).alias("digest"), X.contains_to_word_end(F.col("text"), F.lit("with")).alias("has_with")),
    r"""WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\-\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, md5(t) AS digest, instr(t, 'with') > 0 AND substr(t, instr(t, 'with') + 4, 1) IN ('', ' ') AS has_with FROM n""",
)
# The spelling rules, in order.
SPELLINGS = [
    ("neighbors", "neighbours"), ("neighbor", "neighbour"), ("saviors", "saviours"), ("savior", "saviour"), ("honored", "honoured"), ("honoring", "honouring"),
    ("honors", "honours"), ("honor", "honour"), ("favored", "favoured"), ("favors", "favours"), ("favor", "favour"), ("labored", "laboured"),
    ("labors", "labours"), ("labor", "labour"), ("armors", "armours"), ("armor", "armour"), ("colors", "colours"), ("color", "colour"),
]
MADE = [f"The {a.title()} of {a}s and {a.upper()}, in un{a} " for a, _ in SPELLINGS]


def respelled(s, d):
    """Query texts in which every American spelling stands alone, in another case, and inside a word."""
    t = table(s, d, "benchmark").select("item_id", F.concat(F.element_at(F.array(*map(F.lit, MADE)), (F.col("item_id") % len(MADE) + 1).cast("int")), F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("item_id", F.substring(X.respelled(F.col("t"), SPELLINGS), 1, 80).alias("spelled"), F.md5(X.respelled(F.col("t"), SPELLINGS)).alias("digest"))


_MADE_SQL = "[" + ", ".join(f"'{m}'" for m in MADE) + "]"
_SPELLED = "".join("regexp_replace(" for _ in SPELLINGS) + "t" + "".join(rf", '\b{a}\b', '{b}', 'gi')" for a, b in SPELLINGS)
register("spelling", respelled, f"WITH m AS (SELECT item_id, {_MADE_SQL}[item_id % {len(MADE)} + 1] || coalesce(text, '') AS t FROM benchmark) SELECT item_id, substr({_SPELLED}, 1, 80) AS spelled, md5({_SPELLED}) AS digest FROM m")
register("slug", lambda s, d: table(s, d, "part").select("p_partkey", X.slug("p_name").alias("slug")), "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")


def ref_parse(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.concat(F.element_at(F.array(F.lit("1 ne"), F.lit("Gen"), F.lit("Unknown Book")), (F.col("o_orderkey") % 3 + 1).cast("int")), F.element_at(F.array(F.lit(" {c} {v}"), F.lit(" {c}:{v}"), F.lit(" {c}"), F.lit("")), (F.col("o_custkey") % 4 + 1).cast("int"))).alias("t"))
    t = F.replace(F.replace("t", F.lit("{c}"), (F.col("o_orderkey") % 50 + 1).cast("string")), F.lit("{v}"), (F.col("o_orderkey") % 30 + 1).cast("string"))
    r = X.reference(t, {"1 ne": "1 Nephi", "gen": "Genesis"})
    return o.select("o_orderkey", r["book"].alias("book"), r["chapter"].alias("chapter"), r["verse"].alias("verse"))


register(
    "ref_parse",
    ref_parse,
    r"""WITH t AS (SELECT o_orderkey, replace(replace(['1 ne', 'Gen', 'Unknown Book'][o_orderkey % 3 + 1] || [' {c} {v}', ' {c}:{v}', ' {c}', ''][o_custkey % 4 + 1],
      '{c}', (o_orderkey % 50 + 1)::VARCHAR), '{v}', (o_orderkey % 30 + 1)::VARCHAR) AS t FROM orders),
    f AS (SELECT o_orderkey, t, CASE lower(regexp_extract(t, '^(.+?)\s+(\d+)\s+(\d+)$', 1)) WHEN '1 ne' THEN '1 Nephi' WHEN 'gen' THEN 'Genesis' END AS known FROM t),
    g AS (SELECT *, CASE WHEN known IS NOT NULL THEN '^(.+?)\s+(\d+)\s+(\d+)$' WHEN regexp_matches(t, '^(.+?)\s+(\d+):(\d+)$') THEN '^(.+?)\s+(\d+):(\d+)$' WHEN regexp_matches(t, '^(.+?)\s+(\d+)$') THEN '^(.+?)\s+(\d+)$' END AS kind FROM f),
    p AS (SELECT o_orderkey, CASE WHEN known IS NOT NULL THEN regexp_extract_all(t, '^(.+?)\s+(\d+)\s+(\d+)$', 1)[1] WHEN kind LIKE '%:%' THEN regexp_extract(t, '^(.+?)\s+(\d+):(\d+)$', 1) WHEN kind IS NOT NULL THEN regexp_extract(t, '^(.+?)\s+(\d+)$', 1) END AS b,
      CASE WHEN known IS NOT NULL THEN regexp_extract(t, '^(.+?)\s+(\d+)\s+(\d+)$', 2) WHEN kind LIKE '%:%' THEN regexp_extract(t, '^(.+?)\s+(\d+):(\d+)$', 2) WHEN kind IS NOT NULL THEN regexp_extract(t, '^(.+?)\s+(\d+)$', 2) END AS c,
      CASE WHEN known IS NOT NULL THEN regexp_extract(t, '^(.+?)\s+(\d+)\s+(\d+)$', 3) WHEN kind LIKE '%:%' THEN regexp_extract(t, '^(.+?)\s+(\d+):(\d+)$', 3) END AS v FROM g)
    SELECT o_orderkey, CASE lower(b) WHEN '1 ne' THEN '1 Nephi' WHEN 'gen' THEN 'Genesis' ELSE b END AS book, c::INT AS chapter, v::INT AS verse FROM p""",
)
register(
    "html_extract",
    lambda s, d: table(s, d, "pages").select(
        "page_id",
        F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_count("html", F.lit(r'(?i)<a\s+href="')).cast("long").alias("n_links"),
        F.length(X.stripped(F.col("html"))).cast("long").alias("n_text"),
    ),
    r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a\s+href="'))::BIGINT AS n_links,
    len(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')))::BIGINT AS n_text FROM pages""",
)
register(
    "sentences",
    lambda s, d: docs(s, d).select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(X.sentences(F.col("text")), "|")).alias("digest")),
    r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]\s+'), lambda x: trim(x))[2:], lambda x: len(x) BETWEEN 50 AND 180) AS p FROM documents)
    SELECT doc_id, len(p)::BIGINT AS n, md5(array_to_string(p, '|')) AS digest FROM p""",
)
register(
    "token_hash",
    lambda s, d: index(s, d).vocab.select("term", X.token_hash(F.col("term")).alias("bucket")),
    f"""WITH {POSTS}, v AS (SELECT DISTINCT term FROM posts),
    h AS (SELECT term, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(term, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM v)
    SELECT term, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 30000 + 1000 AS bucket FROM h""",
)
register(
    "short_stems",
    lambda s, d: index(s, d).vocab.select("term", X.short_stem(F.col("term")).alias("stem")),
    f"""WITH {POSTS}, v AS (SELECT DISTINCT term FROM posts)
    SELECT term, CASE """ + " ".join(f"WHEN term LIKE '%{e}' THEN substr(term, 1, len(term) - {len(e)})" for e in X.ENDINGS) + " WHEN term LIKE '%s' AND len(term) > 3 THEN substr(term, 1, len(term) - 1)" + " ELSE term END AS stem FROM v",
)

# Term statistics

register("vocab", lambda s, d: index(s, d).vocab, f"WITH {POSTS}, {TF}, {VOCAB} SELECT * FROM vocab")
register("idf", lambda s, d: termstats.inverse_document_frequency(index(s, d)), f"WITH {POSTS}, {TF}, {VOCAB} SELECT term, df, round(ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1, 6) AS idf FROM vocab")
BIGRAMS = f"""pairs AS (SELECT doc_id, term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM posts),
    bi AS (SELECT doc_id, term || ' ' || next AS bigram, count(*) AS n FROM pairs WHERE next IS NOT NULL AND NOT (term IN ({STOP_SQL}) AND next IN ({STOP_SQL})) GROUP BY ALL)"""
register("bigrams", lambda s, d: termstats.bigrams(index(s, d), STOP, 3), f"WITH {POSTS}, {BIGRAMS} SELECT bigram, sum(n)::BIGINT AS cf, count(*) AS df FROM bi GROUP BY bigram HAVING count(*) >= 3")
LLR = """llr AS (SELECT term, df, round(2 * (df * ln(df / e) + CASE WHEN n - df > 0 AND n - e > 0 THEN (n - df) * ln((n - df) / (n - e)) ELSE 0 END), 4) AS llr, round(cf / df, 4) AS burstiness
      FROM (SELECT term, df::DOUBLE AS df, cf, (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT count(*) FROM documents)::DOUBLE * cf / (SELECT sum(cf) FROM vocab)::DOUBLE AS e FROM vocab))"""
register("llr", lambda s, d: termstats.log_likelihood(index(s, d)), f"WITH {POSTS}, {TF}, {VOCAB}, {LLR} SELECT term, df::BIGINT AS df, llr, burstiness FROM llr")
NPMI = """kept AS (SELECT tf.doc_id, tf.term, v.df FROM tf JOIN vocab v ON v.term = tf.term WHERE v.df BETWEEN 5 AND 20000),
    ids AS (SELECT term, df, row_number() OVER () AS t FROM vocab WHERE df BETWEEN 5 AND 20000), num AS (SELECT doc_id, t FROM kept JOIN ids USING (term)),
    co AS (SELECT x.term AS a, y.term AS b, x.df AS da, y.df AS db, c FROM (SELECT a.t AS t, b.t AS u, count(*) AS c FROM num a JOIN num b ON a.doc_id = b.doc_id AND a.t < b.t GROUP BY a.t, b.t HAVING count(*) >= 3) p JOIN ids x ON x.t = p.t JOIN ids y ON y.t = p.u),
    sc AS (SELECT a, b, c, round(log2((c / n) / ((da / n) * (db / n))) / -log2(c / n), 6) AS npmi FROM (SELECT *, (SELECT count(*) FROM documents)::DOUBLE AS n FROM co)),
    bothways AS (SELECT a AS term, b AS assoc, npmi, c AS cooccur FROM sc WHERE npmi > 0.05 UNION ALL SELECT b, a, npmi, c FROM sc WHERE npmi > 0.05),
    assoc AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY npmi DESC, assoc)::INT AS rank FROM bothways QUALIFY rank <= 10)"""
associations = lambda s, d: termstats.associations(index(s, d))
register("npmi_top10", associations, f"WITH {POSTS}, {TF}, {VOCAB}, {NPMI} SELECT * FROM assoc")
PHRASE_NPMI = """bb AS (SELECT bigram, count(*) AS df FROM bi GROUP BY bigram HAVING count(*) BETWEEN 10 AND 20000 ORDER BY df DESC, bigram LIMIT 5000),
    wb AS (SELECT kept.term, bi.bigram, kept.df AS da, bb.df AS db, count(*) AS c FROM bi JOIN bb USING (bigram) JOIN kept ON kept.doc_id = bi.doc_id GROUP BY ALL HAVING count(*) >= 3),
    ws AS (SELECT term, bigram, c, round(log2((c / n) / ((da / n) * (db / n))) / -log2(c / n), 6) AS npmi FROM (SELECT *, (SELECT count(*) FROM documents)::DOUBLE AS n FROM wb)),
    al AS (SELECT term, assoc, npmi, cooccur FROM bothways UNION ALL SELECT term, bigram, npmi, c FROM ws WHERE npmi > 0.05 UNION ALL SELECT bigram, term, npmi, c FROM ws WHERE npmi > 0.05)"""
register("npmi_phrases", lambda s, d: termstats.phrase_associations(index(s, d), STOP), f"WITH {POSTS}, {TF}, {VOCAB}, {BIGRAMS}, {NPMI}, {PHRASE_NPMI} SELECT *, row_number() OVER (PARTITION BY term ORDER BY npmi DESC, assoc)::INT AS rank FROM al QUALIFY rank <= 10")
register("tfidf_sublinear", lambda s, d: termstats.tf_idf(index(s, d)), f"WITH {POSTS}, {TF}, {VOCAB} SELECT tf.doc_id, tf.term, round((1 + ln(tf.tf)) * (ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (v.df + 1.0::DOUBLE)) + 1), 6) AS weight FROM tf JOIN vocab v ON v.term = tf.term WHERE v.df BETWEEN 3 AND 30000")



def tfidf_svd(s, d):
    """Documents among the first 100 directions of their weighted terms."""
    cells = termstats.tf_idf(index(s, d)).select(F.col("doc_id").alias("row"), F.col("term").alias("col"), F.col("weight").alias("w"))
    found = latent.factor(cells)
    return latent.embedded(found) if found else s.createDataFrame([], "id long, v array<double>")


register("tfidf_svd", tfidf_svd)

# Full-text search

BM25 = """lens AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id),
    sz AS (SELECT count(*) AS n, avg(len) AS mean FROM lens),
    sco AS (SELECT q.query_id, tf.doc_id, round(sum(ln(1 + (sz.n - v.df + 0.5::DOUBLE) / (v.df + 0.5::DOUBLE)) * tf.tf * 2.2::DOUBLE / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.len / sz.mean))), 6) AS score
      FROM (SELECT DISTINCT query_id, term FROM q) q JOIN tf ON tf.term = q.term JOIN vocab v ON v.term = tf.term JOIN lens l ON l.doc_id = tf.doc_id, sz GROUP BY ALL),
    best AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM sco QUALIFY rank <= 10)"""
bm25_topk = lambda s, d: fts.bm25(index(s, d), asked(s, d))
register("bm25_topk", bm25_topk, f"WITH {POSTS}, {TF}, {VOCAB}, {QUERY}, {BM25} SELECT * FROM best")
FIELD_TOK = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({f}, '')), '[^a-z0-9\s-]', ' ', 'g'), '\s+'), lambda t: len(t) >= 1)"
FIELDS = " UNION ALL ".join(f"SELECT doc_id, unnest({FIELD_TOK.format(f=f)}) AS term, {w}.0::DOUBLE AS w FROM documents" for f, w in (("source", 5), ("lang", 1)))
register(
    "bm25_fields",
    lambda s, d: fts.bm25(index(s, d), asked(s, d), weights={"text": 10.0, "source": 5.0, "lang": 1.0}),
    f"""WITH {POSTS}, {TF}, {VOCAB}, {QUERY}, lens AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id), sz AS (SELECT count(*) AS n, avg(len) AS mean FROM lens),
    ftf AS (SELECT doc_id, term, sum(w) AS tf FROM (SELECT doc_id, term, 10.0::DOUBLE AS w FROM posts UNION ALL {FIELDS}) GROUP BY ALL),
    alllens AS (SELECT d.doc_id, coalesce(len, 0) AS len FROM documents d LEFT JOIN lens USING (doc_id)),
    sco AS (SELECT q.query_id, f.doc_id, round(sum(ln(1 + (sz.n - coalesce(v.df, 0) + 0.5::DOUBLE) / (coalesce(v.df, 0) + 0.5::DOUBLE)) * f.tf * 2.2::DOUBLE / (f.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.len / sz.mean))), 6) AS score
      FROM (SELECT DISTINCT query_id, term FROM q) q JOIN ftf f ON f.term = q.term LEFT JOIN vocab v ON v.term = f.term JOIN alllens l ON l.doc_id = f.doc_id, sz GROUP BY ALL)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM sco QUALIFY rank <= 10""",
)
PHRASE = """nq AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id),
    phrase AS (SELECT DISTINCT query_id, doc_id FROM (SELECT q.query_id, p.doc_id, p.pos - q.place AS at, count(DISTINCT q.place) AS m FROM posts p JOIN q ON p.term = q.term GROUP BY ALL) JOIN nq USING (query_id) WHERE m = n)"""
register("fts_phrase", lambda s, d: fts.phrase(index(s, d), asked(s, d)), f"WITH {POSTS}, {QUERY}, {PHRASE} SELECT * FROM phrase")
ALL = """al AS (SELECT query_id, doc_id, matched FROM (SELECT q.query_id, tf.doc_id, count(*) AS matched FROM (SELECT DISTINCT query_id, term FROM q) q JOIN tf ON tf.term = q.term GROUP BY ALL)
    JOIN (SELECT query_id, count(DISTINCT term) AS n FROM q GROUP BY query_id) USING (query_id) WHERE matched = n)"""
register("fts_and", lambda s, d: fts.all_terms(index(s, d), asked(s, d)), f"WITH {POSTS}, {TF}, {QUERY}, {ALL} SELECT * FROM al")
PREFIX = """pw AS (SELECT query_id, q.term AS prefix, v.term FROM (SELECT DISTINCT query_id, term FROM q) q JOIN vocab v ON v.term[1:2] = q.term[1:2] AND starts_with(v.term, q.term)),
    pre AS (SELECT query_id, doc_id, count(DISTINCT prefix) AS matched FROM pw JOIN tf USING (term) GROUP BY ALL),
    pn AS (SELECT query_id, count(DISTINCT term) AS n FROM q GROUP BY query_id)"""
register("fts_prefix_and", lambda s, d: fts.prefixes(index(s, d), asked(s, d)), f"WITH {POSTS}, {TF}, {VOCAB}, {QUERY}, {PREFIX} SELECT pre.* FROM pre JOIN pn USING (query_id) WHERE matched = n")
register("fts_prefix_or", lambda s, d: fts.prefixes(index(s, d), asked(s, d), False).groupBy("query_id", "matched").agg(F.count("*").alias("n_docs")), f"WITH {POSTS}, {TF}, {VOCAB}, {QUERY}, {PREFIX} SELECT query_id, matched, count(*) AS n_docs FROM pre GROUP BY ALL")
LONGEST = """lo AS (SELECT query_id, term, place FROM (SELECT query_id, term, min(place) AS place FROM q GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY len(term) DESC, place) <= 4 AND count(*) OVER (PARTITION BY query_id) >= 4)"""
NEAR = """near AS (SELECT DISTINCT query_id, doc_id FROM (SELECT lo.query_id, p.doc_id, count(DISTINCT lo.term) OVER (PARTITION BY lo.query_id, p.doc_id ORDER BY p.pos RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS m
      FROM posts p JOIN lo ON p.term = lo.term) WHERE m = 4)"""
register("fts_near", lambda s, d: fts.near(index(s, d), fts.longest(asked(s, d))), f"WITH {POSTS}, {QUERY}, {LONGEST}, {NEAR} SELECT * FROM near")
INFORM = """info AS (SELECT query_id, term, place FROM (SELECT query_id, term, min(place) AS place FROM q GROUP BY ALL) JOIN vocab USING (term)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 0.1::DOUBLE * len(term) + CASE WHEN regexp_matches(term, '[0-9]') THEN 0.5 ELSE 0 END, 6) DESC, place) <= 4)"""
INFO_ALL = ALL.replace("al AS", "ial AS").replace("FROM q)", "FROM info)").replace("FROM q GROUP", "FROM info GROUP")


def content(s, d):
    """Documents with all of a query's four most telling terms; for queries of five words or more, where no document has them all, those with any."""
    i, q = index(s, d), asked(s, d)
    tell = fts.informative(i, q)
    every = fts.all_terms(i, tell)
    long_ = q.groupBy("query_id").agg(F.count("*").alias("words")).where("words >= 5").join(every.select("query_id").distinct(), "query_id", "left_anti")
    return every.withColumn("mode", F.lit("and")).unionByName(fts.all_terms(i, tell.join(long_, "query_id", "left_semi"), 1).withColumn("mode", F.lit("or")))


register("fts_content", content, f"""WITH {POSTS}, {TF}, {VOCAB}, {QUERY}, {INFORM}, {INFO_ALL}
    SELECT *, 'and' AS mode FROM ial UNION ALL SELECT query_id, doc_id, count(*), 'or' FROM info JOIN tf USING (term) WHERE query_id NOT IN (SELECT query_id FROM ial) AND query_id IN (SELECT query_id FROM q GROUP BY query_id HAVING count(*) >= 5) GROUP BY query_id, doc_id""")

# Queries of every length, so that every stage answers some: the first words of the benchmark's texts, and words that no document has.
SHORT = "CASE WHEN item_id % 5 = 0 THEN text WHEN item_id % 5 = 1 THEN 'The ' || array_to_string(string_split(text, ' ')[1:3], ' ') WHEN item_id % 5 = 2 THEN array_to_string(string_split(text, ' ')[2:4], ' ') || ' zzqx' WHEN item_id % 5 = 3 THEN substr(string_split(text, ' ')[1], 1, 4) ELSE 'zzqxw' || item_id END"


def short_queries(s, d):
    w = F.split("text", " ")
    join = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    kind = F.col("item_id") % 5
    t = F.when(kind == 0, F.col("text")).when(kind == 1, F.concat(F.lit("The "), join(1, 3))).when(kind == 2, F.concat(join(2, 3), F.lit(" zzqx"))).when(kind == 3, F.substring(w[0], 1, 4)).otherwise(F.concat(F.lit("zzqxw"), "item_id"))
    return table(s, d, "benchmark").select("item_id", t.alias("text"))


def cascade(s, d):
    hits = fts.cascade(index(s, d), docs(s, d), fts.query_terms(short_queries(s, d)))
    return hits.groupBy("query_id", "stage").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


SHORT_QUERY = f"""q0 AS (SELECT item_id AS query_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS place FROM (SELECT item_id, {TOK} AS t FROM (SELECT item_id, {SHORT} AS text FROM benchmark))),
    art AS (SELECT query_id FROM q0 WHERE place = 1 AND term IN ('the', 'a', 'an')), q AS (SELECT query_id, term, place - CASE WHEN query_id IN (SELECT * FROM art) THEN 1 ELSE 0 END AS place FROM q0 WHERE place > 1 OR query_id NOT IN (SELECT * FROM art))"""
register(
    "fts_cascade",
    cascade,
    f"""WITH {POSTS}, {TF}, {VOCAB}, {SHORT_QUERY}, {PHRASE}, {ALL}, {LONGEST}, {NEAR}, {INFORM}, {INFO_ALL}, wc AS (SELECT query_id, count(*) AS words FROM q GROUP BY query_id),
    early AS (SELECT query_id, doc_id, 1 AS stage FROM phrase UNION ALL SELECT query_id, doc_id, 2 FROM al UNION ALL SELECT query_id, doc_id, 3 FROM near UNION ALL SELECT query_id, doc_id, 4 FROM ial
      UNION ALL SELECT DISTINCT query_id, doc_id, 5 FROM info JOIN tf USING (term) WHERE query_id IN (SELECT query_id FROM wc WHERE words >= 5)
      UNION ALL SELECT DISTINCT query_id, doc_id, 6 FROM q JOIN tf USING (term) WHERE query_id IN (SELECT query_id FROM wc WHERE words < 5)
      UNION ALL SELECT DISTINCT query_id, doc_id, 7 FROM q JOIN vocab v ON starts_with(v.term, q.term) JOIN tf ON tf.term = v.term WHERE query_id IN (SELECT query_id FROM wc WHERE words = 1)),
    hits AS (SELECT * FROM early UNION ALL SELECT query_id, doc_id, 8 FROM (SELECT query_id, list(DISTINCT term) AS w FROM q WHERE query_id NOT IN (SELECT query_id FROM early) GROUP BY query_id) JOIN documents ON len(list_filter(w, lambda x: NOT contains(lower(coalesce(text, '')), x))) = 0),
    f AS (SELECT * FROM hits QUALIFY stage = min(stage) OVER (PARTITION BY query_id))
    SELECT query_id, stage, count(*) AS n_docs, min(doc_id) AS first_doc FROM f GROUP BY ALL""",
)


def weights(s, d):
    return termstats.term_weights(index(s, d), asked(s, d))


RAW = """wraw AS (SELECT query_id, term, ln(coalesce(llr, 0) + 1) / 2 + 0.3::DOUBLE * least(coalesce(burstiness, 0), 5) + 0.5::DOUBLE * coalesce(idf, 1) AS raw
      FROM (SELECT DISTINCT query_id, term FROM q) LEFT JOIN llr USING (term) LEFT JOIN (SELECT term, round(ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1, 6) AS idf FROM vocab) USING (term))"""
WEIGHTS = f"{RAW}, wt AS (SELECT query_id, term, round(raw / sum(raw) OVER (PARTITION BY query_id), 6) AS weight FROM wraw)"
WBASE = f"{POSTS}, {TF}, {VOCAB}, {QUERY}, {LLR}, {WEIGHTS}"
register("term_weights", weights, f"WITH {WBASE} SELECT * FROM wt")
register("damped_weights", lambda s, d: termstats.damped_weights(index(s, d), asked(s, d)), f"""WITH {POSTS}, {TF}, {VOCAB}, {QUERY}, {LLR}, {RAW}, dq AS (SELECT DISTINCT query_id, term FROM q), wd AS (SELECT * FROM dq WHERE len(term) > 2),
    pr AS (SELECT a.query_id, a.term, b.term AS other FROM dq a JOIN wd b ON a.query_id = b.query_id AND a.term <> b.term), qt AS (SELECT doc_id, term FROM tf WHERE term IN (SELECT term FROM dq)),
    co AS (SELECT a, b, count(*) AS c FROM (SELECT DISTINCT least(term, other) AS a, greatest(term, other) AS b FROM pr) p JOIN qt x ON x.term = p.a JOIN qt y ON y.term = p.b AND y.doc_id = x.doc_id GROUP BY a, b),
    pm AS (SELECT a, b, log2((c / n) / ((x.df / n) * (y.df / n))) / -log2(c / n) AS pmi FROM co JOIN vocab x ON x.term = a JOIN vocab y ON y.term = b, (SELECT count(*)::DOUBLE AS n FROM documents)),
    bd AS (SELECT query_id, term, sum(pmi) AS pmi FROM pr JOIN pm ON a = least(term, other) AND b = greatest(term, other) WHERE pmi > 0 GROUP BY ALL), mw AS (SELECT query_id, count(*) AS words FROM wd GROUP BY query_id),
    dr AS (SELECT w.query_id, w.term, raw * round(CASE WHEN coalesce(words, 0) < 2 THEN 1 ELSE greatest(0.15::DOUBLE, 1 / (1 + exp(-(coalesce(pmi, 0) / (words - 1) - 2)))) END, 6) AS raw FROM wraw w LEFT JOIN bd ON bd.query_id = w.query_id AND bd.term = w.term LEFT JOIN mw ON mw.query_id = w.query_id)
    SELECT query_id, term, round(raw / sum(raw) OVER (PARTITION BY query_id), 6) AS weight FROM dr""")
COVER = """cov AS (SELECT query_id, doc_id, round(sum(weight) / any_value(total), 6) AS coverage FROM tf JOIN wt USING (term) JOIN (SELECT query_id, sum(weight) AS total FROM wt GROUP BY query_id) USING (query_id) GROUP BY query_id, doc_id)"""
register("coverage", lambda s, d: fts.coverage(index(s, d), weights(s, d)), f"WITH {WBASE}, {COVER} SELECT * FROM cov")
register(
    "cooccurrence",
    lambda s, d: fts.pair_share(fts.matched(index(s, d), asked(s, d))),
    f"""WITH {POSTS}, {TF}, {QUERY}, m AS (SELECT q.query_id, tf.doc_id, count(*) AS matched FROM (SELECT DISTINCT query_id, term FROM q) q JOIN tf ON tf.term = q.term GROUP BY ALL)
    SELECT query_id, doc_id, round(CASE WHEN n < 2 THEN 1 ELSE matched * (matched - 1) / 2 / (n * (n - 1) / 2) END, 6) AS share FROM m JOIN (SELECT query_id, count(DISTINCT term) AS n FROM q GROUP BY query_id) USING (query_id)""",
)


def signal_quality(s, d):
    return fts.signal_quality(bm25_topk(s, d).join(fts.coverage(index(s, d), weights(s, d)), ["query_id", "doc_id"]))


register("signal_quality", signal_quality, f"WITH {WBASE}, {COVER}, {BM25} SELECT query_id, round(sum(exp(-0.45::DOUBLE * (rank - 1)) * coverage) / sum(exp(-0.45::DOUBLE * (rank - 1))), 6) AS quality FROM best JOIN cov USING (query_id, doc_id) WHERE rank <= 5 GROUP BY query_id")
register(
    "pmi_expand",
    lambda s, d: termstats.expansions(asked(s, d), associations(s, d)),
    f"""WITH {POSTS}, {TF}, {VOCAB}, {QUERY}, {NPMI}
    SELECT query_id, term, npmi, row_number() OVER (PARTITION BY query_id ORDER BY npmi DESC, term)::INT AS rank FROM (SELECT query_id, assoc AS term, max(npmi) AS npmi FROM (SELECT DISTINCT query_id, term FROM q) q JOIN assoc USING (term)
      WHERE cooccur >= 5 AND npmi > 0.15 GROUP BY ALL) x WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.query_id = x.query_id AND q.term = x.term) QUALIFY rank <= 8""",
)


def intents(s, d):
    tf = index(s, d).posts.select("doc_id", "term", "tf")
    examples = tf.join(docs(s, d).select("doc_id", F.col("lang").alias("label")), "doc_id").where("label IS NOT NULL")
    q = asked(s, d).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    return termstats.centroid_classifier(examples, q)


register(
    "intent_centroid",
    intents,
    f"""WITH {POSTS}, {TF}, {QUERY}, ex AS (SELECT tf.doc_id, lang AS label, term, tf FROM tf JOIN documents d ON d.doc_id = tf.doc_id WHERE lang IS NOT NULL),
    idf AS (SELECT term, ln(((SELECT count(DISTINCT doc_id) FROM ex) + 1) / (count(DISTINCT doc_id) + 1)) + 1 AS idf FROM ex GROUP BY term),
    ew AS (SELECT label, term, tf / max(tf) OVER (PARTITION BY doc_id) AS w FROM ex),
    c AS (SELECT label, term, sum(w * idf) / any_value(m) AS w FROM ew JOIN idf USING (term) JOIN (SELECT label, count(DISTINCT doc_id) AS m FROM ex GROUP BY label) USING (label) GROUP BY label, term),
    qt AS (SELECT query_id, term, count(*) AS tf FROM q GROUP BY ALL), qm AS (SELECT query_id, term, tf / max(tf) OVER (PARTITION BY query_id) AS w FROM qt), qw AS (SELECT query_id, term, w * idf AS w FROM qm JOIN idf USING (term)),
    sc AS (SELECT query_id, label, round(sum(qw.w * c.w) / any_value(cn * qn), 6) AS score FROM qw JOIN c USING (term) JOIN (SELECT label, sqrt(sum(w * w)) AS cn FROM c GROUP BY label) USING (label) JOIN (SELECT query_id, sqrt(sum(w * w)) AS qn FROM qw GROUP BY query_id) USING (query_id) GROUP BY query_id, label)
    SELECT query_id, CASE WHEN score >= 0.15 THEN label END AS label, score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) = 1""",
)


def sequence_score(s, d):
    """Rank the BM25 candidates by how well they hold the query's tokens in order, each with its weight."""
    terms = fts.keep(asked(s, d), "terms")
    q = terms.join(termstats.term_weights(index(s, d), terms), ["query_id", "term"]).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term", "weight"))), lambda x: F.struct(x["term"].alias("term"), x["weight"].alias("weight"))).alias("q"))
    best = fts.bm25(index(s, d), terms)
    return best.join(q, "query_id").join(index(s, d).texts.withColumnRenamed("tokens", "t"), "doc_id").select("query_id", "doc_id", F.round(fts.in_order(F.col("q"), F.col("t")), 8).alias("sequence"))


register(
    "sequence_score",
    sequence_score,
    rf"""WITH RECURSIVE {WBASE}, {BM25}, qa AS (SELECT query_id, list(term ORDER BY place) AS q, list(weight ORDER BY place) AS w FROM q JOIN wt USING (query_id, term) GROUP BY query_id),
    c AS (SELECT query_id, doc_id, q, w, t FROM best JOIN qa USING (query_id) JOIN (SELECT doc_id, {TOK} AS t FROM documents) USING (doc_id)),
    st(query_id, doc_id, i, prev, first, n, mw) AS (SELECT query_id, doc_id, 0, 0, 0, 0, 0.0::DOUBLE FROM c
      UNION ALL SELECT query_id, doc_id, i + 1, CASE WHEN hop > 0 THEN prev + hop ELSE prev END, CASE WHEN hop > 0 AND first = 0 THEN prev + hop ELSE first END, n + (hop > 0)::INT, mw + CASE WHEN hop > 0 THEN wi ELSE 0 END
        FROM (SELECT s.*, c.w[i + 1] AS wi, coalesce(list_position(c.t[prev + 1:], c.q[i + 1]), 0)::INT AS hop FROM st s JOIN c USING (query_id, doc_id) WHERE i < len(c.q)))
    SELECT query_id, doc_id, round(CASE WHEN len(q) >= 3 AND n >= 2 THEN n / greatest(1, prev - first + 1) * mw / list_sum(w) ELSE 0 END, 8) AS sequence FROM st JOIN c USING (query_id, doc_id) WHERE i = len(q)""",
)
