"""Queries of tokenizers, stems, markup, glosses, fragments and qualifiers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import table
from ..functions import text as X
from ..functions.numeric import park_miller
from ..functions.stem import stemmed
from ..operators import markup
from . import search as S
from .registry import register

KINDS = [*X.TOKENIZERS, "signs"]


def tokenized(s, d):
    """How many tokens each way finds in every text, and which."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), X.tokens_of(k, F.col("text")).alias("t")) for k in KINDS])).alias("x")
    return S.docs(s, d).select("doc_id", each).select("doc_id", "x.kind", F.size("x.t").cast("long").alias("n"), F.md5(F.array_join("x.t", " ")).alias("digest"))


def _kind_sql(kind: str) -> str:
    if kind == "signs":  # RE2 and Java agree on the classes of punctuation
        return r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[\p{P}$+<=>^`|~]', ' ', 'g'), '\s+'), lambda t: t <> '')"
    keep, drop, least = X.TOKENIZERS[kind]
    quote = keep.replace("'", "''")
    out = rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^{quote}]', '{'' if drop else ' '}', 'g'), '\s+'), lambda t: len(t) >= {least})"
    return f"list_filter({out}, lambda t: t NOT IN ({', '.join(repr(w) for w in X.PASSED_OVER)}))" if kind == "matcher" else out


register("tokenizers", tokenized, " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_kind_sql(k)} AS t FROM documents)" for k in KINDS))
register("porter_terms", lambda s, d: S.index(s, d).vocab.select("term", "df").withColumn("stem", stemmed("term")).groupBy("stem").agg(F.count("*").alias("n_terms"), F.sum("df").alias("df")))


def dual(s, d):
    """Every document beside the benchmark text of its id, in pieces of 150 words."""
    b = table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("other"))
    rows = S.docs(s, d).select("doc_id", "text").join(b, "doc_id", "left").select("doc_id", F.posexplode(X.paired_segments(F.col("text"), F.col("other"))).alias("part", "p"))
    return rows.select("doc_id", F.col("part").cast("long").alias("part"), F.md5("p.a").alias("a"), F.md5("p.b").alias("b"))


_W = r"list_filter(regexp_split_to_array(trim(coalesce({c}, '')), '\s+'), lambda x: x <> '')"
register("dual_segments", dual, f"""WITH w AS (SELECT d.doc_id, {_W.format(c='d.text')} AS a, {_W.format(c='b.text')} AS b FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id),
    p AS (SELECT *, unnest(range(0, greatest(1, (len(a) + 149) // 150, (len(b) + 149) // 150))) AS part FROM w)
    SELECT doc_id, part, md5(array_to_string(a[part * 150 + 1:part * 150 + 150], ' ')) AS a, md5(array_to_string(b[part * 150 + 1:part * 150 + 150], ' ')) AS b FROM p""")


def tagged(s, d):
    """Part names and brands inside the tags of a translation."""
    t = F.concat(F.lit("<FI>"), F.col("p_name"), F.lit("<Fi> said<RF>note "), F.col("p_brand"), F.lit("<Rf><WT>H12<Wt> of <WH>"), F.col("p_type"), F.lit("<Wh><CM><FO>"), F.col("p_brand"), F.lit("<Fo>  <x>end "))
    return table(s, d, "part").select("p_partkey", X.untagged(t).alias("text"))


register("untagged", tagged, "SELECT p_partkey, p_name || ' said of ' || p_type || ' ' || p_brand || ' end' AS text FROM part")


def summaries(s, d):
    """Model-written summaries made of parts: headers, a link, emphasis, bullets."""
    head = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("# About "), F.col("p_name"), F.lit("\n**Summary**\n"))).when(F.col("p_partkey") % 3 == 1, F.lit("A short title\r\n\r\n")).otherwise(F.lit(""))
    body = F.when(F.col("p_partkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("This is *"), F.col("p_name"), F.lit("*, see [the "), F.col("p_type"), F.lit("](http://x/y).\n- It is `"), F.col("p_brand"), F.lit("`  indeed.")))
    return table(s, d, "part").select("p_partkey", X.plain_summary(F.concat(head, body)).alias("text"))


register("plain_summary", summaries, "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN 'This is ' || p_name || ', see the ' || p_type || '. - It is ' || p_brand || ' indeed.' END AS text FROM part")


def glosses(s, d):
    """Pairs of words for one meaning, from gloss lists made of parts."""
    p = table(s, d, "part")
    text = F.concat(F.lit("[idiom] "), F.col("p_name"), F.lit(" (-ing), x "), F.col("p_type"), F.lit("; the, H12 "), F.col("p_brand"), F.lit(". Compare others, 17"))
    w = p.select("p_partkey", "p_name", X.gloss_words(text).alias("w"))
    gloss = F.concat(F.array_join(F.slice("w", 1, 5), ", "), F.lit(" (H"), F.col("p_partkey"), F.lit(")"))
    syn = lambda i: F.when(F.length(F.get("w", F.lit(i))) < 15, F.concat(F.get("w", F.lit(i)), F.lit(" (H"), F.col("p_partkey"), F.lit(": "), F.col("p_name"), F.lit(")"))).otherwise(F.get("w", F.lit(i)))
    pair = lambda a, b: F.struct(a.alias("anchor"), b.alias("positive"))
    definition = F.concat(F.lit("the meaning of "), F.col("p_name"))
    rows = w.select("p_partkey", F.explode(F.array(pair(gloss, definition), pair(definition, gloss), pair(syn(0), syn(1)), pair(syn(1), syn(0)))).alias("p"))
    return rows.select("p_partkey", "p.anchor", "p.positive").where((F.length("anchor") >= 15) & (F.length("positive") >= 15))


register("gloss_pairs", glosses, """WITH w AS (SELECT p_partkey, p_name, [lower(p_name), lower(p_type), lower(p_brand)] AS w FROM part), g AS (SELECT *, array_to_string(w[1:5], ', ') || ' (H' || p_partkey || ')' AS gloss, 'the meaning of ' || p_name AS def,
    list_transform(w, lambda x: CASE WHEN len(x) < 15 THEN x || ' (H' || p_partkey || ': ' || p_name || ')' ELSE x END) AS s FROM w),
    p AS (SELECT p_partkey, gloss AS anchor, def AS positive FROM g UNION ALL SELECT p_partkey, def, gloss FROM g UNION ALL SELECT p_partkey, s[1], s[2] FROM g UNION ALL SELECT p_partkey, s[2], s[1] FROM g) SELECT * FROM p WHERE len(anchor) >= 15 AND len(positive) >= 15""")


def fragments(s, d, of=None):
    """A fragment query of every document, or of those in ``of(doc_id)``: their texts alone are taken apart."""
    docs = S.docs(s, d) if of is None else S.docs(s, d).join(of, "doc_id", "left_semi")
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z0-9\s']", " "), r"\s+"), lambda w: w != "")
    return docs.select("doc_id", X.fragment(words, park_miller(F.col("doc_id") + 20_260_404)).alias("query"))


register("fragment_queries", fragments, r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s'']', ' ', 'g'), '\s+'), lambda x: x <> '') AS w, (doc_id + 20260404) * 16807 % 2147483647 AS seed FROM documents),
    c AS (SELECT doc_id, seed, CASE WHEN len(list_filter(w, lambda x: len(x) >= 4)) >= 4 THEN list_filter(w, lambda x: len(x) >= 4) ELSE list_filter(w, lambda x: len(x) >= 3) END AS s FROM w),
    z AS (SELECT *, greatest(3, least(len(s), 4 + seed % 4)) AS width FROM c), a AS (SELECT *, (seed // 4) % (greatest(len(s) - width, 0) + 1) AS start FROM z)
    SELECT doc_id, CASE WHEN len(s) > 0 THEN array_to_string(s[start + 1:start + width], ' ') END AS query FROM a""")
# What stands around a name to qualify it; @ is the name.
QUALIFIERS = [r"@,?\s+(?:the\s+)?son\s+of\s+([A-Z][a-z]+)", r"@,?\s+(?:the\s+)?daughter\s+of\s+([A-Z][a-z]+)", r"@\s+the\s+(Elder|Younger|prophet|priest|king|captain|judge)", r"((?:Captain|King|Prophet|Judge|Chief)\s+@)", r"(the\s+(?:city|land|place|valley|hill|waters?)\s+of\s+@)", r"(@(?:,?\s+a\s+city|\s+in\s+the\s+land))"]


def qualified(s, d):
    """The ten commonest qualifiers of each name, in sentences made of orders: the priority is a name."""
    o = table(s, d, "orders").select("o_orderkey", F.concat(F.upper(F.substring(F.split("o_orderpriority", "-")[1], 1, 1)), F.lower(F.substring(F.split("o_orderpriority", "-")[1], 2, 99))).alias("name"))
    say = F.element_at(F.array(*[F.lit(x) for x in (", the son of Amos", " the Elder and king", " in the land", " of old", ", daughter of Ruth", " the judge")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    t = o.select("name", F.concat(F.when(F.col("o_orderkey") % 4 == 0, "King ").when(F.col("o_orderkey") % 4 == 1, "the city of ").otherwise(""), F.col("name"), say).alias("t"))
    found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("t", F.concat(F.lit("(?i)"), F.replace(F.lit(q), F.lit("@"), F.col("name"))), F.lit(1)) for q in QUALIFIERS])))
    counts = t.select("name", F.explode(found).alias("qualifier")).select("name", F.trim("qualifier").alias("qualifier")).groupBy("name", "qualifier").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("name").orderBy(F.desc("n"), "qualifier"))).where("rank <= 10")


register("qualifiers", qualified, """WITH o AS (SELECT o_orderkey, upper(substr(split_part(o_orderpriority, '-', 2), 1, 1)) || lower(substr(split_part(o_orderpriority, '-', 2), 2)) AS name FROM orders),
    q AS (SELECT name, CASE o_orderkey % 6 WHEN 0 THEN 'Amos' WHEN 1 THEN 'Elder' WHEN 2 THEN name || ' in the land' WHEN 4 THEN 'Ruth' WHEN 5 THEN 'judge' END AS qualifier FROM o UNION ALL SELECT name, CASE o_orderkey % 4 WHEN 0 THEN 'King ' || name WHEN 1 THEN 'the city of ' || name END FROM o),
    c AS (SELECT name, qualifier, count(*) AS n FROM q WHERE qualifier IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, qualifier)::INT AS rank FROM c QUALIFY rank <= 10""")


def marked(s, d):
    """Pages whose links lead to notes of the page itself, and whose paragraphs' short first sentences are headings with an anchor."""
    html = F.regexp_replace("html", r'<li><a href="/([^"]+)">([^<]*)</a></li>', r'<a href="#$1">$2</a><li id="$1">$2 <i>noted</i></li>')
    return table(s, d, "pages").select(F.col("page_id").alias("id"), F.regexp_replace(html, r"<p>([^.<]{1,20})\.", r'<h2>$1<a href="#$1">*</a></h2><p>').alias("html"))


def _stripped_sql(x: str) -> str:
    return rf"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))"""


MARKED = r"""h AS (SELECT page_id AS id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<li><a href="/([^"]+)">([^<]*)</a></li>', '<a href="#\1">\2</a><li id="\1">\2 <i>noted</i></li>', 'g'), '<p>([^.<]{1,20})\.', '<h2>\1<a href="#\1">*</a></h2><p>', 'g'),
      '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS html FROM pages WHERE html IS NOT NULL),
    a AS (SELECT id, string_split(regexp_replace(' ' || html, '(?i)(<h[1-6]\b[^>]*>)', chr(1) || '\1', 'g'), chr(1)) AS p FROM h),
    b AS (SELECT id, i::INT - 1 AS section, p[i] AS part FROM a, unnest(range(1, len(p) + 1)) AS t(i)), c AS (SELECT *, CASE WHEN section = 0 THEN 0 ELSE regexp_extract(part, '(?i)^<h([1-6])', 1)::INT END AS level FROM b)"""
register(
    "page_sections",
    lambda s, d: markup.sections(marked(s, d)).select(F.col("id").alias("page_id"), "section", "level", "parent", "title", F.md5(X.stripped(F.col("body"))).alias("digest")),
    rf"""WITH {MARKED} SELECT id AS page_id, section, level, (SELECT max(o.section) FROM c o WHERE o.id = c.id AND o.section < c.section AND o.level < c.level) AS parent, {_stripped_sql("regexp_extract(part, '" + markup.HEADING + "', 2)")} AS title,
    md5({_stripped_sql("regexp_replace(part, '" + markup.HEADING + "', '')")}) AS digest FROM c""",
)
register(
    "page_notes",
    lambda s, d: markup.notes(marked(s, d)).withColumnRenamed("id", "page_id"),
    rf"""WITH {MARKED}, l AS (SELECT id, section, level, regexp_extract_all(part, '{markup.ANCHOR}', 1) AS x FROM c), g AS (SELECT id, section, level, i::INT - 1 AS nth, x[i] AS anchor FROM l, unnest(range(1, len(x) + 1)) AS t(i)),
    m AS (SELECT id, regexp_extract_all(html, '{markup.TARGET}', 1) AS k, regexp_extract_all(html, '{markup.TARGET}', 2) AS v FROM h), n AS (SELECT id, k[i] AS anchor, v[i] AS v FROM m, unnest(range(1, len(k) + 1)) AS t(i) QUALIFY row_number() OVER (PARTITION BY id, k[i] ORDER BY i) = 1)
    SELECT g.id AS page_id, section, level, nth, anchor, {_stripped_sql("v")} AS note FROM g LEFT JOIN n USING (id, anchor)""",
)
