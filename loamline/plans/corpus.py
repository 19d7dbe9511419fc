"""Queries of the ingest, source and text-quality operators."""

from __future__ import annotations

import string

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamline.functions.storage import shared_folder
from loamline.operators import ingest
from loamline.plans.core import query, table
from loamline.sources import readers, records


@query("""
    WITH s AS (SELECT doc_id, source, CASE WHEN length(text) = 0 AND doc_id % 7 <> 0 THEN 'unreadable' WHEN doc_id % 7 = 0 THEN 'partial' ELSE 'ok' END AS status FROM documents)
    SELECT doc_id, status, CASE status WHEN 'ok' THEN 0 WHEN 'unreadable' THEN 2 ELSE 3 END AS exit_code FROM s""")
def ingest_status(spark, d):
    docs = table(spark, d, "documents")
    return ingest.ingest_status(docs, F.length("text"), (F.col("doc_id") % 7 == 0).cast("int"), F.lit(False)).select("doc_id", "status", "exit_code")


_CODES = "s AS (SELECT source, doc_id, CASE WHEN doc_id % 7 = 0 THEN 3 WHEN length(text) = 0 OR doc_id % 11 = 0 THEN 2 ELSE 0 END AS code FROM documents)"


def _coded_files(spark, d):
    chars = F.when(F.col("doc_id") % 11 == 0, 0).otherwise(F.length("text"))
    return ingest.ingest_status(table(spark, d, "documents"), chars, (F.col("doc_id") % 7 == 0).cast("int"), F.lit(False))


@query(f"""
    WITH {_CODES} SELECT source, CASE WHEN bool_or(code = 2) THEN 2 WHEN bool_or(code = 3) THEN 3 ELSE 0 END AS exit_code, count(*) AS n_files, count(*) FILTER (code <> 0) AS n_bad,
        coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (code <> 0), '') AS bad
    FROM s GROUP BY source""")
def batch_status(spark, d):
    return ingest.batch_status(_coded_files(spark, d), ["source"], "doc_id")


@query(f"WITH {_CODES} SELECT source, doc_id, code AS exit_code, CASE code WHEN 2 THEN 1 ELSE 2 END AS severity FROM s WHERE code <> 0")
def batch_problems(spark, d):
    return ingest.batch_problems(_coded_files(spark, d), ["source"], "doc_id")


@query("""
    SELECT lang, source, count(*) AS docs, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars, count(*) FILTER (n_chars > 5000) AS long_docs
    FROM documents GROUP BY ROLLUP (lang, source)""")
def corpus_census(spark, d):
    return ingest.corpus_census(table(spark, d, "documents"), ["lang", "source"], "n_chars", 5000)


@query(r"""
    WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g') AS t FROM documents),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\n{4,}', repeat(chr(10), 3), 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS t FROM a)
    SELECT doc_id, CASE WHEN t = '' THEN md5('') ELSE md5(t || chr(10)) END AS clean_md5 FROM b""")
def clean_text(spark, d):
    return ingest.clean_text(table(spark, d, "documents"), normalize=False).select("doc_id", F.md5("clean").alias("clean_md5"))


@query("""
    WITH h AS (SELECT doc_id, text, substring(text, 1, 1000) AS head FROM documents),
    p AS (SELECT *, length(head) - strpos(reverse(head), chr(10)) AS last, strpos(head, chr(10)) AS any_nl FROM h)
    SELECT doc_id, length(text) > 1000 AS truncated, length(text) AS full_chars,
        md5(CASE WHEN length(text) <= 1000 THEN text WHEN any_nl > 0 AND last >= 800 THEN substring(text, 1, last) ELSE head END) AS cut_md5
    FROM p""")
def truncate_text(spark, d):
    return ingest.truncate_text(table(spark, d, "documents"), 1000).select("doc_id", "truncated", F.col("full_chars").cast("long").alias("full_chars"), F.md5("cut").alias("cut_md5"))


@query("""
    WITH h AS (SELECT source, doc_id, min(doc_id) OVER (PARTITION BY source, sha1(text)) AS first_key FROM documents),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY first_key) AS n FROM h)
    SELECT source, doc_id, first_key, doc_id = first_key AND n <= 40 AS kept FROM r""")
def dedup_assets(spark, d):
    return ingest.dedup_assets(table(spark, d, "documents"), "source", "doc_id", "text", 40)


@query(r"""
    WITH b AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(strip_accents(p_name || CASE p_partkey % 4 WHEN 0 THEN ' 2' WHEN 1 THEN ' é' ELSE '' END)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM b), m AS (SELECT base, max(n) AS most FROM r GROUP BY 1),
    f AS (SELECT base, k, row_number() OVER (PARTITION BY base ORDER BY k) + 1 AS n FROM (SELECT base, unnest(range(2, most + 30)) AS k FROM m) WHERE base || '-' || k NOT IN (SELECT base FROM b))
    SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '-' || k END AS slug FROM r LEFT JOIN f USING (base, n)""")
def unique_slugs(spark, d):
    tail = F.when(F.col("p_partkey") % 4 == 0, " 2").when(F.col("p_partkey") % 4 == 1, " é").otherwise("")
    return ingest.unique_slugs(table(spark, d, "part").withColumn("name", F.concat("p_name", tail)), "p_partkey", "name").select("p_partkey", "slug")


@query("""
    SELECT l_orderkey, l_linenumber, CASE
        WHEN l_quantity < 20 AND (l_discount >= 0.05 OR l_extendedprice > 50000) THEN 'no_text_layer'
        WHEN l_linenumber / greatest(l_quantity + l_linenumber, 1) > 0.3 THEN 'garbage_text_layer'
        WHEN l_discount >= 0.6 AND l_quantity < 80 THEN 'mostly_image'
        WHEN l_quantity < 20 THEN 'blank' END AS reason
    FROM lineitem""")
def triage_pages(spark, d):
    li = table(spark, d, "lineitem")
    pages = li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("letters"), F.col("l_linenumber").alias("bad_chars"), F.col("l_discount").alias("image_coverage"), (F.col("l_extendedprice") / 250).alias("vector_count"))
    return ingest.triage_pages(pages).select("l_orderkey", "l_linenumber", "reason")


#: Documents in legacy encodings: one in five with TCVN3 codes, one with them in capitals, one with VNI marks, one with codes beside Unicode letters, and one as it is.
_CODED = "CASE doc_id % 5 WHEN 0 THEN translate(text, 'aeou', 'µÖéø') WHEN 1 THEN translate(translate(text, '{lower}', '{upper}'), 'AEOU', 'µÖéø') WHEN 2 THEN replace(replace(replace(translate(text, 'u', 'ö'), 'a', 'aù'), 'e', 'eä'), 'd', 'ñ') WHEN 3 THEN translate(text, 'aq', '¸ệ') ELSE text END".format(
    lower=string.ascii_lowercase, upper=string.ascii_uppercase
)
#: The SQL's own table: codes and letters in the order of the letters.
_TC = "¸µ¶·¹¨¾»¼½Æ©ÊÇÈÉË®ÐÌÎÏÑªÕÒÓÔÖÝ×ØÜÞãßáâä«èåæçé¬íêëìîóïñòôøõö÷ùýúûüþ¡¢£¤¥¦§" + chr(173)
_TC_LETTERS = "áàảãạăắằẳẵặâấầẩẫậđéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụứừửữựýỳỷỹỵĂÂÊÔƠƯĐư"
_TC_STRONG = "[¡¢£¤¥¦§¨©ª¬®µ¶·¸¹¼½¾" + chr(173) + "]"
_VI, _PAIR = "[Ạ-ỹĂăĐđƠơƯưĨĩŨũ]", "[aeouyAEOUYôöÔÖ][ùøûõïâáàåãäêéèúüë]"
_MARKED = "[aeouyAEOUYôöÔÖ][ùøûõïâáàåãäêéèúüëÙØÛÕÏÂÁÀÅÃÄÊÉÈÚÜË]"
_LEGACY = rf"t AS (SELECT doc_id, {_CODED} AS t FROM documents WHERE text IS NOT NULL)"


def _coded(spark, d):
    k, t = F.col("doc_id") % 5, F.col("text")
    coded = F.translate(t, "aeou", "µÖéø")
    upper = F.translate(F.translate(t, string.ascii_lowercase, string.ascii_uppercase), "AEOU", "µÖéø")
    marked = F.translate(t, "u", "ö")
    for letter, code in (("a", "aù"), ("e", "eä"), ("d", "ñ")):
        marked = F.replace(marked, F.lit(letter), F.lit(code))
    out = F.when(k == 0, coded).when(k == 1, upper).when(k == 2, marked).when(k == 3, F.translate(t, "aq", "¸ệ")).otherwise(t)
    return table(spark, d, "documents").where("text is not null").select("doc_id", out.alias("text"))


@query(rf"""
    WITH {_LEGACY}, w AS (SELECT doc_id, t, list_filter(regexp_extract_all(t, '\S+'), lambda w: regexp_matches(w, '\p{{L}}')) AS words FROM t),
    s AS (SELECT doc_id, len(regexp_extract_all(t, '{_VI}')) AS uni, len(regexp_extract_all(t, '{_TC_STRONG}')) AS strong, len(words) AS words,
        len(list_filter(words, lambda w: regexp_matches(w, '[{_TC}]'))) AS tok, len(regexp_extract_all(t, '{_PAIR}')) AS pairs FROM w)
    SELECT doc_id, uni, strong, words, tok, pairs, CASE WHEN words = 0 THEN NULL
        WHEN uni * 4 <= greatest(strong, tok // 2) AND ((strong >= 3 AND tok / words >= 0.2) OR (strong >= 2 AND tok / words >= 0.35)) THEN 'tcvn3'
        WHEN uni * 4 <= pairs AND pairs >= 5 AND pairs / words >= 0.1 THEN 'vni' END AS legacy FROM s""")
def detect_legacy(spark, d):
    out = ingest.detect_legacy(ingest.legacy_signals(_coded(spark, d), "text"))
    return out.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("uni", "strong", "words", "tok", "pairs")), "legacy")


@query(rf"""
    WITH {_LEGACY}, l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM t),
    w AS (SELECT *, list_filter(regexp_extract_all(l, '\S+'), lambda w: regexp_matches(w, '\p{{L}}')) AS words, regexp_extract_all(l, '\S+|\s+') AS parts,
        len(regexp_extract_all(l, '[A-Z]')) >= 3 AND NOT regexp_matches(l, '[a-z]') AS capitals FROM l),
    f AS (SELECT *, NOT regexp_matches(l, '{_VI}') AND regexp_matches(l, '[{_TC}]') AND (regexp_matches(l, '{_TC_STRONG}')
        OR len(list_filter(words, lambda w: regexp_matches(w, '[{_TC}]'))) >= 0.3 * greatest(len(words), 1)) AS wrong FROM w)
    SELECT doc_id, md5(string_agg(CASE WHEN wrong THEN array_to_string(list_transform(parts, lambda w:
        CASE WHEN regexp_matches(w, '[{_TC}]') AND (capitals OR len(regexp_extract_all(w, '[A-Z]')) >= 2 AND NOT regexp_matches(w, '[a-z]')) THEN upper(translate(w, '{_TC}', '{_TC_LETTERS}'))
        ELSE translate(w, '{_TC}', '{_TC_LETTERS}') END), '') ELSE l END, chr(10) ORDER BY n)) AS fixed_md5, count(*) FILTER (wrong) AS lines_changed
    FROM f GROUP BY doc_id""")
def repair_legacy(spark, d):
    return ingest.repair_legacy(_coded(spark, d), "text").select("doc_id", F.md5("fixed").alias("fixed_md5"), F.col("lines_changed").cast("long").alias("lines_changed"))


@query(rf"""
    WITH {_LEGACY}, l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM t WHERE doc_id % 5 = 2),
    w AS (SELECT *, list_filter(regexp_extract_all(l, '\S+'), lambda w: regexp_matches(w, '\p{{L}}')) AS words FROM l),
    f AS (SELECT *, NOT regexp_matches(l, '{_VI}') AND regexp_matches(l, '{_MARKED}') AND len(list_filter(words, lambda w: regexp_matches(w, '{_MARKED}'))) >= 0.3 * greatest(len(words), 1) AS wrong FROM w)
    SELECT doc_id, string_agg(CASE WHEN wrong THEN translate(replace(replace(l, 'aù', 'á'), 'eä', 'ệ'), 'öñ', 'ưđ') ELSE l END, chr(10) ORDER BY n) AS fixed, count(*) FILTER (wrong) AS lines_changed
    FROM f GROUP BY doc_id
    HAVING NOT regexp_matches(string_agg(l, ' '), '[ôæóòîÔÖÑÆÓÒÎ]|[aouyAEOUYôöÔÖ][øûõïâáàåãäêéèúüëÙØÛÕÏÂÁÀÅÃÄÊÉÈÚÜË]|[eouyAEOUYôöÔÖ][ù]|[e][øûõïâáàåãêéèúüë]')""")
def repair_vni(spark, d):
    """Texts of VNI letters and marks that the SQL's own table has."""
    others = "[ôæóòîÔÖÑÆÓÒÎ]|[aouyAEOUYôöÔÖ][øûõïâáàåãäêéèúüëÙØÛÕÏÂÁÀÅÃÄÊÉÈÚÜË]|[eouyAEOUYôöÔÖ][ù]|[e][øûõïâáàåãêéèúüë]"
    some = _coded(spark, d).where(F.col("doc_id") % 5 == 2).where(~F.replace("text", F.lit("\n"), F.lit(" ")).rlike(others))
    return ingest.repair_vni(some, "text").select("doc_id", "fixed", F.col("lines_changed").cast("long").alias("lines_changed"))


@query(r"""
    WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS t FROM documents),
    w AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-zÀ-ÖØ-öø-ÿ]+') AS w, len(regexp_extract_all(t, '[À-ÖØ-öø-ÿ]')) AS acc FROM t)
    SELECT doc_id, round(CASE WHEN len(w) < 20 OR acc < 5 THEN 0.0 ELSE len(list_filter(w, lambda x: length(x) BETWEEN 2 AND 4 AND NOT regexp_matches(x, '[aeiouyAEIOUYÀ-ÖØ-öø-ÿ]') AND x <> upper(x))) / len(w) END, 6) AS damage
    FROM w""")
def diacritic_damage(spark, d):
    return ingest.diacritic_damage(table(spark, d, "documents")).select("doc_id", F.round("damage", 6).alias("damage"))


@query("""
    WITH g AS (SELECT l_orderkey AS sheet, l_linenumber AS r, CAST(l_quantity AS INTEGER) % 9 AS c, CASE WHEN l_returnflag = 'A' THEN 'f' END AS f, CASE WHEN l_linestatus = 'F' THEN l_tax END AS cached FROM lineitem)
    SELECT sheet, max(r) AS max_row, max(c) AS max_col, count(DISTINCT r) AS rows_used, count(f) AS formulas, count(*) FILTER (f IS NOT NULL AND cached IS NULL) AS stale
    FROM g WHERE f IS NOT NULL OR cached IS NOT NULL GROUP BY sheet""")
def stale_formula_cells(spark, d):
    li = table(spark, d, "lineitem")
    cells = li.select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row"), (F.col("l_quantity").cast("int") % 9).alias("col"), F.when(F.col("l_returnflag") == "A", "f").alias("formula"), F.when(F.col("l_linestatus") == "F", F.col("l_tax")).alias("cached"))
    return ingest.stale_formula_cells(cells)


_FLAWED = r"""t AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 6 WHEN 0 THEN chr(10) || 'dear {{name}}, TODO and TBD' WHEN 1 THEN chr(10) || chr(10) || chr(10) || chr(10) || 'end' WHEN 2 THEN chr(10) || '# a' || chr(10) || 'x' || chr(10) || '#### b'
    WHEN 3 THEN chr(10) || 'cafe' || chr(769) || ' is decomposed' WHEN 4 THEN chr(10) || 'so [TO VERIFY: year] and [CẦN XÁC MINH]' ELSE ' — dash' END AS text FROM documents)"""


@query(rf"""
    WITH {_FLAWED}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM t)
    SELECT doc_id, 'placeholder' AS kind, line, len(regexp_extract_all(t, 'TODO|TBD|XXX|\[\.\.\.\]|Lorem ipsum|\{{\{{[^}}\n]+\}}\}}')) AS detail FROM l WHERE regexp_matches(t, 'TODO|TBD|XXX|\[\.\.\.\]|Lorem ipsum|\{{\{{[^}}\n]+\}}\}}')
    UNION ALL SELECT doc_id, 'em_dash', line, 1 FROM l WHERE contains(t, '—')
    UNION ALL SELECT doc_id, 'decomposed', line, 1 FROM l WHERE nfc_normalize(t) <> t
    UNION ALL SELECT doc_id, 'verify_flag', line, len(regexp_extract_all(t, '\[(?:CẦN XÁC MINH|TO VERIFY)[^\]]*\]')) FROM l WHERE regexp_matches(t, '\[(CẦN XÁC MINH|TO VERIFY)[^\]]*\]')
    UNION ALL SELECT doc_id, 'empty_run', min(line), count(*) FROM (SELECT *, sum(CASE WHEN trim(t) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS r FROM l) WHERE trim(t) = '' GROUP BY doc_id, r HAVING count(*) >= 3
    UNION ALL SELECT doc_id, 'heading_jump', line, lev - b FROM (SELECT *, lag(lev) OVER (PARTITION BY doc_id ORDER BY line) AS b FROM (SELECT *, length(regexp_extract(t, '^(#+)', 1)) AS lev FROM l WHERE regexp_matches(t, '^#{{1,6}} '))) WHERE lev > b + 1""")
def doc_findings(spark, d):
    """Documents, each with one of six flaws added."""
    more = ["\ndear {{name}}, TODO and TBD", "\n\n\n\nend", "\n# a\nx\n#### b", "\ncafé is decomposed", "\nso [TO VERIFY: year] and [CẦN XÁC MINH]", " — dash"]
    added = F.element_at(F.array(*map(F.lit, more)), (F.col("doc_id") % 6 + 1).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), added).alias("text"))
    return ingest.doc_findings(docs, "doc_id").withColumns({"line": F.col("line").cast("long"), "detail": F.col("detail").cast("long")})


@query("""
    WITH t AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'note: ' || props || ' end' WHEN event_id % 11 = 0 THEN 'none' ELSE props END AS raw FROM events)
    SELECT event_id, CAST(regexp_extract(raw, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM t WHERE raw LIKE '%{%'
    UNION ALL SELECT event_id, NULL FROM t WHERE raw NOT LIKE '%{%'""")
def salvage_json(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("note: "), "props", F.lit(" end"))).when(F.col("event_id") % 11 == 0, "none").otherwise(F.col("props"))
    return readers.salvage_json(table(spark, d, "events").withColumn("raw", raw), "raw", "k long").select("event_id", F.col("parsed.k").alias("k"))


@query("""
    WITH e AS (SELECT event_id // 10 AS file, event_id, CASE WHEN event_id % 13 = 0 THEN '{broken' WHEN event_id % 17 = 0 THEN '' ELSE props END AS raw FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY event_id) AS line FROM e)
    SELECT file, line, 'bad' AS kind, CAST(NULL AS BIGINT) AS k FROM n WHERE raw = '{broken'
    UNION ALL SELECT file, line, 'good', CAST(json_extract(raw, '$.k') AS BIGINT) FROM n WHERE raw <> '{broken' AND raw <> ''""")
def parse_jsonl(spark, d):
    raw = F.when(F.col("event_id") % 13 == 0, "{broken").when(F.col("event_id") % 17 == 0, "").otherwise(F.col("props"))
    files = table(spark, d, "events").select(F.floor(F.col("event_id") / 10).alias("file"), "event_id", raw.alias("raw")).groupBy("file")
    texts = files.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "raw"))), lambda s: s["raw"]), "\n").alias("t"))
    good, bad = readers.parse_jsonl(texts, "file", "t", "k long")
    both = good.select("file", "line", F.lit("good").alias("kind"), F.col("r.k").alias("k")).unionAll(bad.select("file", "line", F.lit("bad").alias("kind"), F.lit(None).cast("long").alias("k")))
    return both.withColumn("line", F.col("line").cast("long"))


@query(r"""
    WITH a AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages),
    b AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(h, '(?i)</t[dh]>', ' | ', 'g'), '(?i)<br ?/?>|</p>|</div>|</li>|</tr>|</h[1-6]>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS h FROM a),
    c AS (SELECT page_id, html, replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS h FROM b),
    e AS (SELECT page_id, html, regexp_replace(regexp_replace(h, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g') AS h FROM c)
    SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, md5(regexp_replace(h, '^[ \n]+|[ \n]+$', '', 'g')) AS body_md5 FROM e""")
def html_to_text(spark, d):
    return readers.html_to_text(table(spark, d, "pages")).select("page_id", "title", F.md5("body").alias("body_md5"))


@query("""
    SELECT doc_id, CASE WHEN bar > 0 AND bar > comma AND bar > semis THEN '|' WHEN semis > comma AND semis > 0 THEN ';' ELSE ',' END AS delimiter, n_rows
    FROM (SELECT doc_id, length(h) - length(replace(h, '|', '')) AS bar, length(h) - length(replace(h, ',', '')) AS comma, length(h) - length(replace(h, ';', '')) AS semis, n_rows
        FROM (SELECT doc_id, substring(text, 1, 8192) AS h, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) AS n_rows FROM documents))""")
def sniff_delimiter(spark, d):
    return readers.sniff_delimiter(table(spark, d, "documents"), "text").select("doc_id", "delimiter", F.col("n_rows").cast("long").alias("n_rows"))


@query("""
    WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem)
    SELECT l_orderkey, CAST(1 AS BIGINT) AS n_table, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity) + 1 AS n_row, l_returnflag AS a, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS b FROM t
    UNION ALL SELECT DISTINCT l_orderkey, 1, 1, 'flag', 'qty' FROM t""")
def parse_pipe_tables(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_returnflag", "l_quantity").alias("s"))
    rows = F.transform(F.sort_array(F.collect_list("s")), lambda s: F.concat(F.lit("| `"), s["l_returnflag"], F.lit("` | "), s["l_quantity"].cast("int").cast("string"), F.lit(" |")))
    texts = li.groupBy("l_orderkey").agg(F.concat(F.lit("Intro\n\n| flag | qty |\n|---|---|\n"), F.array_join(rows, "\n"), F.lit("\n\nend")).alias("text"))
    cells = readers.parse_pipe_tables(texts, "l_orderkey")
    return cells.select("l_orderkey", F.col("table").cast("long").alias("n_table"), F.col("row").cast("long").alias("n_row"), F.get("cells", F.lit(0)).alias("a"), F.get("cells", F.lit(1)).alias("b"))


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
    SELECT doc_id, line AS section, '<!-- page ' || line || ' -->' AS marker, md5(t) AS body_md5 FROM l""")
def split_sections(spark, d):
    docs = table(spark, d, "documents")
    marked = F.array_join(F.transform(F.split("text", "\n", -1), lambda l, i: F.concat(F.lit("<!-- page "), (i + 1).cast("string"), F.lit(" -->\n"), l)), "\n")
    out = readers.split_sections(docs.select("doc_id", marked.alias("text")), "doc_id")
    return out.where("section > 0").select("doc_id", "section", "marker", F.md5("body").alias("body_md5"))


@query("""
    WITH b AS (SELECT doc_id, '---' || chr(10) || 'title: "doc ' || doc_id || '"' || chr(10) || 'lang: ' || lang AS x, lang, source FROM documents)
    SELECT doc_id, 'title' AS name, 'doc ' || doc_id AS value FROM b UNION ALL SELECT doc_id, 'lang', lang FROM b
    UNION ALL SELECT doc_id, 'about', 'from ' || source || ' and on' FROM b UNION ALL SELECT doc_id, 'nested', '' FROM b""")
def parse_frontmatter(spark, d):
    head = F.concat(F.lit('---\ntitle: "doc '), F.col("doc_id").cast("string"), F.lit('"\nlang: '), "lang", F.lit("\nabout: >\n  from "), "source", F.lit("\n  and on\nnested:\n  a: 1\n---\n"), "text")
    return readers.parse_frontmatter(table(spark, d, "documents").select("doc_id", head.alias("text")), "doc_id")


@query("""
    SELECT doc_id, ['pdf', 'image', 'html', 'binary', 'zip', e, e, e][k + 1] AS format, ['utf-8', 'legacy', 'utf-8', 'utf-8', 'utf-8', 'utf-16-le', 'utf-8-sig', 'legacy'][k + 1] AS encoding, CASE WHEN k = 4 THEN 'docx' END AS kind
    FROM (SELECT doc_id, doc_id % 8 AS k, ['csv', 'md', 'text'][doc_id % 3 + 1] AS e FROM documents WHERE text IS NOT NULL)""")
def detect_format(spark, d):
    """Documents with the leading bytes of eight kinds of files, and extensions that say something else."""
    raw = lambda h: F.unhex(F.lit(h))
    t = F.col("text").cast("binary")
    kinds = [
        F.concat(F.lit("%PDF-1.7\n").cast("binary"), t), F.concat(raw("89504E470D0A1A0A"), t), F.concat(F.lit("<!DOCTYPE html>").cast("binary"), t), F.concat(raw("41004243"), t), F.concat(raw("504B0304"), F.lit("word/document.xml").cast("binary"), t),
        F.concat(raw("FFFE"), F.encode("text", "UTF-16LE")), F.concat(raw("EFBBBF"), t), F.concat(raw("63616661E9"), F.lit(" is latin").cast("binary")),
    ]
    ext = F.element_at(F.array(F.lit(".csv"), F.lit(".md"), F.lit(".txt")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.element_at(F.array(*kinds), (F.col("doc_id") % 8 + 1).cast("int")).alias("content"), ext.alias("ext"))
    return ingest.zip_kind(ingest.detect_encoding(ingest.detect_format(docs))).select("doc_id", "format", "encoding", "kind")


@query(r"""
    WITH p AS (SELECT doc_id // 4 AS key, doc_id % 4 AS pos, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n, (doc_id * 7 % 10) / 20.0 AS damage FROM documents),
    g AS (SELECT key, max(damage) FILTER (pos = 0) AS d0, max(n) FILTER (pos = 0) AS n0, max(damage) FILTER (pos = 1) AS d1, max(n) FILTER (pos = 1) AS n1,
        max(damage) FILTER (pos = 2) AS d2, max(n) FILTER (pos = 2) AS n2, max(damage) FILTER (pos = 3) AS d3, max(n) FILTER (pos = 3) AS n3 FROM p GROUP BY key HAVING n0 IS NOT NULL),
    a AS (SELECT *, d0 >= 0.06 AS open, CASE WHEN d0 >= 0.06 AND n1 * 2 >= n0 AND d1 * 2 < d0 THEN 1 ELSE 0 END AS c1, CASE WHEN d0 >= 0.06 AND n1 * 2 >= n0 AND d1 * 2 < d0 THEN d1 ELSE d0 END AS e1 FROM g),
    b AS (SELECT *, CASE WHEN open AND n2 * 2 >= n0 AND d2 * 2 < e1 THEN 2 ELSE c1 END AS c2, CASE WHEN open AND n2 * 2 >= n0 AND d2 * 2 < e1 THEN d2 ELSE e1 END AS e2 FROM a)
    SELECT key, CAST(CASE WHEN open AND n3 * 2 >= n0 AND d3 * 2 < e2 THEN 3 ELSE c2 END AS INTEGER) AS chosen, CAST(CASE WHEN open AND n3 * 2 >= n0 AND d3 * 2 < e2 THEN d3 ELSE e2 END AS DOUBLE) AS damage FROM b""")
def choose_extraction(spark, d):
    """All documents, in groups of one extraction and three further ones."""
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 4).alias("key"), "text", (F.col("doc_id") * 7 % 10 / 20).alias("damage"), (F.col("doc_id") % 4).cast("int").alias("pos"))
    return ingest.choose_extraction(docs.where("pos = 0").drop("pos"), docs.where("pos > 0"), "key")


@query("""
    WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
    l AS (SELECT doc_id, pos, CASE lower(t) WHEN 'the' THEN 'en' WHEN 'of' THEN 'en' WHEN 'de' THEN 'fr' WHEN 'la' THEN 'fr' WHEN 'der' THEN 'de' WHEN 'die' THEN 'de' END AS lang FROM w),
    c AS (SELECT *, sum(CASE WHEN lang IS NOT DISTINCT FROM prev AND pos > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT *, lag(lang) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM l))
    SELECT doc_id, min(pos) AS first_pos, max(pos) AS last_pos, any_value(lang) AS lang FROM c GROUP BY doc_id, r""")
def language_runs(spark, d):
    """All tokens of all documents in runs, those of words in no list with a null language."""
    words = spark.createDataFrame([("the", "en"), ("of", "en"), ("de", "fr"), ("la", "fr"), ("der", "de"), ("die", "de")], "word string, lang string")
    tokens = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("pos", "t"))
    runs = ingest.language_runs(tokens, words, ["doc_id"], "pos", "t")
    return runs.select("doc_id", F.col("first").cast("long").alias("first_pos"), F.col("last").cast("long").alias("last_pos"), "lang")


@query("""
    WITH r AS (SELECT role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS line, conv_id, turn, length(text) AS n FROM conversations)
    SELECT role, line, CASE WHEN line % 7 = 3 THEN 'bad' ELSE 'good' END AS kind, CASE WHEN line % 7 <> 3 THEN conv_id END AS conv_id, CASE WHEN line % 7 <> 3 THEN n END AS n FROM r WHERE line % 11 <> 5""")
def read_jsonl(spark, d):
    """Conversations as files of JSON lines, one a role, with blank and broken lines, read back with their places."""
    folder = shared_folder(spark, "jsonl")
    place = F.row_number().over(Window.partitionBy("role").orderBy("conv_id", "turn"))
    rows = table(spark, d, "conversations").select("role", "conv_id", "turn", F.length("text").alias("n"), place.alias("line"))
    text = F.when(F.col("line") % 11 == 5, " ").when(F.col("line") % 7 == 3, '{"conv_id": oops').otherwise(F.to_json(F.struct("conv_id", "n")))
    rows.select("role", text.alias("value")).write.partitionBy("role").text(folder)
    good, bad = records.read_jsonl(spark, folder, "conv_id long, n long", "*.txt")
    role = F.regexp_extract("path", "role=([^/]+)/", 1).alias("role")
    return good.select(role, "line", F.lit("good").alias("kind"), "r.conv_id", "r.n").union(bad.select(role, "line", F.lit("bad"), F.lit(None).cast("long"), F.lit(None).cast("long")))


_CELLS = """c AS (SELECT c_nationkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row, c_custkey % 5 AS k, c_name, c_mktsegment, c_nationkey % 4 AS q FROM customer),
    v AS (SELECT file, row, [c_name, CASE k WHEN 0 THEN 'a "b" ' || c_mktsegment WHEN 1 THEN 'x' || chr(10) || 'y' WHEN 2 THEN '' WHEN 3 THEN c_name || ',;|' || chr(9) ELSE '5" pipe' END, CASE WHEN k = 2 THEN '' ELSE c_mktsegment END] AS cells FROM c)"""


@query(rf"""WITH {_CELLS} SELECT file, CAST(row AS INTEGER) AS row, len(cells) AS n, array_to_string(cells, '~') AS cells FROM v""")
def delimited_rows(spark, d):
    """Customers of a nation as one text in one of four dialects: quoted quotes, line ends and delimiters, empty cells."""
    c = table(spark, d, "customer").withColumn("k", F.col("c_custkey") % 5)
    note = F.when(F.col("k") == 0, F.concat(F.lit('a "b" '), "c_mktsegment")).when(F.col("k") == 1, "x\ny").when(F.col("k") == 2, "").when(F.col("k") == 3, F.concat("c_name", F.lit(",;|\t"))).otherwise('5" pipe')
    mark = F.element_at(F.array(*map(F.lit, records.DELIMITERS)), (F.col("c_nationkey") % 4 + 1).cast("int"))
    quoted = F.when(F.col("k").isin(0, 1, 3), F.concat(F.lit('"'), F.replace(note, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(note)
    line = F.concat("c_name", mark, quoted, mark, F.when(F.col("k") == 2, "").otherwise(F.col("c_mktsegment")))
    files = c.groupBy(F.col("c_nationkey").cast("long").alias("file"), mark.alias("delimiter")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("l")))), lambda s: s["l"]), "\r\n").alias("text"))
    rows = records.delimited_rows(files, "file", "text")
    return rows.select("file", "row", F.size("cells").cast("long").alias("n"), F.array_join("cells", "~").alias("cells"))


@query("""
    WITH m AS (SELECT source, count(*) AS files, max(CASE WHEN text IS NULL OR trim(text) = '' THEN 1 ELSE 0 END) AS empty FROM documents GROUP BY source)
    SELECT 'f-' || source AS folder, CASE WHEN files % 3 = 0 THEN 3 ELSE 0 END AS exit_code, files AS chars, max(CASE WHEN files % 3 = 0 THEN 3 ELSE 0 END) OVER () AS batch_code FROM m""")
def publish_manifest(spark, d):
    """One manifest a source, published with its index, which is read back."""
    per = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("chars"))
    rows = per.select(F.concat(F.lit("f-"), "source").alias("folder"), F.when(F.col("chars") % 3 == 0, 3).otherwise(0).alias("exit_code"), "chars", F.array("source").alias("parts"))
    path = shared_folder(spark, "manifests")
    records.publish_manifest(rows, path)
    return records.read_index(spark, path).select("folder", F.col("exit_code").cast("int").alias("exit_code"), "chars", F.col("batch_code").cast("int").alias("batch_code"))


@query(r"""
    WITH w AS (SELECT lower(unnest(string_split(text, ' '))) AS word FROM documents), n AS (SELECT word, count(*) AS n FROM w WHERE regexp_matches(word, '\p{L}') GROUP BY word)
    SELECT word, n FROM n WHERE word NOT IN ('the', 'of', 'de', 'la', 'der', 'die', 'und', 'et')""")
def unknown_words(spark, d):
    words = spark.createDataFrame([("the", "en"), ("of", "en"), ("de", "fr"), ("la", "fr"), ("der", "de"), ("die", "en")], "word string, lang string")
    overrides = spark.createDataFrame([("die", "de"), ("und", "de"), ("et", "fr")], "word string, lang string")
    return ingest.unknown_words(table(spark, d, "documents").select(F.explode(F.split("text", " ", -1)).alias("t")), words, "t", overrides)


_POSTS = r"""p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '# Plan' || chr(10) || 'not this' || chr(10) || '## Post CONTENT now' || chr(10) || '<!-- a note -->' || chr(10) || '### big title' || chr(10) || a || ' **bold** and __more__' || chr(10) || '## Next' || chr(10) || 'nor this'
    WHEN 1 THEN '## Post content' || chr(10) || a || chr(10) || '---' || chr(10) || 'tail' ELSE '  # All of it  ' || chr(10) || a || chr(10) || ' <!-- gone --> ' || chr(10) || 'end <!-- stays -->' END AS text, a
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[#*_<>\s-]+', ' ', 'g') AS a FROM documents))"""


@query(rf"""
    WITH {_POSTS} SELECT doc_id, md5(trim(CASE doc_id % 3 WHEN 0 THEN '📌 BIG TITLE' || chr(10) || a || ' bold and more' WHEN 1 THEN a ELSE '📌 ALL OF IT' || chr(10) || a || chr(10) || 'end <!-- stays -->' END)) AS body_md5 FROM p""")
def publishable_text(spark, d):
    a = F.regexp_replace(F.coalesce("text", F.lit("")), r"[#*_<>\s-]+", " ")
    one = F.concat(F.lit("# Plan\nnot this\n## Post CONTENT now\n<!-- a note -->\n### big title\n"), a, F.lit(" **bold** and __more__\n## Next\nnor this"))
    two = F.concat(F.lit("## Post content\n"), a, F.lit("\n---\ntail"))
    three = F.concat(F.lit("  # All of it  \n"), a, F.lit("\n <!-- gone --> \nend <!-- stays -->"))
    k = F.col("doc_id") % 3
    docs = table(spark, d, "documents").select("doc_id", F.when(k == 0, one).when(k == 1, two).otherwise(three).alias("text"))
    return ingest.publishable_text(docs, "doc_id", "Post content").select("doc_id", F.md5("body").alias("body_md5"))


_OCR = """o AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) AS id, l_linenumber % 2 + 1 AS pass, CASE WHEN l_suppkey % 3 = 0 THEN '漢字' ELSE 'latin' END AS text,
    l_partkey % 40.0 AS x0, l_suppkey % 30.0 AS y0, l_quantity AS q FROM lineitem), b AS (SELECT *, x0 + q AS x1, y0 + q / 2 AS y1 FROM o)"""


def _ocr(spark, d):
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    x, y, q = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 30).cast("double"), F.col("l_quantity").cast("double")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), number.alias("id"), (F.col("l_linenumber") % 2 + 1).alias("pass"), F.when(F.col("l_suppkey") % 3 == 0, "漢字").otherwise("latin").alias("text"), x.alias("x0"), y.alias("y0"), (x + q).alias("x1"), (y + q / 2).alias("y1"),
    )


@query(f"""
    WITH {_OCR}, a AS (SELECT * FROM b WHERE pass = 2 AND text = '漢字')
    SELECT page, CAST(id AS INTEGER) AS id FROM a UNION ALL
    SELECT page, CAST(id AS INTEGER) FROM b x WHERE pass = 1 AND NOT (text = 'latin' AND EXISTS (SELECT 1 FROM a WHERE a.page = x.page AND least(a.x1, x.x1) > greatest(a.x0, x.x0) AND least(a.y1, x.y1) > greatest(a.y0, x.y0)
        AND (least(a.x1, x.x1) - greatest(a.x0, x.x0)) * (least(a.y1, x.y1) - greatest(a.y0, x.y0)) > 0.5 * least((a.x1 - a.x0) * (a.y1 - a.y0), (x.x1 - x.x0) * (x.y1 - x.y0))))""")
def merge_ocr_passes(spark, d):
    return ingest.merge_ocr_passes(_ocr(spark, d), "page").select("page", "id")


@query(f"""
    WITH RECURSIVE {_OCR}, s AS (SELECT page, (y0 + y1) / 2 AS cy, x0, text || id AS t, row_number() OVER (PARTITION BY page ORDER BY (y0 + y1) / 2, x0, text || id) AS n,
        list_sort(list(y1 - y0) OVER (PARTITION BY page)) AS h FROM b),
    r AS (SELECT page, n, cy, x0, t, h, cy AS anchor, 1 AS row FROM s WHERE n = 1
        UNION ALL SELECT s.page, s.n, s.cy, s.x0, s.t, s.h, CASE WHEN abs(s.cy - r.anchor) > greatest(2.0, 0.5 * s.h[len(s.h) // 2 + 1]) THEN s.cy ELSE r.anchor END,
            r.row + CASE WHEN abs(s.cy - r.anchor) > greatest(2.0, 0.5 * s.h[len(s.h) // 2 + 1]) THEN 1 ELSE 0 END FROM r JOIN s ON s.page = r.page AND s.n = r.n + 1)
    SELECT page, row, string_agg(t, ' | ' ORDER BY x0, t) AS text FROM r GROUP BY page, row""")
def layout_rows(spark, d):
    boxes = _ocr(spark, d).withColumn("text", F.concat("text", F.col("id").cast("string")))
    return ingest.layout_rows(boxes, "page")


@query("""SELECT 'source=' || source AS folder, '.txt' AS ext, count(*) AS rows_written, sum(strlen(text) + 1) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY source""")
def read_files(spark, d):
    """Documents as text files, a folder a source, listed with their sizes; the lines written are counted beside them."""
    folder = shared_folder(spark, "files")
    docs = table(spark, d, "documents").where("text is not null")
    docs.select("source", "text").write.partitionBy("source").text(folder)
    found = readers.read_files(spark, folder, "*.txt").withColumn("folder", F.regexp_extract("path", "/(source=[^/]+)/", 1))
    sizes = found.groupBy("folder", "ext").agg(F.sum("size").alias("bytes"))
    return sizes.join(docs.groupBy(F.concat(F.lit("source="), "source").alias("folder")).agg(F.count("*").alias("rows_written")), "folder").select("folder", "ext", "rows_written", "bytes")
