"""Corpus cleaning queries over the lines of documents.

The tables' furniture is rarer than a web site's, so shares are parameters here;
the operators' defaults stay what they are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loamix.functions import text as T
from loamix.operators import furniture as O
from loamix.plans import LABEL, LINES, NORM, table

SHARE = 0.005


def q_line_df(spark, sf_dir):
    freq = O.document_frequency(table(spark, sf_dir, "documents")).filter("df > 1")
    return freq.select(F.md5(F.col("key").cast("binary")).alias("key_md5"), "df")


def q_repeated_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return O.at_least_share(O.document_frequency(docs), docs, 0.02, 20)


def q_furniture(spark, sf_dir):
    return O.find_furniture(table(spark, sf_dir, "documents"), SHARE)


def q_site_contact_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    call = F.when(F.col("doc_id") % 10 == 0, F.lit("\nCall +12 345 678 9012 now")).otherwise(F.lit(""))
    return O.find_site_contact_lines(docs.withColumn("text", F.concat("text", call)), F.col("source") == "src0", 0.05)


def q_own_content(spark, sf_dir):
    return O.own_content(table(spark, sf_dir, "documents"))


def q_contentless(spark, sf_dir):
    return O.find_contentless(table(spark, sf_dir, "documents"))


def q_strip_furniture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = O.strip_furniture(docs, O.find_furniture(docs, SHARE))
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("n_removed").cast("bigint").alias("n_removed"))


def q_alias_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://example.org/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return O.alias_groups(docs, "doc_id", url, F.col("text"))


def q_redundant_props(spark, sf_dir):
    lines = O.page_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).join(
        table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category")), "doc_id"
    )
    rows = lines.select((F.col("doc_id") * 100000 + F.col("pos")).alias("id"), F.col("line").alias("text"), "category", F.col("doc_id").alias("parent_id"))
    return O.redundant_propositions(rows).filter("drop").select("id", "category")


def with_figures(spark, sf_dir):
    """Document lines with figures put in by rule, as the tables hold none."""
    lines = O.page_lines(table(spark, sf_dir, "documents")).select("doc_id", (F.col("pos") * 3).alias("pos"), "line")
    on = (F.col("doc_id") + F.col("pos") / 3) % 3 == 0
    extra = lines.filter(on).select("doc_id", (F.col("pos") + 1).alias("pos"), F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "%").otherwise("+")).alias("line"))
    told = lines.filter(on & (F.col("doc_id") % 5 < 2)).select("doc_id", (F.col("pos") + 2).alias("pos"), F.lit("of all students passed").alias("line"))
    return lines.unionByName(extra).unionByName(told)


FIGURES = """base AS (
  SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1) * 3 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
raw AS (
  SELECT doc_id, pos, line FROM base
  UNION ALL
  SELECT doc_id, pos + 1, doc_id::VARCHAR || CASE WHEN doc_id % 2 = 0 THEN '%' ELSE '+' END FROM base WHERE (doc_id + pos // 3) % 3 = 0
  UNION ALL
  SELECT doc_id, pos + 2, 'of all students passed' FROM base WHERE (doc_id + pos // 3) % 3 = 0 AND doc_id % 5 < 2),
figures AS (SELECT doc_id, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM raw)"""


def q_orphan_stats(spark, sf_dir):
    return O.orphan_stats(with_figures(spark, sf_dir)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


def q_figure_columns(spark, sf_dir):
    out = O.figure_columns(with_figures(spark, sf_dir))
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


def q_scoped_line_dedup(spark, sf_dir):
    lines = O.page_lines(table(spark, sf_dir, "documents"))
    rows = lines.withColumn("line", F.when(F.col("pos") % 3 == 2, F.concat(F.lit("| "), F.col("line"))).otherwise(F.col("line")))
    rows = rows.withColumn("key", T.normalised(F.col("line")))
    return O.scoped_line_dedup(rows).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


def q_dead_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    marked = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Oops! "), F.col("text"))).when(
        F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" page not found"))
    ).otherwise(F.col("text"))
    return docs.select("doc_id", T.looks_dead(marked).alias("dead"))


def q_removed_lines(spark, sf_dir):
    """Lines of each document that cleaning would remove, and how many."""
    docs = table(spark, sf_dir, "documents")
    found = O.page_lines(docs).join(O.find_furniture(docs, SHARE).select("key"), "key", "left_semi")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_removed"), F.min("key").alias("first_key"))


def q_contact_facts(spark, sf_dir):
    lines = O.page_lines(table(spark, sf_dir, "documents")).filter(T.looks_like_contact_fact(F.col("line")))
    return lines.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


def q_not_found_lines(spark, sf_dir):
    """Lines that two probe pages share, without those of a home page; pages that hold all of them."""
    docs = table(spark, sf_dir, "documents")
    keys = O.page_keys(docs.withColumn("text", F.concat(F.when(F.col("doc_id") % 10 == 1, F.lit("Nothing lives here\nTry the search\n")).otherwise(""), F.lit("Welcome\n"), F.col("text"))))
    of = lambda i: keys.filter(F.col("doc_id") == i).select("key")
    learned = of(1).intersect(of(11)).subtract(of(0))
    n = learned.agg(F.count("*").alias("n"))
    hits = keys.join(F.broadcast(learned), "key", "left_semi").groupBy("doc_id").agg(F.count("*").alias("hits"))
    return hits.crossJoin(F.broadcast(n)).filter("hits = n and n > 0").select("doc_id", "hits")


_FURN = f"""furn AS (SELECT key, df FROM freq, total WHERE n >= 20 AND df >= greatest(2, floor(n * {SHARE})) AND {LABEL.format('key')})"""
_CONTACT = r"'\+?\d[\d\s()\-]{7,}\d|\b[\w.\-]+@[\w.\-]+\.\w+\b|\b\w+\.(?:edu|com|org|net|pk)\b'"
_OWN = f"""rare AS (SELECT key FROM freq WHERE df < 4 AND NOT {LABEL.format('key')}),
own AS (SELECT DISTINCT doc_id FROM keyed WHERE key IN (SELECT key FROM rare))"""

SQL = {
    "q_line_df": f"WITH {LINES} SELECT md5(key) AS key_md5, df FROM freq WHERE df > 1",
    "q_repeated_lines": f"WITH {LINES} SELECT key, df FROM freq, total WHERE n >= 20 AND df >= greatest(2, floor(n * 0.02))",
    "q_furniture": f"WITH {LINES}, {_FURN} SELECT key, df FROM furn",
    "q_site_contact_lines": f"""WITH called AS (SELECT doc_id, source, text || CASE WHEN doc_id % 10 = 0 THEN chr(10) || 'Call +12 345 678 9012 now' ELSE '' END AS text FROM documents),
        {LINES.replace('FROM documents),', 'FROM called),', 1)} SELECT key, df FROM freq, total
        WHERE n >= 20 AND df >= greatest(2, floor(n * 0.05)) AND key <> '' AND regexp_matches(key, {_CONTACT})
          AND key IN (SELECT key FROM keyed JOIN documents USING (doc_id) WHERE source = 'src0')""",
    "q_own_content": f"WITH {LINES}, {_OWN} SELECT doc_id, doc_id IN (SELECT doc_id FROM own) AS has_own FROM documents",
    "q_contentless": f"WITH {LINES}, {_OWN} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM own) AND (SELECT n FROM total) >= 20",
    "q_strip_furniture": f"""WITH {LINES}, {_FURN},
        kept AS (SELECT doc_id, pos, line, key <> '' AND key NOT IN (SELECT key FROM furn) AS stays FROM keyed)
        SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS text_md5,
               count(*) FILTER (WHERE NOT stays)::BIGINT AS n_removed FROM kept GROUP BY doc_id""",
    "q_alias_groups": f"""WITH {LINES},
        texts AS (SELECT doc_id, coalesce(string_agg(key, chr(10) ORDER BY pos) FILTER (WHERE key <> ''), '') AS k FROM keyed GROUP BY doc_id),
        pages AS (SELECT doc_id, k, 'https://example.org/' || source || '/' || doc_id::VARCHAR AS url FROM texts JOIN documents USING (doc_id)),
        groups AS (SELECT k, count(*) AS group_size, first(url ORDER BY length(url) - length(replace(url, '/', '')), length(url), url) AS canonical
                   FROM pages GROUP BY k HAVING count(*) > 1)
        SELECT doc_id, url, canonical, group_size FROM pages JOIN groups USING (k)""",
    "q_redundant_props": r"""WITH rows AS (
          SELECT doc_id * 100000 + generate_subscripts(string_split(text, chr(10)), 1) - 1 AS id, unnest(string_split(text, chr(10))) AS t, lang AS category, doc_id AS parent_id
          FROM documents),
        keyed AS (SELECT *, trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) AS key FROM rows),
        firsts AS (SELECT *, id = min(id) OVER (PARTITION BY key, category) AS f FROM keyed),
        marked AS (SELECT *, max(f::INT) OVER (PARTITION BY parent_id) = 0 AS none_live, id = max(id) OVER (PARTITION BY parent_id) AS is_last FROM firsts)
        SELECT id, category FROM marked WHERE NOT f AND NOT (none_live AND is_last)""",
    "q_orphan_stats": f"""WITH {FIGURES},
        solid AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM figures WHERE line <> '')
        SELECT doc_id, pos::BIGINT AS pos, line FROM solid
        WHERE regexp_matches(line, '^[\\d,]+\\s*[%+]?$') AND (nxt IS NULL OR regexp_matches(nxt, '^[\\d,]+\\s*[%+]?$'))""",
    "q_figure_columns": f"""WITH {FIGURES},
        around AS (SELECT *, lead(line) OVER w AS nxt, lag(line) OVER w AS prv FROM figures WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        told AS (SELECT *, regexp_matches(line, '^[\\d,]+\\s*[%+]?$') AS f, coalesce(regexp_matches(nxt, '^[\\d,]+\\s*[%+]?$'), false) AS nf,
                        coalesce(regexp_matches(prv, '^[\\d,]+\\s*[%+]?$'), false) AS pf FROM around)
        SELECT doc_id, pos::BIGINT AS pos, md5(CASE
            WHEN f AND nxt IS NOT NULL AND NOT nf AND length(nxt) <= 60 AND regexp_matches(nxt, '[A-Za-z]') THEN line || ' ' || nxt
            WHEN f AND (nf OR pf) THEN line || ' (no caption)' ELSE line END) AS line_md5
        FROM told WHERE NOT (pf AND NOT f AND length(line) <= 60 AND regexp_matches(line, '[A-Za-z]'))""",
    "q_scoped_line_dedup": f"""WITH cut AS (
          SELECT doc_id, pos, CASE WHEN pos % 3 = 2 THEN '| ' || line ELSE line END AS line FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)),
        keyed AS (SELECT *, {NORM.format('line')} AS key, starts_with(trim(line), '|') AS is_row FROM cut),
        solid AS (SELECT * FROM keyed WHERE key <> ''),
        scoped AS (SELECT *, CASE WHEN is_row THEN coalesce(last_value(CASE WHEN NOT is_row THEN key END IGNORE NULLS)
                     OVER (PARTITION BY doc_id ORDER BY pos), '') ELSE '' END AS scope FROM solid),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, scope, key, is_row ORDER BY pos) AS r FROM scoped)
        SELECT doc_id, pos::BIGINT AS pos, line FROM ranked WHERE r = 1 OR regexp_matches(key, '^[\\d,]+\\s*[%+]?$')""",
    "q_dead_pages": r"""SELECT doc_id, regexp_matches(substr(CASE WHEN doc_id % 7 = 0 THEN 'Oops! ' || text
          WHEN doc_id % 11 = 0 THEN text || ' page not found' ELSE text END, 1, 300),
          '(?i)(something went wrong|couldn''?t find your page|page not found|\b404\b|back to home|oops)') AS dead FROM documents""",
    "q_removed_lines": f"WITH {LINES}, {_FURN} SELECT doc_id, count(*) AS n_removed, min(key) AS first_key FROM keyed WHERE key IN (SELECT key FROM furn) GROUP BY doc_id",
    "q_contact_facts": f"""WITH {LINES} SELECT doc_id, pos::BIGINT AS pos, md5(line) AS line_md5 FROM keyed
        WHERE regexp_replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), '^[ #•|]+|[ #•|]+$', '', 'g') <> ''
          AND regexp_matches(regexp_replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), '^[ #•|]+|[ #•|]+$', '', 'g'), {_CONTACT})""",
    "q_not_found_lines": f"""WITH pages AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'Nothing lives here' || chr(10) || 'Try the search' || chr(10) ELSE '' END
            || 'Welcome' || chr(10) || text AS text FROM documents),
        keys AS (SELECT DISTINCT doc_id, {NORM.format('line')} AS key FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM pages)),
        solid AS (SELECT * FROM keys WHERE key <> ''),
        learned AS (SELECT key FROM solid WHERE doc_id = 1 INTERSECT SELECT key FROM solid WHERE doc_id = 11 EXCEPT SELECT key FROM solid WHERE doc_id = 0)
        SELECT doc_id, count(*) AS hits FROM solid WHERE key IN (SELECT key FROM learned) GROUP BY doc_id
        HAVING count(*) = (SELECT count(*) FROM learned)""",
}

QUERIES = {name: globals()[name] for name in SQL}
