"""Text, name, e-mail and number functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle import functions as H

from . import register, table

#: Nicknames of the words that serve as given names in the part table.
GROUPS = [["small", "mini"], ["large", "big"], ["red", "rouge"], ["old", "aged", "hot"]]
SQL_FOLD = "lower(replace(replace(replace(replace(strip_accents({0}), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'))"
SQL_PERSON = "trim(regexp_replace(regexp_replace(regexp_replace(" + SQL_FOLD + r", '\s*\([^)]*\)', ' ', 'g'), '\b(?:dr|prof|professor)\.?\s*', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
SQL_SQUEEZE = r"trim(regexp_replace({0}, '[ \t-\r]+', ' ', 'g'))"


def column(name: str, source: str, key: str, out: str, expr: Column, sql: str) -> None:
    """Registers a query that applies one function to a column of a whole table."""

    @register(name, f"SELECT {key}, {sql} AS {out} FROM {source}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(*[k.strip() for k in key.split(",")], expr().alias(out))


DOC, PART = ("documents", "doc_id"), ("part", "p_partkey")
column("fn_norm_person", *DOC, "person", lambda: H.norm_person("text"), SQL_PERSON.format("coalesce(text, '')"))
column("fn_norm_text", *DOC, "folded", lambda: H.norm_text("text"), f"trim(regexp_replace({SQL_FOLD.format('text')}, '[^a-z0-9]+', ' ', 'g'))")
column("fn_norm_text_keep", *DOC, "kept_letters", lambda: H.norm_text("text", "keep"), r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))")
column("fn_norm_text_space", *DOC, "spaced", lambda: H.norm_text("text", "space"), f"lower({SQL_SQUEEZE.format('text')})")
column("fn_norm_text_letters", *PART, "letters", lambda: H.norm_text("p_brand", "letters"), "trim(regexp_replace(lower(p_brand), '[^a-z ]', '', 'g'))")
column("fn_strip_accents", *DOC, "plain", lambda: H.strip_accents("text"), "replace(replace(replace(strip_accents(text), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')")
column("fn_strip_html", "pages", "page_id", "stripped", lambda: H.strip_html("html"), "regexp_replace(html, '<[^>]+>', '', 'g')")
column("fn_norm_email", "customer", "c_custkey", "email", lambda: H.norm_email(F.concat(F.lit("  "), "c_name", F.lit("@Mail.EXAMPLE.com; "))), "lower(c_name) || '@mail.example.com'")
EMAILS = "c_name || '@a.com; x ' || c_mktsegment || '@b.org,none'"
column("fn_split_emails", "customer", "c_custkey", "emails", lambda: H.split_emails(F.expr(EMAILS)), f"list_filter(regexp_split_to_array(lower({EMAILS}), '[;\\s]+'), lambda x: contains(x, '@'))")
column("fn_extract_emails", *DOC, "emails", lambda: F.array_sort(H.extract_emails("text")), r"list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+'), lambda x: lower(x))))")
column("fn_without_emails", *DOC, "rest", lambda: H.without_emails("text"), r"CASE WHEN regexp_matches(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+') THEN replace(regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+', '', 'g'), ';', ' ') ELSE text END")
column("fn_fix_email", "customer", "c_custkey", "fixed", lambda: H.fix_email(F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'see jo' || c_custkey || ' mail.org now' WHEN c_custkey % 3 = 1 THEN c_custkey || ' mail.org' ELSE 'a@b.org' END")), "CASE WHEN c_custkey % 3 = 0 THEN 'see jo' || c_custkey || '@mail.org now' WHEN c_custkey % 3 = 1 THEN c_custkey || ' mail.org' ELSE 'a@b.org' END")
NAMED_YEAR = "cast(o_custkey as string) || ' x, ' || cast(year(o_orderdate) as string) || ' and 2001'"
column("fn_extract_year", "orders", "o_orderkey", "year", lambda: H.extract_year(F.expr(NAMED_YEAR)), r"try_cast(regexp_extract(" + NAMED_YEAR.replace("as string", "as varchar") + r", '\b(19[5-9][0-9]|20[0-3][0-9])\b', 1) AS INTEGER)")
column("fn_without_year", "orders", "o_orderkey", "rest", lambda: H.without_year(F.expr("'k' || o_orderkey || ', ' || cast(year(o_orderdate) as string) || ' on 2001'")), "'k' || o_orderkey || ',  on 2001'")
column("fn_clean_name", *PART, "clean", lambda: H.clean_name(F.expr("', ' || CASE WHEN p_partkey % 2 = 0 THEN p_name || ' (' || p_brand || ')' ELSE upper(p_name) END || '  on hold. '")), "CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END")
column("fn_looks_like_name", *PART, "named", lambda: H.looks_like_name(F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END")), "p_partkey % 2 = 0")
column("fn_name_from_email", *PART, "name", lambda: H.name_from_email(F.expr("replace(p_name, ' ', '.') || CASE WHEN p_partkey % 2 = 0 THEN '.7' ELSE 'x9' END || '@d.org'")), "CASE WHEN p_partkey % 2 = 0 THEN upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) ELSE '' END")
column("fn_email_parts", "customer", "c_custkey", "domain", lambda: H.email_parts(F.expr("c_name || '@' || c_mktsegment || '.org;'"))["domain"], "lower(c_mktsegment) || '.org'")
column("fn_split_name", *PART, "parts", lambda: F.concat_ws("|", H.split_name(F.expr("'de ' || p_name"))["first"], H.split_name(F.expr("'de ' || p_name"), "first")["last"], H.split_name(F.expr("'de ' || p_name"), "ends")["first"]), "'de ' || split_part(p_name, ' ', 1) || '|' || p_name || '|de'")
column("fn_name_splits", *PART, "splits", lambda: F.transform(H.name_splits(F.expr("p_name || ' ' || p_type")), lambda s: F.concat(s["first"], F.lit("/"), s["last"])), "[split_part(p_name, ' ', 1) || '/' || split_part(p_name, ' ', 2) || ' ' || lower(p_type), p_name || '/' || lower(p_type)]")
column("fn_tokenize_names", *PART, "names", lambda: H.tokenize_names(F.expr("split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) || '; ' || p_name || ' and Ann Lee, Bo' || chr(10) || p_type")), "[p_name, p_name, 'Ann Lee', 'Bo', p_type]")
column("fn_name_variants", *PART, "variants", lambda: H.name_variants(F.expr("split_part(p_name, ' ', 1) || ' (' || p_type || ') ' || split_part(p_name, ' ', 2)")), "[split_part(p_name, ' ', 1) || ' (' || p_type || ') ' || split_part(p_name, ' ', 2), p_name] || CASE WHEN lower(p_type) = split_part(p_name, ' ', 1) THEN [] ELSE [p_type || ' ' || split_part(p_name, ' ', 2)] END")
column("fn_name_queries", *PART, "forms", lambda: H.name_queries(F.expr("split_part(p_name, ' ', 1) || ' van der ' || split_part(p_name, ' ', 2)")), "[split_part(p_name, ' ', 1) || ' van der ' || split_part(p_name, ' ', 2), split_part(p_name, ' ', 1) || ' der ' || split_part(p_name, ' ', 2), p_name]")
ALT = "p_name || CASE p_partkey % 6 WHEN 0 THEN ' (formerly Ada Stone)' WHEN 1 THEN ' (but was Ada Stone while in Rome)' WHEN 2 THEN ' (Bo Stone)' WHEN 3 THEN ' (of Stone)' WHEN 4 THEN ' formerly Stone' ELSE ' (now one of the staff)' END"
column("fn_alt_names", *PART, "names", lambda: H.alt_names(F.expr(ALT), [("small", "mini")]), "list_transform(flatten(list_transform(CASE WHEN split_part(p_name, ' ', 1) = 'small' THEN ['small', 'Mini'] ELSE [split_part(p_name, ' ', 1)] END, lambda f: list_transform(CASE WHEN p_partkey % 6 < 3 THEN [split_part(p_name, ' ', 2), 'Stone'] WHEN p_partkey % 6 = 4 THEN ['Stone'] ELSE [split_part(p_name, ' ', 2)] END, lambda l: f || ' ' || l))), lambda x: x)")
column("fn_query_list", *PART, "queries", lambda: H.query_list("p_name", "p_brand"), "[p_name, p_name || ' ' || p_brand]")
column("fn_ordered_distinct", *PART, "kept", lambda: H.ordered_distinct(F.array(F.upper("p_name"), F.col("p_name"), F.col("p_type"), F.lower("p_type"), F.lit("")), lambda x: F.lower(x)), "[upper(p_name), p_type]")
column("fn_norm_affil", *PART, "affil", lambda: H.norm_affil(F.expr("'Department of ' || p_name || ', School of ' || p_type")), "p_name || ' ' || lower(p_type)")
column("fn_token_overlap", *PART, "overlap", lambda: H.token_overlap(F.col("p_name"), F.expr("split_part(p_name, ' ', 2) || CASE p_partkey % 4 WHEN 0 THEN ' a b' WHEN 1 THEN ' ' || p_name WHEN 2 THEN '' ELSE 'x' END")), "CASE p_partkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE")
column("fn_token_containment", *PART, "held", lambda: H.token_containment(F.col("p_name"), F.lit("a large old gizmo plate")), "len(list_filter(string_split(p_name, ' '), lambda w: len(w) > 3)) > 0 AND 2 * len(list_filter(string_split(p_name, ' '), lambda w: len(w) > 3 AND contains('a large old gizmo plate', w))) >= len(list_filter(string_split(p_name, ' '), lambda w: len(w) > 3))")
column("fn_inst_similarity", *PART, "similarity", lambda: H.inst_similarity(F.col("p_name"), F.expr("CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'the ' || p_name || ' works' WHEN 2 THEN split_part(p_name, ' ', 1) ELSE 'none of it' END")), "CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN CASE WHEN len(p_name) >= 8 THEN 0.75 ELSE 0.6 END WHEN 2 THEN 0.6 ELSE 0.0 END::DOUBLE")
column("fn_country", "nation", "n_nationkey", "country", lambda: H.country(F.expr("' ' || n_name || '  '"), {"nation_1": "One", "nation_2": "Two"}), "CASE n_name WHEN 'NATION_1' THEN 'One' WHEN 'NATION_2' THEN 'Two' ELSE n_name END")
column("fn_is_us", "supplier", "s_suppkey", "us", lambda: H.is_us(F.expr("CASE s_suppkey % 4 WHEN 0 THEN ' usa' WHEN 1 THEN 'United   States ' WHEN 2 THEN 'Nation ' || s_nationkey END"), {"usa": "United States"}), "s_suppkey % 4 < 2")
column("fn_us_state", "supplier", "s_suppkey", "state", lambda: H.us_state(F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'ny' WHEN 1 THEN 'New  York' WHEN 2 THEN 'Nowhere' ELSE 'CA' END"), F.expr("CASE WHEN s_nationkey < 12 THEN 'United States' ELSE 'Elsewhere' END"), {"new york": "NY", "california": "CA"}), "CASE WHEN s_nationkey < 12 THEN CASE s_suppkey % 4 WHEN 0 THEN 'NY' WHEN 1 THEN 'NY' WHEN 2 THEN NULL ELSE 'CA' END END")
column("fn_levenshtein", *PART, "distance", lambda: F.levenshtein(F.col("p_name"), F.lit("small gear"), 3), "CASE WHEN levenshtein(p_name, 'small gear') > 3 THEN -1 ELSE levenshtein(p_name, 'small gear') END::INTEGER")
column("fn_names_compatible", *PART, "compatible", lambda: H.names_compatible(F.col("p_name"), F.expr("CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 1 THEN left(p_name, 1) || 'x ' || split_part(p_name, ' ', 2) ELSE 'zz ' || split_part(p_name, ' ', 2) END")), "p_partkey % 3 < 2")
column("fn_surname_gate", *PART, "passed", lambda: H.surname_gate(F.expr("split_part(p_name, ' ', 2)"), F.lit("a gear of an old bolt")), "split_part(p_name, ' ', 2) IN ('gear', 'bolt', 'old')")
column("fn_nickname_equal", *PART, "same", lambda: H.nickname_equal(F.expr("split_part(p_name, ' ', 1)"), F.lit("big"), GROUPS), "split_part(p_name, ' ', 1) = 'large'")
REL = "CASE p_partkey % 6 WHEN 0 THEN 'He is my advisor' WHEN 1 THEN 'Advisor of my advisor, Member of my dissertation committee' WHEN 2 THEN 'My advisor’s advisor, is my advisor' WHEN 3 THEN 'Member of my dissertation committee' WHEN 4 THEN 'Other' ELSE '' END"
column("fn_relation_class", *PART, "relation", lambda: H.relation_class(F.expr(REL)).cast("string"), "CASE p_partkey % 6 WHEN 0 THEN '{1, 1, false, true, false, false, false}' WHEN 1 THEN '{null, 1, false, false, true, true, true}' WHEN 2 THEN '{1, 1, true, true, false, true, false}' WHEN 3 THEN '{null, 1, false, false, true, false, false}' ELSE '{null, null, false, false, false, false, false}' END")
column("fn_text_flags", *PART, "flags", lambda: H.text_flags(F.expr("CASE p_partkey % 5 WHEN 0 THEN '* note' WHEN 1 THEN 'dropped out' WHEN 2 THEN ' ASDF ' WHEN 3 THEN 'on committee' ELSE 'Other: x' END")).cast("string"), "CASE p_partkey % 5 WHEN 0 THEN '{true, false, false, false, false}' WHEN 1 THEN '{false, true, false, false, false}' WHEN 2 THEN '{false, false, true, false, false}' WHEN 3 THEN '{false, false, false, true, false}' ELSE '{false, false, false, false, true}' END")
column("fn_parse_bool", *PART, "flag", lambda: H.parse_bool(F.expr("CASE p_partkey % 4 WHEN 0 THEN ' TRUE' WHEN 1 THEN '1' WHEN 2 THEN 'no' END")), "p_partkey % 4 < 2")
column("fn_parse_int", *PART, "number", lambda: H.parse_int(F.expr("CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_size || ' ' ELSE p_size || 'a' END")), "CASE WHEN p_partkey % 2 = 0 THEN p_size END")
column("fn_safe_num", *PART, "number", lambda: H.decorated_int(F.expr("'about ' || p_size || ',000'")), "p_size::BIGINT * 1000")
column("fn_norm_id", "pages", "page_id", "id", lambda: H.norm_id("url"), r"regexp_extract(trim(url), '([^/=?#&]*?)(?:\.html?)?/?(?:[#&].*)?$', 1)")
column("fn_url_class", "pages", "page_id", "classes", lambda: H.url_class("url").cast("string"), r"'{' || (url LIKE 'http%')::VARCHAR || ', ' || regexp_matches(url, '(?i)[?&](?:q|query|search)=')::VARCHAR || ', ' || (NOT regexp_matches(url, '(?i)[?&](?:q|query|search)='))::VARCHAR || '}'")
column("fn_html_ids", "pages", "page_id", "ids", lambda: F.array_sort(H.html_ids("html")), """list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1)))""")
column("fn_codes", *PART, "codes", lambda: H.codes(F.expr("'JEL: N13, Q' || (10 + p_size % 50) || ', N13; ' || p_size || ' H index, 1,' || (100 + p_size) || ' Citations'")).cast("string"), "'{[N13, Q' || (10 + p_size % 50) || '], ' || p_size || ', 1' || (100 + p_size) || '}'")
column("fn_preview", *PART, "line", lambda: H.preview(F.expr("array(struct(p_name as title, p_size as year, p_size * 2 as citations), struct(p_type as title, cast(null as int) as year, cast(null as int) as citations))")), "p_name || ' (' || p_size || '), cites=' || p_size * 2 || '; ' || p_type || ' (?), cites=0'")
column("fn_coalesce_blank", *PART, "label", lambda: H.coalesce_blank(F.expr("CASE WHEN p_partkey % 2 = 0 THEN '  ' ELSE p_name END"), "p_brand"), "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END")
column("fn_format_rate", "nation", "n_nationkey", "rate", lambda: H.format_rate(F.col("n_nationkey"), F.col("n_nationkey") * 4), "CASE WHEN n_nationkey = 0 THEN 'n/a' ELSE n_nationkey || '/' || n_nationkey * 4 || ' (25.0%)' END")
column("fn_name_key", *PART, "key", lambda: H.name_key(F.expr("'Dr. ' || p_name"), "p_brand").cast("string"), "'{' || p_name || ', ' || lower(replace(p_brand, '#', ' ')) || '}'")


@register("fn_canon", "SELECT c_custkey, coalesce('canon ' || lower(c_mktsegment), '') AS canon FROM customer")
def fn_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw spellings with odd case and punctuation joined to a dictionary by their key."""
    raw = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.initcap("c_mktsegment"), F.lit(" ., ")).alias("raw"))
    words = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("key")).distinct().withColumn("canon", F.concat(F.lit("canon "), "key"))
    return raw.join(words, H.canon_key("raw") == F.col("key"), "left").select("c_custkey", F.coalesce("canon", F.lit("")).alias("canon"))


@register("fn_ro_ratio")
def fn_ro_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the pairs of distinct part names that reach .75."""
    from heddle.operators.match import near_pairs

    names = table(spark, sf_dir, "part").select("p_name").distinct()
    pairs = near_pairs(names.select(F.col("p_name").alias("probe")), names.select(F.col("p_name").alias("name")), 0.75)
    return pairs.select(F.col("probe").alias("a"), F.col("name").alias("b"), H.ro_ratio("probe", "name").alias("ratio")).where("ratio >= 0.75")


#: Names as people write them, made of the words of a part and of its place in the table.
SPELLED = "CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN left(p_name, 1) || ' ' || split_part(p_name, ' ', 2) WHEN 2 THEN p_name || 's' WHEN 3 THEN split_part(p_name, ' ', 1) || ' van ' || split_part(p_name, ' ', 2) WHEN 4 THEN left(p_name, 4) || ' ' || split_part(p_name, ' ', 2) WHEN 5 THEN split_part(p_name, ' ', 1) || 'e ' || split_part(p_name, ' ', 2) || 'gear' ELSE left(p_name, 1) || ' ' || split_part(p_name, ' ', 2) || 'gearx' END"


@register("fn_same_person")
def fn_same_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reason ladder over all pairs of distinct spellings whose last tokens are equal or near; others have none."""
    from heddle.operators.match import near_pairs

    n = table(spark, sf_dir, "part").select(H.norm_person(F.expr(SPELLED)).alias("name")).distinct().withColumn("last", H.ends(F.col("name"))[1])
    lasts = n.select("last").distinct()
    near = near_pairs(lasts.select(F.col("last").alias("probe")), lasts.select(F.col("last").alias("name")), 0.9).withColumn("rl", H.ro_ratio("probe", "name")).where("rl >= 0.9")
    a, b = n.select(F.col("name").alias("a"), F.col("last").alias("probe")), n.select(F.col("name").alias("b"), F.col("last").alias("name"))
    pairs = near.join(a, "probe").join(b, "name").select("a", "b", "rl").withColumn("rf", H.ro_ratio(H.ends(F.col("a"))[0], H.ends(F.col("b"))[0]))
    return pairs.select("a", "b", H.same_person(F.col("a"), F.col("b"), GROUPS, F.col("rf"), F.col("rl")).alias("reason")).where("reason is not null")


@register("fn_coauthors", """
WITH t AS (SELECT l_orderkey AS id, l_linenumber AS ord, p_name AS n FROM lineitem JOIN part ON p_partkey = l_partkey),
own AS (SELECT id, arg_min(n, (ord, n)) AS n FROM t GROUP BY id),
d AS (SELECT t.id, t.n FROM t ANTI JOIN own ON own.id = t.id AND own.n = t.n UNION SELECT id, n || ' senior' FROM t WHERE ord = 3),
k AS (SELECT id, split_part(n, ' ', 1) || '::' || split_part(n, ' ', -1) AS author_key, arg_max(n, (len(string_split(n, ' ')), len(n), n)) AS display FROM d GROUP BY 1, 2)
SELECT id, author_key, display FROM k WHERE NOT EXISTS (SELECT 1 FROM k x WHERE x.id = k.id AND starts_with(x.display, k.display || ' '))""")
def fn_coauthors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author text of each order (its parts as "Last, First", the third also with a suffix) taken apart again, without the first part."""
    from heddle.operators.describe import coauthors

    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey AS id", "l_linenumber", "p_name")
    text = "split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) || CASE WHEN l_linenumber = 3 THEN ' and ' || p_name || ' senior.' ELSE '; Solo' END"
    works = items.select("id", F.col("l_linenumber").alias("at"), F.expr(text).alias("authors"))
    own = items.groupBy("id").agg(F.min_by("p_name", F.struct("l_linenumber", "p_name")).alias("name"))
    return coauthors(works, own)
