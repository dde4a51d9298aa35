"""Queries over file text: scans, lines, patterns, rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text, vocab
from codeloom.operators import edits, registry, scan, symbols
from codeloom.sources import files as sources
from suite.registry import query

AUTH_TOKEN = vocab.SECRET_RULES[2][1]
_Q = "''"


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", _Q) + "'"


def _count(rules) -> str:
    return " + ".join(f"len(regexp_extract_all(content, {_sql_text(r[1])}))" for r in rules)


# Rules that do occur in the corpus: capitals before a full stop, and two commas on a line.
CUSTOM_RULES = [
    ("shouted", r"[A-Z][a-z]+\.\n", "Sentence end at line end", "style", "low"),
    ("number", r"[0-9]{3,}", "Long number", "style", "medium"),
]


def _match_lines(pattern: str, label: str) -> str:
    """SQL for the line on which each match starts: newlines of all text before it."""
    p = _sql_text(pattern)
    return f"""
        SELECT repo, path, {_sql_text(label)} AS label, CAST(k AS BIGINT) AS match_ord,
               CAST(length(pre) - length(replace(pre, chr(10), '')) + 1 AS BIGINT) AS line
        FROM (SELECT repo, path, k, array_to_string(list_slice(seg, 1, k + 1), '')
                     || coalesce(array_to_string(list_slice(m, 1, k), ''), '') AS pre
              FROM (SELECT repo, path, m, seg, unnest(range(len(m))) AS k
                    FROM (SELECT repo, path, regexp_extract_all(content, {p}) AS m,
                                 string_split_regex(content, {p}) AS seg FROM files) WHERE len(m) > 0))"""


@query("files", f"""
    SELECT repo, path, CAST({_count(vocab.SECRET_RULES)} AS BIGINT) AS high_severity,
           CAST({_count(vocab.INSECURE_RULES)} AS BIGINT) AS medium_severity,
           CAST({_count(vocab.SECRET_RULES + vocab.INSECURE_RULES)} AS BIGINT) AS total_issues FROM files""")
def security_summary(t):
    return scan.security_summary(t.files)


@query("files", _match_lines(AUTH_TOKEN, "Auth Token"))
def secret_lines(t):
    hits = scan.secret_scan(t.files, with_code=False)
    return hits.select("repo", "path", "label", F.col("match_ord").cast("long"), F.col("line").cast("long"))


@query("files", " UNION ALL ".join(_match_lines(r[1], r[2]) for r in CUSTOM_RULES))
def rule_hits(t):
    hits = scan.rule_hits(t.files, CUSTOM_RULES, with_code=False)
    return hits.select("repo", "path", "label", F.col("match_ord").cast("long"), F.col("line").cast("long"))


# Five hundred rules of a table: each wants its own number behind a full stop and space, two also a literal.
N_TABLE_RULES = 500


@query("files", """
    WITH m AS (SELECT repo, path, unnest(regexp_extract_all(content, '[a-z]{2,}[.,] [A-Z]')) AS found FROM files)
    SELECT repo, path, 'r' || lpad(CAST(unicode(found[-1]) + 100 * (found[-3] = ',')::INT AS VARCHAR), 3, '0') AS rule_id,
           count(*) AS n FROM m GROUP BY ALL""")
def table_rules(t):
    number = F.col("id")
    sign = F.when(number < 100, r"\.").otherwise(",")
    letter = F.char(number % 100)
    upper = (number % 100).between(65, 90) & (number < 200)
    regex = F.when(upper, F.concat(F.lit("[a-z]{2,}"), sign, F.lit(" "), letter)).otherwise(F.concat(F.lit("no such text "), number.cast("string")))
    rules = t.spark.range(N_TABLE_RULES).select(
        F.concat(F.lit("r"), F.lpad(number.cast("string"), 3, "0")).alias("rule_id"), regex.alias("regex"), F.lit("sentence").alias("label"),
        F.lit("style").alias("finding_type"), F.lit("low").alias("severity"),
        F.when(upper, F.concat(F.lit(" "), letter)).when(number % 2 == 0, "no such text").alias("literal"),
    )
    hits = scan.table_rule_hits(t.files, rules, with_code=False)
    return hits.groupBy("repo", "path", "rule_id").agg(F.count(F.lit(1)).alias("n"))


# One text per part, with signs of comments inside strings and lines that go on.
@query("", """
    SELECT 'p' || k AS path, CAST(CASE WHEN k % 97 = 0 THEN 1 ELSE 8 + d + k % 4 + 4 * y + 5 * b + k % 3 END AS BIGINT) AS loc,
           CAST(CASE WHEN k % 97 <> 0 THEN 8 + d + y + b END AS BIGINT) AS lloc,
           CAST(CASE WHEN k % 97 <> 0 THEN 8 + 3 * y END AS BIGINT) AS sloc, CAST(CASE WHEN k % 97 <> 0 THEN k % 4 + 1 END AS BIGINT) AS comments,
           CAST(CASE WHEN k % 97 <> 0 THEN d + k % 4 END AS BIGINT) AS single_comments,
           CAST(CASE WHEN k % 97 <> 0 THEN 4 * b END AS BIGINT) AS multi, CAST(CASE WHEN k % 97 <> 0 THEN y + b + k % 3 END AS BIGINT) AS blank
    FROM (SELECT p_partkey AS k, (p_partkey % 3 <> 0)::INT AS d, p_partkey % 2 AS y, (p_partkey % 5 = 0)::INT AS b FROM part)""")
def raw_metrics(t):
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")
    content = F.concat(
        F.when(k % 3 != 0, F.concat(F.lit('"""Doc # of '), name, F.lit('."""\n'))).otherwise(""),
        F.repeat(F.concat(F.lit("# note "), name, F.lit("\n")), (k % 4).cast("int")),
        F.concat(F.lit('x = "# '), name, F.lit('"  # tail\n')),
        F.when(k % 2 == 1, F.concat(F.lit('y = """a\n\n# '), name, F.lit('\n"""\n'))).otherwise(""),
        F.when(k % 5 == 0, F.concat(F.lit('"""\ntext # '), size, F.lit('\n\nmore\n"""\n'))).otherwise(""),
        F.lit("a = 1; b = 2\n"), F.concat(F.lit("z = (1 +\n     "), size, F.lit(")\n")), F.lit("if x: y = 1\nv = \\\n  5\nw: int = 3\n"),
        F.repeat(F.lit("\n"), (k % 3).cast("int")),
    )
    files = t.part.select(
        F.lit("r").alias("repo"), F.concat(F.lit("p"), k.cast("string")).alias("path"),
        F.when(k % 97 == 0, "def (:\n").otherwise(content).alias("content"))
    return symbols.raw_metrics(files).drop("repo", "error")


_LINES = "CASE WHEN content LIKE '%' || chr(10) THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END"


@query("files", f"""
    SELECT repo, path, CAST(len(l) AS BIGINT) AS loc, CAST(len(b) AS BIGINT) AS blank,
           CAST(len(c) AS BIGINT) AS comments, CAST(len(l) - len(b) - len(c) AS BIGINT) AS sloc
    FROM (SELECT repo, path, l, list_filter(l, lambda x: regexp_matches(x, '^\\s*$')) AS b,
                 list_filter(l, lambda x: regexp_matches(x, '^\\s*#')) AS c
          FROM (SELECT repo, path, {_LINES} AS l FROM files))""")
def file_metrics(t):
    return scan.file_metrics(t.files)


@query("files", f"""
    SELECT repo, path, CAST(len(l) AS BIGINT) AS loc FROM (SELECT repo, path, {_LINES} AS l FROM files) WHERE len(l) > 20""")
def large_files(t):
    return scan.large_files(t.files, 20)


@query("files", f"""
    SELECT repo, path, CAST(i AS BIGINT) AS line, l[i] AS text
    FROM (SELECT repo, path, l, unnest(range(2, least(len(l), 4) + 1)) AS i FROM (SELECT repo, path, {_LINES} AS l FROM files))""")
def line_range(t):
    return scan.explode_lines(t.files, 2, 4).withColumn("line", F.col("line").cast("long"))


@query("files", f"""
    SELECT repo, path, CAST(i AS BIGINT) AS line, l[i] AS text
    FROM (SELECT repo, path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT repo, path, {_LINES} AS l FROM files))""")
def explode_lines(t):
    return scan.explode_lines(t.files).withColumn("line", F.col("line").cast("long"))


_TOKENS = r"""
    tokens AS (SELECT DISTINCT repo, path, name FROM (
        SELECT repo, path, unnest(regexp_extract_all(content, '[\p{L}\p{N}_]+')) AS name FROM files)
        WHERE length(name) >= 2 AND regexp_matches(name, '^[A-Za-z_]'))"""


@query("files", f"WITH {_TOKENS} SELECT repo, path, name FROM tokens")
def identifier_usages(t):
    return scan.identifier_usages(t.files)


@query("files", f"WITH {_TOKENS} SELECT name, count(*) AS n_files FROM tokens GROUP BY name")
def files_per_identifier(t):
    return scan.files_per_identifier(t.files)


@query("files", f"WITH {_TOKENS} SELECT repo, name, min(path) AS path FROM tokens GROUP BY ALL HAVING count(*) = 1".replace(
    "GROUP BY ALL", "GROUP BY repo, name"))
def single_file_identifiers(t):
    return scan.single_file_identifiers(t.files)


@query("files", r"""
    SELECT repo, path, name, count(*) AS n_calls FROM (
        SELECT repo, path, unnest(regexp_extract_all(content, '([\p{L}\p{N}_]+)\s*[(.]', 1)) AS name FROM files)
    GROUP BY repo, path, name""")
def call_tokens(t):
    return scan.call_tokens(t.files)


@query("files", r"""
    WITH calls AS (SELECT path, name, count(*) AS n FROM (
        SELECT path, unnest(regexp_extract_all(content, '([\p{L}\p{N}_]+)\s*\(', 1)) AS name FROM files) GROUP BY path, name)
    SELECT f.path, w.name, coalesce(c.n, 0) AS n_calls
    FROM files f CROSS JOIN (SELECT unnest(['the', 'a', 'de']) AS name) w LEFT JOIN calls c ON c.path = f.path AND c.name = w.name""")
def call_site_count(t):
    names = F.explode(F.array(F.lit("the"), F.lit("a"), F.lit("de")))
    return scan.call_site_count(t.files, t.files.select("path", names.alias("name")))


_HINTED = f"""
    WITH p AS (SELECT path, {_LINES} AS l, trim(left(trim(string_split(content, chr(10))[1]), 12)) AS hint FROM files)
    SELECT path, hint, CAST(min(i) AS BIGINT) AS line FROM (
        SELECT path, hint, i, trim(l[i]) AS x FROM (SELECT path, hint, l, unnest(range(2, len(l) + 1)) AS i FROM p))
    WHERE length(x) > 0 AND length(hint) > 0 AND (contains(x, hint) OR contains(hint, x)) GROUP BY path, hint"""


def _hints(t):
    hint = F.trim(F.substring(F.trim(F.split("content", "\n")[0]), 1, 12))
    return t.files.select("path", hint.alias("hint"), F.lit(2).alias("search_from"))


def _found_lines(found):
    return found.filter(F.col("line").isNotNull()).select("path", "hint", F.col("line").cast("long"))


@query("files", _HINTED)
def find_line_by_content(t):
    return _found_lines(scan.find_line_by_content(t.files, _hints(t)))


@query("files", _HINTED)
def lines_of_stored_texts(t):
    """The same hints sent to texts stored in buckets by path."""
    stored = t.stored_files
    return _found_lines(scan.find_line_by_content(stored.files, stored.aligned(_hints(t))))


@query("code", "SELECT path FROM code WHERE valid AND k % 2 = 0")
def whole_line_present(t):
    return scan.whole_line_present(t.code, '    """A box that holds parts."""')


# ------------------------------------------------------------------ rewrites
_BLANKED = """
    blanked AS (SELECT repo, path, array_to_string(list_transform(string_split(content, chr(10)),
        lambda x: CASE WHEN length(x) % 3 = 0 THEN '' ELSE x END), chr(10)) || chr(10) AS content FROM files)"""


@query("files", f"""
    WITH {_BLANKED},
    n AS (SELECT repo, path, l, unnest(range(1, len(l))) AS i FROM (SELECT repo, path, string_split(content, chr(10)) AS l FROM blanked)),
    kept AS (SELECT repo, path, i, x FROM (
        SELECT repo, path, i, l[i] AS x, lag(l[i]) OVER (PARTITION BY path ORDER BY i) AS before FROM n)
        WHERE NOT (regexp_matches(x, '^\\s*$') AND before IS NOT NULL AND regexp_matches(before, '^\\s*$')))
    SELECT repo, path, count(*) AS n_lines, sha256(string_agg(x, chr(10) ORDER BY i) || chr(10)) AS content_sha
    FROM kept GROUP BY repo, path""")
def collapse_blank_runs(t):
    blank = F.transform(F.split("content", "\n", -1), lambda x: F.when(F.length(x) % 3 == 0, "").otherwise(x))
    blanked = t.files.withColumn("content", F.concat(F.array_join(blank, "\n"), F.lit("\n")))
    done = edits.collapse_blank_runs(blanked)
    return done.select(
        "repo", "path", text.line_count(F.col("content")).alias("n_lines"), F.sha2("content", 256).alias("content_sha")
    )


_EDITED = f"""
    WITH n AS (SELECT repo, path, l, unnest(range(0, len(l) + 2)) AS i FROM (SELECT repo, path, {_LINES} AS l FROM files)),
    e AS (SELECT repo, path, i * 10 AS ord, l[i] AS x FROM n WHERE i BETWEEN 1 AND len(l) AND NOT (i BETWEEN 2 AND 3 AND len(l) >= 3)
                 AND NOT (i = 5 AND len(l) >= 5)
          UNION ALL SELECT repo, path, 25, 'new line' FROM n WHERE i = 0 AND len(l) >= 3
          UNION ALL SELECT repo, path, 51, 'five' FROM n WHERE i = 0 AND len(l) >= 5
          UNION ALL SELECT repo, path, 52, 'again' FROM n WHERE i = 0 AND len(l) >= 5
          UNION ALL SELECT repo, path, 5, 'top' FROM n WHERE i = 0)
    SELECT repo, path, count(*) AS n_lines, sha256(string_agg(x, chr(10) ORDER BY ord) || chr(10)) AS content_sha
    FROM e GROUP BY repo, path"""


def _planned_edits(t):
    def edit(start, end, *lines):
        new = F.array(*[F.lit(x) for x in lines]).cast("array<string>")
        return F.struct(F.lit(start).alias("start"), F.lit(end).alias("end"), new.alias("new_lines"))

    planned = F.array(edit(1, 0, "top"), edit(2, 3, "new line"), edit(5, 5, "five", "again"), edit(100000000, 100000000))
    return t.files.select("path", F.explode(planned).alias("e")).select("path", "e.*")


def _edited(done):
    return done.select(
        "repo", "path", text.line_count(F.col("content")).alias("n_lines"), F.sha2("content", 256).alias("content_sha")
    )


@query("files", _EDITED)
def apply_line_edits(t):
    return _edited(edits.apply_line_edits(t.files, _planned_edits(t)))


@query("files", _EDITED)
def edits_of_stored_texts(t):
    """The same edits sent to texts stored in buckets by path."""
    stored = t.stored_files
    return _edited(edits.apply_line_edits(stored.files, stored.aligned(_planned_edits(t))))


@query("files", f"""
    WITH n AS (SELECT path, len(l) AS size FROM (SELECT path, {_LINES} AS l FROM files)),
    e AS (SELECT path, size, unnest([0, 4, 12]) AS start, unnest([2, 8, 12]) AS end FROM n)
    SELECT path, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM e WHERE start < 1 OR "end" > size""")
def rejected_edits(t):
    spans = [(0, 2), (4, 8), (12, 12)]
    planned = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in spans])
    rows = t.files.select("path", F.explode(planned).alias("e")).select("path", "e.*")
    return edits.rejected_edits(t.files, rows)


@query("", """
    SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'removed' WHEN doc_id % 10 = 1 AND upper(text) <> text THEN 'changed'
                        ELSE 'same' END AS state FROM documents""")
def changed_files(t):
    old = t.documents.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("checksum"))
    newer = F.when(F.col("doc_id") % 10 == 1, F.upper("text")).otherwise(F.col("text"))
    new = t.documents.filter(F.col("doc_id") % 10 != 0).select(
        F.col("doc_id").alias("path"), F.sha2(newer, 256).alias("checksum")
    )
    return sources.changed_files(old, new).withColumnRenamed("path", "doc_id")


@query("files", """
    WITH p AS (SELECT DISTINCT repo AS r FROM files UNION ALL SELECT 'idle' || n_nationkey FROM nation)
    SELECT r AS repo, count(f.path) AS n_files, count(f.path) > 0 AS has_files FROM p LEFT JOIN files f ON f.repo = p.r GROUP BY r""")
def corpus_inventory(t):
    idle = t.nation.select(F.concat(F.lit("idle"), F.col("n_nationkey").cast("string")).alias("repo"))
    return sources.corpus_inventory(t.files.select("repo").distinct().unionByName(idle), t.files)


# Roots beside and inside each other: every source but those that end in 3, and two folders in each.
@query("files", """
    WITH s AS (SELECT DISTINCT repo FROM files),
    roots AS (SELECT repo AS r FROM s WHERE repo NOT LIKE '%3' UNION ALL SELECT repo || '/en' FROM s
              UNION ALL SELECT repo || '/fr' FROM s UNION ALL SELECT repo || '/e' FROM s)
    SELECT path, arg_max(r, length(r)) AS repo FROM files LEFT JOIN roots ON starts_with(path, r || '/') GROUP BY path""")
def repository_of_files(t):
    names = t.documents.select(F.col("source").alias("s")).distinct()
    every = F.array(F.when(~F.endswith("s", F.lit("3")), F.col("s")), *[F.concat("s", F.lit(end)) for end in ("/en", "/fr/", "/e", "/en/")])
    projects = names.select(F.explode(every).alias("repo_path"))
    return sources.with_repository(t.files, projects).select("path", "repo")


@query("code code_loc", "SELECT path FROM code_loc WHERE NOT contains(path, '/m1')")
def path_filter(t):
    return t.code.filter(sources.path_is_kept(F.col("path"), ["/m1"])).select("path")


# ------------------------------------------------------------------ names, lines, targets
@query("", """
    SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9_]', '_', 'g') AS env_var,
           CASE WHEN contains(lower(p_name), 'key') THEN 'your_api_key_here'
                WHEN contains(lower(p_name), 'secret') THEN 'your_secret_here'
                WHEN contains(lower(p_name), 'password') OR contains(lower(p_name), 'pwd') THEN 'your_password_here'
                WHEN contains(lower(p_name), 'token') THEN 'your_token_here'
                WHEN contains(lower(p_name), 'url') OR contains(lower(p_name), 'host') THEN 'your_url_here'
                ELSE 'your_' || lower(p_name) || '_here' END AS placeholder FROM part""")
def env_var_name(t):
    return t.part.select(
        "p_partkey", text.env_var_name(F.col("p_name")).alias("env_var"), text.placeholder(F.col("p_name")).alias("placeholder")
    )


_ASSIGN = """
    lines AS (SELECT p_partkey AS k, CASE p_partkey % 6
        WHEN 0 THEN '  api_' || p_size || ' = "' || p_name || '"  # note'
        WHEN 1 THEN 'label: str = ''' || p_name || p_brand || p_partkey || ''''
        WHEN 2 THEN 'version = "1.2.' || p_partkey || '.000000000"'
        WHEN 3 THEN 'size = ' || p_size
        WHEN 4 THEN 'kind = "' || p_type || p_brand || p_partkey || 'abcdefghijkl"'
        ELSE 'word = "averylongsimpleword"' END AS line FROM part)"""


def _assignments(t):
    k, size, name, brand, kind = (F.col(c) for c in ("p_partkey", "p_size", "p_name", "p_brand", "p_type"))
    case = k % 6
    line = (
        F.when(case == 0, F.concat(F.lit("  api_"), size, F.lit(' = "'), name, F.lit('"  # note')))
        .when(case == 1, F.concat(F.lit("label: str = '"), name, brand, k, F.lit("'")))
        .when(case == 2, F.concat(F.lit('version = "1.2.'), k, F.lit('.000000000"')))
        .when(case == 3, F.concat(F.lit("size = "), size))
        .when(case == 4, F.concat(F.lit('kind = "'), kind, brand, k, F.lit('abcdefghijkl"')))
        .otherwise(F.lit('word = "averylongsimpleword"'))
    )
    return t.part.select(k.alias("k"), line.alias("text"))


@query("", f"""
    WITH {_ASSIGN},
    g AS (SELECT k, line, trim(line) AS x FROM lines),
    p AS (SELECT k, CASE WHEN regexp_matches(x, '"') THEN regexp_extract(x, '^(\\w+)\\s*(?::\\s*[\\w\\[\\], ]+)?\\s*=\\s*"(.*?)"\\s*(?:#.*)?$', 1)
                         ELSE regexp_extract(x, '^(\\w+)\\s*(?::\\s*[\\w\\[\\], ]+)?\\s*=\\s*''(.*?)''\\s*(?:#.*)?$', 1) END AS name,
                 CASE WHEN regexp_matches(x, '"') THEN regexp_extract(x, '^(\\w+)\\s*(?::\\s*[\\w\\[\\], ]+)?\\s*=\\s*"(.*?)"\\s*(?:#.*)?$', 2)
                         ELSE regexp_extract(x, '^(\\w+)\\s*(?::\\s*[\\w\\[\\], ]+)?\\s*=\\s*''(.*?)''\\s*(?:#.*)?$', 2) END AS value FROM g)
    SELECT k, name AS variable, upper(name) AS env_var, sha256(value) AS value_sha256 FROM p
    WHERE name <> '' AND (regexp_matches(lower(name), '{"|".join(vocab.CREDENTIAL_KEYWORDS)}') OR (
        length(value) >= 12 AND NOT regexp_matches(value, '^[a-z_]+$') AND NOT regexp_matches(value, '^[0-9]+\\.[0-9.]+$')
        AND ((regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]'))
             OR (regexp_matches(value, '[-_/@:!#$%^&*]') AND length(value) > 16)
             OR (regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]') AND length(value) > 20))))""")
def credential_lines(t):
    return scan.credential_lines(_assignments(t)).select("k", "variable", "env_var", "value_sha256")


@query("", f"""
    WITH {_ASSIGN}
    SELECT k, CASE k % 6
        WHEN 0 THEN '  api_' || regexp_extract(line, 'api_([0-9]+)', 1) || ' = os.getenv("API_' || regexp_extract(line, 'api_([0-9]+)', 1) || '")'
        WHEN 1 THEN 'label = os.getenv("LABEL")'
        WHEN 4 THEN 'kind = os.getenv("KIND")'
        ELSE '# SECURITY WARNING: Hardcoded secret detected — move to environment variable' || chr(10) || '# ' || line END AS rewritten
    FROM lines""")
def rewrite_credentials(t):
    flagged = _assignments(t).select(F.col("k").alias("path"), F.lit(1).alias("line"), "text")
    rows = scan.credential_edits(flagged)
    return rows.select(F.col("path").alias("k"), F.array_join("new_lines", "\n").alias("rewritten"))


_IMPORTS_SQL = """
    lines AS (SELECT p_partkey AS k, CASE p_partkey % 4
        WHEN 0 THEN 'import a' || p_size || ', b, c as d'
        WHEN 1 THEN '    from pkg.m' || p_size || ' import a' || p_size || ' as x, b'
        WHEN 2 THEN 'import a' || p_size
        ELSE 'from m import c as d, a' || p_size END AS line,
        CASE p_partkey % 4 WHEN 0 THEN 'd' WHEN 1 THEN 'x' ELSE 'a' || p_size END AS name FROM part)"""


@query("", f"""
    WITH {_IMPORTS_SQL}
    SELECT k, CASE k % 4
        WHEN 0 THEN replace(line, ', c as d', '') WHEN 1 THEN regexp_replace(line, 'a[0-9]+ as x, ', '')
        WHEN 2 THEN line ELSE 'from m import c as d' END AS new_line, k % 4 = 2 AS whole_line FROM lines""")
def remove_import_name(t):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    own = F.concat(F.lit("a"), size)
    line = (
        F.when(k % 4 == 0, F.concat(F.lit("import "), own, F.lit(", b, c as d")))
        .when(k % 4 == 1, F.concat(F.lit("    from pkg.m"), size, F.lit(" import "), own, F.lit(" as x, b")))
        .when(k % 4 == 2, F.concat(F.lit("import "), own))
        .otherwise(F.concat(F.lit("from m import c as d, "), own))
    )
    name = F.when(k % 4 == 0, "d").when(k % 4 == 1, "x").otherwise(own)
    rows = t.part.select(k.alias("k"), line.alias("line"), name.alias("name"))
    return rows.select("k", text.without_import(F.col("line"), F.col("name")).alias("r")).select("k", "r.*")


@query("", """
    SELECT p_partkey AS k, repeat(' ', p_size % 5) || 'def f():' || chr(10) || '' || chr(10) || repeat(' ', p_size % 5 + 4) || 'return ' || p_size AS block
    FROM part""")
def reindent_block(t):
    source = F.concat(F.lit("  def f():\n\n      return "), F.col("p_size").cast("string"))
    moved = F.array_join(text.reindent(source, F.col("p_size") % 5), "\n")
    return t.part.select(F.col("p_partkey").alias("k"), moved.alias("block"))


@query("decisions", "SELECT id, action_type, context_hash FROM decisions")
def context_hash(t):
    return t.decisions.select("id", "action_type", "context_hash")


@query("queue", """
    SELECT id, split_part(target, '@', 1) AS file, split_part(split_part(target, '@', 2), ':', 1) AS entity_type,
           split_part(target, ':', 2) AS entity_name, split_part(target, '@', 1) AS queue_file FROM queue""")
def target_roundtrip(t):
    decoded = t.queue.select("id", text.decode_target(F.col("target")).alias("d")).select("id", "d.*")
    again = text.encode_target(F.col("file"), F.col("entity_type"), F.col("entity_name"))
    return decoded.select("id", "file", "entity_type", "entity_name", text.target_file(again).alias("queue_file"))


@query("", """
    SELECT conv_id, turn, CAST(b AS BIGINT) AS block, CASE b WHEN 0 THEN text || chr(10) ELSE 'pass' || chr(10) END AS code
    FROM conversations, (SELECT unnest([0, 1]) AS b) WHERE NOT contains(text, '`')""")
def extract_code_blocks(t):
    fenced = F.concat(F.lit("Here:\n```python\n"), F.col("text"), F.lit("\n```\nand\n```py\npass\n```\n"))
    rows = t.conversations.filter(~F.contains("text", F.lit("`"))).select("conv_id", "turn", fenced.alias("text"))
    return scan.extract_code_blocks(rows, ["conv_id", "turn"]).withColumn("block", F.col("block").cast("long"))


@query("files", """
    SELECT path, CASE WHEN length(content) > 60 THEN substr(content, 1, 60) || '…' ELSE content END AS preview,
           substr(content, 1, 80) AS description, substr(sha256(content), 1, 10) AS short_sum FROM files""")
def list_projection(t):
    return t.files.select(
        "path", text.preview(F.col("content")).alias("preview"), text.clip(F.col("content")).alias("description"),
        F.substring(F.sha2("content", 256), 1, vocab.CHECKSUM_CHARS).alias("short_sum"),
    )


@query("code code_hits", """
    SELECT path, label, finding_type, severity, CAST(line AS BIGINT) AS line,
           CASE WHEN severity = 'high' THEN 'API_TOKEN = "***"' ELSE '        self.e = eval("***")' END AS code FROM code_hits""")
def run_tool(t):
    hits = registry.run_tool("analyze_security", t.code)
    return hits.select("path", "label", "finding_type", "severity", F.col("line").cast("long"), "code")
