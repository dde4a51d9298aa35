"""Queries over the derived modules: symbols, imports, liveness, findings, routed actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import rules, text
from codeloom.operators import coordinate, edits, findings, graph, registry, routing, scan, symbols
from codeloom.plans import analyze
from codeloom.session import materialise, write_table
from codeloom.sources import files as sources
from suite.registry import query


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


def _symbols(t):
    return symbols.extract_symbols(t.code)


def _stored(files):
    """Symbols by bucket, stored once for plans that read them from several branches: each would parse anew."""
    return write_table(symbols.extract_symbols(files), "bucket")


# ------------------------------------------------------------------ symbols
@query("code", """
    SELECT path, bucket, name, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line FROM (
        SELECT path, valid, 'function' AS bucket, 'load_' || k AS name, load_line AS a, load_line + 1 + (k % 2 = 0)::INT AS b FROM code
        UNION ALL SELECT path, valid, 'function', '_spare_' || k, spare_line, spare_end FROM code
        UNION ALL SELECT path, valid, 'function', '__init__', init_line, init_end FROM code
        UNION ALL SELECT path, valid, 'class', 'Box' || k, class_line, init_end FROM code
        UNION ALL SELECT path, valid, 'assignment', 'LIMIT_' || k, limit_line, limit_line FROM code
        UNION ALL SELECT path, valid, 'assignment', 'API_TOKEN', limit_line - 1, limit_line - 1 FROM code WHERE k % 5 = 0
        UNION ALL SELECT path, valid, 'statement', 'expr_block_L1', 1, 1 FROM code WHERE doc = 1) WHERE valid
    UNION ALL SELECT path, 'error', NULL, NULL, NULL FROM code WHERE NOT valid""")
def extract_symbols(t):
    rows = _symbols(t).filter(F.col("bucket").isin("function", "class", "assignment", "statement", "error"))
    return rows.select("path", "bucket", "name", *_long("start_line", "end_line"))


@query("code", """
    SELECT repo, path, 3::BIGINT AS functions, 1::BIGINT AS classes,
           (2 + chain::INT + star::INT + gone::INT)::BIGINT AS imports,
           (1 + (k % 5 = 0)::INT)::BIGINT AS assignments, doc::BIGINT AS statements FROM code WHERE valid""")
def symbol_summary(t):
    counts = symbols.symbol_summary(symbols.latest_symbols(_symbols(t)))
    return counts.join(t.code.select("repo", "path"), "path")


@query("code code_loc", """
    SELECT c.path, l.loc::BIGINT AS lines, CASE WHEN c.valid THEN NULL ELSE 'broken' END AS parse_error,
           CASE WHEN c.valid THEN 3 END::BIGINT AS functions FROM code c JOIN code_loc l ON l.path = c.path""")
def file_state(t):
    table = _stored(t.code)
    errors = symbols.parse_errors(table).select("path", F.lit("broken").alias("parse_error"))
    files = t.code.join(errors, "path", "left").withColumn("checksum", F.sha2("content", 256))
    state = sources.file_state(files, symbols.symbol_summary(symbols.latest_symbols(table)))
    return state.select("path", "lines", "parse_error", "functions")


@query("code", """
    SELECT path, name, kind, is_public FROM (
        SELECT path, valid, 'load_' || k AS name, 'function' AS kind, true AS is_public FROM code
        UNION ALL SELECT path, valid, '_spare_' || k, 'function', false FROM code
        UNION ALL SELECT path, valid, '__init__', 'function', false FROM code
        UNION ALL SELECT path, valid, 'Box' || k, 'class', true FROM code
        UNION ALL SELECT path, valid, 'LIMIT_' || k, 'assignment', true FROM code
        UNION ALL SELECT path, valid, 'API_TOKEN', 'assignment', true FROM code WHERE k % 5 = 0) WHERE valid""")
def definitions(t):
    return symbols.definitions(_stored(t.code)).select("path", "name", "kind", "is_public")


@query("edges", "SELECT importing_file, source_module, symbol_name, is_external FROM edges")
def import_edges(t):
    return symbols.import_edges(_symbols(t)).select("importing_file", "source_module", "symbol_name", "is_external")


@query("code", """
    SELECT path, name FROM (SELECT path, valid, unnest(['load_' || k, 'Box' || k, 'LIMIT_' || k]) AS name FROM code
        UNION ALL SELECT path, valid, 'API_TOKEN' FROM code WHERE k % 5 = 0) WHERE valid""")
def module_exports(t):
    return symbols.module_exports(_stored(t.code))


@query("doc_issues", "SELECT path, issue, name, CAST(line AS BIGINT) AS line, message FROM doc_issues")
def docstring_issues(t):
    return symbols.docstring_issues(_symbols(t)).select("path", "issue", "name", *_long("line"), "message")


@query("code", """
    SELECT path, '_spare_' || k AS name, 7::BIGINT AS complexity, 'B' AS grade, 'function' AS kind,
           spare_line::BIGINT AS line FROM code WHERE valid AND s > 25""")
def function_complexity(t):
    return symbols.function_complexity(_symbols(t)).select("path", "name", *_long("complexity"), "grade", "kind", *_long("line"))


@query("code", """
    SELECT path, name, is_private, is_special, call_sites FROM (
        SELECT path, valid, 'load_' || k AS name, false AS is_private, false AS is_special, 2::BIGINT AS call_sites FROM code
        UNION ALL SELECT path, valid, '_spare_' || k, true, false, 1 FROM code
        UNION ALL SELECT path, valid, '__init__', false, true, 1 FROM code) WHERE valid""")
def function_rows(t):
    return symbols.function_rows(_symbols(t)).select("path", "name", "is_private", "is_special", "call_sites")


@query("code", """
    SELECT path, CASE WHEN k % 2 = 1 THEN 'load_' || k ELSE '__init__' END AS name FROM code WHERE valid AND k % 2 = 1
    UNION ALL SELECT path, '__init__' FROM code WHERE valid""")
def functions_without_docstring(t):
    return symbols.functions_without_docstring(_symbols(t)).select("path", "name")


@query("unused", "SELECT path, name, module, CAST(line AS BIGINT) AS line, type FROM unused")
def unused_imports(t):
    return symbols.unused_imports(_symbols(t)).select("path", "name", "module", *_long("line"), "type")


@query("code", """
    SELECT path, 'load_' || k AS name, 'function' AS bucket, load_line::BIGINT AS start_line FROM code WHERE valid
    UNION ALL SELECT path, 'LIMIT_' || k, 'assignment', limit_line FROM code WHERE valid
    UNION ALL SELECT path, 'os', 'import', doc + 1 FROM code WHERE valid""")
def symbol_lookup(t):
    k = F.regexp_extract("path", r"m([0-9]+)\.py", 1)
    none = F.lit(None).cast("string")
    asked = F.array(
        F.struct(F.concat(F.lit("load_"), k).alias("name"), none.alias("kind")),
        F.struct(F.concat(F.lit("LIMIT_"), k).alias("name"), F.lit("assignment").alias("kind")),
        F.struct(F.lit("os").alias("name"), F.lit("import_from").alias("kind")),
        F.struct(F.lit("absent").alias("name"), none.alias("kind")),
    )
    wanted = t.code.select("path", F.explode(asked).alias("a")).select("path", "a.*")
    return symbols.symbol_lookup(symbols.latest_symbols(_symbols(t)), wanted).select("path", "name", "bucket", *_long("start_line"))


@query("code", "SELECT path FROM code WHERE valid AND chain")
def has_import(t):
    k = F.regexp_extract("path", r"m([0-9]+)\.py", 1).cast("long")
    latest = symbols.latest_symbols(_symbols(t))
    # Bring the name to a common one so that a single lookup name covers the corpus.
    same = latest.withColumn("name", F.when(F.col("name") == F.concat(F.lit("load_"), (k - 10).cast("string")), "previous").otherwise(F.col("name")))
    return symbols.has_import(same, "previous")


@query("code", """
    SELECT path, '_spare_' || k AS name, (spare_line - 1)::BIGINT AS start_line, spare_end::BIGINT AS end_line FROM code WHERE valid
    UNION ALL SELECT path, 'load_' || k, load_line - 1, load_line + 1 + (k % 2 = 0)::INT FROM code WHERE valid
    UNION ALL SELECT path, '__init__', init_line, init_end FROM code WHERE valid""")
def delete_span(t):
    return symbols.delete_span(symbols.latest_symbols(_symbols(t))).select("path", "name", *_long("start_line", "end_line"))


@query("code edges", r"""
    WITH words AS (
        SELECT unnest(['import', 'os', 'json', 'as', 'j' || k, 'LIMIT_' || k, 'def', 'load_' || k, 'return', 'path', 'join',
                       '_spare_' || k, 'class', 'Box' || k, '__init__', 'self']) AS name FROM code WHERE valid
        UNION ALL SELECT unnest(list_concat(['Module'], regexp_extract_all(n, '[\p{L}\p{N}_]+'))) FROM code WHERE valid AND doc = 1
        UNION ALL SELECT unnest(list_concat(['Load', 'one', 'item'], regexp_extract_all(n, '[\p{L}\p{N}_]+'))) FROM code WHERE valid AND k % 2 = 0
        UNION ALL SELECT unnest(['from', 'm' || (k - 10), 'load_' || (k - 10)]) FROM code WHERE valid AND chain
        UNION ALL SELECT unnest(['from', 'm' || (k - 20)]) FROM code WHERE valid AND star
        UNION ALL SELECT unnest(['from', 'missing_' || k, 'thing']) FROM code WHERE valid AND gone
        UNION ALL SELECT unnest(['API_TOKEN', 'tok' || k || 'abcdefghij']) FROM code WHERE valid AND k % 5 = 0
        UNION ALL SELECT 'if' FROM code WHERE valid AND s > 25
        UNION ALL SELECT unnest(['box', 'that', 'holds', 'parts']) FROM code WHERE valid AND k % 2 = 0
        UNION ALL SELECT 'Box' FROM code WHERE valid AND k % 2 = 1
        UNION ALL SELECT 'dumps' FROM code WHERE valid AND k % 4 = 0
        UNION ALL SELECT 'eval' FROM code WHERE valid AND k % 13 = 0
        UNION ALL SELECT unnest(['m' || (k - 10), '_spare_' || (k - 10)]) FROM code WHERE valid AND calls
        UNION ALL SELECT 'pad' FROM code WHERE valid AND k % 50 = 0
        UNION ALL SELECT unnest(['def', 'broken_' || k]) FROM code WHERE NOT valid)
    SELECT (count(*) * 4 + 2)::BIGINT AS defined_symbols,
           (SELECT count(DISTINCT name) FROM words WHERE length(name) >= 2 AND regexp_matches(name, '^[A-Za-z_]'))::BIGINT AS symbols_with_usage,
           (SELECT count(*) FROM edges)::BIGINT AS import_edges, 0::BIGINT AS init_exports
    FROM code WHERE valid""".replace("count(*) * 4 + 2", "count(*) * 4 + 1 + (count(*) FILTER (k % 5 = 0) > 0)::INT"))
def index_summary(t):
    table = _stored(t.code)
    return symbols.index_summary(
        symbols.definitions(table), scan.identifier_usages(t.code), symbols.import_edges(table), symbols.init_exports(table)
    )


@query("code", """
    SELECT repo, path, 'Box' || k AS name, 'class' AS bucket, CAST(class_line AS INT) AS start_line, CAST(init_end AS INT) AS end_line,
           true AS has_docstring, CAST(CASE WHEN k % 2 = 1 THEN 4 ELSE 23 END AS INT) AS doc_len, 'class Box' || k || ':' AS line_text,
           true AS blank_before FROM code WHERE valid""")
def sql_table_function(t):
    registry.register(t.spark)
    t.code.createOrReplaceTempView("codeloom_code")
    return t.spark.sql("""
        SELECT repo, path, name, bucket, start_line, end_line, has_docstring, doc_len, line_text, blank_before
        FROM code_symbols(TABLE(SELECT repo, path, content FROM codeloom_code)) WHERE bucket = 'class'""")


# ------------------------------------------------------------------ packages
@query("packages", """
    SELECT core AS path, 'load_' || k AS name, 'function' AS kind, true AS is_public, k % 5 = 0 AS in_all FROM packages
    UNION ALL SELECT core, '_hidden_' || k, 'function', false, false FROM packages
    UNION ALL SELECT core, 'shared', 'function', true, false FROM packages
    UNION ALL SELECT core, 'Box' || k, 'class', true, false FROM packages
    UNION ALL SELECT core, '__all__', 'assignment', false, false FROM packages WHERE k % 5 = 0
    UNION ALL SELECT init, '__all__', 'assignment', false, false FROM packages WHERE k % 3 < 2""")
def package_definitions(t):
    return symbols.definitions(_stored(t.packages)).select("path", "name", "kind", "is_public", "in_all")


@query("packages", """
    SELECT init AS path, 'load_' || k AS name FROM packages WHERE k % 3 < 2 UNION ALL SELECT init, 'Box' || k FROM packages WHERE k % 3 = 0
    UNION ALL SELECT core, 'load_' || k FROM packages WHERE k % 5 = 0""")
def listed_names(t):
    return symbols.all_names(symbols.extract_symbols(t.packages))


# A list over several lines isn't understood, so such a file offers its public names.
@query("packages", """
    SELECT init AS path, 'load_' || k AS name FROM packages WHERE k % 3 = 0 UNION ALL SELECT init, 'Box' || k FROM packages WHERE k % 3 = 0
    UNION ALL SELECT core, 'load_' || k FROM packages
    UNION ALL SELECT core, 'shared' FROM packages WHERE k % 5 <> 0 UNION ALL SELECT core, 'Box' || k FROM packages WHERE k % 5 <> 0""")
def package_offers(t):
    return symbols.module_exports(_stored(t.packages))


@query("packages", """
    SELECT repo, init AS init_path, 'load_' || k AS name FROM packages UNION ALL SELECT repo, init, 'shared' FROM packages
    UNION ALL SELECT repo, init, 'shown_' || k FROM packages WHERE k % 2 = 0""")
def init_exports(t):
    return symbols.init_exports(symbols.extract_symbols(t.packages))


# Folders are prefixes as plain text: pk1 is one of pk11.
@query("packages", """
    SELECT core AS path, 'load_' || k AS name, init AS init_path FROM packages
    UNION ALL SELECT a.core, 'shared', b.init FROM packages a JOIN packages b ON a.repo = b.repo AND starts_with(a.core, b.folder)""")
def reexported(t):
    table = _stored(t.packages)
    return graph.reexported(symbols.definitions(table), symbols.init_exports(table))


# ------------------------------------------------------------------ graph
def _index(t):
    """Symbols and edges, stored once because the queries below read them many times."""
    return analyze.build_index(t.code, keep=True)


@query("edges", "SELECT importing_file, source_module, symbol_name, resolved_file FROM edges")
def resolve_import_edges(t):
    return _index(t).edges.select("importing_file", "source_module", "symbol_name", "resolved_file")


@query("files", r"""
    WITH want AS (SELECT path, unnest(['en', 'de', 'fr']) AS lang, unnest([0, 1, 2]) AS pos, repo,
                         regexp_extract(path, '[^/]+$') AS leaf FROM files)
    SELECT path, arg_min(found, pos) AS resolved_file FROM (
        SELECT w.path, w.pos, f.path AS found FROM want w JOIN files f ON f.path = w.repo || '/' || w.lang || '/' || w.leaf)
    GROUP BY path""")
def first_candidate(t):
    leaf = text.file_name(F.col("path"))
    tries = F.array(*[F.concat(F.col("repo"), F.lit(f"/{lang}/"), F.col("leaf")) for lang in ("en", "de", "fr")])
    requests = t.files.select("repo", F.col("path").alias("asked"), leaf.alias("leaf"))
    found = graph._first_existing(requests, t.files, tries, ["asked"])
    return found.select(F.col("asked").alias("path"), "resolved_file")


@query("edges", """
    SELECT resolved_file AS path, importing_file FROM edges WHERE resolved_file IS NOT NULL GROUP BY ALL""".replace(
    "GROUP BY ALL", "GROUP BY resolved_file, importing_file"))
def importers_of_file(t):
    return graph.importers_of_file(_index(t).edges)


@query("edges", """
    SELECT resolved_file AS path, count(DISTINCT importing_file) AS n_importers
    FROM edges WHERE resolved_file IS NOT NULL GROUP BY resolved_file""")
def fan_in(t):
    return graph.fan_in(_index(t).edges)


@query("code edges", """
    SELECT e.resolved_file AS path, e.symbol_name AS name, e.importing_file FROM edges e
    JOIN code c ON c.path = e.resolved_file WHERE c.valid""")
def importers_of_symbol(t):
    index = _index(t)
    return graph.importers_of_symbol(index.definitions, index.edges)


@query("edges", "SELECT DISTINCT resolved_file AS path FROM edges WHERE symbol_name = '*' AND resolved_file IS NOT NULL")
def star_import_sources(t):
    return graph.star_import_sources(symbols.import_edges(_stored(t.code)), t.code)


@query("spare", "SELECT path, name, CAST(line AS BIGINT) AS line FROM spare WHERE alive IS NULL")
def dead_functions(t):
    return analyze.dead_functions(_index(t)).select("path", "name", *_long("line"))


@query("spare", """
    SELECT path, name, alive IS NULL AS is_dead, coalesce(alive, 'no cross-file usage found') AS reason FROM spare""")
def function_liveness(t):
    return analyze.liveness(_index(t)).select("path", "name", "is_dead", "reason")


@query("code", r"""
    WITH d AS (SELECT c.path, c.k, unnest(['load_' || c.k, '_spare_' || c.k, '__init__', 'Box' || c.k, 'LIMIT_' || c.k, 'API_TOKEN']) AS name,
                      a.valid AS a_valid, a.k AS ak, a.calls AS a_calls, b.valid AND b.star AS b_star, b.k AS bk
               FROM code c LEFT JOIN code a ON a.k = c.k + 10 LEFT JOIN code b ON b.k = c.k + 20 WHERE c.valid)
    SELECT path, name, reason = 'no cross-file usage found' AS is_unused, reason, n_importers FROM (
        SELECT path, name,
            nullif(CASE WHEN name = '__init__' THEN 0 ELSE CAST(coalesce(a_valid AND name = 'load_' || k, false) AS BIGINT)
                + CAST(coalesce(b_star, false) AS BIGINT) END, 0) AS n_importers, CASE
            WHEN name = '__init__' THEN 'always-alive pattern'
            WHEN name = 'load_' || k AND a_valid AND b_star THEN
                 'imported by: ' || CASE WHEN ak || '.py' < bk || '.py' THEN 'm' || ak ELSE 'm' || bk END || '.py'
            WHEN name = 'load_' || k AND a_valid THEN 'imported by: m' || ak || '.py'
            WHEN b_star THEN 'imported by: m' || bk || '.py'
            WHEN name = '_spare_' || k AND a_valid AND a_calls THEN 'used in: m' || ak || '.py'
            WHEN name = 'API_TOKEN' AND a_valid AND ak % 5 = 0 THEN 'used in: m' || ak || '.py'
            ELSE 'no cross-file usage found' END AS reason
        FROM d WHERE name <> 'API_TOKEN' OR k % 5 = 0)""")
def symbol_liveness(t):
    index = _index(t)
    return graph.symbol_liveness(
        index.definitions, index.edges, scan.identifier_usages(index.files), symbols.init_exports(index.symbols)
    ).drop("first_importer")


@query("code", """
    SELECT path, 'Box' || k AS parent_class, init_line::BIGINT AS line, true AS parent_has_docstring FROM code WHERE valid
    UNION ALL SELECT path, NULL, load_line, false FROM code WHERE valid""")
def parent_class(t):
    table = _stored(t.code)
    points = table.filter((F.col("bucket") == "function") & ~rules.is_private(F.col("name"))).select(
        "path", F.col("start_line").alias("line")
    )
    found = graph.parent_class(points, symbols.latest_symbols(table))
    return found.select("path", "parent_class", *_long("line"), "parent_has_docstring")


@query("code", """
    SELECT path, 1::BIGINT AS line, CASE WHEN doc = 1 THEN 'expr_block_L1' END AS statement FROM code
    WHERE valid UNION ALL SELECT path, 1, NULL FROM code WHERE NOT valid""")
def statement_at(t):
    found = graph.statement_at(t.code.select("path", F.lit(1).alias("line")), _symbols(t))
    return found.select("path", *_long("line"), "statement")


# ------------------------------------------------------------------ findings and actions
def _found(t):
    return analyze.collect_findings(_index(t))


@query("unused spare code_hits doc_issues code_loc", """
    SELECT path AS file_path, 'dead_code' AS agent_type, 'delete_import' AS action_type, 'Unused import: ' || name AS title,
           CAST(line AS BIGINT) AS line_number, 'low' AS severity, 0.85::DOUBLE AS confidence FROM unused
    UNION ALL SELECT path, 'dead_code', 'delete_function', 'Unused function (repo-wide): ' || name, line, 'medium', 0.60 FROM spare WHERE alive IS NULL
    UNION ALL SELECT path, 'dead_code', 'refactor_code', 'High complexity: ' || name, line, 'medium', 1.0 FROM spare WHERE s > 25
    UNION ALL SELECT path, 'security', 'fix_security', CASE WHEN severity = 'high' THEN 'Potential hardcoded ' || label ELSE label END,
           line, severity, CASE WHEN severity = 'high' THEN 0.95 ELSE 0.80 END FROM code_hits
    UNION ALL SELECT path, 'documentation', 'add_docstring', message, line, 'low', 0.90 FROM doc_issues WHERE name IS NOT NULL AND name <> '__init__'
    UNION ALL SELECT path, 'structure', 'restructure', 'Large file: ' || loc || ' LOC', 1, 'medium', 0.70 FROM code_loc WHERE loc > 450""")
def all_findings(t):
    return _found(t).select("file_path", "agent_type", "action_type", "title", *_long("line_number"), "severity", "confidence")


@query("unused", "SELECT path AS file_path, 'Remove: import ' || name AS suggested_fix FROM unused")
def findings_unused_imports(t):
    found = findings.from_unused_imports(symbols.unused_imports(_symbols(t)))
    return found.select("file_path", "suggested_fix")


@query("code_loc edges", """
    SELECT l.path AS file_path, 1 + coalesce(e.n, 0) AS files_affected, coalesce(e.n, 0) AS n_importers, l.loc::BIGINT AS loc,
        'Consider splitting into logical sub-modules. Imported by: ' || coalesce(e.n || ' files', 'none') AS suggested_fix FROM code_loc l
    LEFT JOIN (SELECT resolved_file, count(DISTINCT importing_file) AS n FROM edges GROUP BY 1) e ON e.resolved_file = l.path
    WHERE l.loc > 450""")
def findings_large_files(t):
    index = _index(t)
    found = findings.from_large_files(scan.large_files(index.files), graph.fan_in(index.edges))
    return found.select("file_path", "impact.files_affected", "impact.n_importers", "impact.loc", "suggested_fix")


def _actions(t):
    index = _index(t)
    found = materialise(analyze.collect_findings(index))
    return found, analyze.coordinate_actions(found, index), index


@query("code_actions", """
    SELECT path AS file_path, entity_type, entity_name, action_type, confidence::DOUBLE AS confidence, n::BIGINT AS n_findings,
           row_number() OVER (PARTITION BY path ORDER BY CASE WHEN action_type LIKE 'delete%' THEN 0 ELSE 1 END,
               CASE WHEN action_type LIKE 'delete%' THEN -line
                    ELSE CASE action_type WHEN 'fix_security' THEN 0 WHEN 'refactor_code' THEN 4 WHEN 'add_docstring' THEN 5 ELSE 6 END END,
               line) AS exec_order
    FROM code_actions""")
def coordinated_actions(t):
    return _actions(t)[1].select(
        "file_path", "entity_type", "entity_name", "action_type", "confidence", "n_findings", "exec_order"
    )


@query("code_actions decisions", """
    WITH rate AS (SELECT action_type, count(*) FILTER (NOT was_approved) / count(*) AS r FROM (
        SELECT *, row_number() OVER (PARTITION BY action_type, context_hash ORDER BY created_at DESC, id DESC) AS rn
        FROM decisions WHERE was_approved IS NOT NULL) WHERE rn <= 10 GROUP BY action_type)
    SELECT a.path || '@' || entity_type || ':' || entity_name AS target, a.action_type,
        CASE WHEN a.action_type = 'restructure' OR confidence < 0.7 OR (a.action_type IN ('delete_function', 'fix_security') AND confidence < 0.85)
                  OR a.action_type IN ('fix_security', 'refactor_code') OR rate.r > 0.5 THEN 'review' ELSE 'auto' END AS decision,
        CASE WHEN a.action_type = 'restructure' THEN 'Critical risk: restructure'
             WHEN confidence < 0.7 THEN 'Low confidence: ' || printf('%.2f', confidence::DOUBLE) || ' < 0.7'
             WHEN a.action_type IN ('delete_function', 'fix_security') AND confidence < 0.85
                  THEN 'HIGH risk requires ≥0.85 confidence — got ' || printf('%.2f', confidence::DOUBLE)
             WHEN a.action_type = 'fix_security' THEN 'Security fixes always require manager approval'
             WHEN a.action_type = 'refactor_code' THEN 'Code refactoring always requires manager approval'
             WHEN rate.r > 0.5 THEN 'Historical rejection rate ' || printf('%.0f', rate.r * 100) || '% > 50% — escalating'
             WHEN a.action_type = 'delete_function' THEN 'Auto-approved: high risk, confidence=' || printf('%.2f', confidence::DOUBLE)
             ELSE 'Auto-approved: low risk, confidence=' || printf('%.2f', confidence::DOUBLE) END AS reason
    FROM code_actions a LEFT JOIN rate ON rate.action_type = a.action_type""")
def analyze_routed(t):
    history = t.decisions.filter(F.col("was_approved").isNotNull())
    routed = routing.route(_actions(t)[1], routing.rejection_rate(history))
    return routed.select("target", "action_type", "decision", "reason")


@query("unused spare code_hits doc_issues code_loc code_actions", """
    SELECT ((SELECT count(*) FROM unused) + (SELECT count(*) FROM spare WHERE alive IS NULL) + (SELECT count(*) FROM spare WHERE s > 25)
            + (SELECT count(*) FROM code_hits) + (SELECT count(*) FROM doc_issues WHERE name IS NOT NULL AND name <> '__init__')
            + (SELECT count(*) FROM code_loc WHERE loc > 450))::BIGINT AS findings, (SELECT count(*) FROM code_actions)::BIGINT AS actions""")
def merge_stats(t):
    found, actions, _ = _actions(t)
    return coordinate.merge_stats(found, actions).select("findings", "actions")


@query("code spare", """
    SELECT c.path, (init_end + 449 * (c.k % 50 = 0)::INT
        - CASE WHEN sp.alive IS NULL THEN spare_end - spare_line + 2 ELSE 0 END)::BIGINT AS lines
    FROM code c JOIN spare sp ON sp.path = c.path""")
def edited_sources(t):
    """Dead functions cut out of the text of their files."""
    index = _index(t)
    doomed = analyze.dead_functions(index).select("path", "name")
    cuts = symbols.delete_span(index.latest).join(doomed, ["path", "name"]).select(
        "path", F.col("start_line").alias("start"), F.col("end_line").alias("end"),
        F.array().cast("array<string>").alias("new_lines"),
    )
    done = edits.apply_line_edits(index.files, cuts)
    broken = symbols.parse_errors(index.symbols).select("path")
    return done.join(broken, "path", "left_anti").select("path", text.line_count(F.col("content")).alias("lines"))


@query("code unused", """
    SELECT c.path, (init_end + 449 * (c.k % 50 = 0)::INT - coalesce(u.n, 0))::BIGINT AS lines
    FROM code c LEFT JOIN (SELECT path, count(*) AS n FROM unused GROUP BY path) u ON u.path = c.path WHERE c.valid""")
def removed_imports(t):
    """Unused names taken out of their import lines."""
    index = _index(t)
    cuts = edits.import_removals(symbols.unused_imports(index.symbols), index.latest)
    done = edits.apply_line_edits(index.files, cuts)
    broken = symbols.parse_errors(index.symbols).select("path")
    return done.join(broken, "path", "left_anti").select("path", text.line_count(F.col("content")).alias("lines"))


@query("code_actions code", """
    SELECT a.path || '@' || entity_type || ':' || entity_name AS target, CASE action_type
        WHEN 'delete_import' THEN 'Would delete entire line ' || a.line || ': ' || CASE
             WHEN entity_name LIKE 'j%' THEN 'import json as ' || entity_name
             WHEN entity_name LIKE 'load%' THEN 'from m' || (a.k - 10) || ' import ' || entity_name
             WHEN entity_name = '*' THEN 'from m' || (a.k - 20) || ' import *'
             ELSE 'from missing_' || a.k || ' import thing' END
        WHEN 'delete_function' THEN 'Would delete ''' || entity_name || ''' lines ' || (a.line - 1) || '–' || c.spare_end
        WHEN 'refactor_code' THEN 'Would refactor ''' || entity_name || ''' (complexity=7, lines ' || a.line || '–' || c.spare_end || ')'
        WHEN 'add_docstring' THEN CASE WHEN entity_name LIKE 'Box%' THEN '''' || entity_name || ''' already has a docstring'
             ELSE 'Would add AI docstring to function ''' || entity_name || ''' at line ' || a.line END
        WHEN 'fix_security' THEN CASE WHEN entity_type = 'variable'
             THEN 'Would extract ''API_TOKEN'' to .env.example and replace with os.getenv()'
             ELSE 'Would comment out security issue at line ' || a.line END
        ELSE 'Would analyse ' || a.path END AS message, CAST(NULL AS VARCHAR) AS error
    FROM code_actions a JOIN code c ON c.k = a.k""")
def plan_edits(t):
    _, actions, index = _actions(t)
    plan = edits.plan_edits(materialise(actions), index.latest, index.files)
    return plan.select(text.encode_target(F.col("path"), F.col("entity_type"), F.col("entity_name")).alias("target"), "message", "error")
