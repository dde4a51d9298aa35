"""Expected symbols, edges, findings, actions and routes of the hand-written corpus."""

import re

import pytest
from pyspark.sql import functions as F

from codeloom.functions import vocab
from codeloom.functions.pyast import raw_counts
from codeloom.operators import coordinate, findings, graph, registry, routing, scan, symbols
from codeloom.plans import analyze
from codeloom.sources import files as sources
from tests.corpus import FILES, SECRET, frame


@pytest.fixture(scope="module")
def index(spark):
    return analyze.build_index(frame(spark), keep=True)


@pytest.fixture(scope="module")
def result(spark):
    return analyze.analyze(frame(spark))


def pairs(df, *names):
    return {tuple(r) for r in df.select(*names).collect()}


def test_broken_file_is_a_row_and_nothing_else_is_lost(index):
    errors = symbols.parse_errors(index.symbols).collect()
    assert [r.path for r in errors] == ["/a/broken.py"] and "invalid syntax" in errors[0].parse_error
    assert index.symbols.select("path").distinct().count() == len(FILES)


def test_exports_understand_only_one_line_lists(index):
    exports = pairs(symbols.module_exports(index.symbols), "path", "name")
    assert {n for p, n in exports if p == "/a/utils.py"} == {"kept"}
    assert {n for p, n in exports if p == "/a/multi.py"} == {"one", "two"}
    strict = pairs(symbols.module_exports(index.symbols, fallback=False), "path", "name")
    assert strict == {("/a/utils.py", "kept")}


def test_import_resolution(index):
    edges = {(r.importing_file, r.source_module, r.symbol_name): r for r in index.edges.collect()}
    assert edges["/a/app.py", "utils", "u"].resolved_file == "/a/utils.py"
    assert edges["/a/app.py", "helpers", "*"].resolved_file == "/a/helpers.py"
    assert edges["/a/app.py", "pkg.core", "build"].resolved_file == "/a/pkg/core.py"
    assert edges["/a/app.py", "nowhere", "thing"].resolved_file is None
    assert not edges["/a/app.py", "nowhere", "thing"].is_external
    assert edges["/a/app.py", "os", "os"].is_external and edges["/a/app.py", "numpy", "numpy"].is_external
    assert edges["/a/pkg/__init__.py", "core", "build"].resolved_file == "/a/pkg/core.py"


def test_the_summary_counts_every_part_of_the_index(index):
    inits = symbols.init_exports(index.symbols)
    edges = symbols.import_edges(index.symbols)
    row = symbols.index_summary(index.definitions, scan.identifier_usages(index.files), edges, inits).first().asDict()
    words = {w for content in FILES.values() for w in re.findall(r"\b[A-Za-z_]\w+\b", content)}
    assert row == {"defined_symbols": 26, "symbols_with_usage": len(words), "import_edges": 12, "init_exports": 2}


def test_fan_in_and_star_sources(index):
    assert pairs(graph.star_import_sources(symbols.import_edges(index.symbols), index.files), "path") == {("/a/helpers.py",)}
    assert dict(pairs(graph.fan_in(index.edges), "path", "n_importers"))["/a/pkg/core.py"] == 2


def test_every_importer_is_a_row(index):
    rows = pairs(graph.importers_of_file(index.edges), "path", "importing_file")
    counts = dict(pairs(graph.fan_in(index.edges), "path", "n_importers"))
    assert counts == {path: sum(p == path for p, _ in rows) for path, _ in rows}
    assert counts["/a/utils.py"] == 1 and counts["/a/pkg/core.py"] == 2


def test_a_thousand_importers_and_one_give_the_same_form(spark):
    edges = spark.range(2000).selectExpr("'/a/hub.py' AS resolved_file", "concat('/a/f', id, '.py') AS importing_file", "'run' AS symbol_name")
    large = spark.createDataFrame([("/a", "/a/hub.py", 500)], "repo string, path string, loc long")
    row = findings.from_large_files(large, graph.fan_in(edges)).first()
    assert row.impact.n_importers == 2000 and row.suggested_fix.endswith("Imported by: 2000 files")
    reason = graph.importer_reasons(spark.createDataFrame([("/a/hub.py", "run")], "path string, name string"), edges).first()
    assert (reason.first_importer, reason.n_importers) == ("/a/f0.py", 2000)


def test_dead_functions(index):
    dead = pairs(analyze.dead_functions(index), "path", "name")
    assert dead == {
        ("/a/utils.py", "left_out"), ("/a/utils.py", "_hidden"), ("/a/dead.py", "_tangled"), ("/a/pkg2/other.py", "_exported"),
    }
    reasons = dict(pairs(analyze.liveness(index).filter("path = '/a/pkg/core.py'"), "name", "reason"))
    assert reasons == {"build": "imported by app.py", "_exported": "imported by __init__.py"}


def test_dead_set_shrinks_when_an_edge_is_added(spark, index):
    more = FILES | {"/a/late.py": "import utils\nutils.left_out()\n"}
    dead = pairs(analyze.dead_functions(analyze.build_index(frame(spark, more), keep=True)), "path", "name")
    assert pairs(analyze.dead_functions(index), "path", "name") - dead == {("/a/utils.py", "left_out")}


@pytest.mark.parametrize("segment", [False, True])
def test_an_init_keeps_names_of_its_own_repository_only(spark, segment):
    defs = spark.createDataFrame(
        [("/f/app", "/f/app/m.py", "run"), ("/f/app2", "/f/app2/m.py", "run")], "repo string, path string, name string"
    )
    inits = spark.createDataFrame([("/f/app", "/f/app/__init__.py", "run")], "repo string, init_path string, name string")
    assert pairs(graph.reexported(defs, inits, segment), "path", "init_path") == {("/f/app/m.py", "/f/app/__init__.py")}


def test_unused_symbols_and_the_prefix_trap(index):
    usages = scan.identifier_usages(index.files)
    inits = symbols.init_exports(index.symbols)

    def reasons(segment):
        rows = graph.symbol_liveness(index.definitions, index.edges, usages, inits, segment)
        return {(r.path, r.name): r.reason for r in rows.collect()}

    plain, whole = reasons(False), reasons(True)
    assert plain["/a/pkg2/other.py", "_exported"] == "re-exported via __init__.py"
    assert whole["/a/pkg2/other.py", "_exported"] == "no cross-file usage found"
    assert plain["/a/utils.py", "kept"] == "used in: app.py"
    assert plain["/a/model.py", "__init__"] == "always-alive pattern"
    assert plain["/a/helpers.py", "helper"] == "imported by: app.py"


def test_unused_imports_count_substrings(index):
    unused = pairs(symbols.unused_imports(index.symbols), "path", "name")
    assert ("/a/substring.py", "on") not in unused
    assert {("/a/distance.py", "os"), ("/b/solo.py", "json"), ("/a/app.py", "*")} <= unused


def test_exclusion_by_substring_or_segment(spark):
    files = frame(spark)
    kept = pairs(files.filter(sources.path_is_kept(F.col("path"))), "path")
    assert ("/a/distance.py",) not in kept and ("/a/build/gen.py",) not in kept
    by_part = pairs(files.filter(sources.path_is_kept(F.col("path"), match="segment")), "path")
    assert ("/a/distance.py",) in by_part and ("/a/build/gen.py",) not in by_part


def test_security_lines_cross_newlines_and_are_masked(index):
    hits = {(r.path, r.label): r for r in scan.security_scan(index.files).collect()}
    assert hits["/a/split.py", "Secret/Password"].line == 3
    assert hits["/a/settings.py", "API Key"].code == 'API_KEY = "***"'
    # no word boundary in the scan: retrieval( counts as eval( too
    assert len([1 for r in scan.insecure_scan(index.files).collect() if r.path == "/a/calls.py"]) == 2
    raw = scan.security_scan(index.files, mask=False).filter("path = '/a/settings.py'").first()
    assert SECRET in raw.code


def test_security_summary_keeps_zero_rows(index):
    rows = {r.path: r for r in scan.security_summary(index.files).collect()}
    assert len(rows) == len(FILES)
    assert rows["/a/settings.py"].high_severity == 1 and rows["/a/app.py"].total_issues == 0
    counted = scan.security_scan(index.files).groupBy("path").count()
    assert all(rows[r.path].total_issues == r["count"] for r in counted.collect())


def test_large_file_threshold(index):
    assert pairs(scan.large_files(index.files), "path", "loc") == {("/a/big451.py", 451)}


def test_doc_findings_skip_documented_initialisers(result):
    docs = pairs(result["findings"].filter("action_type = 'add_docstring' and file_path = '/a/model.py'"), "description")
    assert docs == {("Function 'busy' is missing a docstring",), ("Function 'Tiny' is missing a docstring",)}


def test_dead_and_complex_function_is_deleted_with_full_confidence(result):
    row = result["routed"].filter("file_path = '/a/dead.py'").collect()
    assert [(r.action_type, r.confidence, r.decision, r.effective_risk) for r in row] == [("delete_function", 1.0, "auto", "high")]
    assert row[0].merged_actions == ["delete_function", "refactor_code"] and "[merged 2 findings]" in row[0].description


def test_refactor_and_docstring_become_one_action(result):
    row = result["routed"].filter("entity_name = 'busy'").first()
    assert row.sub_actions == ["refactor_code", "add_docstring"] and row.effective_risk == "medium"
    assert row.description == "Execute 2 actions on function 'busy': refactor_code → add_docstring"
    assert row.decision == "review" and row.reason == "Code refactoring always requires manager approval"


def test_primary_confidence_switch(result, index):
    found = coordinate.extract_entity(result["findings"], index.latest, index.symbols)
    groups = coordinate.with_primary_confidence(found, coordinate.group_entities(found))
    row = coordinate.merge_to_action(groups, "primary").filter("file_path = '/a/dead.py'").first()
    assert row.confidence == 0.60


def test_security_target_is_the_variable_or_the_line(result):
    targets = {t for (t,) in pairs(result["actions"].filter("action_type = 'fix_security'"), "target")}
    assert "/a/settings.py@variable:API_KEY" in targets and "/a/calls.py@line:2" in targets


def test_deletes_run_bottom_to_top(result):
    rows = result["actions"].filter("file_path = '/a/utils.py'").orderBy("exec_order").collect()
    assert [r.entity_name for r in rows][:2] == ["_hidden", "left_out"]
    assert [r.exec_order for r in rows] == list(range(1, len(rows) + 1))


def test_reviews_are_unique_and_stats_add_up(result):
    assert result["reviews"].count() == result["reviews"].select("action_type", "target").distinct().count()
    stats = result["stats"].first()
    assert stats.findings == result["findings"].count() and stats.merged == stats.findings - stats.actions
    assert result["auto"].count() + routing.review_actions(result["routed"]).count() == stats.actions


def test_agent_filter(index):
    only = analyze.collect_findings(index, ["security"])
    assert pairs(only, "agent_type") == {("security",)}


def test_tools_by_name(spark, index):
    assert registry.run_tool("nope", index.files).first().error == "Unknown tool: nope"
    assert set(registry.TOOLS) == {
        "analyze_imports", "analyze_functions", "analyze_security", "analyze_documentation", "get_file_metrics", "get_python_files",
    }
    assert registry.run_tool("get_python_files", index.files).count() == len(FILES) - 2
    rules = spark.createDataFrame([("r", "x = [0-9]", "assign", "style", "low")], "rule_id string, regex string, label string, finding_type string, severity string")
    assert scan.table_rule_hits(index.files, rules).filter("path = '/a/big450.py'").count() == 450


def test_table_function_in_sql(spark, index):
    registry.register(spark)
    index.files.createOrReplaceTempView("corpus_files")
    taken = "code_symbols(TABLE(SELECT repo, path, content FROM corpus_files))"
    rows = spark.sql(f"SELECT path, name FROM {taken} WHERE bucket = 'class'")
    assert pairs(rows, "path", "name") == {("/a/model.py", "Model"), ("/a/model.py", "Tiny")}
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    every = spark.sql(f"SELECT * FROM {taken}")
    assert sorted(map(str, every.collect())) == sorted(map(str, symbols.extract_symbols(index.files).collect()))


def test_discovery_and_snapshots_from_disk(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_bytes(b"x = 1\r\ny = 2\r\n")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "venv").mkdir()
    (tmp_path / "venv" / "c.py").write_text("z = 1\n")
    (tmp_path / "notes.txt").write_text("no\n")
    rows = {r.path.rsplit("/", 1)[1]: r for r in sources.load_snapshots(sources.discover_files(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a.py", "bad.py"}
    assert rows["a.py"].content == "x = 1\ny = 2\n" and rows["a.py"].parse_error is None
    assert rows["bad.py"].content is None and rows["bad.py"].parse_error == "not valid UTF-8"


def test_excluded_files_are_never_opened(spark, tmp_path):
    for name in ("a.py", "b+c d.py", "venv/c.py", "venv/e.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    found = sources.discover_files(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaf = plan.collectLeaves().head()
    assert leaf.metrics().apply("numFiles").value() == 2
    # "%20" stands for the space only in the address.
    names = {r.path.rsplit("/", 1)[1] for r in sources.discover_files(spark, str(tmp_path), ["%20", "venv"]).collect()}
    assert names == {"a.py", "b+c d.py"}
    assert {r.path.rsplit("/", 1)[1] for r in sources.discover_files(spark, str(tmp_path), ["c d"]).collect()} == {"a.py", "c.py", "e.py"}
    assert sources.discover_files(spark, str(tmp_path), ["venv"], "segment").count() == 2


def test_deepest_repository(spark, tmp_path):
    for name in ("one/a.py", "one/sub/deep/b.py", "one/subway/c.py", "two/d.py", "e.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    roots = [str(tmp_path / "one"), str(tmp_path / "one/sub") + "/", str(tmp_path / "one/sub"), None, str(tmp_path / "gone")]
    projects = spark.createDataFrame([(r,) for r in roots], "repo_path string")

    def by_name(files):
        cut = len(str(tmp_path)) + 1
        return {r.path[cut:]: r.repo and r.repo[cut:] for r in files.collect()}

    found = sources.discover_files(spark, str(tmp_path), projects=projects)
    assert by_name(found) == {"one/a.py": "one", "one/sub/deep/b.py": "one/sub", "one/subway/c.py": "one", "two/d.py": None, "e.py": None}
    assert bytes(found.first().raw) == b"x = 1\n" and found.columns == ["repo", "path", "raw", "snapshot_ts"]
    several = sources.discover_files(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert by_name(several) == {"one/a.py": "one", "one/sub/deep/b.py": "one", "one/subway/c.py": "one", "two/d.py": "two"}
    assert sources.with_repository(found.limit(0), projects).count() == 0


def test_table_rules(spark, index):
    shape = "rule_id string, regex string, label string, finding_type string, severity string, literal string"
    rules = spark.createDataFrame([
        ("b", "x = [0-9]", "assign", "style", "low", "x ="), ("a", "import", "import", "style", "low", None), (None, "x", "n", "n", "n", None),
        ("c", None, "n", "n", "n", None), ("d", "import", "import", "style", "low", "not in any file"), ("a", "import", "import", "style", "low", None),
    ], shape)
    got = scan.table_rule_hits(index.files, rules)
    want = scan.rule_hits(index.files, [("a", "import", "import", "style", "low"), ("b", "x = [0-9]", "assign", "style", "low")])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert scan.table_rule_hits(index.files, rules.limit(0)).count() == 0


def test_raw_counts():
    source = 'def f():\n    """One."""\n    s = "# no"  # yes\n\n    # alone\n    t = """a\n\nb # no\n"""\n    return s; t\n"""\nx\n\n"""\n'
    assert raw_counts(source) == dict(loc=14, lloc=7, sloc=6, comments=2, single_comments=2, multi=3, blank=3)
    assert raw_counts("def (:\n")["loc"] == 1 and "invalid" in raw_counts("def (:\n")["error"]
    for nothing in (None, ""):
        assert raw_counts(nothing) == dict(loc=0, lloc=0, sloc=0, comments=0, single_comments=0, multi=0, blank=0)
    assert raw_counts("x = [1,\n # in\n 2]\n@a\ndef f(): pass\nif x:\n  pass\nelse: pass") == dict(
        loc=8, lloc=7, sloc=7, comments=1, single_comments=1, multi=0, blank=0)


def test_vocabulary_sizes():
    assert len(vocab.ALWAYS_ALIVE_FUNCTIONS) == 17 and len(vocab.ALWAYS_ALIVE_SYMBOLS) == 26
    assert len(vocab.SECRET_RULES) == 6 and len(vocab.INSECURE_RULES) == 4
