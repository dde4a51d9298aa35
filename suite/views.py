"""Driver tables seen as the library's tables, once in Spark and once as SQL.

``FILES`` reads documents as files.  ``CODE`` derives one Python module per part, so that
parsing, import and liveness queries grow with the data and have a closed form in SQL.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import rules, text
from codeloom.operators.skew import spread
from codeloom.session import checkpoint_folder, tune
from codeloom.sources.texts import TextTable, store_texts

QUEUE_TYPES = [
    "fix_security", "delete_import", "delete_function", "refactor_code", "add_docstring", "restructure", "move_file",
]
LONG_FILE_PADDING = 449
TEXT_BUCKETS = 160


class Tables:
    """Lazily loaded tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def files(self) -> DataFrame:
        return spread(self.table("documents"), "doc_id").select(
            F.col("source").alias("repo"),
            F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"),
            F.col("text").alias("content"),
        )

    @cached_property
    def stored_files(self) -> TextTable:
        """``files`` in buckets by path, in a folder of its own; about 200 MB of text a bucket at 32 GB."""
        mark = uuid.uuid4().hex
        folder = f"{checkpoint_folder(self.spark).rstrip('/')}/codeloom-texts-{mark}"
        return store_texts(self.files, f"codeloom_texts_{mark}", TEXT_BUCKETS, folder)

    @cached_property
    def decisions(self) -> DataFrame:
        return self.decisions_of(self.table("orders"))

    @staticmethod
    def decisions_of(orders: DataFrame) -> DataFrame:
        position = F.substring("o_orderpriority", 1, 1).cast("int")
        action = F.get(F.array(*[F.lit(a) for a in QUEUE_TYPES]), position - 1)
        return orders.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("reviewer"),
            action.alias("action_type"),
            text.context_hash(action, rules.risk_of(action)).alias("context_hash"),
            F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("was_approved"),
            F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("confidence"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def queue(self) -> DataFrame:
        return self.queue_of(spread(self.table("lineitem"), "l_orderkey", "l_linenumber", "l_partkey"))

    @staticmethod
    def queue_of(lineitem: DataFrame) -> DataFrame:
        key = F.col("l_orderkey").cast("string")
        action = F.get(F.array(*[F.lit(a) for a in QUEUE_TYPES]), F.col("l_linenumber") - 1)
        return lineitem.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            action.alias("action_type"),
            F.concat(key, F.lit("@part:"), F.col("l_partkey").cast("string")).alias("target"),
            rules.risk_of(action).alias("risk_level"),
            (1 - 5 * F.col("l_tax")).alias("confidence"),
            F.col("l_suppkey").alias("owner"),
            F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def file_events(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "view", "modified").when(F.col("event_type") == "click", "created")
        return self.table("events").select(
            F.col("event_id"), F.col("user_id").alias("project_id"),
            F.concat(F.lit("m"), (F.col("event_id") % 50).cast("string"), F.lit(".py")).alias("path"),
            F.coalesce(kind, F.lit("deleted")).alias("kind"), F.lit(False).alias("is_dir"), "ts",
        )

    @cached_property
    def code(self) -> DataFrame:
        k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")

        def line(template: str, condition=None):
            """A template with {k}, {a} = k-10, {b} = k-20, {n} = name, {s} = size."""
            values = {"k": k, "a": k - 10, "b": k - 20, "s": size, "n": name}
            parts, rest = [], template
            while "{" in rest:
                before, _, rest = rest.partition("{")
                key, _, rest = rest.partition("}")
                parts += [F.lit(before), values[key].cast("string")]
            filled = F.concat(*parts, F.lit(rest))
            return filled if condition is None else F.when(condition, filled)

        branches = "\n".join(f"    if a > {i}:\n        b = a" for i in range(6))
        lines = [
            line('"""Module {n}."""', k % 3 != 0),
            line("import os"),
            line("import json as j{k}"),
            line("from m{a} import load_{a}", k >= 10),
            line("from m{b} import *", (k >= 20) & (k % 7 == 0)),
            line("from missing_{k} import thing", k % 11 == 0),
            line(""),
            line('API_TOKEN = "tok{k}abcdefghij"', k % 5 == 0),
            line("LIMIT_{k} = {s}"),
            line(""),
            line("def load_{k}(x):"),
            line('    """Load one {n} item."""', k % 2 == 0),
            line('    return os.path.join(x, "{k}")'),
            line(""),
            line("def _spare_{k}(a, b):"),
            line(branches, size > 25),
            line("    return a"),
            line(""),
            line("class Box{k}:"),
            F.when(k % 2 == 1, '    """Box."""').otherwise('    """A box that holds parts."""'),
            line("    def __init__(self):"),
            line("        self.v = load_{k}(1)"),
            line("        self.w = j{k}.dumps(self.v)", k % 4 == 0),
            line('        self.e = eval("1")', k % 13 == 0),
            line("        self.s = m{a}._spare_{a}(1, 2)", (k >= 10) & (k % 9 == 0)),
            line("\n".join(["# pad"] * LONG_FILE_PADDING), k % 50 == 0),
        ]
        module = F.concat(F.concat_ws("\n", *lines), F.lit("\n"))
        content = F.when(k % 97 == 0, line("def broken_{k}(:\n")).otherwise(module)
        repo = F.concat(F.lit("r"), (k % 10).cast("string"))
        # Rows are spread while they are narrow, before text is made of them.
        parts = spread(self.table("part"), "p_partkey", always=True)
        return parts.select(
            repo.alias("repo"), F.concat(repo, F.lit("/m"), k.cast("string"), F.lit(".py")).alias("path"),
            content.alias("content"),
        )

    @cached_property
    def packages(self) -> DataFrame:
        """Two files per part: a package's init, which lists and passes on names, and a module below it."""
        k = F.col("p_partkey").cast("string")

        def named(template: str):
            return F.replace(F.lit(template), F.lit("{k}"), k)

        remainder = F.col("p_partkey") % 3
        init = F.concat(
            F.when(remainder == 0, named('__all__ = ["load_{k}", \'Box{k}\']\n'))
            .when(remainder == 1, named('__all__ = [\n    "load_{k}",\n]\n')).otherwise(""),
            named("from .sub.core import load_{k}, shared\n"),
            F.when(F.col("p_partkey") % 2 == 0, named("from .sub.core import _hidden_{k} as shown_{k}\n")).otherwise(""),
        )
        core = F.concat(
            F.when(F.col("p_partkey") % 5 == 0, named('__all__ = ["load_{k}"]\n\n\n')).otherwise(""),
            named("def load_{k}():\n    pass\n\n\ndef _hidden_{k}():\n    pass\n\n\ndef shared():\n    pass\n\n\nclass Box{k}:\n    pass\n"),
        )
        repo = F.concat(F.lit("r"), (F.col("p_partkey") % 10).cast("string"))
        folder = F.concat(repo, F.lit("/pk"), k)
        both = F.array(
            F.struct(F.concat(folder, F.lit("/__init__.py")).alias("path"), init.alias("content")),
            F.struct(F.concat(folder, F.lit("/sub/core.py")).alias("path"), core.alias("content")),
        )
        return spread(self.table("part"), "p_partkey", always=True).select(repo.alias("repo"), F.explode(both).alias("f")).select("repo", "f.*")


# ------------------------------------------------------------------ the same in SQL
_TYPES_SQL = "[" + ", ".join(f"'{a}'" for a in QUEUE_TYPES) + "]"
RISK_SQL = (
    "CASE {0} WHEN 'delete_file' THEN 'critical' WHEN 'restructure' THEN 'critical' "
    "WHEN 'delete_function' THEN 'high' WHEN 'move_file' THEN 'high' WHEN 'fix_security' THEN 'high' "
    "WHEN 'delete_import' THEN 'low' WHEN 'add_docstring' THEN 'low' ELSE 'medium' END"
)
ORDER_SQL = (
    "CASE {0} WHEN 'fix_security' THEN 0 WHEN 'delete_import' THEN 1 WHEN 'delete_function' THEN 2 "
    "WHEN 'refactor_code' THEN 3 WHEN 'add_docstring' THEN 4 WHEN 'restructure' THEN 5 "
    "WHEN 'move_file' THEN 6 ELSE 99 END"
)

VIEWS = {
    "files": (
        "SELECT source AS repo, source || '/' || lang || '/' || doc_id AS path, text AS content FROM documents"
    ),
    "decisions": f"""
        SELECT id, reviewer, action_type, md5(action_type || '_' || {RISK_SQL.format('action_type')}) AS context_hash,
               was_approved, confidence, created_at
        FROM (SELECT o_orderkey AS id, o_custkey AS reviewer,
                     {_TYPES_SQL}[CAST(substr(o_orderpriority, 1, 1) AS INT)] AS action_type,
                     CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS was_approved,
                     least(1.0, o_totalprice / 500000) AS confidence, o_orderdate AS created_at
              FROM orders)""",
    "queue": f"""
        SELECT id, action_type, target, {RISK_SQL.format('action_type')} AS risk_level, confidence, owner, created_at,
               file, {ORDER_SQL.format('action_type')} AS action_order
        FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
                     {_TYPES_SQL}[l_linenumber] AS action_type,
                     l_orderkey || '@part:' || l_partkey AS target, 1 - 5 * l_tax AS confidence,
                     l_suppkey AS owner, l_shipdate AS created_at, CAST(l_orderkey AS VARCHAR) AS file
              FROM lineitem)""",
    "file_events": """
        SELECT event_id, user_id AS project_id, 'm' || (event_id % 50) || '.py' AS path,
               CASE event_type WHEN 'view' THEN 'modified' WHEN 'click' THEN 'created' ELSE 'deleted' END AS kind,
               ts FROM events""",
    # Closed form of CODE: where each line of module k stands.
    "code": f"""
        SELECT *, init_line + 1 + (k % 4 = 0)::INT + (k % 13 = 0)::INT + (calls)::INT AS init_end
        FROM (SELECT *, class_line + 2 AS init_line
        FROM (SELECT *, spare_end + 2 AS class_line
        FROM (SELECT *, spare_line + 1 + 12 * (s > 25)::INT AS spare_end
        FROM (SELECT *, load_line + 3 + (k % 2 = 0)::INT AS spare_line
        FROM (SELECT *, limit_line + 2 AS load_line
        FROM (SELECT *, doc + 4 + chain::INT + star::INT + gone::INT + (k % 5 = 0)::INT AS limit_line
        FROM (SELECT p_partkey AS k, p_size AS s, p_name AS n, 'r' || (p_partkey % 10) AS repo,
                     'r' || (p_partkey % 10) || '/m' || p_partkey || '.py' AS path,
                     p_partkey % 97 <> 0 AS valid, (p_partkey % 3 <> 0)::INT AS doc,
                     p_partkey >= 10 AS chain, p_partkey >= 20 AND p_partkey % 7 = 0 AS star,
                     p_partkey % 11 = 0 AS gone, p_partkey >= 10 AND p_partkey % 9 = 0 AS calls
              FROM part)))))))""",
    "packages": """
        SELECT p_partkey AS k, 'r' || (p_partkey % 10) AS repo, 'r' || (p_partkey % 10) || '/pk' || p_partkey AS folder,
               folder || '/__init__.py' AS init, folder || '/sub/core.py' AS core FROM part""",
    "code_loc": f"""
        SELECT repo, path, k, CASE WHEN valid THEN init_end + {LONG_FILE_PADDING} * (k % 50 = 0)::INT ELSE 1 END AS loc
        FROM code""",
    "unused": """
        SELECT repo, path, k, 'j' || k AS name, 'json' AS module, doc + 2 AS line, 'import' AS type
        FROM code WHERE valid AND k % 4 <> 0
        UNION ALL SELECT repo, path, k, 'load_' || (k - 10), 'm' || (k - 10), doc + 3, 'from_import'
        FROM code WHERE valid AND chain AND k <> 11  -- load_1 is also found inside load_11
        UNION ALL SELECT repo, path, k, '*', 'm' || (k - 20), doc + 3 + chain::INT, 'from_import'
        FROM code WHERE valid AND star
        UNION ALL SELECT repo, path, k, 'thing', 'missing_' || k, doc + 3 + chain::INT + star::INT, 'from_import'
        FROM code WHERE valid AND gone""",
    "edges": """
        SELECT repo, path AS importing_file, 'os' AS source_module, 'os' AS symbol_name, true AS is_external,
               CAST(NULL AS VARCHAR) AS resolved_file FROM code WHERE valid
        UNION ALL SELECT repo, path, 'json', 'j' || k, true, NULL FROM code WHERE valid
        UNION ALL SELECT repo, path, 'm' || (k - 10), 'load_' || (k - 10), false, repo || '/m' || (k - 10) || '.py'
        FROM code WHERE valid AND chain
        UNION ALL SELECT repo, path, 'm' || (k - 20), '*', false, repo || '/m' || (k - 20) || '.py'
        FROM code WHERE valid AND star
        UNION ALL SELECT repo, path, 'missing_' || k, 'thing', false, NULL FROM code WHERE valid AND gone""",
    "spare": """
        SELECT c.repo, c.path, c.k, c.s, '_spare_' || c.k AS name, c.spare_line AS line,
               CASE WHEN a.calls AND a.valid THEN 'called in m' || a.k || '.py'
                    WHEN b.star AND b.valid THEN 'directly imported by m' || b.k || '.py' END AS alive
        FROM code c LEFT JOIN code a ON a.k = c.k + 10 LEFT JOIN code b ON b.k = c.k + 20 WHERE c.valid""",
    "code_hits": """
        SELECT repo, path, k, 'Auth Token' AS label, 'hardcoded_secret' AS finding_type, 'high' AS severity,
               limit_line - 1 AS line FROM code WHERE valid AND k % 5 = 0
        UNION ALL SELECT repo, path, k, 'Use of eval()', 'insecure_code', 'medium',
               init_line + 2 + (k % 4 = 0)::INT FROM code WHERE valid AND k % 13 = 0""",
    "doc_issues": """
        SELECT repo, path, k, 'missing_module_docstring' AS issue, CAST(NULL AS VARCHAR) AS name, 1 AS line,
               'Module is missing a docstring' AS message FROM code WHERE valid AND doc = 0
        UNION ALL SELECT repo, path, k, 'missing_function_docstring', 'load_' || k, load_line,
               'Function "load_' || k || '" is missing a docstring' FROM code WHERE valid AND k % 2 = 1
        UNION ALL SELECT repo, path, k, 'missing_function_docstring', '__init__', init_line,
               'Function "__init__" is missing a docstring' FROM code WHERE valid
        UNION ALL SELECT repo, path, k, 'short_docstring', 'Box' || k, class_line,
               'Docstring for "Box' || k || '" is very short (4 chars)' FROM code WHERE valid AND k % 2 = 1""",
    # One row per coordinated action of CODE.
    "code_actions": """
        SELECT path, k, 'delete_import' AS action_type, 'import' AS entity_type, name AS entity_name,
               0.85 AS confidence, 1 AS n, line FROM unused
        UNION ALL SELECT path, k, 'delete_function', 'function', name,
               CASE WHEN s > 25 THEN 1.0 ELSE 0.60 END, 1 + (s > 25)::INT, line FROM spare WHERE alive IS NULL
        UNION ALL SELECT path, k, 'refactor_code', 'function', name, 1.0, 1, line FROM spare
               WHERE alive IS NOT NULL AND s > 25
        UNION ALL SELECT path, k, 'add_docstring', 'function', name, 0.90, 1, line FROM doc_issues
               WHERE name IS NOT NULL AND name <> '__init__'
        UNION ALL SELECT path, k, 'fix_security', CASE WHEN severity = 'high' THEN 'variable' ELSE 'line' END,
               CASE WHEN severity = 'high' THEN 'API_TOKEN' ELSE CAST(line AS VARCHAR) END,
               CASE WHEN severity = 'high' THEN 0.95 ELSE 0.80 END, 1, line FROM code_hits
        UNION ALL SELECT code.path, code.k, 'restructure', CASE WHEN doc = 1 THEN 'statement' ELSE 'structure' END,
               CASE WHEN doc = 1 THEN 'expr_block_L1' ELSE 'm' || code.k END, 0.70, 1, 1
        FROM code JOIN code_loc USING (path) WHERE loc > 450""",
}
_NEEDS = {
    "code_loc": ["code"], "unused": ["code"], "edges": ["code"], "spare": ["code"], "code_hits": ["code"],
    "doc_issues": ["code"], "code_actions": ["code", "code_loc", "unused", "spare", "code_hits", "doc_issues"],
}


def sql(views: str, body: str) -> str:
    """A statement with the named views in front, those they build on included."""
    wanted: list[str] = []
    for name in views.split():
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in wanted:
                wanted.append(needed)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in wanted)
    if not ctes:
        return body
    stripped = body.strip()
    if stripped.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{stripped[15:]}"
    return f"WITH {ctes},\n{stripped[5:]}" if stripped.upper().startswith("WITH ") else f"WITH {ctes}\n{stripped}"
