"""Facts of source files as one table, and checks as queries over it.

One worker pass per file emits every kind of fact (kind, line, name, value, extra); all checks are filters, joins and
aggregations of that table, so that a file is parsed once for all of them. Files that do not parse have one fact of the
kind error. Files without any word of the kinds asked for can be filtered out before the pass.
"""

from __future__ import annotations

import ast
import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("value", T.StringType()), T.StructField("extra", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("list", T.ArrayType(T.StringType()))])
_BRANCHES = (ast.If, ast.For, ast.While, ast.Try, ast.ExceptHandler, ast.With, ast.BoolOp)
_LOGS = frozenset("debug info warning error critical exception log write".split())


def dotted(node) -> str:
    """A name with its attributes, as far as it is one."""
    if isinstance(node, ast.Call):
        return dotted(node.func)
    if isinstance(node, ast.Attribute):
        left = dotted(node.value)
        return f"{left}.{node.attr}" if left else node.attr
    if isinstance(node, ast.Name):
        return node.id
    return str(node.value) if isinstance(node, ast.Constant) else ""


def value_kind(node) -> str:
    """What an expression is, as far as checks tell it apart."""
    if isinstance(node, ast.Constant):
        return "true" if node.value is True else "str" if isinstance(node.value, str) else "const"
    if isinstance(node, ast.JoinedStr):
        return "fstring"
    if isinstance(node, ast.BinOp):
        return "add" if isinstance(node.op, ast.Add) else "percent" if isinstance(node.op, ast.Mod) else "binop"
    if isinstance(node, ast.Call):
        return "format" if dotted(node.func).endswith(".format") or isinstance(node.func, ast.Attribute) and node.func.attr == "format" else "call"
    return {ast.List: "list", ast.Dict: "dict", ast.Set: "set", ast.Name: "name"}.get(type(node), "other")


def python_facts_of(text: str) -> list[tuple]:
    """(kind, line, end_line, name, value, extra, n, list) of one Python file."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [("error", getattr(e, "lineno", None) or 0, None, type(e).__name__, None, None, None, None)]
    lines, out, complexity = text.splitlines(), [], {}
    noqa = lambda k: any("# noqa" in lines[i] for i in (k - 1, k) if i < len(lines))
    # (node, enclosing functions, enclosing class, enclosing loop's line)
    todo: list[tuple] = [(tree, (), None, None)]
    while todo:
        node, inside, cls, loop = todo.pop()
        at, to = getattr(node, "lineno", 0), getattr(node, "end_lineno", None)
        if isinstance(node, _BRANCHES):
            for f in inside:
                complexity[f] = complexity.get(f, 1) + 1
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(("function", at, to, node.name, "async" if isinstance(node, ast.AsyncFunctionDef) else "def", cls, node, [a.arg for a in node.args.args]))
            out += [("decorator", d.lineno, None, node.name, dotted(d), None, None, None) for d in node.decorator_list]
            out += [("default", at, None, node.name, value_kind(d), None, None, None) for d in [*node.args.defaults, *node.args.kw_defaults] if d is not None]
            inside = (*inside, node)
        elif isinstance(node, ast.ClassDef):
            methods = sum(isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) for x in node.body)
            out.append(("class", at, to, node.name, None, None, methods, [dotted(b) for b in node.bases]))
            cls = node.name
        elif isinstance(node, ast.Import):
            out += [("import", at, None, a.name, a.asname or a.name, "import", 0, None) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [("import", at, None, node.module or "", a.asname or a.name, "from", node.level, [a.name]) for a in node.names]
        elif isinstance(node, ast.Call):
            if name := dotted(node.func):
                out.append(("call", at, to, name, value_kind(node.args[0]) if node.args else None, inside[-1].name if inside else None, loop, None))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(t, (ast.Name, ast.Attribute)) and node.value is not None:
                    extra = dotted(node.value) if isinstance(node.value, ast.Call) else None
                    size = len(node.value.value) if isinstance(node.value, ast.Constant) and isinstance(node.value.value, str) else None
                    out.append(("assign", at, None, dotted(t), value_kind(node.value), extra, size, None))
        elif isinstance(node, ast.ExceptHandler):
            empty = not node.body or len(node.body) == 1 and isinstance(node.body[0], ast.Pass)
            handled = any(isinstance(x, (ast.Return, ast.Raise)) or isinstance(x, ast.Call) and (isinstance(x.func, ast.Attribute) and x.func.attr in _LOGS or isinstance(x.func, ast.Name) and x.func.id == "print") for x in ast.walk(node))
            out.append(("except", at, to, dotted(node.type) if node.type else "bare", "empty" if empty else "handled" if handled else "silent", "noqa" if noqa(at) else None, None, None))
        elif isinstance(node, ast.Try):
            out.append(("try", at, to, None, "finally" if node.finalbody else None, None, len(node.handlers), None))
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            out += [("with", at, to, dotted(i.context_expr), None, None, None, None) for i in node.items]
        if isinstance(node, (ast.For, ast.While, ast.AsyncFor)):
            loop = at
        todo += [(c, inside, cls, loop) for c in reversed(list(ast.iter_child_nodes(node)))]
    return [(k, a, b, c, d, e, complexity.get(n, 1) if k == "function" else n, ls) for k, a, b, c, d, e, n, ls in out]


#: Bytes of text (and rows, each as so many bytes) that one task parses, the most tasks, and facts in one batch.
TASK_BYTES, ROW_BYTES, MOST_TASKS, BATCH_FACTS = 1 << 20, 1 << 8, 4000, 1 << 16


def spread(files: DataFrame, content: str) -> DataFrame:
    """files dealt out by their own values to tasks of about TASK_BYTES, as small tables of many files come in one."""
    size = files.agg(F.sum(F.coalesce(F.octet_length(F.col(content)), F.lit(0)) + F.lit(ROW_BYTES))).first()[0] or 0
    return files.repartition(int(min(MOST_TASKS, size // TASK_BYTES + 1)), *files.columns)


def python_facts(files: DataFrame, path: str = "path", content: str = "content", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Facts of all files, of the kinds given (all, if none are); equal texts of a batch are parsed once."""
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]

    def run(batches):
        def packed(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=FACTS.names)

        for b in batches:
            known, rows = {}, []
            for p, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                if text not in known:
                    known[text] = [f for f in python_facts_of(text) if kinds is None or f[0] in kinds]
                rows += [(p, *f) for f in known[text]]
                if len(rows) >= BATCH_FACTS:
                    yield packed(rows)
                    rows = []
            yield packed(rows)

    own = files.select(F.col(path).cast("string").alias("path"), F.col(content).cast("string").alias("content"))
    return spread(own, "content").mapInArrow(run, FACTS)


# Calls that are dangerous, their rule and severity; an undotted one also counts as an attribute.
DANGEROUS = {"eval": "SEC-EVAL-001", "exec": "SEC-EXEC-001", "os.system": "SEC-CMD-001", "pickle.loads": "SEC-DESER-001", "pickle.load": "SEC-DESER-002", "yaml.load": "SEC-DESER-003", "marshal.loads": "SEC-DESER-004", "marshal.load": "SEC-DESER-005", "shelve.open": "SEC-DESER-006"}
# Parts of names that hold secrets, and that need random numbers nobody can guess.
SENSITIVE = "password passwd pwd secret api_key apikey token auth_token access_token private_key db_password secret_key flask_secret".split()
UNGUESSABLE = "token password secret key salt nonce otp".split()
DEBUG_NAMES = ["debug", "app.debug", "debug_mode", "flask_debug"]


def _any_in(col, words):
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.lower(col), w))


def python_checks(facts: DataFrame) -> DataFrame:
    """path, rule_id, severity, line, name of every breach in a table of facts."""
    is_ = lambda k: F.col("kind") == k
    dim = facts.sparkSession.createDataFrame(list(DANGEROUS.items()), "word string, rule string")
    last = F.substring_index("name", ".", -1)
    danger = facts.where(is_("call")).join(F.broadcast(dim), (F.col("name") == F.col("word")) | (~F.col("word").contains(".") & F.col("name").contains(".") & (last == F.col("word")))).select("path", F.col("rule").alias("rule_id"), F.lit("high").alias("severity"), "line", "name")
    ends = lambda w: (F.col("name") == w) | F.col("name").endswith(f".{w}")
    table = [
        ("SEC-066", "critical", is_("assign") & _any_in(F.col("name"), SENSITIVE) & ((F.col("value") == "fstring") | (F.col("value") == "str") & (F.col("n") > 3))),
        ("SEC-SQLI-001", "critical", is_("call") & ends("execute") & (F.col("value") == "fstring")),
        ("SEC-SQLI-002", "critical", is_("call") & ends("execute") & (F.col("value") == "format")),
        ("SEC-SQLI-003", "critical", is_("call") & ends("execute") & (F.col("value") == "add")),
        ("B3-EXCEPT-001", "high", is_("except") & F.col("extra").isNull() & (F.col("name") == "bare")),
        ("B3-EXCEPT-002", "low", is_("except") & F.col("extra").isNull() & (F.col("name") == "Exception") & (F.col("value") == "silent")),
        ("B3-EXCEPT-003", "medium", is_("except") & F.col("extra").isNull() & (F.col("value") == "empty")),
        ("SEC-DEBUG-001", "high", is_("assign") & F.lower("name").isin(DEBUG_NAMES) & (F.col("value") == "true")),
        ("CQ-IMPORT-001", "low", is_("import") & (F.col("value") == "*")),
        ("B3-DEFAULT-001", "medium", is_("default") & F.col("value").isin("list", "dict", "set")),
        ("SEC-PATH-001", "high", is_("call") & ends("open") & (F.col("value") == "fstring")),
        ("SEC-PATH-002", "high", is_("call") & ends("open") & (F.col("value") == "add")),
    ]
    hits = F.filter(F.array(*(F.when(c, F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, c in table)), lambda x: x.isNotNull())
    plain = facts.withColumn("_h", hits).where(F.size("_h") > 0).select("path", F.explode("_h").alias("h"), "line", "name").select("path", "h.rule_id", "h.severity", "line", "name")
    uses = facts.where(is_("import") & ((F.col("name") == "random") | F.col("name").endswith(".random") | F.array_contains("list", "random"))).select("path").distinct()
    weak = facts.where(is_("assign") & F.col("extra").contains("random") & _any_in(F.col("name"), UNGUESSABLE)).join(uses, "path", "left_semi").select("path", F.lit("SEC-RAND-001").alias("rule_id"), F.lit("high").alias("severity"), "line", "name")
    return plain.unionByName(danger).unionByName(weak)


def summary(facts: DataFrame) -> DataFrame:
    """One row per file: numbers of functions, classes, imports, calls and assignments, and total, average and largest complexity."""
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    c = F.when(F.col("kind") == "function", F.col("n"))
    return facts.groupBy("path").agg(n("function").alias("functions"), n("class").alias("classes"), n("import").alias("imports"), n("call").alias("calls"), n("assign").alias("assigns"), F.coalesce(F.sum(c), F.lit(0)).alias("total_complexity"), F.coalesce(F.round(F.avg(c), 2), F.lit(0.0)).alias("avg_complexity"), F.coalesce(F.max(c), F.lit(0)).alias("max_complexity"))


def calls_in_loops(facts: DataFrame, names: list[str]) -> DataFrame:
    """Calls of the names inside a loop, as queries repeated for each row are."""
    return facts.where((F.col("kind") == "call") & F.col("n").isNotNull() & F.substring_index("name", ".", -1).isin(names)).select("path", "line", "name", F.col("n").alias("loop_line"))


def unclosed(facts: DataFrame, openers: list[str]) -> DataFrame:
    """Calls of openers that stand in no with statement and in no try with finally; the facts are read once."""
    opens = (F.col("kind") == "call") & F.col("name").isin(openers)
    holds = (F.col("kind") == "with") | (F.col("kind") == "try") & (F.col("value") == "finally")
    # a point lies in a range if, of the ranges that begin no later, the one that ends last does not end before it
    sofar = Window.partitionBy("path").orderBy("line").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = facts.where(opens | holds).withColumn("_to", F.max(F.when(holds, F.col("end_line"))).over(sofar))
    safe = F.col("path").isNotNull() & F.coalesce(F.col("_to") >= F.col("line"), F.lit(False))
    return rows.where(opens & ~safe).select("path", "line", "name")


def unused_imports(facts: DataFrame, files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, name of imported names that occur only once as a word of the file."""
    names = facts.where("kind = 'import' and value <> '*'").select("path", F.substring_index("value", ".", 1).alias("name")).distinct()
    each = files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("_text")).join(names.groupBy("path").agg(F.collect_set("name").alias("_names")), "path")
    # only words that the file imports leave their file, each text once
    words = F.filter(F.regexp_extract_all(F.col("_text"), F.lit(r"[A-Za-z_]\w*"), F.lit(0)), lambda w: F.array_contains(F.col("_names"), w))
    return each.select("path", F.explode(words).alias("name")).groupBy("path", "name").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("path", "name")


_JS = T.StructType([T.StructField("path", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("comment", T.StringType()), T.StructField("hook", T.StringType())])


def masked_script(text: str) -> list[tuple[int, str, int, str]]:
    """(line, code with strings blanked and comments removed, depth of braces before it, comment text) of a script's lines."""
    out, code, note, line, depth, start = [], [], [], 1, 0, 0
    state, k = "", 0
    while k <= len(text):
        c = text[k : k + 1]
        if c in ("\n", ""):
            out.append((line, "".join(code), start, "".join(note).strip()))
            code, note, line, start = [], [], line + 1, depth
            if state in ("//", "'", '"'):
                state = ""
            k += 1
            continue
        two = text[k : k + 2]
        if not state:
            if two in ("//", "/*"):
                state, k = two, k + 2
                continue
            if c in "'\"`":
                state = c
            elif c in "{}":
                depth = max(0, depth + (1 if c == "{" else -1))
            code.append(c)
        elif state == "//":
            note.append(c)
        elif state == "/*":
            if two == "*/":
                state, k = "", k + 2
                continue
            note.append(c)
        elif c == "\\":
            code.append("  ")
            k += 2
            continue
        elif c == state:
            state = ""
            code.append(c)
        else:
            code.append(" ")
        k += 1
    return out


def hook_calls(lines: list[tuple]) -> dict[int, str]:
    """By line: the whole masked call, up to its closing bracket, of the last hook that is called there."""
    text, starts, at = "\n".join(r[1] for r in lines), [], 0
    for r in lines:
        starts.append(at)
        at += len(r[1]) + 1
    out = {}
    for m in re.finditer(r"\buse[A-Z]\w*\s*\(", text):
        depth, k = 0, m.end() - 1
        while k < len(text):
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
            if not depth:
                break
        out[lines[bisect.bisect_right(starts, m.start()) - 1][0]] = text[m.start() : k]
    return out


def script_lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, line, code, depth, comment, hook of every line of scripts."""

    def run(batches):
        for b in batches:
            rows = []
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = masked_script(t or "")
                hooks = hook_calls(lines)
                rows += [(p, *r, hooks.get(r[0])) for r in lines]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()], strict=True)], names=_JS.names)

    return files.select(F.col(path).cast("string"), F.col(content).cast("string")).mapInArrow(run, _JS)


def script_checks(lines: DataFrame) -> DataFrame:
    """path, rule_id, line of breaches that masked lines and hook calls show."""
    rows, c, hook = lines, F.col("code"), F.col("hook")
    table = [
        ("TS-001", c.rlike(r"[:<,]\s*any\b|\bas\s+any\b")),
        ("TS-002", c.rlike(r"[\w\)\]]!(?:\.|\[|;|\)|,)")),
        ("TS-003", F.col("comment").rlike(r"^@ts-(?:ignore|expect-error)\s*$")),
        ("JS-002", c.rlike(r"[^=!<>]==[^=]|!=[^=]")),
        ("JS-003", c.rlike(r"(?<![\w.$])eval\s*\(")),
        ("JS-004", c.rlike(r"\bconsole\.log\s*\(")),
        ("JS-005", c.rlike(r"(?:\)|else|try|finally)\s*\{\s*\}")),
        ("HOOKS-002", c.rlike(r"^\s*(?:if|for|while|switch)\b.*\buse[A-Z]\w*\s*\(")),
        ("HOOKS-003", hook.startswith("useEffect") & ~hook.rlike(r",\s*\[[^\]]*\]\s*\)$")),
        ("HOOKS-005", hook.rlike(r"^use(?:Callback|Memo)\s*\(") & ~hook.rlike(r",\s*\[[^\]]*\]\s*\)$")),
        ("HOOKS-007", c.rlike(r"\buseEffect\s*\(\s*async\b")),
        ("HOOKS-008", c.rlike(r"\buseState\s*\(\s*(?!\(|function)[\w.]+\s*\([^)]")),
    ]
    hits = F.filter(F.array(*(F.when(t, F.lit(r)) for r, t in table)), lambda x: x.isNotNull())
    return rows.withColumn("_h", hits).where(F.size("_h") > 0).select("path", F.explode("_h").alias("rule_id"), "line")
