"""Facts from source and configuration files: one pass over a table of files, one row for each finding.

Each adapter takes one file and yields findings; what reaches over files of a
repository is joined afterwards. A file that is too large, cannot be parsed or
has no parser here becomes a coverage row, so that a gap is never silent.
"""

from __future__ import annotations

import ast
import builtins
import json
import re
import sys
import tomllib
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphledger.functions.exprs import domain_of
from graphledger.operators import extract_config as config

# Fixed values that results depend on.
LARGEST = 2_000_000
HTTP_METHODS = ("get", "post", "put", "delete", "patch", "options", "head")
ROUTERS = ("fastapi.FastAPI", "fastapi.APIRouter", "flask.Flask", "flask.Blueprint")
IGNORED_FOLDERS = (".git", ".idea", ".ipynb_checkpoints", ".mypy_cache", ".next", ".pytest_cache", ".ruff_cache", ".turbo", ".vercel", ".venv", "__pycache__", "build", "coverage", "dist", "node_modules")

FINDING = "repo string, path string, tag string, predicate string, kind string, subject string, object string, detail string, line int, end_line int, place int"
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "typescript", ".jsx": "typescript", ".cs": "dotnet", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby"}
#: Languages whose parsers need programs that are not part of this package.
NEEDS_PARSER = {"typescript": "typescript_parser_unavailable", "dotnet": "csharp_parser_unavailable"}

Finding = tuple[str, str, str, str, str, str | None, int, int]
Adapter = Callable[[str, str], Iterator[Finding]]


def _fact(predicate: str, kind: str, subject: str, obj: str, line: int, detail: str | None = None, end: int | None = None) -> Finding:
    return "fact", predicate, kind, subject, obj, detail, line, line if end is None else end


def _gap(reason: str) -> Finding:
    return "coverage", "", "", "", reason, None, 0, 0


_ASSIGNMENT = re.compile(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=(.*)")


def dotenv(path: str, text: str) -> Iterator[Finding]:
    """Assignments; a value that is a URL or a domain refers to it, no other value is kept."""
    for number, line in enumerate(text.splitlines(), 1):
        found = _ASSIGNMENT.fullmatch(line)
        if found and not line.lstrip().startswith("#"):
            yield _fact("REFERENCES_ENV_VAR", "EnvVar", "", found[1], number, "dotenv")
            value = found[2].strip()
            quote = value[:1] if value[:1] in ("'", '"') else None
            bare = re.match(r"(?:\\.|[^\\" + (quote or "#") + "])*", value[1:] if quote else value)[0]
            yield from _domains(re.sub(r"\\(.)", r"\1", bare).strip(), number, "dotenv")


_DOMAIN = re.compile(r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}")


def _domains(value: str, line: int, source: str) -> Iterator[Finding]:
    host = re.sub(r"[:/?#].*$", "", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?", "", value)).lower()
    if _DOMAIN.fullmatch(host):
        yield _fact("REFERENCES_DOMAIN", "Domain", "", host, line, source)


def cname(path: str, text: str) -> Iterator[Finding]:
    for number, line in enumerate(text.splitlines(), 1):
        value = line.strip().strip("'\"`<>()[]{}.,;").lower()
        if not value.startswith("#") and _DOMAIN.fullmatch(value):
            yield _fact("REFERENCES_DOMAIN", "Domain", "", value, number, "static_site_cname")


def openapi(path: str, text: str) -> Iterator[Finding]:
    """Documented paths, each once for any method and once for each method."""
    try:
        if path.endswith(".json"):
            data = json.loads(text)
        else:
            import yaml

            data = yaml.safe_load(text)
    except ImportError:
        if re.search("openapi|swagger", path.lower()):
            yield _gap("yaml_parser_unavailable")
        return
    except Exception:  # whatever a parser makes of a broken file
        if re.search("openapi|swagger", path.lower()):
            yield _gap("openapi_parse_error")
        return
    if not (isinstance(data, dict) and isinstance(data.get("paths"), dict) and isinstance(data.get("openapi", data.get("swagger")), str)):
        return
    lines = text.splitlines()

    def line_of(key: str, start: int) -> int:
        return next((n for n in range(start, len(lines) + 1) if key in lines[n - 1]), start)

    for route, item in data["paths"].items():
        if isinstance(route, str):
            at = line_of(route, 1)
            yield _fact("DOCUMENTS_ENDPOINT", "Endpoint", "", f"ANY {route}", at)
            for method in item if isinstance(item, dict) else ():
                if isinstance(method, str) and method.lower() in HTTP_METHODS:
                    yield _fact("DOCUMENTS_ENDPOINT", "Endpoint", "", f"{method.upper()} {route}", line_of(method, at))


_PROTO_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S)


def proto(path: str, text: str) -> Iterator[Finding]:
    """Methods of services, named by package, service and method."""
    clean = _PROTO_NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    package = re.search(r"\bpackage\s+([\w.]+)\s*;", clean)
    prefix = f"{package[1]}." if package else ""
    for service in re.finditer(r"\bservice\s+(\w+)\s*\{", clean):
        depth, end = 1, service.end()
        while end < len(clean) and depth:
            depth += {"{": 1, "}": -1}.get(clean[end], 0)
            end += 1
        if depth:
            yield _gap("proto_parse_error")
            return
        for rpc in re.finditer(r"\brpc\s+(\w+)\s*\(", clean[service.end() : end]):
            yield _fact("EXPOSES_ENDPOINT", "Endpoint", "", f"GRPC /{prefix}{service[1]}/{rpc[1]}", clean.count("\n", 0, service.end() + rpc.start()) + 1)


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (inner := _dotted(node.value)):
        return f"{inner}.{node.attr}"
    return None


def python(path: str, text: str) -> Iterator[Finding]:
    """Symbols, imports, calls by what names stand for in the module, bases, routes, environment reads and swallowed exceptions."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        yield _gap("python_parse_error")
        return
    module = re.sub(r"(/__init__)?\.py$", "", path).replace("/", ".")
    yield _fact("DEFINED_IN", "CodeModule", module, "", 1, None, max(1, len(text.splitlines())))
    names: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                names[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                yield _fact("IMPORTS", "ExternalPackage", module, a.name, node.lineno, "")
        elif isinstance(node, ast.ImportFrom):
            parts = module.split(".")
            keep = len(parts) - node.level + path.endswith("__init__.py")
            base = ".".join([*parts[: max(keep, 0)], *filter(None, [node.module])]) if node.level else node.module or ""
            for a in node.names:
                names[a.asname or a.name] = f"{base}.{a.name}"
            yield _fact("IMPORTS", "ExternalPackage", module, base, node.lineno, ",".join(a.name for a in node.names))
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            names[node.name] = f"{module}.{node.name}"

    routers = _routers(tree, names)

    def walk(body: list[ast.stmt], owner: str, inside: str | None) -> Iterator[Finding]:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                own = f"{owner}.{node.name}"
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if inside else "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function"
                yield _fact("DEFINED_IN", "CodeSymbol", own, module, node.lineno, kind, node.end_lineno)
                for base in getattr(node, "bases", ()):
                    if name := _dotted(base):
                        yield _fact("IMPLEMENTS", "CodeSymbol", own, _meant(names, name), node.lineno)
                for mark in node.decorator_list:
                    yield from _route(mark, own, routers)
                yield from walk(node.body, own, own if isinstance(node, ast.ClassDef) else None)
                if not isinstance(node, ast.ClassDef):
                    yield from _calls(node, own, owner if inside else None, names)
            elif not isinstance(node, (ast.Import, ast.ImportFrom)) and owner == module:
                yield from _calls(node, module, None, names)

    yield from walk(tree.body, module, None)
    for node in ast.walk(tree):
        if isinstance(node, ast.ExceptHandler) and all(isinstance(b, (ast.Pass, ast.Continue)) for b in node.body):
            yield _fact("code_risk_signal", "CodeModule", module, "swallowed_exception", node.lineno)


def _meant(names: dict[str, str], dotted: str) -> str:
    head, _, rest = dotted.partition(".")
    return ".".join(filter(None, (names.get(head, head), rest)))


def _calls(node: ast.AST, caller: str, cls: str | None, names: dict[str, str]) -> Iterator[Finding]:
    stack = list(ast.iter_child_nodes(node))
    while stack:
        inner = stack.pop()
        if isinstance(inner, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        stack.extend(ast.iter_child_nodes(inner))
        if isinstance(inner, ast.Call) and (name := _dotted(inner.func)):
            target = f"{cls}.{name[5:]}" if cls and name.startswith("self.") and name.count(".") == 1 else _meant(names, name)
            if name.split(".")[0] in names or target != name or hasattr(builtins, name):
                yield _fact("CALLS", "CodeSymbol", caller, target, inner.lineno)
            if target in ("os.getenv", "os.environ.get") and inner.args and isinstance(inner.args[0], ast.Constant) and isinstance(inner.args[0].value, str):
                yield _fact("REFERENCES_ENV_VAR", "EnvVar", caller, inner.args[0].value, inner.lineno, "code_access")
        elif isinstance(inner, ast.Subscript) and _meant(names, _dotted(inner.value) or "") == "os.environ" and isinstance(inner.slice, ast.Constant):
            yield _fact("REFERENCES_ENV_VAR", "EnvVar", caller, str(inner.slice.value), inner.lineno, "code_access")


def _routers(tree: ast.Module, names: dict[str, str]) -> dict[str, str | None]:
    """Variables that hold an application or a router, with the prefix of its paths; null if that is no literal."""
    out: dict[str, str | None] = {}
    for node in ast.walk(tree):
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        if targets and isinstance(node.value, ast.Call) and _meant(names, _dotted(node.value.func) or "") in ROUTERS:
            given = next((k.value for k in node.value.keywords if k.arg == "prefix"), ast.Constant(""))
            prefix = given.value if isinstance(given, ast.Constant) and isinstance(given.value, str) else None
            out.update((t.id, prefix) for t in targets if isinstance(t, ast.Name))
    return out


def _route(mark: ast.expr, owner: str, routers: dict[str, str | None]) -> Iterator[Finding]:
    """Decorators like app.get("/x") and app.route("/x", methods=[...]) of known applications and routers."""
    if not (isinstance(mark, ast.Call) and isinstance(mark.func, ast.Attribute) and mark.args and isinstance(mark.args[0], ast.Constant) and isinstance(mark.args[0].value, str)):
        return
    if not isinstance(mark.func.value, ast.Name) or (prefix := routers.get(mark.func.value.id)) is None:
        return
    verb, path = mark.func.attr.lower(), prefix + mark.args[0].value
    if verb in HTTP_METHODS:
        yield _fact("EXPOSES_ENDPOINT", "Endpoint", owner, f"{verb.upper()} {path}", mark.lineno)
    elif verb == "route":
        given = next((k.value for k in mark.keywords if k.arg == "methods"), None)
        methods = [e.value for e in given.elts if isinstance(e, ast.Constant)] if isinstance(given, (ast.List, ast.Tuple)) else ["GET"]
        for method in methods:
            yield _fact("EXPOSES_ENDPOINT", "Endpoint", owner, f"{str(method).upper()} {path}", mark.lineno)


def manifest(path: str, text: str) -> Iterator[Finding]:
    """Declared dependencies of requirements files, pyproject.toml and package.json."""
    name = PurePosixPath(path).name
    try:
        if name == "package.json":
            data = json.loads(text)
            wanted = [k for part in ("dependencies", "devDependencies", "peerDependencies") for k in data.get(part, {})]
        elif name == "pyproject.toml":
            project = tomllib.loads(text).get("project", {})
            wanted = [*project.get("dependencies", []), *(d for group in project.get("optional-dependencies", {}).values() for d in group)]
        else:
            wanted = [line for line in text.splitlines() if line.strip() and not line.lstrip().startswith(("#", "-"))]
    except (ValueError, AttributeError):
        yield _gap("manifest_parse_error")
        return
    for d in wanted:
        bare = d if name == "package.json" else re.split(r"[\s;\[<>=!~@]", d.strip(), maxsplit=1)[0]
        yield _fact("DEPENDS_ON", "ExternalPackage", "", bare, 0, name)


def adapters_of(path: str) -> list[Adapter]:
    """Which adapters a file's name calls for."""
    name, suffix = PurePosixPath(path).name, PurePosixPath(path).suffix
    out: list[Adapter] = []
    if name == ".env" or name.startswith(".env.") or suffix == ".env":
        out.append(dotenv)
    if name == "CNAME":
        out.append(cname)
    if suffix in (".json", ".yaml", ".yml") and name != "package.json":
        out.append(openapi)
    if suffix in (".yaml", ".yml"):
        out += [config.kubernetes, config.serverless]
    if suffix == ".json":
        out.append(config.zappa)
    if suffix == ".conf":
        out.append(config.apache)
    if suffix == ".tf":
        out.append(config.terraform)
    if suffix in (".yaml", ".yml", ".json", ".ini", ".toml", ".env", ".cfg", ".tf"):
        out.append(config.channels)
    if suffix == ".proto":
        out.append(proto)
    if suffix == ".py":
        out.append(python)
    if name in ("package.json", "pyproject.toml") or re.fullmatch(r"requirements.*\.txt", name):
        out.append(manifest)
    return out


def findings_of(path: str, text: str | None) -> list[Finding]:
    """All findings of one file; an adapter that fails leaves a coverage row and the others' findings."""
    if text is None or len(text) > LARGEST:
        return [_gap("file_too_large" if text is not None else "file_unreadable")]
    out: list[Finding] = []
    for adapter in adapters_of(path):
        try:
            out.extend(adapter(path, text))
        except (ValueError, TypeError, RecursionError) as error:
            out.append(_gap(f"{adapter.__name__}_failed:{type(error).__name__}"))
    language = LANGUAGES.get(PurePosixPath(path).suffix)
    if language and language != "python":
        out.append(_gap(NEEDS_PARSER.get(language, "unsupported_language")))
    return out


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split(" ")[0] for c in FINDING.split(", ")]
    for frame in batches:
        rows = [(repo, path, *finding, place) for repo, path, text in zip(frame["repo"], frame["path"], frame["content"]) for place, finding in enumerate(findings_of(path, text))]
        yield pd.DataFrame(rows, columns=names)


def extract(files: DataFrame) -> DataFrame:
    """Findings of a table of files (repo, path, content)."""
    return files.select("repo", "path", "content").mapInPandas(_run, FINDING)


def read_files(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """The text files under a folder, without ignored folders; files over the limit come without content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("/")[-1]) + "/", "")
    rows = raw.select(F.lit(repo).alias("repo"), path.alias("path"), F.when(F.col("length") <= LARGEST, F.try_validate_utf8(F.col("content").cast("string"))).alias("content"))
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED_FOLDERS))))


def classify_imports(findings: DataFrame) -> DataFrame:
    """Imports with their category: a module of the same repository, the standard library, declared or unknown."""
    rows = findings.where("predicate = 'IMPORTS'").withColumn("root", F.split("object", "[.]")[0])
    modules = findings.where("kind = 'CodeModule' AND predicate = 'DEFINED_IN'").select("repo", F.col("subject").alias("object")).distinct().withColumn("internal", F.lit(True))
    declared = findings.where("predicate = 'DEPENDS_ON'").select("repo", F.regexp_replace(F.lower("object"), "[-_.]+", "-").alias("key")).distinct().withColumn("declared", F.lit(True))
    rows = rows.withColumn("key", F.regexp_replace(F.lower("root"), "[-_.]+", "-"))
    rows = rows.join(modules, ["repo", "object"], "left").join(declared, ["repo", "key"], "left")
    standard = F.col("root").isin(*sorted(sys.stdlib_module_names))
    category = F.when(F.col("internal"), "internal_module").when(standard, "stdlib").when(F.col("declared"), "third_party").otherwise("unknown")
    return rows.select("repo", "path", "subject", "object", "line", category.alias("category"))


def domains_in(texts: DataFrame, key: str, column: str) -> DataFrame:
    """Hosts of URLs in a text column: key, domain. No Python: a pattern and an explode."""
    urls = F.regexp_extract_all(F.col(column), F.lit(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>]+"), 0)
    rows = texts.select(key, F.explode(urls).alias("url")).select(key, domain_of(F.col("url")).alias("domain"))
    return rows.where("domain IS NOT NULL").distinct()
