"""Fixed dimensions: scopes, document types, languages, families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCOPES = ("universal", "backend", "webapp", "mobile", "e2e", "infra", "platform-process")
FAMILIES = ("corpus", "code", "history", "code_history", "failure_modes")
CODE_FAMILIES = ("code", "code_history")
CODE_SCOPES = ("backend", "webapp", "mobile", "e2e", "infra")
#: Project folder to scope.  A deployment passes its own; these are neutral examples.
PROJECT_SCOPES = {"core-api": "backend", "web": "webapp", "mobile": "mobile", "core-api-e2e": "e2e", "infra": "infra"}
#: Folders of a project that hold its documents.
PROJECT_FOLDERS = ("retrospectives", "workflows", "prompts", "operations")
# Other folders of the tree and their scope.
FOLDER_SCOPES = (
    ("views/", "webapp"), ("wireframes/", "webapp"), ("ux/", "webapp"),
    ("execution-reports/", "platform-process"), ("skills/", "platform-process"), ("templates/", "platform-process"),
    ("standards/", "universal"), ("decisions/", "universal"), ("anti-patterns/", "universal"), ("patterns/", "universal"), ("audit-report/", "universal"),
    ("architecture/", "universal"), ("dsl/", "universal"), ("dictionary/", "universal"), ("corpus/", "universal"),
)
# Folder, required extension, document type; the first that fits counts.
DOC_TYPES = (
    ("standards/", ".yaml", "standard"), ("decisions/", ".yaml", "decision"), ("anti-patterns/", ".yaml", "anti_pattern"), ("patterns/", None, "pattern"),
    ("retrospectives/", None, "retro"), ("workflows/", None, "workflow"), ("prompts/", None, "prompt"), ("templates/", None, "template"), ("skills/", None, "skill"),
    ("audit-report/", None, "audit"), ("architecture/", None, "architecture"), ("operations/", None, "operation"), ("ux/", None, "view"), ("views/", None, "view"),
    ("wireframes/", None, "view"), ("execution-reports/", None, "execution_report"), ("dsl/", None, "meta"), ("dictionary/", None, "meta"), ("corpus/", None, "meta"),
)
# File extensions and their language.
LANGUAGES = {
    "go": "go", "java": "java", "kt": "kotlin", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "tf": "hcl", "hcl": "hcl",
    "sh": "shell", "bash": "shell", "sql": "sql", "yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown", "xml": "xml", "html": "html", "css": "css", "scss": "scss",
    "properties": "properties", "toml": "toml", "rs": "rust", "rb": "ruby", "c": "c", "cpp": "cpp", "h": "c", "swift": "swift", "gradle": "gradle",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scope_rules(projects: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(prefix, scope) in order; the first prefix that fits counts."""
    projects = PROJECT_SCOPES if projects is None else projects
    return [(f"{folder}/{name}/", scope) for scope in SCOPES for name, s in projects.items() if s == scope for folder in PROJECT_FOLDERS] + list(FOLDER_SCOPES)


def path_scope(path, projects: dict[str, str] | None = None, default: str = "universal") -> Column:
    out = F.lit(default)
    for prefix, scope in reversed(scope_rules(projects)):
        out = F.when(_col(path).startswith(prefix), scope).otherwise(out)
    return out


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_col(path), r"(\.[^./]*)\z", 1))


def path_doc_type(path) -> Column:
    out = F.lit("doc")
    for prefix, ext, kind in reversed(DOC_TYPES):
        test = _col(path).startswith(prefix)
        if ext:
            test = test & (extension(path) == ext)
        out = F.when(test, kind).otherwise(out)
    return out


def repo_scope(repo, projects: dict[str, str] | None = None) -> Column:
    out = F.lit("universal")
    for name, scope in (PROJECT_SCOPES if projects is None else projects).items():
        out = F.when(_col(repo) == name, scope).otherwise(out)
    return out


def language(path) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    name = F.regexp_extract(_col(path), r"([^/]*)\z", 1)
    by_name = F.when(name == "Dockerfile", "dockerfile").when(name == "Makefile", "makefile")
    return F.coalesce(by_name, F.element_at(table, F.regexp_replace(extension(path), r"\A\.", "")), F.lit("text"))


def scope_dim(spark: SparkSession) -> DataFrame:
    """One row per scope, in order: counts are joined to it so that empty scopes show as zero."""
    return spark.createDataFrame([(i, s) for i, s in enumerate(SCOPES)], "scope_no int, scope string")


def with_universal(scopes: list[str], first: bool = False) -> list[str]:
    """The scopes with ``universal`` once, at the front or at the end."""
    rest = [s for s in dict.fromkeys(scopes) if s != "universal"]
    return ["universal", *rest] if first else [*rest, "universal"]
