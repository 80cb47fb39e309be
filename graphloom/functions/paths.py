"""Classification of repository paths as column expressions. The order of rules is part of the result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# File names, extensions and folders.
DOCUMENT_FOLDERS = ("docs", "doc", "documentation")
EXAMPLE_FOLDERS = ("examples", "tutorials")
TEXT_FORMATS = (".md", ".rst", ".markdown")
DEPENDENCY_FILES = ("pyproject.toml", "setup.py", "setup.cfg", "pipfile", "pipfile.lock")
ENVIRONMENT_FILES = ("environment.yml", "environment.yaml")
MANIFEST_TYPES = {
    "environment.yml": "environment_yml",
    "environment.yaml": "environment_yml",
}
SKIPPED_FOLDERS = (".git/", ".github/", ".ipynb_checkpoints/", "__pycache__/", "node_modules/", "dist/", "build/", "_build/", "site/", ".venv/", "venv/", "env/", ".mypy_cache/", ".pytest_cache/")
ALLOWED_NAMES = (
    "readme", "readme.md", "readme.rst", "readme.txt",
    "license", "license.md", "license.txt",
    "contributing", "contributing.md", "contributing.rst", "contributing.txt",
    "changelog", "changelog.md", "changelog.rst", "changelog.txt",
    "citation", "citation.md", "citation.txt", "citation.cff",
    "security.md", "code_of_conduct.md",
    "requirements.txt", "environment.yml", "environment.yaml", "pyproject.toml", "setup.py", "setup.cfg", "pipfile", "pipfile.lock",
)
ALLOWED_FORMATS = (".md", ".markdown", ".rst", ".ipynb", ".cff", ".toml", ".yml", ".yaml", ".py")
ALLOWED_FOLDERS = ("docs/", "doc/", "documentation/", "examples/", "example/", "tutorials/", "tutorial/", "notebooks/", "notebook/", "workshop/", "workshops/")
EXCLUDED_NAME_PARTS = ("checkpoint", "dummy", "placeholder", "deleteme", "tmp", "temp", "backup", "~")
GENERATED_PARTS = ("/api/", "/reference/", "/generated/", "_build/")
VENDORED_PARTS = ("_build/", "/vendor/", "/vendors/", "/third_party/", "/third-party/", "/site-packages/", "/dist/", "/build/")
FOLDER_WORDS = ("script", "scripts", "notebook", "notebooks", "tutorial", "tutorials", "example", "examples", "demo", "demos", "exercise", "exercises", "lesson", "lessons", "lab", "labs", "training", "workflow", "workflows")
FOLDER_FORMATS = (".ipynb", ".md", ".markdown", ".rst", ".txt", ".cff")


def _any(test, values) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | test(F.lit(v))
    return out


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """With its dot; none for names that begin with their only dot or end in one."""
    return F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1)


def first_folder(path: Column) -> Column:
    return F.element_at(F.split(F.lower(path), "/"), 1)


def file_role(path: Column, name: Column, ext: Column) -> Column:
    low, name, ext = F.lower(path), F.lower(name), F.lower(ext)
    begins = lambda *ps: _any(lambda p: F.startswith(name, p), ps)
    top = first_folder(path)
    rules = [
        ("readme", begins("readme")),
        ("license", begins("license", "licence", "copying")),
        ("citation_cff", name == "citation.cff"),
        ("citation_md", name.isin("citation", "citation.md", "citation.txt")),
        ("changelog", begins("changelog")),
        ("contributing", begins("contributing")),
        ("code_of_conduct", begins("code_of_conduct")),
        ("security", name == "security.md"),
        ("dockerfile", name.isin("dockerfile", "containerfile") | begins("dockerfile.")),
        ("dependency_manifest", (begins("requirements") & F.endswith(name, F.lit(".txt"))) | name.isin(*DEPENDENCY_FILES)),
        ("environment_manifest", name.isin(*ENVIRONMENT_FILES)),
        ("notebook", ext == ".ipynb"),
        ("documentation", top.isin(*DOCUMENT_FOLDERS) & ext.isin(*TEXT_FORMATS)),
        ("example", top.isin(*EXAMPLE_FOLDERS) & ext.isin(*TEXT_FORMATS, ".ipynb")),
        ("source", ext == ".py"),
        ("documentation", ~F.contains(low, F.lit("/")) & ext.isin(*TEXT_FORMATS)),
    ]
    out = F.when(rules[0][1], rules[0][0])
    for role, rule in rules[1:]:
        out = out.when(rule, role)
    return out.otherwise("other")


def manifest_scope(path: Column) -> Column:
    top = first_folder(path)
    return F.when(top.isin(*DOCUMENT_FOLDERS), "docs").when(top.isin(*EXAMPLE_FOLDERS), "example").otherwise("root")


def manifest_type(path: Column) -> Column:
    name = F.lower(file_name(path))
    out = F.when(F.startswith(name, F.lit("requirements")) & F.endswith(name, F.lit(".txt")), "requirements_txt").when(F.endswith(name, F.lit("-lock.yml")), "conda_lock_yml")
    for given, kind in MANIFEST_TYPES.items():
        out = out.when(name == given, kind)
    return out.otherwise(F.translate(name, ".-", "__"))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(strip(F.translate(path, "\\", "/")), r"\A\./", "")


def skipped(path: Column) -> Column:
    low = F.lower(normal_path(path))
    return _any(lambda p: F.startswith(low, p), SKIPPED_FOLDERS) | F.contains(low, F.lit("/.ipynb_checkpoints/"))


def folder_words(segment: Column) -> Column:
    """A folder's name without numbering, as words."""
    s = F.regexp_replace(F.lower(strip(segment)), r"\A\d+[._\- ]*", "")
    return F.split(strip(F.regexp_replace(s, r"[._\-\s]+", " ")), " ")


def in_telling_folder(path: Column) -> Column:
    parts = F.filter(F.split(normal_path(path), "/"), lambda s: ~s.isin("", "."))
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(folders, lambda s: F.arrays_overlap(folder_words(s), F.array(*[F.lit(w) for w in FOLDER_WORDS])))


def selection_reason(path: Column, repository: Column) -> Column:
    """Why a file is worth keeping, or null."""
    low = F.lower(normal_path(path))
    name = F.element_at(F.filter(F.split(low, "/"), lambda s: s != ""), -1)
    ext = extension(name)
    repo = F.lower(strip(F.coalesce(repository, F.lit(""))))
    holds = lambda parts, where: _any(lambda p: F.contains(where, p), parts)
    dropped = (
        skipped(low)
        | holds(EXCLUDED_NAME_PARTS, name)
        | ((ext == ".rst") & holds(GENERATED_PARTS, low))
        | ((ext == ".rst") & (repo != "") & F.startswith(name, F.concat(repo, F.lit("."))))
        | ((name == "license.txt") & holds(VENDORED_PARTS, low))
    )
    top = ~F.contains(low, F.lit("/"))
    return (
        F.when(dropped, F.lit(None).cast("string"))
        .when(name.isin(*ALLOWED_NAMES), "allowed_exact_filename")
        .when(_any(lambda p: F.startswith(low, p), ALLOWED_FOLDERS) & ext.isin(*ALLOWED_FORMATS), "allowed_path_prefix")
        .when(in_telling_folder(low) & ext.isin(*FOLDER_FORMATS), "allowed_semantic_folder")
        .when(top & ext.isin(".md", ".markdown", ".rst", ".cff"), "allowed_top_level_doc")
        .when(top & (ext == ".ipynb"), "allowed_top_level_notebook")
    )


def symlink_as_text(text: Column) -> Column:
    bare = strip(text)
    return (bare != "") & ~F.contains(bare, F.lit("\n")) & bare.rlike(r"\A(\.\.?/|/|[A-Za-z]:\\)")
