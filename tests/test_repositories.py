"""Repository folders with every kind of manifest."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import manifests as m
from graphloom.functions import requirements
from graphloom.plans import repositories as r

REQUIREMENTS = "numpy>=1.2  # fast\n-r other.txt\n-e .\nrequests[socks]==2.0; python_version > '3'\ngit+https://github.com/Org/Tool.git@v1#egg=tool-x&subdirectory=sub\n???\npip\n"
PYPROJECT = """
[project]
name = "Pkg"
dependencies = ["NumPy", "scipy>1"]
requires-python = ">=3.9"
authors = [{name = "B", email = "b@x"}, {name = "A"}]
[project.optional-dependencies]
test = ["pytest", "numpy"]
[tool.poetry.dependencies]
python = "^3.8"
rich = "*"
fork = {git = "https://github.com/o/fork.git", tag = "t"}
[tool.poetry.group.dev.dependencies]
black = {version = "^23"}
[build-system]
requires = ["setuptools", "cython"]
"""
CONDA = "name: env\nchannels: [forge]\ndependencies:\n  - python=3.10=build\n  - Net_CDF=4.1\n  - pip:\n    - xarray\n    - '!!'\n"


def needs(path, text):
    return {(n.name, n.group, n.version) for n in m.findings(path, text) if isinstance(n, m.Need) and m.wanted(n)}


def test_findings():
    found = list(m.findings("requirements.txt", REQUIREMENTS))
    assert [f.issue for f in found if isinstance(f, m.Warned)] == ["include_directive_skipped: -r other.txt", "editable_self_reference_skipped: -e .", "requirement_unparseable: ???"]
    vcs = next(f for f in found if isinstance(f, m.Need) and f.url)
    assert (vcs.name, vcs.url, vcs.ref, vcs.subdirectory, vcs.egg) == ("tool-x", "https://github.com/Org/Tool", "v1", "sub", "tool-x")
    assert needs("pyproject.toml", PYPROJECT) == {("numpy", "runtime", None), ("scipy", "runtime", ">1"), ("pytest", "optional", None), ("numpy", "optional", None), ("rich", "runtime", None), ("fork", "runtime", None), ("black", "dev", "^23"), ("cython", "build", None)}
    assert [f.python for f in m.findings("pyproject.toml", PYPROJECT) if isinstance(f, m.Environment)] == [">=3.9", "^3.8"]
    locked = [f for f in m.findings("environment.yml", CONDA) if isinstance(f, m.Environment)][0]
    assert locked.pins == ["python=3.10=build", "Net_CDF=4.1", "xarray", "!!"] and locked.python == "3.10"
    assert needs("environment.yml", CONDA.replace("=build", "")) == {("net-cdf", "runtime", "4.1"), ("xarray", "runtime", None)}
    assert [f.issue for f in m.findings("environment.yml", "../env.yml")] == ["symlink_as_text_environment_skipped"]
    assert needs("setup.py", "from setuptools import setup\nsetup(install_requires=['a', 'b>1'], extras_require={'x': ['c']})") == {("a", "runtime", None), ("b", "runtime", ">1"), ("c", "optional", None)}
    assert [f.issue for f in m.findings("setup.py", "import s\ns.setup(install_requires=read())") if isinstance(f, m.Warned)] == ["setup_py_install_requires_deferred_unparseable"]
    assert needs("setup.cfg", "[options]\ninstall_requires =\n  a\n  b<2\n[options.extras_require]\ndoc = sphinx\n[metadata]\nname = n\nauthor = A\n") == {("a", "runtime", None), ("b", "runtime", "<2"), ("sphinx", "optional", None)}
    assert needs("Pipfile", '[packages]\nflask = "*"\n[dev-packages]\ntox = ">3"\n') == {("flask", "runtime", None), ("tox", "dev", ">3")}
    lock = [f for f in m.findings("Pipfile.lock", '{"default": {"b": 1, "a": 2}, "develop": {"c": 1}}') if isinstance(f, m.Environment)][0]
    assert lock.pins == ["b", "a", "c"]
    lock = [f for f in m.findings("requirements.txt", "a==1\n# c\n\nb==2\n", locked=True)]
    assert lock == [m.Verdict("lock"), m.Environment("requirements_lock", pins=["a==1", "b==2"])]


def test_verdicts(spark):
    pins = [f"p{i}==1" for i in range(60)]
    cases = {"a; python_version > '3'": "lock", "a\nb": "direct", "": "direct", "# x\n-r y\n-e .": "direct", "\n".join([*pins, "six==1", "idna==2"]): "lock", "\n".join([*pins, "six==1"]): "direct", "\n".join([*pins[:57], "six==1", "idna==2"]): "direct", "\n".join(["a; python_version > '3'"] * 4 + ["b"] * 2): "lock", "\n".join(["a; python_version > '3'"] * 3 + ["b"] * 2): "direct"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", requirements.verdict(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in rows} == cases


LINES = {
    "git+https://github.com/Org/Tool.git@v1#egg=tool-x&subdirectory=sub": ("tool-x", "https://github.com/Org/Tool", "v1", "sub", "tool-x"),
    "Name_X @ git+https://h.org/o/r.git@feature/y": ("name-x", "https://h.org/o/r", "feature/y", None, None),
    "git+ssh://git@h.org/o/r.git": ("r", "ssh://git@h.org/o/r", None, None, None),
    "git+https://u@h.org/o/a.b/": ("a-b", "https://u@h.org/o/a.b", None, None, None),
    "git+https://h.org/o/r@a@b": ("r@a", "https://h.org/o/r", "b", None, None),
    "git+https://h.org/o/r?x=1#subdirectory=s%20t": ("r", "https://h.org/o/r?x=1", None, "s t", None),
    "numpy>1": None,
    "https://h.org/o/r": None,
}


def test_one_grammar_for_both(spark):
    """Columns and whole manifests take the same parts from a line, and clean it alike."""
    odd = ["a # b", "a#b", "  x  # y # z", "git+https://h/o#egg=n # c", "# only", "http://x # c", "a\t#c", "git+https://h.org/o/r.git@v1", "git@github.com:o/r.git", " https://h.org/r/ ", "https://h.org/r.git/@v2", "https://u@h.org/r", "https://h.org/r@v1/", "ssh://g@r.git", "h.org/r.git", ""]
    rows = spark.createDataFrame([(t,) for t in [*LINES, *odd]], "t string")
    got = rows.select("t", requirements.uncommented(F.col("t")).alias("bare"), requirements.repository_url(F.col("t")).alias("url"), requirements.repository_parts(F.col("t")).alias("parts")).collect()
    for r in got:
        assert r.bare == m.uncommented(r.t) and r.url == m.repository_url(r.t), r.t
        assert (r.parts.asDict() if r.parts else None) == m.from_repository(r.t), r.t
        if r.t in LINES:
            assert (tuple(r.parts) if r.parts else None) == LINES[r.t]
    assert {r.t: r.bare for r in got if r.t in odd[:7]} == {"a # b": "a", "a#b": "a#b", "  x  # y # z": "x", "git+https://h/o#egg=n # c": "git+https://h/o#egg=n # c", "# only": "# only", "http://x # c": "http://x", "a\t#c": "a"}
    want = {"git+https://h.org/o/r.git@v1": "https://h.org/o/r", "git@github.com:o/r.git": "https://github.com/o/r", " https://h.org/r/ ": "https://h.org/r", "https://h.org/r.git/@v2": "https://h.org/r", "https://u@h.org/r": "https://u@h.org/r", "https://h.org/r@v1/": "https://h.org/r@v1", "ssh://g@r.git": "ssh://g@r", "h.org/r.git": "h.org/r"}
    assert {r.t: r.url for r in got if r.t in want} == want


@pytest.mark.parametrize(
    "raw,want",
    [("git+https://github.com/a/b.git@main", "https://github.com/a/b"), ("git@github.com:a/b.git", "https://github.com/a/b"), ("git+ssh://git@host/a/b.git#egg=x", "ssh://git@host/a/b"), ("https://x.org/r/", "https://x.org/r")],
)
def test_repository_url(raw, want):
    assert m.repository_url(raw) == want


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    contents = {"README.md": "see https://github.com/a/b). and https://datasets.example.org/resource/1, 10.1234/abc.", "requirements.txt": REQUIREMENTS, "docs/requirements.txt": "numpy\n", "pyproject.toml": PYPROJECT, "CITATION.cff": "cff-version: 1.2\ntitle: T\ndoi: 10.1/x\nauthors:\n  - family-names: L\n    given-names: A\n", "Dockerfile": "FROM x"}
    one = root / "one"
    for path, text in contents.items():
        (one / "contents" / path).parent.mkdir(parents=True, exist_ok=True)
        (one / "contents" / path).write_text(text)
    (one / "contents" / "latin.txt").write_bytes(b"caf\xe9")
    listed = [{"path": p, "file_name": p.rpartition("/")[2], "extension": "." + p.rpartition(".")[2] if "." in p else "", "size_bytes": len(t), "downloaded": True, "selection_reason": "allowed_exact_filename"} for p, t in contents.items()]
    listed.append({"path": "big.bin", "file_name": "big.bin", "extension": ".bin", "size_bytes": 9, "downloaded": False, "selection_reason": None})
    (one / "files_manifest.json").write_text(json.dumps(listed))
    (one / "repo_metadata.json").write_text(json.dumps({"id": 7, "name": "One", "html_url": "https://github.com/o/one/", "license": {"key": "mit", "spdx_id": "MIT"}, "fork": True}))
    (one / "archive_info.json").write_text(json.dumps({"frozen_commit_sha": "abc", "default_branch": "main"}))
    (one / "contributors.json").write_text(json.dumps([{"id": None, "login": "z"}, {"id": 5, "login": "b", "type": "Bot"}, {"id": 2, "login": "a"}]))
    two = root / "two"
    two.mkdir()
    (two / "repo_metadata.json").write_text("{broken")
    built = r.build(r.raw_files(spark, str(root))).cache()
    return built, {x["name"]: x for x in built.collect()}


def test_record(corpus):
    built, rows = corpus
    one, two = rows["One"], rows["two"]
    assert set(built.columns) == set(r.RECORD_FIELDS)
    deps = {d.name: d for d in one.dependencies}
    assert set(deps) == {"numpy", "requests", "scipy", "pytest", "rich", "black", "cython"}
    assert [(s.manifest_path, s.manifest_scope) for s in deps["numpy"].sources] == [("docs/requirements.txt", "docs"), ("pyproject.toml", "root"), ("pyproject.toml", "root"), ("requirements.txt", "root")]
    assert deps["numpy"].dep_group == "runtime" and deps["requests"].extras == ["socks"] and deps["requests"].marker
    assert [d.vcs_url for d in one.repo_dependencies] == ["https://github.com/o/fork", "https://github.com/Org/Tool"]
    assert one.default_branch == "main" and one.fork and one.license.is_spdx and one.files.has_dockerfile
    assert [c.login for c in one.contributors] == ["a", "b", "z"] and one.contributors[1].is_bot
    assert one.files.selection_reason_histogram == {"None": 1, "allowed_exact_filename": 6} and one.files.downloaded_count == 6
    assert one.citation.doi == "10.1/x" and one.citation.software_authors[0].family_names == "L"
    assert [i.id_type for i in one.identifiers] == ["commit_sha", "doi", "repo_url"]
    assert one.readme.deterministic_urls.code == ["https://github.com/a/b"] and one.readme.deterministic_urls.dois == ["10.1234/abc"] and len(one.readme.deterministic_urls.dataset) == 1
    assert one.provenance.source_artifact == "https://github.com/o/one/tree/abc"
    assert one.provenance.manifest_classifications == {"docs/requirements.txt": "direct", "pyproject.toml": "direct", "requirements.txt": "direct"}
    assert len(one.provenance.parse_warnings) == 3 and [e.python_version for e in one.execution_environment] == [">=3.9", "^3.8"]
    assert [w.issue for w in two.provenance.parse_warnings] == ["source_artifact_missing_html_url_or_frozen_commit_sha", "invalid_json"] or {w.issue for w in two.provenance.parse_warnings} == {"source_artifact_missing_html_url_or_frozen_commit_sha", "invalid_json"}
    assert two.dependencies == [] and two.citation.format == "none" and not two.readme.present
    assert json.loads(one.software_metadata[0])["manifest_type"] == "pyproject_toml"


def test_report(corpus):
    built, _ = corpus
    assert r.issues(built).count() == 0
    total = r.report(built).first()
    assert (total.repo_count, total.dependency_count, total.repo_dependency_count, total.direct_manifest_count) == (2, 7, 2, 3)
    assert [x["name"] for x in r.ordered(built).collect()] == ["One", "two"]
