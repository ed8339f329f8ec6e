import os
import subprocess

import pytest

from orrery.sources import git


def run(root, *args, day="2024-01-01", who="ada"):
    env = os.environ | {f"GIT_{r}_{k}": v for r in ("AUTHOR", "COMMITTER") for k, v in (("NAME", who), ("EMAIL", f"{who}@x.org"), ("DATE", f"{day}T00:00:00Z"))}
    subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, env=env)


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run(root, "init", "-b", "main")
    run(root, "remote", "add", "origin", "git@github.com:org/fixture.git")
    (root / "README.md").write_text("hi\n")
    (root / "old.rs").write_text("fn a() {}\n" * 30)
    for n, (day, who) in enumerate([("2024-01-01", "ada"), ("2024-01-11", "grace"), ("2024-01-21", "ada")]):
        with (root / "old.rs").open("a") as f:
            f.write(f"// {n}\n")
        run(root, "add", "-A")
        run(root, "commit", "-m", f"c{n}", day=day, who=who)
    run(root, "mv", "old.rs", "current.rs")
    run(root, "commit", "-m", "rename", day="2024-02-10", who="grace")
    with (root / "current.rs").open("a") as f:
        f.write("// last\n")
    run(root, "commit", "-am", "last", day="2024-05-20")
    return str(root)


def test_inspect_and_tree(spark, repository):
    info = git.git_inspect(spark, repository)
    assert info["world"] == "code.repository:remote:github.com/org/fixture" and info["branch"] == "main" and not info["dirty"]
    files = git.git_tree(spark, repository, info["commit"])
    assert [(r["path"], r["language"]) for r in files.collect()] == [("README.md", None), ("current.rs", "rust")]
    blobs = {r["path"]: bytes(r["content"]) for r in git.git_blobs(files, repository).collect()}
    assert blobs["README.md"] == b"hi\n"


def test_history(spark, repository):
    info = git.git_inspect(spark, repository)
    changes = git.git_changes(spark, repository, info["commit"])
    ts = max(r["ts"] for r in changes.collect())
    history = git.git_history(changes, ts)
    got = {r["path"]: r for r in history.collect()}
    assert "old.rs" not in got
    row = got["current.rs"]
    assert (row["commits"], row["contributors"], row["recent"], row["frequency"], row["average_days"]) == (5, 2, 1, "low", 35.0)
    before = changes.where(changes["ts"] < ts)
    early = {r["path"]: r for r in git.git_history(before, max(r["ts"] for r in before.collect())).collect()}["current.rs"]
    assert (early["commits"], early["recent"], early["frequency"]) == (4, 4, "medium") and early["average_days"] == pytest.approx(40 / 3)
    e = git.git_inventory(git.git_tree(spark, repository, info["commit"]), history, info["world"], info["version"]).collect()
    assert [x["id"] for x in e] == ["file:current.rs"] and [m["name"] for m in e[0]["measurements"]] == ["git.total_commits", "git.contributors", "git.recent_commits", "git.average_days_between_changes"]
    assert {"git.blob_oid", "git.mode", "git.created_at", "git.last_modified_at", "file.size_bytes"} < set(e[0]["attributes"])


def test_rename_overwrites(spark):
    rows = [(0, 0, "a", "", "A", "x", None), (1, 1, "a", "", "A", "y", None), (2, 2, "b", "", "R", "y", "x"), (3, 3, "b", "", "M", "y", None), (4, 4, "b", "", "C", "z", "y")]
    got = git.lineages(spark.createDataFrame(rows, git.CHANGE)).orderBy("seq").collect()
    assert [r["lineage"] for r in got] == ["y", None, "y", "y", "z"]


def test_read_groups():
    assert git.read_groups([2, 2, 100, None, 1], 5) == [[0, 1], [2], [3], [4]]
